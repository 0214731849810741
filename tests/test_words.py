"""The default tokens against re, text by text."""

import random
import re

import pyarrow as pa

from tallyloom.plans import alignment, annotate


def test_words_and_their_places():
    r = random.Random(4)
    letters = ["a", "B", "é", "𝄞", "-", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "　", "、", "​", "\x00"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3 * annotate.TEXTS + 7)] + ["", None, " ", "x"]
    got = alignment._words(pa.array(texts)).to_pylist()
    assert got == [[{"token": m[0], "start": m.start(), "stop": m.end()} for m in re.finditer(r"\S+", t or "")] for t in texts]
    assert alignment._words(pa.array([], pa.string())).to_pylist() == []
