"""Tags of tokens from spans of characters, and label ids of one length for training."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import TEXTS, lists_of

TOKENS = "array<struct<token string, start int, stop int>>"
TOKEN_TYPES = {"token": pa.string(), "start": pa.int32(), "stop": pa.int32()}
#: The length of a training row, and the label that a loss leaves out.
LENGTH, NO_LABEL = 128, -100
#: Tags that a vocabulary may have.
MOST_TAGS = 10_000
#: White space among the code points up to its last one.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)])


def tokenized(rows: DataFrame, text: str = "text", tokenizer: Callable[[list[str]], list[list[tuple[str, int, int]]]] | None = None) -> DataFrame:
    """Adds tokens, each with its places in the text (code points, stop exclusive). tokenizer: a function from a list of texts to lists of
    (token, start, stop); the default takes what stands between white space. A null text has none."""

    @F.arrow_udf(TOKENS)
    def tokens(column: pa.Array) -> pa.Array:
        return lists_of(column, tokenizer, TOKEN_TYPES) if tokenizer else _words(column)

    return rows.withColumn("tokens", tokens(F.col(text)))


def _words(texts: pa.Array) -> pa.Array:
    """What stands between white space, with its places: TEXTS texts are taken as one, with a blank between them."""
    done = []
    for at in range(0, len(texts), TEXTS):
        some = [t or "" for t in texts.slice(at, TEXTS).to_pylist()]
        joint = "\n".join(some) + "\n"
        codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~(SPACE[np.minimum(codes, len(SPACE) - 1)] & (codes < len(SPACE)))
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        starts, stops = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in some)])
        ends = np.searchsorted(starts, begins)
        shift = np.repeat(begins[:-1], np.diff(ends))
        columns = (pa.array(joint.split(), pa.string()), pa.array((starts - shift).astype(np.int32)), pa.array((stops - shift).astype(np.int32)))
        done.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, names=list(TOKEN_TYPES))))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.struct(list(TOKEN_TYPES.items()))))


def _numbers(lists: pa.Array, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.struct_field(lists.flatten(), name), -1), dtype=np.int64)


def _owners(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists (null ones are empty), and of each element the list that it is in."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes)


def _tags(tokens: pa.Array, spans: pa.Array) -> pa.Array:
    """Both lists of a row are walked side by side, for all rows of a batch at once: a row's places are moved behind those of the row
    before, so that one search among all starts and one among all stops finds the tokens of every span."""
    sizes, row = _owners(tokens)
    a, b = _numbers(tokens, "start"), _numbers(tokens, "stop")
    _, of = _owners(spans)
    first, last = _numbers(spans, "start"), _numbers(spans, "stop")
    step = max((int(x.max()) for x in (a, b, first, last) if len(x)), default=0) + 2
    wide = np.flatnonzero((a >= 0) & (b > a))
    starts, stops = row[wide] * step + a[wide], row[wide] * step + b[wide]
    if (np.diff(starts) < 0).any() or (np.diff(stops) < 0).any():
        raise ValueError("the tokens of a text must stand in the order of their places")
    good = np.flatnonzero((first >= 0) & (last > first))
    lo, hi = np.searchsorted(starts, of[good] * step + first[good], "left"), np.searchsorted(stops, of[good] * step + last[good], "right")
    held = np.maximum(hi - lo, 0)
    span = np.repeat(np.arange(len(good)), held)
    nth = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    names, number = np.unique(np.asarray(pc.fill_null(pc.struct_field(spans.flatten(), "label"), ""), dtype=str), return_inverse=True)
    tags = np.zeros(len(a), dtype=np.int64)
    tags[wide[lo[span] + nth]] = 1 + 2 * number[good][span] + (nth > 0)  # of a place that comes twice the last stays
    spelled = pa.array(["O", *(f"{p}-{n}" for n in names for p in "BI")], pa.string())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), spelled.take(pa.array(tags)))


def aligned(rows: DataFrame, tokens: str = "tokens", spans: str = "spans", tags: str = "ner_tags") -> DataFrame:
    """Adds tags: a tag a token, B-label for the first token that lies within a span, I-label for the others, else O. Where spans overlap
    the later one of the list counts. Tokens without width (a tokenizer's marks) and spans without width or label places are O and nothing; null
    lists are empty. Tokens may share places, but neither their starts nor their stops may go back: that is an error."""
    return rows.withColumn(tags, F.arrow_udf(_tags, "array<string>")(F.col(tokens), F.col(spans)))


def vocabulary(rows: DataFrame, tags: str = "ner_tags") -> list[str]:
    """The tags of rows, O first, then by name: some dozen; more than MOST_TAGS are an error."""
    found = [r[0] for r in rows.select(F.explode_outer(tags).alias("t")).where("t is not null").distinct().limit(MOST_TAGS + 1).collect()]
    if len(found) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    return sorted({*found, "O"}, key=lambda t: (t != "O", t))


def padded(values: Column, fill: Column | int = NO_LABEL, length: int = LENGTH) -> Column:
    """An array cut or filled up to one length."""
    fill = F.lit(fill) if isinstance(fill, int) else fill
    return F.slice(F.concat(F.coalesce(values, F.array().cast("array<int>")), F.array_repeat(fill, length)), 1, length)


def label_ids(tags: Column, names: list[str], length: int = LENGTH) -> Column:
    """Tags as their places in names, of one length, NO_LABEL behind the last one. A tag that names lacks is an error."""
    known = F.array(*map(F.lit, names))

    def number(t: Column) -> Column:
        at = F.array_position(known, t).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce(t, F.lit("null")))).cast("int"))

    return padded(F.transform(F.slice(tags, 1, length), number), NO_LABEL, length)
