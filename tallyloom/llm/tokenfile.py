"""Token files: independent zstandard frames, a document index and a trailing seek table with a checksum for each frame.

A file holds the token ids of a run of documents in ascending order of doc_id:

    frame 0 | frame 1 | ... | skippable frame: index of documents | skippable frame: seek table

Each frame holds FRAME_IDS ids (the last one fewer) as little-endian unsigned 32-bit integers.  Index (magic 0x184D2A50): a zstandard
frame of the number of documents, then their ids (64 bits), whether each id is null (a byte) and their numbers of ids (64 bits).  The
seek table has the public seekable format (magic 0x184D2A5E; a frame's compressed size, size and lowest 32 bits of XXH64; at the end
the number of frames, a flag byte and 0x8F92EAB1), so a reader of that format opens the file, and a document's ids are found by
decompressing only the frames that hold them.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .common import arrow_map, column, cut, in_id_order, keep_columns, shared_dir, sliced, width
from .split import PATTERN, spaced, splitter

FRAME_IDS = 1 << 16
_SEEK, _INDEX, _END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1_500_000


class _Words(dict):
    """Words to numbers; new words get the next ones and are listed until they are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _extended(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """old with more behind its first `used` items; room is doubled when it runs out."""
    if used + len(more) > len(old):
        old = np.concatenate([old[:used], np.empty(max(used, len(more)) + len(more), old.dtype)])
    old[used : used + len(more)] = more
    return old


class Encoder:
    """Ids by the tokenizers library. Its byte-level tokenizers split a text by a fixed pattern and encode each word by itself, so that
    each distinct word is encoded once; texts that hold an added token's string go through the library whole, as do all texts of
    other kinds of tokenizer."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer")
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.words = splitter(PATTERN)
        # bytes of each token: a byte-level vocabulary writes each byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.places, self.known = _Words(), 0
        self.flat, self.bounds = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encodes new words and remembers them. Runs of words that a space opens go through the library as one text, which it splits
        just so; the tokens' bytes tell where each word ends."""
        runs, ids, counts = [], [], []
        for w in words:
            plain = spaced(w) is not None
            if not runs or runs[-1][0] != plain or len(runs[-1][1]) > 4000:
                runs.append((plain, []))
            runs[-1][1].append(w)
        alone = [w for plain, run in runs if not plain for w in run]
        encoded = iter(self.whole(["".join(run) for plain, run in runs if plain]))
        single = iter(self.whole(alone))
        for plain, run in runs:
            if not plain:
                part = [next(single) for _ in run]
                ids += part
                counts += map(len, part)
                continue
            got = next(encoded)
            ends = np.cumsum([len(w.encode("utf-8", "replace")) for w in run])
            reached = np.cumsum(self.sizes[got])
            at = np.searchsorted(reached, ends)
            if len(reached) and at[-1] == len(reached) - 1 and (reached[at] == ends).all():
                ids.append(got)
                counts += np.diff(at + 1, prepend=0).tolist()
            else:
                part = self.whole(run)
                ids += part
                counts += map(len, part)
        end = int(self.bounds[self.known])
        self.flat = _extended(self.flat, end, np.concatenate(ids))
        self.bounds = _extended(self.bounds, self.known + 1, end + np.cumsum(counts))
        self.known += len(words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.places) > REMEMBERED:
            self.forget()
        number, at, odd = self.places.__getitem__, [], []
        for i, t in enumerate(texts):
            if any(a in t for a in self.added):
                odd.append(i)
                t = ""
            found = self.words(t)
            at.append(np.fromiter(map(number, found), np.int64, len(found)))
        if self.places.new:
            new, self.places.new = self.places.new, []
            self.learn(new)
        every = np.concatenate([np.empty(0, np.int64), *at])
        ids, ends = gather(self.flat, self.bounds, every), np.concatenate(([0], np.cumsum(self.bounds[every + 1] - self.bounds[every])))
        cuts = ends[np.cumsum([0, *map(len, at)])].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, x in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = x
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class TokenFileWriter:
    def __init__(self, sink):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=1)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.table = 0, []
        self.ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0), self.nulls.append(doc_id is None), self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= FRAME_IDS:
            every = np.concatenate(self.waiting)
            full = len(every) // FRAME_IDS * FRAME_IDS
            for a in range(0, full, FRAME_IDS):
                self._frame(every[a : a + FRAME_IDS])
            self.waiting, self.n_waiting = [every[full:]], len(every) - full

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.pack.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.sink.write(packed)

    def close(self) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        index = struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.counts, "<u8").tobytes()
        packed = self.pack.compress(index)
        self.sink.write(struct.pack("<II", _INDEX, len(packed)) + packed)
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.sink.write(struct.pack("<II", _SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0x80, _END))


class TokenFile:
    """Random access to a token file; only the frames asked for are read and decompressed, and their checksums are verified."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, _, end = struct.unpack("<IBI", self._read(size - 9, 9))
        if end != _END:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        self.firsts = np.concatenate(([0], np.cumsum(table[:, 1] // 4, dtype=np.int64)))
        self.sums = table[:, 2]
        magic, length = struct.unpack("<II", self._read(int(self.starts[-1]), 8))
        if magic != _INDEX:
            raise ValueError("no index of documents after the frames")
        index = self.unpack.decompress(self._read(int(self.starts[-1]) + 8, length))
        n = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.nulls = np.frombuffer(index, np.uint8, n, 8 + 8 * n).astype(bool)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64))))
        self.kept: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            raw = self.unpack.decompress(self._read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} has a wrong checksum")
            self.kept = (k, np.frombuffer(raw, "<u4"))
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        parts, k = [np.empty(0, np.uint32)], int(np.searchsorted(self.firsts, a, "right")) - 1
        while a < b:
            f, first = self.frame(k), int(self.firsts[k])
            parts.append(f[a - first : b - first])
            a, k = first + len(f), k + 1
        return np.concatenate(parts)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as token files into a folder that all executors share; returns the manifest: file string, part int,
    n_docs, n_tokens, start (long: ids in the files before it), one row a file.

    Documents are in ascending order of doc_id (nulls first), then text; each ends with end_id; null texts are empty. A task that is run
    again writes a file of another name, and the manifest names the files of the runs that counted. Without documents there are no files.
    """
    spark, n = docs.sparkSession, width(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = keep_columns(docs, "doc_id", "text")
    dealt, _ = in_id_order(docs)
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches):
        fs, place = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        part = name = sink = out = None

        def close():
            out.close()
            sink.close()
            return {"file": [name], "part": [part], "n_docs": [len(out.ids)], "n_tokens": [sum(out.counts)]}

        for batch in sliced(batches, limit=1 << 20):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            for bucket, doc_id, ids in zip(column(batch, "bucket").to_pylist(), column(batch, "doc_id").to_pylist(), encoder(tokenizer).encode(texts)):
                if bucket != part:
                    if part is not None:
                        yield close()
                    part, name = bucket, f"part-{bucket:07d}-{uuid.uuid4().hex}.tokens"
                    sink = fs.open_output_stream(f"{place}/{name}")
                    out = TokenFileWriter(sink)
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
        if part is not None:
            yield close()

    files = cut(arrow_map(ordered, write, "file string, part int, n_docs long, n_tokens long"))
    totals = sorted((r.part, r.n_tokens) for r in files.select("part", "n_tokens").collect())  # one row a file
    starts = dict(zip((p for p, _ in totals), np.concatenate(([0], np.cumsum([t for _, t in totals])))[:-1].tolist())) if totals else {}
    placed = spark.createDataFrame(list(starts.items()), "part int, start long")
    return files.join(F.broadcast(placed), "part").select(F.concat(F.lit(f"{folder}/"), "file").alias("file"), "part", "n_docs", "n_tokens", "start")


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens, ids_crc32 (long) and, with_ids, ids (array<int>); of doc_ids only, if given."""
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)

    def read(batches):
        for batch in batches:
            for file, base in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_file(place) as source:
                    f = TokenFile(source)
                    some = np.arange(len(f.doc_ids)) if wanted is None else np.flatnonzero(np.isin(f.doc_ids, wanted) & ~f.nulls)
                    for a in range(0, len(some), 2000):
                        out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                        for i in some[a : a + 2000].tolist():
                            ids = f.ids(i)
                            out["doc_id"].append(None if f.nulls[i] else int(f.doc_ids[i]))
                            out["start"].append(base + int(f.bounds[i])), out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(ids.tobytes())), out["ids"].append(ids.astype(np.int32) if with_ids else None)
                        yield out

    spread = manifest.repartition(width(manifest.sparkSession), "part")
    out = arrow_map(spread.select("file", "start"), read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return out if with_ids else out.drop("ids")


def token_roundtrip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs and reads them back, a row for each row; see write_tokens and read_tokens."""
    return read_tokens(write_tokens(docs, tokenizer, end_id))
