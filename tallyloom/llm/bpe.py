"""Byte-level BPE over the distinct words of the corpus.

1. Each task splits its texts into pre-tokens.  A block of its documents keeps every document as places in the block's list of
   distinct words (the exploded words and their positions, packed), and hands out that list, dealt by the hash of the word.
2. All blocks' lists meet by hash: each distinct word is encoded once, and the ids go back to every block that has it.
3. A block's ids and documents meet, and the documents are put together by position.

Words and ids travel packed and compressed, some bytes each.  Decoding joins the ids with the table of token bytes, which is as large
as the vocabulary (some 0.5 MB) and so broadcast: an id is its row's number.
"""

from __future__ import annotations

import base64
from functools import cache
from hashlib import sha256

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, cut, keep_columns, sliced, width
from .split import Places, splitter

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Words of the documents that are packed together.
PACK = 1_000_000
#: Words of the documents that go out together.
OUT = 200_000


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where the token of each id starts (one more at the end)."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    sizes = np.zeros(pairs[-1][0] + 1, np.int64)
    for i, token in pairs:
        sizes[i] = len(token)
    return np.frombuffer(b"".join(t for _, t in pairs), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[bounds[w]:bounds[w + 1]] for every w, in a row."""
    sizes = bounds[which + 1] - bounds[which]
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(bounds[which] - (ends - sizes), sizes)]


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The bytes of all ids, each joined with its row of the token table."""
    return gather(*table, ids.astype(np.int64)).tobytes()


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_words(words: list[bytes]) -> bytes:
    return _pack(np.array([len(words), *map(len, words)], np.uint32).tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = _unpack(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    at = 4 * (n + 1)
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends)]


def _split(pattern: str, buckets: int, most: int):
    """Rows of a block, by kind. 0: its words of one bucket; 1: the bucket of each word; 2: some documents, as places in the list of words."""

    def run(batches):
        from pyspark import TaskContext

        matches = splitter(pattern)
        task, serial = TaskContext.get().partitionId(), 0
        places = Places()
        docs: list[tuple] = []
        amount = 0

        def block():
            nonlocal serial, places, docs, amount
            # frequent words get small numbers, which pack well
            times = np.zeros(len(places), np.int64)
            for _, x, _ in docs:
                times += np.bincount(x, minlength=len(places))
            number = np.argsort(-times, kind="stable")
            rank = np.empty(len(places), np.uint32)
            rank[number] = np.arange(len(places))
            words = list(places)
            raw = [words[i].encode("utf-8", "replace") for i in number.tolist()]
            bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in raw), np.uint32, len(raw))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            packed = [_pack_words([raw[i] for i in order[cuts[b] : cuts[b + 1]]]) for b in full]
            groups, size = [[]], 0
            for doc in docs:
                if size > PACK:
                    groups.append([])
                    size = 0
                groups[-1].append(doc)
                size += len(doc[1])
            packs = [([i for ids, _, _ in g for i in ids], _pack(_planes(np.concatenate([c for _, _, c in g])) + _planes(rank[np.concatenate([x for _, x, _ in g])]))) for g in groups]
            k, d = len(full), len(packs)
            yield {
                "block": [(task << 32) | serial] * (k + 1 + d),
                "kind": [0] * k + [1] + [2] * d,
                "bucket": [*full, *[None] * (1 + d)],
                "doc_ids": [*[None] * (k + 1), *(ids for ids, _ in packs)],
                "payload": [*packed, _pack(_planes(bucket)), *(raw for _, raw in packs)],
            }
            serial, places, docs, amount = serial + 1, Places(), [], 0

        for batch in sliced(batches):
            found, texts = [], column(batch, "text").to_pylist()
            for text in texts:
                words = matches(text or "")
                found.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            counts = np.array([len(x) for x in found], np.uint32)
            docs.append((column(batch, "doc_id").to_pylist(), np.concatenate(found), counts))
            amount += sum(len(t or "") for t in texts)
            if amount > most:
                yield from block()
        if docs:
            yield from block()

    return run


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all lowest bytes first, and so on: the high ones compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _encode_words(path: str, pattern: str):
    """Rows sorted by bucket. Each word of a bucket is encoded at its first block; the ids go out to every block."""

    def run(batches):
        piece = encoding(path, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            out = {k: [] for k in ("block", "bucket", "payload")}
            for block, bucket, payload in zip(*(column(batch, c).to_pylist() for c in ("block", "bucket", "payload"))):
                if bucket != last:
                    known, last = {}, bucket
                ids = []
                for w in _unpack_words(payload):
                    if (x := known.get(w)) is None:
                        x = known[w] = piece(w)
                    ids.append(x)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                out["block"].append(block), out["bucket"].append(bucket)
                out["payload"].append(_pack(np.uint32(len(ids)).tobytes() + _planes(sizes) + _planes(flat)))
            yield out

    return run


def _assemble(tokens):
    """tokens: the broadcast token table. Rows sorted by block, kind, bucket: the ids of the block's words, the words' buckets, then the documents."""

    def run(batches):
        block = None
        for batch in batches:
            for number, kind, doc_ids, payload in zip(*(column(batch, c).to_pylist() for c in ("block", "kind", "doc_ids", "payload"))):
                raw = _unpack(payload)
                if number != block:
                    block, sizes, flats = number, [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
                if kind == 0:
                    n = int(np.frombuffer(raw, np.uint32, 1)[0])
                    sizes.append(_unplanes(raw[4 : 4 + 4 * n]))
                    flats.append(_unplanes(raw[4 + 4 * n :]))
                elif kind == 1:
                    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
                    flat = np.concatenate(flats)
                    slot = np.argsort(np.argsort(_unplanes(raw), kind="stable"), kind="stable")
                else:
                    counts = _unplanes(raw[: 4 * len(doc_ids)])
                    places = slot[_unplanes(raw[4 * len(doc_ids) :])]
                    ends = np.cumsum(counts, dtype=np.int64)
                    cuts, done = ends.tolist(), 0
                    while done < len(doc_ids):  # some documents at a time, a long one alone
                        to = max(done + 1, int(np.searchsorted(ends, (cuts[done - 1] if done else 0) + OUT, "right")))
                        ids = [gather(flat, bounds, places[a:b]) for a, b in zip((ends - counts)[done:to].tolist(), cuts[done:to])]
                        yield {"doc_id": doc_ids[done:to], "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids], "decoded": [decode(x, tokens.value) for x in ids]}
                        done = to

    return run


def encode_corpus(docs: DataFrame, path: str, pattern: str, digests: bool = False, block: int = BLOCK) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns a row for each row: doc_id, n_tokens (long), ids (binary: little-endian
    unsigned 32-bit integers) and decoded (binary: the ids' bytes); with digests, their SHA-256 in lowercase hex instead.

    block: characters in a block; fewer take less memory (a worker holds a block's distinct words) and more shuffle.
    path: ranks in tiktoken's format, readable on every executor; pattern: what splits texts into words. Special tokens do not exist.
    Null and empty texts have no tokens; rows that repeat stay; null doc_ids are kept.
    """
    n = width(docs.sparkSession)
    parts = cut(arrow_map(keep_columns(docs, "doc_id", "text"), _split(pattern, 2 * n, block), "block long, kind int, bucket int, doc_ids array<long>, payload binary"))
    words = parts.where("kind = 0").select("block", "bucket", "payload").repartition(n, "bucket").sortWithinPartitions("bucket")
    ids = arrow_map(words, _encode_words(path, pattern), "block long, bucket int, payload binary")
    ids = ids.select("block", F.lit(0).alias("kind"), "bucket", F.lit(None).cast("array<bigint>").alias("doc_ids"), "payload")
    whole = ids.union(parts.where("kind > 0")).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")

    tokens = docs.sparkSession.sparkContext.broadcast(token_table(path))

    def assemble(batches):
        if not digests:
            yield from _assemble(tokens)(batches)
            return
        for x in _assemble(tokens)(batches):
            yield {"doc_id": x["doc_id"], "n_tokens": x["n_tokens"], "ids_sha256": [sha256(b).hexdigest() for b in x["ids"]], "decoded_sha256": [sha256(b).hexdigest() for b in x["decoded"]]}

    return arrow_map(whole, assemble, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"))
