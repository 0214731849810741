"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, every pair verified once.

A document's set holds the 64-bit hashes of its distinct word shingles.  The order of shingles is rare first: those that many
documents share (counted over all documents) come last, ties by hash.  Two sets of Jaccard similarity t or more then share one of
the first n - ceil(t * n) + 1 shingles of either.

1. Documents with one set become one entity, so exact copies never meet each other.
2. Entities meet on prefix shingles.  In each shingle's group every entity is paired with the most central one of fitting length
   (that with the fewest rare shingles, as a template has beside its copies) and, in small groups, with all.  The number of pairs is
   linear in the rows.
3. Distinct pairs are verified once against the whole sets; verified links make components.
4. A group that still holds several components may hide links that step 2 did not pair.  Groups with the same least entity, their hub,
   are looked at together (a template's many shingles have one); they are not joined further.  Within a hub's group every entity outside
   the largest component is compared with the entities of other components whose sizes can fit. A hub's group of up to two blocks
   goes to one task, each set once. In larger ones entities are ranged by size, each range is compared with itself and its neighbours,
   block by block of BLOCK entities, through one matrix product a pair of blocks. The sets travel in as many rounds as keep a
   round's shuffle to a share of all sets, as the pairs of blocks grow with the square of a hub's group.
   No link between components is lost and no pair is emitted unless it links.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, cut, drop_shuffles, keep_columns, sliced, width
from .graph import components
from .kernels import U64, encode, shingle_sets

#: Shingles whose counts are kept to order by: the most frequent ones; the others count as rare. 16 bytes each are broadcast.
FREQUENT = 200_000
#: Groups of up to this many entities are paired in full.
SMALL = 32
#: Entities in a block of step 4.
BLOCK = 1024
#: Of the bytes of all sets, the share that a round of step 4 may shuffle, and bytes that it may in any case.
ROUND_SHARE, ROUND_BYTES = 0.25, 256 << 20
#: Entities up to this many are broadcast to find their texts (some 60 bytes each); beyond it, the join shuffles the texts of ids that a
#: bitmap lets pass, with SIEVE bits an id and MOST_BITS at most (a broadcast of 32 MB).
BROADCAST_IDS, SIEVE, MOST_BITS = 500_000, 32, 1 << 28
#: Members of a pivot that are verified in one task.
PORTION = 500
PARTS = 16


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [encode(t) for t in column(batch, "text").to_pylist()]


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent shingles, counted over all documents.

    A task reports what at least two of some thousand of its documents share; this orders prefixes only, no result depends on it.
    """

    def count(batches):
        keys, counts, waiting = np.empty(0, U64), np.empty(0, np.int64), []

        def settle():
            nonlocal keys, counts, waiting
            k, c = np.unique(np.concatenate([np.empty(0, U64), *waiting]), return_counts=True)
            waiting = []
            known = np.searchsorted(keys, k)
            known[known == len(keys)] = 0
            seen = (keys[known] == k) if len(keys) else np.zeros(len(k), bool)
            counts[known[seen]] += c[seen]
            new = ~seen & (c > 1)
            keys, counts = np.concatenate([keys, k[new]]), np.concatenate([counts, c[new]])
            if len(keys) > 2 * FREQUENT:
                most = np.argpartition(-counts, FREQUENT)[:FREQUENT]
                keys, counts = keys[most], counts[most]
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]

        for batch in sliced(batches):
            waiting += shingle_sets(_texts(batch), words)
            if sum(map(len, waiting)) > 500_000:
                settle()
        settle()
        yield {"h": keys.view(np.int64), "c": counts}

    counted = cut(arrow_map(docs.select("text"), count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    # the least count at which the table keeps its bound
    sizes = sorted(((r.c, r["count"]) for r in counted.groupBy("c").count().collect()), reverse=True)  # a row for each different count
    total, floor = 0, 1 << 62
    for c, k in sizes:
        if total + k > FREQUENT:
            break
        total, floor = total + k, c
    top = counted.where(F.col("c") >= floor).toArrow()
    h, c = top["h"].to_numpy().view(U64), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _prefix_length(n, num: int, den: int):
    """n - ceil(t * n) + 1 for t = num / den."""
    return n - -(-n * num // den) + 1


def _sets(words: int, num: int, den: int, frequent):
    def run(batches):
        heavy, counts = frequent.value
        for batch in sliced(batches):
            out = {k: [] for k in ("n", "light", "key", "prefix")}
            for s in shingle_sets(_texts(batch), words):
                n = len(s)
                at = np.searchsorted(heavy, s)
                at[at == len(heavy)] = 0
                known = heavy[at] == s if len(heavy) else np.zeros(n, bool)
                rest = s[known]
                ordered = np.concatenate([s[~known], rest[np.argsort(counts[at[known]], kind="stable")]])
                out["n"].append(n)
                out["light"].append(n - len(rest))
                out["key"].append(blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                out["prefix"].append(ordered[: _prefix_length(n, num, den)].view(np.int64) if n else np.empty(0, np.int64))
            yield {"doc_id": column(batch, "doc_id"), **out}

    return run


def _pair_up(num: int, den: int):
    """Rows sorted by token, light, n, eid. Yields pairs (kind 0: a, b, their sizes, shingles met on in groups paired in full, whether the
    first-shingle filters let them pass anywhere) and the rows of groups larger than SMALL (kind 1: token, eid, size)."""
    names = ("token", "light", "n", "eid", "pos")

    def fits(n1, p1, n2, p2):
        """The length filter, then the positional filter: what can still be shared from these places on.

        It is that of a pair's first shared shingle, where nothing before can be shared; every pair that links passes it there.
        """
        low, high = np.minimum(n1, n2), np.maximum(n1, n2)
        need = -(-num * (n1 + n2) // (num + den))
        return (den * low >= num * high) & (np.minimum(n1 - p1, n2 - p2) >= need)

    def run(batches):
        carry = None  # the last group so far: its first SMALL rows, the pivots in force and its size
        for batch in batches:
            new = {c: column(batch, c).to_numpy(zero_copy_only=False) for c in names}
            if not len(new["token"]):
                continue
            old_n, size0 = 0, 0
            if carry is not None and carry["rows"]["token"][0] == new["token"][0]:
                old_n, size0 = len(carry["rows"]["token"]), carry["size"]
                rows = {c: np.concatenate([carry["rows"][c], new[c]]) for c in names}
            else:
                rows, carry = new, None
            token, count = rows["token"], len(rows["token"])
            first = np.concatenate(([True], token[1:] != token[:-1]))
            heads = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            fresh = np.arange(count) >= old_n
            rank = np.arange(count) - heads[group]
            if old_n:
                head = group == 0
                rank[head & fresh] += size0 - old_n
            sizes = np.bincount(group)
            if old_n:
                sizes[0] += size0 - old_n
            met = []  # rows of pairs, and whether the group is one that is paired in full
            # stars: a row that does not fit its pivot becomes, as the first such, the next pivot of its group
            pivot = heads[group].copy()
            if old_n and carry["pivot"] >= 0:
                pivot[head & fresh] = carry["pivot"]
            todo = np.flatnonzero(fresh & (pivot != np.arange(count)) & (rank >= SMALL))
            while len(todo):
                p = pivot[todo]
                ok = fits(rows["n"][p], rows["pos"][p], rows["n"][todo], rows["pos"][todo])
                met.append((p[ok], todo[ok], 0))
                left = todo[~ok]
                if not len(left):
                    break
                g = group[left]
                lead = np.concatenate(([True], g[1:] != g[:-1]))
                pivot[left] = left[lead][np.cumsum(lead) - 1]
                todo = left[~lead]
            # the first SMALL of a group in full; those that do not fit at this shingle may have met at an earlier one, and count there
            some = np.flatnonzero(fresh & (rank >= 1) & (rank < SMALL))
            for back in range(1, SMALL):
                i = some = some[rank[some] >= back]
                j = i - back
                low, high = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
                ok = den * low >= num * high
                met.append((j[ok], i[ok], 1))
            big = sizes[group] > SMALL
            opened = big & (fresh | ((group == 0) & (size0 <= SMALL) & (rank < SMALL)))
            x, y, full = (np.concatenate([np.empty(0, np.int64), *(np.broadcast_to(m[k], m[0].shape) for m in met)]).astype(np.int64) for k in range(3))
            first_fit = fits(rows["n"][x], rows["pos"][x], rows["n"][y], rows["pos"][y])
            swap = rows["eid"][x] > rows["eid"][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            keep = rows["eid"][x] != rows["eid"][y]
            x, y, full, first_fit = x[keep], y[keep], full[keep], first_fit[keep]
            if len(x):
                order = np.lexsort((rows["eid"][y], rows["eid"][x]))
                x, y, full, first_fit = x[order], y[order], full[order], first_fit[order]
                a, b = rows["eid"][x], rows["eid"][y]
                at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                shared, fit = np.add.reduceat(full, at), np.logical_or.reduceat(first_fit, at)
                yield {"kind": np.zeros(len(at), np.int32), "a": a[at], "b": b[at], "na": rows["n"][x[at]], "nb": rows["n"][y[at]], "shared": shared, "fit": fit}
            if m := int(opened.sum()):
                zero = np.zeros(m, np.int32)
                yield {"kind": zero + 1, "a": token[opened], "b": rows["eid"][opened], "na": rows["n"][opened], "nb": zero, "shared": zero, "fit": zero > 0}
            # what the next batch needs of the last group: its first rows and its pivot in force
            tail = np.flatnonzero(group == group[-1])
            keep_rows = tail[: SMALL]
            last_pivot = pivot[tail[-1]]
            where = np.flatnonzero(keep_rows == last_pivot)
            if not len(where):
                keep_rows = np.concatenate([keep_rows, [last_pivot]])
                where = [len(keep_rows) - 1]
            carry = {"rows": {c: rows[c][keep_rows] for c in names}, "pivot": int(where[0]), "size": int(sizes[-1])}

    return run


def _verify(num: int, den: int):
    """Rows sorted by a, salt, member: the pivot's own set first, then the members'. Yields the links."""

    def parts(s):
        return np.diff(np.searchsorted(s, np.arange(PARTS, dtype=U64) << U64(60)), append=len(s))

    def run(batches):
        a = pivot = split = None
        for batch in batches:
            out = []
            for pid, member, raw in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), column(batch, "hashes")):
                s = np.frombuffer(raw.as_buffer(), U64)
                if member is None:
                    a, pivot = pid, s.copy()
                    split = parts(pivot)
                    continue
                assert pid == a
                total = len(pivot) + len(s)
                need = -(-num * total // (num + den))
                # suffix filter: what the parts of the hash space can share at most
                if np.minimum(split, parts(s)).sum() < need:
                    continue
                at = np.searchsorted(pivot, s)
                at[at == len(pivot)] = 0
                shared = int((pivot[at] == s).sum())
                if den * shared >= num * (total - shared):
                    out.append((pid, member))
            if out:
                yield {"u": [x for x, _ in out], "v": [x for _, x in out]}

    return run


def _block_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """placed: hub, eid, comp, n. The entities of the blocks that are to be compared: hub, stray_block, block (string), stray, eid, comp, n.

    Strays are those outside their hub's largest component. A hub of up to two blocks' entities is taken whole: its blocks have no names, its
    strays are compared with all in it, and each entity comes once. In larger ones sizes are ranged by powers of den / num, so that those
    that can link are in one range or neighbouring ones; a hub's range is dealt by hash into blocks of some BLOCK entities. Pairs of blocks
    without strays do not come up.
    """
    counts = placed.groupBy("hub", "comp").count()
    main = cut(counts.groupBy("hub").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.sum("count").alias("in_hub")))  # written, so that joins split a hub of very many
    every_one = placed.join(main, "hub").withColumn("stray", F.col("comp") != F.col("main"))
    small = every_one.where(F.col("in_hub") <= 2 * BLOCK).withColumns({"stray_block": F.lit(None).cast("string"), "block": F.lit(None).cast("string")})
    ranged = every_one.where(F.col("in_hub") > 2 * BLOCK).withColumn("range", F.floor(F.log(den / num, F.col("n"))).cast("int"))
    sizes = cut(ranged.groupBy("hub", "range").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("stray") / BLOCK).cast("int").alias("stray_blocks")))
    near = sizes.withColumn("there", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)))  # these blocks are met from the ranges beside
    name = lambda at, number: F.concat_ws(":", at, number)
    deal = lambda count: F.pmod(F.xxhash64("eid"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = ranged.join(sizes, ["hub", "range"])
    there = near.select("hub", F.col("there").alias("range"), F.col("range").alias("beside"), F.col("blocks").alias("blocks_there"), F.col("stray_blocks").alias("strays_there"))
    met = own.join(there, ["hub", "range"])
    members = met.where("strays_there > 0").select("hub", F.lit(False).alias("stray"), "eid", "comp", "n", "beside", name(F.col("range"), deal(F.col("blocks"))).alias("block"), every(F.col("strays_there")).alias("k"))
    strays = met.where("stray").select("hub", F.lit(True).alias("stray"), "eid", "comp", "n", "beside", name(F.col("range"), deal(F.col("stray_blocks"))).alias("stray_block"), every(F.col("blocks_there")).alias("k"))
    columns = ("hub", "stray_block", "block", "stray", "eid", "comp", "n")
    members = members.withColumn("stray_block", name(F.col("beside"), F.col("k"))).select(*columns)
    return small.select(*columns).union(members).union(strays.withColumn("block", name(F.col("beside"), F.col("k"))).select(*columns))


def _block_links(num: int, den: int):
    """For groups (hub, block of strays, block of members): links between different components, one for each stray and component at most.
    Where the blocks have no names, strays are members too, and the sizes that can fit are taken here."""

    def run(batches):
        key, strays, members = None, [], []

        def whole():
            by_size = sorted(strays + members, key=lambda x: len(x[2]))
            some, sizes, at = sorted(strays, key=lambda x: len(x[2])), np.array([len(x[2]) for x in by_size]), 0
            own = [len(x[2]) for x in some]
            while at < len(some):
                low, to = own[at], at + 1
                while to < len(some) and den * low >= num * own[to]:
                    to += 1
                fit = np.flatnonzero((den * sizes >= num * low) & (den * own[to - 1] >= num * sizes))
                yield from links(some[at:to], [by_size[i] for i in fit])
                at = to

        def done():
            return whole() if key and key[1] is None else links(strays, members)

        def links(strays, members):
            if not strays or not members:
                return
            sizes = [np.array([len(x[2]) for x in side]) for side in (strays, members)]
            tokens = [np.concatenate([x[2] for x in side]) for side in (strays, members)]
            both = np.intersect1d(np.unique(tokens[0]), np.unique(tokens[1]), assume_unique=True)
            shared = np.zeros((len(strays), len(members)), np.float32)
            owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
            place = [np.searchsorted(both, t) for t in tokens]
            hit = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == t) if len(both) else np.zeros(len(t), bool) for p, t in zip(place, tokens)]
            for c in range(0, len(both), 4096):  # exact: counts stay far below 2**24
                m = []
                for k, side in enumerate((strays, members)):
                    x = np.zeros((len(side), min(4096, len(both) - c)), np.float32)
                    sel = hit[k] & (place[k] >= c) & (place[k] < c + 4096)
                    x[owner[k][sel], place[k][sel] - c] = 1
                    m.append(x)
                shared += m[0] @ m[1].T
            shared = shared.astype(np.int64)
            union = sizes[0][:, None] + sizes[1][None, :] - shared
            comp = [np.array([x[1] for x in side]) for side in (strays, members)]
            i, j = np.nonzero((den * shared >= num * union) & (comp[0][:, None] != comp[1][None, :]))
            if len(i):
                _, first = np.unique(np.stack([i, comp[1][j]], 1), axis=0, return_index=True)
                eids = [np.array([x[0] for x in side]) for side in (strays, members)]
                yield {"u": eids[0][i[first]], "v": eids[1][j[first]]}

        for batch in batches:
            rows = zip(*(column(batch, c).to_pylist() for c in ("hub", "stray_block", "block", "stray", "eid", "comp")), column(batch, "hashes"))
            for hub, theirs, mine, stray, eid, comp, raw in rows:
                if key != (hub, theirs, mine):
                    yield from done()
                    key, strays, members = (hub, theirs, mine), [], []
                (strays if stray else members).append((eid, comp, np.frombuffer(raw.as_buffer(), U64).copy()))
        yield from done()

    return run


def _maybe_in(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of docs whose doc_id is among the n of ids, and few others: by a bitmap of hashes, so that no other text need travel."""
    size = min(MOST_BITS, 1 << max(16, (SIEVE * n - 1).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1  # from 1, as buckets of bitmaps begin there
    parts = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in zip(parts["bucket"].to_pylist(), parts["bits"].to_pylist()):
        bits[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def passes(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.int64) - 1
        return pa.array(held.value[at >> 3] >> (at & 7) & 1 > 0)

    return docs.where(passes(place))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs: doc_id long, text string, any other columns.  Returns doc_id, n_shingles, component_id (long), a row for each row.

    Sets of `words`-word shingles link when den * intersection >= num * union.  component_id is the least doc_id reachable.
    Null and wordless texts have no shingles and stand alone; rows that repeat a doc_id are texts of their own; rows with a null
    doc_id keep a null component and link nothing.  An empty table gives an empty result.  Equality of shingles is that of their
    64-bit hashes.
    """
    return _labelled(keep_columns(docs, "doc_id", "text").withColumn("h", F.lit(0).cast("long")), words, num, den).drop("h", "root")


def keep_one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, by_text: bool = False) -> DataFrame:
    """The rows of docs, with all columns, without near duplicates: of each component the document with the least doc_id stays, once.
    Wordless texts and rows without doc_id are in no component and stay.

    Where one doc_id carries several texts, each the least of a component of its own, one of them stays; by_text keeps each of them.
    """
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("h", F.xxhash64("text"))
    found = _labelled(rows.select("doc_id", "text", "h"), words, num, den)
    chosen = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id", *["root"] * by_text).agg(F.min("h").alias("h"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = rows.where(~alone).join(chosen, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return one.select("row").union(rows.where(alone).select("row")).select("row.*")


def _labelled(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """docs: doc_id, text, h (handed through). Returns doc_id, n_shingles, component_id, h, root (the component, also where ids repeat)."""
    spark, n = docs.sparkSession, width(docs.sparkSession)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words))
    sets = arrow_map(docs, _sets(words, num, den, frequent), "doc_id long, n int, light int, key binary, prefix array<long>")
    whole = sets.where("key is not null and doc_id is not null")
    entities = cut(whole.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("light").alias("light"), F.any_value("prefix").alias("prefix")))
    drop_shuffles(spark)  # cut() asks too, but while its own plan is still held
    entities = entities.withColumn("eid", F.monotonically_increasing_id())
    rows = entities.select("eid", "n", "light", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.repartition(n, "token").sortWithinPartitions("token", "light", "n", "eid")
    met = cut(arrow_map(rows, _pair_up(num, den), "kind int, a long, b long, na int, nb int, shared int, fit boolean"))
    del rows
    drop_shuffles(spark)
    opened = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("eid"), F.col("na").alias("n"))
    # the positional filter at the end of the prefixes: what they share, counted, and all that stands behind the shorter of them
    hidden = opened.groupBy("eid").count()
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("fit").alias("fit")).where("fit")
    for side in ("a", "b"):
        pairs = pairs.join(hidden.select(F.col("eid").alias(side), F.col("count").alias(f"open_{side}")), side, "left")
    behind = lambda n: F.ceil(F.col(n) * num / den) - 1  # noqa: E731  n less the length of its prefix
    possible = F.col("shared") + F.least(F.coalesce("open_a", F.lit(0)), F.coalesce("open_b", F.lit(0))) + F.greatest(behind("na"), behind("nb"))
    pairs = cut(pairs.where(possible >= F.ceil((F.col("na") + F.col("nb")) * num / (num + den))).select("a", "b"))

    def whole_sets(eids: DataFrame) -> DataFrame:
        """eid, hashes: the whole sets of some entities, each once and dealt by entity."""
        wanted, texts = cut(eids.join(entities.select("eid", "doc_id", "key"), "eid")), docs
        if (n_wanted := wanted.count()) <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        else:
            texts = _maybe_in(docs, wanted, n_wanted)

        def hashes(batches):
            for batch in sliced(batches):
                keys, eids = column(batch, "key").to_pylist(), column(batch, "eid").to_pylist()
                s = shingle_sets(_texts(batch), words)
                mine = [i for i, x in enumerate(s) if blake2b(x.tobytes(), digest_size=16).digest() == keys[i]]
                yield {"eid": [eids[i] for i in mine], "hashes": [s[i].tobytes() for i in mine]}

        found = arrow_map(texts.join(wanted, "doc_id"), hashes, "eid long, hashes binary")
        return found.repartition(n, "eid").groupBy("eid").agg(F.any_value("hashes").alias("hashes"))

    full = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("eid")).distinct())

    # each pair once; a pivot's members are dealt in portions, as there may be very many
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    salted = pairs.join(portions, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("portions")))
    sides = salted.join(full.withColumnRenamed("eid", "b"), "b").select("a", "salt", "b", "hashes")
    pivots = portions.join(full.withColumnRenamed("eid", "a"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
    pivots = pivots.select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")
    sides = sides.union(pivots).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = cut(arrow_map(sides, _verify(num, den), "u long, v long"))
    del full, sides, pivots, salted, portions, pairs
    drop_shuffles(spark)
    labels = components(links)

    # groups that still hold several components
    labelled = opened.join(labels.withColumnRenamed("id", "eid"), "eid", "left").withColumn("comp", F.coalesce("root", "eid"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("eid").alias("hub")).where("low < high")
    placed = cut(labelled.join(mixed.select("token", "hub"), "token").select("hub", "eid", "comp", "n").distinct())
    if not placed.isEmpty():
        blocks, full = _block_pairs(placed, num, den), whole_sets(placed.select("eid").distinct())
        total = lambda df: 8 * (df.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)
        rounds = -(-total(blocks) // max(ROUND_BYTES, int(ROUND_SHARE * total(entities))))
        full = cut(full) if rounds > 1 else full
        turn = F.pmod(F.xxhash64("hub", "stray_block", "block"), F.lit(rounds))
        for k in range(rounds):
            drop_shuffles(spark)
            work = blocks.where(turn == k).join(full, "eid").repartition(n, "hub", "stray_block", "block").sortWithinPartitions("hub", "stray_block", "block")
            more = cut(arrow_map(work, _block_links(num, den), "u long, v long"))
            links = links.union(more)
            del work
        labels = components(links)

    # the least document of a component, for every set's key
    named = entities.select("eid", "key", "doc_id").join(labels.withColumnRenamed("id", "eid"), "eid", "left").withColumn("root", F.coalesce("root", "eid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id", "root")
    plain = arrow_map(docs, _keys(words), "doc_id long, n_shingles long, key binary, h long")
    return plain.join(named, "key", "left").select("doc_id", "n_shingles", "h", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _keys(words: int):
    def run(batches):
        for batch in sliced(batches):
            s = shingle_sets(_texts(batch), words)
            yield {"doc_id": column(batch, "doc_id"), "h": column(batch, "h"), "n_shingles": [len(x) for x in s], "key": [blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in s]}

    return run
