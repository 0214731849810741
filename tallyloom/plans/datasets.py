"""Datasets for the models: pairs, negatives, label alignment, augmentation. Picks are by hash, so every run picks alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import ROW_FIELDS
from ..functions.text import filled, strip, unstutter


def signature_key(fields: tuple[str, ...] = ROW_FIELDS) -> Column:
    return F.concat_ws("|", *(F.upper(strip(F.col(c))) for c in fields))


def candidate_text() -> Column:
    """A record as labelled lines."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("-"))) for label, c in _LINES))


_LINES = (("Tanggal request", "tgl_ro"), ("Tanggal muat", "tgl_muat"), ("Lokasi", "pickup"), ("Rute/tujuan", "tujuan"), ("Unit", "type_truck"), ("Driver", "driver"), ("Nopol", "no_plat"), ("No hp", "kontak_driver"))


def revision_text() -> Column:
    """A follow-up that names what the record has."""
    return F.concat_ws("\n", F.lit("REVISI"), *(F.when(filled(F.col(c)), F.concat(F.lit(f"{label} : "), strip(F.col(c)))) for label, c in _LINES))


#: Ranges of the hash that a ring of records is cut into.
RING = 1 << 12


def _ring(records: DataFrame, by: list[str], sig: str, record: str, negative: str = "negative_id", salt: int | None = None) -> DataFrame:
    """by, sig and negative: of each signature the record of the next one of its group, in the order of a hash; the last one meets the
    first. A group is not one window: it is cut into RING ranges of the hash, and the last signature of a range takes the first one of the
    next range that has any, which is looked for among a group's at most RING ranges."""
    h = F.xxhash64(sig) if salt is None else F.xxhash64(sig, F.lit(salt))
    one = records.groupBy(*by, sig).agg(F.min(record).alias("_r")).withColumn("_h", h).withColumn("_b", F.shiftright("_h", 52))
    firsts = one.groupBy(*by, "_b").agg(F.min(F.struct("_h", sig, "_r")).alias("_f"))
    w = Window.partitionBy(*by).orderBy("_b")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(*by, "_b", F.coalesce(F.lead("_f").over(w), F.first("_f").over(whole))["_r"].alias("_next"))
    within = F.lead("_r").over(Window.partitionBy(*by, "_b").orderBy("_h", sig))
    met = one.withColumn("_w", within).join(after.hint("merge"), [*by, "_b"]).withColumn(negative, F.coalesce("_w", "_next"))
    return met.where(F.col(negative) != F.col("_r")).select(*by, sig, negative)


def hard_negatives(records: DataFrame, route: str, sig: str, record: str = "record_id") -> DataFrame:
    """Of each record another record of its route with another signature: the next one in the order of a hash, in a ring, without pairs; a
    route with one signature gives none."""
    return records.join(_ring(records, [route], sig, record), [route, sig])


def random_negatives(records: DataFrame, sig: str, record: str = "record_id") -> DataFrame:
    """As hard_negatives(), in one ring of all records, whatever their number: each gets one, if there is a second signature at all."""
    all_ = records.withColumn("_all", F.lit(0))
    return records.join(_ring(all_, ["_all"], sig, record, salt=7).drop("_all"), sig)


def pair_dataset(records: DataFrame, route: str = "route_key", sig: str = "signature") -> DataFrame:
    """Positives (a record's text and its follow-up, and its record), hard and random negatives; blank sides are left out. Each record goes
    to its two negatives at once, and no table to the driver: whatever is small grows with the records."""
    r = records.withColumn("text_a", candidate_text()).withColumn("text_b", revision_text())
    pair = lambda kind, a, b, label: F.struct(F.lit(kind).alias("pair_kind"), F.col(a).alias("text_a"), F.col(b).alias("text_b"), F.lit(label).alias("label"))
    positives = r.select("record_id", F.inline(F.array(pair("revision", "text_a", "text_b", "MATCH"), pair("original", "original_text", "text_a", "MATCH"))))
    hard = _ring(records, [route], sig, "record_id", "_hard")
    rand = _ring(records.withColumn("_all", F.lit(0)), ["_all"], sig, "record_id", "_random", salt=7).drop("_all")
    met = r.select("record_id", route, sig, "text_b").join(hard.hint("merge"), [route, sig], "left").join(rand.hint("merge"), sig, "left")
    to = F.array(*(F.struct(F.lit(k).alias("pair_kind"), F.col(f"_{k}").alias("negative_id")) for k in ("hard", "random")))
    texts = r.select(F.col("record_id").alias("negative_id"), F.col("text_a").alias("_other"))
    negatives = met.select("record_id", "text_b", F.inline(to)).where("negative_id is not null").join(texts.hint("merge"), "negative_id")
    out = positives.unionByName(negatives.select("record_id", "pair_kind", F.col("text_b").alias("text_a"), F.col("_other").alias("text_b"), F.lit("NO_MATCH").alias("label")))
    named = F.concat_ws("-", "pair_kind", F.col("record_id").cast("string")).alias("pair_id")
    return out.where(filled(F.col("text_a")) & filled(F.col("text_b"))).select(named, "text_a", "text_b", "label", "pair_kind", F.col("record_id").alias("source_id"))


def zip_halves(rows: DataFrame, batch: str, seq: str, text: str) -> DataFrame:
    """The first half of a batch's rows beside the second, by place."""
    w = Window.partitionBy(batch)
    n = rows.withColumn("_k", F.row_number().over(w.orderBy(seq))).withColumn("_half", F.floor(F.count("*").over(w) / 2))
    a = n.where("_k <= _half").select(batch, "_k", F.col(text).alias("text_a"))
    b = n.where("_k > _half and _k <= 2 * _half").select(batch, (F.col("_k") - F.col("_half")).alias("_k"), F.col(text).alias("text_b"))
    return a.join(b, [batch, "_k"]).withColumnRenamed("_k", "place")


def clean_tags(rows: DataFrame, tokens: str = "tokens", tags: str = "ner_tags") -> DataFrame:
    """Long 08 numbers are cut to 12 digits and tagged as phones, 08 numbers are no dates, stuttered tokens lose a half."""
    zipped = F.arrays_zip(F.col(tokens).alias("t"), F.col(tags).alias("g"))

    def fix(x: Column) -> Column:
        phone = x["t"].rlike(r"^08\d+$")
        long_ = phone & (F.length(x["t"]) > 13)
        tag = F.when(long_ | (phone & x["g"].contains("DATE")), F.concat(F.when(x["g"].startswith("I-"), "I-").otherwise("B-"), F.lit("PHONE"))).otherwise(x["g"])
        return F.struct(F.when(long_, F.substring(x["t"], 1, 12)).otherwise(unstutter(x["t"])).alias("t"), tag.alias("g"))

    fixed = rows.withColumn("_z", F.transform(zipped, fix))
    return fixed.withColumns({tokens: F.transform("_z", lambda x: x["t"]), tags: F.transform("_z", lambda x: x["g"])}).drop("_z")


def label_vocabulary(rows: DataFrame, tags: str = "ner_tags") -> DataFrame:
    """The tags, O first, then by name, numbered from 0."""
    names = rows.select(F.explode(tags).alias("tag")).distinct()
    return names.withColumn("id", F.row_number().over(Window.orderBy(F.desc(F.col("tag") == "O"), "tag")) - 1)  # some dozen rows


def pick(seed: Column, *values: str) -> Column:
    """One of the values, by the seed's hash."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(seed), F.lit(len(values))) + 1).cast("int"))


#: Fixed value: parts in which templates are numbered side by side.
BUCKETS = 1024


def augmented(templates: DataFrame, n: int, text: str = "text") -> DataFrame:
    """n rows: a template each, by hash, its dates, clock times, plates and phones replaced by others that depend on the row alone. The
    templates may be many: they are numbered within BUCKETS of a hash, each after the sum of those before, and meet the rows by number."""
    dealt = templates.withColumn("_b", F.pmod(F.xxhash64("template_id"), F.lit(BUCKETS)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # BUCKETS rows at most
    place = F.row_number().over(Window.partitionBy("_b").orderBy("template_id", text)) - 1
    known = dealt.withColumn("_place", place).join(F.broadcast(sizes), "_b").withColumn("_k", F.col("_before") + F.col("_place"))
    size = F.broadcast(templates.agg(F.count("*").alias("_size")))
    rows = templates.sparkSession.range(n).crossJoin(size).withColumn("_k", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_size")))
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    date = F.format_string("%02d/%02d/%04d", h(2, 28) + 1, h(3, 12) + 1, h(4, 3) + 2024)
    clock = F.format_string("%02d:%02d", h(5, 24), h(6, 60))
    plate = F.concat(pick(F.concat(F.col("id"), F.lit("p")), "B", "D", "F", "L"), F.lit(" "), (h(7, 9000) + 1000).cast("string"), F.lit(" "), pick(F.concat(F.col("id"), F.lit("q")), "AB", "KQ", "UXS", "TEY"))
    phone = F.concat(F.lit("08"), F.lpad(h(8, 10**10).cast("string"), 10, "1"))
    out = F.col(text)
    for pattern, new in ((r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", date), (r"\b\d{1,2}[:.]\d{2}\b", clock), (r"\b[A-Z]{1,2}\s?\d{3,4}\s?[A-Z]{1,3}\b", plate), (r"\b08\d{8,11}\b", phone)):
        out = F.regexp_replace(out, F.lit(pattern), new)
    return rows.join(known, "_k").select(F.format_string("aug_spc_%05d", F.col("id") + 1).alias("pair_id"), "template_id", out.alias(text))


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows of the least seeded hash: a sampling operator whose rows do not depend on partitions."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def label_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
