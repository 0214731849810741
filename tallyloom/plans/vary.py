"""Variations of tagged texts that keep tags and tokens together, and a shuffle that any partitioning repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand in the place of the colon before an entity, by its type; a variant's id is so much higher.
PHRASES = {
    "ORIGIN": ("muat di", "dari", "posisi", "ambil di", "loading di"),
    "DESTINATION": ("kirim ke", "tujuan", "arah", "drop di", "bongkar di"),
    "DRIVER": ("driver", "sopir", "sama pak", "drivernya", "supir"),
    "TIME": ("jam", "pukul", "loading jam", "muat jam"),
    "DATE": ("tgl", "tanggal", "hari", "untuk tanggal"),
}
ID_STEP = 9000
#: Ranges of the hash in which a shuffle counts its rows: four hexadecimal digits.
RANGES_DIGITS = 4


def _draw(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def _pieces(token: Column, tag: Column, after: Column, at: Column, draw: Column) -> Column:
    """What becomes of one token: itself, or the words of a phrase; each piece knows the place that its token had."""
    kept = F.array(F.struct(token.alias("token"), tag.alias("tag"), at.alias("from_place")))
    kind = F.element_at(F.split(after, "-"), 2)
    words, known = None, None
    for name, phrases in PHRASES.items():
        said = F.element_at(F.array(*map(F.lit, phrases)), (F.floor(draw / 2) % len(phrases) + 1).cast("int"))
        words = F.when(kind == name, said) if words is None else words.when(kind == name, said)
        known = (kind == name) if known is None else known | (kind == name)
    spoken = F.transform(F.split(words, " "), lambda w: F.struct(w.alias("token"), F.lit("O").alias("tag"), at.alias("from_place")))
    replaced = (token == ":") & F.coalesce(after.startswith("B-") & known, F.lit(False)) & (draw % 2 == 1)
    return F.when(replaced, spoken).otherwise(kept)


def varied(rows: DataFrame, variants: int = 2, seed: int = 42, key: str = "id", tokens: str = "tokens", tags: str = "ner_tags", text: str = "original_text") -> DataFrame:
    """rows with variant 0, and of each row so many variants, numbered from 1: the colon before an entity of a known type gives way, in half
    of the places, to a phrase whose words are tagged O. Returns key (a variant's is ID_STEP higher), variant, tokens, tags, text (a variant's
    tokens in a row) and from_places: for each token the place that it, or the colon, had, so that whatever names places can follow.

    Every choice depends on seed, key, variant and place alone. Arrays of unlike length are cut to the shorter one; null arrays are empty;
    rows that repeat a key vary alike.
    """
    n = F.least(F.coalesce(F.size(tokens), F.lit(0)), F.coalesce(F.size(tags), F.lit(0)))
    cut = {c: F.when(n > 0, F.slice(F.col(c), F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>")) for c in (tokens, tags)}
    base = rows.select(F.col(key), *(v.alias(c) for c, v in cut.items()), F.col(text)).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants))))

    def piece(x: Column, i: Column) -> Column:
        draw = _draw(F.lit(seed), F.col(key), F.col("variant"), i)
        after = F.try_element_at(F.col(tags), i + 2)
        return F.when(F.col("variant") > 0, _pieces(x["token"], x["tag"], after, i, draw)).otherwise(F.array(F.struct(x["token"].alias("token"), x["tag"].alias("tag"), i.alias("from_place"))))

    zipped = F.zip_with(tokens, tags, lambda t, g: F.struct(t.alias("token"), g.alias("tag")))
    made = base.withColumn("_p", F.flatten(F.transform(zipped, piece)))
    field = lambda name: F.transform("_p", lambda p: p[name])
    out = made.select(F.when(F.col("variant") > 0, F.col(key) + ID_STEP).otherwise(F.col(key)).alias(key), "variant", field("token").alias(tokens), field("tag").alias(tags), F.col(text), field("from_place").alias("from_places"))
    return out.withColumn(text, F.when(F.col("variant") > 0, F.array_join(tokens, " ")).otherwise(F.col(text)))


def shuffled(rows: DataFrame, by: list[str], seed: int = 42, place: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in an order that depends on the seed and the values of by alone; rows that agree in by follow each
    other in some order. No sort of the whole: rows are counted in ranges of the hash, whose counts are summed (at most 16 ** RANGES_DIGITS of
    them), and are numbered within their range. Write it with partitions by ranges of place, or sort by it what fits."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)))).withColumn("_r", F.substring("_h", 1, RANGES_DIGITS))
    counts = hashed.groupBy("_r").agg(F.count("*").alias("_n"))
    before = counts.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *by))
    return hashed.withColumn("_k", nth).join(F.broadcast(before), "_r").withColumn(place, F.col("_before") + F.col("_k")).drop("_h", "_r", "_k", "_before")
