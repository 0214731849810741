"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses
from .bpe import encode_corpus
from .jaccard import jaccard_components
from .mixing import mix
from .phrases import collocations
from .quality import score_quality
from .ranking import rank_sale_lines
from .search import exact_top_k
from .sketch import compare_versions
from .suffix import remove_repeats
from .tokenfile import token_roundtrip
from .toxicity import score_toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Shares of the mixture's tokens by domain; what is good keeps its own tokens.
MIXTURE = {"good": 0.95, "poor": 0.05}


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixture's domains."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), MIXTURE, "good")
    return mixed.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(MIXTURE))), "rate", "copies")


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    return chat.chat_digests(turns.union(spark.sql("VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in planted))))


ORACLES["op7_chat_formatting"] = chat.ORACLE


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


ORACLES["op10_license_scan"] = licenses.oracle()

@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# brute force in SQL: all runs of one to four words
ORACLES["op12_phrase_collocations"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, p, len(p) AS size, count(*) AS f FROM (SELECT lang, w[i : i + k - 1] AS p FROM runs) GROUP BY 1, 2 HAVING count(*) >= 30),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 :]
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nr FROM scored),
longer AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, unnest([p[2 :], p[: size - 1], p[3 :], p[: size - 2], p[2 : size - 1]]) AS q FROM f WHERE size > 2) GROUP BY 1, 2),
kept AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.q = b.p WHERE nr = 1 AND (o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(a AS HUGEINT))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_grouped_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_sale_lines(table(spark, sf_dir, "sale_lines"))


# crc32 bit by bit over the digits of sale_id
ORACLES["op13_grouped_ranking_ties"] = """
WITH t AS (
  SELECT *, CASE WHEN sale_id IS NULL THEN FALSE ELSE xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)],
    flatten(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: [CAST(1000 + ascii(x) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 1000) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END), CAST(4294967295 AS UBIGINT)) % 5 = 0 END AS one FROM sale_lines
), k AS (
  SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CAST(CASE WHEN one THEN -1 ELSE coalesce(item_id % 10, -1) END AS BIGINT) AS part,
    CAST(CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month,
    CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity,
    CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents FROM t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST) AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM k
)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE place <= 3
"""

ORACLES["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# brute force in SQL: all pairs that share a shingle, and the closure of their links
ORACLES["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (
  SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id WHERE r.low < e.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(low) AS low FROM r GROUP BY 1) m ON m.id = d.doc_id
"""

# brute force in SQL: every string of 400 bytes, in hexadecimal digits
ORACLES["op8_suffix_array_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), g AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM t),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM g WHERE n >= 400)),
twice AS (SELECT k FROM starts GROUP BY 1 HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM starts JOIN twice USING (k)),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM marked), runs AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY 1, 2),
ends AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS h, sum(b - a) AS gone, count(*) AS spans FROM ends JOIN g USING (doc_id) JOIN (SELECT doc_id, max(b) AS last FROM runs GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT g.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, g.h))) AS kept_sha256 FROM g LEFT JOIN kept USING (doc_id)
"""
