"""One query per operator, with the parameters that production uses, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import exact_dedup, lattice, line_dedup, mixing, quality, run_index, secret_scan, simhash, token_counts, url_filter
from meshlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: What the mix asks for: weights of the sorted sources, share of all words, repetitions at most.
MIX = {"cycle": [5, 2, 1], "share": 1.5, "max_epochs": 2.0, "seed": 17}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM sources),
level AS (
  SELECT * FROM ranked WHERE weight * room / rest_weight <= cap ORDER BY place LIMIT 1),
filled AS (
  SELECT r.source, r.source_size,
         CASE WHEN l.place IS NULL OR r.place < l.place THEN r.cap ELSE r.weight * l.room / l.rest_weight END AS target
  FROM ranked r LEFT JOIN level l ON TRUE),
parts AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM filled),
ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND (through <= rest OR through - rest < rest - (through - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
best AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""

#: The rules (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH parts AS (
  SELECT page_id, row_number() OVER () AS row_no, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
keys AS (
  SELECT page_id, row_no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(r_host, r_path, r_verdict) AS (VALUES %s),
fits AS (
  SELECT k.row_no, r.*, row_number() OVER (PARTITION BY k.row_no ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS place
  FROM keys k JOIN rules r ON (k.host = r.r_host OR ends_with(k.host, '.' || r.r_host)) AND starts_with(k.path, r.r_path))
SELECT k.page_id, k.host, k.path, f.r_host || f.r_path AS rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM keys k LEFT JOIN fits f ON f.row_no = k.row_no AND f.place = 1
""" % ", ".join(map(str, URL_RULES))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"), distance=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Segmentations of a text that are kept.
N_BEST = 3


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes the library's pieces again; round_trip says whether that gave the text."""
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(plain, 256).alias("sha"))
    encoded = lattice.encode_documents(docs, ["doc_id", "sha"], n_best=N_BEST, decoded="decoded")
    named = encoded.withColumns({"n_lattice": F.size("lattice_ids").cast("long"), "ids_hash": F.xxhash64("ids"), "lattice_hash": F.xxhash64("lattice_ids")})
    following = [F.get("next_ids", k) for k in range(N_BEST - 1)]
    sizes = F.array_compact(F.array(*[F.size(x).cast("long") for x in following]))
    hashes = F.array_compact(F.array(*[F.when(x.isNotNull(), F.xxhash64(x)) for x in following]))
    keep = ["doc_id", "n_pieces", "n_lattice", "scores", "ids_hash", "lattice_hash", sizes.alias("next_sizes"), hashes.alias("next_hashes")]
    return named.select(*keep, F.element_at("scores", 1).alias("score"), (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


#: A line on this many distinct sources is boilerplate.
MIN_SITES = 15


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return changed.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM lines),
spread AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE has_word GROUP BY key HAVING count(DISTINCT coalesce('=' || source, '')) >= %d),
judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first_id AS gone FROM keyed k LEFT JOIN spread s ON k.has_word AND k.key = s.key)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM judged GROUP BY doc_id
""" % MIN_SITES

def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_index.repeated_passages(table(spark, sf_dir, "documents"), least=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Query] = {"op1_mixing": op1_mixing, "op10_line_dedup": op10_line_dedup, "op2_simhash": op2_simhash, "op3_exact_dedup": op3_exact_dedup, "op4_sentencepiece": op4_sentencepiece, "op5_quality": op5_quality, "op6_token_counts": op6_token_counts, "op7_secrets": op7_secrets, "op8_url_filter": op8_url_filter, "op9_repeats": op9_repeats}
ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op10_line_dedup": OP10_SQL, "op3_exact_dedup": OP3_SQL, "op8_url_filter": OP8_SQL}
