"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, pii, quality_classifier, quality_rules, substring_dedup
from docframe.llm.common import table


def sites_of(pages: DataFrame) -> DataFrame:
    """(id, host, path, markup) for each id that ends a page's address: of several pages the smallest page_id counts."""
    address = F.col("url")
    host = F.regexp_extract(address, r"^\w+://([^/?#]*)", 1)
    path = F.concat(F.lit("/"), F.regexp_extract(address, r"^\w+://[^/?#]*/([^/?#]*)/", 1))
    key = F.regexp_extract(address, r"/(\d{1,18})(?:\.html?|/)?(?:[?#].*)?$", 1)
    markup = F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    known = pages.select(F.when(key != "", key.cast("long")).alias("id"), "page_id", host.alias("host"), path.alias("path"), F.when(markup != "", markup).alias("markup")).where("id is not null")
    return known.groupBy("id").agg(F.min_by(F.struct("host", "path", "markup"), "page_id").alias("site")).select("id", "site.*")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label"))
    return quality_classifier.judge(table(spark, sf_dir, "documents"), labels, sites_of(table(spark, sf_dir, "pages")))


def domain_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), mixing.domain_of(F.col("quality"), F.col("toxic")).alias("label"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = exact_dedup.exact_groups(docs.select("doc_id", "text"), keep="largest")
    return slim.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), sites_of(table(spark, sf_dir, "pages")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packing.pack(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts),
run AS (
  SELECT doc_id, i, lead(w, 4) OVER own AS fifth, concat_ws(' ', w, lead(w, 1) OVER own, lead(w, 2) OVER own, lead(w, 3) OVER own, lead(w, 4) OVER own) AS s
  FROM word WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
shingle AS (SELECT DISTINCT doc_id, s FROM run WHERE fifth IS NOT NULL OR i = 1),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingle USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * n_both >= 75 * (m.n + n.n - n_both)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_extraction": op10_html_extraction,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op9_jaccard_join": OP9_SQL}
