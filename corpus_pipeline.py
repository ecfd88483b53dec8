"""A corpus pipeline: language ID, exact dedup, near-duplicate join, mixing and packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docframe.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from docframe.llm.common import table, written
from docframe.llm.queries import digest, domain_labels, sites_of

#: SQL can't express the language model, the classes of near copies or the packing; tests hold run() against plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, of no clear language or unlike their language go. Rows of
    one id, and those of null id, stay if one of them does. No rows give no rows; other columns pass through."""
    found = language_id.identify(docs, sites_of(table(spark, sf_dir, "pages")))
    kept = found.where("kept").select(found["doc_id"].alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; null text counts as empty, and a null id stays where there is no other."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts; texts without words are linked with nothing, and rows of null id stay."""
    return jaccard_join.one_of_each(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that give the domains their target shares, with room to keep the good ones whole;
    rows of null id share one draw."""
    return mixing.mixed(docs, domain_labels(table(spark, sf_dir, "labels")), mix=mixing.Mix(stretch=1.1))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; null text is the end id alone, and null ids are carried along."""
    return digest(packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each earlier stage keeps is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
