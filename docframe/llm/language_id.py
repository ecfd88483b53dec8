"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_rows, smallest_hashes, text_of, written
from docframe.llm.shingles import blocks


@dataclass(frozen=True)
class Evidence:
    """most_rows: the text model is fitted on at most so many documents of each language, those with the smallest hash
    of the id; a language needs least_rows. grams: hashed byte 3-grams. most_grams: how many grams' worth a whole text's
    mean log-likelihood may count for. least_letters: a text with fewer letters has no language. A text whose best
    posterior is under least_posterior, or whose mean log-likelihood is least_fit below that of the best language's own
    documents, is rejected. host_weight, suffix_weight: of the level above, in documents."""

    most_rows: int = 1_000
    least_rows: int = 5
    most_languages: int = 200
    grams: int = 1 << 14
    most_grams: int = 60
    least_letters: int = 3
    least_posterior: float = 0.5
    least_fit: float = 4.0
    host_weight: float = 20.0
    suffix_weight: float = 200.0
    batch_rows: int = 1024


def _lowered() -> np.ndarray:
    """Bytes with A-Z lowered, and one sign for all ASCII that isn't a letter."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    low = np.arange(97, 123)
    table[low], table[low - 32] = low, low
    return table


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The hashed 3-gram that begins at each byte but the last two; -1 where it has no letter in the middle."""
    x = _lowered()[data]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    code = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    found = (code >> np.uint32(15)).astype(np.int64) % size
    found[x[1:-1] == 32] = -1
    return found


def _counts(evidence: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            total: dict[str, np.ndarray] = {}
            for at, data, bounds in blocks(batch.column(1)):
                found = _grams(data, evidence.grams)
                for i in range(len(bounds) - 1):
                    own = found[bounds[i] : max(bounds[i], bounds[i + 1] - 2)]
                    own = own[own >= 0]
                    if len(own):  # each document counts alike
                        add = np.bincount(own, minlength=evidence.grams) / len(own)
                        total[langs[at + i]] = total.get(langs[at + i], 0) + add
            for lang, sums in total.items():
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some])], ["lang", "gram", "n"])

    return run


def _likelihoods(evidence: Evidence, model):
    """n_grams and, for each language, the mean log-likelihood of a whole text's grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            mean = np.zeros((batch.num_rows, logs.shape[1]), np.float64)
            for at, data, bounds in blocks(batch.column(1)):
                found = _grams(data, evidence.grams)
                total = np.zeros((len(found) + 1, logs.shape[1]))
                np.cumsum(logs[found], axis=0, out=total[1:])  # -1 takes the last row, of zeros
                some = np.concatenate([[0], np.cumsum(found >= 0)])
                first = np.minimum(bounds[:-1], len(found))
                last = np.minimum(np.maximum(first, bounds[1:] - 2), len(found))
                k = len(first)
                n[at : at + k] = some[last] - some[first]
                mean[at : at + k] = (total[last] - total[first]) / np.maximum(1, n[at : at + k])[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(n), pa.array(list(mean), pa.list_(pa.float64()))], ["id", *batch.schema.names[2:], "n_grams", "mean"]
            )

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(name: str, n: int, prefix: str) -> list[Column]:
    return [F.sum(F.col(name)[k]).alias(f"{prefix}{k}") for k in range(n)]


def identify(docs: DataFrame, sites: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", evidence: Evidence = Evidence()) -> DataFrame:
    """sites: (id, host, markup), one row for an id. One row per row of docs: id_col, language, posterior, declared,
    text_language, n_grams, kept. A document without a site is declared by its own row, and its source is its host.

    The text model (smoothed byte 3-grams) is fitted on declared documents. Its posteriors, summed by groups, give the
    rest: how often each language declares what (smoothed towards what it should declare), the languages of an address
    suffix, shrunk towards the mean, and of a host, shrunk towards its suffix; a document is left out of its own host.
    The posterior's logs are the sum of the mean log-likelihood times the number of grams (most_grams at most), of the
    declaration's log-likelihood and of the host's prior.

    Defined results: null and empty texts, and those of fewer than least_letters letters, have a null language,
    posterior 0 and are not kept; a null declaration, source or host is a value of its own; without enough declared
    documents of any language, language is null and every text with letters is kept; repeated rows have a result each;
    no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    value = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), value(lang_col).alias("lang"), value(source_col).alias("source"))
    known = written(sites.select(F.col("id").cast("long").alias("id_s"), F.lower("host").alias("host_s"), F.lower("markup").alias("markup_s")).where("id_s is not null"))

    def placed(rows: DataFrame) -> DataFrame:
        """rows with their site; texts stay where they are."""
        host = F.coalesce("host_s", "source")
        suffix = F.when(host.contains("."), F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1)).otherwise(F.lit(""))
        joined = rows.join(known, rows["id"] == known["id_s"], "left")
        return joined.withColumns({"declared": F.coalesce("markup_s", "lang"), "host": host, "suffix": suffix}).drop("id_s", "host_s", "markup_s", "lang", "source")

    declared = written(placed(texts.where("text <> ''").select("id", "lang", "source")).where("declared <> ''").select("id", "declared"))
    rows_of = declared.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= evidence.least_rows)
    langs = sorted(r["declared"] for r in rows_of.orderBy(F.desc("n"), "declared").limit(evidence.most_languages).collect())
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long")
    if not langs:
        return placed(texts).select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), "declared", F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_grams"), (letters >= evidence.least_letters).alias("kept"))
    # at most most_rows ids of each of at most most_languages languages
    each = [smallest_hashes(declared.where(F.col("declared") == lang), "id", evidence.most_rows) for lang in langs]
    chosen = each[0]
    for more in each[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.groupBy(F.col("id").alias("id_c")).agg(F.min("declared").alias("declared"))
    sample = texts.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("id_c"))).select("declared", "text")
    counted = sample.mapInArrow(_counts(evidence), "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    logs = np.full((evidence.grams + 1, len(langs)), 0.5 / evidence.grams)
    for r in counted:
        logs[r["gram"], langs.index(r["lang"])] += r["n"]
    logs = np.log(logs / logs.sum(axis=0))
    logs[-1] = 0
    model = spark.sparkContext.broadcast(logs)

    scored = texts.select("id", "text", "lang", "source", letters.alias("letters")).mapInArrow(
        _likelihoods(evidence, model), "id long, lang string, source string, letters long, n_grams long, mean array<double>"
    )
    scored = placed(scored)
    weight = F.least(F.col("n_grams"), F.lit(evidence.most_grams))
    with arrow_rows(spark, evidence.batch_rows):
        scored = written(scored.withColumn("share", _softmax(F.transform("mean", lambda m: m * weight))))
    n = len(langs)
    told = scored.where(F.col("letters") >= evidence.least_letters)
    places = written(told.groupBy("suffix", "host").agg(*_sums("share", n, "h"), F.count(F.lit(1)).alias("n_h")))
    suffixes = places.groupBy("suffix").agg(*[F.sum(f"h{k}").alias(f"s{k}") for k in range(n)])
    world = suffixes.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(n)]).first()
    world = [(x + 1) / (sum(world) + n) for x in world]
    total_s = sum((F.col(f"s{k}") for k in range(n)), F.lit(0.0))
    shrunk_s = [((F.col(f"s{k}") + evidence.suffix_weight * world[k]) / (total_s + evidence.suffix_weight)).alias(f"p{k}") for k in range(n)]
    places = places.join(suffixes.select("suffix", *shrunk_s), "suffix")
    # of each language's share, how much declares each language; others are one value
    named = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.lit(""))
    said = {r["said"]: r for r in told.groupBy(named.alias("said")).agg(*_sums("share", n, "d")).collect()}
    values = ["", *langs]
    table = np.array([[(said[v][f"d{k}"] if v in said else 0.0) + (5.0 if v == langs[k] else 0.1) for k in range(n)] for v in values])
    table = np.log(table / table.sum(axis=0))
    declared_logs = F.create_map(*[x for v, row in zip(values, table.tolist(), strict=True) for x in (F.lit(v), F.array(*[F.lit(y) for y in row]))])
    joined = scored.join(places, ["suffix", "host"], "left")
    has = F.when(F.col("letters") >= evidence.least_letters, F.lit(1.0)).otherwise(F.lit(0.0))
    prior = [
        F.coalesce((F.col(f"h{k}") - has * F.col("share")[k] + evidence.host_weight * F.col(f"p{k}")) / (F.col("n_h") - has + evidence.host_weight), F.lit(world[k])) for k in range(n)
    ]
    logs_all = [F.col("mean")[k] * weight + declared_logs[named][k] + F.log(F.greatest(prior[k], F.lit(1e-6))) for k in range(n)]
    fused = joined.withColumn("post", _softmax(F.array(*logs_all)))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("post", F.array_max("post")).cast("int")
    fused = fused.withColumn("best", best).withColumn("fit", F.element_at("mean", F.col("best")))
    # how well each language's own documents fit on the mean
    usual = {r["best"]: r["u"] for r in fused.where(F.col("letters") >= evidence.least_letters).groupBy("best").agg(F.avg("fit").alias("u")).collect()}
    floor = F.array(*[F.lit(float(usual.get(k + 1, 0.0)) - evidence.least_fit) for k in range(n)])
    enough = F.col("letters") >= evidence.least_letters
    text_best = F.array_position("share", F.array_max("share")).cast("int")
    return fused.select(
        F.col("id").alias(id_col), F.when(enough, F.element_at(names, F.col("best"))).alias("language"), F.when(enough, F.array_max("post")).otherwise(F.lit(0.0)).alias("posterior"),
        "declared", F.when(enough, F.element_at(names, text_best)).alias("text_language"), "n_grams",
        (enough & (F.array_max("post") >= evidence.least_posterior) & (F.col("fit") >= F.element_at(floor, F.col("best")))).alias("kept"),
    )
