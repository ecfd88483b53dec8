"""A naive Bayes text classifier in DataFrame operations only, with the features that tell classes apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import SPACE, smallest_hashes, written


@dataclass(frozen=True)
class Fit:
    """most_rows: the classifier is fitted on at most so many labelled documents, those with the smallest hash of the id.
    most_features: it keeps at most so many features, those of the largest deviation; least_deviation: in standard
    errors. largest_weight bounds what one feature adds to a log-odds; temper scales their sum, since features of one
    document aren't independent. That a feature is missing counts only for features of at most rare_share of the
    documents: the absence of others tells short texts from long ones."""

    most_rows: int = 20_000
    most_features: int = 4_096
    least_rows: int = 5
    least_deviation: float = 4.0
    largest_weight: float = 4.0
    temper: float = 0.5
    rare_share: float = 0.2


#: A feature that every text has.
EVERY = ""


#: Bits of the filter that drops words which are no feature before they become rows.
FILTER_BITS = 1 << 16


def featured(docs: DataFrame, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with the array `features` in place of text: distinct lower-cased words, the shapes of words (letters and
    digits each as one sign), how often words are repeated on the whole, and EVERY. wanted leaves out words and shapes.
    What is used twice has a projection of its own, so that it is computed once."""
    keys = [c for c in docs.columns if c != "text"]
    # the short class takes most letters; what it leaves is little
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[a-zA-ZÀ-ÖØ-öø-ÿ]+", "a"), r"\p{L}+", "a"), r"\p{Nd}+", "9")
    lowered = docs.select(*keys, F.lower("text").alias("_low"), F.split(signs, SPACE).alias("_shapes"))
    words = lowered.select(*keys, F.array_remove(F.split("_low", SPACE), "").alias("_words"), "_shapes")
    distinct = words.select(*keys, F.size("_words").alias("_n"), F.array_distinct("_words").alias("_words"), F.array_distinct("_shapes").alias("_shapes"))
    repeats = F.concat(F.lit("repeats "), F.floor(F.log2(F.col("_n") / F.greatest(F.size("_words"), F.lit(1)))).cast("string"))
    shapes = F.transform("_shapes", lambda s: F.concat(F.lit("shape "), s))
    own = [F.col("_words"), shapes] if wanted is None else [F.filter("_words", wanted), F.filter(shapes, wanted)]
    return distinct.select(*keys, F.concat(*own, F.array(F.coalesce(repeats, F.lit("repeats none")), F.lit(EVERY))).alias("features"))


def _among(features: list[str], docs: DataFrame) -> Callable[[Column], Column]:
    """Whether a word may be one of the features, by a bit of its hash: true for each that is one."""
    size = FILTER_BITS
    bits = [0] * (size // 64)
    table = docs.sparkSession.createDataFrame([(f,) for f in features], "f string")
    for r in table.select(F.pmod(F.xxhash64("f"), F.lit(size)).alias("at")).collect():
        bits[r["at"] >> 6] |= 1 << (r["at"] & 63)
    signed = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in bits)

    def test(word: Column) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(size)).cast("int")
        return F.getbit(F.get(F.split(F.lit(signed), ",").cast("array<bigint>"), F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    return test


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """docs: (id, text); labels: (id, label string). Returns the weights (feature, label, weight), at most most_features
    features, each label's share of the labelled documents, and its evidence from a text without any of the features."""
    chosen = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    chosen = smallest_hashes(chosen, "id", fit.most_rows)
    rows = written(featured(docs.join(F.broadcast(chosen), "id").select("label", "text")))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    found = written(rows.select("label", F.explode("features").alias("feature")).groupBy("feature").pivot("label", sorted(sizes)).count().na.fill(0))
    total = sum((F.col(f"`{k}`") for k in sizes), F.lit(0))
    p = (total + 0.5) / F.lit(n + 1.0)
    spread = {k: F.abs(F.col(f"`{k}`") / m - total / F.lit(max(1, n))) / F.sqrt(p * (1 - p) / m) for k, m in sizes.items()}
    deviation = F.greatest(*spread.values(), F.lit(0.0)) if spread else F.lit(0.0)
    kept = found.where(total >= fit.least_rows).withColumn("deviation", deviation).where(F.col("deviation") >= fit.least_deviation)
    kept = kept.orderBy(F.desc("deviation"), "feature").limit(fit.most_features)
    bound = F.lit(fit.largest_weight)

    def there(k: str) -> Column:
        own = F.log((F.col(f"`{k}`") + 0.5) / F.lit(sizes[k] + 1.0)) - F.log(p)
        return F.greatest(-bound, F.least(bound, own)) * F.lit(fit.temper)

    def missing(k: str) -> Column:
        own = F.log((F.lit(sizes[k] + 0.5) - F.col(f"`{k}`")) / F.lit(sizes[k] + 1.0)) - F.log(1 - p)
        return F.when(p <= fit.rare_share, F.greatest(-bound, F.least(bound, own)) * F.lit(fit.temper)).otherwise(F.lit(0.0))

    each = [F.struct(F.lit(k).alias("label"), (there(k) - missing(k)).alias("weight"), missing(k).alias("missing")) for k in sorted(sizes)]
    each = each or [F.struct(F.lit("").alias("label"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("missing"))]
    weights = written(kept.select("feature", F.explode(F.array(*each)).alias("w")).select("feature", "w.*"))
    bare = {r["label"]: r["m"] for r in weights.groupBy("label").agg(F.sum("missing").alias("m")).collect()}
    return weights, {k: m / n for k, m in sizes.items()}, {k: bare.get(k, 0.0) for k in sizes}


def evidence(docs: DataFrame, weights: DataFrame, labels: list[str]) -> DataFrame:
    """docs: (key columns..., text). The key columns with the array `evidence`: for each label the summed weights of the
    text's features, and `times`, how many rows of equal keys and text it stands for."""
    keys = [c for c in docs.columns if c != "text"]
    wide = weights.where(F.col("feature") != EVERY).groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, k in enumerate(labels)])
    # at most Fit.most_features of them
    wanted = _among([r["feature"] for r in wide.select("feature").collect()], docs)
    wide = wide.unionByName(docs.sparkSession.createDataFrame([(EVERY, *[0.0] * len(labels))], wide.schema))
    # explode would add a test for empty arrays, which computes them twice
    rows = featured(docs, wanted).select(*keys, F.explode_outer("features").alias("feature"))
    joined = rows.join(F.broadcast(wide), "feature")
    # each text has EVERY just once, so it tells how many times the row is there
    times = F.greatest(F.count_if(F.col("feature") == EVERY), F.lit(1))
    sums = [F.sum(f"w{i}") / times for i in range(len(labels))]
    return joined.groupBy(*keys).agg(F.array(*sums).cast("array<double>").alias("evidence"), F.count_if(F.col("feature") == EVERY).alias("times"))


def posteriors(evidence_col: Column, logs_before: list[float]) -> Column:
    """Softmax of the evidence and what is known before it (logs of priors and bare evidence), as an array in the order
    of the labels."""
    logs = F.zip_with(evidence_col, F.array(*[F.lit(float(p)) for p in logs_before]), lambda e, p: e + p)
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
