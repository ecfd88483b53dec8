"""Document quality by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm import textmodel
from docframe.llm.common import text_of, written


@dataclass(frozen=True)
class Sites:
    """least_quality: documents of a lower posterior are rejected. The prior weights of a level, in documents, come from
    the spread of its sites' means, and are held between least_weight and most_weight."""

    least_quality: float = 0.2
    least_weight: float = 5.0
    most_weight: float = 10_000.0
    fit: textmodel.Fit = textmodel.Fit()


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def _prior_weight(sites: DataFrame, total: Column, n: Column, centre: Column, level: Sites) -> float:
    """Method of moments: of sites with means scattered about their centres, the weight that explains the scatter."""
    mean = total / n
    row = sites.where(n >= 2).agg(
        F.sum(n * (mean - centre) * (mean - centre)).alias("scatter"), F.sum(centre * (1 - centre)).alias("noise"), F.sum(n * centre * (1 - centre)).alias("room")
    ).first()
    if not row["noise"] or not row["room"]:
        return level.most_weight
    between = (row["scatter"] - row["noise"]) / row["room"]
    return min(level.most_weight, max(level.least_weight, 1 / between - 1)) if between > 0 else level.most_weight


def judge(docs: DataFrame, labels: DataFrame, places: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", section_col: str = "lang", sites: Sites = Sites()) -> DataFrame:
    """labels: (id, label 'good' or 'bad'); places: (id, host, path), one row for an id; a document without a place has
    its source as host and its section as path. One row per row of docs: id_col, host, path, text_quality, path_quality
    (the shrunk mean of the other documents on the path), quality and kept.

    Evidence: naive Bayes log-odds of good against bad. Each document's share of good under the labels' prior is summed
    by path with map-side partials, paths by host, hosts in all. A host's mean is shrunk to the global mean, a path's to
    its host's, by prior weights from the spread of sites. The means of all three levels leave the document itself out,
    so that its own text counts once, however few documents its site has. The posterior's log-odds are the text's plus
    the path's.

    Defined results: null text counts as empty, with evidence 0; a null source or section is a site of its own; without
    labelled rows all evidence is 0 and everything is kept; repeated rows have a result each; no rows give no rows;
    other columns are not read.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), own(source_col).alias("source"), own(section_col).alias("section"))
    known = places.select(F.col("id").alias("id_s"), F.col("host").alias("host_s"), F.col("path").alias("path_s")).where("id_s is not null")
    weights, priors, bare = textmodel.fitted(texts.select("id", "text"), labels, sites.fit)
    good = priors.get("good", 0.5) if len(priors) > 1 else 0.5
    seen = textmodel.evidence(texts.select("id", "source", "section", "text", F.xxhash64("text").alias("h")), weights, ["good", "bad"])
    odds = F.col("evidence")[0] - F.col("evidence")[1] + F.lit(bare.get("good", 0.0) - bare.get("bad", 0.0))
    prior = float(min(1 - 1e-6, max(1e-6, good)))
    share = 1 / (1 + F.exp(-(odds + F.log(F.lit(prior / (1 - prior))))))
    seen = seen.join(known, seen["id"] == known["id_s"], "left").withColumns({"host": F.coalesce("host_s", "source"), "path": F.coalesce("path_s", "section")})
    scored = written(seen.select("id", "host", "path", "times", odds.alias("odds"), share.alias("share")))
    paths = written(scored.groupBy("host", "path").agg(F.sum(F.col("share") * F.col("times")).alias("good_p"), F.sum("times").alias("n_p")))
    hosts = written(paths.groupBy("host").agg(F.sum("good_p").alias("good_h"), F.sum("n_p").alias("n_h")))
    total = hosts.agg(F.sum("good_h").alias("g"), F.sum("n_h").alias("n")).first()
    mean = total["g"] / total["n"] if total["n"] else 0.5
    k_host = _prior_weight(hosts, F.col("good_h"), F.col("n_h"), F.lit(mean), sites)
    hosts = hosts.withColumn("mean_h", (F.col("good_h") + F.lit(k_host * mean)) / (F.col("n_h") + F.lit(k_host)))
    both = written(paths.join(hosts, "host"))
    k_path = _prior_weight(both, F.col("good_p"), F.col("n_p"), F.col("mean_h"), sites)
    joined = scored.join(both, ["host", "path"])
    own_share, rest = F.col("share"), (total["n"] or 0) - 1
    global_mean = (F.lit(total["g"]) - own_share) / F.lit(rest) if rest > 0 else F.lit(0.5)
    host_mean = (F.col("good_h") - own_share + k_host * global_mean) / (F.col("n_h") - 1 + F.lit(k_host))
    path_quality = (F.col("good_p") - own_share + k_path * host_mean) / (F.col("n_p") - 1 + F.lit(k_path))
    joined = joined.withColumn("path_quality", path_quality).withColumn("quality", 1 / (1 + F.exp(-(F.col("odds") + _logit(F.col("path_quality"))))))
    # rows that were scored together are taken apart again
    each = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(F.col("id").alias(id_col), "host", "path", F.col("share").alias("text_quality"), "path_quality", "quality", (F.col("quality") >= sites.least_quality).alias("kept"))
