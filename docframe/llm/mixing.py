"""Mixing sources to target weights with soft domain membership, in DataFrame operations only."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm import textmodel
from docframe.llm.common import text_of, words_of, written


@dataclass(frozen=True)
class Mix:
    """targets: each domain's share of the tokens of the mixture; shares are scaled to add up to 1. size: tokens of the
    mixture as a share of the corpus's; None for the most that needs no domain more often than it is there. stretch: of
    that size; above 1, bounded rates take the scarcest domain whole. most_rate: no rate is above it; where bounded rates
    fall short of a target, all targets shrink alike to what they reach, so that the shares hold. tolerance: of the
    largest error of a domain's tokens, against the mixture's; steps that change less than a hundredth of it end the
    search too. most_rounds of gradient steps; after each `block` of them the rates are written."""

    targets: dict[str, float] = field(default_factory=lambda: {"good": 0.96, "plain": 0.03, "toxic": 0.01})
    size: float | None = None
    stretch: float = 1.0
    most_rate: float | None = None
    tolerance: float = 1e-3
    block: int = 8
    most_rounds: int = 80
    fit: textmodel.Fit = textmodel.Fit()


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain that a labelled row states."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "plain")


def rates(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """labels: (id, label). One row per row of docs: id_col, tokens, p_<domain> for each domain, rate >= 0.

    A classifier fitted on the labelled table predicts each document's domain posteriors p. Rates r minimise the sum
    over domains k of (sum of r * tokens * p_k - target_k)^2 / S_k, where S_k is the domain's expected tokens in the
    corpus, by projected gradient steps from r = 1: each takes the domains' totals of the current rates by one
    aggregate, and moves every rate by the same expression of its own posteriors, not below 0 (nor above most_rate).
    Tokens are words. Targets that the rates miss in the end by over 1 % of the mixture are told in a warning.

    Defined results: null or empty text has no tokens, the posteriors of the priors, and a rate that follows them;
    targets of domains without labelled rows or tokens are left out; without labelled rows there is one domain, 'all';
    repeated rows have a rate each; no rows give no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    weights, priors, bare = textmodel.fitted(texts, labels, mix.fit)
    names = sorted(k for k in priors if mix.targets.get(k, 0) > 0) or ["all"]
    tokens = F.size(words_of(F.col("text"))).cast("double")
    seen = textmodel.evidence(texts.select("id", "text", F.xxhash64("text").alias("h"), tokens.alias("tokens")), weights, names)
    # rows that were scored together are taken apart again
    each = seen.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    p = textmodel.posteriors(F.col("evidence"), [math.log(priors.get(k, 1.0)) + bare.get(k, 0.0) for k in names])
    scored = each.withColumn("p", p).select("id", "tokens", *[F.col("p")[i].alias(f"p{i}") for i in range(len(names))], F.lit(1.0).alias("rate"))
    now = written(scored)

    def totals(rate: Column, frame: DataFrame) -> list[float]:
        row = frame.agg(*[F.coalesce(F.sum(rate * F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(str(i)) for i in range(len(names))]).first()
        return list(row)

    whole = totals(F.lit(1.0), now)
    used = [i for i, s in enumerate(whole) if s > 0]
    share = {i: mix.targets.get(names[i], 1.0) for i in used}
    share = {i: s / sum(share.values()) for i, s in share.items()}
    size = mix.stretch * (sum(whole) * mix.size if mix.size is not None else min((whole[i] / share[i] for i in used), default=0.0))
    rate, step, last = F.col("rate"), 1.0, None
    for k in range(mix.most_rounds):
        got, near = totals(rate, now), mix.tolerance * size
        if all(abs(got[i] - share[i] * size) <= near for i in used):
            break
        if last and all(abs(got[i] - last[i]) <= near / 100 for i in used):
            reached = min(got[i] / share[i] for i in used)
            if mix.most_rate is None or reached >= size * (1 - mix.tolerance):
                break
            size = reached
        last = got
        error = {i: (got[i] - share[i] * size) / whole[i] for i in used}
        moved = rate - F.lit(step) * sum((F.lit(e) * F.col(f"p{i}") for i, e in error.items()), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), moved if mix.most_rate is None else F.least(F.lit(float(mix.most_rate)), moved))
        if k % mix.block == mix.block - 1:
            now, rate = written(now.withColumn("rate", rate)), F.col("rate")
    missed = {names[i]: x - share[i] * size for i, x in enumerate(totals(rate, now)) if i in share and abs(x - share[i] * size) > 0.01 * size}
    if missed:
        warnings.warn(f"tokens above or below their targets: {missed}", stacklevel=2)
    return now.select(F.col("id").alias(id_col), F.col("tokens").cast("long").alias("tokens"), *[F.col(f"p{i}").alias(f"p_{k}") for i, k in enumerate(names)], rate.alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mix: Mix = Mix(), seed: int = 7) -> DataFrame:
    """The mixture without repeats: each row of docs stays with the chance of its rate, fitted with 1 as the most, drawn
    by a hash of its id, so that the draw is the same on every run. Columns are unchanged; rows of null id share one
    draw."""
    rate = rates(docs, labels, id_col=id_col, text_col=text_col, mix=replace(mix, most_rate=1.0))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    kept = rate.where(draw < F.col("rate")).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
