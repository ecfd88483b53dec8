"""Exact dedup, quality rules, quality classifier and mixing."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import exact_dedup, mixing, quality_classifier, quality_rules
from docframe.llm import queries as Q
from tests.llm.fixtures import awkward_docs, empty_docs, prose


def test_exact_groups_of_awkward_rows(spark):
    rows = exact_dedup.exact_groups(awkward_docs(spark), keep="largest").collect()
    assert len(rows) == 16
    groups = {}
    for r in rows:
        groups.setdefault(r["row"]["text"] or "", []).append(r)
    for text, own in groups.items():
        assert {r["text_sha256"] for r in own} == {hashlib.sha256(text.encode()).hexdigest()}
        assert {r["group_size"] for r in own} == {len(own)}
        ids = [r["row"]["doc_id"] for r in own if r["row"]["doc_id"] is not None]
        assert {r["keep_id"] for r in own} == {max(ids) if ids else None}
        assert sum(r["kept"] for r in own) == 1
    assert all(r["row"]["id"] == "x" and r["row"]["kept"] == "x" for r in rows)
    assert [r["row"]["text"] for r in rows if r["row"]["doc_id"] == 4] == [None]


def test_exact_dedup_keeps_smallest_with_normaliser(spark):
    kept = exact_dedup.exact_dedup(awkward_docs(spark), normalise=F.lower)
    assert sorted(r["doc_id"] for r in kept.where("text like '%ne two'").collect()) == [7]
    assert kept.columns == awkward_docs(spark).columns
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0


def test_exact_dedup_splits_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.exact_groups(docs, keep="largest").where("row.text = 'hot'").collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(2997, 1000)} and sum(r["kept"] for r in rows) == 1


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_against_plain_python(spark):
    extra = [(20, "a b c d e a b c d e x\n\n y\n y\n", "en"), (21, "a a a a a a a", "en"), (22, "# #|| <x>", "en"), (23, prose(5, 60) + "\n" + prose(5, 60), "de"), (24, "a\x1cb c d", "en")]
    docs = awkward_docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    got = quality_rules.judge(docs).collect()
    assert len(got) == 21
    for r in got:
        if r["doc_id"] is not None:
            want = plain_counts(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])


def test_quality_rules_reject_junk_and_keep_clean(spark):
    rows = [(k, prose(k, 200), "en") for k in range(60)] + [(100, " ".join(w.upper() + "!!###" for w in prose(99, 200).split()), "en"), (101, " | ".join("qx" * (k % 5 + 1) for k in range(200)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101]
    assert quality_rules.judge(empty_docs(spark)).count() == 0


def test_quality_rules_distances_against_plain_python(spark):
    rows = [(k, prose(k, 40 + k), "en" if k % 2 else "de") for k in range(40)] + [(50, "Extraordinarily " * 60 + prose(7, 30), "en"), (51, "ab 12 ?! " * 40, "de")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    limits = quality_rules.Limits()
    classes = [r"[a-z]", r"[A-Z]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[0-9]"]

    def js(p, q):
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum((part(a, b) + part(b, a)) / 2 for a, b in zip(p, q, strict=True))))

    for lang in ("en", "de"):
        own = {k: t for k, t, x in rows if x == lang}
        census = Counter(w for t in own.values() for w in t.lower().split())
        top = sorted((-n, w) for w, n in census.items() if n >= limits.common_share * census.total())
        common = [w for _, w in top][: limits.common_words]
        chars, words = {}, {}
        for k, t in own.items():
            hits = [len(re.findall(c, t)) for c in classes]
            if len(t) >= limits.min_chars:
                chars[k] = [n / len(t) for n in [*hits, len(t) - sum(hits)]]
            seen = Counter(t.lower().split())
            if seen.total() >= limits.min_words:
                found = [seen[w] for w in common]
                words[k] = [n / seen.total() for n in [*found, *[0] * (limits.common_words - len(found)), seen.total() - sum(found)]]
        for name, hist in (("char_distance", chars), ("word_distance", words)):
            mean = [sum(x) / len(hist) for x in zip(*hist.values(), strict=True)]
            for k in own:
                assert got[k][name] == (pytest.approx(js(hist[k], mean), abs=1e-9) if k in hist else None)


def test_quality_classifier_shrinks_sparse_sites(spark):
    rows, labels, places = [], [], []
    for k in range(200):
        bad = k % 2
        rows.append((k, "junk spam pills buy now " * 5 + prose(k, 20) if bad else prose(k, 60), "en", "x"))
        places.append((k, "badhost" if bad else "goodhost", "/a"))
        labels.append((k, "bad" if bad else "good"))
    rows += [(1000, "", "en", "x"), (1001, None, "en", "y"), (1002, "", "en", "z")]
    places += [(1000, "badhost", "/a"), (1001, "goodhost", "/a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_classifier.judge(docs, spark.createDataFrame(labels, "id long, label string"), spark.createDataFrame(places, "id long, host string, path string")).collect()}
    assert len(got) == 203
    assert got[1000]["path_quality"] < got[1002]["path_quality"] < got[1001]["path_quality"]
    assert got[1000]["quality"] < got[1001]["quality"]
    assert all(got[k]["kept"] for k in range(0, 200, 2)) and not any(got[k]["kept"] for k in range(1, 200, 2))


def test_quality_classifier_edges(spark):
    labels = spark.createDataFrame([], "id long, label string")
    places = spark.createDataFrame([], "id long, host string, path string")
    got = quality_classifier.judge(awkward_docs(spark), labels, places).collect()
    assert len(got) == 16 and all(r["kept"] for r in got)
    assert quality_classifier.judge(empty_docs(spark), labels, places).count() == 0


def test_quality_classifier_against_plain_means(spark):
    rows = [(k, "junk spam pills buy now " * 3 + prose(k, 20) if k % 3 == 0 else prose(k, 60)) for k in range(90)]
    places = [(k, f"h{k % 5}", f"/{k % 2}") for k in range(88)] + [(88, "alone", "/"), (89, "single", "/")]
    labels = spark.createDataFrame([(k, "bad" if k % 3 == 0 else "good") for k in range(60)], "id long, label string")
    docs = spark.createDataFrame([(*r, "en", "x") for r in rows], "doc_id long, text string, lang string, source string")
    sites = quality_classifier.Sites(least_weight=5.0, most_weight=5.0)
    got = {r["doc_id"]: r for r in quality_classifier.judge(docs, labels, spark.createDataFrame(places, "id long, host string, path string"), sites=sites).collect()}
    site = {k: (h, p) for k, h, p in places}

    def shrunk(own, centre):
        return (sum(own) + 5.0 * centre) / (len(own) + 5.0)

    for k, r in got.items():
        others = [(site[j], x["text_quality"]) for j, x in got.items() if j != k]
        on_host = shrunk([q for (h, _), q in others if h == site[k][0]], sum(q for _, q in others) / len(others))
        assert r["path_quality"] == pytest.approx(shrunk([q for s, q in others if s == site[k]], on_host))


def test_quality_classifier_on_held_out_labels(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "labels").collect()
    labels = spark.createDataFrame([(r["doc_id"], "good" if r["quality"] == 1 else "bad") for r in rows if r["doc_id"] % 2], "id long, label string")
    docs, places = Q.table(spark, sf_dir, "documents"), Q.sites_of(Q.table(spark, sf_dir, "pages"))
    got = {r["doc_id"]: r for r in quality_classifier.judge(docs, labels, places).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in rows if r["doc_id"] % 2 == 0]
    good, bad = [g for g, q in held if q == 1], [g for g, q in held if q == 0]
    ranked = [(g["quality"] > b["quality"]) + 0.5 * (g["quality"] == b["quality"]) for g in good for b in bad]
    assert sum(ranked) / len(ranked) > 0.7
    assert sum(g["kept"] for g in good) / len(good) > 0.95


def test_mixing_meets_targets(spark):
    rows, labels = [], []
    for k in range(300):
        kind = ("good", "plain", "toxic")[k % 3]
        rows.append((k, prose(k, 40) + (" spam pills" if kind == "plain" else " idiot moron" if kind == "toxic" else " lovely kind"),))
        labels.append((k, kind))
    mix = mixing.Mix(targets={"good": 0.7, "plain": 0.2, "toxic": 0.1}, size=0.4)
    got = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "id long, label string"), mix=mix).toPandas()
    total = (got.rate * got.tokens).sum()
    shares = [(got.rate * got.tokens * got[f"p_{k}"]).sum() / total for k in ("good", "plain", "toxic")]
    assert shares == pytest.approx([0.7, 0.2, 0.1], abs=0.01) and total == pytest.approx(0.4 * got.tokens.sum(), rel=0.01)
    assert (got.rate >= 0).all()


def test_mixing_of_bounded_rates_keeps_shares_and_the_scarcest_domain(spark):
    rows, labels = [], []
    for k in range(400):
        kind = ("good", "plain", "plain", "toxic")[k % 4]
        rows.append((k, prose(k, 30 + k % 40) + (" spam pills" if kind == "plain" else " idiot moron" if kind == "toxic" else " lovely kind")))
        labels.append((k, kind))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "id long, label string")
    want = {"good": 0.6, "plain": 0.3, "toxic": 0.1}
    mix = mixing.Mix(targets=want, stretch=1.1, most_rate=1.0)
    got = mixing.rates(docs, known, mix=mix).toPandas()
    names = list(want)
    p, tokens, r = got[[f"p_{k}" for k in names]].to_numpy(), got.tokens.to_numpy(), got.rate.to_numpy()
    sums = (r * tokens) @ p
    assert r.min() >= 0 and r.max() <= 1
    assert sums / sums.sum() == pytest.approx(list(want.values()), abs=0.01)
    assert sums[0] > 0.97 * (tokens @ p)[0]
    kept = {x["doc_id"] for x in mixing.mixed(docs, known, mix=mixing.Mix(targets=want, stretch=1.1)).collect()}
    assert sum(k % 4 == 0 for k in kept) > 95 and 0.2 < sum(k % 4 in (1, 2) for k in kept) / len(kept) < 0.4


def test_mixing_reaches_the_least_squares_optimum(spark):
    rows = [(k, prose(k, 20 + k % 50) + (" spam pills" if k % 3 else " lovely kind") * (k % 4)) for k in range(200)]
    labels = spark.createDataFrame([(k, "plain" if k % 3 else "good") for k in range(200)], "id long, label string")
    # more of the scarce domain than any rates give without the other: the fit is a compromise
    mix = mixing.Mix(targets={"good": 0.97, "plain": 0.03}, size=0.5, tolerance=1e-6, most_rounds=200)
    got = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), labels, mix=mix).toPandas()
    p, tokens = got[["p_good", "p_plain"]].to_numpy(), got.tokens.to_numpy()
    whole = tokens @ p
    target = [0.97 * 0.5 * tokens.sum(), 0.03 * 0.5 * tokens.sum()]

    def loss(r):
        return ((((r * tokens) @ p - target) ** 2) / whole).sum()

    r = np.ones(len(tokens))
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (((r * tokens) @ p - target) / whole))
    assert loss(got.rate.to_numpy()) <= loss(r) + 1e-4 * tokens.sum()


def test_mixing_edges(spark):
    labels = spark.createDataFrame([], "id long, label string")
    got = mixing.rates(awkward_docs(spark), labels).collect()
    assert len(got) == 16 and all(r["rate"] == pytest.approx(1) for r in got)
    assert mixing.rates(empty_docs(spark), labels).count() == 0
    assert mixing.mixed(awkward_docs(spark), labels).columns == awkward_docs(spark).columns
