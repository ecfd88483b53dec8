"""Quality rules by distribution divergence, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import SPACE, text_of, words_of, written

#: Character classes as Java patterns; what none of them takes is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("space", r"[\x20\x09-\x0D]+"), ("stop", r"[.,;:!?'\"()-]+"), ("digit", r"\p{Nd}+"))
N_CLASSES = len(CLASSES) + 1


@dataclass(frozen=True)
class Limits:
    """min_chars, min_words: shorter texts are not judged by the character or the word histogram. The divergences are
    Jensen-Shannon distances (square roots, base 2), between 0 and 1."""

    min_chars: int = 200
    min_words: int = 50
    max_char_distance: float = 0.30
    max_word_distance: float = 0.50
    common_words: int = 24
    common_share: float = 0.002
    language_share: float = 0.001
    repeat_window: int = 5


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def base_counts(docs: DataFrame, text: str, window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and the array `_words` to docs.

    Repeated windows: hashes of each window's words are sorted with their places, and a window whose hash is its
    neighbour's is compared with it in full, so a hash clash can't count as a repeat; the cost grows as n log n.
    """
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words_of(t)).withColumn("_lines", lines).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    places = F.slice("_hashes", 1, F.greatest(F.size("_hashes") - F.lit(window - 1), F.lit(0)))
    keyed = F.transform(places, lambda h, i: F.struct(F.xxhash64(h, *[F.get("_hashes", i + k) for k in range(1, window)]).alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.sort_array(keyed)).drop("_hashes")

    def equal(x: Column, y: Column) -> Column:
        own = lambda z: F.slice("_words", z["i"] + 1, window)
        return F.coalesce((x["h"] == y["h"]) & (own(x) == own(y)), F.lit(False))

    again = F.filter("_sorted", lambda x, k: equal(x, F.get("_sorted", k - 1)) | equal(x, F.get("_sorted", k + 1)))
    out = out.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    gaps = F.transform("_starts", lambda x, k: F.least(F.coalesce(F.get("_starts", k + 1) - x, F.lit(window)), F.lit(window)))
    return out.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda x, y: x + y).cast("long").alias("n_repeat_words"),
    ).drop("_lines", "_starts")


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the array `_classes` of character counts: each class is taken out of what the ones before it left."""
    lengths = [F.length(text)]
    left = text
    for name, pattern in CLASSES:
        df = df.withColumn(f"_no_{name}", F.regexp_replace(left, pattern, ""))
        left = f"_no_{name}"
        lengths.append(F.length(left))
    counts = [(a - b).cast("double") for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1].cast("double")]
    return df.withColumn("_classes", F.array(*counts)).drop(*[f"_no_{name}" for name, _ in CLASSES])


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda x, y: x + y)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def language_words(texts: DataFrame, limits: Limits) -> DataFrame:
    """One row per language of at least language_share of the documents, and one under the name of null for all others:
    `ref` and `common`, its most frequent words. A common word is one with common_share of the words of its language, of
    whatever length: there are at most 1 / common_share of them, and at most 1 / language_share languages, whatever the
    corpus."""
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    n_docs = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    large = sizes.where(F.col("lang").isNotNull() & (F.col("n_docs") >= limits.language_share * n_docs)).select("lang", F.col("lang").alias("ref"))
    word = (
        texts.select("lang", F.explode(F.split(F.lower("text"), SPACE)).alias("w"))
        .where("w <> ''")
        .groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(large), "lang", "left")
        .groupBy("ref", "w").agg(F.sum("n").alias("n"))
    )
    word = written(word)
    total = word.groupBy("ref").agg(F.sum("n").alias("total")).withColumnRenamed("ref", "ref_t")
    frequent = word.join(F.broadcast(total), F.col("ref").eqNullSafe(F.col("ref_t"))).where(F.col("n") >= limits.common_share * F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "w")))
    common = frequent.groupBy("ref").agg(F.slice(F.transform(ranked, lambda x: x["w"]), 1, limits.common_words).alias("common"))
    langs = large.withColumnRenamed("lang", "lang_r")
    return langs.join(common, "ref", "left").unionByName(
        common.where("ref is null").select(F.lit(None).cast("string").alias("lang_r"), "ref", "common"), allowMissingColumns=True
    )


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row per document: id_col, the base counts, base_failed, kept, char_distance and word_distance.

    Language references come from all documents: the mean character-class and common-word histograms over the documents
    of the language that are long enough. A document is rejected when one of its distances to its own language's
    reference is above the limit; texts under the minimum lengths have null distances and pass.

    Defined results: null text counts as empty (base_failed); a null or rare language is held against the reference of
    all rare ones together; repeated rows are judged each; no rows give no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    refs = written(language_words(texts, limits))
    named = F.broadcast(refs.where("ref is not null").select(F.col("lang_r").alias("lang"), "ref", F.col("common").alias("own_common")))
    others = refs.where("ref is null").select("common").first()
    rest = F.array(*[F.lit(w) for w in (others[0] if others else [])]).cast("array<string>")
    with_ref = texts.join(named, "lang", "left").withColumn("common", F.coalesce("own_common", rest)).drop("own_common")
    counted = class_counts(base_counts(with_ref, "text", limits.repeat_window), "text")
    # one letter for each common word, so that its count is a difference of lengths
    letters = "".join(chr(0x4E00 + k) for k in range(limits.common_words))
    zipped = F.transform(F.col("_words"), lambda w: F.array_position("common", F.lower(w)))
    counted = counted.withColumn("_marks", F.array_join(F.transform(F.filter(zipped, lambda k: k > 0), lambda k: F.substring(F.lit(letters), k.cast("int"), F.lit(1))), ""))
    hits = [(F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit(x)))).cast("double") for x in letters]
    feature = counted.select(
        "_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.length("text").alias("chars"), shares(F.col("_classes")).alias("classes"),
        F.array(*hits, (F.col("n_words") - F.length("_marks")).cast("double")).alias("hits"),
    )
    feature = written(feature.withColumn("hits", shares(F.col("hits"))))
    long_c, long_w = F.col("chars") >= limits.min_chars, F.col("n_words") >= limits.min_words
    reference = feature.groupBy("ref").agg(
        F.array(*[F.coalesce(F.avg(F.when(long_c, F.col("classes")[k])), F.lit(0.0)) for k in range(N_CLASSES)]).alias("ref_classes"),
        F.array(*[F.coalesce(F.avg(F.when(long_w, F.col("hits")[k])), F.lit(0.0)) for k in range(limits.common_words + 1)]).alias("ref_hits"),
    ).withColumnRenamed("ref", "ref_r")
    joined = feature.join(F.broadcast(reference), F.col("ref").eqNullSafe(F.col("ref_r")), "left")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        F.when(long_c, js_distance(F.col("classes"), F.col("ref_classes"))).alias("char_distance"),
        F.when(long_w, js_distance(F.col("hits"), F.col("ref_hits"))).alias("word_distance"),
    )
    close = (F.coalesce("char_distance", F.lit(0.0)) <= limits.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.max_word_distance)
    cols = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return scored.select(*cols, (~F.col("base_failed") & close).alias("kept"), "char_distance", "word_distance")
