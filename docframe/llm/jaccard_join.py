"""N-gram Jaccard self-join by rare-first prefix filtering, and the classes that its links make."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import arrow_rows, text_of, written
from docframe.llm.components import components
from docframe.llm.shingles import mix, shingle_sets


#: Longs of a set's sketch: for each of 64 * SKETCH classes of hashes, whether the set has an odd number of them.
SKETCH = 8
SKETCH_COLS = [f"s{k}" for k in range(SKETCH)]
#: Longs of the large sketch, which a pair is held against before its texts are fetched.
LARGE = 64


@dataclass(frozen=True)
class Join:
    """percent: the least similarity of a link. order_size: how many of the most frequent shingles are ranked by their
    counts; the rest come before them in the order of their hashes. The order decides how much work there is, never the
    result. A ranked shingle's rows are dealt to spread_parts tasks. Of the rest, blocks of about block_rows of a
    shingle's texts are held against all of its texts."""

    words: int = 5
    percent: int = 75
    order_size: int = 1 << 16
    spread_parts: int = 64
    block_rows: int = 2048
    chunk: int = 1 << 20
    batch_rows: int = 1024


def _census(join: Join):
    """Each text's size and fingerprint as a set (kind 0), and the shingles that a task meets in several texts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            some = counts > 1
            return rows(1, values[some].view(np.int64), counts[some], np.zeros(some.sum(), np.int64), np.zeros(some.sum(), np.int64))

        def rows(kind: int, a, b, c, d, odd=None) -> pa.RecordBatch:
            cols = [pa.array(x, pa.int64()) for x in (a, b, c, d)]
            n = len(cols[1])
            if odd is None:
                words, large = [pa.nulls(n, pa.int64())] * SKETCH, pa.nulls(n, pa.list_(pa.int64()))
            else:
                small = odd.reshape(n, LARGE // SKETCH, 64 * SKETCH).sum(axis=1, dtype=np.uint8) & 1  # parities add up
                small = np.packbits(small, axis=1).view(np.int64).reshape(n, SKETCH)
                words = [pa.array(np.ascontiguousarray(small[:, k])) for k in range(SKETCH)]
                bits = np.packbits(odd, axis=1).view(np.int64).ravel()
                large = pa.ListArray.from_arrays(pa.array(np.arange(0, n * LARGE + 1, LARGE, dtype=np.int32)), pa.array(bits))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols, *words, large], ["kind", "a", "b", "c", "d", *SKETCH_COLS, "large"])

        kept, held = [], 0
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            odd = np.zeros((batch.num_rows, 64 * LARGE), np.uint8)
            for i, own in shingle_sets(batch.column(1), join.words):
                n[i] = len(own)
                one[i] = mix(own).sum(dtype=np.uint64).view(np.int64)
                two[i] = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)
                odd[i] = np.bincount((own % np.uint64(64 * LARGE)).astype(np.int64), minlength=64 * LARGE) & 1
                kept.append(own)
                held += len(own)
                if held >= join.chunk:
                    yield counted(kept)
                    kept, held = [], 0
            yield rows(0, batch.column(0), n, one, two, odd)
        if kept:
            yield counted(kept)

    return run


def _prefixes(join: Join, ranked):
    """Rows (token, id, n, pos) of the leading shingles of each text, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = ranked.value
        for batch in batches:
            ids = batch.column(0)
            index, token, size, pos = [], [], [], []
            for i, own in shingle_sets(batch.column(1), join.words):
                n = len(own)
                if not n:
                    continue
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    common = tokens[at] == own
                    if common.any():
                        later = own[common][np.argsort(ranks[at[common]], kind="stable")]
                        own = np.concatenate([own[~common], later])
                head = n - -(-join.percent * n // 100) + 1
                index.append(np.full(head, i))
                token.append(own[:head].view(np.int64))
                size.append(np.full(head, n, np.int32))
                pos.append(np.arange(head, dtype=np.int32))
            if index:
                where = np.concatenate(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), ids.take(pa.array(where)), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos))],
                    ["token", "id", "n", "pos"],
                )

    return run


def _far_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Suffix filter: whether two sorted sets differ in more than `most` members for sure. Both are split at the middle
    of one; what the sizes of the parts differ by adds up, and parts are split again."""
    if abs(len(x) - len(y)) > most:
        return True
    if depth == 0 or not len(x) or not len(y):
        return False
    w = y[len(y) // 2]
    i, j = np.searchsorted(x, w), np.searchsorted(y, w)
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    return left + right > most or _far_apart(x[:i], y[:j], most - right, depth - 1) or _far_apart(x[i:], y[j:], most - left, depth - 1)


def _verified(join: Join):
    """(a, b, linked) for pairs with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = {}
            linked = np.zeros(batch.num_rows, bool)
            for (i, x), (_, y) in zip(shingle_sets(batch.column(2), join.words), shingle_sets(batch.column(3), join.words), strict=True):
                need = -(-join.percent * (len(x) + len(y)) // (100 + join.percent))
                if not _far_apart(x, y, len(x) + len(y) - 2 * need):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = both >= need
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    return run


def _possible(a: str, b: str, percent: int) -> Column:
    """Length filter, and a bound on what two sets differ in: two sketches differ in no more places than their sets."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(percent * (na + nb) / F.lit(100 + percent))
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH_COLS), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= na + nb - 2 * need)


def _stars(posting: DataFrame, join: Join) -> DataFrame:
    """Candidate pairs (a, b): of the texts with a leading shingle, each with the first and with the one before it in the
    order of sizes. Linear in the rows."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(join.spread_parts))).otherwise(F.lit(0).cast("long"))
    run = Window.partitionBy("token", "salt").orderBy("n", "id")
    rows = posting.select("token", salt.alias("salt"), "hot", F.struct("id", "n", "class", *SKETCH_COLS).alias("b"), "id", "n")
    others = F.array(F.lag("b").over(run), F.first("b").over(run))
    near = rows.select("b", others.alias("others")).select("b", F.explode("others").alias("a"))
    # the first ones of a hot shingle's parts, with the least of them
    firsts = rows.where("hot").groupBy("token", "salt").agg(F.min_by("b", F.struct("n", "id")).alias("b"))
    least = firsts.groupBy("token").agg(F.min_by("b", F.struct("b.n", "b.id")).alias("a"))
    near = near.unionByName(firsts.join(least, "token").select("b", "a"))
    return near.where("a is not null and a.id <> b.id").where(_possible("a", "b", join.percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _reclassed(posting: DataFrame, label: DataFrame) -> DataFrame:
    """posting with each text's class by its label; written, without the shingles whose texts are of one class."""
    named = posting.drop("class").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
    return written(named.join(mixed, "token", "left_semi"))


def _shared(left: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of rows that share a shingle. Where a shingle has more than block_rows texts, those of side a are dealt
    to blocks, each of which meets all of side b, so that no task holds all pairs of one shingle."""
    many = left.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > join.block_rows)
    many = many.select("token", F.ceil(F.col("rows") / F.lit(join.block_rows)).cast("long").alias("blocks"))
    dealt = left.join(many, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    row = F.struct("id", "n", "pos", "class", *SKETCH_COLS)
    a = dealt.select("token", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), row.alias("a"))
    b = dealt.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), row.alias("b"))
    return a.join(b, ["token", "block"])


def _joined(first: DataFrame, links: DataFrame) -> DataFrame:
    """first: (node, component); links: (a, b) found after it. The components of both: links tie first's components."""
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    second = components(named.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")))
    moved = second.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return first.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(second)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, n_links_found (pairs verified as links that touch the
    row's representative; links that could not change a class are not looked for).

    1. Texts of equal shingle sets have one representative, the smallest id.
    2. Leading shingles are dealt out by shingle, those met most often also by the id, and shingles with one text go.
    3. Stars: of the texts with a leading shingle, each is verified against the first and the one before it in the order
       of sizes. That is linear in the rows, and joins groups of near copies without all their pairs.
    4. The rest, exactly: pairs of texts in different classes that share a leading shingle and pass the length and
       positional filters and the bound by sketches, each verified once, behind a suffix filter.

    Defined results: null text and text without words have n_shingles 0 and are linked with nothing; rows of one id are
    one document; a row of null id is its own class with a null component_id; no rows give no rows; other columns are
    not read. Shingles are compared by 63-bit hashes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, join.batch_rows):  # every step that runs Python is written within
        return _classes(texts, id_col, join)


def _classes(texts: DataFrame, id_col: str, join: Join) -> DataFrame:
    spark = texts.sparkSession
    sketch_schema = ", ".join(f"{s} long" for s in SKETCH_COLS)
    census = written(texts.mapInArrow(_census(join), f"kind int, a long, b long, c long, d long, {sketch_schema}, large array<long>"))
    large = census.where("kind = 0 and b > 0").select(F.col("a").alias("id"), F.col("b").alias("n"), "large")
    sizes = census.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("one"), F.col("d").alias("two"), *SKETCH_COLS)
    top = census.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(join.order_size).collect()
    top = np.array([(r["a"], r["n"]) for r in top], np.int64).reshape(-1, 2)
    by_token = np.argsort(top[:, 0].view(np.uint64))
    ranked = spark.sparkContext.broadcast((top[by_token, 0].view(np.uint64), -by_token))
    same = sizes.where("n > 0 and id is not null").groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times"))
    # written, so that the join has exchanges of its own on both sides and a hot group's rows can be split among tasks
    same = written(same.where("times > 1").drop("times"))
    member = written(sizes.join(same, ["n", "one", "two"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), *SKETCH_COLS))

    hot = spark.createDataFrame([(int(t),) for t in top[:, 0]], "token long")
    prefix = texts.where("id is not null").mapInArrow(_prefixes(join, ranked), "token long, id long, n int, pos int")
    prefix = prefix.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "token", "left")
    dealt = prefix.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(join.spread_parts))).otherwise(F.lit(0).cast("long")))
    group = Window.partitionBy("token", "salt").orderBy("n", "id")
    seen = dealt.withColumn("before", F.lag("id").over(group)).withColumn("after", F.lead("id").over(group))
    shared = seen.where("hot or before is not null or after is not null").select("token", "id", "n", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))
    reps = member.where("id = rep").groupBy("id").agg(*[F.first(s).alias(s) for s in SKETCH_COLS])
    posting = written(shared.join(reps, "id").withColumn("class", F.col("id")))

    tried = _verify(_stars(posting, join), texts, large, join)
    first = components(tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    left = _reclassed(posting, first)

    need = F.ceil(join.percent * (F.col("a.n") + F.col("b.n")) / F.lit(100 + join.percent))
    ahead = F.col("a.n") - F.ceil(F.lit(2 * join.percent) * F.col("a.n") / F.lit(100 + join.percent)) + 1
    rest = _shared(left, join).where(
        (F.col("a.class") != F.col("b.class"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))))
        & (F.col("a.pos") < ahead)
        & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need)
        & _possible("a", "b", join.percent)
    )
    rest = written(rest.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
    found = _verify(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, large, join)
    links = written(tried.where("linked").select("a", "b").unionByName(found.where("linked").select("a", "b")))
    final = _joined(first, found.where("linked").select("a", "b"))
    touching = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links_found"))
    return (
        member.join(final.withColumnRenamed("node", "rep"), "rep", "left").join(touching, "rep", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links_found", F.lit(0).cast("long")).alias("n_links_found"))
    )


def _verify(pairs: DataFrame, texts: DataFrame, large: DataFrame, join: Join) -> DataFrame:
    """pairs: (a, b) in any order, repeated or not; each is held against the large sketches and, if they leave it
    possible, verified once. Written (a, b, linked), a < b, without the impossible ones."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sketch = large.repartition("id")
    side = lambda c: sketch.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("large").alias(f"l{c}"))
    differ = F.aggregate(F.zip_with("la", "lb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    size = F.col("na") + F.col("nb")
    likely = pairs.join(side("b"), "b").join(side("a"), "a").where(differ <= size - 2 * F.ceil(join.percent * size / F.lit(100 + join.percent)))
    pairs = written(likely.select("a", "b").distinct())
    dealt = texts.repartition("id")  # one exchange of the texts, read from both sides
    both = pairs.join(dealt.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(dealt.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    done = both.select("a", "b", "ta", "tb").mapInArrow(_verified(join), "a long, b long, linked boolean")
    return written(done.groupBy("a", "b").agg(F.bool_or("linked").alias("linked")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of docs whose id is the smallest of its class, and rows of null id; columns unchanged."""
    kept = classes(docs, id_col=id_col, text_col=text_col, join=join).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, docs[id_col] == kept["_kept"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
