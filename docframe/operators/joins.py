"""Joins and set operations across aliases. Keys match as by ===: null equals null, NaN equals nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _without_nan(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(F.col(k).isNull() | ~F.isnan(k))
    return df


def _on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    test = F.lit(True)
    for a, b in pairs:
        test = test & left[a].eqNullSafe(right[b])
    return test


def lookup(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], order_by: list[str], name: str = "found") -> DataFrame:
    """Each left row with the first right row of its key as a struct; null if there is none."""
    keys = [b for _, b in pairs]
    best = _without_nan(right, keys).groupBy(*keys).agg(F.min_by(F.struct(*right.columns), F.struct(*order_by)).alias(name))
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
    return left.join(best, _on(left, best, [(a, f"_k_{b}") for a, b in pairs]), "left").select(*[left[c] for c in left.columns], name)


def inner(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    right = _without_nan(right, [b for _, b in pairs])
    return left.join(right, _on(left, right, pairs))


def nest(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], order_by: list[str], name: str = "items") -> DataFrame:
    """Each left row with all right rows of its key in an array, in order; an empty one if there are none. For keys whose
    rows fit one row; aggregate the right side first where only sums are wanted."""
    keys = [b for _, b in pairs]
    item = F.struct(*order_by, *[c for c in right.columns if c not in order_by])
    gathered = _without_nan(right, keys).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sort_array(F.collect_list(item)).alias(name))
    joined = left.join(gathered, _on(left, gathered, [(a, f"_k_{b}") for a, b in pairs]), "left")
    empty = F.array().cast(gathered.schema[name].dataType)
    return joined.select(*[left[c] for c in left.columns], F.coalesce(name, empty).alias(name))


def semi(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    right = _without_nan(right, [b for _, b in pairs])
    return left.join(right, _on(left, right, pairs), "left_semi")


def anti(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    right = _without_nan(right, [b for _, b in pairs])
    return left.join(right, _on(left, right, pairs), "left_anti")


def theta(left: DataFrame, right: DataFrame, test: Column) -> DataFrame:
    return left.join(right, test)


#: Buckets of a level are so many times as wide as those of the one below; the last level has a single bucket.
_WIDER, _LEVELS = 16, 16


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, through buckets. Width is that of the smallest buckets; a range is put into those
    of the first level of which it touches few, so it has at most 17 rows however long it is (ranges without an end are
    in the last level), and a point has one row for each level that some range is in. The bounds are tested again."""
    finite = lambda c: F.abs(c.cast("double")) < float("inf")
    length = (F.col(high).cast("double") - F.col(low).cast("double")) / F.lit(float(width))
    steps = F.ceil(F.log(F.greatest(length, F.lit(1.0))) / F.log(F.lit(float(_WIDER)))).cast("int") - 1
    level = F.when(finite(F.col(low)) & finite(F.col(high)), F.least(F.greatest(steps, F.lit(0)), F.lit(_LEVELS))).otherwise(_LEVELS)

    def bucket(c: Column) -> Column:
        size = F.lit(float(width)) * F.pow(F.lit(float(_WIDER)), F.col("_level"))
        return F.when(F.col("_level") == _LEVELS, 0).otherwise(F.floor(c.cast("double") / size)).cast("long")

    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_level", level)
    spread = spread.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    used = sorted(r["_level"] for r in spread.select("_level").distinct().collect()) or [0]
    placed = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in used]))).withColumn("_bucket", bucket(F.col(point)))
    return placed.join(spread, ["_level", "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_bucket")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs: the user's own product."""
    return left.crossJoin(right)


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], value: list[str], tie: str) -> DataFrame:
    """Each left row with the columns `value` of the last right row of its key at or before its time (the largest tie of
    equal times), as the struct `last`: one window over both sides, without pairs."""
    a = left.select(*[left[k].alias(k) for k in keys], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"))
    a = a.withColumn("_value", F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType))
    right = _without_nan(right, keys)
    b = right.select(*[right[k].alias(k) for k in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*value).alias("_value"))
    run = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("last", F.last("_value", ignorenulls=True).over(run))
    return seen.where("_side = 1").select("_row.*", "last")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Left rows, duplicates kept, whose columns are on the right too."""
    return semi(a, b, [(c, c) for c in columns])


def except_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return anti(a, b, [(c, c) for c in columns])
