"""A keyed, bounded log of expressions without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.strings import contains_any_case
from docframe.operators import groups

LIMIT = 200
ITEM = "user string, place long, expr string, is_favorite boolean, name string"


def apply_event(items: list[dict], action: str, expr: str, name: str | None, limit: int = LIMIT) -> list[dict]:
    """One event on one list. push: an equal expression goes, its flag stays, its name is lost; over the limit the
    oldest that are no favourites go first, then the oldest. toggleFavorite, delete and rename take the first equal one;
    a name that isn't blank makes a favourite."""
    at = next((i for i, x in enumerate(items) if x["expr"] == expr), None)
    if action == "push":
        kept = bool(at is not None and items[at]["is_favorite"])
        items = [x for x in items if x["expr"] != expr] + [{"expr": expr, "is_favorite": kept, "name": None}]
        while len(items) > limit:
            del items[next((i for i, x in enumerate(items) if not x["is_favorite"]), 0)]
    elif at is not None and action == "toggleFavorite":
        items[at] = items[at] | {"is_favorite": not items[at]["is_favorite"]}
    elif at is not None and action == "delete":
        items = items[:at] + items[at + 1 :]
    elif at is not None and action == "rename":
        text = (name or "").strip()
        items[at] = items[at] | {"name": text or None, "is_favorite": items[at]["is_favorite"] or bool(text)}
    return items


def fold_history(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """events: (user, seq, action, expr, name). Each user's list after all events in the order of seq; users are folded
    apart, a user's events are read as a stream, and a state has `limit` items at most."""

    def step(items: list[dict], r: dict) -> list[dict]:
        return apply_event(items, r["action"], r["expr"], r["name"], limit)

    def finish(items: list[dict]) -> list[dict]:
        return [x | {"place": i} for i, x in enumerate(items)]

    rows = events.select(F.col("user").cast("string").alias("user"), "seq", "action", "expr", "name")
    return groups.fold_rows(rows, ["user"], ["seq"], step, list, finish, ITEM)


def push_only(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same for logs of pushes alone, by aggregation: the last `limit` different expressions of each user."""
    last = events.groupBy("user", "expr").agg(F.max("seq").alias("seq"))
    newest = Window.partitionBy("user").orderBy(F.desc("seq"))
    kept = last.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit)
    return kept.withColumn("place", (F.row_number().over(Window.partitionBy("user").orderBy("seq")) - 1).cast("long")).drop("_r")


def normalised(text: Column) -> Column:
    """A stored item from its JSON: a bare string is an expression that is no favourite."""
    v = F.parse_json(text)
    bare = F.schema_of_variant(v) == "STRING"
    return F.struct(
        F.when(bare, F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.expr", "string")).alias("expr"),
        F.when(bare, F.lit(False)).otherwise(F.coalesce(F.try_variant_get(v, "$.isFavorite", "boolean"), F.lit(False))).alias("is_favorite"),
        F.when(bare, F.lit(None)).otherwise(F.try_variant_get(v, "$.name", "string")).alias("name"),
    )


def display_order() -> list[Column]:
    """Favourites first: named ones by name in locale order, then unnamed in list order; then the others, newest first."""
    name = F.trim(F.coalesce("name", F.lit("")))
    group = F.when(F.col("is_favorite") & (name != ""), 0).when(F.col("is_favorite"), 1).otherwise(2)
    return [group, F.when(group == 0, F.collate(name, "UNICODE")), F.when(group == 2, -F.col("place")).otherwise(F.col("place"))]


def search(items: DataFrame, term: str) -> DataFrame:
    return items.where(contains_any_case(F.col("expr"), term) | contains_any_case(F.coalesce("name", F.lit("")), term))
