"""Array columns: the array methods as column expressions, with positions from 0 and negatives from the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Items = Callable[[Column], Column]


def _bound(value: int | Column, n: Column) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.least(n, F.greatest(F.lit(0), F.when(v < 0, n + v).otherwise(v)))


def map_items(arr: Column, f: Items) -> Column:
    return F.transform(arr, f)


def filter_items(arr: Column, keep: Items) -> Column:
    """Items for which keep is true; null counts as false."""
    return F.filter(arr, lambda x: F.coalesce(keep(x), F.lit(False)))


def slice_items(arr: Column, start: int | Column = 0, end: int | Column | None = None) -> Column:
    """Items from start to before end."""
    n = F.size(arr)
    a = _bound(start, n)
    z = n if end is None else _bound(end, n)
    return F.slice(arr, a + 1, F.greatest(z - a, F.lit(0)))


def concat_items(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.array()) for p in parts])


def flat(arr: Column, depth: int = 1) -> Column:
    """One level of nesting less for each depth; a null item stays."""
    for _ in range(depth):
        arr = F.flatten(F.transform(arr, lambda x: F.coalesce(x, F.array(F.lit(None)))))
    return arr


def flat_map(arr: Column, f: Items) -> Column:
    return F.flatten(F.transform(arr, lambda x: F.coalesce(f(x), F.array())))


def sort_by(arr: Column, key: Items, descending: bool = False) -> Column:
    """Stable order by key, nulls last; items of equal keys keep their order."""
    n = F.when(F.lit(descending), -1).otherwise(1)

    def compare(a: Column, b: Column) -> Column:
        ka, kb = key(a["v"]), key(b["v"])
        by_key = F.when(ka.isNull() & kb.isNull(), 0).when(ka.isNull(), 1).when(kb.isNull(), -1).when(ka < kb, -n).when(ka > kb, n).otherwise(0)
        return F.when(by_key != 0, by_key).otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))

    placed = F.transform(arr, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed, compare), lambda s: s["v"])


def sort_as_text(arr: Column) -> Column:
    """The default order: by the items' text, so that 10 comes before 9; null as 'null'. For integers and strings."""
    return sort_by(arr, lambda x: F.coalesce(x.cast("string"), F.lit("null")))


def reverse(arr: Column) -> Column:
    return F.reverse(arr)


def push(arr: Column, *values: Column) -> Column:
    return F.concat(arr, F.array(*values))


def unshift(arr: Column, *values: Column) -> Column:
    return F.concat(F.array(*values), arr)


def pop(arr: Column) -> tuple[Column, Column]:
    """The last item (null of an empty array) and the rest."""
    return F.try_element_at(arr, F.lit(-1)), slice_items(arr, 0, -1)


def shift(arr: Column) -> tuple[Column, Column]:
    """The first item and the rest."""
    return F.get(arr, F.lit(0)), slice_items(arr, 1)


def includes(arr: Column, value: Column) -> Column:
    """Null equals null and NaN equals NaN; never null."""
    return F.coalesce(F.exists(arr, lambda x: x.eqNullSafe(value)), F.lit(False))


def some(arr: Column, test: Items) -> Column:
    return F.coalesce(F.exists(arr, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def every(arr: Column, test: Items) -> Column:
    return F.coalesce(F.forall(arr, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))


def find(arr: Column, test: Items) -> Column:
    return F.get(filter_items(arr, test), F.lit(0))


def find_index(arr: Column, test: Items) -> Column:
    places = F.transform(arr, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i))
    return F.coalesce(F.array_min(places), F.lit(-1))


def at(arr: Column, i: int) -> Column:
    return F.try_element_at(arr, F.lit(i + 1 if i >= 0 else i))


def item(arr: Column, i: int | Column) -> Column:
    return F.get(arr, i if isinstance(i, Column) else F.lit(i))


def index_of(arr: Column, value: Column, fractional: bool = False) -> Column:
    """First place of a value, -1 if none. Null is found; NaN never is (fractional: items may be NaN)."""
    same = (lambda x: x.eqNullSafe(value) & ~F.coalesce(F.isnan(x), F.lit(False))) if fractional else (lambda x: x.eqNullSafe(value))
    return find_index(arr, same)


def last_index_of(arr: Column, value: Column, fractional: bool = False) -> Column:
    found = index_of(F.reverse(arr), value, fractional)
    return F.when(found >= 0, F.size(arr) - 1 - found).otherwise(F.lit(-1))


def join_items(arr: Column, separator: str = ",") -> Column:
    return F.array_join(arr.cast("array<string>"), separator, "")


def reduce(arr: Column, start: Column, f: Callable[[Column, Column], Column], finish: Items | None = None) -> Column:
    return F.aggregate(arr, start, f, finish) if finish else F.aggregate(arr, start, f)


def reduce_right(arr: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(arr), start, f)


def reduce_first(arr: Column, f: Callable[[Column, Column], Column]) -> Column:
    """A fold that starts from the first item; an empty array is an error."""
    first = F.when(F.size(arr) == 0, F.raise_error(F.lit("reduce of an empty array with no start"))).otherwise(F.get(arr, F.lit(0)))
    return F.aggregate(slice_items(arr, 1), first, f)


def length(arr: Column) -> Column:
    return F.size(arr).cast("long")


def distinct(arr: Column) -> Column:
    """Distinct items in first-seen order."""
    return F.array_distinct(arr)


def top_k(arr: Column, key: Items, k: int, descending: bool = True) -> Column:
    return F.slice(sort_by(arr, key, descending), 1, k)


def with_fields(item_: Column, **fields: Column) -> Column:
    """A copy of an object with fields set or added."""
    for name, value in fields.items():
        item_ = item_.withField(name, value)
    return item_


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.array_except(a, b)
