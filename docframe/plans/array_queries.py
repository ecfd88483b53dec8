"""Array methods over array columns: the turns of conversations, the lines of orders, embeddings."""

from pyspark.sql import functions as F

from docframe.functions import arrays as A
from docframe.plans.registry import query

_CONV = "WITH c AS (SELECT conv_id, list({'role': role, 'n': length(text), 'turn': turn} ORDER BY turn) AS t FROM conversations GROUP BY conv_id) "
_LINES = "WITH o AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey) "


def _turns(t):
    item = F.struct("turn", "role", F.length("text").cast("long").alias("n"))
    return t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))


def _quantities(t):
    item = F.struct("l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return t("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["q"]).alias("q"))


def _text(arr):
    return A.join_items(arr, "|")


@query(_CONV + "SELECT conv_id, array_to_string(list_transform(t, lambda x: x.role), '|') AS roles, array_to_string(list_transform(list_filter(t, lambda x: x.role = 'user'), lambda x: x.n), '|') AS user_sizes FROM c")
def array_map_filter(t):
    """A1, A2, A25, A26 on array columns."""
    roles = A.map_items(F.col("t"), lambda x: x["role"])
    sizes = A.map_items(A.filter_items(F.col("t"), lambda x: x["role"] == "user"), lambda x: x["n"])
    return _turns(t).select("conv_id", _text(roles).alias("roles"), _text(sizes).alias("user_sizes"))


@query(_LINES + "SELECT l_orderkey, array_to_string(q[2:3], '|') AS middle, array_to_string(q[greatest(len(q) - 1, 1):], '|') AS last_two, array_to_string(list_reverse(q), '|') AS reversed FROM o")
def array_slice_reverse(t):
    """A3, A8 on array columns."""
    q = F.col("q")
    return _quantities(t).select("l_orderkey", _text(A.slice_items(q, 1, 3)).alias("middle"), _text(A.slice_items(q, -2)).alias("last_two"), _text(A.reverse(q)).alias("reversed"))


@query(_LINES + "SELECT l_orderkey, array_to_string(list_concat(q, [0, len(q)]), '|') AS pushed, array_to_string(list_concat([-1], q), '|') AS unshifted, array_to_string(q[1:len(q) - 1], '|') AS popped, array_to_string(q[2:], '|') AS shifted, q[len(q)] AS last, q[1] AS first FROM o")
def array_push_pop(t):
    """A4, A9, A10 on array columns."""
    q = F.col("q")
    (last, popped), (first, shifted) = A.pop(q), A.shift(q)
    return _quantities(t).select(
        "l_orderkey", _text(A.push(q, F.lit(0).cast("long"), A.length(q))).alias("pushed"), _text(A.unshift(q, F.lit(-1).cast("long"))).alias("unshifted"), _text(popped).alias("popped"), _text(shifted).alias("shifted"), last.alias("last"), first.alias("first")
    )


@query(_LINES + "SELECT l_orderkey, array_to_string(flatten(list_transform(q, lambda x: CASE WHEN x > 40 THEN [] ELSE [x, x * 2] END)), '|') AS mapped FROM o")
def array_flat_map(t):
    """A5, A6 on array columns."""
    return _quantities(t).select("l_orderkey", _text(A.flat_map(F.col("q"), lambda x: F.when(x > 40, F.array().cast("array<long>")).otherwise(F.array(x, x * 2)))).alias("mapped"))


@query(_LINES + "SELECT l_orderkey, array_to_string(list_transform(list_sort(list_transform(q, lambda x: x::VARCHAR)), lambda x: x), '|') AS as_text, array_to_string(list_sort(q), '|') AS as_number, array_to_string(list_reverse_sort(q)[1:2], '|') AS top FROM o")
def array_sort(t):
    """A7, A30 on array columns."""
    q = F.col("q")
    return _quantities(t).select("l_orderkey", _text(A.sort_as_text(q)).alias("as_text"), _text(A.sort_by(q, lambda x: x)).alias("as_number"), _text(A.top_k(q, lambda x: x, 2)).alias("top"))


@query(_LINES + "SELECT l_orderkey, list_contains(q, 7) AS includes, len(list_filter(q, lambda x: x > 45)) > 0 AS some, len(list_filter(q, lambda x: x > 5)) = len(q) AS every, (coalesce(list_position(q, 7), 0) - 1)::BIGINT AS at7, CASE WHEN list_contains(q, 7) THEN len(q) - list_position(list_reverse(q), 7) ELSE -1 END::BIGINT AS last7 FROM o")
def array_tests(t):
    """A11, A12, A13, A18 on array columns."""
    q = F.col("q")
    return _quantities(t).select(
        "l_orderkey", A.includes(q, F.lit(7)).alias("includes"), A.some(q, lambda x: x > 45).alias("some"), A.every(q, lambda x: x > 5).alias("every"),
        A.index_of(q, F.lit(7)).cast("long").alias("at7"), A.last_index_of(q, F.lit(7)).cast("long").alias("last7"),
    )


@query(_CONV + "SELECT conv_id, list_filter(t, lambda x: x.role = 'assistant')[1].n AS found, (coalesce(list_position(list_transform(t, lambda x: x.role), 'assistant'), 0) - 1)::BIGINT AS index, t[len(t)].n AS last, t[3].n AS third FROM c")
def array_find_at(t):
    """A14, A15, A16, A17 on array columns."""
    arr = F.col("t")
    test = lambda x: x["role"] == "assistant"
    return _turns(t).select("conv_id", A.find(arr, test)["n"].alias("found"), A.find_index(arr, test).cast("long").alias("index"), A.at(arr, -1)["n"].alias("last"), A.item(arr, 2)["n"].alias("third"))


@query(_LINES + "SELECT l_orderkey, array_to_string(q, ', ') AS joined, list_sum(q)::BIGINT AS total, len(q) AS n, list_reduce(list_reverse(q), lambda a, x: (a * 3 + x) % 1009) AS folded_right, list_reduce(q, lambda a, x: (a * 3 + x) % 1009) AS folded FROM o")
def array_reduce_join(t):
    """A19-A22, A24 on array columns."""
    q = F.col("q")
    step = lambda a, x: (a * 3 + x) % 1009
    return _quantities(t).select(
        "l_orderkey", A.join_items(q, ", ").alias("joined"), A.reduce(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), A.length(q).alias("n"),
        A.reduce_first(A.reverse(q), step).alias("folded_right"), A.reduce_first(q, step).alias("folded"),
    )


@query(_LINES + "SELECT l_orderkey, len(list_distinct(q)) AS n_distinct, list_sum(list_transform(q, lambda x, i: x * (i - 1)))::BIGINT AS weighted, len(list_intersect(list_distinct(q), [1, 2, 3, 4, 5])) AS n_small FROM o")
def array_distinct_index(t):
    """A28, A29, J10 on array columns."""
    q = F.col("q")
    weighted = A.reduce(F.transform(q, lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x)
    small = F.array(*[F.lit(k).cast("long") for k in range(1, 6)])
    return _quantities(t).select("l_orderkey", A.length(A.distinct(q)).alias("n_distinct"), weighted.alias("weighted"), A.length(A.intersect(q, small)).alias("n_small"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings")
def array_embedding_norm(t):
    """A1, A2, A21 on vectors."""
    e = F.col("embedding")
    squares = A.reduce(A.map_items(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.round(squares, 4).alias("squares"), A.length(e).alias("n"), A.length(A.filter_items(e, lambda x: x > 0)).alias("n_positive"))
