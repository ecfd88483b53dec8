"""Sources and array methods over rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.values import string_of
from docframe.operators import order, rows
from docframe.plans.registry import query
from docframe.sources import documents


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total_k FROM events GROUP BY event_type")
def source_json_strict(t):
    """JSON text parsed strictly into typed columns."""
    typed = t("events").select("event_type", F.from_json("props", "k long", {"mode": "FAILFAST", "allowSingleQuotes": "false"}).alias("p"))
    return typed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total_k"))


@query("SELECT 'data' AS alias, count(*) AS n FROM orders UNION ALL SELECT 'data1', count(*) FROM lineitem UNION ALL SELECT '$c', count(*) FROM customer")
def source_aliases(t):
    """Several sources under aliases."""
    bound = documents.Sources(data=t("orders"), data1=t("lineitem"), **{"$c": t("customer")})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("alias"), "n") for a, df in bound.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def source_wrapped_records(t):
    """S3: records in a wrapper object's array."""
    item = F.struct("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return documents.records(t("conversations").groupBy("conv_id").agg(F.collect_list(item).alias("items")).select("items"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def source_records_beside_a_column(t):
    """S3: an array beside another column is no wrapper; nothing is lost."""
    wrapped = documents.records(t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("items")))
    return wrapped.select("conv_id", F.size("items").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 12000")
def rows_slice_deep(t):
    """A3: a slice far from either end, by places."""
    return order.slice_rows(t("orders").select("o_orderkey"), [F.col("o_orderkey")], 12000, 12050)


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_retailprice * 10000 = floor(p_retailprice * 10000) THEN CAST(CAST(p_retailprice * 10000 AS BIGINT) AS VARCHAR) END, p_partkey) - 1 AS _pos FROM part WHERE p_retailprice * 10000 = floor(p_retailprice * 10000)")
def rows_sort_doubles_as_text(t):
    """Large whole doubles in the order of their own text, without exponents."""
    p = t("part").select("p_partkey", F.floor(F.col("p_retailprice") * 10000).cast("double").alias("x"), (F.col("p_retailprice") * 10000).alias("y")).where("x = y").drop("y")
    return order.with_position(p, [string_of(F.col("x"), T.DoubleType()), F.col("p_partkey")]).select("p_partkey", "_pos")


@query("""SELECT to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS value FROM orders""")
def sink_json_lines(t):
    """Rows as JSON lines."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return t("orders").select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT 'events.parquet' AS file_name, count(*) AS n FROM events")
def source_provenance(t):
    """The file that rows come from."""
    found = documents.with_provenance(t("events").select("event_id", "_metadata"))
    name = F.regexp_extract("file_path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1)
    return found.groupBy(name.alias("file_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS sample FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2)")
def source_sample_text(t):
    """The first two records as JSON."""
    return documents.sample_text(t("orders").select("o_orderkey", "o_orderstatus"), [F.col("o_orderkey")])


@query("SELECT o_orderkey, o_orderpriority AS priority, CAST(o_totalprice * 2 AS DOUBLE) AS doubled FROM orders")
def rows_map(t):
    """One object for each row."""
    return rows.map_rows(t("orders"), o_orderkey=F.col("o_orderkey"), priority=F.col("o_orderpriority"), doubled=F.col("o_totalprice") * 2)


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 7 <> 0")
def rows_filter_truthy(t):
    """A2: rows whose test is truthy."""
    return rows.filter_rows(t("part"), F.col("p_size") % 7).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10")
def rows_slice(t):
    """A3: slice(10, 50)."""
    return order.slice_rows(t("orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], 10, 50)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r BETWEEN 6 AND 30")
def rows_slice_from_end(t):
    """A3: slice(-30, -5)."""
    return order.slice_rows(t("orders").select("o_orderkey"), [F.col("o_orderkey")], -30, -5)


@query("SELECT 0 AS _source, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier")
def rows_concat(t):
    """Rows of both."""
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return rows.concat_rows(a, b)


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def rows_flat_map(t):
    """A row for each line of each text."""
    return rows.flat_rows(t("documents").select("doc_id", F.split("text", "\n", -1).alias("line")), "line")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey::VARCHAR) - 1 AS _pos FROM nation")
def rows_sort_as_text(t):
    """The default order puts 10 before 9."""
    return order.with_position(t("nation").select(F.col("n_nationkey")), [F.col("n_nationkey").cast("string")])


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS _pos FROM events")
def rows_reverse_index(t):
    """Opposite order, with contiguous places."""
    return order.with_position(t("events").select("event_id"), [F.desc("event_id")])


@query("SELECT max(event_id) AS event_id FROM events UNION ALL SELECT min(event_id) FROM events")
def rows_pop_shift(t):
    """The last row and the first."""
    e = t("events").select("event_id")
    last = order.row_at(e, [F.col("event_id")], -1, [F.desc("event_id")])
    return last.unionByName(order.row_at(e, [F.col("event_id")], 0))


@query("SELECT coalesce(bool_or(event_type = 'signup'), false) AS includes FROM events")
def rows_includes(t):
    """A11."""
    return rows.includes(t("events"), "event_type", "signup")


@query("SELECT coalesce(bool_or(l_quantity > 49), false) AS some FROM lineitem")
def rows_some(t):
    """A12."""
    return rows.some(t("lineitem"), F.col("l_quantity") > 49)


@query("SELECT coalesce(bool_and(l_quantity > 0), true) AS every FROM lineitem")
def rows_every(t):
    """A13."""
    return rows.every(t("lineitem"), F.col("l_quantity") > 0)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 1")
def rows_find(t):
    """A14."""
    return rows.find(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_totalprice") > 100000, [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("SELECT coalesce(min(p), -1) AS index FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE event_type = 'error'")
def rows_find_index(t):
    """A15."""
    return rows.find_index(order.with_position(t("events").select("event_id", "event_type"), [F.col("event_id")]), F.col("event_type") == "error")


@query("SELECT coalesce(max(p), -1) AS index FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE event_type = 'purchase'")
def rows_last_index_of(t):
    """A18."""
    return rows.last_index_of(order.with_position(t("events").select("event_id", "event_type"), [F.col("event_id")]), "event_type", "purchase")


@query("SELECT string_agg(n_name, '; ' ORDER BY n_nationkey) AS text FROM nation")
def rows_join_text(t):
    """One text of all."""
    return rows.join_text(t("nation"), "n_name", "n_nationkey", "; ")


@query("SELECT count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem")
def rows_reduce_length(t):
    """A fold that is a sum, and the number of rows."""
    return t("lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def rows_property_path(t):
    """Data.props.k through a variant."""
    return t("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT c_custkey, c_name, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS c_acctbal, 'x' AS mark FROM customer")
def rows_spread(t):
    """A copy with fields set and added."""
    return t("customer").select("c_custkey", "c_name", "c_acctbal").withColumns({"c_acctbal": F.floor(F.col("c_acctbal") + 0.5).cast("long"), "mark": F.lit("x")})


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def rows_distinct(t):
    """Each brand with its first part."""
    p = t("part").select("p_brand", "p_partkey")
    return rows.distinct_rows(p, ["p_brand"], "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rows_top_k(t):
    """A30."""
    return order.top_k(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)
