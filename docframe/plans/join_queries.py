"""Joins and set operations across aliases."""

from pyspark.sql import functions as F

from docframe.operators import joins
from docframe.plans.registry import query


@query("SELECT o.o_orderkey, f.l_linenumber, f.l_partkey FROM orders o LEFT JOIN (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1) f ON o.o_orderkey = f.l_orderkey")
def join_lookup(t):
    """Map with find."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    found = joins.lookup(t("orders").select("o_orderkey"), lines, [("o_orderkey", "l_orderkey")], ["l_linenumber", "l_partkey"])
    return found.select("o_orderkey", "found.l_linenumber", "found.l_partkey")


@query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_inner(t):
    """flatMap with filter."""
    orders = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return joins.inner(orders, t("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), [("o_orderkey", "l_orderkey")]).drop("l_orderkey")


@query("SELECT d.doc_id, coalesce(len(l.items), 0) AS n, coalesce(list_sum(l.items), 0)::BIGINT AS toxic FROM documents d LEFT JOIN (SELECT doc_id, list(toxic) AS items FROM labels GROUP BY doc_id) l USING (doc_id)")
def join_nest(t):
    """Map with filter, empty arrays where nothing is found."""
    nested = joins.nest(t("documents").select("doc_id"), t("labels"), [("doc_id", "doc_id")], ["quality", "toxic"])
    total = F.aggregate(F.transform("items", lambda x: x["toxic"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return nested.select("doc_id", F.size("items").cast("long").alias("n"), total.alias("toxic"))


@query("SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)")
def join_semi(t):
    """Filter with some."""
    return joins.semi(t("documents").select("doc_id", "lang"), t("labels").where("quality = 1"), [("doc_id", "doc_id")])


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def join_anti(t):
    """Filter with none."""
    return joins.anti(t("documents").select("doc_id", "lang"), t("labels"), [("doc_id", "doc_id")])


@query("SELECT c_custkey, band FROM customer JOIN (SELECT n_nationkey AS band, n_nationkey * 450 - 1000 AS lo, n_nationkey * 450 - 400 AS hi FROM nation) ON c_acctbal >= lo AND c_acctbal < hi")
def join_range(t):
    """Ranges, through buckets."""
    n = F.col("n_nationkey")
    bands = t("nation").select(n.alias("band"), (n * 450 - 1000).alias("lo"), (n * 450 - 400).alias("hi"))
    return joins.range_join(t("customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "lo", "hi", 500.0).select("c_custkey", "band")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    """The user's own product of two small datasets."""
    return joins.cross(t("region").select("r_name"), t("nation").select("n_name"))


@query("SELECT a.event_id, max_by(b.event_id, b.event_id) AS signup_id, max(b.ts) IS NOT NULL AS known FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id")
def join_as_of(t):
    """The last signup at or before each purchase."""
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    found = joins.as_of(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type"), "ts", "ts", ["user_id"], ["event_id", "ts"], "event_id")
    return found.select("event_id", F.col("last.event_id").alias("signup_id"), F.col("last").isNotNull().alias("known"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    """Concat with Set."""
    return joins.union_distinct(t("customer").select(F.col("c_nationkey").alias("nation")), t("supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_intersect(t):
    """Filter with includes, duplicates kept."""
    poor = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.intersect_rows(t("orders").select("o_orderkey", "o_custkey"), poor, ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_except(t):
    """Filter without includes."""
    poor = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.except_rows(t("orders").select("o_orderkey", "o_custkey"), poor, ["o_custkey"])


@query("SELECT event_id, NULL::DOUBLE AS last FROM events WHERE event_id % 5 = 0 UNION ALL SELECT e.event_id, (SELECT max_by(value, event_id) FROM events f WHERE f.event_type = e.event_type AND f.event_id % 5 <> 0 AND f.user_id % 7 = e.user_id % 7 AND f.event_id <= e.event_id) FROM events e WHERE event_id % 5 <> 0")
def join_as_of_nan(t):
    """Keys that are NaN match nothing."""
    key = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("user_id") % 7).cast("double"))
    e = t("events").select("event_id", "event_type", "value", key.alias("key"))
    found = joins.as_of(e.select("event_id", "event_type", "key"), e, "event_id", "event_id", ["event_type", "key"], ["value"], "event_id")
    return found.select("event_id", F.col("last.value").alias("last"))
