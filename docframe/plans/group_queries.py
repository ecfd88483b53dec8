"""Grouping, windows, history and the flagship."""

from pyspark.sql import functions as F

from docframe.functions import strings as S
from docframe.operators import groups, history, joins, order, present
from docframe.plans.registry import query

_MONEY = "decimal(18,2)"


@query("""SELECT row_number() OVER (ORDER BY revenue DESC, label) - 1 AS _pos, label, 'revenue' AS series, revenue AS value FROM (
SELECT c_mktsegment AS label, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS revenue
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY revenue DESC, label LIMIT 3)""")
def flagship_segment_revenue_series(t):
    """Three aliases, filtered, joined, grouped, the largest, as a chart series."""
    orders = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice").cast(_MONEY) * (1 - F.col("l_discount").cast(_MONEY))).alias("part"))
    joined = joins.inner(joins.inner(orders, lines, [("o_orderkey", "l_orderkey")]), t("customer").select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")])
    revenue = groups.aggregate(joined, ["c_mktsegment"], revenue=F.sum("part").cast("double")).withColumnRenamed("c_mktsegment", "label")
    best = order.top_k(revenue, [F.desc("revenue"), F.col("label")], 3)
    return present.chart_series(order.with_position(best, [F.desc("revenue"), F.col("label")]))


@query("SELECT count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders")
def group_summary(t):
    """G1."""
    return groups.summary(t("orders").select(F.col("o_totalprice").cast(_MONEY).alias("p")), "p").select("n", F.col("total").cast("double").alias("total"), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events GROUP BY user_id")
def group_items(t):
    """Rows of each key in order."""
    grouped = groups.group_items(t("events").select("user_id", "event_id"), ["user_id"], ["event_id"])
    return grouped.select("user_id", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total, min(l_quantity) AS least, max(l_quantity) AS most, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def group_aggregate(t):
    """G3, G4."""
    return groups.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), total=F.sum(F.col("l_quantity").cast(_MONEY)).cast("double"), least=F.min("l_quantity"), most=F.max("l_quantity"), parts=F.count_distinct("l_partkey"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS n_big, coalesce(sum(CASE WHEN user_id % 2 = 0 THEN user_id END), 0)::BIGINT AS even_users, bool_or(value > 99) AS some, bool_and(value >= 0) AS every FROM events GROUP BY event_type")
def group_conditional(t):
    """G5, G6."""
    return groups.aggregate(
        t("events"), ["event_type"], n_big=F.count_if(F.col("value") > 50), even_users=F.coalesce(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("user_id"))), F.lit(0)), some=groups.some_of(F.col("value") > 99), every=groups.every_of(F.col("value") >= 0)
    )


@query("SELECT user_id, min_by(event_type, event_id) AS first, max_by(event_type, event_id) AS last, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def group_first_last_text(t):
    """G7, G8."""
    e, o = F.col("event_type"), F.col("event_id")
    return groups.aggregate(t("events"), ["user_id"], first=groups.first_of(e, o), last=groups.last_of(e, o), path=groups.joined_text(e, o, ">"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def group_pivot(t):
    """A count matrix."""
    return groups.pivot(t("orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], n=F.count(F.lit(1))).na.fill(0)


@query("SELECT event_id, row_number() OVER w AS r, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, (sum(user_id) OVER w)::BIGINT AS running, round(avg(user_id + 0.0) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_rows(t):
    """W1-W4."""
    k, o = ["user_id"], [F.col("event_id")]
    e = F.col("event_id")
    return t("events").select(
        "event_id", groups.row_number(k, o).alias("r"), groups.previous(e, k, o).alias("before"), groups.following(e, k, o).alias("after"),
        groups.running(F.sum("user_id"), k, o).alias("running"), F.round(groups.moving(F.avg("user_id"), k, o, 3), 6).alias("moving"),
    )


@query("SELECT event_id, round(user_id / sum(user_id) OVER (PARTITION BY event_type), 9) AS share FROM events")
def window_share(t):
    """W5."""
    return t("events").select("event_id", F.round(groups.share(F.col("user_id"), ["event_type"]), 9).alias("share"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def window_top_k(t):
    """W6."""
    return groups.top_k_of_each(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("SELECT event_id, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS running FROM events")
def window_running_total(t):
    """W3 without a key, in two phases."""
    return order.running_total(t("events").select("event_id", "user_id"), [F.col("event_id")], "user_id").select("event_id", "running")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase' AND event_id > last_other) AS purchases_at_end FROM (SELECT *, coalesce(max(event_id) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id), -1) AS last_other FROM events) GROUP BY user_id")
def custom_fold(t):
    """An ordered fold of each key by Python code."""
    e = t("events").select("user_id", "event_id", "event_type")

    def step(state, row):
        return state + 1 if row["event_type"] == "purchase" else 0

    return groups.fold(e, ["user_id"], ["event_id"], step, lambda: 0, lambda s: {"purchases_at_end": s}, "user_id long, purchases_at_end long")


_EXPR = "event_type || '.' || json_extract_string(props, '$.k')"


def _pushes(t):
    return t("events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("."), F.get_json_object("props", "$.k")).alias("expr"))


@query(f"SELECT user, expr, row_number() OVER (PARTITION BY user ORDER BY seq) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY seq DESC) AS r FROM (SELECT user_id AS user, {_EXPR} AS expr, max(event_id) AS seq FROM events GROUP BY ALL)) WHERE r <= 20")
def history_push_only(t):
    """H1 for logs of pushes."""
    return history.push_only(_pushes(t), 20).select("user", "expr", "place")


def _events(t):
    action = F.when(F.col("k") % 10 == 0, "toggleFavorite").when(F.col("k") % 10 == 1, "delete").when(F.col("k") % 10 == 2, "rename").otherwise("push")
    k = F.get_json_object("props", "$.k").cast("long")
    e = t("events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), "event_type", k.alias("k"))
    return e.select("user", "seq", action.alias("action"), F.concat("event_type", F.lit("."), (F.col("k") % 7).cast("string")).alias("expr"), F.when(F.col("k") % 20 == 2, F.lit(" ")).otherwise(F.concat(F.lit("n"), F.col("k").cast("string"))).alias("name"))


@query()
def history_fold(t):
    """H1-H4: all events in order, for each user."""
    return history.fold_history(_events(t), 10)


@query()
def history_display(t):
    """H6, H7: found items in display order."""
    from pyspark.sql import Window

    items = history.search(history.fold_history(_events(t), 10), "  C ")
    return items.withColumn("shown", F.row_number().over(Window.partitionBy("user").orderBy(*history.display_order())))


@query("SELECT event_id, event_type AS expr, false AS is_favorite, CAST(NULL AS VARCHAR) AS name FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, true, 'n' || event_id FROM events WHERE event_id % 2 = 1")
def history_normalised(t):
    """H5: bare strings and objects."""
    e = F.col("event_id")
    rich = F.to_json(F.struct(F.col("event_type").alias("expr"), F.lit(True).alias("isFavorite"), F.concat(F.lit("n"), e.cast("string")).alias("name")))
    text = F.when(e % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(rich)
    return t("events").select("event_id", history.normalised(text).alias("i")).select("event_id", "i.*")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12')")
def history_search(t):
    """H7: case-insensitive search."""
    return t("customer").where(S.contains_any_case(F.col("c_name"), " 12")).select("c_custkey", "c_name")
