"""Row operators, joins, history, schema, shaping, sources, sinks and streams."""

import csv
import io
import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docframe.operators import delivery, groups, history, joins, order, present, rows, schema
from docframe.plans import pipeline
from docframe.sources import documents, sinks
from docframe.streaming import delivery as stream_delivery
from docframe.streaming import history as stream_history


def test_positions_are_contiguous(spark):
    for n, parts in ((0, 1), (1, 3), (1000, 7)):
        df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("x")).repartition(parts)
        got = order.with_position(df, [F.col("x")]).orderBy("_pos").collect()
        assert [r["_pos"] for r in got] == list(range(n)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def test_slices_and_places(spark):
    df, up, down = spark.range(20), [F.col("id")], [F.desc("id")]
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(order.slice_rows(df, up, 3, 6)) == [3, 4, 5] and ids(order.slice_rows(df, up, -3)) == [17, 18, 19]
    assert ids(order.slice_rows(df, up, -100, 2)) == [0, 1] and ids(order.slice_rows(df, up, 5, 2)) == []
    assert ids(order.row_at(df, up, 4)) == [4] and ids(order.row_at(df, up, -2, down)) == [18] and ids(order.row_at(df, up, 99)) == []
    running = order.running_total(df.repartition(5), up, "id").orderBy("id").collect()
    assert [r["running"] for r in running] == [sum(range(k + 1)) for k in range(20)]


def test_rows(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(3, 1.5)], "k int, w double")
    assert rows.concat_rows(a, b).columns == ["k", "v", "_source", "w"] and rows.push_rows(a, b)[1] == 3 and rows.unshift_rows(a, b)[1] == 3
    empty = a.limit(0)
    assert rows.some(empty, F.col("k") > 0).first()[0] is False and rows.every(empty, F.col("k") > 0).first()[0] is True
    assert rows.includes(a, "v", None).first()[0] is True and rows.includes(empty, "v", None).first()[0] is False
    assert rows.join_text(a, "v", "k").first()[0] == "x,"
    assert sorted(r["l"] for r in rows.flat_rows(spark.createDataFrame([([1, 2],), ([],)], "l array<int>"), "l").collect()) == [1, 2]
    assert [r["k"] for r in rows.text_order(spark.createDataFrame([(10,), (9,), (1,)], "k int"), "k").collect()] == [1, 10, 9]


def test_joins_match_nulls_but_not_nan(spark):
    left = spark.createDataFrame([(1, 1.0), (2, None), (3, math.nan)], "id int, k double")
    right = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (None, "n"), (math.nan, "x")], "k double, v string")
    on = [("k", "k")]
    found = {r["id"]: r["found"] and r["found"]["v"] for r in joins.lookup(left, right, on, ["v"]).collect()}
    assert found == {1: "a", 2: "n", 3: None}
    assert {r["id"]: len(r["items"]) for r in joins.nest(left, right, on, ["v"]).collect()} == {1: 2, 2: 1, 3: 0}
    assert {r["id"] for r in joins.semi(left, right, on).collect()} == {1, 2} and {r["id"] for r in joins.anti(left, right, on).collect()} == {3}
    assert joins.inner(left, right, on).count() == 3


def test_range_and_as_of(spark):
    points = spark.createDataFrame([(float(x),) for x in (-3, 0, 5, 9.5, 20)], "p double")
    ranges = spark.createDataFrame([("a", -5.0, 5.0), ("b", 5.0, 10.0), ("c", 3.0, 3.0)], "n string, lo double, hi double")
    assert sorted((r["p"], r["n"]) for r in joins.range_join(points, ranges, "p", "lo", "hi", 2.0).collect()) == [(-3, "a"), (0, "a"), (5, "b"), (9.5, "b")]
    a = spark.createDataFrame([("u", 1), ("u", 5), ("v", 5)], "k string, t int")
    b = spark.createDataFrame([("u", 1, 1), ("u", 4, 2), ("u", 4, 3), ("u", 6, 4)], "k string, t int, i int")
    got = {(r["k"], r["t"]): r["last"] and r["last"]["i"] for r in joins.as_of(a, b, "t", "t", ["k"], ["i"], "i").collect()}
    assert got == {("u", 1): 1, ("u", 5): 3, ("v", 5): None}


def test_groups_fold(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 7), ("b", 1, 1)], "k string, o int, x int")
    got = groups.fold(df, ["k"], ["o"], lambda s, r: s * 10 + r["x"], lambda: 0, lambda s: {"v": s}, "k string, v long")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": 75, "b": 1}


def test_groups_fold_holds_no_group(spark):
    n = 60_000  # more than one Arrow batch of one key
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, F.lit("b"))).alias("k"), (-F.col("id")).alias("o"), F.when(F.col("id") > 0, F.col("id")).alias("x"))
    # step must take a null as None, the last in order, and ints as ints
    got = groups.fold(df, ["k"], ["o"], lambda s, r: (s[0] + 1, r["x"]), lambda: (0, 0), lambda s: {"n": s[0], "last": s[1]}, "k string, n long, last long")
    assert {r["k"]: (r["n"], r["last"]) for r in got.collect()} == {"hot": (n // 3 * 2, 1), "b": (n // 6, None), None: (n // 6, 3)}
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


EVENTS = "user string, seq long, action string, expr string, name string"


def random_events(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("ab"), k, rng.choice(["push"] * 6 + ["toggleFavorite", "delete", "rename"]), f"e{rng.randint(0, 12)}", rng.choice([None, " ", "nm"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_history_is_the_sequential_fold(spark, seed):
    events = random_events(seed)
    want = {}
    for user, _, action, expr, name in events:
        want[user] = history.apply_event(want.get(user, []), action, expr, name, 8)
    df = spark.createDataFrame(random.Random(9).sample(events, len(events)), EVENTS)
    got = {}
    for r in history.fold_history(df, 8).orderBy("user", "place").collect():
        got.setdefault(r["user"], []).append({"expr": r["expr"], "is_favorite": r["is_favorite"], "name": r["name"]})
    assert got == want
    pushes = df.where("action = 'push'")
    a = {(r["user"], r["place"], r["expr"]) for r in history.push_only(pushes, 8).collect()}
    assert a == {(r["user"], r["place"], r["expr"]) for r in history.fold_history(pushes, 8).collect()}


def test_history_eviction_and_display(spark):
    items = []
    for k in range(3):
        items = history.apply_event(items, "push", f"e{k}", None, 3)
        items = history.apply_event(items, "toggleFavorite", f"e{k}", None, 3)
    assert [x["expr"] for x in history.apply_event(items, "push", "new", None, 3)] == ["e0", "e1", "e2"]
    again = history.apply_event(history.apply_event(items, "rename", "e0", " N ", 3), "push", "e0", None, 3)
    assert again[-1] == {"expr": "e0", "is_favorite": True, "name": None}
    df = spark.createDataFrame([("u", 0, "a", True, "é"), ("u", 1, "b", True, "Z"), ("u", 2, "c", False, None), ("u", 3, "d", True, None), ("u", 4, "e", False, "x")], history.ITEM)
    assert [r["expr"] for r in df.orderBy(*history.display_order()).collect()] == ["a", "b", "d", "e", "c"]
    assert {r["expr"] for r in history.search(df, " Z ").collect()} == {"b"} and history.search(df, "").count() == 5


def test_history_normalised(spark):
    df = spark.createDataFrame([('"data.length"',), ('{"expr":"data","isFavorite":true,"name":"All"}',)], "t string")
    assert [tuple(r[0]) for r in df.select(history.normalised(F.col("t"))).collect()] == [("data.length", False, None), ("data", True, "All")]


def test_schema_unions_and_optional(spark):
    texts = ['{"a":1,"o":{"p":1}}', '{"a":"z","o":{"p":"x","q":[1,2]}}', '{"a":null,"l":[]}', "[[1],[2]]", "null"]
    want = None
    for parts in (1, 4):
        found = {r["path"]: (r["types"], r["n_present"], r["optional"]) for r in schema.infer(spark.createDataFrame([(t,) for t in texts], "t string").repartition(parts), "t").collect()}
        assert want is None or found == want
        want = found
    assert want["a"] == (["null", "number", "string"], 3, False) and want["o"] == (["object"], 2, True) and want["o.q"][2] and want["o.q[]"] == (["number"], 2, False)
    assert want["[][]"] == (["number"], 2, False) and want[""][0] == ["array", "null", "object"]
    kinds = spark.createDataFrame([(["null", "number"],), (["number", "string"],), ([],), (["a", "b", "c", "d"],)], "t array<string>")
    assert [r[0] for r in kinds.select(schema.effective(F.col("t"))).collect()] == ["number", "any", "null", "any"]
    assert [r[0] for r in kinds.select(schema.item_type(F.col("t"))).collect()] == ["null | number", "number | string", "any", "any"]


def test_dynamic_table(spark):
    df = spark.createDataFrame([(0, '{"a":1,"b":null}'), (1, '{"c":[1,{"x":"y"}],"a":"q,\\"r"}'), (2, "5")], "o int, t string")
    keys = present.header(df, "t", F.col("o"))
    assert keys == ["a", "b", "c"] and present.header(df, "t", F.col("o"), first=1) == ["a", "b"]
    assert [tuple(r) for r in present.dynamic_table(df, "t", keys).collect()] == [("1", "null", ""), ('q,"r', "", '[1,{"x":"y"}]'), ("", "", "")]


def test_csv_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"', "line\nbreak"), (" lead ", "", None)], "x string, y string, z string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, one_file=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert list(csv.reader(io.StringIO(text))) == [["x", "y", "z"], ["a,b", 'say "hi"', "line\nbreak"], [" lead ", "", "null"]]
    sinks.write_csv(spark.range(20).repartition(3).select("id", F.lit(None).cast("string").alias("n")), str(tmp_path / "many"))
    parts = [p.read_text().split() for p in (tmp_path / "many").glob("part-*") if p.stat().st_size]
    assert len(parts) == 3 and all(p[0] == "id,n" for p in parts)
    assert sorted(x for p in parts for x in p[1:]) == sorted(f"{k},null" for k in range(20))
    objects = spark.createDataFrame([('{"a":1.50,"b":[1,null,[2,3]]}',), ('{"b":null}',)], "t string")
    sinks.write_dynamic_csv(objects, "t", ["a", "b"], str(tmp_path / "dynamic"), one_file=True)
    sinks.write_primitives_csv(spark.range(0), "id", str(tmp_path / "none"))
    read = lambda name: "".join(p.read_text() for p in (tmp_path / name).glob("part-*"))
    assert read("dynamic") == 'a,b\n1.5,"1,,2,3"\n,null\n' and read("none") == "Value\n"


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.0), (2, "é", 0.5)], "a int, b string, c double")
    sinks.write_pretty(df, str(tmp_path / "p"))
    text = "".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))
    assert json.loads(text) == [{"a": 1, "b": None, "c": 2}, {"a": 2, "b": "é", "c": 0.5}] and '    "c": 2\n' in text
    stats = present.statistics(df).first()
    assert (stats["items"], stats["lines"], stats["chars"]) == (2, text.rstrip("\n").count("\n") + 1, len(text.rstrip("\n")))
    assert tuple(present.statistics(df.limit(0)).first())[2:] == (1, 2)
    with pytest.raises(ValueError):
        sinks.write_pretty(df, str(tmp_path / "q"), most_rows=1)
    sinks.write_json(df, str(tmp_path / "j"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert sinks.output_name("r", "csv", datetime(2024, 5, 6, 7, 8, 9, 123000)) == "r-2024-05-06T07-08-09-123Z.csv"


def test_strict_json_and_wrappers(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"items":[{"active":true,"name":"Ann7"},{"active":false,"name":"Bo"}]}')
    df = documents.records(documents.with_provenance(documents.read_json(spark, str(tmp_path / "ok.json"))).drop("file_path", "file_name", "file_dir"))
    assert [r["name"] for r in rows.filter_rows(df, F.col("active")).collect()] == ["Ann7"]
    named = documents.with_provenance(documents.read_json(spark, str(tmp_path / "ok.json"))).first()
    assert named["file_name"] == "ok.json" and named["file_dir"].endswith(tmp_path.name)
    (tmp_path / "bad.json").write_text("{'a': 1}")
    with pytest.raises(Exception, match="bad.json"):
        documents.read_json(spark, str(tmp_path / "bad.json"), schema="a int").collect()
    with pytest.raises(Exception, match="Malformed|MALFORMED|not JSON"):
        documents.read_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "l.json").write_text('{"a":1}\n{"a":null}\n{"b":"x","b":"y"}\n')
    got = documents.read_dynamic(spark, str(tmp_path / "l.json"))
    assert [r[0] for r in got.select(F.try_variant_get("value", "$.b", "string")).collect()] == [None, None, "y"]


def test_aliases_and_query_functions(spark):
    bound = documents.Sources(first=spark.range(3), data=spark.range(5))
    assert bound.primary.count() == 5 and spark.sql("select * from data").count() == 5
    for bad in ("1a", "a-b", "data"):
        with pytest.raises(ValueError):
            bound.add(bad, spark.range(1))
    bound.rebind("data", spark.range(7))
    assert bound.primary.count() == 7
    bound.remove("data")
    assert bound.primary.count() == 3 and list(bound) == ["first"]
    assert pipeline.run(bound, lambda d: d.where("id > 0")).count() == 2
    with pytest.raises(ValueError):
        pipeline.run(bound, lambda d: None)


@pytest.mark.parametrize("n, want", [(999, 1), (1000, 2), (1001, 3), (1250, 3)])
def test_chunks(spark, n, want):
    got = delivery.chunks(spark.range(n).repartition(3), [F.col("id")]).orderBy("_pos").collect()
    assert len({r["chunk"] for r in got}) == want and [r["id"] for r in got] == list(range(n))
    assert all(r["chunk_index"] <= r["_pos"] < r["chunk_end"] and r["total_items"] == n for r in got)
    assert {r["chunk"] for r in got if r["is_last"]} == {want - 1}


def test_chart_series(spark):
    df = spark.createDataFrame([(0, "Jan", 1, "2"), (1, "Feb", None, "z")], "_pos long, m string, x int, y string")
    assert [tuple(r) for r in present.chart_series(df).orderBy("_pos").collect()] == [(0, "Jan", "x", 1.0), (1, "Feb", "x", 0.0)]
    texts = df.select("_pos", "m", "y")
    assert [r["value"] for r in present.chart_series(texts).orderBy("_pos").collect()] == [2.0, 0.0]


def test_stream_delivery_equals_batch(spark, tmp_path):
    df = spark.range(1250).withColumn("v", F.col("id") * 2)
    delivery.write_chunks(df, [F.col("id")], str(tmp_path / "in"), files=3)
    source = str(tmp_path / "in" / "*")
    progress = stream_delivery.deliver(spark, source, df.schema, str(tmp_path / "out"), str(tmp_path / "check"), 1250)
    assert progress.steps[-1] == (1250, 100) and len(progress.steps) >= 3
    assert spark.read.parquet(str(tmp_path / "out")).select("id", "v").exceptAll(df).count() == 0


def test_stream_history_equals_batch(spark, tmp_path):
    events = random_events(4, 120)
    df = spark.createDataFrame(events, EVENTS)
    for k in range(3):
        df.where(f"seq >= {40 * k} and seq < {40 * k + 40}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream_history.keep_history(stream, 8).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.sql("select * from kept").collect():
        last[r["user"]] = json.loads(r["items"])
    want = {}
    for user, _, action, expr, name in events:
        want[user] = history.apply_event(want.get(user, []), action, expr, name, 8)
    assert last == want
