"""Every registered query that has SQL, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docframe.operators import present
from tests.compare import connect, difference

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(k for k in ORACLES if not k.startswith("op")))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) is None


def test_queries_without_sql_run(spark, sf_dir):
    for name, query in entry.queries().items():
        if name not in ORACLES and not name.startswith(("op", "pipeline")):
            assert query(spark, sf_dir).count() > 0, name


@pytest.mark.parametrize("ks", [(43, 2, 3), (1, 9, 4), (1, 5), ()])
def test_csv_of_objects_keeps_its_columns_in_place(spark, tmp_path, ks):
    """the first event lacks the key k and a later one has it, with a value or with null; no event has it; no events."""
    con, path = duckdb.connect(), str(tmp_path / "events.parquet")
    rows = [(n, ("error", "view")[n % 2], f'{{"k": {k}}}') for n, k in enumerate(ks)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(path)
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert difference(entry.queries()["sink_csv_dynamic"](spark, str(tmp_path)), con, ORACLES["sink_csv_dynamic"]) is None


def test_known_keys_come_first(spark):
    df = spark.createDataFrame([(0, '{"z":1,"b":2}'), (1, '{"a":3,"y":4}')], "o int, t string")
    assert present.header(df, "t", F.col("o"), known=("a", "b", "c")) == ["a", "b", "c", "z", "y"]
    assert present.header(df, "t", F.col("o"), first=1, known=("c",)) == ["c", "z", "b"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["_pos", "label", "series", "value"]
