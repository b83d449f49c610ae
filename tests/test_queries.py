"""Every relational query against its SQL, and the streaming form against the batch one."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import impact, storage, traverse
from strandgraph.plans import applied, documents, relational, sources
from strandgraph.streaming import changes

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: "" if v is None or v != v else (float(v) if isinstance(v, float) else str(v))
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", [*relational.QUERIES, *applied.QUERIES, *documents.QUERIES, *sources.QUERIES])
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    queries, sql = relational.QUERIES | applied.QUERIES | documents.QUERIES | sources.QUERIES, relational.SQL | applied.SQL | documents.SQL | sources.SQL
    got, want = queries[name](spark, DATA).toPandas(), con.sql(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(math.isclose(x, y) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_replacements_of_a_record_with_two_names(spark, tmp_path):
    """Supplier 204 is SPEC-Q-204 to itself and SPEC-N-204 to 202, which it replaces."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(202, 1, "a"), (204, 1, "b")], "s_suppkey long, s_nationkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got, want = applied.QUERIES["e44_replacements"](spark, str(tmp_path)).toPandas(), con.sql(applied.SQL["e44_replacements"]).df()
    assert rows(got) == rows(want) and len(got) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_facts_that_are_read_again_are_written_once(spark):
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(applied.facts(spark, DATA)[1])
    assert not any("Join" in plan(x) or "Window" in plan(x) or "Relation" in plan(x) for x in applied.traced(spark, DATA).values())


@pytest.fixture
def written(monkeypatch):
    """The columns of everything that a query writes to the checkpoint folder."""
    found = []
    for module in (applied, impact, traverse):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda frame, write=storage.cut: (found.append(frame.columns), write(frame))[1])
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_review_queue_moves_no_more_than_ids(spark, written):
    plan = applied.QUERIES["e17_review_queue"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert written and all(set(columns) <= {"_bucket", "n", "id"} for columns in written)
    assert "Window" not in plan and "collect_" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_dossiers_deal_facts_once(spark, written):
    """Facts are not written; occurrences and relations are shuffled once; lists of the same rows are made together."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = sources.QUERIES["g10_dossiers"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert written and all(set(columns) <= {"_bucket", "n", "id"} for columns in written)
    dealt = [x for x in made.split("\n") if "Exchange hashpartitioning(" in x]
    assert not any("_base#" in x or "src#" in x and "root_id#" in x for x in dealt) and made.count("ObjectHashAggregate(") <= 6


def test_stream(spark, tmp_path):
    data = spark.createDataFrame([("a", 0), ("a", 100), ("b", 400)], "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    data.write.parquet(str(tmp_path / "in"))
    relations = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "src string, dst string")
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = changes.touched(stream, relations).writeStream.outputMode("complete").format("memory").queryName("touched").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.window.start.minute, r.id, r.n) for r in spark.table("touched").collect())
    assert got == [(0, "x", 2), (0, "y", 2), (5, "x", 1)]
