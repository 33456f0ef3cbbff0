"""What the review of round 3 found."""

from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq

from plumbline.functions import text as tx
from plumbline.operators import evidence as ev
from plumbline.operators import identifiers
from plumbline.operators import stats as ss
from plumbline.plans import catalogue

from .oracle import rows_of_spark, rows_of_sql


def with_tables(sf, folder, **tables):
    """A copy of the tables `sf` by links, but for some of their own."""
    import os

    folder.mkdir()
    for t in os.listdir(sf):
        if t.split(".")[0] not in tables:
            os.symlink(f"{sf}/{t}", f"{folder}/{t}")
    for name, rows in tables.items():
        pq.write_table(rows, f"{folder}/{name}.parquet")
    return str(folder)


def test_permutation_plan_has_each_step_once(spark):
    """shuffles are made and read once each; no join doubles the plan, and no orders pass through the driver."""
    df = spark.createDataFrame([("f", f"p{i}", "ab"[i % 2], 0, i % 3 == 0) for i in range(60)], "family string, project string, grp string, check_id int, positive boolean")
    plan = ss.permutation_test(df, "s", 2000)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("MapInPandas" in x or "MapInArrow" in x for x in plan) == 2
    assert not [x for x in plan if "BroadcastHashJoin" in x and "block#" in x]


def test_gate_of_large_keys(spark, sf, tmp_path):
    """The sum of keys leaves 64 bits."""
    li = pq.read_table(f"{sf}/lineitem.parquet")
    at = li.schema.get_field_index("l_suppkey")
    folder = with_tables(sf, tmp_path / "sf", lineitem=li.set_column(at, "l_suppkey", pa.array([x + (1 << 61) for x in li["l_suppkey"].to_pylist()], pa.int64())))
    for name in ("gate_report", "method_view", "publishable_checks", "published_decisions", "release_input"):
        assert rows_of_spark(catalogue.QUERIES[name](spark, folder)) == rows_of_sql(catalogue.ORACLES[name], folder)


def test_upsert_of_ties(spark, sf, tmp_path):
    """F8: of a user's events of one value the first counts, as SQL meets it."""
    e = pq.read_table(f"{sf}/events.parquet")
    tied = e.set_column(e.schema.get_field_index("value"), "value", pa.array([float(int(x) // 50) for x in e["value"].to_pylist()]))
    folder = with_tables(sf, tmp_path / "sf", events=tied)
    assert rows_of_spark(catalogue.QUERIES["store_upsert"](spark, folder)) == rows_of_sql(catalogue.ORACLES["store_upsert"], folder)


def test_rolling_count_takes_running_frames(spark):
    """no frame slides, and the counts are those of all pairs."""
    import random
    from datetime import datetime, timedelta

    from plumbline.operators import jobs as jb

    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(-90, 90))) for i in range(300)] + [(300, "a", None), (301, "a", None), (302, None, datetime(2024, 1, 1))]
    df = jb.rolling_count(spark.createDataFrame(rows, "id int, k string, at timestamp"), ["k"], "at", 20)
    assert "RangeFrame, -" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.recent for r in df.collect()}
    for i, k, t in rows[:300]:
        assert got[i] == sum(k == x and u is not None and timedelta() < t - u < timedelta(seconds=20) for _, x, u in rows)
    assert got[300] == got[301] == 2 and got[302] == 0


def test_codings_move_once(spark, sf):
    """One exchange for both aggregations of codings, and states are computed once for all that read them."""
    from plumbline.operators.states import merge_chunks
    from plumbline.plans import shims

    codings = spark.createDataFrame([(1, "1", 1, "pass", ["a"])], "project long, check_id string, chunk long, state string, span_ids array<string>")
    assert merge_chunks(codings)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in shims.states(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_quotes_become_python_values_a_few_at_a_time():
    """a batch of many quotes with all their words and runs is not one list of Python values."""
    from plumbline.functions.numbers import sliced

    batch = pa.record_batch([pa.array(range(150))], ["id"])
    parts = list(sliced(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [64, 64, 22] and [x for p in parts for x in p.column("id").to_pylist()] == list(range(150))


def test_packing_streams_its_spans(spark):
    """a project is no group of one call, and a null text has no characters."""
    rows = [("a", 0, i, "x" * 30) for i in range(3)] + [("a", 1, 3, None), ("a", 1, 4, "y" * 80), ("b", 0, 0, "z" * 300), (None, 0, 0, "n"), (None, 0, 1, "n" * 100)]
    packed = ev.pack(spark.createDataFrame(rows, "project string, page_ix int, span_ix int, text string"), 100)
    assert "InPandas" not in packed._jdf.queryExecution().executedPlan().toString()
    assert {(r.project, r.span_ix): r.chunk for r in packed.collect()} == {("a", 0): 0, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("a", 4): 1, ("b", 0): 0, (None, 0): 0, (None, 1): 1}


def test_halving_reads_texts_once(spark, sf):
    """spans went through packing and were then joined with their texts, cut into spans once more."""
    plan = catalogue.QUERIES["chunk_halving"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") <= 1 and plan.count("EvalPython") == 1 and "Join" not in plan


def test_identifier_scan_looks_at_few_texts_at_once():
    """a whole batch of texts became Python values, and each identifier was a few Python objects in every worker."""
    batch = pa.record_batch([pa.array(range(300)), pa.array([f"see acme {i}" for i in range(300)])], ["file", "t"])
    shared = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    texts = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=shared), schema={"file": kind}, mapInArrow=lambda run, _: list(run(iter([batch]))))
    found = identifiers._search(texts, pa.table({"v": ["acme", "7", "acme"], "rule": ["title", "hn-id", "url"], "id": [1, 2, 3]}))
    assert len(found) == 5
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == sorted([(i, "title", 1) for i in range(300)] + [(i, "url", 3) for i in range(300)] + [(7, "hn-id", 2)])


def test_long_blocks_are_split_a_few_rows_at_a_time(spark):
    """a whole batch of texts became Python values, as blocks and as spans."""
    rows = [["aaaa bbbb", "c"], None, [], ["d. e f"]] * 50
    out = tx.split_long_udf(5).func(pa.array(rows, pa.list_(pa.string())))
    assert out.to_pylist() == [["aaaa", "bbbb", "c"], [], [], ["d.", "e f"]] * 50
