"""Operators on small hand-made tables: repair, gates, budgets, runs and the streaming session operator."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import gates, graph, intervals, relational
from corpusloom.streaming import sessions


def test_row_gate_lets_a_good_second_copy_through(spark):
    rows = spark.createDataFrame([(1, 0, "bad"), (1, 1, "ok"), (1, 2, "ok"), (2, 0, None)], "id int, pos int, c string")
    got = {(r["id"], r["pos"]): r["verdict"] for r in gates.row_gate(rows, ["id"], ["pos"], [(F.col("c") == "ok", "conclusion")]).collect()}
    assert got == {(1, 0): "conclusion", (1, 1): "accepted", (1, 2): "duplicate", (2, 0): "conclusion"}


def test_dealt_rows_are_judged_in_tasks_of_bounded_size(spark):
    rows = spark.range(3000).selectExpr("id DIV 3 AS k", "id % 3 AS pos")
    marks = spark.range(0, 1000, 2).selectExpr("id AS k", "true AS pending")
    items, pending = gates.dealt(rows, marks, ["k"], per_task=100)
    got = gates.row_gate(items.join(pending, "k", "left"), ["k"], ["pos"], [(F.col("pending"), "not pending"), (F.col("pos") > 0, "reason")])
    got = got.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["k"], r["pos"]): r["verdict"] for r in got} == {(k, p): "not pending" if k % 2 else ("reason", "accepted", "duplicate")[p] for k in range(1000) for p in range(3)}
    sizes = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(got) == 3000 and len(sizes) == 30 and max(sizes) < 200


def test_query_of_the_row_gate_deals_its_lines(spark, monkeypatch):
    from corpusloom.jobs import catalog

    monkeypatch.setattr(gates.dealt, "__defaults__", (500,))
    got = catalog.QUERIES["q_gate_per_row"](spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(got) > 8 and max(r["count"] for r in got) < 1000


def test_budget_keeps_the_remainder(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5)], "k string, p int, n int")
    got = sorted((r["p"], r["keep"], r["truncated"]) for r in relational.within_budget(rows, "k", ["p"], F.col("n"), 8).collect())
    assert got == [(1, 5, False), (2, 3, True)]


def test_depth_never_falls_below_zero(spark):
    row = spark.createDataFrame([("}}{{}",)], "t string").select(intervals.bracket_depth(F.col("t"), "{", "}").alias("d")).first()["d"]
    assert (row["final"], row["deepest"]) == (1, 2)


def test_runs_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x")], "k int, p int, v string")
    assert sorted((r["first"], r["last"], r["n"]) for r in intervals.runs(rows, "k", ["p"], "v", "p").collect()) == [(1, 2, 2), (3, 3, 1)]


def test_lines_and_tokens(spark):
    texts = [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb\rc", 3), (None, 0)]
    rows = spark.createDataFrame(texts, "t string, n int").select("n", S.line_count(F.col("t")).alias("c"), F.size(S.lines(F.col("t"))).alias("s")).collect()
    assert all(r["n"] == r["c"] == r["s"] for r in rows)
    assert spark.range(1).select(S.token_estimate(F.lit(10), F.lit(12)).alias("t")).first()["t"] == 4


def test_json_ladder(spark):
    replies = ['{"k": 1}', '```json\n{"k": 1,}\n```', 'so: {"k": 1} end', '﻿{"k": 1}', "none"]
    rows = spark.createDataFrame([(r,) for r in replies], "t string").select(F.from_json(S.extracted_json(F.col("t")), "k int")["k"].alias("k")).collect()
    assert [r["k"] for r in rows] == [1, 1, 1, 1, None]


def test_closure_and_groups_agree(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "e"), (2, "x", "x"), (2, "x", "y")], "m int, src string, dst string")
    wide = {(r["m"], tuple(r["members"])) for r in graph.cycles(graph.closure(edges, "m"), "m").collect()}
    assert wide == {(r["m"], tuple(r["members"])) for r in graph.module_cycles(edges, "m").collect()} == {(1, ("a", "b", "c")), (2, ("x",))}
    assert graph.closure(edges.limit(0), "m").count() == 0


def test_next_owner_equals_a_plain_walk(spark):
    import random

    r = random.Random(4)
    rows = [(k, i, r.choice([None, None, i])) for k in range(4) for i in range(60 if k else 1)] + [(9, i, None) for i in range(3)]
    table = spark.createDataFrame(rows, "k int, p int, o int")
    for tail in (False, True):
        got = {(x["k"], x["p"]): x["owner"] for x in intervals.next_owner(table, "k", ["p"], F.col("o"), tail).collect()}
        for k, i, _ in rows:
            own = [o for kk, _, o in rows if kk == k and o is not None]
            ahead = [o for o in own if o >= i]
            assert got[k, i] == (ahead[0] if ahead else own[-1] if own and tail else None)


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(u, base + datetime.timedelta(minutes=m)) for u in (1, 2) for m in (0, 10, 45, 50, 200, 600)]
    table = spark.createDataFrame(rows, "user_id int, ts timestamp")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = sessions.idle_sessions_stream(stream, "user_id", "ts", "30 minutes", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = {(r["user_id"], r["started"], r["n"]) for r in spark.table("sessions").collect()}
    whole = {(r["user_id"], r["started"], r["n"]) for r in sessions.idle_sessions(table, "user_id", "ts", "30 minutes").collect()}
    assert closed == {x for x in whole if x[1] < base + datetime.timedelta(minutes=600)} and len(whole) == 8


def test_entry_works_without_the_optional_parts(monkeypatch):
    import importlib

    import __spark_entry__ as entry
    from corpusloom.jobs import catalog

    def missing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert entry.queries() == catalog.QUERIES and entry.oracle_sql() == catalog.ORACLES

    def broken(name):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    try:
        entry.queries()
    except ModuleNotFoundError:
        return
    raise AssertionError("another missing module must not be hidden")


def test_a_scope_removes_what_was_staged_inside(spark, tmp_path):
    import os

    from corpusloom.sources import staging

    kept = staging.staged(spark.range(3), "kept")
    with staging.scope(spark):
        inner = staging.shared_folder(spark)
        table = staging.staged(spark.range(5), "inside")
        with staging.scope(spark):
            staging.staged(spark.range(2), "deeper")
        assert table.count() == 5 and os.path.isdir(os.path.dirname(inner))
    assert not os.path.isdir(os.path.dirname(inner)) and kept.count() == 3
    with pytest.raises(ZeroDivisionError), staging.scope(spark):
        staging.staged(spark.range(2), "inside")
        raise ZeroDivisionError
    assert "scope-" not in staging.shared_folder(spark)


def test_staged_tables_need_a_shared_folder(spark, monkeypatch):
    import os

    import pytest

    from corpusloom.sources import staging

    root = spark.conf.get("spark.checkpoint.dir")
    table = staging.staged(spark.range(3))
    assert table.count() == 3 and os.listdir(root)

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        sparkContext = spark.sparkContext

        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(ValueError):
        staging.shared_folder(Session("spark://host:7077"))
    assert staging.shared_folder(Session("local[2]")) != staging.shared_folder(Session("local[2]"))
    mine = staging._own(spark)
    staging.clear(spark)
    assert not os.path.exists(mine.removeprefix("file:"))
