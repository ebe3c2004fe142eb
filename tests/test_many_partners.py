"""Joins whose rows meet many partners are divided among tasks, with the same pairs."""

import pytest
from pyspark.sql import functions as F

from rillbase.operators import joins
from rillbase.plans.retrieve import retrieve


@pytest.mark.parametrize("clause", ["k fn= m", "k fn= m and x fn< y", "x fn<= y", "k fn= m and k fn= y"])
def test_pairs_of_few_keys_go_to_many_tasks(spark, clause):
    n = 8000
    a = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("x")).coalesce(1)
    b = spark.range(n).select((F.col("id") % 2).alias("m"), (F.col("id") if "k fn= y" not in clause else F.col("id") % 2).alias("y")).coalesce(1)
    found = retrieve({"a": a, "b": b}, "x y", clause)
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    wanted = {"k fn= m": n * n // 2, "k fn= m and x fn< y": n * (n // 2 - 1) // 2, "x fn<= y": n * (n + 1) // 2, "k fn= m and k fn= y": n * n // 2}[clause]
    assert sum(by_task) == wanted
    assert len(by_task) > 1 and max(by_task) < 0.9 * wanted


def test_a_task_of_the_reported_queries_holds_a_part(spark, tmp_path):
    from rillbase import queries

    nation = [(i, f"n{i}", i % 5) for i in range(25)]
    spark.createDataFrame(nation, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    one = lambda n, m: spark.range(n).select("id", (F.col("id") % m).cast("int").alias("nation"), (F.hash("id") % 10000).cast("double").alias("balance"))
    one(6000, 25).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.col("nation").alias("s_nationkey"), F.col("balance").alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    customers = one(60000, 25).select(F.col("id").alias("c_custkey"), F.col("nation").alias("c_nationkey"), F.col("balance").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.QUERIES["jn_theta_residual"](spark, str(tmp_path))
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 1 and max(by_task) < 0.9 * sum(by_task)
    s, c = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("supplier", "customer"))
    assert sum(by_task) == s.join(c, (s.s_nationkey == c.c_nationkey) & (s.s_acctbal > c.c_acctbal)).count()


def test_divided_joins_give_the_same_rows(spark, monkeypatch):
    # Nulls, repeated rows, and texts that are the same number.
    a = spark.createDataFrame([(str(i % 4) if i % 3 else f"0{i % 4}", i % 7, i // 2) for i in range(40)] + [(None, 1, 1)], "k string, x int, n int")
    b = spark.createDataFrame([(i % 3, i % 5, i // 3) for i in range(30)] + [(None, 1, 1), (1, None, 2)], "m int, y int, p int")
    c = spark.createDataFrame([(i % 3, i) for i in range(9)], "z int, q int")
    clauses = ["k fn= m", "k fn= m and x fn> y", "x fn!= y", "k fn= m and x fn= y", "k fn= m and z fn= m and z fn= k", "k f= m and m fOn= z"]
    tables = lambda clause: {"a": a, "b": b, "c": c} if "z" in clause else {"a": a, "b": b}
    plain = {clause: sorted(map(str, retrieve(tables(clause), "all", clause).collect())) for clause in clauses}
    assert all(len(x) > 10 for x in plain.values())
    monkeypatch.setattr(joins, "PART_PAIRS", 8)
    monkeypatch.setattr(joins, "_mostly_single", lambda *args: False)
    for clause in clauses:
        assert sorted(map(str, retrieve(tables(clause), "all", clause).collect())) == plain[clause], clause


def test_usual_joins_are_left_alone(spark):
    folder = "/root/testdata/sf0.001"
    c, o, n = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "orders", "nation"))
    assert joins._mostly_single(c, o, ["c_custkey"], ["o_custkey"]) and joins._mostly_single(c, n, ["c_nationkey"], ["n_nationkey"])


def test_a_date_join_reads_each_date_once(spark):
    from rillbase import queries

    found = queries.QUERIES["jn_date"](spark, "/root/testdata/sf0.001")
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_" not in told  # the join takes keys that are computed already
    assert found.columns == ["event_id", "o_orderkey"] and found.count() > 0
