"""Queries and readers see every row that they should."""

from rillbase import queries
from rillbase.sources import flatfile

FOLDER = "/root/testdata/sf0.001"


def test_compute_covers_the_whole_table(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    found = queries.QUERIES["fn_compute"](spark, FOLDER).select("l_orderkey", "l_linenumber")
    assert sorted(found.collect()) == sorted(lines.collect())


def test_date_join_takes_all_users(spark):
    found = queries.QUERIES["jn_date"](spark, FOLDER).select("event_id").distinct()
    users = spark.read.parquet(f"{FOLDER}/events.parquet").join(found, "event_id").agg({"user_id": "max"}).first()[0]
    assert users >= 5


def test_a_record_like_a_line_of_the_description_stays(spark, tmp_path):
    head = ["%description", "name\tt:", "city\tt\\n", "%enddescription"]
    (tmp_path / "inline").write_text("\n".join([*head, "x:rome", head[1], "%enddescription", "x:oslo"]) + "\n")
    found = flatfile.read_inline(spark, f"file://{tmp_path}/inline", "permissive")
    assert sorted((r.name, r.city, r._malformed) for r in found.collect()) == [("", "", True), ("name\tt", "", False), ("x", "oslo", False), ("x", "rome", False)]


def test_packets_keep_line_ends(spark, tmp_path):
    from rillbase.operators import tables

    rows = spark.createDataFrame([(1, "a", "one\ntwo"), (1, "b", ""), (2, "a", "x\ty")], "packet long, name string, value string")
    tables.packet_text(rows).coalesce(1).write.text(f"file://{tmp_path}/p")
    assert sorted(map(tuple, tables.read_packets(spark, f"file://{tmp_path}/p").collect())) == [(1, "a", "one\ntwo"), (1, "b", ""), (2, "a", "x\ty")]


def test_seek_is_refused_by_name(spark):
    import pytest

    from rillbase.plans.retrieve import retrieve

    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="seek#"):
        retrieve({"t": df}, "a", "seek# gt 3")


def test_merges_count_their_rows(spark):
    import pytest

    from rillbase.operators import tables

    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert tables.ordered_merge(df, df.limit(1), ["k"], "replace", exactly=1).count() == 2
    for call in (lambda: tables.ordered_merge(df, df, ["k"], exactly=1), lambda: tables.merge_by_record(df, df.withColumn("at", df.k), ("k:numeric",), "at", exactly=3)):
        with pytest.raises(ValueError):
            call()
    assert [r["rec#"] for r in tables.merge_by_record(df, df.withColumn("at", df.k + 5), ("k:numeric",), "at").orderBy("rec#").collect()] == [1, 2, 3, 4]
