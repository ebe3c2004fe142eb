"""Small worked examples with known outputs, and edge cases of the typed conversions."""

import pytest
from pyspark.sql import functions as F

from rillbase.functions import scalar, typed
from rillbase.operators import aggregates, joins, sorting, tables, validation
from rillbase.plans import where
from rillbase.plans.retrieve import retrieve, select_where
from rillbase.sources import flatfile, reports
from rillbase.sources.descriptor import read_descriptor, split_inline, write_descriptor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def suppliers(spark):
    s = spark.createDataFrame([("s1", "smith", "london"), ("s2", "jones", "paris"), ("s3", "blake", "paris")], "snumber string, sname string, city string")
    sp = spark.createDataFrame([("s1", "p1", "300"), ("s1", "p2", "200"), ("s1", "p3", "400"), ("s2", "p1", "100"), ("s2", "p2", "200")], "snumber string, pnumber string, qty string")
    return s, sp


@pytest.fixture(scope="module")
def inventory(spark):
    data = [("s1", "p1", "300", ".25"), ("s1", "p2", "200", ".30"), ("s1", "p3", "400", ".35"), ("s2", "p1", "100", ".23"), ("s2", "p2", "200", ".32"), ("s3", "p1", "300", ".24")]
    return scalar.compute(spark.createDataFrame(data, "snumber string, pnumber string, qty string, price string"), "%.2f", total="qty * price")


def test_joins(suppliers):
    s, sp = suppliers
    five = [("s1", "smith", "london", "p1", "300"), ("s1", "smith", "london", "p2", "200"), ("s1", "smith", "london", "p3", "400"), ("s2", "jones", "paris", "p1", "100"), ("s2", "jones", "paris", "p2", "200")]
    assert rows(joins.equi_join(s, sp, "snumber")) == five
    assert rows(joins.outer_join(s, sp, "snumber")) == [*five, ("s3", "blake", "paris", "", "")]
    assert rows(joins.set_difference(s, sp, "snumber")) == [("s3", "blake", "paris")]


def test_compute_and_distributions(inventory):
    assert [r.total for r in inventory.orderBy("snumber", "pnumber").collect()] == ["75.00", "60.00", "140.00", "23.00", "64.00", "72.00"]
    assert rows(aggregates.tally(inventory, "pnumber", total=True)) == [("TOTAL", 6), ("p1", 3), ("p2", 2), ("p3", 1)]
    assert rows(aggregates.distribution(inventory, "qty", "pnumber")) == [("p1", 700.0, 3), ("p2", 400.0, 2), ("p3", 400.0, 1)]
    assert rows(aggregates.cross_tally(inventory, "pnumber", "snumber", total=True)) == [("TOTAL", 3, 2, 1), ("p1", 1, 1, 1), ("p2", 1, 1, 0), ("p3", 1, 0, 0)]
    assert rows(aggregates.cross_sum(inventory, "qty", "pnumber", "snumber", missing="-")) == [("p1", "300", "100", "300"), ("p2", "200", "200", "-"), ("p3", "400", "-", "-")]


def test_statistics(inventory):
    got = {r.aname: [round(x, 2) for x in r[1:]] for r in aggregates.statistics(select_where(inventory, "pnumber leq p1"), "qty", "price", "total").collect()}
    assert got == {"qty": [700, 3, 233.33, 100, 300, 94.28], "price": [0.72, 3, 0.24, 0.23, 0.25, 0.01], "total": [170, 3, 56.67, 23, 75, 23.84]}


def test_merge_and_back(spark):
    df = spark.createDataFrame([("A", "Child 1", 1), ("A", "Child 2", 2), ("A", "Child 3", 3), ("B", "Child 1", 4), ("B", "Child 2", 5)], "parent string, child string, n int")
    merged = aggregates.merge_values(df, "child", "n")
    assert rows(merged) == [("A", "Child 1,Child 2,Child 3"), ("B", "Child 1,Child 2")]
    assert rows(aggregates.unmerge_values(merged, "child")) == rows(df.drop("n"))
    lists = spark.createDataFrame([("a,b,c",), ("a,",), (",a",), ("",)], "v string")
    assert rows(aggregates.unmerge_values(lists, "v")) == [("",), ("",), ("a",), ("a",), ("a",), ("b",), ("c",)]


def test_numbers(spark):
    df = spark.createDataFrame([("",), ("12abc",), ("zz",), (" +7",), ("-.5",), ("1e3",), (None,)], "v string")
    assert [r[0] for r in df.select(typed.atof(F.col("v"))).collect()] == [0, 12, 0, 7, -0.5, 1000, 0]
    assert [r[0] for r in df.select(typed.strict_number(F.col("v"))).collect()] == [0, 12, None, 7, -0.5, 1000, 0]
    hexes = spark.createDataFrame([("ff",), ("",), ("ffffffff",), ("0x1F",)], "v string")
    assert [r[0] for r in hexes.select(typed.based(F.col("v"), 16)).collect()] == [255, 0, -1, 31]
    assert spark.range(1).select(typed.based(F.lit("102"), 2)).first()[0] == 2


def test_dates(spark):
    key = lambda y, m, d, s=0: ((y * 12 + m - 1) * 31 + d - 1) * 86400 + s
    cases = {
        "2/31/99": key(1999, 2, 31), "02-29-2000": key(2000, 2, 29), "31.12.99 23.59": key(1999, 12, 31, 86340), "991231": key(1999, 12, 31), "19991231235959": key(1999, 12, 31, 86399),
        "0/1/99": None, "13/1/99": None, "1/1/65": key(1965, 1, 1), "1/1/64": key(2064, 1, 1), "12/31/1999 1:02:03": key(1999, 12, 31, 3723), "991231 235959": key(1999, 12, 31, 86399), "x": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.k for r in df.select("v", typed.date_key(F.col("v")).alias("k")).collect()} == cases


def test_patterns():
    assert typed.java_pattern("a|b?") == r"a\|b\?"
    assert typed.java_pattern("^a^b$c$") == r"^a\^b\$c$"
    assert typed.java_pattern("([a-z]+)$0x") == "([a-z]+)x"
    assert typed.basic_pattern(r"\(ab\)\{2\}+(") == r"(ab){2}\+\("


def test_where_trees():
    tree = where.parse("! a = 1 and b = 2 or c = 3 else d = 4")
    assert isinstance(tree, where.Or) and isinstance(tree.parts[0], where.And) and isinstance(tree.parts[0].parts[0], where.Not) and isinstance(tree.parts[1], where.Else)
    assert where.parse(["a", "in", "x,y"]).groups == (("x",), ("y",))
    assert where.parse("a,b in (1),(2,3)").groups == (("1", ""), ("2", "3"))
    with pytest.raises(ValueError):
        where.parse("a = ")
    with pytest.raises(ValueError):
        where.parse("- ( a = 1 or b = 2 )")


def test_outer_joins_and_blanks(suppliers):
    s, sp = suppliers
    left = retrieve({"s": s, "sp": sp}, "s.snumber pnumber", "s.snumber fO= sp.snumber and qty gt 250", blanks=True)
    assert rows(left) == [("s1", "p1"), ("s1", "p3"), ("s2", ""), ("s3", "")]
    both = retrieve({"s": s, "sp": sp}, ["s.snumber as a", "sp.snumber as b"], "s.snumber fo= sp.snumber and s.snumber gt 0 and sname = smith")
    assert len(rows(retrieve({"s": s}, "snumber", "rec# le 2", record_order={"s": ("snumber",)}))) == 2
    assert both.columns == ["a", "b"]


def test_empty_tables(spark, suppliers):
    s, sp = suppliers
    none = sp.limit(0)
    assert rows(retrieve({"s": s, "sp": none}, "sname", "s.snumber f-= sp.snumber")) == [("blake",), ("jones",), ("smith",)]
    assert rows(joins.pattern_join(none.select("snumber", "qty"), s, "qty", "city")) == []
    assert rows(aggregates.statistics(none, "qty")) == [("qty", 0.0, 0, 0.0, 0.0, 0.0, 0.0)]
    assert sorting.is_sorted(none, "snumber", "qty").first().is_sorted


def test_alter_errors(spark, suppliers):
    s, sp = suppliers
    with pytest.raises(ValueError):
        tables.alter(sp, [("qty", "/=", "0")])
    with pytest.raises(Exception, match="several values"):
        tables.alter_from(s, sp, ["snumber"], {"city": "qty"}).collect()
    assert rows(tables.alter(sp, [("qty", "*=", "2")], "pnumber = p1").where("pnumber = 'p1'")) == [("s1", "p1", "600"), ("s2", "p1", "200")]


def test_difference_of_a_table_with_itself(suppliers):
    s, _ = suppliers
    assert rows(tables.difference(s, s, ["snumber"])) == []


def test_overwrite_and_save(spark, suppliers, tmp_path):
    s, _ = suppliers
    place = f"file://{tmp_path}/s"
    tables.save(s, place)
    with pytest.raises(Exception):
        tables.save(s, place)
    tables.save(s, place, onto=True)
    tables.overwrite(spark, tables.delete(spark.read.parquet(place), "city = paris"), place)
    assert rows(spark.read.parquet(place)) == [("s1", "smith", "london")] * 2


def test_flat_files(spark, suppliers, tmp_path):
    text = "snumber\tt:\tl4\nsname\tw6\tl6\ncity\tt\\n\tL0\tCITY\n"
    d = read_descriptor(text)
    assert d.shown() == ["snumber", "sname"]
    assert read_descriptor(write_descriptor(d)).names == d.names
    s, _ = suppliers
    odd = s.unionByName(spark.createDataFrame([("a:b\\", "x", "")], s.schema))
    flatfile.write_table(odd, f"file://{tmp_path}/flat", d, compression="gzip")
    back = flatfile.read_table(spark, f"file://{tmp_path}/flat", d, "fail")
    assert rows(back.select("snumber", F.rtrim("sname"), "city")) == rows(odd)
    (tmp_path / "inline").write_text("%description\n" + text + "%enddescription\ns9:smithxrome\nbroken\n")
    assert rows(flatfile.read_inline(spark, f"file://{tmp_path}/inline")) == [("s9", "smithx", "rome")]
    assert split_inline((tmp_path / "inline").read_text())[1] == "s9:smithxrome\nbroken\n"
    assert validation.structural_errors(flatfile.read_inline(spark, f"file://{tmp_path}/inline", "permissive")).first().errors == 1
    with pytest.raises(Exception, match="malformed"):
        flatfile.read_inline(spark, f"file://{tmp_path}/inline", "fail").collect()


def test_validation_of_accounts(spark):
    data = [("root", "x", "0", "0", "/", ""), ("s", "", "12", "1", "/u", "/bin/rsh"), ("bad", "", "x1", "1", "", "/bin/sh"), ("toolonglogin", "x", "123456", "9", "/", "")]
    df = spark.createDataFrame(data, "login string, passwd string, uid string, gid string, home string, shell string")
    script = """
login % ".{3,8}" : badlogin
passwd == ""
    shell == "/bin/rsh" | shell == "/bin/uname" | shell == "/bin/sync" : nopasswd
uid % "[0-9]{1,5}" : baduid
gid % "[0-9]{1,5}" : badgid
home != "" : badhome
"""
    assert rows(validation.validate(df, script, ["login"])) == [("bad", "badhome"), ("bad", "baduid"), ("bad", "nopasswd"), ("s", "badlogin"), ("toolonglogin", "badlogin"), ("toolonglogin", "baduid")]


def test_reports(spark, suppliers):
    s, sp = suppliers
    assert reports.table_report(s.orderBy("snumber").limit(1)).splitlines()[2].split() == ["s1", "smith", "london"]
    packets = tables.to_packets(sp, ("snumber", "pnumber"))
    assert rows(packets.where("packet = 1")) == [(1, "pnumber", "p1"), (1, "qty", "300"), (1, "snumber", "s1")]
    assert rows(tables.from_packets(packets, sp.columns).drop("packet")) == rows(sp)


def test_stream(spark, suppliers, tmp_path):
    from rillbase.streaming.rows import compute_stream, select_stream

    s, sp = suppliers
    sp.write.parquet(f"{tmp_path}/in")
    stream = compute_stream(select_stream(spark.readStream.schema(sp.schema).parquet(f"{tmp_path}/in"), "qty gt 250"), "%.0f", qty="qty + 1")
    q = stream.writeStream.format("memory").queryName("big").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("big")) == [("s1", "p1", "301"), ("s1", "p3", "401")]
    with pytest.raises(ValueError):
        select_stream(sp, "qty = 1 else qty = 2")
