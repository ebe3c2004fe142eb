"""Registered queries over the relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillbase.functions import scalar, typed
from rillbase.operators import aggregates, joins, sorting, tables, validation
from rillbase.plans.retrieve import Prepared, exists, retrieve, select_where
from rillbase.sources import flatfile, reports
from rillbase.sources.descriptor import read_descriptor
from rillbase.storage import shared_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute; each reads its Parquet file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        QUERIES[key].__doc__ = function.__doc__
        ORACLE_SQL[key] = sql
        return function

    return register


def where_query(name: str, table: str, select: str, clause: str, sql_where: str, **options) -> None:
    """A selection from one table."""

    def run(t: Tables) -> DataFrame:
        return retrieve({table: getattr(t, table)}, select, clause, **options)

    query(f"SELECT {', '.join(select.split())} FROM {table} WHERE {sql_where}", name)(run)


@query("""SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
          WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000""")
def flagship(t: Tables) -> DataFrame:
    return retrieve(
        {"customer": t.customer, "orders": t.orders}, "customer.c_name orders.o_orderkey orders.o_totalprice",
        "customer.c_mktsegment = BUILDING and orders.o_totalprice gt 1000 and customer.c_custkey fn= orders.o_custkey",
        sorted_by="o_totalprice:numeric:descending o_orderkey:numeric",
    )


# Predicates

where_query("fl_lexical", "customer", "c_custkey c_mktsegment", "c_mktsegment >= F", "c_mktsegment >= 'F'")
where_query("fl_lexical_ops", "customer", "c_custkey c_mktsegment", "c_mktsegment lgt BUILDING and c_mktsegment llt MACHINERY and c_mktsegment lne FURNITURE", "c_mktsegment > 'BUILDING' AND c_mktsegment < 'MACHINERY' AND c_mktsegment <> 'FURNITURE'")
where_query("fl_numeric", "orders", "o_orderkey o_totalprice", "o_totalprice gt 5000", "o_totalprice > 5000")
where_query("fl_numeric_ops", "part", "p_partkey p_size", "p_size nge 10 and p_size n<= 20 and p_size ne 15", "p_size >= 10 AND p_size <= 20 AND p_size <> 15")
where_query("fl_lexical_number", "part", "p_partkey p_size", "p_size < 2", "CAST(p_size AS VARCHAR) < '2'")
where_query("fl_caseless", "customer", "c_custkey c_mktsegment", "c_mktsegment ceq building", "upper(c_mktsegment) = upper('building')")
where_query("fl_caseless_global", "customer", "c_custkey c_mktsegment", "c_mktsegment = building", "upper(c_mktsegment) = upper('building')", caseless=True)
where_query("fl_length", "part", "p_partkey p_name", "p_name:length gt 10", "strlen(p_name) > 10")
where_query("fl_regex", "part", "p_partkey p_name", "p_name ~ '^(s|b)'", "contains(p_name, '(s|b)') AND false")
where_query("fl_regex_repeat", "part", "p_partkey p_name", "p_name ~ 'b.*l[eo]*.* [a-w]'", "regexp_matches(p_name, 'b.*l[eo]*.* [a-w]')")
where_query("fl_regex_plain", "part", "p_partkey p_name", "p_name ~ '^s[a-m]' and p_name !~ 'bolt$'", "regexp_matches(p_name, '^s[a-m]') AND NOT regexp_matches(p_name, 'bolt$')")
where_query("fl_regex_ci", "part", "p_partkey p_name", "p_name rceq 'RING$'", "regexp_matches(p_name, 'RING$', 'i')")
where_query("fl_date", "orders", "o_orderkey", "o_orderdate d>= 6/1/1998 and o_orderdate dlt 19990101", "o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
where_query("fl_date_time", "events", "event_id", "ts d< '1/2/2024 12:30:15'", "date_trunc('second', ts) < TIMESTAMP '2024-01-02 12:30:15'")
where_query("fl_date_only", "events", "event_id", "ts Deq 15.1.2024", "CAST(ts AS DATE) = DATE '2024-01-15'")
where_query("fl_in", "customer", "c_custkey c_mktsegment", "c_mktsegment in BUILDING,MACHINERY", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
where_query("fl_in_number", "part", "p_partkey p_size", "p_size nin 1,7.0,49", "p_size IN (1, 7, 49)")
where_query("fl_in_regex", "part", "p_partkey p_name", "p_name rin ^red,^blue", "regexp_matches(p_name, '^red') OR regexp_matches(p_name, '^blue')")
where_query("fl_not_in", "customer", "c_custkey c_mktsegment", "c_mktsegment !in BUILDING,MACHINERY", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
where_query("fl_in_multi", "orders", "o_orderkey", "o_orderstatus,o_orderpriority in (P,5-LOW),(O,1-URGENT)", "(o_orderstatus, o_orderpriority) IN (('P', '5-LOW'), ('O', '1-URGENT'))")
where_query("fl_field", "lineitem", "l_orderkey l_linenumber l_discount l_tax", "l_discount fn> l_tax", "l_discount > l_tax")
where_query("fl_bool", "part", "p_partkey", "( p_size lt 5 or p_size gt 45 ) and p_type = PROMO", "(p_size < 5 OR p_size > 45) AND p_type = 'PROMO'")
where_query("fl_precedence", "part", "p_partkey", "p_size lt 5 or p_size gt 45 and p_type = PROMO", "p_size < 5 OR (p_size > 45 AND p_type = 'PROMO')")
where_query("fl_not", "part", "p_partkey", "! ( p_size lt 30 or p_type = PROMO )", "NOT (p_size < 30 OR p_type = 'PROMO')")
where_query("fl_minus", "customer", "c_custkey", "- c_mktsegment = BUILDING", "c_mktsegment <> 'BUILDING'")
where_query("fl_else_left", "customer", "c_custkey c_mktsegment", "c_mktsegment = BUILDING else c_mktsegment = MACHINERY", "c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND NOT (SELECT bool_or(c_mktsegment = 'BUILDING') FROM customer))")
where_query("fl_else_right", "customer", "c_custkey c_mktsegment", "c_mktsegment = NOWHERE else c_mktsegment = MACHINERY", "c_mktsegment = 'NOWHERE' OR (c_mktsegment = 'MACHINERY' AND NOT (SELECT bool_or(c_mktsegment = 'NOWHERE') FROM customer))")
where_query("fl_else_nested", "customer", "c_custkey c_mktsegment", "c_mktsegment = NOWHERE else c_mktsegment = NEVER else c_mktsegment = MACHINERY", "c_mktsegment = 'MACHINERY'")
where_query("fl_else_after", "customer", "c_custkey", "c_nationkey eq 3 and ( c_acctbal gt 9000 else c_acctbal gt 5000 else c_acctbal gt 0 )",
            "c_nationkey = 3 AND c_acctbal > (SELECT CASE WHEN max(c_acctbal) > 9000 THEN 9000 WHEN max(c_acctbal) > 5000 THEN 5000 ELSE 0 END FROM customer WHERE c_nationkey = 3)")
where_query("fl_not_else", "customer", "c_custkey", "! ( c_mktsegment = BUILDING else c_mktsegment = MACHINERY )", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")


@query("SELECT p_partkey, p_brand FROM part WHERE TRY_CAST(substr(p_brand, 7) AS DOUBLE) > 10")
def fl_numeric_prefix(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_brand", F.concat(F.lit(" "), F.substring("p_brand", 7, 9), F.lit("kg")).alias("amount"))
    return select_where(df, "amount gt 10").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 16 AND p_size < 32")
def fl_base(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.hex("p_size").alias("h"), F.bin("p_size").alias("b"), F.conv(F.col("p_size").cast("string"), 10, 8).alias("o"))
    return select_where(df, "h:hex ge 0x10 and b:binary lt 100000 and o:octal lt 40").select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1997-02-28' AND o_orderdate <= DATE '1997-03-31'")
def fl_date_text(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "M/d/yy").alias("day"))
    return select_where(df, "day d> 2/31/97 and day d<= 31.3.1997").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def fl_date_invalid(t: Tables) -> DataFrame:
    """What is no date meets no comparison, not even a negated one, but is in no list."""
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"))
    known = select_where(df, "day d>= 1/1/1900 or ! day d>= 1/1/1900").select("o_orderkey")
    return joins.set_difference(select_where(df, "day d!in 1/1/1899").select("o_orderkey"), known, "o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rec FROM part QUALIFY rec BETWEEN 11 AND 20")
def fl_recno(t: Tables) -> DataFrame:
    return retrieve({"part": t.part}, "p_partkey rec# as rec", "rec# gt 10 and rec# le 20", record_order={"part": ("p_partkey:numeric",)})


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000
          UNION ALL SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 300000""")
def or_two_tables(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer, "orders": t.orders}, "c_custkey o_orderkey", "c_custkey fn= o_custkey and o_totalprice gt 300000 and ( c_mktsegment = BUILDING or o_orderstatus = P )")


@query("""SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE (n_name = 'NATION_1' AND r_name = 'AMERICA')
          UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_2' AND r_name = 'ASIA'""")
def fl_in_two_tables(t: Tables) -> DataFrame:
    return retrieve({"nation": t.nation, "region": t.region}, "n_name r_name", "n_regionkey fn= r_regionkey and n_name,r_name in (NATION_1,AMERICA),(NATION_2,ASIA)")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 400000")
def prepared_query(t: Tables) -> DataFrame:
    """A query whose constants are given when it runs."""
    q = Prepared("c_custkey o_orderkey", "c_custkey fn= o_custkey and c_mktsegment = $segment and o_totalprice gt $least")
    return q.run({"customer": t.customer, "orders": t.orders}, segment="MACHINERY", least=400000)


# Projection


@query("SELECT c_name AS name, 'x' AS kind, c_custkey FROM customer")
def pr_rename_constant(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer}, ["c_name as name", "kind:value=x", "c_custkey"])


@query("SELECT * EXCLUDE (p_retailprice, p_type) FROM part")
def pr_all_except(t: Tables) -> DataFrame:
    return retrieve({"part": t.part}, "all:nodisplay=p_retailprice,p_type")


@query("SELECT p_name FROM part ORDER BY p_size, p_partkey LIMIT 5")
def pr_hidden_sort(t: Tables) -> DataFrame:
    return retrieve({"part": t.part}, "p_name p_size:numeric:nodisplay", sorted_by="p_size:numeric p_partkey:numeric", limit=5)


@query("SELECT rpad(substr(p_name, 1, 6), 6, ' ') AS p_name, lpad(substr(CAST(p_size AS VARCHAR), 1, 4), 4, ' ') AS p_size, '' AS note FROM part")
def pr_fit(t: Tables) -> DataFrame:
    shape = read_descriptor("p_name\tw6\tl6\np_size\tw4\tr4\nnote\tt\\n\tl12\n")
    return tables.fit_to(t.part, shape.schema())


# Joins


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn_inner(t: Tables) -> DataFrame:
    return retrieve({"supplier": t.supplier, "nation": t.nation}, "s_name n_name", "s_nationkey fn= n_nationkey")


@query("""SELECT a.l_orderkey AS l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
          WHERE a.l_quantity > 45 AND b.l_quantity < 5 GROUP BY a.l_orderkey""")
def jn_multikey(t: Tables) -> DataFrame:
    li = t.lineitem
    pairs = retrieve([("a", li), ("b", li)], "1.l_orderkey", "1.l_partkey fn= 2.l_partkey and 1.l_suppkey fn= 2.l_suppkey and 1.l_quantity gt 45 and 2.l_quantity lt 5")
    return aggregates.tally(pairs, "l_orderkey").withColumnRenamed("count", "n")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal WHERE c_mktsegment = 'BUILDING'")
def jn_theta_residual(t: Tables) -> DataFrame:
    return retrieve({"supplier": t.supplier, "customer": t.customer}, "s_suppkey c_custkey", "s_nationkey fn= c_nationkey and s_acctbal fn> c_acctbal and c_mktsegment = BUILDING")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON upper(replace(c_name, 'Customer', 'X')) = upper(replace(s_name, 'Supplier', 'x'))")
def jn_caseless(t: Tables) -> DataFrame:
    a = t.customer.withColumn("k", F.replace("c_name", F.lit("Customer"), F.lit("X")))
    b = t.supplier.withColumn("m", F.replace("s_name", F.lit("Supplier"), F.lit("x")))
    return retrieve({"a": a, "b": b}, "c_custkey s_suppkey", "k fc= m")


@query("""SELECT event_id, o_orderkey FROM (SELECT *, CAST(ts AS DATE) - INTERVAL 25 YEAR AS d FROM events) JOIN orders ON CAST(d AS DATE) = CAST(o_orderdate AS DATE)
          WHERE o_orderstatus = 'P'""")
def jn_date(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.date_format(F.col("ts") - F.expr("INTERVAL 25 YEAR"), "M-d-yyyy H:mm").alias("day"))
    return retrieve({"e": e, "orders": t.orders}, "event_id o_orderkey", "day fD= o_orderdate and o_orderstatus = P")


@query("SELECT a.p_partkey AS pa, b.p_partkey AS pb FROM part a JOIN part b ON a.p_retailprice < b.p_retailprice WHERE a.p_size = 1 AND b.p_size = 2")
def jn_theta(t: Tables) -> DataFrame:
    return retrieve([("a", t.part), ("b", t.part)], ["1.p_partkey as pa", "2.p_partkey as pb"], "1.p_retailprice fn< 2.p_retailprice and 1.p_size eq 1 and 2.p_size eq 2")


_SMALL = "(SELECT * FROM customer WHERE c_acctbal > 9000)"


@query(f"SELECT c_custkey, o_orderkey FROM {_SMALL} FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey")
def jn_full(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer, "orders": t.orders}, "c_custkey o_orderkey", "c_custkey fon= o_custkey and c_acctbal gt 9000 and o_totalprice gt 450000")


@query(f"SELECT c_custkey, o_orderkey FROM {_SMALL} LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey")
def jn_left(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer, "orders": t.orders}, "c_custkey o_orderkey", "c_custkey fOn= o_custkey and c_acctbal gt 9000 and o_totalprice gt 450000")


@query("SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal < 500) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON s_nationkey < n_nationkey")
def jn_theta_left(t: Tables) -> DataFrame:
    return retrieve({"supplier": t.supplier, "nation": t.nation}, "s_suppkey n_nationkey", "s_nationkey fOn< n_nationkey and s_acctbal lt 500 and n_regionkey eq 1")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def jn_anti(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer, "orders": t.orders}, "c_custkey", "c_custkey f-n= o_custkey and o_totalprice gt 400000")


@query("""SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_regionkey = 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)),
          (SELECT * FROM supplier WHERE s_acctbal > 8000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))""")
def jn_anti_both(t: Tables) -> DataFrame:
    return retrieve({"nation": t.nation, "supplier": t.supplier}, "n_name s_name", "n_nationkey f-n= s_nationkey and n_regionkey eq 0 and s_acctbal gt 8000")


@query("SELECT p_partkey FROM part a WHERE p_size = 3 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 4 AND b.p_type = 'PROMO' AND a.p_retailprice < b.p_retailprice)")
def jn_anti_theta(t: Tables) -> DataFrame:
    return retrieve([("a", t.part), ("b", t.part)], "1.p_partkey", "1.p_retailprice f-n< 2.p_retailprice and 1.p_size eq 3 and 2.p_size eq 4 and 2.p_type = PROMO")


@query("SELECT c_name, n_name, r_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON c_custkey = o_custkey WHERE r_name = 'ASIA' AND o_totalprice > 300000")
def jn_nway(t: Tables) -> DataFrame:
    return retrieve(
        {"customer": t.customer, "nation": t.nation, "region": t.region, "orders": t.orders}, "c_name n_name r_name o_orderkey",
        "c_nationkey fn= n_nationkey and n_regionkey fn= r_regionkey and c_custkey fn= o_custkey and r_name = ASIA and o_totalprice gt 300000",
    )


@query("SELECT c_custkey, s_suppkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey = c_nationkey WHERE c_acctbal > 9000")
def jn_cyclic(t: Tables) -> DataFrame:
    return retrieve({"customer": t.customer, "nation": t.nation, "supplier": t.supplier}, "c_custkey s_suppkey n_name", "c_nationkey fn= n_nationkey and s_nationkey fn= n_nationkey and s_nationkey fn= c_nationkey and c_acctbal gt 9000")


@query("SELECT r_name, n_name FROM region, nation")
def jn_cross(t: Tables) -> DataFrame:
    return retrieve({"region": t.region, "nation": t.nation}, "r_name n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def jn_self(t: Tables) -> DataFrame:
    return retrieve([("nation", t.nation), ("nation2", t.nation)], ["1.n_name as a", "2.n_name as b"], "1.n_regionkey fn= 2.n_regionkey and 1.n_nationkey fn< 2.n_nationkey")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9900)")
def jn_exists(t: Tables) -> DataFrame:
    return retrieve({"nation": t.nation, "customer": t.customer}, "n_name", "customer.c_acctbal gt 9900")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 99999)")
def jn_exists_empty(t: Tables) -> DataFrame:
    return retrieve({"nation": t.nation, "customer": t.customer}, "n_name", "customer.c_acctbal gt 99999")


@query("SELECT n.*, s_suppkey, s_name, s_acctbal FROM nation n JOIN supplier ON n_nationkey = s_nationkey")
def jn_equi(t: Tables) -> DataFrame:
    return joins.equi_join(t.nation, t.supplier, "n_nationkey", "s_nationkey")


@query("SELECT n.*, s_suppkey, coalesce(s_name, '') AS s_name FROM nation n LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) ON n_nationkey = s_nationkey")
def jn_outer(t: Tables) -> DataFrame:
    return joins.outer_join(t.nation, select_where(t.supplier, "s_acctbal gt 8000").drop("s_acctbal"), "n_nationkey", "s_nationkey")


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def jn_setdiff(t: Tables) -> DataFrame:
    return joins.set_difference(t.nation, select_where(t.supplier, "s_acctbal gt 8000"), "n_nationkey", "s_nationkey")


_PATTERNS = [("metal", "b[a-z]*lt"), ("red", "^red"), ("five", "[a-z]{5} "), ("plus", "a+b")]


@query("""SELECT class, p_partkey, p_name FROM (VALUES ('metal', 'b[a-z]*lt'), ('red', '^red'), ('five', '[a-z]\\{5\\} '), ('plus', 'a\\+b')) AS v(class, re) JOIN part ON regexp_matches(p_name, re)""")
def jn_regjoin(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame(_PATTERNS, "class string, re string")
    return joins.pattern_join(patterns, t.part.select("p_partkey", "p_name"), "re", "p_name")


# Aggregates


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'TOTAL', count(*) FROM customer")
def ag_tally(t: Tables) -> DataFrame:
    return aggregates.tally(t.customer, "c_mktsegment", total=True)


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS total, count(*) AS count FROM lineitem GROUP BY l_returnflag""")
def ag_dist(t: Tables) -> DataFrame:
    return aggregates.distribution(t.lineitem, "l_quantity", "l_returnflag").withColumn("total", F.round("total", 2))


@query("""SELECT p_type, round(sum(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END), 2) + 0.0::DOUBLE AS total, count(*) AS count FROM part WHERE p_size % 7 <> 0 GROUP BY p_type""")
def ag_dist_text(t: Tables) -> DataFrame:
    """Empty numbers count as 0, other text leaves the row out."""
    amount = F.when(F.col("p_size") % 7 == 0, "n/a").when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(" +"), F.col("p_size").cast("string")))
    return aggregates.distribution(t.part.select("p_type", amount.alias("amount")), "amount", "p_type")


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag""")
def ag_ddist(t: Tables) -> DataFrame:
    out = aggregates.cross_sum(t.lineitem, "l_quantity", "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS v1_URGENT, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS v2_HIGH,
          count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS v3_MEDIUM, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS v4_NOT_SPECIFIED,
          count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS v5_LOW FROM (SELECT o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT 'TOTAL', o_orderpriority FROM orders) GROUP BY o_orderstatus""")
def ag_dtally(t: Tables) -> DataFrame:
    return aggregates.cross_tally(t.orders, "o_orderstatus", "o_orderpriority", total=True)


def _stat_sql(name: str) -> str:
    return f"SELECT '{name}' AS aname, round(sum({name}), 2) AS total, count({name}) AS count, round(avg({name}), 4) AS average, min({name}) + 0.0::DOUBLE AS min, max({name}) + 0.0::DOUBLE AS max, round(stddev_pop({name}), 4) AS std_dev FROM lineitem"


@query(" UNION ALL ".join(map(_stat_sql, ("l_quantity", "l_discount", "l_linenumber"))))
def ag_stat(t: Tables) -> DataFrame:
    out = aggregates.statistics(t.lineitem, "l_quantity", "l_discount", "l_linenumber")
    return out.select("aname", F.round("total", 2).alias("total"), "count", F.round("average", 4).alias("average"), "min", "max", F.round("std_dev", 4).alias("std_dev"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def ag_merge(t: Tables) -> DataFrame:
    return aggregates.merge_values(t.nation, "n_name", "n_nationkey").select("n_regionkey", "n_name")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def ag_unique(t: Tables) -> DataFrame:
    return retrieve({"orders": t.orders}, "o_orderstatus o_orderpriority", unique=True)


@query("SELECT upper(p_type) AS p_type FROM part GROUP BY upper(p_type)")
def ag_unique_ci(t: Tables) -> DataFrame:
    mixed = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("p_type"))
    return retrieve({"p": mixed}, "p_type:caseless", unique=True).select(F.upper("p_type").alias("p_type"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def ag_first_of_key(t: Tables) -> DataFrame:
    return sorting.first_of_each(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey:numeric")


@query("SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_type")
def ag_sort_unique(t: Tables) -> DataFrame:
    return sorting.unique(t.part.select("p_partkey", "p_type"), "p_type").select("p_type", "p_partkey")


@query("SELECT count(*) AS records FROM lineitem")
def ag_count(t: Tables) -> DataFrame:
    return aggregates.count_rows(t.lineitem)


# Sorting


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def so_sort_limit(t: Tables) -> DataFrame:
    return retrieve({"orders": t.orders}, "o_orderkey o_totalprice", sorted_by="o_totalprice:numeric:descending o_orderkey:numeric", limit=20)


def _ranked(df: DataFrame, *specs: str) -> DataFrame:
    """The order of a sort as a column."""
    return sorting.numbered(df, *specs, name="place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY split_part(p_name, ' ', 2), substr(p_name, 2, 1), p_partkey) AS place FROM part")
def so_subfield(t: Tables) -> DataFrame:
    return _ranked(t.part.select("p_partkey", "p_name"), "p_name:split= :field=2", "p_name:split= :field=1.2-1.2", "p_partkey:numeric").select("p_partkey", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY regexp_replace(o_orderpriority, '[^A-Za-z0-9 ]', '', 'g') DESC, o_orderkey) AS place FROM orders")
def so_dict(t: Tables) -> DataFrame:
    return _ranked(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority:dictionary:descending", "o_orderkey:numeric").select("o_orderkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY upper(p_name), p_size, p_partkey) AS place FROM part")
def so_caseless(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("  "), "p_name")).alias("n"), F.hex("p_size").alias("h"))
    return _ranked(df, "n:caseless:blanks", "h:hexadecimal", "p_partkey:numeric").select("p_partkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey % 64, p_partkey) AS place FROM part")
def so_bases(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.bin("p_size").alias("b"), F.conv((F.col("p_partkey") % 64).cast("string"), 10, 8).alias("o"))
    return _ranked(df, "b:binary:descending", "o:octal", "p_partkey:numeric").select("p_partkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS place FROM part")
def so_printable(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.concat(F.lit("\x01"), F.substring("p_name", 1, 3), F.lit("\u00e9\t"), F.expr("substring(p_name, 4)")).alias("n"))
    return _ranked(df, "n:printable:descending", "p_partkey:numeric").select("p_partkey", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY date_trunc('second', ts) DESC, event_id) AS place FROM events")
def so_date(t: Tables) -> DataFrame:
    df = t.events.select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("at"))
    return _ranked(df, "at:date:descending", "event_id:numeric").select("event_id", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rec FROM orders")
def so_recno(t: Tables) -> DataFrame:
    return sorting.numbered(t.orders.select("o_orderkey"), "o_orderkey:numeric", name="rec")


@query("SELECT true AS is_sorted UNION ALL SELECT false")
def so_is_sorted(t: Tables) -> DataFrame:
    return sorting.is_sorted(t.part, "p_partkey", "p_partkey:numeric").unionAll(sorting.is_sorted(t.part, "p_partkey", "p_size:numeric"))


# Sets


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def st_append(t: Tables) -> DataFrame:
    return tables.append(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")))


_NEW = "(SELECT n_nationkey + 20 AS n_nationkey, 'NEW_' || n_nationkey AS n_name, n_regionkey FROM nation)"


def _new_nations(t: Tables) -> DataFrame:
    return t.nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("NEW_"), F.col("n_nationkey").cast("string")).alias("n_name"), "n_regionkey")


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM {_NEW} WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def st_umerge_keep(t: Tables) -> DataFrame:
    return tables.ordered_merge(t.nation, _new_nations(t), ["n_nationkey"], "unique")


@query(f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}")
def st_umerge_replace(t: Tables) -> DataFrame:
    return tables.ordered_merge(t.nation, _new_nations(t), ["n_nationkey"], "replace")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'extra1' WHEN a.c_custkey IS NULL THEN 'extra2' ELSE 'differ' END AS status,
          CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' END) END AS differs,
          a.c_name AS c_name FROM (SELECT * FROM customer WHERE c_custkey % 10 <> 0) a FULL JOIN
          (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 1) b
          ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_mktsegment <> b.c_mktsegment OR a.c_acctbal <> b.c_acctbal""")
def st_udiff(t: Tables) -> DataFrame:
    one = t.customer.where("c_custkey % 10 <> 0")
    two = t.customer.where("c_custkey % 10 <> 1").withColumns(
        {"c_mktsegment": F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'NONE' ELSE c_mktsegment END"), "c_acctbal": F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END")}
    )
    return tables.difference(one, two, ["c_custkey"], ["c_mktsegment", "c_acctbal"], show=["c_name"], kinds={"c_acctbal": "number"})


@query("SELECT 'extra1' AS status, CAST(count(*) AS BIGINT) AS records FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT 'extra2', count(*) FROM customer WHERE c_custkey % 10 = 0")
def st_udiff_counts(t: Tables) -> DataFrame:
    return tables.difference_counts(tables.difference(t.customer.where("c_custkey % 10 <> 0"), t.customer.where("c_custkey % 10 <> 1"), ["c_custkey"]))


@query(f"""SELECT n_nationkey, n_name, n_regionkey, q AS "recQ#", k AS "recK#", row_number() OVER (ORDER BY k) AS "recM#" FROM
          (SELECT *, row_number() OVER (ORDER BY q) AS k FROM (SELECT *, row_number() OVER (ORDER BY n_name DESC) AS q FROM {_NEW})) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def st_umerge_numbers(t: Tables) -> DataFrame:
    return tables.merge_numbers(t.nation, _new_nations(t), ["n_nationkey"], ("n_name:descending",))


@query("""SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY rec, new) AS "rec#" FROM (
          SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_name) AS rec, 1 AS new FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey, 5 * r_regionkey + 2, 0 FROM region)""")
def st_umerge_record_insert(t: Tables) -> DataFrame:
    rows = t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"), F.expr("5 * r_regionkey + 2").alias("place"))
    return tables.merge_by_record(t.nation, rows, ("n_name",), "place", "insert", exactly=5)


@query("""SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY rec) AS "rec#" FROM (
          SELECT * FROM (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_name) AS rec FROM nation) WHERE rec NOT IN (SELECT 5 * r_regionkey + 2 FROM region)
          UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey, 5 * r_regionkey + 2 FROM region)""")
def st_umerge_record_replace(t: Tables) -> DataFrame:
    rows = t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"), F.expr("5 * r_regionkey + 2").alias("place"))
    return tables.merge_by_record(t.nation, rows, ("n_name",), "place", exactly=5)


def _two_customers(t: Tables) -> DataFrame:
    two = t.customer.where("c_custkey % 10 <> 1").withColumn("c_mktsegment", F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'NONE' ELSE c_mktsegment END"))
    return tables.difference(t.customer.where("c_custkey % 10 <> 0"), two, ["c_custkey"], ["c_mktsegment"])


@query("SELECT c_custkey, 'extra1' AS status, '' AS differs FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey, 'extra2', '' FROM customer WHERE c_custkey % 10 = 0")
def st_udiff_extra(t: Tables) -> DataFrame:
    """Extra rows alone (``-d``)."""
    return tables.only(_two_customers(t), differing=False)


@query("SELECT c_custkey, 'extra2' AS status, '' AS differs FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'differ', 'c_mktsegment' FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 10 > 1")
def st_udiff_without_first(t: Tables) -> DataFrame:
    """Without what only the first table has (``-e1``)."""
    return tables.only(_two_customers(t), extra=("2",))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
def st_unmerge(t: Tables) -> DataFrame:
    return aggregates.unmerge_values(t.part.select("p_partkey", F.concat("p_name", F.lit(" ")).alias("p_name")), "p_name", " ")


# Functions


@query("""SELECT l_orderkey, l_linenumber, printf('%.4f', l_quantity * (l_extendedprice - 1) / 2 + -l_tax) AS price, printf('%.4f', CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE)) AS l_quantity,
          printf('%.4f', 0.0::DOUBLE) AS none FROM lineitem""")
def fn_compute(t: Tables) -> DataFrame:
    return _computed(t.lineitem)


def _computed(df: DataFrame) -> DataFrame:
    out = scalar.compute(df, "%.4f", price="l_quantity * (l_extendedprice - 1) / 2 + -l_tax", l_quantity="l_quantity % 7", none="l_quantity / (l_tax - l_tax)")
    return out.select("l_orderkey", "l_linenumber", "price", "l_quantity", "none")


@query("SELECT p_partkey, CAST(2 * p_size AS DOUBLE) AS twice, CAST(strlen(p_name) AS DOUBLE) AS size, abs(p_size - 25) + 0.0::DOUBLE AS off FROM part")
def fn_compute_based(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_name", F.hex("p_size").alias("h"), F.bin("p_size").alias("b"), F.concat((F.col("p_size") - 25).cast("string"), F.lit(" units")).alias("d"))
    out = scalar.compute(df, None, twice="hex(h) + bin(b)", size="len(p_name)", off="abs(d)")
    return out.select("p_partkey", "twice", "size", "off")


@query("SELECT p_partkey, printf('%05d', p_size) AS p_size, printf('%x', p_size) AS h, to_base(p_size, 2) AS b, printf('[%10.1f]', p_retailprice) AS p_retailprice FROM part")
def fn_nprintf(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.col("p_size").alias("h"), F.col("p_size").alias("b"), "p_retailprice")
    return scalar.rewrite(df, p_size="%05d", h="%x", b="%b", p_retailprice="[%10.1f]")


@query("SELECT p_partkey, printf('%o', p_size) AS p_size, printf('%.3e', p_retailprice) AS e, printf('%g', p_retailprice) AS g, printf('%-8s|', p_brand) AS p_brand FROM part")
def fn_nprintf_more(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("e"), F.col("p_retailprice").alias("g"), "p_brand")
    return scalar.rewrite(df, p_size="%o", e="%.3e", g="%g", p_brand="%-8s|")


@query("SELECT p_partkey, upper(p_name) AS a, ' ' || lower(p_type) AS b, lower(p_type) AS c, p_name || ' ' AS d FROM part")
def fn_trim_case(t: Tables) -> DataFrame:
    wide = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    df = t.part.select("p_partkey", wide("p_name").alias("a"), wide("p_type").alias("b"), wide("p_type").alias("c"), wide("p_name").alias("d"))
    return scalar.rewrite(df, a="trupper", b="rtrlower", c="trlower", d="ltrim")


@query("SELECT event_id, strftime(ts, '%m/%d/%y') AS a, strftime(ts, '%d.%m.%Y') AS b, strftime(ts, '%y%m%d') AS c, strftime(ts, '%H:%M:%S') AS d, strftime(ts, '%H.%M') AS e FROM events")
def fn_date_fmt(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "ts", F.date_format("ts", "M-d-yyyy H:mm:ss").alias("x"))
    x = F.col("x")
    return df.select(
        "event_id", scalar.date_text(x).alias("a"), scalar.date_text(F.col("ts"), ".", True, native=True).alias("b"), scalar.date_text(x, "#").alias("c"),
        scalar.time_text(x).alias("d"), scalar.time_text(F.col("ts"), ".", False, native=True).alias("e"),
    )


@query("SELECT c_custkey, printf('%08d', c_custkey) || '/' || c_mktsegment || '%' AS tag FROM customer")
def fn_uprintf(t: Tables) -> DataFrame:
    return scalar.build(t.customer, "tag", "%08d/%s%%", "c_custkey", "c_mktsegment").select("c_custkey", "tag")


@query("SELECT o_orderkey, ((year(o_orderdate) * 12 + month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1)::BIGINT * 86400 AS k FROM orders")
def fn_date_key(t: Tables) -> DataFrame:
    """The same key from four ways to write a date."""
    day = F.col("o_orderdate")
    forms = [F.date_format(day, p) for p in ("M/d/yy", "MM-dd-yyyy", "d.M.yyyy", "yyMMdd")]
    written_ = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", typed.date_key(written_).alias("k"))


@query("SELECT p_partkey, regexp_replace(p_name, ' ', '~', 'g') AS p_name FROM part")
def fn_newline(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalar.newlines_out(F.translate("p_name", " ", "\n")).alias("p_name"))


# Updates


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment,
          CASE WHEN c_mktsegment = 'BUILDING' THEN (c_acctbal + 100) ELSE c_acctbal END AS c_acctbal FROM customer""")
def dm_alter(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return tables.alter(df, [("c_mktsegment", "=", "HOUSES"), ("c_acctbal", "+=", "100")], "c_mktsegment = BUILDING")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size * 2 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS amount FROM part")
def dm_alter_text(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.col("p_size").cast("string").alias("amount"))
    return tables.alter(df, [("amount", "f+=", "p_size")], "p_size gt 25").drop("p_size")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'NEW NAME' ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN printf('%04x', p_size + 16) ELSE printf('%x', p_size) END AS h FROM part")
def dm_alter_modifiers(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_name", F.lower(F.hex("p_size")).alias("h"), "p_size")
    return tables.alter(df, [("p_name", "=", "  new name ", ["trim", "toupper"]), ("h", "+=", "10", ["hexadecimal"], "%04x")], "p_size gt 25").drop("p_size")


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dm_alter_join(t: Tables) -> DataFrame:
    nations = select_where(t.nation, "n_regionkey eq 1")
    return tables.alter_from(t.supplier, nations, {"s_nationkey": "n_nationkey"}, {"s_name": "n_name"}).select("s_suppkey", "s_name")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND n_regionkey = 1 THEN s_acctbal + n_nationkey ELSE s_acctbal END AS s_acctbal,
          CASE WHEN s_acctbal > 0 AND n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def dm_alter_join_add(t: Tables) -> DataFrame:
    out = tables.alter_from(t.supplier, t.nation, {"s_nationkey": "n_nationkey"}, {"s_acctbal": ("f+=", "n_nationkey"), "s_name": "n_name"}, "s_acctbal gt 0", "n_regionkey eq 1")
    return out.select("s_suppkey", "s_acctbal", "s_name")


@query("""SELECT s_suppkey, CAST(CASE WHEN n_regionkey < 3 THEN s_suppkey * (n_regionkey + 1) ELSE s_suppkey END AS VARCHAR) AS amount FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def dm_alter_join_multiply(t: Tables) -> DataFrame:
    df = t.supplier.select("s_suppkey", "s_nationkey", F.col("s_suppkey").cast("string").alias("amount"))
    nations = t.nation.select("n_nationkey", "n_regionkey", (F.col("n_regionkey") + 1).cast("string").alias("by"))
    return tables.alter_from(df, nations, {"s_nationkey": "n_nationkey"}, {"amount": ("f*=", "by")}, with_clause="n_regionkey lt 3").select("s_suppkey", "amount")


@query("SELECT * FROM part WHERE NOT (p_size > 10 AND p_type = 'PROMO')")
def dm_delete(t: Tables) -> DataFrame:
    return tables.delete(t.part, "p_size gt 10 and p_type = PROMO")


@query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def dm_delete_join(t: Tables) -> DataFrame:
    return tables.delete_with(t.supplier, t.nation, {"s_nationkey": "n_nationkey"}, "n_regionkey eq 2")


@query("SELECT * FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, -1 FROM region")
def dm_insert(t: Tables) -> DataFrame:
    rows = t.region.withColumn("n_nationkey", F.col("r_regionkey") + 100)
    return tables.insert_from(t.nation, rows, {"r_name": "n_name"}, {"n_regionkey": -1})


@query("SELECT * FROM nation UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name DESC) AS INTEGER), r_name, r_regionkey FROM region")
def dm_insert_recno(t: Tables) -> DataFrame:
    return tables.insert_from(t.nation, t.region, {"r_name": "n_name", "r_regionkey": "n_regionkey"}, number="n_nationkey", order=("r_name:descending",))


# Validation

_RULES = """
c_mktsegment % "[A-Z]{8,9}" : badsegment
c_acctbal >= 0 : negative
c_mktsegment == "BUILDING"
    c_acctbal < 5000 & size(c_name) == 18 : bigbuilder
    index(c_name, "9") #== 0 : nine
substr(c_name, 1, 8) $ "!" == "Customer!" : badname
"""


@query("""SELECT c_custkey, 'badsegment' AS code FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-Z]{8,9}')
          UNION ALL SELECT c_custkey, 'negative' FROM customer WHERE c_acctbal < 0
          UNION ALL SELECT c_custkey, 'bigbuilder' FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT (c_acctbal < 5000 AND strlen(c_name) = 18)
          UNION ALL SELECT c_custkey, 'nine' FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '9')""")
def dq_validate(t: Tables) -> DataFrame:
    return validation.validate(t.customer, _RULES, ["c_custkey"])


@query("SELECT o_orderkey, 'nocust' AS code, 'no such customer' AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def dq_tblsearch(t: Tables) -> DataFrame:
    known = {"cust": select_where(t.customer, "c_mktsegment = BUILDING")}
    messages = t.spark.createDataFrame([("nocust", "no such customer")], "code string, message string")
    return validation.validate(t.orders, 'tblsearch("cust", "c_custkey", o_custkey) : nocust', ["o_orderkey"], known, messages)


@query("SELECT CAST(count(*) AS BIGINT) AS errors FROM part WHERE p_size % 5 = 0")
def dq_structure(t: Tables) -> DataFrame:
    d = read_descriptor("a\tt:\tl12\nb\tt:\tl12\nc\tt\\n\tl12\n")
    lines = t.part.select(F.when(F.col("p_size") % 5 == 0, F.concat_ws(":", "p_partkey", "p_name")).otherwise(F.concat_ws(":", "p_partkey", "p_name", "p_type")).alias("value"))
    return validation.structural_errors(flatfile.records(lines, d))


# Flat files, packets and reports


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ':' || p_brand AS p_name, rpad(p_type, 8, ' ') AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def sc_flat(t: Tables) -> DataFrame:
    """A table as lines, with delimiters escaped and a fixed width, and back."""
    d = read_descriptor("p_partkey\tt:\tr8\np_name\tt:\tl20\np_type\tw8\tl8\np_size\tt\\n\tr4\n")
    rows = t.part.select("p_partkey", F.concat_ws(":", "p_name", "p_brand").alias("p_name"), "p_type", "p_size")
    return flatfile.records(flatfile.to_lines(rows, d), d, policy="fail")


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part"
_PART_LINES = "p_partkey\tt:\tr8\np_name\tt:\tl20\np_size\tt\\n\tr4\n"


@query(_PARTS)
def sc_file(t: Tables) -> DataFrame:
    """A table written as a compressed flat file and read from it."""
    place = shared_place(t.spark, "flat")
    flatfile.write_table(t.part.select("p_partkey", "p_name", "p_size"), place, read_descriptor(_PART_LINES), compression="gzip")
    return flatfile.read_table(t.spark, place, _PART_LINES, "fail")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def sc_inline(t: Tables) -> DataFrame:
    """A flat file, one by its nature, that begins with its own descriptor."""
    text = "n_nationkey\tt:\tr8\nn_name\tt:\tl20\nn_regionkey\tt\\n\tr4"
    place = shared_place(t.spark, "inline")
    head = t.spark.range(0, 1, 1, 1).select(F.lit(f"%description\n{text}\n%enddescription").alias("value"))
    head.union(flatfile.to_lines(t.nation, read_descriptor(text))).coalesce(1).write.text(place)
    return flatfile.read_inline(t.spark, place)


@query(f"{_PARTS} UNION ALL {_PARTS}")
def sk_load_unload(t: Tables) -> DataFrame:
    """A flat file loaded onto a table twice, and the table unloaded to a flat file again."""
    source, table, target = (shared_place(t.spark, tag) for tag in ("source", "table", "target"))
    flatfile.write_table(t.part.select("p_partkey", "p_name", "p_size"), source, read_descriptor(_PART_LINES))
    for _ in range(2):
        flatfile.load(t.spark, source, _PART_LINES, table)
    flatfile.unload(t.spark, table, target, read_descriptor(_PART_LINES))
    return flatfile.read_table(t.spark, target, _PART_LINES, "fail")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS packet, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def sc_packet_file(t: Tables) -> DataFrame:
    """Packets written as text and read from it."""
    place = shared_place(t.spark, "packets")
    tables.packet_text(tables.to_packets(t.nation, ("n_nationkey:numeric",))).write.text(place)
    return tables.from_packets(tables.read_packets(t.spark, place), ["n_name", "n_regionkey"])


@query("SELECT p_partkey || '|' || p_name || '|' || p_size AS value FROM part")
def sk_lines(t: Tables) -> DataFrame:
    return flatfile.to_lines(t.part.select("p_partkey", "p_name", "p_size"), delimiter="|")


@query("""SELECT n_nationkey + 1 AS packet, 'n_nationkey' AS name, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey + 1, 'n_name', n_name FROM nation
          UNION ALL SELECT n_nationkey + 1, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation""")
def sk_packet(t: Tables) -> DataFrame:
    return tables.to_packets(t.nation, ("n_nationkey:numeric",))


@query("SELECT p_partkey + 1 AS packet, p_name, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS p_brand FROM part")
def sc_tuple(t: Tables) -> DataFrame:
    packets = tables.to_packets(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), ("p_partkey:numeric",))
    small = tables.from_packets(packets, ["p_size"]).where("CAST(p_size AS INT) <= 25").select("packet")
    kept = packets.join(small.withColumn("name", F.lit("p_brand")), ["packet", "name"], "left_anti")
    return tables.from_packets(kept, ["p_name", "p_brand"])


@query("SELECT (SELECT count(*) > 0 FROM customer WHERE c_acctbal > 9000) AS found")
def sk_exists(t: Tables) -> DataFrame:
    return exists({"customer": t.customer}, "c_custkey", "c_acctbal gt 9000")


@query("SELECT rpad(substr(n_name, 1, 8), 8, ' ') || ' ' || lpad(CAST(n_regionkey AS VARCHAR), 4, ' ') AS line FROM nation")
def sk_table(t: Tables) -> DataFrame:
    d = read_descriptor("n_name\tt:\tl8\nn_regionkey\tt\\n\tr4\n")
    return reports.table_lines(t.nation.select(*[F.col(f.name).cast("string").alias(f.name, metadata=f.metadata) for f in d.schema()]))


@query("SELECT 'n_name     : ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS block FROM nation")
def sk_block(t: Tables) -> DataFrame:
    return reports.block_lines(t.nation.select("n_name", "n_regionkey"))


@query("SELECT 'n_name=' || n_name || ' (' || printf('%03d', n_regionkey) || ')' AS line FROM nation")
def sk_format(t: Tables) -> DataFrame:
    return reports.format_lines(t.nation.select("n_name", "n_regionkey"), "%n=%s (%03.0f)")


@query("""SELECT n_nationkey, CASE WHEN lag(n_regionkey) OVER (ORDER BY n_regionkey, n_nationkey) = n_regionkey THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation""")
def sk_repeated(t: Tables) -> DataFrame:
    return reports.repeated_blank(t.nation.select("n_nationkey", "n_regionkey", F.col("n_regionkey").alias("k")), ["n_regionkey"], ["k", "n_nationkey"]).drop("k")


@query("SELECT '<tr><td>' || replace(p_name, ' ', ' &amp; ') || '</td><td>&lt;' || p_size || '&gt;</td></tr>' AS line FROM part")
def sk_html(t: Tables) -> DataFrame:
    return reports.html_lines(t.part.select(F.replace("p_name", F.lit(" "), F.lit(" & ")), F.concat(F.lit("<"), F.col("p_size").cast("string"), F.lit(">"))))


@query("SELECT attribute, kind, justify, width, label FROM (VALUES ('r_regionkey', 't:', 'l', 12, ''), ('r_name', 't\\n', 'l', 12, '')) AS v(attribute, kind, justify, width, label)")
def sk_describe(t: Tables) -> DataFrame:
    return flatfile.describe(t.region)


