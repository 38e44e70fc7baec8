"""One query for each operator, with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter, Parameter, conjunction, decode, encode, sum_double, summary_check
from lodestar.operators import key_summary as ks
from lodestar.operators import relational as rel
from lodestar.operators import statistics as st
from lodestar.plans import artefacts, runner, star
from lodestar.plans.workload import Query, Scan, Table, Workload, read_queries, read_workload
from lodestar.sources.tables import read_parquet, update

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORKLOADS = Path(__file__).resolve().parent.parent / "workloads"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{artefacts.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Scans, projections and predicates


def _scan(name: str, source: str, columns: list[str], filters: list[Filter], where: str):
    @register(name, f"SELECT {', '.join(columns)} FROM {source}{f' WHERE {where}' if where else ''}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rel.scan(table(spark, sf_dir, source), columns, filters)


_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
_ORDER = ["o_orderkey", "o_totalprice"]
_scan("scan_project", "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"], [], "")
for _name, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    _scan(f"filter_{_name}", "lineitem", _LINE, [Filter("l_quantity", _name, (17.0,))], f"l_quantity {_sign} 17")
for _name, _left, _right in (("cc", True, True), ("co", True, False), ("oc", False, True), ("oo", False, False)):
    _low, _high = (">=" if _left else ">"), ("<=" if _right else "<")
    _scan(f"between_{_name}", "lineitem", _LINE, [Filter("l_quantity", "between", (10.0, 20.0), _left, _right)], f"l_quantity {_low} 10 AND l_quantity {_high} 20")
_scan("in_list", "part", ["p_partkey", "p_size"], [Filter("p_size", "in", (3, 11, 28))], "p_size IN (3, 11, 28)")
_scan("not_null", "orders", _ORDER, [Filter("o_totalprice", "not_null")], "o_totalprice IS NOT NULL")
_scan("string_lt", "orders", ["o_orderkey", "o_orderpriority"], [Filter("o_orderpriority", "lt", ("3",))], "o_orderpriority < '3'")
_scan("conjunction", "lineitem", _LINE, [Filter("l_quantity", "lt", (30.0,)), Filter("l_linenumber", "eq", (2,))], "l_quantity < 30 AND l_linenumber = 2")


@register("date_eq", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = DATE '1998-10-03'")
def date_eq(spark, sf_dir):
    day = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return rel.scan(day, ["o_orderkey"], [Filter("day", "eq", (date(1998, 10, 3),))])


@register("param_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_linenumber >= 3")
def param_scan(spark, sf_dir):
    filters = [Filter("l_quantity", "lt", (Parameter("most"),)), Filter("l_linenumber", "ge", (Parameter("line"),))]
    return rel.scan(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [f.bound({"most": 5.0, "line": 3}) for f in filters])


@register("filter_col_col", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate")
def filter_col_col(spark, sf_dir):
    joined = rel.inner_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"])
    return joined.where(F.col("l_shipdate") > F.col("o_orderdate")).select("o_orderkey", "l_linenumber")


@register("arith_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, l_linenumber // 2 AS half FROM lineitem")
def arith_project(spark, sf_dir):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("half"))


@register("arith_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 - 1 > l_linenumber + 60")
def arith_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") * 2 - 1 > F.col("l_linenumber") + 60).select("l_orderkey", "l_linenumber")


@register("date_parts", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
def date_parts(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"))


@register("date_shift", "SELECT l_orderkey, l_linenumber, (l_shipdate::DATE + 30)::VARCHAR AS due, (l_shipdate::DATE - DATE '1995-01-01')::INT AS days FROM lineitem")
def date_shift(spark, sf_dir):
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_add(day, 30).cast("string").alias("due"), F.datediff(day, F.lit(date(1995, 1, 1))).alias("days"))


@register("dict_codes", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS code, l_returnflag AS decoded FROM lineitem")
def dict_codes(spark, sf_dir):
    flags = ["A", "N", "R"]
    coded = table(spark, sf_dir, "lineitem").withColumn("code", encode("l_returnflag", flags))
    return coded.select("l_orderkey", "l_linenumber", "code", decode("code", flags).alias("decoded"))


@register("project_filter_over_agg", "SELECT l_returnflag, n FROM (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) WHERE q > 1000")
def project_filter_over_agg(spark, sf_dir):
    grouped = rel.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [("l_orderkey", "count", "n"), ("l_quantity", "sum", "q")])
    return rel.scan(grouped, ["l_returnflag", "n"], [Filter("q", "gt", (1000.0,))])


@register("point_update", "SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def point_update(spark, sf_dir):
    return update(table(spark, sf_dir, "orders"), F.col("o_orderkey") < 100, "o_totalprice", F.lit(0.0)).select(*_ORDER)


# Aggregation

_STATIC = [("l_orderkey", "count", "n"), ("l_quantity", "sum", "total"), ("l_quantity", "min", "low"), ("l_shipdate", "max", "last"), ("l_returnflag", "min", "flag")]
_STATIC_SQL = "count(l_orderkey) AS n, sum(l_quantity::DOUBLE) AS total, min(l_quantity) AS low, max(l_shipdate) AS last, min(l_returnflag) AS flag"


def _agg(name: str, keys: list[str], filters: list[Filter], where: str):
    head = "".join(f"{k}, " for k in keys)

    @register(name, f"SELECT {head}{_STATIC_SQL} FROM lineitem{where}{' GROUP BY ' + ', '.join(keys) if keys else ''}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rel.aggregate(table(spark, sf_dir, "lineitem").where(conjunction(filters)), keys, _STATIC)


_agg("static_agg", [], [], "")
_agg("static_agg_empty", [], [Filter("l_quantity", "lt", (0.0,))], " WHERE l_quantity < 0")
_agg("hash_agg_one", ["l_returnflag"], [], "")
_agg("hash_agg_two", ["l_returnflag", "l_linestatus"], [Filter("l_linenumber", "le", (4,))], " WHERE l_linenumber <= 4")


@register("agg_date_text_minmax", "SELECT o_custkey, min(o_orderdate) AS first, max(o_orderpriority) AS priority FROM orders GROUP BY 1")
def agg_date_text_minmax(spark, sf_dir):
    return rel.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], [("o_orderdate", "min", "first"), ("o_orderpriority", "max", "priority")])


@register("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return rel.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [])


@register("count_distinct", "SELECT count(DISTINCT o_custkey) AS customers FROM orders")
def count_distinct(spark, sf_dir):
    return rel.aggregate(table(spark, sf_dir, "orders"), [], [("o_custkey", "count_distinct", "customers")])


@register("avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def avg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"))


@register("two_level_agg", "SELECT count(*) AS parts, sum(n::DOUBLE) AS n, max(n) AS most FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def two_level_agg(spark, sf_dir):
    inner = rel.aggregate(table(spark, sf_dir, "lineitem"), ["l_partkey"], [("l_orderkey", "count", "n")])
    return rel.aggregate(inner, [], [("l_partkey", "count", "parts"), ("n", "sum", "n"), ("n", "max", "most")])


@register("bit_or_agg", "SELECT l_orderkey, bit_or(1::BIGINT << l_linenumber) AS bits FROM lineitem GROUP BY 1")
def bit_or_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("bit_or(shiftleft(1L, l_linenumber))").alias("bits"))


@register("freq_desc", "SELECT p_size AS value, count(*) AS freq FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def freq_desc(spark, sf_dir):
    return rel.frequencies(table(spark, sf_dir, "part"), "p_size").orderBy(F.desc("freq"), "value")


@register("max_top_freq", "SELECT max(n) AS max_freq, avg(n) AS top_freq FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey ORDER BY n DESC LIMIT (SELECT greatest(1000, count(DISTINCT o_custkey) // 100) FROM orders))")
def max_top_freq(spark, sf_dir):
    return rel.max_and_top_frequency(table(spark, sf_dir, "orders"), "o_custkey")


@register("usage_freq", "SELECT l_linenumber AS value, sum((l_quantity < 10)::INT + (l_quantity < 20)::INT)::BIGINT AS freq FROM lineitem GROUP BY 1")
def usage_freq(spark, sf_dir):
    log = [Filter("l_quantity", "lt", (10.0,)), Filter("l_quantity", "lt", (20.0,))]
    usage = sum((f.column().cast("int") for f in log[1:]), log[0].column().cast("int"))
    return rel.frequencies(table(spark, sf_dir, "lineitem").withColumn("usage", usage), "l_linenumber", "usage")


# Sorting


@register("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_asc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDER).orderBy(F.asc("o_totalprice"))


@register("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDER).orderBy(F.desc("o_totalprice"))


@register("sort_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def sort_multi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_orderpriority"), F.asc("o_totalprice"))


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return rel.top_k(table(spark, sf_dir, "orders").select(*_ORDER), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 25)


@register("topk_multi", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 40")
def topk_multi(spark, sf_dir):
    order = [F.desc_nulls_last("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return rel.top_k(table(spark, sf_dir, "lineitem"), order, 40).select(*_LINE)


# Joins

_JOIN_SQL = "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 300000")


@register("inner_join", _JOIN_SQL)
def inner_join(spark, sf_dir):
    return rel.inner_join(_priced(spark, sf_dir), table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"]).select("o_orderkey", "l_linenumber", "l_quantity")


@register("bloom_join", _JOIN_SQL)
def bloom_join(spark, sf_dir):
    priced = _priced(spark, sf_dir)
    return rel.bloom_join(priced, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", priced.count()).select("o_orderkey", "l_linenumber", "l_quantity")


@register("index_join", _JOIN_SQL)
def index_join(spark, sf_dir):
    keys = _priced(spark, sf_dir).select("o_orderkey")
    return star.index_join(keys, "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", keys.count()).select("o_orderkey", "l_linenumber", "l_quantity")


@register("inner_join_two_keys", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS quantity FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def inner_join_two_keys(spark, sf_dir):
    build = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"))
    return rel.inner_join(build, table(spark, sf_dir, "lineitem"), ["k", "n"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "quantity")


@register("inner_join_text_key", "SELECT c_custkey, n_name FROM customer JOIN (SELECT DISTINCT c_mktsegment AS s, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3) ON c_mktsegment = s")
def inner_join_text_key(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey < 3")
    segments = rel.inner_join(nation, customer, ["n_nationkey"], ["c_nationkey"]).select(F.col("c_mktsegment").alias("s"), "n_name").distinct()
    return rel.inner_join(segments, customer, ["s"], ["c_mktsegment"]).select("c_custkey", "n_name")


@register("left_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def left_semi(spark, sf_dir):
    return rel.semi_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 48"), ["o_orderkey"], ["l_orderkey"]).select("o_orderkey")


@register("right_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def right_semi(spark, sf_dir):
    return rel.semi_join(table(spark, sf_dir, "lineitem"), _priced(spark, sf_dir), ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber")


LINEITEM_STAR = Workload(
    "lineitem star",
    "lineitem",
    {
        "lineitem": Table("lineitem", {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double"}),
        "orders": Table("orders", {"o_orderkey": "bigint", "o_totalprice": "double"}, primary=("o_orderkey",), links=("o_orderkey", "l_orderkey")),
        "part": Table("part", {"p_partkey": "bigint", "p_size": "int"}, primary=("p_partkey",), links=("p_partkey", "l_partkey")),
        "supplier": Table("supplier", {"s_suppkey": "bigint", "s_acctbal": "double"}, primary=("s_suppkey",), links=("s_suppkey", "l_suppkey")),
    },
)
_STAR_FILTERS = {
    "lineitem": ((Filter("l_quantity", "lt", (25.0,)),), "l_quantity < 25"),
    "orders": ((Filter("o_totalprice", "between", (100000.0, 300000.0)),), "o_totalprice BETWEEN 100000 AND 300000"),
    "part": ((Filter("p_size", "in", (1, 5, 9, 11)),), "p_size IN (1, 5, 9, 11)"),
    "supplier": ((Filter("s_acctbal", "gt", (0.0,)),), "s_acctbal > 0"),
}


def star_query(tables: list[str]) -> Query:
    return Query("star", {t: Scan(t, filters=_STAR_FILTERS[t][0]) for t in tables}, count=True)


def star_frames(spark, sf_dir, names=("lineitem", "orders", "part", "supplier")):
    return {t: table(spark, sf_dir, t) for t in names}


def star_sql(tables: list[str]) -> str:
    on = {t: "{} = {}".format(*LINEITEM_STAR.tables[t].links) for t in tables if t != "lineitem"}
    return f"SELECT count(*) AS n FROM lineitem{''.join(f' JOIN {t} ON {c}' for t, c in on.items())} WHERE {' AND '.join(_STAR_FILTERS[t][1] for t in tables)}"


for _tables in (["lineitem", "orders"], ["lineitem", "orders", "part"], ["lineitem", "orders", "part", "supplier"]):

    @register(f"star_join_{len(_tables)}", star_sql(_tables))
    def star_join(spark, sf_dir, tables=_tables):
        return star.star_join(LINEITEM_STAR, star_query(tables), star_frames(spark, sf_dir))


@register("star_join_5", "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity < 25 AND c_acctbal > 0")
def star_join_5(spark, sf_dir):
    frames = star_frames(spark, sf_dir)
    query = Query("star", {"lineitem": Scan("lineitem", filters=_STAR_FILTERS["lineitem"][0]), "orders": Scan("orders", projections=("o_custkey",)), "part": Scan("part"), "supplier": Scan("supplier")})
    joined = star.star_join(LINEITEM_STAR, query, frames)
    customer = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return rel.inner_join(customer, joined, ["c_custkey"], ["orders__o_custkey"]).agg(F.count("*").alias("n"))


@register("toml_star_count", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey WHERE c_nationkey >= 3 AND c_nationkey < 12 AND o_totalprice > 100000 AND value < 50")
def toml_star_count(spark, sf_dir):
    workload = read_workload(WORKLOADS / "customer_star.toml")
    query = read_queries(WORKLOADS / "customer_queries.toml", workload)["star_count"]
    return star.star_join(workload, query, {t: table(spark, sf_dir, t) for t in workload.tables})


@register("planned_star", star_sql(["lineitem", "orders", "part", "supplier"]))
def planned_star(spark, sf_dir):
    """The star by the order that gathered statistics make the cheapest."""
    query, frames = star_query(["lineitem", "orders", "part", "supplier"]), star_frames(spark, sf_dir)
    plan = runner.choose(LINEITEM_STAR, query, frames, runner.gather(LINEITEM_STAR, [query], frames), keyed=["orders", "part"])
    return runner.planned(LINEITEM_STAR, query, frames, plan)


# Statistics

_PROFILED = ["o_custkey", "o_totalprice"]


@register(
    "col_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS n, count(DISTINCT {c}) AS ndv, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, (SELECT max(k) FROM (SELECT count(*) AS k FROM orders GROUP BY {c})) AS max_freq, (SELECT avg(k) FROM (SELECT count(*) AS k FROM orders GROUP BY {c} ORDER BY k DESC LIMIT (SELECT greatest(1000, count(DISTINCT {c}) // 100) FROM orders))) AS top_freq FROM orders"
        for c in _PROFILED
    ),
)
def col_stats(spark, sf_dir):
    return st.profile(table(spark, sf_dir, "orders"), _PROFILED)


def _rows(spark, histogram: st.Histogram) -> DataFrame:
    rows = [(k, float(a), float(b), int(c)) for k, (a, b, c) in enumerate(zip(histogram.lows, histogram.highs, histogram.counts, strict=True))]
    return spark.createDataFrame(rows, "bucket int, lo double, hi double, card long")


_VALUES = "WITH RECURSIVE g AS (SELECT p_retailprice AS x, count(*) AS f FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1), v AS (SELECT x, f, row_number() OVER (ORDER BY x) AS k, sum(f) OVER (ORDER BY x) AS c, lead(f) OVER (ORDER BY x) AS next_f FROM g), t AS (SELECT max(k) AS n, CASE WHEN max(k) <= 16 THEN 1 ELSE sum(f) / 16.0::DOUBLE END AS least, (max(x) - min(x)) / 16 AS width FROM v)"
_ENDED = "b AS (SELECT e, coalesce(lag(e) OVER (ORDER BY e), 0) AS s FROM (SELECT k AS e FROM cuts WHERE k > 0 UNION SELECT n FROM t)) SELECT (row_number() OVER (ORDER BY e) - 1)::INT AS bucket, min(x) AS lo, max(x) AS hi, sum(f)::BIGINT AS card FROM b JOIN v ON k > s AND k <= e GROUP BY e"
_HISTOGRAMS = {
    # A bucket ends with the value that fills it; the last one takes the rest.
    "equidepth": (st.equi_depth, f"{_VALUES}, cuts(i, k, c) AS (SELECT 0, 0::BIGINT, 0::HUGEINT UNION ALL SELECT i + 1, min(v.k), min(v.c) FROM cuts, v, t WHERE v.k > cuts.k AND v.c - cuts.c >= least AND i < 15 GROUP BY i), {_ENDED}"),
    # A bucket starts with the first value that is over a width beyond the last one's start.
    "equiwidth": (st.equi_width, f"{_VALUES}, cuts(k, x) AS (SELECT 0::BIGINT, min(x) FROM v UNION ALL SELECT min(v.k) - 1, min(v.x) FROM cuts, v, t WHERE v.x - cuts.x > width GROUP BY cuts.k), {_ENDED}"),
    # As equi-depth, but a bucket also ends before a value that fills one alone.
    "compressed": (st.compressed, f"{_VALUES}, cuts(k, c) AS (SELECT 0::BIGINT, 0::HUGEINT UNION ALL SELECT min(v.k), min(v.c) FROM cuts, v, t WHERE v.k > cuts.k AND (v.c - cuts.c >= least OR next_f >= least) GROUP BY cuts.k), {_ENDED}"),
}
for _name, (_make, _sql) in _HISTOGRAMS.items():

    @register(f"hist_{_name}", _sql)
    def hist(spark, sf_dir, make=_make):
        return _rows(spark, make(table(spark, sf_dir, "part"), "p_retailprice", 16))


@register(
    "hist_maxdiff",
    "WITH v AS (SELECT p_retailprice AS x, count(*) AS f FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1), g AS (SELECT x, f, x - lag(x) OVER (ORDER BY x) AS gap FROM v), r AS (SELECT x, f, gap, row_number() OVER (ORDER BY gap DESC NULLS LAST, x) AS k FROM g), b AS (SELECT x, f, sum(CASE WHEN gap IS NOT NULL AND k <= 15 THEN 1 ELSE 0 END) OVER (ORDER BY x) AS bucket FROM r) SELECT bucket::INT AS bucket, min(x) AS lo, max(x) AS hi, sum(f)::BIGINT AS card FROM b GROUP BY 1",
)
def hist_maxdiff(spark, sf_dir):
    return _rows(spark, st.max_diff(table(spark, sf_dir, "part"), "p_retailprice", 16))


@register("bit_index", "SELECT p_partkey, greatest(len(list_filter(range(0, 51, 5), lambda l: l <= p_size)) - 1, 0)::INT AS bucket, (greatest(len(list_filter(range(0, 51, 5), lambda l: l <= p_size)) - 1, 0) // 2 + 3)::INT AS bit FROM part")
def bit_index(spark, sf_dir):
    lows = tuple(range(0, 51, 5))
    h = st.Histogram(lows, tuple(x + 4 for x in lows), (1,) * len(lows))
    return table(spark, sf_dir, "part").select("p_partkey", h.bucket_column("p_size").alias("bucket"), h.bit_column("p_size", 6, 3).alias("bit"))


# Key summaries: lineitem and part learn what orders and lineitem hold.  The oracle is the plain join.


def order_summary(spark, sf_dir, bits: int = 16, offset: int = 0) -> ks.Summary:
    return ks.Summary("orders", "o_totalprice", "lineitem", st.equi_depth(table(spark, sf_dir, "orders"), "o_totalprice", 16), bits, offset)


def _with_order_bits(spark, sf_dir) -> tuple[DataFrame, ks.Summary]:
    """lineitem with bits made on the spot; what is stored is in _summarised()."""
    summary = order_summary(spark, sf_dir)
    bits = ks.build(table(spark, sf_dir, "orders"), "o_orderkey", summary)
    return ks.attach(table(spark, sf_dir, "lineitem"), "l_orderkey", bits), summary


def _summarised(spark, sf_dir) -> tuple[dict[str, DataFrame], list[ks.Summary], dict[str, str]]:
    """The star's tables with lineitem's stored summaries by orders and part, and the versions of these: built on first use."""
    frames = star_frames(spark, sf_dir)
    orders, part = frames["orders"], frames["part"]
    lineitem = frames["lineitem"].select(*LINEITEM_STAR.tables["lineitem"].columns)
    versions = {"orders": artefacts.version(orders), "part": artefacts.version(part)}

    def make(path: str) -> None:
        by_part = ks.Summary("part", "p_size", "lineitem", st.equi_depth(part, "p_size", 32), 32, 16, version=versions["part"])
        by_order = replace(order_summary(spark, sf_dir), version=versions["orders"])
        rows = ks.attach(lineitem, "l_orderkey", ks.build(orders, "o_orderkey", by_order))
        rows = ks.attach(rows, "l_partkey", ks.build(part, "p_partkey", by_part))
        artefacts.store_summaries(rows, [by_order, by_part], path)

    rows, summaries = artefacts.read_summaries(spark, artefacts.built(spark, "lineitem-star", [lineitem, orders, part], make))
    return frames | {"lineitem": rows}, summaries, versions


@register("ks_build", "SELECT o_custkey AS key, bit_or(1::BIGINT << (least(greatest(floor(o_totalprice / 50000), 0), 9))::INT) AS bits FROM orders GROUP BY 1")
def ks_build(spark, sf_dir):
    lows = tuple(50000.0 * k for k in range(10))
    h = st.Histogram(lows, lows, (1,) * 10)
    return ks.build(table(spark, sf_dir, "orders"), "o_custkey", ks.Summary("orders", "o_totalprice", "customer", h, 10))


@register("ks_reduced_scan", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 450000)")
def ks_reduced_scan(spark, sf_dir):
    lows = tuple(50000.0 * k for k in range(10))
    summary = ks.Summary("orders", "o_totalprice", "customer", st.Histogram(lows, lows, (1,) * 10), 10)
    bits = ks.build(table(spark, sf_dir, "orders"), "o_custkey", summary)
    return ks.reduced(ks.attach(table(spark, sf_dir, "customer"), "c_custkey", bits), [(summary, Filter("o_totalprice", "ge", (450000.0,)))]).select("c_custkey")


_KS = {
    "range": (Filter("o_totalprice", "between", (100000.0, 200000.0)), "o_totalprice BETWEEN 100000 AND 200000"),
    "eq": (Filter("o_totalprice", "eq", (112946.26,)), "o_totalprice = 112946.26"),
    "in": (Filter("o_totalprice", "in", (112946.26, 473274.17)), "o_totalprice IN (112946.26, 473274.17)"),
}
for _name, (_filter, _where) in _KS.items():

    @register(f"ks_join_{_name}", f"SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_where}")
    def ks_join(spark, sf_dir, filter_=_filter):
        frames, summaries, versions = _summarised(spark, sf_dir)
        query = Query("ks", {"lineitem": Scan("lineitem"), "orders": Scan("orders", filters=(filter_,))}, count=True)
        return star.star_join(LINEITEM_STAR, query, frames, summaries=summaries, versions=versions)


@register("ks_join_two", star_sql(["lineitem", "orders", "part"]))
def ks_join_two(spark, sf_dir):
    frames, summaries, versions = _summarised(spark, sf_dir)
    return star.star_join(LINEITEM_STAR, star_query(["lineitem", "orders", "part"]), frames, summaries=summaries, versions=versions)


@register("ks_compound", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderpriority < '2')")
def ks_compound(spark, sf_dir):
    bits = ks.build_compound(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderpriority") >= "4", (F.col("o_totalprice") > 400000) & (F.col("o_orderpriority") < "2")])
    return ks.attach(table(spark, sf_dir, "customer"), "c_custkey", bits).where(summary_check("ks", 2)).select("c_custkey")


@register("ks_path", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def ks_path(spark, sf_dir):
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    summary = ks.Summary("region", "r_name", "orders", st.equi_depth(region, "r_name", 8), 5)
    bits = ks.build_path([(nation, "n_regionkey", "n_nationkey"), (customer, "c_nationkey", "c_custkey")], region, "r_regionkey", summary)
    filter_ = Filter("r_name", "eq", ("ASIA",))
    left = ks.reduced(ks.attach(orders, "o_custkey", bits), [(summary, filter_)])
    for other, own, key in ((customer, "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey"), (region.where(filter_.column()), "n_regionkey", "r_regionkey")):
        left = left.join(other, F.col(own) == F.col(key))
    return left.agg(F.count("*").alias("n"))


@register("ks_after_update", "SELECT count(*) AS n FROM lineitem JOIN (SELECT o_orderkey, CASE WHEN o_orderkey < 200 THEN 150000.0 ELSE o_totalprice END AS p FROM orders) ON o_orderkey = l_orderkey WHERE p BETWEEN 140000 AND 160000")
def ks_after_update(spark, sf_dir):
    lineitem, summary = _with_order_bits(spark, sf_dir)
    changed = update(table(spark, sf_dir, "orders"), F.col("o_orderkey") < 200, "o_totalprice", F.lit(150000.0))
    touched = changed.where("o_orderkey < 200").select(F.col("o_orderkey").alias("key"))
    lineitem = ks.refresh(lineitem, "l_orderkey", touched, changed, "o_orderkey", summary)
    query = Query("ks", {"lineitem": Scan("lineitem"), "orders": Scan("orders", filters=(Filter("o_totalprice", "between", (140000.0, 160000.0)),))}, count=True)
    return star.star_join(LINEITEM_STAR, query, {"lineitem": lineitem, "orders": changed}, summaries=[summary])


@register("view_join", star_sql(["lineitem", "orders", "part"]))
def view_join(spark, sf_dir):
    frames = star_frames(spark, sf_dir)
    needed = {t: frames[t].select(*LINEITEM_STAR.tables[t].columns) for t in frames}
    path = artefacts.built(spark, "view-lineitem-orders", [needed["lineitem"], needed["orders"]], lambda to: star.build_view(LINEITEM_STAR, ["orders"], needed, to))
    return star.from_view(LINEITEM_STAR, star_query(["lineitem", "orders", "part"]), read_parquet(spark, path), ["orders"], frames)


# End to end


@register("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2")
def tpch_q1(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    revenue = sum_double(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@register("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
def tpch_q3(spark, sf_dir):
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day)
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    lineitem = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    joined = rel.inner_join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), lineitem, ["o_orderkey"], ["l_orderkey"])
    revenue = F.round(sum_double(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return rel.top_k(joined.groupBy("l_orderkey", "o_orderdate").agg(revenue), [F.desc("revenue"), F.asc("l_orderkey")], 10)


@register("tpch_q4_adapted", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY 1")
def tpch_q4_adapted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01' AND o_orderdate < timestamp_ntz '1998-01-01'")
    late = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return orders.join(table(spark, sf_dir, "lineitem"), late, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@register("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def tpch_q5(spark, sf_dir):
    asia = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01' AND o_orderdate < timestamp_ntz '1999-01-01'")
    supplier = rel.inner_join(asia, table(spark, sf_dir, "supplier"), ["n_nationkey"], ["s_nationkey"])
    joined = rel.inner_join(supplier, table(spark, sf_dir, "lineitem"), ["s_suppkey"], ["l_suppkey"])
    joined = rel.inner_join(orders, joined, ["o_orderkey"], ["l_orderkey"])
    joined = rel.inner_join(table(spark, sf_dir, "customer"), joined, ["c_custkey", "c_nationkey"], ["o_custkey", "s_nationkey"])
    return joined.groupBy("n_name").agg(F.round(sum_double(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("table_sample")
def table_sample(spark, sf_dir):
    """A Bernoulli sample; which rows it holds has no equivalent in SQL."""
    from lodestar.sources.tables import sample

    lineitem = table(spark, sf_dir, "lineitem")
    return sample(lineitem, lineitem.count()).select(*_LINE)


@register("dense_codes", "SELECT DISTINCT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority))::INT - 1 AS code FROM orders")
def dense_codes(spark, sf_dir):
    """Order-preserving codes of a dictionary: ranks among the distinct values, of which there are few."""
    values = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return values.withColumn("code", F.dense_rank().over(Window.orderBy("o_orderpriority")) - 1)


# The queries of the plans register themselves with these.
from lodestar import plan_queries  # noqa: E402, F401
