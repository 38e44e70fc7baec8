"""Queries for sources, sinks, estimates, advisors and the workload driver, with the SQL they must agree with."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter
from lodestar.operators import key_summary as ks
from lodestar.operators import relational as rel
from lodestar.operators import statistics as st
from lodestar.plans import advisors, artefacts, driver, estimate, runner
from lodestar.plans.observe import observed
from lodestar.plans.workload import read_filter, read_queries, read_workload
from lodestar.queries import _HISTOGRAMS, _JOIN_SQL, LINEITEM_STAR, WORKLOADS, _priced, _rows, _with_order_bits, register, shared_path, star_frames, star_query, star_sql, table
from lodestar.sources import tables

_NATION = [("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")]


# Sources and sinks


@register("csv_scan", "SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def csv_scan(spark, sf_dir):
    path = shared_path(spark, "csv")
    table(spark, sf_dir, "nation").select(*(c for c, _ in _NATION)).write.csv(path, header=False, nullValue="")
    return tables.convert_csv(spark, path, tables.schema_of(_NATION), shared_path(spark, "parquet"))


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@register("tuple_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def tuple_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("row_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def row_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.lookup(table(spark, sf_dir, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@register("stats_restored", _HISTOGRAMS["equidepth"][1])
def stats_restored(spark, sf_dir):
    """A histogram that has been to the statistics' sidecar and back."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "statistics.json"
        runner.Statistics({"part": 1}, {}, {("part", "p_retailprice"): st.equi_depth(table(spark, sf_dir, "part"), "p_retailprice", 16)}).save(path)
        return _rows(spark, runner.Statistics.restored(path).histograms["part", "p_retailprice"])


@register("print_lines", "SELECT 'n_nationkey,n_name,n_regionkey' AS line UNION ALL SELECT concat_ws(',', coalesce(n_nationkey::VARCHAR, 'NULL'), coalesce(n_name, 'NULL'), coalesce(n_regionkey::VARCHAR, 'NULL')) FROM nation")
def print_lines(spark, sf_dir):
    lines = tables.print_rows(table(spark, sf_dir, "nation").select(*(c for c, _ in _NATION)))
    return spark.createDataFrame([(line,) for line in lines], "line string")


@register("drained", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
def drained(spark, sf_dir):
    counted, counter = observed(table(spark, sf_dir, "lineitem").where("l_quantity < 10"), "drained")
    tables.drain(counted)
    return spark.createDataFrame([(counter.get["rows"],)], "n long")


@register("appended", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def appended(spark, sf_dir):
    path, nation = shared_path(spark, "appended"), table(spark, sf_dir, "nation")
    tables.append(nation.select("n_nationkey", "n_name"), path)
    tables.append(nation.where("n_regionkey = 2").select("n_nationkey", "n_name"), path)
    return tables.read_parquet(spark, path)


@register("ddl_cycle", "SELECT 'created' AS step, count(*) AS n FROM nation UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'dropped', -1")
def ddl_cycle(spark, sf_dir):
    """A table made, emptied and dropped: its rows after each step, -1 if it isn't there."""
    name, nation = f"cycle_{uuid.uuid4().hex}", table(spark, sf_dir, "nation")
    tables.create_table(nation, name, shared_path(spark, name))
    steps = [("created", spark.table(name).count())]
    tables.clear_table(spark, name)
    steps.append(("cleared", spark.table(name).count()))
    tables.drop_table(spark, name)
    steps.append(("dropped", -1 if not spark.catalog.tableExists(name) else 0))
    return spark.createDataFrame(steps, "step string, n long")


@register("result_file", "SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def result_file(spark, sf_dir):
    found = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n"))
    with tempfile.TemporaryDirectory() as folder:
        runner.write_rows(Path(folder) / "results.csv", [r.asDict() for r in found.collect()])
        lines = (Path(folder) / "results.csv").read_text().splitlines()[1:]
    return spark.createDataFrame([(name, int(n)) for name, n in (x.rsplit(",", 1) for x in lines)], "name string, n long")


# Expressions


@register("literal_range", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 17")
def literal_range(spark, sf_dir):
    """A filter whose upper end is its literal plus a range."""
    filter_ = read_filter({"col": "p_size", "expr": "between", "val": "10", "range": 7}, "int")
    return rel.scan(table(spark, sf_dir, "part"), ["p_partkey"], [filter_])


@register("promotion", "SELECT p_partkey, p_size + p_retailprice AS whole_and_double, p_partkey + p_size AS long_and_int FROM part")
def promotion(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + F.col("p_retailprice")).alias("whole_and_double"), (F.col("p_partkey") + F.col("p_size")).alias("long_and_int"))


# Joins


@register("keyed_lookup", _JOIN_SQL)
def keyed_lookup(spark, sf_dir):
    """The looked-up side lies in buckets of its key."""
    lineitem = artefacts.keyed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "lineitem", 16)
    return lineitem.join(_priced(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@register("bloom_probe", "SELECT count(*) AS probe_in, count_if(l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000)) AS joined, true AS fewer, 0::BIGINT AS lost FROM lineitem")
def bloom_probe(spark, sf_dir):
    """What the filter lets through: fewer rows than there are, and every row that joins."""
    build, probe = table(spark, sf_dir, "orders").where("o_totalprice > 450000"), table(spark, sf_dir, "lineitem")
    words, n_bits = rel.key_filter(build, "o_orderkey", build.count())
    passed = rel.may_join(probe, "l_orderkey", words, n_bits)
    all_, some = probe.count(), passed.count()
    joined = passed.join(build, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count()
    lost = probe.join(build, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count() - joined
    return spark.createDataFrame([(all_, joined, some < all_, lost)], "probe_in long, joined long, fewer boolean, lost long")


# Statistics


@register("value_sample", "SELECT DISTINCT p_size AS value FROM part WHERE p_size IS NOT NULL")
def value_sample(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in st.value_sample(table(spark, sf_dir, "part"), "p_size")], "value int")


@register("part_index", f"WITH h AS ({_HISTOGRAMS['equidepth'][1]}) SELECT p AS literal, (greatest(count_if(lo <= p) - 1, 0))::INT AS bucket FROM h, (SELECT unnest([0.0, 905.5, 1000.25, 1200.0, 1500.0, 99999.0]::DOUBLE[]) AS p) GROUP BY p")
def part_index(spark, sf_dir):
    h = st.equi_depth(table(spark, sf_dir, "part"), "p_retailprice", 16)
    return spark.createDataFrame([(v, h.bucket(v)) for v in (0.0, 905.5, 1000.25, 1200.0, 1500.0, 99999.0)], "literal double, bucket int")


@register("hist_usage", _HISTOGRAMS["equidepth"][1].replace("count(*) AS f", "sum(p_size) AS f", 1))
def hist_usage(spark, sf_dir):
    """Equi-depth by a weight of the rows, here p_size, as by how often they were used."""
    return _rows(spark, st.equi_depth(table(spark, sf_dir, "part"), "p_retailprice", 16, weight="p_size"))


_USED = ["p_size < 10", "p_size BETWEEN 5 AND 20", "p_retailprice > 1500"]


@register("usage_log", f"SELECT p_size AS value, sum({' + '.join(f'({w})::INT' for w in _USED)})::BIGINT AS freq FROM part GROUP BY 1")
def usage_log(spark, sf_dir):
    """How often a log of scans has read the rows of each value."""
    log = spark.createDataFrame([(w,) for w in _USED], "predicate string")
    used = sum((F.expr(r["predicate"]).cast("long") for r in log.collect()), F.lit(0))
    return rel.frequencies(table(spark, sf_dir, "part").withColumn("usage", used), "p_size", "usage")


@register(
    "operator_counters",
    "SELECT (SELECT count(*) FROM orders) AS build_scan_in, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS build_in, (SELECT count(*) FROM lineitem) AS probe_scan_in, (SELECT count(*) FROM lineitem WHERE l_quantity < 25) AS probe_in, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000 AND l_quantity < 25) AS out, true AS timed",
)
def operator_counters(spark, sf_dir):
    """Rows into and out of each scan and the join, and whether the times of building and probing were taken."""
    from lodestar.plans.observe import join_counters

    found = join_counters(table(spark, sf_dir, "orders"), Filter("o_totalprice", "gt", (300000.0,)), "o_orderkey", table(spark, sf_dir, "lineitem"), Filter("l_quantity", "lt", (25.0,)), "l_orderkey")
    timed = found.pop("build_seconds") > 0 and found.pop("probe_seconds") > 0
    return spark.createDataFrame([(*found.values(), timed)], f"{', '.join(f'{k} long' for k in found)}, timed boolean")


# Key summaries


@register("ks_reset", "SELECT count(*) AS n, 0::BIGINT AS bits FROM lineitem")
def ks_reset(spark, sf_dir):
    lineitem, summary = _with_order_bits(spark, sf_dir)
    return ks.reset(lineitem).agg(F.count("*").alias("n"), F.bit_or("ks").alias("bits"))


_CONJUNCT = (Filter("o_totalprice", "gt", (100000.0,)), Filter("o_totalprice", "lt", (120000.0,)))


@register("ks_conjunct", "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 100000 AND o_totalprice < 120000")
def ks_conjunct(spark, sf_dir):
    """Two filters on the summarised column: a row must share bits with both masks together."""
    lineitem, summary = _with_order_bits(spark, sf_dir)
    left = ks.reduced(lineitem, [(summary, ks.Conjunction(_CONJUNCT))])
    orders = rel.scan(table(spark, sf_dir, "orders"), ["o_orderkey"], _CONJUNCT)
    return left.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("n"))


@register("ks_probe", "SELECT count(*) AS rows_in, true AS a_third_at_most, 0::BIGINT AS lost FROM lineitem")
def ks_probe(spark, sf_dir):
    """How many rows survive the check of a narrow filter, and that no row which joins is among the others."""
    lineitem, summary = _with_order_bits(spark, sf_dir)
    filter_ = Filter("o_totalprice", "between", (100000.0, 120000.0))
    kept = ks.reduced(lineitem, [(summary, filter_)])
    orders = table(spark, sf_dir, "orders").where(filter_.column())
    joins = lambda df: df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count()
    return spark.createDataFrame([(lineitem.count(), kept.count() * 3 <= lineitem.count(), joins(lineitem) - joins(kept))], "rows_in long, a_third_at_most boolean, lost long")


@register("ks_rank", "WITH s AS (SELECT 'price' AS name, count_if(o_totalprice > 300000) * 0.5::DOUBLE AS s FROM orders UNION ALL SELECT 'priority', count_if(o_orderpriority < '2') * 0.25::DOUBLE FROM orders) SELECT name, floor(s / (SELECT sum(s) FROM s) * 62)::INT AS bits FROM s WHERE floor(s / (SELECT sum(s) FROM s) * 62) >= 2")
def ks_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_totalprice") > 300000).alias("price"), F.count_if(F.col("o_orderpriority") < "2").alias("priority")).first()
    ranked = advisors.rank_filters({"price": (float(orders["price"]), 1.0, 1.0, 0.5), "priority": (float(orders["priority"]), 1.0, 0.5, 0.5)})
    return spark.createDataFrame(list(ranked.items()), "name string, bits int")


# Estimates


@register(
    "selectivity_scan",
    "SELECT 'eq' AS expr, avg((n_regionkey = 2)::INT)::DOUBLE AS share FROM nation UNION ALL SELECT 'between', avg((n_nationkey BETWEEN 3 AND 12)::INT)::DOUBLE FROM nation UNION ALL SELECT 'in', avg((n_nationkey IN (1, 5))::INT)::DOUBLE FROM nation",
)
def selectivity_scan(spark, sf_dir):
    """The share of a sample that passes; a table of under 1,000 rows is its own sample."""
    nation = tables.sample(table(spark, sf_dir, "nation"), 25)
    filters = {"eq": Filter("n_regionkey", "eq", (2,)), "between": Filter("n_nationkey", "between", (3, 12)), "in": Filter("n_nationkey", "in", (1, 5))}
    seen = nation.agg(F.count("*").alias("n"), *(F.count_if(f.column()).alias(k) for k, f in filters.items())).first()
    return spark.createDataFrame([(k, estimate.scan_selectivity(seen[k], seen["n"], [f], {})) for k, f in filters.items()], "expr string, share double")


_SHARES = {"lt": ((1000.0,), "lo <= 1000"), "ge": ((1500.0,), "hi >= 1500"), "between": ((1000.0, 1200.0), "hi >= 1000 AND lo <= 1200"), "eq": ((1234.5,), "hi >= 1234.5 AND lo <= 1234.5")}


@register("selectivity_filter", f"WITH h AS ({_HISTOGRAMS['equidepth'][1]}) " + " UNION ALL ".join(f"SELECT '{k}' AS expr, round(coalesce(sum(card) FILTER ({w}), 0) / sum(card)::DOUBLE, 12) AS share FROM h" for k, (_, w) in _SHARES.items()))
def selectivity_filter(spark, sf_dir):
    h = st.equi_depth(table(spark, sf_dir, "part"), "p_retailprice", 16)
    return spark.createDataFrame([(k, round(estimate.filter_selectivity(Filter("p_retailprice", k, v), h), 12)) for k, (v, _) in _SHARES.items()], "expr string, share double")


_ROWS = "SELECT (SELECT count(*) FROM lineitem)::DOUBLE AS l, (SELECT count(*) FROM orders)::DOUBLE AS o, (SELECT count(*) FROM part)::DOUBLE AS p, (SELECT count(*) FROM supplier)::DOUBLE AS s"


def _star_rows(spark, sf_dir) -> dict[str, float]:
    return {t: float(df.count()) for t, df in star_frames(spark, sf_dir).items()}


@register("join_sizes", f"WITH r AS ({_ROWS}) SELECT least(l, o) AS to_one, least(l / 4, o / 2) * 8 AS to_many FROM r")
def join_sizes(spark, sf_dir):
    rows = _star_rows(spark, sf_dir)
    return spark.createDataFrame([(estimate.join_size(rows["lineitem"], rows["orders"], 1.0, 1.0, False), estimate.join_size(rows["lineitem"], rows["orders"], 4.0, 2.0, True))], "to_one double, to_many double")


@register("plan_costs", f"WITH r AS ({_ROWS}) SELECT 'orders' AS first, round(0.1 * (l + o + p) + least(l / 2, o) + least(least(l / 2, o), p), 6) AS cost FROM r UNION ALL SELECT 'part', round(0.1 * (l + o + p) + least(l / 2, p) + least(least(l / 2, p), o), 6) FROM r")
def plan_costs(spark, sf_dir):
    """A tenth of every table and every join's output, for both orders of two joins."""
    rows = _star_rows(spark, sf_dir)
    scans = rows | {"lineitem": rows["lineitem"] / 2}
    cost = lambda order: round(estimate.plan_cost(scans, rows, LINEITEM_STAR, order, {})[0], 6)
    return spark.createDataFrame([(a, cost([a, b])) for a, b in (("orders", "part"), ("part", "orders"))], "first string, cost double")


@register("best_order", f"WITH r AS ({_ROWS}) SELECT k AS place, CASE WHEN (k = 0) = (least(l, p) < least(l, o)) THEN 'part' ELSE 'orders' END AS name FROM r, (SELECT unnest([0, 1]) AS k)")
def best_order(spark, sf_dir):
    rows = _star_rows(spark, sf_dir)
    order = estimate.best_order(star_query(["lineitem", "orders", "part"]), LINEITEM_STAR, rows, rows, {})
    return spark.createDataFrame(list(enumerate(order)), "place int, name string")


@register("view_sizes", f"WITH r AS ({_ROWS}) SELECT 'orders' AS view, least(l, o) AS n, (least(l, o) * (8 * 3 + 8 + 8 + 8))::BIGINT AS bytes FROM r UNION ALL SELECT 'part', least(l, p), (least(l, p) * (8 * 3 + 8 + 8 + 4))::BIGINT FROM r")
def view_sizes(spark, sf_dir):
    rows, out = _star_rows(spark, sf_dir), []
    for t in ("orders", "part"):
        n = estimate.view_rows(rows, LINEITEM_STAR, [t], {})
        out.append((t, n, estimate.view_size(n, LINEITEM_STAR, {x: list(LINEITEM_STAR.tables[x].columns) for x in ("lineitem", t)})))
    return spark.createDataFrame(out, "view string, n double, bytes long")


@register("view_costs", f"WITH r AS ({_ROWS}) SELECT 'none' AS view, round(0.1 * (l + o + p) + least(l, o) + least(least(l, o), p), 6) AS cost FROM r UNION ALL SELECT 'orders', round(0.1 * (least(l, o) + p) + least(least(l, o), p), 6) FROM r UNION ALL SELECT 'orders+part', round(0.1 * least(least(l, o), p), 6) FROM r")
def view_costs(spark, sf_dir):
    rows = _star_rows(spark, sf_dir)
    views = {"none": (), "orders": ("orders",), "orders+part": ("orders", "part")}
    return spark.createDataFrame([(k, round(estimate.view_cost(v, rows, rows, LINEITEM_STAR, ["orders", "part"], {}), 6)) for k, v in views.items()], "view string, cost double")


@register("materialised_volume", f"WITH r AS ({_ROWS}) SELECT o + p + least(l, o) + least(least(l, o), p) AS n FROM r")
def materialised_volume(spark, sf_dir):
    rows = _star_rows(spark, sf_dir)
    outs = estimate._steps(rows, LINEITEM_STAR, ["orders", "part"], {}, "top")
    return spark.createDataFrame([(estimate.materialised_volume([rows["orders"], rows["part"]], outs[1:]),)], "n double")


@register("join_kinds", f"WITH r AS ({_ROWS}), s AS (SELECT *, l / 1000 AS f FROM r) SELECT 'orders' AS name, CASE WHEN 2 * f * greatest(1, least(f, o) / f) < 0.1 * o + least(f, o) THEN 'lookup' ELSE 'hash' END AS kind FROM s UNION ALL SELECT 'part', 'hash'")
def join_kinds(spark, sf_dir):
    """Few rows of the central table: a keyed table is looked up where that costs less; one without a keyed layout is hashed."""
    rows = _star_rows(spark, sf_dir)
    scans = rows | {"lineitem": rows["lineitem"] / 1000}
    return spark.createDataFrame(list(estimate.join_kinds(scans, rows, LINEITEM_STAR, ["orders", "part"], {}, ["orders"]).items()), "name string, kind string")


# Advisors


@register("layout_sizes", f"WITH r AS ({_ROWS}) SELECT 'orders' AS name, (8 * (l + o))::BIGINT AS bytes, greatest(0, 0.1 * o + o - 2 * (l / 100) * greatest(1, o / (l / 100))) AS saved FROM r")
def layout_sizes(spark, sf_dir):
    rows = _star_rows(spark, sf_dir)
    size = advisors.layout_size(int(rows["orders"]), int(rows["lineitem"]))
    return spark.createDataFrame([("orders", size, advisors.layout_savings(0.1 * rows["orders"] + rows["orders"], 0.0, rows["lineitem"] / 100, rows["orders"]))], "name string, bytes long, saved double")


@register(
    "advise_layouts",
    f"WITH r AS ({_ROWS}), c AS (SELECT 'orders' AS name, 8 * (l + o) AS size, o AS saved, 8 * (2 * l + o + p) AS budget FROM r UNION ALL SELECT 'part', 8 * (l + p), p, 8 * (2 * l + o + p) FROM r UNION ALL SELECT 'supplier', 8 * (l + s), s, 8 * (2 * l + o + p) FROM r), t AS (SELECT *, sum(size) OVER (ORDER BY saved / size DESC) AS taken FROM c) SELECT name FROM t WHERE taken <= budget",
)
def advise_layouts(spark, sf_dir):
    """By savings for each byte, as far as the budget goes."""
    rows = {t: int(n) for t, n in _star_rows(spark, sf_dir).items()}
    savings = [(t, advisors.layout_size(rows[t], rows["lineitem"]), float(rows[t])) for t in ("orders", "part", "supplier")]
    return spark.createDataFrame([(t,) for t in advisors.choose_layouts(savings, 8 * (2 * rows["lineitem"] + rows["orders"] + rows["part"]))], "name string")


@register("advise_views", f"WITH r AS ({_ROWS}), c AS (SELECT 'orders' AS name, (l - o) / l / (48 * l) AS gain FROM r UNION ALL SELECT 'part', (l - p) / l / (44 * l) FROM r) SELECT name FROM c ORDER BY gain DESC LIMIT 1")
def advise_views(spark, sf_dir):
    """The view of the largest relative savings for each byte; the other would cost more than it by then."""
    rows = _star_rows(spark, sf_dir)
    costs = {("orders", "q"): rows["orders"], ("part", "q"): rows["part"]}
    sizes = {"orders": int(48 * rows["lineitem"]), "part": int(44 * rows["lineitem"])}
    return spark.createDataFrame([(v,) for v in advisors.choose_views({"q": rows["lineitem"]}, costs, sizes, 1 << 40)], "name string")


@register("view_candidates", "SELECT unnest(['orders', 'part', 'orders+part', 'part+supplier']) AS view")
def view_candidates(spark, sf_dir):
    found = advisors.view_candidates([("orders", "part"), ("part", "supplier")])
    return spark.createDataFrame([("+".join(v),) for v in found], "view string")


@register(
    "advise_bits",
    "WITH l AS (SELECT count(*)::DOUBLE AS n FROM lineitem), e AS (SELECT 'orders' AS source, 'o_totalprice' AS \"column\", (1 - avg((o_totalprice > 300000)::INT)) * (SELECT n FROM l) AS e FROM orders UNION ALL SELECT 'part', 'p_size', (1 - avg((p_size < 10)::INT)) * (SELECT n FROM l) FROM part), s AS (SELECT *, floor(e / sum(e) OVER () * 32)::INT AS b, row_number() OVER (ORDER BY e DESC, source) AS k FROM e), f AS (SELECT source, \"column\", k, (b + CASE WHEN k = 1 THEN 32 - sum(b) OVER () ELSE 0 END)::INT AS bits FROM s) SELECT source, \"column\", 'lineitem' AS target, bits, (sum(bits) OVER (ORDER BY k) - bits)::INT AS \"offset\" FROM f",
)
def advise_bits(spark, sf_dir):
    """32 bits of lineitem shared among the filters of two queries by the rows that they may prune."""
    rows, share = _star_rows(spark, sf_dir), {}
    share["orders"] = table(spark, sf_dir, "orders").agg(F.avg((F.col("o_totalprice") > 300000).cast("int"))).first()[0]
    share["part"] = table(spark, sf_dir, "part").agg(F.avg((F.col("p_size") < 10).cast("int"))).first()[0]
    uses = [advisors.Use(f"q_{t}", t, c, "lineitem", share[t], int(rows[t]), int(rows["lineitem"]), rows["lineitem"]) for t, c in (("orders", "o_totalprice"), ("part", "p_size"))]
    return spark.createDataFrame(advisors.place_bits(uses, 32), "source string, column string, target string, bits int, offset int")


@register("speedups", "SELECT 'summary' AS mode, 2.0::DOUBLE AS p25, 2.0::DOUBLE AS median, 4.0::DOUBLE AS p75, round(10.0 / 4.0, 6)::DOUBLE AS total")
def speedups(spark, sf_dir):
    found = advisors.speedups({"default": {"a": 2.0, "b": 4.0, "c": 4.0}, "summary": {"a": 1.0, "b": 2.0, "c": 1.0}})
    return spark.createDataFrame([(m, s["p25"], s["median"], s["p75"], round(s["total"], 6)) for m, s in found.items()], "mode string, p25 double, median double, p75 double, total double")


# The workload driver


def _times(counts: str) -> str:
    return f"SELECT query, mode, n FROM ({counts}), (SELECT unnest({list(driver.MODES)}) AS mode)"


_RUN = {f"star_{len(t)}": t for t in (["lineitem", "orders"], ["lineitem", "orders", "part"], ["lineitem", "orders", "part", "supplier"])}


@register("workload_run", _times(" UNION ALL ".join(f"SELECT '{k}' AS query, n FROM ({star_sql(t)})" for k, t in _RUN.items())))
def workload_run(spark, sf_dir):
    """Statistics, advice under the budget, what it has built, and every query in every mode."""
    workload = replace(LINEITEM_STAR, budget=64, embedding_size=32)
    queries = {k: replace(star_query(t), name=k) for k, t in _RUN.items()}
    frames = {t: table(spark, sf_dir, t).select(*LINEITEM_STAR.tables[t].columns) for t in LINEITEM_STAR.tables}
    with tempfile.TemporaryDirectory() as folder:
        rows = driver.run(spark, workload, queries, folder, frames)
    return spark.createDataFrame([(r["query"], r["mode"], r["n"]) for r in rows], "query string, mode string, n long")


@register("workload_toml", _times("SELECT 'star_count' AS query, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey WHERE c_nationkey >= 3 AND c_nationkey < 12 AND o_totalprice > 100000 AND value < 50"))
def workload_toml(spark, sf_dir):
    workload = read_workload(WORKLOADS / "customer_star.toml")
    frames = {t: table(spark, sf_dir, t).select(*workload.tables[t].columns) for t in workload.tables}
    with tempfile.TemporaryDirectory() as folder:
        rows = driver.run(spark, workload, read_queries(WORKLOADS / "customer_queries.toml", workload), folder, frames)
    return spark.createDataFrame([(r["query"], r["mode"], r["n"]) for r in rows], "query string, mode string, n long")
