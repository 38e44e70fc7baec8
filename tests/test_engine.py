"""Closed-form expectations, and properties of statistics, summaries, plans and advisors."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter, Parameter, conjunction
from lodestar.operators import key_summary as ks
from lodestar.operators import relational as rel
from lodestar.operators import statistics as stats
from lodestar.plans import advisors, driver, estimate, runner, star
from lodestar.plans.observe import observed
from lodestar.plans.workload import read_queries, read_workload
from lodestar.queries import LINEITEM_STAR, WORKLOADS, star_frames, star_query
from lodestar.sources import tables
from lodestar.streaming.summaries import summary_stream

N = 10_000
TEXT = [c * 3 for c in "abcdefghij"]
DOUBLES = [0.37, 0.73, 3.7, 7.3, 0.037, 0.073, 0.0037, 0.0073, 0.00037, 0.00073]


@pytest.fixture(scope="module")
def numbers(spark):
    place = F.col("id") % 10 + 1
    return spark.range(N).select(
        F.col("id").alias("int64"),
        (F.col("id") % 10).cast("int").alias("int32"),
        F.element_at(F.array(*map(F.lit, TEXT)), place.cast("int")).alias("varchar"),
        F.element_at(F.array(*map(F.lit, DOUBLES)), place.cast("int")).alias("float64"),
        F.date_add(F.lit(date(1993, 1, 1)), (F.col("id") % 10).cast("int")).alias("date"),
    ).cache()


@pytest.mark.parametrize(
    ("filters", "rows"),
    [
        ([], N),
        ([Filter("int64", "lt", (N // 10,)), Filter("int32", "eq", (5,))], N // 100),
        ([Filter("date", "eq", (date(1993, 1, 4),))], N // 10),
        ([Filter("varchar", "lt", ("fff",))], N // 2),
        ([Filter("int32", "between", (2, 5), False, False)], N // 5),
        ([Filter("int32", "in", (1, 2, 11))], N // 5),
        ([Filter("int32", "not_null")], N),
    ],
)
def test_scans(numbers, filters, rows):
    assert rel.scan(numbers, ["int64"], filters).count() == rows


def test_parameters(numbers):
    filter_ = Filter("int32", "lt", (Parameter("u"),))
    assert [numbers.where(filter_.bound({"u": u}).column()).count() for u in (1, 5, 9)] == [N // 10, N // 2, 9 * N // 10]
    with pytest.raises(ValueError, match="no such predicate"):
        Filter("int32", "like", ("a",)).column()


def test_null_semantics(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0), (2, None)], "k int, v double")
    assert df.where(conjunction([Filter("k", "ne", (1,))])).count() == 1
    row = rel.aggregate(df, [], [("k", "count", "n"), ("v", "sum", "s"), ("v", "min", "m")]).first()
    assert tuple(row) == (2, 5.0, 2.0)
    empty = rel.aggregate(df.where("k > 5"), [], [("k", "count", "n"), ("v", "max", "m")]).collect()
    assert [tuple(r) for r in empty] == [(0, None)]


def test_aggregates(numbers):
    half = numbers.where("int32 < 5")
    row = rel.aggregate(half, [], [("int64", "count", "n"), ("int64", "max", "hi"), ("int32", "sum", "s"), ("varchar", "max", "t"), ("float64", "sum", "f")]).first()
    assert tuple(row)[:4] == (N // 2, N - 6, float(N), "eee") and abs(row["f"] - N / 10 * sum(DOUBLES[:5])) < 1e-6
    groups = rel.aggregate(half, ["varchar"], [("int64", "count", "n"), ("int64", "min", "low")])
    assert tuple(rel.aggregate(groups, [], [("n", "count", "groups"), ("n", "sum", "n"), ("low", "sum", "low")]).first()) == (5, N / 2, 10.0)


def test_sorting(numbers):
    rows = numbers.where("int64 < 1000").orderBy(F.desc("int32"), F.asc("int64")).select("int32", "int64").collect()
    assert rows == sorted(rows, key=lambda r: (-r.int32, r.int64)) and len(rows) == 1000
    assert [r.int64 for r in rel.top_k(numbers, [F.desc("int64")], 3).collect()] == [N - 1, N - 2, N - 3]


def test_joins_by_nested_loops(spark):
    rule = lambda n: spark.range(n).select((F.col("id") % 210).alias("k"), (F.col("id") % 10).cast("int").alias("i"), F.concat(F.lit("t"), F.col("id") % 10).alias("t"))
    build, probe = rule(210).toDF("k", "i", "t"), rule(420).toDF("pk", "pi", "pt")
    for keys in (["k"], ["k", "i"], ["t"], ["t", "i", "k"]):
        loop = probe.crossJoin(build).where(" AND ".join(f"{x} = p{x}" for x in keys))
        assert rel.inner_join(build, probe, keys, ["p" + x for x in keys]).count() == loop.count()
        assert rel.semi_join(build, probe, keys, ["p" + x for x in keys]).count() == loop.select("k").distinct().count()
    assert rel.bloom_join(build, probe, "k", "pk", 210).count() == 420


def test_statistics(spark, numbers):
    h = stats.equi_depth(numbers, "int32")
    assert h.lows == h.highs == tuple(range(10)) and set(h.counts) == {N // 10}
    bits = numbers.select("int32", h.bit_column("int32", 5, 30).alias("bit")).distinct().collect()
    assert all(r.bit == 30 + r.int32 // 2 == h.bit(h.bucket(r.int32), 5, 30) for r in bits)
    profile = {r["col"]: r for r in stats.profile(numbers, ["int64", "int32"], ["int64"]).collect()}
    assert (profile["int32"].ndv, profile["int32"].max_freq, profile["int64"].ndv) == (10, N // 10, N)
    assert stats.value_sample(numbers, "int32") == list(range(10))
    assert stats.Histogram.from_json(h.to_json()) == h


@pytest.mark.parametrize("make", [stats.equi_depth, stats.equi_width, stats.max_diff, stats.compressed])
@pytest.mark.parametrize("heavy", [None, 0, 500])
def test_histograms(spark, make, heavy):
    df = spark.range(1000).select(F.col("id").alias("v"))
    if heavy is not None:
        df = df.unionAll(spark.range(1000).select(F.lit(heavy).cast("long").alias("v")))
    h = make(df, "v", 10)
    assert 1 <= len(h.lows) <= 21 and h.lows[0] == 0 and h.highs[-1] == 999 and sum(h.counts) == df.count()
    assert all(a <= b for a, b in zip(h.lows, h.highs, strict=True)) and all(b < a for b, a in zip(h.highs, h.lows[1:], strict=False))
    for k, (low, high) in enumerate(zip(h.lows, h.highs, strict=True)):
        assert h.bucket(low) == h.bucket(high) == h.bucket((low + high) // 2) == k
    assert h.bucket(-5) == 0 and h.bucket(5000) == len(h.lows) - 1
    if make is stats.compressed and heavy is not None:
        assert (heavy, heavy) in list(zip(h.lows, h.highs, strict=True))


def test_histograms_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRIVER_VALUES", 100)
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("v"), F.format_string("%06d", "id").alias("t"), F.date_add(F.lit(date(1900, 1, 1)), F.col("id").cast("int")).alias("d"))
    df = df.unionAll(df.where("v = 77").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("n"))
    for c in ("v", "t", "d"):
        h = stats.equi_depth(df, c, 8)
        low, high = df.agg(F.min(c), F.max(c)).first()
        assert sum(h.counts) == 2 * n and (h.lows[0], h.highs[-1]) == (low, high)
        assert all(a <= b for a, b in zip(h.lows, h.highs, strict=True)) and all(b < a for b, a in zip(h.highs, h.lows[1:], strict=False))
        found = df.groupBy(h.bucket_column(c).alias("k")).count().orderBy("k").collect()
        assert [r["count"] for r in found] == list(h.counts)
        assert sorted(h.counts)[-2] < n // 2 and stats.Histogram.from_json(h.to_json()) == h


def test_summary_bits(spark):
    probe = spark.range(4096).select((F.col("id") % 2048).cast("int").alias("fk"), F.when(F.col("id") < 2048, F.col("id")).otherwise(4095 - F.col("id")).cast("int").alias("filter"))
    h = stats.Histogram(tuple(range(0, 2048, 32)), tuple(range(31, 2048, 32)), (64,) * 64)
    for bits, offset in ((16, 0), (16, 32)):
        summary = ks.Summary("probe", "filter", "build", h, bits, offset)
        for r in ks.build(probe, "fk", summary).collect():
            assert r.bits == 1 << (r.key // 32 // (64 // bits) + offset) | 1 << ((2047 - r.key) // 32 // (64 // bits) + offset)


@given(st.lists(st.integers(-5, 105), min_size=1, max_size=2), st.sampled_from(["eq", "lt", "le", "gt", "ge", "between", "in"]), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_masks_miss_nothing(values, expr, bits):
    lows = (0, 3, 10, 11, 40, 41, 77, 90)
    summary = ks.Summary("s", "v", "t", stats.Histogram(lows, lows, (1,) * 8), bits)
    values = (values * 2)[:2] if expr == "between" else values if expr == "in" else values[:1]
    mask = summary.mask(Filter("v", expr, tuple(values)))
    for x in range(-6, 107):
        passes = {"eq": x == values[0], "lt": x < values[0], "le": x <= values[0], "gt": x > values[0], "ge": x >= values[0], "between": values[0] <= x <= values[-1], "in": x in values}[expr]
        if passes:
            assert mask >> summary.histogram.bit(summary.histogram.bucket(x), bits, 0) & 1
    assert summary.mask(Filter("v", "ne", (1,))) is None and summary.mask(Filter("w", "eq", (1,))) is None


def test_reduced_plans_keep_all_answers(spark):
    """Rows kept include all rows that join, with nulls on either side, and fewer rows reach the join."""
    source = spark.createDataFrame([(k % 50 if k % 7 else None, k if k % 5 else None) for k in range(400)], "key int, v int")
    target = spark.createDataFrame([(k if k % 9 else None,) for k in range(100)], "id int")
    summary = ks.Summary("source", "v", "target", stats.equi_depth(source, "v", 32), 16)
    with_bits = ks.attach(target, "id", ks.build(source, "key", summary))
    for filter_ in (Filter("v", "lt", (60,)), Filter("v", "eq", (33,)), Filter("v", "between", (100, 120)), Filter("v", "in", (1, 399))):
        kept = ks.reduced(with_bits, [(summary, filter_)])
        plain = target.join(source.where(filter_.column()), F.col("id") == F.col("key"))
        assert kept.join(source.where(filter_.column()), F.col("id") == F.col("key")).count() == plain.count()
        assert kept.count() < target.count()
    stale = ks.Summary("source", "v", "target", summary.histogram, 16, version="1")
    with pytest.raises(ValueError, match="version"):
        ks.reduced(with_bits, [(stale, filter_)], {"source": "2"})
    assert ks.reset(with_bits).where("ks <> 0").count() == 0


def test_orders_views_and_counters(spark, tmp_path):
    frames = star_frames(spark, "/root/testdata/sf0.001")
    query = star_query(["lineitem", "orders", "part", "supplier"])
    answers = {star.star_join(LINEITEM_STAR, query, frames, order).first()["n"] for order in star.join_orders(LINEITEM_STAR, query)}
    assert len(answers) == 1
    view = star.build_view(LINEITEM_STAR, ["orders", "part"], frames, str(tmp_path / "view"))
    assert star.from_view(LINEITEM_STAR, query, view, ["orders", "part"], frames).first()["n"] in answers
    scans = {"lineitem": 30_000, "orders": 5_000, "part": 20, "supplier": 50}
    rows = {"lineitem": 60_000, "orders": 15_000, "part": 2_000, "supplier": 100}
    best = estimate.best_order(query, LINEITEM_STAR, scans, rows, {})
    assert best[0] == "part" and star.star_join(LINEITEM_STAR, query, frames, best).first()["n"] in answers
    counted, counter = observed(frames["part"], "parts")
    tables.drain(counted)
    assert counter.get["rows"] == frames["part"].count()


def test_filters_reach_the_scan(spark):
    plan = star.star_join(LINEITEM_STAR, star_query(["lineitem", "part"]), star_frames(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "LessThan(l_quantity,25.0)" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_estimates():
    h = stats.Histogram((0, 10, 20), (9, 19, 29), (10, 10, 20))
    assert estimate.filter_selectivity(Filter("v", "between", (5, 12)), h) == 0.5
    assert estimate.filter_selectivity(Filter("v", "eq", (25,)), h) == 0.5
    assert estimate.scan_selectivity(0, 100, [Filter("v", "eq", (25,)), Filter("v", "lt", (5,))], {"v": h}) == 0.125
    assert estimate.join_size(100, 50, 1, 1, False) == 50
    assert estimate.join_size(100, 50, 2, 5, True) == 100


def test_advisors():
    assert advisors.choose_layouts([("a", 10, 5.0), ("b", 10, 9.0), ("a", 10, 5.0), ("c", 5, 0.0)], 15) == ["a"]
    assert advisors.view_candidates([["x", "y"], ["y", "x"]]) == [("x",), ("y",), ("x", "y")]
    assert advisors.choose_views({"q": 100.0, "r": 100.0}, {("v", "q"): 10.0, ("v", "r"): 90.0, ("w", "q"): 20.0, ("w", "r"): 20.0}, {"v": 5, "w": 5}, 5) == ["w"]
    uses = [advisors.Use("q1", "orders", "price", "lineitem", 0.1, 1000, 4000, 4000.0), advisors.Use("q2", "part", "size", "lineitem", 0.5, 200, 4000, 4000.0)]
    placed = advisors.place_bits(uses, 16)
    assert [p[:3] for p in placed] == [("orders", "price", "lineitem"), ("part", "size", "lineitem")]
    assert sum(p[3] for p in placed) == 16 and placed[0][3] > placed[1][3] and placed[1][4] == placed[0][3]
    assert advisors.rank_filters({"a": (1, 1, 1, 1), "b": (1, 1, 1, 0.01)}) == {"a": 61}
    assert advisors.speedups({"default": {"q": 2.0}, "ks": {"q": 1.0}})["ks"]["total"] == 2.0


def test_toml(tmp_path):
    workload = read_workload(WORKLOADS / "customer_star.toml")
    query = read_queries(WORKLOADS / "customer_queries.toml", workload)["star_count"]
    assert workload.tables["orders"].links == ("o_custkey", "c_custkey") and workload.tables["orders"].to_many
    assert query.count and query.scans["customer"].filters == (Filter("c_nationkey", "between", (3, 12), True, False),)
    bad = (WORKLOADS / "customer_star.toml").read_text().replace(', foreign = "customer.c_custkey"', "")
    (tmp_path / "bad.toml").write_text(bad)
    with pytest.raises(ValueError, match="no key"):
        read_workload(tmp_path / "bad.toml")
    sampled = '[queries.s]\ntype = "scan"\ntable = "orders"\n[[queries.s.filters]]\ncol = "o_totalprice"\nexpr = "in"\nnum_ins = 2\n'
    (tmp_path / "q.toml").write_text(sampled)
    read = lambda: read_queries(tmp_path / "q.toml", workload, {("orders", "o_totalprice"): [1.0, 2.0, 3.0]})["s"]
    assert read() == read() and len(read().scans["orders"].filters[0].values) == 2


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,abc,1996-01-02,0.5\n2,,,\n")
    schema = tables.schema_of([("id", "bigint"), ("t", "text"), ("d", "date"), ("x", "double")])
    rows = tables.convert_csv(spark, str(tmp_path / "t.csv"), schema, str(tmp_path / "t.parquet")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "abc", date(1996, 1, 2), 0.5), (2, None, None, None)]
    assert tables.print_rows(spark.createDataFrame([(1, None)], "a int, b int")) == ["a,b", "1,NULL"]
    with pytest.raises(ValueError, match="unknown types"):
        tables.schema_of([("p", "pointer")])


def test_summary_stream(spark, tmp_path):
    schema = "key int, v int"
    spark.createDataFrame([(1, 5), (2, 95)], schema).write.parquet(str(tmp_path / "in"))
    summary = ks.Summary("s", "v", "t", stats.Histogram((0, 50), (49, 99), (1, 1)), 2)
    stream = summary_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", summary)
    query = stream.writeStream.outputMode("update").format("memory").queryName("bits").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    spark.createDataFrame([(1, 99)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert {r.key: r.m for r in spark.sql("SELECT key, max(bits) AS m FROM bits GROUP BY key").collect()} == {1: 3, 2: 2}


def test_view_and_lookup_costs():
    workload = read_workload(WORKLOADS / "customer_star.toml")
    rows = {"customer": 100.0, "orders": 1000.0, "events": 500.0}
    scans, order = {"customer": 50.0, "orders": 200.0, "events": 500.0}, ["orders", "events"]
    freq = {"orders": estimate.Link(10, 10, 10), "events": estimate.Link(5, 5, 5)}
    cost, out = estimate.plan_cost(scans, rows, workload, order, freq)
    assert (cost, out) == (0.1 * 1600 + 200 + 1000, 1000)
    assert estimate.view_rows(rows, workload, ["orders"], freq) == 1000
    assert estimate.view_cost(["orders"], scans, rows, workload, order, freq) == 0.1 * (1000 + 500) + 1000
    assert estimate.view_cost(["events"], scans, rows, workload, order, freq) == cost
    assert estimate.best_view([["events"], ["orders"]], scans, rows, workload, order, freq) == ("orders",)
    assert estimate.best_view([["events"]], scans, rows, workload, order, freq) == ()
    assert estimate.view_size(10, workload, {"customer": ["c_custkey"]}) == 80
    assert estimate.join_kinds(scans | {"customer": 2.0}, rows, workload, ["orders"], freq, ["orders"]) == {"orders": "lookup"}
    assert estimate.join_kinds(scans, rows, workload, ["orders"], freq, []) == {"orders": "hash"}


def test_running_a_workload(spark, tmp_path):
    workload = read_workload(WORKLOADS / "customer_star.toml")
    queries = read_queries(WORKLOADS / "customer_queries.toml", workload)
    frames = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in workload.tables}
    found = runner.gather(workload, queries.values(), frames, 16)
    found.save(tmp_path / "statistics.json")
    assert runner.Statistics.restored(tmp_path / "statistics.json") == found
    query = queries["star_count"]
    expected = star.star_join(workload, query, frames).first().n
    plan = runner.choose(workload, query, frames, found, keyed=["orders", "events"])
    assert sorted(plan.order) == ["events", "orders"] and plan.cost > 0
    assert runner.planned(workload, query, frames, plan).first().n == expected
    needed = {t: frames[t].select(*workload.tables[t].columns) for t in frames}
    views = {(plan.order[0],): star.build_view(workload, [plan.order[0]], needed, str(tmp_path / "view"))}
    by_view = runner.choose(workload, query, frames, found, list(views))
    assert runner.planned(workload, query, frames, runner.Plan(plan.order, next(iter(views))), views).first().n == expected
    assert by_view.cost <= plan.cost
    uses = runner.advisor_uses(workload, queries.values(), frames, found)
    assert {(u.source, u.target) for u in uses if u.query == "star_count"} >= {("customer", "orders"), ("orders", "events")}
    assert all(0 <= u.selectivity <= 1 for u in uses) and advisors.place_bits(uses, 32)
    runner.write_rows(tmp_path / "costs.csv", [{"query": "star_count", "cost": plan.cost}])
    assert (tmp_path / "costs.csv").read_text().splitlines()[0] == "query,cost"


def test_link_path():
    links = [("region", "nation"), ("nation", "customer"), ("customer", "orders"), ("orders", "lineitem")]
    assert star.link_path(links, "region", "orders") == ["region", "nation", "customer", "orders"]
    assert star.link_path(links, "region", "part") is None


def test_bits_take_a_comparison_each(spark):
    """Not one for each bucket: with 63 of them a summary of 9 million keys took 17 s."""
    rows = spark.range(-5, 1100).select(F.col("id").cast("double").alias("x"))
    for n in (1, 2, 5, 64):
        h = stats.Histogram(tuple(16.0 * k for k in range(n)), tuple(16.0 * k + 15 for k in range(n)), (16,) * n)
        for bits in (1, 7, 25, 62):
            column = h.bit_column("x", bits, 3)
            assert column._jc.toString().count(">=") < bits
            assert all(r.bit == h.bit(h.bucket(r.x), bits, 3) for r in rows.select("x", column.alias("bit")).collect())


def test_views_begin_with_smaller_ones(spark, tmp_path, monkeypatch):
    """Of (a), (b) and (a, b), the last joins only what the other lacks, and has the same rows and columns."""
    frames = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(*c.columns) for t, c in LINEITEM_STAR.tables.items()}
    found = runner.Statistics({t: df.count() for t, df in frames.items()}, {})
    bases, make = {}, star.build_view

    def watched(workload, tables, frames, path, base=None, hints=None):
        bases[tuple(tables)] = base and base[0]
        return make(workload, tables, frames, path, base, hints)

    monkeypatch.setattr(star, "build_view", watched)
    monkeypatch.setattr(driver, "LARGE", 100)  # so that large sides are hashed
    views, *_ = driver.build(spark, LINEITEM_STAR, frames, driver.Advice([("supplier",), ("orders", "supplier"), ("orders", "part", "supplier")], [], []), found)
    assert bases == {("supplier",): None, ("orders", "supplier"): ("supplier",), ("orders", "part", "supplier"): ("orders", "supplier")}
    plain = make(LINEITEM_STAR, ["orders", "part", "supplier"], frames, str(tmp_path / "view"))
    last = views["orders", "part", "supplier"]
    assert last.columns == plain.columns and last.count() == plain.count() > 0
    assert last.exceptAll(plain).isEmpty() and plain.exceptAll(last).isEmpty()
