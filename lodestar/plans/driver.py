"""The workload driver: load, gather statistics, let the advisors choose under the budget, build, run every query in every mode."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import key_summary as ks
from lodestar.operators.statistics import equi_depth
from lodestar.plans import advisors, artefacts, estimate, runner, star
from lodestar.plans.workload import Query, Workload

MODES = ("default", "view", "index", "summary")
#: Rows of a table from which a join with the central one is by hashing what is shuffled; fewer may be broadcast.
LARGE = 500_000


@dataclass
class Advice:
    """What the advisors choose for a workload: views (sets of tables), keyed tables, and (source, column, target, bits, offset)."""

    views: list[tuple[str, ...]]
    layouts: list[str]
    bits: list[tuple[str, str, str, int, int]]
    costs: list[dict[str, object]] = field(default_factory=list)


def advise(workload: Workload, queries: Mapping[str, Query], frames: Mapping[str, DataFrame], stats: runner.Statistics) -> Advice:
    """Views and keyed layouts within workload.budget (MB each), summary bits within embedding_size, by the training queries."""
    budget = workload.budget << 20
    training = [q for q in queries.values() if q.for_training and q.kind == "join"]
    plans, costs = {}, []
    for q in training:
        scans = runner.scan_rows(q, frames, stats)
        order = estimate.best_order(q, workload, scans, stats.rows, stats.freq)
        plans[q.name] = scans, order
        costs.append({"query": q.name, "mode": "default", "cost": estimate.plan_cost(scans, stats.rows, workload, order, stats.freq)[0]})
    default = {c["query"]: c["cost"] for c in costs}

    candidates = advisors.view_candidates([order for _, order in plans.values()])
    columns = {t.name: list(t.columns) for t in workload.tables.values()}
    sizes = {}
    for v in candidates:
        rows = estimate.view_rows(stats.rows, workload, v, stats.freq, "avg")
        sizes["+".join(v)] = estimate.view_size(rows, workload, {t: columns[t] for t in (workload.central, *v)})
    by_view = {("+".join(v), name): estimate.view_cost(v, scans, stats.rows, workload, order, stats.freq) for v in candidates for name, (scans, order) in plans.items()}
    views = [tuple(name.split("+")) for name in advisors.choose_views(default, by_view, sizes, budget)]

    savings = []
    for scans, order in plans.values():
        outs = estimate._steps(scans, workload, order, stats.freq, "top")
        for t, n, out in zip(order, outs, outs[1:], strict=False):
            scan = estimate.SCAN_COST * stats.rows[t] + out
            savings.append((t, advisors.layout_size(stats.rows[t], stats.rows[workload.central]), advisors.layout_savings(scan, 0.0, n, out)))
    layouts = advisors.choose_layouts(savings, budget)
    bits = advisors.place_bits(runner.advisor_uses(workload, training, frames, stats), workload.embedding_size)
    # A summary goes along a link, so from or to the central table.
    bits = [b for b in bits if workload.central in (b[0], b[2])]
    costs += [{"query": q, "mode": f"view {v}", "cost": c} for (v, q), c in sorted(by_view.items())]
    return Advice(views, layouts, bits, costs)


def build(spark: SparkSession, workload: Workload, frames: Mapping[str, DataFrame], advice: Advice, stats: runner.Statistics, buckets: int = 16) -> tuple[dict, dict, dict, list[ks.Summary], dict[str, str]]:
    """(views, tables in buckets of their keys, tables with summaries, the summaries, their sources' versions), each built once."""
    # Each key is in them once, so what a task hashes is its share of the keys, and the central table needs no sorting.
    large = lambda t: stats.rows[t] > LARGE
    hints = {t.name: "shuffle_hash" for t in workload.tables.values() if large(t.name) and t.name != workload.central and t.links and t.primary == (t.links[0],)}
    views = {}
    for v in sorted(advice.views, key=len):
        held = max((w for w in views if set(w) < set(v)), key=lambda w: sum(stats.rows[t] for t in w), default=None)
        base = (held, views[held]) if held else None
        path = artefacts.built(spark, f"view-{workload.title}-{'-'.join(v)}", [frames[t] for t in (workload.central, *v)], lambda to, v=v, base=base: star.build_view(workload, v, frames, to, base, hints))
        views[v] = spark.read.parquet(path)
    views = {v: views[v] for v in advice.views}
    keyed = {t: artefacts.keyed(frames[t], workload.tables[t].links[0], f"{workload.title}-{t}", buckets) for t in advice.layouts}
    versions = {t: artefacts.version(frames[t]) for t in {b[0] for b in advice.bits}}
    with_bits, summaries = {}, []
    for target in sorted({b[2] for b in advice.bits}):
        own = [b for b in advice.bits if b[2] == target]
        made = [ks.Summary(s, c, target, stats.histograms[s, c], n, offset, version=versions[s]) for s, c, _, n, offset in own]

        def make(path: str, target=target, made=made) -> None:
            rows = frames[target]
            for summary in made:
                other = summary.source if target == workload.central else target
                key, central_key = workload.tables[other].links
                source_key, target_key = (key, central_key) if target == workload.central else (central_key, key)
                bits = ks.build(frames[summary.source], source_key, summary)
                rows = ks.attach(rows, target_key, bits.hint("shuffle_hash") if large(summary.source) else bits)
            artefacts.store_summaries(rows, made, path)

        name = f"summaries-{workload.title}-{target}-{'-'.join(f'{s}.{c}.{n}' for s, c, _, n, _ in own)}"
        path = artefacts.built(spark, name, [frames[target], *(frames[s] for s, *_ in own)], make)
        with_bits[target], found = artefacts.read_summaries(spark, path)
        summaries += found
    return views, keyed, with_bits, summaries, versions


def plans(spark: SparkSession, workload: Workload, queries: Mapping[str, Query], frames: Mapping[str, DataFrame], stats: runner.Statistics, advice: Advice) -> dict[tuple[str, str], DataFrame]:
    """(query, mode): the query's plan in each mode, over what the advice had built."""
    views, keyed, with_bits, summaries, versions = build(spark, workload, frames, advice, stats)
    out = {}
    for q in queries.values():
        if not q.for_running:
            continue
        plan = runner.choose(workload, q, frames, stats, list(views), list(keyed))
        plain = replace(plan, view=(), lookups=())
        out[q.name, "default"] = runner.planned(workload, q, frames, plain)
        out[q.name, "view"] = runner.planned(workload, q, frames, plan, views)
        out[q.name, "index"] = runner.planned(workload, q, {**frames, **{t: keyed[t] for t in plan.lookups}}, plain)
        out[q.name, "summary"] = runner.planned(workload, q, {**frames, **with_bits}, plain, summaries=summaries, versions=versions)
    return out


def run(spark: SparkSession, workload: Workload, queries: Mapping[str, Query], folder: str | Path, frames: Mapping[str, DataFrame] | None = None) -> list[dict[str, object]]:
    """The whole workload: rows (query, mode, n, seconds), which are written to folder/times.csv as well.

    The workload's flags act: reload reads the input files again, just_load ends after loading, gen_costs only
    writes the plans' costs (costs.csv), rebuild gathers the statistics anew instead of reading their sidecar
    (statistics.json).  folder is the driver's own: what it gets is small.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    frames = runner.load(spark, workload) if frames is None else frames
    if workload.just_load:
        return []
    sidecar = folder / "statistics.json"
    if sidecar.exists() and not workload.rebuild:
        stats = runner.Statistics.restored(sidecar)
    else:
        stats = runner.gather(workload, queries.values(), frames)
        stats.save(sidecar)
    advice = advise(workload, queries, frames, stats)
    runner.write_rows(folder / "costs.csv", advice.costs)
    runner.write_rows(folder / "summaries.csv", [dict(zip(("source", "column", "target", "bits", "offset"), b, strict=True)) for b in advice.bits])
    if workload.gen_costs:
        return []
    rows = []
    for (name, mode), df in plans(spark, workload, queries, frames, stats, advice).items():
        started = time.perf_counter()
        n = df.first()["n"] if queries[name].count else df.count()
        rows.append({"query": name, "mode": mode, "n": n, "seconds": round(time.perf_counter() - started, 4)})
    runner.write_rows(folder / "times.csv", rows)
    times = {m: {r["query"]: max(r["seconds"], 1e-4) for r in rows if r["mode"] == m} for m in MODES}
    runner.write_rows(folder / "speedups.csv", [{"mode": m} | s for m, s in advisors.speedups(times).items()])
    return rows
