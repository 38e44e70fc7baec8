"""Running a workload: statistics of its tables, kept in a sidecar file; estimates; plans by the cheapest order; result files."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.predicates import conjunction
from lodestar.operators.key_summary import Summary
from lodestar.operators.statistics import Histogram, equi_depth, profile
from lodestar.plans import estimate, star
from lodestar.plans.advisors import Use
from lodestar.plans.workload import Query, Workload
from lodestar.sources.tables import read_csv, sample, schema_of


@dataclass
class Statistics:
    """What plans are chosen by: rows and key frequencies of each table, histograms of the filtered columns."""

    rows: dict[str, int]
    freq: dict[str, estimate.Link]
    histograms: dict[tuple[str, str], Histogram] = field(default_factory=dict)

    def save(self, path: str | Path) -> None:
        histograms = [[t, c, h.to_json()] for (t, c), h in sorted(self.histograms.items())]
        Path(path).write_text(json.dumps({"rows": self.rows, "freq": {t: asdict(f) for t, f in self.freq.items()}, "histograms": histograms}))

    @classmethod
    def restored(cls, path: str | Path) -> Statistics:
        raw = json.loads(Path(path).read_text())
        return cls(raw["rows"], {t: estimate.Link(**f) for t, f in raw["freq"].items()}, {(t, c): Histogram.from_json(h) for t, c, h in raw["histograms"]})


def load(spark: SparkSession, workload: Workload, null: str = "") -> dict[str, DataFrame]:
    """The workload's tables: Parquet from its data folder, made from the input folder's files on `reload`."""
    frames = {}
    for t in workload.tables.values():
        schema, path = schema_of(list(t.columns.items())), f"{workload.data_folder}/{t.name}.parquet"
        if workload.reload:
            read_csv(spark, f"{workload.input_folder}/{t.datafile}", schema, null).write.mode("overwrite").parquet(path)
        frames[t.name] = spark.read.schema(schema).parquet(path)
    return frames


def gather(workload: Workload, queries: Iterable[Query], frames: Mapping[str, DataFrame], parts: int = 64) -> Statistics:
    """Statistics of all tables, with a histogram for each column that some query filters."""
    rows, freq = {}, {}
    for t in workload.tables.values():
        if t.to_many and t.links:
            keys = profile(frames[t.name], [t.links[0]]).first()
            freq[t.name] = estimate.Link(keys["n"] / max(1, keys["ndv"]), float(keys["max_freq"] or 1), float(keys["top_freq"] or 1.0))
        rows[t.name] = frames[t.name].count()
    filtered = sorted({(s.table, f.col) for q in queries for s in q.scans.values() for f in s.filters})
    return Statistics(rows, freq, {(t, c): equi_depth(frames[t], c, parts) for t, c in filtered})


def scan_rows(query: Query, frames: Mapping[str, DataFrame], stats: Statistics) -> dict[str, float]:
    """Estimated rows of each scan of a query: by a sample of the table, or by histograms if none of it passes."""
    out = {}
    for name, scan in query.scans.items():
        rows = stats.rows[name]
        if not scan.filters:
            out[name] = float(rows)
            continue
        seen = sample(frames[name], rows).agg(F.count("*").alias("n"), F.count_if(conjunction(scan.filters)).alias("hits")).first()
        share = estimate.scan_selectivity(seen["hits"], seen["n"], scan.filters, {f.col: stats.histograms[name, f.col] for f in scan.filters})
        out[name] = share * rows
    return out


@dataclass(frozen=True)
class Plan:
    """A chosen plan: join order, the view that begins it (if any), and the tables to look up by key."""

    order: tuple[str, ...]
    view: tuple[str, ...] = ()
    lookups: tuple[str, ...] = ()
    cost: float = 0.0


def choose(workload: Workload, query: Query, frames: Mapping[str, DataFrame], stats: Statistics, views: Sequence[Sequence[str]] = (), keyed: Sequence[str] = ()) -> Plan:
    """The cheapest order, then the cheapest of the views there are for it, then lookups for joins the view leaves."""
    scans = scan_rows(query, frames, stats)
    order = estimate.best_order(query, workload, scans, stats.rows, stats.freq)
    view = estimate.best_view([v for v in views if set(v) <= set(order)], scans, stats.rows, workload, order, stats.freq)
    kinds = estimate.join_kinds(scans, stats.rows, workload, order, stats.freq, keyed)
    cost = estimate.view_cost(view, scans, stats.rows, workload, order, stats.freq)
    return Plan(tuple(order), view, tuple(t for t in order if kinds[t] == "lookup" and t not in view), cost)


def planned(workload: Workload, query: Query, frames: Mapping[str, DataFrame], plan: Plan, views: Mapping[tuple[str, ...], DataFrame] | None = None, summaries: Sequence[Summary] = (), versions: Mapping[str, str] | None = None) -> DataFrame:
    """The query by a chosen plan.  A table that is looked up is one in buckets of its key (frames has it), which isn't shuffled."""
    if plan.view:
        return star.from_view(workload, query, (views or {})[plan.view], plan.view, frames)
    return star.star_join(workload, query, frames, plan.order, summaries, versions=versions)


def advisor_uses(workload: Workload, queries: Iterable[Query], frames: Mapping[str, DataFrame], stats: Statistics) -> list[Use]:
    """What place_bits works on: each training query's filters, with each other table the query scans."""
    out = []
    for q in queries:
        if q.for_training and q.kind == "join":
            scans = scan_rows(q, frames, stats)
            for name, scan in q.scans.items():
                for c in dict.fromkeys(f.col for f in scan.filters):
                    share = 1.0
                    for f in scan.filters:
                        share *= estimate.filter_selectivity(f, stats.histograms[name, c]) if f.col == c else 1.0
                    out += [Use(q.name, name, c, t, share, stats.rows[name], stats.rows[t], scans[t]) for t in q.scans if t != name]
    return out


def write_rows(path: str | Path, rows: Sequence[Mapping[str, object]]) -> None:
    """Results (times, costs, selectivities) as a CSV file with a header."""
    with Path(path).open("w", newline="") as out:
        writer = csv.DictWriter(out, list(rows[0]) if rows else [])
        writer.writeheader()
        writer.writerows(rows)
