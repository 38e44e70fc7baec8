"""Star joins from query descriptions, and what rewrites them: key summaries, views, keyed layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.predicates import conjunction
from lodestar.operators.key_summary import Summary, reduced
from lodestar.plans.workload import Query, Workload


def _needed(workload: Workload, query: Query, table: str) -> list[str]:
    scan = query.scans[table]
    keys = [workload.tables[t].links[1] for t in query.scans if t != workload.central] if table == workload.central else [workload.tables[table].links[0]]
    return list(dict.fromkeys([*keys, *scan.projections]))


def scan_of(workload: Workload, query: Query, table: str, frame: DataFrame, summaries: Sequence[Summary] = (), versions: Mapping[str, str] | None = None) -> DataFrame:
    """One table's part: filters and summary checks, then the columns still needed, as table__column."""
    df = frame.where(conjunction(query.scans[table].filters))
    checks = [(s, f) for s in summaries if s.target == table and s.source in query.scans for f in query.scans[s.source].filters]
    df = reduced(df, checks, versions)
    return df.select(*[F.col(c).alias(f"{table}__{c}") for c in _needed(workload, query, table)])


def star_join(workload: Workload, query: Query, frames: Mapping[str, DataFrame], order: Sequence[str] | None = None, summaries: Sequence[Summary] = (), hints: Mapping[str, str] | None = None, versions: Mapping[str, str] | None = None) -> DataFrame:
    """Central table first, then the others in the given order; Catalyst takes it as a hint.  Counted if the query says so.

    versions: of the summaries' sources, as artefacts.version() has them; a summary of another one is refused.
    """
    order = list(order or [t for t in query.scans if t != workload.central])
    df = scan_of(workload, query, workload.central, frames[workload.central], summaries, versions)
    for t in order:
        part = scan_of(workload, query, t, frames[t], summaries, versions)
        if hints and t in hints:
            part = part.hint(hints[t])
        df = df.join(part, link(workload, t), "inner")
    return counted(query, df)


def link(workload: Workload, table: str) -> Column:
    own, central = workload.tables[table].links
    return F.col(f"{table}__{own}") == F.col(f"{workload.central}__{central}")


def counted(query: Query, df: DataFrame) -> DataFrame:
    if query.count:
        return df.agg(F.count("*").alias("n"))
    return df.select(*[f"{t}__{c}" for t, s in query.scans.items() for c in s.projections])


def join_orders(workload: Workload, query: Query) -> list[list[str]]:
    """All left-deep orders after the central table, links to one row before links to many."""
    others = [t for t in query.scans if t != workload.central]
    one = [t for t in others if not workload.tables[t].to_many]
    many = [t for t in others if workload.tables[t].to_many]
    return [[*a, *b] for a in permutations(one) for b in permutations(many)]


def build_view(workload: Workload, tables: Sequence[str], frames: Mapping[str, DataFrame], path: str, base: tuple[Sequence[str], DataFrame] | None = None, hints: Mapping[str, str] | None = None) -> DataFrame:
    """Materialises the join of the central table with `tables`, all columns as table__column, as Parquet.

    base: a view of some of the tables, and which; only the others are joined then.
    """
    every = lambda t: frames[t].select(*[F.col(c).alias(f"{t}__{c}") for c in frames[t].columns])
    held, df = base or ((), every(workload.central))
    for t in tables:
        if t not in held:
            part = every(t).hint(hints[t]) if hints and t in hints else every(t)
            df = df.join(part, link(workload, t), "inner")
    df = df.select(*[f"{t}__{c}" for t in (workload.central, *tables) for c in frames[t].columns])
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_view(workload: Workload, query: Query, view: DataFrame, view_tables: Sequence[str], frames: Mapping[str, DataFrame]) -> DataFrame:
    """The query from a view of the central table and view_tables: filters apply again, what the view lacks is joined."""
    if not set(view_tables) <= set(query.scans):
        raise ValueError("the view joins a table that the query doesn't")
    covered = [workload.central, *view_tables]
    for t in covered:
        view = view.where(conjunction(query.scans[t].filters, f"{t}__"))
    df = view.select(*dict.fromkeys(f"{t}__{c}" for t in covered for c in _needed(workload, query, t)))
    for t in query.scans:
        if t not in covered:
            df = df.join(scan_of(workload, query, t, frames[t]), link(workload, t), "inner")
    return counted(query, df)


def index_join(keys: DataFrame, key: str, lookup: DataFrame, lookup_key: str, checked_rows: int, limit: int = 100_000) -> DataFrame:
    """Rows of lookup for the keys.  The key side is broadcast if its checked row count is small, else left to the planner."""
    return lookup.join(F.broadcast(keys) if checked_rows <= limit else keys, lookup[lookup_key] == keys[key], "inner")


def link_path(links: Sequence[tuple[str, str]], start: str, goal: str) -> list[str] | None:
    """The shortest chain of tables from start to goal over key links, either way along each."""
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    paths, seen = [[start]], {start}
    while paths:
        path = paths.pop(0)
        if path[-1] == goal:
            return path
        for t in sorted(near.get(path[-1], set()) - seen):
            seen.add(t)
            paths.append([*path, t])
    return None
