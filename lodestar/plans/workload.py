"""Workload and query descriptions in TOML."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from lodestar.functions.predicates import COMPARE, Filter, sampled_literal
from lodestar.sources.tables import TYPES


@dataclass(frozen=True)
class Table:
    """A table of a star: `links` is (own key column, column of the central table)."""

    name: str
    columns: dict[str, str]
    datafile: str = ""
    primary: tuple[str, ...] = ()
    to_many: bool = False
    links: tuple[str, str] | None = None


@dataclass(frozen=True)
class Workload:
    title: str
    central: str
    tables: dict[str, Table]
    input_folder: str = ""
    data_folder: str = ""
    reload: bool = False
    just_load: bool = False
    gen_costs: bool = False
    rebuild: bool = False
    budget: int = 256
    embedding_size: int = 16


@dataclass(frozen=True)
class Scan:
    table: str
    inputs: tuple[str, ...] = ()
    projections: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Query:
    name: str
    scans: dict[str, Scan]
    kind: str = "join"
    count: bool = False
    is_mat_view: bool = False
    for_training: bool = True
    for_running: bool = True
    extra: dict = field(default_factory=dict)


def read_workload(path: str | Path) -> Workload:
    raw = tomllib.loads(Path(path).read_text())
    tables = {}
    for name, t in raw["tables"].items():
        columns, links = {}, None
        for c in t["columns"]:
            if c["type"] not in TYPES:
                raise ValueError(f"{name}.{c['name']}: unknown type {c['type']}")
            if c.get("dict_encode") and c["type"] != "int":
                raise ValueError(f"{name}.{c['name']}: only int columns are dictionary encoded")
            columns[c["name"]] = c["type"]
            if "foreign" in c:
                links = (c["name"], c["foreign"].rpartition(".")[2])
        tables[name] = Table(name, columns, t.get("datafile", ""), tuple(t.get("primary", ())), t.get("to_many", False), links)
    central = raw["central_table"]
    if central not in tables:
        raise ValueError(f"no central table {central}")
    for t in tables.values():
        if t.name != central and (t.links is None or t.links[1] not in tables[central].columns):
            raise ValueError(f"{t.name} has no key that refers to a column of {central}")
    reload = raw.get("reload", False)
    gen_costs = raw.get("gen_costs", False) and not reload
    flags = {"reload": reload, "just_load": raw.get("just_load", False), "gen_costs": gen_costs, "rebuild": raw.get("rebuild", False) and not gen_costs}
    return Workload(raw["workload_title"], central, tables, raw.get("input_folder", ""), raw.get("data_folder", ""), **flags, budget=raw.get("budget", 256), embedding_size=raw.get("embedding_size", 16))


def literal(kind: str, text: Any) -> Any:
    if kind in ("float", "double"):
        return float(text)
    if kind == "date":
        return date.fromisoformat(text)
    return int(text) if kind in ("tinyint", "smallint", "int", "bigint") else str(text)


def read_filter(raw: Mapping, kind: str, samples: list | None = None, number: int = 0) -> Filter:
    value = lambda text, k=0: sampled_literal(samples or [], number + k) if text == "?" else literal(kind, text)
    closed = raw.get("left_closed", True), raw.get("right_closed", True)
    if raw["expr"] == "between":
        if "range" in raw:
            low = value(raw.get("val", "?"))
            return Filter(raw["col"], "between", (low, low + literal(kind, raw["range"])), *closed)
        return Filter(raw["col"], "between", tuple(value(v, k) for k, v in enumerate(raw["vals"])), *closed)
    if raw["expr"] == "in":
        values = raw["vals"] if "vals" in raw else ["?"] * raw["num_ins"]
        return Filter(raw["col"], "in", tuple(value(v, k) for k, v in enumerate(values)))
    if raw["expr"] not in (*COMPARE, "not_null"):
        raise ValueError(f"no such predicate: {raw['expr']}")
    return Filter(raw["col"], raw["expr"], (value(raw["val"]),) if "val" in raw else ())


def read_queries(path: str | Path, workload: Workload, samples: Mapping[tuple[str, str], list] | None = None) -> dict[str, Query]:
    """Queries by name.  A join's parts are scans and include the central table; join conditions follow from the links."""
    out = {}
    for name, q in tomllib.loads(Path(path).read_text())["queries"].items():
        parts = [q] if q["type"] == "scan" else [v for v in q.values() if isinstance(v, dict)]
        scans = {}
        for part in parts:
            table = workload.tables[part["table"]]
            filters = tuple(read_filter(f, table.columns[f["col"]], (samples or {}).get((table.name, f["col"])), k) for k, f in enumerate(part.get("filters", ())))
            scans[table.name] = Scan(table.name, tuple(part.get("inputs", ())), tuple(part.get("projections", ())), filters)
        if q["type"] == "join" and workload.central not in scans:
            raise ValueError(f"{name} leaves out {workload.central}")
        flags = {k: q.get(k, d) for k, d in (("count", False), ("is_mat_view", False), ("for_training", True), ("for_running", True))}
        out[name] = Query(name, scans, q["type"], **flags)
    return out
