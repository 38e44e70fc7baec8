"""Row counters and timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with a counter of its rows, readable once an action has run."""
    counter = Observation(name)
    return df.observe(counter, F.count(F.lit(1)).alias("rows")), counter


def join_counters(build: DataFrame, build_filter: Filter, build_key: str, probe: DataFrame, probe_filter: Filter, probe_key: str) -> dict[str, float]:
    """Rows read, passed on and joined, and seconds: of scanning and dealing the build side, and of the rest of the join."""
    seen, counters = {}, {}

    def counted(name: str, df: DataFrame) -> DataFrame:
        out, counters[name] = observed(df, name)
        return out

    left = counted("build_in", counted("build_scan_in", build).where(build_filter.column()))
    started = time.perf_counter()
    left.select(build_key).repartition(build_key).write.format("noop").mode("overwrite").save()
    seen["build_seconds"] = time.perf_counter() - started
    seen |= {k: c.get["rows"] for k, c in counters.items()}
    counters.clear()
    right = counted("probe_in", counted("probe_scan_in", probe).where(probe_filter.column()))
    out = counted("out", right.join(build.where(build_filter.column()).select(build_key), F.col(probe_key) == F.col(build_key)))
    started = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    seen["probe_seconds"] = max(1e-9, time.perf_counter() - started - seen["build_seconds"])
    seen |= {k: c.get["rows"] for k, c in counters.items()}
    return {k: seen[k] for k in ("build_scan_in", "build_in", "probe_scan_in", "probe_in", "out", "build_seconds", "probe_seconds")}


def timed(run: Callable[[], object]) -> float:
    """Seconds of a run: one to warm up, one timed, then the mean of 5 (under 1 s), 3 (under 10 s) or that one."""
    run()
    started = time.perf_counter()
    run()
    first = time.perf_counter() - started
    more = 5 if first < 1 else 3 if first < 10 else 0
    if not more:
        return first
    started = time.perf_counter()
    for _ in range(more):
        run()
    return (time.perf_counter() - started) / more
