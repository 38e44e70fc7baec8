"""Keeping a key summary fresh under appends to its source."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestar.operators.key_summary import Summary, build


def summary_stream(source: DataFrame, source_key: str, summary: Summary) -> DataFrame:
    """key, bits of a streaming source: OR only ever adds bits, so update mode sends each changed key on."""
    return build(source, source_key, summary)
