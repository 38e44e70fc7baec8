"""What is built once and read by many queries: tables with key summaries, views, keyed layouts.

Each lies in the shared folder beside a note of what it was made from; it is built anew where the source has
changed since, and a summary of another version than its source's is refused.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestar.operators import key_summary as ks
from lodestar.operators.statistics import Histogram

#: What this program has built: folders by (program, name, versions), the notes in them, and tables of the catalogue.
_BUILT: dict[tuple[str, str, str], str] = {}
_NOTES: dict[str, str] = {}
_TABLES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def version(df: DataFrame) -> str:
    """A fingerprint of the files that a table is read from: their paths, sizes and times."""
    spark = df.sparkSession
    configuration, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted(df.inputFiles()):
        path = paths(spark.sparkContext._jvm.java.net.URI(name))
        status = path.getFileSystem(configuration).getFileStatus(path)
        found.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:16]


def built(spark: SparkSession, name: str, made_from: Sequence[DataFrame], make: Callable[[str], None]) -> str:
    """The folder of artefact `name`, for which make(folder) is called if this program has none of these sources yet."""
    key = (spark.sparkContext.applicationId, name, "-".join(version(df) for df in made_from))
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
        make(path)
        _BUILT[key] = path
    return _BUILT[key]


def store_summaries(target: DataFrame, summaries: Sequence[ks.Summary], path: str) -> None:
    """Writes a target that has its summaries' column, and the summaries with their versions."""
    target.write.mode("overwrite").parquet(f"{path}/rows")
    notes = json.dumps({"schema": target.schema.json(), "summaries": [asdict(s) | {"histogram": s.histogram.to_json()} for s in summaries]})
    target.sparkSession.createDataFrame([(notes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summaries")


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, list[ks.Summary]]:
    if path not in _NOTES:
        _NOTES[path] = spark.read.text(f"{path}/summaries", wholetext=True).first()[0]
    notes = json.loads(_NOTES[path])
    rows = spark.read.schema(StructType.fromJson(json.loads(notes["schema"]))).parquet(f"{path}/rows")
    return rows, [ks.Summary(**n | {"histogram": Histogram.from_json(n["histogram"])}) for n in notes["summaries"]]


def keyed(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """df as a table in buckets of the key, sorted by it within them: a join on the key does not shuffle it again."""
    spark = df.sparkSession

    def make(path: str) -> None:
        table = f"keyed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
        _TABLES[path] = table

    return spark.table(_TABLES[built(spark, f"{name}-{key}-{buckets}", [df], make)])

