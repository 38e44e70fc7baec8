"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"char": "string", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "text": "string"}


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """A declared schema from (name, type) pairs; schemas are never inferred."""
    unknown = [kind for _, kind in columns if kind not in TYPES]
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return T.StructType.fromDDL(", ".join(f"`{name}` {TYPES[kind]}" for name, kind in columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null: str = "") -> DataFrame:
    """Comma-separated without header; `null` marks missing values."""
    return spark.read.csv(path, schema=schema, header=False, sep=",", nullValue=null, dateFormat="yyyy-MM-dd", mode="FAILFAST")


def convert_csv(spark: SparkSession, path: str, schema: T.StructType, to: str, null: str = "") -> DataFrame:
    read_csv(spark, path, schema, null).write.mode("overwrite").parquet(to)
    return spark.read.schema(schema).parquet(to)


def sample(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """Bernoulli sample: everything below 1000 rows, else 1000 / rows, 1 % at least."""
    rate = 1.0 if rows < 1000 else max(0.01, 1000 / rows)
    return df if rate >= 1 else df.sample(False, rate, seed)


def with_row_id(df: DataFrame) -> DataFrame:
    """Appends row_id: partition in the high, row in the low bits."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def lookup(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of df with the given keys (random access is a join)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """Writes a table; clustering by a column lets row-group statistics prune on it."""
    (df.sortWithinPartitions(cluster_by) if cluster_by else df).write.mode("overwrite").parquet(path)


def create_table(df: DataFrame, name: str, path: str) -> None:
    """A table of that name in the catalogue, its files under path."""
    df.write.option("path", path).saveAsTable(name)


def clear_table(spark: SparkSession, name: str) -> None:
    """Empties a table and keeps its schema."""
    spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def drain(df: DataFrame) -> None:
    """Computes every value and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def print_rows(df: DataFrame, header: bool = True) -> list[str]:
    """The rows as comma-separated lines, NULL for missing values."""
    lines = [",".join(df.columns)] if header else []
    return lines + [",".join("NULL" if v is None else str(v) for v in row) for row in df.toLocalIterator()]


def update(df: DataFrame, where, column: str, value) -> DataFrame:
    """Point update as copy-on-write."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))
