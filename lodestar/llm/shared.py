"""Spark helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Written tables of the scratch() blocks that are open, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, keep: bool = False, **options: str) -> DataFrame:
    """Computes df now and cuts its lineage: writes it as Parquet in the shared folder, so that lost executors don't matter.

    The table goes when the scratch() block around ends, or with `keep` the one around that; without one, when
    the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestar-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    around = _open[:-1] if keep else _open
    if around:
        around[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same for small tables by checkpoint(), whose files go with its last user if spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpoint keeps the size that Catalyst expects of its plan, a join's being the product of its sides'; where
    each round joins the last one's tables, that number has three times the digits after each, until it fills the
    driver.  So the rows come back as a plan of unknown size.
    """
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint(eager=True)._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorting and merging, for what grows with the corpus: Catalyst must not take it for small enough to broadcast.

    It reckons an explode to give as many rows as it gets, and a Parquet table at its compressed size, so it
    would send what fills the driver.
    """
    return df.hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that are stored within; what is to live on must be stored with `keep`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that gives the memory it has freed back to the system when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _remove(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or context is None or context.sc().isStopped():
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def in_rest(doc_id: str, modulus: int, remainder: int = 2):
    """True for the rows that are held out: crc32 of the id as text, modulo modulus, is remainder.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """Connected components by randomised contraction.

    links: columns a, b (long).  Returns one row (node, root) for each node that has a link; nodes of one
    component share a root, which is one of them.  In each round every node joins the neighbour (or itself)
    that comes first in a random order drawn anew, and the graph of the chosen ones is what remains: the
    nodes that still have links fall by a constant factor, so the rounds are logarithmic, the space is
    linear, and no node's neighbours are ever gathered (minima are pre-aggregated, joins can be split).
    """
    spark = links.sparkSession
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("o"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        chosen = checkpointed(chosen.select(F.col("a").alias("node"), F.least(order("a"), "m")["v"].alias("root")))
        steps.append(chosen)
        left, right = chosen.toDF("a", "ra"), chosen.toDF("b", "rb")
        edges = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = checkpointed(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps.pop()
    while steps:
        below = steps.pop()
        out = below.join(out.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


#: Rows of a labelled sample at most, whatever the number of grades.
MOST_LABELLED = 64_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_grade: int) -> DataFrame:
    """(grade, text) of at most per_grade rows of each grade of labels[label], joined to docs by doc_id; written once.

    Rows are taken by their id's hash, so a sample is the same every time; of the texts of a repeated id the
    first in order is taken.  It has MOST_LABELLED rows at most, fewer of each grade if there are many grades,
    which is why it may be broadcast.  Over MOST_LABELLED grades are too many to learn.
    """
    known = labels.select("doc_id", F.col(label).alias("grade")).where("doc_id is not null and grade is not null")
    grades = [r[0] for r in known.select("grade").distinct().orderBy("grade").limit(MOST_LABELLED + 1).collect()]
    if len(grades) > MOST_LABELLED:
        raise ValueError(f"over {MOST_LABELLED} grades")
    if not grades:
        return docs.sparkSession.createDataFrame([], "grade double, text string")
    each = min(per_grade, max(1, MOST_LABELLED // len(grades)))
    picked = None
    for grade in grades:
        part = known.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id")).limit(each)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return stored(found.select(F.col("grade").cast("double").alias("grade"), "text"))
