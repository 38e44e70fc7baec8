"""Exact top-k search by inner product with MaxScore pruning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import load, shuffle_partitions, stored

#: Queries sent to the executors at a time, and how many of them are matched at once.
QUERY_BLOCK = 16384
QUERY_GROUP = 256
ROWS = 4096
#: Sums of whole numbers under this are exact in doubles.
EXACT = float(1 << 53)
#: Non-essential terms that are probed before what has fallen behind is dropped.
PROBED = 4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are zero beyond their end."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, at] = values
    return out


class Heaps:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores[q], scores.astype(np.int64)))
        ids = np.concatenate((self.ids[q], ids))
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores[q], self.ids[q] = scores[best], ids[best]
        if len(best) == self.k:
            self.least[q] = scores[best[-1]]


def max_score(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, heaps: Heaps, first: int) -> int:
    """Offers to heaps[first:] what rows may add to the queries' best; returns how many postings were read.

    Every dimension is a term, its postings the rows' components in it, side by side.  A term's bound is the
    most it adds to a score among these rows.  For each query the terms of least bound that together stay under
    the query's k-th score are non-essential: a row that gains nothing from the others cannot enter.  Only the
    essential terms' postings are traversed; the others are probed, largest bound first, for the rows that
    what is left of the bounds may still lift to the k-th score (an equal score counts, as the smaller id wins).
    """
    postings = np.ascontiguousarray(rows.T)
    low, high = postings.min(axis=1), postings.max(axis=1)
    read = 0
    for k, query in enumerate(queries):
        bounds = np.maximum(np.maximum(query * high, query * low), 0)
        order = np.argsort(bounds, kind="stable")
        total = np.cumsum(bounds[order])
        least = heaps.least[first + k]
        n_other = int(np.searchsorted(total, least, side="left"))
        essential = order[n_other:]
        essential = essential[query[essential] != 0]
        score = query[essential] @ postings[essential] if len(essential) < len(query) else query @ postings
        read += len(essential) * len(ids)
        rest = total[n_other - 1] if n_other else 0.0
        alive = np.flatnonzero((score + rest >= least) & (ids != query_ids[k]))
        score = score[alive]
        while n_other and len(alive):
            some = order[max(0, n_other - PROBED) : n_other]
            score += query[some] @ postings[some[:, None], alive]
            read += len(some) * len(alive)
            n_other -= len(some)
            rest = total[n_other - 1] if n_other else 0.0
            keep = score + rest >= least
            alive, score = alive[keep], score[keep]
        if len(alive):
            heaps.offer(first + k, score, ids[alive])
    return read


def exact(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, heaps: Heaps, first: int) -> None:
    """The same for vectors whose scores may leave the 53 bits that doubles add up exactly: in whole numbers of any size."""
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    scores = whole(queries) @ whole(rows).T
    for k in range(len(queries)):
        keep = ids != query_ids[k]
        # A score is a long: beyond its range it is cut to the range's end.
        own = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores[k][keep]], np.int64)
        heaps.offer(first + k, own, ids[keep])


def _whole(x: Column) -> Column:
    """floor(256 x) as a double: beyond 2^53 a double is whole already, and may be no long."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector: components floor(256 x), as doubles, of the vectors whose components are all there and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", _whole).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id, vector) its k best of vectors, itself left out.

    Vectors are dealt evenly to shards; each shard streams through its rows with all queries of a block,
    and the shards' lists are merged.  Queries go out in blocks of QUERY_BLOCK, one pass over the vectors
    each, and one after the other, so what the driver and a task hold has a fixed size.  Scores are exact,
    whatever the components; one that no long can hold is cut to the range's end.  Ties go to the smaller vec_id.  Vectors that are null or hold null or non-finite components take no part, nor do
    rows without an id; shorter vectors count as zero beyond their end; repeated rows are candidates each,
    but a row with the query's own id never is.
    """
    spark = vectors.sparkSession
    shards = vectors.repartition(shuffle_partitions(spark), F.xxhash64("vec_id", "vector"))
    stats = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n_blocks = max(1, -(-stats["n"] // QUERY_BLOCK))
    passes = []
    for number in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).toArrow()
        passes.append(_one_pass(spark, shards, block, k) if n_blocks == 1 else stored(_one_pass(spark, shards, block, k)))
    found = reduce(DataFrame.unionByName, passes)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(spark: SparkSession, shards: DataFrame, block: pa.Table, k: int) -> DataFrame:
    width = max([0, *(len(x) for x in block.column("vector").to_pylist())])
    sent = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), _matrix(block.column("vector").combine_chunks(), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        heaps = Heaps(len(query_ids), k)
        largest = float(np.abs(queries).max(initial=0.0))
        size = 64  # the first rows only set the scores to beat
        for batch in batches:
            ids = batch.column(0).to_numpy()
            reach = max([width, *np.diff(batch.column(1).offsets.to_numpy())])
            rows = _matrix(batch.column(1), int(reach))[:, :width]
            a = 0
            while a < len(ids) and len(query_ids):
                part, own = rows[a : a + size], ids[a : a + size]
                small = np.abs(part).sum(axis=1) * largest < EXACT
                for first in range(0, len(query_ids), QUERY_GROUP):
                    group = slice(first, first + QUERY_GROUP)
                    if small.any():
                        max_score(queries[group], query_ids[group], part[small], own[small], heaps, first)
                    if not small.all():
                        exact(queries[group], query_ids[group], part[~small], own[~small], heaps, first)
                a += size
                size = min(ROWS, 4 * size)
        counts = [len(x) for x in heaps.ids]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate(heaps.ids)), pa.array(np.concatenate(heaps.scores))],
                ["query_id", "vec_id", "score"],
            )

    return shards.mapInArrow(run, "query_id long, vec_id long, score long")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
