"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import minhash
from lodestar.llm import textkernel as tk
from lodestar.llm.shared import components, frugal, load, merged, scratch, stored

SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text; one of the whole word sequence if it is shorter than a shingle."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (long): the majority of each bit over the shingles' hashes, repeats included; 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.utf8(batch.column(1))
            prints = np.zeros(len(at) - 1, np.uint64)
            held, waiting, first = [], [], [0]

            def flush() -> None:
                if waiting:
                    prints[waiting] = tk.majority_bits(np.concatenate(held), np.array(first))  # noqa: B023
                held.clear()
                waiting.clear()
                first[:] = [0]

            for d in range(len(at) - 1):
                hashes = shingle_hashes(tk.LOWER[data[at[d] : at[d + 1]]].tobytes(), size)
                held.append(hashes)
                waiting.append(d)
                first.append(first[-1] + len(hashes))
                if first[-1] > tk.PIECE:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


#: Fingerprints in one entry of a segment's table up to which each is compared with each that probes it.
CROWD = 64


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ball(width: int, radius: int, shift: int = 0) -> list[int]:
    """The masks that change up to radius of the width bits from bit shift on, fewest first, as signed 64-bit values."""
    chosen = (c for n in range(radius + 1) for c in combinations(range(shift, shift + width), n))
    return [_signed(sum(1 << b for b in bits)) for bits in chosen]


def linked(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between different fingerprints within distance bits; their closure is that of all such pairs.

    Multi-index hashing over two segments of 32 bits, each with a table of the fingerprints by its value.  Of
    two fingerprints within 2r bits, one segment differs in r bits at most; so each one probes the
    tables with every value of the ball of radius r around its own segments (of pairs that differ by just r in
    both, one table is enough), and the complete distance of what it finds decides.  An entry of over CROWD
    fingerprints is not searched pair by pair: all that are in one or probe one go to crowded() instead.
    """
    if distance not in (0, 2, 4):
        raise ValueError("distance must be 0, 2 or 4")
    segments = [_signed(0xFFFFFFFF << 32), 0xFFFFFFFF]
    value = lambda k: F.col("fingerprint").bitwiseAND(F.lit(segments[k]).cast("long"))
    filed = prints.select("fingerprint", F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), value(k).alias("value")) for k in (0, 1)))).alias("entry"))
    filed = filed.select("entry.segment", "entry.value", "fingerprint")
    # If both segments differ in as many bits as the larger ball reaches, the first table finds the pair.
    radius = [distance // 2, (distance - 1) // 2 if distance else 0]
    probes = [F.struct(F.lit(k).alias("segment"), value(k).bitwiseXOR(F.lit(m).cast("long")).alias("value")) for k in (0, 1) for m in ball(32, radius[k], 32 * (1 - k))]
    asked = prints.select("fingerprint", F.explode(F.array(*probes)).alias("entry")).select("entry.segment", "entry.value", F.col("fingerprint").alias("probe"))
    full = stored(filed.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("segment", "value"))
    found = filed.join(full, ["segment", "value"], "left_anti").join(merged(asked), ["segment", "value"]).where("fingerprint <> probe")
    found = found.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("probe"))) <= distance)
    links = found.select(F.col("fingerprint").alias("a"), F.col("probe").alias("b"))
    if full.isEmpty():
        return links
    many = asked.join(full, ["segment", "value"], "left_semi").select(F.col("probe").alias("fingerprint")).distinct()
    return links.unionByName(crowded(stored(many), distance))


def crowded(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of the same closure as all pairs within distance bits, however close fingerprints are crowded.

    Every fingerprint is filed under each value of the ball of radius distance / 2 around the whole of it.  Two
    within the distance meet at a value between them, and whatever meets is within it; so a chain of the
    members of an entry, of which there are as many as the ball has values at most, has the same closure.
    """
    masks = F.array(*(F.lit(m).cast("long") for m in ball(64, distance // 2)))
    filed = prints.select("fingerprint", F.explode(masks).alias("mask")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("key"))
    previous = F.lag("fingerprint").over(Window.partitionBy("key").orderBy("fingerprint"))
    return filed.select(F.col("fingerprint").alias("a"), previous.alias("b")).where("b is not null")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable over links of at most distance bits.

    One row for each row of docs.  A null text is an empty one: fingerprint 0, linked like any other.  Equal
    texts, repeated rows and equal fingerprints are one node.  A null doc_id keeps its row; it never names a
    component unless no other id does.  Extra columns are ignored.
    """
    prints = stored(fingerprints(docs, size))
    with scratch(docs.sparkSession):
        nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
        roots = components(linked(nodes, distance)).withColumnRenamed("node", "fingerprint")
        nodes = stored(nodes.join(merged(roots), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
        smallest = stored(nodes.groupBy("root").agg(F.min("smallest").alias("component_id")))
        named = stored(nodes.join(merged(smallest), "root").select("fingerprint", "component_id"), keep=True)
    return prints.join(merged(named), "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """key, root: rows of one root are connected by pairs whose sets of `size`-word shingles have Jaccard `similarity` at least.

    One row for each row of docs (key long, unique; text).  Rows of equal sets are one node, null and empty
    texts too.  Candidates are fingerprints within distance bits (linked()) and, as 64 bits don't tell a Jaccard
    similarity of 0.8 from chance at that or any distance that can be searched, rows whose prefixes share a
    shingle (minhash.prefixes()), which all pairs of that similarity do; each link is verified on the whole sets.
    """
    found = stored(minhash.prefixes(docs, size, similarity, minhash.common_shingles(docs, size)))
    nodes = stored(found.groupBy("print").agg(F.min("key").alias("key")))
    prints = fingerprints(docs.select(F.col("key").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "key")
    prints = stored(prints.join(merged(nodes.select("key")), "key", "left_semi"))
    heads = stored(prints.groupBy("fingerprint").agg(F.min("key").alias("head")))
    near = linked(heads, distance).join(merged(heads.toDF("a", "x")), "a").join(merged(heads.toDF("b", "y")), "b")
    pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(prints.join(merged(heads), "fingerprint").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")))
    tied = minhash.ties(found)
    for c in "ab":
        tied = tied.join(merged(nodes.select(F.col("print").alias(c), F.col("key").alias(f"{c}_key"))), c)
    links = stored(tied.select("block", F.col("a_key").alias("a"), F.col("b_key").alias("b")).unionByName(pairs.select(F.xxhash64("a", "b").alias("block"), "a", "b")))

    def whole(keys: DataFrame) -> DataFrame:
        keys = stored(keys.distinct())
        return stored(minhash.sets(docs.join(F.broadcast(keys) if keys.count() <= minhash.FEW_KEYS else keys, "key", "left_semi"), size))

    roots = minhash.connected(links, whole, minhash.Jaccard(similarity), found.select("key", "bags"), minhash.Bags(similarity)).withColumnRenamed("node", "key")
    named = nodes.select("print", "key").join(merged(roots), "key", "left").select("print", F.coalesce("root", "key").alias("root"))
    return found.select("key", "print").join(merged(named), "print").select("key", "root")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
