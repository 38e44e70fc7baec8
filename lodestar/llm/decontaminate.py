"""Benchmark decontamination: a prefix-filtered set join of word windows, verified over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.shared import frugal, load, merged, stored

#: Bits of the filter that is sent to the executors: 2 MB, whatever the size of the benchmark.
FILTER_BITS = 24


def _shingle_texts(data: np.ndarray, w: tk.Words, at: np.ndarray, width: np.ndarray) -> list[str]:
    joined = []
    for i, n in zip(at.tolist(), width.tolist(), strict=True):
        joined.append(b" ".join(tk.LOWER[data[a:b]].tobytes() for a, b in zip(w.start[i : i + n], w.end[i : i + n], strict=True)).decode())
    return joined


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """item (a number of each row of items), item_id, length (words), at (word position), width, shingle, bit (its place in the filter); none for items without words."""
    id_type = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(2))
            w = tk.words(data, offsets, tk.NON_WORD)
            lengths = np.diff(w.first)
            for width in range(1, size + 1):
                run_at = tk.windows(w.first, width)
                if width < size:
                    run_at = run_at[lengths[w.doc[run_at]] == width] if len(run_at) else run_at
                if not len(run_at):
                    continue
                owner = w.doc[run_at]
                bits = (tk.chain(w.hash, width)[run_at] >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
                widths = np.full(len(run_at), width, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        batch.column(1).take(pa.array(owner)),
                        pa.array(lengths[owner]),
                        pa.array((run_at - w.first[owner]).astype(np.int64)),
                        pa.array(widths),
                        pa.array(_shingle_texts(data, w, run_at, widths), pa.string()),
                        pa.array(bits),
                    ],
                    ["item", "item_id", "length", "at", "width", "shingle", "bit"],
                )

    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(run, f"item long, item_id {id_type}, length long, at long, width int, shingle string, bit int")


def occurrences(docs: DataFrame, shingles: DataFrame, size: int) -> DataFrame:
    """Every row of docs as (row, doc_id, n_words, hits): hits are the (at, width, shingle) that may be an item's.

    One pass over the text.  A filter of fixed size, sent to the executors, drops nearly all windows that no
    item has; what it lets through is settled by the join on the shingle's own text.
    """
    spark = docs.sparkSession
    bits = shingles.select("width", "bit").distinct().toArrow()
    widths = sorted(set(bits.column("width").to_pylist()))
    table = np.zeros(1 << FILTER_BITS, bool)
    table[bits.column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(table, bitorder="little"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            whole, bounds = tk.utf8(batch.column(1))
            for x, y in tk.document_blocks(bounds):
                data, offsets = whole[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x]
                w = tk.words(data, offsets, tk.NON_WORD)
                ats, kinds = [], []
                for width in widths:
                    run_at = tk.windows(w.first, width)
                    place = tk.chain(w.hash, width)[run_at] >> np.uint64(64 - FILTER_BITS)
                    place = place.astype(np.int64)
                    run_at = run_at[(packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                    ats.append(run_at)
                    kinds.append(np.full(len(run_at), width, np.int32))
                at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
                kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int32)
                order = np.argsort(at, kind="stable")
                at, kind = at[order], kind[order]
                owner = w.doc[at]
                lists = np.searchsorted(owner, np.arange(w.n_docs + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [pa.array(at - w.first[owner]), pa.array(kind), pa.array(_shingle_texts(data, w, at, kind), pa.string())], ["at", "width", "shingle"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(lists), hits)], ["doc_id", "n_words", "hits"]
                )

    found = docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {id_type}, n_words long, hits array<struct<at: long, width: int, shingle: string>>")
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "hits")


def stretches(at: np.ndarray, code: np.ndarray, reach: int, need: int, lead: int) -> np.ndarray:
    """The places, of windows found at `at` (ascending), that lie in a stretch with `need` different windows.

    A stretch starts at a found window and holds those up to `reach` words further on; none that starts
    elsewhere has more.  Codes up to `lead` are the joined ones.  The stretch slides on, so the work is linear
    however often a long document repeats an item.
    """
    anchors = at[code <= lead]
    if not len(anchors):
        return at[:0]
    ahead = anchors[np.minimum(np.searchsorted(anchors, at - reach), len(anchors) - 1)]
    close = np.abs(ahead - at) <= reach
    at, code = at[close], code[close].tolist()
    stop = np.searchsorted(at, at + reach, side="right")
    edge = np.zeros(len(at) + 1, np.int64)
    inside: dict[int, int] = {}
    taken = 0
    for start, end in enumerate(stop.tolist()):
        for k in range(taken, end):
            inside[code[k]] = inside.get(code[k], 0) + 1
        taken = end
        if len(inside) >= need:
            edge[start] += 1
            edge[end] -= 1
        inside[code[start]] -= 1
        if not inside[code[start]]:
            del inside[code[start]]
    return at[np.cumsum(edge[:-1]) > 0]


def _verified(held: DataFrame) -> DataFrame:
    """row, item, at, width of the windows in good stretches; held has what each document has of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda name: batch.column(name).to_numpy()  # noqa: B023, E731
            found = batch.column("found")
            edges = found.offsets.to_numpy()
            inner = found.values
            at, code = inner.field("at").to_numpy(), inner.field("code").to_numpy()
            width = number("width")
            good = [
                stretches(at[a:b], code[a:b], int(length - w), int(need), int(lead))
                for a, b, length, w, need, lead in zip(edges[:-1], edges[1:], number("length"), width, number("need"), number("lead"), strict=True)
            ]
            owner = np.repeat(np.arange(len(good)), [len(g) for g in good])
            take = pa.array(owner, pa.int64())
            places = np.concatenate([np.zeros(0, np.int64), *good])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("item").take(take), pa.array(places), pa.array(width[owner])], ["row", "item", "at", "width"])

    return held.mapInArrow(run, "row long, item long, at long, width int")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 8, containment: float | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans, held (any item, named or not): what each document holds of each item.

    An item is its set of windows of `size` consecutive words (one shorter window if it has fewer words).
    A document holds an item if some stretch of the document, as long as the item, has enough of its windows:
    containment of them, or with None a single one.  The join is prefix-filtered: an item's windows are
    ordered by how many documents have them, rarest first, and of n windows of which k are needed only the
    first n - k + 1 are joined, since any k of n include one of those.  Candidates must be long enough
    (length bound), and every window found must lie with one of the joined ones in one stretch of the item's
    length (positional bound) before the exact count over such stretches decides.

    One row per row of docs, so repeated rows stay repeated.  A null or empty text has no words and no
    items; an item without words is in nothing; equal items are reported each.  Null ids are kept as they
    are (an item whose item_id is null hits words but has no name to list).  Extra columns are ignored.
    """
    shingles = stored(item_shingles(items.select("item_id", "text"), size))
    seen = stored(occurrences(docs, shingles, size))
    rare = seen.select(F.explode(F.array_distinct("hits.shingle")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n_docs"))
    # Each row of items is an item of its own, so that null and repeated ids do no harm.
    item = shingles.select("item", "length", "shingle", "width").distinct()
    own = Window.partitionBy("item")
    item = item.join(rare, "shingle", "left").withColumn("n", F.count("*").over(own))
    share = F.lit(0.0) if containment is None else F.lit(float(containment))
    item = item.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    rank = F.row_number().over(own.orderBy(F.coalesce("n_docs", F.lit(0)), "shingle"))
    item = item.withColumn("code", rank).withColumn("lead", F.col("n") - F.col("need") + 1).drop("n_docs", "n")

    hits = merged(seen.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.at", "hit.width", "hit.shingle"))
    long_enough = F.col("n_words") >= F.col("width") + F.col("need") - 1
    if containment is None:
        # Every window is in the prefix and each one found is a match by itself.
        match = hits.join(item.where("code <= lead"), ["shingle", "width"]).where(long_enough).select("row", "item", "at", "width")
    else:
        probe = hits.join(item.where("code <= lead"), ["shingle", "width"]).where(long_enough)
        # Only documents with a joined window are looked at again.
        near = probe.select("row", "item").distinct()
        all_hits = hits.join(item, ["shingle", "width"]).join(near, ["row", "item"])
        held = all_hits.groupBy("row", "item", "length", "need", "lead", "width").agg(F.array_sort(F.collect_set(F.struct("at", "code"))).alias("found"))
        match = _verified(held)

    match = match.join(shingles.select("item", F.col("item_id").cast("string").alias("name")).distinct(), "item")
    per = match.groupBy("row").agg(F.collect_set(F.struct("at", "width")).alias("spans"), F.sort_array(F.collect_set("name")).alias("items"), F.lit(True).alias("held"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1))))
    per = per.select("row", "items", "held", F.array_sort("spans").alias("spans"), F.size(covered).cast("long").alias("n_hit"))
    out = seen.select("row", "doc_id", "n_words").join(merged(per), "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at: long, width: int>>")).alias("spans"),
        F.coalesce("held", F.lit(False)).alias("held"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 8) AS width, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM items),
runs AS (SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
found AS (SELECT doc_id, i, width, item_id FROM runs JOIN items USING (width, s)),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN named USING (doc_id) LEFT JOIN hit USING (doc_id)
"""
