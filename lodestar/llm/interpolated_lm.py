"""Language-model scoring by deleted interpolation of n-gram estimates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.chunks import pieces
from lodestar.llm.shared import frugal, load, stored

CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 200_000
MODULUS, HELD_OUT, DELETED = 7, 2, 3
#: Part of a row without an id: it is in the training set.
NO_ID = MODULUS
BUCKETS = 24
END = np.uint64(0x5E4D0E4D0E4D0E4D)
#: Pairs are told apart by hashes this many bits wider than log2 of the text's bytes (64 at most): fewer than one in a million share one.
SPARE_BITS = 18
_CHUNK = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("size", pa.int64()), *((c, pa.binary()) for c in ("ids", "parts", "sizes", "texts"))])
#: Ratios of estimates are learned from at a resolution of an eighth of a power of two.
FINE = 8


def pack(values: np.ndarray) -> bytes:
    """Sorted values as differences of 3 to 8 bytes, as few as all of them fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    most = int(steps[1:].max()) if len(steps) > 1 else 0
    width = max(3, (most.bit_length() + 7) // 8)
    return bytes([width]) + steps[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], (len(blob) - 9) // blob[0]
    steps = np.zeros((n + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(n, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def packed(docs: DataFrame) -> DataFrame:
    """Documents in rows of one chunk each, written once: compressed texts, their sizes, ids and parts.

    A chunk is what comes next of a task's rows, about CHUNK_BYTES of text, so no text is shuffled and neither a
    common id nor repeated rows gather anywhere.  Documents of the part DELETED have chunks of their own.
    """
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % MODULUS, F.lit(NO_ID)).cast("int")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), "text", part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        held: dict[bool, list[tuple[int, int, bytes]]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def row(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            rows = held[deleted]
            column = lambda k, kind: np.array([r[k] for r in rows], kind).tobytes()
            sizes = np.array([len(r[2]) for r in rows], np.int64).tobytes()
            values = [number, deleted, size[deleted], column(0, np.int64), column(1, np.int32), sizes, packer.compress(b"".join(r[2] for r in rows))]
            number, held[deleted], size[deleted] = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNK, strict=True)], schema=_CHUNK)

        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            raw = memoryview(data)
            for d, (id_, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                deleted = own == DELETED
                held[deleted].append((id_, own, bytes(raw[offsets[d] : offsets[d + 1]])))
                size[deleted] += int(offsets[d + 1] - offsets[d])
                if size[deleted] >= CHUNK_BYTES or len(held[deleted]) >= CHUNK_DOCS:
                    yield row(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield row(deleted)

    kind = "chunk long, deleted boolean, size long, ids binary, parts binary, sizes binary, texts binary"
    return stored(base.mapInArrow(frugal(run), kind), **{"compression": "none", "parquet.block.size": str(4 * CHUNK_BYTES)})


@dataclass
class Tokens:
    """The tokens of a chunk: hashes of words and of an end after each document, with the hash of each pair ending there."""

    ids: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    kinds: list[np.ndarray]

    @classmethod
    def of(cls, row: dict, bits: int) -> Tokens:
        ids, parts, sizes = (np.frombuffer(row[name], kind) for name, kind in (("ids", np.int64), ("parts", np.int32), ("sizes", np.int64)))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        offsets = np.append(0, np.cumsum(sizes))
        w = tk.words(data, offsets, tk.WHITESPACE)
        words = np.insert(w.hash, w.first[1:], END)
        first = w.first + np.arange(len(w.first))
        before = np.append(END, words[:-1])  # a document starts after an end
        pairs = tk.mix(before * np.uint64(0xFF51AFD7ED558CCD) + words) >> np.uint64(64 - bits)
        return cls(ids, parts, first, np.repeat(np.arange(len(ids)), np.diff(first)), [words, pairs])


def _edges(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of n buckets, equal ranges of the hashes, starts among the sorted values; one entry more than buckets."""
    inner = (np.arange(1, n, dtype=np.float64) * (2.0**bits / n)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(values, inner), [len(values)]))


def counted(chunks: DataFrame, m: int, bits: int) -> DataFrame:
    """What each chunk must know beyond its own counts, as (chunk, kind, bucket, told, totals); the rows of chunk -1 have N and V.

    The chunks send every distinct word and pair with its number in their training documents to m buckets
    of hashes.  These add them up and answer each chunk with the totals that differ from what it counted
    itself; told marks which of the hashes it sent they are of, so the hashes needn't travel back.
    """
    asked_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    told_schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("told", pa.binary()), ("totals", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens = Tokens.of(row, bits)
            train = (tokens.parts != HELD_OUT)[tokens.doc]
            for kind in (0, 1):
                hashes = tokens.kinds[kind]
                order = np.argsort(hashes, kind="stable")
                hashes = hashes[order]
                start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))[: len(hashes)]
                counts = np.add.reduceat(train[order].astype(np.uint32), start, dtype=np.uint32) if len(start) else np.zeros(0, np.uint32)
                values = hashes[start]
                edges = _edges(values, m, bits if kind else 64)
                for some in np.array_split(np.flatnonzero(np.diff(edges)), 1 + m // 256):
                    parts = [slice(edges[b], edges[b + 1]) for b in some]
                    columns = [some.astype(np.int32), np.full(len(some), row["chunk"]), np.full(len(some), kind, np.int32), [pack(values[x]) for x in parts], [_pack_counts(counts[x]) for x in parts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, asked_schema, strict=True)], schema=asked_schema)

    def add(table: pa.Table) -> pa.Table:
        rows = []
        for kind in (0, 1):
            mine = table.filter(pc.equal(table.column("kind"), kind))
            if not mine.num_rows:
                continue
            chunk, bucket = mine.column("chunk").to_pylist(), mine.column("bucket")[0].as_py()
            hashes = [unpack(x.as_py()) for x in mine.column("hashes")]
            edges = np.append(0, np.cumsum([len(x) for x in hashes]))
            counts = np.concatenate([_unpack_counts(x.as_py(), n) for x, n in zip(mine.column("counts"), np.diff(edges), strict=True)])
            del mine
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            del hashes
            total = np.add.reduceat(counts[order], start)
            if kind == 0:
                rows.append((-1, kind, 0, b"", np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
            every = np.empty(len(order), np.int64)
            every[order] = np.repeat(total, np.diff(np.append(start, len(order))))
            told = every != counts
            for c, a, b in zip(chunk, edges[:-1], edges[1:], strict=True):
                if told[a:b].any():
                    rows.append((c, kind, bucket, np.packbits(told[a:b]).tobytes(), _pack_counts(every[a:b][told[a:b]])))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(told_schema)], schema=told_schema)

    asked = chunks.mapInArrow(frugal(ask), "bucket int, chunk long, kind int, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(add, "chunk long, kind int, bucket int, told binary, totals binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count under 255; those beyond follow in eight."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob[n:], np.int64)
    return out


def _totals(tokens: Tokens, answers: pa.Table, m: int, bits: int) -> list[np.ndarray]:
    """The corpus count of each token's word and pair: the bucket's answer, or else the chunk's own count."""
    train = (tokens.parts != HELD_OUT)[tokens.doc]
    out = []
    replies = answers.select(["kind", "bucket", "told", "totals"]).to_pylist()
    for kind, hashes in enumerate(tokens.kinds):
        values, inverse = np.unique(hashes, return_inverse=True)
        counts = np.bincount(inverse, train, len(values)).astype(np.int64)
        edges = _edges(values, m, bits if kind else 64)
        for r in replies:
            if r["kind"] == kind:
                a, b = edges[r["bucket"]], edges[r["bucket"] + 1]
                told = np.flatnonzero(np.unpackbits(np.frombuffer(r["told"], np.uint8), count=b - a))
                counts[a + told] = _unpack_counts(r["totals"], len(told))
        out.append(counts[inverse])
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 for unseen, then one for each power of two."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def learn(events: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """[BUCKETS, 3] weights of pair, word and uniform estimates by expectation-maximisation.

    events: bucket, and the binned log ratios of the pair and word estimate to the uniform one (-1: zero).
    """
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    if not len(events):
        return weights
    bucket = events[:, 0]
    ratio = np.column_stack([np.where(events[:, k] >= 0, 2.0 ** ((events[:, k] - 512) / FINE), 0) for k in (1, 2)] + [np.ones(len(events))])
    for _ in range(rounds):
        share = weights[bucket] * ratio
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        # A bucket without events takes the next lower one's weights; one with few leans on them.
        for b in range(1, BUCKETS):
            prior = weights[b - 1] if b > 1 else weights[b]
            weights[b] = (new[b] + 2 * prior) / (total[b] + 2)
        weights[0] = (new[0] + [0, 1, 1]) / (total[0] + 2)
    return np.maximum(weights, [0, 1e-7, 1e-7]) / np.maximum(weights, [0, 1e-7, 1e-7]).sum(axis=1, keepdims=True)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model mixes the pair estimate c(h w) / c(h), the word estimate c(w) / N and the uniform 1 / (V + 1),
    with weights that depend on how often the context h was seen (buckets of its frequency).  The weights
    are learned on the training part whose ids' remainder is DELETED: each of its tokens is deleted from the
    counts and then predicted.  Counts cover all training documents.  Tokens are lower-cased non-blank runs
    and an end for each document; a document starts after an end.  Words are told apart by 64-bit hashes, pairs
    by hashes so wide that fewer than one in a million share a count with another, whatever the size; such a
    count is cut to the context's and the word's own, which no true one exceeds.

    A null text is empty: its one token is the end.  Repeated rows count and are scored each; a row without
    an id is in the training part and keeps its null id.  A text longer than a chunk is a chunk of its own.
    Ids may repeat or be one and the same; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks = packed(docs)
    total = chunks.agg(F.sum("size").alias("n")).first()["n"] or 0
    m = pieces(spark, total, CHUNK_BYTES, spread=1)
    bits = min(64, SPARE_BITS + max(14, int(total).bit_length()))
    answers = stored(counted(chunks, m, bits))
    totals = np.zeros(2, np.int64)
    for r in answers.where("chunk = -1").toArrow().to_pylist():
        totals += np.frombuffer(r["totals"], np.int64)
    n_train, vocabulary = int(totals[0]), int(totals[1])
    uniform = 1 / (vocabulary + 1)

    def told(table: pa.Table, reply: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of a chunk with the corpus counts of their words, pairs and contexts."""
        tokens = Tokens.of(table.to_pylist()[0], bits)
        word, pair = _totals(tokens, reply, m, bits)
        context = np.append(_end_count(tokens, word), word[:-1])
        return tokens, word, np.minimum(pair, np.minimum(context, word)), context

    def meet(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["event", "n"])
        _, word, pair, context = told(table, reply)
        word, pair, context = word - 1, pair - 1, context - 1
        ratios = [pair / np.maximum(context, 1), word / max(1, n_train - 1)]
        with np.errstate(divide="ignore"):
            bins = [np.where(r > 0, np.clip(np.round(np.log2(r / uniform) * FINE) + 512, 0, 1023), 1024).astype(np.int64) for r in ratios]
        event, count = np.unique((_bucket(context) << 22) | (bins[0] << 11) | bins[1], return_counts=True)
        return pa.table([pa.array(event), pa.array(count)], ["event", "n"])

    def rate(table: pa.Table, reply: pa.Table) -> pa.Table:
        fields = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not table.num_rows:
            return fields.empty_table()
        tokens, word, pair, context = told(table, reply)
        weight = weights[_bucket(context)]
        p = weight[:, 0] * pair / np.maximum(context, 1) + weight[:, 1] * word / max(1, n_train) + weight[:, 2] * uniform
        start = tokens.first[:-1]
        base = np.add.reduceat(np.log10((word + 1) / (n_train + vocabulary + 1)), start)
        known = np.add.reduceat((word > 0).astype(np.int64), start)
        ids = pa.array(tokens.ids, mask=tokens.parts == NO_ID)
        return pa.Table.from_arrays([ids, pa.array(tokens.parts), pa.array(np.diff(tokens.first)), pa.array(known), pa.array(base), pa.array(np.add.reduceat(np.log10(p), start))], schema=fields)

    def with_answers(part: DataFrame, replies: DataFrame):
        return part.select("chunk", "ids", "parts", "sizes", "texts").groupBy("chunk").cogroup(replies.groupBy("chunk"))

    deleted = chunks.where("deleted")
    events = with_answers(deleted, answers.join(deleted.select("chunk"), "chunk", "left_semi")).applyInArrow(meet, "event long, n long")
    events = events.groupBy("event").agg(F.sum("n").alias("n")).toArrow()
    event = events.column("event").to_numpy()
    bins = np.column_stack([event >> 22, (event >> 11) & 2047, event & 2047])
    bins[:, 1:][bins[:, 1:] == 1024] = -1
    weights = learn(bins, events.column("n").to_numpy())
    out = with_answers(chunks, answers.where("chunk >= 0")).applyInArrow(rate, "doc_id long, part int, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (F.col("part") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _end_count(tokens: Tokens, word: np.ndarray) -> np.ndarray:
    """The count of the end token, the context of a chunk's first token."""
    return word[tokens.first[1] - 1 : tokens.first[1]]


def op5_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents"))
