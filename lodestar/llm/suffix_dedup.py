"""Substring deduplication by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.chunks import CHUNK_BYTES, HASH_BITS, bucket_edges, chunk_of, pack, pieces, text_bytes, unpack
from lodestar.llm.shared import load

#: Length of the strings whose hashes pick anchors; at most the shortest match.
ANCHOR = 24


def _words64(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position on as a number; the data must be padded by 8 bytes."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    raw = data.tobytes()
    for r in range(min(8, n)):
        out[r::8] = np.frombuffer(raw, f"{order}u8", (n - r + 7) // 8, r)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, document, hash) of runs of string starts: all strings of `length` bytes of each document, in runs.

    A string's hash is the smallest hash of the ANCHOR-byte strings inside it, so it depends on the string
    alone, and neighbouring strings mostly share it: a hash stands for about a dozen strings.
    """
    k = min(ANCHOR, length)
    reach = length - k + 1
    padded = np.concatenate((data, np.zeros(length + 40, np.uint8)))
    parts = []
    for a in range(0, len(data), tk.PIECE):
        b = min(len(data), a + tk.PIECE)
        need = b - a + reach - 1
        u = _words64(padded[a : a + need + k + 8])
        h = u[:need] * np.uint64(0x9E3779B97F4A7C15)
        for at in [*range(8, k - 7, 8), k - 8][: (k + 7) // 8 - 1] if k > 8 else []:
            h ^= h >> np.uint64(29)
            h += u[at : at + need]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h >>= np.uint64(64 - HASH_BITS)
        low, width = h, 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: b - a], low[reach - width :][: b - a])
        low = low[: b - a]
        inner = offsets[(offsets > a) & (offsets < b)]
        ends = offsets[1:] - length + 1
        ends = ends[(ends > a) & (ends < b)]
        # An equal hash that enters at the right starts a run as well: else text that repeats itself is one long run.
        new = (low[1:] != low[:-1]) | (h[reach:] == low[1:])
        cut = np.unique(np.concatenate(([0], np.flatnonzero(new) + 1, inner - a, ends - a)))
        stop = np.append(cut[1:], b - a) + a
        start = cut + a
        doc = np.searchsorted(offsets, start, side="right") - 1
        whole = stop - 1 + length <= offsets[doc + 1]
        # Smallest values crowd at the low end; an odd factor spreads them over the range again, one to one.
        spread = (low[cut][whole] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << HASH_BITS) - 1)
        parts.append((start[whole], stop[whole] - 1, doc[whole], spread))
    if not parts:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def longest_previous_factor(data: np.ndarray, at: np.ndarray, owner: np.ndarray, cap: int, floor: int = 1) -> np.ndarray:
    """For each position, the longest match (up to cap bytes) with a position of a smaller owner; 0 if under floor.

    Positions are put in suffix order (by their first cap bytes, which data must have).  The nearest
    positions before and after in that order whose owner is smaller give the longest match with any
    smaller owner, as the common prefix only shrinks with the distance; both are found for all positions at
    once by following pointers that skip over larger owners.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words = _words64(padded, ">")
    steps = [*range(0, cap - 7, 8)]
    tail = cap - (steps[-1] + 8 if steps else 0)
    keys = [words[at + s] for s in steps]
    if tail:
        keys.append(words[at + cap - tail] >> np.uint64(64 - 8 * tail))
    order = np.lexsort(keys[::-1])
    common = np.zeros(n, np.int64)  # with the one before in suffix order
    alive = np.arange(1, n)
    for number, key in enumerate(keys):
        bits = 8 * tail if tail and number == len(keys) - 1 else 64
        differ = key[order[alive]] ^ key[order[alive - 1]]
        common[alive] += bits // 8
        other = differ != 0
        late = alive[other]
        x = differ[other]
        equal = np.zeros(len(x), np.int64)
        for shift in range(bits - 8, 0, -8):
            equal += (x >> np.uint64(shift)) == 0
        common[late] += equal - bits // 8
        alive = alive[~other]
    own = owner[order]
    best = np.zeros(n, np.int64)
    for forward in (False, True):
        mine, near = (own[::-1], np.append(0, common[1:][::-1])) if forward else (own, common)
        to = np.arange(-1, n - 1)
        near = near.copy()
        to[near < floor] = -1
        todo = np.flatnonzero(to >= 0)
        while len(todo):
            todo = todo[mine[to[todo]] >= mine[todo]]
            if not len(todo):
                break
            via = to[todo]
            near[todo] = np.minimum(near[todo], near[via])
            to[todo] = to[via]
            gone = to[todo] < 0
            todo = todo[~gone]
        match = np.where(to >= 0, near, 0)
        best = np.maximum(best, match[::-1] if forward else match)
    out = np.empty(n, np.int64)
    out[order] = np.where(best >= floor, best, 0)
    return out


def _repeated(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The indices of the positions whose string of that length may occur at another one (those of unique hash can't)."""
    words = _words64(np.concatenate((data, np.zeros(16, np.uint8))))
    hashes = np.zeros(len(at), np.uint64)
    for s in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        hashes ^= hashes >> np.uint64(31)
        hashes += words[at + s]
        hashes *= np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _firsts(texts: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its distinct text, and the smallest owner of each distinct text."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    smallest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(smallest, ids, owner)
    return ids, smallest


_SPANS = pa.schema([("chunk", pa.int32()), ("number", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("owner", pa.binary()), ("number", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("bytes", pa.binary())])


def _numbers(owners: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Numbers the documents of a chunk by id and text, the same way whatever order its rows come in."""
    order = np.lexsort((prints, owners))
    new = np.append(False, (owners[order][1:] != owners[order][:-1]) | (prints[order][1:] != prints[order][:-1]))[: len(order)]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def _grouped(chunk: np.ndarray, *columns: np.ndarray) -> list[list]:
    """Rows (chunk, packed columns...), one for each chunk."""
    order = np.argsort(chunk, kind="stable")
    ids, starts = np.unique(chunk[order], return_index=True)
    stops = np.append(starts, len(order))[1:]
    return [[int(c), *(col[order[a:b]].tobytes() for col in columns)] for c, a, b in zip(ids, starts, stops, strict=True)]


def removed(docs: DataFrame, length: int = 50) -> DataFrame:
    """Every row of docs as (doc_id, text, removed): the sorted byte ranges [from, to) that a smaller doc_id also has.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id,
    so the copy of the smallest id stays whole; strings never cross documents and are judged on the input.
    Three rounds between chunks of documents and buckets of hashes: which anchors occur in two chunks; the
    strings at shared anchors, of which equal ones in a chunk go once, are compared by suffix order and
    previous factors; the ranges found come back to their chunk.  A null text is empty.  Repeated rows (same
    id and text) stay repeated and are one document; rows of one id never take from each other; a null
    doc_id counts as greater than any other.  Extra columns are ignored.
    """
    total = text_bytes(docs)
    n = pieces(docs.sparkSession, total)
    n_groups = pieces(docs.sparkSession, total, CHUNK_BYTES // 4)  # of strings: as many bytes as the text, and sorting needs many times that
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = base.withColumn("owner", F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)))
    base = base.withColumn("print", F.xxhash64("text")).withColumn("chunk", chunk_of("owner", n))

    def held(table: pa.Table):
        data, offsets = tk.utf8(table.column("text"))
        return data, offsets, table.column("owner").to_numpy(), table.column("print").to_numpy()

    def ask(table: pa.Table) -> pa.Table:
        data, offsets, _, _ = held(table)
        hashes = np.unique(anchors(data, offsets, length)[3])
        edges = bucket_edges(hashes, n)
        some = np.flatnonzero(np.diff(edges))
        chunk = table.column("chunk")[0].as_py()
        blobs = [pack(hashes[edges[b] : edges[b + 1]]) for b in some]
        return pa.table([pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "hashes"])

    def answer(table: pa.Table) -> pa.Table:
        blobs = [unpack(x) for x in table.column("hashes").to_pylist()]
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in blobs])
        hashes = np.concatenate(blobs)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        shared = order[np.append(same, False) | np.append(False, same)]
        rows = _grouped(chunk[shared], hashes[shared])
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "hashes"])

    def strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = _SENT.empty_table()
        if not table.num_rows:
            return empty
        data, offsets, owners, prints = held(table)
        numbers = _numbers(owners, prints)
        first, last, doc, hash_ = anchors(data, offsets, length)
        wanted = [np.frombuffer(x, np.uint64) for x in answers.column("hashes").to_pylist()]
        order = np.lexsort((doc, hash_))
        h, d = hash_[order], doc[order]
        # A hash that two documents of this chunk have is shared as well.
        twice = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        wanted = np.unique(np.concatenate([*wanted, twice]))
        if not len(wanted):
            return empty
        place = np.minimum(np.searchsorted(wanted, hash_), len(wanted) - 1)
        keep = np.flatnonzero(wanted[place] == hash_)
        first, last, doc, hash_ = first[keep], last[keep], doc[keep], hash_[keep]
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
        owner = owners[doc]
        ids, smallest = _firsts(texts, owner)
        late = owner > smallest[ids]  # all its strings are in a smaller document of this chunk
        rows = []
        chunk = table.column("chunk")[0].as_py()
        begin = (first - offsets[doc]).astype(np.int32)
        end = (last - offsets[doc] + length).astype(np.int32)
        number = numbers[doc]
        if late.any():
            rows.append([chunk * n_groups // n, chunk, b"", number[late].tobytes(), begin[late].tobytes(), end[late].tobytes(), b""])
        go = np.flatnonzero(~late)
        go = go[np.argsort(hash_[go], kind="stable")]
        edges = bucket_edges(hash_[go], n_groups)
        packer = zstandard.ZstdCompressor(level=1)
        for b in np.flatnonzero(np.diff(edges)):
            part = go[edges[b] : edges[b + 1]]
            joined = packer.compress(b"".join(texts[i] for i in part.tolist()))
            rows.append([int(b), chunk, owner[part].tobytes(), number[part].tobytes(), begin[part].tobytes(), end[part].tobytes(), joined])
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

    def factors(table: pa.Table) -> pa.Table:
        passed, parts = [], []
        for r in table.to_pylist():
            if r["owner"]:
                parts.append(r)
            else:
                passed.append([r["chunk"], r["number"], r["first"], r["last"]])
        if parts:
            column = lambda name, kind=np.int32: np.concatenate([np.frombuffer(r[name], kind) for r in parts])
            owner, number, begin = column("owner", np.int64), column("number"), column("first")
            size = (column("last") - begin).astype(np.int64)
            chunk = np.repeat([r["chunk"] for r in parts], [len(r["number"]) // 4 for r in parts])
            unpacker = zstandard.ZstdDecompressor()
            raw = b"".join(unpacker.decompress(r["bytes"]) for r in parts)
            stops = np.cumsum(size)
            texts = [raw[a:b] for a, b in zip((stops - size).tolist(), stops.tolist(), strict=True)]
            ids, smallest = _firsts(texts, owner)
            whole = owner > smallest[ids]
            # Distinct texts, each under its smallest owner, are compared string by string.
            one = np.full(len(smallest), -1)
            one[ids[::-1]] = np.arange(len(ids))[::-1]
            sizes = size[one]
            data = np.frombuffer(b"".join(texts[i] for i in one.tolist()), np.uint8)
            starts = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            at = _ranges(starts, windows)
            text = np.repeat(np.arange(len(one)), windows)
            again = _repeated(data, at, length)
            hit = np.zeros(len(at), bool)
            hit[again] = longest_previous_factor(data, at[again], smallest[text[again]], length, length) >= length
            # Runs of hit strings in each text, given to every holder that isn't removed as a whole.
            step = np.flatnonzero(hit)
            new = np.ones(len(step), bool)
            new[1:] = (step[1:] != step[:-1] + 1) | (text[step[1:]] != text[step[:-1]])
            run_start = step[new]
            run_stop = step[np.append(new[1:], True)] if len(step) else step
            run_text = text[run_start]
            run_from = at[run_start] - starts[run_text]
            run_to = at[run_stop] - starts[run_text] + length
            edges = np.searchsorted(run_text, np.arange(len(one) + 1))
            rest = np.flatnonzero(~whole)
            counts = (edges[1:] - edges[:-1])[ids[rest]]
            pick = _ranges(edges[:-1][ids[rest]], counts)
            holder = np.repeat(rest, counts)
            all_of = np.flatnonzero(whole)
            holders = np.concatenate((all_of, holder))
            lo = np.concatenate((begin[all_of], begin[holder] + run_from[pick])).astype(np.int32)
            hi = np.concatenate((begin[all_of] + size[all_of], begin[holder] + run_to[pick])).astype(np.int32)
            passed += _grouped(chunk[holders], number[holders], lo, hi)
        return pa.Table.from_arrays([pa.array([r[i] for r in passed], f.type) for i, f in enumerate(_SPANS)], schema=_SPANS)

    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts, hit = table.column("doc_id").to_pylist(), table.column("text").to_pylist(), []
        column = lambda name: np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in spans.column(name).to_pylist())])
        number, lo, hi = (column(x) for x in ("number", "first", "last"))
        order = np.lexsort((lo, number))
        number, lo, hi = number[order], lo[order], hi[order]
        own = _numbers(table.column("owner").to_numpy(), table.column("print").to_numpy())
        for a, b in zip(np.searchsorted(number, own), np.searchsorted(number, own, "right"), strict=True):
            reach = np.maximum.accumulate(hi[a:b])
            new = np.flatnonzero(np.append(True, lo[a + 1 : b] > reach[:-1])) if b > a else np.zeros(0, np.int64)
            stops = reach[np.append(new[1:], b - a) - 1] if b > a else new
            hit.append([{"from": int(x), "to": int(y)} for x, y in zip(lo[a:b][new], stops, strict=True)])
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(hit, kind)], ["doc_id", "text", "removed"])

    asked = base.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, hashes binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk int, hashes binary")
    grouped = base.groupBy("chunk")
    sent = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(strings, "bucket int, chunk int, owner binary, number binary, first binary, last binary, bytes binary")
    spans = sent.groupBy("bucket").applyInArrow(factors, "chunk int, number binary, first binary, last binary")
    return grouped.cogroup(spans.groupBy("chunk")).applyInArrow(finish, "doc_id long, text string, removed array<struct<from: long, to: long>>")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): each document without the strings that a smaller doc_id has."""

    def cut(batches):
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            kept, n_removed = [], []
            for d, spans in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[d] : offsets[d + 1]]
                mask = np.ones(len(text), bool)
                for s in spans:
                    mask[s["from"] : s["to"]] = False
                kept.append(text[mask].tobytes() if spans else text.tobytes())
                n_removed.append(len(text) - len(kept[-1]))
            counts = [len(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return removed(docs, length).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS i FROM n WHERE n_bytes >= 50)),
m AS (SELECT md5(w) AS k, min(doc_id) AS smallest FROM s GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i + 50 AS j FROM s JOIN m ON md5(w) = k WHERE doc_id > smallest),
mark AS (SELECT doc_id, i, max(j) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, j FROM hit),
grp AS (SELECT doc_id, i, j, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, g, min(i) AS a, max(j) AS b FROM grp GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT n.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM n JOIN edge USING (doc_id) GROUP BY n.doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)
"""
