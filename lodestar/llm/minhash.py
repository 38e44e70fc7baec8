"""Bands of min-hashes, prefixes of sets, and groups connected through what shares one: helpers of the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.shared import components, frugal, merged, shuffle_partitions, stored

#: Rows of one part of a block; a task compares two parts at a time.
TILE = 256
#: Shingles that are known as common at most, and rows at least of the sample in which they are counted.
MOST_COMMON, SAMPLED = 1 << 16, 5_000
#: Bags of a set's values at most, unless one would hold over 255; their numbers bound what two sets share.
MOST_BAGS = 4096
#: Keys up to this many may be broadcast.
FEW_KEYS = 200_000
#: Entries that a task holds before it sends them or, of one slice, before it ties them.
FLUSH = 1 << 18


def bands(hashes: np.ndarray, first: np.ndarray, n_bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """[groups, n_bands] values; two groups hashes[first[g]:first[g+1]] share one with odds of their similarity to the power rows.

    Each min-hash takes the features in an order of its own.  The second result, [groups, n_bands * rows], has
    a byte of each, those of a band side by side; the share of equal ones estimates the similarity.
    """
    n = len(first) - 1
    odd = np.random.default_rng(42).integers(1, 1 << 31, n_bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full((n_bands * rows, n), 0xFFFFFFFF, np.uint32)
    sizes = np.diff(first)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    # Groups of about one size are the columns of a matrix; columns are filled up with their first feature.
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    start = 0
    while start < len(order):
        size = int(sizes[order[start]])
        stop = int(np.searchsorted(sizes[order], size + max(4, size // 8), side="right"))
        stop = min(stop, start + max(1, (1 << 18) // (size + max(4, size // 8))))
        own = order[start:stop]
        rank = np.arange(int(sizes[own[-1]]))[:, None]
        table = low[first[:-1][own] + np.where(rank < sizes[own], rank, 0)]
        for k, factor in enumerate(odd):
            least[k, own] = np.multiply(table, factor).min(axis=0)
        start = stop
    value = np.repeat(tk.mix(np.arange(1, n_bands + 1, dtype=np.uint64))[:, None], n, axis=1)
    for k in range(rows):
        value = tk.mix(value * np.uint64(0xFF51AFD7ED558CCD) + least[k::rows])
    sketch = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return np.ascontiguousarray(value.T), np.ascontiguousarray(sketch.T.astype(np.uint8))


class Same:
    """Whether two forms are alike: __call__ decides; near(forms, block)(x) marks those after the x-th to compare in that block."""

    def __call__(self, a, b) -> bool:
        raise NotImplementedError

    def near(self, forms: list, block: int) -> Callable[[int], np.ndarray]:
        return lambda x: np.ones(len(forms) - x - 1, bool)


class Jaccard(Same):
    """Sets of 64-bit values (ascending, as bytes) with a Jaccard similarity of at least `least`."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if min(len(x), len(y)) < self.least * max(len(x), len(y)) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.least * (len(x) + len(y) - both) - 1e-9

    def near(self, forms: list, block: int) -> Callable[[int], np.ndarray]:
        size = np.array([len(f) for f in forms])
        return lambda x: np.minimum(size[x + 1 :], size[x]) >= self.least * np.maximum(size[x + 1 :], size[x]) - 1e-6


def bags(values: np.ndarray) -> bytes:
    """How many of a set's values are in each of its bags, of which there are about a quarter as many as values: a power of two; a byte each."""
    n = min(MOST_BAGS, max(16, 1 << (len(values) // 4).bit_length()))
    while (held := np.bincount((values & np.uint64(n - 1)).view(np.int64), minlength=n)).max() > 255:
        n *= 2
    return held.astype(np.uint8).tobytes()


def _folded(bag: np.ndarray, n: int) -> np.ndarray:
    return bag.reshape(-1, n).sum(axis=0, dtype=np.uint32)


class Bags(Same):
    """Whether sets may have a Jaccard similarity of at least `least`, by their bags().

    No more values of a bag are in both sets than the lesser of the two numbers.  The one with more bags is
    folded to as many as the other has.
    """

    def __init__(self, least: float):
        self.least = least

    def __call__(self, a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        n = min(len(x), len(y))
        both = int(np.minimum(_folded(x, n), _folded(y, n)).sum())
        return both >= self.least * (int(x.sum()) + int(y.sum()) - both) - 1e-6

    def near(self, forms: list, block: int) -> Callable[[int], np.ndarray]:
        own = [np.frombuffer(f, np.uint8) for f in forms]
        level, size = np.array([len(b) for b in own]), np.array([int(b.sum()) for b in own])
        table = {n: np.array([_folded(b, n) if len(b) >= n else np.zeros(n, np.uint32) for b in own]) for n in np.unique(level).tolist()}

        def fit(x: int) -> np.ndarray:
            out = np.minimum(size[x + 1 :], size[x]) >= self.least * np.maximum(size[x + 1 :], size[x]) - 1e-6
            low = np.minimum(level[x + 1 :], level[x])
            for n in np.unique(low[out]).tolist():
                some = np.flatnonzero(out & (low == n))
                both = np.minimum(table[n][x + 1 + some], table[n][x]).sum(axis=1)
                out[some] = both >= self.least * (size[x + 1 + some] + size[x] - both.astype(np.int64)) - 1e-6
            return out

        return fit


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _alike(pairs: DataFrame, forms: DataFrame, same: Same) -> DataFrame:
    """Those of the pairs (a, b) whose forms are alike."""
    right = pairs.join(merged(forms.toDF("b", "right")), "b")
    both = right.join(merged(forms.toDF("a", "left")), "a").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [same(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fit, pa.bool_()))

    return both.mapInArrow(frugal(run), "a long, b long")


def _rest(members: DataFrame, forms: DataFrame, same: Same, mark: bool = False) -> DataFrame:
    """Links (a, b) between members (block, key, root) of one block but different roots that are alike, a spanning set of them.

    With `mark`, (a: block, b: key) of the members instead that are near() one of another root.

    Members are dealt to parts of TILE rows; of the block's most common root, whose members are connected
    already, no two parts meet, so the work follows what is not connected.  Every other two parts meet in a
    task of their own.
    """
    of_root = members.groupBy("block", "root").agg(F.count("*").alias("n"))
    sizes = of_root.groupBy("block").agg(F.max_by("root", "n").alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"))
    parts = sizes.select("block", "top", F.ceil(F.col("n_top") / TILE).alias("tops"), F.ceil((F.col("n") - F.col("n_top")) / TILE).alias("others"))
    met = members.join(stored(parts), "block").withColumn("is_top", F.col("root") == F.col("top"))
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others")))
    met = met.withColumn("mine", F.when(F.col("is_top"), F.col("others") + mine).otherwise(mine))
    number = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    met = met.withColumn("other", F.explode(number(F.when(F.col("is_top"), F.col("others")).otherwise(F.col("others") + F.col("tops")))))
    met = met.select("key", "root", "mine", "block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    met = met.join(forms.toDF("key", "form"), "key").select(F.xxhash64("block", "i", "j").alias("tile"), "block", "i", "j", "key", "root", "mine", "form")

    def compare(held: list[tuple]) -> list[tuple[int, int]]:
        forms_ = [r[6] for r in held]
        near = same.near(forms_, held[0][0])
        apart, mine = held[0][1] != held[0][2], np.array([r[5] for r in held])
        parent = {r[4]: r[4] for r in held}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        if mark:
            roots, marked = np.array([r[4] for r in held]), np.zeros(len(held), bool)
            for x in range(len(held) - 1):
                fit = np.flatnonzero(near(x) & (roots[x + 1 :] != roots[x]) & (not apart or mine[x + 1 :] != mine[x])) + x + 1
                marked[fit] = True
                marked[x] |= len(fit) > 0
            return [(r[0], r[3]) for r, m in zip(held, marked.tolist(), strict=True) if m]
        for x in range(len(held) - 1):
            fit = np.flatnonzero(near(x)) + x + 1
            for y in (fit[mine[fit] != mine[x]] if apart and len(fit) else fit).tolist():
                a, b = top(held[x][4]), top(held[y][4])
                if a != b and same(forms_[x], forms_[y]):
                    parent[b] = a
                    found.append((held[x][3], held[y][3]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns)), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield _pair_batch(compare(held))
                    held = []
                held.append(row)
        if held:
            yield _pair_batch(compare(held))

    dealt = met.repartition(shuffle_partitions(members.sparkSession), "tile").sortWithinPartitions("tile", "block", "i", "j", "key")
    return dealt.mapInArrow(frugal(run), "a long, b long")


def connected(links: DataFrame, forms: DataFrame | Callable[[DataFrame], DataFrame], same: Same, shapes: DataFrame | None = None, may: Same | None = None) -> DataFrame:
    """(node, root) of all keys that are connected by pairs that share a block and are alike.

    links (block, a, b) tie the members of each block together, one link a member or so; forms are (key, form),
    or give them for a table of keys.  With shapes (key, form) and `may`, which holds for the shapes of all that
    are alike, forms are only asked for, and compared, where the shapes allow it.
    First the links themselves are tried, which connects most of what is alike; then, in blocks that are not
    connected as a whole by then, every two members that are not.  So no block's pairs are all emitted, and
    no two alike members of a block stay apart.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    of = forms if callable(forms) else lambda keys: forms
    pairs = stored(links.where("a <> b").select(*pair).distinct())
    able = pairs if shapes is None else stored(_alike(pairs, shapes, may))
    good = stored(_alike(able, of(able.select(F.explode(F.array("a", "b")).alias("key"))), same))
    roots = stored(components(good))
    top = lambda c: merged(roots.toDF(c, f"root_{c}"))
    apart = pairs.join(top("a"), "a", "left").join(top("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)")
    ties = links.select("block", *pair)
    # Blocks in which a link failed; the two members of a block of two were a pair already.
    open_ = ties.join(merged(apart.select("a", "b")), ["a", "b"], "left_semi").select("block").distinct()
    ties = stored(ties.join(merged(open_), "block", "left_semi"))
    members = ties.select("block", F.explode(F.array("a", "b")).alias("key")).distinct()
    large = members.groupBy("block").agg(F.count("*").alias("n")).where("n > 2").select("block")
    members = stored(members.join(stored(large), "block"))
    if members.isEmpty():
        return roots
    named = members.join(top("key"), "key", "left").select("block", "key", F.coalesce("root_key", "key").alias("root"))
    named = stored(named)
    if shapes is not None:
        some = _rest(named, shapes, may, mark=True).toDF("block", "key").distinct()
        named = stored(named.join(some, ["block", "key"], "left_semi"))
    late = stored(_rest(named, of(named.select("key")), same))
    return components(good.unionByName(late)) if not late.isEmpty() else roots


def _shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, hashes, first hash of each row) of blocks of texts; a text shorter than a shingle has one of all its words."""
    whole, bounds = tk.utf8(column)
    for x, y in tk.document_blocks(bounds):
        w = tk.words(whole[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], tk.WHITESPACE)
        sizes = np.diff(w.first)
        parts, owners = [], []
        for width in range(1, size + 1):
            at = tk.windows(w.first, width)
            if width < size:
                at = at[sizes[w.doc[at]] == width]
            parts.append(tk.chain(w.hash, width)[at])
            owners.append(w.doc[at])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield x, y, np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(y - x + 1))


def sets(docs: DataFrame, size: int) -> DataFrame:
    """key, shingles: the set of the text's shingles, ascending, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, hashes, first in _shingles(batch.column(1), size):
                unique = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(unique, pa.binary())], ["key", "shingles"])

    return docs.select("key", "text").mapInArrow(frugal(run), "key long, shingles binary")


def prefixes(docs: DataFrame, size: int, least: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """key, print (of the set of the text's shingles), its bags, prefix: so many of the set that two of Jaccard `least` share one.

    Of n shingles, a set as alike as that has ceil(least * n), so it can't lack all of any n - ceil(least * n) + 1.
    If both sets take those that come first in one order, whatever order, the first that they share is in both
    prefixes.  The order is by how common a shingle is, as far as `common` knows, then by its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, hashes, first in _shingles(batch.column(1), size):
                unique = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                prints = [int(tk.mix(np.array([np.add.reduce(tk.mix(s), dtype=np.uint64) + np.uint64(len(s))]))[0]) for s in unique]
                counts = np.array([len(s) for s in unique])
                ends = np.cumsum(counts)
                grade = np.zeros(ends[-1], np.uint8)
                if common is not None and len(common[0]):
                    every = np.concatenate(unique)
                    at = np.minimum(np.searchsorted(common[0], every), len(common[0]) - 1)
                    grade = np.where(common[0][at] == every, common[1][at], 0).astype(np.uint8)
                need = np.minimum(counts, counts - np.ceil(least * counts - 1e-6).astype(np.int64) + 1)
                out = [np.zeros(0, np.uint64)]
                for s, n, end in zip(unique, need.tolist(), ends.tolist(), strict=True):
                    own = grade[end - len(s) : end]
                    out.append(s[np.argsort(own, kind="stable")[:n]] if own.any() else s[:n])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(need)), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))
                columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([bags(s) for s in unique], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *columns], ["key", "print", "bags", "prefix"])

    return docs.select("key", "text").mapInArrow(frugal(run), "key long, print long, bags binary, prefix array<long>")


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending; their grade): the MOST_COMMON at most that are in the most different sets of a sample.

    It only puts shingles in order, so what the sample has missed costs time, not results.
    """
    every = max(1, min(64, docs.count() // SAMPLED))
    found = prefixes(docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0), size, 0.0).dropDuplicates(["print"])
    counts = found.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    counts = stored(counts.select("shingle", F.log2("n").cast("int").alias("grade")))
    least, held = 0, 0
    for grade, n in sorted(counts.groupBy("grade").count().collect(), reverse=True):
        held += n
        if held > MOST_COMMON:
            least = grade + 1
            break
    rows = counts.where(F.col("grade") >= least).toArrow()
    shingle, grade = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], grade[order].astype(np.uint8)


def _firsts(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): entries by name, as they came within one, and for each place in that order the first of its name."""
    order = np.argsort(name, kind="stable")
    start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))[: len(order)]
    return order, np.repeat(start, np.diff(np.append(start, len(order))))


def ties(found: DataFrame) -> DataFrame:
    """Links (block, a, b) that tie the prints of found (print, prefix) together which have a shingle in common; a block is a shingle.

    Entries go out packed, by slices of the shingles' hashes.  A task ties what it holds itself to the first of
    a shingle and sends only that one on; a slice is streamed through, its first key of a shingle being what the
    later ones are tied to.  A block is named by its slice and 32 more bits, so a few prints are tied that share
    no shingle; nothing but a comparison comes of it.
    """
    spark = found.sparkSession
    few = 2 * shuffle_partitions(spark)
    slices = min(512 * few, max(few, int(found.agg(F.sum(F.size("prefix"))).first()[0] or 0) // FLUSH))

    def send(keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, length = np.concatenate(keys), np.concatenate([np.diff(np.append(0, e)) for _, e in values])
        key, at = np.unique(key, return_index=True)  # equal sets have equal prefixes
        start = np.cumsum(length)[at] - length[at]
        length = length[at]
        take = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        key, value = np.repeat(key, length), tk.mix(np.concatenate([v for v, _ in values])[take])
        name = ((value >> np.uint64(32)) % np.uint64(slices) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
        order, first = _firsts(name)
        name, key = name[order], key[order]
        place = np.arange(len(key))
        heads, later = np.flatnonzero(first == place), np.flatnonzero(first != place)
        part = (name >> np.uint64(32)).astype(np.int64)
        some = np.unique(part)
        edges, edges_later = (np.searchsorted(part[x], np.append(some, slices)) for x in (heads, later))
        entries, tied = [], []
        for k in range(len(some)):
            h, t = heads[edges[k] : edges[k + 1]], later[edges_later[k] : edges_later[k + 1]]
            entries.append(name[h].astype(np.uint32).tobytes() + key[h].tobytes())
            tied.append(name[t].tobytes() + key[first[t]].tobytes() + key[t].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(entries, pa.binary()), pa.array(tied, pa.binary())], ["slice", "entries", "ties"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            prefix = batch.column(1)
            keys.append(batch.column(0).to_numpy())
            values.append((prefix.flatten().to_numpy().view(np.uint64), np.cumsum(prefix.value_lengths().to_numpy())))
            held += len(values[-1][0])
            if held >= FLUSH:
                yield from send(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield from send(keys, values)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, leads = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of(block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (block, a, b)], ["block", "a", "b"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal names, leads
            if not waiting:
                return
            name, key = np.concatenate([names, *(x for x, _ in waiting)]), np.concatenate([leads, *(k for _, k in waiting)])
            waiting.clear()
            order, first = _firsts(name)
            name, key = name[order], key[order]
            place = np.arange(len(key))
            later = np.flatnonzero(first != place)
            names, leads = name[first == place], key[first == place]
            if len(later):
                yield batch_of(name[later].astype(np.uint64) | np.uint64(current << 32), key[first[later]], key[later])

        for batch in batches:
            for part, entries, tied in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != current:
                    yield from settle()
                    current, names, leads = part, names[:0], leads[:0]
                count = len(entries) // 12
                waiting.append((np.frombuffer(entries, np.uint32, count), np.frombuffer(entries, np.int64, count, 4 * count)))
                if tied:
                    yield batch_of(*np.frombuffer(tied, np.uint64).reshape(3, -1))
                if sum(len(x) for x, _ in waiting) >= FLUSH:
                    yield from settle()
        yield from settle()

    dealt = found.select("print", "prefix").mapInArrow(frugal(deal), "slice int, entries binary, ties binary").repartition(shuffle_partitions(spark), "slice")
    return dealt.sortWithinPartitions("slice").mapInArrow(frugal(stream), "block long, a long, b long").where("a <> b")
