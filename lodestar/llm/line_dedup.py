"""Fuzzy line deduplication: bands of normalised lines, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import minhash
from lodestar.llm import textkernel as tk
from lodestar.llm.minhash import connected
from lodestar.llm.shared import frugal, load, merged, scratch, shuffle_partitions, stored

SIMILARITY = 0.8
#: Lines are candidates if they share one of BANDS bands of ROWS min-hashes of their pairs of words, each with its place in stretches of STRETCH words.
BANDS, ROWS, STRETCH = 16, 3, 32
#: Lines that share a band are compared if this share of all their min-hashes is equal: with an edit similarity of 0.8 it is.
AGREE = 0.3
#: Lines of 4 words up to this many have their halves in place of the last four bands.
SHORT = 15
#: Entries that a task holds before it sends them, and bytes of the table for each slice.
FLUSH, SLICE_BYTES = 1 << 20, 4 << 20
FILTER_BITS = 24
_LAST = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of two integers; some number over `most` if it is more.

    The distance of two beginnings of one length, less the difference in length, is no more than that of the whole.
    """
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, apart = (1 << len(a)) - 1, 1 << (len(a) - 1), abs(len(a) - len(b))
    more, less, distance = full, 0, len(a)  # rows at which the column's value goes up or down by one
    for j, c in enumerate(b):
        if j & 31 == 0 and most < j < len(a):
            head = (1 << j) - 1
            beginnings = j + (more & head).bit_count() - (less & head).bit_count()
            if beginnings - apart > most:
                return beginnings - apart
        match = where.get(c, 0)
        diagonal = (((match & more) + more) ^ more) | match | less
        right_more, right_less = less | (full & ~(diagonal | more)), more & diagonal
        distance += 1 if right_more & top else -1 if right_less & top else 0
        right_more, right_less = (right_more << 1 | 1) & full, right_less << 1 & full
        more, less = right_less | (full & ~(diagonal | right_more)), right_more & diagonal
    return distance


def similar(a: str, b: str, least: float) -> bool:
    """True if 1 - edit distance / longer length is at least `least`."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if shorter < least * longer - 1e-9:
        return False
    if a == b:
        return True
    # One way to edit is found at sight; if it is cheap enough, so is the best way.
    if _edits_at_most(a.split(" "), b.split(" "), (1 - least) * longer):
        return True
    # What both begin and end with costs nothing.
    head = _common(lambda n: a[:n] == b[:n], shorter)
    tail = _common(lambda n: a[len(a) - n :] == b[len(b) - n :], shorter - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    most = (1 - least) * longer + 1e-6
    distance = edit_distance(a, b, most)
    return distance <= most and 1 - distance / longer >= least - 1e-9


class EditSimilar(minhash.Same):
    """similar() of two lines, given as forms: the line's sketch and its text.

    Compared are lines whose sketches agree in AGREE of their bytes, in the block of the first band that they
    share; one of the last four bands, which may be halves, counts if there is no other.  near() also has an
    exact bound: of two texts, letters that the other lacks must be edited.
    """

    def __init__(self, least: float):
        self.least = least

    def __call__(self, a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint8, BANDS * ROWS), np.frombuffer(b, np.uint8, BANDS * ROWS)
        if np.count_nonzero(x == y) < AGREE * BANDS * ROWS:
            return False
        return similar(a[BANDS * ROWS :].decode(), b[BANDS * ROWS :].decode(), self.least)

    def near(self, forms: list[bytes], block: int) -> Callable[[int], np.ndarray]:
        sketch = np.array([np.frombuffer(f, np.uint8, BANDS * ROWS) for f in forms])
        n, first = len(forms), min(block % BANDS, BANDS - 4)
        fits = np.empty((n, n), bool)
        rows = max(1, (1 << 20) // (n * BANDS * ROWS))
        for a in range(0, n, rows):
            equal = sketch[a : a + rows, None] == sketch[None]
            before = equal.reshape(*equal.shape[:2], BANDS, ROWS)[:, :, :first].all(axis=3).any(axis=2)
            fits[a : a + rows] = (np.count_nonzero(equal, axis=2) >= AGREE * BANDS * ROWS) & ~before
        fits = np.triu(fits, 1)
        some = np.flatnonzero(fits.any(axis=0) | fits.any(axis=1))
        # Bytes for letters: a letter may have four bytes, of which only the first is counted.
        bags = np.zeros((n, 63), np.int32)
        for k in some.tolist():
            bags[k] = np.bincount(np.frombuffer(forms[k][BANDS * ROWS :].translate(_HEAD), np.uint8), minlength=64)[1:]
        size = bags.sum(axis=1)

        def fit(x: int) -> np.ndarray:
            out = fits[x, x + 1 :].copy()
            some = np.flatnonzero(out)
            if len(some):
                differ = bags[x + 1 :][some] - bags[x]
                apart = np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1))
                out[some] = apart <= (1 - self.least) * np.maximum(size[x + 1 :][some], size[x]) + 1e-6
            return out

        return fit


#: How far to look ahead in either line for the next word they share, nearest first.
_AHEAD = sorted(((i, j) for i in range(4) for j in range(4) if i + j), key=lambda p: (p[0] + p[1], abs(p[0] - p[1])))


def _edits_at_most(a: list[str], b: list[str], most: float) -> bool:
    """True if matching words in order, and replacing what lies between, takes no more than `most` edits of letters."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        x, y = next(((x, y) for x, y in _AHEAD if i + x < len(a) and j + y < len(b) and a[i + x] == b[j + y]), (1, 1))
        cost += max(sum(map(len, a[i : i + x])) + x, sum(map(len, b[j : j + y])) + y)
        if cost > most:
            return False
        i, j = i + x, j + y
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j) <= most


def _common(same, most: int) -> int:
    """The largest n up to most for which same(n) holds."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same(middle) else (low, middle - 1)
    return low


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, document, number within it) of every line."""
    breaks = np.flatnonzero(data == 10) + 1
    start = np.concatenate((offsets[:-1], breaks))
    owner = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, side="right") - 1))
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    return start, owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tk.Words]:
    """(document, number within it, key, words) of every line; the key, a hash of its words in order, is 0 for none."""
    start, owner, number = _split(data, offsets)
    w = tk.words(data, np.append(start, len(data)), tk.NON_WORD)
    sizes = np.diff(w.first)
    key = np.zeros(len(owner), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        rank = np.arange(len(w.hash)) - np.repeat(w.first[:-1][some], sizes[some])
        powers = tk._power_tables(int(sizes.max()) + 1)[0]
        key[some] = np.maximum(tk.mix(np.add.reduceat(w.hash * powers[rank], w.first[:-1][some]) + sizes[some].astype(np.uint64)), 1)
    return owner, number, key, w


#: First bytes of letters, in 1 to 63; the others are 0.
_HEAD = bytes(0 if 0x80 <= b < 0xC0 else 1 + b % 63 for b in range(256))
_TO_BLANK = tk.LOWER.copy()
_TO_BLANK[tk.NON_WORD[tk.LOWER]] = 32


def _normal(line: np.ndarray) -> bytes:
    return b" ".join(_TO_BLANK[line].tobytes().split())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("print"), "text")


_READ = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("slice", pa.int32()), ("entries", pa.binary()), ("ties", pa.binary())])


def line_bands(w: tk.Words, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lines, BANDS] values, and sketches, of the lines of these numbers, each with a word: by their pairs of neighbouring words.

    A pair counts with the stretch of the line that it is in, so that lines are not drawn together by a passage
    which both hold somewhere.  Short lines keep too little where a word differs, so they are filed under their
    halves as well, as they are and as if they had a word less: whatever differs in one word, or by one, shares
    one of the two.
    """
    counts = np.diff(w.first)[lines]
    first = np.append(0, np.cumsum(counts))
    rank = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    at = rank + np.repeat(w.first[:-1][lines], counts)
    pairs = np.append(tk.chain(w.hash, 2), np.zeros(1, np.uint64))[at] + (rank // STRETCH).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    # The last word is in no other pair; it stands alone if there is no other.
    last = first[1:] - 1
    pairs[last] = w.hash[at[last]]
    keep = np.ones(len(at), bool)
    keep[last[counts > 1]] = False
    out, sketch = minhash.bands(tk.mix(pairs[keep]), first - np.append(0, np.cumsum(counts > 1)), BANDS, ROWS)
    short = np.flatnonzero((counts >= 4) & (counts <= SHORT))
    powers = tk._power_tables(SHORT)[0]
    for band, (less, end) in enumerate(((0, False), (0, True), (1, False), (1, True)), BANDS - 4):
        n = counts[short] - less
        size = n - n // 2 if end else n // 2
        some, size = short[size > 1], size[size > 1]
        if len(some):
            edge = np.append(0, np.cumsum(size))
            rank = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
            start = first[some] + (counts[some] - size if end else 0)
            total = np.add.reduceat(w.hash[at[np.repeat(start, size) + rank]] * powers[rank], edge[:-1])
            out[some, band] = tk.mix(total + (size + 64 * end).astype(np.uint64))
    return out, sketch


def read_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, print, line, key) of each line that has a word, and links (block, a, b): one pass over the text.

    The links tie the keys of all lines together that share a band's value, the block.  A task links the lines
    that it holds itself to the first of them, and sends only that one on, so a value that is everywhere costs
    an entry a task.  Slices of the values are streamed through: the first key of a value is what the later ones
    are linked to.  A block is named by its band and 28 bits of the value beside those that decide its slice, so
    a few lines are tied that share none; nothing but a comparison comes of it.
    """
    spark = docs.sparkSession
    few = 2 * shuffle_partitions(spark)
    # By the size that Catalyst expects: it only decides how many entries a slice has.
    slices = min(512 * few, max(few, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SLICE_BYTES))

    def tie(name: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, first): entries by name, and for each the place of the first of its name."""
        order = np.argsort(name, kind="stable")
        start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))[: len(order)]
        return order, np.repeat(start, np.diff(np.append(start, len(order))))

    def send(keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, at = np.unique(np.concatenate(keys), return_index=True)
        value = np.concatenate(values)[at]
        low = value & _LOW
        low += np.arange(BANDS, dtype=np.uint64) - low % np.uint64(BANDS)
        key = np.repeat(key, BANDS)
        name = ((((value >> np.uint64(32)) % np.uint64(slices)) << np.uint64(32)) | low).ravel()
        order, first = tie(name, key)
        name, key = name[order], key[order]
        place = np.arange(len(key))
        heads, later = np.flatnonzero(first == place), np.flatnonzero((first != place) & (key != key[first]))
        part = (name >> np.uint64(32)).astype(np.int64)
        found = np.unique(part)
        edges, edges_later = (np.searchsorted(part[x], np.append(found, slices)) for x in (heads, later))
        for some in np.array_split(np.arange(len(found)), 1 + len(found) // 1024):
            entries, ties = [], []
            for k in some:
                h, t = heads[edges[k] : edges[k + 1]], later[edges_later[k] : edges_later[k + 1]]
                entries.append((name[h] & _LOW).astype(np.uint32).tobytes() + key[h].tobytes())
                ties.append(name[t].tobytes() + key[first[t]].tobytes() + key[t].tobytes())
            columns = {"slice": pa.array(found[some].astype(np.int32)), "entries": pa.array(entries, pa.binary()), "ties": pa.array(ties, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(some), f.type)) for f in _READ], schema=_READ)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            data, offsets = tk.utf8(batch.column(2))
            for a, b in tk.document_blocks(offsets):
                owner, number, key, w = _lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = np.flatnonzero(key)
                take = pa.array(owner[keep] + a)
                place = [batch.column(0).take(take), batch.column(1).take(take), pa.array(number[keep].astype(np.int32)), pa.array(key[keep].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*place, *(pa.nulls(len(keep), f.type) for f in list(_READ)[4:])], schema=_READ)
                names, lines = np.unique(key, return_index=True)
                names, lines = names[names > 0], lines[names > 0]
                if len(names):
                    keys.append(names)
                    values.append(line_bands(w, lines)[0])
                    held += len(names) * BANDS
                if held >= FLUSH:
                    yield from send(keys, values)
                    keys, values, held = [], [], 0
        if held:
            yield from send(keys, values)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, leads = None, np.zeros(0, np.uint32), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of(block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (block, a, b)], ["block", "a", "b"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal names, leads
            if not waiting:
                return
            name, key = np.concatenate([names, *(x for x, _ in waiting)]), np.concatenate([leads, *(k for _, k in waiting)])
            waiting.clear()
            order, first = tie(name, key)
            name, key = name[order], key[order]
            place = np.arange(len(key))
            later = np.flatnonzero((first != place) & (key != key[first]))
            names, leads = name[first == place], key[first == place]
            if len(later):
                yield batch_of(name[later].astype(np.uint64) | np.uint64(current << 32), key[first[later]], key[later])

        for batch in batches:
            for part, entries, ties in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != current:
                    yield from settle()
                    current, names, leads = part, names[:0], leads[:0]
                count = len(entries) // 12
                waiting.append((np.frombuffer(entries, np.uint32, count), np.frombuffer(entries, np.uint64, count, 4 * count)))
                if ties:
                    yield batch_of(*np.frombuffer(ties, np.uint64).reshape(3, -1))
                if sum(len(x) for x, _ in waiting) >= FLUSH:
                    yield from settle()
        yield from settle()

    read = stored(_keyed(docs).mapInArrow(frugal(deal), "doc long, print long, line int, key long, slice int, entries binary, ties binary"))
    dealt = read.where("slice is not null").select("slice", "entries", "ties").repartition(shuffle_partitions(spark), "slice")
    links = dealt.sortWithinPartitions("slice").mapInArrow(frugal(stream), "block long, a long, b long")
    return read.where("slice is null").select("doc", "print", "line", "key"), stored(links)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, form: the sketch and the normal form of each line of wanted (key, first), from another pass over the text.

    Only the lines that are some key's first occurrence are needed.  A filter of fixed size drops nearly all
    others by their place alone; the join settles the rest.
    """
    top = F.shiftrightunsigned(F.col("first.doc").bitwiseXOR(F.col("first.print")), 64 - FILTER_BITS)
    place = top.bitwiseXOR(F.col("first.line").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("long")) + 1
    marked = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    # Dealt first, so that no task sends a whole bitmap of the few places that it knows.
    for r in marked.repartition(shuffle_partitions(docs.sparkSession), "bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow().to_pylist():
        start = (r["bucket"] - 1) * 4096
        bits[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = sent.value
        for batch in batches:
            data, offsets = tk.utf8(batch.column(2))
            top = (batch.column(0).to_numpy() ^ batch.column(1).to_numpy()).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            start, owner, number = _split(data, offsets)
            spot = top.astype(np.int64)[owner] ^ (number & ((1 << FILTER_BITS) - 1))
            keep = np.flatnonzero((packed[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1)
            stop = np.append(start[1:], len(data))
            take = pa.array(owner[keep])
            lines = [_normal(data[a:b]) for a, b in zip(start[keep].tolist(), stop[keep].tolist(), strict=True)]
            place = [batch.column(0).take(take), batch.column(1).take(take), pa.array(number[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*place, pa.array(lines, pa.binary())], ["doc", "print", "line", "normal"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            for a, b in tk.document_blocks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w = tk.words(part, at, tk.NON_WORD)
                some = np.flatnonzero(np.diff(w.first))
                _, sketch = line_bands(w, some)
                forms = [sketch[k].tobytes() + part[at[d] : at[d + 1]].tobytes() for k, d in enumerate(some.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(forms, pa.binary())], ["key", "form"])

    found = _keyed(docs).mapInArrow(frugal(run), "doc long, print long, line int, normal binary")
    keys = wanted.select("key", "first.doc", "first.print", "first.line")
    # A repeated row has each of its lines again.
    found = found.join(keys, ["doc", "print", "line"]).select("key", "normal").dropDuplicates(["key"])
    return found.mapInArrow(frugal(sketched), "key long, form binary")


def _cut(docs: DataFrame, similarity: float) -> DataFrame:
    """doc, print, removed: the numbers of the lines that go, of each document that has any."""
    lines, links = read_lines(docs)
    near = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # Only lines that occur again or are linked are looked at; of the others there is one occurrence, which stays.
    again = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = near.withColumn("near", F.lit(True)).join(again, "key", "full").select("key", F.coalesce("near", F.lit(False)).alias("near"))
    # A key once, so what a task hashes is its share of the keys.
    lines = stored(lines.join(wanted.hint("shuffle_hash"), "key"))
    distinct = stored(lines.groupBy("key", "near").agg(F.min(F.struct("doc", "print", "line")).alias("first")))
    forms = stored(line_texts(docs, distinct.where("near")))
    roots = connected(links, forms, EditSimilar(similarity)).withColumnRenamed("node", "key")
    groups = stored(distinct.join(merged(roots), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")))
    # Written, so that the join is one of two shuffled sides, of which a hot root's can be split.
    kept = stored(groups.groupBy("root").agg(F.min("first").alias("kept")))
    stay = groups.join(merged(kept), "root").select("key", "kept")
    cut = lines.join(merged(stay), "key").where("struct(doc, print, line) <> kept")
    return cut.groupBy("doc", "print").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of docs as (row, n_lines, removed, kept): row holds all columns, removed the numbers of the lines cut, kept the text.

    Lines are the parts between line feeds.  A line's normal form is its words (lower-cased, without
    punctuation).  Lines of equal form are one; different ones are linked if they share a band and their forms
    have an edit similarity of `similarity` at least, whatever else the band holds.  Of all occurrences of a
    connected group one is kept, that of the smallest (doc_id, line).  Lines without a word are never cut.  A null text stays null, with no lines; repeated rows are one document and stay
    repeated; a null doc_id comes after all others.
    """
    with scratch(docs.sparkSession):
        cut = stored(_cut(docs, similarity), keep=True)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("print"))
    # One row a document at most, so what a task hashes is its share of the cut documents.
    rows = rows.join(cut.hint("shuffle_hash"), ["doc", "print"], "left")
    parts = F.split("row.text", "\n")
    n_lines = F.octet_length("row.text") - F.octet_length(F.replace("row.text", F.lit("\n"))) + 1
    rows = rows.select("row", n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), parts.alias("parts"))
    # By a set difference: looking each line up in `removed` would take the square of a long text's lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "removed")
    left = F.transform(stay, lambda i: F.element_at("parts", i + 1))
    text = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return rows.select("row", F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "removed", F.explode(F.array(text)).alias("kept"))  # so that it is worked out once


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
