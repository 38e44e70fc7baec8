"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.shared import frugal, in_rest, load, shuffle_partitions

TABLE_BITS = 16
SLICES = 16
_NO_LETTER = tk.separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LETTER = regex.compile(r"\p{L}")
_WORDS_AT_ONCE = 100_000


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table index, first gram of each word) of the byte trigrams of the words [start, end), blanks around each word included."""
    counts = end - start
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    to = np.arange(n) + np.repeat(start - first, counts)  # the middle byte
    middle = tk.LOWER[data[to]].astype(np.uint32)
    before = tk.LOWER[data[to - 1]].astype(np.uint32)
    before[first] = 32
    after = tk.LOWER[data[np.minimum(to + 1, len(data) - 1)]].astype(np.uint32)
    after[first + counts - 1] = 32
    value = (before << np.uint32(16)) | (middle << np.uint32(8)) | after
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS), first


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [2^TABLE_BITS, languages]) from the rows (lang, text) with a language.

    Trigrams of all texts are counted, in tables of fixed size (half a MB) for each language; the tables are
    summed up in slices, streaming, so no task holds more than a few of them however many tasks counted.  The
    model has a quarter of a MB for each language.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            langs = batch.column(0).to_pylist()
            names, code = np.unique(langs, return_inverse=True)
            w = tk.words(data, offsets, _NO_LETTER, hashed=False)
            for a in range(0, len(w.start), _WORDS_AT_ONCE):
                part = slice(a, a + _WORDS_AT_ONCE)
                index, _ = grams(data, w.start[part], w.end[part])
                owner = np.repeat(code[w.doc[part]], w.end[part] - w.start[part])
                for c, name in enumerate(names):
                    table = tables.setdefault(str(name), np.zeros(1 << TABLE_BITS, np.int64))
                    table += np.bincount(index[owner == c], minlength=1 << TABLE_BITS)
        for name, table in tables.items():
            parts = np.split(table, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], ["lang", "slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["lang"], r["slice"])
                tables[key] = tables.get(key, 0) + np.frombuffer(r["counts"], np.int64)
        for (lang, part), table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([table.tobytes()])], ["lang", "slice", "counts"])

    kind = "lang string, slice int, counts binary"
    counted = docs.where("lang is not null").select("lang", "text").mapInArrow(frugal(count), kind)
    summed = counted.repartition(shuffle_partitions(spark), "lang", "slice").mapInArrow(add, kind).toArrow()
    languages = sorted(set(summed.column("lang").to_pylist()))
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    wide = (1 << TABLE_BITS) // SLICES
    for r in summed.to_pylist():
        counts[r["slice"] * wide : (r["slice"] + 1) * wide, languages.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    counts += 0.5
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def mixtures(model: np.ndarray, data: np.ndarray, w: tk.Words, rounds: int = 6, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, chosen) for each document and language.

    Words are drawn from one language each; a word's likelihood is that of its trigrams.  Expectation-
    maximisation gives the proportions.  Then languages are added, largest first, as long as the log-likelihood
    rises by more than penalty * log(words) for each; chosen marks the set.
    """
    n_langs = model.shape[1]
    like = np.empty((len(w.start), n_langs), np.float32)
    for a in range(0, len(w.start), _WORDS_AT_ONCE):
        part = slice(a, a + _WORDS_AT_ONCE)
        index, first = grams(data, w.start[part], w.end[part])
        like[part] = np.add.reduceat(model[index], first, axis=0)
    peak = like.max(axis=1, keepdims=True)
    like -= peak
    np.exp(np.maximum(like, -60, out=like), out=like)
    sizes = np.diff(w.first)
    some = np.flatnonzero(sizes)
    share = np.full((w.n_docs, n_langs), 1 / n_langs, np.float32)
    chosen = np.zeros((w.n_docs, n_langs), bool)
    if not len(some):
        return share, chosen
    starts, n = w.first[:-1][some], sizes[some]
    for _ in range(rounds):
        part = like * np.repeat(share[some], n, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share[some] = np.add.reduceat(part, starts, axis=0) / n[:, None]
    order = np.argsort(-share[some], axis=1, kind="stable")
    best = np.full(len(some), -np.inf)
    size = np.ones(len(some), int)
    rising = np.arange(len(some))
    for k in range(1, n_langs + 1):
        if not len(rising):
            break
        own = order[rising, :k]
        inside = np.zeros((len(rising), n_langs), np.float32)
        np.put_along_axis(inside, own, np.take_along_axis(share[some[rising]], own, 1), 1)
        inside /= inside.sum(axis=1, keepdims=True)
        counts = n[rising]
        first = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(starts[rising] - first, counts)
        fit = np.log(np.maximum(np.einsum("ij,ij->i", like[at], np.repeat(inside, counts, axis=0)), 1e-30), dtype=np.float64)
        fit = np.add.reduceat(fit, first) - penalty * (k - 1) * np.log(counts + 1)
        better = fit > best[rising]
        rising, fit = rising[better], fit[better]
        best[rising], size[rising] = fit, k
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n_langs)[None, :].repeat(len(some), 0), 1)
    chosen[some] = rank < size[:, None]
    return share, chosen


def identified(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Every row of docs as (row, lang_pred, score, languages, covered): row holds all columns, languages the chosen set, largest first.

    lang_pred is the language of the largest proportion, score that proportion, covered the set's; `und` and 0 if the text is
    null or has no letter, or if no language was learned.  Repeated rows stay repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast((languages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            pred, score, sets, covered = [], [], [], []
            for a, b in tk.document_blocks(offsets, tk.PIECE):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w = tk.words(part, at, _NO_LETTER, hashed=False)
                if names:
                    share, chosen = mixtures(table, part, w)
                plain = tk.NON_WORD | (np.arange(256) >= 128) | ((np.arange(256) >= 48) & (np.arange(256) < 58))
                ascii_letters = np.add.reduceat(np.append(~plain[tk.LOWER[part]], False).astype(np.int32), at[:-1]) if len(part) else np.zeros(b - a, int)
                for d in range(b - a):
                    text = part[at[d] : at[d + 1]]
                    letter = len(text) and (ascii_letters[d] > 0 or _LETTER.search(text.tobytes().decode(errors="replace")) is not None)
                    if not letter or not names or not chosen[d].any():
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        covered.append(0.0)
                        continue
                    held = np.flatnonzero(chosen[d])
                    held = held[np.argsort(-share[d][held], kind="stable")]
                    pred.append(names[held[0]])
                    score.append(min(1.0, float(share[d][held[0]])))
                    sets.append([names[k] for k in held])
                    covered.append(min(1.0, float(share[d][held].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(covered, pa.float64())], ["row", "lang_pred", "score", "languages", "covered"])

    rows = docs.select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(frugal(run), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, languages array<string>, covered double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), *train(docs.where(~in_rest("doc_id", 4))))
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", in_rest("doc_id", 4).alias("held_out"), "lang_pred", "score")
