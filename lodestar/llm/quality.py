"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.shared import in_rest, labelled_sample, load

TABLE_BITS = 15
SIZE = (2 << TABLE_BITS) + 2
#: Bound of the labelled sample the classifier is fitted on, for each grade.
SAMPLE = 2000

#: A byte's kind: letters small and capital, digits and bytes beyond ASCII are one kind each, others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = 128


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Table index of the n bytes that end at each position (before the start: the bytes there are)."""
    value = np.zeros(len(data), np.uint32)
    for k in range(n):
        value[k:] += data[: len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def _features(text: np.ndarray) -> Iterator[tuple[str, np.ndarray, int]]:
    """(what they count among, feature indices, words) of the pieces of one text: shapes of 4 bytes, 3 lower-cased bytes, repeated words."""
    offsets = np.array([0, len(text)])
    words = tk.words(text, offsets, tk.WHITESPACE)
    again = int((words.hash[1:] == words.hash[:-1]).sum()) + int((words.hash[2:] == words.hash[:-2]).sum())
    yield "words", np.full(again, SIZE - 2), len(words.hash)
    for a in range(0, len(text), tk.PIECE):
        piece = text[max(0, a - 3) : a + tk.PIECE]
        skip = min(a, 3)
        yield "bytes", _grams(_SHAPE[piece], 4)[skip:], 0
        yield "bytes", _grams(tk.LOWER[piece], 3)[skip:] + np.uint32(1 << TABLE_BITS), 0


def vector(text: np.ndarray) -> np.ndarray:
    """Relative frequencies of a text's features: the two kinds of grams each among the bytes, repeated words among the words."""
    counts = np.zeros(SIZE)
    n_words = 0
    for _, index, words in _features(text):
        counts += np.bincount(index, minlength=SIZE)
        n_words += words
    counts[:-2] /= max(1, len(text))
    counts[-2] /= max(1, n_words)
    counts[-1] = 1 / (1 + n_words)
    return counts


@dataclass
class Ordinal:
    """P(grade <= grades[k]) = 1 / (1 + exp(score - thresholds[k])), thresholds ascending."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: np.ndarray) -> float:
        """The weights' sum over a text's vector()."""
        total, n_words = 0.0, 0
        for kind, index, words in _features(text):
            n_words += words
            total += self.weights[index].sum() / max(1, words if kind == "words" else len(text))
        return total + self.weights[-1] / (1 + n_words)

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        return np.concatenate((1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -500, 500))), np.ones((len(score), 1))), axis=1)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return np.diff(self.cumulative(score), prepend=0, axis=1) @ self.grades

    def tail(self, score: np.ndarray, grade: float) -> np.ndarray:
        """P(a grade of at least `grade`)."""
        below = int((self.grades < grade).sum())
        return np.ones(len(score)) if not below else 1 - self.cumulative(score)[:, below - 1]


def fit(rows: list[np.ndarray], index: list[np.ndarray], grade: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam on sparse rows (values, feature indices), each counting as its weight; ordered by gaps that are exponentials."""
    grades = np.unique(grade)
    if len(grades) < 2:
        return Ordinal(grades if len(grades) else np.zeros(1), np.zeros(SIZE), np.zeros(max(0, len(grades) - 1)))
    y = np.searchsorted(grades, grade)
    weight = np.ones(len(rows)) if weight is None else weight * (len(rows) / weight.sum())
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value, feature = np.concatenate(rows), np.concatenate(index)
    used, feature = np.unique(feature, return_inverse=True)
    # Rare features count like common ones.
    scale = 1 / np.sqrt(np.bincount(feature, value**2) / len(rows) + 1e-8)
    value = value * scale[feature] / np.sqrt(len(used))
    parameters = np.zeros(len(used) + len(grades) - 1)
    parameters[len(used)] = np.log(weight[y == 0].sum() / weight[y > 0].sum())
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    n, k = len(rows), len(grades) - 1
    for step in range(1, rounds + 1):
        w, raw = parameters[: len(used)], parameters[len(used) :]
        cuts = np.cumsum(np.append(raw[0], np.exp(raw[1:])))
        score = np.bincount(owner, value * w[feature], n)
        c = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -500, 500))), np.ones((n, 1))), axis=1)
        slope = c * (1 - c)
        hi, lo = slope[np.arange(n), y + 1], slope[np.arange(n), y]
        p = np.maximum(c[np.arange(n), y + 1] - c[np.arange(n), y], 1e-12)
        by_score = weight * (hi - lo) / p / n
        by_cut = np.zeros(k + 2)
        np.add.at(by_cut, y + 1, -weight * hi / p / n)
        np.add.at(by_cut, y, weight * lo / p / n)
        by_cut = by_cut[1:-1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate((np.bincount(feature, value * by_score[owner], len(used)) + decay * w, [tail[0]], tail[1:] * np.exp(raw[1:])))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(SIZE)
    weights[used] = parameters[: len(used)] * scale / np.sqrt(len(used))
    raw = parameters[len(used) :]
    return Ordinal(grades, weights, np.cumsum(np.append(raw[0], np.exp(raw[1:]))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_grade: int = SAMPLE) -> Ordinal:
    """Fits on a bounded sample: per_grade labelled documents of each grade at most.

    A sampled document counts for as many as its grade has for each one sampled, so probabilities are those
    among all labelled rows, whatever the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            index, value = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                x = vector(data[a:b])
                some = np.flatnonzero(x)
                index.append(some.astype(np.int32).tobytes())
                value.append(x[some].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["grade", "index", "value"])

    sample = labelled_sample(docs, labels, label, per_grade)
    rows = sample.mapInArrow(run, "grade double, index binary, value binary").toArrow().sort_by([("grade", "ascending"), ("index", "ascending"), ("value", "ascending")])
    index = [np.frombuffer(x, np.int32) for x in rows.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float32).astype(np.float64) for x in rows.column("value").to_pylist()]
    grade = rows.column("grade").to_numpy()
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("grade")).agg(F.count("*").alias("n")).collect()
    total = {r["grade"]: r["n"] for r in known}
    weight = np.array([total[g] for g in grade.tolist()], np.float64)
    names, code, held = np.unique(grade, return_inverse=True, return_counts=True)
    return fit(value, index, grade, weight / held[code] if len(names) else weight)


def graded(docs: DataFrame, model: Ordinal, at_least: float) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of at least at_least) of every whole text; a null text is empty.

    One row per row of docs, in whatever number an id comes; extra columns are ignored.  Without two grades
    to learn from, every document gets the one there is (0 if none).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            score = np.zeros(len(offsets) - 1)
            for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                score[d] = m.score(data[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.expected(score)), pa.array(m.tail(score, at_least))], ["doc_id", "expected_grade", "tail_probability"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train(docs.select("doc_id", "text"), labels.where(~in_rest("doc_id", 4)))
    out = graded(docs, model, 1.0)
    return out.select("doc_id", in_rest("doc_id", 4).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))
