"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import textkernel as tk
from lodestar.llm.shared import frugal, in_rest, labelled_sample, load

#: Bound of the labelled sample the machine is fitted on, for each label.
SAMPLE = 1500
LANDMARKS = 64
GAP_DECAY = 0.6
#: Subsequences of three letters within SPAN further bytes; each byte left out costs a factor of GAP_DECAY.
SPAN = 5
STEPS = [(i, j) for j in range(2, SPAN + 1) for i in range(1, j)]
#: Kernel values under this are taken as 0, which lets nearly all words be passed over.
FLOOR = 0.4

#: Letters 1 to 26, bytes beyond ASCII five further symbols, all else 0: a gap.
_SYMBOL = np.zeros(256, np.uint16)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 5
_CODES = 1 << 15


def _codes(symbols: np.ndarray, i: int, j: int) -> np.ndarray:
    """Codes of the subsequences (p, p + i, p + j) for each p; symbols have SPAN zeros at their end."""
    n = len(symbols) - SPAN
    return (symbols[:n] << np.uint16(10)) | (symbols[i : n + i] << np.uint16(5)) | symbols[j : n + j]


def _whole() -> np.ndarray:
    """False for the codes that hold a gap."""
    code = np.arange(_CODES)
    return (code >> 10 > 0) & ((code >> 5) & 31 > 0) & (code & 31 > 0)


def embed(text: bytes) -> np.ndarray:
    """The explicit feature map: for each three-symbol subsequence the sum of its occurrences' weights."""
    symbols = np.append(_SYMBOL[np.frombuffer(text, np.uint8)], np.zeros(SPAN, np.uint16))
    out = np.zeros(_CODES, np.float32)
    for i, j in STEPS:
        np.add.at(out, _codes(symbols, i, j), np.float32(GAP_DECAY ** (j - 2)))
    return out * _whole()


@dataclass
class Machine:
    """landmarks [codes, m], each scaled so that it has kernel 1 with itself; score = logistic(slope * margin + offset)."""

    landmarks: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _values(data: np.ndarray, offsets: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """For each document and landmark the largest kernel value of any of its words, 0 if under FLOOR.

    A word's value sums over the subsequences that start in it (they may run on into the next word).  A first pass takes, for each subsequence, the most that any landmark gives
    for it; only words that reach FLOOR so are compared with each landmark.
    """
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, landmarks.shape[1]), np.float32)
    if not landmarks.shape[1]:
        return out
    highest = landmarks.max(axis=1)
    w = tk.words(data, offsets, tk.WHITESPACE, lower=False, hashed=False)
    # One buffer with SPAN gaps after each document, so that no subsequence leaves its document.
    a = 0
    while a < len(w.start):
        b = max(a + 1, int(np.searchsorted(w.start, w.start[a] + tk.PIECE)))
        low, high = int(w.start[a]), int(w.end[b - 1])
        shift = SPAN * (w.doc[a:b] - w.doc[a])
        last = int(np.searchsorted(offsets, high + SPAN, side="right"))
        reach = min(len(data), high + SPAN)
        inner = np.arange(w.doc[a], min(last, n_docs))
        symbols = np.zeros(reach - low + SPAN * (len(inner) + 2), np.uint16)
        for d in inner:
            x, y = max(low, int(offsets[d])), min(reach, int(offsets[d + 1]))
            if y > x:
                symbols[x - low + SPAN * (d - inner[0]) : y - low + SPAN * (d - inner[0])] = _SYMBOL[data[x:y]]
        most = np.zeros(len(symbols) - SPAN, np.float32)
        for i, j in STEPS:
            most += (highest * np.float32(GAP_DECAY ** (j - 2)))[_codes(symbols, i, j)]
        start, end = w.start[a:b] - low + shift, w.end[a:b] - low + shift
        total = np.append(0, np.cumsum(most, dtype=np.float64))
        near = np.flatnonzero(total[end] - total[start] >= FLOOR - 1e-4)
        for c in range(0, len(near), 2048):
            part = near[c : c + 2048]
            sizes = end[part] - start[part]
            first = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(start[part] - first, sizes)
            value = np.zeros((len(at), landmarks.shape[1]), np.float32)
            for i, j in STEPS:
                code = (symbols[at] << np.uint16(10)) | (symbols[at + i] << np.uint16(5)) | symbols[at + j]
                value += landmarks[code] * np.float32(GAP_DECAY ** (j - 2))
            value = np.add.reduceat(value, first, axis=0)
            value[value < FLOOR] = 0
            np.maximum.at(out, w.doc[a:b][part], value)
        a = b
    return np.minimum(out, 1.5)


def _alternate(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of every second byte of each word, from the first and from the second: what one character between all letters hides."""
    w = tk.words(data, offsets, tk.WHITESPACE, lower=False, hashed=False)
    long = np.flatnonzero(w.end - w.start >= 5)
    sizes = w.end[long] - w.start[long]
    half = (sizes + 1) // 2
    first = np.append(0, np.cumsum(sizes + 2))
    owner = np.repeat(np.arange(len(long)), sizes)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    second = k >= half[owner]
    out = np.full(int(first[-1]), 32, np.uint8)
    out[first[:-1][owner] + k + second] = data[w.start[long][owner] + np.where(second, 2 * (k - half[owner]) + 1, 2 * k)]
    return out, first[np.searchsorted(long, w.first)]


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of words with other characters between their letters, without these, and of runs of one-letter words, each as one."""
    w = tk.words(data, offsets, tk.WHITESPACE, lower=False, hashed=False)
    letter = _SYMBOL[data] > 0
    before = np.append(0, np.cumsum(letter))
    some = np.flatnonzero(before[w.end] > before[w.start])
    low, high, doc = before[w.start[some]], before[w.end[some]], w.doc[some]
    n = high - low
    places = np.append(np.flatnonzero(letter), 0)
    span = places[high - 1] - places[low] + 1
    heads = np.append(0, np.cumsum(letter & ((data < 0x80) | (data >= 0xC0))))
    single = heads[w.end[some]] - heads[w.start[some]] == 1
    on = np.ones(len(n), bool)  # a run of one-letter words, or a word of its own, starts here
    on[1:] = ~(single[1:] & single[:-1] & (doc[1:] == doc[:-1]))
    run = np.cumsum(on) - 1
    kept = np.flatnonzero(np.where(single, np.bincount(run)[run] >= 3, (n >= 3) & (span > n)))
    group = np.cumsum(on[kept]) - 1
    first = np.append(0, np.cumsum(n[kept]))
    at = np.arange(int(first[-1])) + np.repeat(low[kept] - first[:-1], n[kept])
    groups = np.append(group, group[-1] + 1 if len(group) else 0)
    out = np.full(int(first[-1] + groups[-1]), 32, np.uint8)
    out[np.arange(len(at)) + np.repeat(group, n[kept])] = data[places[at]]
    edge = np.searchsorted(some[kept], w.first)
    return out, first[edge] + groups[edge]


def features(data: np.ndarray, offsets: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """For each document and landmark the largest kernel value of any of its words, as written or with its letters drawn together.

    Gaps between all letters leave too little of a word's kernel value to tell it from a clean one, so words
    are compared without them as well: every second byte, and letters only, one-letter words in a row as one.
    """
    out = _values(data, offsets, landmarks)
    for a, b in tk.document_blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        for view in (_alternate, _joined):
            np.maximum(out[a:b], _values(*view(part, at), landmarks), out=out[a:b])
    return out


def choose_landmarks(held: list[list[int]], grade: np.ndarray, names: list[str], most: int) -> list[str]:
    """Greedy cover: strings that many toxic and hardly any other documents hold, each document counting less once covered."""
    members: dict[int, list[int]] = {}
    against = np.zeros(len(names))
    for d, items in enumerate(held):
        for k in items:
            if grade[d] > 0:
                members.setdefault(k, []).append(d)
            else:
                against[k] += 1
    weight = np.ones(len(held))
    chosen: list[str] = []
    pool = {k: np.array(v) for k, v in members.items() if len(v) >= 2 and against[k] <= 0.05 * len(v)}
    while pool and len(chosen) < most:
        gain = {k: weight[v].sum() - 5 * against[k] for k, v in pool.items()}
        best = max(gain, key=lambda k: (round(gain[k], 6), len(names[k]), names[k]))
        if gain[best] < 0.5:
            break
        weight[pool.pop(best)] /= 3
        chosen.append(names[best])
        pool = {k: v for k, v in pool.items() if names[k] not in names[best] and names[best] not in names[k]}
    return chosen


def fit(features_: np.ndarray, grade: np.ndarray, landmarks: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float, float, float]:
    """(weights on kernel values, bias, slope, offset): Nyström map, squared hinge loss by Newton steps, Platt scaling."""
    m = features_.shape[1]
    sign = np.where(grade > 0, 1.0, -1.0)
    if not m or len(set(sign)) < 2:
        share = float((sign > 0).mean()) if len(sign) else 0.0
        return np.zeros(m), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    unit = landmarks / np.linalg.norm(landmarks, axis=0)
    values, vectors = np.linalg.eigh((unit.T @ unit).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = np.column_stack((features_ @ root, np.ones(len(sign))))
    w = np.zeros(m + 1)
    ridge = np.append(np.ones(m), 1e-6)
    for _ in range(50):
        slack = 1 - sign * (x @ w)
        on = slack > 0
        gradient = ridge * w - cost * x[on].T @ (sign[on] * slack[on])
        step = np.linalg.solve(np.diag(ridge) + cost * x[on].T @ x[on], gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    margin = x @ w
    n_plus, n_minus = (sign > 0).sum(), (sign < 0).sum()
    target = np.where(sign > 0, (n_plus + 1) / (n_plus + 2), 1 / (n_minus + 2))
    z = np.column_stack((margin, np.ones(len(margin))))
    link = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ link, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        link -= np.linalg.solve(hessian, z.T @ (p - target) + 1e-3 * link)
    return root @ w[:m], float(w[m]), float(link[0]), float(link[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_grade: int = SAMPLE) -> Machine:
    """Fits on a bounded sample: per_grade labelled texts of each label at most, null and empty ones included."""
    sample = labelled_sample(docs, labels, label, per_grade)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({"".join(c for c in t if c.isalpha()) for t in (text or "").lower().split()})
                yield pa.RecordBatch.from_arrays([pa.array([grade > 0] * len(found), pa.bool_()), pa.array(found, pa.string())], ["toxic", "token"])

    seen = sample.mapInArrow(tokens, "toxic boolean, token string")
    seen = seen.groupBy("token").agg(F.sum(F.col("toxic").cast("long")).alias("on"), F.sum((~F.col("toxic")).cast("long")).alias("off"))
    telling = seen.where("on >= 2 and on > 4 * off and length(token) between 3 and 40").orderBy(F.desc(F.expr("on - 4 * off")), "token").limit(1000).toArrow()
    pieces: dict[str, int] = {}
    for token, on in zip(telling.column("token").to_pylist(), telling.column("on").to_pylist(), strict=True):
        for size in range(3, 11):
            for k in range(len(token) - size + 1):
                pieces[token[k : k + size]] = pieces.get(token[k : k + size], 0) + on
    names = sorted(sorted(pieces, key=lambda p: (-pieces[p], p))[:3000])

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[k for k, name in enumerate(names) if name in text] for text in ((t or "").lower() for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["grade", "held"])

    held = sample.mapInArrow(holds, "grade double, held array<int>").toArrow()
    chosen = choose_landmarks(held.column("held").to_pylist(), held.column("grade").to_numpy(), names, LANDMARKS)
    vectors = [embed(name.encode()) for name in chosen]
    landmarks = np.array([v / max(1e-9, float(v @ v)) for v in vectors if v.any()], np.float32).reshape(-1, _CODES).T.copy()
    sent = docs.sparkSession.sparkContext.broadcast(landmarks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(*tk.utf8(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["grade", "values"])

    rows = sample.mapInArrow(compare, "grade double, values binary").toArrow().sort_by([("grade", "ascending"), ("values", "ascending")])
    values = np.array([np.frombuffer(x, np.float32) for x in rows.column("values").to_pylist()], np.float64).reshape(rows.num_rows, landmarks.shape[1])
    grade = rows.column("grade").to_numpy()
    weights, bias, slope, offset = fit(values, grade, landmarks)
    # The sample has the labels in equal numbers; scores are to be probabilities among all labelled rows.
    known = labels.where(F.col(label).isNotNull()).agg(F.sum((F.col(label) > 0).cast("long")).alias("on"), F.count("*").alias("n")).first()
    odds = lambda on, n: np.log((on + 1) / (n - on + 1))
    offset += odds(known["on"] or 0, known["n"]) - odds(int((grade > 0).sum()), len(grade))
    return Machine(landmarks, weights, bias, slope, float(offset))


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) of every whole text; a null text is scored as an empty one.

    One row per row of docs; extra columns are ignored.  Without both labels to learn from, all get the
    share of toxic rows seen.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            score = m.score(features(*tk.utf8(batch.column(1)), m.landmarks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    machine = train(docs.select("doc_id", "text"), labels.where(~in_rest("doc_id", 4)))
    out = toxicity(docs, machine)
    return out.select("doc_id", in_rest("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
