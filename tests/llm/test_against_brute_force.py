"""Operators that SQL can't express, against plain versions of themselves; models on held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, interpolated_lm, langid, line_dedup, maxscore, minhash, mixing, quality, simhash, suffix_dedup
from lodestar.llm import textkernel as tk
from lodestar.llm.queries import QUERIES
from lodestar.llm.shared import components

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def lower(text: str) -> bytes:
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@given(st.lists(st.text(alphabet="abÉ \n.", max_size=20), min_size=1, max_size=6), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_words(parts, bits):
    import pyarrow as pa

    piece, tk.PIECE = tk.PIECE, 1 << bits
    try:
        data, offsets = tk.utf8(pa.array(parts))
        w = tk.words(data, offsets, tk.WHITESPACE)
    finally:
        tk.PIECE = piece
    found = [[bytes(tk.LOWER[data[a:b]]) for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert found == [lower(p).split() for p in parts]


@given(st.binary(min_size=0, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 12), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factor(data, cap, seed):
    at = np.arange(max(0, len(data) - cap + 1))
    owner = np.random.default_rng(seed).integers(0, 4, len(at))
    same = lambda i, j: next((k for k in range(cap) if data[i + k] != data[j + k]), cap)
    expected = [max([same(i, j) for j in at if owner[j] < owner[i]], default=0) for i in at]
    assert suffix_dedup.longest_previous_factor(np.frombuffer(data, np.uint8), at, owner, cap).tolist() == expected


@given(st.text(alphabet="abc", max_size=99), st.text(alphabet="abc", max_size=99))
@settings(max_examples=400, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    assert line_dedup.edit_distance(a, b) == row[-1]
    assert all((line_dedup.edit_distance(a, b, k) == row[-1]) or line_dedup.edit_distance(a, b, k) > k < row[-1] for k in (0, 1, 5, 20))
    longer = max(len(a), len(b))
    for least in (0.5, 0.8):
        assert line_dedup.similar(a, b, least) == (not longer or 1 - row[-1] / longer >= least - 1e-9)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert set(out) == linked
    assert all((out[x] == out[y]) == (root(x) == root(y)) for x in linked for y in list(linked)[:40])


def test_simhash(spark, texts):
    prints = {}
    for d, text in texts.items():
        words = lower(text).split()
        n = min(3, len(words))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for d in prints:
            least = min(component[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 2)
            if least < component[d]:
                component[d], changed = least, True
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SMALL).collect()}
    assert out == {d: (f"{p:016x}", component[d]) for d, p in prints.items()}


@pytest.mark.parametrize(("distance", "crowd"), [(0, 64), (2, 64), (2, 3), (4, 64), (4, 3)])
def test_simhash_links_planted(spark, monkeypatch, distance, crowd):
    """All pairs within the distance, among crowds of fingerprints around a few centres."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            values.add(centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(4))}))
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    links = simhash.linked(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long"), distance).cache()
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance for a, b in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    close = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= distance]
    assert (close or not distance) and all(roots[signed(a)] == roots[signed(b)] for a, b in close)


def test_lines(spark, texts):
    """All pairs of lines that share a band, agree in 0.3 of their min-hashes and have an edit similarity of 0.8."""
    import pyarrow as pa

    where = defaultdict(list)
    for d, text in sorted(texts.items()):
        for i, line in enumerate(text.split("\n")):
            form = b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line))).decode()
            if form:
                where[form].append((d, i))
    forms = list(where)
    w = tk.words(*tk.utf8(pa.array(forms)), tk.NON_WORD)
    bands, sketch = line_dedup.line_bands(w, np.arange(len(forms)))
    parent = list(range(len(forms)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(forms)):
        for y in np.flatnonzero((bands[x + 1 :] == bands[x]).any(axis=1)) + x + 1:
            longer = max(len(forms[x]), len(forms[y]))
            if (sketch[x] == sketch[y]).sum() >= 0.3 * 48 and 1 - line_dedup.edit_distance(forms[x], forms[y]) / longer >= 0.8:
                parent[root(int(y))] = root(x)
    groups = defaultdict(list)
    for k, form in enumerate(forms):
        groups[root(k)] += where[form]
    cut = {place for group in groups.values() for place in group if place != min(group)}
    out = {r.doc_id: (r.n_removed, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, SMALL).collect()}
    for d, text in texts.items():
        kept = "\n".join(line for i, line in enumerate(text.split("\n")) if (d, i) not in cut)
        assert out[d] == (sum(p[0] == d for p in cut), hashlib.sha256(kept.encode()).hexdigest())


def test_line_links_of_small_slices(spark, texts, monkeypatch):
    """Whatever the sizes, the links tie together what shares a band's value, and hardly anything else."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    _, _, key, w = line_dedup._lines(*tk.utf8(pa.array(list(texts.values()))))
    key, at = np.unique(key, return_index=True)
    values, _ = line_dedup.line_bands(w, at[key > 0])
    key = key[key > 0].view(np.int64)
    for flush, size in ((1 << 20, 1 << 22), (300, 200)):
        monkeypatch.setattr(line_dedup, "FLUSH", flush)
        monkeypatch.setattr(line_dedup, "SLICE_BYTES", size)
        links = line_dedup.read_lines(docs)[1].collect()
        assert all(r.a != r.b for r in links)
        top = {r.node: r.root for r in components(spark.createDataFrame(links).select("a", "b")).collect()}
        tied = set()
        for band in values.T:
            for v in np.unique(band)[np.unique(band, return_counts=True)[1] > 1]:
                held = key[band == v].tolist()
                tied |= set(held)
                assert len({top[k] for k in held}) == 1
        assert len(tied) > 20 and len(set(top) - tied) <= 2


def test_like_lines_in_tiles(spark, monkeypatch):
    """A block of more lines than a tile holds, tied to a line that none is like: what is alike is connected all the same."""
    monkeypatch.setattr(minhash, "TILE", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base).replace("w50", f"v{k}")) for k in range(1, 41)]
    own = {k: " ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=80)) for k in range(50, 65)}
    rows += [(k, own[k // 2] + " y" * (k % 2)) for k in range(100, 130)] + [(0, "a line of its own")]
    forms = spark.createDataFrame([(k, bytes(48) + t.encode()) for k, t in rows], "key long, form binary")
    links = spark.createDataFrame([(16, 0, k) for k, _ in rows if k], "block long, a long, b long")
    groups = defaultdict(set)
    for r in minhash.connected(links, forms, line_dedup.EditSimilar(0.8)).collect():
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(1, 41))] + [[k, k + 1] for k in range(100, 130, 2)])


@given(st.lists(st.text(alphabet="abé ", max_size=12), min_size=2, max_size=8), st.sampled_from([0.5, 0.8]))
@settings(max_examples=80, deadline=None)
def test_bound_of_edit_similarity(forms, least):
    same = line_dedup.EditSimilar(least)
    forms = [bytes(48) + f.encode() for f in forms]
    near = same.near(forms, 0)
    for x in range(len(forms) - 1):
        for y, may in enumerate(near(x), x + 1):
            assert may or not same(forms[x], forms[y])


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5)), max_size=40, unique_by=lambda p: p[0]), st.integers(0, 8), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_stretches(found, reach, need):
    found.sort()
    at, code = np.array([p[0] for p in found], np.int64), np.array([p[1] for p in found], np.int64)
    lead = 5 - need + 1  # of five windows, need of them include one of these
    inside = [[p for p in found if a <= p[0] <= a + reach] for a, _ in found]
    expected = {p[0] for s in inside if len({c for _, c in s}) >= need for p in s}
    assert decontaminate.stretches(at, code, reach, need, lead).tolist() == sorted(expected)


def test_containment(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(30)}" for _ in range(n)]
    items = {k: words(n) for k, n in enumerate((3, 8, 9, 20, 30, 40))}
    docs = {k: words(rng.randrange(60)) for k in range(30)}
    for k in range(30, 60):
        item = items[rng.randrange(6)]
        a = rng.randrange(len(item))
        docs[k] = words(rng.randrange(20)) + item[a : a + rng.randrange(1, 30)] + words(rng.randrange(5)) + item[:a] + words(3)
    docs[60] = items[4] * 2000  # an item over and over
    share, size = 0.5, 8
    expected = {}
    for d, text in docs.items():
        for i, item in items.items() if d < 60 else ():
            width = min(size, len(item))
            parts = {tuple(item[k : k + width]) for k in range(len(item) - width + 1)}
            held = [k for k in range(len(text) - width + 1) if tuple(text[k : k + width]) in parts]
            for s in held:
                stretch = [k for k in held if s <= k <= s + len(item) - width]
                if len({tuple(text[k : k + width]) for k in stretch}) >= max(1, math.ceil(share * len(parts))):
                    expected.setdefault(d, {}).setdefault(str(i), set()).update((k, width) for k in stretch)
    assert len(expected) > 5
    as_table = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in rows.items()], f"{key} long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(as_table(docs, "doc_id"), as_table(items, "item_id"), size, share).collect()}
    for d in range(60):
        assert found[d]["items"] == sorted(expected.get(d, {}))
        assert {tuple(s) for s in found[d].spans} == set().union(*expected.get(d, {}).values())
    assert "4" in found[60]["items"] and found[60].n_hit == len(docs[60])


def mixture(events, n_buckets=24, rounds=60):
    """Weights of the pair, word and uniform estimates for each bucket, by expectation-maximisation over (bucket, ratios) events."""
    weights = [[0.0, 0.8, 0.2]] + [[0.4, 0.4, 0.2] for _ in range(n_buckets - 1)]
    for _ in range(rounds):
        found = [[0.0] * 3 for _ in weights]
        for (b, ratios), n in events.items():
            parts = [w * r for w, r in zip(weights[b], ratios, strict=True)]
            for k in range(3):
                found[b][k] += n * parts[k] / sum(parts)
        for b in range(1, n_buckets):
            prior = weights[b - 1] if b > 1 else weights[b]
            weights[b] = [(f + 2 * p) / (sum(found[b]) + 2) for f, p in zip(found[b], prior, strict=True)]
        weights[0] = [(f + p) / (sum(found[0]) + 2) for f, p in zip(found[0], (0, 1, 1), strict=True)]
    least = [[max(w, m) for w, m in zip(row, (0, 1e-7, 1e-7), strict=True)] for row in weights]
    return [[w / sum(row) for w in row] for row in least]


def test_language_model(spark, texts):
    tokens = {d: [*lower(t).split(), None] for d, t in texts.items()}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    pairs_of = {d: list(zip([None, *words], words, strict=False)) for d, words in tokens.items()}
    pairs = Counter(p for d in train for p in pairs_of[d])
    bucket = lambda n: min(23, n.bit_length())
    binned = lambda p: 2.0 ** (round(math.log2(p * (distinct + 1)) * 8) / 8) if p > 0 else 0.0
    events = Counter()
    for d in tokens:
        if zlib.crc32(str(d).encode()) % 7 == 3:
            for h, w in pairs_of[d]:
                events[bucket(counts[h] - 1), (binned((pairs[h, w] - 1) / max(1, counts[h] - 1)), binned((counts[w] - 1) / (total - 1)), 1.0)] += 1
    weights = mixture(events)
    out = QUERIES["op5_interpolated_lm"](spark, SMALL).collect()
    assert len(out) == len(tokens)
    for r in out:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)
        score = 0.0
        for h, w in pairs_of[r.doc_id]:
            pair, word, uniform = weights[bucket(counts[h])]
            score += math.log10(pair * pairs[h, w] / max(1, counts[h]) + word * counts[w] / total + uniform / (distinct + 1))
        assert math.isclose(r.score, score, rel_tol=1e-6)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_in_many_chunks(spark, monkeypatch):
    """Small chunks, all rows under one id or none: the same scores as in one chunk."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.lit(3).cast("long").alias("doc_id"), "text")
    for rows in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        whole = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in interpolated_lm.scored(rows).collect())
        with monkeypatch.context() as m:
            m.setattr(interpolated_lm, "CHUNK_BYTES", 5000)
            parts = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in interpolated_lm.scored(rows).collect())
        assert len(whole) == len(parts) and np.allclose(whole, parts, rtol=1e-9)


def test_mixture_weights():
    events = np.array([[3, 512 + 80, 512 + 16], [3, -1, 512 + 16]])
    weights = interpolated_lm.learn(events, np.array([900, 100]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[3, 0] > 0.8 and weights[0, 0] == 0


def test_packing():
    for values in ([], [5], [1, 2, 1 << 20], [0, 1 << 30, 1 << 62]):
        array = np.array(values, np.uint64)
        if len(array):
            assert (interpolated_lm.unpack(interpolated_lm.pack(array)) == array).all()


def test_max_score_prunes_nothing_it_needs():
    rng = np.random.default_rng(4)
    scale = np.array([1, 1, 1, 2, 2, 3, 5, 8, 13, 21, 34, 55])
    rows, queries = rng.integers(-9, 9, (3000, 12)) * scale * 1.0, rng.integers(-9, 9, (9, 12)) * 1.0
    ids, query_ids = np.arange(3000), np.arange(9)
    heaps = maxscore.Heaps(9, 5)
    read = sum(maxscore.max_score(queries, query_ids, rows[a : a + 64], ids[a : a + 64], heaps, 0) for a in range(0, 3000, 64))
    for q in range(9):
        score = rows @ queries[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:5]
        assert heaps.ids[q].tolist() == best.tolist()
    assert read < 0.6 * 9 * rows.size  # most of the smaller terms' postings are left alone


def test_search_of_large_components(spark):
    """Whole numbers beyond what doubles add up exactly take part with their exact scores."""
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.randrange(0, 8) for _ in range(4)]) for k in range(60)] + [(60, [1e17, 1.0, 0.0, 0.0])]
    vectors = maxscore.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    found = defaultdict(list)
    for r in maxscore.top_k(vectors, vectors.where("vec_id % 10 = 0"), 3).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert len(found) == 7
    for q, best in found.items():
        score = {k: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(1 << 63)), (1 << 63) - 1) for k, v in whole.items() if k != q}
        assert best == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3]


def test_quality_of_four_grades(spark):
    """Grades by how many words are capitals: expected grades follow them, and shares are those of all rows, not of the sample."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(600):
        grade = (0, 1, 2, 3, 3, 3)[k % 6]
        rows.append((k, " ".join(w.upper() if rng.random() < 0.05 + 0.25 * grade + rng.uniform(-0.08, 0.08) else w for w in (word() for _ in range(80))), grade))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for bound, apart in ((2000, 0.06), (60, 0.15)):
        model = quality.train(table, table.select("doc_id", "quality"), per_grade=bound)
        assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
        out = quality.graded(table, model, 3).join(table.select("doc_id", "quality"), "doc_id").collect()
        means = [np.mean([r.expected_grade for r in out if r.quality == g]) for g in range(4)]
        assert all(abs(m - g) < 0.35 for g, m in enumerate(means))
        assert abs(np.mean([r.tail_probability for r in out]) - 0.5) < apart


def test_language_sets_of_many_languages(spark):
    """A text in equal parts of five made languages has all five; one in one of 300 has that one."""
    rng = random.Random(9)
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0x3B1, 0x3C9), *range(0x430, 0x450))]
    own = {f"l{k:03d}": [["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))][0] for _ in range(12)] for k in range(300)}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    languages, model = langid.train(spark.createDataFrame([(k, text(k, 300)) for k in own], "lang string, text string"))
    assert len(languages) == 300
    mixed = " ".join(text(k, 120) for k in list(own)[:5])
    rows = spark.createDataFrame([(1, mixed), (2, text("l123", 60))], "doc_id long, text string")
    found = {r.row.doc_id: r for r in langid.identified(rows, languages, model).collect()}
    assert set(found[1].languages) == set(list(own)[:5]) and found[1].covered > 0.9 > found[1].score
    assert found[2].languages == ["l123"]


def test_repeated_and_unnamed_items(spark):
    """Items of one id or none, of one length, are told apart: a whole copy of either is found at any containment."""
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b), (4, "c " * 30)], "doc_id long, text string")
    for ids in ((1, 2), (1, 1), (None, None)):
        items = spark.createDataFrame(list(zip(ids, (a, b), strict=True)), "item_id long, text string")
        for share in (None, 0.25, 0.75, 1.0):
            found = {r.doc_id: r for r in decontaminate.contaminated(docs, items, 8, share).collect()}
            assert [found[d].held for d in (1, 2, 3, 4)] == [True, True, True, False]
            names = [[str(x) for x in sorted({i for i in p if i})] for p in (ids[:1], ids[1:], ids)]
            assert [found[d]["items"] for d in (1, 2, 3)] == names and found[3].n_hit == 40


def test_mixing_meets_its_limits(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").when(F.col("id") < 3900, "mid").otherwise("small").alias("source"), F.lit("a b c d e").alias("text"))
    out = mixing.mixed(docs, repeats=3.0, entropy=None, block_docs=50)
    used = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(used["small"] / 500 - 3.0) < 0.02 and abs(sum(used.values()) - 20_000) <= 15
    times = out.groupBy("doc_id").count().groupBy().agg(F.max("count")).first()[0]
    assert times == 3
    ordered = out.where("source = 'mid'").orderBy("position").collect()
    assert [r.position for r in ordered] == [5 * k for k in range(len(ordered))]
    assert [r.doc_id for r in ordered[:900]] != sorted(r.doc_id for r in ordered[:900])


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    lang = QUERIES["op8_langid"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() / lang.count() > 0.97
    for name, column, label, least in (("op4_quality", "selected", "quality", 0.93), ("op6_toxicity", "predicted", "toxic", 0.9)):
        held = QUERIES[name](spark, MIDDLE).join(labels, "doc_id").where("held_out")
        assert held.where(F.col(column).cast("int") == F.col(label)).count() / held.count() > least, name
