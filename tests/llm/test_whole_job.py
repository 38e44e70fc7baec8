"""Places where a stage or operator once did less than its whole job."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, line_dedup, minhash, shared, simhash, toxicity
from lodestar.llm import textkernel as tk
from lodestar.llm.shared import components

SCHEMA = "doc_id long, text string"


def shingles(text, size=5):
    words = text.lower().split()
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_reach_the_similarity(spark):
    """Against all pairs: whatever Jaccard 0.8 connects leaves one row, the rest stays."""
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append(" ".join(base))
        for changed in (0.002, 0.01, 0.02, 0.05):
            rows.append(" ".join(f"v{rng.randrange(5000)}" if rng.random() < changed else w for w in base))
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))
    pairs = [(x, y) for x in range(len(rows)) for y in range(x) if alike(sets[x], sets[y]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for x, y in pairs:
            least = min(root[x], root[y])
            changed |= root[x] != root[y]
            root[x] = root[y] = least
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(rows)), SCHEMA), "")
    assert len(pairs) > 100 and len(set(root)) < len(rows)
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_lines_by_edit_similarity_alone(spark):
    """All pairs of sf0.001's lines: of those with edit similarity 0.8, all but a few end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forms = {}
    for r in docs.orderBy("doc_id").collect():
        for line in (r.text or "").split("\n"):
            form = b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), line.encode()))).decode()
            if form:
                forms.setdefault(form, len(forms))
    forms = list(forms)
    counts = np.array([np.bincount(np.frombuffer(f.encode("utf-32-le"), np.uint32) % 64, minlength=64) for f in forms])
    size = np.array([len(f) for f in forms])
    pairs = []
    for x in range(len(forms)):
        # No edit changes more than one letter for another: a bound that loses no pair.
        bound = np.maximum(np.maximum(counts[x + 1 :] - counts[x], 0).sum(axis=1), np.maximum(counts[x] - counts[x + 1 :], 0).sum(axis=1))
        for y in np.flatnonzero(bound <= 0.2 * np.maximum(size[x + 1 :], size[x]) + 1e-9) + x + 1:
            if line_dedup.similar(forms[x], forms[y], 0.8):
                pairs.append((x, int(y)))
    rows = spark.createDataFrame(list(enumerate(forms)), SCHEMA)
    out = {r.doc_id: bool(r.removed) for r in line_dedup.deduplicated(rows).select("row.doc_id", "removed").collect()}
    caught = sum(out[y] for _, y in pairs)
    assert len(pairs) > 40 and caught >= 0.97 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert all(not cut or d in linked for d, cut in out.items())


def test_lines_with_one_letter_changed(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
    lines = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(300)]
    place = [rng.randrange(len(t)) for t in lines]
    changed = [t[:k] + "0" + t[k + 1 :] for t, k in zip(lines, place, strict=True)]
    out = line_dedup.deduplicated(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(changed))], SCHEMA))
    removed = {r.doc_id: len(r.removed) for r in out.select("row.doc_id", "removed").collect()}
    assert removed[1] == 0 and removed[2] >= 297


def test_toxic_words_with_gaps():
    names = ["idiot", "clown", "stupid", "pathetic"]
    vectors = [toxicity.embed(n.encode()) for n in names]
    landmarks = np.array([v / float(v @ v) for v in vectors], np.float32).T.copy()
    for join in (".".join, " ".join, "x".join, "-".join, " . ".join, "..".join, ". ".join):
        texts = ["", *(f"the day was {join(n)}, he said" for n in names), "the day was long and I like a book"]
        found = toxicity.features(*tk.utf8(pa.array(texts)), landmarks)
        assert (found[np.arange(1, 5), np.arange(4)] >= 0.9).all(), join("abc")
        assert (found[0] == 0).all() and (found[5] == 0).all()


def test_near_duplicates_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(50))
    other, third = text.replace("w", "x"), text.replace("w", "y")
    rows = [(None, text), (5, text), (5, text), (7, other), (7, text), (None, third), (None, third), (9, None), (None, "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, text), (7, other), (0, third), (9, "")])


def test_decontamination_by_row(spark, tmp_path):
    item = " ".join(f"i{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "a clean text"), (3, item), (3, "another clean text"), (4, "more of it"), (4, "more of it")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a clean text"), (3, "another clean text"), (4, "more of it"), (4, "more of it")]


def test_chains_of_links_keep_plans_small(spark):
    """A chain takes many rounds; the size that Catalyst expects of each round's tables must not grow with all before."""
    links = spark.range(1000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    out = components(links)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 5000
    assert out.count() == 1001 and out.select("root").distinct().count() == 1


def test_chains_of_near_copies_keep_plans_small(spark, monkeypatch):
    """Windows that slide over one text: one group by a chain of links, and no table on the way expects to be huge."""
    sizes, inner = [], shared.checkpointed

    def watched(df):
        out = inner(df)
        sizes.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(shared, "checkpointed", watched)
    words = [f"w{k}" for k in range(1500)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(288)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r.doc_id for r in kept] == [0] and len(sizes) > 6 and max(sizes) < 500


def test_near_duplicates_lose_no_pair(spark):
    """Pairs of Jaccard 0.8 that 24 bands of 5 min-hashes all missed, and whose fingerprints are 9 to 15 bits apart."""
    rows = []
    for k in (3936, 4507, 53028, 68517, 71621, 82686, 89795):
        text = " ".join(f"w{9 * k + i}" for i in range(8))
        rows += [(2 * k, text), (2 * k + 1, f"{text} w{9 * k + 8}")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == [d for d, _ in rows[::2]]


def test_prefixes_share_a_shingle(spark):
    """Whatever is known as common, sets of Jaccard 0.8 share a shingle of their prefixes, and the bound by bags keeps them."""
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))]
        rows += [" ".join(base), " ".join(base + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "key long, text string").coalesce(1)
    whole = {r.key: np.frombuffer(r.shingles, np.uint64) for r in minhash.sets(docs, 5).collect()}
    known = np.unique(np.concatenate(list(whole.values())))[::3]
    found = minhash.prefixes(docs, 5, 0.8, (known, (known % np.uint64(7) + np.uint64(1)).astype(np.uint8)))
    prefix = {r.key: set(r.prefix) for r in found.collect()}
    bags = {r.key: r.bags for r in found.collect()}
    same, may, forms = minhash.Jaccard(0.8), minhash.Bags(0.8), [whole[k].tobytes() for k in range(len(rows))]
    near, pairs = may.near([bags[k] for k in range(len(rows))], 0), 0
    for x in range(len(rows)):
        fit = near(x)
        for y in range(x + 1, len(rows)):
            if alike(set(whole[x].tolist()), set(whole[y].tolist())) >= 0.8:
                pairs += 1
                assert prefix[x] & prefix[y] and fit[y - x - 1] and may(bags[x], bags[y]) and same(forms[x], forms[y])
    assert pairs > 50 and sum(map(len, prefix.values())) < sum(map(len, whole.values())) / 3


def broadcast_parts(df):
    """The part of the plan below each of its broadcasts, as it stands before anything has run."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(re.match(r"[\s:+\-*]*", line)[0])
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((n for n in range(k + 1, len(lines)) if depth(lines[n]) <= depth(line)), len(lines))
            out.append("\n".join(lines[k:below]))
    return out


def test_probes_are_not_broadcast(spark):
    """34 probes a fingerprint, which Catalyst takes for as many rows as there are fingerprints: 10 million of them filled the driver."""
    prints = shared.stored(spark.range(300_000).select(F.xxhash64("id").alias("fingerprint")))
    plan = simhash.linked(prints)
    assert "Generate" in plan._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate" in part for part in broadcast_parts(plan))


def test_hits_are_not_broadcast(spark):
    """The windows found in the documents, an explode too, beside the items' own, of which Catalyst doesn't know how few they are."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven eight nine").alias("text"))
    items = spark.range(2_000).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("one two three four five six seven eight n"), "id").alias("text"))
    for containment in (None, 0.25):
        parts = broadcast_parts(decontaminate.contaminated(docs, items, containment=containment))
        # Whole windows; the count of each is bounded by the items'.
        assert not any(re.search(r"Generate explode\(hits", part) for part in parts)
