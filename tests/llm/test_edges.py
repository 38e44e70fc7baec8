"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, interpolated_lm, langid, line_dedup, maxscore, mixing, quality, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string, n_tokens string, score string, key string, hits string, weight string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it rests for a while in the shade of a tree"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", LONG, PROSE, PROSE, "!!! ---", "Élan ünd ñandú\n\n" + PROSE, PROSE.upper() + "\n" + PROSE, "x", None]
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b"][i % 3], len(t or "")) + ("x",) * 7 for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, PROSE, "en", "a", 5) + (None,) * 7, (3, "another text under an id that is there", "en", "a", 5) + (None,) * 7]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, PROSE), (None, "jumps over the lazy dog"), (3, None), (4, ""), (5, "x"), (5, "x")], "item_id long, text string")


def test_decontamination(spark, docs, items):
    for containment in (None, 0.5, 1.0):
        out = decontaminate.contaminated(docs, items, containment=containment).collect()
        assert len(out) == docs.count()
        prose = [r for r in out if r.doc_id == 4][0]
        assert prose.items == ["1", "2"] and prose.n_hit == prose.n_words == len(PROSE.split())
        assert [r.items for r in out if r.doc_id == 8] == [["5"]]
        assert {r.n_words for r in out if r.doc_id in (0, 1, 5, 9)} == {0}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_suffix_dedup(docs):
    out = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.deduplicated(docs).collect()}
    assert suffix_dedup.deduplicated(docs).count() == docs.count()
    assert out[3, len(PROSE)].n_removed == 0 and out[4, len(PROSE)].n_removed == len(PROSE)
    assert out[None, len(PROSE)].n_removed == len(PROSE)
    assert out[0, 0].kept == b""
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    out = line_dedup.deduplicated(docs)
    rows = out.select("row.doc_id", "row.text", "row.row", "n_lines", "removed", "kept").collect()
    assert len(rows) == docs.count()
    assert [r.kept for r in rows if r.doc_id == 3 and r.text == PROSE] == [PROSE] * 3  # repeated rows are one document
    assert [r.kept for r in rows if r.doc_id == 7] == [""]
    assert [r.kept for r in rows if r.doc_id == 6] == ["Élan ünd ñandú\n"]
    assert [r.kept for r in rows if r.doc_id == 0] == [None] and [r.n_lines for r in rows if r.doc_id == 0] == [0]
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"{'one and the same line' if k % 3 else f'number {k} {k * k} {k ** 3}'}" for k in range(30_000))
    out = line_dedup.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string"), similarity=1.0).first()
    seen, kept = set(), []
    for line in text.split("\n"):
        if line not in seen:
            seen.add(line)
            kept.append(line)
    assert out.kept == "\n".join(kept) and len(out.removed) == 30_000 - len(kept)


def test_quality(docs, labels):
    model = quality.train(docs, labels)
    out = quality.graded(docs, model, 1).collect()
    assert len(out) == docs.count() and all(0 <= r.tail_probability <= 1 for r in out)
    assert len({r.expected_grade for r in out if r.doc_id in (0, 1, 9)}) == 1
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert quality.graded(docs, quality.train(docs, none), 1).count() == docs.count()
    assert quality.graded(docs.limit(0), model, 1).count() == 0


def test_language_model(docs):
    out = interpolated_lm.scored(docs).collect()
    assert len(out) == docs.count()
    assert {r.n_tokens for r in out if r.doc_id in (0, 1, 9)} == {1}
    assert all(r.score < 0 for r in out) and {r.held_out for r in out if r.doc_id is None} == {False}
    assert interpolated_lm.scored(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    machine = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, machine).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert toxicity.toxicity(docs, toxicity.train(docs, none)).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


def test_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [-0.5, -0.5], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1)]
    vectors = maxscore.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    out = maxscore.top_k(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in out] == [(1, 1, 32768), (2, 2, 32768), (3, 8, 32768)]
    assert maxscore.top_k(vectors.limit(0), vectors.limit(0), 3).count() == 0
    assert maxscore.top_k(vectors, vectors.limit(0), 3).count() == 0


def test_language(docs):
    model = langid.train(docs.select("lang", "text"))
    out = langid.identified(docs, *model).select("row.doc_id", "row.score", "lang_pred").collect()
    assert len(out) == docs.count()
    assert {r.lang_pred for r in out if r.doc_id in (0, 1, 5, 9)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id == 3} <= {"en", "de"}
    assert langid.identified(docs, *langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identified(docs.limit(0), *model).count() == 0


def test_near_duplicates(docs):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert {r.component_id for r in out if r.doc_id in (0, 1, 9)} == {0}
    assert {r.component_id for r in out if r.doc_id == 4} == {3}
    assert {r.fingerprint for r in out if r.doc_id in (0, 1, 9)} == {0}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mixed(docs)
    assert {r.source for r in out.collect()} == {None, "a", "b"}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_pipeline_stages(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept and not kept & {0, 1, 4, 5, 9}
