"""Mixing sources to target weights by temperature, realised as budgeted block permutations.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import load

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 1000
STEPS = 40


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _tempered(totals: Column, exponent: Column) -> Column:
    """Weights of the sources whose token totals are given: shares to the exponent, normalised."""
    whole = _sum(totals)
    raised = F.transform(totals, lambda t: F.pow(t / whole, exponent))
    return F.transform(raised, lambda r: r / _sum(raised))


def _smallest(fits, totals: Column) -> Column:
    """Bisects [0, 1] for the smallest exponent that fits, for a property that holds from some exponent on."""
    halve = lambda s, _: F.when(fits(totals, (s["lo"] + s["hi"]) / 2), F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))).otherwise(
        F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))
    )
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"]
    return F.when(fits(totals, F.lit(0.0)), F.lit(0.0)).otherwise(found)


def weights(docs: DataFrame, budget: float = 1.0, entropy: float | None = 0.98, repeats: float | None = 1.25) -> DataFrame:
    """source, n_docs, total (tokens), exponent, weight, quota (tokens): from rows (source, n_tokens).

    Each source's share of the tokens is raised to one exponent in [0, 1] and normalised.  The exponent is
    the smallest (flattest) at which the weights' entropy is no more than `entropy` times that of equal
    weights and no source is repeated more than `repeats` times within the budget (a factor on all tokens);
    both hold from some exponent on, which bisection finds.  At exponent 1 sources keep their own shares, so
    with a budget over `repeats` the limit can't be met and exponent 1 stands.  Sources without tokens
    weigh nothing.
    """
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("total"))

    def fits(totals: Column, exponent: Column) -> Column:
        w = _tempered(totals, exponent)
        held = F.lit(True)
        if entropy is not None:
            held = held & (-_sum(F.transform(w, lambda x: x * F.ln(x))) <= F.lit(float(entropy)) * F.ln(F.size(totals).cast("double")) + 1e-12)
        if repeats is not None:
            most = F.array_max(F.transform(F.arrays_zip(w.alias("w"), totals.alias("t")), lambda z: z["w"] / z["t"]))
            held = held & (most * _sum(totals) * F.lit(float(budget)) <= F.lit(float(repeats)))
        return held

    lists = per.where("total > 0").agg(F.array_sort(F.collect_list(F.col("total").cast("double"))).alias("totals"))
    found = lists.select("totals", F.round(_smallest(fits, F.col("totals")), 6).alias("exponent"))
    found = found.select("exponent", _sum(F.col("totals")).alias("whole"), _sum(F.transform("totals", lambda t: F.pow(t / _sum(F.col("totals")), F.col("exponent")))).alias("norm"))
    out = per.crossJoin(found)  # one row, so nothing is multiplied
    weight = F.when(F.col("total") > 0, F.round(F.pow(F.col("total") / F.col("whole"), F.col("exponent")) / F.col("norm"), 9)).otherwise(0.0)
    out = out.withColumn("weight", weight)
    return out.select("source", "n_docs", "total", "exponent", "weight", F.floor(F.col("weight") * F.col("whole") * budget + 0.5).cast("long").alias("quota"))


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mixed(docs: DataFrame, budget: float = 1.0, entropy: float | None = 0.98, repeats: float | None = 1.25, seed: int = 7, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The mix: doc_id, source, epoch, position (of its first token in its source's stream), n_tokens, weight.

    A source's stream goes through its documents epoch by epoch until its quota of tokens is full: the last
    document is the one that fills it.  Documents are dealt to blocks of about block_docs by their id's hash;
    in each epoch the blocks come in an order drawn anew, and so do the documents of a block.  So no order of
    a whole source is ever built: running sums are taken inside blocks and over the blocks' totals, and a
    source with a third of all rows is spread like any other.

    Tokens are runs of non-blanks; a null text has none.  Documents without tokens come along where the
    stream passes them.  A null source is a source of its own.  Repeated rows are dealt each.  Extra columns
    are ignored; an empty table gives an empty mix.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"))
    per = weights(base, budget, entropy, repeats).withColumnRenamed("source", "of")
    rows = base.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of").where("quota > 0")
    blocks = F.ceil(F.col("n_docs") / block_docs)
    number = F.conv(F.substring(_hash(F.lit(seed), F.lit("block"), F.col("doc_id")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("block", number % blocks)
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("total")).cast("long"))
    rows = rows.withColumn("epoch", F.explode(epochs))
    rows = rows.withColumn("turn", _hash(F.lit(seed), F.col("epoch"), F.col("doc_id")))
    key = [F.col("source"), F.col("epoch"), F.col("block")]
    inside = Window.partitionBy(*key).orderBy("turn", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    turn = _hash(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block"))
    totals = rows.groupBy(*key).agg(F.sum("n_tokens").alias("block_total")).withColumn("block_turn", turn)
    earlier = Window.partitionBy("source", "epoch").orderBy("block_turn").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("block_total").over(earlier), F.lit(0)))
    totals = totals.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "offset")
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    rows = rows.withColumn("position", F.col("epoch") * F.col("total") + F.col("offset") + F.col("before"))
    return rows.where("position < quota").select("doc_id", "source", "epoch", "position", "n_tokens", "weight")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
per AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS total FROM base GROUP BY source),
lists AS (SELECT list(total::DOUBLE ORDER BY total) AS ts, sum(total)::DOUBLE AS whole, count(*)::DOUBLE AS n FROM per WHERE total > 0),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT i, lo, hi,
      -list_sum(list_transform(r, lambda x: x / z * ln(x / z))) <= 0.98 * ln(n) + 1e-12
      AND list_max(list_transform(range(1, len(r) + 1), lambda k: r[k] / z / ts[k])) * whole <= 1.25 AS ok
    FROM (SELECT i, lo, hi, n, whole, ts, list_transform(ts, lambda t: power(t / whole, (lo + hi) / 2)) AS r,
            list_sum(list_transform(ts, lambda t: power(t / whole, (lo + hi) / 2))) AS z FROM bis, lists WHERE i < 40))),
flat AS (SELECT ln(n) <= 0.98 * ln(n) + 1e-12 AND list_max(list_transform(ts, lambda t: 1 / n / t)) * whole <= 1.25 AS ok FROM lists),
ex AS (SELECT CASE WHEN ok THEN 0.0 ELSE round(hi, 6) END AS a, whole, ts FROM bis, flat, lists WHERE i = 40),
wt AS (SELECT source, n_docs, total, CASE WHEN total > 0 THEN round(power(total / whole, a) / list_sum(list_transform(ts, lambda t: power(t / whole, a))), 9) ELSE 0.0 END AS weight, whole FROM per, ex),
q AS (SELECT *, floor(weight * whole + 0.5)::BIGINT AS quota FROM wt),
dealt AS (SELECT doc_id, b.source, n_tokens, weight, quota, total,
    ('0x' || substr(md5('7:block:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(n_docs / 1000)::BIGINT AS block,
    unnest(range(0, ((quota - 1) // total) + 1)) AS epoch
  FROM base b JOIN q ON b.source IS NOT DISTINCT FROM q.source WHERE quota > 0),
run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY md5('7:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt),
bt AS (SELECT source, epoch, block, sum(n_tokens) AS t FROM dealt GROUP BY ALL),
bo AS (SELECT source, epoch, block, coalesce(sum(t) OVER (PARTITION BY source, epoch ORDER BY md5('7:' || epoch || ':' || coalesce(source, '') || ':' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM bt)
SELECT doc_id, run.source, run.epoch::BIGINT AS epoch, (run.epoch * total + off + before)::BIGINT AS position, n_tokens, weight
FROM run JOIN bo ON run.source IS NOT DISTINCT FROM bo.source AND run.epoch = bo.epoch AND run.block = bo.block
WHERE run.epoch * total + off + before < quota
"""
