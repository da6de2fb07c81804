"""Queries over labels and scores: a document's quality label is what was expected of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators import evaluation as ev
from clausegraph.operators import scoring

from .answers import records
from .registry import query

_ROWS = "r AS (SELECT l.doc_id, d.lang AS slot_type, quality AS expected, (l.doc_id * 37 % 101) / 100.0 AS score, 0.5 AS threshold, CASE WHEN (l.doc_id * 37 % 101) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    score = F.col("doc_id") * 37 % 101 / F.lit(100.0)
    return labels.join(docs.select("doc_id", F.col("lang").alias("slot_type")), "doc_id").select("doc_id", "slot_type", F.col("quality").alias("expected"), score.alias("score"), F.lit(0.5).alias("threshold"), (score >= 0.5).cast("int").alias("predicted"))


@query(f"WITH {_ROWS}, c AS (SELECT count(*) AS n, count(*) FILTER (expected = 1 AND predicted = 1) AS tp, count(*) FILTER (expected = 0 AND predicted = 0) AS tn, count(*) FILTER (expected = 0 AND predicted = 1) AS fp, count(*) FILTER (expected = 1 AND predicted = 0) AS fn FROM r) SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(rows(spark, sf_dir))


@query(f"WITH {_ROWS}, p AS (SELECT a.score > b.score AS w, a.score = b.score AS t FROM r a, r b WHERE a.expected = 1 AND b.expected = 0) SELECT avg(w::INT + 0.5 * t::INT) AS auc, (SELECT count(*) FROM r WHERE expected = 1) AS n_pos, (SELECT count(*) FROM r WHERE expected = 0) AS n_neg FROM p")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auc(rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT avg((score - expected) ** 2) AS brier, count(*) AS n FROM r")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.brier(rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT slot_type, (avg(score) FILTER (expected = 1) - avg(score) FILTER (expected = 0)) / sqrt((var_pop(score) FILTER (expected = 1) + var_pop(score) FILTER (expected = 0)) / 2) AS d FROM r GROUP BY slot_type")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("slot_type").agg(ev.cohens_d(F.col("score")).alias("d"))


@query(f"WITH {_ROWS} SELECT CAST(least(floor(score * 5), 4) AS INT) AS bin, count(*) AS n, avg(score) AS mean_pred, avg(expected) AS empirical FROM r GROUP BY ALL")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.calibration(rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT slot_type, count(*) AS n, avg((expected = predicted)::INT) AS accuracy, count(*) FILTER (expected = 1) AS answerable_n, count(*) FILTER (expected = 0) AS unanswerable_n, avg(score) AS mean_score, avg(threshold) AS mean_threshold FROM r GROUP BY ROLLUP (slot_type)")
def per_slot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_slot(rows(spark, sf_dir))


@query(f"WITH {_ROWS}, k AS (SELECT expected, score, row_number() OVER (PARTITION BY expected ORDER BY score) AS k, count(*) OVER (PARTITION BY expected) AS n FROM r) SELECT expected, avg(score) AS mean_score, max(score) FILTER (k = n // 2 + 1) AS median_score FROM k GROUP BY expected")
def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.score_split(rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT doc_id, expected, predicted, abs(score - threshold) AS margin FROM r WHERE expected <> predicted")
def error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.errors(rows(spark, sf_dir)).select("doc_id", "expected", "predicted", "margin")


_SIGNALS = {"s1": "doc_id % 17", "s2": "CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END", "s3": "1"}


@query(f"""WITH {_ROWS}, l AS ({' UNION ALL '.join(f"SELECT '{n}' AS signal, expected, CAST({e} AS DOUBLE) AS v FROM r" for n, e in _SIGNALS.items())}),
  m AS (SELECT signal, count(v) AS n, 1 - count(v) / count(*) AS null_rate, count(DISTINCT v) AS n_distinct, avg(v) FILTER (expected = 1) AS mean_answerable, avg(v) FILTER (expected = 0) AS mean_unanswerable, sqrt((var_pop(v) FILTER (expected = 1) + var_pop(v) FILTER (expected = 0)) / 2) AS s FROM l GROUP BY signal)
  SELECT signal, n, null_rate, n_distinct, mean_answerable, mean_unanswerable, CASE WHEN s < 1e-12 THEN 0 ELSE (mean_answerable - mean_unanswerable) / s END AS cohens_d FROM m""")
def signal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.signals(rows(spark, sf_dir).selectExpr("expected", *[f"{e} AS {n}" for n, e in _SIGNALS.items()]), list(_SIGNALS))


_TEXTS = ("answerable", "Unanswerable", "yes", "0", "n/a", "TRUE", "maybe una", "ans?")


@query(f"SELECT doc_id, CAST([1, 0, 1, 0, NULL, 1, 0, 1][1 + doc_id % 8] AS INT) AS label, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.5 WHEN 2 THEN NULL WHEN 3 THEN -2.0 ELSE NULL END AS number FROM labels")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    pick = lambda v, k: F.get(F.array(*map(F.lit, v)), (F.col("doc_id") % k).cast("int"))
    return labels.select("doc_id", ev.label(pick(_TEXTS, 8)).alias("label"), ev.number(pick((" N/A ", " 1.5", "nan", "-2", "x"), 5)).alias("number"))


@query("SELECT d.source AS doc, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS answerable, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS unanswerable FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return ev.label_counts(labels.join(docs, "doc_id").select(F.col("source").alias("doc"), F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable").alias("label")))


#: Measures that are dropped in turn.
DROPS = {"drop_path_bottleneck": "path_bottleneck", "drop_slot_score": "slot_score", "drop_h0_life": "h0", "drop_trigger_weight": "trigger_weight", "drop_chain_strength": "chain", "drop_type_entropy": "type_entropy", "drop_sheaf_consistency": "sheaf", "drop_weighted_sheaf": "w_sheaf", "drop_weighted_ricci": "w_ricci", "drop_anchor_bridge": "bridge"}


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = records(spark, sf_dir).withColumn("expected", F.when(F.col("question_id") % 3 == 0, 1).otherwise(0))
    return ev.ablation(base, DROPS, scoring.score)
