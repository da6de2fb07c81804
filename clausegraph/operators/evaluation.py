"""How well scores tell answerable from unanswerable: rows are (slot_type, expected 0/1, predicted 0/1, score, threshold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for no value.
NULLS = ("", "-", "—", "na", "n/a", "none", "null", "nan")


def number(text: Column) -> Column:
    t = F.trim(F.lower(text))
    return F.when(~t.isin(*NULLS), t.try_cast("double"))


def label(text: Column) -> Column:
    """1 answerable, 0 unanswerable, null unknown; `una` is looked for before `ans`."""
    t = F.trim(F.lower(text))
    return F.when(F.contains(t, F.lit("una")), 0).when(F.contains(t, F.lit("ans")), 1).when(t.isin("true", "1", "yes"), 1).when(t.isin("false", "0", "no"), 0)


#: The report's column of each measure of a record.
REPORT = {
    "slot_score": "Slot score", "path_bottleneck": "Path bottleneck", "h0": "H0 life", "chain": "Chain str", "trigger_weight": "Trig wt", "sheaf": "Sheaf cons", "w_sheaf": "Wt sheaf", "w_ricci": "Wt Ricci μ", "bridge": "Bridge scr",
    "type_entropy": "Type H", "exact_frac": "Path cov", "distant_frac": "Mismatch", "sequence_frac": "SS frac", "party_mismatch": "Mismatch", "role_inversion": "Role inv", "placeholder_frac": "Placeholder frac", "trap_confidence": "KwTrap",
}


def report_records(rows: DataFrame, measures: dict[str, str]) -> DataFrame:
    """question, expected, slot and the measures (name: type) of a report's rows, all strings; what a report doesn't have is null."""
    text = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(""))
    path = number(text("Path exists"))
    own = {m: number(text(c)) for m, c in REPORT.items()}
    own |= {"path_exists": F.coalesce(path > 0, F.lit(True)), "n_targets": F.coalesce(number(text("N targets")), F.lit(0)), "n_well": F.coalesce(number(text("N well-conn")), F.lit(0)), "has_tags": F.lit(False)}
    slot = F.coalesce(F.nullif(F.trim(text("Slot type")), F.lit("")), F.lit("GENERAL"))
    return rows.select(F.col("Q").alias("question"), label(text("Expected")).alias("expected"), slot.alias("slot"), *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in measures.items()])


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    y, h = F.col("expected") == 1, F.col("predicted") == 1
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(y & h).alias("tp"), F.count_if(~y & ~h).alias("tn"), F.count_if(~y & h).alias("fp"), F.count_if(y & ~h).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.withColumns({"accuracy": ratio(tp + F.col("tn"), F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve from rank sums with ties at their mean rank.

    Scores are counted by value first, and running counts are kept over values in ranges: each range is summed, ranges are
    put in order, and the values of a range add what comes before, so no task sees all values."""
    counts = rows.groupBy("score").agg(F.count_if(F.col("expected") == 1).alias("p"), F.count_if(F.col("expected") == 0).alias("q"))
    binned = counts.withColumn("bin", F.floor(F.col("score") * 1024))
    before = binned.groupBy("bin").agg(F.sum("q").alias("bq")).withColumn("start", F.coalesce(F.sum("bq").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(before.select("bin", "start"), "bin").withColumn("below", F.col("start") + F.coalesce(F.sum("q").over(inside), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return ranked.agg(F.try_divide(wins, (F.sum("p") * F.sum("q")).cast("double")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("expected"), F.lit(2))).alias("brier"), F.count(F.lit(1)).alias("n"))


def cohens_d(value: Column) -> Column:
    pos, neg = F.when(F.col("expected") == 1, value), F.when(F.col("expected") == 0, value)
    pooled = F.sqrt((F.var_pop(pos) + F.var_pop(neg)) / 2)
    return F.when(F.count(pos) * F.count(neg) > 0, F.when(pooled < 1e-12, 0.0).otherwise((F.avg(pos) - F.avg(neg)) / pooled))


def by_slot(rows: DataFrame) -> DataFrame:
    """Per slot type and, with a null slot type, over all rows, in one pass."""
    return rows.rollup("slot_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("expected") == F.col("predicted")).cast("int")).alias("accuracy"), F.count_if(F.col("expected") == 1).alias("answerable_n"), F.count_if(F.col("expected") == 0).alias("unanswerable_n"), F.avg("score").alias("mean_score"), F.avg("threshold").alias("mean_threshold"))


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Bins of equal width, open above but for the last."""
    k = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return rows.where("score >= 0 AND score <= 1").groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_pred"), F.avg("expected").alias("empirical"))


def score_split(rows: DataFrame) -> DataFrame:
    """Per label the mean and the upper median of the scores."""
    w = Window.partitionBy("expected")
    ranked = rows.select("expected", "score").withColumns({"k": F.row_number().over(w.orderBy("score")), "n": F.count(F.lit(1)).over(w)})
    return ranked.groupBy("expected").agg(F.avg("score").alias("mean_score"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("score"))).alias("median_score"))


def signals(rows: DataFrame, names: list[str]) -> DataFrame:
    """signal, n, null_rate, n_distinct, cohens_d, mean_answerable, mean_unanswerable for each named column."""
    long = rows.unpivot(["expected"], [F.col(n).cast("double").alias(n) for n in names], "signal", "value")
    v = F.col("value")
    return long.groupBy("signal").agg(
        F.count(v).alias("n"), (1 - F.count(v) / F.count(F.lit(1))).alias("null_rate"), F.count_distinct(F.round(v, 10)).alias("n_distinct"), cohens_d(v).alias("cohens_d"),
        F.avg(F.when(F.col("expected") == 1, v)).alias("mean_answerable"), F.avg(F.when(F.col("expected") == 0, v)).alias("mean_unanswerable"),
    )


def ablation(records: DataFrame, drops: dict[str, str], score) -> DataFrame:
    """test, accuracy, delta: the scorer over the records with one measure gone each time; `none` is the base. One pass over rows times drops."""
    tests = F.explode(F.array(F.lit("none"), *map(F.lit, drops))).alias("test")
    many = records.select("*", tests)
    many = many.withColumns({col: F.when(F.col("test") != name, F.col(col)) for name, col in drops.items()})
    got = score(many).groupBy("test").agg(F.avg((F.col("answerable").cast("int") == F.col("expected")).cast("int")).alias("accuracy"))
    base = got.where("test = 'none'").select(F.col("accuracy").alias("base"))
    return got.crossJoin(F.broadcast(base)).select("test", "accuracy", (F.col("accuracy") - F.col("base")).alias("delta"))  # one row


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("expected <> predicted").withColumn("margin", F.abs(F.col("score") - F.col("threshold")))


def label_counts(questions: DataFrame) -> DataFrame:
    """doc and its number of questions by label, as columns."""
    return questions.groupBy("doc").pivot("label", ["answerable", "unanswerable"]).count().na.fill(0)
