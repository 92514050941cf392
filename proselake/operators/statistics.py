"""Statistics of evaluations: classification, calibration, agreement of many raters, preferences, bootstrap, blind trials."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classification(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1. A null prediction abstains: it counts in fn only."""
    seen = rows.select(F.col(gold).alias("g"), F.col(predicted).alias("p")).groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    classes = seen.select(F.col("g").alias("class")).unionByName(seen.select(F.col("p").alias("class"))).filter("class is not null").distinct()
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    k = F.col("class")
    g, p = F.col("g"), F.col("p")
    cells = classes.join(seen, (k == g) | (k == p)).groupBy("class").agg(hit((g == k) & (p == k)).alias("tp"), hit((p == k) & ~g.eqNullSafe(k)).alias("fp"), hit((g == k) & ~p.eqNullSafe(k)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def macro(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: cases, answered, coverage, accuracy of the answered, macro_f1."""
    f1 = classification(rows, gold, predicted).agg(F.avg("f1").alias("macro_f1"))
    answered = F.count(predicted)
    right = F.sum((F.col(gold) == F.col(predicted)).cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("cases"), answered.alias("answered"), (answered / F.count(F.lit(1))).alias("coverage"), (right / answered).alias("accuracy")).join(F.broadcast(f1), F.lit(True))


def risk_coverage(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """For each confidence: how many are as sure or surer, and the share of errors among them. One row per distinct confidence before the window."""
    n = rows.groupBy(F.col(confidence).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(correct).cast("int")).alias("wrong"))
    w = Window.orderBy(F.desc("confidence"))
    return n.select("confidence", F.sum("n").over(w).alias("covered"), (F.sum("wrong").over(w) / F.sum("n").over(w)).alias("risk"))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per bin of the confidence (0 to 1, the last bin closed): n, mean confidence, accuracy, gap."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")
    b = rows.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    return b.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: ece and brier."""
    ece = calibration(rows, confidence, correct, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    miss = F.col(confidence) - F.col(correct).cast("int")
    return rows.agg(F.avg(miss * miss).alias("brier")).join(F.broadcast(ece), F.lit(True))


def nominal_alpha(ratings: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Krippendorff's alpha for nominal values of any number of raters: pairs, observed, expected, alpha.

    Units with fewer than two values do not count. Only (unit, value) counts are exchanged, and at the end one row per
    value. alpha is null where only one value occurs.
    """
    n = ratings.filter(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n").over(Window.partitionBy("u"))
    n = n.withColumn("m", m).filter("m >= 2")
    same = n.groupBy("v").agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("off"))
    t = same.agg(F.sum("total").alias("pairs"), F.sum("off").alias("off"), F.sum(F.col("total") * F.col("total")).alias("square"))
    observed = F.col("off") / F.col("pairs")
    expected = (F.col("pairs") * F.col("pairs") - F.col("square")) / (F.col("pairs") * (F.col("pairs") - 1))
    return t.select("pairs", observed.alias("observed"), expected.alias("expected"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))


def consensus(ratings: DataFrame, valid: list[str], least: int, unit: str = "unit", value: str = "value") -> DataFrame:
    """Per unit: the value that more than half of the answers give, where there are `least` or more; else noConsensus."""
    n = ratings.filter(F.col(value).isin(valid)).groupBy(F.col(unit).alias("unit"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    u = n.groupBy("unit").agg(F.sum("n").alias("answered"), F.max(F.struct("n", "v")).alias("top"))
    sure = (F.col("answered") >= least) & (2 * F.col("top.n") > F.col("answered"))
    return u.select("unit", "answered", F.when(sure, F.col("top.v")).otherwise("noConsensus").alias("verdict"))


def preferences(rows: DataFrame, choice: str, genre: str) -> DataFrame:
    """Share of a choice against b over all and by genre; a tie is half for each. genre is null in the total."""
    score = F.when(F.col(choice) == "a", 1.0).when(F.col(choice) == "b", 0.0).when(F.col(choice) == "tie", 0.5)
    r = rows.withColumn("__s", score).filter("__s is not null")
    return r.groupingSets([[genre], []], genre).agg(F.count(F.lit(1)).alias("n"), F.avg("__s").alias("share"))


def bootstrap_mean(rows: DataFrame, group: str, value: str, seed: int = 0, iterations: int = 5000, level: float = 0.95) -> DataFrame:
    """Per group: n, mean, low, high of the mean under resampling.

    Values are first counted, so what meets in a task are distinct values; each draw is a multinomial over their counts, which is
    the same as drawing rows. The seed and the group decide the draws.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("group"), F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))

    def draw(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("value")
        total = int(d.n.sum())
        rng = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(str(key[0]).encode()).digest()[:8], "big")])
        means = rng.multinomial(total, d.n / total, iterations) @ d.value.to_numpy() / total
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([(key[0], total, float((d.n * d.value).sum() / total), float(low), float(high))], columns=["group", "n", "mean", "low", "high"])

    return counted.groupBy("group").applyInPandas(draw, "group string, n long, mean double, low double, high double")


def left_side(trial: Column, seed: int) -> Column:
    """Whether the candidate of a trial is shown on the left: the parity of a digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), trial.cast("string")), 256), 64, 1), 16, 10).cast("int") % 2 == 0


def balanced_sides(trials: DataFrame, key: str, seed: int) -> DataFrame:
    """Each trial's side, as many left as right within one: every other trial in the order of a digest, by hash bucket and rank."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    t = trials.withColumn("__d", digest).withColumn("__b", F.substring("__d", 1, 2))
    before = t.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__d", key)) - 1
    return t.join(F.broadcast(before), "__b").withColumn("left", (rank + F.col("__before")) % 2 == 0).drop("__d", "__b", "__n", "__before")


def judge_cases(pairs: DataFrame) -> DataFrame:
    """Both presentations of each pair (case_id, a, b): forward and reversed."""
    both = F.array(F.struct(F.lit("forward").alias("order"), F.col("a").alias("first"), F.col("b").alias("second")), F.struct(F.lit("reversed").alias("order"), F.col("b").alias("first"), F.col("a").alias("second")))
    return pairs.select("case_id", F.explode(both).alias("p")).select("case_id", "p.*")


def pair_decisions(judged: DataFrame) -> DataFrame:
    """Per case of (case_id, order, winner: first, second or tie): the decision of both orders, and whether they agree."""
    side = F.when(F.col("winner") == "tie", "tie").when((F.col("winner") == "first") == (F.col("order") == "forward"), "a").otherwise("b")
    d = judged.withColumn("s", side).groupBy("case_id").agg(F.max(F.when(F.col("order") == "forward", F.col("s"))).alias("forward"), F.max(F.when(F.col("order") == "reversed", F.col("s"))).alias("backward"))
    agree = F.coalesce(F.col("forward") == F.col("backward"), F.lit(False))
    return d.select("case_id", F.when(agree, F.col("forward")).otherwise("tie").alias("decision"), agree.alias("consistent"))


def results_summary(results: DataFrame, *dimensions: str) -> DataFrame:
    """Counts per dimension and value in one pass: (dimension, value, n)."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return results.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))


def stable_digest(value: object) -> str:
    """SHA-256 of a value's canonical JSON: sorted keys, no blanks, text as it is."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def exact_keys(data: object, expected: set[str], where: str) -> dict:
    """The mapping, if it has exactly these keys."""
    if not isinstance(data, dict) or set(data) != expected:
        raise ValueError(f"{where}: expected the keys {sorted(expected)}")
    return data


def evenly(rows: DataFrame, order: list[str], limit: int, *keys: str) -> DataFrame:
    """At most `limit` rows per key, evenly spaced in the given order."""
    part = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    r = rows.withColumn("__i", F.row_number().over(part.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(part))
    kept = (F.col("__n") <= limit) | (F.expr(f"__i * {limit} div __n") != F.expr(f"(__i - 1) * {limit} div __n")) | (F.col("__i") == 0)
    return r.filter(kept).drop("__i", "__n")


def percentile_rank(values: DataFrame, keys: list[str], value: str, points: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Nearest-rank percentiles per key over the counts of distinct values; the rank's index is rounded half to even."""
    n = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("__c", F.sum("__n").over(w.orderBy(value))).withColumn("__t", F.sum("__n").over(w))
    at = lambda p: F.bround((F.col("__t") - 1) * p / 100.0, 0)
    return n.groupBy(*keys).agg(*[F.min(F.when(F.col("__c") > at(p), F.col(value))).alias(f"p{p}") for p in points])
