"""Classifier evaluation from counts: confusion, floors, ranking metrics, calibration, decompositions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import CLASSES, argmax_label, total_variation, vector_mean, vector_weighted_mean
from .ranking import rank_in_group, ranked_totals

BINS = 10


def _div(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.nullif(b, F.lit(0))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Counts of every (true, predicted) cell, zeros included, in one pass."""
    one = df.agg(*[
        F.count_if((F.col(truth) == a) & (F.col(pred) == b)).alias(f"{a}|{b}") for a in classes for b in classes
    ])
    cells = F.array(*[
        F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred"), F.col(f"`{a}|{b}`").alias("n")) for a in classes for b in classes
    ])
    return one.select(F.inline(cells))


def class_counts(df: DataFrame, group: Sequence[str], truth: str, pred: str, classes: Sequence[str] = CLASSES, times: str | None = None) -> DataFrame:
    """Counts of rows; with `times`, a row stands for so many."""

    def number(c: Column) -> Column:
        return F.sum(F.when(c, F.col(times)).otherwise(0)) if times else F.count_if(c)

    aggs = [number(F.lit(True)).alias("n"), number(F.col(truth) == F.col(pred)).alias("n_correct")]
    for c in classes:
        t, p = F.col(truth) == c, F.col(pred) == c
        aggs += [number(t & p).alias(f"tp_{c}"), number(p).alias(f"pp_{c}"), number(t).alias(f"ap_{c}")]
    return df.groupBy(*group).agg(*aggs)


def _prf(c: str) -> tuple[Column, Column, Column]:
    rec, prec = _or0(_div(f"tp_{c}", f"ap_{c}")), _or0(_div(f"tp_{c}", f"pp_{c}"))
    return rec, prec, _or0(2 * F.col(f"tp_{c}") / F.nullif(F.col(f"ap_{c}") + F.col(f"pp_{c}"), F.lit(0)))


def per_class(df: DataFrame, truth: str, pred: str, group: Sequence[str] = (), classes: Sequence[str] = CLASSES, times: str | None = None) -> DataFrame:
    """Recall, precision, F1 and support per class; 0 where a ratio is undefined."""
    cells = []
    for c in classes:
        rec, prec, f1 = _prf(c)
        cells.append(F.struct(F.lit(c).alias("class"), rec.alias("recall"), prec.alias("precision"), f1.alias("f1"), F.col(f"ap_{c}").alias("support")))
    return class_counts(df, group, truth, pred, classes, times).select(*group, F.inline(F.array(*cells)))


def summary(df: DataFrame, truth: str, pred: str, group: Sequence[str] = (), classes: Sequence[str] = CLASSES, times: str | None = None) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1."""
    f1 = [_prf(c)[2] for c in classes]
    macro = sum(f1[1:], f1[0]) / len(classes)
    parts = [f * F.col(f"ap_{c}") for f, c in zip(f1, classes)]
    return class_counts(df, group, truth, pred, classes, times).select(
        *group, "n", _div("n_correct", "n").alias("accuracy"), macro.alias("macro_f1"), _div(sum(parts[1:], parts[0]), "n").alias("weighted_f1")
    )


def random_floor(df: DataFrame, event: Column, fired: Column, group: Sequence[str] = ()) -> DataFrame:
    """Expected recall, precision and recall sd of flagging as many random rows as were flagged.

    Closed form (hypergeometric) instead of repeated draws.
    """
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(event).alias("m"), F.count_if(fired).alias("k"))
    n, m, k = (F.col(c).cast("double") for c in "nmk")
    var = k * (m / n) * (1 - m / n) * (n - k) / F.nullif(n - 1, F.lit(0.0))
    return g.select(
        *group, "n", "m", "k", (k / n).alias("recall"), F.when(k > 0, m / n).otherwise(0.0).alias("precision"),
        (F.sqrt(var) / F.nullif(m, F.lit(0.0))).alias("recall_sd"),
    )


def threshold_at_budget(df: DataFrame, score: str, key: str, event: Column, fired: Column) -> DataFrame:
    """Recall and precision of flagging the top rows by score, as many as were fired; ties by key."""
    r = rank_in_group(df.withColumn("_y", event), [], score, key, totals={"_k": fired.cast("bigint")})
    g = r.agg(
        F.count("*").alias("n"), F.max("_k").alias("k"), F.count_if(F.col("_y")).alias("m"),
        F.count_if(F.col("_y") & (F.col("rk") <= F.col("_k"))).alias("hits"),
    )
    return g.select("n", "k", "hits", _div("hits", "m").alias("recall"), _div("hits", "k").alias("precision"))


def headline(df: DataFrame, truth: str, preds: dict[str, str], event: str, score: str, key: str, budget_of: str) -> DataFrame:
    """One row per method: argmax methods, the random floor and the threshold at the same budget."""
    long = df.select(truth, F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("pred")) for n, c in preds.items()])).alias("_m")).select(truth, "_m.*")
    c = class_counts(long, ["method"], truth, "pred")
    arg = c.select("method", _or0(_div(f"tp_{event}", f"ap_{event}")).alias("recall"), _or0(_div(f"tp_{event}", f"pp_{event}")).alias("precision"),
                   _div("n_correct", "n").alias("accuracy"), _div(f"pp_{event}", "n").alias("fire_rate"))
    y, f = F.col(truth) == event, F.col(budget_of) == event
    rnd = random_floor(df, y, f).select(F.lit("random").alias("method"), "recall", "precision", _div("k", "n").alias("fire_rate"))
    thr = threshold_at_budget(df, score, key, y, f).select(F.lit("threshold").alias("method"), "recall", "precision", _div("k", "n").alias("fire_rate"))
    return arg.unionByName(rnd, allowMissingColumns=True).unionByName(thr, allowMissingColumns=True)


def ranking_metrics(df: DataFrame, score: str, event: Column, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """ROC area (ties count half) and average precision (tied scores form one step) per group.

    Both come from prefix sums over distinct scores.
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    cum = ranked_totals(df, group, score, {"n": w, "p": F.when(event, w).otherwise(F.lit(0))}, descending=True)
    tot = cum.groupBy(*group).agg(F.sum("n").alias("_N"), F.sum("p").alias("_P"))
    cum = cum.join(tot, list(group)) if group else cum.withColumn("_t", tot.select(F.struct("*")).scalar()).withColumns({"_N": F.col("_t._N"), "_P": F.col("_t._P")})
    neg_below = (F.col("_N") - F.col("_P")) - (F.col("cum_n") - F.col("cum_p"))
    area = F.sum(F.col("p").cast("double") * (neg_below + (F.col("n") - F.col("p")) / 2))
    ap = F.sum(F.col("p").cast("double") * F.col("cum_p") / F.col("cum_n"))
    return cum.groupBy(*group).agg(F.max("_N").alias("n"), F.max("_P").alias("n_event"), area.alias("_a"), ap.alias("_ap")).select(
        *group, "n", "n_event",
        (F.col("_a") / F.nullif(F.col("n_event").cast("double") * (F.col("n") - F.col("n_event")), F.lit(0.0))).alias("roc_auc"),
        (F.col("_ap") / F.nullif(F.col("n_event").cast("double"), F.lit(0.0))).alias("avg_precision"),
    )


def probability_bin(p: str, bins: int = BINS) -> Column:
    """Equal-width bin; the edges are multiples of the step in double arithmetic, left-closed."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + (F.col(p) >= F.lit(i * (1.0 / bins))).cast("int")
    return out


def reliability_curve(df: DataFrame, p: str, event: Column, bins: int = BINS) -> DataFrame:
    """Count, mean forecast and observed rate of every bin, empty bins included."""
    g = df.withColumn("bin", probability_bin(p, bins)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_forecast"), F.avg(event.cast("double")).alias("observed")
    )
    one = g.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "mean_forecast", "observed")))).alias("_m"))
    every = one.select("_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    cell = F.col("_m")[F.col("bin")]
    return every.select(
        "bin", (F.col("bin") * (1.0 / bins)).alias("lo"), ((F.col("bin") + 1) * (1.0 / bins)).alias("hi"),
        F.coalesce(cell["n"], F.lit(0)).alias("n"), cell["mean_forecast"].alias("mean_forecast"), cell["observed"].alias("observed"),
    )


def murphy(df: DataFrame, p: str, event: Column, bins: int = BINS) -> DataFrame:
    """Brier score with its reliability, resolution, uncertainty and residual parts, and the ECE."""
    y = event.cast("double")
    g = df.withColumn("_b", probability_bin(p, bins)).groupBy("_b").agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - y) * (F.col(p) - y)).alias("se")
    )
    base = g.agg((F.sum("sy") / F.sum("n")).alias("b")).scalar()
    pk, yk = F.col("sp") / F.col("n"), F.col("sy") / F.col("n")
    n = F.sum("n")
    out = g.withColumn("_base", base).agg(
        n.alias("n"), (F.sum("se") / n).alias("brier"), (F.sum(F.col("n") * (pk - yk) * (pk - yk)) / n).alias("reliability"),
        (F.sum(F.col("n") * (yk - F.col("_base")) * (yk - F.col("_base"))) / n).alias("resolution"),
        F.max(F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"), (F.sum(F.col("n") * F.abs(pk - yk)) / n).alias("ece"),
    )
    return out.withColumn("residual", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def grid_share(df: DataFrame, p: str, step: float) -> DataFrame:
    """Number of distinct probabilities and the share lying on a grid."""
    near = F.abs(F.bround(F.col(p) / step) * step - F.col(p)) <= 1e-9 + 1e-5 * F.abs(F.col(p))
    return df.agg(F.count("*").alias("n"), F.countDistinct(p).alias("n_distinct"), F.avg(near.cast("double")).alias("on_grid"))


def tie_census(df: DataFrame, inc: str, hold: str, red: str, event: Column) -> DataFrame:
    """Ties for the top probability, and recall if every tie with the event class went to it."""
    top = F.greatest(inc, hold, red)
    at_top = sum(((F.col(c) == top).cast("int") for c in (hold, red)), (F.col(inc) == top).cast("int"))
    tied = at_top >= 2
    tied_red = tied & (F.col(red) == top)
    fired = argmax_label(inc, hold, red) == "reduce"
    g = df.agg(
        F.count("*").alias("n"), F.count_if(tied).alias("n_tied"), F.count_if(tied_red).alias("n_tied_event"), F.count_if(event).alias("n_event"),
        F.count_if(fired).alias("fired"), F.count_if(fired | tied_red).alias("fired_upper"),
        F.count_if(fired & event).alias("_h"), F.count_if((fired | tied_red) & event).alias("_hu"),
    )
    return g.withColumn("recall", _div("_h", "n_event")).withColumn("recall_upper", _div("_hu", "n_event")).drop("_h", "_hu")


def diebold_mariano(df: DataFrame, t: str, event: Column, scores: dict[str, str]) -> DataFrame:
    """Paired tests of period-mean squared errors, with the base rate as one more forecast.

    Mean difference, t with the small-sample factor sqrt((T-1)/T), and T, for every pair.
    """
    y = event.cast("double")
    base = df.agg(F.avg(y).alias("b")).scalar()
    d = df.withColumn("_base", base)
    cols = {**{n: F.col(c) for n, c in scores.items()}, "base": F.col("_base")}
    per = d.groupBy(t).agg(*[F.avg((c - y) * (c - y)).alias(n) for n, c in cols.items()])
    pairs = list(combinations(cols, 2))
    long = per.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs
    ])).alias("_p")).select("_p.*")
    g = long.groupBy("pair").agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("_sd"), F.count("d").alias("n_periods"))
    n = F.col("n_periods")
    return g.withColumn("t", F.col("mean_diff") / F.nullif(F.col("_sd") / F.sqrt(n), F.lit(0.0)) * F.sqrt((n - 1) / n)).drop("_sd")


def sector_table(df: DataFrame, sector: str, event: Column, fired: Column) -> DataFrame:
    g = df.groupBy(sector).agg(F.count("*").alias("n"), F.count_if(fired).alias("k"), F.count_if(event).alias("m"), F.count_if(fired & event).alias("tp"))
    return g.select(sector, "n", "k", "m", "tp", _div("k", "n").alias("fire_rate"), _div("m", "n").alias("event_rate"),
                    _div("tp", "m").alias("recall"), _div("tp", "k").alias("precision"))


def allocation_selection(df: DataFrame, sector: str, event: Column, fired: Column) -> DataFrame:
    """Recall split into choosing sectors (budgets kept, random inside) and choosing inside sectors."""
    g = sector_table(df, sector, event, fired).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("m").alias("m"), F.sum("tp").alias("tp"), F.sum(F.col("k") * F.col("m") / F.col("n")).alias("_e")
    )
    out = g.select("n", "k", "m", "tp", _div("tp", "m").alias("recall"), _div("k", "n").alias("recall_random"), _div("_e", "m").alias("recall_allocation"))
    return out.withColumn("allocation_effect", F.col("recall_allocation") - F.col("recall_random")).withColumn(
        "selection_effect", F.col("recall") - F.col("recall_allocation"))


def subgroup_metrics(df: DataFrame, flag: Column, event: Column, fired: Column) -> DataFrame:
    """Counts and rates in the flagged rows, the others and all rows."""
    name = F.when(flag, "affected").otherwise("unaffected")
    long = df.select(F.explode(F.array(name, F.lit("all"))).alias("group"), event.alias("_e"), fired.alias("_f"))
    g = long.groupBy("group").agg(F.count("*").alias("n"), F.count_if("_e").alias("n_event"), F.count_if("_f").alias("n_fired"), F.count_if(F.col("_e") & F.col("_f")).alias("_h"))
    return g.withColumn("recall", _div("_h", "n_event")).withColumn("precision", _div("_h", "n_fired")).drop("_h")


def rule_predictions(df: DataFrame, keep: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (row, rule): rules give a class vector, the label is its first maximum."""
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("v")) for n, v in rules.items()])
    long = df.select(*keep, F.explode(cells).alias("_r")).select(*keep, "_r.*")
    return long.withColumn("pred", argmax_label(F.col("v")[0], F.col("v")[1], F.col("v")[2])).drop("v")


def channel_ablation(df: DataFrame, vectors: dict[str, Column], subsets: dict[str, Sequence[str]], logged: Column, truth: str, event: str) -> DataFrame:
    """Metrics of the mean vector of each subset of channels, next to the logged vector's.

    The random recall at the same budget equals the fire rate.
    """
    rules = {"logged": logged, **{n: vector_mean(F.array(*[vectors[a] for a in s])) for n, s in subsets.items()}}
    c = class_counts(rule_predictions(df, [truth], rules), ["rule"], truth, "pred")
    rec, prec, _ = _prf(event)
    return c.select("rule", rec.alias("recall"), prec.alias("precision"), _div(f"pp_{event}", "n").alias("fire_rate"), _div("n_correct", "n").alias("accuracy"))


def aggregation_agreement(df: DataFrame, vectors: dict[str, Column], single: str, logged: Column, truth: str, event: str) -> DataFrame:
    """Mean, confidence-weighted and single-channel rules against the logged label."""
    every = F.array(*vectors.values())
    rules = {"logged": logged, "mean": vector_mean(every), "confidence": vector_weighted_mean(every), "single": vectors[single]}
    d = df.withColumn("_log", argmax_label(logged[0], logged[1], logged[2]))
    long = rule_predictions(d, [truth, "_log"], rules)
    same = long.groupBy("rule").agg(F.count_if(F.col("pred") == F.col("_log")).alias("n_agree"))
    c = class_counts(long, ["rule"], truth, "pred").join(same, "rule")
    rec, prec, _ = _prf(event)
    return c.select("rule", "n", rec.alias("recall"), prec.alias("precision"), F.col(f"pp_{event}").alias("n_fired"), _div("n_correct", "n").alias("accuracy"),
                    "n_agree", _div("n_agree", "n").alias("agreement"))


def pairwise_disagreement(vectors: Sequence[Column]) -> Column:
    """Mean total-variation distance over all pairs of a fixed, short list of vectors."""
    d = [total_variation(a, b) for a, b in combinations(vectors, 2)]
    return sum(d[1:], d[0]) / len(d)


def score_rule(a: str, b: str, c: str) -> dict[str, Column]:
    """Three integer scores in -2..2 to a signal: sum with a disagreement veto and a confidence grade."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    total, spread = x + y + z, F.greatest(x, y, z) - F.least(x, y, z)
    signal = (
        F.when((spread >= 3) & (F.abs(total) < 3), "hold").when(total >= 2, "increase").when(total <= -2, "reduce").otherwise("hold")
    )
    grade = F.when((F.abs(total) >= 4) & (spread <= 2), "high").when((F.abs(total) >= 2) & (spread <= 3), "medium").otherwise("low")
    return {"total_score": total, "decision_score": total / 3.0, "disagreement": spread, "signal": signal, "confidence": grade}
