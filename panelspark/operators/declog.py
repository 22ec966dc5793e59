"""Audits of the nested decision log and of ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.columns import argmax_label
from .joins import asof_join
from .ranking import exact_quantiles
from .sets import last_wins


def flat_predictions(records: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Nested log records to one flat row per (date, entity): last version wins, truth joined if given."""
    p = "final_probabilities"
    flat = records.select(
        F.col("decision_date_t").cast("date").alias("decision_date"), "ticker", F.col(f"{p}.increase").alias("prob_increase"),
        F.col(f"{p}.hold").alias("prob_hold"), F.col(f"{p}.reduce").alias("prob_reduce"),
        F.coalesce("model_main", F.lit("unknown")).alias("model_run_id"), "seq",
    )
    out = last_wins(flat, ["decision_date", "ticker"], "seq").withColumn("predicted_label", argmax_label("prob_increase", "prob_hold", "prob_reduce"))
    if truth is None:
        return out.withColumn("true_label", F.lit("unknown"))
    t = truth.select("decision_date", "ticker", "true_label")
    return out.join(t, ["decision_date", "ticker"], "left").withColumn("true_label", F.coalesce("true_label", F.lit("unknown")))


def future_citations(df: DataFrame, facts: str, decided: str) -> DataFrame:
    """Filing dates cited in a decision's facts that lie after the decision."""
    dates = F.flatten(F.transform(F.col(facts), lambda f: tx.cited_dates(f, tx.FILED_DATE)))
    late = F.filter(F.col("_dates"), lambda d: d > F.col(decided))
    return df.withColumn("_dates", dates).withColumn("n_cited", F.size("_dates")).withColumn("n_future", F.size(late)).drop("_dates")


def grounding(facts: Column, rationale: Column, terms: Sequence[str] = tx.RISK_TERMS, percent_counts: bool = False) -> dict[str, Column]:
    """Facts cited, money or percent present, risk terms, and whether the decision is grounded.

    Grounded: at least one fact, and a risk term or money (or, in the wider definition, a percent).
    """
    blob = F.concat(F.array_join(facts, " "), F.lit(" "), F.coalesce(rationale, F.lit("")))
    n, risk = F.size(facts), tx.term_count(blob, terms)
    money, pct = F.regexp_like(blob, F.lit(tx.HAS_MONEY)), F.regexp_like(blob, F.lit(tx.HAS_PERCENT))
    proof = (risk >= 1) | money
    return {"n_facts": n, "has_money": money, "has_pct": pct, "n_risk": risk, "grounded": (n >= 1) & ((proof | pct) if percent_counts else proof)}


def structured_factuality(df: DataFrame, facts: str, keys: Sequence[str], truth: DataFrame) -> DataFrame:
    """Cited `name: value` facts against the true value, within 1% and a small absolute slack.

    `truth` is long: keys, name, true_value. Facts whose name is unknown are not counted.
    """
    cited = df.select(*keys, F.explode(facts).alias("_f")).select(*keys, *[v.alias(n) for n, v in tx.key_value("_f").items()])
    j = cited.where(F.col("value").isNotNull()).join(truth, [*keys, "name"])
    ok = F.abs(F.col("value") - F.col("true_value")) <= 0.01 * (F.abs("true_value") + 1e-6) + 1e-4
    return j.withColumn("ok", ok)


def text_factuality(df: DataFrame, facts: str, source: str, keep: Sequence[str], prefix: int | None = None) -> DataFrame:
    """Money, year and decimal-percent tokens of the facts and whether the source text has them.

    A token counts as present when it occurs in the source, as it is or with both stripped of `$`, `,` and blanks;
    with `prefix`, its first so many stripped characters are enough.
    """
    toks = F.array_distinct(F.flatten(F.transform(
        F.col(facts), lambda f: F.concat(tx.tokens(f, tx.MONEY), tx.tokens(f, tx.YEAR), tx.tokens(f, tx.PERCENT)))))
    bare = lambda c: F.regexp_replace(c, "[$, ]", "")
    d = df.select(*keep, F.col(source).alias("_src"), bare(F.col(source)).alias("_bare"), F.explode(toks).alias("token"))
    ok = F.contains(F.col("_bare"), bare(F.col("token")) if prefix is None else F.substring(bare(F.col("token")), 1, prefix)) | F.contains(F.col("_src"), F.btrim(F.col("token"), F.lit("$ ")))
    return d.withColumn("ok", ok).drop("_src", "_bare")


def restatements(points: DataFrame, facts: DataFrame, key: Sequence[str], t: str) -> DataFrame:
    """Value used at each point against the first-filed value of the same period end.

    `facts` has concept, end_d, filed, val, pos.
    """
    k = [*key, "concept"]
    grid = points.select(*key, t).distinct().join(facts.select(*k).distinct(), list(key))
    used = asof_join(grid, facts, k, t, "filed", ["end_d", "val", "pos"], ["pos"]).where(F.col("val").isNotNull())
    first = facts.groupBy(*k, "end_d").agg(F.min_by(F.struct("filed", "val"), F.struct("filed", "pos")).alias("_f"))
    j = used.join(first, [*k, "end_d"])
    restated = (F.col("filed") != F.col("_f.filed")) & (F.col("val") != F.col("_f.val"))
    rel = F.abs(F.col("val") - F.col("_f.val")) / F.nullif(F.abs(F.col("_f.val")), F.lit(0.0))
    return j.select(*k, t, "end_d", "filed", "val", F.col("_f.filed").alias("first_filed"), F.col("_f.val").alias("first_val"),
                    restated.alias("restated"), F.when(restated, rel).alias("rel_diff"))


def restatement_summary(used: DataFrame) -> DataFrame:
    g = used.agg(
        F.count("*").alias("n_uses"), F.count_if("restated").alias("n_restated"), F.max("rel_diff").alias("max_diff"),
        F.avg(F.when(F.col("rel_diff").isNotNull(), (F.col("rel_diff") > 0.05).cast("double"))).alias("share_gt_5pct"))
    q = exact_quantiles(used.select("rel_diff"), [], "rel_diff", {"median": 0.5, "p90": 0.9}).select(F.struct("*").alias("s")).scalar()
    return g.withColumn("_q", q).select("n_uses", "n_restated", (F.col("n_restated") / F.nullif(F.col("n_uses"), F.lit(0))).alias("share"),
                                        F.col("_q.median").alias("median_diff"), F.col("_q.p90").alias("p90_diff"), "max_diff", "share_gt_5pct")


def raw_restatements(facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many (entity, concept, period end) cells hold more than one value."""
    cells = facts.groupBy(*key, "concept", "end_d").agg((F.min("val") != F.max("val")).alias("_many"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_if("_many").alias("n_restated"))


def fallback_census(df: DataFrame, vectors: dict[str, tuple[str, str, str]], uniform: Sequence[float]) -> DataFrame:
    """Rows whose vector is exactly the no-information vector, per channel."""
    hits = {n: (F.col(v[0]) == uniform[0]) & (F.col(v[1]) == uniform[1]) & (F.col(v[2]) == uniform[2]) for n, v in vectors.items()}
    one = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"_{n}") for n, c in hits.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("channel"), F.col("n"), F.col(f"_{n}").alias("n_fallback"), (F.col(f"_{n}") / F.nullif(F.col("n"), F.lit(0))).alias("share")) for n in hits])))


def wide_ratings(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """(item, dim, rater, score) to one column per rater; items lacking a rater are dropped."""
    w = df.groupBy("item", "dim").agg(*[F.max(F.when(F.col("rater") == r, F.col("score"))).alias(r) for r in raters])
    return w.na.drop(subset=list(raters))


def rater_pairs(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    return wide.select("dim", F.explode(cells).alias("_p")).select("dim", "_p.*")


def agreement(pairs: DataFrame) -> DataFrame:
    """n, means, exact and within-one agreement per dimension and pair."""
    return pairs.groupBy("dim", "pair").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"), F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("within_1"))


def quadratic_kappa(pairs: DataFrame) -> DataFrame:
    """Quadratic-weighted kappa from second moments: observed against independent mean squared distance."""
    g = pairs.groupBy("dim", "pair").agg(
        F.count("*").alias("n"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("_o"),
        F.avg(F.col("a") * F.col("a")).alias("_aa"), F.avg(F.col("b") * F.col("b")).alias("_bb"), F.avg("a").alias("_a"), F.avg("b").alias("_b"))
    e = F.col("_aa") + F.col("_bb") - 2 * F.col("_a") * F.col("_b")
    return g.select("dim", "pair", "n", (1 - F.col("_o") / F.nullif(e, F.lit(0.0))).alias("kappa"))


def krippendorff_alpha(df: DataFrame, n_raters: int) -> DataFrame:
    """Interval alpha per dimension for complete data, from sums and sums of squares (no pairs)."""
    u = df.groupBy("dim", "item").agg(F.count("score").alias("_m"), F.sum("score").alias("_s"), F.sum(F.col("score") * F.col("score")).alias("_q"))
    u = u.where(F.col("_m") == n_raters)
    g = u.groupBy("dim").agg(
        F.count("*").alias("n_items"), F.sum(n_raters * F.col("_q") - F.col("_s") * F.col("_s")).alias("_w"), F.sum("_s").alias("_S"), F.sum("_q").alias("_Q"))
    n = F.col("n_items").cast("double")
    big = n * n_raters
    do = F.col("_w") / (n * (n_raters * (n_raters - 1) / 2.0))
    de = (big * F.col("_Q") - F.col("_S") * F.col("_S")) / (big * (big - 1) / 2.0)
    return g.select("dim", "n_items", (1 - do / F.nullif(de, F.lit(0.0))).alias("alpha"))


def judge_summary(wide: DataFrame, dims: Sequence[str], label: str | None = None) -> DataFrame:
    """Mean score and shares >= 1 and = 2 per dimension, overall and by true label."""
    long = wide.select(F.explode(F.array(F.lit("all"), *([F.col(label)] if label else []))).alias("group"), *dims).unpivot(["group"], list(dims), "dim", "score")
    return long.where(F.col("group").isNotNull()).groupBy("group", "dim").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.avg((F.col("score") >= 1).cast("double")).alias("share_ge_1"),
        F.avg((F.col("score") == 2).cast("double")).alias("share_eq_2"))


def match_texts(slots: DataFrame, entries: DataFrame, text: str, agent: str, version: str) -> DataFrame:
    """Exact-text matches of log slots and cached entries by (agent, version).

    Both sides are counted per text hash first, so copies of one text never multiply in the join.
    """
    h = F.sha2(F.col(text), 256)
    a = slots.groupBy(h.alias("_h"), agent).agg(F.count("*").alias("_s"))
    b = entries.groupBy(h.alias("_h"), version).agg(F.count("*").alias("_e"))
    return a.join(b, "_h").groupBy(agent, version).agg(
        F.sum(F.col("_s") * F.col("_e")).alias("n_matches"), F.sum("_s").alias("n_slots"), F.sum("_e").alias("n_entries"))


def pick_cases(df: DataFrame, keys: Sequence[str], hit: Column, grounded: str, agreement_score: str) -> DataFrame:
    """The most grounded correct hit and the record the channels agree on least (ties by keys)."""
    k = F.struct(*keys)
    neg = F.struct(*[F.col(c) for c in keys])
    one = df.agg(
        F.min_by(k, F.when(hit, F.struct(-F.col(grounded), neg))).alias("grounded_hit"),
        F.min_by(k, F.struct(F.col(agreement_score), neg)).alias("least_agreement"))
    return one.select(F.inline(F.array(
        F.struct(F.lit("grounded_hit").alias("case"), F.col("grounded_hit").alias("_k")), F.struct(F.lit("least_agreement").alias("case"), F.col("least_agreement").alias("_k"))))).select("case", "_k.*")
