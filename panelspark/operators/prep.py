"""Feature preparation: fills, winsorising, imputation, label grids, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import CLASSES, band_label, clip
from .ranking import exact_quantiles


def long_form(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keep), list(cols), name, value)


def coalesce_from(df: DataFrame, lookup: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fill missing values of `cols` from a lookup; present values win."""
    right = lookup.select(*on, *[F.col(c).alias(f"_r_{c}") for c in cols])
    out = df.join(right, list(on), "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, f"_r_{c}") if c in df.columns else F.col(f"_r_{c}"))
    return out.drop(*[f"_r_{c}" for c in cols])


def label_grid(df: DataFrame, ret: str, bands: Sequence[float]) -> DataFrame:
    """Class counts and shares of the label under each band; one pass, no copy of the rows."""
    aggs = [F.count(ret).alias("_n")]
    for i, b in enumerate(bands):
        lab = band_label(ret, b)
        aggs += [F.count_if(lab == c).alias(f"_{i}_{c}") for c in CLASSES]
    one = df.agg(*aggs)
    cells = [
        F.struct(F.lit(float(b)).alias("band"), F.lit(c).alias("label"), F.col(f"_{i}_{c}").alias("n"),
                 (F.col(f"_{i}_{c}") / F.nullif(F.col("_n"), F.lit(0))).alias("share"))
        for i, b in enumerate(bands) for c in CLASSES
    ]
    return one.select(F.inline(F.array(*cells)))


def _fitted(df: DataFrame, cols: Sequence[str], fit_where: Column, probs: dict[str, float]) -> Column:
    """One struct of quantiles per column, fitted on some rows, as a scalar for every row.

    All columns share one ranked pass over (feature, value).
    """
    q = exact_quantiles(long_form(df.where(fit_where), [], cols), ["feature"], "value", probs)
    wide = q.agg(*[
        F.max(F.when(F.col("feature") == c, F.col(p))).alias(f"{c}_{p}") for c in cols for p in probs
    ])
    return wide.select(F.struct(*wide.columns)).scalar()


def winsorize(df: DataFrame, cols: Sequence[str], fit_where: Column, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Bound every row to the quantiles of the fitting rows."""
    out = df.withColumn("_q", _fitted(df, cols, fit_where, {"lo": lo, "hi": hi}))
    return out.withColumns({c: clip(c, F.col(f"_q.{c}_lo"), F.col(f"_q.{c}_hi")) for c in cols}).drop("_q")


def impute_median(df: DataFrame, cols: Sequence[str], fit_where: Column) -> DataFrame:
    out = df.withColumn("_q", _fitted(df, cols, fit_where, {"m": 0.5}))
    return out.withColumns({c: F.coalesce(c, F.col(f"_q.{c}_m")) for c in cols}).drop("_q")


def feature_inventory(variation: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Attach a role and a keep/drop reason to the output of `stats.feature_variation`."""
    known = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    role = F.coalesce(known[F.col("feature")], F.lit("unlisted"))
    reason = (
        F.when(F.col("role") != "input", F.concat(F.lit("role: "), F.col("role")))
        .when(F.col("coverage") == 0, "no data")
        .when(~F.col("has_signal"), "constant within periods")
        .otherwise("varies across entities")
    )
    return variation.withColumn("role", role).withColumn("reason", reason).withColumn(
        "keep", (F.col("role") == "input") & F.col("has_signal")
    )
