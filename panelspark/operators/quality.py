"""Data-quality reports and record validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import CLASSES
from .stats import missing_rates


def quality_report(df: DataFrame, key: str, t: str, label: str, expected: Sequence[str] = ()) -> DataFrame:
    """(check, value, note) rows: sizes, range, label counts, missing rates, expected columns."""
    one = df.agg(
        F.count("*").cast("double").alias("rows"), F.countDistinct(key).cast("double").alias("entities"), F.min(t).alias("_lo"), F.max(t).alias("_hi"),
        *[F.count_if(F.col(label) == c).cast("double").alias(f"label_count_{c}") for c in CLASSES])
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = lambda n, v, s: F.struct(F.lit(n).alias("check"), v.alias("value"), s.alias("note"))
    cells = [cell(n, F.col(n), blank) for n in ("rows", "entities", *[f"label_count_{c}" for c in CLASSES])]
    cells += [cell("start", none, F.col("_lo").cast("string")), cell("end", none, F.col("_hi").cast("string"))]
    cells += [cell(f"column_present_{c}", F.lit(float(c in df.columns)), blank) for c in expected]
    rates = missing_rates(df).select(F.concat(F.lit("missing_rate_"), F.col("column")).alias("check"), F.col("missing_rate").alias("value"), blank.alias("note"))
    return one.select(F.inline(F.array(*cells))).unionByName(rates)


def range_outliers(df: DataFrame, key: str, value: str, lo: float, hi: float) -> DataFrame:
    """Rows with a value, and those below and above the bounds, per entity."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count(v).alias("n"), F.count_if(v < lo).alias("n_low"), F.count_if(v > hi).alias("n_high"))


def payments_per_year(df: DataFrame, key: str, t: str, amount: str) -> DataFrame:
    g = df.where(F.col(amount) > 0).groupBy(key, F.year(t).alias("year")).agg(F.count("*").alias("n"))
    return g.groupBy("n").agg(F.count("*").alias("n_entity_years")).withColumnRenamed("n", "payments")


def validate_records(
    df: DataFrame, text_fields: Sequence[str], probs: Sequence[str], enums: dict[str, Sequence[str]], tolerance: float = 0.02,
    lists: Sequence[str] = (),
) -> DataFrame:
    """Add `errors` (joined messages) and `valid`."""
    checks = [F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f"{f} must be a non-empty string")) for f in text_fields]
    for p in probs:
        c = F.col(p)
        checks += [F.when(c.isNull(), F.lit(f"{p} must be numeric")), F.when((c < 0) | (c > 1), F.lit(f"{p} must be between 0 and 1"))]
    total = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
    checks.append(F.when(F.abs(total - 1.0) > tolerance, F.lit(f"probability sum must be within {tolerance} of 1")))
    checks += [F.when(~F.coalesce(F.col(f).isin(*v), F.lit(False)), F.lit(f"{f} must be one of {list(v)}")) for f, v in enums.items()]
    checks += [F.when(F.col(f).isNull(), F.lit(f"{f} must be a list of strings")) for f in lists]
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return df.withColumn("errors", F.array_join(errors, "; ")).withColumn("probability_sum", total).withColumn("valid", F.col("errors") == "")


def truncated_series(df: DataFrame, series: str, ts: str, start: str, slack_days: int = 95) -> DataFrame:
    """First observation of each series and whether it starts too long after the requested day."""
    g = df.groupBy(series).agg(F.min(ts).alias("first"))
    return g.withColumn("truncated", F.datediff("first", F.lit(start).cast("date")) > slack_days)


def input_presence(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Which sources can be read and have at least one row."""
    out = None
    for name, path in paths.items():
        try:
            part = spark.read.parquet(path).limit(1).agg((F.count("*") > 0).alias("non_empty")).select(F.lit(name).alias("source"), F.lit(True).alias("present"), "non_empty")
        except AnalysisException:
            part = spark.range(1).select(F.lit(name).alias("source"), F.lit(False).alias("present"), F.lit(False).alias("non_empty"))
        out = part if out is None else out.unionByName(part)
    return out


def drift_summary(df: DataFrame, split: str, means: Sequence[str], event: Column) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in means], F.avg(event.cast("double")).alias("event_share"))
