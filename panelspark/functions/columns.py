"""Column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Class names in their fixed order, and the ordinal scale.
CLASSES = ("increase", "hold", "reduce")
ORDINAL = {"reduce": 0, "hold": 1, "increase": 2}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """NaN becomes NULL, so that aggregates and joins see one kind of missing value."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def ratio(num, den) -> Column:
    """num / den as double; NULL when the denominator is zero or NULL."""
    den = col(den).cast("double") if not isinstance(den, (int, float)) else F.lit(float(den))
    num = col(num) if not isinstance(num, (int, float)) else F.lit(float(num))
    return num.cast("double") / F.nullif(den, F.lit(0.0))


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison between engines.

    Plain floor arithmetic, so that any IEEE engine gives the same bits; the cut lies just off the exact
    half, where values computed in another order could fall on either side. Never yields negative zero.
    """
    scale = float(10**digits)
    return F.floor(col(c).cast("double") * scale + 0.4999).cast("double") / F.lit(scale)


def month_end(c: str | Column) -> Column:
    return F.last_day(col(c))


def upper_trim(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def zero_pad(c: str | Column, width: int) -> Column:
    """Left-pad an identifier with zeros; longer identifiers are kept whole."""
    s = col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def to_number(c: str | Column) -> Column:
    """Lossy numeric coercion: unparsable text becomes NULL."""
    return col(c).try_cast("double")


def band_label(ret: str | Column, band: float | Column) -> Column:
    """Three-way label. Both sides are strict: exactly +/-band is `hold`."""
    ret, band = col(ret), band if isinstance(band, Column) else F.lit(float(band))
    return (
        F.when(ret.isNull(), F.lit(None).cast("string"))
        .when(ret > band, F.lit("increase"))
        .when(ret < -band, F.lit("reduce"))
        .otherwise(F.lit("hold"))
    )


def argmax_label(inc, hold, red) -> Column:
    """Most probable class; ties go to the first of increase, hold, reduce."""
    inc, hold, red = col(inc), col(hold), col(red)
    return (
        F.when((inc >= hold) & (inc >= red), F.lit("increase"))
        .when(hold >= red, F.lit("hold"))
        .otherwise(F.lit("reduce"))
    )


def prob_vector(inc, hold, red) -> Column:
    return F.array(*[col(c).cast("double") for c in (inc, hold, red)])


def _vector_sum(vectors: Column, i: int, weight) -> Column:
    return F.aggregate(vectors, F.lit(0.0), lambda acc, v: acc + v[i] * weight(v))


def vector_mean(vectors: Column, size: int = 3) -> Column:
    """Component-wise mean of an array of equal-length vectors."""
    return F.array(*[_vector_sum(vectors, i, lambda v: F.lit(1.0)) / F.size(vectors) for i in range(size)])


def vector_weighted_mean(vectors: Column, size: int = 3) -> Column:
    """Mean weighted by each vector's own maximum (its confidence)."""
    total = F.aggregate(vectors, F.lit(0.0), lambda acc, v: acc + F.array_max(v))
    return F.array(*[_vector_sum(vectors, i, F.array_max) / F.nullif(total, F.lit(0.0)) for i in range(size)])


def total_variation(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / 2


def clip(c, lo, hi) -> Column:
    """Bound a value; NULL stays NULL (least/greatest alone would skip it)."""
    c = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def is_close(a, b, rtol: float = 1e-10, atol: float = 1e-10) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def stars(t: str | Column) -> Column:
    """Two-sided normal cuts at 10%, 5% and 1%."""
    a = F.abs(col(t))
    return (
        F.when(a.isNull(), "").when(a >= 2.576, "***").when(a >= 1.96, "**").when(a >= 1.645, "*").otherwise("")
    )


def portable_draw(n: Column, *parts: Column | str | int) -> Column:
    """Integer in [0, n) that any SQL engine with md5 reproduces from the same parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} found in {df.columns}")


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Optional columns that this frame really has, in the order asked for."""
    return [c for c in cols if c in df.columns]


def t_p_value(t: str | Column, dof: str | Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom, by its finite cosine series.

    The series has dof / 2 terms. NULL without t or with less than one degree.
    """
    t, v = F.abs(col(t).cast("double")), col(dof).cast("int")
    angle = F.atan(t / F.sqrt(v))
    cos2 = v / (v + t * t)
    odd = v % 2
    terms = F.floor((v - odd) / 2).cast("int")
    start = F.struct(F.when(odd == 1, F.sqrt(cos2)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def add(a, k):
        return F.struct((a["term"] * cos2 * (2 * k + odd - 1) / (2 * k + odd)).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    part = F.sin(angle) * F.aggregate(steps, start, add)["sum"]
    inside = F.when(odd == 1, (angle + part) * (2 / math.pi)).otherwise(part)
    return F.when((v > 0) & t.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def t_p_value_sql(t: str, dof: str) -> str:
    """The same in SQL, each term by itself."""
    v, odd = f"CAST({dof} AS BIGINT)", f"(CAST({dof} AS BIGINT) % 2)"
    angle, cos2 = f"atan(abs({t}) / sqrt({v}))", f"({v} / ({v} + ({t}) * ({t})))"
    ratio = f"coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j + {odd} - 1) / (2 * j + {odd}))), 1)"
    total = f"coalesce(list_sum(list_transform(range(({v} - {odd}) // 2), lambda k: CASE WHEN {odd} = 1 THEN sqrt({cos2}) ELSE 1 END * power({cos2}, k) * {ratio})), 0)"
    part = f"sin({angle}) * {total}"
    return f"(1 - CASE WHEN {odd} = 1 THEN ({angle} + {part}) * 2 / pi() ELSE {part} END)"
