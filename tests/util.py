"""Shared helpers of the tests and the check tool."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def make_spark() -> SparkSession:
    shared = tempfile.mkdtemp(prefix="tests-")  # one machine runs all of it
    spark = (
        SparkSession.builder.master(os.environ.get("SPARK_TEST_MASTER", "local[8]"))
        .appName("panel-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call sites kept for each column
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.checkpoint.dir", f"{shared}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return repr(v) if isinstance(v, float) else v


def compare(df, rows, cur) -> str:
    """Same columns, same kinds of values, same rows in any order."""
    cols = sorted(df.columns)
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    if cols != sorted(ocols):
        return f"columns differ: {cols} vs {sorted(ocols)}"
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in rows), key=str)
    pos = [ocols.index(c) for c in cols]
    b = sorted((tuple(_norm(r[i]) for i in pos) for r in orows), key=str)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} vs {len(b)}"
    if not a:
        return "empty result"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        d = [(c, x, y) for c, x, y in zip(cols, *diff[0]) if x != y]
        return f"{len(diff)} of {len(a)} rows differ; first {diff[0][0]}: {d}"
    return f"ok ({len(a)} rows)"
