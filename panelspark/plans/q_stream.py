"""Stream-shaped queries (ST*): run to the end of the available input, then read the final state."""

from pyspark.sql import functions as F

from ..functions.columns import r6 as R
from ..sources import bind as b, sinks
from ..streaming import incremental as inc
from .registry import query, r6

LOG = "k bigint, t date, seq int, p_r double"


@query("st1_last_wins_stream", f"SELECT k, t, max(seq) AS seq, {r6('arg_max(p_r, seq)')} AS p_r FROM v_log GROUP BY 1, 2")
def st1(spark, sf):
    src, ck = sinks.new_path(spark, "st1-in"), sinks.new_path(spark, "st1-ck")
    # the log arrives in two appended portions, later versions of a key possibly first
    log = b.log_rows(spark, sf).select("k", "t", "seq", "p_r")
    for part in (1, 0):
        log.where(F.col("seq") % 2 == part).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 6).parquet(src)
    inc.last_wins_stream(stream, ["k", "t"], "seq", ck).awaitTermination()
    return inc.current_state(spark, ck).withColumn("p_r", R("p_r"))


@query("st2_ledger_stream", """
 SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS model, count(*) AS n, CAST(sum(floor(value * 10)) AS BIGINT) AS prompt_tokens, CAST(sum(floor(value)) AS BIGINT) AS completion_tokens FROM events GROUP BY 1, 2""")
def st2(spark, sf):
    out, ck = sinks.new_path(spark, "st2-out"), sinks.new_path(spark, "st2-ck")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    ledger = stream.select("event_id", "ts", F.col("event_type").alias("model"), F.floor(F.col("value") * 10).alias("p"), F.floor("value").alias("c"))
    rolled = inc.ledger_stream(ledger, "ts", ["model"], {"prompt_tokens": F.col("p"), "completion_tokens": F.col("c")}, "1 day", "40 days", ["event_id"])
    inc.run_rollup(rolled, out, ck).awaitTermination()
    state = inc.rollup_state(spark, out, ck, "start timestamp, model string, n bigint, prompt_tokens bigint, completion_tokens bigint")
    return state.select(F.to_date("start").alias("day"), "model", "n", "prompt_tokens", "completion_tokens")
