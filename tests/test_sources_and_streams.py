import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as c
from panelspark.operators import declog as dl, quality as ql
from panelspark.sources import readers, sinks
from panelspark.streaming import incremental as inc


def test_log_skips_blank_and_reports_malformed_lines(spark, tmp_path):
    rec = lambda seq, **kw: {"decision_date_t": "2024-01-31", "ticker": "A", "final_probabilities": {"increase": 0.2, "hold": 0.4, "reduce": 0.4}, "seq": seq, **kw}
    lines = [json.dumps(rec(1, model_main="m")), "", "   ", '{"broken": ', json.dumps(rec(2))]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_decision_log(spark, str(tmp_path))
    assert good.count() == 2 and [r.line for r in bad.collect()] == ['{"broken": ']
    r = dl.flat_predictions(good).collect()
    assert len(r) == 1 and (r[0].seq, r[0].predicted_label, r[0].true_label, r[0].model_run_id) == (2, "hold", "unknown", "unknown")
    assert good.where("seq = 1").first().agent_outputs is None


def test_empty_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("")
    good, bad = readers.read_decision_log(spark, str(tmp_path))
    assert good.count() == 0 and bad.count() == 0 and dl.flat_predictions(good).count() == 0


def test_documents_from_a_folder(spark, tmp_path):
    (tmp_path / "abc_8-K_2024-03-01_000-1.txt").write_text("line one\nline two")
    (tmp_path / "notes.txt").write_text("ignored")
    r = readers.read_documents(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].entity, r[0].form, r[0].filed, r[0].accession, r[0].text) == ("ABC", "8-K", dt.date(2024, 3, 1), "000-1", "line one\nline two")


def test_csv_aliases_and_missing_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,Date,Adj Close\nA,2024-01-02,1.5\n")
    df = readers.read_table(spark, str(tmp_path), "ticker string, Date date, `Adj Close` double", {"adj_close": ["Adj Close", "Close"], "date": ["Date"]}, "csv", header=True)
    assert df.first().adj_close == 1.5 and df.columns == ["ticker", "date", "adj_close"]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), "ticker string", {"price": ["Close"]}, "csv")


def test_facts_keep_positions_and_annual_forms(spark):
    from pyspark.sql.types import _parse_datatype_string as schema

    s = schema("k string, facts map<string, map<string, array<struct<filed: date, val: double, form: string, fp: string>>>>")
    d = dt.date(2020, 1, 1)
    rows = [("a", {"Assets": {"USD": [(d, 1.0, "10-K", "FY"), (d, 2.0, "10-Q", "Q1"), (d, 3.0, "8-K", "FY"), (d, 4.0, None, None)]}, "Other": {"USD": [(d, 9.0, "10-K", "FY")]}})]
    got = sorted((r.pos, r.val) for r in readers.flatten_facts(spark.createDataFrame(rows, s), "facts", ["k"], ["Assets"]).collect())
    assert got == [(0, 1.0), (2, 3.0)]


def test_split_bounds_and_nan(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 2, 29), float("nan")), (dt.date(2021, 1, 31), 2.0)], "t date, x double")
    s = sinks.time_split(df, "t", {"a": ("2020-01-01", "2020-01-31"), "b": ("2020-02-01", "2020-12-31")})
    assert [(r.split) for r in s.orderBy("t").collect()] == ["a", "b"]
    assert [r.x for r in s.orderBy("t").select(c.clean("x").alias("x")).collect()] == [1.0, None]


def test_documents_are_written_and_scanned_back(spark, tmp_path):
    at = str(tmp_path / "docs")
    rows = [("ab_10-K_2024-02-28_7.txt", "one\n\ntwo\n"), ("ab_8-K_2024-02-29_8.txt", None), ("nonsense.txt", "é" * 70_000)]
    readers.write_documents(spark.createDataFrame(rows, "name string, body string"), at, "name", "body")
    (tmp_path / "docs" / "CD_10-Q_2023-01-31_9.txt").write_text("flat")
    (tmp_path / "docs" / "readme.md").write_text("other")
    got = {r.file_name: r for r in readers.read_documents(spark, at, unreadable=True).collect()}
    one = got["ab_10-K_2024-02-28_7.txt"]
    assert (one.text, one.entity, one.form, one.accession, one.n_bytes, one.readable) == ("one\n\ntwo\n\n", "AB", "10-K", "7", 10, True)
    assert got["ab_8-K_2024-02-29_8.txt"].text == "\n" and got["nonsense.txt"].text == "é" * 70_000 + "\n"
    assert {k for k, r in got.items() if not r.readable} == {"nonsense.txt", ""} and got["CD_10-Q_2023-01-31_9.txt"].text == "flat"
    assert {r.accession for r in readers.read_documents(spark, at).collect()} == {"7", "8", "9"}


def test_documents_are_plain_files_in_few_folders(spark, tmp_path):
    """A folder, a hidden checksum and two forked commands a document took most of the time."""
    at = tmp_path / "docs"
    names = [f"ab_8-K_2024-02-29_{i}.txt" for i in range(600)] + ["a b_8-K_2024-02-29_9:1.txt", "a/c_8-K_2024-02-29_92.txt"]
    readers.write_documents(spark.createDataFrame([(n, n) for n in names], "name string, body string").repartition(3), f"file://{at}", "name", "body")
    found = [p for p in at.rglob("*") if p.is_file()]
    assert {p.name for p in found} == {n.replace("/", "%2F").replace(":", "%3A") for n in names} and len(found) == len(names)
    assert len([p for p in at.rglob("*") if p.is_dir()]) == readers.FOLDERS
    assert {r.text for r in readers.read_documents(spark, str(at)).collect()} == {f"{n}\n" for n in names}


def test_documents_where_arrow_has_no_file_system(spark, tmp_path):
    at = tmp_path / "docs"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./at", f"file://{tmp_path}")
    names = [f"ab_8-K_2024-02-29_{i}.txt" for i in range(3)]
    readers.write_documents(spark.createDataFrame([(n, n) for n in names], "name string, body string"), "viewfs://docs/at/docs", "name", "body")
    assert {(r.file_name, r.text) for r in readers.read_documents(spark, str(at)).collect()} == {(n, f"{n}\n") for n in names}


def test_names_of_documents_stay_out_of_the_driver(spark, tmp_path):
    """Spark's reader held name, size and time of every file on the driver."""
    at = tmp_path / "docs"
    names = [f"ab_8-K_2024-02-29_{i}.txt" for i in range(600)]
    readers.write_documents(spark.createDataFrame([(n, n) for n in names], "name string, body string"), str(at), "name", "body")
    for p in (".hidden.txt", "_SUCCESS", "_tmp/ab_8-K_2024-02-29_x.txt", "deep/er/a+b c%3A_8-K_2024-02-29_700.txt", "empty/ab_8-K_2024-02-29_701.txt"):
        (at / p).parent.mkdir(parents=True, exist_ok=True)
        (at / p).write_bytes(b"" if "empty" in p else b"caf\xe9")
    df = readers.read_documents(spark, str(at))
    assert len(df.inputFiles()) < 100
    got = {r.file_name: r for r in df.select("*", F.encode("text", "utf-8").alias("raw"), F.unix_millis("modified").alias("ms")).collect()}
    assert set(got) == {*names, "a+b c%3A_8-K_2024-02-29_700.txt", "ab_8-K_2024-02-29_701.txt"}
    odd = got["a+b c%3A_8-K_2024-02-29_700.txt"]
    assert (odd.entity, odd.n_bytes, odd.ms) == ("A+B C%3A", 4, (at / "deep/er/a+b c%3A_8-K_2024-02-29_700.txt").stat().st_mtime_ns // 1_000_000)
    assert got["ab_8-K_2024-02-29_701.txt"].text == "" and df.where("accession = '700'").select(F.hex(F.col("text").cast("binary"))).first()[0] == "636166E9"


def test_patterns_and_stores_of_spark_alone_are_read_by_it(spark, tmp_path):
    at = tmp_path / "docs"
    at.mkdir()
    for i in range(2):
        (at / f"a+b c%3A_8-K_2024-02-29_{i}.txt").write_text(str(i))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./at", f"file://{tmp_path}")
    for path in (str(at), f"{at}/*_0.txt", "viewfs://only/at/docs"):
        got = {(r.file_name, r.text, r.entity) for r in readers.read_documents(spark, path).collect()}
        assert got == {(f"a+b c%3A_8-K_2024-02-29_{i}.txt", str(i), "A+B C%3A") for i in range(1 if "*" in path else 2)}


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class _Session:
    """A session whose setting is given or missing; the context is the real one."""

    def __init__(self, spark, value):
        self.conf, self.sparkContext = _Conf(value), spark.sparkContext


def test_settle_uses_the_named_folder(spark):
    assert sinks.settle(spark.range(5)).count() == 5
    assert sinks.shared_dir(_Session(spark, "hdfs://shared/x")) == "hdfs://shared/x"
    unset = sinks.shared_dir(_Session(spark, None))
    assert unset and unset == sinks.shared_dir(_Session(spark, None))


def test_record_validation(spark):
    rows = [("a", 0.2, 0.4, 0.4, "hold"), (" ", 0.2, 0.4, 0.4, "hold"), ("a", 1.2, None, 0.4, "buy"), ("a", 0.5, 0.5, 0.5, "hold")]
    out = ql.validate_records(spark.createDataFrame(rows, "n string, i double, h double, r double, s string"), ["n"], ["i", "h", "r"], {"s": c.CLASSES}).collect()
    assert [r.valid for r in out] == [True, False, False, False]
    assert out[2].errors == "i must be between 0 and 1; h must be numeric; s must be one of ['increase', 'hold', 'reduce']"


def _add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_last_wins_stream_survives_restarts_and_repeats(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "k bigint, seq int, v double"
    seen = []
    changed = lambda df, i: seen.append(sorted((r.k, r.v) for r in df.where("k > 0").collect()))
    run = lambda: inc.last_wins_stream(spark.readStream.schema(schema).parquet(src), ["k"], "seq", ck, changed).awaitTermination()
    state = lambda: {r.k: (r.seq, r.v) for r in inc.current_state(spark, ck).collect()}
    _add(spark, src, [(1, 2, 2.0), (2, 1, 9.0)], schema)
    run()
    _add(spark, src, [(1, 1, 1.0), (2, 3, 7.0), (3, 1, 5.0), (None, 1, None)], schema)
    run()
    want = {1: (2, 2.0), 2: (3, 7.0), 3: (1, 5.0), None: (1, None)}
    assert state() == want
    run()  # nothing new: nothing changes
    _add(spark, src, [(2, 3, 7.0), (1, 2, 2.0)], schema)  # rows that came before
    run()
    assert state() == want and seen[0] == [(1, 2.0), (2, 9.0)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != inc.ROCKSDB


def test_last_wins_state_grows_with_keys_not_with_batches(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "k bigint, seq int, v double"
    for i in range(6):
        _add(spark, src, [(k, i, float(i)) for k in range(4)], schema)
        inc.last_wins_stream(spark.readStream.schema(schema).parquet(src), ["k"], "seq", ck).awaitTermination()
    assert spark.read.format("statestore").load(ck).count() == 4
    assert {r.v for r in inc.current_state(spark, ck).collect()} == {5.0}


def test_a_batch_that_died_is_run_again_from_the_state_before_it(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "k bigint, seq int, v double"

    def die(df, i):
        df.count()
        raise RuntimeError("lost")

    run = lambda f: inc.last_wins_stream(spark.readStream.schema(schema).parquet(src), ["k"], "seq", ck, f).awaitTermination()
    _add(spark, src, [(1, 5, 5.0)], schema)
    run(lambda df, i: df.count())
    _add(spark, src, [(1, 6, 6.0), (2, 1, 1.0)], schema)
    with pytest.raises(Exception, match="lost"):
        run(die)
    run(lambda df, i: df.count())
    assert {r.k: r.v for r in inc.current_state(spark, ck).collect()} == {1: 6.0, 2: 1.0}


def _rollup(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "id bigint, ts timestamp, model string, p bigint, x double"

    def add(rows):
        _add(spark, src, [(i, dt.datetime(2024, 1, *t), m, p, p / 2) for i, t, m, p in rows], schema)
        rolled = inc.ledger_stream(spark.readStream.schema(schema).parquet(src), "ts", ["model"], {"p": F.col("p"), "x": F.col("x")},
                                   "1 day", "10 days", ["id"])
        inc.run_rollup(rolled, out, ck).awaitTermination()
        state = inc.rollup_state(spark, out, ck, "start timestamp, model string, n bigint, p bigint, x double")
        return sorted((r.start.day, r.model, r.n, r.p, r.x) for r in state.collect())

    return add, lambda: spark.read.format("statestore").option("operatorId", 0).load(ck).count()


def test_ledger_stream_counts_late_rows_and_no_row_twice(spark, tmp_path):
    add, _ = _rollup(spark, tmp_path)
    assert add([(1, (1, 1), "m", 1), (2, (3,), "m", 2)]) == [(1, "m", 1, 1, 0.5), (3, "m", 1, 2, 1.0)]
    late = add([(3, (1, 9), "m", 5), (2, (3,), "m", 2), (2, (3, 4), "m", 2)])
    assert late == [(1, "m", 2, 6, 3.0), (3, "m", 1, 2, 1.0)]


def test_closed_windows_leave_the_state_and_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    add, _ = _rollup(spark, tmp_path)
    add([(1, (1, 1), "m", 1), (2, (30,), "m", 2)])
    got = add([(3, (1, 2), "m", 100), (4, (25,), "z", 4)])
    assert got == [(1, "m", 1, 1, 0.5), (25, "z", 1, 4, 2.0), (30, "m", 1, 2, 1.0)]
