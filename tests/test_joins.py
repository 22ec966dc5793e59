import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import documents as dc, joins, sets

D = dt.date


def test_asof_is_inclusive_left_preserving_and_breaks_ties(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 10), 1), ("a", D(2020, 1, 10), 2), ("a", D(2019, 1, 1), 3), ("b", D(2020, 1, 1), 4), ("a", None, 5)], "k string, t date, id int")
    right = spark.createDataFrame([("a", D(2020, 1, 10), 7.0, 1), ("a", D(2020, 1, 10), None, 2), ("a", D(2020, 1, 11), 9.0, 3)], "k string, f date, v double, pos int")
    got = {r.id: (r.f, r.v) for r in joins.asof_join(left, right, ["k"], "t", "f", ["v"], ["pos"]).collect()}
    # the last element of the day wins although its value is NULL; it still hides older ones
    assert got == {1: (D(2020, 1, 10), None), 2: (D(2020, 1, 10), None), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_asof_against_brute_force_with_one_hot_key(spark):
    rng = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"
    left = [(key(), day(), i) for i in range(400)]
    right = [(key(), day(), float(i), i) for i in range(400)]
    got = {r.id: r.v for r in joins.asof_join(
        spark.createDataFrame(left, "k string, t date, id int"), spark.createDataFrame(right, "k string, f date, v double, pos int"), ["k"], "t", "f", ["v"], ["pos"]).collect()}
    for k, t, i in left:
        best = [(f, pos, v) for kk, f, v, pos in right if kk == k and f <= t]
        assert got[i] == (max(best)[2] if best else None)


@pytest.mark.parametrize("back, ahead", [(6, 0), (0, 12)])
def test_interval_join_bounds(spark, back, ahead):
    t = D(2020, 6, 30)
    days = [D(2019, 12, 29), D(2019, 12, 30), D(2020, 6, 30), D(2020, 7, 1), D(2021, 6, 30), D(2021, 7, 1)]
    left = spark.createDataFrame([("a", t)], "k string, t date")
    right = spark.createDataFrame([("a", d) for d in days], "k string, f date")
    got = sorted(r.f for r in joins.interval_join(left, right, ["k"], "t", "f", months_back=back, months_ahead=ahead).collect())
    assert got == ([days[1], days[2]] if back else [days[3], days[4]])


def test_join_1to1_fails_on_duplicates_and_losses(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    ok = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert joins.join_1to1(a, ok, ["k"]).count() == 2
    for bad in ([(1, 10), (1, 11), (2, 20)], [(1, 10)], [(1, 1), (2, 2), (3, 3)]):
        with pytest.raises(Exception, match="one-to-one"):
            joins.join_1to1(a, spark.createDataFrame(bad, "k int, w int"), ["k"]).collect()


def test_enrich_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        joins.enrich(a, [(spark.createDataFrame([(1, 2), (1, 3)], "k int, w int"), ["k"])]).collect()


def test_previous_record_inside_and_across_days(spark):
    rows = [("a", D(2020, 1, 1), 3), ("a", D(2020, 1, 1), 1), ("a", D(2020, 1, 5), 2), ("b", D(2020, 1, 2), 9)]
    df = spark.createDataFrame(rows, "k string, d date, id int")
    got = {r.id: r.prev_id for r in joins.previous_record(df, ["k"], "d", "id", ["d"]).collect()}
    assert got == {1: None, 3: 1, 2: 3, 9: None}


def test_newest_keeps_the_newest_in_ascending_order(spark):
    t = D(2020, 6, 30)
    hits = spark.createDataFrame([("a", t, D(2020, 1, i), i) for i in range(1, 8)], "k string, t date, f date, id int")
    got = [(r.pos, r.id) for r in dc.newest(hits, ["k", "t"], "f", "id", 5).orderBy("pos").collect()]
    assert got == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7)]


def test_recency_audit_counts_what_the_old_cut_dropped(spark):
    t = D(2020, 6, 30)
    docs = spark.createDataFrame([("a", D(2020, 2, i)) for i in range(1, 8)], "k string, f date")
    pts = spark.createDataFrame([("a", t), ("b", t)], "k string, t date")
    got = {r.k: r for r in dc.recency_audit(pts, docs, "k", "t", "f", 6, 5).collect()}
    assert (got["a"].n_window, got["a"].n_kept, got["a"].n_dropped) == (7, 5, 2)
    assert got["a"].dropped_dates == "2020-02-06;2020-02-07" and got["a"].affected
    assert (got["b"].n_window, got["b"].dropped_dates, got["b"].affected) == (0, "", False)


def test_forward_totals_exclude_the_start_day(spark):
    pts = spark.createDataFrame([("a", D(2020, 1, 31)), ("a", D(2020, 1, 31)), ("b", D(2020, 1, 1))], "k string, t date")
    out = spark.createDataFrame([("a", D(2020, 1, 31), 1), ("a", D(2020, 2, 1), 2), ("a", D(2021, 1, 31), 4), ("a", D(2021, 2, 1), 8)], "k string, d date, v int")
    got = sorted((r.k, r.s) for r in dc.forward_totals(pts, out, ["k"], "t", "d", {"s": F.col("v")}, 12).collect())
    assert got == [("a", 6), ("a", 6), ("b", 0)]


def test_attach_drops_missing_text_before_the_newest_cut(spark):
    t = D(2020, 6, 30)
    docs = [("a", "E", D(2020, 6, i), i, None if i == 7 else f"e{i}") for i in range(1, 8)]
    docs += [("a", "A", D(2019, 1, 1), 100, "annual one"), ("a", "A", D(2020, 7, 1), 101, "later"), ("a", "Q", D(2020, 6, 30), 102, "same day")]
    d = spark.createDataFrame(docs, "k string, form string, filed date, doc_id bigint, text string")
    r = dc.attach_documents(spark.createDataFrame([("a", t)], "k string, t date"), d, "k", "t", "A", "Q", "E", F.col("text")).first()
    assert (r.annual_id, r.quarterly_id, r.n_events) == (100, 102, 5)
    assert r.text.split("\n") == ["annual one", "same day", "e2", "e3", "e4", "e5", "e6"]


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "z")], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in sets.last_wins(df, ["k"], "seq").collect()) == [(1, None), (2, "z")]
    assert sorted((r.k, r.v) for r in sets.first_wins(df, ["k"], "seq").collect()) == [(1, "a"), (2, "z")]


def test_asof_ignores_undated_facts_and_needs_an_order(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 10))], "k string, t date")
    right = spark.createDataFrame([("a", None, 5.0, 1)], "k string, f date, v double, pos int")
    assert joins.asof_join(left, right, ["k"], "t", "f", ["v"], ["pos"]).first().v is None
    with pytest.raises(ValueError):
        joins.asof_join(left, right, ["k"], "t", "f", ["v"], [])


def test_interval_join_left_keeps_equal_rows_once_and_takes_both_sides(spark):
    t = D(2020, 6, 30)
    left = spark.createDataFrame([("a", t), ("a", t), ("b", t)], "k string, t date")
    right = spark.createDataFrame([("a", D(2020, 5, 1)), ("a", D(2020, 7, 1))], "k string, f date")
    one = joins.interval_join(left, right, ["k"], "t", "f", months_back=2, how="left").collect()
    assert sorted((r.k, str(r.f)) for r in one) == [("a", "2020-05-01"), ("a", "2020-05-01"), ("b", "None")]
    both = joins.interval_join(left, right, ["k"], "t", "f", months_back=2, months_ahead=2).collect()
    assert sorted(str(r.f) for r in both) == ["2020-05-01", "2020-05-01", "2020-07-01", "2020-07-01"]
