"""Hand cases for the generic operators: nulls, ties, open intervals,
skewed keys, zero divisors, 29 February, and the worked numbers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as X
from tallyspark.functions.params import END_OF_TIME, filter_in, filter_nvl, filter_optional
from tallyspark.operators import effective as E
from tallyspark.operators import joins as J
from tallyspark.operators import quality as Q
from tallyspark.operators import windows as W
from tallyspark.operators import aging
from tallyspark.operators.aging import AR_FIVE, bucket_totals
from tallyspark.operators.movements import union_branches


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_running_total_chunked_equals_window_on_a_hot_key(spark):
    # key 1 holds most of the rows (a hot customer)
    data = [(1 if i % 10 else 2, dt.date(2020, 1, 1) + dt.timedelta(days=i % 37), i, Decimal(i % 13) - 6)
            for i in range(3000)]
    df = spark.createDataFrame(data, "k int, d date, id int, v decimal(18,2)")
    chunked = W.running_total(df, ["k"], ["d", "id"], "v", "rt", chunk="d")
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("rt", F.sum("v").over(w))
    assert rows(chunked, "k", "id", "rt") == rows(plain, "k", "id", "rt")


def test_running_total_range_ties_share(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 5), (1, dt.date(2020, 1, 1), 7), (1, dt.date(2020, 1, 2), 1)],
                               "k int, d date, v int")
    out = W.running_total_range(df, ["k"], "d", "v", "rt")
    assert rows(out, "d", "v", "rt") == [(dt.date(2020, 1, 1), 5, 12), (dt.date(2020, 1, 1), 7, 12),
                                         (dt.date(2020, 1, 2), 1, 13)]


def test_partition_and_grand_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 10)], "k string, v int")
    out = W.grand_total(W.partition_total(df, ["k"], "v", "kt"), "v", "gt")
    assert rows(out, "k", "v", "kt", "gt") == [("a", 1, 3, 13), ("a", 2, 3, 13), ("b", 10, 10, 13)]


def test_serial_number_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).withColumn("o", (F.col("id") * 7919) % 1000).repartition(7)
    out = W.serial_number(df, ["o"]).collect()
    pairs = sorted((r["o"], r["serial_no"]) for r in out)
    assert [s for _, s in pairs] == list(range(1, 1001))


def test_keep_first_ties_and_rows_at_max(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 3, "z"), (2, 1, "w")], "k int, v int, t string")
    assert len(W.keep_ties(df, ["k"], "v").filter("k = 1").collect()) == 2
    first = W.keep_first(df, ["k"], [F.col("v").desc(), F.col("t")])
    assert rows(first, "k", "t") == [(1, "x"), (2, "w")]


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    sub_plain = spark.createDataFrame([(2,)], "b int")
    sub_null = spark.createDataFrame([(2,), (None,)], "b int")
    empty = spark.createDataFrame([], "b int")
    assert rows(J.not_in(left, "a", sub_plain, "b"), "a") == [(1,)]
    assert J.not_in(left, "a", sub_null, "b").count() == 0
    assert J.not_in(left, "a", empty, "b").count() == 3


def test_semi_or_and_override_union(spark):
    df = spark.createDataFrame([(1, 10), (2, 500), (3, 20)], "k int, amt int")
    other = spark.createDataFrame([(3,)], "k int")
    assert rows(J.semi_or(df, other, ["k"], F.col("amt") > 100), "k") == [(2,), (3,)]
    l2 = spark.createDataFrame([(1, "L2")], "k int, s string")
    l1 = spark.createDataFrame([(1, "L1"), (2, "L1")], "k int, s string")
    assert rows(J.override_union(l2, l1, ["k"]), "k", "s") == [(1, "L2"), (2, "L1")]


def test_effective_dating_open_end_and_rehire(spark):
    dim = spark.createDataFrame([
        (1, dt.date(2020, 1, 1), dt.date(2020, 6, 30), 100),
        (1, dt.date(2020, 7, 1), END_OF_TIME, 200),
        (2, dt.date(2019, 1, 1), None, 300),            # NULL end = open
    ], "person_id int, eff_start date, eff_end date, salary int")
    fact = spark.createDataFrame([(1, dt.date(2020, 3, 1)), (1, dt.date(2021, 1, 1)), (2, dt.date(2030, 1, 1)),
                                  (3, dt.date(2020, 1, 1))], "person_id int, d date")
    out = E.join_effective(fact, dim, ["person_id"], "d")
    assert rows(out, "person_id", "d", "salary") == [
        (1, dt.date(2020, 3, 1), 100), (1, dt.date(2021, 1, 1), 200), (2, dt.date(2030, 1, 1), 300),
        (3, dt.date(2020, 1, 1), None)]
    at = E.join_as_of(fact.select("person_id").distinct(), dim, ["person_id"], dt.date(2020, 8, 1))
    assert rows(at, "person_id", "salary") == [(1, 200), (2, 300), (3, None)]
    # rehire: the later service period is the latest start not in the future
    svc = spark.createDataFrame([(1, dt.date(2010, 1, 1)), (1, dt.date(2018, 5, 1)), (1, dt.date(2031, 1, 1))],
                                "person_id int, date_start date")
    latest = E.latest_at_or_before(svc, ["person_id"], "date_start", dt.date(2020, 1, 1))
    assert rows(latest, "date_start") == [(dt.date(2018, 5, 1),)]


def test_latest_pair_may_match_nothing(spark):
    df = spark.createDataFrame([(1, 2, 1), (1, 1, 9)], "k int, version int, status int")
    assert E.latest_pair(df, ["k"], "version", "status").count() == 0


def test_anti_interval_and_overlap(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in range(1, 8)], "p int, day date")
    leave = spark.createDataFrame([(1, dt.date(2024, 1, 2), dt.date(2024, 1, 4))], "p int, s date, e date")
    left = E.anti_interval(days, leave, "p", "day", "s", "e")
    assert [r[0].day for r in rows(left, "day")] == [1, 5, 6, 7]
    iv = spark.createDataFrame([(dt.date(2024, 1, 10), dt.date(2024, 1, 20))], "s date, e date")
    assert iv.filter(E.overlaps("s", "e", dt.date(2024, 1, 1), dt.date(2024, 1, 9))).count() == 0
    assert iv.filter(E.overlaps("s", "e", dt.date(2024, 1, 20), dt.date(2024, 1, 25))).count() == 1


def test_exact_rounding_and_zero_guard(spark):
    df = spark.createDataFrame([(107, 40), (-107, 40), (1, 0), (1, 3)], "a long, b long")
    out = df.select(X.div_round("a", "b").alias("r"), X.percent("a", "b").alias("p")).collect()
    assert [r["r"] for r in out] == [Decimal("2.68"), Decimal("-2.68"), None, Decimal("0.33")]
    assert out[3]["p"] == Decimal("33.33")


def test_oracle_scalar_semantics(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("B", None, None)], "c string, n int, s string")
    out = df.select(
        X.decode("c", [(None, "was null"), ("B", "bee")], "other").alias("dec"),
        X.greatest_strict("n", F.lit(5)).alias("g"),
        X.concat_oracle("c", F.lit("-"), "s").alias("cc")).collect()
    assert [(r["dec"], r["g"], r["cc"]) for r in out] == [("was null", 5, "-a"), ("bee", None, "B-")]


def test_plan_year_for_29_february_hire(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 1), dt.date(2020, 2, 29)), (dt.date(2021, 2, 27), dt.date(2020, 2, 29))],
                               "as_of date, hire date")
    out = df.select(X.plan_year_start("as_of", "hire").alias("py")).collect()
    assert [r["py"] for r in out] == [dt.date(2021, 2, 28), dt.date(2020, 2, 29)]


def test_parameter_filter_modes(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, c string")
    assert filter_in(df, "c", "All").count() == 3
    assert filter_in(df, "c", ["x", "y"]).count() == 2
    assert filter_optional(df, "c", None).count() == 3     # F3 keeps NULL rows
    assert filter_nvl(df, "c", None).count() == 2          # F4 drops them


def test_worked_numbers_signed_movements(spark):
    inv = spark.createDataFrame([(1, Decimal("15000.00")), (2, Decimal("100.00"))], "doc int, amount decimal(18,2)")
    pay = spark.createDataFrame([(1, Decimal("-10000.00")), (2, Decimal("-100.00"))], "doc int, amount decimal(18,2)")
    fact = union_branches([("INVOICE", 1, inv), ("RECEIPT", 2, pay)])
    bal = fact.groupBy("doc").agg(F.sum("amount").alias("b"))
    assert rows(bal, "doc", "b") == [(1, Decimal("5000.00")), (2, Decimal("0.00"))]


def test_aging_buckets_sum_to_total(spark):
    df = spark.createDataFrame([(1, d, Decimal(10)) for d in (-5, 0, 1, 30, 31, 60, 61, 90, 91, 400)],
                               "c int, days int, amt decimal(18,2)")
    out = bucket_totals(df, ["c"], "days", "amt", AR_FIVE).collect()[0]
    assert sum(out[c] for c in AR_FIVE.columns) == out["total_due"] == Decimal(100)
    assert out["current_amt"] == Decimal(20) and out["b90_plus"] == Decimal(20)


@pytest.mark.parametrize("bset,last_days", [
    (aging.AR_FIVE, (0, 30, 60, 90)),
    (aging.AR_SEVEN, (0, 30, 60, 90, 180, 360)),
    (aging.AR_EIGHT, (-1, 30, 60, 90, 120, 180, 360)),
    (aging.AR_SIX_NOT_DUE, (-1, 30, 60, 90, 120)),
    (aging.UNAPPLIED_EIGHT, (0, 30, 60, 90, 120, 180, 365)),
    (aging.AP_FOURTEEN, (-1, 7, 15, 30, 45, 60, 75, 90, 120, 150, 180, 360, 720)),
])
def test_bucket_edges(spark, bset, last_days):
    """The last day of each bucket and the day after it."""
    days = sorted({x for d in last_days for x in (d, d + 1)})
    df = spark.createDataFrame([(d,) for d in days], "days int")
    got = {r.days: r.label for r in df.select("days", bset.label("days").alias("label")).collect()}
    names = [b[0] for b in bset.buckets]
    assert got == {d: names[sum(d > last for last in last_days)] for d in days}


def test_widened_first_bucket(spark):
    """Only the lower edge of the first bucket moves; earlier days have none."""
    df = spark.createDataFrame([(d,) for d in (-61, -60, -1, 0, 30, 31, 120, 121)], "days int")
    for widen, first in ((60, ["0-30"] * 4), (0, [None, None, "0-30", "0-30"])):
        got = [r.label for r in df.select(aging.ar_widened(widen).label("days").alias("label")).collect()]
        assert got == [None, *first[:3], "0-30", "31-60", "91-120", ">120"]


def test_service_years_to_two_decimals(spark):
    from datetime import date
    from tallyspark.functions.scalars import service_years
    df = spark.createDataFrame([(date(1999, 12, 31),), (date(2000, 1, 1),), (date(1995, 12, 31),), (date(2000, 6, 30),), (None,)], "d date")
    got = [r.y for r in df.select(service_years(F.lit(date(2000, 12, 31)), "d").alias("y")).collect()]
    assert got == [Decimal("1.00"), Decimal("1.00"), Decimal("5.00"), Decimal("0.50"), None]


def test_quality_operators(spark):
    child = spark.createDataFrame([(1, 10), (2, 99)], "id int, parent int")
    parent = spark.createDataFrame([(10,)], "pid int")
    assert rows(Q.orphans(child, parent, "parent", "pid"), "id") == [(2,)]
    dup = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(Q.duplicate_keys(dup, ["k"]), "k", "row_count") == [(1, 2)]
    a = spark.createDataFrame([(1, Decimal("1.00"))], "k int, x decimal(18,2)")
    b = spark.createDataFrame([(1, Decimal("1.00")), (2, Decimal("5.00"))], "k int, y decimal(18,2)")
    assert rows(Q.tie_out(a, b, ["k"], "x", "y"), "k") == [(2,)]


def test_line_number_chunked_on_a_hot_document(spark):
    data = [(1 if i % 5 else i, i % 9, i) for i in range(2000)]   # document 1 holds 80 % of the rows
    df = spark.createDataFrame(data, "doc int, line int, id int")
    chunked = W.line_number(df, ["doc"], ["line", "id"], "n", chunk="line")
    w = Window.partitionBy("doc").orderBy("line", "id")
    plain = df.withColumn("n", F.row_number().over(w))
    assert rows(chunked, "doc", "id", "n") == rows(plain, "doc", "id", "n")


def test_line_number_of_numbers_among_all_rows(spark):
    """Repeated lines, null keys, and a dimension that drops and repeats rows."""
    rows = [(doc, line, i, i % 4) for i, (doc, line) in enumerate([(1, 1), (1, 2), (1, 2), (1, 2), (1, 3), (2, 5), (2, 5), (2, 7), (2, 7), (2, None),
                                                                   (None, 1), (3, 1), (3, 1), (3, 2), (3, 4), (4, 1)])]
    df = spark.createDataFrame(rows, "doc int, line int, id int, dim int")
    dims = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (2, "c")], "k int, name string")
    widen = lambda x: x.join(dims, F.col("dim") == F.col("k"))
    for wanted in (F.col("id") % 3 == 0, F.col("id") % 3 == 1, F.col("doc") == 2, F.lit(True), F.lit(False)):
        picked = F.coalesce(wanted, F.lit(False))
        full = W.line_number(widen(df), ["doc"], ["line", "id"], "n", chunk="line", count_out="of").filter(picked)
        only = W.line_number_of(df.withColumn("p", picked), widen, ["doc"], ["line", "id"], "p", "line", "n", "of")
        cols = ["doc", "line", "id", "name", "n", "of"]
        assert sorted(full.select(cols).collect()) == sorted(only.select(cols).collect())
        assert full.select(cols).dtypes == only.select(cols).dtypes


def test_ordered_list_two_level_equals_single_sort(spark):
    from tallyspark.operators.rollup import ordered_list
    data = [(1 if i % 4 else 2, dt.date(2024, 1, 1 + i % 20), i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame(data, "k int, d date, id int, v string")
    out = {r["k"]: r["lst"] for r in ordered_list(df, ["k"], "v", ["d", "id"], ",", "lst").collect()}
    for k in (1, 2):
        expect = ",".join(v for kk, d, i, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2])))
        assert out[k] == expect


def test_parameter_block_and_default_windows(spark):
    from tallyspark.functions.params import Params, apply_filters, as_date, previous_month, year_to_date
    assert as_date("2024/01/15 10:00".replace("/", "-")) == dt.date(2024, 1, 15)
    assert as_date(dt.datetime(2024, 2, 29, 23, 59)) == dt.date(2024, 2, 29)
    assert year_to_date(dt.date(2024, 5, 7)) == (dt.date(2024, 1, 1), dt.date(2024, 5, 7))
    assert previous_month(dt.date(2024, 3, 10)) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert Params(as_of=None).as_of == dt.date.today()
    df = spark.createDataFrame([(1, "a", "X"), (2, "b", None)], "id int, k string, c string")
    assert apply_filters(df, {"k": ["a", "b"], "c": "All"}).count() == 2
    assert apply_filters(df, {"c": None}, mode="nvl").count() == 1


def test_resolve_first_non_null(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    s1 = spark.createDataFrame([(1, "from-1")], "k int, v string")
    s2 = spark.createDataFrame([(1, "ignored"), (2, "from-2")], "k int, v string")
    out = J.resolve_first(base, [(s1, "k", "v"), (s2, "k", "v")], "source", default="Manual Journal")
    assert rows(out, "k", "source") == [(1, "from-1"), (2, "from-2"), (3, "Manual Journal")]


def test_sinks_write_and_burst(spark, tmp_path):
    from tallyspark.sources.sinks import burst, write_report
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "burst_key string, v int")
    write_report(df, str(tmp_path / "rep"), fmt="csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "rep")).count() == 3
    burst(df, str(tmp_path / "burst"), fmt="parquet")
    parts = sorted(p.name for p in (tmp_path / "burst").iterdir() if p.name.startswith("burst_key="))
    assert parts == ["burst_key=A", "burst_key=B"]


def test_optional_source_by_uri(spark, small_dir):
    from tallyspark.sources.tables import Tables

    assert Tables(spark, f"file:{small_dir}").exists("customer")
    assert Tables(spark, small_dir).exists("customer")
    assert not Tables(spark, f"file:{small_dir}").exists("no_such_table")


def test_div_round_beyond_bigint(spark):
    from tallyspark.functions.scalars import div_round

    row = spark.range(1).select(
        div_round(F.lit(500000000 * 200000000), F.lit(700)).alias("a"),
        div_round(F.lit(-60000000000000000), F.lit(7)).alias("b"), div_round(F.lit(1), F.lit(0)).alias("c")).first()
    assert (str(row.a), str(row.b), row.c) == ("142857142857142.86", "-8571428571428571.43", None)
