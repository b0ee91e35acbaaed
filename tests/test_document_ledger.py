"""R-AP5 by document and the subledger link chain: hand cases and balances."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.params import Params
from tallyspark.operators.joins import link_chain
from tallyspark.plans import registry as R

R.load_all()

from tallyspark.plans import link_chain as chain  # noqa: E402
from tallyspark.plans import supplier_ledger as ledger  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return R.tables_for(spark, SMALL)


def test_discount_is_prorated_in_base_currency_half_away_from_zero(spark):
    cases = [("100.00", "100.00", "5.00", "5.00"), ("100.00", "125.00", "5.00", "6.25"), ("3.00", "10.00", "1.00", "3.33"),
             ("8.00", "1.00", "0.04", "0.01"), ("-8.00", "1.00", "0.04", "-0.01"), ("0.00", "1.00", "0.04", None)]
    df = spark.createDataFrame([tuple(map(Decimal, c[:3])) for c in cases], "amount decimal(18,2), base decimal(18,2), discount decimal(18,2)")
    got = [r[0] for r in df.select(ledger.prorated_discount(F.col("amount"), F.col("base"), F.col("discount"))).collect()]
    assert got == [None if c[3] is None else Decimal(c[3]) for c in cases]


def test_prepayments_are_applied_oldest_first_and_never_overdrawn(spark):
    day = dt.date(2000, 1, 1)
    rows = [  # order, supplier, prepayment paid on, paid, invoice date, invoice amount, status
        (1, 7, day, "100.00", None, None, None), (2, 7, day + dt.timedelta(1), "50.00", None, None, None),
        (11, 7, None, "0.00", day, "30.00", "F"), (12, 7, None, "0.00", day + dt.timedelta(1), "90.00", "F"),
        (13, 7, None, "0.00", day + dt.timedelta(2), "500.00", "O"), (20, 7, None, "0.00", day, "500.00", "F"),  # not approved; a memo
        (14, 8, None, "0.00", day, "30.00", "F")]
    docs = spark.createDataFrame(
        [(o, v, p, Decimal(a), i, b and Decimal(b), s, 1, 1, 1, p, None) for o, v, p, a, i, b, s in rows],
        "order_id long, vendor_id long, pre_date date, pre_paid decimal(18,2), inv_date date, inv_amount decimal(18,2), inv_status string,"
        "org_id long, ledger_id long, customer_id long, pre_gl_date date, exchange_rate decimal(18,6)")
    got = {(r.prepay_id, r.invoice_id, r.applied) for r in ledger.applied_prepayments(docs, dt.date(2000, 12, 31)).collect()}
    assert got == {(1, 11, Decimal("30.00")), (1, 12, Decimal("70.00")), (2, 12, Decimal("20.00"))}


def test_packed_values_come_back_null_or_not(spark):
    fields = {"day": (-(1 << 31), 33), "rate": (-9999, 15), "code": (0, 2)}
    cases = [(-(1 << 31), -9999, 0), ((1 << 31) - 1, 9999, 2), (0, 0, 1), (None, None, None), (11000, None, 2), (None, -1, None), (-1, 5, None)]
    df = spark.createDataFrame(cases, "day int, rate int, code int")
    back = ledger.unpack(fields, ledger.pack(fields, **{c: F.col(c) for c in fields}))
    assert [tuple(r) for r in df.select(*[back[c].alias(c) for c in fields]).collect()] == cases


def test_what_is_left_of_prepayments(spark):
    day = dt.date(2000, 1, 31)
    rows = [  # order, supplier, prepayment paid on, paid, invoice date, invoice amount
        (1, 7, day, "100.00", None, None), (2, 7, day + dt.timedelta(1), "50.00", None, None), (3, 7, day + dt.timedelta(90), "8.00", None, None),
        (11, 7, None, "0.00", day, "30.00"), (12, 7, None, "0.00", day + dt.timedelta(40), "90.00"),
        (4, 8, day, "5.00", None, None), (5, None, day, "5.00", None, None), (6, 9, dt.date(2001, 1, 1), "5.00", None, None)]
    docs = spark.createDataFrame(
        [(o, v, p, Decimal(a), i, b and Decimal(b), "F", 1, 1, 1, p, Decimal("1.250000")) for o, v, p, a, i, b in rows],
        "order_id long, vendor_id long, pre_date date, pre_paid decimal(18,2), inv_date date, inv_amount decimal(18,2), inv_status string,"
        "org_id long, ledger_id long, customer_id long, pre_gl_date date, exchange_rate decimal(18,6)")
    got = {(r.order_id, r.vendor_id, r.pre_date, r.pre_paid, r.left, r.exchange_rate) for r in ledger.left_ahead(ledger.laid_out(docs, dt.date(2000, 12, 31))).collect()}
    rate = Decimal("1.250000")
    assert got == {(2, 7, day + dt.timedelta(1), Decimal("50.00"), Decimal("30.00"), rate), (3, 7, day + dt.timedelta(90), Decimal("8.00"), Decimal("8.00"), rate),
                   (4, 8, day, Decimal("5.00"), Decimal("5.00"), rate)}  # 5 and 6 lie in no stretch: a document itself leaves them whole


def test_movements_of_a_document_add_up(tables):
    mv = ledger.supplier_movements(tables.with_params(Params(date_from="1990-01-01", date_to="2030-01-01"))).toPandas()
    docs = ledger.ledger_documents(tables).toPandas().set_index(["order_id", "vendor_id"])
    assert set(mv["num"]) == {1, 2, 3, 4, 5, 6, 7}
    advance = mv[mv["invoice_description"].str.startswith("Advance")].groupby(["order_id", "vendor_id"])["amount_dr"].sum()
    applied = mv[mv["num"] == 6].groupby(["order_id", "vendor_id"])["amount_dr"].sum()
    both = advance.add(applied, fill_value=Decimal(0))
    paid = docs[docs["pre_paid"] > 0]["pre_paid"]
    assert dict(both) == dict(paid)  # what is paid ahead is either applied or still an advance
    assert mv[mv["num"] == 5][["amount_dr", "amount_cr", "acct_dr", "acct_cr"]].isna().all().all()
    assert not (mv["order_id"].isin(mv[mv["num"] == 5]["order_id"]) & (mv["num"] == 7)).any()  # no discount on a void check
    assert (mv[mv["num"] == 1]["order_id"] % 10 != 0).all() and (mv[mv["num"] == 2]["order_id"] % 10 == 0).all()


def test_opening_block_is_the_sum_of_earlier_periods(spark):
    run = lambda a, b: R.report("r_ap5_supplier_document_ledger", spark, SMALL, Params(date_from=a, date_to=b))
    whole = run("1900-01-01", "1996-12-31")
    assert whole.filter("block = 1").count() == 0
    # applications depend on the period's end, so both runs end on one day
    late = run("1996-01-01", "1996-12-31")
    sums = [F.sum(c) for c in ("entered_debit", "entered_credit", "accounted_debit", "accounted_credit")]
    assert whole.agg(*sums).first() == late.agg(*sums).first()
    opening = late.filter("block = 1").collect()
    assert len(opening) == 1 and opening[0].description == "Opening Balance" and opening[0].invoice_id is None and opening[0].business_unit is None


def test_a_hop_must_carry_the_tenant_key(spark):
    lines = spark.createDataFrame([(1, "h", 5), (2, "h", 7)], "ledger_id int, header string, amount int")
    headers = spark.createDataFrame([(1, "h", "a"), (2, "h", "b")], "ledger_id int, header string, doc string")
    got = link_chain(lines, [(headers, ["ledger_id", "header"], "inner")], ["ledger_id"])
    assert {(r.amount, r.doc) for r in got.collect()} == {(5, "a"), (7, "b")}
    with pytest.raises(ValueError, match="tenant key ledger_id"):
        link_chain(lines, [(headers, ["header"], "inner")], ["ledger_id"])


def test_chain_neither_loses_nor_repeats_lines(spark, tables):
    always = Params(date_from="1900-01-01", date_to="2100-01-01")
    lines = chain.accounting_lines(tables)
    got = R.report("j13_sla_distributions", spark, SMALL, always).agg(F.count("*"), F.sum("accounted_dr")).first()
    assert got == lines.filter("application_id = 222").agg(F.count("*"), F.sum("accounted_dr")).first()
    heads = chain.accounting_headers(tables)
    assert heads.groupBy("event_id").count().filter("count > 1").limit(1).count() == 1  # one to many without the ledger
    posted = tables.lineitem.filter("l_linestatus = 'F'").count()
    assert R.report("r_fx1_source_documents", spark, SMALL, always).count() == posted
    vouchers = R.report("r_ap4_voucher_distributions", spark, SMALL, always).agg(F.sum("dist_debit")).first()[0]
    assert vouchers == -lines.filter("application_id = 200").agg(F.sum("accounted_cr")).first()[0]
