"""Rows that a report shuffles, per line item, with every join shuffled as on
large tables; rows are built here."""

import datetime as dt

import pytest

import __spark_entry__ as entry

LINES = 600


def shuffled_rows(df) -> int:
    """Rows written by all shuffles of one run (a reused one counts once)."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind != "ReusedExchangeExec":
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return total


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("volume")
    day = lambda n: dt.datetime(1997, 1, 1) + dt.timedelta(n % 1460)
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 2) for i in range(4)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(i, f"Customer {i}", i % 4, 10.0 - i, "AUTO") for i in range(20)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"Supplier {i}", i % 4, i - 3.0) for i in range(10)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
                 [(i, f"part {i}", "B", "T", 1, 9.5) for i in range(30)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(i, i * 7 % 20, "FOP"[i % 3], 100.0 + i, day(i * 9), f"{i % 5 + 1}-P") for i in range(LINES // 4)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(i // 4, i * 11 % 30, i * 3 % 10, i % 4 + 1, 1.0 + i % 9, 10.25 + i, i % 11 / 100, i % 9 / 100, "ANR"[i % 3], "FO"[i // 5 % 2], day(i * 13))
                      for i in range(LINES)])}
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name, most", [("r_fx1_source_documents", 16), ("r_ap4_voucher_distributions", 12), ("j13_sla_distributions", 3),
                                        ("r_po2_po_shipment_detail", 6), ("r_ap5_supplier_document_ledger", 14)])
def test_rows_shuffled_per_line(spark, folder, name, most):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = entry.queries()[name](spark, folder)
        assert df.count() > 0
        rows = shuffled_rows(df) / LINES
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert rows < most, (name, rows)


def test_whole_lines_are_shuffled_once(spark, folder):
    """Shuffles of all line items with their prices: one, by journal and line."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = entry.queries()["r_ap4_voucher_distributions"](spark, folder)
        df.collect()
        whole, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            elif kind != "ReusedExchangeExec":
                if kind == "ShuffleExchangeExec" and "l_extendedprice" in node.output().toString():
                    whole += node.metrics().apply("shuffleRecordsWritten").value() >= LINES
                todo.extend(node.children().apply(i) for i in range(node.children().size()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert whole == 1


def test_supplier_ledger_shuffles_its_lines_twice(spark, folder):
    """Shuffles of all line items: one by order, one by order and supplier,
    which documents, prepayments and invoices share; prices go through once each."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = entry.queries()["r_ap5_supplier_document_ledger"](spark, folder)
        df.collect()
        of_lines, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            elif kind != "ReusedExchangeExec":
                if kind == "ShuffleExchangeExec" and "gross_amount" in node.output().toString():
                    of_lines.append(node.metrics().apply("shuffleRecordsWritten").value())
                todo.extend(node.children().apply(i) for i in range(node.children().size()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert of_lines == [LINES, LINES]
