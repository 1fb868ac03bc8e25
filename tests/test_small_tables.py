"""Queries against their twins over a few rows that the given tables rarely have."""

import datetime as dt
import hashlib
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.compare import connect, same
from tidemark.operators import certify
from tidemark.plans import queries as plans
from tidemark.sources import readers as R


def tables(folder, parts, orders, lines):
    day = pa.timestamp("us")
    pq.write_table(pa.table({"p_partkey": pa.array(parts, pa.int64()), "p_name": [f"part {p}" for p in parts]}), folder / "part.parquet")
    pq.write_table(pa.table({"o_orderkey": pa.array([o for o, _ in orders], pa.int64()), "o_custkey": pa.array([5] * len(orders), pa.int64()), "o_orderdate": pa.array([d for _, d in orders], day)}), folder / "orders.parquet")
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names), folder / "lineitem.parquet")
    return str(folder)


def test_purchases_of_congress_without_an_amount_amend_nothing(spark, tmp_path):
    days = [(42, dt.datetime(1996, 1, 10)), (43, dt.datetime(1996, 2, 10)), (85, dt.datetime(1996, 1, 11)), (86, dt.datetime(1996, 2, 11))]
    lines = [(42, 7, 10, 1, "A", 3.0, 40000.0), (43, 37, 10, 1, "A", 3.0, 40000.0), (85, 8, 10, 1, "A", 3.0, 40000.0), (86, 9, 10, 1, "A", 3.0, 40000.0)]  # part 37: no amount
    data = tables(tmp_path, [7, 8, 9, 37], days, lines)
    got = plans.QUERIES["c03_holdings_candidates"](spark, data)
    assert {r.filing_refs for r in got.collect()} == {"house_pdf|D42|R1", "house_pdf|D86|R1"}
    same(got, connect(data), plans.ORACLES["c03_holdings_candidates"])


@pytest.mark.parametrize(("name", "most"), [("g47_certify_series", 1), ("g48_rebaseline_plan", 5)])
def test_generations_of_prices_are_dealt_out_once(spark, data_dir, name, most):
    df = plans.QUERIES[name](spark, data_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.split("\n") if re.match(r"\W*Exchange hash", line)]
    assert len(dealt) <= most and len([line for line in dealt if "REPARTITION_BY_COL" in line]) == 1


def test_bad_values_end_no_certification_by_an_error(spark):
    day = [dt.date(2024, 1, d) for d in range(1, 5)]
    rows = [("A", g, d, 10.0 * s, s) for g, s in (("g1", 1.0), ("g2", 2.0)) for d in day] + [("A", "g3", d, 10.0, 0.0 if d == day[1] else 1.0) for d in day]
    values = spark.createDataFrame(rows, "ticker string, generation string, date date, close double, adjustment_factor double")
    paid = spark.createDataFrame([("A", None, 1.0), ("B", day[1], 1.0)], "ticker string, ex_date date, cash_amount double")
    got = certify.certify_series(values, paid).collect()
    assert [(r.keeper, r.fetches, r.splits, r.reason) for r in got] == [("g3", 3, 0, "invalid_values")]
    plan = certify.rebaseline_plan(values, paid.where("ticker = 'B'"), spark.createDataFrame([("A", "g1"), ("C", "g1")], "ticker string, keeper string")).collect()
    assert sorted(map(tuple, plan)) == [("A", "g1", "g2", "g3"), ("C", "g1", "", "")]


def test_documents_are_bundled_and_read_like_files(spark, tmp_path):
    texts = {i: (b"%PDF-1.4 " if i % 3 else b"<html>") + bytes([i % 256]) * (i % 1500) + b"%%EOF" for i in range(3000)}
    docs = spark.createDataFrame([(f"{1990 + i % 9}/pdfs/{i}.pdf", bytearray(t)) for i, t in texts.items()], "path string, content binary").repartition(3)
    folder = f"{tmp_path}/a b"
    assert R.write_documents(docs, folder) == 3000
    assert len([f for _, _, names in os.walk(folder) for f in names]) < 100
    (tmp_path / "a b/2024/pdfs").mkdir(parents=True)
    (tmp_path / "a b/2024/pdfs/x.pdf").write_bytes(b"%PDF-1.4 x %%EOF\n")
    want = [(1990 + i % 9, str(i), hashlib.sha256(t).hexdigest(), i % 3 > 0) for i, t in texts.items()] + [(2024, "x", hashlib.sha256(b"%PDF-1.4 x %%EOF\n").hexdigest(), True)]
    assert sorted(map(tuple, R.scan_document_inventory(spark, folder).collect())) == sorted(want)
    assert R.write_documents(docs.where("false"), f"{tmp_path}/none") == 0 and R.scan_document_inventory(spark, f"{tmp_path}/none").count() == 0
