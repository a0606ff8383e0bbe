"""Python functions on columns hold a slice of a batch at a time."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.functions import batches
from gristmill.plans import cases  # noqa: F401  registers its queries
from gristmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_a_function_gets_slices(spark):
    df = spark.range(0, 4000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("ü"), (F.col("id") % 5000).cast("int"))).alias("t"))
    told = batches.sliced(lambda n, t: [{"n": i, "size": None if x is None else len(x), "held": len(n), "chars": sum(len(y or "") for y in t)} for i, x in zip(n, t)], "n bigint, size int, held int, chars int")
    rows = df.select("id", told(F.col("id"), F.col("t")).alias("x")).select("id", "x.*").collect()
    assert all(r["n"] == r["id"] and r["size"] == (r["id"] % 5000 if r["id"] % 7 else None) for r in rows) and len(rows) == 4000
    assert max(r["held"] for r in rows) <= batches.ROWS and max(r["chars"] for r in rows) <= batches.BYTES
    alone = batches.sliced(lambda t: [None if x is None else len(t) for x in t], "int")
    assert [r[0] is None for r in df.select(alone(F.col("t"))).collect()] == [k % 7 == 0 for k in range(4000)]
    assert df.where("id < 0").select(alone(F.col("t"))).count() == 0


def test_slices_keep_every_row_in_order():
    rows = [{"t": "x" * (3_000_000 if k % 50 == 0 else k)} for k in range(120)]
    parts = [p.to_pylist() for p in batches.slices(pa.RecordBatch.from_pylist(rows), 30)]
    assert [r for p in parts for r in p] == rows
    assert max(map(len, parts)) <= 30 and all(len(p) == 1 or sum(len(r["t"]) for r in p) <= batches.BYTES for p in parts)


#: Queries whose functions took a batch of 10,000 rows as Python objects at once.
SLICED = ["grounded_extraction", "embedded_state", "card_chunks", "extracted_bytes", "envelope_reasons"]


@pytest.mark.parametrize("name", SLICED)
def test_no_function_of_a_query_takes_whole_batches(spark, name, monkeypatch):
    """Neither in its plan nor in those of the tables that it writes on the way: 200 is the kind of functions on whole Pandas columns."""
    from gristmill.plans.tables import Written

    plans, write = [], Written.__call__
    monkeypatch.setattr(Written, "__call__", lambda self, df: (plans.append(df), write(self, df))[1])
    plans.append(QUERIES[name](spark, SF))
    found = [k for df in plans for k in re.findall(r"(?:ArrowEvalPython|BatchEvalPython) .*?, (\d+)$", df._jdf.queryExecution().executedPlan().toString(), re.M)]
    assert "200" not in found and found
