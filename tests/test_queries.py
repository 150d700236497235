"""Every registered query with SQL gives the SQL's rows, and plans stay distributed."""

import pytest

from cohortlens.plans import registry
from tests.compare import difference, duck

MODEL_FREE = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows_over_one_partition(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "WindowGroupLimit" not in line:
            below = "\n".join(lines[i + 1 : i + 4])
            if "SinglePartition" in below:
                return True
    return False


@pytest.mark.parametrize("name", MODEL_FREE)
def test_query_equals_sql_with_a_distributed_plan(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert difference(con, df, registry.ORACLES[name]) is None
    plan = plan_of(df)
    assert not windows_over_one_partition(plan)
    for slow in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan, slow


def test_running_counts_share_one_shuffle(spark, sf):
    df = registry.QUERIES["mann_whitney"](spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    # Bucket bounds and value counts are each made once and reused by the other branch.
    assert final.count("ReusedExchange") == 2 and final.count("FileScan") == 2


def test_filters_and_columns_reach_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from cohortlens.operators import clean

    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = clean.filter_timepoint(df, "F", "o_orderstatus").select("o_orderkey").agg(F.count("*"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_package_of_the_optional_part():
    import subprocess
    import sys

    # Neither tokenizers nor xxhash can be imported; what needs neither is still there.
    code = (
        "import sys; sys.modules['tokenizers'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; "
        "names = e.queries(); assert 'biomarker_screen' in names and not any(n.startswith('op1') for n in names); assert e.oracle_sql().keys() <= names.keys()"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
