"""Every query against its SQL, and the plan of the scalar stage."""

import re

import pytest
from compare import both

from kartoteka.plans.details import with_details
from kartoteka.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLE[name], SF)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def executed(spark):
    df = with_details(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    return df._jdf.queryExecution().executedPlan()


def test_no_shuffle_and_no_python(spark):
    plan = executed(spark).toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_each_pattern_stands_in_the_plan_once(spark):
    """Nothing is copied to where it is used: the count of regular expressions is that of the rules, not of their uses."""
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    df = with_details(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), compose=False)
    found = re.findall(r"(regexp_\w+|RLIKE)\(", df._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxPlanStringLength")
    assert len(found) <= 130


def test_compiled_code_stays_below_64_kb(spark):
    module = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spans = module.codegenStringSeq(executed(spark))
    sizes = [spans.apply(i)._3().maxMethodCodeSize() for i in range(spans.size())]
    assert sizes and 0 < max(sizes) < 64_000
