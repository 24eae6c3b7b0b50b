"""Every registered query of the miner against its SQL."""

import pytest
from conftest import DATA, duck, rows_of

from linestrata.plans.queries import ORACLES, QUERIES, flagship

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, f"{DATA}/{SF}").toPandas()
    want = con.execute(ORACLES[name]).to_arrow_table().to_pandas()
    assert rows_of(got) == rows_of(want)


def test_flagship(spark):
    assert flagship(spark, f"{DATA}/{SF}", 20).count() > 0


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["clusters"](spark, f"{DATA}/{SF}")._jdf.queryExecution().executedPlan().toString()
    schemas = {line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line}
    assert schemas and all("ts" not in s and "value:" not in s for s in schemas)
