"""Neighbour queries shuffle a point a few times, not once for each cell that it looks into."""

import pytest

from pointweave.plans import QUERIES

SF = "/root/testdata/sf0.001"


def shuffled_rows(node) -> int:
    """Rows that the shuffles of an executed plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(node.plan())
    if kind == "ReusedExchangeExec":
        return 0
    found = node.metrics().get("shuffleRecordsWritten")
    below = node.children()
    return (found.get().value() if found.isDefined() else 0) + sum(shuffled_rows(below.apply(k)) for k in range(below.size()))


NAMES = ["reciprocal_neighbours", "semantic_boundary", "memory_retrieval", "causal_consistency", "dilated_z_buffer", "boundary_subsets"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_shuffled(spark, name):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    df = QUERIES[name](spark, SF)
    df.collect()
    assert 0 < shuffled_rows(df._jdf.queryExecution().executedPlan()) < 6 * n
