"""Every time-series query beside its independent DuckDB SQL."""

import pytest

from tests.comparing import oracle_rows, query_rows
from tideline.plans import ablation_queries, contract_queries, feature_queries, forecast_queries, learned_queries, matrix_queries, pit_queries, projection_queries, registry, selection_queries, source_queries, stream_queries, structural_queries, transition_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert query_rows(registry.queries()[name](spark, sf_dir)) == oracle_rows(sf_dir, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0
