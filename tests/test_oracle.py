"""Every registered query against its DuckDB statement, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracles.catalog import SQL
from rentalytics.plans.catalog import QUERIES
from tests.compare import connect, differences

# No SQL counterpart: trained models, tails of distributions, and the schema report.
WITHOUT_SQL = {
    "clean_listings", "anova_price_p", "tukey_hsd", "manova_wilks_p",
    "train_price_model", "predict_price", "what_if", "evaluate_price_model",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(queries())
    assert set(SQL) <= set(oracle_sql())


def test_catalog_and_statements_match():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 200
