"""Every registered query against its SQL on the smallest tables."""

import pytest

from conformance.check import compare, connect
from conformance.oracle import SQL
from conformance.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) == ""


def test_answers_are_not_empty(connection):
    for name, sql in SQL.items():
        assert connection.sql(f"SELECT count(*) FROM ({sql})").fetchall()[0][0] > 0, name


def test_labels_and_statuses_vary(connection):
    for name, column, least in (
        ("categorize", "category", 7), ("track_label", "track_match", 5), ("active_verdict", "reason", 12),
        ("best_tracks", "best_tracks", 4), ("run_pipeline", "category", 6), ("freshness_bucket", "freshness", 3),
    ):
        found = connection.sql(f"SELECT count(DISTINCT {column}) FROM ({SQL[name]})").fetchall()[0][0]
        assert found >= least, (name, found)
