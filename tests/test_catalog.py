"""Every query against its DuckDB form over the smallest tables."""

import os
from collections import Counter
from glob import glob

import duckdb
import pytest

from lexmill.functions.stats import log_gamma
from lexmill.plans import catalog


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if hasattr(value, "item") and getattr(value, "ndim", 0) == 0:
        return plain(value.item())
    return value.tolist() if hasattr(value, "tolist") else value


def bag(frame, columns):
    return Counter(tuple(map(repr, map(plain, row))) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob(f"{small}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{files}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, small, duck, name):
    mine = catalog.queries()[name](spark, small).toPandas()
    theirs = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert bag(mine, columns) == bag(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


#: (f, t, c_first, c_second, c_both): pairs of check_s whose scores near 1, or near half of their last shown digit.
CLOSE = [
    ("It", "to", 3018, 245, 3), ("It", "of", 5829, 245, 3), ("It", "edble", 62, 245, 1), ("erin", "and", 3585, 193, 3), ("erin", "the", 9376, 193, 6),
    ("is,", "and", 3585, 178, 3), ("is,", "the", 9376, 178, 9), ("reth", "of", 5829, 112, 2), ("reth", "the", 9376, 112, 5), ("thon", "in", 2582, 315, 3),
    ("thon", "the", 9376, 315, 12), ("eran", "inor", 54, 200, 1), ("hewh", "rees", 100, 80, 1), ("or,", "thnt", 239, 51, 1),
    ("all", "the", 30_000, 40, 2), ("all", "of", 25_000, 40, 5), ("none", "the", 30_000, 2, 3), ("none", "two words", 4, 2, 1),
]


@pytest.mark.parametrize("name", ["fisher_filter_words", "fisher_filter_lines"])
def test_close_scores_equal_duckdb(spark, monkeypatch, name):
    rows = spark.createDataFrame(CLOSE, "f string, t string, c_first long, c_second long, c_both long")
    monkeypatch.setattr(catalog, "relation", lambda *_: rows)
    connection = duckdb.connect()
    connection.register("pt_words", rows.toPandas())
    oracle = catalog.oracle_sql()[name]
    theirs = connection.execute("with " + oracle[oracle.index(", p as (") + 2 :]).df()
    mine = catalog.queries()[name](spark, "").toPandas()
    assert bag(mine, ["f", "t", "score"]) == bag(theirs, ["f", "t", "score"]) and len(mine) > 7


def test_log_gamma_to_the_last_bit():
    theirs = duckdb.sql("select lgamma(i) from range(1, 20002) t(i) order by i").fetchall()
    assert [log_gamma(i + 1) for i in range(20_001)] == [x for (x,) in theirs]
