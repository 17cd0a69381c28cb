"""Every query that has SQL against DuckDB, and the rest by their rows and rules."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.operators import rolling, strategies
from tidemark.registry import oracle_sql, queries
from tidemark.sources.bars import BAR

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, duck, name):
    found = queries()[name](spark, SF)
    names = sorted(found.columns)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=repr)
    assert rows(found.select(names).collect()) == rows(duck.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    """Rows come out, the same ones in a second run; tests of their values are in the other files."""
    run = lambda: sorted(map(repr, queries()[name](spark, data).collect()))
    found = run()
    assert found
    if name not in ("live_signals", "ml_report", "ml_features", "signal_report", "declared_signals"):  # a minute each
        assert found == run()


def test_constant_prices(spark):
    from datetime import datetime, timedelta

    bars = spark.createDataFrame([("s", datetime(2024, 1, 1) + timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(64)], BAR)
    stats = rolling.return_stats(bars).first()
    assert (stats["mean"], stats["std"], stats["sharpe"], stats["t"], stats["p"]) == (0, 0, 0, 0, 1)
    assert rolling.half_life(bars).first()["half_life"] == math.inf


def test_unknown_strategy():
    with pytest.raises(KeyError):
        strategies.strategy("none")
