"""Features that are worked out while the ranges are written, against pandas; what is shuffled and written for them."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from conftest import make
from tallyloom import session
from tallyloom.operators import features, ordered

SCHEMA = "row_id string, order_date date, region string, kind string, quantity double"


def frame(n):
    rnd = random.Random(n)
    return pd.DataFrame({
        "row_id": [f"{i:06d}" for i in range(n)],
        "order_date": [dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60)) for _ in range(n)],
        "region": [rnd.choice(["hot", "hot", "hot", "b", "c", None]) for _ in range(n)],
        "kind": [f"k{rnd.randrange(40)}" for _ in range(n)],
        "quantity": [rnd.uniform(-5, 40) for _ in range(n)]}).sort_values(["order_date", "row_id"]).reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-9)


@pytest.fixture
def ranges(spark):
    """More ranges than some tables have rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n,rows", [(1, 50_000), (35, 50_000), (400, 7), (3000, 50_000)])
def test_streamed_is_what_pandas_gives(spark, monkeypatch, ranges, n, rows):
    monkeypatch.setattr(ordered, "ROWS", rows)
    want = frame(n)
    df = make(spark, want, SCHEMA).repartition(3)
    got, plain = ordered.streamed(df, "quantity", ["order_date", "row_id"], True, [1, 30], [1, 7, 30],
                                  {"e7": 0.25, "e900": 2 / 901, "e1": 1.0})
    assert plain.count() == n and "_mid" in plain.columns
    got, q = got.toPandas().sort_values(["order_date", "row_id"]).reset_index(drop=True), want["quantity"]
    assert list(got["row_id"]) == list(want["row_id"])
    for name, a in (("e7", 0.25), ("e900", 2 / 901), ("e1", 1.0)):
        same(got[name], q.ewm(alpha=a, adjust=False).mean())
    for k in (1, 30):
        same(got[f"quantity_lag_{k}"], q.shift(k))
    for k in (1, 7, 30):
        roll = q.rolling(k, min_periods=1)
        same(got[f"quantity_rolling_mean_{k}"], roll.mean())
        same(got[f"quantity_rolling_std_{k}"], roll.std())
        same(got[f"quantity_rolling_max_{k}"], roll.max())


@pytest.mark.parametrize("n,rows", [(35, 50_000), (2500, 11)])
def test_lags_by_groups(spark, monkeypatch, ranges, n, rows):
    monkeypatch.setattr(ordered, "ROWS", rows)
    want = frame(n)
    want.loc[::9, "quantity"] = np.nan  # nulls are values too
    df = make(spark, want, SCHEMA).repartition(3)
    with session.scratch(spark) as written:
        got = features.lag(df, lags=[2, 20], group_cols=["kind", "region"])
        got = got.toPandas().sort_values(["order_date", "row_id"]).reset_index(drop=True)
        assert len(written) == 2  # the rows with what was worked out of them, and the ids that come twice
    assert len(got) == n
    for g in ("kind", "region"):
        for k in (2, 20):
            same(got[f"quantity_lag_{k}_{g}"], want.groupby(g)["quantity"].shift(k))


def test_rows_of_one_id_have_the_largest_lags(spark):
    df = make(spark, frame(200).assign(row_id=lambda f: [None if i == 5 else f"{i // 2:06d}" for i in range(200)]), SCHEMA)
    lone = df.selectExpr("monotonically_increasing_id() row_id", "order_date", "region", "kind", "quantity")
    assert features.lag(lone, lags=[1], group_cols=["kind", "region"]).count() == 200
    got = features.lag(df, lags=[1], group_cols=["kind", "region"]).toPandas()
    assert len(got) == 200
    for _, rows in got.groupby("row_id"):
        for c in ("quantity_lag_1_kind", "quantity_lag_1_region"):
            assert rows[c].nunique(dropna=False) == 1
    assert got[got.row_id.isna()][["quantity_lag_1_kind", "quantity_lag_1_region"]].isna().all().all()
    assert got["quantity_lag_1_region"].notna().sum() > 150


def test_all_features_with_and_without_gaps(spark):
    """A missing quantity goes the longer way, to the same columns."""
    want = frame(500)[["row_id", "order_date", "quantity"]]
    df = make(spark, want, "row_id string, order_date date, quantity double")
    off = dict(temporal_=False, aggregations_=False, prices=False, interactions=False)
    wide, names = features.all_features(df, **off)
    plan = wide._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(_block" not in plan and "Window" not in plan
    gaps, other = features.all_features(df.selectExpr(
        "row_id", "order_date", "IF(row_id = '000003', NULL, quantity) quantity"), **off)
    assert names == other and wide.columns == gaps.columns and wide.dtypes == gaps.dtypes
    assert "Window" in gaps._jdf.queryExecution().toString() and gaps.count() == wide.count() == 500
