"""Row-order operators, cleaning and features against pandas."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import make
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.operators import clean, features, ordered, requests
from tallyloom.sources.tables import SALES_COLUMNS


def rows_frame(n=3000, seed=1):
    rnd = random.Random(seed)
    return pd.DataFrame({
        "row_id": [f"{i:06d}" for i in range(n)],
        "order_date": [dt.date(2024, 1, 1) + dt.timedelta(days=rnd.choice([3, 3, rnd.randrange(60)]))
                       for _ in range(n)],
        "region": [rnd.choice(["hot", "hot", "hot", "b", "c", None]) for _ in range(n)],
        "quantity": [float(rnd.randrange(-5, 40)) for _ in range(n)],
    })


SCHEMA = "row_id string, order_date date, region string, quantity double"


@pytest.fixture(scope="module")
def frame():
    return rows_frame().sort_values(["order_date", "row_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def rows(spark):
    return make(spark, rows_frame(), SCHEMA)


def in_order(df):
    return df.toPandas().sort_values(["order_date", "row_id"]).reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-9)


def test_positions_do_not_gather_a_hot_key(spark, rows, frame):
    known = rows.filter("region is not null")
    out = ordered.positions(known, ["region"], ["order_date", "row_id"], partitions=6)
    got = in_order(out)
    want = frame[frame.region.notna()].groupby("region").cumcount()
    assert list(got["_pos"]) == list(want)


def test_copies_spread_over_the_ranges(spark):
    """A third of the rows are exact copies of one row."""
    df = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    sizes = [r["count"] for r in ordered._ranged(df, ["k"], 8).groupBy(
        F.shiftright("_mid", 33)).count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 2 * 12_000 / 8
    places = ordered.positions(df, [], ["k"], partitions=8).agg(
        F.count_distinct("_pos"), F.min("_pos"), F.max("_pos")).first()
    assert tuple(places) == (12_000, 0, 11_999)


@pytest.mark.parametrize("block", [8, 64, 1024])
def test_lag_rolling_ewma_ungrouped(spark, rows, frame, block):
    p = ordered.positions(rows, [], ["order_date", "row_id"], partitions=5)
    spans = {"e2": 2, "e7": 7, "e30": 30, "e900": 900}
    p = ordered.ewm(p, [], "quantity", {k: 2 / (n + 1) for k, n in spans.items()}, block=block)
    p = ordered.ewm(p, [], "quantity", {"e_all": 1.0}, block=block)
    got = in_order(ordered.lag_roll(p, [], "quantity", [1, 30], [7, 100], block=block))
    assert len(got) == len(frame)
    q = frame["quantity"]
    for k, n in spans.items():
        same(got[k], q.ewm(span=n, adjust=False).mean())
    same(got["e_all"], q)
    for n in (1, 30):
        same(got[f"quantity_lag_{n}"], q.shift(n))
    for n in (7, 100):
        roll = q.rolling(n, min_periods=1)
        same(got[f"quantity_rolling_mean_{n}"], roll.mean())
        same(got[f"quantity_rolling_std_{n}"], roll.std())
        same(got[f"quantity_rolling_max_{n}"], roll.max())


def test_grouped_features_skip_rows_without_key(spark, rows, frame):
    got = in_order(features.ewma(features.rolling(features.lag(
        rows, lags=[2], group_cols=["region"]), windows=[5], group_cols=["region"]),
        spans=[4], group_cols=["region"]))
    g = frame.groupby("region")["quantity"]
    same(got["quantity_lag_2_region"], g.shift(2))
    same(got["quantity_rolling_mean_5_region"],
         g.transform(lambda s: s.rolling(5, min_periods=1).mean()))
    same(got["quantity_ewma_4_region"], g.transform(lambda s: s.ewm(span=4, adjust=False).mean()))
    assert got.loc[frame.region.isna(), "quantity_rolling_mean_5_region"].isna().all()
    assert len(got) == len(frame)


@pytest.mark.parametrize("block", [8, 64])
@pytest.mark.parametrize("missing", ["some", "first", "long", "all", "most"])
def test_exponential_means_over_gaps(spark, block, missing):
    n = 400
    i = np.arange(n)
    empty = {"some": i % 7 == 3, "first": i < 30, "long": (i > 50) & (i < 390), "all": i >= 0,
             "most": i % 97 != 5}[missing]
    values = pd.Series(np.where(empty, np.nan, np.sin(i) * 50 + i))
    df = spark.createDataFrame(
        [(k, int(p), None if np.isnan(v) else float(v)) for k in ("a", "b") for p, v in enumerate(values)],
        "k string, _pos bigint, quantity double").repartition(3)
    spans = {"e1": 1, "e2": 2, "e7": 7, "e900": 900}
    got = ordered.ewm(df, ["k"], "quantity", {k: 2 / (s + 1) for k, s in spans.items()}, block=block)
    got = got.toPandas().sort_values(["k", "_pos"]).reset_index(drop=True)
    for key in ("a", "b"):
        part = got[got.k == key].reset_index(drop=True)
        for name, span in spans.items():
            same(part[name], values.ewm(span=span, adjust=False).mean())


def test_scratch_is_deleted(spark, rows, tmp_path):
    """Intermediate tables written inside go; the result stays, and so do tables written before."""
    import os

    kept = session.settle(rows, "kept")
    with session.scratch(spark) as written:
        features.ewma(features.lag(rows)).write.parquet(str(tmp_path / "features"))
        folders = [w.removeprefix("file:") for w, _ in written]
        assert folders and all(os.path.isdir(f) for f in folders)
    assert not any(os.path.exists(f) for f in folders)
    assert spark.read.parquet(str(tmp_path / "features")).count() == rows.count() == kept.count()
    features.lag(rows).collect()
    assert len(written) == len(folders)


def test_unique_order_saves_a_copy(spark, rows):
    with session.scratch(spark) as written:
        ordered.positions(rows, [], ["order_date", "row_id"], unique=True).collect()
    with session.scratch(spark) as more:
        ordered.positions(rows, [], ["order_date", "row_id"]).collect()
    assert len(written) == len(more) - 1 == 2


def test_smoothing_factor_is_checked(spark, rows):
    with pytest.raises(ValueError):
        ordered.ewm(rows.withColumn("_pos", F.lit(0)), [], "quantity", {"x": 0.0})


def dirty():
    base = dict(product_id="P", product_name="n", category="C", supplier_id="S", supplier_name="s",
                region="R", unit_price="10.0", discount="0.1", order_date="2024-01-03",
                delivery_date="2024-01-10", status="ok", customer_id="c", warehouse_id="w")
    rows = [
        {"order_id": "O-1", "quantity": "3"},
        {"order_id": "O-1", "quantity": "9"},               # later copy
        {"order_id": " O-1", "quantity": "4"},              # other id before stripping
        {"order_id": "O-2", "quantity": "N/A"},
        {"order_id": "O-3", "quantity": "-2"},
        {"order_id": "O-4", "quantity": "2.9", "discount": None, "delivery_date": None},
        {"order_id": "O-5", "quantity": "1", "unit_price": "-1"},
        {"order_id": "O-6", "quantity": "nan"},
        {"order_id": "O-7", "quantity": "5", "product_name": " \t Chair \n", "discount": "x"},
        {"order_id": "O-8", "quantity": "5", "delivery_date": "soon", "unit_price": "0.125"},
    ]
    return pd.DataFrame([{**base, **r} for r in rows])[SALES_COLUMNS]


def test_preprocess(spark):
    schema = ", ".join(f"{c} string" for c in SALES_COLUMNS)
    df = clean.with_input_ordinal(make(spark, dirty(), schema).coalesce(1))
    out = {(r["order_id"], r["quantity"]): r for r in clean.preprocess(df).collect()}
    assert set(out) == {("O-1", 3), ("O-1", 4), ("O-4", 2), ("O-7", 5), ("O-8", 5)}
    assert out[("O-1", 3)]["total_price"] == 27.0 and out[("O-1", 3)]["lead_time_days"] == 7
    assert out[("O-4", 2)]["discount"] == 0.0 and out[("O-4", 2)]["lead_time_days"] is None
    assert out[("O-7", 5)]["product_name"] == "Chair" and out[("O-7", 5)]["discount"] == 0.0
    assert out[("O-8", 5)]["delivery_date"] is None
    assert out[("O-8", 5)]["total_price"] == np.round(5 * 0.125 * (1 - 0.1), 2)
    report = {r["rule"]: r["dropped"] for r in clean.drop_report(df).collect()}
    assert list(report.values()) == [1, 2, 2]
    numeric = clean.numeric_only(df).toPandas()
    assert len(numeric) == 8 and (numeric["quantity"] < 0).any()


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a",)], "order_id string")
    with pytest.raises(ValueError, match="unit_price"):
        clean.validate_columns(df)


def test_numbers_in_texts(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "7.", "12d", "1f", "0x1p3", "N/A", "", "nan", "inf", None, "1,000"]
    df = spark.createDataFrame([(t,) for t in texts], "quantity string")
    got = [r[0] for r in clean.coerce_numeric(df).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, math.inf, None, None]
    numbers = spark.createDataFrame([(1.5,), (float("nan"),)], "quantity double")
    assert [r[0] for r in clean.coerce_numeric(numbers).collect()] == [1.5, None]


def test_date_formats(spark):
    df = spark.createDataFrame([("2024-02-03",), ("03/02/2024",), ("?",)], "order_date string")
    iso = [str(r[0]) for r in clean.clean_dates(df).collect()]
    both = [str(r[0]) for r in clean.clean_dates(df, ["yyyy-MM-dd", "dd/MM/yyyy"]).collect()]
    assert iso == ["2024-02-03", "None", "None"] and both == ["2024-02-03", "2024-02-03", "None"]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (3, None)], "a int, b string")
    got = [(r["column"], r["rows"], r["nulls"]) for r in clean.profile_nulls(df).collect()]
    assert got == [("a", 3, 1), ("b", 3, 2)]


def sales_frame(n=400, seed=5):
    rnd = random.Random(seed)
    pdf = rows_frame(n, seed)
    pdf["quantity"] = [float(rnd.randrange(1, 9)) for _ in range(n)]
    pdf["unit_price"] = [rnd.randrange(50, 5000) / 10 for _ in range(n)]
    pdf["discount"] = [rnd.choice([0.0, 0.1, 0.25]) for _ in range(n)]
    pdf["category"] = [rnd.choice(["x", "y", None]) for _ in range(n)]
    pdf["supplier_id"] = [rnd.choice(["s1", "s2", "s3"]) for _ in range(n)]
    return pdf


SALES = SCHEMA + ", unit_price double, discount double, category string, supplier_id string"


def test_all_features(spark):
    pdf = sales_frame().sort_values("row_id").reset_index(drop=True)
    df = make(spark, pdf, SALES)
    wide, names = features.all_features(df)
    assert len(names) == 44
    got = wide.toPandas().sort_values("row_id").reset_index(drop=True)
    assert len(got) == len(pdf) and not got[names].isna().any().any()
    rev = pdf["quantity"] * pdf["unit_price"] * (1 - pdf["discount"])
    same(got["category_revenue_sum"], rev.groupby(pdf["category"]).transform("sum").fillna(0))
    same(got["region_qty_mean"], pdf.groupby("region")["quantity"].transform("mean").fillna(0))
    same(got["supplier_avg_qty"], pdf.groupby("supplier_id")["quantity"].transform("mean"))
    p = pdf["unit_price"]
    same(got["unit_price_normalized"], (p - p.mean()) / (p.std() + 1e-8))
    same(got["unit_price_log"], np.log1p(p))
    same(got["has_discount"], pdf["discount"] > 0)
    key = pdf["category"].fillna("nan") + "_" + pdf["region"].fillna("nan")
    assert list(got["category_region_group"]) == list(pd.factorize(key)[0])
    d = pd.to_datetime(pdf["order_date"])
    same(got["week_of_year"], d.dt.isocalendar().week)
    same(got["is_month_end"], d.dt.is_month_end)
    same(got["sin_day_of_week"], np.sin(2 * math.pi * d.dt.dayofweek / 7))
    assert features.feature_names(wide, df) == names


def test_families_can_be_left_out(spark):
    df = make(spark, sales_frame(), SALES)
    off = dict(lags=False, rolling_=False, ewma_=False, aggregations_=False, interactions=False)
    assert len(features.all_features(df, **off)[1]) == 17
    few = df.select("row_id", "order_date", "quantity")
    _, names = features.all_features(few, **off)
    assert names == features.TEMPORAL  # price features need their columns


def test_iso_week_53(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),)], "order_date date")
    r = features.temporal(df).first()
    assert (r["week_of_year"], r["day_of_week"], r["quarter"]) == (53, 4, 1)


@pytest.mark.parametrize("func", ["sum", "mean", "max"])
def test_target(spark, func):
    pdf = sales_frame()
    ts = pdf.groupby("order_date")["quantity"].agg(func).sort_index()
    got = features.target(make(spark, pdf, SALES), forecast_horizon=3, agg_func=func)
    same(got.toPandas().sort_values("t")["target"], ts.shift(-3))
    with pytest.raises(ValueError):
        features.target(make(spark, pdf, SALES), agg_func="median")


def test_requests(spark):
    df = spark.createDataFrame([
        ("ok", "q", 5, 256, 0.7), ("empty", "", 5, 256, 0.7), ("null", None, 5, 256, 0.7),
        ("many", "q", 25, 256, 0.7), ("hot", "q", 5, 256, 2.0), ("short", "q", 5, 10, 0.7),
        ("default", "q", None, None, None), ("two", "q", 0, 2001, 0.0),
    ], "id string, query string, num_retrieval int, max_tokens int, temperature double")
    out = {r["id"]: r["rejected"] for r in requests.split_ask(df).collect()}
    assert out == {"ok": "", "empty": "query", "null": "query", "many": "num_retrieval",
                   "hot": "temperature", "short": "max_tokens", "default": "",
                   "two": "num_retrieval,max_tokens"}
    assert requests.accepted(requests.split_ask(df)).count() == 2
