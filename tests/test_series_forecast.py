"""Grids, forecasts and back-tests against pandas and NumPy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import make
from pyspark.sql import functions as F

from tallyloom.operators import clean, forecast, metrics, series
from tallyloom.plans import demand

A = 2 * 0.3 / 1.3


def orders_frame(days=100, n=60, seed=3):
    rnd = random.Random(seed)
    start = dt.date(2024, 1, 3)
    rows = []
    for i in range(n):
        q = rnd.choice([None, -2, 0, 3, 5, 8, 13, 21])
        rows.append((start + dt.timedelta(days=rnd.randrange(days)), rnd.choice("ABC"),
                     None if q is None else float(q), rnd.randrange(100, 900) / 10,
                     rnd.choice([None, 0.0, 0.1])))
    rows += [(start, "A", 4.0, 10.0, 0.0), (start + dt.timedelta(days=days - 1), "A", 7.0, 10.0, None)]
    return pd.DataFrame(rows, columns=["order_date", "category", "quantity", "unit_price", "discount"])


SCHEMA = "order_date date, category string, quantity double, unit_price double, discount double"


def pandas_series(pdf, freq="D"):
    ts = pdf["quantity"].groupby(pd.to_datetime(pdf["order_date"])).sum()
    return ts.asfreq({"D": "D", "W": "W", "M": "ME"}[freq], fill_value=0)


def expected(ts, periods):
    n = len(ts)
    x = np.arange(n)
    slope, icpt = np.polyfit(x, ts.values, 1) if n > 1 else (0.0, ts.values[0])
    out = {
        "sma": np.full(periods, ts.iloc[-7:].mean()),
        "exponential_smoothing": np.full(periods, ts.ewm(span=1 / 0.3, adjust=False).mean().iloc[-1]),
        "trend": np.maximum(icpt + slope * np.arange(n, n + periods), 0),
    }
    out["ensemble"] = np.mean(list(out.values()), axis=0)
    return out


@pytest.fixture(scope="module")
def orders(spark):
    return make(spark, orders_frame(), SCHEMA)


@pytest.mark.parametrize("freq", ["D", "W", "M"])
def test_grid_and_forecast_equal_pandas(spark, orders, freq):
    ts = pandas_series(orders_frame().dropna(subset=["quantity"]), freq)
    g = series.prepare_series(orders, freq=freq).orderBy("idx").toPandas()
    assert list(pd.to_datetime(g["t"])) == list(ts.index)
    np.testing.assert_allclose(g["y"], ts.values)
    f = forecast.predict(orders, 5, freq=freq).toPandas()
    for method, want in expected(ts, 5).items():
        got = f[f.method == method].sort_values("step")
        np.testing.assert_allclose(got["yhat"], want, rtol=1e-9, atol=1e-9)
        future = pd.date_range(ts.index[-1], periods=6, freq=ts.index.freq)[1:]
        assert list(pd.to_datetime(got["t"])) == list(future)


def test_resample_keeps_the_total(spark, orders):
    pdf = orders_frame().dropna(subset=["quantity"])
    want = pdf["quantity"].groupby(pd.to_datetime(pdf["order_date"])).sum().resample("W").sum()
    g = series.prepare_series(orders, freq="W", mode="resample").orderBy("idx").toPandas()
    np.testing.assert_allclose(g["y"], want.values)
    assert list(pd.to_datetime(g["t"])) == list(want.index)
    f = forecast.predict(orders, 2, freq="W", mode="resample").toPandas()
    for method, v in expected(want, 2).items():
        np.testing.assert_allclose(f[f.method == method].sort_values("step")["yhat"], v)


def test_by_category_has_own_grids(spark, orders):
    pdf = orders_frame().dropna(subset=["quantity"])
    f = forecast.by_category(orders, 3).toPandas()
    for c, part in pdf.groupby("category"):
        for method, want in expected(pandas_series(part), 3).items():
            got = f[(f.category == c) & (f.method == method)].sort_values("step")["yhat"]
            np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_revenue_null_discount_counts_zero_unless_asked(spark, orders):
    pdf = orders_frame()
    for flag, d in ((False, pdf["discount"]), (True, pdf["discount"].fillna(0))):
        pdf["revenue"] = pdf["quantity"] * pdf["unit_price"] * (1 - d)
        ts = pdf["revenue"].groupby(pd.to_datetime(pdf["order_date"])).sum().asfreq("D", fill_value=0)
        f = forecast.of_revenue(orders, 2, null_discount_as_zero=flag).toPandas()
        for method, want in expected(ts, 2).items():
            np.testing.assert_allclose(f[f.method == method].sort_values("step")["yhat"], want)


def test_single_point_series(spark):
    df = make(spark, pd.DataFrame({"order_date": [dt.date(2024, 5, 1)], "quantity": [6.0]}),
              "order_date date, quantity double")
    f = forecast.predict(df, 2).toPandas()
    assert set(f["yhat"]) == {6.0} and len(f) == 8
    assert forecast.evaluate(df).count() == 0  # no training part, no metrics


def test_empty_series_and_empty_grid_have_no_rows(spark):
    empty = spark.createDataFrame([], "order_date date, quantity double")
    assert forecast.predict(empty, 3).count() == 0
    tuesday = make(spark, pd.DataFrame({"order_date": [dt.date(2024, 5, 7)], "quantity": [6.0]}),
                   "order_date date, quantity double")
    assert forecast.predict(tuesday, 3, freq="W").count() == 0
    assert series.prepare_series(tuesday, freq="M").count() == 0


def test_grid_without_observed_points_is_zero(spark):
    rows = [(dt.date(2024, 1, 30), 5.0), (dt.date(2024, 3, 2), 7.0)]
    df = spark.createDataFrame(rows, "order_date date, quantity double")
    f = forecast.predict(df, 2, freq="M").toPandas()
    assert len(f) == 8 and set(f["yhat"]) == {0.0}
    assert [str(t) for t in sorted(set(f["t"]))] == ["2024-03-31", "2024-04-30"]


def test_methods_and_frequency_are_checked(spark, orders):
    one = forecast.predict(orders, 2, methods=["es"]).toPandas()
    assert set(one.method) == {"exponential_smoothing"}
    two = forecast.predict(orders, 2, methods=["trend", "sma"]).toPandas()
    assert set(two.method) == {"sma", "trend", "ensemble"}
    with pytest.raises(ValueError):
        forecast.predict(orders, 2, methods=["arima"])
    with pytest.raises(ValueError):
        forecast.predict(orders, 2, freq="X")
    with pytest.raises(ValueError):
        forecast.predict(orders, 0)
    with pytest.raises(ValueError):
        series.effective_alpha(1.5)


def test_time_of_day_does_not_leave_the_grid(spark):
    rows = [(dt.datetime(2024, 1, 1, 9), 1.0), (dt.datetime(2024, 1, 2, 17), 2.0)]
    df = spark.createDataFrame(rows, "order_date timestamp_ntz, quantity double")
    assert [r.y for r in series.prepare_series(df).orderBy("idx").collect()] == [1.0, 2.0]


def test_backtest(spark, orders):
    ts = pandas_series(orders_frame().dropna(subset=["quantity"]))
    cut = int(len(ts) * 0.8)
    train, test = ts.iloc[:cut], ts.iloc[cut:]
    got = {r["method"]: r for r in forecast.evaluate(orders).collect()}
    for method, p in expected(train, len(test)).items():
        e = test.values - p
        assert got[method]["mae"] == pytest.approx(np.abs(e).mean())
        assert got[method]["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert got[method]["r2"] == pytest.approx(1 - (e**2).sum() / ((test - test.mean())**2).sum())
        assert got[method]["mape"] == pytest.approx(np.abs(e / (test.values + 1e-8)).mean() * 100)


def test_fit_stats(spark, orders):
    ts = pandas_series(orders_frame().dropna(subset=["quantity"]))
    s = series.fit_stats(orders).first()
    assert (s["mean"], s["std"]) == (pytest.approx(ts.mean()), pytest.approx(ts.std()))
    assert (s["min"], s["max"], s["periods"]) == (ts.min(), ts.max(), len(ts))
    assert s["date_range"] == f"{ts.index.min()} to {ts.index.max()}"


def test_series_columns(spark, orders):
    ts = pandas_series(orders_frame().dropna(subset=["quantity"]))
    g = series.prepare_series(orders)
    out = series.es_series(series.sma_series(g, [], 7), []).orderBy("idx").toPandas()
    np.testing.assert_allclose(out["sma"], ts.rolling(7).mean(), atol=1e-12)
    np.testing.assert_allclose(out["es"], ts.ewm(span=1 / 0.3, adjust=False).mean(), atol=1e-12)


def test_arrays(spark):
    df = spark.createDataFrame(
        [(1, [10.0, 12.0, 9.0, 14.0]), (2, [5.0]), (3, [])], "id int, historical_data array<double>")
    f = forecast.of_arrays(df, "id", periods=3).toPandas()
    assert set(f["id"]) == {1, 2}
    for method, want in expected(pd.Series([10.0, 12.0, 9.0, 14.0]), 3).items():
        got = f[(f.id == 1) & (f.method == method)].sort_values("step")["yhat"]
        np.testing.assert_allclose(got, want)


def test_a_hot_category_is_summed_before_it_is_gathered(spark):
    base = spark.range(30_000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 50 as int))").alias("order_date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")))
        .alias("category"), F.lit(1.0).alias("quantity"))
    points = series.daily(base, ["category"])
    assert points.groupBy("category").count().agg(F.max("count")).first()[0] <= 50
    f = forecast.by_category(base, 1).filter("category = 'hot' and method = 'sma'").first()
    assert f["yhat"] == pytest.approx(200.0)


def test_job_and_requests(spark, orders):
    text = orders.withColumns({
        "quantity": F.col("quantity").cast("string"), "unit_price": F.col("unit_price").cast("string"),
        "discount": F.col("discount").cast("string"), "order_date": F.col("order_date").cast("string")})
    ts = pandas_series(orders_frame().dropna(subset=["quantity"]))
    job = demand.forecast_job(text, 3).toPandas()
    for method, want in expected(ts, 3).items():
        np.testing.assert_allclose(job[job.method == method].sort_values("step")["yhat"], want)
    asked = spark.createDataFrame(
        [(1, 3, "D"), (2, 0, "D"), (3, 400, "D"), (4, 2, "X"), (5, 2, "W"), (6, None, None)],
        "request_id int, periods int, freq string")
    got = demand.forecast_requests_job(text, asked).toPandas()
    assert got.groupby("request_id").size().to_dict() == {1: 12, 5: 8, 6: 28}
    asked = spark.createDataFrame(
        [(1, ["sma"], None, None), (2, ["trend", "es"], "order_date", "unit_price"), (3, ["nope"], None, None),
         (4, None, "status", None), (5, [], None, "order_id"), (6, [], None, "quantity")],
        "request_id int, methods array<string>, date_col string, value_col string")
    got = demand.forecast_requests_job(text, asked.withColumn("periods", F.lit(2))).toPandas()
    assert got.groupby("request_id").method.unique().map(sorted).to_dict() == {
        1: ["sma"], 2: ["ensemble", "exponential_smoothing", "trend"],
        6: ["ensemble", "exponential_smoothing", "sma", "trend"]}
    two = got[(got.request_id == 2) & (got.step == 1)].set_index("method")["yhat"]
    direct = forecast.predict(clean.numeric_only(text), 1, value_col="unit_price", methods=["es", "trend"])
    for r in direct.collect():
        assert two[r["method"]] == pytest.approx(r["yhat"])


def test_summary_sections(spark, orders):
    out = demand.summary(orders, 2).toPandas()
    assert out.groupby("section").size().to_dict() == {
        "fit_statistics": 5, "metrics": 16, "quantity_forecast": 8, "revenue_forecast": 8,
        "category_forecast": 24}
    direct = forecast.predict(orders, 2).toPandas().set_index(["method", "step"])["yhat"]
    q = out[out.section == "quantity_forecast"]
    for _, r in q.iterrows():
        assert r["value"] == pytest.approx(direct[(r["method"], int(r["item"]))])


def test_baseline_save_load(spark, orders, tmp_path):
    g = series.prepare_series(orders)
    forecast.save_baseline(g, str(tmp_path / "m"), 5, 0.5)
    back, window, alpha = forecast.load_baseline(spark, str(tmp_path / "m"))
    assert (window, alpha) == (5, 0.5) and back.count() == g.count()
    with pytest.raises(ValueError):
        forecast.save_baseline(g.limit(0), str(tmp_path / "e"))


def test_metric_edges(spark):
    rows = [("const_bad", 2.0, 3.0), ("const_bad", 2.0, 2.0), ("const_good", 2.0, 2.0),
            ("const_good", 2.0, 2.0), ("one", 1.0, 2.0), ("zero", 0.0, 1.0), ("zero", 4.0, 4.0)]
    m = {r["k"]: r for r in metrics.evaluate(
        spark.createDataFrame(rows, "k string, y double, yhat double"), ["k"]).collect()}
    assert m["const_bad"]["r2"] == 0.0 and m["const_good"]["r2"] == 1.0 and m["one"]["r2"] is None
    assert m["zero"]["mape"] == pytest.approx(0.5 / metrics.EPS)
    assert "mape" not in metrics.evaluate(
        spark.createDataFrame(rows, "k string, y double, yhat double"), include_mape=False).columns


def test_horizons(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 5.0)], "horizon int, r int, y double")
    p = spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0), (3, 1, 0.0)], "horizon int, r int, yhat double")
    out = metrics.by_horizon(a, p, ["r"]).collect()
    assert [(r.horizon, r.mae) for r in out] == [(1, 0.5)]
    assert metrics.by_horizon(a.drop("horizon"), p, ["r"]) is None
