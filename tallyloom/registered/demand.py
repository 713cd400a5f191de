"""Series, forecast and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numeric import round_even
from tallyloom.operators import forecast, metrics, series
from tallyloom.plans import demand, models
from tallyloom.registered.common import Family, r, shown, with_sales
from tallyloom.session import scratch_path
from tallyloom.sources import files
from tallyloom.sources.tables import row_id, sales, sales_text, table

_f = Family()
QUERIES, SQL = _f.queries, _f.sql

ALPHA_SQL = "(6e-1 / 13e-1)"


def daily_sql(key: str | None, value: str = "quantity", source: str = "sales") -> str:
    k = f"{key}, " if key else ""
    return f""", daily AS (SELECT {k}order_date AS t, coalesce(sum({value}), 0e0) AS y
      FROM {source} GROUP BY {k}order_date)"""


def grid_sql(key: str | None, freq: str = "D") -> str:
    """Complete grid ``g(key, t, y, idx, n)`` over ``daily``."""
    k = f"{key}, " if key else ""
    by = f"PARTITION BY {key} " if key else ""
    group = f"GROUP BY {key}" if key else ""
    slots = {
        "D": "unnest(generate_series(s, e, INTERVAL 1 DAY))",
        "W": "unnest(generate_series(CAST(s + CAST((7 - isodow(s)) % 7 AS INTEGER) AS DATE), e, "
             "INTERVAL 7 DAY))",
        "M": "last_day(unnest(generate_series(CAST(date_trunc('month', s) AS DATE), e, "
             "INTERVAL 1 MONTH)))",
    }[freq]
    on = f"g0.t = d.t AND g0.{key} = d.{key}" if key else "g0.t = d.t"
    kg = f"g0.{key}, " if key else ""
    return f""", bounds AS (SELECT {k}min(t) AS s, max(t) AS e FROM daily {group}),
    slots AS (SELECT {k}e, CAST({slots} AS DATE) AS t FROM bounds),
    g AS (SELECT {kg}g0.t, coalesce(d.y, 0e0) AS y,
        row_number() OVER ({by.replace(key, 'g0.' + key) if key else ''}ORDER BY g0.t) - 1 AS idx,
        count(*) OVER ({by.replace(key, 'g0.' + key) if key else ''}) AS n
      FROM slots g0 LEFT JOIN daily d ON {on} WHERE g0.t <= g0.e)"""


def levels_sql(key: str | None, source: str = "g", n: str = "n", last: str = "max(t)",
               window: int = 7, a: str = ALPHA_SQL) -> str:
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f""", lv AS (SELECT {k}max({n}) AS n, {last} AS stop,
        avg(y) FILTER (idx >= {n} - {window}) AS sma,
        list_reduce(list(y ORDER BY idx), lambda b, x: (1 - {a}) * b + {a} * x) AS es,
        coalesce(regr_slope(y, idx), 0e0) AS slope,
        coalesce(regr_intercept(y, idx), avg(y)) AS icpt
      FROM {source} {group})"""


NEXT = {
    "D": "stop + CAST(step AS INTEGER)",
    "W": "stop + CAST(7 * step AS INTEGER)",
    "M": "last_day(CAST(date_trunc('month', stop) AS DATE) + to_months(CAST(step AS INTEGER)))",
}


def steps_sql(key: str | None, periods: int, freq: str = "D") -> str:
    """Long forecast ``f(key, method, step, t, yhat)`` from ``lv``."""
    k = f"{key}, " if key else ""
    return f""", st AS (SELECT {k}step, strftime({NEXT[freq]}, '%Y-%m-%d') AS t, sma, es,
        greatest(icpt + slope * (n - 1 + step), 0e0) AS trend
      FROM lv, range(1, {periods + 1}) AS x(step)),
    f AS (SELECT {k}'sma' AS method, step, t, sma AS yhat FROM st
      UNION ALL SELECT {k}'exponential_smoothing', step, t, es FROM st
      UNION ALL SELECT {k}'trend', step, t, trend FROM st
      UNION ALL SELECT {k}'ensemble', step, t, (sma + es + trend) / 3 FROM st)"""


def forecast_sql(key=None, periods=7, freq="D", value="quantity", where="", places=6,
                 source="sales"):
    k = f"{key}, " if key else ""
    return with_sales(
        daily_sql(key, value, source) + grid_sql(key, freq) + levels_sql(key)
        + steps_sql(key, periods, freq)
        + f""" SELECT {k}method, CAST(step AS INTEGER) AS step, t, {r('yhat', places)} AS yhat
          FROM f {where}""")


# --- series ---------------------------------------------------------------------------

@_f.add("agg_daily", with_sales("""
  SELECT category, strftime(order_date, '%Y-%m-%d') AS t, sum(quantity) AS y
  FROM sales GROUP BY category, order_date"""))
def agg_daily(spark, sf_dir):
    return shown(series.daily(sales(spark, sf_dir, "order_date", "quantity", "category"),
                              ["category"]))


@_f.add("agg_by_func", with_sales(f"""
  SELECT strftime(order_date, '%Y-%m-%d') AS t, sum(quantity) AS y_sum,
    {r('avg(quantity)')} AS y_mean, max(quantity) AS y_max FROM sales GROUP BY order_date"""))
def agg_by_func(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity")
    out = None
    for func in series.AGGREGATES:
        part = series.aggregate_by_date(df, [], func=func).withColumnRenamed("y", f"y_{func}")
        out = part if out is None else out.join(part, "t")
    return shown(out)


def _grid_query(freq):
    def run(spark, sf_dir):
        df = sales(spark, sf_dir, "order_date", "quantity", "region")
        g = series.prepare_series(df, ["region"], freq=freq)
        return shown(g.select("region", "t", "y", "idx"))
    return run


for _name, _freq in (("ts_grid", "D"), ("ts_grid_weekly", "W"), ("ts_grid_monthly", "M")):
    _f.add(_name, with_sales(daily_sql("region") + grid_sql("region", _freq) + """
      SELECT region, strftime(t, '%Y-%m-%d') AS t, y, CAST(idx AS INTEGER) AS idx FROM g"""))(
        _grid_query(_freq))


@_f.add("ts_grid_resample", with_sales(f"""
  {daily_sql('region')}, m AS (SELECT region, last_day(t) AS t, sum(y) AS y FROM daily GROUP BY ALL)
  SELECT region, strftime(t, '%Y-%m-%d') AS t, y FROM m"""))
def ts_grid_resample(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "region")
    g = series.prepare_series(df, ["region"], freq="M", mode="resample")
    return shown(g.select("region", "t", "y"))


@_f.add("ts_grid_events", f"""WITH src AS (SELECT event_type, CAST(ts AS DATE) AS order_date, value
    FROM events){daily_sql('event_type', 'value', 'src')}{grid_sql('event_type')}
  SELECT event_type, strftime(t, '%Y-%m-%d') AS t, {r('y', 4)} AS y FROM g""")
def ts_grid_events(spark, sf_dir):
    g = series.prepare_series(table(spark, sf_dir, "events"), ["event_type"], "ts", "value")
    return shown(g.select("event_type", "t", "y"), default=4)


@_f.add("fit_stats", with_sales(daily_sql("category") + grid_sql("category") + f"""
  SELECT category, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS std, min(y) AS min,
    max(y) AS max, count(*) AS periods, strftime(min(t), '%Y-%m-%d') || ' 00:00:00 to '
    || strftime(max(t), '%Y-%m-%d') || ' 00:00:00' AS date_range FROM g GROUP BY category"""))
def fit_stats(spark, sf_dir):
    return shown(series.fit_stats(sales(spark, sf_dir, "order_date", "quantity", "category"),
                                  ["category"]))


def _grid_by(spark, sf_dir, key):
    return series.prepare_series(sales(spark, sf_dir, "order_date", "quantity", key), [key])


@_f.add("sma_series", with_sales(daily_sql("category") + grid_sql("category") + f"""
  SELECT category, strftime(t, '%Y-%m-%d') AS t, {r('''CASE WHEN idx >= 6 THEN
    avg(y) OVER (PARTITION BY category ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    ELSE -1e0 END''')} AS sma FROM g"""))
def sma_series(spark, sf_dir):
    g = series.sma_series(_grid_by(spark, sf_dir, "category"), ["category"], 7)
    return shown(g.select("category", "t", F.coalesce("sma", F.lit(-1.0)).alias("sma")))


@_f.add("es_series", with_sales(daily_sql("category") + grid_sql("category") + f"""
  SELECT a.category, strftime(a.t, '%Y-%m-%d') AS t, {r(f'''sum(b.y * pow(1 - {ALPHA_SQL},
    a.idx - b.idx) * CASE WHEN b.idx = 0 THEN 1e0 ELSE {ALPHA_SQL} END)''')} AS es
  FROM g a JOIN g b ON a.category = b.category AND b.idx <= a.idx AND b.idx >= a.idx - 100
  GROUP BY a.category, a.t"""))
def es_series(spark, sf_dir):
    g = series.es_series(_grid_by(spark, sf_dir, "category"), ["category"])
    return shown(g.select("category", "t", "es"))


@_f.add("tail_window", with_sales(daily_sql("category") + grid_sql("category") + """
  SELECT category, strftime(t, '%Y-%m-%d') AS t, y FROM g WHERE idx >= n - 7"""))
def tail_window(spark, sf_dir):
    g = series.last_points(_grid_by(spark, sf_dir, "category"), ["category"], 7)
    return shown(g.select("category", "t", "y"))


@_f.add("last_value", with_sales(daily_sql("category") + grid_sql("category")
                                 + levels_sql("category")
                                 + f" SELECT category, {r('es')} AS last_es FROM lv"))
def last_value(spark, sf_dir):
    g = series.es_series(_grid_by(spark, sf_dir, "category"), ["category"])
    return shown(series.last_value(g, ["category"], "es").withColumnRenamed("es", "last_es"))


@_f.add("split_time", with_sales(daily_sql("category") + grid_sql("category") + """
  SELECT category, strftime(t, '%Y-%m-%d') AS t, y,
    CASE WHEN idx < floor(n * 8e-1) THEN 'train' ELSE 'test' END AS split FROM g"""))
def split_time(spark, sf_dir):
    g = forecast.split_time(_grid_by(spark, sf_dir, "category"))
    return shown(g.select("category", "t", "y", "split"))


# --- forecasts ------------------------------------------------------------------------

def _one_method(method, reported):
    def run(spark, sf_dir):
        df = sales(spark, sf_dir, "order_date", "quantity", "region")
        return shown(forecast.predict(df, 7, methods=[method], series_key=["region"]))
    _f.add(f"forecast_{method}", forecast_sql("region", where=f"WHERE method = '{reported}'"))(run)


for _m, _reported in forecast.METHODS.items():
    _one_method(_m, _reported)


@_f.add("forecast_predict", forecast_sql(periods=14))
def forecast_predict(spark, sf_dir):
    return shown(forecast.predict(sales(spark, sf_dir, "order_date", "quantity"), 14))


@_f.add("forecast_predict_weekly", forecast_sql("region", 8, "W"))
def forecast_predict_weekly(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "region")
    return shown(forecast.predict(df, 8, freq="W", series_key=["region"]))


@_f.add("forecast_predict_monthly", forecast_sql("region", 12, "M"))
def forecast_predict_monthly(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "region")
    return shown(forecast.predict(df, 12, freq="M", series_key=["region"]))


@_f.add("forecast_by_category", forecast_sql("category"))
def forecast_by_category(spark, sf_dir):
    return shown(forecast.by_category(sales(spark, sf_dir, "order_date", "quantity", "category")))


@_f.add("forecast_by_supplier", forecast_sql("supplier_id"))
def forecast_by_supplier(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "supplier_id")
    return shown(forecast.predict(df, 7, series_key=["supplier_id"]))


@_f.add("ensemble_mean", forecast_sql("supplier_id", where="WHERE method = 'ensemble'"))
def ensemble_mean(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "supplier_id")
    return shown(forecast.predict(df, 7, series_key=["supplier_id"])
                 .filter(F.col("method") == forecast.ENSEMBLE))


@_f.add("union_methods", forecast_sql("region", 3, where="WHERE method <> 'ensemble'"))
def union_methods(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "region")
    points = series.daily(df, ["region"])
    parts = [forecast.forecast_points(points, ["region"], 3, methods=[m])
             for m in forecast.METHODS]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@_f.add("forecast_revenue", forecast_sql(
    "region", value="quantity * unit_price * (1 - discount)", places=3))
def forecast_revenue(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "unit_price", "discount", "region")
    return shown(forecast.of_revenue(df, series_key=["region"]), default=3)


def six(expr: str) -> str:
    """Six significant digits, as text: errors relative to empty days are near 1e10."""
    return f"printf('%.5e', {expr})"


def _six(c):
    return F.format_string("%.5e", c)


def _scores_sql(key):
    k = f"{key}, " if key else ""
    kk = f"test.{key}, " if key else ""
    on = f"test.{key} = lv.{key}" if key else "true"
    group = f"GROUP BY {k}method"
    return (
        daily_sql(key) + grid_sql(key)
        + """, cutted AS (SELECT *, floor(n * 8e-1) AS cut FROM g),
          train AS (SELECT * FROM cutted WHERE idx < cut),
          test AS (SELECT * FROM cutted WHERE idx >= cut)"""
        + levels_sql(key, "train", "cut")
        + f""", p AS (SELECT {kk}y, sma, es, greatest(icpt + slope * idx, 0e0) AS trend
            FROM test JOIN lv ON {on}),
          s AS (SELECT {k}'sma' AS method, y, sma AS f FROM p
            UNION ALL SELECT {k}'exponential_smoothing', y, es FROM p
            UNION ALL SELECT {k}'trend', y, trend FROM p
            UNION ALL SELECT {k}'ensemble', y, (sma + es + trend) / 3 FROM p),
          m AS (SELECT {k}method, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse,
            1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)) AS r2,
            avg(abs((y - f) / (y + 1e-8))) * 100 AS mape FROM s {group})""")


@_f.add("forecast_evaluate", with_sales(_scores_sql("category") + f"""
  SELECT category, method, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('r2')} AS r2,
    {six('mape')} AS mape FROM m"""))
def forecast_evaluate(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "category")
    out = forecast.evaluate(df, series_key=["category"])
    return shown(out.drop("mape")).join(out.select("category", "method", _six(F.col("mape")).alias("mape")),
                                        ["category", "method"])


def _named(sql, name):
    """The same CTEs under names of their own."""
    for t in ("daily", "bounds", "slots", "lv", "st"):
        sql = sql.replace(f" {t} AS", f" {t}_{name} AS").replace(
            f"FROM {t} ", f"FROM {t}_{name} ").replace(f"FROM {t},", f"FROM {t}_{name},").replace(
            f"JOIN {t} ", f"JOIN {t}_{name} ").replace(f"FROM {t})", f"FROM {t}_{name})")
    return (sql.replace(" g AS", f" g_{name} AS").replace("FROM g ", f"FROM g_{name} ")
            .replace("FROM g)", f"FROM g_{name})")
            .replace(" f AS (", f" f_{name} AS (").replace("FROM st\n", f"FROM st_{name}\n"))


def _chain(key, value, name, freq="D", periods=7, source="sales"):
    return _named(daily_sql(key, value, source) + grid_sql(key, freq) + levels_sql(key)
                  + steps_sql(key, periods, freq), name)


def _summary_sql():
    value = "quantity * unit_price * (1 - discount)"
    stats = " UNION ALL ".join(
        f"SELECT 'fit_statistics' AS section, '' AS series, '' AS method, '{n}' AS item, "
        f"{r(e)} AS value FROM g_q" for n, e in (
            ("mean", "avg(y)"), ("std", "stddev_samp(y)"), ("min", "min(y)"), ("max", "max(y)"),
            ("periods", "CAST(count(*) AS DOUBLE)")))
    return with_sales(
        _chain(None, "quantity", "q") + _chain(None, value, "r")
        + _chain("category", "quantity", "c") + _named(_scores_sql(None), "e") + " " + stats
        + f""" UNION ALL SELECT 'quantity_forecast', '', method, CAST(step AS VARCHAR),
            {r('yhat')} FROM f_q
          UNION ALL SELECT 'revenue_forecast', '', method, CAST(step AS VARCHAR),
            {r('yhat', 2)} FROM f_r
          UNION ALL SELECT 'category_forecast', category, method, CAST(step AS VARCHAR),
            {r('yhat')} FROM f_c
          UNION ALL SELECT 'metrics', '', method, 'mae', {r('mae')} FROM m
          UNION ALL SELECT 'metrics', '', method, 'rmse', {r('rmse')} FROM m
          UNION ALL SELECT 'metrics', '', method, 'r2', {r('r2')} FROM m
          UNION ALL SELECT 'metrics', '', method, 'mape', CAST({six('mape')} AS DOUBLE) FROM m""")


@_f.add("forecast_summary", _summary_sql())
def forecast_summary(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "unit_price", "discount", "category")
    out = demand.summary(df, 7)
    money = F.col("section") == "revenue_forecast"
    value = F.when(money, round_even(F.col("value"), 2)).when(
        F.col("item") == "mape", _six(F.col("value")).cast("double")).otherwise(
            round_even(F.col("value"), 6))
    return out.withColumn("value", value + F.lit(0.0))


@_f.add("forecast_arrays", f"""WITH a AS (SELECT user_id, list(value ORDER BY event_id) AS v
    FROM events GROUP BY user_id),
  g AS (SELECT user_id, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS idx, len(v) AS n FROM a)
  {levels_sql('user_id', last='NULL')},
  st AS (SELECT user_id, step, sma, es, greatest(icpt + slope * (n - 1 + step), 0e0) AS trend
    FROM lv, range(1, 6) AS x(step))
  SELECT user_id, 'sma' AS method, CAST(step AS INTEGER) AS step, {r('sma')} AS yhat FROM st
  UNION ALL SELECT user_id, 'exponential_smoothing', CAST(step AS INTEGER), {r('es')} FROM st
  UNION ALL SELECT user_id, 'trend', CAST(step AS INTEGER), {r('trend')} FROM st
  UNION ALL SELECT user_id, 'ensemble', CAST(step AS INTEGER), {r('(sma + es + trend) / 3')}
    FROM st""")
def forecast_arrays(spark, sf_dir):
    arrays = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))),
                    lambda e: e["value"]).alias("historical_data"))
    return shown(forecast.of_arrays(arrays, "user_id", periods=5))


@_f.add("forecast_job", with_sales(f""", numeric AS (
    SELECT order_date, CASE WHEN l_orderkey % 23 = 0 THEN -quantity ELSE quantity END AS quantity
    FROM sales WHERE l_orderkey % 17 <> 0)
  {daily_sql(None, source='numeric')}{grid_sql(None)}{levels_sql(None)}{steps_sql(None, 7)}
  SELECT method, CAST(step AS INTEGER) AS step, t, {r('yhat')} AS yhat FROM f"""))
def forecast_job(spark, sf_dir):
    return shown(demand.forecast_job(sales_text(spark, sf_dir)))


def _requests_sql():
    chains, every = "", []
    for f in NEXT:
        for d, source in (("order_date", "sales"), ("delivery_date", "delivered")):
            for v in ("quantity", "unit_price"):
                name = f"{f}_{d}_{v}".lower()
                chains += _chain(None, v, name, f, 24, source)
                every.append(f"""SELECT '{f}' AS freq, '{d}' AS date_col, '{v}' AS value_col, step, t,
                  max(yhat) FILTER (method = 'sma') AS sma, max(yhat) FILTER (method = 'trend') AS trend,
                  max(yhat) FILTER (method = 'exponential_smoothing') AS es FROM f_{name} GROUP BY step, t""")
    rows = " UNION ALL ".join(
        f"SELECT request_id, freq, date_col, value_col, step, t, '{name}' AS method, {value} AS yhat FROM j WHERE {cond}"
        for name, value, cond in (
            ("sma", "sma", "list_contains(ms, 'sma')"),
            ("exponential_smoothing", "es", "list_contains(ms, 'es')"),
            ("trend", "trend", "list_contains(ms, 'trend')"),
            ("ensemble", """(CASE WHEN list_contains(ms, 'sma') THEN sma ELSE 0 END
               + CASE WHEN list_contains(ms, 'es') THEN es ELSE 0 END
               + CASE WHEN list_contains(ms, 'trend') THEN trend ELSE 0 END) / len(ms)""", "len(ms) > 1")))
    return with_sales(f""", delivered AS (SELECT * REPLACE (delivery_date AS order_date) FROM sales)
      {chains}, asked AS (SELECT c_custkey AS request_id, c_nationkey AS periods,
        CASE c_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'W' ELSE 'M' END AS freq,
        CASE c_custkey % 4 WHEN 0 THEN ['sma', 'es', 'trend'] WHEN 1 THEN ['sma']
          WHEN 2 THEN ['trend', 'es'] ELSE ['bogus', 'sma'] END AS ms,
        CASE WHEN c_custkey % 7 = 0 THEN 'delivery_date' ELSE 'order_date' END AS date_col,
        CASE c_custkey % 5 WHEN 0 THEN 'unit_price' WHEN 1 THEN 'nope' ELSE 'quantity' END AS value_col
        FROM customer),
      every AS ({" UNION ALL ".join(every)}),
      j AS (SELECT * FROM asked JOIN every USING (freq, date_col, value_col)
        WHERE periods BETWEEN 1 AND 365 AND step <= periods AND NOT list_contains(ms, 'bogus'))
      SELECT request_id, freq, date_col, value_col, method, CAST(step AS INTEGER) AS step, t,
        {r('yhat')} AS yhat FROM ({rows})""")


@_f.add("forecast_requests", _requests_sql())
def forecast_requests(spark, sf_dir):
    key = F.col("c_custkey")
    every = F.lit(None).cast("array<string>")
    asked = table(spark, sf_dir, "customer").select(
        key.alias("request_id"), F.col("c_nationkey").alias("periods"),
        F.when(key % 3 == 0, "D").when(key % 3 == 1, "W").otherwise("M").alias("freq"),
        F.when(key % 4 == 0, every).when(key % 4 == 1, F.array(F.lit("sma")))
        .when(key % 4 == 2, F.array(F.lit("trend"), F.lit("es")))
        .otherwise(F.array(F.lit("bogus"), F.lit("sma"))).alias("methods"),
        F.when(key % 7 == 0, "delivery_date").alias("date_col"),
        F.when(key % 5 == 0, "unit_price").when(key % 5 == 1, "nope").alias("value_col"))
    orders = sales(spark, sf_dir, "order_date", "delivery_date", "quantity", "unit_price")
    return shown(demand.forecast_requests_job(orders, asked))


@_f.add("sink_forecast", with_sales(
    daily_sql("category") + grid_sql("category") + levels_sql("category")
    + steps_sql("category", 7) + f""", a AS (SELECT category, method,
      to_json(list({r('yhat', 4)} ORDER BY step)) AS v FROM f GROUP BY category, method)
    SELECT category, '{{' || string_agg('"' || method || '":' || v, ',' ORDER BY method) || '}}'
      AS forecast FROM a GROUP BY category"""))
def sink_forecast(spark, sf_dir):
    df = forecast.by_category(sales(spark, sf_dir, "order_date", "quantity", "category"))
    return files.forecast_json(shown(df, default=4), ["category"])


@_f.add("forecast_lookup", forecast_sql("category", where="WHERE category = 'PROMO'"))
def forecast_lookup(spark, sf_dir):
    df = forecast.by_category(sales(spark, sf_dir, "order_date", "quantity", "category"))
    path = scratch_path(spark, "forecast")
    files.write_forecast(shown(df), path, ["category"])
    return files.forecast_lookup(spark, path, category="PROMO").select(
        "category", "method", "step", "t", "yhat")


@_f.add("forecast_lookup_many", forecast_sql(
    "product_id", where="WHERE CAST(product_id AS BIGINT) < 1000"))
def forecast_lookup_many(spark, sf_dir):
    """A thousand products out of the forecasts of all."""
    df = forecast.predict(sales(spark, sf_dir, "order_date", "quantity", "product_id"), 7, series_key=["product_id"])
    path = scratch_path(spark, "forecast")
    files.write_forecast(shown(df), path, ["product_id"])
    return files.forecast_lookup(spark, path, product_id=[str(i) for i in range(1000)]).select(
        "product_id", "method", "step", "t", "yhat")


@_f.add("baseline_save_load", with_sales(daily_sql("category") + grid_sql("category") + """
  SELECT category, strftime(t, '%Y-%m-%d') AS t, y, CAST(7 AS INTEGER) AS window_size,
    3e-1 AS alpha FROM g"""))
def baseline_save_load(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity", "category")
    path = scratch_path(spark, "baseline")
    forecast.save_baseline(series.prepare_series(df, ["category"]), path, 7, 0.3)
    g, window_size, alpha = forecast.load_baseline(spark, path)
    return shown(g.select("category", "t", "y", F.lit(window_size).alias("window_size"),
                          F.lit(alpha).alias("alpha")))


@_f.add("registry_load_forecast", with_sales(
    daily_sql("region") + grid_sql("region") + levels_sql("region", window=5, a="(2e0 / 3e0)")
    + steps_sql("region", 7) + f""" SELECT region, method, CAST(step AS INTEGER) AS step, t,
      {r('yhat')} AS yhat FROM f"""))
def registry_load_forecast(spark, sf_dir):
    """Save and register a model, replace it, load it by name, forecast with its parameters."""
    df = sales(spark, sf_dir, "order_date", "quantity", "region")
    root = scratch_path(spark, "models")
    g = series.prepare_series(df, ["region"])
    models.save_baseline(g, root, "demand")
    models.save_baseline(g, root, "demand", 5, 0.5, {"note": "shorter window"})
    _, window_size, alpha = models.load_baseline(spark, root, "demand")
    return shown(forecast.predict(df, 7, series_key=["region"], window_size=window_size,
                                  alpha=alpha))


# --- metrics --------------------------------------------------------------------------

_PAIRS = "(SELECT l_returnflag AS k, l_quantity AS y, l_extendedprice / 15e2 AS f FROM lineitem)"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / F.lit(1500.0)).alias("yhat"))


METRIC_SQL = {
    "rmse": "sqrt(avg((y - f) * (y - f)))",
    "mae": "avg(abs(y - f))",
    "r2": "1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y))",
    "mape_frac": "avg(abs(y - f) / greatest(abs(y), 2.220446049250313e-16))",
    "mape_pct_eps": "avg(abs((y - f) / (y + 1e-8))) * 100",
}


def _metric(name):
    fn = getattr(metrics, name)

    def run(spark, sf_dir):
        out = _pairs(spark, sf_dir).groupBy("k").agg(fn(F.col("y"), F.col("yhat")).alias(name))
        return shown(out)

    _f.add(name, f"SELECT k, {r(METRIC_SQL[name])} AS {name} FROM {_PAIRS} GROUP BY k")(run)


for _m in METRIC_SQL:
    _metric(_m)


@_f.add("evaluate_model", f"""SELECT k, {r(METRIC_SQL['rmse'])} AS rmse, {r(METRIC_SQL['mae'])} AS mae,
  {r(METRIC_SQL['r2'])} AS r2, {r(METRIC_SQL['mape_frac'])} AS mape FROM {_PAIRS} GROUP BY k""")
def evaluate_model(spark, sf_dir):
    return shown(metrics.evaluate(_pairs(spark, sf_dir), ["k"]))


@_f.add("evaluate_by_horizon", f"""SELECT horizon, {r(METRIC_SQL['rmse'])} AS rmse,
  {r(METRIC_SQL['mae'])} AS mae, {r(METRIC_SQL['r2'])} AS r2, {r(METRIC_SQL['mape_frac'])} AS mape
  FROM (SELECT l_linenumber AS horizon, l_quantity AS y, l_extendedprice / 15e2 AS f FROM lineitem)
  GROUP BY horizon""")
def evaluate_by_horizon(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", row_id()).withColumn(
        "horizon", F.col("l_linenumber"))
    actual = rows.select("horizon", "row_id", F.col("l_quantity").alias("y"))
    predicted = rows.select("horizon", "row_id",
                            (F.col("l_extendedprice") / F.lit(1500.0)).alias("yhat"))
    return shown(metrics.by_horizon(actual, predicted, ["row_id"]))


@_f.add("horizon_distinct", "SELECT DISTINCT l_linenumber AS horizon FROM lineitem")
def horizon_distinct(spark, sf_dir):
    return metrics.horizons(table(spark, sf_dir, "lineitem").withColumn(
        "horizon", F.col("l_linenumber")))
