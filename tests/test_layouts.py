"""Layouts that bound what a later step reads: forecasts by series, registry state, one numbering for many keys."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import features, registry
from tallyloom.sources import files


def scanned_rows(df):
    """Rows that came out of the file scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FORECAST_FILE_ROWS", 20_000)
    monkeypatch.setattr(files, "FORECAST_GROUP_BYTES", 64 << 10)
    n = 20_000
    df = spark.range(n * 14).select(
        (F.col("id") * 7919 % n).cast("string").alias("series"), F.lit("sma").alias("method"),
        F.floor(F.col("id") / n).cast("int").alias("step"), F.rand(3).alias("yhat"))
    path = str(tmp_path / "f")
    files.write_forecast(df, path, ["series"])
    assert 14 <= len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 40
    one = files.forecast_lookup(spark, path, series="777")
    assert one.count() == 14 and scanned_rows(one) < 0.2 * n * 14
    assert files.forecast_lookup(spark, path, series="no such").count() == 0
    many = files.forecast_lookup(spark, path, series=[f"19{i:03}" for i in range(1000)])
    assert many.count() == 14_000 and scanned_rows(many) < 0.5 * n * 14
    assert files.forecast_lookup(spark, path, series=[]).count() == 0
    assert files.forecast_lookup(spark, path, series=["1", "1", None], step=0).count() == 1


def events(spark, *rows):
    return spark.createDataFrame(
        [(t, n, f"/m/{n}", "{}", at, seq, e) for t, n, at, seq, e in rows], registry.SCHEMA)


def test_registry_is_the_same_after_compaction(spark, tmp_path):
    path = str(tmp_path)
    assert registry.scan(spark, path + "/none").count() == 0
    for i in range(12):
        registry.write(events(spark, ("baseline", f"m{i % 4}", f"2024-01-{i + 1:02}", i, "save" if i != 11 else "delete")
                              ).coalesce(1), path)
    before = sorted(map(str, registry.latest(registry.scan(spark, path)).collect()))
    assert registry.compact(spark, path) == []  # a reader may be at the files yet
    assert sorted(map(str, registry.latest(registry.scan(spark, path)).collect())) == before
    assert len(registry.compact(spark, path, older_than=0)) >= 12
    assert sorted(map(str, registry.latest(registry.scan(spark, path)).collect())) == before
    assert registry.scan(spark, path).count() == 4  # the deletion is one of them
    assert [f for f in os.listdir(path) if f.startswith("part-")] == []
    # written later but older than the deletion: does not come back; a newer one does
    registry.write(events(spark, ("baseline", "m3", "2024-01-02", 1, "save")), path)
    assert sorted(map(str, registry.latest(registry.scan(spark, path)).collect())) == before
    registry.write(events(spark, ("baseline", "m3", "2024-02-01", 1, "save")), path)
    registry.compact(spark, path, older_than=0)
    assert registry.latest(registry.scan(spark, path)).count() == 4
    assert len(os.listdir(f"{path}/_state/data")) == 1 and len([
        f for f in os.listdir(f"{path}/_state/log") if f.endswith(".json")]) == 1


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3_000).select(
        F.format_string("r%05d", "id").alias("row_id"), F.expr("date_add(DATE'2024-01-01', int(id * 37 % 200))").alias("order_date"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 17 * 1.5).alias("quantity"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("category"),
        (F.col("id") % 3).alias("region"))


@pytest.mark.parametrize("family", [features.lag, features.rolling, features.ewma])
@pytest.mark.parametrize("order", [None, ["order_date", "row_id"]])
def test_many_keys_give_what_each_gives(spark, rows, family, order):
    both = family(rows, group_cols=["category", "region"], order_cols=order)
    each = family(family(rows, group_cols=["category"]), group_cols=["region"])
    assert set(both.columns) == set(each.columns) and len(both.columns) > len(rows.columns)
    a, b = ({r["row_id"]: r.asDict() for r in df.collect()} for df in (both, each.select(*both.columns)))
    assert a.keys() == b.keys() and len(a) == 3_000
    for k in a:
        for name, value in a[k].items():
            assert value == pytest.approx(b[k][name], nan_ok=True) if isinstance(value, float) else value == b[k][name], (k, name)


def test_only_a_narrow_copy_is_numbered(spark, rows):
    wide = rows.withColumns({f"w{i}": F.lit(i) for i in range(30)})
    from tallyloom import session
    with session.scratch(spark) as written:
        got = features.lag(wide, group_cols=["category", "region"])
        copies = [p for p, _ in written if "/ranged-" in p]
        assert len(copies) == 1
        assert set(spark.read.parquet(copies[0]).columns) == {"row_id", "order_date", "quantity", "_col", "_key", "_mid"}
        assert got.count() == 3_000
