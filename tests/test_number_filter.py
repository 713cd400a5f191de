"""Rows without or with negative numbers go, and each number is parsed once for that."""

from tallyloom.operators import clean


def test_each_text_is_parsed_once_in_the_filter(spark):
    rows = [("5", "1.5", "0.1"), ("-1", "2", None), ("N/A", "2", "0"), ("3", "NaN", "0"), (None, "1", "0"),
            ("-0", "0", "x"), ("2", "-0.5", "0"), ("12d", "1", "0"), ("4", "1e3", "NaN")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, quantity string, unit_price string, discount string")
    out = clean.clean_numeric(df)
    got = sorted((r["i"], r["quantity"], r["unit_price"], r["discount"]) for r in out.collect())
    assert got == [(0, 5, 1.5, 0.1), (5, 0, 0.0, 0.0), (8, 4, 1000.0, 0.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line]
    assert len(tests) == 1 and tests[0].lower().count("rlike") == 2


def test_dirt_goes_by_the_key_itself(spark, sf):
    from tallyloom.sources.tables import sales_text

    plan = sales_text(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
