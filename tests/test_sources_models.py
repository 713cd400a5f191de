"""Files, registry, forest and session helpers."""

import csv
import gzip
import json
import os
import pathlib
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyloom.operators import clean, forest, registry
from tallyloom.plans import answers, models
from tallyloom.session import scratch_path, settle, shared_dir
from tallyloom.sources import documents, files
from tallyloom.sources.tables import sales, sales_text


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes("bé\r\nline\rend".encode())
    (tmp_path / "A.TXT").write_text("upper")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "d.json").write_text('{"k": [1, 2.5], "é": null}')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "r.pdf").write_bytes(b"p1\x0cp2 \n")
    (tmp_path / "x.docx").write_bytes(b"?")
    (tmp_path / "noext").write_bytes(b"?")
    (tmp_path / "sub" / "c.txt").write_text("deep")
    return str(tmp_path)


def by_name(df):
    return {os.path.basename(r["source"]): r for r in df.collect()}


def test_folder(spark, folder):
    flat = by_name(documents.good(documents.load_files(spark, folder)))
    assert set(flat) == {"b.txt", "A.TXT", "d.json", "r.pdf"}
    assert flat["b.txt"]["content"] == "bé\nline\nend"
    assert flat["d.json"]["content"] == json.dumps({"k": [1, 2.5], "é": None}, indent=2)
    assert flat["r.pdf"]["content"] == documents.PDF_PLACEHOLDER + "r.pdf"
    meta = flat["r.pdf"]["metadata"]
    assert (meta["filename"], meta["type"], meta["path"]) == ("r.pdf", "pdf", flat["r.pdf"]["source"])
    deep = by_name(documents.good(documents.load_files(spark, folder, recursive=True)))
    assert set(deep) == set(flat) | {"c.txt"}
    bad = by_name(documents.failed(documents.load_files(spark, folder, only_known=False)))
    assert set(bad) == {"bad.txt", "broken.json", "x.docx", "noext"}
    assert bad["x.docx"]["error"] == "Unsupported file format: .docx"


def test_named_files(spark, folder):
    asked = [f"{folder}/b.txt", f"{folder}/x.docx"]
    df = documents.load_files(spark, asked, only_known=False)
    assert [r["error"] for r in df.orderBy("source").collect()] == [None, "Unsupported file format: .docx"]


def test_pdf_extractor(spark, folder):
    def make():
        def pages(blob):
            if blob.startswith(b"?"):
                raise ValueError("no pdf")
            return blob.decode().split("\x0c")
        return pages

    df = documents.pdf_documents(documents.scan_files(spark, folder).filter(
        F.col("path").rlike("pdf$|docx$")), make)
    got = by_name(df)
    assert got["r.pdf"]["content"] == "p1\np2" and got["x.docx"]["error"] == "ValueError: no pdf"


def test_text_source_keeps_whole_files(spark, folder):
    got = by_name(documents.text_documents(spark, f"{folder}/b.txt"))
    assert got["b.txt"]["content"] == "bé\nline\nend"
    assert got["b.txt"]["metadata"]["type"] == "text"


def test_index_folder(spark, folder, tmp_path):
    index = answers.index_folder(spark, folder)
    rows = index.documents.orderBy("ord").collect()
    assert [r["id"] for r in rows] == [f"doc_{i}" for i in range(4)]
    assert [r["source"] for r in rows] == sorted(r["source"] for r in rows)
    (tmp_path / "void").mkdir()
    with pytest.raises(ValueError):
        answers.index_folder(spark, str(tmp_path / "void"))


def test_struct(spark):
    raw = spark.createDataFrame([("t", "s", 5)], "text string, src string, n int")
    d = documents.to_struct(documents.from_table(raw, "text", "src", {"n": F.col("n")})).first()
    assert d["document"].asDict() == {"content": "t", "source": "s", "metadata": {"n": "5"}}


def test_sales_csv_round_trip(spark, sf, tmp_path):
    text = sales_text(spark, sf).drop("row_id")
    files.write_sales_csv(text, str(tmp_path / "csv"))
    back = files.read_sales_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(text).count() == 0 and text.exceptAll(back).count() == 0
    numeric = files.read_sales_numeric(spark, str(tmp_path / "csv"))
    assert numeric.filter("quantity < 0").count() > 0
    with pytest.raises(AnalysisException):
        files.read_sales_csv(spark, str(tmp_path / "nowhere"))


def test_quotes_in_csv(spark, tmp_path):
    head = "order_id,product_id,product_name,category,supplier_id,supplier_name,region,quantity," \
           "unit_price,discount,order_date,delivery_date,status,customer_id,warehouse_id"
    (tmp_path / "o.csv").write_text(
        head + '\nO-1,P,Monitor 27",E,S,T,North,3,349.99,,2024-01-12,,In Transit,C,W\n')
    r = files.read_sales_csv(spark, str(tmp_path / "o.csv")).first()
    assert r["product_name"] == 'Monitor 27"' and r["discount"] is None and r["quantity"] == "3"


def test_csv_of_pandas(spark, tmp_path):
    import pandas as pd
    names = ['Desk "XL", black', '"', '""', 'a,b', ' lead', "tail ", 'x"y', "'"]
    pd.DataFrame({"order_id": range(len(names)), "product_name": names, "quantity": 5}).to_csv(
        tmp_path / "p.csv", index=False)
    rows = files.read_sales_csv(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.order_id, r.product_name, r.quantity) for r in rows] == [
        (str(i), n, "5") for i, n in enumerate(names)]


def test_csv_with_headers_in_two_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,quantity,region\n1,10,N\n")
    (tmp_path / "b.csv").write_text('\ufeffquantity,"order_id"\n20,2\n')
    (tmp_path / "c.csv").write_text("")
    rows = files.read_sales_csv(spark, str(tmp_path), ordinal="_ord").orderBy("_ord").collect()
    assert [(r.order_id, r.quantity, r.region) for r in rows] == [("1", "10", "N"), ("2", "20", None)]


def test_first_row_does_not_depend_on_split_size(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,quantity\n7,1\n")
    (tmp_path / "b.csv").write_text("order_id,quantity\n" + "".join(f"{i % 20},{100 + i}\n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("128m", "64b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = files.read_sales_csv(spark, str(tmp_path), ordinal="_ord")
            got.append(sorted((r.order_id, r.quantity) for r in clean.dedup_orders(df).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got[0] == got[1] == sorted(
        (str(i), "1" if i == 7 else str(100 + i)) for i in range(20))


def test_headers_of_many_files_are_read_by_the_tasks(spark, tmp_path, monkeypatch):
    orders = [["order_id", "quantity", "region"], ["region", "order_id", "quantity"], ["quantity", "order_id"]]
    for i in range(2_000):
        row = {"order_id": f"O-{i}", "quantity": str(i % 7), "region": f"R,{i % 3}"}
        names = orders[i % 3]
        (tmp_path / f"part {i:04}.csv").write_text(
            ",".join(names) + "\n" + ",".join(f'"{row[n]}"' for n in names) + "\n")

    def opened(*_):  # what the tasks open they open in processes of their own
        raise AssertionError("the driver opened a file")

    monkeypatch.setattr(pathlib.Path, "open", opened)
    monkeypatch.setattr(csv, "reader", opened)
    df = files.read_sales_csv(spark, str(tmp_path))
    assert df._jdf.queryExecution().toString().count("FileScan csv") >= 3
    got = {r.order_id: (r.quantity, r.region) for r in df.select("order_id", "quantity", "region").collect()}
    assert got == {f"O-{i}": (str(i % 7), None if i % 3 == 2 else f"R,{i % 3}") for i in range(2_000)}


def test_headers_by_either_way(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n" * 4000)
    (tmp_path / "b é%.csv").write_text('\ufeff"y ""1""","x, z"\r\n1,2\r\n')
    (tmp_path / "c.csv").write_text("")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("x,y\n5,6\n")
    want = {"a.csv": '["x", "y"]', "b é%.csv": '["y \\"1\\"", "x, z"]', "d.csv.gz": '["x", "y"]'}
    for got in (files.headers(spark, str(tmp_path)), files._scanned(spark, str(tmp_path))):
        assert {unquote(r.file.rpartition("/")[2]): r.header for r in got.collect() if r.header} == want

    monkeypatch.setattr(files, "_PLAIN", (".none",))  # as if the tasks could not open them
    rows = files.read_sales_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "d.csv.gz")])
    assert rows.filter("x = '5'").count() == 1 and rows.count() == 8_000
    assert len(files.read_sales_csv(spark, str(tmp_path / "c.csv")).columns) == 0


def test_files_written_by_the_tasks(spark, tmp_path, monkeypatch):
    """One file a row on shelves of bounded size, read in fewer tasks than Spark deals them to, all rows as before."""
    monkeypatch.setattr(files, "FILES_A_SHELF", 20)
    monkeypatch.setattr(documents, "FEW_TASKS", 1)
    texts = [None, "", "a\nb", 'é "x"'] + [f"text {i}" for i in range(1196)]
    path = str(tmp_path / "each")
    files.write_each(spark.createDataFrame([(t,) for t in texts], "text string"), path, ".txt")
    found = [p for p in pathlib.Path(path).rglob("*") if p.is_file()]
    assert len(found) == len(texts) and len({p.parent for p in found}) == 60
    assert not [p for p in found if p.suffix != ".txt"]  # neither checksums nor unfinished files
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).rdd.getNumPartitions()
    for read in (documents.load_files(spark, path, recursive=True), documents.text_documents(spark, path, True)):
        assert read.rdd.getNumPartitions() < plain
        assert sorted(r.content for r in read.collect()) == sorted(f"{t or ''}\n" for t in texts)
    files.write_each(spark.createDataFrame([], "text string"), f"{path}-none", ".txt")
    assert documents.text_documents(spark, f"{path}-none", True).count() == 0


def test_states_of_files_take_one_reading(spark, sf):
    """Good and failed files are told apart in rows that are written once, not by reading the files for each."""
    from tallyloom.registered import files as queries

    df = queries.src_documents(spark, sf)
    assert "binaryFile" not in df._jdf.queryExecution().toString()
    want = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("pages", "labels"))
    assert {r.state: r.n for r in df.collect()} == {"good": want, "failed": 25}


def test_columns_go_by_the_header(spark, tmp_path):
    (tmp_path / "o.csv").write_text("quantity,order_id\n3,O-1\n")
    df = files.read_sales_csv(spark, str(tmp_path / "o.csv"))
    assert df.first().asDict() == {"quantity": "3", "order_id": "O-1"}
    with pytest.raises(ValueError, match="product_id"):
        clean.validate_columns(df)


def test_small_nodes_are_leaves(planted):
    rows, names, _ = planted
    train = rows.filter("split = 'train'")
    loose = forest.train(train, names, "y", min_split=0, numTrees=6, maxDepth=8)
    before = forest.nodes(loose).toPandas()
    assert ((before["rows"] < 40) & (before["left"] >= 0)).any()
    model = forest.unsplit(loose, 40)
    after = forest.nodes(model).toPandas()
    assert not ((after["rows"] < 40) & (after["left"] >= 0)).any()
    small = after[after["rows"] < 40]
    assert len(small) and np.allclose(small["prediction"], small["total"] / small["rows"])
    # the same tree, cut: every node below large ones only is there, in the same order
    for tree, old in before.groupby("tree"):
        old = old.sort_values("node").reset_index(drop=True)
        keep, stack = [], [0]
        while stack:
            i = stack.pop()
            keep.append(i)
            if old["rows"][i] >= 40 and old["left"][i] >= 0:
                stack += [old["right"][i], old["left"][i]]
        new = after[after["tree"] == tree].sort_values("node")
        assert list(new["node"]) == list(range(len(keep)))
        assert list(new["prediction"]) == list(old["prediction"][keep])
    by_hand = tree_values(model, rows.filter("f0 IS NOT NULL" if "f0" in rows.columns else "y IS NOT NULL"))
    got = forest.predict(model, by_hand).toPandas()
    assert np.allclose(got["prediction"], [np.mean(v) for v in got["by_tree"]])
    assert forest.unsplit(loose, 1) is loose
    assert forest.importance(model, names).count() == len(names)


def tree_values(model, df):
    """``by_tree``: every tree asked on its own."""
    out = df
    for stage in model.stages[:-1]:
        out = stage.transform(out)
    trees = forest.forest_of(model).trees
    for i, tree in enumerate(trees):
        out = tree.setFeaturesCol("features").setPredictionCol(f"_t{i}").transform(out)
    return out.withColumn("by_tree", F.array(*[f"_t{i}" for i in range(len(trees))])).drop(
        "raw_features", "features", *[f"_t{i}" for i in range(len(trees))])


def test_confidence_is_that_of_the_trees(planted):
    rows, _, model = planted
    for q in (0.16, 16.0):
        out = forest.predict_with_confidence(model, tree_values(model, rows), q)
        assert set(out.columns) == {*rows.columns, "by_tree", "mean", "lower", "upper"}
        got = out.toPandas()
        values = np.array(got["by_tree"].tolist())
        assert np.allclose(got["mean"], values.mean(1))
        assert np.allclose(got["lower"], np.percentile(values, q, axis=1))
        assert np.allclose(got["upper"], np.percentile(values, 100 - q, axis=1))
    plan = forest.predict_with_confidence(model, rows)._jdf.queryExecution().toString()
    assert plan.split("== Optimized")[0].count("_leaves#") and "_tree_" not in plan


def test_forecast_sinks(spark, tmp_path):
    f = spark.createDataFrame(
        [("a", "sma", 2, 2.5), ("a", "sma", 1, 1.5), ("b", "trend", 1, 0.0)],
        "series string, method string, step int, yhat double")
    got = {r["series"]: json.loads(r["forecast"]) for r in files.forecast_json(f, ["series"]).collect()}
    assert got == {"a": {"sma": [1.5, 2.5]}, "b": {"trend": [0.0]}}
    files.write_forecast(f, str(tmp_path / "f"), ["series"])
    assert files.forecast_lookup(spark, str(tmp_path / "f"), series="b").count() == 1
    assert files.forecast_lookup(spark, str(tmp_path / "f"), series="zz").count() == 0


def entries(spark, *rows):
    return spark.createDataFrame(
        [(t, n, f"/m/{t}/{n}", meta, at, i) for i, (t, n, meta, at) in enumerate(rows)],
        "type string, name string, path string, metadata string, saved_at string, seq bigint")


def test_registry(spark, tmp_path):
    log = registry.register(registry.empty(spark), entries(
        spark, ("baseline", "m", '{"v":1}', "2024-01-01"), ("baseline", "m", '{"v":2}', "2024-02-01"),
        ("baseline", "old", None, "2024-01-05")))
    assert registry.get(log, "baseline", "m").first()["metadata"] == '{"v":2}'
    with pytest.raises(ValueError, match="is registered"):
        registry.get(log, "random_forest", "m")
    names = {(r["type"], r["name"]) for r in registry.list_models(log).collect()}
    assert names == {("baseline", "m"), ("baseline", "old"), ("random_forest", None)}
    out = registry.export(log, "now").collect()
    assert [r["key"] for r in out] == ["baseline/m"]  # no readable metadata: skipped
    wanted = spark.createDataFrame(
        [("baseline", "m", "2024-03-01", 9), ("baseline", "ghost", "2024-03-01", 9)],
        "type string, name string, saved_at string, seq bigint")
    assert [r["name"] for r in registry.missing(log, wanted).collect()] == ["ghost"]
    after = registry.delete(log, wanted)
    assert [r["name"] for r in registry.latest(after).collect()] == ["old"]
    again = registry.register(after, entries(spark, ("baseline", "m", "{}", "2024-04-01")))
    assert registry.latest(again).count() == 2
    path = str(tmp_path / "log")
    registry.write(again, path)
    with open(os.path.join(path, "junk.json"), "w") as f:
        f.write("{not json\n")
    assert registry.scan(spark, path).count() == again.count()
    assert registry.scan(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = 5 * x[:, 0] + 2 * (x[:, 1] > 0) + rng.normal(scale=0.1, size=600)
    rows = [(f"r{i}", *map(float, x[i]), float(y[i])) for i in range(600)]
    rows.append(("null", None, 0.0, 0.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    rows = forest.split_random(forest.valid_rows(df, names, "y"))
    return rows, names, forest.train(rows.filter("split = 'train'"), names, "y", numTrees=15, maxDepth=8)


def test_forest(spark, planted, tmp_path):
    rows, names, model = planted
    assert rows.count() == 600
    share = rows.filter("split = 'test'").count() / 600
    assert 0.14 < share < 0.26
    scores = {r["split"]: r for r in forest.score(model, rows, "y").collect()}
    assert scores["train"]["r2"] > 0.97 and scores["test"]["r2"] > 0.9
    history = forest.training_metrics(forest.score(model, rows, "y")).first()
    assert history["test_rmse"] == scores["test"]["rmse"]
    top = forest.importance(model, names, 2).collect()
    assert [r["feature"] for r in top] == ["a", "b"]
    forest.save(model, str(tmp_path / "m"))
    again = forest.predict(forest.load(str(tmp_path / "m")), rows).select("row_id", "prediction")
    assert again.exceptAll(forest.predict(model, rows).select("row_id", "prediction")).count() == 0


def test_model_life_cycle(spark, planted, tmp_path):
    rows, names, model = planted
    root = str(tmp_path)
    assert models.log(spark, root).count() == 0
    with pytest.raises(ValueError, match="is registered"):
        models.load_forest(spark, root, "f")
    models.save_forest(model, names, root, "f", {"test_r2": 0.9}, {"by": "me"})
    again, features = models.load_forest(spark, root, "f")
    assert features == names
    few = rows.limit(5)
    assert ([r["prediction"] for r in forest.predict(again, few).collect()]
            == [r["prediction"] for r in forest.predict(model, few).collect()])
    g = spark.createDataFrame([(1.0, 0, 2), (3.0, 1, 2)], "y double, idx int, n int")
    models.save_baseline(g, root, "b")
    models.save_baseline(g, root, "b", 3, 0.4)
    _, window, alpha = models.load_baseline(spark, root, "b")
    assert (window, alpha) == (3, 0.4)
    meta = json.loads(registry.get(models.log(spark, root), "baseline", "b").first()["metadata"])
    assert meta["model_info"]["scaler_mean"] == 2.0 and meta["custom_metadata"] == {}
    models.delete(spark, root, "baseline", "b")
    left = {(r["type"], r["name"]) for r in registry.list_models(models.log(spark, root)).collect()}
    assert left == {("baseline", None), ("random_forest", "f")}
    assert not (tmp_path / "baseline" / "b").exists() and (tmp_path / "random_forest" / "f").exists()
    with pytest.raises(ValueError):
        models.delete(spark, root, "baseline", "b")


def test_confidence(spark, planted):
    rows, names, model = planted
    few = rows.orderBy("row_id").limit(20)
    p = forest.predict_with_confidence(model, few, 16).toPandas().set_index("row_id")
    mean = forest.predict(model, few).toPandas().set_index("row_id")["prediction"]
    np.testing.assert_allclose(p["mean"], mean.loc[p.index])
    assert (p["lower"] <= p["mean"]).all() and (p["mean"] <= p["upper"]).all()


@pytest.mark.parametrize("q", [0.16, 16, 50, 99.84, 0, 100])
def test_percentile(spark, q):
    values = [5.0, 1.0, 9.0, 2.5, 7.0]
    df = spark.createDataFrame([(values,), ([3.0],)], "v array<double>")
    got = [r[0] for r in df.select(forest.percentile(F.col("v"), q)).collect()]
    assert got == [pytest.approx(np.percentile(values, q)), 3.0]


def test_scaling_uses_training_rows(spark):
    df = spark.createDataFrame([(1.0, 4.0, True), (3.0, 4.0, True), (9.0, 5.0, False)],
                               "a double, b double, t boolean")
    got = forest.standard_scale(df, ["a", "b"], F.col("t")).collect()
    assert [r["a_scaled"] for r in got] == [-1.0, 1.0, 7.0]
    assert [r["b_scaled"] for r in got] == [0.0, 0.0, 1.0]


def test_split_is_the_same_on_every_run(spark, sf):
    rows = sales(spark, sf, "row_id")
    a, b = forest.split_random(rows), forest.split_random(rows.repartition(3))
    assert a.exceptAll(b).count() == 0
    other = forest.split_random(rows, seed=7)
    assert a.exceptAll(other).count() > 0


def test_settled_rows_are_in_the_shared_folder(spark):
    df = settle(spark.range(10).withColumn("s", F.lit("x")))
    assert df.count() == 10 and df.schema.names == ["id", "s"]
    assert scratch_path(spark, "a").startswith(shared_dir(spark))


def test_configured_folder_wins(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = shared_dir(spark)
    assert got == (configured.rstrip("/") if configured else
                   spark.sparkContext.getCheckpointDir().rstrip("/"))
