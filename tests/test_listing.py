"""Folders are listed by tasks: the same files as Spark's own lookup finds, and the driver holds none of their names."""

from pyspark.sql import functions as F

from tallyloom.sources import documents


def plant(base):
    for name, text in {
            "a.txt": "one", "B.TXT": "", "deep/er/c d%20é.json": "{}", "deep/x.csv": "1,2", "deep/.hidden.txt": "h",
            "deep/_not.txt": "n", "_away/d.txt": "d", "shelf=1/_e=1.txt": "e", "shelf=1/f.txt._COPYING_": "f",
            "deep/none": "no suffix", ".txt": "dot", "deep/gz.txt.gz": "not packed", "deep/g.pdf": "p", "_metadata": "m", "deep/_metadata2/y.txt": "y"}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "empty").mkdir()


def rows(df):
    return sorted((r[0], bytes(r[1])) for r in df.select("path", "content").collect())


def test_listed_as_spark_does(spark, tmp_path):
    plant(tmp_path)
    base = str(tmp_path)
    for paths in (base, f"{base}/", [f"{base}/deep", base, base], [f"{base}/a.txt", f"{base}/deep/er"], f"{base}/empty"):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        got = documents.scan_files(spark, paths, True)
        assert rows(got) == rows(want)
        assert got.select("path", "content").dtypes == want.select("path", "content").dtypes
        few = documents.scan_files(spark, paths, True, [".txt", ".json"])
        assert rows(few) == rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", documents._glob([".txt", ".json"])).load(paths))
    assert len(rows(documents.scan_files(spark, base, True))) == 8


def test_no_file_reaches_the_driver(spark, tmp_path):
    plant(tmp_path)
    docs = documents.load_files(spark, str(tmp_path), recursive=True, only_known=False)
    plan = docs._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "a.txt" not in plan
    got = {r[0]: r[1] for r in docs.select(F.col("metadata")["filename"], "error").collect()}
    assert got["x.csv"] == "Unsupported file format: .csv" and got["a.txt"] is None and got["g.pdf"] is None


def test_patterns_and_missing_folders_are_left_to_spark(spark, tmp_path):
    plant(tmp_path)
    assert len(rows(documents.scan_files(spark, f"{tmp_path}/de*", True))) == 6
    try:
        documents.scan_files(spark, f"{tmp_path}/gone", True)
        raise SystemError("found")
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)
