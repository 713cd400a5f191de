"""Order files are written compressed and in bounded pieces, and read back whole and in order."""

from tallyloom.sources import files
from tallyloom.sources.tables import SALES_COLUMNS


def test_written_order_files_are_compressed_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ORDER_FILE_ROWS", 100)
    texts = [f'O-{i}, "x"\t' if i % 3 else None for i in range(1050)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").selectExpr(
        *[f"{'cast(i as string)' if c == 'quantity' else 't'} AS {c}" for c in SALES_COLUMNS]).coalesce(1)
    files.write_sales_csv(rows, str(tmp_path / "o"))
    found = list((tmp_path / "o").glob("part-*"))
    assert len(found) == 11 and all(p.name.endswith(".csv.gz") for p in found)
    back = files.read_sales_csv(spark, str(tmp_path / "o"), ordinal="_ord").orderBy("_ord").collect()
    assert [r.quantity for r in back] == [str(i) for i in range(1050)]
    assert [r.product_name for r in back] == texts
