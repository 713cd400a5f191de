"""File sources: the tables are written as files by Spark, then read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import clean, registry
from tallyloom.plans import answers
from tallyloom.registered.common import Family, with_sales_text
from tallyloom.registered.texts import DOCS_SQL, _SUMMARY, _vector_summary
from tallyloom.session import scratch_path, settle
from tallyloom.sources import documents, files
from tallyloom.sources.tables import SALES_COLUMNS, sales_text, table

_f = Family()
QUERIES, SQL = _f.queries, _f.sql

# One set of files per session and table folder: several queries read the same.
_FOLDERS: dict = {}


def _folder(spark, sf_dir, name, write):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FOLDERS:
        path = scratch_path(spark, name)
        write(path)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def _one_file_each(df):
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks).write.option("maxRecordsPerFile", 1)


def _text_folder(spark, sf_dir):
    """Pages, one text file each, on shelves (sub-folders)."""
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    return _folder(spark, sf_dir, "pages-text", lambda p: files.write_each(pages, p, ".txt"))


def _json_folder(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("text"))
    return _folder(spark, sf_dir, "labels-json", lambda p: files.write_each(labels, p, ".json"))


def _csv_folder(spark, sf_dir, name="nations-csv", extension="csv"):
    nations = table(spark, sf_dir, "nation")
    return _folder(spark, sf_dir, name,
                   lambda p: _one_file_each(nations).option("extension", extension).csv(p))


def _odd_names(rows):
    """Product names with quotes, commas and, in some, a quote at the very start."""
    key = F.split("order_id", "-")[1].cast("bigint")
    return rows.withColumn("product_name", F.when(key % 3 == 0, F.concat(
        F.lit('"'), F.trim(F.replace("product_name", F.lit("\t"), F.lit(""))), F.lit('", 12" wide'))).otherwise(
            F.concat("product_name", F.lit(', "XL"'))))


def _sales_csv(spark, sf_dir):
    """Two folders of files, the second with its columns in another order."""
    rows = _odd_names(sales_text(spark, sf_dir))
    first = F.split("order_id", "-")[1].cast("bigint") % 4 != 0

    def write(path):
        files.write_sales_csv(rows.filter(first), f"{path}/a")
        files.write_sales_csv(rows.filter(~first), f"{path}/b", SALES_COLUMNS[::-1])

    path = _folder(spark, sf_dir, "sales-csv", write)
    return [f"{path}/a", f"{path}/b"]


@_f.add("src_csv_sales", with_sales_text("""
  SELECT * EXCLUDE (row_id) REPLACE (CASE WHEN CAST(split_part(order_id, '-', 2) AS BIGINT) % 3 = 0
      THEN '"' || trim(replace(product_name, chr(9), '')) || '", 12" wide'
      ELSE product_name || ', "XL"' END AS product_name)
  FROM sales_text"""))
def src_csv_sales(spark, sf_dir):
    return clean.validate_columns(files.read_sales_csv(spark, _sales_csv(spark, sf_dir)))


# ids that stand in several rows and in both folders
_SHARED_ID = "'ORD-' || CAST(CAST(split_part(order_id, '-', 2) AS BIGINT) // 4 AS VARCHAR)"


@_f.add("dedup_orders_files", with_sales_text(f"""
  SELECT order_id, product_id, quantity FROM (
    SELECT {_SHARED_ID} AS order_id, product_id, quantity, row_number() OVER (
      PARTITION BY {_SHARED_ID}
      ORDER BY CAST(split_part(order_id, '-', 2) AS BIGINT) % 3 <> 0, row_id) AS rn
    FROM sales_text) WHERE rn = 1"""))
def dedup_orders_files(spark, sf_dir):
    """First row of each id in the order of files of unequal size, each sorted."""
    key = F.split("order_id", "-")[1].cast("bigint")
    rows = sales_text(spark, sf_dir).withColumn("_third", key % 3 == 0).withColumn(
        "order_id", F.concat(F.lit("ORD-"), F.floor(key / 4).cast("string")))

    def write(path):
        for name, part in (("a", F.col("_third")), ("b", ~F.col("_third"))):
            files.write_sales_csv(rows.filter(part).orderBy("row_id"), f"{path}/{name}")

    path = _folder(spark, sf_dir, "sales-shared-ids", write)
    read = files.read_sales_csv(spark, [f"{path}/a", f"{path}/b"], ordinal="_ord")
    return clean.dedup_orders(read).select("order_id", "product_id", "quantity")


@_f.add("src_sales_numeric", with_sales_text("""
  SELECT order_id, product_id, TRY_CAST(quantity AS DOUBLE) AS quantity,
    TRY_CAST(unit_price AS DOUBLE) AS unit_price,
    coalesce(TRY_CAST(discount AS DOUBLE), -1e0) AS discount
  FROM sales_text WHERE TRY_CAST(quantity AS DOUBLE) IS NOT NULL"""))
def src_sales_numeric(spark, sf_dir):
    df = files.read_sales_numeric(spark, _sales_csv(spark, sf_dir))
    return df.select("order_id", "product_id", "quantity", "unit_price",
                     F.coalesce("discount", F.lit(-1.0)).alias("discount"))


_LINES = "replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10)"


@_f.add("src_text", f"""SELECT {_LINES} AS content, 'text' AS type,
    CAST(1 AS INTEGER) AS named FROM pages""")
def src_text(spark, sf_dir):
    docs = documents.text_documents(spark, _text_folder(spark, sf_dir), recursive=True)
    meta = F.col("metadata")
    named = (F.endswith(F.col("source"), meta["filename"]) & (meta["path"] == F.col("source")))
    return docs.select("content", meta["type"].alias("type"), named.cast("int").alias("named"))


@_f.add("src_json_doc", """SELECT '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10)
    || '  "quality": ' || quality || ',' || chr(10) || '  "toxic": ' || toxic || chr(10) || '}'
    AS content, 'json' AS type FROM labels""")
def src_json_doc(spark, sf_dir):
    docs = documents.good(documents.json_documents(spark, _json_folder(spark, sf_dir), True))
    return docs.select("content", F.col("metadata")["type"].alias("type"))


def _make_extractor():
    """Stand-in for a PDF reader: pages are separated by form feeds."""
    return lambda blob: blob.decode("utf-8").split("\f")


@_f.add("src_pdf_doc", f"""SELECT regexp_replace(regexp_replace({_LINES}, '^\\s+', ''), '\\s+$', '') AS content,
    CAST(1 AS INTEGER) AS placeholder, 'pdf' AS type FROM pages""")
def src_pdf_doc(spark, sf_dir):
    scanned = documents.scan_files(spark, _text_folder(spark, sf_dir), recursive=True)
    real = documents.good(documents.pdf_documents(scanned, _make_extractor))
    shown = documents.pdf_documents(scanned).select(
        F.col("source"), (F.col("content") == F.concat(
            F.lit(documents.PDF_PLACEHOLDER), F.col("metadata")["filename"]
        )).cast("int").alias("placeholder"))
    return real.join(shown, "source").select(
        "content", "placeholder",
        F.col("metadata")["type"].alias("type"))


@_f.add("src_dispatch", """SELECT 'text' AS type, '' AS error, count(*) AS n FROM pages
  UNION ALL SELECT 'json', '', count(*) FROM labels
  UNION ALL SELECT 'pdf', '', count(*) FROM nation
  UNION ALL SELECT 'unknown', 'Unsupported file format: .csv', count(*) FROM nation""")
def src_dispatch(spark, sf_dir):
    folders = [
        _text_folder(spark, sf_dir), _json_folder(spark, sf_dir), _csv_folder(spark, sf_dir),
        _csv_folder(spark, sf_dir, "nations-pdf", "pdf"),
    ]
    docs = documents.load_files(spark, folders, recursive=True, only_known=False)
    return docs.groupBy(
        F.col("metadata")["type"].alias("type"), F.coalesce("error", F.lit("")).alias("error")
    ).agg(F.count("*").alias("n"))


@_f.add("src_documents", """SELECT 'good' AS state, count(*) AS n FROM
    (SELECT page_id FROM pages UNION ALL SELECT doc_id FROM labels)
  UNION ALL SELECT 'failed', count(*) FROM nation""")
def src_documents(spark, sf_dir):
    asked = [_text_folder(spark, sf_dir), _json_folder(spark, sf_dir), _csv_folder(spark, sf_dir)]
    docs = settle(documents.load_files(spark, asked, recursive=True, only_known=False).select(
        "source", "error"), "read-files")  # the files are read once for both states
    state = [("good", documents.good(docs)), ("failed", documents.failed(docs))]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
             for s, df in state]
    return parts[0].unionByName(parts[1])


@_f.add("src_dir_recursive", f"SELECT md5({_LINES}) AS content, 'text' AS type FROM pages")
def src_dir_recursive(spark, sf_dir):
    docs = documents.good(documents.load_files(spark, _text_folder(spark, sf_dir), recursive=True))
    return docs.select(F.md5("content").alias("content"),
                       F.col("metadata")["type"].alias("type"))


@_f.add("rag_load", DOCS_SQL.replace("documents", "page_docs").replace(
    "WITH ", f"WITH page_docs AS (SELECT page_id AS doc_id, {_LINES} AS text FROM pages), ", 1) + f"""
  SELECT md5(any_value(text)) AS content, {_SUMMARY} FROM page_docs
  LEFT JOIN doc_vec ON doc_id = ord GROUP BY doc_id""")
def rag_load(spark, sf_dir):
    index = answers.index_folder(spark, _text_folder(spark, sf_dir), recursive=True)
    texts = index.documents.select("ord", F.md5("content").alias("content"))
    return _vector_summary(index.vectors.join(texts, "ord"), "content")


# --- registry: events of users act on models named after them ---------------------------

_LOG_SQL = """log AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'random_forest' END
      AS type, 'model_' || CAST(user_id AS VARCHAR) AS name, event_id AS seq,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') AS saved_at, props,
      CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS event FROM events),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, name
      ORDER BY saved_at DESC, seq DESC) AS rn FROM log) WHERE rn = 1),
    now_there AS (SELECT * FROM newest WHERE event = 'save')"""


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("random_forest")
    name = F.concat(F.lit("model_"), F.col("user_id").cast("string"))
    return e.select(
        kind.alias("type"), name.alias("name"), F.concat_ws("/", kind, name).alias("path"),
        F.col("props").alias("metadata"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("event"))


@_f.add("registry_register", f"""WITH {_LOG_SQL}
  SELECT type, name, type || '/' || name AS path, seq, saved_at FROM (SELECT *, row_number()
    OVER (PARTITION BY type, name ORDER BY saved_at DESC, seq DESC) AS r2 FROM log
    WHERE event = 'save') WHERE r2 = 1""")
def registry_register(spark, sf_dir):
    entries = _log(spark, sf_dir).filter(F.col("event") == "save").drop("event")
    log = registry.register(registry.empty(spark), entries)
    return registry.latest(log).select("type", "name", "path", "seq", "saved_at")


@_f.add("registry_latest", f"WITH {_LOG_SQL} SELECT type, name, seq, saved_at FROM now_there")
def registry_latest(spark, sf_dir):
    return registry.latest(_log(spark, sf_dir)).select("type", "name", "seq", "saved_at")


@_f.add("registry_metadata", f"""WITH {_LOG_SQL} SELECT type, name, props AS metadata FROM now_there
  WHERE name IN (SELECT 'model_' || CAST(s_nationkey AS VARCHAR) FROM supplier)""")
def registry_metadata(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(
        F.explode(F.array(*map(F.lit, registry.MODEL_TYPES))).alias("type"),
        F.concat(F.lit("model_"), F.col("s_nationkey").cast("string")).alias("name"))
    return registry.metadata(_log(spark, sf_dir), wanted)


@_f.add("registry_list", f"""WITH {_LOG_SQL} SELECT t.type, name FROM
    (VALUES ('baseline'), ('random_forest')) t(type) LEFT JOIN now_there ON now_there.type = t.type""")
def registry_list(spark, sf_dir):
    return registry.list_models(_log(spark, sf_dir))


@_f.add("registry_delete", f"""WITH {_LOG_SQL} SELECT type, name, seq FROM now_there
  WHERE name NOT IN (SELECT 'model_' || CAST(s_nationkey AS VARCHAR) FROM supplier)""")
def registry_delete(spark, sf_dir):
    log = _log(spark, sf_dir)
    wanted = table(spark, sf_dir, "supplier").select(
        F.explode(F.array(*map(F.lit, registry.MODEL_TYPES))).alias("type"),
        F.concat(F.lit("model_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.lit("9999-12-31T00:00:00").alias("saved_at"), F.lit(0).cast("bigint").alias("seq"),
    ).distinct()
    return registry.latest(registry.delete(log, wanted)).select("type", "name", "seq")


@_f.add("registry_export", f"""WITH {_LOG_SQL} SELECT type || '/' || name AS key,
    '{{"exported_at":"2024-01-01","type":"' || type || '","name":"' || name || '","saved_at":"'
    || saved_at || '","metadata":"' || replace(props, '"', '\\"') || '"}}' AS json FROM now_there""")
def registry_export(spark, sf_dir):
    return registry.export(_log(spark, sf_dir), "2024-01-01")


@_f.add("registry_scan", f"""WITH {_LOG_SQL} SELECT type, name, seq, saved_at, event,
    props AS metadata FROM log""")
def registry_scan(spark, sf_dir):
    path = scratch_path(spark, "registry")
    registry.write(_log(spark, sf_dir), path)
    return registry.scan(spark, path).select(
        "type", "name", "seq", "saved_at", "event", "metadata")


@_f.add("registry_compacted", f"WITH {_LOG_SQL} SELECT type, name, seq, saved_at, props AS metadata FROM now_there")
def registry_compacted(spark, sf_dir):
    """Events in three writes, compacted after the first and after the second, are the same state."""
    path, log = scratch_path(spark, "registry"), _log(spark, sf_dir)
    for i in range(3):
        registry.write(log.filter(F.col("seq") % 3 == i), path)
        if i < 2:
            registry.compact(spark, path, older_than=0)
    return registry.latest(registry.scan(spark, path)).select("type", "name", "seq", "saved_at", "metadata")
