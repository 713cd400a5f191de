"""Vector queries on the given embeddings."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tallyloom.functions import vectors as vec
from tallyloom.operators import knn as nn, vector_store
from tallyloom.registered.common import Family, r, shown
from tallyloom.session import scratch_path
from tallyloom.sources import files
from tallyloom.sources.tables import table

_f = Family()
QUERIES, SQL = _f.queries, _f.sql

# vectors as doubles with their length
V_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
NORM = "sqrt(list_inner_product({0}, {0}))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("ord", F.col("vec_id"))


def _as_queries(df):
    return df.select(F.col("ord").alias("query_id"), "embedding")


def _new_rows(spark, sf_dir):
    return _vectors(spark, sf_dir).select(
        "vec_id", "embedding",
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


def _knn_sql(score: str, order: str, k: int) -> str:
    return f"""WITH {V_SQL}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS ord,
      {r(score)} AS score FROM v a, v b),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, ord) AS rk
      FROM s)
    SELECT query_id, CAST(rk AS INTEGER) AS rank, ord, score FROM t WHERE rk <= {k}"""


COSINE = "list_inner_product(a.e, b.e) / (" + NORM.format("a.e") + " * " + NORM.format("b.e") + ")"
L2 = """greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e)
      - 2 * list_inner_product(a.e, b.e), 0e0)"""


@_f.add("knn_cosine", _knn_sql(COSINE, "DESC", 5))
def knn_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return nn.knn(_as_queries(v), v, 5, "cosine")


@_f.add("knn_l2", _knn_sql(L2, "ASC", 5))
def knn_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return nn.knn(_as_queries(v), v, 5, "l2")


@_f.add("topk_knn", _knn_sql(COSINE, "DESC", 20))
def topk_knn(spark, sf_dir):
    """The same search by blocks of queries and vectors, as used beyond the block size."""
    v = _vectors(spark, sf_dir)
    return nn.knn(_as_queries(v), v, 20, "cosine", query_block=128)


@_f.add("knn_by_label_centre", f"""WITH {V_SQL},
  p AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
  c AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i),
  q AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY label),
  s AS (SELECT a.label AS query_id, b.vec_id AS ord, {r(COSINE)} AS score FROM q a, v b),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rk FROM s)
  SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rk AS INTEGER) AS rank, ord, score
  FROM t WHERE rk <= 10""")
def knn_by_label_centre(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return nn.knn(_centres(v, ["label"]).withColumnRenamed("label", "query_id")
                  .withColumn("query_id", F.col("query_id").cast("bigint")), v, 10)


def _centres(v, key):
    """Mean vector per key; sums run per dimension, so no key's vectors are gathered."""
    parts = v.select(*key, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))  # one entry per dimension
    return means.groupBy(*key).agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))


@_f.add("cosine_similarity", f"""WITH {V_SQL}
  SELECT a.vec_id, {r(COSINE)} AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = v.select("vec_id", "embedding").join(following, "vec_id")
    return shown(vector_store.pairwise_similarity(pairs, "embedding", "next")
                 .select("vec_id", "similarity"))


@_f.add("batch_similarity", f"""WITH {V_SQL},
  p AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
  c AS (SELECT i, avg(x) AS x FROM p GROUP BY i), a AS (SELECT list(x ORDER BY i) AS e FROM c)
  SELECT b.vec_id, {r(COSINE)} AS similarity FROM v b, a""")
def batch_similarity(spark, sf_dir):
    """All vectors against one query vector, here the mean of all; a scalar, not a join."""
    v = _vectors(spark, sf_dir)
    query = _centres(v, []).scalar()
    return shown(vector_store.batch_similarity(v, query).select("vec_id", "similarity"))


@_f.add("vector_prepare", f"""WITH {V_SQL}, n AS (
    SELECT vec_id, CAST(list_transform(e, lambda x: x / {NORM.format('e')}) AS FLOAT[]) AS u FROM v)
  SELECT vec_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS i,
    {r('CAST(unnest(u) AS DOUBLE)', 5)} AS x FROM n""")
def vector_prepare(spark, sf_dir):
    df = vector_store.prepare(_vectors(spark, sf_dir), 64, "cosine")
    return shown(df.select("vec_id", F.posexplode("embedding").alias("i", "x"))
                 .withColumn("x", F.col("x").cast("double")), default=5)


_STORE = """SELECT vec_id AS ord, 'vec_' || CAST(vec_id AS VARCHAR) AS id,
    CAST(label AS VARCHAR) AS label FROM embeddings"""


@_f.add("vector_add", _STORE)
def vector_add(spark, sf_dir):
    store = vector_store.create(_new_rows(spark, sf_dir), ["vec_id"])
    return store.select("ord", "id", F.col("metadata")["label"].alias("label"))


@_f.add("append_vectors", f"""{_STORE} UNION ALL
  SELECT (SELECT count(*) FROM embeddings) + vec_id, 'again_' || CAST(vec_id AS VARCHAR),
    CAST(label AS VARCHAR) FROM embeddings""")
def append_vectors(spark, sf_dir):
    rows = _new_rows(spark, sf_dir)
    store = vector_store.create(rows, ["vec_id"])
    named = rows.withColumn("id", F.concat(F.lit("again_"), F.col("vec_id").cast("string")))
    return vector_store.add(store, named, ["vec_id"]).select(
        "ord", "id", F.col("metadata")["label"].alias("label"))


@_f.add("replace_index", """SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS ord,
    'vec_' || CAST(row_number() OVER (ORDER BY vec_id DESC) - 1 AS VARCHAR) AS id,
    CAST(label AS VARCHAR) AS label FROM embeddings""")
def replace_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    rows = _new_rows(spark, sf_dir).withColumn("back", -F.col("vec_id"))
    vector_store.save(vector_store.create(rows, ["vec_id"]), path, 64)
    vector_store.save(vector_store.create(rows, ["back"]), path, 64)
    store, _, _ = vector_store.load(spark, path)
    return store.select("ord", "id", F.col("metadata")["label"].alias("label"))


@_f.add("index_two_savers", """SELECT 'v' || CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label,
    count(*) OVER () AS n, count(*) OVER () AS places FROM embeddings""")
def index_two_savers(spark, sf_dir):
    """Two writers add to one saved store at once; both additions are there, numbered without a gap."""
    path = scratch_path(spark, "index")
    rows = _new_rows(spark, sf_dir).withColumn("id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    third = F.col("vec_id") % 3
    vector_store.save(vector_store.create(rows.filter(third == 0), ["vec_id"]), path, 64)
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(
            lambda i: vector_store.append(spark, path, rows.filter(third == i), ["vec_id"]), (1, 2)))
    store, _, _ = vector_store.load(spark, path)
    return store.select("id", F.col("metadata")["label"].alias("label"),
                        store.agg(F.count("*")).scalar().alias("n"),
                        store.agg(F.max("ord") + 1).scalar().alias("places"))


@_f.add("store_clear", _STORE)
def store_clear(spark, sf_dir):
    """A cleared store numbers from 0 again."""
    rows = _new_rows(spark, sf_dir)
    cleared = vector_store.clear(vector_store.create(rows, ["vec_id"]))
    return vector_store.add(cleared, rows, ["vec_id"]).select(
        "ord", "id", F.col("metadata")["label"].alias("label"))


@_f.add("index_size", "SELECT count(*) AS n FROM embeddings")
def index_size(spark, sf_dir):
    return vector_store.size(_vectors(spark, sf_dir))


@_f.add("sink_vector_index", f"""WITH {V_SQL}
  SELECT vec_id AS ord, 'vec_' || CAST(vec_id AS VARCHAR) AS id, CAST(64 AS INTEGER) AS dim,
    'cosine' AS metric, {r(NORM.format('e'), 5)} AS length FROM v""")
def sink_vector_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    vector_store.save(vector_store.create(_new_rows(spark, sf_dir), ["vec_id"]), path, 64)
    store, dim, metric = vector_store.load(spark, path)
    return shown(store.select("ord", "id", F.lit(dim).alias("dim"), F.lit(metric).alias("metric"),
                              vec.l2_norm(F.col("embedding")).alias("length")), default=5)


@_f.add("sink_embeddings", """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER)
    AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""")
def sink_embeddings(spark, sf_dir):
    path = scratch_path(spark, "embeddings")
    files.write_embeddings(table(spark, sf_dir, "embeddings"), path)
    back = files.read_embeddings(spark, path)
    return back.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn(
        "x", F.col("x").cast("double"))


def _store_writes(spark, sf_dir):
    return _vectors(spark, sf_dir).select(
        F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("doc_id"), "embedding",
        F.create_map(F.lit("vec"), F.col("vec_id").cast("string")).alias("metadata"),
        F.col("vec_id").alias("written"))


@_f.add("embedding_store", f"""WITH {V_SQL}
  SELECT 'doc_' || CAST(label AS VARCHAR) AS doc_id, max(vec_id) AS written,
    CAST(max(vec_id) AS VARCHAR) AS vec, {r(f"arg_max({NORM.format('e')}, vec_id)", 5)} AS length
  FROM v GROUP BY label""")
def embedding_store(spark, sf_dir):
    store = vector_store.upsert_latest(_store_writes(spark, sf_dir))
    return shown(store.select("doc_id", "written", F.col("metadata")["vec"].alias("vec"),
                              vec.l2_norm(F.col("embedding")).alias("length")), default=5)


@_f.add("sink_embedding_store", """SELECT 'doc_' || CAST(label AS VARCHAR) AS doc_id,
    CAST(max(vec_id) AS VARCHAR) AS vec, CAST(64 AS INTEGER) AS dim FROM embeddings GROUP BY label""")
def sink_embedding_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    store = vector_store.upsert_latest(_store_writes(spark, sf_dir))
    vector_store.to_json(store).write.parquet(path)
    back = spark.read.parquet(path).withColumn("v", F.from_json(
        "json", "embedding array<float>, metadata map<string,string>"))
    return back.select("doc_id", F.col("v.metadata")["vec"].alias("vec"),
                       F.size("v.embedding").alias("dim"))


@_f.add("store_retrieve", """WITH latest AS (SELECT 'doc_' || CAST(label AS VARCHAR) AS doc_id,
    max(vec_id) AS written FROM embeddings GROUP BY label)
  SELECT doc_id, written FROM latest
  WHERE doc_id IN (SELECT 'doc_' || CAST(c_nationkey AS VARCHAR) FROM customer)""")
def store_retrieve(spark, sf_dir):
    store = vector_store.upsert_latest(_store_writes(spark, sf_dir))
    asked = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("doc_"), F.col("c_nationkey").cast("string")).alias("doc_id"))
    return vector_store.retrieve(store, asked).select("doc_id", "written")
