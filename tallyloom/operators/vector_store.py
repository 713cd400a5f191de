"""Vector tables: rows ``(ord, id, embedding, metadata)``; ``ord`` is the key, ids may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyloom.functions import vectors as vec
from tallyloom.operators import ordered
from tallyloom.operators.knn import check_metric
from tallyloom.session import settle
from tallyloom.sources import versions

SCHEMA = "ord bigint, id string, embedding array<float>, metadata map<string,string>"


def prepare(df: DataFrame, dim: int, metric: str = "cosine") -> DataFrame:
    """float32 vectors of length ``dim``; unit length for cosine, a zero vector stays zero.

    A vector of another length fails the job when it is read.
    """
    m = check_metric(metric)
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(F.concat(
            F.lit(f"vector dimension mismatch: expected {dim}, got "),
            F.size("embedding").cast("string"),
        )).cast("array<float>")
    )
    df = df.withColumn("embedding", checked.cast("array<float>"))
    if m == "cosine":
        df = df.withColumn("embedding", vec.normalise(F.col("embedding")).cast("array<float>"))
    return df


def size(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("n"))


def add(store: DataFrame, new: DataFrame, order_cols: list[str]) -> DataFrame:
    """Append vectors; ``ord`` goes on at the store's size, missing ids become ``vec_{ord}``."""
    return store.select("ord", "id", "embedding", "metadata").unionByName(
        _numbered(new, order_cols, size(store).scalar()))


def _numbered(new: DataFrame, order_cols: list[str], base) -> DataFrame:
    numbered = ordered.positions(new, [], order_cols).withColumn("ord", base + F.col("_pos"))
    return _rows(numbered, "vec_")


def _rows(numbered: DataFrame, prefix: str) -> DataFrame:
    given = F.col("id") if "id" in numbered.columns else F.lit(None).cast("string")
    meta = (F.col("metadata") if "metadata" in numbered.columns
            else F.lit(None).cast("map<string,string>"))
    return numbered.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.coalesce(given, F.concat(F.lit(prefix), F.col("ord").cast("string"))).alias("id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def create(new: DataFrame, order_cols: list[str], prefix: str = "vec_") -> DataFrame:
    """Number rows from 0 in the given order."""
    numbered = ordered.positions(new, [], order_cols).withColumnRenamed("_pos", "ord")
    return _rows(numbered, prefix)


def clear(store: DataFrame) -> DataFrame:
    """Empty table of the same columns."""
    return store.sparkSession.createDataFrame([], store.schema)


def save(store: DataFrame, path: str, dim: int, metric: str = "cosine") -> None:
    """Vectors and a one-row description replace what is at ``path``, which may be the table that
    ``store`` was loaded from."""
    spark = store.sparkSession
    rows = settle(store, "vectors")
    about = rows.agg(
        F.lit(dim).alias("embedding_dim"), F.lit(check_metric(metric)).alias("metric"),
        F.count("*").alias("n"))
    versions.save(spark, path, {"vectors": rows, "meta": about})


def append(spark: SparkSession, path: str, new: DataFrame, order_cols: list[str]) -> int:
    """Add vectors to the store saved at ``path``; several may do so at once, and none is lost.

    Vectors and description show together. Numbers go on at the store's size when the addition takes
    effect: who finds another addition there first numbers again.
    """
    def make(draft: versions.Draft) -> None:
        about = draft.read("meta").first()
        # l2: of the right length, otherwise as they are
        rows = draft.add("vectors", prepare(
            _numbered(new, order_cols, F.lit(about["n"])), about["embedding_dim"], "l2"))
        draft.replace("meta", draft.read("meta").withColumn("n", F.col("n") + rows.count()))

    return versions.change(spark, path, make)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, str]:
    """(vectors, dimension, metric); the row count must be the described one."""
    store, about = versions.load(spark, path, "vectors", "meta")
    meta = about.first()
    n = store.count()
    if n != meta["n"]:
        raise ValueError(f"{path} holds {n} vectors, but its description says {meta['n']}")
    return store, meta["embedding_dim"], meta["metric"]


def upsert_latest(writes: DataFrame, key: str = "doc_id", write_order: str = "written") -> DataFrame:
    """Last write per id wins; each task first reduces its own rows to one per id.

    Of writes of one id with the same order the one with the greatest other columns counts, so the result is
    the same on every run; maps count by their JSON text.
    """
    rest = [F.desc(f.name) for f in writes.schema.fields
            if f.name not in (key, write_order) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    maps = [F.desc(F.to_json(f.name)) for f in writes.schema.fields if isinstance(f.dataType, T.MapType)]
    w = Window.partitionBy(key).orderBy(F.desc(write_order), *rest, *maps)
    return writes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def retrieve(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the asked ids; unknown ids have no row."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def to_json(store: DataFrame, key: str = "doc_id") -> DataFrame:
    return store.select(
        key, F.to_json(F.struct("embedding", "metadata")).alias("json")
    )


def pairwise_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", vec.cosine(F.col(a), F.col(b)))


def batch_similarity(store: DataFrame, query: Column, name: str = "similarity") -> DataFrame:
    """Cosine of one query vector with every row; 0 where either has no length."""
    both = store.withColumn("_query", query)
    return both.withColumn(name, vec.cosine(F.col("embedding"), F.col("_query"))).drop("_query")
