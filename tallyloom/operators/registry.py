"""Model registry as an append-only table of events.

A row says that the model ``type/name`` was saved or deleted at ``saved_at``; the newest row
of a key is its state. Model bytes live at ``path``, metadata is a JSON text.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyloom.session import remove
from tallyloom.sources import commits, versions

MODEL_TYPES = ["baseline", "random_forest"]
KEY = ["type", "name"]

SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("metadata", T.StringType()),
    T.StructField("saved_at", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("event", T.StringType()),
])
COLUMNS = SCHEMA.names


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def register(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Add save events; a later one for the same key replaces the earlier."""
    return log.unionByName(entries.withColumn("event", F.lit("save")).select(*COLUMNS))


def newest(log: DataFrame) -> DataFrame:
    """Last event per key, deletions too. Combines on the map side."""
    rest = [c for c in COLUMNS if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct("saved_at", "seq")).alias("_e")
    return log.groupBy(*KEY).agg(last).select(*KEY, "_e.*").select(*COLUMNS)


def latest(log: DataFrame) -> DataFrame:
    """Current entry per key; deleted keys have none."""
    return newest(log).filter(F.col("event") == "save").drop("event")


def get(log: DataFrame, model_type: str, name: str) -> DataFrame:
    """The entry of one model; raises if there is none."""
    entry = latest(log.filter((F.col("type") == model_type) & (F.col("name") == name)))
    if entry.isEmpty():
        raise ValueError(f"no model {model_type}/{name} is registered")
    return entry


def metadata(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metadata of the asked keys ``(type, name)``; unknown ones have no row."""
    return latest(log).join(wanted.select(*KEY).distinct(), KEY).select(*KEY, "metadata")


def list_models(log: DataFrame) -> DataFrame:
    """``(type, name)`` of all models; a type without models has one row with null name."""
    names = latest(log).select(*KEY)
    types = log.sparkSession.createDataFrame([(t,) for t in MODEL_TYPES], "type string")
    bare = types.join(names.select("type").distinct(), "type", "left_anti")
    return names.unionByName(bare.withColumn("name", F.lit(None).cast("string")))


def delete(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add delete events for ``wanted (type, name, saved_at, seq)``.

    Use ``missing`` first to learn which keys are not there.
    """
    gone = latest(log).select(*KEY, "path").join(wanted.select(*KEY, "saved_at", "seq"), KEY)
    events = gone.withColumn("metadata", F.lit(None).cast("string")).withColumn(
        "event", F.lit("delete"))
    return log.unionByName(events.select(*COLUMNS))


def missing(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select(*KEY).distinct().join(latest(log).select(*KEY), KEY, "left_anti")


def export(log: DataFrame, exported_at: str) -> DataFrame:
    """One JSON text per model with readable metadata: ``(key, json)``."""
    entries = latest(log).filter(F.col("metadata").isNotNull())
    return entries.select(
        F.concat_ws("/", *KEY).alias("key"),
        F.to_json(F.struct(
            F.lit(exported_at).alias("exported_at"), "type", "name", "saved_at", "metadata",
        )).alias("json"),
    )


def write(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def _state(path: str) -> str:
    """Where compaction keeps the state; no file of events, as the name begins with an underscore."""
    return f"{path}/_state"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Registry events at ``path``: the state at the last compaction, and the events written since.

    Lines that cannot be read are skipped; without a folder there are none. Events that the state holds
    already may still be there: they say the same again.
    """
    if not commits.names(spark, path):
        return empty(spark)
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)
    events = raw.filter(F.col("type").isNotNull() & F.col("name").isNotNull())
    if commits.last(spark, f"{_state(path)}/log") is None:
        return events
    return versions.load(spark, _state(path), "state")[0].select(*COLUMNS).unionByName(events)


def compact(spark: SparkSession, path: str, older_than: float = 3600.0) -> list[str]:
    """Write the newest event of every key as the state; names of the event files deleted.

    Deletions stay in it, so a save that is older but written later does not bring a model back. The
    files that were there before and are older than ``older_than`` seconds go: readers that have listed
    them may be at work until then.
    """
    now = time.time()
    before = [(n, at) for n, at in commits.names(spark, path) if not n.startswith(("_", "."))]
    versions.save(spark, _state(path), {"state": newest(scan(spark, path))})
    versions.vacuum(spark, _state(path), older_than)
    gone = [n for n, at in before if at <= now - older_than]
    for n in gone:
        remove(spark, f"{path}/{n}")
    return gone
