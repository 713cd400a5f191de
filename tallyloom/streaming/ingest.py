"""Incremental indexing: new document files of a folder go through the fitted vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import retrieval
from tallyloom.sources import versions

# Parts of a table after which a stream joins them.
COMPACT_AFTER = 50


def add_documents_stream(
    spark: SparkSession,
    source: str,
    schema,
    index_path: str,
    checkpoint: str,
    order_cols: list[str],
    file_format: str = "parquet",
    name_filter: str | None = None,
    prepare=None,
    files_per_batch: int | None = None,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Append the documents of every new file below ``source`` to the index saved at ``index_path``.

    Rows need ``(content, source[, id, metadata])`` and the columns they are ordered by, possibly
    after ``prepare``. Numbers go on at what the index holds when a batch takes effect. A batch's
    documents and vectors show together, by one record that also names the batch, so one that runs
    twice after a failure is there once. A batch goes to the index as it is at that time, whatever was
    saved or added meanwhile. When the documents have more than ``compact_after`` parts, they are joined.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(source)
    if prepare is not None:
        rows = prepare(rows)
    versions.state(spark, index_path)  # raises if there is no index

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        retrieval.append(session, index_path, batch, order_cols, (checkpoint, batch_id))
        if len(versions.state(session, index_path)[1]["tables"]["documents"]) > compact_after:
            retrieval.compact(session, index_path)

    return (
        rows.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
