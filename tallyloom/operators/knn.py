"""Exact nearest neighbours.

Queries are written in blocks of bounded size to the shared folder. Each task holds a bounded part
of its vectors, takes one block of queries after the other, scores both by a matrix product and
hands on its k best per query; only those are shuffled and ranked. Vectors are read once and never
shuffled, and no pair of a query and a vector is ever a row. The plan is the same for one query
and for very many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.session import scratch_path

METRICS = ("cosine", "l2")

# Rows of a block of queries, about.
QUERY_BLOCK = 4096
# Numbers in one dense matrix, and bytes of vectors that a task holds.
_CELLS = 2_000_000
_HELD_BYTES = 64_000_000
SCORE_PLACES = 6
# A query's exact scores are worked out pair by pair if no more than one vector in so many may be among its best.
_FEW = 16


def check_metric(metric: str) -> str:
    m = metric.lower().strip()
    if m not in METRICS:
        raise ValueError(f"{metric!r} is no metric; choose {' or '.join(METRICS)}")
    return m


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of an Arrow list column."""
    if column.null_count:
        raise ValueError("vector is null")
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    flat, lengths = _offsets(column)
    wrong = lengths[lengths != dim]
    if wrong.size:
        raise ValueError(f"vector dimension mismatch: expected {dim}, got {int(wrong[0])}")
    return flat.astype(np.float64).reshape(len(lengths), dim)


def _sparse(ids: pa.Array, weights: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense rows over the sorted ``terms`` alone, squared lengths of the whole rows)"""
    cols, lengths = _offsets(ids)
    vals, _ = _offsets(weights)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), len(terms)))
    if len(terms):
        at = np.minimum(np.searchsorted(terms, cols), len(terms) - 1)
        known = terms[at] == cols
        out[rows[known], at[known]] = vals[known]
    return out, np.bincount(rows, weights=vals * vals, minlength=len(lengths))


def _rows(columns: list[pa.Array], dim: int | None, terms: np.ndarray | None):
    if terms is not None:
        return _sparse(*columns, terms)
    m = _dense(columns[0], dim)
    return m, (m**2).sum(1)


def _unit(m: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.where(squares == 0, 1.0, squares))[:, None]


def _rounded(s: np.ndarray) -> np.ndarray:
    """Rounded so that ties are ties everywhere."""
    scale = 10.0**SCORE_PLACES
    return np.rint(s * scale) / scale + 0.0


class _Queries:
    """Part of a block: ids, rows (of unit length for cosine) and what scoring them needs."""

    def __init__(self, ids: np.ndarray, columns: list[pa.Array], metric: str, dim: int | None):
        self.ids, self.metric, self.dim = ids, metric, dim
        self.terms = np.unique(_offsets(columns[0])[0]) if len(columns) == 2 else None
        self.rows, self.squares = _rows(columns, dim, self.terms)
        self.rough = None
        if metric == "cosine":
            self.rows = _unit(self.rows, self.squares)
            if np.isfinite(self.squares).all():
                self.rough = self.rows.astype(np.float32)

    def scores(self, m: np.ndarray, squares: np.ndarray, which=slice(None)) -> np.ndarray:
        """Queries × vectors, larger is better; of the vectors' rows (unit length for cosine) and squared lengths."""
        rows, own = self.rows[which], self.squares[which]
        if self.metric == "cosine":
            return _rounded(rows @ m.T)
        return _rounded(-np.maximum(own[:, None] + squares[None, :] - 2.0 * (rows @ m.T), 0.0))

    def candidates(self, m: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, vectors) as places, which hold all of the k best of unit rows ``m``, and the queries for which
        these are not few and that are left out.

        The product in single precision is off by less than ``margin``, as no row is longer than 1. What is below
        a query's ``floor``, its k-th best score so far, or below k others by more than that is not among the best.
        """
        n, margin = len(m), 1.2 * (m.shape[1] + 8) * 2.0**-24
        rough = self.rough @ m.astype(np.float32).T
        cut = floor - margin
        if n > k and np.isneginf(floor).any():
            cut = np.maximum(cut, np.partition(rough, n - k, axis=1)[:, n - k] - 2 * margin)
        cut = (cut - 10.0**-SCORE_PLACES).astype(np.float32)
        near = rough >= np.nextafter(cut, np.float32(-np.inf))[:, None]
        crowded = np.flatnonzero(np.count_nonzero(near, axis=1) * _FEW > n)
        near[crowded] = False
        return *divmod(np.flatnonzero(near), n), crowded

    def exact(self, m: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of single pairs of a query and a unit row of ``m``."""
        step = max(1, _CELLS // max(1, m.shape[1]))
        s = [np.einsum("ij,ij->i", self.rows[q[i:i + step]], m[c[i:i + step]]) for i in range(0, len(q), step)]
        return _rounded(np.concatenate(s)) if s else np.empty(0)


def _parts(table: pa.Table, names: list[str], metric: str, dim: int | None) -> list[_Queries]:
    """A block cut so that no part's matrix has more than about _CELLS numbers."""
    if not table.num_rows:
        return []
    table = table.combine_chunks()
    ids = table.column("query_id").to_numpy().astype(np.int64)
    columns = [table.column(n).combine_chunks() for n in names]
    width = len(np.unique(_offsets(columns[0])[0])) if len(names) == 2 else dim
    step = max(1, _CELLS // max(1, width))
    return [_Queries(ids[i:i + step], [c.slice(i, step) for c in columns], metric, dim)
            for i in range(0, len(ids), step)]


def _best(q: np.ndarray, o: np.ndarray, s: np.ndarray, k: int):
    """k best rows per query of flat candidates; ties by position."""
    order = np.lexsort((o, -s, q))
    q, o, s = q[order], o[order], s[order]
    start = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - start < k
    return q[keep], o[keep], s[keep]


class _TopK:
    """Running k best per query over batches of vectors."""

    def __init__(self, queries: _Queries, k: int):
        self.queries, self.k = queries, k
        self.q = np.empty(0, np.int64)
        self.o = np.empty(0, np.int64)
        self.s = np.empty(0, np.float64)
        self.floor = np.full(len(queries.ids), -np.inf)  # the k-th best score, once there are k

    def add_batch(self, batch: pa.RecordBatch, names: list[str]) -> None:
        """Score a batch in slices, so that neither matrix grows with the batch."""
        n, width = self.queries.rows.shape
        step = max(1, _CELLS // max(1, width, n))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            ords = part.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)
            self.add(ords, [part.column(c) for c in names])

    def add(self, ords: np.ndarray, columns: list[pa.Array]) -> None:
        own = self.queries
        m, squares = _rows(columns, own.dim, own.terms)
        if own.metric == "cosine":
            m = _unit(m, squares)
        if own.rough is not None and np.isfinite(squares).all():
            q, c, whole = own.candidates(m, self.k, self.floor)
            s = own.exact(m, q, c)
        else:
            q = c = np.empty(0, np.int64)
            s, whole = np.empty(0), np.arange(len(own.ids))
        if len(whole) and len(m):
            every, n = own.scores(m, squares, whole), len(m)
            least = np.partition(every, max(n - self.k, 0), axis=1)[:, max(n - self.k, 0)]
            a, b = np.nonzero(every >= least[:, None])
            q, c, s = (np.concatenate(x) for x in ((q, whole[a]), (c, b), (s, every[a, b])))
        self.q, self.o, self.s = _best(
            np.concatenate([self.q, q]), np.concatenate([self.o, ords[c]]), np.concatenate([self.s, s]), self.k)
        last = np.flatnonzero(np.arange(len(self.q)) - np.searchsorted(self.q, self.q, side="left") == self.k - 1)
        self.floor[self.q[last]] = self.s[last]


def _written_blocks(queries: DataFrame, names: list[str], rows: int) -> tuple[str, int]:
    """Folder with the queries in ``_block=<n>`` folders, and their number."""
    spark = queries.sparkSession
    known = queries.select(F.col("query_id").cast("bigint").alias("query_id"), *names).filter(
        "query_id IS NOT NULL")
    n = max(1, -(-known.count() // rows))
    path = scratch_path(spark, "queries")
    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError) as e:
        raise ValueError(
            f"the tasks cannot read {path}: nearest neighbours need a spark.checkpoint.dir that pyarrow.fs "
            "knows (a path, file:, hdfs:, s3:, gs: or abfs:)") from e
    known.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")) \
        .repartition(n, "_block").write.partitionBy("_block").parquet(path)
    return path, n


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    dim: int | None = None,
    sparse: bool = False,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """k nearest vectors per query: ``(query_id, rank, ord, score)``.

    ``queries`` has ``query_id`` and ``vectors`` has ``ord``, both whole numbers, next to
    ``embedding`` (or ``term_ids, weights`` when sparse). cosine scores fall, l2 scores are
    squared distances and rise; ties go to the smaller ``ord``. k is at least 1 and at most
    the number of vectors; vectors with score 0 count. A query without an id has no result.
    """
    m = check_metric(metric)
    k = max(int(k), 1)
    names = ["term_ids", "weights"] if sparse else ["embedding"]
    if dim is None and not sparse:
        first = queries.filter("query_id IS NOT NULL").select(F.size("embedding").alias("n")).first()
        dim = first["n"] if first else 1
    path, n_blocks = _written_blocks(queries, names, query_block)

    def best(held: list[pa.RecordBatch]):
        store, base = fs.FileSystem.from_uri(path)
        for i in range(n_blocks):
            folder = f"{base}/_block={i}"
            if store.get_file_info(folder).type == fs.FileType.NotFound:
                continue
            block = ds.dataset(folder, filesystem=store, format="parquet").to_table(["query_id", *names])
            for part in _parts(block, names, m, dim):
                top = _TopK(part, k)
                for batch in held:
                    top.add_batch(batch, names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ids[top.q]), pa.array(top.o), pa.array(top.s)],
                    names=["query_id", "ord", "score"])

    def score(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _HELD_BYTES:
                yield from best(held)
                held, size = [], 0
        if held:
            yield from best(held)

    partial = vectors.select(F.col("ord").cast("bigint"), *names).mapInArrow(
        score, "query_id bigint, ord bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"))
    top = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    distance = F.col("score") if m == "cosine" else -F.col("score") + 0.0
    return top.select("query_id", "rank", "ord", distance.alias("score"))
