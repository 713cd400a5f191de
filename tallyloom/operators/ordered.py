"""Row-order operators (lag, rolling, exponential weighting) without one-task windows.

``positions`` numbers rows inside each key by a range shuffle, so neither a global order
nor a key that holds a third of all rows is sorted in one task. Windows then run inside
blocks of consecutive positions; the rows a block needs from the one before are copied
over (halo) or come as one carried number.

``streamed`` needs no shuffle beyond the one into ranges: a task works its features out while it
writes a range, and only the first rows of a range (or of a key in it) are mended afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyloom.session import settle

BLOCK = 1024

# Gaps in a column: rows of a run in which the last value before a row is looked up.
RUN = 1 << 20
# Exponents in a block stay below the range of doubles: so much per row at most (what came before
# then no longer shows), and so many rows of that.
_FADED = 60.0
_SHORT = 10
# Rows that a task takes at once when it streams a range.
ROWS = 50_000
# A row's place in its range is in these bits of ``_mid``, the range above them.
_PLACE = (1 << 33) - 1


def _ranged(
    df: DataFrame, cols: list[str], partitions: int | None, unique: bool = False, then=None
) -> DataFrame:
    """Rows sorted over all partitions, with ``_mid`` = partition · 2³³ + place in it; as ``then`` makes them.

    Rows go to ranges by the sort columns alone if these tell rows apart, so a task that runs
    again sends them the same way. Else the input is written with a running number first, the
    last sort column, so that even many exact copies of a row spread over the ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not unique:
        df = settle(df.withColumn("_tie", F.monotonically_increasing_id()), "input")
        cols = [*cols, "_tie"]
    ranged = (
        df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).drop("_tie")
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return settle(ranged if then is None else then(ranged), "ranged")


def positions(
    df: DataFrame, keys: list[str], order_cols: list[str], partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add ``_pos``: 0-based place of a row inside its key, by ``order_cols``.

    One range shuffle on (keys, order_cols), so neither a hot key nor a hot date is sorted in
    one task. The place is the offset of the (key, partition) run plus the place inside the
    run. The table of runs has one row per partition and key change; it is written too, so
    the planner joins it by its true size. Keys must not be null. ``unique`` says that the order
    columns tell rows apart, which saves a copy of the input; a few rows that are alike in them
    all the same only stay together.
    """
    return placed(_ranged(df, [*keys, *order_cols], partitions, unique), keys, df.columns)


def placed(ranged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns of rows in ranges, with ``_pos``."""
    run = F.shiftright("_mid", 33).alias("_run")
    runs = ranged.groupBy(*keys, run).agg(
        F.count("*").alias("_len"), F.min("_mid").alias("_first")
    )
    over_runs = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_run")
    before = F.coalesce(
        F.sum("_len").over(over_runs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    runs = settle(runs.select(*keys, "_run", (before - F.col("_first")).alias("_shift")), "runs")
    return (
        ranged.withColumn("_run", run).join(runs, [*keys, "_run"])
        .select(*columns, (F.col("_mid") + F.col("_shift")).alias("_pos"))
    )


def _windows(keys: list[str]):
    return Window.partitionBy(*keys, "_block").orderBy("_pos")


def lag_roll(
    df: DataFrame,
    keys: list[str],
    value_col: str,
    lags: list[int],
    windows: list[int],
    suffix: str = "",
    block: int = BLOCK,
) -> DataFrame:
    """Add ``{v}_lag_{n}`` and ``{v}_rolling_{mean,std,max}_{w}`` to rows that have ``_pos``.

    One shuffle on (keys, block) serves all lags and windows; the rows at a block's end are
    copied into the next block and dropped again after the windows.
    """
    reach = max([*lags, *[w - 1 for w in windows], 0])
    size = max(block, reach + 1)
    out = df.withColumn("_block", F.floor(F.col("_pos") / size))
    if reach:
        is_tail = F.col("_pos") % size >= size - reach
        halo = F.when(is_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = (
            out.withColumn("_copy", F.explode(halo))
            .withColumn("_block", F.col("_block") + F.col("_copy"))
        )
    w = _windows(keys)
    v = F.col(value_col)
    new = {}
    for n in lags:
        new[f"{value_col}_lag_{n}{suffix}"] = F.lag(v, n).over(w)
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        new[f"{value_col}_rolling_mean_{n}{suffix}"] = F.avg(v).over(frame)
        new[f"{value_col}_rolling_std_{n}{suffix}"] = F.stddev_samp(v).over(frame)
        new[f"{value_col}_rolling_max_{n}{suffix}"] = F.max(v).over(frame)
    out = out.withColumns(new)
    if reach:
        out = out.filter(F.col("_copy") == 0).drop("_copy")
    return out.drop("_block")


def ewm(
    df: DataFrame,
    keys: list[str],
    value_col: str,
    alphas: dict[str, float],
    pos_col: str = "_pos",
    block: int = BLOCK,
) -> DataFrame:
    """Add exponentially weighted means: y₀ = x₀, yₜ = (1−a)·yₜ₋₁ + a·xₜ, one per alpha.

    Inside a block the mean is a running sum of x scaled by (1−a)^−j; the value that a block
    hands to the next ones decays by (1−a) per row, and it is handed on until it would
    underflow, so no block waits for the one before.

    A column with nulls goes through ``_ewm_with_gaps``.
    """
    if not df.filter(F.col(value_col).isNull()).isEmpty():
        return _ewm_with_gaps(df, keys, value_col, alphas, pos_col, block)
    out = df
    by_size: dict[int, dict[str, float]] = {}
    for name, a in alphas.items():
        if not 0 < a <= 1:
            raise ValueError(f"smoothing factor must be in (0, 1], got {a}")
        decay = -math.log1p(-a) if a < 1 else math.inf
        size = max(1, min(block, int(500 / decay)))
        by_size.setdefault(size, {})[name] = a
    x = F.col(value_col).cast("double")
    for size, group in by_size.items():
        out = out.withColumn("_block", F.floor(F.col(pos_col) / size)).withColumn(
            "_j", (F.col(pos_col) % size).cast("int")
        )
        w = Window.partitionBy(*keys, "_block").orderBy(pos_col).rowsBetween(
            Window.unboundedPreceding, 0)
        totals, handed, sums = [], [], {}
        reach = 1
        for i, (name, a) in enumerate(group.items()):
            b = 1.0 - a
            weight = F.when(F.col(pos_col) == 0, F.lit(1.0)).otherwise(F.lit(a))
            if b == 0.0:
                totals.append(F.lit(0.0).alias(f"_c{i}"))
                handed.append(F.lit(0.0).alias(f"_c{i}"))
                continue
            # value at the end of a full block that comes from the block's own rows
            totals.append(
                F.sum(weight * x * F.pow(F.lit(b), F.lit(size - 1) - F.col("_j"))).alias(f"_c{i}")
            )
            steps = max(1, math.ceil(745 / (-math.log(b) * size)))
            reach = max(reach, steps)
            fade = F.pow(F.lit(b), F.col("_m") * size)
            handed.append(F.sum(F.col(f"_c{i}") * fade).alias(f"_c{i}"))
            sums[f"_s{i}"] = F.sum(weight * x * F.pow(F.lit(b), -F.col("_j"))).over(w)
        carry = (
            out.groupBy(*keys, "_block").agg(*totals)
            .withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))))
            .groupBy(*keys, (F.col("_block") + F.col("_m") + 1).alias("_block"))
            .agg(*handed)
        )
        names = [*keys, "_block"]
        cols = [c for c in out.columns if c not in ("_block", "_j")]
        # the rows are already laid out by (keys, block) for the running sums
        joined = (out.withColumns(sums) if sums else out).join(carry, names, "left")
        results = []
        for i, (name, a) in enumerate(group.items()):
            b = 1.0 - a
            if b == 0.0:
                results.append(x.alias(name))
                continue
            from_before = F.coalesce(F.col(f"_c{i}"), F.lit(0.0)) * F.pow(
                F.lit(b), F.col("_j") + 1
            )
            own = F.col(f"_s{i}") * F.pow(F.lit(b), F.col("_j"))
            results.append((from_before + own).alias(name))
        out = joined.select(*cols, *results)
    return out


def _last_before(df: DataFrame, keys: list[str], value_col: str, pos_col: str) -> DataFrame:
    """Add ``_prev``: place of the last row before this one, in its key, that has a value.

    Looked up inside runs of RUN rows, and over the table of runs for what lies before them.
    """
    at = F.when(F.col(value_col).isNotNull(), F.col(pos_col))
    rows = df.withColumn("_run", F.floor(F.col(pos_col) / RUN))
    over_runs = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_run")
    runs = rows.groupBy(*keys, "_run").agg(F.max(at).alias("_max")).select(
        *keys, "_run", F.max("_max").over(over_runs.rowsBetween(Window.unboundedPreceding, -1)).alias("_old"))
    inside = Window.partitionBy(*keys, "_run").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.max(at).over(inside)).join(runs, [*keys, "_run"]).withColumn(
        "_prev", F.coalesce("_in", "_old")).drop("_run", "_in", "_old")


def _scan(rows: DataFrame, keys: list[str], n: int, size: int, last: int) -> DataFrame:
    """``_y{i}`` of yₜ = exp(l)·yₜ₋₁ + b for the ``n`` pairs of columns ``_l{i}``, ``_b{i}``, starting at 0.

    ``_p`` numbers the rows of a key without holes, up to ``last``. Inside a block the values are a
    scaled running sum; the blocks' ends are a sequence of the same kind, with fewer rows, that is
    scanned in the same way.
    """
    blocks = rows.withColumn("_blk", F.floor(F.col("_p") / size))
    w = Window.partitionBy(*keys, "_blk").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumns({f"_s{i}": F.sum(f"_l{i}").over(w) for i in range(n)})
    out = out.withColumns({
        f"_y{i}": F.exp(f"_s{i}") * F.sum(F.col(f"_b{i}") * F.exp(-F.col(f"_s{i}"))).over(w) for i in range(n)})
    if last >= size:
        ends = _block_ends(out, keys, n)
        after = _scan(ends, keys, n, _SHORT, last // size).select(
            *keys, (F.col("_p") + 1).alias("_blk"), *[F.col(f"_y{i}").alias(f"_c{i}") for i in range(n)])
        out = out.join(after, [*keys, "_blk"], "left").withColumns({
            f"_y{i}": F.col(f"_y{i}") + F.exp(f"_s{i}") * F.coalesce(f"_c{i}", F.lit(0.0)) for i in range(n)}
        ).drop(*[f"_c{i}" for i in range(n)])
    return out.drop("_blk", *[f"_s{i}" for i in range(n)])


def _block_ends(out: DataFrame, keys: list[str], n: int) -> DataFrame:
    """What each block does to a value that comes in: its factor, and what it adds."""
    return out.groupBy(*keys, F.col("_blk").alias("_p")).agg(
        *[F.greatest(F.sum(f"_l{i}"), F.lit(-_FADED)).alias(f"_l{i}") for i in range(n)],
        *[F.max_by(f"_y{i}", out["_p"]).alias(f"_b{i}") for i in range(n)])


def _ewm_with_gaps(
    df: DataFrame, keys: list[str], value_col: str, alphas: dict[str, float], pos_col: str, block: int
) -> DataFrame:
    """``ewm`` of a column with nulls: a null keeps the mean, and the weight of the past fades on.

    After a gap of g rows yₜ = (w·yₜ₋₁ + a·xₜ) / (w + a) with w = (1−a)^(g+1). There is no mean
    before the first value.
    """
    names = list(alphas)
    x = F.col(value_col).cast("double")
    rows = _last_before(df, keys, value_col, pos_col).withColumn("_p", F.col(pos_col))
    first, steps = F.col("_prev").isNull(), F.col(pos_col) - F.col("_prev")
    size = block
    new = {}
    for i, (name, a) in enumerate(alphas.items()):
        if not 0 < a <= 1:
            raise ValueError(f"smoothing factor must be in (0, 1], got {a}")
        decay = -math.log1p(-a) if a < 1 else math.inf
        size = max(1, min(size, int(500 / decay))) if a < 1 else min(size, _SHORT)
        old = F.exp(-decay * steps) if a < 1 else F.lit(0.0)
        log_old = -decay * steps if a < 1 else F.lit(-_FADED)
        factor = F.greatest(log_old - F.log(old + a), F.lit(-_FADED))
        new[f"_l{i}"] = F.when(x.isNull() | first, F.lit(0.0)).otherwise(factor)
        new[f"_b{i}"] = F.when(x.isNull(), F.lit(0.0)).when(first, x).otherwise(x * a / (old + a))
    last = df.agg(F.max(pos_col).alias("last")).first()["last"] or 0
    done = _scan(rows.withColumns(new), keys, len(names), size, last)
    known = F.col("_prev").isNotNull() | F.col(value_col).isNotNull()
    return done.select(*df.columns, *[
        F.when(known, F.col(f"_y{i}")).alias(name) for i, name in enumerate(names)])


def _sizes(alphas: dict[str, float]) -> dict[str, tuple[float, int]]:
    """Factor and rows of a block whose scaled sums stay in the range of doubles."""
    out = {}
    for name, a in alphas.items():
        if not 0 < a <= 1:
            raise ValueError(f"smoothing factor must be in (0, 1], got {a}")
        out[name] = a, max(1, min(BLOCK, int(500 / -math.log1p(-a)))) if a < 1 else 1
    return out


def _smoothed(x: np.ndarray, a: float, size: int, before: float) -> np.ndarray:
    """yₜ = (1−a)·yₜ₋₁ + a·xₜ after ``before``, in blocks of ``size``."""
    if a == 1:
        return x.copy()
    rows = np.zeros((-(-len(x) // size), size))
    rows.ravel()[:len(x)] = x
    fade = (1 - a) ** np.arange(size)
    rows = np.cumsum(rows * (a / fade), axis=1) * fade
    ends, old = rows[:, -1].tolist(), []
    for end in ends:
        old.append(before)
        before = end + before * (1 - a) ** size
    return (rows + np.array(old)[:, None] * (fade * (1 - a))).ravel()[:len(x)]


def _rolled(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Mean, std and max of the last ``n`` values, of those that have so many before and with them."""
    rows = [x[i:len(x) - n + 1 + i] for i in range(n)]
    total, most, mean, squares = 0.0, rows[0], 0.0, 0.0
    for i, r in enumerate(rows, 1):  # in the steps of Spark's own, so that results round alike
        total, most = total + r, np.maximum(most, r)
        delta = r - mean
        mean = mean + delta / i
        squares = squares + delta * (delta - delta / i)
    return [total / n, np.sqrt(squares / (n - 1)) if n > 1 else np.full(len(most), np.nan), most]


class _Kept:
    """The last rows of each key of a range: keys, values and ``_mid``, in order within a key."""

    def __init__(self, reach: int):
        self.reach, self.rows = reach, None

    def lagged(self, own: pa.Table, lags: list[int]) -> tuple[list[pa.Array], np.ndarray]:
        """Earlier values of each further row, as far as known, and how many rows of its key come before it, at most
        ``reach``; a row without a key has none that could come."""
        every = own if self.rows is None else pa.concat_tables([self.rows, own])
        every = every.combine_chunks()
        m = every.num_rows - own.num_rows
        code = every.column("key").combine_chunks().dictionary_encode().indices
        code = code.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        first = np.concatenate([[True], code[order][1:] != code[order][:-1]])
        start = np.flatnonzero(first)
        place = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
        left = np.repeat(np.diff([*start, len(order)]), np.diff([*start, len(order)])) - place
        known = code[order] >= 0
        values, out = every.column("value").combine_chunks(), []
        for n in lags:
            source = np.full(len(order), -1)
            source[order[n:]] = np.where((place >= n) & known, np.concatenate([np.full(n, -1), order[:-n]]), -1)[n:] \
                if n < len(order) else -1
            source = source[m:]
            out.append(values.take(pa.array(source, mask=source < 0)))
        before = np.empty(len(order), np.int32)
        before[order] = np.where(known, np.minimum(place, self.reach), self.reach)
        self.rows = every.take(pa.array(order[known & (left <= self.reach)]))
        return out, before[m:]


def _stream_schema(df: DataFrame, value_col: str, groups: list[str], names: list[str]) -> T.StructType:
    kinds = {c: df.schema[value_col].dataType if "_lag_" in c else T.DoubleType() for c in names}
    return T.StructType([
        *(T.StructField(f.name, f.dataType) for f in df.schema.fields), T.StructField("_mid", T.LongType()),
        T.StructField("_kind", T.IntegerType()), *(T.StructField(f"_j{i}", T.IntegerType())
                                                   for i in range(len(groups) or 1)),
        *(T.StructField(c, k) for c, k in kinds.items())])


def streamed(
    df: DataFrame, value_col: str, order_cols: list[str], unique: bool, lags: list[int] = (),
    windows: list[int] = (), alphas: dict[str, float] | None = None, groups: list[str] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the features of ``ewm`` and ``lag_roll`` over all of them, or of the lags by each of the ``groups``.

    Rows move once, into ranges by the order columns; a task works the features out in the order of its range, and
    writes behind its rows the last ones of each key. What the first rows of a range lack is worked out of these and
    joined to these few rows alone. Also the settled rows (columns of ``df`` and ``_mid``); of a column with nulls, or
    NaN, means and the like are not made, and the first is None.
    """
    alphas, own_keys = alphas or {}, list(groups) or [None]
    reach = max([*lags, *[n - 1 for n in windows], 1])
    sizes = _sizes(alphas)
    numbers = bool(windows or alphas)
    rolls = [f"{value_col}_rolling_{kind}_{n}" for n in windows for kind in ("mean", "std", "max")]
    lag_names = [[f"{value_col}_lag_{n}" + (f"_{g}" if g else "") for n in lags] for g in own_keys]
    names = [*alphas, *sum(lag_names, []), *rolls]
    schema = _stream_schema(df, value_col, list(groups), names)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [_Kept(reach) for _ in own_keys]
        ends, before, gaps, kinds = dict.fromkeys(alphas, 0.0), np.empty(0), 0, None
        held, n = [], 0

        def made(t: pa.Table) -> pa.RecordBatch:
            nonlocal before, gaps
            n, value = t.num_rows, t.column(value_col).combine_chunks()
            new, places = {}, []
            for own, g, to in zip(kept, own_keys, lag_names):
                keys = t.column(g).combine_chunks() if g else pa.array(np.zeros(n, np.int8))
                found, place = own.lagged(pa.table({"key": keys, "value": value, "mid": t.column("_mid")}), list(lags))
                new |= dict(zip(to, found))
                places.append(pa.array(place, pa.int32()))
            if numbers:
                x = value.cast(pa.float64()).to_numpy(zero_copy_only=False)
                gaps |= int(np.isnan(x).any())
                for name, (a, size) in sizes.items():
                    y = _smoothed(x, a, size, ends[name])
                    ends[name] = float(y[-1])
                    new[name] = pa.array(y)
                longer = np.concatenate([before, x])
                for i, w in enumerate(windows):
                    done = _rolled(longer, w) if len(longer) >= w else [np.empty(0)] * 3
                    for name, r in zip(rolls[3 * i:], done):
                        r = np.concatenate([np.full(max(0, n - len(r)), np.nan), r[max(0, len(r) - n):]])
                        new[name] = pa.array(r, mask=np.isnan(r))
                before = longer[max(0, len(longer) - reach):]
            return pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in (*columns, "_mid")), pa.array(np.zeros(n, np.int32)), *places,
                 *(new[c] for c in names)], names=schema.names)

        def flat(b):
            return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                out = made(pa.Table.from_batches(held).combine_chunks())
                kinds = out.schema
                yield pa.RecordBatch.from_arrays(flat(out.columns), names=schema.names)
                held, n = [], 0
        if held:
            out = made(pa.Table.from_batches(held).combine_chunks())
            kinds = out.schema
            yield pa.RecordBatch.from_arrays(flat(out.columns), names=schema.names)
        for i, (own, g) in enumerate(zip(kept, own_keys)):
            if own.rows is None:
                continue
            n = own.rows.num_rows
            cells = {"_kind": pa.array(np.full(n, i + 1, np.int32)), "_mid": own.rows.column("mid"),
                     value_col: own.rows.column("value"), "_j0": pa.array(np.full(n, gaps, np.int32))}
            if g and g != value_col:
                cells[g] = own.rows.column("key")
            cells |= {name: pa.array(np.full(n, end)) for name, end in ends.items()}
            yield pa.RecordBatch.from_arrays(flat(
                [cells.get(c, pa.nulls(n, kinds.field(c).type)) for c in schema.names]), names=schema.names)

    every = _ranged(df, list(order_cols), None, unique, lambda rows: rows.mapInArrow(run, schema))
    rows = every.filter("_kind = 0")
    plain = rows.select(*columns, "_mid")
    if numbers and not every.filter("_kind = 1 AND _j0 = 1").isEmpty():
        return None, plain
    out = rows
    heads = [rows.filter(F.col(f"_j{i}") < reach) for i in range(len(own_keys))]
    if sizes:
        carried = _carried(every, value_col, sizes)
        out = rows.join(F.broadcast(carried), F.shiftright("_mid", 33) == F.col("_run")).drop("_run")
        out = out.withColumns({name: F.col(name) + F.col(f"_c_{name}") * F.pow(
            F.lit(1 - a), F.col("_mid").bitwiseAND(F.lit(_PLACE)) + 1) for name, (a, _) in sizes.items()})
    mended = [c for c in names if c not in alphas]
    if mended:
        few = F.lit(False)
        for i in range(len(own_keys)):
            few = few | (F.col(f"_j{i}") < reach)
        lacking = out.filter(few)
        for i, (g, to) in enumerate(zip(own_keys, lag_names)):
            found = [*to, *rolls]
            fixes = _mended(heads[i], every.filter(F.col("_kind") == i + 1), i, g, value_col, list(lags), list(windows),
                            found, T.StructType([f for f in schema.fields if f.name in found]))
            fixes = fixes.select(F.col("_mid").alias("_of"), *[F.col(c).alias(f"_f_{c}") for c in found])
            lacking = lacking.join(fixes, F.col("_mid") == F.col("_of"), "left").withColumns({
                c: F.coalesce(F.col(f"_f_{c}"), F.col(c)) for c in found}).drop("_of", *[f"_f_{c}" for c in found])
        out = out.filter(~few).select(*columns, *names).unionByName(lacking.select(*columns, *names))
    return out.select(*columns, *names), plain


def _carried(every: DataFrame, value_col: str, sizes: dict[str, tuple[float, int]]) -> DataFrame:
    """(_run, _c_…): the means that come into each range from those before; one small row per range."""
    run = F.shiftright("_mid", 33)
    last = every.filter("_kind = 1").groupBy(run.alias("_run")).agg(
        (F.max("_mid").bitwiseAND(F.lit(_PLACE)) + 1).alias("n"),
        *[F.max(F.col(name)).alias(name) for name in sizes])
    first = every.filter((F.col("_kind") == 0) & (F.col("_mid").bitwiseAND(F.lit(_PLACE)) == 0)).select(
        run.alias("_run"), F.col(value_col).cast("double").alias("x"))

    def carry(t: pa.Table) -> pa.Table:
        t = t.sort_by("_run")
        n, x = t.column("n").to_pylist(), t.column("x").to_pylist()
        out = {"_run": t.column("_run")}
        for name, (a, _) in sizes.items():
            c, before = [], x[0]  # as if the first value had always been there
            for size, end in zip(n, t.column(name).to_pylist()):
                c.append(before)
                before = end + before * (1 - a) ** size
            out[f"_c_{name}"] = pa.array(c, pa.float64())
        return pa.table(out)

    return last.join(first, "_run").groupBy().applyInArrow(
        carry, "_run long, " + ", ".join(f"_c_{name} double" for name in sizes))


def _mended(heads: DataFrame, tails: DataFrame, i: int, g: str | None, value_col: str, lags: list[int],
            windows: list[int], names: list[str], kinds: T.StructType) -> DataFrame:
    """(_mid, names) of the first rows of each key in a range, out of its last rows in the ranges before."""
    key = F.col(g) if g else F.lit(0)
    both = heads.select(key.alias("_key"), "_mid", F.col(f"_j{i}").alias("_j"), F.col(value_col).alias("_v")).unionByName(
        tails.select(key.alias("_key"), "_mid", F.lit(-1).alias("_j"), F.col(value_col).alias("_v")))
    kinds = T.StructType([T.StructField("_mid", T.LongType()), *kinds.fields])
    order = [f.name for f in kinds.fields]

    def mend(t: pa.Table) -> pa.Table:
        t = t.sort_by("_mid").combine_chunks()
        j = t.column("_j").to_numpy()
        tail, head = t.filter(pa.array(j < 0)), t.filter(pa.array(j >= 0))
        j, mid = j[j >= 0], head.column("_mid").to_numpy()
        # tails in ranges before that of the row
        offset = np.searchsorted(tail.column("_mid").to_numpy() >> 33, mid >> 33)
        out, values = {"_mid": head.column("_mid")}, tail.column("_v").combine_chunks()
        for n, name in zip(lags, names):
            at = np.where(j < n, offset - (n - j), -1)
            out[name] = values.take(pa.array(at, mask=at < 0))
        if windows:
            x, own = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (
                values, head.column("_v").combine_chunks()))
            longest = max(windows)
            found = [[] for _ in range(3 * len(windows))]
            for place, at, k in zip(j.tolist(), offset.tolist(), range(len(j))):
                seen = np.concatenate([x[max(0, at - longest):at], own[k - place:k + 1]])
                for w, n in enumerate(windows):
                    stats = [None] * 3
                    if place < n - 1:
                        part = seen[-n:]
                        stats = [float(r[0]) for r in _rolled(part, len(part))]
                        stats[1] = None if len(part) == 1 else stats[1]
                    for to, r in zip(found[3 * w:], stats):
                        to.append(r)
            out |= {name: pa.array(r, pa.float64()) for name, r in zip(names[len(lags):], found)}
        return pa.table({c: out[c] for c in order})

    return both.groupBy("_key").applyInArrow(mend, kinds)
