"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, one of words in toxic and one in ordinary training texts, give each word a
probability byte by byte. Each is interpolated by absolute discounting with one backoff model
that both share, made of continuation counts of both classes, so that an expression that is rare
in either is judged by what both know. A text's score compares its two log-likelihoods,
normalised by length. Whether all words count in it, or those beyond a margin, and which margin,
is chosen on the training rows by folds of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom import session
from tallyloom.llm.common import arrow_schema, as_schema, blocks, field, sliced

ORDER = 5            # bytes of an n-gram; packed into one long
DISCOUNT = 0.75
# What a word's log-likelihood ratio counts for, in nats. None is the plain comparison: all words,
# for and against. With a margin a word counts by what it has beyond; below, the ratio may be what
# the sampling of rare n-grams brings about. The choice is made on folds of the training rows.
MARGINS = (None, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
FOLDS = 2
# Bytes added to a text's length, so that one odd word does not decide a very short text.
PRIOR_BYTES = 100
# Rows of one block of n-grams or of expressions.
BLOCK_ROWS = 1_000_000
# Distinct words a worker counts before it hands them on.
HELD_WORDS = 500_000
# Bins of the histogram that the calibration is fitted to, and its ridge.
BINS = 400
RIDGE = 1e-3
THRESHOLD = 0.3

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_START, _END = b"\x00" * (ORDER - 1), b"\x01"


def words_of(text: str) -> list[bytes]:
    """Words of the lower-cased text: runs of letters, digits and anything beyond ASCII."""
    return _WORD.findall(text.lower().encode())


def packed_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all words as integers, index of the word of each)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b"".join([_START + w + _END for w in words]), np.uint8).astype(np.int64)
    out = np.zeros(len(data) - ORDER + 1, np.int64)
    for k in range(ORDER):
        out = out << 8 | data[k:len(data) - ORDER + 1 + k]
    which = np.repeat(np.arange(len(words)), lengths)
    before = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out[np.repeat(before, lengths) + at], which


def word_counts(rows: DataFrame, text_col: str, label_col: str, fold_col: str) -> DataFrame:
    """(word, ordinary, toxic, fold): counts over all texts of a fold, summed up in the tasks first."""
    schema = as_schema([("word", "binary"), ("ordinary", "long"), ("toxic", "long"), ("fold", "int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[Counter, Counter]] = {}

        def emit():
            for fold, own in counts.items():
                words = list(own[0].keys() | own[1].keys())
                made = [pa.array([c[w] for w in words], pa.int64()) for c in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), *made, pa.array([fold] * len(words), pa.int32())],
                    schema=arrow_schema(schema))

        for b in sliced(batches):
            for text, label, fold in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts.setdefault(fold, (Counter(), Counter()))[label].update(words_of(text or ""))
                if sum(len(c) for own in counts.values() for c in own) > HELD_WORDS:
                    yield from emit()
                    counts = {}
        yield from emit()

    return (rows.select(f"`{text_col}`", F.col(label_col).cast("int"), F.col(fold_col).cast("int"))
            .mapInArrow(run, schema).groupBy("word", "fold")
            .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
            .select("word", "ordinary", "toxic", "fold"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic) of the words' n-grams."""
    schema = as_schema([("gram", "long"), ("ordinary", "long"), ("toxic", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            if not words:
                continue
            grams, which = packed_grams(words)
            distinct, at = np.unique(grams, return_inverse=True)
            sums = [np.bincount(at, weights=b.column(i).to_numpy()[which]).astype(np.int64) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, sums)],
                                             schema=arrow_schema(schema))

    return words.mapInArrow(run, schema).groupBy("gram").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def model(grams: DataFrame) -> DataFrame:
    """(key, ratio): logarithms of the toxic over the ordinary probability.

    A key that is an n-gram holds what it adds to its context; a key that is minus one minus a
    context holds what any n-gram unseen in it has. What stands in neither has 0: both models
    fall back to the shared one.
    """
    low = (1 << 8 * (ORDER - 1)) - 1
    g = grams.withColumn("context", F.shiftright("gram", 8)).withColumn(
        "suffix", F.col("gram").bitwiseAND(F.lit(low)))
    seen = [F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_types") for c in ("ordinary", "toxic")]
    contexts = g.groupBy("context").agg(
        F.sum("ordinary").alias("ordinary_all"), F.sum("toxic").alias("toxic_all"), *seen)

    # shared backoff: in how many left contexts, of either class, a suffix continues
    suffixes = g.groupBy("suffix").agg(F.count("*").alias("continues"))
    lower = suffixes.groupBy(F.shiftright("suffix", 8).alias("lower")).agg(
        F.sum("continues").alias("lower_all"), F.count("*").alias("lower_types"))
    last = suffixes.groupBy(F.col("suffix").bitwiseAND(F.lit(255)).alias("last")).agg(
        F.sum("continues").alias("last_all"))  # at most 256 rows
    every = suffixes.agg(F.sum("continues").alias("every"))
    floor = last.join(F.broadcast(every)).select("last", ((F.col("last_all") + 1) / (F.col("every") + 256)).alias("floor"))
    shared = (
        suffixes.withColumn("lower", F.shiftright("suffix", 8))
        .withColumn("last", F.col("suffix").bitwiseAND(F.lit(255)))
        .join(lower, "lower").join(floor, "last")
        .select("suffix", (((F.col("continues") - DISCOUNT)
                            + DISCOUNT * F.col("lower_types") * F.col("floor")) / F.col("lower_all")).alias("shared")))

    def fallback(c: str) -> Column:
        """Probability that the class leaves to the shared model in this context."""
        return F.when(F.col(f"{c}_all") == 0, 1.0).otherwise(
            DISCOUNT * F.col(f"{c}_types") / F.greatest(F.col(f"{c}_all"), F.lit(1)))

    def probability(c: str) -> Column:
        own = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_all"), F.lit(1))
        return own + fallback(c) * F.col("shared")

    unseen = F.log(fallback("toxic") / fallback("ordinary"))
    of_grams = g.join(contexts, "context").join(shared, "suffix").select(
        F.col("gram").alias("key"),
        (F.log(probability("toxic") / probability("ordinary")) - unseen).alias("ratio"))
    return of_grams.union(contexts.select((-1 - F.col("context")).alias("key"), unseen.alias("ratio")))


def distinct_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word) of all texts, each once."""
    schema = as_schema([("word", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                seen.update(words_of(text or ""))
                if len(seen) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())],
                                                     schema=arrow_schema(schema))
                    seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())],
                                             schema=arrow_schema(schema))

    return docs.select(f"`{text_col}`").mapInArrow(run, schema).distinct()


def expressions(words: DataFrame, ratios: DataFrame) -> DataFrame:
    """(word, total) of the words: their log-likelihood ratios.

    The words pass through the model block by block and gather their sums.
    """
    schema = as_schema([("word", "binary"), ("total", "double")])
    table = blocks(ratios, ["key", "ratio"], BLOCK_ROWS)

    def sorted_block(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, values = t.column("key").to_numpy(), t.column("ratio").to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for part in table.past(batches):
            totals = [np.zeros(b.num_rows) for b in part]
            for keys, values in table.each(sorted_block, kept):
                for k, b in enumerate(part):
                    if not b.num_rows or not len(keys):
                        continue
                    grams, which = packed_grams(b.column(0).to_pylist())
                    gained = np.zeros(len(grams))
                    for key in (grams, -1 - (grams >> 8)):
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        gained += np.where(keys[at] == key, values[at], 0.0)
                    totals[k] += np.bincount(which, weights=gained, minlength=b.num_rows)
            for b, total in zip(part, totals):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(total)],
                                                 schema=arrow_schema(schema))

    return words.select("word").mapInArrow(run, schema)


def weighed(totals: np.ndarray, margin: float | None) -> np.ndarray:
    """What words of these log-likelihood ratios count for."""
    return totals if margin is None else np.maximum(totals - margin, 0.0)


def evidence(docs: DataFrame, table: DataFrame, keep: str, text_col: str, margins: tuple) -> DataFrame:
    """(keep, evidence): for each margin the sum over a whole text's words by its length in bytes.

    The texts pass through the table of expressions block by block; nothing is shuffled.
    """
    schema = as_schema([field(docs, keep), ("evidence", "array<double>")])
    target = arrow_schema(schema)
    told = blocks(table, ["word", "total"], BLOCK_ROWS)

    def lookup(t: pa.Table) -> dict:
        return dict(zip(t.column("word").to_pylist(), t.column("total").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for part in told.past(batches):
            totals = [np.zeros((b.num_rows, len(margins))) for b in part]
            sizes = [np.zeros(b.num_rows) for b in part]
            for known in told.each(lookup, kept):
                for k, b in enumerate(part):
                    for i, text in enumerate(b.column(1).to_pylist()):
                        words = words_of(text or "")
                        found = np.fromiter(filter(None, map(known.get, words)), float)
                        totals[k][i] += [float(weighed(found, m).sum()) for m in margins]
                        sizes[k][i] = sum(map(len, words)) + len(words)
            for k, b in enumerate(part):
                each = totals[k] / (sizes[k] + PRIOR_BYTES)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(target.field(0).type), pa.array(list(each), target.field(1).type)], schema=target)

    return docs.select(f"`{keep}`", f"`{text_col}`").mapInArrow(run, schema)


def scaled(e: Column) -> Column:
    """Evidence on the logarithmic scale that the calibration uses, 0 for none."""
    return F.signum(e) * F.log1p(F.abs(e) * 1000.0)


def calibrate(rows: DataFrame) -> tuple[float, float, float]:
    """(slope, intercept, loss) of a logistic curve over the scaled evidence of (evidence, label) rows.

    The rows are summed into BINS bins by class; the curve is fitted to those sums with a small
    ridge; ``loss`` is its mean log-loss. Without both classes the curve is flat at the known one.
    """
    x = scaled(F.col("evidence"))
    bins = rows.select(F.greatest(F.least(F.floor(x * (BINS / 8.0)), F.lit(BINS - 1)), F.lit(-BINS)).alias("bin"), "label").groupBy(
        "bin").agg(F.count(F.when(F.col("label") == 0, 1)).alias("ordinary"),
                   F.count(F.when(F.col("label") == 1, 1)).alias("toxic")).collect()  # at most 2 * BINS rows
    at = np.array([(b.bin + 0.5) * 8.0 / BINS if b.bin else 0.0 for b in bins])
    n = np.array([(b.ordinary, b.toxic) for b in bins], float).reshape(-1, 2)
    totals = n.sum(axis=0)
    if not totals.all():
        return 0.0, 0.0 if not totals.any() else math.copysign(5.0, totals[1] - totals[0]), 0.0
    n /= totals.sum()
    slope, intercept = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(slope * at + intercept)))
        gap, weight = n[:, 1] * (1 - p) - n[:, 0] * p, n.sum(axis=1) * p * (1 - p)
        gradient = np.array([(gap * at).sum() - RIDGE * slope, gap.sum()])
        hessian = np.array([[(weight * at * at).sum() + RIDGE, (weight * at).sum()],
                            [(weight * at).sum(), weight.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        slope, intercept = slope + step[0], intercept + step[1]
        if np.abs(step).max() < 1e-9:
            break
    x = slope * at + intercept
    loss = (n[:, 1] * np.logaddexp(0.0, -x) + n[:, 0] * np.logaddexp(0.0, x)).sum()
    return float(slope), float(intercept), float(loss)


def choose_margin(taught: DataFrame, words: DataFrame) -> tuple[float | None, float, float]:
    """(margin, slope, intercept): the one of MARGINS whose calibrated evidence has the least log-loss on the
    training rows, each scored by models of the other folds, and the curve of that evidence.

    Of equal ones the first; no other row is looked at. ``taught`` holds (text, label, fold), ``words`` their
    counts by fold. All training rows are used, and none is judged by a model that has seen it.
    """
    scored = None
    for fold in range(FOLDS):
        other = words.filter(F.col("fold") != fold).select("word", "ordinary", "toxic")
        ratios = session.settle(model(session.settle(gram_counts(other), "grams")), "model")
        table = expressions(words.filter(F.col("fold") == fold), ratios)
        own = evidence(taught.filter(F.col("fold") == fold), table, "label", "text", MARGINS)
        scored = own if scored is None else scored.union(own)
    scored = session.settle(scored, "folds")
    curves = [calibrate(scored.select(F.col("evidence")[i].alias("evidence"), "label"))
              for i in range(len(MARGINS))]
    best = int(np.argmin([loss for _, _, loss in curves]))
    return MARGINS[best], *curves[best][:2]


def toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, score, predicted) of every document, learnt from the labelled ones that ``train``, a
    condition on the id, selects.

    Counts are taken over all of those; nothing but texts and labels is used. A document with
    several labels has the largest; null labels teach nothing. Exact copies are in one fold when the
    margin is chosen. Null and empty texts have no
    evidence and get the score of none. Null ids and repeated rows are scored, one row out per
    row in. Without training rows of both classes the score is constant. Long texts are
    scored whole. Further columns are not read.
    """
    key = F.col(f"`{id_col}`")
    known = (labels.select(key.alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .filter("label IN (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
             .hint("merge"))  # labels grow with the documents: one plan for all sizes
    taught = session.settle(
        docs.select(key.alias(id_col), F.col(f"`{text_col}`").alias(text_col)).filter(train)
        .join(known, key == F.col("_id")).select(
            F.col(f"`{text_col}`").alias("text"), "label",
            F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")),
        "taught")
    words = session.settle(word_counts(taught, "text", "label", "fold"), "words")
    margin, slope, intercept = choose_margin(taught, words)
    ratios = session.settle(model(session.settle(gram_counts(words), "grams")), "model")
    table = expressions(distinct_words(docs, text_col), ratios)
    if margin is not None:
        table = table.filter(F.col("total") > margin)
    rows = session.settle(evidence(docs, table, id_col, text_col, (margin,)).select(
        key, F.col("evidence")[0].alias("evidence")), "evidence")
    score = 1 / (1 + F.exp(-(slope * scaled(F.col("evidence")) + intercept)))
    return rows.select(key, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
