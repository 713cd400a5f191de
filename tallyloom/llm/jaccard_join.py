"""N-gram Jaccard self-join with adaptive multi-match prefixes: its links and the groups they make.

A document is the set of its distinct word shingles, in one global order from rare to frequent.
Two sets with a Jaccard similarity of at least the threshold share at least k shingles within
the first n - ceil(threshold * n) + k of each, for every k. Each document picks its own k: a
longer prefix costs more list entries, but asks for k common ones before a pair is verified.
A pair is a candidate if it shares at least the smaller of the two k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyloom import session
from tallyloom.llm.common import arrow_schema, as_schema, field, sliced
from tallyloom.llm.components import components
from tallyloom.llm.word_hashes import WordHashes, mixed

SHINGLE = 5
PERCENT = 80
# The frequency sketch: cells of the broadcast table (4 bytes each), and rows it travels in.
CELL_BITS = 20
PARTS = 64
# Longest k, and what verifying a candidate costs in list entries read.
MAX_MATCHES = 3
VERIFY_COST = 20.0
# Documents in one outgoing record batch of entries hold about so many.
EMIT_ENTRIES = 200_000
# Ratio of neighbouring size classes, within which entries of a list meet.
SIZE_STEP = 1.05
# Bits of the broadcast filter that keeps texts of no interest out of a shuffle.
FILTER_BITS = 24
# A list of so many entries may be that of a large group: its nodes meet so many of them first.
MANY = 8
STARS = 4
# Nodes of a group that meet those of another such block, and shingles that a task lays out for them at a time.
BLOCK_NODES = 128
BLOCK_SHINGLES = 1 << 16

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than SHINGLE are one shingle."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _PRIME + words[k:len(words) - width + 1 + k]
    return np.unique(mixed(out))


def digest(words: np.ndarray) -> bytes:
    """Name of a sequence of words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def least_shared(n: int) -> int:
    """Fewest shingles that a set of n shares with any partner."""
    return -(-PERCENT * n // 100)


def choose_matches(counts: np.ndarray, n: int) -> int:
    """k of a document of n shingles, the first of which have these estimated counts.

    Lists read: the counts of the prefix. Candidates: each needs k of those entries.
    """
    base = n - least_shared(n)
    read = np.cumsum(counts)[base:]
    k = np.arange(1, len(read) + 1)
    return int(np.argmin(read + VERIFY_COST * read / k)) + 1


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Settled rows: (_id, key, node, n) per document, and (part, cells) with the sketch of each task.

    ``node`` is a digest of the word sequence: exact copies are one node, counted once per task. ``key``
    hashes the text and tells rows of one id apart.
    """
    schema = as_schema([("_id", field(docs, id_col).dataType.simpleString()), ("key", "long"),
                        ("node", "binary"), ("n", "long"), ("part", "int"), ("cells", "binary")])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, size = WordHashes(), {}, 1 << CELL_BITS
        cells, waiting, held = np.zeros(size, np.uint32), [], 0
        for b in sliced(batches):
            nodes, ns = [], []
            for words in hashes.of_texts(b.column(2)):
                node = digest(words) if len(words) else None
                n = seen.get(node) if len(words) else 0
                if n is None:
                    own = shingles(words)
                    n = seen[node] = len(own)
                    waiting.append(cells_of(own))
                    held += n
                    if held > size:
                        cells += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
                        waiting, held = [], 0
                nodes.append(node)
                ns.append(n)
            k = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), b.column(1), pa.array(nodes, pa.binary()),
                 pa.array(ns, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema=target)
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
        if seen:
            parts = [p.tobytes() for p in np.split(cells, PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, target.field(0).type), pa.nulls(PARTS, pa.int64()),
                 pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()),
                 pa.array(parts, pa.binary())], schema=target)

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("key"), text.alias("_text"))
    return session.settle(rows.mapInArrow(run, schema), "nodes")


def _merged(rows: DataFrame, merge: np.ufunc, dtype, size: int) -> np.ndarray:
    """One array out of (part, cells) rows, in two steps, so that no task reads those of all
    others. PARTS rows of fixed size reach the driver."""
    schema = as_schema([("part", "int"), ("cells", "binary")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(cells, dtype)
                total[part] = merge(total[part], cells) if part in total else cells
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()),
                 pa.array([c.tobytes() for c in total.values()], pa.binary())],
                schema=arrow_schema(schema))

    # merged where they are read first: a task's input holds the arrays of many writers
    merged = rows.mapInArrow(add, schema).repartition(PARTS, "part").mapInArrow(add, schema)
    out = np.zeros((PARTS, size // PARTS), dtype)
    for part, cells in merged.collect():
        out[part] = np.frombuffer(cells, dtype)
    return out.ravel()


def _sketch(nodes: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches. The counts only order shingles and estimate costs."""
    return _merged(nodes.filter("part IS NOT NULL").select("part", "cells"), np.add, np.uint32,
                   1 << CELL_BITS)


def _bit(nodes: np.ndarray) -> np.ndarray:
    """Place in the filter of digests, given as rows of bytes."""
    return nodes[:, :4].copy().view(np.uint32).ravel() >> np.uint32(32 - FILTER_BITS)


def _as_bytes(nodes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(nodes.to_pylist()), np.uint8).reshape(-1, 16)


def _filter(nodes: DataFrame) -> np.ndarray:
    """Bits that are set for the nodes; others may share a bit, which costs their texts a shuffle."""
    schema = as_schema([("part", "int"), ("cells", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_bit(_as_bytes(b.column(0)))] = True
        if bits.any():
            parts = [p.tobytes() for p in np.split(np.packbits(bits), PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())],
                schema=arrow_schema(schema))

    return _merged(nodes.mapInArrow(run, schema), np.bitwise_or, np.uint8, (1 << FILTER_BITS) // 8)


def _entries(docs: DataFrame, text_col: str, sketch) -> DataFrame:
    """(token, node, packed, last) of each document's prefix, once per task for exact copies.

    ``packed`` holds n, k and the token's place; ``last`` where the prefix ends in the global order.
    """
    schema = as_schema([("token", "long"), ("node", "binary"), ("packed", "long"), ("last", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        # the upper half of a float32 keeps the order of the counts and sorts by radix
        counts = sketch.value
        ranks = (counts.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)
        for b in sliced(batches):
            tokens, nodes, packed, last, held = [], [], [], [], 0

            def emit():
                sizes = [len(t) for t in tokens]
                which = np.repeat(np.arange(len(nodes)), sizes)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)),
                     pa.array(nodes, pa.binary()).take(pa.array(which)),
                     pa.array(np.concatenate(packed)), pa.array(np.repeat(last, sizes), pa.int64())],
                    schema=arrow_schema(schema))

            for words in hashes.of_texts(b.column(0)):
                node = digest(words)
                if not len(words) or node in seen:
                    continue
                seen.add(node)
                own = shingles(words)
                cells = cells_of(own)
                rank = ranks[cells]
                order = np.argsort(rank, kind="stable")  # ties by hash: own is sorted
                first = order[:len(own) - least_shared(len(own)) + MAX_MATCHES]
                k = choose_matches(counts[cells[first]].astype(np.float64), len(own))
                prefix = first[:len(own) - least_shared(len(own)) + k]
                tokens.append(own[prefix])
                nodes.append(node)
                end = prefix[-1]
                last.append(int(rank[end]) << 47 | int(own[end]) >> 17)
                packed.append((len(own) << 32 | k << 28) + np.arange(len(prefix), dtype=np.int64))
                held += len(prefix)
                if held > EMIT_ENTRIES:
                    yield emit()
                    tokens, nodes, packed, last, held = [], [], [], [], 0
            if tokens:
                yield emit()

    return docs.select(f"`{text_col}`").mapInArrow(run, schema)


def _unpacked(lists: DataFrame) -> DataFrame:
    """Columns of the entries: n, k and place in the document's prefix."""
    return lists.select(
        "token", "node", "component", "last", F.shiftright("packed", 32).alias("n"),
        F.shiftright("packed", 28).bitwiseAND(F.lit(15)).alias("k"),
        F.col("packed").bitwiseAND(F.lit((1 << 28) - 1)).alias("place"))


def _least(n: Column) -> Column:
    """``least_shared`` of a column."""
    return F.ceil(PERCENT * n / 100)


def _largest_partner(n: Column, m: Column) -> Column:
    """Most shingles of a set that is similar enough to one of n shingles when they share m."""
    return F.floor((100 + PERCENT) * m / PERCENT) - n


def _bounded(entries: DataFrame) -> DataFrame:
    """Entries (token, node, n, k, place, last) of lists with more than one node, with ``m`` and ``live``.

    A list of one component counts as one of one node: it tells of no partner that is looked for.

    Of two sets, take the one whose prefix ends first in the global order: each of its prefix
    tokens that the other has is in the other's prefix too. So if u of them stand in no list with
    another node, the two share at most m = n - u shingles. ``live`` is the token's place
    among the others of the prefix.
    """
    by_node = Window.partitionBy("node")
    prefix = F.col("n") - _least(F.col("n")) + F.col("k")
    return session.settle(
        entries.withColumn("m", F.col("n") - (prefix - F.count("*").over(by_node)))
        .withColumn("live", F.row_number().over(by_node.orderBy("place")) - 1), "lists")


def _possible(lo: Column, hi: Column) -> Column:
    """Whether two sets with a token in common can share enough, ``lo`` being the one whose prefix
    ends first: at most all that either has before it, the token, and all that either has behind it."""
    before = F.least(lo["live"], hi["place"])
    behind = F.least(lo["m"] - lo["live"], hi["n"] - hi["place"])
    return (100 + PERCENT) * (before + behind) >= PERCENT * (lo["n"] + hi["n"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets are similar enough."""
    schema = as_schema([("a", "binary"), ("b", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                shared = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append((100 + PERCENT) * shared >= PERCENT * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("p"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("q"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "p", "q") \
        .mapInArrow(run, schema)


def _sets(docs: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """(node, set) of the nodes in (a, b) pairs, one row each, the set as sorted hashes."""
    schema = as_schema([("node", "binary"), ("text", "string")])
    out = as_schema([("node", "binary"), ("set", "binary")])
    wanted = session.settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    shipped = docs.sparkSession.sparkContext.broadcast(_filter(wanted))  # 1 << FILTER_BITS bits

    def name(batches):
        seen, hashes, bits = set(), WordHashes(), np.unpackbits(shipped.value)
        for b in sliced(batches):
            nodes, at = [], []
            for i, words in enumerate(hashes.of_texts(b.column(0))):
                node = digest(words) if len(words) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    at.append(i)
            if not nodes:
                continue
            keep = np.flatnonzero(bits[_bit(_as_bytes(pa.array(nodes, pa.binary())))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in keep], pa.binary()),
                 b.column(0).take(pa.array([at[i] for i in keep], pa.int64())).cast(pa.string())],
                schema=arrow_schema(schema))

    def hashed(batches):
        hashes = WordHashes()
        for b in sliced(batches):
            made = [shingles(words).tobytes() for words in hashes.of_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(made, pa.binary())],
                                             schema=arrow_schema(out))

    # texts meet their node's name once: the join's partitioning serves to drop copies as well
    named = docs.select(f"`{text_col}`").mapInArrow(name, schema).join(wanted, "node", "left_semi")
    return session.settle(named.dropDuplicates(["node"]).mapInArrow(hashed, out), "sets")


def _lists(docs: DataFrame, text_col: str, sketch) -> DataFrame:
    """Entries of lists with more than one node, once each; ``many`` where a list has MANY entries or more."""
    by_token = Window.partitionBy("token")
    return session.settle(
        _entries(docs, text_col, sketch)
        .withColumn("_least", F.min("node").over(by_token)).withColumn("_most", F.max("node").over(by_token))
        .withColumn("many", F.count("*").over(by_token) >= MANY)
        .filter("_least < _most").drop("_least", "_most").distinct(), "lists")


def _grouped(docs: DataFrame, text_col: str, lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, sets, rest): (node, component) of nodes that verified links join, the sets of at least these, and the
    entries, with ``component``, of lists that may tell of more links.

    Every node of a long list is held against STARS nodes of the list, the first in as many orders of all nodes by
    how few of their shingles no long list has, as such lie amid a group. So a large group takes some pairs a
    node, not one for any two of its nodes. Long lists of one component only are done with; links between
    components, which these pairs miss, are left to the lists of ``rest``.
    """
    by_token = Window.partitionBy("token")
    n, k = F.shiftright("packed", 32), F.shiftright("packed", 28).bitwiseAND(F.lit(15))
    own = n - _least(n) + k - F.count("*").over(Window.partitionBy("node"))
    stars = F.array(*[F.min(F.struct("own", F.xxhash64(F.lit(i), "node").alias("_at"), "node")).over(by_token)["node"]
                      for i in range(STARS)])
    met = lists.filter("many").withColumn("own", own).withColumn("stars", stars) \
        .withColumn("star", F.explode(F.array_distinct("stars"))).filter("star != node") \
        .groupBy(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")) \
        .agg(F.count("*").alias("shared"), F.min(k).alias("k"))
    pairs = session.settle(met.filter("shared >= k").select("a", "b"), "star-pairs")
    sets = _sets(docs, text_col, pairs)
    groups = session.settle(components(_verified(pairs, sets)), "groups")
    entries = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = entries.filter("many").withColumn("_least", F.min("component").over(by_token)) \
        .withColumn("_most", F.max("component").over(by_token)).filter("_least < _most").drop("_least", "_most")
    return groups, sets, entries.filter("NOT many").union(mixed)


def _between(docs: DataFrame, text_col: str, rest: DataFrame) -> DataFrame:
    """(a, b), a < b, of nodes of unlike components that are similar enough, out of the lists where both are."""
    entries = _bounded(_unpacked(rest))
    entry = F.struct("node", "component", "n", "m", "k", "place", "live", "last")
    x, y = F.col("x"), F.col("y")

    # A set x of m shingles that may be shared, o of which have to be, lacks at most m - o of them
    # in its partner y: of its first m - o + k live tokens, y has at least k.
    def step(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")

    def overlap(n: Column, other: Column) -> Column:
        return F.ceil(PERCENT * (n + other) / (100 + PERCENT))

    n, m = F.col("n"), F.col("m")
    least, most = _least(n), F.least(_largest_partner(n, m), F.floor(100 * n / PERCENT))
    smallest = F.greatest(F.ceil(F.pow(F.lit(SIZE_STEP), F.col("size")) - 1e-6), least)  # of a class
    lower = entries.filter(most >= least).withColumn("size", F.explode(F.sequence(step(least), step(most)))) \
        .filter(F.col("live") < m - overlap(n, smallest) + F.col("k")).select("token", "size", entry.alias("x"))
    upper = entries.select("token", step(n).alias("size"), entry.alias("y"))
    matches = F.least(x["k"], y["k"])
    pairs = session.settle(
        lower.join(upper, ["token", "size"])
        .filter((x["component"] != y["component"]) & (x["last"] <= y["last"])
                & (x["live"] < x["m"] - overlap(x["n"], y["n"]) + matches) & _possible(x, y))
        .groupBy(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
        # prefixes that end at one place meet both ways round: a token must not count twice
        .agg(F.greatest(F.count(F.when(x["node"] < y["node"], 1)),
                        F.count(F.when(x["node"] > y["node"], 1))).alias("shared"), F.min(matches).alias("k"))
        .filter("shared >= k").select("a", "b"), "pairs")
    return session.settle(_verified(pairs, _sets(docs, text_col, pairs)), "links")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, groups, sets, links): the settled rows, the groups of ``_grouped`` with their sets, and the links
    between nodes that are not of one group."""
    nodes = _nodes(docs, id_col, text_col)
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(nodes))  # 4 << CELL_BITS bytes
    groups, sets, rest = _grouped(docs, text_col, _lists(docs, text_col, sketch))
    return nodes.filter("part IS NULL").drop("part", "cells"), groups, sets, _between(docs, text_col, rest)


def _similar(sets: list[np.ndarray], at: int) -> np.ndarray:
    """Which of the first ``at`` sets are similar enough to which of all: a matrix of bits.

    Shingles are laid out as columns, so many at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    row, column = row[kept], column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((at, len(sets)))
    for start in range(0, len(tokens), BLOCK_SHINGLES):
        lo, hi = np.searchsorted(column, [start, start + BLOCK_SHINGLES])
        if lo < hi:
            laid = np.zeros((len(sets), min(BLOCK_SHINGLES, len(tokens) - start)), np.float32)
            laid[row[lo:hi], column[lo:hi] - start] = 1
            shared += laid[:at] @ laid.T
    return (100 + PERCENT) * shared >= PERCENT * (sizes[:at, None] + sizes[None, :])


def _inside(groups: DataFrame, sets: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Links (a, b), a < b, of nodes of one group; with ``copies (node, copies)`` instead (node, near), one or more
    rows a node, that add up to the copies of all nodes of its group that it links with.

    Nodes of a group are dealt to blocks of about BLOCK_NODES. Two blocks at a time meet in one task, as
    the sides of a product, so that a task holds two blocks and no pair is a row unless asked for.
    """
    counted = copies is not None
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK_NODES)).alias("blocks"))
    rows = groups.join(blocks, "component").withColumn("block", block).join(sets, "node")
    rows = rows.join(copies, "node") if counted else rows.withColumn("copies", F.lit(1).cast("long"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("lo"), F.greatest(F.col("block"), o).alias("hi")))
    schema = as_schema([("node", "binary"), ("near", "long")] if counted else [("a", "binary"), ("b", "binary")])

    def meet(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        side = table["block"].to_numpy()
        table = table.take(pa.array(np.argsort(side, kind="stable")))
        at = int((side == lo).sum())
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["set"].combine_chunks()]
        like = _similar(sets, at) if at else np.zeros((0, len(sets)), bool)
        nodes = table["node"].combine_chunks().cast(pa.binary())
        like[np.arange(at), np.arange(at)] = False
        if lo < hi:
            like[:, :at] = False
        if counted:
            n = table["copies"].to_numpy()
            near = np.zeros(len(sets), np.int64)
            near[:at] += like @ n
            if lo < hi:
                near[at:] += n[:at] @ like[:, at:]
            return pa.Table.from_arrays([nodes, pa.array(near)], schema=arrow_schema(schema))
        p, q = np.nonzero(like if lo < hi else np.triu(like))
        a, b = nodes.take(pa.array(p)).to_pylist(), nodes.take(pa.array(q)).to_pylist()
        both = [(min(i, j), max(i, j)) for i, j in zip(a, b)]
        return pa.Table.from_arrays([pa.array([i for i, _ in both], pa.binary()),
                                     pa.array([j for _, j in both], pa.binary())], schema=arrow_schema(schema))

    return rows.withColumn("_o", F.explode(others)).select(
        "component", "_o.lo", "_o.hi", "block", "node", "set", "copies") \
        .groupBy("component", "lo", "hi").applyInArrow(meet, schema)


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                  ) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): settled (_id, key, node, n) rows, and (a, b), a < b, of nodes that are similar enough.

    A node stands for all rows of one word sequence, so the nodes are the membership and the links
    are those between distinct texts, all of them, within groups as well. What a document has for
    itself bounds what it can share, so documents of a list only meet where sizes and bounds allow
    a link, and are verified if they share the smaller of their two k. Nodes of a large group meet in blocks.

    Null and empty texts and texts without a word have no node and no link. Exact copies, repeated rows and rows
    with null or equal ids are rows of one node. Very long texts are one set each. Without rows there are no
    links. Further columns are not read, and an id column may have any name. Shingles are told apart by
    64-bit hashes.
    """
    nodes, groups, sets, links = _found(docs, id_col, text_col)
    return nodes, session.settle(links.union(_inside(groups, sets)), "links")


def _n_links(nodes: DataFrame, groups: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(_node, n_links): how many other rows a row of the node links with, exact copies included."""
    copies = session.settle(nodes.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies")), "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    apart = both.join(copies, F.col("b") == F.col("node")).select("a", F.col("copies").alias("near"))
    near = apart.union(_inside(groups, sets, copies)).groupBy("a").agg(F.sum("near").alias("near"))
    return copies.join(near, F.col("node") == F.col("a"), "left").select(
        F.col("node").alias("_node"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_links) of every document: how many other rows are exact copies or similar enough.

    Rows as in ``jaccard_groups``; texts without a word have no links.
    """
    return jaccard_groups(docs, id_col, text_col).select(F.col(f"`{id_col}`"), "n_links")


def _components(nodes: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component, first), one row per node: ``first`` is the row that stands for it, the one with the
    smallest id, null last, and among equal ids with the smallest key. A node of ``groups`` is with the
    first of its group."""
    links = links.union(groups.select(F.col("component").alias("a"), F.col("node").alias("b")))
    first = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "key")).alias("first")
    by_node = nodes.filter("node IS NOT NULL").groupBy("node").agg(first)
    return by_node.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document.

    The component is the smallest id that links reach; ``n_links`` counts the other rows that a row links with,
    exact copies included. Texts without a word, null texts included,
    have no shingles and are their own component. Exact copies share their component; repeated
    rows are kept, one row out per row in. Null ids are kept, but are never the smallest unless
    all of a group are null. Very long texts are one set. An empty table gives none. Shingles are compared by
    64-bit hashes. Further columns are not read.
    """
    nodes, groups, sets, links = _found(docs, id_col, text_col)
    named = _components(nodes, groups, links)
    least = session.settle(named.groupBy("component").agg(F.min("first")["_id"].alias("least")), "least")
    where = named.join(least, "component").select(F.col("node").alias("_node"), "least") \
        .join(_n_links(nodes, groups, sets, links), "_node")
    return nodes.join(where, F.col("node") == F.col("_node"), "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, with all columns: the one with the smallest id.

    Texts that do not link are never taken for each other, whatever their ids: of rows with one id and unlike
    texts each group keeps its own. A null id is the largest. Of rows alike in id and text one stays, the
    first by their other columns that have an order. Texts without a word, null ones too, are no group:
    one row stays for each of them and id. Very long texts are one set. An empty table stays empty.
    """
    nodes, groups, _, links = _found(docs, id_col, text_col)
    first = _components(nodes, groups, links).groupBy("component").agg(F.min("first").alias("first"))
    keep = first.select("first._id", "first.key").union(
        nodes.filter("node IS NULL").select("_id", "key").distinct()).select(
            F.col("_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    key = F.col("_text_key")
    kept = docs.withColumn("_text_key", F.xxhash64(F.col(f"`{text_col}`"))).join(
        keep, F.col(f"`{id_col}`").eqNullSafe(F.col("_kept_id")) & (key == F.col("_kept_key")), "left_semi")
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields
            if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    place = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), key).orderBy(*rest))
    return kept.withColumn("_copy", place).filter("_copy = 1").drop("_copy", "_text_key")
