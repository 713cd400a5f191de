"""Importance resampling, periodic runs and line dedup against plain versions, on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import line_dedup, periodic_runs, registered, resampling

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "a", "a b c d e", "Wort " * 400, "é" * 3000, "x\ny\nx", "日本 語 " * 60, "ſ KK ÄÖ"]


def frame(spark, rows):
    """(doc_id, text) rows with further columns of clashing names."""
    return spark.createDataFrame(
        [(i, t, "a", 1, 2, None, 3) for i, t in rows],
        "doc_id long, text string, id string, key int, _id int, _key string, pos int")


# importance resampling -----------------------------------------------------------------------

def features_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def draws_by_hand(rows, goal, percent=5, min_words=20, buckets=10_000, seed=42):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(code(f) for _, t in rows for f in features_by_hand(t)[1])
    t = collections.Counter(code(f) for x in goal for f in features_by_hand(x)[1])
    big_s, big_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * big_t ** 0 * big_s / ((s[b] + 1.0) * big_t)))
    out = []
    for i, text in rows:
        n, f = features_by_hand(text)
        weight = sum(gain(code(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, score, None])
    asked = sorted((r for r in out if r[1] >= min_words),
                   key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for rank, r in enumerate(asked[:percent * len(asked) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["river", "Tax", "grün", "x1", "日本", "data,", "to-do", "A"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 25, 60]))) for _ in range(n)]
    rows = list(enumerate(texts + ODD))
    return rows + [(None, texts[0]), (None, "river " * 30), (7, "Tax " * 30), (7, "Tax " * 30), (3, None)]


@pytest.mark.parametrize("percent, min_words", [(5, 20), (50, 1), (100, 0), (0, 20)])
def test_draws(spark, percent, min_words):
    rows, goal = corpus(percent), ["river tax data", None, "", "Grün grün 日本 x1 x1"]
    target = spark.createDataFrame([(g,) for g in goal], "text string")
    got = resampling.resample(frame(spark, rows), target, percent=percent, min_words=min_words)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=str) == draws_by_hand(rows, goal, percent, min_words)


def test_draws_with_few_or_many_buckets(spark):
    rows, target = corpus(1, 40), spark.createDataFrame([("river river",)], "text string")
    for buckets in (7, 100_000):
        got = resampling.resample(frame(spark, rows), target, percent=20, buckets=buckets, seed=3).collect()
        assert sorted(map(tuple, got), key=str) == draws_by_hand(rows, ["river river"], 20, 20, buckets, 3)


def test_drawn_rows_come_whole(spark):
    rows = corpus(2)
    target = spark.createDataFrame([("Tax",)], "text string")
    ranks = resampling.resample(frame(spark, rows), target, percent=30).filter("rank IS NOT NULL")
    docs = resampling.drawn(frame(spark, rows), target, percent=30)
    assert docs.columns == frame(spark, rows).columns
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in ranks.collect()}
    assert {(r.doc_id, r.text) for r in docs.collect()} <= set(rows)


def test_draws_of_nothing(spark):
    docs = frame(spark, corpus(3, 10))
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), empty).count() == 0
    assert resampling.resample(docs, empty).count() == docs.count()
    with pytest.raises(ValueError):
        resampling.resample(docs.withColumnRenamed("doc_id", "score"), empty, id_col="score")


def test_scan_takes_every_run_of_words():
    n, codes = resampling.scanner(10_000)("A-b,, C  d\té")
    assert n == 5
    want = ["a", "b", "c", "d", "é", "a b", "b c", "c d", "d é", "a b c", "b c d", "c d é"]
    assert codes.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in want]


# periodic runs -------------------------------------------------------------------------------

def runs_by_hand(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_words(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        alphabet = rng.choice([1, 2, 2, 3, 50])
        q = rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 40, 64, 70, 101])
        unit = [rng.randrange(alphabet) for _ in range(q)]
        if rng.random() < .5:
            unit = [0] * (q - 1) + [1]
        out += [unit[i % q] for i in range(rng.randint(1, int(q * rng.choice([1, 3, 3.2, 4, 8]) + 1)))]
        out += [rng.randrange(alphabet) for _ in range(rng.randint(0, 5))]
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_all_stretches(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = [periodic_words(rng) for _ in range(4)] + [fibonacci(rng.randint(30, 300))]
        base, codes = 0, []
        for t in texts:
            codes.append(np.array(t, np.int64) + base)
            base += max(t) + 1
        found = [[] for _ in texts]
        for i, *run in zip(*(a.tolist() for a in periodic_runs.runs_of(codes))):
            found[i].append(tuple(run))
        assert found == [runs_by_hand(t) for t in texts]


def test_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periodic_runs.WaveletMatrix(values)
    lo = rng.integers(0, 300, 2000)
    hi = np.minimum(lo + rng.integers(0, 40, 2000), 300)
    x = rng.integers(0, 305, 2000)
    want = [min((v for v in values[a:b] if v >= k), default=300) for a, b, k in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_runs_of_documents(spark, monkeypatch):
    rng = random.Random(9)
    texts = ODD + ["\t".join(map(str, periodic_words(rng))) for _ in range(30)] + ["a b c " * 9 + "d"] * 3
    rows = list(enumerate(texts)) + [(None, "x " * 30), (3, "x " * 30)]
    whole = periodic_runs.find_runs(frame(spark, rows)).collect()
    assert [r.doc_id for r in whole] == [i for i, _ in rows]
    for r, (_, text) in zip(whole, rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_by_hand(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)  # texts indexed one by one
    texts = [periodic_runs.words_of(t or "") for _, t in rows]
    for at, codes in periodic_runs._batches(texts):
        for i, *run in zip(*(a.tolist() for a in periodic_runs.runs_of(codes))):
            assert tuple(run) in [tuple(x) for x in whole[at[i]].runs]


def test_runs_of_nothing(spark):
    assert periodic_runs.find_runs(frame(spark, [(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(frame(spark, [(1, "a")]).withColumnRenamed("doc_id", "runs"), "runs")


def test_some_documents_are_made_periodic(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(60 + i))) for i in range(200)] + [(None, "a b"), (1000, None)]
    for r, (i, text) in zip(registered.repeated(frame(spark, rows)).collect(), rows):
        want = text
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and text:
            w, g = text.split(), h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            want = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))
        assert (r.doc_id, r.text) == (i, want)


# line dedup ----------------------------------------------------------------------------------

def kept_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    by = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            by[key(line)].add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in by.items()
           if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def lines_frame(seed, n, hot=0.3):
    rng = random.Random(seed)
    pool = [f"Line {k} of the shared pool{' ' * (k % 3)}" for k in range(12)] + ["short", "", "\t", "é" * 19, "É" * 20]
    one = " THE very common line that all know \r"
    rows = []
    for i in range(n):
        lines = [one if rng.random() < hot else rng.choice(pool) for _ in range(rng.randint(0, 8))]
        if rng.random() < .3:
            lines.append(f"only document {i} holds this line")
        rows.append((i, "\n".join(lines)))
    return rows + list(enumerate(ODD, n)) + [(None, one + "\nshort"), (None, one), (2, one), (2, one), (n + 50, one.lower())]


@pytest.mark.parametrize("seed, batch, parts", [(0, 10_000, 8), (1, 3, 8), (2, 1, 40), (3, 7, 200), (4, 2, 1)])
def test_lines(spark, seed, batch, parts):
    """Small batches and many ranges: a hash goes on over batches and tasks."""
    rows = lines_frame(seed, 120, [0.3, 0.9, 0.6, 1.0, 0.5][seed])
    was = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        docs = frame(spark, rows)
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == kept_by_hand(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_lines_with_other_limits_and_text_ids(spark):
    rows = [(None if i is None else f"d{i:04}", t) for i, t in lines_frame(5, 80)]
    docs = spark.createDataFrame(rows, "name string, body string")
    for chars, at_least in ((1, 2), (0, 5), (20, 1)):
        bitmaps = line_dedup.keep_bitmaps(docs, "name", "body", chars, at_least)
        got = line_dedup.apply_bitmaps(docs, bitmaps, "name", "body").collect()
        key = lambda i: (i is not None, i or "")
        assert sorted((tuple(r) for r in got), key=str) == kept_by_hand_of(rows, chars, at_least, key)


def kept_by_hand_of(rows, chars, at_least, order):
    number = {i: k for k, i in enumerate(sorted({i for i, _ in rows if i is not None}, key=order))}
    back = {k: i for i, k in number.items()}
    out = kept_by_hand([(number.get(i), t) for i, t in rows], chars, at_least)
    return sorted(((back.get(i), *rest) for i, *rest in out), key=str)


def test_bitmaps(spark):
    rows = [(1, "this line is long enough to count\nb"), (2, "This line is long enough to count"),
            (3, "x\n this line is long enough to count\n")]
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert {i: line_dedup.unpacked(bytes(r.keep), r.n_lines).tolist() for i, r in got.items()} == {
        1: [False, True], 2: [False], 3: [True, True, True]}
    assert [got[i].n_dropped for i in (1, 2, 3)] == [1, 1, 0]
    kept = line_dedup.apply_bitmaps(frame(spark, rows), line_dedup.keep_bitmaps(frame(spark, rows)))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "b", 2: "", 3: rows[2][1]}


def test_lines_of_nothing(spark):
    docs = frame(spark, [(1, "a")])
    assert line_dedup.keep_bitmaps(docs.limit(0)).count() == 0
    assert line_dedup.apply_bitmaps(docs.limit(0), line_dedup.keep_bitmaps(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(docs.withColumnRenamed("doc_id", "keep"), "keep")
