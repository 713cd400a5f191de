"""Terms, TF-IDF, nearest neighbours, search, prompts and answers against brute force."""

import random
import re
import unicodedata
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tallyloom.functions import text as tx, vectors as vec
from tallyloom.operators import knn as nn, rag, retrieval, tfidf, vector_store
from tallyloom.plans import answers
from tallyloom.sources import commits, versions
from tallyloom.streaming.ingest import add_documents_stream


def plain(s):
    s = unicodedata.normalize("NFKD", s.lower())
    return "".join(c for c in s if not unicodedata.combining(c))


def grams(s):
    w = re.findall(r"\w+", plain(s))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


class Brute:
    """The same vectors by plain loops."""

    def __init__(self, texts, limit=1000):
        bags = [Counter(grams(t)) for t in texts]
        total = sum(bags, Counter())
        self.vocab = sorted(sorted(total, key=lambda t: (-total[t], t))[:limit])
        n = len(texts)
        self.idf = {t: np.log((1 + n) / (1 + sum(t in b for b in bags))) + 1 for t in self.vocab}
        self.total = total
        self.matrix = np.array([self.embed(t) for t in texts])

    def embed(self, text):
        bag = Counter(grams(text))
        v = np.array([bag[t] * self.idf[t] for t in self.vocab])
        norm = np.linalg.norm(v)
        return v / norm if norm else v


WORDS = "alpha beta gamma delta été Ñandú stock_1 42 x über naïve supply chain".split()


def random_texts(n, seed=2, most=25):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) + rnd.choice(["", ",", ".", "\n", " -"])
                     for _ in range(rnd.randrange(0, most))) for _ in range(n)]


TEXTS = random_texts(40) + ["", "solo", "Ünïque wörds nobody_else Úses", "a b", "!!! ???"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", {"n": str(i)}) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows, "ord bigint, content string, source string, metadata map<string,string>")


def test_words(spark):
    samples = ["Crème Brûlée, déjà-vu!", "snake_case 3x", "", "ÀÉÎÕÜ ångström", "Ελλάδα Ёлка"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tx.words(F.col("s"))).collect()]
    assert got == [re.findall(r"\w+", plain(s)) for s in samples]


def test_every_one_character_plain_form(spark):
    """All long-known letters of two planes whose plain form is one character."""
    known = unicodedata.ucd_3_2_0  # the JVM's tables lag behind for the newest letters
    letters = [chr(c) for c in range(0x80, 0x20000)
               if known.category(chr(c)) in ("Ll", "Lu", "Lo", "Nd", "No")
               and plain(chr(c)) != chr(c) and len(plain(chr(c))) == 1]
    assert len(letters) > 2000
    df = spark.createDataFrame([(c,) for c in letters], "s string")
    got = [r[0] for r in df.select(tx.words(F.col("s"))).collect()]
    wrong = [c for c, g in zip(letters, got) if g != re.findall(r"\w+", plain(c))]
    assert wrong == []


def test_exact_accents_expand_ligatures(spark):
    df = spark.createDataFrame([("ﬁne ½ Ǆ plain",)], "s string")
    assert df.select(tx.strip_accents(F.col("s"), exact=True)).first()[0] == tx._plain("ﬁne ½ Ǆ plain")


@pytest.mark.parametrize("limit", [1, 3, 7, 13, 40, 1000])
def test_top_terms_with_ties(spark, docs, limit):
    b = Brute(TEXTS, limit)
    got = {r["term"]: r["corpus_count"] for r in
           tfidf.top_terms(docs, max_features=limit).collect()}
    assert got == {t: b.total[t] for t in b.vocab}


def test_pair_may_win_a_tie_against_its_second_word(spark):
    """'a z' and 'z' are equally frequent; the pair sorts first and must be kept."""
    texts = ["a z a", "a a"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    for limit in (1, 2, 3, 4):
        b = Brute(texts, limit)
        got = sorted(r["term"] for r in tfidf.top_terms(df, max_features=limit).collect())
        assert got == b.vocab


def dense(row, dim):
    out = np.zeros(dim)
    out[row["term_ids"]] = row["weights"]
    return out


@pytest.mark.parametrize("limit", [10, 1000])
def test_fit_and_transform(spark, docs, limit):
    b = Brute(TEXTS, limit)
    vocab, vectors = tfidf.fit_transform(docs, max_features=limit)
    rows = {r["term"]: r for r in vocab.collect()}
    assert [rows[t]["term_id"] for t in b.vocab] == list(range(len(b.vocab)))
    for t in b.vocab:
        assert rows[t]["idf"] == pytest.approx(b.idf[t])
    got = {r["ord"]: dense(r, len(b.vocab)) for r in vectors.collect()}
    assert len(got) == len(TEXTS)
    for i in range(len(TEXTS)):
        np.testing.assert_allclose(got[i], b.matrix[i], atol=1e-12)
    new = spark.createDataFrame([(1, "beta gamma unseen"), (2, "unseen"), (3, None)],
                                "ord bigint, content string")
    out = {r["ord"]: dense(r, len(b.vocab)) for r in
           tfidf.transform(new, vocab).collect()}
    np.testing.assert_allclose(out[1], b.embed("beta gamma unseen"), atol=1e-12)
    assert not out[2].any() and not out[3].any()


def brute_top(queries, vectors, k, metric):
    q, v = np.asarray(queries, float), np.asarray(vectors, float)
    if metric == "cosine":
        def unit(m):
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(n == 0, 1, n)
        s = np.round(unit(q) @ unit(v).T, 6)
        order = [sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(q))]
    else:
        s = np.round(((q[:, None, :] - v[None, :, :]) ** 2).sum(2), 6)
        order = [sorted(range(len(v)), key=lambda j: (s[i, j], j))[:k] for i in range(len(q))]
    return {(i, rank + 1): (j, s[i, j]) for i, js in enumerate(order) for rank, j in enumerate(js)}


@pytest.fixture(scope="module")
def vector_set():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:90] = v[7]      # many exact ties
    v[120] = 0.0         # no length
    q = np.vstack([rng.normal(size=(9, 8)), np.zeros((1, 8)), v[7:8]]).astype(np.float32)
    return q, v


def vector_frames(spark, q, v):
    vs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)],
                               "ord bigint, embedding array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)],
                               "query_id bigint, embedding array<float>")
    return qs, vs.repartition(7)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [1, 5, 45, 1000])
@pytest.mark.parametrize("blocks", [{}, {"query_block": 4}])
def test_knn(spark, vector_set, metric, k, blocks, monkeypatch):
    if blocks:  # three blocks of queries, and vectors in several parts
        monkeypatch.setattr(nn, "_HELD_BYTES", 500)
    q, v = vector_set
    qs, vs = vector_frames(spark, q, v)
    rows = nn.knn(qs, vs, k, metric, **blocks).collect()
    want = brute_top(q, v, k, metric)
    assert len(rows) == len(want) == len(q) * min(k, len(v))
    for r in rows:
        ord_, score = want[(r["query_id"], r["rank"])]
        assert r["ord"] == ord_ and r["score"] == pytest.approx(score, abs=2e-6)


def test_knn_small_slices(spark, vector_set, monkeypatch):
    monkeypatch.setattr(nn, "_CELLS", 100)
    q, v = vector_set
    import pyarrow as pa
    rows = pa.array([list(map(float, r)) for r in q])
    top = nn._TopK(nn._Queries(np.arange(len(q)), [rows], "cosine", 8), 6)
    batch = pa.record_batch({"ord": np.arange(len(v)), "embedding": [list(map(float, r)) for r in v]})
    top.add_batch(batch, ["embedding"])
    want = brute_top(q, v, 6, "cosine")
    assert list(top.o) == [want[(i, r + 1)][0] for i in range(len(q)) for r in range(6)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_sparse_knn_in_a_wide_space(spark, metric):
    """Term ids far beyond what a dense matrix could hold."""
    rng = np.random.default_rng(4)
    wide = [{int(t): float(rng.integers(1, 9)) for t in rng.choice(40, 4, replace=False)} for _ in range(60)]
    def rows(key, some):
        return spark.createDataFrame(
            [(i, [t * 50_000_000 for t in sorted(d)], [d[t] for t in sorted(d)]) for i, d in enumerate(some)],
            f"{key} bigint, term_ids array<int>, weights array<double>")
    q, v = wide[:7] + [{}], wide[5:]
    dense_rows = [[[d.get(t, 0.0) for t in range(40)] for d in some] for some in (q, v)]
    got = nn.knn(rows("query_id", q), rows("ord", v).repartition(3), 6, metric, sparse=True, query_block=3)
    assert {(r["query_id"], r["rank"]): (r["ord"], pytest.approx(r["score"], abs=2e-6)) for r in got.collect()} \
        == brute_top(*dense_rows, 6, metric)


def test_query_without_an_id_is_left_out(spark, vector_set):
    q, v = vector_set
    qs, vs = vector_frames(spark, q, v)
    odd = qs.limit(1).withColumn("query_id", F.lit(None).cast("bigint"))
    assert {r["query_id"] for r in nn.knn(qs.limit(2).union(odd), vs, 3).collect()} == {0, 1}


def test_knn_limits(spark, vector_set):
    q, v = vector_set
    qs, vs = vector_frames(spark, q, v)
    assert nn.knn(qs, vs, 0).count() == len(q)          # k below 1 is 1
    assert nn.knn(qs, vs.limit(0), 3).count() == 0
    assert nn.knn(qs.limit(0), vs, 3).count() == 0
    with pytest.raises(ValueError):
        nn.knn(qs, vs, 3, "dot")
    short = vs.withColumn("embedding", F.slice("embedding", 1, 5))
    with pytest.raises(PythonException, match="dimension mismatch"):
        nn.knn(qs, short, 3).collect()


def test_similarity_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]),
                                ([1.0, 1.0], [-1.0, -1.0])], "a array<float>, b array<float>")
    got = [r["similarity"] for r in vector_store.pairwise_similarity(df, "a", "b").collect()]
    assert got == [1.0, 0.0, pytest.approx(-1.0)] and min(got) >= -1.0
    assert df.select(vec.dot(F.col("a"), F.col("b"))).first()[0] == 2.0


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([("b", [3.0, 4.0], {"m": "1"}), ("a", [0.0, 0.0], None)],
                                 "name string, embedding array<float>, metadata map<string,string>")
    store = vector_store.create(rows, ["name"])
    assert [(r.ord, r.id) for r in store.orderBy("ord").collect()] == [(0, "vec_0"), (1, "vec_1")]
    more = vector_store.add(store, rows.withColumn("id", F.lit("vec_0")), ["name"])
    got = more.orderBy("ord").collect()
    assert [(r.ord, r.id) for r in got] == [(0, "vec_0"), (1, "vec_1"), (2, "vec_0"), (3, "vec_0")]
    assert got[0].metadata == {} and got[1].metadata == {"m": "1"}
    unit = {r.ord: r.embedding for r in vector_store.prepare(store, 2).collect()}
    assert unit[0] == [0.0, 0.0] and unit[1] == [pytest.approx(0.6), pytest.approx(0.8)]
    with pytest.raises(Exception, match="dimension mismatch"):
        vector_store.prepare(store, 3).collect()
    path = str(tmp_path / "ix")
    vector_store.save(store, path, 2, "l2")
    back, dim, metric = vector_store.load(spark, path)
    assert (back.count(), dim, metric) == (2, 2, "l2")
    # what was loaded may be extended and saved in the same place
    vector_store.save(vector_store.add(back, rows, ["name"]), path, 2, "l2")
    assert vector_store.load(spark, path)[0].count() == 4
    versions.change(spark, path, lambda draft: draft.add("vectors", store))
    with pytest.raises(ValueError, match="holds 6 vectors"):
        vector_store.load(spark, path)
    assert vector_store.clear(store).count() == 0
    writes = spark.createDataFrame([("d", [1.0], 1), ("d", [2.0], 2), ("e", [3.0], 1)],
                                   "doc_id string, embedding array<float>, written int")
    latest = {r.doc_id: r.embedding for r in vector_store.upsert_latest(writes).collect()}
    assert latest == {"d": [2.0], "e": [3.0]}


def test_equal_writes_have_one_winner(spark):
    rows = [("d", [1.0], {"a": "1"}, 5), ("d", [2.0], {"a": "0"}, 5), ("d", [2.0], {"a": "2"}, 5), ("d", [9.0], None, 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id string, embedding array<float>, m map<string,string>, written int")
        assert [(r.embedding, r.m) for r in vector_store.upsert_latest(df).collect()] == [([2.0], {"a": "2"})]


def test_folder_that_tasks_cannot_read_is_named(spark, monkeypatch):
    monkeypatch.setattr(nn, "scratch_path", lambda *_: "wasbs://box@store/x")
    one = spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        nn.knn(one, one.withColumnRenamed("query_id", "ord"))


@pytest.fixture(scope="module")
def index(docs):
    return retrieval.build_index(docs)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "alpha été 42"), (2, "no such word"), (3, "supply chain")],
                                 "query_id bigint, query string")


def test_search_pads_with_zero_scores(index, questions):
    b = Brute(TEXTS)
    out = {(r["query_id"], r["rank"]): r for r in retrieval.search(index, questions, 100).collect()}
    assert len(out) == 3 * len(TEXTS)
    q = {1: "alpha été 42", 2: "no such word", 3: "supply chain"}
    for i, text in q.items():
        s = np.round(b.matrix @ b.embed(text), 6)
        order = sorted(range(len(TEXTS)), key=lambda j: (-s[j], j))
        for rank, j in enumerate(order, 1):
            r = out[(i, rank)]
            assert (r["id"], r["content"], r["metadata"]) == (f"doc_{j}", TEXTS[j], {"n": str(j)})
            assert r["score"] == pytest.approx(s[j], abs=2e-6)


def test_missing_documents_are_dropped_and_ranks_stay(index, questions):
    m = retrieval.match(index, questions, 5)
    best = m.filter("query_id = 1 and rank = 2").first()["ord"]
    left = retrieval.attach_documents(m, index.documents.filter(F.col("ord") != best))
    assert sorted(r["rank"] for r in left.filter("query_id = 1").collect()) == [1, 3, 4, 5]


def test_index_save_load_and_add(spark, index, questions, tmp_path):
    retrieval.save(index, str(tmp_path))
    again = retrieval.load(spark, str(tmp_path))
    extra = spark.createDataFrame([("z", "42 42 42 42", "new"), ("y", "nothing known", "new")],
                                  "name string, content string, source string")
    more = retrieval.add_documents(again, extra, ["name"])
    ids = [r["id"] for r in more.documents.orderBy("ord").collect()][-2:]
    assert ids == [f"doc_{len(TEXTS)}", f"doc_{len(TEXTS) + 1}"]
    q = spark.createDataFrame([(9, "42 42 42 42")], "query_id bigint, query string")
    assert retrieval.search(more, q, 1).first()["content"] == "42 42 42 42"
    assert more.vectors.count() == len(TEXTS) + 2
    retrieval.save(more, str(tmp_path))
    saved = retrieval.load(spark, str(tmp_path))
    assert sorted(r["id"] for r in saved.documents.collect()) == sorted(
        f"doc_{i}" for i in range(len(TEXTS) + 2))
    # a save that fails leaves what was there
    broken = retrieval.Index(saved.documents, saved.vectors.withColumn(
        "weights", F.raise_error(F.lit("lost")).cast("array<double>")), saved.vocabulary)
    with pytest.raises(Exception, match="lost"):
        retrieval.save(broken, str(tmp_path))
    assert retrieval.search(retrieval.load(spark, str(tmp_path)), q, 1).first()["content"] == "42 42 42 42"


def test_nothing_saved_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        retrieval.load(spark, str(tmp_path))


def test_empty_index_is_an_error(docs):
    with pytest.raises(ValueError):
        retrieval.build_index(docs.limit(0))


def test_prompt_and_answer(index, questions):
    rows = {r["query_id"]: r for r in rag.answer(index, questions, 2, 400).collect()}
    found = {r["query_id"]: [] for r in questions.collect()}
    for r in retrieval.search(index, questions, 2).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r)
    for i, r in rows.items():
        context = "\n---\n".join(f"Source: {d['source']}\n{d['content']}" for d in found[i])
        prompt = (f"{rag.PROMPT_HEAD}\n\nCONTEXT:\n{context}\n\nQUESTION: {r['query']}\n\nANSWER:")
        assert r["prompt"] == prompt
        assert r["answer"] == rag.ECHO_HEAD + prompt[:400]
        assert r["num_retrieved"] == 2
        assert [d["id"] for d in r["retrieved_documents"]] == [d["id"] for d in found[i]]


def test_query_without_documents_has_empty_context(spark, index, questions):
    none = retrieval.search(index, questions, 1).limit(0)
    r = rag.build_prompts(none, questions).filter("query_id = 1").first()
    assert r["num_retrieved"] == 0 and "CONTEXT:\n\n\nQUESTION: alpha" in r["prompt"]


def test_ask_job_uses_each_request(spark, index):
    asked = spark.createDataFrame(
        [(1, "beta", 3, 60), (2, "gamma", None, None), (3, "", 3, 60), (4, "x", 21, 60)],
        "query_id bigint, query string, num_retrieval int, max_tokens int")
    out = {r["query_id"]: r for r in answers.ask_job(index, asked).collect()}
    assert set(out) == {1, 2}
    assert out[1]["num_retrieved"] == 3 and len(out[1]["answer"]) == len(rag.ECHO_HEAD) + 60
    assert out[2]["num_retrieved"] == 5 and len(out[2]["answer"]) <= len(rag.ECHO_HEAD) + 256


def test_generator_errors_stay_with_their_prompt(index, questions):
    def make_client():
        def call(prompt, max_tokens, temperature):
            if "no such word" in prompt.split("QUESTION:")[1]:
                raise RuntimeError("refused")
            return f"{max_tokens}/{temperature}"
        return call

    out = {r["query_id"]: (r["answer"], r["error"]) for r in
           answers.answers_with(index, questions, make_client, 1, 64, 0.2).collect()}
    assert out == {1: ("64/0.2", None), 2: (None, "RuntimeError: refused"), 3: ("64/0.2", None)}


def test_encoder_plug_in_feeds_knn(spark, docs):
    def make_encoder():
        return lambda texts: [[len(t), 1.0] for t in texts]

    vectors = rag.embed(docs, make_encoder)
    q = spark.createDataFrame([(1, "x" * 10)], "ord bigint, content string")
    qv = rag.embed(q, make_encoder).withColumnRenamed("ord", "query_id")
    best = nn.knn(qv, vectors, 1, "l2").first()
    lengths = [abs(len(t) - 10) for t in TEXTS]
    assert best["ord"] == lengths.index(min(lengths))


def test_stream_adds_new_files_once(spark, index, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "ix", "progress"))
    docs = index.documents.drop("id").withColumnRenamed("ord", "place")
    docs.filter("place < 10").coalesce(1).write.parquet(source)
    retrieval.save(index, target)
    n = len(TEXTS)

    def run():
        add_documents_stream(spark, source, docs.drop("ord").schema, target, progress, ["place"]
                             ).awaitTermination()
        return retrieval.load(spark, target)

    assert run().vectors.count() == n + 10
    assert run().documents.count() == n + 10
    docs.filter("place >= 10").coalesce(1).write.mode("append").parquet(source)
    after = run()
    terms = {r["ord"]: r["term_ids"] for r in index.vectors.collect()}
    got = {r["ord"]: r["term_ids"] for r in after.vectors.collect()}
    assert got == {**terms, **{n + i: terms[i] for i in range(n)}}
    assert sorted(r["id"] for r in after.documents.collect()) == sorted(f"doc_{i}" for i in range(2 * n))


# what several writers do to a saved set --------------------------------------------------------

def rows_of(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.format_string("n%03d", "id").alias("id"), F.array(F.col("id").cast("float")).alias("embedding"))


def test_two_savers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "ix")
    vector_store.save(vector_store.create(rows_of(spark, 0, 5), ["id"]), path, 1, "l2")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(
            lambda i: vector_store.append(spark, path, rows_of(spark, 10 * i, 10 * i + 3), ["id"]), range(1, 5)))
    assert sorted(numbers) == [2, 3, 4, 5]
    store, _, _ = vector_store.load(spark, path)
    got = store.orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(17))
    assert sorted(r["id"] for r in got) == sorted(
        f"n{i:03}" for i in [*range(5), *(10 * k + j for k in range(1, 5) for j in range(3))])


def test_a_writer_overtaken_starts_again(spark, tmp_path):
    path, tries = str(tmp_path / "s"), []
    versions.save(spark, path, {"t": spark.range(2)})

    def make(draft):
        tries.append(draft.read("t").count())
        if len(tries) < 3:  # another one is faster, twice
            versions.change(spark, path, lambda d: d.add("t", spark.range(1)))
        draft.add("t", draft.read("t").agg(F.count("*").alias("id")))

    assert versions.change(spark, path, make) == 4
    assert tries == [2, 3, 4]
    assert sorted(r["id"] for r in versions.load(spark, path, "t")[0].collect()) == [0, 0, 0, 1, 4]
    assert len(commits.names(spark, f"{path}/data")) == 4  # the parts of the lost tries are gone


def test_a_number_is_given_out_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: commits.append(spark, folder, 7, {"by": i}), range(16)))
    assert won.count(True) == 1
    assert commits.last(spark, folder) == (7, {"by": won.index(True)})
    assert commits.names(spark, str(tmp_path / "none")) == []
    assert [n for n, _ in commits.names(spark, folder) if n.endswith(".tmp")] == []


def test_what_is_no_record_is_an_error(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / f"{1:020d}.json").write_text("{")
    with pytest.raises(ValueError):
        versions.save(spark, str(tmp_path), {"t": spark.range(1)})


def test_a_reader_sees_documents_with_their_vectors_only(spark, index, tmp_path, monkeypatch):
    path, seen = str(tmp_path), []
    retrieval.save(index, path)
    n = index.documents.count()
    transform = tfidf.transform

    def between(*args):  # the documents are written, the vectors are not
        now = retrieval.load(spark, path)
        seen.append((now.documents.count(), now.vectors.count()))
        return transform(*args)

    monkeypatch.setattr(retrieval.tfidf, "transform", between)
    docs = index.documents.drop("id").withColumnRenamed("ord", "place")
    assert retrieval.append(spark, path, docs, ["place"], ("s", 0)) == 2
    assert seen == [(n, n)]
    now = retrieval.load(spark, path)
    assert (now.documents.count(), now.vectors.count()) == (2 * n, 2 * n)
    # the same batch again, after a failure elsewhere
    assert retrieval.append(spark, path, docs, ["place"], ("s", 0)) == 2
    assert retrieval.load(spark, path).documents.count() == 2 * n


def test_compaction_and_vacuum(spark, index, tmp_path):
    path = str(tmp_path)
    retrieval.save(index, path)
    docs = index.documents.drop("id").withColumnRenamed("ord", "place")
    for i in range(3):
        retrieval.append(spark, path, docs.filter(F.col("place") % 3 == i), ["place"], ("s", i))
    old = retrieval.load(spark, path)
    before = [sorted(map(str, t.collect())) for t in (old.documents, old.vectors)]
    assert len(versions.state(spark, path)[1]["tables"]["documents"]) == 4
    retrieval.compact(spark, path)
    assert versions.vacuum(spark, path, 3600) == []  # a reader may still be at the old parts
    assert [sorted(map(str, t.collect())) for t in (old.documents, old.vectors)] == before
    now = retrieval.load(spark, path)
    assert [sorted(map(str, t.collect())) for t in (now.documents, now.vectors)] == before
    record = versions.state(spark, path)[1]
    assert {k: len(v) for k, v in record["tables"].items()} == {"documents": 1, "vectors": 1, "vocabulary": 1}
    assert record["seen"] == {"s": 2}
    assert len(versions.vacuum(spark, path, 0)) == 8
    assert len(commits.numbers(spark, f"{path}/log")) == 1
    now = retrieval.load(spark, path)
    assert [sorted(map(str, t.collect())) for t in (now.documents, now.vectors)] == before
    assert retrieval.append(spark, path, docs, ["place"], ("s", 2)) == 5  # in already


def test_only_candidates_are_scored_in_doubles(monkeypatch):
    """The k best of sparse rows, copies and near ties among them, without the whole product in doubles."""
    rng = np.random.default_rng(1)

    def sparse(n, terms):
        ids = [np.sort(rng.choice(300, terms, replace=False)) for _ in range(n)]
        return ids, [rng.random(terms) for _ in range(n)]

    (qi, qw), (vi, vw) = sparse(40, 12), sparse(3_000, 60)
    for i in range(2_000, 2_030):  # copies of one row, and rows that are off by less than a score shows
        vi[i], vw[i] = vi[7], vw[7] + (i % 2) * 1e-9
    place = rng.permutation(3_000)

    def full(ids, weights):
        m = np.zeros((len(ids), 300))
        for r, (i, w) in enumerate(zip(ids, weights)):
            m[r, i] = w
        return m / np.sqrt((m**2).sum(1))[:, None]

    want = np.round(full(qi, qw) @ full(vi, vw).T, 6)

    scores = nn._Queries.scores

    def some(self, vectors, squares=None, which=()):
        assert 0 < len(which) < 4, "all pairs were scored in doubles"
        return scores(self, vectors, squares, which)

    monkeypatch.setattr(nn._Queries, "scores", some)
    columns = [pa.array(qi, pa.list_(pa.int32())), pa.array(qw, pa.list_(pa.float64()))]
    for k in (1, 5, 40):
        top = nn._TopK(nn._Queries(np.arange(40), columns, "cosine", None), k)
        for i in range(0, 3_000, 1_000):
            names = ["ord", "term_ids", "weights"]
            top.add_batch(pa.RecordBatch.from_arrays([
                pa.array(place[i:i + 1_000]), pa.array(vi[i:i + 1_000], pa.list_(pa.int32())),
                pa.array(vw[i:i + 1_000], pa.list_(pa.float64()))], names), names[1:])
        for q in range(40):
            order = np.lexsort((place, -want[q]))[:k]
            assert top.o[top.q == q].tolist() == place[order].tolist()
            assert np.allclose(top.s[top.q == q], want[q][order], atol=1e-9)
