"""A large group of near copies takes some pairs a text, not one for any two of its texts."""

import random

from test_documents import edited, frame
from tallyloom import session
from tallyloom.llm import jaccard_join


def test_pairs_grow_with_texts(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randint(0, 2)) for _ in range(400)]
    rows, settle = {}, session.settle

    def counted(df, name="rows"):
        out = settle(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(session, "settle", counted)
    assert jaccard_join.first_of_groups(frame(spark, texts)).count() == 1
    assert rows["pairs"] + rows.get("star-pairs", 0) < 10 * len(texts)
    assert rows["links"] < 10 * len(texts)


def test_blocks_of_a_group(spark, monkeypatch):
    """Links within a group are the same whatever the blocks."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    docs = frame(spark, [edited(rng, base, rng.randint(0, 4)) for _ in range(60)])
    nodes, links = jaccard_join.similar_links(docs)
    whole = sorted((r.a, r.b) for r in links.collect())
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 50)
    assert sorted((r.a, r.b) for r in jaccard_join.similar_links(docs)[1].collect()) == whole
    assert len(whole) > nodes.count()
