"""The near-copy stage against all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import near_copies


def groups(rows, similarity):
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or len(x & y) >= similarity * len(x | y) > 0:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i for i in sets if find(i) != i}


def edited(rng, words, share):
    words = list(words)
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("copies", "dense"), [(3, 12), (60, 12), (60, 4)])
def test_near_copies(documents, monkeypatch, copies, dense):
    """Near copies go, also out of crowded buckets; documents that resemble none stay."""
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rng = random.Random(copies)
    rows, k = [], 0
    for family in range(6 if copies < 10 else 2):
        base = [f"f{family}w{rng.randrange(4000)}" for _ in range(250)]
        for _ in range(copies):
            rows.append((k, edited(rng, base, 0.01)))
            k += 1
    rows += [(k + i, " ".join(f"s{rng.randrange(3000)}" for _ in range(200))) for i in range(80)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, ""), (1003, None), (1004, " \n"), (None, rows[0][1])]
    got = {r["doc_id"] for r in near_copies.removed(documents(rows)).collect()}
    must, may = groups(rows, 0.8), groups(rows, 0.55)
    assert len(must - got) <= 0.02 * len(must) and got <= may and {1000, 1001, 1003, 1004} <= got
    kept = [r["doc_id"] for r in near_copies.keep_first(documents(rows)).collect()]
    assert None in kept and set(kept) == {i for i, _ in rows} - got


def test_votes_and_shingles():
    text = "A b c d e f"
    assert len(near_copies.shingles(text)) == 2 and len(near_copies.shingles("a b")) == 1 and len(near_copies.shingles(None)) == 0
    assert near_copies.shingles(text).tolist() == near_copies.shingles("a\tB c  d e f").tolist()
    many = np.arange(1, 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.allclose(near_copies.votes(many), near_copies.votes(many[:50_000]) + near_copies.votes(many[50_000:]), atol=1)


def test_pairs_near_the_least_similarity(documents):
    """Pairs just above 0.8 go, those just below stay."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        base = [f"p{k}w{rng.randrange(4000)}" for _ in range(300)]
        other = list(base)
        for at in range(7, 7 + 25 * (6 + k % 2 * 3), 25):  # each changes five shingles: 0.82 and 0.74
            other[at] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"] for r in near_copies.removed(documents(rows)).collect()}
    must = groups(rows, 0.8)
    assert len(must) == 75 and got <= must and len(must - got) <= 2


def test_copies_among_texts_that_share_boilerplate(documents, monkeypatch):
    """In buckets crowded with texts that resemble one another without being copies, every pair is still compared."""
    monkeypatch.setattr(near_copies, "DENSE", 2)
    monkeypatch.setattr(near_copies, "HUBS", 1)
    rng = random.Random(21)
    shared = [f"b{rng.randrange(4000)}" for _ in range(250)]
    rows = []
    for k in range(150):
        own = [f"o{k}x{j}" for j in range(50)]
        rows.append((2 * k, " ".join(shared + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join(shared + own[:5] + [f"c{k}"] + own[6:30] + [f"d{k}"] + own[31:])))
    got = {r["doc_id"] for r in near_copies.removed(documents(rows)).collect()}
    must = groups(rows, 0.8)
    assert len(must) == 50 and got == must


def test_texts_that_meet_by_chance_are_no_crowd(documents, monkeypatch):
    """Few places for many texts: unrelated ones share cells, and their shingles are not joined for that; copies still go."""
    monkeypatch.setattr(near_copies, "REFERENCES", 3)  # 216 cells a table
    rng = random.Random(5)
    rows = [(i, " ".join(f"s{rng.randrange(3000)}" for _ in range(60))) for i in range(900)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    shingled, crowd_of = [], near_copies.crowd_of

    def counted(texts, crowded, docs):
        out = crowd_of(texts, crowded, docs)
        shingled.append(texts.count() and near_copies._celled(texts).join(crowded, "cell", "left_semi").select("own").distinct().count())
        return out

    monkeypatch.setattr(near_copies, "crowd_of", counted)
    got = {r["doc_id"] for r in near_copies.removed(documents(rows)).collect()}
    assert got == groups(rows, 0.8) == {1000 + i for i in range(40)}
    assert sum(shingled) <= 0.3 * len(rows)
