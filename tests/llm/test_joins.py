"""Operators 11 to 13: brute force, edge cases, and the parts of their methods."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import hardneg, jaccardjoin, merkle

SMALL = "/root/testdata/sf0.001"


def _table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# -- 11, hard negatives -------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, anchor_id string, score string, v int"


def _mined(spark, tmp_path, rows):
    path = _table(spark, tmp_path, "embeddings", [(*r, "a", "s", 1) for r in rows], VECTORS)
    return sorted(tuple(r) for r in hardneg.op11_hard_negatives(spark, path).collect())


def test_hard_negatives_of_clusters_ties_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK", 64)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8))
    rows = []
    for k in range(600):
        x = middle[k % 6] + rng.normal(size=8) * 0.2
        rows.append([k, [float(np.float32(c)) for c in x], k % 4])
    for k in range(100, 260):
        rows[k][1] = rows[100][1]  # a third of the rows are one vector
    rows[3][1], rows[5][1], rows[8][2], rows[9][1] = None, [None] * 8, None, [float("nan")] + [0.0] * 7
    rows[11][1] = [float("inf")] + [0.0] * 7
    rows[50][1] = [0.0] * 8  # an anchor with equal scores everywhere
    want = sorted(hardneg.brute_force([tuple(r) for r in rows]))
    assert _mined(spark, tmp_path, [tuple(r) for r in rows] + [tuple(rows[k]) for k in (100, 7)] + [(None, rows[0][1], 1)]) == want
    assert want


def test_hard_negatives_of_little(spark, tmp_path):
    assert _mined(spark, tmp_path / "a", []) == []
    assert _mined(spark, tmp_path / "b", [(0, [1.0, 0.0], 1)]) == []
    # A shorter vector counts as padded; 7 divides 0 and 7, so their labels move on.
    rows = [(0, [1.0, 0.0], 1), (1, [1.0], 2), (2, [0.75, 0.0], 3), (3, [0.96, 0.0], 3)]
    assert _mined(spark, tmp_path / "c", rows) == [(0, 1, 1, 2, 65536, 49152)]


def test_bounds_hold_for_every_node():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 6)) * 100)
    q = np.floor(rng.normal(size=(20, 6)) * 100)
    top2 = float((x * x).sum(axis=1).max())
    tree = hardneg.Tree(np.arange(500), np.zeros(500, np.int64), x, top2)
    assert sorted(tree.ids.tolist()) == list(range(500))

    def rows_of(n):
        first, last = tree.loose[n]
        below = range(*tree.children[n])
        return [*range(first, last), *(r for m in below for r in rows_of(m))]

    norm2 = (q * q).sum(axis=1)
    for n in range(len(tree.radius)):
        low, high = hardneg.bounds(q @ tree.centre[n], norm2, top2, tree.radius[n])
        score = q @ tree.x[rows_of(n)].T
        assert (score >= low[:, None]).all() and (score <= high[:, None]).all()


def test_search_skips_nodes_outside_of_the_window(monkeypatch):
    x = np.vstack([np.random.default_rng(k).normal(size=(200, 4)) + c for k, c in enumerate(([900, 0, 0, 0], [0, 900, 0, 0], [0, 0, 900, 0]))])
    x = np.floor(x)
    tree = hardneg.Tree(np.arange(600), np.zeros(600, np.int64), x, float((x * x).sum(axis=1).max()))
    q = np.array([[10.0, 0, 0, 0]])
    scored = []
    whole = tree.x

    class Spy:
        def __getitem__(self, at):
            scored.append(len(whole[at]))
            return whole[at]

    tree.x = Spy()
    one = np.array([0])
    w, p, s = hardneg.search(tree, np.array([-1]), one, q, one, np.array([-hardneg._FAR]), np.array([hardneg._FAR]), np.array([-hardneg._FAR]), 5, True)
    best = np.sort((whole @ q[0]))[::-1][:5]
    assert s.tolist() == best.astype(int).tolist() and sum(scored) <= 220


# -- 12, Merkle manifest -------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, leaf string"


def _docs(rows):
    return [(*r, "g", "l") for r in rows]


def _manifest(spark, path):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["proof_sha256"])
    got = sorted((r.asDict() for r in merkle.op12_merkle(spark, path).collect()), key=key)
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    return got, sorted(merkle.brute_force(rows), key=key)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_against_lists(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    long = "word " * 50_000
    rows = [(k, f"t{k}", ("en", "fr", None, "", "é", "z\U0001f600", "z�")[k % 7 if k < 21 else 0], "s" if k % 3 else None, k) for k in range(41)]
    rows += [(None, "x", "en", "s", 1), (3, "again", "en", "s", None), (3, "again", "en", "s", None), (77, None, "de", None, None), (78, long, "de", "", 0)]
    got, want = _manifest(spark, _table(spark, tmp_path, "documents", _docs(rows), DOCS))
    assert got == want
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    got, want = _manifest(spark, _table(spark, tmp_path / "a", "documents", _docs([(5, "t", "en", "s", 1)]), DOCS))
    assert got == want
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"]
    assert got[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert _manifest(spark, _table(spark, tmp_path / "b", "documents", [], DOCS)) == ([], [])


def test_messages_are_taken_by_label():
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(5)]
    node = merkle.ascend(8, leaves, 3)
    assert list(node) == sorted(node) and len(node) == 5 + 3 + 2 + 1
    assert node[2, 3] == merkle._h(node[1, 6])  # a run of one
    for index, proof, steps in merkle.descend(node, 3, 1, "", ""):
        assert merkle.fold(leaves[index - 8], proof, steps) == node[3, 1]
        assert merkle.fold("0" * 64, proof, steps) != node[3, 1]


# -- 13, Jaccard join ----------------------------------------------------------

TEXTS = "doc_id bigint, text string, n string, key int, grp string"


def _joined(spark, rows):
    docs = spark.createDataFrame([(*r, "n", 1, "g") for r in rows], TEXTS)
    return jaccardjoin.join(docs)


def _near_copies(seed=5):
    """Groups of copies, near copies at all similarities, chains, shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    passage = " ".join(word() for _ in range(40))
    for _ in range(12):
        base = [word() for _ in range(rng.choice((4, 7, 30, 120, 300)))]
        for _ in range(rng.randrange(1, 9)):
            now = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                now[rng.randrange(len(now))] = word()
            texts.append(" ".join(now))
            if rng.random() < 0.5:  # a chain: the next one starts from this one
                base = now
    texts += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(8)]
    texts += ["", None, " \t\n", "a", "A", "a b c", "a B c", "a b", "a a a a a a a a", "a a a a"]
    # 17 common shingles of 20 are exactly 0.85; 16 of 19 are less
    exact = [f"e{k}" for k in range(23)]
    texts += [" ".join(exact), " ".join(exact[:20]), " ".join(exact[:19])]
    return dict(enumerate(texts))


@pytest.mark.parametrize("size", [2, 512])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(jaccardjoin, "BLOCK_DOCS", size)
    texts = _near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in _joined(spark, list(texts.items())).collect()}
    want = jaccardjoin.brute_force(texts)
    assert got == want
    assert sum(v[2] for v in want.values()) > 60


def test_bounds_that_are_too_low_are_raised(spark, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "ODDS", 0.5)
    texts = _near_copies(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in _joined(spark, list(texts.items())).collect()}
    assert got == jaccardjoin.brute_force(texts)


def test_jaccard_join_of_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(40_000))
    rows = [(1, long), (2, long + " y"), (2, long + " y"), (None, long), (4, None), (4, None), (5, "one two three four five")]
    got = sorted(_joined(spark, rows).collect(), key=lambda r: (r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.n_links) for r in got] == [(None, None, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1), (4, 4, 0), (4, 4, 0), (5, 5, 0)]
    assert _joined(spark, []).count() == 0


def test_a_hot_group_emits_no_pairs(spark):
    """300 near copies of one text link with one another; tasks return a forest."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: k % 190] + [f"v{k}"] + base[k % 190 + 1 :])) for k in range(300)]
    out = _joined(spark, rows)
    assert out.agg(F.max("component_id"), F.min("n_links")).first() == (0, 299)


def test_partners_counts_by_merge_and_probe():
    rng = np.random.default_rng(2)
    base = rng.choice(2**40, 200, replace=False).astype(np.uint64)
    sets = []
    for k in range(60):
        s = base.copy()
        s[rng.choice(200, k, replace=False)] = rng.choice(2**40, k, replace=False)
        sets.append(np.unique(s))
    lists = jaccardjoin.Lists(sets)
    for s in sets:
        want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert lists.partners(s).tolist() == want
    assert jaccardjoin.required(100) == 85
