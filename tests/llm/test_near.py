"""Near duplicates of documents and vectors against brute force."""

import itertools
import random

import numpy as np

from broadsheet.llm import chosen_path, collision_count


def _least(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def _sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        out[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    return out


def _brute(texts, k, percent):
    s = _sets(texts, k)
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return s, _least(texts, links)


def _texts():
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage = r.choices(words, k=40)
    base = r.choices(words, k=120)
    texts = {}
    for k in range(200):  # near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        texts[k] = " ".join(w)
    for k in range(200, 500):  # different texts that share a passage
        texts[k] = " ".join(r.choices(words, k=80) + passage)
    for k in range(500, 560):
        texts[k] = texts[300]
    texts |= {600: None, 601: "", 602: " \n", 603: "One two", 604: "one TWO", 605: "one", 606: "one one one one one one", 607: "one " * 3000, 608: "É é", 609: "é é"}
    return texts


def test_documents_against_brute_force(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, node long, sketch string").repartition(5)
    for leaf in (chosen_path.LEAF, 6):  # small leaves force branching and blocks
        monkeypatch.setattr(chosen_path, "LEAF", leaf)
        monkeypatch.setattr(chosen_path, "BLOCK", 512 if leaf > 6 else 40)
        sets, least = _brute(texts, 4, 80)
        rows = chosen_path.digest(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), c, c == i) for i, c in least.items()}


def test_keep_first_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "A b c d e f g", 2), (None, "a b c d e f g", 3), (4, None, 4)], "doc_id long, text string, kept long")
    kept = chosen_path.keep_first(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert chosen_path.digest(df.limit(0)).count() == 0


def test_vectors_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(700, 24))
    x[100:200] = x[0] + 0.25 * draw.normal(size=(100, 24))
    x[200:260] = x[1]
    vectors = {k: v.tolist() for k, v in enumerate(x)}
    vectors |= {900: None, 901: [0.0] * 24, 902: [float("nan")] + [1.0] * 23, 903: [None] + [1.0] * 23, 904: x[5].tolist()[:10], 905: (2 * x[5]).tolist(), 906: [], 907: [float("inf")] * 24}
    df = spark.createDataFrame([(k, v, k % 3, "x") for k, v in vectors.items()], "vec_id long, embedding array<double>, label int, copies string").repartition(4)
    good = {k: np.array(v) for k, v in vectors.items() if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    least, n = _least(vectors, links), {k: sum(k in p for p in links) for k in vectors}
    for cell in (collision_count.CELL, 32):
        monkeypatch.setattr(collision_count, "CELL", cell)
        rows = collision_count.digest(df).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {k: (n[k], least[k], least[k] == k) for k in vectors}
    assert collision_count.digest(df.limit(0)).count() == 0


def test_vectors_in_rounds_keep_no_pairs(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(500, 32))
    x[100:400] = x[0] + 0.05 * draw.normal(size=(300, 32))
    vectors = {k: v.tolist() for k, v in enumerate(x)} | {600 + k: x[k].astype(np.float32).tolist() for k in range(20)}  # single precision meets double
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    good = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if good[a] @ good[b] >= 0.9]
    assert len(links) > 40_000
    least, n, staged = _least(vectors, links), {k: sum(k in p for p in links) for k in vectors}, {}

    def counted(df, name, keep=collision_count.stage):
        out = keep(df, name)
        staged[name] = staged.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(collision_count, "stage", counted)
    monkeypatch.setattr(collision_count, "ROWS", 1, raising=False)  # four lists to a round
    monkeypatch.setattr(collision_count, "PART", 4096, raising=False)
    rows = collision_count.digest(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {k: (n[k], least[k], least[k] == k) for k in vectors}
    assert max(staged.values()) < 10 * len(vectors)
