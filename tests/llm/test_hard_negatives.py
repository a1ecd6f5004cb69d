"""Hard negatives against brute force in whole Python numbers, and against SQL."""

import math
import random

import numpy as np

from broadsheet.llm import hard_negatives as h
from tests.oracle import DATA, compare

SCHEMA = "extra string, vec_id long, embedding array<double>, label int, score string"


def _brute(rows):
    used = []
    for _, i, v, label, _ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 4096 for x in v):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (i, own, v) in enumerate(used):
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, label) for m, (j, label, w) in enumerate(used) if m != n and len(w) == len(v)]
        for p, j, label in sorted(x for x in scored if x[2] == own)[:5]:
            inside = sorted(x for x in scored if x[2] != own and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(inside, 1)]
    return sorted(out)


def _rows():
    r = random.Random(3)
    rows = [("e", i, [r.gauss(0, 0.3) + (i % 5 == k) for k in range(11)], r.randrange(4), "s") for i in range(400)]
    rows += [("e", i, [0.5] * 11, i % 3, "s") for i in range(400, 460)]  # ties
    rows += [("e", 1000, [1.0, 2.0], 1, "s"), ("e", 1050, [1.0, 1.9], 2, "s"), ("e", 1001, [1.0, 1.99], 1, "s"), ("e", 1100, [], 1, "s"), ("e", 1101, [], 2, "s")]
    rows += [("e", None, [0.5] * 11, 1, "s"), ("e", 2000, None, 1, "s"), ("e", 2050, [0.5] * 10 + [None], 1, "s"), ("e", 2100, [float("nan")] * 11, 1, "s")]
    rows += [("e", 2150, [float("inf")] * 11, 1, "s"), ("e", 2200, [1e308] * 11, 1, "s"), ("e", 2250, [0.1] * 11, None, "s"), ("e", 2300, [-4095.9] * 11, 1, "s")]
    rows += [("e", 2350, [1e-200, -1e-200] * 5 + [0.0], 1, "s"), ("e", -50, [0.7] * 11, 2, "s"), rows[50], rows[50], rows[51]]
    return rows


def _got(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _brute(rows)
    assert len(want) > 50
    assert _got(h.mine(df)) == want
    assert _got(h.mine(df, tile=32)) == want  # many tiles, more buckets


def test_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP", 2048, raising=False)
    monkeypatch.setattr(h, "CHUNK", 64, raising=False)
    monkeypatch.setattr(h, "BLOCK", 3)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = h.stage(h.tiles(df, 32), "tiles")
    scored = h._scored(packed, h.anchors(packed), 20, 4, False)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    assert _got(h.mine(df, tile=32)) == _brute(rows)


def test_empty_and_all_unusable(spark):
    assert h.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert h.mine(spark.createDataFrame([("e", 50, None, 1, "s")], SCHEMA)).collect() == []


def test_scores_are_exact():
    r = np.random.default_rng(1)
    for size in (1, 7, 8, 9, 64):
        x, a = r.integers(-(2**20) + 1, 2**20, (50, size)), r.integers(-(2**20) + 1, 2**20, (5, size))
        planes, bits = h.bit_planes(x)
        assert (h.whole_numbers(bits, size, np.arange(50)) == x).all()
        assert (h.scores(bits, h.subset_sums(a)) == x @ a.T).all()


def test_against_sql(spark):
    d = f"{DATA}/sf0.01"
    compare(h.digest(spark.read.parquet(f"{d}/embeddings.parquet")), d, h.sql())
