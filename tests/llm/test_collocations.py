"""Phrases against brute force, filters by round trip, and the query against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from broadsheet.llm import collocations as co
from tests.oracle import DATA, compare

SCHEMA = "rank int, lang string, text string, phrase string"


def _brute(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for _, lang, text, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, c in cand.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def _rows():
    r = random.Random(2)
    words = ["the", "The", "of", "New", "york", "city", "hall", "Straße", "日本", "\x00z", "a\xa0b", "-", "x" * 50]
    texts = [" ".join(r.choices(words, weights=range(13, 0, -1), k=r.randint(0, 60))) + r.choice([".", "\n", "\x0b", "\t", ""]) for _ in range(150)]
    texts += ["new york city hall, new york city; in  new\tyork!" for _ in range(40)]
    rows = [(1, r.choice(["en", "de", None, "und"]), t, "p") for t in texts]
    rows += [(1, "en", None, "p"), (1, "en", "", "p"), (1, None, None, "p"), (1, "rare", "one two", "p"), (1, "fr", "le chat noir " * 200, "p"), rows[0], rows[0]]
    return rows


def _got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("tokens,size", [(1 << 20, 1 << 21), (60, 4)])
def test_against_brute_force(spark, tokens, size):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _brute(rows, 10, 40)
    assert len(want) > 60
    assert _got(co.collocations(df, 10, 40, tokens, size)) == want


def test_slices_keep_phrases(spark, monkeypatch):
    raw = b"ab cd " * 100
    monkeypatch.setattr(co, "SLICE", 16)
    pieces = list(co._slices(raw))
    assert len(pieces) > 10 and b"".join(pieces) == raw


def test_empty(spark):
    assert co.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert co.digest(spark.createDataFrame([(1, "en", None, "p")], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [1, 5, 16, 17, 21, 31, 32])
def test_filters_are_lossless(width):
    r = np.random.default_rng(width)
    packing = co.Packing(width)
    fields = [r.integers(0, 1 << width, 500, dtype=np.uint64) for _ in range(4)]
    upper, rest = packing.mix(fields)
    assert all((a == b).all() for a, b in zip(fields, packing.unmix(upper, rest)))
    want = Counter(zip(*(f.tolist() for f in fields)))
    counts = r.integers(1, 400, 500)
    want = Counter()
    for key, c in zip(zip(*(f.tolist() for f in fields)), counts.tolist()):
        want[key] += c
    halves = [co.CountingQuotientFilter.of(packing, upper[s], rest[s], counts[s]) for s in (slice(0, 200), slice(200, 500))]
    for bits in (0, min(3, packing.top)):
        cells = defaultdict(list)
        for half in halves:
            for prefix, f in half.cut(bits):
                cells[prefix].append(co.CountingQuotientFilter.from_bytes(packing, prefix, bits, f.to_bytes()))
        got = Counter()
        for prefix, fs in cells.items():
            f = co.CountingQuotientFilter.merged(fs)
            for key, c in zip(zip(*(g.tolist() for g in packing.unmix(f.upper, f.rest))), f.counts.tolist()):
                assert key not in got
                got[key] = c
        assert got == want


def test_equal_upper_parts_are_kept_apart():
    upper, rest = np.array([7, 7, 7, 3], np.uint64), np.array([2, 1, 2, 0], np.uint64)
    u, s, c = co._sorted(upper, rest, np.array([1, 1, 5, 2]))
    assert u.tolist() == [3, 7, 7] and s.tolist() == [0, 1, 2] and c.tolist() == [2, 1, 6]


def test_against_sql(spark):
    d = f"{DATA}/sf0.001"
    compare(co.digest(spark.read.parquet(f"{d}/documents.parquet")), d, co.sql())
