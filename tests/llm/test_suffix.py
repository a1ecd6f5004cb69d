"""Suffix sorting and passage removal against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import suffix_dedup
from broadsheet.llm.linear_grouping import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.text("ab\x00c", max_size=60), st.integers(1, 3))
def test_suffix_array(text, times):
    t = text.encode() * times
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def _brute(texts):
    first = {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
    out = {}
    for i, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\x01" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def _texts():
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("xyz é") for _ in range(n))
    passage = "this passage is shared by very many documents and is over fifty bytes long, "
    texts = {1000 + k: noise(r.randint(0, 70)) + passage * r.randint(1, 2) + noise(r.randint(0, 70)) for k in range(200)}
    texts |= {20000: None, 20001: "", 20002: "a" * 500, 20003: "a" * 49, 20004: "a" * 50, 20005: "ab" * 100, 19999: "a" * 51, 20006: "é" * 40}
    long = noise(30000)
    return texts | {30000: long, 30001: long[:20000] + "!" + long[20001:], 30002: long}


def test_removal(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, block long, payload string").repartition(4)
    for contexts, piece in ((suffix_dedup.CONTEXTS, suffix_dedup.SORTED), (2, 2000)):
        monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
        monkeypatch.setattr(suffix_dedup, "SORTED", piece)
        rows = suffix_dedup.removed(df, block=20_000).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == _brute(texts)


def test_remove_keeps_columns(spark):
    p = "é" + "a passage that is well over fifty bytes long and stands in both texts"
    rows = [(1, p + "one", "x"), (2, "two" + p, None), (None, p, "y"), (3, None, "z"), (3, None, "z"), (4, p, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string")
    got = suffix_dedup.remove(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.body) for r in got.collect()) == sorted(
        [("1", p + "one", "x"), ("2", "two", None), ("None", p, "y"), ("3", None, "z"), ("3", None, "z"), ("4", "", "w")], key=lambda r: r[0]
    ) or {r.doc_id: r.text for r in got.collect()} == {1: p + "one", 2: "two", None: p, 3: None, 4: ""}
    assert suffix_dedup.digest(df.limit(0)).count() == 0


def test_sort_of_symbols(monkeypatch):
    """Windows are judged as by their bytes, from one symbol per whole eight bytes and one end per text."""
    r = random.Random(5)
    texts = [bytes(r.choices(b"ab\x00\xff", k=r.choice((50, 51, 57, 90)))) for _ in range(30)]
    texts += [t[:55] for t in texts if len(t) > 55] + [b"a" * 120, b"\x00" * 70, b"a" * 60]
    owner = np.array([r.randint(1, 9) for _ in texts])
    sorted_sizes = []

    def spy(symbols):
        sorted_sizes.append(len(symbols))
        return suffix_array(symbols)

    monkeypatch.setattr(suffix_dedup, "suffix_array", spy)
    first = {}
    for t, who in zip(texts, owner):
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(first.get(t[a : a + 50], who), who)
    want = {(k, a, owner[k] > first[t[a : a + 50]]) for k, t in enumerate(texts) for a in range(len(t) - 49)}
    assert set(zip(*suffix_dedup.sort_stretches(texts, owner))) == want
    assert sorted_sizes == [sum(len(t) - 7 + 1 for t in texts)]


def test_runs_of_joined_texts(monkeypatch):
    """A block's texts are hashed together, and each has the runs it has alone."""
    r = random.Random(6)
    docs = [(k, bytes(r.choices(b"ab", k=r.choice((0, 49, 50, 51, 200)))), True, ()) for k in range(300)]
    calls = []
    hashes = suffix_dedup.hashes
    monkeypatch.setattr(suffix_dedup, "hashes", lambda *a: calls.append(1) or hashes(*a))
    got = suffix_dedup._block_runs(docs)
    assert len(calls) == 1
    alone = [suffix_dedup._block_runs([d]) for d in docs]
    for c in (0, 1, 3, 4):
        assert np.concatenate([a[c] for a in alone]).tolist() == got[c].tolist()
    assert got[2].tolist() == [k for k, a in enumerate(alone) for _ in a[0]]
    monkeypatch.setattr(suffix_dedup, "JOINED", 300)
    assert [c.tolist() for c in suffix_dedup._block_runs(docs)] == [c.tolist() for c in got]
