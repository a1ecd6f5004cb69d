"""Benchmark windows in documents against brute force, and against SQL."""

import hashlib
import random
import re

from broadsheet.llm import decontamination as dc
from tests.oracle import DATA, compare

DOCS, ITEMS = "n_hit string, doc_id long, text string", "text string, item_id long, doc_id int"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, n=10):
    windows = {}
    for text, item, _ in items:
        w = _words(text)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).update([] if item is None else [str(item)])
    lengths = {len(w) for w in windows}
    out = []
    for _, doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


def _tables():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["Straße", "日本語", "averyverylongwordindeed", "averyverylongwordIndeed2"]
    items = [(" ".join(r.choices(vocabulary, k=r.randint(1, 40))), k, 0) for k in range(40)]
    items += [("w1 w2", 100, 0), ("W1, w2!", 101, 0), ("x", 102, 0), ("", 103, 0), (None, 104, 0), ("... --", 105, 0), (items[3][0], 106, 0), (items[4][0], None, 0), items[5]]
    docs = [("h", k, " ".join(r.choices(vocabulary, k=r.randint(0, 200)))) for k in range(60)]
    for k in range(60, 100):
        own = items[k % 40][0].upper() if k % 2 else items[k % 40][0].replace(" ", "-\n ")
        docs.append(("h", k, " ".join(r.choices(vocabulary, k=20)) + ". " + own + "; " + " ".join(r.choices(vocabulary, k=r.randint(0, 5)))))
    docs += [("h", 200, None), ("h", 201, ""), ("h", 202, " . "), ("h", 203, "x"), ("h", None, "w1 w2"), ("h", 60, docs[60][2]), ("h", 204, "w1"), ("h", 205, "w1 w2 " * 3000 + items[0][0])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = _tables()
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = _brute(docs, items)
    assert 30 < sum(x[5] for x in want) < len(want)
    assert _got(dc.digest(d, b)) == want


def test_several_blocks_and_pieces(spark):
    docs, items = _tables()
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    whole, parts = dc.contamination(d, b), dc.contamination(d, b, at_once=150)
    key = lambda r: (r["doc_id"], r["n_words"], r["spans"], sorted(r["items"]))
    assert sorted(map(repr, map(key, whole.collect()))) == sorted(map(repr, map(key, parts.collect())))
    raw = " ".join(f"v{k}" for k in range(400)).encode()
    assert [w for w in dc._pieces(raw, 9)] == [(0, raw.split())]


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 100)
    words = [f"v{k}".encode() for k in range(400)]
    pieces = list(dc._pieces(b" ".join(words), 9))
    assert len(pieces) > 10
    for first, own in pieces:
        assert own == words[first : first + len(own)]
    ends = [first + len(own) for first, own in pieces]
    assert ends[-1] == 400 and all(b[0] == a - 9 for a, b in zip(ends, pieces[1:]) if a >= 9)


def test_search_skips(monkeypatch):
    """Most positions of a clean text are not looked at."""
    table = dc.Table(10, [b" ".join(b"a%d" % (k + j) for j in range(10)) for k in range(50)], [["1"]] * 50)
    looked = []
    run = dc.Words.run
    monkeypatch.setattr(dc.Words, "run", lambda self, at, n: (looked.append(len(at)), run(self, at, n))[1])
    words = dc.Words(b"".join(b"b%d " % (k % 97) for k in range(5000)))
    first, last = dc._strips(dc.np.array([5000]), 10)
    assert len(table.ends(words, first, last)) == 0 and sum(looked) < 5000 / 8


def test_empty_tables(spark):
    docs, items = _tables()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.digest(spark.createDataFrame([], DOCS), b).collect() == []
    assert _got(dc.digest(d, spark.createDataFrame([], ITEMS))) == _brute(docs, [])


def test_against_sql(spark):
    d = f"{DATA}/sf0.01"
    compare(dc.digest(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")), d, dc.sql())
