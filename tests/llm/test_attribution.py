"""Token attribution against the spans of the tokenizers library."""

import public_tokenizers
from tokenizers import Tokenizer

from broadsheet.llm import token_attribution as ta
from tests.llm.test_tokens import ODD


def _documents(spark):
    from tests.oracle import DATA

    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()} | ODD | {9100: "\n\nab\n\n\ncd  \n x"}


def _brute(text, encoder, rule):
    sections, at = [], 0
    for line in text.split("\n"):
        stop = min(len(text), at + len(line) + 1)
        if stop > at:
            sections.append((at, stop))
        at = stop
    counts = [0.0] * len(sections)
    spans = encoder.encode(text, add_special_tokens=False).offsets
    for a, b in spans:
        over = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if rule == "first":
            counts[next(k for k, (s, e) in enumerate(sections) if s <= a < e)] += 1
        elif rule == "most":
            counts[over.index(max(over))] += 1
        else:
            for k, n in enumerate(over):
                counts[k] += n / (b - a)
    return sections, counts, len(spans)


def test_lines(spark):
    texts = {k: v for k, v in _documents(spark).items()}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, section int").repartition(3)
    for rule in ta.RULES:
        got = {}
        for r in ta.count(df, rule=rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        assert set(got) == set(texts)
        for doc, rows in got.items():
            sections, counts, n = _brute(texts[doc] or "", encoder, rule)
            rows = sorted(rows, key=lambda r: (r.section is None, r.section))
            assert {r.doc_tokens for r in rows} == {n}
            if sections:
                assert [(r.start, r.stop) for r in rows] == sections
                assert all(abs(r.n_tokens - c) < 1e-9 for r, c in zip(rows, counts))
            else:
                assert [(r.section, r.n_tokens) for r in rows] == [(None, 0.0)]


def test_given_sections_and_empty(spark):
    df = spark.createDataFrame([(1, "hello wide world", [(0, 3), (8, 16)]), (2, "abc", None)], "doc_id long, text string, parts array<struct<start:long,stop:long>>")
    rows = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in ta.count(df, sections="parts").collect()}
    assert rows[(1, 0)] == (1.0, 1) and rows[(2, None)][0] > 0
    assert sum(n for (d, _), (n, _) in rows.items() if d == 1) == 3
    assert ta.digest(df.limit(0)).count() == 0
