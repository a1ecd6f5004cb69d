"""The pipeline stage by stage against brute force."""

import corpus_pipeline
from broadsheet.llm import quality_rules
from broadsheet.llm.common import stage, table
from tests.llm.test_near import _brute
from tests.llm.test_suffix import _brute as _passages
from tests.oracle import DATA, expected


def test_stages(spark):
    d = f"{DATA}/sf0.001"
    docs = table(spark, d, "documents")
    for name, work in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else None
        out = stage(work(spark, docs, d), name)
        if name == "quality_rules":
            _, order, rows = expected(d, quality_rules.sql())
            assert {r.doc_id for r in out.collect()} == {r[order.index("doc_id")] for r in rows if r[order.index("kept")]}
        elif name == "language_id":
            assert {r.doc_id for r in out.collect()} == set(before)
        elif name == "near_duplicates":
            _, least = _brute({i: r.text for i, r in before.items()}, 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, c in least.items() if i == c}
        elif name == "suffix_dedup":
            want = _passages({i: r.text for i, r in before.items()})
            for r in out.collect():
                n, gone, _, _ = want[r.doc_id]
                assert n - gone - 4 * want[r.doc_id][2] <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
                assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out
    assert docs.count() > 0
