"""Rule bitmask ledger: against SQL on whole tables and by hand on odd rows."""

from broadsheet.llm import quality_rules as q
from broadsheet.llm import queries
from tests.oracle import DATA, compare

SCHEMA = "doc_id long, text string, n_words string"


def test_against_sql(spark):
    d = f"{DATA}/sf0.001"
    compare(queries.QUERIES["op8_rule_bitmask"](spark, d), d, queries.SQL["op8_rule_bitmask"])


def test_odd_rows(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, same, "x"), (3, same, "x"), (None, same + "\n" + same, "x"), (5, "a b\n\n \na b\nc", "x"), (6, "é\xa0é " * 20000, None)]
    out = {(r.doc_id, r.n_words): r for r in q.ledger(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[(1, 0)].fail_bits == out[(2, 0)].fail_bits == 1
    assert out[(3, 60)].fail_bits == 0 and out[(3, 60)].n_repeat_words == 0
    assert out[(None, 120)].n_repeat_words == 120 and out[(None, 120)].n_dup_lines == 1
    assert (out[(5, 5)].n_dup_lines, out[(5, 5)].n_lines, out[(5, 5)].word_chars) == (1, 3, 5)
    assert (out[(6, 20000)].word_chars, out[(6, 20000)].n_repeat_words) == (60000, 20000)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good), (2, good + " #" * 40), (3, "a a a"), (4, good + "!" * 100)]
    ledger = q.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.kept for r in q.apply_policy(ledger, "base").orderBy("doc_id").collect()] == [True, True, False, True]
    assert [r.kept for r in q.apply_policy(ledger, "v2").orderBy("doc_id").collect()] == [True, False, False, False]
    counts = {r.rule: (r.n_failed, r.n_only) for r in q.ablation(ledger, "v1").collect()}
    assert counts == {"few_words": (1, 1), "repeated_words": (0, 0), "symbols": (1, 1), "shouting": (1, 1)}


def test_keep_passing_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "s", 7)], "doc_id long, text string, fail_bits string, n_lines long")
    kept = q.keep_passing(df, "v2")
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in df.collect()]
    assert q.verdicts(df.limit(0)).count() == 0
