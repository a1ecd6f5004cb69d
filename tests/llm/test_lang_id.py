"""Language identification: held-out accuracy and odd rows."""

from broadsheet.llm import lang_id
from tests.oracle import DATA


def test_held_out_accuracy_and_odd_rows(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = lang_id.fit_documents(df)
    rows = lang_id.digest(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert sum(r.rejected for r in rows) == 0
    assert model.predict(None) == model.predict("") == model.predict("12 34 !!\n") == ("und", 0.0, True)
    text = "the of and that with " * 100_000
    lang, score, rejected = model.predict(text)
    assert lang == "en" and 0 <= score <= 1 and not rejected
    odd = spark.createDataFrame([(1, None, "x", "y"), (None, "1 2", "x", "y"), (2, df.first().text, None, "y")], "doc_id long, text string, score string, _p string")
    assert [r.lang_pred == "und" for r in lang_id.digest(odd, model).collect()] == [True, True, False]
    kept = lang_id.keep_accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == 1


def test_spans_of_long_texts_count_every_subword_once():
    import numpy as np

    text = ("abc déf " * 40)[:-1]
    whole = np.bincount(np.concatenate(list(lang_id.subwords(text))), minlength=lang_id.BUCKETS)
    span, lang_id.SPAN = lang_id.SPAN, 17
    try:
        parts = np.bincount(np.concatenate(list(lang_id.subwords(text))), minlength=lang_id.BUCKETS)
    finally:
        lang_id.SPAN = span
    assert (whole == parts).all()


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in lang_id.digest(df).collect()] == [("und", 0.0, True)]
    assert lang_id.digest(df.limit(0)).count() == 0


def test_threshold_rejects_no_right_prediction():
    import numpy as np

    best = np.linspace(0.6, 0.999, 5000)
    p = np.stack([best, 1 - best], axis=1)
    truth = np.zeros(5000, int)
    assert lang_id._threshold(p, truth) == 0.0
    low = np.concatenate([[0.51, 0.52], best])
    p = np.stack([low, 1 - low], axis=1)
    cut = lang_id._threshold(p, np.concatenate([[1, 1], truth]))
    assert 0.52 < cut < 0.6 and abs(cut - 0.55) < 1e-9
