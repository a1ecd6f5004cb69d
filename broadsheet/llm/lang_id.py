"""Language of a text: averaged hashed subword embeddings with a linear softmax, trained by gradient descent in numpy.

A subword is a run of three or four characters whose inner characters are letters (anything else is a border mark), hashed
into ``BUCKETS`` rows.  A text is the mean of the embeddings of all its subwords, over the whole text.  Because the softmax
layer is linear, embedding table and layer are multiplied once after training, and a prediction adds one row of logits per
subword.

Training sees a bounded sample of labelled rows: about ``PER_LANG`` documents per language, ``SAMPLE`` in all, drawn by a hash
of doc_id; it is the only bounded part.  Tasks reduce each sampled text to subword counts, so what reaches the driver is bounded by
the sample size.  A fifth of the sample is kept to calibrate: a temperature by likelihood, then the rejection threshold, halfway
between the lowest score of a right prediction and the score of a guess among all languages.  Scores are rejected only where
the kept fifth has no right prediction near, and only if it has wrong ones there; otherwise no score is too low.

Defined results: null text or a text without letters is ``und`` with score 0 and is rejected; without any labelled row all
texts are ``und``; equal logits give the language that sorts first; repeated rows and equal texts get equal answers; other
columns pass through and do not take part; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 16
PER_LANG = 600
SAMPLE = 6000
WINDOW = 80
EPOCHS = 6
RATE = 0.8
UND = "und"
#: characters hashed at a time
SPAN = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of the text, a span at a time."""
    low = f" {text.lower()} "
    for at in range(0, len(low), SPAN):
        codes = np.frombuffer(low[at : at + SPAN + 3].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        c = np.where(letter, codes, 32).astype(np.uint32)
        for n in (3, 4):
            m = min(len(c) - n + 1, SPAN)
            if m <= 0:
                continue
            inner = letter[1 : 1 + m].copy()
            if n == 4:
                inner &= letter[2 : 2 + m]
            h = np.full(int(inner.sum()), n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + c[k : k + m][inner]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            yield (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for b in subwords(text):
        total += np.bincount(b, minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits per bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for b in subwords(text or ""):
            total += np.bincount(b, minlength=BUCKETS) @ self.table if len(b) > BUCKETS else self.table[b].sum(axis=0)
            n += len(b)
        return _softmax((total / n + self.bias) / self.temperature) if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        p = self.scores(text) if self.langs else None
        if p is None:
            return UND, 0.0, True
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best])), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def sample(rows: DataFrame) -> DataFrame:
    """About PER_LANG rows of each language, by a hash of doc_id (rows: doc_id, text, lang)."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(PER_LANG, SAMPLE // max(1, len(counts)))
    luck = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    most = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        most = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(most)
    return rows.filter(luck < most)


def examples(rows: DataFrame) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """Bags of each sampled text and of two short windows of it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"]):
                draw = np.random.default_rng(abs(int(doc)))
                starts = draw.integers(0, max(1, len(text) - WINDOW), 2)
                for part in (text, *(text[a : a + WINDOW] for a in starts)):
                    ids, n = bag(part)
                    if len(ids):
                        out.append((int(doc), lang, ids.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "ids", "n"])

    got = rows.select("doc_id", "text", "lang").mapInPandas(run, "doc_id long, lang string, ids binary, n binary").collect()
    return sorted(
        ((r["doc_id"], r["lang"], np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.float32)) for r in got),
        key=lambda r: (r[0], len(r[2]), r[2].tobytes()),
    )


def fit(rows: DataFrame) -> Model:
    """Train on labelled rows (doc_id, text, lang); rows without label, text or id are not used."""
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    data = examples(sample(usable))
    langs = sorted({r[1] for r in data})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    number = {lang: k for k, lang in enumerate(langs)}
    held = [r for r in data if r[0] % 5 == 0] or data
    learn = [r for r in data if r[0] % 5 != 0] or data
    draw = np.random.default_rng(0)
    e = draw.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps = EPOCHS * len(learn)
    done = 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(learn)):
            _, lang, ids, n = learn[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = n / n.sum()
            x = share @ e[ids]
            error = _softmax(x @ w + bias)
            error[number[lang]] -= 1
            back = w @ error
            w -= rate * np.outer(x, error)
            bias -= 0.1 * rate * error
            e[ids] -= (rate * 20) * share[:, None] * back  # a bucket's share of a text is small
    table = e @ w
    logits = np.stack([(n / n.sum()) @ table[ids] + bias for _, _, ids, n in held])
    truth = np.array([number[r[1]] for r in held])
    temperature = min((0.25 * 1.25**k for k in range(20)), key=lambda t: _loss(logits / t, truth))
    p = np.stack([_softmax(z) for z in logits / temperature])
    return Model(langs, table, bias, temperature, _threshold(p, truth))


def _loss(z: np.ndarray, truth: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))


def _threshold(p: np.ndarray, truth: np.ndarray) -> float:
    """Halfway from the lowest right held-out score to a guess (1 / languages); 0 where no wrong prediction lies below that."""
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    if not right.any():
        return 0.0
    guess = 1 / p.shape[1]
    low = guess + (float(best[right].min()) - guess) / 2
    return low if (best[~right] < low).any() else 0.0


def held_out() -> Column:
    """Documents of which nothing is learned."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_documents(documents: DataFrame) -> Model:
    return fit(documents.select("doc_id", "text", "lang").filter(~held_out()))


def predictor(df: DataFrame, model: Model):
    """A column function text -> (lang_pred, score, rejected); the model's size is bounded by its parameters."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def digest(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of op2, and whether the prediction is rejected."""
    model = fit_documents(documents) if model is None else model
    rows = documents.select("doc_id", held_out().alias("held_out"), predictor(documents, model)("text").alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.rejected")


def keep_accepted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows whose language is recognised, all columns kept."""
    model = fit_documents(documents) if model is None else model
    return documents.filter(~predictor(documents, model)("text")["rejected"])
