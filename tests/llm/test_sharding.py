"""Sampled splitters: balance, slots and groups."""

from collections import Counter, defaultdict
from zlib import crc32

from broadsheet.llm import sharding


def _check(rows, texts, shards=16):
    total = sum(r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == crc32((texts[r.doc_id] or "").encode())
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= max(2 * total / shards / sharding.LARGE, max(r.size for r in rows)) + 1
    return by


def test_documents(spark):
    from tests.oracle import DATA

    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = sharding.digest(df).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)


def test_hot_group_nulls_and_long_texts(spark):
    texts = {k: "the same text " * 5 for k in range(4000)} | {k: f"text number {k} " * (k % 9) for k in range(4000, 9000)}
    texts |= {9001: None, 9002: "", 9003: "é" * 50000}
    rows = sharding.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    by = _check(rows, texts)
    homes = defaultdict(set)
    for s, own in by.items():
        for r in own:
            homes[texts[r.doc_id]].add(s)
    split = [t for t, where in homes.items() if len(where) > 1]
    assert split == ["the same text " * 5], Counter(map(len, homes.values()))


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (1, "a", 5, 6), (None, "b", 5, 6)], "doc_id long, text string, size long, shard long")
    rows = sharding.digest(df).collect()
    assert len(rows) == 3 and all(r.size == 2 for r in rows)
    assert sharding.digest(df.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}" * (k % 7), "x") for k in range(300)], "doc_id long, text string, slot string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4


def test_many_empty_rows_do_not_fill_one_range(spark):
    texts = {k: None if k % 2 else "" for k in range(3000)} | {k: f"text number {k} " * 60 for k in range(3000, 9000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = sharding.assign(df).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)
    assert len({r.shard for r in rows if r.size == 1}) == 1
    found = []
    keep, sharding.range_of = sharding.range_of, lambda cuts: found.append(cuts) or keep(cuts)
    try:
        sharding.assign(df)
    finally:
        sharding.range_of = keep
    sizes = Counter(r[0] for r in sharding.keyed(df).select(keep(found[0])).collect())
    assert max(sizes.values()) < 1000
