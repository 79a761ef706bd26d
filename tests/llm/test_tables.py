"""Sharding and vector search against brute force; the pipeline against its stages' rules."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phenogrid.llm import decontaminate, sharding, simhash, vectors

FOLDER = "/root/testdata/sf0.001"


def test_sharding(spark):
    rows = [(i % 900, "ü" * (i * 37 % 500)) for i in range(1200)] + [(None, None), (None, ""), (7, None)] + [(5, "big")] * 400
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, shard int, size string")
    placed, slot_map = sharding.shard_records(df, "doc_id", "text", 5, slots=256)
    got = placed.collect()
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for shard in range(5):
        places = sorted(r.place for r in got if r.shard == shard)
        assert places == list(range(len(places))) and places
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    largest = max(r["bytes"] for r in slot_map.collect())
    assert max(load.values()) - min(load.values()) <= largest
    assert {r.slot_id: r.shard for r in got}.items() <= {r.slot_id: r.shard for r in slot_map.collect()}.items()
    placed, slot_map = sharding.shard_records(df.where("false"), "doc_id", "text", 5)
    assert placed.count() == 0 and slot_map.count() == sharding.SLOTS


@pytest.mark.parametrize("rows", [
    [(None if i % 2 else i, f"text {i} " + "x" * (i % 50)) for i in range(20000)],
    [(-1 if i % 2 else i, f"text {i} " + "x" * (i % 50)) for i in range(20000)],
    [(i, "one text that half of all share" if i % 2 else f"other {i} " + "y" * (i % 40)) for i in range(20000)],
    [(3, "equal rows") if i % 2 else (i, f"other {i} " + "y" * (i % 40)) for i in range(20000)],
], ids=["null keys", "one key", "one text", "equal rows"])
def test_sizes_are_near_equal_whatever_repeats(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed, slot_map = sharding.shard_records(df, "doc_id", "text", 16)
    load = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(load) == 16 and max(load) <= 1.02 * min(load)
    assert slot_map.agg(F.sum("bytes")).first()[0] == sum(load)


def test_maps_are_kept_by_version(spark, tmp_path):
    one = sharding.first_map(spark, [5, 1, 7, 3] * 16, 4)
    two = sharding.rebalance(one, 5)
    for m in (one, two):
        sharding.publish_map(m, str(tmp_path / "map"))
    rows = lambda m: sorted(map(tuple, m.collect()))
    assert rows(sharding.read_map(spark, str(tmp_path / "map"))) == rows(two)
    back = sharding.read_map(spark, str(tmp_path / "map"), 1)
    assert rows(back) == rows(one) and back.schema == sharding.MAP_SCHEMA
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sharding.publish_map(one, str(tmp_path / "map"))


def test_rebalancing(spark):
    sizes = [(i * 7919) % 1000 + 1 for i in range(512)]
    one = sharding.first_map(spark, sizes, 8)
    two = sharding.rebalance(one, 9)
    a, b = ({r.slot_id: r.shard for r in m.collect()} for m in (one, two))
    moved = {s for s in a if a[s] != b[s]}
    assert sum(b[s] == 8 for s in moved) >= 0.9 * len(moved) > 0 and len(moved) < 512 / 8
    load = Counter()
    for s, shard in b.items():
        load[shard] += sizes[s]
    assert len(load) == 9 and max(load.values()) <= 1.03 * sum(sizes) / 9
    three = {r.slot_id: r.shard for r in sharding.rebalance(two, 8).collect()}
    assert set(three.values()) == set(range(8))
    assert {r.version for r in two.collect()} == {2}


@pytest.mark.parametrize("n", [4, 300])
def test_vectors(spark, n, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    draw = np.random.default_rng(2)
    x = np.round(draw.normal(size=(n, 6)), 1)  # rounding makes ties
    x[1::5] *= 1e3
    x = np.vstack([x, [x[0] * 3, x[0] * 3, x[1]]])
    ids = [*range(n), 0, 0, 1]  # rows that repeat an id, with the same vector and with others
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, []), (None, [1.0] * 6), (1120, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, rank int, score int")
    want = []
    for q in range(len(x)):
        scores = sorted((-float(np.cumsum(x[q] * x[j])[-1]), ids[j]) for j in range(len(x)) if j != q)[:5]
        want += [(ids[q], r, j, -s) for r, (s, j) in enumerate(scores, 1) if ids[q] % 20 == 0]
    for parts in (1, 40):
        got = vectors.search(df.repartition(parts), "vec_id", "embedding", 20, 5).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert vectors.search(df.where("false"), "vec_id", "embedding", 20, 5).count() == 0


def test_tile_survivors_are_few():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(2000, 32))
    ids = np.arange(2000)
    found = list(vectors.tile(rows[:50], ids[:50], rows, ids, 10))
    exact = rows[:50] @ rows.T
    np.fill_diagonal(exact[:, :50], -np.inf)
    best = np.argsort(-exact, axis=1)[:, :10]
    assert [f[1] for f in found] == best.ravel().tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes, before = [], docs
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, before, FOLDER).cache()
        sizes.append((name, after.count()))
        assert after.columns[:5] == corpus_pipeline.COLUMNS
        lost = before.join(after, "doc_id", "left_anti")
        if name == "language_id":
            assert lost.where(F.col("text").rlike("[A-Za-z]")).count() == 0
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before, "doc_id", "text").groupBy("component").agg(F.min("doc_id").alias("low"))
            assert {r.low for r in groups.collect()} == {r.doc_id for r in after.collect()}
        if name == "benchmark_decontamination":
            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            clean = decontaminate.mark(before, "text", items, "item_id", "text").where("hits.n_hit = 0").select("doc_id", "text")
            assert clean.join(after, ["doc_id", "text"], "left_anti").count() == 0
            assert decontaminate.mark(after, "text", items, "item_id", "text").where("hits.n_hit > 9").count() == 0
        if name == "sentencepiece":
            assert after.where("exact").count() == sizes[-2][1]
        before = after
    counts = [n for _, n in sizes]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * docs.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]


def test_pipeline_odd_rows(spark, tmp_path):
    long = "The same long line of words stands in several of these documents here"
    rows = [(1, long + "\nThe other line of the first text is about the weather", "en"), (2, long, "en"), (2, long, "en"), (None, None, None), (3, "", None), (4, "12 34", "en"), (5, "The quick and the slow went to the sea with all of their things", None)]
    docs = spark.createDataFrame([(k, t, g, "s", len(t or "")) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 5]
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_document_dedup_null_ids_and_repeats(spark):
    own = [" ".join(f"{w}{i}" for i in range(30)) for w in ("sea", "hill", "town", "wood")]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (7, own[1]), (4, own[2]), (4, own[2]), (9, own[2]), (None, own[3]), (None, own[3])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup_documents(spark, docs, "").select("doc_id", "text").collect()
    assert sorted((r.text, r.doc_id) for r in got) == sorted([(own[0], None), (own[1], 7), (own[2], 4), (own[3], None)])


def test_stages_keep_null_texts_and_ask_for_languages(spark, tmp_path):
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "plain words", None, "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontaminate_documents(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    with pytest.raises(ValueError, match="language"):
        corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert corpus_pipeline.identify_language(spark, docs.where("text is null"), str(tmp_path)).count() == 0
