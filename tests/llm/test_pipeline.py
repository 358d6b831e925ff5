from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_ngram_join import brute

WORDS = {"en": [a + b for a in "thi ing the ati ond".split() for b in "er on at ed ly".split()], "es": [a + b for a in "ció ñas que llo esa".split() for b in "do ra mos ez ar".split()]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda k, n: " ".join(rng.choice(WORDS[k]) for _ in range(n))
    items = [(i, prose("en", 30)) for i in range(5)]
    docs = [(i, prose(k := "es" if i % 3 else "en", rng.randrange(20, 90)), k, "big" if i % 2 else f"s{i % 4}") for i in range(300)]
    docs += [(400 + i, docs[i][1], docs[i][2], "copies") for i in range(10)]
    docs += [(500 + i, docs[20 + i][1] + " end", docs[20 + i][2], None) for i in range(10) if len(docs[20 + i][1].split()) > 40]
    docs += [(600 + i, prose("en", 20) + " " + items[i][1] + " " + prose("en", 20), "en", "leak") for i in range(5)]
    docs += [(700, None, None, "odd"), (701, "", "en", "odd"), (702, "12 34 !!", "es", "odd"), (5, docs[5][1], docs[5][2], docs[5][3])]
    path = tmp_path_factory.mktemp("p")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def test_pipeline_matches_brute_force(spark, folder):
    path, docs, _ = folder
    alive = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    groups = brute([(d[0], d[1]) for d in alive])
    kept = {d for d, _, component in groups if d == component}
    want = sorted(kept - {600 + i for i in range(5)})
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in got) == want
    text = {d[0]: d[1] for d in docs}
    assert all(r.text == text[r.doc_id] for r in got)
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_the_mixture_holds_in_every_stretch_of_a_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "FILE_ROWS", 100)
    monkeypatch.setattr(corpus_pipeline.sharding, "SHARDS", 2)
    rows = [(i, f"text {i} " * 30, "en", "rare" if i % 10 == 0 else "common", 9) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r.source for r in mixed.withColumn("f", corpus_pipeline.F.col("_metadata.file_path")).withColumn("i", corpus_pipeline.F.col("_metadata.row_index")).orderBy("f", "i").collect()]
    assert len(mixed.inputFiles()) >= 4 and "rare" in order[:300] and set(order[-300:]) == {"common"}
    placed = corpus_pipeline.sharding.external_shuffle(corpus_pipeline.mixture_order(mixed, "place"), shards=2, bucket_bytes=20_000, place="place").collect()
    assert Counter(r.doc_id for r in placed) == Counter(r[0] for r in rows)
    first = order[: len(order) // 2].count("rare")
    for shard in (0, 1):  # the rare source ends in the mixture before the common one, and so it does in each shard
        mine = [r.source for r in sorted(placed, key=lambda r: r.slot) if r.shard == shard]
        half = mine[: len(mine) // 2].count("rare")
        assert abs(half - first / 2) < 0.25 * first and half > 1.2 * mine[len(mine) // 2 :].count("rare")


def test_the_mixture_is_seen_in_the_shards_of_a_small_table(spark, tmp_path):
    """Without the mixing stage rows lie elsewhere; with it every stretch of a shard has its sources' shares."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    where = lambda df: {r.doc_id: (r.shard, r.slot) for r in corpus_pipeline.shuffle_into_shards(spark, df, "").collect()}
    with_, without = where(mixed), where(docs)
    assert set(with_) == set(without) and sum(with_[d] != without[d] for d in with_) > 0.5 * len(with_)
    position = {r.doc_id: i for i, r in enumerate(mixed.withColumn("f", corpus_pipeline.F.col("_metadata.file_path")).withColumn("i", corpus_pipeline.F.col("_metadata.row_index")).orderBy("f", "i").collect())}
    for shard in range(40):
        order = [position[d] for _, d in sorted((slot, d) for d, (s, slot) in with_.items() if s == shard)]
        # a row stands at most one stretch away from its place in the mixture
        assert all(a < b + len(position) / corpus_pipeline.STRETCHES + 1 for i, a in enumerate(order) for b in order[i + 1 :])


def test_names_of_the_stages_may_be_taken(spark, folder, tmp_path):
    path, docs, _ = folder
    odd = spark.read.parquet(f"{path}/documents.parquet")
    for c in ("__row", "__first", "__place", "__file", "__spot", "__i"):
        odd = odd.withColumn(c, corpus_pipeline.F.lit(c))
    odd.write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.shuffle_into_shards):
        out = stage(spark, odd, path)
        assert out.columns[: len(odd.columns)] == odd.columns and {tuple(r)[5:11] for r in out.collect()} == {("__row", "__first", "__place", "__file", "__spot", "__i")}


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pfair_mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert (out.columns if name != "sharding" else out.columns[:5]) == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
