from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from statuta.llm import decontam, langid, toxicity

WORDS = [a + b for a in "ba co du fi ge hu ka lo mi no pe ru sa te vo".split() for b in "lan mer tok sil dun rip".split()]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(90, None), (91, ""), (92, "too short here"), (3, prose(rng, 25))]
    docs = []
    for d in range(300):
        text = prose(rng, rng.choice([5, 40, 200])).split()
        if d % 10 == 0:  # a planted item, every third with some words replaced, one at a doc's very start or end
            words = items[d // 10 % 20][1].split()
            if d % 30 == 0:
                for k in rng.sample(range(30), 4):
                    words[k] = "changed"
            at = rng.choice([0, len(text) // 2, len(text)])
            text[at:at] = [w.upper() + "," if d % 20 == 0 else w for w in words]
        docs.append((d, " ".join(text), "x"))
    docs += [(1000, None, "x"), (None, items[5][1], "x"), (1001, "", "x"), (50, items[7][1], "x"), (1002, prose(rng, 20000) + " " + items[2][1], "x"), (1002, prose(rng, 20000) + " " + items[2][1], "x")]
    return docs, items


def brute(docs, items):
    import re

    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text, _ in docs:
        have = split(text)
        for i, item in items:
            want = split(item)
            if len(want) < decontam.LEAST_TOKENS:
                continue
            for at in range(1 - len(want), len(have)):
                same = [0 <= at + k < len(have) and have[at + k] == w for k, w in enumerate(want)]
                if sum(same) >= decontam.LEAST_SHARE * len(want):
                    out.add((d, i))
    return out


def test_leaks_match_brute_force(spark, leaks):
    docs, items = leaks
    short = [d for d in docs if d[0] != 1002]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated_pairs(spark.createDataFrame(short, "doc_id long, text string, item string"), b).collect()
    want = brute(short, items)
    assert want <= {(r.doc_id, r.item_id) for r in got} and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert len(want) >= 30 and all(r.share >= decontam.LEAST_SHARE or r.stretch >= decontam.LEAST_STRETCH for r in got)
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_masks_hit_every_pattern_of_replacements():
    for n in range(8, 16):
        for replaced in itertools.combinations(range(n), n - math.ceil(decontam.LEAST_SHARE * n - 1e-9)):
            kept = set(range(n)) - set(replaced)
            assert any(all(at + k in kept for k, c in enumerate(mask) if c == "1") for mask in decontam.MASKS for at in range(n - len(mask) + 1)), (n, replaced)


def test_sparse_replacements_and_short_items(spark):
    items, docs, rng = [], [], random.Random(8)
    for i, n in enumerate([8, 10, 12, 15, 20, 59]):
        words = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        # every fourth replaced, then as many as may be, at random
        for spots in [set(range(3, n, 4)), *({*rng.sample(range(n), n - math.ceil(0.7 * n - 1e-9))} for _ in range(40))]:
            docs.append((len(docs), " ".join(["before"] + ["other" if k in spots else w for k, w in enumerate(words)] + ["after"]), i))
    items += [(10, "Seven short words that stand as one"), (11, "single"), (12, ""), (13, "two words")]
    docs += [(1000, "so: seven short words, that stand as one. Single", 10), (1001, "seven short words that stand as two", None), (1002, "two other words", None), (1003, "single", 11), (1004, "single single two words", 11), (1005, None, None)]
    want = {(d, i) for d, _, i in docs if i is not None} | {(1000, 11), (1004, 13)}
    got = decontam.contaminated_pairs(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.at for r in got if (r.doc_id, r.item_id) == (1004, 11)} == {1}


def test_long_texts_nulls_and_shuffled_join(spark, leaks, monkeypatch):
    docs, items = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(d, b).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    two = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(d, b).collect()}
    assert one == two and (1002, 2) in one and (None, 5) in one
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {x[0] for x in docs} - {p[0] for p in one}
    assert decontam.contaminated_pairs(d.limit(0), b).count() == 0 == decontam.contaminated_pairs(d, b.limit(0)).count()


LANGS = {"aa": ["qua", "tro", "mel"], "bb": ["shi", "zuk", "owo"], "cc": ["pfe", "rtz", "sch"], "dd": ["ñam", "ción", "lle"], "ee": ["één", "ijs", "oek"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_codewords_differ(n):
    code = langid.codebook(n)
    assert code.shape[0] == n and all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 4) for i in range(n) for j in range(i))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, spoken(rng, k := list(LANGS)[i % 5], rng.randrange(2, 60)), k if i % 9 else None, 1.5) for i in range(600)]
    rows += [(None, "qua tro", "aa", 0.0), (900, None, "aa", 0.0), (901, "", "bb", 0.0), (902, "12 ?!", "bb", 0.0), (903, "tro mel " * 30_000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(df.filter("doc_id % 4 != 2"))
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: r for r in got.collect()}
    test = [r for i, r in got.items() if i is not None and i < 600 and i % 4 == 2]
    assert np.mean([r.lang_pred == list(LANGS)[r.doc_id % 5] for r in test]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    one = langid.fit(df.filter("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"aa", "und"}


def test_ambiguous_between_two(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, spoken(rng, "aa" if i % 2 else "bb", 20), "aa" if i % 2 else "bb") for i in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    half = langid.identify(spark.createDataFrame([(1, "quatro shizuk")], "doc_id long, text string"), model).first()
    whole = langid.identify(spark.createDataFrame([(1, "quatro melqua")], "doc_id long, text string"), model).first()
    assert whole.score > half.score and not whole.ambiguous


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["zorgon", "blarfing", "snivvel"]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = prose(rng, rng.randrange(8, 60)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "s"))
        if i % 4:
            labels.append((i, int(toxic)))
    docs += [(2000, None, "s"), (2001, "", "s"), (None, "zorgon", "s"), (2002, prose(rng, 30_000), "s"), (7, docs[7][1], "s")]
    labels += [(3000, 1), (None, 1), (5, None), (8, 0), (8, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d.select("doc_id", "text"), model, ["doc_id"]).collect()}
    test = [r for i, r in got.items() if i is not None and i < 1500 and i % 4 == 0]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and got[2001].predicted == 0 == got[2002].predicted
    flat = toxicity.fit(d, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(d, flat, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(d.limit(0), model, ["doc_id"]).count() == 0
    odd = d.select("doc_id", "text", *[F.lit("kept").alias(c) for c in ("score", "features", "prediction", "probability", "raw", "rawPrediction")])
    clash = toxicity.score(odd, model, odd.columns)
    assert clash.columns == ["doc_id", "text", "features", "prediction", "probability", "raw", "rawPrediction", "score", "predicted"]
    assert {(r.doc_id, r.score) for r in clash.collect() if r.raw == "kept"} == {(r.doc_id, r.score) for r in toxicity.score(d.select("doc_id", "text"), model, ["doc_id"]).collect()}


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_capitals_are_a_share_of_the_letters(n):
    f = dict(zip(toxicity.FEATURES, toxicity.Features({}).of("Ab 1, " * (n // 6)), strict=True))
    assert f["capitals"] == 0.5


def test_isotonic_step_against_pooled_neighbours(spark):
    """The curve's values are the weighted means of pooled neighbours, as brute force pools them."""
    rng = random.Random(2)
    points = [(round(rng.random(), 2), float(rng.random() < 0.4), rng.choice([1.0, 2.5])) for _ in range(200)]
    df = spark.createDataFrame(points, "label_at double, label double, w double").withColumnRenamed("label_at", "__raw")
    curve = toxicity.IsotonicRegression(featuresCol="__raw", labelCol="label", weightCol="w", predictionCol="__score").fit(df)
    blocks = []
    for x in sorted({p[0] for p in points}):
        own = [(y, w) for a, y, w in points if a == x]
        blocks.append([sum(y * w for y, w in own), sum(w for _, w in own), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {x: s / w for s, w, xs in blocks for x in xs}
    assert all(abs(r["__score"] - want[r["__raw"]]) < 1e-9 for r in curve.transform(df).collect())


def test_decoding_against_brute_force():
    rng = np.random.default_rng(3)
    code = langid.codebook(9)
    model = langid.Model(list("abcdefghi"), code, None, rng.random(code.shape[1]), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
    means = rng.normal(size=(40, code.shape[1]))
    best, score, lead = model.decode(means)
    for i, m in enumerate(means):
        margin = m * model.slope + model.shift
        loss = [sum(t * math.log1p(math.exp(-w * x)) for t, w, x in zip(model.trust, word, margin, strict=True)) for word in code]
        apart = min(sum(t for t, x, y in zip(model.trust, code[a], code[b], strict=True) if x != y) for a in range(9) for b in range(a))
        belief = [math.exp(-x / apart) for x in loss]
        assert best[i] == int(np.argmin(loss)) and abs(score[i] - max(belief) / sum(belief)) < 1e-9
        assert abs(lead[i] - (sorted(belief)[-1] - sorted(belief)[-2]) / sum(belief)) < 1e-9


def test_toxic_features():
    f = toxicity.Features({"zorgon": 4.0, "^zorg": 2.0})
    name = dict(zip(toxicity.FEATURES, f.of("You ZORGON! z0rg0n zorgonia"), strict=True))
    assert abs(name["strong_log"] - math.log(3)) < 1e-9 and name["near_second"] > 0 and name["shouted"] > 0 and name["masked_hits"] > 0 and name["prefix_max"] == 2.0
    assert f.of("") == f.of(" ") and len(f.of("")) == len(toxicity.FEATURES)
