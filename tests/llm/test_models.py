"""Fitted operators: held-out accuracy, exact parts against brute force, and odd tables."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lm_score, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.15
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        if toxic:
            words[3:3] = rng.sample(["grumblefritz", "snarkwort", "bogmuncher"], 2)
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text, "en", f"src{i % 5}", None))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic), "x"))
    truth = {i: ("!!" not in t, "ritz" in t.lower() or "snark" in t.lower() or "bogm" in t.lower()) for i, t, *_ in rows}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), truth


def test_quality_held_out(labelled):
    docs, labels, truth = labelled
    got = quality.score_quality(docs, labels).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == 900 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["good"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["good"] for r in got)


def test_quality_is_not_fitted_in_the_driver(labelled):
    """The driver gets a fitted model, not the labelled rows' views (here 675 rows of 1,076 numbers)."""
    docs, labels, _ = labelled
    tracemalloc.start()
    try:
        model = quality.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model is not None and most < 1_500_000


def test_toxicity_held_out(labelled):
    docs, labels, truth = labelled
    got = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_risk_and_its_gradient():
    """Against the formula, text by text, and against differences; also where the negative part is held at zero."""
    rng = np.random.default_rng(3)

    def texts(n):
        sets = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(n)]
        return sets, (np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate([np.zeros(0, int), *sets]).astype(int), rng.integers(1, 4, n).astype(float))

    (p_sets, p), (u_sets, u) = texts(7), texts(12)
    held = 0
    for prior, scale in ((0.1, 1), (0.9, 3), (0.5, 0.1)):
        w = rng.normal(0, scale, 7)

        def risk(w, prior=prior):
            def mean(sets, x, sign):
                return sum(n * math.log(1 + math.exp(sign * (sum(w[f] for f in s) + w[6]))) for s, n in zip(sets, x[2], strict=True)) / sum(x[2])

            rest = mean(u_sets, u, 1) - prior * mean(p_sets, p, 1)
            return prior * mean(p_sets, p, -1) + max(0, rest) + 0.01 / 2 * sum(w[:6] ** 2), rest < 0

        value, gradient = toxicity.nn_risk(w, p, u, prior, 0.01)
        assert abs(value - risk(w)[0]) < 1e-9
        held += risk(w)[1]
        for j in range(7):
            step = np.eye(7)[j] * 1e-6
            assert abs(gradient[j] - (risk(w + step)[0] - risk(w - step)[0]) / 2e-6) < 1e-6
    assert held


def test_toxicity_in_shards(spark, labelled, monkeypatch):
    docs, labels, truth = labelled
    monkeypatch.setattr(toxicity, "SHARD", 200)
    odd = labels.withColumn("toxic", F.when(F.col("toxic") == 0, F.lit(None)).otherwise(F.col("toxic"))).unionByName(labels.withColumn("toxic", F.lit(5))).unionByName(labels)
    got = toxicity.score_toxicity(docs, odd).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in got if r["held_out"]]) > 0.95


def test_toxic_text_with_many_copies(spark):
    """A toxic text that fills a third of the rows is found, and so are other texts with only its words."""
    rng = random.Random(7)
    bad, hot = ["grumblefritz", "snarkwort", "bogmuncher"], "a grumblefritz b snarkwort c bogmuncher d"
    rows = []
    for i in range(6000):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        if rng.random() < 0.04:
            words[3:3] = [rng.choice(bad)]
        rows.append((i, hot if i % 3 == 0 else " ".join(words)))
    toxic = {i for i, t in rows if any(b in t for b in bad)}
    labels = [(i, int(i in toxic)) for i, _ in rows if rng.random() < 0.4]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    for copies in (True, False):  # the copies, and the other rows
        own = [r for r in held if (r["doc_id"] % 3 == 0) == copies]
        assert np.mean([r["predicted"] == (r["doc_id"] in toxic) for r in own]) > 0.95
        assert np.mean([r["predicted"] for r in own if r["doc_id"] in toxic]) > 0.9


def test_without_labels(spark, docs, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (odd, empty):
        assert quality.score_quality(df, none).count() == toxicity.score_toxicity(df, none).count() == df.count()
    one = spark.createDataFrame([(0, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["good"] for r in quality.score_quality(docs, one).collect()} == {True}


def test_base_score_and_model(docs, rows, odd, empty):
    tokens = {i: [lower(w) for w in WORD.findall(t or "")] + [None] for i, t, *_ in rows}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in learn for w in tokens[i])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs).collect()}
    assert got.keys() == tokens.keys()
    for i, own in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learn, len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    long = max(rows, key=lambda r: len(r[1] or ""))
    assert got[long[0]]["bits_per_byte"] < 4  # eight without a model
    assert lm_score.score_texts(odd).count() == 4 and lm_score.score_texts(empty).count() == 0


def some_runs(rng):
    key = np.unique((rng.integers(0, 6, (5000, 6)).astype(np.uint64) * np.uint64(31) << np.arange(0, 48, 8, dtype=np.uint64)).sum(1, dtype=np.uint64))
    count = rng.integers(1, 9, len(key))
    pairs = np.zeros(1 << 16, np.int64)
    np.add.at(pairs, lm_score.Counts.packed(key, 1).astype(np.int64), count)
    return key, count, pairs


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    key, count, pairs = some_runs(rng)
    model = lm_score.Model(lm_score.Counts(key, count, pairs))
    model.seen_w += rng.normal(0, 0.1, model.seen_w.shape).astype(np.float32)
    model.learn(key, count.astype(float), 0.5)
    for context in (*(key[:3] & ~np.uint64(255)), np.uint64(0x61626364E200)):
        assert abs((2 ** model.bits(context + np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-6


def test_a_bits_probability_by_the_formula():
    """Logits of counts, mixed by the weights of both gates, beside the adaptive table; one bit at a time."""
    rng = np.random.default_rng(2)
    key, count, pairs = some_runs(rng)
    model = lm_score.Model(lm_score.Counts(key, count, pairs))
    model.learn(key, count.astype(float), 0.5)
    for k in key[:: len(key) // 6]:
        nxt, total = int(k) & 255, 0.0
        for j in range(8):
            so_far = (nxt | 256) >> (8 - j)
            x, longest, size = [], 0, 0
            for o in range(1, 6):
                ctx = key >> np.uint64(8 * (6 - o)) == k >> np.uint64(8 * (6 - o))
                here = ctx & ((key & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j) == so_far)
                one = (key >> np.uint64(7 - j)) & np.uint64(1) == 1
                n0, n1 = int(count[here & ~one].sum()), int(count[here & one].sum())
                x.append(math.log((n1 + 0.3) / (n0 + 0.3)))
                if n0 + n1:
                    longest, size = o, min(int(math.log2(n0 + n1)), 5)
            z = float(np.dot([*x, 1.0], model.seen_w[longest, size] + model.node_w[so_far]))
            at = min(max(z * 2 + 16, 0), 32 - 1e-3)
            refined = model.refine[so_far, int(at)] * (1 - at % 1) + model.refine[so_far, int(at) + 1] * (at % 1)
            p = min(max((1 / (1 + math.exp(-z)) + refined) / 2, 1e-5), 1 - 1e-5)
            total += math.log2(p if nxt >> (7 - j) & 1 else 1 - p)
        assert abs(model.bits(np.array([k]))[0] - total) < 1e-3


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "TAKE", 1 << 14)
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 15)
    one, two = ({r["doc_id"]: r["score"] for r in lm_score.score_texts(d).collect()} for d in (docs.coalesce(1), docs.repartition(5, "text")))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-3


def test_counts_are_exact():
    """Each order's counts are those of the context itself, however many distinct contexts there are."""
    key, count, pairs = some_runs(np.random.default_rng(1))
    got = list(lm_score.Counts(key, count, pairs).of(key))
    nxt = (key & np.uint64(255)).astype(int)
    for i in range(0, len(key), 400):
        for o, (n0, n1) in enumerate(got, 1):
            same = key >> np.uint64(8 * (6 - o)) == key[i] >> np.uint64(8 * (6 - o))
            for j in range(8):
                here = same & (nxt >> (8 - j) == nxt[i] >> (8 - j))
                one = (nxt >> (7 - j)) & 1 == 1
                assert (n0[i, j], n1[i, j]) == (count[here & ~one].sum(), count[here & one].sum())


def test_byte_runs_do_not_cross_texts():
    data = np.frombuffer(b"abcdefgxy", np.uint8)
    key, at = lm_score.byte_runs(data, np.array([0, 7, 7, 9]))
    assert at.tolist() == [0, 8, 9, 12] and len(key) == 12
    assert key[0] == ord("a") and key[8] == 0xFF and key[9] == ord("x")
    assert key[6] == int.from_bytes(b"fedcbg", "big")


def test_lcs():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_leaks_against_brute_force(spark, odd, empty):
    rng = random.Random(9)

    def prose(n):
        return [f"v{int(rng.paretovariate(0.4)) % 30_000}" for _ in range(n)]

    items = [prose(rng.randrange(15, 60)) for _ in range(30)]
    rows, planted = [], set()
    for d in range(200):
        words = prose(rng.randrange(0, 300))
        if d % 4 == 0:
            i = rng.randrange(30)
            own = [w for w in items[i] if rng.random() > (0.15 if d % 8 else 0)]  # paraphrases lack words
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
            planted.add((d, i))
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(99, None), (98, "  ")], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string"), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    brute = set()
    for d, text in rows:
        words = text.split()
        for i, item in enumerate(items):
            for at in range(0, max(1, len(words)), 16):
                region = words[max(0, at - len(item)) : at + 32 + len(item)]
                share, end = decontaminate._best(item, region) if region else (0, 0)
                if share >= decontaminate.COVER and end >= decontaminate.ANSWER_COVER:
                    brute.add((d, i))
    assert pairs <= brute and len(planted & brute - pairs) == 0
    assert decontaminate.find_leaks(odd, bench).count() == decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench).count() == 4


def test_rows_without_id_are_judged_by_themselves(spark, labelled):
    item = " ".join(f"q{i}" for i in range(40))
    docs = spark.createDataFrame([(None, f"x {item} y", 1), (None, "clean words only", 1), (1, item, 1), (2, None, 1)], "doc_id long, text string, _bad_id long")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(None, 7), (1, 7)}
    assert sorted(r["text"] or "" for r in decontaminate.drop_leaks(docs, bench).collect()) == ["", "clean words only"]
    rows, labels, _ = labelled
    shout = "WORD1!! WORD7!! WORD9!! " * 10
    more = rows.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(None, shout, "en", "src1"), (None, shout.lower().replace("!", ""), "en", "src1")], "doc_id long, text string, lang string, source string"))
    assert [r["text"] for r in quality.keep_good(more, labels).filter("doc_id is null").collect()] == [shout.lower().replace("!", "")]


def test_leaks_of_long_items(spark):
    """A copy or paraphrase is found whatever the item's length, beside items of all lengths."""
    rng = random.Random(4)

    def prose(n):
        return [f"v{int(rng.paretovariate(0.4)) % 30_000}" for _ in range(n)]

    items = [prose(n) for n in (20, 40, 100, 150, 200, 300, 400, 700, 1000) for _ in range(3)]
    rows = []
    for i, item in enumerate(items):
        rows.append((2 * i, " ".join(prose(150) + item + prose(150))))
        rows.append((2 * i + 1, " ".join(prose(150) + [f"x{j}" if j % 4 == 1 else w for j, w in enumerate(item)] + prose(150))))
    rows += [(1000 + i, " ".join(prose(300))) for i in range(100)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for at_once in (decontaminate.ITEMS, 50):  # the latter: several blocks, longer items alone
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, items_at_once=at_once).collect()}
        assert {(2 * i + k, i) for i in range(len(items)) for k in (0, 1)} <= got
