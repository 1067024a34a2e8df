import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import DATA
from llm_conftest import frame, prose

from vecspark.llm import queries, toxicity


def maximal(x):
    """All maximal scoring segments by their definition: the best one, then both sides of it."""

    def rec(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += x[j]
                if s > 1e-12 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else [*rec(a, best[1]), best, *rec(best[2] + 1, b)]

    return rec(0, len(x))


def test_segments_by_definition():
    draw = random.Random(5)
    for _ in range(1500):
        gap = -draw.choice([0.3, 0.7, 1.1])
        x = [draw.choice([gap, gap, gap, draw.random() * 3 + 0.01]) for _ in range(draw.randint(0, 14))]
        got = toxicity.segments([(i, s) for i, s in enumerate(x) if s > 0], gap)
        assert [(round(s, 6), i, j) for s, i, j in got] == [(round(s, 6), i, j) for s, i, j in maximal(x)]


def test_log_odds_against_the_formula(spark):
    counts = spark.createDataFrame([("bad", 0, 50), ("the", 900, 95), ("rare", 0, 2), ("fine", 300, 5)], "token string, clean bigint, toxic bigint")
    scores, n0, n1 = toxicity.log_odds(counts, 0.05, 5, 3.5, 10)
    assert set(scores) == {"bad"} and (n0, n1) == (1200, 152)
    a1, a0, more = 50 + 2.5, 2.5, 0.05 * 1352
    assert math.isclose(scores["bad"], math.log(a1 / (152 + more - a1)) - math.log(a0 / (1200 + more - a0)))


def test_passages_of_planted_words(spark):
    draw = random.Random(6)
    texts, labels = [], []
    for i in range(400):
        words = prose(i, 120).split()
        toxic = i % 4 == 0
        if toxic:
            for at in range(40, 48):
                words[at] = draw.choice(["scumlet", "vilestuff", "vileword", "gitface"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    out = {r.doc_id: r for r in toxicity.score_documents(frame(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    for i, y in labels:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1
        assert out[i].predicted == y == int(out[i].score >= 0.5)
        if y:
            a, b = map(int, out[i].passages.split(",")[0].split(":"))
            assert 38 <= a <= 42 and 46 <= b <= 50


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_query_on_held_out_rows(spark, sf):
    sf = f"{DATA}/{sf}"
    truth = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op9_toxicity(spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "documents").count()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02


def test_held_out_labels_change_nothing(spark):
    sf = f"{DATA}/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(key, toxicity.score_documents(docs, labels).collect())) == sorted(map(key, toxicity.score_documents(docs, turned).collect()))


def test_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (None, 1), (7, None), (8, 3)], "doc_id bigint, toxic int")
    for own in (labels, labels.limit(0)):
        rows = toxicity.score_documents(odd, own).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.predicted for r in rows if r.doc_id in (0, 1, 2))
    assert toxicity.score_documents(nothing, labels).collect() == []


@pytest.mark.parametrize("step", [1, 3, 10, 50])
@pytest.mark.parametrize("score", [0.4, 1.0, 9.0])
def test_many_spread_hits_take_linear_time(step, score):
    import time

    draw = random.Random(step)
    hits = [(i * step + draw.randrange(step), score + draw.random()) for i in range(100_000)]
    begun = time.time()
    found = toxicity.segments(hits, -0.3)
    assert time.time() - begun < 1
    assert sum(1 for s, a, b in found if s <= 0 or a > b) == 0 and all(x[2] < y[1] for x, y in zip(found, found[1:]))


def test_texts_that_share_a_passage_are_not_near_copies():
    shared = prose(1, 60)
    texts = [shared + " " + prose(i, 200) for i in range(2, 42)]
    assert len({toxicity.sketch(t) for t in texts}) == len(texts)
    assert toxicity.sketch(texts[0]) == toxicity.sketch(texts[0].upper() + "!")
    assert toxicity.sketch(None) == toxicity.sketch("")


def slow_scores(docs, labels):
    """Every document's score by the definitions, one token after the other."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    usable = {}
    for i, y in labels:
        if y in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 5:
            usable[i] = max(y, usable.get(i, 0))
    texts = ({}, {})
    for i, t in docs:
        if i in usable:
            own = words(t)
            least = tuple(sorted({zlib.crc32(" ".join(own[j : j + 4]).encode()) for j in range(max(1, len(own) - 3))})[:4])
            held = texts[usable[i]]
            held[least] = min(held.get(least, t), t)
    counts = [collections.Counter(), collections.Counter()]
    for y in (0, 1):
        for t in texts[y].values():
            own = set(words(t))
            counts[y].update(own | {w[:n] + "*" for w in own for n in (3, 4, 5, 6) if len(w) > n})
    n0, n1 = (sum(n for w, n in c.items() if w[-1] != "*") for c in counts)
    scores, strength = {}, 0.05 * (n0 + n1)
    for w in counts[0].keys() | counts[1].keys():
        c, t = counts[0][w], counts[1][w]
        a0, a1 = c + 0.05 * (c + t), t + 0.05 * (c + t)
        delta = math.log(a1 / (n1 + strength - a1)) - math.log(a0 / (n0 + strength - a0))
        if c + t >= 5 and delta / math.sqrt(1 / a1 + 1 / a0) > 3.5 and delta > 0.5:
            scores[w] = delta

    def of(word):
        return next((scores[k] for k in (word, *(word[:n] + "*" for n in (6, 5, 4, 3) if len(word) > n)) if k in scores), 0.0)

    rate = []
    for y in (0, 1):
        every = [of(w) for t in texts[y].values() for w in words(t)]
        rate.append(sum(x > 0 for x in every) / max(len(every), 1))
    gap = min(math.log((1 - min(rate[1], 0.9)) / (1 - min(rate[0], 0.9))), -0.01)

    def best(t):
        top = run = 0.0
        for w in words(t):
            run = max(0.0, run + (of(w) or gap))
            top = max(top, run)
        return len(words(t)), top

    clean = [best(t) for t in texts[0].values()]
    k = len(clean) / max(sum(max(n, 1) * math.exp(-s) for n, s in clean), 1e-9)
    surprise = lambda n, s: min(max(s - math.log(k * max(n, 1)), -20.0), 20.0)
    x = np.array([surprise(*b) for b in clean + [best(t) for t in texts[1].values()]])
    slope, offset = toxicity.logistic(x, np.array([0.0] * len(clean) + [1.0] * len(texts[1])))
    return [1 / (1 + math.exp(-min(max(slope * surprise(*best(t)) + offset, -40.0), 40.0))) for _, t in docs]


def test_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.01"
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.toxic) for r in queries.table(spark, sf, "labels").collect()]
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    want = slow_scores(docs, labels)
    assert np.allclose([got[i].score for i, _ in docs], want, rtol=1e-6, atol=1e-9)
    assert [got[i].predicted for i, _ in docs] == [int(s >= 0.5) for s in want]
    assert len({round(s, 3) for s in want}) > 20


def test_logistic_curve_is_where_its_loss_is_least():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 1, 300), rng.normal(2, 1, 40)])
    y = np.array([0.0] * 300 + [1.0] * 40)
    weight = np.where(y > 0, 0.5 / 40, 0.5 / 300)
    loss = lambda a, b: (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (a * x + b))).sum() + 0.5e-3 * (a * a + b * b)
    a, b = toxicity.logistic(x, y)
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
