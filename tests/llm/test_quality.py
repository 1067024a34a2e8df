import collections
import functools
import math

import numpy as np
import pytest
from oracle import DATA
from llm_conftest import frame, prose

from vecspark.llm import quality, queries


def grams_of(text, order=quality.ORDER):
    whole = chr(quality.OPEN) * order + (text or "") + chr(quality.CLOSE)
    return [whole[i - order + 1 : i + 1] for i in range(order, len(whole))]


def slow_model(texts):
    """Minus log p of a text by the textbook recursion over dictionaries."""
    tables = [collections.Counter(g for t in texts for g in grams_of(t))]
    for _ in range(quality.ORDER - 1):
        tables.append(collections.Counter(g[1:] for g in tables[-1]))
    tables = tables[::-1]

    def cut(table):
        n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.5]
        return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]

    cuts = [cut(t) for t in tables]
    totals = []
    for t, d in zip(tables, cuts):
        own = {}
        for g, n in t.items():
            c = own.setdefault(g[:-1], [0, 0.0])
            c[0] += n
            c[1] += d[min(n, 3) - 1]
        totals.append(own)

    @functools.cache
    def p(g):
        k = len(g) - 1
        below = p(g[1:]) if k else 1 / quality.ALPHABET
        total = totals[k].get(g[:-1])
        if total is None:
            return below
        n = tables[k].get(g, 0)
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total[0] + total[1] / total[0] * below

    return lambda text: -sum(math.log(p(g)) for g in grams_of(text))


def slow_judged(docs, labels, quantile=0.999, margin=1.05):
    """{row: (perplexity, threshold)} of (id, text, lang) rows, computed plainly."""
    good = {i for i, q in labels if q == 1 and i is not None}
    nll = slow_model([t for i, t, _ in docs if i in good and quality.trains(i)])
    own = [(i in good, lang or "", nll(t), len(t or "") + 1) for i, t, lang in docs]
    trusted = [x[1:] for x in own if x[0]]
    mean_all = sum(x[1] for x in trusted) / sum(x[2] for x in trusted)
    means, limits = {}, {}
    for lang in {x[0] for x in trusted}:
        mine = [x for x in trusted if x[0] == lang]
        means[lang] = (sum(x[1] for x in mine) + quality.PRIOR_SYMBOLS * mean_all) / (sum(x[2] for x in mine) + quality.PRIOR_SYMBOLS)
    smooth = lambda lang, x, n: (x + quality.PRIOR * means.get(lang, mean_all)) / (n + quality.PRIOR)
    top = lambda rows: sorted(math.ceil(smooth(*x) * 1000) for x in rows)[math.ceil(quantile * len(rows)) - 1] / 1000
    for lang in means:
        mine = [x for x in trusted if x[0] == lang]
        limits[lang] = (len(mine) * top(mine) + quality.PRIOR_DOCS * top(trusted)) / (len(mine) + quality.PRIOR_DOCS)
    return [(math.exp(smooth(lang, x, n)), math.exp(limits.get(lang, top(trusted))) * margin) for _, lang, x, n in own]


@pytest.fixture(scope="module")
def texts():
    return [prose(i, 40) for i in range(12)] + ["", "A short one.", None]


def test_model_against_the_textbook(spark, texts):
    docs = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)] + [(None, texts[0], "en"), (90, "日本語 Zzz !!! 9", "ja"), (3, "the an", "en")]
    labels = [(i, int(i != 3)) for i in range(len(texts))] + [(None, 1)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").coalesce(1)
    out = quality.judged(rows, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = slow_judged(docs, labels)
    assert [(r.doc_id, r.text) for r in out] == [d[:2] for d in docs]
    assert np.allclose([(r.perplexity, r.threshold) for r in out], want, rtol=1e-9)
    assert [r.keep for r in out] == [a <= b for a, b in want]


def test_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in queries.table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.quality) for r in queries.table(spark, sf, "labels").collect()]
    got = {r.doc_id: (r.perplexity, r.threshold) for r in queries.op7_quality(spark, sf).collect()}
    assert np.allclose([got[d[0]] for d in docs], slow_judged(docs, labels), rtol=1e-9)


def test_probabilities_sum_to_one(spark):
    text = "abcab abd cab"
    model = {r.g: (r.p, r.back) for r in quality.kneser_ney(spark.createDataFrame([(g, 1) for g in grams_of(text)], "g string, n bigint").groupBy("g").sum("n").toDF("g", "n")).collect()}

    def p(g):
        if g in model and model[g][0] is not None:
            return math.exp(model[g][0])
        back = model.get(g[:-1], (None, None))[1]
        below = p(g[1:]) if len(g) > 1 else 1 / quality.ALPHABET
        return below * (1 if back is None else math.exp(back))

    for context in ("", "a", "ab", "xab", "\x02\x02\x02", "zzz"):
        known = [chr(quality.CLOSE), *sorted(set(text))]
        assert math.isclose(sum(p(context + c) for c in known) + (quality.ALPHABET - len(known)) * p(context + "日"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("size", [1, 1 << 40])
def test_grams_numbered_by_table_or_sorting(size, monkeypatch):
    texts = ["abcabc", "", None, "bca 日本", "a" * 50]
    plain = quality.Grams(texts)
    monkeypatch.setattr(quality, "TABLE", size)
    other = quality.Grams(texts)
    every = lambda g: [g.names(k, np.ones(len(g.ends[k - 1]), dtype=bool)) for k in range(1, 5)]
    assert every(plain) == every(other) and (plain.ids == other.ids).all()
    whole = every(quality.Grams(["abcabc"]))[-1]
    assert sorted(g for g in whole if g[-1] != chr(quality.OPEN)) == sorted(set(grams_of("abcabc")))
    assert all(len(set(h.tolist())) == len(h) for h in plain.hashes())


@pytest.mark.parametrize("chunk", [1, 60, 500])
def test_chunks_change_nothing(spark, texts, chunk, monkeypatch):
    texts = [*texts, *texts[:3], "日本語"]
    assert [t for part in quality.chunks(texts, chunk) for t in texts[part]] == texts
    known, names = quality.Slots(), []
    for part in quality.chunks(texts, chunk):
        grams = quality.Grams(texts[part])
        slots, fresh = known.of(grams.hashes())
        for k, new in enumerate(fresh, 1):
            names += grams.names(k, new)
        for k, own in enumerate(slots, 1):
            assert [names[i] for i in own] == grams.names(k, np.ones(len(own), dtype=bool))
    assert len(names) == len(set(names)) == known.count


def test_junk_goes_and_prose_stays(spark):
    good = [prose(i, 80) for i in range(150)]
    junk = ["&&& %%% $$$ ### " * 30, "SHOUT!! " * 60, "x9x9 || " * 50]
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality.judged(frame(spark, good + junk), labels).collect()}
    assert sum(out[i].keep for i in range(150)) >= 147
    assert not any(out[i].keep for i in range(150, 153))
    kept = quality.judged(frame(spark, good + junk), labels, only_kept=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.keep}


def test_query_on_labelled_rows(spark):
    sf = f"{DATA}/sf0.01"
    truth = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op7_quality(spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "documents").count()
    known = [(truth[r.doc_id], r.keep) for r in rows if truth.get(r.doc_id) is not None]
    good = [k for q, k in known if q == 1]
    bad = [k for q, k in known if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.35


def test_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 1), (6, 1), (None, 1), (7, None), (99, 1)], "doc_id bigint, quality int")
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(r.perplexity > 0 for r in rows)
    assert quality.judged(nothing, labels).collect() == []
    assert all(r.keep for r in quality.judged(odd, labels.limit(0)).collect())
    assert quality.judged(odd, labels, only_kept=True).columns == odd.columns
