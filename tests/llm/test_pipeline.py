from llm_conftest import prose
from oracle import DATA

import corpus_pipeline
from vecspark.llm import decontaminate, pii, quality, queries, simhash


def test_stages_take_effect(spark):
    sf = f"{DATA}/sf0.001"
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "encoding"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        if name == "near_dedup":
            groups = simhash.similar_documents(docs).collect()
            assert len({r.component_id for r in groups}) == len(groups)
        if name == "decontamination":
            left = decontaminate.contamination(docs, queries.table(spark, sf, "benchmark")).collect()
            assert not any(r.hits for r in left)
        if name == "personal_data":
            for r in docs.collect():
                assert not any(s[0] == "email" for s in pii.base_spans(r.text)) and r.n_chars == len(r.text)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == before and all(r.decoded and len(r.ids) == r.n_tokens for r in out)


def test_stages_on_odd_rows(spark, odd, nothing):
    sf = f"{DATA}/sf0.001"
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count()


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def expected(docs, labels, items):
    """(id, text, token ids) of what is left, computed plainly over lists."""
    from test_decontaminate import brute as contaminated
    from test_pii import brute as spans
    from test_quality import slow_judged
    from tokenizers import Tokenizer

    bars = slow_judged([(i, t, "en") for i, t in docs], labels)
    left = [d for d, (found, bar) in zip(docs, bars) if found <= bar]

    shingled = {i: set(simhash.shingles(t.encode(), 5)) for i, t in left}
    top = {i: i for i, _ in left}
    for _ in left:
        for i in top:
            for j in top:
                a, b = shingled[i], shingled[j]
                if top[j] < top[i] and len(a & b) >= 0.8 * len(a | b):
                    top[i] = top[j]
    left = [(i, t) for i, t in left if top[i] == i]
    left = [(i, t) for i, t in left if not contaminated(t, items, 10)[1]]
    library = Tokenizer.from_file(queries.tokenizer_path())
    out = []
    for i, t in left:
        for kind, a, b in sorted(spans(t), key=lambda s: -s[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        out.append((i, t, library.encode(t, add_special_tokens=False).ids))
    return out


def test_run_against_brute_force(spark, tmp_path):
    docs = [(i, prose(i, 120) + (f" write to b.{i}@c.org or call +1 (212) 555-01{i}" if 10 <= i < 30 else "")) for i in range(60)]
    items = [(0, prose(500, 30)), (1, "just three words")]
    docs += [(60, docs[3][1]), (61, docs[4][1] + " some more"), (62, docs[4][1].replace(" ", "  "))]
    docs += [(63, "&&& %%% $$$ ### " * 30), (64, "SHOUT!! " * 60)]
    docs += [(65, prose(65, 40) + " " + items[0][1][:150] + " " + prose(66, 40)), (66, prose(67, 40) + " Just three, words! " + prose(68, 40))]
    docs += [(67, prose(69, 60) + " write to a.b@c.org or call +1 (212) 555-0101 now"), (68, prose(70, 30))]
    labels = [(i, 1) for i in range(50)] + [(63, 0)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.text, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = expected(docs, labels, items)
    assert got == sorted(want)
    assert {60, 61, 62, 63, 64, 65, 66}.isdisjoint(i for i, _, _ in want) and {67, 68} <= {i for i, _, _ in want}
