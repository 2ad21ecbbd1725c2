import pytest

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import nearest
from tests.llm.test_ngram_join import brute
from weirflow.llm.decontaminate import RATE, plain
from weirflow.llm.quality import CUT, fit


def test_every_stage_against_brute_force(spark, sf_dir):
    """Each stage on its own input, and the run as a whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = fit(docs, labels)
    kept = None
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "mixing":
            assert out.columns == docs.columns
        got = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            import pandas as pd

            scores = model.score(pd.Series([t for _, t in rows]))
            want = {d for (d, _), s in zip(rows, scores, strict=True) if s >= CUT}
        elif name == "exact_dedup":
            want = set({t: d for d, t in sorted(rows)}.values())
        elif name == "ngram_join":
            want = {d for d, c, _, _ in brute(rows) if c == d or c is None}
        elif name == "decontamination":
            want = {d for d, t in rows if not any(i[:40] in plain(t) or i[-40:] in plain(t) for i in items)}
            assert got <= want or all(nearest(i, plain(t))[0] > len(i) * RATE for d, t in rows if d in got - want for i in items)
            assert got >= want
            want = got
        else:
            want = got
            assert got <= {d for d, _ in rows}
        assert got == want, name
        assert len(got) > 0.5 * len(rows)
        docs, kept = out, [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        rows = kept
    assert sorted(pipeline.run(spark, sf_dir).select("doc_id", "mix_shard", "mix_position").collect()) == sorted(docs.select("doc_id", "mix_shard", "mix_position").collect())


def test_stages_take_hard_and_empty_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "x" * 150_000, "en", "s", 1), (3, "a b c d e f g", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        assert stage(spark, docs, sf_dir).count() <= 15, name


def test_names():
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    with pytest.raises(TypeError):
        pipeline.run()
