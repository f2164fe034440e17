"""The pipeline's stages one by one, on edge cases and on the smallest sample."""

import collections

import corpus_pipeline
import pytest
from test_llm_operators import SCHEMA, near_copies, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def mixed_share(docs):
    from foliant.llm import catalog, mixing
    from pyspark.sql import functions as F

    return mixing.mix(docs, catalog.MIX_TARGETS).agg(F.avg("prob")).first()[0] - 0.05


def test_stages_keep_columns_and_rows(spark, sample):
    ids = {r.doc_id for r in sample.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, sample, SF)
        assert out.dtypes == sample.dtypes, name
        kept = [r.doc_id for r in out.collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)), name
        # What the mix keeps is what its targets leave: tokens over the largest ratio.
        least = 0.9 * mixed_share(sample) if name == "mixing" else 0.4
        assert len(kept) > least * len(ids), name


@pytest.mark.parametrize("rows", [[], near_copies()])
def test_stages_take_edge_cases(spark, rows):
    docs = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_decisions_take_effect(spark, sample):
    from foliant.llm import catalog, near_dedup

    stages = dict(corpus_pipeline.STAGES)
    classes = {r.class_id for r in near_dedup.classes(sample).collect()}
    assert {r.doc_id for r in stages["MinHash near-dedup"](spark, sample, SF).collect()} == classes
    bad = {r.doc_id for r in catalog.op7_spaced_seeds(spark, SF).collect()}
    assert {r.doc_id for r in stages["benchmark decontamination"](spark, sample, SF).collect()} == \
        {r.doc_id for r in sample.collect()} - bad


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert len(out) > 50 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert max(collections.Counter(r.doc_id for r in out).values()) == 1


def test_texts_without_an_id_or_with_one_id_are_documents(spark):
    import random

    from foliant.llm import catalog

    r = random.Random(7)
    plain = [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "en", "s") for i, t in zip([None, None, None, 7, 5, 5], plain, strict=True)]
    rows += [(7, plain[0], "en", "s"), (8, plain[1], "en", "s")]  # copies of texts without an id
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["MinHash near-dedup"](spark, table(spark, rows), SF)
    assert sorted(x.text for x in kept.collect()) == sorted(plain)
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 0, 0, 5, 5, 7]
    leak = catalog.table(spark, SF, "benchmark").first().text
    rows = [(i, t, "en", "s") for i, t in [(None, plain[0]), (None, leak), (5, plain[1]), (5, leak + " more")]]
    kept = stages["benchmark decontamination"](spark, table(spark, rows), SF)
    assert sorted(x.text for x in kept.collect()) == sorted(plain[:2])
