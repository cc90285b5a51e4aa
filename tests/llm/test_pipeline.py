"""The pipeline's stages against brute force, and its rows as a whole."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from collections import Counter  # noqa: E402

from plumbline.llm import common, quality  # noqa: E402
from tests.llm.test_operators import brute_components, brute_mix, contaminated, plain_em, sets_of  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]

    # the scorer is trained on the label model's posteriors: it keeps what an independent model of the votes keeps
    rows = [(r.doc_id, p) for r in docs.collect() if (p := quality.pattern_of(r.text))]
    good = {i: q for (i, _), q in zip(rows, plain_em([p for _, p in rows])[0], strict=True)}
    one = stages["quality"](spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    differ = kept ^ {i for i, q in good.items() if q >= quality.CUT}
    assert len(differ) <= len(good) / 100 and one.columns == docs.columns

    two = stages["near_dedup"](spark, docs, sf)
    want = brute_components(sets_of([(r.doc_id, r.text) for r in docs.collect()], 5))
    assert {r.doc_id for r in two.collect()} == set(want.values()) and two.columns == docs.columns

    three = stages["decontamination"](spark, docs, sf)
    bad = {i for i, _ in contaminated([(r.doc_id, r.text) for r in docs.collect()], bench)}
    assert bad and {r.doc_id for r in three.collect()} == {r.doc_id for r in docs.collect()} - bad

    four = stages["mixing"](spark, docs, sf)
    copies = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert four.columns == docs.columns and Counter((r.doc_id, r.text, r.source) for r in four.collect()) == +copies

    five = stages["sharding"](spark, four, sf)
    assert five.count() == four.count() and five.columns == [*docs.columns, "shard", "slot"]


def test_run(spark, sf):
    begun = common.mark()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(common._written) == begun + 1  # nothing but the result is left
    assert rows and len({(r.shard, r.slot) for r in rows}) == len(rows)
