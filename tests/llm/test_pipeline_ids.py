"""The stages on rows that are awkward: null and repeated ids, null and empty texts, ties, empty tables."""

import random

import pytest

import corpus_pipeline


def test_each_row_keeps_its_own_text(spark):
    rng = random.Random(3)
    one, two, three, four = ("".join(rng.choices("abcdefgh", k=150)) for _ in range(4))
    rows = [(None, one, "en", "a", 150), (None, two, None, "b", 150), (1, three, "de", "c", 150), (1, four, "fr", None, 150), (2, three + "more", "de", "e", 154), (3, one, "en", "f", 150), (4, None, "en", "g", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.repeats(spark, docs, "")
    assert out.columns == docs.columns
    left = [*rows[:4], (2, "more", "de", "e", 4), (4, "", "en", "g", 0)]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, left))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(4)
    plain = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=60)) for _ in range(6)]
    return [(None, plain[0], "en", "a", 1), (None, plain[1], None, None, None), (1, plain[2], "en", "a", 1), (1, plain[3], "fr", "b", 1), (2, plain[4], "en", "a", 1), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, plain[5], "en", "a", 1), (5, plain[5], "en", "a", 1)]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_every_clean_row(spark, k):
    """Nothing of these goes but what a stage is there for: one of the rows alike is a repeat of the other to the third stage alone."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    told = [(i, t) for i, t, *_ in _rows()]
    if k == 2:
        told.remove((5, _rows()[-1][1]))
        told = [(i, t or "") for i, t in told]
    assert sorted(map(repr, found)) == sorted(map(repr, told)), name
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_decisions_take_effect_on_null_and_repeated_ids(spark):
    item = next(r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect() if len(r.text) > 60)
    rows = _rows() + [(None, f"so {item} it is", "en", "a", 9), (1, item, "en", "a", 9)]
    out = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, SCHEMA), "/root/testdata/sf0.001")
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, _rows()))
    lengths = {}
    for r in corpus_pipeline.pack(spark, spark.createDataFrame(_rows(), SCHEMA), "").collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert set(lengths) == {None, 1, 2, 3, 4, 5} and lengths[3] == lengths[4] == 1
