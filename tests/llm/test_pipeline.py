"""The pipeline, stage by stage, against plain versions over the smallest tables."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from rillbase.llm import cotraining  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k < 4:
            assert out.columns == columns, name
            out = spark.createDataFrame(out.collect(), docs.schema)
            found = {r.doc_id: r.text for r in out.collect()}
        if k == 0:
            scored = cotraining.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
            assert set(found) == {r.doc_id for r in scored if r.kept} and 0.5 * len(kept) < len(found) < len(kept)
        elif k == 1:
            classes = brute.near_classes(list(kept.items()))
            assert set(found) == set(classes.values())
        elif k == 2:
            told = brute.repeats(list(kept.items()))
            assert set(found) == {i for i, t in told.items() if t[0] > t[1] or not t[1]}
            assert all(len(t.encode()) <= told[i][0] - told[i][1] for i, t in found.items())
        elif k == 3:
            folded = [" ".join(x.lower().split()) for x in benchmark]
            assert set(kept) - set(found) == {i for i, t in kept.items() if any(x in " ".join(t.lower().split()) for x in folded)}
        else:
            lengths = {}
            for r in out.collect():
                lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
            assert lengths == {i: len(brute.encoded(t)) + 1 for i, t in kept.items()}
        if k < 4:
            docs, kept = out, found


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0
    assert np.all(np.array([r.length for r in out.collect()]) > 0)
