import random

import numpy as np
import pytest
from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.common import documents, held_out
from veilframe.llm.language_id import Network, identify_languages
from veilframe.llm.quality_classifier import N_FEATURES, classify_quality, estimate_prior, features, fit

SF = "/root/testdata/sf0.01"


def test_gradients_by_backpropagation_through_time():
    r = np.random.default_rng(0)
    net = Network.random(["a", "b", "c"], 4)
    for name in ("embed", "recur", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64) * 0.7)
    ids, labels = r.integers(0, 5, (7, 6)), r.integers(0, 3, 6)
    _, slopes = net.gradients(ids, labels)
    for weights, slope in zip((net.embed, net.recur, net.out), slopes):
        for _ in range(40):
            at = tuple(int(r.integers(0, n)) for n in weights.shape)
            kept, step = weights[at], 3e-3
            weights[at] = kept + step
            above = net.gradients(ids, labels)[0]
            weights[at] = kept - step
            below = net.gradients(ids, labels)[0]
            weights[at] = kept
            assert (above - below) / (2 * step) == pytest.approx(slope[at], abs=2e-4)


def test_every_byte_is_read():
    net = Network.random(["a", "b"], 4)
    long, short = b"ab" * 5000, b"x"
    both = net.label([long, short])
    assert np.allclose(both.sum(1), 1, atol=1e-4)
    assert np.allclose(both[0], net.label([long])[0], atol=1e-6) and np.allclose(both[1], net.label([short])[0], atol=1e-6)
    assert not np.allclose(net.label([long[:-64] + b"z" * 64])[0], both[0], atol=1e-6)


def test_held_out_languages(spark):
    docs = documents(spark, SF)
    rows = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(docs_of):
    rows = identify_languages(docs_of([*EDGES, (50, "12 34!"), (51, "x " * 30000)])).collect()
    assert len(rows) == len(EDGES) + 2
    for r in rows:
        if r.doc_id in (7, 8, 9, 50):
            assert (r.lang_pred, r.score) == ("und", 1.0)
        if r.doc_id in (10, 51):
            assert r.lang_pred == "en"
    assert identify_languages(docs_of([])).count() == 0


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = classify_quality(documents(spark, SF), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in rows)


def test_quality_edges(spark, docs_of):
    r = random.Random(2)
    pairs = [*EDGES, *((100 + k, words(r, 40)) for k in range(30)), *((200 + k, "### | " * 30) for k in range(10))]
    labels = spark.createDataFrame([(100 + k, 1) for k in range(20)] + [(100, 1), (None, 1), (999, 1)], "doc_id bigint, quality int")
    assert classify_quality(docs_of(pairs), labels).count() == len(pairs)
    none = classify_quality(docs_of(pairs), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert classify_quality(docs_of([]), labels).count() == 0


def test_marks_of_bad_documents_and_of_the_test_fold_are_not_used(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    other = labels.where("quality = 1").withColumn("quality", F.when(held_out("doc_id"), 0).otherwise(1))
    a, b = (sorted(map(tuple, classify_quality(docs, x).collect())) for x in (labels, other))
    assert a == b


def test_prior_and_separation():
    r = np.random.default_rng(3)
    good, bad = r.normal(0.8, 0.5, (4000, N_FEATURES)), r.normal(-0.8, 0.5, (1200, N_FEATURES))
    positive, unlabelled = good[:2000], np.concatenate([good[2000:], bad])
    assert estimate_prior(positive, unlabelled) == pytest.approx(2000 / 3200, abs=0.08)
    model = fit(positive, unlabelled)
    assert model.scores(good[2000:]).mean() > 0.9 > 0.1 > model.scores(bad).mean()
    assert features(None).sum() == features(" \n").sum() == 0


def test_more_languages_than_the_sample_has_room_for(docs_of, spark, monkeypatch):
    """250 labels, each with bytes of its own; the sample shrinks instead of leaving any out."""
    from veilframe.llm import language_id

    monkeypatch.setattr(language_id, "DOCS_IN_ALL", 500)
    rows = [(i, f"{chr(0x4E00 + i % 250)} " * 30, f"l{i % 250}") for i in range(1500)]
    out = identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(out) == 1500 and {r.lang_pred for r in out} <= {f"l{k}" for k in range(250)}


WITHOUT_PACKAGE = """
import os, sys
sys.path.insert(0, sys.argv[1])
from veilframe.llm.queries import LLM_QUERIES
from veilframe.session import local_session

spark = local_session(2)
seen = spark.range(1).mapInArrow(lambda batches: (b for b in batches if __import__("importlib.util").util.find_spec("veilframe") is None), "id bigint")
assert seen.count() == 1, "workers have the package"
for name in ("op2_quality_classifier", "op10_language_id"):
    assert LLM_QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
print("done")
"""


def test_workers_need_no_package(tmp_path):
    """Functions travel with the job, and what is broadcast are plain values."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    script = tmp_path / "job.py"
    script.write_text(WITHOUT_PACKAGE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script), root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
