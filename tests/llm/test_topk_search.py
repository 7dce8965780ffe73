import math
import random

from pyspark.sql import functions as F

from veilframe.llm import topk_search
from veilframe.llm.topk_search import top_k_search

SCHEMA = "vec_id bigint, embedding array<double>, row string, score int"


def brute(rows, k=20, scale=64):
    def whole(x):
        return math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale

    sound = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(sound):
        if i is None or i % 20:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for p, (j, w) in enumerate(sound) if p != q]
        for rank, (s, _, _, j) in enumerate(sorted(others, key=lambda o: o[:3])[:k], 1):
            out.append((i, rank, j, max(-(2**63), min(2**63 - 1, -s))))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    out = top_k_search(df, F.col("vec_id") % 20 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(x) for x in out.collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_edges_ties_and_brute_force(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(150)]
    same = [r.choice([0.0, 0.5]) for _ in range(8)]
    rows += [(i, same) for i in range(200, 300)]  # a hot vector: ties over more rows than are asked for
    rows += [(20, [0.1] * 8), (20, [0.1] * 8), (None, same), (None, [0.9] * 8), (320, []), (321, [1.0]), (340, [0.0, -0.01])]
    rows += [(360, None), (361, [0.1, None]), (362, [float("nan")]), (380, [float("inf"), 1.0])]
    assert order(found(spark, rows)) == order(brute(rows))
    for name in ("GROUP", "BLOCK"):
        monkeypatch.setattr(topk_search, name, 7)
    monkeypatch.setattr(topk_search, "TILE", 2)
    assert order(found(spark, rows)) == order(brute(rows))


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e300, -1e17]), (1, [1e300, 3.0]), (2, [-1e300, 1.0]), (3, [0.5, 1e17]), (4, [1e-3, 0.0]), (5, [3e9, 3e9]), (20, [2e9, -4.0])]
    assert order(found(spark, rows)) == order(brute(rows))


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert order(found(spark, [(0, [1.0]), (2, [1.0])])) == [(0, 1, 2, 4096)]
