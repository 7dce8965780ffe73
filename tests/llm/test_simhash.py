import random

import pytest
import xxhash
from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.simhash import links, simhash_components, without_near_copies


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    fp = [brute_fingerprint(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((p[0] for p, h in zip(pairs, group) if h == g and p[0] is not None), default=None) for g in group}
    return sorted(((p[0] is None, p[0] or 0), f"{f:016x}", least[g] or -1) for p, f, g in zip(pairs, fp, group))


@pytest.fixture
def pairs():
    r = random.Random(5)
    base = [words(r, 150) for _ in range(12)]
    out = list(EDGES)
    for k, text in enumerate(base):
        w = text.split(" ")
        for copy in range(8):
            v = list(w)
            for _ in range(copy % 4):
                v[r.randrange(len(v))] = r.choice("xyz")
            out.append((100 + 10 * k + copy, " ".join(v)))
    out += [(500 + k, "\n".join([base[0]] * 3)) for k in range(20)]
    return out


def test_components_match_brute_force(docs_of, pairs):
    rows = simhash_components(docs_of(pairs)).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in rows)
    assert got == brute_components(pairs)
    assert len({g[2] for g in got}) < len(pairs) - 40


def test_one_row_of_each_component_stays(docs_of, pairs):
    docs = docs_of(pairs)
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, _, c in brute_components(pairs)})


def test_empty_table(docs_of):
    assert simhash_components(docs_of([]).limit(0)).count() == 0
    assert without_near_copies(docs_of([])).count() == 0


def test_variants_are_not_broadcast(spark, tmp_path):
    """A table of fingerprints is small, their variants are 64 times as many."""
    spark.range(200).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fp")
    found = links(spark.read.parquet(f"{tmp_path}/fp").union(spark.createDataFrame([(0,), (7,), (1 << 40,)], "fp bigint")))
    assert sorted(map(tuple, found.collect())) == [(0, 7), (0, 1 << 40)]
    assert "Broadcast" not in found._jdf.queryExecution().toString()
