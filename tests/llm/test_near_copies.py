"""Near copies against all pairs by Jaccard similarity."""

import random

from llm_data import EDGES, docs_of, words  # noqa: F401

import corpus_pipeline
from veilframe.llm.near_copies import without_similar
from veilframe.llm.simhash import fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    key = lambda p: (p[0] is None, p[0] or 0)
    least = {}
    for p, g in zip(pairs, group):
        least[g] = min(least.get(g, p), p, key=key)
    return sorted(least.values(), key=str)


def test_edited_copies_are_found(spark, docs_of):
    r = random.Random(4)
    pairs, far = [(100, "one two"), (101, "ONE  two"), (102, "one")], 0
    for k in range(12):
        base = words(r, r.randint(40, 300)).split(" ")
        pairs.append((1000 * k + 200, " ".join(base)))
        for j in range(8):
            new = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 30))):
                new[r.randrange(len(new))] = words(r, 1) + "x"
            pairs.append((1000 * k + 201 + j, " ".join(new)))
            far += (fingerprint(pairs[-1][1]) ^ fingerprint(" ".join(base))).bit_count() > 3
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_copy_stage(spark, docs_of(pairs), "").collect()), key=str)
    assert got == brute(pairs) and len(got) < len(pairs) - 50 and far > 30


def test_edges(docs_of):
    got = without_similar(docs_of(EDGES)).collect()
    assert len(got) == len(brute(EDGES))
    assert without_similar(docs_of([])).count() == 0
