import random
import re
from collections import Counter

import numpy as np
from llm_data import EDGES

from veilframe.llm.collocations import behind_of, collocations, suffixes, transform

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for x in range(len(p)):
            for y in range(x + 2, len(p) + 1):
                if y - x < len(p) and 100 * a >= 100 * candidates[lang, p[x:y]]:
                    gone.add((lang, p[x:y]))
    scored = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, ps in scored.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(ps)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def found(spark, rows, least=3, top=40, shard_words=50):
    df = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, n int, shard int")
    return sorted((tuple(x) for x in collocations(df, min_count=least, top=top, shard_words=shard_words).collect()), key=repr)


def texts(r, count):
    words = "new york the big apple of É é Ab ab \x00 a b x".split(" ")
    for _ in range(count):
        parts = []
        for _ in range(r.randint(0, 30)):
            parts.append("New York the big" if r.random() < 0.1 else r.choice(words))
            parts.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]))
        yield "".join(parts)


def test_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice(["en", "de", None, "und"]), t) for t in texts(r, 150)]
    rows += [("en", "copied all over the place again") for _ in range(60)] + [("xx", "ha " * 500), ("xx", "ha " * 3)]
    rows += [("en", None), ("en", ""), (None, None), ("yy", " .,;\n\t "), ("en", t := "a b c d e f g"), ("en", t), ("en", t)]
    rows += [("en", t) for _, t in EDGES]
    want = sorted(brute(rows, 3, 40), key=repr)
    assert found(spark, rows) == want and any(len(x[2].split()) == 5 for x in want)
    assert found(spark, rows, shard_words=1 << 20) == want


def test_long_text(spark):
    r = random.Random(6)
    long = " ".join(r.choice(["one", "two", "three", "four."]) for _ in range(30_000))
    whole = " ".join(r.choice(["in", "one", "piece"]) for _ in range(20_000))
    rows = [("en", long), ("en", whole)]
    assert found(spark, rows, 20, 2000, 1 << 10) == sorted(brute(rows, 20, 2000), key=repr)


def test_without_words(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), ("en", " .\n")]) == []


def test_suffix_order_and_steps():
    r = random.Random(7)
    for _ in range(100):
        ids = np.array([x for _ in range(r.randint(1, 12)) for x in [*(r.randint(1, 3) for _ in range(r.choice([1, 2, 5, 30]))), 0]], np.int64)
        ends = np.cumsum(ids == 0)
        order = suffixes(ids)
        assert list(order) == sorted(range(len(ids)), key=lambda p: [(int(ids[q]), int(ends[q]) * (ids[q] == 0)) for q in range(p, len(ids))])
        rank, behind = np.argsort(order), behind_of(transform(ids))
        assert all(behind[j] == rank[p + 1] for j, p in enumerate(order) if ids[p])
