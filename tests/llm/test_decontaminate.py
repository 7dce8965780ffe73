import random

from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.decontaminate import Myers, contaminated, without_contaminated


def normal(text):
    out = "".join(c if c.isalnum() else " " for c in (text or "").lower())
    return " " + " ".join(out.split()) + " "


def least(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def spoilt(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + 1] = r.choice([[], [r.choice("xyz")], [t[i], "q"]])
    return "".join(t)


def test_myers_distances():
    r = random.Random(1)
    for _ in range(60):
        p, t = ("".join(r.choice("ab ") for _ in range(r.randint(1, n))) for n in (80, 120))
        assert min([len(p), *Myers(p).distances(t)]) == least(p, t)
        assert list(Myers(p).distances(t, anchored=True))[-1] == full(p, t)


def test_matches_brute_force(spark, docs_of):
    r = random.Random(2)
    items = [(k, words(r, r.randint(5, 40)).capitalize() + ".") for k in range(8)] + [(50, "Yes!"), (51, None), (52, " ."), (None, words(r, 30))]
    pairs = list(EDGES)
    for k in range(40):
        item = r.choice(items[:9])[1]
        pairs.append((100 + k, words(r, 20) + "\n" + spoilt(r, item, r.choice([0, 1, 3, 8, 20])).upper() + ", " + words(r, 30)))
    pairs += [(300, items[-1][1]), (301, "yes"), (302, "eyes")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "0 AS distance", "1 AS item")
    docs = docs_of(pairs)
    want = []
    for doc_id, text in pairs:
        for item_id, item in items:
            p = normal(item)
            if len(p) > 2 and (d := least(p, normal(text))) <= int(0.08 * len(p)):
                want.append((doc_id, item_id, d))
    for bound in (1_000_000, 500):
        rows = contaminated(docs, benchmark, max_block_chars=bound).collect()
        assert sorted((r.doc_id, r.item_id or -1, r.distance) for r in rows) == sorted((a, b or -1, d) for a, b, d in want)
        texts = dict(pairs)
        for row in rows:
            assert full(normal(dict(items)[row.item_id]), normal(texts[row.doc_id])[row.start : row.end]) == row.distance
        clean = without_contaminated(docs, benchmark, max_block_chars=bound)
        assert clean.columns == docs.columns
        bad = {w[0] for w in want}
        assert sorted(x.doc_id or -1 for x in clean.collect()) == sorted(p[0] or -1 for p in pairs if p[0] not in bad)
    assert len({w[0] for w in want}) > 15


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(docs_of(EDGES), none).count() == 0
    assert without_contaminated(docs_of(EDGES), none).count() == len(EDGES)
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contaminated(docs_of([]), some).count() == 0


def test_repeated_and_long_items(spark, docs_of):
    r = random.Random(6)
    same, long = words(r, 10), words(r, 60)
    benchmark = spark.createDataFrame([*((k, same) for k in range(30)), (50, long), (51, "other one")], "item_id bigint, text string")
    docs = docs_of([(1, words(r, 20) + " " + same), (2, long), (3, words(r, 30))])
    bound = len(same) + 40
    rows = contaminated(docs, benchmark, max_block_chars=bound).collect()
    assert sorted((x.doc_id, x.item_id) for x in rows) == [*((1, k) for k in range(30)), (2, 50)]
    assert [x.doc_id for x in without_contaminated(docs, benchmark, max_block_chars=bound).collect()] == [3]
