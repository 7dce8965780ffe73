import random

from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.line_dedup import MIN_WORDS, dedup_lines, extended, selected


def n_words(line):
    return len(line.split())


def brute(pairs, least):
    """Every run of every document against every earlier place."""
    order = sorted(set(pairs), key=lambda p: (p[0] is None, p[0] or 0))
    seen, cut = set(), {}
    for pair in order:
        lines = (pair[1] or "").split("\n")
        full = [i for i, x in enumerate(lines) if n_words(x)]
        runs, gone = [], set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(lines[i] for i in full[a : b + 1])
                if sum(map(n_words, run)) >= least:
                    runs.append((a, run, full[a], full[b]))
        for _, run, first, last in sorted(runs, key=lambda x: x[0]):
            if run in seen:
                gone.update(range(first, last + 1))
            seen.add(run)
        cut[pair] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if pair[1] is not None else None
    return cut


def test_matches_brute_force(docs_of):
    r = random.Random(3)
    shared = [[words(r, r.choice([2, 5, 9, 20, 60])) for _ in range(r.randint(1, 8))] for _ in range(12)]
    pairs = list(EDGES)
    for k in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            lines += r.choice(shared) if r.random() < 0.6 else [words(r, r.randint(1, 30))]
            if r.random() < 0.2:
                lines.append(r.choice(["", " "]))
        pairs.append((100 + k, "\n".join(lines)))
    pairs.append((300, "\n".join(["again and again"] * 60)))
    pairs.append(pairs[-1])
    want = brute(pairs, 50)
    docs = docs_of(pairs)
    out = dedup_lines(docs)
    assert out.columns == docs.columns[:-2] + ["h1", "n_lines_removed"]
    rows = out.collect()
    by_id = {(r.doc_id): r.text for r in rows if r.doc_id is not None and r.doc_id >= 100}
    assert by_id == {p[0]: t for p, t in want.items() if p[0] is not None and p[0] >= 100}
    assert len(rows) == len(pairs)
    assert sum(t != p[1] for p, t in want.items()) > 20
    edges = sorted((r.text is None, r.text or "", r.n_lines_removed) for r in rows if r.doc_id is None or r.doc_id < 100)
    assert edges == sorted((t is None, t or "", 0) for _, t in EDGES)


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_few_positions_are_kept_and_only_shared_ones_extended(spark, docs_of):
    r = random.Random(8)
    passage = [words(r, 6) for _ in range(40)]
    pairs = [(k, "\n".join(words(r, 6) for _ in range(200))) for k in range(20)]
    pairs += [(100, "\n".join([words(r, 6)] + passage)), (101, "\n".join(passage + [words(r, 6)]))]
    docs = docs_of(pairs)
    lines = selected(docs, "doc_id", "text", MIN_WORDS).cache()
    n, kept = lines.count(), lines.where("new").count()
    assert n / 8 < kept < n / 3  # 2 of 10 lines on average, as windows have nine
    marks = lines.where("new").groupBy("mark").count().where("count > 1").select("mark")
    stretches = extended(lines, marks, MIN_WORDS).collect()
    assert {x.id for x in stretches} == {100, 101} and len(stretches) < 150
    out = {x.doc_id: x for x in dedup_lines(docs).collect()}
    assert out[101].n_lines_removed == 40 and sum(x.n_lines_removed for x in out.values()) == 40


def test_very_long_text(docs_of):
    r = random.Random(9)
    lines = [words(r, 4) for _ in range(20000)]
    passage = [words(r, 4) for _ in range(30)]
    long = lines[:9000] + passage + lines[9000:]
    out = {x.doc_id: x for x in dedup_lines(docs_of([(1, "\n".join(passage)), (2, "\n".join(long)), (3, "word " * 300000)])).collect()}
    assert out[2].text == "\n".join(lines) and out[2].n_lines_removed == 30
    assert out[1].n_lines_removed == out[3].n_lines_removed == 0
