import random
import re

from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.quality_rules import STOP_WORDS, quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = list(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    n_dup = len(lines) - len(set(lines))
    stop = sum(x.lower() in STOP_WORDS.split() for x in w)
    base_failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    chars = sum(map(len, w))
    bad = base_failed or not 2 <= chars / len(w) <= 12 or n_symbols / len(w) > 0.1 or stop / len(w) < 0.04
    bad = bad or n_dup / len(lines) > 0.4 or text.count("!") / len(w) > 0.2
    return len(w), chars, n_symbols, n_dup, len(covered), base_failed, not bad


def test_matches_brute_force(docs_of):
    r = random.Random(7)
    pairs = list(EDGES)
    for k in range(80):
        few = [words(r, 1) for _ in range(r.choice([2, 5, 12, 40]))]
        text = " ".join(r.choice(few) for _ in range(r.randint(1, 300)))
        pairs.append((100 + k, text))
        lines = [words(r, r.randint(1, 9)) for _ in range(5)]
        pairs.append((200 + k, "\n".join(r.choice([*lines, "", " \t"]) for _ in range(r.randint(1, 40))) + r.choice(["", " ###"])))
    pairs += [(300, words(r, 4000)), (301, words(r, 200)), (302, "of the " * 40), (303, "! " * 60), (304, words(r, 60) + " <|>" * 20)]
    # More than a few repeated triples: the other way of finding their places.
    pairs.append((305, words(r, 60) + " x " + " ".join([words(random.Random(1), 100)] * 3)))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = quality_rules(docs_of(pairs)).select("doc_id", *columns).collect()
    assert sorted((tuple(x) for x in rows), key=str) == sorted(((i, *brute(t)) for i, t in pairs), key=str)
    assert sum(x.kept for x in rows) > 5


def test_columns_of_the_input_may_clash(docs_of):
    docs = docs_of(EDGES)
    assert quality_rules(docs, keep=["doc_id", "lang"]).columns[:3] == ["doc_id", "lang", "n_words"]
    assert quality_rules(docs_of([])).count() == 0
