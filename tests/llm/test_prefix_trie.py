import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veilframe.llm import prefix_trie as module
from veilframe.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, n_convs string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        convs[c] = (*own.get(base, [])[:h], *own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        leaves = sum(b[0] for b in below) if below else 1
        saved = sum(b[1] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        totals[node] = (leaves, saved)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if convs[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, band=module.BAND):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return [tuple(x) for x in prefix_trie(df, band).collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["a", "b", "", None, "é\U0001f600", "long " * 400]
    out = [(c, t, r.choice(["user", "assistant", None]), r.choice(words)) for c in range(0, 230, 3) for t in range(r.randint(0, 7))]
    out += [(c, t, "user", "same") for c in range(400, 480) for t in range(3)]  # copies
    out += [(500, t, "user", f"{t % 7}") for t in range(120)] + [(501, t, "user", f"{t % 7}") for t in range(150)]  # long ones
    out += [(-5, 1, "user", "x"), (-100, 1, "user", "y"), (None, 1, "user", "z"), (777, None, "user", "first"), (777, 0, "user", "second")]
    out += [(888, None, None, None)] * 3 + [(901, 0, "ab", "c"), (903, 0, "a", "bc")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("band", [2, 16])
def test_brute_force(spark, rows, band):
    assert order(found(spark, rows, band)) == order(brute(rows))


def test_node_of_many_ends_is_hashed_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 64)
    assert order(found(spark, rows)) == order(brute(rows))


def test_without_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation(spark):
    # 1 keeps what stands after its first h turns, of which it has none, and there is no conversation 0.
    assert zlib.crc32(b"1") % 6 >= 1
    assert found(spark, [(1, 0, "user", "x")]) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
