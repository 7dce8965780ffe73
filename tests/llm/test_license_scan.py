import random
import re

import pytest
from llm_data import EDGES, docs_of  # noqa: F401

from veilframe.llm.license_scan import THRESHOLD, compiled, scan_licenses
from veilframe.llm.license_templates import APACHE_HEADER, GPL3_HEADER, MIT, TEMPLATES


def pairs(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return set(zip(w, w[1:]))


def brute(text):
    if text is None:
        return []
    lines, paragraphs = text.split("\n"), re.split(r"\n(?:[ \t\r\x0b\f]*\n)+", text)
    passages = [("line", i, x) for i, x in enumerate(lines)]
    passages += [("paragraph", i, x) for i, x in enumerate(paragraphs)] if len(paragraphs) > 1 else []
    passages += [("text", 0, text)] if len(lines) > 1 else []
    out = []
    for kind, no, x in passages:
        a = pairs(x)
        for k, (license_, template) in enumerate(TEMPLATES):
            b = pairs(template)
            dice = round(2 * len(a & b) / (len(a) + len(b)), 6)
            if dice >= THRESHOLD:
                out.append((kind, no, k, license_, dice))
    words = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    for k, (t, (license_, template)) in enumerate(zip(compiled(TEMPLATES, THRESHOLD), TEMPLATES)):
        own, b, best = [x for x in re.split(r"[\W_]+", template.lower()) if x], pairs(template), None
        if any(x[2] == k for x in out):
            continue
        for start in {max(i - o, 0) for i, w in enumerate(words) if w in t.markers for o, v in enumerate(own) if v == w}:
            run = words[start : start + len(own)]
            a = set(zip(run, run[1:]))
            dice = round(2 * len(a & b) / (len(a) + len(b)), 6)
            if dice >= THRESHOLD:
                best = max(best or (0, 0), (dice, -start))
        if best:
            out.append(("run", -best[1], k, license_, best[0]))
    return sorted(out)


@pytest.fixture
def texts():
    r = random.Random(8)
    out = list(EDGES)
    for k in range(120):
        words = r.choice(TEMPLATES)[1].split(" ")
        for _ in range(r.randint(0, max(1, len(words) // 5))):
            words[r.randrange(len(words))] = r.choice(["foo", "the", "license", "copyright 2020"])
        head = r.choice(["", "Some text.\n", "Some text.\n\n", "a\n \t\n"])
        out.append((100 + k, head + " ".join(words) + r.choice(["", "\nmore", "\n\nmore of it"])))
    return [*out, (300, APACHE_HEADER + "\n\n" + MIT), (301, "MIT\n\n" + MIT.replace(" ", "\t"))]


def test_matches_brute_force(docs_of, texts):
    rows = scan_licenses(docs_of(texts)).collect()
    got = sorted(((r.doc_id or -1, [tuple(m) for m in r.matches], r.licenses, r.n_matches, r.best_dice) for r in rows), key=str)
    want = []
    for doc_id, text in texts:
        m = brute(text)
        want.append((doc_id or -1, m, ",".join(sorted({x[3] for x in m})), len(m), max((x[4] for x in m), default=None)))
    assert got == sorted(want, key=str)
    assert sum(bool(w[1]) for w in want) > 60


def test_notices_inside_files(docs_of):
    wrapped = lambda t, sign: "\n".join(sign + x for x in t.split("\n"))
    bsd = {k: t for k, t in TEMPLATES if k.startswith("BSD") and len(t) > 500}
    texts = [
        "#!/usr/bin/env python\nimport os\n\n" + MIT.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE") + "\n\ndef f():\n    pass\n" * 40,
        "/*\n" + wrapped(APACHE_HEADER, " * ") + "\n */\npackage a;\nclass B {}\n" * 3,
        wrapped(GPL3_HEADER, "# ") + "\nimport sys\n" + "x = 1\n" * 500,
        "Copyright 2020 Ann Lee. Released under the MIT License. See LICENSE for details.",
        "Copyright (c) 2019, Someone\n" + wrapped(bsd["BSD-2-Clause"], "") + "\nint main() {}",
        "// " + bsd["BSD-3-Clause"].replace("3. Neither", "\n//\n// 3. Neither") + "\nint main() {}",
        "Permission is hereby a word, software is another, and license a third. " * 2000,
    ]
    got = {r.doc_id: r.licenses for r in scan_licenses(docs_of(list(enumerate(texts)))).collect()}
    names = ["MIT", "Apache-2.0", "GPL-3.0", "MIT", "BSD-2-Clause", "BSD-3-Clause"]
    assert all(n in got[i].split(",") for i, n in enumerate(names)) and got[6] == ""


def test_bounds_keep_every_match():
    for t in compiled(TEMPLATES, THRESHOLD):
        without = [b for b in t.bigrams if not set(b.split()) & set(t.markers)]
        assert len(without) < t.least <= len(t.bigrams) <= t.most


def test_empty_table(docs_of):
    assert scan_licenses(docs_of([])).count() == 0
