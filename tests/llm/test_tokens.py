import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from llm_data import EDGES, docs_of, words  # noqa: F401
from tokenizers import Tokenizer

from veilframe.llm.packing import CAPACITY, OpenSequences, pack_documents, packed_sequences
from veilframe.llm.token_counts import token_counts
from veilframe.llm.tokens import PieceCounts, WordIds

PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", ".", ",", "!!", "'s", "'", "É", "ß", "İ", "Σ", "\x1c", "\x85", "\xa0", "<|endoftext|>"]
PARTS += ["<|ENDOFTEXT|>", "</w>", "<s>", "<unk>", "▁", "1", "23", "_", "é", "中文", "😀", "\x00", "​", "<0x0A>", "\r\n", "|", "%%%", "Ⅷ"]


def odd_texts(n=3000):
    r = random.Random(4)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "\n", " \n ", words(r, 5000)]


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), odd_texts()
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert WordIds(path).encode(texts) == want


def test_piece_counts_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, texts = sentencepiece.SentencePieceProcessor(model_file=path), odd_texts()
    assert PieceCounts(path).count(texts) == [len(library.encode(t)) for t in texts]


def test_token_counts(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pairs = [*EDGES, *enumerate(odd_texts(100), 1000)]
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in pairs]
    for rows in (50_000, 3):
        got = [tuple(r) for r in token_counts(docs_of(pairs), table_rows=rows).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(docs_of([])).count() == 0


def test_packing_is_an_exact_round_trip(docs_of):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(6)
    pairs = [*EDGES, *((1000 + k, words(r, r.choice([3, 50, 200, 500, 3000]))) for k in range(120))]
    docs = docs_of(pairs)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in pairs}
    rows = pack_documents(docs).collect()
    filled = defaultdict(list)
    pieces = defaultdict(set)
    for x in rows:
        filled[x.sequence_id].append((x.offset, x.length))
        if x.doc_id is not None and x.doc_id != 10:
            part = ids[x.doc_id][x.start : x.start + x.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == x.ids_crc32
            pieces[x.doc_id].add((x.piece, x.start, x.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    for doc_id, got in pieces.items():
        n = len(ids[doc_id])
        assert got == {(k, a, min(CAPACITY, n - a)) for k, a in enumerate(range(0, n, CAPACITY))}
    total = sum(x.length for x in rows)
    assert total == sum(len(ids[i]) if i not in (None,) else len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in pairs)
    assert len(filled) <= 1.02 * (total // CAPACITY + 1) + 1
    for s in packed_sequences(docs).collect():
        assert len(s.ids) == 4 * s.n_ids and s.n_ids == sum(p.length for p in s.parts)
    assert pack_documents(docs_of([])).count() == 0


def test_rule_takes_the_least_sum_of_squares():
    r = random.Random(9)
    packed, gaps = OpenSequences(20), []
    for _ in range(400):
        length = r.randint(1, 20)
        squares = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
        choices = [squares([*gaps, 20 - length])]
        choices += [squares([*gaps[:i], g - length, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= length]
        _, offset = packed.place(length)
        if offset:
            gaps.remove(20 - offset)
        gaps.append(20 - offset - length)
        assert squares(gaps) == min(choices)
