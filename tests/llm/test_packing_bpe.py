import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelflow.llm import bpe, packing
from llm_fixtures import odd_rows, table  # noqa: F401 - fixtures

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a  b\t\tc  x\x1cy\x1dz \x85 q", "ΑΣ ΣΑΣ İstanbul ſ é é ﬁ ①②٣ it's we'll I'D 'S",
       "a<|endoftext|>b <|startoftext|>c <|endoftext|> ", "日本語 テキスト 😀👩‍👧 z̷̢", "aaaa aaaaa aaaaaaa " * 5 + "-----====!!!!!???" * 9,
       "̸ ́a", "x​y­z﻿ ﷺ", "0123 12a3 ½ ²", "a" * 5000, "ab" * 700 + "\x01\x02"]


def test_proposals_checked_equal_library():
    coder, library = bpe.SpeculativeBpe(WORD), Tokenizer.from_file(WORD)
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(chr(c) for c in rng.choice([*range(32, 127), 0x130, 0x301, 0x3a3, 0x2028, 0xe9, 0x4e00], 40)) for _ in range(300)]
    for text, (n, ids, decoded) in zip(texts, coder.encode_texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_compatible_pairs_decide_like_merging():
    coder = bpe.SpeculativeBpe(WORD)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(1, 15))) for _ in range(3000)]
    got = coder.encode_words(words)
    assert got == [coder.exact([*w[:-1], w[-1] + bpe.WORD_END]) for w in words]
    failing = [w for w in words if coder.propose(w) != coder.exact([*w[:-1], w[-1] + bpe.WORD_END])]
    assert 0 < len(failing) < len(words)  # both ways are taken


def test_encode_table(table, odd_rows):
    library = Tokenizer.from_file(WORD)
    want = sorted((d if d is not None else -1, library.encode(t or "", add_special_tokens=False).ids) for d, t in odd_rows)
    got = bpe.encode(table(odd_rows), WORD).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got) == want
    digests = {(r.doc_id, r.ids_sha256) for r in bpe.encode_digests(table(odd_rows), WORD).collect()}
    assert (4, hashlib.sha256(" ".join(map(str, library.encode("one", add_special_tokens=False).ids)).encode()).hexdigest()) in digests
    assert bpe.encode_digests(table([]), WORD).count() == 0


def checked(rows, pieces):
    library = Tokenizer.from_file(BYTE)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    assert set(ids) == set(by_doc)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and all(p.sequence_tokens == at for p in own)
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_every_id_in_one_piece(table, odd_rows):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)] + [(100 + i, t) for i, t in enumerate(ODD)]
    assert checked(rows, packing.pack(table(rows), BYTE).collect()) == 0
    assert packing.pack(table([]), BYTE).count() == 0


def test_repeated_rows_are_packed_again(table):
    got = packing.pack(table([(1, "same"), (1, "same"), (None, "x")]), BYTE).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_level_choice_minimises_sum_of_squares(n):
    rng = np.random.default_rng(n)
    packer = packing.Packer(0, window=64)
    for i in range(n):
        r = int(rng.integers(1, 64))
        count = packer.count.copy()
        best = min((sum(c * c for c in after(count, h, r)), h) for h in range(0, 64 - r + 1) if h == 0 or count[h])
        h = packer.level_for(r)
        assert sum(c * c for c in after(count, h, r)) == best[0]
        packer.add(i, np.full(r, i % 65536, np.uint16))
    packer.finish()
    assert sum(p[2] for p in packer.out) and not packer.open


def after(count, h, r):
    c = count.copy()
    if h:
        c[h] -= 1
    if h + r < 64:
        c[h + r] += 1
    return c.tolist()
