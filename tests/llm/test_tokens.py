"""Operators 3 and 9 against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolens.llm import binfmt, packing
from repolens.llm.queries import packing_digests
from repolens.llm.tokens import Encoder

from . import brute

ODD = ["", "a", "  a  b\n\n c\t d 'tis don't's \x01 x\x01 <|endoftext|> a, b. ...", ",", ". a.", "\n", "a\n", "\na", "Σας. ΑΣ, é́ ́x",
       "a\x85b  c", "x,.", "1,2. 3.", "don't, it's. 's,", "İstanbul ǅ, Straße.", "日本語 テキスト。", "a b　c", "tab\tsep\r\nline", "ﬁne ﬂag"]


def reference(name, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, rows):
    enc, ref = Encoder(name), reference(name, 0)
    for text in [*ODD, *(t for _, t in rows if t)]:
        assert enc.encode([text])[0] == ref(text)[:-1].tobytes(), text[:60]


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_bit_plane_files(spark, frame, scratch, request, which):
    pairs, ref = request.getfixturevalue(which), reference(binfmt.TOKENIZER, 1)
    binfmt.write(frame(pairs), f"{scratch}/ids", parts=3)
    at, want = 0, []
    for doc, text in brute.ordered(pairs):
        ids = ref(text)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    out = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in binfmt.read_digests(spark, f"{scratch}/ids").collect()]
    assert sorted(out, key=lambda r: r[1]) == want
    assert spark.read.parquet(f"{scratch}/ids/index").agg({"n_ids": "sum"}).first()[0] == at


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2), (7, 50_000), (binfmt.BLOCK, 1 << 16), (1000, 1 << 20)):
        ids = rng.integers(0, top, n)
        bits = max(1, int(ids.max()).bit_length())
        assert (binfmt.from_planes(binfmt.to_planes(ids, bits), n) == ids).all()


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_packing(frame, request, which):
    pairs, ref = request.getfixturevalue(which), reference(packing.TOKENIZER, 0)
    pieces = packing_digests(frame(pairs)).collect()
    want = {}
    for doc, text in pairs:
        want.setdefault(doc, []).append(ref(text))
    spent, filled = {}, {}
    for p in pieces:
        spent.setdefault((p.doc_id, p.doc_tokens), 0)
        spent[p.doc_id, p.doc_tokens] += p.length
        assert any(p.ids_crc32 == zlib.crc32(x[p.start:p.start + p.length].tobytes()) for x in want[p.doc_id] if len(x) == p.doc_tokens)
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = {}
    for doc, each in want.items():
        for x in each:
            total[doc, len(x)] = total.get((doc, len(x)), 0) + len(x)
    assert spent == total
    for k, spans in filled.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or k == max(filled)
    assert sorted(filled) == list(range(len(filled)))


def test_like_documents_lie_together():
    """Neighbours on the curve: ids of one half of the vocabulary and of the
    other do not mix."""
    rng, table = np.random.default_rng(1), packing.signs(np.arange(1000))
    ids = np.concatenate([rng.choice(20, 300) + (500 if k % 2 else 0) for k in range(40)])
    keys = packing.curve_keys(ids, np.arange(0, len(ids), 300), table)
    order = np.argsort(keys) % 2
    assert (order[1:] != order[:-1]).sum() <= 4


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_empty_tables(spark, frame, scratch):
    empty = frame([]).limit(0)
    assert packing.pack(empty).count() == 0
    binfmt.write(empty, f"{scratch}/none", parts=2)
    assert binfmt.read_digests(spark, f"{scratch}/none").count() == 0
