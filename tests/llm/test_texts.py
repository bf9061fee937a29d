"""Fingerprints, packing and word hashes, by brute force and round trip."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import pyarrow as pa
from orgsift.llm import textscan
from orgsift.llm.chunk_prints import (MAX_CHUNK, MIN_CHUNK, as_print, chunk_bounds, chunk_sets, containment, edited,
                                      fingerprints_with_next, from_print)
from orgsift.llm.packing import END_ID, Encoder, default_tokenizer, pack, pack_block, with_digests
from cases import TEXTS, awkward, none


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_do_not_depend_on_their_neighbours(texts):
    data, offsets = textscan.text_bytes(pa.array(texts, pa.string()))
    hashes, owner, starts, ends = textscan.words_of(data, offsets, textscan.NOT_SPACE)
    wanted = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().translate(None, b"").replace(b"\t", b" ").replace(b"\n", b" ")
              .replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    assert owner.tolist() == [i for i, _ in wanted]
    assert [int(h) for h in hashes] == [textscan.hash_of(w.decode()) for _, w in wanted]


def test_long_words_hash_alike_in_pieces():
    raw = np.frombuffer((b"abc " * 3000 + b"y" * 5000 + b" end"), np.uint8)
    starts, ends = textscan.word_bounds(raw, np.array([0, len(raw)]), textscan.NOT_SPACE)
    assert (textscan.word_hashes(raw, starts, ends, most=100) == textscan.word_hashes(raw, starts, ends)).all()


# ------------------------------------------------------------------ fingerprints

def slow_chunks(raw: bytes):
    """The cuts byte by byte."""
    out, a = [], 0
    from orgsift.llm import chunk_prints as c
    while a < len(raw):
        end = len(raw)
        for i in range(a + MIN_CHUNK - 1, min(len(raw), a + MAX_CHUNK)):
            h = 0
            for back in range(32):
                h = (h + (int(c._GEAR[raw[i - back]]) << back)) & 0xFFFFFFFF
            h = ((h * 0x9E3779B1) & 0xFFFFFFFF) >> 12
            mask = int(c.STRICT) if i + 1 - a < c.USUAL_CHUNK else int(c.LOOSE)
            if h & mask == 0 or i + 1 - a == MAX_CHUNK:
                end = i + 1
                break
        out.append((a, end))
        a = end
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_cuts_are_those_of_the_slow_way(texts):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    owner, begin, end = chunk_bounds(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert list(zip(owner, begin, end)) == [(i, a + offsets[i], b + offsets[i]) for i, x in enumerate(texts) for a, b in slow_chunks(x)]


def test_an_edit_moves_few_chunks():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    a, b, c = chunk_sets([text, text[:5000] + b"new words" + text[5000:], bytes(rng.integers(97, 123, 20_000).astype(np.uint8))])
    assert containment(a, b) > 0.97 and containment(a, c) < 0.01 and containment(a, a) == 1.0
    assert (from_print(as_print(a)) == a).all()
    assert containment(a[:0], a[:0]) == 1.0 and containment(a, a[:0]) == 0.0 == containment(a[:0], a)


@pytest.mark.parametrize("part_bytes", [200, 1 << 24])
def test_every_document_meets_the_next(spark, part_bytes):
    rows = [(d, t) for d, t, *_ in TEXTS if d is not None and d not in (10, 11, 14)] + [(100 + 3 * i, f"text number {i} " * (i % 9)) for i in range(60)]
    out = {r.doc_id: r for r in fingerprints_with_next(awkward(spark, [(d, t, None, None) for d, t in rows]), part_bytes).collect()}
    order = sorted(rows, reverse=True)
    assert len(out) == len(rows)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        changed = edited(t, following)
        a, b, c = chunk_sets([t.encode(), changed.encode(), following.encode()])
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_print(a), as_print(b))
        assert (r.near_edited, r.near_next) == (containment(a, b), containment(a, c))


def test_awkward_rows_of_fingerprints(spark):
    assert Counter(r.doc_id for r in fingerprints_with_next(awkward(spark), 4000).collect()) == Counter(d for d, *_ in TEXTS)
    assert fingerprints_with_next(none(spark)).collect() == []
    one = fingerprints_with_next(awkward(spark, TEXTS[:1])).first()
    assert one.near_next == 1.0


# ------------------------------------------------------------------ packing

@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="abÀà'sT.,! \n\t0\u0307İΣ", max_size=40)), max_size=5))
def test_ids_are_those_of_the_tokenizer(encoder, texts):
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [END_ID]


def test_special_tokens_are_those_of_the_file(encoder):
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(default_tokenizer())
    texts = ["end of page <|endoftext|> next", "a<|endoftext|>b.", "<|ENDOFTEXT|> <|EndOfText|>", "Up<|startoftext|><|endoftext|>\nX<|", "<|endoftext|>,", "<|a|>. <|A|>, I<| |>"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids + [END_ID], text
    assert encoder.encode([texts[0].encode()])[0].tolist() == [806, 539, 2504, 49407, 1131, END_ID]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9000), st.sampled_from([1, 8, 3000, 4095, 4096, 4097])), max_size=60), st.booleans())
def test_each_token_lies_in_one_place(lengths, same):
    lengths = lengths * 8 if same else lengths
    sequences = pack_block([np.zeros(n, "<u2") for n in lengths])
    seen = defaultdict(list)
    for s in sequences:
        assert 0 < sum(n for _, _, n in s) <= 4096
        for d, a, n in s:
            assert n > 0
            seen[d].append((a, n))
    for d, n in enumerate(lengths):
        assert sum(k for _, k in seen[d]) == n
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at
            at += k
    total = sum(lengths)
    sizes = [sum(n for _, _, n in s) for s in sequences]
    padding = sum(4096 - n for n in sizes if n & (n - 1))
    assert padding <= 0.01 * total + 256


def test_pieces_hold_the_documents(spark, encoder):
    rows = [(i, t) for i, (_, t, *_) in enumerate(TEXTS)]
    pieces = pack(awkward(spark, [(d, t, None, None) for d, t in rows]).coalesce(1), block_tokens=2000)
    found = pieces.collect()
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in with_digests(pieces).collect()}
    for d, t in rows:
        ids = encoder.encode([(t or '').encode()])[0]
        own = sorted((r.start, r.ids) for r in found if r.doc_id == d)
        assert np.concatenate([np.frombuffer(x, "<u4") for _, x in own]).tolist() == ids.tolist()
        for start, x in own:
            assert crc[d, start] == zlib.crc32(x)
    for r in found:
        assert r.length * 4 == len(r.ids) and r.doc_tokens == len(encoder.encode([(rows[r.doc_id][1] or '').encode()])[0])
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert Counter(r.doc_id for r in pack(awkward(spark)).collect() if r.start == 0) == Counter(d for d, *_ in TEXTS)
    assert pack(none(spark)).collect() == []


ODD = ["ABC<|ENDOFTEXT|>x", "don't we'll it's '' 's", "x" * 1000, "İstanbul ΣΑΣ ﬁ é Å", "a\tb\x0bc d e", "<|startoftext|><|endoftext|>", "  \n\n ",
       "a$$$$$$$ b!!! c., (x) [y] 12ab 3.14 x_y é$$$ ß. ǆ, Ǆ", "日本語 text。", "a̸ ≮ ≠.", "foó foo,́ A,b.C", "<| A<|B |> <|", "$$$ ... !!"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["word", "Word,", "é", "É!", "x1", "'s", "(", "$$$", "<|endoftext|>", "<|", " ", "\n", "\u0301", "ß.", "aa--", ";"]), max_size=8).map("".join), max_size=5))
def test_ids_are_those_of_a_fresh_tokenizer(texts):
    from tokenizers import Tokenizer
    texts = texts + ODD
    fresh = Tokenizer.from_file(default_tokenizer())
    encoder = Encoder(default_tokenizer())
    for _ in range(2):  # the second time from the tables
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [fresh.encode(t, add_special_tokens=False).ids + [END_ID] for t in texts]


def test_words_that_are_not_asked_for_are_forgotten(monkeypatch):
    from orgsift.llm import packing
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    encoder, plain = Encoder(default_tokenizer()), Encoder(default_tokenizer()).tokenizer
    for k in range(50):
        text = f"common word{chr(97 + k % 26)}{chr(97 + k // 26)}, and more"
        assert encoder.encode([text.encode()])[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [END_ID]
    assert len(encoder.known) + len(encoder.older) < 80
