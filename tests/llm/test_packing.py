"""Packing: every id in one piece, limits kept, nothing padded; ids equal to the library's."""
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lograil.llm import packing, toxicity
from lograil.llm.packing import Example, Limits, Packer, WordEncoder, pack_documents, pack_examples

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "  ", "The cat", "don't I'LL 12\u00b3 x", "\u0130stanbul \u0391\u03a3 \u00df \u01c4 <|endoftext|> y", "a\x1cb \x85 c", "\u65e5\u672c \u8a9e",
         "cafe\u0301 \u00e9\u00e8 \x00\x7f\u200b \u00bd", "word " * 9000, "<|startoftext|>", "\u212b \ufb01"]


def check(sequences, examples, limits):
    seen = {}
    for pieces in sequences:
        total = sum(stop - start for _, start, stop in pieces)
        assert 0 < total <= limits.tokens and total & (total - 1) == 0
        assert len(pieces) <= limits.segments and sum(e.lost(a, b) for e, a, b in pieces) <= limits.loss
        for e, a, b in pieces:
            seen.setdefault(id(e), []).append((a, b))
    for e in examples:
        at = 0
        for a, b in sorted(seen.get(id(e), [])):
            assert a == at < b
            at = b
        assert at == e.total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.booleans()), max_size=60), st.sampled_from([16, 64]), st.integers(1, 5), st.integers(1, 60), st.integers(1, 9))
def test_limits_hold_and_no_id_is_lost(lengths, tokens, segments, loss, held):
    rng = np.random.default_rng(len(lengths))
    examples = [Example(i, b"\0" * 4 * n, np.concatenate([[0], np.cumsum(rng.random(n) < 0.5)]) if mixed else None, silent=min(n, i % 3)) for i, (n, mixed) in enumerate(lengths)]
    limits = Limits(tokens, segments, loss, held)
    check(list(Packer(limits).pack(examples)), examples, limits)


def test_ids_are_the_librarys():
    library, encode = Tokenizer.from_file(PATH), WordEncoder(PATH, 2)
    for text in TEXTS * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_documents_and_their_pieces(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = pack_documents(docs, PATH, with_ids=True).collect()
    sequences = {}
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    library = Tokenizer.from_file(PATH)
    wanted = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in found) == wanted
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_instruction_examples(spark):
    rows = [(1, [5, 6, 7], [False, True, True]), (2, [], []), (3, None, None), (4, list(range(100)), None)]
    found = pack_examples(spark.createDataFrame(rows, "doc_id bigint, ids array<int>, loss array<boolean>"), Limits(64, 4, 32)).collect()
    assert sum(r.length for r in found) == 103 and {r.doc_id for r in found} == {1, 4}


def test_bad_limits():
    with pytest.raises(ValueError):
        Limits(tokens=100)


def test_a_worker_lets_go_of_the_words_when_it_classifies():
    held = weakref.ref(packing.encoder(PATH, 2))
    assert held() is packing.encoder(PATH, 2)
    toxicity.word_ids("a text of other work", 1 << 10)
    assert held() is None
