"""BPE, packing and token files against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from fixtures import awkward_rows, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import bpe, dac, packing
from scorelake.llm.common import TextEncoder
from scorelake.llm.queries import vocabulary
from scorelake.session import scratch_path

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def word():
    return bpe.PrefixBPE(WORD), TextEncoder(WORD), library(WORD)


@pytest.fixture(scope="module")
def byte():
    return TextEncoder(BYTE), library(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from("  \n'stremdl,.<|>Σİœ日"))))
def test_encoders_equal_the_library(word, byte, text):
    expected = packed(word[2].encode(text, add_special_tokens=False).ids)
    assert word[0].encode(text) == expected == word[1].encode(text)
    assert byte[0].encode(text) == packed(byte[1].encode(text, add_special_tokens=False).ids)


def test_special_tokens_are_found_inside_text(word, byte):
    for text in ("a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> x", "a <|endoftext|>\n"):
        assert word[0].encode(text) == packed(word[2].encode(text, add_special_tokens=False).ids)
        assert byte[0].encode(text) == packed(byte[1].encode(text, add_special_tokens=False).ids)


def test_pieces_are_encoded_by_the_model_alone(word, byte):
    texts = ["It's ONE día,  <|ENDOFTEXT|> a\x1c\xa0\xad¿ not \t12 's ''re\n\n", "naïve ­ÿ×!", "日 Abc's, 日"]
    for path, whole in ((WORD, word[2]), (BYTE, byte[1])):
        encoder = TextEncoder(path)
        seen = []

        class Counted:
            def encode(self, chunk, whole=whole, seen=seen, **options):
                seen.append(chunk)
                return whole.encode(chunk, **options)

        encoder.library = Counted()
        for text in texts:
            assert encoder.encode(text) == packed(whole.encode(text, add_special_tokens=False).ids)
        # Only of the last text, which has letters beyond.
        assert seen and all(chunk.strip() in texts[2].split() for chunk in seen)


def test_random_letter_strings(word):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aeinorstthl") for _ in range(rng.randint(1, 60)))
        assert word[0].encode(text) == packed(word[2].encode(text, add_special_tokens=False).ids)


def test_encode_and_decode_documents(spark, word):
    rows = bpe.digest_documents(documents(spark), WORD).collect()
    expected = []
    for doc_id, text, _ in awkward_rows():
        ids = word[2].encode(text or "", add_special_tokens=False).ids
        decoded = word[2].decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    whole = bpe.encode_documents(documents(spark), WORD).where("doc_id = 9").first()
    assert whole.decoded == word[2].decode(list(struct.unpack(f"<{whole.n_tokens}I", whole.ids)), skip_special_tokens=False)


@pytest.mark.parametrize("length", [16, 4096])
def test_packing_holds_each_id_once(spark, word, length):
    docs = documents(spark).where("doc_id is not null and doc_id <> 3")
    pieces = packing.pack(docs, WORD, end_id=2, length=length).collect()
    texts = {d: t for d, t, _ in awkward_rows()}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    assert by_doc.keys() == {r.doc_id for r in docs.select("doc_id").collect()}
    for doc_id, own in by_doc.items():
        ids = packed([*word[2].encode(texts[doc_id] or "", add_special_tokens=False).ids, 2])
        own.sort(key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids and {p.doc_tokens for p in own} == {len(ids) // 4}
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for number, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == length or number == max(sequences)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), WORD, end_id=2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_segment_round_trip_and_random_access(ids):
    segment = dac.Segment(dac.pack_segment(np.array(ids, dtype=np.uint32)))
    assert segment.ids().tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 40)):
        assert segment[i] == ids[i]


def test_token_files(spark, byte):
    docs = documents(spark).where("doc_id is not null and doc_id <> 3")
    out = scratch_path(spark, "tokens")
    dac.write_token_files(docs, out, BYTE, end_id=0, segment_tokens=500)
    assert spark.read.parquet(out).count() > 2
    rows = {r.doc_id: r for r in dac.read_token_files(spark, out).collect()}
    digests = {r.doc_id: r.ids_crc32 for r in dac.digest_token_files(spark, out).collect()}
    start = 0
    for doc_id, text, _ in sorted((r for r in awkward_rows() if r[0] not in (None, 3)), key=lambda r: r[0]):
        ids = packed([*byte[1].encode(text or "", add_special_tokens=False).ids, 0])
        assert (rows[doc_id].start, bytes(rows[doc_id].ids), digests[doc_id]) == (start, ids, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_files_of_nulls_repeats_and_nothing(spark):
    out = scratch_path(spark, "tokens")
    dac.write_token_files(documents(spark), out, BYTE, end_id=0)
    rows = dac.digest_token_files(spark, out).orderBy("start").collect()
    assert len(rows) == len(awkward_rows()) and rows[0].doc_id is None
    assert [r.start for r in rows] == [sum(q.n_tokens for q in rows[:i]) for i in range(len(rows))]
    out = scratch_path(spark, "tokens")
    dac.write_token_files(documents(spark, []), out, BYTE, end_id=0)
    assert dac.digest_token_files(spark, out).count() == 0
