"""Token alignment against a direct loop over bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward_rows, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import alignment
from scorelake.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
MORE = [
    (20, "日本語 ①② x", "en"), (21, "▁x a▁ b", "en"), (22, "  two  spaces ", "en"), (23, "a <s> </s> <unk> <0x41> <|endoftext|>", "en"),
    (24, "é ﬁ   　z\x00\x1c q", "en"), (25, "\U0001f600\U0001f468‍\U0001f469", "en"), (26, " ", "en"), (27, "\n", "en"),
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def byte_tokens(libraries, text):
    """(id, bytes) of both sides straight from the vocabularies; None where they don't spell the text."""
    a, b = libraries
    to_byte = alignment._byte_level()
    encoded = a.encode(" " + text, add_special_tokens=False)
    side_a = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]
    side_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        side_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    ok = all(b"".join(t for _, t in side) == whole for side in (side_a, side_b))
    return (side_a, side_b) if text and ok else None


def direct(libraries, texts):
    """Per text: counts, groups and links, by comparing every pair of byte ranges in a group."""
    out = []
    for text in texts:
        found = byte_tokens(libraries, text or "")
        if not found:
            out.append((0, 0, 0, [], ""))
            continue
        ranges = []
        for side in found:
            ends = np.cumsum([len(t) for _, t in side]).tolist()
            ranges.append([(i, s, e) for (i, _), s, e in zip(side, [0, *ends[:-1]], ends, strict=True)])
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups, links, start = [], [], 0
        for cut in cuts:
            inside = [[r for r in side if r[1] >= start and r[2] <= cut] for side in ranges]
            groups.append("|".join(",".join(str(r[0]) for r in side) for side in inside))
            links += [(x[0], y[0]) for x in inside[0] for y in inside[1] if x[1] < y[2] and y[1] < x[2]]
            start = cut
        out.append((len(ranges[0]), len(ranges[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def expected(libraries, rows):
    found = direct(libraries, [t for _, t, *_ in rows])
    counts = Counter(p for *_, links, _ in found for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (r[0], n_a, n_b, groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for r, (n_a, n_b, groups, links, sha) in zip(rows, found, strict=True)
    ]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\tab.'1é日①▁\x1c"))))
def test_chunks_equal_whole_texts(libraries, own, text):
    (n_a, n_b, groups, links, sha), found = direct(libraries, [text])[0], own.digests([text])[0]
    assert (n_a, n_b, groups) == found[:3]
    pairs = np.frombuffer(found.links, dtype="<i8")
    assert sorted(links) == sorted((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs)
    assert sha == (hashlib.sha256(found.groups.encode()).hexdigest() if found.n_groups else "")


def test_the_memo_is_bounded(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_CHUNKS", 50)
    small = alignment.Aligner(A, B)
    for i in range(30):
        texts = [prose(i, 40), "x" * 500 + str(i), prose(i % 3, 40)]
        for text, found in zip(texts, small.digests(texts), strict=True):
            assert found[:3] == direct(libraries, [text])[0][:3]
    assert len(small.old) < 50 + 120 and len(small.young) < 50 + 120 and not any(len(c) > 64 for c in small.young)


@pytest.mark.parametrize("links", [alignment.BLOCK_LINKS, 40])
def test_link_statistics_equal_the_direct_loop(spark, libraries, monkeypatch, links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    rows = [*awkward_rows(), *MORE, *[(100 + i, prose(i, 60), "en") for i in range(40)]]
    found = alignment.link_statistics(documents(spark, rows).repartition(3), A, B)
    assert ordered(found.collect()) == ordered(expected(libraries, rows))


def test_no_rows(spark):
    assert alignment.link_statistics(documents(spark, []), A, B).collect() == []
    assert alignment.align_documents(documents(spark, []), A, B).collect() == []


def test_spans_of_documents(spark, libraries):
    rows = [*awkward_rows(), *MORE]
    found = alignment.align_documents(documents(spark, rows), A, B).collect()
    assert len(found) == len(rows)
    for r in found:
        tokens = byte_tokens(libraries, r.doc.text or "")
        assert r.fits == (tokens is not None or not r.doc.text)
        whole = (" " + (r.doc.text or "")).encode()
        for side, spans in zip(tokens or ([], []), (r.a, r.b), strict=True):
            assert [(s.id, whole[s.start : s.end]) for s in spans] == side
        ends = [{s.end for s in spans} for spans in (r.a, r.b)]
        assert r.cuts == sorted(ends[0] & ends[1])


def test_other_ids_and_aligned_whole_without_safe_cuts(spark, libraries, own, monkeypatch):
    docs = documents(spark).selectExpr("cast(doc_id as string) as name", "text as body")
    found = alignment.link_statistics(docs, A, B, id_col="name", text_col="body")
    assert found.columns[0] == "name" and dict(found.dtypes)["name"] == "string"
    monkeypatch.setattr(own, "cuts_at_spaces", False)
    for _, text, _ in [*awkward_rows(), *MORE]:
        n_a, n_b, groups, links, _ = direct(libraries, [text])[0]
        found = own.digests([text or ""])[0]
        assert (n_a, n_b, groups, 8 * len(links)) == (*found[:3], len(found.links))
