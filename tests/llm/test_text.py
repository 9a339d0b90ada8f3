"""Line runs, SpotSigs, main text, languages and personal data."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import awkward_rows, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import langid, linedup, pages, pii, spotsigs
from scorelake.llm.queries import _LINE_RUNS_SQL


def _line_runs(spark, rows, min_words=50):
    return {r.doc_id: (r.text, r.removed) for r in linedup.delete_repeated_lines(documents(spark, rows), min_words=min_words).select("doc.doc_id", "text", "removed").collect()}


def test_line_runs_equal_the_sql(spark):
    rng = random.Random(7)
    lines = [" ".join(rng.choice("ab") + str(rng.randrange(9)) for _ in range(rng.choice([1, 3, 20, 30, 60]))) for _ in range(25)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30))), "en") for i in range(60)]
    rows += [(100, "\n".join(lines), "en"), (101, "\n".join(lines), "en"), (102, "same\n" * 200, "en"), (103, None, "en"), (104, "", "en"), (105, "tail\n" * 51 + "x", "en")]
    import pandas as pd

    frame = pd.DataFrame([(a, b) for a, b, _ in rows], columns=["doc_id", "text"])
    with duckdb.connect() as db:
        db.register("documents", frame)
        expected = {d: (None if t is None or t != t else t, n) for d, t, n in db.sql(_LINE_RUNS_SQL).fetchall()}
    assert _line_runs(spark, rows) == expected


def test_line_runs_keep_first_copies_and_maximal_runs(spark):
    long, tail, own = " ".join(f"w{i}" for i in range(60)), "short tail", "a line of its own"
    found = _line_runs(spark, [(2, f"{own} 2\n{long}\n\n{tail}\n{own}", "en"), (1, f"{long}\n{tail}", "en"), (3, f"{tail}\n{own} 3", "en")])
    assert found[1] == (f"{long}\n{tail}", 0)
    assert found[2] == (f"{own} 2\n{own}", 3)  # the blank line inside the run goes with it
    assert found[3][1] == 0  # too few words


def test_line_runs_of_awkward_documents(spark):
    rows = linedup.delete_repeated_lines(documents(spark)).select("doc.doc_id", "text", "removed").collect()
    assert len(rows) == len(awkward_rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[2][0].text == "" and by_id[1][0].removed == 0 and by_id[4][0].text is None
    assert by_id[9][0].text == "" and [r.removed for r in by_id[3]] == [0, 0]
    assert linedup.delete_repeated_lines(documents(spark, [])).count() == 0


def test_spotsigs_pairs(spark):
    rows = [r for r in awkward_rows() if r[0] not in (None, 3)] + [(20, prose(8, 300), "en"), (21, prose(8, 300), "en")]
    found = {r.doc_id: r for r in spotsigs.compare_with_edited(documents(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: r[0])
    for i, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        edit = text[: len(text) - quarter] + after[:quarter]
        bags = [spotsigs.signatures(t) for t in (text, edit, after)]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(spotsigs.fingerprint(b) for b in bags[:2])
        assert (r.near_edited, r.near_next) == (spotsigs.likeness(bags[0], bags[1]), spotsigs.likeness(bags[0], bags[2]))
    assert found[20].fingerprint == found[21].fingerprint and found[20].near_next == 1.0 and found[20].near_edited > 0.5
    assert spotsigs.compare_with_edited(documents(spark, [])).count() == 0
    assert spotsigs.compare_with_edited(documents(spark, [(1, "alone in the room", "en")])).first().near_next == 1.0
    assert spotsigs.compare_with_edited(documents(spark)).count() == len(awkward_rows())


def test_likeness_is_jaccard_of_bags_and_pruning_only_drops():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 60, rng.integers(0, 200)).astype(np.uint32)) for _ in range(2))
        both = sum(min((a == v).sum(), (b == v).sum()) for v in set(a.tolist()))
        exact = both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0
        assert spotsigs.likeness(a, b) == exact
        for least in (0.2, 0.5, 0.8):
            assert spotsigs.likeness(a, b, least) == (exact if exact >= least else 0.0)
        assert (spotsigs.bag_of(spotsigs.fingerprint(a)) == a).all()
    for least in (0.3, 0.8, 0.95):
        for n in range(1, 3000, 7):
            assert abs(spotsigs.size_class(n, least) - spotsigs.size_class(math.ceil(n * least), least)) <= 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=a>Home</a></nav><article><h1>A &amp; B</h1><p>One.<p>Two&nbsp; words<br>here.</article><footer>x</footer>", "A & B\n\nOne.\n\nTwo words here."),
        ("<article><p>Kept text.</p><form><p>Your name please, dear reader.</p></form><script>a='</p>'</script><div class='ad'>Buy it</div></article>", "Kept text."),
        ("<article><p>Kept text.</p><section id=comments><article><p>A long remark by a reader, with many words in it.</p></article></section></article>", "Kept text."),
        ("<div class=ad>Never closed<article><p>Still the article.</p></article>", "Still the article."),
        ("<main><p>Text.</p><aside><p>Beside it, a long sentence that is not wanted here at all.</p></aside></main>", "Text."),
        ("", ""), (None, ""), ("<p", ""), ("<!-- open", ""), ("<nav><a href=x>only</a></nav>", ""),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


ARTICLE = "<article><h1>A head</h1><p>The first sentence stays here.</p><p>And so does the second one.</p></article>"
KEPT = "A head\n\nThe first sentence stays here.\n\nAnd so does the second one."


@pytest.mark.parametrize("tag", ["svg", "math", "iframe", "object", "select", "noscript", "canvas", "template"])
def test_raw_elements_without_an_end_hold_no_article(tag):
    for opened in (f"<{tag}>", f"<{tag} class='x' />", f"<{tag}/>"):
        assert pages.main_text(f"<body><div>{opened}</div>{ARTICLE}</body>") == KEPT
        assert pages.main_text(f"<body>{opened}{ARTICLE}<div><{tag}>inside</{tag}></div></body>") == KEPT
    assert pages.main_text(f"<body><{tag}>gone <{tag}>gone</{tag}> gone.</{tag}>{ARTICLE}</body>") == KEPT
    assert pages.main_text(f"<body><script src='x' />{ARTICLE}</body>") == KEPT


def test_words_about_comments_do_not_empty_a_page():
    for page in (f"<body class='single comments-open'>{ARTICLE}</body>", ARTICLE.replace("<article>", "<article class='post has-comments'>"), f"<main id='discussion'>{ARTICLE}</main>"):
        assert pages.main_text(page) == KEPT
    remark = "<div class='comments'><article class='comment'><p>A long remark by a reader, with many words in it.</p></article></div>"
    assert pages.main_text(f"<body class='comments-open'>{ARTICLE}{remark}</body>") == KEPT


def test_minimum_cut_is_least(spark):
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))) if a != b]

        def cost(labels, scores=scores, edges=edges):
            return sum(abs(s) for s, x in zip(scores, labels, strict=True) if x != (s > 0)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert cost(pages.min_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>Hi there.</article>"), (2, None, None), (2, None, None), (None, "u", "<p>" * 3000)]
    found = pages.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page.*", "text", "n_chars")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", "Hi there.", 9), (2, None, "", 0), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert pages.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_languages_held_out(spark):
    rows = [(i, prose(i, 60, lang), lang) for i in range(120) for lang in ("en" if i % 3 else "fr",)]
    docs = documents(spark, rows)
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    found = langid.predict_languages(docs, profiles, out=("predicted", "certainty")).select("doc.*", "predicted", "certainty").where(langid.held_out()).collect()
    assert len(found) > 10 and all(r.predicted == r.lang and 0 < r.certainty <= 1 for r in found)


def test_language_profiles_by_their_definition(spark):
    docs = documents(spark, [(1, "The theta", "en"), (2, "the", "en"), (3, "été", "fr"), (4, "x", None), (5, None, "fr")])
    found = {(r.lang, r.gram): r.rank for r in langid.learn_profiles(docs).collect()}
    counts = {}
    for word in ("the", "theta", "the"):
        for g in langid.grams_of(word):
            counts[g] = counts.get(g, 0) + 1
    assert {g: r for (lang, g), r in found.items() if lang == "en"} == {g: sum(m > n for m in counts.values()) for g, n in counts.items()}


def test_languages_of_awkward_documents(spark):
    docs = documents(spark)
    found = langid.predict_languages(docs, langid.learn_profiles(docs), out=("predicted", "certainty")).select("doc.doc_id", "predicted", "certainty").collect()
    assert len(found) == len(awkward_rows())
    und = {r.doc_id for r in found if r.predicted == langid.UNKNOWN}
    assert {4, 5, 6, 8} <= und and not und & {1, 2, 3, 7, 9}
    empty = documents(spark, [])
    assert langid.predict_languages(empty, langid.learn_profiles(empty), out=("predicted", "certainty")).count() == 0
    assert {r.predicted for r in langid.predict_languages(docs, langid.learn_profiles(empty), out=("predicted", "certainty")).collect()} == {langid.UNKNOWN}


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        *[("email", *m.span()) for m in _EMAIL.finditer(text)],
        *[("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        *[("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))],
        *[("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    ]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for text in [t for _, t, _ in awkward_rows() if t]:
        assert pii.base_spans(text) == _plain_spans(text)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@--+ ab()") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == _plain_spans(text)
    assert pii.base_spans("1" * 100_000 + " " + "a." * 50_000) == []


def test_terms_that_disclose(spark):
    mail = "kim.lee@mail.example.org"
    rows = [(i, f"{prose(i, 30)}\ngarden Quillfeather {'abcdef'[i] * 5} {mail} river stone", "en") for i in range(6)]
    rows += [(100 + i, f"{prose(200 + i, 30)}\npaper stone river", "en") for i in range(30)]
    # The same context over and over is one context: nothing there is disclosing.
    rows += [(200 + i, "Marblewood calls from 10.1.2.3 each morning", "en") for i in range(8)]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in pii.find_personal_data(docs).select("doc.doc_id", "doc.text", "base", "terms").collect()}
    for i in range(6):
        r = found[i]
        assert [s.kind for s in r.base] == ["email"] and [r.text[s.start : s.end] for s in r.terms] == ["Quillfeather"]
    assert all(not found[100 + i].terms and not found[100 + i].base for i in range(30))
    assert all([s.kind for s in found[200 + i].base] == ["ip"] and not found[200 + i].terms for i in range(8))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == rows[0][1].replace(mail, "[EMAIL]").replace("Quillfeather", "[TERM]") and clean[100] == rows[6][1]


def test_terms_disclose_wherever_they_stand(spark):
    mail = "kim@mail.example.org"
    rows = [(i, f"Lee {'abcdef'[i] * 6}\n{prose(300 + i, 30)}\nwrite to {mail} {'uvwxyz'[i] * 3}\nsoon Brightwater and Lee", "en") for i in range(6)]
    rows += [(100 + i, prose(400 + i, 30), "en") for i in range(60)]
    found = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows)).select("doc.doc_id", "doc.text", "terms").collect()}
    for i in range(6):
        marked = [found[i].text[s.start : s.end] for s in found[i].terms]
        assert marked.count("Lee") == 2 and marked.count("Brightwater") == 1


def test_words_around_are_read_until_enough_are_met():
    text = "one two three four five " + "7 " * 400 + "a@b.org" + " 8" * 400 + " six seven eight nine ten eleven"
    words = pii.Words(text, pii.base_spans(text))
    at = text.index("a@b.org")
    assert words.said(words.around(at, at + 7)).split() == "one two three four five six seven eight nine ten".split()


def test_personal_data_of_awkward_documents(spark):
    docs = documents(spark)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[10] == "Mail [EMAIL] or [PHONE], [CARD] from 10.0.0.256 and [IP]." and by_id[4] is None and by_id[5] == ""
    assert clean.count() == len(awkward_rows()) and pii.sanitise(documents(spark, [])).count() == 0


def test_replaced_spans_may_overlap():
    assert pii.replace_spans("+1 4111111111111111 x", [("card", 3, 19), ("phone", 0, 19)]) == "[CARD] x"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n_a1éßİσς日"))))
def test_gram_codes_are_the_grams_of_the_words(text):
    found = Counter(langid.gram_of(c) for c in langid.gram_codes(text).tolist())
    assert found == Counter(g for w in langid.words_of(text) for g in langid.grams_of(w))
    assert all(langid.gram_of(langid.code_of(g)) == g for g in found)


def out_of_place(text, profiles, size):
    """Language and score straight from the definition, n-gram by n-gram."""
    counts = Counter(g for w in langid.words_of(text or "") for g in langid.grams_of(w))
    if not counts:
        return langid.UNKNOWN, 0.0
    places = {g: sum(m > n for m in counts.values()) for g, n in counts.items()}
    mine = {g: p for g, p in places.items() if p < size}
    far = {lang: sum(min(size, abs(known[g] - p)) if g in known else size for g, p in mine.items()) for lang, known in profiles.items()}
    lang = min(sorted(far), key=far.get)
    return lang, 1 - far[lang] / (size * len(mine))


@pytest.mark.parametrize("size", [5, 40, 400])
def test_out_of_place_distance_by_its_definition(size):
    profiles = {}
    for lang in ("en", "fr"):
        counts = Counter(g for i in range(6) for w in langid.words_of(prose(i, 200, lang)) for g in langid.grams_of(w))
        profiles[lang] = {g: sum(m > n for m in counts.values()) for g, n in counts.items() if sum(m > n for m in counts.values()) < size}
    own = langid.Profiles([(lang, g, r) for lang, known in profiles.items() for g, r in known.items()], size)
    for text in [None, "", "12 !?", "a", "é", *[t for _, t, _ in awkward_rows()], *[prose(50 + i, 30, lang) for i in range(10) for lang in ("en", "fr")]]:
        lang, score = own.predict(text)
        wanted = out_of_place(text, profiles, size)
        assert (lang, pytest.approx(score, abs=1e-12)) == wanted
