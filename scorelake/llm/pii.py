"""Personal data, and terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Removing
them is not enough where the words around them point to the same person: with
p(e), p(t) and p(e, t) the shares of documents that hold an entity, a term, and
both, wherever they stand, pointwise mutual information

    PMI(e; t) = log p(e, t) / (p(e) p(t))

says how much of the entity's information content -log p(e) the term reveals.
A term is disclosing when it reveals at least a given share of it and was seen
with the entity in several different contexts: the words around the entity and,
where the term isn't among them, around the term. Copies of a text are one
context, so a copied document does not make its own words disclosing. All counts
cover all documents. A disclosing term is marked wherever it stands in a
document that holds its entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored
from .common import extend, prepare, slices

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as its context.
REACH = 5
#: Share of an entity's information content from which a term is disclosing.
DISCLOSURE = 0.9
#: Different contexts that must hold both.
MIN_CONTEXTS = 3
#: Distinct words that a worker holds before it passes their counts on.
HELD = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# Whole chains of dotted numbers; possessive, and begun only where a number begins, so long digit runs stay linear.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile("[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each "@" outwards: trying the pattern at every letter would be quadratic in long words.
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(n := p[0].lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and a separator between any two
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and not sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10:
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in code points, ends exclusive, by kind and start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, find in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            found += [(kind, a, b) for a, b in find(text)]
    return found


class Words:
    """The words of a text outside its spans, read once however many spans there are."""

    def __init__(self, text: str, spans: list[Span], reach: int = REACH) -> None:
        self.text, self.reach = text, reach
        taken: list[list[int]] = []
        for start, end in sorted((a, b) for _, a, b in spans):
            if taken and start < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], end)
            else:
                taken.append([start, end])
        starts = [a for a, _ in taken]
        at = lambda m: bisect_left(starts, m.end()) - 1  # noqa: E731  the last span that begins before the word ends
        self.found = list(_TERM.finditer(text))
        self.free = [(i := at(m)) < 0 or taken[i][1] <= m.start() for m in self.found]
        self.starts, self.ends = [m.start() for m in self.found], [m.end() for m in self.found]

    def around(self, start: int, end: int) -> list[int]:
        """Numbers of the words within reach on either side, on the same line and outside all spans."""
        line_start, line_end = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", end)
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        low = max(bisect_left(self.starts, line_start), before - self.reach)
        high = min(bisect_left(self.starts, line_end) if line_end >= 0 else len(self.starts), after + self.reach)
        return [i for i in [*range(low, before), *range(after, high)] if self.free[i]]

    def said(self, numbers: list[int]) -> str:
        return "\n".join(self.found[i][0].lower() for i in numbers)


def entity_of(text: str, span: Span) -> str:
    return f"{span[0]}:{text[span[1] : span[2]].lower()}"


def document_terms(text: str, spans: list[Span], entities: set[str], reach: int = REACH) -> list[tuple[str, str, str]]:
    """``entity, term, context`` of each word of a text beside each of ``entities`` in it.

    ``context`` is a digest of the words around the span, and around the term
    where it isn't among them, so equal surroundings count once.
    """
    words, rows = Words(text, spans, reach), set()
    first: dict[str, int] = {}
    for i, m in enumerate(words.found):
        if words.free[i]:
            first.setdefault(m[0].lower(), i)
    beside = {t: words.said([i, *words.around(words.starts[i], words.ends[i])]) for t, i in first.items()}
    nearest: dict[str, set[str]] = {}
    surroundings: dict[str, str] = {}
    for span in spans:
        entity = entity_of(text, span)
        if entity not in entities:
            continue
        numbers = words.around(span[1], span[2])
        said = words.said(numbers)
        surroundings.setdefault(entity, said)
        for i in numbers:
            term = words.found[i][0].lower()
            nearest.setdefault(entity, set()).add(term)
            rows.add((entity, term, hashlib.md5(said.encode()).hexdigest()))
    for entity, said in surroundings.items():
        near = nearest.get(entity, ())
        rows.update((entity, t, hashlib.md5(f"{said}\n\n{b}".encode()).hexdigest()) for t, b in beside.items() if t not in near)
    return sorted(rows)


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


#: Names of a text: a 128-bit hash, so that what was found in a text finds its rows again without a copy of them.
TEXT = ["_t1", "_t2"]


def _named(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(*columns, text.alias("_text"), *[F.xxhash64(F.lit(lane), text).alias(n) for lane, n in enumerate(TEXT)])


def _span_rows(spans: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in found] for found in spans], kind)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A text's name and the entities in it, for each row whose text holds any; stored in the shared folder."""
    prepare(docs.sparkSession)
    counted = pa.list_(pa.struct([("entity", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                found = [base_spans(t) for t in few.column(0).to_pylist()]
                some = [i for i, spans in enumerate(found) if spans]
                texts = few.column(0).take(pa.array(some, pa.int32())).to_pylist()
                entities = [[{"entity": e, "n": n} for e, n in sorted(Counter(entity_of(t, x) for x in found[i]).items())] for i, t in zip(some, texts, strict=True)]
                names = few.select(TEXT).take(pa.array(some, pa.int32()))
                yield pa.RecordBatch.from_arrays([*names.columns, pa.array(entities, counted)], names=[*TEXT, "entities"])

    return cut_lineage(_named(docs, text_col).mapInArrow(run, "_t1 bigint, _t2 bigint, entities array<struct<entity: string, n: bigint>>"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df``: in how many documents each word stands; workers pass on sums."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])
            held.clear()
            return batch

        for batch in batches:
            for few in slices(batch):
                for text in few.column(0).to_pylist():
                    held.update({w.lower() for w in set(_TERM.findall(text))})
                if len(held) > HELD:
                    yield passed_on()
        yield passed_on()

    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "term string, df bigint")
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


def disclosing_pairs(scanned: DataFrame, docs: DataFrame, text_col: str = "text", share: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``entity, term, revealed``: pairs in enough different contexts where the term reveals at least ``share``."""
    total = docs.count()
    holders = scanned.select(*TEXT, F.explode("entities").alias("e")).select(*TEXT, "e.entity", "e.n")
    # Entities that stand in fewer places cannot have enough contexts.
    entities = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("places"))
    often = cut_lineage(entities.where(F.col("places") >= min_contexts).select("entity", "docs"))
    # Rows of one text are looked at once and count as often as they are.
    rows = holders.join(often, "entity").groupBy(*TEXT, "entity").agg(F.count(F.lit(1)).alias("copies"))
    held = cut_lineage(rows.groupBy(*TEXT).agg(F.collect_set("entity").alias("wanted"), F.max("copies").alias("copies")))
    texts = _named(docs, text_col).join(held, TEXT).dropDuplicates(TEXT).select(*TEXT, "copies", "_text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 8):
                for *name, copies, text, wanted in zip(*[c.to_pylist() for c in few.columns], strict=True):
                    rows = document_terms(text, base_spans(text), set(wanted))
                    for at in range(0, len(rows), 10_000):
                        entity, term, context = zip(*rows[at : at + 10_000], strict=True)
                        same = [pa.array([x] * len(term), pa.int64()) for x in (*name, copies)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(entity), pa.array(term), pa.array(context)], names=[*TEXT, "copies", "entity", "term", "context"])

    # A term in more than docs * (total / docs) ** (1 - share) documents cannot reveal that share.
    most = F.col("docs") * F.pow(F.lit(total) / F.col("docs"), F.lit(1 - share)) * (1 + 1e-9)
    largest = F.coalesce(often.select(F.max(most)).scalar(), F.lit(0.0))
    frequencies = document_frequencies(docs, text_col).where(F.col("df") <= largest)
    beside = texts.mapInArrow(run, "_t1 bigint, _t2 bigint, copies bigint, entity string, term string, context string").join(frequencies, "term").join(often, "entity").where(F.col("df") <= most)
    # Counted by context first: a term's rows of one context are one row.
    once = beside.groupBy("entity", "term", *TEXT, "copies", "docs", "df").agg(F.collect_set("context").alias("contexts"))
    by_context = cut_lineage(once)
    together = by_context.groupBy("entity", "term", "docs", "df").agg(F.sum("copies").alias("both"))
    contexts = by_context.select("entity", "term", F.explode("contexts").alias("c")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    judged = together.join(contexts.where(F.col("contexts") >= min_contexts), ["entity", "term"])
    joint = F.log(F.col("both") * F.lit(total) / (F.col("docs") * F.col("df")))
    content = F.log(F.lit(total) / F.col("docs"))
    # An entity in every document has no information to reveal.
    revealed = F.when(content > 0, joint / content)
    return judged.select("entity", "term", revealed.alias("revealed")).where(F.col("revealed") >= share)


def find_personal_data(docs: DataFrame, text_col: str = "text", share: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: its columns in a struct ``doc``, ``base`` spans and ``terms`` spans.

    A null text is an empty one. Repeated rows get the same result. A term is
    marked wherever it stands in a document with the entity that it discloses.
    """
    scanned = scan(docs, text_col)
    pairs = disclosing_pairs(scanned, docs, text_col, share, min_contexts).select("entity", "term")
    holders = scanned.select(*TEXT, F.explode("entities.entity").alias("entity")).distinct()
    # Stored, so that Spark knows its size when it meets the texts.
    wanted = cut_lineage(holders.join(pairs, "entity").groupBy(*TEXT).agg(F.collect_set("term").alias("wanted")))
    drop_stored(scanned)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    texts = _named(docs, text_col, packed).join(wanted, TEXT, "left").select("doc", "_text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                bases, marks = [], []
                for text, terms in zip(*[c.to_pylist() for c in few.columns[1:]], strict=True):
                    bases.append(base_spans(text))
                    marks.append([])
                    if terms:
                        words, terms = Words(text, bases[-1]), set(terms)
                        marks[-1] = [(TERM, m.start(), m.end()) for m, free in zip(words.found, words.free, strict=True) if free and m[0].lower() in terms]
                yield pa.RecordBatch.from_arrays([few.column(0), _span_rows(bases), _span_rows(marks)], names=["doc", "base", "terms"])

    return texts.mapInArrow(run, extend(texts.select("doc").schema, f"base {_SPANS}, terms {_SPANS}"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def replace_spans(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones the first kind listed names the whole."""
    out, at = [], 0
    order = [*KINDS, TERM]
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][0] = min(merged[-1][0], kind, key=order.index)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", share: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``docs`` with each span generalised to its kind; other columns as they were, a null text stays null."""
    found = find_personal_data(docs, text_col, share, min_contexts)
    flat = found.select(F.col(f"doc.`{text_col}`").alias("_text"), F.concat("base", "terms").alias("_spans"), "doc")
    new = extend(flat.select("doc").schema, "_clean string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                clean = [
                    replace_spans(t, [(s["kind"], s["start"], s["end"]) for s in spans]) if t and spans else t
                    for t, spans in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([few.column(2), pa.array(clean, pa.string())], names=["doc", "_clean"])

    replaced = flat.mapInArrow(run, new)
    return replaced.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
