"""How the tokens of two tokenizers lie over each other, in bytes.

One is a byte-level vocabulary of the tokenizers library (A), the other a
sentencepiece model (B); both see a space and then the text. Each library's own
spans are the coarse cuts: character offsets on one side, the surface spans of
the piece messages on the other. Where several tokens share one character (parts
of a multibyte character, byte-fallback tokens) their spans say nothing about
the borders between them, and the decoded bytes refine the cut.

Both tokenizers always cut before a single space that follows no space and
precedes something visible, and between a letter and a sign where no piece of B
holds the two. Texts are cut there into chunks, each distinct chunk is aligned
once and remembered in a bounded memo, and a text is the chain of its chunks.
Chunks that are new in a slice of texts are aligned together, as one text.

How often two ids are linked in the corpus is counted per block of links first.
Each block then gets the sums of its own pairs back, so no task holds the table
of all pairs and no text is read twice.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import MEMO_KEY_CHARS, extend, prepare, slices, text_or_empty

#: Links of a block, whose pairs are counted in one go. A text is never split: a longer one is a block of its own.
BLOCK_LINKS = 4_000_000
#: Chunks in either generation of the memo.
MEMO_CHUNKS = 150_000
#: A pair of ids in one number: A's id above the low bits, B's id in them.
_ID_BITS = 32

_BEFORE_WORD = "(?<![ ▁])(?= \\S)"
_SPACES = (" ", "▁")
#: Letters that both sides take for letters, and the signs that may follow them.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_SIGNS = [chr(c) for c in (10, *range(33, 127)) if not chr(c).isalpha()]
#: Cut off again: what keeps a chunk without a space before it away from the chunk before.
_AFTER_LETTER, _AFTER_LINE = "\na", "\n"


class Digest(NamedTuple):
    """What the counts need of an aligned chunk or text."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes  # pairs of ids as little-endian 64-bit integers


_NOTHING = Digest(0, 0, 0, "", b"")


def _apart(chunk: str) -> str:
    return _AFTER_LINE if chunk[0].isalpha() else _AFTER_LETTER


def _byte_level() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refine_ends(coarse: np.ndarray, sizes: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse one where it is ``trusted``, else decoded bytes from the last such cut on."""
    if not len(coarse):
        return coarse
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(trusted, np.arange(1, len(coarse) + 1), 0))
    base = np.concatenate([[0], coarse])[last] - np.concatenate([[0], decoded])[last]
    return base + decoded


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        # Strings of special tokens inside a text are plain text.
        self.a.encode_special_tokens = True
        byte = _byte_level()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in zip(pieces, self.b_is_byte, strict=True)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        # An id as it stands in a group: before another of its side, or as its side's last.
        self.names = [f"{i}{end}" for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for end in (",", last) for i in range(len(table))]
        self.cuts_at_spaces = self._cuts_at_spaces(pieces)
        mixed = {p[i + 1] for p in pieces for i in range(len(p) - 1) if re.match(f"[{_LETTERS}]", p[i])}
        signs = "".join(s for s in _SIGNS if s not in mixed)
        # A line's end is cut from the next line's first letter unless other white space stands before it.
        lines = "" if any("\n" in p for p in pieces) else f"|(?<=\\S\n)(?=[{_LETTERS}])"
        self.before_chunk = re.compile(f"{_BEFORE_WORD}|(?<=[{_LETTERS}])(?=[{re.escape(signs)}]){lines}" if signs else _BEFORE_WORD)
        self.young: dict[str, Digest | None] = {}
        self.old: dict[str, Digest | None] = {}

    def _cuts_at_spaces(self, pieces: list[str]) -> bool:
        """Whether both sides always cut before a space: else texts are aligned whole."""
        import json

        spec = json.loads(self.a.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = plain and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        # No piece goes on over a space, and neither spaces nor letters are rewritten.
        joined = any("▁" in p.lstrip("▁") for p in pieces)
        odd = " a  b\t ﬁ "
        return bool(plain) and not joined and self.b.normalize(odd) == "▁" + odd.replace(" ", "▁")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of both sides over ``text``, which starts with the space that B adds."""
        units = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        upto = np.concatenate([[0], np.cumsum(1 + (units > 0x7F) + (units > 0x7FF) + (units > 0xFFFF))])
        found = self.a.encode(text, add_special_tokens=False)
        a_ids, spans = np.array(found.ids, dtype=np.int64), np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        # A token whose successor starts inside its last character has no border of its own.
        alone = np.ones(len(a_ids), dtype=bool)
        alone[:-1] = spans[1:, 0] >= spans[:-1, 1]
        a_ends = refine_ends(upto[spans[:, 1]], self.a_sizes[a_ids], alone)
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b_ids, ends = (np.array(x, dtype=np.int64) for x in ([p.id for p in pieces], [p.end for p in pieces]))
        # Of the bytes of one character only the last has a span, the others end where it starts.
        inside = self.b_is_byte[b_ids] & (ends == np.concatenate([[0], ends[:-1]]))
        # Spans start after the added space.
        return a_ids, a_ends, b_ids, refine_ends(ends + 1, self.b_sizes[b_ids], ~inside)

    def spelled(self, raw: bytes, a_ids: np.ndarray, b_ids: np.ndarray) -> bool:
        sides = ((self.a_bytes, a_ids), (self.b_bytes, b_ids))
        return all(b"".join(map(table.__getitem__, ids.tolist())) == raw for table, ids in sides)

    def whole(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids and ends of A, of B, and the ends of the groups; None where a side doesn't spell the text."""
        text = " " + text
        a_ids, a_ends, b_ids, b_ends = self.tokens(text)
        if not self.spelled(text.encode(), a_ids, b_ids):
            return None
        return a_ids, a_ends, b_ids, b_ends, np.intersect1d(a_ends, b_ends, assume_unique=True)

    def _aligned(self, texts: list[str]) -> list[Digest] | None:
        """Digests of ``texts``, which may stand behind each other as one text; None where a side doesn't spell that."""
        whole = "".join(texts)
        a_ids, a_ends, b_ids, b_ends = self.tokens(whole)
        if not self.spelled(whole.encode(), a_ids, b_ids):
            return None
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # Between two neighbouring borders of either side just one token of each lies over the other.
        borders = np.union1d(a_ends, b_ends)
        raw = ((a_ids[np.searchsorted(a_ends, borders)] << _ID_BITS) | b_ids[np.searchsorted(b_ends, borders)]).astype("<i8").tobytes()
        # Tokens in the order of group and side, each with the sign behind it.
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        a_names = a_ids + len(self.a_bytes) * np.isin(a_ends, cuts, assume_unique=True)
        b_names = b_ids + len(self.b_bytes) * np.isin(b_ends, cuts, assume_unique=True) + 2 * len(self.a_bytes)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        names = list(map(self.names.__getitem__, np.concatenate([a_names, b_names])[order].tolist()))
        ends = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts])
        a, b, c, l = (np.searchsorted(x, ends) + 1 for x in (a_ends, b_ends, cuts, borders))  # noqa: E741
        counts = [np.diff(x, prepend=0).tolist() for x in (a, b, c)]
        upto, links = (a + b).tolist(), (8 * l).tolist()
        return [
            Digest(n_a, n_b, n_c, "".join(names[s:e])[:-1], raw[x:y])
            for n_a, n_b, n_c, s, e, x, y in zip(*counts, [0, *upto[:-1]], upto, [0, *links[:-1]], links, strict=True)
        ]

    def _alone(self, chunk: str) -> Digest | None:
        found = self._aligned([chunk] if chunk[0] == " " else [" a", _apart(chunk), chunk])
        return found[-1] if found else None

    def digests(self, texts: list[str]) -> list[Digest]:
        """One digest for each text: nothing for an empty one, and for one that a side doesn't spell."""
        if len(self.young) >= MEMO_CHUNKS:
            self.old, self.young = self.young, {}
        known, cut = self.young, [self._cut(t) for t in texts]
        new = list(set().union(*cut).difference(known))
        known.update((c, self.old[c]) for c in new if c in self.old)
        new = [c for c in new if c not in known]
        # A chunk that ends in spaces would run into the next one; whole texts stay by themselves too.
        apart = [c for c in new if self.cuts_at_spaces and not c.endswith(_SPACES) and "▁" not in c]
        together = [c for c in apart if c[0] == " "]
        if len(together) < len(apart):
            together = together or [" a"]
            together += [x for c in apart if c[0] != " " for x in (_apart(c), c)]
        known.update(zip(together, together and self._aligned(together) or [], strict=False))
        known.update((c, self._alone(c)) for c in new if c not in known)
        out = [self._chained([known[c] for c in chunks]) for chunks in cut]
        for chunk in new:
            if len(chunk) > MEMO_KEY_CHARS:
                del known[chunk]
        return out

    @staticmethod
    def _chained(chunks: list[Digest | None]) -> Digest:
        if not chunks or None in chunks:
            return _NOTHING
        n_a, n_b, n_groups, groups, links = zip(*chunks, strict=True)
        return Digest(sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links))

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts_at_spaces:
            return [" " + text]
        found = self.before_chunk.split(" " + text)
        return found if found[0] else found[1:]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, so that its memo outlives a task."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_TOKENS = "array<struct<id:int, start:bigint, end:bigint>>"


def align_documents(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``doc`` (the whole row), ``fits``, ``a`` and ``b`` (ids with byte ranges) and ``cuts`` (ends of the groups, in bytes).

    Bytes count from the space that stands before the text. A null or empty text
    has no tokens; nor has one that either side's tokens don't spell, byte by
    byte, which shows as ``fits`` false. Whole texts of any length are aligned;
    repeated rows stay, and other columns may have any name.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("doc"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, none = aligner(a_path, b_path), (np.zeros(0, dtype=np.int64),) * 5
        for batch in batches:
            for few in slices(batch, 16):
                found = [own.whole(t) if t else none for t in few.column(1).to_pylist()]
                rows = [x or none for x in found]
                arrays = [few.column(0), pa.array([x is not None for x in found])]
                arrays += [pa.array([_spans(*x[i : i + 2]) for x in rows], _SPANS) for i in (0, 2)]
                cuts = pa.array([x[4] for x in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*arrays, cuts], names=["doc", "fits", "a", "b", "cuts"])

    schema = extend(packed.select("doc").schema, f"fits boolean, a {_TOKENS}, b {_TOKENS}, cuts array<bigint>")
    return packed.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(ids: np.ndarray, ends: np.ndarray) -> list[dict]:
    ends = ends.tolist()
    return [{"id": i, "start": s, "end": e} for i, s, e in zip(ids.tolist(), [0, *ends[:-1]], ends, strict=False)]


_STORED = "kind int, block bigint, id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, times binary"
_DIGEST = "{id_col} {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _blocks(a_path: str, b_path: str):
    """Texts in, rows of documents and of their blocks out.

    A block's row has its distinct pairs and how often each occurs; a document's
    row the places of its own pairs in that list, as differences, and their counts.
    """
    names = [f.split()[0] for f in _STORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            links = np.frombuffer(b"".join(h[-1] for h in held), dtype="<i8")
            pairs, place, times = np.unique(links, return_inverse=True, return_counts=True)
            rows, at = [], 0
            for doc, *counts, sha, raw in held:
                n = len(raw) // 8
                mine, often = np.unique(place[at : at + n], return_counts=True)
                at += n
                packed = np.diff(mine, prepend=0).astype("<i4").tobytes(), often.astype("<i4").tobytes()
                rows.append((1, number, doc, *counts, n, sha, *packed))
            rows.append((0, number, None, None, None, None, None, None, pairs.tobytes(), times.astype("<i8").tobytes()))
            kinds = [pa.int32(), pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
            for s in range(0, len(rows), 256):
                columns = zip(*rows[s : s + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            number, held, size = number + 1, [], 0

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for few in slices(batch, 32):
                for doc, found in zip(few.column(0).to_pylist(), own.digests(few.column(1).to_pylist()), strict=True):
                    sha = hashlib.sha256(found.groups.encode()).hexdigest() if found.n_groups else ""
                    held.append((doc, found.n_a, found.n_b, found.n_groups, sha, found.links))
                    size += len(found.links) // 8
                    if size >= BLOCK_LINKS:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _unpack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs, times = (np.frombuffer(row[k], dtype="<i8") for k in ("links", "times"))
            for s in range(0, len(pairs), 16384):
                few = pairs[s : s + 16384]
                block = pa.array(np.full(len(few), row["block"]))
                yield pa.RecordBatch.from_arrays([block, pa.array(few), pa.array(times[s : s + 16384])], names=["block", "pair", "times"])


def _count(names: list[str]):
    """Over rows sorted by (block, kind, pair): the sums of a block's pairs, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                few = batch.slice(s, e - s)
                if blocks[s] != block:
                    block, parts, table = blocks[s], [], None
                if kinds[s] == 0:
                    parts.append((few.column("total").to_numpy(zero_copy_only=False), few.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if table is None:
                    table = [np.concatenate([*x]) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, bool)]
                n_best, count_sum = [], []
                for links, times in zip(few.column("links").to_pylist(), few.column("times").to_pylist(), strict=True):
                    place, often = np.cumsum(np.frombuffer(links, dtype="<i4"), dtype=np.int64), np.frombuffer(times, dtype="<i4").astype(np.int64)
                    n_best.append(int(often[table[1][place].astype(bool)].sum()))
                    count_sum.append(int((often * table[0][place]).sum()))
                kept = [few.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), few.column("groups_sha256")], names=names)

    return run


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its tokens, groups and links, how many links are the best of their B id, and the sum of their counts.

    Columns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    A link's count is how many links of all documents hold its pair of ids; ties
    for the best all count. Null and empty texts, and texts that either side's
    tokens don't spell, have zeros and an empty ``groups_sha256``. Null ids and
    repeated rows are documents like others; no rows in, no rows out. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    stored = cut_lineage(rows.mapInArrow(_blocks(a_path, b_path), _STORED.format(id=kind)))
    own = stored.where("kind = 0").select("block", "links", "times").mapInArrow(_unpack_pairs, "block bigint, pair bigint, times bigint")
    own = cut_lineage(own)
    totals = own.groupBy("pair").agg(F.sum("times").alias("total"))
    totals = cut_lineage(totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1))))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    judged = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = own.join(judged, "pair").select(F.lit(0).alias("kind"), "block", "pair", "total", "best")
    asking = stored.where("kind = 1")
    met = asking.unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "pair")
    schema = _DIGEST.format(id_col=f"`{id_col}`", id=kind)
    return met.mapInArrow(_count([id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]), schema)
