"""BPE encoding and decoding by dynamic programming over prefixes.

The byte-pair encoding of a prefix ends in exactly one token. Reading a word
from left to right, the last token of each prefix is found among the vocabulary
tokens that end there (matches of an automaton with suffix links) as the one
that may follow the last token of the rest: two tokens are compatible when no
merge crosses their border before both are built. Following the stored last
tokens backwards gives the ids, without replaying any merge.

Rows are independent: no shuffle, one pass, and memory bounded by the longest
text plus memos of fixed size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SEPARATORS, WORD_PIECES, Memo, extend, is_latin, prepare, slices, text_or_empty

ENCODED = "ids binary, n_tokens bigint, decoded string"
#: White space as the vocabulary files have it: Python's without the information separators.
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
#: Upper half of the symbol alphabet: a byte that ends a word.
_END = 256


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class PrefixBPE:
    """Encoder and decoder of one vocabulary file with word-end tokens.

    Texts are normalised, cut at special tokens and into words as the file
    says; each word is encoded by :meth:`encode_word`.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != "</w>" or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
            raise ValueError(f"{path}: not a BPE vocabulary with word ends")
        stand_in = {c: chr(b) for b, c in enumerate(_byte_alphabet())}
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.spelling: dict[int, bytes] = {i: s.encode() for s, i in [*model["vocab"].items(), *self.special.items()]}

        def symbols(token: str) -> str:
            body = token.removesuffix("</w>")
            out = "".join(stand_in[c] for c in body)
            return out[:-1] + chr(_END + ord(out[-1])) if body != token else out

        vocab = {symbols(t): i for t, i in model["vocab"].items()}
        #: id of the merged token, and its place in the merge order, by the pair that makes it
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = (model["vocab"][t] for t in (left, right, left + right))
            self.merge[a, b] = (rank, c)
            self.parts[c] = (rank, a, b)
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Memo(self.encode_word)
        self.chunks = Memo(self._encode_chunk)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both spellings together is just these two tokens.

        Undo merges from the latest on. At each moment the border has one
        token on either side; a merge of the two that comes before the one
        being undone would have been made, so the border would not have stood.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, fits = left, right, len(self.merge), True
        while True:
            made = self.merge.get((a, b))
            if made and made[0] < limit:
                fits = False
                break
            from_a, from_b = self.parts.get(a), self.parts.get(b)
            if from_a is None and from_b is None:
                break
            # The later merge is undone first. On the right side, a merge of the same
            # place in the order acts after the border's, which stands further left.
            if from_b is None or from_a and from_a[0] > from_b[0]:
                limit, a = from_a[0], from_a[2]
            else:
                limit, b = from_b[0] + 1, from_b[1]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def encode_word(self, word: str) -> bytes:
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(_END + raw[-1])
        last: list[int] = [-1] * (len(symbols) + 1)
        size: list[int] = [0] * (len(symbols) + 1)
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            start = end - length
            if last[end] < 0 and (start == 0 or last[start] >= 0 and self.compatible(last[start], token)):
                if start or self._whole(token):
                    last[end], size[end] = token, length
        ids, end = [], len(symbols)
        while end:
            ids.append(last[end])
            end -= size[end]
        return b"".join(i.to_bytes(4, "little") for i in reversed(ids))

    def _whole(self, token: int) -> bool:
        """Whether a token's own spelling is encoded as the token: its two parts must be compatible but for their merge."""
        made = self.parts.get(token)
        if made is None:
            return True
        known = self.pairs.get((token, -1))
        if known is None:
            rank, a, b = made
            known = self._whole(a) and self._whole(b) and self._border_stands(a, b, rank)
            self.pairs[token, -1] = known
        return known

    def _border_stands(self, a: int, b: int, rank: int) -> bool:
        made = self.merge.pop((a, b))
        self.pairs.pop((a, b), None)
        try:
            return self.compatible(a, b)
        finally:
            self.merge[a, b] = made
            self.pairs.pop((a, b), None)

    def _encode_chunk(self, chunk: str) -> bytes:
        out, at = [], 0
        for m in self.specials.finditer(chunk):
            out += [self._plain(chunk[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(chunk[at:])])

    def _plain(self, text: str) -> bytes:
        # Each character is lowered by itself: no rule for a sigma at a word's end.
        lowered = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
        return b"".join(map(self.words.__getitem__, self.word.findall(lowered)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if is_latin(text) and not any(t in text for t in self.special):
            return b"".join(map(self.words.__getitem__, WORD_PIECES.findall(text.lower())))
        # Words never span white space, so chunks between it are encoded (and remembered) one by one.
        chunks = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' spellings, joined by spaces as a file without a decoder has it."""
        return b" ".join(map(self.spelling.__getitem__, memoryview(ids).cast("I").tolist()))


_LOADED: dict[str, PrefixBPE] = {}


def loaded(path: str) -> PrefixBPE:
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def _apply(docs: DataFrame, id_col: str, text_col: str, path: str, schema: str, row) -> DataFrame:
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    fields = extend(narrow.select(id_col).schema, schema)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch):
                rows = [row(bpe, t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), *[pa.array(c) for c in zip(*rows, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=fields.fieldNames())

    return narrow.mapInArrow(run, fields)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit), their number, and the decoded text of every row.

    A null or empty text has no ids and decodes to the empty string. Rows that
    repeat stay as they are; other columns are not returned.
    """

    def row(bpe: PrefixBPE, text: str):
        ids = bpe.encode(text)
        return ids, len(ids) // 4, bpe.decode(ids).decode()

    return _apply(docs, id_col, text_col, path, ENCODED, row)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, but SHA-256 digests of ids and decoded text in place of both.

    Digests are taken where the ids are made, so neither ids nor texts leave the worker.
    """

    def row(bpe: PrefixBPE, text: str):
        ids = bpe.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _apply(docs, id_col, text_col, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
