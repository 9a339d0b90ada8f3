"""What the operators of this subpackage share: worker set-up, bounded memos, whole-text token ids."""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

#: Rows of one Arrow batch, and of one batch read from Parquet. Texts may be very long, so batches are kept short.
BATCH_ROWS = 512
#: Entries of a memo's young generation; the old generation holds as many again.
MEMO_ENTRIES = 300_000
#: Longer keys are computed anew, so that a memo's bytes are bounded too.
MEMO_KEY_CHARS = 64
#: Longs of the bitmap of :func:`marked`: 4 million bits, 1 MB as rows. Executors hold many of these at a time.
MARK_LONGS = 1 << 16


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep batches short, Arrow's and Parquet's (larger settings of the user are lowered).

    Spark's default of 4096 rows takes arrays of many MB for a column of texts or
    shingles, anew for each file, and an executor's heap grows with them.
    """
    ship_package(spark)
    for rows in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(rows)) > BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extend(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the fields of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def marked(rows: DataFrame, key: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose 64-bit hash ``key`` is marked in a bitmap of the hashes in ``wanted`` (one column); with ``others`` all the rest.

    Every row with a wanted hash is marked, and some without one, so an exact
    join must follow. The bitmap is bounded and goes to the rows, which don't
    cross the network for this: wide rows, few of them wanted, are thinned out
    before they are exchanged. Beyond about as many hashes as bits it thins no more.
    """
    bits = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(x).bitwiseAND(F.lit(63)).cast("int"))
    place = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(MARK_LONGS - 1))
    hashes = wanted.toDF("_hash")
    bitmap = hashes.select(place("_hash").alias("_place"), bits("_hash").alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    hit = (place(key) == F.col("_place")) & (F.col("_bits").bitwiseAND(bits(key)) != 0)
    return rows.join(F.broadcast(bitmap), hit, "left_anti" if others else "left_semi")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


class Memo(dict):
    """A memo of two generations: when the young one is full it becomes the old one.

    Often used keys move back into the young generation, so at most twice
    ``entries`` values are held however many distinct keys pass.
    """

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_KEY_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Where a byte-level pre-tokeniser always starts a new piece: a space before a visible character.
_BEFORE_WORD = re.compile(r" (?=\S)")
#: Python counts these as white space, the tokenizers library does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Letters, numbers and white space among the first 256 code points, for classes of characters below.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokenisers' patterns as they act on texts of these code points only.
WORD_PIECES = re.compile(f"{_SUFFIXES}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
SPACED_PIECES = re.compile(f"{_SUFFIXES}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")

#: The letter that spells each byte in byte-level vocabularies: itself where it is printable, else one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted({*range(256)} - {*_PRINTABLE})
_BYTE_LETTERS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))
#: Whether all characters but spaces spell themselves.
_PLAIN = re.compile("[ -~]*").fullmatch


def is_latin(text: str) -> bool:
    """Whether all code points are below 256: composed already, and lowered one by one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class TextEncoder:
    """Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit bytes.

    A text is cut only where the tokenizer's own pre-tokeniser always cuts: into
    its pieces where all code points are below 256, else at white space for
    vocabularies that drop it and before " x" for byte-level ones. Each distinct
    piece is encoded by the library once and remembered in a bounded memo; one
    below 256 by its BPE model alone, as it needs no more cutting. A tokenizer of
    any other shape gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = self._rule(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.library.model if self.cut != "whole" and self._bytes_last(spec) else None
        self.memo = Memo(self._encode)

    @staticmethod
    def _rule(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        plain = not spec.get("truncation") and not spec.get("padding") and not spec.get("post_processor")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            return "whole"
        if plain and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
            return "words"
        if plain and len(steps) == 1 and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "spaces"
        return "whole"

    @staticmethod
    def _bytes_last(spec: dict) -> bool:
        """Whether the pre-tokeniser's last step spells bytes, without a space before, and a BPE model follows."""
        last = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])[-1]
        return last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and spec["model"].get("type") == "BPE"

    def _encode_piece(self, piece: str) -> bytes:
        spelled = piece.replace(" ", _BYTE_LETTERS[32]) if _PLAIN(piece) else charmap_decode(piece.encode(), "strict", _BYTE_LETTERS)[0]
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _encode(self, chunk: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.cut != "whole" and is_latin(text) and not any(t in text for t in self.special):
            chunks: Iterable[str] = WORD_PIECES.findall(text.lower()) if self.cut == "words" else SPACED_PIECES.findall(text)
            # A chunk that is also a piece has the same ids either way, so both share the memo.
            self.memo.compute = self._encode_piece if self.model else self._encode
        elif self.cut == "words" and not _SEPARATORS.search(text):
            chunks, self.memo.compute = text.split(), self._encode
        elif self.cut == "spaces":
            first, *rest = _BEFORE_WORD.split(text)
            chunks, self.memo.compute = [first, *[" " + x for x in rest]], self._encode
        else:
            return self._encode(text)
        return b"".join(map(self.memo.__getitem__, chunks))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def slices(batch, rows: int = 64) -> Iterator:
    """An Arrow batch in short slices, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
