"""Language by rank-order profiles of character n-grams.

A language's profile is the rank of its most frequent n-grams over all training
texts; a document's is made alike from its whole text. The out-of-place measure
sums, over the document's n-grams, how far each is from its place in the
language's profile, and the greatest distance for those the profile lacks.

N-grams are counted within words (``_word_``). A text is an array of code points,
with one border between words, and its n-grams are numbers made from neighbours
in that array, so a whole text is cut and counted at once. Equal counts share a
rank, so no order of ties is needed and the result doesn't depend on how rows are
dealt out.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extend, prepare, slices

UNKNOWN = "und"
#: N-grams of a profile. A learned model has at most this many rows for each language.
PROFILE_SIZE = 400
MAX_N = 3
#: Counts of n-grams that a worker holds at most before it sums them up, and sums before it passes them on.
HELD = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(1, MAX_N + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter of :data:`_WORD`."""
    return np.fromiter((_WORD.match(chr(c)) is not None for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


#: Bits of a code point; a border is 0.
_POINT = 21


def gram_codes(text: str) -> np.ndarray:
    """A number for each n-gram of :func:`grams_of` of each word of a text; see :func:`gram_of`."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    line = np.zeros(len(points) + 2, dtype=np.int64)
    line[1:-1] = np.where(_letters()[points], points, 0)
    # Of several borders in a row one stays.
    kept = np.ones(len(line), dtype=bool)
    kept[1:] = (line[1:] != 0) | (line[:-1] != 0)
    line = line[kept]
    pairs = -1 - (line[:-1] << _POINT | line[1:])
    inner = line[1:-1] != 0
    triples = (line[:-2] << 2 * _POINT | line[1:-1] << _POINT | line[2:])[inner]
    return np.concatenate([line[line != 0], pairs if len(line) > 1 else pairs[:0], triples])


def gram_of(code: int) -> str:
    """The n-gram of a number: pairs are negative, and a triple's middle is never a border."""
    if code < 0:
        points = [(-1 - code) >> _POINT, (-1 - code) & ((1 << _POINT) - 1)]
    elif code >> _POINT:
        points = [code >> k * _POINT & ((1 << _POINT) - 1) for k in (2, 1, 0)]
    else:
        points = [code]
    return "".join(chr(p) if p else "_" for p in points)


def code_of(gram: str) -> int:
    points = [0 if c == "_" else ord(c) for c in gram]
    if len(points) == 2:
        return -1 - (points[0] << _POINT | points[1])
    return sum(p << k * _POINT for k, p in enumerate(reversed(points)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    sums = np.zeros(len(codes), dtype=np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return codes, sums


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, gram, rank`` from every row whose text and language are not null.

    Workers pass on sums for each n-gram, not texts, so what is exchanged grows
    with distinct n-grams. N-grams that tie for the last rank are all kept.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    narrow = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sum_up() -> int:
            for lang, parts in held.items():
                held[lang] = [_summed(parts)]
            return sum(len(parts[0][0]) for parts in held.values())

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, sums = _summed(parts)
                arrays = [pa.array([lang] * len(codes), pa.string()), pa.array(map(gram_of, codes.tolist()), pa.string()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for few in slices(batch):
                for lang, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, []).append(np.unique(gram_codes(text), return_counts=True))
                    size += len(held[lang][-1][0])
                if size > HELD:
                    size = sum_up()
                    if size > HELD // 2:
                        yield from passed_on()
                        size = 0
        yield from passed_on()

    counts = narrow.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    return ranked.where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank"))


class Profiles:
    """Learned profiles, ready to measure documents against all languages at once."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int = PROFILE_SIZE) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.learned = np.unique(np.array([code_of(gram) for _, gram, _ in rows], dtype=np.int64))
        # A gram that a profile lacks stands so far off that the greatest distance is reached.
        self.ranks = np.full((len(self.langs), len(self.learned) + 1), 10 * size, dtype=np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[at[lang], np.searchsorted(self.learned, code_of(gram))] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its distance as a share of the greatest possible one.

        ``und`` and 0 where the text is null or has no letter, or nothing was
        learned; languages at the same distance are taken in alphabetical order.
        """
        codes, own = np.unique(gram_codes(text or ""), return_counts=True)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        # Place of an n-gram: how many have a greater count.
        levels, level, many = np.unique(own, return_inverse=True, return_counts=True)
        place = (len(own) - np.cumsum(many))[level]
        top = place < self.size
        column = np.searchsorted(self.learned, codes[top])
        lacking = self.learned[np.minimum(column, len(self.learned) - 1)] != codes[top]
        column[lacking] = len(self.learned)
        apart = np.minimum(np.abs(self.ranks[:, column] - place[top]), self.size)
        distance = apart.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(column)))


def predict_languages(docs: DataFrame, profiles: DataFrame, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, in one struct ``doc``, beside the predicted language and its score.

    The struct keeps columns of any name apart from the two new ones. Only the
    text is read for the prediction. The profiles are collected: at most
    ``PROFILE_SIZE`` rows (and ties) for each language.
    """
    prepare(docs.sparkSession)
    rows = [tuple(r) for r in profiles.select("lang", "gram", "rank").collect()]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("_text"))
    name, score = out
    fields = extend(packed.select("doc").schema, f"{name} string, {score} double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(rows)
        for batch in batches:
            for few in slices(batch):
                found = [model.predict(t) for t in few.column(1).to_pylist()]
                arrays = [few.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", name, score])

    return packed.mapInArrow(run, fields)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of documents that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
