"""Small documents with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql.types import StructType

WORDS = {
    "en": "the of and to in is that house water light morning river stone paper garden window".split(),
    "fr": "le la les de des et que maison eau lumière matin rivière pierre papier jardin fenêtre".split(),
}
#: Columns whose names the operators use inside.
CLASHING = "doc string, _text string, key bigint, node bigint, fp bigint, d bigint, kind int, text_2 string, removed bigint, score double"


def prose(seed: int, words: int, lang: str = "en", line: int = 12) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS[lang]) + (str(rng.randrange(300)) if rng.random() < 0.3 else "") for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, words, line))


def awkward_rows() -> list[tuple]:
    a, b = prose(1, 150), prose(2, 140, "fr")
    return [
        (1, a, "en"), (2, a, "en"), (3, b, "fr"), (3, b, "fr"), (4, None, "en"), (5, "", None), (None, prose(3, 80), "en"),
        (None, None, None), (6, " \n\t ", "fr"), (7, prose(4, 6000), "en"), (8, "!!! ... ???", "en"), (9, a + "\n" + b, "en"),
        (10, "Mail a.b@c.example.org or +1 (234) 567-8901, 4111 1111 1111 1111 from 10.0.0.256 and 10.0.0.25.", "en"),
        (11, "naïve Σίσυφος İstanbul œuvre 日本語 \U0001f600 <|endoftext|> it's", None), (12, "x" * 5000, "en"), (13, "one", "en"),
    ]


def documents(spark, rows=None, clashing: bool = True):
    rows = awkward_rows() if rows is None else rows
    schema = StructType.fromDDL("doc_id bigint, text string, lang string")
    docs = spark.createDataFrame(rows, schema)
    if clashing:
        for name, kind in (c.split() for c in CLASHING.split(", ")):
            docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
    return docs
