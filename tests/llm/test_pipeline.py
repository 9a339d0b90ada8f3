"""The pipeline's stages one after another on small documents."""

import struct

from fixtures import documents, prose

import corpus_pipeline as pipeline
from scorelake.llm import common
from scorelake.llm.queries import vocabulary


def test_stages_in_order(spark):
    from tokenizers import Tokenizer

    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, prose(i, 120, "fr" if i % 2 else "en"), "fr" if i % 2 else "en") for i in range(12)]
    rows += [(20, rows[0][1], "en"), (21, f"{prose(50, 30)}\n{shared}\n{prose(51, 30)}", "en"), (22, f"{prose(52, 40)}\n{shared}", "en")]
    rows += [(23, "!!! ???", None), (24, None, "en"), (25, f"{prose(53, 60)}\nwrite to a.b@c.example.org now", "en")]
    # Too short for a run of lines, but the same but for case.
    rows += [(26, "a short text that is there twice in the house of stone", "en"), (27, "A SHORT text that is there twice in the house of stone", "en")]
    docs = documents(spark, rows, clashing=False).selectExpr("*", "'s' as source", "cast(length(text) as bigint) as n_chars")
    kept = {}
    current = docs
    for name, stage in pipeline.STAGES[:-1]:
        current = pipeline.cut_lineage(stage(spark, current, ""))
        assert current.columns == docs.columns
        kept[name] = {r.doc_id: r for r in current.collect()}
        assert len(kept[name]) == current.count() and all(r.n_chars == len(r.text) for r in kept[name].values())
    everyone = {r[0] for r in rows}
    assert kept["language"].keys() == everyone - {23, 24}
    assert kept["line dedup"].keys() == everyone - {23, 24, 20}
    assert shared in kept["line dedup"][21].text and kept["line dedup"][22].text == prose(52, 40)
    assert kept["near dedup"].keys() == everyone - {23, 24, 20, 27}
    assert kept["personal data"][25].text.endswith("write to [EMAIL] now")
    assert all(kept["personal data"][i].text == rows[i][1] for i in range(12))
    pieces = pipeline.STAGES[-1][1](spark, current, "").collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for doc_id, r in kept["personal data"].items():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == struct.pack(f"<{len(ids)}I", *ids)


def test_stages_of_nothing(spark):
    docs = documents(spark, [], clashing=False).selectExpr("*", "'s' as source", "cast(0 as bigint) as n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut_lineage(stage(spark, docs, ""))
    assert pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_stages_read_texts_in_short_batches(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    docs = documents(spark, [(1, prose(1, 80), "en"), (2, prose(2, 80), "en")], clashing=False).selectExpr("*", "'s' as source", "cast(length(text) as bigint) as n_chars")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        assert pipeline.repeated_lines(spark, docs, "").count() == 2
        assert int(spark.conf.get(key)) == common.BATCH_ROWS
        # A smaller setting of the user stays.
        spark.conf.set(key, "100")
        common.prepare(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
