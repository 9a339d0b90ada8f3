"""The operators applied to whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..session import scratch_path
from . import alignment, bpe, dac, langid, linedup, multiindex, packing, pages, pii, simhash, spotsigs, topk, trie
from .common import table

catalog = Catalog()


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; workers open the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@catalog.query("op1_bpe_prefix_dp")
def op1(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@catalog.query("op2_concat_and_cut")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@catalog.query("op6_addressable_codes")
def op6(spark, sf_dir):
    out = scratch_path(spark, "tokens")
    dac.write_token_files(table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"), end_id=0)
    return dac.digest_token_files(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


@catalog.query("op8_rank_order_profiles")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    found = langid.predict_languages(docs.select("doc_id", "text"), profiles)
    split = found.select("doc.doc_id", "lang_pred", "score")
    return split.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@catalog.query("op10_disclosure_terms")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, "text")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc.doc_id", *counts, base, pii.spans_text(F.concat("base", "terms")).alias("spans"))


@catalog.query("op3_golay_simhash")
def op3(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=4, most=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@catalog.query("op9_multi_index")
def op9(spark, sf_dir):
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


_LINE_RUNS_SQL = """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM raw),
solid AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k,
         length(line) - length(replace(line, ' ', '')) + 1 AS words
  FROM lines WHERE trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM solid),
-- the shortest run of 50 words from each line forwards and backwards
ends AS (
  SELECT a.doc_id, a.k AS k, min(b.k) AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.k) AS k, a.k AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.k <= a.k AND a.upto - b.upto + b.words >= 50 GROUP BY a.doc_id, a.k),
runs AS (
  SELECT r.doc_id, r.k, r.e, string_agg(s.line, chr(10) ORDER BY s.k) AS body, min(s.pos) AS first, max(s.pos) AS last
  FROM ends r JOIN solid s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k AND r.e GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS copy FROM runs),
dead AS (SELECT DISTINCT l.doc_id, l.pos FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first AND r.last WHERE r.copy > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l
  LEFT JOIN dead x ON x.doc_id = l.doc_id AND x.pos = l.pos WHERE x.pos IS NULL GROUP BY l.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(g.n, 0)::BIGINT AS removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


@catalog.query("op4_line_runs", _LINE_RUNS_SQL)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.delete_repeated_lines(docs, min_words=50).select("doc.doc_id", "text", "removed")


@catalog.query("op7_min_cut_text")
def op7(spark, sf_dir):
    found = pages.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page.page_id", "page.url", "text", "n_chars")


@catalog.query("op5_spotsigs")
def op5(spark, sf_dir):
    return spotsigs.compare_with_edited(table(spark, sf_dir, "documents"))


# The checksum takes each digit's code, then eight shifts.
_PREFIX_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) % 9 AS h
  FROM t),
heads AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
taken AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(k.n, 0), t.role, t.text FROM t JOIN c ON c.conv_id = t.conv_id AND t.pos > c.h LEFT JOIN taken k ON k.conv_id = t.conv_id),
paths AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS p, list(strlen(text) ORDER BY pos) AS sizes FROM rebuilt GROUP BY conv_id),
whole AS (SELECT c.conv_id, coalesce(p, []) AS p, sizes FROM c LEFT JOIN paths ON paths.conv_id = c.conv_id),
members AS (SELECT conv_id, d, array_to_string(p[1:d], ',') AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, len(p) = d AS stops FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(bytes) AS saved,
         string_agg(CASE WHEN stops THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM members GROUP BY d, node),
up AS (SELECT n.d, n.node, p.node AS parent FROM nodes n JOIN members p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
fan AS (SELECT d - 1 AS d, parent AS node, count(*) AS children FROM up GROUP BY ALL),
below AS (
  SELECT a.d, a.node, sum(w.saved) AS saved, count(*) FILTER (f.children IS NULL) AS leaves
  FROM nodes w JOIN members a ON a.conv_id = w.conv_id AND a.d <= w.d LEFT JOIN fan f ON f.d = w.d AND f.node = w.node GROUP BY a.d, a.node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(f.children, 0)::BIGINT AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.node = n.node LEFT JOIN fan f ON f.d = n.d AND f.node = n.node
LEFT JOIN up u ON u.d = n.d AND u.node = n.node LEFT JOIN nodes p ON p.d = u.d - 1 AND p.node = u.parent
"""


@catalog.query("op12_vertical_bitmaps", _PREFIX_TRIE_SQL)
def op12(spark, sf_dir):
    turns = trie.turn_table(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_shared_heads(turns, every=5, heads=9), turns)


@catalog.query("op13_token_spans")
def op13(spark, sf_dir):
    return alignment.link_statistics(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


_TOP_PRODUCTS_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@catalog.query("op11_pivot_table", _TOP_PRODUCTS_SQL)
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_products(vectors.where("vec_id % 50 = 0"), vectors, k=5)
