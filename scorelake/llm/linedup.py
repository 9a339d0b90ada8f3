"""Repeated runs of lines, found by a suffix array over line ids and deleted but for their first copy.

Documents are sequences of line ids, blank lines left out. Prefix doubling ranks
the suffixes: the rank of a suffix by its first 2h lines is that of the pair of
ranks by h lines, its own and the one h lines on; ranks are numbered in the
order of the pairs, and a suffix that no other shares is settled and drops out.
Suffixes that agree on a run of m lines form one interval of the suffix array
(longest common prefix of at least m); with h the greatest power of two up to m,
it is known by the ranks at the run's start and h lines before its end.

A run counts when it has at least ``min_words`` words. Every line of a maximal
repeated run lies in a repeated run that is just long enough and ends or starts
there, so it suffices to look at the shortest such run from each line forwards
and from each line backwards: their union is the maximal runs. Lines of a run
are deleted where an earlier copy exists; by induction the first copy of every
line stays.

DataFrame operations only. A line that a third of all rows share is one row once
ids are counted (sums are built before the exchange), and joins back to it are
skewed on one side only, which Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored
from .common import marked

MIN_WORDS = 50
#: Tasks that share the copies of one run.
SALTS = 16


def _text_key(text: Column) -> Column:
    """128 bits of a text: hashes of it behind two different prefixes."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _is_blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers in the order of ``by``, with gaps; stored, because they must not change."""
    ordered = distinct.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut_lineage(ordered.withColumn(name, F.monotonically_increasing_id()))


def _repeated(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Ordered numbers of the values of ``by`` that more than one row has."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return _numbered(counted, by, name)


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated lines with the shortest long enough run from each line forwards and backwards.

    Each stretch gets a closing row. ``first`` and ``last`` are line numbers of
    the text, ``k`` and ``m`` place and length among its lines that aren't blank.
    """
    in_doc = Window.partitionBy("d").orderBy("k")
    lines = lines.withColumn("q", F.col("k") - F.row_number().over(in_doc))
    whole = Window.partitionBy("d", "q")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"before": F.coalesce(F.sum("words").over(upto), F.lit(0)), "total": F.sum("words").over(whole), "end_k": F.max("k").over(whole), "end_pos": F.max("pos").over(whole), "prev_pos": F.max("pos").over(upto)})
    lines = lines.where(F.col("total") >= min_words)
    # The closing row stands behind the last line.
    here = F.struct("k", "pos", "prev_pos", "before", "rank")
    closing = F.struct((F.col("k") + 1).alias("k"), F.lit(None).cast("int").alias("pos"), F.col("pos").alias("prev_pos"), F.col("total").alias("before"), F.lit(None).cast("bigint").alias("rank"))
    rows = F.when(F.col("k") == F.col("end_k"), F.array(here, closing)).otherwise(F.array(here))
    lines = lines.select("d", "q", F.explode(rows).alias("r")).select("d", "q", "r.*")
    # Places with at least so many words between: a growing frame, forwards and backwards.
    behind = whole.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    ahead = whole.orderBy("before").rangeBetween(Window.unboundedPreceding, -min_words)
    until, since = F.min(F.struct("k", "prev_pos")).over(behind), F.max(F.struct("k", "pos")).over(ahead)
    return lines.withColumns({"until": until, "since": since})


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d, first, last``: line numbers of each later copy of a repeated run, a stored table.

    ``lines`` has a document number ``d`` in document order, the place ``k``
    among its lines that aren't blank, the line number ``pos``, ``words``, and
    the line's ``key``.
    """
    ids = _repeated(lines, ["key"], "rank")
    known = lines.join(ids, "key").select("d", "k", "pos", "words", "rank")
    places = cut_lineage(_stretches(known, min_words))
    forwards = places.where("until is not null").select("d", "k", (F.col("until.k") - F.col("k")).alias("m"), F.col("pos").alias("first"), F.col("until.prev_pos").alias("last"))
    backwards = places.where("since is not null").select("d", F.col("since.k").alias("k"), (F.col("k") - F.col("since.k")).alias("m"), F.col("since.pos").alias("first"), F.col("prev_pos").alias("last"))
    runs = cut_lineage(forwards.unionByName(backwards).distinct())
    drop_stored(ids)
    longest = runs.agg(F.max("m")).first()[0] or 0

    stored = [places, runs]
    ranks, h, met = places.where("rank is not null").select("d", "k", "rank"), 1, []
    while h <= longest:
        # Runs of h up to 2h - 1 lines: the ranks at both ends tell them apart.
        start = ranks.withColumnRenamed("rank", "a")
        finish = ranks.select("d", F.col("k").alias("_e"), F.col("rank").alias("b"))
        of_size = runs.where(F.col("m").between(h, 2 * h - 1)).join(start, ["d", "k"]).withColumn("_e", F.col("k") + F.col("m") - h)
        met.append(of_size.join(finish, ["d", "_e"]).select("m", "a", "b", "d", "k", "first", "last"))
        if 2 * h <= longest:
            in_doc = Window.partitionBy("d").orderBy("k")
            on = F.when(F.lead("k", h).over(in_doc) == F.col("k") + h, F.lead("rank", h).over(in_doc))
            pairs = cut_lineage(ranks.withColumn("on", on).where("on is not null"))
            following = _repeated(pairs, ["rank", "on"], "next")
            ranks = cut_lineage(pairs.join(following, ["rank", "on"]).select("d", "k", F.col("next").alias("rank")))
            drop_stored(pairs, following)
            stored.append(ranks)
        h *= 2
    if not met:
        later = cut_lineage(runs.select("d", "first", "last"))
        drop_stored(*stored)
        return later
    occurrences = cut_lineage(reduce(DataFrame.unionByName, met))
    drop_stored(*stored)
    interval = ["m", "a", "b"]
    least = occurrences.groupBy(*interval).agg(F.min(F.struct("d", "k")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A run that a third of all documents share is met in as many tasks as there are salts.
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = occurrences.withColumn("salt", F.pmod(F.xxhash64("d", "k"), F.lit(SALTS)).cast("int"))
    later = dealt.join(least, [*interval, "salt"]).where(F.struct("d", "k") > F.col("least"))
    later = cut_lineage(later.select("d", "first", "last"))
    drop_stored(occurrences)
    return later


def _merged(ranges: DataFrame) -> DataFrame:
    """``d, gone``: the union of a document's ranges, as sorted disjoint ones."""
    by_first = Window.partitionBy("d").orderBy("first", "last")
    reached = F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.distinct().withColumn("_new", F.when(F.col("first") <= reached + 1, 0).otherwise(1))
    islands = opened.withColumn("_i", F.sum("_new").over(by_first.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("d", "_i").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # One entry for each deleted run of one document.
    return runs.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone"))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Columns of ``docs`` in a struct ``doc``, the text that stays, and the number of lines ``removed``.

    Copies are ordered by ``id_col`` (null first), then by a hash of the text,
    then by place. Rows with the same id and text are one document, as often as
    it stands there. Words are what single spaces separate. Blank lines are kept,
    but for those inside a deleted run. A null text stays null with nothing
    removed; a text of which nothing stays is empty. Texts are exchanged only
    where a bitmap of those with deleted lines doesn't tell that all of it stays.
    """
    text = F.col(f"`{text_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    packed = packed.withColumn("_th", F.xxhash64("_text"))
    lines = F.split("_text", "\n")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    noted = F.transform(lines, lambda x, i: F.when(~_is_blank(x), F.struct(i.alias("pos"), (spaces(x) + 1).alias("words"), _text_key(x).alias("key"))))
    sequences = packed.where("_text is not null").select("_id", "_th", F.filter(noted, lambda x: x.isNotNull()).alias("lines"))
    sequences = _numbered(sequences.dropDuplicates(["_id", "_th"]), ["_id", "_th"], "d")
    flat = sequences.select("d", F.posexplode("lines").alias("k", "l")).select("d", "k", "l.pos", "l.words", "l.key")
    runs = repeated_runs(flat, min_words)
    gone = cut_lineage(sequences.select("d", F.col("_id").alias("_gid"), F.col("_th").alias("_gth")).join(_merged(runs), "d").drop("d"))
    drop_stored(sequences, runs)
    listed = gone.select("_gth")
    some = marked(packed, "_th", listed)
    matched = some.join(gone, some["_id"].eqNullSafe(gone["_gid"]) & (some["_th"] == gone["_gth"]), "left")
    matched = matched.unionByName(marked(packed, "_th", listed, others=True), allowMissingColumns=True)
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["last"] + 1))
    ends = F.concat(F.transform("gone", lambda g: g["first"]), F.array(F.size(lines)))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(lines, z["s"] + 1, z["e"] - z["s"]))
    stays = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    removed = F.aggregate(F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("bigint"), lambda n, g: n + g["last"] - g["first"] + 1)
    return matched.select("doc", stays.alias("text"), removed.alias("removed"))
