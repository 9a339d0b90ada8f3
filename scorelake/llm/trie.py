"""Prefix trie of conversations by vertical bitmaps.

Conversations in the order of their ids form shards. In a shard, an index maps
(position, turn) to the bitset of conversations that have that turn there. Depth
first from the root, a node's bitset is intersected with the postings of the next
position: each intersection is a child, its population count the child's
conversations of this shard, and the conversations that end there its end list.
Local nodes of all shards are summed by the key of their path, the exclusive or
of 128-bit hashes of (position, turn).

Long conversations are cut into bands of positions, each a task of its own; a
band starts from the keys of the paths before it. So neither a hot turn nor a
conversation with most of the rows gathers in a task.

Sums over subtrees come from bitsets as well. A node belongs to its smallest
member, and what a conversation owns is the tail of its path. Hence the subtree
of a node holds all that its other members own, and what its smallest member owns
from the node's depth on: a weighted population count minus a running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import running_before, running_xor_before, with_row_index
from ..session import cut_lineage, drop_stored
from .common import prepare

#: Conversations of a shard, positions of a band, and local nodes that are weighed in one task.
SHARD, BAND, WEIGHED = 512, 64, 20_000

KEY = ["depth", "key1", "key2"]
_LOCAL = "depth bigint, key1 bigint, key2 bigint, up1 bigint, up2 bigint, n bigint, least bigint, bytes bigint, shard bigint, members binary, ends array<bigint>"


def turn_table(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, turn1, turn2, bytes``: position from 1, a 128-bit hash of role and text, and the text's UTF-8 bytes.

    Turns are ordered by ``turn_col`` (null first), equal ones by role and text;
    null role or text is empty. Repeated rows are turns of their own; rows
    without an id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("at"), role.alias("role"), text.alias("text"))
    hashes = [F.xxhash64(F.lit(lane), "role", "text").alias(f"turn{lane}") for lane in (1, 2)]
    rows = rows.select("*", *hashes, F.octet_length("text").cast("bigint").alias("bytes"))
    order = [F.col("at").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    numbered = with_row_index(rows, order, ["conv_id"], "pos", keep=["conv_id", "turn1", "turn2", "bytes"])
    return numbered.withColumn("pos", F.col("pos") + 1)


def with_shared_heads(turns: DataFrame, every: int, heads: int) -> DataFrame:
    """Conversations with the head of another one before their own later turns.

    Conversation c gets the first h turns of c - c % ``every`` (all if fewer,
    none if absent), then its own after the first h; h is the CRC-32 of c's
    decimal digits modulo ``heads``.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    known = lengths.select("conv_id", share.alias("share"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = lengths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.least("length", F.lit(heads - 1)).alias("there"))
    # Stored, so that Spark knows its size: one row for each conversation.
    known = cut_lineage(known.join(bases, "base", "left").withColumn("taken", F.least("share", F.coalesce("there", F.lit(0)))).drop("there"))
    lent = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    head = known.join(lent, "base").where(F.col("pos") <= F.col("share")).select(*turns.columns)
    tail = turns.join(known, "conv_id").where(F.col("pos") > F.col("share"))
    return head.unionByName(tail.withColumn("pos", F.col("pos") - F.col("share") + F.col("taken")).select(*turns.columns))


class _Unit:
    """The rows of one band of one shard."""

    def __init__(self, shard: int, rows: np.ndarray) -> None:
        self.shard = shard
        self.local, pos, one, two, self.bytes, length, conv = rows
        self.first = int(pos[pos >= 0].min(initial=np.iinfo(np.int64).max))
        self.conv = dict(zip(self.local.tolist(), conv.tolist(), strict=True))
        turns = np.flatnonzero(pos >= 0)
        # Equal turns of a position next to each other: a posting each.
        order = turns[np.lexsort((self.local[turns], two[turns], one[turns], pos[turns]))]
        where = pos[order], one[order], two[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in where])
        starts = np.flatnonzero(new)
        self.keys = list(zip(one[order][starts].tolist(), two[order][starts].tolist(), strict=True))
        self.sizes = self.bytes[order][starts].tolist()
        self.bits = [_bitset(x) for x in np.split(self.local[order], starts[1:])] if len(order) else []
        levels = int(pos.max(initial=0)) - self.first + 1 if len(order) else 0
        self.posting = np.full((levels, SHARD), -1, dtype=np.int64)
        self.posting[pos[order] - self.first, self.local[order]] = np.cumsum(new) - 1
        self.posting = self.posting.tolist()
        self.here = [0] * levels
        self.ended = [0] * levels
        for at, bits in zip((pos[order][starts] - self.first).tolist(), self.bits, strict=True):
            self.here[at] |= bits
        stop = pos[order] == length[order]
        for at in np.unique(pos[order][stop]).tolist():
            self.ended[at - self.first] = _bitset(self.local[order][stop & (pos[order] == at)])
        # Paths before the band, by their keys; before the first band there is none.
        before = pos < 0
        self.roots: dict[tuple[int, int], int] = {}
        for key, local in zip(zip(one[before].tolist(), two[before].tolist(), strict=True), self.local[before].tolist(), strict=True):
            self.roots[key] = self.roots.get(key, 0) | 1 << local
        if not before.any():
            self.roots = {(0, 0): -1}

    def nodes(self) -> Iterator[tuple]:
        stack = [(bits, 0, key) for key, bits in self.roots.items()]
        while stack:
            parent, level, (up1, up2) = stack.pop()
            if level == len(self.here):
                continue
            rest = parent & self.here[level]
            while rest:
                low = (rest & -rest).bit_length() - 1
                posting = self.posting[level][low]
                child = rest & self.bits[posting]
                rest ^= child
                one, two = self.keys[posting]
                key = (up1 ^ one, up2 ^ two)
                ended = child & self.ended[level]
                ends = [self.conv[i] for i in _members(ended)] if ended else None
                yield (self.first + level, *key, up1, up2, child.bit_count(), self.conv[low], self.sizes[posting], self.shard, _packed(child), ends)
                stack.append((child, level + 1, key))


def _bitset(members: np.ndarray) -> int:
    flags = np.zeros(SHARD, dtype=bool)
    flags[members] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int) -> list[int]:
    raw = np.frombuffer(bits.to_bytes(-(-SHARD // 8), "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def _packed(bits: int) -> bytes:
    """A bitset as a list of 16-bit places, or as it is where that is shorter."""
    if bits.bit_count() * 16 >= SHARD:
        return bits.to_bytes(-(-SHARD // 8), "little")
    if bits & (bits - 1) == 0:
        return (bits.bit_length() - 1).to_bytes(2, "little")
    return np.array(_members(bits), dtype="<u2").tobytes()


def _places(packed: bytes) -> np.ndarray:
    if len(packed) * 8 >= SHARD:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little"))
    return np.frombuffer(packed, dtype="<u2")


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (shard, band): the nodes of each unit."""
    names = [f.split()[0] for f in _LOCAL.split(", ")]
    kinds = [*[pa.int64()] * 9, pa.binary(), pa.list_(pa.int64())]
    key, parts = None, []

    def made() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node in _Unit(key[0], np.concatenate(parts, axis=1)).nodes() if parts else ():
            out.append(node)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy() for c in ("shard", "band", "local", "pos", "x1", "x2", "bytes", "length", "conv_id")])
        cuts = [0, *(np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = (int(columns[0, s]), int(columns[1, s]))
            if now != key:
                yield from made()
                key, parts = now, []
            parts.append(columns[2:, s:e])
    yield from made()


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (shard, part, kind): what the members of each node own, from the weights of the shard."""
    key, weights, leaves = None, np.zeros(SHARD, dtype=np.int64), np.zeros(SHARD, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            few = batch.slice(s, e - s)
            if key != (shard[s], part[s]):
                key, weights, leaves = (shard[s], part[s]), np.zeros(SHARD, dtype=np.int64), np.zeros(SHARD, dtype=np.int64)
            if kind[s] == 0:
                at = few.column("local").to_numpy()
                weights[at], leaves[at] = few.column("weight").to_numpy(), few.column("leaf").to_numpy()
                continue
            places = [_places(x) for x in few.column("members").to_pylist()]
            sums = [pa.array([int(w[p].sum()) for p in places], pa.int64()) for w in (weights, leaves)]
            yield pa.RecordBatch.from_arrays([*[few.column(c) for c in KEY], *sums], names=[*KEY, "below", "leaves"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (node, shard): the hash of all ids that end at the node, fed as they pass."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ends"]), strict=True):
            if now != key:
                if key is not None:
                    yield done()
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
    if key is not None:
        yield done()


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, from the empty one on.

    ``turns`` as of :func:`turn_table`; ``conversations`` has every ``conv_id``,
    so those without turns count at the root. Columns: ``conv_id`` (smallest
    member), ``depth, parent_conv_id`` (null at the root), ``n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. ``saved_tokens`` sums (conversations
    - 1) x bytes of the last text over a subtree; ``ends_sha256`` is over the
    comma-joined ids that end there, in ascending order. Paths of any length are
    followed. Repeated ids are one conversation, null ones none; without
    conversations there is no node.
    """
    prepare(turns.sparkSession)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    ids = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    ids = ids.join(lengths, "conv_id", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("bigint")))
    ranked = with_row_index(ids, [F.col("conv_id").asc()], name="rank")
    shards = cut_lineage(ranked.select("conv_id", "length", F.floor(F.col("rank") / SHARD).alias("shard"), (F.col("rank") % SHARD).alias("local")))

    lanes = [F.xxhash64(F.lit(lane), "pos", "turn1", "turn2").alias(f"x{lane}") for lane in (1, 2)]
    rows = turns.select("conv_id", "pos", F.floor(F.col("pos") / BAND).alias("band"), *lanes, "bytes").join(shards, "conv_id")
    drop_stored(ranked)
    # The root is a turn that all have, at position 0.
    zero = F.lit(0).cast("bigint")
    roots = shards.select("*", zero.alias("pos"), zero.alias("band"), zero.alias("x1"), zero.alias("x2"), zero.alias("bytes"))
    folded = rows.where(F.col("length") >= BAND).groupBy("conv_id", "band", "shard", "local", "length").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    chained = running_xor_before(folded, ["conv_id"], [F.col("band").asc()], ["x1", "x2"])
    before = chained.where("band > 0").select("conv_id", "band", "shard", "local", "length", F.col("prev_x1").alias("x1"), F.col("prev_x2").alias("x2"), F.lit(-1).cast("bigint").alias("pos"), zero.alias("bytes"))
    units = rows.unionByName(roots).unionByName(before).repartition("shard", "band").sortWithinPartitions("shard", "band")
    local = cut_lineage(units.mapInArrow(_local_nodes, _LOCAL))

    drop_stored(chained)
    # Counts of a node and of its children meet in one aggregation.
    parts = local.select(*KEY, "up1", "up2", "n", "least", "bytes")
    merged = parts.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("bytes").alias("bytes"), F.max(F.struct("up1", "up2")).alias("up"))
    merged = cut_lineage(merged)
    children = merged.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up.up1").alias("key1"), F.col("up.up2").alias("key2"))
    children = children.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.unionByName(children, allowMissingColumns=True).groupBy(*KEY)
    nodes = cut_lineage(nodes.agg(*[F.max(c).alias(c) for c in ("n_convs", "conv_id", "bytes", "up")], F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children")))
    drop_stored(merged)

    # What conversations own: values of nodes that several share, and leaves.
    shared = nodes.where("n_convs > 1").select(*KEY, "conv_id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    owned = shared.groupBy("conv_id").agg(F.sum("value").alias("weight"))
    leaf = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("bigint").alias("leaf"))
    weights = owned.unionByName(leaf, allowMissingColumns=True).groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("weight", "leaf")])
    weights = weights.join(shards, "conv_id").select("shard", "local", "weight", "leaf")
    lists = cut_lineage(local.select(*KEY, "shard", "members").join(shared.select(*KEY), KEY))
    sizes = lists.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / WEIGHED).cast("int").alias("parts"))
    dealt = lists.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("key1", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    copies = weights.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = copies.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    below = met.mapInArrow(_weigh, "depth bigint, key1 bigint, key2 bigint, below bigint, leaves bigint")
    below = below.groupBy(*KEY).agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    upto = running_before(shared, ["conv_id"], [F.col("depth").asc()], "value")
    above = upto.select(*KEY, F.coalesce("prev_sum", F.lit(0)).alias("above"))

    ends = local.where("ends is not null").select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    hashed = ends.mapInArrow(_hash_ends, "depth bigint, key1 bigint, key2 bigint, ends_sha256 string")
    found = nodes
    for more in (below, above, hashed):
        found = found.unionByName(more, allowMissingColumns=True)
    found = cut_lineage(found.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in found.columns if c not in KEY]))
    drop_stored(local, lists, nodes, shards, upto)
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    children = found.withColumns({"up1": F.when(F.col("depth") > 0, F.col("up.up1")), "up2": F.when(F.col("depth") > 0, F.col("up.up2"))})
    return children.join(parents, ["depth", "up1", "up2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        # A path of one conversation has one leaf and saves nothing.
        F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        F.coalesce(F.col("below") - F.col("above"), F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
