"""Prefix trie of conversations: ternary search trees per range shard, merged along the shards' borders.

Turns get numbers from a dictionary, so that a conversation is a sequence of
numbers. Equal sequences are one row with their count and least conversation.
The distinct sequences are range-partitioned into shards in their order. A
shard inserts its sequences, the median first, into a ternary search tree:
an entry has a turn, the entries of smaller and larger turns at the same place,
and the entry below it, which holds the next turn. One walk with a stack, from
the last level up, adds up members, childless nodes and savings.

Only a node on the path of a shard's first or last sequence can also stand in
another shard. These boundary nodes are known by a digest of their path. What
hangs below them within a shard is summed there; their own members are merged by
digest, and the sums of their subtrees by pointer jumping over the small table of
boundary nodes: after k rounds a node has the sum of the 2^k levels below it.

Conversations that end at a node are hashed in the order of their ids. The ids
are sorted and joined in runs over all tasks, a large group in many; one
task then feeds the runs of a group into one digest, as SHA-256 demands.

Positions of turns come from one range sort, so that a conversation with many turns is
spread over tasks. Sequences are cut into segments of SEGMENT turns. A segment hangs below its
anchor, the node of all turns before it, which is known by a polynomial hash of the
earlier segments, a running sum over one narrow row per segment. Each anchor is the root of a tree of its
own; as a subtree goes on in the next segment's tree, the nodes on the way to a whole
segment's end are boundary nodes like the others. No row holds more than a segment, no task
more than a shard of some SHARD turns.

Defined results: a null role or text is empty; a null turn comes first, and equal turns follow
role, then text; repeated rows are repeated turns. Rows without a conv_id belong to no
conversation and are left out. A conversation whose rebuilt form has no turn is a member of the root only. An
empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, store

#: Turns of distinct sequences in a shard, about.
SHARD = 1 << 17
#: Conversation ids that are joined to one text before they are hashed.
RUN = 1 << 12
#: Turns of a sequence that form one row.
SEGMENT = 512
#: Segments are hashed modulo a prime (2^89 - 1), with a base that is fixed.
PRIME, BASE = (1 << 89) - 1, 0x9E3779B97F4A7C15F39CC1
#: The rule that rebuilds conversations: every GROUP-th is the base of those behind it, of whose turns at most MOST are taken.
GROUP, MOST = 5, 9
NO_END = hashlib.sha256(b"").hexdigest()
TOP = hashlib.sha256(b"top").digest()

NODE = (
    "path binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved bigint, n_bytes bigint, end string, bound boolean"
)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str, keep: list[Column]) -> DataFrame:
    """``keys``, ``keep`` and each row's place (1, 2, ...) among those of equal keys, by a range sort that splits large groups."""
    by = [*map(F.col, keys), *order]
    # The ids rise along the sorted rows of a partition, and partitions follow each other; the store makes them final.
    at = [F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__part")]
    rising = store(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, *keep, *at), "numbered")
    parts = rising.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    placed = rising.join(parts, [*keys, "__part"])
    return placed.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__first", "__before")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, turn_id, n_bytes): the dictionary-encoded turns of each conversation in their order."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    )
    # The length tells where the role ends, so that different pairs differ.
    pair = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    keep = [F.unhex(F.sha2(pair.cast("binary"), 256)).alias("name"), F.octet_length("text").cast("bigint").alias("n_bytes")]
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = numbered(rows, ["conv_id"], order, "nth", keep)
    named = store(placed.select("name").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "turn_ids")
    return placed.join(named, "name").select("conv_id", "nth", "turn_id", "n_bytes")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, total, ids, sizes): each conversation as its base's first h turns, then its own after its first h.

    A segment is a row; ``total`` is the number of the conversation's turns. One without turns has one empty segment."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    convs = rows.groupBy("conv_id").agg(F.max("nth").alias("n")).select(
        "conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    )
    given = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("given", given)
    convs = convs.withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = store(convs.select("conv_id", "base", "h", "given", "total"), "convs")
    heads = rows.where(F.col("nth") < MOST).select(F.col("conv_id").alias("base"), "nth", "turn_id", "n_bytes")
    first = convs.join(heads, "base").where("nth <= h").select("conv_id", "total", F.col("nth").alias("pos"), "turn_id", "n_bytes")
    rest = rows.where(F.col("nth") > taken).join(convs, "conv_id").select(
        "conv_id", "total", (F.col("nth") - F.col("h") + F.col("given")).alias("pos"), "turn_id", "n_bytes"
    )
    turn = F.struct("pos", "turn_id", "n_bytes")
    found = first.unionByName(rest).groupBy("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(turn)).alias("t")
    )
    none = F.array().cast("array<bigint>")
    empty = convs.where("total = 0").select("conv_id", F.lit(0).cast("bigint").alias("seg"), "total", none.alias("ids"), none.alias("sizes"))
    return found.select("conv_id", "seg", "total", F.col("t.turn_id").alias("ids"), F.col("t.n_bytes").alias("sizes")).unionByName(empty)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, seg, ids) -> (conv_id, seg, term): a segment's term of the polynomial hash."""
    for batch in batches:
        terms = []
        for seg, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            digest = hashlib.sha256(b"".join(i.to_bytes(8, "little", signed=True) for i in ids)).digest()
            terms.append(Decimal(int.from_bytes(digest, "big") % PRIME * pow(BASE, seg, PRIME) % PRIME))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(terms, pa.decimal128(38, 0))], names=["conv_id", "seg", "term"])


def anchored(segments: DataFrame) -> DataFrame:
    """``segments`` with anchor, the name of the node above them, and next: that of a whole segment's last node."""
    long = segments.where(F.col("total") >= SEGMENT)
    terms = long.select("conv_id", "seg", "ids").mapInArrow(_terms, "conv_id bigint, seg bigint, term decimal(38,0)")
    w = Window.partitionBy("conv_id").orderBy("seg")
    name = lambda seg, total: F.unhex(F.sha2(F.concat_ws(":", seg, total % F.lit(Decimal(PRIME))).cast("binary"), 256))
    before = F.sum("term").over(w.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.sum("term").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = terms.select(
        "conv_id", "seg", F.coalesce(name(F.col("seg"), before), F.lit(TOP)).alias("anchor"), name(F.col("seg") + 1, upto).alias("next")
    )
    whole = F.when(F.size("ids") == SEGMENT, F.col("next"))
    deep = long.join(names.withColumn("anchor", F.when(F.col("seg") == 0, F.lit(TOP)).otherwise(F.col("anchor"))), ["conv_id", "seg"])
    columns = ["conv_id", "seg", "total", "ids", "sizes", "anchor"]
    short = segments.where(F.col("total") < SEGMENT).withColumn("anchor", F.lit(TOP))
    return deep.select(*columns, whole.alias("next")).unionByName(short.select(*columns, F.lit(None).cast("binary").alias("next")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq, run, ids) sorted by seq and run -> (seq, end): the digest of a group's joined runs."""
    now, digest = None, None
    seqs, ends = [], []
    for batch in batches:
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if seq != now:
                if now is not None:
                    seqs.append(now)
                    ends.append(digest.hexdigest())
                now, digest = seq, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(ends, pa.string())], names=["seq", "end"])
        seqs, ends = [], []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["seq", "end"])


def ends(members: DataFrame) -> DataFrame:
    """(seq, end) from (seq, conv_id): the SHA-256 of each group's ids in rising order, joined by commas."""
    placed = numbered(members, ["seq"], [F.col("conv_id").asc()], "nth", [F.col("conv_id")])
    runs = placed.groupBy("seq", F.floor((F.col("nth") - 1) / RUN).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return runs.repartition("seq").sortWithinPartitions("seq", "run").select("seq", "run", "ids").mapInArrow(_hashed, "seq string, end string")


class Tree:
    """A ternary search tree over sequences of turn numbers; entry 0 is the root, which has no turn."""

    def __init__(self, depth: int = 0) -> None:
        self.turn, self.size, self.depth, self.parent = [-1], [0], [depth], [0]
        self.lower, self.higher, self.below = [0], [0], [0]
        self.convs, self.least, self.end = [0], [None], [NO_END]

    def insert(self, ids: list[int], sizes: list[int], copies: int, least: int, end: str) -> None:
        turn, lower, higher, below = self.turn, self.lower, self.higher, self.below
        node = 0
        for depth, (want, size) in enumerate(zip(ids, sizes, strict=True), self.depth[0] + 1):
            # The entries for the turns behind ``node`` hang together by lower and higher; find that of this turn.
            at, links, owner = below[node], below, node
            while at and turn[at] != want:
                links, owner = (lower, at) if want < turn[at] else (higher, at)
                at = links[owner]
            if not at:
                at = links[owner] = len(turn)
                turn.append(want)
                for column, value in (
                    (self.size, size), (self.depth, depth), (self.parent, node), (lower, 0), (higher, 0),
                    (below, 0), (self.convs, 0), (self.least, None), (self.end, NO_END),
                ):
                    column.append(value)
            node = at
        self.convs[node] += copies
        self.least[node] = least
        self.end[node] = end


def medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle first, then the middles of both halves, and so on."""
    waiting = [(0, n)]
    for low, high in waiting:
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(low, middle), (middle + 1, high)]


def _nodes(rows: list[tuple]) -> pa.Table:
    """The nodes of the tree below one anchor, from sorted rows (anchor, ids, sizes, copies, least, end, next, depth)."""
    anchor, start = rows[0][0], rows[0][7]
    tree = Tree(start)
    for row in medians(len(rows)):
        tree.insert(*rows[row][1:6])
    n = len(tree.turn)
    convs, least, parent = tree.convs, tree.least, tree.parent
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    # Paths of the first and the last sequence, whose nodes may stand in other shards too, and of those that go on.
    paths: dict[int, bytes] = {0: anchor}
    for row, (_, ids, _, _, _, _, after, _) in enumerate(rows):
        if 0 < row < len(rows) - 1 and after is None:
            continue
        node, path = 0, anchor
        for want in ids:
            at = tree.below[node]
            while tree.turn[at] != want:
                at = tree.lower[at] if want < tree.turn[at] else tree.higher[at]
            node, path = at, hashlib.sha256(path + want.to_bytes(8, "little", signed=True)).digest()
            paths[node] = path
        if after is not None:
            paths[node] = after
    # An entry is made after its parent, so that going back from the last one sees children first.
    for node in range(n - 1, -1, -1):
        bound = node in paths
        if not bound:
            leaves[node] += not children[node]
            saved[node] += (convs[node] - 1) * tree.size[node]
        if node:
            up = parent[node]
            convs[up] += convs[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]
            if not bound:  # merged nodes add themselves to their parents later
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    inner_parent = [parent[k] not in paths for k in range(n)]
    up_conv = [least[parent[k]] if inner_parent[k] else None for k in range(n)]
    if start:
        convs[0] = 0  # its members are counted where the segment before it ends
    columns = [
        ([paths.get(k) for k in range(n)], pa.binary()),
        ([paths.get(parent[k]) if k else None for k in range(n)], pa.binary()),
        (tree.depth, pa.int64()),
        (least, pa.int64()),
        (up_conv, pa.int64()),
        (convs, pa.int64()),
        (children, pa.int64()),
        (leaves, pa.int64()),
        (saved, pa.int64()),
        (tree.size, pa.int64()),
        (tree.end, pa.string()),
        ([k in paths for k in range(n)], pa.bool_()),
    ]
    return pa.table([pa.array(c, t) for c, t in columns], names=[c.split()[0] for c in NODE.split(", ")])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, whose rows are sorted by anchor and ids."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, own in groupby(rows, key=lambda row: row[0]):
        yield from _nodes(list(own)).to_batches(max_chunksize=1 << 14)


def _merged(pieces: DataFrame) -> DataFrame:
    """Boundary nodes, one row each, with the sums over their whole subtrees."""
    own = store(
        pieces.groupBy("path").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("hanging"), F.sum("n_leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("n_bytes").alias("n_bytes"),
            F.max(F.when(F.col("end") != NO_END, F.col("end"))).alias("end"),
        ),
        "boundary",
    )
    below = own.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("more"))
    children = F.col("hanging") + F.coalesce("more", F.lit(0))
    now = store(
        own.join(below, "path", "left").select(
            "path", "parent", "depth", "conv_id", "n_convs", children.alias("n_children"),
            F.coalesce("end", F.lit(NO_END)).alias("end"), F.col("parent").alias("far"),
            (F.col("leaves") + F.when(children == 0, 1).otherwise(0)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        ),
        "subtrees",
    )
    forget(own)
    for _ in range((now.agg(F.max("depth")).first()[0] or 0).bit_length()):
        # far is the node 2^k levels up; its sum over 2^k levels takes in the next 2^k.
        add = now.where("far is not null").groupBy(F.col("far").alias("path")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")
        )
        jump = now.select(F.col("path").alias("far"), F.col("far").alias("further"))
        wider = now.join(add, "path", "left").join(jump, "far", "left").select(
            "path", "parent", "depth", "conv_id", "n_convs", "n_children", "end", F.col("further").alias("far"),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        wider = store(wider, "subtrees")
        forget(now)
        now = wider
    return now


def trie(segments: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations whose segments are given as by ``rebuilt``."""
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    seq = F.sha2(F.concat(F.hex("anchor"), F.lit(":"), listed).cast("binary"), 256)
    rows = store(anchored(segments).withColumn("seq", seq), "sequences")
    # Copies are counted on narrow rows; the arrays come from the least copy.
    groups = rows.groupBy("seq").agg(F.count("*").alias("copies"), F.min("conv_id").alias("least"))
    depth = (F.col("seg") * SEGMENT).alias("depth")
    kept = rows.select("seq", F.col("conv_id").alias("least"), "anchor", "ids", "sizes", "next", depth).join(groups, ["seq", "least"])
    last = rows.where((F.col("seg") + 1) * SEGMENT >= F.col("total")).select("seq", "conv_id")
    end = F.coalesce("end", F.lit(NO_END)).alias("end")
    distinct = kept.join(ends(last), "seq", "left").select("anchor", "ids", "sizes", "copies", "least", end, "next", "depth")
    distinct = store(distinct, "distinct")
    forget(rows)
    total = distinct.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = distinct.repartitionByRange(max(1, math.ceil(total / SHARD)), "anchor", "ids").sortWithinPartitions("anchor", "ids")
    nodes = store(shards.mapInArrow(_shard, NODE), "nodes")
    forget(distinct)
    bounds = _merged(nodes.where("bound"))
    up = bounds.select(F.col("path").alias("parent"), F.col("conv_id").alias("up"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("end").alias("ends_sha256")]
    inner = nodes.where("not bound")
    # An inner node below a boundary node asks the merged one for its parent's conversation.
    hung = inner.where("parent is not null").drop("parent_conv_id").join(up, "parent").withColumnRenamed("up", "parent_conv_id")
    merged = bounds.join(up, "parent", "left").withColumnRenamed("up", "parent_conv_id")
    return inner.where("parent is null").select(*columns).unionByName(hung.select(*columns)).unionByName(merged.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return trie(store(rebuilt(store(turns(conversations), "turns")), "segments"))
