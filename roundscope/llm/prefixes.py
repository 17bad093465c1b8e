"""Trie of conversation prefixes by truncation peeling.

A node is a distinct sequence of first turns. Peeling begins at the greatest depth: conversations
that end there and nodes that survived from one depth further down are merged, each merged node loses
its last turn, and what is left is grouped again. Counts, leaves and savings are summed as nodes are
found, so each node is made once and never visited again.

Depths far from the root are peeled inside tasks and the rest by one grouping per depth. Which
subtree a task gets is a matter of its size: prefixes of 1, 2, 4, ... turns are tried until no more
than ``GROUP_TURNS`` turns of different conversations share one. A first turn that a third of all
conversations begin with is thus split further down, and equal conversations are one row from the
start. Sequences are told apart by a 128-bit digest chained from turn to turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundscope.session import materialize

#: Turns of a subtree that one group may hold; a single conversation may be longer.
GROUP_TURNS = 2_000
#: Turns that a task peels at a time (whole groups), and ids in one piece of an id list.
BLOCK_TURNS, LIST_IDS = 100_000, 4_096
#: Bytes of a digest, and of a step: the digest of a prefix with the size of its last text.
KEY, STEP = 16, 24
ROOT = bytes(KEY)
#: Turns that a conversation takes over from the one it is derived from: fewer than this.
SHARED, FAMILY = 9, 5

PATH_SCHEMA = "conv_id bigint, depth int, key binary, steps binary"
NODE_SCHEMA = (
    "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, key binary, steps binary"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: digest and text size of each turn, by turn (null first), then digest.

    Texts stay where they are; 40 bytes per turn are shuffled, and a conversation is one row of them.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)
    return (
        conversations.filter("conv_id is not null")
        .select("conv_id", F.struct(
            F.col("turn").isNotNull().alias("placed"), "turn",
            F.unhex(F.substring(mark, 1, 2 * KEY)).alias("mark"),
            F.octet_length(text).cast("bigint").alias("size"),
        ).alias("turn"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.transform(
            "turns", lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))
        ).alias("turns"))
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first one of its family of five.

    How many (0 to 8) is drawn from a checksum of its id; where that one has fewer, all of them.
    """
    head = turns.select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head")
    )
    own = turns.select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"),
    )
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    taken = F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h")))
    return own.join(head, "base", "left").select(
        "conv_id",
        F.when(taken.isNull(), rest).otherwise(F.concat(taken, rest)).alias("turns"),
    )


def chained(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, key, steps``: the digest of every prefix, and that of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, keys, paths = [], [], []
            for row in batch.column("turns"):
                key, steps = ROOT, []
                for turn in row:
                    key = hashlib.blake2b(key + turn["mark"].as_py(), digest_size=KEY).digest()
                    steps.append(key + turn["size"].as_py().to_bytes(STEP - KEY, "big"))
                depths.append(len(steps))
                keys.append(key)
                paths.append(b"".join(steps))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depths, pa.int32()),
                 pa.array(keys, pa.binary()), pa.array(paths, pa.binary())],
                ["conv_id", "depth", "key", "steps"],
            )

    return turns.select(F.col("conv_id").cast("bigint"), "turns").mapInArrow(run, PATH_SCHEMA)


def _first(steps: str, depth: int | Column) -> Column:
    """The steps of the first turns."""
    return F.substr(F.col(steps), F.lit(1), F.lit(STEP) * depth)


def list_digests(paths: DataFrame) -> DataFrame:
    """``key, ends_sha256``: digest of the ascending ids of the conversations that end at a node.

    Ids are put in order over all tasks, whoever they belong to, and travel as pieces of a list; the
    digest of a node takes its pieces one after another, however many ids there are.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, out = None, [], []

        def flush() -> None:
            if ids:
                out.append((last, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def batch_of(rows: list) -> pa.RecordBatch:
            keys, heads, texts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(heads, pa.int64()), pa.array(texts, pa.string())],
                ["key", "head", "ids"],
            )

        for batch in batches:
            for key, conv in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id"))):
                if key != last or len(ids) == LIST_IDS:
                    flush()
                    last = key
                ids.append(conv)
            if out:
                yield batch_of(out)
                out.clear()
        flush()
        if out:
            yield batch_of(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "ids"))):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                ["key", "ends_sha256"],
            )
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"]
            )

    ordered = paths.select("key", "conv_id").repartitionByRange("key", "conv_id")
    listed = ordered.sortWithinPartitions("key", "conv_id").mapInArrow(
        pieces, "key binary, head bigint, ids string"
    )
    return listed.repartition("key").sortWithinPartitions("key", "head").select(
        "key", "ids"
    ).mapInArrow(digest, "key binary, ends_sha256 string")


def split(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deal different paths into groups: ``cut, group`` for each, and those that end above any group.

    A group is all paths through one node at depth ``cut``. Paths through a node that has too many
    are tried again twice as far down; those that end before are merged outside of groups.
    """
    grouped, above = [], [paths.filter("depth = 0")]
    rest, cut = paths.filter("depth > 0"), 1
    while True:
        tried = rest.withColumn("group", _first("steps", cut))
        sizes = tried.groupBy("group").agg(
            F.sum("depth").alias("turns"), F.count(F.lit(1)).alias("n_paths")
        )
        fits = (F.col("turns") <= GROUP_TURNS) | (F.col("n_paths") == 1)
        tried = materialize(
            tried.join(sizes, "group").withColumn("fits", fits).drop("turns", "n_paths"),
            "prefix-groups",
        )
        grouped.append(tried.filter("fits").withColumn("cut", F.lit(cut)).drop("fits"))
        large = tried.filter("not fits").drop("group", "fits")
        cut *= 2
        above.append(large.filter(F.col("depth") < cut))
        rest = large.filter(F.col("depth") >= cut)
        if rest.isEmpty():
            break
    union = grouped[0]
    for more in grouped[1:]:
        union = union.unionByName(more)
    ended = above[0]
    for more in above[1:]:
        ended = ended.unionByName(more)
    return union, ended


class _Node:
    __slots__ = ("children", "conv", "convs", "cut", "kids", "leaves", "saved", "steps")

    def __init__(self, steps: bytes, cut: int):
        self.steps, self.cut = steps, cut
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.kids: list[_Node] = []


def peel(paths: list[tuple[bytes, int, int, int, int]]) -> list[tuple]:
    """All nodes of whole groups of paths ``steps, depth, cut, conv_id, n_ends`` down to their cuts.

    Rows of :data:`NODE_SCHEMA`; the node at a group's cut keeps its steps and has no parent yet.
    """
    ending: dict[int, list] = {}
    for path in paths:
        ending.setdefault(path[1], []).append(path)
    done: list[tuple] = []

    def emit(node: _Node, depth: int, parent: int | None, steps: bytes | None) -> None:
        key = node.steps[STEP * (depth - 1) : STEP * (depth - 1) + KEY]
        done.append((node.conv, depth, parent, node.convs, node.children, node.leaves,
                     node.saved, key, steps))

    surviving: list[_Node] = []
    for depth in range(max(ending, default=0), 0, -1):
        at = slice(STEP * (depth - 1), STEP * (depth - 1) + KEY)
        merged: dict[bytes, _Node] = {}
        for steps, _, cut, conv, n_ends in ending.get(depth, ()):
            node = merged.setdefault(steps[at], _Node(steps, cut))
            node.convs += n_ends
            node.conv = conv if node.conv is None else min(node.conv, conv)
        for kid in surviving:
            node = merged.setdefault(kid.steps[at], _Node(kid.steps, kid.cut))
            node.convs += kid.convs
            node.children += 1
            node.leaves += kid.leaves
            node.saved += kid.saved
            node.conv = kid.conv if node.conv is None else min(node.conv, kid.conv)
            node.kids.append(kid)
        surviving = []
        for node in merged.values():
            node.leaves = node.leaves or 1
            size = int.from_bytes(node.steps[at.stop : STEP * depth], "big")
            node.saved += (node.convs - 1) * size
            for kid in node.kids:
                emit(kid, depth + 1, node.conv, None)
            node.kids = []
            if depth > node.cut:
                surviving.append(node)
            else:
                emit(node, depth, None, node.steps[: STEP * depth])
    return done


def peel_groups(groups: DataFrame) -> DataFrame:
    """Nodes of all groups, each group in one task, whole groups at a time."""
    names = ("steps", "depth", "cut", "conv_id", "n_ends", "group")

    def rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary())
        fields = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        if done:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, group = 0, None
        for batch in batches:
            for *path, own in zip(*(batch.column(c).to_pylist() for c in names)):
                if turns >= BLOCK_TURNS and own != group:
                    yield from rows(peel(held))
                    held, turns = [], 0
                group = own
                held.append(tuple(path))
                turns += path[1]
        yield from rows(peel(held))

    dealt = groups.repartition("group").sortWithinPartitions("group").select(*names)
    return dealt.mapInArrow(run, NODE_SCHEMA)


def _size(steps: Column, depth: int) -> Column:
    last = F.substr(steps, F.lit(STEP * (depth - 1) + KEY + 1), F.lit(STEP - KEY))
    return F.conv(F.hex(last), 16, 10).cast("bigint")


def peel_rounds(tops: DataFrame, ended: DataFrame) -> list[DataFrame]:
    """The nodes above all groups, one grouping and one table per depth, from the deepest up."""
    parts = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    newly = ended.select(
        "depth", "steps", "conv_id", F.col("n_ends").alias("n_convs"),
        *[F.lit(0).cast("bigint").alias(c) for c in parts[2:]],
    )
    depths = tops.select("depth").union(newly.select("depth")).agg(F.max("depth")).first()[0]
    if depths is None:
        return []
    found, below = [], None
    for depth in range(depths, -1, -1):
        children = tops.filter(F.col("depth") == depth + 1).select("steps", *parts)
        if below is not None:
            children = children.unionByName(below.select("steps", *parts))
        stripped = children.select(
            _first("steps", depth).alias("steps"), "conv_id", "n_convs",
            F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        )
        merged = newly.filter(F.col("depth") == depth).drop("depth").unionByName(stripped).groupBy(
            "steps"
        ).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in parts[1:]])
        own = (F.col("n_convs") - 1) * _size(F.col("steps"), depth) if depth else F.lit(0)
        below = materialize(merged.select(
            "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + own).alias("saved_tokens"),
            F.substr(F.col("steps"), F.lit(STEP * (depth - 1) + 1), F.lit(KEY)).alias("key")
            if depth else F.lit(bytearray(ROOT)).alias("key"), "steps",
        ), "prefix-nodes")
        found.append(below)
    return found


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the conversations in ``conv_id, turns`` (as :func:`ordered_turns` gives them).

    ``conv_id`` is the least member and names a node together with ``depth``; ``parent_conv_id`` is
    that of the node without the last turn (null for the root). ``n_convs`` counts members,
    ``n_children`` the nodes one turn longer, ``n_leaves`` the childless nodes of the subtree (the
    node itself included), ``saved_tokens`` the bytes that are stored once instead of once per
    member over the subtree, ``ends_sha256`` digests the ascending ids of the conversations that end
    at the node. No conversation, no node.
    """
    whole = materialize(chained(turns), "prefix-paths")
    paths = materialize(whole.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_ends"),
        F.first("steps").alias("steps"),
    ).drop("key"), "prefix-paths")
    groups, ended = split(paths)
    peeled = materialize(peel_groups(groups), "prefix-nodes")
    tops = peeled.filter("steps is not null")
    # Nodes above the groups, and the tops of groups, still look for their parents.
    rounds = peel_rounds(tops, ended)
    orphans, parents = tops.drop("parent_conv_id"), None
    for found in rounds:
        orphans = orphans.unionByName(found)
        named = found.select(F.col("steps").alias("above"), F.col("conv_id").alias("parent_conv_id"))
        parents = named if parents is None else parents.unionByName(named)
    nodes = peeled.filter("steps is null").drop("steps")
    if parents is not None:
        shorter = F.when(F.col("depth") > 0, _first("steps", F.col("depth") - 1))
        nodes = nodes.unionByName(
            orphans.withColumn("above", shorter).join(parents, "above", "left")
            .drop("above", "steps")
        )
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(list_digests(whole), "key", "left").select(
        "conv_id", F.col("depth").cast("bigint"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table ``conv_id, turn, role, text`` as it is, see :func:`trie`.

    Null roles and texts are empty, a null turn comes first, rows of one turn are ordered by a digest
    of role and text and all stay. Rows without a conv_id belong to no conversation and are left out.
    Other columns are not looked at.
    """
    return trie(ordered_turns(conversations))
