"""The prefix trie of conversations, built as a burst trie (Heinz, Zobel and Williams 2002).

A conversation is the sequence of its turns' ids (16 bytes of SHA-256 of role and text). Equal sequences are one with a
weight, so thousands of copies are one row. All sequences begin in the container under the root. A container of more than
CONTAINER sequences bursts: the prefixes of its sequences, one turn longer at first and twice as many turns in each
further round, are heads of the trie, grouped sums in Spark; what is longer goes to the containers under the last of
them. The other containers are dealt to shards by head, sorted, and swept: a stack holds the nodes on the path to the
current sequence, and a node is done when a sequence leaves it. Heads add up what lies under them.

A sweep holds the nodes of one container whose parent is not done, CONTAINER of each depth at most. The hash of the
conversations that end at a node is taken over a sorted stream, so that thousands of copies need no list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise, small

#: Sequences of a container that does not burst.
CONTAINER = 2048
#: Turns that a conversation takes from its base are fewer than this; every so many conversations share a base.
TAKEN, BASE = 4, 20
WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
_NODES = "head binary, key binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, whole boolean"


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart by role and text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def key_of(ids: Column, depth: Column | None = None) -> Column:
    """The key of the node of the first `depth` turns, or of all."""
    return F.unhex(F.sha2(ids if depth is None else F.substring(ids, F.lit(1), depth * WIDTH), 256))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): of every conversation the turn ids in a row and the words of each turn, after the first h
    turns of its base have taken the place of its own first h; h is crc32 of the decimal conv_id, modulo TAKEN."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    turns = turns.select("conv_id", F.col("turn").isNotNull().alias("given"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("given", "turn", "id", "words"))).alias("turns"))
    listed = materialise(listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")), tidy=True)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TAKEN)).cast("int")
    bases = listed.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, TAKEN - 1).alias("first"))
    met = listed.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % BASE}).join(bases, "base", "left")
    none = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    both = met.select("conv_id", F.concat(taken, own).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return both.select("conv_id", joined.alias("ids"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words"))


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): the hash of the conv_ids, ascending, with commas. One sorted stream."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for batch in batches:
            keys, ids, done = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = keys[at], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids[at:end])).encode())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return members.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(stream, "key binary, ends_sha256 string")


@dataclass
class _Node:
    depth: int
    words: int
    conv: int
    n: int = 0
    leaves: int = 0
    saved: int = 0
    children: list[tuple] = field(default_factory=list)
    key: bytes = b""


class Sweep:
    """Nodes of sorted sequences, container by container."""

    def __init__(self) -> None:
        self.head: bytes | None = None
        self.path: list[_Node] = []
        self.ids, self.rows = b"", []

    def _close(self, depth: int) -> None:
        """Ends the nodes below `depth`; a node's children, whose parent is then known, are given out."""
        while self.path[-1].depth > depth:
            node = self.path.pop()
            self.rows += [(self.head, *c[:3], node.conv, *c[3:], False) for c in node.children]
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            above = self.path[-1]
            above.children.append((node.key, node.depth, node.conv, node.n, len(node.children), leaves, saved))
            above.conv, above.n = min(above.conv, node.conv), above.n + node.n
            above.leaves, above.saved = above.leaves + leaves, above.saved + saved

    def end(self) -> None:
        """Ends the container: its top nodes, whose parent is the head, and a row of what lies under the head."""
        if self.path:
            top = self.path[0]
            self._close(top.depth)
            self.rows += [(self.head, *c[:3], None, *c[3:], False) for c in top.children]
            self.rows.append((self.head, self.head, top.depth, top.conv, None, top.n, len(top.children), top.leaves, top.saved, True))
        self.path = []

    def add(self, head: bytes, depth: int, ids: bytes, words: list[int], weight: int, conv: int) -> None:
        if head != self.head or not self.path:
            self.end()
            self.head, self.ids, self.path = head, ids[: depth * WIDTH], [_Node(depth, 0, conv)]
        same, most = depth, min(len(ids), len(self.ids)) // WIDTH
        while same < most and ids[same * WIDTH : (same + 1) * WIDTH] == self.ids[same * WIDTH : (same + 1) * WIDTH]:
            same += 1
        self._close(same)
        for d in range(len(self.path) + depth, len(words) + 1):
            self.path.append(_Node(d, words[d - 1], conv, key=hashlib.sha256(ids[: d * WIDTH]).digest()))
        last = self.path[-1]
        last.n, last.conv, self.ids = last.n + weight, min(last.conv, conv), ids


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep()
    types = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
    names = [c.split()[0] for c in _NODES.split(", ")]

    def given() -> pa.RecordBatch:
        rows, sweep.rows = sweep.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 10, types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sweep.add(*row)
            if len(sweep.rows) > 8192:
                yield given()
        yield given()
    sweep.end()
    yield given()


def prefix_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are in order of `turn`, null first; equal ones in order of their ids, so that the order of rows is without
    effect. Null roles and texts are empty, and so are turns without words. Rows without conv_id are left out; an empty
    table has no root. Long texts count by their hash, a conversation is held as 16 bytes and a number a turn. Other columns
    are ignored.
    """
    convs = materialise(rebuilt(conversations).withColumn("key", key_of(F.col("ids"))), tidy=True)
    same = convs.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv"))
    one = convs.select("key", "conv_id", "ids", "words").join(same, (convs.key == same.key) & (F.col("conv_id") == F.col("conv"))).select("ids", "words", "weight", "conv")
    root = F.unhex(F.sha2(F.lit(b""), 256))
    active = materialise(one.withColumns({"head": root, "depth": F.lit(0)}), tidy=True)
    heads = active.groupBy(F.col("head").alias("key")).agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id")).select("key", F.lit(0).alias("depth"), "conv_id", "n_convs", F.lit(0).alias("words"), F.lit(b"").alias("path"))
    active, settled, step = active.where(F.size("words") > 0), [], 1
    while True:
        large = materialise(active.groupBy("head").count().where(F.col("count") > container).select("head"), tidy=True)
        if large.first() is None:
            break
        settled.append(active.join(small(large), "head", "left_anti"))
        burst = active.join(small(large), "head", "left_semi")
        upto = F.least(F.size("words"), F.col("depth") + step)
        prefixes = burst.select(F.explode(F.sequence(F.col("depth") + 1, upto)).alias("depth"), "ids", "words", "weight", "conv")
        prefixes = prefixes.select(F.substring("ids", F.lit(1), F.col("depth") * WIDTH).alias("path"), "depth", F.element_at("words", F.col("depth")).alias("words"), "weight", "conv")
        heads = heads.unionByName(materialise(prefixes.groupBy("path", "depth", "words").agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id")).select(key_of(F.col("path")).alias("key"), "depth", "conv_id", "n_convs", "words", "path"), tidy=True))
        deeper = burst.withColumn("depth", upto).where(F.size("words") > F.col("depth"))
        active = materialise(deeper.withColumn("head", key_of(F.col("ids"), F.col("depth"))), tidy=True)
        step *= 2
    held = active
    for rows in settled:
        held = held.unionByName(rows)
    sweeps = held.select("head", "depth", "ids", "words", "weight", "conv").repartition("head").sortWithinPartitions("head", "ids")
    swept = materialise(sweeps.mapInArrow(_swept, _NODES), tidy=True)

    # What lies under a head: itself, the heads and the containers whose path begins with its own.
    heads = materialise(heads)
    containers = swept.where("whole").join(heads.select(F.col("key").alias("head"), "path"), "head").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("n_children").alias("tops"))
    own = heads.select("path", F.lit(0).alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(0).alias("tops"))
    above = containers.unionByName(own).withColumn("at", F.explode(F.sequence(F.lit(0), (F.length("path") / WIDTH).cast("int"))))
    mine = F.length("path") == F.col("at") * WIDTH
    under = above.groupBy(key_of(F.col("path"), F.col("at")).alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(F.when(mine, F.col("tops")).otherwise(0)).alias("tops"))
    parent = heads.where("depth > 0").select(key_of(F.col("path"), F.col("depth") - 1).alias("parent"))
    children = parent.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))
    counted = materialise(heads.join(under, "key", "left").join(children, "key", "left").withColumn("n_children", F.coalesce("below", F.lit(0)) + F.coalesce("tops", F.lit(0))))
    # A head without children is a leaf of all heads on its path.
    bare = counted.where("n_children = 0").select("path").withColumn("at", F.explode(F.sequence(F.lit(0), (F.length("path") / WIDTH).cast("int"))))
    bare = bare.groupBy(key_of(F.col("path"), F.col("at")).alias("key")).agg(F.count("*").alias("bare"))
    named = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = counted.join(bare, "key", "left").withColumn("parent", F.when(F.col("depth") > 0, key_of(F.col("path"), F.col("depth") - 1))).join(named, "parent", "left")
    upper = upper.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.coalesce("leaves", F.lit(0)) + F.coalesce("bare", F.lit(0))).alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    lower = swept.where("not whole").join(named.select(F.col("parent").alias("head"), F.col("parent_conv_id").alias("over")), "head").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    nodes = upper.unionByName(lower.select(*upper.columns))
    return nodes.join(ends(convs.select("key", "conv_id")), "key", "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
