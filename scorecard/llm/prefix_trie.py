"""A trie of the prefixes that conversations share (operator 12).

1. Every turn becomes a 128-bit digest of role and text and the text's size in
   bytes, so texts are never shuffled.  A conversation's *path* is its turns'
   digests, joined; a node of the trie is a prefix of paths.
2. Conversations are dealt into ranges of (path, conv_id) and sorted, so the
   paths below a node are neighbours, and a node with very many conversations
   spreads over many tasks.
3. Each task inserts its conversations, in batches, into z-fast tries
   (:class:`ZFastTrie`): compacted nodes are hashed by the prefix at their
   two-fattest depth, a fat binary search finds a conversation's exit node in
   a logarithmic number of probes, and the edge there is split.  A trie of
   ``TURNS`` turns is expanded, edge by edge, into a row for each node, and the
   next one begins, so memory does not depend on the size of a partition.
4. Nodes off the first and the last path of a trie are whole.  Of the others, the
   *spine*, each trie has a part; the parts are summed.  What two neighbouring
   tries share is the common prefix of the one's last and the other's first
   path, so what would be counted twice is known from these two paths, and is
   taken off.

Two turns are the same if role and text are, up to collisions of MD5.

Defined results: turns are ordered by ``turn``, null first, and those that tie by
their digest; repeated rows are turns each.  Null role and text are empty.  Rows
with a null ``conv_id`` belong to no conversation and are left out.  Very long
texts leave Spark's expressions as 20 bytes.  A single conversation's digests must
fit a row.  Without conversations there is no node, not even a root.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .common import prepare, split_hot, stored

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns (and conversations) that a trie takes in before the next one begins.
TURNS = 200_000
#: Conversation ids in a piece of a node's list of ends.
PIECE = 4096
#: Rows of the Arrow batches that tasks return.
ROWS_OUT = 16_384
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = pa.schema([
    ("kind", pa.int32()), ("pid", pa.int32()), ("seq", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("bytes_all", pa.int64()), ("bytes_once", pa.int64()),
    ("ends", pa.string()), ("first_path", pa.binary()), ("last_path", pa.binary()),
    ("last_sizes", pa.list_(pa.int32()))])
NODES_SQL = ("kind int, pid int, seq bigint, node binary, parent binary, depth bigint, conv_id bigint, "
             "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, bytes_all bigint, "
             "bytes_once bigint, ends string, first_path binary, last_path binary, last_sizes array<int>")
#: Kinds of rows: a whole node, a part of a spine node, what to take off one, a piece
#: of a spine node's ends, and the first and last path of a task.
WHOLE, PART, TWICE, ENDS, BOUNDS = range(5)


# --- conversations as paths -------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def _in_order(conversations: DataFrame, by: Column) -> DataFrame:
    """``by, turns``: the turns of each group, by conversation and turn."""
    turn = F.struct("conv_id", F.col("turn").isNotNull().alias("numbered"), "turn",
                    turn_digest(F.col("role"), F.col("text")).alias("digest"),
                    F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return (conversations.where("conv_id IS NOT NULL").select(by.alias("by"), turn.alias("turn"))
            .groupBy("by").agg(F.array_sort(F.collect_list("turn")).alias("turns")))


def _path(turns: str) -> list[Column]:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), "")).alias("path"),
            F.transform(turns, lambda t: t["size"]).alias("sizes")]


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of each conversation as it is."""
    return _in_order(conversations, F.col("conv_id")).select(F.col("by").alias("conv_id"), *_path("turns"))


def rebuilt_paths(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, path, sizes`` of rebuilt conversations.

    Conversation ``c`` becomes the first ``h`` turns of ``c - c % family`` and its own
    after its first ``h``, with ``h = crc32(c) % most``.  A family's turns meet in one
    row, so this is a single shuffle.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    shared = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    each = (_in_order(conversations, base)
            .select("turns", F.slice(F.filter("turns", lambda t: t["conv_id"] == F.col("by")), 1, most - 1).alias("head"),
                    F.explode(F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))).alias("conv_id"))
            .select("conv_id", "head", shared.cast("int").alias("h"),
                    F.filter("turns", lambda t: t["conv_id"] == F.col("conv_id")).alias("own")))
    return each.select("conv_id", F.concat(
        F.slice("head", F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns")).select("conv_id", *_path("turns"))


# --- z-fast tries -----------------------------------------------------------

class Node:
    """A compacted node: the edge from depth ``top`` down to ``depth``."""

    __slots__ = ("extent", "top", "depth", "sizes", "up", "kids", "ids", "n", "least", "all", "once", "leaves", "spine")

    def __init__(self, extent: bytes, top: int, depth: int, sizes: list, up: Node | None):
        self.extent, self.top, self.depth, self.sizes, self.up = extent, top, depth, sizes, up
        self.kids: dict[bytes, Node] = {}
        self.ids: list[int] = []


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """Compacted nodes in a table by their handles: the prefix of a node's
    extent at the two-fattest depth of its edge."""

    def __init__(self):
        self.root = Node(b"", 0, 0, [], None)
        self.table: dict[bytes, Node] = {}
        self.last = self.root

    def _handle(self, x: Node) -> bytes:
        return x.extent[:WIDTH * two_fattest(x.top, x.depth)]

    def exit_node(self, path: bytes, depth: int) -> Node:
        """The node where ``path`` leaves the trie: on its edge, or at its end."""
        a, b, x = 0, depth, self.root
        while a < b:
            f = two_fattest(a, b)
            met = self.table.get(path[:WIDTH * f])
            if met is None:
                b = f - 1
            elif path.startswith(met.extent):
                a, x = met.depth, met
            else:
                return met
        return x.kids.get(path[WIDTH * x.depth:WIDTH * (x.depth + 1)], x)

    def insert(self, path: bytes, sizes: list, conv: int) -> None:
        if path == self.last.extent:  # a copy of the conversation before
            self.last.ids.append(conv)
            return
        depth = len(path) // WIDTH
        x = self.exit_node(path, depth)
        at = x.depth if path.startswith(x.extent) else shared_depth(path, x.extent, x.top)
        if at < x.depth:
            x = self._split(x, at)
        if at < depth:
            leaf = Node(path, at, depth, sizes, x)
            x.kids[path[WIDTH * at:WIDTH * (at + 1)]] = leaf
            self.table[self._handle(leaf)] = leaf
            x = leaf
        x.ids.append(conv)
        self.last = x

    def _split(self, x: Node, at: int) -> Node:
        """Cut the edge of ``x`` at depth ``at`` by a new node."""
        mid = Node(x.extent[:WIDTH * at], x.top, at, x.sizes, x.up)
        del self.table[self._handle(x)]
        x.up.kids[x.extent[WIDTH * x.top:WIDTH * (x.top + 1)]] = mid
        mid.kids[x.extent[WIDTH * at:WIDTH * (at + 1)]] = x
        x.up, x.top = mid, at
        self.table[self._handle(x)] = x
        self.table[self._handle(mid)] = mid
        return mid

    def summed(self) -> list[Node]:
        """All nodes, parents first, with the sums over their subtrees."""
        order = [self.root]
        for x in order:
            order.extend(x.kids.values())
        for x in reversed(order):
            kids = x.kids.values()
            x.n = len(x.ids) + sum(k.n for k in kids)
            x.least = min(x.ids[:1] + [k.least for k in kids])  # ids ascend
            x.leaves = sum(k.leaves for k in kids) or 1
            own = sum(x.sizes[x.top:x.depth])
            x.once = own + sum(k.once for k in kids)
            x.all = own * x.n + sum(k.all for k in kids)
        return order


def shared_depth(a: bytes, b: bytes, low: int = 0) -> int:
    """Turns at the start of both paths, which agree up to ``low``."""
    high = min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[WIDTH * low:WIDTH * mid] == b[WIDTH * low:WIDTH * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_ids(path: bytes) -> list[bytes]:
    """An identifier for each prefix of ``path``, the empty one first."""
    state = hashlib.md5()
    found = [state.digest()]
    for i in range(0, len(path), WIDTH):
        state.update(path[i:i + WIDTH])
        found.append(state.copy().digest())
    return found


class Rows:
    """Rows on their way out, in batches."""

    def __init__(self):
        self.rows: list[dict] = []
        self.pieces = 0

    def add(self, **row) -> None:
        self.rows.append(row)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= least:
            out, self.rows = self.rows[:ROWS_OUT], self.rows[ROWS_OUT:]
            yield pa.RecordBatch.from_pylist(out, NODES)


def expanded(trie: ZFastTrie, first: bytes, last: bytes, out: Rows, pid: int) -> Iterator[pa.RecordBatch]:
    """The nodes of all edges: whole ones, and parts of those on the spine.

    ``x.spine`` is the depth down to which an edge lies on the first or last path.
    """
    ids_first, ids_last = prefix_ids(first), prefix_ids(last)
    for x in trie.summed():
        on_first = on_last = -1
        if x.up is None or x.up.spine == x.up.depth:
            on_first, on_last = shared_depth(x.extent, first), shared_depth(x.extent, last)
        x.spine = max(on_first, on_last)

        def name(depth, on_first=on_first):
            return ids_first[depth] if depth <= on_first else ids_last[depth]

        above_all, above_once = x.all, x.once  # at depth ``top + 1``
        for depth in range(x.top + 1 if x.up else 0, x.depth + 1):
            end = depth == x.depth
            row = dict(depth=depth, conv_id=x.least, n_convs=x.n, n_children=len(x.kids) if end else 1, n_leaves=x.leaves,
                       bytes_all=above_all, bytes_once=above_once)
            if depth <= x.spine:
                out.add(kind=PART, node=name(depth), parent=name(depth - 1) if depth else None, **row)
                if end:
                    for i in range(0, len(x.ids), PIECE):
                        out.add(kind=ENDS, pid=pid, seq=out.pieces, node=name(depth),
                                ends=",".join(map(str, x.ids[i:i + PIECE])))
                        out.pieces += 1
            else:
                row["ends"] = hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest() if end and x.ids else NO_ENDS
                if depth - 1 <= x.spine or depth == x.top + 1 and x.up.spine == x.up.depth:
                    out.add(kind=WHOLE, parent=name(depth - 1), **row)
                else:
                    out.add(kind=WHOLE, parent_conv_id=x.up.least if depth == x.top + 1 else x.least, **row)
            if depth:
                above_all -= x.sizes[depth - 1] * x.n
                above_once -= x.sizes[depth - 1]
        yield from out.batches(ROWS_OUT)


def counted_twice(last: bytes, sizes: list, first: bytes, out: Rows) -> None:
    """What two neighbouring tries both count: the prefixes that the one's last
    and the other's first path share."""
    shared = shared_depth(last, first)
    inside = len(last) // WIDTH == shared  # the last path ends on the other's: no leaf, or the same one again
    ids, once = prefix_ids(last[:WIDTH * shared]), 0
    for depth in range(shared, -1, -1):
        once += sizes[depth - 1] if depth else 0
        out.add(kind=TWICE, node=ids[depth], n_convs=0, n_children=-(depth < shared), n_leaves=-inside, bytes_all=0,
                bytes_once=-once)


def trie_rows(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[pa.RecordBatch]:
    """The rows of one task's tries, from ``conv_id, path, sizes`` in order."""
    pid, out = TaskContext.get().partitionId(), Rows()
    trie, room, start, first, path, sizes = None, 0, None, None, None, None
    for batch in batches:
        for conv, now, now_sizes in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes")]):
            if room <= 0 or trie is None:
                if trie is not None:
                    yield from expanded(trie, first, path, out, pid)
                    counted_twice(path, sizes, now, out)
                trie, room, first = ZFastTrie(), turns, now
            start = now if start is None else start
            trie.insert(now, now_sizes, conv)
            path, sizes = now, now_sizes
            room -= 1 + len(now_sizes)
    if trie is not None:
        yield from expanded(trie, first, path, out, pid)
        out.add(kind=BOUNDS, pid=pid, first_path=start, last_path=path, last_sizes=sizes)
        yield from out.batches()


# --- the whole trie ---------------------------------------------------------

RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(convs: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of ``convs`` (``conv_id, path, sizes``):
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    The node is the first ``depth`` turns of conversation ``conv_id``.  Tries are
    built, and written below the checkpoint folder, when this is called.  The
    driver gets the numbers of the tasks that had rows.
    """
    spark = convs.sparkSession
    prepare(spark)

    def build(batches):
        return trie_rows(batches, turns)

    dealt = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    at = shared_path(spark, "tries")
    dealt.mapInArrow(build, NODES_SQL).write.partitionBy("kind").parquet(at)
    rows = spark.read.schema(NODES_SQL).parquet(at)

    spine = _spine(rows)
    whole = rows.where(F.col("kind") == WHOLE).select(
        "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("bytes_all") - F.col("bytes_once")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    both = whole.unionByName(spine.drop("node"), allowMissingColumns=True)
    known, open_ = both.where("parent IS NULL"), both.where("parent IS NOT NULL").drop("parent_conv_id")
    parents = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                           F.col("n_children").alias("n_rows"))
    named = split_hot(open_, parents, ["parent"], "n_rows", open_.count())
    return known.select(*RESULT).unionByName(named.select(*RESULT))


def _spine(rows: DataFrame) -> DataFrame:
    """The nodes that lie on first and last paths of tries, from their parts."""
    spark = rows.sparkSession
    bounds = rows.where(F.col("kind") == BOUNDS)
    tasks = sorted(r.pid for r in bounds.select("pid").collect())  # a number a task
    pairs = spark.createDataFrame(list(zip(tasks, tasks[1:])), "pid int, next int")
    later = bounds.select(F.col("pid").alias("next"), F.col("first_path").alias("next_path"))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows()
        for batch in batches:
            for last, sizes, first in zip(*[c.to_pylist() for c in batch.columns]):
                counted_twice(last, sizes, first, out)
                yield from out.batches()

    twice = (bounds.join(pairs, "pid").join(later, "next").select("last_path", "last_sizes", "next_path")
             .mapInArrow(between, NODES_SQL))
    parts = rows.where(F.col("kind").isin(PART, TWICE)).unionByName(twice)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "bytes_all", "bytes_once")]
    total = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"),
                                      F.min("conv_id").alias("conv_id"), *sums)
    pieces = (rows.where(F.col("kind") == ENDS).select("node", "pid", "seq", "ends")
              .repartition("node").sortWithinPartitions("node", "pid", "seq"))
    ends = pieces.mapInArrow(_digests, "node binary, ends_sha256 string")
    return stored(total.join(ends, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("bytes_all") - F.col("bytes_once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-spine")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in order; pieces pass one by one."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for n, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if n == node:
                state.update(b",")
            else:
                if state:
                    yield row()
                node, state = n, hashlib.sha256()
            state.update(ends.encode())
    if state:
        yield row()
