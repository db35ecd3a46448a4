"""Prefix trie of conversations by union-find over sorted-neighbour common prefixes.

1. A turn becomes a fixed-width key: 128 bits of a strong digest of (role, text), then the words of the text. A
   conversation is the row of its keys in turn order (20 bytes a turn; texts never travel). Its opening may come from
   another conversation (``rebuilt``), found in the same partition, since both are dealt by their family.
2. Conversations are range-partitioned by (keys, conv_id), so copies of one conversation spread like other rows, and
   every trie node is a run of neighbours.
3. A task takes the common prefixes of neighbours as edges, in descending depth, and joins what they connect by
   union-find: each merge makes a branching node, or hangs the right side below the left one's top. Nodes between
   branching ones are written out with the edge they lie on.
4. Nodes that hold neither the first nor the last conversation of a task are complete. The others form its contracted
   forest: two paths with the sums of what hangs off them. Forests of ``MERGE`` neighbouring tasks are merged by the
   same union-find, and so on until one is left; a merge sees two paths a task, however many rows there are.
5. Two facts reach a complete node late: the smallest member of its parent, if that was still open, and the digest of
   the members that end at an open node. Both are small tables by node digest. Ids that end at an open node leave the
   tasks as sorted blocks of text, so the digest of a third of all ids is one pass over few rows; it is one sequential
   hash by definition.

A conversation is one row of keys: 2 GB hold 100 million turns.

Defined results: null role and text are empty. Turns are ordered by turn, null first, then by their digest; repeated
turns stay. Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root. Only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide.llm.common import partitions, stored
from flowtide.operators.skew import lookup

#: Bytes of a turn's key, of the digest in it and of the word count after it.
KEY, DIGEST = 20, 16
FAMILY, OPENING = 20, 4
PARTITION_BYTES, MERGE = 4 << 20, 64
BLOCK_CHARS = 1 << 20
SPACED_WORD = r"[^\x20\x09-\x0D]+"
NOBODY = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max

_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
         ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary())]
_PATH = [("forest", pa.int64()), ("path", pa.binary()), ("depths", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))]
_ENDS = [("first_id", pa.int64()), ("ids", pa.string())]
_SCHEMA = pa.schema([*_NODE, *_PATH, *_ENDS])
_DDL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "node binary, parent binary, forest long, path binary, depths array<long>, sums array<long>, first_id long, ids string")


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, key) of every turn that has a conv_id."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(SPACED_WORD)).cast("long")), 2 * (KEY - DIGEST), "0")
    return turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.substring(whole, 1, 2 * DIGEST), words).alias("key"))


def conversations(turns: DataFrame, family: Column | None = None) -> DataFrame:
    """(conv_id, family, keys): one row per conversation, ``keys`` the binary row of its turns' keys."""
    keys = turn_keys(turns)
    dealt = keys.withColumn("family", F.lit(None).cast("long") if family is None else family)
    # Dealt by family, so that grouping by conversation and looking into the family need no further shuffle.
    dealt = dealt.repartition("family") if family is not None else dealt
    ordered = F.sort_array(F.collect_list(F.struct("turn", "key")))  # null turns first
    return dealt.groupBy("family", "conv_id").agg(ordered.alias("turns")).select(
        "conv_id", "family", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, keys): the first h turns come from the conversation whose id is conv_id less conv_id mod ``FAMILY``,
    the others, after the first h, are its own; h is crc32 of the decimal id mod ``OPENING``."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = conversations(turns, base)
    opening = F.max(F.when(F.col("conv_id") == F.col("family"), F.substring("keys", 1, KEY * OPENING))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).cast("int") * KEY
    joined = own.withColumn("opening", F.coalesce(opening, F.lit(b""))).withColumn("h", h)
    return joined.select("conv_id", F.concat(F.expr("substring(opening, 1, h)"), F.expr("substring(keys, h + 1)")).alias("keys"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two rows of keys share from the start: doubling steps, then halving ones."""
    most, at, step = min(len(a), len(b)) // KEY, 0, 1
    while at < most and a[at * KEY:min(at + step, most) * KEY] == b[at * KEY:min(at + step, most) * KEY]:
        at, step = min(at + step, most), step * 2
    while step > 1:
        step //= 2
        if at + step <= most and a[at * KEY:(at + step) * KEY] == b[at * KEY:(at + step) * KEY]:
            at += step
    return at


def digest_of(path: bytes, depth: int) -> bytes:
    """Names a node by the digest of its path."""
    return hashlib.sha256(path[:depth * KEY]).digest()[:16]


class Forest:
    """The compact trie of sorted, distinct paths: branching nodes and nodes with sums of their own.

    ``paths[i]`` are keys, of which the first ``depths[i]`` turns are the path; ``shared[i]`` is how many turns path i
    has in common with path i - 1. ``members``, ``least``, ``children``, ``leaves``, ``saved`` are what already hangs at it.
    """

    def __init__(self, paths: list[bytes], depths: list[int], shared: list[int], members, least, children, leaves, saved):
        self.paths, self.rep, self.depth = paths, list(range(len(paths))), list(depths)
        self.members, self.least = list(members), list(least)
        self.children, self.leaves, self.saved = list(children), list(leaves), list(saved)
        self.parent = [-1] * len(paths)
        self.top = list(range(len(paths)))
        self._joined = list(range(len(paths)))
        # Deepest edges first; of equal depth the left one first, so that a path that is a prefix of others is met
        # before them.
        for i in (np.argsort(-np.array(shared[1:], np.int64), kind="stable") + 1).tolist():
            self._merge(self._find(i - 1), self._find(i), shared[i])
        root = self.top[self._find(0)]
        if self.depth[root]:
            self.parent[root] = self._branch(self.rep[root], 0)

    def _find(self, i: int) -> int:
        while self._joined[i] != i:
            self._joined[i] = self._joined[self._joined[i]]
            i = self._joined[i]
        return i

    def _branch(self, rep: int, depth: int) -> int:
        for column, value in ((self.rep, rep), (self.depth, depth), (self.members, 0), (self.least, _NONE), (self.children, 0), (self.leaves, 0),
                              (self.saved, 0), (self.parent, -1)):
            column.append(value)
        return len(self.depth) - 1

    def _merge(self, left: int, right: int, depth: int) -> None:
        top = self.top[left]
        if self.depth[top] > depth:
            branch = self._branch(self.rep[top], depth)
            self.parent[top] = branch
            top = branch
        self.parent[self.top[right]] = top
        # The smaller index stays the root: components are runs, and only their tops matter.
        self._joined[right] = left
        self.top[left] = top

    def open_nodes(self, outer: tuple[int, int]) -> set[int]:
        """Nodes on the paths of the first and of the last conversation, which ``outer`` names."""
        found: set[int] = set()
        for at in outer:
            while at >= 0 and at not in found:
                found.add(at)
                at = self.parent[at]
        return found

    def words(self, node: int, first: int, last: int) -> list[int]:
        """Words of the turns at depths first + 1 to last on the node's path."""
        path = self.paths[self.rep[node]]
        return [struct.unpack_from(">I", path, d * KEY + DIGEST)[0] for d in range(first, last)]

    def closed_rows(self, opened: set[int], ends: dict[int, str | None], put) -> None:
        """Write every node that isn't open, and add it to its parent. ``ends`` holds the digest of ids that end at an
        item, or None where it comes later."""
        order = sorted((n for n in range(len(self.depth)) if n not in opened), key=lambda n: -self.depth[n])
        for n in order:
            up, depth = self.parent[n], self.depth[n]
            over = self.depth[up] if up >= 0 else -1
            if not self.children[n]:
                self.leaves[n] = 1
            repeats = self.members[n] - 1
            saved = [self.saved[n]]
            if repeats:
                # Saved at the node, then at each node between it and its parent.
                for w in reversed(self.words(n, max(over, 0), depth)):
                    saved.append(saved[-1] + repeats * w)
                saved = saved[1:] if depth else saved
            else:
                saved = saved * max(1, depth - over)
            self.saved[n] = saved[-1]
            put.node(self, n, over, saved, ends, opened)
            if up >= 0:
                self.members[up] += self.members[n]
                self.least[up] = min(self.least[up], self.least[n])
                self.children[up] += 1
                self.leaves[up] += self.leaves[n]
                self.saved[up] += self.saved[n]


class Writer:
    """Collects rows of a task and hands them out as batches."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.late: list[tuple[int, int]] = []

    def node(self, forest: Forest, n: int, over: int, saved: list[int], ends: dict, opened: set[int]) -> None:
        least, members, leaves, depth, up = forest.least[n], forest.members[n], forest.leaves[n], forest.depth[n], forest.parent[n]
        path = forest.paths[forest.rep[n]]
        digest = ends.get(n, NOBODY)
        own = digest_of(path, depth) if digest is None else None
        for k, d in enumerate(range(depth, over, -1)):
            top = d == over + 1
            parent = digest_of(path, over) if top and up in opened else None
            if top and up >= 0 and parent is None:
                self.late.append((len(self.rows), up))
            self.rows.append((least, d, None if top else least, members, forest.children[n] if not k else 1, leaves, saved[k],
                              digest if not k else NOBODY, own if not k else None, parent))

    def batches(self, forest: Forest, extra: list[dict]) -> Iterator[pa.RecordBatch]:
        for at, up in self.late:
            row = self.rows[at]
            self.rows[at] = (*row[:2], forest.least[up], *row[3:])
        for first in range(0, len(self.rows), 20_000):
            columns = list(zip(*self.rows[first:first + 20_000], strict=True))
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _NODE, strict=True)]
            arrays += [pa.nulls(len(columns[0]), f.type) for f in list(_SCHEMA)[len(_NODE):]]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)
        for row in extra:
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _contracted(forest: Forest, outer: tuple[int, int], number: int) -> list[dict]:
    """The open nodes as two paths: those above the first conversation, and those above the last that are no part of it."""
    rows, seen = [], set()
    for item in outer:
        nodes, at = [], item
        while at >= 0:
            if at not in seen:
                nodes.append(at)
            seen.add(at)
            at = forest.parent[at]
        if nodes:
            nodes.reverse()
            sums = [v for n in nodes for v in (forest.members[n], forest.least[n], forest.children[n], forest.leaves[n], forest.saved[n])]
            deepest = forest.depth[nodes[-1]]
            rows.append({"forest": number, "path": forest.paths[item][:deepest * KEY], "depths": [forest.depth[n] for n in nodes], "sums": sums})
    return rows


class _Run:
    """Ids of one path, in order: a running digest and the text so far."""

    def __init__(self):
        self.members, self.least, self.parts, self.size = 0, _NONE, [], 0

    def add(self, ids: list[int]) -> None:
        self.members += len(ids)
        self.least = min(self.least, ids[0])
        self.parts.append(",".join(map(str, ids)))

    def digest(self) -> str:
        return hashlib.sha256(",".join(self.parts).encode()).hexdigest()

    def blocks(self, node: bytes, size: int) -> list[dict]:
        """The ids as blocks that a later digest puts one after the other."""
        ids, rows = ",".join(self.parts), []
        while ids:
            cut = ids.find(",", size)
            cut = len(ids) if cut < 0 else cut
            rows.append({"node": node, "first_id": int(ids[:cut].split(",", 1)[0]), "ids": ids[:cut]})
            ids = ids[cut + 1:]
        return rows


def _first_forest(block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv_id, keys) of one task, sorted by (keys, conv_id)."""
        from pyspark import TaskContext
        paths: list[bytes] = []
        runs: list[_Run] = []
        digests: dict[int, str | None] = {}
        for batch in batches:
            keys, ids = batch.column("keys").to_pylist(), batch.column("conv_id").to_pylist()
            first = 0
            while first < len(keys):
                last = first + 1
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                if not paths or paths[-1] != keys[first]:
                    if len(runs) > 1:
                        digests[len(runs) - 1] = runs[-1].digest()
                        runs[-1].parts = []
                    paths.append(keys[first])
                    runs.append(_Run())
                runs[-1].add(ids[first:last])
                first = last
        if not paths:
            return
        ends: dict[int, str | None] = dict(digests)
        extra: list[dict] = []
        for k in {0, len(paths) - 1}:
            ends[k] = None
            extra += runs[k].blocks(digest_of(paths[k], len(paths[k]) // KEY), block)
        depths = [len(p) // KEY for p in paths]
        shared = [0, *(common(a, b) for a, b in zip(paths, paths[1:], strict=False))]
        zeros = [0] * len(paths)
        forest = Forest(paths, depths, shared, [r.members for r in runs], [r.least for r in runs], zeros, zeros, zeros)
        outer = (0, len(paths) - 1)
        opened, put = forest.open_nodes(outer), Writer()
        # A run between the first and the last is whole, also where its node is open.
        extra += [{"node": digest_of(paths[k], depths[k]), "ends_sha256": ends[k]} for k in opened if ends.get(k) is not None]
        forest.closed_rows(opened, ends, put)
        yield from put.batches(forest, extra + _contracted(forest, outer, TaskContext.get().partitionId()))
    return task


def _merged_forest(final: bool, merge: int):
    def task(table: pa.Table) -> pa.Table:
        """The contracted forests of neighbouring tasks. All their nodes, sorted by path, are items of the next forest;
        equal paths add up."""
        items: list[tuple[bytes, int, list[int]]] = []
        rows = list(zip(*(table.column(c).to_pylist() for c in ("forest", "path", "depths", "sums")), strict=True))
        low, high = min(r[0] for r in rows), max(r[0] for r in rows)
        for _, path, depths, sums in rows:
            items += [(path[:d * KEY], d, sums[5 * i:5 * i + 5]) for i, d in enumerate(depths)]
        items.sort(key=lambda item: item[0])
        paths: list[bytes] = []
        sums: list[list[int]] = []
        for path, _, values in items:
            if paths and paths[-1] == path:
                own = sums[-1]
                sums[-1] = [own[0] + values[0], min(own[1], values[1]), *(x + y for x, y in zip(own[2:], values[2:], strict=True))]
            else:
                paths.append(path)
                sums.append(values)
        shared = [0, *(common(a, b) for a, b in zip(paths, paths[1:], strict=False))]
        forest = Forest(paths, [len(p) // KEY for p in paths], shared, *zip(*sums, strict=True))
        # Both ends of the run of tasks; shallower items sort before the first conversation.
        outer = (paths.index(min(r[1] for r in rows if r[0] == low)), paths.index(max(r[1] for r in rows if r[0] == high)))
        opened, put = set() if final else forest.open_nodes(outer), Writer()
        forest.closed_rows(opened, dict.fromkeys(range(len(paths))), put)
        extra = [] if final else _contracted(forest, outer, low // merge)
        return pa.Table.from_batches(list(put.batches(forest, extra)), _SCHEMA)
    return task


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from blocks sorted by (node, first_id): one running hash per node."""
    node, running = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], ["node", "digest"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "digest"])


def trie(rows: DataFrame, tasks: int | None = None, merge: int = MERGE, block: int = BLOCK_CHARS) -> DataFrame:
    """All nodes over ``rows`` (conv_id, keys): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Each conv_id must stand once.

    ``tasks`` range partitions (at least one per ``PARTITION_BYTES`` of keys if not given), ``merge`` forests at a time,
    ids in blocks of about ``block`` characters."""
    spark = rows.sparkSession
    rows = stored(rows.select("conv_id", "keys"), "trie-conversations")
    size = rows.agg(F.sum(F.octet_length("keys") + 8)).first()[0] or 0
    n = tasks or max(partitions(spark), -(-size // PARTITION_BYTES))
    ranged = rows.repartitionByRange(n, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    level = stored(ranged.mapInArrow(_first_forest(block), _DDL), "trie-forests")
    levels, blocks = [level], level.filter("ids is not null").select("node", "first_id", "ids")
    last = level.agg(F.max("forest")).first()[0]
    while last is not None:
        # Numbers of forests are those of the range tasks, so a run of numbers is a run of neighbours.
        final = last < merge
        open_paths = levels[-1].filter("path is not null").withColumn("merged", F.floor(F.col("forest") / merge))
        level = stored(open_paths.groupBy("merged").applyInArrow(_merged_forest(final, merge), _DDL), "trie-forests")
        levels.append(level)
        last = None if final else last // merge
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.filter("depth is not null").select(*[name for name, _ in _NODE])
    if len(levels) == 1:
        return nodes.drop("node", "parent")
    late = levels[1]
    for level in levels[2:]:
        late = late.unionByName(level)
    # Nodes completed by a merge: at most two paths a task. They name the parents and the ends that others wait for.
    late = late.filter("node is not null and depth is not null").select("node", "conv_id")
    digests = blocks.repartition("node").sortWithinPartitions("node", "first_id").select("node", "ids").mapInArrow(_digests, "node binary, digest string")
    digests = digests.unionByName(levels[0].filter("depth is null and ends_sha256 is not null").select("node", F.col("ends_sha256").alias("digest")))
    nodes = lookup(nodes.withColumnRenamed("node", "own"), late.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper")), "parent")
    nodes = lookup(nodes, stored(digests, "trie-digests").withColumnRenamed("node", "own"), "own")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "upper").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", "digest", F.lit(NOBODY)).alias("ends_sha256"))
