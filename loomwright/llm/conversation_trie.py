"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, merged by Spark."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import give_back, small_batches
from loomwright.plans.joins import salted_join
from loomwright.plans.ranks import ranked
from loomwright.session import stored

ID_BYTES = 16
CHUNK_PATHS = 4096
CHUNK_BYTES = 1 << 22
TEXT_BYTES = 1 << 15


class Few:
    """Children of up to ``most`` next bytes, as two sorted lists."""

    __slots__ = ("bytes", "most", "nodes")

    def __init__(self, most: int, keys: list[int] | None = None, nodes: list[Node] | None = None):
        self.most, self.bytes, self.nodes = most, keys or [], nodes or []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.most:
            grown = Few(16, self.bytes, self.nodes) if self.most == 4 else Indexed(self)
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)


class Indexed:
    """Children of up to 48 next bytes: a place per byte, and the nodes in the order they came."""

    __slots__ = ("nodes", "places")

    def __init__(self, few: Few):
        self.places, self.nodes = bytearray([255]) * 256, list(few.nodes)
        for at, byte in enumerate(few.bytes):
            self.places[byte] = at

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if self.places[byte] != 255:
            self.nodes[self.places[byte]] = node
            return self
        if len(self.nodes) == 48:
            return Full(self).put(byte, node)
        self.places[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.nodes[at] for at in self.places if at != 255)


class Full:
    """A child for each of 256 next bytes."""

    __slots__ = ("nodes",)

    def __init__(self, indexed: Indexed):
        self.nodes: list[Node | None] = [indexed.get(byte) for byte in range(256)]

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator[Node]:
        return (node for node in self.nodes if node is not None)


class Node:
    """The keys that go on as ``key[:end]``. The bytes from the node above down to ``end`` are not unfolded."""

    __slots__ = ("children", "end", "key", "path")

    def __init__(self, key: bytes, end: int):
        self.key, self.end = key, end
        self.path: int | None = None  # the key that ends here
        self.children: Few | Indexed | Full | None = None

    def attach(self, node: Node) -> None:
        if self.children is None:
            self.children = Few(4)
        self.children = self.children.put(node.key[self.end], node)


def common(one: bytes, other: bytes, start: int, end: int) -> int:
    """The first place from ``start`` to ``end`` at which two keys differ."""
    if one[start:end] == other[start:end]:
        return end
    low, high = start, end
    while high - low > 1:
        middle = (low + high) // 2
        if one[start:middle] == other[start:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Adaptive radix tree of distinct byte keys."""

    def __init__(self):
        self.root = Node(b"", 0)

    def add(self, key: bytes, path: int) -> None:
        node = self.root
        while True:
            if node.end == len(key):
                node.path = path
                return
            child = node.children.get(key[node.end]) if node.children is not None else None
            if child is None:
                leaf = Node(key, len(key))
                leaf.path = path
                node.attach(leaf)
                return
            at = common(key, child.key, node.end, min(child.end, len(key)))
            if at < child.end:
                fork = Node(child.key, at)
                fork.attach(child)
                node.children = node.children.put(key[node.end], fork)
                child = fork
            node = child


@dataclass
class Path:
    """A distinct sequence of turns below a block's top."""

    key: bytes
    sizes: list[int]  # UTF-8 bytes of each turn's text
    count: int  # conversations
    least: int
    leaves: int  # of the block that goes on at its end, 0 without one
    saved: int
    children: int
    goes_on: bool


def turns_shared(one: bytes, other: bytes) -> int:
    return common(one, other, 0, min(len(one), len(other))) // ID_BYTES


def node_id(block: bytes, inner: bytes) -> bytes:
    return hashlib.sha256(block + inner).digest()[:ID_BYTES]


#: (node, parent, depth, conversations, least, children, leaves, saved)
Partial = tuple[bytes, bytes, int, int, int, int, int, int]


def partial_nodes(block: bytes, paths: list[Path], before: bytes | None, behind: bytes | None) -> tuple[list[Partial], tuple[int, int, int]]:
    """What these neighbouring paths of a block add to each of its nodes, and to the block's top (children, leaves, saved).

    ``before`` and ``behind`` are the neighbours' keys. A node that the path before has too is counted as a child, and
    with the bytes of its text, where that path is. What is added up over all parts of a block is its whole sum.
    """
    tree = RadixTree()
    for k, path in enumerate(paths):
        tree.add(path.key, k)
    known = turns_shared(before, paths[0].key) if before is not None else 0
    first = paths[0].key
    ids: dict[int, tuple[bytes, list[bytes]]] = {}  # ids along the path walked last, by depth
    walked, trail = b"", []

    def ids_of(key: bytes) -> list[bytes]:
        nonlocal walked, trail
        keep = turns_shared(walked, key)
        inner = hashlib.sha256(key[: keep * ID_BYTES])
        del trail[keep:]
        for d in range(keep, len(key) // ID_BYTES):
            inner.update(key[d * ID_BYTES: (d + 1) * ID_BYTES])
            trail.append(node_id(block, inner.digest()))
        walked = key
        return trail

    out: list[Partial] = []
    sums: dict[int, list[int]] = {}  # by id of the tree's node: conversations, least, children, leaves, saved
    stack: list[tuple[Node, Node | None, bool]] = [(tree.root, None, False)]
    top = (0, 0, 0)
    while stack:
        node, above, done = stack.pop()
        if not done:
            stack.append((node, above, True))
            stack += [(child, node, False) for child in reversed([*(node.children or ())])]
            continue
        total = [0, 1 << 63, 0, 0, 0]
        for child in node.children or ():
            part = sums.pop(id(child))
            total = [total[0] + part[0], min(total[1], part[1]), total[2] + part[2], total[3] + part[3], total[4] + part[4]]
        if node.path is not None:
            path = paths[node.path]
            extended = node.children is not None or (node.path == len(paths) - 1 and behind is not None and behind.startswith(path.key))
            total[0] += path.count
            total[1] = min(total[1], path.least)
            total[2] += path.children
            total[3] += path.leaves if path.goes_on else 0 if extended else 1
            total[4] += path.saved
        if above is None:
            top = (total[2], total[3], total[4])
            break
        key, trail_ids = node.key, None
        sizes = None
        for depth in range(node.end // ID_BYTES, above.end // ID_BYTES, -1):
            if trail_ids is None:
                trail_ids = ids_of(key[: node.end // ID_BYTES * ID_BYTES])
                sizes = paths[_some_path(node)].sizes
            new = depth > known or not first.startswith(key[: depth * ID_BYTES])
            total[4] += (total[0] - new) * sizes[depth - 1]
            out.append((trail_ids[depth - 1], trail_ids[depth - 2] if depth > 1 else block, depth, *total))
            total[2] = int(new)
        sums[id(node)] = total
    return out, top


def _some_path(node: Node) -> int:
    while node.path is None:
        node = next(iter(node.children))
    return node.path


@dataclass(frozen=True)
class ConversationTrie:
    """The trie of conversations, each rebuilt behind the head of another one: nodes are distinct leading turns.

    Turns of a conversation stand by turn (NULL first), equal turn numbers by the SHA-256 of role and text; NULL role or
    text is empty. Conversation c becomes the first h turns of conversation c - c % 5 (none if there is none) and its own
    turns behind its first h, with h = crc32(c as text) % 9. Rows without ``conv_id`` belong to no conversation and play
    no part. Repeated rows are turns of their own. An empty table has no node; other columns play no part.

    1. A turn becomes an id of 16 bytes, the head of the SHA-256 of role and text, so texts are read once and never
       shuffled. Places in a conversation are counted over ranges of rows, so one of any length is spread.
    2. A conversation is cut into segments of ``segment`` turns; a segment hangs below a block, named by a hash of all
       before it. Equal segments of a block are one path, counted before they are shuffled.
    3. Paths are sorted in ranges of (block, key). Each task builds adaptive radix trees over the turn ids of neighbouring
       paths, in chunks, and emits a part of each node at byte depths that are whole turns. The neighbours' keys at the
       ends of a range tell which nodes are counted there already, so parts add up to exact sums, whatever the cuts.
    4. A block below another hands its sums up, one job per ``segment`` turns that conversations share; blocks with one
       conversation need no job.

    The digest of the ids that end at a node is made from pieces of text in their order; a hash of one long text is the
    one thing here that a single task must read in order, piece by piece.
    """

    segment: int = 256
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"

    def __call__(self, rows: DataFrame) -> DataFrame:
        convs, segments = self._segments(rows)
        paths = stored(segments.groupBy("level", "block", "key").agg(
            F.count("*").alias("count"), F.min("conv").alias("least"), F.first("sizes").alias("sizes"),
            F.first("next").alias("next")), "trie-paths")
        nodes, top = self._nodes(paths)
        nodes = stored(nodes, "trie-nodes")
        share = max(1000, nodes.count() // 1000)
        parents = nodes.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
        families = nodes.groupBy("parent").agg(F.count("*").alias("_n"))
        first = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        by_parent = nodes.select("parent", "least", "node", "depth", "count", "children", "leaves", "saved")
        inner = salted_join(by_parent, parents.unionByName(first.select(F.lit(b"").alias("parent"), F.col("conv_id").alias("parent_conv_id"))),
                            ["parent"], counts=families, rows_per_task=share)
        inner = inner.select("node", F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("count").alias("n_convs"),
                             F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        root = first.select(
            F.lit(b"").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.lit(top[0]).cast("long").alias("n_children"), F.lit(max(top[1], 1)).cast("long").alias("n_leaves"),
            F.lit(top[2]).cast("long").alias("saved_tokens"))
        ends = (segments.where("last").select(self._id(F.col("block"), F.col("key")).alias("node"), "conv")
                .unionByName(convs.where("turns = 0").select(F.lit(b"").alias("node"), "conv")))
        out = inner.unionByName(root).join(self.digests(ends), "node", "left")
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

    @staticmethod
    def _id(block: Column, key: Column) -> Column:
        return F.substring(F.unhex(F.sha2(F.concat(block, F.unhex(F.sha2(key, 256))), 256)), 1, ID_BYTES)

    def turns(self, rows: DataFrame) -> DataFrame:
        """conv, place (from 0), id and size of every turn."""
        role, text = F.coalesce(F.col(self.role), F.lit("")), F.coalesce(F.col(self.text), F.lit(""))
        named = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
        slim = stored(rows.where(F.col(self.conv).isNotNull()).select(
            F.col(self.conv).cast("long").alias("conv"), F.col(self.turn).alias("turn"),
            F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, ID_BYTES).alias("id"),
            F.octet_length(text).cast("long").alias("size")), "turns")
        return ranked(slim, ["conv"], [F.col("turn").asc_nulls_first(), F.col("id")], "place", tie="row").select("conv", "place", "id", "size")

    def _segments(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """conv and turns of every conversation; and level, block, key, sizes, next, last and conv of every segment."""
        turns = stored(self.turns(rows), "placed-turns")
        head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
        own = turns.groupBy("conv").agg(F.count("*").alias("own"))
        heads = (turns.where((F.col("place") < 8) & (F.col("conv") % 5 == 0)).groupBy(F.col("conv").alias("base"))
                 .agg(F.array_sort(F.collect_list(F.struct("place", "id", "size"))).alias("head")))
        convs = stored(own.withColumn("h", head).withColumn("base", F.col("conv") - F.col("conv") % 5).join(heads, "base", "left").select(
            "conv", "own", "h", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))).alias("head")), "heads")
        lead = F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)).cast("long")
        convs = convs.withColumn("lead", lead).withColumn("turns", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        share = max(1000, turns.count() // 1000)
        behind = salted_join(turns.withColumn("h", head).where("place >= h"), convs.select("conv", "lead"), ["conv"],
                             counts=convs.select("conv", F.col("own").alias("_n")), rows_per_task=share)
        rebuilt = behind.select("conv", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "id", "size").unionByName(
            convs.select("conv", F.explode("head").alias("t")).select("conv", "t.place", "t.id", "t.size"))
        level = F.floor(F.col("place") / F.lit(self.segment)).cast("long")
        cut = rebuilt.groupBy("conv", level.alias("level")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "size"))).alias("t"))
        key = F.aggregate("t", F.lit(b""), lambda made, t: F.concat(made, t["id"]))
        cut = stored(cut.select("conv", "level", key.alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes")), "segments")
        last = convs.select("conv", F.floor((F.col("turns") - 1) / F.lit(self.segment)).cast("long").alias("end"))
        # blocks of conversations that go on below their first segment: each is named by a hash of all above
        longer = cut.join(last.where("end > 0"), "conv").groupBy("conv").agg(
            F.array_sort(F.collect_list(F.struct("level", F.unhex(F.sha2("key", 256)).alias("hash")))).alias("hashes"))
        chain = F.aggregate("hashes", F.array(F.lit(b"")), lambda names, s: F.concat(
            names, F.array(F.substring(F.unhex(F.sha2(F.concat(F.element_at(names, -1), s["hash"]), 256)), 1, ID_BYTES))))
        blocks = longer.select("conv", F.posexplode(chain).alias("level", "block")).select("conv", F.col("level").cast("long").alias("level"), "block")
        blocks = stored(blocks, "blocks")
        named = cut.join(blocks, ["conv", "level"], "left")
        ending = F.octet_length("key") < self.segment * ID_BYTES
        # the last of a conversation's names is for what would follow
        going = blocks.groupBy("conv").agg(F.max("level").alias("blocks"))
        named = named.join(going, "conv", "left").withColumn(
            "last", ending | F.col("blocks").isNull() | (F.col("level") + 1 >= F.col("blocks")))
        segments = stored(named.select(
            "conv", "level", F.coalesce("block", F.lit(b"")).alias("block"), "key", "sizes", "last",
            F.when(ending, F.lit(None).cast("binary")).otherwise(self._id(F.coalesce("block", F.lit(b"")), F.col("key"))).alias("next")), "trie-segments")
        return convs, segments

    def _nodes(self, paths: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
        """All nodes but the root, and the root's children, leaves and saved."""
        blocks = stored(paths.where("level > 0").groupBy("level", "block").agg(
            F.sum("count").alias("convs"), F.count("*").alias("paths")), "trie-blocks")
        # below a block with one conversation nothing is shared
        lone = blocks.where("convs = 1").select(F.col("block").alias("next"), F.lit(1).cast("long").alias("children"),
                                                F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        shared = blocks.where("convs > 1")
        deepest = shared.agg(F.max("level")).first()[0] or 0
        sums, nodes, top = lone, None, None
        for level in range(deepest, -1, -1):
            if level:
                own = paths.where(F.col("level") == level).join(shared.select("block"), "block", "left_semi")
            else:  # blocks of one conversation need nothing from below, so they go with the top level
                own = paths.where(F.col("level") == 0).unionByName(paths.join(blocks.where("convs = 1").select("block"), "block", "left_semi"))
            parts = stored(self._parts(own.join(sums, "next", "left")), "trie-parts")
            made = parts.where("depth > 0").groupBy("node", "parent", "depth").agg(
                F.sum("count").alias("count"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
            nodes = made if nodes is None else nodes.unionByName(made)
            tops = parts.where("depth = 0").groupBy(F.col("node").alias("next")).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
            sums = stored(sums.unionByName(tops), "trie-sums") if level else sums
            top = tops
        root = top.where(F.octet_length("next") == 0).first()
        return nodes, (root["children"], root["leaves"], root["saved"]) if root is not None else (0, 0, 0)

    def _parts(self, paths: DataFrame) -> DataFrame:
        segment = self.segment
        dealt = stored(paths.repartitionByRange("block", "key").withColumn("part", F.spark_partition_id()), "trie-ranges")
        # one row per range, of two keys of at most ``segment`` ids
        rows = dealt.groupBy("part").agg(F.min(F.struct("block", "key")).alias("low"), F.max(F.struct("block", "key")).alias("high")).collect()
        rows.sort(key=lambda r: r["part"])
        beside: dict[int, tuple] = {}
        for k, row in enumerate(rows):
            left = rows[k - 1]["high"] if k else None
            right = rows[k + 1]["low"] if k + 1 < len(rows) else None
            beside[row["part"]] = tuple((bytes(x["block"]), bytes(x["key"])) if x is not None else None for x in (left, right))
        ends = dealt.sparkSession.sparkContext.broadcast(beside)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, list[Path], bytes | None, bytes | None]]:
            """Runs of neighbouring paths of a block, with the keys beside them."""
            held: list[Path] = []
            now = before = None  # (part, block, level); (block, key) of the path before

            def cut(behind: tuple[bytes, bytes] | None) -> tuple[bytes, int, list[Path], bytes | None, bytes | None]:
                block = now[1]
                return (block, now[2], held, before[1] if before is not None and before[0] == block else None,
                        behind[1] if behind is not None and behind[0] == block else None)

            size = 0
            for batch in batches:
                for part, level, block, key, sizes, count, least, goes_on, leaves, saved, children in zip(
                        *(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                    if held and ((part, block) != now[:2] or len(held) >= CHUNK_PATHS or size >= CHUNK_BYTES):
                        yield cut((block, key) if part == now[0] else ends.value[now[0]][1])
                        before = (now[1], held[-1].key) if part == now[0] else ends.value[part][0]
                        held, size = [], 0
                    elif not held:
                        before = ends.value[part][0]
                    now = (part, block, level)
                    size += len(key)
                    held.append(Path(key, sizes, count, least, leaves, saved, children, goes_on))
            if held:
                yield cut(ends.value[now[0]][1])

        def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, level, held, before, behind in chunks(batches):
                nodes, (children, leaves, saved) = partial_nodes(block, held, before, behind)
                nodes = [(n, p, level * segment + d, *rest) for n, p, d, *rest in nodes]
                nodes.append((block, b"", 0, 0, 0, children, leaves, saved))
                for k in range(0, len(nodes), 10_000):
                    columns = zip(*nodes[k: k + 10_000], strict=True)
                    kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NODE_NAMES)
            give_back()

        zero = F.lit(0).cast("long")
        slim = dealt.select("part", "level", "block", "key", "sizes", "count", "least", F.col("leaves").isNotNull().alias("goes_on"),
                            *[F.coalesce(c, zero).alias(c) for c in ("leaves", "saved", "children")])
        return small_batches(slim.repartition("part").sortWithinPartitions("part", "block", "key")).mapInArrow(walked, NODE_SCHEMA)

    def digests(self, ends: DataFrame) -> DataFrame:
        """node and ends_sha256: the hash of a node's decimal ids (conv), ascending, joined by commas."""

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, first, held, size = None, 0, [], 0
            out: list[tuple] = []
            for batch in batches:
                for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and (own != node or size >= TEXT_BYTES):
                        out.append((node, first, ",".join(held)))
                        held, size = [], 0
                    if not held:
                        node, first = own, conv
                    held.append(str(conv))
                    size += len(held[-1]) + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "first", "ids"])
                    out = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first]), pa.array([",".join(held)])], names=["node", "first", "ids"])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, state = None, None
            for batch in batches:
                out = []
                for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if state is not None and own == node:
                        state.update(b",")
                    else:
                        if state is not None:
                            out.append((node, state.hexdigest()))
                        node, state = own, hashlib.sha256()
                    state.update(ids.encode())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "ends_sha256"])
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        texts = small_batches(ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")).mapInArrow(
            pieces, "node binary, first long, ids string")
        return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


NODE_NAMES = ["node", "parent", "depth", "count", "least", "children", "leaves", "saved"]
NODE_SCHEMA = "node binary, parent binary, depth long, count long, least long, children long, leaves long, saved long"
