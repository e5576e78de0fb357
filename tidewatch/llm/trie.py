"""Conversation prefix trie: adaptive radix trees over turn ids, merged along the borders of their ranges.

A turn is named by 16 bytes (MD5 of its role and text, separated), so that a conversation is a string of fixed-width ids
and a prefix of turns is a prefix of bytes. Equal conversations are counted once, with their number and smallest id. The
distinct ones are sorted by range, and every block of a range is put into an adaptive radix tree: nodes of 4, 16, 48 or 256
places that grow as they fill, with compressed paths. Only byte depths that are whole turns emit nodes.

A node inside a block is finished there. Only the nodes along a block's first and last conversation may go on in a neighbouring
block; they are merged by their name, and their subtrees summed over doubling distances. A hot first turn therefore
spreads over many ranges, and a conversation repeated by a third of all ids is one string.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, cut, join_facts, partitions

#: Bytes of a turn id; distinct conversations in one tree, and the most bytes of their ids.
WIDTH, BLOCK, BLOCK_BYTES = 16, 20_000, 16 << 20
#: Conversations whose turns come from the same one begin at a multiple of this id.
FAMILY = 20

PIECES = "path binary, words array<int>, conv_id long, n long, ids string"
NODES = (
    "name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, n_words long, ends_sha256 string, partial boolean, parent_partial boolean"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOBODY = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(df: DataFrame) -> DataFrame:
    """conv_id, path (the ids of its turns, concatenated), words (of each turn) of every rebuilt conversation.

    Conversation c takes the first h turns of conversation c - c mod 20, then its own after its first h; h is the unsigned CRC-32 of
    its decimal id modulo 4. Turns are ordered by turn, a null one first, ties by turn id. Only ids travel, no texts.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(said("role")).cast("string"), F.lit(":"), said("role"), said("text"))))
    n_words = F.size(F.filter(F.split(said("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    order = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"), turn.alias("id"), n_words.alias("n"))
    held = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    begin = held.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, 3).alias("begin"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    own = held.withColumn("base", base).join(begin, "base", "left").withColumn("h", h)
    whole = F.concat(F.when(F.col("begin").isNotNull(), F.slice("begin", 1, F.col("h"))).otherwise(F.slice("t", 1, 0)), F.slice("t", F.col("h") + 1, F.size("t")))
    path = F.unhex(F.array_join(F.transform("whole", lambda t: F.hex(t.id)), ""))
    return own.withColumn("whole", whole).select("conv_id", path.alias("path"), F.transform("whole", lambda t: t.n).alias("words"))


def member_lists(convs: DataFrame) -> DataFrame:
    """PIECES: ids of equal conversations, ascending and comma-joined, in pieces of at most a million.

    Rows are ranged by (path, conv_id), so the members of one path may fill many ranges; the pieces of a path are in order of conv_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # path, words, first id, ids
        for batch in batches:
            out = []
            for path, words, conv_id in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "conv_id")), strict=True):
                if held and held[0] == path and len(held[3]) < 1_000_000:
                    held[3].append(conv_id)
                    continue
                if held:
                    out.append((*held[:3], len(held[3]), ",".join(map(str, held[3]))))
                held = [path, words, conv_id, [conv_id]]
            yield batch_of(out, schema)
        if held:
            yield batch_of([(*held[:3], len(held[3]), ",".join(map(str, held[3])))], schema)

    schema, n = arrow_schema(PIECES), partitions(convs.sparkSession)
    return convs.repartitionByRange(n, F.substring("path", 1, 16 * WIDTH), "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, PIECES)


class Node:
    """A node of the adaptive radix tree: its compressed path, its children, and what ends in it.

    Up to 4 or 16 children lie in sorted lists of bytes and nodes; up to 48 behind a table of 256 places; more in 256 places.
    """

    __slots__ = ("prefix", "keys", "children", "value")

    def __init__(self, prefix: bytes, value=None):
        self.prefix = prefix
        self.keys: bytearray | None = bytearray()
        self.children: list = []
        self.value = value

    def find(self, byte: int):
        if self.keys is None:
            return self.children[byte]
        if len(self.keys) == 256:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        at = self.keys.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, child: Node) -> None:
        """Enters or replaces the child below a byte; a full layout grows into the next."""
        if self.keys is None:
            self.children[byte] = child
            return
        if len(self.keys) == 256:
            if at := self.keys[byte]:
                self.children[at - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.keys[byte] = len(self.children)
            else:
                self.children = [self.children[at - 1] if at else None for at in self.keys]
                self.children[byte] = child
                self.keys = None
            return
        at = self.keys.find(byte)
        if at >= 0:
            self.children[at] = child
        elif len(self.children) < 16:
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.children.insert(at, child)
        else:
            table = bytearray(256)
            for i, k in enumerate(self.keys):
                table[k] = i + 1
            self.keys = table
            self.put(byte, child)

    def ordered(self) -> list[Node]:
        """Children by ascending byte."""
        if self.keys is None:
            return [c for c in self.children if c is not None]
        if len(self.keys) == 256:
            return [self.children[at - 1] for at in self.keys if at]
        return self.children


def insert(root: Node, path: bytes, value) -> None:
    """Enters a string that is not in the tree yet; the root's own path is empty."""
    node, at = root, 0
    while at < len(path):
        child = node.find(path[at])
        if child is None:
            node.put(path[at], Node(path[at:], value))
            return
        own, n = child.prefix, 0
        most = min(len(own), len(path) - at)
        if own == path[at : at + len(own)]:
            n = len(own)
        else:
            while n < most and own[n] == path[at + n]:
                n += 1
        if n < len(own):  # the compressed path splits
            upper = Node(own[:n])
            node.put(own[0], upper)
            child.prefix = own[n:]
            upper.put(own[n], child)
            child = upper
        node, at = child, at + n
    node.value = value


def name_of(path: bytes) -> bytes:
    return hashlib.md5(path).digest()


class Frame:
    """A turn node being summed up while its subtree is walked."""

    __slots__ = ("below", "children", "depth", "ends", "leaves", "least", "n", "name", "partial", "path", "saved", "words")

    def __init__(self, path: bytes, words: int, partial: bool):
        self.path, self.name, self.depth, self.words, self.partial = path, name_of(path), len(path) // WIDTH, words, partial
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = NOBODY
        self.below: list[list] = []

    def count(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def turn_nodes(root: Node, words_of: dict[bytes, int], first: bytes, last: bytes) -> Iterator[list]:
    """Rows of NODES for every turn-aligned depth of a tree whose values are (n, smallest conv_id, ends_sha256).

    Nodes along the paths first and last are partial: of their subtree they count only finished nodes, and not themselves.
    """

    def close() -> Iterator[list]:
        f = frames.pop()
        if not f.partial:
            f.leaves = f.leaves or int(not f.children)
            f.saved += (f.n - 1) * f.words
        for row in f.below:
            row[4] = f.least
            yield row
        up = frames[-1] if frames else None
        row = [f.name, up and up.name, f.depth, f.least, None, f.n, f.children, f.leaves, f.saved, f.words, f.ends, f.partial, bool(up and up.partial)]
        if up is None:
            yield row
            return
        up.count(f.n, f.least)
        if not f.partial:
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + f.leaves, up.saved + f.saved
        if up.partial:  # its smallest conv_id is not known yet
            yield row
        else:
            up.below.append(row)

    frames = [Frame(b"", 0, True)]
    path = bytearray()
    steps: list[tuple[Node | None, int]] = [(root, 0)]
    while steps:
        node, at = steps.pop()
        if node is None:  # all below a byte node is done: close the turns that lie on its compressed path
            while len(frames[-1].path) > at:
                yield from close()
            del path[at:]
            continue
        path += node.prefix
        for end in range((at // WIDTH + 1) * WIDTH, len(path) + 1, WIDTH):
            prefix = bytes(path[:end])
            frames.append(Frame(prefix, words_of[prefix[-WIDTH:]], first.startswith(prefix) or last.startswith(prefix)))
        if node.value is not None:
            n, least, ends = node.value
            frames[-1].count(n, least)
            frames[-1].ends = ends
        steps.append((None, at))
        steps += [(child, len(path)) for child in reversed(node.ordered())]
    yield from close()


def tree_nodes(pieces_: DataFrame) -> DataFrame:
    """NODES of all blocks: a path's pieces come together in one range, in order, and are hashed as they stream by."""

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        root, words_of = Node(b""), {}
        for path, words, n, least, ends in held:
            insert(root, path, (n, least, ends))
            words_of.update((path[i * WIDTH : (i + 1) * WIDTH], w) for i, w in enumerate(words))
        nodes = turn_nodes(root, words_of, held[0][0], held[-1][0])
        while rows := list(itertools.islice(nodes, 10_000)):
            yield batch_of(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: list = []  # path, words, n, least, hash of the ids so far
        size = 0
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "words", "conv_id", "n", "ids")), strict=True))
        for path, words, least, n, ids in itertools.chain(rows, [(None,) * 5]):
            if now and now[0] == path:
                now[2] += n
                now[4].update(b"," + ids.encode())
                continue
            if now:
                held.append((*now[:4], now[4].hexdigest()))
                size += len(now[0])
            if held and (path is None or len(held) >= BLOCK or size >= BLOCK_BYTES):
                yield from block(held)
                held, size = [], 0
            if path is not None:
                now = [path, words, n, least, hashlib.sha256(ids.encode())]

    schema, n = arrow_schema(NODES), partitions(pieces_.sparkSession)
    return pieces_.repartitionByRange(n, F.substring("path", 1, 16 * WIDTH)).sortWithinPartitions("path", "conv_id").mapInArrow(run, NODES)


def merged_borders(nodes: DataFrame) -> DataFrame:
    """The partial nodes, one row a name, completed: their subtrees are summed over distances of 1, 2, 4, ... turns."""
    one = nodes.where("partial").groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("n_words").alias("n_words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOBODY, F.col("ends_sha256"))), F.lit(NOBODY)).alias("ends_sha256"),
    )
    one = cut(one)
    below = one.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("more"))
    n_children = F.col("n_children") + F.coalesce("more", F.lit(0))
    one = one.join(below, "name", "left").withColumn("n_children", n_children).drop("more")
    own = one.select(
        "name", F.col("parent").alias("up"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
    )
    sums = cut(own)
    deepest = one.agg(F.max("depth")).head()[0] or 0
    for _ in range(deepest.bit_length()):
        farther = sums.select(F.col("name").alias("up"), F.col("up").alias("up2"))
        under = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        got = sums.join(under, "name", "left").join(farther, "up", "left")
        sums = cut(got.select("name", F.col("up2").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    done = one.drop("n_leaves", "saved_tokens").join(sums.select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "name")
    return cut(done.join(one.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left"))


def conversation_trie(df: DataFrame) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations of df (conv_id, turn, role, text); see rebuilt_conversations.

    conv_id is the node's smallest member; n_children, n_leaves and saved_tokens (over the subtree, (n_convs - 1) times the words
    of the node's last text) count the whole trie; ends_sha256 hashes the ids of the conversations that end in the node. Rows
    without a conv_id are ignored; null roles and texts are empty, an empty text is a turn without words; repeated rows are
    turns of their own. Other columns are ignored. An empty table has no nodes.
    """
    nodes = cut(tree_nodes(cut(member_lists(rebuilt_conversations(df)))))
    borders = merged_borders(nodes)
    inner = nodes.where("NOT partial AND NOT parent_partial")
    outer = nodes.where("NOT partial AND parent_partial").drop("parent_conv_id")
    parents = borders.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    joined = join_facts(outer, parents, ["parent"], F.col("name"))
    return inner.select(RESULT).unionByName(joined.select(RESULT)).unionByName(borders.select(RESULT))
