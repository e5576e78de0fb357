"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A paragraph is a line; a section ends at a blank line or after a paragraph whose own hash picks it (one in eight), so an
inserted paragraph moves one section's border only. Leaves are sentences of at most 400 code points. Every inner node
hashes its children's digests, the root therefore all of the text: equal roots mean equal texts, and two trees that
differ can be descended to the sentences that differ.

A fingerprint is ``root|section/section/...`` with section = ``digest(paragraph,paragraph,...)``, paragraph =
``digest<leaf leaf ...>`` and leaf = ``digest:length``; inner digests are shortened to 8 hexadecimal digits, the root has 32.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces

LEAF = re.compile(r"[^.!?]{0,400}[.!?]*\s*")
SECTION_ONE_IN = 8


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """root, text form, and the length that each leaf digest stands for."""

    __slots__ = ("root", "form", "leaves", "weight")

    def __init__(self, text: str):
        sections: list[list[tuple[bytes, str]]] = [[]]
        self.leaves: dict[str, int] = {}
        self.weight = 0
        for line in text.split("\n"):
            below, shown = [], []
            for leaf in LEAF.findall(line):
                if leaf:
                    below.append(d := digest(leaf.encode()))
                    shown.append(f"{(h := d[:4].hex())}:{len(leaf)}")
                    self.leaves[h] = self.leaves.get(h, 0) + len(leaf)
                    self.weight += len(leaf)
            d = digest(b"p" + b"".join(below))
            sections[-1].append((d, f"{d[:4].hex()}<{' '.join(shown)}>"))
            if not below or d[15] % SECTION_ONE_IN == 0:
                sections.append([])
        if not sections[-1]:
            sections.pop()
        tops, shown = [], []
        for section in sections:
            tops.append(d := digest(b"s" + b"".join([p for p, _ in section])))
            shown.append(f"{d[:4].hex()}({','.join([s for _, s in section])})")
        self.root = digest(b"d" + b"".join(tops)).hex()
        self.form = f"{self.root}|{'/'.join(shown)}"

    def likeness(self, other: Tree) -> float:
        """Share of the code points of both that lie in sentences which both have: 1 for equal roots, 0 for nothing in common."""
        if self.root == other.root:
            return 1.0
        few, many = sorted((self.leaves, other.leaves), key=len)
        shared = sum(min(n, many[h]) for h, n in few.items() if h in many)
        return min(2 * shared / max(1, self.weight + other.weight), 1 - 1e-9)


def differing_paragraphs(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of a's fingerprint whose paragraphs b's does not have; sections that b has are not descended."""
    if a.split("|")[0] == b.split("|")[0]:
        return []
    parse = lambda f: [(s[:8], re.findall(r"([0-9a-f]{8})<", s[8:])) for s in f.split("|")[1].split("/")]
    theirs = parse(b)
    sections, paragraphs = {s for s, _ in theirs}, {p for _, ps in theirs for p in ps}
    return [(i, j) for i, (s, ps) in enumerate(parse(a)) if s not in sections for j, p in enumerate(ps) if p not in paragraphs]


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(text: str) -> str:
    return Tree(text).form


def _bucket(value: Column, splits: list) -> Column:
    """How many of the ascending splits are at most value, by binary search over a literal array."""
    if not splits:
        return F.lit(0)
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]
    held = F.array(*map(F.lit, splits))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.try_element_at(held, at + step) <= value, at + step).otherwise(at),
    )


def in_order_with_next(df: DataFrame, key: str) -> DataFrame:
    """df with columns bucket_, wrap_, copy_, one bucket a partition, sorted by key; each bucket ends with a copy of what follows it.

    One shuffle: ranges are cut at quantiles of the key, and the first row of each range also travels to the range before
    (the first row of all to the last range). The driver holds two numbers a partition.
    """
    n = partitions(df.sparkSession)
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).head()[0] if n > 1 else []
    splits = sorted(set(cuts or []))
    bucket = _bucket(F.col(key), splits)
    firsts = dict(df.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.min(key)).collect())
    held = sorted(firsts)
    first_of = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(len(splits) + 1)])
    before = F.array(*[F.lit(max([x for x in held if x < b], default=held[-1] if held else 0)) for b in range(len(splits) + 1)])
    place = lambda b, wrap, copy: F.struct(b.alias("bucket_"), F.lit(wrap).alias("wrap_"), F.lit(copy).alias("copy_"))
    own = F.array(place(F.col("b_"), 0, False))
    led = F.col(key) == F.element_at(first_of, F.col("b_") + 1)
    prior = F.element_at(before, F.col("b_") + 1)
    first = F.lit(held[0] if held else 0)
    places = F.when(
        led & (F.col("b_") == first),
        F.array(place(F.col("b_"), 0, False), place(prior, 1, True)),
    ).when(led, F.array(place(F.col("b_"), 0, False), place(prior, 0, True))).otherwise(own)
    spread = df.withColumn("b_", bucket).withColumn("at_", F.explode(places)).select("at_.*", *df.columns)
    return spread.repartitionById(len(splits) + 1, F.col("bucket_")).sortWithinPartitions("wrap_", key, "copy_", "text")


def document_fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text (see edited), with their likenesses.

    The next document is the one that follows by ascending doc_id; the first follows the last. Null texts count as empty.
    Rows with a null doc_id come first, and rows that share a doc_id follow each other by text. With one row, that row
    follows itself. An empty table gives an empty result. Other columns are ignored.
    """
    rows = in_order_with_next(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), "doc_id")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ],
    )

    def finished(row: tuple[int, str, Tree], following: str, tree: Tree) -> tuple:
        doc_id, text, own = row
        changed = edited(text, following)
        new = Tree(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.form, new.form, own.likeness(new), own.likeness(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for part in pieces(batch):
                out = []
                for copy, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("copy_", "doc_id", "text")), strict=True):
                    if copy and waiting is None:
                        continue
                    tree = Tree(text)
                    if waiting is not None:
                        out.append(finished(waiting, text, tree))
                    waiting = None if copy else (doc_id, text, tree)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                        schema=schema,
                    )
        if waiting is not None:  # only if no row has a doc_id: nothing follows
            out = [finished(waiting, "", Tree(""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
