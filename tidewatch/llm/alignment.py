"""Alignment of two tokenizers over the same text: where tokens of both end, and how often their ids meet.

Every token of A and of B covers a byte range of the same string. The ends of both, cumulated, are put into dictionaries from
end to index; the intersection of their key sets, sorted, cuts both id lists into groups of equal bytes. Within a group every
pair of an A and a B token whose ranges overlap is a link.

Counts of id pairs over the corpus go through Spark in aggregated form: a slice of a partition (a few MB of text) writes its
distinct pairs with their counts, once, and for every document which of them it holds how often. Pairs are summed over all
slices, compared with the highest count of their B id, and go back to the slices that hold them, where the documents' sums are
made. Texts are encoded once, no link travels on its own, and the most frequent pair has one row a slice. What a slice's documents
hold travels packed, as Spark reads a whole file's arrays at once and only Python looks into them.
"""

from __future__ import annotations

import ctypes
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import cut, pieces, task_memory

#: Bytes of text in a slice; groups whose text form and links a task remembers.
SLICE, REMEMBERED = 4 << 20, 100_000
#: An id pair in one number: B's id above A's, so that pairs of one B id are neighbours.
SHIFT = 32

SLICES = "slice long, pair array<long>, n array<int>, documents binary"
#: What is packed in documents, as one row: each document's figures, the end of its part of held and times, the pairs held as steps.
DOCUMENTS = pa.schema([
    *((c, pa.list_(pa.int64() if c == "doc_id" else pa.int32())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups_sha256", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("upto", "held", "times")),
])
NONE = np.empty(0, np.int64)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


#: Fixed value: how byte-level vocabularies split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with so many blanks in a row go to the slower library, whose splitting does not backtrack over them.
BLANKS = re.compile(r"\s{10000}")


def byte_level(content: bytes) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """An encoder of a byte-level vocabulary, to which special strings are plain text, and the bytes of each id.

    The vocabulary's ids above the single bytes are the ranks of its merges, so tiktoken gives the same ids as the vocabulary's own
    library (a test goes through all code points) in a third of the time. Other vocabularies are refused.
    """
    import tiktoken
    from tokenizers import Tokenizer

    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    spec = json.loads(content)
    ids, split = spec["model"]["vocab"], spec["pre_tokenizer"]
    tokens = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
    special = {t["content"] for t in spec["added_tokens"]}
    for token, i in ids.items():
        tokens[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    ranked = all(ids[x + y] == 256 + rank for rank, (x, y) in enumerate(pairs))
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or not ranked:
        raise ValueError("not a plain byte-level vocabulary with ids in the order of its merges")
    fast = tiktoken.Encoding("A", pat_str=SPLIT, mergeable_ranks={tokens[i]: i for t, i in ids.items() if t not in special}, special_tokens={})
    slow = Tokenizer.from_str(content.decode())
    slow.encode_special_tokens = True
    slow.no_truncation()

    def encode(text: str) -> list[int]:
        if len(text) >= 10_000 and BLANKS.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode, tokens


def pieces_of(content: bytes) -> tuple[object, list[bytes]]:
    """A sentence-piece model and the bytes of each id: byte pieces stand for their byte, U+2581 for a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, [piece(i) for i in range(model.get_piece_size())]


def cut_points(ends_a: Iterable[int], ends_b: Iterable[int]) -> tuple[list[int], list[int]]:
    """How many tokens of A, and of B, end at or before each byte offset where tokens of both end, ascending."""
    index_a, index_b = dict(zip(ends_a, itertools.count(1))), dict(zip(ends_b, itertools.count(1)))  # noqa: B905
    common = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


def overlaps(ids_a: list[int], ids_b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]) -> list[tuple[int, int]]:
    """All pairs of tokens of one group whose byte ranges overlap; the group's tokens cover the same bytes."""
    out, i, j = [], 0, 0
    end_a, end_b = len(bytes_a[ids_a[0]]), len(bytes_b[ids_b[0]])
    while True:
        out.append((ids_a[i], ids_b[j]))
        if end_a == end_b:
            i, j = i + 1, j + 1
            if i == len(ids_a):
                return out
            end_a, end_b = end_a + len(bytes_a[ids_a[i]]), end_b + len(bytes_b[ids_b[j]])
        elif end_a < end_b:
            i += 1
            end_a += len(bytes_a[ids_a[i]])
        else:
            j += 1
            end_b += len(bytes_b[ids_b[j]])


def packed(row: Iterable) -> bytes:
    """One row of DOCUMENTS, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, DOCUMENTS, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, DOCUMENTS, strict=True)], schema=DOCUMENTS))
    return sink.getvalue().to_pybytes()


def unpacked(content: pa.Buffer) -> dict[str, pa.Array]:
    """The columns that packed() was given."""
    batch = pa.ipc.open_stream(content).read_next_batch()
    return {c: batch.column(c)[0].values for c in DOCUMENTS.names}


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers wait for later tasks, and keep it otherwise."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Aligner:
    """Both tokenizers of a task, and what it remembers of groups seen."""

    def __init__(self, content_a: bytes, content_b: bytes):
        self.a, self.bytes_a = byte_level(content_a)
        self.b, self.bytes_b = pieces_of(content_b)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Groups of more than one token on a side: by ids, and each one's text form and link codes.
        self.number: dict[tuple, int] = {}
        self.groups: list[tuple[str, list[int]]] = []

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both of every text; none where either does not give the text's own bytes back (A does by its kind)."""
        for text in texts:
            spaced, ids_b = " " + text, self.b.encode(text)
            same = text and b"".join(map(self.bytes_b.__getitem__, ids_b)) == spaced.encode()
            yield (np.array(self.a(spaced), np.int64), np.array(ids_b, np.int64)) if same else (NONE, NONE)

    def group(self, ids_a: list[int], ids_b: list[int]) -> int:
        """The number of a group."""
        key = (*ids_a, -1, *ids_b)
        number = self.number.get(key)
        if number is None:
            shown = f"{','.join(map(str, ids_a))}|{','.join(map(str, ids_b))}"
            number = len(self.groups)
            self.groups.append((shown, [b << SHIFT | a for a, b in overlaps(ids_a, ids_b, self.bytes_a, self.bytes_b)]))
            self.number[key] = number
        return number

    def slice(self, doc_ids: list, texts: list[str]) -> tuple:
        """One row of SLICES without its number. Lists of numbers are made of a document, or of the rare groups, never of all tokens."""
        if len(self.groups) > REMEMBERED:
            self.number.clear()
            self.groups.clear()
        ids: tuple[list, list] = [], []
        cuts: tuple[list, list] = [], []
        sizes, total = [], [0, 0]
        for both in self.encode(texts):
            found = cut_points(*(np.cumsum(length[own]).tolist() for length, own in zip((self.length_a, self.length_b), both, strict=True)))
            for side in (0, 1):
                cuts[side].append(np.fromiter(found[side], np.int64, len(found[side])) + total[side])
                ids[side].append(both[side])
                total[side] += len(both[side])
            sizes.append((len(both[0]), len(both[1]), len(found[0])))
        n_a, n_b, n_groups = (np.array(c, np.int64) for c in zip(*sizes, strict=True))
        flat_a, flat_b, ends_a, ends_b = map(np.concatenate, (*ids, *cuts))
        del ids, cuts
        # A group begins where the one before ended: a text's last group ends with its last token.
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        kind = np.empty(len(ends_a), np.int64)  # one token each: the link's own code; others: their number, below zero
        single = (size_a == 1) & (size_b == 1)
        kind[single] = flat_b[ends_b[single] - 1] << SHIFT | flat_a[ends_a[single] - 1]
        longer_a, longer_b = (flat[np.repeat(~single, size)].tolist() for flat, size in ((flat_a, size_a), (flat_b, size_b)))
        places = (itertools.pairwise([0, *np.cumsum(size[~single]).tolist()]) for size in (size_a, size_b))
        kind[~single] = [-1 - self.group(longer_a[i:p], longer_b[j:q]) for (i, p), (j, q) in zip(*places, strict=True)]
        del flat_a, flat_b, ends_a, ends_b, size_a, size_b, single, longer_a, longer_b
        kinds, place = np.unique(kind, return_inverse=True)
        shown, links = [], []
        for k in kinds.tolist():
            form, own = self.groups[-1 - k] if k < 0 else (f"{k & 0xFFFFFFFF}|{k >> SHIFT}", (k,))
            shown.append(form)
            links.append(own)
        named = lambda lo, hi: ";".join(map(shown.__getitem__, place[lo:hi].tolist())).encode()
        digests = [hashlib.sha256(named(lo, hi)).hexdigest() if lo < hi else "" for lo, hi in itertools.pairwise([0, *np.cumsum(n_groups).tolist()])]
        # How often each document holds each kind, then each pair.
        both, times = np.unique(np.repeat(np.arange(len(texts)), n_groups) * (len(kinds) + 1) + place, return_counts=True)
        of_kind = both % (len(kinds) + 1)
        width = np.array([len(x) for x in links], np.int64)
        pair, number = np.unique(np.fromiter(itertools.chain.from_iterable(links), np.int64, int(width.sum())), return_inverse=True)
        first = np.cumsum(width) - width
        n = width[of_kind] if len(width) else np.empty(0, np.int64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of_kind] if len(first) else n, n)
        held, where = np.unique(np.repeat(both // (len(kinds) + 1), n) * (len(pair) + 1) + number[at], return_inverse=True)
        times = np.bincount(where, np.repeat(times, n), len(held)).astype(np.int64)
        counts = np.bincount(held % (len(pair) + 1), times, len(pair)).astype(np.int64)
        n_links = np.bincount(held // (len(pair) + 1), times, len(texts)).astype(np.int64)
        ends = np.searchsorted(held, (np.arange(len(texts)) + 1) * (len(pair) + 1))
        held = np.diff(held % (len(pair) + 1), prepend=0)
        return pair, counts, packed((doc_ids, n_a, n_b, n_groups, n_links, digests, ends, held, times))


def slices(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each few MB of texts: its documents' figures, distinct pairs with counts, and the pairs each document holds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    context = df.sparkSession.sparkContext
    contents = [context.broadcast(open(p, "rb").read()) for p in (path_a, path_b)]  # noqa: SIM115
    schema = to_arrow_schema(StructType.fromDDL(SLICES), prefers_large_types=False)

    def coded(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            for part in pieces(batch, SLICE):
                row = aligner.slice(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, *row), schema, strict=True)], schema=schema)
                number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            yield from coded(Aligner(*(c.value for c in contents)), batches)
        trim()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SLICES)


def pair_counts(coded: DataFrame) -> DataFrame:
    """pair, count, best of all slices: links over the corpus that hold the id pair, and whether no pair of its B id has more."""
    counts = coded.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("count"))
    counts = counts.withColumn("b", F.shiftright("pair", SHIFT))
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of df (doc_id, text).

    A (a byte-level vocabulary file) encodes a space and the text, B (a sentence-piece model, which adds the space) the text.
    Texts that are null, empty, or not given back byte for byte by both have no tokens: zeros and ''. Rows are aligned one by
    one, so repeated rows and null ids each give a row, and each counts in the corpus. Ties for the highest count all are
    best. Other columns, of any name, are ignored; an empty table stays empty.
    """
    coded = cut(slices(df, path_a, path_b))
    wanted = coded.select("slice", F.explode("pair").alias("pair"))
    found = wanted.join(cut(pair_counts(coded)), "pair").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("found"))
    rows = coded.select("slice", "documents").join(found.select("slice", F.col("found.count").alias("count"), F.col("found.best").alias("best")), "slice", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, sums = unpacked(batch.column("documents")[i].as_buffer()), {}
                held = np.cumsum(row["held"].to_numpy())
                for c, of in (("n_best", "best"), ("count_sum", "count")):
                    each = np.zeros(1 + len(held), np.int64)
                    if len(held):
                        known = batch.column(of)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                        np.cumsum(row["times"].to_numpy() * known[held], out=each[1:])
                    sums[c] = np.diff(each[row["upto"].to_numpy()], prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(sums[c]) if c in sums else row[c].cast(f.type) for c, f in zip(names, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, RESULT)
