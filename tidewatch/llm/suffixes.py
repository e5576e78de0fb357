"""Substring dedup by a distributed difference-cover suffix sort, over UTF-8 bytes.

Only the order of suffixes by their first 50 bytes matters here, so every depth below is exact and nothing is left to recursion.

0. Equal texts are one text, that of the smallest doc_id. Texts lie in chunks of a few MB, one row each.
1. Unique names leave early. Positions of a difference cover modulo 21 are sampled; two equal 50-byte strings have a sampled
   position in common within their first 21 bytes, where 30 bytes are equal. The 30-byte strings are named by hashes, which each
   chunk sends sorted and once; the answer is one bit each: does another chunk have it? A string all of whose sampled positions have
   names of their own occurs once. What is left are segments of text, a fraction of the corpus.
2. Alike segments come together. Segments are dealt to slices by the least hash of the words in them, so that a copied passage is mostly
   sorted where its copies are: the suffixes of a slice are sorted once, and what follows sees each of their strings once a slice.
3. Difference cover modulo 3. Positions 1 and 2 (mod 3) of a segment are sampled. Only 16 triples (48 bytes) of theirs are needed, so
   the recursion ends where it begins: they are sorted at once into global ranks.
4. Merging. With c the bytes of a suffix and g the rank of a sampled one, types 0, 1 and 2 compare by (c0, g+1, c49), (c0, c1, g+2) or
   (g, c48, c49), whichever both types have.
5. Suffixes next to each other in this order whose first 50 bytes are equal form a class; its smallest doc_id keeps the string,
   and every other start of it covers 50 bytes.

Each step is a question and an answer between chunks or slices and ranges of keys: a chunk sends its distinct keys to their range,
packed, and gets one number or bit a key back in the same order. No task sees more than a chunk, a slice or a range, and a passage
that a third of all texts share is one key a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, cut, join_facts, pieces, release

LENGTH = 50
#: A perfect difference cover: every distance modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = LENGTH - PERIOD + 1
#: Bytes of a chunk; keys of a range; bits of a rank within its range (a rank has 48 bits, so there are up to four million ranges).
CHUNK, RANGE, LOCAL = 4 << 20, 6_000_000, 26
#: Bytes that the rank of a sampled suffix covers.
DEEP = 48
#: Segments of a slice with the same least hash that go to one place; over how many partitions of chunks these share their places.
ALIKE, NEARBY = 16, 64

CHUNKS = "chunk long, key array<binary>, doc_id array<long>, size array<int>, data binary"
PIECES = "bucket int, alike long, chunk long, doc int, doc_id long, start long, data binary"
SEGMENTS = "chunk long, slice int, source array<long>, doc array<int>, doc_id array<long>, start array<long>, size array<int>, data binary, name binary, joined binary, sample array<long>"
ASKED = "part int, chunk long, slice int, n array<int>, payload array<binary>"
TOLD = "chunk long, slice int, part int, payload array<binary>"
HITS = "chunk long, doc int, begin long, end long"
RESULT = "key binary, n_removed long, n_spans long, kept_sha256 string"


# -- packing -----------------------------------------------------------------------------------------------------------


def squeeze(rows: np.ndarray) -> bytes:
    """Rows of bytes, column by column, compressed."""
    return pa.compress(np.ascontiguousarray(rows.T).tobytes(), codec="zstd", asbytes=True)


def loosen(data: bytes, n: int, width: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T)


def pack_numbers(a: np.ndarray) -> bytes:
    """Numbers by their steps, which are small where they ascend: only as many bytes of each as the largest needs."""
    if not len(a):
        return b""
    steps = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + squeeze(steps.view(np.uint8).reshape(-1, 8)[:, :width])


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : data[0]] = loosen(data[1:], n, data[0])
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Byte strings of one width, by what differs from the one before."""
    rows = keys.view(np.uint8).reshape(len(keys), -1).copy()
    rows[1:] ^= keys.view(np.uint8).reshape(len(keys), -1)[:-1]
    return squeeze(rows) if len(keys) else b""


def unpack_keys(data: bytes, n: int, width: int) -> np.ndarray:
    return np.bitwise_xor.accumulate(loosen(data, n, width), axis=0).view(f"S{width}").ravel() if n else np.empty(0, f"S{width}")


def pack_texts(keys: np.ndarray) -> bytes:
    """Strings of text as they are: neighbours overlap, which the compression finds."""
    return pa.Codec("zstd", 3).compress(keys.tobytes(), asbytes=True)


def unpack_texts(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), f"S{width}")


def words(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, in the order of the bytes. b has eight spare bytes at its end."""
    return np.ndarray((len(b) - 7,), ">u8", b, 0, (1,))[at].astype(np.uint64)


def strings(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.ndarray((len(b) - width + 1,), f"S{width}", b, 0, (1,))[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


# -- questions and answers ---------------------------------------------------------------------------------------------


def ask(state: DataFrame, question: Callable, answer: Callable, parts: int, by: list[str]) -> DataFrame:
    """One round: question(row) gives (slice, part, ns, payloads), answer(part, list of (ns, payloads)) a list of payloads for each.

    Returns the columns by (chunk, or chunk and slice) and told: their answers as an array of (slice, part, payload).
    """
    asked, told = arrow_schema(ASKED), arrow_schema(TOLD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_in(batches):
            for at, part, ns, payloads in question(row):
                yield batch_of([(part, row["chunk"], at, ns, payloads)], asked)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for row in rows_in(batches)]
        if held:
            for row, payloads in zip(held, answer(held[0]["part"], [(r["n"], r["payload"]) for r in held]), strict=True):
                yield batch_of([(row["chunk"], row["slice"], row["part"], payloads)], told)

    answers = state.mapInArrow(send, ASKED).repartitionById(parts, F.col("part")).mapInArrow(reply, TOLD)
    return answers.groupBy(*by).agg(F.collect_list(F.struct("slice", "part", "payload")).alias("told"))


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; arrays of numbers stay numpy."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: plain(batch.column(c)[i]) for c in batch.schema.names}


def plain(value: pa.Scalar):
    if isinstance(value, pa.ListScalar) and pa.types.is_integer(value.type.value_type):
        return value.values.to_numpy(zero_copy_only=False) if value.is_valid else None
    return value.as_py()


def told_of(row: dict, at: int, i: int, n_parts: list[tuple[int, int]], unpack: Callable) -> np.ndarray:
    """Answer i to one slice, over the parts that it asked, in order."""
    by_part = {t["part"]: t["payload"][i] for t in row["told"] if t["slice"] == at}
    return np.concatenate([unpack(by_part[part], n) for part, n in n_parts if n]) if any(n for _, n in n_parts) else unpack(b"", 0)


def changes(a: np.ndarray) -> np.ndarray:
    """Where an array has another value than before; its first place too."""
    return np.r_[np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]


def runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the stretches of equal values of an ascending array."""
    if not len(part):
        return []
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


# -- chunks, and names that occur once ---------------------------------------------------------------------------------


def chunks(texts: DataFrame) -> DataFrame:
    """CHUNKS of (key, doc_id, data); a text is never divided between chunks."""
    schema = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in pieces(batch, CHUNK):
                for key, doc_id, data in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "data")), strict=True):
                    held.append((key, doc_id, data))
                    size += len(data)
                    if size >= CHUNK:
                        yield batch_of([packed(number, held)], schema)
                        number, held, size = number + 1, [], 0
        if held:
            yield batch_of([packed(number, held)], schema)

    def packed(number: int, held: list) -> tuple:
        return number, [h[0] for h in held], [h[1] for h in held], [len(h[2]) for h in held], b"".join(h[2] for h in held)

    return texts.mapInArrow(run, CHUNKS)


class Slice:
    """Pieces of texts, at most about a chunk together: a longer text is looked at piece by piece, each with the begin of the next."""

    def __init__(self, row: dict, own: list[tuple[int, int, int]]):
        data = np.frombuffer(row["data"], np.uint8)
        base = np.cumsum(row["size"].astype(np.int64)) - row["size"]
        self.doc, self.start, self.size = (np.array(c, np.int64) for c in zip(*own, strict=True))
        self.bytes = np.concatenate([*(data[base[i] + s : base[i] + s + n] for i, s, n in own), np.zeros(64, np.uint8)])
        self.begin = np.cumsum(self.size) - self.size

    def names(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions in ascending order, the pieces they lie in, and the hashes of the 30 bytes there."""
        periods = -(-self.size // PERIOD)
        piece = np.repeat(np.arange(len(periods)), periods)
        first = self.begin[piece] + PERIOD * (np.arange(len(piece)) - (np.cumsum(periods) - periods)[piece])
        at, piece = (first[:, None] + np.array(COVER)).ravel(), np.repeat(piece, len(COVER))
        whole = at + ANCHOR <= (self.begin + self.size)[piece]
        at, piece = at[whole], piece[whole]
        found = strings(self.bytes, at, 32).view("<u8").reshape(-1, 4)
        h = _mixed(found[:, 0])
        for word in (found[:, 1], found[:, 2], found[:, 3] & np.uint64((1 << 8 * (ANCHOR - 24)) - 1)):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)
        return at, piece, h >> np.uint64(64 - bits)


def slices(row: dict) -> Iterator[tuple[int, Slice]]:
    own, total, number = [], 0, 0
    for i, n in enumerate(row["size"].tolist()):
        for s in range(0, max(1, n - LENGTH + 1), CHUNK):
            if own and total >= CHUNK:
                yield number, Slice(row, own)
                own, total, number = [], 0, number + 1
            own.append((i, s, min(n - s, CHUNK + LENGTH - 1)))
            total += own[-1][2]
    if own:
        yield number, Slice(row, own)


def ask_names(bits: int, parts: int) -> Callable:
    def question(row: dict):
        for number, s in slices(row):
            h = np.sort(s.names(bits)[2])
            h = h[changes(h)]
            for part, a, b in runs(part_of(h, bits, parts)):
                yield number, part, [b - a], [pack_numbers(h[a:b])]

    return question


def part_of(h: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((h >> np.uint64(bits - 31)) * np.uint64(parts)) >> np.uint64(31)


def tell_repeats(part: int, asked: list) -> list[list[bytes]]:
    """A bit for each name: whether another slice has it too."""
    ns = [n[0] for n, _ in asked]
    h = np.concatenate([unpack_numbers(p[0], n) for n, (_, p) in zip(ns, asked, strict=True)])
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order]) == 0
    repeated = np.zeros(len(h), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    return [[np.packbits(x).tobytes()] for x in np.split(repeated, np.cumsum(ns)[:-1])]


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def segments(bits: int, parts: int, buckets: int) -> Callable:
    """What is left of a chunk as PIECES: runs of starts whose strings may occur elsewhere, with the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_in(batches):
            for number, s in slices(row):
                at, piece, h = s.names(bits)
                if not len(at):
                    continue
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(changes(h))
                told = told_of(row, number, 0, [(p, b - a) for p, a, b in runs(part_of(h[first], bits, parts))], bits_of)
                doc = s.doc[piece[order]]
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                shared = np.empty(len(at), bool)
                shared[order] = np.repeat(told | several, np.diff(first, append=len(h)))
                at, piece = at[shared], piece[shared]
                low, high = np.maximum(at - (PERIOD - 1), s.begin[piece]), np.minimum(at, (s.begin + s.size)[piece] - LENGTH) + 1
                low, high, piece = low[low < high], high[low < high], piece[low < high]
                if not len(low):
                    continue
                new = np.r_[True, (low[1:] > high[:-1]) | (piece[1:] != piece[:-1])]
                begin, end, piece = low[new], high[np.r_[new[1:], True]] + LENGTH - 1, piece[new]
                data = b"".join([s.bytes[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                offset = np.r_[0, np.cumsum(end - begin)]
                alike = sketches(data, offset)
                doc = s.doc[piece]
                columns = [
                    bucket_of(alike, row["chunk"] >> 32, buckets), alike.view(np.int64), np.full(len(doc), row["chunk"]), doc.astype(np.int32),
                    row["doc_id"][doc], s.start[piece] + begin - s.begin[piece],
                ]
                binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])
                whole = pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)), binary], schema=schema)
                yield from pieces(whole)

    schema = arrow_schema(PIECES)
    return run


def sketches(data: bytes, offset: np.ndarray) -> np.ndarray:
    """The least hash of the words in each segment, but for those of its first and last bytes, which alike segments need not share."""
    edge = PERIOD - 1
    h = _mixed(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15))
    return np.minimum.reduceat(h, np.stack([offset[:-1] + edge, offset[1:] - edge - 8], 1).ravel())[::2]


def bucket_of(alike: np.ndarray, partition: int, buckets: int) -> np.ndarray:
    """Where segments go: by their sketch, and where a slice has more than ALIKE of one, by their number too. So no sketch fills a bucket."""
    order = np.argsort(alike, kind="stable")
    first = np.flatnonzero(changes(alike[order]))
    number = np.empty(len(alike), np.uint64)
    number[order] = (np.arange(len(alike)) - np.repeat(first, np.diff(first, append=len(alike)))) // ALIKE
    return (_mixed(alike + _mixed(number + np.uint64(partition // NEARBY << 32))) % np.uint64(buckets)).astype(np.int32)


def sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENTS of a bucket's PIECES, with the names of their suffixes: places in their order by 50 bytes."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("slice", pa.int32()), ("source", pa.list_(pa.int64())), ("doc", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())),
        ("size", pa.list_(pa.int32())), ("data", pa.binary()), ("name", pa.binary()), ("joined", pa.binary()), ("sample", pa.list_(pa.int64())),
    ])
    number, held, total = 0, [], 0
    for batch in batches:
        for part in pieces(batch, CHUNK):
            held.append(part)
            total += part.nbytes
            if total >= CHUNK:
                yield batch_of([one_slice(number, held)], schema)
                number, held, total = number + 1, [], 0
    if held:
        yield batch_of([one_slice(number, held)], schema)


def one_slice(number: int, held: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(held).sort_by("alike")
    size = pc.binary_length(t["data"]).to_numpy()
    data = b"".join(t["data"].to_pylist())
    b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(64, np.uint8)])
    long = np.flatnonzero(lefts(size) >= DEEP)
    name, joined = suffix_names(b, long)
    place = np.empty(len(joined), np.int64)
    place[name] = long
    sample = words(b, place[::512]) ^ np.uint64(1 << 63)
    columns = [t[c].to_numpy() for c in ("chunk", "doc", "doc_id", "start")]
    return t["bucket"][0].as_py(), number, *columns, size, data, squeeze(name.astype(np.int32).view(np.uint8).reshape(-1, 4)), np.packbits(joined).tobytes(), sample.view(np.int64)


def lefts(size: np.ndarray) -> np.ndarray:
    """For each byte of the segments how many its segment has from there on."""
    end = np.cumsum(size.astype(np.int64))
    return np.repeat(end, size) - np.arange(end[-1] if len(end) else 0)


def spans(marked: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the runs of marked places; a run ends where new begins."""
    if not len(marked):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = marked & (np.r_[True, ~marked[:-1]] | new)
    ends = marked & np.r_[~marked[1:] | new[1:], True]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


# -- difference cover --------------------------------------------------------------------------------------------------


def suffix_names(b: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the chosen positions, ascending from 0 with the 50 bytes at each, equal for equal ones; and for each name whether its first
    48 bytes are those of the name before.

    By doubling: places in the order of 8 bytes, of 16 by pairs of these, of 32; 50 bytes are two strings of 32 that overlap.
    """
    n = len(b) - 64
    key = words(b, np.arange(n))
    order = np.argsort(key)
    new = changes(key[order])
    rank = np.zeros(n + 64, np.int64)  # behind the end lie zero bytes: their rank is 0, that of no string within
    for step in (8, 16, 0):
        rank[order] = np.cumsum(new)
        if not step:
            break
        same = ~new
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        own = order[tied]
        key = rank[own] << 32 | rank[own + step]
        within = np.argsort(key)
        order[tied] = own[within]
        new[tied] |= changes(key[within])
    key = rank[chosen] << 32 | rank[chosen + LENGTH - 32]
    order = np.argsort(key)
    new = changes(key[order])
    name = np.empty(len(chosen), np.int64)
    name[order] = np.cumsum(new) - 1
    first = chosen[order[new]]
    deep = rank[first] << 32 | rank[first + DEEP - 32]
    return name, ~changes(deep)


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order of byte strings of one width, by eight bytes; then, where these tie, by the group that ties and the next five, and so on."""
    rows = keys.view(np.uint8).reshape(len(keys), -1)
    column = lambda own, at, n: np.pad(rows[own, at : at + n], ((0, 0), (8 - n, 0))).view(">u8").ravel().astype(np.uint64)
    key = column(slice(None), 0, 8)
    order = np.argsort(key)
    key, place, depth = key[order], np.arange(len(keys)), 8
    group = order
    while depth < rows.shape[1]:
        same = key[1:] == key[:-1]
        tied = np.r_[same, False] | np.r_[False, same]
        if not tied.any():
            break
        number = np.cumsum(np.r_[True, ~same])[tied].astype(np.uint64)
        place, group = place[tied], group[tied]
        fresh = min(5, rows.shape[1] - depth)
        key = number << np.uint64(40) | column(group, depth, fresh)
        within = np.argsort(key)
        key, group = key[within], group[within]
        order[place] = group
        depth += fresh
    return order


class Segments:
    """The segments of a slice, and the names of their suffixes, from which the distinct strings of both depths follow."""

    def __init__(self, row: dict, cuts: np.ndarray):
        self.row, self.cuts = row, cuts
        self.bytes = np.concatenate([np.frombuffer(row["data"], np.uint8), np.zeros(64, np.uint8)])
        size = row["size"].astype(np.int64)
        self.segment = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(self.segment)) - (np.cumsum(size) - size)[self.segment]
        self.left = lefts(size)
        long = self.left >= DEEP
        self.name = np.full(len(self.segment), -1)
        self.name[long] = loosen(row["name"], int(long.sum()), 4).view(np.int32).ravel()
        self.deep = np.cumsum(~bits_of(row["joined"], int(self.name.max()) + 1)) - 1  # the name of the first 48 bytes, by name

    def distinct(self, chosen: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the distinct strings of this depth among the chosen ones, ascending by string, and the index of theirs for each chosen one."""
        at = np.flatnonzero(chosen)
        name = self.name[at] if depth == LENGTH else self.deep[self.name[at]]
        place = np.full(len(self.deep), -1)
        place[name] = at
        return place[place >= 0], (np.cumsum(place >= 0) - 1)[name]

    def parts(self, at: np.ndarray) -> list[tuple[int, int, int]]:
        return runs(np.searchsorted(self.cuts, words(self.bytes, at), side="right"))

    def sampled(self) -> np.ndarray:
        return (self.at % 3 > 0) & (self.left >= DEEP)

    def of_type(self) -> list[np.ndarray]:
        return [(self.at % 3 == t) & (self.left >= LENGTH) for t in range(3)]

    def answers(self, told: list, i: int, at: np.ndarray, unpack: Callable) -> np.ndarray:
        return told_of({"told": told}, self.row["slice"], i, [(p, b - a) for p, a, b in self.parts(at)], unpack)

    def ranks(self, told: list) -> np.ndarray:
        """The answered ranks at all positions; -1 where there is none."""
        out, chosen = np.full(len(self.segment) + 8, -1), self.sampled()
        at, index = self.distinct(chosen, DEEP)
        out[:-8][chosen] = self.answers(told, 0, at, unpack_numbers).astype(np.int64)[index]
        return out

    def keys(self, kind: str, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Numbers by which two types of suffixes compare."""
        b = self.bytes
        byte = lambda k: b[at + k].astype(np.uint64)
        number = lambda p: rank[p].astype(np.uint64)
        of = lambda x, n: x << np.uint64(n)
        if kind == "A":
            return of(byte(0), 56) | of(number(at + 1), 8) | byte(49)
        if kind == "B":
            return of(byte(0), 56) | of(byte(1), 48) | number(at + 2)
        return of(number(at), 16) | of(byte(48), 8) | byte(49)


#: Which keys each type has, in the order in which it sends them: the first is also its own order.
KINDS = (("A", "B"), ("A", "C"), ("B", "C"))


def ask_deep(cuts: np.ndarray) -> Callable:
    def question(row: dict):
        s = Segments(row, cuts)
        at, _ = s.distinct(s.sampled(), DEEP)
        for part, a, b in s.parts(at):
            yield row["slice"], part, [b - a], [pack_texts(strings(s.bytes, at[a:b], DEEP))]

    return question


def tell_deep(part: int, asked: list) -> list[list[bytes]]:
    """Ranks of the keys over all ranges: the range, and the place within it."""
    ns = [n[0] for n, _ in asked]
    keys = np.concatenate([unpack_texts(p[0], n, DEEP) for n, (_, p) in zip(ns, asked, strict=True)])
    order = order_of(keys)
    place = np.cumsum(changes(keys[order])) - 1
    rank = np.empty(len(keys), np.int64)
    rank[order] = within(place) + (part << LOCAL)
    return [[pack_numbers(x)] for x in np.split(rank, np.cumsum(ns)[:-1])]


def within(rank: np.ndarray) -> np.ndarray:
    if len(rank) and rank.max() >= 1 << LOCAL:
        raise ValueError(f"a range holds more than {1 << LOCAL} keys; lower RANGE")
    return rank


def ask_merge(cuts: np.ndarray) -> Callable:
    def question(row: dict):
        s = Segments(row, cuts)
        rank = s.ranks(row["told"])
        by_part: dict[int, tuple[list, list]] = {}
        for t, chosen in enumerate(s.of_type()):
            at, index = s.distinct(chosen, LENGTH)
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, index, row["doc_id"][s.segment[chosen]])
            keys = [s.keys(kind, at, rank) for kind in KINDS[t]]
            for part, a, b in s.parts(at):
                ns, payloads = by_part.setdefault(part, ([0, 0, 0], [b""] * 9))
                ns[t] = b - a
                payloads[3 * t : 3 * t + 3] = [pack_numbers(x[a:b]) for x in (*keys, least)]
        for part, (ns, payloads) in sorted(by_part.items()):
            yield row["slice"], part, ns, payloads

    return question


def merge(keys: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    """For each suffix of the three types, how many of all are smaller: equal suffixes get equal numbers, of whatever type."""
    held = [{kind: np.sort(k) for kind, k in own.items()} for own in keys]
    out = []
    for t, own in enumerate(keys):
        n = np.zeros(len(next(iter(own.values()))), np.int64)
        for u, theirs in enumerate(held):
            kind = next(k for k in KINDS[t] if k in theirs)
            n += np.searchsorted(theirs[kind], own[kind])
        out.append(n)
    return out


def tell_merge(part: int, asked: list) -> list[list[bytes]]:
    """A bit for each suffix: whether a smaller doc_id has its string."""
    ns = [[n[t] for n, _ in asked] for t in range(3)]
    column = lambda i: np.concatenate([unpack_numbers(p[i], n[i // 3]) for n, p in asked])
    rank = merge([{kind: column(3 * t + k) for k, kind in enumerate(KINDS[t])} for t in range(3)])
    doc = np.concatenate([column(3 * t + 2).astype(np.int64) for t in range(3)])
    rank = np.concatenate(rank)
    order = np.argsort(rank)
    first = np.flatnonzero(changes(rank[order]))
    smaller = np.empty(len(doc), bool)
    smaller[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(first, append=len(doc))) < doc[order]
    told = np.split(smaller, np.cumsum([sum(n) for n in ns])[:-1])
    split = [np.split(x, np.cumsum(n)[:-1]) for x, n in zip(told, ns, strict=True)]
    return [[np.packbits(x[i]).tobytes() for x in split] for i in range(len(asked))]


def covered(cuts: np.ndarray) -> Callable:
    """HITS of each slice: the stretches of starts whose string a text of a smaller doc_id has, as the bytes they cover."""
    schema = arrow_schema(HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_in(batches):
            s = Segments(row, cuts)
            hit = np.zeros(len(s.segment), bool)
            for t, chosen in enumerate(s.of_type()):
                at, index = s.distinct(chosen, LENGTH)
                doc_id = row["doc_id"][s.segment[chosen]]
                least = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(least, index, doc_id)
                hit[chosen] = s.answers(row["told"], t, at, bits_of)[index] | (doc_id > least[index])
            begin, end = spans(hit, s.at == 0)
            if len(begin):
                segment = s.segment[begin]
                first = row["start"][segment] + s.at[begin]
                columns = row["source"][segment], row["doc"][segment], first, first + (end - begin) + LENGTH - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of every text of a chunk, from the stretches of all its slices."""
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for row in rows_in(batches):
        gone: dict[int, list[tuple[int, int]]] = {}
        for t in row["told"] or ():
            gone.setdefault(t["doc"], []).append((t["begin"], t["end"]))
        base, out = 0, []
        for i, (key, n) in enumerate(zip(row["key"], row["size"].tolist(), strict=True)):
            kept, at, removed, n_spans = hashlib.sha256(), 0, 0, 0
            view = memoryview(row["data"])[base : base + n]
            for a, b in sorted(gone.get(i, ())):
                if a > at or not n_spans:
                    n_spans += 1
                    kept.update(view[at:a])
                    removed += b - a
                else:
                    removed += max(0, b - at)
                at = max(at, b)
            kept.update(view[at:])
            out.append((key, removed, n_spans, kept.hexdigest()))
            base += n
        yield batch_of(out, schema)


def range_cuts(left: DataFrame, parts: int) -> np.ndarray:
    """Quantiles of the first eight bytes of the suffixes, of one in 512 distinct ones of each slice in order; they only balance the ranges."""
    if parts == 1:
        return np.empty(0, np.uint64)
    found = left.select(F.explode("sample").alias("w")).select(F.percentile_approx("w", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).head()[0]
    return np.unique(np.array(found or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def hits(left: DataFrame) -> DataFrame:
    """HITS of all segments: ranks of the sampled suffixes, then all suffixes merged by these."""
    by = ["chunk", "slice"]
    parts = min(1 << (48 - LOCAL), max(1, math.ceil((left.agg(F.sum(F.octet_length("data"))).head()[0] or 0) / RANGE)))
    cuts = range_cuts(left, parts)
    with_answers = lambda told: left.join(told.hint("shuffle_hash"), by)
    ranks = cut(ask(left, ask_deep(cuts), tell_deep, parts, by))
    smaller = cut(ask(with_answers(ranks), ask_merge(cuts), tell_merge, parts, by))
    release(ranks)
    found = cut(with_answers(smaller).mapInArrow(covered(cuts), HITS))
    release(smaller)
    return found


def dedup_bytes(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of df (doc_id, text).

    Each byte goes that a 50-byte string covers which also starts in a row of a smaller doc_id; matches do not cross rows.
    Null texts are empty; texts under 50 bytes keep all. Rows without a doc_id have no place in the order: they lose nothing and
    take nothing from others. Rows that share doc_id and text share their result; rows that share a doc_id but not the text do not
    take from each other. Other columns, of any name, are ignored; an empty table stays empty.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("key", F.unhex(F.sha2("data", 256)))
    known = cut(rows.select("doc_id", "key", F.octet_length("data").cast("long").alias("n_bytes")))
    first = cut(known.where(f"doc_id IS NOT NULL AND n_bytes >= {LENGTH}").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    texts = join_facts(rows.where("doc_id IS NOT NULL"), first, ["key"], F.col("doc_id")).where("doc_id = first")
    held = cut(chunks(texts.select("key", "doc_id", "data")))
    total = held.agg(F.sum(F.octet_length("data"))).head()[0] or 0

    n_names = total * len(COVER) / PERIOD
    bits, parts = max(40, 8 + math.ceil(math.log2(n_names + 2))), max(1, math.ceil(n_names / RANGE))
    repeats = cut(ask(held, ask_names(bits, parts), tell_repeats, parts, ["chunk"]))
    buckets = max(1, math.ceil(total / (2 * CHUNK)))
    dealt = held.join(repeats.hint("shuffle_hash"), "chunk").mapInArrow(segments(bits, parts, buckets), PIECES).repartitionById(buckets, F.col("bucket"))
    left = cut(dealt.mapInArrow(sorted_slices, SEGMENTS))
    release(repeats)
    found = hits(left)
    told = found.groupBy("chunk").agg(F.collect_list(F.struct("doc", "begin", "end")).alias("told"))
    done = cut(held.join(told.hint("shuffle_hash"), "chunk", "left").mapInArrow(remainders, RESULT).dropDuplicates(["key"]))
    release(held, left, found)

    indexed = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)
    both = join_facts(known.where(indexed), first.join(done, "key"), ["key"], F.col("doc_id"))
    own = F.col("doc_id") == F.col("first")
    copies = both.select(
        "doc_id",
        "n_bytes",
        F.when(own, F.col("n_removed")).otherwise(F.col("n_bytes")).alias("n_removed"),
        F.when(own, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(own, F.col("kept_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )
    whole = known.where(~indexed).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("key")).alias("kept_sha256"))
    return copies.unionByName(whole)
