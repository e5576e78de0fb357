"""Byte-pair encoding with word ends: encoding and decoding by a pair-occurrence index, and token counts by heap merging.

Both reproduce, for the public vocabulary file, what its library gives with add_special_tokens=False and without
truncation or padding. Special strings inside a text become their special id, as the library does by default.
Null and empty texts have no tokens. Rows are coded one by one: repeated rows and null ids pass, in the order of the input's
partitions; columns but the id and the text, of any name, are ignored; empty tables give no rows.

The index covers a stretch of a partition: texts are held, in Arrow, until they come to STRETCH bytes or NEW_WORDS words that
the task has not coded yet. A partition of the usual size is one such stretch; a longer one is walked in several, so that
memory stays bounded, and since no pair crosses a word the ids are the same.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import TASK_TABLES, map_columns, pieces, task_memory

#: Words whose codes, or counts, a task keeps at most, and characters of the longest.
CACHE_WORDS, CACHE_LONGEST = 60_000, 40
#: Bytes of text, and words not coded yet, that one index covers.
STRETCH, NEW_WORDS = 16 << 20, 30_000


#: Code points outside the blocks whose letters, case and order all versions of Unicode since 5 agree on (a test compares every
#: one inside with the library): Latin, Greek, Cyrillic, punctuation, kana without marks, common ideographs, Hangul, pictographs.
UNUSUAL = re.compile("[^\x00-\u02ff\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3001-\u3020\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 ones stand for themselves, others move above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """Symbols and merge ranks of one vocabulary file (kind: BPE, byte-level, word-end suffix)."""

    def __init__(self, content: bytes):
        self.content = content
        spec = json.loads(content)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + end] for s in symbols], np.int64)
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        made = {*self.inner.tolist(), *self.last.tolist()}
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[p] for p in (pair.split(" ") if isinstance(pair, str) else pair))
            if left not in made or right not in made:
                raise ValueError("a merge uses a symbol that only a later merge makes; rank order would not be safe")
            new = ids[self.tokens[left] + self.tokens[right]]
            made.add(new)
            self.ranks[left << 32 | right] = rank
            self.merged.append(new)
            self.pairs.append((left, right))
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.coded: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.extra: dict[str, tuple[bytes, str]] = {}
        TASK_TABLES.extend((self.coded, self.extra, self.chunks, self.words))

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of a text, and whether each is a special string."""
        if not any(s in text for s in self.special):
            return [(text, False)]
        return [(s, s in self.special) for s in self.cut_special.split(text) if s]

    @functools.cached_property
    def library(self) -> object:
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content.decode())

    def blanks(self, text: str) -> list[str]:
        """The normalised text at its white space: no word crosses it. Lower case goes by single characters, so no final sigma.

        Code points on whose class, case or order versions of Unicode differ are normalised by the vocabulary's library.
        """
        if not text.isascii() and UNUSUAL.search(text):
            return [c for c in self.library.normalizer.normalize_str(text).split(" ") if c]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the vocabulary's pattern
            return [c for c in regex.split(r"\p{White_Space}+", text) if c]
        return text.split()

    def split(self, chunk: str) -> list[str]:
        """The words of a normalised piece without white space."""
        if not chunk.isascii() and UNUSUAL.search(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return [chunk] if chunk.isalpha() else self.word.findall(chunk)

    # -- pair occurrence index ------------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words, and where each word's begin and end. All words lie in one array of symbols; the index holds every pair's positions in it."""
        if not words:
            return np.empty(0, np.int64), [0]
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1)  # a gap after each word
        symbols = np.full(int(ends[-1]), -1, np.int32)
        flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        gap = np.zeros(len(symbols), bool)
        gap[ends - 1] = True
        symbols[~gap] = self.inner[flat[~gap]]
        symbols[ends - 2] = self.last[flat[ends - 2]]
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        rank_of = self.ranks

        def note(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions."""
            if not len(at):
                return
            keys = symbols[at].astype(np.int64) << 32 | symbols[after[at]]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for key, where in zip(keys[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                rank = rank_of.get(key)
                if rank is not None:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank].append(where)

        note(np.flatnonzero((symbols >= 0) & (np.append(symbols[1:], -1) >= 0)))
        while active:
            rank = heapq.heappop(active)
            left, right = self.pairs[rank]
            at = np.sort(np.concatenate(index.pop(rank)))
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # overlapping places: the leftmost wins
                kept, barred = [], -1
                for p in at.tolist():
                    if p != barred:
                        kept.append(p)
                        barred = int(after[p])
                at = np.array(kept, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.merged[rank]
            symbols[gone] = -2
            after[at] = after[gone]
            inside = after[at] < len(symbols)
            before[after[at][inside]] = at[inside]
            right_ok = inside & (symbols[np.minimum(after[at], len(symbols) - 1)] >= 0)
            prior = before[at]
            prior = prior[(prior >= 0) & (symbols[np.maximum(prior, 0)] >= 0)]
            note(np.unique(np.concatenate([at[right_ok], prior])))
        live = symbols >= 0
        return symbols[live], [0, *np.cumsum(live)[ends - 1].tolist()]

    def unknown(self, texts: list[str]) -> set[str]:
        """The pieces between white space that have no codes yet."""
        out: set[str] = set()
        for text in texts:
            for segment, special in self.segments(text):
                if not special:
                    out.update(self.blanks(segment))
        return out - self.coded.keys()

    def learn(self, pieces_: set[str]) -> None:
        """Codes of all these pieces by one index. They stay for the task while its table has room, else until the next call."""
        split = {c: self.split(c) for c in pieces_}
        words = list({w for ws in split.values() for w in ws} - self.coded.keys())
        new = dict(zip(words, self.coded_words(words), strict=True))
        of = {}
        for c, ws in split.items():
            got = [new.get(w) or self.coded[w] for w in ws]
            of[c] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        room = CACHE_WORDS - len(self.coded)  # frequent words come early
        self.coded.update(itertools.islice(((c, got) for c, got in of.items() if len(c) <= CACHE_LONGEST), max(0, room)))
        self.extra.clear()
        self.extra.update((c, got) for c, got in of.items() if c not in self.coded)

    def put_together(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a text whose pieces all have codes."""
        known, extra, got = self.coded, self.extra, []
        for segment, special in self.segments(text):
            if special:
                got.append((self.special[segment].to_bytes(4, "little"), segment))
            else:
                got += [known.get(c) or extra[c] for c in self.blanks(segment)]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        self.learn(self.unknown(texts))
        return [self.put_together(t) for t in texts]

    def coded_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        ids, cuts = self.encode_words(words)
        raw, named = ids.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, ids.tolist()))
        return [(raw[4 * a : 4 * b], " ".join(named[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]

    # -- heap and linked list -------------------------------------------------------------------------------------

    def word_tokens(self, word: str) -> int:
        """Tokens of one word: its symbols, less one for each merge."""
        raw = word.encode()
        symbols = [self._inner[b] for b in raw]
        symbols[-1] = self._last[raw[-1]]
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks, merged = self.ranks, self.merged
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merged[rank], -1
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    @functools.cached_property
    def _inner(self) -> list[int]:
        return self.inner.tolist()

    @functools.cached_property
    def _last(self) -> list[int]:
        return self.last.tolist()

    def chunk_tokens(self, chunk: str) -> int:
        n = 0
        for w in self.split(chunk):
            k = self.words.get(w)
            if k is None:
                k = self.word_tokens(w)
                if len(self.words) < CACHE_WORDS and len(w) <= CACHE_LONGEST:
                    self.words[w] = k
            n += k
        if len(self.chunks) < CACHE_WORDS and len(chunk) <= CACHE_LONGEST:
            self.chunks[chunk] = n
        return n

    def count(self, text: str) -> int:
        known, n = self.chunks.get, 0
        for s, special in self.segments(text):
            if special:
                n += 1
                continue
            for c in self.blanks(s):
                n += k if (k := known(c)) is not None else self.chunk_tokens(c)
        return n


@functools.lru_cache(2)
def _vocabulary(content: bytes, use: str) -> Vocabulary:
    return Vocabulary(content)


def vocabulary_loader(df: DataFrame, path: str, use: str):
    """The driver reads the file (its size does not depend on the data) and every task gets its bytes by broadcast."""
    with open(path, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _vocabulary(content.value, use)


def coded_rows(df: DataFrame, path: str, id_col: str, text_col: str, schema: str, finish: Callable[[list], list]) -> DataFrame:
    """Rows of schema: the id, and what finish makes of the codes of all rows of a slice. Each stretch of a partition has one index."""
    setup = vocabulary_loader(df, path, "encode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            vocabulary = setup()
            held: list[pa.RecordBatch] = []
            fresh: set[str] = set()
            size = 0
            for batch in itertools.chain(batches, [None]):
                for part in pieces(batch) if batch is not None else ():
                    held.append(part)
                    size += part.nbytes
                    fresh |= vocabulary.unknown([t or "" for t in part.column(1).to_pylist()])
                if held and (batch is None or size >= STRETCH or len(fresh) >= NEW_WORDS):
                    vocabulary.learn(fresh)
                    for part in held:
                        columns = finish([vocabulary.put_together(t or "") for t in part.column(1).to_pylist()])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), *[pa.array(c, f.type) for c, f in zip(columns, arrow[1:], strict=True)]],
                            schema=pa.schema(arrow),
                        )
                    held, fresh, size = [], set(), 0

    arrow = list(to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def bpe_encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int), decoded text of every whole text, in the order of the input's partitions."""

    def finish(coded: list) -> list:
        return [[len(b) // 4 for b, _ in coded], [np.frombuffer(b, "<u4").astype(np.int32) for b, _ in coded], [t for _, t in coded]]

    return coded_rows(df, path, id_col, text_col, "doc_id long, n_tokens long, ids array<int>, decoded string", finish)


def bpe_digests(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As bpe_encode, with SHA-256 digests of the ids and of the decoded text in place of both (made where they are)."""

    def finish(coded: list) -> list:
        return [
            [len(b) // 4 for b, _ in coded],
            [hashlib.sha256(b).hexdigest() for b, _ in coded],
            [hashlib.sha256(t.encode()).hexdigest() for _, t in coded],
        ]

    return coded_rows(df, path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def token_counts(df: DataFrame, path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""

    def run(vocabulary: Vocabulary, ids: list, texts: list) -> list:
        return [ids, [len((t or "").encode()) for t in texts], [vocabulary.count(t or "") for t in texts]]

    counted = map_columns(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        run,
        "doc_id long, n_bytes long, n_tokens long",
        vocabulary_loader(df, path, "count"),
    )
    over: Column = F.col("n_tokens") > F.lit(limit)
    return counted.withColumn("over_limit", over)
