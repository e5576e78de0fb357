"""Substring dedup: runs of 50 words that a document with a smaller id has too, found by super-k-mers.

The minimiser of a window is the smallest hash among its runs of 10 words. Consecutive windows that share a minimiser form a
super-k-mer: one string of words that stands for all of them. Equal windows have equal minimisers, so

1. every document sends its distinct minimisers; those that one document alone has are done with,
2. the super-k-mers of the others travel as packed strings to their minimiser's bucket. Of a string that several documents
   have, only its smallest document counts there, and each task sends its words once; in every other document all windows of
   such a string have an earlier copy,
3. in the bucket the strings are unpacked and their windows sorted; where a window's smallest document is another one, its
   words go.

A minimiser that more than HOT_DOCS documents have does not go to one bucket: its windows are unpacked before the shuffle and
spread by their hash. Joins on texts, minimisers and strings are salted (join_facts), so that a passage which a third of all
documents share spreads over tasks. Equal whole texts collapse before all this. The plan is the same at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_facts, map_columns, partitions
from .shingles import run_hashes, word_hashes

WINDOW, MINIMISER = 50, 10
#: Documents with one minimiser up to which its windows are sorted in one bucket.
HOT_DOCS = 1_000
#: Windows of a bucket that are sorted at once, and strings whose words a task remembers to have sent.
SORT_WINDOWS, SENT_STRINGS = 1 << 20, 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def minimisers(words: list[bytes]) -> np.ndarray:
    """The minimiser of each window of the words."""
    h = run_hashes(word_hashes(words), MINIMISER)
    left, width = WINDOW - MINIMISER + 1, 1
    while width * 2 <= left:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    return (np.minimum(h[: len(h) - (left - width)], h[left - width :]) >> np.uint64(1)).astype(np.int64)


def super_kmers(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(minimiser, first window, number of windows) of each stretch of windows that share a minimiser."""
    m = minimisers(words)
    starts = np.r_[0, np.flatnonzero(np.diff(m)) + 1]
    return list(zip(m[starts].tolist(), starts.tolist(), np.diff(np.r_[starts, len(m)]).tolist(), strict=True))


def key_of(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def outlines(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_words, kept_sha256 (nothing removed), minis (distinct minimisers)."""

    def run(ids: list, texts: list) -> list:
        out = []
        for doc_id, text in zip(ids, texts, strict=True):
            words = words_of(text)
            out.append((doc_id, key_of(text), len(words), sha(words), np.unique(minimisers(words)) if len(words) >= WINDOW else []))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(5)]

    return map_columns(docs, run, "doc_id long, key binary, n_words long, kept_sha256 string, minis array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """mini, hot, key, string, doc_id, start, n of the super-k-mers in the document's lists (columns doc_id, text, key, minis, hot_minis).

    string is null where the same task has sent it before.
    """

    def run(sent: set, ids: list, texts: list, keys: list, lists: list, hot_lists: list) -> list:
        out = []
        for doc_id, text, key, minis, hot_minis in zip(ids, texts, keys, lists, hot_lists, strict=True):
            if key_of(text) != key:
                continue
            words, shared, hot = words_of(text), set(minis), set(hot_minis)
            for m, s, n in super_kmers(words):
                if m in shared or m in hot:
                    string = b" ".join(words[s : s + n + WINDOW - 1])
                    name = hashlib.blake2b(string, digest_size=16).digest()
                    out.append((m, m in hot, name, None if name in sent else string, doc_id, s, n))
                    if len(sent) >= SENT_STRINGS:
                        sent.clear()
                    sent.add(name)
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(7)]

    return map_columns(
        docs.select("doc_id", "text", "key", "minis", "hot_minis"),
        run,
        "mini long, hot boolean, key binary, string binary, doc_id long, start int, n int",
        set,
    )


def windows_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of packed strings: its 64-bit hash, its string's place and its own place in that string."""
    words = [s.split(b" ") for s in strings]
    size = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(place + WINDOW <= size[row])  # windows that lie within one string
    return run_hashes(h, WINDOW)[at].view(np.int64), row[at], place[at]


def unpacked(strings: DataFrame) -> DataFrame:
    """mini, w, doc_id, at of every window of packed strings (columns mini, string, doc_id, start); mini and w are 127 bits of hash."""

    def run(minis: list, held: list, ids: list, starts: list) -> list:
        w, row, place = windows_of(held)
        return [np.array(minis, np.int64)[row], w, np.array(ids, np.int64)[row], np.array(starts, np.int64)[row] + place]

    return map_columns(strings.select("mini", "string", "doc_id", "start"), run, "mini long, w long, doc_id long, at int")


def sorted_bucket(mini: np.ndarray, strings: list[bytes], doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, s, e of the stretches of windows of packed strings whose words also start in a smaller document: words s to e of strings[row]."""
    w, row, at = windows_of(strings)
    if not len(w):
        return row, at, at
    order = np.lexsort((doc_id[row], w, mini[row]))
    w, row, at = w[order], row[order], at[order]
    doc = doc_id[row]
    opens = np.r_[True, (mini[row[1:]] != mini[row[:-1]]) | (w[1:] != w[:-1])]
    late = doc > doc[opens][np.cumsum(opens) - 1]
    row, at = row[late], at[late]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(row)] - 1 if len(row) else cuts
    return row[cuts], at[cuts], at[ends] + WINDOW


def bucket_spans(strings: DataFrame, leads: DataFrame) -> DataFrame:
    """doc_id, s, e of repeats within the minimisers' buckets.

    strings: mini, key, string, of which one row at least of each (mini, key) has words; leads: mini, key, doc_id, start of
    each place where a string's smallest document has it. Both travel to their minimiser's bucket and are sorted there; whole
    minimisers are gathered until there are enough windows to unpack and sort.
    """
    n = partitions(strings.sparkSession)
    none = F.lit(None)
    rows = leads.select("mini", "key", F.lit(True).alias("lead"), "doc_id", "start", none.cast("binary").alias("string"))
    rows = rows.unionByName(
        strings.where("string IS NOT NULL").select(
            "mini",
            "key",
            F.lit(False).alias("lead"),
            none.cast("long").alias("doc_id"),
            none.cast("int").alias("start"),
            "string",
        ),
    )

    def run(batches):
        minis: list[int] = []
        texts: list[bytes] = []
        docs: list[int] = []
        places: list[list[int]] = []
        waiting, name, doc, starts, windows = None, None, 0, [], 0

        def found():
            row, s, e = sorted_bucket(np.array(minis, np.int64), texts, np.array(docs, np.int64))
            own = [np.array(places[r], np.int64) for r in row.tolist()]
            n = np.array([len(x) for x in own], np.int64)
            at = np.concatenate([np.empty(0, np.int64), *own])
            columns = np.repeat(np.array(docs, np.int64)[row], n), at + np.repeat(s, n), at + np.repeat(e, n)
            for held in (minis, texts, docs, places):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["doc_id", "s", "e"],
            )

        for batch in batches:  # few words, so their hashes are not kept
            for mini, key, lead, doc_id, start, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mini != waiting and windows >= SORT_WINDOWS:
                    yield found()
                    windows = 0
                waiting = mini
                if lead:
                    if (mini, key) != name:
                        name, doc, starts = (mini, key), doc_id, []
                    starts.append(start)
                elif starts and (mini, key) == name:  # the first words of this string; further ones are the same
                    minis.append(mini)
                    texts.append(string)
                    docs.append(doc)
                    places.append(starts)
                    windows += string.count(b" ") + 2 - WINDOW
                    starts = []
        if texts:
            yield found()

    placed = rows.repartition(n, "mini").sortWithinPartitions("mini", "key", F.desc("lead"))
    return placed.select("mini", "key", "lead", "doc_id", "start", "string").mapInArrow(run, "doc_id long, s int, e int")


def spread_spans(strings: DataFrame, leads: DataFrame) -> DataFrame:
    """As bucket_spans, for minimisers of very many documents: each window goes where its hash sends it."""
    words = strings.where("string IS NOT NULL").groupBy("mini", "key").agg(F.first("string").alias("string"))
    windows = unpacked(leads.join(words, ["mini", "key"]))
    early = windows.groupBy("mini", "w").agg(
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        F.count("*").alias("n"),
    ).where("lo < hi").select("mini", "w", "lo", "n")
    later = join_facts(windows, cut(early), ["mini", "w"], F.col("doc_id")).where("doc_id > lo")
    return later.select("doc_id", F.col("at").alias("s"), (F.col("at") + WINDOW).alias("e"))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, kept_sha256 of the documents (doc_id, text, key) that have spans (doc_id, spans: start and end words)."""

    def run(ids: list, texts: list, keys: list, lists: list) -> list:
        out = []
        for doc_id, text, key, found in zip(ids, texts, keys, lists, strict=True):
            if key_of(text) != key:
                continue
            words = words_of(text)
            edge = np.zeros(len(words) + 1, np.int64)
            for s in found:
                edge[s["s"]] += 1
                edge[s["e"]] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            out.append((doc_id, key, int(gone.sum()), sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(4)]

    return map_columns(
        docs.join(spans, "doc_id").select("doc_id", "text", "key", "spans"),
        run,
        "doc_id long, key binary, n_removed long, kept_sha256 string",
    )


def shared_minimisers(reps: DataFrame) -> DataFrame:
    """doc_id, key, minis, hot_minis: the minimisers of each document that another document has too."""
    minis = reps.select("doc_id", "key", F.explode("minis").alias("mini"))
    counted = minis.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    facts = cut(counted.select("mini", (F.col("n") > HOT_DOCS).alias("hot"), "n"))
    found = join_facts(minis, facts, ["mini"], F.col("doc_id"))
    of = lambda wanted: F.collect_list(F.when(F.col("hot") == wanted, F.col("mini")))
    return found.groupBy("doc_id", "key").agg(of(False).alias("minis"), of(True).alias("hot_minis"))


def dedup_substrings(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words covered by a window of 50 whose words also start in a document with a smaller id go.

    Words are maximal runs without ASCII white space, unchanged; kept words are joined by one space. Null and empty texts have
    no words, and texts of fewer than 50 lose none. Windows are judged on the input. Rows without a doc_id are neither compared
    nor changed; rows that share a doc_id do not repeat each other. Other columns, of any name, are ignored. An empty table
    gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = cut(outlines(docs))
    whole = F.col("n_words") >= WINDOW
    usable = whole & F.col("doc_id").isNotNull()
    first = cut(lines.where(usable).groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    marked = join_facts(lines.where(usable), first, ["key"], F.col("doc_id"))
    reps = cut(marked.where("doc_id = first").select("doc_id", "key", "minis").dropDuplicates(["doc_id", "key"]))
    chosen = cut(docs.join(shared_minimisers(reps), "doc_id"))
    strings = cut(packed(chosen))
    known = cut(strings.groupBy("mini", "key").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")))
    places = cut(
        join_facts(strings.select("mini", "hot", "key", "doc_id", "start", F.col("n").alias("windows")), known, ["mini", "key"], F.col("doc_id")),
    )
    spans = places.where("doc_id > lo").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("e"))
    leads = places.where("doc_id = lo")
    spans = spans.union(bucket_spans(strings.where("NOT hot"), leads.where("NOT hot"))).union(spread_spans(strings.where("hot"), leads.where("hot")))
    changed = without_repeats(chosen, spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    changed = changed.dropDuplicates(["doc_id", "key"]).withColumnRenamed("kept_sha256", "new_sha256")
    late = F.col("doc_id") > F.col("first")
    out = marked.select("doc_id", "key", "n_words", "kept_sha256", "first").join(changed, ["doc_id", "key"], "left")
    n_removed = F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    kept = F.when(late, F.lit(sha([]))).otherwise(F.coalesce("new_sha256", "kept_sha256"))
    judged = out.select("doc_id", "n_words", n_removed.alias("n_removed"), kept.alias("kept_sha256"))
    rest = lines.where(~usable | F.col("doc_id").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return judged.union(rest)
