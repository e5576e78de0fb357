"""The alignment of two tokenizers against a plain loop over byte positions."""

import hashlib
import random
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest

from tidewatch.llm.alignment import Aligner, align_tokenizers, cut_points, overlaps, slices

from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True


@pytest.fixture(scope="module")
def aligner():
    return Aligner(open(A, "rb").read(), open(B, "rb").read())  # noqa: SIM115


def brute(aligner, rows):
    """Every link by comparing all byte ranges of a document."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        raw, out = b" " + (text or "").encode(), None
        ids = LIBRARY.encode(" " + (text or ""), add_special_tokens=False).ids, aligner.b.encode(text or "")
        parts = [[t[i] for i in own] for own, t in zip(ids, (aligner.bytes_a, aligner.bytes_b), strict=True)]
        if text and all(b"".join(p) == raw for p in parts):
            spans = []
            for own, p in zip(ids, parts, strict=True):
                at, got = 0, []
                for i, x in zip(own, p, strict=True):
                    got.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(got)
            links = [(a, b) for a, s, e in spans[0] for b, t, f in spans[1] if s < f and t < e]
            both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            shown = [tuple(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *both], both, strict=False)]
            out = (len(ids[0]), len(ids[1]), len(both), links, hashlib.sha256(";".join("|".join(g) for g in shown).encode()).hexdigest())
            counts.update(links)
        docs.append((doc_id, out))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (str(d), 0, 0, 0, 0, 0, 0, "") if o is None else (str(d), o[0], o[1], o[2], len(o[3]), sum(counts[x] == most[x[1]] for x in o[3]), sum(counts[x] for x in o[3]), o[4])
        for d, o in docs
    )


TRICKY = [
    (1, "Plain words, and more plain words."), (2, ""), (3, None), (4, "a▁b"), (5, "<|endoftext|> <s> <0x41> <unk>"), (6, "  two  spaces \n\t tab"),
    (7, "é é 中文字 \U0001f600\U0001f600 ﬁ"), (8, "\x00 nul"), (9, "x" * 400), (14, "a" + " " * 30_000 + "\n" * 20_000 + "b"), (15, "aa\u2581"), (16, "zz " * 5 + "<|endoftext|>"), (10, "x"), (10, "x"), (None, "no id"), (11, " "), (12, "\n"), (13, "internationalisation " * 40),
]


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_cut_points_and_overlaps():
    assert cut_points([1, 3, 6], [3, 4, 6]) == ([2, 3], [1, 3])
    table = [b"a", b"bc", b"def", b"abc", b"d", b"ef"]
    assert overlaps([0, 1], [3], table, table) == [(0, 3), (1, 3)]
    assert overlaps([0, 1, 2], [3, 4, 5], table, table) == [(0, 3), (1, 3), (2, 4), (2, 5)]


def test_alignment_equals_brute_force(spark, make, corpus, aligner, monkeypatch):
    rows = TRICKY + [r for r in corpus if r[0] is None or r[0] < 70 or r[0] > 130]
    assert got(align_tokenizers(make(rows).repartition(5), A, B)) == brute(aligner, rows)


def test_alignment_of_a_table(spark, data, aligner):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(align_tokenizers(small, A, B)) == brute(aligner, rows)


def test_alignment_of_empty_tables_and_long_texts(spark, make):
    assert align_tokenizers(make([]), A, B).count() == 0
    text = "some words that repeat, " * 120_000
    [row] = align_tokenizers(make([(1, text)]), A, B).collect()
    [one] = align_tokenizers(make([(1, text[: len(text) // 2]), (2, None)]).where("doc_id = 1"), A, B).collect()
    assert row.n_a == 2 * one.n_a - 1 and row.n_links > 400_000 and row.count_sum > one.count_sum


def test_ids_of_all_code_points_equal_the_library(aligner):
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{chr(c)}b {chr(c)}1{chr(c)}\n" for c in every[lo : lo + 64]) for lo in range(0, len(every), 64)]
    assert [aligner.a(t) for t in texts] == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def prose(n, words=3000):
    rng = random.Random(5)
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(words)]
    return [" ".join(rng.choices(known, k=100)) for _ in range(n)]


def test_rows_of_slices_are_small(make):
    """Spark's readers hold a file's arrays at once: besides the distinct pairs, a slice's row is a fraction of its text."""
    texts = prose(2000)
    rows = slices(make(enumerate(texts)).coalesce(1), A, B).drop("slice", "pair", "n").collect()
    held = sum(len(x) if isinstance(x, bytes | bytearray | str) else 4 * len(x) for r in rows for x in r)
    assert rows and held < sum(map(len, texts))


def test_memory_of_a_slice(aligner):
    """A worker's memory while it aligns a slice, in bytes for one of text."""
    texts = prose(2000)
    aligner.slice(list(range(len(texts))), texts)  # groups are known from here on
    tracemalloc.start()
    aligner.slice(list(range(len(texts))), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, texts))
