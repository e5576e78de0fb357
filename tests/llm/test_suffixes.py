"""The difference-cover dedup against a plain dictionary of all 50-byte strings, and its parts."""

import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import suffixes
from tidewatch.llm.suffixes import COVER, LENGTH, PERIOD, dedup_bytes, merge, pack_keys, pack_numbers, unpack_keys, unpack_numbers


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - LENGTH + 1):
                k = b[p : p + LENGTH]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - LENGTH + 1):
                if first[b[p : p + LENGTH]] < i:
                    gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def hard(rng):
    """Short periods, runs of one byte, null bytes, passages at all offsets, matches of exactly 49, 50 and 51 bytes."""
    passage = "".join(rng.choice("abcd") for _ in range(120))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(i % 7)) + passage + rng.choice("pq") * (i % 5)) for i in range(40)]
    rows += [(50 + n, f"{n:03}" + passage[20 : 20 + n] + f"{n:04}") for n in range(46, 56)]
    rows += [(70, "a" * 300), (71, "a" * 49), (72, "b" + "a" * 50), (73, "ab" * 90), (74, "ba" * 90), (75, "\0" * 130), (76, "x\0" + "\0" * 60), (77, "abc" * 70), (78, passage * 3)]
    return rows + [(80 + i, "é中" * (20 + i) + passage[i:]) for i in range(9)]


@pytest.fixture(params=[(2 << 20, 3_000_000), (700, 400)], ids=["whole", "small"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", request.param[0])
    monkeypatch.setattr(suffixes, "RANGE", request.param[1])
    return request.param


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_dedup_equals_brute_force(spark, make, corpus, sizes):
    rng = random.Random(2)
    rows = [r for r in hard(rng) + [((i + 1000) if i is not None else None, t) for i, t in corpus if sizes[0] > 1000 or len(t or "") < 4000]]
    if sizes[0] < 1000:
        rows = rows[:70] + rows[70::9]
    assert got(dedup_bytes(make(rows).repartition(3))) == brute(rows)


def test_dedup_of_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(dedup_bytes(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nothing_to_find(spark, make):
    assert dedup_bytes(make([])).count() == 0
    rows = [(1, "short"), (2, None), (None, "n" * 80), (3, "n" * 80)]
    assert got(dedup_bytes(make(rows))) == brute(rows)


def test_long_text_in_pieces(spark, make):
    rng = random.Random(4)
    half = "".join(rng.choice("etaoin shrdlu") for _ in range(1_500_000))
    rows = [(1, half), (2, "-" + half + half[:1000] + "+" + "".join(rng.choice("etaoin shrdlu") for _ in range(1_200_000)))]
    second = [r for r in got(dedup_bytes(make(rows))) if r[0] == "2"]
    assert second == [("2", len(rows[1][1]), 1_501_000, 1, hashlib.sha256((rows[1][1][0] + rows[1][1][1_501_001:]).encode()).hexdigest())]


def test_packing_and_merging():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    assert (unpack_numbers(pack_numbers(a), 100) == a).all()
    k = np.sort(rng.integers(0, 3, (50, 12), np.uint8).view("S12").ravel())
    assert (unpack_keys(pack_keys(k), 50, 12) == k).all()
    text = rng.integers(0, 2, 400)
    of = {"A": lambda p: tuple(text[p : p + 8]), "B": lambda p: tuple(text[p : p + 8]), "C": lambda p: tuple(text[p : p + 8])}
    code = lambda p: int("".join(map(str, of["A"](p))), 2)
    keys = [{kind: np.array([code(p) for p in range(t, 390, 3)], np.uint64) for kind in kinds} for t, kinds in enumerate(suffixes.KINDS)]
    every = sorted(x for own in keys for x in next(iter(own.values())).tolist())
    assert all([every.index(x) for x in next(iter(own.values())).tolist()] == r.tolist() for own, r in zip(keys, merge(keys), strict=True))


def test_names_are_places_in_the_order_of_50_bytes():
    rng = random.Random(6)
    passage = "".join(rng.choice("abc") for _ in range(90)).encode()
    data = b"".join([passage, b"\0" * 70, passage[3:], b"ab" * 60, b"a" * 120, bytes(rng.choice(b"ab\0") for _ in range(400)), passage[:60]])
    b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(64, np.uint8)])
    chosen = np.array([p for p in range(len(data) - LENGTH + 1) if p % 7], np.int64)
    name, joined = suffixes.suffix_names(b, chosen)
    own = [data[p : p + LENGTH] for p in chosen.tolist()]
    every = sorted(set(own))
    assert [every[i] for i in name.tolist()] == own
    assert joined.tolist() == [i > 0 and every[i][: suffixes.DEEP] == every[i - 1][: suffixes.DEEP] for i in range(len(every))]
    keys = np.array(own, "S50")
    assert [own[i] for i in suffixes.order_of(keys).tolist()] == sorted(own)


def test_alike_segments_meet_and_no_passage_fills_a_bucket():
    rng = random.Random(7)
    text = lambda n: bytes(rng.choice(b"etaoin shrdlu") for _ in range(n))
    passage = text(300)
    data = [text(rng.randint(0, 20)) + passage + text(rng.randint(0, 20)) for _ in range(suffixes.ALIKE)] + [text(rng.randint(50, 300)) for _ in range(200)]
    alike = suffixes.sketches(b"".join(data), np.cumsum([0, *map(len, data)]))
    assert len(set(alike[: suffixes.ALIKE].tolist())) == 1 and len(set(alike.tolist())) == 201
    same = {tuple(suffixes.bucket_of(alike[: suffixes.ALIKE], partition, 50)) for partition in range(suffixes.NEARBY)}
    assert len(same) == 1 and len(set(same.pop())) == 1
    held = np.bincount(suffixes.bucket_of(np.full(20_000, alike[0]), 3, 50), minlength=50)
    assert held.min() > 0 and held.max() < 3 * held.mean()


def test_texts_are_asked_about_in_three_rounds(spark, data, monkeypatch):
    """Names, ranks and one merge: a fourth round, over two thirds of all suffixes, took a third of the time."""
    asked, ask = [], suffixes.ask
    monkeypatch.setattr(suffixes, "ask", lambda *a: asked.append(a) or ask(*a))
    assert dedup_bytes(spark.read.parquet(f"{data}/documents.parquet")).where("n_removed > 0").count() > 0
    assert len(asked) == 3
