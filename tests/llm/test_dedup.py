"""Near-duplicate operators against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidewatch.llm import common, jaccard, lines, substrings, vectors
from tidewatch.llm.components import components


class Groups:
    def __init__(self, items):
        self.p = {i: i for i in items}

    def root(self, i):
        while self.p[i] != i:
            i = self.p[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.p[b] = a


def shingles(text):
    w = tuple((text or "").encode().lower().split())
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    g, ids = Groups(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                g.join(a, b)
    return {i: (len(s), g.root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "one_in"), [(512, 1000), (4, 3)])
def test_jaccard(make, corpus, block, one_in, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ONE_IN", one_in)
    out = jaccard.jaccard_components(make(corpus)).collect()
    assert len(out) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute_jaccard(corpus)
    assert all(r.component_id is None for r in out if r.doc_id is None)


def short_copies(seed):
    """Short texts with a word more or less at either end, in groups of 2 to 30."""
    rng, rows, used = random.Random(seed), [], iter(range(10**6))
    new = lambda: f"x{next(used)}"
    for group in (2, 2, 2, 3, 5, 9, 12, 16, 30):
        for n in range(5, 18):
            base = [new() for _ in range(n)]
            for _ in range(group):
                w = base[rng.choice((0, 0, 0, 1)) : n - rng.choice((0, 0, 0, 1))]
                rows.append(" ".join([new()] * rng.choice((0, 0, 0, 1)) + w + [new()] * rng.choice((0, 0, 1, 1, 2))))
    return [(i, t) for i, t in enumerate(rows)]


def test_jaccard_of_short_texts(make):
    words = [f"w{i}" for i in range(1, 10)]
    rows = [*short_copies(4), (5000, " ".join(words[:8])), (5001, " ".join(words))]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows)).collect()}
    assert out[5001] == (5, 5000)
    assert out == brute_jaccard(rows)


@pytest.mark.parametrize(("seed", "block"), [(1, 3), (2, 512), (3, 5)])
def test_jaccard_of_random_small_sets(make, seed, block, monkeypatch):
    """Sets of 1 to 30 shingles in chains and groups of near copies; few and many frequent shingles, whole and cut groups."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(seed), []
    for _ in range(14):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(5, 34))]
        shared = [f"s{i}" for i in range(12)] if rng.random() < 0.5 else []
        for _ in range(rng.choice((2, 4, 14, 25))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                if rng.random() < 0.5:
                    w[rng.choice((0, len(w) - 1))] = f"v{rng.randrange(10**6)}"
                else:
                    w = w[1:] if rng.random() < 0.5 else [*w, f"v{rng.randrange(10**6)}"]
            texts.append(" ".join(shared + w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows)).collect()}
    assert out == brute_jaccard(rows)


def test_jaccard_without_rows(make):
    assert jaccard.jaccard_components(make([])).count() == 0
    assert [(r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make([(1, None)])).collect()] == [(0, 1)]


def test_keep_one(make, corpus):
    kept = {r.doc_id for r in jaccard.keep_one(make(corpus)).collect()}
    want = {i for i, (_, c) in brute_jaccard(corpus).items() if i == c}
    assert kept == want | {None}


def test_components_of_a_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (7, 200)], "a long, b long")
    assert {r.node: r.component for r in components(e).collect()} == {i: 0 for i in [*range(n + 1), 200]}


def brute_substrings(rows):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for a in range(len(w) - 49):
                k = tuple(w[a : a + 50])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for a in range(len(w) - 49):
                if first[tuple(w[a : a + 50])] < i:
                    gone |= set(range(a, a + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "at_once", "one_in"), [(20_000, 1 << 20, 1000), (20_000, 1, 5), (3, 1 << 20, 5)])
def test_substrings(make, corpus, hot, at_once, one_in, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_DOCS", hot)
    monkeypatch.setattr(substrings, "SORT_WINDOWS", at_once)
    monkeypatch.setattr(common, "HOT_ONE_IN", one_in)
    got = sorted((tuple(r) for r in substrings.dedup_substrings(make(corpus)).collect()), key=str)
    assert got == brute_substrings(corpus)
    assert sum(r[2] > 0 for r in got) > 30


def test_substrings_without_rows(make):
    assert substrings.dedup_substrings(make([])).count() == 0


def test_substrings_of_very_long_texts(make):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    long = [f"w{rng.randrange(10**9)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[1000:90_000], "x", *passage])), (3, " ".join(["y"] * 40_000)), (4, " ".join(["y"] * 60)), (5, " ".join(passage * 300))]
    assert sorted((tuple(r) for r in substrings.dedup_substrings(make(rows)).collect()), key=str) == brute_substrings(rows)


def brute_lines(rows):
    seen, out = {}, []
    for i, t in rows:
        if i is not None and t is not None:
            x = t.split("\n")
            for p in range(len(x) - 2):
                k = tuple(x[p : p + 3])
                seen[k] = min((i, p), seen.get(k, (i, p)))
    for i, t in rows:
        if t is None or i is None:
            out.append((i, t, 0))
            continue
        x = t.split("\n")
        gone = {q for p in range(len(x) - 2) if seen[tuple(x[p : p + 3])] != (i, p) for q in (p, p + 1, p + 2)}
        out.append((i, "\n".join(y for q, y in enumerate(x) if q not in gone), len(gone)))
    return sorted(out, key=str)


def test_lines(make, corpus):
    df = lines.dedup_lines(make(corpus))
    assert sorted((tuple(r) for r in df.select("doc_id", "text", "n_removed").collect()), key=str) == brute_lines(corpus)
    assert df.columns == [*make([]).columns, "n_lines", "n_removed"]
    assert lines.dedup_lines(make([])).count() == 0


@pytest.mark.parametrize("one_in", [1000, 2])
def test_lines_keep_columns_of_any_name(spark, one_in, monkeypatch):
    monkeypatch.setattr(common, "HOT_ONE_IN", one_in)
    names = ["starts", "gone", "l", "row", "h", "pos", "first", "n", "c0", "salt_", "starts_", "a.b"]
    rows = [(i, f"own {i}\na\nb\nc\nd", *[f"{c}{i}" for c in names]) for i in range(30)] + [(None, "a\nb\nc", *names), (7, None, *names)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    got = {(r.doc_id, r.starts): r for r in out.collect()}
    assert all(got[i, f"starts{i}"][2:14] == rows[i][2:] and got[i, f"starts{i}"].text == (rows[0][1] if i == 0 else f"own {i}") for i in range(30))
    assert got[None, "starts"].text == "a\nb\nc" and got[7, "starts"].text is None and len(got) == 32


def test_vectors(spark, monkeypatch):
    rng = random.Random(1)
    near = lambda v, s: [x + rng.gauss(0, s) for x in v]
    rows, centres = [], [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    for i in range(300):
        c = centres[i % 6]
        rows.append((i, near(c, rng.choice([0.05, 0.2, 0.3])) if i % 3 else [rng.gauss(0, 1) for _ in range(16)], i % 4))
    rows += [(400 + i, rows[1][1], 1) for i in range(9)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [math.nan] * 16, 1), (503, [None, *[1.0] * 15], 1), (504, rows[1][1], None), (505, rows[1][1][:8], 1), (None, rows[1][1], 1), (506, [math.inf] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    ok = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and r.label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[r.vec_id] = (r.label, v)
    g, n = Groups([r[0] for r in rows if r[0] is not None]), dict.fromkeys([r[0] for r in rows], 0)
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y):
                if sum(p * q for p, q in zip(x, y, strict=True)) >= 0.93 * math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y)):
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    g.join(a, b)
    for cell in (4096, 20):
        monkeypatch.setattr(vectors, "CELL", cell)
        monkeypatch.setattr(vectors, "HOME_BLOCK", cell)
        monkeypatch.setattr(vectors, "OTHER_BLOCK", 2 * cell)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
        assert got.pop(None) == (0, None, False)
        assert got == {i: (n[i], g.root(i), g.root(i) == i) for i in n if i is not None}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_cells_meet_as_the_triangle_inequality_says():
    """Well-separated groups stay in their own cells; a pair that a border cuts is seen on the other side, and nothing near is missed."""
    rng = np.random.default_rng(4)
    centres = vectors.unit(rng.normal(size=(12, 32)))
    x = vectors.unit(np.repeat(centres, 30, 0) + rng.normal(size=(360, 32)) * 0.04)
    middle = vectors.unit(centres[:1] + centres[1:2] + rng.normal(size=(40, 32)) * 0.02)
    x, r = np.concatenate([x, middle]), math.acos(0.93)
    cos = x @ centres.T
    home = cos.argmax(1)
    reach = np.array([np.arccos(np.clip(cos[home == j, j].min(), -1, 1)) for j in range(12)])
    meets = vectors.meeting_cells(x, home, centres, reach, r)
    near = x @ x.T >= 0.93
    i, j = np.nonzero(near)
    assert meets[j, home[i]].all() and (home[i] != home[j]).any()
    assert len(x) < meets.sum() < 0.5 * meets.size


def test_every_label_has_pivots(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], "abc"[i % 3]) for i in range(90)] + [(900, [1.0] * 8, "d")], "vec_id long, embedding array<float>, label string")
    pivots = vectors._pivots(vectors.vector_classes(df))
    assert {k: len(v) for k, v in pivots.items()} == {("a", 8): 4, ("b", 8): 4, ("c", 8): 4, ("d", 8): 1}


def test_scratch_folder_comes_from_the_session(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_jaccard_of_rows_that_share_a_doc_id(make):
    """Every text of a doc_id links, and joins the groups of all others."""
    rng = random.Random(6)
    one, two, three = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one), (1, two), (2, one + " near"), (3, two + " near"), (4, three), (5, three), (5, two), (7, "other text that links with nothing at all"), (None, one)]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(make(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (None, None)}
    assert {r.doc_id for r in jaccard.keep_one(make(rows)).collect()} == {1, 7, None}
