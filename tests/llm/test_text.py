"""Tokenisation, fingerprints, secrets, toxicity, mixing and the pipeline."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, merkle, mixing, secrets, toxicity
from tidewatch.llm.queries import WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)
ODD = ["<|endoftext|>a<|startoftext|>", "İΣΑΣ ΟΔΟΣ aaa'sbb !'s ½ 123 \x1c a\x1db c ﬁ é 日本語 <|ENDOFTEXT|>", "hahahahaha aaaaaaaaaaaa " * 3, " x​y﻿z \U0001f468‍\U0001f469", "a" * 5000]


def test_bpe_matches_the_library(make, corpus):
    rows = [*corpus, *enumerate(ODD, 1000)]
    lib = Tokenizer.from_file(PATH)
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, t)] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.bpe_digests(make(rows), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id is not None) == sorted((i, *v) for (i, t), v in want.items() if i is not None for _ in range(sum(x == (i, t) for x in rows)))
    counts = bpe.token_counts(make(rows), PATH, limit=100).collect()
    assert sorted((r.doc_id, r.n_tokens, r.over_limit) for r in counts if r.doc_id is not None) == sorted((r.doc_id, r.n_tokens, r.n_tokens > 100) for r in got if r.doc_id is not None)
    one = bpe.bpe_encode(make([(1, "Hello world")]), PATH).head()
    assert one.ids == lib.encode("Hello world", add_special_tokens=False).ids and one.decoded == "hello</w> world</w>"
    assert bpe.bpe_encode(make([]), PATH).count() == 0


@pytest.mark.parametrize(("stretch", "new"), [(1, 10**6), (1 << 30, 40)])
def test_short_stretches_change_nothing(make, corpus, stretch, new, monkeypatch):
    want = sorted(map(str, bpe.bpe_digests(make(corpus), PATH).collect()))
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    monkeypatch.setattr(bpe, "NEW_WORDS", new)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    assert sorted(map(str, bpe.bpe_digests(make(corpus), PATH).collect())) == want


def test_full_word_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    v, lib = bpe.Vocabulary(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    for t in ["the quick brown fox, jumps!", *ODD, "the lazy dog's bone"] * 2:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert v.encode([t])[0][0] == np.array(ids, "<u4").tobytes() and v.count(t) == len(ids)


def test_fingerprints(make):
    rng = random.Random(5)
    rows = [(3 * i, "\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(9)) + "." for _ in range(rng.randint(1, 40)))) for i in range(50)]
    rows += [(200, rows[0][1]), (201, None), (202, ""), (203, "é\U0001f600x")]
    out = {r.doc_id: r for r in merkle.document_fingerprints(make(rows)).collect()}
    order = sorted(rows)
    assert len(out) == len(rows)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        n = len(t)
        changed = t[: n - n // 2] + after[: n // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert out[i].fingerprint == merkle.fingerprint(t) and out[i].edited_fingerprint == merkle.fingerprint(changed)
        assert 0 <= out[i].near_edited <= 1 and (out[i].near_edited == 1) == (changed == t)
    assert out[0].fingerprint == out[200].fingerprint
    assert merkle.document_fingerprints(make([])).count() == 0
    assert [r.near_next for r in merkle.document_fingerprints(make([(7, "alone")])).collect()] == [1.0]
    assert merkle.document_fingerprints(make([(None, "x"), (1, "b"), (1, "a"), (None, None)])).count() == 4


def plain_tree(text):
    """(root, lengths of the leaves by their shortened digest), by a plain recursion over sections, paragraphs and sentences."""
    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    leaves, sections, open_ = [], [], []
    for line in text.split("\n"):
        cut, at = [], 0
        while at < len(line):
            n = at
            while n < len(line) and n < at + 400 and line[n] not in ".!?":
                n += 1
            while n < len(line) and line[n] in ".!?":
                n += 1
            while n < len(line) and line[n].isspace():
                n += 1
            cut.append(line[at:n])
            at = n
        leaves += cut
        p = h(b"p" + b"".join(h(x.encode()) for x in cut))
        open_.append(p)
        if not cut or p[15] % 8 == 0:
            sections.append(open_)
            open_ = []
    sections += [open_] if open_ else []
    lengths = {}
    for x in leaves:
        k = h(x.encode())[:4].hex()
        lengths[k] = lengths.get(k, 0) + len(x)
    return h(b"d" + b"".join(h(b"s" + b"".join(s)) for s in sections)).hex(), lengths


def test_likeness_follows_plain_trees(make, corpus):
    rows = [(i, t) for i, t in corpus if i is not None] + [(900, "A. B? C! " * 100_000 + "x" * 1_000_000), (901, "A. B? C! " * 100_000)]
    rows = sorted({i: (i, t or "") for i, t in rows}.values())
    out = {r.doc_id: r for r in merkle.document_fingerprints(make(rows)).collect()}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        (root, mine), (new_root, new), (next_root, following) = map(plain_tree, (t, changed, after))
        for got, other_root, other in ((out[i].near_edited, new_root, new), (out[i].near_next, next_root, following)):
            shared = sum(min(n, other.get(k, 0)) for k, n in mine.items())
            total = sum(mine.values()) + sum(other.values())
            assert abs(got - (1.0 if other_root == root else 2 * shared / max(1, total))) < 1e-6
        assert out[i].fingerprint.startswith(root + "|") and out[i].edited_fingerprint.startswith(new_root + "|")


def test_roots_tell_texts_apart_and_edits_are_located():
    assert len({merkle.Tree(t).root for t in ("", "\n", "a", "a\n", "a.b", "a. b", "b\na", "a\nb", "a\n\nb")}) == 9
    text = "\n".join(f"line number {i}." for i in range(40))
    places = merkle.differing_paragraphs(merkle.fingerprint(text.replace("number 17", "no 17")), merkle.fingerprint(text))
    assert len(places) == 1


def test_secret_base_spans():
    key = "A" * 6
    cases = {f'password = "{key}"': [(0, 0, 18)], "token=token:abcdef": [], "API_KEY: 'abcdefgh'": [(0, 0, 18)], "xAKIA" + "B" * 16: [(1, 1, 21)], "AKIA" + "B" * 15: [], "f" * 24: [(0, 2, 24)], "f" * 23: [], "toKen=abcdefgh": [], "ésecret=abcdef": [(1, 0, 14)]}
    for text, want in cases.items():
        assert secrets.base_spans(text) == want, text


def test_secret_scan(spark, make, data):
    rng = random.Random(9)
    made = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    plain = "understanding internationalisation and the configuration_manager_factory of documentation " * 5
    rows = [(i, plain) for i in range(20)] + [(50, f"key {made} end"), (51, "password=hunter22 " + "0" * 30), (52, None), (53, "")]
    table = secrets.train(spark.read.parquet(f"{data}/documents.parquet"))
    out = {r.doc_id: r for r in secrets.scan_secrets(make(rows), table).collect()}
    assert out[50].spans == "markov:4:44" and out[50].n_hex == 0
    assert out[51].spans == "assign:0:17,hex:18:48" and (out[51].n_assign, out[51].n_hex) == (1, 1)
    assert all(out[i].spans == "" for i in (0, 52, 53))
    assert secrets.scan_secrets(make([])).count() == 0


def plain_spans(text, table):
    """Base spans by the patterns as stated, and random stretches by trying every one; no vectors."""
    found = []
    for kind, pattern in enumerate((r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.I | re.A if kind == 0 else 0):
            size, least = (len(m[2]), 6) if kind == 0 else (len(m[0]), 20 if kind == 1 else 24)
            if size >= least:
                found.append((m.start(), kind, m.end()))
    base, free = sorted(found), list(text)
    for s, _, e in base:
        free[s:e] = [" "] * (e - s)

    def walk(run, at):
        if len(run) < 16:
            return
        c = [secrets.SYMBOLS.index(x) for x in run]
        gain = [table[secrets.SIZE][c[0]], *[table[a][b] for a, b in zip(c, c[1:], strict=False)]]
        best, s, e = max((round(sum(gain[i:j]), 9), -j, i) for i in range(len(run) - 15) for j in range(i + 16, len(run) + 1))
        s, e = e, -s
        if best >= 12 and best >= 0.5 * (e - s):
            while s and run[s - 1].isalnum():
                s -= 1
            while e < len(run) and run[e].isalnum():
                e += 1
            walk(run[:s], at)
            found.append((at + s, 3, at + e))
            walk(run[e:], at + e)

    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", "".join(free)):
        walk(m[0], m.start())
    return base, sorted(found)


def test_secret_spans_follow_plain_loops(spark, data):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = secrets.train(docs)
    key = lambda n, a=string.ascii_letters + string.digits: "".join(rng.choices(a, k=n))
    texts = [r.text or "" for r in docs.collect()][:150]
    texts += [f"path/to/some/directory/{key(22)} and {key(30)}/{key(30)}", f"secret={key(9)} x_{key(24)}", f"{key(40, '0123456789abcdef')}{key(20)}", f"AKIA{key(16, string.ascii_uppercase)}/{key(20)}"]
    texts += [" ".join(key(rng.randint(3, 34)) for _ in range(12)) for _ in range(10)]
    for t in texts:
        assert secrets.all_spans(t, table) == plain_spans(t, table), t
    assert [t[s:e] for t in [f"some/long/path/of/a/configuration/{'x9K2pQ7vLm4Tz8Rw1YbN'}"] for s, _, e in secrets.all_spans(t, table)[1]] == ["x9K2pQ7vLm4Tz8Rw1YbN"]


def test_secrets_in_a_very_long_text(make):
    text = "plain words go on " * 200_000 + "password=hunter22 " + "0123456789abcdef" * 3 + " end"
    table = np.full((secrets.SIZE + 1, secrets.SIZE), -1.0)
    (row,) = secrets.scan_secrets(make([(1, text)]), table).collect()
    at = 200_000 * 18
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 1) and row.spans == f"assign:{at}:{at + 17},hex:{at + 18}:{at + 66}"


def labelled(spark, n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice("the river runs over stone and paper in green light".split()) for _ in range(rng.randint(5, 160))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyword"])
        good = rng.random() < 0.7
        w += [rng.choice(["filler", "cheap", "bargain"]) for _ in range(0 if good else len(w) // 2 + 1)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, make):
    docs, labels = labelled(spark)
    long = " ".join(["river stone"] * 4000 + ["vileword"] + ["paper"] * 10)
    rows = [*docs, (900, long), (901, None), (902, ""), (903, "...")]
    out = {r.doc_id: r for r in toxicity.toxicity_scores(make(rows), labels).collect()}
    held = [i for i, _ in docs if out[i].held_out]
    assert held and sum(out[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert out[900].predicted == 1 and all(out[i].score == 0 for i in (901, 902, 903))
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(make(rows), labels).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity_scores(make(rows), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(make([]), labels).count() == 0


def test_toxic_passages_are_found_at_every_offset(spark):
    """Passages of 8 to 33 words lie whole in a window wherever they begin; scores equal a plain loop's over all windows."""
    docs, labels = labelled(spark)
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    scorer = toxicity.train([t for _, t in docs], [marks[i] for i, _ in docs])
    clean = ["river", "stone", "paper", "green", "light", "over"] * 40
    texts = []
    for size in (8, 20, 33):
        passage = (["vileword", "nastyword"] * size)[:size]
        texts += [" ".join(clean[:at] + passage + clean[at:]) for at in range(120)]
    found = scorer.score([*texts, " ".join(clean)])
    assert all(s >= 0.5 for s in found[:-1]) and found[-1] < 0.5
    for text, got in zip(texts[::37], found[::37], strict=True):
        words = toxicity.words_of(text)
        best = -math.inf
        for start in toxicity.window_starts(len(words)):
            part = words[start : start + toxicity.WINDOW]
            x = toxicity.features(part, scorer.odds, scorer.tables)[None]
            net = toxicity.Network()
            net.p = scorer.p
            best = max(best, float(net.run(x, np.ones(x.shape[:2], bool))[0][0]))
        assert abs(got - 1 / (1 + math.exp(-best))) < 1e-4


def test_window_starts_cover_all_words():
    for n in range(1, 400):
        starts = toxicity.window_starts(n)
        assert starts[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_training_rows_are_whole_and_bounded(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 60_000)
    rows = [(i, "word " * (10 if i % 2 else 3000)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 < 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.chosen_rows(make(rows).select("doc_id", "text"), labels).collect()
    assert all(r.text == dict(rows)[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    for mark in (0, 1):
        assert 0 < sum(len(r.text) for r in got if r.toxic == mark) <= 60_000


def test_gradients_match_differences():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(3, 6, toxicity.INPUT)), np.ones((3, 6), bool)
    mask[1, 4:] = False
    w = rng.normal(size=3)
    g, dx = net.gradients(net.run(x, mask)[1], w)
    for name, at in (("wf", (0, 5)), ("ub", (2, 9)), ("cf", (20,)), ("wa", (3, 2)), ("va", (1,)), ("u", (4,))):
        old = net.p[name][at]
        values = []
        for d in (1e-5, -1e-5):
            net.p[name][at] = old + d
            values.append(net.run(x, mask)[0] @ w)
        net.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - g[name][at]) < 1e-2 * max(0.05, abs(g[name][at])), name
    assert not dx[1, 4:].any()


def shares(rates):
    n = sum(r.n_words for r in rates)
    return {d: sum(r[f"p_{d}"] * r.n_words * r.rate for r in rates) / n for d in mixing.DOMAINS}


@pytest.mark.parametrize("targets", [None, {"low_clean": 0.3, "low_toxic": 0.1, "high_clean": 0.5, "high_toxic": 0.1}, {"low_clean": 8.0, "low_toxic": 0.5, "high_clean": 90.0, "high_toxic": 1.5}])
def test_mixing_meets_stated_targets(spark, data, targets):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rates = mixing.mix_rates(docs, labels, targets).collect()
    got, want = shares(rates), targets or mixing.TARGETS
    total = sum(want.values())
    assert len(rates) == docs.count()
    assert all(abs(got[d] - want[d] / total) < 1e-5 * want[d] / total for d in got) and all(r.miss <= mixing.CLOSE for r in rates)


def test_mixing(spark, make):
    docs, labels = labelled(spark)
    rates = mixing.mix_rates(make([*docs, (900, None), (901, "")]), labels, {"low_clean": 0.3, "low_toxic": 0.1, "high_clean": 0.5, "high_toxic": 0.1}).collect()
    assert all(r.rate >= 0 and abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-6 for r in rates)
    assert {r.rate for r in rates if r.n_words == 0} == {1.0}


def test_targets_out_of_reach_are_reported(spark):
    """No document leans to two of the domains: the rates are as good as projected gradient in numpy finds, and miss says what is left."""
    p = np.array([[0.7, 0.1, 0.1, 0.1]] * 5 + [[0.1, 0.7, 0.1, 0.1]] * 9)
    n = np.arange(10, 24)
    held = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(n, p, strict=True)], "n_words long, p array<double>")
    targets = {"low_clean": 0.1, "low_toxic": 0.1, "high_clean": 0.4, "high_toxic": 0.4}
    rows = mixing.fit_rates(held, targets).collect()
    a = (p * n[:, None]).T / (np.array(list(targets.values()))[:, None] * n.sum())
    r = np.ones(14)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 / np.linalg.norm(a @ a.T, 2) * a.T @ (a @ r - 1))
    got = a @ np.array([x.rate for x in sorted(rows, key=lambda x: x.n_words)]) - 1
    assert got @ got <= 1.001 * ((a @ r - 1) @ (a @ r - 1))
    assert abs(rows[0].miss - np.abs(got).max()) < 1e-9 and rows[0].miss > 0.1


def test_posteriors_follow_plain_bayes(spark, make):
    docs, labels = labelled(spark, 60)
    made = mixing.fit_classifiers(make(docs), labels)
    marks = {r.doc_id: r for r in labels.collect()}
    n, yes, all_words = {}, {}, 0
    for i, t in docs:
        for w in t.split():
            n[w] = n.get(w, 0) + 1
            yes[w] = yes.get(w, 0) + marks[i].toxic
            all_words += 1
    ones = sum(yes.values())
    prior = math.log((sum(m.toxic for m in marks.values()) + 1) / (sum(1 - m.toxic for m in marks.values()) + 1))
    weight = lambda w: math.log((yes[w] + 200 * n[w] / all_words) / (ones + 200)) - math.log((n[w] - yes[w] + 200 * n[w] / all_words) / (all_words - ones + 200))
    for r in mixing.posteriors(make(docs), made).collect():
        words = docs[r.doc_id][1].split()
        odds = prior + sum(map(weight, words)) * mixing.EVIDENCE_WORDS / max(len(words), mixing.EVIDENCE_WORDS)
        assert abs(r.p[1] + r.p[3] - 1 / (1 + math.exp(-odds))) < 1e-3


def test_mixing_edges(spark, make):
    _, labels = labelled(spark)
    assert mixing.mix_rates(make([]), labels).count() == 0
    assert mixing.mix_rates(make([(1, "a b"), (1, "a b"), (None, "c")]), labels.limit(0)).count() == 3
    rates = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 1.0)], "doc_id long, rate double")
    drawn = [r.doc_id for r in mixing.draw(make([(1, "a"), (2, "b"), (3, "c"), (None, "d")]), rates).collect()]
    assert sorted(map(str, drawn)) == ["2", "2", "3", "None"]
    names = ["rate", "rate_", "copies", "copy_", "row", "i", "a.b"]
    odd = spark.createDataFrame([(2, "b", *names), (1, "a", *names)], ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    out = mixing.draw(odd, rates)
    assert out.columns == odd.columns and [tuple(r) for r in out.collect()] == [(2, "b", *names)] * 2


def test_pipeline(spark, data):
    """Each stage, on what its predecessor kept, against plain loops; scores and rates come from their operators."""
    import corpus_pipeline as P
    from test_dedup import brute_jaccard, brute_lines

    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.union(docs.limit(3)).withColumn("rate", F.lit("kept")).withColumn("starts", F.lit(None).cast("string"))
    docs = P.cut(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.lit(None).cast("string")})))
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name, stage in P.STAGES:
        before = rows(docs)
        out = P.cut(stage(spark, docs, data))
        if name == "encoding":
            lib = Tokenizer.from_file(PATH)
            want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t in before)
            assert sorted((str(r.doc_id), list(r.ids)) for r in out.collect()) == want
            break
        assert out.columns == docs.columns and {r.rate for r in out.collect()} == {"kept"}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
            assert rows(out) == [r for r in before if r[0] not in bad]
        if name == "line_dedup":
            left = [(i, t) for i, t, n in brute_lines(before) if not n or t]
            assert rows(out) == sorted(left, key=str)
        if name == "near_copies":
            groups = brute_jaccard(before)
            assert rows(out) == [(i, t) for i, t in before if i is None or groups[i][1] == i]
        if name == "mixing":
            rates = {r.doc_id: r.rate for r in mixing.mix_rates(docs, labels).collect()}
            want = {}
            for i, _ in before:
                want[i] = want.get(i, 0) + 1
            got = {}
            for i, _ in rows(out):
                got[i] = got.get(i, 0) + 1
            assert all(got.get(i, 0) in (n * math.floor(rates[i]), n * math.floor(rates[i] + 1)) if i is not None else got[i] == n for i, n in want.items())
        docs = out
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_copies", "mixing", "encoding"]


def test_queries_run(spark, data):
    from tidewatch.llm import queries as Q

    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name, f in Q.queries().items():
        rows = f(spark, data).count()
        if name.startswith("op12"):  # nodes, counted in its own test
            assert rows > 0
            continue
        assert rows == (spark.read.parquet(f"{data}/embeddings.parquet").count() if name.startswith("op8") else n), name


def test_every_code_point_is_coded_as_by_the_library():
    """Singly, and between letters before a combining mark; of blocks of ideographs and of planes without letters one in 16."""
    raw = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()  # noqa: SIM115
    own, library = bpe.Vocabulary(raw), Tokenizer.from_str(raw.decode())
    even = [(0x3400, 0xA000), (0xAC00, 0xD800), (0xE000, 0xF900), (0x13000, 0x16000), (0x17000, 0x1B000), (0x20000, 0x110000)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 16 == 0 or not any(a <= c < b for a, b in even))]
    texts = [f"{chr(c)} a{chr(c)}́b" for c in points]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [b for b, _ in own.encode(texts)] == want
    assert [4 * own.count(t) for t in texts] == list(map(len, want))
    rng = random.Random(8)
    mixed = ["".join(rng.choice("aÉσΣ ᲉꟜꟋ́ͅ\U00032808'1.İﬁ한하ガガ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t, e in zip(mixed, library.encode_batch_fast(mixed, add_special_tokens=False), strict=True):
        assert own.encode([t])[0][0] == np.array(e.ids, "<u4").tobytes() and own.count(t) == len(e.ids)


@pytest.mark.parametrize("mark", [0, 1])
def test_over_long_documents_do_not_cost_a_class(spark, make, monkeypatch, mark):
    monkeypatch.setattr(toxicity, "SAMPLE_LONGEST", 100)
    rows = [(i, "word " * (5000 if i % 2 == mark and i < 40 else 9)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.chosen_rows(make(rows).select("doc_id", "text"), labels).collect()
    assert {r.doc_id for r in got if r.toxic == mark} == {i for i in range(40, 60) if i % 2 == mark and zlib.crc32(str(i).encode()) % 5}
    all_long = [(i, "word " * (5000 + i) if i % 2 == mark else "short") for i in range(60)]
    got = [r for r in toxicity.chosen_rows(make(all_long).select("doc_id", "text"), labels).collect() if r.toxic == mark]
    assert [r.doc_id for r in got] == [min(i for i in range(60) if i % 2 == mark and zlib.crc32(str(i).encode()) % 5)]
    assert got[0].text == dict(all_long)[got[0].doc_id]
