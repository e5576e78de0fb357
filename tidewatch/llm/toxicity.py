"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its hashed word embedding beside the mean of its hashed character n-gram embeddings, with the log-odds of
the word and of its n-grams in toxic against other training documents. Windows of 48 words, 24 apart, cover the whole text,
so that any passage of up to 25 words lies whole in one of them; every window is scored and the highest score is the
document's. Training in numpy follows multiple-instance learning: each document, read whole, trains through the window that
scores highest. Log-odds of a training document are counted without its own fold.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, pieces, task_memory
from .shingles import mix

WINDOW, STRIDE = 48, 24
WORDS, GRAMS = 1 << 16, 1 << 17
EMBED, HIDDEN = 4, 8
INPUT = 2 * EMBED + 3
#: Labelled documents that train the network at most: of each class the first by hash of doc_id. Documents are taken whole or not
#: at all. Those of more than SAMPLE_LONGEST code points are left out one by one, unless their class has no shorter one; then its
#: shortest trains. The others train as far as they have SAMPLE_TEXT code points together, so at least 50 of a class do.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_LONGEST, SAMPLE_TEXT = 1200, 2400, 200_000, 10_000_000
FOLDS, EPOCHS, BATCH, RATE = 4, 14, 64, 0.01
#: Epochs that look for each document's highest window anew.
LOOK_AT = (0, 1, 2, 4, 7, 10)
#: Words that a task's table holds at most, besides those of one slice of texts; the table goes with the task.
CACHE_WORDS = 60_000
#: Words whose n-grams are worked out at once.
AT_ONCE = 8_192
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 4-, 6- and 7-byte runs of all words, word after word; where each word's begin; and their number."""
    raw = [f"<{w}>>".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes to the end of the word
    found = []
    for n in (4, 6, 7):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + text[at + j]
        found.append((owner[at], mix(h) % np.uint64(GRAMS)))
    owner = np.concatenate([o for o, _ in found])
    order = np.argsort(owner, kind="stable")
    n = np.bincount(owner, minlength=len(raw))
    return np.concatenate([h for _, h in found])[order].astype(np.int64), np.r_[0, np.cumsum(n)[:-1]], n.astype(np.float32)


def word_bucket(word: str) -> int:
    return zlib.crc32(b"w" + word.encode()) % WORDS


class LogOdds:
    """Shrunken log-odds of words and n-grams between the documents of two classes."""

    def __init__(self, words: np.ndarray, grams_: np.ndarray, n: np.ndarray):
        self.word, self.gram = self._odds(words, n), self._odds(grams_, n)

    @staticmethod
    def _odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        both = counts.sum(0)
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        return np.where(both >= 2, odds * both / (both + 3), 0).astype(np.float32) * 0.5


def embedded(at: tuple, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Word embedding and mean n-gram embedding of words; at: their buckets and what grams says of them."""
    bucket, (flat, cut, n) = at
    return np.concatenate([tables[0][bucket], np.add.reduceat(tables[1][flat], cut) / n[:, None]], 1)


def rated(at: tuple, odds: LogOdds) -> np.ndarray:
    """Log-odds of words, and the largest and the mean of their n-grams."""
    bucket, (flat, cut, n) = at
    go = odds.gram[flat]
    return np.stack([odds.word[bucket], np.maximum.reduceat(go, cut), np.add.reduceat(go, cut) / n], 1)


def features(words: list[str], odds: LogOdds, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of inputs for each word."""
    at = np.fromiter(map(word_bucket, words), np.int64, len(words)), grams(words)
    return np.concatenate([embedded(at, tables), rated(at, odds)], 1).astype(np.float32)


def in_turn(words: list[str]) -> list[list[str]]:
    return [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, and their gradients for a batch of windows."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = INPUT, HIDDEN
        draw = lambda *s: (rng.normal(size=s) / math.sqrt(s[0])).astype(np.float32)
        self.p = {"b": np.zeros(1, np.float32) - 1, "u": draw(2 * h), "wa": draw(2 * h, h), "va": draw(h)}
        for way in "fb":
            self.p |= {f"w{way}": draw(d, 3 * h), f"u{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
            self.p[f"w{way}"][2 * EMBED :] *= 2
        self.tables = (rng.normal(size=(WORDS, EMBED)).astype(np.float32) * 0.05, rng.normal(size=(GRAMS, EMBED)).astype(np.float32) * 0.05)

    def run(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores (log-odds) of windows x (n, steps, input), and what the gradients need."""
        p, hid, (n, t, _) = self.p, HIDDEN, x.shape
        kept: dict = {"x": x, "mask": mask}
        out = np.zeros((n, t, 2 * hid), np.float32)
        for k, way in enumerate("fb"):
            h, steps = np.zeros((n, hid), np.float32), []
            a = x @ p[f"w{way}"] + p[f"c{way}"]
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                g = h @ p[f"u{way}"]
                rz = sigmoid(a[:, i, : 2 * hid] + g[:, : 2 * hid])
                r, z = rz[:, :hid], rz[:, hid:]
                c = np.tanh(a[:, i, 2 * hid :] + r * g[:, 2 * hid :])
                m = mask[:, i, None]
                new = np.where(m, (1 - z) * c + z * h, h)
                steps.append((i, h, r, z, c, g[:, 2 * hid :]))
                h = new
                out[:, i, k * hid : (k + 1) * hid] = h
            kept[way] = steps
        s = np.tanh(out @ p["wa"])
        e = np.where(mask, s @ p["va"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * out).sum(1)
        return pooled @ p["u"] + p["b"], kept | {"out": out, "s": s, "alpha": alpha, "pooled": pooled}

    def gradients(self, kept: dict, dy: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the inputs, given those of the scores."""
        p, hid, out, alpha, s, mask, x = self.p, HIDDEN, kept["out"], kept["alpha"], kept["s"], kept["mask"], kept["x"]
        g = {"b": dy.sum(keepdims=True), "u": kept["pooled"].T @ dy}
        dp = dy[:, None] * p["u"]
        da = (out * dp[:, None, :]).sum(2)
        de = alpha * (da - (alpha * da).sum(1, keepdims=True))
        g["va"] = np.einsum("nt,nth->h", de, s)
        ds = de[:, :, None] * p["va"] * (1 - s * s)
        g["wa"] = np.einsum("nti,nth->ih", out, ds)
        dout = alpha[:, :, None] * dp[:, None, :] + ds @ p["wa"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            w, u = p[f"w{way}"], p[f"u{way}"]
            gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * hid, np.float32)
            dh = np.zeros((len(x), hid), np.float32)
            for i, h, r, z, c, gn in reversed(kept[way]):
                m = mask[:, i, None]
                dh = dh + dout[:, i, k * hid : (k + 1) * hid]
                on = np.where(m, dh, 0)
                dn = on * (1 - z) * (1 - c * c)
                dz = on * (h - c) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                into, back = np.concatenate([dr, dz, dn], 1), np.concatenate([dr, dz, dn * r], 1)
                gu += h.T @ back
                gw += x[:, i].T @ into
                gc += into.sum(0)
                dx[:, i] += into @ w.T
                dh = on * z + back @ u.T + np.where(m, 0, dh)
            g |= {f"w{way}": gw, f"u{way}": gu, f"c{way}": gc}
        return g, dx


def window_starts(n: int) -> list[int]:
    """Where the windows of n words begin: every STRIDE words until one reaches the end."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n > WINDOW else [0]


class Scorer:
    """Scores texts with a trained network. Each word's contribution to both ways' gates is worked out once while the table has room."""

    def __init__(self, weights: dict, tables: tuple, odds: LogOdds):
        self.p, self.tables, self.odds = weights, tables, odds
        self.index: dict[str, int] = {}
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)
        self.used = 1

    def gates_of(self, x: np.ndarray, out: np.ndarray) -> None:
        for k, way in enumerate("fb"):
            np.matmul(x, self.p[f"w{way}"], out=out[k])
            out[k] += self.p[f"c{way}"]
            out[k, :, : 2 * HIDDEN] *= 0.5  # the sigmoid of x is half of tanh(x / 2), and a half

    def learn(self, words: list[str]) -> None:
        need = self.used + len(words)
        if need > self.gates.shape[1]:
            grown = np.zeros((2, max(need, min(2 * self.gates.shape[1], CACHE_WORDS)), 3 * HIDDEN), np.float32)
            grown[:, : self.used] = self.gates[:, : self.used]
            self.gates = grown
        self.gates[:, 0, HIDDEN : 2 * HIDDEN] = 30  # padding: the update gate keeps the state
        for part in in_turn(words):
            self.gates_of(features(part, self.odds, self.tables), self.gates[:, self.used : self.used + len(part)])
            self.index.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def indexed(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list({w for t in texts for w in t} - self.index.keys())
        if new and self.used + len(new) > CACHE_WORDS:
            self.index, self.used, self.gates = {}, 1, self.gates[:, :1024].copy()
            new = list({w for t in texts for w in t})
        if new:
            self.learn(new)
        return [np.fromiter(map(self.index.__getitem__, t), np.int32, len(t)) for t in texts]

    def windows(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All windows of all texts as rows of word numbers (0: none), and each row's text."""
        rows, owner = [], []
        for k, x in enumerate(ids):
            if len(x):
                starts = window_starts(len(x))
                x = np.concatenate([x, np.zeros(starts[-1] + WINDOW - len(x), np.int32)]) if starts[-1] + WINDOW > len(x) else x
                rows.append(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[starts])
                owner.append(np.full(len(starts), k, np.int32))
        return (np.concatenate(rows), np.concatenate(owner)) if rows else (np.empty((0, WINDOW), np.int32), np.empty(0, np.int64))

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of windows."""
        p, hid, out = self.p, HIDDEN, np.empty(len(rows), np.float32)
        for at in range(0, len(rows), 2048):
            part = np.ascontiguousarray(rows[at : at + 2048].T)
            states = np.empty((WINDOW, part.shape[1], 2 * hid), np.float32)
            for k, way in enumerate("fb"):
                h, u, table = np.zeros((part.shape[1], hid), np.float32), p[f"u{way}"].copy(), self.gates[k]
                u[:, : 2 * hid] *= 0.5
                for i in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                    a = table[part[i]]
                    g = h @ u
                    rz = a[:, : 2 * hid] + g[:, : 2 * hid]
                    np.tanh(rz, out=rz)
                    rz *= 0.5
                    rz += 0.5
                    z = rz[:, hid:]
                    c = np.tanh(a[:, 2 * hid :] + rz[:, :hid] * g[:, 2 * hid :])
                    h = c + z * (h - c)
                    states[i, :, k * hid : (k + 1) * hid] = h
            e = np.where(part > 0, np.tanh(states @ p["wa"]) @ p["va"], -1e9)
            e = np.exp(e - e.max(0))
            pooled = np.einsum("tn,tnh->nh", e / e.sum(0), states)
            out[at : at + 2048] = pooled @ p["u"] + p["b"]
        return out

    def score(self, texts: list[str]) -> list[float]:
        ids = self.indexed([words_of(t) for t in texts])
        rows, owner = self.windows(ids)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, self.raw(rows).astype(np.float64))
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -700, 700)))).tolist()


class Vocabulary:
    """The words of the training texts, their buckets and their n-grams."""

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        self.parts = in_turn(list(number))
        self.hashed = np.array([word_bucket(w) for w in number], np.int32)
        made = [grams(p) for p in self.parts]
        self.flat = [f.astype(np.int32) for f, _, _ in made]
        self.cut, self.n = [c for _, c, _ in made], [n for _, _, n in made]

    def __len__(self) -> int:
        return len(self.hashed)

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        found = [np.empty(0, np.int32)]
        for w in words.tolist():
            k, i = divmod(w, AT_ONCE)
            found.append(self.flat[k][self.cut[k][i] : self.cut[k][i] + int(self.n[k][i])])
        return np.concatenate(found)

    def rows(self, of: Callable[[tuple], np.ndarray], width: int) -> np.ndarray:
        """of(at) for all words, row 0 for padding."""
        out = np.zeros((len(self) + 1, width), np.float32)
        for k, part in enumerate(self.parts):
            lo = k * AT_ONCE
            out[lo + 1 : lo + 1 + len(part)] = of((self.hashed[lo : lo + len(part)], (self.flat[k], self.cut[k], self.n[k])))
        return out

    def move(self, tables: tuple, words: np.ndarray, by: np.ndarray) -> None:
        """Adds to the n-gram embeddings of words (with repeats) a row each, shared out over the n-grams."""
        unique, where = np.unique(words, return_inverse=True)
        total = np.zeros((len(unique), EMBED), np.float32)
        np.add.at(total, where, by)
        n = np.array([self.n[k][i] for k, i in (divmod(w, AT_ONCE) for w in unique.tolist())], np.int64)
        np.add.at(tables[1], self.grams_of(unique), np.repeat(total / n[:, None], n, 0))


def folded_odds(words: Vocabulary, y: np.ndarray, fold: np.ndarray) -> tuple[list[LogOdds], LogOdds]:
    """Log-odds without each fold, and of all; counted by documents."""
    w, g, n = np.zeros((FOLDS, 2, WORDS), np.float32), np.zeros((FOLDS, 2, GRAMS), np.float32), np.zeros((FOLDS, 2))
    for k, mark, x in zip(fold, y, words.docs, strict=True):
        u = np.unique(x)
        n[k, mark] += 1
        w[k, mark, np.unique(words.hashed[u])] += 1
        g[k, mark, np.unique(words.grams_of(u))] += 1
    return [LogOdds(w.sum(0) - w[k], g.sum(0) - g[k], n.sum(0) - n[k]) for k in range(FOLDS)], LogOdds(w.sum(0), g.sum(0), n.sum(0))


class Descent:
    """Adam steps for the network's weights; plain steps for the embeddings."""

    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def __call__(self, g: dict, rate: float) -> None:
        self.step += 1
        for name, grad in g.items():
            m, v = self.moments[name]
            grad = grad + 1e-4 * self.net.p[name]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            self.net.p[name] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def window_values(net: Network, shared: np.ndarray, own: list[np.ndarray], rows: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Scores of all training windows, each without its own fold's log-odds."""
    value = np.zeros(len(rows), np.float32)
    part = Scorer(net.p, net.tables, None)
    part.gates = np.empty((2, len(shared), 3 * HIDDEN), np.float32)
    for k, table in enumerate(own):
        mine = np.flatnonzero(fold == k)
        part.gates_of(np.concatenate([shared, table], 1), part.gates)
        part.gates[:, 0] = 0
        part.gates[:, 0, HIDDEN : 2 * HIDDEN] = 30
        value[mine] = part.raw(rows[mine])
    return value


def train(texts: Iterable[str], marks: list[int]) -> Scorer | float:
    """A scorer fitted to labelled texts; with one class only, the share of toxic ones."""
    y = np.array(marks, np.int64)
    if len(set(marks)) < 2:
        return float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(11)
    words = Vocabulary(texts)
    fold = rng.permutation(len(y)) % FOLDS
    held, full = folded_odds(words, y, fold)
    net = Network()
    descend = Descent(net)
    rows, owner = Scorer(net.p, net.tables, full).windows([x + 1 for x in words.docs])
    used = np.unique(owner)
    weight = np.minimum(np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 1.0), 3.0).astype(np.float32)
    top = np.empty(0, np.int64)
    own = [words.rows(lambda at, o=o: rated(at, o), INPUT - 2 * EMBED) for o in held]
    for epoch in range(EPOCHS):
        shared = words.rows(lambda at: embedded(at, net.tables), 2 * EMBED)
        if epoch in LOOK_AT:
            if epoch == 0:  # before anything is learned: the window with the largest log-odds
                value = np.zeros(len(rows), np.float32)
                for at in range(0, len(rows), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    for k, table in enumerate(own):
                        mine = fold[owner[part]] == k
                        value[part][mine] = np.maximum(table[rows[part][mine], 1], 0).sum(1)
            else:
                value = window_values(net, shared, own, rows, fold[owner])
            order = np.lexsort((value, owner))
            top = order[np.flatnonzero(np.diff(np.r_[owner[order], -1]))]
        rate = RATE * (1 - epoch / EPOCHS) + 0.001
        for at in np.array_split(rng.permutation(len(used)), max(1, len(used) // BATCH)):
            r, docs_at = rows[top[at]], owner[top[at]]
            x = np.concatenate([shared[r], np.stack([own[fold[d]][row] for d, row in zip(docs_at, r, strict=True)])], 2)
            score, kept = net.run(x, r > 0)
            dy = ((sigmoid(score) - y[docs_at]) * weight[docs_at] / len(at)).astype(np.float32)
            g, dx = net.gradients(kept, dy)
            descend(g, rate)
            at_word = r[r > 0] - 1
            dxs = dx[r > 0]
            np.add.at(net.tables[0], words.hashed[at_word], -rate * 5 * dxs[:, :EMBED])
            if epoch % 3 == 1:
                words.move(net.tables, at_word, -rate * 5 * dxs[:, EMBED : 2 * EMBED])
    return Scorer(net.p, net.tables, full)


def held_out(doc_id) -> object:
    """Whether crc32 of the id's text leaves no remainder by 5; such rows never train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chosen_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that train: not held out, bounded in number and in total length, each whole."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda mark, n: marks.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, SAMPLE_TOXIC).union(first(0, SAMPLE_OTHER))  # at most 3,600 rows of 12 bytes
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), "toxic")
    sizes = found.groupBy("doc_id", "toxic").agg(F.max(F.length("text")).alias("size")).withColumn("short", F.col("size") <= SAMPLE_LONGEST)
    of_class = Window.partitionBy("toxic")
    so_far = F.sum(F.when(F.col("short"), F.col("size")).otherwise(0)).over(of_class.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    alone = ~F.max("short").over(of_class) & (F.row_number().over(of_class.orderBy("size", "doc_id")) == 1)
    fits = sizes.withColumns({"so_far": so_far, "alone": alone}).where((F.col("short") & (F.col("so_far") <= SAMPLE_TEXT)) | F.col("alone"))
    return found.join(F.broadcast(fits.select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | float:
    """Trains on a bounded sample of labelled rows that are not held out, in one task; only the weights reach the driver."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        marks = [r[2] for r in rows]
        rows.reverse()
        made = train((rows.pop()[1] for _ in marks), marks)  # a text is let go once it is read
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(made if isinstance(made, float) else (made.p, made.tables, made.odds))], pa.binary())],
            names=["model"],
        )

    found = chosen_rows(docs, labels).repartition(1).mapInArrow(run, "model binary").collect()  # weights of a fixed size; an empty sample has no task
    made = pickle.loads(found[0].model) if found else 0.0
    return made if isinstance(made, float) else Scorer(*made)


def drop_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df, all columns, without the documents that toxicity_scores predicts toxic; texts are scored where they are, without a shuffle.

    Null and empty texts, and null ids, stay (empty ones score 0); repeated rows go or stay together. Columns of any name pass.
    """
    scorer = fit(df.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    if isinstance(scorer, float):
        return df if scorer < 0.5 else df.limit(0)
    held = df.sparkSession.sparkContext.broadcast((scorer.p, scorer.tables, scorer.odds))
    place = df.columns.index("text")

    def run(batches):
        with task_memory():
            own = Scorer(*held.value)
            for batch in batches:
                for part in pieces(batch):
                    score = own.score([t or "" for t in part.column(place).to_pylist()])
                    yield part.filter(pa.array([x < 0.5 for x in score], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def toxicity_scores(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) of every whole text.

    Null and empty texts, and texts without letters or digits, score 0. Repeated rows and null ids are scored like others (a
    null id is not held out). With labels of one class only, every score is the share of toxic ones. Other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer = fit(docs, labels.select("doc_id", "toxic"))
    if isinstance(scorer, float):
        scored = docs.select("doc_id", F.lit(scorer).alias("score"))
    else:
        held = df.sparkSession.sparkContext.broadcast((scorer.p, scorer.tables, scorer.odds))
        scored = map_columns(
            docs,
            lambda s, ids, texts: [ids, s.score([t or "" for t in texts])],
            "doc_id long, score double",
            lambda: Scorer(*held.value),
        )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
