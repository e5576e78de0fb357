"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# The three base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN_LEAST = 16
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
SIZE = len(SYMBOLS)
CODE = np.full(128, SIZE, np.int64)
CODE[[ord(c) for c in SYMBOLS]] = np.arange(SIZE)

#: A stretch counts as a secret from this log-likelihood ratio, in nats, in all and for each character.
RATIO_LEAST, RATIO_EACH = 12.0, 0.5
#: Training documents at most (the first by hash of doc_id), and strings of each alphabet that the generator adds.
SAMPLE_DOCS, MADE_EACH = 4_000, 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by start, then kind: leftmost matches of each kind that do not overlap."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if max(map(len, text.split()), default=0) >= 20:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def codes(run: str) -> np.ndarray:
    return CODE[np.frombuffer(run.encode(), np.uint8)]


def steps_of(run: str, table: np.ndarray) -> np.ndarray:
    """For each character, its log-likelihood in a random string less that in an identifier, given the one before (at first: the start)."""
    c = codes(run)
    return np.r_[table[SIZE, c[0]], table[c[:-1], c[1:]]]


def best_stretch(gain: np.ndarray) -> tuple[float, int, int]:
    """Sum, start and end of the stretch of RUN_LEAST characters or more with the largest sum; of equal ones the first to end."""
    total = np.r_[0.0, np.cumsum(gain)]
    ends = total[RUN_LEAST:]
    lowest = np.minimum.accumulate(total[: len(ends)])
    end = int(np.argmax(ends - lowest))
    start = int(np.argmin(total[: end + 1]))
    return float(ends[end] - lowest[end]), start, end + RUN_LEAST


def random_stretches(run: str, table: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a run that look random: the best one, widened to whole letters and digits, then those of what is left."""
    if len(run) < RUN_LEAST:
        return []
    sum_, s, e = best_stretch(steps_of(run, table))
    if sum_ < RATIO_LEAST or sum_ < RATIO_EACH * (e - s):
        return []
    while s and run[s - 1].isalnum():
        s -= 1
    while e < len(run) and run[e].isalnum():
        e += 1
    return [*random_stretches(run[:s], table), (s, e), *[(e + a, e + b) for a, b in random_stretches(run[e:], table)]]


def all_spans(text: str, table: np.ndarray) -> tuple[list, list]:
    base = base_spans(text)
    more = []
    if max(map(len, text.split()), default=0) >= RUN_LEAST:
        for m in RUN.finditer(text):
            at = m.start()
            for s, e in [*((s, e) for s, _, e in base if s < m.end() and m.start() < e), (m.end(), m.end())]:  # what lies beside base spans
                if s > at:
                    more += [(at + a, 3, at + b) for a, b in random_stretches(text[at:s], table)]
                at = max(at, e)
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def made_strings() -> list[str]:
    """Labelled random strings, so that alphabets which the documents lack are known: hexadecimal, letters and digits, base 64."""
    rng = random.Random(7)
    alphabets = (
        string.hexdigits[:16],
        string.ascii_uppercase + string.digits,
        string.ascii_letters + string.digits,
        string.ascii_letters + string.digits + "+/",
        string.ascii_letters + string.digits + "-_",
    )
    return ["".join(rng.choices(a, k=rng.randint(20, 44))) for a in alphabets for _ in range(MADE_EACH)]


def steps(runs: list[str]) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for run in runs:
        c = [SIZE, *codes(run).tolist()]
        for pair in zip(c, c[1:], strict=False):
            out[pair] = out.get(pair, 0) + 1
    return out


def joined_words(words: list[str]) -> list[str]:
    """Labelled ordinary identifiers that texts may lack: each three words in turn, joined by a sign or by capitals."""
    out = []
    for i in range(0, len(words) - 2, 3):
        three = words[i : i + 3]
        sign = "_-/=+"[i // 3 % 5]
        out.append("".join([three[0], *[w.capitalize() for w in three[1:]]]) if sign == "+" else sign.join(three))
    return out


def train(df: DataFrame) -> np.ndarray:
    """Log-probability ratios of each step, from a bounded sample of documents.

    Labels: values of base matches are random strings, runs outside base matches are ordinary. Generated random strings
    are added to the former, and identifiers joined of the documents' own words to the latter. Step counts are summed by Spark; at most 2 x 70 x 70 rows reach the driver.
    """
    ids = df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = df.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def run(texts: list) -> list:
        secret, plain = [], []
        for text in texts:
            text = text or ""
            spans = base_spans(text)
            secret += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 12 and RUN.fullmatch(m[2])] + [text[s:e] for s, k, e in spans if k]
            at = 0
            for s, _, e in [*spans, (len(text), 0, len(text))]:
                plain += WORD.findall(text[at:s]) if at < s else []
                at = max(at, e)
        rows = [(k, a, b, n) for k, runs in enumerate((plain + joined_words(plain), secret)) for (a, b), n in steps(runs).items()]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

    counted = map_columns(
        sample.select("text"),
        run,
        "secret int, a int, b int, n long",
    ).groupBy("secret", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.full((2, SIZE + 1, SIZE), 0.5)
    for r in counted:
        counts[r.secret, r.a, r.b] += r.n
    for (a, b), n in steps(made_strings()).items():
        counts[1, a, b] += n
    chance = np.log(counts / counts.sum(2, keepdims=True))
    return chance[1] - chance[0]


def scan_secrets(df: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """Spans of secrets in every whole text, as code points with exclusive ends.

    Base spans come from fixed patterns, leftmost and without overlap within a kind. A further span (kind markov) is a stretch
    of at least 16 characters of a run of [A-Za-z0-9+/_=-], beside base spans, whose likelihood under the model of random
    strings exceeds that under the model of identifiers by RATIO_LEAST in all and RATIO_EACH a character; it is the stretch
    of the run where this is largest, widened to whole letters and digits, then those in what is left on both sides. Null and
    empty texts have none. Rows are judged one by one: repeated rows and null ids pass; other columns, of any name, are
    ignored; an empty table gives no rows.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = train(rows) if table is None else table

    def run(ids: list, texts: list) -> list:
        out = []
        for doc_id, text in zip(ids, texts, strict=True):
            base, spans = all_spans(text or "", table)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            out.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(6)]

    return map_columns(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
