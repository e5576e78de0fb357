"""Mixing sources to target weights with soft domain membership. DataFrame functions only.

Domains are the four combinations of the label table's quality and toxic marks. Two naive Bayes classifiers over hashed
words, fitted on labelled documents, give each document its posterior over the domains; a document of n words adds
n x posterior x rate expected tokens to each. Rates start at 1 and are fitted by projected gradient least squares, so that the
expected domain totals equal stated shares of all tokens. The gradient of every document follows from one number a domain,
and the projection onto rates >= 0 is taken of the sum of all steps so far: the state is one number a domain, rates are a
column expression of it, and one aggregation a round is all that is gathered. Targets that no nonnegative rates meet get the
closest rates, and the column ``miss`` says by how much they fail.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Domains in the order of all arrays: (quality, toxic).
DOMAINS = ("low_clean", "low_toxic", "high_clean", "high_toxic")
#: Default targets: each domain's share of the expected tokens.
TARGETS = {"low_clean": 0.1, "low_toxic": 0.01, "high_clean": 0.85, "high_toxic": 0.04}
BUCKETS = 8192
#: Labelled documents that the classifiers are fitted on at most (the first by hash of doc_id).
SAMPLE_DOCS = 20_000
#: A document counts as at most so many words of evidence, which keeps the posteriors of long ones soft.
EVIDENCE_WORDS = 20
#: Each bucket's chance in a class is drawn to its chance in all texts by so many words.
PRIOR_WORDS = 200
#: Rounds at most, the relative miss of every domain at which they end, and the weights of the pull to rate 1, taken in turn.
MOST_ROUNDS, CLOSE, PULLS = 120, 1e-6, (1e-2, 1e-4, 1e-6, 1e-8, 1e-10)
#: Steps of projected gradient at most, and after how many the rates are written.
MOST_STEPS, KEEP_EVERY = 60, 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\s.,;:!?]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_classifiers(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[float, list[float]]]:
    """For quality and toxic: the prior log-odds of 1 and the log-odds of each word bucket (at most BUCKETS rows reach the driver)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(
        F.max("quality").alias("quality"),
        F.max("toxic").alias("toxic"),
    )
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    held = docs.join(F.broadcast(marks), "doc_id")
    n = held.agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).head()
    seen = held.select("quality", "toxic", F.explode(words(F.col("text"))).alias("w"))
    counts = seen.groupBy(bucket(F.col("w")).alias("b")).agg(
        F.count("*").alias("n"),
        F.sum("quality").alias("quality"),
        F.sum("toxic").alias("toxic"),
    ).collect()
    out = {}
    for mark in ("quality", "toxic"):
        yes, total = sum(r[mark] for r in counts), sum(r.n for r in counts)
        weights = [0.0] * BUCKETS
        for r in counts:
            pull = PRIOR_WORDS * r.n / total
            weights[r.b] = math.log((r[mark] + pull) / (yes + PRIOR_WORDS)) - math.log((r.n - r[mark] + pull) / (total - yes + PRIOR_WORDS))
        out[mark] = (math.log(((n[mark] or 0) + 1) / (n.n - (n[mark] or 0) + 1)), weights)
    return out


def posteriors(docs: DataFrame, classifiers: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, p: array of the domains' posteriors."""
    held = docs.select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.transform("w", lambda x: bucket(x) + 1).alias("b"),
    )
    least = F.greatest(F.col("n_words"), F.lit(EVIDENCE_WORDS))

    def chance(mark: str) -> Column:
        prior, weights = classifiers[mark]
        table = F.from_json(F.lit(json.dumps([round(w, 6) for w in weights])), "array<double>")
        total = F.aggregate("b", F.lit(0.0), lambda a, b: a + F.element_at(table, b))
        return F.lit(1.0) / (1 + F.exp(-(F.lit(prior) + total * EVIDENCE_WORDS / least)))

    scored = held.select("doc_id", F.col("n_words").cast("long").alias("n_words"), chance("quality").alias("q"), chance("toxic").alias("t"))
    return scored.select(
        "doc_id",
        "n_words",
        F.array((1 - F.col("q")) * (1 - F.col("t")), (1 - F.col("q")) * F.col("t"), F.col("q") * (1 - F.col("t")), F.col("q") * F.col("t")).alias("p"),
    )


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, by elimination with pivoting; a handful of domains."""
    n = len(b)
    m = [[*row, v] for row, v in zip(a, b, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i and m[i][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


def fit_rates(held: DataFrame, targets: dict[str, float]) -> DataFrame:
    """held (n_words, p, ...) with columns rate >= 0 (expected tokens of each domain come to its share of all words) and miss.

    Projected gradient for |A r - 1|^2 over the documents' rates r, A being each document's share of its domains' targets: from
    r = 1, r = max(0, r - A'z), z being the domains' misses A r - 1 in the metric of the documents with a rate above 0, so that a step
    that clips nothing new meets all targets; it is halved until the misses fall. A round is one aggregation, a dozen sums and
    products; the rates are a column of the documents and are written every few rounds.

    Where that stops short, the targets are out of reach: the rates then start from the solution of the dual (_dual_start), if that
    misses less, and plain projected gradient with the step 1 / |A A'| goes on until it gains nothing.

    miss is the largest |expected / target - 1| of a domain: at most CLOSE where the targets can be met, else what is left.
    A domain without expected tokens or without a target is left out.
    """
    k = len(DOMAINS)
    mass = held.agg(F.sum("n_words").alias("n"), *[F.sum(F.col("p")[i] * F.col("n_words")).alias(f"s{i}") for i in range(k)]).head()
    live = [i for i in range(k) if (mass[f"s{i}"] or 0) > 0 and targets.get(DOMAINS[i], 0) > 0]
    if not live:
        return held.withColumns({"rate": F.lit(1.0), "miss": F.lit(0.0)})
    share = sum(targets[DOMAINS[i]] for i in live)
    a = [F.col("p")[i] * F.col("n_words") / F.lit(targets[DOMAINS[i]] / share * mass.n) for i in live]
    places = range(len(live))

    def moved(df: DataFrame, z: list[float]) -> DataFrame:
        return df.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - sum((a[i] * F.lit(z[i]) for i in places), F.lit(0.0))))

    def look(df: DataFrame, free: Column | None = None) -> tuple[list[float], list[list[float]]]:
        """Misses of the domains, and the metric of the free documents (by default those with a rate)."""
        free = ((F.col("rate") > 0) if free is None else free).cast("double")
        got = df.agg(
            *[F.sum(a[i] * F.col("rate")).alias(f"e{i}") for i in places],
            *[F.sum(a[i] * a[j] * free).alias(f"g{i}_{j}") for i in places for j in places if i <= j],
        ).head()
        return [got[f"e{i}"] - 1 for i in places], [[got[f"g{min(i, j)}_{max(i, j)}"] for j in places] for i in places]

    off = lambda e: sum(x * x for x in e)
    now = held.withColumn("rate", F.lit(1.0))
    e, metric = look(now)
    whole = metric  # all documents have a rate at first
    scale = sum(metric[i][i] for i in places) / len(live)
    steps = slow = 0
    while max(map(abs, e)) > CLOSE and steps < MOST_STEPS and slow < 3:
        z = _solve([[metric[i][j] + 1e-12 * scale * (i == j) for j in places] for i in places], e)
        for size in (1.0, 0.5, 0.25, 0.125):
            tried = moved(now, [size * v for v in z])
            seen = look(tried)
            if off(seen[0]) < off(e):
                break
        else:
            break
        slow = slow + 1 if off(seen[0]) > 0.9 * off(e) else 0
        steps += 1
        now, (e, metric) = cut(tried) if steps % KEEP_EVERY == 0 else tried, seen
    if max(map(abs, e)) > CLOSE:
        y = _dual_start(held, a)
        other = moved(held.withColumn("rate", F.lit(1.0)), y)
        seen = look(other)
        if off(seen[0]) < off(e):
            now, (e, metric) = other, seen
        step = 1 / max(1e-300, _largest(whole))
        for _ in range(MOST_STEPS):
            tried = moved(now, [step * v for v in e])
            seen = look(tried)
            if off(seen[0]) >= (1 - 1e-6) * off(e):
                break
            steps += 1
            now, (e, metric) = cut(tried) if steps % KEEP_EVERY == 0 else tried, seen
    return now.withColumn("miss", F.lit(max(map(abs, e))))


def _largest(m: list[list[float]]) -> float:
    """The largest eigenvalue of a small symmetric matrix, by powers."""
    v = [1.0] * len(m)
    for _ in range(200):
        w = [sum(x * y for x, y in zip(row, v, strict=True)) for row in m]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        v = [x / norm for x in w]
    return norm


def _dual_start(held: DataFrame, a: list[Column]) -> list[float]:
    """y of the rates max(0, 1 - A'y) that miss least, for targets out of reach.

    The dual of |A r - 1|^2 + w |r - 1|^2, w being a small pull to rate 1 that is lowered in turn; y, one number a domain, is all that
    changes. A step is the dual's gradient in the metric of the documents whose rate is above 0, shortened until the dual falls.
    """
    places, k = range(len(a)), len(a)
    rate_of = lambda y: F.greatest(F.lit(0.0), F.lit(1.0) - sum((a[i] * F.lit(y[i]) for i in places), F.lit(0.0)))

    def look(y: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Misses of the domains, metric, and half the square of the rates."""
        free = (F.col("rate") > 0).cast("double")
        sums = [F.sum(a[i] * F.col("rate")).alias(f"e{i}") for i in places] + [
            F.sum(a[i] * a[j] * free).alias(f"g{i}_{j}") for i in places for j in places if i <= j
        ]
        got = held.withColumn("rate", rate_of(y)).agg(F.sum(F.col("rate") * F.col("rate")).alias("r"), *sums).head()
        return [got[f"e{i}"] - 1 for i in places], [[got[f"g{min(i, j)}_{max(i, j)}"] for j in places] for i in places], got.r / 2

    y = [0.0] * k
    e, metric, half = look(y)
    scale = sum(metric[i][i] for i in places) / k
    rounds = 1
    off = lambda e: sum(x * x for x in e)
    best, least = y, e
    for pull in (w * scale for w in PULLS):
        dual = lambda y, half: half + sum(y) + pull / 2 * sum(v * v for v in y)  # noqa: B023, E731
        while rounds < MOST_ROUNDS and max(map(abs, e)) > CLOSE:
            slope = [pull * v - x for v, x in zip(y, e, strict=True)]
            if max(map(abs, slope)) < CLOSE / 10:
                break
            step = _solve([[metric[i][j] + (pull + 1e-12 * scale) * (i == j) for j in places] for i in places], slope)
            fall = sum(g * s for g, s in zip(slope, step, strict=True))
            size, moved = 1.0, False
            while rounds < MOST_ROUNDS and size > 1e-4 and not moved:
                tried = [v - size * s for v, s in zip(y, step, strict=True)]
                seen = look(tried)
                rounds += 1
                moved = dual(tried, seen[2]) <= dual(y, half) - 1e-4 * size * fall
                size /= 4
            if not moved:
                break
            y, (e, metric, half) = tried, seen
        if off(e) >= off(least):  # out of reach, and as close as these numbers tell
            break
        best, least = y, e
    return best


def mix_rates(df: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, p_<domain>, rate (expected copies) and miss (see fit_rates; one value for all) of every document.

    targets: share of the expected tokens of each domain, TARGETS by default; they are scaled to add up to 1.
    Null and empty texts have no words and keep rate 1. Labels that are null or not 0 or 1 are ignored; a document labelled
    more than once takes the larger marks. Without labels every posterior is even. Repeated rows each get a rate. Other
    columns, of any name, are ignored. Empty tables give no rows.
    """
    docs = df.select("doc_id", "text")
    held = cut(posteriors(docs, fit_classifiers(docs, labels)))
    rated = fit_rates(held, TARGETS if targets is None else targets)
    shown = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rated.select("doc_id", "n_words", *shown, F.when(F.col("n_words") == 0, 1.0).otherwise(F.col("rate")).alias("rate"), "miss")


def draw(df: DataFrame, rates: DataFrame) -> DataFrame:
    """df with each document floor(rate + u) times, u in [0, 1) being fixed by its doc_id; rows without a doc_id stay once.

    Rows that share a doc_id are drawn alike, by the larger of their rates; documents without a rate stay once. Columns of
    any name pass through.
    """
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    per_id = rates.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rate").alias("rate")).select("doc_id", F.floor(F.col("rate") + u).cast("int").alias("copies"))
    rows = df.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    whole = rows.where("doc_id IS NOT NULL").join(per_id, "doc_id", "left")
    drawn = whole.select("row", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)))).alias("i")).select("row")
    return drawn.union(rows.where("doc_id IS NULL").select("row")).select("row.*")
