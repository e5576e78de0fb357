"""Embedding near-duplicates: an exact metric range join by pivots.

The metric is the angle between vectors, so cosine >= c means an angle of at most r = arccos(c). Vectors of one label go to
their nearest pivot (their home cell). The triangle inequality decides where a vector must also be seen: cell j with pivot p
and radius R (its farthest home vector) can hold a partner of y only if angle(y, p) <= R + r; and as the cell lies on its
own side of the bisecting great circle between p and y's home pivot h, only if cos(y, h) - cos(y, p) <= sin(r) |p - h|.
A home vector thus meets all its partners in its own cell, where its links are counted; cells are joined independently,
in blocks of bounded size. Equal vectors of one label form one class beforehand and are counted by their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import top_rows
from .common import cut, join_facts
from .components import components

#: Pivots of a label: one for so many of its vectors and at least LEAST_PIVOTS, as far as MOST_PIVOTS in all go (the only data
#: that is broadcast: 64 x 8 x 4096 bytes, 2 MB). A label without pivots is one cell; cells of any size are joined in blocks.
CELL, LEAST_PIVOTS, MOST_PIVOTS = 4096, 4, 4096
#: Cosines to pivots that a task works out at once.
AT_ONCE = 1 << 20
#: Rows of a cell that one task holds at once: home vectors and others.
HOME_BLOCK, OTHER_BLOCK = 4096, 16384


def usable_rows() -> Column:
    """Whether a row has an id, a label, and a finite vector that is not zero; never null."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    return F.coalesce(held & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))


def vector_classes(df: DataFrame) -> DataFrame:
    """rep (smallest vec_id), mult, label, embedding of each distinct usable vector of a label."""
    return df.where(usable_rows()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pivots(classes: DataFrame) -> dict:
    """(label, dimension) -> unit pivots: the vectors with the smallest hashes of their ids, a number that follows each label's size."""
    order = [F.xxhash64("rep").asc(), F.col("rep").asc()]
    kinds = classes.withColumn("dim", F.size("embedding"))
    sizes = kinds.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(MOST_PIVOTS // LEAST_PIVOTS)
    sizes = sizes.withColumn("want", F.greatest(F.lit(LEAST_PIVOTS), F.ceil(F.col("n") / CELL)))
    most = sizes.agg(F.sum("want")).head()[0] or 1
    share = F.greatest(F.lit(1), F.floor(F.col("want") * F.lit(min(1.0, MOST_PIVOTS / most)))).cast("int")
    nth = top_rows(kinds.select("label", "dim", "rep"), ["label", "dim"], order, MOST_PIVOTS, "nth", F.col("rep"))  # no label's rows meet in one task
    chosen = nth.join(F.broadcast(sizes.select("label", "dim", share.alias("want"))), ["label", "dim"]).where("nth <= want")
    rows = kinds.join(F.broadcast(chosen.select("rep")), "rep", "left_semi").orderBy("label", "dim", F.xxhash64("rep"), "rep").collect()  # at most MOST_PIVOTS
    out: dict = {}
    for r in rows:
        out.setdefault((r.label, r.dim), []).append(r.embedding)
    return {k: unit(np.array(v)) for k, v in out.items()}


def _parts(batches, held):
    """(label, dim, rows, their pivots or None) of each label, in slices whose cosines to all pivots fit."""
    for pdf in batches:
        for (label, dim), part in pdf.groupby(["label", "dim"]):
            p = held.value.get((label, dim))
            step = max(1, AT_ONCE // (1 if p is None else len(p)))
            for at in range(0, len(part), step):
                yield label, dim, part[at : at + step], p


def _placed(batches, held):
    """Home cells: rep, mult, label, dim, cell, unit vector (bytes), cosine to the home pivot."""
    for label, dim, part, p in _parts((pdf.assign(dim=pdf["embedding"].map(len)) for pdf in batches), held):
        x = unit(np.stack(part["embedding"].to_numpy()))
        cos = x @ p.T if p is not None else np.ones((len(x), 1))
        home = cos.argmax(1)
        yield pd.DataFrame(
            {
                "rep": part["rep"],
                "mult": part["mult"],
                "label": label,
                "dim": dim,
                "cell": home,
                "cos": cos[np.arange(len(x)), home],
                "v": [r.tobytes() for r in x],
            },
        )


def meeting_cells(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, reach: np.ndarray, r: float) -> np.ndarray:
    """For each vector, the cells that may hold a partner of it within the angle r; reach: the radius of each cell."""
    cos = np.clip(x @ pivots.T, -1, 1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(pivots @ pivots.T, -1, 1)))[home]
    own = np.arange(len(x))
    meets = (np.arccos(cos) <= reach + r + 1e-7) & (cos[own, home][:, None] - cos <= math.sin(r) * apart + 1e-7)
    meets[own, home] = True
    return meets


def _seen(batches, held, radii, r):
    """Each vector once for every cell that may hold a partner of it."""
    for label, dim, part, p in _parts(batches, held):
        x = np.frombuffer(b"".join(part["v"]), np.float64).reshape(-1, dim)
        home = part["cell"].to_numpy()
        if p is None:
            meets = np.ones((len(x), 1), bool)
        else:
            meets = meeting_cells(x, home, p, np.array([radii.value.get((label, dim, j), -np.inf) for j in range(len(p))]), r)
        row, cell = np.nonzero(meets)
        yield pd.DataFrame(
            {
                "rep": part["rep"].to_numpy()[row],
                "mult": part["mult"].to_numpy()[row],
                "label": label,
                "dim": dim,
                "cell": cell,
                "home": home[row] == cell,
                "v": part["v"].to_numpy()[row],
            },
        )


def _linked(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the home block's vectors with the block of others: counts for the former, and edges to the smallest linked id."""
    dim = int(pdf["dim"].iloc[0]) if len(pdf) else 1
    left, right = pdf[pdf["as_home"]], pdf[~pdf["as_home"]]
    a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
    x, y = (np.frombuffer(b"".join(t["v"]), np.float64).reshape(-1, dim) for t in (left, right))
    mult = right["mult"].to_numpy()
    links = np.zeros(len(a), np.int64)
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s in range(0, len(a), 512):
        close = x[s : s + 512] @ y.T >= least
        close &= a[s : s + 512, None] != b[None, :]
        links[s : s + 512] = close @ mult
        for i in np.flatnonzero(close.any(1)):
            roots = {root(int(a[s + i])), *map(root, np.unique(b[close[i]]).tolist())}
            top = min(roots)
            for t in roots:
                parent[t] = top
    edges = [(i, root(i)) for i in list(parent)]
    return pd.DataFrame(
        {
            "rep": np.r_[a, np.array([i for i, _ in edges], np.int64)],
            "links": np.r_[links, np.zeros(len(edges), np.int64)],
            "top": np.r_[a, np.array([t for _, t in edges], np.int64)],
        },
    )


def near_vectors(df: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: vectors of one label with cosine >= least (in double precision) link.

    Null labels, null vectors, vectors that are zero or hold null or non-finite components, and null ids link with nothing
    and are their own component. Only vectors of equal length are compared. Equal vectors link with each other. Rows that
    share a vec_id count as separate vectors with one component. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = usable_rows()
    classes = cut(vector_classes(rows))
    held = spark.sparkContext.broadcast(_pivots(classes))
    label_type = classes.schema["label"].dataType.simpleString()
    at = f"label {label_type}, dim int, cell int"
    r = math.acos(least)
    homes = cut(
        classes.select("rep", "mult", "label", "embedding").mapInPandas(
            lambda b: _placed(b, held),
            f"rep long, mult long, {at}, cos double, v binary",
        ),
    )
    cells = homes.groupBy("label", "dim", "cell").agg(
        F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.min("cos")))).alias("wide"),
    ).where("cell >= 0")
    piloted = spark.createDataFrame(list(held.value) or [(None, None)], f"label {label_type}, dim int")
    radii = spark.sparkContext.broadcast({(c.label, c.dim, c.cell): c.wide for c in cells.join(F.broadcast(piloted), ["label", "dim"], "left_semi").collect()})  # at most MOST_PIVOTS rows
    seen = cut(homes.mapInPandas(lambda b: _seen(b, held, radii, r), f"rep long, mult long, {at}, home boolean, v binary"))
    sizes = seen.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count_if("home") / HOME_BLOCK).cast("int").alias("n_home"),
        F.ceil(F.count("*") / OTHER_BLOCK).cast("int").alias("n_other"),
    )
    spread = seen.join(sizes, ["label", "dim", "cell"])
    block = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    own = spread.where("home").select(
        "rep",
        "mult",
        "label",
        "dim",
        "cell",
        "v",
        F.lit(True).alias("as_home"),
        block(F.col("n_home"), 1).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("j"),
    )
    other = spread.where("n_home > 0").select(
        "rep",
        "mult",
        "label",
        "dim",
        "cell",
        "v",
        F.lit(False).alias("as_home"),
        F.explode(F.sequence(F.lit(0), F.col("n_home") - 1)).alias("i"),
        block(F.col("n_other"), 2).alias("j"),
    )
    pairs = own.union(other).groupBy("label", "dim", "cell", "i", "j")
    found = cut(pairs.applyInPandas(lambda pdf: _linked(pdf, least), "rep long, links long, top long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tops = components(
        found.where("rep != top").select(F.col("rep").alias("a"), F.col("top").alias("b")),
    ).withColumnsRenamed({"node": "rep", "component": "top"})
    n_links = (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    placed = cut(
        classes.join(links, "rep", "left").join(tops, "rep", "left").select(
            "label",
            "embedding",
            n_links,
            F.coalesce("top", "rep").alias("component_id"),
            F.col("mult").alias("n"),
        ),
    )
    found = join_facts(rows.where(usable), placed, ["label", "embedding"], F.col("vec_id")).select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
    )
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
