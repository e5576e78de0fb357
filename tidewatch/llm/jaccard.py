"""Exact Jaccard self-join of documents on word-shingle sets, as connected components.

Shingles are 63-bit hashes and are ordered by value. A set of n needs at least ceil(0.8 n) shingles in common with a
partner, so its first n - ceil(0.8 n) + 1 hold one of them, and a prefix longer by e holds e + 1 (extended prefix).

1. Equal sets form one class; its smallest doc_id stands for it.
2. Every class keeps a prefix that is longer by e = e(n). A shingle is rare if at most RARE prefixes hold it, else frequent.
   Two prefixes share at least min(e + 1, i) shingles, i being the least intersection that links sets of these sizes (a short
   set is its own prefix, and need have no more than i in common). A class is sparse if its prefix has less than min(e + 1, i)
   frequent shingles for any partner: with each it then shares a rare one, found in the index of single shingles. The number of rare shingles that a pair shares is bounded below too, which drops
   nearly all chance pairs before any set is fetched.
3. Pairs of dense classes (boilerplate, large groups of near copies) are found over their full sets, counted afresh, rare
   shingles first. Frequent shingles fall into classes by hash, and the index holds pairs of the same class: a prefix is
   extended until (rare ones) + sum over classes of (members - 1) exceeds what a partner may miss, so that any partner shares
   a rare shingle or two shingles of one class. Sets too small for that (10 or less) put all pairs of their frequent shingles
   into the index, so that they meet each other and the pairs of a class of larger partners.
4. Candidates are verified on whole sets. Each bucket of the dense index is led by its member of the smallest hash; all
   buckets of one leader form one group, which a document joins once however many of them it is in. First every member is held
   against its leader. Groups that still hold several components are then cut into blocks, and each pair of blocks is compared
   by one product of its members' incidence matrices; only edges that join components leave it, never all pairs. No link that
   joins components is lost.

Joins whose keys may be hot are salted (join_facts). The plan is the same at every size: nothing but hot keys is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_facts, map_columns, pieces
from .components import components
from .shingles import mix, shingle_set

RARE = 8
CLASSES = 8
#: Members of a group, and shingles of theirs, in one block.
BLOCK, BLOCK_TOKENS = 512, 1 << 18


def needed(n: int) -> int:
    return -(-4 * n // 5)


def extra(n: int) -> int:
    return (n - needed(n)) // 4 + 8


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, tokens (ascending), set_key of every document."""

    def run(ids: list, texts: list) -> list:
        sets = [shingle_set(t) for t in texts]
        return [ids, [len(s) for s in sets], sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]]

    return map_columns(docs, run, "doc_id long, n long, tokens array<long>, set_key binary")


def prefixes_of(docs: DataFrame) -> DataFrame:
    """As sets_of, with each set's extended prefix instead of the set."""

    def run(ids: list, texts: list) -> list:
        sets = [shingle_set(t) for t in texts]
        cuts = [s[: len(s) - needed(len(s)) + 1 + extra(len(s))] for s in sets]
        return [ids, [len(s) for s in sets], cuts, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]]

    return map_columns(docs, run, "doc_id long, n long, tokens array<long>, set_key binary")


def token_counts(sets: DataFrame) -> DataFrame:
    """token, c of the shingles that more than one row of sets has."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1")


def with_counts(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n, tokens (ascending) and c of the tokens that are in the table of counts; documents without such tokens drop out."""
    rows = sets.select("doc_id", F.explode("tokens").alias("token"))
    known = join_facts(rows, counts.withColumn("n", F.col("c")), ["token"], F.col("doc_id"))
    grouped = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", F.col("c").cast("int").alias("c")))).alias("x"))
    return grouped.join(sets.select("doc_id", "n"), "doc_id").select("doc_id", "n", F.col("x.token").alias("tokens"), F.col("x.c").alias("c"))


def _fits(n: Column, m: Column) -> Column:
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


def verified(pairs: DataFrame, sets: DataFrame, led: bool = False) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= 80 x union; led: very many pairs may share their b."""
    side = lambda end: sets.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("tokens").alias(f"t_{end}"))
    half = pairs.join(side("a"), "a")
    if led:
        facts = cut(side("b").join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b"))
        whole = join_facts(half, facts, ["b"], F.col("a"))
    else:
        whole = half.join(side("b"), "b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    return whole.where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * 80).select("a", "b")


def sparse_pairs(flagged: DataFrame) -> DataFrame:
    """Candidate pairs of classes that share enough rare shingles in their prefixes; flagged: doc_id, n, tokens, c."""
    frequent = F.size(F.filter("c", lambda c: c > RARE))
    dupes = F.filter(F.arrays_zip("tokens", "c"), lambda x: (x["c"] >= 2) & (x["c"] <= RARE))
    rows = flagged.select("doc_id", "n", frequent.alias("f"), F.explode(F.transform(dupes, lambda x: x["tokens"])).alias("token"))
    groups = rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n", "f"))).alias("m"))  # at most RARE members
    one = groups.select("m", F.posexplode("m").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(RARE))).alias("y")).where(_fits(F.col("x.n"), F.col("y.n")))
    shared = two.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(
        F.count("*").alias("k"),
        F.first("x.n").alias("n"),
        F.first("y.n").alias("m"),
        F.first("x.f").alias("f"),
        F.first("y.f").alias("g"),
    )
    small = F.least("n", "m")
    common = F.least(F.floor((small - F.ceil(small * 4 / 5)) / 4) + 9, F.ceil((F.col("n") + F.col("m")) * 4 / 9))
    return shared.where(F.col("k") >= common - F.least("f", "g")).select("a", "b")


def dense_signatures(flagged: DataFrame) -> DataFrame:
    """sig, doc_id, n: single rare shingles and pairs of frequent ones of a class; flagged: doc_id, n, tokens, c (over dense classes)."""

    def run(ids: list, sizes: list, tokens: list, counts: list) -> list:
        sigs, docs, ns = [], [], []
        for doc_id, n, t, c in zip(ids, sizes, tokens, counts, strict=True):
            t, c = np.asarray(t, np.int64), np.asarray(c)
            most = n - needed(n)  # what a partner may miss
            rare = t[c <= RARE][: most + 1]
            shown = c[c <= RARE][: most + 1]
            found = [rare[shown >= 2].view(np.uint64)]
            if len(rare) <= most:
                often = t[c > RARE]
                if n - CLASSES <= most:  # too small for classes to tell; all its frequent ones are paired
                    group, end = np.zeros(len(often), np.int64), len(often)
                else:
                    group = (mix(often.view(np.uint64)) % np.uint64(CLASSES)).astype(np.int64)
                    first = np.zeros(CLASSES, bool)
                    weight, end = len(rare), 0
                    for end, g in enumerate(group.tolist(), 1):  # the first of a class adds nothing, the others one each
                        weight += bool(first[g])
                        first[g] = True
                        if weight > most:
                            break
                for g in range(CLASSES):
                    x = often[:end][group[:end] == g].view(np.uint64)
                    i, j = np.triu_indices(len(x), 1)
                    found.append(mix(mix(x[i]) + x[j]))
            out = np.concatenate(found)
            sigs.append(out.view(np.int64))
            docs.append(np.full(len(out), doc_id, np.int64))
            ns.append(np.full(len(out), n, np.int64))
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return [cat(sigs), cat(docs), cat(ns)]

    return map_columns(flagged.select("doc_id", "n", "tokens", "c"), run, "sig long, doc_id long, n long")


def leader_groups(members: DataFrame) -> DataFrame:
    """lead, doc_id, n, lead_n: each document once for every leader that one of its buckets has, leaders included."""
    lead = F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.col("n").alias("lead_n"))).alias("x")
    led = members.groupBy("sig").agg(F.count("*").alias("n"), lead).where("n > 1").select("sig", "n", F.col("x.doc_id").alias("lead"), "x.lead_n")
    rows = join_facts(members.select("sig", "doc_id", F.col("n").alias("size")), cut(led), ["sig"], F.col("doc_id"))
    return rows.groupBy("lead", "doc_id").agg(F.first("size").alias("n"), F.first("lead_n").alias("lead_n"))


def joined(docs: list[int], comps: list[int], sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (a, b) between members that link and whose components were apart, as few as join them; left: compare these with the others only."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1  # a shingle of one member is in no intersection
    number = np.cumsum(often) - 1
    kept = often[token]
    token, owner = number[token[kept]], owner[kept]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        part = (token >= lo) & (token < lo + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[part], token[part] - lo] = 1
        shared += m @ m.T
    both = shared.astype(np.int64)
    linked = both * 100 >= (n[:, None] + n[None, :] - both) * 80
    comp = np.array(comps)
    linked &= comp[:, None] != comp[None, :]
    if left is not None:
        linked &= left[:, None] != left[None, :]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            i = p
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = root(comps[i]), root(comps[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((docs[i], docs[j]))
    return out


def block_edges(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a group in different components; labels: doc_id, comp of documents with links."""
    held = cut(groups.join(labels, "doc_id", "left").select("lead", "doc_id", F.coalesce("comp", "doc_id").alias("comp"), F.col("n").alias("size")))
    sizes = held.groupBy("lead").agg(
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
        F.count("*").alias("n"),
        F.sum("size").alias("tokens"),
    ).where("lo != hi")
    sizes = sizes.select("lead", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("nb"))
    placed = join_facts(held, cut(sizes), ["lead"], F.col("doc_id")).withColumn("k", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("nb")).cast("int"))
    with_sets = placed.join(sets.select("doc_id", "tokens"), "doc_id")
    item = F.struct("doc_id", "comp", "k", "tokens")
    spread = with_sets.select("lead", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"), item.alias("x"))
    places = spread.select("lead", F.least("x.k", "o").alias("i"), F.greatest("x.k", "o").alias("j"), "x")
    pairs_of_blocks = places.groupBy("lead", "i", "j").agg(F.collect_list("x").alias("x"))  # two blocks at most

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 8 << 20):
                out: list[tuple[int, int]] = []
                first, second = (part.column(c).to_numpy() for c in "ij")
                x = part.column("x").flatten()
                docs, comps, k = (x.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp", "k"))
                tokens = x.field("tokens")
                flat = tokens.flatten().to_numpy(zero_copy_only=False)
                cuts = np.r_[0, np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]
                ends = np.r_[0, np.cumsum(part.column("x").value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
                for r in range(part.num_rows):
                    at = slice(int(ends[r]), int(ends[r + 1]))
                    if len(np.unique(comps[at])) > 1:
                        own = [flat[cuts[m] : cuts[m + 1]] for m in range(at.start, at.stop)]
                        out += joined(docs[at].tolist(), comps[at].tolist(), own, None if first[r] == second[r] else k[at] == first[r])
                yield pa.RecordBatch.from_arrays([pa.array([e[k_] for e in out], pa.int64()) for k_ in (0, 1)], names=["a", "b"])

    return pairs_of_blocks.select("i", "j", "x").mapInArrow(run, "a long, b long")


def dense_edges(members: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that join all components of the dense index; members: sig, doc_id, n; edges: links known before."""
    groups = cut(leader_groups(cut(members)))
    pairs = groups.where(
        (F.col("doc_id") != F.col("lead")) & _fits(F.col("n"), F.col("lead_n")),
    ).select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    edges = cut(edges.union(verified(pairs, sets, led=True)))
    labels = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    return cut(edges.union(block_edges(groups, labels, sets)))


def shared_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that have a doc_id in common; most tables have none."""
    held = full.select("doc_id", "set_key").distinct()
    several = held.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.count("*").alias("n")).where("n > 1")
    pairs = join_facts(held, cut(several), ["doc_id"], F.col("set_key")).where("set_key != least").select("set_key", "least").distinct()
    first = pairs.join(classes.select("set_key", F.col("node").alias("a")), "set_key")
    return first.join(classes.select(F.col("set_key").alias("least"), F.col("node").alias("b")), "least").select("a", "b")


def jaccard_components(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of documents that are linked by Jaccard similarity of at least 0.8.

    The set of a document: distinct runs of five words (maximal runs without ASCII white space, A-Z in lower case); with
    fewer words all of them as one; null and empty texts have the empty set, which links with nothing. Rows with a null
    doc_id link with nothing and have a null component. Rows that share a doc_id share a component: every one of their sets is
    compared, and they are joined by an edge. Columns but doc_id and text, of any name, are ignored. An empty table gives no rows.

    Classes of equal sets are nodes with a number of their own, called doc_id within this module's joins.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = cut(prefixes_of(docs))
    full = all_rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    chosen = classes.select(F.col("rep").alias("doc_id"), "set_key", "node")
    reps = full.select("doc_id", "set_key", "n", "tokens").join(chosen, ["doc_id", "set_key"])
    reps = reps.groupBy("doc_id", "set_key").agg(*[F.first(c).alias(c) for c in ("node", "n", "tokens")])  # on the same partitioning
    reps = cut(reps.select(F.col("node").alias("doc_id"), "n", "tokens"))
    flagged = cut(with_counts(reps, cut(token_counts(reps))))
    pairs = cut(sparse_pairs(flagged))
    least = F.ceil(F.col("n") * 4 / 5)
    dense = flagged.where(
        F.size(F.filter("c", lambda c: c > RARE)) >= F.least(F.floor((least - F.ceil(least * 4 / 5)) / 4) + 9, least),
    ).select("doc_id")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), F.lit(False).alias("dense"))
    wanted = ends.union(dense.select("doc_id", F.lit(True))).groupBy(F.col("doc_id").alias("node")).agg(F.max("dense").alias("dense"))
    wanted = cut(wanted.join(chosen, "node"))
    whole = sets_of(docs.join(wanted.select("doc_id"), "doc_id", "left_semi")).join(wanted, ["doc_id", "set_key"])
    sets = cut(whole.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "dense")]).withColumnRenamed("node", "doc_id"))
    edges = cut(verified(pairs, sets))
    thick = sets.where("dense").drop("dense")
    edges = dense_edges(dense_signatures(with_counts(thick, cut(token_counts(thick)))), thick, edges)
    labels = cut(components(edges.union(shared_ids(full, classes))))
    named = labels.join(classes.select("node", "rep"), "node")
    least = cut(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    found = join_facts(labels, least, ["component"], F.col("node")).select("node", "component_id")
    placed = cut(classes.join(found, "node", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"), F.col("n")))
    linked = join_facts(full.select("doc_id", F.col("n").alias("n_shingles"), "set_key"), placed, ["set_key"], F.col("doc_id"))
    empty = all_rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").union(empty)


def keep_one(df: DataFrame) -> DataFrame:
    """df without the documents that have a smaller document in their group; rows without a doc_id stay.

    Null and empty texts stay (they link with nothing); rows that repeat the kept document's doc_id all stay. Columns of any
    name pass through.
    """
    gone = jaccard_components(df).where("component_id != doc_id").select("doc_id").distinct()
    held = df.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in df.columns])
    return held.union(df.where("doc_id IS NULL"))
