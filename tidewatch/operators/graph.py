"""Connected components over a bipartite link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import kept, release
from .ranges import join_counted


def _star(edges: DataFrame, both: DataFrame) -> DataFrame:
    """edges (a > b), each end b of a node's neighbours replaced by the least of them; both is what the neighbours are taken from."""
    least = kept(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_counted(edges, least, ["a"], F.col("b")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
    return join_counted(both.where("b > a"), least, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars: every node that has a smaller neighbour has one only, and that one has none."""
    ends = edges.select("a", F.lit(1).alias("n"), F.lit(0).alias("p")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("n"), F.lit(1).alias("p")))
    return ends.groupBy("a").agg(F.sum("n").alias("n"), F.max("p").alias("p")).where("n > 1 OR (n = 1 AND p = 1)").isEmpty()


def link_components(links: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """left, component: the smallest left value that is reachable over shared right values; links need not be distinct.

    Each right value becomes a star around its smallest left value. Then rounds of a large star and a small star step replace every
    neighbourhood by a star around its least node, until nothing changes: their number grows with the logarithm of a chain's length.
    A value that a third of all links share is a hub, whose links are dealt over many tasks (ranges.join_counted). Every step is
    written to the shared folder, and the tables of the round before are deleted. Stars that have not settled after most_rounds are
    an error. Links with a null on either side are ignored. Repeated links go with the edges they make, so links are not exchanged for that;
    a right value of one link makes no edge. Once edges are fewer than nodes, rounds end as soon as they are stars, without a round that
    changes nothing.
    """
    links = kept(links.select(F.col(left).alias("a"), F.col(right).alias("r")).where("a IS NOT NULL AND r IS NOT NULL"))
    every = kept(links.select("a").distinct())
    nodes = every.count()
    hubs = kept(links.groupBy("r").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1"))
    now = kept(join_counted(links, hubs, ["r"], F.col("a")).where("a != b").select("a", "b").distinct())
    mark = None
    for _ in range(most_rounds):
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).head()
        if (new.n, new.s) == mark or not new.n or (new.n < nodes and _settled(now)):
            break
        mark = (new.n, new.s)
        wide = kept(_large_star(now))
        small = kept(_star(wide, wide))
        release(now, wide)
        now = small
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return every.join(now, "a", "left").select(F.col("a").alias(left), F.coalesce("b", "a").alias("component"))


def component_evidence(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finding_id, component of every finding; component, audit_id of every cited event): findings that share an audit id are linked."""
    cited = findings.select("finding_id", F.explode("evidence").alias("e")).select("finding_id", F.col("e.audit_id").alias("audit_id"))
    linked = link_components(cited, "finding_id", "audit_id")
    labels = findings.select("finding_id").join(linked, "finding_id", "left").select(
        "finding_id",
        F.coalesce("component", "finding_id").alias("component"),
    )
    return labels, cited.join(labels, "finding_id").select("component", "audit_id").distinct()


def finding_components(findings: DataFrame) -> DataFrame:
    """Groups of findings that share an audit id: component, members, representative, tactics and number of audit ids.

    The representative has the highest confidence x 100 + evidence, ties to the smallest id. Members and audit ids stay rows
    (component_evidence), since one group may hold most of a case; the tactics are a short list by nature.
    """
    labels, cited = component_evidence(findings)
    score = F.coalesce(F.col("confidence"), F.lit(0.0)) * 100 + F.size("evidence")
    rows = findings.select("finding_id", "tactics", score.alias("score")).join(labels, "finding_id")
    best = F.min_by("finding_id", F.struct(-F.col("score"), F.col("finding_id"))).alias("representative")
    groups = rows.groupBy("component").agg(F.count("*").alias("members"), best)
    tactics = rows.select("component", F.explode("tactics").alias("t")).distinct().groupBy("component").agg(F.array_sort(F.collect_list("t")).alias("tactics"))
    ids = cited.groupBy("component").agg(F.count("*").alias("n_audit_ids"))
    return groups.join(tactics, "component", "left").join(ids, "component", "left").fillna(0, ["n_audit_ids"])
