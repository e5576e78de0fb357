"""Whole jobs of queries that did less, and plans of steps that grew too fast."""

from tidewatch.plans import more
from tidewatch.plans import queries as plans


def test_intrusion_path_numbers_every_cluster(spark, data):
    every = {(r.case_id, r.cluster_id) for r in more.full_clusters(spark, data).select("case_id", "cluster_id").collect()}
    steps = plans.QUERIES["intrusion_path"](spark, data).collect()
    assert {(r.case_id, r.cluster_id) for r in steps} == every
    for case in {c for c, _ in every}:
        assert sorted(r.step for r in steps if r.case_id == case) == list(range(1, sum(c == case for c, _ in every) + 1))


def mentions(df, what):
    """How often the optimized plan names an expression."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_payloads_are_parsed_once_a_row(spark, data):
    assert mentions(plans.QUERIES["rare_images"](spark, data), "get_json_object") == 0  # counted and joined as written
    assert mentions(plans.QUERIES["tactic_events"](spark, data), "get_json_object") <= 2  # once for the total, once for the page


def test_finding_iocs_read_the_texts_once(spark, data):
    assert mentions(plans.QUERIES["finding_iocs"](spark, data), "Relation") == 1


def test_clusters_hold_no_array_of_evidence(spark, data):
    assert mentions(plans.dated_findings(spark, data), "collect_list") == 0
    assert mentions(plans.QUERIES["timeline_clusters"](spark, data), "to_json") == 0


def test_ungrounded_mentions_scan_the_texts_once(spark):
    from tidewatch.operators import checks

    prose = spark.createDataFrame([("a", 1, "Mimikatz and a Web Shell"), ("b", 2, "WEBSHELL"), ("b", 3, None), (None, 4, "mimikatz")], "case_id string, doc_id long, text string")
    f = spark.createDataFrame([("a", "mimikatz", "R", "sigma", [])], f"case_id string, title string, rule_id string, source string, evidence {checks_evidence()}")
    confirmed = spark.createDataFrame([("b", "T1190"), ("b", "T1")], "case_id string, technique string")
    out = checks.ungrounded_mentions(prose, f, confirmed)
    assert {tuple(r) for r in out.select("case_id", "doc_id", "label").collect()} == {("a", 1, "Web shell"), (None, 4, "Mimikatz")}
    assert mentions(out, "Generate explode") <= 3  # of texts, findings and the list of claims


def checks_evidence():
    from tidewatch.model import EVIDENCE

    return EVIDENCE


def test_components_of_stars_need_no_further_round(spark):
    from tidewatch.operators import graph

    links = [(a, f"r{a % 3}") for a in range(1, 40)] * 2 + [(50, "own")]
    out = graph.link_components(spark.createDataFrame(links, "l long, r string"), "l", "r", most_rounds=1)  # an error before
    assert {r.l: r.component for r in out.collect()} == {a: (a % 3 or 3) for a in range(1, 40)} | {50: 50}
