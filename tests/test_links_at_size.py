"""Links behind confirmed signals: which ones are told, and that a record's tier is worked out once."""

from sieveworks import catalog, queries_runs  # noqa: F401 (registers its queries)
from sieveworks.operators import views

SMALL = "/root/testdata/sf0.001"


def test_evidence_links_on_odd_records(spark):
    rows = [
        ("1", "Bullseye", [("a", "yes", "u"), ("b", "no", "u"), ("c", "yes", ""), ("d", "yes", None), ("e", None, "u"), (None, "yes", "v")]),
        ("2", "Contender", [("a", "yes", "u"), ("a", "yes", "u")]), ("3", "Excluded", [("a", "yes", "u")]), ("4", None, [("a", "yes", "u")]), ("5", "Bullseye", None), ("6", "Bullseye", []), (None, "Contender", [("a", "yes", "w")]),
    ]
    frame = spark.createDataFrame(rows, "id string, displayed_tier string, signals array<struct<signal_id:string,signal_state:string,source_url:string>>")
    want = [("1", "a", "u"), ("1", None, "v"), ("2", "a", "u"), ("2", "a", "u"), (None, "a", "w")]
    assert sorted(map(tuple, views.evidence_links(frame).collect()), key=str) == sorted(want, key=str)


def test_link_occurrences_scores_records_once_and_shuffles_no_links(spark):
    plan = catalog.QUERIES["link_occurrences"](spark, SMALL)._jdf.queryExecution().executedPlan()
    conditions, scores, joins = [], 0, []
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.nodeName()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.length())] + ([node.inputPlan()] if kind == "AdaptiveSparkPlan" else [])
        text = " ".join(node.expressions().apply(i).toString() for i in range(node.expressions().length()))
        scores += text.count("aggregate(")
        joins += [kind] if "Join" in kind and "url#" in text else []
        conditions += [text] if kind == "Filter" or "Join" in kind else []
    assert not any("aggregate(" in c or "transform(" in c for c in conditions)
    assert scores == 1 and joins == ["BroadcastHashJoin"]
