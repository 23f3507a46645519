"""Networks that grow by layers, on hand-made bundles."""

import json

from holdgraph.operators import expansion

LEI = {n: f"{n.upper():0<18}00" for n in "abcdefgh"}


def entity(sid, *ids):
    return json.dumps({"statementId": sid, "recordType": "entity", "recordDetails": {"identifiers": [{"id": i, "scheme": "XI-LEI" if len(i) == 20 else "GB-COH"} for i in ids]}})


def link(sid, subject, party, *types):
    return json.dumps({"statementId": sid, "recordType": "relationship", "recordDetails": {"subject": subject, "interestedParty": party, "interests": [{"type": t} for t in types]}})


def lines_of(spark, bundles):
    return spark.createDataFrame([(LEI.get(k, k), i, v) for k, vs in bundles.items() for i, v in enumerate(vs)], "lei string, seq int, value string")


def seeds_of(spark, *items):
    return spark.createDataFrame([(r, LEI.get(n, n), a, p) for r, n, a, p in items], "root string, lei string, anchor string, place int")


def grown(spark, bundles, depth=5, signals=(), **how):
    s = spark.createDataFrame([(LEI[n], i, v) for i, (n, v) in enumerate(signals)], "lei string, seq int, value string")
    out = expansion.expand(seeds_of(spark, ("r", "a", "root", 1)), lines_of(spark, bundles), s, depth, **how)
    return {r.statement_id: r for r in out.statements.collect()}, sorted((r.layer, r.value) for r in out.signals.collect()), {r.layer: (r.n_items, r.truncated) for r in out.layers.collect()}


def test_bundles_are_stitched_onto_the_node(spark):
    bundles = {
        "a": [entity("a1", LEI["a"], "REG1"), entity("a2", "reg1 "), entity("b1", LEI["b"]), link("l1", "a2", "b1", "shareholding"), link("l2", "a1", "b1", "boardMember"), "no json", '{"recordType": "entity"}'],
        "b": [entity("b9", LEI["b"]), entity("c1", LEI["c"].lower()), link("l3", "b9", {"describedByEntityStatement": "c1"}, "votingRights"), link("l1", "x", "y", "shareholding")],
        "c": [entity("c7", LEI["c"]), link("l4", "c7", "a1", "shareholding")],
    }
    got, signals, layers = grown(spark, bundles, signals=[("a", '{"at": "a2"}'), ("a", '{"at": "a1"}'), ("b", '{"at": "b9"}'), ("b", '{"at": "b9"}')])
    assert set(got) == {"root", "b1", "l1", "l2", "c1", "l3", "l4"}
    assert (got["l1"].subject_id, got["l1"].party_id, got["l1"].layer) == ("root", "b1", 1), "the first one stays"
    assert (got["l3"].subject_id, got["l3"].party_id) == ("b1", "c1") and got["l4"].subject_id == "c1"
    assert signals == [(1, '{"at": "root"}'), (2, '{"at": "b1"}')]
    assert layers == {1: (1, False), 2: (1, False), 3: (1, False)}


def test_offices_leave_the_frontier_open_and_owned_nodes_close_it(spark):
    bundles = {"a": [entity("a1", LEI["a"]), entity("b1", LEI["b"]), entity("c1", LEI["c"]), entity("d1"), link("l1", "a1", "b1", "shareholding"), link("l2", "b1", "c1", "votingRights"), link("l3", "c1", "d1", "boardChair")], "c": [entity("c1", LEI["c"]), entity("e1", LEI["e"])]}
    got, _, layers = grown(spark, bundles)
    assert "e1" in got and layers[2] == (1, False), "b is owned by c, c has an officer only, d has no LEI"


def test_subsidiaries_go_down(spark):
    bundles = {"a": [entity("a1", LEI["a"]), entity("b1", LEI["b"]), link("l1", "b1", "a1", "shareholding")], "b": [entity("b2", LEI["b"]), entity("c1", LEI["c"]), link("l2", "c1", "b2", "shareholding")], "c": [entity("c5", LEI["c"])]}
    got, _, layers = grown(spark, bundles, direction="subsidiaries")
    assert (got["l2"].subject_id, got["l2"].party_id) == ("c1", "b1") and sorted(layers) == [1, 2, 3]
    up, _, _ = grown(spark, bundles)
    assert set(up) == {"root", "b1", "l1"}, "upwards b is owned already"


def test_a_layer_takes_its_first_items_and_says_so(spark):
    bundles = {"a": [entity("a1", LEI["a"]), *(entity(f"{n}1", LEI[n]) for n in "bcde")], **{n: [entity(f"{n}2", LEI[n]), entity(f"deep-{n}", "none")] for n in "bcde"}}
    got, _, layers = grown(spark, bundles, depth=3, most=2)
    assert {s for s in got if s.startswith("deep")} == {"deep-b", "deep-c", "deep-d", "deep-e"}
    assert layers == {1: (1, False), 2: (2, True), 3: (2, False)}
    got, _, layers = grown(spark, bundles, depth=2, most=2)
    assert {s for s in got if s.startswith("deep")} == {"deep-b", "deep-c"} and layers[2] == (2, True)


def test_nothing_to_expand(spark):
    got, signals, layers = grown(spark, {"b": [entity("b1", LEI["b"])]})
    assert (got, signals, layers) == ({}, [], {1: (1, False)})
    out = expansion.expand(seeds_of(spark).where("false"), lines_of(spark, {"a": ["{}"]}), lines_of(spark, {"a": ["{}"]}), 2)
    assert out.statements.count() == out.signals.count() == out.layers.count() == 0


def test_controlling_companies(spark):
    item = lambda kind, number, country="England", ceased=None: {"kind": kind, "ceased_on": ceased, "registration_number": number, "country": country}
    corporate = "corporate-entity-person-with-significant-control"
    rows = [
        ("00000001", [item(corporate, " 00000002 "), item("Legal-Person-Control", "SC000003", "Scotland"), item("individual-person", "00000009"), item(corporate, "00000009", "France"), item(corporate, "00000009", None), item(corporate, "9"), item(corporate, "00000009", "GB", "2020-01-01")]),
        ("00000002", [item(corporate, "00000001"), item(corporate, "00000004", " uk ")]),
        ("SC000003", [item(corporate, "00000004")]),
        ("00000004", [item(corporate, "00000005")]),
        ("00000005", [item(corporate, "00000006")]),
        ("00000007", None),
    ]
    filings = spark.createDataFrame(rows, "number string, items array<struct<kind:string,ceased_on:string,registration_number:string,country:string>>")
    roots = spark.createDataFrame([("00000001",), ("00000001",), ("00000007",)], "root string")
    got = sorted((r.number, r.depth, r.via) for r in expansion.controlling_companies(filings, roots).collect())
    assert got == [("00000002", 1, "00000001"), ("00000004", 2, "00000002"), ("00000005", 3, "00000004"), ("SC000003", 1, "00000001")]
