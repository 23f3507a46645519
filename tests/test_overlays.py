"""Validation, overlays, targets and search quality on hand-made rows."""

import json

from holdgraph.operators import overlays, risk, rollups
from holdgraph.sources import statements, validation


def parsed(spark, *lines):
    return statements.parsed(spark.createDataFrame([("b", json.dumps(x)) for x in lines], "bundle_id string, value string"))


def statement(sid, kind, details, **more):
    return {"statementId": sid, "recordId": f"r-{sid}", "recordType": kind, "recordStatus": "new", "recordDetails": details} | more


GOOD = [
    statement("e1", "entity", {"name": "A", "entityType": {"type": "legalEntity"}}),
    statement("e2", "entity", {"name": "a ", "entityType": {"type": "state"}}),
    statement("p1", "person", {"personType": "knownPerson", "names": [{"fullName": "P"}]}),
    statement("l1", "relationship", {"subject": "e1", "interestedParty": "r-p1", "interests": [{"type": "boardMember"}, {"type": "nominator"}]}),
    statement("l2", "relationship", {"subject": {"describedByEntityStatement": "e1"}, "interestedParty": {"unspecifiedReason": "x"}}),
    statement("l3", "relationship", {"subject": "r-e1", "interestedParty": {"reason": "x"}, "interests": []}),
]


def test_good_statements_have_no_issues(spark):
    assert validation.issues(parsed(spark, *GOOD)).collect() == []
    row = validation.connectivity(parsed(spark, *GOOD)).first()
    assert row.asDict() == {"bundle_id": "b", "n_entities": 2, "n_persons": 1, "n_relationships": 3, "n_dangling": 0, "n_unreferenced": 1, "n_repeated_names": 1}


def test_every_family_of_issues(spark):
    bad = [
        {"statementId": "x1", "recordType": "thing"},
        statement("x2", "entity", {"entityType": {"type": "company"}}, recordStatus="old"),
        statement("x3", "person", {"personType": "human", "names": [{"givenName": "P"}]}),
        statement("x4", "person", {}),
        statement("x5", "relationship", {"subject": "gone", "interests": [{"type": "golden"}, {}, {"type": "trustee"}]}),
        statement("x6", "relationship", {"subject": {}, "interestedParty": {"describedByPersonStatement": "x3"}}),
        {"recordType": "entity", "recordStatus": "new", "recordId": "r7", "recordDetails": {"name": "N", "entityType": {"type": "state"}}},
    ]
    got = {(r.statement_id, r.check, r.detail) for r in validation.issues(parsed(spark, *bad)).collect()}
    assert got == {
        ("x1", "missing", "recordId"), ("x1", "missing", "recordStatus"), ("x1", "missing", "recordDetails"), ("x1", "recordType", "thing"),
        ("x2", "recordStatus", "old"), ("x2", "entityType", "company"), ("x2", "entityName", ""),
        ("x3", "personType", "human"), ("x3", "personName", ""), ("x4", "personType", ""), ("x4", "personName", ""),
        ("x5", "subject", "gone"), ("x5", "interestedParty", ""), ("x5", "interestType", "golden"), ("x5", "interestType", ""),
        ("x6", "subject", ""), (None, "missing", "statementId"),
    }


def test_group_register_prefers_heads_and_confirms(spark):
    schema = "lei string, name string, parent_name string, identifiers map<string,string>"
    heads = spark.createDataFrame([("L1", "Head", "G", {"opencorporates": "gb/1", "capiq": " "})], schema)
    members = spark.createDataFrame([("L1", "Member", "G", {}), ("l2", "Sub", "G", {"permid": "9", "capiq": "IQ 7"}), (None, "x", "G", {})], schema)
    subjects = spark.createDataFrame([("b1", " l1", {"opencorporates": "GB/1 "}), ("b2", "L2", {"permid": "9", "capiq": "iq7"}), ("b3", "L3", {}), ("b4", None, None), ("b5", "L2", None)], "bundle_id string, lei string, known map<string,string>")
    got = {r.bundle_id: (r.mode, r.name, [tuple(i) for i in r.identifiers]) for r in overlays.group_matches(subjects, heads, members).collect()}
    assert got == {"b1": ("head", "Head", [("opencorporates", "gb/1", True)]), "b2": ("subsidiary", "Sub", [("permid", "9", False), ("capiq", "IQ 7", True)]), "b5": ("subsidiary", "Sub", [("permid", "9", False), ("capiq", "IQ 7", False)])}


def test_securities_become_signals_and_rows(spark):
    index = spark.createDataFrame([("L1", "os", ["EU", "US"], ["I1", "", None, "I2", "I3", "I4", "I5", "I6"]), ("L2", None, None, ["I9"]), ("L3", "x", [], [""])], "lei string, id string, regimes array<string>, isins array<string>")
    subjects = spark.createDataFrame([("b1", "l1 "), ("b2", "L2"), ("b3", "L3"), ("b4", None)], "bundle_id string, lei string")
    got = {r.bundle_id: (r.hit_id, r.n_matches, r.detail, r["sample"]) for r in overlays.security_signals(subjects, index).collect()}
    assert got == {"b1": ("os", 6, "EU, US", ["I1", "I2", "I3", "I4", "I5"]), "b2": ("L2", 1, "", ["I9"])}
    listed = spark.createDataFrame([("L2", "i9"), ("L2", "I8"), ("L2", None)], "lei string, isin string")
    details = spark.createDataFrame([("I8", "Bond", "bond"), ("I8", "Bond", "bond")], "isin string, name string, kind string")
    rows = {(r.isin, r.name, r.sanctioned) for r in overlays.security_rows(listed, index.where("lei = 'L2'"), details).collect()}
    assert rows == {("I9", None, True), ("I8", "Bond", False)}


def test_targets_of_screens(spark):
    entities = spark.createDataFrame([("b", "e1", " Acme ", "legalEntity"), ("b", "e2", "X", "anonymousEntity"), ("b", "e3", " ", "state"), ("b", "e4", "A.B", None), ("b", "", "No id", "state")], "bundle_id string, statement_id string, name string, entity_type string")
    persons = spark.createDataFrame([("b", "p1", "Ann Lee", "knownPerson", "1970-05", ["gb"]), ("b", "p2", "Y", "unknownPerson", None, None), ("b", "p3", "Bo", None, "x", None)], "bundle_id string, statement_id string, name string, person_type string, birth_date string, nationalities array<string>")
    found = overlays.screening_targets(entities, persons)
    assert {(r.statement_id, r.kind, r.name, r.birth_year, tuple(r.countries)) for r in found.collect()} == {("e1", "entity", "Acme", None, ()), ("e4", "entity", "A.B", None, ()), ("p1", "person", "Ann Lee", 1970, ("gb",)), ("p3", "person", "Bo", None, ())}
    assert {r.statement_id for r in overlays.leak_targets(found).collect()} == {"e1", "p1"}


def test_search_quality(spark):
    answers = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "b", 6), (2, "b", 3), (3, "c", 7)], "query_id long, id string, place int")
    expected = spark.createDataFrame([(1, "typo", "a"), (2, "typo", "b"), (3, "exact", "c"), (4, "exact", "d")], "query_id long, category string, id string")
    got = {r.category: (r.n, r.hit_1, r.hit_5) for r in rollups.search_quality(answers, expected).collect()}
    assert got == {"": (4, 1, 2), "typo": (2, 1, 2), "exact": (2, 0, 0)}


def test_a_screen_without_a_source_counts_as_missing(spark):
    subjects = spark.createDataFrame([("b",), ("c",)], "bundle_id string")
    signals = spark.createDataFrame([], "bundle_id string, code string, kind string, n_matches int")
    failed = spark.createDataFrame([("b", None), ("b", "x")], "bundle_id string, source string")
    got = {r.bundle_id: r.verdict for r in risk.verdicts(subjects, signals, failed).collect()}
    assert "2 checks did not run" in got["b"] and "sources that answered" in got["c"]
