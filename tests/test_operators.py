"""Operators on small hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from holdgraph import components as stars
from holdgraph.functions import names
from holdgraph.functions import scalars as S
from holdgraph.operators import cycles, exports, graph, narrative, resolution, risk, rollups, screening, selection, timeline
from holdgraph.sources import statements
from holdgraph.streaming import changes


def one(spark, expr, **columns):
    schema = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("x")).first()["x"]


def edges(spark, pairs, bundle="b"):
    return spark.createDataFrame([(bundle, a, b) for a, b in pairs], "bundle_id string, owner_id string, subject_id string")


CHAINS = {
    "cycle below": ([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], ["a", "b", "c"]),
    "ring": ([("a", "b"), ("b", "c"), ("c", "a")], ["a", "b", "c"]),
    "starts on a ring": ([("a", "b"), ("c", "d"), ("d", "e"), ("e", "c")], ["c", "d", "e"]),
    "left inside": ([("t", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")], ["a", "b", "c", "x"]),
    "entered": ([("t", "c"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y")], ["a", "b", "c", "x", "y"]),
    "more than 64 nodes": ([(f"{i:03}", f"{i + 1:03}") for i in range(65)], [f"{i:03}" for i in range(66)]),
    # Sixteen diamonds in a row have 65,536 paths; a ring hangs below them.
    "diamonds": ([p for i in range(16) for p in ((f"a{i:02}", f"b{i:02}"), (f"a{i:02}", f"c{i:02}"), (f"b{i:02}", f"a{i + 1:02}"), (f"c{i:02}", f"a{i + 1:02}"))] + [("a16", "x"), ("x", "y"), ("y", "a16")], [x for i in range(16) for x in (f"a{i:02}", f"b{i:02}")] + ["a16", "x", "y"]),
}


def test_longest_chains_over_cycles_and_diamonds(spark):
    e = spark.createDataFrame([(name, a, b) for name, (pairs, _) in CHAINS.items() for a, b in pairs] + [("self", "a", "a")], "bundle_id string, owner_id string, subject_id string")
    got = {r.bundle_id: (r.layers, r.path) for r in cycles.longest_chains(e).collect()}
    assert got == {name: (len(path), path) for name, (_, path) in CHAINS.items()}


def test_layers_of_a_cycle_are_one(spark):
    got = {r.node: r.layer for r in cycles.layers(edges(spark, [("t", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "x")])).collect()}
    assert got == {"d": 0, "c": 1, "a": 2, "b": 2, "t": 3}
    assert cycles.layers(edges(spark, [("a", "b"), ("b", "a")])).where("layer = 0").count() == 2


def plain_chain(pairs):
    """The longest simple path by following all, of equals the smallest."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    best = (0, [])

    def walk(path):
        nonlocal best
        best = min(best, (-len(path), path))
        for n in to.get(path[-1], ()):
            if n not in path:
                walk([*path, n])

    for n in sorted({x for p in pairs for x in p}):
        walk([n])
    return -best[0], best[1]


def plain_components(pairs):
    reach = {x: {b for a, b in pairs if a == x} for p in pairs for x in p}
    for _ in reach:
        reach = {a: r | {y for x in r for y in reach[x]} for a, r in reach.items()}
    return {a: min(b for b in r if a in reach[b]) for a, r in reach.items() if any(a in reach[b] and b != a for b in r)}


def test_cycles_and_chains_of_random_graphs(spark):
    rng = random.Random(11)
    graphs = {f"g{i}": sorted({(a, b) for a, b in ((f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, int(1.6 * n)))) if a != b}) for i, n in enumerate([3, 4, 5, 6, 7, 8, 9, 9, 10, 10, 11, 12] * 3)}
    e = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a, b in [*ps, *ps[:1]]], "bundle_id string, owner_id string, subject_id string")
    rings, chains = {}, {}
    for r in cycles.strongly_connected(e).collect():
        rings.setdefault(r.bundle_id, {})[r.node] = r.component
    for r in cycles.longest_chains(e).collect():
        chains[r.bundle_id] = (r.layers, r.path)
    for g, pairs in graphs.items():
        assert rings.get(g, {}) == plain_components(pairs), pairs
        if pairs:
            assert chains[g] == plain_chain(pairs), pairs
    assert any(rings.values())


def test_deepest_chains(spark):
    e = edges(spark, [("t", "m"), ("m", "x"), ("x", "y"), ("t", "x"), ("q", "r"), ("r", "q"), ("r", "z"), *((f"{i:02}", f"{i + 1:02}") for i in range(12))])
    names = spark.createDataFrame([("b", "t", "Top"), ("b", "y", "Why")], "bundle_id string, node string, name string")
    got = graph.deepest(e, names, hops=8, most=12).orderBy("place").collect()
    chains = ["".join(c["name"] + ">" for c in r.chain) for r in got]
    assert [r.depth for r in got] == [8, 7, 6, 5, 4, 3, 3, 2, 2, 2, 1, 1]
    assert chains[6] == "Top>m>x>Why>" and "q" not in "".join(chains)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_closure_excludes_root_and_ends_on_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    roots = spark.createDataFrame([("a",)], "root string")
    assert {(r.node, r.depth) for r in graph.closure(e, roots).collect()} == {("b", 1), ("c", 2)}


def test_walks_count_walks(spark):
    e = edges(spark, [("t", "m"), ("t", "n"), ("m", "x"), ("n", "x")])
    assert graph.walks(e, 3).where("start = 'x' AND node = 't'").count() == 2


def test_components_on_a_long_path(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("900", "901")], "a string, b string")
    assert {r.component for r in graph.components(links).collect()} == {"000", "900"}


def test_components_on_a_path_against_the_order(spark):
    """1 - a1 - ... - aL - 2, where ids fall towards 2."""
    path = ["001", *(f"{i:03}" for i in range(199, 99, -1)), "002"]
    links = spark.createDataFrame([*zip(path, path[1:]), ("900", "900")], "a string, b string")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(path, "001"), "900": "900"}


def test_components_raise_at_the_bound(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30, 0, -1)], "a long, b long")
    with pytest.raises(RuntimeError, match="1 rounds"):
        stars.components(links, lambda df, name: graph.written(df), most=1)


def test_layers_take_the_longest_way(spark):
    got = {r.node: r.layer for r in cycles.layers(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])).collect()}
    assert got == {"c": 0, "b": 1, "a": 2}


def test_statements_in_both_spellings(spark, tmp_path):
    rows = [
        {"statementId": "e1", "recordType": "entity", "recordDetails": {"name": "A Ltd", "entityType": {"type": "registeredEntity", "details": "Family trust"}, "jurisdiction": {"code": "GB"}, "identifiers": [{"id": "1", "scheme": "GB-COH"}]}},
        {"statement_id": "e2", "statementType": "entityStatement", "recordDetails": {"name": "B", "entityType": "state", "incorporatedInJurisdiction": {"code": "NO"}}},
        {"statementId": "p1", "recordType": "person", "recordDetails": {"names": [{"type": "alternative", "fullName": "X"}, {"type": "individual", "fullName": "Ann Lee"}], "birthDate": "1970-05"}},
        {"statementId": "r1", "recordType": "relationship", "recordDetails": {"subject": "e1", "interestedParty": {"describedByPersonStatement": "p1"}, "interests": [{"type": "shareholding", "share": {"exact": 25}}]}},
        {"statementId": "r2", "recordType": "relationship", "recordDetails": {"subject": "e1", "interestedParty": {"reason": "noBeneficialOwners", "description": "none"}}},
        {"statementId": "r3", "recordType": "relationship", "recordDetails": {"subject": {"describedByEntityStatement": "e2"}, "interestedParty": "e1"}},
    ]
    (tmp_path / "LEI1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    raw = statements.read_bundles(spark, str(tmp_path))
    assert raw.count() == 6
    e = {r.statement_id: r for r in statements.entities(raw).collect()}
    assert (e["e1"].bundle_id, e["e1"].jurisdiction, e["e1"].legal_form, e["e2"].jurisdiction, e["e2"].entity_type) == ("LEI1", "GB", ["Family trust"], "NO", "state")
    assert statements.persons(raw).first().name == "Ann Lee"
    r = {x.statement_id: x for x in statements.relationships(raw).collect()}
    assert (r["r1"].party_id, r["r1"].party_kind, r["r1"].interests[0].share.exact) == ("p1", "person", 25.0)
    assert (r["r2"].party_id, r["r2"].unspecified_reason) == (None, "noBeneficialOwners")
    assert (r["r3"].subject_id, r["r3"].party_id) == ("e2", "e1")


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (S.lei_ok, "5493001KJTIIGC8Y1R12", True),
        (S.lei_ok, "5493001KJTIIGC8Y1R13", False),
        (S.lei_ok, None, False),
        (S.isin_ok, "US0378331005", True),
        (S.isin_ok, "US0378331006", False),
        (S.business_id_ok, "0112038-9", True),
        (S.business_id_ok, "0112038-8", False),
        (S.organisation_number_ok, "556036-0793", True),
        (S.cnpj_ok, "00.000.000/0001-91", True),
        (S.cnpj_ok, "00.000.000/0001-92", False),
        (S.qid_ok, "Q42", True),
        (S.qid_ok, "Q042", False),
        (S.canonical_identifier, "ΗΕ 489 243", "HE489243"),
        (S.canonical_identifier, "12-3", None),
        (S.canonical_url, " HTTPS://Example.org/a/ ", "example.org/a"),
        (S.rounded_date, "2021-03", "2021-03-01"),
        (S.human_date, "2021-05-03T10:00:00Z", "3 May 2021"),
        (S.human_date, "2021-13-03", None),
        (S.slug, "Acme & Sons, Ltd.", "acme-sons-ltd"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f(F.col("v")), v=value) == want


def test_number_text(spark):
    values = [0.0, 25.0, 33.333333333, 0.5, 100.0, 1234567.0]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.number_text(F.col("v")).alias("x")).collect()]
    assert got[:5] == [f"{v:g}" for v in values[:5]]


def test_names():
    assert names.normalised("Łódź Energia Sp. z o.o.") == "lodz energia sp z o o"
    assert names.normalised("Чехов") == "chekhov"
    assert names.similarity("a b", "a b") == 1.0 and names.similarity("", "x") == 0.0
    assert names.similarity("john smith", "smith john") > 0.99
    assert names.distinctive("Gulf Bank B.S.C. Holdings Ltd") == ["gulf", "bank", "bsc"]


def test_token_gate(spark):
    gate = lambda a, b: spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>").select(S.token_gate(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert gate("moet hennessy", "hennessy")
    assert gate("gazprm", "gazprom")
    assert not gate("energen biogas", "biogas energy")
    assert not gate("hornsea 1", "hornsea 2")


def test_dice(spark):
    assert one(spark, S.dice(F.col("a"), F.col("b")), a="night", b="nacht") == pytest.approx(0.25)
    assert one(spark, S.dice(F.col("a"), F.col("b")), a="aaaa", b="aa") == pytest.approx(0.5)


def test_topics(spark):
    hits = spark.createDataFrame([("b", 1, ["sanction.control", "sanction.linked", "role.rca"]), ("b", 2, ["sanction.new"]), ("b", 3, ["crime"])], "bundle_id string, hit_id int, topics array<string>")
    got = {(r.hit_id, r.code) for r in risk.topic_signals(hits).collect()}
    assert got == {(1, "PEP"), (1, "SANCTIONS_CONTROLLED"), (2, "SANCTIONS_LINKED")}


def test_anchored_clusters_hang_on_the_first_event(spark):
    days = ["2020-01-01", "2020-12-01", "2021-06-01", "2022-01-01", None]
    df = spark.createDataFrame([("k", d) for d in days], "k string, d string").withColumn("d", F.to_date("d"))
    assert [(str(r.anchor), r.n) for r in timeline.anchored_clusters(df, ["k"], "d", 400).orderBy("anchor").collect()] == [("2020-01-01", 2), ("2021-06-01", 2)]


def test_possibly_same_treats_missing_years_as_compatible(spark):
    rows = [(1, ["n"], "GB", 2000, ["a"]), (2, ["n", "x"], "GB", None, ["b"]), (3, ["n"], "GB", 2001, ["c"]), (4, ["n"], "GB", 2000, ["a"]), (5, ["n"], "", None, [])]
    df = spark.createDataFrame(rows, "id int, name_keys array<string>, jurisdiction string, year int, keys array<string>")
    assert {(r.a, r.b) for r in resolution.possibly_same(df).collect()} == {(1, 2), (2, 3), (2, 4)}


def test_links_without_interest_and_dangling(spark):
    r = spark.createDataFrame([("r1", "a", "b", ["shareholding", "boardChair"]), ("r2", "a", "b", None), ("r3", "a", "zz", ["x"])], "statement_id string, party_id string, subject_id string, interests array<string>")
    nodes = spark.createDataFrame([("a",), ("b",)], "statement_id string")
    assert {(x.link_id, x.schema) for x in exports.entity_links(r, nodes).collect()} == {("r1", "Ownership"), ("r1-2", "Directorship"), ("r2", "UnknownLink")}


def test_gate_quality(spark):
    p = spark.createDataFrame([(0.9, True), (0.8, False), (0.4, True), (0.1, None)], "s double, l boolean")
    got = {r.threshold: (r.precision, r.recall) for r in rollups.gate_quality(p, "s", "l", [0.5, 0.95]).collect()}
    assert got == {0.5: (0.5, 0.5), 0.95: (None, 0.0)}


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 05:00:00", "view", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events.parquet")
    out = changes.drained(changes.windows(stream), "complete")
    assert [(r.event_type, r.n) for r in out.collect()] == [("view", 2)]


def test_contained_forms_of_any_length(spark):
    hits = spark.createDataFrame([(1, "Acme Trading"), (2, "a b c d e f g h i j"), (3, "acm")], "hit_id int, form string")
    targets = spark.createDataFrame([(7, "The ACME-Trading Co"), (8, "x a b c d e f g h i j y"), (9, "")], "target_id int, name string")
    assert {(r.hit_id, r.target_id) for r in selection.contained(hits, targets).collect()} == {(1, 7), (2, 8), (3, 7)}, "forms may stand inside words"


def test_validated_claims(spark):
    claims = spark.createDataFrame([(1, ["f1"]), (2, ["f1", "f9"]), (3, []), (4, None)], "claim_id int, cited array<string>")
    claims = claims.withColumn("bundle_id", F.lit("b"))
    evidence = spark.createDataFrame([("b", "f1", "f", "s1"), ("b", "g1", "g", "icij"), ("c", "f9", "f", "s2")], "bundle_id string, evidence_id string, part string, ref string")
    judged, summaries, gaps = narrative.validated(claims, evidence)
    assert {(r.claim_id, r.kept, r.unknown) for r in judged.collect()} == {(1, True, 0), (2, False, 1), (3, False, 0), (4, False, 0)}
    assert [(r.bundle_id, r.stands) for r in summaries.collect()] == [("b", False)]
    assert [(r.evidence_id, r.ref) for r in gaps.collect()] == [("g1", "icij")]


def statement(sid, kind, **details):
    return ("b", json.dumps({"statementId": sid, "recordType": kind, "recordDetails": details}))


def assessed(spark, *lines, filings=None):
    got = risk.assessed(*statements.typed(statements.parsed(spark.createDataFrame(list(lines), "bundle_id string, value string"))), filings)
    return {r.code: (r.confidence, r.kind, r.n_matches, r.detail) for r in got.collect()}


def entity(sid, **more):
    return statement(sid, "entity", **({"name": sid, "entityType": {"type": "registeredEntity"}} | more))


def owns(sid, owner, subject, **more):
    return statement(sid, "relationship", subject=subject, interestedParty=owner, **({"interests": [{"type": "shareholding"}]} | more))


def test_rules_on_statements_as_published(spark):
    chain = [entity("a", jurisdiction={"code": "DE"}), entity("b", jurisdiction={"code": "kp"}), entity("c", legalForm="Family Foundation"), owns("r1", "a", "b"), owns("r2", {"describedByEntityStatement": "b"}, {"describedByEntityStatement": "c"}), "not json"]
    lines = [x if isinstance(x, tuple) else ("b", x) for x in chain]
    lines += [statement("p", "person", personType="anonymousPerson", names=[{"type": "individual", "fullName": "Smith Nominees"}]), owns("r3", {"reason": "interestedPartyHasNotProvidedInformation"}, "a", interests=[])]
    got = assessed(spark, *lines)
    assert got["FATF_BLACK_LIST"] == ("high", "risk", 1, "KP") and got["EU_HIGH_RISK_THIRD_COUNTRY"][0] == "high"
    assert got["TRUST_OR_ARRANGEMENT"][:3] == ("high", "risk", 1) and got["NON_EU_JURISDICTION"] == ("low", "context", 1, "KP")
    assert got["OPAQUE_OWNERSHIP"][:3] == ("high", "risk", 2) and got["NOMINEE"][:3] == ("medium", "risk", 1)
    assert got["COMPLEX_OWNERSHIP_LAYERS"] == ("medium", "risk", 3, "a>b>c")
    assert got["COMPLEX_CORPORATE_STRUCTURE"] == ("high", "risk", 3, "trust/arrangement, non-EU jurisdiction, nominee")
    assert got["POSSIBLE_OBFUSCATION"][0] == "low"


def test_rules_stay_silent(spark):
    """Names say nothing of the form, persons end a chain, parties without a duty to answer aren't opaque."""
    got = assessed(spark, entity("a", name="Global Trust Foundation", jurisdiction={"code": "FR"}), entity("b"), statement("p", "person", personType="unknownPerson"), owns("r1", "p", "a"), owns("r2", "a", "b"), owns("r3", {"reason": "noBeneficialOwners"}, "b", interests=[]))
    assert got == {}


def test_filed_nominees_count_alone(spark):
    nature = "registered-owner-as-nominee-person-scotland-registered-overseas-entity"
    filings = spark.createDataFrame([("b", nature, None), ("b", nature, "2020-01-01"), ("b", "voting-rights", None)], "bundle_id string, nature string, ceased_on string")
    got = assessed(spark, owns("r1", "x", "a", interests=[{"type": "shareholding", "details": "as nominee shareholder"}]), filings=filings)
    assert got["NOMINEE"] == ("high", "risk", 1, nature)


def test_verdicts(spark):
    signals = spark.createDataFrame([("a", "PEP", "risk", 1), ("a", "SANCTIONED", "risk", 1), ("a", "STATE_CONTROLLED", "risk", 1), ("a", "COMPLEX_OWNERSHIP_LAYERS", "risk", 4), ("b", "COMPLEX_OWNERSHIP_LAYERS", "risk", 3), ("c", "NEW_CODE", "risk", 1), ("d", "GLEIF_REPORTING_EXCEPTION", "context", 1)], "bundle_id string, code string, kind string, n_matches long")
    lost = spark.createDataFrame([("d", "x"), ("e", "x"), ("e", "y"), ("a", "x")], "bundle_id string, source string")
    subjects = spark.createDataFrame([(c,) for c in "abcdef"], "bundle_id string")
    got = {r.bundle_id: r.verdict for r in risk.verdicts(subjects, signals, lost).collect()}
    assert got["a"] == "Sanctions findings on the company itself, and a politically exposed person among the parties named, over an ownership chain 4 layers deep."
    assert got["b"] == "The records show an ownership chain 3 layers deep." and got["c"] is None
    assert got["d"] == "No risk signals surfaced, over no parent filed with GLEIF, under a permitted exception, but one check did not run — an empty result there is not a clean screen."
    assert got["e"] == "No risk signals surfaced, but 2 checks did not run — an empty result there is not a clean screen."
    assert got["f"] == "No risk signals surfaced across the sources that answered."


def test_expansion_says_what_it_leaves_out(spark):
    e = spark.createDataFrame([("o1", "s", False), ("o2", "s", False), ("o3", "s", True), ("t", "o1", False), ("s", "t", False)], "owner_id string, subject_id string, ended boolean")
    nodes, cut = graph.expansion(e, spark.createDataFrame([("s",), ("z",)], "root string"), 3, 1)
    assert {(r.node, r.depth) for r in nodes.collect()} == {("o1", 1), ("t", 2)}
    assert {(r.root, r.truncated) for r in cut.collect()} == {("s", True), ("z", False)}


def test_split_values_and_ladder(spark):
    got = spark.createDataFrame([(" a; ;b ;", "ann lee", "lee ann")], "c string, a string, b string").select(S.split_values(F.col("c")).alias("v"), screening.name_ladder(F.col("a"), F.col("b")).alias("l")).first()
    assert (got.v, got.l) == (["a", "b"], 0.97)
