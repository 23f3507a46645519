"""Notices, files of mixed encodings, old statements and timeline entries on hand-made rows."""

import json

from holdgraph.operators import graph, timeline
from holdgraph.sources import notices, sniffed, statements, upgrade


def notice(result="", organisations=""):
    return f'<a:ContractAwardNotice xmlns:a="u:a" xmlns:b="u:b"><a:Other/><b:UBLExtensions><b:UBLExtension><b:ExtensionContent><a:EformsExtension><a:NoticeResult>{result}</a:NoticeResult><a:Organizations>{organisations}</a:Organizations></a:EformsExtension></b:ExtensionContent></b:UBLExtension></b:UBLExtensions></a:ContractAwardNotice>'


def org(i, *numbers):
    return f"<a:Organization><a:Company><b:PartyIdentification><b:ID>ORG-{i}</b:ID></b:PartyIdentification>{''.join(f'<b:PartyLegalEntity><b:CompanyID> {n} </b:CompanyID></b:PartyLegalEntity>' for n in numbers)}</a:Company></a:Organization>"


def test_winners_follow_the_references_of_a_notice(spark):
    parties = "<a:TenderingParty><b:ID>T1</b:ID><a:Tenderer><b:ID>ORG-1</b:ID></a:Tenderer><a:Tenderer><b:ID>ORG-2</b:ID></a:Tenderer></a:TenderingParty><a:TenderingParty><b:ID>T2</b:ID><a:Tenderer><b:ID>ORG-3</b:ID></a:Tenderer></a:TenderingParty>"
    tenders = '<a:LotTender><b:ID>N1</b:ID><a:TenderingParty><b:ID>T1</b:ID></a:TenderingParty><a:TenderLot><b:ID>LOT-1</b:ID></a:TenderLot><b:LegalMonetaryTotal><b:PayableAmount currencyID="EUR">10.5</b:PayableAmount></b:LegalMonetaryTotal></a:LotTender><a:LotTender><b:ID>N1</b:ID></a:LotTender><a:LotTender><b:ID>N2</b:ID><a:TenderingParty><b:ID>T2</b:ID></a:TenderingParty></a:LotTender>'
    results = "<a:LotResult><b:TenderResultCode>selec-w</b:TenderResultCode><a:LotTender><b:ID>N1</b:ID></a:LotTender><a:SettledContract><b:ID>C1</b:ID></a:SettledContract></a:LotResult><a:LotResult><b:TenderResultCode>selec-w</b:TenderResultCode><a:LotTender><b:ID>N1</b:ID></a:LotTender><a:TenderLot><b:ID>LOT-7</b:ID></a:TenderLot></a:LotResult><a:LotResult><b:TenderResultCode>clos-nw</b:TenderResultCode><a:LotTender><b:ID>N2</b:ID></a:LotTender></a:LotResult>"
    contracts = "<a:SettledContract><b:ID>C1</b:ID><b:AwardDate>2025-07-03+02:00</b:AwardDate><a:ContractReference><b:ID>R-9</b:ID></a:ContractReference></a:SettledContract>"
    rows = [
        ("n1", notice(results + tenders + contracts + parties, org(1, "GB 123", "x") + org(2, "77") + org(3, "gb-123a") + org(4, "88"))),
        ("n2", "no xml"),
        ("n3", notice("", org(9, "GB123"))),
        ("n4", None),
    ]
    targets = spark.createDataFrame([("a", "gb123"), ("a", "X"), ("b", "GB123A"), ("c", "88"), ("d", ""), ("e", "none")], "target_id string, company_id string")
    got = {(r.notice_id, r.target_id): r for r in notices.winners(spark.createDataFrame(rows, "notice_id string, xml string"), targets).collect()}
    assert {k: r.role for k, r in got.items()} == {("n1", "a"): "won", ("n1", "b"): "tendered", ("n1", "c"): "unknown", ("n3", "a"): "unknown"}
    won = got["n1", "a"]
    assert won.lots == ["LOT-1", "LOT-7"] and [tuple(v) for v in won["values"]] == [("10.5", "EUR"), ("10.5", "EUR")]
    assert (won.award_dates, won.contract_references, won.company_ids) == (["2025-07-03"], ["R-9"], ["GB 123", "x"])
    assert got["n1", "b"].lots == [] and got["n1", "b"].award_dates == []


def test_files_are_read_by_what_they_show(spark, tmp_path):
    files = {
        "a.csv": 'Reg;Name\n1;"x; ""y"""\n\n2;Ελλάς\n'.encode("cp1253"),
        "b.csv": "reg\tname\n3\tΕλλάς\textra\n4\n".encode("utf-8-sig"),
        "c.csv": "REG,Title\n5,\"a\nb\"\n".encode("utf-16"),
        "d.csv": b"",
        "e.csv": b"one\n6\n",
        "f.csv": b"reg|name\n7|a,b\n8|c,d\n",
        "sub/g.csv": b"reg;name\n9;\x81\n",
        "h.txt": b"reg;name\n10;no\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = sniffed.read_sniffed(spark, str(tmp_path))
    got = {(r.reg, r.name) for r in read.select(sniffed.cell(("reg", "one")).alias("reg"), sniffed.cell(("name", "title")).alias("name")).collect()}
    assert got == {("1", 'x; "y"'), ("2", "Ελλάς"), ("3", "Ελλάς"), ("4", None), ("5", "a\nb"), ("6", None), ("7", "a,b"), ("8", "c,d"), ("9", "\x81")}
    assert sorted(r.row for r in read.where("file LIKE '%a.csv'").collect()) == [1, 2]


def test_old_statements_read_as_new_ones(spark):
    lines = [
        {"statementID": "e1", "statementType": "entityStatement", "name": "A", "alternateNames": ["B", ""], "identifiers": [{"id": "1", "scheme": "X"}, {"id": "2"}], "statementDate": "2020-01-02T00"},
        {"statementID": "e2", "statementType": "entityStatement", "incorporatedInJurisdiction": {"code": "AM"}},
        {"statementID": "p1", "statementType": "personStatement", "names": [{"type": "transliteration", "fullName": "Ani"}, {"fullName": " Անի "}], "birthDate": "1980-05-06", "nationalities": [{"code": "AM"}]},
        {"statementID": "r1", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "e1"}, "interestedParty": {"describedByPersonStatement": "p1"}, "interests": [{"type": "voting-rights", "interestLevel": "direct", "share": {"exact": "12.5"}, "startDate": "2019-01-01T00:00"}, {"type": "golden", "share": {"exact": 140}, "beneficialOwnershipOrControl": True}]},
        {"statementID": "r2", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "nowhere"}, "interestedParty": {}},
        {"statementID": "r3", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "e2"}, "interestedParty": {"describedByEntityStatement": "gone"}},
        {"statementID": "r4", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "e2"}, "interestedParty": {"unspecified": {"reason": "noBeneficialOwners"}}},
        {"statementId": "n1", "recordType": "entity", "recordDetails": {"name": "New"}},
        {"statementType": "entityStatement", "name": "no id"},
    ]
    df = spark.createDataFrame([("b", json.dumps(x)) for x in lines] + [("b", "no json"), ("c", json.dumps(lines[3]))], "bundle_id string, value string")
    parsed = statements.parsed(upgrade.upgraded(df, "s"))
    entities = {r.name: r for r in statements.entities(parsed).collect()}
    assert set(entities) == {"A", "e2", "New"} and entities["A"].statement_date == "2020-01-02" and [i.id for i in entities["A"].identifiers] == ["1"]
    assert entities["e2"].jurisdiction == "AM"
    (person,) = statements.persons(parsed).collect()
    assert (person.name, person.birth_date, person.nationalities[0].code) == ("Անի", "1980-05", "AM") and "Ani" in person.words
    links = {(r.subject_id, r.party_id, r.unspecified_reason): r.interests for r in statements.relationships(parsed).collect()}
    a, e2 = entities["A"].statement_id, entities["e2"].statement_id
    assert set(links) == {(a, person.statement_id, None), (e2, None, "unknown"), (e2, None, "noBeneficialOwners")}, "the bundle without the subject has no link"
    first, second = links[a, person.statement_id, None]
    assert (first.type, first.directOrIndirect, first.share.exact, first.startDate, first.details) == ("votingRights", "direct", 12.5, "2019-01-01", None)
    assert (second.type, second.directOrIndirect, second.share, second.beneficialOwnershipOrControl, second.details) == ("otherInfluenceOrControl", "unknown", None, True, "interest type as filed: golden")


EVENTS = "subject string, event_id long, change_type string, record_type string, event_date date, date_basis string, date_confidence string, source_id string, tier int, boosted boolean, interest_start string, interest_end string, counterparty string"


def test_entries_choose_the_event_that_counts(spark):
    rows = [
        ("s", 1, "NAME", "entity", "2020-01-01", "recorded", "high", "a", 2, False, "", None, "x"),
        ("s", 2, "NAME", "entity", "2020-06-01", "effective", "low", "b", 2, True, None, None, ""),
        ("s", 3, "NAME", "entity", "2020-05-01", "effective", "high", "b", 2, False, "2019", None, None),
        ("s", 4, "NAME", "entity", "2021-03-01", "effective", "high", "c", 2, False, None, None, None),
        ("s", 5, "NAME", "entity", None, "effective", "high", "c", 2, False, None, None, None),
        ("s", 6, "NAME", "entity", None, "effective", "high", "c", 2, False, None, None, None),
        ("s", 7, "OWNER", "relationship", "2020-01-01", "recorded", "high", "a", 1, False, None, None, None),
        ("s", 8, "OWNER", "relationship", "2020-01-01", "recorded", "high", "b", 1, False, None, None, None),
        ("s", 9, "NAME", "entity", "2020-01-01", "effective", "high", "a", 3, False, None, None, None),
        ("s", 10, None, "entity", "2020-01-01", "effective", "high", "a", 1, True, None, None, None),
        ("t", 11, "NAME", "entity", "2020-01-01", "odd", "odd", "a", 3, True, None, None, None),
    ]
    import datetime

    data = [(*r[:4], r[4] and datetime.date.fromisoformat(r[4]), *r[5:]) for r in rows]
    entries, members = timeline.entries(spark.createDataFrame(data, EVENTS))
    got = {r.entry_id: r for r in entries.collect()}
    assert {i: (r.n_corroborating, r.sources, r.place) for i, r in got.items()} == {3: (2, ["a", "b"], 3), 4: (0, ["c"], 4), 5: (0, ["c"], 5), 6: (0, ["c"], 6), 7: (0, ["a"], 1), 8: (0, ["b"], 2), 11: (0, ["a"], 1)}
    assert (got[3].boosted, got[3].interest_start, got[3].counterparty) == (True, "2019", "x")
    assert {(r.event_id, r.entry_id) for r in members.collect()} == {(1, 3), (2, 3), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (11, 11)}


def test_assets_stand_under_the_sector_of_their_first_owner(spark):
    reach = spark.createDataFrame([("r", "r", 0), ("r", "b", 1), ("r", "a", 1), ("r", "c", 2)], "root string, node string, depth int")
    assets = spark.createDataFrame([("c", 1, "late"), ("b", 1, "b"), ("a", 1, "first"), ("c", 2, None), ("r", 3, "own"), ("a", 3, "other"), ("z", 4, "far"), ("c", 2, None)], "node string, asset long, sector string")
    assert {tuple(r) for r in graph.assets_by_sector(reach, assets).collect()} == {("r", "first", 1), ("r", "unknown", 1), ("r", "own", 1)}
