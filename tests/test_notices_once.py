"""Notices are read as XML once, whatever is joined afterwards."""

from pyspark.sql import functions as F

from holdgraph.sources import notices

XML = """<N xmlns:a="urn:a"><a:UBLExtensions><a:UBLExtension><a:ExtensionContent><a:EformsExtension><a:NoticeResult>
<a:LotResult><a:TenderResultCode>selec-w</a:TenderResultCode><a:LotTender><a:ID>T1</a:ID></a:LotTender></a:LotResult>
<a:LotTender><a:ID>T1</a:ID><a:TenderingParty><a:ID>P1</a:ID></a:TenderingParty><a:TenderLot><a:ID>L1</a:ID></a:TenderLot></a:LotTender>
<a:TenderingParty><a:ID>P1</a:ID><a:Tenderer><a:ID>O1</a:ID></a:Tenderer></a:TenderingParty></a:NoticeResult>
<a:Organizations><a:Organization><a:Company><a:PartyIdentification><a:ID>O1</a:ID></a:PartyIdentification><a:PartyLegalEntity><a:CompanyID>ab-1</a:CompanyID></a:PartyLegalEntity></a:Company></a:Organization></a:Organizations>
</a:EformsExtension></a:ExtensionContent></a:UBLExtension></a:UBLExtensions></N>"""


def test_joins_read_what_was_taken_apart(spark):
    rows = spark.createDataFrame([("n1", XML), ("n2", XML.replace("selec-w", "clos-nw")), ("n3", "<N"), ("n4", None)], "notice_id string, xml string")
    out = notices.winners(rows, spark.createDataFrame([("x", "AB 1")], "target_id string, company_id string"))
    assert {(r.notice_id, r.role, tuple(r.lots)) for r in out.collect()} == {("n1", "won", ("L1",)), ("n2", "tendered", ())}
    assert "xml" not in out.select(F.lit(1), "role", "lots")._jdf.queryExecution().optimizedPlan().toString().lower()
