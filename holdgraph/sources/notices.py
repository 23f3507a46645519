"""Procurement notices as XML, taken apart into their parts and joined on the ids by which these refer to each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdgraph.lineage import written

_ID = "struct<ID:string>"
_RESULT = f"LotResult:array<struct<TenderResultCode:string,LotTender:array<{_ID}>,TenderLot:array<{_ID}>,SettledContract:array<{_ID}>>>"
_TENDER = f"LotTender:array<struct<ID:string,TenderingParty:array<{_ID}>,TenderLot:array<{_ID}>,LegalMonetaryTotal:struct<PayableAmount:struct<_VALUE:string,_currencyID:string>>>>"
_CONTRACT = f"SettledContract:array<struct<ID:string,AwardDate:string,ContractReference:array<{_ID}>>>"
_PARTY = f"TenderingParty:array<struct<ID:string,Tenderer:array<{_ID}>>>"
_ORGANISATION = f"Organization:array<struct<Company:array<struct<PartyIdentification:array<{_ID}>,PartyLegalEntity:array<struct<CompanyID:string>>>>>>"
#: The elements of a notice that matter here, by their local names.
SCHEMA = f"UBLExtensions struct<UBLExtension:array<struct<ExtensionContent:struct<EformsExtension:struct<NoticeResult:struct<{_RESULT},{_TENDER},{_CONTRACT},{_PARTY}>,Organizations:struct<{_ORGANISATION}>>>>>>"
# The result code of a lot that was awarded.
AWARDED = "selec-w"


def plain_id(value: Column) -> Column:
    """A company number as compared: letters and digits in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}]", ""))


def _first(ids: Column) -> Column:
    return F.nullif(F.trim(F.get(ids, F.lit(0))["ID"]), F.lit(""))


def _merged(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Elements of one id are one; of each field the last that says anything counts."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at"))).alias(c)
    return df.groupBy(*key).agg(*map(last, columns))


def taken_apart(notices: DataFrame) -> dict[str, DataFrame]:
    """organisations (org, company_id), parties (party, org), tenders (tender, party, lot, amount, currency), results
    (at, status, tender, lot, contract) and contracts (contract, award_date, reference) of notices (notice_id,
    xml), each with notice_id. XML that can't be read has no parts."""
    read = notices.select("notice_id", F.from_xml("xml", F.lit(SCHEMA), {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("n"))
    # Every part and join reads from here, so the XML is read once.
    body = written(read.select("notice_id", F.posexplode("n.UBLExtensions.UBLExtension.ExtensionContent.EformsExtension").alias("part", "e")).where("e IS NOT NULL"), "notices")

    def parts(path: str) -> DataFrame:
        each = body.select("notice_id", "part", F.posexplode(f"e.{path}").alias("k", "x"))
        return each.select("notice_id", (F.col("part") * 1_000_000 + F.col("k")).alias("at"), "x")

    company = parts("Organizations.Organization").select("notice_id", F.explode("x.Company").alias("c"))
    organisations = company.select("notice_id", _first(F.col("c.PartyIdentification")).alias("org"), F.explode("c.PartyLegalEntity.CompanyID").alias("company_id"))
    organisations = organisations.select("notice_id", "org", F.trim("company_id").alias("company_id")).where("org IS NOT NULL AND company_id <> ''").distinct()
    party = parts("NoticeResult.TenderingParty").select("notice_id", F.trim("x.ID").alias("party"), F.explode("x.Tenderer.ID").alias("org"))
    party = party.select("notice_id", "party", F.trim("org").alias("org")).where("party <> '' AND org <> ''").distinct()
    total = F.col("x.LegalMonetaryTotal.PayableAmount")
    tender = parts("NoticeResult.LotTender").select("notice_id", "at", F.trim("x.ID").alias("tender"), _first(F.col("x.TenderingParty")).alias("party"), _first(F.col("x.TenderLot")).alias("lot"), F.trim(total["_VALUE"]).alias("amount"), total["_currencyID"].alias("currency")).where("tender <> ''")
    result = parts("NoticeResult.LotResult").select("notice_id", "at", F.trim("x.TenderResultCode").alias("status"), _first(F.col("x.LotTender")).alias("tender"), _first(F.col("x.TenderLot")).alias("lot"), _first(F.col("x.SettledContract")).alias("contract"))
    day = F.get(F.split(F.get(F.split(F.trim("x.AwardDate"), r"\+"), F.lit(0)), "T"), F.lit(0))
    contract = parts("NoticeResult.SettledContract").select("notice_id", "at", F.trim("x.ID").alias("contract"), day.alias("award_date"), _first(F.col("x.ContractReference")).alias("reference")).where("contract <> ''")
    return {
        "organisations": organisations,
        "parties": party,
        "tenders": _merged(tender, ["notice_id", "tender"], ["party", "lot", "amount", "currency"]),
        "results": result,
        "contracts": _merged(contract, ["notice_id", "contract"], ["award_date", "reference"]),
    }


def winners(notices: DataFrame, targets: DataFrame) -> DataFrame:
    """notice_id, target_id, role ('won', 'tendered', 'unknown'), lots (won, in order), values (amount, currency),
    award_dates, contract_references, company_ids (as the notice has them), for every notice that names a target
    (target_id, company_id). Everything is joined within a notice, on its internal ids."""
    part = taken_apart(notices)
    wanted = targets.select("target_id", plain_id(F.col("company_id")).alias("plain")).where("plain <> ''").distinct()
    named = part["organisations"].withColumn("plain", plain_id(F.col("company_id"))).join(wanted, "plain").select("notice_id", "target_id", "org", "company_id").distinct()
    ours = named.select("notice_id", "target_id", "org").join(part["parties"], ["notice_id", "org"]).select("notice_id", "target_id", "party").distinct()
    tenders = ours.join(part["tenders"].withColumnRenamed("lot", "tender_lot"), ["notice_id", "party"])
    won = tenders.join(part["results"].where(F.col("status") == AWARDED), ["notice_id", "tender"]).join(part["contracts"], ["notice_id", "contract"], "left")
    won = won.withColumn("lot", F.coalesce("lot", "tender_lot"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("at", c.alias("v"))))), lambda x: x["v"])
    value = F.when(F.coalesce("amount", F.lit("")) != "", F.struct("amount", F.coalesce("currency", F.lit("")).alias("currency")))
    said = won.groupBy("notice_id", "target_id").agg(F.array_distinct(in_order(F.col("lot"))).alias("lots"), in_order(value).alias("values"), in_order(F.col("award_date")).alias("award_dates"), in_order(F.col("reference")).alias("contract_references"))
    out = named.groupBy("notice_id", "target_id").agg(F.array_sort(F.collect_set("company_id")).alias("company_ids"))
    out = out.join(tenders.select("notice_id", "target_id").distinct().withColumn("tendered", F.lit(True)), ["notice_id", "target_id"], "left").join(said, ["notice_id", "target_id"], "left")
    role = F.when(F.size("lots") > 0, "won").when(F.col("tendered"), "tendered").otherwise("unknown")
    empty = reduce(lambda df, c: df.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType))), ("lots", "values", "award_dates", "contract_references"), out.withColumn("role", role))
    return empty.select("notice_id", "target_id", "role", "lots", "values", "award_dates", "contract_references", "company_ids")
