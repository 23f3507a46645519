"""The statement model: typed tables of entities, persons, relationships, hits, signals and changes."""

IDENTIFIER = "struct<id:string,scheme:string,schemeName:string,uri:string>"
SHARE = "struct<exact:double,minimum:double,exclusiveMinimum:double,maximum:double,exclusiveMaximum:double>"
INTEREST = f"struct<type:string,directOrIndirect:string,beneficialOwnershipOrControl:boolean,details:string,share:{SHARE},startDate:string,endDate:string>"
COUNTRY = "struct<name:string,code:string>"

ENTITY = f"bundle_id string, statement_id string, record_id string, record_status string, statement_date string, name string, entity_type string, legal_form array<string>, jurisdiction string, founding_date string, identifiers array<{IDENTIFIER}>"
PERSON = f"bundle_id string, statement_id string, record_id string, record_status string, statement_date string, name string, person_type string, birth_date string, nationalities array<{COUNTRY}>, identifiers array<{IDENTIFIER}>"
RELATIONSHIP = f"bundle_id string, statement_id string, record_id string, record_status string, statement_date string, subject_id string, party_id string, party_kind string, unspecified_reason string, unspecified_description string, interests array<{INTEREST}>"
SIGNAL = "bundle_id string, code string, confidence string, kind string, source_id string, hit_id string, subject_statement_id string"
