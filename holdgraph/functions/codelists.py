"""Fixed values that results depend on: published lists and codes, each with its date where it has one."""

# EU-27 and the EEA states outside the EU.
EU_EEA = ("AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "IS", "LI", "NO")

# FATF call for action (February 2026) and increased monitoring (June 2026).
FATF_BLACK = ("KP", "IR", "MM")
FATF_GREY = ("AO", "BA", "BO", "BG", "CM", "CI", "CD", "HT", "IQ", "KE", "KW", "LA", "LB", "MC", "NP", "PG", "SS", "SY", "VE", "VN", "VG", "YE")

# Annex of Delegated Regulation (EU) 2016/1675 as of 29 January 2026.
EU_HIGH_RISK = ("AF", "DZ", "AO", "BO", "VG", "CM", "CI", "CD", "HT", "KE", "LA", "LB", "MC", "MM", "NA", "NP", "SS", "SY", "TT", "VU", "VE", "VN", "YE", "IR", "KP")

# Fragments of legal forms and of nominee wording, lower case.
TRUST_FRAGMENTS = ("trust", "foundation", "stiftung", "anstalt", "fideicomiso", "treuhand")
NOMINEE_FRAGMENTS = ("nominee", "nomineeshareholder", "nominee shareholder", "nomineedirector", "nominee director", "prête-nom", "prete-nom", "fiduciaire")

# Filed natures of control that state a nominee arrangement.
NOMINEE_NATURES = (
    "registered-owner-as-nominee-person-england-wales-registered-overseas-entity",
    "registered-owner-as-nominee-person-scotland-registered-overseas-entity",
    "registered-owner-as-nominee-person-northern-ireland-registered-overseas-entity",
    "registered-owner-as-nominee-another-entity-england-wales-registered-overseas-entity",
    "registered-owner-as-nominee-another-entity-scotland-registered-overseas-entity",
    "registered-owner-as-nominee-another-entity-northern-ireland-registered-overseas-entity",
)

# Topics of screening lists and the signal each family gives.
PEP_TOPICS = ("role.pep", "role.rca", "role.spouse", "role.family")
SANCTION_TOPICS = {"sanction": "SANCTIONED", "sanction.counter": "COUNTER_SANCTIONED", "sanction.control": "SANCTIONS_CONTROLLED", "sanction.linked": "SANCTIONS_LINKED"}
EXPORT_TOPICS = {"export.control": "EXPORT_CONTROLLED", "export.control.linked": "EXPORT_CONTROL_LINKED", "export.risk": "EXPORT_RISK"}

# Reasons under which ownership counts as undisclosed.
UNDISCLOSED_REASONS = ("NON_PUBLIC", "BINDING_LEGAL_COMMITMENTS", "LEGAL_OBSTACLES", "DISCLOSURE_DETRIMENTAL", "DETRIMENT_NOT_EXCLUDED", "CONSENT_NOT_OBTAINED")
OPAQUE_PARTY_REASONS = ("subjectUnableToConfirmOrIdentifyBeneficialOwner", "interestedPartyHasNotProvidedInformation")

# Change types with tier (1 ownership, 2 identity, 3 administrative) and record status.
CHANGE_TYPES = {
    "OWNER_ADDED": (1, "new"),
    "OWNER_REMOVED": (1, "closed"),
    "CONTROL_BAND_CHANGED": (1, "updated"),
    "CONTROL_NATURE_CHANGED": (1, "updated"),
    "PARENT_CHANGED": (1, "updated"),
    "REPORTING_EXCEPTION_CHANGED": (1, "updated"),
    "STATUS_CHANGED": (2, "updated"),
    "SUCCESSION": (2, "updated"),
    "LEGAL_NAME_CHANGE": (2, "updated"),
    "LEGAL_FORM_CHANGE": (2, "updated"),
    "JURISDICTION_CHANGE": (2, "updated"),
    "REGISTRATION_RETIRED": (2, "closed"),
    "ADDRESS_CHANGE": (2, "updated"),
}
FILING_CODES = {"PSC01": "OWNER_ADDED", "PSC02": "OWNER_ADDED", "PSC03": "OWNER_ADDED", "PSC04": "CONTROL_NATURE_CHANGED", "PSC05": "CONTROL_NATURE_CHANGED", "PSC06": "CONTROL_NATURE_CHANGED", "PSC07": "OWNER_REMOVED", "PSC08": "REPORTING_EXCEPTION_CHANGED", "PSC09": "REPORTING_EXCEPTION_CHANGED"}
FILING_CATEGORIES = {"change-of-name": "LEGAL_NAME_CHANGE", "reregistration": "LEGAL_FORM_CHANGE", "address": "ADDRESS_CHANGE", "dissolution": "STATUS_CHANGED", "liquidation": "STATUS_CHANGED", "insolvency": "STATUS_CHANGED", "restoration": "STATUS_CHANGED"}
RETIRED_STATUSES = ("RETIRED", "MERGED", "ANNULLED", "DUPLICATE")
LEGAL_FORM_CLASSES = {"B6ES": "PUBLIC_LIMITED", "H0PO": "PRIVATE_LIMITED", "8888": "UNKNOWN"}

# Interests that are offices rather than ownership.
DIRECTORSHIPS = ("seniorManagingOfficial", "boardMember", "boardChair")

# Letters that look like Latin capitals, for identifiers.
HOMOGLYPHS = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I"}
