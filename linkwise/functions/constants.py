"""Fixed values that results depend on.

Everything in this module is a FIXED VALUE: the lists and maps below must stay
exactly as they are for normalization and validation results to be right.
They are stated plainly, in natural order, and are not derived from anything.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: name abbreviations (whole-word, lower case) -> expansion
# ---------------------------------------------------------------------------
NAME_ABBREVIATIONS = {
    "jr": "junior",
    "sr": "senior",
    "dr": "doctor",
    "mr": "mister",
    "mrs": "missus",
    "ms": "miss",
    "prof": "professor",
    "rev": "reverend",
    "hon": "honorable",
    "st": "saint",
    "capt": "captain",
    "lt": "lieutenant",
    "col": "colonel",
    "gen": "general",
    "maj": "major",
    "sgt": "sergeant",
    "cpl": "corporal",
    "pvt": "private",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: street / unit / direction abbreviations -> expansion
# ---------------------------------------------------------------------------
ADDRESS_ABBREVIATIONS = {
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "rd": "road",
    "dr": "drive",
    "ln": "lane",
    "pl": "place",
    "pkwy": "parkway",
    "cir": "circle",
    "ct": "court",
    "ter": "terrace",
    "terr": "terrace",
    "hwy": "highway",
    "fwy": "freeway",
    "apt": "apartment",
    "bldg": "building",
    "fl": "floor",
    "ste": "suite",
    "rm": "room",
    "n": "north",
    "s": "south",
    "e": "east",
    "w": "west",
    "ne": "northeast",
    "nw": "northwest",
    "se": "southeast",
    "sw": "southwest",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: US state names (lower case) -> two-letter code (lower case)
# ---------------------------------------------------------------------------
STATE_CODES = {
    "alabama": "al",
    "alaska": "ak",
    "arizona": "az",
    "arkansas": "ar",
    "california": "ca",
    "colorado": "co",
    "connecticut": "ct",
    "delaware": "de",
    "florida": "fl",
    "georgia": "ga",
    "hawaii": "hi",
    "idaho": "id",
    "illinois": "il",
    "indiana": "in",
    "iowa": "ia",
    "kansas": "ks",
    "kentucky": "ky",
    "louisiana": "la",
    "maine": "me",
    "maryland": "md",
    "massachusetts": "ma",
    "michigan": "mi",
    "minnesota": "mn",
    "mississippi": "ms",
    "missouri": "mo",
    "montana": "mt",
    "nebraska": "ne",
    "nevada": "nv",
    "new hampshire": "nh",
    "new jersey": "nj",
    "new mexico": "nm",
    "new york": "ny",
    "north carolina": "nc",
    "north dakota": "nd",
    "ohio": "oh",
    "oklahoma": "ok",
    "oregon": "or",
    "pennsylvania": "pa",
    "rhode island": "ri",
    "south carolina": "sc",
    "south dakota": "sd",
    "tennessee": "tn",
    "texas": "tx",
    "utah": "ut",
    "vermont": "vt",
    "virginia": "va",
    "washington": "wa",
    "west virginia": "wv",
    "wisconsin": "wi",
    "wyoming": "wy",
    "district of columbia": "dc",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: legacy input column name -> model field name
# ---------------------------------------------------------------------------
LEGACY_FIELD_NAMES = {
    "firstname": "first_name",
    "lastname": "last_name",
    "middlename": "middle_name",
    "gnpi": "group_npi",
    "primary_spec_desc": "specialty",
    "address1": "address_line_1",
    "address2": "address_line_2",
    "zipcode": "postal_code",
    "address_category": "address_type",
}

# FIXED VALUES: strings the model turns into null in every field
MODEL_NULL_TOKENS = ["null", "NULL"]

# FIXED VALUES: CSV null tokens: the loader's own list, then the pandas
# default NA strings (keep_default_na=True)
CSV_NULL_TOKENS = [
    "null", "NULL", "None", "NONE", "",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NaN", "n/a", "nan",
]

# FIXED VALUES: enumerations (lower case) and their defaults
ADDRESS_STATUS_VALUES = ["verified", "inconclusive", "invalid", "no"]
PHONE_STATUS_VALUES = ["verified", "inconclusive", "invalid", "no"]
ADDRESS_TYPE_VALUES = ["primary", "secondary", "billing", "mailing"]
DEFAULT_ADDRESS_STATUS = "inconclusive"
DEFAULT_PHONE_STATUS = "inconclusive"
DEFAULT_ADDRESS_TYPE = "primary"

# FIXED VALUES: NPI Luhn prefix (the constant 24 is the Luhn sum of it)
NPI_LUHN_PREFIX = "80840"

# FIXED VALUES: field length limits (min, max); None = no bound
FIELD_LENGTHS = {
    "first_name": (1, 50),
    "middle_name": (None, 50),
    "last_name": (1, 50),
    "address_line_1": (1, 100),
    "address_line_2": (None, 100),
    "city": (1, 50),
    "group_name": (None, 255),
    "specialty": (None, 100),
}

# FIXED VALUES: prepared table columns, in order
PREPARED_COLUMNS = [
    "unique_id", "npi", "group_npi", "group_name", "given_name", "middle_name",
    "family_name", "street_address", "city", "state", "postal_code", "phone",
    "specialty", "address_status", "phone_status",
]

# FIXED VALUES: batch check (required raw columns); address1 and zipcode are
# added because the row model requires them (see README, decision D16)
BATCH_REQUIRED_COLUMNS = ["npi", "firstname", "lastname", "city", "state", "address1", "zipcode"]

# FIXED VALUES: data quality settings
CRITICAL_FIELDS = ["family_name", "given_name", "npi"]
DUPLICATE_KEY_FIELDS = ["npi", "given_name", "family_name"]
QUALITY_MISSING_RATE = 0.05
QUALITY_DUPLICATE_RATE = 0.10
QUALITY_INCONCLUSIVE_SHARE = 0.2
QUALITY_INVALID_PHONE_SHARE = 0.1
QUALITY_TOP_STATES_SHARE = 0.8

# FIXED VALUES: training rules used for EM sessions
TRAINING_RULES = [
    "l.npi = r.npi",
    "l.family_name = r.family_name AND l.given_name = r.given_name",
    "l.phone = r.phone AND length(l.phone) >= 10",
]
TRAINING_RULE_COLUMNS = ["npi", "family_name", "given_name", "phone"]

# FIXED VALUES: cluster-sample display columns
SAMPLE_DISPLAY_COLUMNS = [
    "cluster_id", "npi", "given_name", "family_name", "city", "state", "phone", "cluster_size",
]
