"""The fixed 17-field target schema and its reference values.

Every literal table in this module is a fixed value of the domain: results are
only right when these spellings and their order are kept exactly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Target fields in output order -> (type, definition, synonyms).
FIELDS: dict[str, tuple[str, str, list[str]]] = {
    "Reference": (
        "str",
        "Unique identifier or reference number for the insured location or risk (e.g. policy/location ID, loc number).",
        ["Ref", "Loc #", "Location #", "Loc No", "Location No", "Location ID", "Loc ID", "Pol No", "Policy No",
         "Site ID", "Risk ID", "Item No", "Item #", "Loc Num", "Location Number"],
    ),
    "Address": (
        "str",
        "Street address of the insured property.",
        ["Street", "Street Address", "Addr", "Property Address", "Site Address", "Location Address"],
    ),
    "City": (
        "str",
        "City where the insured property is located.",
        ["City Name", "Town", "Municipality", "Locality"],
    ),
    "State": (
        "str",
        "US state abbreviation (e.g. CA, TX, NY).",
        ["ST", "Province", "St.", "State Code"],
    ),
    "Zip": (
        "int",
        "5-digit US postal code (integer).",
        ["ZIP Code", "Postal Code", "Zip Code", "Post Code", "Zipcode", "Zip+4", "Zip Code (5 digit)"],
    ),
    "County": (
        "str",
        "County where the insured property is located.",
        ["Parish", "Borough", "District"],
    ),
    "Country": (
        "str",
        "Country where the insured property is located (e.g. USA, US).",
        ["Nation", "Country Code", "Country Name", "Ctry"],
    ),
    "Building Value": (
        "float",
        "Replacement cost value of the building/structure (currency, float). Also known as Building RCV, Bldg Repl Cost.",
        ["Building", "Building Values", "Bldg Value", "Bldg Repl Cost", "Building RCV", "Bldg RCV",
         "Replacement Cost", "TIV-Bldg", "Building TIV", "Structure Value", "Bldg Val"],
    ),
    "Contents": (
        "float",
        "Insured value of contents within the building (currency, float). Also known as Contents Value.",
        ["Contents Value", "Cont Value", "Contents TIV", "TIV-Contents", "Personal Property",
         "Business Personal Property", "BPP"],
    ),
    "BI": (
        "float",
        "Business Interruption value (currency, float). Also known as Time Element, BI/EE.",
        ["Business Interruption", "Business Interruption Value", "BI Value", "Time Element", "BI/EE", "BI EE",
         "Business Income", "Extra Expense", "Loss of Rents", "Rental Value"],
    ),
    "Occupancy": (
        "str",
        "Occupancy class or type of use (e.g. Office, Retail, Warehouse). May be a code.",
        ["Occ", "Occ Code", "Occupancy Class", "Use", "Building Use", "Property Type", "Occ Type"],
    ),
    "Construction": (
        "str",
        "Construction type of the building (e.g. Frame, Masonry, Steel). May be a code.",
        ["Const", "Const Code", "Construction Type", "Build Type", "Frame Type", "ISO Construction"],
    ),
    "Storeys": (
        "int",
        "Number of floors/storeys in the building (integer, typically 1–100).",
        ["Stories", "Floors", "No of Floors", "Num Floors", "Num Stories", "No of Stories", "# of Stories",
         "Number of Stories", "Num of Storeys", "Floor Count", "# Floors", "# Floor"],
    ),
    "Number of Buildings": (
        "int",
        "Number of buildings at the location (integer, >= 1).",
        ["Num Bldgs", "# Bldgs", "No of Bldgs", "Bldg Count", "No of Buildings", "# of Buildings",
         "Num Buildings", "Building Count"],
    ),
    "Year Built": (
        "int",
        "Year the building was originally constructed (integer, 1700–current year).",
        ["Yr Blt", "Yr Built", "Year of Construction", "Built Year", "Construct Year", "Build Year",
         "Year Constructed"],
    ),
    "Fire Sprinklers (Y/N)": (
        "str",
        "Whether fire sprinklers are present. Valid values: Y, N, Y13, Y(13R), etc.",
        ["Fire Prot", "Fire Protection", "Sprinklers", "Sprinkler", "Sprinklered", "% Sprinklered",
         "Sprinkler %", "Fire Sprinkler", "Sprinkler System", "SPRK", "Sprink", "Fire Prot.", "Sprk Sys"],
    ),
    "Other": (
        "float",
        "Other/additional insured value not covered by Building, Contents, or BI (currency, float).",
        ["Other Value", "Other TIV", "Misc Value", "Miscellaneous", "Other Covered", "Add'l Value"],
    ),
}

TARGET_FIELDS = list(FIELDS)
TARGET_DTYPES = {f: spec[0] for f, spec in FIELDS.items()}
TARGET_DEFINITIONS = {f: spec[1] for f, spec in FIELDS.items()}
TARGET_SYNONYMS = {f: spec[2] for f, spec in FIELDS.items()}

MONETARY_FIELDS = [f for f, t in TARGET_DTYPES.items() if t == "float"]
INTEGER_FIELDS = [f for f, t in TARGET_DTYPES.items() if t == "int"]
STRING_FIELDS = [f for f, t in TARGET_DTYPES.items() if t == "str"]
PLACE_FIELDS = ["City", "County", "Country"]
CODE_FIELDS = ["Occupancy", "Construction"]

# US state and territory codes.
STATE_CODES = """
AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ
NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR GU VI AS MP
""".split()

# State and territory names -> code.
STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "american samoa": "AS", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "guam": "GU", "hawaii": "HI",
    "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE",
    "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "northern mariana islands": "MP", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "puerto rico": "PR", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "u.s. virgin islands": "VI", "us virgin islands": "VI", "utah": "UT", "vermont": "VT",
    "virgin islands": "VI", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY",
}

# Canonical sprinkler codes, informal spellings, and spellings that look like a code.
SPRINKLER_CODES = ["Y", "N", "Y13", "Y(13R)"]
SPRINKLER_ALIASES = {
    "yes": "Y", "true": "Y", "1": "Y", "no": "N", "false": "N", "0": "N",
    "y 13": "Y13", "y13r": "Y(13R)", "y (13r)": "Y(13R)",
}
SPRINKLER_LOOKALIKES = ["Y", "N", "YES", "NO", "Y13", "Y(13R)", "TRUE", "FALSE", "1", "0",
                        "Y 13", "Y(13 R)", "SPRINKLERED", "NON-SPRINKLERED"]

# Words that mark a street address, and words that mark a total row.
STREET_WORDS = ["street", "st", "ave", "avenue", "blvd", "boulevard", "rd", "road", "dr", "drive",
                "ln", "lane", "way", "place", "pl", "court", "ct"]
TOTAL_WORDS = ["total", "grand total", "subtotal", "sum", "footer"]

KEYS = ["file_id", "sheet_name"]

_SPARK_TYPES = {"str": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType()}

# Cleaned output: every field nullable, in the exact order above.
OUTPUT_SCHEMA = T.StructType([T.StructField(f, _SPARK_TYPES[t], True) for f, t in TARGET_DTYPES.items()])


def spark_type(field: str) -> T.DataType:
    return _SPARK_TYPES[TARGET_DTYPES[field]]


def corpus() -> list[tuple[int, str, str, str]]:
    """Matching corpus in field order as (idx, text, target, kind): name, definition, synonyms."""
    entries = []
    for field in TARGET_FIELDS:
        entries.append((field, field, "field"))
        entries.append((TARGET_DEFINITIONS[field], field, "definition"))
        entries.extend((s, field, "synonym") for s in TARGET_SYNONYMS[field])
    return [(i, *e) for i, e in enumerate(entries)]
