"""Plate-text column functions. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State codes in stored order (order decides ties between equally close codes).
STATES = {
    "AN": "Andaman and Nicobar Islands",
    "AP": "Andhra Pradesh",
    "AR": "Arunachal Pradesh",
    "AS": "Assam",
    "BR": "Bihar",
    "CG": "Chhattisgarh",
    "CH": "Chandigarh",
    "DD": "Dadra and Nagar Haveli and Daman and Diu",
    "DL": "Delhi",
    "DN": "Dadra and Nagar Haveli",
    "GA": "Goa",
    "GJ": "Gujarat",
    "HP": "Himachal Pradesh",
    "HR": "Haryana",
    "JH": "Jharkhand",
    "JK": "Jammu and Kashmir",
    "KA": "Karnataka",
    "KL": "Kerala",
    "LA": "Ladakh",
    "LD": "Lakshadweep",
    "MH": "Maharashtra",
    "ML": "Meghalaya",
    "MN": "Manipur",
    "MP": "Madhya Pradesh",
    "MZ": "Mizoram",
    "NL": "Nagaland",
    "OD": "Odisha",
    "OR": "Odisha",
    "PB": "Punjab",
    "PN": "Punjab",
    "PY": "Puducherry",
    "RJ": "Rajasthan",
    "SK": "Sikkim",
    "TN": "Tamil Nadu",
    "TG": "Telangana",
    "TR": "Tripura",
    "TS": "Telangana",
    "UA": "Uttarakhand",
    "UK": "Uttarakhand",
    "UP": "Uttar Pradesh",
    "WB": "West Bengal",
}
BH_NAME = "Bharat Series"

# Characters a reader confuses, by the kind of slot they stand in.
LETTER_SLOT_FIXES = {"0": "O", "1": "I", "2": "Z", "4": "A", "5": "S", "6": "G", "8": "B"}
DIGIT_SLOT_FIXES = {
    "O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "T": "7",
}
# Letters that may stand for a character inside a state code.
STATE_CHAR_OPTIONS = {
    "0": "ODQ", "1": "IL", "2": "Z", "4": "A", "5": "S", "6": "G", "8": "B",
    "O": "DQC", "D": "O", "Q": "O", "C": "GO", "G": "C", "I": "L", "L": "I", "V": "Y", "Y": "V",
}
# Plate layouts as (tag, digits after the state code, letters after those digits).
SLOT_LAYOUTS = (
    ("indian_8", 1, 1),
    ("indian_9a", 1, 2),
    ("indian_9b", 2, 1),
    ("indian_10a", 1, 3),
    ("indian_10b", 2, 2),
    ("indian_11", 2, 3),
)
STANDARD_FORMAT = "^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{1,4}$"
BH_FORMAT = "^[0-9]{2}BH[0-9]{4}[A-Z]{1,2}$"


def normalize_plate(c: Column) -> Column:
    """ASCII letters and digits, upper case; null becomes empty. Stripping first keeps case mapping ASCII."""
    return F.coalesce(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def registry_key(c: Column) -> Column:
    """Any Unicode letter or digit, upper case: the key registry lookups compare."""
    return F.upper(F.regexp_replace(c, "[^\\p{L}\\p{Nd}]", ""))


def lookup_key(c: Column) -> Column:
    """Registry key of a plate read; null (never matches) for blank reads."""
    return F.when(c.rlike("\\S"), registry_key(c))


# Each predicate is one pattern, so it reads its argument once and stays small when inlined.
_CODES = "(?:" + "|".join(STATES) + ")"
_ANY_FORMAT = f"(?:{STANDARD_FORMAT[1:-1]}|{BH_FORMAT[1:-1]})"
KNOWN_STATE = f"^(?:..BH|{_CODES})"
KNOWN_FORMAT = f"^(?:{_CODES}{STANDARD_FORMAT[9:-1]}|{BH_FORMAT[1:-1]})$"
VALID_FORMAT = f"^(?=.{{6,12}}$){_ANY_FORMAT}$"
MIXED_TEXT = "^(?=.*[A-Z])(?=.*[0-9]).{6,12}$"


def is_known_state(n: Column) -> Column:
    return n.rlike(KNOWN_STATE)


def state_code(n: Column) -> Column:
    return F.when(F.substring(n, 3, 2) == "BH", F.lit("BH")).otherwise(F.regexp_extract(n, f"^{_CODES}", 0))


def is_settled(n: Column) -> Column:
    """In a known layout with a known state: nothing can score higher."""
    return n.rlike(KNOWN_FORMAT)


def format_score(n: Column) -> Column:
    return (
        F.when(n.rlike(KNOWN_FORMAT), F.lit(0.98))
        .when(n.rlike(f"^{_ANY_FORMAT}$"), F.lit(0.9))
        .when(n.rlike(MIXED_TEXT), F.lit(0.45))
        .otherwise(F.lit(0.0))
    )


def length_penalty(n: Column) -> Column:
    return (
        F.when(n.rlike(f"^(?:{_ANY_FORMAT}|.{{8,11}})$"), F.lit(0.0))
        .when(F.length(n).between(6, 13), F.lit(0.02))
        .otherwise(F.lit(0.05))
    )


def is_valid_format(n: Column) -> Column:
    return n.rlike(VALID_FORMAT)


#: Texts up to this length may differ by one edit only.
SHORT = 7


def similar(a: Column, b: Column) -> Column:
    """Same plate up to reading noise: one edit for short texts, two otherwise; empties never match."""
    longest = F.greatest(F.length(a), F.length(b))
    limit = F.when(longest <= SHORT, 1).otherwise(2)
    return (
        (F.length(a) > 0)
        & (F.length(b) > 0)
        & (F.abs(F.length(a) - F.length(b)) <= 2)
        # Bounded distance: -1 past two edits.
        & F.levenshtein(a, b, 2).between(F.lit(0), limit)
    )


def parse_positions(c: Column) -> Column:
    """Comma-separated metres as array<double>, blanks dropped."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("double"))
