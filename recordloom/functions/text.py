"""Text cleaning as Column expressions.

Everything is built-in except Unicode normalization (``nfkc``), which has no
built-in and runs as one Arrow batch call. ``unicode="none"`` leaves it out for
inputs known to be NFKC-stable. Null is empty throughout.

Two normalizers are kept apart on purpose: ``normalize_name`` and
``normalize_address`` (Unicode-aware) and ``normalize_ascii`` (ASCII only).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: patterns -------------------------------------------------
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"

# --- fixed values: whole texts that stand for nothing -----------------------
NULL_WORDS = ("nan", "none", "null", "")

# --- fixed values: legal suffixes of business names -------------------------
LEGAL_SUFFIXES = (
    "private limited", "private ltd", "public limited", "pvt limited", "pvt ltd", "llp", "llc", "incorporated",
    "corporation", "limited", "company", "corp", "ltd", "inc", "lp", "plc", "co", "societe anonyme",
    "societe en commandite", "societe par actions simplifiee", "sas", "sarl", "sca", "snc", "sci", "eurl", "eirl",
    "pvt", "opc", "ngo", "trust", "society", "foundation", "associates", "enterprises", "solutions", "services",
    "group", "trading", "international", "global", "india", "centre", "center", "partners",
)

# --- fixed values: address abbreviations ------------------------------------
ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "pkwy": "parkway", "hwy": "highway", "fwy": "freeway", "sq": "square", "ft": "fort", "mt": "mount",
    "pt": "point", "pts": "point", "jct": "junction", "nc": "north carolina", "oh": "ohio", "in": "indiana",
    "tx": "texas", "ca": "california", "fl": "floor", "ny": "new york", "pa": "pennsylvania", "ga": "georgia",
    "va": "virginia", "ma": "massachusetts", "md": "maryland", "az": "arizona", "co": "colorado", "wi": "wisconsin",
    "mn": "manipur", "mo": "missouri", "wa": "washington", "or": "oregon", "sc": "south carolina", "mi": "michigan",
    "al": "alabama", "la": "ladakh", "nj": "new jersey", "ks": "kansas", "ky": "kentucky", "ne": "nebraska",
    "nv": "nevada", "nm": "new mexico", "wv": "west virginia", "ms": "mississippi", "ar": "arkansas", "iowa": "iowa",
    "ok": "oklahoma", "ut": "utah", "me": "maine", "nh": "new hampshire", "vt": "vermont", "ri": "rhode island",
    "de": "delaware", "nd": "north dakota", "sd": "south dakota", "wy": "wyoming", "id": "idaho", "hi": "hawaii",
    "ak": "alaska", "mh": "maharashtra", "wb": "west bengal", "up": "uttar pradesh", "mp": "madhya pradesh",
    "ka": "karnataka", "kl": "kerala", "ap": "andhra pradesh", "ts": "telangana", "tg": "telangana", "hr": "haryana",
    "pb": "punjab", "rj": "rajasthan", "gu": "gujarat", "br": "bihar", "jh": "jharkhand", "cg": "chhattisgarh",
    "ua": "uttarakhand", "hp": "himachal pradesh", "sk": "sikkim", "mz": "mizoram", "nl": "nagaland",
    "ml": "meghalaya", "tr": "tripura", "as": "assam", "goa": "goa", "dl": "delhi", "chandigarh": "chandigarh",
    "jk": "jammu kashmir", "apt": "apartment", "ste": "suite", "unit": "unit",
}

# --- fixed values: country aliases ------------------------------------------
COUNTRY_ALIASES = {
    "united states": "us", "usa": "us", "u.s.a.": "us", "u.s.": "us", "america": "us", "india": "india",
    "bharat": "india", "france": "france", "fr": "france", "french republic": "france",
}

#: Between the parts of a name-and-address key.
KEY_SEPARATOR = "||"


def _map(values: dict[str, str]) -> Column:
    """A constant map, as one parsed expression."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_string(c: Column) -> Column:
    """Trimmed of any white space; null and the null words are empty."""
    trimmed = _trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(trimmed).isin(*NULL_WORDS), F.lit("")).otherwise(trimmed)


def nfkc(c: Column, unicode: str = "nfkc") -> Column:
    """Unicode compatibility normalization; diacritics stay."""
    if unicode not in ("nfkc", "none"):
        raise ValueError(f"unicode: {unicode}")
    return _normal(c) if unicode == "nfkc" else c


def _normal(c: Column) -> Column:
    """Only texts beyond ASCII cross to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def _plain(normal: Column) -> Column:
    """Lower case, ``&`` as a word, punctuation as single spaces; of a text that is clean and normal."""
    words = F.replace(F.lower(normal), F.lit("&"), F.lit(" and "))
    return _trim(F.regexp_replace(F.regexp_replace(words, NOT_WORD, " "), f"{SPACE}+", " "))


def normalize_name(c: Column, unicode: str = "nfkc") -> Column:
    return _plain(nfkc(clean_string(c), unicode))


def strip_suffixes(name: Column) -> Column:
    """A normalized name without the legal suffixes at its end, however many; maybe empty."""
    return F.regexp_replace(name, "((^| )(" + "|".join(LEGAL_SUFFIXES) + "))+$", "")


def normalize_name_stripped(c: Column, unicode: str = "nfkc") -> Column:
    return strip_suffixes(normalize_name(c, unicode))


def strip_leading_zeros(token: Column) -> Column:
    return F.regexp_replace(token, r"^0+(\p{Nd})", "$1")


def expand_abbreviation(token: Column) -> Column:
    """Looked up once; entries that stand for themselves need no lookup, and no other key is longer than four."""
    table = {k: v for k, v in ABBREVIATIONS.items() if k != v}
    longest = max(map(len, table))
    return F.when(F.length(token) <= longest, F.coalesce(F.try_element_at(_map(table), token), token)).otherwise(token)


def expand_address(plain: Column) -> Column:
    """A punctuation-free address with leading zeros stripped and abbreviations expanded, token by token."""
    return F.array_join(F.transform(F.split(plain, " "), lambda t: expand_abbreviation(strip_leading_zeros(t))), " ")


def normalize_address(c: Column, unicode: str = "nfkc") -> Column:
    return expand_address(normalize_name(c, unicode))


def extract_numbers(c: Column) -> Column:
    """Distinct digit runs of the raw text, sorted as strings, leading zeros stripped."""
    stripped = F.regexp_replace(clean_string(c), r"(?<![\p{L}\p{N}_])0+(\p{Nd})", "$1")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(stripped, F.lit(r"\p{Nd}+"), F.lit(0))))


def tokenize(normalized: Column) -> Column:
    """Distinct tokens of at least two characters, sorted; of a normalized text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.char_length(t) >= 2)))


def normalize_country(c: Column) -> Column:
    """Lower case, with the known aliases; any other label stays."""
    low = _trim(F.lower(clean_string(c)))
    return F.coalesce(F.try_element_at(_map(COUNTRY_ALIASES), low), low)


def normalize_ascii(c: Column) -> Column:
    """The baseline's form: ASCII letters and digits only."""
    words = F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))


build_name_key, build_name_stripped_key, build_address_key = normalize_name, normalize_name_stripped, normalize_address


def combine_keys(name: Column, address: Column) -> Column:
    """Both keys in one; empty if either is."""
    return F.when((name != "") & (address != ""), F.concat(name, F.lit(KEY_SEPARATOR), address)).otherwise(F.lit(""))


def build_name_address_key(name: Column, address: Column, unicode: str = "nfkc") -> Column:
    return combine_keys(normalize_name(name, unicode), normalize_address(address, unicode))


def prepare(records: DataFrame, unicode: str = "nfkc") -> DataFrame:
    """entity_id, country key and all blocking keys of ``records``: one Arrow exchange at most.

    Columns: entity_id, country, name_key, name_stripped_key, address_key, name_tokens,
    address_tokens (of the address without expansion), ascii_name, ascii_address.
    """
    cleaned = records.select(
        "entity_id",
        normalize_country(F.col("country")).alias("country"),
        clean_string(F.col("business_name")).alias("n"),
        clean_string(F.col("business_address")).alias("a"),
        normalize_ascii(F.col("business_name")).alias("ascii_name"),
        normalize_ascii(F.col("business_address")).alias("ascii_address"),
    )
    if unicode == "nfkc":
        # both calls share one Arrow exchange; one whose column nobody reads is pruned
        cleaned = cleaned.withColumns({"n": _normal(F.col("n")), "a": _normal(F.col("a"))})
    plain = cleaned.withColumns({"n": _plain(F.col("n")), "a": _plain(F.col("a"))})
    return plain.select(
        "entity_id",
        "country",
        F.col("n").alias("name_key"),
        strip_suffixes(F.col("n")).alias("name_stripped_key"),
        expand_address(F.col("a")).alias("address_key"),
        tokenize(F.col("n")).alias("name_tokens"),
        tokenize(F.col("a")).alias("address_tokens"),
        "ascii_name",
        "ascii_address",
    )
