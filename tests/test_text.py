import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import features, text

NAMES = {
    "Orelee's Barbershop": "orelee s barbershop", "B+ Retail Inc": "b retail inc", "A & B Company": "a and b company", "  Spaces   ": "spaces",
    None: "", "nan": "", "None": "", "nan!": "nan", "A_B": "a_b", "महाराष्ट्र": "मह र ष ट र", "ＡＢＣ Ltd": "abc ltd", "K ＆ Co": "k and co", "ﬁn x": "fin x",
    "Société": "société", "": "",
}
STRIPPED = {"Custom Wealth Services LLC": "custom wealth", "Acme Corporation": "acme", "Acme Private Limited": "acme", "Acme Pvt Ltd": "acme", "LLC Services": "", "Air India": "air", "Société Anonyme": "société anonyme", "Incline": "incline"}
ADDRESSES = {
    "1795 Westchester Drive": "1795 westchester drive", "123 Main St, Apt 4": "123 main street apartment 4", "0337 Oakland Ave": "337 oakland avenue",
    "Columbus, OH": "columbus ohio", "Miami, FL": "miami floor", "St. Paul, MN": "street paul manipur", "12 Av Foch": "12 av foch",
    "Rue de la Paix": "rue delaware ladakh paix", "A007": "a007", "1.05": "1 5", "00": "0", None: "", "5 Goa Unit": "5 goa unit",
}
NUMBERS = {"123 Main St Apt 4B": ["123", "4"], "0337 Oakland": ["337"], None: [], "10 9 10": ["10", "9"], "A007": ["007"]}
COUNTRIES = {"US": "us", "United States": "us", " INDIA ": "india", "France": "france", "FR": "france", "Peru": "peru", None: "", "U.S.": "us"}


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(make(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


@pytest.mark.parametrize(
    ("cases", "make"),
    [(NAMES, text.normalize_name), (STRIPPED, text.normalize_name_stripped), (ADDRESSES, text.normalize_address), (NUMBERS, text.extract_numbers), (COUNTRIES, text.normalize_country)],
)
def test_cases(spark, cases, make):
    assert column(spark, cases, make) == list(cases.values())


def test_ascii_and_tokens(spark):
    assert column(spark, ["Café Noir", "महा", "A_B", "X & Y", None], text.normalize_ascii) == ["caf noir", "", "a b", "x and y", ""]
    assert column(spark, ["a and b company", "", "zz aa zz b"], text.tokenize) == [["and", "company"], [], ["aa", "zz"]]


def test_key_needs_both_parts(spark):
    rows = spark.createDataFrame([("Acme", "1 St"), ("Acme", ""), (None, "1 St")], "n string, a string")
    assert [r[0] for r in rows.select(text.build_name_address_key(F.col("n"), F.col("a"))).collect()] == ["acme||1 street", "", ""]


def test_unicode_none_equals_nfkc_for_stable_text(spark):
    values = ["Acme & Co", "Société", "12 Main St"]
    assert column(spark, values, lambda c: text.normalize_name(c, "none")) == column(spark, values, text.normalize_name)
    with pytest.raises(ValueError):
        text.nfkc(F.col("x"), "nfd")


def test_prepare_equals_single_functions(spark):
    rows = spark.createDataFrame([("1", "ＡＢＣ & Co LLC", "0337 Oakland Ave", "USA"), ("2", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    a, b = text.prepare(rows).orderBy("entity_id").collect()
    assert (a.name_key, a.name_stripped_key, a.address_key, a.country) == ("abc and co llc", "abc and", "337 oakland avenue", "us")
    assert a.address_tokens == ["0337", "ave", "oakland"] and a.ascii_name == "and co llc"
    assert (b.name_key, b.address_key, b.country, b.name_tokens) == ("", "", "", [])


def plain_name(x):
    import re

    x = "" if x is None else x.strip()
    x = "" if x.lower() in text.NULL_WORDS else x
    x = unicodedata.normalize("NFKC", x).lower().replace("&", " and ")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x)).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ&_.-'éß９ﬁ̀  \x1c\t 한中٣0"), max_size=12), min_size=40, max_size=80))
def test_names_like_plain_python(spark, values):
    assert column(spark, values, text.normalize_name) == [plain_name(v) for v in values]


def test_features(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"], "kitten", "sitting"), ([], [], "", "")], "x array<string>, y array<string>, s string, t string")
    got = rows.select(features.jaccard(F.col("x"), F.col("y")), features.levenshtein_similarity(F.col("s"), F.col("t")), features.indel_ratio(F.col("s"), F.col("t")), features.shared_numbers(F.col("x"), F.col("y"))).collect()
    assert [round(v, 4) if isinstance(v, float) else v for v in got[0]] == [0.3333, 0.5714, 61.5385, True]
    assert list(got[1]) == [0.0, 1.0, 100.0, False]
