"""Values of functions, nulls and odd inputs among them."""

import datetime

import pytest
from pyspark.sql import functions as F

from tributary.functions.comparisons import COST
from tributary.functions.registry import COMPARISONS, FEATURES
from tributary.functions.strings import jaro_winkler_similarity, metaphone_of
from tributary.functions import features, comparisons  # noqa: F401


def lit(v):
    return F.lit(v) if v is not None else F.lit(None).cast("string")


def value(spark, registry, name, *args, **params):
    return spark.range(1).select(registry.call(name, *(a if hasattr(a, "_jc") else lit(a) for a in args), **params).alias("v")).first().v


FEATURE_VALUES = [
    ("name_clean", ["Mary Ann-Lee 3"], "MARY ANN-LEE"), ("name_clean", ["42"], None), ("name_clean", [None], None), ("name_clean_strict", ["O'Brien-Lee  x"], "OBRIENLEE X"),
    ("extract_salutation", ["Dr. Who"], "DR"), ("extract_salutation", ["Drew"], None), ("strip_salutation", ["mr  smith"], "SMITH"), ("extract_suffix", ["John Smith III"], "III"),
    ("strip_suffix", ["John Smith Jr."], "JOHN SMITH"), ("word_count", ["a b c"], 3), ("word_count", [None], None), ("first_word", [" a b"], "a"), ("last_word", ["a b "], "b"), ("initials", ["John Adam Smith"], "JAS"),
    ("strip_business_suffix", ["Acme Holdings"], "ACME"), ("nickname_canonical", [" bob "], "ROBERT"), ("nickname_canonical", ["jon"], "JOHN"), ("nickname_canonical", ["pat"], "PATRICK"), ("nickname_canonical", ["Zoe"], "ZOE"), ("nickname_canonical", [None], None),
    ("is_compound_name", ["Jane & Joe"], 1), ("is_compound_name", ["Andy"], 0), ("is_compound_name", [None], 0), ("compound_pattern", ["Mr. and Mrs. Smith"], "title_pair"), ("compound_pattern", ["The Johnson Family"], "family"),
    ("extract_compound_first", ["Jane and Joe Smith"], "JANE"), ("extract_compound_second", ["Jane and Joe Smith"], "JOE"), ("extract_compound_first", ["Mr. and Mrs. Smith"], None), ("extract_compound_second", ["John/Jane"], "JANE"),
    ("address_standardize", ["12 north Main Street,  Apartment 4"], "12 N MAIN ST, APT 4"), ("address_standardize", ["Streetcar Northeast"], "STREETCAR NE"), ("extract_street_number", ["12 Main"], "12"), ("extract_street_number", ["Main"], None),
    ("extract_street_name", ["12 Main St "], "MAIN ST"), ("extract_unit_number", ["1 A St apt 5b"], "5B"), ("sorted_name_tokens", ["smith  John"], "JOHN SMITH"), ("dba_extract", ["X Corp D/B/A Foo Bar"], "FOO BAR"), ("dba_extract", ["X"], None),
    ("business_type_extract", ["Acme Inc"], "INC"), ("business_core_name", ["Acme Corp DBA Widget Co"], "ACME"), ("phone_standardize", ["1-555-010-1234"], "5550101234"), ("phone_standardize", ["(555) 010-1234"], "5550101234"), ("phone_area_code", ["+1 555 010 1234"], "555"),
    ("email_domain", ["A@B.Com"], "b.com"), ("email_domain", ["none"], None), ("email_local_part", ["none"], "none"), ("email_local_part_safe", ["none"], None), ("email_domain_type", ["a@gmail.com"], "FREE"), ("email_is_role_address", ["Sales@x.com"], 1), ("email_is_role_address", [None], 0),
    ("email_domain_category", ["a@b.gov.uk"], "GOVERNMENT"), ("email_domain_category", ["x"], None), ("entity_type_classify", ["Acme LLC"], "BUSINESS"), ("entity_type_classify", ["City Hospital"], "ORGANIZATION"), ("entity_type_classify", [None], None),
    ("name_format_detect", ["Smith, John"], "REVERSED"), ("name_format_detect", ["Jane and Joe"], "COMPOUND"), ("name_format_detect", ["Cher"], "SINGLE"), ("is_multi_person", ["John or Jane"], 1), ("is_multi_person", [None], 0),
    ("extract_generational_suffix", ["Bob 2nd"], "2ND"), ("extract_roman_numeral", ["Phase II"], "II"), ("extract_roman_numeral", ["Malcolm X"], None), ("is_hoa_trust_careof", ["Smith C/O Jones"], 1), ("extract_numbered_entity_suffix", ["ABC #12"], "12"), ("geographic_qualifier", ["Bank of the Northwest"], "NORTHWEST"),
    ("is_placeholder_phone", ["999-999-9999"], 1), ("is_placeholder_phone", ["1234567890"], 1), ("is_placeholder_phone", ["5551234567"], 0), ("is_placeholder_email", ["No.Email@x.org"], 1), ("is_placeholder_email", ["joe@test.com"], 1), ("is_placeholder_name", [" john doe "], 1), ("is_placeholder_name", [None], 0),
    ("is_placeholder_address", ["00000"], 1), ("is_placeholder_ssn", ["222-22-2222"], 1), ("is_placeholder_ssn", ["222-22-2223"], 0), ("nullify_placeholder_name", ["N/A"], None), ("nullify_placeholder_email", ["joe@x.org"], "joe@x.org"), ("remove_diacritics", ["Éß Ñø"], "E NO"),
    ("length_category", ["abcde"], "M"), ("length_bucket", ["abcdefg"], 5), ("zip5", ["12345-6789"], "12345"), ("zip3", ["12345"], "123"), ("vin_normalize", ["1o-iq"], "1010"), ("policy_number_clean", ["00-a 1"], "A1"), ("npi_validate", ["1234567890"], "1234567890"), ("npi_validate", ["123"], None),
    ("duns_clean", ["12-345-6789"], "123456789"), ("mrn_clean", ["00-ab1"], "AB1"), ("ticker_normalize", ["b.rk a"], "BRKA"), ("soundex", ["Robert"], "R163"), ("metaphone", ["Knight"], "NT"), ("concat", ["a", None, "b"], "a  b"), ("coalesce", [None, "b"], "b"), ("nullif_empty", ["  "], None),
]


@pytest.mark.parametrize("name, args, want", FEATURE_VALUES)
def test_feature_values(spark, name, args, want):
    assert value(spark, FEATURES, name, *args) == want


def test_counts_of_functions():
    assert (len(FEATURES.names()), len(COMPARISONS.names()), len(COST)) == (104, 54, 54)


def test_every_feature_takes_null_and_empty(spark):
    skip = {"geo_hash", "lat_lon_bucket", "haversine_distance", "year_of_date", "date_to_string", "dob_year", "age_from_dob", "dob_mmdd", "amount_bucket"}
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("x" * 5000,), ("日本 語",)], "c string")
    assert df.select(*(FEATURES.call(n, F.col("c")).alias(n) for n in FEATURES.names() if n not in skip)).count() == 5


def test_hashes_of_null(spark):
    assert value(spark, FEATURES, "farm_fingerprint", None) is None
    assert value(spark, FEATURES, "farm_fingerprint_concat", None, None) == value(spark, FEATURES, "farm_fingerprint_concat", "", "")
    assert value(spark, FEATURES, "nickname_match_key", "Bob") == value(spark, FEATURES, "nickname_match_key", "robert")


def test_geo(spark):
    assert value(spark, FEATURES, "geo_hash", F.lit(57.64911), F.lit(10.40744), precision=11) == "u4pruydqqvj"
    assert value(spark, FEATURES, "geo_hash", F.lit(42.605), F.lit(-5.603), precision=5) == "ezs42"
    assert abs(value(spark, FEATURES, "haversine_distance", F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522)) - 877.5) < 1


def test_dates(spark):
    d = F.lit(datetime.date(1990, 12, 31))
    assert value(spark, FEATURES, "date_to_string", d, fmt="%d/%m %Y at") == "31/12 1990 at"
    assert value(spark, COMPARISONS, "date_within_years", d, F.lit(datetime.date(1991, 1, 1)), years=0) is False
    assert value(spark, COMPARISONS, "date_within_months", d, F.lit(datetime.date(1991, 1, 1)), months=1) is True


COMPARISON_VALUES = [
    ("exact", "a", None, {}, False), ("exact_or_null", "a", None, {}, True), ("different", "a", None, {}, False), ("null_either", None, None, {}, True), ("exact_diacritics_insensitive", "José", "JOSE", {}, True),
    ("levenshtein", "kitten", "sitting", {"max_distance": 3}, True), ("levenshtein", "kitten", "sitting", {"max_distance": 2}, False), ("levenshtein_normalized", "", "", {}, False), ("levenshtein_score", None, "a", {}, 0.0),
    ("jaro_winkler", "MARTHA", "marhta", {"threshold": 0.96}, True), ("soundex_match", "Robert", "Rupert", {}, True), ("metaphone_match", "Smith", "Smyth", {}, True), ("double_metaphone_match", "Church", "Kurk", {}, True),
    ("contains", "abc", "b", {}, True), ("starts_with", "a", "abc", {}, False), ("abbreviation_match", "rob", "Robert", {}, True), ("token_set_match", "a b", "b a", {}, True), ("initials_match", "John Smith", "Jane Snow", {}, True),
    ("dice_coefficient_score", "a b", "b c", {}, 0.5), ("overlap_coefficient_score", "a b", "b", {}, 1.0), ("monge_elkan_score", "abc", "abd", {}, 2 / 3), ("token_sort_ratio_score", "b a", "A  b", {}, 1.0),
    ("jaccard_ngram_score", "night", "nacht", {}, 1 / 7), ("jaccard_ngram", "a", "a", {}, False), ("regex_match", "a1", "b2", {"pattern": "[0-9]"}, True), ("length_mismatch", "a", "abcdefgh", {}, True),
]


@pytest.mark.parametrize("name, left, right, params, want", COMPARISON_VALUES)
def test_comparison_values(spark, name, left, right, params, want):
    got = value(spark, COMPARISONS, name, left, right, **params)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_numbers(spark):
    assert value(spark, COMPARISONS, "numeric_ratio", F.lit(0.0), F.lit(0.0)) is False
    assert value(spark, COMPARISONS, "numeric_percent_diff", F.lit(100.0), F.lit(95.0)) is True
    assert value(spark, COMPARISONS, "numeric_ratio_score", F.lit(-9.0), F.lit(10.0)) == pytest.approx(0.9)


def test_jaro_winkler_boosts_low_scores_too():
    assert jaro_winkler_similarity("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler_similarity("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler_similarity("ABCVWXYZ", "ABCDEFGH") == pytest.approx(0.708, abs=1e-3)
    assert jaro_winkler_similarity("", "a") == 0.0 and jaro_winkler_similarity("", "") == 1.0


def test_metaphone_codes():
    assert metaphone_of("Thomas")[0] == "0MS" and metaphone_of("Thomas")[1] == "TMS" and metaphone_of("Phone")[0] == "FN" and metaphone_of("")[0] == ""


def test_unknown_names_and_parameters(spark):
    with pytest.raises(KeyError):
        FEATURES.get("nothing")
    with pytest.raises(TypeError):
        FEATURES.call("name_clean", F.lit("a"), size=3)
