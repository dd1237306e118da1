"""Feature functions: expressions of columns, all evaluated in the JVM but the metaphone codes.

Null inputs give null unless a function says otherwise. Extraction gives null, not '', where
nothing is found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .registry import feature
from .strings import metaphone_code

EARTH_KM = 6371.0088


def text(c: Column) -> Column:
    return c.cast("string")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def without(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def digits(c: Column) -> Column:
    return without(text(c), "[^0-9]")


def flag(condition: Column) -> Column:
    """1 or 0, and 0 for null."""
    return F.when(condition, 1).otherwise(0)


def fingerprint(c: Column) -> Column:
    """A 64-bit hash; null of null."""
    return F.when(c.isNotNull(), F.xxhash64(text(c)))


def words(c: Column) -> Column:
    return F.split(F.trim(c), " ", -1)


def squeezed(c: Column) -> Column:
    return F.trim(without(c, r"\s+", " "))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


# names


@feature()
def name_clean(c: Column) -> Column:
    return F.nullif(F.upper(squeezed(without(c, r"[^a-zA-Z\s\-]"))), F.lit(""))


@feature()
def name_clean_strict(c: Column) -> Column:
    return F.nullif(F.upper(squeezed(without(c, r"[^a-zA-Z\s]"))), F.lit(""))


@feature()
def first_letter(c: Column) -> Column:
    return F.substring(c, 1, 1)


@feature()
def first_n_chars(c: Column, length: int = 3) -> Column:
    return F.substring(c, 1, length)


@feature()
def extract_salutation(c: Column) -> Column:
    return found(F.upper(c), rf"^({K.SALUTATION})[.\s]")


@feature()
def strip_salutation(c: Column) -> Column:
    return F.trim(without(F.upper(c), rf"^({K.SALUTATION})[.\s]+"))


@feature()
def extract_suffix(c: Column) -> Column:
    return found(F.upper(c), rf"\b({K.NAME_SUFFIX})\b")


@feature()
def strip_suffix(c: Column) -> Column:
    return F.trim(without(F.upper(c), rf"\b({K.NAME_SUFFIX})\b\.?\s*$"))


@feature()
def word_count(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(words(c)))


@feature()
def first_word(c: Column) -> Column:
    return words(c)[0]


@feature()
def last_word(c: Column) -> Column:
    return F.element_at(words(c), -1)


@feature()
def initials(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w: F.substring(w, 1, 1)), "")


@feature()
def strip_business_suffix(c: Column) -> Column:
    return F.trim(without(F.upper(c), rf"\b({K.BUSINESS_SUFFIX})\.?\s*$"))


@feature()
def nickname_canonical(c: Column) -> Column:
    name = F.upper(F.trim(c))
    full: dict[str, str] = {}
    for canonical, shorts in K.NICKNAMES.items():
        for short in shorts:
            full.setdefault(short, canonical)
    table = F.create_map(*(F.lit(x) for pair in full.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)


@feature()
def nickname_match_key(c: Column) -> Column:
    return fingerprint(nickname_canonical(c))


def _conjunction(c: Column) -> Column:
    return F.upper(c).rlike(r"\bAND\b") | c.rlike(r"\s[&+]\s")


@feature()
def is_compound_name(c: Column) -> Column:
    return flag(_conjunction(c) | F.upper(c).rlike(K.TITLE_PAIR) | F.upper(c).rlike(K.FAMILY) | c.rlike(K.SLASH))


@feature()
def compound_pattern(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.rlike(K.TITLE_PAIR), "title_pair").when(up.rlike(K.FAMILY), "family").when(c.rlike(K.SLASH), "slash").when(_conjunction(c), "conjunction")


@feature()
def extract_compound_first(c: Column) -> Column:
    return F.coalesce(found(F.upper(c), r"^(\w+)\s+(?:AND|&|\+)\s+\w+"), found(F.upper(c), r"^(\w+)\s*/\s*\w+"))


@feature()
def extract_compound_second(c: Column) -> Column:
    return F.coalesce(found(F.upper(c), r"^\w+\s+(?:AND|&|\+)\s+(\w+)"), found(F.upper(c), r"^\w+\s*/\s*(\w+)"))


# addresses


@feature()
def address_standardize(c: Column) -> Column:
    """Upper case with postal abbreviations; one look-up for each word, as no abbreviation is
    itself abbreviated."""
    table = F.create_map(*(F.lit(x) for pair in K.STREET_WORDS.items() for x in pair))
    # Words and what stands between them, in turn.
    parts = F.regexp_extract_all(F.upper(c), F.lit(r"(\w+|\W+)"), 1)
    return squeezed(F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), w)), ""))


@feature()
def extract_street_number(c: Column) -> Column:
    return found(c, r"^(\d+)")


@feature()
def extract_street_name(c: Column) -> Column:
    return F.trim(found(F.upper(c), r"^\d+\s+(.+?)\s*$"))


@feature()
def extract_unit_number(c: Column) -> Column:
    return found(F.upper(c), K.UNIT)


# blocking keys


@feature()
def farm_fingerprint(c: Column) -> Column:
    return fingerprint(c)


@feature()
def farm_fingerprint_concat(*cols: Column) -> Column:
    """Nulls count as empty, so the key is never null."""
    joined = [x for c in cols for x in (F.lit("||"), F.coalesce(text(c), F.lit("")))][1:]
    return F.xxhash64(F.concat(*joined))


@feature()
def identity(c: Column) -> Column:
    return c


@feature()
def sorted_name_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(words(F.upper(c)), lambda w: w != "")), " ")


@feature()
def sorted_name_fingerprint(c: Column) -> Column:
    return fingerprint(sorted_name_tokens(c))


@feature()
def name_fingerprint(c: Column) -> Column:
    return fingerprint(without(F.upper(c), "[^A-Z]"))


# businesses


@feature()
def dba_extract(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.rlike(rf"\b({K.DBA})\b"), F.trim(found(up, rf"(?:{K.DBA})[\s:.\-]*(.+)$")))


@feature()
def dba_normalize(c: Column) -> Column:
    return F.upper(squeezed(without(without(c, rf"\b({K.DBA_NOISE})\b"), "[^A-Za-z0-9 ]")))


@feature()
def business_type_extract(c: Column) -> Column:
    return found(F.upper(c), rf"\b({K.BUSINESS_TYPE})\b")


@feature()
def business_core_name(c: Column) -> Column:
    plain = without(without(F.upper(c), rf"\b({K.DBA})\s+.+$"), rf"\b({K.BUSINESS_TYPE}|THE)\b")
    return F.trim(without(plain, "[^A-Z0-9 ]"))


# contacts


@feature()
def phone_standardize(c: Column) -> Column:
    d = digits(c)
    return F.when((F.length(d) > 10) & F.substring(d, 1, 1).isin("1", "0"), F.substring(d, 2, 1 << 30)).otherwise(tail(d, 10))


@feature()
def phone_area_code(c: Column) -> Column:
    return F.substring(tail(digits(c), 10), 1, 3)


@feature()
def phone_last_four(c: Column) -> Column:
    return tail(digits(c), 4)


@feature()
def email_domain(c: Column) -> Column:
    return F.lower(found(c, "@(.+)$"))


@feature()
def email_local_part(c: Column) -> Column:
    return F.lower(found(c, "^([^@]+)"))


@feature()
def email_domain_type(c: Column) -> Column:
    domain = email_domain(c)
    return F.when(domain.isin(*K.FREE_DOMAINS), "FREE").when(domain.isNotNull(), "BUSINESS")


@feature()
def email_local_part_safe(c: Column) -> Column:
    return F.when(F.instr(c, "@") > 0, F.lower(F.substring_index(c, "@", 1)))


@feature()
def email_domain_safe(c: Column) -> Column:
    return F.when(F.instr(c, "@") > 0, F.lower(F.substring(c, F.instr(c, "@") + 1, F.length(c))))


@feature()
def email_is_role_address(c: Column) -> Column:
    return flag(email_local_part_safe(c).isin(*K.ROLE_ADDRESSES))


@feature()
def email_domain_category(c: Column) -> Column:
    domain = email_domain_safe(c)
    kinds = F.when(domain.isNull(), None).when(domain.isin(*K.FREE_DOMAINS, *K.MORE_FREE_DOMAINS), "FREE")
    return kinds.when(domain.isin(*K.DISPOSABLE_DOMAINS), "DISPOSABLE").when(domain.rlike(r"\.(gov|mil|gov\.[a-z]{2})$"), "GOVERNMENT").otherwise("CORPORATE")


# dates and identity numbers

STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


@feature()
def year_of_date(c: Column) -> Column:
    return F.year(c)


@feature()
def date_to_string(c: Column, fmt: str = "%Y%m%d") -> Column:
    parts = re.findall(r"%.|[^%]+", fmt)
    if bad := [p for p in parts if p[0] == "%" and p not in STRFTIME]:
        raise ValueError(f"date format {bad[0]!r} has no equivalent")
    out = "".join(STRFTIME[p] if p[0] == "%" else "'" + p.replace("'", "''") + "'" for p in parts)
    return F.date_format(c, out)


@feature()
def dob_year(c: Column) -> Column:
    return F.year(c)


@feature()
def age_from_dob(c: Column) -> Column:
    """Year boundaries since, not completed years."""
    return F.year(F.current_date()) - F.year(c)


@feature()
def dob_mmdd(c: Column) -> Column:
    return F.date_format(c, "MMdd")


@feature()
def ssn_last_four(c: Column) -> Column:
    return tail(digits(c), 4)


@feature()
def ssn_clean(c: Column) -> Column:
    return digits(c)


# kinds of entities


@feature()
def entity_type_classify(c: Column) -> Column:
    up = F.upper(c)
    return F.when(c.isNull(), None).when(up.rlike(rf"\b({K.BUSINESS_WORDS})\b"), "BUSINESS").when(up.rlike(rf"\b({K.ORGANIZATION_WORDS})\b"), "ORGANIZATION").otherwise("PERSON")


@feature()
def name_format_detect(c: Column) -> Column:
    compound = F.upper(c).rlike(r"\b(AND|&)\b")
    return F.when(c.isNull(), None).when(c.rlike(r",\s*\w"), "REVERSED").when(compound, "COMPOUND").when(F.size(words(c)) == 1, "SINGLE").otherwise("NATURAL")


@feature()
def is_multi_person(c: Column) -> Column:
    return flag(F.upper(c).rlike(r"\b(AND|&|OR)\b|\w\s*/\s*\w"))


@feature()
def extract_generational_suffix(c: Column) -> Column:
    return found(F.upper(c), rf"\b({K.GENERATION})\b")


@feature()
def extract_roman_numeral(c: Column) -> Column:
    return found(F.upper(c), rf"\b({K.ROMAN})\b")


@feature()
def is_hoa_trust_careof(c: Column) -> Column:
    return flag(F.upper(c).rlike(rf"\b({K.CARE_OF})\b"))


@feature()
def extract_numbered_entity_suffix(c: Column) -> Column:
    return found(F.upper(c), K.NUMBERED)


@feature()
def geographic_qualifier(c: Column) -> Column:
    return found(F.upper(c), rf"\b({K.DIRECTIONS})\b")


# places

GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


@feature()
def geo_hash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """The geohash of a point: five bits a character, longitude first, in turn with latitude.
    The bits of the two grid numbers are spread apart and added up."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2

    def cell(value: Column, low: float, width: float, n: int) -> Column:
        return F.least(F.greatest(F.floor((value.cast("double") - low) / width * (1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")

    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        n, at = (nx, i // 2) if i % 2 == 0 else (ny, i // 2)
        return F.shiftright(x if i % 2 == 0 else y, n - 1 - at).bitwiseAND(one)

    chars = []
    for k in range(precision):
        number = reduce(lambda a, b: a * 2 + b, [bit(5 * k + j) for j in range(5)])
        chars.append(F.substring(F.lit(GEOHASH), (number + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


@feature()
def lat_lon_bucket(lat: Column, lon: Column, grid_size_km: float = 10) -> Column:
    step = round(grid_size_km / 111.0, 4)
    cell = lambda c: text(F.floor(c / step).cast("long"))
    return F.concat(cell(lat), F.lit("_"), cell(lon))


@feature()
def haversine_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


# sound


@feature()
def metaphone(c: Column) -> Column:
    return metaphone_code(c)


@feature()
def soundex(c: Column) -> Column:
    return F.soundex(c)


# placeholders


@feature()
def is_placeholder_phone(c: Column) -> Column:
    return flag(digits(c).rlike(K.PLACEHOLDER_PHONE))


@feature()
def is_placeholder_email(c: Column) -> Column:
    low = F.lower(text(c))
    return flag(low.rlike(K.PLACEHOLDER_EMAIL) | low.rlike(K.PLACEHOLDER_DOMAIN))


@feature()
def is_placeholder_name(c: Column) -> Column:
    return flag(F.upper(F.trim(text(c))).isin(*K.PLACEHOLDER_NAMES))


@feature()
def is_placeholder_address(c: Column) -> Column:
    value = F.upper(F.trim(text(c)))
    return flag(value.isin(*K.PLACEHOLDER_ADDRESSES) | value.rlike("^0+$"))


@feature()
def is_placeholder_ssn(c: Column) -> Column:
    return flag(digits(c).rlike(K.PLACEHOLDER_SSN))


@feature()
def nullify_placeholder(c: Column, patterns: tuple[str, ...] = ()) -> Column:
    return F.when(~F.coalesce(F.upper(F.trim(text(c))).isin(*(p.upper() for p in patterns)), F.lit(False)), c) if patterns else c


@feature()
def nullify_placeholder_phone(c: Column) -> Column:
    return F.when(is_placeholder_phone(c) == 0, c)


@feature()
def nullify_placeholder_name(c: Column) -> Column:
    return F.when(is_placeholder_name(c) == 0, c)


@feature()
def nullify_placeholder_address(c: Column) -> Column:
    return F.when(is_placeholder_address(c) == 0, c)


@feature()
def nullify_placeholder_email(c: Column) -> Column:
    return F.when(is_placeholder_email(c) == 0, c)


# general


@feature()
def upper_trim(c: Column) -> Column:
    return F.trim(F.upper(c))


@feature()
def lower_trim(c: Column) -> Column:
    return F.trim(F.lower(c))


@feature()
def left(c: Column, length: int = 5) -> Column:
    return F.left(text(c), F.lit(length))


@feature()
def right(c: Column, length: int = 4) -> Column:
    return tail(text(c), length)


@feature()
def coalesce(*cols: Column) -> Column:
    return F.coalesce(*cols)


@feature()
def concat(*cols: Column, separator: str = " ") -> Column:
    """Nulls count as empty."""
    return F.concat(*[x for c in cols for x in (F.lit(separator), F.coalesce(text(c), F.lit("")))][1:])


@feature()
def nullif_empty(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


@feature()
def is_not_null(c: Column) -> Column:
    return c.isNotNull().cast("int")


@feature()
def char_length(c: Column) -> Column:
    return F.length(c)


@feature()
def remove_diacritics(c: Column) -> Column:
    return F.translate(F.upper(F.translate(c, "ß", "")), K.ACCENTED, K.UNACCENTED)


@feature()
def length_bucket(c: Column, bucket_size: int = 5) -> Column:
    return (F.floor(F.length(c) / bucket_size) * bucket_size).cast("long")


@feature()
def length_category(c: Column) -> Column:
    n = F.length(c)
    return F.when(c.isNull(), None).when(n <= 4, "S").when(n <= 12, "M").otherwise("L")


@feature()
def normalize_whitespace(c: Column) -> Column:
    return squeezed(c)


@feature()
def zip5(c: Column) -> Column:
    return F.substring(digits(c), 1, 5)


@feature()
def zip3(c: Column) -> Column:
    return F.substring(digits(c), 1, 3)


# industries


@feature()
def vin_normalize(c: Column) -> Column:
    return without(F.translate(F.upper(without(text(c), "[^A-Za-z0-9]")), "OIQ", "010"), "[^A-Z0-9]")


@feature()
def vin_last_six(c: Column) -> Column:
    return tail(vin_normalize(c), 6)


@feature()
def policy_number_clean(c: Column) -> Column:
    return F.upper(without(without(F.trim(text(c)), r"[-\s]"), "^0+"))


@feature()
def iban_normalize(c: Column) -> Column:
    return F.upper(without(F.trim(text(c)), r"[\s-]"))


@feature()
def routing_number_clean(c: Column) -> Column:
    return digits(c)


@feature()
def account_number_clean(c: Column) -> Column:
    return without(without(text(c), r"[\s-]"), "^0+")


@feature()
def amount_bucket(c: Column, bucket_size: float = 100) -> Column:
    return (F.floor(c.cast("double") / bucket_size) * bucket_size).cast("long")


@feature()
def npi_validate(c: Column) -> Column:
    return F.when(F.length(digits(c)) == 10, digits(c))


@feature()
def dea_number_clean(c: Column) -> Column:
    return F.upper(without(text(c), r"[\s-]"))


@feature()
def mrn_clean(c: Column) -> Column:
    return F.upper(without(without(text(c), "[^A-Za-z0-9]"), "^0+"))


@feature()
def icd_code_normalize(c: Column) -> Column:
    return F.upper(without(text(c), "[^A-Za-z0-9]"))


@feature()
def ein_format(c: Column) -> Column:
    return digits(c)


@feature()
def duns_clean(c: Column) -> Column:
    return F.when(F.length(digits(c)) == 9, digits(c))


@feature()
def ticker_normalize(c: Column) -> Column:
    return F.upper(without(text(c), r"[\s.]"))


@feature()
def cusip_clean(c: Column) -> Column:
    return F.upper(without(text(c), r"[\s-]"))


@feature()
def license_number_clean(c: Column) -> Column:
    return F.upper(without(text(c), "[^A-Za-z0-9]"))
