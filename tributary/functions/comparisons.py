"""Comparisons of a left with a right column.

Predicates are false where a side is null, unless they say otherwise; scores are then 0.0.
`COST` ranks them, so that scoring can test the cheap ones first; `USES_PYTHON` are those that
leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import haversine_distance, initials, text, words
from .registry import comparison
from .strings import jaro_winkler_of, metaphone_alternate, metaphone_code

#: Relative cost; methods that aren't named cost 1.
COST: dict[str, int] = {}
USES_PYTHON = ("jaro_winkler", "jaro_winkler_score", "metaphone_match", "double_metaphone_match")


def compares(cost: int) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        COST[f.__name__] = cost
        return comparison()(f)

    return add


def sure(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def score(l: Column, r: Column, value: Column) -> Column:  # noqa: E741
    """A score that is 0 where a side is null, and null where the value is undefined."""
    return F.when(l.isNotNull() & r.isNotNull(), value.cast("double")).otherwise(F.lit(0.0))


# equality and length


@compares(1)
def exact(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(l == r)


@compares(2)
def exact_case_insensitive(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(F.upper(l) == F.upper(r))


@compares(1)
def exact_or_null(l: Column, r: Column) -> Column:  # noqa: E741
    return l.isNull() | r.isNull() | sure(l == r)


def plain_letters(c: Column) -> Column:
    """Upper case without combining marks. Letters of Latin scripts that carry a mark are folded
    by a table made from Unicode's own decompositions."""
    import unicodedata

    pairs = {}
    for code in range(0xC0, 0x1F00):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            pairs[chr(code)] = base[0]
    for code in range(0x1E00, 0x1F00):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs[chr(code)] = base[0]
    folded = F.translate(c, "".join(pairs), "".join(pairs.values()))
    return F.upper(F.regexp_replace(folded, r"\p{M}", ""))


@compares(5)
def exact_diacritics_insensitive(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(plain_letters(l) == plain_letters(r))


@compares(2)
def length_ratio(l: Column, r: Column, threshold: float = 0.6) -> Column:  # noqa: E741
    return sure(_length_ratio(l, r) >= threshold)


@compares(2)
def length_ratio_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _length_ratio(l, r))


def _length_ratio(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = F.length(l), F.length(r)
    return F.try_divide(F.least(a, b), F.greatest(a, b))


@compares(2)
def length_mismatch(l: Column, r: Column, max_diff: int = 5) -> Column:  # noqa: E741
    return sure(F.abs(F.length(l) - F.length(r)) > max_diff)


@compares(1)
def different(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(l != r)


@compares(1)
def null_either(l: Column, r: Column) -> Column:  # noqa: E741
    return l.isNull() | r.isNull()


# edit distance


def _edit(l: Column, r: Column, by: Callable[..., Column]) -> Column:  # noqa: E741
    return 1 - F.try_divide(F.levenshtein(l, r), by(F.length(l), F.length(r)))


@compares(10)
def levenshtein(l: Column, r: Column, max_distance: int = 2) -> Column:  # noqa: E741
    return sure(F.levenshtein(l, r, max_distance) >= 0)


@compares(12)
def levenshtein_normalized(l: Column, r: Column, threshold: float = 0.8) -> Column:  # noqa: E741
    return sure(_edit(l, r, F.greatest) >= threshold)


@compares(12)
def levenshtein_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _edit(l, r, F.greatest))


@compares(12)
def levenshtein_length_aware(l: Column, r: Column, threshold: float = 0.8) -> Column:  # noqa: E741
    return sure(_edit(l, r, F.least) >= threshold)


@compares(12)
def levenshtein_length_aware_score(l: Column, r: Column) -> Column:  # noqa: E741
    """Below 0 where the distance is larger than the shorter side."""
    return score(l, r, _edit(l, r, F.least))


@compares(20)
def jaro_winkler(l: Column, r: Column, threshold: float = 0.85) -> Column:  # noqa: E741
    return sure(jaro_winkler_of(l, r) >= threshold)


@compares(20)
def jaro_winkler_score(l: Column, r: Column) -> Column:  # noqa: E741
    return F.coalesce(jaro_winkler_of(l, r), F.lit(0.0))


# sound


@compares(3)
def soundex_match(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(F.soundex(l) == F.soundex(r))


@compares(15)
def metaphone_match(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(metaphone_code(l) == metaphone_code(r))


@compares(15)
def double_metaphone_match(l: Column, r: Column) -> Column:  # noqa: E741
    """A primary code equals a primary or an alternate one."""
    pl, pr = metaphone_code(l), metaphone_code(r)
    return sure(pl == pr) | sure(pl == metaphone_alternate(r)) | sure(metaphone_alternate(l) == pr)


# parts


@compares(5)
def contains(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(F.contains(text(l), text(r)) | F.contains(text(r), text(l)))


@compares(5)
def starts_with(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(F.startswith(text(l), text(r)))


@compares(5)
def abbreviation_match(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = F.upper(l), F.upper(r)
    return sure(F.startswith(a, b) | F.startswith(b, a))


@compares(15)
def initials_match(l: Column, r: Column) -> Column:  # noqa: E741
    return sure(initials(F.upper(l)) == initials(F.upper(r)))


@compares(5)
def regex_match(l: Column, r: Column, pattern: str = ".*") -> Column:  # noqa: E741
    return sure(text(l).rlike(pattern) & text(r).rlike(pattern))


# tokens


def _tokens(c: Column) -> Column:
    return words(F.upper(c))


def _token_jaccard(l: Column, r: Column) -> Column:  # noqa: E741
    """Over word lists; repeated words on the left count each time."""
    a, b = _tokens(l), _tokens(r)
    shared = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    return F.try_divide(shared, F.size(a) + F.size(b) - shared)


@compares(30)
def token_set_match(l: Column, r: Column, min_overlap: float = 0.5) -> Column:  # noqa: E741
    return sure(_token_jaccard(l, r) >= min_overlap)


@compares(30)
def token_set_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _token_jaccard(l, r))


def _distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(_tokens(c), lambda w: w != ""))


def _shared(l: Column, r: Column) -> Column:  # noqa: E741
    return F.size(F.array_intersect(_distinct(l), _distinct(r)))


def _dice(l: Column, r: Column) -> Column:  # noqa: E741
    return F.try_divide(2 * _shared(l, r), F.size(_distinct(l)) + F.size(_distinct(r)))


def _overlap(l: Column, r: Column) -> Column:  # noqa: E741
    return F.try_divide(_shared(l, r), F.least(F.size(_distinct(l)), F.size(_distinct(r))))


def _monge_elkan(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = _distinct(l), _distinct(r)
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: _edit(x, y, F.greatest))))
    return F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.size(a))


def _token_sort(l: Column, r: Column) -> Column:  # noqa: E741
    line = lambda c: F.array_join(F.array_sort(F.filter(_tokens(c), lambda w: w != "")), " ")
    return _edit(line(l), line(r), F.greatest)


@compares(30)
def dice_coefficient(l: Column, r: Column, min_similarity: float = 0.5) -> Column:  # noqa: E741
    return sure(_dice(l, r) >= min_similarity)


@compares(30)
def dice_coefficient_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _dice(l, r))


@compares(30)
def overlap_coefficient(l: Column, r: Column, min_similarity: float = 0.5) -> Column:  # noqa: E741
    return sure(_overlap(l, r) >= min_similarity)


@compares(30)
def overlap_coefficient_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _overlap(l, r))


@compares(35)
def monge_elkan(l: Column, r: Column, min_similarity: float = 0.7) -> Column:  # noqa: E741
    return sure(_monge_elkan(l, r) >= min_similarity)


@compares(35)
def monge_elkan_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _monge_elkan(l, r))


@compares(25)
def token_sort_ratio(l: Column, r: Column, min_similarity: float = 0.8) -> Column:  # noqa: E741
    return sure(_token_sort(l, r) >= min_similarity)


@compares(25)
def token_sort_ratio_score(l: Column, r: Column) -> Column:  # noqa: E741
    return score(l, r, _token_sort(l, r))


def _grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; null where the text is shorter than n."""
    up = F.upper(c)
    return F.when(F.length(up) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(up) - (n - 1)), lambda i: F.substring(up, i, F.lit(n)))))


def _gram_jaccard(l: Column, r: Column, n: int) -> Column:  # noqa: E741
    shared = F.size(F.array_intersect(_grams(l, n), _grams(r, n)))
    return F.try_divide(shared, F.size(_grams(l, n)) + F.size(_grams(r, n)) - shared)


@compares(15)
def jaccard_ngram(l: Column, r: Column, n: int = 2, min_similarity: float = 0.5) -> Column:  # noqa: E741
    long = (F.length(l) >= n) & (F.length(r) >= n)
    return sure(long & (_gram_jaccard(l, r, n) >= min_similarity))


@compares(15)
def jaccard_ngram_score(l: Column, r: Column, n: int = 2) -> Column:  # noqa: E741
    long = (F.length(l) >= n) & (F.length(r) >= n)
    return score(l, r, F.when(long, _gram_jaccard(l, r, n)))


# numbers


@compares(1)
def numeric_within(l: Column, r: Column, tolerance: float = 0) -> Column:  # noqa: E741
    return sure(F.abs(l - r) <= tolerance)


def _ratio(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = F.abs(l), F.abs(r)
    return F.when((a > 0) & (b > 0), F.try_divide(F.least(a, b), F.greatest(a, b)))


@compares(2)
def numeric_ratio(l: Column, r: Column, min_ratio: float = 0.9) -> Column:  # noqa: E741
    return sure(_ratio(l, r) >= min_ratio)


@compares(2)
def numeric_ratio_score(l: Column, r: Column) -> Column:  # noqa: E741
    return F.coalesce(_ratio(l, r).cast("double"), F.lit(0.0))


@compares(2)
def numeric_percent_diff(l: Column, r: Column, tolerance: float = 5.0) -> Column:  # noqa: E741
    return sure(F.try_divide(F.abs(l - r), F.greatest(F.abs(l), F.abs(r))) * 100 <= tolerance)


# dates


@compares(1)
def date_within_days(l: Column, r: Column, days: int = 0) -> Column:  # noqa: E741
    return sure(F.abs(F.datediff(l, r)) <= days)


@compares(1)
def date_within_months(l: Column, r: Column, months: int = 0) -> Column:  # noqa: E741
    """Month boundaries between."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    return sure(F.abs(month(l) - month(r)) <= months)


@compares(1)
def date_within_years(l: Column, r: Column, years: int = 0) -> Column:  # noqa: E741
    return sure(F.abs(F.year(l) - F.year(r)) <= years)


@compares(2)
def age_difference(l: Column, r: Column, max_diff: int = 2) -> Column:  # noqa: E741
    return sure(F.abs(F.year(l) - F.year(r)) <= max_diff)


@compares(2)
def date_overlap(l: Column, r: Column, left_end: Column, right_end: Column) -> Column:  # noqa: E741
    return sure((l <= right_end) & (left_end >= r))


@compares(3)
def date_overlap_score(l: Column, r: Column, left_end: Column, right_end: Column) -> Column:  # noqa: E741
    """Days of the overlap over those of the shorter period, both counted inclusively."""
    days = F.datediff(F.least(left_end, right_end), F.greatest(l, r)) + 1
    shorter = F.least(F.datediff(left_end, l), F.datediff(right_end, r)) + 1
    return F.when(date_overlap(l, r, left_end, right_end), F.try_divide(days, shorter).cast("double")).otherwise(F.lit(0.0))


# places


@compares(25)
def geo_within_km(l: Column, r: Column, left_lon: Column, right_lon: Column, max_km: float = 10.0) -> Column:  # noqa: E741
    return sure(haversine_distance(l, left_lon, r, right_lon) <= max_km)


@compares(25)
def geo_distance_score(l: Column, r: Column, left_lon: Column, right_lon: Column, max_km: float = 50.0) -> Column:  # noqa: E741
    km = haversine_distance(l, left_lon, r, right_lon)
    return F.when(km.isNotNull(), F.greatest(F.lit(0.0), 1 - km / max_km)).otherwise(F.lit(0.0))


# vectors


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _zipped(l: Column, r: Column, f: Callable[[Column, Column], Column]) -> Column:  # noqa: E741
    return _sum(F.zip_with(l, r, lambda x, y: f(x.cast("double"), y.cast("double"))))


def cosine(l: Column, r: Column) -> Column:  # noqa: E741
    times = lambda x, y: x * y
    return F.try_divide(_zipped(l, r, times), F.sqrt(_zipped(l, l, times)) * F.sqrt(_zipped(r, r, times)))


def _l2(l: Column, r: Column) -> Column:  # noqa: E741
    return F.sqrt(_zipped(l, r, lambda x, y: (x - y) * (x - y)))


def _l1(l: Column, r: Column) -> Column:  # noqa: E741
    return _zipped(l, r, lambda x, y: F.abs(x - y))


@compares(50)
def cosine_similarity(l: Column, r: Column, min_similarity: float = 0.85) -> Column:  # noqa: E741
    return sure(cosine(l, r) >= min_similarity)


@compares(50)
def cosine_similarity_score(l: Column, r: Column) -> Column:  # noqa: E741
    return cosine(l, r)


@compares(50)
def euclidean_distance(l: Column, r: Column, max_distance: float = 1.0) -> Column:  # noqa: E741
    return sure(_l2(l, r) <= max_distance)


@compares(50)
def euclidean_distance_score(l: Column, r: Column, max_distance: float = 10.0) -> Column:  # noqa: E741
    return score(l, r, F.greatest(F.lit(0.0), 1 - _l2(l, r) / max_distance))


@compares(45)
def manhattan_distance(l: Column, r: Column, max_distance: float = 1.0) -> Column:  # noqa: E741
    return sure(_l1(l, r) <= max_distance)


@compares(45)
def manhattan_distance_score(l: Column, r: Column, max_distance: float = 10.0) -> Column:  # noqa: E741
    return score(l, r, F.greatest(F.lit(0.0), 1 - _l1(l, r) / max_distance))
