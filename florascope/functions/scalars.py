"""Scalar expressions over record fields: labels, dates, issues, names, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies of the record sources.
EXCLUDED_BASIS = ["FOSSIL_SPECIMEN", "LIVING_SPECIMEN"]
EXCLUDED_ESTABLISHMENT = ["managed", "cultivated", "captive"]
INTRODUCED_MEANS = ["invasive", "naturalised", "naturalized"]
INTRODUCED_DEGREES = ["invasive", "naturalised", "naturalized", "established", "colonising", "casual"]
RANGE_LABELS = ["native", "introduced", "unknown"]
ANNOTATION_KINDS = ["range_label", "exclude", "cultivated", "verified"]
SPECIMEN_BASIS = ["PRESERVED_SPECIMEN", "MATERIAL_SAMPLE", "MATERIAL_CITATION"]
NO_NUMBER = ["", "sn", "none", "na", "nan", "unknown", "0"]
MAX_TEXT = 500
MONTHLY_GROUPS = {"humidity": ["hurs", "vpd"], "wind": ["sfcWind"], "water_balance": ["cmi", "pet_penman"], "radiation": ["rsds", "clt"]}


def cleaned(c: Column) -> Column:
    """Trimmed lower-case text, empty if null."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def range_label(means: Column, degree: Column) -> Column:
    """native, introduced or unknown from establishment means and degree of establishment."""
    em, doe = cleaned(means), cleaned(degree)
    return (
        F.when(em.startswith("native") | (doe == "native"), "native")
        .when(em.startswith("introduced") | em.isin(INTRODUCED_MEANS) | doe.isin(INTRODUCED_DEGREES), "introduced")
        .otherwise("unknown")
    )


def partial_date(c: Column) -> Column:
    """The start of a date or date interval given to the day, month or year; null if it is none of these."""
    t = F.split(F.trim(c), "/")[0]
    forms = ((10, r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (7, r"^\d{4}-\d{2}$", "yyyy-MM"), (4, r"^\d{4}$", "yyyy"))
    heads = [(F.substring(t, 1, n), shape, form) for n, shape, form in forms]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.when(h.rlike(shape), h), F.lit(form))) for h, shape, form in heads])


def iso_day(c: Column) -> Column:
    """The date in the first ten characters, or null."""
    head = F.substring(c.cast("string"), 1, 10)
    return F.to_date(F.try_to_timestamp(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head), F.lit("yyyy-MM-dd")))


def year_start(c: Column) -> Column:
    """First day of a year given as a number; null if it is no four-digit year."""
    return partial_date(c.cast("long").cast("string"))


def stale(updated: Column, days: int, now: Column) -> Column:
    """True if ``updated`` lies more than ``days`` days before ``now``."""
    return updated < now - F.make_interval(days=F.lit(days))


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 text with a T, microseconds only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def issue_set(c: Column) -> Column:
    """Distinct upper-case issue codes in order from ``;``-separated text; null stays null, empty text is an empty set."""
    items = F.transform(F.split(c, ";"), lambda x: F.upper(F.trim(x)))
    return F.when(c.isNotNull(), F.array_sort(F.array_distinct(F.filter(items, lambda x: x != ""))))


def norm_key(c: Column) -> Column:
    """Digits and letters of the lower-cased text."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]", "")


def detail_text(c: Column) -> Column:
    """Trimmed text of at most 500 characters, null if blank."""
    t = F.substring(F.trim(c), 1, MAX_TEXT)
    return F.when(F.length(t) > 0, t)


def joined_detail(c: Column) -> Column:
    """List values as one text with ``" | "`` between them, blanks left out."""
    return detail_text(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), " | "))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def column_key(c: Column) -> Column:
    """A column name without case and punctuation."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def number(c: Column) -> Column:
    """A double, or null if the text is no number."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def integer(c: Column) -> Column:
    """A whole number, or null if the text is none."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t).try_cast("long")


def finite(c: Column) -> Column:
    """The value, null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def decimals(c: Column, most: int = 9) -> Column:
    """Decimal places of a double as written: the fewest at which rounding gives it back."""
    out = F.lit(most)
    for d in range(most - 1, -1, -1):
        out = F.when(F.round(c, d) == c, F.lit(d)).otherwise(out)
    return out


def scenario_group(name: Column) -> Column:
    """``model_ssp_period`` without the model: the last two parts."""
    return F.regexp_extract(name, r"_([^_]*_[^_]*)$", 1)


def predictor_group(name: Column) -> Column:
    """Group of a predictor's name."""
    no = F.regexp_extract(name, r"^bio(\d+)$", 1).try_cast("int")
    monthly = F.coalesce(*[F.when(name.rlike(f"^({'|'.join(prefixes)})_"), group) for group, prefixes in MONTHLY_GROUPS.items()])
    return (
        F.when(no.between(1, 11), "temperature").when(no.between(12, 19), "precipitation").when(name.startswith("soil_"), "soil").when(monthly.isNotNull(), monthly)
        .when(name.isin("ai", "swb"), "water_balance")
        .when(name.rlike("^(gdd|ngd)") | name.isin("gsl", "gsp", "gst", "fcf", "scd", "npp"), "growing_season")
        .otherwise("other")
    )


def tile_label(lat_top: Column, lon_left: Column) -> Column:
    """Label of a 10 degree tile, such as ``30\u201340\u00b0N, 110\u2013120\u00b0E``."""

    def span(low: Column, high: Column, positive: str, negative: str) -> Column:
        a, b = (F.round(F.abs(c)).cast("long").cast("string") for c in (low, high))
        return (
            F.when(low >= 0, F.concat(a, F.lit("\u2013"), b, F.lit(f"\u00b0{positive}")))
            .when(high <= 0, F.concat(b, F.lit("\u2013"), a, F.lit(f"\u00b0{negative}")))
            .otherwise(F.concat(a, F.lit(f"\u00b0{negative}\u2013"), b, F.lit(f"\u00b0{positive}")))
        )

    return F.concat_ws(", ", span(lat_top - 10, lat_top, "N", "S"), span(lon_left, lon_left + 10, "E", "W"))


def flag_list(tests: dict[str, Column]) -> Column:
    """Names of the tests that a record fails, in the order of ``tests``; an unknown result is no flag."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()]))


def by_importance(scores: Column) -> Column:
    """Keys of a map from the largest value down, ties by name."""
    order = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.transform(order, lambda e: e["k"])


def verified(c: Column, expected: Column) -> Column:
    """True if the SHA-256 of ``c`` is ``expected``; false if either is missing."""
    return F.coalesce(F.sha2(c, 256) == expected, F.lit(False))


def xml_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def auc_words(c: Column) -> Column:
    return F.when(c.isNull(), "could not be measured").when(c >= 0.9, "excellent").when(c >= 0.8, "good").when(c >= 0.7, "fair").otherwise("poor")


def cbi_words(c: Column) -> Column:
    return F.when(c.isNull(), "could not be measured").when(c >= 0.7, "strong").when(c >= 0.4, "moderate").when(c > 0, "weak").otherwise("no better than chance")


def cloglog(eta: Column) -> Column:
    """``1 - exp(-exp(eta))`` with eta clipped to +-30."""
    return -F.expm1(-F.exp(F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))

