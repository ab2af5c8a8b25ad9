"""Record-level data-quality tests, tiers and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florascope.functions.geo import hav_km
from florascope.functions.scalars import NO_NUMBER, SPECIMEN_BASIS, decimals, issue_set, norm_key

from .spatial import within

#: Tests in their order with their severity.
TESTS = {
    "equal_coordinates": "error", "gbif_headquarters": "error", "capital": "error", "near_capital": "warning", "country_centroid": "error", "province_centroid": "error",
    "institution": "error", "gbif_geospatial_issue": "error", "low_precision": "error", "duplicate_specimen": "error", "gbif_coordinate_corrected": "warning",
    "gbif_taxon_match": "warning", "gbif_date_issue": "warning", "before_climate_baseline": "warning", "cultivation_text": "warning", "near_botanical_garden": "warning",
    "weak_identification": "warning", "environmental_outlier": "warning", "spatial_isolate": "warning",
}
#: Issue codes behind the issue tests.
ISSUES = {
    "gbif_geospatial_issue": ["ZERO_COORDINATE", "COORDINATE_OUT_OF_RANGE", "COORDINATE_INVALID", "COUNTRY_COORDINATE_MISMATCH", "COORDINATE_REPROJECTION_FAILED"],
    "gbif_coordinate_corrected": ["PRESUMED_SWAPPED_COORDINATE", "PRESUMED_NEGATED_LATITUDE", "PRESUMED_NEGATED_LONGITUDE", "COORDINATE_REPROJECTION_SUSPICIOUS"],
    "gbif_taxon_match": ["TAXON_MATCH_FUZZY", "TAXON_MATCH_HIGHERRANK"],
    "gbif_date_issue": ["RECORDED_DATE_INVALID", "RECORDED_DATE_UNLIKELY"],
}
#: Fixed value: words for planted or cultivated individuals.
CULTIVATION = (
    r"(?i)\b(?:cultivated|cultivad[ao]s?|cultiv[ée]e?s?|kultiviert|planted|plantation|ornamental|gardens?|jard[ií]n(?:es)?|jardim|giardino|garten|nursery|arboretum|botanic\w*|hortus|"
    r"(?:city|urban|public|municipal) park)\b|\b(?:cult|hort)\."
)
HEADQUARTERS = (12.5788, 55.6761)
METRES_PER_DEGREE = 111_320.0
BUFFERS_KM = {"capital": 1.0, "near_capital": 10.0, "country_centroid": 1.0, "province_centroid": 1.0, "institution": 0.1, "near_botanical_garden": 1.0}
KEY = ["source", "record_id"]


def equal_coordinates() -> Column:
    return F.abs(F.col("longitude") - F.col("latitude")) <= 1e-9


def headquarters(km: float = 1.0) -> Column:
    return hav_km(F.col("longitude"), F.col("latitude"), F.lit(HEADQUARTERS[0]), F.lit(HEADQUARTERS[1])) <= km


def has_issue(test: str, issues: Column) -> Column:
    return F.coalesce(F.arrays_overlap(issues, F.array(*[F.lit(c) for c in ISSUES[test]])), F.lit(False))


def implied_uncertainty_m() -> Column:
    """Half the last-digit step of the more precise coordinate."""
    d = F.greatest(decimals(F.col("longitude")), decimals(F.col("latitude")))
    return F.lit(0.5 * METRES_PER_DEGREE) / F.pow(F.lit(10.0), d.cast("double"))


def low_precision(cell_degrees: float) -> Column:
    return F.coalesce(F.col("coordinate_uncertainty_m"), implied_uncertainty_m()) > cell_degrees * METRES_PER_DEGREE


def before_baseline(year: int = 1970) -> Column:
    return F.coalesce(F.year("event_date") < year, F.lit(False))


def cultivation_text(*fields: str) -> Column:
    return F.coalesce(F.concat_ws(" ", *[F.col(f) for f in fields]).rlike(CULTIVATION), F.lit(False))


def weak_identification(agreements: int = 2) -> Column:
    weak = (F.coalesce("id_disagreements", F.lit(0)) > 0) | (F.coalesce("observer_id_from_vision", F.lit(False)) & (F.coalesce("id_agreements", F.lit(0)) <= agreements))
    return (F.col("source") == "iNaturalist") & weak


def duplicate_specimens(occ: DataFrame) -> DataFrame:
    """Adds ``duplicate_specimen``: all but the first record of a set with one collector, number and date."""
    collector, no = norm_key(F.col("recorded_by")), norm_key(F.col("record_number"))
    usable = F.col("basis_of_record").isin(SPECIMEN_BASIS) & (collector != "") & ~no.isin(NO_NUMBER) & F.col("event_date").isNotNull()
    # rows without a usable key are dealt by their id, so that they make no hot group
    group = F.when(usable, F.concat_ws("\u0001", collector, no, F.col("event_date").cast("string"))).otherwise(F.concat_ws("\u0002", *[F.col(k).cast("string") for k in KEY]))
    nth = F.row_number().over(Window.partitionBy("_set").orderBy(*KEY))
    return occ.withColumn("_set", group).withColumn("duplicate_specimen", usable & (nth > 1)).drop("_set")


def near_places(occ: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the gazetteer tests; ``places(kind, types, longitude, latitude)``."""
    kinds = {
        "capital": F.col("kind") == "capital", "near_capital": F.col("kind") == "capital", "country_centroid": F.col("kind") == "country_centroid", "province_centroid": F.col("kind") == "province_centroid",
        "institution": F.col("kind") == "institution", "near_botanical_garden": (F.col("kind") == "institution") & F.coalesce(F.col("types").contains("BOTANICAL_GARDEN"), F.lit(False)),
    }
    hits = None
    for test, which in kinds.items():
        h = within(occ.select(*KEY, "longitude", "latitude"), places.where(which), BUFFERS_KM[test]).select(*KEY, F.lit(test).alias("t"))
        hits = h if hits is None else hits.unionAll(h)
    found = hits.groupBy(*KEY).agg(F.collect_set("t").alias("_near"))
    out = occ.join(found, KEY, "left")
    at = {t: F.coalesce(F.array_contains("_near", t), F.lit(False)) for t in kinds}
    at["near_capital"] = at["near_capital"] & ~at["capital"]
    at["near_botanical_garden"] = at["near_botanical_garden"] & ~at["institution"]
    return out.withColumns(at).drop("_near")


def assess(occ: DataFrame, places: DataFrame | None = None, cell_degrees: float = 1 / 6, baseline_year: int = 1970, text_fields: tuple[str, ...] = ("locality",), more: dict[str, Column] | None = None) -> DataFrame:
    """``occ`` with ``flags`` in test order, ``excluded`` and ``tier``; tests without their inputs are not run."""
    d = duplicate_specimens(occ.withColumn("_issues", issue_set(F.col("issues_csv"))))
    if places is not None:
        d = near_places(d, places)
    tests = {
        "equal_coordinates": equal_coordinates(), "gbif_headquarters": headquarters(), "low_precision": low_precision(cell_degrees), "duplicate_specimen": F.col("duplicate_specimen"),
        "before_climate_baseline": before_baseline(baseline_year), "cultivation_text": cultivation_text(*text_fields), "weak_identification": weak_identification(),
        **{t: has_issue(t, F.col("_issues")) for t in ISSUES}, **({t: F.col(t) for t in BUFFERS_KM} if places is not None else {}), **(more or {}),
    }
    d = d.withColumn("flags", F.array_compact(F.array(*[F.when(tests[t], F.lit(t)) for t in TESTS if t in tests])))
    errors = F.array(*[F.lit(t) for t, s in TESTS.items() if s == "error"])
    d = d.withColumn("excluded", F.arrays_overlap("flags", errors)).withColumn("tier", tier())
    return d.drop("_issues", "duplicate_specimen", *(BUFFERS_KM if places is not None else ()))


def tier(max_uncertainty_m: float = 1000.0) -> Column:
    warned = F.size(F.array_except("flags", F.array(*[F.lit(t) for t, s in TESTS.items() if s == "error"]))) > 0
    specimen = F.coalesce(F.col("basis_of_record").isin(SPECIMEN_BASIS), F.lit(False)) & (F.col("coordinate_uncertainty_m") <= max_uncertainty_m)
    return F.when(F.col("excluded"), "excluded").when(warned | F.col("coordinate_uncertainty_m").isNull(), "C").when(specimen, "A").otherwise("B")


def summary(assessed: DataFrame, run: list[str]) -> DataFrame:
    """``test, severity, status, n_flagged`` for every test; those not in ``run`` are skipped, which is not passed."""
    counts = assessed.agg(*[F.count_if(F.array_contains("flags", t)).alias(t) for t in TESTS])
    rows = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(s).alias("severity"), F.lit("run" if t in run else "skipped").alias("status"), (F.col(t) if t in run else F.lit(None).cast("long")).alias("n_flagged")) for t, s in TESTS.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
