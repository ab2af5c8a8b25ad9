"""Analytic views over the driver's tables, in SQL that Spark and DuckDB both run.

Each view is a pure function of its tables' columns. ``{name}`` stands for a
table or another view; ``{src}`` for the row numbers 0..64799.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

VIEWS: dict[str, str] = {
    "occ": """SELECT CAST(5000001 + user_id % 3 AS INT) AS taxon_key,
 CASE WHEN event_type = 'view' THEN 'iNaturalist' ELSE 'GBIF' END AS source, event_id AS record_id,
 CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN event_id + 1 END AS inat_crossref_id,
 CAST((user_id * 7919) % 300 - 150 AS DOUBLE) + CAST((event_id * 31) % 4001 - 2000 AS DOUBLE) / 1000e0 AS longitude,
 CAST((user_id * 104729) % 100 - 45 AS DOUBLE) + CAST((event_id * 57) % 4001 - 2000 AS DOUBLE) / 1000e0 AS latitude,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE make_date(CAST(1955 + event_id % 70 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT)) END AS event_date,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 40e0 END AS coordinate_uncertainty_m,
 CASE event_id % 5 WHEN 0 THEN 'PRESERVED_SPECIMEN' WHEN 1 THEN 'OBSERVATION' WHEN 2 THEN 'MATERIAL_SAMPLE' ELSE 'HUMAN_OBSERVATION' END AS basis_of_record,
 concat('C', CAST(user_id % 25 AS STRING)) AS country_code,
 CASE event_id % 6 WHEN 0 THEN 'native' WHEN 1 THEN 'introduced' ELSE 'unknown' END AS range_label,
 CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'ZERO_COORDINATE' WHEN 2 THEN 'TAXON_MATCH_FUZZY;RECORDED_DATE_INVALID' WHEN 3 THEN 'PRESUMED_SWAPPED_COORDINATE' ELSE '' END AS issues_csv,
 CASE event_id % 13 WHEN 0 THEN 'City Botanic garden' WHEN 1 THEN 'planted by road' WHEN 2 THEN 'cult. specimen' WHEN 3 THEN 'Gardenia hill' WHEN 4 THEN NULL ELSE 'river bank' END AS locality,
 concat('Coll. ', CAST(user_id % 5 AS STRING)) AS recorded_by,
 CASE WHEN event_id % 4 = 0 THEN 's.n.' ELSE CAST(event_id % 29 AS STRING) END AS record_number,
 CAST(event_id % 5 AS INT) AS id_agreements, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS id_disagreements,
 event_id % 3 = 0 AS observer_id_from_vision, ts AS ingested_ts FROM {events}""",
    "grid": """SELECT r AS row, c AS col, lon, lat, 28e0 - 0.45e0 * abs(lat) AS bio1, 12e0 * abs(lat) + 0.8e0 * abs(lon) + 150e0 AS bio4,
 2200e0 / (1e0 + (lat / 32e0) * (lat / 32e0)) + 4e0 * ((lon + 180e0) % 60e0) AS bio12
 FROM (SELECT r, c, -180e0 + CAST(c AS DOUBLE) + 0.5e0 AS lon, 90e0 - CAST(r AS DOUBLE) - 0.5e0 AS lat
  FROM (SELECT CAST(floor(id / 360e0) AS INT) AS r, CAST(id % 360 AS INT) AS c FROM {src}) a) b
 WHERE (lon >= -125e0 AND lon <= -35e0 AND lat >= -50e0 AND lat <= 70e0) OR (lon >= -10e0 AND lon <= 145e0 AND lat >= -35e0 AND lat <= 70e0)""",
    "cells": """SELECT g.*, 1e0 / (1e0 + ((bio1 - 15e0) / 8e0) * ((bio1 - 15e0) / 8e0) + ((bio12 - 900e0) / 700e0) * ((bio12 - 900e0) / 700e0)) AS suitability FROM {grid} g""",
    "ann": """SELECT CAST(5000001 + l_suppkey % 3 AS INT) AS taxon_key, CASE WHEN l_orderkey % 2 = 0 THEN 'GBIF' ELSE 'iNaturalist' END AS source, l_orderkey % 1000 AS record_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'range_label' WHEN 1 THEN 'exclude' WHEN 2 THEN 'cultivated' ELSE 'verified' END AS kind,
 CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'native' ELSE 'introduced' END WHEN l_partkey % 3 = 0 THEN 'false' ELSE 'true' END AS value,
 l_returnflag AS author, l_shipdate AS created_ts, l_orderkey AS seq1, l_linenumber AS seq2, l_partkey AS seq3 FROM {lineitem}""",
    "eff": """SELECT px_row, px_col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM (SELECT CAST((l_partkey * 13) % 220 + 40 AS INT) AS px_row, CAST((l_orderkey * 17) % 700 AS INT) AS px_col, l_quantity FROM {lineitem} WHERE l_linenumber <= 2) a GROUP BY px_row, px_col""",
    "ref_rec": """SELECT CAST(5000001 + user_id % 3 AS INT) AS taxon_key, CASE WHEN event_id % 2 = 0 THEN 'upload-a' ELSE 'gbif-absences' END AS dataset_id, event_id AS record_id,
 CASE WHEN event_id % 2 = 0 AND event_id % 4 = 0 THEN 'present' ELSE 'absent' END AS occurrence_status,
 CAST((user_id * 7919) % 300 - 150 AS DOUBLE) + CAST((event_id * 31) % 4001 - 2000 AS DOUBLE) / 1000e0 + 0.0005e0 * CAST(event_id % 5 AS DOUBLE) AS longitude,
 CAST((user_id * 104729) % 100 - 45 AS DOUBLE) + CAST((event_id * 57) % 4001 - 2000 AS DOUBLE) / 1000e0 AS latitude,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE make_date(CAST(1955 + event_id % 70 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT)) END AS event_date
 FROM {events} WHERE event_type IN ('error', 'signup') AND event_id % 3 = 0""",
    "occ_cells": """SELECT o.*, CAST(floor(90e0 - latitude) AS INT) AS row, CAST(floor(longitude + 180e0) AS INT) AS col FROM {occ} o""",
    "pred": """SELECT o.record_id AS id, 1 AS y, c.suitability AS s, c.bio1, c.bio12 FROM {occ_cells} o JOIN {cells} c ON c.row = o.row AND c.col = o.col WHERE o.range_label = 'native'
 UNION ALL SELECT 1000000 + c.row * 360 + c.col AS id, 0 AS y, c.suitability AS s, c.bio1, c.bio12 FROM {cells} c""",
    "gaz": """SELECT * FROM (VALUES
 ('capital', 'Capital One', CAST(NULL AS STRING), 2.3e0, 9.1e0), ('capital', 'Capital Two', NULL, -31.5e0, 42.25e0), ('capital', 'Capital Three', NULL, 84.02e0, -12.4e0), ('capital', 'Capital Four', NULL, 12e0, 44e0),
 ('country_centroid', 'Country A', NULL, 10.004e0, 20.001e0), ('country_centroid', 'Country B', NULL, -60.2e0, 5.1e0), ('province_centroid', 'Province A', NULL, 50.3e0, 30.2e0), ('province_centroid', 'Province B', NULL, 100.9e0, 11.4e0),
 ('institution', 'Museum', 'MUSEUM', 25.25e0, 1.75e0), ('institution', 'Garden', 'BOTANICAL_GARDEN', -2.61e0, 33.3e0), ('institution', 'Garden Two', 'HERBARIUM;BOTANICAL_GARDEN', 60.75e0, -3.25e0)) v(kind, name, types, longitude, latitude)
 UNION ALL SELECT CASE record_id % 5 WHEN 0 THEN 'capital' WHEN 1 THEN 'country_centroid' WHEN 2 THEN 'province_centroid' ELSE 'institution' END, concat('near ', CAST(record_id AS STRING)),
 CASE WHEN record_id % 2 = 0 THEN 'BOTANICAL_GARDEN' ELSE 'MUSEUM' END, longitude + CAST(record_id % 4 AS DOUBLE) * 0.0021e0, latitude + CAST(record_id % 3 AS DOUBLE) * 0.0018e0 FROM {occ} o WHERE record_id % 97 = 0 AND latitude BETWEEN -80e0 AND 80e0""",
    "edges": """SELECT * FROM (VALUES (0, 0, -2.0005e0, 30.0005e0, 45.0005e0, 30.0005e0), (0, 1, 45.0005e0, 30.0005e0, 20.0005e0, 44.0005e0), (0, 2, 20.0005e0, 44.0005e0, 45.0005e0, 60.0005e0),
 (0, 3, 45.0005e0, 60.0005e0, -2.0005e0, 60.0005e0), (0, 4, -2.0005e0, 60.0005e0, -2.0005e0, 30.0005e0), (1, 0, -100.0005e0, -20.0005e0, -60.0005e0, -20.0005e0), (1, 1, -60.0005e0, -20.0005e0, -60.0005e0, 20.0005e0),
 (1, 2, -60.0005e0, 20.0005e0, -100.0005e0, 20.0005e0), (1, 3, -100.0005e0, 20.0005e0, -100.0005e0, -20.0005e0)) v(poly, seq, x1, y1, x2, y2)""",
    "scen": """SELECT row, col, lon, lat, bio12, name, 1e0 / (1e0 + ((b1 - 15e0) / 8e0) * ((b1 - 15e0) / 8e0) + ((bio12 - 900e0) / 700e0) * ((bio12 - 900e0) / 700e0)) AS suitability, b1 > 33e0 AS extrapolated
 FROM (SELECT g.*, v.name, bio1 + v.warm AS b1 FROM {grid} g CROSS JOIN (VALUES ('g1_ssp245_p1', 2e0), ('g2_ssp245_p1', 3e0), ('g1_ssp585_p1', 4e0)) v(name, warm)) s""",
    "wanted_rows": """SELECT p_partkey AS id, split(concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'bio1' END, CASE WHEN p_partkey % 3 = 0 THEN 'bio4' END, CASE WHEN p_partkey % 5 = 0 THEN 'bio1' END, CASE WHEN p_partkey % 7 = 0 THEN 'zzz' END, 'bio12'), ',') AS wanted FROM {part}""",
    "box_rows": """SELECT CAST(s_suppkey AS INT) AS id, CAST((s_suppkey * 37) % 400 - 210 AS DOUBLE) AS west, CAST((s_suppkey * 37) % 400 - 210 + s_suppkey % 60 - 5 AS DOUBLE) AS east, CAST((s_suppkey * 11) % 150 - 75 AS DOUBLE) AS south, CAST((s_suppkey * 11) % 150 - 75 + s_suppkey % 15 AS DOUBLE) AS north, CAST(s_suppkey % 4 AS INT) AS z FROM {supplier}""",
    "member_rows": """SELECT concat('m', CAST(s_suppkey AS STRING)) AS member, 0.4e0 + CAST((s_suppkey * 37) % 60 AS DOUBLE) / 100e0 AS auc FROM {supplier}""",
    "importance_rows": """SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS bio1, CAST((p_partkey * 13) % 51 AS DOUBLE) AS bio12, CAST((p_partkey * 7) % 37 AS DOUBLE) AS bio4 FROM {part}""",
    "user_rows": """SELECT c_custkey AS usr, split(concat_ws(',', 'staff', CASE WHEN c_custkey % 3 = 0 THEN 'analysts' END, CASE WHEN c_custkey % 5 = 0 THEN 'curators' END, CASE WHEN c_custkey % 7 = 0 THEN 'guests' END), ',') AS grps FROM {customer}""",
    "predictor_rows": """SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN concat('bio', CAST(1 + p_size % 19 AS STRING)) WHEN 1 THEN concat('soil_', CAST(p_size AS STRING)) WHEN 2 THEN concat('hurs_', CAST(p_size AS STRING)) WHEN 3 THEN concat('cmi_', CAST(p_size AS STRING)) WHEN 4 THEN concat('gdd', CAST(p_size AS STRING)) WHEN 5 THEN 'ai' WHEN 6 THEN concat('sfcWind_', CAST(p_size AS STRING)) WHEN 7 THEN concat('rsds_', CAST(p_size AS STRING)) ELSE concat('layer', CAST(p_size AS STRING)) END AS name FROM {part}""",
    "hook_rows": """SELECT url FROM {pages} UNION ALL SELECT concat(CASE WHEN page_id % 5 = 0 THEN 'http' ELSE 'https' END, '://', CASE page_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' ELSE CAST(page_id % 256 AS STRING) END, '.', CAST((page_id * 7) % 260 AS STRING), '.', CAST((page_id * 13) % 256 AS STRING), '.', CAST(page_id % 256 AS STRING), '/hook') FROM {pages}
 UNION ALL SELECT replace(replace(url, 'http://', 'https://'), '.example.', '.localhost.') FROM {pages} UNION ALL SELECT concat('https://[', CASE page_id % 3 WHEN 0 THEN 'fe80::' WHEN 1 THEN '2606:4700::' ELSE '::' END, CAST(page_id AS STRING), ']/x') FROM {pages}""",
}

_FIXED = {"src": ("range(64800)", "(SELECT range AS id FROM range(64800)) r0")}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or driver table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{src}", _FIXED["src"][0])
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def ctes(names: list[str]) -> str:
    """The views, with those they need, as the beginning of a DuckDB WITH clause (without WITH)."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in VIEWS:
            return
        sql = VIEWS[name].replace("{src}", _FIXED["src"][1])
        for n in _needs(sql):
            add(n)
        done[name] = sql.format(**{n: n for n in _needs(sql)})

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({q})" for n, q in done.items())
