"""Readers of record archives, uploads, polygons, paged results and point tiles."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of upload columns in order of preference, without case and punctuation.
UPLOAD_COLUMNS = {
    "longitude": ["decimallongitude", "longitude", "lon", "lng", "long", "x"],
    "latitude": ["decimallatitude", "latitude", "lat", "y"],
    "name": ["scientificname", "species", "taxon", "taxonname", "acceptedname", "name"],
    "date": ["eventdate", "date", "observationdate", "dateevent", "obsdate", "year"],
    "uncertainty": ["coordinateuncertaintyinmeters", "coordinateuncertainty", "uncertainty", "accuracy", "positionalaccuracy", "precision"],
    "status": ["occurrencestatus", "presence", "presenceabsence", "status", "detected"],
    "id": ["occurrenceid", "id", "recordid", "objectid", "fid", "catalognumber"],
}
ABSENT = ["absent", "absence", "0", "false", "no", "n", "not detected", "not found"]
PRESENT = ["present", "presence", "1", "true", "yes", "y", "detected", "found"]


def zipped_table(spark: SparkSession, path: str, batch: int = 5000) -> DataFrame:
    """Tab-separated UTF-8 tables with a header inside zip files, no quoting: ``file, fields map<string,string>``.

    A zip file is read by one task, line by line.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            text = io.TextIOWrapper(f, "utf-8", newline="\n")
                            head = text.readline().rstrip("\r\n")
                            rows: list[str] = []
                            for line in text:
                                rows.append(line.rstrip("\r\n"))
                                if len(rows) == batch:
                                    yield pa.RecordBatch.from_arrays([pa.array([name] * batch), pa.array([head] * batch), pa.array(rows)], ["file", "head", "line"])
                                    rows = []
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([head] * len(rows), pa.string()), pa.array(rows, pa.string())], ["file", "head", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    raw = files.mapInArrow(lines, "file string, head string, line string")
    pairs = F.arrays_zip(F.split("head", "\t").alias("k"), F.split("line", "\t").alias("v"))
    named = F.filter(pairs, lambda x: x["k"].isNotNull())
    return raw.select("file", F.map_from_entries(F.transform(named, lambda x: F.struct(x["k"], F.nullif(x["v"], F.lit(""))))).alias("fields"))


def sniff_delimiter(sample: str, default: str = ",") -> str:
    try:
        return csv.Sniffer().sniff(sample[:20_000], delimiters=",;\t|").delimiter
    except csv.Error:
        return default


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header (delimiter and byte order mark detected) or GeoJSON points, all columns as text."""
    if path.lower().endswith((".geojson", ".json")):
        return geojson_points(spark, path)
    sample = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())
    sep = sniff_delimiter(sample.lstrip("﻿"), "\t" if path.lower().endswith(".tsv") else ",")
    df = spark.read.csv(path, sep=sep, header=True, encoding="UTF-8", mode="PERMISSIVE", multiLine=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def detect_columns(df: DataFrame, least: float = 0.99) -> dict[str, str]:
    """Which column is which: an exact name first, then one that contains it; coordinates must fit their range in ``least`` of the rows."""
    plain = {c: "".join(ch for ch in c.lower() if ch.isalnum() and ch.isascii()) for c in df.columns}
    found: dict[str, list[str]] = {}
    for field, names in UPLOAD_COLUMNS.items():
        exact = [c for n in names for c in df.columns if plain[c] == n]
        within = [c for n in names if len(n) > 1 for c in df.columns if n in plain[c]]
        found[field] = list(dict.fromkeys(exact + within))
    out = {f: c[0] for f, c in found.items() if c and f not in ("longitude", "latitude")}
    tries = [(f, c, m) for f, m in (("longitude", 180), ("latitude", 90)) for c in found[f]]
    if tries:
        fit = df.agg(*[F.avg(F.coalesce(F.abs(decimal(F.col(f"`{c}`"))) <= m, F.lit(False)).cast("double")) for _, c, m in tries]).first()
        for (field, c, _), share in zip(tries, fit, strict=True):
            if field not in out and (share or 0) >= least:
                out[field] = c
    return out


def decimal(c: Column) -> Column:
    """A double from text with a decimal point or comma."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def upload_status(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(PRESENT), "present").when(t.isin(ABSENT), "absent")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features as rows: properties as a map of text, ``longitude`` and ``latitude``."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: array<double>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.where("f.geometry.type = 'Point'").select("f.properties", F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"))


def geojson_edges(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and multipolygon rings as edges ``poly, ring, seq, x1, y1, x2, y2`` and the feature's ``status``."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "features array<string>")["features"]).alias("poly", "f"))
    kind, coords = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    multi = F.when(kind == "Polygon", F.array(F.from_json(coords, "array<array<array<double>>>"))).otherwise(F.from_json(coords, "array<array<array<array<double>>>>"))
    rings = text.select("poly", F.get_json_object("f", "$.properties.status").alias("status"), F.posexplode(F.flatten(multi)).alias("ring", "points"))
    pairs = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    e = rings.select("poly", "status", "ring", F.posexplode(pairs).alias("seq", "e"))
    return e.select("poly", "status", "ring", "seq", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def quadrants(points: DataFrame, most: int, levels: int = 30) -> DataFrame:
    """``west, south, east, north, n``: boxes of at most ``most`` points, by halving the longer side of fuller ones.

    Halving the globe alternates between longitude and latitude, so a point's
    box at every level follows from its finest one. Points are counted once per
    finest box; a box is final if it is full enough and its parent is too full,
    or if it is of the last level (about 0.01 degrees).
    """
    fine = 2.0 ** ((levels + 1) // 2)
    side = lambda c, lo, span, n: F.least(F.greatest(F.floor((F.col(c) - lo) / (span / n)), F.lit(0)), F.lit(int(n) - 1)).cast("int")
    cells = points.groupBy(side("longitude", -180.0, 360.0, fine).alias("fx"), side("latitude", -90.0, 180.0, fine).alias("fy")).agg(F.count("*").alias("c"))
    d = cells.select("fx", "fy", "c", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    top = (levels + 1) // 2
    box = lambda f, cut: F.floor(F.col(f) / F.pow(F.lit(2.0), top - cut)).cast("int")
    cx, cy = F.floor((F.col("level") + 1) / 2.0), F.floor(F.col("level") / 2.0)
    n = d.groupBy("level", box("fx", cx).alias("bx"), box("fy", cy).alias("by")).agg(F.sum("c").alias("n"))
    # the parent's box is found by undoing the last halving
    up = n.select((F.col("level") + 1).alias("level"), F.col("bx").alias("px"), F.col("by").alias("py"), F.col("n").alias("above"))
    odd = F.col("level") % 2 == 1
    here = n.withColumns({"px": F.when(odd, F.floor(F.col("bx") / 2.0)).otherwise(F.col("bx")).cast("int"), "py": F.when(odd, F.col("by")).otherwise(F.floor(F.col("by") / 2.0)).cast("int")})
    j = here.join(up, ["level", "px", "py"], "left").where(((F.col("n") <= most) | (F.col("level") == levels)) & (F.col("above").isNull() | (F.col("above") > most)))
    w, h = 360.0 / F.pow(F.lit(2.0), cx), 180.0 / F.pow(F.lit(2.0), cy)
    return j.select((F.col("bx") * w - 180.0).alias("west"), (F.col("by") * h - 90.0).alias("south"), ((F.col("bx") + 1) * w - 180.0).alias("east"), ((F.col("by") + 1) * h - 90.0).alias("north"), "n")


class PagedSource(DataSource):
    """``spark.read.format("paged")``: result pages of a search, one partition for each range of offsets of a slice.

    Options: ``url`` with ``{offset}`` and ``{limit}`` (http, https or file),
    ``page`` (300) and ``window`` (9900, the last offset a server answers).
    Without slices, ``total`` is the number of results; one beyond the window is
    an error, since the rest could not be read. With ``count_url`` both addresses
    also have ``{west}``, ``{south}``, ``{east}`` and ``{north}``: boxes with more
    results than the window are halved along their longer side until each fits,
    down to ``least`` degrees (0.0001), where more than the window is an error.
    ``max_records`` reads of each slice a share in proportion to its results,
    rounded up. Ends of boxes belong to both sides: see ``sliced_search``.

    A page is JSON with a list under ``results``, a count JSON with ``count``;
    rows are the items as JSON text. Failed calls are repeated with growing
    pauses, or after the pause that the server names; client errors are not.
    ``pause`` seconds lie between the calls of one task.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "slice int, offset long, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


Box = tuple[float, float, float, float]


def halves(box: Box) -> tuple[Box, Box]:
    """A box cut in two across its longer side."""
    west, south, east, north = box
    if east - west >= north - south:
        middle = (west + east) / 2
        return (west, south, middle, north), (middle, south, east, north)
    middle = (south + north) / 2
    return (west, south, east, middle), (west, middle, east, north)


def slices(count: Callable[[Box], int], window: int, least: float, box: Box = (-180.0, -90.0, 180.0, 90.0)) -> list[tuple[Box, int]]:
    """Boxes of at most ``window`` results with their counts; boxes without results are left out."""
    todo, out = [box], []
    while todo:
        box = todo.pop()
        n = count(box)
        if n > window:
            if max(box[2] - box[0], box[3] - box[1]) < 2 * least:
                raise ValueError(f"{n} results lie in {box}, more than the {window} that can be read")
            todo += reversed(halves(box))
        elif n:
            out.append((box, n))
    return out


def quotas(counts: list[int], most: int | None) -> list[int]:
    """Rows to read of each slice: all, or a share of ``most`` in proportion, rounded up."""
    total = sum(counts)
    return list(counts) if most is None or total <= most else [-(-most * n // total) for n in counts]


def fetch(url: str, attempts: int, patience: float = 120.0) -> dict:
    """JSON from an address. Server errors and throttling are tried again, after the named pause if there is one."""
    import json
    import time
    import urllib.error
    import urllib.request

    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or attempt == attempts - 1:
                raise
            named = e.headers.get("Retry-After", "")
            time.sleep(min(patience, float(named) if named.replace(".", "", 1).isdigit() else 5.0 * 2**attempt if e.code == 429 else 2.0**attempt))
        except urllib.error.URLError:
            if attempt == attempts - 1:
                raise
            time.sleep(min(patience, 2.0**attempt))
    raise ValueError("no attempts")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.page, self.window = options["url"], int(options.get("page", 300)), int(options.get("window", 9900))
        self.attempts, self.pause = int(options.get("attempts", 4)), float(options.get("pause", 0))
        self.count_url, self.least = options.get("count_url"), float(options.get("least", 1e-4))
        self.most = int(options["max_records"]) if "max_records" in options else None
        self.total = int(options.get("total", 0))

    def _count(self, box: Box) -> int:
        return int(fetch(self.count_url.format(**dict(zip(("west", "south", "east", "north"), box, strict=True))), self.attempts)["count"])

    def partitions(self) -> list[InputPartition]:
        if self.count_url:
            found = slices(self._count, self.window, self.least)
            cut = [(dict(zip(("west", "south", "east", "north"), box, strict=True)), n) for (box, _), n in zip(found, quotas([n for _, n in found], self.most), strict=True)]
        elif self.total > self.window:
            raise ValueError(f"{self.total} results, more than the {self.window} that can be read: give count_url to read them by slices")
        else:
            cut = [({}, n) for n in quotas([self.total], self.most)]
        return [InputPartition((k, box, offset, min(self.page, n - offset))) for k, (box, n) in enumerate(cut) for offset in range(0, n, self.page)] or [InputPartition((0, {}, 0, 0))]

    def read(self, partition: InputPartition):
        import json
        import time

        nth, box, offset, limit = partition.value
        if limit:
            time.sleep(self.pause)
            for i, item in enumerate(fetch(self.url.format(offset=offset, limit=limit, **box), self.attempts)["results"][:limit]):
                yield nth, offset + i, json.dumps(item)


def sliced_search(spark: SparkSession, url: str, count_url: str, id_path: str = "$.key", max_records: int | None = None, **options: object) -> DataFrame:
    """``id, item``: all results of a search over the globe, each once, however many there are.

    What lies on the common side of two slices comes with both and is returned
    once, by its id. With ``max_records`` about so many are returned, spread over
    the slices like the results are.
    """
    spark.dataSource.register(PagedSource)
    given = {k: str(x) for k, x in options.items()} | ({"max_records": str(max_records)} if max_records is not None else {})
    d = spark.read.format("paged").option("url", url).option("count_url", count_url).options(**given).load()
    return d.select(F.get_json_object("item", id_path).alias("id"), "item").groupBy("id").agg(F.min("item").alias("item"))
