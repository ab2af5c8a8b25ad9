"""Point tiles: cover of a box, decoding of vector tiles, georeference of their points."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

TILE_PIXELS = 512
MAX_TILES = 64


class _Message:
    """A cursor over one protobuf message."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        shift = value = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def __iter__(self):
        width = {1: 8, 5: 4}
        while self.at < len(self.data):
            tag = self.number()
            kind = tag & 7
            if kind not in (0, 1, 2, 5):
                raise ValueError(f"wire type {kind} is not part of vector tiles")
            yield tag >> 3, self.number() if kind == 0 else self.take(width[kind] if kind in width else self.number())

    def numbers(self) -> list[int]:
        out = []
        while self.at < len(self.data):
            out.append(self.number())
        return out


def _signed(n: int) -> int:
    return -(n + 1) // 2 if n & 1 else n // 2


def _scalar(data: bytes) -> str:
    """The text of a tile value."""
    ((field, v),) = list(_Message(data))[:1]
    read = {
        1: lambda: v.decode(), 2: lambda: repr(struct.unpack("<f", v)[0]), 3: lambda: repr(struct.unpack("<d", v)[0]),
        4: lambda: str(v - (1 << 64) * (v >> 63)), 5: lambda: str(v), 6: lambda: str(_signed(v)), 7: lambda: str(bool(v)).lower(),
    }
    return read[field]()


def tile_points(data: bytes, layer: str | None = None):
    """``(x, y, extent, properties)`` of the points inside the first matching layer."""
    for field, body in _Message(data):
        if field != 3:
            continue
        parts: dict[int, list] = {k: [] for k in range(1, 16)}
        for f, v in _Message(body):
            parts[f].append(v)
        if layer is not None and (not parts[1] or parts[1][0].decode() != layer):
            continue
        extent = parts[5][0] if parts[5] else 4096
        keys, values = [k.decode() for k in parts[3]], [_scalar(v) for v in parts[4]]
        for feature in parts[2]:
            f = dict(_Message(feature))
            tags = _Message(f.get(2, b"")).numbers()
            shape = _Message(f.get(4, b"")).numbers()
            props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=False)}
            x = y = at = 0
            while at < len(shape) and shape[at] & 7 == 1:  # move-to commands are points
                for k in range(shape[at] >> 3):
                    x += _signed(shape[at + 1 + 2 * k])
                    y += _signed(shape[at + 2 + 2 * k])
                    if 0 <= x < extent and 0 <= y < extent:
                        yield x, y, extent, props
                at += 1 + 2 * (shape[at] >> 3)
        return


@udtf(returnType="x int, y int, extent int, properties map<string,string>")
class DecodeTile:
    """SQL: ``SELECT t.*, p.* FROM tiles t, LATERAL decode_tile(t.data, 'layer') p``."""

    def eval(self, data: bytes, layer: str):
        if data is not None:
            yield from tile_points(bytes(data), layer)


def decode(tiles: DataFrame, layer: str, data: str = "data") -> DataFrame:
    """``tiles`` joined with the points of each tile."""
    tiles.sparkSession.udtf.register("decode_tile", DecodeTile)
    tiles.createOrReplaceTempView("_tiles")
    keep = ", ".join(f"t.`{c}`" for c in tiles.columns if c != data)
    return tiles.sparkSession.sql(f"SELECT {keep}, p.* FROM _tiles t, LATERAL decode_tile(t.`{data}`, '{layer}') p")


def zoom(pixel_degrees: Column, most: int = 16) -> Column:
    """The coarsest zoom whose pixels are no larger than ``pixel_degrees``."""
    z = F.ceil(F.log2(F.lit(180.0 / TILE_PIXELS) / pixel_degrees) - 1e-9).cast("int")
    return F.least(F.greatest(z, F.lit(0)), F.lit(most))


def tile_cover(boxes: DataFrame) -> DataFrame:
    """``boxes(west, south, east, north, z)`` with the tiles ``x, y`` that cover each; zoom is lowered to at most MAX_TILES tiles."""
    def tiles(z: Column) -> Column:
        span = 180.0 / F.pow(F.lit(2.0), z)
        nx = F.least(F.pow(F.lit(2.0), z + 1), F.ceil((F.col("east") + 180.0) / span)) - F.greatest(F.lit(0.0), F.floor((F.col("west") + 180.0) / span))
        ny = F.least(F.pow(F.lit(2.0), z), F.ceil((90.0 - F.col("south")) / span)) - F.greatest(F.lit(0.0), F.floor((90.0 - F.col("north")) / span))
        return nx * ny

    levels = F.sequence(F.lit(0), F.col("z"))
    fit = F.array_max(F.filter(levels, lambda k: (tiles(k) <= MAX_TILES) | (k == 0)))
    d = boxes.withColumn("z", fit).withColumn("span", 180.0 / F.pow(F.lit(2.0), F.col("z")))
    first = lambda c: F.greatest(F.lit(0), F.floor(c / F.col("span"))).cast("int")
    last = lambda c, top: (F.least(top.cast("int"), F.ceil(c / F.col("span")).cast("int")) - 1)
    d = d.withColumn("x", F.explode(F.sequence(first(F.col("west") + 180.0), last(F.col("east") + 180.0, F.pow(F.lit(2.0), F.col("z") + 1)))))
    return d.withColumn("y", F.explode(F.sequence(first(90.0 - F.col("north")), last(90.0 - F.col("south"), F.pow(F.lit(2.0), F.col("z")))))).drop("span")


def pixel_centre(z: Column, x: Column, y: Column, px: Column, py: Column, extent: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a tile pixel's centre."""
    span = 180.0 / F.pow(F.lit(2.0), z)
    return -180.0 + (x + (px + 0.5) / extent) * span, 90.0 - (y + (py + 0.5) / extent) * span
