"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised where they lie, cut into pieces of at most
``capacity`` tokens and packed. A packing plan depends on nothing but how many
pieces there are of each length, a table of at most ``capacity`` rows, so the
plan is made from that histogram alone whatever the corpus size. Spark then
numbers the pieces within each length (salted, so one hot length is spread
over many tasks) and each piece looks up its place from its number.

Plan: take the longest length left, leaving a gap. Single lengths, pair sums
and triple sums are looked up by the gap as key; combinations that fill it
exactly are consumed as often as the counts allow. When no combination of up to
three fills a gap exactly, the residual pieces are packed best-fit: the longest
piece that fits goes in until nothing fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Byte-level BPE split pattern (fixed values; possessive form of the public one).
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CAPACITY = 2048
#: Rows of one length that a single numbering task may hold, before salting adds buckets.
ROWS_PER_BUCKET = 500_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def load_encoder(json_path: str):
    """``text -> list of ids`` for the byte-level BPE vocabulary file of ``tokenizers``.

    The vocabulary is read from the given file; ids are the file's own. The strings
    of the file's added tokens get their ids wherever they stand in a text, as
    ``tokenizers`` encodes by default.
    """
    import json

    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    # the byte-to-printable-character table of byte-level BPE, from its rule
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    back = {c: b for b, c in chars.items()}
    ranks = {bytes(back[c] for c in tok): i for tok, i in model["vocab"].items() if all(c in back for c in tok) and i < 50256}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if added and any(t[flag] for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or whole words are not supported")
    encoding = tiktoken.Encoding("bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)


def piece_rows(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, salts: int, id_col: str, text_col: str) -> DataFrame:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                n = len(raw)
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity if k == 0 else capacity
                    crc = zlib.crc32(raw[at : at + size])
                    for col, v in zip(out, (doc, k, at, size, crc, hash((doc, k, crc)) % salts), strict=True):
                        col.append(v)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(how many sequences, [(length, pieces of it in each)])``.

    ``counts[l]`` is the number of pieces of length ``l``; it is consumed.
    """
    counts = counts.astype(np.int64).copy()
    patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def use(lengths: list[int]) -> None:
        kinds, each = np.unique(lengths, return_counts=True)
        times = int(min(counts[k] // e for k, e in zip(kinds, each, strict=True)))
        for k, e in zip(kinds, each, strict=True):
            counts[k] -= times * e
        patterns.append((times, [(int(k), int(e)) for k, e in zip(kinds[::-1], each[::-1], strict=True)]))

    def fits(lengths: list[int]) -> bool:
        return all(counts[k] >= lengths.count(k) for k in set(lengths))

    def complement(top: int, gap: int) -> list[int] | None:
        if gap == 0:
            return [top]
        if fits([top, gap]):
            return [top, gap]
        live = np.flatnonzero(counts[: gap + 1])
        live = live[live > 0]
        # pairs: the complement gap - a of each live length a, longest first
        pairs = live[(counts[gap - live] > 0) & (live >= gap - live) & (live < gap)]
        for a in pairs[::-1]:
            if fits([top, int(a), int(gap - a)]):
                return [top, int(a), int(gap - a)]
        # triples: a >= b >= c with c = gap - a - b, found by the same hashed lookup
        for a in live[::-1]:
            rest = gap - int(a)
            if rest < 2 or 3 * int(a) < gap:
                continue
            two = live[(live < rest) & (live <= a)]
            two = two[(counts[rest - two] > 0) & (two >= rest - two)]
            for b in two[::-1]:
                if fits(found := [top, int(a), int(b), int(rest - b)]):
                    return found
        return None

    residual = np.zeros_like(counts)
    for top in range(capacity, 0, -1):
        while counts[top] > 0:
            if (found := complement(top, capacity - top)) is None:
                residual[top], counts[top] = counts[top], 0
                break
            use(found)
    counts = residual
    for top in range(capacity, 0, -1):
        while counts[top] > 0:
            counts[top] -= 1
            gap, kinds = capacity - top, {top: 1}
            while gap > 0:
                live = np.flatnonzero(counts[: gap + 1])
                if not len(live) or live[-1] == 0:
                    break
                best = int(live[-1])
                n = int(min(counts[best], gap // best))
                kinds[best] = kinds.get(best, 0) + n
                counts[best] -= n
                gap -= n * best
            for k, e in kinds.items():
                counts[k] += e
            times = int(min(counts[k] // e for k, e in kinds.items()))
            for k, e in kinds.items():
                counts[k] -= times * e
            patterns.append((times, sorted(kinds.items(), reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the numbers from which a run of places starts, its first sequence, pieces per sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    next_no: dict[int, int] = {}
    seq = 0
    for times, kinds in patterns:
        offset = 0
        for length, each in kinds:
            runs.setdefault(length, []).append((next_no.get(length, 0), seq, each, offset))
            next_no[length] = next_no.get(length, 0) + times * each
            offset += length * each
        seq += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece with its place.

    Null or empty texts are one piece holding the end id alone. A document longer
    than ``capacity`` tokens is cut so that only its first piece is shorter.
    Repeated rows and null ids are packed like any other row; pieces of equal
    length are interchangeable, so ties don't matter. Very long texts are encoded
    whole. The strings of added tokens get their ids. No rows give no rows. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    salts = 4096
    pieces = materialize(piece_rows(docs, tokenizer_path, capacity, end_id, salts, id_col, text_col), "pieces")
    hist = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    places = slots(plan_patterns(counts, capacity))
    buckets = int(min(salts, max(32, -(-int(counts.max()) // ROWS_PER_BUCKET))))

    split = pieces.withColumn("salt", F.col("salt") % F.lit(buckets))
    base = (
        split.groupBy("length", "salt").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
        .select("length", "salt", "before")
    )
    rank = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = split.withColumn("no", F.row_number().over(rank)).join(base, ["length", "salt"]).withColumn("no", F.col("no") - 1 + F.col("before"))

    sent = spark.sparkContext.broadcast(places)  # a few runs for each of at most `capacity` lengths

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, no: pd.Series) -> pd.DataFrame:
        n, size = no.to_numpy(), length.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            first, first_seq, each, first_off = sent.value[int(k)]
            run = np.searchsorted(first, n[at], side="right") - 1
            nth = n[at] - first[run]
            seq[at] = first_seq[run] + nth // each[run]
            off[at] = first_off[run] + nth % each[run] * int(k)
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return numbered.withColumn("p", place("length", "no")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "p.sequence_id", "p.offset"
    )
