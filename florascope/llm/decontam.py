"""Benchmark decontamination by SimHash of item-sized windows (DataFrame operations only).

A benchmark item of L words is compared with windows of L words of every
document, or with the whole of a shorter one, by the weighted Jaccard similarity
of their five-word shingles (repeats count).

A window without any of the benchmark's shingles has similarity 0 with every
item, so windows are taken where at least one stands; the look-up says where,
and decides no more. Each such window gets a SimHash fingerprint over all its
shingles. A multi-index of ``radius + 1`` bit blocks per length finds the items:
two fingerprints within the radius agree on a whole block. Distinct fingerprints
only are looked up, so copies of a passage cost one. The exact weighted
similarity then decides every candidate. Documents shorter than an item are one
window of other size; their fingerprints rest on few shingles, so every item that
shares a shingle is verified.

The corpus side is never shuffled but for its hits; the benchmark side is
broadcast while its counted size allows, and joined by shuffle beyond.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, text_key
from .words import normalised

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows at the similarity limit differ in 9.7 +- 2.9 of 64 bits (angle of the shingle vectors): 1 in 10 000 lies beyond.
RADIUS = 20


def _words(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the array of words ``w`` and their number ``n``."""
    d = df.withColumn("w", F.split(F.trim(normalised(F.lower(F.coalesce(text_col, F.lit(""))))), " ")).drop(text_col)
    return d.withColumn("n", F.when(F.element_at("w", 1) == "", 0).otherwise(F.size("w")))


def _shingle(at: str, k: int) -> str:
    """SQL for the hash of the ``k`` words from index ``at``."""
    return f"xxhash64({', '.join(f'w[{at} + {j}]' for j in range(k))})"


def _simhash(hashes: str) -> Column:
    """SimHash of an array of 64-bit hashes: a bit is set if over half of them set it.

    Four bits are counted at once, in 16-bit lanes of one long; arrays beyond a lane's range are counted bit by bit.
    """
    lanes = f"transform(sequence(0, 15), j -> aggregate({hashes}, 0L, (c, h) -> c + (shiftrightunsigned(h, j) & 281479271743489L)))"
    fast = f"transform(array({lanes}), c -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * (shiftrightunsigned(c[b % 16], 16 * cast(b div 16 as int)) & 65535L) > size({hashes}), shiftleft(1L, b), 0L)))[0]"
    slow = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * aggregate({hashes}, 0, (c, h) -> c + cast(shiftright(h, b) & 1L as int)) > size({hashes}), shiftleft(1L, b), 0L))"
    return F.expr(f"if(size({hashes}) <= 65535, {fast}, {slow})")


def _tagged(hashes: str) -> Column:
    """The hashes with their occurrence number mixed in, so that a set of them stands for the multiset."""
    return F.expr(
        f"if(size(array_distinct({hashes})) = size({hashes}), transform({hashes}, h -> xxhash64(h, 0)),"
        f" transform({hashes}, (h, i) -> xxhash64(h, size(filter(slice({hashes}, 1, i), x -> x = h)))))"
    )


def _edges(radius: int) -> list[tuple[int, int]]:
    """First bit and mask of each of ``radius + 1`` blocks of the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block(fp: Column, a: int, mask: int) -> Column:
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(mask).cast("long"))


def _blocks(fp: str, radius: int) -> Column:
    """``(block number, bits of it)`` for each block."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col(fp), a, mask).alias("bits")) for i, (a, mask) in enumerate(_edges(radius))]))


def _links(docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Links of the items whose shingles have ``k`` words."""
    items = items.select("item_id", F.col("n").alias("len"), F.expr(f"transform(sequence(0, n - {k}), i -> {_shingle('i', k)})").alias("hs"))
    items = items.select("item_id", "len", "hs", _simhash("hs").alias("ifp"), _tagged("hs").alias("it"))
    items = materialize(items, "bench-items")
    known = materialize(items.select(F.explode("hs").alias("h"), "len").distinct(), "bench-shingles")
    n_known = known.count()
    # what a broadcast of items weighs is their shingles, not their number
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()

    # places are exploded, not shingles: each is hashed and looked up inside one generated loop
    at = docs.where(F.col("n") >= k).select("doc_id", "_text", "n", "w", F.explode(F.expr(f"sequence(0, n - {k})")).alias("pos"))
    hits = at.select("doc_id", "_text", "n", "pos", F.expr(_shingle("pos", k)).alias("h")).join(broadcast_if_small(known, n_known), "h")
    by_doc = hits.groupBy("doc_id", "_text", "n", "len").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("a"))
    by_doc = materialize(by_doc.withColumn("m", F.col("len") - (k - 1)), "bench-hits")
    short = _short_links(by_doc.where("n < len"), items, n_shingles, k, similarity)
    long = by_doc.where("n >= len")
    # all shingles of the documents that have a window
    keys = materialize(long.select("doc_id", "_text").distinct(), "bench-docs")
    whole = docs.join(broadcast_if_small(keys.withColumnsRenamed({"doc_id": "id2", "_text": "text2"}), keys.count()), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("_text") == F.col("text2")), "left_semi")
    whole = whole.groupBy("doc_id", "_text").agg(F.first("w").alias("w"), F.first("n").alias("n"))  # repeated rows once
    whole = whole.select(F.col("doc_id").alias("id2"), F.col("_text").alias("text2"), F.expr(f"transform(sequence(0, n - {k}), i -> {_shingle('i', k)})").alias("hs"))
    # a window's first known shingle is a[i]: it starts behind a[i - 1]
    windows = long.select("doc_id", "_text", "n", "len", "m", F.explode(F.expr("transform(a, (x, i) -> struct(if(i = 0, -1, a[greatest(i - 1, 0)].pos) as before, x.pos as pos))")).alias("x"))
    windows = windows.select("*", F.expr("greatest(0, x.before + 1, x.pos - m + 1)").alias("low"), F.expr("least(x.pos, n - len)").alias("high")).where("low <= high")
    # little data, much work: as many tasks as the session shuffles to
    windows = windows.join(whole, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("_text") == F.col("text2"))).select("doc_id", "_text", "len", "m", "hs", F.explode(F.expr("sequence(low, high)")).alias("s"))
    windows = windows.select("doc_id", "_text", "len", "m", "s", F.expr("slice(hs, s + 1, m)").alias("ws"))
    windows = materialize(windows.withColumn("wfp", _simhash("ws")), "bench-windows")
    probe = windows.select("len", "wfp").distinct().select("*", _blocks("wfp", radius).alias("key")).select("len", "wfp", "key.*")
    index = items.select("len", "item_id", "ifp", _blocks("ifp", radius).alias("key")).select("len", "item_id", "ifp", "key.*")
    x = F.col("wfp").bitwiseXOR(F.col("ifp"))
    first = F.coalesce(*[F.when(_block(x, a, mask) == 0, F.lit(i)) for i, (a, mask) in enumerate(_edges(radius))])
    index = broadcast_if_small(index.withColumnsRenamed({"len": "len2", "block": "block2", "bits": "bits2"}), n_items * (radius + 1), 50_000)
    # a pair that agrees on several blocks is taken once
    same_block = (F.col("len") == F.col("len2")) & (F.col("block") == F.col("block2")) & (F.col("bits") == F.col("bits2"))
    pairs = probe.join(index, same_block & (F.bit_count(x) <= radius) & (F.col("block") == first))
    pairs = materialize(pairs.select("len", "wfp", "item_id", F.bit_count(x).cast("int").alias("hamming")), "bench-pairs")
    found = windows.join(broadcast_if_small(pairs, pairs.count(), 100_000), ["len", "wfp"]).join(broadcast_if_small(items.select("item_id", "it"), n_shingles), "item_id")
    found = found.withColumn("o", F.size(F.array_intersect(_tagged("ws"), F.col("it"))))
    found = found.withColumn("similarity", F.col("o") / (2 * F.col("m") - F.col("o"))).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "_text", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by(F.struct("s", "hamming"), F.struct("similarity", -F.col("s"))).alias("w")
    )
    return best.unionAll(short)


def _short_links(by_doc: DataFrame, items: DataFrame, n_shingles: int, k: int, similarity: float) -> DataFrame:
    """Links of documents shorter than the item, as a whole; every item that shares a shingle is verified.

    Their own number of shingles differs from the item's, and fingerprints of
    few and uneven numbers of shingles are too far apart for the radius. Known
    shingles are all that such a document can share, so too few of them end it.
    """
    index = items.select("item_id", "len", F.explode(F.array_distinct("hs")).alias("h"))
    t = similarity / (1 + similarity)
    whole = by_doc.withColumns({"md": F.col("n") - (k - 1), "ws": F.expr("transform(a, x -> x.h)")}).where(F.size("ws") >= F.ceil((F.col("m") + F.col("md")) * t - 1e-9))
    probe = whole.withColumn("h", F.explode(F.array_distinct("ws")))
    pairs = probe.join(broadcast_if_small(index, n_shingles), ["len", "h"]).groupBy("doc_id", "_text", "item_id", "m").agg(*[F.first(c).alias(c) for c in ("md", "ws")])
    # an item's own shingles are joined to its candidates once, not carried by each of them in the index
    pairs = pairs.join(broadcast_if_small(items.select("item_id", F.col("len").alias("len2"), "it", "ifp"), n_shingles), "item_id").where(F.col("m") == F.col("len2") - (k - 1))
    pairs = pairs.withColumn("o", F.size(F.array_intersect(_tagged("ws"), F.col("it")))).withColumn("similarity", F.col("o") / (F.col("m") + F.col("md") - F.col("o"))).where(F.col("similarity") >= similarity)
    hamming = F.bit_count(_simhash("ws").bitwiseXOR(F.col("ifp"))).cast("int")
    return pairs.select("doc_id", "_text", "item_id", "similarity", F.struct(F.lit(0).alias("s"), hamming.alias("hamming")).alias("w"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, similarity: float, radius: int) -> DataFrame:
    """``doc_id, _text, item_id, similarity, w`` for each document, known by id and text digest, and item."""
    d = _words(docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_text"), F.col(text_col).alias("text")), "text")
    items = _words(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct(), "text").where("n > 0")
    sizes = sorted(r["k"] for r in items.select(F.least("n", F.lit(WORDS)).alias("k")).distinct().collect())  # 1 to 5
    out = None
    for k in sizes:
        part = _links(d, items.where(F.least("n", F.lit(WORDS)) == k), k, similarity, radius)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, _text long, item_id long, similarity double, w struct<s:int,hamming:int>")
    # an id with several texts in the benchmark counts as one item
    best = F.max_by(F.struct("similarity", "w"), F.struct("similarity", -F.col("w.s"))).alias("b")
    return out.groupBy("doc_id", "_text", "item_id").agg(best).select("doc_id", "_text", "item_id", "b.similarity", "b.w")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, item_id, similarity, window_start, hamming``: one row per document and item it contains.

    The best window counts, the earliest of equal ones; a document shorter than
    an item is its one window, compared by both sides' own numbers of shingles.
    Words are runs of letters and digits, lower-cased. Items of fewer than five
    words are one shingle of all their words; items and documents without words,
    null texts and empty tables give no rows. Repeated documents give one row
    per item; rows with a null or shared id are told apart by their texts, so an
    id with several texts may give several rows. Very long texts are searched
    whole. Extra columns are not read.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity, radius)
    return found.select("doc_id", "item_id", "similarity", F.col("w.s").alias("window_start"), F.col("w.hamming").alias("hamming"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text contains a benchmark item.

    A row goes by its id and text: a contaminated text without an id goes, a
    clean row that shares its id with a contaminated one stays. Repeated rows
    share their fate. Null, empty and short texts without an item stay. Very long
    texts are searched whole. No rows give no rows. Other columns, whatever their
    names, pass through unchanged.
    """
    found = materialize(_found(docs, benchmark, id_col, text_col, item_col, item_text_col, SIMILARITY, RADIUS).select(F.col("doc_id").alias("id2"), F.col("_text").alias("text2")).distinct(), "bench-found")
    # the row as one struct: its columns cannot clash with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    kept = rows.join(broadcast_if_small(found, found.count()), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("text2")), "left_anti")
    return kept.select("row.*")
