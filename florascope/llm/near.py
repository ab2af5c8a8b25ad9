"""Near duplicates by exact five-word Jaccard similarity: SimHash links first, then what lies beyond their radius.

Used by the pipeline's stage. Distinct texts only are joined, and every link is
verified on the texts' sets of shingle hashes.

1. The trie join of ``simhash`` over five-word fingerprints proposes the pairs
   within its radius; they settle most near copies.
2. At a similarity of 0.8 two 64-bit fingerprints are 9.7 +- 2.9 bits apart
   (angle of the shingle sets), so a radius that finds such pairs has roots of a
   few bits only and its join is quadratic. The rest is found by MinHash: 192
   minima in 32 bands of six; two texts of similarity ``s`` share a band with
   probability ``1 - (1 - s^6)^32``, 0.99994 at 0.8, unrelated texts share none.
   The members of a bucket are first compared with one of them.
3. Texts of buckets that still hold several components are joined exactly, with
   prefix, length and positional filters on shingles in the order of their
   frequency. A text with too many shingles of its own meets no one, so texts
   that share bands with a large group and stay below 0.8 cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if_small, materialize, text_key
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Rounds in which the members of a bucket meet one of them, before what is left is joined exactly.
STARS = 2
SEED = 42


def band_keys(shingles: np.ndarray, factors: np.ndarray) -> list[int]:
    """One key for each band, the hash of its minima and its number."""
    import xxhash

    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):  # bounded memory for very long texts
        low = np.minimum(low, (shingles[at : at + 1024, None] * factors).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)]


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype(np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.uint64).view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, node, n, fp, bands`` of every row: digest of the text, distinct shingles, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for b in batches:
            hashes = [simhash.shingle_hashes(_bytes(t), words) for t in b.column(2).cast(pa.binary())]
            fps = np.array([simhash.majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            sets = [_set(h) for h in hashes]
            bands = _lists([np.array(band_keys(s, factors), dtype=np.uint64) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), bands], ["doc_id", "node", "n", "fp", "bands"]
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, node long, n int, fp long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, s``: the shingle set of each of ``nodes(node, first_id)``; of a text's copies the one of that id is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_set(simhash.shingle_hashes(_bytes(t), words)) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], ["node", "s"])

    wanted = materialize(nodes.select(F.col("node").alias("node2"), "first_id"), "near-members")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    texts = given.join(broadcast_if_small(wanted, wanted.count()), (F.col("node") == F.col("node2")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return texts.groupBy("node").agg(F.first("text", ignorenulls=True).alias("text")).mapInArrow(run, "node long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(u, v)`` whose sets reach the similarity; two texts without words are alike."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(shared >= similarity * (F.size("su") + F.size("sv") - shared) - 1e-9).select("u", "v")


def _ordered(u: str, v: str) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of texts with equal fingerprints (each with one of them) or with fingerprints within the radius."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fp")
    equal = nodes.join(firsts, "fp").where("node <> first").select(*_ordered("node", "first"))
    near = simhash.links(firsts.select("fp")).withColumnsRenamed({"u": "fp", "v": "other"})
    near = near.join(firsts, "fp").select("other", F.col("first").alias("a")).join(firsts.withColumnRenamed("fp", "other"), "other")
    return equal.unionAll(near.select(*_ordered("a", "first")))


def prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: candidates among ``texts(node, n, root, s)`` of different roots; all pairs of the similarity are among them.

    Shingles are ordered by frequency, rarest first. The smaller set of a similar
    pair shares one of its first ``n - ceil(2t / (1 + t) * n) + 1`` with one of the
    larger's first ``n - ceil(t * n) + 1``, their sizes differ by a factor of ``t``
    at most, and behind the first common one both must have room for the rest.
    """
    t, e = similarity, 1e-9
    tokens = texts.select("node", "n", "root", F.explode("s").alias("t"))
    often = materialize(tokens.groupBy("t").agg(F.count("*").alias("f")).where("f > 1"), "near-frequency")
    ranked = tokens.join(broadcast_if_small(often, often.count()), "t", "left").select("node", "n", "root", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t").alias("x"))
    ranked = ranked.groupBy("node", "n", "root").agg(F.array_sort(F.collect_list("x")).alias("x"))
    firsts = ranked.select("node", "n", "root", F.posexplode(F.expr(f"slice(x, 1, n - int(ceil({t} * n - {e})) + 1)")).alias("i", "x"))
    # a shingle that one text alone has joins nothing
    firsts = materialize(firsts.where("x.f > 1").select("node", "n", "root", "i", F.col("x.t").alias("t")), "near-prefixes")
    a = firsts.where(f"i <= n - ceil({2 * t / (1 + t)} * n - {e})")
    b = firsts.select("t", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "i")])
    room = f"1 + least(n - 1 - i, n2 - 1 - i2) >= {t / (1 + t)} * (n + n2) - {e}"
    on = (F.col("root") != F.col("root2")) & F.expr(f"(n < n2 or n = n2 and node < node2) and n >= {t} * n2 - {e} and {room}")
    return a.join(b, "t").where(on).select(*_ordered("node", "node2")).distinct()


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``(node, root)`` of the components over pairs of the similarity (nodes without a link are left out)."""
    close = F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - 1e-9
    spread = nodes.select("node", "n", F.explode("bands").alias("key"))
    # counted on the map side first and joined back: one key may hold a large part of all texts
    held = spread.groupBy("key").count().where("count > 1").select("key")
    shared = materialize(spread.join(held, "key"), "near-buckets")
    tried = materialize(_simhash_pairs(nodes), "near-pairs")
    members = shared.select("node").unionAll(tried.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = materialize(_sets(docs, members.join(nodes.select("node", "first_id"), "node"), id_col, text_col, words), "near-sets")
    found = materialize(_verified(tried, sets, similarity), "near-links")
    roots = connected_components(found)
    for turn in range(STARS + 1):
        # buckets that lie within one component are settled
        placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = materialize(placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"), "near-several")
        open_keys = several.count()
        placed = materialize(placed.join(broadcast_if_small(several, open_keys), "key", "left_semi"), "near-open")
        if turn < STARS:
            # another member stands in the middle each time
            first = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("first"))
            first = first.select("key", F.col("first.node").alias("v"), F.col("first.n").alias("m"), F.col("first.root").alias("other"))
            # one row a key: while they fit a broadcast, a large bucket stays spread over its tasks
            pairs = placed.join(broadcast_if_small(first, open_keys), "key").where((F.col("root") != F.col("other")) & close).select(*_ordered("node", "v")).distinct()
        else:
            pairs = prefix_pairs(placed.select("node", "n", "root").distinct().join(sets, "node"), similarity)
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"), "near-pairs")
        tried = tried.unionAll(pairs)
        new = materialize(_verified(pairs, sets, similarity), "near-links")
        if not new.isEmpty():
            found = found.unionAll(new)
            roots = connected_components(found)
    return roots


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, root`` for every row of ``docs``; rows of one root are near duplicates.

    Texts are linked if their word shingles have a Jaccard similarity of
    ``similarity`` or more, and links are followed. Words are lower-cased runs of
    non-blanks; null texts count as empty, and texts without words are alike.
    """
    rows = materialize(signatures(docs, id_col, text_col, words), "near-rows")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    roots = links(docs, nodes, id_col, text_col, words, similarity)
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every near-duplicate group (see ``groups``): the one with the smallest id.

    A null id counts as larger than any other, so such a row stays only if its
    group has no id at all. Rows of one id with different texts are told apart:
    each belongs to the group of its own text, and if they are of one group the
    smaller text digest stays. Repeated rows are copies. Null, empty and blank
    texts are one group. Very long texts are compared whole. No rows give no
    rows. Other columns, whatever their names, pass through unchanged.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    kept = groups(docs, id_col, text_col).groupBy("root").agg(F.min(rank).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.node").alias("keep_node"))
    # the row as one struct: its columns cannot clash with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("node"))
    one = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node")), "left_semi")
    first = Window.partitionBy("id", "node").orderBy(F.xxhash64("row"))
    return one.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
