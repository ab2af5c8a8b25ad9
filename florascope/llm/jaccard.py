"""N-gram Jaccard self-join by grouped prefixes, exact for every pair.

Texts are sets of distinct word shingles (64-bit hashes); equal sets are one
node, so copies cost nothing. Two sets link at ``100 * common >= percent * union``.

1. Of two linked sets each has at most ``n - ceil(percent * n / 100)`` shingles
   that the other lacks. A fixed quarter of all shingles (by hash) is counted over
   the whole corpus; a set with more shingles of its own than that among them
   has no partner, whatever the rest holds. That settles most texts.
2. The shingles of the others are counted and ordered, rarest first. Linked sets
   share a shingle in their prefixes. Those that no other set has join nothing;
   what is left of a prefix, with its place and the size of the set, is the key of
   a group: its sets pass all filters alike, so groups are joined in their place.
3. The members of a group are compared with one of them, and so are the groups
   that share a prefix shingle, twice, with another in the middle each time.
   Pairs of groups that have not met by then pass length and positional filters
   and one on bitmaps: two sets differ at least by the bits in which their bitmaps
   do, so most sets that are alike but below the limit never become a pair. What
   is left is expanded to the members and verified. Pairs within one component say
   nothing new about components and are left out, so a large group of near copies
   costs no pairs.
4. All links are between members of one component, so the links of each text are
   counted there, in tiles of bounded size that return one number for a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if_small, materialize, text_key
from .components import connected_components

WORDS = 3
PERCENT = 90
#: One in 2^SAMPLE_BITS shingles, those whose leading hash bits are zero, is counted for the first filter.
SAMPLE_BITS = 2
#: Rounds in which a group, and the groups of a shingle, meet one of them.
STARS = 2
#: Shingles (repeats over members included) and sets that one side of a tile holds, about; a single larger text apart.
TILE_SHINGLES = 1_000_000
TILE_SETS = 250
#: Bits of a set's bitmap: eight for a shingle up to this many (a power of two); beyond, the bitmap tells less.
MOST_BITS = 4_096


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; fewer words are one shingle, none are no shingles."""
    return np.unique(simhash.shingle_hashes(text, words).astype(np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.uint64).view(np.int64)))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle by its low hash bits, in 64-bit words."""
    bits = min(MOST_BITS, max(64, 1 << (8 * max(len(shingles), 1) - 1).bit_length()))
    at = shingles & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text"))


def sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, text_id, node, n, sample`` of every row: digest and size of its set, and the shingles of the fixed part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = [shingle_set(_bytes(t), words) for t in b.column(2).cast(pa.binary())]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)
            part = [s[: np.searchsorted(s, np.uint64(1 << (64 - SAMPLE_BITS)))] for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in found], pa.int32()), _lists(part)], ["doc_id", "text_id", "node", "n", "sample"])

    return _given(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_id long, node long, n int, sample array<long>")


def _read_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, n, s, bits``: the shingles and bitmap of each of ``nodes(node, n, doc_id, text_id)``, from the one row that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(_bytes(t), words) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(found), _lists([bitmap(s) for s in found])], ["node", "n", "s", "bits"])

    wanted = nodes.select("node", "n", F.col("doc_id").alias("id2"), F.col("text_id").alias("text_id2"))
    rows = _given(docs, id_col, text_col).join(broadcast_if_small(wanted, wanted.count()), (F.col("text_id") == F.col("text_id2")) & F.col("doc_id").eqNullSafe(F.col("id2")))
    # repeated rows of one id and text all stand for their node
    one = rows.groupBy("node", "n").agg(F.first("text", ignorenulls=True).alias("text"))
    return one.mapInArrow(run, "node long, n int, s array<long>, bits array<long>")


def most_unshared(n: str, percent: int) -> str:
    """SQL for the number of shingles that a linked set of ``n`` can have for itself."""
    return f"({n} - ceil({percent} * {n} / 100))"


def least_common(n: str, m: str, percent: int) -> str:
    """SQL for the number of shingles that linked sets of ``n`` and ``m`` share at least."""
    return f"ceil({percent} * ({n} + {m}) / {100 + percent})"


def with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """``node, n, doc_id, text_id, copies`` of the sets that may have a partner, with one row that stands for each."""
    # copies have one node: a shingle of one node has equal ends, however often the text comes
    alone = rows.select("node", F.explode("sample").alias("t")).groupBy("t").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = alone.where("node = last").groupBy("node").agg(F.count("*").alias("own"))
    # a null id comes last
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("r")
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), first, F.count("*").alias("copies"))
    nodes = nodes.join(alone, "node", "left").where(f"coalesce(own, 0) <= {most_unshared('n', percent)}")
    return nodes.select("node", "n", "r.doc_id", "r.text_id", "copies")


def prefixes(found: DataFrame, percent: int) -> DataFrame:
    """``node, n, own, x``: what is left of each set's prefix behind its ``own`` unshared shingles; sets with nothing left are dropped."""
    tokens = found.select("node", "n", F.explode("s").alias("t"))
    often = materialize(tokens.groupBy("t").agg(F.count("*").alias("f")).where("f > 1"), "jaccard-frequency")
    shared = tokens.join(broadcast_if_small(often, often.count()), "t").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("x"))
    left = f"{most_unshared('n', percent)} + 1 - (n - size(x))"
    x = F.transform(F.expr(f"slice(x, 1, cast({left} as int))"), lambda e: e["t"])
    return shared.where(f"{left} > 0").select("node", "n", (F.col("n") - F.size("x")).alias("own"), x.alias("x"))


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of the written ``pairs(u, v)`` that link."""
    both = broadcast_if_small(pairs, pairs.count()).join(found.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su")), "u")
    both = both.join(found.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * common >= percent * (F.col("nu") + F.col("nv") - common)).select("u", "v")


def _compatible(percent: int) -> Column:
    """Sets of ``n`` and ``n2`` shingles may link."""
    return F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")


def _folded(bits: str, other: str) -> Column:
    """A bitmap in as many words as another one of half its size has (sizes of linked sets differ less)."""
    half = F.size(bits) / 2
    both = F.zip_with(F.slice(bits, F.lit(1), half.cast("int")), F.slice(bits, half.cast("int") + 1, half.cast("int")), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(bits) > F.size(other), both).otherwise(F.col(bits))


def _close(percent: int, every: str = "every", some: str = "some") -> Column:
    """Whether sets with and without ``2`` behind their names may be near enough, by the bits that all of a side have and those that any has."""
    apart = lambda a, b: F.aggregate(F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    return apart(every, f"{some}2") + apart(f"{every}2", some) <= F.expr(f"n + n2 - 2 * {least_common('n', 'n2', percent)}")


def components(found: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of all sets ``found(node, n, s)`` that link."""
    groups = prefixes(found, percent)
    key = ["n", "own", "x"]
    grouped = groups.withColumn("group", F.xxhash64(*key))
    members = materialize(grouped.select("group", "node", "n").join(found.select("node", "bits"), "node"), "jaccard-members")
    held = grouped.groupBy("group").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("x").alias("x"), F.min("node").alias("head"))
    held = materialize(held, "jaccard-groups")
    places = materialize(held.select("group", "n", "own", F.posexplode("x").alias("i", "t")).select("group", "n", (F.col("own") + F.col("i")).alias("i"), "t"), "jaccard-places")
    heads = held.select("group", "head")
    pairs = materialize(members.select("group", "node").join(heads, "group").where("node <> head").select(*_ordered("node", "head")), "jaccard-pairs")
    links = materialize(verified(pairs, found, percent), "jaccard-links")
    roots = connected_components(links)
    tried = None
    for turn in range(STARS + 1):
        # members of a group that are in one component stand together
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = materialize(rooted.groupBy("group", "root").agg(F.min("node").alias("head")), "jaccard-parts")
        # a shingle whose groups are all of one component is settled
        at = places.join(parts, "group")
        several = materialize(at.groupBy("t").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("t"), "jaccard-several")
        count = several.count()
        if not count:
            break
        at = materialize(at.join(broadcast_if_small(several, count), "t", "left_semi"), "jaccard-open")
        if turn < STARS:
            middle = at.groupBy("t").agg(F.min_by(F.struct("head", "n", "root"), F.xxhash64("head", F.lit(turn))).alias("m"))
            middle = middle.select("t", F.col("m.head").alias("head2"), F.col("m.n").alias("n2"), F.col("m.root").alias("root2"))
            pairs = at.join(broadcast_if_small(middle, count), "t").where((F.col("root") != F.col("root2")) & _compatible(percent)).select(*_ordered("head", "head2")).distinct()
        else:
            # bitmaps are wide: they are joined to what is still open, and never broadcast
            bits = materialize(_bits(rooted.join(at.select("group", "root").distinct(), ["group", "root"], "left_semi")), "jaccard-bits")
            pairs = _expanded(_group_pairs(at.join(bits, ["group", "root"]), percent), rooted, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "jaccard-tried")
        tried = pairs if tried is None else tried.unionAll(pairs)
        new = materialize(verified(pairs, found, percent), "jaccard-links")
        if not new.isEmpty():
            links = links.unionAll(new)
            roots = connected_components(links)
    return roots


def _bits(rooted: DataFrame) -> DataFrame:
    """``group, root, every, some``: the bits that all of a group's members in one component have, and those that any has."""
    words = rooted.select("group", "root", F.posexplode("bits").alias("at", "word")).groupBy("group", "root", "at")
    words = words.agg(F.bit_and("word").alias("every"), F.bit_or("word").alias("some"))
    # members of a group have sets of one size, so their bitmaps have as many words
    listed = words.groupBy("group", "root").agg(F.array_sort(F.collect_list(F.struct("at", "every", "some"))).alias("w"))
    return listed.select("group", "root", F.col("w.every").alias("every"), F.col("w.some").alias("some"))


def _group_pairs(at: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups, each with a root, that share a prefix shingle and pass the filters."""
    cols = ("group", "root", "n", "i", "every", "some")
    a = at.where(f"i <= n - ceil({2 * percent} * n / {100 + percent})").select("t", *cols)
    b = at.select("t", *[F.col(c).alias(f"{c}2") for c in cols])
    room = F.expr(f"1 + least(n - 1 - i, n2 - 1 - i2) >= {least_common('n', 'n2', percent)}")
    # the smaller set's first half of the prefix is enough; groups of one size meet once
    once = F.expr("n < n2 or n = n2 and (group < group2 or group = group2 and root < root2)")
    on = (F.col("root") != F.col("root2")) & once & _compatible(percent) & room & _close(percent)
    return a.join(b, "t").where(on).select("group", "root", "group2", "root2").distinct()


def _expanded(pairs: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(rooted.select("group", "root", F.col("node").alias("a"), "n", "bits"), ["group", "root"])
    right = rooted.select(*[F.col(c).alias(f"{c}2") for c in ("group", "root", "n", "bits")], F.col("node").alias("b"))
    return left.join(right, ["group2", "root2"]).where(_close(percent, "bits", "bits")).select(*_ordered("a", "b")).distinct()


def _linked(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> np.ndarray:
    """For each set of ``a`` the copies of the sets of ``b`` that it links with."""
    if not len(a) or not len(b):
        return np.zeros(len(a), np.int64)
    sizes = b["n"].to_numpy(np.int64)
    tokens, at = np.unique(np.concatenate(b["s"].to_numpy()), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marked, out = np.zeros(len(tokens), np.int64), []
    for s, n in zip(a["s"], a["n"], strict=True):
        place = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        place = place[tokens[place] == s]
        marked[place] = 1
        common = np.add.reduceat(marked[at], starts)
        marked[place] = 0
        out.append(int(b["copies"].to_numpy()[100 * common >= percent * (n + sizes - common)].sum()))
    return np.array(out, np.int64)


def link_counts(members: DataFrame, percent: int) -> DataFrame:
    """``node, linked`` of ``members(root, node, n, s, copies)``: rows of the component, its own included, whose set links with the node's."""
    size = members.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / TILE_SHINGLES, F.count("*") / TILE_SETS)).cast("int").alias("parts"))
    m = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": a["node"].to_numpy(np.int64), "linked": _linked(a, b, percent)})

    cut = [F.col(c).alias(c) for c in ("root", "node", "n", "s", "copies")]
    rows, meet = m.select(*cut, F.col("own").alias("p"), other.alias("q")), m.select(*cut, other.alias("p"), F.col("own").alias("q"))
    each = rows.groupBy("root", "p", "q").cogroup(meet.groupBy("root", "p", "q")).applyInPandas(tile, "node long, linked long")
    return each.groupBy("node").agg(F.sum("linked").alias("linked"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own
    included; n_links counts the other rows that the row's set links with, copies
    included. Null, empty and blank texts have no shingles, link with nothing and
    keep their own id. A row with a null id gets its component's smallest id (null
    if that has none). Repeated rows are copies and are returned as often as they
    come. Very long texts are compared whole. No rows give no rows. Extra columns
    are not read. Sets and shingles are told apart by 64-bit hashes.
    """
    rows = materialize(sets(docs, id_col, text_col, words), "jaccard-rows")
    nodes = materialize(with_partner(rows, percent), "jaccard-nodes")
    found = materialize(_read_sets(docs, nodes, id_col, text_col, words), "jaccard-sets")
    roots = materialize(components(found, percent), "jaccard-roots")
    linked = materialize(link_counts(roots.join(found, "node").join(nodes.select("node", "copies"), "node"), percent), "jaccard-degrees")
    every = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    every = every.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = every.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = every.join(smallest, "root").join(linked, "node", "left").select("node", "component_id", (F.coalesce("linked", "copies") - 1).alias("n_links"))
    of = materialize(of, "jaccard-classes")
    out = rows.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(of, "node", "left")
    own = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
