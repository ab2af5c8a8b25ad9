"""SimHash near-duplicate detection with a binary-trie self-join.

Fingerprints that differ in at most ``budget`` bits are linked. Distinct
fingerprints only are joined (copies share one), so a group of copies costs one
node. Two steps make the join. Above 32 bits it is a repartition, not a walk:
the 64 bits fall into four blocks, two fingerprints within two bits agree on at
least two whole blocks, and for each of the six block pairs the fingerprints are
rotated so that those 32 bits come first and dealt out by them. Below, in the
subtree of a common 32-bit root, the binary trie is walked: node pairs are
traversed together, differing bits are accumulated, and a pair is pruned once
its error exceeds the budget. A walk from bit 0 would send every fingerprint to
the tasks of all prefixes within two bits, 79 for 12-bit prefixes instead of
six. A pair is reported only for the first of the six roots that both share.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

BUDGET = 2
SHINGLE = 3
SEED = 42
BLOCKS = 4
#: Subtrees above this many distinct fingerprints are cut into salted halves that meet pairwise.
SUBTREE_ROWS = 20_000
_PAIRS = list(itertools.combinations(range(BLOCKS), BLOCKS - BUDGET))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hash of every shingle of a UTF-8 text, repeats included; a shorter text is one shingle of all its words."""
    import xxhash

    toks = text.lower().split()
    joined = b" ".join(toks)
    if len(toks) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if toks else [], dtype=">u8")
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    f = xxhash.xxh64_intdigest
    return np.array([f(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=">u8")


def majority(h: np.ndarray) -> int:
    """64-bit SimHash of big-endian shingle hashes: a bit is set if over half of them set it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_bytes(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of one UTF-8 text; 0 without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for every row; null texts count as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_bytes((t.as_buffer().to_pybytes() if t.is_valid else b""), words) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _rotate(fp: np.ndarray, pair: tuple[int, ...]) -> np.ndarray:
    """The blocks of ``pair`` first, the others behind; blocks are 16 bits, block 0 the highest."""
    order = [*pair, *(b for b in range(BLOCKS) if b not in pair)]
    out = np.zeros_like(fp)
    for b in order:
        out = (out << np.uint64(16)) | ((fp >> np.uint64(48 - 16 * b)) & np.uint64(0xFFFF))
    return out


def trie_pairs(keys: np.ndarray, side: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``i < j`` of sorted distinct ``keys`` with equal top ``depth`` bits and at most ``budget`` differing bits.

    A trie node is a range of the sorted keys; a node pair is split by one more
    bit at a time, so children are found by binary search. The frontier is
    handled in bounded slices, depth first.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    roots = keys >> np.uint64(64 - depth)
    lo = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1])))
    hi = np.append(lo[1:], n)
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > 200_000:
            half = len(al) // 2
            stack += [(d, al[half:], ah[half:], bl[half:], bh[half:], err[half:]), (d, al[:half], ah[:half], bl[:half], bh[:half], err[:half])]
            continue
        if not len(al):
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():  # two leaves: the remaining bits at once
            a, b, e = al[single], bl[single], err[single]
            rest = np.uint64((1 << (64 - d)) - 1) if d < 64 else np.uint64(0)
            diff = np.bitwise_count((keys[a] ^ keys[b]) & rest)
            ok = (a < b) & (e + diff <= budget)
            out.append((a[ok], b[ok]))
            more = ~single
            al, ah, bl, bh, err = al[more], ah[more], bl[more], bh[more], err[more]
            if not len(al):
                continue
        bit = np.uint64(63 - d)
        # all keys of a node share the top d bits, so its upper child starts at (prefix, 1, 0...)
        am = np.clip(np.searchsorted(keys, ((keys[al] >> bit) | np.uint64(1)) << bit), al, ah)
        bm = np.clip(np.searchsorted(keys, ((keys[bl] >> bit) | np.uint64(1)) << bit), bl, bh)
        same = (al == bl) & (ah == bh)
        children = []
        for (xl, xh), (yl, yh), step in (((al, am), (bl, bm), 0), ((am, ah), (bm, bh), 0), ((al, am), (bm, bh), 1), ((am, ah), (bl, bm), 1)):
            ok = (xh > xl) & (yh > yl) & (err + step <= budget)
            if step == 0:
                ok &= ~((xl == yl) & (xh == yh) & (xh - xl == 1))  # a leaf with itself
            elif xl is am:
                ok &= ~same  # (upper, lower) of a node with itself mirrors (lower, upper)
            children.append((xl[ok], xh[ok], yl[ok], yh[ok], err[ok] + np.int8(step)))
        nxt = [np.concatenate(c) for c in zip(*children, strict=True)]
        if len(nxt[0]) and d + 1 <= 64:
            stack.append((d + 1, *nxt))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(u, v)`` pairs of distinct fingerprints that differ in at most ``budget`` bits, each once.

    ``fps`` has one row per distinct ``fp``. A fingerprint has at most
    C(64,1)+C(64,2) partners at two bits, so the output is linear in its input.
    """
    if budget > BUDGET:
        raise ValueError("four blocks guarantee pairs up to two bits")
    spread = fps.select("fp", F.posexplode(F.array(*[_block_key(p) for p in _PAIRS])).alias("t", "root"))
    # a root held by very many fingerprints is cut into salted parts that meet pairwise
    sizes = spread.groupBy("t", "root").count().where(F.col("count") > SUBTREE_ROWS)
    sizes = sizes.select("t", "root", F.ceil(F.col("count") / SUBTREE_ROWS).cast("int").alias("parts"))
    dealt = (
        spread.join(sizes, ["t", "root"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))))
        .select("fp", "t", "root", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for b in batches:
            for c, name in zip(cols, ("fp", "t", "own", "p", "q"), strict=True):
                c.append(b.column(name).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        fp, t, own, p, q = (np.concatenate(c) for c in cols)
        fp = fp.view(np.uint64)
        for k, pair in enumerate(_PAIRS):
            for part in np.unique(np.stack([p[t == k], q[t == k]], axis=1), axis=0) if (t == k).any() else ():
                at = (t == k) & (p == part[0]) & (q == part[1])
                f, o = fp[at], own[at]
                rot = _rotate(f, pair)
                order = np.argsort(rot)
                f, o, rot = f[order], o[order], rot[order]
                i, j = trie_pairs(rot, o, 16 * len(pair), budget)
                # each pair once: only in the salted part that both sides span, and only at the first common root
                x = f[i] ^ f[j]
                ok = (o[i] != o[j]) | (part[0] == part[1])
                for earlier in _PAIRS[:k]:
                    mask = np.uint64(sum(0xFFFF << (48 - 16 * b) for b in earlier))
                    ok &= (x & mask) != 0
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(f[i][ok].view(np.int64)), pa.array(f[j][ok].view(np.int64))], ["u", "v"])

    return dealt.repartition(n, "t", "root", "p", "q").mapInArrow(run, "u long, v long")


def _block_key(pair: tuple[int, ...]):
    key = F.lit(0).cast("long")
    for b in pair:
        key = F.shiftleft(key, 16).bitwiseOR(F.shiftrightunsigned("fp", 48 - 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long")))
    return key


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fp, component_id, n_links`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own
    included; n_links counts other distinct fingerprints within the budget.
    Null and empty texts have fingerprint 0 and link like any other. A row with
    a null id gets its group's smallest id (null if the group has none);
    repeated rows are returned as often as they come. No rows give no rows.
    Extra columns are not read.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, words), "fp")
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-nodes")
    pairs = materialize(links(nodes.select("fp"), budget), "fp-links")
    roots = connected_components(pairs)
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    tagged = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialize(tagged.join(smallest, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "fp-groups")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id", "n_links")


def hex16(fp):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

