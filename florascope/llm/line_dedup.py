"""Site-relative line deduplication (DataFrame operations only).

A line is boilerplate on a host if the share of the host's pages that contain
it exceeds ``ratio``. Only 128-bit line digests are counted, a page counts a
line once, and counts are summed on the map side first, so a line on a third of
all pages is one row per task in the shuffle.

Lines are then dropped where the texts lie: a host's boilerplate is one array of
digests, at most ``1 / ratio`` times the lines of an average page of it however
many pages it has. The hosts' arrays are broadcast while their counted total is
small; beyond it line digests (and no texts) are joined, and a text moves once,
with the numbers of its dropped lines.

With ``by_text`` whole copies of a text on a host are one page, in the line's
count and in the host's, or a group of copies would lose its own text. A line's
texts are then made distinct by their digests before they are counted, in a
shuffle that spreads a common line over its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key

RATIO = 0.02
#: A line on a single page is no repeat, however few pages its host has.
MIN_PAGES = 2
#: Characters that make up blank lines.
BLANK = " \t\r\n\x0b\x0c"
#: Boilerplate lines of all hosts that are broadcast at most.
BROADCAST_LINES = 500_000


def _digest(host: Column, line: Column) -> Column:
    return F.xxhash64(host, line)


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) == ""


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, by_text: bool = False) -> DataFrame:
    """``host, h`` digests of the lines whose page share on their host exceeds ``ratio``."""
    host = F.col(host_col)
    lines = docs.select(host.alias("host"), text_key(F.col(text_col)).alias("t"), F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("line")).where(~_is_blank(F.col("line")))
    lines = lines.select("host", _digest(F.col("host"), F.col("line")).alias("h"), F.xxhash64(F.lit("line"), "line", "host").alias("h2"), *(["t"] if by_text else []))
    counts = (lines.distinct() if by_text else lines).groupBy("host", "h", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sites = docs.select(host.alias("site"), *([text_key(F.col(text_col)).alias("t")] if by_text else []))
    pages = (sites.distinct() if by_text else sites).groupBy("site").agg(F.count("*").alias("pages"))
    return counts.join(pages, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.col("pages") * F.lit(ratio)).select("host", "h")


def _drop_in_place(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``gone``, the digests of a row's lines that are dropped; the hosts' arrays come to the texts."""
    of_host = found.groupBy("host").agg(F.collect_set("h").alias("bad")).select(F.col("host").alias("host2"), "bad")
    joined = rows.join(F.broadcast(of_host), F.col("host").eqNullSafe(F.col("host2")), "left")
    return joined.withColumn("gone", F.when(F.col("bad").isNull(), F.array().cast("array<long>")).otherwise(F.array_intersect("keys", "bad"))).drop("host2", "bad")


def _drop_by_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """As ``_drop_in_place``; only digests are joined with the boilerplate, then each text meets its own."""
    named = rows.select("id", "key", "host", F.explode("keys").alias("h")).join(found.select(F.col("host").alias("host2"), "h"), "h").where(F.col("host").eqNullSafe(F.col("host2")))
    gone = named.groupBy("id", "key", "host").agg(F.collect_set("h").alias("gone")).select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("host").alias("host2"), "gone")
    own = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")) & F.col("host").eqNullSafe(F.col("host2"))
    return rows.join(gone, own, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>"))).drop("id2", "key2", "host2")


def dedup_lines(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, by_text: bool = False, counts: bool = True
) -> DataFrame:
    """``docs`` without boilerplate lines; with ``counts``, ``n_lines`` and ``n_dropped`` are added.

    Lines end at a line feed. Lines of nothing but blanks and control blanks
    (a lone carriage return too) are never dropped or counted as boilerplate. A
    null text stays null with zero lines; a text whose lines all go becomes
    empty; an empty text is one blank line. Very long texts are handled whole. A
    null host is a host of its own; repeated rows are pages of their own, unless
    ``by_text`` takes the rows of one text on a host as one. No rows give no
    rows. Other columns, whatever their names, pass through unchanged; only with
    ``counts`` a column named ``n_lines`` or ``n_dropped`` gives way.
    """
    found = materialize(boilerplate_lines(docs, host_col, text_col, ratio, min_pages, by_text), "boilerplate")
    # the row as one struct: its columns cannot clash with the operator's own
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row") if len(docs.columns) > 1 else F.lit(None).alias("row"),
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(host_col).alias("host"), F.split(F.col(text_col), "\n").alias("lines"),
    )
    rows = rows.withColumn("keys", F.transform("lines", lambda x: F.when(~_is_blank(x), _digest(F.col("host"), x))))
    rows = (_drop_in_place if found.count() <= BROADCAST_LINES else _drop_by_join)(rows, found)
    bad = lambda i: F.array_contains("gone", F.element_at("keys", i + 1))
    stays = F.filter("lines", lambda x, i: ~F.coalesce(bad(i), F.lit(False)))
    text = F.when(F.col("lines").isNotNull(), F.concat_ws("\n", F.when(F.size("gone") > 0, stays).otherwise(F.col("lines"))))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    n_dropped = F.when(F.size("gone") > 0, F.size(F.filter("keys", lambda k: F.coalesce(F.array_contains("gone", k), F.lit(False))))).otherwise(0)
    rows = rows.select("row", F.struct(text.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped")).alias("done"))
    added = ["n_lines", "n_dropped"] if counts else []
    columns = [F.col("done.text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return rows.select(*columns, *[F.col(f"done.{c}") for c in added])
