"""Secret scans with multipart credential linking (DataFrame operations only).

Base kinds (assign, access, hex) are reported wherever they stand. Weak
candidates (key-like tokens, endpoints, account names) are reported only when
complementary parts stand in the same scope. That is a semi-join of intervals
within a document: ``[start - SCOPE, end + SCOPE]`` of a part meets
``[start, end]`` of another, or at most ``SCOPE`` characters lie between them. In
the order of starts a complement met before a part is the one that ends last,
and one met behind it is the one that starts first; so two running values decide
every part, whatever its length, and no pairs are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key

#: Kinds in their order, with their patterns.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "secret": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?:https?|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""",
    "account": r"""(?i:username|user|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""",
}
BASE = ["assign", "access", "hex"]
#: Code points on either side within which parts belong together.
SCOPE = 256
#: The same matches for these kinds: a run is tried at its first character only.
AT_RUNS = {"hex": "(?<![0-9a-f])" + PATTERNS["hex"], "secret": "(?<![A-Za-z0-9+/_-])" + PATTERNS["secret"]}
#: Without one of these substrings (of the lower-cased text; access: as it is) no match is possible.
NEEDLES = {
    "assign": ["passw", "secret", "token", "apikey", "api_key"],
    "access": ["AKIA"],
    "endpoint": ["://"],
    "account": ["user", "login", "clientid", "client_id", "key"],
}


def _holds(kind: str, match: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "assign":
        return F.length(value) >= 8
    if kind == "access":
        return F.length(match) >= 16
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _measure(kind: str):
    return lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), _holds(kind, x["match"], x["value"]).alias("ok"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _text, kind, k, start, end`` of all parts, base and weak, in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_text"), text.alias("text"))
    d = d.withColumn("low", F.lower("text"))

    def matches(kind: str) -> Column:
        all_of = F.regexp_extract_all("text", F.lit(AT_RUNS.get(kind, PATTERNS[kind])), F.lit(0))
        if kind not in NEEDLES:
            return all_of
        possible = [F.contains(F.col("text" if kind == "access" else "low"), F.lit(x)) for x in NEEDLES[kind]]
        return F.when(reduce(Column.__or__, possible), all_of).otherwise(F.array().cast("array<string>"))

    d = d.select("doc_id", "_text", "text", *[matches(k).alias(k) for k in PATTERNS])
    d = d.withColumn("secret", F.when(F.exists("secret", lambda m: _holds("secret", m, m)), F.col("secret")).otherwise(F.array().cast("array<string>")))
    d = d.where(sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0)
    each = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        value = F.regexp_extract_all("text", F.lit(p), F.lit(1)) if kind == "assign" else F.col(kind)
        rows = F.arrays_zip(F.split("text", AT_RUNS.get(kind, p), -1).alias("gap"), F.col(kind).alias("match"), value.alias("value"))
        rows = F.transform(rows, _measure(kind))
        each.append(F.when(F.size(kind) > 0, F.struct(F.lit(n).alias("k"), F.slice(rows, F.lit(1), F.size(kind)).alias("rows"))))
    d = d.select("doc_id", "_text", F.explode(F.array_compact(F.array(*each))).alias("kind")).select("doc_id", "_text", "kind.k", F.posexplode("kind.rows").alias("at", "m"))
    # repeated rows have the same parts: one of each is enough
    d = d.groupBy("doc_id", "_text", "k", "at").agg(F.first("m").alias("m"))
    before = Window.partitionBy("doc_id", "_text", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("long")).where("m.ok")
    kinds = F.array(*[F.lit(k) for k in PATTERNS])
    return d.select("doc_id", "_text", kinds[F.col("k")].alias("kind"), "k", (F.col("end") - F.col("m.size")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """Parts with ``report``: base parts always, weak ones only with their complement in scope.

    A key-like token that overlaps a base part or an endpoint is that part and no
    further evidence. A token needs an access identifier, account or endpoint; an
    account needs a secret; an endpoint needs both.
    """
    doc = Window.partitionBy("doc_id", "_text")
    # ordered by start alone, both range frames include all parts that start here; both begin unbounded, so each is one running value
    so_far, ahead = (doc.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))

    def meets(which: Column, scope: int) -> Column:
        """Whether a part of ``which`` lies within ``scope`` characters (0: shares one)."""
        reach = scope + 1 if scope else 0
        before = F.max(F.when(which, F.col("end"))).over(so_far) > F.col("start") - reach
        behind = F.min(F.when(which, F.col("start"))).over(ahead) < F.col("end") + reach
        return F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))

    covered = meets(F.col("kind").isin(*BASE, "endpoint"), 0)
    d = found.withColumn("covered", (F.col("kind") == "secret") & covered).where(~F.col("covered"))
    near = lambda *kinds: meets(F.col("kind").isin(*kinds), SCOPE)
    d = d.withColumns({"near_id": near("access", "account"), "near_secret": near("assign", "hex", "secret"), "near_end": near("endpoint")})
    weak = (
        F.when(F.col("kind") == "secret", F.col("near_id") | F.col("near_end"))
        .when(F.col("kind") == "endpoint", F.col("near_id") & F.col("near_secret"))
        .when(F.col("kind") == "account", F.col("near_secret"))
    )
    return d.withColumn("report", F.col("kind").isin(*BASE) | F.coalesce(weak, F.lit(False))).drop("covered")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secret digest of every row: counts of base kinds, digest of base spans, all reported spans.

    Null texts are empty: no parts. Rows are matched by id and text digest, so
    null and repeated ids keep their own result; repeated rows are returned as
    often as they come. Very long texts and tokens are searched whole. Spans that start together are in the order of their
    kinds. No rows give no rows; extra columns are not read.
    """
    spans = linked(parts(docs, id_col, text_col)).where("report")
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    found = spans.groupBy("doc_id", "_text").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.struct("start", "k", span.alias("s")))).alias("all"),
    )
    found = found.select(F.col("doc_id").alias("_id2"), F.col("_text").alias("_text2"), *[f"n_{k}" for k in BASE], "all")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_text"))
    j = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["s"]))
    base = F.filter("all", lambda x: x["k"] < len(BASE))
    return j.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(listed(base), F.lit("")), 256).alias("base_sha256"), F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
    )
