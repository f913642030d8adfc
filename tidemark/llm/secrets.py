"""Secrets in texts, and multipart credentials linked by an interval join. DataFrame functions only.

Base findings are matches of three patterns (``BASE``), leftmost and without overlap per kind; those whose value is too
short are dropped after matching. Weak candidates (``WEAK``) mean nothing alone: a long unlabelled token or short
password field, a user or key identifier, an endpoint. Parts have a role (identifier, secret, endpoint); a weak
candidate is reported only when complementary parts start within ``SCOPE`` code points of it: an identifier or endpoint
next to a secret, a secret next to an identifier, both next to an endpoint.

The interval join puts parts into bins as wide as the scope, reduced to their first and last start per document, bin and
role, and joins each candidate to its own bin and the two next to it; so no pair within a scope is written out, and a
document full of parts costs no more than its length.

Places are code points, the end exclusive. Null text counts as empty and has no spans. Repeated rows are each answered
alike. Empty tables give empty results. Further columns are kept by :func:`masked`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import bound, running, table

SCOPE = 200
PIECE = 1024

# Pattern, group that holds the value, least length of that group.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
WEAK = {
    "weak_secret": (r"""(?:(?i:\b(?:pwd|pass|passphrase|private_?key|auth))["']?\x20*[:=]\x20*["']?|(?<![A-Za-z0-9+/_=-])"""
                    r"""(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])))([A-Za-z0-9+/_=-]{6,})""", 1, 6),
    "weak_id": (r"""(?i:\b(?:access_?key_?id|client_?id|user(?:name)?|login|account))["']?\x20*[:=]\x20*["']?"""
                r"""([A-Za-z0-9@._-]{3,})""", 1, 3),
    "endpoint": (r"""((?i:\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://)[A-Za-z0-9._~:/?#@%&=+-]+)""",
                 1, 8),
}
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id",
        "endpoint": "endpoint"}
ORDER = [*BASE, *WEAK]
SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"


def spans(text: Column, kind: str) -> Column:
    """All matches of a kind: what lies between matches and the matches themselves add up to the places."""
    pattern, group, least = (BASE | WEAK)[kind]
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)

    def placed(gaps: Column, sizes: Column) -> Column:
        steps = F.zip_with(gaps, sizes, lambda gap, size: gap + F.coalesce(size, F.lit(0)))
        rows = F.arrays_zip(running(steps, F.lit(0), lambda a, x: a + x).alias("at"), gaps.alias("gap"),
                            sizes.alias("size"), value.alias("value"))
        return F.transform(F.filter(rows, lambda x: x["value"] >= least), lambda x: F.struct(
            (x["at"] + x["gap"]).alias("start"), F.lit(ORDER.index(kind)).alias("place"), F.lit(kind).alias("kind"),
            (x["at"] + x["gap"] + x["size"]).alias("end"))).cast(SPAN)

    return F.when(text.rlike(pattern), bound(between, lambda gaps: bound(whole, lambda sizes: placed(gaps, sizes)))
                  ).otherwise(F.array().cast(SPAN))


def linked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_key``, ``_linked``: weak candidates with complementary parts in their scope. ``docs`` has _key and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weak = docs.select("_key", text.alias("text"), F.concat(*[spans(text, k) for k in WEAK]).alias("weak"))
    found = weak.where(F.size("weak") > 0).select(
        "_key", F.explode(F.concat("weak", *[spans(F.col("text"), k) for k in BASE])).alias("s"))
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    parts = found.select("_key", "s.*").withColumn("role", role[F.col("kind")]).withColumn("bin", F.floor(F.col("start") / scope))
    bins = parts.groupBy("_key", "bin", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    candidates = parts.where(F.col("kind").isin(list(WEAK))).select(
        "_key", "start", "place", "kind", "end", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin"))
    near = (F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("start") + scope)
    met = (candidates.join(bins, ["_key", "bin"]).where(near)
           .groupBy("_key", "start", "place", "kind", "end")
           .agg(*[F.bool_or(F.col("role") == r).alias(r) for r in ("id", "secret", "endpoint")]))
    whole = (F.when(F.col("kind") == "weak_secret", F.col("id") | F.col("endpoint"))
             .when(F.col("kind") == "weak_id", F.col("secret")).otherwise(F.col("id") & F.col("secret")))
    return met.where(whole).groupBy("_key").agg(F.collect_list(F.struct("start", "place", "kind", "end")).alias("_linked"))


def found(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows of ``docs`` with ``_spans``: base findings and linked weak candidates, by place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(text), F.length(text))
    keyed = docs.withColumn("_key", key)
    base = keyed.withColumn("_base", F.array_sort(F.concat(*[spans(text, k) for k in BASE])))
    links = linked(keyed.select("_key", "text"), scope)
    all_spans = F.array_sort(F.concat("_base", F.coalesce(F.col("_linked").cast(SPAN), F.array().cast(SPAN))))
    return base.join(links, "_key", "left").withColumn("_spans", all_spans).drop("_key", "_linked")


def listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by ``mask``; ``n_chars`` follows the new text."""
    # A place in a long text is found by walking to it, so pieces are taken from blocks of PIECE code points.
    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first, last = (F.floor(x / PIECE).cast("int") for x in (start, end))
        near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(near, start % PIECE + 1, end - start)).otherwise("")

    def replaced(blocks: Column) -> Column:
        ends = F.transform("_spans", lambda s: s["end"])
        before = running(ends, F.lit(0), F.greatest)
        parts = F.zip_with("_spans", before, lambda s, at: F.when(
            s["start"] >= at, F.concat(piece(blocks, at, s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.array_max(ends), F.length("text")))

    walked = bound(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), replaced)
    changed = F.size("_spans") > 0
    out = found(docs, scope).withColumn("_new", F.when(changed, walked).otherwise(F.col("text")))
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.col("_new").alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = (F.when(changed, F.length("_new")).otherwise(F.col("n_chars"))
                              .cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return out.select(*columns.values())


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    out = found(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(listed("_base"), 256).alias("base_sha256"),
                      listed("_spans").alias("spans"))
