"""Secret scans with multipart credential linking (DataFrame functions only).

Base kinds are reported wherever they stand.  Two weak kinds are candidates only: ``weak``, a run of 32 or more
characters ``[A-Za-z0-9+/_-]`` with a digit and a letter that overlaps no base span, and ``endpoint``, an http(s)
address.  Access identifiers, secrets and endpoints are joined by interval within a scope of ``scope`` code points
in one document: a weak secret is reported if an access identifier or an endpoint lies that near, an endpoint
if a base secret or an access identifier does.  A weak run within an address (a long path) is no complement of addresses: it is
reported only if an access identifier lies near.

The interval join runs on exploded parts, keyed by document and cell (start div scope, and its neighbours), and only
for documents that hold both a candidate and a partner, equal rows once.  A cell holds a bounded number of parts, as parts of
a kind do not overlap, so no document is large enough to skew it.  Spans are summed up in blocks of ``BLOCK`` matches, so the cost
of a text grows with its length and not with the square of its matches.

Edge cases: null text is empty; equal rows share one key and one linking result; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Fixed patterns of the contract.  The minimum lengths of access and hex stand in the quantifiers.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "weak", "endpoint")
SPAN = "array<struct<s:int,k:int,e:int>>"


#: Matches whose spans are gathered at once.
BLOCK = 128


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans ``(s, k, e)`` of all leftmost matches: the text between matches comes from ``split``, so each
    start is a running sum of lengths.  ``keep`` tests the match (or ``group`` of it)."""
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("g"),
    )
    sizes = F.transform(
        F.filter(pieces, lambda z: z["m"].isNotNull()),
        lambda z: F.struct(F.length(z["g"]).alias("g"), F.length(z["m"]).alias("m"), (keep(z["v"]) if keep else F.lit(True)).alias("ok")),
    )
    span = lambda p, z: F.struct((p + z["g"]).alias("s"), F.lit(kind).alias("k"), (p + z["g"] + z["m"]).alias("e"))

    def block(part: Column) -> Column:
        """Length and spans of some matches, from their own begin on."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("p"), F.array().cast(SPAN).alias("a")),
            lambda acc, z: F.struct(
                (acc["p"] + z["g"] + z["m"]).alias("p"), F.when(z["ok"], F.array_append(acc["a"], span(acc["p"], z))).otherwise(acc["a"]).cast(SPAN).alias("a")
            ),
        )

    def walk(every: Column) -> Column:
        begins = F.sequence(F.lit(1), F.size(every), F.lit(BLOCK))
        moved = lambda a, p: F.transform(a, lambda x: F.struct((x["s"] + p).alias("s"), x["k"].alias("k"), (x["e"] + p).alias("e")))
        return F.aggregate(
            F.transform(begins, lambda at: block(F.slice(every, at, F.lit(BLOCK)))),
            F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{SPAN}>").alias("a")),
            lambda acc, z: F.struct((acc["p"] + z["p"]).alias("p"), F.array_append(acc["a"], moved(z["a"], acc["p"])).cast(f"array<{SPAN}>").alias("a")),
            lambda acc: F.flatten(acc["a"]),
        )

    return F.when(text.rlike(pattern), bound(sizes, walk)).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``all_spans`` (sorted arrays of ``(s, k, e)``, code points, end exclusive).

    With ``carry``, the whole input row comes along as the struct ``row``.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.lit("|"), text).cast("binary"))
    rows = docs.select(
        docs[id_col].alias("s_id"), key.alias("s_key"), text.alias("s_text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else [])
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "s_text"],
        F.sort_array(
            F.concat(
                found(F.col("s_text"), ASSIGN, 0, lambda v: F.length(v) >= 6, 2),
                found(F.col("s_text"), ACCESS, 1),
                found(F.col("s_text"), HEX, 2),
            )
        ).alias("base"),
        found(F.col("s_text"), WEAK, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")).alias("runs"),
        found(F.col("s_text"), ENDPOINT, 4).alias("ends"),
    )
    clear = F.filter("runs", lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    rows = stage(rows.withColumn("weak", clear).drop("runs"), "secret-parts")
    both = ((F.size("weak") > 0) & ((F.size("ends") > 0) | F.exists("base", lambda b: b["k"] == 1))) | ((F.size("ends") > 0) & (F.size("base") > 0))
    linked = rows.where(both).select("s_key", "ends", F.concat("base", "weak", "ends").alias("parts")).dropDuplicates(["s_key"])
    overlaps = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    inner = lambda p: (p["k"] == 3) & F.exists("ends", lambda y: overlaps(p, y))
    parts = linked.select("s_key", F.explode(F.transform("parts", lambda p: F.struct(p.alias("p"), inner(p).alias("inner")))).alias("x")).select("s_key", "x.p", "x.inner")
    cell = F.floor(F.col("p.s") / scope)
    left = parts.where(F.col("p.k") >= 3).select("s_key", "inner", F.col("p").alias("c"), F.explode(F.sequence(cell - 1, F.floor((F.col("p.e") - 1) / scope) + 1)).alias("cell"))
    right = parts.where(F.col("p.k") != 3).select("s_key", F.col("p").alias("q"), F.explode(F.sequence(cell, F.floor((F.col("p.e") - 1) / scope))).alias("cell"))
    near = (F.col("q.s") - F.col("c.e") <= scope) & (F.col("c.s") - F.col("q.e") <= scope)
    fits = ((F.col("c.k") == 3) & ((F.col("q.k") == 1) | (F.col("q.k") == 4) & ~F.col("inner"))) | ((F.col("c.k") == 4) & F.col("q.k").isin(0, 1, 2))
    hits = left.join(right, ["s_key", "cell"]).where(near & fits).groupBy("s_key").agg(F.collect_set("c").alias("more"))
    out = rows.join(hits, "s_key", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.col("more").cast(SPAN))))
    return out.select(F.col("s_id").alias(id_col), "base", every.alias("all_spans"), *(["row"] if carry else []))


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]", **params) -> DataFrame:
    """All documents; every reported span is replaced by ``mark`` (overlapping spans by one)."""
    scanned = scan_secrets(docs, text_col=text_col, carry=True, **params)
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    cut = F.aggregate(
        "all_spans",
        F.struct(F.lit(0).alias("p"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] < a["p"], F.struct(F.greatest(a["p"], x["e"]).alias("p"), a["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("p"), F.concat(a["out"], F.substring(text, a["p"] + 1, x["s"] - a["p"]), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["p"] + 1, F.length(text))),
    )
    new = F.when(F.size("all_spans") == 0, F.col(f"row.{text_col}")).otherwise(cut)
    with_text = scanned.select("row", new.alias("t"))
    chars = {c: t for c, t in docs.dtypes}.get(chars_col)
    return with_text.select(
        *[
            F.col("t").alias(c)
            if c == text_col
            else F.when(F.col("t").eqNullSafe(F.col(f"row.{text_col}")), F.col(f"row.{c}")).otherwise(F.length("t")).cast(chars).alias(c)
            if c == chars_col
            else F.col(f"row.{c}").alias(c)
            for c in docs.columns
        ]
    )
