"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document's measures are integer statistics of its whole text.  Three rates (symbols per character of words, equal lines per
line, characters per word) have thresholds that come from the documents' own language and source alone: a sketch of the group's
rates gives its quartiles, and the fences lie three quartile ranges beyond them.  No fence is a constant.  A document fails
if its count lies beyond what the fence's rate explains for its size by more than ``DEVIATIONS`` Poisson deviations, so a
short text does not fail by chance.  (Symbols and lines have an upper fence, characters per word both.)

A sketch counts documents in log-linear bins: values under ``2 * STEPS`` have a bin each, larger ones ``STEPS`` bins for each power of two, so a
quantile is off by 1/STEPS of its value at most, a sketch has at most ``STEPS * 58`` bins whatever its data, and sketches merge
by addition; results depend on no order of tasks.  A group's sketch has ``PRIOR`` documents of its language's mixed in, and the
language's as many of all documents': thresholds of small groups move smoothly to those of the larger ones, and every document is judged.
The thresholds are joined back to the documents.

Edge cases: null text has no words and fails the base rule; null language or source is a group of its own;
equal rows give equal rows; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import maybe_broadcast, stage

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rates are counted per million; each has its count and size.
PER = 1_000_000
RATES = {"b_symbols": ("n_symbols", "word_chars"), "b_lines": ("n_dup_lines", "n_lines"), "b_length": ("word_chars", "n_words")}
STEPS = 64
PRIOR = 20
DEVIATIONS = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes: sorted with their starts, equal neighbours are repeats, and the
    union of the repeats' spans is the sum of min(5, gap to the next start).  The nested transforms over
    one-element arrays bind a value once, so it is not evaluated again for each element.
    """

    def bound(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def spans(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - p, F.lit(5))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        here = F.filter(s, lambda e, i: (F.get(s, i - 1)["g"] == e["g"]) | (F.get(s, i + 1)["g"] == e["g"]))
        return bound(F.sort_array(F.transform(here, lambda e: e["i"])), spans)

    def of_grams(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bound(pairs, repeated))

    def grams(h: Column) -> Column:
        ends = F.slice(h, F.lit(5), F.size(h))
        return F.transform(ends, lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), x))

    whole = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound(grams(h), of_grams))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(whole)


def measured(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.select(*keep, text.alias("q_text")).select(
        "*",
        F.filter(F.split("q_text", SPACE + "+", -1), lambda w: w != "").alias("q_words"),
        lines.alias("q_lines"),
    )
    return parts.select(
        *[c for c in parts.columns if not c.startswith("q_")],
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.translate("q_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.size("q_lines").cast("long").alias("n_lines"),
        repeat_words(F.col("q_words")).alias("n_repeat_words"),
    )


def rate_bin(top: Column, bottom: Column) -> Column:
    """Lower end of the sketch's bin of ``top / bottom`` per million."""
    rate = F.when(bottom > 0, F.floor(top * PER / F.greatest(bottom, F.lit(1)))).otherwise(0).cast("long")
    return F.transform(F.array(rate), lambda v: F.call_function("shiftleft", F.call_function("shiftright", v, _drop(v)), _drop(v)))[0]


def _drop(v: Column) -> Column:
    """Low bits of ``v`` that its bin leaves out."""
    return F.greatest(F.length(F.bin(v)) - F.lit((2 * STEPS - 1).bit_length()), F.lit(0))


def fences(binned: DataFrame) -> DataFrame:
    """``f_lang, f_source`` and a low and a high fence of each rate, one row per group of ``binned(k_lang, k_source, b_...)``."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    stacked = ", ".join(f"'{m}', {m}" for m in RATES)
    own = binned.select("k_lang", "k_source", F.expr(f"stack({len(RATES)}, {stacked}) as (measure, bin)")).groupBy("k_lang", "k_source", "measure", "bin").agg(F.count(F.lit(1)).alias("c"))
    own = stage(own, "quality-sketch")  # bounded for each group; all that follows reads it only
    of_lang = own.groupBy("k_lang", "measure", "bin").agg(F.sum("c").alias("c"))
    of_all = own.groupBy("measure", "bin").agg(F.sum("c").alias("c_all"))
    groups = own.groupBy("k_lang", "k_source", "measure").agg(F.sum("c").alias("n"))
    langs = of_lang.groupBy("k_lang", "measure").agg(F.sum("c").alias("n_lang"))
    n_all = of_all.groupBy("measure").agg(F.sum("c_all").alias("n_all"))
    langs = langs.join(n_all, "measure")
    # a language's sketch in units of 1 / n_all documents: its own documents and PRIOR of all
    lang = langs.join(of_all, "measure").select("k_lang", "measure", "bin", (big("c_all") * PRIOR).alias("w"))
    lang = lang.union(of_lang.join(langs, ["k_lang", "measure"]).select("k_lang", "measure", "bin", (big("c") * big("n_all")).alias("w")))
    lang = lang.groupBy("k_lang", "measure", "bin").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    # a group's in units of 1 / (n_all * (n_lang + PRIOR)): its own documents and PRIOR of its language's sketch
    group = groups.join(lang, ["k_lang", "measure"]).select("k_lang", "k_source", "measure", "bin", (big("w") * PRIOR).alias("w"))
    scale = big("n_all") * (big("n_lang") + PRIOR)
    group = group.union(own.join(langs, ["k_lang", "measure"]).select("k_lang", "k_source", "measure", "bin", (big("c") * scale).alias("w")))
    group = group.groupBy("k_lang", "k_source", "measure", "bin").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    whole = Window.partitionBy("k_lang", "k_source", "measure")
    ranks = group.withColumn("total", F.sum("w").over(whole)).withColumn("upto", F.sum("w").over(whole.orderBy("bin")))
    quantile = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin")))
    q = ranks.groupBy("k_lang", "k_source", "measure").agg(quantile(25).alias("q25"), quantile(75).alias("q75"))
    spread = (F.col("q75") - F.col("q25")) * 3
    q = q.select("k_lang", "k_source", "measure", F.greatest(F.col("q25") - spread, F.lit(0)).alias("low"), (F.col("q75") + spread).alias("high"))
    edges = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{e}_{m}") for m in RATES for e in ("low", "high")]
    return q.groupBy(F.col("k_lang").alias("f_lang"), F.col("k_source").alias("f_source")).agg(*edges)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` per document."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit(""))  # noqa: E731  null is a group of its own
    keep = [docs[id_col].alias("k_id"), named(lang_col).alias("k_lang"), named(source_col).alias("k_source")]
    rows = measured(docs, text_col, keep)
    binned = stage(rows.select("*", *[rate_bin(F.col(top), F.col(bottom)).alias(m) for m, (top, bottom) in RATES.items()]), "quality-measures")
    edges = stage(fences(binned), "quality-fences")
    joined = binned.join(maybe_broadcast(edges), (F.col("k_lang") == F.col("f_lang")) & (F.col("k_source") == F.col("f_source")), "left")
    out = F.lit(False)
    for m, (top, bottom) in RATES.items():
        high, low = (F.col(f"{e}_{m}") * F.col(bottom) / F.lit(float(PER)) for e in ("high", "low"))
        out = out | (F.col(top) > high + DEVIATIONS * F.sqrt(high + 1))
        if m == "b_length":
            out = out | (F.col(top) < low - DEVIATIONS * F.sqrt(low + 1))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return joined.select(F.col("k_id").alias(id_col), *MEASURES, base.alias("base_failed"), (~base & ~out).alias("kept"))
