"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a shuffled order (by md5 of the id), served again from the
front up to ``max_repeats`` times.  A copy's virtual finish time is the cumulative words of its source
up to and including it, divided by the source's weight.  All copies are sorted by finish time (ties by source and copy) and the
order is truncated at the total budget: a copy is taken if the words up to and including it fit, and the copy in service where the
budget ends gives the rest of it.  So each source's taken words are its target but for a document or so.

The truncation needs no task that sees the whole order.  The finish time at which the budget is used up is found by sums
over ``BINS`` ranges of finish times, each time within the range that holds it, until the range is one value; at that value stands at
most one copy with words for each source and turn, and these few rows share what is left.  Targets follow from the table of sources.

Scale: a source may hold any share of the rows.  Its queue is dealt into buckets of about
``rows_per_bucket`` rows by ranges of the shuffle key; running sums are taken within buckets and over the
small table of bucket sums, so no task sees a whole source.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, ordered last;
null ids are shuffled by their text, and rows of one key are ordered by size; equal rows are interchangeable; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import maybe_broadcast, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget_ratio: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``m_source, source_size, n_rows, weight, cut, target`` per source of ``sized(m_source, m_size)``.

    One row per source goes through the windows, after a map-side aggregate.
    """
    per = sized.groupBy("m_source").agg(F.sum("m_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = F.col("m_source").asc_nulls_last()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("full_at").asc(), order)
    ranked = (
        per.withColumn("place", F.row_number().over(Window.orderBy(order)))
        .withColumn("weight", F.get(wheel, (F.col("place") - 1) % len(weights)))
        .withColumn("most", F.col("source_size").cast("double") * float(max_repeats))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole).cast("double") * float(budget_ratio))
        .withColumn("used", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("pull", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("used")) / F.col("pull"))
        .withColumn("cut", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("cut").isNull(), F.col("most")).otherwise(F.least("most", F.col("cut") * F.col("weight")))
    return ranked.select("m_source", "source_size", "n_rows", "weight", "cut", target.alias("target"))


def finish_at_budget(copies: DataFrame, budget: int) -> float | None:
    """The least ``finish`` up to which the ``m_size`` of ``copies`` sum to ``budget`` or more; None if all sum to less."""
    lo, hi, total = copies.agg(F.min("finish"), F.max("finish"), F.sum("m_size")).first()
    if total is None or total < budget:
        return None
    before = 0  # words of finish times below the range
    while lo < hi:
        step = (hi - lo) / BINS
        # where the range is a few neighbouring numbers, each is a bin of its own
        spot = F.col("finish") if lo + step == lo else F.least(F.floor((F.col("finish") - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1)).cast("double")
        sums = copies.where(F.col("finish").between(lo, hi)).groupBy(spot.alias("b")).agg(F.sum("m_size").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi"))
        for row in sorted(sums.collect(), key=lambda r: r["lo"]):  # BINS rows at most
            if before + row["n"] >= budget:
                lo, hi = row["lo"], row["hi"]
                break
            before += row["n"]
    return lo


def weighted_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
    rows_per_bucket: int = 4096,
    carry: bool = False,
) -> DataFrame:
    """One row per document in mix order: ``doc_id, size, source_size, target, taken, finish, copies``.

    ``taken`` counts words over all copies, ``copies`` is the nearest whole number of copies, ``finish`` is that of the first copy.
    With ``carry`` the whole input row comes along as the struct ``row`` (names in it cannot clash with ours).
    """
    ident = docs[id_col]
    sized = docs.select(
        ident.alias("m_id"),
        docs[source_col].alias("m_source"),
        word_count(docs[text_col]).alias("m_size"),
        F.md5(F.coalesce(ident.cast("string"), docs[text_col], F.lit("")).cast("binary")).alias("m_key"),
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []),
    )
    if not carry:
        sized = stage(sized, "mix-sizes")
    targets = stage(source_targets(sized, weights, budget_ratio, max_repeats), "mix-targets")
    budget = int((targets.agg(F.sum("source_size")).first()[0] or 0) * budget_ratio)
    targets = targets.withColumn("n_buckets", F.ceil(F.col("n_rows") / F.lit(rows_per_bucket)))
    known = targets.withColumnRenamed("m_source", "t_source")
    part = F.conv(F.substring("m_key", 1, 8), 16, 10).cast("long")
    rows = sized.join(maybe_broadcast(known), F.col("m_source").eqNullSafe(F.col("t_source"))).withColumn(
        "bucket", F.floor(part * F.col("n_buckets") / F.lit(float(1 << 32))).cast("long")
    )
    heads = rows.groupBy("m_source", "bucket").agg(F.sum("m_size").alias("words"))
    ahead = Window.partitionBy("m_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = stage(
        heads.select(F.col("m_source").alias("h_source"), F.col("bucket").alias("h_bucket"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before")),
        "mix-buckets",
    )
    queue = Window.partitionBy("m_source", "bucket").orderBy("m_key", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("upto", F.sum("m_size").over(queue)).join(
        maybe_broadcast(heads), F.col("m_source").eqNullSafe(F.col("h_source")) & (F.col("bucket") == F.col("h_bucket"))
    )
    queued = queued.select("m_id", "m_source", "m_size", "source_size", "target", "weight", (F.col("before") + F.col("upto")).alias("end"), *(["row"] if carry else []))
    queued = stage(queued, "mix-queue")
    finish = lambda turn: (F.col("source_size") * turn + F.col("end")).cast("double") / F.col("weight")
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), finish(k).alias("finish")) for k in range(max_repeats)]))
    copies = queued.select("m_source", "m_size", turns.alias("c")).select("m_source", "m_size", "c.turn", "c.finish").where("m_size > 0")
    last = finish_at_budget(copies, budget)
    if last is None:  # the budget is never used up, or there are no words
        last, left = float("inf"), 0
    else:
        left = budget - (copies.where(F.col("finish") < last).agg(F.sum("m_size")).first()[0] or 0)
    # the copies that end where the budget does, one for each source and turn at most, share what is left in order
    order = Window.orderBy(F.col("m_source").asc_nulls_last(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    ends = copies.where(F.col("finish") == last).withColumn("ahead", F.coalesce(F.sum("m_size").over(order), F.lit(0)))
    give = F.greatest(F.lit(0).cast("long"), F.least(F.lit(left).cast("long") - F.col("ahead"), F.col("m_size")))
    ends = stage(ends.groupBy(F.col("m_source").alias("e_source")).agg(F.map_from_entries(F.collect_list(F.struct("turn", give.alias("give")))).alias("gives")), "mix-ends")
    rest = lambda k: F.coalesce(F.element_at("gives", F.lit(k)), F.lit(0).cast("long"))
    taken = [F.when(finish(k) < last, F.col("m_size")).when((finish(k) == last) & (F.col("m_size") > 0), rest(k)).otherwise(F.lit(0).cast("long")) for k in range(max_repeats)]
    whole = queued.join(maybe_broadcast(ends), F.col("m_source").eqNullSafe(F.col("e_source")), "left").withColumn("taken", sum(taken[1:], taken[0]))
    out = whole.select(
        F.col("m_id").alias(id_col),
        F.col("m_size").alias("size"),
        "source_size",
        "target",
        "taken",
        finish(0).alias("finish"),
        # a document without words comes as often as its place in the order does
        F.when(F.col("m_size") == 0, (finish(0) <= last).cast("long"))
        .otherwise(F.floor(F.col("taken") / F.greatest(F.col("m_size"), F.lit(1)) + F.lit(0.5)))
        .cast("long")
        .alias("copies"),
        *(["row"] if carry else []),
    )
    return out.orderBy("finish", id_col)


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as its nearest whole number of copies."""
    mixed = weighted_mix(docs, carry=True, **params).where(F.col("copies") > 0)
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
