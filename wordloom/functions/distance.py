"""Edit distances over UTF-8 bytes, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("levenshtein", "damerau")


def byte_text(word: Column) -> Column:
    """One character for each UTF-8 byte, so that character functions work on bytes."""
    return F.decode(F.encode(word, "utf-8"), "iso-8859-1")


def letters(word_bytes: Column) -> Column:
    """A bit for each byte value modulo 64 that a byte text holds.

    An edit takes at most one bit away and adds at most one, and a swap none: texts within d edits lack at most d of each other's bits.
    """
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substring(word_bytes, i, 1)) % 64)
    every = F.aggregate(F.sequence(F.lit(1), F.length(word_bytes)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))
    return F.when(F.length(word_bytes) > 0, every).otherwise(F.lit(0).cast("long"))


def neighbours(word_bytes: Column) -> Column:
    """A bit for each hash modulo 64 of two neighbouring bytes.  An edit takes at most two away and adds at most two, a swap three."""
    code = lambda i: F.ascii(F.substring(word_bytes, i, 1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (code(i) * 31 + code(i + 1) * 7) % 64)
    every = F.aggregate(F.sequence(F.lit(1), F.length(word_bytes) - 1), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))
    return F.when(F.length(word_bytes) > 1, every).otherwise(F.lit(0).cast("long"))


def bits_within(a: Column, b: Column, most: int) -> Column:
    """Do two sets of bits lack at most ``most`` of each other's?"""
    return (F.bit_count(a.bitwiseAND(F.bitwise_not(b))) <= most) & (F.bit_count(b.bitwiseAND(F.bitwise_not(a))) <= most)


def byte_length(word: Column) -> Column:
    return F.octet_length(word)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(byte_text(a), byte_text(b)).cast("bigint")


def levenshtein_within(a_bytes: Column, b_bytes: Column, d: int) -> Column:
    """Distance of byte texts if at most ``d``, else null."""
    found = F.levenshtein(a_bytes, b_bytes, d)
    return F.when(found >= 0, found).cast("bigint")


def osa_bytes(a: Column, b: Column) -> Column:
    """Restricted Damerau distance (optimal string alignment) of byte texts."""
    far = 1 << 20

    def row(acc: Column, i: Column) -> Column:
        def cell(r: Column, j: Column) -> Column:
            here, there = F.substring(a, i, 1), F.substring(b, j, 1)
            swap = (i > 1) & (j > 1) & (here == F.substring(b, j - 1, 1)) & (F.substring(a, i - 1, 1) == there)
            return F.array_append(
                r,
                F.least(
                    F.get(r, j - 1) + 1,
                    F.get(acc["one"], j) + 1,
                    F.get(acc["one"], j - 1) + (here != there).cast("int"),
                    F.when(swap, F.get(acc["two"], j - 2) + 1).otherwise(F.lit(far)),
                ),
            )

        new = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)
        return F.struct(acc["one"].alias("two"), new.alias("one"))

    start = F.sequence(F.lit(0), F.length(b))
    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(start.alias("two"), start.alias("one")), row, lambda acc: F.get(acc["one"], F.length(b)))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(table).cast("bigint")


def may_swap(a: Column, b: Column) -> Column:
    """Does ``b`` hold two different neighbours of ``a`` the other way round?  If not, the restricted Damerau distance is Levenshtein's."""
    return F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: (F.substring(a, i, 1) != F.substring(a, i + 1, 1)) & (F.length(a) > i) & b.contains(F.concat(F.substring(a, i + 1, 1), F.substring(a, i, 1))),
    )


def osa(a: Column, b: Column) -> Column:
    return osa_bytes(byte_text(a), byte_text(b))


#: Bytes of a text whose deletion variants are made.
PREFIX = 7


def deletions(word_bytes: Column, d: int, prefix: int | None = PREFIX) -> Column:
    """All texts that at most ``d`` deletions make of the first ``prefix`` bytes of a byte text (None: of all), themselves included.

    Texts within d edits share one: an edit within both prefixes, or one that moves a byte over a prefix's end, costs either side one deletion.
    """

    def once(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array(w))

    every = F.array(word_bytes if prefix is None else F.substring(word_bytes, 1, prefix))
    for _ in range(d):
        every = F.array_distinct(F.concat(every, F.flatten(F.transform(every, once))))
    return every


def segments(word_bytes: Column, parts: int) -> Column:
    """``(part, text)`` of the ``parts`` even pieces of a byte text that has as many bytes at least."""
    n = F.length(word_bytes)
    at = lambda k: F.floor(n * k / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(k.alias("part"), F.substring(word_bytes, at(k) + 1, at(k + 1) - at(k)).alias("text")))


def probes(word_bytes: Column, n: Column, parts: int, shift: int) -> Column:
    """``(part, text)`` of all substrings that can be a piece of a text of ``n`` bytes moved by at most ``shift``."""
    at = lambda k: F.floor(n * k / parts).cast("int")
    moved = lambda k, j: F.struct(k.alias("part"), F.substring(word_bytes, at(k) + 1 + j, at(k + 1) - at(k)).alias("text"), (at(k) + j).alias("begin"), (at(k + 1) + j).alias("end"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.transform(F.sequence(F.lit(-shift), F.lit(shift)), lambda j: moved(k, j))))
    inside = F.filter(every, lambda x: (x["begin"] >= 0) & (x["end"] <= F.length(word_bytes)))
    return F.array_distinct(F.transform(inside, lambda x: F.struct(x["part"].alias("part"), x["text"].alias("text"))))


def without_middle_byte(word: Column) -> Column:
    """``word`` (ASCII) without its middle byte: a misspelling generator."""
    half = F.floor(byte_length(word) / 2).cast("int")
    return F.concat(F.substring(word, F.lit(1), half), F.substring(word, half + 2, F.length(word)))


def misspellings(words: DataFrame, column: str = "word", every: int = 1) -> DataFrame:
    """``query``: different words of 3 to 20 ASCII bytes without their middle byte; of these words, in byte order, each ``every``-th."""
    fit = words.select(F.col(column).alias("word")).where((F.octet_length("word") == F.length("word")) & F.octet_length("word").between(3, 20)).distinct()
    if every > 1:
        # numbers are a range's rows before it and the place in the range, so no task holds all words
        placed = fit.repartitionByRange("word").sortWithinPartitions("word").select("word", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        per = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
        before = per.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
        fit = placed.join(before, "range").where((F.col("before") + F.col("place")) % every == 0)
    return fit.select(without_middle_byte(F.col("word")).alias("query")).distinct()
