"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs, tokens being runs of letters and digits or runs of other
signs, in ``BUCKETS`` buckets) are fitted: the target model on documents labelled as good, the raw model on the whole corpus; the
target model is smoothed towards the raw one, so n-grams that the sample lacks weigh little.  A document's log importance weight
is the sum over its n-grams of log(target / raw), neither scaled nor clipped.  Documents are drawn without replacement, each
time with probability in proportion to their weights: Gumbel noise at ``temperature`` 1 is added to the log weights and the
largest ``k`` sums are kept.  The noise is a function of the document, so reruns agree.

``k`` is the number of documents of the whole corpus whose log weight lies above the cut that best separates held-out labels
of good and bad documents (mean of both recalls, a false rejection counting ``caution`` times); a third of the labels is held out
of the models for that.  Which documents are kept is the draw's decision: those within a few units of the cut are a matter of
chance, in proportion to their weights.

Toxic documents may be of good prose, so they are rejected by a model of their own before the draw.  It holds the tokens (lower
case, hashed to ``TOXIC_BUCKETS``) that labelled toxic documents contain more often than good ones by more than ``DEVIATIONS``
standard deviations of the log ratio; a token weighs what its log ratio exceeds that by.  A document whose different tokens' weights sum to more than
the cut that best separates held-out labels is not drawn.

Bounds: only the target and toxic models and the cuts are fitted on a sample of labelled rows, the ``sample_rows`` rows with
the smallest hashes of the id (documented bound); it is broadcast.  The raw model counts all documents.  Scores are written
once and read for the selection, whose exact k-th largest sum is found by histograms of fixed size.

Edge cases: null and empty texts, and texts without n-grams, have weight 0 (the corpus average) and are rejected;
without labels of both kinds all documents with text are kept; repeated rows share their noise and fate;
sums equal to the k-th are all kept; rows of one id share noise and labels, but not their fate, in ``keep_quality`` too; ids are cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetools import SPACE, hash_spans, mix, runs, slices, spread, text_bytes
from .staging import arrow_map, stage

BUCKETS = 1 << 14
TOXIC_BUCKETS = 1 << 22
DEVIATIONS = 3.0
SAMPLE_ROWS = 20_000
#: Pieces of a vector of counts that are added up apart.
CHUNKS = 32

_b = np.arange(256)
_WORDLIKE = ((_b | 32) >= ord("a")) & ((_b | 32) <= ord("z")) | (_b >= ord("0")) & (_b <= ord("9")) | (_b >= 0x80)
_TOKEN_KIND = np.where(SPACE, 0, np.where(_WORDLIKE, 1, 2)).astype(np.uint8)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def token_buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets (of ``TOXIC_BUCKETS``) of the different lower-cased tokens of each text."""
    buf, offsets = text_bytes(column)
    low = _LOWER[buf]
    starts, ends = runs(_TOKEN_KIND[low[:-8]], offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    both = np.unique(owner * TOXIC_BUCKETS + (hash_spans(low, starts, ends) % np.uint64(TOXIC_BUCKETS)).astype(np.int64))
    return both // TOXIC_BUCKETS, both % TOXIC_BUCKETS


def ngram_buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, flat, and their number in each text."""
    buf, offsets = text_bytes(column)
    starts, ends = runs(_TOKEN_KIND[buf[:-8]], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    h = hash_spans(buf, starts, ends)
    per = np.diff(np.searchsorted(starts, offsets))
    inner = np.repeat(per, per) - spread(per) > 1  # has a successor in its text
    pairs = mix(h[:-1] * np.uint64(3) ^ h[1:])[inner[:-1]]
    owner = np.repeat(np.arange(len(per)), per)
    which = np.concatenate([owner, owner[:-1][inner[:-1]]])
    order = np.argsort(which, kind="stable")
    return (np.concatenate([h, pairs])[order] % np.uint64(BUCKETS)).astype(np.int64), per + np.maximum(per - 1, 0)


def _label_sample(labels: DataFrame, id_col: str, sample_rows: int) -> DataFrame:
    """``l_id, kind, held``: kind 1 is good, 0 bad, 2 toxic; held rows choose cuts, the others fit models."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("q") == 1, 1).when(F.col("q") == 0, 0)
    held = F.pmod(F.xxhash64(F.lit(1), "l_id"), F.lit(3)) == 0
    return rows.select("l_id", kind.alias("kind"), held.alias("held")).where("kind is not null").orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)


def _counts(rows: DataFrame) -> np.ndarray:
    """Counts of buckets over all documents and over the good sample.  Two vectors of BUCKETS numbers leave each task, in pieces that are added up apart."""

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                buckets, per = ngram_buckets(piece.column("text"))
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                fits = np.asarray(pc.and_(pc.equal(piece.column("kind"), 1), pc.invert(piece.column("held"))).fill_null(False))
                total[1] += np.bincount(buckets[np.repeat(fits, per)], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.arange(CHUNKS), pa.int32()), "n": pa.array([x.tobytes() for x in total.reshape(CHUNKS, -1)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n")):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(n.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = arrow_map(rows.select("text", "kind", "held"), count, "chunk int, n binary")
    out = np.zeros((CHUNKS, 2 * BUCKETS // CHUNKS), np.int64)
    for row in arrow_map(parts.repartition(CHUNKS, "chunk"), add, "chunk int, n binary").collect():  # 2 * BUCKETS numbers
        out[row["chunk"]] = np.frombuffer(row["n"], np.int64)
    return out.reshape(2, BUCKETS)


def _toxic_model(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens that tell toxic documents from good ones, in order, and their weights."""

    def tokens(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                owner, bucket = token_buckets(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("kind").take(pa.array(owner)), pa.array(bucket)], names=["kind", "bucket"])

    fitted = rows.where("kind > 0 and not held").select("kind", F.coalesce("text", F.lit("")).alias("text"))
    toxic_docs, good_docs = (fitted.where(F.col("kind") == k).count() for k in (2, 1))
    if not toxic_docs or not good_docs:
        return np.zeros(0, np.int64), np.zeros(0)
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)) + F.lit(0.5)
    seen = arrow_map(fitted, tokens, "kind int, bucket long").groupBy("bucket").agg(n(2).alias("t"), n(1).alias("g"))
    ratio = F.log(F.col("t") / (toxic_docs + 1)) - F.log(F.col("g") / (good_docs + 1))
    found = seen.select("bucket", (ratio - DEVIATIONS * F.sqrt(1 / F.col("t") + 1 / F.col("g"))).alias("w")).where("w > 0").orderBy("bucket")
    rows = found.collect()  # tokens of the sample at most
    return np.array([r["bucket"] for r in rows], np.int64), np.array([r["w"] for r in rows], np.float64)


def best_cut(score: np.ndarray, good: np.ndarray, caution: float) -> float:
    """The cut between neighbouring scores with the least ``caution * share of good below + share of bad above``."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    loss = caution * np.append(0, np.cumsum(g)) / g.sum() + (np.append(0, np.cumsum(~g))[-1] - np.append(0, np.cumsum(~g))) / (~g).sum()
    at = int(np.argmin(loss))
    if at == 0:
        return -np.inf
    return float(s[at - 1] + (s[at] - s[at - 1]) / 2) if at < len(s) else np.inf


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value of ``column`` by histograms of ``bins`` counts over ever narrower ranges."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            break
        spot = F.least(F.floor((F.col(column) - lo) / step), F.lit(bins - 1)).cast("int")
        found = rows.where(F.col(column).between(lo, hi)).groupBy(spot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(found, key=lambda r: -r["b"]):
            if above + row["n"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
        else:
            return lo
    return lo


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket; the target model has BUCKETS n-grams of the raw one added."""
    raw_share = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    return np.log((target + BUCKETS * raw_share) / (target.sum() + BUCKETS)) - np.log(raw_share)


def importance_scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """Staged ``id, key, n, weight, toxic, kind, held``: log importance weight and toxic weight of each document."""
    sample = F.broadcast(stage(_label_sample(labels, id_col, sample_rows), "label-sample"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text")).join(sample, F.col("id") == F.col("l_id"), "left").select("id", "key", "text", "kind", "held")
    shared = docs.sparkSession.sparkContext.broadcast((log_ratios(*_counts(rows)), *_toxic_model(rows)))  # BUCKETS numbers, and tokens of the sample

    def score(batches):
        table, marked, weights = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                buckets, per = ngram_buckets(piece.column("text"))
                owner = np.repeat(np.arange(len(per)), per)
                weight = np.bincount(owner, table[buckets], minlength=len(per))
                toxic = np.zeros(len(per))
                if len(marked):
                    owner, token = token_buckets(piece.column("text"))
                    at = np.minimum(np.searchsorted(marked, token), len(marked) - 1)
                    toxic = np.bincount(owner, np.where(marked[at] == token, weights[at], 0.0), minlength=len(per))
                columns = {"id": piece.column("id"), "key": piece.column("key"), "n": pa.array(per, pa.int64()), "weight": pa.array(weight, pa.float64()), "toxic": pa.array(toxic, pa.float64())}
                yield pa.RecordBatch.from_pydict(columns | {"kind": piece.column("kind"), "held": piece.column("held")})

    return stage(arrow_map(rows, score, "id long, key long, n long, weight double, toxic double, kind int, held boolean"), "quality-scores")


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    caution: float = 10.0,
    temperature: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, n_grams, log_weight, toxic_weight, sum, kept`` per document (``sum``: log weight plus Gumbel noise)."""
    return _fates(docs, labels, id_col, text_col, sample_rows, caution, temperature, seed).drop("key")


def gumbel(ident: Column, seed: int) -> Column:
    """Gumbel noise, a function of the id."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def _fates(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, caution: float = 10.0, temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """``classify_quality`` with the hash of the text, ``key``, which tells rows of one id apart."""
    scored = importance_scores(docs, labels, id_col, text_col, sample_rows)
    known = scored.where("held and n > 0").groupBy("id", "kind").agg(F.min("weight").alias("weight"), F.max("toxic").alias("toxic")).toPandas()  # sample_rows rows at most
    weight, toxic, kind = (known[c].to_numpy() for c in ("weight", "toxic", "kind"))
    cut = best_cut(weight[kind < 2], kind[kind < 2] == 1, caution)
    clean = (F.col("n") > 0) & (-F.col("toxic") >= F.lit(best_cut(-toxic[kind > 0], kind[kind > 0] == 1, caution)))
    noisy = scored.withColumn("sum", F.col("weight") + F.lit(temperature) * gumbel(F.col("id"), seed))
    k = scored.where(clean & (F.col("weight") >= F.lit(cut))).count()
    least = kth_largest(noisy.where(clean), "sum", k) if k else float("inf")
    kept = (clean & (F.col("sum") >= F.lit(least))).alias("kept")
    return noisy.select(F.col("id").alias(id_col), "key", F.col("n").alias("n_grams"), F.col("weight").alias("log_weight"), F.col("toxic").alias("toxic_weight"), "sum", kept)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    fate = _fates(docs, labels, id_col, text_col, **params).where("kept").select(F.col(id_col).alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(fate["kept_id"]) & (text_key(docs[text_col]) == fate["kept_key"])
    return docs.join(fate, same, "left_semi")
