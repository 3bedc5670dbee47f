"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are integer (floor of ``scale`` times a component).  A term is a dimension; a posting's impact is the component's distance from
the block's mean of the dimension, quantised to ``LEVELS`` levels of the dimension's range there (small integers are exact), and a score
is the sum of weighted impacts plus a constant of the query.

A block of vectors meets a block of queries term by term in descending order of impact: what the term's postings hold in the block
times what the queries weigh it.  The leading terms, all postings of them, are accumulated first, for tiles of queries and vectors at a
time by matrix products.  What a vector can still gain is at most the product of two norms (Cauchy-Schwarz): of the query's weights and of the
vector's impacts behind the leading terms.  Vectors that stay under the query's k-th best score so far cannot enter its top k.  Where the leading
terms end is chosen so that about ``few`` vectors of the block are left to a query.  Those left are rescored exactly in integers.
Skewed queries are grouped by their strongest term, so that each group has leading terms of its own.
A sample of the block and the scores so far tell where; that decides what is computed, never the result.
Quantisation and rounding widen the bounds.

Blocks are built once and stored.  A task meets several blocks of vectors one after another with blocks of queries that are broadcast,
``QUERIES_PER_ROUND`` at a time, and holds each query's best k, so that every further block meets a sharper threshold.  The best k over all tasks
are kept by rank.  Nothing is shuffled but the blocks of vectors, once a round, and k rows a query and task.

Vectors of many dimensions whose components are spread evenly leave little to stop early for; skewed vectors and queries stop earlier.
``Index.search`` returns how many postings it skipped.  The work is that of all pairs of queries and vectors, so it grows with the square of a table
of which a fixed share asks.

Edge cases: null vectors and vectors with null or non-finite components take no part; shorter vectors count as if
ended by zeros; ties go to the smaller id; repeated ids are repeated rows; a query excludes rows of its own id; no rows
give no rows.  Of equal vectors in a block only the 2 k rows that can matter are compared (k of an id at most).  Scores are exact as far
as a long holds them: components beyond that range after scaling, and scores that may leave it, raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetools import mix, spread
from .staging import arrow_map, ship, stage

LEVELS = 4096
VECTORS_PER_BLOCK = 32768
QUERIES_PER_BLOCK = 16384
#: Queries that are broadcast at a time.
QUERIES_PER_ROUND = 16 * QUERIES_PER_BLOCK
TILE = 512
#: Vectors that a query without a threshold meets first; steps double from there.
FIRST, MOST = 128, 8192
#: Share of a block's vectors that may be left to rescore after the leading terms.
LEFT = 2048
PILOT = 256
#: Share of the queries' impact in a quarter of their terms from which they are grouped by their strongest term.
SKEWED = 0.9


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; by unbounded integers where 64 bits might not do."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query.astype(np.float64)).sum())
    if most < 2.0**62:
        return vectors @ query
    found = vectors.astype(object) @ query.astype(object)
    if any(not -(1 << 63) <= int(x) < 1 << 63 for x in found):
        raise OverflowError("a score leaves the range of a long")
    return np.array([int(x) for x in found], np.int64)


def _rank_in_runs(*keys: np.ndarray) -> np.ndarray:
    """Number of each row among its neighbours of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    return spread(np.diff(np.append(np.nonzero(new)[0], len(new))))


class Best:
    """The best ``k`` rows of each query so far: number of the query, score, id and row, ordered by query and rank."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(query):
            return
        met = np.zeros(len(self.floor), bool)
        met[query] = True
        old = met[self.rows[0]]
        both = [np.concatenate([x[old], y]) for x, y in zip(self.rows, (query, score, ids, row))]
        order = np.lexsort((both[2], ~both[1], both[0]))  # ~ turns the order of all longs round
        both = [x[order] for x in both]
        rank = _rank_in_runs(both[0])
        full = rank == self.k - 1
        # as floating point, never above the score itself
        self.floor[both[0][full]] = np.nextafter(both[1][full].astype(np.float64), -np.inf)
        self.rows = tuple(np.concatenate([x[~old], y[rank < self.k]]) for x, y in zip(self.rows, both))


class Index:
    """Impacts of one block of vectors: of each term, quantised."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors.astype(np.int64)
        wide = self.vectors.astype(np.float64)
        self.centre = np.rint(wide.mean(axis=0))
        wide -= self.centre
        self.step = np.maximum(1.0, -(-(wide.max(axis=0) - wide.min(axis=0) + 1) // LEVELS))
        quantised = np.rint(wide / self.step) * self.step
        self.impact, self.quantised = wide.astype(np.float32), quantised.astype(np.float32)  # n x d
        self.remainder = (wide - quantised).astype(np.float32) if (self.step > 1).any() else None
        self.most = float(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        self.energy = (wide * wide).mean(axis=0)
        self.length = float(np.sqrt((wide * wide).sum(axis=1)).max(initial=0) + np.sqrt((self.centre**2).sum()))

    def scores(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact inner products of rows and as many queries."""
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 1 << 16):
            part, ask = self.vectors[rows[a : a + (1 << 16)]], queries[a : a + (1 << 16)]
            if self.most * float(np.abs(ask.astype(np.float64)).sum(axis=1).max()) < 2.0**62:
                out[a : a + len(part)] = np.einsum("ij,ij->i", part, ask)
            else:
                out[a : a + len(part)] = [exact_scores(v[None], q)[0] for v, q in zip(part, ask)]
        return out

    def _sides(self, terms: np.ndarray, cut: int, weights: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Left and right side of the product that accumulates the first ``cut`` terms and adds what the others, and the remainders, can give."""
        lead, rest = terms[:cut], terms[cut:]
        up = 1 + 2.0**-20 + len(terms) * 2.0**-22  # norms are rounded up
        norm = lambda x: (np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)) * up)[:, None].astype(np.float32)
        left, right = [weights[:, lead].astype(np.float32)], [self.quantised[rows][:, lead]]
        if len(rest):
            left.append(norm(weights[:, rest]))
            right.append(norm(self.impact[rows][:, rest]))
        if self.remainder is not None:
            left.append(norm(weights[:, lead]))
            right.append(norm(self.remainder[rows][:, lead]))
        return np.hstack(left), np.hstack(right)

    def _cut(self, terms: np.ndarray, weights: np.ndarray, need: np.ndarray, share: float) -> int:
        """The least number of leading terms after which, in a sample, at most ``share`` of the vectors are left to a query."""
        n, d = self.vectors.shape
        ask = np.nonzero(np.isfinite(need))[0]
        if not len(ask):
            return d
        ask = ask[np.linspace(0, len(ask) - 1, min(PILOT, len(ask))).astype(np.int64)]
        rows = np.linspace(0, n - 1, min(PILOT, n)).astype(np.int64)
        for cut in sorted({-(-d * j // 16) for j in range(4, 16)}):
            left, right = self._sides(terms, cut, weights[ask], rows)
            if ((left @ right.T) >= need[ask, None]).mean() <= share:
                return cut
        return d

    def extend(self, best: Best, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, few: int | None = None) -> int:
        """Adds this block's vectors to the best of each query; returns how many postings were skipped."""
        weights = queries.astype(np.float64)
        impact = weights * weights * self.energy
        leading = -np.sort(-impact, axis=1)[:, : -(-impact.shape[1] // 4)].sum(axis=1)
        if leading.sum() < SKEWED * impact.sum():
            return self._extend(best, np.arange(len(queries)), queries, own, ids, few)
        strongest = impact.argmax(axis=1)
        groups = [np.nonzero(strongest == term)[0] for term in np.unique(strongest)]
        return sum(self._extend(best, g, queries[g], own[g], ids, few) for g in groups)

    def _extend(self, best: Best, members: np.ndarray, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, few: int | None) -> int:
        """``extend`` for the queries of the numbers ``members``."""
        n, d = self.vectors.shape
        few = max(1, n // LEFT) if few is None else few
        queries = queries.astype(np.int64)
        weights = queries.astype(np.float64)
        base = weights @ self.centre
        size = np.sqrt((weights * weights).sum(axis=1))
        reach = size * self.length
        wild = bool(reach.max(initial=0) > 2.0**100)  # single precision might overflow: all are scored exactly, which raises what must be raised
        terms = np.argsort(-(weights * weights).mean(axis=0) * self.energy, kind="stable")
        error = (d + 16) * 2.0**-23  # of sums and products in single precision, of what they add up
        out, skipped, a = np.empty((TILE, TILE), np.float32), 0, 0
        step, cut = (MOST if np.isfinite(best.floor[members]).all() else FIRST), None
        whole = None
        while a < n:
            b = min(n, a + step)
            need = best.floor[members] - base
            slack = error * (reach + np.where(np.isfinite(need), np.abs(need), 0) + np.abs(base))
            cold = np.nonzero(~np.isfinite(need))[0]
            if len(cold) and not wild:  # no threshold yet: the k-th best accumulated score of this part gives one
                whole = whole or self._sides(terms, d, weights)
                for at in range(0, len(cold), TILE):
                    q = cold[at : at + TILE]
                    acc = whole[0][q, :d] @ whole[1][a:b, :d].T
                    acc[own[q][:, None] == ids[None, a:b]] = -np.inf
                    if b - a > best.k:
                        kth = np.partition(acc, b - a - best.k, axis=1)[:, b - a - best.k].astype(np.float64)
                        off = whole[0][q, d:].astype(np.float64) @ whole[1][a:b, d:].astype(np.float64).max(axis=0, initial=0) if self.remainder is not None else 0
                        need[q] = kth - off - 2 * slack[q]  # -inf where too few rows are others
            need = need - slack
            if cut is None or step < MOST:
                cut = self._cut(terms, weights, need, few / n) if (a or not len(cold)) and not wild else d
                left, right = self._sides(terms, cut, weights)
            bound = np.where(np.isfinite(need), need, -1e38)
            # rounded down, so that what reaches it in double precision does here
            bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for v in range(a, b, TILE):
                w = min(b, v + TILE)
                tile = np.ascontiguousarray(right[v:w].T)
                for q in range(0, len(queries), TILE):
                    r = min(len(queries), q + TILE)
                    acc = out[: r - q, : w - v] if w - v == TILE else np.empty((r - q, w - v), np.float32)
                    np.matmul(left[q:r], tile, out=acc)
                    if wild:
                        acc.fill(0)
                        bound.fill(-1)
                    hit = np.nonzero(acc.max(axis=1) >= bound[q:r])[0]
                    if not len(hit):
                        continue
                    row, col = np.nonzero(acc[hit] >= bound[q:r][hit, None])
                    row, col = hit[row] + q, col + v
                    other = ids[col] != own[row]
                    found.append((row[other], col[other]))
            query = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            row = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            skipped += int((np.bincount(query, minlength=len(queries)) <= few).sum()) * (b - a) * (d - cut)
            best.add(members[query], self.scores(row, queries[query]), ids[row], row)
            a, step = b, min(MOST, step * 2)
        return skipped

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, few: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Positions and scores of the best ``k`` vectors of each query other than those of its own id, and the number of skipped postings."""
        best = Best(len(queries), k)
        skipped = self.extend(best, queries, own, ids, few)
        query, score, found, row = best.rows
        order = np.lexsort((found, ~score, query))
        cuts = np.searchsorted(query[order], np.arange(len(queries) + 1))
        return [(row[order[a:b]], score[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], skipped


def _that_matter(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best k of any query: of equal vectors the first 2 k by id, counting k rows of an id at most
    (a query's own id takes away at most k of these)."""
    sums = vectors.view(np.uint64) @ mix(np.arange(1, vectors.shape[1] + 1, dtype=np.uint64))  # equal vectors have equal sums
    order = np.lexsort((ids, sums))
    near = vectors[order]
    alike = np.append(0, np.cumsum((near[1:] != near[:-1]).any(axis=1)))
    some = _rank_in_runs(alike, ids[order]) < k
    order, alike = order[some], alike[some]
    return np.sort(order[_rank_in_runs(alike) < 2 * k])


def _blocks(rows: DataFrame, per_block: int, n: int, k: int | None = None) -> DataFrame:
    """Rows ``block, part, ids, width, kind, vectors`` of about ``per_block`` vectors; a block has one width.  With ``k``, only rows that matter."""
    blocks = max(1, -(-n // per_block))

    def block(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id").combine_chunks())
        lists = table.column("v").combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        out = np.zeros((len(ids), int(sizes.max())), np.int64)
        out[np.repeat(np.arange(len(ids)), sizes), spread(sizes)] = np.asarray(lists.flatten())
        if k:
            keep = _that_matter(ids, out, k)
            ids, out = ids[keep], out[keep]
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= out.min() and out.max() <= np.iinfo(t).max)
        parts = []
        for m, part in enumerate(np.array_split(np.arange(len(ids)), -(-len(ids) // (2 * per_block)))):
            parts.append((int(table.column("block")[0].as_py()), m, ids[part].astype("<i8").tobytes(), out.shape[1], kind, out[part].astype(kind).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts), kinds)], names=["block", "part", "ids", "width", "kind", "vectors"])

    ship(rows.sparkSession)
    # by the place in the stored table, so that equal rows and ids are dealt evenly
    dealt = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    return dealt.groupBy("block").applyInArrow(block, "block int, part int, ids binary, width int, kind string, vectors binary")


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["width"]).astype(np.int64)


def exact_top_k(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows.  ``is_query`` is a condition on ``id``."""
    vector = F.col("x").cast("array<double>")
    usable = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].alias("x")).where(F.coalesce(usable, F.lit(False)))
    fits = lambda x: F.when(F.abs(x * F.lit(scale)) < F.lit(2.0**62), F.floor(x * F.lit(scale)).cast("long")).otherwise(F.raise_error(F.lit("a component leaves the range of a long")).cast("long"))
    rows = rows.select("id", F.transform(vector, fits).alias("v")).where(F.size("v") > 0)
    rows = stage(rows, "vectors")
    asked = rows.where(is_query)
    n, q = rows.count(), asked.count()
    index = stage(_blocks(rows, VECTORS_PER_BLOCK, n, k), "index-blocks")
    queries = stage(_blocks(asked, QUERIES_PER_BLOCK, q), "query-blocks")
    side = lambda df, x: df.select(F.struct("block", "part", "ids", "width", "kind", "vectors").alias(x))

    def search(batches):
        held, best, last, block = {}, {}, None, None
        for batch in batches:
            for i, ask in zip(batch.column("i"), batch.column("q")):
                if (at := (i["block"].as_py(), i["part"].as_py())) != last:
                    ids, vectors = _matrix(i.as_py())
                    last, block = at, Index(vectors)
                if (to := (ask["block"].as_py(), ask["part"].as_py())) not in best:
                    own, weights = _matrix(ask.as_py())
                    held[to], best[to] = (own, weights.astype(np.min_scalar_type(-1 - int(np.abs(weights).max(initial=1))))), Best(len(own), k)
                own, weights = held[to]
                width = block.vectors.shape[1]  # beyond it the block's vectors hold zeros, so further components of a query count nothing
                block.extend(best[to], np.pad(weights, ((0, 0), (0, max(0, width - weights.shape[1]))))[:, :width], own, ids)
        for to in best:
            query, score, found, _ = best[to].rows
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(held[to][0][query]), "vec_id": pa.array(found), "score": pa.array(score)})

    blocks, every = max(1, -(-n // VECTORS_PER_BLOCK)), None
    per_round = max(1, QUERIES_PER_ROUND // QUERIES_PER_BLOCK)
    for first in range(0, max(1, -(-q // QUERIES_PER_BLOCK)), per_round):
        some = queries.where(F.col("block").between(first, first + per_round - 1))
        # few tasks of several blocks: thresholds carry over, and each task returns k rows a query
        pairs = side(index, "i").repartition(min(blocks, max(48, blocks // 16))).crossJoin(F.broadcast(side(some, "q")))
        found = arrow_map(pairs, search, "query_id long, vec_id long, score long")
        every = found if every is None else every.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
