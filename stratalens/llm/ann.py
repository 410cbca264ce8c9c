"""Nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_id

#: Counters that a recount keeps at hand at a time, so that they stay in a core's cache.
AT_HAND = 1 << 17
#: Windows that grow by one in so many of all places or more are counted anew, which then costs less than counting what entered.
ANEW = 24
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def window_factor(count: int, need: int, miss: float) -> float:
    """Half-width, in distances, of windows that a point collides in ``need`` of ``count`` times, but for a chance of ``miss``.

    A Gaussian projection moves a point at distance d by d times a standard normal
    number, so it stays within w with probability p = erf(w / d / sqrt 2), and the
    number of its collisions is binomial. With ``miss`` 0 no width is enough.
    """
    if miss <= 0:
        return math.inf
    ways = [math.lgamma(count + 1) - math.lgamma(i + 1) - math.lgamma(count - i + 1) for i in range(need)]
    low, high = 0.0, 8.0
    for _ in range(60):
        x = (low + high) / 2
        inside, outside = math.log(max(math.erf(x / math.sqrt(2)), 1e-300)), math.log(max(math.erfc(x / math.sqrt(2)), 1e-300))
        missed = sum(math.exp(w + i * inside + (count - i) * outside) for i, w in enumerate(ways))
        low, high = (x, high) if missed > miss else (low, x)
    return high


class Projections:
    """Sorted arrays of one random projection each, over the vectors of one range of norms.

    Inner products become distances by one more coordinate: with R the largest
    norm, x is placed at (x, sqrt(R^2 - |x|^2)) / R and a query at (q, 0) / |q|, so
    that the nearest point has the largest product.
    """

    def __init__(self, vectors: np.ndarray, radius: float, count: int, need: int, miss: float, seed: int) -> None:
        n, d = vectors.shape
        self.directions = np.random.default_rng(seed).standard_normal((d + 1, count))
        square = np.einsum("ij,ij->i", vectors, vectors)
        rest = np.sqrt(np.maximum(radius * radius - square, 0.0))
        placed = ((vectors @ self.directions[:d] + rest[:, None] * self.directions[d]) / radius).T.astype(np.float32)
        self.order = np.argsort(placed, axis=1).astype(np.int32)  # windows hold all equal numbers or none, so their order is free
        self.sorted = np.take_along_axis(placed, self.order, axis=1)
        self.ranks = np.empty(self.order.shape, dtype=np.uint16 if n < 1 << 16 else np.uint32)  # of each place, in each sorted array
        np.put_along_axis(self.ranks, self.order.astype(np.int64), np.arange(n, dtype=self.ranks.dtype)[None, :], axis=1)
        self.vectors, self.radius, self.n, self.count, self.need = vectors, radius, n, count, need
        self.factor = window_factor(count, need, miss)
        self.counter = np.uint8 if count < 256 else np.uint16

    def recount(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Collisions of every place in the windows low..high (projections x queries) into ``counts`` (queries x places)."""
        kind = self.ranks.dtype.type
        counts[:] = 0
        low, wide = low.astype(kind), np.minimum(high - low, np.iinfo(kind).max).astype(kind)
        step = max(1, AT_HAND // self.n)
        for at in range(0, len(counts), step):
            part = counts[at : at + step]
            off, hit = np.empty(part.shape, dtype=kind), np.empty(part.shape, dtype=bool)
            for rank, a, b in zip(self.ranks, low[:, at : at + step, None], wide[:, at : at + step, None], strict=True):
                np.subtract(rank[None, :], a, out=off)  # wraps round below the window
                np.less(off, b, out=hit)
                np.add(part, hit.view(np.uint8), out=part)

    def entered(self, counts: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Add the collisions of one query's windows grown from ``old`` to ``new`` (rows low, high); the places that entered any."""
        parts = [self.order[i, a:b] for i, ends in enumerate(zip(new[0].tolist(), old[0].tolist(), old[1].tolist(), new[1].tolist(), strict=True)) for a, b in (ends[:2], ends[2:]) if a < b]
        if not parts:
            return np.zeros(0, np.int64)
        places = np.concatenate(parts)
        if len(places) > self.n // 4:
            times = np.bincount(places, minlength=self.n)
            counts += times.astype(counts.dtype)
            return np.flatnonzero(times)
        places, times = np.unique(places, return_counts=True)
        counts[places] += times.astype(counts.dtype)
        return places

    def widened(self, asked: np.ndarray, live: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows low..high (projections x queries) with those of the queries ``live`` widened to ``reach``."""
        low, high, wide = low.copy(), high.copy(), reach[live].astype(np.float32)
        for s, a, at, to in zip(self.sorted, asked[:, live], low, high, strict=True):
            at[live] = np.minimum(at[live], np.searchsorted(s, a - wide))
            to[live] = np.maximum(to[live], np.searchsorted(s, a + wide, "right"))
        return low, high

    def search(self, queries: np.ndarray, norms: np.ndarray, own: np.ndarray, bests: list[Best], width: float, grow: float, ahead: int) -> None:
        """Add to ``bests`` the places nearest to each query; ``own`` is the query's place or -1.

        Every projection has a window centred on the query, found in its sorted
        array. Virtual rehashing widens all windows by ``grow``. A place that
        collides in ``need`` windows or more is verified, and so are each time the
        ``ahead`` places with most collisions, to learn early how near neighbours
        are. With t the distance of the last of the best ``top``, windows need not be
        wider than ``factor`` * t: a place nearer than t would have been verified, but
        for a chance of ``miss``. A query ends at that width, or when all its windows
        hold everything. Only places that enter a window are counted; where they are
        a large part of all, ranks are compared with the windows, which counts the same.
        As that costs the same at any width, such windows go to the last width at once.
        """
        limit = np.array([self.factor * best.distance(n, self.radius) for best, n in zip(bests, norms.tolist(), strict=True)])
        live = np.flatnonzero(limit >= 0)
        asked = (queries @ self.directions[:-1] / norms[:, None]).T.astype(np.float32)
        counts = np.zeros((len(queries), self.n), dtype=self.counter)
        verified = np.zeros((len(queries), self.n), dtype=bool)
        verified[np.flatnonzero(own >= 0), own[own >= 0]] = True
        low = high = np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, asked, strict=True)])
        while len(live):
            reach = np.minimum(width, limit)
            before = low, high
            low, high = self.widened(asked, live, reach, low, high)
            sizes = (high - low).sum(axis=0) - (before[1] - before[0]).sum(axis=0)
            anew = sizes * ANEW >= self.n * self.count
            many = live[anew[live]]
            if len(many):
                known = many[np.isfinite(limit[many])]
                reach[known] = limit[known]
                low, high = self.widened(asked, known, reach, low, high)
                counted = np.empty((len(many), self.n), dtype=self.counter)
                self.recount(counted, low[:, many], high[:, many])
                counts[many] = counted
            stay = []
            for i in live.tolist():
                full = int((high[:, i] - low[:, i]).min()) >= self.n
                if anew[i]:
                    new = np.flatnonzero(~verified[i])
                else:
                    new = self.entered(counts[i], np.stack([before[0][:, i], before[1][:, i]]), np.stack([low[:, i], high[:, i]]))
                    new = new[~verified[i][new]]
                held = counts[i][new]
                some = held >= self.need
                if len(new) - int(some.sum()) > ahead:
                    left = np.flatnonzero(~some)
                    some[left[np.argpartition(held[left], len(left) - ahead)[len(left) - ahead :]]] = True
                else:
                    some[:] = True
                new = new[some]
                if len(new):
                    verified[i][new] = True
                    bests[i].add(new, self.vectors[new], queries[i])
                limit[i] = self.factor * bests[i].distance(norms[i], self.radius)
                if reach[i] < limit[i] and not full:
                    stay.append(i)
            live = np.array(stay, dtype=np.int64)
            width *= grow


class Best:
    """The best places of a query so far, over ranges of norms."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, top: int) -> None:
        self.rows, self.ids, self.top = rows, ids, top
        self.places: np.ndarray = np.zeros(0, np.int64)
        self.scores: np.ndarray = np.zeros(0)
        self.of: np.ndarray | None = None  # places of the range that is being searched

    def add(self, at: np.ndarray, vectors: np.ndarray, query: np.ndarray) -> None:
        places = np.concatenate([self.places, self.of[at]])
        scores = np.concatenate([self.scores, np.einsum("ij,j->i", vectors, query)])  # row by row, so that equal vectors tie
        if len(places) > 4 * self.top:
            cut = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            places, scores = places[scores >= cut], scores[scores >= cut]
        order = np.lexsort((self.rows[places], self.ids[places], -scores))[: self.top]
        self.places, self.scores = places[order], scores[order]

    def distance(self, norm: float, radius: float) -> float:
        """How far, in a range of this radius, a place may lie that ties the last of the best; below 0: none can."""
        if len(self.scores) < self.top:
            return math.inf
        square = 2.0 - 2.0 * self.scores[-1] / (norm * radius)
        return math.sqrt(square) if square > 0 else (1e-6 if square > -1e-9 else -1.0)  # products of one pair differ by rounding


def norm_ranges(norms: np.ndarray, ratio: float = 0.5) -> list[np.ndarray]:
    """Places by falling norm, cut where the norm falls below ``ratio`` times the largest of the range."""
    order = np.argsort(-norms, kind="stable")
    falling, out, at = -norms[order], [], 0
    while at < len(order):
        end = int(np.searchsorted(falling, ratio * falling[at], side="right"))
        out.append(np.sort(order[at:end]))
        at = end
    return out


def search_block(
    rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, top: int, projections: int, threshold: float, miss: float, width: float, grow: float, ahead: int, seed: int, cells: int = 1 << 21
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the best ``top`` of a block: (query place, places, scores). ``rows`` ascend.

    Each range of norms is indexed with its own radius. Ranges are taken by falling
    norm; a query leaves out those whose radius times its norm is less than its last
    product. Queries go in batches that have about ``cells`` counters.
    """
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    need = max(1, round(threshold * projections))
    parts = []
    for places in norm_ranges(lengths):
        x = np.ascontiguousarray(vectors[places])
        parts.append((places, rows[places], Projections(x, float(lengths[places].max()), projections, need, miss, seed)))
    batch = max(1, cells // len(rows))
    for start in range(0, len(queries), batch):
        part, mine = queries[start : start + batch], query_rows[start : start + batch]
        norms = np.sqrt(np.einsum("ij,ij->i", part, part))
        bests = [Best(rows, ids, top) for _ in part]
        for places, of, index in parts:
            at = np.minimum(np.searchsorted(of, mine), len(places) - 1)
            for best in bests:
                best.of = places
            index.search(part, norms, np.where(of[at] == mine, at, -1), bests, width, grow, ahead)
        for i, best in enumerate(bests):
            yield start + i, best.places, best.scores


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    top: int = 20,
    components: int = 1 << 20,
    query_block: int = 1024,
    projections: int = 256,
    threshold: float = 0.65,
    miss: float = 0.03,
    width: float = 0.2,
    grow: float = 2.0,
    ahead: int = 80,
    seed: int = 11,
) -> DataFrame:
    """The ``top`` rows of largest inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates all rows
    but the query's own. All rows are indexed: they are dealt by hash into blocks of
    about ``components`` numbers, queries into blocks of ``query_block``; a task takes
    one block of each, cuts its vectors into ranges of norms, sorts ``projections``
    projections of each range and widens windows around each query
    (:meth:`Projections.search`). A vector that lies in ``threshold`` of the windows
    or more is verified by its product, in double precision. There is no cap: windows
    widen until a vector among the true ``top`` would have been verified with
    probability 1 - ``miss``, whatever the data and the size of the block. That holds
    for each neighbour of each query, so recall is 1 - ``miss`` or more on average;
    ``miss`` 0 widens until every vector is verified, which is exact. Each block
    gives its best ``top``, and a window over blocks gives the final ones. Ties go to
    the smaller id, then the earlier row.

    Work: vectors in tight groups leave after narrow windows, whose few entries are
    counted one by one. Over isolated vectors in many dimensions windows have to hold
    half of all vectors, so work grows with queries times rows, like a plain scan.

    Vectors that are null, empty, zero, or hold null or non-finite components, and
    rows with null id, take no part. Vectors of different lengths never meet. Of
    repeated rows each is a candidate and, if divisible, a query of its own. Fewer
    candidates than ``top``: all of them. An empty table gives an empty result;
    other columns are not read.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(row_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(rows.where(sound).withColumn("d", F.size("v")), "ann-rows")
    facts = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q"))
    facts = facts.select("d", F.ceil(F.col("n") * F.col("d") / components).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("q") / query_block), F.lit(1)).cast("int").alias("qblocks"))
    known = rows.join(materialize(facts, "ann-facts", gathered=True), "d")  # one row for each vector length, read back with its size known
    queries = known.where(F.col("id") % every == 0).withColumn("j", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("qblocks").cast("long")))
    own = known.withColumn("i", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.col("blocks").cast("long"))).withColumn("j", F.explode(F.expr("sequence(0L, qblocks - 1L)")))
    asked = queries.withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    columns = ["d", "i", "j", "row", "id", "v"]
    options = {"projections": projections, "threshold": threshold, "miss": miss, "width": width, "grow": grow, "ahead": ahead, "seed": seed}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        x, q = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
        place = np.argsort(left.column("row").to_numpy())
        own_rows, ids, x = left.column("row").to_numpy()[place], left.column("id").to_numpy()[place], x[place]
        asked_rows, asked_ids = right.column("row").to_numpy(), right.column("id").to_numpy()
        got = list(search_block(own_rows, ids, x, asked_rows, q, top, **options))
        at = np.concatenate([a for _, a, _ in got]).astype(np.int64)
        who = np.repeat(np.array([i for i, _, _ in got]), [len(a) for _, a, _ in got]).astype(np.int64)
        arrays = [asked_rows[who], asked_ids[who], own_rows[at], ids[at], np.concatenate([s for _, _, s in got])]
        return pa.Table.from_arrays([pa.array(a) for a in arrays], schema=FOUND)

    columns = [F.col(c).alias(c) for c in columns]  # both sides come from one table: new names for the columns of each
    found = own.select(columns).groupBy("d", "i", "j").cogroup(asked.select(columns).groupBy("d", "i", "j")).applyInArrow(run, "query_row long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
