"""Most similar vectors by a permutation index (problem 5).

A vector is represented by the order of its nearest pivots and posted in the inverted
file of each of its first few. Vectors that point the same way see the pivots in
nearly the same order, so candidates share a posting, are ranked there by the footrule
distance of their pivot orders, and the best are reranked by cosine: first with
vectors rounded to a byte a component, whose error is known and allowed for, then exactly.

With weight ``w = prefix - place`` for the pivots in a vector's prefix (0 for all
others) the footrule distance of two prefixes, missing pivots placed at the end, is
``prefix * (prefix + 1) - 2 * sum(min(w_a, w_b))``: only shared pivots matter, which
is what a posting list provides. ``closeness`` below is that sum of minima.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import divide, norm
from quillrank.operators.cut import cut

#: Pivots grow with the root of the collection, up to this many (a billion vectors; 64 MB at 64 dimensions).
MAX_PIVOTS = 262_144
#: A pivot closer than this cosine to an earlier one is left out, so a dense cluster has few and shares them.
PIVOT_SPREAD = 0.85
#: Longer postings are cut into parts of about this many entries; every two parts meet in a group of their own.
POSTING = 2_000
#: Entries that one group of short postings holds, about.
GROUP = 20_000
#: Up to this many row numbers (8 bytes each) are broadcast to pick rows out of the collection.
MAX_PICKED = 200_000
#: Vectors of a block of the exhaustive product; a task holds two (64 dimensions: 25 MB in both precisions).
CHUNK = 16_000


def usable_vectors(rows: DataFrame, item: str, vector: str, dim: int) -> DataFrame:
    """``(item, vec, norm)``: vectors of ``dim`` finite numbers that are not all zero.

    Others, and NULL items, take no part. Of rows that repeat an item the least
    vector is kept.
    """
    v = F.col(vector)
    ok = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = rows.select(F.col(item), v.alias("vec")).filter(F.col(item).isNotNull() & ok)
    one = good.groupBy(item).agg(F.min("vec").alias("vec"))
    # scaled by the largest component first, so that no square over- or underflows
    top = F.array_max(F.transform("vec", F.abs)).cast("double")
    scaled = one.withColumn("_top", top).filter(F.col("_top") > 0)
    return scaled.select(item, "vec", (F.col("_top") * norm(divide("vec", F.col("_top")))).alias("norm"))


def _unit(vec: pa.Array, length: pa.Array) -> np.ndarray:
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vec), -1) / length.to_numpy(zero_copy_only=False)[:, None]


# the index ------------------------------------------------------------------------------

def pivot_count(n: int) -> int:
    """Pivots for ``n`` vectors: postings and pivots both grow with the root of ``n``."""
    return max(1, min(MAX_PIVOTS, n, math.ceil(8 * math.sqrt(n))))


def spread_out(vectors: np.ndarray, count: int, spread: float = PIVOT_SPREAD) -> np.ndarray:
    """The first ``count`` unit vectors of which none is closer than ``spread`` to an earlier one."""
    kept = np.empty((0, vectors.shape[1]), vectors.dtype)
    for s in range(0, len(vectors), 1024):
        block = vectors[s : s + 1024]
        if len(kept):
            near = np.zeros(len(block), bool)
            for k in range(0, len(kept), 16_384):
                near |= (block @ kept[k : k + 16_384].T).max(axis=1) >= spread
            block = block[~near]
        own = block @ block.T >= spread
        good = np.ones(len(block), bool)
        for i in range(1, len(block)):
            good[i] = not (own[i, :i] & good[:i]).any()
        kept = np.concatenate([kept, block[good]])
        if len(kept) >= count:
            break
    return kept[:count]


def choose_pivots(units: DataFrame, item: str, count: int) -> np.ndarray:
    """About ``count`` spread-out vectors from a bounded sample: the first ``2 * count`` by a hash of the item."""
    rows = units.orderBy(F.md5(F.col(item).cast("string")), item).limit(2 * count).select("vec", "norm").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.empty((0, 1), np.float32)
    return spread_out(_unit(rows.column(0).combine_chunks(), rows.column(1)).astype(np.float32), count)


def pivot_orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of every row, nearest first, ties by number."""
    prefix = min(prefix, len(pivots))
    out = np.empty((len(x), prefix), np.int64)
    step = max(1, 4_000_000 // len(pivots))
    for s in range(0, len(x), step):
        sims = x[s : s + step] @ pivots.T
        if prefix < len(pivots):
            least = np.partition(sims, len(pivots) - prefix, axis=1)[:, len(pivots) - prefix, None]
            # of pivots tied at the end of the prefix the first by number
            above, tied = sims > least, sims == least
            tied &= np.cumsum(tied, axis=1) <= prefix - above.sum(axis=1, keepdims=True)
            near = np.nonzero(above | tied)[1].reshape(-1, prefix)
        else:
            near = np.broadcast_to(np.arange(prefix), (len(sims), prefix))
        by = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        out[s : s + step] = np.take_along_axis(near, by, axis=1)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Every row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(0, len(rows) * width + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])


def _from_binary(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    chunks = [np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1) for c in column.chunks if len(c)]
    return np.concatenate(chunks)


def signatures(units: DataFrame, pivots: np.ndarray, prefix: int, lists: int) -> DataFrame:
    """``(_row, lists, order, scale, code, error)`` of every vector.

    ``lists``: the first pivots, in whose postings the vector stands; ``order``: the whole
    prefix; ``code * scale``: the unit vector rounded to a byte a component, at most ``error`` away.
    """
    shared = units.sparkSession.sparkContext.broadcast(pivots)
    order_kind = np.uint16 if len(pivots) <= 65_536 else np.uint32

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1), batch.column(2))
            order = pivot_orders(x.astype(np.float32), shared.value, prefix)
            scale = np.abs(x).max(axis=1) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            error = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-6
            own = order[:, :lists]
            offsets = pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(own.ravel().astype(np.int32))), _binary(order.astype(order_kind)),
                 pa.array(scale.astype(np.float32)), _binary(code), pa.array(error.astype(np.float32))],
                names=["_row", "lists", "order", "scale", "code", "error"])

    schema = "_row bigint, lists array<int>, order binary, scale float, code binary, error float"
    return units.select("_row", "vec", "norm").mapInArrow(sign, schema)


def _groups(signed: DataFrame, entries: int, posting: int) -> tuple[DataFrame, int]:
    """``(pivot, parts)`` of postings that are cut into parts, and the number of groups for all others."""
    sizes = signed.select(F.explode("lists").alias("pivot")).groupBy("pivot").count().filter(F.col("count") > posting)
    # at most entries / posting rows, and no more than there are pivots
    return cut(sizes.select("pivot", F.ceil(F.col("count") / F.lit(posting)).cast("int").alias("parts"))), max(1, -(-entries // GROUP))


def _grouped(posted: DataFrame, bins: int) -> Column:
    """Long postings are groups of their own, short ones share one by number."""
    return F.when(F.col("parts") > 1, F.col("pivot") + F.lit(bins)).otherwise(F.pmod(F.col("pivot"), F.lit(bins)))


def _local(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivot numbers as they occur here, from 0."""
    found, inverse = np.unique(order, return_inverse=True)
    return found, inverse.reshape(order.shape)


def closeness(order: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sum of minima of place weights for every row of ``order`` with every row of ``other``.

    ``other`` may see more places; its weights are then stretched over them.
    """
    prefix, wide = order.shape[1], other.shape[1]
    weight = (prefix - np.arange(prefix)).astype(np.uint8)
    stretched = np.ceil((wide - np.arange(wide)) * (prefix / wide)).astype(np.uint8)
    _, inside = _local(np.concatenate([order.ravel(), other.ravel()]))
    mine, theirs = inside[: order.size].reshape(order.shape), inside[order.size :].reshape(other.shape)
    table = np.zeros((int(inside.max()) + 1, len(other)), np.uint8)
    table[theirs, np.arange(len(other))[:, None]] = stretched
    out = np.empty((len(order), len(other)), np.uint16)
    step = max(1, 2_000_000 // (prefix * len(other)))
    for s in range(0, len(order), step):
        shared = table[mine[s : s + step].ravel()].reshape(-1, prefix, len(other))
        np.minimum(shared, weight[None, :, None], out=shared)
        out[s : s + step] = shared.sum(axis=1, dtype=np.uint16)
    return out


class _Entries:
    """Posting entries of one group as arrays, by pivot."""

    def __init__(self, t: pa.Table, order_kind: type):
        by = np.argsort(t.column("pivot").to_numpy(), kind="stable")
        t = t.take(pa.array(by)).combine_chunks()
        self.pivot, self.row = t.column("pivot").to_numpy(), t.column("_row").to_numpy()
        self.order = _from_binary(t.column("order"), order_kind).astype(np.int64)
        self.vec = _from_binary(t.column("code"), np.int8).astype(np.float32) * t.column("scale").to_numpy()[:, None]
        self.error = t.column("error").to_numpy().astype(np.float32)
        self.part = t.column("part").to_numpy()

    def postings(self) -> Iterator[tuple[int, int]]:
        edges = np.flatnonzero(np.concatenate([[True], self.pivot[1:] != self.pivot[:-1], [True]]))
        yield from zip(edges[:-1], edges[1:], strict=True)


# close pairs ----------------------------------------------------------------------------

def close_pairs(
    units: DataFrame, item: str, min_cosine: float, *, lists: int = 6, prefix: int = 16, min_share: float = 0.25, posting: int = POSTING,
) -> DataFrame:
    """Pairs ``item_a < item_b`` of vectors with at least ``min_cosine``: ``(item_a, item_b, cosine)``.

    ``units`` comes from :func:`usable_vectors`. Candidates share one of their first
    ``lists`` pivots, their closeness is at least ``min_share`` of that of equal orders, and
    their rounded vectors leave the cosine possible; the exact cosine decides. Every
    vector is indexed. ``lists`` and ``min_share`` suit cosines of 0.95 and more, where
    0.998 of pairs at exactly 0.95 are candidates (measured, random directions, 94,000
    vectors) and nearly all closer ones; lower cosines need more lists.
    :func:`close_pairs_exhaustive` finds all pairs whatever the cosine.

    Pivots are spread out, so vectors of a dense cluster share theirs, equal vectors
    have equal orders, and a posting crowded by such a cluster is compared whole: its
    parts of about ``posting`` entries meet two by two in groups of their own. Nothing is capped.
    """
    units = cut(units.withColumn("_row", F.monotonically_increasing_id()))
    n = units.count()
    kind = units.schema[item].dataType.simpleString()
    if n < 2:
        return units.sparkSession.createDataFrame([], f"item_a {kind}, item_b {kind}, cosine double")
    pivots = choose_pivots(units, item, pivot_count(n))
    prefix = min(prefix, len(pivots))
    signed = cut(signatures(units, pivots, prefix, lists))
    long, bins = _groups(signed, n * min(lists, prefix), posting)
    posted = signed.select("_row", "order", "scale", "code", "error", F.explode("lists").alias("pivot")).join(F.broadcast(long), "pivot", "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("_row"), F.col("parts"))).otherwise(0).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    posted = posted.withColumn("part", part).withColumn("other", other).withColumn("group", _grouped(posted, bins))
    posted = posted.withColumn("bi", F.least("part", "other")).withColumn("bj", F.greatest("part", "other")).drop("parts", "other")
    least = math.ceil(min_share * prefix * (prefix + 1) / 2)
    order_kind = np.uint16 if len(pivots) <= 65_536 else np.uint32

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        e = _Entries(t.drop_columns(["bi", "bj"]), order_kind)
        for start, end in e.postings():
            own = np.arange(start, end)
            left, right = (own[e.part[own] == bi], own[e.part[own] == bj]) if bi != bj else (own, own)
            for s in range(0, len(left), 500):
                a, b = left[s : s + 500], right if bi != bj else right[s:]
                if not len(b):
                    continue
                possible = e.vec[a] @ e.vec[b].T >= min_cosine - (e.error[a][:, None] + e.error[b]) * 1.01 - 1e-5
                if bi == bj:
                    possible &= np.arange(len(a))[:, None] < np.arange(len(b))
                rows = np.flatnonzero(possible.any(axis=1))
                if not len(rows):
                    continue
                i, j = np.nonzero((closeness(e.order[a[rows]], e.order[b]) >= least) & possible[rows])
                x, y = e.row[a[rows[i]]], e.row[b[j]]
                for k in range(0, len(x), 100_000):
                    p, q = x[k : k + 100_000], y[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    found = cut(posted.groupBy("group", "bi", "bj").applyInArrow(compare, "a bigint, b bigint").distinct())
    a, b = _picked(found, units, item)
    pairs = found.join(a, "a").join(b, "b").withColumn("cosine", _cosine("_va", "_na", "_vb", "_nb")).filter(F.col("cosine") >= min_cosine)
    return pairs.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "cosine")


def _picked(found: DataFrame, units: DataFrame, item: str) -> list[DataFrame]:
    """Items and vectors of the rows on either side of candidate pairs."""
    few = found.count() <= MAX_PICKED
    sides = []
    for side in ("a", "b"):
        rows = units.select(F.col("_row").alias(side), F.col(item).alias(f"item_{side}"), F.col("vec").alias(f"_v{side}"), F.col("norm").alias(f"_n{side}"))
        # few rows out of many are picked where they are read
        sides.append(rows.join(F.broadcast(found.select(side).distinct()), side, "left_semi") if few else rows)
    return sides


def _cosine(va: str, na: str, vb: str, nb: str) -> Column:
    parts = F.zip_with(va, vb, lambda x, y: (x / F.col(na)) * (y / F.col(nb)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def close_pairs_exhaustive(units: DataFrame, item: str, min_cosine: float, *, chunk: int = CHUNK) -> DataFrame:
    """The result of :func:`close_pairs` without the index, exact for any cosine: what recall is measured against.

    A hash cuts the vectors into blocks of about ``chunk``, and every two blocks
    meet in a task, so the work grows with the square of the collection. Products in
    single precision, with room for their rounding, leave few pairs for the exact cosine.
    """
    units = cut(units)
    n = units.count()
    kind = units.schema[item].dataType.simpleString()
    if n < 2:
        return units.sparkSession.createDataFrame([], f"item_a {kind}, item_b {kind}, cosine double")
    blocks = -(-n // chunk)
    rows = units.withColumn("_own", F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(item, "vec", "norm", "_own", F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        ids, own = t.column(item), t.column("_own").to_numpy()
        x = _unit(t.column("vec").combine_chunks(), t.column("norm"))
        low = x.astype(np.float32)
        least = min_cosine - 1.2e-7 * (x.shape[1] + 4)
        one = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        a = np.flatnonzero(own == t.column("bi")[0].as_py())
        b = a if one else np.flatnonzero(own == t.column("bj")[0].as_py())
        right = low[b]
        for s in range(0, len(a), 500):
            # within one block only later rows
            start = s if one else 0
            i, j = np.nonzero(low[a[s : s + 500]] @ right[start:].T >= least)
            i, j = a[s + i], b[start + j]
            if one:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                cosine = np.einsum("ij,ij->i", x[p], x[q])
                ok = cosine >= min_cosine
                p, q = (ids.take(pa.array(r[ok])).combine_chunks() for r in (p, q))
                yield pa.RecordBatch.from_arrays([p, q, pa.array(cosine[ok])], names=["x", "y", "cosine"])

    found = rows.groupBy("bi", "bj").applyInArrow(compare, f"x {kind}, y {kind}, cosine double")
    return found.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "cosine")


# nearest neighbours ---------------------------------------------------------------------

def nearest(
    queries: DataFrame, units: DataFrame, item: str, k: int, *, lists: int = 4, prefix: int = 16, probes: int = 128, keep: float = 0.6,
    posting: int = POSTING, exhaustive: bool = False,
) -> DataFrame:
    """The ``k`` most similar other vectors for every query item.

    ``queries`` holds one column of items that are also in ``units``. Result:
    ``query, neighbour, cosine, rank``, ties by neighbour. Every row is posted under
    its first ``lists`` pivots, and a query reads the postings of its first
    ``probes``: only the queries are copied that often, and no query meets the
    whole collection. In a posting the ``keep`` part with the smallest footrule
    distance (and ``4 k`` at least) goes on; rounded vectors, with their error
    allowed for, leave little more than ``k`` for the exact cosine. Long postings are read in
    parts, by a copy of the query for each. With ``exhaustive`` every posting
    is read and nothing left out, which gives the exact neighbours at the price of a scan per query.

    Measured recall is in the README; more ``probes`` raise it.
    """
    units = cut(units.withColumn("_row", F.monotonically_increasing_id()))
    kind = units.schema[item].dataType.simpleString()
    n = units.count()
    if n < 2:
        return units.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double, rank int")
    pivots = choose_pivots(units, item, pivot_count(n))
    count = len(pivots)
    lists, probes = (1, count) if exhaustive else (min(lists, count), min(probes, count))
    prefix = min(prefix, count)
    signed = cut(signatures(units, pivots, prefix, lists))
    long, bins = _groups(signed, n * lists, posting)
    rows = signed.select("_row", "order", "scale", "code", "error", F.explode("lists").alias("pivot")).join(F.broadcast(long), "pivot", "left")
    rows = rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("_row"), F.col("parts"))).otherwise(0).cast("int"))
    asked = units.join(queries.select(F.col(item)).distinct(), item, "left_semi")
    asked = signatures(asked, pivots, probes, probes).withColumn("pivot", F.explode("lists")).drop("lists")
    asked = asked.join(F.broadcast(long), "pivot", "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    columns = ["_row", "order", "scale", "code", "error", "pivot", "part"]
    rows, asked = (d.withColumn("group", _grouped(d, bins)).select("group", *columns) for d in (rows, asked))
    order_kind = np.uint16 if count <= 65_536 else np.uint32

    names = ["a", "b", "low", "high"]
    nothing = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float32(), pa.float32())], names=names)

    def answer(r: pa.Table, q: pa.Table) -> pa.Table:
        if not r.num_rows or not q.num_rows:
            return nothing
        r, q = _Entries(r, order_kind), _Entries(q, order_kind)
        starts = {int(q.pivot[s]): (s, e) for s, e in q.postings()}
        found: list[tuple[np.ndarray, ...]] = []
        for s, e in r.postings():
            if int(r.pivot[s]) not in starts:
                continue
            first, last = starts[int(r.pivot[s])]
            for f in range(first, last, 200):
                a = np.arange(f, min(f + 200, last))
                size = e - s if exhaustive else min(e - s, max(4 * k, math.ceil(keep * (e - s))))
                near = closeness(r.order[s:e], q.order[a]).T
                cosine = q.vec[a] @ r.vec[s:e].T
                error = (q.error[a][:, None] + r.error[s:e]) * 1.01 + 1e-5
                if size < e - s:
                    limit = np.partition(near, e - s - size, axis=1)[:, e - s - size, None]
                    cosine[near < limit] = -4.0
                cosine[q.row[a][:, None] == r.row[s:e]] = -4.0
                low = cosine - error
                worst = np.partition(low, -k, axis=1)[:, -k, None] if k < e - s else np.full((len(a), 1), -4.0, np.float32)
                i, j = np.nonzero((cosine + error >= worst) & (cosine > -3.0))
                found.append((q.row[a[i]], r.row[s + j], cosine[i, j], error[i, j]))
        if not found:
            return nothing
        x, y, cosine, error = (np.concatenate(c) for c in zip(*found, strict=True))
        # a row met in several postings counts once; of a query's rows only possible neighbours go on
        by = np.lexsort((y, x))
        by = by[np.concatenate([[True], (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])])]
        x, y, cosine, error = x[by], y[by], cosine[by], error[by]
        by = np.lexsort((error - cosine, x))
        edge = np.flatnonzero(np.concatenate([[True], x[by][1:] != x[by][:-1]]))
        size = np.diff(np.append(edge, len(by)))
        worst = np.where(size >= k, (cosine - error)[by[np.minimum(edge + k - 1, len(by) - 1)]], -4.0)
        by = by[(cosine + error)[by] >= np.repeat(worst, size)]
        bounds = [pa.array(c[by].astype(np.float32)) for c in (cosine - error, cosine + error)]
        return pa.table([pa.array(x[by]), pa.array(y[by]), *bounds], names=names)

    parts = rows.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInArrow(answer, "a bigint, b bigint, low float, high float")
    parts = parts.groupBy("a", "b").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    by_low = Window.partitionBy("a").orderBy(F.desc("low"), "b")
    worst = F.min(F.when(F.col("_at") == k, F.col("low"))).over(Window.partitionBy("a"))
    some = parts.withColumn("_at", F.row_number().over(by_low)).withColumn("_worst", worst).filter(F.col("_worst").isNull() | (F.col("high") >= F.col("_worst")))
    some = cut(some.select("a", "b"))
    a, b = _picked(some, units, item)
    exact = some.join(a, "a").join(b, "b")
    exact = exact.select(F.col("item_a").alias("query"), F.col("item_b").alias("neighbour"), _cosine("_va", "_na", "_vb", "_nb").alias("cosine"))
    by_cosine = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return exact.withColumn("rank", F.row_number().over(by_cosine)).filter(F.col("rank") <= k)
