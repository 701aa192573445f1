"""Filling fixed-capacity containers by multiway number differencing (problem 8)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.cut import cut

#: Windows that one block of items fills, about.
WINDOWS_PER_BLOCK = 512
#: Most kinds of containers: each packs all items anew.
MAX_KINDS = 1_000


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Window of every item and the largest window sum, by Karmarkar-Karp differencing.

    A partial partition is a list of ``windows`` sums. The two partitions with the
    largest imbalance (largest minus smallest sum) are merged so that the large sums of
    one meet the small sums of the other, until one is left. Every item starts as a
    partition of its own. As items come largest first, a partition of single items
    in a row merges with the next item by taking it into an empty window, and any
    other with a single item by adding that to its smallest sum.
    """
    n, k = len(sizes), windows
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64), int(sizes.sum())
    order = np.argsort(-sizes, kind="stable")
    item, size = order.tolist(), sizes[order].tolist()
    merges: list[tuple[int, int]] = []  # the two nodes below node n, n + 1, ...

    def node(a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        merges.append((a, b))
        return n + len(merges) - 1

    def spread(p: tuple) -> tuple[list[int], list[int]]:
        """Sums, rising, and their nodes (-1: none)."""
        if p[3] is not None:
            return p[3], p[4]
        empty = k - (p[2] - p[1])
        return [0] * empty + size[p[1] : p[2]][::-1], [-1] * empty + item[p[1] : p[2]][::-1]

    def run(start: int, end: int) -> tuple:
        return (-(size[start] - (size[end - 1] if end - start == k else 0)), start, end, None, None)

    heap = [run(0, min(k, n)), *(run(i, i + 1) for i in range(k, n))]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        p, q = heapq.heappop(heap), heap[0]
        if p[3] is None and q[3] is None and p[2] == q[1] and q[2] - p[1] <= k:
            heapq.heapreplace(heap, run(p[1], q[2]))
            continue
        if p[3] is None and p[2] - p[1] == 1:
            p, q = q, p
        s, m = spread(p)
        if q[3] is None and q[2] - q[1] == 1:
            total, joined = s[0] + size[q[1]], node(m[0], item[q[1]])
            at = bisect_left(s, total, 1)
            s[: at - 1], m[: at - 1] = s[1:at], m[1:at]
            s[at - 1], m[at - 1] = total, joined
        else:
            other, nodes = spread(q)
            both = [(a + b, node(x, y)) for a, b, x, y in zip(s, reversed(other), m, reversed(nodes), strict=True)]
            both.sort()
            s, m = map(list, zip(*both, strict=True))
        heapq.heapreplace(heap, (s[0] - s[-1], tick, tick, s, m))
        tick += 1
    s, m = spread(heap[0])
    label = [-1] * (n + len(merges))
    for window, x in enumerate(reversed(m)):  # the fullest is 0
        if x >= 0:
            label[x] = window
    for x in range(len(merges) - 1, -1, -1):
        a, b = merges[x]
        label[a] = label[b] = label[n + x]
    return np.array(label[:n], np.int64), s[-1]


def fewest_windows(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: total size, and items of which no two fit together."""
    large = int((2 * sizes > capacity).sum())
    half = sizes[2 * sizes > capacity]
    rest = int(sizes[2 * sizes <= capacity].sum()) - int((capacity - half).sum())
    return max(math.ceil(int(sizes.sum()) / capacity), large + max(0, math.ceil(rest / capacity)), 1)


def pack_block(sizes: np.ndarray, capacity: int, slack: float = 0.01, widest: float = 0.08) -> np.ndarray:
    """Window of every item (sizes 1 to ``capacity``); no window above ``capacity``.

    Differencing starts at the lower bound of windows. While its largest window is
    above the capacity, the windows that are full but not too full - within ``slack``
    of the capacity, which widens up to ``widest`` while there are none, then the
    fullest that fits - are sealed and the items of all others are differenced
    again with a new bound. So the window count rises only by what the rest cannot
    fill. Every round seals at least one window or, where nothing fits, raises the
    count to one window per item at most, so the search ends.
    """
    out, made = np.full(len(sizes), -1, np.int64), 0
    left = np.arange(len(sizes))
    more = 0
    while len(left):
        part = sizes[left]
        k = min(fewest_windows(part, capacity) + more, len(left))
        label, most = difference(part, k)
        if most <= capacity:
            out[left] = made + label
            break
        sums = np.bincount(label, weights=part, minlength=k).astype(np.int64)
        fits = (sums <= capacity) & (sums > 0)
        while slack < widest and not (fits & (sums >= capacity * (1 - slack))).any():
            slack *= 2
        seal = fits & (sums >= capacity * (1 - slack))
        if not seal.any():
            seal = fits & (sums == sums[fits].max(initial=0))
        if not seal.any():
            more = 2 * more + 1
            continue
        more = 0
        number = np.cumsum(seal) - 1 + made
        inside = seal[label]
        out[left[inside]] = number[label[inside]]
        left, made = left[~inside], made + int(seal.sum())
    return out


def fill_containers(
    items: DataFrame, item: str, size: str, containers: DataFrame, name: str, capacity: str, *, windows_per_block: int = WINDOWS_PER_BLOCK
) -> DataFrame:
    """A container for every item, for every capacity.

    Result: ``container_name, capacity, item, piece_no, piece_size, container_id,
    container_fill``. An item larger than the capacity is cut into full pieces, each
    a container of its own, and a rest that is packed like an item. Items of size 0
    or NULL keep one row of size 0 without a container. Containers without name or
    with a capacity below 1 are ignored; NULL items are left out; repeated items are
    packed each (tell them apart by ``item``). More than ``MAX_KINDS`` kinds are refused.

    Items fall into blocks by a hash, as many as make about ``windows_per_block``
    windows each; a block is packed by itself, so no task ever holds more than that,
    and the room lost at block ends is about half a window per block.
    """
    items = cut(items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")).filter(F.col("item").isNotNull()))
    kinds = containers.select(F.col(name).alias("container_name"), F.col(capacity).cast("bigint").alias("capacity")).filter(
        F.col("container_name").isNotNull() & (F.col("capacity") > 0)).distinct()
    listed = [r.asDict() for r in kinds.orderBy("container_name", "capacity").limit(MAX_KINDS + 1).collect()]
    if len(listed) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers: every item would be packed for each of them")
    # blocks are as many as what is left beside full pieces fills
    capacities = sorted({k["capacity"] for k in listed})
    rests = items.agg(*[F.coalesce(F.sum(F.col("size") % c), F.lit(0)).alias(str(c)) for c in capacities]).first() if listed else {}
    made = [
        F.struct(F.lit(k["container_name"]).alias("container_name"), F.lit(k["capacity"]).cast("bigint").alias("capacity"),
                 F.lit(max(1, -(-rests[str(k["capacity"])] // (k["capacity"] * windows_per_block)))).cast("bigint").alias("blocks"))
        for k in listed
    ]
    every = F.array(*made).cast("array<struct<container_name:string,capacity:bigint,blocks:bigint>>")
    each = items.select("*", F.explode(every).alias("_kind")).select("*", "_kind.*").drop("_kind")
    key = ["container_name", "capacity", "item"]
    sized = each.withColumn("_full", F.floor(F.col("size") / F.col("capacity"))).withColumn("_rest", F.col("size") % F.col("capacity"))
    full = sized.filter("_full > 0").select(*key, F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)).alias("piece_no"),
                                            F.col("capacity").alias("piece_size"))
    full = full.withColumn("container_id", F.concat_ws("-", "container_name", F.lit("item"), F.col("item").cast("string"), F.col("piece_no").cast("string")))
    full = full.withColumn("container_fill", F.col("capacity"))
    none = sized.filter("size = 0").select(*key, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("piece_size"),
                                            F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("bigint").alias("container_fill"))
    rest = sized.filter("_rest > 0").withColumn("_block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    rest = rest.select(*key, F.col("_full").cast("int").alias("piece_no"), F.col("_rest").alias("piece_size"), "_block")
    kind = items.schema["item"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_size", "item"], ascending=[False, True], kind="stable")
        window = pack_block(pdf["piece_size"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        fill = np.bincount(window, weights=pdf["piece_size"]).astype(np.int64)
        head = f"{pdf['container_name'].iloc[0]}-{pdf['_block'].iloc[0]}-"
        out = pdf.drop(columns="_block")
        return out.assign(container_id=[head + str(w) for w in window], container_fill=fill[window])

    packed = rest.groupBy("container_name", "capacity", "_block").applyInPandas(
        pack, f"container_name string, capacity bigint, item {kind}, piece_no int, piece_size bigint, container_id string, container_fill bigint")
    columns = [*key, "piece_no", "piece_size", "container_id", "container_fill"]
    out = packed.select(columns).unionByName(full.select(columns)).unionByName(none.select(columns))
    return out.withColumnRenamed("item", item)
