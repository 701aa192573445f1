"""Items that appear together: a blocked Gram matrix of baskets (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.cut import cut
from quillrank.operators.skew import join_key_stats

#: A task merges equal entries of its products, and passes them on, at about this many.
BLOCK_ENTRIES = 1_000_000
#: Entries of products that are added up in one task, at most, before equal ones are merged.
TILE_ENTRIES = 1_500_000
#: Dictionaries of up to this many items (and 32 bytes an item) are broadcast to the tasks.
MAX_DICTIONARY = 500_000


def gram_block(
    items: np.ndarray, sizes: np.ndarray, support: np.ndarray | None, ratio: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strict upper triangle of ``X' X`` for the binary sparse block ``X`` of some baskets.

    ``items`` holds the baskets' distinct item numbers one after another, ``sizes``
    their lengths. Baskets of one length form a dense index block, whose transposed
    product is one triangular gather; equal entries are summed on the way. Entries
    are left out where the smaller support is under ``ratio`` of the larger. The
    product comes in pieces of bounded size, whose sum it is.
    """
    codes, inverse = np.unique(items, return_inverse=True)
    weight = None
    if support is not None and ratio > 0:
        weight = np.empty(len(codes), np.float64)
        weight[inverse] = support
    m = np.int64(len(codes))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c[order], first)

    for n in np.unique(sizes):
        if n < 2:
            continue
        i, j = np.triu_indices(n, 1)
        at = starts[sizes == n]
        step = max(1, BLOCK_ENTRIES // len(i))
        for s in range(0, len(at), step):
            block = np.sort(inverse[at[s : s + step, None] + np.arange(n)], axis=1)
            a, b = block[:, i].ravel(), block[:, j].ravel()
            if weight is not None:
                wa, wb = weight[a], weight[b]
                ok = np.minimum(wa, wb) >= ratio * np.maximum(wa, wb) - 1e-9
                a, b = a[ok], b[ok]
            k, c = np.unique(a * m + b, return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 2 * BLOCK_ENTRIES:
                k, c = merged()
                if len(k) > BLOCK_ENTRIES:
                    yield codes[k // m], codes[k % m], c
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
    if held:
        k, c = merged()
        yield codes[k // m], codes[k % m], c


class _Blocks:
    """Gathers baskets to record blocks and multiplies each with its transpose."""

    def __init__(self, record_block: int, ratio: float):
        self.record_block, self.ratio = record_block, ratio
        self.items: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.support: list[np.ndarray] = []
        self.held = 0

    def add(self, items: np.ndarray, sizes: np.ndarray, support: np.ndarray) -> bool:
        """Whether the block is full."""
        self.items.append(items)
        self.sizes.append(sizes)
        self.support.append(support)
        self.held += len(items)
        return self.held >= self.record_block

    def product(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = [np.concatenate(x) for x in (self.items, self.sizes, self.support)]
        self.__init__(self.record_block, self.ratio)
        yield from gram_block(parts[0], parts[1], parts[2].astype(np.float64), self.ratio)


def _packed(numbers: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers, compressed: bytes of equal weight stand together, as most of the high ones are 0."""
    raw = np.ascontiguousarray(np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _tile(k: np.ndarray, tiles: int) -> np.ndarray:
    """The bucket of an entry: that of its tile of the product, one row by 4,096 columns."""
    h = ((k >> 32) * np.int64(0x100000) + ((k & 0xFFFFFFFF) >> 12)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(tiles)).astype(np.int64)


def _in_tiles(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tiles: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a product, cut by bucket and packed: one row for each bucket, not one for each entry."""
    for a, b, n in pieces:
        k = (a << 32) | b
        tile = _tile(k, tiles)
        by = np.lexsort((k, tile))
        k, n, tile = k[by], n[by], tile[by]
        edges = np.flatnonzero(np.diff(tile, prepend=-1, append=tiles))
        rows = [(int(tile[s]), *_packed(np.diff(k[s:e], prepend=0)), *_packed(n[s:e])) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tile", "k", "k_size", "n", "n_size"])


def _summed(products: DataFrame, min_count: int) -> DataFrame:
    """Entries of at least ``min_count`` after the packed pieces of each bucket are added up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            k, k_size, n, n_size = (batch.column(c).to_pylist() for c in ("k", "k_size", "n", "n_size"))
            keys += [np.cumsum(_unpacked(*x)) for x in zip(k, k_size, strict=True)]
            counts += [_unpacked(*x) for x in zip(n, n_size, strict=True)]
        k, n = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(k, kind="stable")
        k, n = k[by], n[by]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        n = np.add.reduceat(n, first)
        k = k[first][n >= min_count]
        n = n[n >= min_count]
        for s in range(0, len(k), 200_000):
            part = k[s : s + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part >> 32), pa.array(part & 0xFFFFFFFF), pa.array(n[s : s + 200_000])], names=["a", "b", "n_ab"])

    return products.groupBy("tile").applyInArrow(add, "a bigint, b bigint, n_ab bigint")


_TILES = "tile int, k binary, k_size bigint, n binary, n_size bigint"


def _products_by_dictionary(
    sets: DataFrame, support: DataFrame, ratio: float, record_block: int, tiles: int, min_count: int
) -> tuple[DataFrame, DataFrame]:
    """Summed products by item number, and ``(code, item, n_item)`` with these numbers.

    The baskets are multiplied where they are read.
    """
    spark = sets.sparkSession
    table = support.select("item", "n_item").toArrow().combine_chunks()
    numbered = table.append_column("code", pa.array(np.arange(len(table)), pa.int64()))
    values = table.column("item").combine_chunks() if len(table) else pa.array([], table.schema.field("item").type)
    shared = spark.sparkContext.broadcast((values, table.column("n_item").to_numpy() if len(table) else np.empty(0, np.int64)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = shared.value
        block = _Blocks(record_block, ratio)
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            codes = pc.index_in(lists.flatten(), value_set=values)
            there = codes.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[there]
            codes = codes.drop_null().to_numpy().astype(np.int64)
            if block.add(codes, np.bincount(owner, minlength=len(lists)), counts[codes]):
                yield from _in_tiles(block.product(), tiles)
        if block.held:
            yield from _in_tiles(block.product(), tiles)

    pairs = _summed(sets.select("_items").mapInArrow(products, _TILES), min_count)
    names = spark.createDataFrame(numbered) if len(table) else support.select("item", "n_item", "code").limit(0)
    return pairs, names


def _products_by_join(
    sets: DataFrame, support: DataFrame, total: float, ratio: float, record_block: int, min_count: int
) -> DataFrame:
    """The same for dictionaries of any size: numbers, of 64 bits, come by a join, baskets are put together again."""
    long = sets.select("_basket", F.explode("_items").alias("item"))
    coded = join_key_stats(long, support, "item", "n_item", total, spread=F.col("_basket"))
    rows = coded.groupBy("_basket").agg(F.collect_list(F.struct("code", "n_item")).alias("x")).filter(F.size("x") > 1)
    rows = rows.select(F.col("x.code").alias("code"), F.col("x.n_item").alias("n_item"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Blocks(record_block, ratio)
        for batch in batches:
            codes, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            if block.add(codes, np.diff(batch.column(0).offsets.to_numpy()), counts):
                for part in block.product():
                    yield from _sliced(list(part), ["a", "b", "n"])
        if block.held:
            for part in block.product():
                yield from _sliced(list(part), ["a", "b", "n"])

    summed = rows.mapInArrow(products, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    return summed.filter(F.col("n_ab") >= min_count)


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(columns[0]), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 200_000].astype(np.int64)) for c in columns], names=names)


def together(
    baskets: DataFrame, items: str, *,
    min_count: int = 1, min_lift: float = 0.0, min_jaccard: float = 0.0, record_block: int = 200_000,
    dictionary: int = MAX_DICTIONARY,
) -> DataFrame:
    """Pairs of items with the number of baskets that hold both, against chance.

    ``baskets`` has one row per basket; NULL items and repeats within a basket do
    not count, baskets without items are not baskets, and NULL lists are empty.
    Result, ``item_a < item_b``: ``n_ab, n_a, n_b, n_baskets, lift, jaccard`` where
    ``lift = n_ab * n / (n_a * n_b)`` compares with independent items.

    1. Supports ``n_a`` by a map-side combined count.
    2. Items get numbers: where their dictionary is small, which is checked, inside
       the tasks that read the baskets, else by a join that is safe for hot items.
       Items that cannot reach the thresholds are dropped first, exactly: a pair
       has ``n_ab <= min(n_a, n_b)``, hence needs supports of at least
       ``min_count`` and at most ``n / min_lift``, and a support ratio of at least
       ``min_jaccard``.
    3. Each task multiplies blocks of about ``record_block`` entries with their
       transpose and sums equal entries before anything is shuffled, so a pair of
       frequent items leaves a block as one number.
    4. The partial products are shuffled as packed tiles, a row for each bucket of
       tiles, added up by pair and normalised by the marginals. Buckets are as many as
       keep one within a task whatever the input.

    A basket's list is a row of the input; no list ever gathers more than that.
    Sums are exact whatever the order of blocks.
    """
    held = F.array_distinct(F.filter(items, lambda x: x.isNotNull()))
    sets = baskets.select(held.alias("_items")).filter(F.size("_items") > 0)
    sets = cut(sets.withColumn("_basket", F.monotonically_increasing_id()))
    size = F.size("_items").cast("bigint")
    n, entries = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0))).first()
    support = sets.select(F.explode("_items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    support = support.filter(F.col("n_item") >= min_count)
    if min_lift > 0:
        support = support.filter(F.col("n_item") * F.lit(float(min_lift)) <= F.lit(float(n)) + 1e-6)
    support = cut(support.withColumn("code", F.monotonically_increasing_id()))
    known = support.agg(F.count(F.lit(1)), F.sum("n_item"), F.sum(F.octet_length(F.col("item").cast("string")))).first()
    if known[0] <= dictionary and (known[2] or 0) <= 32 * dictionary:
        tiles = max(1, -(-int(entries) // TILE_ENTRIES))
        pairs, support = _products_by_dictionary(sets, support, min_jaccard, record_block, tiles, min_count)
        named_by = F.broadcast  # its size has just been checked
    else:
        pairs = _products_by_join(sets, support, float(known[1] or 0), min_jaccard, record_block, min_count)
        named_by = lambda df: df
    left = support.select(F.col("code").alias("a"), F.col("item").alias("_ia"), F.col("n_item").alias("_na"))
    right = support.select(F.col("code").alias("b"), F.col("item").alias("_ib"), F.col("n_item").alias("_nb"))
    named = pairs.join(named_by(left), "a").join(named_by(right), "b")
    swap = F.col("_ia") > F.col("_ib")
    out = named.select(
        F.when(swap, F.col("_ib")).otherwise(F.col("_ia")).alias("item_a"),
        F.when(swap, F.col("_ia")).otherwise(F.col("_ib")).alias("item_b"),
        "n_ab",
        F.when(swap, F.col("_nb")).otherwise(F.col("_na")).alias("n_a"),
        F.when(swap, F.col("_na")).otherwise(F.col("_nb")).alias("n_b"),
        F.lit(int(n)).cast("bigint").alias("n_baskets"),
    )
    out = out.filter(
        (F.col("n_ab") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
        & (F.col("n_ab") >= F.lit(float(min_jaccard)) * (F.col("n_a") + F.col("n_b") - F.col("n_ab")))
    )
    return out.select(
        "*",
        (F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"),
    )
