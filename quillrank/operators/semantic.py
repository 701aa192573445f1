"""Dense vectors: alignment, user vectors, pair scores, exact and approximate retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import EPS, divide, dot, l2_normalize, norm, sum_vectors
from quillrank.operators.best import FOUND, Best, Order, user_blocks
from quillrank.operators.cut import cut, stream


#: Cells of the approximate search (67 million articles); their centres are fitted on 8 articles for each, or 20,000.
MAX_CELLS = 16_384


def align_vectors(articles: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(article_id, unit, has_vector)`` for every catalogue article.

    Articles without a usable vector (missing, of another length, with a NULL or
    not finite number) get the zero vector and ``has_vector`` false. Of repeated ids
    the greatest vector is used.
    """
    v = F.col("vec")
    ok = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = vectors.filter(ok).groupBy("article_id").agg(F.max("vec").alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    joined = articles.select("article_id").join(good, "article_id", "left")
    unit = F.when(F.col("vec").isNull(), zero).otherwise(l2_normalize("vec"))
    return joined.select("article_id", unit.alias("unit"), F.coalesce(norm("vec") > 0, F.lit(False)).alias("has_vector"))


def user_vectors(clicks: DataFrame, units: DataFrame, dim: int, half_life: float | None = None) -> DataFrame:
    """``(user_id, split, unit)``: normalised mean of the units of a user's known clicks.

    With ``half_life`` a click's weight is ``0.5 ** (age / half_life)``, age counted
    from the newest known click. Zero vectors of known articles take part.
    """
    joined = clicks.join(units.select("article_id", "unit"), "article_id")
    if half_life is None:
        weighted = joined.withColumn("_w", F.lit(1.0))
    else:
        w = Window.partitionBy("user_id", "split").orderBy("age")
        weighted = joined.withColumn("_w", F.pow(F.lit(0.5), (F.row_number().over(w) - 1) / F.lit(float(half_life))))
    sums = sum_vectors(weighted, ["user_id", "split"], "unit", dim, F.col("_w"), [F.sum("_w").alias("_n")])
    mean = divide("total", F.col("_n"))
    return sums.select("user_id", "split", mean.alias("_m")).select("user_id", "split", l2_normalize("_m").alias("unit"))


def mean_pair_scores(pairs: DataFrame, users: DataFrame, units: DataFrame, name: str = "semantic") -> DataFrame:
    """Cosine of user and article for every pair, 0 where either is unknown."""
    u = users.select("user_id", "split", F.col("unit").alias("_u"))
    a = units.select("article_id", F.col("unit").alias("_a"))
    joined = pairs.join(a, "article_id", "left").join(u, ["user_id", "split"], "left")
    return joined.withColumn(name, F.coalesce(dot("_u", "_a"), F.lit(0.0))).drop("_u", "_a")


def topk_pair_scores(pairs: DataFrame, clicks: DataFrame, units: DataFrame, k: int = 5, name: str = "semantic") -> DataFrame:
    """Mean of a candidate's ``k`` largest cosines to the user's single clicks; 0 without any.

    The user's click units are packed to one short list (at most the click limit),
    so every pair is one row and similarities never become rows. A pair takes its
    article's one vector along to its user, and not the user's many to the article.
    """
    mine = clicks.join(units.select("article_id", "unit"), "article_id").groupBy("user_id", "split").agg(F.collect_list("unit").alias("_us"))
    a = units.select("article_id", F.col("unit").alias("_a"))
    joined = pairs.join(a, "article_id", "left").join(mine, ["user_id", "split"], "left")
    sims = F.sort_array(F.transform("_us", lambda u: dot(u, F.col("_a"))), asc=False)
    best = F.slice(sims, 1, k)
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    return joined.withColumn(name, F.when(F.size("_us") > 0, F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(0.0))).drop("_us", "_a")


def click_vectors(clicks: DataFrame, units: DataFrame) -> DataFrame:
    """As :func:`user_vectors` without weights, for ``units`` that are a table written by ``cut``.

    Only lists of article ids go to the users; their tasks read the vectors where they lie,
    so no vector is shuffled for each click.
    """
    lists = clicks.groupBy("user_id", "split").agg(F.collect_list("article_id").alias("ids"))
    files = units.inputFiles()

    def run(batches):
        for whole in batches:
            for s in range(0, len(whole), 5_000):
                part = whole.slice(s, 5_000)
                lengths = pc.list_value_length(part.column("ids")).to_numpy(zero_copy_only=False)
                asked = part.column("ids").flatten().dictionary_encode()
                which, vectors, known = asked.indices.to_numpy(zero_copy_only=False), None, np.zeros(len(asked.dictionary), bool)
                for docs in stream(files, ["article_id", "unit"], 20_000):
                    at = pc.index_in(docs.column("article_id"), value_set=asked.dictionary)
                    here = np.flatnonzero(at.is_valid())
                    if len(here):
                        m, at = _matrix(docs.column("unit")), at.drop_null().to_numpy(zero_copy_only=False)
                        vectors = np.zeros((len(known), m.shape[1])) if vectors is None else vectors
                        vectors[at], known[at] = m[here], True
                who, which = np.repeat(np.arange(len(part)), lengths)[known[which]], which[known[which]]
                if not len(who):
                    continue
                starts = np.flatnonzero(np.diff(who, prepend=-1))
                mean = np.add.reduceat(vectors[which], starts, axis=0) / np.diff(starts, append=len(who))[:, None]
                unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), EPS)
                names = part.select(["user_id", "split"]).take(pa.array(who[starts]))
                yield pa.RecordBatch.from_arrays([*names.columns, _vectors(unit)], ["user_id", "split", "unit"])

    return lists.mapInArrow(run, "user_id string, split string, unit array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _search(users: DataFrame, n_users: int, files: list[str], block_users: int, k: int, find) -> DataFrame:
    """Blocks of users, each in one task: ``find(unit vectors, Best)`` sees all articles of ``files``."""
    asks = users.select("user_id", "split", "unit").repartition(user_blocks(users.sparkSession, n_users, 1, block_users), "user_id", "split")

    def run(batches):
        order = None
        for whole in batches:
            for s in range(0, len(whole), block_users):
                part = whole.slice(s, block_users)
                x = _matrix(part.column("unit"))
                part, x = part.filter(pa.array(np.linalg.norm(x, axis=1) > EPS)), x[np.linalg.norm(x, axis=1) > EPS]
                if len(part):
                    order = order or Order(files)
                    best = Best(len(part), k)
                    find(x, best, order)
                    yield best.rows(part, order)

    return asks.mapInArrow(run, FOUND)


def retrieve_vectors(users: DataFrame, units: DataFrame, pool: DataFrame | None, k: int, *, block_articles: int = 20_000, block_users: int = 5_000, digits: int = 9) -> DataFrame:
    """Exact best ``k`` articles by inner product: ``(user_id, split, article_id, score, rank)``.

    Blocks of users meet all articles block by block, read from one shared copy, so neither
    is repeated in a shuffle and only ``k`` rows per user leave a task. Products are made in
    single precision first; those that its error bound leaves a chance are made again in double.
    Articles without vector and users with a zero vector take no part; ties by id.
    Without ``pool``, ``users`` and ``units`` are tables written by ``cut``, the latter :func:`searchable`.
    """
    items = units if pool is None else cut(searchable(units, pool))
    asks = users if pool is None else cut(users)
    files = items.inputFiles()

    def find(x: np.ndarray, best: Best, order: Order) -> None:
        single, length, done = x.astype(np.float32), np.linalg.norm(x, axis=1), 0
        for docs in stream(files, ["article_id", "unit"], block_articles):
            m, code = _matrix(docs.column("unit")), order.codes(done, len(docs))
            done += len(docs)
            error = (x.shape[1] + 4) * 2.0**-23 * length * np.linalg.norm(m, axis=1).max() + 10.0**-digits
            for a in range(0, len(m), 2_048):
                tile, other = m[a : a + 2_048], m[a : a + 2_048].astype(np.float32).T
                for u in range(0, len(x), 1_024):
                    at = slice(u, u + 1_024)
                    sims = single[at] @ other
                    i, j = best.chances(sims, at, error[at])
                    for s in range(0, len(i), 100_000):
                        p, q = i[s : s + 100_000], j[s : s + 100_000]
                        best.add(u + p, code[a + q], np.round(np.einsum("ij,ij->i", x[u + p], tile[q]), digits))

    return _search(asks, asks.count(), files, block_users, k, find)


def searchable(units: DataFrame, pool: DataFrame) -> DataFrame:
    """``(article_id, unit, has_vector)`` of the pool's articles that have a vector."""
    return units.filter("has_vector").join(pool.select("article_id"), "article_id", "left_semi").select("article_id", "unit", "has_vector")


def fit_cells(units: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 13, n: int | None = None) -> np.ndarray:
    """Centres of a spherical k-means on a bounded, hash-chosen sample of unit vectors.

    With their number ``n``, vectors far beyond the sample's last hash are left out before the sort.
    """
    units = units.filter("has_vector")
    if n and 2 * sample + 1_000 < n:
        units = units.filter(F.md5("article_id") < f"{(2 * sample + 1_000) * 2**32 // n:08x}")
    rows = units.orderBy(F.md5("article_id"), "article_id").limit(sample).select("unit").toArrow().column(0).combine_chunks()
    if not len(rows):
        return np.zeros((1, 1))
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[s : s + 2_000] @ centres.T, axis=1) for s in range(0, len(x), 2_000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > EPS, sums / np.maximum(size, EPS), centres)
    return centres


def nearest_cells(unit: str, centres: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` centres nearest to a unit vector, as an Arrow-batched function."""
    @F.pandas_udf("array<int>")
    def cells(units: pd.Series) -> pd.Series:
        x = np.stack(units.to_numpy())
        if n == 1:
            return pd.Series(list(np.argmax(x @ centres.T, axis=1)[:, None].astype(np.int32)))
        return pd.Series(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells(unit)


def retrieve_approximate(users: DataFrame, units: DataFrame, pool: DataFrame | None, k: int, *, cells: int | None = None, probe: int = 64, chunk: int = 20_000) -> DataFrame:
    """Best ``k`` articles among those in the ``probe`` cells nearest to the user.

    An inverted file: every article lies in one cell, cells are stored one after the other, and
    a block of users goes through them, ``chunk`` articles at a time; no user is sent to
    a cell. Cells are twice the root of the
    collection unless stated, ``MAX_CELLS`` at most, so a cell grows with the root as
    well. Same columns and use of ``pool`` as the exact search.
    """
    items = units if pool is None else cut(searchable(units, pool))
    asks = users if pool is None else cut(users)
    n_items = items.count()
    wanted = cells or min(MAX_CELLS, math.ceil(2 * math.sqrt(n_items)))
    centres = fit_cells(items, max(1, wanted), sample=max(20_000, 8 * wanted), n=n_items)
    if not n_items or not asks.limit(1).count():
        return retrieve_vectors(asks, items, None, k)
    placed = items.select("article_id", "unit", nearest_cells("unit", centres, 1)[0].alias("_cell"))
    files = cut(placed.repartition("_cell").sortWithinPartitions("_cell")).inputFiles()

    def find(x: np.ndarray, best: Best, order: Order) -> None:
        near = np.concatenate([np.argsort(-(x[s : s + 1_000] @ centres.T), axis=1, kind="stable")[:, :probe] for s in range(0, len(x), 1_000)])
        by = np.argsort(near, axis=None, kind="stable")
        edges, visitors, done = np.searchsorted(near.ravel()[by], np.arange(len(centres) + 1)), by // near.shape[1], 0
        for docs in stream(files, ["article_id", "unit", "_cell"], chunk):
            m, cell, code = _matrix(docs.column("unit")), docs.column("_cell").to_numpy(), order.codes(done, len(docs))
            done += len(docs)
            found = []
            runs = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for a, b in zip(runs[:-1], runs[1:], strict=True):
                who = visitors[edges[cell[a]] : edges[cell[a] + 1]]
                if len(who):
                    sims = x[who] @ m[a:b].T
                    i, j = best.chances(sims, who, 0.0)
                    found.append((who[i], code[a + j], sims[i, j]))
            if found:
                best.add(*map(np.concatenate, zip(*found, strict=True)))

    return _search(asks, asks.count(), files, 5_000, k, find)


def agreement(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Mean share of a user's exact results that the approximate search also has."""
    hit = approximate.select("user_id", "split", "article_id", F.lit(1).alias("_hit"))
    per_user = exact.join(hit, ["user_id", "split", "article_id"], "left").groupBy("user_id", "split").agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))
    return per_user.agg(F.count(F.lit(1)).alias("n_users"), F.avg("share").alias("agreement"))


def encode_texts(articles: DataFrame, load_encoder, dim: int) -> DataFrame:
    """``(article_id, vec)`` of ``title. abstract`` by a pluggable encoder.

    ``load_encoder()`` runs once per Python worker and returns a function from a list
    of texts to a matrix with ``dim`` columns.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))

    def run(batches):
        encode = load_encoder()
        for pdf in batches:
            yield pd.DataFrame({"article_id": pdf["article_id"], "vec": list(np.asarray(encode(pdf["_text"].tolist()), np.float32).reshape(len(pdf), dim))})

    return articles.select("article_id", text.alias("_text")).mapInPandas(run, "article_id string, vec array<float>")


def hashed_encoder(dim: int):
    """An encoder without a model: signed hashed words, to be used where no better one is at hand."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            h = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], np.int64)
            np.add.at(out[i], (h >> 1) % dim, np.where(h & 1, 1.0, -1.0))
        return out

    return encode


def cached_vectors(articles: DataFrame, load_encoder, dim: int, path: str, refresh: bool = False) -> DataFrame:
    """``(article_id, vec)`` from ``path`` where the stored ids are exactly the articles', else encoded and stored.

    Vectors belong to ids, not to places, so what has to agree is the set of ids: their
    number and an order-free checksum of them, which are stored beside the
    vectors. An encoder must be stored under a path of its own.
    """
    spark = articles.sparkSession
    ids = articles.select("article_id")
    mark = ids.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("article_id").cast("decimal(38,0)")).alias("sum"), F.lit(dim).alias("dim")).first()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/mark")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not refresh and files.exists(target) and tuple(spark.read.parquet(f"{path}/mark").select("n", "sum", "dim").first()) == tuple(mark):
        return spark.read.parquet(f"{path}/vectors")
    files.delete(target, True)  # the mark is the last to be written
    encode_texts(articles, load_encoder, dim).write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([mark], "n bigint, sum decimal(38,0), dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")
    return spark.read.parquet(f"{path}/vectors")
