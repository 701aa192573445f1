"""BM25: postings, queries, pair scores and retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.best import FOUND, Best, Order, user_blocks
from quillrank.operators.cut import cut, stream

K1, B = 1.2, 0.75
#: Scores that a task holds at once while it answers users from a block of articles (8 bytes each).
SCORES = 4_000_000
#: Products that a dense matrix makes in the time of one that is added by its place.
DENSE = 400


def document_frequencies(features: DataFrame) -> DataFrame:
    """``(term, df, idf)`` over all documents, empty ones included in their number."""
    n = features.agg(F.count(F.lit(1)).alias("_n"))
    df = features.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(n)).select("term", "df", idf.alias("idf"))


def postings(features: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(article_id, term, tf, weight)``: the document half of BM25."""
    mean = features.agg(F.avg(F.size("tokens")).alias("_avgdl"))
    long = features.select("article_id", F.size("tokens").alias("_dl"), F.explode("tokens").alias("term"))
    tf = long.groupBy("article_id", "term", "_dl").agg(F.count(F.lit(1)).alias("tf"))
    joined = tf.join(document_frequencies(features), "term").join(F.broadcast(mean))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))
    return joined.select("article_id", "term", "tf", weight.alias("weight"))


def query_terms(clicks: DataFrame, features: DataFrame) -> DataFrame:
    """``(user_id, split, term, qtf)`` of the users' recent clicks; unknown articles are skipped."""
    tokens = features.select("article_id", "tokens")
    long = clicks.join(tokens, "article_id").select("user_id", "split", F.explode("tokens").alias("term"))
    return long.groupBy("user_id", "split", "term").agg(F.count(F.lit(1)).alias("qtf"))


def score_pairs(pairs: DataFrame, queries: DataFrame, index: DataFrame, name: str = "bm25") -> DataFrame:
    """``pairs`` (``user_id, split, article_id``, distinct) with their score, 0 without a match."""
    hits = pairs.select("user_id", "split", "article_id").join(index.select("article_id", "term", "weight"), "article_id")
    hits = hits.join(queries, ["user_id", "split", "term"]).groupBy("user_id", "split", "article_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias(name))
    return pairs.join(hits, ["user_id", "split", "article_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def retrieve(
    queries: DataFrame, index: DataFrame, pool: DataFrame, k: int, *, block_articles: int = 20_000, block_users: int = 2_000, digits: int = 9
) -> DataFrame:
    """``(user_id, split, article_id, score, rank)``: the best ``k`` articles of the pool.

    Terms are numbered, queries and postings become one row per user and article, each stored
    once; see :func:`_answer`. Only positive scores are returned, ties by id. Weights must be positive, as BM25's are.
    """
    index = index.join(pool.select("article_id"), "article_id", "left_semi").select("article_id", "term", "weight")
    postings_ = cut(index.groupBy("article_id").agg(F.collect_list(F.struct("term", "weight")).alias("p")).select("article_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")))
    vocabulary = cut(postings_.select(F.explode("terms").alias("term")).distinct()).inputFiles()

    def number(batches):
        words = _column(vocabulary, "term")
        for docs in batches:
            lists = docs.column("terms")
            at = pc.index_in(lists.flatten(), value_set=words)
            yield pa.RecordBatch.from_arrays([docs.column("article_id"), _lists(lists, at), docs.column("weights")], ["article_id", "terms", "weights"])

    files = cut(postings_.mapInArrow(number, "article_id string, terms array<int>, weights array<double>")).inputFiles()
    asks = queries.groupBy("user_id", "split").agg(F.collect_list(F.struct("term", F.col("qtf").cast("double").alias("qtf"))).alias("p"))
    asks = cut(asks.select("user_id", "split", F.col("p.term").alias("terms"), F.col("p.qtf").alias("qtf")))

    def run(batches):
        words, order = None, None
        for whole in batches:
            words, order = words or _column(vocabulary, "term"), order or Order(files)
            for s in range(0, len(whole), block_users):
                part = whole.slice(s, block_users)
                term = pc.index_in(part.column("terms").flatten(), value_set=words)
                known = term.is_valid().to_numpy(zero_copy_only=False)
                who = np.repeat(np.arange(len(part)), _sizes(part.column("terms")))[known]
                yield _answer(part, who, term.drop_null().to_numpy(), part.column("qtf").flatten().to_numpy()[known], files, order, k, block_articles, digits)

    return asks.repartition(user_blocks(asks.sparkSession, asks.count(), 1, block_users), "user_id", "split").mapInArrow(run, FOUND)


def retrieve_clicked(
    clicks: DataFrame, features: DataFrame, pool: DataFrame, k: int, k1: float = K1, b: float = B, *, block_articles: int = 20_000, block_users: int = 2_000, digits: int = 9
) -> DataFrame:
    """``retrieve`` of ``query_terms(clicks, features)`` in ``postings(features, k1, b)`` without their long rows.

    Articles become lists of numbered terms, which are stored once; users bring
    only the ids of their clicks, and their tasks read the terms of these where they lie.
    """
    vocabulary = cut(document_frequencies(features).select("term", "idf")).inputFiles()
    mean = features.agg(F.avg(F.size("tokens"))).first()[0]
    flagged = features.select("article_id", "tokens").join(pool.select("article_id", F.lit(True).alias("wanted")).distinct(), "article_id", "left")

    def number(batches):
        words, idf = _column(vocabulary, "term"), _column(vocabulary, "idf").to_numpy()
        for docs in batches:
            long = _sizes(docs.column("tokens"))
            key = np.repeat(np.arange(len(docs)), long) * len(words) + pc.index_in(docs.column("tokens").flatten(), value_set=words).to_numpy(zero_copy_only=False)
            key, tf = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, max(1, len(words)))
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long[doc] / mean)) if len(key) else np.zeros(0)
            ends = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.astype(np.int32), tf.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([docs.column("article_id"), docs.column("wanted"), *lists], ["article_id", "wanted", "terms", "tf", "weights"])

    stored = cut(flagged.mapInArrow(number, "article_id string, wanted boolean, terms array<int>, tf array<int>, weights array<double>"))
    files = stored.inputFiles()
    asks = cut(clicks.groupBy("user_id", "split").agg(F.collect_list("article_id").alias("ids")))

    def run(batches):
        order = None
        for whole in batches:
            order = order or Order(files)
            for s in range(0, len(whole), block_users):
                part = whole.slice(s, block_users)
                asked = part.column("ids").flatten().dictionary_encode()
                which, who = asked.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(part)), _sizes(part.column("ids")))
                owner, terms, tfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for docs in stream(files, ["article_id", "terms", "tf"], block_articles):
                    at = pc.index_in(docs.column("article_id"), value_set=asked.dictionary)
                    docs, at = docs.filter(at.is_valid()), at.drop_null().to_numpy(zero_copy_only=False)
                    owner.append(np.repeat(at, _sizes(docs.column("terms"))))
                    terms.append(docs.column("terms").flatten().to_numpy())
                    tfs.append(docs.column("tf").flatten().to_numpy())
                owner, terms, tfs = map(np.concatenate, (owner, terms, tfs))
                by = np.argsort(owner, kind="stable")
                edges, terms, tfs = np.searchsorted(owner[by], np.arange(len(asked.dictionary) + 1)), terms[by], tfs[by]
                at, times = _ranges(edges[which], edges[which + 1])
                key, place = np.unique(np.repeat(who, times) * np.int64(2**32) + terms[at], return_inverse=True)
                qtf = np.bincount(place, tfs[at], len(key))
                yield _answer(part, key >> 32, key & (2**32 - 1), qtf, files, order, k, block_articles, digits)

    return asks.repartition(user_blocks(asks.sparkSession, asks.count(), 1, block_users), "user_id", "split").mapInArrow(run, FOUND)


def _column(files: list[str], name: str) -> pa.Array:
    return pa.chunked_array([b.column(0) for b in stream(files, [name], 100_000)] or [pa.array([], "string" if name == "term" else "float64")]).combine_chunks()


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_sizes(like))]).astype(np.int32)), values)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and each range's length."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64), n


def _answer(
    users: pa.RecordBatch, who: np.ndarray, term: np.ndarray, qtf: np.ndarray, files: list[str], order: Order, k: int, block_articles: int, digits: int
) -> pa.RecordBatch:
    """The best ``k`` articles of a block of users, whose queries are given as triples.

    Articles come piece by piece, those with the same most frequent term together. Terms that
    many of both sides share are one matrix product in single precision, the others are
    added posting by posting; scores within the error bound of the user's best are
    made again in double precision.
    """
    best = Best(len(users), k)
    terms, local = np.unique(term, return_inverse=True)
    ends, done, n_users = np.searchsorted(who, np.arange(len(users) + 1)), 0, min(len(users), 1_024)
    n_users = max(1, min(n_users, 16_000_000 // max(1, len(terms))))
    tile = max(1, SCORES // n_users)
    for docs in stream(files, ["article_id", "terms", "weights", *(["wanted"] if "wanted" in _names(files) else [])], block_articles):
        code = order.codes(done, len(docs))
        done += len(docs)
        long, all_terms, all_weights = _sizes(docs.column("terms")), docs.column("terms").flatten().to_numpy(), docs.column("weights").flatten().to_numpy()
        place = np.minimum(np.searchsorted(terms, all_terms), max(0, len(terms) - 1))
        use = terms[place] == all_terms if len(terms) else np.zeros(len(all_terms), bool)
        if "wanted" in docs.schema.names:
            use &= np.repeat(docs.column("wanted").fill_null(False).to_numpy(zero_copy_only=False), long)
        doc, place, weight = np.repeat(np.arange(len(docs)), long)[use], place[use], all_weights[use]
        if not len(doc):
            continue
        df = np.bincount(place, minlength=len(terms))
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        frequent, lead = df[place] * np.int64(len(terms)) + place, np.full(len(docs), -1, np.int64)
        lead[doc[heads]] = np.maximum.reduceat(frequent, heads)
        rows = np.argsort(lead, kind="stable")
        rows = rows[np.searchsorted(lead[rows], 0) :]  # those that share a term with any user
        at, n = _ranges(np.searchsorted(doc, rows), np.searchsorted(doc, rows, side="right"))
        doc, place, weight, code = np.repeat(np.arange(len(rows)), n), place[at], weight[at], code[rows]
        most = np.zeros(len(terms))
        np.maximum.at(most, place, weight)
        edges = np.concatenate([[0], np.cumsum(n)])
        for u in range(0, len(users), n_users):
            mine, m = slice(ends[u], ends[min(u + n_users, len(users))]), min(n_users, len(users) - u)
            asks = np.zeros((m, len(terms)))
            asks[who[mine] - u, local[mine]] = qtf[mine]
            asked = np.bincount(local[mine], minlength=len(terms))
            by = np.argsort(local[mine], kind="stable")
            by_term, first = who[mine][by] - u, np.concatenate([[0], np.cumsum(asked)])
            by_qtf = qtf[mine][by]
            error = 1.01 * (n.max() + 8) * 2.0**-24 * (asks @ most) + 10.0**-digits  # a sum has no more parts that are not 0 than an article has terms
            for a in range(0, len(rows), tile):
                b = min(a + tile, len(rows))
                part = slice(edges[a], edges[b])
                t, d, w = place[part], doc[part] - a, weight[part]
                dense = np.bincount(t, minlength=len(terms)) * asked * DENSE > m * (b - a)
                number = np.cumsum(dense) - 1
                right, left = np.zeros((np.count_nonzero(dense), b - a), np.float32), asks[:, dense].astype(np.float32)
                sums = dense[t]
                right[number[t[sums]], d[sums]] = w[sums]
                scores = left @ right
                rest = ~sums & (asked[t] > 0)
                pairs, times = _ranges(first[t[rest]], first[t[rest] + 1])
                for s in range(0, len(pairs), 2_000_000):
                    x = slice(s, s + 2_000_000)
                    p = pairs[x]
                    np.add.at(scores.ravel(), by_term[p] * (b - a) + np.repeat(d[rest], times)[x], (by_qtf[p] * np.repeat(w[rest], times)[x]).astype(np.float32))
                i, j = best.chances(scores, slice(u, u + m), error, positive=True)
                for s in range(0, len(i), 50_000):
                    p, q = i[s : s + 50_000], j[s : s + 50_000] + a
                    cells, n_cells = _ranges(edges[q], edges[q + 1])
                    score = np.round(np.add.reduceat(asks[np.repeat(p, n_cells), place[cells]] * weight[cells], np.cumsum(n_cells) - n_cells), digits)
                    good = score > 0
                    best.add(u + p[good], code[q[good]], score[good])
    return best.rows(users, order)


def _names(files: list[str]) -> list[str]:
    return next((b.schema.names for b in stream(files, None, 1)), [])


def recall_at(impressions: DataFrame, retrieved: DataFrame, profiles: DataFrame, ks: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Hits over clicks of impressions whose user has a profile, one row with ``recall_<k>``."""
    users = profiles.select("user_id", "split").distinct()
    clicks = impressions.join(users, ["user_id", "split"], "left_semi").select("user_id", "split", F.explode("clicked_ids").alias("article_id"))
    joined = clicks.join(retrieved.select("user_id", "split", "article_id", "rank"), ["user_id", "split", "article_id"], "left")
    n = F.count(F.lit(1))
    return joined.agg(n.alias("n_clicks"), *[(F.count_if(F.col("rank") <= k) / F.when(n > 0, n)).alias(f"recall_{k}") for k in ks])
