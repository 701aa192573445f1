"""How distinctive a term is per record: a parsimonious language model (problem 1)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.operators.cut import cut
from quillrank.operators.skew import join_key_stats


def count_words(records: DataFrame, record_id: str, text: str, min_letters: int = 4) -> DataFrame:
    """``(record_id, terms array, tfs array)``: runs of letters of the NFC, lower-case text.

    A NULL text counts as empty; a record without terms keeps empty arrays.
    """
    pattern = regex.compile(r"\p{L}{%d,}" % min_letters)
    field = records.schema[record_id]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(pattern.findall(unicodedata.normalize("NFC", t or "").lower())) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int32)
            terms = pa.array([w for c in counted for w in c], pa.string())
            tfs = pa.array([n for c in counted for n in c.values()], pa.int32())
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)],
                names=[record_id, "terms", "tfs"],
            )

    schema = f"`{record_id}` {field.dataType.simpleString()}, terms array<string>, tfs array<int>"
    return records.select(record_id, F.col(text).cast("string").alias("_text")).mapInArrow(count, schema)


def count_tokens_column(records: DataFrame, record_id: str, tokens: str) -> DataFrame:
    """Like :func:`count_words`, for a column that already holds the terms (NULL terms are left out)."""
    long = records.select(record_id, F.explode(tokens).alias("term")).filter(F.col("term").isNotNull())
    counted = long.groupBy(record_id, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    packed = counted.groupBy(record_id).agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    return packed.select(record_id, F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))


def separate(
    seg: np.ndarray, tf: np.ndarray, background: np.ndarray, record_share: float, floor: float, tolerance: float, max_rounds: int,
) -> np.ndarray:
    """Expectation-maximisation for many records at once.

    ``seg`` holds the start of each record in the flat arrays (no empty records).
    E-step: the part of each term's mass that the record, not the background,
    explains. M-step: those parts, normalised. Terms whose probability falls below
    ``floor``, or in a long record below a tenth of one occurrence, lose all mass, so
    the model becomes parsimonious.
    """
    size = np.diff(np.append(seg, len(tf)))
    occurrences = np.repeat(np.add.reduceat(tf, seg), size)
    p = tf / occurrences
    floor = np.minimum(floor, 0.1 / occurrences)
    active = np.ones(len(seg), bool)
    for _ in range(max_rounds):
        mixed = record_share * p
        explained = tf * mixed / np.maximum(mixed + (1.0 - record_share) * background, 1e-300)
        mass = np.add.reduceat(explained, seg)
        new = explained / np.repeat(np.maximum(mass, 1e-300), size)
        new[new < floor] = 0.0
        new /= np.repeat(np.maximum(np.add.reduceat(new, seg), 1e-300), size)
        moved = np.maximum.reduceat(np.abs(new - p), seg)
        p = np.where(np.repeat(active, size), new, p)  # a converged record stays as it is, whatever shares its batch
        active &= moved > tolerance
        if not active.any():
            break
    return p


def parsimonious_terms(
    counted: DataFrame, record_id: str, *, record_share: float = 0.2, floor: float = 1e-4, tolerance: float = 1e-6, max_rounds: int = 60,
    background: str = "cf",
) -> DataFrame:
    """One row per record and term with the term's converged record probability.

    ``counted`` is the result of :func:`count_words` with one row per record. Result:
    ``record_id, term, tf, df, cf, p_background, p_record, term_rank, record_size``; ``df`` and
    ``cf`` are the records and occurrences of the term in the whole collection,
    ``p_background`` is its part of all occurrences, or with ``background="df"`` of all
    distinct terms of records, so that one record that repeats a term does not make it common;
    ``p_record`` is 0 for terms that the background explains, ``term_rank``
    counts from 1 by falling ``p_record``, ties by term, and ``record_size`` is the record's occurrences.

    Counts of the collection come from map-side combined aggregates over all
    records. Frequent terms reach the records by a broadcast of at most 10,000
    rows, the others by a shuffled join, so no term is a hot key. The EM itself is
    per record and vectorised over Arrow batches. Records without terms, an empty
    table and NULL record ids give no rows. Extra columns are ignored.
    """
    counted = cut(counted.filter(F.col(record_id).isNotNull()))
    long = counted.select(record_id, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(
        record_id, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    stats = cut(long.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    total, distinct = stats.agg(F.coalesce(F.sum("cf"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    joined = join_key_stats(long, stats, "term", "cf", float(total), spread=F.col(record_id))
    packed = joined.groupBy(record_id).agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df", "cf"))).alias("x"))
    packed = packed.select(record_id, *[F.col(f"x.{c}").alias(c) for c in ("term", "tf", "df", "cf")])
    id_type = counted.schema[record_id].dataType.simpleString()
    by_records = {"cf": False, "df": True}[background]

    names = ["term", "tf", "df", "cf", "p_background", "p_record", "term_rank", "record_size"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(i) for i in range(1, 5)]
            flat = [x.flatten() for x in lists]
            sizes = np.diff(lists[0].offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            tf = flat[1].to_numpy(zero_copy_only=False).astype(np.float64)
            of, whole = (flat[2], distinct) if by_records else (flat[3], total)
            background = of.to_numpy(zero_copy_only=False) / float(whole)
            p = separate(starts, tf, background, record_share, floor, tolerance, max_rounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((np.arange(len(p)), -p, owner))
            rank = np.empty(len(p), np.int32)
            rank[order] = np.arange(len(p)) - np.repeat(starts, sizes) + 1
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            record_size = np.repeat(np.add.reduceat(tf, starts), sizes).astype(np.int64)
            new = [flat[0], flat[1], flat[2], flat[3], pa.array(background), pa.array(p), pa.array(rank), pa.array(record_size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.ListArray.from_arrays(offsets, x) for x in new]],
                names=[record_id, *names],
            )

    schema = (
        f"`{record_id}` {id_type}, term array<string>, tf array<int>, df array<bigint>, cf array<bigint>, "
        "p_background array<double>, p_record array<double>, term_rank array<int>, record_size array<bigint>"
    )
    rows = packed.mapInArrow(fit, schema).select(record_id, F.explode(F.arrays_zip(*names)).alias("x"))
    return rows.select(record_id, *[F.col(f"x.{c}").alias(c) for c in names])


def one_text_per_record(rows: DataFrame, record_id: str, text: Column) -> DataFrame:
    """``(record_id, text)`` with each record once: of differing texts the least one is kept."""
    return rows.select(F.col(record_id), text.alias("text")).groupBy(record_id).agg(F.min("text").alias("text"))
