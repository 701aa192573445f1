"""Attributes of an entity as they were known at an event's time (problem 7).

A fact (one history row) has two times: its own time, from which it holds
(valid time), and the time at which the version that contains it became available
(recorded time). A version is current from its ``taken_at`` until the next
version's. Inside that strip of recorded time the facts of an entity split valid
time into disjoint pieces, each with one current state: these rectangles are
disjoint, so an event point lies in at most one of them. They are indexed by a
grid of (entity, version, valid-time cell), and each event is located in its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.cut import cut

#: Up to this many versions the version table is broadcast.
MAX_BROADCAST_VERSIONS = 10_000
#: An entity with more events than this in one version has them spread over several tasks.
BUSY = 200


def version_strips(versions: DataFrame, version: str, taken: str) -> DataFrame:
    """Versions with the recorded-time strip in which each is current.

    Versions without a name or time are left out; of several taken at one moment
    the last by name is current, the others have an empty strip and never are.
    """
    known = versions.select(F.col(version).alias("_version"), F.col(taken).alias("_from")).dropna().distinct()
    order = Window.orderBy("_from", "_version")
    return known.withColumn("_to", F.lead("_from").over(order))


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def _cell(t: Column, start: Column, days: float, cells: int) -> Column:
    raw = F.floor((_seconds(t) - _seconds(start)) / F.lit(days * 86400.0))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(cells - 1)).cast("int")


def state_rectangles(
    facts: DataFrame, strips: DataFrame, *, entity: str, version: str, valid_time: str, order: str, value: str,
    cell_days: float = 2.0, cells: int = 4,
) -> DataFrame:
    """Disjoint rectangles ``[_valid_from, _valid_to) x [_from, _to)`` with the current state.

    The state is the value with the highest ``order`` (then the greater value) among
    facts valid by then, and the latest fact time. Facts valid before their version
    was taken - nearly all - need no sort: they fold by a map-side maximum into the
    one rectangle that opens the strip. Only later ones are ordered.
    """
    f = facts.select(
        F.col(entity).alias("_entity"), F.col(version).alias("_version"), F.col(valid_time).alias("_time"),
        F.struct(F.col(order).alias("order"), F.col(value).alias("value")).alias("_state"),
    ).filter(F.col("_entity").isNotNull() & F.col("_state.value").isNotNull() & F.col("_version").isNotNull())
    f = f.join(strips, "_version")
    start = F.when(F.col("_time").isNull() | (F.col("_time") <= F.col("_from")), F.col("_from")).otherwise(F.col("_time"))
    f = f.withColumn("_valid_from", start).filter(F.col("_to").isNull() | (F.col("_valid_from") < F.col("_to")))
    steps = f.groupBy("_entity", "_version", "_from", "_to", "_valid_from").agg(
        F.max("_state").alias("_state"), F.max("_time").alias("_last"))
    w = Window.partitionBy("_entity", "_version").orderBy("_valid_from")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rect = steps.select(
        "_entity", "_version", "_from", "_to", "_valid_from",
        F.coalesce(F.lead("_valid_from").over(w), F.col("_to")).alias("_valid_to"),
        F.max("_state").over(upto).alias("_state"), F.max("_last").over(upto).alias("_last"),
    )
    first = _cell(F.col("_valid_from"), F.col("_from"), cell_days, cells)
    last = F.when(F.col("_valid_to").isNull(), F.lit(cells - 1)).otherwise(_cell(F.col("_valid_to"), F.col("_from"), cell_days, cells))
    return rect.withColumn("_cell", F.explode(F.sequence(first, last)))


def attributes_as_of(
    events: DataFrame, facts: DataFrame, versions: DataFrame, *,
    event_time: str, entity: str, version: str = "snapshot", taken: str = "taken_at",
    valid_time: str = "timestamp", order: str = "position", value: str = "article_id",
    keep: tuple[str, ...] = ("impression_id",), how: str = "left",
    cell_days: float = 2.0, cells: int = 4,
) -> DataFrame:
    """Every event with the entity's state as it was available at the event's time.

    The version is the latest one taken by the event's time, whether or not it has
    facts of the entity; of its facts those count whose own time is NULL or not
    after the event's. Result: ``keep`` columns, ``known_version``, ``value``,
    ``order``, ``known_last`` (latest fact time). With ``how="left"`` an event
    without entity, time, version or facts keeps NULLs; with ``"inner"`` it is left
    out. Repeated facts change nothing; repeated events are each answered; ties in
    ``order`` go to the greater value. Extra columns are ignored.
    """
    strips = version_strips(versions, version, taken)
    # only a proven-small version table is broadcast; beyond, Spark picks the join
    bounded = F.broadcast(strips) if strips.limit(MAX_BROADCAST_VERSIONS + 1).count() <= MAX_BROADCAST_VERSIONS else strips
    rect = state_rectangles(facts, bounded, entity=entity, version=version, valid_time=valid_time, order=order, value=value,
                            cell_days=cell_days, cells=cells)
    e = events.select(F.struct(*keep).alias("_keep"), F.col(entity).alias("_entity"), F.col(event_time).alias("_at"))
    e = e.join(bounded, (F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to"))), how)
    e = e.withColumn("_cell", _cell(F.col("_at"), F.col("_from"), cell_days, cells)).withColumnRenamed("_version", "_known").drop("_from", "_to")
    r = rect.select(F.col("_entity").alias("_re"), F.col("_version").alias("_rv"), F.col("_cell").alias("_rc"), "_valid_from", "_valid_to", "_state", "_last")
    hit = (
        (F.col("_entity") == F.col("_re")) & (F.col("_known") == F.col("_rv")) & (F.col("_cell") == F.col("_rc"))
        & (F.col("_valid_from") <= F.col("_at")) & (F.col("_valid_to").isNull() | (F.col("_at") < F.col("_valid_to")))
    )
    return e.join(r, hit, how).select(
        *[F.col(f"_keep.{c}").alias(c) for c in keep], F.col("_known").alias("known_version"),
        F.col("_state.value").alias(value), F.col("_state.order").alias(order), F.col("_last").alias("known_last"),
    )


def known_facts(
    events: DataFrame, facts: DataFrame, versions: DataFrame, *,
    event_time: str, entity: str, version: str = "snapshot", taken: str = "taken_at", valid_time: str = "timestamp",
    values: tuple[str, ...] = ("article_id", "position"), keep: tuple[str, ...] = ("impression_id",),
) -> DataFrame:
    """What :func:`facts_as_of` says, without the product of an entity's events and facts.

    Two kinds of rows. For every event with a known version one with ``keep``, entity,
    version, ``event_time`` and ``n_known``, the number of facts available to it (0
    without any). For every different fact of an entity and version that some event can see one with
    entity, version, ``valid_time`` and ``values``. An event's facts are those of its entity and version whose time is
    NULL or not after the event's; ``n_known`` of them there are. Rows grow with events plus facts.

    Facts valid before their version was taken are counted by a map-side combined sum;
    only later ones are ordered, as rectangles that begin with each. Facts with a NULL
    first value do not count, equal ones count once; columns of the other kind are NULL.
    """
    strips = version_strips(versions, version, taken)
    bounded = F.broadcast(strips) if strips.limit(MAX_BROADCAST_VERSIONS + 1).count() <= MAX_BROADCAST_VERSIONS else strips
    f = facts.select(F.col(entity).alias("_entity"), F.col(version).alias("_version"), F.col(valid_time).alias("_time"), *[F.col(v).alias(f"_v_{v}") for v in values])
    f = f.filter(F.col("_entity").isNotNull() & F.col(f"_v_{values[0]}").isNotNull() & F.col("_version").isNotNull()).distinct().join(bounded, "_version")
    begins = F.when(F.col("_time").isNull() | (F.col("_time") <= F.col("_from")), F.col("_from")).otherwise(F.col("_time"))
    f = cut(f.withColumn("_begins", begins).filter(F.col("_to").isNull() | (F.col("_begins") < F.col("_to"))).drop("_from", "_to"))
    e = events.select(F.struct(*keep).alias("_keep"), F.col(entity).alias("_entity"), F.col(event_time).alias("_at")).filter(F.col("_entity").isNotNull())
    e = e.join(bounded, (F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))).drop("_to")
    steps = f.groupBy("_entity", "_version", "_begins").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_entity", "_version").orderBy("_begins")
    rect = steps.select("_entity", "_version", "_begins", F.lead("_begins").over(w).alias("_ends"),
                        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_n"))
    hit = [e[c] == rect[c] for c in ("_entity", "_version")] + [rect["_begins"] <= e["_at"], rect["_ends"].isNull() | (e["_at"] < rect["_ends"])]
    counted = e.join(rect, hit, "left").select("_keep", e["_entity"], e["_version"], "_at", F.coalesce("_n", F.lit(0)).cast("bigint").alias("_n"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    of_events = counted.select(
        *[F.col(f"_keep.{c}").alias(c) for c in keep], F.col("_entity").alias(entity), F.col("_version").alias(version), F.col("_at").alias("event_time"),
        F.col("_n").alias("n_known"), none(facts, valid_time).alias("valid_time"), *[none(facts, v).alias(v) for v in values])
    of_facts = f.select(
        *[none(events, c).alias(c) for c in keep], F.col("_entity").alias(entity), F.col("_version").alias(version), none(events, event_time).alias("event_time"),
        F.lit(None).cast("bigint").alias("n_known"), F.col("_time").alias("valid_time"), *[F.col(f"_v_{v}").alias(v) for v in values])
    return of_events.unionByName(of_facts)


def facts_as_of(
    events: DataFrame, facts: DataFrame, versions: DataFrame, *,
    event_time: str, entity: str, version: str = "snapshot", taken: str = "taken_at", valid_time: str = "timestamp",
    values: tuple[str, ...] = ("article_id", "position"), keep: tuple[str, ...] = ("impression_id",), salts: int = 8,
) -> DataFrame:
    """Every event with all facts of its entity that were available at its time, long.

    Same rule as :func:`attributes_as_of`; facts with a NULL first value do not count,
    equal facts (entity, version, time, values) count once. Result: ``keep`` columns and
    ``values``; events without facts give no rows. As the result of an entity is the
    product of its events and facts, the events of a busy entity (more than ``BUSY`` in
    one version) are spread over ``salts`` buckets, each with a copy of its facts.
    """
    strips = version_strips(versions, version, taken)
    bounded = F.broadcast(strips) if strips.limit(MAX_BROADCAST_VERSIONS + 1).count() <= MAX_BROADCAST_VERSIONS else strips
    e = events.select(F.struct(*keep).alias("_keep"), F.col(entity).alias("_entity"), F.col(event_time).alias("_at")).filter(F.col("_entity").isNotNull())
    e = e.join(bounded, (F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))).drop("_from", "_to")
    busy = e.groupBy("_entity", "_version").agg(F.count(F.lit(1)).alias("_events")).filter(F.col("_events") > BUSY)
    busy = busy.select("_entity", "_version", F.lit(salts).alias("_salts"))
    f = facts.select(F.col(entity).alias("_entity"), F.col(version).alias("_version"), F.col(valid_time).alias("_time"), F.struct(*values).alias("_values"))
    f = f.filter(F.col("_entity").isNotNull() & F.col("_version").isNotNull() & F.col("_values")[values[0]].isNotNull()).distinct()
    many = F.coalesce("_salts", F.lit(1))
    f = f.join(busy, ["_entity", "_version"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    e = e.join(busy, ["_entity", "_version"], "left").withColumn("_salt", F.pmod(F.xxhash64("_keep"), many).cast("int")).drop("_salts")
    joined = e.join(f, ["_entity", "_version", "_salt"]).filter(F.col("_time").isNull() | (F.col("_time") <= F.col("_at")))
    return joined.select(*[F.col(f"_keep.{c}").alias(c) for c in keep], *[F.col(f"_values.{c}").alias(c) for c in values])
