"""Hot-key statistics and as-of attributes against brute force, and their edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillrank.functions.ids import canonical_article_id
from quillrank.operators.eventtime import attributes_as_of, facts_as_of, known_facts, version_strips
from quillrank.operators.keystats import heavy_keys, key_stats
from quillrank.operators.skew import join_key_stats

T0 = dt.datetime(2024, 1, 1)
FACTS = "user_id string, article_id string, timestamp timestamp_ntz, position int, snapshot string, impression_id string"
EVENTS = "impression_id bigint, user_id string, timestamp timestamp_ntz, position string"
VERSIONS = "snapshot string, taken_at timestamp_ntz"


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def test_canonical_ids(spark):
    spellings = ["N123456789", "123456789", " N123456789 ", "n123456789", "N-123456789", "N123456789-1", None, "", "N12345", "x1234567890y"]
    rows = spark.createDataFrame([(s,) for s in spellings], "a string").select(canonical_article_id("a").alias("c")).collect()
    assert [r.c for r in rows] == ["N123456789"] * 6 + [None] * 4


def test_key_stats_counts_copies_once(spark):
    rows = [("a", "u", hours(1), 1), ("a", "u", hours(1), 1), ("a", "u", hours(3), 2), ("a", None, None, 3), (None, "v", hours(2), 1), ("b", "u", None, 1)]
    df = spark.createDataFrame(rows, "k string, m string, t timestamp_ntz, clicks int")
    got = {r.k: (r.clicks, r.users, r.last_click) for r in key_stats(df, "k", "m", "t").collect()}
    assert got == {"a": (3, 1, hours(3)), None: (1, 1, hours(2)), "b": (1, 1, None)}
    plain = {r.k: r.clicks for r in key_stats(df, "k", "m", "t", distinct_rows=False).collect()}
    assert plain["a"] == 4


def test_key_stats_hot_key_and_empty(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 500).alias("m"), F.lit(hours(1)).alias("t"), "id")
    stats = key_stats(df, "k", "m", "t")
    hot = stats.filter("k = 'hot'").first()
    assert (hot.clicks, hot.users) == (10_000, 500)
    assert [r.k for r in heavy_keys(stats, "k", "clicks", 0.01).collect()] == ["hot"]
    none = key_stats(df.limit(0), "k", "m", "t")
    assert none.count() == 0 and heavy_keys(none, "k", "clicks", 0.01).count() == 0


def brute_as_of(events, facts, versions):
    out = []
    for imp, user, at, _ in events:
        taken = sorted((t, s) for s, t in versions if s is not None and t is not None and at is not None and t <= at)
        version = taken[-1][1] if taken else None
        mine = {(p if p is not None else -10**9, a, t) for u, a, t, p, s, _ in facts if u is not None and u == user and a is not None and s == version and s is not None and (t is None or t <= at)}
        best = max(mine, key=lambda x: (x[0], x[1])) if mine else (None, None, None)
        times = [t for _, _, t in mine if t is not None]
        out.append((imp, version, best[1], None if best[0] in (None, -10**9) else best[0], max(times) if times else None))
    return sorted(out)


def test_as_of_against_brute_force(spark):
    rng = random.Random(5)
    versions = [("v0", hours(24)), ("v1", hours(100)), ("v2", hours(300)), ("gone", None), (None, hours(50))]
    pick = lambda *x: rng.choice(x)
    facts = [(pick("u1", "u2", "u3", None), pick("a", "b", "c", None), pick(None, *[hours(rng.randint(0, 600)) for _ in range(8)]), pick(None, *range(9)), pick("v0", "v1", "v2", "other", None), "x") for _ in range(400)]
    facts += facts[:50]
    events = [(i, pick("u1", "u2", "u3", "nobody", None), pick(None, hours(rng.randint(-50, 900)), hours(24), hours(100)), "p") for i in range(200)]
    e, f, v = (spark.createDataFrame(x, s) for x, s in ((events, EVENTS), (facts, FACTS), (versions, VERSIONS)))
    want = brute_as_of(events, facts, versions)
    for cells in (1, 4):
        got = attributes_as_of(e, f, v, event_time="timestamp", entity="user_id", cells=cells)
        assert sorted(tuple(r) for r in got.select("impression_id", "known_version", "article_id", "position", "known_last").collect()) == want
    inner = attributes_as_of(e, f, v, event_time="timestamp", entity="user_id", how="inner")
    assert sorted(r.impression_id for r in inner.collect()) == [w[0] for w in want if w[2] is not None]


def test_facts_as_of_against_brute_force(spark, monkeypatch):
    from quillrank.operators import eventtime

    rng = random.Random(6)
    versions = [("v0", hours(24)), ("v1", hours(100))]
    pick = lambda *x: rng.choice(x)
    facts = [(pick("u1", "u1", "u2", None), pick("a", "b", None), pick(None, hours(rng.randint(0, 200))), pick(None, 1, 2), pick("v0", "v1", None), "x") for _ in range(200)]
    events = [(i, pick("u1", "u1", "u2", "nobody", None), pick(None, hours(rng.randint(0, 300))), "p") for i in range(150)]
    want = []
    for imp, user, at, _ in events:
        taken = sorted((t, s) for s, t in versions if at is not None and t <= at)
        mine = {(a, p, t) for u, a, t, p, s, _ in facts if taken and u is not None and u == user and a is not None and s == taken[-1][1] and (t is None or t <= at)}
        want += [(imp, a, p or -1) for a, p, _ in mine]
    e, f, v = (spark.createDataFrame(x, s) for x, s in ((events, EVENTS), (facts, FACTS), (versions, VERSIONS)))
    for busy in (200, 10):
        monkeypatch.setattr(eventtime, "BUSY", busy)
        got = facts_as_of(e, f, v, event_time="timestamp", entity="user_id")
        assert sorted((r.impression_id, r.article_id, r.position or -1) for r in got.collect()) == sorted(want)
    rows = known_facts(e, f, v, event_time="timestamp", entity="user_id").collect()
    seen = [r for r in rows if r.n_known is None]  # every fact once, and what an event can see follows from its row
    expanded = []
    for r in rows:
        if r.n_known is not None:
            mine = [(r.impression_id, x.article_id, x.position or -1) for x in seen
                    if (x.user_id, x.snapshot) == (r.user_id, r.snapshot) and (x.valid_time is None or x.valid_time <= r.event_time)]
            assert len(mine) == r.n_known
            expanded += mine
    assert sorted(expanded) == sorted(want) and len(set(seen)) == len(seen)


def test_as_of_empty_inputs(spark):
    e, f, v = (spark.createDataFrame([], s) for s in (EVENTS, FACTS, VERSIONS))
    assert attributes_as_of(e, f, v, event_time="timestamp", entity="user_id").count() == 0
    assert known_facts(e, f, v, event_time="timestamp", entity="user_id").count() == 0
    one = spark.createDataFrame([(1, "u", hours(1), "p")], EVENTS)
    assert attributes_as_of(one, f, v, event_time="timestamp", entity="user_id").first().article_id is None


def test_versions_taken_together(spark):
    v = spark.createDataFrame([("a", hours(1)), ("b", hours(1)), ("c", hours(2))], VERSIONS)
    strips = {r._version: (r._from, r._to) for r in version_strips(v, "snapshot", "taken_at").collect()}
    assert strips["a"] == (hours(1), hours(1)) and strips["b"] == (hours(1), hours(2)) and strips["c"] == (hours(2), None)


def test_join_key_stats_equals_plain_join(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise((F.col("id") % 700).cast("string")).alias("k"))
    stats = rows.filter("k IS NOT NULL AND k != '5'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for share in (1e-4, 0.1, 2.0):
        got = join_key_stats(rows, stats, "k", "n", 5_000.0, F.col("id"), share)
        assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(stats, "k").select("id", "k", "n").collect()))
