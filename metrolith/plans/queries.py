"""Named queries over the driver's tables, each with an oracle in DuckDB SQL where SQL can express it.

The tables stand in for the platform's own: events for fixes, readings, fetches and snapshots; embeddings for points in
metres; orders and lineitem for dated facts; documents and pages for source records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions import geo, names
from metrolith.io import table
from metrolith.operators import graph, latest, lifecycle, raster, records, sessions, spatial, stats, status, temporal, transit
from metrolith.plans import views
from metrolith.streaming import streams

NOW = "2024-01-31 00:00:00"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def points(spark: SparkSession, sf_dir: str, scale: float = 1000.0) -> DataFrame:
    """The first two components of each vector as metres."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") * scale * 100) / 100
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), F.col("label").alias("kind"), F.get("embedding", F.lit(2)).cast("double").alias("value"))


PTS = "SELECT vec_id AS id, floor(CAST(embedding[1] AS DOUBLE) * 1000 * 100) / 100 AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000 * 100) / 100 AS y, label AS kind, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings"


# --- newest rows, status, records ----------------------------------------------------------------------------------

@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC""")
def latest_per_key(spark, sf):
    return latest.latest_per_key(events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], ["ts", "event_id", "value"])


@query("""SELECT * EXCLUDE r, r AS rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders_per_customer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return latest.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def _sources(spark):
    rows = [(f"s{i}", 3600 * (i + 1) if i % 4 else None, 1800 * (i + 1) if i % 4 == 0 or i == 9 else None) for i in range(12)]
    return spark.createDataFrame([(s, None if x is not None and s == "s9" else x, y) for s, x, y in rows], "source string, schedule_s long, stale_s long")


SOURCES = "(VALUES " + ", ".join(
    f"('s{i}', {'NULL' if i % 4 == 0 or i == 9 else 3600 * (i + 1)}::BIGINT, {1800 * (i + 1) if i % 4 == 0 or i == 9 else 'NULL'}::BIGINT)" for i in range(12)) + ") s(source, schedule_s, stale_s)"


def _fetches(spark, sf):
    e = events(spark, sf)
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 11).alias("source"), F.col("ts").alias("started_at"), F.col("event_id").alias("id"),
                    F.when(F.col("event_type") == "view", None).otherwise(F.col("event_type") == "click").alias("ok"), F.when(F.col("event_type") != "click", F.col("props")).alias("error"))


STATUS_SQL = f"""
f AS (SELECT 's' || (user_id % 11) AS source, ts, event_id AS id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type = 'click' END AS ok, CASE WHEN event_type <> 'click' THEN props END AS error FROM events),
good AS (SELECT DISTINCT ON (source) source, ts FROM f WHERE ok ORDER BY source, ts DESC, id DESC),
tried AS (SELECT DISTINCT ON (source) source, ts, ok FROM f WHERE ok IS NOT NULL ORDER BY source, ts DESC, id DESC),
failed AS (SELECT f.source, count(*) AS failures, arg_max(error, (f.ts, id)) AS last_error FROM f LEFT JOIN good USING (source) WHERE NOT ok AND f.ts > coalesce(good.ts, TIMESTAMP '0001-01-01') GROUP BY 1),
st AS (SELECT s.source, s.schedule_s, good.ts AS last_ok_at, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(good.ts))::BIGINT AS age_s, greatest(schedule_s / 4, 900) AS grace, stale_s, tried.ts AS last_try_at, tried.ok AS last_try_ok, coalesce(failures, 0) AS failures, last_error
  FROM {SOURCES} LEFT JOIN good USING (source) LEFT JOIN tried USING (source) LEFT JOIN failed USING (source) WHERE schedule_s IS NOT NULL OR stale_s IS NOT NULL)"""


@query(f"""WITH {STATUS_SQL} SELECT source, last_ok_at, age_s, CASE WHEN last_ok_at IS NULL THEN 'never' WHEN stale_s IS NOT NULL THEN CASE WHEN age_s < stale_s THEN 'fresh' ELSE 'stale' END
  WHEN age_s < schedule_s + grace THEN 'fresh' WHEN age_s < 3 * schedule_s + grace THEN 'late' ELSE 'stale' END AS state, last_try_at, last_try_ok, failures, last_error FROM st""")
def source_status(spark, sf):
    return status.source_status(_sources(spark), _fetches(spark, sf), now())


@query(f"""WITH {STATUS_SQL} SELECT source FROM st WHERE schedule_s IS NOT NULL AND (last_ok_at IS NULL OR age_s >= schedule_s) AND (last_try_at IS NULL OR epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(last_try_at))::BIGINT >= least(schedule_s, 900))""")
def due_sources(spark, sf):
    s = _sources(spark)
    return status.due(status.source_status(s, _fetches(spark, sf), now()), s, now())


def _daily(spark, sf):
    """Each user's last event of a day is what that day's snapshot holds of them."""
    d = events(spark, sf).select("user_id", F.date_trunc("day", "ts").alias("seen_at"), "event_type", "ts", "event_id")
    return d.groupBy("user_id", "seen_at").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content"))


DAILY = "daily AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS seen_at, arg_max(event_type, (ts, event_id)) AS content FROM events GROUP BY 1, 2)"


@query(f"""WITH {DAILY}, t AS (SELECT seen_at, lead(seen_at) OVER (ORDER BY seen_at) AS n FROM (SELECT DISTINCT seen_at FROM daily)),
v AS (SELECT user_id, content, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM daily GROUP BY 1, 2)
SELECT v.user_id, content, first_seen, last_seen, t.n AS removed_at FROM v JOIN t ON t.seen_at = v.last_seen""")
def scd2_versions(spark, sf):
    return records.versions_of_snapshots(_daily(spark, sf), "user_id", "seen_at", "content")


@query(f"""WITH {DAILY}, s AS (SELECT user_id, content FROM daily WHERE seen_at = TIMESTAMP '2024-01-11'), h AS (SELECT user_id, content, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM daily WHERE seen_at <= TIMESTAMP '2024-01-10' GROUP BY 1, 2)
SELECT 'events' AS source, CAST(coalesce(h.user_id, s.user_id) AS VARCHAR) AS source_id, coalesce(h.content, s.content) AS version_hash, coalesce(h.content, s.content) AS payload,
  coalesce(first_seen, TIMESTAMP '2024-01-11') AS first_seen, CASE WHEN s.user_id IS NOT NULL THEN TIMESTAMP '2024-01-11' ELSE last_seen END AS last_seen,
  CASE WHEN s.user_id IS NOT NULL THEN NULL WHEN last_seen = TIMESTAMP '2024-01-10' THEN TIMESTAMP '2024-01-11' ELSE TIMESTAMP '2024-01-10' END AS removed_at
FROM h FULL JOIN s ON h.user_id = s.user_id AND h.content = s.content""")
def scd2_merge(spark, sf):
    """Ten days held, the eleventh day's snapshot merged."""
    d = _daily(spark, sf)
    row = lambda df: df.select(F.lit("events").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("content").alias("version_hash"), F.col("content").alias("payload"), "seen_at")
    at = lambda x: F.lit(f"2024-01-{x} 00:00:00").cast("timestamp_ntz")
    held = row(d.where(F.col("seen_at") <= at(10))).groupBy("source", "source_id", "version_hash", "payload").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    held = held.withColumn("removed_at", F.when(F.col("last_seen") < at(10), at(10)))
    return records.merge_versions(held, row(d.where(F.col("seen_at") == at(11))).drop("seen_at"), at(11))


@query("""WITH a AS (SELECT doc_id, source, n_chars, doc_id % 7 <> 0 AS active FROM documents WHERE doc_id % 5 <> 1), b AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NOT NULL AND NOT active THEN 'reactivated' WHEN b.doc_id IS NOT NULL AND a.source IS NOT DISTINCT FROM b.source AND a.n_chars IS NOT DISTINCT FROM b.n_chars THEN 'unchanged' WHEN b.doc_id IS NOT NULL THEN 'changed' WHEN active THEN 'retired' ELSE 'gone' END AS state,
  count(*) AS n, CAST(sum(CASE WHEN b.doc_id IS NOT NULL THEN b.n_chars ELSE a.n_chars END) AS BIGINT) AS chars FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def typed_upsert_counts(spark, sf):
    """Two editions of the documents' records: an older and a newer snapshot."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    held = d.where("doc_id % 5 <> 1").withColumn("active", F.expr("doc_id % 7 <> 0"))
    staged = d.where("doc_id % 3 <> 0").withColumn("n_chars", F.expr("case when doc_id % 11 = 0 then null else n_chars end"))
    return records.upsert(held, staged, "doc_id", ["source", "n_chars"]).groupBy("state").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT user_id) AS found FROM events GROUP BY 1) SELECT day, found, lag(found) OVER (ORDER BY day) AS active, found = 0 OR found < 0.9 * lag(found) OVER (ORDER BY day) AS refused FROM c""")
def snapshot_guard(spark, sf):
    from pyspark.sql import Window

    c = events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.countDistinct("user_id").alias("found"))
    return records.guard(c.withColumn("active", F.lag("found").over(Window.orderBy("day"))), "found", "active", 0.9)  # one row for each day


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), n AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT DISTINCT ON (user_id, hour) user_id, hour, event_id, value FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = n.user_id AND h.hour = n.hour) ORDER BY user_id, hour, event_id""")
def insert_if_absent(spark, sf):
    e = events(spark, sf).select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "value", "ts")
    return records.insert_if_absent(e.where("ts < timestamp_ntz '2024-01-15'"), e.where("ts >= timestamp_ntz '2024-01-10'").drop("ts"), ["user_id", "hour"], [F.col("event_id")])


@query("""WITH u AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('{"p_size":' || p_size || ',"p_type":"' || p_type || '"}')) AS k FROM u)
SELECT p_brand, p_type, p_size, CASE WHEN k = 1 THEN p_brand ELSE p_brand || '#' || k END AS stable_key FROM n""")
def stable_key_suffix(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    return records.suffix_keys(p, "p_brand", ["p_type", "p_size"]).drop("content_hash")


@query("""SELECT n_regionkey, count(*) AS n, md5(string_agg(md5(concat_ws('|', n_nationkey, n_name)), ',' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1""")
def content_digest(spark, sf):
    return records.content_digest(table(spark, sf, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"])


REPUB = """o AS (SELECT p_partkey AS id, p_name AS code, p_brand || p_size AS line FROM part WHERE p_partkey % 10 <> 9), n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE p_partkey + 1000000 END AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS code, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || p_size END AS line FROM part WHERE p_partkey % 10 <> 8)"""


def _editions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("code"), F.expr("p_brand || p_size").alias("line"))
    new = p.where("id % 10 <> 8").select(F.expr("case when id % 10 = 0 then id else id + 1000000 end").alias("id"), F.expr("case when id % 3 <> 0 then code end").alias("code"), F.expr("case when id % 4 <> 0 then line end").alias("line"))
    return p.where("id % 10 <> 9"), new


@query(f"""WITH {REPUB}, a AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)), b AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)),
p1 AS (SELECT y.id AS new_id, x.id AS old_id FROM (SELECT code, line, min(id) AS id FROM a WHERE code IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) x JOIN (SELECT code, line, min(id) AS id FROM b WHERE code IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) y USING (code, line)),
a2 AS (SELECT * FROM a WHERE id NOT IN (SELECT old_id FROM p1)), b2 AS (SELECT * FROM b WHERE id NOT IN (SELECT new_id FROM p1)),
p2 AS (SELECT y.id AS new_id, x.id AS old_id FROM (SELECT code, min(id) AS id FROM a2 WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT code, min(id) AS id FROM b2 WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) = 1) y USING (code)),
a3 AS (SELECT * FROM a2 WHERE id NOT IN (SELECT old_id FROM p2)), b3 AS (SELECT * FROM b2 WHERE id NOT IN (SELECT new_id FROM p2)),
p3 AS (SELECT y.id AS new_id, x.id AS old_id FROM (SELECT line, min(id) AS id FROM a3 WHERE line IS NOT NULL GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT line, min(id) AS id FROM b3 WHERE line IS NOT NULL GROUP BY 1 HAVING count(*) = 1) y USING (line))
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def republish_pairs(spark, sf):
    return records.pair_republished(*_editions(spark, sf))


@query(f"""WITH {REPUB}, m AS (SELECT o.id AS o, n.id AS n FROM o FULL JOIN n USING (id)), c AS (SELECT count(o) AS known, count(n) AS found, count(*) FILTER (o IS NULL) AS fresh, count(*) FILTER (n IS NULL) AS gone FROM m)
SELECT *, known > 0 AND found > 0 AND fresh > 0.5 * found AND gone > 0.5 * known AS republish FROM c""")
def republish_check(spark, sf):
    return records.is_republish(*_editions(spark, sf))


@query("""SELECT item, owners, claimed_by FROM (SELECT k AS item, count(DISTINCT o) AS owners, coalesce(array_to_string(list(DISTINCT o ORDER BY o) FILTER (o IS NOT NULL), ','), '') AS claimed_by FROM (
  SELECT c_nationkey AS k, 'customer' AS o FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, NULL FROM nation) GROUP BY 1) WHERE owners <> 1""")
def union_ownership(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("item"), F.lit("customer").alias("owner"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("item"), F.lit("supplier").alias("owner"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("item"), F.lit(None).cast("string").alias("owner"))
    return records.ownership(c.unionByName(s).unionByName(n), "item", "owner").withColumn("claimed_by", F.array_join("claimed_by", ","))


@query("""SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS strictest, count(*) AS versions FROM orders GROUP BY 1""")
def layer_versions(spark, sf):
    return records.append_layer_version(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "o_orderdate", {"O": 0, "P": 1, "F": 2}, "o_orderstatus")


@query("""WITH s AS (SELECT user_id, count(*) AS n, max(event_id) AS top, max(ts) AS edited FROM events GROUP BY 1), h AS (SELECT user_id, count(*) AS n, max(event_id) AS top, max(ts) AS edited FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT s.* FROM s LEFT JOIN h USING (user_id) WHERE (s.n, s.top, s.edited) IS DISTINCT FROM (h.n, h.top, h.edited)""")
def change_gate(spark, sf):
    sign = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("top"), F.max("ts").alias("edited"))
    e = events(spark, sf)
    return records.changed_sources(sign(e.where("ts < timestamp_ntz '2024-01-30'")), sign(e), "user_id", ["n", "top", "edited"])


# --- lifecycles, sessions, steps -----------------------------------------------------------------------------------

@query(f"""WITH {DAILY}, t AS (SELECT seen_at, row_number() OVER (ORDER BY seen_at) AS n FROM (SELECT DISTINCT seen_at FROM daily)), d AS (SELECT daily.*, t.n, t.n - row_number() OVER (PARTITION BY user_id ORDER BY t.n) AS i FROM daily JOIN t USING (seen_at)),
r AS (SELECT user_id, i, min(seen_at) AS opened_at, max(seen_at) AS last_seen, count(*) AS n_seen, max(n) AS l FROM d GROUP BY 1, 2) SELECT user_id, opened_at, last_seen, n_seen, t.seen_at AS closed_at FROM r LEFT JOIN t ON t.n = r.l + 1""")
def snapshot_spells(spark, sf):
    return lifecycle.spells(_daily(spark, sf), ["user_id"], "seen_at")


@query(f"""WITH {DAILY}, t AS (SELECT seen_at, row_number() OVER (ORDER BY seen_at) AS n FROM (SELECT DISTINCT seen_at FROM daily)), d AS (SELECT daily.*, t.n, t.n - row_number() OVER (PARTITION BY user_id ORDER BY t.n) AS i FROM daily JOIN t USING (seen_at)),
r AS (SELECT user_id, i, min(seen_at) AS opened_at, max(n) AS l FROM d GROUP BY 1, 2), e AS (SELECT user_id, opened_at, t.seen_at AS closed_at FROM r LEFT JOIN t ON t.n = r.l + 1),
c AS (SELECT user_id, max(seen_at) AS content_at FROM (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY seen_at) AS p FROM daily) WHERE p IS NULL OR p <> content GROUP BY 1),
l AS (SELECT user_id, min(opened_at) AS observed_lo, arg_max(CASE WHEN closed_at IS NULL THEN TIMESTAMP '9999-01-01' ELSE closed_at END, opened_at) AS hi, count(*) - 1 AS returns, max(opened_at) AS o FROM e GROUP BY 1)
SELECT user_id, observed_lo, nullif(hi, TIMESTAMP '9999-01-01') AS observed_hi, hi = TIMESTAMP '9999-01-01' AS active, returns, greatest(o, content_at, CASE WHEN hi = TIMESTAMP '9999-01-01' THEN content_at ELSE hi END) AS updated_at FROM l JOIN c USING (user_id)""")
def snapshot_lifecycle(spark, sf):
    return lifecycle.lifecycles(_daily(spark, sf), ["user_id"], "seen_at", "content")


@query("""WITH v AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS shown FROM events), c AS (SELECT *, lag(shown) OVER w AS p, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, shown, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM c WHERE k = 1 OR shown IS DISTINCT FROM p) SELECT * FROM d WHERE shown IS NOT NULL""")
def value_change_intervals(spark, sf):
    e = events(spark, sf).withColumn("shown", F.when(F.col("event_type") != "error", F.col("event_type")))
    return lifecycle.value_intervals(e, ["user_id"], "ts", "shown", "event_id")


@query("""WITH w AS (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, count(*) FILTER (event_type = 'error') AS amount FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week) AS k FROM w),
l AS (SELECT user_id, max(k) FILTER (amount <= 0) AS dry FROM n GROUP BY 1) SELECT user_id, min(week) AS since, max(week) AS latest, count(*) AS weeks, arg_max(amount, week) AS amount, max(amount) AS peak, min(k) = 1 AS since_is_lower_bound FROM n JOIN l USING (user_id) WHERE k > coalesce(dry, 0) GROUP BY 1""")
def open_episodes(spark, sf):
    w = events(spark, sf).groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.count_if(F.col("event_type") == "error").alias("amount"))
    return lifecycle.open_episodes(w, ["user_id"], "week", "amount")


@query(f"""WITH e AS (SELECT user_id, min(ts) AS opened_at, max(ts) AS last_at, max(value) AS peak, count(*) AS reports FROM events WHERE event_type = 'purchase' GROUP BY 1), q AS (SELECT *, CASE WHEN peak >= 200 THEN 5 WHEN peak >= 100 THEN 2 ELSE 1 END AS quiet_days FROM e)
SELECT *, last_at + to_days(quiet_days) AS closes_at, last_at + to_days(quiet_days) > TIMESTAMP '{NOW}' AS is_open FROM q""")
def quiet_lifecycles(spark, sf):
    return lifecycle.quiet_lifecycles(events(spark, sf).where("event_type = 'purchase'"), "user_id", "ts", "value", now(), [(100, 2), (200, 5)], 1)


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 7200 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM t GROUP BY 1, 2""")
def gap_sessions(spark, sf):
    s = sessions.with_sessions(events(spark, sf), ["user_id"], "ts", "event_id", 7200)
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id, dayofyear(ts) AS day FROM events WHERE event_type = 'click'), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY user_id, g""")
def active_day_islands(spark, sf):
    d = events(spark, sf).where("event_type = 'click'").select("user_id", F.dayofyear("ts").cast("long").alias("day")).distinct()
    return sessions.islands(d, ["user_id"], "day")


@query("""WITH d AS (SELECT *, value < 20 AS slow FROM events), e AS (SELECT *, CASE WHEN lag(slow) OVER w IS DISTINCT FROM slow THEN 1 ELSE 0 END AS edge FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, run, min(ts) AS stopped_at, max(ts) AS left_at, count(*) AS fixes FROM r WHERE slow GROUP BY 1, 2) SELECT user_id, stopped_at, left_at, fixes, (epoch_us(left_at) - epoch_us(stopped_at)) / 1e6 AS stop_s FROM s WHERE (epoch_us(left_at) - epoch_us(stopped_at)) / 1e6 >= 3""")
def slow_stops(spark, sf):
    return sessions.slow_stops(events(spark, sf), ["user_id"], "ts", "value", 20.0, 3.0)


@query("""WITH m AS (SELECT event_type, date_trunc('minute', ts)::TIMESTAMP AS minute, arg_max(value, (ts, value)) AS v FROM events GROUP BY 1, 2), h AS (SELECT event_type, date_trunc('hour', minute)::TIMESTAMP AS hour, list(v ORDER BY minute) AS vs FROM m GROUP BY 1, 2) SELECT event_type, hour, len(vs) AS n, round(vs[1], 6) AS first, round(list_sum(vs), 4) AS total FROM h WHERE len(vs) >= 3""")
def packed_hours(spark, sf):
    h = sessions.pack_hours(events(spark, sf), ["event_type"], "ts", "value", 3)
    return h.select("event_type", "hour", F.size("values").cast("long").alias("n"), F.round(F.get("values", F.lit(0)), 6).alias("first"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), v AS (SELECT *, q > 40 AND n > min(n) OVER w AND n < max(n) OVER w AS cut FROM g WINDOW w AS (PARTITION BY l_orderkey)),
p AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM v), u AS (SELECT l_orderkey, piece, n, q FROM p UNION ALL SELECT l_orderkey, piece - 1, n, q FROM p WHERE cut)
SELECT l_orderkey, CAST(piece AS BIGINT) AS piece, min(n) AS from_n, max(n) AS to_n, count(*) AS vertices FROM u GROUP BY 1, 2""")
def split_pieces(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    p = sessions.split_at(v, ["l_orderkey"], "n", F.col("q") > 40)
    return p.groupBy("l_orderkey", "piece").agg(F.min("n").alias("from_n"), F.max("n").alias("to_n"), F.count("*").alias("vertices"))


STEP = """s AS (SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS dt, abs(lead(value) OVER w - value) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, CASE WHEN dt IS NULL THEN NULL WHEN dt > 43200 THEN 'gap' WHEN c < 15 THEN 'still' ELSE 'straight' END AS step FROM s)"""


@query(f"""WITH {STEP} SELECT event_id, step, round(CASE WHEN step = 'still' THEN 0 WHEN step = 'straight' AND dt > 0 THEN c / dt END, 6) AS speed FROM k""")
def step_classify(spark, sf):
    e = events(spark, sf).withColumn("y", F.lit(0.0))
    s = transit.steps(e, "user_id", "ts", "event_id", "value", "y", gap_s=43200)
    return s.select("event_id", "step", F.round("step_speed_ms", 6).alias("speed"))


@query(f"""WITH {STEP}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AS newest FROM k WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') SELECT event_id, user_id, ts, step, newest FROM d
WHERE ts + to_microseconds(CAST(round(dt * 1e6) AS BIGINT)) >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 900 SECOND OR (newest AND ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 21600 SECOND)""")
def playback_window(spark, sf):
    e = events(spark, sf).withColumn("y", F.lit(0.0))
    s = transit.steps(e, "user_id", "ts", "event_id", "value", "y", gap_s=43200)
    return transit.playback(s, "user_id", "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 900, 21600).select("event_id", "user_id", "ts", "step", "newest")


@query("""WITH h AS (SELECT user_id, event_type, count(*) AS hits FROM events GROUP BY 1, 2), f AS (SELECT user_id, count(*) AS fixes FROM events GROUP BY 1), r AS (SELECT *, hits / fixes AS share, row_number() OVER w AS k, lead(event_type) OVER w AS runner_up, lead(hits / fixes) OVER w AS rs FROM h JOIN f USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY hits DESC, event_type))
SELECT user_id, event_type, round(share, 3) AS share, runner_up, round(rs, 3) AS runner_up_share FROM r WHERE k = 1 AND fixes >= 10 AND share >= 0.25 AND share - coalesce(rs, 0) >= 0.02""")
def route_vote(spark, sf):
    e = events(spark, sf)
    hits, fixes = e.groupBy("user_id", "event_type").agg(F.count("*").alias("hits")), e.groupBy("user_id").agg(F.count("*").alias("fixes"))
    return transit.vote(hits, "user_id", "event_type", fixes, 10, 0.25, 0.02)


@query("""SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Boise' AS DATE)::VARCHAR AS day FROM events""")
def service_dates(spark, sf):
    return events(spark, sf).select("event_id", transit.service_date(F.col("ts"), "America/Boise").cast("string").alias("day"))


# --- joins ---------------------------------------------------------------------------------------------------------

@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT ON (user_id, ts) user_id, ts AS rts, event_id AS click_id, value AS click_value FROM events WHERE event_type = 'click' ORDER BY user_id, ts, click_id DESC)
SELECT l.event_id, l.user_id, l.ts, r.click_id, r.click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts""")
def asof_last_click(spark, sf):
    e = events(spark, sf)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return latest.as_of_join(left, right, ["user_id"], "ts", "rts", ["click_id", "click_value"])


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT a.o_orderkey, b.o_orderkey AS previous, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.day DESC, b.o_orderkey) AS r FROM o a LEFT JOIN o b ON a.k = b.k AND b.o_orderkey <> a.o_orderkey AND b.day BETWEEN a.day - 30 AND a.day)
SELECT o_orderkey, previous FROM p WHERE r = 1""")
def asof_dim_range(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.to_date("o_orderdate").alias("day"))
    right = o.select("k", F.col("o_orderkey").alias("other"), F.col("day").alias("other_day"))
    pick = F.when(F.col("other") != F.col("o_orderkey"), F.col("other_day"))
    d = latest.as_of_within(o, right, ["k"], "day", "other_day", 30, [pick.desc_nulls_last(), F.col("other")], ["o_orderkey"])
    return d.select("o_orderkey", F.when(F.col("other") != F.col("o_orderkey"), F.col("other")).alias("previous"))


@query(f"""WITH p AS ({PTS}) SELECT a.id, count(*) AS n, count(*) FILTER (b.kind = a.kind) AS same_kind, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) AS nearest, round(max(b.value), 6) AS top FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25 GROUP BY 1""")
def radius_join_stats(spark, sf):
    p = points(spark, sf)
    j = spatial.radius_join(p, p, 25.0).where("id <> r_id")
    return j.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("r_kind") == F.col("kind")).alias("same_kind"), F.round(F.min("d"), 4).alias("nearest"), F.round(F.max("r_value"), 6).alias("top"))


@query(f"""WITH p AS ({PTS}), r AS (SELECT a.id, b.id AS nearest_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS k FROM p a JOIN p b ON a.kind < b.kind AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40) SELECT id, nearest_id, round(d, 4) AS d FROM r WHERE k = 1""")
def knn1_within(spark, sf):
    p = points(spark, sf)
    n = spatial.nearest_within(p, p, 40.0, ["id"], ["r_id"], F.col("kind") < F.col("r_kind"))
    return n.select("id", F.col("r_id").alias("nearest_id"), F.round("d", 4).alias("d"))


@query(f"""WITH RECURSIVE p AS ({PTS}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.kind = b.kind AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30), r(id, c) AS (SELECT id, id FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY 1""")
def cluster_components(spark, sf):
    return spatial.clusters(points(spark, sf), "id", 30.0, ["kind"]).select("id", "cluster")


@query(f"""WITH p AS ({PTS}) SELECT id, x, y FROM p WHERE x BETWEEN -100 AND 100 AND y BETWEEN -100 AND 100 ORDER BY value DESC, id LIMIT 21""")
def bbox_topk(spark, sf):
    return spatial.top_in_box(points(spark, sf), (-100, -100, 100, 100), [F.desc("value"), F.col("id")], 20).select("id", "x", "y")


@query(f"""WITH p AS ({PTS}), t AS (SELECT *, x / 100 - 116.2 AS lon, y / 100 + 43.6 AS lat FROM p) SELECT 10 AS z, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS ty, count(*) AS n, max(id) AS top FROM t GROUP BY ALL""")
def tile_counts(spark, sf):
    p = points(spark, sf).withColumn("lon", F.col("x") / 100 - 116.2).withColumn("lat", F.col("y") / 100 + 43.6)
    return spatial.tile_counts(p, "lon", "lat", 10, [F.count("*").alias("n"), F.max("id").alias("top")])


@query(f"""WITH RECURSIVE p AS ({PTS}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10), r(id, c) AS (SELECT id, id FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(c) AS cluster FROM r GROUP BY 1), m AS (SELECT cluster, count(*) AS members, avg(x) AS x, avg(y) AS y FROM c JOIN p USING (id) GROUP BY 1),
n AS (SELECT m.cluster, p.id, p.value, p.kind, sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) AS d FROM m JOIN p ON sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) <= 30 AND p.kind >= 5), a AS (SELECT cluster, arg_min(id, (d, id)) AS nearest_id, min(d) AS nearest_d, max(value) AS max_value, count(*) AS facts, count(DISTINCT kind) AS kinds FROM n GROUP BY 1)
SELECT cluster, members, round(nearest_d, 3) AS nearest_d, round(max_value, 6) AS max_value, coalesce(facts, 0) AS facts, coalesce(kinds, 0) AS kinds FROM m LEFT JOIN a USING (cluster)""")
def place_summary(spark, sf):
    p = points(spark, sf)
    s = views.place_summary(p.select("id", "x", "y"), p.where("kind >= 5"), 30.0, 10.0)
    return s.select("cluster", "members", F.round("nearest_d", 3).alias("nearest_d"), F.round("max_value", 6).alias("max_value"), "facts", "kinds")


@query(f"""WITH p AS ({PTS}), b AS (SELECT id, x, y FROM p), r(zone, x0, x1, y0) AS (VALUES (1, -200, 0, -200), (2, 0, 200, -100), (3, -50, 50, 0)) SELECT id, zone FROM b JOIN r ON y >= y0 AND y < y0 + 150 AND x >= x0 + (y - y0) / 3 AND x < x1 + (y - y0) / 3""")
def points_in_polygons(spark, sf):
    """Slanted boxes, so that their bounds alone don't decide."""
    rings = [(z, [(float(a), float(c)), (float(b), float(c)), (b + 50.0, c + 150.0), (a + 50.0, c + 150.0)]) for z, a, b, c in ((1, -200, 0, -200), (2, 0, 200, -100), (3, -50, 50, 0))]
    polygons = spark.createDataFrame(rings, "zone int, ring array<struct<x:double,y:double>>")
    return spatial.points_in_polygons(points(spark, sf).select("id", "x", "y"), polygons, 50.0).select("id", "zone")


@query()
def greedy_assignment(spark, sf):
    """Points of two kinds paired one to one, the closest first."""
    p = points(spark, sf)
    near = spatial.radius_join(p.where("kind = 1"), p.where("kind = 2"), 60.0)
    return spatial.greedy_pairs(near.select(F.col("id").alias("l"), F.col("r_id").alias("r"), F.round("d", 6).alias("d")), "l", "r", "d")


@query()
def line_match(spark, sf):
    """All orders' lines against each other, by the target's share or the line's."""
    return spatial.match_lines(_tracks(spark, sf).withColumnRenamed("line", "target"), None, 12.0, 20.0, min_line=20.0)


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_anti_guard(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    c = c.join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH b AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, unnest(supps) AS s, len(supps) AS n FROM b) SELECT s_nationkey, count(*) AS links, count(DISTINCT l_orderkey) AS orders, max(n) AS widest FROM u JOIN supplier ON s_suppkey = s GROUP BY 1""")
def array_membership(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("supps"))
    u = b.select("l_orderkey", F.explode("supps").alias("s_suppkey"), F.size("supps").cast("long").alias("n"))
    return u.join(table(spark, sf, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("links"), F.countDistinct("l_orderkey").alias("orders"), F.max("n").alias("widest"))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), d AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.k, d.k) AS k, a.q AS a_q, d.q AS d_q, a.k IS NOT NULL AND d.k IS NOT NULL AS divided FROM a FULL JOIN d ON a.k = d.k""")
def full_outer_sides(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda f, n: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias(n))
    m = side("A", "a_q").join(side("R", "d_q"), "k", "full")
    return m.withColumn("divided", F.col("a_q").isNotNull() & F.col("d_q").isNotNull())


@query(r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part) SELECT key, count(*) AS n, min(p_partkey) AS first FROM n GROUP BY 1 HAVING count(*) > 1""")
def name_normalise_join(spark, sf):
    """Records that share a normalised name."""
    d = table(spark, sf, "part").select("p_partkey", names.name_key(F.col("p_name")).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


# --- views ---------------------------------------------------------------------------------------------------------

@query("""WITH seg AS (SELECT p_partkey AS segment, CASE p_size % 6 WHEN 0 THEN 'Interstate' WHEN 1 THEN 'Principal Arterial' WHEN 2 THEN 'Minor Arterial' WHEN 3 THEN 'Collector' WHEN 4 THEN 'Local' ELSE 'Alley' END AS functional, p_size % 5 = 0 AS one_way, CASE p_size % 4 WHEN 0 THEN 'SH' WHEN 1 THEN 'US' ELSE 'LR' END AS rs FROM part),
r AS (SELECT l_partkey AS segment, CASE l_suppkey % 4 WHEN 0 THEN 'hpms' WHEN 1 THEN 'city' WHEN 2 THEN 'osm' ELSE 'regional' END AS source, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 6 + 1 END AS through, l_linenumber = 1 AS single_lane, l_discount AS share, l_tax AS confidence, l_orderkey * 10 + l_linenumber AS source_id FROM lineitem),
b AS (SELECT DISTINCT ON (segment, source) * FROM r ORDER BY segment, source, share DESC NULLS LAST, confidence DESC NULLS LAST, source_id),
w AS (SELECT segment, max(through) FILTER (source = 'hpms') AS h, max(through) FILTER (source = 'city') AS m, max(through) FILTER (source = 'osm') AS o, max(through) FILTER (source = 'regional') AS c, max(confidence * CASE WHEN single_lane THEN 0.5 ELSE 1 END) FILTER (source = 'hpms') AS hc, max(confidence * CASE WHEN single_lane THEN 0.5 ELSE 1 END) FILTER (source = 'city') AS mc, max(confidence * CASE WHEN single_lane THEN 0.5 ELSE 1 END) FILTER (source = 'osm') AS oc, max(confidence * CASE WHEN single_lane THEN 0.5 ELSE 1 END) FILTER (source = 'regional') AS cc FROM b GROUP BY 1),
k AS (SELECT seg.*, w.* EXCLUDE segment, CASE WHEN functional IN ('Interstate', 'Ramp') OR (functional IN ('Principal Arterial', 'Minor Arterial') AND rs IN ('SH', 'US', 'IN')) THEN 'state' WHEN functional IN ('Principal Arterial', 'Minor Arterial') OR m IS NOT NULL THEN 'arterial' WHEN functional IN ('Collector', 'Local') THEN 'local' ELSE 'other' END AS road_class FROM seg LEFT JOIN w USING (segment)),
u AS (SELECT *, CASE WHEN c IS NOT NULL AND (c <> 2 OR coalesce(CASE WHEN road_class = 'state' THEN h ELSE m END = 2, false) OR coalesce(o = 2, false)) THEN c END AS cu, CASE WHEN road_class = 'state' THEN h ELSE m END AS t1 FROM k),
s AS (SELECT *, CASE road_class WHEN 'state' THEN CASE WHEN h IS NOT NULL THEN 'hpms' WHEN o IS NOT NULL THEN 'osm' WHEN m IS NOT NULL THEN 'city' WHEN cu IS NOT NULL THEN 'regional' END WHEN 'arterial' THEN CASE WHEN m IS NOT NULL THEN 'city' WHEN o IS NOT NULL THEN 'osm' WHEN cu IS NOT NULL THEN 'regional' WHEN h IS NOT NULL THEN 'hpms' END
  WHEN 'local' THEN CASE WHEN o IS NOT NULL THEN 'osm' WHEN cu IS NOT NULL THEN 'regional' ELSE 'default' END ELSE CASE WHEN o IS NOT NULL THEN 'osm' WHEN m IS NOT NULL THEN 'city' WHEN cu IS NOT NULL THEN 'regional' WHEN h IS NOT NULL THEN 'hpms' END END AS source FROM u)
SELECT segment, road_class, CASE source WHEN 'default' THEN CASE WHEN one_way THEN 1 ELSE 2 END WHEN 'hpms' THEN h WHEN 'city' THEN m WHEN 'osm' THEN o WHEN 'regional' THEN cu END AS through, source, round(CASE source WHEN 'default' THEN 0.2 WHEN 'hpms' THEN hc WHEN 'city' THEN mc WHEN 'osm' THEN oc WHEN 'regional' THEN cc END, 4) AS confidence,
  coalesce(greatest(t1, o, cu) - least(t1, o, cu) > 1, false) AS conflict, concat_ws(',', 'hpms=' || h, 'city=' || m, 'osm=' || o, 'regional=' || c) AS candidates FROM s""")
def lanes_priority(spark, sf):
    """Parts stand in for road segments, line items for the sources' readings."""
    cls = F.element_at(F.array(*map(F.lit, ("Interstate", "Principal Arterial", "Minor Arterial", "Collector", "Local", "Alley"))), F.col("p_size") % 6 + 1)
    seg = table(spark, sf, "part").select(F.col("p_partkey").alias("segment"), cls.alias("functional"), (F.col("p_size") % 5 == 0).alias("one_way"), F.when(F.col("p_size") % 4 == 0, "SH").when(F.col("p_size") % 4 == 1, "US").otherwise("LR").alias("route_system"))
    src = F.element_at(F.array(*map(F.lit, ("hpms", "city", "osm", "regional"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    r = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("segment"), src.alias("source"), F.when(F.col("l_quantity") % 7 != 0, F.col("l_quantity").cast("int") % 6 + 1).alias("through"), (F.col("l_linenumber") == 1).alias("single_lane"),
        F.col("l_discount").alias("share"), F.col("l_tax").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"))
    return views.resolve_lanes(seg, r)


@query("""WITH s AS (SELECT o_orderkey AS k, max(l_quantity) FILTER (l_linenumber = 1) AS a, max(l_quantity) FILTER (l_linenumber = 2) AS b, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS opened FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END AS widest, a IS NOT NULL AND b IS NOT NULL AS both_known, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a > 0, false) OR coalesce(b > 0, false) END AS any_side, returned, opened, concat_ws(',', CASE WHEN returned THEN 'returned' END, CASE WHEN opened THEN 'opened' END) AS flags FROM s""")
def unpivot_flags(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    w = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    s = li.groupBy(F.col("l_orderkey").alias("k")).agg(w(1).alias("a"), w(2).alias("b"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("opened"))
    return views.cross_sections(s, "k", "a", "b", ["returned", "opened"]).withColumn("flags", F.array_join("flags", ","))


@query(f"""WITH r AS (SELECT DISTINCT ON (user_id) user_id AS path, ts AS seen, event_id AS report_id, event_type AS condition FROM events WHERE event_type <> 'view' ORDER BY user_id, ts DESC, event_id DESC), p AS (SELECT DISTINCT user_id AS path FROM events UNION SELECT -1)
SELECT path, report_id, CASE WHEN condition IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(seen))::BIGINT > 36000 THEN 'outdated' ELSE condition END AS state FROM p LEFT JOIN r USING (path)""")
def path_states(spark, sf):
    e = events(spark, sf)
    paths = e.select(F.col("user_id").alias("path")).union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()
    r = e.where("event_type <> 'view'").select(F.col("user_id").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("report_id"), F.col("event_type").alias("condition"))
    return views.path_states(paths, r, now(), 36000).select("path", "report_id", "state")


@query("""WITH f AS (SELECT l_suppkey AS field, list(l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS crops FROM lineitem GROUP BY 1), y AS (SELECT field, unnest(range(len(crops))) AS i, unnest(crops) AS crop FROM f) SELECT field, count(*) AS years, CAST(max(2000 + i) AS INT) AS newest, arg_max(crop, i) AS crop FROM y GROUP BY 1""")
def crop_years(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("field")).agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"))).alias("s"))
    y = views.crop_years(f.select("field", F.transform("s", lambda x: x["l_returnflag"]).alias("crops")), "field", 2000, "crops")
    return y.groupBy("field").agg(F.count("*").alias("years"), F.max("year").alias("newest"), F.max_by("crop", "year").alias("crop"))


# --- statistics ----------------------------------------------------------------------------------------------------

@query("""SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def status_pivot(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.flows(o, "n_name", "o_orderstatus", F.lit(1), ["F", "O"]).select("n_name", F.col("F").alias("f"), F.col("O").alias("o"), "other")


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS states, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY 1""")
def ordered_array_string_agg(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["o_orderkey"].cast("string")), ",").alias("orders"), F.max_by("o_orderkey", at).alias("last"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("states"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_quantity, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, round(quantile_cont(l_extendedprice, 0.9) FILTER (l_discount > 0.02), 4) AS q90 FROM lineitem GROUP BY 1, 2""")
def quantile_report(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.percentile("l_quantity", 0.25), 4).alias("q25"), F.round(F.median("l_extendedprice"), 4).alias("median_price"), F.round(F.percentile(F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")), 0.9), 4).alias("q90"))


HIST = "h AS (SELECT l_returnflag, CAST(least(greatest(floor(l_extendedprice / 110000 * 256), 0), 255) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY bin) AS k FROM c WHERE cum >= 0.5 * total)
SELECT l_returnflag, round((bin + (0.5 * total - (cum - n)) / n) * (110000 / 256), 4) AS quantile FROM r WHERE k = 1""")
def histogram_quantile(spark, sf):
    h = stats.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, 110000.0, 256)
    q = stats.histogram_quantile(h, ["l_returnflag"], 0.5, 0.0, 110000.0, 256)
    return q.select("l_returnflag", F.round("quantile", 4).alias("quantile"))


@query(f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY l_returnflag) AS total, sum(n * bin) OVER (PARTITION BY l_returnflag) AS ts FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin)),
b AS (SELECT l_returnflag, bin, n0 * (total - n0) * (s0 / n0 - (ts - s0) / (total - n0)) ** 2 AS v FROM c WHERE total > n0) SELECT l_returnflag, arg_max(bin, v) AS threshold_bin FROM b GROUP BY 1""")
def otsu_threshold(spark, sf):
    h = stats.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, 110000.0, 256)
    return stats.otsu(h, ["l_returnflag"]).select("l_returnflag", "threshold_bin")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(covar_samp(l_quantity, l_extendedprice) / 1000, 4) AS cov_k, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1""")
def covariance_accumulator(spark, sf):
    """By month first, then merged: the accumulators add up."""
    li = table(spark, sf, "lineitem").withColumn("month", F.month("l_shipdate"))
    s = stats.finish(stats.merge(stats.accumulate(li, ["l_returnflag", "month"], "l_quantity", "l_extendedprice"), ["l_returnflag"]))
    return s.select("l_returnflag", "n", F.round("mean_x", 6).alias("mean_x"), F.round(F.col("cov_xy") / 1000, 4).alias("cov_k"), F.round("corr", 6).alias("corr"))


@query("""WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS b FROM lineitem) SELECT l_suppkey, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_by_supplier(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount").select("l_suppkey", F.round("rho", 6).alias("rho"), "n")


@query("""WITH w AS (SELECT l_suppkey, p_type, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT l_suppkey, p_type, weight, round(weight / sum(weight) OVER (PARTITION BY l_suppkey), 6) AS share FROM w""")
def weighted_share(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.shares(j, ["l_suppkey"], ["p_type"], F.col("l_quantity")).withColumn("share", F.round("share", 6))


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS matching, count(*) AS total, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS agreement FROM lineitem GROUP BY 1""")
def zonal_agreement(spark, sf):
    return stats.agreement(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "N").withColumn("agreement", F.round("agreement", 6))


@query("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT DISTINCT ON (l_suppkey) l_suppkey, l_quantity, n FROM c ORDER BY l_suppkey, n DESC, l_quantity""")
def mode_with_ties(spark, sf):
    return stats.mode(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""WITH c(cycle) AS (VALUES (3600.0), (43200.0), (86400.0), (604800.0)), s AS (SELECT event_type, cycle, count(*) AS n, sqrt(sum(cos(epoch_us(ts) / 1e6 * (2 * pi() / cycle))) ** 2 + sum(sin(epoch_us(ts) / 1e6 * (2 * pi() / cycle))) ** 2) / count(*) AS r FROM events CROSS JOIN c GROUP BY 1, 2) SELECT event_type, n, CAST(arg_max(cycle, r) AS DOUBLE) AS cycle, round(max(r), 5) AS resultant FROM s GROUP BY 1, 2""")
def circular_best_cycle(spark, sf):
    s = stats.best_cycle(events(spark, sf), ["event_type"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, [3600.0, 43200.0, 86400.0, 604800.0])
    return s.withColumn("resultant", F.round("resultant", 5))


@query("""WITH f AS (SELECT p_brand, p_type, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1), a AS (SELECT avg(p_retailprice) AS m FROM part)
SELECT f.p_brand, f.p_type, round(CASE WHEN f.n >= 20 THEN f.m WHEN b.n >= 78 THEN b.m ELSE a.m END, 4) AS pooled, CASE WHEN f.n >= 20 THEN 0 WHEN b.n >= 78 THEN 1 ELSE 2 END AS level FROM f JOIN b USING (p_brand) CROSS JOIN a""")
def pooled_fallback(spark, sf):
    p = table(spark, sf, "part")
    d = stats.pooled(p, [["p_brand", "p_type"], ["p_brand"], []], "p_retailprice", [20, 78, 0])
    return d.withColumn("pooled", F.round("pooled", 4))


@query("""SELECT o_orderkey, spent FROM (SELECT o_orderkey, sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)) WHERE spent <= 50000000""")
def priority_budget(spark, sf):
    o = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return stats.spend(o, [F.col("o_orderpriority"), F.col("o_orderkey")], "cents", 50000000, ["o_custkey"]).select("o_orderkey", "spent")


# --- rules and gauges ----------------------------------------------------------------------------------------------

@query("""WITH d AS (SELECT o_orderkey, o_orderdate AS t FROM orders), f AS (SELECT o_orderkey, CASE WHEN t >= TIMESTAMP '1997-03-01' AND t < TIMESTAMP '1997-05-01' THEN 'closed' WHEN month(t) * 100 + day(t) >= 1101 OR month(t) * 100 + day(t) <= 215 THEN 'winter' WHEN isodow(t) IN (6, 7) THEN 'weekend' WHEN day(t) % 2 = 1 THEN 'odd' END AS value FROM d) SELECT o_orderkey, value FROM f""")
def yearly_rules_spans(spark, sf):
    """Each order falls into one span of the winning rules."""
    rules = spark.createDataFrame([
        ("r1", 0, "order", "closed", "1997-03-01", "1997-05-01", None, None, None, None), ("r2", 1, "season", "winter", None, None, 1101, 215, None, None),
        ("r3", 3, "default", "weekend", None, None, None, None, [5, 6], None), ("r4", 2, "default", "odd", None, None, None, None, None, list(range(1, 32, 2)))],
        "id string, position int, level string, value string, s string, e string, yearly_from int, yearly_to int, weekdays array<int>, monthdays array<int>")
    rules = rules.withColumn("starts", F.col("s").cast("timestamp")).withColumn("ends", F.col("e").cast("timestamp")).withColumn("minute_from", F.lit(None).cast("int")).withColumn("minute_to", F.lit(None).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    spans = temporal.timeline(rules, F.lit("1990-01-01").cast("timestamp"), F.lit("2005-01-01").cast("timestamp"))
    # Spans lie end to end: the newest that has begun is the one in force.
    d = latest.as_of_join(o.withColumn("k", F.lit(0)).withColumn("bucket", F.year("t")), spans.withColumn("bucket", F.explode(F.sequence(F.year("since"), F.year("until")))).withColumn("since2", F.greatest("since", F.make_timestamp("bucket", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))), ["bucket"], "t", "since2", ["value"])
    return d.select("o_orderkey", "value")


GAUGE = """r AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN value * 10 END AS flow, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS stage FROM events),
s AS (SELECT *, CASE WHEN flow IS NOT NULL THEN CASE WHEN flow >= 300 THEN 'on' ELSE 'off' END WHEN stage IS NULL THEN NULL WHEN stage >= 40 THEN 'on' WHEN stage <= 10 THEN 'off' END AS st FROM r),
k AS (SELECT *, count(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known FROM s), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM k WHERE known > 0)"""


@query(f"""WITH {GAUGE}, e AS (SELECT user_id, ts AS t, 1 AS k, event_id, st FROM n WHERE st IS NOT NULL UNION ALL SELECT user_id, ts + INTERVAL 86400 SECOND, 0, event_id, 'unknown' FROM n WHERE CASE WHEN nx IS NULL THEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 >= 86400 ELSE (epoch_us(nx) - epoch_us(ts)) / 1e6 > 86400 END),
c AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY t, k, event_id) AS p FROM e) SELECT user_id, st AS state, t AS since, lead(t) OVER (PARTITION BY user_id ORDER BY t, k, event_id) AS until FROM c WHERE p IS NULL OR p <> st""")
def gauge_deadband(spark, sf):
    r = events(spark, sf).select("user_id", "event_id", "ts", F.when(F.col("event_type") == "click", F.col("value") * 10).alias("flow"), F.when(F.col("event_type") != "error", F.col("value")).alias("stage"))
    return temporal.gauge_spans(r, "user_id", "ts", "event_id", temporal.gauge_state(F.col("flow"), F.col("stage"), 300.0, 40.0, 10.0), now(), 86400)


# --- scalar functions, graphs, grids -------------------------------------------------------------------------------

@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 2 = 0 AS even, json_extract(props, '$.missing') IS NULL AS lacks FROM events""")
def json_paths(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf).select("event_id", k.alias("k"), (k % 2 == 0).alias("even"), F.get_json_object("props", "$.missing").isNull().alias("lacks"))


@query(f"""WITH p AS ({PTS}) SELECT id, round(x / 100 - 117, 7) AS lon, round(y / 100 + 43.6, 7) AS lat FROM p""")
def utm_round_trip(spark, sf):
    """To metres and back: the series return the places they were given."""
    p = points(spark, sf)
    e, n = geo.to_utm(F.col("x") / 100 - 117, F.col("y") / 100 + 43.6, 11)
    lon, lat = geo.from_utm(F.col("e"), F.col("n"), 11)
    return p.select("id", e.alias("e"), n.alias("n")).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(f"""WITH p AS ({PTS}), q AS (SELECT id, x / 100 - 116.2 AS lon, y / 100 + 43.6 AS lat FROM p) SELECT id, round(2 * 6371008.8 * asin(sqrt(least(sin(radians(43.6 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(43.6)) * sin(radians(-116.2 - lon) / 2) ** 2, 1))), 3) AS metres FROM q""")
def haversine_distance(spark, sf):
    p = points(spark, sf).withColumn("lon", F.col("x") / 100 - 116.2).withColumn("lat", F.col("y") / 100 + 43.6)
    return p.select("id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(-116.2), F.lit(43.6)), 3).alias("metres"))


@query("""SELECT p_partkey, CAST(('0x' || substr(md5(concat_ws(':', p_brand, p_name)), 1, 12)) AS BIGINT) AS id FROM part""")
def short_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.short_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links, min(href) AS first_link FROM h GROUP BY 1""")
def html_listing_extract(spark, sf):
    from metrolith.sources.listings import links

    return links(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"), F.min("href").alias("first_link"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 3 AS a, c_custkey AS b FROM customer UNION SELECT c_custkey, c_custkey + c_nationkey FROM customer), r(node, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 20) SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def graph_reach(spark, sf):
    """Every customer has an edge from the one of a third of its number, and one to a later one; none is further than 20 steps."""
    c = table(spark, sf, "customer")
    e = c.select(F.expr("c_custkey div 3").alias("a"), F.col("c_custkey").alias("b")).union(c.select("c_custkey", F.col("c_custkey") + F.col("c_nationkey"))).distinct()
    return graph.reachable(e, spark.range(1, 2).select(F.col("id").alias("node")))


@query("""WITH RECURSIVE e AS (SELECT c_nationkey AS a, (c_custkey * 7) % 25 AS b, min(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) AS w FROM customer GROUP BY 1, 2), d(node, dist, i) AS (SELECT n, CASE WHEN n = 0 THEN 0 ELSE 1000000000000 END, 0 FROM range(25) t(n) UNION ALL SELECT * FROM (SELECT x.node, least(x.dist, coalesce(min(y.dist + e.w), 1000000000000)) AS dist, x.i + 1 AS i FROM d x LEFT JOIN e ON e.b = x.node LEFT JOIN d y ON y.node = e.a GROUP BY x.node, x.dist, x.i) WHERE i <= 25)
SELECT node, CAST(min(dist) AS DOUBLE) AS distance FROM d GROUP BY 1 HAVING min(dist) < 1000000000000""")
def shortest_ways(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_custkey") * 7) % 25).alias("b"), F.round(F.abs("c_acctbal") * 100).alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    return graph.distances(e, spark.range(1).select(F.col("id").alias("node"))).select("node", "distance")


GRID = "g AS (SELECT l_orderkey % 60 AS row, l_partkey % 50 AS col, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _grid(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 60).alias("row"), (F.col("l_partkey") % 50).alias("col")).agg(F.max("l_quantity").alias("v"))


@query(f"""WITH {GRID} SELECT a.row, a.col, a.v, round(avg(b.v), 6) AS focal_mean, min(b.v) AS focal_min, max(b.v) AS focal_max, count(*) AS focal_n FROM g a JOIN g b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3""")
def focal_3x3(spark, sf):
    return raster.focal(_grid(spark, sf), "v").withColumn("focal_mean", F.round("focal_mean", 6))


@query(f"""WITH RECURSIVE {GRID}, m AS (SELECT row, col, row * 50 + col AS id FROM g WHERE v < 47), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1), r(id, c) AS (SELECT id, id FROM m UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(c) AS clump FROM r GROUP BY 1)
SELECT m.row, m.col, clump, count(*) OVER (PARTITION BY clump) AS cells FROM c JOIN m USING (id)""")
def cell_clumps(spark, sf):
    return raster.components(_grid(spark, sf).where("v < 47"), 50).select("row", "col", "clump", "cells")


@query(f"""WITH {GRID} SELECT CAST(floor(row / 10) AS BIGINT) AS brow, CAST(floor(col / 10) AS BIGINT) AS bcol, count(*) AS n, max(v) AS top, count(*) FILTER (v > 45) AS high FROM g GROUP BY 1, 2""")
def block_stats(spark, sf):
    return raster.blocks(_grid(spark, sf), 10, [], [F.count("*").alias("n"), F.max("v").alias("top"), F.count_if(F.col("v") > 45).alias("high")])


@query("""WITH v AS (SELECT l_linenumber * 10 + l_orderkey % 10 AS lo, l_linenumber * 10 + l_orderkey % 10 + 7 AS hi, l_quantity AS q FROM lineitem), b AS (SELECT q, lo, hi, unnest(range(CAST(floor(lo / 4) AS BIGINT), CAST(ceil(hi / 4) AS BIGINT))) AS bin FROM v), w AS (SELECT bin, q, least(hi, (bin + 1) * 4) - greatest(lo, bin * 4) AS w FROM b)
SELECT bin, round(sum(q * w) / sum(w), 6) AS mean, CAST(sum(w) AS DOUBLE) AS covered FROM w WHERE w > 0 GROUP BY 1""")
def resample_overlap(spark, sf):
    lo = F.col("l_linenumber") * 10 + F.col("l_orderkey") % 10
    v = table(spark, sf, "lineitem").select(lo.cast("double").alias("lo"), (lo + 7).cast("double").alias("hi"), F.col("l_quantity").alias("q"))
    return raster.resample(v, 4.0, "lo", "hi", "q").withColumn("mean", F.round("mean", 6))


@query()
def spaced_peaks(spark, sf):
    return raster.spaced_peaks(points(spark, sf), "id", "value", 50.0)


@query()
def map_matching(spark, sf):
    """Users' events as fixes along two crossing lines."""
    import pandas as pd

    shapes = pd.DataFrame({"shape": ["a", "a", "b", "b"], "x": [0.0, 500.0, 0.0, 500.0], "y": [0.0, 100.0, 100.0, 0.0]})
    f = events(spark, sf).select(F.col("user_id").cast("string").alias("vehicle"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return transit.map_match(f, shapes, gap_s=86400.0)


# --- streams -------------------------------------------------------------------------------------------------------

@query("""SELECT DISTINCT user_id, ts FROM events""")
def stream_dedupe(spark, sf):
    """Every event comes twice, and is kept once."""
    s = streams.file_stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.run_available(streams.once_by_key(s.union(s), ["user_id", "ts"], "ts", "30 days"), "append")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_daily_windows(spark, sf):
    s = streams.file_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.windowed(s, "ts", "40 days", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    out = streams.run_available(w, "update", streams.newest_epoch(["start", "event_type"], ["n", "total"]))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s), g AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM t GROUP BY user_id, k)
SELECT user_id, start, n FROM g WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    s = streams.file_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_available(streams.session_windows(s, "ts", "1 hour", "6 hours", ["user_id"], [F.count("*").alias("n")]), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1""")
def stream_latest(spark, sf):
    s = streams.file_stream(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    s = s.select("user_id", "m.event_id", "m.ts")
    return streams.run_available(s, "update", streams.newest_epoch(["user_id"], ["event_id", "ts"]))


@query("""WITH weekly AS (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS seen_at, arg_max(event_type, (ts, event_id)) AS content FROM events WHERE user_id % 4 <> 1 OR dayofyear(ts) % 14 < 7 GROUP BY 1, 2), t AS (SELECT seen_at, row_number() OVER (ORDER BY seen_at) AS n FROM (SELECT DISTINCT seen_at FROM weekly)),
d AS (SELECT weekly.*, t.n, t.n - row_number() OVER (PARTITION BY user_id ORDER BY t.n) AS i FROM weekly JOIN t USING (seen_at)), r AS (SELECT user_id, i, min(seen_at) AS opened_at, max(n) AS l FROM d GROUP BY 1, 2), e AS (SELECT user_id, opened_at, t.seen_at AS closed_at FROM r LEFT JOIN t ON t.n = r.l + 1),
c AS (SELECT user_id, max(seen_at) AS content_at FROM (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY seen_at) AS p FROM weekly) WHERE p IS NULL OR p <> content GROUP BY 1),
l AS (SELECT user_id, min(opened_at) AS observed_lo, arg_max(CASE WHEN closed_at IS NULL THEN TIMESTAMP '9999-01-01' ELSE closed_at END, opened_at) AS hi, max(opened_at) AS o FROM e GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS source_id, observed_lo, nullif(hi, TIMESTAMP '9999-01-01') AS observed_hi, hi = TIMESTAMP '9999-01-01' AS active, greatest(o, content_at, CASE WHEN hi = TIMESTAMP '9999-01-01' THEN content_at ELSE hi END) AS updated_at FROM l JOIN c USING (user_id)""")
def stream_lifecycle(spark, sf):
    """Weekly snapshots merged one after the other: the same as lifecycles() has at once."""
    import uuid

    from metrolith.io import shared_dir

    e = events(spark, sf).where("user_id % 4 <> 1 or dayofyear(ts) % 14 < 7")
    weekly = e.groupBy("user_id", F.date_trunc("week", "ts").alias("seen_at")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content"))
    t = streams.SnapshotTable(spark, f"{shared_dir(spark)}/lifecycle-{uuid.uuid4().hex}")
    for n, r in enumerate(weekly.select("seen_at").distinct().orderBy("seen_at").collect()):  # one row for each snapshot
        at = F.lit(r["seen_at"].isoformat(" ")).cast("timestamp_ntz")
        t.merge(weekly.where(F.col("seen_at") == at).select(F.col("user_id").cast("string").alias("source_id"), F.col("content").alias("content_hash")), n, at)
    return t.at(t.versions[-1]).drop("content_hash")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS ts, event_id AS id, 'newest' AS placed FROM events""")
def stream_late_rows(spark, sf):
    s = streams.file_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("id"))
    return streams.run_available(streams.mark_late(s), "append")


@query(f"""WITH {GAUGE}, e AS (SELECT user_id, ts AS t, 1 AS k, event_id, st FROM n WHERE st IS NOT NULL UNION ALL SELECT user_id, ts + INTERVAL 86400 SECOND, 0, event_id, 'unknown' FROM n WHERE (epoch_us(nx) - epoch_us(ts)) / 1e6 > 86400),
c AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY t, k, event_id) AS p FROM e) SELECT CAST(user_id AS VARCHAR) AS key, st AS state, round(epoch_us(t) / 1e6, 3) AS since FROM c WHERE p IS NULL OR p <> st""")
def stream_gauge(spark, sf):
    e = streams.file_stream(spark, sf, "events")
    st = temporal.gauge_state(F.when(F.col("event_type") == "click", F.col("value") * 10), F.when(F.col("event_type") != "error", F.col("value")), 300.0, 40.0, 10.0)
    s = e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), st.alias("state"))
    return streams.run_available(streams.gauge_changes(s, 86400.0), "append").withColumn("since", F.round("since", 3))


# --- more of the same kinds ----------------------------------------------------------------------------------------

SEGS = """v AS (SELECT l_orderkey AS id, l_linenumber AS n, (l_orderkey % 400) * 60.0 + l_linenumber * 40.0 AS x, (l_orderkey // 400) * 10.0 + max(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
s AS (SELECT id, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(lead(x) OVER w AS DOUBLE) AS x1, CAST(lead(y) OVER w AS DOUBLE) AS y1 FROM v WINDOW w AS (PARTITION BY id ORDER BY n)), g AS (SELECT * FROM s WHERE x1 IS NOT NULL)"""


def _tracks(spark, sf):
    """Each order's items as a line: quantities against line numbers, every order at a place of its own."""
    v = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    v = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("v")).where("size(v) >= 2")
    return v.select(F.col("id").alias("line"), F.transform("v", lambda s: F.struct(((F.col("id") % 400) * 60.0 + s["n"] * 40.0).alias("x"), (F.floor(F.col("id") / 400) * 10.0 + s["q"]).alias("y"))).alias("points"))


@query(f"""WITH {SEGS}, c AS (SELECT a.id AS a, b.id AS b, a.x0, a.y0, a.x1 - a.x0 AS ux, a.y1 - a.y0 AS uy, b.x1 - b.x0 AS vx, b.y1 - b.y0 AS vy, b.x0 - a.x0 AS wx, b.y0 - a.y0 AS wy FROM g a JOIN g b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND least(a.y0, a.y1) <= greatest(b.y0, b.y1) AND least(b.y0, b.y1) <= greatest(a.y0, a.y1)),
t AS (SELECT *, (wx * vy - wy * vx) / nullif(ux * vy - uy * vx, 0) AS t, (wx * uy - wy * ux) / nullif(ux * vy - uy * vx, 0) AS u FROM c) SELECT a, b, count(*) AS n, round(min(x0 + t * ux), 4) AS first_x FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1, 2""")
def line_crossings(spark, sf):
    c = spatial.crossings(_tracks(spark, sf), "line", 25.0)
    return c.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.min("x"), 4).alias("first_x"))


@query()
def line_neighbours(spark, sf):
    return spatial.neighbours(_tracks(spark, sf), 8.0, 20.0, 40.0)


@query(f"""WITH p AS ({PTS}) SELECT a.id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 3 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30) AND a.kind <> 3""")
def points_apart(spark, sf):
    p = points(spark, sf)
    return spatial.apart(p.where("kind <> 3"), p.where("kind = 3"), 30.0, "id").select("id")


@query("""WITH m AS (SELECT o_orderkey AS target, o_orderpriority AS source, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey) SELECT source, count(DISTINCT target) AS lines, count(DISTINCT target) FILTER (l_linenumber IS NOT NULL) AS matched, count(l_linenumber) AS matches, round(count(DISTINCT target) FILTER (l_linenumber IS NOT NULL) / count(DISTINCT target), 6) AS covered FROM m GROUP BY 1""")
def coverage_report(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("source"))
    m = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("target"))
    return spatial.coverage(o, m, "source").withColumn("covered", F.round("covered", 6))


@query("""WITH s AS (SELECT p_name, min(p_size) AS v FROM part WHERE p_type = 'SMALL' GROUP BY 1), b AS (SELECT p_brand, min(p_size) AS v FROM part WHERE p_type = 'ECONOMY' GROUP BY 1) SELECT p_partkey, coalesce(s.v, b.v, -1) AS p_size FROM part p LEFT JOIN s USING (p_name) LEFT JOIN b USING (p_brand)""")
def lookup_fallback(spark, sf):
    p = table(spark, sf, "part")
    return stats.looked_up(p.drop("p_size"), [(p.where("p_type = 'SMALL'"), "p_name", "p_name"), (p.where("p_type = 'ECONOMY'"), "p_brand", "p_brand")], "p_size", F.lit(-1)).select("p_partkey", "p_size")


@query("""SELECT p_partkey, p_type FROM part WHERE p_type IN ('SMALL', 'LARGE')""")
def zoom_visibility(spark, sf):
    return stats.visible(table(spark, sf, "part"), "p_type", {"SMALL": 8, "LARGE": 10, "ECONOMY": 14}, 12).select("p_partkey", "p_type")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders),
r AS (SELECT o_custkey, k, o_orderkey, o_totalprice <= 500000.0 AS taken, CASE WHEN o_totalprice <= 500000.0 THEN 500000.0 - o_totalprice ELSE 500000.0 END AS rest FROM o WHERE k = 1
  UNION ALL SELECT o.o_custkey, o.k, o.o_orderkey, o.o_totalprice <= r.rest, CASE WHEN o.o_totalprice <= r.rest THEN r.rest - o.o_totalprice ELSE r.rest END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.k = r.k + 1)
SELECT o.o_custkey, o.o_orderpriority, o.o_orderkey, o.o_totalprice FROM r JOIN o USING (o_custkey, k) WHERE taken""")
def budget_with_skips(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return stats.spend_skipping(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "o_totalprice", 500_000.0)


@query(f"""WITH p AS ({PTS}), r(zone, x0, y0) AS (VALUES (1, -200, -200), (2, -100, -150)), c AS (SELECT zone, cx, cy FROM r, range(-40, 40) a(cx), range(-40, 40) b(cy) WHERE (cx + 0.5) * 10 BETWEEN x0 AND x0 + 150 AND (cy + 0.5) * 10 BETWEEN y0 AND y0 + 150)
SELECT a.zone AS a, b.zone AS b, count(*) * CAST(100 AS DOUBLE) AS area, round(count(*) / (SELECT count(*) FROM c WHERE zone = a.zone), 6) AS share FROM c a JOIN c b ON a.cx = b.cx AND a.cy = b.cy GROUP BY 1, 2""")
def overlap_shares(spark, sf):
    ring = lambda x, y: [(float(x), float(y)), (x + 150.0, float(y)), (x + 150.0, y + 150.0), (float(x), y + 150.0)]
    z = spark.createDataFrame([(1, ring(-200, -200)), (2, ring(-100, -150))], "zone int, ring array<struct<x:double,y:double>>")
    s = spatial.shared_area(z.withColumnRenamed("zone", "a"), z.withColumnRenamed("zone", "b"), 10.0, "a", "b")
    return s.withColumn("share", F.round("share", 6))


@query("""SELECT p_partkey, true AS agree FROM part""")
def street_names_agree(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("N "), F.col("p_name"), F.lit(" Road")).alias("a"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" Rd")).alias("b"))
    return p.select("p_partkey", names.names_agree(F.col("a"), F.col("b")).alias("agree"))


@query()
def vector_tiles(spark, sf):
    from metrolith.sources.sinks import vector_tiles as tiles

    p = points(spark, sf).withColumn("lon", F.col("x") / 100 - 116.2).withColumn("lat", F.col("y") / 100 + 43.6)
    return tiles(p, "points", "id", "lon", "lat", 8, ["kind", "value"])


@query("""WITH c AS (SELECT p_partkey, md5(p_name) AS h FROM part), r AS (SELECT p_partkey, CAST(('0x' || substr(h, 1, 2)) AS INT) / 255 AS r, CAST(('0x' || substr(h, 3, 2)) AS INT) / 255 AS g, CAST(('0x' || substr(h, 5, 2)) AS INT) / 255 AS b FROM c), l AS (SELECT p_partkey, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE ((r + 0.055) / 1.055) ** 2.4 END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE ((g + 0.055) / 1.055) ** 2.4 END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END AS b FROM r)
SELECT p_partkey, round(1.05 / (0.2126 * r + 0.7152 * g + 0.0722 * b + 0.05), 4) AS on_white FROM l""")
def colour_contrast(spark, sf):
    from metrolith.functions import color

    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)).alias("c"))
    return p.select("p_partkey", F.round(color.contrast(F.col("c"), F.lit("#ffffff")), 4).alias("on_white"))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'paved' WHEN p_size % 3 = 1 THEN 'gravel' END AS surface, count(*) AS n FROM part GROUP BY 1""")
def sql_functions(spark, sf):
    from metrolith.plans.scheduler import register_functions

    register_functions(spark)
    p = table(spark, sf, "part").withColumn("tag", F.when(F.col("p_size") % 3 == 0, "asphalt").when(F.col("p_size") % 3 == 1, "compacted").otherwise("x"))
    return p.select(F.expr("surface_class(tag)").alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))


from metrolith.plans import builds  # noqa: E402, F401  (registers its queries here)
