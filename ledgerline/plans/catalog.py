"""Registry of the log engine's queries, each over whole tables, and of DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.text import seconds_text
from ..operators import admit, log, metrics, read, repl, retain, views, wire
from ..plans.prefix import running
from ..schema import NO_HISTORY, record_size, unsigned_text
from ..shared import scratch_path
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# -- SQL of the fixtures

LOG = """log AS (
  SELECT event_id + 1 AS seq, user_id + 1 AS session,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS client_seq,
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS partition_key,
    CAST(1 AS BIGINT) AS term, CAST(0 AS INT) AS record_type,
    CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 7 ELSE 3 END AS INT) AS flags,
    CAST(octet_length(encode(props)) AS BIGINT) AS len,
    CAST(56 + CAST(floor((octet_length(encode(props)) + 7) / 8.0) AS BIGINT) * 8 AS BIGINT) AS rec_size, props
  FROM events)"""
REQUESTS = LOG + """, requests AS (
  SELECT (seq - 1) * 4 AS arrival, session, client_seq, partition_key, flags, len, seq AS origin FROM log
  UNION ALL
  SELECT (seq + 36) * 4 + 1, session, client_seq, partition_key, flags, len, seq FROM log WHERE (seq - 1) % 5 = 0)"""
GAPS = LOG + """, requests AS (
  SELECT CASE WHEN (seq - 1) % 11 = 0 THEN (seq + 399) * 4 + 2 ELSE (seq - 1) * 4 END AS arrival, session, client_seq, seq AS origin FROM log)"""
MIXED = REQUESTS + """, mixed AS (
  SELECT arrival, CASE WHEN arrival % 97 = 0 THEN 0 ELSE session END AS session, client_seq,
    CAST(CASE WHEN arrival % 13 = 0 THEN flags | 8 ELSE flags END AS INT) AS flags,
    CASE WHEN arrival % 89 = 0 THEN 2000000 ELSE len END AS len, arrival % 101 <> 0 AS leader,
    CASE WHEN arrival % 5 = 0 THEN 0 ELSE 1 END AS replicas FROM requests)"""
MARKS = "coalesce(max(client_seq) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
ACCEPTED = REQUESTS + f""", accepted AS (
  SELECT *, CAST(row_number() OVER (ORDER BY arrival) AS BIGINT) AS seq FROM (SELECT * FROM (SELECT *, {MARKS} AS mark FROM requests) WHERE client_seq > mark))"""
ACKS = ACCEPTED + """, acks AS (
  SELECT session, CAST(floor((seq - 1) / 64.0) AS BIGINT) AS batch, CASE WHEN flags & 4 <> 0 THEN 'replicated' ELSE 'local' END AS level,
    max(client_seq) AS client_seq, max(seq) AS wal_seq, CAST(bit_or(flags & 7) AS INT) AS flags FROM accepted WHERE flags & 1 <> 0 GROUP BY ALL)"""
STATUS = MIXED + """, folded AS (
  SELECT *, CASE WHEN session = 0 THEN 7 WHEN NOT leader THEN 5 WHEN flags & 4 <> 0 AND flags & 8 = 0 AND replicas = 0 THEN 10 END AS refused FROM mixed),
status AS (
  SELECT arrival, session, flags, replicas, CAST(coalesce(refused,
    CASE WHEN client_seq <= coalesce(max(CASE WHEN refused IS NULL AND len <= 1048576 THEN client_seq END) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN -1 END,
    CASE WHEN len > 1048576 THEN 4 END, 0) AS INT) AS status FROM folded)"""
SEGMENTS = LOG + ", segs AS (SELECT *, CAST(floor((seq - 1) / 500.0) AS BIGINT) * 500 + 1 AS seg_base FROM log)"
PEERS = LOG + ", peers AS (SELECT seq AS event, CAST(seq % 2 AS INT) AS slot, seq % 50 <> 0 AS live, greatest(seq - CASE WHEN seq % 2 = 0 THEN 5 ELSE 9 END, 0) AS durable FROM log)"
DECODED = SEGMENTS + """, dec AS (
  SELECT seg_base, (seq - seg_base) * 72 AS off, rec_size,
    CASE WHEN ((seg_base - 1) // 500) % 7 = 3 AND seq - seg_base = 450 THEN seq + 5 ELSE seq END AS seq,
    NOT (((seg_base - 1) // 500) % 3 = 1 AND seq - seg_base = 100 + (seg_base - 1) // 500) AS ok FROM segs),
placed AS (SELECT *, row_number() OVER (PARTITION BY seg_base ORDER BY off) - 1 AS k FROM dec),
good AS (SELECT *, min(CASE WHEN ok AND seq = seg_base + k THEN 1 ELSE 0 END) OVER (PARTITION BY seg_base ORDER BY off ROWS UNBOUNDED PRECEDING) AS g FROM placed),
scanned AS (SELECT seg_base, CAST(sum(g) AS BIGINT) AS records, max(CASE WHEN g = 1 THEN seq END) AS last_seq,
  CAST(coalesce(max(CASE WHEN g = 1 THEN off + rec_size END), 0) AS BIGINT) AS end_off, min(g) = 0 AS torn FROM good GROUP BY seg_base)"""


def pack_sql(source: str, capacity: int) -> str:
    return f"""WITH RECURSIVE {source}, p AS (SELECT seq, rec_size AS sz, sum(rec_size) OVER (ORDER BY seq) AS cum FROM lg),
st(base, cum0) AS (
  SELECT min(seq), CAST(0 AS HUGEINT) FROM p
  UNION ALL
  SELECT n.seq, n.cum - n.sz FROM st, LATERAL (SELECT p.seq, p.cum, p.sz FROM p WHERE p.seq >= st.base AND p.cum - st.cum0 > {capacity} ORDER BY p.seq LIMIT 1) n),
b AS (SELECT base, lead(base) OVER (ORDER BY base) AS nxt FROM st)
SELECT CAST(base AS BIGINT) AS seg_base, count(*) AS records, CAST(sum(rec_size) AS BIGINT) AS bytes
FROM b JOIN lg ON lg.seq >= base AND (nxt IS NULL OR lg.seq < nxt) GROUP BY base"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- codec rules, packing, scan


@query("SELECT doc_id, len, CASE WHEN len BETWEEN 0 AND 1048576 THEN CAST(56 + CAST(floor((len + 7) / 8.0) AS BIGINT) * 8 AS BIGINT) END AS rec_size FROM (SELECT doc_id, (doc_id * 7919) % 2000000 - 1000 AS len FROM documents)")
def record_sizes(spark, d):
    """O-03 over lengths in and out of range."""
    rows = fx.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 7919) % 2_000_000 - 1000).alias("len"))
    return rows.select("doc_id", "len", record_size(F.col("len")).alias("rec_size"))


NAMES = """names AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN lpad(CAST(event_id AS VARCHAR), 20, '0') || '.seg' WHEN 1 THEN lpad(CAST(event_id AS VARCHAR), 19, '0') || '.seg'
  WHEN 2 THEN lpad(CAST(event_id AS VARCHAR), 20, '0') || '.seg.tmp' WHEN 3 THEN '18446744073709551617.seg' WHEN 4 THEN '00000000000000000000.seg' ELSE lpad(CAST(event_id AS VARCHAR), 19, '0') || 'x.seg' END AS name FROM events)"""


@query(f"WITH {NAMES} SELECT event_id, name, CASE WHEN regexp_matches(name, '^[0-9]{{20}}\\.seg$') AND CAST(name[1:20] AS HUGEINT) BETWEEN 1 AND 18446744073709551615 THEN CAST(CAST(name[1:20] AS HUGEINT) AS VARCHAR) END AS base FROM names")
def segment_names(spark, d):
    """O-08: only exact names of 20 digits within 64 bits count."""
    e = F.col("event_id")
    k = e % 6
    padded = F.lpad(e.cast("string"), 20, "0")
    short = F.lpad(e.cast("string"), 19, "0")
    name = F.when(k == 0, log.segment_name(e)).when(k == 1, F.concat(short, F.lit(".seg"))).when(k == 2, F.concat(padded, F.lit(".seg.tmp"))).when(k == 3, "18446744073709551617.seg").when(k == 4, "00000000000000000000.seg").otherwise(F.concat(short, F.lit("x.seg")))
    return fx.table(spark, d, "events").select("event_id", name.alias("name")).withColumn("base", log.segment_base(F.col("name")).cast("string"))


@query("WITH f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 1297303382 END AS magic, CASE WHEN event_id % 13 = 0 THEN 3 ELSE 2 END AS version, event_id % 17 AS op, (event_id * 991) % 1100000 AS len FROM events) SELECT event_id, CAST(CASE WHEN magic <> 1297303382 THEN 1 WHEN version <> 2 THEN 2 WHEN op < 1 OR op > 13 THEN 3 WHEN len > 1048576 THEN 4 ELSE 0 END AS INT) AS err FROM f")
def frame_validity(spark, d):
    """O-15, O-16: header checks in order."""
    e = F.col("event_id")
    magic = F.when(e % 11 == 0, 1).otherwise(0x4D534756)
    version, op, length = F.when(e % 13 == 0, 3).otherwise(2), e % 17, (e * 991) % 1_100_000
    err = F.when(magic != 0x4D534756, 1).when(version != 2, 2).when((op < 1) | (op > 13), 3).when(length > 1 << 20, 4).otherwise(0)
    return fx.table(spark, d, "events").select("event_id", err.cast("int").alias("err"))


@query(f"WITH {LOG} SELECT seq, session, client_seq, partition_key, flags, len, rec_size FROM log")
def log_view(spark, d):
    """O-21 on the canonical log."""
    return fx.log(spark, d).select("seq", "session", "client_seq", "partition_key", "flags", "len", "rec_size")


@query(f"WITH {ACCEPTED} SELECT arrival, session, client_seq, seq FROM accepted")
def seq_assign(spark, d):
    """O-21 after admission: dense numbers in order of arrival."""
    kept = admit.dedup(fx.requests(spark, d)).where(~F.col("dup"))
    return log.assign_seq(kept).select("arrival", "session", "client_seq", "seq")


@query(pack_sql(LOG + ", lg AS (SELECT seq, rec_size FROM log)", 4096))
def segment_pack(spark, d):
    """O-22 over the canonical log."""
    return log.packed_segments(log.pack(fx.log(spark, d), 4096))


DOCLOG = "lg AS (SELECT row_number() OVER (ORDER BY doc_id) AS seq, CAST(56 + CAST(floor((octet_length(encode(text)) + 7) / 8.0) AS BIGINT) * 8 AS BIGINT) AS rec_size FROM documents)"


@query(pack_sql(DOCLOG, 262144))
def segment_pack_documents(spark, d):
    """O-22 over records of very unequal sizes."""
    return log.packed_segments(log.pack(fx.documents_log(spark, d), 262144))


@query(f"WITH {DECODED} SELECT seg_base, records, last_seq, end_off, torn FROM scanned")
def segment_scan_prefix(spark, d):
    """O-10: records up to a segment's first failure."""
    return log.scan_prefix(fx.decoded(spark, d))


@query(f"""WITH {DECODED}, o AS (SELECT seg_base, torn, coalesce(lag(last_seq) OVER w, lag(seg_base) OVER w - 1) AS prev, lead(seg_base) OVER w IS NULL AS last FROM scanned WINDOW w AS (ORDER BY seg_base))
SELECT seg_base, CASE WHEN torn AND NOT last THEN 'torn_middle' WHEN prev IS NULL OR prev + 1 = seg_base THEN 'ok' WHEN prev + 1 < seg_base THEN 'gap' ELSE 'overlap' END AS status FROM o""")
def log_open_check(spark, d):
    """O-11: each segment continues the one before; only the last may be torn."""
    return log.open_check(log.scan_prefix(fx.decoded(spark, d)))


# -- admission


@query(f"WITH {REQUESTS} SELECT arrival, session, client_seq, client_seq <= mark AS dup FROM (SELECT *, {MARKS} AS mark FROM requests)")
def admit_dedup(spark, d):
    """O-26, O-57: the high-water rule."""
    return admit.dedup(fx.requests(spark, d)).select("arrival", "session", "client_seq", "dup")


HIGH = LOG + """, high AS (SELECT arrival, session, CAST(client_seq AS HUGEINT) + 9223372036854775758 AS n, seq FROM
  (SELECT (seq - 1) * 4 AS arrival, session, client_seq, seq FROM log UNION ALL SELECT (seq + 36) * 4 + 1, session, client_seq, seq FROM log WHERE (seq - 1) % 5 = 0))"""


@query(f"WITH {HIGH} SELECT arrival, session, CAST(n AS VARCHAR) AS client_seq, n <= coalesce(max(n) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dup FROM high")
def admit_dedup_high(spark, d):
    """O-26 where client numbers pass 2^63: they are unsigned."""
    return admit.dedup(fx.high(fx.requests(spark, d))).select("arrival", "session", unsigned_text(F.col("client_seq")).alias("client_seq"), "dup")


@query(f"WITH {HIGH} SELECT session, CAST(max(n) AS VARCHAR) AS last_client_seq, max(seq) AS last_seq FROM high GROUP BY session ORDER BY last_seq DESC LIMIT 64")
def session_table_high(spark, d):
    """O-33 where client numbers pass 2^63."""
    table = views.session_table(fx.high(fx.log(spark, d)), 64)
    return table.select("session", unsigned_text(F.col("last_client_seq")).alias("last_client_seq"), "last_seq")


@query(f"WITH {GAPS} SELECT session, count(*) AS lost FROM (SELECT *, {MARKS} AS mark FROM requests) WHERE client_seq <= mark GROUP BY session")
def admit_gap_loss(spark, d):
    """O-26: writes acknowledged and lost because a later number came first."""
    return admit.dedup(fx.requests_gap(spark, d)).where("dup").groupBy("session").agg(F.count("*").alias("lost"))


@query(f"WITH {STATUS} SELECT arrival, status FROM status")
def admit_status(spark, d):
    """O-25, O-66: status of every write in the order of checks."""
    return admit.admit(fx.mixed_requests(spark, d), F.col("leader"), F.col("replicas")).select("arrival", "status")


@query(f"WITH {STATUS} SELECT arrival, CASE WHEN status = 5 THEN '203.0.113.7:4100' ELSE '' END AS text FROM status WHERE status > 0")
def refusal_texts(spark, d):
    """O-66: a follower's refusal names the leader."""
    told = admit.admit(fx.mixed_requests(spark, d), F.col("leader"), F.col("replicas")).where("status > 0")
    return told.select("arrival", admit.refusal_text(F.col("status"), "203.0.113.7:4100").alias("text"))


@query(f"WITH {MIXED} SELECT arrival, CASE WHEN flags & 1 = 0 THEN 'none' WHEN flags & 4 = 0 THEN 'local' WHEN replicas > 0 THEN 'wait' WHEN flags & 8 <> 0 THEN 'degraded' ELSE 'no_replicas' END AS route FROM mixed")
def ack_route(spark, d):
    """O-29."""
    return fx.mixed_requests(spark, d).select("arrival", admit.ack_route(F.col("flags"), F.col("replicas")).alias("route"))


def _acks(spark, d):
    kept = log.assign_seq(admit.dedup(fx.requests(spark, d)).where(~F.col("dup")))
    return admit.cumulative_acks(kept, F.floor((F.col("seq") - 1) / 64).cast("long"))


@query(f"WITH {ACKS} SELECT * FROM acks")
def group_commit_ack(spark, d):
    """O-27, O-28: one cumulative answer a session, flush and level."""
    return _acks(spark, d)


@query(f"WITH {ACCEPTED} SELECT CAST(floor((seq - 1) / 64.0) AS BIGINT) AS batch, count(*) AS records, max(seq) AS durable FROM accepted GROUP BY 1")
def group_commit(spark, d):
    """O-23, O-27: what each flush made durable."""
    kept = log.assign_seq(admit.dedup(fx.requests(spark, d)).where(~F.col("dup")))
    return kept.groupBy(F.floor((F.col("seq") - 1) / 64).cast("long").alias("batch")).agg(F.count("*").alias("records"), F.max("seq").alias("durable"))


# -- views


@query(f"WITH {SEGMENTS} SELECT count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT seg_base) AS segments FROM segs")
def log_summary(spark, d):
    """O-30."""
    return views.summary(fx.segments(spark, d))


@query(f"WITH {SEGMENTS} SELECT min(seq) AS first_seq, max(seq) AS durable_seq, max(seq) + 1 AS next_seq, count(DISTINCT seg_base) AS segments FROM segs")
def log_bounds(spark, d):
    """O-48."""
    return views.summary(fx.segments(spark, d)).select("first_seq", F.col("last_seq").alias("durable_seq"), (F.col("last_seq") + 1).alias("next_seq"), "segments")


@query(f"WITH {LOG} SELECT partition_key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records FROM log GROUP BY partition_key")
def key_index(spark, d):
    """O-31, O-12."""
    return views.key_index(fx.log(spark, d))


CAPPED = "SELECT k AS {k}, first_seq, last_seq, records FROM i WHERE rn <= {cap} UNION ALL SELECT NULL, NULL, NULL, CAST(coalesce(sum(records), 0) AS BIGINT) FROM i WHERE rn > {cap}"
INDEX = "i AS (SELECT {k} AS k, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records, row_number() OVER (ORDER BY min(seq)) AS rn FROM log GROUP BY {k})"


@query(f"WITH {LOG}, {INDEX.format(k='partition_key')} {CAPPED.format(k='partition_key', cap=3)}")
def key_index_capped(spark, d):
    """O-31 with a cap that bites; the rest counts as unknown."""
    return views.capped_index(fx.log(spark, d), 3)


@query(f"WITH {LOG}, {INDEX.format(k='session')} {CAPPED.format(k='session', cap=64)}")
def key_index_sessions(spark, d):
    """O-31 by session, cap 64."""
    return views.capped_index(fx.log(spark, d), 64, "session")


CONVLOG = "log AS (SELECT row_number() OVER (ORDER BY conv_id * 1024 + turn) AS seq, conv_id + 1 AS session, turn + 1 AS client_seq, conv_id AS partition_key FROM conversations)"


@query(f"WITH {CONVLOG}, {INDEX.format(k='partition_key')} {CAPPED.format(k='partition_key', cap=1024)}")
def key_index_conversations(spark, d):
    """O-31 at the default cap over a log of conversations."""
    return views.capped_index(fx.conversations_log(spark, d))


@query(f"""WITH {LOG}, i AS (SELECT partition_key AS k, min(seq) AS a, max(seq) AS b FROM log GROUP BY 1), q AS (SELECT user_id % 9 AS partition_key, event_id // 2 AS from_seq FROM events)
SELECT q.partition_key, from_seq, k IS NOT NULL AS found, CASE WHEN k IS NOT NULL THEN greatest(from_seq, a) END AS start_seq, b AS end_seq FROM q LEFT JOIN i ON q.partition_key = k""")
def key_range(spark, d):
    """O-32: ranges of asked keys, clamped; some keys are absent."""
    asked = fx.table(spark, d, "events").select((F.col("user_id") % 9).alias("partition_key"), F.floor(F.col("event_id") / 2).cast("long").alias("from_seq"))
    return views.key_range(views.key_index(fx.log(spark, d)), asked)


SESSIONS = "(SELECT session, max(client_seq) AS last_client_seq, max(seq) AS last_seq FROM log WHERE session <> 0 GROUP BY session ORDER BY last_seq DESC LIMIT {cap})"


@query(f"WITH {LOG} SELECT * FROM {SESSIONS.format(cap=64)}")
def session_table(spark, d):
    """O-33, cap 64."""
    return views.session_table(fx.log(spark, d), 64)


@query(f"WITH {LOG} SELECT * FROM {SESSIONS.format(cap=1024)}")
def session_table_default(spark, d):
    """O-33 at the default cap."""
    return views.session_table(fx.log(spark, d))


@query(f"WITH {LOG}, s AS {SESSIONS.format(cap=64)}, q AS (SELECT DISTINCT user_id * 3 + 1 AS session FROM events) SELECT q.session, last_client_seq AS mark, CAST(CASE WHEN s.session IS NULL THEN 8 ELSE 0 END AS INT) AS status FROM q LEFT JOIN s ON q.session = s.session")
def session_resume(spark, d):
    """O-36: unknown sessions stay unknown."""
    asked = fx.table(spark, d, "events").select((F.col("user_id") * 3 + 1).alias("session")).distinct()
    return views.resume(asked, views.session_table(fx.log(spark, d), 64))


@query(f"WITH {LOG}, b AS (SELECT seq, session, client_seq, lag(client_seq) OVER (PARTITION BY session ORDER BY seq) AS before FROM log) SELECT * FROM b WHERE client_seq <= before")
def session_marks_rise(spark, d):
    """The invariant behind O-33: no rows on an admitted log."""
    return views.marks_rise(fx.log(spark, d))


EVICTIONS = LOG + """, a AS (SELECT seq, session, lag(seq) OVER w AS p, lead(seq) OVER w AS n FROM log WHERE session <> 0 WINDOW w AS (PARTITION BY session ORDER BY seq)),
others AS (SELECT a.seq, count(b.seq) AS seen FROM a LEFT JOIN a b ON b.seq > a.p AND b.seq < a.seq AND (b.n IS NULL OR b.n > a.seq) WHERE a.p IS NOT NULL GROUP BY a.seq),
lru AS (SELECT greatest((SELECT count(DISTINCT session) FROM a) + (SELECT count(*) FROM others WHERE seen >= 64) - 64, 0) AS evicted, least((SELECT count(DISTINCT session) FROM a), 64) AS held)"""


@query(f"WITH {EVICTIONS} SELECT evicted, held FROM lru")
def session_evictions(spark, d):
    """O-34: evictions of a table of 64 sessions."""
    return views.evictions(fx.log(spark, d), 64, width=1000)


@query(f"""WITH {SEGMENTS}, k AS (SELECT partition_key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records FROM log GROUP BY 1)
SELECT 'key' AS kind, partition_key, first_seq, last_seq, records, CAST(NULL AS BIGINT) AS segments FROM k
UNION ALL SELECT 'log', NULL, min(seq), max(seq), count(*), count(DISTINCT seg_base) FROM segs
UNION ALL SELECT 'unknown', NULL, NULL, NULL, 0, NULL""")
def inspect(spark, d):
    """O-37: the report on a log, its summary and every key."""
    rows = fx.segments(spark, d)
    capped = views.capped_index(rows)
    kind = F.when(F.col("first_seq").isNull(), "unknown").otherwise("key")
    keys = capped.select(kind.alias("kind"), "partition_key", "first_seq", "last_seq", "records", F.lit(None).cast("long").alias("segments"))
    whole = views.summary(rows).select(F.lit("log").alias("kind"), F.lit(None).cast("long").alias("partition_key"), "first_seq", "last_seq", "records", "segments")
    return whole.unionByName(keys)


# -- reads and subscriptions

NOTIFY = "seq, record_type, len, partition_key, props AS payload"


def _readable(spark, d):
    return fx.log(spark, d).withColumnRenamed("props", "payload")


@query(f"WITH {LOG} SELECT {NOTIFY} FROM log WHERE partition_key = 3 AND seq BETWEEN 100 AND 700")
def read_key(spark, d):
    """O-40, O-46, O-47."""
    return read.read(_readable(spark, d), 3, 100, 700)


@query(f"WITH {LOG} SELECT {NOTIFY} FROM log")
def read_all(spark, d):
    """O-41."""
    return read.read(_readable(spark, d))


@query(f"WITH {LOG} SELECT {NOTIFY} FROM log WHERE false")
def read_absent(spark, d):
    """O-42: a key known to be absent reads nothing."""
    return read.read(_readable(spark, d), 77, until=1000, key_bounds=(1, 0))


@query(f"WITH {LOG}, b AS (SELECT max(seq) // 2 AS durable FROM log) SELECT {NOTIFY} FROM log, b WHERE partition_key = 2 AND seq <= durable")
def read_snapshot(spark, d):
    """O-43: what was durable at the request bounds the read."""
    rows = _readable(spark, d)
    return read.read(rows, 2, until=read.bounds(rows)[1] // 2)


@query(f"WITH {LOG} SELECT {NOTIFY}, 0 AS flags FROM log WHERE partition_key = 4 AND seq <= 900 UNION ALL SELECT 900, NULL, NULL, NULL, NULL, 32")
def read_terminator(spark, d):
    """O-44: the read ends with a marked empty row."""
    return read.read(_readable(spark, d), 4, until=900, terminator=True)


@query(f"WITH {LOG}, b AS (SELECT max(seq) AS durable FROM log) SELECT event_id, CAST(CASE WHEN durable >= event_id * 2 THEN 0 ELSE 6 END AS INT) AS status FROM events, b")
def read_barrier(spark, d):
    """O-45: asked positions against the durable one."""
    durable = read.bounds(fx.log(spark, d))[1]
    return fx.table(spark, d, "events").select("event_id", read.barrier_status(F.col("event_id") * 2, F.lit(durable)).alias("status"))


@query(f"WITH {SEGMENTS}, b AS (SELECT max(seq) AS durable FROM log) SELECT event_id * 2 AS asked, CAST(CASE WHEN event_id * 2 < 501 OR event_id * 2 > durable + 1 THEN 11 ELSE 0 END AS INT) AS status FROM events, b")
def seek_status(spark, d):
    """O-13, O-49, on a log whose first segment is gone."""
    durable = read.bounds(fx.log(spark, d))[1]
    asked = F.col("event_id") * 2
    return fx.table(spark, d, "events").select(asked.alias("asked"), read.seek_status(asked, F.lit(501), F.lit(durable)).alias("status"))


@query(f"WITH {SEGMENTS}, q AS (SELECT event_id AS request, event_id * 7 % (SELECT max(seq) FROM log) + 1 AS asked FROM events) SELECT request, asked, CAST(floor((asked - 1) / 500.0) AS BIGINT) * 500 + 1 AS seg_base FROM q")
def seek_segment(spark, d):
    """O-13: the segment of the greatest base at or below a position."""
    bases = fx.segments(spark, d).select("seg_base").distinct()
    durable = read.bounds(fx.log(spark, d))[1]
    asked = fx.table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("event_id") * 7 % durable + 1).alias("asked"))
    # bases and positions merged in one order; each position takes the last base at or before it
    merged = bases.select((F.col("seg_base") * 2).alias("o"), "seg_base").unionByName(asked.select((F.col("asked") * 2 + 1).alias("o"), F.lit(None).cast("long").alias("seg_base")).distinct())
    found = running(merged, [], "o", F.col("seg_base"), "base", "max").where("seg_base IS NULL").select(F.floor((F.col("o") - 1) / 2).cast("long").alias("asked"), F.col("base").alias("seg_base"))
    return asked.join(found, "asked").select("request", "asked", "seg_base")


@query(f"""WITH {LOG}, c AS (SELECT *, sum(rec_size) OVER (ORDER BY seq) AS bytes FROM log WHERE seq BETWEEN 400 AND 1000)
SELECT seq, rec_size FROM c WHERE bytes <= 8192""")
def cursor_read(spark, d):
    """O-14: whole records from a position, within a limit and a buffer."""
    rows = fx.log(spark, d).where(F.col("seq").between(400, 1000)).select("seq", "rec_size")
    return running(rows, [], "seq", F.col("rec_size"), "bytes").where("bytes <= 8192").select("seq", "rec_size")


@query(f"WITH {LOG}, s AS (SELECT greatest(300, min(seq)) AS start FROM log WHERE partition_key = 1) SELECT {NOTIFY} FROM log, s WHERE seq >= start AND partition_key = 1")
def subscribe_from(spark, d):
    """O-50, O-51 as a batch: from the effective start of a key on."""
    rows = _readable(spark, d)
    first = rows.where("partition_key = 1").agg(F.min("seq")).first()[0]
    return read.read(rows, 1, max(300, first or 1))


@query(f"WITH {SEGMENTS}, q AS (SELECT seq AS cursor_seq FROM log) SELECT cursor_seq, cursor_seq < 1001 AS stranded FROM q")
def stranded_readers(spark, d):
    """O-54: readers that retention passed, were the log to start at 1001."""
    return fx.log(spark, d).select(F.col("seq").alias("cursor_seq"), (read.seek_status(F.col("seq"), F.lit(1001), F.lit(1 << 40)) == NO_HISTORY).alias("stranded"))


# -- replication

INCOMING = LOG + ", inc AS (SELECT seq AS arrival, CASE WHEN seq = 7 * (SELECT max(seq) FROM log) // 8 THEN seq + 1 ELSE seq END AS seq, rec_size FROM log)"


def _incoming(spark, d):
    rows = fx.log(spark, d)
    last = read.bounds(rows)[1]
    return rows.select(F.col("seq").alias("arrival"), F.when(F.col("seq") == 7 * last // 8, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), F.lit(True).alias("ok"))


@query(f"WITH {LOG}, h AS (SELECT seq FROM log WHERE seq % 37 <> 0) SELECT seq FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS b FROM h) WHERE b IS NOT NULL AND seq <> b + 1")
def repl_continuity(spark, d):
    """O-24: records that don't continue the one before."""
    return repl.breaks(fx.log(spark, d).where(F.col("seq") % 37 != 0))


@query(pack_sql(LOG + ", lg AS (SELECT seq, rec_size FROM log)", 16352))
def repl_frames(spark, d):
    """O-61: whole records in frames of 16 KiB."""
    return repl.frames(fx.log(spark, d))


@query(f"WITH {INCOMING} SELECT arrival, seq FROM (SELECT *, min(CASE WHEN seq = arrival THEN 1 ELSE 0 END) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS g FROM inc) WHERE g = 1")
def repl_apply(spark, d):
    """O-62: all before the first record that does not continue."""
    return repl.apply_prefix(_incoming(spark, d), 1).select("arrival", "seq")


@query(f"WITH {LOG} SELECT CAST(floor((seq - 1) / 64.0) AS BIGINT) AS batch, max(seq) AS durable FROM log GROUP BY 1")
def repl_progress(spark, d):
    """O-63: a report for each flush."""
    return repl.progress(fx.log(spark, d), F.floor((F.col("seq") - 1) / 64).cast("long"))


@query(f"WITH {LOG}, b AS (SELECT max(seq) AS last FROM log) SELECT event_id * 2 AS asked, CAST(CASE WHEN event_id % 19 = 0 THEN 5 WHEN event_id % 23 = 0 THEN 9 WHEN event_id * 2 < 51 OR event_id * 2 > last + 1 THEN 11 ELSE 0 END AS INT) AS status FROM events, b")
def repl_start_status(spark, d):
    """O-60."""
    e = F.col("event_id")
    last = read.bounds(fx.log(spark, d))[1]
    return fx.table(spark, d, "events").select((e * 2).alias("asked"), repl.start_status(e * 2, F.lit(51), F.lit(last + 1), e % 19 == 0, e % 23 == 0).alias("status"))


@query(f"""WITH {PEERS}, m AS (SELECT event, max(CASE WHEN live THEN durable END) OVER (ORDER BY event ROWS UNBOUNDED PRECEDING) AS best FROM peers),
f AS (SELECT best, min(event) AS event FROM m WHERE best IS NOT NULL GROUP BY best), x AS (SELECT seq FROM log)
SELECT seq, event FROM x ASOF LEFT JOIN f ON x.seq <= f.best""")
def quorum_ack(spark, d):
    """O-64: the report at which each record had its second copy."""
    rows = fx.log(spark, d)
    return repl.quorum(rows.select("seq"), fx.peers(spark, d), read.bounds(rows)[1])


@query(SQL["quorum_ack"].replace("SELECT seq, event FROM x", ", q AS (SELECT x.seq, event FROM x").replace("x.seq <= f.best", "x.seq <= f.best)") + " SELECT seq, CASE WHEN event <= seq + 6 THEN 'ack' WHEN seq % 2 = 0 THEN 'degraded' ELSE 'no_replicas' END AS outcome FROM q JOIN log USING (seq) WHERE flags & 4 <> 0")
def degrade_or_refuse(spark, d):
    """O-65 for replicated writes: whether the quorum of O-64 was there within six reports."""
    s = F.col("seq")
    flags = F.when(s % 2 == 0, F.col("flags").bitwiseOR(F.lit(8))).otherwise(F.col("flags"))
    waits = fx.log(spark, d).where(F.col("flags").bitwiseAND(F.lit(4)) != 0).select("seq", flags.alias("flags"))
    done = quorum_ack(spark, d).select("seq", "event")
    return waits.join(done, "seq").select("seq", repl.outcome(F.col("flags"), F.coalesce(F.col("event") <= s + 6, F.lit(False))).alias("outcome"))


@query("WITH a AS (SELECT user_id % 2 AS slot, event_id AS attempt, CASE event_type WHEN 'error' THEN 11 WHEN 'purchase' THEN 9 ELSE 0 END AS code FROM events), b AS (SELECT *, lag(code) OVER (PARTITION BY slot ORDER BY attempt) AS before FROM a) SELECT slot, attempt, code FROM b WHERE code <> 0 AND (before IS NULL OR before <> code)")
def refusal_log(spark, d):
    """O-67: a refusal is logged once per change."""
    code = F.when(F.col("event_type") == "error", 11).when(F.col("event_type") == "purchase", 9).otherwise(0)
    return repl.refusals_to_log(fx.table(spark, d, "events").select((F.col("user_id") % 2).alias("slot"), F.col("event_id").alias("attempt"), code.alias("code")))


@query(f"WITH {LOG}, a AS (SELECT seq FROM log WHERE seq % 101 <> 0), b AS (SELECT seq FROM log WHERE seq % 89 <> 0) SELECT seq, 'left' AS side FROM a WHERE seq NOT IN (SELECT seq FROM b) UNION ALL SELECT seq, 'right' FROM b WHERE seq NOT IN (SELECT seq FROM a)")
def log_diff(spark, d):
    """O-68: records that only one of two logs has."""
    rows = fx.log(spark, d).select("seq")
    return repl.difference(rows.where(F.col("seq") % 101 != 0), rows.where(F.col("seq") % 89 != 0))


@query(f"WITH {LOG} SELECT 'a' AS name, max(seq) AS last_seq FROM log WHERE seq % 101 <> 0 UNION ALL SELECT 'b', max(seq) FROM log WHERE seq % 2 <> 0")
def log_further(spark, d):
    """O-68: which stopped log is further along."""
    rows = fx.log(spark, d)
    return repl.further({"a": rows.where(F.col("seq") % 101 != 0), "b": rows.where(F.col("seq") % 2 != 0)})


# -- retention

FLOOR = PEERS + """, st AS (SELECT event, max(CASE WHEN slot = 0 THEN event END) OVER w AS e0, max(CASE WHEN slot = 1 THEN event END) OVER w AS e1 FROM peers WINDOW w AS (ORDER BY event ROWS UNBOUNDED PRECEDING)),
paired AS (SELECT st.event, CASE WHEN a.live AND b.live THEN least(a.durable, b.durable) END AS now FROM st LEFT JOIN peers a ON a.event = e0 LEFT JOIN peers b ON b.event = e1),
fl AS (SELECT event, coalesce(max(now) OVER (ORDER BY event ROWS UNBOUNDED PRECEDING), 0) AS floor FROM paired)"""
MARK = "mk AS (SELECT coalesce((SELECT seg_base FROM (SELECT seg_base, row_number() OVER (ORDER BY seg_base DESC) AS rn FROM (SELECT DISTINCT seg_base FROM segs)) WHERE rn = {n} AND EXISTS (SELECT 1 FROM (SELECT DISTINCT seg_base FROM segs) HAVING count(*) > {n})), 0) AS keep_from)"


@query(f"WITH {SEGMENTS}, {MARK.format(n=4)} SELECT CAST(keep_from AS BIGINT) AS keep_from FROM mk")
def retain_mark(spark, d):
    """O-70."""
    return retain.mark(fx.segments(spark, d), 4)


NEXT = "nx AS (SELECT seg_base, lead(seg_base) OVER (ORDER BY seg_base) AS n FROM (SELECT DISTINCT seg_base FROM segs))"


@query(f"WITH {SEGMENTS}, {MARK.format(n=4)}, {NEXT} SELECT seg_base FROM nx, mk WHERE n <= keep_from")
def retain_drop(spark, d):
    """O-71."""
    rows = fx.segments(spark, d)
    return retain.drop(rows, retain.mark(rows, 4))


@query(f"WITH {FLOOR} SELECT event, floor FROM fl")
def retain_floor(spark, d):
    """O-72."""
    return retain.floor(fx.peers(spark, d), 2)


@query(f"WITH {FLOOR}, segs AS (SELECT *, CAST(floor((seq - 1) / 500.0) AS BIGINT) * 500 + 1 AS seg_base FROM log), {MARK.format(n=2)}, {NEXT}, lim AS (SELECT least(keep_from, (SELECT max(floor) FROM fl) // 2 + 1) AS k FROM mk) SELECT seg_base FROM nx, lim WHERE n <= k")
def retain_pass(spark, d):
    """O-73: a pass under the mark and half the final floor."""
    last = retain.floor(fx.peers(spark, d), 2).agg(F.max("floor")).first()[0]
    return retain.retain(fx.segments(spark, d), 2, last // 2)


@query(f"WITH {LOG}, k AS (SELECT DISTINCT session FROM log WHERE seq >= (SELECT max(seq) - 200 FROM log)) SELECT DISTINCT session FROM log WHERE session NOT IN (SELECT session FROM k)")
def sessions_forgotten(spark, d):
    """O-74: sessions without a record once only the last 201 are retained."""
    rows = fx.log(spark, d)
    return retain.forgotten(rows, read.bounds(rows)[1] - 200)


# -- metrics


@query(f"""WITH {ACKS}, s AS (SELECT CASE WHEN flags & 4 <> 0 AND batch % 3 = 0 THEN (CASE WHEN batch % 2 = 0 THEN flags - (flags & 2) ELSE flags END) | 16 ELSE flags END AS flags FROM acks),
l AS (SELECT flags, CASE WHEN flags & 4 <> 0 AND flags & 16 = 0 THEN 'replicated' WHEN flags & 2 <> 0 THEN 'sync' ELSE 'append' END AS label FROM s), d AS (SELECT unnest(['append', 'sync', 'replicated']) AS label)
SELECT 'acks_total' AS metric, d.label, count(l.label) AS value FROM d LEFT JOIN l ON d.label = l.label GROUP BY d.label UNION ALL SELECT 'acks_degraded_total', '', count(*) FILTER (flags & 16 <> 0) FROM l""")
def metrics_acks(spark, d):
    """O-86; of the replicated answers some were degraded, and of these some had no flush to wait for."""
    flags, batch = F.col("flags"), F.col("batch")
    given_up = (flags.bitwiseAND(F.lit(4)) != 0) & (batch % 3 == 0)
    sent = F.when(given_up, F.when(batch % 2 == 0, flags - flags.bitwiseAND(F.lit(2))).otherwise(flags).bitwiseOR(F.lit(16))).otherwise(flags)
    return metrics.acks(_acks(spark, d).withColumn("flags", sent))


@query(f"""WITH {STATUS}, l AS (SELECT CASE status WHEN 5 THEN 'not_leader' WHEN 10 THEN 'no_replicas' WHEN 6 THEN 'behind' WHEN 11 THEN 'no_history' WHEN 12 THEN 'storage' ELSE 'other' END AS label FROM status WHERE status > 0),
d AS (SELECT unnest(['not_leader', 'no_replicas', 'behind', 'no_history', 'storage', 'other']) AS label)
SELECT 'refused_total' AS metric, d.label, count(l.label) AS value FROM d LEFT JOIN l ON d.label = l.label GROUP BY d.label""")
def metrics_refused(spark, d):
    """O-87."""
    return metrics.refused(admit.admit(fx.mixed_requests(spark, d), F.col("leader"), F.col("replicas")))


@query(f"WITH {STATUS} SELECT 'writes_total' AS metric, '' AS label, count(*) FILTER (status = 0) AS value FROM status UNION ALL SELECT 'dedup_hits_total', '', count(*) FILTER (status = -1) FROM status")
def metrics_writes(spark, d):
    """O-85."""
    return metrics.writes(admit.admit(fx.mixed_requests(spark, d), F.col("leader"), F.col("replicas")))


@query("""WITH d AS (SELECT * FROM (VALUES ('0.5', 0.5), ('1', 1.0), ('2', 2.0), ('5', 5.0), ('10', 10.0), ('20', 20.0), ('50', 50.0)) t(le, b))
SELECT 'fsync_seconds_bucket' AS metric, le, count(*) FILTER (value <= b) AS value FROM d, events GROUP BY le, b
UNION ALL SELECT 'fsync_seconds_bucket', '+Inf', count(value) FROM events UNION ALL SELECT 'fsync_seconds_count', '', count(value) FROM events
UNION ALL SELECT 'fsync_seconds_sum', '', CAST(coalesce(sum(CAST(round(value * 1000000) AS BIGINT)), 0) AS BIGINT) FROM events""")
def metrics_hist(spark, d):
    """O-89 with events.value as milliseconds."""
    return metrics.histogram(fx.table(spark, d, "events"), "value")


@query(f"WITH {ACCEPTED} SELECT 'flushes_total' AS metric, '' AS label, count(DISTINCT floor((seq - 1) / 64.0)) AS value FROM accepted")
def metrics_flushes(spark, d):
    """O-89: flushes that made something durable."""
    return metrics.flushes(group_commit(spark, d))


@query(f"""WITH {SEGMENTS}, s AS (SELECT min(seq) AS a, max(seq) AS b, count(DISTINCT seg_base) AS n FROM segs)
SELECT 'first_seq' AS metric, '' AS label, a AS value FROM s UNION ALL SELECT 'durable_seq', '', b FROM s UNION ALL SELECT 'next_seq', '', b + 1 FROM s UNION ALL SELECT 'segments', '', n FROM s
UNION ALL SELECT 'segment_bytes', '', 36000 FROM s UNION ALL SELECT 'wal_bytes', '', n * 36000 FROM s""")
def metrics_log(spark, d):
    """O-81."""
    return metrics.log_gauges(views.summary(fx.segments(spark, d)), 36_000)


@query("SELECT * FROM (VALUES ('role', 'leader', CAST(1 AS BIGINT)), ('role', 'follower', CAST(0 AS BIGINT))) t(metric, label, value)")
def metrics_role(spark, d):
    """O-80."""
    return metrics.role(spark, True)


@query(f"""WITH {FLOOR}, p AS (SELECT event, floor, event // 500 % 3 AS removed, event // 500 % 4 = 3 AS failed FROM fl WHERE event % 500 = 0)
SELECT 'retain_segments' AS metric, '' AS label, CAST(4 AS BIGINT) AS value UNION ALL SELECT 'replicas_expected', '', 2 UNION ALL SELECT 'retain_floor', '', CAST(coalesce(arg_max(floor, event), 0) AS BIGINT) FROM p
UNION ALL SELECT 'retain_removed_total', '', CAST(coalesce(sum(removed), 0) AS BIGINT) FROM p UNION ALL SELECT 'retain_errors_total', '', count(*) FILTER (failed) FROM p""")
def metrics_retain(spark, d):
    """O-82 over passes at every 500th report."""
    turn = F.floor(F.col("event") / 500)
    passes = retain.floor(fx.peers(spark, d), 2).where("event % 500 = 0").select("event", "floor", (turn % 3).alias("removed"), (turn % 4 == 3).alias("failed"))
    return metrics.retention(passes, 4, 2)


@query(f"WITH {EVICTIONS} SELECT 'sessions' AS metric, '' AS label, held AS value FROM lru UNION ALL SELECT 'sessions_evicted_total', '', evicted FROM lru")
def metrics_sessions(spark, d):
    """O-83: sessions held and evicted by a table of 64."""
    return metrics.sessions(session_evictions(spark, d))


@query(f"""WITH {PEERS}, l AS (SELECT * FROM peers QUALIFY row_number() OVER (PARTITION BY slot ORDER BY event DESC) = 1), n AS (SELECT max(event) * 1000000 - 500000 AS now FROM peers)
SELECT 'follower_live' AS metric, CAST(slot AS VARCHAR) AS label, CAST(live AS BIGINT) AS value FROM l UNION ALL SELECT 'follower_durable_seq', CAST(slot AS VARCHAR), CASE WHEN live THEN durable ELSE 0 END FROM l
UNION ALL SELECT 'follower_ack_age_seconds', CAST(slot AS VARCHAR), CAST(greatest(now - event * 1000000, 0) AS BIGINT) FROM l, n""")
def metrics_followers(spark, d):
    """O-84 of a leader, half a report before the last."""
    peers = fx.peers(spark, d)
    now = peers.agg(F.max("event")).first()[0] * 1_000_000 - 500_000
    return metrics.followers(peers.withColumn("at", F.col("event") * 1_000_000), F.lit(now))


@query(f"WITH {LOG} SELECT 'repl_records_total' AS metric, '' AS label, count(*) AS value FROM log")
def metrics_sent(spark, d):
    """O-84 of a leader: records in the frames that it sent."""
    return metrics.sent(repl.frames(fx.log(spark, d)))


@query(SQL["repl_apply"].replace("SELECT arrival, seq FROM", "SELECT 'repl_applied_total' AS metric, '' AS label, count(*) AS value FROM") + " UNION ALL SELECT 'leader_connected', '', 1")
def metrics_following(spark, d):
    """O-84 of a follower."""
    return metrics.following(repl_apply(spark, d), True)


@query(f"WITH {LOG} SELECT 'notified_total' AS metric, '' AS label, count(*) AS value FROM log WHERE partition_key = 3")
def metrics_notified(spark, d):
    """O-88: records that a subscriber of one key was sent."""
    return read.notify(_readable(spark, d).where("partition_key = 3")).agg(F.count("*").alias("value")).select(F.lit("notified_total").alias("metric"), F.lit("").alias("label"), "value")


@query("SELECT event_id, CAST(event_id * 123456789 // 1000000000 AS VARCHAR) || '.' || lpad(CAST(event_id * 123456789 % 1000000000 AS VARCHAR), 9, '0') AS seconds FROM events")
def seconds_format(spark, d):
    """O-91."""
    return fx.table(spark, d, "events").select("event_id", seconds_text(F.col("event_id") * 123456789).alias("seconds"))


# -- segments and streams, through the shared folder


def _stored(spark, d) -> DataFrame:
    """The canonical log's rows as the segment writer takes them."""
    return _readable(spark, d).select(F.lit(0).cast("long").alias("crc"), "len", "term", "seq", "session", "client_seq", "record_type", "flags", "partition_key", F.encode("payload", "UTF-8").alias("payload"))


def _append(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("seq").sortWithinPartitions("seq").write.format("seglog").option("capacity", 1 << 16).mode("append").save(path)


def _written_log(spark, d) -> str:
    """The canonical log written as segments; its path."""
    from ..sources import seglog

    seglog.register(spark)
    path = scratch_path(spark, "seglog")
    _append(_stored(spark, d), path)
    return path


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is at its end, by a checkpointed file sink."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {LOG} SELECT seq, session, client_seq, partition_key, flags, len, rec_size, props AS payload FROM log")
def seg_roundtrip(spark, d):
    """O-04 to O-07, O-09, O-20: the log written as segments and read back through the data source."""
    from ..sources import seglog

    log_read = seglog.open_log(spark, _written_log(spark, d))
    return log_read.select("seq", "session", "client_seq", "partition_key", "flags", "len", "rec_size", F.decode("payload", "UTF-8").alias("payload"))


@query(SQL["subscribe_from"].replace("greatest(300, min(seq))", "300").replace("FROM log WHERE partition_key = 1) SELECT", ") SELECT"))
def subscribe_stream(spark, d):
    """O-50, O-52: a stream from seq 300 over one key, run to the durable end."""
    from ..streaming import log_streams

    got = _drained(log_streams.subscribe(spark, _written_log(spark, d), 300, key=1))
    return got.withColumn("payload", F.decode("payload", "UTF-8"))


@query(SQL["admit_dedup"])
def dedup_stream(spark, d):
    """O-26, O-56 as a stream with a mark per session as state."""
    from ..streaming import log_streams

    path = scratch_path(spark, "requests")
    rows = fx.requests(spark, d).select("arrival", "session", "client_seq")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return _drained(log_streams.dedup_stream(stream))


@query(f"WITH {LOG} SELECT seq, session, client_seq FROM log")
def replica_stream(spark, d):
    """O-61, O-62: a replica's log after applying the leader's stream."""
    from ..sources import seglog
    from ..streaming import log_streams

    leader, replica = _written_log(spark, d), scratch_path(spark, "replica")
    stream = spark.readStream.format("seglog").option("fromSeq", 1).load(leader)
    q = stream.writeStream.foreachBatch(log_streams.apply_batches(replica, 1 << 16)).option("checkpointLocation", f"{replica}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return seglog.open_log(spark, replica).select("seq", "session", "client_seq")


@query(SQL["log_view"])
def torn_append(spark, d):
    """O-20, O-11: a log whose last segment lost its end goes on after the last whole record."""
    from ..sources import seglog

    seglog.register(spark)
    path, rows = scratch_path(spark, "torn"), _stored(spark, d)
    _append(rows.where(F.col("seq") <= read.bounds(rows)[1] * 3 // 4), path)
    _, last = seglog.segments(path)[-1]
    data = seglog.load(path, last)
    with seglog.file_system(path)[0].open_output_stream(last) as out:
        out.write(data[:-10])
    _append(rows.where(F.col("seq") >= seglog.next_seq(path)), path)
    return seglog.open_log(spark, path).select("seq", "session", "client_seq", "partition_key", "flags", "len", "rec_size")


@query(SQL["admit_dedup_high"])
def dedup_stream_high(spark, d):
    """O-26 as a stream where client numbers pass 2^63."""
    from ..streaming import log_streams

    path = scratch_path(spark, "requests")
    rows = fx.high(fx.requests(spark, d)).select("arrival", "session", "client_seq")
    rows.write.parquet(path)
    got = _drained(log_streams.dedup_stream(spark.readStream.schema(rows.schema).parquet(path)))
    return got.withColumn("client_seq", unsigned_text(F.col("client_seq")))


def _admitted(spark, d) -> tuple[str, str]:
    """Paths of the log and of the answers of mixed requests that came in two batches."""
    from ..sources import seglog
    from ..streaming import log_streams

    seglog.register(spark)
    source, path, answers = (scratch_path(spark, x) for x in ("mixed", "admitted", "answers"))
    rows = fx.mixed_requests(spark, d).withColumns({"partition_key": F.lit(1).cast("long"), "record_type": F.lit(0), "payload": F.encode(F.lit("x"), "UTF-8")})
    middle = rows.agg(F.max("arrival")).first()[0] // 2
    for part in (rows.where(F.col("arrival") <= middle), rows.where(F.col("arrival") > middle)):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    told = log_streams.admission_stream(stream, F.col("leader"), F.col("replicas"))
    q = told.writeStream.foreachBatch(log_streams.append_batches(path, answers, 1 << 16)).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return path, answers


@query(SQL["admit_status"])
def admission_stream(spark, d):
    """O-25, O-26 as a stream with state, in the order of checks; a record that is too large is refused and the stream goes on."""
    return spark.read.parquet(_admitted(spark, d)[1]).select("arrival", "status")


@query(f"WITH {STATUS} SELECT CAST(row_number() OVER (ORDER BY arrival) AS BIGINT) AS seq, session FROM status WHERE status = 0")
def admission_stream_log(spark, d):
    """O-21, O-27 as a stream: the log after it."""
    from ..sources import seglog

    return seglog.open_log(spark, _admitted(spark, d)[0]).select("seq", "session")


@query(f"WITH {LOG}, m AS (SELECT CAST(ceil(max(seq) / 4.0) AS BIGINT) AS most FROM log) SELECT seq, (seq - 1) // most AS batch FROM log, m")
def subscribe_bounded(spark, d):
    """O-53: a reader takes a bounded batch at a time and leaves the rest in the log."""
    from ..streaming import log_streams

    path, out = _written_log(spark, d), scratch_path(spark, "bounded")
    most = -(-read.bounds(fx.log(spark, d))[1] // 4)

    def keep(batch: DataFrame, n: int) -> None:
        batch.select("seq", F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{out}/n={n}")

    q = log_streams.subscribe(spark, path, 1, most=most, progress=f"{out}-progress").writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).select("seq", "batch")


@query(f"WITH {LOG} SELECT seq, CASE WHEN seq % 5 <> 0 AND seq % 7 * 300 <= 1000 THEN 'ack' WHEN seq % 2 = 0 THEN 'degraded' ELSE 'no_replicas' END AS outcome FROM log WHERE flags & 4 <> 0")
def deadlines(spark, d):
    """O-58, O-65 as a stream: a timer for each replicated write, of a second; every fifth never gets its second copy."""
    from ..streaming import log_streams

    path, s = scratch_path(spark, "waits"), F.col("seq")
    rows = fx.log(spark, d).where(F.col("flags").bitwiseAND(F.lit(4)) != 0)
    flags = F.when(s % 2 == 0, F.col("flags").bitwiseOR(F.lit(8))).otherwise(F.col("flags"))
    writes = rows.select("seq", F.timestamp_millis(s * 10).alias("at"), F.lit("write").alias("kind"), flags.alias("flags"))
    copies = rows.where(s % 5 != 0).select("seq", F.timestamp_millis(s * 10 + s % 7 * 300).alias("at"), F.lit("durable").alias("kind"), F.lit(0).alias("flags"))
    later = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.timestamp_millis(F.lit(1 << 42)).alias("at"), F.lit("write").alias("kind"), F.lit(0).alias("flags"))
    for part in (writes.unionByName(copies), later):  # what moves the clock comes last
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("at", "0 seconds")
    return _drained(log_streams.deadline_stream(stream, 1000))


# -- wire


@query("WITH f AS (SELECT event_id, event_id % 13 + 1 AS op, event_id % 3 <> 0 AS has_session FROM events) SELECT event_id, CAST(CASE WHEN op IN (5, 6, 7, 9) THEN 3 WHEN op = 3 THEN 9 WHEN op = 1 AND NOT has_session THEN 7 ELSE 0 END AS INT) AS status FROM f")
def verb_statuses(spark, d):
    """O-96, O-97: verbs that are refused before any handler looks at them."""
    names = F.array(*[F.lit(name) for name in codec.OPS])
    rows = fx.table(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 13).cast("int")).alias("op"), (F.col("event_id") % 3 != 0).alias("has_session"))
    return rows.select("event_id", wire.verb_status(F.col("op"), F.col("has_session")).alias("status"))


@query("WITH p AS (SELECT event_id, event_id % 90 AS stated, event_id % 90 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS held FROM events) SELECT event_id, stated <= 64 AND stated = held AS hello, stated <= 64 AND stated = held AS error, event_id % 4 = 0 AS ack, event_id % 4 = 1 AS subscribe FROM p")
def payload_validity(spark, d):
    """O-17: payloads whose tails or sizes are not as stated are refused."""
    rows = fx.table(spark, d, "events").select("event_id")

    def run(batches):
        for batch in batches:
            out = []
            for e in batch.column("event_id").to_pylist():
                stated, tail, fixed = e % 90, b"n" * (e % 90 + (e % 7 == 0)), bytes((8, 16, 7, 17)[e % 4])
                hello, error = codec.HELLO.pack(e, stated, 0, 0) + tail, codec.ERR.pack(5, stated, 0) + tail
                out.append((e, codec.parse_hello(hello) is not None, codec.parse_error(error) is not None, codec.parse_fixed(codec.ACK, fixed) is not None, codec.parse_fixed(codec.SUBSCRIBE, fixed) is not None))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["event_id", "hello", "error", "ack", "subscribe"])

    return rows.mapInArrow(run, "event_id long, hello boolean, error boolean, ack boolean, subscribe boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
