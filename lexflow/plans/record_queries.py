"""Queries on JSON records, settings and listings.

Inputs that have no table of their own (recogniser output, transcripts, cached usage, nested
settings) are derived by Spark from a given table as the docstring says, then read back by the
operator; the SQL computes the result from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexes, listing, records, sessions
from ..runtime import table
from .document_queries import _HASH, _INTERVALS, _OCR, _RUNS, _TOKEN, _hashes, _intervals, _ocr, _runs, _tokens

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _outputs(s: SparkSession, d: str) -> DataFrame:
    """Recogniser output of each sidecar and hundred pages, in one of its four shapes."""
    pages = table(s, d, "sidecar_pages").where("image is not null").distinct()
    pages = pages.withColumn("batch", F.concat_ws("#", "sidecar_rel", F.expr("page_no div 100")))
    record = F.to_json(F.struct("image", "ok", "markdown", "error"))
    rows = pages.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("page_id", record.alias("r")))).alias("rows")).withColumn("rows", F.transform("rows", lambda x: x["r"]))
    kind = F.pmod(F.length("batch"), F.lit(4))
    array = F.concat(F.lit("["), F.array_join("rows", ",\n"), F.lit("]"))
    text = F.when((kind == 0) & (F.size("rows") == 1), F.col("rows")[0]).when(kind == 1, array).when(kind == 2, F.concat(F.lit('{"results": '), array, F.lit("}"))).otherwise(F.concat(F.lit("\n"), F.array_join("rows", "\n\n")))
    return rows.select("batch", text.alias("output"))


_RECORDS = "(SELECT DISTINCT sidecar_rel || '#' || (page_no // 100) AS batch, page_id, image, ok, markdown, error FROM sidecar_pages WHERE image IS NOT NULL)"


@query(f"SELECT batch, image, arg_max(ok, page_id) AS ok, arg_max(md5(coalesce(markdown, '')), page_id) AS digest, arg_max(coalesce(error, ''), page_id) AS error FROM {_RECORDS} GROUP BY batch, image")
def records_read(s: SparkSession, d: str) -> DataFrame:
    """The record of each page image, read from recogniser output in all its shapes; the last one of an image counts."""
    got = records.recognised_records(_outputs(s, d), "batch", "output")
    return got.select("batch", "image", "ok", F.md5(F.coalesce("markdown", F.lit(""))).alias("digest"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"SELECT batch, image, arg_min(ok, page_id) AS ok, arg_min(md5(coalesce(markdown, '')), page_id) AS digest FROM {_RECORDS} GROUP BY batch, image")
def records_streamed(s: SparkSession, d: str) -> DataFrame:
    """The same as records are taken while they arrive: the first one of an image counts."""
    got = records.recognised_records(_outputs(s, d), "batch", "output", first=True)
    return got.select("batch", "image", "ok", F.md5(F.coalesce("markdown", F.lit(""))).alias("digest"))


def _transcripts(s: SparkSession, d: str) -> DataFrame:
    """Transcripts of each user's events by a thousand: clicks stand for users, purchases for assistants, errors for lines that are none."""
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    usage = F.struct(F.col("k").alias("input_tokens"), F.col("value").cast("bigint").alias("output_tokens"))
    kind = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "purchase", "assistant").otherwise(F.col("event_type"))
    entry = F.to_json(F.struct(kind.alias("type"), (F.col("event_type") == "signup").alias("isSidechain"), (F.col("k") > 90).alias("isApiErrorMessage"), F.struct(usage.alias("usage")).alias("message")))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(entry)
    lines = e.select(F.concat_ws("#", "user_id", F.expr("event_id div 1000")).alias("transcript"), "event_id", line.alias("line"))
    joined = lines.groupBy("transcript").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("lines"))
    return joined.select("transcript", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


_LINES = """
WITH e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(trunc(value) AS BIGINT) AS v, CASE event_type WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'assistant' ELSE event_type END AS kind FROM events),
     l AS (SELECT user_id || '#' || (event_id // 1000) AS transcript, event_id, event_type, k, v,
                  CASE WHEN event_type = 'error' THEN '{broken ' || props ELSE '{"type":"' || kind || '","isSidechain":' || (event_type = 'signup') || ',"isApiErrorMessage":' || (k > 90) || ',"message":{"usage":{"input_tokens":' || k || ',"output_tokens":' || v || '}}}' END AS line FROM e),
     t AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY transcript ORDER BY event_id DESC) AS from_end, sum(strlen(line) + 1) OVER (PARTITION BY transcript) AS size FROM l)
"""


@query(_LINES + "SELECT transcript, count(*) AS entries, CAST(coalesce(sum(k + v) FILTER (event_type = 'purchase' AND NOT k > 90), 0) AS BIGINT) AS tokens FROM t WHERE (size <= 700 OR from_end < 700) AND event_type NOT IN ('error', 'signup') GROUP BY transcript")
def transcripts_scanned(s: SparkSession, d: str) -> DataFrame:
    """Entries and tokens in the last 700 bytes of each transcript."""
    return records.token_totals(records.transcript_entries(_transcripts(s, d), "transcript", "content", 700), "transcript")


@query(_INTERVALS + """
, m AS (SELECT *, max(end_us) OVER (PARTITION BY session ORDER BY begin_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i),
  c2 AS (SELECT session, sum(greatest(0, end_us - greatest(begin_us, coalesce(reached, begin_us)))) / 1e6 AS seconds FROM m GROUP BY session),
  t AS (SELECT user_id AS session, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) * 100000 AS DOUBLE) AS tokens FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT session, CASE WHEN tokens / seconds >= 1000 THEN 'k t/s' ELSE ' t/s' END AS unit, round(tokens / seconds, 6) AS rate FROM t JOIN c2 USING (session) WHERE tokens > 0 AND seconds > 0
""")  # fmt: skip
def events_speed(s: SparkSession, d: str) -> DataFrame:
    """Tokens in a second of covered time by user; properties of purchases stand for hundred thousands of tokens."""
    tokens = table(s, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("session")).agg((F.sum(F.get_json_object("props", "$.k").try_cast("bigint")) * 100_000).cast("double").alias("tokens"))
    both = tokens.join(sessions.cover(_intervals(s, d)).select("session", (F.col("covered_us") / 1e6).alias("seconds")), "session")
    shown = both.withColumn("text", records.speed(F.col("tokens"), F.col("seconds"))).where("text is not null")
    return shown.select("session", F.regexp_extract("text", r"^[\d.]+(.*)$", 1).alias("unit"), F.round(F.col("tokens") / F.col("seconds"), 6).alias("rate"))


_NOW = 1_706_600_000_000_000  # the moment for which windows are judged: 2024-01-30 07:33:20 UTC


@query(f"""
WITH g AS (SELECT user_id, event_type, arg_max(value, event_id) / 5 AS percent, epoch_us(max(ts)) + 86400000000 AS resets_us, max(event_id) AS last FROM events WHERE event_type <> 'signup' GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY percent DESC, event_type) AS place FROM g WHERE event_type = 'error' OR (event_type = 'view' AND floor(resets_us / 1e6) * 1000000 > {_NOW}) OR (event_type NOT IN ('error', 'view') AND resets_us > {_NOW}))
SELECT user_id, event_type AS kind, round(percent, 6) AS percent, CASE WHEN percent >= 95 THEN 'exhausted' WHEN percent > 60 THEN 'offered' ELSE 'open' END AS state, place FROM o
""")  # fmt: skip
def windows_live(s: SparkSession, d: str) -> DataFrame:
    """Open usage windows of each user, fullest first; each user's newest events stand for a cached payload."""
    e = table(s, d, "events")
    at = F.unix_micros(F.to_utc_timestamp(F.max(F.col("ts").cast("timestamp")), F.current_timezone()))
    newest = e.groupBy("user_id", "event_type").agg((F.max_by("value", "event_id") / 5).alias("percent"), (at + 86_400_000_000).alias("resets_us"))
    iso = F.date_format(F.to_utc_timestamp(F.timestamp_micros("resets_us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    reset = F.when(F.col("event_type") == "error", F.lit("soon")).when(F.col("event_type") == "view", F.floor(F.col("resets_us") / 1e6).cast("string")).otherwise(iso)
    percent = F.when(F.col("event_type") == "signup", F.lit("true")).otherwise(F.col("percent").cast("string"))
    window = F.concat(F.lit('"'), "event_type", F.lit('": {"used_percentage": '), percent, F.lit(', "resets_at": "'), reset, F.lit('"}'))
    caches = newest.select("user_id", window.alias("w")).groupBy("user_id").agg(F.concat(F.lit('{"rate_limits": {'), F.array_join(F.collect_list("w"), ", "), F.lit("}}")).alias("payload"))
    live = records.live_windows(caches, "user_id", "payload", F.lit(_NOW))
    return listing.placed(live, ["user_id"], F.col("percent").desc(), F.col("kind")).select("user_id", "kind", F.round("percent", 6).alias("percent"), records.window_state(F.col("percent"), 95, 60).alias("state"), "place")


@query("""
WITH m AS (SELECT DISTINCT msg_id, matter_code, subject, thread_id, attachments, sender, to_addrs FROM messages WHERE msg_id IS NOT NULL),
     v AS (SELECT msg_id, 'SUBJECT' AS name, subject AS value FROM m UNION ALL SELECT msg_id, 'MATTER_CODE', matter_code FROM m
           UNION ALL SELECT msg_id, 'THREAD_KEY_2ND', CAST(thread_id AS VARCHAR) FROM m UNION ALL SELECT msg_id, 'THREAD_LONG', CASE WHEN thread_id > 500 THEN 'true' WHEN thread_id <= 500 THEN 'false' END FROM m
           UNION ALL SELECT msg_id, 'THREAD_FILES_' || i, attachments[i] FROM (SELECT msg_id, attachments, unnest(generate_series(1, len(attachments))) AS i FROM m)
           UNION ALL SELECT msg_id, 'THREAD_FILES', NULL FROM m WHERE attachments IS NULL
           UNION ALL SELECT msg_id, 'SAME', sender FROM m UNION ALL SELECT msg_id, 'SAME', to_addrs FROM m)
SELECT msg_id, name, md5(coalesce(min(value), '')) AS digest, CASE WHEN count(DISTINCT value) = 0 THEN 'null' WHEN count(DISTINCT value) > 1 THEN 'conflict' ELSE 'set' END AS state FROM v GROUP BY msg_id, name
""")  # fmt: skip
def settings_flattened(s: SparkSession, d: str) -> DataFrame:
    """Nested JSON of each message as environment-like names, with nulls and conflicts told."""
    m = table(s, d, "messages").where("msg_id is not null").select("msg_id", "matter_code", "subject", "thread_id", "attachments", "sender", "to_addrs").distinct()
    thread = F.struct(F.col("thread_id").alias("key 2nd"), (F.col("thread_id") > 500).alias("long"), F.col("attachments").alias("files"))
    nested = F.struct("subject", F.col("matter_code").alias("matter-code"), thread.alias("thread"), F.col("sender").alias("same"), F.col("to_addrs").alias("Same!"))
    rows = m.select("msg_id", F.to_json(nested, {"ignoreNullFields": "false"}).alias("payload"))
    return records.flattened(rows, "msg_id", "payload").select("msg_id", "name", F.md5(F.coalesce("value", F.lit(""))).alias("digest"), "state")


@query(f"SELECT upper(regexp_replace(verdict, '[^0-9A-Za-z]+', '_', 'g')) AS name, count(*) AS n, count(DISTINCT file) AS kinds FROM {_OCR} WHERE verdict NOT LIKE 'error%' GROUP BY 1")
def env_read(s: SparkSession, d: str) -> DataFrame:
    """Values by name of an environment file; the classification index, written as such lines, stands for it."""
    o = _ocr(s, d).where("verdict not like 'error%'")
    name = F.upper(F.regexp_replace("verdict", "[^0-9A-Za-z]+", "_"))
    lines = o.select(records.env_line(name, F.col("file")).alias("line"), F.xxhash64("file").alias("pos"))
    return records.env_values(lines, "line", "pos").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


_EXISTING = "(SELECT DISTINCT sidecar_rel AS file FROM processing_results WHERE sidecar_rel IS NOT NULL)"
_BOTH = "(SELECT source_rel, source_rel || '.md' AS file FROM {0} UNION ALL SELECT source_rel, regexp_extract(source_rel, '^(.*/)?[^/]*$', 1) || '.' || regexp_extract(source_rel, '([^/]*)$', 1) || '.md' FROM {0})"


@query(f"""
WITH d AS (SELECT source_rel, bool_or(file_hash IS NOT NULL) AS hashed FROM {_RUNS} GROUP BY source_rel),
     c AS {_BOTH.format('d')},
     x AS (SELECT file FROM c JOIN d USING (source_rel) WHERE NOT hashed UNION SELECT c.file FROM c JOIN {_EXISTING} e ON e.file = c.file)
SELECT 'hash' AS kind, file FROM {_HASH} WHERE file IN (SELECT source_rel FROM d)
UNION ALL SELECT 'token', file FROM {_TOKEN} WHERE file IN (SELECT file FROM x)
UNION ALL SELECT 'ocr', file FROM {_OCR} WHERE file IN (SELECT source_rel FROM d WHERE lower(source_rel) LIKE '%.pdf')
""")  # fmt: skip
def indexes_pruned(s: SparkSession, d: str) -> DataFrame:
    """The rows of all three indexes that stay: of sources found, of PDFs found, and of sidecars that exist or are protected."""
    runs = _runs(s, d).select("source_rel", F.col("file_hash").isNotNull().alias("hashed"))
    existing = table(s, d, "processing_results").select(F.col("sidecar_rel").alias("file")).where("file is not null")
    hashes, tokens, ocr = indexes.reconciled(_hashes(s, d), _tokens(s, d), _ocr(s, d), runs.select("source_rel"), runs.where("not hashed").select("source_rel"), existing)
    kept = lambda df, kind: df.select(F.lit(kind).alias("kind"), "file")
    return kept(hashes, "hash").unionByName(kept(tokens, "token")).unionByName(kept(ocr, "ocr"))


@query("SELECT source_rel, file, file LIKE '%/.%' AS dotted, EXISTS (SELECT 1 FROM processing_results p WHERE p.sidecar_rel = c.file) AS found FROM " + _BOTH.format("(SELECT DISTINCT source_rel FROM processing_results)") + " c")
def sidecar_candidates(s: SparkSession, d: str) -> DataFrame:
    """Both sidecar paths of each source and which of them exists; sidecars of all runs stand for the listing."""
    existing = table(s, d, "processing_results").select(F.col("sidecar_rel").alias("file")).where("file is not null").distinct().withColumn("found", F.lit(True))
    both = indexes.sidecar_candidates(table(s, d, "processing_results").select("source_rel").distinct())
    return both.join(existing, "file", "left").select("source_rel", "file", "dotted", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT doc_id, row_number() OVER (ORDER BY strftime(created_at::TIMESTAMP, '%Y-%m-%d') DESC NULLS LAST, doc_id) AS position FROM documents")
def listing_toggled(s: SparkSession, d: str) -> DataFrame:
    """Place of each document in its list sorted by day, newest first; equal days keep the order they had."""
    day = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd")
    rows = table(s, d, "documents").select("doc_id", day.alias("day"))
    return listing.toggled(rows, "day", "doc_id", reverse=True).select("doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT matter_code, entity FROM matters WHERE open_items > 3")
def matters_recent(s: SparkSession, d: str) -> DataFrame:
    """What a blank search gives: the list of recent matters; those with open items stand for it."""
    m = table(s, d, "matters")
    return listing.search_or_recent(m, m.where("open_items > 3"), "entity", "  ", "stamp", "matter_code").select("matter_code", "entity")


@query("SELECT status, count(*) AS n, string_agg(detail, '; ' ORDER BY first_us, detail) AS details FROM (SELECT status, detail, epoch_us(min(run_at)) AS first_us FROM processing_results WHERE detail IS NOT NULL GROUP BY ALL) GROUP BY status")
def errors_once(s: SparkSession, d: str) -> DataFrame:
    """The distinct details of each status, joined in the order of their first time."""
    once = table(s, d, "processing_results").where("detail is not null").groupBy("status", "detail").agg(F.min("run_at").alias("first"))
    joined = once.groupBy("status").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("first", "detail"))).alias("rows"))
    return joined.select("status", "n", F.array_join(F.transform("rows", lambda x: x["detail"]), "; ").alias("details"))


@query(f"SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) AS sidecars FROM {_TOKEN}")
def tokens_total(s: SparkSession, d: str) -> DataFrame:
    """Tokens of all sidecars in the token index."""
    return _tokens(s, d).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("sidecars"))


@query(f"SELECT r.source_rel, r.sidecar_rel, o.verdict FROM {_RUNS} r JOIN {_OCR} o ON o.file = r.source_rel AND o.hash = r.file_hash WHERE o.ocr_done AND o.verdict IN ('scanned-image-only', 'scan+ocr', 'mixed/other') AND r.sidecar_rel IN (SELECT sidecar_rel FROM processing_results)")
def sources_recoverable(s: SparkSession, d: str) -> DataFrame:
    """PDFs whose finished recognition can be taken over; sidecars of all runs stand for the listing."""
    existing = table(s, d, "processing_results").select(F.col("sidecar_rel").alias("file")).where("file is not null")
    return indexes.recoverable(_runs(s, d), _ocr(s, d), existing)


@query(f"SELECT source_rel FROM {_RUNS} r WHERE file_hash IS NOT NULL AND source_rel NOT IN (SELECT source_rel FROM processing_results WHERE status = 'failed') AND source_rel NOT IN (SELECT file FROM {_HASH} h WHERE h.hash = r.file_hash) AND source_rel NOT IN (SELECT file FROM {_OCR} WHERE verdict IN ('scanned-image-only', 'scan+ocr', 'mixed/other'))")
def sources_remaining(s: SparkSession, d: str) -> DataFrame:
    """Sources that are left when unchanged ones, PDFs for recognition and those that ever failed are taken out."""
    runs = _runs(s, d).where("file_hash is not null")
    unchanged = runs.join(_hashes(s, d).select(F.col("file").alias("source_rel"), F.col("hash").alias("file_hash")), ["source_rel", "file_hash"], "left_semi")
    for_ocr = _ocr(s, d).where(indexes.needs_ocr(F.col("verdict"))).select(F.col("file").alias("source_rel"))
    return indexes.remaining(runs, [unchanged, for_ocr], table(s, d, "processing_results").where("status = 'failed'"))


@query("SELECT 'run' AS origin, source_rel AS file, status AS state, CAST(tokens AS BIGINT) AS tokens FROM processing_results UNION ALL SELECT 'ocr', file, verdict, NULL FROM ocr_index UNION ALL SELECT 'hash', file, NULL, NULL FROM hash_index")
def results_united(s: SparkSession, d: str) -> DataFrame:
    """The result lists of all steps as one; what a list lacks is null."""
    runs = table(s, d, "processing_results").select(F.lit("run").alias("origin"), F.col("source_rel").alias("file"), F.col("status").alias("state"), "tokens")
    ocr = table(s, d, "ocr_index").select(F.lit("ocr").alias("origin"), "file", F.col("verdict").alias("state"))
    return runs.unionByName(ocr, allowMissingColumns=True).unionByName(table(s, d, "hash_index").select(F.lit("hash").alias("origin"), "file"), allowMissingColumns=True)


@query("SELECT user_id AS session, count(*) AS n, CASE WHEN count(*) > 1 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / (count(*) - 1), 3) END AS us_each FROM events GROUP BY user_id")
def events_pace(s: SparkSession, d: str) -> DataFrame:
    """Mean time between each user's events; they stand for pages as they arrive."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("at"))
    return sessions.pace(e, "user_id", "at").select("session", "n", F.round("us_each", 3).alias("us_each"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS moment, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
     i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT user_id, min(moment) AS begin_us, max(moment) AS last_us, count(*) AS n FROM i GROUP BY user_id, island
""")  # fmt: skip
def flags_expired(s: SparkSession, d: str) -> DataFrame:
    """Stretches of each user's events that end after six idle hours; they stand for flags that use refreshes."""
    e = table(s, d, "events").select("user_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("at"))
    return sessions.idle_sessions(e, "user_id", "at").select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("last").alias("last_us"), "n")


@query("""
SELECT mailbox_id, CASE WHEN mailbox_id % 5 = 0 THEN 'KEY_' || mailbox_id || '_BOX' WHEN mailbox_id % 5 = 1 THEN 'BOX_' || mailbox_id ELSE 'ENV_' || mailbox_id END AS name,
       CASE WHEN mailbox_id % 3 = 0 THEN address WHEN mailbox_id % 3 = 1 THEN NULL END AS value, CASE WHEN mailbox_id % 3 = 0 THEN 'set' WHEN mailbox_id % 3 = 1 THEN 'null' ELSE 'missing' END AS state
FROM mailboxes WHERE mailbox_id % 5 < 3
""")  # fmt: skip
def credentials_named(s: SparkSession, d: str) -> DataFrame:
    """Credentials by name; JSON objects of the mailboxes, with their fields by turns, stand for a payload."""
    m = table(s, d, "mailboxes")
    i = F.col("mailbox_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.when(i % 5 == 0, F.concat(F.lit('"name": '), quoted(F.concat(i.cast("string"), F.lit(" box"))))).when(i % 5 == 1, F.concat(F.lit('"name": "  ", "variable": '), quoted(F.concat(F.lit("box-"), i.cast("string"))))).when(i % 5 == 2, F.concat(F.lit('"key": 7, "env": '), quoted(F.concat(F.lit("env."), i.cast("string"))))).otherwise(F.lit('"other": 1'))
    value = F.when(i % 3 == 0, F.concat(F.lit(', "secret": '), quoted(F.col("address")), F.lit(', "url": "no"'))).when(i % 3 == 1, F.lit(', "token": null, "url": "no"')).otherwise(F.lit(""))
    rows = m.select("mailbox_id", F.concat(F.lit("{"), name, value, F.lit("}")).alias("payload"))
    return records.named_credentials(rows, "mailbox_id", "payload")
