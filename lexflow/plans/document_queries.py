"""Queries of the document pipeline: indexes, runs, pages, mail and event sessions.

The input of each is one of the given tables; where a table stands in for an input that has
none of its own, the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compact_count, content_hash, env_key, rendered_email
from ..operators import indexes, listing, pages, sessions
from ..runtime import broadcast_if_small, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# SQL of parts that several queries share
_HASH = "(SELECT file, hash FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no DESC) r FROM hash_index) WHERE r = 1)"
_TOKEN = "(SELECT file, tokens FROM (SELECT file, CAST(replace(trim(tokens), '_', '') AS BIGINT) tokens, row_number() OVER (PARTITION BY file ORDER BY row_no DESC) r FROM token_index WHERE regexp_full_match(trim(tokens), '[+-]?\\d+(_\\d+)*')) WHERE r = 1)"
_OCR = "(SELECT file, hash, try_cast(pages AS BIGINT) pages, try_cast(pg_image_only AS BIGINT) pg_image_only, try_cast(pg_scan_ocr AS BIGINT) pg_scan_ocr, try_cast(pg_digital AS BIGINT) pg_digital, try_cast(pg_other AS BIGINT) pg_other, verdict, coalesce(producer, '') producer, coalesce(ocr_done, '') = 'true' ocr_done FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no DESC) r FROM ocr_index) WHERE r = 1)"
_RUNS = "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source_rel ORDER BY run_at DESC NULLS LAST, status DESC, route DESC) r FROM processing_results) WHERE r = 1)"
_MAIL = "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ingested_at) r FROM messages) WHERE r = 1)"
_NEEDS = "verdict IN ('scanned-image-only', 'scan+ocr', 'mixed/other')"


def _hashes(s: SparkSession, d: str) -> DataFrame:
    return indexes.hash_index(table(s, d, "hash_index"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return indexes.token_index(table(s, d, "token_index"))


def _ocr(s: SparkSession, d: str) -> DataFrame:
    return indexes.ocr_index(table(s, d, "ocr_index"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return indexes.latest_runs(table(s, d, "processing_results"))


def _mail(s: SparkSession, d: str) -> DataFrame:
    """Each message once; copies differ in nothing but the time of their delivery."""
    m = table(s, d, "messages")
    rest = [c for c in m.columns if c != "msg_id"]
    return m.groupBy("msg_id").agg(F.min_by(F.struct(*rest), "ingested_at").alias("m")).select("msg_id", "m.*")


@query(f"SELECT file, hash FROM {_HASH}")
def index_hashes(s: SparkSession, d: str) -> DataFrame:
    """The valid row of each file in the hash index."""
    return _hashes(s, d)


@query(f"SELECT file, tokens FROM {_TOKEN}")
def index_tokens(s: SparkSession, d: str) -> DataFrame:
    """The valid row of each sidecar in the token index."""
    return _tokens(s, d)


@query(f"SELECT * FROM {_OCR}")
def index_ocr(s: SparkSession, d: str) -> DataFrame:
    """The valid row of each PDF in the classification index, typed."""
    return _ocr(s, d)


@query(f"SELECT source_rel, status, route, sidecar_rel, file_hash, tokens, coalesce(ocr_done, false) AS ocr_done, epoch_us(run_at) AS run_us FROM {_RUNS}")
def runs_latest(s: SparkSession, d: str) -> DataFrame:
    """The last run of each source."""
    return _runs(s, d).select("source_rel", "status", "route", "sidecar_rel", "file_hash", "tokens", F.coalesce("ocr_done", F.lit(False)).alias("ocr_done"), F.unix_micros("run_at").alias("run_us"))


@query(f"SELECT count(*) FILTER (status = 'converted') AS n_converted, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'deferred_for_ocr') AS n_deferred_for_ocr, count(*) FILTER (status = 'failed') AS n_failed, count(*) AS n_results, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM {_RUNS}")
def runs_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts of the last runs by status, zeros shown."""
    return indexes.run_summary(_runs(s, d))


@query("SELECT status, coalesce(detail, '') AS detail, count(*) AS n, epoch_us(min(run_at)) AS first_us FROM (SELECT DISTINCT * FROM processing_results) GROUP BY ALL")
def runs_details(s: SparkSession, d: str) -> DataFrame:
    """Distinct details of each status with their count and first time; exact copies count once."""
    return table(s, d, "processing_results").distinct().groupBy("status", F.coalesce("detail", F.lit("")).alias("detail")).agg(F.count("*").alias("n"), F.unix_micros(F.min("run_at")).alias("first_us"))


@query(f"SELECT o.file, h.hash AS old_hash, o.hash AS new_hash FROM {_OCR} o LEFT JOIN {_HASH} h ON o.file = h.file WHERE h.hash IS NULL OR o.hash IS DISTINCT FROM h.hash")
def files_changed(s: SparkSession, d: str) -> DataFrame:
    """PDFs that are new or changed against the hash index."""
    return indexes.changed_files(_ocr(s, d), _hashes(s, d))


@query(f"SELECT r.source_rel, r.sidecar_rel, t.tokens FROM {_RUNS} r JOIN {_HASH} h ON h.file = r.source_rel AND h.hash = r.file_hash JOIN {_TOKEN} t ON t.file = r.sidecar_rel")
def sources_unchanged(s: SparkSession, d: str) -> DataFrame:
    """Sources whose indexed hash, sidecar and token count all stand."""
    return indexes.unchanged_sources(_runs(s, d), _hashes(s, d), _tokens(s, d))


@query(f"SELECT file, verdict, pages FROM {_OCR} o WHERE {_NEEDS} AND NOT (ocr_done AND EXISTS (SELECT 1 FROM processing_results p WHERE p.sidecar_rel = o.file || '.md'))")
def pdfs_pending_ocr(s: SparkSession, d: str) -> DataFrame:
    """PDFs that wait for recognition; the sidecars of all runs stand for the listing."""
    return indexes.pending_ocr(_ocr(s, d), table(s, d, "processing_results").select("sidecar_rel").where("sidecar_rel is not null"))


@query(f"SELECT count(*) AS n_pdfs, count(*) FILTER ({_NEEDS}) AS n_need_ocr, count(*) FILTER (ocr_done) AS n_done, count(*) FILTER (verdict LIKE 'error:%') AS n_errors, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages FROM {_OCR}")
def pdfs_summary(s: SparkSession, d: str) -> DataFrame:
    """How many PDFs need recognition, are done, or could not be read."""
    o = _ocr(s, d)
    return o.agg(F.count("*").alias("n_pdfs"), F.count_if(indexes.needs_ocr(F.col("verdict"))).alias("n_need_ocr"), F.count_if("ocr_done").alias("n_done"), F.count_if(F.col("verdict").startswith("error:")).alias("n_errors"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


@query(f"SELECT file, CASE WHEN pg_image_only + pg_scan_ocr >= greatest(coalesce(pages, 0), 1) / 2.0 THEN CASE WHEN pg_scan_ocr > pg_image_only THEN 'scan+ocr' ELSE 'scanned-image-only' END WHEN pg_digital >= greatest(coalesce(pages, 0), 1) / 2.0 THEN 'digital-text' ELSE 'mixed/other' END AS computed FROM {_OCR} WHERE verdict NOT LIKE 'error:%'")
def pdfs_verdict(s: SparkSession, d: str) -> DataFrame:
    """The verdict of each readable PDF, computed again from its page counts."""
    o = _ocr(s, d).where("verdict not like 'error:%'")
    return o.select("file", indexes.majority_verdict(F.col("pages"), F.col("pg_image_only"), F.col("pg_scan_ocr"), F.col("pg_digital")).alias("computed"))


@query(f"SELECT file, hash FROM {_HASH} WHERE file NOT IN (SELECT source_rel FROM {_RUNS} WHERE status = 'converted' AND file_hash IS NOT NULL) UNION ALL SELECT source_rel, file_hash FROM {_RUNS} WHERE status = 'converted' AND file_hash IS NOT NULL")
def index_staged(s: SparkSession, d: str) -> DataFrame:
    """The hash index after the last runs were staged into it."""
    return indexes.staged_index(_hashes(s, d), _runs(s, d))


@query(f"SELECT file, tokens FROM {_TOKEN} WHERE file IN (SELECT sidecar_rel FROM processing_results)")
def index_pruned(s: SparkSession, d: str) -> DataFrame:
    """Token rows whose sidecar some run has named."""
    return indexes.pruned(_tokens(s, d), table(s, d, "processing_results").select(F.col("sidecar_rel").alias("file")).where("file is not null"))


@query(f"SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' ELSE 'differs' END AS state FROM {_HASH} a FULL JOIN (SELECT source_rel AS file, file_hash AS hash FROM {_RUNS}) b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.hash IS DISTINCT FROM b.hash")
def tree_diff(s: SparkSession, d: str) -> DataFrame:
    """The hash index against the hashes of the last runs."""
    return indexes.tree_difference(_hashes(s, d), _runs(s, d).select(F.col("source_rel").alias("file"), F.col("file_hash").alias("hash")))


@query("SELECT i.file, i.hash, CASE WHEN k.file IS NULL THEN 'new' WHEN EXISTS (SELECT 1 FROM hash_index h WHERE h.file = i.file AND h.hash = i.hash) THEN 'existing' ELSE 'conflicting' END AS state FROM (SELECT DISTINCT file, hash FROM ocr_index WHERE hash IS NOT NULL) i LEFT JOIN (SELECT DISTINCT file FROM hash_index) k ON k.file = i.file")
def keys_split(s: SparkSession, d: str) -> DataFrame:
    """Keys and values of the classification index against all values that the hash index ever held for them."""
    return indexes.split_incoming(table(s, d, "ocr_index").where("hash is not null"), table(s, d, "hash_index"))


@query("SELECT source_rel, regexp_extract(source_rel, '^(.*/)?[^/]*$', 1) || '.' || regexp_extract(source_rel, '([^/]*)$', 1) || '.md' AS sidecar_rel FROM (SELECT DISTINCT source_rel FROM processing_results)")
def sidecar_paths(s: SparkSession, d: str) -> DataFrame:
    """The dotted sidecar path of each source."""
    return indexes.expected_sidecars(table(s, d, "processing_results").select("source_rel").distinct(), dotted=True)


@query("""
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(ok, false) DESC, sidecar_rel, page_no, markdown NULLS FIRST) r FROM sidecar_pages) WHERE r = 1),
     q AS (SELECT *, coalesce(ok AND markdown IS NOT NULL, false) AS good FROM p)
SELECT sidecar_rel, count(*) AS pages, count(*) FILTER (NOT good) AS failed,
       CASE WHEN count(*) FILTER (NOT good) > 0 THEN count(*) FILTER (NOT good) || '/' || count(*) || ' page(s) failed: ' || first(coalesce(error, 'no result returned') ORDER BY page_no, page_id) FILTER (NOT good) END AS failure,
       CASE WHEN count(*) FILTER (NOT good) = 0 THEN md5(string_agg(markdown, chr(10) || chr(10) ORDER BY page_no, page_id)) END AS text_md5,
       CASE WHEN count(*) FILTER (NOT good) = 0 THEN CAST(sum(length(markdown)) + 2 * (count(*) - 1) AS BIGINT) END AS text_chars
FROM q GROUP BY sidecar_rel
""")  # fmt: skip
def pages_assembled(s: SparkSession, d: str) -> DataFrame:
    """Each recognised document: pages, the first failure, or its assembled text by digest and length."""
    got = pages.assembled_documents(table(s, d, "sidecar_pages"))
    return got.select("sidecar_rel", "pages", "failed", "failure", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_chars"))


@query("SELECT doc_id, title, epoch_us(created_at) AS created_us FROM documents WHERE title ILIKE '%agreement%' ORDER BY created_at DESC NULLS FIRST, doc_id LIMIT 10")
def titles_search(s: SparkSession, d: str) -> DataFrame:
    """The ten newest documents whose title contains a term; documents stand for the table of remote matters."""
    return listing.top_matches(table(s, d, "documents"), "title", "agreement", "created_at", "doc_id").select("doc_id", "title", F.unix_micros("created_at").alias("created_us"))


@query()
def titles_fuzzy(s: SparkSession, d: str) -> DataFrame:
    """Documents whose title resembles a term, best first, then by title."""
    rows = listing.fuzzy_filter(table(s, d, "documents").select("doc_id", "title"), "title", "settlemnt offer")
    return listing.positions(rows, F.col("score").desc(), F.col("title"), F.col("doc_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY created_at NULLS FIRST, doc_id) AS position FROM documents")
def listing_positions(s: SparkSession, d: str) -> DataFrame:
    """Place of each document in the order of its time."""
    return listing.positions(table(s, d, "documents").select("doc_id", "created_at"), F.col("created_at").asc_nulls_first(), F.col("doc_id")).select("doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT file, row_number() OVER (ORDER BY string_split(file, '/')) AS position FROM (SELECT DISTINCT file FROM hash_index)")
def path_positions(s: SparkSession, d: str) -> DataFrame:
    """Place of each file in the order of its path's components."""
    files = table(s, d, "hash_index").select("file").distinct().withColumn("parts", F.split("file", "/"))
    return listing.positions(files, F.col("parts")).select("file", F.col("position").cast("bigint").alias("position"))


@query("SELECT doc_id, CASE WHEN length(title) > 40 THEN substr(title, 1, 37) || '...' ELSE title END AS label, strftime(created_at::TIMESTAMP, '%Y-%m-%d') AS modified FROM documents")
def listing_labels(s: SparkSession, d: str) -> DataFrame:
    """Short labels and dates of a listing."""
    return table(s, d, "documents").select("doc_id", listing.short_label(F.col("title"), 40).alias("label"), F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd").alias("modified"))


@query(f"SELECT h.file, coalesce(split_part(p.packed, '|', 1) <> h.hash, false) AS outdated, CASE WHEN p.packed IS NOT NULL THEN substr(p.packed, strpos(p.packed, '|') + 1) END AS fetched_on FROM {_HASH} h LEFT JOIN (SELECT upper(source_rel) AS file, file_hash || '|' || strftime(run_at::TIMESTAMP, '%Y-%m-%d') AS packed FROM {_RUNS} WHERE file_hash IS NOT NULL) p ON lower(p.file) = lower(h.file)")
def copies_outdated(s: SparkSession, d: str) -> DataFrame:
    """Files whose last fetched copy has another checksum; last runs stand for the history of downloads."""
    day = F.date_format(F.to_utc_timestamp("run_at", F.current_timezone()), "yyyy-MM-dd")
    history = _runs(s, d).where("file_hash is not null").select(F.upper("source_rel").alias("file"), F.concat_ws("|", "file_hash", day).alias("packed"))
    return listing.outdated(_hashes(s, d), history)


@query(f"""
SELECT msg_id, md5('# ' || CASE WHEN coalesce(subject, '') = '' THEN '(no subject)' ELSE subject END || chr(10) || chr(10) || '**From:** ' || coalesce(sender, 'None') || chr(10) || '**To:** ' || coalesce(to_addrs, 'None')
       || CASE WHEN coalesce(cc_addrs, '') <> '' THEN chr(10) || '**CC:** ' || cc_addrs ELSE '' END || chr(10) || '**Date:** ' || coalesce(date_raw, 'None')
       || CASE WHEN coalesce(len(attachments), 0) > 0 THEN chr(10) || '**Attachments:** ' || array_to_string(attachments, ', ') ELSE '' END
       || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN coalesce(body, '') = '' THEN '(no text content)' ELSE body END) AS rendered_md5
FROM {_MAIL}
""")  # fmt: skip
def mail_rendered(s: SparkSession, d: str) -> DataFrame:
    """Each message as Markdown, by the digest of its text."""
    text = rendered_email(*(F.col(c) for c in ("subject", "sender", "to_addrs", "cc_addrs", "date_raw", "body", "attachments")))
    rendered = table(s, d, "messages").select("msg_id", F.md5(text).alias("rendered_md5"))
    return rendered.groupBy("msg_id").agg(F.min("rendered_md5").alias("rendered_md5"))


@query("SELECT msg_id, CAST(i - 1 AS INTEGER) AS pos, attachments[i] AS attachment FROM (SELECT DISTINCT msg_id, attachments, unnest(generate_series(1, len(attachments))) AS i FROM messages WHERE len(attachments) > 0)")
def mail_attachments(s: SparkSession, d: str) -> DataFrame:
    """Attachments of each message with their place."""
    return table(s, d, "messages").select("msg_id", F.posexplode("attachments").alias("pos", "attachment")).distinct()


@query("SELECT matter_code, count(DISTINCT msg_id) AS messages, count(DISTINCT thread_id) AS threads, count(*) - count(DISTINCT msg_id) AS copies FROM messages GROUP BY matter_code")
def mail_by_matter(s: SparkSession, d: str) -> DataFrame:
    """Messages, threads and repeated deliveries of each matter, folded by message first so that a hot matter is spread."""
    by_message = table(s, d, "messages").groupBy("matter_code", "msg_id", "thread_id").agg(F.count("*").alias("n"))
    threads = by_message.groupBy("matter_code", "thread_id").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    total = threads.groupBy("matter_code").agg(F.sum("m").alias("messages"), F.count("thread_id").alias("threads"), F.sum("n").alias("n"))
    return total.select("matter_code", "messages", "threads", (F.col("n") - F.col("messages")).alias("copies"))


@query("SELECT DISTINCT doc_id, m.matter_code AS mentioned FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d+')) AS t FROM documents) d JOIN matters m ON m.matter_code = d.t")
def matters_mentioned(s: SparkSession, d: str) -> DataFrame:
    """Matters whose code stands in a document as a whole number; a join on the numbers instead of all pairs."""
    numbers = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)))).alias("mentioned"))
    codes = broadcast_if_small(table(s, d, "matters").select(F.col("matter_code").alias("mentioned")).distinct(), 100_000)
    return numbers.join(codes, "mentioned").distinct().select("doc_id", "mentioned")


@query("SELECT m.matter_code, n.newest, CASE WHEN m.stamp IS NULL THEN 'UNSTAMPED' WHEN m.stamp < n.newest THEN 'STALE' ELSE 'CURRENT' END AS state FROM matters m LEFT JOIN (SELECT matter_code, strftime(max(created_at)::TIMESTAMP, '%Y%m%d') AS newest FROM documents GROUP BY matter_code) n ON n.matter_code = m.matter_code")
def matters_stamped(s: SparkSession, d: str) -> DataFrame:
    """Each matter's stamp against its newest document; documents stand for journal entries."""
    newest = table(s, d, "documents").groupBy("matter_code").agg(F.date_format(F.to_utc_timestamp(F.max("created_at"), F.current_timezone()), "yyyyMMdd").alias("newest"))
    joined = table(s, d, "matters").join(newest, "matter_code", "left")
    return joined.select("matter_code", "newest", F.when(F.col("stamp").isNull(), "UNSTAMPED").when(F.col("stamp") < F.col("newest"), "STALE").otherwise("CURRENT").alias("state"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents")
def texts_digest(s: SparkSession, d: str) -> DataFrame:
    """Digest and length of each document."""
    return table(s, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))


# the table of the checksum by its rule: eight shifts of the polynomial for each byte
_CRC = """
WITH RECURSIVE s AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS n FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM s WHERE n < 8),
     t AS MATERIALIZED (SELECT list(v ORDER BY i) AS steps FROM s WHERE n = 8),
     d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, lower(lpad(hex(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)), 8, '0')) AS hash
FROM d, t
"""


@query(_CRC)
def texts_crc32(s: SparkSession, d: str) -> DataFrame:
    """CRC-32 fingerprint of each document's text."""
    return table(s, d, "documents").select("doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_property(s: SparkSession, d: str) -> DataFrame:
    """A numeric property of each event's JSON; what is no number is null."""
    return table(s, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, upper(key) AS name, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def events_flattened(s: SparkSession, d: str) -> DataFrame:
    """The JSON of each event as environment-like names and values."""
    return table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).select("event_id", env_key(F.col("key")).alias("name"), "value")


_INTERVALS = """
WITH c AS (SELECT user_id AS session, event_id, epoch_us(ts) AS moment, event_type, last_value(CASE WHEN event_type = 'click' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begin_us FROM events),
     i AS (SELECT session, begin_us, moment AS end_us FROM c WHERE event_type = 'purchase' AND moment > begin_us)
"""


def _intervals(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("at"), (F.col("event_type") == "click").alias("s"), (F.col("event_type") == "purchase").alias("e"))
    return sessions.carried_starts(e, "user_id", "event_id", "at", "s", "e")


@query(_INTERVALS + "SELECT session, begin_us, end_us FROM i")
def events_intervals(s: SparkSession, d: str) -> DataFrame:
    """From the last earlier click to each purchase, by user in line order; clicks and purchases stand for turns."""
    return _intervals(s, d)


@query(_INTERVALS + ", m AS (SELECT *, max(end_us) OVER (PARTITION BY session ORDER BY begin_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i) SELECT session, CAST(sum(greatest(0, end_us - greatest(begin_us, coalesce(reached, begin_us)))) AS BIGINT) AS covered_us FROM m GROUP BY session")
def events_cover(s: SparkSession, d: str) -> DataFrame:
    """Length of the union of each user's intervals."""
    return sessions.cover(_intervals(s, d))


@query("""
WITH s AS (SELECT user_id AS session, max(event_id) FILTER (event_type = 'click') AS u, max(event_id) FILTER (event_type = 'purchase') AS a, arg_max(epoch_us(ts), event_id) FILTER (event_type = 'purchase' AND value > 50) AS last FROM events GROUP BY user_id)
SELECT session, coalesce(u > coalesce(a, -1), false) AS working, CASE WHEN NOT coalesce(u > coalesce(a, -1), false) THEN last END AS last_assistant_us FROM s
""")  # fmt: skip
def events_turn_state(s: SparkSession, d: str) -> DataFrame:
    """What a scan of each user's events from the newest on finds first."""
    e = table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("u"), (F.col("event_type") == "purchase").alias("a"), (F.col("value") > 50).alias("active"), F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("at"))
    return sessions.turn_state(e, "user_id", "event_id", "u", "a", "active", "at")


@query('SELECT user_id AS "group", value, event_type AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) r FROM events WHERE value IS NOT NULL) WHERE r = 1')
def gauges_highest(s: SparkSession, d: str) -> DataFrame:
    """The highest value of each user, of equal ones the first; events stand for gauges."""
    return sessions.first_highest(table(s, d, "events"), "user_id", "value", "event_id", "event_type")


def _short(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN printf('%.1fM', round_even({n} / 1000000.0, 1)) WHEN {n} >= 1000 THEN printf('%.1fk', round_even({n} / 1000.0, 1)) ELSE CAST({n} AS VARCHAR) END"


@query(f"SELECT file, {_short('tokens')} AS short, {_short('(tokens * 1000)')} AS thousands FROM {_TOKEN}")
def tokens_compact(s: SparkSession, d: str) -> DataFrame:
    """Token counts in short form, and those of a thousand times as many."""
    return _tokens(s, d).select("file", compact_count(F.col("tokens")).alias("short"), compact_count(F.col("tokens") * 1000).alias("thousands"))


@query("SELECT nation.n_name, count(*) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def general_orders_by_nation(s: SparkSession, d: str) -> DataFrame:
    """A general join and aggregation; not from the document pipeline."""
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    by_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    joined = by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(broadcast_if_small(n, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))
