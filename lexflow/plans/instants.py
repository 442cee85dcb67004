"""Queries on mixed timestamp texts (problem 3)."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.instants import ABBREVIATIONS, EPOCH_FROM_US, EPOCH_TO_US, FIELDS, MONTHS, PATTERNS, message_instants
from ..runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Each message whose date text denotes exactly one instant."""
    all_rows = message_instants(table(spark, root, "messages"), table(spark, root, "mailboxes"))
    return all_rows.where("instant_us is not null").select("msg_id", "instant_us")


def p3_normalised(spark: SparkSession, root: str) -> DataFrame:
    """Every message with its instant, or the reason why it stays unresolved."""
    return message_instants(table(spark, root, "messages"), table(spark, root, "mailboxes"))


QUERIES = {"p3_found": p3_found, "p3_normalised": p3_normalised}


def _sql(last: str) -> str:
    """The same cascade for DuckDB, ended by ``last``; its regular expressions have no back-references, so the separators are spelt out."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    branches = []
    for pattern, at in PATTERNS:
        for separator in "/.-" if "\\2" in pattern else [""]:
            p = pattern.replace(r"([/.\-])", rf"(\{separator})", 1).replace("\\2", rf"\{separator}") if separator else pattern
            groups = {k: v for k, v in at.items() if k != "hour"} | {k: at["hour"] + i for i, k in enumerate(FIELDS[6:])}
            whole = f"regexp_extract(t, {text(p)}, [{', '.join(f"'g{i}'" for i in range(1, max(groups.values()) + 1))}])"
            fields = ", ".join(f"({whole}).g{groups[k]}" if k in groups else "''" for k in FIELDS)
            branches.append(f"WHEN regexp_matches(t, {text(p)}) THEN [{fields}]")
    f = lambda k: f"f[{FIELDS.index(k) + 1}]"
    n = lambda k: f"try_cast(nullif({f(k)}, '') AS BIGINT)"
    months = " ".join(f"WHEN {f('name')} IN ({', '.join(text(x) for x in names.split())}) THEN {number}" for number, names in MONTHS.items())
    zoned = " ".join(f"WHEN {f('abbreviation')} = '{name.lower()}' AND starts_with(tz_name, '{prefix}') THEN {minutes}" for (prefix, name), minutes in sorted(ABBREVIATIONS.items(), reverse=True) if prefix)
    anywhere = " ".join(f"WHEN {f('abbreviation')} = '{name.lower()}' THEN {minutes}" for (prefix, name), minutes in ABBREVIATIONS.items() if not prefix)
    off = lambda u: f"(epoch_us(timezone(zone, make_timestamptz({u}))) - ({u}))"
    day = 86_400_000_000
    return f"""
WITH b AS (SELECT mailbox_id, arg_min(tz_name, (tz_name, locale)) AS tz_name, arg_min(locale, (tz_name, locale)) AS locale FROM mailboxes GROUP BY mailbox_id),
     m AS (SELECT DISTINCT msg_id, mailbox_id, date_raw FROM messages WHERE msg_id IS NOT NULL),
     s AS (SELECT m.msg_id, m.date_raw, b.tz_name, b.locale, trim(regexp_replace(m.date_raw, '\\p{{Z}}+|\\s+', ' ', 'g')) AS spaced FROM m LEFT JOIN b ON b.mailbox_id = m.mailbox_id),
     t AS (SELECT *, lower(spaced) AS t, nullif(regexp_extract(spaced, '\\[([A-Za-z_]+(?:/[A-Za-z_+\\-0-9]+)*)\\]$', 1), '') AS region, CASE WHEN regexp_full_match(spaced, '\\d{{1,18}}(?:\\.\\d{{1,6}})?') THEN try_cast(spaced AS DECIMAL(24, 6)) END AS number FROM s),
     e AS (SELECT *, CASE WHEN number * 1000000 >= {EPOCH_FROM_US} AND number * 1000000 < {EPOCH_TO_US} THEN CAST(number * 1000000 AS BIGINT) WHEN number * 1000 >= {EPOCH_FROM_US} AND number * 1000 < {EPOCH_TO_US} THEN CAST(number * 1000 AS BIGINT) WHEN number >= {EPOCH_FROM_US} AND number < {EPOCH_TO_US} THEN CAST(number AS BIGINT) END AS epoch FROM t),
     p AS (SELECT *, CASE WHEN epoch IS NULL THEN CASE {' '.join(branches)} END END AS f FROM e),
     d AS (SELECT *, {n('year')} + CASE WHEN {n('year')} < 100 THEN 2000 ELSE 0 END AS y,
                  CASE WHEN {f('first')} <> '' THEN CASE WHEN coalesce(locale LIKE '%US', false) THEN {n('first')} ELSE {n('second_number')} END WHEN {f('month')} <> '' THEN {n('month')} ELSE CASE {months} END END AS mo,
                  CASE WHEN {f('first')} <> '' THEN CASE WHEN coalesce(locale LIKE '%US', false) THEN {n('second_number')} ELSE {n('first')} END ELSE {n('day')} END AS da,
                  CASE WHEN {f('half')} = '' THEN CASE WHEN {n('hour')} < 24 THEN {n('hour')} END WHEN {n('hour')} BETWEEN 1 AND 12 THEN {n('hour')} % 12 + CASE WHEN {f('half')} = 'p' THEN 12 ELSE 0 END WHEN {f('half')} = 'a' AND {n('hour')} = 0 THEN 0 WHEN {f('half')} = 'p' AND {n('hour')} BETWEEN 13 AND 23 THEN {n('hour')} END AS ho,
                  CASE WHEN {n('minute')} < 60 THEN {n('minute')} END AS mi, CASE WHEN {f('second')} = '' THEN 0 WHEN {n('second')} < 60 THEN {n('second')} END AS se,
                  try_cast(left(rpad({f('fraction')}, 6, '0'), 6) AS BIGINT) AS us,
                  CASE WHEN {f('sign')} <> '' AND {n('zone_hour')} <= 14 THEN ({n('zone_hour')} * 60 + CASE WHEN {f('zone_minute')} = '' THEN 0 WHEN {n('zone_minute')} < 60 THEN {n('zone_minute')} END) * CASE WHEN {f('sign')} = '-' THEN -1 ELSE 1 END END AS signed_min,
                  coalesce(CASE {zoned} END, CASE {anywhere} END) AS named_min, {f('abbreviation')} <> '' OR {f('sign')} <> '' AS has_zone
           FROM p),
     l AS (SELECT *, (try_strptime(printf('%04d-%02d-%02d', y, mo, da), '%Y-%m-%d')::DATE - DATE '1970-01-01') * {day} + ho * 3600000000 + mi * 60000000 + se * 1000000 + us AS local_us, CASE WHEN NOT has_zone THEN coalesce(region, tz_name) END AS zone FROM d),
     c AS (SELECT *, local_us - {off(f'local_us - {day}')} AS c1, local_us - {off(f'local_us + {day}')} AS c2 FROM l),
     k AS (SELECT *, CASE WHEN c1 + {off('c1')} = local_us THEN c1 END AS k1, CASE WHEN c2 + {off('c2')} = local_us THEN c2 END AS k2 FROM c),
     r AS (SELECT *, coalesce(signed_min, named_min) AS offset_min, coalesce(epoch, CASE WHEN has_zone THEN local_us - coalesce(signed_min, named_min) * 60000000 WHEN k1 IS NULL OR k2 IS NULL OR k1 = k2 THEN coalesce(k1, k2) END) AS instant_us FROM k)
{last.replace("@sign", f("sign"))}
"""


_STATUS = """
SELECT msg_id, date_raw, instant_us,
       CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN epoch IS NOT NULL THEN 'epoch' WHEN f IS NULL THEN 'unparsed'
            WHEN local_us IS NULL OR (@sign <> '' AND offset_min IS NULL) THEN 'impossible'
            WHEN has_zone AND offset_min IS NULL THEN 'no_zone' WHEN has_zone THEN 'ok' WHEN zone IS NULL THEN 'no_zone'
            WHEN k1 <> k2 THEN 'ambiguous' WHEN k1 IS NULL AND k2 IS NULL THEN 'nonexistent' ELSE 'ok' END AS instant_status
FROM r
"""

SQL: dict[str, str] = {"p3_found": _sql("SELECT msg_id, instant_us FROM r WHERE instant_us IS NOT NULL"), "p3_normalised": _sql(_STATUS)}
