"""Column functions on texts, hashes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """CRC-32 of a binary or text column as eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def rendered_email(subject: Column, sender: Column, to: Column, cc: Column, date: Column, body: Column, attachments: Column) -> Column:
    """An email as Markdown: header lines, copies and attachments only where there are any, then the body."""
    some = lambda c: F.coalesce(c, F.lit("None"))
    copies = F.when(F.coalesce(cc, F.lit("")) != "", F.concat(F.lit("\n**CC:** "), cc)).otherwise("")
    files = F.when(F.coalesce(F.size(attachments), F.lit(0)) > 0, F.concat(F.lit("\n**Attachments:** "), F.array_join(attachments, ", "))).otherwise("")
    text = F.when(F.coalesce(body, F.lit("")) != "", body).otherwise("(no text content)")
    return F.concat(F.lit("# "), F.coalesce(F.nullif(subject, F.lit("")), F.lit("(no subject)")), F.lit("\n\n**From:** "), some(sender), F.lit("\n**To:** "), some(to), copies, F.lit("\n**Date:** "), some(date), files, F.lit("\n\n---\n\n"), text)


def declared_charset(html: Column) -> Column:
    """The character set that an HTML file declares in its first 4096 bytes, lower-case; empty if none."""
    head = F.decode(F.substring(html.cast("binary"), 1, 4096), "ISO-8859-1")
    return F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:\-]+)""", 1))


def compact_count(n: Column) -> Column:
    """A count as 950, 1.2k or 3.4M; halves round to even."""
    short = lambda size, unit: F.concat(F.format_string("%.1f", F.bround(n / size, 1)), F.lit(unit))
    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "k")).otherwise(n.cast("bigint").cast("string"))


def env_key(name: Column) -> Column:
    """A name as an environment key: upper case, other characters to underscores, no leading digit."""
    key = F.upper(F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))
    return F.when(key.rlike(r"^\d"), F.concat(F.lit("KEY_"), key)).otherwise(key)


def redacted_secret(value: Column) -> Column:
    """The first four characters of a secret; a connection string keeps all but its password."""
    dsn = r"(?i)^([a-z][a-z0-9+.-]*://[^:/@]+:)[^@]*(@.*)$"
    return F.when(value.rlike(dsn), F.regexp_replace(value, dsn, "$1***$2")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("...")))


def moment_us(value: Column) -> Column:
    """Epoch seconds, as number or text, or an ISO time (UTC where it has no zone) as microseconds; null otherwise."""
    number = value.try_cast("double")
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))))
    return F.coalesce(F.unix_micros(iso), F.when(F.abs(number) < 1e11, (number * 1_000_000).try_cast("bigint")))
