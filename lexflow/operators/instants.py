"""Mixed timestamp texts to one unambiguous instant.

An ordered cascade of anchored patterns splits a text into date fields, time fields and a
zone; every step is a JVM expression, so the scan, the cascade and the zone arithmetic stay
in one generated stage. Instants are microseconds since 1970-01-01 UTC and do not depend on
the session's time zone.
"""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Month names and abbreviations as mail clients write them.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene janeiro января янв",
    2: "feb february februar février févr fév fevrier febrero fevereiro fev февраля фев",
    3: "mar march märz mär maerz mrz mars marzo março marco марта мар",
    4: "apr april avril avr abril abr апреля апр",
    5: "may mai mayo maio мая май",
    6: "jun june juni juin junio junho июня июн",
    7: "jul july juli juillet juil julio julho июля июл",
    8: "aug august août aout agosto ago августа авг",
    9: "sep sept september septembre septiembre set setembro сентября сен сент",
    10: "oct october oktober okt octobre octubre outubro out октября окт",
    11: "nov november novembre noviembre novembro ноября ноя нояб",
    12: "dec december dezember dez décembre déc decembre diciembre dic dezembro декабря дек",
}

# Minutes east of UTC; an entry with a zone prefix holds for mailboxes of such zones only.
ABBREVIATIONS = {
    ("", "Z"): 0, ("", "UTC"): 0, ("", "UT"): 0, ("", "GMT"): 0,
    ("", "EST"): -300, ("", "EDT"): -240, ("", "CST"): -360, ("", "CDT"): -300,
    ("", "MST"): -420, ("", "MDT"): -360, ("", "PST"): -480, ("", "PDT"): -420,
    ("", "BST"): 60, ("", "WET"): 0, ("", "WEST"): 60, ("", "CET"): 60, ("", "MEZ"): 60, ("", "CEST"): 120, ("", "MESZ"): 120,
    ("", "EET"): 120, ("", "EEST"): 180, ("", "MSK"): 180, ("", "JST"): 540, ("", "KST"): 540,
    ("", "AEST"): 600, ("", "AEDT"): 660, ("", "ACST"): 570, ("", "ACDT"): 630, ("", "AWST"): 480, ("", "BRT"): -180, ("", "BRST"): -120,
    ("Asia/Kolkata", "IST"): 330, ("Asia/Calcutta", "IST"): 330, ("Europe/Dublin", "IST"): 60, ("Asia/Jerusalem", "IST"): 120,
    ("Australia/", "EST"): 600, ("Australia/", "EDT"): 660, ("Australia/", "CST"): 570,
    ("Asia/Shanghai", "CST"): 480, ("Asia/Taipei", "CST"): 480,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?)?(?: uhr)?"
_ZONE = r"(?: ?([a-z]{1,5})| ?\(?(?:utc|gmt)? ?([+-])(\d{1,2}):?(\d{2})?\)?)?"
_NOTE = r"(?: ?\([a-z]{1,5}\)| ?\[[a-z_]+(?:/[a-z_+\-0-9]+)*\])?"
_TAIL = _TIME + _ZONE + _NOTE + "$"
_WEEKDAY = r"(?:\p{L}{2,9}\.?,? )?"
FIELDS = ["year", "month", "name", "day", "first", "second_number", "hour", "minute", "second", "fraction", "half", "abbreviation", "sign", "zone_hour", "zone_minute"]
_CLOCK = FIELDS[6:]

#: An anchored pattern and the group of each field; the clock and zone fields are the nine groups from ``hour`` on.
#: The patterns run on lower-cased text with single spaces, in this order, and the first that matches decides.
PATTERNS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:t|,? )" + _TAIL, dict(year=1, month=2, day=3, hour=4)),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2}),? " + _TAIL, dict(year=1, month=2, day=3, hour=4)),
    (r"^(\d{1,2})([/.\-])(\d{1,2})\2(\d{4}),? " + _TAIL, dict(first=1, second_number=3, year=4, hour=5)),
    ("^" + _WEEKDAY + r"(\d{1,2})\.?(?: de |[ -])(\p{L}{3,10})\.?(?: de |[ -])(\d{4}|\d{2}),? " + _TAIL, dict(day=1, name=2, year=3, hour=4)),
    ("^" + _WEEKDAY + r"(\p{L}{3,10})\.? (\d{1,2}),? (\d{4}),? " + _TAIL, dict(name=1, day=2, year=3, hour=4)),
    (r"^\p{L}{2,4}\.? (\p{L}{3,4}) (\d{1,2}) " + _TIME + r"(?: ([a-z]{1,5})| ([+-])(\d{2}):?(\d{2}))? (\d{4})$", dict(name=1, day=2, hour=3, year=12)),
    (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})()()(?:([a-z]{1,5})|([+-])(\d{2}):?(\d{2}))?$", dict(year=1, month=2, day=3, hour=4)),
]
_EPOCH = r"^\d{1,18}(?:\.\d{1,6})?$"
EPOCH_FROM_US, EPOCH_TO_US = 1_577_836_800_000_000, 1_798_761_600_000_000  # 2020-01-01 to 2027-01-01


def _month_of(name: Column) -> Column:
    pairs = [x for number, names in MONTHS.items() for n in names.split() for x in (F.lit(n), F.lit(number))]
    return F.try_element_at(F.create_map(*pairs), name)


def _parsed(text: Column) -> Column:
    """The fields of the first pattern that matches as an array of texts, empty where it has no such field; null where none matches."""
    chain = F.when(F.lit(False), F.lit(""))
    for pattern, at in PATTERNS:
        groups = {k: v for k, v in at.items() if k != "hour"} | {k: at["hour"] + i for i, k in enumerate(_CLOCK)}
        rewritten = F.regexp_replace(text, pattern, "|".join(f"${groups[k]}" if k in groups else "" for k in FIELDS))
        chain = chain.when(text.rlike(pattern), rewritten)
    return F.split(chain, r"\|", -1)


def _epoch_us(text: Column) -> Column:
    """A bare number as microseconds, in the one unit that puts it in 2020 to 2026."""
    number = F.when(text.rlike(_EPOCH), text).try_cast("decimal(24,6)")
    within = lambda v: (v >= EPOCH_FROM_US) & (v < EPOCH_TO_US)
    units = [(number * unit).try_cast("bigint") for unit in (1_000_000, 1_000, 1)]
    return reduce(lambda c, v: c.when(within(v), v), units[1:], F.when(within(units[0]), units[0]))


def _offset_us(instant_us: Column, zone: Column) -> Column:
    """Offset of ``zone`` at ``instant_us``; independent of the session's zone."""
    at = F.timestamp_micros(instant_us)
    return F.unix_micros(F.from_utc_timestamp(at, zone)) - instant_us


def local_candidates(local_us: Column, zone: Column) -> Column:
    """Array of the instants that a wall-clock time denotes in ``zone``: none in a gap, two in an overlap.

    Offsets a day before and after bracket any transition; each is kept if it is in force
    at the instant that it yields.
    """
    tries = F.array(*(local_us - _offset_us(local_us + shift, zone) for shift in (F.lit(-DAY_US), F.lit(DAY_US))))
    return F.array_sort(F.array_distinct(F.filter(tries, lambda u: u + _offset_us(u, zone) == local_us)))


def normalise_instants(
    df: DataFrame,
    text: str,
    zone: str,
    locale: str,
    *,
    ambiguous: str = "reject",
    nonexistent: str = "reject",
    instant: str = "instant_us",
    status: str = "instant_status",
) -> DataFrame:
    """``df`` with ``instant`` (BIGINT microseconds, or null) and ``status``.

    ``text``, ``zone`` and ``locale`` name columns: the raw text, the IANA zone of the source
    and its locale, of which ``*-US`` writes numeric dates month first.
    ``ambiguous``: "reject", "earlier" or "later"; ``nonexistent``: "reject" or "forward".

    Status is ``ok``; ``empty`` for null or blank text; ``epoch`` for a number; ``unparsed``
    where no pattern matches (dates without a time of day included); ``impossible`` for a
    calendar date, clock time or offset that does not exist; ``no_zone`` where the text has no
    zone and the source none that is known; ``ambiguous`` and ``nonexistent`` for local times
    that the clock showed twice or skipped. Repeated rows get equal results; columns named like
    the outputs are replaced, all others are kept.
    """
    spaced = F.trim(F.regexp_replace(F.col(text), r"\p{Z}+|\s+", " "))
    d = df.withColumn("__r", F.nullif(F.regexp_extract(spaced, r"\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]$", 1), F.lit(""))).withColumn("__t", F.lower(spaced))
    d = d.withColumn("__e", _epoch_us(F.col("__t"))).withColumn("__f", F.when(F.col("__e").isNull(), _parsed(F.col("__t"))))
    p = lambda k: F.get("__f", F.lit(FIELDS.index(k)))
    n = lambda k: p(k).try_cast("int")

    month_first = F.coalesce(F.col(locale).endswith("US"), F.lit(False))
    year = n("year") + F.when(n("year") < 100, 2000).otherwise(0)
    numeric = p("first") != ""
    month = F.when(numeric, F.when(month_first, n("first")).otherwise(n("second_number"))).when(p("month") != "", n("month")).otherwise(_month_of(p("name")))
    day = F.when(numeric, F.when(month_first, n("second_number")).otherwise(n("first"))).otherwise(n("day"))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    hour = (
        F.when(p("half") == "", F.when(n("hour") < 24, n("hour")))
        .when(n("hour").between(1, 12), n("hour") % 12 + F.when(p("half") == "p", 12).otherwise(0))
        .when((p("half") == "a") & (n("hour") == 0), 0)
        .when((p("half") == "p") & n("hour").between(13, 23), n("hour"))
    )
    minute = F.when(n("minute") < 60, n("minute"))
    second = F.when(p("second") == "", 0).when(n("second") < 60, n("second"))
    fraction = F.rpad(p("fraction"), 6, "0").try_cast("bigint")
    local_us = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_US + hour.cast("bigint") * HOUR_US + minute.cast("bigint") * 60_000_000 + second.cast("bigint") * 1_000_000 + fraction

    named = F.when(F.lit(False), F.lit(0))
    for (prefix, name), minutes in sorted(ABBREVIATIONS.items(), reverse=True):
        if prefix:
            named = named.when((p("abbreviation") == name.lower()) & F.col(zone).startswith(prefix), F.lit(minutes))
    anywhere = F.create_map(*(F.lit(x) for (prefix, name), minutes in ABBREVIATIONS.items() if not prefix for x in (name.lower(), minutes)))
    zone_minute = F.when(p("zone_minute") == "", 0).when(n("zone_minute") < 60, n("zone_minute"))
    signed = F.when((p("sign") != "") & (n("zone_hour") <= 14), (n("zone_hour") * 60 + zone_minute) * F.when(p("sign") == "-", -1).otherwise(1))
    has_zone = (p("abbreviation") != "") | (p("sign") != "")
    offset_min = F.coalesce(signed, named, F.try_element_at(anywhere, p("abbreviation")))
    own_zone = F.coalesce("__r", F.col(zone))

    d = d.select("*", local_us.alias("__local"), has_zone.alias("__has_zone"), (offset_min.cast("bigint") * 60_000_000).alias("__offset"), own_zone.alias("__own"), (p("sign") != "").alias("__signed"))
    d = d.withColumn("__zone", F.when(~F.col("__has_zone") & F.col("__own").isin(sorted(available_timezones())), F.col("__own")))
    d = d.withColumn("__c", F.when(F.col("__zone").isNotNull() & F.col("__local").isNotNull(), local_candidates(F.col("__local"), F.col("__zone"))))

    size = F.size("__c")
    pick = {"reject": F.lit(None).cast("bigint"), "earlier": F.get("__c", F.lit(0)), "later": F.get("__c", F.lit(1))}[ambiguous]
    gap = {"reject": F.lit(None).cast("bigint"), "forward": F.col("__local") - _offset_us(F.col("__local") - DAY_US, F.col("__zone"))}[nonexistent]
    value = (
        F.when(F.col("__e").isNotNull(), F.col("__e"))
        .when(F.col("__has_zone"), F.col("__local") - F.col("__offset"))
        .when(size == 1, F.get("__c", F.lit(0)))
        .when(size == 2, pick)
        .when(size == 0, gap)
    )
    said = (
        F.when(F.coalesce(F.col("__t"), F.lit("")) == "", "empty")
        .when(F.col("__e").isNotNull(), "epoch")
        .when(F.col("__f").isNull(), "unparsed")
        .when(F.col("__local").isNull() | (F.col("__signed") & F.col("__offset").isNull()), "impossible")
        .when(F.col("__has_zone") & F.col("__offset").isNull(), "no_zone")
        .when(F.col("__has_zone"), "ok")
        .when(F.col("__zone").isNull(), "no_zone")
        .when(size == 2, "ambiguous")
        .when(size == 0, "nonexistent")
        .otherwise("ok")
    )
    keep = [c for c in df.columns if c not in (instant, status)]
    return d.select(*(F.col(f"`{c}`") for c in keep), value.alias(instant), said.alias(status))


def message_instants(messages: DataFrame, mailboxes: DataFrame, **policy: str) -> DataFrame:
    """One row per message: ``msg_id``, ``date_raw``, ``instant_us``, ``instant_status``.

    Copies of a message count once. Only three narrow columns are shuffled. A message whose
    mailbox is missing or null keeps its row, with no default zone. ``mailboxes`` is a lookup;
    its first zone and locale by text order win where a mailbox is listed twice.
    """
    boxes = mailboxes.where("mailbox_id is not null").groupBy("mailbox_id").agg(F.min_by("tz_name", F.struct("tz_name", "locale")).alias("tz_name"), F.min_by("locale", F.struct("tz_name", "locale")).alias("locale"))
    narrow = messages.select("msg_id", "mailbox_id", "date_raw").where("msg_id is not null")
    each = normalise_instants(narrow.join(boxes, "mailbox_id", "left"), "date_raw", "tz_name", "locale", **policy)
    # folded last: a filter on the result then stays above the aggregate instead of being rewritten into the scan as a copy of the whole cascade
    once = each.groupBy("msg_id").agg(F.min(F.struct("date_raw", "mailbox_id", "instant_us", "instant_status")).alias("m"))
    return once.select("msg_id", "m.date_raw", "m.instant_us", "m.instant_status")
