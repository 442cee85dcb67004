"""Timestamps against an independent parser and zoneinfo."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lexflow.operators.instants import message_instants, normalise_instants

CASES = [
    ("Wed, 26 Feb 2020 08:11:28 +0300", "Europe/Moscow", "ru-RU", "2020-02-26T05:11:28Z", "ok"),
    (" tue,  24 mar 2020   08:16:25 +0100 ", "Europe/Paris", "fr-FR", "2020-03-24T07:16:25Z", "ok"),
    ("Thu, 18 MAR 21 13:21:23 +0100 (CET)", "Europe/Berlin", "de-DE", "2021-03-18T12:21:23Z", "ok"),
    ("06-May-21 11:38 AM", "America/Los_Angeles", "en-US", "2021-05-06T18:38:00Z", "ok"),
    ("5/11/2025 12:51:18 AM", "America/Chicago", "en-US", "2025-05-11T05:51:18Z", "ok"),
    ("02/10/2020 3:50:54 AM", "Australia/Sydney", "en-AU", "2020-10-01T17:50:54Z", "ok"),
    ("4/24/2024, 12:02 p.m.", "America/New_York", "en-US", "2024-04-24T16:02:00Z", "ok"),
    ("31.01.2021 19:08 Uhr", "Europe/Berlin", "de-DE", "2021-01-31T18:08:00Z", "ok"),
    ("14-03-2021 09:37 UTC+5:30", "Asia/Kolkata", "en-IN", "2021-03-14T04:07:00Z", "ok"),
    ("8/31/2022 21:38 (GMT-05:00)", "America/Chicago", "en-US", "2022-09-01T02:38:00Z", "ok"),
    ("Fri Aug 26 21:48:28 BST 2022", "Europe/London", "en-GB", "2022-08-26T20:48:28Z", "ok"),
    ("Sun Jun 13 22:51:24 2021", "Europe/Berlin", "de-DE", "2021-06-13T20:51:24Z", "ok"),
    ("20220213T065004Z", "Europe/Moscow", "ru-RU", "2022-02-13T06:50:04Z", "ok"),
    ("20220213065004Z", "Europe/Moscow", "ru-RU", "2022-02-13T06:50:04Z", "ok"),
    ("22 de junho de 2024, 11:44", "America/Sao_Paulo", "pt-BR", "2024-06-22T14:44:00Z", "ok"),
    ("24 июня 2025 23:35", "Europe/Moscow", "ru-RU", "2025-06-24T20:35:00Z", "ok"),
    ("2021-07-22T21:37:42+02:00[Europe/Paris]", "Europe/Paris", "fr-FR", "2021-07-22T19:37:42Z", "ok"),
    ("2021-07-22T21:37:42[Europe/Paris]", "Asia/Tokyo", "en-JP", "2021-07-22T19:37:42Z", "ok"),
    ("2022-01-05 09:24:14,337", "America/Sao_Paulo", "pt-BR", "2022-01-05T12:24:14.337Z", "ok"),
    ("13 Aug 2022 18:12:46 -0000", "America/New_York", "en-US", "2022-08-13T18:12:46Z", "ok"),
    ("2021-10-31 02:30 CET", "Europe/Berlin", "de-DE", "2021-10-31T01:30:00Z", "ok"),
    ("1579568350", "Asia/Tokyo", "en-JP", "2020-01-21T00:59:10Z", "epoch"),
    ("1580275524138", None, None, "2020-01-29T05:25:24.138Z", "epoch"),
    ("1610678382239791", None, None, "2021-01-15T02:39:42.239791Z", "epoch"),
    ("1672245621.675701", None, None, "2022-12-28T16:40:21.675701Z", "epoch"),
    ("999", None, None, None, "unparsed"),
    ("2021-10-31 02:30", "Europe/Berlin", "de-DE", None, "ambiguous"),
    ("2021-03-28 02:30", "Europe/Berlin", "de-DE", None, "nonexistent"),
    ("2021-03-28 02:30", None, None, None, "no_zone"),
    ("2021-03-28 02:30", "No/Where", "de-DE", None, "no_zone"),
    ("2021-03-28 02:30 XYZ", "Europe/Berlin", "de-DE", None, "no_zone"),
    ("2021-02-29 12:30", "Europe/Berlin", "de-DE", None, "impossible"),
    ("13/25/2021 12:30", "America/Chicago", "en-US", None, "impossible"),
    ("2021-02-28 25:61:00", "Europe/Berlin", "de-DE", None, "impossible"),
    ("2021-02-28 10:00 +9900", "Europe/Berlin", "de-DE", None, "impossible"),
    ("2020-04-18", "Europe/Berlin", "de-DE", None, "unparsed"),
    ("yesterday", "Europe/Berlin", "de-DE", None, "unparsed"),
    ("  ", "Europe/Berlin", "de-DE", None, "empty"),
    (None, "Europe/Berlin", "de-DE", None, "empty"),
    ("x" * 100_000, "Europe/Berlin", "de-DE", None, "unparsed"),
]


def micros(text):
    at = datetime.fromisoformat(text)
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, z string, l string")
    got = {r.i: (r.instant_us, r.instant_status) for r in normalise_instants(df, "t", "z", "l").collect()}
    for i, (text, _, _, instant, status) in enumerate(CASES):
        assert got[i] == (micros(instant) if instant else None, status), text


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Australia/Lord_Howe"])
def test_every_half_hour_against_zoneinfo(spark, zone):
    """Around all clock changes of a year, every local half hour has the candidates that zoneinfo gives."""
    start = datetime(2021, 1, 1)
    times = [start + timedelta(minutes=30 * k) for k in range(48 * 366)]
    df = spark.createDataFrame([(t.isoformat(), zone, "en-GB") for t in times], "t string, z string, l string")
    got = {r.t: r.instant_us for r in normalise_instants(df, "t", "z", "l").collect()}
    for t in times:
        own = {round((t.replace(tzinfo=ZoneInfo(zone), fold=f) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) for f in (0, 1)}
        back = {u for u in own if (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=u)).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t}
        assert got[t.isoformat()] == (back.pop() if len(back) == 1 else None), t


def test_policies(spark):
    df = spark.createDataFrame([("2021-10-31 02:30", "Europe/Berlin", "de-DE"), ("2021-03-28 02:30", "Europe/Berlin", "de-DE")], "t string, z string, l string")
    run = lambda **k: [r.instant_us for r in normalise_instants(df, "t", "z", "l", **k).collect()]
    assert run(ambiguous="earlier", nonexistent="forward") == [micros("2021-10-31T00:30:00Z"), micros("2021-03-28T01:30:00Z")]
    assert run(ambiguous="later")[0] == micros("2021-10-31T01:30:00Z")


def test_copies_clashing_names_and_empty_tables(spark):
    boxes = spark.createDataFrame([(1, "Europe/Berlin", "de-DE"), (1, "Europe/Berlin", "de-DE"), (None, "Asia/Tokyo", "en-JP")], "mailbox_id long, tz_name string, locale string")
    m = spark.createDataFrame([(1, 1, "2021-05-01 10:00", "x"), (1, 1, "2021-05-01 10:00", "y"), (2, None, "2021-05-01 10:00", "x"), (3, 9, "1620000000", None), (None, 1, "1620000000", None)], "msg_id long, mailbox_id long, date_raw string, instant_us string")
    rows = {r.msg_id: (r.instant_us, r.instant_status) for r in message_instants(m, boxes).collect()}
    assert rows == {1: (micros("2021-05-01T08:00:00Z"), "ok"), 2: (None, "no_zone"), 3: (1620000000000000, "epoch")}
    assert message_instants(m.limit(0), boxes.limit(0)).count() == 0
    kept = normalise_instants(m.withColumn("tz_name", F.lit("Asia/Tokyo")).withColumn("locale", F.lit(None).cast("string")), "date_raw", "tz_name", "locale")
    assert kept.columns.count("instant_us") == 1 and kept.count() == 5
