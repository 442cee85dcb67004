"""Operators of the document pipeline on small cases, with nulls, ties, copies and empty tables."""

import os
import random
from itertools import groupby

from pyspark.sql import functions as F

from lexflow.functions import text as fx
from lexflow.operators import indexes, listing, pages, sessions
from lexflow.sources.files import document_tree, mail_messages, read_index, write_index
from lexflow.streaming.updates import first_runs, newest_version, result_stream, upsert_index


def column(spark, rows, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_functions(spark):
    assert column(spark, ["", "a", "Straße"], fx.content_hash) == ["00000000", "e8b7be43", "%08x" % __import__("zlib").crc32("Straße".encode())]
    assert column(spark, ["a.b c", "9x", "--", None], fx.env_key) == ["A_B_C", "KEY_9X", "", None]
    assert column(spark, ["secretvalue", "postgres://u:pw@h/db"], fx.redacted_secret) == ["secr...", "postgres://u:***@h/db"]
    assert column(spark, ['<meta charset="UTF-8">', "<meta http-equiv=x content='text/html; charset=windows-1252'>", "<p>", "x" * 5000 + "<meta charset=utf-8>"], fx.declared_charset) == ["utf-8", "windows-1252", "", ""]
    assert column(spark, ["1700000000", "1700000000.5", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20", "2023-11-14T23:13:20+01:00", "soon", None], fx.moment_us) == [1700000000000000, 1700000000500000] + [1700000000000000] * 3 + [None, None]
    assert column(spark, [12, 1250, 3_450_000], fx.compact_count, "bigint") == ["12", "1.2k", "3.4M"]


def test_index_rules(spark):
    t = spark.createDataFrame([(1, "a", "5"), (2, "a", "x"), (3, "b", " 12 "), (4, "b", "1_000"), (5, "c", ""), (6, "d", None), (7, "e", "3.5")], "row_no long, file string, tokens string")
    assert {tuple(r) for r in indexes.token_index(t).collect()} == {("a", 5), ("b", 1000)}
    h = spark.createDataFrame([(1, "a", "1"), (2, "a", None), (3, None, "9")], "row_no long, file string, hash string")
    assert {tuple(r) for r in indexes.hash_index(h).collect()} == {("a", None), (None, "9")}
    now = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2"), ("d", "4")], "file string, hash string")
    was = spark.createDataFrame([("a", "1"), ("c", "3"), ("d", None)], "file string, hash string")
    assert {r.file for r in indexes.changed_files(now, was).collect()} == {"b", "c", "d"}
    assert {tuple(r) for r in indexes.tree_difference(was, now).collect()} == {("b", "extra"), ("c", "differs"), ("d", "differs")}
    assert indexes.run_summary(spark.createDataFrame([], "status string, tokens long")).first().asDict() == {"n_converted": 0, "n_unchanged": 0, "n_deferred_for_ocr": 0, "n_failed": 0, "n_results": 0, "tokens": 0}


def test_page_classes_and_verdicts(spark):
    df = spark.createDataFrame([(0.9, 5), (0.8, 20), (0.2, 20), (0.2, 3)], "c double, n int")
    assert [r[0] for r in df.select(indexes.page_class(F.col("c"), F.col("n"))).collect()] == ["image_only", "scan_ocr", "digital", "other"]
    v = spark.createDataFrame([(2, 1, 0, 1), (2, 0, 1, 1), (3, 0, 0, 2), (3, 1, 0, 1), (0, 0, 0, 0)], "p int, i int, s int, d int")
    assert [r[0] for r in v.select(indexes.majority_verdict(*(F.col(c) for c in "pisd"))).collect()] == ["scanned-image-only", "scan+ocr", "digital-text", "mixed/other", "mixed/other"]


def brute_sessions(rows):
    """The carry-forward and union of intervals, one row at a time."""
    out = {}
    for user, own in groupby(sorted(rows), key=lambda r: r[0]):
        last, spans = None, []
        for _, _, at, start, end in own:
            if start and at is not None:
                last = at
            if end and at is not None and last is not None and at > last:
                spans.append((last, at))
        total, reached = 0, None
        for b, e in sorted(spans):
            total += max(0, e - max(b, reached if reached is not None else b))
            reached = e if reached is None else max(e, reached)
        out[user] = (sorted(spans), total)
    return out


def test_sessions_against_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for pos in range(30_000):  # one session holds a third of all rows and spans many stretches
        at = None if rng.random() < 0.02 else pos * 60_000_000 + rng.randrange(-600_000_000, 600_000_000)
        kind = rng.random()
        rows.append((0 if rng.random() < 0.34 else rng.randrange(1, 40), pos, at, kind < 0.2, kind > 0.8))
    df = spark.createDataFrame(rows, "u int, pos long, at long, s boolean, e boolean")
    spans = sessions.carried_starts(df, "u", "pos", "at", "s", "e")
    want = brute_sessions(rows)
    got = {}
    for r in spans.collect():
        got.setdefault(r.session, []).append((r.begin_us, r.end_us))
    assert {u: sorted(v) for u, v in got.items()} == {u: v for u, (v, _) in want.items() if v}
    assert {r.session: r.covered_us for r in sessions.cover(spans).collect()} == {u: t for u, (v, t) in want.items() if v}


def test_positions_and_fuzzy(spark):
    rng = random.Random(2)
    values = [None if rng.random() < 0.1 else rng.randrange(50) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int")
    got = {r.k: r.position for r in listing.positions(df, F.col("v").asc_nulls_first(), F.col("k")).collect()}
    order = sorted(range(3000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {k: n for n, k in enumerate(order, 1)}
    names = spark.createDataFrame([(1, "Settlement Agreement 2"), (2, "Deed"), (3, None), (4, "settlement agreement 2")], "k int, name string")
    assert {r.k for r in listing.fuzzy_filter(names, "name", "settlment agreement").collect()} == {1, 4} and listing.fuzzy_filter(names, "name", "").count() == 4
    words = ["settlement offer", "setlement ofer", "the settlement offers", "offer", "settle", "unsettled payment offer", "deed", "sttlmnt ffr", "settlement  offer x", "ettlement offe"]
    many = spark.createDataFrame(list(enumerate(words)), "k int, name string")
    for least in (60.0, 80.0, 90.0):
        assert {r.name for r in listing.fuzzy_filter(many, "name", "settlement offer", least).collect()} == {w for w in words if listing.partial_ratio("settlement offer", w) >= least}
    assert listing.partial_ratio("abc", "xxabcxx") == 100.0 and listing.partial_ratio("abc", "xyz") < 50


def test_document_states(spark):
    p = spark.createDataFrame([(1, "s", 1, "i", True, "ab", None), (1, "s", 1, "i", True, "ab", None), (2, "s", 2, "i", True, "c", None), (3, "t", 1, "i", True, "x", None), (4, "t", 2, "i", False, None, "blur"), (5, "t", 3, "i", True, None, None)], "page_id long, sidecar_rel string, page_no int, image string, ok boolean, markdown string, error string")
    got = {r.sidecar_rel: tuple(r)[1:] for r in pages.document_states(p).collect()}
    assert got == {"s": (2, 0, None), "t": (3, 2, "2/3 page(s) failed: blur")}


def test_tree_mail_and_index_files(spark, tmp_path):
    for name, data in {
        "a/x.eml": b"From: A <a@x.example>\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nTo: b@x.example\r\n\r\nBody\r\n", "a/.dot.pdf": b"1", "a/~tmp.docx": b"1", ".git/y.eml": b"1", "a/cache/z.pdf": b"1", "b.MBOX": b"", "n.txt": b"1",
        "m.mbox": b"From a Mon\nSubject: one\n\nfirst\n>From here\n\nFrom b Mon\nSubject: two\n\nsecond\n", "bad.eml": b'Content-Type: text/plain; charset="no-such"\n\n\xff\xfe', "empty.mbox": b"no separator\n",
        "w.mht": b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"; start="<r>"\n\n--b\nContent-Type: text/html\nContent-ID: <q>\n\n<p>no</p>\n--b\nContent-Type: text/html\nContent-ID: <r>\n\n<p>root</p>\n--b--\n',
        ".hid.eml": b"Subject: s\n\nSeen\n", "only.eml": b'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>x</p>\n--b--\n',
        "both.mht": b'Content-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/plain\n\nplain\n--b\nContent-Type: text/html\n\n<p>Page</p>\n--b--\n',
    }.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.file for r in document_tree(spark, str(tmp_path), "cache").collect()} == {"a/x.eml", "a/.dot.pdf", "b.MBOX", "m.mbox", "bad.eml", "empty.mbox", "w.mht", ".hid.eml", "only.eml", "both.mht"}
    rows = mail_messages(spark, str(tmp_path)).collect()
    by = {(os.path.basename(r.path), r.pos): r for r in rows}
    assert by["x.eml", 0].subject == "Grüße" and by["m.mbox", 1].body.strip() == "second" and by["w.mht", 0].body == "root"
    assert by["bad.eml", 0].body.startswith("�") and by["empty.mbox", None].error
    assert by["m.mbox", 0].body == "first\nFrom here\n\n" and by[".hid.eml", 0].body.strip() == "Seen" and by["only.eml", 0].body is None and by["both.mht", 0].body == "Page"
    path = str(tmp_path / "index.csv")
    index = spark.createDataFrame([("b,1", "2"), ("a", "1"), ("ü", None)], "file string, hash string")
    assert write_index(index, path, ["file", "hash"]) and not write_index(index, path, ["file", "hash"])
    assert open(path, "rb").read() == 'file,hash\r\na,1\r\n"b,1",2\r\nü,\r\n'.encode()
    assert {(r.file, r.hash) for r in read_index(spark, path, "hash").collect()} == {("a", "1"), ("b,1", "2"), ("ü", None)}
    assert read_index(spark, path + "x", "hash").count() == 0


def test_mailbox_in_ranges(tmp_path):
    from lexflow.sources.files import mailbox_messages

    data = b"".join(b"From a\nSubject: %d\n\nline\n>>From x\n\n" % k for k in range(40))
    path = str(tmp_path / "m.mbox")
    (tmp_path / "m.mbox").write_bytes(data)
    whole = list(mailbox_messages(path, 0, len(data) + 1))
    assert len(whole) == 40 and b">From x" in whole[0] and b">>From" not in whole[0]
    for size in (1, 7, 50, 333):
        assert [m for k in range(0, len(data) + 1, size) for m in mailbox_messages(path, k, k + size)] == whole


def test_fuzzy_filter_prunes_nothing_that_scores(spark):
    import random

    rng = random.Random(4)
    names = ["abc#defhijklnop#qrst"]
    for _ in range(400):
        n = list("abcdefghijklmnopqrst")
        for _ in range(rng.randrange(5)):
            n[rng.randrange(len(n))] = rng.choice("#xyz")
        names.append("".join(n) + rng.choice(["", " tail"]))
    df = spark.createDataFrame([(n,) for n in set(names)], "title string")
    got = {r.title for r in listing.fuzzy_filter(df, "title", "abcdefghijklmnopqrst").collect()}
    assert got == {n for n in set(names) if listing.partial_ratio("abcdefghijklmnopqrst", n) >= 90} and "abc#defhijklnop#qrst" in got


def test_recogniser_output_in_all_shapes(spark):
    from lexflow.operators import records

    rec = lambda i, md: '{"image": "%s", "ok": true, "markdown": "%s"}' % (i, md)
    rows = [("wrapper", '{"results": [%s, 5, %s]}' % (rec("a", "x"), rec("a", "y"))), ("array", "[%s,\n%s]" % (rec("a", "x"), rec("b", "y"))), ("one", rec("a", "x")), ("lines", rec("a", "x") + "\n\n" + rec("a", "z") + "\n"), ("bad", "no json"), ("none", None), ("named", '{"image": 7}')]
    df = spark.createDataFrame(rows, "key string, output string").withColumn("image", F.lit("clash"))
    last = {(r["key"], r.image): r.markdown for r in records.recognised_records(df, "key", "output").collect()}
    assert last == {("wrapper", "a"): "y", ("array", "a"): "x", ("array", "b"): "y", ("one", "a"): "x", ("lines", "a"): "z"}
    first = {(r["key"], r.image): r.markdown for r in records.recognised_records(df, "key", "output", first=True).collect()}
    assert first["lines", "a"] == "x" and first["wrapper", "a"] == "x"


def test_usage_windows(spark):
    from lexflow.operators import records

    rows = [(1, '{"rate_limits": {"a": {"used_percentage": 99.5, "resets_at": 2000}, "b": {"used_percentage": true}, "c": {"used_percentage": 50, "resets_at": "1970-01-01T00:00:01"}, "d": {"used_percentage": 91, "resets_at": "soon"}, "e": 4, "f": {"used_percentage": 1, "resets_at": "1970-01-01T01:00:00Z"}}}'), (2, "{}"), (3, "x"), (4, None), (5, '{"rate_limits": []}')]
    got = records.live_windows(spark.createDataFrame(rows, "k int, payload string"), "k", "payload", F.lit(1_000_000_000)).withColumn("s", records.window_state(F.col("percent")))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 99.5, 2_000_000_000, "exhausted"), (1, "d", 91.0, None, "offered"), (1, "f", 1.0, 3_600_000_000, "open")}
    assert [r[0] for r in spark.createDataFrame([(0,), (1,)], "m long").select(records.is_stale(F.col("m"), F.lit(21_600_000_001))).collect()] == [True, False]


def test_flattened_settings_and_environment_lines(spark):
    from lexflow.operators import records

    df = spark.createDataFrame([(1, '{"a": {"b-c": [1, {"x": true}], "A B C": 1}, "9": null, "deep": {"deep": {"deep": "v"}}, "a_b_c_1": "2"}'), (2, "broken"), (3, None)], "k int, payload string")
    got = {(r.name, r.value, r.state) for r in records.flattened(df, "k", "payload").collect()}
    assert got == {("A_B_C_1", "1", "conflict"), ("A_B_C_2_X", "true", "set"), ("A_A_B_C", "1", "set"), ("KEY_9", None, "null"), ("DEEP_DEEP_DEEP", "v", "set")}
    lines = spark.createDataFrame(list(enumerate(["A=1", " export B = 'it\\'s' # note", "# C=3", "", "A=\"two words\"", "D=", "E=plain text # c"])), "pos long, line string")
    assert [(r.name, r.value) for r in records.env_values(lines, "line", "pos").orderBy("pos").collect()] == [("A", "1"), ("B", "it's"), ("A", "two words"), ("D", ""), ("E", "plain text")]
    assert column(spark, ["abc1", "a b", "it's"], lambda c: records.env_line(F.lit("K"), c)) == ["K=abc1", "K='a b'", "K='it\\'s'"]


def test_assembled_documents(spark):
    rows = [(1, "a", 2, True, "two", None), (2, "a", 1, True, "one", None), (2, "a", 1, True, "one", None), (3, "b", 1, True, "x", None), (4, "b", 2, False, None, "broken"), (5, "c", 1, None, None, None)]
    got = {r.sidecar_rel: (r.pages, r.failure, r.text) for r in pages.assembled_documents(spark.createDataFrame(rows, "page_id long, sidecar_rel string, page_no int, ok boolean, markdown string, error string")).collect()}
    assert got == {"a": (2, None, "one\n\ntwo"), "b": (2, "1/2 page(s) failed: broken", None), "c": (1, "1/1 page(s) failed: no result returned", None)}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", "converted", "h1", "2024-01-01 00:00:00"), ("a", "converted", "h2", "2024-01-03 00:00:00"), ("b", "failed", None, "2024-01-01 00:00:00"), ("a", "converted", "h1", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "source_rel string, status string, file_hash string, t string").select("source_rel", "status", "file_hash", F.to_timestamp("t").alias("run_at"))
    df.repartition(3).write.parquet(source)
    stream = result_stream(spark, source, files_at_once=1)
    upsert_index(stream, str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    assert [(r.source_rel, r.file_hash) for r in newest_version(spark, str(tmp_path / "index")).collect()] == [("a", "h2")]
    q = first_runs(result_stream(spark, source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.source_rel, r.file_hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "h1"), ("a", "h2")]


def test_streams_of_pages_and_flags(spark, tmp_path):
    from lexflow.streaming.updates import complete_documents, expired_flags, versions

    rows = [("a", 1, True, "2024-01-01 00:00:00"), ("a", 1, True, "2024-01-01 00:00:05"), ("b", 2, True, "2024-01-01 00:00:00"), ("a", 3, True, "2024-01-01 00:00:09"), ("b", 4, False, "2024-01-01 00:01:00"), ("a", 9, True, "2024-01-03 00:00:00")]
    source = str(tmp_path / "pages")
    spark.createDataFrame(rows, "sidecar_rel string, page_id long, ok boolean, t string").select("sidecar_rel", "page_id", "ok", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    totals = spark.createDataFrame([("a", 3), ("b", 2)], "sidecar_rel string, pages int")
    done = complete_documents(stream(), totals).writeStream.format("memory").queryName("complete").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from complete").collect()] == [("a", 3, 3)]
    gone = expired_flags(stream(), "sidecar_rel", "at").writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    gone.awaitTermination(60)
    assert {(r.sidecar_rel, r.n) for r in spark.sql("select * from expired").collect()} == {("a", 3), ("b", 2)}
    assert versions(spark, str(tmp_path / "nowhere")) == []


def test_checkpoint_folder_is_shared():
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from lexflow.runtime import checkpoint_dir

    session = MagicMock()
    session.conf.get = lambda k, default=None: None if k == "spark.checkpoint.dir" else "/tmp/w"
    session.sparkContext.getConf.return_value = SimpleNamespace(get=lambda k: None)
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.sparkContext.master = "local[4]"
    assert checkpoint_dir(session) == "/tmp/w/_checkpoints"
    session.sparkContext.master = "spark://host:7077"
    with __import__("pytest").raises(ValueError):
        checkpoint_dir(session)
