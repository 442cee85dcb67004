import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexflow.llm import scans
from lexflow.llm.scans import damage, fuzzy_key, page_number, repaired_pages, split_furniture
from lexflow.runtime import table

NAMES = ["", "alpha", "bravo", "delta", "foxtrot", "golf", "hotel", "juliet", "kilo"]
BODY = "The interim agreement covers the quarterly statement of the parties and the final register."


def tables(spark, pages, verdict="scan+ocr", ocr_done=True):
    results = spark.createDataFrame([("a.pdf", "a.md", ocr_done), ("a.pdf", "a.md", None), ("b.pdf", "b.md", False), (None, None, None)], "source_rel string, sidecar_rel string, ocr_done boolean")
    index = spark.createDataFrame([(1, "a.pdf", "digital-text"), (2, "a.pdf", verdict), (3, "b.pdf", verdict), (4, None, None)], "row_no long, file string, verdict string").withColumn("page_id", F.lit(7))
    return results, index, spark.createDataFrame(pages, "page_id long, sidecar_rel string, page_no int, markdown string").withColumn("kind", F.lit("clash"))


def sample():
    pages = []
    for k in range(1, 9):
        head = "SHARE REGISTER OF KREDA" if k != 3 else "SHARE REG|STER OF KREDA"
        lines = [head, "", f"Under the terms of {NAMES[k]} all of it stands."] + [BODY] * 2 + ["It was exe-", "cuted by a third-", "party in 2O17 with the " + ("quarter1y" if k == 2 else "quarterly")] + (["state¬", "ment ~ as agreed"] if k == 2 else [f"statement of {NAMES[k]}."]) + ["", f"Page {k} of 8"]
        pages.append((k, "a.md", k, "\n".join(lines)))
    pages.append((50, "a.md", 9, "executed once, executed twice, third-party executed executed executed third-party executed\nquarterly quarterly"))
    return pages + pages[:2] + [(60, "a.md", 10, None), (61, "a.md", 11, " \n "), (62, "b.md", 1, "12"), (None, "a.md", 12, "7"), (63, None, 1, "7")]


def test_kinds(spark):
    got = defaultdict(set)
    rows = damage(*tables(spark, sample())).collect()
    for r in rows:
        got[r.kind].add((r.page_id, r.line_no))
    assert len(rows) == len({tuple(r) for r in rows})
    assert got["header"] == {(k, 1) for k in range(1, 9)}
    assert got["page_no"] == {(k, 12 if k == 2 else 11) for k in range(1, 9)}
    assert got["hyphen"] == {(k, 6) for k in range(1, 9)} | {(2, 9)}
    assert got["misread"] == {(k, 8) for k in range(1, 9)} | {(2, 10)}


def test_furniture_of_three_and_four_lines(spark):
    pages = []
    for k in range(1, 9):
        head = [f"p. {k}", "Anlage K 28", "Case No. INV 2024/62299", "PRIVILEGED AND CONFIDENTIAL"][: 3 + k % 2]
        pages.append((k, "a.md", k, "\n".join([*head, f"Under the terms of {NAMES[k]} all of it stands.", BODY, BODY, f"So {NAMES[k]} ended it.", "Execution copy of the parties", "Anlage K 30", "Share register of Kreda"])))
    got = {(r.page_id, r.line_no) for r in damage(*tables(spark, pages)).collect() if r.kind in ("header", "page_no")}
    assert got == {(k, n) for k in range(1, 9) for h in [3 + k % 2] for n in [*range(1, h + 1), *range(h + 5, h + 8)]}


def near_pages():
    heads = ["SHARE REGISTER OF KREDA AND PARTNERS"] * 4 + ["SHARE REGISTER BY MARLA AND PARTNERS"] * 3 + ["SHARE REGISTER BY MAXLA AND PARTNERS"]
    feet = {1: ["Valuation of Raelkcourt"], 2: ["Valuatiom of Raelkcourt"], 3: ["Minutes of the Parmel board", "Mlnutes of the Parmek board"]}
    return [(k, "a.md", k, "\n".join([heads[k - 1], f"Under the terms of {NAMES[k]} all of it stands.", BODY, BODY, f"So {NAMES[k]} ended it.", *feet.get(k, [])])) for k in range(1, 9)]


@pytest.mark.parametrize("many", [scans.MANY, 0])
def test_near_form_of_any_other_key_counts(spark, monkeypatch, many):
    monkeypatch.setattr(scans, "MANY", many)
    got = {(r.page_id, r.line_no) for r in damage(*tables(spark, near_pages())).collect() if r.kind == "header"}
    assert got == {(k, 1) for k in range(1, 9)} | {(1, 6), (2, 6)}  # two near lines of one page are no repetition


def test_near_keys_always_share_a_piece():
    rng, near = random.Random(3), 0
    for _ in range(4000):
        key = "".join(rng.choices("abc", k=rng.choice([6, 7, 8, 15, 16, 23, 24, 25, 40])))
        other = list(key)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        other = "".join(other)
        if len(other) >= scans.SHORTEST and edits(key, other) <= scans.errors_allowed(len(key)):
            near += 1
            assert set(scans.places(pd.Series([key]))[0]) & set(scans.pieces(pd.Series([other]))[0]), (key, other)
    assert near > 1000


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_repaired_text(spark):
    text = {r.page_id: r.text for r in repaired_pages(*tables(spark, sample())).collect()}
    assert text[2].endswith("It was executed by a third-party in 2017 with the quarterly statement as agreed") and text[2].startswith("Under the terms of bravo")
    assert set(text) == {*range(1, 9), 50}


@pytest.mark.parametrize("kwargs", [{"verdict": "digital-text"}, {"verdict": "error: broken"}, {"verdict": None}, {"ocr_done": False}, {"ocr_done": None}])
def test_other_sidecars_are_left_alone(spark, kwargs):
    assert damage(*tables(spark, sample(), **kwargs)).count() == 0


def test_empty(spark):
    results, index, pages = tables(spark, sample())
    assert damage(results, index, pages.limit(0)).count() == 0 and damage(results.limit(0), index, pages).count() == 0


def test_number_forms():
    for line, value in [("15", 15), ("5/46", 5), ("Page 2 of 4", 2), ("3 |", 3), ("p. 400", 400), ("- 1 -", 1), ("[4]", 4), ("Seite 289", 289), ("4O", 40), ("xiv", 14), ("lxix", 69), ("NGC0074227", 74227), ("DV-00O12", 12)]:
        assert page_number(line)[:2] == (True, value), line
    for line in ["3.7", "1,342", "(f)", "2019.", "ARTICLE II", "Kreda"]:
        assert not page_number(line)[0], line
    assert split_furniture("35 |   BRUDRERN GMBH")[:3] == ("BRUDRERN GMBH", True, 35)
    assert fuzzy_key("Anla9c K 25") == fuzzy_key("Anlage K 25") and fuzzy_key("Execiition c0py") == fuzzy_key("Execution copy")


def test_numbers_of_capital_and_dotless_letters_and_long_stamps(spark):
    for line, value in [("L2", 12), ("Page 1L", 11), ("4İ", 41), ("ı", 1), ("xıv", 14), ("NGCO07L227", 71227)]:
        assert page_number(line)[:2] == (True, value), line
    assert page_number("AB12345678901234567890123") == (True, 901234567890123, "AB12345678#")
    pages = [(k, "a.md", k, "\n".join([f"So {NAMES[k]} began.", BODY, BODY, BODY, f"AB1234567890123456789012{k}" if k < 4 else f"Page L{k}"])) for k in range(1, 9)]
    pages.append((9, "a.md", None, "\n".join(["So nobody began.", BODY, BODY, BODY, "L9"])))
    got = {(r.page_id, r.line_no) for r in damage(*tables(spark, pages)).collect() if r.kind == "page_no"}
    assert got == {(k, 5) for k in range(1, 9)}


def test_tables(spark):
    t = [table(spark, "/root/testdata/sf0.01", n) for n in ("processing_results", "ocr_index", "sidecar_pages")]
    counts = {r.kind: r["count"] for r in damage(*t).groupBy("kind").count().collect()}
    assert all(counts.get(k, 0) > 50 for k in ("header", "page_no", "hyphen", "misread"))


def test_error_in_a_cut_word_is_on_its_own_line(spark):
    text = "\n".join(["registered register " * 10, "the re-", "gist@red seat and the regi@t-", "ered office"])
    got = {(r.line_no, r.kind) for r in damage(*tables(spark, [(1, "a.md", 1, text)])).collect()}
    assert got == {(2, "hyphen"), (3, "hyphen"), (3, "misread")}
    text = "\n".join(["registered register " * 10, "the rcgi-", "stered seat and the regi-", "stercd office"])
    got = {(r.line_no, r.kind) for r in damage(*tables(spark, [(1, "a.md", 1, text)])).collect()}
    assert got == {(2, "hyphen"), (3, "hyphen"), (2, "misread"), (4, "misread")}
