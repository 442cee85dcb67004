import unicodedata
from itertools import combinations

from pyspark.sql import functions as F

from lexflow.llm import lookalikes
from lexflow.llm.lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, JOINED, canonical_documents, look_alike_pairs
from lexflow.runtime import table

LONG = "long text " * 20_000
DOCS = [
    (1, "Kreda Ltd paid"), (2, "Krеda Ltd paid"), (3, "Kreda​ Ltd\xa0paid"), (4, "KREDA Ltd paid"), (5, "Kreda Ltd paid"),
    (6, "caf\xe9 co-op ﬁle"), (7, "café co‑op file"), (8, "cafe co-op file"), (9, "ｃａｆé co‐op file"),
    (10, ""), (11, None), (12, LONG), (13, LONG + "­"), (14, LONG.replace("o", "о")),
    (15, "a – b"), (16, "a - b"), (17, "ё ï"), (18, "ë ї"), (19, "a\nb"), (20, "a b"), (None, "Kreda Ltd paid"), (3, "Kreda​ Ltd\xa0paid"),
]


def reference_form(text):
    """Brute-force form of the equivalence, one character at a time."""
    letters = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))
    out = []
    for ch in unicodedata.normalize("NFD", text):
        kind = unicodedata.category(ch)
        how = unicodedata.decomposition(ch).split(" ")
        if kind == "Cf":
            continue
        if kind == "Zs":
            ch = " "
        elif ch in "‐‑":
            ch = "-"
        elif how[0] in ("<wide>", "<narrow>", "<font>"):
            ch = chr(int(how[1], 16))
        ch = JOINED.get(ch, ch)
        out.append(letters.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


def brute_pairs(rows):
    rows = sorted({r for r in rows if r[0] is not None and r[1]})
    return {(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] != b[1] and reference_form(a[1]) == reference_form(b[1])}


def test_pairs_on_fixture(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {tuple(r) for r in look_alike_pairs(df).collect()}
    assert got == brute_pairs(DOCS) and (1, 2) in got and (6, 7) in got and (17, 18) in got and (15, 16) not in got


def test_canonical_forms(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = canonical_documents(df).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r.canonical_text for r in rows}
    assert by[1] == by[2] == by[3] == by[5] == "Kreda Ltd paid" and by[4] == "KREDA Ltd paid"
    assert by[10] == "" and by[11] is None and by[12] == by[13] == by[14] and by[6] == by[7] == by[9] != by[8]


def test_pairs_on_tables_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        if t:
            groups.setdefault(reference_form(t), []).append((i, t))
    want = set().union(*(brute_pairs(g) for g in groups.values()))
    assert {tuple(r) for r in look_alike_pairs(docs).collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert look_alike_pairs(df).count() == 0 and canonical_documents(df).count() == 0


def test_candidates_by_shuffle_give_the_same(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    pairs = {tuple(r) for r in look_alike_pairs(docs).collect()}
    forms = {r.doc_id: (r.class_id, r.canonical_text) for r in canonical_documents(docs).collect()}
    monkeypatch.setattr(lookalikes, "FEW", 0)
    assert {tuple(r) for r in look_alike_pairs(docs).collect()} == pairs
    assert {r.doc_id: (r.class_id, r.canonical_text) for r in canonical_documents(docs).collect()} == forms


def test_composed_and_decomposed_forms_share_a_key():
    source, target = lookalikes.key_table()
    table_of = dict.fromkeys(map(ord, source[len(target) :])) | {ord(a): b for a, b in zip(source, target)}
    key = lambda t: t.translate(table_of)
    mapped, invisible = lookalikes.character_table()
    assert all(key(a) == key(b) for a, b in mapped.items()) and not any(key(c) for c in invisible)
    wrong = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.normalize("NFD", c) != c and key(c) != key(unicodedata.normalize("NFD", c))]
    assert wrong == []


def test_scripts_beyond_latin(spark):
    texts = ["한국어", "ガギ", "أب", "क़", "ക്കോ", "φαίνω", "Å", "plain", "mark", "ｶﾞ", "1≯2"]
    rows = [(2 * k, unicodedata.normalize("NFC", t)) for k, t in enumerate(texts)] + [(2 * k + 1, unicodedata.normalize("NFD", t)) for k, t in enumerate(texts)]
    rows += [(100, "mark؜"), (101, "ma\u0001rk"), (102, "ガ")]
    want = {(2 * k, 2 * k + 1) for k, t in enumerate(texts) if unicodedata.normalize("NFC", t) != unicodedata.normalize("NFD", t)}
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and {(16, 100), (17, 100), (18, 102), (19, 102)} <= got and not any({a // 2, b // 2} == {7, 8} for a, b in got)


def test_text_that_many_documents_share(spark):
    rows = [(k, "Kreda Ltd paid") for k in range(300)] + [(1000, "Krеda Ltd paid"), (1001, "Kreda Ltd\xa0paid")]
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, x) for k in range(300) for x in (1000, 1001)} | {(1000, 1001)}
