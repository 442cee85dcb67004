import pytest
from pyspark.sql import functions as F

from lexflow.llm import personal
from lexflow.llm.personal import Names, checksum, header_names, id_score, luhn, mod_97, personal_information, personal_lines, redacted, redacted_messages
from lexflow.runtime import table

NAMES = Names({"kendra", "will", "june", "mark", "götz", "tobias", "арсений"}, {"lemley", "beixdale", "moranztev", "gerwald", "buxthorne", "kialdale-korncombe", "громухин"})
# A text and the kinds on each of its lines.
CASES = [
    ("Write to a.b@c.example or wolf (at) x.example.com.", [{"email"}]),
    ("Please call Kendra Lemley on 340.555.0153 before.", [{"name", "phone"}]),
    ("Her number is +44 (0)1632\n960969. Paid £434 800 on 17 January 2016.", [{"phone"}, {"phone"}]),
    ("Bitte unter 030/23125-766 oder 0049-30-23125299 anrufen", [{"phone"}]),
    ("Tel. +33 1 99 00 17 41\n176, rue des Tanneurs, 00411 Braexmere", [{"phone"}, {"address"}]),
    ("SSN 666-69-8241, NI number QQ 58 67 39 C", [{"id_number"}]),
    ("gave passport no.\nJ21VL8815 as proof", [set(), {"id_number"}]),
    ("Steuer-ID 00 250 210 263; ИНН 000007482492; DNI 00726340-H; CPF 000.867.335-19", [{"id_number"}]),
    ("Reference 4:25-cv-10646, INV 2020/9012, DV-8080716, HRB 0014.7, 28 O 388/26, 12.05.2021 10:30", [set()]),
    ("card 4111 1111 1111 1112; IBAN GB00 WEST 1234 5698 7654 32; 123.456.789-00; INV 666-69-8241; file 529.982.247", [set()]),
    ("529.982.247-25 and 12345678Z; order no. 000065846885, 00759176252", [{"id_number"}]),
    ("card 4111 1111 1111 1111 and 4111 1111 1111 1112", [{"id_number"}]),
    ("Pay to GB82 WEST 1234 5698 7654 32.", [{"id_number"}]),
    ("moved to Flat 40, 163 Larkspur Lane,\nKaelkcourt L3 9QL.", [{"address"}, {"address"}]),
    ("P.O. Box 77, Staexalba 00234\nFärbergasse 73a, 00119 Weinddorf\nпер. Кузнечный, д. 25, кв. 87", [{"address"}, {"address"}, {"address"}]),
    ("Plaza del Peñón 104, 1.º X, 00034 Bramford; Rua das Oliveiras, 194 – Leithdorf, 00061-675", [{"address"}]),
    ("Will that work? June is free, and I can mark the grant.", [set()]),
    ("Hi Will,\nWill Beixdale met kendra lemley in June 2021.\nJune", [{"name"}, {"name"}, {"name"}]),
    ("G√∂tz Gerwald und GERWALD; Арсений Громухин", [{"name"}]),
    ("Tobias Kialdale-Korncombe’s file; Kraexwick Marine SA", [{"name"}]),
    ("em SÃO TOBIAS não há", [set()]),
    ("> > kendra.lemley@x.example\n> K. Lemley", [{"email"}, {"name"}]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_lines(text, want):
    found = personal_lines(text, NAMES)
    got = [{k for n, k in found if n == i} for i in range(1, len(want) + 1)]
    assert got == want
    hidden = redacted(text, NAMES)
    assert personal_lines(hidden, NAMES) == set() and hidden.count("\n") == text.count("\n")


def test_validators():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and mod_97("GB82 WEST 1234 5698 7654 32") and not mod_97("GB82WEST12345698765433")
    assert checksum("dni", "12345678Z") and not checksum("dni", "12345678A") and checksum("cpf", "529.982.247-25") and checksum("nir", "1 55 08 31 168 025 38"[:0] + "255081416802538")
    assert redacted("> a kendra@x.example\r\nHi Kendra Lemley,", NAMES) == "> a [EMAIL]\r\nHi [NAME],"
    assert redacted(None, NAMES) is None and redacted("", NAMES) == "" and personal_lines(None, NAMES) == set()


def test_check_digits_and_words_before_move_the_score():
    valid = {"cpf": "529.982.247-25", "dni": "12345678Z", "nie": "X1234567L", "snils": "112-233-445 95", "inn": "7707083893", "tax_id": "86095742719", "card": "4111111111111111", "iban": "DE89370400440532013000"}
    for kind, number in valid.items():
        last = number[-1]
        wrong = number[:-1] + next(c for c in ("1234567890" if last.isdigit() else "ABCDEFGH") if c != last)
        assert checksum(kind, number) and not checksum(kind, wrong), kind
        assert id_score(kind, number, False, False) > id_score(kind, wrong, False, False) < id_score(kind, wrong, True, False)
        assert id_score(kind, number, True, True) < id_score(kind, number, True, False)
    assert checksum("inn", "500100732259") and checksum("ssn", "666-69-8241") is None


def test_lexicon_beyond_its_bound_gives_the_same(spark, monkeypatch):
    m, b = table(spark, "/root/testdata/sf0.001", "messages"), table(spark, "/root/testdata/sf0.001", "mailboxes")
    found = {tuple(r) for r in personal_information(m, b).collect()}
    hidden = {tuple(r) for r in redacted_messages(m, b).collect()}
    monkeypatch.setattr(personal, "MOST_NAMES", 5)
    assert {tuple(r) for r in personal_information(m, b).collect()} == found and {tuple(r) for r in redacted_messages(m, b).collect()} == hidden


def test_header_names():
    assert header_names('"Lemley, Kendra" <k@x.example>; Contracts Desk <d@x.example>, w@x.example (Will Beixdale)') == [("kendra", True), ("lemley", False), ("will", True), ("beixdale", False)]
    assert header_names(None) == [] and header_names("a@b.example") == []


def test_operator(spark):
    rows = [(1, "Kendra Lemley <k@x.example>", "Contracts Desk <d@x.example>", None, "Hi Kendra,\n> call 340.555.0153"), (2, None, None, None, None), (3, "", " ", "", ""), (None, "Will Beixdale", None, None, "Will Beixdale"), (1, "Kendra Lemley <k@x.example>", "Contracts Desk <d@x.example>", None, "Hi Kendra,\n> call 340.555.0153"), (4, None, None, None, "x " * 60_000)]
    df = spark.createDataFrame(rows, "msg_id long, sender string, to_addrs string, cc_addrs string, body string").withColumn("kind", F.lit("clash")).withColumn("field", F.lit(1))
    boxes = spark.createDataFrame([("Tobias Buxthorne",), (None,)], "display_name string")
    got = personal_information(df, boxes)
    assert {tuple(r) for r in got.collect()} == {(1, "sender", 1, "email"), (1, "sender", 1, "name"), (1, "to_addrs", 1, "email"), (1, "body", 1, "name"), (1, "body", 2, "phone")} and got.count() == 5
    hidden = {r.msg_id: r for r in redacted_messages(df, boxes).collect()}
    assert hidden[1].sender == "[NAME] <[EMAIL]>" and hidden[1].body == "Hi [NAME],\n> call [PHONE]" and hidden[2].body is None and len(hidden) == 4
    assert personal_information(df.limit(0), boxes.limit(0)).count() == 0 and redacted_messages(df.limit(0), boxes).count() == 0


def test_tables(spark):
    found = personal_information(table(spark, "/root/testdata/sf0.01", "messages"), table(spark, "/root/testdata/sf0.01", "mailboxes"))
    kinds = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    assert all(kinds[k] > 100 for k in ("email", "phone", "id_number", "address", "name"))
