import pytest
from pyspark.sql import functions as F

from lexflow.llm.garbled import _garble, finder, garbled_fields, restored_messages
from lexflow.runtime import table

SOUND = [
    "Für die Prüfung der Bücher gilt: die Übergabe erfolgt später, so Frau Müller.",
    "La cláusula última menciona el año y la señal. ¿Le parece bien mañana?",
    "A cláusula de rescisão não contempla a notificação; SÃO TOMÁS e NÃO HÁ OBJEÇÃO.",
    "Résumé de l’article 16 – la pièce complémentaire est déjà signée.",
    "Уважаемый Родион! Сообщаем, что реестр требований уточняет порядок расчётов.",
    "The sum of £9,500 – see § 4 – won’t change: “best endeavours” cost €5.",
]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252")]


def cases():
    for s in SOUND:
        for pair in PAIRS:
            g = _garble(s, pair)
            if g and sum(ord(c) > 127 for c in g) >= 2:
                yield s, g


def corpus():
    rows = [(i, s, s.upper() + "\n" + s) for i, s in enumerate(SOUND * 30)]
    rows += [(1000 + i, "plain", f"Sound text.\n{g}\n> {g}") for i, (_, g) in enumerate(cases())]
    return rows + [(5000, None, ""), (5001, "", None), (5002, "x" * 200_000, "é" * 50_000), (5003, "A��O", "ok"), (None, "Ã¼ber", "Ã¼"), (1000, rows[-1][1], None)]


def test_found_exactly(spark):
    rows = corpus()
    df = spark.createDataFrame(rows[:-1] + rows[180:182], "msg_id long, subject string, body string").withColumn("field", F.lit("clash"))
    got = {tuple(r) for r in garbled_fields(df).collect()}
    assert got == {(i, "body") for i, *_ in rows if i and 1000 <= i < 5000} | {(5003, "subject")}


def test_round_trip(spark):
    df = spark.createDataFrame(corpus()[:-1], "msg_id long, subject string, body string")
    got = {r.msg_id: r for r in restored_messages(df).collect()}
    good = sum(got[1000 + i].body == f"Sound text.\n{s}\n> {s}" for i, (s, _) in enumerate(cases()))
    assert good >= 0.75 * len(list(cases())), good / len(list(cases()))
    assert all(got[i].body == s.upper() + "\n" + s for i, s in enumerate(SOUND * 30)) and got[5000].subject is None and got[5002].body == "é" * 50_000


@pytest.mark.parametrize("operator", [garbled_fields, restored_messages])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], "msg_id long, subject string, body string")).count() == 0


def test_tables(spark):
    n = garbled_fields(table(spark, "/root/testdata/sf0.01", "messages")).count()
    assert 40 < n < 250


def test_sound_words_beside_garbled_ones_stay_and_all_pairs_are_put_right(spark):
    german, french = "Für die Prüfung der Bücher gilt die Übergabe später", "Résumé de la pièce complémentaire déjà signée"
    one, two = _garble(german, ("cp1252", "mac_roman")), _garble(french, ("cp1252", "cp437"))
    rows = [(i, None, f"{german}\n{french}\nmit Grüße aus") for i in range(100)]
    rows += [(1000, None, f"{one} mit Grüße aus"), (1001, None, "\n".join([one, two, _garble(german, ("cp1252", "cp850")), _garble(french, ("cp1252", "mac_roman")), _garble("Für", ("utf-8", "cp1252"))]))]
    got = {r.msg_id: r.body for r in restored_messages(spark.createDataFrame(rows, "msg_id long, subject string, body string")).collect()}
    assert got[1000] == f"{german} mit Grüße aus"
    assert got[1001] == "\n".join([german, french, german, french, "Für"])


def test_one_message_alone_is_judged_by_itself():
    """Whether a text is found depends on no other text: UTF-7, lost letters, controls, East Asian and Cyrillic garbles."""
    find = finder()
    for sound, pair in [("Änderung der Prüfung", ("utf-8", "cp1252")), ("Замечания к договору", ("koi8-r", "cp1251")), ("日本はとてもすきです", ("shift_jis", "cp1252")), ("Grüße aus München", ("mac_roman", "cp1252")), ("paid £2,746", ("cp1252", "cp1251"))]:
        assert not find.garbled(sound) and find.garbled(_garble(sound, pair)), sound
    assert find.garbled("AW: +AMQ-nderung") and find.restored("Situa+AOcA4w-o +IBM- fim") == "Situação – fim"
    assert find.garbled("RE: ????????? ? 9") and not find.garbled("What??? 1+2-3, A+BC-D") and not find.garbled("London–Paris, l’État, 5º, ½ m², Škoda, naïve, Peñón")
    assert find.restored(None) is None and not find.garbled("")


def test_share_of_texts_that_come_back_whole():
    found = whole = n = 0
    for sound, bad in cases():
        text = f"Plain.\n{bad}\nPlain."
        n, found, whole = n + 1, found + finder().garbled(text), whole + (finder().restored(text) == f"Plain.\n{sound}\nPlain.")
    assert found == n and whole >= 0.75 * n, (n, found, whole)


def test_pair_of_few_spans_is_tried_beside_many_others():
    stuck = " ".join(["a‰a中 a‡a中 a▀a中"] * 2)  # 39 pairs have spans here, and none can put them right
    for garbled, sound in [("die Gebьhr", "die Gebühr"), ("seńor Muńoz", "señor Muñoz"), ("die GebЭhr", "die Gebühr")]:
        assert finder().restored(f"{stuck}\n{garbled}") == f"{stuck}\n{sound}"
