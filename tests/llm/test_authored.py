import pytest
from pyspark.sql import functions as F

from lexflow.llm.authored import authored, newly_written, unwritten, unwritten_lines
from lexflow.runtime import table

# Each line starts with "-" if it is not newly written, "+" if it is, or is blank.
MAILS = {
    "top": """+Hi Clement,
+The schedule stands.

-Best regards,
-Tobias Buxthorne
-Associate | Kraegast Optics AG
-Tel. +44 20 7946 0912

-On Sunday, March 10, 2024 1:07 AM Kendra
-Lemley wrote:
-> Hi Tobias,
-> please confirm.""",
    "interleaved": """-Am 9. Juni 2021 09:15 schrieb Ute Hiasthorst
-<ute@huprilk.example>:
->> Erste Frage?
+Ja, gerne.
->> Zweite Frage?
->> | tiefer zitiert
+Nein.
+Von: Montag bis Freitag ist das Archiv geöffnet.

-MfG
-=====
-Tobias""",
    "header": """-[EXTERNAL SENDER] Check the address before replying.

+Hola, Tomás:
+Está bien.

-Un saludo,
-Tobias

+P.S. Falta el anexo,
+también el índice.

-Este mensaje es confidencial y se dirige solo a su destinatario.
-Bórrelo.

-________________________________
-De: Inés Pinando <ines@sakrux.test>
-Enviado: 3 de abril de 2024, 11:48
-Para: Tomás

-Hola: texto anterior.""",
    "decoys": """+From: the handover date to the end of June the site stays closed.
+As counsel wrote: the deed stands.
+To: confirm, the second tranche is still open.
+--- draft wording follows ---
+-> please see tab 3 of the bundle
+Confidentiality: the notice period in the new draft is 30 days.
+Sent from the registry today: two sealed copies.
+| a | b |""",
    "russian": """+Здравствуйте, Пелагея!
+Согласовано.

-Отправлено с телефона

------Исходное сообщение-----
-От: Родион Моранцев <r@s.example>
-Отправлено: 25 января 2020 02:29

-Итого.""",
}


@pytest.mark.parametrize("name", MAILS)
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_rules(name, ends):
    lines = MAILS[name].split("\n")
    body = ends.join(x[1:] for x in lines)
    want = [k for k, x in enumerate(lines, 1) if x.startswith("-")]
    assert unwritten_lines(body, '"Buxthorne, Tobias" <tobias_buxthorne@kraegast.test>') == want
    kept = newly_written(body, "Tobias Buxthorne")
    assert all((x[1:] in kept.split("\n")) for x in lines if x.startswith("+"))


def test_odd_bodies():
    assert unwritten_lines(None) == unwritten_lines("") == unwritten_lines(" \n\t\r\n") == []
    assert newly_written(None) is None and newly_written(" \n ") == ""
    assert unwritten_lines("word " * 50_000) == []
    assert unwritten_lines("> a\n" * 2000)[-1] == 2000
    assert unwritten_lines("Mit freundlichen GrÃ¼ÃŸen\nx") == [1, 2]


def test_operator(spark):
    rows = [(1, MAILS["top"].replace("\n-", "\n").replace("\n+", "\n")[1:], "Tobias"), (2, None, None), (3, "", "x"), (None, "> a", "x"), (4, "> a\nb", None), (4, "> a\nb", None)]
    df = spark.createDataFrame(rows, "msg_id long, body string, sender string").withColumn("line_no", F.lit("clash")).withColumn("r", F.lit(1))
    got = {tuple(r) for r in unwritten(df).collect()}
    assert {x for x in got if x[0] == 4} == {(4, 1)} and {m for m, _ in got} == {1, 4}
    assert {r.msg_id: r.text for r in authored(df).collect()}[4] == "b" and authored(df).count() == 4
    assert unwritten(df.limit(0)).count() == authored(df.limit(0)).count() == 0


def test_tables(spark):
    m = table(spark, "/root/testdata/sf0.01", "messages")
    texts = [r.text for r in authored(m).collect() if r.text]
    assert len(texts) > 1000 and not any(line.startswith(">") for t in texts for line in t.split("\n"))
    assert unwritten(m).count() == unwritten(m.union(m)).count()
