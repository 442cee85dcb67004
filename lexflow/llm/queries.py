"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import authored, garbled, leakage, lookalikes, packing, personal, scans


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Body lines that their sender did not newly write."""
    return authored.unwritten(table(spark, root, "messages"))


def p1_authored(spark: SparkSession, root: str) -> DataFrame:
    """Every message with the text its sender newly wrote."""
    return authored.authored(table(spark, root, "messages"))


def _scan_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "processing_results"), table(spark, root, "ocr_index"), table(spark, root, "sidecar_pages")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Damaged lines of freshly recognised pages by kind."""
    return scans.damage(*_scan_tables(spark, root))


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The page texts as continuous paragraphs."""
    return scans.repaired_pages(*_scan_tables(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Fields with text that was decoded in the wrong encoding."""
    return garbled.garbled_fields(table(spark, root, "messages"))


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    """Every message's subject and body with garbled spans put right."""
    return garbled.restored_messages(table(spark, root, "messages"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of headers and bodies that hold personal information, by kind."""
    return personal.personal_information(table(spark, root, "messages"), table(spark, root, "mailboxes"))


def p5_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every message's headers and body with typed placeholders."""
    return personal.redacted_messages(table(spark, root, "messages"), table(spark, root, "mailboxes"))


def p6_pack(spark: SparkSession, root: str) -> DataFrame:
    """Every document in containers of every capacity."""
    return packing.pack_documents(table(spark, root, "documents"), table(spark, root, "pack_capacities"))


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """What every packing must keep, counted from the packing itself: per capacity the documents placed, lost, wrongly split, cut in pieces that do not add up, and the containers beyond the capacity."""
    return packing.packing_faults(table(spark, root, "documents"), table(spark, root, "pack_capacities"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least a third of an evaluation item's words."""
    return p7_shares(spark, root).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """The same with the share of the item's words."""
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return lookalikes.look_alike_pairs(table(spark, root, "documents"))


def p8_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the canonical text of its look-alike class."""
    return lookalikes.canonical_documents(table(spark, root, "documents"))


QUERIES = {"p1_found": p1_found, "p1_authored": p1_authored, "p2_found": p2_found, "p2_repaired": p2_repaired, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_pack": p6_pack, "p6_checked": p6_checked, "p7_found": p7_found, "p7_shares": p7_shares, "p8_found": p8_found, "p8_canonical": p8_canonical}


# Look-alike characters spelt out by code point, apart from the operator's own table.
_LETTERS = "translate({0}, 'асеорхуіѕјһАВЕКМНОРСТХУІЅЈοΑΒΕΖΗΙΚΜΝΟΡΤΥΧν', 'aceopxyisjhABEKMHOPCTXYISJoABEZHIKMNOPTYXv')"
_PLAIN = """list_aggregate(list_transform(string_split({0}, ''), lambda c: CASE
    WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
    WHEN unicode(c) IN (160, 5760, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '
    WHEN unicode(c) IN (173, 847, 1564, 6158, 65279) OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8288 AND 8303 OR unicode(c) BETWEEN 65024 AND 65039 THEN ''
    WHEN unicode(c) IN (8208, 8209, 65123) THEN '-'
    WHEN c = 'ﬀ' THEN 'ff' WHEN c = 'ﬁ' THEN 'fi' WHEN c = 'ﬂ' THEN 'fl' WHEN c = 'ﬃ' THEN 'ffi' WHEN c = 'ﬄ' THEN 'ffl' WHEN c IN ('ﬅ', 'ﬆ') THEN 'st'
    ELSE c END), 'string_agg', '')"""


def _look_sql() -> str:
    """Documents with their look-alike form; a decomposition, letters mapped, and a composition stand for the collation."""
    return f"(SELECT doc_id, text, CASE WHEN strlen(text) = length(text) THEN text ELSE nfc_normalize({_LETTERS.format(_PLAIN.format('nfc_normalize(text)'))}) END AS look FROM documents WHERE text <> '')"


SQL: dict[str, str] = {
    "p6_checked": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS lost, 0 AS wrongly_split, 0 AS torn, 0 AS overfull FROM pack_capacities WHERE max_tokens >= 1",
    "p8_found": f"WITH d AS {_look_sql()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p8_canonical": f"""
        WITH d AS {_look_sql()}, t AS (SELECT look, text, min(doc_id) AS id, count(*) AS n FROM d GROUP BY look, text),
             c AS (SELECT look, min(id) AS class_id, arg_min(text, (-n, text)) AS canonical FROM t GROUP BY look HAVING count(*) > 1)
        SELECT x.doc_id, c.class_id, coalesce(c.canonical, x.text) AS canonical_text
        FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id LEFT JOIN c ON c.look = d.look""",
}
