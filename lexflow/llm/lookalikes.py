"""Visually identical text with different characters.

Character classes that a reader cannot tell apart are mapped to one member with JVM string
functions; the mapped values are grouped in SQL under accent-sensitive Unicode collation,
which also equates composed and combining accents; the most frequent original text of each
class becomes its canonical member and is joined back.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, is_small

# Letters of other scripts that look like the Latin letter below them.
CYRILLIC = "асеорхуіѕјԁһԛԝАВЕКМНОРСТХУІЅЈԌ"
CYRILLIC_AS = "aceopxyisjdhqwABEKMHOPCTXYISJG"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳν"
GREEK_AS = "oABEZHIKMNOPTYXjv"
# Joined letters and the letters they join.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǳ": "dz", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}
HYPHENS = "‐‑﹣－"  # hyphen, non-breaking hyphen, small and full-width hyphen; dashes differ visibly
# Format characters that show a sign (number and abbreviation signs of Arabic, Syriac and Kaithi)
SHOWN_FORMAT = (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
FEW = 500_000  # narrow rows (about 50 MB) up to which candidates are sent to the texts instead of the texts to them
SALTS = 16  # parts of a text's documents where pairs are joined by shuffle
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


@lru_cache
def character_table() -> tuple[dict[str, str], str]:
    """One-to-one mapping and the string of invisible characters, by rule over the character database."""
    letters = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True))
    mapped, invisible = dict(letters), list(INVISIBLE_EXTRA)
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co") or ch in mapped:
            continue
        if kind == "Cf" or "︀" <= ch <= "️":
            if not 0xE0000 <= code <= 0xE0FFF and code not in SHOWN_FORMAT:
                invisible.append(ch)
        elif kind == "Zs":
            mapped[ch] = " "
        elif ch in HYPHENS:
            mapped[ch] = "-"
        else:
            how = unicodedata.decomposition(ch).split(" ")
            if how[0] in ("<wide>", "<narrow>", "<font>", "<noBreak>") and len(how) == 2:
                plain = chr(int(how[1], 16))
                mapped[ch] = letters.get(plain, plain)
            elif how[0] and how[0][0] != "<" and (base := unicodedata.normalize("NFD", ch))[0] in letters:
                whole = unicodedata.normalize("NFC", letters[base[0]] + base[1:])
                if len(whole) == 1:
                    mapped[ch] = whole
    return mapped, "".join(invisible)


def _unjoined(text: Column) -> Column:
    joined = text
    for one, letters in JOINED.items():
        joined = F.replace(joined, F.lit(one), F.lit(letters))
    return F.when(text.rlike("[" + "".join(JOINED) + "]"), joined).otherwise(text)


def look_alike_mapped(text: Column) -> Column:
    """``text`` with each look-alike character replaced by its class's plain member.

    Widths, kinds of space and hyphen, joined letters, invisible characters and look-alike
    letters are mapped here; accents are left to the collation. Null stays null, and text
    without any such character comes back as it is without being rebuilt.
    """
    mapped, invisible = character_table()
    plain = F.translate(_unjoined(text), "".join(mapped) + invisible, "".join(mapped.values()))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


@lru_cache
def key_table() -> tuple[str, str]:
    """Characters and what a key keeps of them, by rule over the character database.

    Look-alikes count as their plain member. A letter with a canonical decomposition keeps
    its base (a Hangul syllable its first letter); marks, later Hangul letters, controls and
    format characters keep nothing. So the composed and the decomposed form of any text have
    the same key.
    """
    mapped, _ = character_table()
    source, target, gone = [], [], []
    for code in range(1, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co") or ch in "\t\n\v\f\r\x85":
            continue
        plain = mapped.get(ch, ch)
        base = unicodedata.normalize("NFD", plain)[0]
        base = mapped.get(base, base)
        kind = unicodedata.category(base)
        if kind[0] == "M" or kind in ("Cf", "Cc") or base in INVISIBLE_EXTRA or 0x1160 <= ord(base) <= 0x11FF or 0xD7B0 <= ord(base) <= 0xD7FB:
            gone.append(ch)
        elif base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source + gone), "".join(target)


def coarse_key(text: Column) -> Column:
    """64-bit key that is equal for any two texts whose mapped forms the collation can equate (it ignores all marks)."""
    plain = F.translate(_unjoined(text), *key_table())
    return F.xxhash64(F.when(text.rlike(r"[^\t\n\x0b\f\r -~]"), plain).otherwise(text))


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The classes of texts that look alike, and the texts of all documents.

    The first has one row per distinct text that looks like another: ``text_hash``,
    ``class_id``, ``canonical_id``. ``class_id`` and ``canonical_id`` are the smallest
    document id of the class and of its canonical text; the canonical text is the one most
    documents have, then the smallest in byte order. Texts that look like no other are
    absent; null and empty texts have no class. The second has ``id`` and ``text_hash`` of
    every document with text, written once for all joins on it.

    Exact copies are folded first, so a text that a third of all rows share is one row from
    there on. Whole texts are shuffled only for texts whose coarse key another text shares.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).where((F.col("t") != "") & F.col("id").isNotNull())
    signed = cut_lineage(own.select("id", F.unhex(F.md5("t")).alias("text_hash"), coarse_key(F.col("t")).alias("key")))
    distinct = signed.groupBy("text_hash", "key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    shared = distinct.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    candidates = broadcast_if_small(cut_lineage(distinct.join(shared, "key", "left_semi").select("text_hash", "id", "n")), FEW)
    texts = own.join(candidates, "id").where(F.unhex(F.md5("t")) == F.col("text_hash")).dropDuplicates(["text_hash"])
    members = texts.select("text_hash", "id", "n", "t", look_alike_mapped(F.col("t")).alias("mapped"))
    classes = members.sparkSession.sql(
        """
        WITH member AS (SELECT text_hash, id, n, t, mapped COLLATE UNICODE AS look FROM {members}),
             class AS (SELECT look, min(id) AS class_id, min_by(id, struct(-n, t)) AS canonical_id
                       FROM member GROUP BY look HAVING count(*) > 1)
        SELECT m.text_hash, c.class_id, c.canonical_id FROM member m JOIN class c ON m.look = c.look
        """,
        members=members,
    )
    return cut_lineage(classes), signed.select("id", "text_hash")


def canonical_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id``, its ``class_id`` and ``canonical_text``.

    A text that looks like another gets its class's canonical text; any other text is its own
    canonical text (and its class id is null), so two canonical texts are equal exactly where
    the originals look alike. Null and empty texts come back as they are; repeated rows stay
    repeated; other columns are not read.
    """
    classes = broadcast_if_small(text_classes(docs, doc_id, text)[0], FEW)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"), F.unhex(F.md5(text)).alias("text_hash"))
    alone = own.join(classes, "text_hash", "left_anti").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.col("t").alias("canonical_text"))
    members = own.join(classes, "text_hash")
    canon = members.where("doc_id = canonical_id").groupBy("class_id").agg(F.min("t").alias("canonical_text"))
    return alone.unionByName(members.select("doc_id", "class_id").join(canon, "class_id").select("doc_id", "class_id", "canonical_text"))


def look_alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id_a`` < ``doc_id_b`` for documents whose texts look the same but differ in characters.

    The pairs of a class are those between its distinct texts only; equal texts never pair.
    Distinct texts are paired first, then the documents of each text are joined to either
    side. Beyond a checked number of pairs these joins are salted by document, so a text that
    a third of all documents share is spread over many tasks.
    """
    classes, every = text_classes(docs, doc_id, text)
    ids = every.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    a, b = classes.select("class_id", F.col("text_hash").alias("hash_a")), classes.select("class_id", F.col("text_hash").alias("hash_b"))
    texts = a.join(b, "class_id").where("hash_a < hash_b").select("hash_a", "hash_b")
    if is_small(texts, FEW):
        first = ids.join(F.broadcast(texts), F.col("text_hash") == F.col("hash_a")).select(F.col("id").alias("id_a"), "hash_b")
        if is_small(first, FEW):
            both = ids.join(F.broadcast(first), F.col("text_hash") == F.col("hash_b")).select("id_a", F.col("id").alias("id_b"))
            return _smaller_first(both)
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = ids.withColumnRenamed("text_hash", "hash_a").join(texts.withColumn("salt", each), ["hash_a", "salt"]).select(F.col("id").alias("id_a"), "hash_b")
    both = ids.withColumnRenamed("text_hash", "hash_b").join(first.withColumn("salt", each), ["hash_b", "salt"]).select("id_a", F.col("id").alias("id_b"))
    return _smaller_first(both)


def _smaller_first(pairs: DataFrame) -> DataFrame:
    return pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()
