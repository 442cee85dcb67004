"""Garbled text from wrong character encoding.

Every pair of encodings that mail software confuses is applied beforehand to what sound text
consists of: to single characters for multi-byte pairs, to letters with the kinds of their
neighbours for single-byte pairs of Latin text, and to pairs of frequent letters for Cyrillic
and East Asian text. What comes out, and cannot stand in sound text by rule, goes into one
multi-pattern automaton. It depends on nothing but this file; each Python worker builds it
once. Texts are scanned once, and only matched spans are put right.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that text was in, and those it was read as.
MULTI = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp866"), ("utf-8", "koi8-r"), ("utf-8", "iso8859-15"), ("utf-8", "cp1250"), ("utf-8", "mac_cyrillic"), ("utf-8", "iso8859-5"), ("utf-8", "cp1253"), ("utf-8", "cp1254")]
TWICE = [("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp1251", "cp1251"), ("mac_roman", "mac_roman")]
LATIN = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866", "cp1253", "cp1254"]
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1252", "latin-1", "mac_roman"]
EAST_READERS = ["gbk", "shift_jis", "big5", "euc_kr"]  # what UTF-8 was read as
EAST = {"shift_jis": "のにをはがとでしたてるいすまなかられこりくもうきあっだんそ", "euc_jp": "のにをはがとでしたてるいすまなかられこりくもうきあっだんそ", "gbk": "的一是不了人我在有他这中大来上个国到说们为子和你地出道时年", "big5": "的一是不了人我在有他這中大來上個國到說們為子和你地出道時年", "euc_kr": "이다는을의가에를하고은지한로도사기서대자나시어라있리인수"}
# Frequent characters of sound mail, each list in falling order of use.
LOWER = "éüäáóãöçíèßàêñúâõôîûùœïëìòåæøýÿ"
UPPER = "ÉÜÄÖÁÓÇÀÍÂÚÃÊÔÈÕÑÎÛËÏÌÒÙÅÆØÝŒ"
TYPOGRAPHIC = "’“”–„€£§…«»°ºª—‘¿¡•·©®™²³½"
CYRILLIC_LOWER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
#: Characters that a multi-byte pair may have garbled.
SOUND = LOWER + UPPER + TYPOGRAPHIC + "☎⚠✓→№" + "".join(map(chr, range(0x410, 0x450))) + "ёЁ"
ANYWHERE = frozenset("’‘–—…·-´")  # marks that may stand between letters
TOGETHER = frozenset("çã çõ éé ïé üß äß öß ée èé ñó ñé ñí ñá ñú".split())  # accented letters that may follow each other
ALONE = frozenset("àáèéêòóôùúìíõивскоуабяжы")  # letters that are words
SIGNS = frozenset("–—•·№§→✓±×")  # signs that may stand alone before a number
LEAST_CYRILLIC, LEAST_WEAK = 3, 2  # spans without which a field is taken for sound

_SPACE_OR = {**{c: " " for c in (0x9, 0xA, 0xB, 0xC, 0xD, 0xA0, 0x1680, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))}}
#: Texts are scanned by kind of character: a for a small letter, A for a capital, 0 for a digit, a dot for marks; others stay.
_KINDS = {c: "a" for c in range(97, 123)} | {c: "A" for c in range(65, 91)} | {c: "0" for c in range(48, 58)} | {c: "." for c in range(33, 127) if not chr(c).isalnum()} | _SPACE_OR
_SHIFTED = re.compile(r"\+([A-Za-z0-9+/]{2,})-")  # how UTF-7 marks letters outside ASCII
_LOST = re.compile(r"(?<!\S)\?{4,}(?!\S)")  # a word none of whose letters the encoding had
_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = "".join(map(chr, range(0x80, 0xA0))) + "�"
_RANK = {c: k for order in (LOWER, UPPER, CYRILLIC_LOWER) for k, c in enumerate(order)} | {c: 3 + k for k, c in enumerate(TYPOGRAPHIC)}


def _decoded(raw: bytes, encoding: str) -> str:
    """What a lenient reader shows; bytes without a character stay as control characters."""
    return raw.decode(encoding, "strict") if encoding != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


def _garble(text: str, pair: tuple[str, str]) -> str | None:
    try:
        out = _decoded(text.encode(pair[0]), pair[1])
    except UnicodeError:
        return None
    return out if out != text else None


def _ungarble(text: str, pair: tuple[str, str]) -> str | None:
    try:
        raw = text.encode(pair[1]) if pair[1] != "cp1252" else b"".join(c.encode("cp1252") if not 0x80 <= ord(c) < 0xA0 else bytes([ord(c)]) for c in text)
        return raw.decode(pair[0])
    except UnicodeError:
        return None


def utf_7(text: str) -> Iterator[tuple[int, int, str]]:
    """Letters that UTF-7 wrote as base64, shown as it stands: begin, end, and the letters, where all of them belong to sound mail."""
    for m in _SHIFTED.finditer(text):
        try:
            stood = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode("utf-16-be")
        except (ValueError, UnicodeError):
            continue
        if stood and all(c in SOUND for c in stood):
            yield m.start(), m.end(), stood


def doubt(left: str, c: str, right: str) -> int:
    """How surely ``c`` cannot stand between these kinds of character in sound text: 2 surely, 1 perhaps, 0 it can."""
    letters = (left in "aA") + (right in "aA")
    if right == "0" and left in " ." and c.isalpha():  # where a sign of money stood
        return 2
    if c in ANYWHERE or c in LOWER:
        return 0
    if c in UPPER:
        return 2 if left == "a" else 0
    if c in TYPOGRAPHIC:
        return 2 if letters == 2 else 0
    if "Ѐ" <= c <= "ӿ":
        return 2 if letters else 0
    if not letters:
        return 0
    if "Ā" <= c <= "ɏ" or c in "ðþÐÞﬁﬂ":  # letters of further languages
        return 2 if c.isupper() and (left == "a" or left + right == "Aa") else 1
    if unicodedata.category(c)[0] in "LMSPN":
        return 2 if letters == 2 or unicodedata.category(c)[0] == "L" or c in "¸ˆ˜¨‰‡†‹›¦¬¤¯±÷" else 1
    return 0


def foreign(a: str, b: str) -> bool:
    """Whether two letters cannot follow each other in sound text."""
    if a.isspace() or b.isspace() or a in _CONTROL or b in _CONTROL:
        return False
    cyrillic = ["Ѐ" <= c <= "ӿ" for c in (a, b)]
    russian = [c.lower() in CYRILLIC_LOWER for c in (a, b)]
    if all(cyrillic):
        return not all(russian) or (a.islower() and b.isupper())
    if any(cyrillic) or not (a.isalpha() and b.isalpha()):
        return not all(c in SOUND for c in (a, b))
    return (a + b).lower() not in TOGETHER


@lru_cache(maxsize=1)
def patterns() -> dict[str, tuple[str, str, tuple[str, ...]]]:
    """Garbled sequence, by kind of its ASCII characters: M with what stood there, S (surely) or W (perhaps) or K (Cyrillic, East Asian) with the pairs, C for controls."""
    out: dict[str, tuple[str, str, tuple[str, ...]]] = {}
    kept = lambda g: not any(c.isspace() for c in g) or not any(c in SOUND for c in g)
    for c in SOUND:
        for pair in MULTI:
            g = _garble(c, pair)
            if g and len(g) >= 2 and kept(g) and not (g.isalpha() and g.isupper() and all(x in SOUND for x in g) and pair[1] != "cp1251"):
                out.setdefault(g.translate(_KINDS), ("M", c, (">".join(pair),)))
                for first, second in TWICE:
                    if first == pair[1] and (twice := _garble(g, ("utf-8", second))) and kept(twice):
                        out.setdefault(twice.translate(_KINDS), ("M", c, (f"{pair[0]}>{first}>utf-8>{second}",)))
    single: dict[str, list[str]] = {}

    def add(g: str, pair: tuple[str, str]) -> None:
        found = single.setdefault(g, [])
        if ">".join(pair) not in found:
            found.append(">".join(pair))

    alike = ({"cp1252", "latin-1"}, {"cp1252", "iso8859-15"}, {"latin-1", "iso8859-15"}, {"cp1252", "cp1254"}, {"latin-1", "cp1254"}, {"iso8859-15", "cp1254"})
    pairs = [p for p in product(LATIN, LATIN) if p[0] != p[1] and set(p) not in alike] + [("utf-8", reader) for reader in EAST_READERS]
    for c, pair in product(LOWER + UPPER + TYPOGRAPHIC, pairs):
        g = _garble(c, pair)
        if g and g in _CONTROL:
            add(g, pair)
        elif g and len(g) == 1 and ord(g) > 127 and not g.isspace():
            for left, right in product("aA .0", "aA .0"):
                if doubt(left, g, right) and not doubt(left, c, right):
                    add(left + g + right, pair)
    kinds = {g: "S" if doubt(*g) == 2 else "W" for g in single if len(g) == 3} | dict.fromkeys(_CONTROL, "C")
    for c, pair in product("–—§", pairs):  # signs that stand alone
        g = _garble(c, pair)
        if g and len(g) == 1 and ord(g) > 127 and g not in _CONTROL and not g.isspace():
            if c != "§" and g.isalpha() and g.lower() not in ALONE:
                add(f" {g} ", pair)
                kinds[f" {g} "] = "S"
            if c == "§" and g not in SIGNS:
                add(f" {g} 0", pair)
                kinds[f" {g} 0"] = "S"
    letters = CYRILLIC_LOWER[:26]
    texts = [a + b for a, b in [*product(letters, letters), *product(letters.upper(), letters), *product(letters.upper(), letters.upper())]]
    for text, pair in product(texts, product(CYRILLIC[:5], CYRILLIC)):
        g = _garble(text, pair)
        if g and len(g) == 2 and min(map(ord, g)) > 127 and foreign(*g):
            add(g, pair)
            if text[0].isupper() and text[1].islower() and g[0].islower() and g[1].isupper():  # small and capital letters swapped
                add(f" {g}", pair)
                kinds[f" {g}"] = "S"
    for source, often in EAST.items():
        for a, b in product(often, often):
            for reader in ("cp1252", "latin-1"):
                g = _garble(a + b, (source, reader))
                if g and not any(c.isspace() for c in g) and sum(ord(c) > 127 for c in g) >= 3:
                    add(g.translate(_KINDS), (source, reader))
    for g in _CONTROL:
        single.setdefault(g, [])
    for g, found in single.items():
        out.setdefault(g, (kinds.get(g, "K"), "", tuple(found)))
    return out


class Finder:
    """The automaton over all patterns."""

    def __init__(self):
        self.table = patterns()
        self.automaton = ahocorasick.Automaton()
        for g in self.table:
            self.automaton.add_word(g, g)
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
        """Non-overlapping matches, longest first at each place: begin, end (both one more than in the text), kind, what stood there, pairs."""
        best: dict[tuple[bool, int], tuple[int, str]] = {}
        for end, g in self.automaton.iter(f" {text.translate(_KINDS)} "):
            at = (self.table[g][0] != "M", end + 1 - len(g))
            if at not in best or len(g) > len(best[at][1]):
                best[at] = (end + 1, g)
        taken, out = bytearray(len(text) + 2), []
        for begin, end, stood in utf_7(text) if "+" in text else ():
            taken[begin + 1 : end + 1] = b"\1" * (end - begin)
            out.append((begin + 1, end + 1, "M", stood, ("utf-7",)))
        for single, begin in sorted(best):  # multi-byte pairs first: their sequences are proof by themselves
            end, g = best[single, begin]
            inner = range(begin, end) if self.table[g][0] in "MCK" else range(begin + 1, end - 1)  # a neighbour may serve two spans
            if not any(taken[k] for k in inner):
                for k in inner:
                    taken[k] = 1
                out.append((begin, end, *self.table[g]))
        return sorted(out)

    def garbled(self, text: str | None) -> bool:
        if not text:
            return False
        if "+" in text and any(utf_7(text)) or "????" in text and _LOST.search(text):
            return True
        if text.isascii():
            return False
        kinds = Counter(kind for _, _, kind, *_ in self.spans(self._near(text)))
        return kinds["M"] + kinds["C"] + kinds["S"] > 0 or kinds["K"] >= LEAST_CYRILLIC or kinds["W"] >= LEAST_WEAK

    @staticmethod
    def _near(text: str) -> str:
        """The characters outside ASCII with what stands around them; no pattern reaches farther."""
        pieces, begin, end = [], 0, 0
        for m in _RUN.finditer(text):
            if m.start() - 3 > end:
                pieces.append(text[begin:end])
                begin = max(0, m.start() - 3)
            end = m.end() + 3
        return "\n\n".join([*pieces, text[begin:end]])

    def restored(self, text: str | None) -> str | None:
        """``text`` with its garbled spans put right where a pair allows; null and sound text as it is."""
        if not self.garbled(text):
            return text
        seen = set()
        while text not in seen:
            seen.add(text)
            spans = self.spans(text)
            if any(kind == "M" for _, _, kind, *_ in spans):
                out, at = [], 0
                for begin, end, kind, stood, _ in spans:
                    if kind == "M":
                        out += [text[at : begin - 1], stood]
                        at = end - 1
                text = "".join([*out, text[at:]])
                continue
            single = [s for s in spans if s[4]]
            fixes = {self._single(text, pair, [s for s in single if pair in s[4]]) for pair in dict.fromkeys(pair for s in single for pair in s[4])}
            tries = [(self._left(fixed), fixed) for fixed in fixes if fixed != text]  # pairs that read alike are judged once
            if tries and min(tries)[0] < self._left(text):
                text = min(tries)[1]
        return text

    def _left(self, text: str) -> tuple[int, int]:
        """How many spans a text has, and how rare its letters are: the lower, the sounder."""
        return len(self.spans(text)), sum(_RANK.get(c, _RANK.get(c.lower(), 40)) for c in text if ord(c) > 127)

    def _single(self, text: str, pair: str, own: list[tuple]) -> str:
        """``text`` with the words that have a span of a single-byte pair read anew, and words of their lines that become sounder by it."""
        encodings = tuple(pair.split(">"))
        lines = {text.count("\n", 0, s[0]) for s in own}
        out, at = [], 0
        for m in re.finditer(r"[^ \t\r\n]+", text):
            if m[0].isascii():
                continue
            within = any(s[0] <= m.end() and s[1] - 1 > m.start() for s in own)
            if not within and text.count("\n", 0, m.start()) not in lines:
                continue
            better = _ungarble(m[0], encodings)
            if better is None or (not within and not (self._left(better) < self._left(m[0]) and not self.spans(better))):
                continue
            out += [text[at : m.start()], better]
            at = m.end()
        return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def finder() -> Finder:
    """One per Python worker, which serves many tasks."""
    return Finder()


def garbled_fields(messages: DataFrame, fields: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """``msg_id``, ``field``: each field with text that was decoded in the wrong encoding.

    Null, empty and pure ASCII fields are sound. Copies of a message count once; a message
    without id has no rows; extra columns are not read. Texts are scanned where they lie, only
    the names of found fields are shuffled. Whether a field is found depends on its own text
    alone.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["msg_id"].tolist()
            found = [(msg, field) for field in fields for msg, t in zip(ids, batch[field].tolist(), strict=True) if finder().garbled(t)]
            yield pd.DataFrame(found, columns=["msg_id", "field"])

    return messages.where("msg_id is not null").select("msg_id", *fields).mapInPandas(search, "msg_id bigint, field string").distinct()


def restored_messages(messages: DataFrame, fields: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """``msg_id`` and the fields with their original text as far as it can be recovered, one row per message."""

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"msg_id": batch["msg_id"]} | {f: [finder().restored(t) for t in batch[f].tolist()] for f in fields})

    kinds = ", ".join(f"{f} string" for f in fields)
    fixed = messages.where("msg_id is not null").select("msg_id", *fields).mapInPandas(restore, f"msg_id bigint, {kinds}")
    return fixed.groupBy("msg_id").agg(*(F.min(f).alias(f) for f in fields))
