"""Personal information inside free text.

Regular expressions propose spans, also across wrapped and quoted lines. Each span has a
score: its form, plus the words before it that announce such a value or speak against it, plus
its check digits (Luhn, mod-97, national rules), which lower it where they fail. Spans above a
threshold are reported by line or replaced by typed placeholders. Person names come from a
lexicon that Spark gathers from all mail headers and mailboxes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_rows, cut_lineage
from .garbled import CYRILLIC, LATIN, MULTI, TWICE, _garble

FIELDS = ("sender", "to_addrs", "cc_addrs", "body")
THRESHOLD = 1.0
# What is added to the score of a form.
CONTEXT, AGAINST = 0.9, -0.6  # words before it that announce its kind, or another kind of number
VALID, INVALID = 0.5, -0.3  # national check digits
SURE_VALID, SURE_INVALID = 0.6, -0.6  # Luhn and mod-97
MOST_NAMES = 500_000  # lexicon rows that are broadcast; more are joined to the words of each message
LEAST_NAMED = 2  # times that a header names a person before the name counts everywhere
SALTS = 64

S = r"(?:[  ]|\n)"  # a space or a wrapped line
_EMAIL = re.compile(r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+")
_SPELT = re.compile(r"[\(\[{] ?(?:at|ät|arroba|собака) ?[\)\]}]", re.I)
_SPELT_EMAIL = re.compile(r"\b[\w.+-]{2,} ?[\(\[{] ?(?:at|ät|arroba|собака) ?[\)\]}] ?[\w-]+(?:(?:\.| ?[\(\[{] ?(?:dot|punkt|punto|точка) ?[\)\]}] ?)[\w-]+)+", re.I)

# Numbers issued to persons. Name, pattern, score of the form, words that announce it.
_IDS = [
    ("ssn", rf"(?<![\d-])\d{{3}}(?:-|{S}|-\n)\d{{2}}(?:-|{S}|-\n)\d{{4}}(?![\d-])", 0.6, r"SSN|social\s+security|security\s+number"),
    ("nino", rf"(?<![A-Z0-9])[A-Z]{{2}}{S}?\d{{2}}{S}?\d{{2}}{S}?\d{{2}}{S}?[A-D](?![A-Z0-9])", 1.0, r"NI\s+number|national\s+insurance|NINO"),
    ("licence", r"(?<![A-Z0-9])[A-Z]\d{3}-\d{4}-\d{4}(?![\d-])", 1.0, r"licen[cs]e"),
    ("dni", r"(?<![A-Z0-9])\d{8}-?[A-Z](?![A-Z0-9])", 0.6, r"DNI|NIF"),
    ("nie", r"(?<![A-Z0-9])[XYZ]-?\d{7}-?[A-Z](?![A-Z0-9])", 0.8, r"NIE"),
    ("cpf", r"(?<![\d.])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\d-])", 0.8, r"CPF"),
    ("rg", r"(?<![\d.])\d{2}\.\d{3}\.\d{3}-[\dXx](?![\d-])", 0.6, r"RG"),
    ("nir", rf"(?<!\d)\d{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{2}}(?!\d)|(?<!\d)[12]\d{{14}}(?!\d)", 0.7, r"NIR|sécurité\s+sociale"),
    ("snils", r"(?<![\d-])\d{3}-\d{3}-\d{3} \d{2}(?!\d)", 0.7, r"СНИЛС"),
    ("ru_passport", rf"(?<!\d)\d{{2}}{S}\d{{2}}{S}\d{{6}}(?!\d)", 0.5, r"паспорт"),
    ("inn", r"(?<![\d.,-])\d{12}(?![\d-])|(?<![\d.,-])\d{10}(?![\d-])", 0.45, r"ИНН"),
    ("tax_id", rf"(?<![\d-])\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}(?!\d)|(?<![\d.-])\d{{11}}(?![\d-])", 0.45, r"Steuer-?ID|Steueridentifikationsnummer|IdNr\.?|Sozialversicherungsnummer"),
    ("document", r"(?<![A-Z0-9-])(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{6,14}(?![A-Z0-9-])", 0.2, r"passport(?:\s+no\.?)?|Personalausweis|Reisepass|Ausweis|carte\s+d\S{1,4}identit\S{1,4}(?:\s+n\S{1,3})?|passeport(?:\s+n\S{1,3})?|pasaporte|passaporte|паспорт|CNI|identity\s+card"),
    ("iban", r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Z0-9])", 0.4, r"IBAN"),
    ("card", r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])", 0.4, r"card|Karte|carte|tarjeta|cartão|карт"),
]
_ID_PATTERNS = {name: re.compile(pattern) for name, pattern, _, _ in _IDS}
# Context words before a number, lower case, and the kinds of number they announce.
_CONTEXT_WORDS = {
    "ssn": "ssn", "security": "ssn", "security number": "ssn", "social": "ssn", "ni number": "nino", "national insurance": "nino", "nino": "nino", "licence": "licence", "license": "licence",
    "dni": "dni", "nif": "dni", "nie": "nie", "cpf": "cpf", "rg": "rg", "nir": "nir", "sociale": "nir", "снилс": "snils", "инн": "inn", "паспорт": "ru_passport document",
    "steuer-id": "tax_id", "steueridentifikationsnummer": "tax_id", "idnr": "tax_id", "sozialversicherungsnummer": "tax_id",
    "passport": "document", "passport no": "document", "passport number": "document", "ausweis": "document", "reisepass": "document", "identit": "document", "passeport": "document", "pasaporte": "document", "passaporte": "document", "identity card": "document", "cni": "document",
    "iban": "iban", "card": "card", "karte": "card", "carte": "card", "tarjeta": "card", "cartão": "card", "карт": "card",
}
_CONTEXT = re.compile("|".join(sorted(map(re.escape, _CONTEXT_WORDS), key=len, reverse=True)))
_START = re.compile(rf"(?<![^\W_])(?=[A-Z]{{1,2}}{S}?\d|[A-Z]?\d[\dA-Z. -])")
_ALONE = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, form, _ in _IDS if form + SURE_VALID >= THRESHOLD and name not in ("inn", "tax_id", "ru_passport")))
_FORM_SCORE = {name: form for name, _, form, _ in _IDS}
_OTHER_NUMBER = re.compile(r"(?:\bINV|invoice|factura|facture|fatura|Rechnung|file|docket|case|register|HRB|Aktenzeichen|Az\.|ref(?:erence)?\.?|order|account|Konto|дело|сч[её]т)[\s.:#/№n°ºo]*$", re.I)

_PHONE = re.compile(
    rf"(?<![\w.,+/-])(?:"
    rf"\+\d{{1,3}}(?:{S}|[.-])?(?:\(0?\d{{0,4}}\))?(?:(?:{S}|[.-])?\d){{6,12}}(?:{S}?(?:ext|Durchw|x)\.?{S}?\d{{1,5}})?"
    rf"|00\d{{2}}[ -](?:\(0\)[ -]?)?\d{{1,4}}[ -]\d{{4,10}}(?:-\d{{1,4}})?"
    rf"|\(\+?\d{{2,5}}\){S}?\d{{2,5}}(?:(?:{S}|[.-])?\d{{2,4}}){{1,4}}(?:{S}?ext\.?{S}?\d{{1,5}})?"
    rf"|(?:1[-. ])?\d{{3}}([-. ]|\n)\d{{3}}(?:\1|\n)\d{{4}}(?:{S}?ext\.?{S}?\d{{1,5}})?"
    rf"|0\d{{2,4}}/\d{{4,8}}(?:-\d{{1,4}})?"
    rf"|0[1-9](?:([ .]|\n)\d{{2}}(?=\2|\n|\D|$)){{4}}"
    rf"|0[1-9](?:(?:[ .]|\n)\d{{2}}){{4}}"
    rf"|020{S}\d{{4}}{S}\d{{4}}|0\d{{4}}{S}\d{{6}}|0\d{{3}}{S}\d{{3}}{S}\d{{4}}"
    rf"|8{S}\(?\d{{3}}\)?{S}\d{{3}}(?:{S}|-)\d{{2}}(?:{S}|-)\d{{2}}"
    rf"|[69]\d{{2}}-\d{{3}}-\d{{3}}|[69]\d{{2}}{S}\d{{3}}{S}\d{{3}}|[69]\d{{8}}"
    rf"|\d{{2}}{S}\d{{4}}[- ]\d{{4}}"
    rf")(?![\w/]|[-.,]\d)"
)
_PHONE_CONTEXT = re.compile(r"(?:Tel|Tél|T|M|Mob|Mobile|Direct|Phone|Fax|☎|call|on|or|at|al|au|unter|number is|к|для|para|ligue|Llame|appel\S*|Позвоните)[\s.:]*[^\n\d]{0,40}$|☎")
_MONEY = re.compile(r"(?:[£€$¤Ј]|CHF|EUR|USD|GBP|Euro|руб)\s?$|INV\s$|HRB\s$")

_TOWN = rf"[A-ZÀ-ÞА-ЯЁ][^\W\d_]+"
_END_EN = rf"(?:,?{S}{_TOWN})?(?:,?{S}[A-Z]{{2}}{S}\d{{5}}|{S}\d{{5}}|{S}[A-Z]{{1,2}}\d{{1,2}}{S}\d[A-Z]{{2}})?"
_WAY_EN = "Street|Lane|Road|Avenue|Drive|Court|Row|Hill|Quay|Crescent|Close|Terrace|Way|Place|Square|Gardens|Mews|Boulevard|Walk|Parade|Grove"
_DIGIT_LED = re.compile(
    rf"(?<![\w.,/-])(?:\d{{1,5}}[a-z]?{S}(?:[A-Z][\w’'-]+{S}){{1,3}}(?:{_WAY_EN})\b(?:,{S}(?:Suite|Flat|Unit|Floor){S}\d+)?(?:,{_END_EN})?"
    rf"|\d{{1,4}}(?:{S}(?:bis|ter|quater))?,?{S}(?:rue|avenue|quai|all\S{{1,4}}e|impasse|place|boulevard|chemin|cours|passage|square){S}[^,;:.!?]{{2,45}}?,{S}\d{{5}}{S}{_TOWN})"
)
_FLAT_BEFORE = re.compile(rf"\b(?:Flat|Unit|Apartment|Apt\.?){S}\d+[a-z]?,{S}$")
_KEYWORD_LED = re.compile(
    rf"\bP\.?{S}?O\.?{S}Box{S}\d+(?:,{_END_EN})?"
    rf"|\b(?:Postfach|Apartado(?:{S}de{S}[Cc]orreos)?|Caixa{S}Postal|BP|CP){S}\d[\d ]*(?:,?{S}(?:D-)?\d{{5}}(?:-\d{{3}})?{S}{_TOWN}|,?{S}{_TOWN}(?:,{S}\d{{5}}(?:-\d{{3}})?)?)?"
    rf"|\b(?:Rua|Travessa|Avenida|Alameda|Largo|Pra\S{{1,4}}a|Estrada|Av\.){S}[^,;:!?]{{2,45}}?,{S}\d{{1,5}}{S}\S{{1,6}}{S}{_TOWN}(?:,{S}\d{{5}}-\d{{3}})?"
)
_RUSSIAN = re.compile(rf"(?<!\w)(?:[а-яА-ЯёЁ]{{2,6}}\.|а/я){S}(?:[а-яА-ЯёЁ-]{{3,}}{S}?){{1,2}},{S}[а-яА-ЯёЁ]\.{S}\d+\w?(?:,{S}[а-яА-ЯёЁ]{{2,3}}\.{S}\d+)?|(?<!\w)а/я{S}\d+")
_POSTCODE_LED = re.compile(rf"(?<![\w.,/-])\d{{1,4}}{S}?[a-z]?(?:,{S}\d{{1,2}}\.\S{{1,4}}(?:{S}[A-Z])?)?,{S}(?:D-)?\d{{5}}(?!-?\d){S}{_TOWN}")
_GERMAN = re.compile(rf"(?:straße|strasse|stra\S{{1,4}}e|gasse|allee|weg|platz|str\.|ufer|damm){S}\d{{1,4}}(?:{S}?[a-z]\b)?(?:,{S}(?:D-)?\d{{5}}(?!-?\d){S}{_TOWN})?")
_WAY_BEFORE = re.compile(rf"(?:(?:\b(?:Paseo|Calle|Plaza|Avenida|Camino|Ronda)\b|\bAvda\.|\bC/)[^,;:!?]{{1,45}}|(?:\b(?:Am|An{S}der|Im|In{S}der|Zum|Zur|Auf{S}der|[A-ZÄÖÜ]\w*e){S})?[A-ZÄÖÜ]\S*{S}?)$")


def address_spans(text: str) -> list[tuple[int, int]]:
    """Street addresses and post boxes; the number leads the search, the street's name is looked for before it."""
    found = []
    for m in _DIGIT_LED.finditer(text):
        flat = _FLAT_BEFORE.search(text, max(0, m.start() - 16), m.start())
        found.append((flat.start() if flat else m.start(), m.end()))
    found += [m.span() for m in _KEYWORD_LED.finditer(text)]
    if _CYRILLIC.search(text):
        found += [m.span() for m in _RUSSIAN.finditer(text)]
    for pattern in (_POSTCODE_LED, _GERMAN):
        for m in pattern.finditer(text):
            before = _WAY_BEFORE.search(text, max(0, m.start() - 60), m.start())
            if before:
                found.append((before.start(), m.end()))
    out: list[tuple[int, int]] = []
    for begin, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or begin >= out[-1][1]:
            out.append((begin, end))
    return out


_CYRILLIC = re.compile("[Ѐ-ӿ]")
_PREFIX = re.compile(r"^(?:\s*(?:[^\W\d_]{1,3}>|[>|]))+ ?")
_ANY_DIGIT = re.compile(r"\d")
_SAINT = re.compile(r"(?<!\w)(?:Sao|San|Santa|Santo|Saint|Sainte|St\.?|Sankt|S[^\x00-\x7f]{1,8}o)[ \n-]$", re.I)
_AROUND = ".'’_-–—"
_TOKEN = re.compile(r"[^ \t\r\n\x0b\x0c,;:<>()\"\[\]{}*!?|/=“”„«»¡¿]+")
_GREETING = re.compile(r"^\s*(?:Hi|Hello|Hey|Dear|Good (?:morning|afternoon|evening|day))\b", re.I)
# Given names that are also everyday words or months.
AMBIGUOUS = frozenset("will grant mark june may april august art bill rose grace hope faith joy frank rich rob sue pat drew chase dean guy miles penny sterling victor max".split())
ROLES = frozenset("desk contracts docket team office support info intake reception accounts billing admin legal department service services hotline noreply mailer daemon group list clerk registry court filing".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def mod_97(iban: str) -> bool:
    text = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def checksum(kind: str, text: str) -> bool | None:
    """Whether a number's check digits hold; None where its kind has none."""
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        return luhn(digits)
    if kind == "iban":
        return mod_97(text)
    if kind in ("dni", "nie"):
        number = re.sub(r"[^0-9XYZ]", "", text[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2"))
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == text[-1]
    if kind == "nir":
        return 97 - int(digits[:13]) % 97 == int(digits[13:])
    weighed = lambda d, weights: sum(int(x) * w for x, w in zip(d, weights))
    if kind == "cpf":
        check = lambda d: weighed(d, range(len(d) + 1, 1, -1)) * 10 % 11 % 10
        return check(digits[:9]) == int(digits[9]) and check(digits[:10]) == int(digits[10])
    if kind == "snils":
        return weighed(digits[:9], range(9, 0, -1)) % 101 % 100 == int(digits[9:])
    if kind == "inn" and len(digits) == 10:
        return weighed(digits, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(digits[9])
    if kind == "inn":
        return weighed(digits, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(digits[10]) and weighed(digits, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(digits[11])
    if kind == "tax_id":
        product = 10
        for d in digits[:10]:
            product = ((int(d) + product) % 10 or 10) * 2 % 11
        return (11 - product) % 10 == int(digits[10])
    return None


def id_score(kind: str, text: str, announced: bool, against: bool) -> float:
    """Score of a number issued to a person: form, words before it, check digits."""
    score = _FORM_SCORE[kind] + CONTEXT * announced + AGAINST * against
    if kind == "ssn" and text.count("-") == 2:
        score += 0.5
    valid = checksum(kind, text)
    if valid is None:
        return score
    if kind in ("card", "iban"):
        return score + (SURE_VALID if valid else SURE_INVALID)
    return score + (VALID if valid else INVALID)


class Names:
    """Parts of person names, lower-case, also as wrong decoding shows them."""

    def __init__(self, given: set[str], family: set[str]):
        self.given = set(self._forms(given))
        self.parts = self.given | set(self._forms(family))
        self._seen: dict[str, list[tuple[int, int, str]]] = {}

    def __reduce__(self):
        return _names_from, (self.given, self.parts)

    def personal(self, text: str) -> list[tuple[int, int, str]]:
        """``spans_of`` by paragraph. Quoted history repeats its paragraphs, so a task remembers some of them."""
        out, at = [], 0
        for paragraph in text.split("\n\n"):
            found = self._seen.get(paragraph)
            if found is None:
                found = spans_of(paragraph, self)
                if len(self._seen) >= 100_000:
                    self._seen.clear()
                if len(paragraph) < 2_000:
                    self._seen[paragraph] = found
            out += [(b + at, e + at, k) for b, e, k in found] if at else found
            at += len(paragraph) + 2
        return out

    @staticmethod
    def _forms(names: set[str]) -> Iterator[str]:
        for w in names:
            yield w
            if not w.isascii():
                pairs = MULTI + [(a, b) for group in (LATIN, CYRILLIC) for a in group for b in group if a != b]
                for form in {w, w.title(), w.upper()}:
                    for pair in pairs:
                        g = _garble(form, pair)
                        if g:
                            yield g.lower()
                            for first, second in TWICE:
                                if pair == ("utf-8", first) and (twice := _garble(g, ("utf-8", second))):
                                    yield twice.lower()
                    yield re.sub(r"[^\x00-\x7f]", "�", form).lower()

    def known(self, token: str) -> bool:
        low = token.lower()
        return low in self.parts or ("-" in low and any(p in self.parts for p in low.split("-")))

    def _any(self, text: str) -> bool:
        """Whether a text has any known part at all; most paragraphs have none."""
        tokens = [t.strip(_AROUND) for t in _TOKEN.findall(text.lower())]
        if not self.parts.isdisjoint(tokens):
            return True
        return any(("-" in t and not self.parts.isdisjoint(t.split("-"))) or t[-2:] in ("’s", "'s") and t[:-2] in self.parts for t in tokens if not t.isalnum())

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places of names: known parts with a capital, or two lower-case parts beside each other."""
        found, at = [], 0
        last = None  # begin, end, capital, taken
        for line in text.split("\n"):
            if self._any(line):
                for m in _TOKEN.finditer(text, at, at + len(line)):
                    raw = m[0]
                    token = raw.strip(_AROUND)
                    if len(token) < 2:
                        continue
                    low = token.lower()
                    if low not in self.parts and not ("-" in low and self.known(token)) and not (low.endswith(("’s", "'s")) and low[:-2] in self.parts and (low := low[:-2])):
                        last = None if len(token) > 2 or token[-1:].islower() else last
                        continue
                    begin = m.start() + raw.index(token)
                    end = begin + len(token)
                    capital = not token[0].islower() or not token[0].isascii()
                    doubtful = low in AMBIGUOUS or not capital
                    beside = last is not None and not text[last[1] : begin].strip(" ,.\n") [1:] and begin - last[1] <= 5
                    if _SAINT.search(text, max(0, begin - 12), begin):  # a place
                        last = None
                        continue
                    if beside and (capital or not last[2]):
                        if not last[3]:
                            found.append(last[:2])
                        found.append((begin, end))
                        taken = True
                    elif doubtful and not self._alone(text, begin, end):
                        taken = False
                    elif not capital:
                        taken = False
                    else:
                        found.append((begin, end))
                        taken = True
                    last = (begin, end, capital, taken)
            elif line and not line.isspace():
                last = None
            at += len(line) + 1
        return found

    @staticmethod
    def _alone(text: str, begin: int, end: int) -> bool:
        """A doubtful word is a name in a greeting or as a line of its own."""
        a, b = text.rfind("\n", 0, begin) + 1, text.find("\n", end)
        line = text[a : b if b >= 0 else len(text)]
        if not text[begin].isupper():
            return False
        rest = line.strip(" ,.!-–—:")
        return rest == text[begin:end] or (bool(_GREETING.match(line)) and len(line) < 40)


def _names_from(given: set[str], parts: set[str]) -> Names:
    names = Names(set(), set())
    names.given, names.parts = given, parts
    return names


def _id_at(text: str, at: int, before: str) -> re.Match | None:
    """The number issued to a person that begins at ``at``, where its score reaches the threshold."""
    low = before.lower()
    for word in _CONTEXT.finditer(low):
        place = word.start()
        if len(low) - word.end() <= 9 and not (place and low[place - 1].isalpha() and word[0] in ("rg", "nie", "dni", "nir", "nif", "ssn", "cni")):
            for kind in _CONTEXT_WORDS[word[0]].split():
                if (m := _ID_PATTERNS[kind].match(text, at)) and id_score(kind, m[0], True, bool(_OTHER_NUMBER.search(before))) >= THRESHOLD:
                    return m
    m = _ALONE.match(text, at)
    return m if m and id_score(m.lastgroup, m[0], False, bool(_OTHER_NUMBER.search(before))) >= THRESHOLD else None


def spans_of(text: str, names: Names) -> list[tuple[int, int, str]]:
    """All personal spans of a text without quote prefixes: begin, end, kind. They do not overlap but for names."""
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(begin: int, end: int, kind: str) -> None:
        out.append((begin, end, kind))
        taken[begin:end] = b"\1" * (end - begin)

    if "@" in text:
        for m in _EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    if ("(" in text or "[" in text or "{" in text) and _SPELT.search(text):
        for m in _SPELT_EMAIL.finditer(text):
            if not any(taken[m.start() : m.end()]):
                take(m.start(), m.end(), "email")
    if _ANY_DIGIT.search(text):
        for begin, end in address_spans(text):
            if not any(taken[begin:end]):
                take(begin, end, "address")
        done = 0
        for start in _START.finditer(text):
            at = start.start()
            if at < done or taken[at]:
                continue
            before = text[max(0, at - 40) : at]
            found = _id_at(text, at, before)
            if found and not any(taken[at : found.end()]) and not _MONEY.search(before):
                take(at, found.end(), "id_number")
                done = found.end()
        at = 0
        while m := _PHONE.search(text, at):
            at = m.end()
            used = taken.find(1, m.start(), m.end())
            if used >= 0:  # it ran into another value, as on the next line of a signature
                at = max(m.start() + 1, used)
                m = _PHONE.match(text, m.start(), used) or _PHONE.match(text[: used].rstrip(), m.start())
                if not m:
                    continue
            before = text[max(0, m.start() - 60) : m.start()]
            if _MONEY.search(before):
                continue
            plain = re.match(r"[69]\d\d[ \n]\d|[69]\d{8}|\d{2}[ \n]\d{4}", m[0])
            digits = sum(c.isdigit() for c in m[0])
            if (not plain or _PHONE_CONTEXT.search(before)) and 7 <= digits <= 18:
                take(m.start(), m.end(), "phone")
    for begin, end in names.spans(text):
        if not any(taken[begin:end]):
            out.append((begin, end, "name"))
    return sorted(out)


def _flow(text: str) -> tuple[str, list[int], list[str]]:
    """A body without quote prefixes and carriage returns, the start of each of its lines, and the prefixes."""
    prefixes, lines, starts, at = [], [], [], 0
    for line in text.replace("\r\n", "\n").split("\n"):
        m = _PREFIX.match(line) if line[:6].find(">") >= 0 or line[:2].find("|") >= 0 else None
        prefix = m[0] if m else ""
        prefixes.append(prefix)
        rest = line[len(prefix) :]
        lines.append(rest)
        starts.append(at)
        at += len(rest) + 1
    return "\n".join(lines), starts, prefixes


def personal_lines(text: str | None, names: Names) -> set[tuple[int, str]]:
    """Line numbers and kinds of what a text holds; pieces of a wrapped value count on each of their lines."""
    if not text:
        return set()
    flow, starts, _ = _flow(text)
    found = set()
    for begin, end, kind in names.personal(flow):
        first, last = bisect_right(starts, begin), bisect_right(starts, end - 1)
        for n in range(first, last + 1):
            a = max(begin, starts[n - 1])
            b = min(end, starts[n] - 1 if n < len(starts) else end)
            if flow[a:b].strip():
                found.add((n, kind))
    return found


def redacted(text: str | None, names: Names) -> str | None:
    """``text`` with a typed placeholder for each span; quote prefixes and line ends stay."""
    if not text:
        return text
    flow, starts, prefixes = _flow(text)
    spans = names.personal(flow)
    if not spans:
        return text
    ends = "\r\n" if "\r\n" in text else "\n"
    out, at = [], 0
    for begin, end, kind in spans:
        if begin < at:
            continue
        if out and kind == "name" and out[-1] == "[NAME]" and not flow[at:begin].strip(" ,\n"):
            out.append("\n" * flow.count("\n", at, end))
        else:
            out += [flow[at:begin], f"[{kind.upper()}]", "\n" * flow.count("\n", begin, end)]
            out = [x for x in out if x]
        at = end
    out.append(flow[at:])
    lines = "".join(out).split("\n")
    return ends.join(p + x for p, x in zip(prefixes, lines, strict=True))


def header_names(value: str | None) -> list[tuple[str, bool]]:
    """Lower-case parts of the persons' names in an address list, and whether each is a given name."""
    if not value:
        return []
    out = []
    plain = re.sub(r"[\w.+'-]+@[\w.-]+", "\0", value)
    for m in re.finditer(r"\"([^\"<>,]+),\s*([^\"<>]+)\"|([^\",;<>()\0]+)", plain):
        words = (m[2].split() + m[1].split()) if m[1] else m[3].split()
        words = [w.strip(".'") for w in words if len(w.strip(".'")) > 1]
        if 2 <= len(words) <= 4 and not any(w.lower() in ROLES for w in words) and all(w[0].isalpha() and (w[0].isupper() or not w[0].isascii()) for w in words):
            out += [(p.lower(), k == 0) for k, w in enumerate(words) for p in (w, *(w.split("-") if "-" in w else ()))]
    return out


def lexicon(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``part``, ``given``: parts of the names in all headers and mailboxes, also as wrong decoding shows them.

    A part counts if headers name it ``LEAST_NAMED`` times or a mailbox has it. Spark folds
    the parts, and tasks spell out their forms.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for value, weight in zip(batch["v"], batch["weight"], strict=True):
                for found in header_names(value):
                    seen[found] += weight
            yield pd.DataFrame([(*found, n) for found, n in seen.items()], columns=["part", "given", "n"])

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(form, given) for part, given in zip(batch["part"], batch["given"], strict=True) for form in set(Names._forms({part}))]
            yield pd.DataFrame(rows, columns=["part", "given"])

    values = messages.select(F.explode(F.array("sender", "to_addrs", "cc_addrs")).alias("v"), F.lit(1).alias("weight")).unionByName(mailboxes.select(F.col("display_name").alias("v"), F.lit(LEAST_NAMED).alias("weight"))).where("v is not null")
    counted = values.mapInPandas(parts, "part string, given boolean, n bigint").groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("given"), F.col("n")).otherwise(0)).alias("given_n")).where(F.col("n") >= LEAST_NAMED)
    spelt = counted.select("part", (2 * F.col("given_n") >= F.col("n")).alias("given")).mapInPandas(forms, "part string, given boolean")
    return cut_lineage(spelt.groupBy("part").agg(F.bool_or("given").alias("given")))


def _named(own: DataFrame, names: DataFrame):
    """``own`` with the names to look for: a broadcast lexicon where its checked size allows, else a column of those names that each row's words have.

    Beyond the bound the words of every message are joined to the lexicon, salted, as some
    names stand in a third of all messages.
    """
    rows = bounded_rows(names, MOST_NAMES)
    if rows is not None:
        return own, own.sparkSession.sparkContext.broadcast(_names_from({r.part for r in rows if r.given}, {r.part for r in rows}))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                seen = {w for field in FIELDS if (text := getattr(row, field)) for line in (_flow(text)[0],) for m in _TOKEN.finditer(line) for w in _word_forms(m[0])}
                out += [(row.msg_id, row.key, w) for w in seen]
            yield pd.DataFrame(out, columns=["msg_id", "key", "part"])

    keyed = own.withColumn("key", F.xxhash64(*FIELDS))
    salt = F.pmod(F.xxhash64("msg_id"), F.lit(SALTS)).cast("int")
    spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = keyed.mapInPandas(words, "msg_id bigint, key bigint, part string").withColumn("salt", salt).join(spread, ["part", "salt"])
    per_row = known.groupBy("msg_id", "key").agg(F.collect_set(F.struct("part", "given")).alias("names"))
    return keyed.join(per_row, ["msg_id", "key"], "left").drop("key"), None


def _word_forms(raw: str) -> set[str]:
    """What ``Names.spans`` looks up for a token."""
    low = raw.strip(".'’_-–—").lower()
    return {low, *low.split("-"), low[:-2] if low.endswith(("’s", "'s")) else low} - {""}


def _lexicons(batch: pd.DataFrame, shared) -> list[Names]:
    if shared is not None:
        return [shared.value] * len(batch)
    own = [n if n is not None else () for n in batch["names"]]
    return [_names_from({x["part"] for x in n if x["given"]}, {x["part"] for x in n}) for n in own]


def personal_information(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``msg_id``, ``field``, ``line_no``, ``kind`` of each line with personal information; line 1 outside the body.

    Null and blank fields hold none. Copies of a message count once: they are searched where
    they lie, and only what was found is shuffled. A message without id has no rows.
    """
    own, shared = _named(messages.where("msg_id is not null").select("msg_id", *FIELDS), lexicon(messages, mailboxes))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, lexicons = [], _lexicons(batch, shared)
            for field in FIELDS:
                for msg, text, names in zip(batch["msg_id"], batch[field], lexicons, strict=True):
                    if text:
                        found = personal_lines(text, names)
                        rows += [(msg, field, n, k) for n, k in (found if field == "body" else {(1, k) for _, k in found})]
            yield pd.DataFrame(rows, columns=["msg_id", "field", "line_no", "kind"])

    return own.mapInPandas(search, "msg_id bigint, field string, line_no int, kind string").distinct()


def redacted_messages(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``msg_id`` and the four fields with typed placeholders, one row per message."""
    own, shared = _named(messages.where("msg_id is not null").select("msg_id", *FIELDS), lexicon(messages, mailboxes))

    def hide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lexicons = _lexicons(batch, shared)
            yield pd.DataFrame({"msg_id": batch["msg_id"]} | {f: [redacted(t, names) for t, names in zip(batch[f], lexicons, strict=True)] for f in FIELDS})

    hidden = own.mapInPandas(hide, "msg_id bigint, " + ", ".join(f"{f} string" for f in FIELDS))
    return hidden.groupBy("msg_id").agg(*(F.min(f).alias(f) for f in FIELDS))
