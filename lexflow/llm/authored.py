"""Quoted history, signatures and footers in mail bodies.

Multilingual line rules mark every line that its sender did not newly write: quote prefixes,
attribution lines (also wrapped ones), forwarded headers and what follows them, the signature
from its closing phrase, delimiter or name on, gateway notices, client footers and
disclaimers. Replies between quotations, the greeting and a postscript stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .garbled import CYRILLIC, LATIN, MULTI, TWICE, _garble

# What mail clients and people write, by kind and language.
FROM = "From|Von|De|От|Da|Van|Expéditeur|Remitente|Absender"
HEADERS = FROM + "|Sent|Date|Gesendet|Datum|Envoyé|Envoyée|Enviado|Enviada|Enviado el|Enviado em|Enviada em|Fecha|Data|Отправлено|Дата|To|An|À|A|Para|Кому|Cc|Bcc|Copie|Kopie|Copia|Cópia|Копия|Subject|Betreff|Objet|Asunto|Assunto|Тема|Reply-To"
WROTE = r"wrote|writes|said|schrieb|schreibt|a écrit|écrivait|escribió|escreveu|пишет|писал|писала|написал|написала"
DAYS = r"On|At|Am|Le|El|Em|Il|\d{1,2}[./ ]"
SEPARATOR = r"Original Message|Forwarded message|Forwarded by|Reply message|Ursprüngliche Nachricht|Originalnachricht|Weitergeleitete Nachricht|Message d'origine|Message d’origine|Message original|Message transféré|Mensaje original|Mensaje reenviado|Mensagem original|Mensagem encaminhada|Исходное сообщение|Пересылаемое сообщение|Пересланное сообщение"
BEGIN = r"Begin forwarded message|Anfang der weitergeleiteten (?:Nachricht|E-Mail)|Début du message (?:réexpédié|transféré)|Inicio del mensaje reenviado|Início da mensagem encaminhada|Начало переадресованного сообщения"
CLOSINGS = (
    "Regards|Kind regards|Best regards|Warm regards|Kindest regards|With kind regards|Best|All the best|Best wishes|With best wishes|Thanks|Many thanks|Thank you|Thanks and regards|Thanks in advance|Cheers|Sincerely|Yours sincerely|Sincerely yours|Yours faithfully|Yours truly|Yours|Respectfully|Cordially|"
    "Mit freundlichen Grüßen|Mit freundlichem Gruß|Mit freundlichen Gruessen|Freundliche Grüße|Viele Grüße|Beste Grüße|Liebe Grüße|Herzliche Grüße|Schöne Grüße|Grüße|Gruß|Mit besten Grüßen|MfG|VG|LG|Hochachtungsvoll|"
    "Cordialement|Bien cordialement|Très cordialement|Bien à vous|Bien à toi|Sincères salutations|Salutations distinguées|Meilleures salutations|Cdlt|Salutations|Respectueusement|Amicalement|"
    "Saludos|Saludos cordiales|Un saludo|Un cordial saludo|Cordialmente|Atentamente|Muy atentamente|Un abrazo|Gracias|Muchas gracias|Reciba un cordial saludo|"
    "Atenciosamente|Cumprimentos|Com os melhores cumprimentos|Melhores cumprimentos|Um abraço|Abraços|Abraço|Obrigado|Obrigada|Att|Grato|Grata|"
    "С уважением|С наилучшими пожеланиями|Всего доброго|Всего хорошего|С благодарностью|Спасибо|Искренне Ваш|Искренне ваш|До свидания"
)
FOOTERS = (
    r"Sent from (?:my|Mail|Outlook|Yahoo)|Sent via|Get (?:the mail app|Outlook)|Envoyé (?:depuis|de) m|Enviado (?:desde|do) m|Von mein\w+ .{1,30}gesendet|Gesendet von mein|Отправлено с |Diese Nachricht wurde von mein|Téléchargez |Descarga(?:r)? |Obter o |Скачать |"
    r"This (?:e-?mail|message|communication)\b.{0,40}(?:confidential|intended|attachments)|CONFIDENTIAL(?:ITY)?(?: NOTICE)?: the contents|CONFIDENTIALITY NOTICE|NOTICE: unless|DISCLAIMER|[^.]{3,60} is registered in |Registered (?:office|in )|The (?:views|information|contents) (?:expressed|contained)|Please (?:think|consider)|Think before (?:you )?print|If you (?:have )?received this|"
    r"Diese (?:Nachricht|E-?Mail|Mail)\b.{0,30}(?:vertraulich|enthält)|Bitte (?:denken|prüfen) Sie .{0,30}(?:Umwelt|druck)|Denken Sie an die Umwelt|Der Inhalt dieser|Sitz der Gesellschaft|"
    r"Ce (?:message|courriel)\b.{0,30}confidentiel|Pensez à l['’]environnement|Este (?:mensaje|correo)\b.{0,30}confidencial|Antes de imprimir|Siège social|Domicilio social|Sede social|Юридический адрес|Piense en el medio|Esta mensagem\b.{0,30}confidencial|Pense (?:no|antes)|Настоящее сообщение|Это сообщение|Данное сообщение|Подумайте об окружающей|Берегите"
)
NOTICES = r"\[(?:EXTERNAL|EXTERN|EXTERNE|EXTERNO|ВНЕШН|CAUTION|WARNING)|⚠|CAUTION:|WARNING:|ACHTUNG:|ATTENTION ?:|ATENCIÓN:|ATENÇÃO:|ВНИМАНИЕ:|\*\*\* ?(?:Extern|External|Externe|Externo|Внешн)|EXTERNAL (?:EMAIL|SENDER)|This (?:sender|message|email) (?:is new|came|originated|was sent) |Externe E-?Mail"


def _also_garbled(alternatives: str) -> str:
    """The words of an alternation and what wrong decoding makes of them, so that rules hold for garbled mails too."""
    words = alternatives.split("|")
    out = {re.escape(w): None for w in words}
    for w in words:
        if not w.isascii():
            some = [_garble(w, p) for p in MULTI] + [_garble(w, (a, b)) for group in (LATIN, CYRILLIC) for a in group for b in group if a != b]
            some += [_garble(g, ("utf-8", second)) for (_, first), g in zip(MULTI, some, strict=False) if g for x, second in TWICE if x == first]
            out |= {re.escape(g): None for g in [*some, re.sub(r"[^\x00-\x7f]", "\ufffd", w)] if g and len(g) > 1}
    return "|".join(sorted(out, key=len, reverse=True))


_QUOTED = re.compile(r"\s*(?:[^\W\d_]{1,3}>|>|\|(?!.*[^\s|>].*\|\s*$))")
_HEADER = re.compile(rf"\s*\**(?:{_also_garbled(HEADERS)}) ?:\**(?:\s|$)", re.I)
_FROM = re.compile(rf"\s*\**(?:{_also_garbled(FROM)}) ?:\**\s")
_SEPARATORS = _also_garbled(SEPARATOR)
_SEPARATOR = re.compile(rf"\s*(?:[-_=]{{2,}} ?(?:{_SEPARATORS}) ?[-_=]{{2,}}|(?:{BEGIN}) ?:)\s*$", re.I)
_RULE = re.compile(r"\s*_{8,}\s*$")
_WROTE_END = re.compile(rf"(?:\b(?:{WROTE})\b[^:]{{0,80}}|\d{{1,2}}:\d{{2}}(?: ?[APap]\.?[Mm]\.?)?) ?:\s*$")
_WROTE = re.compile(rf"\b(?:{WROTE})\b")
_WHEN = re.compile(r"\d{4}|\d{1,2}:\d{2}|<[^<>\s]+@[^<>\s]+>")
_WHO = re.compile(rf"\s*[A-ZÀ-ÞА-ЯЁ][\w’'-]+(?: [A-ZÀ-ÞА-ЯЁ][\w’'.-]*){{0,3}}(?: <[^<>]+>)? (?:{WROTE}) ?:\s*$")
_STARTS = re.compile(rf"\s*(?:{DAYS}|[A-ZÀ-ÞА-ЯЁ\"'])")
_CLOSINGS = {re.sub(r"\\(.)", r"\1", c).casefold() for c in _also_garbled(CLOSINGS).split("|")}
_CLOSING_NAME = re.compile(rf"\s*(?:{CLOSINGS}),? [A-ZÀ-ÞА-ЯЁ][\w’'-]+(?: [A-ZÀ-ÞА-ЯЁ][\w’'-]+)?\s*$")
_DELIMITER = re.compile(r"\s*(?:--|—|–|__+|==+|~~+|\* \* \*|-{2,}|\*\*\*)\s*$")
_STARS = re.compile(r"\s*[*=#_-]{12,}\s*$")
_FOOTER = re.compile(rf"\s*(?:<i>)?\s*(?:{FOOTERS})")
_NOTICE = re.compile(rf"\s*(?:{NOTICES})")
_POSTSCRIPT = re.compile(r"\s*(?:P\. ?S\.|PS|P\. ?P\. ?S\.|PPS|P\. ?D\.|PD|П\. ?С\.|З\. ?Ы\.|NB|N\. ?B\.)[ :.–-]")
_NAME = re.compile(r"\s*[A-ZÀ-ÞА-ЯЁ][\w’'-]+(?: [A-ZÀ-ÞА-ЯЁ]\.)?(?: [A-ZÀ-ÞА-ЯЁ][\w’'-]+){0,2}\s*$")
_CARD = re.compile(r"@|☎|^\s*(?:T|E|M|F|Tel|Mail|Mobile|Direct|Phone|Tél|Fax|Mob)\b ?[.:]|\+?\d[\d ().-]{6,}| \| |\b(?:Partner|Associate|Paralegal|Counsel|Secretary|Head of|Director|Manager|Assistant|Officer)\b")
_CONTACT = re.compile(r"\s*(?:(?:T|E|M|F|Tel|Mail|E-Mail|Email|Mobile|Direct|Phone|Tél|Fax|Mob)\b ?[.:]|☎|(?:Tel\.|Direct|Mobile:?|Fax|Phone) ?[+(\d]|(?:Partner|Associate|Paralegal|Of Counsel|General Counsel|Company Secretary|Head of \w+|Director|Managing Director|Manager|Attorney|Solicitor)(?: \||,) [A-ZÀ-ÞА-ЯЁ])")
_LETTERS = re.compile(r"[^\W\d_]+")


def _names(sender: str | None) -> set[str]:
    """Lower-case parts of the sender's name, from the display name and the address."""
    if not sender:
        return set()
    shown = re.sub(r"<[^>]*>|\S+@\S+", " ", sender)
    parts = _LETTERS.findall(shown) or [p for a in re.findall(r"([\w.+-]+)@", sender) for p in _LETTERS.findall(a.replace("_", " "))]
    return {p.lower() for p in parts if len(p) > 1}


def _is_closing(line: str) -> bool:
    return len(line) < 60 and (line.strip().rstrip(" ,.!;–-").casefold() in _CLOSINGS or _CLOSING_NAME.match(line) is not None)


def _is_name(line: str, names: set[str]) -> bool:
    words = [w.lower() for w in _LETTERS.findall(line) if len(w) > 1]
    return bool(words) and len(line) < 60 and all(w in names for w in words) and not line.rstrip().endswith((",", ":", "!", " -"))


def unwritten_lines(body: str | None, sender: str | None = None) -> list[int]:
    """Numbers, from 1, of the lines that the sender of the mail did not newly write; blank lines are left out."""
    if not body or not body.strip():
        return []
    lines = body.replace("\r\n", "\n").split("\n")
    n = len(lines)
    filled = [bool(x.strip()) for x in lines]
    old = [f and _QUOTED.match(x) is not None for x, f in zip(lines, filled, strict=True)]
    quoted = old[:]

    def next_filled(i: int) -> int:
        while i < n and not filled[i]:
            i += 1
        return i

    # forwarded headers, separators and attribution lines outside of prefixed quotations
    i = 0
    end = n  # of what can be new
    while i < n:
        line = lines[i]
        if not filled[i] or quoted[i]:
            i += 1
            continue
        j = i  # behind the introduction that begins at i
        if (line.lstrip()[:2] in ("--", "==", "__") or line.rstrip()[-1] == ":") and _SEPARATOR.match(line) or (_RULE.match(line) and (k := next_filled(i + 1)) < n and _FROM.match(lines[k])):
            j = i + 1
            k = next_filled(j)
            while k < n and not quoted[k] and _HEADER.match(lines[k]):
                j = k + 1
                k = next_filled(j) if next_filled(j) - j <= 1 else n
        elif ":" in line[:24] and _FROM.match(line) and not line.rstrip().endswith(".") and any(i + d < n and _HEADER.match(lines[i + d]) and not _FROM.match(lines[i + d]) and not lines[i + d].rstrip().endswith(".") for d in (1, 2)):
            j = i + 1
            while j < n and filled[j] and not quoted[j] and (_HEADER.match(lines[j]) or (j + 1 < n and _HEADER.match(lines[j + 1]))):
                j += 1
        elif _STARTS.match(line):
            for d in range(4):
                if i + d >= n or not filled[i + d] or quoted[i + d]:
                    break
                tail = lines[i + d].rstrip()
                text = " ".join(x.strip() for x in lines[i : i + d + 1])
                if tail.endswith(":") and _WROTE_END.search(text):
                    after = next_filled(i + d + 1)
                    if _WROTE.search(text) and len(text) < 260 and (_WHEN.search(text) or (_WHO.match(text) and after < n and quoted[after])):
                        j = i + d + 1
                    break
                if d == 0 and not (_WROTE.search(line) or _WHEN.search(line) or line.lstrip().startswith(("On ", "At ", "Am ", "Le ", "El ", "Em "))):
                    break
        if j > i:
            for k in range(i, j):
                old[k] = filled[k]
            after = next_filled(j)
            if after < n and not quoted[after]:
                end = i
                break
            i = j
        else:
            i += 1
    for k in range(end, n):
        old[k] = filled[k]

    # notices of a gateway on top
    k = next_filled(0)
    while k < end and not quoted[k] and _NOTICE.match(lines[k]):
        while k < end and filled[k] and not quoted[k]:
            old[k] = True
            k += 1
        k = next_filled(k)

    # in each stretch without quotations: footers, then the signature
    names = _names(sender)
    i = 0
    while i < end:
        if old[i] or not filled[i]:
            i += 1
            continue
        stop = i
        while stop < end and not quoted[stop] and not (old[stop] and filled[stop]):
            stop += 1
        _mark_signature(lines, filled, old, i, stop, names)
        i = stop
    return [k + 1 for k in range(n) if old[k]]


def _mark_signature(lines: list[str], filled: list[bool], old: list[bool], begin: int, stop: int, names: set[str]) -> None:
    """Marks signature and footers of ``lines[begin:stop]``; a postscript within is left as it is."""
    start = stop
    for k in range(begin, stop):
        line = lines[k]
        if not filled[k]:
            continue
        alone = k == begin or not filled[k - 1]
        if _is_closing(line) or _FOOTER.match(line):
            start = k
        elif k > begin and _is_name(line, names) and (alone or _rest_is_card(lines, filled, k, stop)):
            start = k
        elif _DELIMITER.match(line) and k + 1 < stop and filled[k + 1] and (_is_name(lines[k + 1], names) or _NAME.match(lines[k + 1])):
            start = k
        elif _STARS.match(line) and (_STARS.match("".join(lines[k + 1 : k + 2])) is None) and any(_STARS.match(x) for x in lines[k + 2 : min(stop, k + 8)]):
            start = k
        elif k > begin and alone and _NAME.match(line) and _rest_is_card(lines, filled, k, stop):
            start = k
        elif _CONTACT.match(line):  # contact data whose name line was not recognised
            before = k - 1 if not alone and len(lines[k - 1]) < 60 and not lines[k - 1].rstrip().endswith((".", "?", ",")) else k
            start = before - 1 if before > begin and filled[before - 1] and _DELIMITER.match(lines[before - 1]) else before
        if start < stop:
            break
    k = start
    while k < stop:
        if filled[k] and _POSTSCRIPT.match(lines[k]):
            while k < stop and filled[k]:
                k += 1
            continue
        old[k] = filled[k]
        k += 1


def _rest_is_card(lines: list[str], filled: list[bool], k: int, stop: int) -> bool:
    """Whether what follows a name at once is its contact data, or nothing but the end of the stretch."""
    block = []
    while k + 1 < stop and filled[k + 1]:
        k += 1
        block.append(lines[k])
    if block:
        return any(_CARD.search(x) for x in block[:2]) or bool(_DELIMITER.match(block[0]))
    rest = [lines[j] for j in range(k + 1, stop) if filled[j]]
    return not rest or bool(_FOOTER.match(rest[0]) or _STARS.match(rest[0]) or _POSTSCRIPT.match(rest[0]) or _DELIMITER.match(rest[0]))


def _once(messages: DataFrame, function, kind: str) -> DataFrame:
    """One result per message: copies are worked on where they lie, only results are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"msg_id": batch["msg_id"], "r": [function(b, s) for b, s in zip(batch["body"], batch["sender"], strict=True)]})

    own = messages.where("msg_id is not null").select("msg_id", "body", "sender")
    return own.mapInPandas(run, f"msg_id bigint, r {kind}").groupBy("msg_id").agg(F.min("r").alias("r"))


def unwritten(messages: DataFrame) -> DataFrame:
    """``msg_id``, ``line_no`` of each line that the sender did not newly write.

    Null and blank bodies have no such line. Copies of a message count once (were they to
    differ, the smaller result would stand); a message without id has no rows; a missing
    sender only weakens the recognition of names. Extra columns are not read.
    """
    return _once(messages.where("body is not null"), unwritten_lines, "array<int>").select("msg_id", F.explode("r").alias("line_no"))


def newly_written(body: str | None, sender: str | None = None) -> str | None:
    """The text that the sender newly wrote, without outer blank lines and with single ones inside; null stays null."""
    if body is None:
        return None
    gone = set(unwritten_lines(body, sender))
    kept = [x for k, x in enumerate(body.replace("\r\n", "\n").split("\n"), 1) if k not in gone]
    return re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(kept)).strip()


def authored(messages: DataFrame) -> DataFrame:
    """``msg_id``, ``text``: one row per message with its newly written text."""
    return _once(messages, newly_written, "string").select("msg_id", F.col("r").alias("text"))
