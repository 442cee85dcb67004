"""Noise in text from scanned pages.

Running headers and page numbers are found relationally: lines at page edges get a fuzzy key
that ignores recognition errors, and keys that repeat over pages are headers, numbers that
advance with the pages are page numbers. A vocabulary counted over all page texts decides
which line-end marks are foreign to their word and which rare words are misread forms of
frequent ones. Python only splits one page at a time; counting, matching and joining are
Spark's, so a sidecar with a third of all pages is never gathered in one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import broadcast_if_small, cut_lineage

EDGE = 2  # non-blank lines at either edge of a page that are looked at first; further ones wherever all of these are furniture
DEEPER = 3  # lines that are looked at together then
VERDICTS = ("scanned-image-only", "scan+ocr", "mixed/other")
MARKS = "-¬­‐‑"
# What a recogniser reads, and what stood there.
CONFUSIONS = [("ii", "u"), ("ii", "ü"), ("m", "rn"), ("d", "cl"), ("6", "é"), ("6", "ö"), ("6", "ó"), ("6", "e"), ("6", "o"), ("c", "e"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("y", "v"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "i"), ("|", "l"), ("†", "t"), ("$", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("l", "i"), ("i", "l"), ("o", "0"), ("a", "ä"), ("a", "á"), ("a", "à"), ("e", "é"), ("e", "è"), ("o", "ö"), ("o", "ó"), ("u", "ü"), ("u", "ú"), ("i", "í"), ("n", "ñ"), ("c", "ç"), ("ß", "b"), ("b", "ß")]
SPECKS = "~_'°·•*^`¨´¦|\\"
# Words that number the parts of a text.
HEADINGS = "article section clause part chapter annex appendix schedule artikel abschnitt kapitel teil anhang chapitre partie artículo capítulo anexo sección artigo seção статья раздел глава".split()
FREQUENT, TIMES = 6, 8  # a misread word's original has this many occurrences, and so many times its own

SHORTEST = 6  # characters of a header's key that may have near forms
ERRORS_PER, MOST_ERRORS = 8, 3  # characters of a key for each error that near forms may have, and the most errors
MANY = 200  # keys at one edge of a sidecar from which they are compared by their pieces
NO_SHIFT = -(1 << 62)  # of a line without a number or a page without one
MOSTLY = 0.75  # share of a form's page numbers that advance with the pages, from which the others count too
FEW, FEW_PAGES = 500_000, 200_000  # narrow rows that are broadcast, and rows with a page's furniture

_PAIRS = [(a, b) for a, b in CONFUSIONS if len(a) == 2]
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "†": "t", "$": "s", "c": "e", "y": "v", "j": "l"})
LONGEST_NUMBER = 30  # characters of a page number with all that belongs to it
LONGEST_VALUE = 15  # digits of a stamp that its value keeps, further ones in front belong to its form
_DIGITS = str.maketrans("oOlLiI|ıİ", "001111111")  # whatever [oOlI|] matches in either case
_ROMAN = str.maketrans("ıİ", "ii")
_NUMBER_WORD = re.compile(r"\d|^[ivxlcIVXLC]{1,8}$")
_NUMBER = r"(?=[oOlI|]{0,5}\d)[\doOlI|]{1,6}"
_PAGE = re.compile(rf"^(?:(?:page|seite|p\.|pg\.?|página|pág\.|стр\.|s\.|{'|'.join(['pagc', 'pa9e', 'pa9c'])}) ?({_NUMBER})(?: ?(?:of|von|de|sur|из|/) ?{_NUMBER})?|- ?({_NUMBER}) ?-|\[({_NUMBER})\]|({_NUMBER}) ?\||\| ?({_NUMBER})|({_NUMBER}) ?/ ?{_NUMBER}|({_NUMBER})|([ivxlc]{{1,8}})|[A-Z]{{2,6}}[-_ ]?[\dOolI|]{{5,}})$", re.I)
_STAMP = r"[A-Za-z]{2,6}?(?=[-_ ]?[\dOolI|]{5,}$)"
_WORDS = re.compile(r"(?:(?<!\S)[@!|†$](?=[^\W\d_]{2}))?[^\W_](?:[^\W_]|[@!|†$­¬]|(?<=\w)[-’'‐‑](?=\w))*", re.U)
_PLAIN_WORDS = re.compile(r"[^\W_]+(?:[­¬]+[^\W_]*|[-’'‐‑](?=\w)[^\W_]*)*")
_ODD = re.compile(r"[@!|†$]")
_SPOT = re.compile(rf"[\d@!|†{re.escape(SPECKS)}]")
_SPECK = re.compile(rf"(?:^|(?<=\s))[{re.escape(SPECKS)}](?=\s|$)")
_MIXED = re.compile(r"(?<![^\W_])(?=[\dOolISB|]*\d)(?=[\dOolISB|]*[OolISB|])(?:[\dOolISB|]+)(?![^\W_])")
_INNER = re.compile(r"[^\W\d_][@!|†][^\W\d_]|(?:^|(?<=[\s(\"'’]))[@!†][^\W\d_]{2}|[^\W\d_]{2}[@†](?=[\s.,;:)]|$)|[a-zß-ÿ]\d[a-zß-ÿ]|(?<![\w.,-])\d[a-zß-ÿ]{4}|[a-zß-ÿ]{4}\d(?![\w.])")
_ADDRESS = re.compile(r"\S+@[\w-]+\.\w")


class _Folded(dict):
    """What a key keeps of a character: nothing of marks, else its folded form."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = kept = _FOLD.get(code, c if c.isalnum() and not unicodedata.combining(c) else None)
        return kept


class _Unmarked(dict):
    def __missing__(self, code: int) -> str | None:
        self[code] = kept = None if unicodedata.combining(chr(code)) else chr(code)
        return kept


_FOLDED, _UNMARKED = _Folded(), _Unmarked()


def fuzzy_key(line: str) -> str:
    """Equal for lines that differ by recognition errors, case, accents and spacing only."""
    low = line.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).translate(_UNMARKED)
    for read, stood in _PAIRS:
        if read in low:
            low = low.replace(read, stood)
    return low.translate(_FOLDED).replace("ll", "u")


def roman(numeral: str) -> int:
    """The value of a Roman numeral in lower case, as its letters stand."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in numeral]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def page_number(line: str) -> tuple[bool, int | None, str]:
    """Whether the line is only a page number or stamp; its value; its form with ``#`` for the number.

    Roman numerals count too; a stamp's value is its last digits, its form has its letters and digits beyond those.
    """
    text = line.strip()
    m = _PAGE.match(text) if len(text) <= LONGEST_NUMBER else None
    if not m:
        return False, None, ""
    if m[8]:
        return True, roman(m[8].translate(_ROMAN).lower()), "roman"
    digits = next((g for g in m.groups()[:7] if g), None)
    if digits:
        form = re.sub(_NUMBER, "#", text.lower())
    else:
        letters = (re.match(_STAMP, text) or re.match(_STAMP, text, re.I))[0]
        digits = text[len(letters) :].strip("-_ ").translate(_DIGITS)
        digits, form = digits[-LONGEST_VALUE:], letters.upper() + digits[:-LONGEST_VALUE] + "#"
    return True, int(digits.translate(_DIGITS)), form


def split_furniture(line: str) -> tuple[str, bool, int | None, str]:
    """The header text of a line (may be empty), and its page number as ``page_number`` gives it."""
    whole = page_number(line)
    if whole[0]:
        return "", *whole
    parts = re.split(r"\s{2,}", line.strip())
    if len(parts) >= 2:
        for number, rest in ((parts[0], parts[1:]), (parts[-1], parts[:-1])):
            found = page_number(number)
            if found[0]:
                return "  ".join(rest), *found
    m = re.match(rf"^(.*?\w.*?)\s+({_NUMBER} ?\|)$", line.strip())
    if m:
        return m[1], *page_number(m[2])
    words = line.split()
    for number, rest in ((words[-1], words[:-1]), (words[0], words[1:])):  # beside one space only its repetition proves it
        if len(rest) >= 2 and _NUMBER_WORD.search(number) and page_number(number)[0]:
            return " ".join(rest), False, None, ""
    return line.strip(), False, None, ""


def shape(text: str) -> str:
    """A header's form without its numbers: equal over the sidecars of one kind."""
    return " ".join("#" if any(c.isdigit() for c in w) or re.fullmatch("[IVXL]+", w) else fuzzy_key(w) for w in text.split())


EDGE_TYPE = "array<struct<line_no: int, zone: string, depth: int, key: string, shape: string, numbered: boolean, number: bigint, form: string>>"


def edge_lines(texts: pd.Series, zones: pd.Series, depths: range = range(EDGE)) -> pd.Series:
    """The lines at a page's edges, so many lines from its top or bottom, with what tells furniture from text."""

    def of(text: str | None, wanted: str) -> list[dict]:
        lines = [(n, line) for n, line in enumerate((text or "").split("\n"), 1) if line.strip()]
        out = []
        half = (len(lines) + 1) // 2
        top, bottom = [(k, lines[k]) for k in depths if k < half], [(k, lines[-1 - k]) for k in depths if k < len(lines) - half]
        for zone, part in (("top", top), ("bottom", bottom)):
            for k, (n, line) in part if zone in wanted else ():
                head, numbered, value, form = split_furniture(line)
                out.append({"line_no": n, "zone": zone, "depth": k, "key": fuzzy_key(head), "shape": shape(head), "numbered": numbered, "number": value, "form": form})
        return out

    return pd.Series([of(t, z) for t, z in zip(texts, zones, strict=True)], index=texts.index, dtype=object)


def recognised_pages(results: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of sidecars that an OCR run produced for a PDF whose valid verdict calls for OCR; copies count once.

    ``page_id``, ``sidecar_rel``, ``page_no``, ``markdown``. Pages without text are left out.
    """
    latest = index.groupBy("file").agg(F.max_by("verdict", F.col("row_no")).alias("verdict"))
    valid = latest.where(F.col("verdict").isin(*VERDICTS)).select(F.col("file").alias("source_rel"))
    sidecars = results.where("ocr_done and sidecar_rel is not null").join(valid, "source_rel", "left_semi").select("sidecar_rel").distinct()
    kept = pages.where("page_id is not null and markdown rlike '[^ \\t\\r\\n]'").select("page_id", "sidecar_rel", "page_no", "markdown").join(broadcast_if_small(cut_lineage(sidecars), FEW), "sidecar_rel", "left_semi")
    repeated = broadcast_if_small(kept.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id"), FEW)
    once = kept.join(repeated, "page_id", "left_anti")  # only the texts of repeated pages are shuffled
    folded = kept.join(repeated, "page_id", "left_semi").groupBy("page_id").agg(F.min(F.struct("sidecar_rel", "page_no", "markdown")).alias("p")).select("page_id", "p.*")
    return once.select("page_id", "sidecar_rel", "page_no", "markdown").unionByName(folded)


def edges_of(pages: DataFrame, depths: range) -> DataFrame:
    """A row for each line at those depths of each page, in the ``zones`` that the page names."""

    def lines(texts: pd.Series, zones: pd.Series) -> pd.Series:
        return edge_lines(texts, zones, depths)

    return pages.select("page_id", "sidecar_rel", "page_no", F.explode(F.pandas_udf(lines, EDGE_TYPE)("markdown", "zones")).alias("e")).select("page_id", "sidecar_rel", "page_no", "e.*")


def furniture(pages: DataFrame) -> DataFrame:
    """``page_id``, ``line_no``, ``kind`` (header or page_no) of all running headers, footers and page numbers.

    A line counts if it and all lines between it and the edge are furniture. Where that holds
    for all lines that were looked at, the next ``DEEPER`` are too; it ends with the longest
    header or footer.
    """
    edges, depth = cut_lineage(edges_of(pages.withColumn("zones", F.lit("top bottom")), range(EDGE))), EDGE
    until = Window.partitionBy("page_id", "zone").orderBy("depth")
    while True:
        marked = edges.join(edge_furniture(edges), ["page_id", "line_no"], "left").withColumn("open", F.count_if(F.col("kind").isNull()).over(until))
        found = cut_lineage(marked.where("open = 0").select("page_id", "zone", "depth", "line_no", "kind"))
        reached = found.where(F.col("depth") == depth - 1).groupBy("page_id").agg(F.concat_ws(" ", F.collect_set("zone")).alias("zones"))
        inner = cut_lineage(edges_of(pages.join(broadcast_if_small(reached, FEW), "page_id"), range(depth, depth + DEEPER)))
        if inner.isEmpty():
            return found.select("page_id", "line_no", "kind").distinct()
        edges, depth = edges.unionByName(inner), depth + DEEPER


def _pages(page: str = "page_id") -> Column:
    """Lines of a group, but one where all are on the same page; no distinct count is needed to tell repetition."""
    return F.when(F.min(page) == F.max(page), 1).otherwise(F.count("*"))


def errors_allowed(length: int) -> int:
    """Errors that a near form of so many characters may have."""
    return min(MOST_ERRORS, max(1, length // ERRORS_PER))


def pieces(keys: pd.Series) -> pd.Series:
    """A key's pieces, one more than the errors that a near form may have: of these at least one stands in it unchanged."""

    def of(key: str) -> list[str]:
        n = len(key)
        errors = {errors_allowed(m) for m in range(n - MOST_ERRORS, n + MOST_ERRORS + 1) if abs(m - n) <= errors_allowed(m)}
        return [f"{e} {n} {i} {key[i * n // (e + 1) : (i + 1) * n // (e + 1)]}" for e in errors for i in range(e + 1)]

    return keys.map(of)


def places(keys: pd.Series) -> pd.Series:
    """What ``pieces`` of another key may stand in this one: piece i is moved by the errors before it at most, which are i or fewer wherever those after it are few enough."""

    def of(key: str) -> list[str]:
        n, e, out = len(key), errors_allowed(len(key)), set()
        for m in range(n - e, n + e + 1):  # length of the other key
            for i in range(e + 1):
                begin, end = i * m // (e + 1), (i + 1) * m // (e + 1)
                for shift in range(max(-i, n - m - e + i), min(i, n - m + e - i) + 1):
                    if 0 <= begin + shift and end + shift <= n:
                        out.add(f"{e} {m} {i} {key[begin + shift : end + shift]}")
        return sorted(out)

    return keys.map(of)


def near_keys(own: DataFrame) -> DataFrame:
    """``sidecar_rel``, ``zone``, ``key``: keys of one page that stand on another page of the sidecar but for a few errors.

    Every two keys of a place are compared by edit distance. Where a place has more than
    ``MANY`` keys, only those that share a piece are; keys near to each other always do.
    """
    place = ["sidecar_rel", "zone"]
    keys = own.where(~F.col("heading") & (F.length("key") >= SHORTEST))
    ones = keys.where("on_pages = 1").select(*place, "key", "page")
    others = keys.select(*place, F.col("key").alias("other"), F.when(F.col("on_pages") == 1, F.col("page")).alias("other_page"))
    errors = F.least(F.lit(MOST_ERRORS), F.greatest(F.lit(1), F.expr(f"length(key) div {ERRORS_PER}")))
    # compared in the join, so no pair is ever written
    near = (F.col("key") != F.col("other")) & (F.col("other_page").isNull() | (F.col("page") != F.col("other_page"))) & (F.abs(F.length("key") - F.length("other")) <= errors) & F.levenshtein("key", "other", MOST_ERRORS).between(0, errors)
    crowded = cut_lineage(keys.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(*place))
    if crowded.isEmpty():
        return ones.join(others, place).where(near).select(*place, "key").distinct()
    crowded = broadcast_if_small(crowded, FEW)
    found = ones.join(crowded, place, "left_anti").join(others, place).where(near).select(*place, "key")
    cut = others.join(crowded, place, "left_semi").withColumn("piece", F.explode(F.pandas_udf(pieces, "array<string>")("other")))
    put = ones.join(crowded, place, "left_semi").withColumn("piece", F.explode(F.pandas_udf(places, "array<string>")("key")))
    return found.unionByName(put.join(cut, [*place, "piece"]).where(near).select(*place, "key")).distinct()


def repeated_keys(named: DataFrame) -> DataFrame:
    """``sidecar_rel``, ``zone``, ``key``: keys that stand at that edge on two pages of the sidecar, but for a few errors, or on three of another one."""
    own = cut_lineage(named.groupBy("sidecar_rel", "zone", "key").agg(_pages().alias("on_pages"), F.min("page_id").alias("page"), F.bool_or(F.col("shape").rlike("^# ")).alias("heading")))
    often = own.where("on_pages >= 3").select("key").distinct()
    kept = own.where("on_pages >= 2").unionByName(own.where("on_pages < 2").join(often, "key", "left_semi"))
    return kept.select("sidecar_rel", "zone", "key").unionByName(near_keys(own)).distinct()


def edge_furniture(edges: DataFrame) -> DataFrame:
    """``page_id``, ``line_no``, ``kind`` of those edge lines that are furniture.

    A header repeats over pages of its sidecar, in other sidecars, or in its form; a page
    number advances with the pages. Where a sidecar has too few numbered pages to show that,
    a number counts if most numbers of its form and place advance wherever it can be seen.
    """
    named = edges.where("key <> '' and length(key) >= 3")
    good = broadcast_if_small(cut_lineage(repeated_keys(named)), FEW).withColumn("repeats", F.lit(True))
    in_sidecar = named.where("shape like '%#%' and shape not rlike '^# '").groupBy("shape", "sidecar_rel").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shapes = in_sidecar.groupBy("shape").agg(F.count("*").alias("in_sidecars"), F.min("low").alias("low"), F.max("high").alias("high")).where("in_sidecars >= 3 and low <> high").select("shape", F.lit(True).alias("formed"))
    heads = named.join(good, ["sidecar_rel", "zone", "key"], "left").join(shapes, "shape", "left").where("repeats or numbered or formed")
    # headings of the text itself number its parts and stand at an edge by chance
    heads = heads.where(~F.col("shape").rlike(f"^({'|'.join(map(fuzzy_key, HEADINGS))}|#)( #)?$") | F.col("numbered"))
    stamp = F.col("form").rlike("^[A-Z]+\\d*#$")
    numbers = edges.where("numbered and key = ''").select("page_id", "line_no", "sidecar_rel", F.when(stamp | (F.col("form") == "roman"), F.col("form")).otherwise("#").alias("series"), (F.col("number") - F.col("page_no")).alias("shift"), F.when(stamp, "stamp").otherwise(F.col("form")).alias("form"), (F.col("depth") == 0).alias("outer"))
    by_shift = numbers.groupBy("sidecar_rel", "series", "shift").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    seen = Window.partitionBy("sidecar_rel", "series")
    advance = by_shift.select("sidecar_rel", "series", F.coalesce("shift", F.lit(NO_SHIFT)).alias("shift"), (F.col("shift").isNotNull() & (F.col("low") < F.col("high"))).alias("in_sequence"), (F.min("low").over(seen) < F.max("high").over(seen)).alias("can_be_seen"))
    placed = numbers.withColumn("shift", F.coalesce("shift", F.lit(NO_SHIFT))).join(advance, ["sidecar_rel", "series", "shift"])
    forms = placed.where("can_be_seen").groupBy("form", "outer").agg(F.avg(F.col("in_sequence").cast("int")).alias("rate"))
    counted = placed.join(forms, ["form", "outer"], "left").where(F.col("in_sequence") | (F.coalesce("rate", F.lit(1.0)) >= MOSTLY))
    return heads.select("page_id", "line_no", F.lit("header").alias("kind")).unionByName(counted.select("page_id", "line_no", F.lit("page_no").alias("kind"))).distinct()


def text_parts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The text lines of each page: ``page_id``, ``sidecar_rel``, ``page_no``, ``line_no``, ``last``, ``words``, ``left``, ``mark``, ``right``, ``spot``.

    ``words`` are lower-cased, without the pieces of cut words; a cut word's pieces are
    ``left`` with its ``mark`` and, unless the page ends, ``right`` on the line ``after``. ``spot`` tells of a speck or
    of a letter in a number.
    """
    taken = found.groupBy("page_id").agg(F.collect_set("line_no").alias("taken"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, sidecar, number, text, gone in zip(batch["page_id"], batch["sidecar_rel"], batch["page_no"], batch["markdown"], batch["taken"], strict=True):
                gone = set(gone) if gone is not None else ()
                lines = [(n, line.rstrip()) for n, line in enumerate(text.split("\n"), 1) if line.strip() and n not in gone]
                carried = False
                for k, (n, line) in enumerate(lines):
                    low = line.lower()
                    words = (_WORDS if _ODD.search(low) else _PLAIN_WORDS).findall(low)
                    head = words[0] if words and low.lstrip().startswith(words[0]) else None
                    if carried and words:
                        words = words[1:]
                    left = mark = right = after = None
                    if line[-1] in MARKS and len(line) > 1 and line[-2].isalpha():
                        left, mark = re.search(rf"[^\s]*$", line[:-1])[0].lower().lstrip("(\"“„«'"), line[-1]
                        words = words[:-1]
                        if k + 1 < len(lines):
                            after = lines[k + 1][0]
                            m = re.match(r"[^\W\d_](?:[^\W_]|[-’'‐@!|†$])*", lines[k + 1][1].lstrip())
                            right = m[0] if m else ""
                    carried = bool(left) and bool(right)
                    spot = bool(_SPOT.search(line) and (_SPECK.search(line) or _MIXED.search(line) or (_INNER.search(line) and not _ADDRESS.search(line))))
                    out.append((page, sidecar, number, n, k, k + 1 == len(lines), words, head, left, mark, right, after, spot))
            yield pd.DataFrame(out, columns=["page_id", "sidecar_rel", "page_no", "line_no", "nth", "last", "words", "head", "left", "mark", "right", "after", "spot"], dtype=object)

    return pages.join(broadcast_if_small(taken, FEW_PAGES), "page_id", "left").mapInPandas(split, "page_id bigint, sidecar_rel string, page_no int, line_no int, nth int, last boolean, words array<string>, head string, left string, mark string, right string, after int, spot boolean")


def misreadings(words: pd.Series) -> pd.Series:
    """How a word may have been misread: one confusion at one place, or everywhere."""

    def of(word: str) -> list[str]:
        out = set()
        for read, stood in CONFUSIONS:
            at = word.find(stood)
            if at >= 0:
                out.add(word.replace(stood, read))
            while at >= 0:
                out.add(word[:at] + read + word[at + len(stood) :])
                at = word.find(stood, at + 1)
        return sorted(w for w in out if w != word and len(w) >= 3)

    return words.map(of)


def misread_words(vocabulary: DataFrame, cuts: DataFrame) -> DataFrame:
    """``word``, ``correction``: rare words, whole or cut, that are a frequent word of the vocabulary but for recognition errors.

    The misreadings of the frequent words, which are few, are joined to the vocabulary.
    """
    joined = cuts.where("rest_line is not null").groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n"))
    joined = joined.join(vocabulary, "word", "left_anti")
    rare = vocabulary.unionByName(joined).where("length(word) >= 3")
    known = vocabulary.select(F.col("word").alias("correction"), F.col("n").alias("times")).where(F.col("times") >= max(FREQUENT, TIMES))
    tries = known.select("correction", "times", F.explode(F.pandas_udf(misreadings, "array<string>")("correction")).alias("word"))
    good = rare.join(tries, "word").where(F.col("times") >= TIMES * F.col("n"))
    return good.groupBy("word").agg(F.max_by("correction", F.struct("times", "correction")).alias("correction"))


def cut_words(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``page_id``, ``line_no``, ``joined``: lines that end inside a word with a mark foreign to it, and where its ``rest`` stands.

    A page's last line goes on with the first text line of the sidecar's next page.
    """
    cuts = parts.where("left is not null").select("page_id", "sidecar_rel", "page_no", "line_no", "left", "mark", "right", "last", "after")
    starts = parts.where("nth = 0 and head is not null").groupBy("sidecar_rel", (F.col("page_no") - 1).cast("int").alias("page_no")).agg(F.min(F.struct("head", "page_id", "line_no")).alias("next"))
    cuts = cuts.join(starts, ["sidecar_rel", "page_no"], "left").withColumn("rest", F.when(F.col("last"), F.col("next.head")).otherwise(F.col("right")))
    cuts = cuts.withColumn("rest_page", F.when(F.col("last"), F.col("next.page_id")).otherwise(F.col("page_id"))).withColumn("rest_line", F.when(F.col("last"), F.col("next.line_no")).otherwise(F.col("after")))
    # a mark other than the plain hyphen never belongs to a word; a capital or no letter after it starts a new word
    cuts = cuts.where("rest is null or rest = '' or rest rlike '^[^A-ZÄÖÜÀ-Þ]'")
    forms = cuts.withColumn("joined", F.concat("left", F.coalesce(F.lower("rest"), F.lit("")))).withColumn("whole", F.concat_ws("-", "left", F.lower("rest")))
    count = lambda c: vocabulary.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    forms = forms.join(count("joined"), "joined", "left").join(count("whole"), "whole", "left").join(count("left"), "left", "left")
    compound = (F.coalesce("n_whole", F.lit(0)) > F.coalesce("n_joined", F.lit(0))) | (F.col("n_whole").isNull() & F.col("n_joined").isNull() & (F.coalesce("n_left", F.lit(0)) >= 20) & (F.length("left") >= 3))
    return forms.where(F.col("mark").isin(*MARKS[1:4]) | ~compound).select("page_id", "line_no", "joined", "left", "rest_page", "rest_line").distinct()


def damaged_lines(results: DataFrame, index: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All that was found: ``pages``, ``furniture``, ``parts``, ``cuts``, ``misread`` (page_id, line_no) and ``words``.

    Pages with null or blank text, null ids and sidecars that no OCR run made have no rows;
    repeated rows of any table count once; extra columns are ignored.
    """
    own = cut_lineage(recognised_pages(results, index, pages))
    # each of these is read by several joins; written once, they also keep the plan small
    found = furniture(own)
    parts = cut_lineage(text_parts(own, found))
    vocabulary = cut_lineage(parts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    cuts = cut_lineage(cut_words(parts, vocabulary))
    bad = cut_lineage(misread_words(vocabulary, cuts))
    words = parts.select("page_id", "line_no", F.explode(F.array_distinct("words")).alias("word")).join(broadcast_if_small(bad, FEW), "word")
    # an error in a cut word stands on the line of the piece that differs from the right word
    in_rest = F.substring("correction", 1, F.length("left")) == F.col("left")
    halves = cuts.where("rest_line is not null").join(bad, F.col("joined") == F.col("word")).select(F.when(in_rest, F.col("rest_page")).otherwise(F.col("page_id")).alias("page_id"), F.when(in_rest, F.col("rest_line")).otherwise(F.col("line_no")).alias("line_no"))
    spots = parts.where("spot").select("page_id", "line_no")
    misread = words.select("page_id", "line_no").unionByName(halves).unionByName(spots).distinct()
    return {"pages": own, "furniture": found, "parts": parts, "cuts": cuts, "misread": misread, "words": words}


def damage(results: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id``, ``line_no``, ``kind``: header, page_no, hyphen or misread."""
    d = damaged_lines(results, index, pages)
    return d["furniture"].unionByName(d["cuts"].select("page_id", "line_no", F.lit("hyphen").alias("kind"))).unionByName(d["misread"].withColumn("kind", F.lit("misread"))).distinct()


def repaired_pages(results: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id``, ``sidecar_rel``, ``page_no``, ``text``: each page as paragraphs of the original wording.

    Furniture is gone, cut words are joined, misread words and letters in numbers are put
    right, specks are dropped; blank lines part paragraphs. The rest of a word that the next
    page begins with stays there.
    """
    d = damaged_lines(results, index, pages)
    gone = d["furniture"].groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    cuts = d["cuts"].groupBy("page_id").agg(F.collect_set("line_no").alias("cuts"))
    fixes = d["words"].groupBy("page_id").agg(F.collect_set(F.struct("word", "correction")).alias("fixes"))
    all_of = d["pages"].join(gone, "page_id", "left").join(cuts, "page_id", "left").join(fixes, "page_id", "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text, dropped, ends, pairs in zip(batch["markdown"], batch["gone"], batch["cuts"], batch["fixes"], strict=True):
                dropped, ends = set(dropped if dropped is not None else ()), set(ends if ends is not None else ())
                fix = {f["word"]: f["correction"] for f in (pairs if pairs is not None else ())}
                out, open_end = "", "\n\n"
                for n, line in enumerate(text.split("\n"), 1):
                    if n in dropped:
                        continue
                    if not line.strip():
                        open_end = open_end if open_end == "" else "\n\n"
                        continue
                    line = _SPECK.sub("", line)
                    line = _MIXED.sub(lambda m: m[0].translate(str.maketrans("OoIl|SB", "0011158")), line)
                    if fix:
                        line = _WORDS.sub(lambda m: _cased(m[0], fix.get(m[0].lower())), line)
                    line = re.sub(r" {2,}", " ", line.strip())
                    out += (open_end if out else "") + (line.rstrip(MARKS) if n in ends else line)
                    compound = len(line) > 1 and line[-1] == "-" and line[-2].isalnum()
                    open_end = "" if n in ends or compound else " "
                texts.append(out)
            yield pd.DataFrame({"page_id": batch["page_id"], "sidecar_rel": batch["sidecar_rel"].tolist(), "page_no": batch["page_no"], "text": texts})

    return all_of.mapInPandas(repair, "page_id bigint, sidecar_rel string, page_no int, text string")


def _cased(word: str, correction: str | None) -> str:
    if correction is None:
        return word
    return correction.upper() if word.isupper() and len(word) > 1 else correction.capitalize() if word[0].isupper() else correction
