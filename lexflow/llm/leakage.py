"""Evaluation texts leaking into training text.

Spaced seeds: a mask of fixed length keeps some token positions and ignores the others, so
two passages that differ by replaced words still share hashes. Items are folded by their
words; the hashes of all item texts, less those of clauses that several texts share, are
joined to the hashes of the documents. A Bloom filter of the items' hashes lets each document
emit only hashes that can meet one. Around the hits of a document and item the whole overlap
is verified: hits on nearly the same diagonal form a passage, which tolerates replaced, added
and dropped words, and the item's words in its best two passages are counted.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage

MASKS = ("11101001011", "11010110101", "11011000111")
LEAST_SHARE = 1 / 3  # of an item's words
LEAST_PASSAGE = 14  # words; a shorter passage is a phrase, but for items that are hardly longer
LEAST_EQUAL = 0.6  # of a passage's words
COMMON_ITEMS = 3  # a seed of so many different item texts belongs to a common clause
LEAST_OWN = 0.5  # of an item's seeds; an item with fewer of its own is known by all its seeds
DRIFT = 12  # words added or dropped between two hits of one passage
BRIDGE = 21  # words between two hits up to which the words between them belong to the passage
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 8, 20, 28  # of the filter, as powers of two: at most 32 MB
FEW = 1_000_000  # narrow rows of seeds that are broadcast; more are joined by a salted shuffle
FEW_TEXTS = 20_000  # item texts that are broadcast
SALTS = 16
CHUNK = 1 << 21  # characters that a task hashes at once

_MASKS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
SPAN = max(map(len, MASKS))
_IDEOGRAPH = "぀-ヿ㐀-䶿一-鿿豈-﫿"  # kana and ideographs are written without spaces: each is a word
_WORD = re.compile(r"\w+")
_WORD_OR_SIGN = re.compile(rf"[{_IDEOGRAPH}]|[^\W{_IDEOGRAPH}]+")
_SIGN = re.compile(f"[{_IDEOGRAPH}]")
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-case words without accents, widths and invisible characters; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        if _SIGN.search(text):
            return _WORD_OR_SIGN.findall(text.lower())
    return _WORD.findall(text.lower())


class Codes(dict):
    """A number from 1 on for each word; a task remembers the words it saw."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1
        return code

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), np.uint64)


def packed(codes: np.ndarray) -> bytes:
    return codes.astype("<u4").tobytes()


def unpacked(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, "<u4").astype(np.uint64)


def seed_hashes(codes: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions whose kept words are all there, and their hashes. Code 0 stands for no word."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, there = np.full(n, mask + 1, np.uint64), np.ones(n, bool)
    for at in _MASKS[mask]:
        part = codes[at : at + n]
        there &= part > 0
        h = (h ^ part) * _PRIME
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(there)
    return at, h[at]


def all_seeds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [seed_hashes(codes, m) for m in range(len(MASKS))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Item:
    """An item's words and seeds, the seeds sorted by hash, and which of them belong to common clauses."""

    def __init__(self, codes: np.ndarray, common: np.ndarray):
        self.codes = codes
        at, h = all_seeds(codes)
        order = np.lexsort((at, h))
        self.at, self.hashes = at[order], h[order]
        self.common = np.isin(self.hashes, common)
        self.least = min(LEAST_PASSAGE, max(SPAN, len(codes) - 2))

    def share_in(self, codes: np.ndarray, doc_at: np.ndarray, hashes: np.ndarray) -> float:
        """The share of the item's words in the best two passages of a text, in the item's order.

        A common clause adds to a passage of the item's own words beside it, but makes none.
        """
        left, right = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = right - left
        if not n.any():
            return 0.0
        at = np.repeat(doc_at, n)
        entry = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item_at, own = self.at[entry], ~self.common[entry]
        order = np.argsort(at - item_at, kind="stable")
        at, item_at, own = at[order], item_at[order], own[order]
        equal = self.codes[item_at[:, None] + np.arange(SPAN)] == codes[at[:, None] + np.arange(SPAN)]
        passages = []  # length, first and last word in the item, first word in the text
        cuts = np.flatnonzero(np.diff(at - item_at) > DRIFT) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(at)]):
            here = item_at[begin:end]
            if len(np.unique((here[own[begin:end], None] + np.arange(SPAN)))) < self.least:
                continue
            steps = np.diff(np.sort(here))
            length = SPAN + int(np.where(steps <= BRIDGE, steps, SPAN).sum())
            matched = len(np.unique((here[:, None] + np.arange(SPAN))[equal[begin:end]]))
            if matched >= LEAST_EQUAL * length:
                passages.append((length, int(here.min()), int(here.max()) + SPAN, int(at[begin:end].min())))
        if not passages:
            return 0.0
        first = max(passages)
        more = 0
        for length, low, high, text_low in passages:
            if (low - first[1]) * (text_low - first[3]) > 0:
                more = max(more, length - max(0, min(high, first[2]) - max(low, first[1])))
        return min(1.0, (first[0] + more) / len(self.codes))


def item_texts(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``item_id``, ``text_key`` of each item; ``text_key``, ``codes``, ``common`` of each distinct item text; and ``hash``, ``text_key`` of all seeds, and of those that are a text's own.

    Items with the same words are one text, so an item that several suites repeat keeps its
    seeds. ``common`` lists the hashes that ``COMMON_ITEMS`` texts or more share, counted
    over all items; of an item with few other seeds, as where its near copies are items
    too, none counts as common. Items shorter than a seed have no text.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for batch in batches:
            own = [codes.of(t) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "codes": [packed(c) for c in own]})

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, codes in zip(batch["text_key"], batch["codes"], strict=True):
                h = np.unique(all_seeds(unpacked(codes))[1])
                yield pd.DataFrame({"text_key": key, "hash": h.view(np.int64)})

    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text <> ''").distinct()
    coded = cut_lineage(held.mapInPandas(encode, "item_id bigint, codes binary").where(F.octet_length("codes") >= 4 * SPAN).select("item_id", "codes", F.xxhash64("codes").alias("text_key")))
    texts = coded.groupBy("text_key").agg(F.min("codes").alias("codes"))
    every = cut_lineage(texts.mapInPandas(seeds, "text_key bigint, hash bigint"))
    shared = every.groupBy("hash").agg(F.count("*").alias("texts")).where(F.col("texts") >= COMMON_ITEMS).select("hash", F.lit(True).alias("common"))
    flagged = every.join(shared, "hash", "left").groupBy("text_key").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("common"), F.col("hash"))).alias("common"))
    common = F.when(F.size("common") <= (1 - LEAST_OWN) * F.col("n"), F.col("common")).otherwise(F.array().cast("array<bigint>"))
    kept = flagged.select("text_key", common.alias("common"))
    own = every.join(kept, "text_key").where(~F.array_contains("common", F.col("hash"))).select("hash", "text_key")
    return coded.select("item_id", "text_key"), texts.join(kept, "text_key"), every, own


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column ``hash`` with two probes, as bytes, and its size as a power of two.

    Spark builds it in pieces of 4 KB; ``MOST_BITS`` bounds what reaches the driver.
    """
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n << BITS_PER_SEED).bit_length()))
    pieces = seeds.select(F.explode(F.array(F.expr(f"(hash & {(1 << bits) - 1}L) + 1"), F.shiftrightunsigned("hash", 64 - bits) + 1)).alias("p"))
    rows = pieces.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")).collect()
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows:
        piece = np.frombuffer(r.bitmap, np.uint8)
        begin = (r.bucket - 1) * 4096
        out[begin : begin + 4096] = piece[: len(out) - begin]
    return out, bits


def passing(filter_bytes: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets pass."""
    test = lambda p: (filter_bytes[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    first = np.flatnonzero(test(h & np.uint64((1 << bits) - 1)))
    return first[test(h[first] >> np.uint64(64 - bits)).astype(bool)]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Stretches of a batch with a bounded number of characters; a longer text is a stretch of its own."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, texts[begin:k]
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, texts[begin:]


def document_hits(docs: DataFrame, own: tuple[np.ndarray, int], every: tuple[np.ndarray, int]) -> DataFrame:
    """``id``, ``key``, ``codes``, ``at``, ``hash``: the documents with a hash that passes the filter of own seeds; their words, and their hashes that pass that of all seeds."""
    shared = docs.sparkSession.sparkContext.broadcast((own, every))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, gap = Codes(), np.zeros(SPAN, np.uint64)
        for batch in batches:
            ids, keys, texts_of = batch["id"].to_numpy(), batch["key"].to_numpy(), batch["t"].tolist()
            for begin, texts in chunks(texts_of):
                held = [codes.of(t) for t in texts]
                whole = np.concatenate([x for c in held for x in (c, gap)])
                start = np.cumsum([0, *(len(c) + SPAN for c in held)])
                at, h = all_seeds(whole)
                near = passing(*shared.value[1], h)
                order = near[np.argsort(at[near], kind="stable")]
                at, h = at[order], h[order]
                cuts = np.searchsorted(at, start)
                known = np.unique(np.searchsorted(start, at[passing(*shared.value[0], h)], "right") - 1)
                rows = [(ids[begin + k], keys[begin + k], packed(held[k]), at[a:b] - start[k], h[a:b].view(np.int64)) for k, a, b in zip(known, cuts[known], cuts[known + 1])]
                yield pd.DataFrame(rows, columns=["id", "key", "codes", "at", "hash"])

    return docs.mapInPandas(search, "id bigint, key bigint, codes binary, at array<int>, hash array<bigint>")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id``, ``item_id``, ``share``: documents with at least ``least_share`` of an item's words.

    Null and empty texts, null ids and items shorter than a seed match nothing. A repeated
    document or item id gives one row, with its largest share; items with equal words are each
    reported. Documents are read once and whole, where they lie. A checked number of item
    seeds is broadcast to the documents' hashes, more are joined by a shuffle that is salted
    by document, so a passage that a third of all documents hold is spread over many tasks.
    """
    members, texts, every, own = item_texts(items)
    own = cut_lineage(own)
    held = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("t")).where("id is not null and t <> ''")
    found = cut_lineage(document_hits(held, seed_filter(own), seed_filter(every)))
    hashes = found.select("id", "key", F.explode(F.array_distinct("hash")).alias("hash"))
    seeds = broadcast_if_small(own, FEW)
    if seeds is own:
        hashes = hashes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        seeds = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = hashes.join(seeds, [c for c in ("hash", "salt") if c in hashes.columns]).select("id", "key", "text_key").distinct()
    rows = pairs.join(found, ["id", "key"]).join(broadcast_if_small(texts.select("text_key", F.col("codes").alias("item_codes"), "common"), FEW_TEXTS), "text_key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Item] = {}
        for batch in batches:
            shares = []
            for key, item_codes, common, codes, at, h in zip(batch["text_key"], batch["item_codes"], batch["common"], batch["codes"], batch["at"], batch["hash"], strict=True):
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = Item(unpacked(item_codes), np.asarray(common, np.int64).view(np.uint64))
                shares.append(known[key].share_in(unpacked(codes), np.asarray(at), np.asarray(h, np.int64).view(np.uint64)))
            yield pd.DataFrame({"doc_id": batch["id"], "text_key": batch["text_key"], "share": shares})

    shares = rows.select("id", "text_key", "item_codes", "common", "codes", "at", "hash").mapInPandas(verify, "doc_id bigint, text_key bigint, share double")
    kept = shares.where(F.col("share") >= least_share).join(members, "text_key")
    return kept.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
