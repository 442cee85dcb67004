"""Keyed, incremental indexes of a document tree: loading, comparing, updating and pruning.

Everything is an aggregation or an equi-join on the file's path, so Spark shuffles narrow
rows only and combines them before the shuffle; no key's rows are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEEDS_OCR = ("scanned-image-only", "scan+ocr", "mixed/other")
STATUSES = ("converted", "unchanged", "deferred_for_ocr", "failed")


def last_row_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row with the highest position of each key; null keys are kept as one key."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("__row"))
    return picked.select(key, "__row.*")


def hash_index(rows: DataFrame) -> DataFrame:
    """``file``, ``hash`` of the valid rows of an index of content hashes."""
    return last_row_wins(rows.select("file", "hash", "row_no"), "file", "row_no").select("file", "hash")


def token_index(rows: DataFrame) -> DataFrame:
    """``file``, ``tokens`` (BIGINT); rows whose count is no integer are dropped before the last one wins."""
    integer = F.when(F.trim("tokens").rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(F.trim("tokens"), F.lit("_"), F.lit(""))).try_cast("bigint")
    counted = rows.select("file", integer.alias("tokens"), "row_no").where("tokens is not null")
    return last_row_wins(counted, "file", "row_no").select("file", "tokens")


def ocr_index(rows: DataFrame) -> DataFrame:
    """The valid rows of the index of PDF classifications with typed counts and a boolean ``ocr_done``."""
    last = last_row_wins(rows, "file", "row_no")
    counts = [F.col(c).try_cast("bigint").alias(c) for c in ("pages", "pg_image_only", "pg_scan_ocr", "pg_digital", "pg_other")]
    return last.select("file", "hash", *counts, "verdict", F.coalesce("producer", F.lit("")).alias("producer"), (F.coalesce("ocr_done", F.lit("")) == "true").alias("ocr_done"))


def needs_ocr(verdict: Column) -> Column:
    """Whether a verdict calls for recognition; an error verdict does not."""
    return F.coalesce(verdict.isin(*NEEDS_OCR), F.lit(False))


def page_class(coverage: Column, chars: Column) -> Column:
    """Class of a page by its image coverage and number of characters."""
    return F.when((coverage >= 0.8) & (chars < 20), "image_only").when(coverage >= 0.8, "scan_ocr").when(chars >= 20, "digital").otherwise("other")


def majority_verdict(pages: Column, image: Column, scan: Column, digital: Column) -> Column:
    """Verdict of a PDF by the classes of at least half of its pages; images and scans together come first."""
    half = F.greatest(F.coalesce(pages, F.lit(0)), F.lit(1)) / 2
    return F.when(image + scan >= half, F.when(scan > image, "scan+ocr").otherwise("scanned-image-only")).when(digital >= half, "digital-text").otherwise("mixed/other")


def latest_runs(results: DataFrame) -> DataFrame:
    """The last run of each source; exact duplicates count once, a run without time comes first."""
    rest = [c for c in results.columns if c != "source_rel"]
    order = F.struct(F.col("run_at"), *(F.col(c) for c in rest if c != "run_at"))
    return results.groupBy("source_rel").agg(F.max_by(F.struct(*rest), order).alias("r")).select("source_rel", "r.*")


def changed_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """``file``, ``old_hash``, ``new_hash`` of the files that are new or whose hash differs; nulls compare as values."""
    k = known.select("file", F.col("hash").alias("old_hash"))
    return current.select("file", F.col("hash").alias("new_hash")).join(k, "file", "left").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")) | F.col("old_hash").isNull()).select("file", "old_hash", "new_hash")


def unchanged_sources(latest: DataFrame, hashes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sources that need no new conversion: same hash as indexed, a sidecar, and a token count for that sidecar."""
    t = tokens.select(F.col("file").alias("sidecar_rel"), "tokens")
    h = hashes.select(F.col("file").alias("source_rel"), "hash")
    joined = latest.select("source_rel", "file_hash", "sidecar_rel").join(h, "source_rel").where(F.col("file_hash") == F.col("hash"))
    return joined.join(t, "sidecar_rel").select("source_rel", "sidecar_rel", "tokens")


def pending_ocr(index: DataFrame, sidecars: DataFrame) -> DataFrame:
    """PDFs whose verdict calls for OCR and that have no sidecar from a finished one."""
    done = index.where("ocr_done").join(sidecars.select(F.col("sidecar_rel").alias("s")).distinct(), F.concat("file", F.lit(".md")) == F.col("s"), "left_semi").select("file")
    return index.where(needs_ocr(F.col("verdict"))).join(done, "file", "left_anti").select("file", "verdict", "pages")


def staged_index(known: DataFrame, latest: DataFrame) -> DataFrame:
    """The hash index after a run: converted sources replace or join the known rows."""
    new = latest.where("status = 'converted' and file_hash is not null").select(F.col("source_rel").alias("file"), F.col("file_hash").alias("hash"))
    return known.join(new, "file", "left_anti").unionByName(new)


def pruned(index: DataFrame, existing: DataFrame) -> DataFrame:
    """Index rows whose file still exists."""
    return index.join(existing.select("file").distinct(), "file", "left_semi")


def tree_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``file``, ``state`` (missing, extra or differs) between two listings with hashes; equal files are left out."""
    a, b = left.select("file", F.col("hash").alias("a"), F.lit(1).alias("in_a")), right.select("file", F.col("hash").alias("b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, "file", "full_outer").select("file", state.alias("state")).where("state is not null")


def split_incoming(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``file``, ``hash``, ``state``: new key, existing (the value is among the key's values) or conflicting."""
    keys = existing.groupBy("file").agg(F.count("*").alias("n"))
    pairs = existing.select("file", "hash").distinct().withColumn("same", F.lit(True))
    state = F.when(F.col("n").isNull(), "new").when(F.col("same"), "existing").otherwise("conflicting")
    return incoming.select("file", "hash").distinct().join(keys, "file", "left").join(pairs, ["file", "hash"], "left").select("file", "hash", state.alias("state"))


def run_summary(latest: DataFrame) -> DataFrame:
    """One row of counts by status, zeros shown."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return latest.agg(*counts, F.count("*").alias("n_results"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def expected_sidecars(sources: DataFrame, dotted: bool = False) -> DataFrame:
    """The sidecar path of each source: beside it, with ``.md`` added, and a leading dot where ``dotted``."""
    name = F.regexp_extract("source_rel", r"([^/]*)$", 1)
    folder = F.regexp_extract("source_rel", r"^(.*/)?[^/]*$", 1)
    return sources.select("source_rel", F.concat(folder, F.lit("." if dotted else ""), name, F.lit(".md")).alias("sidecar_rel"))


def sidecar_candidates(sources: DataFrame) -> DataFrame:
    """``source_rel``, ``file``, ``dotted``: both sidecar paths that a source may have."""
    plain, dotted = (expected_sidecars(sources, dotted=d).select("source_rel", F.col("sidecar_rel").alias("file"), F.lit(d).alias("dotted")) for d in (False, True))
    return plain.unionByName(dotted)


def reconciled(hashes: DataFrame, tokens: DataFrame, ocr: DataFrame, discovered: DataFrame, protected: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three indexes without stale rows; each has keys of its own kind.

    Hash rows stay for sources that were discovered, classification rows for PDFs among them,
    and token rows for sidecars of theirs that exist. Both sidecars of a protected source
    (one that could not be hashed, or is in conflict) stay whether they exist or not.
    """
    found = discovered.select("source_rel").distinct()
    candidates = sidecar_candidates(found)
    there = candidates.join(existing.select("file").distinct(), "file", "left_semi").select("file")
    kept = there.unionByName(candidates.join(protected.select("source_rel").distinct(), "source_rel", "left_semi").select("file"))
    sources = found.withColumnRenamed("source_rel", "file")
    return pruned(hashes, sources), pruned(tokens, kept), pruned(ocr, sources.where(F.lower("file").endswith(".pdf")))


def recoverable(latest: DataFrame, ocr: DataFrame, existing: DataFrame) -> DataFrame:
    """``source_rel``, ``sidecar_rel``, ``verdict``: PDFs that OCR has finished for this very content and whose sidecar is still there."""
    done = ocr.where(needs_ocr(F.col("verdict")) & F.col("ocr_done")).select(F.col("file").alias("source_rel"), F.col("hash").alias("file_hash"), "verdict")
    found = latest.select("source_rel", "sidecar_rel", "file_hash").join(done, ["source_rel", "file_hash"])
    return found.join(existing.select(F.col("file").alias("sidecar_rel")).distinct(), "sidecar_rel", "left_semi").select("source_rel", "sidecar_rel", "verdict")


def remaining(hashed: DataFrame, handled: list[DataFrame], excluded: DataFrame) -> DataFrame:
    """``source_rel`` of the sources with a hash that no earlier step handled and that nothing excludes."""
    left = hashed.select("source_rel").distinct()
    for step in [*handled, excluded]:
        left = left.join(step.select("source_rel").distinct(), "source_rel", "left_anti")
    return left
