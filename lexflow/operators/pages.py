"""Page records of recognised documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_records(pages: DataFrame) -> DataFrame:
    """Each page once: of repeated records the one that went well, then the smallest."""
    return pages.groupBy("page_id").agg(F.min_by(F.struct(*(c for c in pages.columns if c != "page_id")), F.struct(~F.coalesce("ok", F.lit(False)), "sidecar_rel", "page_no", "markdown")).alias("p")).select("page_id", "p.*")


def _good():
    return F.coalesce(F.col("ok") & F.col("markdown").isNotNull(), F.lit(False))


def document_states(pages: DataFrame) -> DataFrame:
    """Per sidecar: pages, failed pages, and the failure's wording (its first failed page's error), null where all went well."""
    d = page_records(pages).groupBy("sidecar_rel").agg(
        F.count("*").alias("pages"),
        F.count_if(~_good()).alias("failed"),
        F.min_by(F.coalesce("error", F.lit("no result returned")), F.when(~_good(), F.struct("page_no", "page_id"))).alias("first"),
    )
    return d.select("sidecar_rel", "pages", "failed", F.when(F.col("failed") > 0, F.format_string("%d/%d page(s) failed: %s", "failed", "pages", "first")).alias("failure"))


def assembled_documents(pages: DataFrame) -> DataFrame:
    """Per sidecar: ``pages``, ``failed``, ``failure`` and the whole ``text``, its pages in page order with a blank line between.

    A document with a failed page fails as a whole and has no text. The pages of failed
    documents are dropped before the others are brought together by document.
    """
    states = document_states(pages)
    records = page_records(pages).where(_good())
    whole = records.join(states.where("failed = 0").select("sidecar_rel"), "sidecar_rel", "left_semi")
    texts = whole.groupBy("sidecar_rel").agg(F.sort_array(F.collect_list(F.struct("page_no", "page_id", "markdown"))).alias("rows"))
    texts = texts.select("sidecar_rel", F.array_join(F.transform("rows", lambda r: r["markdown"]), "\n\n").alias("text"))
    return states.join(texts, "sidecar_rel", "left").select("sidecar_rel", "pages", "failed", "failure", "text")
