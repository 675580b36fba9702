"""From extracted pages to clean texts, with quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

SAMPLE_PAGES = 10


def pages_of(extracted: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """(keep..., pos, page, text): one row per page in stored order; documents without pages have none."""
    return extracted.select(*keep, F.posexplode("pages").alias("pos", "p")).select(*keep, "pos", "p.page", "p.text")


def boilerplate_lines(pages: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """(key, line, n): edge lines found on at least half of a document's pages (and twice)."""
    per_page = pages.select(key, F.coalesce("text", F.lit("")).alias("text"))
    counts = per_page.select(key, F.explode(T.edge_lines("text")).alias("line")).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_page.groupBy(key).agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * share)).alias("least"))
    return counts.join(sizes, key).where(F.col("n") >= F.col("least")).select(key, "line", "n")


def clean_pages(extracted: DataFrame, *, normalise: bool = True) -> DataFrame:
    """(doc_id, pos, page, text): characters normalised, boilerplate and page numbers removed, space squeezed.

    Null pages become empty; repeated documents are told apart by their row.
    """
    rows = extracted.select("doc_id", F.xxhash64("doc_id", "extracted_at", F.size("pages")).alias("_row"), "pages")
    pages = pages_of(rows, ["doc_id", "_row"]).withColumn("text", F.coalesce("text", F.lit("")))
    if normalise:
        pages = pages.withColumn("text", T.plain_signs(T.nfkc("text")))
    drop = boilerplate_lines(pages, "_row").groupBy("_row").agg(F.collect_set("line").alias("_drop"))
    joined = pages.join(drop, "_row", "left")
    kept = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(T.without_lines("text", F.coalesce("_drop", F.array().cast("array<string>"))))
    return joined.select("doc_id", "_row", "pos", "page", T.squeeze_space(T.drop_page_numbers(kept)).alias("text"))


def joined_text(pages: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """(keys..., text): the pages in order, each after a mark that names its page."""
    mark = F.concat(F.lit("\f<PAGE "), F.col("page").cast("string"), F.lit(">\f\n"), F.col("text"))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", mark.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def page_sample(extracted: DataFrame, n: int = SAMPLE_PAGES, keys: list[str] = ["doc_id"]) -> DataFrame:
    """(keys..., page, text): up to n pages of each document, chosen by a hash of document and page."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", "doc_id", F.col("page").cast("string"))), "pos")
    return pages_of(extracted, keys).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(*keys, "page", "text")


def page_checks(pages: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pages.select(*keep, "page", F.length(text).alias("chars"), T.has_section_sign(text).alias("has_section_sign"), T.suspicious_chars(text).alias("suspicious"))


def document_checks(extracted: DataFrame, n: int = SAMPLE_PAGES) -> DataFrame:
    """One row per document row: rates over its sampled pages, average characters over all, and what speaks for
    extracting it again. Documents without pages have zero rates."""
    keys = ["doc_id", "extracted_at"]
    size = F.coalesce(F.try_divide(F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(F.coalesce(p["text"], F.lit("")))).cast("double"), F.col("page_count").cast("double")), F.lit(0.0))
    head = extracted.select(*keys, "extractor", F.coalesce(size, F.lit(0.0)).alias("avg_chars"))
    sampled = page_checks(page_sample(extracted.where("pages is not null"), n, keys), keys)
    rates = sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("chars") < 20).alias("empty"), F.count_if("has_section_sign").alias("signs"), F.sum("suspicious").alias("odd"), F.sum("chars").alias("chars"))
    rates = rates.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = head.join(rates, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("extracted_at").eqNullSafe(F.col("_extracted_at")), "left").fillna(0, ["k", "empty", "signs", "odd", "chars"])
    over = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    joined = joined.select("doc_id", "extractor", F.col("k").alias("sampled"), "avg_chars", over("empty", "k").alias("empty_rate"), over("signs", "k").alias("section_rate"), over("odd", "chars").alias("suspicious_rate"))
    return joined.withColumn("reasons", reasons())


def reasons() -> Column:
    """The reasons against an extraction, in order; columns as in document_checks."""
    # The reasons' texts and the limits beyond which they hold.
    return F.array_compact(F.array(
        F.when(F.coalesce("extractor", F.lit("")).isin("", "failed"), "extraction failed"),
        F.when(F.col("avg_chars") < 100, "near-empty document"),
        F.when(F.col("empty_rate") > 0.4, F.concat(T.percent(F.col("empty_rate")), F.lit(" of sampled pages near-empty"))),
        F.when((F.col("section_rate") == 0) & (F.col("avg_chars") > 200), "no section markers in sample"),
        F.when(F.col("suspicious_rate") > 0.005, "high suspicious-char rate (OCR garble?)")))


def with_verdict(checks: DataFrame) -> DataFrame:
    """needs_reextraction unless there is no reason, or only that the sample shows no section numbering."""
    soft = (F.size("reasons") == 1) & (F.get("reasons", F.lit(0)) == "no section markers in sample")
    return checks.withColumn("reason", F.array_join("reasons", "; ")).withColumn("needs_reextraction", (F.size("reasons") > 0) & ~soft).drop("reasons")


def quality_summary(checks: DataFrame) -> DataFrame:
    """The summary table with fixed-format numbers, one row per document."""
    num = lambda c, d: F.format_string(f"%.{d}f", F.bround(c, d))
    return with_verdict(checks).select("doc_id", "extractor", num("avg_chars", 1).alias("avg_chars"), num("empty_rate", 2).alias("empty_rate"), num("section_rate", 2).alias("section_rate"),
                                       num("suspicious_rate", 4).alias("suspicious_rate"), F.col("needs_reextraction").cast("int").alias("needs_reextraction"), "reason")


def extractor_breakdown(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy(F.coalesce("extractor", F.lit("")).alias("extractor")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce(F.size("pages"), F.lit(0))).alias("n_pages"))


def run_totals(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(extractor, n_documents, n_pages, n_chunks, needs_reextraction, n_failures) of a run: documents by extractor, with
    what came out of them. chunks has a row per chunk; a document with errors and no pages has failed."""
    name = F.coalesce("extractor", F.lit("")).alias("extractor")
    rows = extracted.groupBy(name).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce(F.size("pages"), F.lit(0))).alias("n_pages"), F.count_if((F.coalesce(F.size("pages"), F.lit(0)) <= 0) & (F.coalesce(F.size("extraction_errors"), F.lit(0)) > 0)).alias("n_failures"))
    verdicts = with_verdict(document_checks(extracted)).groupBy(name).agg(F.count_if("needs_reextraction").alias("needs_reextraction"))
    owners = extracted.groupBy("doc_id").agg(F.min(name).alias("extractor"))
    made = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(owners, "doc_id").groupBy("extractor").agg(F.sum("n").alias("n_chunks"))
    return rows.join(verdicts, "extractor").join(made, "extractor", "left").select("extractor", "n_documents", "n_pages", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "needs_reextraction", "n_failures")
