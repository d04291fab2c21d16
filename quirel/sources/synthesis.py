"""PDF objects from ordinary tables: the inputs of round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writer import literal_string, stream

FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [" + " ".join(["500"] * 224) + "] >>"


def numbered_lines(docs: DataFrame, per_page: int) -> DataFrame:
    """(doc_id, page, line, text) of rows (doc_id, text), split at line feeds."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("page", F.floor(F.col("line") / per_page).cast("int"))


def show(x: Column, y: Column, text: Column) -> Column:
    """Shows text at a place: its own text object."""
    return F.concat(F.lit("BT /F0 10 Tf "), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(" Td "), literal_string(text), F.lit(" Tj ET"))


def page_contents(shows: DataFrame) -> DataFrame:
    """(doc_id, page, content) of rows (doc_id, page, seq, op)."""
    grouped = shows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("ops"))
    return grouped.select("doc_id", "page", F.array_join(F.transform("ops", lambda o: o["op"]), "\n").alias("content"))


def page_objects(contents: DataFrame, entries: Column | None = None, catalog: Column | None = None, deflate: bool = False) -> DataFrame:
    """Objects of documents whose pages have these contents: 1 catalog, 2 pages, 3 font, then two for each page.

    entries go into each page's dictionary; catalog, an aggregate, into the document's.
    """
    from quirel.functions.codecs import deflated
    from quirel.sources.writer import byte_text

    number = 4 + 2 * F.col("page")
    body = byte_text(deflated(F.encode(F.col("content"), "ISO-8859-1"))) if deflate else F.col("content")
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents "), (number + 1).cast("string"), F.lit(" 0 R "), entries if entries is not None else F.lit(""), F.lit(" >>"))
    pages = contents.select("doc_id", F.explode(F.array(F.struct(number.alias("obj_num"), page.alias("body")), F.struct((number + 1).alias("obj_num"), stream(body, "/Filter /FlateDecode" if deflate else "").alias("body")))).alias("o")).select("doc_id", "o.*")
    heads = contents.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("pages"), (catalog if catalog is not None else F.lit("")).alias("catalog"))
    kids = F.array_join(F.transform("pages", lambda p: F.concat((4 + 2 * p).cast("string"), F.lit(" 0 R"))), " ")
    first = F.array(
        F.struct(F.lit(1).alias("obj_num"), F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R "), F.col("catalog"), F.lit(" >>")).alias("body")),
        F.struct(F.lit(2).alias("obj_num"), F.concat(F.lit("<< /Type /Pages /MediaBox [0 0 612 792] /Resources << /Font << /F0 3 0 R >> >> /Count "), F.size("pages").cast("string"), F.lit(" /Kids ["), kids, F.lit("] >>")).alias("body")),
        F.struct(F.lit(3).alias("obj_num"), F.lit(FONT).alias("body")),
    )
    return pages.unionByName(heads.select("doc_id", F.explode(first).alias("o")).select("doc_id", "o.*"))


def text_documents(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """Objects of documents that show each line of a text by itself."""
    lines = numbered_lines(docs, per_page)
    shows = lines.select("doc_id", "page", F.col("line").alias("seq"), show(F.lit(60), 780 - 16 * (F.col("line") % per_page), F.col("text")).alias("op"))
    return page_objects(page_contents(shows), deflate=True)
