"""Tables to PDF bytes, with column functions only.

Bodies are strings in which a character is a byte (ISO 8859-1), so that offsets are lengths. A file is an
ordered concatenation of its objects; the cross-reference table is a running sum of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = "%PDF-1.7\n%âãÏÓ\n"


def byte_text(binary: Column) -> Column:
    return F.decode(binary, "ISO-8859-1")


def literal_string(text: Column) -> Column:
    """(text) with its brackets and backslashes escaped; characters beyond 255 become question marks."""
    latin = F.regexp_replace(text, r"[^\x00-\xff]", "?")
    return F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(latin, r"([()\\])", r"\\$1"), "\r", r"\\r"), F.lit(")"))


def text_string(text: Column) -> Column:
    """A text string in UTF-16 behind its mark, as hex."""
    return F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">"))


def name(text: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_"))


def stream(body: Column, entries: Column | str = "") -> Column:
    """A stream object's body; entries go into its dictionary besides the length."""
    entries = F.lit(entries) if isinstance(entries, str) else entries
    return F.concat(F.lit("<< /Length "), F.length(body).cast("string"), F.lit(" "), entries, F.lit(" >>\nstream\n"), body, F.lit("\nendstream"))


def assemble(objects: DataFrame, root: int = 1, extra: str = "", prefix: str | None = None) -> DataFrame:
    """(doc_id, content) of rows (doc_id, obj_num, body): one file for each doc_id.

    With prefix, a BINARY column of the rows, the objects are appended to it as a further revision,
    whose table points back at the prefix's own.
    """
    chunk = F.concat(F.col("obj_num").cast("string"), F.lit(" 0 obj\n"), F.col("body"), F.lit("\nendobj\n"))
    start = [F.first(prefix).alias("prefix")] if prefix else []
    # Offsets are a running sum over a file's objects, made where they lie before they are collected.
    rows = objects.withColumns({"_n": F.col("obj_num").cast("long"), "_t": chunk})
    before = Window.partitionBy("doc_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_t").cast("long")).over(before), F.lit(0).cast("long")))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_at").alias("at"), F.col("_t").alias("t")))).alias("parts"), *start)
    head = byte_text(F.col("prefix")) if prefix else F.lit(HEADER)
    begin = F.length(head).cast("long")
    places = F.transform("parts", lambda p: F.struct(p["n"].alias("n"), (begin + p["at"]).alias("at")))
    end = begin + F.element_at("parts", -1)["at"] + F.length(F.element_at("parts", -1)["t"])
    entry = lambda p: F.concat(p["n"].cast("string"), F.lit(" 1\n"), F.lpad(p["at"].cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    back = F.concat(F.lit(" /Prev "), F.regexp_extract(F.substring(head, -40, 40), r"startxref\s+(\d+)", 1)) if prefix else F.lit("")
    size = F.element_at("parts", -1)["n"] + 1
    docs = docs.withColumns({"places": places, "end": end})
    text = F.concat(
        head,
        F.array_join(F.transform("parts", lambda p: p["t"]), ""),
        F.lit("xref\n" if prefix else "xref\n0 1\n0000000000 65535 f \n"),
        F.array_join(F.transform("places", entry), ""),
        F.concat(F.lit(f"trailer\n<< /Root {root} 0 R {extra} /Size "), size.cast("string"), back, F.lit(" >>\nstartxref\n"), F.col("end").cast("string"), F.lit("\n%%EOF\n")),
    )
    return docs.select("doc_id", F.encode(text, "ISO-8859-1").alias("content"))


def assemble_packed(objects: DataFrame, root: int = 1) -> DataFrame:
    """(doc_id, content): as assemble(), but objects without streams are packed into one object stream, and the table is a stream too.

    The table's numbers are hexadecimal text behind a filter, so that it needs nothing but string functions.
    """
    rows = objects.select("doc_id", F.struct(F.col("obj_num").cast("long").alias("n"), F.col("body").alias("t"), F.col("body").contains("\nstream\n").alias("s")).alias("o"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("o")).alias("all"))
    docs = docs.select("doc_id", F.filter("all", lambda o: ~o["s"]).alias("small"), F.filter("all", lambda o: o["s"]).alias("large"), (F.element_at("all", -1)["n"] + 1).alias("pack"))
    prefix = lambda items, begin, length: F.aggregate(items, F.array(begin.cast("long")), lambda acc, o: F.concat(acc, F.array(F.element_at(acc, -1) + length(o))))
    docs = docs.withColumn("inner", prefix("small", F.lit(0), lambda o: F.length(o["t"]) + 1))
    heads = F.array_join(F.zip_with("small", F.slice("inner", F.lit(1), F.size("small")), lambda o, at: F.concat(o["n"].cast("string"), F.lit(" "), at.cast("string"))), " ")
    docs = docs.withColumn("heads", F.concat(heads, F.lit(" ")))
    packed = stream(F.concat("heads", F.array_join(F.transform("small", lambda o: o["t"]), "\n")), F.concat(F.lit("/Type /ObjStm /N "), F.size("small").cast("string"), F.lit(" /First "), F.length("heads").cast("string")))
    wrap = lambda n, t: F.concat(n.cast("string"), F.lit(" 0 obj\n"), t, F.lit("\nendobj\n"))
    docs = docs.withColumn("parts", F.concat(F.transform("large", lambda o: F.struct(o["n"].alias("n"), wrap(o["n"], o["t"]).alias("t"))), F.array(F.struct(F.col("pack").alias("n"), wrap(F.col("pack"), packed).alias("t")))))
    docs = docs.withColumn("sums", prefix("parts", F.lit(len(HEADER)), lambda o: F.length(o["t"])))
    field = lambda kind, a, b: F.concat(F.lit(kind), F.lpad(F.hex(a.cast("long")), 8, "0"), F.lpad(F.hex(b.cast("long")), 4, "0"))
    used = F.zip_with("parts", F.slice("sums", F.lit(1), F.size("parts")), lambda o, at: F.struct(o["n"].alias("n"), field("01", at, F.lit(0)).alias("e")))
    inside = F.transform("small", lambda o, i: F.struct(o["n"].alias("n"), field("02", F.col("pack"), i).alias("e")))
    table = F.array_sort(F.concat(used, inside, F.array(F.struct((F.col("pack") + 1).alias("n"), field("01", F.element_at("sums", -1), F.lit(0)).alias("e")))))
    docs = docs.withColumn("table", table)
    index = F.array_join(F.transform("table", lambda e: F.concat(e["n"].cast("string"), F.lit(" 1"))), " ")
    body = F.concat(F.array_join(F.transform("table", lambda e: e["e"]), ""), F.lit(">"))
    xref = stream(body, F.concat(F.lit(f"/Type /XRef /Root {root} 0 R /W [1 4 2] /Filter /ASCIIHexDecode /Index ["), index, F.lit("] /Size "), (F.col("pack") + 2).cast("string")))
    text = F.concat(F.lit(HEADER), F.array_join(F.transform("parts", lambda o: o["t"]), ""), wrap(F.col("pack") + 1, xref), F.lit("startxref\n"), F.element_at("sums", -1).cast("string"), F.lit("\n%%EOF\n"))
    return docs.select("doc_id", F.encode(text, "ISO-8859-1").alias("content"))


def write_pdf(files: DataFrame, folder: str) -> None:
    """Writes (doc_id, content) as files doc_id.pdf below a folder that executors share, one task per partition of rows.

    A file is written under another name and moved into place, so a task that runs twice leaves it whole.
    """

    def put(rows):
        import os

        for r in rows:
            path = os.path.join(folder, f"{r.doc_id}.pdf")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(r.content)
            os.replace(f"{path}.{os.getpid()}", path)

    import os

    os.makedirs(folder, exist_ok=True)
    files.select("doc_id", "content").foreachPartition(put)
