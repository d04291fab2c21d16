"""Named queries of the library and the SQL that gives the same rows.

Most make PDF files of a table's rows, read them back and are held against SQL over the table itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirel.functions import calculator, codecs, colour, crypto, samples, strings
from quirel.operators import catalogue as C
from quirel.operators import cidmaps as I
from quirel.operators import content as N
from quirel.operators import encryption as E
from quirel.operators import pages as P
from quirel.operators import reading as R
from quirel.operators import scene as S
from quirel.operators import shadings as G
from quirel.operators import text as T
from quirel.operators import typed as D
from quirel.operators import validity as V
from quirel.plans.stages import broadcast_by_measure, materialize, shared_folder, spread
from quirel.sources import format as Z
from quirel.sources import objects as O
from quirel.sources import synthesis as Y
from quirel.sources import trees as B
from quirel.sources import writer as W

FLAGSHIP = "text_roundtrip"
#: Embedded files of a document, and event ids that are numbered together.
FILES, EVENT_BLOCK = 1000, 65_536
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            broadcast_by_measure(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _objects(parts: DataFrame, extra: str = "") -> DataFrame:
    return materialize(O.read_objects(W.assemble(parts, extra=extra)))


def _rows(*pairs: tuple[Column, Column]) -> Column:
    """Objects of a row, to be exploded."""
    return F.explode(F.array(*[F.struct(n.cast("long").alias("obj_num"), b.alias("body")) for n, b in pairs])).alias("o")


def _text(n) -> Column:
    return n.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


LINES = """
lines AS (
  SELECT doc_id, i AS line, rtrim(string_split(text, chr(10))[i + 1]) AS t
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
kept AS (SELECT doc_id, line, line // 40 AS page, t FROM lines WHERE trim(t) <> '')"""


def _document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.runs(_objects(Y.text_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))))


@query(f"WITH {LINES} SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS lines, string_agg(t, chr(10) ORDER BY line) AS text FROM kept GROUP BY doc_id")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF with a line of text at a time, read back as text."""
    return T.document_texts(T.page_texts(T.run_lines(_document_runs(spark, sf_dir))))


@query(f"WITH {LINES}, ranked AS (SELECT doc_id, page, line, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, line) AS place FROM kept) SELECT doc_id, CAST(page AS BIGINT) AS page_index, CAST(place AS BIGINT) AS place, CAST(n AS BIGINT) AS n FROM ranked WHERE place <= 3")
def longest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest extracted lines of each document."""
    lines = T.run_lines(_document_runs(spark, sf_dir)).withColumn("n", F.length("text").cast("long"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "page_index", "line_seq"))
    return lines.withColumn("place", place.cast("long")).where("place <= 3").select("doc_id", F.col("page_index").cast("long").alias("page_index"), "place", "n")


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, 612e0 AS width, 792e0 AS height FROM (SELECT DISTINCT doc_id, i // 40 AS page FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) GROUP BY doc_id")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document, with the size that they inherit."""
    leaves = P.pages(_objects(Y.text_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return leaves.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("width").alias("width"), F.min("height").alias("height"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(300 + n_nationkey AS DOUBLE) AS width, 4e2 AS height, n_name || chr(10) || 'inline ' || n_name || chr(10) || 'form ' || n_name || chr(10) || 'below ' || n_name AS text FROM nation")
def foreign_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of other shapes: kids, box, contents and resources are references, a font stands inline, forms have names of their own; beside them files whose kids are no array."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name")
    line = lambda font, y, *parts: _cat(f"BT /{font} 10 Tf 50 {y} Td ", W.literal_string(_cat(*parts)), " Tj ET")
    bodies = {
        1: F.lit("<< /Type /Catalog /Pages 2 0 R >>"),
        2: F.lit("<< /Type /Pages /Kids 10 0 R /MediaBox 11 0 R /Count 1 >>"),
        3: F.lit("<< /Type /Page /Parent 2 0 R /Contents 12 0 R /Resources << /Font 13 0 R /XObject 14 0 R >> >>"),
        4: W.stream(line("F0", 360, F.col("n_name"))),
        5: W.stream(_cat(line("F1", 340, "inline ", F.col("n_name")), " q 1 0 0 1 0 -20 cm /X Do Q")),
        6: F.lit(Y.FONT),
        7: W.stream(_cat(line("G", 340, "form ", F.col("n_name")), " /Y Do"), "/Type /XObject /Subtype /Form /Resources 15 0 R"),
        8: W.stream(line("G", 320, "below ", F.col("n_name")), "/Type /XObject /Subtype /Form"),
        10: F.lit("[3 0 R]"),
        11: _cat("[0 0 ", _text(300 + F.col("doc_id")), " 400]"),
        12: F.lit("[4 0 R 5 0 R]"),
        13: F.lit(f"<< /F0 6 0 R /F1 {Y.FONT} >>"),
        14: F.lit("<< /X 7 0 R >>"),
        15: F.lit("<< /Font << /G 6 0 R >> /XObject << /Y 8 0 R >> >>"),
    }
    good = nation.select("doc_id", _rows(*[(F.lit(n), b) for n, b in bodies.items()])).select("doc_id", "o.*")
    broken = nation.select((1000 + F.col("doc_id")).alias("doc_id"), _rows((F.lit(1), bodies[1]), (F.lit(2), F.when(F.col("doc_id") % 2 == 0, "<< /Type /Pages /Kids 7 >>").otherwise("<< /Type /Pages /Kids 3 0 R >>")), (F.lit(3), F.lit("(no array)")))).select("doc_id", "o.*")
    objects = _objects(good.unionByName(broken))
    texts = T.document_texts(T.page_texts(T.run_lines(T.runs(objects))))
    return P.pages(objects).join(texts, "doc_id").select("doc_id", "width", "height", "text")


@query("""WITH named AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name || ' has the number ' || n_nationkey || ', side ' || k AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, k) - 1 AS i FROM nation, (SELECT unnest(range(2)) AS k))
SELECT doc_id, string_agg(t, chr(10) ORDER BY i % 2, i) || chr(10) || 'These are all names of one region, each of them on two sides' AS text FROM named GROUP BY doc_id""")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in two columns, painted from the last to the first by turns, with a foot line over both of them in between; read left, right, foot."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), "n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "n_name")
    lines = nation.withColumn("i", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n_nationkey", "k")) - 1).cast("int"))
    op = Y.show(F.when(F.col("i") % 2 == 0, 72).otherwise(331), 655 - 17 * F.floor(F.col("i") / 2), _cat(F.col("n_name"), " has the number ", _text(F.col("n_nationkey")), ", side ", _text(F.col("k"))))
    shows = lines.select("doc_id", F.lit(0).alias("page"), (-2 * F.col("i")).alias("seq"), op.alias("op"))
    foot = lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit(-5).alias("seq"), Y.show(F.lit(140), F.lit(388), F.lit("These are all names of one region, each of them on two sides")).alias("op"))
    return R.layout_text(T.runs(_objects(Y.page_objects(Y.page_contents(shows.unionByName(foot)))))).select("doc_id", "text")


@query("SELECT conv_id AS doc_id, string_agg(text_line, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, role || ' ' || turn AS text_line FROM conversations) GROUP BY conv_id")
def structure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations painted in another order than their tagged structure has."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat_ws(" ", "role", "turn").alias("t"))
    shown = turns.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("turn"))))
    op = _cat("/P << /MCID ", _text(F.col("turn")), " >> BDC ", Y.show(F.lit(60), 700 - 20 * F.col("seq"), F.col("t")), " EMC")
    contents = Y.page_contents(shown.select("doc_id", F.lit(0).alias("page"), "seq", op.alias("op")))
    kids = turns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("long"))).alias("k"))
    tree = kids.select("doc_id", F.lit(9000).cast("int").alias("obj_num"), _cat("<< /Type /StructTreeRoot /K << /S /Document /Pg 4 0 R /K [", F.array_join(F.transform("k", lambda k: _cat("<< /S /P /K ", k.cast("string"), " >>")), " "), "] >> >>").alias("body"))
    objects = _objects(Y.page_objects(contents, catalog=F.lit("/StructTreeRoot 9000 0 R")).unionByName(tree))
    places = C.structure_text(objects, T.runs(objects))
    return places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


@query("SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, o_orderpriority AS priority, CAST(2 AS BIGINT) AS keywords FROM orders")
def info_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as information dictionaries with dates, keywords and a key of their own."""
    orders = table(spark, sf_dir, "orders")
    info = _cat("<< /Title ", W.text_string(_cat("Order ", _text(F.col("o_orderkey")))), " /CreationDate ", W.literal_string(strings.iso_to_date(F.col("o_orderdate"))), " /Keywords (a, b ,) /Priority ", W.literal_string(F.col("o_orderpriority")), " >>")
    parts = orders.select(F.col("o_orderkey").alias("doc_id"), _rows((F.lit(1), F.lit("<< /Type /Catalog >>")), (F.lit(2), info))).select("doc_id", "o.*")
    return C.metadata(_objects(parts, extra="/Info 2 0 R")).select("doc_id", "title", "created_at", F.col("custom")["Priority"].alias("priority"), F.size("keywords").cast("long").alias("keywords"))


@query("SELECT o_orderkey AS doc_id, CAST(3 AS BIGINT) AS obj_num, o_orderstatus || '2' AS status, CAST(1 AS BIGINT) AS older FROM orders")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rewritten in a second revision: the newest object counts, one older entry is under it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    first = orders.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog /Status 3 0 R >>")), (F.lit(2), F.lit("null")), (F.lit(3), W.literal_string(F.col("o_orderstatus"))))).select("doc_id", "o.*")
    once = W.assemble(first)
    again = orders.join(once, "doc_id").select("doc_id", F.lit(3).cast("long").alias("obj_num"), W.literal_string(_cat(F.col("o_orderstatus"), "2")).alias("body"), "content")
    # Entries and objects come from one parse of a file.
    found = O.read_revised(W.assemble(again, prefix="content")).where("obj_num = 3 and older > 0")
    return found.select("doc_id", "obj_num", strings.variant_text(F.col("value"), "$").alias("status"), "older")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS page_index, CASE n_regionkey % 3 WHEN 0 THEN 'Part ' || (30 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHEN 1 THEN (['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'])[row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)] ELSE chr(CAST(64 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER)) END AS label FROM nation")
def page_label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region with a page per nation, labelled by a range that is joined as of its start."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), "n_name", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("page"))
    contents = nation.select("doc_id", "page", Y.show(F.lit(60), F.lit(700), F.col("n_name")).alias("content"))
    kind = F.max("doc_id") % 3
    style = F.when(kind == 0, "/S /D /P (Part ) /St 31").when(kind == 1, "/S /r").otherwise("/S /A")
    catalog = _cat("/PageLabels << /Kids [<< /Nums [0 << ", style, " >>] >>] >>")
    return C.page_labels(_objects(Y.page_objects(contents, catalog=catalog))).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "label")


@query("""WITH c AS (SELECT n_regionkey, n_name, c_name, c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (
  SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey, -1 AS custkey, n_name AS title, 0 AS depth FROM nation
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), n_nationkey, c_custkey, c_name, 1 FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n_nationkey, custkey) - 1 AS node_id, title, CAST(depth AS BIGINT) AS depth,
  CASE WHEN depth = 0 THEN count(*) OVER (PARTITION BY doc_id, n_nationkey) - 1 ELSE 0 END AS descendants FROM nodes""")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their customers as bookmarks of regions; a document holds one nation's customers of a range of keys, so that none grows with the table."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"), "n_name")
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").cast("long").alias("key"), "c_name").join(nation.select("nation"), "nation")
    people = people.withColumn("bucket", F.floor(F.col("key") / C.LEVEL_ITEMS))
    doc = (F.col("nation") * F.lit(1 << 32) + F.col("bucket")).alias("doc_id")
    parts = nation.join(people.select("nation", "bucket").distinct(), "nation", "left").withColumn("bucket", F.coalesce("bucket", F.lit(0)))
    none = F.lit(None).cast("string").alias("dest")
    tops = parts.select(doc, F.lit(1).cast("long").alias("item"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"), F.col("n_name").alias("title"), none, F.lit(True).alias("is_open"))
    leaf = people.select(doc, (2 + F.col("key") - F.col("bucket") * C.LEVEL_ITEMS).alias("item"), F.lit(1).cast("long").alias("parent"), F.col("key").alias("place"), F.col("c_name").alias("title"), none, F.lit(True).alias("is_open"))
    heads = parts.select(doc, F.lit(1).cast("long").alias("obj_num"), F.lit("<< /Type /Catalog /Outlines 2 0 R >>").alias("body"))
    nodes = materialize(C.outline(_objects(B.outline_objects(tops.unionByName(leaf), 2).unionByName(heads))))
    nodes = nodes.join(C.outline_descendants(nodes), ["doc_id", "node_id"])
    # Documents are few; their places in the region follow from their numbers of nodes. A nation's bookmark counts in its first one.
    held = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).join(parts.select("region", "nation", "bucket", doc), "doc_id")
    of_nation, in_region = Window.partitionBy("nation"), Window.partitionBy("region").orderBy("nation", "bucket")
    held = held.withColumns({"again": (F.col("bucket") > F.min("bucket").over(of_nation)).cast("long"), "people": F.sum(F.col("n") - 1).over(of_nation)})
    held = held.withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("again")).over(in_region.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("again"))
    found = nodes.join(held.select("doc_id", "region", "again", "people", "before"), "doc_id").where("depth > 0 or again = 0")
    return found.select(F.col("region").alias("doc_id"), (F.col("before") + F.col("node_id")).alias("node_id"), "title", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == 0, F.col("people")).otherwise(F.col("descendants")).alias("descendants"))


@query("SELECT page_id AS doc_id, CAST(0 AS BIGINT) AS seq, url AS uri, CAST(NULL AS VARCHAR) AS dest_name, CAST(-1 AS BIGINT) AS dest_page FROM pages UNION ALL SELECT page_id, 1, NULL, 'top', 0 FROM pages UNION ALL SELECT page_id, 2, NULL, 'nowhere', -1 FROM pages")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web address, a name that is known and one that isn't, as links of a page."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    contents = rows.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content"))
    extra = rows.select("doc_id", _rows((F.lit(100), _cat("<< /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI ", W.literal_string(F.col("url")), " >> >>")), (F.lit(101), F.lit("<< /Subtype /Link /Rect [0 0 9 9] /Dest (top) >>")), (F.lit(102), F.lit("<< /Subtype /Link /Rect [0 0 9 9] /A << /S /GoTo /D (nowhere) >> >>")), (F.lit(103), F.lit("<< /Subtype /Text /Rect [0 0 9 9] >>")))).select("doc_id", "o.*")
    entries, catalog = F.lit("/Annots [100 0 R 101 0 R 102 0 R 103 0 R]"), F.lit("/Names << /Dests << /Names [(top) [4 0 R /Fit]] >> >> /Dests << /top [4 0 R /FitB] >>")
    found = C.links(_objects(Y.page_objects(contents, entries, catalog).unionByName(extra.withColumn("obj_num", F.col("obj_num").cast("int")))))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), "uri", "dest_name", F.coalesce(F.col("dest_page").cast("long"), F.lit(-1)).alias("dest_page"))


@query("SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, 'event-' || event_id AS name, 'application/json' AS mime, props AS body, CAST(strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS VARCHAR) AS modified FROM events")
def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as embedded files, FILES at most in a document."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id", "props", "ts").withColumn("block", F.floor(F.col("event_id") / EVENT_BLOCK))
    # A user's events are numbered within blocks of ids, so that a hot user's are split over tasks.
    sizes = rows.groupBy("user", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("user").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    events = rows.withColumn("at", F.row_number().over(Window.partitionBy("user", "block").orderBy("event_id")) - 1).join(sizes.select("user", "block", before.alias("before")), ["user", "block"]).withColumn("place", F.col("at") + F.col("before"))
    doc = F.shiftleft(F.col("user").cast("long"), 20) + F.floor(F.col("place") / FILES)
    events = events.select(doc.alias("doc_id"), "event_id", "props", "ts", (F.col("place") % FILES + 1).alias("k"))
    rows = events.select("doc_id", F.encode(F.lpad(F.col("k").cast("string"), 8, "0"), "UTF-8").alias("key"), _cat("event-", _text(F.col("event_id"))).alias("name"), F.col("props").alias("data"), F.lit("application/json").alias("mime"), F.col("ts").alias("modified"), F.lit(None).cast("string").alias("description"))
    files, root = B.attachment_objects(rows, 10)
    heads = root.select("doc_id", F.lit(1).cast("long").alias("obj_num"), _cat("<< /Type /Catalog /Names << /EmbeddedFiles ", F.col("root"), " >> >>").alias("body"))
    seq = F.col("doc_id").bitwiseAND(F.lit((1 << 20) - 1)) * FILES + F.col("seq")
    return C.attachments(_objects(files.unionByName(heads))).select(F.shiftright("doc_id", 20).alias("doc_id"), seq.cast("long").alias("seq"), "name", "mime", F.col("bytes").cast("string").alias("body"), "modified")


@query("SELECT CAST(1 AS BIGINT) AS doc_id, n_name AS name, n_regionkey <> 2 AS visible FROM nation")
def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as layers; those of one region are off, some of which are also listed as on."""
    nation = table(spark, sf_dir, "nation").withColumn("doc_id", F.lit(1).cast("long"))
    groups = nation.select("doc_id", (10 + F.col("n_nationkey")).cast("long").alias("obj_num"), _cat("<< /Type /OCG /Name ", W.literal_string(F.col("n_name")), " >>").alias("body"))
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("n_nationkey")))), lambda n: _cat((10 + n).cast("string"), " 0 R")), " ")
    heads = nation.groupBy("doc_id").agg(listed(F.lit(True)).alias("every"), listed(F.col("n_regionkey") == 2).alias("off"), listed(F.col("n_nationkey") % 2 == 0).alias("on"))
    roots = heads.select("doc_id", _rows((F.lit(1), _cat("<< /Type /Catalog /OCProperties << /OCGs [", F.col("every"), "] /D << /ON [", F.col("on"), "] /OFF [", F.col("off"), "] >> >> >>")))).select("doc_id", "o.*")
    return C.layers(_objects(groups.unionByName(roots))).select("doc_id", "name", "visible")


@query("SELECT n_regionkey AS doc_id, policy AS member_id, CASE policy WHEN 'AllOn' THEN min(CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END) = 1 WHEN 'AnyOn' THEN max(CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END) = 1 WHEN 'AllOff' THEN max(CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END) = 0 ELSE min(CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END) = 0 END AS visible FROM nation, (SELECT unnest(['AllOn', 'AnyOn', 'AllOff', 'AnyOff']) AS policy) GROUP BY n_regionkey, policy")
def layer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four membership policies over each region's nations."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("obj_num"))
    members = nation.select("doc_id", "obj_num", F.explode(F.array(*[F.lit(p) for p in ("AllOn", "AnyOn", "AllOff", "AnyOff")])).alias("policy")).withColumn("member_id", F.col("policy"))
    return C.membership_visible(members, nation.withColumn("visible", F.col("obj_num") % 3 > 0))


@query("SELECT doc_id, md5(text) AS flate, md5(text) AS base85, md5(text) AS hexed, md5(text) AS runs, CAST(NULL AS VARCHAR) AS unknown FROM documents")
def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through encoders, and back through chains of filters; an unknown filter gives null."""
    data = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", data.alias("raw"))
    back = lambda c, *names: F.md5(codecs.decoded(c, F.array(*[F.lit(n) for n in names])))
    hexed = F.encode(F.concat(F.hex("raw"), F.lit(">")), "ISO-8859-1")
    return docs.select("doc_id", back(codecs.deflated("raw"), "FlateDecode").alias("flate"), back(codecs.encoded85(codecs.deflated("raw")), "ASCII85Decode", "Fl").alias("base85"), back(hexed, "AHx").alias("hexed"), back(codecs.run_lengths("raw"), "RunLengthDecode").alias("runs"), back(F.col("raw"), "DCTDecode").alias("unknown"))


@query("SELECT p_partkey AS doc_id, p_name AS rc4_text, p_name AS aes_text, p_name AS plain_text FROM part")
def decrypted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encrypted under keys of revisions 3 and 4, and decrypted by method."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.encode("p_name", "UTF-8").alias("raw"), F.encode(F.col("p_brand"), "UTF-8").alias("password"))
    key = crypto.file_key(F.col("password"), F.lit(bytes(range(32))), F.lit(-44), F.unhex(F.md5(_text(F.col("doc_id")).cast("binary"))), 3, 16)
    keyed = part.withColumn("key", key).withColumns({"k": crypto.object_key(F.col("key"), F.col("doc_id"), F.lit(0), False), "k_aes": crypto.object_key(F.col("key"), F.col("doc_id"), F.lit(0), True)})
    vector = F.unhex(F.md5("raw"))
    sealed = keyed.withColumns({"a": crypto.rc4("k", "raw"), "b": crypto.encrypt_aes(F.col("raw"), F.col("k_aes"), vector)})
    text = lambda data, identity, method, k: crypto.decrypt(F.col(data), F.lit(identity), F.lit(method), F.col(k)).cast("string")
    return sealed.select("doc_id", text("a", False, "V2", "k").alias("rc4_text"), text("b", False, "AESV2", "k_aes").alias("aes_text"), text("raw", True, "V2", "k").alias("plain_text"))


@query("SELECT p_partkey AS doc_id, CAST(floor((1 - least(0.1 + (p_size % 10) / 20e0, 1e0)) * 255 + 0.5) AS BIGINT) AS r, CAST(floor((1 - least((p_size % 7) / 8e0 + (p_size % 10) / 20e0, 1e0)) * 255 + 0.5) AS BIGINT) AS g, CAST(floor((1 - least(0.75 + (p_size % 10) / 20e0, 1e0)) * 255 + 0.5) AS BIGINT) AS b, 0.25 + ((p_size % 50) / 50e0) * ((p_size % 50) / 50e0) * 0.5 AS tint FROM part")
def ink_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes as inks, and as tints through an exponential function."""
    n = F.col("p_size")
    ink = colour.cmyk(F.lit(0.1), (n % 7) / 8.0, F.lit(0.75), (n % 10) / 20.0)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), ink.alias("c"), colour.exponential((n % 50) / 50.0, [0.25], [0.75], 2.0)[0].alias("tint"))
    return part.select("doc_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in "rgb"], "tint")


@query("SELECT l_orderkey, l_linenumber, round(2 * l_quantity + 3, 6) AS x, round(-l_discount * 4 + 1, 6) AS y, round(l_quantity, 6) AS back FROM lineitem")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a composed matrix and back through its inverse."""
    m = colour.compose(colour.matrix(2, 0, 0, 4, 0, 0), colour.matrix(1, 0, 0, -1, 3, 1))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", colour.apply(m, F.col("l_quantity"), F.col("l_discount")).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round(colour.apply(colour.invert(m), F.col("p.x"), F.col("p.y"))["x"], 6).alias("back"))


@query("SELECT l_suppkey AS doc_id, CAST((y - 1992) // 2 AS BIGINT) AS version, count(*) AS valid FROM (SELECT l_suppkey, extract(year FROM l_shipdate) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE y BETWEEN 1992 AND 1999 GROUP BY l_suppkey, (y - 1992) // 2")
def certificates_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments joined to the supplier's certificate version whose validity holds their date: a range join within an equi-join."""
    store = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("version"))
    store = store.withColumns({"low": F.make_date((1992 + 2 * F.col("version")).cast("int"), F.lit(1), F.lit(1)), "high": F.make_date((1993 + 2 * F.col("version")).cast("int"), F.lit(12), F.lit(31))})
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.to_date("l_shipdate").alias("day"))
    # Versions hold two years, and so do the buckets by which days meet them.
    found = V.in_force(sent, store, ["doc_id"], V.day_number(F.col("day")), V.day_number(F.col("low")), V.day_number(F.col("high")), 731)
    return found.groupBy("doc_id", "version").agg(F.count("*").alias("valid"))


@query("SELECT n_nationkey AS doc_id, 'error' AS severity, 'Count 7 over 2 pages' AS message FROM nation WHERE n_nationkey % 2 = 1")
def tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page trees whose stated count is wrong in every other document."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"))
    count = F.when(F.col("doc_id") % 2 == 1, "7").otherwise("2")
    parts = nation.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog /Pages 2 0 R >>")), (F.lit(2), _cat("<< /Type /Pages /MediaBox [0 0 9 9] /Kids [3 0 R 4 0 R] /Count ", count, " >>")), (F.lit(3), F.lit("<< /Type /Page /Parent 2 0 R >>")), (F.lit(4), F.lit("<< /Type /Page /Parent 2 0 R >>")))).select("doc_id", "o.*")
    return P.hierarchy_issues(_objects(parts)).select(F.col("doc_id").cast("int").alias("doc_id"), "severity", "message")


@query("SELECT c_custkey AS doc_id, c_name AS title, 'x|' || c_mktsegment AS subject, '2' AS part, 'PDF/A-2b' AS declared, false AS sound FROM customer")
def archive_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata packets with an archive claim that the catalogue doesn't bear out."""
    people = table(spark, sf_dir, "customer")
    packet = _cat("<x:xmpmeta><rdf:Description pdfaid:part='2' pdfaid:conformance='B'><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>", F.col("c_name"), "</rdf:li></rdf:Alt></dc:title><dc:subject><rdf:Bag><rdf:li>x</rdf:li><rdf:li>", F.col("c_mktsegment"), "</rdf:li></rdf:Bag></dc:subject></rdf:Description></x:xmpmeta>")
    parts = people.select(F.col("c_custkey").alias("doc_id"), _rows((F.lit(1), F.lit("<< /Type /Catalog /Metadata 2 0 R >>")), (F.lit(2), W.stream(packet, "/Type /Metadata /Subtype /XML")))).select("doc_id", "o.*")
    objects = _objects(parts)
    return C.xmp(objects).select("doc_id", "title", F.array_join("subject", "|").alias("subject"), "part").join(C.pdfa(objects).select("doc_id", "declared", "sound"), "doc_id")


@query("SELECT o_orderkey AS doc_id, repeat('M', CAST(o_orderkey // 1000 AS INTEGER)) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[CAST(o_orderkey // 100 % 10 + 1 AS INTEGER)] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[CAST(o_orderkey // 10 % 10 + 1 AS INTEGER)] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[CAST(o_orderkey % 10 + 1 AS INTEGER)] AS numeral, repeat(chr(CAST(97 + (o_orderkey % 100) % 26 AS INTEGER)), CAST((o_orderkey % 100) // 26 + 1 AS INTEGER)) AS letter FROM orders WHERE o_orderkey > 0")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers in Roman numerals and repeated letters."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).where("doc_id > 0").select("doc_id", strings.roman(n).alias("numeral"), strings.page_label(F.lit("a"), F.lit(None), n % 100 + 1).alias("letter"))


@query("SELECT p_partkey AS doc_id, 'an ' || replace(lower(p_name), ' ', '') || 'ending|then office' AS lines FROM part")
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names broken over hyphenated rows in chains, joined again; ligatures spelled out."""
    word = F.replace("p_name", F.lit(" "), F.lit("-\n"))
    rows = F.split(_cat("an ", F.lower(word), "-\nending\n\nthen oﬃce"), "\n")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(R.finished(rows), "|").alias("lines"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, 'aaa' || l_linenumber || 'cccc' AS signed, true AS matches FROM lineitem")
def signed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes on both sides of a signature, and their digest against a stated one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"))
    content = F.encode(_cat("aaa", _text(F.col("n")), "<sig>cccc"), "UTF-8")
    cut = 3 + F.length(_text(F.col("n")))
    rows = rows.withColumns({"content": content, "r": F.array(F.lit(0), cut, cut + 5, F.lit(4))})
    stated = F.unhex(F.sha2(_cat("aaa", _text(F.col("n")), "cccc"), 256))
    return rows.select("doc_id", "n", crypto.signed_bytes(F.col("content"), F.col("r")).cast("string").alias("signed"), crypto.digest_matches(F.col("content"), F.col("r"), stated).alias("matches"))


@query("""WITH shape(source_rank, source, depth, kind) AS (VALUES (0, 'open', 0, 'URI'), (0, 'open', 1, 'Named'), (0, 'open', 2, 'URI'), (2, 'page O', 0, 'Named'), (5, 'field', 0, 'JavaScript'), (6, 'field K', 0, 'URI'), (7, 'script', 0, 'JavaScript'), (7, 'script', 1, 'Named'))
SELECT r_regionkey AS doc_id, source_rank, source, CAST(depth AS BIGINT) AS depth, kind,
  CASE WHEN source_rank = 5 THEN 'one' WHEN source_rank = 7 AND depth = 0 THEN 'two' WHEN source_rank = 7 THEN 'LastPage' WHEN kind = 'URI' THEN 'http://' || r_name ELSE 'NextPage' END AS target FROM region CROSS JOIN shape""")
def action_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle of two actions at opening, which a page and a form field also have as their own, and scripts of a field and of a name."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), "r_name")
    contents = region.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content"))
    bodies = {
        50: _cat("<< /S /URI /URI ", W.literal_string(_cat("http://", F.col("r_name"))), " /Next 51 0 R >>"),
        51: F.lit("<< /S /Named /N /NextPage /Next [50 0 R] >>"),
        52: F.lit("<< /T (group) /Kids [53 0 R] >>"),
        53: F.lit("<< /T (child) /Parent 52 0 R /A << /S /JavaScript /JS (one) >> /AA << /K 50 0 R >> >>"),
        54: F.lit("<< /Names [(first) << /S /JavaScript /JS (two) /Next << /S /Named /N /LastPage >> >>] >>"),
    }
    extra = region.select("doc_id", _rows(*[(F.lit(n), b) for n, b in bodies.items()])).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body")
    catalog = F.lit("/OpenAction 50 0 R /AcroForm << /Fields [52 0 R] >> /Names << /JavaScript 54 0 R >>")
    found = C.actions(_objects(Y.page_objects(contents, F.lit("/AA << /O 51 0 R >>"), catalog).unionByName(extra)))
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), "source_rank", "source", F.col("depth").cast("long").alias("depth"), "kind", "target")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS bead_seq, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page_index, 'Story' AS title FROM nation")
def article_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of beads over a region's pages, one for each nation."""
    by = Window.partitionBy("doc_id")
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("page"))
    nation = nation.withColumn("n", F.count("*").over(by))
    contents = nation.select("doc_id", "page", F.lit("").alias("content"))
    beads = nation.select("doc_id", (500 + F.col("page")).alias("obj_num"), _cat("<< /R [0 0 9 9] /P ", _text(4 + 2 * F.col("page")), " 0 R /N ", _text(500 + (F.col("page") + 1) % F.col("n")), " 0 R >>").alias("body"))
    catalog = F.lit("/Threads [<< /F 500 0 R /I << /Title (Story) >> >>]")
    found = C.threads(_objects(Y.page_objects(contents, catalog=catalog).unionByName(beads.withColumn("obj_num", F.col("obj_num").cast("int")))))
    return found.select("doc_id", F.col("bead_seq").cast("long").alias("bead_seq"), F.col("page_index").cast("long").alias("page_index"), "title")


@query("SELECT c_custkey AS doc_id, c_name AS body, true AS opened, CAST(1 AS BIGINT) AS refused FROM customer")
def encrypted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams under 128-bit AES, opened with the empty password; with another one the document refuses."""
    people = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name"), "doc_id")
    owner, ident = F.lit(bytes(range(32))), F.unhex(F.md5(_text(F.col("doc_id")).cast("binary")))
    keyed = people.withColumns({"ident": ident}).withColumn("key", crypto.file_key(F.lit(b""), owner, F.lit(-44), F.col("ident"), 4, 16))
    user = crypto.user_entry_r3("key", "ident")
    sealed = crypto.encrypt_aes(F.encode("c_name", "UTF-8"), crypto.object_key(F.col("key"), F.lit(2), F.lit(0), True), F.unhex(F.md5("c_name")))
    made = materialize(keyed.select("doc_id", "ident", user.alias("u"), sealed.alias("sealed")))
    entry = _cat("<< /Filter /Standard /V 4 /R 4 /Length 128 /P -44 /O <", F.lit(bytes(range(32)).hex()), "> /U <", F.hex("u"), "00000000000000000000000000000000> /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF >>")
    parts = made.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog >>")), (F.lit(2), W.stream(W.byte_text(F.col("sealed")))), (F.lit(3), entry))).select("doc_id", "o.*")
    files = W.assemble(parts, extra="/Encrypt 3 0 R").join(made.select("doc_id", "ident"), "doc_id")
    # The identifier differs by file, so it is put into each trailer afterwards; nothing before it moves.
    content = F.encode(F.replace(W.byte_text(F.col("content")), F.lit("/Encrypt 3 0 R"), _cat("/Encrypt 3 0 R /ID [<", F.hex("ident"), "> <00>]")), "ISO-8859-1")
    objects = materialize(O.read_objects(spread(files.select("doc_id", content.alias("content")), "doc_id")))
    keys = materialize(E.file_keys(objects))
    body = E.unlocked(objects, keys=keys).where("obj_num = 2").select("doc_id", F.col("data").cast("string").alias("body"))
    opened = keys.select("doc_id", "opened")
    refused = E.unlocked(objects, b"other").where("error = 'wrong password' and obj_num = 2").groupBy("doc_id").agg(F.count("*").alias("refused"))
    return body.join(opened, "doc_id").join(refused, "doc_id")


@query("SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS node_id, CASE i WHEN 0 THEN '#ff0000' END AS fill, CASE i WHEN 1 THEN '#333333' END AS stroke, CASE i WHEN 0 THEN 5 ELSE 2 END AS steps, CASE i WHEN 0 THEN 2e0 * p_size ELSE CAST(p_size AS DOUBLE) END AS x FROM part, (SELECT unnest(range(2)) AS i)")
def painted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled rectangle under a matrix and a stroked line, for each part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")
    content = _cat("q 2 0 0 2 0 0 cm 1 0 0 rg ", _text(F.col("p_size")), " 0 10 10 re f Q 0.2 G ", _text(F.col("p_size")), " 1 m 5 5 l S 7 7 m n")
    nodes = S.scene_nodes(_objects(Y.page_objects(part.select("doc_id", F.lit(0).alias("page"), content.alias("content")))))
    first = F.get("path", 0)["p"]
    return nodes.select("doc_id", F.col("node_id").cast("long").alias("node_id"), "fill", "stroke", F.size("path").alias("steps"), (F.get("ctm", 0) * F.get(first, 0) + F.get("ctm", 2) * F.get(first, 1) + F.get("ctm", 4)).alias("x"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size > 25 THEN 1 - p_size / 50e0 ELSE round(p_size / 50e0 * (p_size / 50e0), 9) END AS y, 0e0 AS failed FROM part")
def calculated_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculator program with a branch, compiled to columns; one that fails gives zero."""
    x = F.col("p_size") / 50.0
    y = calculator.calculator("{ dup 0.5 gt { 1 exch sub } { dup mul 1 mul } ifelse }", [x], [0, 1], [0, 1])[0]
    failed = calculator.calculator("{ pop pop add }", [x], [0, 1], [0, 1])[0]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 25, y).otherwise(F.round(y, 9)).alias("y"), failed.alias("failed"))


@query("SELECT p_partkey AS doc_id, upper(hex(chr(CAST(65 + p_size AS INTEGER)))) AS grey, 'FF' AS alpha FROM part WHERE p_size < 60")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey image of one pixel for each part, through its object and back as pixels."""
    part = table(spark, sf_dir, "part").where("p_size < 60").select(F.col("p_partkey").alias("doc_id"), F.chr((65 + F.col("p_size")).cast("long")).alias("c"))
    parts = part.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog >>")), (F.lit(2), W.stream(F.col("c"), "/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray")))).select("doc_id", "o.*")
    pixels = C.images(_objects(parts)).select("doc_id", F.hex(samples.image_rgba("data", "width", "height", "bits", "color_space")).alias("p"))
    return pixels.select("doc_id", F.substring("p", 1, 2).alias("grey"), F.substring("p", 7, 2).alias("alpha"))


@query("SELECT p_partkey AS doc_id, p_name AS name, 'stream of ' || p_brand AS body FROM part")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose small objects are packed into a stream and whose table is a stream."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    parts = part.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog /Name 2 0 R >>")), (F.lit(2), W.literal_string(F.col("p_name"))), (F.lit(3), W.stream(_cat("stream of ", F.col("p_brand")))))).select("doc_id", "o.*")
    objects = materialize(O.read_objects(W.assemble_packed(parts)))
    names = objects.where("obj_num = 2").select("doc_id", strings.variant_text(F.col("value"), "$").alias("name"))
    return names.join(objects.where("obj_num = 3").select("doc_id", F.col("data").cast("string").alias("body")), "doc_id")


@query("SELECT n_nationkey AS doc_id, i AS seq, (['BMC', 'BDC', 'MP', 'EMC', 'EMC'])[i + 1] AS op, (['Outer', 'Span', 'Point', NULL, NULL])[i + 1] AS tag, (['1', '2', '2', '1', '0'])[i + 1] AS depth FROM nation, (SELECT unnest(range(5)) AS i)")
def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-content events of a page with their depth."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("page"), F.lit("/Outer BMC /Span << /MCID 3 >> BDC /Point MP EMC EMC").alias("content"))
    found = N.marked_content(_objects(Y.page_objects(nation)))
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "op", "tag", F.col("depth").cast("string").alias("depth"))


@query("SELECT n_nationkey AS doc_id, CAST(2 AS BIGINT) AS width, 'DeviceGray' AS color_space, upper(hex(chr(CAST(65 + n_nationkey AS INTEGER)) || 'z')) AS bytes FROM nation")
def inline_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images inside content streams, through a filter."""
    digits = F.hex(F.concat(F.chr((65 + F.col("n_nationkey")).cast("long")), F.lit("z")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("page"), _cat("q BI /W 2 /H 1 /BPC 8 /CS /G /F /AHx ID ", digits, ">\nEI Q").alias("content"))
    found = N.inline_images(_objects(Y.page_objects(nation)))
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("width").cast("long").alias("width"), "color_space", F.hex("data").alias("bytes"))


@query("SELECT c_custkey AS doc_id, CAST(2 AS BIGINT) AS curves, round(10e0 + c_nationkey, 6) AS end_x, CASE WHEN c_nationkey = 0 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) || '.5' END AS text FROM customer")
def arcs_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half turn as two curves, and numbers as the shortest text."""
    n = F.col("c_nationkey").cast("double")
    curves = colour.arc_cubics(F.lit(10.0), F.lit(0.0), n, n, F.lit(0.0), F.lit(3.141592653589793), F.lit(3.141592653589793))
    text = colour.number_text(F.when(n == 0, 0.0).otherwise(n + 0.5))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.size(curves).cast("long").alias("curves"), F.round(F.element_at(curves, -1)["end"]["x"], 6).alias("end_x"), text.alias("text"))


@query("SELECT CAST(1 AS BIGINT) AS doc_id, CAST(1000 + n_nationkey AS BIGINT) AS member_id, (n_nationkey % 3 > 0) <> ((n_nationkey + 1) % 3 > 0 AND n_nationkey < (SELECT max(n_nationkey) FROM nation)) AS visible FROM nation")
def layer_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships that hold where one of two layers is on and the other isn't; a layer behind the last one is unknown."""
    nation = table(spark, sf_dir, "nation").select(F.lit(1).cast("long").alias("doc_id"), F.col("n_nationkey").cast("long").alias("n"))
    a, b = _cat(_text(10 + F.col("n")), " 0 R"), _cat(_text(11 + F.col("n")), " 0 R")
    group = _cat("<< /Type /OCG /Name ", W.literal_string(_text(F.col("n"))), " >>")
    member = _cat("<< /Type /OCMD /VE [/Or [/And ", a, " [/Not ", b, "]] [/And [/Not ", a, "] ", b, "]] >>")
    rows = nation.select("doc_id", _rows((10 + F.col("n"), group), (1000 + F.col("n"), member))).select("doc_id", "o.*")
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("n")))), lambda n: _cat((10 + n).cast("string"), " 0 R")), " ")
    heads = nation.groupBy("doc_id").agg(listed(F.lit(True)).alias("every"), listed(F.col("n") % 3 == 0).alias("off"))
    roots = heads.select("doc_id", _rows((F.lit(1), _cat("<< /Type /Catalog /OCProperties << /OCGs [", F.col("every"), "] /D << /OFF [", F.col("off"), "] >> >> >>")))).select("doc_id", "o.*")
    objects = _objects(rows.unionByName(roots))
    return C.expression_visible(C.visibility_expressions(objects), C.layers(objects))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS name, CAST(0 AS BIGINT) AS dest_page, CASE WHEN n_nationkey % 2 = 0 THEN 'FitH' ELSE 'Fit' END AS dest_kind, CASE WHEN n_nationkey % 2 = 0 THEN 700e0 + n_nationkey END AS top FROM nation")
def named_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a tree and of an older dictionary; where both have one the tree's counts."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("n"), "n_name")
    newer = F.when(F.col("n") % 2 == 0, _cat(W.literal_string(F.col("n_name")), " [4 0 R /FitH ", _text(700 + F.col("n")), "]"))
    older = _cat(W.name(F.col("n_name")), " [4 0 R /Fit]")
    held = nation.select("doc_id", newer.alias("newer"), older.alias("older")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("newer")), " ").alias("newer"), F.array_join(F.array_sort(F.collect_list("older")), " ").alias("older"))
    contents = held.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content"), _cat("/Names << /Dests << /Names [", F.col("newer"), "] >> >> /Dests << ", F.col("older"), " >>").alias("dests"))
    found = C.named_destinations(_objects(Y.page_objects(contents, catalog=F.first("dests"))))
    return found.select("doc_id", "name", F.col("dest_page").cast("long").alias("dest_page"), "dest_kind", F.get("dest_args", F.lit(0)).alias("top"))


@query("SELECT p_partkey AS doc_id, p_name || ' & ' || p_type AS title, p_brand AS creator, p_type AS producer, p_brand || ',' || p_type AS subjects FROM part")
def packet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of metadata packets: list items, an attribute, a bag and escaped characters."""
    part = table(spark, sf_dir, "part")
    item = lambda c: _cat("<rdf:li>", c, "</rdf:li>")
    packet = _cat(
        '<rdf:Description pdf:Producer="', F.col("p_type"), '"><dc:title><rdf:Alt>', item(_cat(F.col("p_name"), " &amp; ", F.col("p_type"))), "</rdf:Alt></dc:title><dc:creator><rdf:Seq>", item(F.col("p_brand")),
        "</rdf:Seq></dc:creator><dc:subject><rdf:Bag>", item(F.col("p_brand")), item(F.col("p_type")), "</rdf:Bag></dc:subject></rdf:Description>",
    )
    rows = part.select(F.col("p_partkey").alias("doc_id"), _rows((F.lit(1), F.lit("<< /Type /Catalog /Metadata 2 0 R >>")), (F.lit(2), W.stream(packet, "/Type /Metadata /Subtype /XML")))).select("doc_id", "o.*")
    return C.xmp(_objects(rows)).select("doc_id", "title", "creator", "producer", F.array_join("subject", ",").alias("subjects"))


@query("SELECT p_partkey AS doc_id, 'Text' AS subtype, p_name AS contents, p_brand AS name, CAST(p_size AS BIGINT) AS flags, p_size + 0e0 AS wide, p_size % 2 = 0 AS down, array_to_string(list_sort(CASE WHEN p_size % 2 = 0 THEN ['Off', 'On', p_type] ELSE ['Off', 'On'] END), ',') AS states FROM part")
def note_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes, with the states that their appearances name."""
    part = table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    down = F.when(F.col("p_size") % 2 == 0, _cat(" /D << /On 5 0 R ", W.name(F.col("p_type")), " 5 0 R >>")).otherwise("")
    note = _cat("<< /Subtype /Text /Rect [0 0 ", _text(F.col("p_size")), " 9] /Contents ", W.text_string(F.col("p_name")), " /NM ", W.literal_string(F.col("p_brand")), " /F ", _text(F.col("p_size")), " /AP << /N << /On 5 0 R /Off 5 0 R >>", down, " >> >>")
    contents = part.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content"))
    notes = part.select("doc_id", F.lit(100).alias("obj_num"), note.alias("body"))
    found = C.annotations(_objects(Y.page_objects(contents, F.lit("/Annots [100 0 R]")).unionByName(notes)))
    return found.join(C.appearances(found), ["doc_id", "page_index", "seq"]).select("doc_id", "subtype", "contents", "name", "flags", F.element_at("rect", 3).alias("wide"), "down", F.array_join("states", ",").alias("states"))


@query("SELECT p_partkey AS doc_id, p_partkey * 7 AS start, CASE WHEN p_size % 2 = 0 THEN p_partkey + 1000 ELSE -1 END AS length, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE -1 END AS hint, CASE WHEN p_size % 2 = 0 THEN p_partkey + 2 ELSE -1 END AS pages FROM part")
def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files say that their last table begins, and what the linearized of them say in front."""
    number = F.col("p_partkey")
    front = F.when(F.col("p_size") % 2 == 0, _cat("/Linearized 1 /L ", _text(number + 1000), " /H [", _text(F.col("p_size")), " 20] /O 3 /E 9 /N ", _text(number + 2), " /T 5")).otherwise("/Type /Catalog")
    content = F.encode(_cat("%PDF-1.4\n1 0 obj\n<< ", front, " >>\nendobj\nstartxref\n1\n%%EOF\nstartxref\n", _text(number * 7), "\n%%EOF\n"), "ISO-8859-1")
    files = table(spark, sf_dir, "part").select(number.alias("doc_id"), content.alias("content"))
    found = files.select("doc_id", O.startxref("content").alias("start"), O.linearization("content").alias("lin"))
    return found.select("doc_id", "start", *[F.coalesce(c, F.lit(-1)).cast("long").alias(n) for n, c in (("length", F.col("lin.L")), ("hint", F.get("lin.H", F.lit(0))), ("pages", F.col("lin.N")))])


@query("SELECT p_partkey // 64 AS file, 10 + p_partkey % 64 AS obj_num, p_name AS name, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS even FROM part WHERE p_partkey % 64 >= 8")
def format_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as files of 64 and read back by the data source, with object numbers and types pushed down and streams left undecoded."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("doc_id"), (10 + F.col("p_partkey") % 64).alias("obj_num"), "p_name", "p_size")
    kind = F.when(F.col("p_size") % 2 == 0, "/Even").otherwise("/Odd")
    body = W.stream(F.repeat(F.lit("undecoded "), 20), _cat("/Filter /FlateDecode /Type ", kind, " /Name ", W.text_string(F.col("p_name"))))
    roots = part.select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("obj_num"), F.lit("<< /Type /Catalog >>").alias("body"))
    folder = shared_folder(spark, "format")
    Z.register(spark)
    W.assemble(part.select("doc_id", "obj_num", body.alias("body")).unionByName(roots)).write.format("pdf").mode("append").save(folder)
    found = Z.read(spark, folder, "path", "obj_num", "type", "json", "error").where("obj_num >= 18 and type in ('Even', 'Odd') and error is null")
    name = strings.variant_text(F.parse_json("json"), "$.Name")
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("file"), "obj_num", name.alias("name"), (F.col("type") == "Even").cast("long").alias("even"))


@query("""WITH c AS (SELECT CAST(n_regionkey * 4294967296 + c_custkey // 10000 AS BIGINT) AS doc_id, c_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
SELECT doc_id, c_name AS key, c_custkey AS value, CAST(CASE WHEN n <= 8 THEN 1 WHEN n <= 64 THEN 2 WHEN n <= 512 THEN 3 WHEN n <= 4096 THEN 4 ELSE 5 END AS BIGINT) AS visited FROM n
UNION ALL SELECT doc_id, '~' || c_name, -1, 1 FROM n""")
def name_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as balanced name trees of regions; each name is looked up going down by limits, and another that isn't there."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
    people = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")
    people = people.select((F.col("region") * F.lit(1 << 32) + F.floor(F.col("c_custkey") / 10_000)).alias("doc_id"), F.encode("c_name", "UTF-8").alias("key"), _text(F.col("c_custkey")).alias("value"))
    tree = materialize(B.name_tree(people, 10, fan=8))
    heads = B.root_refs(tree).select("doc_id", F.lit(1).cast("long").alias("obj_num"), _cat("<< /Type /Catalog /Names << /Dests ", F.col("root"), " >> >>").alias("body"))
    objects = _objects(tree.select("doc_id", "obj_num", "body").unionByName(heads))
    probes = people.select("doc_id", "key").unionByName(people.select("doc_id", F.concat(F.lit(b"~"), "key").alias("key")))
    found = C.tree_lookup(objects, C.from_catalog(objects, "Names.Dests"), probes)
    return found.select("doc_id", F.decode("key", "UTF-8").alias("key"), F.coalesce(F.try_variant_get("entry", "$", "long"), F.lit(-1)).alias("value"), "visited")


@query("""WITH c AS (SELECT CAST(n_regionkey * 4294967296 + c_custkey // 1000 AS BIGINT) AS doc_id, n_nationkey, n_name, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT doc_id, n_nationkey, n_name, count(*) AS held FROM c GROUP BY doc_id, n_nationkey, n_name)
SELECT doc_id, 'Region' AS title, CAST(0 AS BIGINT) AS depth, CAST(sum(1 + CASE WHEN n_nationkey % 2 = 0 THEN held ELSE 0 END) AS BIGINT) AS count, CAST(0 AS BIGINT) AS dest_page FROM n GROUP BY doc_id
UNION ALL SELECT doc_id, n_name, 1, CASE WHEN n_nationkey % 2 = 0 THEN held ELSE -held END, -1 FROM n
UNION ALL SELECT doc_id, c_name, 2, 0, -1 FROM c""")
def written_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as bookmarks of three levels, every other nation closed, with the counts that the writer makes from below."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"), "n_name")
    people = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("long")).join(F.broadcast(nation), "nation")
    people = people.withColumns({"doc_id": F.col("region") * F.lit(1 << 32) + F.floor(F.col("c_custkey") / 1000)})
    rows = lambda df, item, parent, place, title, is_open, dest=F.lit(None): df.select("doc_id", item.cast("long").alias("item"), parent.cast("long").alias("parent"), place.cast("long").alias("place"), title.alias("title"), dest.cast("string").alias("dest"), is_open.alias("is_open"))
    leaf = rows(people, 1000 + F.col("c_custkey") % 1000, 100 + F.col("nation"), F.col("c_custkey"), F.col("c_name"), F.lit(True))
    inner = rows(people.select("doc_id", "nation", "n_name").distinct(), 100 + F.col("nation"), F.lit(1), F.col("nation"), F.col("n_name"), F.col("nation") % 2 == 0)
    docs = people.select("doc_id").distinct()
    top = rows(docs, F.lit(1), F.lit(None), F.lit(0), F.lit("Region"), F.lit(True), F.lit("[4 0 R /Fit]"))
    pages = Y.page_objects(docs.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content")), catalog=F.lit("/Outlines 10 0 R"))
    found = C.outline(_objects(B.outline_objects(top.unionByName(inner).unionByName(leaf), 10).unionByName(pages.withColumn("obj_num", F.col("obj_num").cast("long")))))
    return found.select("doc_id", "title", F.col("depth").cast("long").alias("depth"), "count", F.coalesce(F.col("dest_page").cast("long"), F.lit(-1)).alias("dest_page"))


@query("""SELECT p_partkey AS doc_id, p_name AS title, p_brand AS author, 'x, ' || p_type AS keywords, '2020-01-02T03:04:05Z' AS created_at, 'http://parts/' || p_partkey AS uri, p_type || ' ü' AS contents, p_size + 0e0 AS wide FROM part""")
def written_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' information, a link and a note by the writers, read back."""
    part = table(spark, sf_dir, "part").withColumns({"doc_id": F.col("p_partkey"), "at": F.to_timestamp(F.lit("2020-01-02 03:04:05"))})
    rect = F.array(F.lit(0), F.lit(0), F.col("p_size"), F.lit(9))
    info = B.info_body(title=F.col("p_name"), author=F.col("p_brand"), keywords=F.array(F.lit("x"), F.col("p_type")), created=F.col("at"), subject=F.lit(None).cast("string"))
    extra = part.select("doc_id", _rows((F.lit(100), B.link_body(rect, uri=_cat("http://parts/", _text(F.col("p_partkey"))))), (F.lit(101), B.note_body(rect, _cat(F.col("p_type"), " ü"), modified=F.col("at"), key=F.col("p_brand"))), (F.lit(102), info))).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body")
    pages = Y.page_objects(part.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content")), F.lit("/Annots [100 0 R 101 0 R]"))
    objects = _objects(pages.unionByName(extra), extra="/Info 102 0 R")
    about = C.metadata(objects).select("doc_id", "title", "author", F.array_join("keywords", ", ").alias("keywords"), "created_at")
    notes = C.annotations(objects).where("subtype = 'Text'").select("doc_id", "contents", F.element_at("rect", 3).alias("wide"))
    return about.join(C.links(objects).select("doc_id", "uri"), "doc_id").join(notes, "doc_id")


@query("""WITH codes AS (SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS place, CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END AS width,
    CASE i WHEN 0 THEN 32 + p_size WHEN 1 THEN 33088 + p_size WHEN 2 THEN 65 WHEN 3 THEN 57664 + p_size WHEN 4 THEN 127 ELSE 41280 END AS code FROM part, (SELECT unnest(range(6)) AS i)),
cids AS (SELECT doc_id, place, CAST(width AS BIGINT) AS width, CAST(code AS BIGINT) AS code, CAST(CASE place WHEN 0 THEN CASE WHEN code = 65 THEN 900 ELSE code END WHEN 1 THEN 1000 + code - 33088 WHEN 2 THEN 900 WHEN 3 THEN 7 WHEN 4 THEN 0 ELSE 1256 END AS BIGINT) AS cid FROM codes)
SELECT doc_id, place, width, code, cid, round(sum(CASE WHEN cid >= 1000 THEN 1e0 WHEN cid = 900 THEN 0.25 ELSE 0.5 END) OVER (PARTITION BY doc_id) * 10, 4) AS advance FROM cids""")
def mixed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of one- and two-byte codes under a map that builds on another: their identifiers by an interval join, and the width that a page's walk gives them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("long").alias("n"))
    own = "1 begincodespacerange <00> <7E> endcodespacerange 1 begincidchar <41> 900 endcidchar 1 beginnotdefrange <E100> <E1FF> 7 endnotdefrange"
    # <7F> lies in no code space; identifiers of the second range go on by number, though trail bytes below 40 have none.
    base = "2 begincodespacerange <8140> <9FFE> <A040> <E1FE> endcodespacerange % a remark <00>\n2 begincidrange <8140> <81FE> 1000 <A040> <A1FE> 1000 endcidrange 1 begincidrange <20> <7E> 32 endcidrange"
    code = lambda n, width: F.lpad(F.hex(n), 2 * width, "0")
    shown = _cat(code(32 + F.col("n"), 1), code(33088 + F.col("n"), 2), "41", code(57664 + F.col("n"), 2), "7F", "A140")
    bodies = {
        20: W.stream(F.lit(own), "/Type /CMap /CMapName /Own /UseCMap 21 0 R"),
        21: W.stream(F.lit(base), "/Type /CMap /CMapName /Base"),
        22: F.lit("<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding 20 0 R /DescendantFonts [23 0 R] >>"),
        23: F.lit("<< /Type /Font /Subtype /CIDFontType0 /BaseFont /F /DW 500 /W [900 [250] 1000 1300 1000] >>"),
    }
    extra = part.select("doc_id", _rows(*[(F.lit(n), b) for n, b in bodies.items()])).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body")
    pages = Y.page_objects(part.select("doc_id", F.lit(0).alias("page"), _cat("BT /G 10 Tf 50 50 Td <", shown, "> Tj ET").alias("content")), F.lit("/Resources << /Font << /G 22 0 R >> >>"))
    objects = _objects(pages.unionByName(extra))
    ranges = materialize(I.resolved_ranges(objects)).where("cmap = 20")
    strings_ = part.select("doc_id", F.lit(20).cast("long").alias("cmap"), F.lit(0).cast("long").alias("key"), F.unhex(shown).alias("data"))
    cids = I.code_cids(I.split_codes(strings_, ranges), ranges)
    wide = T.runs(objects).select("doc_id", F.round("adv_x", 4).cast("double").alias("advance"))
    return cids.join(wide, "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("place", "width", "code", "cid")], F.round("advance", 4).alias("advance"))


def _page_file(rows: DataFrame, content: Column, fonts: str = "", extra: tuple = ()) -> DataFrame:
    """Objects of documents of one page with this content."""
    made = Y.page_objects(rows.select("doc_id", F.lit(0).alias("page"), content.alias("content")), F.lit(fonts))
    more = rows.select("doc_id", _rows(*extra)).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body") if extra else None
    return _objects(made.unionByName(more) if extra else made)


@query("SELECT p_partkey AS doc_id, p_name AS tracked, replace(p_name, ' ', '') AS glued, p_name AS single FROM part")
def tracked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names laid down glyph by glyph: a spaced-out line keeps its words, one whose only gaps are as wide as those between letters has none, and one without spacing has its words."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", "").alias("c"))
    part = part.withColumn("c", F.filter("c", lambda x: x != ""))

    def glyphs(step, blank, y):
        # Widths are half an em, so a step of 5 at size 10 is no gap. Each glyph is a show at a place of its own.
        at = F.transform("c", lambda ch, i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(50.0), lambda x, k: x + F.when(k == " ", blank).otherwise(step)))
        shows = F.zip_with("c", at, lambda ch, x: F.when(ch != " ", _cat("BT /F0 10 Tf ", x.cast("string"), f" {y} Td ", W.literal_string(ch), " Tj ET")))
        return F.array_join(F.array_compact(shows), " ")

    content = _cat(glyphs(7.0, 7.0, 700), " ", glyphs(7.0, 0.0, 600), " ", glyphs(5.0, 5.0, 500))
    lines = T.run_lines(T.runs(_page_file(part, content)))
    at = lambda y: F.max(F.when(F.round("y") == y, F.col("text")))
    return lines.groupBy("doc_id").agg(at(700).alias("tracked"), at(600).alias("glued"), at(500).alias("single"))


@query("SELECT p_partkey AS doc_id, 'before ' || p_name || ' after' AS text, CAST(3 AS BIGINT) AS runs, 10e0 * length(p_brand) AS wide FROM part")
def replaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with a text of their own: the first show takes it, the second only moves its end; an inner span without one changes nothing."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    shown = W.literal_string(F.col("p_brand"))
    content = _cat("BT /F0 10 Tf 50 700 Td (before) Tj ET /Span << /ActualText ", W.text_string(F.col("p_name")), " >> BDC BT /F0 10 Tf 90 700 Td ", shown, " Tj /Span << /MCID 3 >> BDC ", shown, " Tj EMC ET EMC BT /F0 10 Tf ", _text(95 + 10 * F.length("p_brand")), " 700 Td (after) Tj ET")
    found = materialize(T.runs(_page_file(part, content)))
    wide = found.groupBy("doc_id").agg(F.count("*").alias("runs"), F.max(F.when(F.col("run_seq") == 1, F.round("adv_x", 3).cast("double"))).alias("wide"))
    return T.run_lines(found).select("doc_id", "text").join(wide, "doc_id")


@query("SELECT p_partkey AS doc_id, 'level ' || p_name || chr(10) || 'second line of it' || chr(10) || 'up ' || p_brand || chr(10) || 'next up' || chr(10) || 'mirrored' AS text FROM part")
def turned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, upright and mirrored text on a page, painted in turns; each direction is read by itself, that with most text first."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    show = lambda matrix, *t: _cat(f"BT /F0 10 Tf {matrix} Tm ", W.literal_string(_cat(*t)), " Tj ET ")
    content = _cat(show("0 1 -1 0 320 300", "next up"), show("1 0 0 1 50 680", "second line of it"), show("-1 0 0 1 500 100", "mirrored"), show("0 1 -1 0 300 300", "up ", F.col("p_brand")), show("1 0 0 1 50 700", "level ", F.col("p_name")))
    return R.layout_text(T.runs(_page_file(part, content))).select("doc_id", "text")


@query("SELECT p_partkey AS doc_id, 'fünf café Ångström ' || p_brand AS text, '¨ apart' AS lone FROM part")
def accented_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents as glyphs of their own with the letter backed up under them; one that stands apart stays."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand")
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /Acc /FirstChar 32 /LastChar 126 /Widths [" + " ".join(["400"] * 95) + "] /Encoding << /Differences [33 /dieresis /acute /ring] >> >>"
    line = lambda y, text: _cat(f"BT /G 10 Tf 50 {y} Td ", text, " TJ ET ")
    parts, x = [], 50.0
    # An accent, then the letter 3 units back (its accent is 4 wide), then the rest.
    for text in ("f", "!", "unf caf", '"', "e ", "#", "Angstr", "!", "om "):
        back = 3.0 if parts and parts[-1][1] in ("!", '"', "#") else 0.0
        parts.append((x - back, text))
        x += 4.0 * len(text) - back
    shows = " ".join(f"BT /G 10 Tf {at:g} 700 Td ({text}) Tj ET" for at, text in parts)
    content = _cat(shows, f" BT /G 10 Tf {x:g} 700 Td ", W.literal_string(F.col("p_brand").substr(F.lit(1), F.lit(40))), " Tj ET ", "BT /G 10 Tf 50 600 Td (!) Tj ET BT /G 10 Tf 60 600 Td (apart) Tj ET")
    # The brand's own hash sign is a ring in this font.
    lines = T.run_lines(T.runs(_page_file(part, content, "/Resources << /Font << /G 20 0 R >> >>", ((F.lit(20), F.lit(font)),))))
    at = lambda y: F.max(F.when(F.round("y") == y, F.col("text")))
    return lines.groupBy("doc_id").agg(F.replace(at(700), F.lit("˚"), F.lit("#")).alias("text"), at(600).alias("lone"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 3 THEN 'locked' ELSE c_name END AS body, CASE WHEN c_custkey % 4 = 3 THEN 'crypt filter: AESV9' ELSE 'none' END AS error, c_mktsegment AS title, c_name || ' plain' AS aside FROM customer")
def crypt_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose streams and strings have filters of their own: AES, none, RC4 and one that nobody knows; a further stream names Identity itself."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment", (F.col("c_custkey") % 4).alias("kind"))
    people = spread(people, "doc_id")
    owner, ident = F.lit(bytes(range(32))), F.unhex(F.md5(_text(F.col("doc_id")).cast("binary")))
    keyed = people.withColumn("ident", ident).withColumn("key", crypto.file_key(F.lit(b""), owner, F.lit(-44), F.col("ident"), 4, 16))
    own = lambda n, aes: crypto.object_key(F.col("key"), F.lit(n), F.lit(0), aes)
    vector, name_, title = F.unhex(F.md5("c_name")), F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    body = F.when(F.col("kind") == 0, crypto.encrypt_aes(name_, own(2, True), vector)).when(F.col("kind") == 1, name_).when(F.col("kind") == 2, crypto.rc4(own(2, False), name_)).otherwise(F.lit(b"locked"))
    sealed = F.when(F.col("kind") % 2 == 0, crypto.encrypt_aes(title, own(4, True), vector)).otherwise(crypto.rc4(own(4, False), title))
    made = materialize(keyed.select("doc_id", "c_name", "kind", "ident", crypto.user_entry_r3("key", "ident").alias("u"), body.alias("body"), sealed.alias("title")))
    by_kind = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("kind") + 1).cast("int"))
    filters = "/CF << /Aes << /CFM /AESV2 >> /Rc << /CFM /V2 >> /Odd << /CFM /AESV9 >> >>"
    entry = _cat("<< /Filter /Standard /V 4 /R 4 /Length 128 /P -44 /O <", F.lit(bytes(range(32)).hex()), "> /U <", F.hex("u"), f"00000000000000000000000000000000> {filters} /StmF /", by_kind("Aes", "Identity", "Rc", "Odd"), " /StrF /", by_kind("Aes", "Rc", "Aes", "Rc"), " >>")
    aside = W.stream(_cat(F.col("c_name"), " plain"), "/Filter /Crypt /DecodeParms << /Name /Identity >>")
    parts = made.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog >>")), (F.lit(2), W.stream(W.byte_text(F.col("body")))), (F.lit(3), entry), (F.lit(4), _cat("<< /Title <", F.hex("title"), "> >>")), (F.lit(5), aside))).select("doc_id", "o.*")
    files = W.assemble(parts, extra="/Encrypt 3 0 R").join(made.select("doc_id", "ident"), "doc_id")
    content = F.encode(F.replace(W.byte_text(F.col("content")), F.lit("/Encrypt 3 0 R"), _cat("/Encrypt 3 0 R /ID [<", F.hex("ident"), "> <00>]")), "ISO-8859-1")
    found = E.unlocked(materialize(O.read_objects(spread(files.select("doc_id", content.alias("content")), "doc_id"))))
    at = lambda n, c: F.max(F.when(F.col("obj_num") == n, c))
    text = F.col("data").cast("string")
    return found.groupBy("doc_id").agg(at(2, text).alias("body"), F.coalesce(at(2, F.col("error")), F.lit("none")).alias("error"), at(4, strings.variant_text(F.col("value"), "$.Title")).alias("title"), at(5, text).alias("aside"))


@query("""WITH shape(node_id, level, fill, stroke, scale, shift, x0) AS (VALUES (0, 0, '#ff0000', NULL, 0, 0, 0), (1, 1, '#ff0000', NULL, 2, 10, 0), (2, 2, '#ff0000', '#0000ff', 2, 10, 3), (3, 1, NULL, '#0000ff', 2, 10, 0),
  (4, 1, '#00ff00', NULL, 1, 0, 0), (5, 2, '#00ff00', '#0000ff', 1, 0, 3), (6, 1, NULL, '#0000ff', 1, 0, 0), (7, 0, NULL, '#000000', 0, 1, 0), (8, 1, '#808080', NULL, 0, 114, 0))
SELECT p_partkey AS doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(level AS BIGINT) AS level, fill, stroke, CAST(scale * (x0 + p_size) + shift AS DOUBLE) AS x FROM part, shape""")
def spliced_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form painted twice with another inside that tries to paint itself, colours inherited, and a turned appearance fitted into its annotation."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")
    content = F.lit("1 0 0 rg 0 0 5 5 re f q 2 0 0 2 10 0 cm /X Do Q 0 1 0 rg /X Do 1 1 m 2 2 l S /Gone Do")
    bodies = (
        (F.lit(30), W.stream(F.lit("0 0 1 1 re f 0 0 1 RG /Y Do 0 0 m 9 9 l S"), _cat("/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 ", _text(F.col("p_size")), " 0] /Resources << /XObject << /Y 31 0 R >> >>"))),
        (F.lit(31), W.stream(F.lit("3 0 1 1 re B /Y Do"), "/Type /XObject /Subtype /Form /BBox [0 0 9 9]")),
        (F.lit(32), W.stream(F.lit("0.5 g 2 3 m 4 4 l f"), "/Subtype /Form /BBox [0 0 10 10] /Matrix [0 1 -1 0 0 0]")),
        (F.lit(40), F.lit("<< /Subtype /Stamp /Rect [120 110 100 100] /AS /On /AP << /N << /On 32 0 R /Off 31 0 R >> >> >>")),
        (F.lit(41), F.lit("<< /Subtype /Stamp /F 2 /Rect [0 0 9 9] /AP << /N 32 0 R >> >>")),
    )
    nodes = S.spliced_nodes(_page_file(part, content, "/Annots [40 0 R 41 0 R] /Resources << /XObject << /X 30 0 R >> >>", bodies))
    first = F.get("path", 0)["p"]
    x = F.get("ctm", 0) * F.get(first, 0) + F.get("ctm", 2) * F.get(first, 1) + F.get("ctm", 4)
    return nodes.select("doc_id", F.col("node_id").cast("long").alias("node_id"), F.col("level").cast("long").alias("level"), "fill", "stroke", F.round(x, 6).alias("x"))


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS back FROM nation)
SELECT doc_id, CAST(0 AS BIGINT) AS config, name, true AS before, n_nationkey % 2 = 0 AS visible FROM n
UNION ALL SELECT doc_id, 1, name, n_nationkey % 3 = 0 AS before, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey % 3 = 0 ELSE back = (SELECT min(m.back) FROM n m WHERE m.doc_id = n.doc_id AND m.n_nationkey % 5 > 0) END FROM n""")
def layer_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as layers under two configurations: in the first, odd ones are turned off; in the second, a radio group, each is turned on in turn, but for locked ones."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").cast("long").alias("n"), "n_name")
    groups = nation.select("doc_id", (10 + F.col("n")).alias("obj_num"), _cat("<< /Type /OCG /Name ", W.literal_string(F.col("n_name")), " >>").alias("body"))
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("n")))), lambda n: _cat((10 + n).cast("string"), " 0 R")), " ")
    heads = nation.groupBy("doc_id").agg(listed(F.lit(True)).alias("every"), listed(F.col("n") % 3 == 0).alias("third"), listed(F.col("n") % 5 == 0).alias("fifth"), listed(F.col("n") % 5 > 0).alias("radio"))
    other = _cat("<< /Name (Other) /BaseState /OFF /ON [", F.col("third"), "] /Locked [", F.col("fifth"), "] /RBGroups [[", F.col("radio"), "]] >>")
    roots = heads.select("doc_id", _rows((F.lit(1), _cat("<< /Type /Catalog /OCProperties << /OCGs [", F.col("every"), "] /D << /Name (First) >> /Configs [2 0 R] >> >>")), (F.lit(2), other))).select("doc_id", "o.*")
    objects = _objects(groups.unionByName(roots))
    configurations = materialize(C.layer_configurations(objects))
    states = materialize(C.layers_by_configuration(objects, configurations))
    odd = nation.where("n % 2 = 1").select("doc_id", F.lit(0).alias("config"), F.col("n").alias("seq"), (10 + F.col("n")).alias("obj_num"), F.lit(False).alias("on"))
    on = nation.select("doc_id", F.lit(1).alias("config"), F.col("n").alias("seq"), (10 + F.col("n")).alias("obj_num"), F.lit(True).alias("on"))
    after = C.switched_layers(states, configurations, odd.unionByName(on)).select("doc_id", "config", "name", "visible")
    before = states.select("doc_id", "config", "name", F.col("visible").alias("before"))
    return before.join(after, ["doc_id", "config", "name"]).withColumn("config", F.col("config").cast("long"))


@query("""WITH s AS (SELECT p_partkey AS doc_id, p_size / 100e0 AS a, CAST(unnest(range(5)) AS INTEGER) AS k FROM part)
SELECT doc_id, 'axial' AS kind, CAST(k AS BIGINT) AS k, lower(printf('#%02x%02x%02x', CAST(floor(k / 4e0 * 255 + 0.5) AS INTEGER), CAST(floor((a + k / 4e0 * (0 - a)) * 255 + 0.5) AS INTEGER), CAST(0 AS INTEGER))) AS colour FROM s
UNION ALL SELECT doc_id, 'radial', k, lower(printf('#%02x%02x%02x', v, v, v)) FROM (SELECT doc_id, k, CAST(floor(CASE WHEN k < 2 THEN a * (k / 2e0) * (k / 2e0) ELSE a + (1 - a) * (1 - (k - 2) / 2e0) END * 255 + 0.5) AS INTEGER) AS v FROM s) t""")
def gradient_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axial gradient of three functions, a component each, and a radial one inside a pattern of two stitched functions, the second turned round."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _text(F.col("p_size") / 100.0).alias("a"))
    of = lambda c0, c1, n="1": _cat("<< /FunctionType 2 /Domain [0 1] /N ", n, " /C0 [", c0, "] /C1 [", c1, "] >>")
    axial = _cat("<< /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 1] /Function [", of("0", "1"), " 5 0 R ", of("0", "0"), "] >>")
    stitched = _cat("<< /FunctionType 3 /Domain [0 1] /Bounds [0.5] /Encode [0 1 1 0] /Functions [", of("0", F.col("a"), "2"), " 6 0 R] >>")
    radial = _cat("<< /PatternType 2 /Shading << /ShadingType 3 /ColorSpace /DeviceGray /Coords [0 0 0 1 1 9] /Extend [true false] /Function ", stitched, " >> >>")
    rows = part.select("doc_id", _rows((F.lit(1), F.lit("<< /Type /Catalog >>")), (F.lit(3), axial), (F.lit(4), radial), (F.lit(5), of(F.col("a"), "0")), (F.lit(6), of(F.col("a"), "1")))).select("doc_id", "o.*")
    found = G.gradients(_objects(rows), 5)
    return found.select("doc_id", "kind", F.posexplode("stops").alias("k", "colour")).withColumn("k", F.col("k").cast("long"))


@query("""WITH q AS (SELECT p_partkey AS doc_id, p_size / 50e0 AS x, (p_size % 7) / 7e0 AS y FROM part)
SELECT doc_id, round(x * (1 - y) + y * (1 - x), 6) AS mixed, round(x, 6) AS first, round(2 * x - 1, 6) AS line FROM q""")
def sampled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions given by samples: two inputs and outputs, linear between four corners, and a cubic over evenly spaced samples of a line."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_size") % 7) / 7.0).alias("y"))
    numbers = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    # Corners (0, 0), (1, 0), (0, 1), (1, 1), with two outputs each.
    corners = colour.sampled_nd([F.col("x"), F.col("y")], numbers(0, 0, 1, 1, 1, 0, 0, 1), [2, 2], [(0, 1), (0, 1)], [(0, 1), (0, 1)])
    # The line goes on behind both ends of the domain, so that the cubic has all of its samples.
    line = colour.sampled_nd([F.col("x")], numbers(0, 0.25, 0.5, 0.75, 1), [5], [(-0.5, 1.5)], [(-2, 2)], decode=[(-2, 2)], order=3)
    return part.select("doc_id", F.round(corners[0], 6).alias("mixed"), F.round(corners[1], 6).alias("first"), F.round(line[0], 6).alias("line"))


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'second tagged' || chr(10) || p_name ELSE p_name || chr(10) || 'second tagged' END AS text FROM part""")
def partly_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are read by their structure tree, ones whose tree holds too little of them, and ones without a tree, which are read by geometry."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", (F.col("p_partkey") % 3).alias("kind"))
    # The tree's order is another one than that on the page; in the second kind it holds the shorter part alone.
    content = _cat("/P << /MCID 0 >> BDC BT /F0 10 Tf 50 700 Td ", W.literal_string(F.col("p_name")), " Tj ET EMC ", F.when(F.col("kind") == 0, "/P << /MCID 1 >> BDC BT /F0 10 Tf 50 600 Td (second tagged) Tj ET EMC").otherwise("BT /F0 10 Tf 50 600 Td (second tagged) Tj ET"))
    pages = Y.page_objects(part.select("doc_id", F.lit(0).alias("page"), content.alias("content"), F.when(F.col("kind") < 2, "/StructTreeRoot 9 0 R").otherwise("").alias("tree")), catalog=F.first("tree"))
    kids = F.when(F.col("kind") == 0, "1 0").otherwise("")
    tree = part.select("doc_id", F.lit(9).alias("obj_num"), _cat("<< /Type /StructTreeRoot /K << /S /P /Pg 4 0 R /K [", kids, "] >> >>").alias("body"))
    objects = _objects(pages.unionByName(tree))
    places = C.structure_text(objects, materialize(T.runs(objects)))
    return places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


@query("""WITH n AS (SELECT p_partkey AS doc_id, p_size, p_name, p_brand, unnest(['note', 'markup', 'widget', 'line', 'ink']) AS family FROM part)
SELECT doc_id, family, CASE WHEN family = 'widget' THEN 'part.name' WHEN family = 'note' THEN p_brand END AS named, CASE WHEN family = 'widget' THEN p_name WHEN family = 'note' THEN 'Help' END AS held,
  CASE family WHEN 'markup' THEN p_size + 3e0 WHEN 'line' THEN p_size + 2e0 WHEN 'ink' THEN p_size + 1e0 END AS reach, CASE WHEN family = 'note' AND p_size % 2 = 0 THEN 'hidden,print' WHEN family = 'note' THEN 'print' ELSE '' END AS flags FROM n""")
def typed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of five kinds for each part, with the columns of their kinds; the widget has its type and value from the field above it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", _text(F.col("p_size")).alias("n"), "p_size")
    bodies = (
        (F.lit(40), _cat("<< /Subtype /Text /Name /Help /T ", W.literal_string(F.col("p_brand")), " /F ", _text(F.when(F.col("p_size") % 2 == 0, 6).otherwise(4)), " >>")),
        (F.lit(41), _cat("<< /Subtype /Highlight /QuadPoints [0 1 ", _text(F.col("p_size") + 3), " 1 0 0 1 0] >>")),
        (F.lit(42), F.lit("<< /Subtype /Widget /T (name) /Parent 45 0 R >>")),
        (F.lit(43), _cat("<< /Subtype /Line /L [0 0 ", _text(F.col("p_size") + 2), " 0] >>")),
        (F.lit(44), _cat("<< /Subtype /Ink /InkList [[0 0] [", _text(F.col("p_size") + 1), " 1]] >>")),
        (F.lit(45), _cat("<< /T (part) /FT /Tx /V ", W.literal_string(F.col("p_name")), " /Kids [42 0 R] >>")),
    )
    extra = part.select("doc_id", _rows(*bodies)).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body")
    pages = Y.page_objects(part.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content")), F.lit("/Annots [40 0 R 41 0 R 42 0 R 43 0 R 44 0 R]"), F.lit("/AcroForm << /Fields [45 0 R] >>"))
    found = D.typed_annotations(_objects(pages.unionByName(extra)))
    return found.select("doc_id", "family", F.coalesce("author", "field_name").alias("named"), F.coalesce("icon", "field_value").alias("held"), F.coalesce(F.get("quads", 2), F.get("ends", 2), F.get(F.get("strokes", 1), 0)).alias("reach"), F.array_join("flags", ",").alias("flags"))


@query("""WITH a AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_id, s_name, s_nationkey, unnest(['GoTo', 'URI', 'SubmitForm', 'SetOCGState', 'JavaScript', 'GoToR']) AS kind FROM supplier)
SELECT doc_id, kind, CASE kind WHEN 'GoTo' THEN 'here' WHEN 'URI' THEN 'http://s/' || doc_id WHEN 'SubmitForm' THEN 'XFDF http://t a' WHEN 'SetOCGState' THEN 'OFF ' || (50 + s_nationkey) || ' ON 49' WHEN 'JavaScript' THEN s_name ELSE s_name || '.pdf' END AS leads,
  CAST(CASE kind WHEN 'GoTo' THEN 0 WHEN 'GoToR' THEN s_nationkey ELSE -1 END AS BIGINT) AS dest_page FROM a""")
def action_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of six kinds of each supplier with the columns of their kinds: one chain from the opening of the document."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), "s_name", "s_nationkey")
    name = F.col("s_name")
    bodies = (
        (F.lit(40), F.lit("<< /S /GoTo /D (here) /Next [41 0 R 42 0 R 43 0 R 44 0 R << /S /GoToR /D 46 0 R /F 45 0 R >>] >>")),
        (F.lit(41), _cat("<< /S /URI /URI (http://s/", _text(F.col("doc_id")), ") >>")),
        (F.lit(42), F.lit("<< /S /SubmitForm /F << /FS /URL /F (http://t) >> /Flags 32 /Fields [(a)] >>")),
        (F.lit(43), _cat("<< /S /SetOCGState /State [/OFF ", _text(50 + F.col("s_nationkey")), " 0 R /ON 49 0 R] >>")),
        (F.lit(44), F.lit("<< /S /JavaScript /JS 47 0 R >>")),
        (F.lit(45), _cat("<< /F (old) /UF ", W.literal_string(_cat(name, ".pdf")), " >>")),
        (F.lit(46), _cat("[", _text(F.col("s_nationkey")), " /Fit]")),
        (F.lit(47), W.stream(name)),
    )
    extra = supplier.select("doc_id", _rows(*bodies)).select("doc_id", F.col("o.obj_num").cast("int").alias("obj_num"), "o.body")
    pages = Y.page_objects(supplier.select("doc_id", F.lit(0).alias("page"), F.lit("").alias("content")), catalog=F.lit("/OpenAction 40 0 R /Names << /Dests << /Names [(here) [4 0 R /Fit]] >> >>"))
    found = D.typed_actions(_objects(pages.unionByName(extra)))
    switched = F.array_join(F.transform("layers", lambda s: F.concat_ws(" ", s["state"], s["obj_num"])), " ")
    sent = F.when(F.col("kind") == "SubmitForm", F.concat_ws(" ", "format", "url", F.array_join(F.transform("fields", lambda f: f["name"]), ",")))
    return found.select("doc_id", "kind", F.coalesce("dest_name", sent, "url", switched, "script", "file").alias("leads"), F.coalesce(F.col("dest_page").cast("long"), F.lit(-1)).alias("dest_page"))


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size, CAST(floor((1 + p_size / 100e0 * (0 - 1)) * 255 + 0.5) AS INTEGER) AS g FROM part)
SELECT doc_id, CAST(0 AS BIGINT) AS node_id, '#ff' || lower(printf('%02x%02x', g, g)) AS colour, p_size + 0e0 AS line_width, round(p_size / 50e0, 6) AS alpha, 'Multiply' AS blend FROM p
UNION ALL SELECT doc_id, 1, CASE p_size % 2 WHEN 0 THEN '#0000ff' ELSE '#00ff00' END, 7e0, 1e0, 'Multiply' FROM p
UNION ALL SELECT doc_id, 2, '#000000', 1e0, 1e0, 'Normal' FROM p""")
def named_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tint of a spot colour under a graphics state, a line in an indexed colour whose width is set behind that state, and a line outside of it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")
    size = _text(F.col("p_size"))
    content = _cat("q /G gs /Spot cs ", _text(F.col("p_size") / 100.0), " scn 0 0 1 1 re f /Idx CS ", _text(F.col("p_size") % 2), " SCN 7 w 0 0 m 1 1 l S Q 0 0 m 2 2 l S")
    bodies = (
        (F.lit(30), _cat("<< /LW ", size, " /ca ", _text(F.col("p_size") / 50.0), " /BM /Multiply >>")),
        (F.lit(31), F.lit("[/Separation /Red 33 0 R << /FunctionType 2 /Domain [0 1] /N 1 /C0 [1 1 1] /C1 [1 0 0] >>]")),
        (F.lit(32), F.lit("[/Indexed [/ICCBased 34 0 R] 1 <0000FF00FF00>]")),
        (F.lit(33), F.lit("[/ICCBased 34 0 R]")),
        (F.lit(34), W.stream(F.lit("profile"), "/N 3")),
    )
    resources = "/Resources << /ExtGState << /G 30 0 R >> /ColorSpace << /Spot 31 0 R /Idx 32 0 R >> >>"
    nodes = S.scene_nodes(_page_file(part, content, resources, bodies))
    alpha = F.when(F.col("fill").isNotNull(), F.col("fill_alpha")).otherwise(F.col("stroke_alpha"))
    return nodes.select("doc_id", F.col("node_id").cast("long").alias("node_id"), F.coalesce("fill", "stroke").alias("colour"), "line_width", F.round(alpha, 6).alias("alpha"), "blend")
