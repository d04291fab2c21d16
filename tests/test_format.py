"""The data source: what is pushed down isn't read, and the rest is read as the operators read it."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, InputPartition, IsNotNull, StringEndsWith
from pyspark.sql.types import _parse_datatype_string

from quirel.sources import format as Z
from quirel.sources import objects as O
from quirel.sources import writer as W


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pdf") / "in")
    rows = [(d, n, b) for d in range(12) for n, b in ((1, "<< /Type /Catalog >>"), (2, f"<< /Length 4 /Type /Note >>\nstream\nd{d:03d}\nendstream"), (3, f"<< /Type /Page /N {d} >>"))]
    Z.register(spark)
    W.assemble(spark.createDataFrame(rows, "doc_id long, obj_num int, body string")).write.format("pdf").mode("append").save(path)
    with open(f"{path}/broken.pdf", "wb") as f:
        f.write(b"no file of this kind")
    with open(f"{path}/other.txt", "wb") as f:
        f.write(b"not asked for")
    return path


def reader(folder, columns, filters=(), **options):
    made = Z.PrunedReader(_parse_datatype_string(columns), {"path": folder, **options})
    left = list(made.pushFilters(list(filters)))
    return made, left


def rows_of(made):
    return [r for p in made.partitions() for b in made.read(p) for r in b.to_pylist()]


def test_equals_the_readers_of_binary_files(spark, folder):
    by_format = {(r.doc_id, r.obj_num, r.json, bytes(r.data or b""), r.error) for r in Z.as_objects(Z.read(spark, folder)).select("doc_id", "obj_num", F.to_json("value").alias("json"), "data", "error").collect()}
    plain = O.read_objects(O.read_pdf(spark, f"{folder}/*.pdf")).select("doc_id", "obj_num", F.to_json("value").alias("json"), "data", "error")
    assert by_format == {(r.doc_id, r.obj_num, r.json, bytes(r.data or b""), r.error) for r in plain.collect()}
    assert len(by_format) == 12 * 4 + 1


def test_pruned_reads_decode_and_parse_nothing_else(folder, monkeypatch):
    decoded, parsed = [], []
    monkeypatch.setattr(O.File, "_decoded", staticmethod(lambda value, body: decoded.append(1) or body))
    get = O.File.get
    monkeypatch.setattr(O.File, "get", lambda self, number: parsed.append(number) or get(self, number))
    made, left = reader(folder, "path string, obj_num long, json string", [GreaterThan(("obj_num",), 1)])
    assert not left and {r["obj_num"] for r in rows_of(made)} == {2, 3} and not decoded and set(parsed) == {2, 3}
    made, _ = reader(folder, "obj_num long, type string, data binary", [EqualTo(("type",), "Page")])
    assert len(rows_of(made)) == 12 and not decoded
    made, _ = reader(folder, "obj_num long, type string, data binary", [In(("type",), ("Note", "Page"))])
    assert len(rows_of(made)) == 24 and len(decoded) == 12


def test_paths_are_pruned_before_files_are_opened(folder, monkeypatch):
    made, left = reader(folder, "path string, obj_num long", [StringEndsWith(("path",), "/7.pdf"), IsNotNull(("path",))])
    assert [type(f) for f in left] == [IsNotNull]
    opened = []
    monkeypatch.setattr(Z, "object_rows", lambda *a: opened.append(1) or iter(()))
    rows_of(made)
    assert len(opened) == 1


def test_partitions_by_size(folder):
    made, _ = reader(folder, "path string", maxPartitionBytes=str(5 << 20))
    groups = [p.value for p in made.partitions()]
    assert len(groups) == 4 and sorted(x for g in groups for x in g) == [p for p, _, _ in Z.listed(folder)] and len(Z.listed(folder)) == 13
    assert Z.packed([("big", 99), ("a", 1), ("b", 1)], Z.OPEN_BYTES * 2 + 2) == [["big"], ["a", "b"]]
    assert Z.packed([], 5) == [] and [p.value for p in Z.PdfReader(_parse_datatype_string("path string"), {"path": folder, "pathGlobFilter": "*.none"}).partitions()] == [[]]
    assert isinstance(next(made.read(InputPartition(groups[0]))), pa.RecordBatch)


def test_plan_shows_filters_and_columns(spark, folder):
    found = Z.read(spark, folder, "path", "obj_num", "type").where("type = 'Page' and obj_num > 2")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(type,Page)" in plan and "GreaterThan(obj_num,2)" in plan and "data" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert found.count() == 12 and Z.read(spark, folder, pushdown="false").where("type = 'Page'").count() == 12
    assert Z.read(spark, folder, "error", "obj_num").where("obj_num is null").first().error.startswith("PdfError")


def test_stream_takes_new_files_once(spark, folder, tmp_path):
    Z.register(spark)
    grown = str(tmp_path / "grown")
    os.makedirs(grown)

    def take(out="all", **options):
        stream = spark.readStream.format("pdf").schema("path string, obj_num long").options(**options).load(grown)
        stream.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-state")).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema("path string, obj_num long").parquet(str(tmp_path / out))
        assert found.count() == 4 * found.select("path").distinct().count()
        return found.count() // 4

    for names, held in ((range(0, 7), 7), (range(7, 12), 12), ((), 12)):
        for n in names:
            with open(f"{folder}/{n}.pdf", "rb") as f, open(f"{grown}/{n}.pdf.part", "wb") as g:
                g.write(f.read())
            os.replace(f"{grown}/{n}.pdf.part", f"{grown}/{n}.pdf")
        assert take() == held
    assert [take("some", maxFilesPerTrigger="5") for _ in range(4)] == [5, 10, 12, 12]
