from quirel.streaming.ingest import ingest, stream_pdf
from tests.test_objects import page


def test_new_files_become_objects(spark, tmp_path):
    files, out = tmp_path / "in", tmp_path / "out"
    files.mkdir()
    (files / "a.pdf").write_bytes(page("BT /F0 12 Tf 1 1 Td (a) Tj ET"))
    for n in (1, 2):
        ingest(stream_pdf(spark, str(files)), str(out), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(out)).select("doc_id").distinct().count() == n
        (files / "b.pdf").write_bytes(b"broken")
