import json

from folioforge.operators import edits
from folioforge.streaming import documents


def test_document_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\n*x*")
    (tmp_path / "in" / "b.bin").write_bytes("plain\n\ntext".encode("utf-16"))
    stream = documents.documents(spark, str(tmp_path / "in"))
    for fmt, want in (("md", {"T\nx", "plain\ntext"}), (None, {"# T\n*x*", "plain\ntext"})):
        q = documents.converted(stream.select("doc_id", "content"), "plain", fmt).writeStream.format("memory").queryName(f"out_{fmt}").start()
        q.processAllAvailable()
        q.stop()
        got = {bytes(r.content).decode() for r in spark.table(f"out_{fmt}").collect()}
        assert got == want if fmt else "plain\ntext" in got


def test_edit_stream(spark, tmp_path):
    insert = lambda i: ("insert", i, json.dumps({"parent": 1, "ix": 0, "kind": "Paragraph"}))
    first = [(1, 1, 0, *insert(2)), (1, 2, 0, *insert(3)), (2, 1, 0, *insert(2))]
    second = [(1, 3, 0, "undo", None, None), (2, 2, 0, "delete", 0, "{}")]
    path = str(tmp_path / "ops")
    spark.createDataFrame(first, edits.OPS).coalesce(1).write.parquet(path)
    q = documents.edited(spark.readStream.schema(edits.OPS).parquet(path)).writeStream.outputMode("update").format("memory").queryName("edited").start()
    q.processAllAvailable()
    spark.createDataFrame(second, edits.OPS).coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    rows = sorted(tuple(r) for r in spark.table("edited").collect())
    assert rows == [(1, 3, 3, 0), (1, 4, 2, 0), (2, 3, 1, 0), (2, 3, 1, 1)]
