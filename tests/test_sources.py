import io
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tagquarry.operators import project, relation
from tagquarry.sources import datasource
from tagquarry.sources.store import stored


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def packed(names, zst):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w" if zst else "w:gz") as archive:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = len(name)
            archive.addfile(info, io.BytesIO(name.encode()))
    return zstandard.ZstdCompressor().compress(out.getvalue()) if zst else out.getvalue()


def test_batch_and_stream_read_the_same(source, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for i in range(7):
        (folder / ("sub" if i % 2 else "") / f"{i}.html").write_text(f"<p>{i}")
    (folder / "_hidden").write_text("no")
    (folder / "a.tar.gz").write_bytes(packed(["x.html", "d/y.html"], False))
    (folder / "b.tar.zst").write_bytes(packed(["z.html"], True))
    read = source.read.format("tagquarry").option("partition_bytes", 10).load(str(folder))
    rows = {r["path"].removeprefix(str(folder)): bytes(r["content"]).decode() for r in read.collect()}
    expected = {f"{'/sub' if i % 2 else ''}/{i}.html": f"<p>{i}" for i in range(7)} | {"/a.tar.gz!x.html": "x.html", "/a.tar.gz!d/y.html": "d/y.html", "/b.tar.zst!z.html": "z.html"}
    assert rows == expected
    assert project.texts(relation.trees(read.where(F.col("path").endswith("3.html")), "path", "content"), "path").first()["text"] == "3"
    for condition, n in ((F.col("path") == f"{folder}/2.html", 1), (F.col("path").startswith(f"{folder}/sub"), 3), (F.col("path") == f"{folder}/a.tar.gz!x.html", 1), (F.col("path").startswith(f"{folder}/a.tar.gz!d"), 1), (F.col("path") == "none", 0)):
        some = read.where(condition)
        assert some.count() == n and {r["path"] for r in some.collect()} == {p for p in map(str(folder).__add__, expected) if p in {r["path"] for r in read.where(condition).collect()}}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        stream = source.readStream.format("tagquarry").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["path"].removeprefix(str(folder)) for r in source.read.parquet(out).collect())

    assert drain() == sorted(expected)
    (folder / "later.html").write_text("<p>l")
    assert drain() == sorted([*expected, "/later.html"])
    assert source.read.format("tagquarry").load(str(tmp_path / "nowhere")).count() == 0


def test_a_failed_task_leaves_no_file(source, tmp_path):
    docs = source.createDataFrame([(f"d{i % 3}/{i}.md", f"text {i}") for i in range(20)] + [("empty.md", None)], "name string, text string").repartition(4)
    target = tmp_path / "out"
    docs.write.format("tagquarry").mode("append").save(str(target))
    assert {str(p.relative_to(target)): p.read_text() for p in target.rglob("*") if p.is_file()} == {f"d{i % 3}/{i}.md": f"text {i}" for i in range(20)} | {"empty.md": ""}
    bad = docs.unionByName(source.createDataFrame([("../out.md", "x")], docs.schema))
    with pytest.raises(Exception, match="no name of a file"):
        bad.write.format("tagquarry").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] and not (tmp_path / "out.md").exists()


def test_stored_tables_are_written_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert stored(spark, "five rows", make).count() == stored(spark, "five rows", make).count() == 5 and len(made) == 1
