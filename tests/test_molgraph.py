"""format("molgraph"): graph files as a data source."""

import os

import pytest

from joinery.sources import molgraph

GRAPHS = "name string, labels array<string>, edges array<struct<src: int, dst: int, label: int>>"


def named(df):
    return {os.path.basename(r["path"]): (r["labels"], [tuple(e) for e in r["edges"]] if r["edges"] is not None else None, r["error"]) for r in df.collect()}


def test_what_is_written_reads_back(spark, tmp_path, monkeypatch):
    molgraph.register(spark)
    rows = [(f"g{i}", ["C", "N", "O"][: 2 + i % 2], [(0, 1, 1 + i % 3)] + ([(1, 2, 2)] if i % 2 else [])) for i in range(30)]
    graphs = spark.createDataFrame(rows, GRAPHS)
    folder = f"{tmp_path}/out"
    graphs.where("name < 'g2'").repartition(3).write.format("molgraph").mode("append").save(folder)
    graphs.where("name >= 'g2'").write.format("molgraph").mode("append").save(f"file://{folder}")
    got = named(spark.read.format("molgraph").load(folder))
    assert got == {f"{n}.graph": (labels, edges, None) for n, labels, edges in rows}
    assert sorted(os.listdir(folder)) == sorted(f"{n}.graph" for n, *_ in rows)
    graphs.limit(2).write.format("molgraph").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 2


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    molgraph.register(spark)
    folder = f"{tmp_path}/out"
    spark.createDataFrame([("a", ["C", "C"], [(0, 1, 1)])], GRAPHS).write.format("molgraph").mode("append").save(folder)
    for bad in ([("b", ["C", "C"], [(0, 1, 1)]), ("c", ["white space", "C"], [(0, 1, 1)])], [("a", ["N", "C"], [(0, 1, 1)])], [("d", ["C"], []), ("d", ["N"], [])], [("x/y", ["C"], [])]):
        with pytest.raises(Exception, match="label|name"):
            spark.createDataFrame(bad, GRAPHS).coalesce(1).write.format("molgraph").mode("append").save(folder)
    assert os.listdir(folder) == ["a.graph"]
    assert named(spark.read.format("molgraph").load(folder))["a.graph"][0] == ["C", "C"]
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("molgraph").mode("append").save(folder)


def test_broken_files_are_rows(spark, tmp_path):
    molgraph.register(spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.graph").write_text("p\n3\n1 2 2 3\nC C H\n1 1\n")
    (tmp_path / "in" / "sub" / "b.MOL").write_text("junk")
    (tmp_path / "in" / "_c.graph").write_text("hidden")
    got = named(spark.read.format("molgraph").load(f"{tmp_path}/in"))
    assert got["a.graph"] == (["C", "C"], [(0, 1, 1)], None) and got["b.MOL"][2] and set(got) == {"a.graph", "b.MOL"}
    kept = spark.read.format("molgraph").option("removeHydrogens", "false").load(f"{tmp_path}/in/a.graph")
    assert kept.select("labels").first()[0] == ["C", "C", "H"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("molgraph").load(f"{tmp_path}/none").collect() == []
