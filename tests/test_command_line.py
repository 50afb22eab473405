"""Result lines, path resolution, stops at failed lines, and searches over the cluster from the command line."""

import pytest
from pyspark.sql import functions as F

from joinery import cli
from joinery.plans.options import GraphOptions, StringOptions
from joinery.plans.solve import assembly_of_graphs, assembly_of_strings
from joinery.sources import sinks
from joinery.sources.files import resolved

MOL = "x\n\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n" + "    0.0000    0.0000    0.0000 C   0  0\n" * 3 + "  1  2  1  0\n  2  3  1  0\nM  END\n"


def test_every_row_has_a_line(spark):
    graphs = spark.createDataFrame([("good", ["C", "C", "C"], [(0, 1, 1), (1, 2, 1)]), ("bad", ["C"], [(0, 5, 1)]), ("none", None, None)], "name string, labels array<string>, edges array<struct<src:int,dst:int,label:int>>")
    lines = {r[0]: r[1] for r in assembly_of_graphs(graphs).select("name", sinks.result_line(F.col("name"))).collect()}
    assert lines["good"] == "good has assembly index: 1"
    assert lines["bad"].startswith("bad failed: ") and lines["none"] == "none failed: no index"


def test_blocks_of_an_out_file(spark):
    texts = spark.createDataFrame([("abababab",)], "text string")
    block = lambda options: assembly_of_strings(texts, "text", options).select(sinks.result_block(F.lit("s"), "string")).first()[0].split("\n")
    exact = block(StringOptions())
    assert exact[0] == "s has assembly index: 3" and exact[1].startswith("time elapsed: ") and len(exact) == 2
    bound = block(StringOptions(algorithm="repair"))
    assert bound[:3] == ["s has assembly upper bound: 3", "status: heuristic upper bound (minimum not proven)", "trivial upper bound: 7"]
    assert bound[3].startswith("string-repair rules: ") and bound[4].startswith("remaining fragments: ") and bound[5].startswith("time elapsed: ")
    assert block(StringOptions(cpu_budget_ns=0))[1] == "status: runtime limit reached"


def test_paths_resolve_to_mol_files(spark, tmp_path, capsys):
    (tmp_path / "a.mol").write_text(MOL)
    (tmp_path / "b").write_text("p\n3\n1 2 2 3\nC C C\n1 1\n")
    (tmp_path / "b.mol").write_text("junk")
    assert resolved(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c"]) == [f"{tmp_path}/a.mol", f"{tmp_path}/b", f"{tmp_path}/c"]
    assert cli.main([f"{tmp_path}/a"]) == 0
    assert capsys.readouterr().out.rstrip().endswith("a.mol has assembly index: 1")


def test_a_failed_line_ends_its_file(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes(b"abab\nxyxyxy\n")
    (tmp_path / "b.txt").write_bytes(b"ab\n\xff\nabab\n")
    assert cli.main([f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", "--run-strings=1"]) == 1
    lines = capsys.readouterr().out.rstrip().split("\n")
    assert [x.split("/")[-1] for x in lines] == ["a.txt:0 has assembly index: 2", "a.txt:1 has assembly index: 3", "b.txt:0 failed: invalid UTF-8"]


def test_an_interrupt_exits_by_130(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("abab\n")

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "_written", stopped)
    assert cli.main([f"{tmp_path}/a.txt", "--run-strings=1"]) == 130


def test_parallel_goes_over_the_cluster_or_is_refused(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("abcabcabxabc\nabab\n")
    (tmp_path / "g.mol").write_text(MOL)
    for given in ([f"{tmp_path}/a.txt", "--run-strings=1"], [f"{tmp_path}/g.mol"]):
        assert cli.main(given) == 0
        alone = capsys.readouterr().out
        assert cli.main([*given, "--parallel=on"]) == 0 and capsys.readouterr().out == alone
        for wrong in (["--algorithm=re-pair"], ["--runtime=5"], [f"--out={tmp_path}/o"], ["--telemetry=1"]):
            assert cli.main([*given, "--parallel=on", *wrong]) == 2


@pytest.mark.parametrize("column", ["text", "_text"])
def test_equal_objects_are_known_by_digest(spark, column):
    rows = spark.createDataFrame([("abab", 1), ("abab", 2), (None, 3), ("", 4)], f"{column} string, n int")
    got = assembly_of_strings(rows, column)
    assert {r["n"]: r["assembly_index"] for r in got.collect() if r["n"] < 3} == {1: 2, 2: 2} and got.count() == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (__object" in plan
    graphs = spark.createDataFrame([(["C", "C"], [(0, 1, 1)]), (["C", "C"], [(0, 1, 2)]), (None, None)], "labels array<string>, edges array<struct<src:int,dst:int,label:int>>")
    assert sorted(str(r["assembly_index"]) for r in assembly_of_graphs(graphs, GraphOptions()).collect()) == ["0", "0", "None"]
