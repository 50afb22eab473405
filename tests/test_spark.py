"""Readers, solvers, distributed search, streams, manifests, command line."""

import json

import pytest
from pyspark.sql import functions as F

from joinery import cli
from joinery.functions import scalars
from joinery.kernels import graph_search, string_repair, strings
from joinery.kernels.graphs import Graph
from joinery.plans import distributed
from joinery.plans.options import GraphOptions, OptionError, StringOptions
from joinery.plans.solve import assembly_of_graphs, assembly_of_strings, calculate_content, calculate_string, register
from joinery.sources import files, manifests, sinks

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("data, want", [(b"", []), (b"\n", [""]), (b"a", ["a"]), (b"a\n", ["a"]), (b"a\nb", ["a", "b"]), (b"a\r\nb\r", ["a", "b\r"]), (b"a\r\n", ["a"]), (b"a\r\r\n", ["a\r"]), (b"\n\n", ["", ""]), (b"a\rb\n", ["a\rb"]), ("é😀\n".encode(), ["é😀"])])
def test_records(spark, tmp_path, data, want):
    (tmp_path / "f.txt").write_bytes(data)
    rows = files.read_strings(spark, str(tmp_path)).orderBy("line_ix").collect()
    assert [r["text"] for r in rows] == want and [r["line_ix"] for r in rows] == list(range(len(want)))


def test_records_of_invalid_bytes(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xed\xa0\x80\n")
    rows = files.read_strings(spark, str(tmp_path)).collect()
    assert [(r["text"], r["error"]) for r in rows] == [(None, "invalid UTF-8")]


def test_solving_goes_on_after_failures(spark):
    rows = spark.createDataFrame([(1, "abab"), (2, None), (3, ""), (4, "abab")], "id int, text string")
    got = {r["id"]: r for r in assembly_of_strings(rows, "text", StringOptions(with_pathway=True, with_history=True)).collect()}
    assert [got[i]["assembly_index"] for i in (1, 3, 4)] == [2, -1, 2] and got[2]["error"] == "no string" and not got[2]["succeeded"]
    assert json.loads(got[1]["pathway"])["duplicates"] and got[1]["history"]


def test_graph_files(spark):
    native = b"p\n3\n1 2 2 3\nC C H\n1 1\n"
    rows = spark.createDataFrame([("a.graph", bytearray(native)), ("b.mol", bytearray(b"junk")), ("c", None)], "path string, content binary")
    parsed = {r["path"]: r for r in files.parse_graphs(rows).collect()}
    assert parsed["a.graph"]["labels"] == ["C", "C"] and parsed["b.mol"]["error"] and parsed["c"]["error"] == "no content"
    solved = {r["path"]: r for r in assembly_of_graphs(files.parse_graphs(rows, remove_hydrogens=False).drop("error"), GraphOptions(remove_hydrogens=False)).collect()}
    assert solved["a.graph"]["assembly_index"] == 1 and solved["b.mol"]["assembly_index"] is None
    assert calculate_content(native)["assembly_index"] == 0 and calculate_content(b"?")["error"]
    assert calculate_string("abab")["assembly_index"] == 2
    bad = spark.createDataFrame([(["C"], [(0, 5, 1)])], "labels array<string>, edges array<struct<src:int,dst:int,label:int>>")
    assert assembly_of_graphs(bad).first()["error"] == "endpoint out of range"


def test_path_resolution():
    there = {"x.mol", "y", "z", "z.mol"}.__contains__
    assert [files.resolve(p, there) for p in ("x", "x.mol", "y", "z", "q", "q.SDF")] == ["x.mol", "x.mol", "y", "z", "q", "q.SDF"]


@pytest.mark.parametrize("make", [lambda: StringOptions(algorithm="x"), lambda: StringOptions(cpu_budget_ns=-1), lambda: StringOptions(algorithm="repair", cpu_budget_ns=5), lambda: GraphOptions(enumeration_limit=0), lambda: GraphOptions(algorithm="repair", enumeration_limit=7), lambda: GraphOptions(algorithm="repair", with_history=True)])
def test_refused_options(make):
    with pytest.raises(OptionError):
        make()


@pytest.mark.parametrize("mode", ["local", "distributed", "auto"])
def test_distributed_search_equals_local(spark, mode):
    for text in ("abracadabraabracadabra", "aabbaabbabab", "x"):
        out = distributed.search_string(spark, text, mode=mode)
        assert out.index == strings.solve(text).index and out.proven
    ladder = Graph.of(["C"] * 8, [(i, i + 1, 1) for i in range(3)] + [(i + 4, i + 5, 1) for i in range(3)] + [(i, i + 4, 1) for i in range(4)])
    assert distributed.search_graph(spark, ladder, mode=mode).index == graph_search.solve(ladder).index


def test_jobs_that_run_out_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(distributed, "LOCAL_ROUND_NS", 1)
    text = "abcabdabcabdacabca"
    out = distributed.search_string(spark, text, mode="distributed")
    assert out.index == strings.solve(text).index and out.rounds > 1 and out.best_by_round == sorted(out.best_by_round, reverse=True)
    stopped = distributed.search_string(spark, "".join("abc"[i * i % 3] for i in range(30)), mode="distributed", max_rounds=0)
    assert not stopped.proven or stopped.rounds == 0


@pytest.mark.parametrize("mode", ["local", "distributed"])
def test_distributed_pathways_replay(spark, monkeypatch, mode):
    if mode == "distributed":
        monkeypatch.setattr(distributed, "LOCAL_ROUND_NS", 2_000_000)
    for text, turned in (("abracadabraabracadabra", False), ("abcabdabcabdacabca", False), ("aabbabaabbbbaa", True), ("xyz", False), ("x", False)):
        out = distributed.search_string(spark, text, turned, mode=mode)
        assert strings.replay(text, out.steps, turned) == out.index == strings.solve(text, turned).index
    ladder = Graph.of(["C"] * 8, [(i, i + 1, 1) for i in range(3)] + [(i + 4, i + 5, 1) for i in range(3)] + [(i, i + 4, 1) for i in range(4)])
    ring = Graph.of(["C", "N"] * 3, [(i, (i + 1) % 6, 1 + i % 2) for i in range(6)])
    for graph in (ladder, ring, Graph.of(["C", "N", "O"], [(0, 1, 1), (1, 2, 2)])):
        out = distributed.search_graph(spark, graph, mode=mode, with_pathway=True)
        assert out.index == graph_search.solve(graph).index and graph_search.replay(graph, out.steps) == out.index


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT string_assembly('abab', false).assembly_index AS i, string_repair('abba', true).assembly_index AS b").first() == (2, 2)
    assert spark.sql("SELECT graph_assembly(CAST('p\n2\n1 2\nC C\n1' AS BINARY), '').assembly_index").first()[0] == 0
    assert [tuple(r) for r in spark.sql("SELECT * FROM pathway_steps('abxab', false)").collect()] == [(0, 0, 3, 2)]
    assert spark.sql("SELECT count(*) FROM repair_rules('abababab', false)").first()[0] == len(string_repair.repair("abababab").rules)


def test_streams(spark, tmp_path):
    from joinery.streaming.strings import assembly_stream, growing_strings, index_windows

    rows = [("2024-01-01 00:00:00", "a", "abab"), ("2024-01-01 00:30:00", "a", "xyz"), ("2024-01-01 02:00:00", "b", None)]
    spark.createDataFrame(rows, "ts string, key string, text string").select(F.to_timestamp("ts").alias("ts"), "key", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, text string").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(90)
        return spark.table(name).collect()

    solved = run(assembly_stream(stream, "text").select("key", "assembly_index", "error"), "solved", "append")
    assert sorted(map(tuple, solved), key=str) == [("a", 2, None), ("a", 2, None), ("b", None, "no string")]
    windows = run(index_windows(assembly_stream(stream, "text"), "ts", "key"), "windows", "complete")
    assert {(r["key"], r["n"], r["largest_index"]) for r in windows} == {("a", 2, 2), ("b", 1, None)}
    grown = run(growing_strings(stream.where("text is not null"), "key", "text"), "grown", "update")
    assert [(r["key"], r["length"]) for r in grown] == [("a", 7)]


def test_manifests(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("molecule\texpected_assembly_index\na\t3\nb\t-1\n")
    rows = manifests.check_regression(manifests.read_tsv(spark, str(tmp_path / "r.tsv"), manifests.REGRESSION))
    assert sorted(map(tuple, rows.collect())) == [("a", 3), ("b", -1)]
    make = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    for bad in ([("a", "x")], [("a", "1"), ("a", "1")], [(None, "1")]):
        with pytest.raises(manifests.ManifestError):
            manifests.check_regression(make(bad, manifests.REGRESSION))
    with pytest.raises(manifests.ManifestError, match="unknown"):
        manifests.check_pathways(make([("zz", "{}")], manifests.PATHWAYS), rows)
    case = ("n", "i", "4", "exact", "quick,full", "w")
    assert manifests.check_cases(make([case], manifests.CASES)).count() == 2
    with pytest.raises(manifests.ManifestError, match="suite"):
        manifests.check_cases(make([case[:4] + ("odd", "w")], manifests.CASES))
    for bad in (case[:5] + (" ",), case[:4] + ("quick,quick", "w"), (None,) + case[1:]):
        with pytest.raises(manifests.ManifestError):
            manifests.check_cases(make([bad], manifests.CASES))
    assert manifests.check_cases(make([case[:3] + ("reviewed",) + case[4:]], manifests.CASES), manifests.EXPECTATIONS).count() == 2
    with pytest.raises(manifests.ManifestError, match="expectation"):
        manifests.check_cases(make([case], manifests.CASES), manifests.EXPECTATIONS)
    with pytest.raises(manifests.ManifestError):
        manifests.check_weights(make([("c", "0")], manifests.WEIGHTS))


def test_outputs_do_not_touch_inputs():
    for inputs, outputs in ((["/a/b"], ["/a/b"]), (["/a"], ["/a/out"]), (["/a/b/c"], ["/a/b"]), ([], ["/x", "/x/"])):
        with pytest.raises(sinks.OutputError):
            sinks.check_outputs(inputs, outputs)
    sinks.check_outputs(["/a/in"], ["/a/out"])


def test_ascii_json(spark):
    rows = spark.createDataFrame([("é😀\n",)], "text string")
    assert rows.select(scalars.ascii_json(F.struct("text"))).first()[0] == '{"text":"\\u00e9\\ud83d\\ude00\\n"}'


def test_incumbents_and_metrics(spark):
    rows = spark.createDataFrame([("bbbabba",), ("abab",)], "text string")
    solved = assembly_of_strings(rows, "text", StringOptions(with_history=True))
    log = sinks.incumbents(solved, "text").where("text = 'bbbabba'").orderBy("step").collect()
    assert [r["index"] for r in log] == [5, 4]
    assert sinks.metrics(solved).select("objects", "succeeded", "bounds_only").first() == (2, 2, 0)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.txt").write_text("abab\nx\n")
    (tmp_path / "g.graph").write_text("p\n3\n1 2 2 3\nC C C\n1 1\n")
    assert cli.main([str(tmp_path / "s.txt"), "--run-strings=1"]) == 0
    assert [x.rsplit(" ", 1)[1] for x in capsys.readouterr().out.split("\n")[:2]] == ["2", "0"]
    assert cli.main([str(tmp_path / "g.graph"), f"--out={tmp_path}/out", "--telemetry=1", "--write-intermediate-mas=1"]) == 0
    assert "assembly index: 1" in spark.read.text(f"{tmp_path}/out/lines").first()[0]
    assert cli.main([str(tmp_path / "g.graph"), "--algorithm=re-pair"]) == 0 and "upper bound: 1" in capsys.readouterr().out
    (tmp_path / "bad.mol").write_text("junk")
    assert cli.main([str(tmp_path / "bad.mol")]) == 1
    for wrong in (["--accept-palindromes=1"], ["--run-strings=1", "--enum-max=5"], ["--algorithm=re-pair", "--runtime=5"], ["--enum-max=0"], [f"--out={tmp_path}/g.graph"]):
        assert cli.main([str(tmp_path / "g.graph"), *wrong]) == 2
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "g.graph"), "--pathway=1", "--pathway=0"])


def test_scan_reads_only_what_it_needs(spark):
    from joinery.queries.objects import order_strings

    plan = order_strings(spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan
