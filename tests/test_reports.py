"""Reports of timed runs: error rows beside good ones."""

import json

import pytest

from joinery.sources import reports


def report(**changes):
    measured = {"measurements": [{"round": i + 1, "wall_seconds": 0.5 + i, "clock_ticks": 10 * i, "assembly_index": 3} for i in range(2)]}
    case = {"name": "a", "input": "a.mol", "expected_assembly_index": 3, "expectation": "reviewed", "workload": "w", "suites": ["quick"], "candidate": measured, "baseline": None}
    document = {"schema_version": 2, "generated_at": "x", "suite": "quick", "runs": 2, "execution": {"candidate": {"launcher": [], "arguments": [], "environment": {}}, "baseline": None}, "cases": [case]}
    for path, value in changes.items():
        at = document
        *head, last = [int(x) if x.isdigit() else x for x in path.split("__")]
        for x in head:
            at = at[x]
        at[last] = value
    return document


def read(spark, tmp_path, documents):
    for name, d in documents.items():
        (tmp_path / f"{name}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=2))
    parsed = reports.parsed(reports.read_reports(spark, str(tmp_path)))
    cases = reports.case_roles(parsed)
    stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".json")
    return {(stem(r["path"]), r["case"], r["role"]): r["error"] for r in reports.errors(parsed, cases).collect()}, [(stem(r["path"]), *r[1:]) for r in reports.samples(cases).collect()]


WHOLE = {json.dumps(report(cases__0__candidate__measurements__1__wall_seconds=float("nan"))): "no JSON document", " ": "no JSON document", "{": "no JSON document", "[1]": "no object", "7": "no object", "null": "no object"}
REPORTS = {
    "schema_version is not 2": [{"schema_version": v} for v in (1, 2.0, True, "2", None)],
    "no suite": [{"suite": ""}, {"suite": None}],
    "invalid number of runs": [{"runs": 0}, {"runs": 1.5}, {"runs": None}],
    "no cases": [{"cases": []}, {"cases": None}, {"cases": 3}],
}
CASES = {
    "no measurements": [{"cases__0__candidate": None}, {"cases__0__candidate__measurements": 4}],
    "wrong number of samples": [{"runs": 3}, {"cases__0__candidate__measurements": []}],
    "invalid round order": [{"cases__0__candidate__measurements__0__round": 2}, {"cases__0__candidate__measurements__1__round": None}, {"cases__0__candidate__measurements__1__round": 2.0}],
    "invalid wall sample": [{"cases__0__candidate__measurements__1__wall_seconds": v} for v in (0, -1, None, "1", True)],
    "invalid clock sample": [{"cases__0__candidate__measurements__1__clock_ticks": v} for v in (-1, 1.5, None)],
    "unexpected index": [{"cases__0__candidate__measurements__1__assembly_index": v} for v in (4, None)],
    "invalid expected index": [{"cases__0__expected_assembly_index": None}],
    "no case name": [{"cases__0__name": ""}, {"cases__0__name": None}],
    "duplicate or reserved case name": [{"cases__0__name": "__suite__"}],
    "invalid number of workers": [{"execution__candidate__launcher": x} for x in (["mpiexec", "-n"], ["mpiexec", "-n", "0"], ["-n2", "--np=3"])] + [{"execution__candidate__environment": {"OMP_NUM_THREADS": "x"}}],
}


def test_faults_are_rows_and_the_rest_goes_on(spark, tmp_path):
    documents, whole, by_case = {"good": report()}, {}, {}
    for i, (text, error) in enumerate(WHOLE.items()):
        documents[f"w{i}"], whole[f"w{i}"] = text, error
    for error, changes in REPORTS.items():
        for i, c in enumerate(changes):
            name = f"r{len(documents)}"
            documents[name], whole[name] = report(**c), error
    for error, changes in CASES.items():
        for i, c in enumerate(changes):
            name = f"c{len(documents)}"
            documents[name], by_case[name] = report(**c), error
    found, good = read(spark, tmp_path, documents)
    assert {k[0]: e for k, e in found.items() if k[2] is None} == whole
    assert {k[0]: e for k, e in found.items() if k[2]} == by_case and all(k[2] in (None, "candidate") for k in found)
    assert sorted(good) == [("good", "quick", "a", "candidate", 1, 0.5, 0, 1), ("good", "quick", "a", "candidate", 2, 1.5, 10, 1)]


def test_roles_are_paired(spark, tmp_path):
    one = report()["cases"][0]
    both = one | {"baseline": one["candidate"]}
    short = both | {"name": "b", "baseline": {"measurements": one["candidate"]["measurements"][:1]}}
    started = {"launcher": ["mpiexec", "--ntasks=3"], "environment": {"OMP_NUM_THREADS": "4", "OMP_THREAD_LIMIT": "2"}}
    found, good = read(spark, tmp_path, {"x": report(cases=[both, short, one | {"name": "c"}, one | {"name": "c"}], execution={"candidate": started, "baseline": None})})
    assert found == {("x", "b", "baseline"): "wrong number of samples", ("x", "c", "candidate"): "duplicate or reserved case name"}
    assert {(r[2], r[3], r[4], r[7]) for r in good} == {("a", "baseline", 1, 1), ("a", "baseline", 2, 1), ("a", "candidate", 1, 6), ("a", "candidate", 2, 6)}


@pytest.mark.parametrize("rows", [[], [("s", "a", "candidate", 1, 0.25, 3, 2)]])
def test_documents_read_back(spark, rows):
    frame = spark.createDataFrame(rows, "suite string, case string, role string, round int, wall_seconds double, clock_ticks long, workers int")
    files = reports.documents(frame).withColumnRenamed("suite", "path")
    assert [tuple(r)[1:] for r in reports.samples(reports.case_roles(reports.parsed(files))).collect()] == rows
