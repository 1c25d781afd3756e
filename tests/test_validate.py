import pytest

from recordloom.operators.validate import validate

MATCH, CAND = "source1_entity_id\tmatched_entity_ids\n", "source1_entity_id\tcandidate_entity_ids\n"


@pytest.fixture
def folder(tmp_path):
    for k, ids in ((1, ["S1-1", "S1-2"]), (2, ["S2-1", "S2-2"]), (3, ["S3-1"])):
        (tmp_path / f"test_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tx\ty\tz\n" for i in ids))
    return tmp_path


def run(spark, folder, matches, candidates=None, **k):
    for name, body in (("m", matches), ("c", candidates)):
        if body is not None:
            (folder / f"{name}.tsv").write_bytes(body if isinstance(body, bytes) else body.encode())
    report = validate(spark, str(folder / "m.tsv"), str(folder / "c.tsv"), str(folder), **k)
    return report, {what.removeprefix("matches: "): (severity, n, examples) for severity, what, n, examples in report.findings}


def test_clean_files_pass(spark, folder):
    report, found = run(spark, folder, MATCH + "S1-1\tS2-1\nS1-2\t\n", CAND + "S1-1\tS2-1,S2-2\nS1-2\t\n", check_ids=True)
    assert report.passed and found == {} and report.counts["matches"] == {"n_rows": 2, "n_empty": 1, "n_filled": 1}


@pytest.mark.parametrize(
    ("body", "check"),
    [
        (None, "file not found"), ("", "file is empty"), ("source1_entity_id,matched_entity_ids\n", "header has commas and no tab"), ("a\tb\n", "unexpected header"),
        ("﻿" + MATCH, "unexpected header"), (MATCH.encode() + b"S1-1\t\xff\n", "file is not UTF-8"),
    ],
)
def test_fatal(spark, folder, body, check):
    report, found = run(spark, folder, body)
    assert not report.passed and found[check][0] == "error" and "matches" not in report.counts


@pytest.mark.parametrize(
    ("rows", "check", "examples"),
    [
        ("S1-1\t\nS1-2\t\nbroken\n\n  \n", "line without a tab", ["line      4: broken"]),
        ("S1-1\t\nS1-1\tS2-1\nS1-2\t\n", "source-1 row repeated", ["S1-1"]),
        ("S1-1\tS2-1,S2-1\nS1-2\t\n", "id repeated in a list", ["S1-1"]),
        ("S1-1\tS1-2\nS1-2\t\n", "source-1 id in a list", ["S1-2"]),
        ("S1-1\tS2-1, S2-2\nS1-2\tS2-1,\n", "id of neither S2- nor S3-", ["", " S2-2"]),
        ("S1-1\tS2-77\nS1-2\t\n", "id in no target file", ["S2-77"]),
        ("S1-1\t\n", "required source-1 row missing", ["S1-2"]),
        ("S1-1\t\nS1-2\t\nS1-3\t\n", "source-1 row not required", ["S1-3"]),
    ],
)
def test_each_rule(spark, folder, rows, check, examples):
    report, found = run(spark, folder, MATCH + rows, check_ids=True)
    assert not report.passed and found[check] == ("error", len(examples), examples)
    assert {k for k, v in found.items() if v[0] == "error"} == {check}


def test_warnings_pass(spark, folder):
    report, found = run(spark, folder, MATCH + "S1-1\tS2-1\nS1-2\t\n")
    assert report.passed and found["ids not checked for existence"][0] == "warning" and found["candidates: file not found"][0] == "warning"
    report, found = run(spark, folder, MATCH + "S1-1\tS2-1,S3-1\nS1-2\t\n", CAND + "S1-1\tS3-1\nS1-2\t\n")
    assert report.passed and found["matches not among the candidates"] == ("warning", 1, ["S1-1"])


def test_missing_inputs(spark, folder):
    (folder / "test_source3.tsv").unlink()
    report, found = run(spark, folder, MATCH + "S1-1\tS2-77\nS1-2\t\n", check_ids=True)
    assert report.passed and "target file not found, ids not checked for existence" in found
    (folder / "test_source1.tsv").unlink()
    assert not run(spark, folder, MATCH)[0].passed


def test_examples_are_few_and_sorted(spark, folder):
    ids = ",".join(f"X{k}" for k in range(9, 0, -1))
    _, found = run(spark, folder, MATCH + f"S1-1\t{ids}\nS1-2\t\n")
    assert found["id of neither S2- nor S3-"][1:] == (9, ["X1", "X2", "X3", "X4", "X5"])
