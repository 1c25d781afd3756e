"""Licence files at the root of a tree."""

from recordloom.llm import licenses


def test_licence_at_the_root_of_relative_paths(spark):
    mit, isc = "Released under the MIT License.", "Released under the ISC License."
    rows = [("LICENSE", mit), ("src/a.py", "x"), ("b.py", "x"), ("lib/LICENSE", isc), ("lib/deep/c.py", "x"), ("/abs/d.py", "x"), ("/e.py", "x"), (None, "x")]
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    nothing = (None, None)
    assert got == {
        "LICENSE": ("MIT", None), "src/a.py": ("MIT", ""), "b.py": ("MIT", ""), "lib/LICENSE": ("ISC", None), "lib/deep/c.py": ("ISC", "lib"),
        "/abs/d.py": nothing, "/e.py": nothing, None: nothing,
    }


def test_licence_at_the_root_of_absolute_paths(spark):
    rows = [("/LICENSE", "Released under the MIT License."), ("/src/a.py", "x"), ("src/a.py", "x")]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"/LICENSE": "MIT", "/src/a.py": "MIT", "src/a.py": None}
