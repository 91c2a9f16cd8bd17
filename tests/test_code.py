"""Syntax trees, features and rules of small snippets."""

from __future__ import annotations

import fnmatch
import re

import pytest

from grove.functions.text import guarded, normalized, without_comments, without_docstrings
from grove.operators import ast_table, rules, structural
from grove.sources.files import glob_regex


def nodes(spark, *codes):
    files = spark.createDataFrame([(f"f{i}.py", c) for i, c in enumerate(codes)], "filepath string, code string")
    return files, ast_table.ast_nodes(files)


def features(spark, code):
    files, n = nodes(spark, code)
    return structural.structural(n, files).first()


def found(spark, code):
    return sorted((r["rule_id"], r["line_number"], r["message"]) for r in rules.findings(nodes(spark, code)[1]).collect())


def test_bad_code_has_one_row_and_no_features(spark):
    files, n = nodes(spark, "def broken(:", "x = 1", None)
    assert n.where("not parse_ok and err_kind = 'syntax'").count() == 1
    assert [r["filepath"] for r in structural.structural(n, files).collect()] == ["f1.py"]


def test_functions_classes_imports(spark):
    code = "import a.b as c, d\nfrom . import e\nclass K(Base, m.Other):\n    def go(self, x, *y, z=1, **w):\n        return x.f(g(1))\nasync def h():\n    pass\n"
    _, n = nodes(spark, code)
    f = {r["name"]: r for r in ast_table.functions(n).collect()}
    assert f["go"]["args"] == ["self", "x", "z", "*y", "**w"] and f["go"]["num_args"] == 3 and f["go"]["calls"] == ["f", "g"] and f["go"]["has_return"]
    assert f["h"]["is_async"] and not f["h"]["has_return"]
    k = ast_table.classes(n).first()
    assert k["bases"] == ["Base", "Other"] and k["methods"] == ["go"]
    assert sorted((r["module"], tuple(r["names"])) for r in ast_table.imports(n).collect()) == [("", ("e",)), ("a.b", ("c",)), ("d", ("d",))]


def test_nesting_counts_functions_and_elif(spark):
    assert features(spark, "def f():\n for a in b:\n  for c in d:\n   for e in g:\n    if e:\n     pass\n")["max_nesting_depth"] == 5
    assert features(spark, "if a:\n  pass\nelif b:\n  pass\nelif c:\n  pass\n")["max_nesting_depth"] == 3


def test_complexity_and_recursion(spark):
    row = features(spark, "def f(n: int):\n    if n and n > 1 or n == 0:\n        return f(n - 1)\n    return [x for x in y if x if z]\n")
    assert (row["cyclomatic_complexity"], row["recursion_count"], row["has_recursion"], row["has_type_hints"]) == (1 + 1 + 2 + 2, 1, True, True)
    assert features(spark, "def f():\n    def g():\n        f()\n    g()\n")["recursion_count"] == 0


@pytest.mark.parametrize(
    ("rule", "bad", "good"),
    [
        ("BARE_EXCEPT", "try:\n    pass\nexcept:\n    pass\n", "try:\n    pass\nexcept E:\n    pass\n"),
        ("DEEP_NESTING", "".join(" " * i + "if a:\n" for i in range(6)) + " " * 6 + "pass\n", "".join(" " * i + "if a:\n" for i in range(5)) + " " * 5 + "pass\n"),
        ("LONG_FUNCTION", "def f():\n" + "    pass\n" * 50, "def f():\n" + "    pass\n" * 49),
        ("TOO_MANY_ARGS", "def f(a, b, c, d, e, f, g, h): pass\n", "def f(self, b, c, d, e, f, g, h): pass\n"),
        ("GLOBAL_USAGE", "def f():\n    global a, b\n", "def f():\n    nonlocal_ = 1\n    return nonlocal_\n"),
        ("MUTABLE_DEFAULT", "def f(*, a={}): pass\n", "def f(a=dict()): pass\n"),
        ("RECURSION_NO_BASE", "def f():\n    return f()\n", "def f(n):\n    if n:\n        return 1\n    return f(n)\n"),
        ("BROAD_EXCEPTION", "try:\n    pass\nexcept Exception:\n    x()\n", "try:\n    pass\nexcept Exception:\n    if a:\n        raise\n"),
        ("UNUSED_VARIABLE", "def f():\n    a = 1\n", "def f():\n    _a = 1\n    b, c = 1, 2\n    d = 1\n    return d\n"),
        ("MAGIC_NUMBER", "def f():\n    return 3.5\n", "def f():\n    return [0, 1, 2, -1, 10, 100]\nx = 3.5\n"),
    ],
)
def test_rules(spark, rule, bad, good):
    assert rule in {r for r, _, _ in found(spark, bad)}
    assert rule not in {r for r, _, _ in found(spark, good)}


def test_magic_numbers_stop_at_five_and_repeat_for_nested_functions(spark):
    assert [m for r, _, m in found(spark, "def f():\n    def g():\n        return 7\n") if r == "MAGIC_NUMBER"] == ["unnamed constant 7"] * 2
    assert sum(r == "MAGIC_NUMBER" for r, _, _ in found(spark, "def f():\n    return [3, 4, 5, 6, 7, 8, 9]\n")) == 5


def test_scores(spark):
    bad = rules.check_code(spark, "def (").first()
    assert bad["risk_score"] == 100.0 and bad["critical"] == 1 and bad["has_critical"]
    assert rules.check_code(spark, "x = 1\n").first()["risk_score"] == 0.0
    assert rules.check_code(spark, "try:\n    pass\nexcept:\n    pass\n").first()["risk_score"] == 45.1


def test_graph_caps_and_lone_node(spark):
    _, n = nodes(spark, "x = 1", "")
    assert ast_table.graph_nodes(n, most_nodes=0).count() == 0
    edges = [(r["src"], r["dst"]) for r in ast_table.graph_edges(n).where("filepath = 'f1.py'").collect()]
    assert edges == [(0, 0)]
    assert ast_table.graph_edges(n).where("filepath = 'f0.py'").count() == 2 * (n.where("filepath = 'f0.py'").count() - 1)


def test_cleaning(spark):
    code = '"""doc"""\nx = "# kept"  # gone\ndef f():\n    """doc"""\n    return 1\n'
    assert without_docstrings(code) == 'x = "# kept"  # gone\ndef f():\n    return 1\n'
    assert "gone" not in without_comments(code) and "# kept" in without_comments(code)
    assert guarded("def (\n") == "def (\n"
    df = spark.createDataFrame([("a  \n\n\n\n\n\nb\t\n\n",), (" \n",), ("",)], "c string")
    assert [r[0] for r in df.select(normalized(df["c"])).collect()] == ["a\n\n\nb\n", "", ""]


@pytest.mark.parametrize("pattern", ["**/test_*.py", "**/tests/**", "setup.py", "[!a]?.py", "a[b-d].py", "x.+(y)"])
@pytest.mark.parametrize("path", ["test_x.py", "a/test_x.py", "tests/a.py", "/r/tests/a.py", "setup.py", "bb.py", "ab.py", "ac.py", "x.+(y)", "xx+(y)"])
def test_globs(pattern, path):
    mine = glob_regex(pattern).replace(r"(?s)\A", "").replace(r"\z", "")
    assert bool(re.fullmatch(mine, path, re.DOTALL)) == fnmatch.fnmatchcase(path, pattern)
