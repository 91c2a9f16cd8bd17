"""A corpus of source code whose features follow from a number by arithmetic, for tests and oracle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (code, how often it occurs in file n as SQL)
SEGMENTS = (
    ("import os\nfrom sys import path, argv\n", "n % 3"),
    ("for i in range(3):\n    pass\n", "n % 4"),
    ("while x:\n    break\n", "n % 2"),
    ("if a and b:\n    pass\nelif c:\n    pass\n", "n % 5"),
    ("class K(B):\n    def m(self):\n        pass\n", "(n div 2) % 3"),
    ("def f(a: int):\n    if a:\n        return 42\n    return 7\n", "(n div 3) % 2"),
    ("try:\n    pass\nexcept:\n    pass\n", "(n div 4) % 2"),
    ("try:\n    pass\nexcept Exception:\n    pass\n", "(n div 5) % 2"),
    ("try:\n    pass\nexcept Exception:\n    raise\n", "(n div 6) % 2"),
    ("def r():\n    return r()\n", "(n div 7) % 2"),
    ("def s(a):\n    if a:\n        return a\n    return s(a)\n", "(n div 8) % 2"),
    ("def g():\n    global u, w\n    u = w\n", "(n div 9) % 2"),
    ("def d(a=[]):\n    return a\n", "(n div 10) % 2"),
    ("@wraps\ndef p(a, b, c, d, e, f, g, h):\n    return a\n", "(n div 11) % 2"),
    ("def q():\n" + "    pass\n" * 51, "(n div 12) % 2"),
    ("if a:\n if a:\n  if a:\n   if a:\n    if a:\n     if a:\n      pass\n", "(n div 13) % 2"),
    ("z = [i for i in y if i]\nk = lambda: (j for j in y)\nassert z\n", "n % 3"),
    ("# only a comment\n\nif __name__ == '__main__':\n    pass\n", "n % 2"),
    ("def (\n", "if(n % 11 = 0, 1, 0)"),
)


def source_corpus(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, filepath, code``: file n is its segments, each repeated as n says."""
    parts = [F.repeat(F.lit(code), F.expr(times).cast("int")) for code, times in SEGMENTS]
    rows = ids.select(F.col(id_col), F.col(id_col).alias("n")).withColumn("code", F.concat(*parts))
    return rows.select(id_col, F.concat(F.lit("repo/f"), F.col(id_col).cast("string"), F.lit(".py")).alias("filepath"), "code")
