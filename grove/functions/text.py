"""Text functions of source code: line counts, hashes, and removal of comments and docstrings."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def total_lines(code: Column) -> Column:
    return F.size(F.split(code, "\n", -1)).cast("long")


def code_lines(code: Column) -> Column:
    """Lines with something other than white space that isn't a comment."""
    return F.size(F.filter(F.split(code, "\n", -1), lambda x: x.rlike(r"(?U)^\s*[^\s#]"))).cast("long")


def code_hash(code: Column) -> Column:
    return F.sha2(code, 256)


def escaped(text: Column) -> Column:
    """HTML's five special characters as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def short_name(name: Column, n: int = 20) -> Column:
    return F.substring(name, 1, n)


def normalized(code: Column) -> Column:
    """No trailing blanks, at most two blank lines together, none at the ends, one final line feed; all blank: empty."""
    text = F.regexp_replace(code, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r"\A\n+|\n+\z", "")
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


#: White space other than the line feed, as Unicode (and the regular expression of ``normalized``) has it.
_BLANKS = "\t\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tidied(code: str) -> str:
    """What ``normalized`` makes of a text, line by line, for functions that hold the text anyway."""
    text = "\n".join([line.rstrip(_BLANKS) for line in code.split("\n")])
    text = re.sub("\n{4,}", "\n\n\n", text).strip("\n")
    return text + "\n" if text else ""


def without_docstrings(code: str) -> str:
    """Drops the lines of every leading string of a module, class or function; code that doesn't parse stays."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return code
    gone: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, clean=False) is not None:
            gone.update(range(node.body[0].lineno, node.body[0].end_lineno + 1))
    return "\n".join(line for i, line in enumerate(code.split("\n"), 1) if i not in gone)


def without_comments(code: str) -> str:
    """Drops comments; raises what the tokenizer raises."""
    kept = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type != tokenize.COMMENT]
    return tokenize.untokenize(kept)


def guarded(code: str | None, docs: bool = True, comments: bool = True) -> str | None:
    """Both removals, or the code as it was if either fails."""
    try:
        text = without_docstrings(code) if docs else code
        return without_comments(text) if comments else text
    except Exception:  # noqa: BLE001  whatever the tokenizer makes of odd input
        return code


def cleaned(code: Column, docs: bool = True, comments: bool = True) -> Column:
    """Cleaned source: Python's tokenizer does the removals batch by batch, and white space is normalised right there."""

    @F.pandas_udf("string")
    def strip(codes: pd.Series) -> pd.Series:
        out = []
        for c in codes:
            try:
                t = without_docstrings(c) if docs else c
                out.append(tidied(without_comments(t) if comments else t))
            except Exception:  # noqa: BLE001
                out.append(c)
        return pd.Series(out, dtype=object)

    return strip(code)


def write_cleaned(files: DataFrame, out: str) -> None:
    """Writes ``filepath, filename, code`` of ``files`` with the code cleaned; files without text are left out.

    Files of one name in different folders keep a row each.
    """
    rows = files.where("code is not null").select("filepath", basename(F.col("filepath")).alias("filename"), cleaned(F.col("code")).alias("code"))
    rows.write.mode("overwrite").parquet(out)
