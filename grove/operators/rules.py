"""Code smells as filters and joins over the node relation, and the risk score made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.operators.ast_table import ast_nodes

#: Severity weights, thresholds, and the rules in their order.
WEIGHTS = {"low": 5, "medium": 15, "high": 30, "critical": 50}
THRESHOLDS = {"max_nesting_depth": 5, "max_function_length": 50, "max_parameters": 7}
RULES = {
    "SYNTAX_ERROR": ("Syntax Error", "critical"), "BARE_EXCEPT": ("Bare Except Clause", "high"), "DEEP_NESTING": ("Deep Nesting", "medium"), "LONG_FUNCTION": ("Long Function", "low"), "TOO_MANY_ARGS": ("Too Many Arguments", "low"),
    "GLOBAL_USAGE": ("Global Variable Usage", "medium"), "MUTABLE_DEFAULT": ("Mutable Default Argument", "high"), "RECURSION_NO_BASE": ("Recursion Without Base Case", "high"), "BROAD_EXCEPTION": ("Broad Exception Handler", "low"),
    "UNUSED_VARIABLE": ("Unused Variable", "low"), "MAGIC_NUMBER": ("Magic Number", "low"),
}
MAGIC_MOST = 5
#: What the rules read of the node relation: these columns of these nodes.
COLUMNS = tuple(
    "filepath parse_ok err_kind err_line err_msg pre bfs_ord type lineno end_lineno block_depth funcs handlers if_funcs name ctx call_name call_is_name names n_params has_mutable_default is_bare handler_name const_repr is_magic assign_names".split()
)
TYPES = tuple("FunctionDef AsyncFunctionDef For While If With Try ExceptHandler Raise Return Global Assign Name Call Constant".split())


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def findings(nodes: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """``filepath, rule_id, rule_name, severity, message, line_number, ord``.

    What a node shows by itself is read off its row. What lies inside a function or handler comes from one aggregation:
    each node goes to the functions or handlers it carries, never by a range join; files are dealt out once for it.
    """
    t = THRESHOLDS | (thresholds or {})
    c, fits = F.col, nodes.where("parse_ok")
    is_def, is_handler = c("type").isin("FunctionDef", "AsyncFunctionDef"), c("type") == "ExceptHandler"

    def shown(when: Column, rule: str, message: Column, line: Column, order: Column, within: Column | None = None) -> Column:
        name, severity = RULES[rule]
        parts = {"rule_id": F.lit(rule), "rule_name": F.lit(name), "severity": F.lit(severity), "message": message, "line_number": line, "ord": order.cast("long"), "within": (F.lit(None) if within is None else within).cast("int")}
        return F.when(when, F.struct(*(x.alias(k) for k, x in parts.items())))

    def listed(rows: DataFrame, *lists: Column) -> DataFrame:
        return rows.select("filepath", F.explode(F.filter(F.concat(*lists), lambda x: x.isNotNull())).alias("x")).select("filepath", "x.*")

    long = c("end_lineno") - c("lineno") + 1
    alone = listed(
        nodes,
        F.array(
            shown(c("err_kind") == "syntax", "SYNTAX_ERROR", _text("does not parse: ", c("err_msg")), c("err_line"), F.lit(0)),
            shown(c("parse_ok") & is_handler & c("is_bare"), "BARE_EXCEPT", F.lit("handler without a type also stops interrupts and exits"), c("lineno"), c("bfs_ord")),
            shown(c("parse_ok") & c("type").isin("For", "While", "If", "With", "Try") & (c("block_depth") > t["max_nesting_depth"]), "DEEP_NESTING", _text("block at depth ", c("block_depth").cast("string")), c("lineno"), c("pre")),
            shown(c("parse_ok") & is_def & (long > t["max_function_length"]), "LONG_FUNCTION", _text(c("name"), " has ", long.cast("string"), " lines"), c("lineno"), c("bfs_ord")),
            shown(c("parse_ok") & is_def & (c("n_params") > t["max_parameters"]), "TOO_MANY_ARGS", _text(c("name"), " takes ", c("n_params").cast("string"), " arguments"), c("lineno"), c("bfs_ord")),
            shown(c("parse_ok") & (c("type") == "Global"), "GLOBAL_USAGE", _text("rebinds module names: ", F.array_join("names", ", ")), c("lineno"), c("bfs_ord")),
            shown(c("parse_ok") & is_def & c("has_mutable_default"), "MUTABLE_DEFAULT", _text("calls of ", c("name"), " share a default value that can change"), c("lineno"), c("bfs_ord")),
        ),
    ).drop("within")
    loads = (c("type") == "Name") & (c("ctx") == "Load")
    broad = is_handler & c("handler_name").isin("Exception", "BaseException")
    around = (
        F.when(is_def | broad, F.array("pre")).when(c("type") == "Return", c("if_funcs")).when((c("type") == "Raise") & c("is_bare"), c("handlers"))
        .when(c("call_is_name") | (c("type") == "Assign") | loads | c("is_magic"), c("funcs"))
    )
    kept = ["type", "bfs_ord", "lineno", "name", "handler_name", "call_name", "const_repr", "assign_names"]
    inside = fits.select("filepath", F.explode(around).alias("pre"), *kept).repartition("filepath")
    names = F.filter("assign_names", lambda x: ~x.startswith("_") & ~x.isin("self", "cls", "args", "kwargs"))
    by = inside.groupBy("filepath", "pre").agg(
        F.max(F.when(is_def | is_handler, F.struct(is_def.alias("is_def"), "name", "lineno", "bfs_ord", "handler_name"))).alias("me"),
        F.collect_set(F.when(c("type") == "Call", c("call_name"))).alias("called"),
        F.bool_or(c("type") == "Return").alias("based"), F.bool_or(c("type") == "Raise").alias("again"),
        F.collect_set(F.when(c("type") == "Assign", names)).alias("given"), F.collect_set(F.when(c("type") == "Name", c("name"))).alias("used"),
        F.collect_list(F.when(c("type") == "Constant", F.struct("bfs_ord", "lineno", "const_repr"))).alias("magic"),
    ).select("*", "me.*")
    unused = F.array_except(F.flatten("given"), c("used"))
    deep = listed(
        by,
        F.array(
            shown(c("is_def") & F.array_contains("called", c("name")) & ~c("based"), "RECURSION_NO_BASE", _text(c("name"), " calls itself and returns under no condition"), c("lineno"), c("bfs_ord")),
            shown(~c("is_def") & ~c("again"), "BROAD_EXCEPTION", _text("handler of any ", c("handler_name"), " that raises nothing again"), c("lineno"), c("bfs_ord")),
        ),
        F.transform(unused, lambda x: shown(c("is_def"), "UNUSED_VARIABLE", _text(c("name"), " never reads ", x), c("lineno"), c("bfs_ord"))),
        F.transform(F.slice(F.array_sort("magic"), 1, MAGIC_MOST), lambda x: shown(c("is_def"), "MAGIC_NUMBER", _text("unnamed constant ", x["const_repr"]), x["lineno"], x["bfs_ord"], c("bfs_ord"))),
    )
    k = F.when(c("rule_id") == "MAGIC_NUMBER", F.row_number().over(Window.partitionBy("filepath", "rule_id").orderBy("within", "ord")))
    deep = deep.withColumn("k", k).where(c("k").isNull() | (c("k") <= MAGIC_MOST)).withColumn("ord", F.coalesce(c("k").cast("long"), "ord"))
    return alone.unionByName(deep.drop("within", "k"))


def score(total: Column) -> Column:
    """0 to 100 from the sum of severity weights."""
    return F.coalesce(F.round(100 * (1 - F.exp(-total / 50)), 1), F.lit(0.0))


def risk(found: DataFrame, files: DataFrame, path_col: str = "filepath") -> DataFrame:
    """Risk score, number of findings and counts by severity of every file in ``files``; none: zeros, a syntax error: 100."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("severity"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS]
    by = found.groupBy("filepath").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), F.bool_or(F.col("rule_id") == "SYNTAX_ERROR").alias("_broken"), *counts)
    rows = files.select(F.col(path_col).cast("string").alias("filepath")).join(by, "filepath", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.strip("_"))
    return rows.select("filepath", F.when(F.col("_broken"), 100.0).otherwise(score(F.col("_w"))).alias("risk_score"), zero("_n").alias("risk_findings"), *(zero(s) for s in WEIGHTS))


def band(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def reports(found: DataFrame, files: DataFrame, path_col: str = "filepath") -> DataFrame:
    """``risk`` with the findings themselves and whether any is critical or high."""
    lists = found.groupBy("filepath").agg(F.array_sort(F.collect_list(F.struct(F.array_position(F.lit(list(RULES)), F.col("rule_id")).alias("rule"), "ord", "rule_id", "rule_name", "severity", "message", "line_number"))).alias("findings"))
    return risk(found, files, path_col).join(lists, "filepath", "left").withColumns({"has_critical": F.col("critical") > 0, "has_high": F.col("high") > 0})


def check_code(spark: SparkSession, code: str, filepath: str = "<code>", thresholds: dict | None = None) -> DataFrame:
    """The report of one snippet, by the same plan as whole corpora."""
    files = spark.createDataFrame([(filepath, code)], "filepath string, code string")
    return reports(findings(ast_nodes(files), thresholds), files)
