"""The 25 structural features of a file, as one aggregation over its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.text import basename, code_lines, total_lines

#: The features in their order.
FEATURES = (
    "loop_count for_loop_count while_loop_count if_count function_count class_count import_count max_nesting_depth avg_function_length max_function_length cyclomatic_complexity "
    "has_recursion recursion_count try_except_count bare_except_count global_var_count assertion_count lambda_count comprehension_count generator_count decorator_count total_lines "
    "code_lines has_main_guard has_type_hints"
).split()
#: What the features read of the node relation: these columns of these nodes (a file has a module at least).
COLUMNS = tuple("filepath parse_ok pre type lineno end_lineno nest_depth func_name call_name call_is_name cc_weight names n_decorators has_hint is_bare".split())
TYPES = tuple("Module FunctionDef AsyncFunctionDef ClassDef For While If With Try Import ImportFrom ExceptHandler Global Assert Lambda ListComp SetComp DictComp GeneratorExp Call BoolOp comprehension".split())


def _n(*types: str) -> Column:
    return F.count_if(F.col("type").isin(*types))


def structural(nodes: DataFrame, files: DataFrame, path_col: str = "filepath", code_col: str = "code") -> DataFrame:
    """A row for each file that parses: its path, name and features. Nodes are reduced before files are joined."""
    is_def = F.col("type").isin("FunctionDef", "AsyncFunctionDef")
    length = F.when(is_def, F.col("end_lineno") - F.col("lineno") + 1)
    calls_itself = F.when(F.col("call_is_name") & (F.col("call_name") == F.col("func_name")), F.col("call_name"))
    agg = nodes.where("parse_ok").groupBy("filepath").agg(
        _n("For", "While").alias("loop_count"), _n("For").alias("for_loop_count"), _n("While").alias("while_loop_count"), _n("If").alias("if_count"),
        _n("FunctionDef", "AsyncFunctionDef").alias("function_count"), _n("ClassDef").alias("class_count"), _n("Import", "ImportFrom").alias("import_count"),
        F.max("nest_depth").cast("long").alias("max_nesting_depth"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_function_length"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_function_length"),
        (1 + F.sum("cc_weight")).cast("long").alias("cyclomatic_complexity"), F.size(F.collect_set(calls_itself)).cast("long").alias("recursion_count"),
        _n("Try").alias("try_except_count"), F.count_if((F.col("type") == "ExceptHandler") & F.col("is_bare")).alias("bare_except_count"),
        F.coalesce(F.sum(F.when(F.col("type") == "Global", F.size("names"))), F.lit(0)).cast("long").alias("global_var_count"),
        _n("Assert").alias("assertion_count"), _n("Lambda").alias("lambda_count"), _n("ListComp", "SetComp", "DictComp").alias("comprehension_count"), _n("GeneratorExp").alias("generator_count"),
        F.coalesce(F.sum("n_decorators"), F.lit(0)).cast("long").alias("decorator_count"), F.coalesce(F.bool_or("has_hint"), F.lit(False)).alias("has_type_hints"),
    )
    text = F.col(code_col)
    lines = files.select(F.col(path_col).cast("string").alias("filepath"), total_lines(text).alias("total_lines"), code_lines(text).alias("code_lines"), F.contains(text, F.lit("if __name__")).alias("has_main_guard"))
    out = agg.join(lines, "filepath").withColumn("has_recursion", F.col("recursion_count") > 0)
    return out.select("filepath", basename(F.col("filepath")).alias("filename"), *FEATURES)


def available(df: DataFrame, names=FEATURES) -> list[str]:
    """Those feature columns that a table has, in their order; none is an error."""
    if not (found := [n for n in names if n in df.columns]):
        raise ValueError("the table has none of the feature columns")
    return found


def vector(df: DataFrame, names: list[str] | None = None) -> Column:
    """The features as an array of doubles; booleans count as 0 and 1."""
    return F.array(*(F.col(n).cast("int").cast("double") if df.schema[n].dataType.typeName() == "boolean" else F.col(n).cast("double") for n in names or available(df)))


def failures(nodes: DataFrame) -> DataFrame:
    """Files parsed and not."""
    one = nodes.where("pre is null or pre = 0")
    return one.agg(F.count_if("parse_ok").alias("parsed"), F.count_if(~F.col("parse_ok")).alias("failed"))
