"""Source code as a relation: one row for each node of its syntax tree, made in a single pass over each file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node types with a number of their own, in order; all others share the next number.
NODE_TYPES = (
    "Module FunctionDef AsyncFunctionDef ClassDef Return Delete Assign AugAssign AnnAssign For AsyncFor While If With AsyncWith Match Raise Try Assert Import ImportFrom "
    "Global Nonlocal Expr Pass Break Continue BoolOp NamedExpr BinOp UnaryOp Lambda IfExp Dict Set ListComp SetComp DictComp GeneratorExp Await Yield YieldFrom Compare Call "
    "FormattedValue JoinedStr Constant Attribute Subscript Starred Name List Tuple Slice Load Store Del arg arguments alias ExceptHandler"
).split()
TYPE_ID = {name: i for i, name in enumerate(NODE_TYPES)}
MAX_NODES, MAX_EDGES = 5000, 50_000
_DEFS, _BLOCKS = (ast.FunctionDef, ast.AsyncFunctionDef), (ast.For, ast.While, ast.If, ast.With, ast.Try)

SCHEMA = """filepath string, parse_ok boolean, err_kind string, err_line int, err_msg string, pre int, post_max int, parent_pre int, bfs_ord int, type string, type_id int, lineno int, end_lineno int, nest_depth int, block_depth int, func_pre int, func_name string, funcs array<int>, handlers array<int>, if_funcs array<int>, name string, ctx string, call_name string, call_is_name boolean, cc_weight int, names array<string>, decorators array<string>, n_decorators int, args array<string>, num_args int, n_params int, has_hint boolean, has_mutable_default boolean, is_bare boolean, handler_name string, bases array<string>, const_repr string, is_magic boolean, assign_names array<string>"""
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
COLUMNS = [tuple(c.split()) for c in SCHEMA.replace("\n", " ").split(", ")]

#: What these relations read: columns, and node types (summaries count all).
OF_FUNCTIONS = {"columns": tuple("filepath pre bfs_ord type funcs name call_name lineno end_lineno num_args args decorators".split()), "types": ("FunctionDef", "AsyncFunctionDef", "Call", "Return")}
OF_CLASSES = {"columns": tuple("filepath pre parent_pre bfs_ord type name lineno end_lineno bases decorators".split()), "types": ("FunctionDef", "AsyncFunctionDef", "ClassDef")}
OF_IMPORTS = {"columns": ("filepath", "bfs_ord", "type", "name", "args", "names"), "types": ("Import", "ImportFrom")}
OF_SUMMARIES = ("filepath", "parse_ok", "bfs_ord", "type", "name", "args", "names")


def _called(f: ast.expr) -> tuple[str | None, bool]:
    if isinstance(f, ast.Name):
        return f.id, True
    return (f.attr, False) if isinstance(f, ast.Attribute) else (None, False)


def _of_function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    a = node.args
    names = [x.arg for x in a.args]
    more = [x.arg for x in a.kwonlyargs] + ["*" + x.arg for x in [a.vararg] if x] + ["**" + x.arg for x in [a.kwarg] if x]
    total = len(names) + len(more) - (names[:1] in (["self"], ["cls"]))
    deco = [d.id if isinstance(d, ast.Name) else d.func.id for d in node.decorator_list if isinstance(d, ast.Name) or isinstance(d, ast.Call) and isinstance(d.func, ast.Name)]
    mutable = any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*a.defaults, *a.kw_defaults])
    return {"name": node.name, "args": names + more, "num_args": len(names) + len(a.kwonlyargs), "n_params": total, "decorators": deco, "n_decorators": len(node.decorator_list), "has_hint": bool(node.returns or any(x.annotation for x in a.args)), "has_mutable_default": mutable}


def _of_class(node: ast.ClassDef) -> dict:
    bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
    return {"name": node.name, "bases": bases, "decorators": [d.id for d in node.decorator_list if isinstance(d, ast.Name)], "n_decorators": len(node.decorator_list)}


def _of_number(node: ast.Constant) -> dict:
    if not isinstance(node.value, (int, float)):
        return {}
    return {"const_repr": str(node.value), "is_magic": bool(abs(node.value) > 2 and abs(node.value) not in (10, 100))}


def _one(node: ast.AST) -> dict:
    return {"cc_weight": 1}


#: What nodes of a type add to the columns that all nodes have.
_FACTS = {
    ast.FunctionDef: _of_function, ast.AsyncFunctionDef: _of_function, ast.ClassDef: _of_class, ast.Constant: _of_number, ast.If: _one, ast.While: _one, ast.For: _one,
    ast.Name: lambda n: {"name": n.id, "ctx": type(n.ctx).__name__}, ast.arg: lambda n: {"name": n.arg}, ast.Call: lambda n: dict(zip(("call_name", "call_is_name"), _called(n.func), strict=True)),
    ast.Import: lambda n: {"names": [x.asname or x.name for x in n.names], "args": [x.name for x in n.names]}, ast.ImportFrom: lambda n: {"name": n.module or "", "names": [x.name for x in n.names]},
    ast.Global: lambda n: {"names": list(n.names)}, ast.Assign: lambda n: {"assign_names": [t.id for t in n.targets if isinstance(t, ast.Name)]}, ast.Raise: lambda n: {"is_bare": n.exc is None},
    ast.ExceptHandler: lambda n: {"is_bare": n.type is None, "handler_name": n.type.id if isinstance(n.type, ast.Name) else None, "cc_weight": 1},
    ast.BoolOp: lambda n: {"cc_weight": len(n.values) - 1}, ast.comprehension: lambda n: {"cc_weight": len(n.ifs)},
}
#: Columns that every node has; the others are kept as places and values.
_DENSE = ("filepath", "pre", "post_max", "parent_pre", "bfs_ord", "type", "type_id", "lineno", "end_lineno", "nest_depth", "block_depth", "func_pre", "func_name", "funcs", "handlers", "if_funcs")


class NodeColumns:
    """The node relation of some files, column by column, of the asked columns and node types; files that don't parse have a row."""

    def __init__(self, columns: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None):
        self.columns = [c for c in COLUMNS if columns is None or c[0] in columns]
        self.types, self.size = None if types is None else set(types), 0
        self.dense: dict[str, list] = {name: [] for name in _DENSE}
        self.sparse: dict[str, tuple[list[int], list]] = {name: ([], []) for name, _ in COLUMNS if name not in _DENSE}

    def _put(self, facts: dict) -> None:
        for name, value in facts.items():
            at, values = self.sparse[name]
            at.append(self.size)
            values.append(value)

    def _failed(self, path: str, facts: dict) -> None:
        self._put({"parse_ok": False} | facts)
        for name, column in self.dense.items():
            column.append(path if name == "filepath" else None)
        self.size += 1

    def add(self, path: str, code: str) -> None:
        """The nodes of one file: one row without a node if it doesn't parse."""
        try:
            tree = ast.parse(code)
        except SyntaxError as e:
            return self._failed(path, {"err_kind": "syntax", "err_line": e.lineno, "err_msg": str(e)})
        except (ValueError, RecursionError, MemoryError, TypeError) as e:
            return self._failed(path, {"err_kind": type(e).__name__, "err_msg": str(e)})
        parents, depths, kept, rows, types, facts = [], [], [], [], self.types, _FACTS
        todo = [(tree, None, 0, 0, 0, None, None, [], [], None)]
        while todo:
            node, parent, depth, nest, block, func, name, funcs, handlers, if_funcs = todo.pop()
            me, of = len(parents), type(node)
            if of in _DEFS:
                func, name, funcs, nest = me, node.name, [*funcs, me], nest + 1
            elif of in _BLOCKS:
                nest, block = nest + 1, block + 1
                if_funcs = funcs if of is ast.If else if_funcs
            elif of is ast.ExceptHandler:
                handlers = [*handlers, me]
            parents.append(parent)
            depths.append(depth)
            kind = of.__name__
            if types is None or kind in types:
                kept.append(me)
                rows.append((kind, TYPE_ID.get(kind, len(NODE_TYPES)), getattr(node, "lineno", None), getattr(node, "end_lineno", None), nest, block, func, name, funcs, handlers, if_funcs))
                if of in facts:
                    self._put(facts[of](node))
                self.size += 1
            below = []
            for field in node._fields:
                value = getattr(node, field, None)
                if isinstance(value, ast.AST):
                    below.append((value, me, depth + 1, nest, block, func, name, funcs, handlers, if_funcs))
                elif isinstance(value, list):
                    below += [(c, me, depth + 1, nest, block, func, name, funcs, handlers, if_funcs) for c in value if isinstance(c, ast.AST)]
            below.reverse()
            todo += below
        if not kept:
            return None
        ends = list(range(len(parents)))
        for me in range(len(parents) - 1, 0, -1):
            up = parents[me]
            if ends[me] > ends[up]:
                ends[up] = ends[me]
        order = np.empty(len(parents), np.int64)  # nodes of one depth stand in the order in which they are passed
        order[np.argsort(depths, kind="stable")] = np.arange(len(parents))
        order = order.tolist()
        d = self.dense
        d["filepath"] += [path] * len(kept)
        d["pre"] += kept
        for column, values in (("post_max", ends), ("parent_pre", parents), ("bfs_ord", order)):
            d[column] += [values[me] for me in kept]
        for column, values in zip(_DENSE[5:], zip(*rows, strict=True), strict=True):
            d[column] += values
        return None

    def batch(self) -> pa.RecordBatch:
        """All rows so far."""
        arrays = []
        for name, kind in self.columns:
            if name in _DENSE:
                arrays.append(pa.array(self.dense[name], _ARROW[kind]))
                continue
            at, values = self.sparse[name]
            where = np.full(self.size, -1, np.int64)
            where[at] = np.arange(len(at))
            filled = pa.array(values, _ARROW[kind]).take(pa.array(where, mask=where < 0))
            if name in ("parse_ok", "cc_weight"):  # nodes have parsed, and weigh nothing unless they say so
                node = pa.array([p is not None for p in self.dense["pre"]])
                filled = pc.if_else(node, pc.fill_null(filled, True if name == "parse_ok" else 0), filled)
            arrays.append(filled)
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in self.columns])


def ast_nodes(files: DataFrame, path_col: str = "filepath", code_col: str = "code", columns: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """The node relation of all files, so that no file is parsed twice; of some columns and node types if asked."""
    kinds = ", ".join(f"{n} {k}" for n, k in COLUMNS if columns is None or n in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = NodeColumns(columns, types)
        for batch in batches:
            for path, code in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if code is not None:
                    made.add(path, code)
                if made.size > 20_000:
                    yield made.batch()
                    made = NodeColumns(columns, types)
        yield made.batch()

    return files.select(F.col(path_col).cast("string").alias("filepath"), F.col(code_col).alias("code")).mapInArrow(run, kinds)


def functions(nodes: DataFrame) -> DataFrame:
    """Every function: its parameters, decorators, calls in its subtree (breadth first) and whether anything returns."""
    defs = nodes.where("type in ('FunctionDef', 'AsyncFunctionDef')")
    inside = nodes.where("type in ('Call', 'Return')").select("filepath", F.explode("funcs").alias("pre"), "bfs_ord", "type", "call_name")
    seen = inside.groupBy("filepath", "pre").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("call_name").isNotNull(), F.struct("bfs_ord", "call_name")))), lambda x: x["call_name"]).alias("calls"), F.bool_or(F.col("type") == "Return").alias("has_return"),
    )
    return defs.join(seen, ["filepath", "pre"], "left").select("filepath", "bfs_ord", "name", "lineno", "end_lineno", "num_args", "args", "decorators", F.coalesce("calls", F.expr("cast(array() AS array<string>)")).alias("calls"), F.coalesce("has_return", F.lit(False)).alias("has_return"), (F.col("type") == "AsyncFunctionDef").alias("is_async"))


def classes(nodes: DataFrame) -> DataFrame:
    """Every class: bases, decorators and the names of functions that stand right in its body."""
    methods = nodes.where("type in ('FunctionDef', 'AsyncFunctionDef')").groupBy("filepath", F.col("parent_pre").alias("pre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bfs_ord", "name"))), lambda x: x["name"]).alias("methods"))
    rows = nodes.where("type = 'ClassDef'").join(methods, ["filepath", "pre"], "left")
    return rows.select("filepath", "bfs_ord", "name", "lineno", "end_lineno", "bases", "decorators", F.coalesce("methods", F.expr("cast(array() AS array<string>)")).alias("methods"))


def imports(nodes: DataFrame) -> DataFrame:
    """A row for each name of an import statement, one for each from-import."""
    plain = nodes.where("type = 'Import'").select("filepath", "bfs_ord", F.posexplode(F.arrays_zip("args", "names")).alias("k", "x")).select("filepath", "bfs_ord", "k", F.col("x.args").alias("module"), F.array("x.names").alias("names"), F.lit(False).alias("is_from_import"))
    other = nodes.where("type = 'ImportFrom'").select("filepath", "bfs_ord", F.lit(0).alias("k"), F.col("name").alias("module"), "names", F.lit(True).alias("is_from_import"))
    return plain.unionByName(other)


def node_counts(nodes: DataFrame) -> DataFrame:
    by = nodes.where("parse_ok").groupBy("filepath", "type").count()
    return by.groupBy("filepath").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("node_counts"))


def summaries(nodes: DataFrame) -> DataFrame:
    """Counts of functions, classes and imported names, and node counts, of each file that parses."""
    n = imports(nodes).groupBy("filepath").agg(F.count("*").alias("import_count"))
    by = nodes.where("parse_ok").groupBy("filepath").agg(F.count_if(F.col("type").isin("FunctionDef", "AsyncFunctionDef")).alias("function_count"), F.count_if(F.col("type") == "ClassDef").alias("class_count"), F.count("*").alias("total_nodes"))
    return by.join(n, "filepath", "left").join(node_counts(nodes), "filepath").withColumn("import_count", F.coalesce("import_count", F.lit(0)))


def graph_nodes(nodes: DataFrame, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES) -> DataFrame:
    """``filepath, node_id, type_id`` of files whose tree is no larger than the caps."""
    fits = nodes.where("parse_ok").groupBy("filepath").agg(F.count("*").alias("n")).where((F.col("n") <= most_nodes) & (2 * (F.col("n") - 1) <= most_edges))
    return nodes.join(fits.select("filepath"), "filepath", "left_semi").select("filepath", F.col("pre").alias("node_id"), "type_id")


def graph_edges(nodes: DataFrame, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES) -> DataFrame:
    """``filepath, src, dst``: each tree edge both ways; a lone node points to itself."""
    kept = nodes.join(graph_nodes(nodes, most_nodes, most_edges).select("filepath").distinct(), "filepath", "left_semi")
    down = kept.where("parent_pre is not null").select("filepath", F.col("parent_pre").alias("src"), F.col("pre").alias("dst"))
    lone = kept.where("parent_pre is null and post_max = 0").select("filepath", F.lit(0).alias("src"), F.lit(0).alias("dst"))
    return down.unionByName(down.select("filepath", F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(lone)


def one_hot(type_id, width: int = len(NODE_TYPES) + 1):
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == type_id).cast("float"))
