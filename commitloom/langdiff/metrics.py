"""Static metrics of Python sources, and what a commit changes in their syntax trees.

A tree diff pairs statements of both versions whose trees are equal, in order,
level by level; what stays unpaired was changed.  Docstrings and comments do not
count.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
import warnings
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp, ast.comprehension)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef)
METRICS = "nodes int, cc int, lloc int, sloc int, functions int, classes int, halstead double, mi double, stmt_depth int, expr_depth int, max_depth int, sum_of_depth int, instances int"


def parse(source: str | None) -> ast.Module | None:
    """The tree of a source, null if it is no Python 3."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def without_docstrings(tree: ast.AST) -> ast.AST:
    """The tree with docstrings made ``pass``, in place."""
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, *SCOPES)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                node.body[0] = ast.copy_location(ast.Pass(), first)
    return tree


def complexity(tree: ast.AST) -> int:
    """Decision points plus one per function (plus one for the module)."""
    n = 1
    for node in ast.walk(tree):
        if isinstance(node, DECISIONS):
            n += 1
        elif isinstance(node, ast.BoolOp):
            n += len(node.values) - 1
        elif isinstance(node, SCOPES):
            n += 1
    return n


def depths(tree: ast.AST) -> tuple[int, int, list[int]]:
    """Greatest depth of statements, of expressions, and the depth of every leaf."""
    stmt = expr = 0
    leaves: list[int] = []
    stack = [(tree, 0, 0, 0)]
    while stack:
        node, d, s, e = stack.pop()
        s += isinstance(node, ast.stmt)
        e = e + 1 if isinstance(node, ast.expr) else 0
        stmt, expr = max(stmt, s), max(expr, e)
        below = list(ast.iter_child_nodes(node))
        if not below:
            leaves.append(d)
        stack += [(c, d + 1, s, e) for c in below]
    return stmt, expr, leaves


def halstead(source: str) -> float:
    """Volume: tokens times the logarithm of distinct ones."""
    try:
        toks = [(t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type in (tokenize.NAME, tokenize.OP, tokenize.NUMBER, tokenize.STRING)]
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return 0.0
    return len(toks) * math.log2(max(2, len(set(toks)))) if toks else 0.0


def measure(source: str) -> dict | None:
    """All metrics of a source, null if it does not parse."""
    tree = parse(source)
    if tree is None:
        return None
    nodes = list(ast.walk(tree))
    stmt, expr, leaves = depths(tree)
    sloc = sum(1 for x in source.split("\n") if x.strip() and not x.strip().startswith("#"))
    volume, cc = halstead(source), complexity(tree)
    mi = max(0.0, (171 - 5.2 * math.log(max(volume, 1)) - 0.23 * cc - 16.2 * math.log(max(sloc, 1))) * 100 / 171)
    return {"nodes": len(nodes), "cc": cc, "lloc": sum(isinstance(n, ast.stmt) for n in nodes), "sloc": sloc, "functions": sum(isinstance(n, SCOPES) for n in nodes), "classes": sum(isinstance(n, ast.ClassDef) for n in nodes), "halstead": volume, "mi": mi, "stmt_depth": stmt, "expr_depth": expr, "max_depth": max(leaves, default=0), "sum_of_depth": sum(leaves), "instances": len(leaves)}


def node_counts(source: str) -> dict[str, int]:
    """How many nodes of each type a source has; empty if it does not parse."""
    tree = parse(source)
    return dict(Counter(type(n).__name__ for n in ast.walk(tree))) if tree else {}


def _key(node: ast.stmt) -> str:
    return ast.dump(node)


def _unpaired(old: list[ast.stmt], new: list[ast.stmt]) -> Iterator[tuple[list[ast.stmt], list[ast.stmt]]]:
    """Statements without an equal partner, the inner ones where outer ones pair by kind and name."""
    match = SequenceMatcher(None, [_key(x) for x in old], [_key(x) for x in new], autojunk=False)
    for tag, a, b, c, d in match.get_opcodes():
        if tag == "equal":
            continue
        left, right = list(old[a:b]), list(new[c:d])
        for x in list(left):
            twin = next((y for y in right if type(x) is type(y) and getattr(x, "name", None) == getattr(y, "name", None) and hasattr(x, "body")), None)
            if twin is None:
                continue
            left.remove(x)
            right.remove(twin)
            if _header(x) != _header(twin):
                yield [_shell(x)], [_shell(twin)]
            for part in ("body", "orelse", "finalbody"):
                yield from _unpaired(getattr(x, part, []) or [], getattr(twin, part, []) or [])
            hx, hy = getattr(x, "handlers", []), getattr(twin, "handlers", [])
            yield from _unpaired([s for h in hx for s in h.body], [s for h in hy for s in h.body])
        # code moved into a try: compare with what the try holds
        wrapped = [y for y in right if isinstance(y, ast.Try)]
        if left and wrapped:
            right.remove(wrapped[0])
            yield [], [_shell(wrapped[0])]
            yield from _unpaired(left, wrapped[0].body)
            left = []
        if left or right:
            yield left, right


def _header(node: ast.stmt) -> str:
    return ast.dump(_shell(node))


def _shell(node: ast.stmt) -> ast.stmt:
    """A compound statement without what it holds."""
    fields = {k: ([] if k in ("body", "orelse", "finalbody", "handlers") else v) for k, v in ast.iter_fields(node)}
    return ast.copy_location(type(node)(**fields), node)


def compare(old: str | None, new: str | None) -> dict:
    """What changed from the parent's source to the child's: counts, and the parent's line ranges; ``invalid`` if one does not parse."""
    a, b = parse(old) if old is not None else ast.Module([], []), parse(new) if new is not None else ast.Module([], [])
    if a is None or b is None:
        return {"invalid": True, "changes": None, "cc": None, "new_functions": None, "new_classes": None, "ranges": []}
    without_docstrings(a)
    without_docstrings(b)
    changes = cc = functions = classes = 0
    ranges: list[tuple[int, int]] = []
    for left, right in _unpaired(a.body, b.body):
        for node in right:
            inner = list(ast.walk(node))
            changes += len(inner)
            cc += sum(isinstance(n, DECISIONS) for n in inner)
            functions += sum(isinstance(n, SCOPES) and bool(n.body) for n in inner)
            classes += sum(isinstance(n, ast.ClassDef) and bool(n.body) for n in inner)
        for node in left:
            end = node.end_lineno or node.lineno
            if hasattr(node, "body") and not node.body:
                end = node.lineno
            ranges.append((node.lineno, end))
            changes += 0 if right else 1
    return {"invalid": False, "changes": changes, "cc": cc, "new_functions": functions, "new_classes": classes, "ranges": sorted(set(ranges))}


def file_metrics(files: DataFrame, keys: list[str], source: str = "content") -> DataFrame:
    """``keys`` and the metrics of each source; sources that do not parse, and nulls, have ``invalid`` and null metrics."""
    names = [x.split()[0] for x in METRICS.split(", ")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keys).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [measure(s) if isinstance(s, str) else None for s in f["_source"]]
            out = f.drop(columns="_source")
            for n in names:
                out[n] = pd.array([m[n] if m else None for m in found], dtype="Float64" if n in ("halstead", "mi") else "Int64")
            yield out.assign(invalid=[m is None for m in found])

    return files.select(*keys, F.col(source).alias("_source")).mapInPandas(run, f"{fields}, {METRICS}, invalid boolean")


def pair_changes(pairs: DataFrame, keys: list[str], old: str = "source_parent", new: str = "source_new") -> DataFrame:
    """``keys, invalid, changes, cc, new_functions, new_classes, ranges`` of file pairs; a null side is an added or deleted file."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [compare(a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(f["_old"], f["_new"])]
            out = f.drop(columns=["_old", "_new"]).assign(invalid=[x["invalid"] for x in found])
            for n in ("changes", "cc", "new_functions", "new_classes"):
                out[n] = pd.array([x[n] for x in found], dtype="Int64")
            yield out.assign(ranges=[[{"start": a, "end": b} for a, b in x["ranges"]] for x in found])

    return pairs.select(*keys, F.col(old).alias("_old"), F.col(new).alias("_new")).mapInPandas(run, f"{fields}, invalid boolean, changes int, cc int, new_functions int, new_classes int, ranges array<struct<start:int,end:int>>")


def aggregate_metrics(files: DataFrame, cid: str = "cid", name: str = "path") -> DataFrame:
    """Per commit: sums split into tests and others by the file name, mean and greatest depth of the others; a commit with a file that does not parse is invalid."""
    test = F.col(name).contains("test")
    cols = [c for c in ("changes", "cc", "new_functions", "new_classes", "lloc", "nodes", "complexity") if c in files.columns]
    sums = [F.sum(F.when(~test, F.col(c)).otherwise(0)).alias(c) for c in cols] + [F.sum(F.when(test, F.col(c)).otherwise(0)).alias(f"test_{c}") for c in cols]
    if "sum_of_depth" in files.columns:
        sums += [(F.sum(F.when(~test, F.col("sum_of_depth")).otherwise(0)) / F.greatest(F.sum(F.when(~test, F.col("instances")).otherwise(0)), F.lit(1))).alias("avg_depth"), F.max(F.when(~test, F.col("max_depth"))).alias("max_depth")]
    return files.groupBy(cid).agg(*sums, F.bool_or("invalid").alias("invalid"))


def stats_delta(left: DataFrame, right: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """``keys, delta``: right minus left of sparse counts, 0 where one side lacks a key."""
    a, b = left.select(*keys, F.col(value).alias("_a")), right.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full_outer").select(*keys, (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta"))


def type_counts(files: DataFrame, key: str, source: str = "content") -> DataFrame:
    """``key, node_type, n``: nodes by type of each source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, t, n) for k, s in zip(f["k"], f["s"]) for t, n in sorted(node_counts(s).items())]
            yield pd.DataFrame(rows, columns=["key", "node_type", "n"])

    kind = files.select(key).schema.fields[0].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(source).alias("s")).filter("s is not null").mapInPandas(run, f"key {kind}, node_type string, n int").withColumnRenamed("key", key)
