"""Facts about Python files that need the language's own grammar.

The only Python-side step of the measuring job: one text in, nine counts out. The arithmetic on
them is shared with the lexical route and stays in Spark.
"""

from __future__ import annotations

import ast
import gc
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Workers get this module's functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = ["decisions", "branches", "definitions", "classes", "calls", "n1", "n2", "eta1", "eta2"]
AST_FACTS = T.StructType([T.StructField(n, T.IntegerType()) for n in COUNTS])


def _name(kind: object) -> str:
    return kind.__class__.__name__


# What a statement or expression adds: decisions, branches, operator tokens. Calls, names, constants and definitions,
# which are most of a file, are counted where the tree is walked.
RULES = {
    ast.If: lambda n: (1, 2 if n.orelse else 1, ("if",)),
    ast.IfExp: lambda n: (1, 2, ("if_exp",)),
    ast.For: lambda n: (1, 1, ("for",)),
    ast.AsyncFor: lambda n: (1, 1, ("async_for",)),
    ast.While: lambda n: (1, 1, ("while",)),
    ast.ExceptHandler: lambda n: (1, 1, ("except",)),
    ast.With: lambda n: (1, 0, ("with",)),
    ast.AsyncWith: lambda n: (1, 0, ("async_with",)),
    ast.Assert: lambda n: (1, 0, ("assert",)),
    ast.comprehension: lambda n: (1 + len(n.ifs), 1 + len(n.ifs), ("comp",)),
    ast.BoolOp: lambda n: (len(n.values) - 1, len(n.values) - 1, (_name(n.op),) * (len(n.values) - 1)),
    ast.BinOp: lambda n: (0, 0, (_name(n.op),)),
    ast.UnaryOp: lambda n: (0, 0, (_name(n.op),)),
    ast.Compare: lambda n: (0, 0, tuple([_name(op) for op in n.ops])),
}
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# fields that hold no node which adds anything: contexts, operators, and what is no node at all
_BARE = {"ctx", "op", "ops", "id", "attr", "kind", "type_comment", "lineno", "module", "level"}
_children: dict[type, tuple[str, ...]] = {}


def _fields(kind: type) -> tuple[str, ...]:
    if kind not in _children:
        _children[kind] = tuple(f for f in kind._fields if f not in _BARE)
    return _children[kind]


def file_facts(code: str) -> tuple | None:
    """The counts of one file, or None when it does not parse."""
    decisions = branches = definitions = classes = calls = n1 = n2 = 0
    operators, operands = set(), set()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            stack: list = [ast.parse(code)]
        while stack:
            node = stack.pop()
            kind = node.__class__
            if kind is ast.Name:
                n2 += 1
                operands.add(node.id)
                continue
            if kind is ast.Constant:
                n2 += 1
                operands.add(repr(node.value))
                continue
            if kind is ast.Call:
                calls += 1
                n1 += 1
                operators.add("call()")
                called = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
                if called:
                    n2 += 1
                    operands.add(called)
            elif kind in RULES:
                d, b, tokens = RULES[kind](node)
                decisions += d
                branches += b
                n1 += len(tokens)
                operators.update(tokens)
            elif kind in DEFINITIONS:
                n2 += 1
                operands.add(node.name)
                if kind is ast.ClassDef:
                    classes += 1
                else:
                    definitions += 1
            for field in _fields(kind):
                value = getattr(node, field, None)
                child = value.__class__
                # names and constants, half of a tree, are counted where they hang
                if child is ast.Name:
                    n2 += 1
                    operands.add(value.id)
                elif child is ast.Constant:
                    n2 += 1
                    operands.add(repr(value.value))
                elif child is list:
                    stack += [x for x in value if isinstance(x, ast.AST)]
                elif isinstance(value, ast.AST):
                    stack.append(value)
    except Exception:  # bad syntax, null bytes, nesting too deep: the lexical route takes over
        return None
    return decisions, branches, definitions, classes, calls, n1, n2, len(operators), len(operands)


@F.pandas_udf(AST_FACTS)
def ast_facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """One struct of counts per text; all fields null for a null text or one that does not parse."""
    nothing = (None,) * len(COUNTS)
    # syntax trees have no cycles, and searching their many nodes for some takes longer than making them
    collecting = gc.isenabled()
    gc.disable()
    try:
        for codes in batches:
            rows = [nothing if code is None else (file_facts(code) or nothing) for code in codes]
            yield pd.DataFrame(rows, columns=COUNTS, dtype="Int32")
    finally:
        if collecting:
            gc.enable()
