"""Metric formulas from a config file -> Column expressions.

Python's own ``ast`` reads the formula; only arithmetic, comparisons, the named
inputs and a few functions are allowed. Nothing is evaluated per row in Python.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


class UnsafeFormula(ValueError):
    """The formula uses something outside the allowed set."""


def _all_known(args: list[Column], result: Column) -> Column:
    """NULL as soon as one input is NULL, where Spark would skip it."""
    known = reduce(lambda a, b: a & b, [a.isNotNull() for a in args])
    return F.when(known, result)


# Allowed functions with the number of their arguments.
FUNCTIONS = {
    "min": (2, lambda a, b: _all_known([a, b], F.least(a, b))),
    "minimum": (2, lambda a, b: _all_known([a, b], F.least(a, b))),
    "max": (2, lambda a, b: _all_known([a, b], F.greatest(a, b))),
    "maximum": (2, lambda a, b: _all_known([a, b], F.greatest(a, b))),
    "clip": (3, lambda x, lo, hi: _all_known([x, lo, hi], F.least(F.greatest(x, lo), hi))),
    "abs": (1, F.abs),
    "sqrt": (1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "log1p": (1, lambda x: F.when(x > -1, F.log1p(x))),
    "exp": (1, F.exp),
}
ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Pow: lambda a, b: finite_power(a, b),
}
COMPARISONS = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def finite_power(a: Column, b: Column) -> Column:
    p = F.pow(a, b)
    return F.when(~F.isnan(p), p)


def compile_formula(text: str, inputs: Mapping[str, Column]) -> Column:
    """Formula over ``inputs`` as a double column; undefined results are NULL."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise UnsafeFormula(f"not a formula: {text!r}") from error

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise UnsafeFormula(f"no truth values in formulas: {text!r}")
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in inputs:
                return inputs[name].cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in ARITHMETIC:
                return ARITHMETIC[type(op)](build(a), build(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in COMPARISONS:
                return COMPARISONS[type(op)](build(a), build(b)).cast("double")
            case ast.Call(func=f, args=args, keywords=[]):
                name = _function_name(f)
                arity, make = FUNCTIONS.get(name, (None, None))
                if arity != len(args):
                    raise UnsafeFormula(f"{name!r} with {len(args)} arguments in {text!r}")
                return make(*map(build, args))
        raise UnsafeFormula(f"not allowed in a formula: {ast.unparse(node)!r}")

    return build(tree)


def _function_name(node: ast.AST) -> str:
    """``clip`` or ``np.clip``."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name(id="np"), attr=name):
            return name
    raise UnsafeFormula(f"not a function: {ast.unparse(node)!r}")
