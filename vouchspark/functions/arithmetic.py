"""Re-evaluation of recorded calculator expressions."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MAX_EXPONENT = 256, 64

BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


class Refused(ValueError):
    """The expression is not plain arithmetic."""


def _checked(tree: ast.AST) -> ast.AST:
    """The same tree, once every node is found to be plain arithmetic.  Nodes are looked at level
    by level before anything is computed, so a fault of form wins over one of value.  The texts of
    faults are fixed values: recordings hold them."""
    level = [tree]
    while level:
        below: list[ast.AST] = []
        for node in level:
            match node:
                case ast.Constant(value=bool()):
                    raise Refused("only numeric literals allowed, got bool")
                case ast.Constant(value=int() | float()):
                    pass
                case ast.Constant(value=other):
                    raise Refused(f"only numeric literals allowed, got {type(other).__name__}")
                case ast.UnaryOp(op=op, operand=inner):
                    if type(op) not in UNARY:
                        raise Refused(f"unary operator not allowed: {type(op).__name__}")
                    below.append(inner)
                case ast.BinOp(left=left, op=op, right=right):
                    if type(op) not in BINARY:
                        raise Refused(f"operator not allowed: {type(op).__name__}")
                    below += [left, right]
                case _:
                    raise Refused(f"AST node not allowed: {type(node).__name__}")
        level = below
    return tree


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant):
        return float(node.value)
    if isinstance(node, ast.UnaryOp):
        return UNARY[type(node.op)](_value(node.operand))
    a, b = _value(node.left), _value(node.right)
    if isinstance(node.op, ast.Pow) and abs(b) > MAX_EXPONENT:
        raise Refused("exponent too large (max abs 64)")
    result = BINARY[type(node.op)](a, b)
    if isinstance(result, complex):
        raise Refused("result is not a real number")
    return result


def calculate(expression: str | None) -> str:
    """Result as recorded: integers without a fraction, other numbers with six significant
    digits, faults as ``ERROR: …``."""
    try:
        if not isinstance(expression, str) or not expression.strip():
            raise Refused("expression must be a non-empty string")
        if len(expression) > MAX_CHARS:
            raise Refused("expression too long (max 256 chars)")
        result = _value(_checked(ast.parse(expression, mode="eval").body))
        if not math.isfinite(result):
            raise Refused("result is not a finite number")
    except Refused as fault:
        return f"ERROR: {fault}"
    except SyntaxError as fault:
        return f"ERROR: syntax error: {fault.msg}"
    except ZeroDivisionError:
        return "ERROR: division by zero"
    except OverflowError as fault:
        return f"ERROR: overflow: {fault}"
    return str(int(result)) if result == int(result) else f"{result:.6g}"


@F.pandas_udf(T.StringType())
def recalculated(expressions: pd.Series) -> pd.Series:
    """Each distinct expression of an Arrow batch is evaluated once."""
    codes, distinct = pd.factorize(expressions, use_na_sentinel=False)
    return pd.Series([calculate(e) for e in distinct]).take(codes)
