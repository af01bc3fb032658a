"""Arithmetic over column names, checked before it becomes a Column."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import quoted

_OPERATIONS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}


def arithmetic(expression: str, columns: Sequence[str]) -> Column:
    """``+ - * /``, numbers, brackets and column names (names may hold
    blanks).  Division by zero gives null; anything else raises."""
    places = {f"c_{i}_": c for i, c in enumerate(sorted(columns, key=len, reverse=True))}
    text = expression
    for mark, name in places.items():
        text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", mark, text)

    def build(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in places:
            return quoted(places[node.id]).try_cast("double")
        raise ValueError(f"{expression!r} is not arithmetic over the columns {list(columns)}")

    try:
        return build(ast.parse(text, mode="eval").body)
    except SyntaxError as error:
        raise ValueError(f"{expression!r} cannot be read") from error
