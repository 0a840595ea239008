"""Expressions of a model as Columns. The language (+ - * /, unary minus, calls, numbers, names, array literals) is a
subset of Python's expressions, so Python's own parser reads it; what is here only maps its nodes to Columns."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arith
from ..operators.series import KEYS, convolve, shift

#: Functions and how many arguments they take.
FUNCTIONS = {"MIN": (2, 2), "MAX": (2, 2), "CLAMP": (3, 3), "MOD": (2, 2), "FLOOR": (1, 1), "CEIL": (1, 1), "ROUND": (1, 1), "STEP": (2, 2), "PULSE": (1, 3), "SHIFT": (2, 2), "CONV": (2, 2)}
_OPS: dict[type, Callable] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: arith.safe_div}


class ExpressionError(ValueError):
    pass


def parse(text: str) -> ast.expr:
    """The checked tree of an expression; raises ExpressionError for anything outside the language."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = node.func.id.upper() if isinstance(node.func, ast.Name) else ""
            if name not in FUNCTIONS or node.keywords:
                raise ExpressionError(f"{text!r}: unknown function {name or '?'}")
            lo, hi = FUNCTIONS[name]
            if not lo <= len(node.args) <= hi:
                raise ExpressionError(f"{text!r}: {name} takes {lo} to {hi} arguments")
        elif isinstance(node, ast.Constant):
            if type(node.value) not in (int, float):
                raise ExpressionError(f"{text!r}: {node.value!r} is not a number")
        elif not isinstance(node, (ast.Name, ast.List, ast.expr_context, ast.operator, ast.BinOp, ast.UnaryOp, ast.USub, ast.UAdd)) or isinstance(node, ast.operator) and type(node) not in _OPS:
            raise ExpressionError(f"{text!r}: {type(node).__name__} is not part of the language")
    return tree


def number(node: ast.expr) -> float:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -number(node.operand)
    if not isinstance(node, ast.Constant):
        raise ExpressionError("a literal number is needed here")
    return float(node.value)


def whole(node: ast.expr, least: int) -> int:
    x = number(node)
    if x != int(x) or x < least:
        raise ExpressionError(f"a whole number of {least} or more is needed here, not {x:g}")
    return int(x)


def references(tree: ast.expr) -> tuple[set[str], set[str]]:
    """Names used in the same bin, and names used only of earlier bins (below a SHIFT of one bin or more)."""
    same: set[str] = set()
    past: set[str] = set()

    def walk(node: ast.AST, lagged: bool) -> None:
        if isinstance(node, ast.Name):
            (past if lagged else same).add(node.id)
        elif isinstance(node, ast.Call):
            late = lagged or node.func.id.upper() == "SHIFT" and number(node.args[1]) >= 1
            for a in node.args:
                walk(a, late)
        else:
            for child in ast.iter_child_nodes(node):
                walk(child, lagged)

    walk(tree, False)
    return same, past - same


def _kernel(node: ast.expr) -> list[float]:
    return [number(x) for x in node.elts] if isinstance(node, ast.List) else [number(node)]


def to_column(tree: ast.expr | str, names: dict[str, Column] | None = None, keys: Sequence[str] = KEYS, past: Callable[[str, int], Column] | None = None) -> Column:
    """The Column of an expression over a frame with a column bin; names maps ids to Columns (default: same-named).

    Within a fold, past(name, back) gives a name's value (or "bin") so many bins before; shifts then need no window."""
    tree = parse(tree) if isinstance(tree, str) else tree

    def bin_at(back: int) -> Column:
        return past("bin", back) if past else F.col("bin")

    def earlier(node: ast.expr, lag: int, back: int) -> Column:
        """node's value `lag` bins before; 0 before the start."""
        if past is None:
            return shift(walk(node, 0), lag, keys)
        return F.when(bin_at(back + lag) >= 0, walk(node, back + lag)).otherwise(0.0) if lag else walk(node, back)

    def walk(node: ast.expr, back: int = 0) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if past:
                return past(node.id, back)
            if names is not None and node.id not in names:
                raise ExpressionError(f"unknown series {node.id}")
            return names[node.id] if names else F.col(node.id)
        if isinstance(node, ast.UnaryOp):
            return F.lit(0.0) - walk(node.operand, back) if isinstance(node.op, ast.USub) else walk(node.operand, back)
        if isinstance(node, ast.BinOp):
            return _OPS[type(node.op)](walk(node.left, back), walk(node.right, back))
        if isinstance(node, ast.List):
            return F.element_at(F.array(*[F.lit(number(x)) for x in node.elts]), (bin_at(back) + 1).cast("int"))
        name, args = node.func.id.upper(), node.args
        if name == "SHIFT":
            return earlier(args[0], whole(args[1], 0), back)
        if name == "CONV":
            kernel = _kernel(args[1])
            if past is None:
                return convolve(walk(args[0]), kernel, keys)
            return sum((F.lit(k) * arith.fin(earlier(args[0], i, back)) for i, k in enumerate(kernel) if k), F.lit(0.0))
        if name == "PULSE":
            return arith.pulse(bin_at(back), whole(args[0], 1), whole(args[1], 0) if len(args) > 1 else 0, walk(args[2], back) if len(args) > 2 else 1.0)
        f = {"MIN": F.least, "MAX": F.greatest, "CLAMP": arith.clamp, "MOD": arith.floored_mod, "FLOOR": arith.floor, "CEIL": arith.ceil, "ROUND": arith.round_away, "STEP": arith.step}[name]
        return f(*(walk(a, back) for a in args))

    return walk(tree)


def to_sql(tree: ast.expr, keys: Sequence[str] = KEYS) -> str:
    """The same as to_column() over a frame, as SQL text: one call to the JVM for an expression, however long, where a wide model
    would make tens of thousands."""
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    by = f"PARTITION BY {', '.join(map(quoted, keys))} ORDER BY `bin`" if keys else "ORDER BY `bin`"
    finite = lambda x: f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) <> double('Infinity') THEN {x} ELSE 0D END"
    literal = lambda v: f"double('{float(v)!r}')"

    def fires(period: int, phase: int) -> str:
        return f"(`bin` >= {phase} AND (`bin` - {phase}) % {period} = 0)"

    def walk(node: ast.expr) -> str:
        if isinstance(node, ast.Constant):
            return literal(node.value)
        if isinstance(node, ast.Name):
            return quoted(node.id)
        if isinstance(node, ast.UnaryOp):
            return f"(0D - {walk(node.operand)})" if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Div):
                return f"CASE WHEN {b} <> 0 THEN try_divide({a}, {b}) ELSE 0D END"
            return f"({a} {'+' if isinstance(node.op, ast.Add) else '-' if isinstance(node.op, ast.Sub) else '*'} {b})"
        if isinstance(node, ast.List):
            return f"element_at(array({', '.join(literal(number(x)) for x in node.elts)}), cast(`bin` + 1 AS int))"
        name, args = node.func.id.upper(), node.args
        if name == "SHIFT":
            lag = whole(args[1], 0)
            return f"lag({walk(args[0])}, {lag}, 0D) OVER ({by})" if lag else walk(args[0])
        if name == "CONV":
            x = finite(walk(args[0]))
            return "(0D" + "".join(f" + {literal(k)} * {f'lag({x}, {i}, 0D) OVER ({by})' if i else x}" for i, k in enumerate(_kernel(args[1])) if k) + ")"
        if name == "PULSE":
            amplitude = walk(args[2]) if len(args) > 2 else "1D"
            return f"CASE WHEN {fires(whole(args[0], 1), whole(args[1], 0) if len(args) > 1 else 0)} THEN {amplitude} ELSE 0D END"
        x = [walk(a) for a in args]
        if name == "MOD":
            ok = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) <> double('Infinity')" for v in x)
            return f"CASE WHEN NOT ({ok}) THEN double('NaN') WHEN {x[1]} = 0 THEN 0D ELSE {x[0]} - {x[1]} * cast(floor(try_divide({x[0]}, {x[1]})) AS double) END"
        return {
            "MIN": lambda: f"least({x[0]}, {x[1]})", "MAX": lambda: f"greatest({x[0]}, {x[1]})", "CLAMP": lambda: f"greatest({x[1]}, least({x[2]}, {x[0]}))", "FLOOR": lambda: f"cast(floor({x[0]}) AS double)",
            "CEIL": lambda: f"cast(ceil({x[0]}) AS double)", "ROUND": lambda: f"cast(round({x[0]}) AS double)", "STEP": lambda: f"CASE WHEN NOT isnan({x[0]}) AND {x[0]} >= {x[1]} THEN 1D ELSE 0D END",
        }[name]()

    return walk(tree)


def reach(tree: ast.expr) -> dict[str, int]:
    """How many bins back an expression looks at each of its names."""
    found: dict[str, int] = {}

    def walk(node: ast.AST, back: int) -> None:
        if isinstance(node, ast.Name):
            found[node.id] = max(back, found.get(node.id, 0))
        elif isinstance(node, ast.Call):
            name, args = node.func.id.upper(), node.args
            if name == "SHIFT":
                walk(args[0], back + whole(args[1], 0))
            elif name == "CONV":
                walk(args[0], back + len(_kernel(args[1])) - 1)
            else:
                for x in args:
                    walk(x, back)
        else:
            for child in ast.iter_child_nodes(node):
                walk(child, back)

    walk(tree, 0)
    return found


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
