"""A string front end: "3 <= a < 5", "a in (1, 3)", "mean(b) + 1" as expressions, by Python's own grammar."""

from __future__ import annotations

import ast
import operator

from . import library
from .expr import Expr, as_expr, col, lit

_TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
_TEST = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_CALLS = {k: getattr(library, k) for k in library.__all__ if callable(getattr(library, k))} | {"sum": library.sum_, "round": library.round_, "abs": library.absolute}


def parse(text: str, **values) -> Expr:
    """The expression of a text; names are columns, or the values given."""
    return as_expr(_node(ast.parse(text.strip(), mode="eval").body, values))


def _node(x: ast.AST, values: dict):
    match x:
        case ast.Constant():
            return lit(x.value)
        case ast.Name():
            if x.id in values:
                return values[x.id]
            return lit(None) if x.id == "missing" else library.pi if x.id == "pi" else col(x.id)
        case ast.BinOp():
            return _TWO[type(x.op)](as_expr(_node(x.left, values)), as_expr(_node(x.right, values)))
        case ast.UnaryOp(op=ast.USub()):
            return -as_expr(_node(x.operand, values))
        case ast.UnaryOp(op=ast.Not() | ast.Invert()):
            return ~as_expr(_node(x.operand, values))
        case ast.BoolOp():
            parts = [as_expr(_node(v, values)) for v in x.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(x.op, ast.And) else out | p
            return out
        case ast.Compare():
            out, left = None, _node(x.left, values)
            for op, right in zip(x.ops, x.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    members = values[right.id] if isinstance(right, ast.Name) else [None if isinstance(e, ast.Name) and e.id == "missing" else ast.literal_eval(e) for e in right.elts]
                    test = library.in_(left, members)
                    test = ~test if isinstance(op, ast.NotIn) else test
                else:
                    right = _node(right, values)
                    test = _TEST[type(op)](as_expr(left), as_expr(right))
                    left = right
                out = test if out is None else out & test
            return out
        case ast.Call():
            known = _CALLS | library.REGISTERED
            if not isinstance(x.func, ast.Name) or x.func.id not in known:
                raise ValueError(f"unknown function in {ast.unparse(x)}")
            plain = [ast.literal_eval(a) if isinstance(a, ast.Constant) else _node(a, values) for a in x.args]
            return known[x.func.id](*plain, **{k.arg: ast.literal_eval(k.value) for k in x.keywords})
    raise ValueError(f"can't read {ast.unparse(x)}")
