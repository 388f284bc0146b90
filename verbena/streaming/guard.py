"""Which verbs work on a streaming DataFrame.

Projections, plain filters, grouped summaries (under a watermark), joins with
static frames and unnesting only build lazy plans and stay valid on a stream;
verbs that need row order, a discovery job or a window over all rows do not.
"""

from __future__ import annotations

from ..functions.expr import Expr, Vector
from ..functions.library import Across
from ..operators.projection import expand

STATELESS = {"select", "transmute", "mutate", "rename", "rename_with", "relocate", "clean_names", "filter", "drop_missing", "group_by", "ungroup", "summarize", "count", "tally", "separate", "unite", "separate_rows", "unnest_longer", "inner_join", "left_join", "semi_join", "bind_rows", "pivot_longer"}


class NotStreaming(TypeError):
    """The verb can't run on a stream."""


def _deep(frame, a) -> bool:
    """Does the argument hold an aggregate or window, across() included?"""
    if isinstance(a, Across):
        return any(e.deep() for e in expand(frame, {"x": a}).values())
    if isinstance(a, Vector):
        return True  # its values go by position
    return isinstance(a, Expr) and a.deep()


def check(verb: str, frame, args: tuple, kwargs: dict) -> None:
    if not frame.df.isStreaming:
        return
    if verb not in STATELESS:
        raise NotStreaming(f"{verb} needs all rows or their order, which a stream doesn't have")
    if verb in ("mutate", "filter", "select", "transmute") and any(_deep(frame, a) for a in (*args, *kwargs.values())):
        raise NotStreaming(f"{verb} with aggregates or windows needs all rows")
