"""Tidy verbs over Spark DataFrames."""

from .frame import TidyFrame, tidy
from .functions.expr import c, col, lit
from .functions.library import *  # noqa: F403
from .functions.parse import parse
from .operators.inspect import settings
from .operators.joins import DuplicateColumn
from .operators.selection import between, cols, contains, ends_with, everything, matches, not_, starts_with, where
from .plans.context import OrderRequired
from .sources.io import from_pandas, from_rows, read, read_jdbc, read_stream, session, table, write
