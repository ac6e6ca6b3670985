

from . import queries, tables  # noqa: F401  both register queries
