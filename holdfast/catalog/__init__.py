"""Named queries over the supplied tables, each with the SQL it is checked against."""

from holdfast.catalog import views  # noqa: F401
from holdfast.catalog import core  # noqa: F401
from holdfast.catalog import audit  # noqa: F401
from holdfast.catalog import markets  # noqa: F401
from holdfast.catalog import review  # noqa: F401
from holdfast.catalog import text  # noqa: F401
from holdfast.catalog import files  # noqa: F401
from holdfast.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
