"""Portfolio analytics and recommendation auditing as Spark DataFrame operators."""

from holdfast.session import get_session

__all__ = ["get_session"]
