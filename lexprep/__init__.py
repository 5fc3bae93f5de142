"""lexprep: legal-text preparation and classification as Spark DataFrame jobs.

Every data-path operator is a composition of built-in Spark column
expressions and DataFrame operators (no Python UDF on the data path), so
Catalyst can push filters and prune columns into the Parquet scan and
whole-stage codegen runs the text work inside the JVM.
"""

from lexprep.options import CleanOptions, TopicOptions  # noqa: F401
from lexprep.session import build_session  # noqa: F401

__all__ = ["CleanOptions", "TopicOptions", "build_session"]
