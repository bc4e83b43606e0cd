"""Named queries over the stored tables, each with the SQL that gives the same rows where there is one."""

from . import joins, media, records, retrieval, scalars, segmentation, words  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
