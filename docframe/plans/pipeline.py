"""Queries as functions over bound sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docframe.sources.documents import Sources


def run(sources: Sources, query: Callable[[DataFrame], DataFrame], **arguments) -> DataFrame:
    """query on the primary dataset (and named arguments, such as other aliases); one that returns nothing is an error."""
    out = query(sources.primary, **arguments)
    if out is None:
        raise ValueError("the query returned nothing; return a DataFrame")
    return out
