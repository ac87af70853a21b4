"""Connected components of a link table, by the engine's contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.components import contracted


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): component is the smallest id reachable.

    Rounds grow with the logarithm of the vertices, whatever their order and the links' shape (see ``contracted``).  Links with a null end and
    links of a vertex with itself count for nothing; an empty table gives no rows.
    """
    return contracted(links, name)[0]
