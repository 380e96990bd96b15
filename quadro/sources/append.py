"""Several sources as one: the union of files whose fields are the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from quadro.plans.spec import PlanError


def signature(df: DataFrame) -> list[tuple[str, str, str]]:
    """Name, type, and the widths that a fixed-width file declares."""
    return [(f.name, f.dataType.simpleString(), str(sorted(f.metadata.items()))) for f in df.schema.fields]


def append_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources; a source whose fields differ is named."""
    (first, head), *rest = sources.items()
    for name, df in rest:
        if signature(df) != signature(head):
            raise PlanError(f"the fields of {name} aren't those of {first}")
    return reduce(DataFrame.unionByName, sources.values())
