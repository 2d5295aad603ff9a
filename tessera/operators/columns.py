"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(names: list[str], *frames: DataFrame) -> list[str]:
    """Names like these that no column of the frames has, so that no column of a caller is hidden."""
    taken = {c.lower() for df in frames for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
