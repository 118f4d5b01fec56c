"""Equal rows as one row with a count, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are written from one row at most.
CHUNK = 4096


def repeated(rows: DataFrame, n: str, most: int, by: list[str], nth: str = "nth") -> DataFrame:
    """Each row ``n`` times (at least once), numbered from 1 in ``nth``.

    ``most`` is the largest ``n``: beyond ``CHUNK`` rows are cut into chunks that are dealt out by
    ``by`` and the chunk's number before they are written, so no task holds one row's copies alone.
    """
    part = "__chunk"
    if most > CHUNK:
        rows = rows.withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({n} - 1) div {CHUNK}")))).repartition(*by, part)
    else:
        rows = rows.withColumn(part, F.lit(0).cast("bigint"))
    numbers = F.sequence(F.col(part) * CHUNK + 1, F.least(F.col(n), (F.col(part) + 1) * CHUNK))
    return rows.withColumn(nth, F.explode(numbers)).drop(part)
