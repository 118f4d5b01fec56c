"""Counter-based uniform draws: a function of (seed, step, action, id, k) alone.

The draw is the first 32 bits of an MD5 digest, so it is the same in any engine and does not
depend on partitions, order or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(seed: int, step: Column | int, action: str, *ids: Column | int) -> Column:
    """A uniform draw in [0, 1)."""
    parts = [F.lit(str(seed)), step if isinstance(step, Column) else F.lit(str(step)), F.lit(action)]
    parts += [i if isinstance(i, Column) else F.lit(str(i)) for i in ids]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def u_sql(seed: int, step: int | str, action: str, *ids: str) -> str:
    """The same draw as SQL text."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{step}', '{action}', {', '.join(ids)})), 1, 8))::BIGINT / 4294967296.0)"


def pick(draw: Column, n: Column) -> Column:
    """A place in 0..n-1 from a draw."""
    return F.least(F.floor(draw * n), n - 1).cast("int")
