"""Tables on disk: agents, layers, ancestor logs, fragments of graphs, sequences, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut
from cohortspark.operators.grid import lattice_edges

#: Layers of an environment file.
LAYERS = ("geo", "climate", "veg", "nav", "grid", "movestat")


def write_agents(agents: DataFrame, path: str, safe: bool = False) -> None:
    """The living agents; ``safe`` takes a reliable copy first, so agents that were read from ``path`` may be written to it."""
    living = agents.where("life_state > 0")
    (cut(living) if safe else living).write.mode("overwrite").parquet(path)


def read_agents(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if columns is None else found.select(*columns)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer is a table of its own, so one can be written anew without the others."""
    for name, table in layers.items():
        if name not in LAYERS:
            raise ValueError(f"unknown layer {name}")
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_layers(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The layers of ``geo+climate``-like lists that an event names."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def append_ancestors(records: DataFrame, path: str, block: int = 1 << 20) -> None:
    """Adds birth records (``id, mom, dad, ...``) to a log; a log is cut into fragments of ids of ``block``."""
    records.withColumn("fragment", F.floor(F.col("id") / block)).write.mode("append").partitionBy("fragment").parquet(path)


def read_ancestors(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, block: int = 1 << 20) -> DataFrame:
    """The log, or only the fragments that hold ids from ``first`` to ``last``: other files are not opened."""
    log = spark.read.parquet(path)
    if first is not None:
        log = log.where((F.col("fragment") >= first // block) & (F.col("id") >= first))
    if last is not None:
        log = log.where((F.col("fragment") <= last // block) & (F.col("id") <= last))
    return log.drop("fragment")


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Genomes or phenomes with their ids, sorted within files, so that a search by id skips row groups."""
    sequences.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def grid_tables(spark: SparkSession, definition: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cells and edges of a lattice definition (``WIDTH``, ``HEIGHT``, ``TYPE`` rect or hex, ``PERIODIC``)."""
    known = {k.lower(): v for k, v in definition.items()}
    width, height = int(known["width"]), int(known["height"])
    i = F.col("id")
    cells = spark.range(width * height).select(i.cast("int").alias("cell"), (i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y"))
    return cells, lattice_edges(cells, width, height, known.get("periodic", "0") not in ("0", "no", "false"), known.get("type", "rect").startswith("hex"))


def parse_regions(text: str) -> dict[tuple[int, str], list[int]]:
    """Nodes of regions: ``Region <number>: <name>``, then one node number a line (comments start with #)."""
    out: dict[tuple[int, str], list[int]] = {}
    now: list[int] | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("Region"):
            number, colon, name = line[6:].partition(":")
            if not colon or not number.strip().isdigit():
                raise ValueError(f"cannot read {raw!r}")
            now = out.setdefault((int(number), name.strip()), [])
        elif now is None or not line.isdigit():
            raise ValueError(f"cannot read {raw!r}")
        else:
            now.append(int(line))
    return out
