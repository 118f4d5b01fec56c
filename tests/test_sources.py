"""Binary and text sources, against files written here."""

import struct
import zlib

import numpy as np
import pytest

from cohortspark.sources import binary


@pytest.mark.parametrize("kind", list(binary.RASTER_TYPES))
@pytest.mark.parametrize("magic", [b"SOMEMP1", b"SOMEMP2"])
def test_header_rasters(spark, tmp_path, kind, magic):
    values = np.arange(12).reshape(3, 4)
    content = binary.raster_bytes(values, magic, kind, (1.0, -2.0, 2.0), (0.5, 0.0, 1.5))
    head, got = binary.parse_raster(content)
    assert (got == values).all() and head["width"] == 4 and head["lat_max"] == 1.5
    if kind == "d":
        (tmp_path / "a.map").write_bytes(content)
        rows = binary.read_rasters(spark, str(tmp_path)).collect()
        assert {(r.y, r.x): r.v for r in rows} == {(y, x): float(values[y, x]) for y in range(3) for x in range(4)}


def png(pixels: np.ndarray, filters: list[int]) -> bytes:
    h, w, c = pixels.shape
    flat, lines = pixels.reshape(h, w * c).astype(int), []
    for y in range(h):
        line, out = flat[y], []
        for i, v in enumerate(line):
            a, b = (line[i - c] if i >= c else 0), (flat[y - 1][i] if y else 0)
            d = flat[y - 1][i - c] if y and i >= c else 0
            paeth = min((a, b, d), key=lambda q, t=a + b - d: abs(t - q))
            out.append((v - [0, a, b, (a + b) // 2, paeth][filters[y]]) & 255)
        lines.append(bytes([filters[y], *out]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    for c in (1, 3):
        pixels = rng.integers(0, 256, (5, 6, c), dtype=np.uint8)
        assert (binary.parse_png(png(pixels, [0, 1, 2, 3, 4])) == pixels).all()
    two = np.array([[[0], [9]]], np.uint8)
    (tmp_path / "a.png").write_bytes(png(two, [0]))
    got = binary.read_images(spark, str(tmp_path), {(9,): 2.5}, -1.0).collect()
    assert {(r.y, r.x): r.v for r in got} == {(0, 0): -1.0, (0, 1): 2.5}


def test_shapes_and_attributes(spark, tmp_path):
    line = struct.pack("<i4d2i2i", 3, 0, 0, 1, 1, 2, 3, 0, 2) + struct.pack("<6d", 0, 0, 1, 1, 5, 6)
    point = struct.pack("<i2d", 1, 7, 8)
    record = lambda n, b: struct.pack(">ii", n, len(b) // 2) + b
    (tmp_path / "a.shp").write_bytes(bytes(100) + record(1, line) + record(2, point) + record(3, struct.pack("<i", 0)))
    got = [tuple(r)[1:] for r in binary.read_shapes(spark, str(tmp_path / "a.shp")).collect()]
    assert got == [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 1.0), (1, 1, 0, 5.0, 6.0), (2, 0, 0, 7.0, 8.0)]
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15) + b"FLOW".ljust(11, b"\0") + b"N" + bytes(4) + bytes([3]) + bytes(15) + b"\x0d"
    rows = b" Rhine 12" + b"*Gone   1" + b" Aare   7"
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 3, 32 + len(fields), 9) + bytes(20) + fields + rows)
    got = [(r.record, r.value) for r in binary.read_attributes(spark, str(tmp_path / "a.dbf"), "FLOW").collect()]
    assert got == [(1, "12"), (3, "7")]


def test_value_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("lon lat v\n-179.75 10.25 1.5 2\n 0.25\t-0.25  3\n")
    rows = binary.bin_table(binary.read_value_table(spark, str(tmp_path), 2), -180.0, 0.5, -90.0, 0.5).collect()
    assert sorted((r.y, r.x, r.v0, r.v1) for r in rows if r.v1) == [(200, 0, 1.5, 2.0)] and len(rows) == 2


def test_agents_and_layers(spark, tmp_path):
    from cohortspark.sources import store

    agents = spark.createDataFrame([(i, i % 3, 5 if i % 4 else 0) for i in range(40)], "id long, cell int, life_state int")
    path = f"{tmp_path}/agents"
    store.write_agents(agents, path)
    store.write_agents(store.read_agents(spark, path).where("id < 20"), path, safe=True)  # onto itself
    assert {r.id for r in store.read_agents(spark, path, ["id"]).collect()} == {i for i in range(20) if i % 4}
    layers = {"geo": agents.select("cell").distinct(), "nav": agents.select("id")}
    store.write_layers(layers, f"{tmp_path}/env")
    store.write_layers({"nav": agents.select("id").limit(3)}, f"{tmp_path}/env")
    got = store.read_layers(spark, f"{tmp_path}/env", ["geo", "nav"])
    assert got["geo"].count() == 3 and got["nav"].count() == 3
    with pytest.raises(ValueError):
        store.write_layers({"sky": agents}, f"{tmp_path}/env")


def test_ancestor_fragments_and_sequences(spark, tmp_path):
    from cohortspark.sources import store

    log = f"{tmp_path}/log"
    for part in range(3):
        store.append_ancestors(spark.range(part * 100, part * 100 + 100).selectExpr("id", "id - 1 AS mom", "id - 2 AS dad"), log, block=64)
    whole = store.read_ancestors(spark, log)
    assert whole.count() == 300 and whole.columns == ["id", "mom", "dad"]
    some = store.read_ancestors(spark, log, 70, 130, block=64)
    assert sorted(r.id for r in some.collect()) == list(range(70, 131))
    assert all(f"fragment={n}/" not in f for f in some.inputFiles() for n in ()) and "PartitionFilters" in some._jdf.queryExecution().executedPlan().toString()
    store.write_sequences(spark.range(500).selectExpr("id", "array(id, id + 1) AS strand1"), f"{tmp_path}/genes")
    assert spark.read.parquet(f"{tmp_path}/genes").where("id = 77").first().strand1 == [77, 78]


def test_grids_regions_trees_and_units(spark):
    from cohortspark.functions import scalars
    from cohortspark.operators import trees
    from cohortspark.sources import config, store

    cells, edges = store.grid_tables(spark, config.parse_grid("WIDTH 4\nHEIGHT = 3\nTYPE rect\nPERIODIC 1\n"))
    assert cells.count() == 12 and edges.count() == 48 and edges.where("nbr < 0").isEmpty()
    assert store.parse_regions("# nodes\nRegion 1: North\n4\n5\n\nRegion 2 : South\n7\n") == {(1, "North"): [4, 5], (2, "South"): [7]}
    for bad in ("Region x: y", "3", "Region 1: a\nb"):
        with pytest.raises(ValueError):
            store.parse_regions(bad)
    tree = trees.from_merges(["a_1", "a_2", "b_1", "c_1"], [(0, 1), (2, 3), (4, 5)])
    assert trees.lines(tree) == ["++--a_1", "|  +--a_2", "++--b_1", "   +--c_1"]
    assert trees.lines(trees.merged(tree)) == ["+--a", "++--b", "   +--c"]
    assert scalars.unit_factor("kg m^-2 * s^1.5") == 1000.0 and scalars.unit_factor("furlong") == 0.0 and scalars.unit_factor("km^2 ha^-1") == 100.0
