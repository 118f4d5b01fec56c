"""Map algebra over long rasters (``y, x, v``); NaN is "undefined"."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.curves import npp_miami
from cohortspark.functions.lineage import cut

NAN = float("nan")
#: Types in the order of promotion.
TYPES = ("smallint", "int", "bigint", "float", "double")


def _nan() -> Column:
    return F.lit(NAN)


def promoted(a: str, b: str) -> str:
    """The higher of two raster types."""
    return TYPES[max(TYPES.index(a), TYPES.index(b))]


def combine_values(op: str, a: Column, b: Column) -> Column:
    """A pixel of ``a`` combined with one of ``b`` (another map's, or a number)."""
    undefined = F.isnan(a) | F.isnan(b)
    return {
        "plus": a + b,
        "minus": a - b,
        "times": a * b,
        "div": F.when(b == 0, _nan()).otherwise(F.try_divide(a, b)),
        "invdiv": F.when(a == 0, _nan()).otherwise(F.try_divide(b, a)),
        "min": F.when(undefined, _nan()).otherwise(F.least(a, b)),
        "max": F.when(undefined, _nan()).otherwise(F.greatest(a, b)),
        "eq": F.when(~undefined & (a == b), a).otherwise(_nan()),
        "thr": F.when(~undefined & (a >= b), 1.0).otherwise(0.0),
        "set": F.when(F.isnan(b), a).otherwise(b),
        "isnan": F.isnan(a).cast("double"),
        "setnan": F.when(F.isnan(a), b).otherwise(a),
        "log": F.when(~F.isnan(a) & (a > 0), F.log(F.when(a > 0, a).otherwise(1.0))).otherwise(_nan()),
    }[op]


OPERATIONS = ("plus", "minus", "times", "div", "invdiv", "min", "max", "eq", "thr", "set", "isnan", "setnan", "log")


def combine(op: str, a: DataFrame, b: DataFrame | float) -> DataFrame:
    """Map with map (joined on the pixel) or map with number."""
    if isinstance(b, DataFrame):
        both = a.join(b.withColumnRenamed("v", "w"), ["y", "x"])
        return both.select("y", "x", combine_values(op, F.col("v"), F.col("w")).alias("v"))
    return a.select("y", "x", combine_values(op, F.col("v"), F.lit(float(b))).alias("v"))


def mask(a: DataFrame, test: str, value: float = 0.0, invert: bool = False) -> DataFrame:
    """1 where the test holds, else 0: ``equal`` (NaN never equals), ``nan``, ``+inf``, ``-inf``, ``numeric``."""
    v = F.col("v")
    inf = float("inf")
    holds = {
        "equal": ~F.isnan(v) & (v == value), "nan": F.isnan(v), "+inf": v == F.lit(inf), "-inf": v == F.lit(-inf),
        "numeric": ~F.isnan(v) & (F.abs(v) != F.lit(inf)),
    }[test]
    return a.select("y", "x", (~holds if invert else holds).cast("double").alias("v"))


def statistics(a: DataFrame) -> DataFrame:
    """Sum, count, mean and range of the finite pixels; counts of NaN, infinite and all."""
    v, inf = F.col("v"), F.lit(float("inf"))
    finite = F.when(~F.isnan(v) & (F.abs(v) != inf), v)
    return a.agg(
        F.sum(finite).alias("total"), F.count(finite).alias("n"), F.avg(finite).alias("mean"), F.min(finite).alias("low"), F.max(finite).alias("high"),
        F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == inf).alias("n_inf"), F.count("*").alias("n_all"),
    )


def kernel(kind: str, w: int, h: int, sigma: float = 1.0) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of a normalised kernel: ``rect``, ``circ``, ``pyramid``, ``cone`` or ``gauss``."""
    out = []
    for j in range(h):
        for i in range(w):
            dy, dx = j - h // 2, i - w // 2
            ry, rx = dy / max(1, h // 2), dx / max(1, w // 2)
            r = math.hypot(rx, ry)
            weight = {
                "rect": 1.0, "circ": float(r <= 1), "pyramid": max(0.0, 1 - max(abs(dx) / (w // 2 + 1), abs(dy) / (h // 2 + 1))),
                "cone": max(0.0, 1 - math.hypot(dx / (w // 2 + 1), dy / (h // 2 + 1))), "gauss": math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)),
            }[kind]
            if weight > 0:
                out.append((dy, dx, weight))
    total = sum(x[2] for x in out)
    return [(dy, dx, x / total) for dy, dx, x in out]


def _spread(a: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Every defined pixel sent to the pixels whose window it is in (a fixed number of rows each)."""
    table = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in offsets))
    sent = a.where(~F.isnan("v")).select("y", "x", "v", F.explode(table).alias("o"))
    return sent.select((F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", F.col("o.w").alias("w"))


def convolve(a: DataFrame, offsets: list[tuple[int, int, float]], allow_nan: bool = False) -> DataFrame:
    """Weighted means over the window; weights are normalised over the defined pixels inside the map.

    An undefined centre stays so, unless ``allow_nan``; a window without a defined pixel is NaN.
    """
    means = _spread(a, offsets).groupBy("y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    out = a.join(means, ["y", "x"], "left")
    value = F.coalesce("mean", _nan())
    return out.select("y", "x", (value if allow_nan else F.when(F.isnan("v"), _nan()).otherwise(value)).alias("v"))


def majority(a: DataFrame, w: int, h: int) -> DataFrame:
    """The most frequent defined value of the window, ties to the larger (no special case for counts of 3)."""
    sent = _spread(a, kernel("rect", w, h)).groupBy("y", "x", "v").agg(F.count("*").alias("n"))
    best = sent.groupBy("y", "x").agg(F.max(F.struct("n", "v")).alias("b"))
    out = a.join(best, ["y", "x"], "left")
    return out.select("y", "x", F.when(F.isnan("v"), _nan()).otherwise(F.coalesce("b.v", _nan())).alias("v"))


def fill_nan(a: DataFrame) -> DataFrame:
    """Undefined pixels become the mean of their defined neighbours (all read from the input, unlike the in-place scan)."""
    cross = [(0, -1, 1.0), (0, 1, 1.0), (-1, 0, 1.0), (1, 0, 1.0)]
    means = _spread(a, cross).groupBy("y", "x").agg(F.avg("v").alias("mean"))
    return a.join(means, ["y", "x"], "left").select("y", "x", F.when(F.isnan("v"), F.coalesce("mean", _nan())).otherwise(F.col("v")).alias("v"))


def roll(a: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    return a.select(F.pmod(F.col("y") + dy, F.lit(height)).alias("y"), F.pmod(F.col("x") + dx, F.lit(width)).alias("x"), "v")


def flip(a: DataFrame, height: int) -> DataFrame:
    return a.select((F.lit(height - 1) - F.col("y")).alias("y"), "x", "v")


def extract(a: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """The pixels of a range (ends excluded), counted from its corner."""
    return a.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def translate(a: DataFrame, table: list[tuple[float, float]], default: float) -> DataFrame:
    """Values by a table, others the default."""
    out = F.lit(float(default))
    for old, new in table:
        out = F.when(F.col("v") == old, F.lit(float(new))).otherwise(out)
    return a.select("y", "x", out.alias("v"))


def generate(spark, height: int, width: int, value: float) -> DataFrame:
    n = spark.range(height * width)
    return n.select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.lit(float(value)).alias("v"))


def _cubic_weights(t: Column) -> dict[int, Column]:
    """Weights of the pixels at -1, 0, 1 and 2 for a place ``t`` between the middle two."""
    return {
        -1: ((-t + 2.0) * t - 1.0) * t / 2.0, 0: ((t * 3.0 - 5.0) * t * t + 2.0) / 2.0,
        1: ((t * -3.0 + 4.0) * t + 1.0) * t / 2.0, 2: (t - 1.0) * t * t / 2.0,
    }


def sample(targets: DataFrame, a: DataFrame, method: str = "nearest", default: float = NAN) -> DataFrame:
    """``targets`` (``py, px`` in pixels of ``a``) with ``v``: the nearest pixel, bilinear over four corners, or
    bicubic over sixteen (the cubic through the inner two with the slopes of their neighbours)."""
    if method == "nearest":
        at = targets.withColumns({"y": F.round("py").cast("int"), "x": F.round("px").cast("int")})
        return at.join(a, ["y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(default))).drop("y", "x")
    y0, x0 = F.floor("py").cast("int"), F.floor("px").cast("int")
    t, u = F.col("px") - x0, F.col("py") - y0
    if method == "bicubic":
        wy, wx = _cubic_weights(u), _cubic_weights(t)
        corners = F.array(*(F.struct((y0 + j).alias("y"), (x0 + i).alias("x"), (wy[j] * wx[i]).alias("w")) for j in wy for i in wx))
    else:
        corners = F.array(*(F.struct((y0 + j).alias("y"), (x0 + i).alias("x"), ((u if j else 1 - u) * (t if i else 1 - t)).alias("w")) for j in (0, 1) for i in (0, 1)))
    keys = targets.columns
    spread = targets.withColumn("c", F.explode(corners)).select(*keys, F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.w").alias("w"))
    joined = spread.join(a, ["y", "x"], "left")
    value = F.sum(F.when(F.col("w") != 0, F.coalesce("v", F.lit(default)) * F.col("w")).otherwise(F.lit(0.0)))
    return joined.groupBy(*keys).agg(value.alias("v"))


def rescale(a: DataFrame, height: int, width: int, new_height: int, new_width: int, default: float = NAN) -> DataFrame:
    """Nearest samples at another resolution."""
    grid = generate(a.sparkSession, new_height, new_width, 0.0).select(F.col("y").alias("ny"), F.col("x").alias("nx"))
    grid = grid.withColumns({"py": F.col("ny") * (height / new_height), "px": F.col("nx") * (width / new_width)})
    return sample(grid, a, "nearest", default).select(F.col("ny").alias("y"), F.col("nx").alias("x"), "v")


def descents(a: DataFrame) -> DataFrame:
    """``y, x, ny, nx``: each pixel's highest neighbour still below it (ties: the last in y, then x), over cyclic borders."""
    top = a.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    if top.y is None:
        return a.select("y", "x", F.col("y").alias("ny"), F.col("x").alias("nx"))
    known = a.where(~F.isnan("v") & F.col("v").isNotNull())
    around = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j))
    sent = known.select(F.struct("v", F.col("y").alias("ny"), F.col("x").alias("nx")).alias("e"), "y", "x", F.inline(around))
    sent = sent.select(F.pmod(F.col("y") + F.col("j"), F.lit(top.y + 1)).alias("y"), F.pmod(F.col("x") + F.col("i"), F.lit(top.x + 1)).alias("x"), "e")
    lower = sent.join(known, ["y", "x"]).where(F.col("e.v") < F.col("v"))
    best = lower.groupBy("y", "x").agg(F.max("e").alias("e"))
    return best.select("y", "x", "e.ny", "e.nx")


def gradient_path(a: DataFrame, y0: int, x0: int) -> DataFrame:
    """``n, y, x, v``: from a pixel to the highest neighbour still below it, over cyclic borders, until there is none.

    Steps of all pixels are joined with themselves, so a round doubles the length of the path that is known.
    """
    jump = cut(descents(a))
    path = a.where((F.col("y") == y0) & (F.col("x") == x0) & ~F.isnan("v")).select(F.lit(0).alias("n"), "y", "x")
    length = 1
    while True:
        on = cut(path.join(jump, ["y", "x"]).select((F.col("n") + length).alias("n"), F.col("ny").alias("y"), F.col("nx").alias("x")))
        if on.isEmpty():
            return path.join(a, ["y", "x"]).select("n", "y", "x", "v")
        path, length = cut(path.unionByName(on)), length * 2
        far = jump.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("ny").alias("my"), F.col("nx").alias("mx"))
        jump = cut(jump.join(far, ["ny", "nx"]).select("y", "x", F.col("my").alias("ny"), F.col("mx").alias("nx")))


def npp_map(land: DataFrame, temp: DataFrame, rain: DataFrame, lat0: float, dlat: float) -> DataFrame:
    """Miami production times the cosine of the pixel's middle latitude where the mask is over 0, else 0."""
    joined = land.withColumnRenamed("v", "m").join(temp.withColumnRenamed("v", "t"), ["y", "x"]).join(rain.withColumnRenamed("v", "r"), ["y", "x"])
    lat = F.radians(F.lit(lat0) + F.col("y") * dlat + dlat / 2)
    value = F.when(F.col("m") > 0, F.cos(lat) * npp_miami(F.col("t"), F.col("r"))).otherwise(F.lit(0.0))
    return joined.select("y", "x", value.alias("v"))


def altitude_temperature(temp: DataFrame, altitude: DataFrame, threshold: float, rate: float) -> DataFrame:
    """Temperature plus rate times altitude; undefined under the threshold or without a finite temperature."""
    joined = temp.join(altitude.withColumnRenamed("v", "alt"), ["y", "x"])
    bad = F.isnan("v") | F.isnan("alt") | (F.col("alt") < threshold)
    return joined.select("y", "x", F.when(bad, _nan()).otherwise(F.col("v") + F.col("alt") * rate).alias("v"))


def sea_level(levels: list[tuple[float, float]], t: Column) -> Column:
    """The level at a time, linear between the given (time, level)."""
    from cohortspark.functions.curves import polyline

    return polyline(t, levels)


def biome_bins(biomes: DataFrame, t_bin: float, r_bin: float) -> DataFrame:
    """``tb, rb, biomes, multiple`` from ``temp, rain, biome``: the set of biomes of every climate bin."""
    binned = biomes.select(F.floor(F.col("temp") / t_bin).alias("tb"), F.floor(F.col("rain") / r_bin).alias("rb"), "biome")
    out = binned.groupBy("tb", "rb").agg(F.array_sort(F.collect_set("biome")).alias("biomes"))
    return out.withColumn("multiple", F.size("biomes") > 1)


def _ring_votes(multiple: DataFrame, single: DataFrame, radius: int) -> DataFrame:
    """``tb, rb, ring, biome, n`` around the bins of ``multiple`` up to the radius; tiles of that size meet their neighbours."""
    tile = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)))
    asks = multiple.select("tb", "rb", "biomes", F.explode(near).alias("o")).select("tb", "rb", "biomes", (tile("tb") + F.col("o.j")).alias("tt"), (tile("rb") + F.col("o.i")).alias("rt"))
    tells = single.select(tile("tb").alias("tt"), tile("rb").alias("rt"), F.col("tb").alias("ntb"), F.col("rb").alias("nrb"), "biome")
    ring = F.greatest(F.abs(F.col("tb") - F.col("ntb")), F.abs(F.col("rb") - F.col("nrb")))
    seen = asks.join(tells, ["tt", "rt"]).withColumn("ring", ring).where((F.col("ring") <= radius) & F.array_contains("biomes", F.col("biome")))
    return seen.groupBy("tb", "rb", "ring", "biome").agg(F.count("*").alias("n"))


def _first_leaders(votes: DataFrame, radius: int) -> DataFrame:
    """``tb, rb, biome``: rings are added up from the inside; the first sum that one biome alone leads decides."""
    upto = votes.withColumn("upto", F.explode(F.sequence(F.col("ring"), F.lit(radius).cast("bigint"))))
    sums = upto.groupBy("tb", "rb", "upto", "biome").agg(F.sum("n").alias("n"))
    each = sums.groupBy("tb", "rb", "upto").agg(F.sort_array(F.collect_list(F.struct("n", "biome")), asc=False).alias("by"))
    alone = (F.size("by") == 1) | (F.get("by", F.lit(0))["n"] > F.get("by", F.lit(1))["n"])
    led = each.where(alone).select("tb", "rb", "upto", F.get("by", F.lit(0))["biome"].alias("biome"))
    first = led.groupBy("tb", "rb").agg(F.min(F.struct("upto", "biome")).alias("b"))
    return first.select("tb", "rb", F.col("b.biome").alias("biome"))


def uniquify(bins: DataFrame, first_radius: int = 4) -> DataFrame:
    """``tb, rb, biome``: a bin of several biomes takes the one that leads around it. Rings of bins of one biome are
    added up from the inside until one of the bin's own biomes alone is the most frequent, up to the extent of the
    grid; where none ever is, the smallest. (Votes come from the bins of one biome at the start, where the original
    lets bins already decided vote too, in the order in which it meets them.)

    The radius doubles for the bins left until it has passed the extent of the grid."""
    bins = cut(bins)
    single = bins.where("size(biomes) = 1").select("tb", "rb", F.get("biomes", F.lit(0)).alias("biome"))
    left, told = bins.where("size(biomes) > 1").select("tb", "rb", "biomes"), single
    extent = bins.agg(F.greatest(F.max("tb") - F.min("tb"), F.max("rb") - F.min("rb"))).first()[0] or 0
    radius = max(1, first_radius)
    while True:
        found = cut(_first_leaders(_ring_votes(left, single, radius), radius))
        told, left = told.unionByName(found), cut(left.join(found, ["tb", "rb"], "left_anti"))
        if radius >= extent or left.isEmpty():
            return told.unionByName(left.select("tb", "rb", F.array_min("biomes").alias("biome")))
        radius *= 2


def capacity_by_bin(rows: DataFrame, t_bin: float, r_bin: float) -> DataFrame:
    """``tb, rb, mean, std, n`` of ``temp, rain, v`` (population deviation)."""
    binned = rows.select(F.floor(F.col("temp") / t_bin).alias("tb"), F.floor(F.col("rain") / r_bin).alias("rb"), "v")
    return binned.groupBy("tb", "rb").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))


def fill_bins(bins: DataFrame, wanted: DataFrame, radius: int) -> DataFrame:
    """``tb, rb, mean``: bins without data take the mean over the square of the radius around them (rings count once)."""
    offsets = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)))
    sent = bins.select("mean", "tb", "rb", F.explode(offsets).alias("o")).select((F.col("tb") + F.col("o.j")).alias("tb"), (F.col("rb") + F.col("o.i")).alias("rb"), F.col("mean").alias("near"))
    near = sent.groupBy("tb", "rb").agg(F.avg("near").alias("near"))
    out = wanted.join(bins.select("tb", "rb", "mean"), ["tb", "rb"], "left").join(near, ["tb", "rb"], "left")
    return out.select("tb", "rb", F.coalesce("mean", "near").alias("mean"))


def biomass(biomes: DataFrame, shares: DataFrame, density: float, radius: float, lat0: float, dlat: float, dlon: float) -> DataFrame:
    """``species, mass``: density times the species' share of the pixel's biome times the spherical pixel area; oceans (NaN) count nothing."""
    top, bottom = F.radians(F.lit(lat0) + (F.col("y") + 1) * dlat), F.radians(F.lit(lat0) + F.col("y") * dlat)
    area = (F.sin(top) - F.sin(bottom)) * (math.radians(dlon) * radius * radius)
    land = biomes.where(~F.isnan("v")).select(F.col("v").cast("int").alias("biome"), area.alias("area"))
    return land.join(shares, "biome").groupBy("species").agg(F.sum(F.col("area") * F.col("share") * density).alias("mass"))


def weighted_class(states: DataFrame, keys: list[str]) -> DataFrame:
    """The class with the largest summed weight (ties: the smaller class) of ``keys, biome, weight``."""
    total = states.groupBy(*keys, "biome").agg(F.sum("weight").alias("w"))
    best = total.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("w"), "biome")).alias("b"))
    return best.select(*keys, F.col("b.biome").alias("biome"))


def _shown(v: Column) -> Column:
    return F.when(F.isnan(v), F.lit("nan")).otherwise(F.format_string("%.6f", v))


def text_lines(a: DataFrame) -> DataFrame:
    """``y, line``: the pixels of each row as text, in the order of x."""
    rows = a.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("row"))
    return rows.select("y", F.array_join(F.transform("row", lambda p: _shown(p["v"])), " ").alias("line"))


def text_triples(a: DataFrame, lon0: float, dlon: float, lat0: float, dlat: float) -> DataFrame:
    """``value``: a line of longitude, latitude and value for each pixel, parted by tabs."""
    place = lambda c, first, step: F.format_string("%.6f", F.col(c) * step + first)
    return a.select(F.concat_ws("\t", place("x", lon0, dlon), place("y", lat0, dlat), _shown(F.col("v"))).alias("value"))


def trace(lines: DataFrame, steps: int) -> DataFrame:
    """``lines`` (``x0, y0, x1, y1`` in cells) with the cells ``x, y`` at ``steps`` + 1 places along each."""
    at = F.col("i") / float(steps)
    spread = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    along = lambda c: F.round(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * at).cast("int")
    return spread.withColumns({"x": along("x"), "y": along("y")}).drop("i", "x0", "y0", "x1", "y1")
