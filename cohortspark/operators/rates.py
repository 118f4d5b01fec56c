"""Ageing, fertility, births and deaths as expressions over agents joined with per-cell counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.draws import u

DEAD, ALIVE, FERTILE, MOVING = 0, 1, 5, 8


def alive(agents: DataFrame) -> DataFrame:
    return agents.where(F.col("life_state") > DEAD)


def counts(agents: DataFrame) -> DataFrame:
    """``cell, n``: living agents of each cell that has any."""
    return alive(agents).groupBy("cell").agg(F.count("*").alias("n"))


def with_counts(agents: DataFrame) -> DataFrame:
    """Agents with their cell's count; an equi-join on the cell (counts have one row per cell)."""
    return agents.join(counts(agents), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def get_old(agents: DataFrame, t: float) -> DataFrame:
    """Age of the living; the dead keep none."""
    return agents.withColumn("age", F.when(F.col("life_state") > DEAD, F.lit(t) - F.col("birth_time")))


def fertility(agents: DataFrame, t: float, low: float, high: float, pause: float) -> DataFrame:
    """Females are fertile strictly between two ages and after the pause since their last birth, males above the lower age."""
    female = (F.col("age") > low) & (F.col("age") < high) & (F.lit(t) - F.col("last_birth") > pause)
    fertile = F.when(F.col("gender") == 0, female).otherwise(F.col("age") > low)
    state = F.when(F.col("life_state") > DEAD, F.when(fertile, FERTILE).otherwise(ALIVE)).otherwise(F.col("life_state"))
    return agents.withColumn("life_state", state)


def spread(draw: Column, width: float) -> Column:
    """A factor drawn between 1 - width and 1 + width."""
    return F.lit(1 - width) + draw * (2 * width)


def old_age_death(agents: DataFrame, max_age: float, width: float, seed: int, step: int) -> DataFrame:
    over = F.col("age") * spread(u(seed, step, "oldage", F.col("id")), width) > max_age
    return agents.withColumn("is_dead", F.coalesce((F.col("life_state") > DEAD) & over, F.lit(False)))


def manage_mass(agents: DataFrame, delta: float, low: float, high: float) -> DataFrame:
    """Mass changes by a constant; under the minimum the agent dies, over the maximum it is clamped."""
    mass = F.col("mass") + delta
    return agents.withColumn("is_dead", mass < low).withColumn("mass", F.least(mass, F.lit(high)))


def linear_rate(rate0: float, theta: float, n: Column, k: Column) -> Column:
    return F.lit(rate0) + (F.lit(theta) - rate0) * n / k


def birth_rate(b0: float, theta: float, n: Column, k: Column) -> Column:
    """No births where the capacity is 0 or less; a negative rate is a probability of death."""
    return F.when(k <= 0, F.lit(0.0)).otherwise(linear_rate(b0, theta, n, k))


def death_rate(d0: float, theta: float, n: Column, k: Column) -> Column:
    """Certain death where the capacity is 0 or less."""
    return F.when(k <= 0, F.lit(1.0)).otherwise(linear_rate(d0, theta, n, k))


def linear_birth(agents: DataFrame, b0: float, theta: float, k: Column, seed: int, step: int, paired: bool = False) -> DataFrame:
    """Adds ``is_birth`` and ``is_dead`` (from negative rates). ``agents`` has ``n``; paired: only females with a mate give birth."""
    b, draw = birth_rate(b0, theta, F.col("n"), k), u(seed, step, "birth", F.col("id"))
    may = F.col("life_state") > DEAD
    mother = may & (F.col("gender") == 0) & (F.coalesce("mate_id", F.lit(-1)) >= 0) if paired else may
    return agents.withColumns({"is_birth": mother & (draw < b), "is_dead": may & (b < 0) & (draw < -b)})


def linear_death(agents: DataFrame, d0: float, theta: float, k: Column, seed: int, step: int) -> DataFrame:
    d = death_rate(d0, theta, F.col("n"), k)
    died = (F.col("life_state") > DEAD) & (u(seed, step, "death", F.col("id")) < d)
    return agents.withColumn("is_dead", (F.coalesce("is_dead", F.lit(False)) if "is_dead" in agents.columns else F.lit(False)) | died)


def verhulst(agents: DataFrame, b0: float, d0: float, theta: float, k: Column, seed: int, step: int) -> DataFrame:
    """Logistic growth: births and then deaths with rates that meet at ``theta`` when the cell is at capacity."""
    born = linear_birth(with_counts(agents), b0, theta, k, seed, step)
    return linear_death(born, d0, theta, k, seed, step)


def apply_births_deaths(agents: DataFrame, step: int, seed: int) -> DataFrame:
    """The living who did not die, and newborns in their mothers' cells (a mother may die in the same step).

    A newborn's id is a hash of its mother's and the step, its gender a draw; newborn females start fertile.
    """
    kept = agents.where((F.col("life_state") > DEAD) & ~F.col("is_dead")).select("id", "cell", "life_state", "birth_time", "gender")
    girl = u(seed, step, "gender", F.col("id")) < 0.5
    baby = agents.where("is_birth").select(
        newborn_id(F.col("id"), step).alias("id"), "cell", F.when(girl, FERTILE).otherwise(ALIVE).alias("life_state"),
        F.lit(float(step)).alias("birth_time"), F.when(girl, 0).otherwise(1).alias("gender"),
    )
    return kept.unionByName(baby)


def newborn_id(mother: Column, step: int) -> Column:
    """52 bits of a digest of (mother, step), above all ids of founders."""
    digest = F.md5(F.concat_ws("|", F.lit("child"), mother.cast("string"), F.lit(str(step))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + (1 << 40)


def lotka_volterra(agents: DataFrame, other_counts: DataFrame, self_rate: float, mix_rate: float, k: float, seed: int, step: int) -> DataFrame:
    """Positive parts of the own and the mixed rate add up to births, negative parts to deaths; draws are independent."""
    others = other_counts.select("cell", F.col("n").alias("n_other"))
    joined = agents.join(others, "cell", "left")
    mixed = F.lit(mix_rate) * F.coalesce("n_other", F.lit(0)) / k
    zero = F.lit(0.0)
    b = F.lit(max(self_rate, 0.0)) + F.greatest(mixed, zero)
    d = F.lit(max(-self_rate, 0.0)) + F.greatest(-mixed, zero)
    may = F.col("life_state") > DEAD
    return joined.withColumns({"is_birth": may & (u(seed, step, "lvb", F.col("id")) < b), "is_dead": may & (u(seed, step, "lvd", F.col("id")) < d)})


def birther(agents: DataFrame, birth_mass: float, width: float, seed: int, step: int) -> DataFrame:
    """A body heavier than a drawn baby mass gives it away and gives birth."""
    baby = spread(u(seed, step, "baby", F.col("id")), width) * birth_mass
    gives = (F.col("life_state") > DEAD) & (F.col("mass") > baby)
    return agents.withColumns(
        {"is_birth": gives, "baby_mass": F.when(gives, baby).otherwise(F.lit(0.0)), "mass": F.when(gives, F.col("mass") - baby).otherwise(F.col("mass"))}
    )
