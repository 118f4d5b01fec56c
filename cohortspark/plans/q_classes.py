"""Every population class run for three steps over the model's agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.draws import u_sql
from cohortspark.operators import genetics as ge
from cohortspark.plans import model as m
from cohortspark.plans import q_simulate, simulate as s  # noqa: F401 (its sub-queries come first)
from cohortspark.plans.populations import CLASSES, add_class
from cohortspark.registry import cte, query
from cohortspark.sources.config import Population

STEPS = 3
PARAMS = {
    "Verhulst_b0": "0.2", "Verhulst_d0": "0.02", "Verhulst_theta": "0.05", "Verhulst_K": "70", "RandomMove_prob": "0.3", "WeightedMoveProb": "0.4",
    "AltCapPref": "-4000 0 0 0.01 10 1 3000 0.2", "NPPPref": "0 0 500 1 3000 2", "Genetics_mutation_rate": "0.01", "MM_delta": "-0.2", "MM_mass_min": "0.5",
    "MM_mass_max": "12", "NavigateProb0": "0.05", "NavigateDist0": "1500", "Fertility_interbirth": "1", "OAD_max_age": "58",
}


def definition(name: str) -> Population:
    return Population(class_name=name, species=name, params=dict(PARAMS))


def people(spark: SparkSession, sf: str, own: tuple[str, ...]) -> DataFrame:
    """The model's living agents with the columns that the class's actions need."""
    a = m.agents(spark, sf).where("life_state > 0").withColumn("age", -F.col("birth_time"))
    columns = ["id", "cell", "life_state", "gender", "birth_time"]
    columns += ["age"] * any(x in own for x in ("GetOld", "OldAgeDeath", "Fertility", "DirMove"))
    columns += ["last_birth"] * ("Fertility" in own) + ["mass"] * ("MassManager" in own)
    if "Genetics" in own or "AssPair" in own or "AssPairHam" in own or "SelPair" in own or "RandDistrPair" in own:
        a = a.join(m.genomes(spark, sf).drop("cell"), "id")
        columns += ["strand1", "strand2"]
    if "Phenetics" in own:
        a = a.withColumn("traits", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (ge.digest_block("trait", F.col("id"), i) % 100).cast("double")))
        columns.append("traits")
    if "DirMove" in own:
        a = a.withColumns({"direction": (F.col("id") % 4) * 1.5707963 - 1.5707963, "error": F.lit(0.0)})
        columns += ["direction", "error"]
    return a.select(*columns)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The lattice with the direction of each neighbour: left, up, right, down."""
    angle = F.element_at(F.array(*map(F.lit, (3.14159265, -1.57079633, 0.0, 1.57079633))), F.col("k") + 1)
    return m.edges(spark, sf).withColumn("angle", angle)


def simulation(spark: SparkSession, sf: str, name: str) -> s.Simulation:
    """A class with what it needs: hunters hunt the prey of their kind, ships go between the cells divisible by 3."""
    own = CLASSES[name]
    ports = m.cells(spark, sf).where("cell % 3 = 0").select("cell")
    nav = ports.select(F.col("cell").alias("port")).join(ports.select(F.col("cell").alias("dest")), F.col("port") < F.col("dest")).withColumn("dist", F.lit(1500.0))
    sim = s.Simulation({}, {}, edges(spark, sf), m.env(spark, sf), nav_edges=nav)
    hunts = "Hunting" in own or "PDHunting" in own
    if hunts:
        prey = {"SimplePredPop": "SimplePreyPop", "PDPredPop": "PDPreyPop", "PDAltPredPop": "PDAltPreyPop"}[name]
        columns = ["id", "cell", "life_state", "gender", "birth_time", "mass"]
        sim.populations = {name: m.predators(spark, sf).select(*columns), prey: people(spark, sf, CLASSES[prey])}
        add_class(sim, name, definition(name), prey)
        add_class(sim, prey, definition(prey))
    else:
        sim.populations = {name: people(spark, sf, own)}
        add_class(sim, name, definition(name), allowed=m.env(spark, sf).where("altitude > -4400").select("cell") if "ConfinedMove" in own else None)
    return sim


def run(spark: SparkSession, sf: str, name: str, steps: int = STEPS) -> DataFrame:
    sim = simulation(spark, sf, name)
    sim.run(steps)
    return sim.populations[name]


def _grown(n: int, own: tuple[str, ...], name: str) -> None:
    """The SQL of one step of a class of growth, plain moves, ageing and mass."""
    d = lambda action, i="id": u_sql(7, n, action, i)
    b, dd = "(0.2e0 + (0.05e0 - 0.2e0) * n / 70e0)", "(0.02e0 + (0.05e0 - 0.02e0) * n / 70e0)"
    grows, has_mass = "Verhulst" in own, "MassManager" in own
    birth = f"{d('birth')} < {b}" if grows else "false"
    death = f"({b} < 0 AND {d('birth')} < -{b}) OR {d('death')} < {dd}" if grows else "false"
    where = {"RandomMove": f"ns[CAST(least(floor({d('where')} * 4), 3) AS INTEGER) + 1]", "RandomMove1D": f"CASE WHEN {d('where')} < 0.5 THEN ns[1] ELSE ns[3] END"}
    moves = next((f"CASE WHEN {d('move')} < 0.3e0 THEN {w} END" for k, w in where.items() if k in own), "NULL::INTEGER")
    baby = f"((0.8e0 + {d('babymass')} * 0.45e0) * 0.5e0)"
    left = f"(mass - CASE WHEN is_birth THEN {baby} ELSE 0e0 END + -0.2e0)"
    starved = f"{left} < 0.5e0" if has_mass else "false"
    mass = f", least({left}, 12e0) AS mass" if has_mass else ""
    baby_mass = f", {baby}" if has_mass else ""
    cte(f"{name}_acts{n}", f"""SELECT a.*, {birth} AS is_birth, {death} AS died, {moves} AS target
      FROM (SELECT a.*, count(*) OVER (PARTITION BY a.cell) AS n, ns FROM {{{name}{n}}} a JOIN {{nbrs}} g ON g.cell = a.cell) a""")
    cte(f"{name}_babies{n}", f"SELECT *, ('0x' || substr(md5(concat_ws('|', 'child', id || '.1', '{n}')), 1, 13))::BIGINT + {1 << 40} AS child FROM {{{name}_acts{n}}} WHERE is_birth")
    cte(f"{name}{n + 1}", f"""SELECT id, CAST(coalesce(target, cell) AS INTEGER) AS cell, CASE WHEN target IS NULL THEN life_state ELSE life_state & ~8 END AS life_state, gender, birth_time{mass}
      FROM {{{name}_acts{n}}} WHERE NOT died AND NOT {starved}
      UNION ALL SELECT child, cell, CASE WHEN {d('gender', 'child')} < 0.5 THEN 5 ELSE 1 END, CASE WHEN {d('gender', 'child')} < 0.5 THEN 0 ELSE 1 END, {n}e0{baby_mass} FROM {{{name}_babies{n}}}""")


def _register(name: str, own: tuple[str, ...]) -> None:
    if set(own) <= {"Verhulst", "RandomMove", "RandomMove1D", "GetOld", "MassManager", "IndexCollector"}:
        mass = ", mass" if "MassManager" in own else ""
        cte(f"{name}0", f"SELECT id, cell, life_state, CAST(gender AS INTEGER) AS gender, birth_time{mass} FROM {{agents}} WHERE life_state > 0")
        for n in range(STEPS):
            _grown(n, own, name)
        age = f", CASE WHEN birth_time < {STEPS - 1} THEN {STEPS - 1}e0 - birth_time ELSE 0e0 END AS age" if "GetOld" in own else ""
        mass = ", round(mass, 6) AS mass" if mass else ""

        @query(f"K_{name}", f"SELECT id, cell, life_state, gender{age}{mass} FROM {{{name}{STEPS}}}")
        def _(spark, sf):
            out = run(spark, sf, name)
            extra = (["age"] if age else []) + ([F.round("mass", 6).alias("mass")] if mass else [])
            return out.select("id", "cell", "life_state", "gender", *extra)

        return

    @query(f"K_{name}")
    def _(spark, sf):
        out = run(spark, sf, name)
        return out.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("gender") == 0).alias("females"), F.count_if(F.col("birth_time") >= 0).alias("born"))


for _name, _own in CLASSES.items():
    _register(_name, _own)
