"""The step loop: actions by priority over populations, committed at the end of each step.

An action has two parts. ``prepare`` builds its per-cell or pair tables from the agents as they
are at the start of the step (all actions are prepared before any acts); ``act`` folds its effect
into one wide frame of agents: ``n_births``, ``is_dead``, ``target``, ``mate_id`` and whatever
columns it owns. Actions that are plain expressions fuse into one projection. Deaths count at
once for later actions; births and moves are applied when the step ends, births first. Every step
starts from populations whose lineage was cut through the shared checkpoint folder: the plan of a
step does not depend on how many there were before, and a lost executor costs one step at most.

Tables that follow from the environment alone (weights of moving, capacities, ways by sea) are
derived when an action first asks for them and kept until the layers change (``update_env``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.draws import u
from cohortspark.functions.genome import diploid_distance
from cohortspark.functions.lineage import cut
from cohortspark.operators import evaluators, genetics, moving, pairing, rates

TRANSIENT = ("n_births", "is_dead", "target", "mate_id")


@dataclass
class Action:
    """``prepare(sim, agents)`` gives a context for ``act(sim, agents, context)``.

    ``inherit`` adds ``baby_<column>`` to rows of newborns: their mother's columns, and their father's
    as ``father_<column>`` (null without one).
    """

    name: str
    act: Callable[[Simulation, DataFrame, object], DataFrame] = lambda sim, agents, _: agents
    prepare: Callable[[Simulation, DataFrame], object] = lambda sim, agents: None
    priority: int = 0
    inherit: Callable[[Simulation, DataFrame], DataFrame] | None = None


@dataclass
class Simulation:
    populations: dict[str, DataFrame]
    actions: dict[str, list[Action]]
    edges: DataFrame
    env: DataFrame
    seed: int = 7
    step_no: int = 0
    iters: int = 0
    events: dict[int, list[Callable[[Simulation], None]]] = field(default_factory=dict)
    at_end: list[Callable[[Simulation], None]] = field(default_factory=list)
    nav_edges: DataFrame | None = None
    env_version: int = 0
    _derived: dict[str, tuple[int, DataFrame]] = field(default_factory=dict)

    def add_action(self, population: str, action: Action) -> None:
        self.actions.setdefault(population, []).append(action)

    def remove_action(self, population: str, name: str) -> bool:
        """Whether there was such an action."""
        own = self.actions.get(population, [])
        self.actions[population] = [a for a in own if a.name != name]
        return len(own) != len(self.actions[population])

    def update_env(self, env: DataFrame, nav_edges: DataFrame | None = None, drown: bool = True) -> None:
        """New layers: what was derived from the old ones is derived again when it is next asked for; agents in water
        or on ice die at once (``drown``)."""
        self.env, self.env_version = cut(env), self.env_version + 1
        self.nav_edges = self.nav_edges if nav_edges is None else nav_edges
        if drown:
            dry = self.env.where((F.col("altitude") >= 0) & ~F.col("ice")).select("cell")
            self.populations = {n: cut(p.join(dry, "cell", "left_semi")) for n, p in self.populations.items()}

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name for the current layers."""
        version, table = self._derived.get(name, (-1, None))
        if version != self.env_version:
            table = cut(build())
            self._derived[name] = (self.env_version, table)
        return table

    def command(self, line: str) -> bool:
        """``SET ITERS n`` (at least one more step) or ``REMOVE ACTION population:action``; whether it could be done."""
        words = line.split()
        if words[:2] == ["SET", "ITERS"] and len(words) == 3 and words[2].lstrip("-").isdigit():
            self.iters = int(words[2]) if int(words[2]) >= self.step_no else self.step_no + 1
            return True
        if words[:2] == ["REMOVE", "ACTION"] and len(words) == 3 and ":" in words[2]:
            population, _, action = words[2].partition(":")
            return self.remove_action(population, action)
        return False

    def step(self) -> None:
        for act in self.events.get(self.step_no, []):
            act(self)
        wide = {}
        for name, agents in self.populations.items():
            ready = agents.withColumns({"n_births": F.lit(0), "is_dead": F.lit(False), "target": F.lit(None).cast("int"), "mate_id": F.lit(None).cast("bigint")})
            wide[name] = ready.where(F.col("life_state") > rates.DEAD)
        self.populations = wide
        contexts = {(p, a.name): a.prepare(self, wide[p]) for p, own in self.actions.items() for a in own}
        order = sorted(((a.priority, n, p, a) for n, (p, own) in enumerate(self.actions.items()) for a in own), key=lambda x: x[:2])
        for _, _, p, action in order:
            self.populations[p] = action.act(self, self.populations[p], contexts[p, action.name])
        self.step_no += 1
        for name, agents in self.populations.items():
            heirs = [a.inherit for a in self.actions.get(name, []) if a.inherit is not None]
            self.populations[name] = cut(commit(self, agents, self.step_no - 1, heirs))

    def run(self, steps: int, stop_when_empty: bool = True) -> None:
        """``steps`` more steps (commands may change their number), or until no agent is left; then the final events."""
        self.iters = self.step_no + steps
        while self.step_no < self.iters:
            self.step()
            if stop_when_empty and all(p.isEmpty() for p in self.populations.values()):
                break
        for act in self.at_end:
            act(self)

    def dump(self, path: str) -> None:
        """Agents, layers and counters under a shared folder, for ``restore``; actions are code and are added anew."""
        for name, agents in self.populations.items():
            agents.write.mode("overwrite").parquet(f"{path}/population={name}")
        self.env.write.mode("overwrite").parquet(f"{path}/env")
        spark = self.env.sparkSession
        state = {"seed": self.seed, "step_no": self.step_no, "iters": self.iters, "env_version": self.env_version, "populations": list(self.populations)}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    def restore(self, path: str) -> None:
        """Goes on where ``dump`` stopped: draws depend on the seed, the step and ids alone."""
        spark = self.env.sparkSession
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        self.populations = {name: spark.read.parquet(f"{path}/population={name}") for name in state["populations"]}
        self.env, self._derived = spark.read.parquet(f"{path}/env"), {}
        self.seed, self.step_no, self.iters, self.env_version = (state[k] for k in ("seed", "step_no", "iters", "env_version"))


def commit(sim: Simulation, agents: DataFrame, step: int, heirs: list[Callable[[Simulation, DataFrame], DataFrame]]) -> DataFrame:
    """Survivors in their new cells, and newborns in their mothers' old ones."""
    own = [c for c in agents.columns if c not in TRANSIENT]
    state = F.when(F.col("target").isNotNull(), F.col("life_state").bitwiseAND(F.lit(~rates.MOVING))).otherwise(F.col("life_state"))
    moved = {"cell": F.coalesce("target", "cell"), "life_state": state}
    if "last_birth" in own:
        moved["last_birth"] = F.when(F.col("n_births") > 0, F.lit(float(step))).otherwise(F.col("last_birth"))
    kept = agents.where(~F.col("is_dead")).select(*(moved.get(c, F.col(c)).alias(c) for c in own))
    girl = u(sim.seed, step, "gender", F.col("child"))
    born = agents.where("n_births > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n_births"))))
    child = rates.newborn_id(F.concat_ws(".", F.col("id").cast("string"), F.col("nth").cast("string")), step)
    born = born.withColumn("child", child).withColumn("girl", girl < 0.5)
    fresh = {
        "id": F.col("child"), "life_state": F.when(F.col("girl"), rates.FERTILE).otherwise(rates.ALIVE),
        "gender": F.when(F.col("girl"), 0).otherwise(1), "birth_time": F.lit(float(step)), "cell": F.col("cell"),
        "age": F.lit(0.0), "last_birth": F.lit(0.0), "mother": F.col("id"), "father": F.col("mate_id"), "species": F.col("species") if "species" in own else F.lit(None),
    }
    if heirs:
        fathers = agents.select(F.col("id").alias("mate_id"), *(F.col(c).alias(f"father_{c}") for c in own))
        born = cut(born.join(fathers, "mate_id", "left"))
        for heir in heirs:
            born = heir(sim, born)
    fresh |= {c.removeprefix("baby_"): F.col(c) for c in born.columns if c.startswith("baby_") and c.removeprefix("baby_") in own}
    types = {f.name: f.dataType for f in agents.schema.fields}
    newborn = born.select(*(fresh.get(c, F.lit(None)).cast(types[c]).alias(c) for c in own))
    return kept.unionByName(newborn)


def with_target(agents: DataFrame, move: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A move of agents that are neither dead nor on a way already; ``move`` adds ``target`` to agents without one."""
    had = agents.withColumnRenamed("target", "had_target")
    out = move(had)
    may = ~F.col("is_dead") & F.col("had_target").isNull()
    return out.withColumn("target", F.coalesce("had_target", F.when(may, F.col("target")))).drop("had_target")


def get_old(priority: int = 0) -> Action:
    return Action("GetOld", lambda sim, a, _: rates.get_old(a, float(sim.step_no)), priority=priority)


def fertility(low: float, high: float, pause: float, priority: int = 0) -> Action:
    return Action("Fertility", lambda sim, a, _: rates.fertility(a, float(sim.step_no), low, high, pause), priority=priority)


def old_age_death(max_age: float, width: float, priority: int = 0) -> Action:
    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        before = F.col("was_dead")
        out = rates.old_age_death(agents.withColumn("was_dead", F.col("is_dead")), max_age, width, sim.seed, sim.step_no)
        return out.withColumn("is_dead", before | F.col("is_dead")).drop("was_dead")

    return Action("OldAgeDeath", act, priority=priority)


def _grow(sim: Simulation, agents: DataFrame, n: Column, k: Column, b0: float, d0: float, theta: float, paired: bool) -> DataFrame:
    b, d = rates.birth_rate(b0, theta, n, k), rates.death_rate(d0, theta, n, k)
    birth, death = u(sim.seed, sim.step_no, "birth", F.col("id")), u(sim.seed, sim.step_no, "death", F.col("id"))
    may = ~F.col("is_dead")
    mother = may & (F.col("gender") == 0) & F.col("mate_id").isNotNull() if paired else may
    return agents.withColumns(
        {"n_births": F.col("n_births") + (mother & (birth < b)).cast("int"), "is_dead": F.col("is_dead") | (may & (((b < 0) & (birth < -b)) | (death < d)))}
    )


def verhulst(b0: float, d0: float, theta: float, k: float, priority: int = 0, paired: bool = False) -> Action:
    """Rates come from the counts at the start of the step; paired: only females with a mate give birth."""

    def act(sim: Simulation, agents: DataFrame, counts: object) -> DataFrame:
        return _grow(sim, agents.join(counts, "cell"), F.col("n"), F.lit(float(k)), b0, d0, theta, paired).drop("n")

    return Action("Verhulst", act, lambda sim, agents: rates.counts(agents), priority)


def verhulst_var_k(b0: float, d0: float, theta: float, priority: int = 0, paired: bool = True, **bounds: float) -> Action:
    """Verhulst with each cell's own capacity."""

    def prepare(sim: Simulation, agents: DataFrame) -> DataFrame:
        return rates.counts(agents).join(capacities(sim, **bounds), "cell", "left").select("cell", "n", F.coalesce("capacity", F.lit(0.0)).alias("k"))

    def act(sim: Simulation, agents: DataFrame, counts: object) -> DataFrame:
        return _grow(sim, agents.join(counts, "cell"), F.col("n"), F.col("k"), b0, d0, theta, paired).drop("n", "k")

    return Action("VerhulstVarK", act, prepare, priority)


def capacities(sim: Simulation, **bounds: float) -> DataFrame:
    return sim.derived("capacity", lambda: evaluators.capacity(sim.env, **bounds))


def npp_capacity(priority: int = 0, **bounds: float) -> Action:
    """Derives the cells' capacities where the layers have changed."""
    return Action("NPPCapacity", prepare=lambda sim, agents: capacities(sim, **bounds), priority=priority)


Curve = tuple[str, list[tuple[float, float]], float]


def evaluate(sim: Simulation, curves: list[Curve], mode: str, name: str) -> DataFrame:
    """Cumulated weights over each cell and its neighbours, from (layer, curve, weight)."""

    def build() -> DataFrame:
        parts = [(evaluators.single_evaluator(sim.edges, sim.env, layer, knots, False), w) for layer, knots, w in curves]
        return evaluators.multi_evaluator(parts, mode)

    return sim.derived(f"weights {name}", build)


def multi_evaluator(curves: list[Curve], mode: str = "add_block", priority: int = 0, name: str = "MultiEvaluator") -> Action:
    return Action(name, prepare=lambda sim, agents: evaluate(sim, curves, mode, "own"), priority=priority)


def share_evaluator(other: str, knots: list[tuple[float, float]], priority: int = 0) -> Action:
    """Weights by the numbers of another population, anew each step; left for the moves in ``sim``."""

    def prepare(sim: Simulation, agents: DataFrame) -> None:
        n = rates.counts(sim.populations[other]).select("cell", F.col("n").cast("double").alias("n"))
        here = sim.env.select("cell", "ice").join(n, "cell", "left").select("cell", "ice", F.coalesce("n", F.lit(0.0)).alias("n"))
        sim._derived["weights shared"] = (sim.env_version, cut(evaluators.single_evaluator(sim.edges, here, "n", knots)))

    return Action("ShareEvaluator", prepare=prepare, priority=priority)


def weighted_move(prob: float, uniform_if_zero: bool = False, weights: str = "own", priority: int = 0) -> Action:
    """A move by the weights that an evaluator of this population has left."""

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        cum = sim._derived[f"weights {weights}"][1]
        return with_target(agents, lambda a: moving.weighted_move(a, cum, sim.env, prob, sim.seed, sim.step_no, uniform_if_zero))

    return Action("WeightedMoveRand" if uniform_if_zero else "WeightedMove", act, priority=priority)


def confined_move(allowed: DataFrame, priority: int = 0) -> Action:
    """Gives up targets outside the allowed cells; comes after the moves."""
    return Action("ConfinedMove", lambda sim, agents, _: moving.confine(agents, allowed), priority=priority)


def navigate(p0: float, d0: float, decay: float, priority: int = 0) -> Action:
    def prepare(sim: Simulation, agents: DataFrame) -> DataFrame | None:
        return None if sim.nav_edges is None else sim.derived("ways", lambda: moving.navigation_table(sim.nav_edges, p0, d0, decay))

    def act(sim: Simulation, agents: DataFrame, ways: object) -> DataFrame:
        return agents if ways is None else with_target(agents, lambda a: moving.navigate(a, ways, sim.env, sim.seed, sim.step_no))

    return Action("Navigate", act, prepare, priority)


def directed_move(min_age: float = 5.0, priority: int = 0) -> Action:
    """Agents have ``direction, error, age``, edges ``angle``."""

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        out = with_target(agents, lambda a: moving.directed_move(a, sim.edges, min_age))
        return out.withColumn("error", F.when(F.col("is_dead"), F.col("error")).otherwise(F.col("new_error"))).drop("new_error")

    return Action("DirMove", act, priority=priority)


def random_move_1d(prob: float, priority: int = 0) -> Action:
    return Action("RandomMove1D", lambda sim, agents, _: with_target(agents, lambda a: moving.random_move_1d(a, sim.edges, prob, sim.seed, sim.step_no)), priority=priority)


def random_move(prob: float, absorbing: bool = False, priority: int = 0) -> Action:
    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        plain = agents.drop("target")
        out = moving.random_move(plain.withColumnRenamed("is_dead", "was_dead"), sim.edges, prob, sim.seed, sim.step_no, absorbing)
        lost = F.col("is_dead") if absorbing else F.lit(False)
        return out.withColumn("is_dead", F.col("was_dead") | lost).withColumn("target", F.when(~F.col("was_dead"), F.col("target"))).drop("was_dead")

    return Action("RandomMove", act, priority=priority)


def paired(agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``mate_id`` of both partners."""
    mates = pairs.select(F.col("female").alias("id"), F.col("male").alias("mate")).unionByName(pairs.select(F.col("male").alias("id"), F.col("female").alias("mate")))
    return agents.drop("mate_id").join(mates, "id", "left").withColumnRenamed("mate", "mate_id")


def pairing_action(name: str, make: Callable[[Simulation, DataFrame], DataFrame], priority: int = 0) -> Action:
    """``make`` gives ``female, male`` from the agents at the start of the step."""
    return Action(name, lambda sim, agents, pairs: paired(agents, pairs), lambda sim, agents: cut(make(sim, agents).select("female", "male")), priority)


def random_pair(priority: int = 0) -> Action:
    return pairing_action("RandomPair", lambda sim, agents: pairing.random_pairs(agents, sim.seed, sim.step_no), priority)


def _strands(agents: DataFrame, who: str) -> DataFrame:
    return agents.select(F.col("id").alias(who), F.col("strand1").alias(f"{who}1"), F.col("strand2").alias(f"{who}2"))


def genetic_distance(agents: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.join(_strands(agents, "female"), "female").join(_strands(agents, "male"), "male")
    return both.withColumn("dist", diploid_distance(*map(F.col, ("female1", "female2", "male1", "male2")))).drop("female1", "female2", "male1", "male2")


def fertile(agents: DataFrame) -> DataFrame:
    return agents.where(F.col("life_state") == rates.FERTILE)


def random_distance_pair(d_crit: float, v_crit: float, slope: float, priority: int = 0) -> Action:
    def make(sim: Simulation, agents: DataFrame) -> DataFrame:
        pairs = genetic_distance(agents, pairing.random_pairs(agents, sim.seed, sim.step_no))
        return pairing.accepted_pairs(pairs, F.col("dist"), d_crit, v_crit, slope, sim.seed, sim.step_no)

    return pairing_action("RandDistrPair", make, priority)


def selective_pair(knots: list[tuple[float, float]], priority: int = 0) -> Action:
    """Females draw a mate by a curve of the genetic distance."""

    def make(sim: Simulation, agents: DataFrame) -> DataFrame:
        return pairing.selected_pairs(fertile(agents), partial(pairing.curve, knots=knots), sim.seed, sim.step_no)

    return pairing_action("SelPair", make, priority)


def assortative_pair(cutoff: float, loci: int, by_blocks: bool = False, priority: int = 0) -> Action:
    """The most alike first: by the share of equal loci, or by the number of equal blocks."""

    def make(sim: Simulation, agents: DataFrame) -> DataFrame:
        if by_blocks:
            return pairing.shared_pairs(fertile(agents), None, cutoff, sim.seed, sim.step_no)
        return pairing.assortative_pairs(fertile(agents), partial(pairing.likeness, loci=float(loci)), cutoff, sim.seed, sim.step_no)

    return pairing_action("AssPair" if by_blocks else "AssPairHam", make, priority)


def inherit_genes(blocks: int, loci: int, breaks: int = -1, rate: float = 0.01, priority: int = 0) -> Action:
    """Newborns get a genome from their parents' (a mother without a mate counts for both)."""

    def inherit(sim: Simulation, born: DataFrame) -> DataFrame:
        sides = {"m1": "strand1", "m2": "strand2", "d1": "father_strand1", "d2": "father_strand2"}
        parents = born.select(F.col("child").alias("id"), *(F.coalesce(c, c.removeprefix("father_")).alias(n) for n, c in sides.items()))
        made = genetics.offspring(parents, blocks, loci, sim.seed, sim.step_no - 1, breaks, rate)
        made = cut(made.select(F.col("id").alias("child"), F.col("strand1").alias("baby_strand1"), F.col("strand2").alias("baby_strand2")))
        return born.join(made, "child")

    return Action("Genetics", priority=priority, inherit=inherit)


def inherit_phenes(sigma: float, priority: int = 0) -> Action:
    """Newborns get the mean of their parents' traits, each with a normal nudge."""

    def inherit(sim: Simulation, born: DataFrame) -> DataFrame:
        mean = genetics.mix_phenomes(F.col("traits"), F.coalesce("father_traits", "traits"))
        return born.withColumn("baby_traits", genetics.mutate_phenome(mean, sigma, sim.seed, sim.step_no - 1, F.col("child")))

    return Action("Phenetics", priority=priority, inherit=inherit)


def index_collector(priority: int = 0) -> Action:
    """The original's list of agents per cell for hunters; here a hunt joins by cell, so nothing is to be kept."""
    return Action("IndexCollector", priority=priority)


def distributed_hunting(prey: str, ratio: float, usability: float, priority: int = 0) -> Action:
    """Each prey is assigned to one hunter of its cell, or to none; hunters eat all that is theirs."""

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        quarry = sim.populations[prey]
        hunters = agents.where(~F.col("is_dead")).withColumn("species", F.lit(0))
        assigned = cut(pairing.distribute_prey(quarry.where(~F.col("is_dead")), hunters, ratio, sim.seed, sim.step_no))
        gone = assigned.select(F.col("prey").alias("id"), F.lit(True).alias("eaten"))
        gains = cut(pairing.consume(assigned, quarry, usability).select(F.col("pred").alias("id"), "gain"))
        sim.populations[prey] = quarry.join(gone, "id", "left").withColumn("is_dead", F.col("is_dead") | F.coalesce("eaten", F.lit(False))).drop("eaten")
        return agents.join(gains, "id", "left").withColumn("mass", F.col("mass") + F.coalesce("gain", F.lit(0.0))).drop("gain")

    return Action("PDHunting", act, priority=priority)


def hunting(prey: str, efficiency: float, usability: float, priority: int = 0) -> Action:
    """The prey's deaths go into its population before its next action; the hunter gains mass."""

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        quarry = sim.populations[prey]
        caught = cut(pairing.hunt(agents.where(~F.col("is_dead")), quarry.where(~F.col("is_dead")), efficiency, usability, sim.seed, sim.step_no))
        gone = caught.select(F.col("prey").alias("id"), F.lit(True).alias("eaten"))
        sim.populations[prey] = quarry.join(gone, "id", "left").withColumn("is_dead", F.col("is_dead") | F.coalesce("eaten", F.lit(False))).drop("eaten")
        gains = caught.select(F.col("pred").alias("id"), "gain")
        return agents.join(gains, "id", "left").withColumn("mass", F.col("mass") + F.coalesce("gain", F.lit(0.0))).drop("gain")

    return Action("Hunting", act, priority=priority)


def mass_manager(delta: float, low: float, high: float, priority: int = 0, feeds_babies: bool = False) -> Action:
    """``feeds_babies``: a newborn gets 0.8 to 1.25 of the least mass, which its mother loses."""
    baby = lambda sim, step: (F.lit(0.8) + u(sim.seed, step, "babymass", F.col("id")) * 0.45) * low

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        if feeds_babies:
            agents = agents.withColumn("mass", F.col("mass") - F.col("n_births") * baby(sim, sim.step_no))
        out = rates.manage_mass(agents.withColumnRenamed("is_dead", "was_dead"), delta, low, high)
        return out.withColumn("is_dead", F.col("was_dead") | F.coalesce("is_dead", F.lit(False))).drop("was_dead")

    inherit = (lambda sim, born: born.withColumn("baby_mass", baby(sim, sim.step_no - 1))) if feeds_babies else None
    return Action("MassManager", act, priority=priority, inherit=inherit)


def birther(birth_mass: float, width: float, priority: int = 0) -> Action:
    """A heavy body gives birth; the baby's mass is taken from it."""

    def act(sim: Simulation, agents: DataFrame, _: object) -> DataFrame:
        out = rates.birther(agents.drop("baby_mass"), birth_mass, width, sim.seed, sim.step_no)
        gives = F.col("is_birth") & ~F.col("is_dead")
        return out.withColumn("n_births", F.col("n_births") + gives.cast("int")).drop("is_birth", *(() if "baby_mass" in agents.columns else ("baby_mass",)))

    def inherit(sim: Simulation, born: DataFrame) -> DataFrame:
        mass = rates.spread(u(sim.seed, sim.step_no - 1, "baby", F.col("id")), width) * birth_mass
        return born.withColumn("baby_mass_own", mass).withColumnRenamed("baby_mass", "mother_baby_mass").withColumnRenamed("baby_mass_own", "baby_mass")

    return Action("Birther", act, priority=priority, inherit=inherit)
