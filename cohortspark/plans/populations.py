"""The population classes: named sets of actions, built from a definition's parameters.

A class says which actions there are; their order comes from the definition's priorities (without
them, from ``ORDER``). Parameters have the names of the definition files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortspark.plans import simulate as s
from cohortspark.sources.config import Population

#: The actions of every class.
CLASSES: dict[str, tuple[str, ...]] = {
    "Breeder1Pop": ("MultiEvaluator", "WeightedMove", "ConfinedMove", "Verhulst", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics"),
    "DirTestPop": ("DirMove", "Verhulst", "RandomPair", "GetOld"),
    "ExamplePop": ("RandomMove", "GetOld"),
    "FK1DPop": ("RandomMove1D", "Verhulst", "GetOld"),
    "FKPop": ("RandomMove", "Verhulst", "GetOld"),
    "FlatExpPop": ("MultiEvaluator", "WeightedMove", "Verhulst", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics"),
    "MiniOoAPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity"),
    "OoAConfGen1BPop": ("MultiEvaluator", "WeightedMove", "ConfinedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoAConfGen2BPop": ("MultiEvaluator", "WeightedMove", "ConfinedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavGen2bitAssHamPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "AssPairHam", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavGen2bitAssPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "AssPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavGen2bitPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavGen2bitRandDistrPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandDistrPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavGenPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics", "Navigate"),
    "OoANavPhenPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Phenetics", "Navigate"),
    "OoANavPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Navigate"),
    "OoAPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "RandomPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics"),
    "OoASelPop": ("MultiEvaluator", "WeightedMove", "VerhulstVarK", "SelPair", "GetOld", "OldAgeDeath", "Fertility", "NPPCapacity", "Genetics"),
    "PDAltPredPop": ("IndexCollector", "WeightedMoveRand", "MultiEvaluator", "MassManager", "Birther", "PDHunting"),
    "PDAltPreyPop": ("IndexCollector", "Verhulst", "SingleEvaluator", "WeightedMove", "MassManager"),
    "PDPredPop": ("IndexCollector", "WeightedMoveRand", "ShareEvaluator", "MassManager", "Birther", "PDHunting"),
    "PDPreyPop": ("IndexCollector", "Verhulst", "RandomMove", "MassManager"),
    "SimplePredPop": ("WeightedMoveRand", "ShareEvaluator", "MassManager", "Birther", "Hunting"),
    "SimplePreyPop": ("Verhulst", "RandomMove", "MassManager"),
    "Stress1Pop": ("Verhulst",),
    "Stress2Pop": ("RandomMove", "Verhulst"),
}

#: Actions in the order in which they act where a definition has no priorities.
ORDER = (
    "NPPCapacity", "GetOld", "Fertility", "IndexCollector", "RandomPair", "SelPair", "AssPair", "AssPairHam", "RandDistrPair", "SingleEvaluator",
    "MultiEvaluator", "ShareEvaluator", "Verhulst", "VerhulstVarK", "OldAgeDeath", "Hunting", "PDHunting", "MassManager", "Birther", "RandomMove",
    "RandomMove1D", "DirMove", "WeightedMove", "WeightedMoveRand", "ConfinedMove", "Navigate", "Genetics", "Phenetics",
)
#: Classes whose females need a mate to give birth are those that have one of these.
_PAIRING = ("RandomPair", "SelPair", "AssPair", "AssPairHam", "RandDistrPair")
_FLAT = [(-1e9, 1.0), (1e9, 1.0)]


def _number(p: Population, name: str, default: float) -> float:
    return float(p.params.get(name, default))


def _curve(p: Population, name: str) -> list[tuple[float, float]]:
    return p.polyline(name) if name in p.params else _FLAT


def make_action(name: str, p: Population, own: tuple[str, ...], prey: str | None, allowed: DataFrame | None, priority: int) -> s.Action:
    """One action of a class with the definition's parameters."""
    n = lambda key, default: _number(p, key, default)
    paired = any(x in own for x in _PAIRING)
    loci = int(n("Genetics_genome_size", 96))
    growth = (n("Verhulst_b0", 0.2), n("Verhulst_d0", 0.01), n("Verhulst_theta", 0.05))
    capacity = {
        "k_min": n("NPPCap_K_min", 5.0), "k_max": n("NPPCap_max_capacity", 60.0), "npp_min": n("NPPCap_NPP_min", 100.0), "npp_max": n("NPPCap_NPP_max", 1400.0),
        "coast": 1.0 + n("NPPCap_coastal_factor", 0.3), "water": n("NPPCap_water_factor", 0.5),
    }
    shared = "shared" if "ShareEvaluator" in own else "own"
    if name in ("PDHunting", "Hunting", "ShareEvaluator") and prey is None:
        raise ValueError(f"{name} needs a population of prey")
    if name == "ConfinedMove" and allowed is None:
        raise ValueError("ConfinedMove needs the allowed cells")
    makers = {
        "Verhulst": lambda: s.verhulst(*growth, n("Verhulst_K", 70.0), priority, paired),
        "VerhulstVarK": lambda: s.verhulst_var_k(*growth, priority, paired, **capacity),
        "NPPCapacity": lambda: s.npp_capacity(priority, **capacity),
        "GetOld": lambda: s.get_old(priority),
        "OldAgeDeath": lambda: s.old_age_death(n("OAD_max_age", 60.0), n("OAD_uncertainty", 0.1), priority),
        "Fertility": lambda: s.fertility(n("Fertility_min_age", 15.0), n("Fertility_max_age", 50.0), n("Fertility_interbirth", 2.0), priority),
        "RandomMove": lambda: s.random_move(n("RandomMove_prob", 0.3), p.params.get("RandomMove_absorbing") == "1", priority),
        "RandomMove1D": lambda: s.random_move_1d(n("RandomMove_prob", 0.3), priority),
        "DirMove": lambda: s.directed_move(n("DirMove_min_age", 5.0), priority),
        "MultiEvaluator": lambda: s.multi_evaluator([("altitude", _curve(p, "AltCapPref"), n("AltWeight", 0.2)), ("npp", _curve(p, "NPPPref"), n("NPPWeight", 0.8))], p.params.get("Multi_mode", "add_block"), priority),
        "SingleEvaluator": lambda: s.multi_evaluator([("altitude", _curve(p, "AltCapPref"), 1.0)], "add", priority, "SingleEvaluator"),
        "ShareEvaluator": lambda: s.share_evaluator(prey, p.polyline("SharePref") if "SharePref" in p.params else [(0.0, 0.0), (50.0, 1.0)], priority),
        "WeightedMove": lambda: s.weighted_move(n("WeightedMoveProb", 0.2), False, shared, priority),
        "WeightedMoveRand": lambda: s.weighted_move(n("WeightedMoveProb", 0.2), True, shared, priority),
        "ConfinedMove": lambda: s.confined_move(allowed, priority),
        "Navigate": lambda: s.navigate(n("NavigateProb0", 0.1), n("NavigateDist0", 150.0), n("NavigateDecay", -0.001), priority),
        "RandomPair": lambda: s.random_pair(priority),
        "SelPair": lambda: s.selective_pair(p.polyline("SelPair_pref") if "SelPair_pref" in p.params else [(0.0, 1.0), (2.0 * loci, 0.1)], priority),
        "AssPair": lambda: s.assortative_pair(n("AssPair_min", 0.0), loci, True, priority),
        "AssPairHam": lambda: s.assortative_pair(n("AssPair_min", 0.0), loci, False, priority),
        "RandDistrPair": lambda: s.random_distance_pair(n("RandDistr_dcrit", 2.0 * loci), n("RandDistr_vcrit", 0.1), n("RandDistr_slope", 0.5 / loci), priority),
        "Genetics": lambda: s.inherit_genes(loci * int(n("Genetics_bits_per_nuc", 1)) // 32, loci * int(n("Genetics_bits_per_nuc", 1)), int(n("Genetics_num_crossover", -1)), n("Genetics_mutation_rate", 2e-6), priority),
        "Phenetics": lambda: s.inherit_phenes(n("Phenetics_mutation_sigma", 0.1), priority),
        "MassManager": lambda: s.mass_manager(n("MM_delta", -0.2), n("MM_mass_min", 0.5), n("MM_mass_max", 12.0), priority, "Verhulst" in own),
        "Birther": lambda: s.birther(n("Birther_birth_mass", 4.0), n("Birther_uncertainty", 0.2), priority),
        "Hunting": lambda: s.hunting(prey, n("Hunting_efficiency", 0.7), n("Hunting_usability", 0.3), priority),
        "PDHunting": lambda: s.distributed_hunting(prey, n("Hunting_efficiency", 0.4), n("Hunting_usability", 0.3), priority),
        "IndexCollector": lambda: s.index_collector(priority),
    }
    return makers[name]()


def add_class(sim: s.Simulation, population: str, definition: Population, prey: str | None = None, allowed: DataFrame | None = None) -> None:
    """Adds the actions of the definition's class to a population, by its priorities."""
    own = CLASSES[definition.class_name]
    known = {"RandomPair": ("RandomPair", "RandPair"), "MultiEvaluator": ("MultiEvaluator", "MultiEval")}
    for name in own:
        given = [definition.priorities[x] for x in known.get(name, (name,)) if x in definition.priorities]
        if definition.priorities and not given and name not in ("Genetics", "Phenetics", "IndexCollector"):
            continue  # a definition's list of priorities says what is done
        sim.add_action(population, make_action(name, definition, own, prey, allowed, given[0] if given else ORDER.index(name) + 1))
