"""The step loop: classes, inheritance, stopping and going on, layers, commands, plan sizes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import model as m
from cohortspark.plans import q_classes, simulate
from cohortspark.plans.populations import CLASSES, ORDER, add_class
from cohortspark.sources.config import Population, parse_population

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_every_action_of_every_class_can_be_made(spark):
    assert len(CLASSES) == 26 and {a for own in CLASSES.values() for a in own} <= set(ORDER)
    for name in CLASSES:
        sim = q_classes.simulation(spark, SF, name)
        assert [a.name for a in sorted(sim.actions[name], key=lambda a: a.priority)] == [a for a in ORDER if a in CLASSES[name]]


def test_priorities_of_a_definition(spark):
    text = "CLASS FKPop\nSPECIES 1 x\nSENSING 1\nBEGIN_PARAMS\nVerhulst_K = 9\nPRIO RandomMove 1\nPRIO Verhulst 2\nEND_PARAMS\n"
    sim = simulate.Simulation({}, {}, m.edges(spark, SF), m.env(spark, SF))
    add_class(sim, "a", parse_population(text))
    assert [(a.name, a.priority) for a in sim.actions["a"]] == [("RandomMove", 1), ("Verhulst", 2)]
    with pytest.raises(ValueError):
        add_class(sim, "b", Population(class_name="SimplePredPop"))


def genetic(spark):
    sim = q_classes.simulation(spark, SF, "OoANavGenPop")
    for agents in sim.populations.values():
        sim.populations["OoANavGenPop"] = agents.withColumn("mother", F.lit(None).cast("long")).withColumn("father", F.lit(None).cast("long"))
    return sim


def test_newborns_have_their_parents_genes(spark):
    sim = genetic(spark)
    sim.actions["OoANavGenPop"] = [a for a in sim.actions["OoANavGenPop"] if a.name != "Genetics"]
    sim.add_action("OoANavGenPop", simulate.inherit_genes(3, 96, -1, 0.0, 99))  # no mutations: each bit is a parent's
    before = {r.id: r for r in sim.populations["OoANavGenPop"].collect()}
    sim.run(1)
    after = sim.populations["OoANavGenPop"].collect()
    babies = [r for r in after if r.id not in before]
    assert babies and all(r.age == 0 and r.last_birth == 0 and r.birth_time == 0 for r in babies)
    for r in babies:
        mother, father = before[r.mother], before[r.father]
        for strand, parent in ((r.strand1, mother), (r.strand2, father)):
            for got, x, y in zip(strand, parent.strand1, parent.strand2, strict=True):
                assert got & ~(x | y) == 0 and (x & y) & ~got == 0
    assert {r.id: r.last_birth for r in after if r.id in {b.mother for b in babies}} and all(r.last_birth == 0 for r in after if r.id in {b.mother for b in babies})


def test_stop_and_go_on(spark, tmp_path):
    straight = genetic(spark)
    straight.run(3)
    first = genetic(spark)
    first.run(2)
    first.dump(f"{tmp_path}/state")
    second = genetic(spark)
    second.restore(f"{tmp_path}/state")
    assert second.step_no == 2
    second.run(1)
    assert rows(second.populations["OoANavGenPop"]) == rows(straight.populations["OoANavGenPop"])


def test_layers_are_derived_once_until_they_change(spark):
    sim = q_classes.simulation(spark, SF, "MiniOoAPop")
    asked = []
    capacity = simulate.evaluators.capacity
    simulate.evaluators.capacity = lambda env, **k: asked.append(1) or capacity(env, **k)
    try:
        sim.run(2)
        assert len(asked) == 1  # not once a step
        wet = sim.env.withColumn("altitude", F.when(F.col("cell") % 2 == 0, -5.0).otherwise(F.col("altitude")))
        sim.update_env(wet)
        assert sim.populations["MiniOoAPop"].where("cell % 2 = 0").isEmpty()
        sim.run(1)
        assert len(asked) == 2
    finally:
        simulate.evaluators.capacity = capacity


def test_commands_and_the_end(spark):
    sim = q_classes.simulation(spark, SF, "FKPop")
    sim.events[1] = [lambda s: s.command("SET ITERS 4")]
    sim.events[2] = [lambda s: s.command("REMOVE ACTION FKPop:Verhulst")]
    sim.run(2)
    assert sim.step_no == 4 and [a.name for a in sim.actions["FKPop"]] == ["RandomMove", "GetOld"]
    assert not sim.command("SET ITERS") and not sim.command("REMOVE ACTION FKPop:Verhulst") and not sim.command("DANCE")
    sim.command("SET ITERS 1")
    assert sim.iters == 5
    dying = q_classes.simulation(spark, SF, "Stress1Pop")
    dying.events[1] = [lambda s: s.populations.update(Stress1Pop=s.populations["Stress1Pop"].limit(0))]
    dying.run(9)
    assert dying.step_no == 2  # the step after which nobody was left


def test_plans_do_not_grow(spark):
    sim = q_classes.simulation(spark, SF, "Stress2Pop")
    sizes = []
    for _ in range(3):
        sim.step()
        probe = simulate.Action("Probe", lambda s, a, _: sizes.append(len(a._jdf.queryExecution().optimizedPlan().toString())) or a, priority=99)
        sim.remove_action("Stress2Pop", "Probe")
        sim.add_action("Stress2Pop", probe)
    assert len(sizes) == 2 and abs(sizes[1] - sizes[0]) < 0.05 * sizes[0]


def test_hunters_and_prey(spark):
    sim = q_classes.simulation(spark, SF, "PDPredPop")
    before = {n: p.count() for n, p in sim.populations.items()}
    ids = {r.id for r in sim.populations["PDPreyPop"].select("id").collect()}
    sim.step()
    prey = sim.populations["PDPreyPop"]
    assert prey.select("id").distinct().count() == prey.count() and prey.where("mass is null").isEmpty()
    assert len({r.id for r in prey.collect()} & ids) < len(ids) and before["PDPredPop"] > 0
    again = q_classes.simulation(spark, SF, "PDPredPop")
    again.step()
    assert rows(again.populations["PDPreyPop"]) == rows(prey) and hashlib.md5(repr(rows(again.populations["PDPredPop"])).encode()).digest() == hashlib.md5(repr(rows(sim.populations["PDPredPop"])).encode()).digest()
