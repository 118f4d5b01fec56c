"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Targets fill up by weight: a source whose share is over ``cap`` times its size is held there and
the excess is shared again by weight, until none is above. Every document of a source then has
the same expected number of copies; its whole part is taken, and the fraction is rounded by the
pivotal method: two documents meet, mass moves at random from one to the other until one is
integral, and the other goes on. Documents meet in the order of their sizes, so a transfer barely
changes the number of words.

The meetings form a reduction tree. Rows that agree in key, source and size are one element with a
number of rows: whole rows of their common mass are settled at once and what is left is rounded.
A block holds the elements of one source and size class (sizes within a tenth), salted into so many
blocks that a class of all the source's elements would have ``FAN_IN`` to a block; it settles all
its elements but one, and these residuals meet in ever fewer blocks, at last in one per source.
Long documents are rounded first (over the source's mean size, then over half of it); what they
take over or under their share is made up for in the shares of the shorter ones, so the words of
small sources come near their target too. So a source or a key with any share of the rows is spread
over all tasks, and only residuals travel further. The random numbers are hashes of the elements
that meet: reruns agree, whatever the partitions.

Defined results: a null text has size 0; a document of size 0 takes 0; with no words at all every
target is 0; the null source is a source of its own and comes last; a repeated row is a document
of its own (of equal rows any take the further copies); a null key is passed through; an empty table gives no rows; other columns are not
read. The table of sources is numbered and summed up in ranges, however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut
from cohortspark.llm.repeats import repeated
from cohortspark.operators.ordering import numbered, running_sums

#: Of size classes, in natural logarithms: a tenth.
CLASS_WIDTH = 0.0953
WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 1024
#: Residuals of a source that meet in one block at most.
LAST_BLOCK = 8192
#: Rows of the table of sources up to which it is broadcast (about 100 bytes each); beyond, a shuffled join.
BROADCAST_SOURCES = 100_000


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, source_size, n_docs, n_rows, target`` from elements of ``source, size, n`` (``n`` equal rows)."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"))
    by_name = F.col("source").asc_nulls_last()
    place = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    sources = numbered(sources, [by_name], "place")
    sources = sources.withColumn("w", _wide(weight)).withColumn("most", _wide(F.col("source_size")) * cap).drop("place")
    # Fill level at which a source reaches its cap; sources below the water line are the first ones.
    sources = cut(running_sums(sources, [F.col("most") / F.col("w"), by_name], {"most": "most_upto", "w": "w_upto"}))
    zero = F.lit(0).cast("decimal(38,0)")
    whole = sources.agg(F.coalesce(F.sum(_wide(F.col("source_size"))), zero).alias("total"), F.coalesce(F.sum("w"), zero).alias("w")).first()
    before, rest = F.col("most_upto") - F.col("most"), F.lit(whole.w) - F.col("w_upto") + F.col("w")
    sources = sources.withColumn("held", F.col("most") * _wide(rest) <= (F.lit(whole.total) - _wide(before)) * F.col("w"))
    sums = sources.agg(F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))), zero).alias("fixed"), F.coalesce(F.sum(F.when(~F.col("held"), F.col("w"))), zero).alias("free")).first()
    share = F.lit(float(whole.total - sums.fixed)) * F.col("w").cast("double") / F.lit(float(sums.free or 1))
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(share)
    return sources.select("source", "source_size", "n_docs", "n_rows", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _meet(state: Column, e: Column, level: int, seed: int, kind: str) -> Column:
    """One step: the residual so far and the next document exchange mass."""
    a = state["carry"]
    pa, pb = a["p"], e["p"]
    total = pa + pb
    u = _uniform(a["h"], e["h"], F.lit(level), F.lit(seed))
    low = total <= 1
    # The first keeps the mass (or is filled) with the probability that leaves expectations as they are.
    first = F.when(low, u * total < pa).otherwise(u * (F.lit(2.0) - total) < F.lit(1.0) - pb)
    settled = F.when(low, F.lit(0.0)).otherwise(F.lit(1.0))
    left = F.when(low, total).otherwise(total - 1)
    stays = F.when(low, first).otherwise(~first)  # does the first go on with what is left?
    tiny = 1e-9
    over = (left < tiny) | (left > 1 - tiny)
    first_p = F.when(stays, left).otherwise(settled)
    next_p = F.when(stays, settled).otherwise(left)

    def row(x: Column, p: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("k", "h", "id", "copies", "n", "more")), p.alias("p"))

    first_row, next_row = row(a, first_p), row(e, next_p)
    settled_row = F.when(stays, next_row).otherwise(first_row)
    going = F.when(over, F.lit(None)).when(stays, first_row).otherwise(next_row)
    done = F.when(over, F.concat(state["out"], F.array(first_row, next_row))).otherwise(F.concat(state["out"], F.array(settled_row)))
    return F.when(
        a.isNull(), F.struct(e.cast(kind).alias("carry"), state["out"].alias("out"))
    ).otherwise(F.struct(going.cast(kind).alias("carry"), done.alias("out")))


def _step(level: int, seed: int, kind: str):
    return lambda state, e: _meet(state, e, level, seed, kind)


def pivotal_round(rows: DataFrame, most: int, classes: int, seed: int = 7, fan_in: int = FAN_IN, last_block: int = LAST_BLOCK) -> DataFrame:
    """Elements of ``group, n_docs, size, id, copies, n, more, p`` with 0 < p < 1, rounded: ``group, id, size, copies, n, more``.

    ``more`` grows by one where ``p`` becomes 1. ``most`` bounds ``n_docs``, ``classes`` the size classes of a group.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    kind = f"struct<k:bigint,h:bigint,id:{id_type},copies:bigint,n:bigint,more:bigint,p:double>"
    splits, left = [], most
    while left > last_block:
        splits.append(fan_in ** (len(splits) + 1))
        left = classes * -(-most // splits[-1]) if splits[-1] < most else classes
        if splits[-1] >= most:
            break
    now = rows.select(
        "group",
        "n_docs",
        F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(CLASS_WIDTH)).alias("klass"),
        F.struct((-F.col("size")).alias("k"), F.xxhash64("id", "size", F.lit(seed)).alias("h"), "id", *(F.col(c).cast("bigint").alias(c) for c in ("copies", "n", "more")), "p").cast(kind).alias("e"),
    )
    settled = []
    for level, split in enumerate([*splits, None]):
        last = split is None
        if last:
            keys = ["group"]
        else:
            blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(split)))).cast("bigint")
            now = now.withColumn("salt", F.pmod(F.xxhash64(F.col("e.h"), F.lit(level)), blocks))
            keys = ["group", "klass", "salt"]
        grouped = now.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), F.sort_array(F.collect_list("e")).alias("es"))
        state = F.aggregate(
            "es",
            F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("out")),
            _step(level, seed, kind),
        )
        grouped = cut(grouped.select("group", "n_docs", *([] if last else ["klass"]), state.alias("state")))
        settled.append(grouped.select("group", F.explode("state.out").alias("e")))
        residuals = grouped.where("state.carry is not null").select("group", "n_docs", *([] if last else ["klass"]), F.col("state.carry").alias("e"))
        if last:
            lucky = (_uniform(F.col("e.h"), F.lit(-1), F.lit(seed)) < F.col("e.p")).cast("double")
            settled.append(residuals.select("group", F.col("e").withField("p", lucky).alias("e")))
        now = residuals
    out = settled[0]
    for further in settled[1:]:
        out = out.unionByName(further)
    return out.select(
        "group", F.col("e.id").alias("id"), (-F.col("e.k")).alias("size"), F.col("e.copies").alias("copies"), F.col("e.n").alias("n"),
        (F.col("e.more") + F.round("e.p").cast("bigint")).alias("more"),
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``key, size, source_size, target, taken`` and ``source, copies`` of every document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    sizes = cut(sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    sources = cut(source_targets(sizes, weights, cap))
    bounds = sources.agg(F.count("*").alias("sources"), F.max("n_docs").alias("docs")).first()
    longest = sizes.agg(F.max("size").alias("size"), F.max("n").alias("n")).first()
    if longest.n is None:
        nothing = sizes.join(sources.drop("source"), F.lit(False))
        zero = F.lit(0).cast("bigint")
        return nothing.select(F.col("id").alias(key), "size", "source_size", "target", zero.alias("taken"), "source", zero.alias("copies"))
    classes = 2 + int(math.log(max(1, longest.size)) / CLASS_WIDTH)
    small = bounds.sources <= BROADCAST_SOURCES
    right = sources.withColumnRenamed("source", "group")
    both = sizes.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("group")))
    mean = F.col("source_size") / F.col("n_rows")
    tier = F.when(F.col("size") > mean, 0).when(F.col("size") * 2 > mean, 1).otherwise(2)
    share = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.select("group", "n_docs", "id", "size", "n", share.alias("share"), tier.alias("tier"))
    # What long documents take over or under their share, shorter ones make up for.
    words = F.col("size") * F.col("n")
    weight = both.groupBy("group").agg(*(F.sum(F.when(F.col("tier") >= t, words).otherwise(F.lit(0))).alias(f"w{t}") for t in range(3)))
    weight = cut(weight.select(F.col("group").alias("g"), "w0", "w1", "w2", F.lit(0.0).alias("over")))
    outs = []
    for t in range(3):
        rows = both.where(F.col("tier") == t).join(F.broadcast(weight) if small else weight, F.col("group").eqNullSafe(F.col("g")))
        moved = F.col("share") - F.when(F.col(f"w{t}") > 0, F.col("over") / F.col(f"w{t}")).otherwise(F.lit(0.0))
        moved = F.least(F.greatest(F.when(F.col("size") > 0, moved).otherwise(F.lit(0.0)), F.lit(0.0)), F.lit(float(cap)))
        rows = rows.withColumn("moved", moved)
        whole = F.floor(F.col("moved") + 1e-12)
        mass = F.greatest(F.col("moved") - whole, F.lit(0.0)) * F.col("n")
        rows = rows.select("group", "n_docs", "id", "size", "n", whole.cast("bigint").alias("copies"), mass.alias("mass"))
        more = F.least(F.floor(F.col("mass") + 1e-9), F.col("n"))
        rows = rows.select("group", "n_docs", "id", "size", "n", "copies", more.cast("bigint").alias("more"), F.greatest(F.col("mass") - more, F.lit(0.0)).alias("p"))
        rounded = pivotal_round(rows.where("p >= 1e-9"), bounds.docs, classes, seed + t)
        outs.append(rows.where("p < 1e-9").select("group", "id", "size", "copies", "n", "more").unionByName(rounded))
        if t < 2:
            took = outs[-1].groupBy("group").agg(F.sum((F.col("copies") * F.col("n") + F.col("more")) * F.col("size")).alias("took"))
            due = F.col(f"w{t}") - F.col(f"w{t + 1}")
            plan = F.coalesce(F.col("took"), F.lit(0)) - due * F.col("ratio")
            ratio = right.select(F.col("group").alias("r"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"))
            weight = weight.join(took, F.col("g").eqNullSafe(F.col("group")), "left").join(ratio, F.col("g").eqNullSafe(F.col("r")))
            weight = cut(weight.select("g", "w0", "w1", "w2", (F.col("over") + plan).alias("over")))
    out = repeated(outs[0].unionByName(outs[1]).unionByName(outs[2]), "n", longest.n, ["id", "size"])
    right = right.withColumnRenamed("group", "source")
    out = out.join(F.broadcast(right) if small else right, F.col("group").eqNullSafe(F.col("source")))
    copies = F.col("copies") + (F.col("nth") <= F.col("more")).cast("bigint")
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.col("source"), copies.alias("copies"))
