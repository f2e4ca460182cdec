"""All states of a small model at once: masses, marginals under every set of pins, likeliest configurations.

A model of K features (``MOST`` at most) has 2^K states.  A partial assignment has three digits a feature, in base 3:
0 absent, 1 present, 2 free.  The mass of an assignment is the sum of the states it allows; a transform finds all 3^K of them in
K rounds, each of which adds every row to itself and to the one with its digit set free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features whose states are enumerated: 3^12 assignments.
MOST = 12


def energies(fields: DataFrame, couplings: DataFrame) -> tuple[list[str], DataFrame]:
    """Features in order, and (state, energy): minus the sum of fields and couplings of the features present; bit k is feature k.

    ``fields`` (feature, h), at most ``MOST`` rows; couplings of other features are left out.
    """
    spark = fields.sparkSession
    h = {r.feature: float(r.h) for r in fields.select("feature", "h").limit(MOST + 1).collect()}
    if len(h) > MOST:
        raise ValueError(f"more than {MOST} features")
    names = sorted(h)
    at = {f: k for k, f in enumerate(names)}
    known = fields.select("feature")
    inner = couplings.join(F.broadcast(known.toDF("i")), "i", "left_semi").join(F.broadcast(known.toDF("j")), "j", "left_semi")
    bit = lambda k: F.shiftright("state", k).bitwiseAND(F.lit(1))
    terms = [bit(k) * F.lit(h[f]) for f, k in at.items()]
    terms += [bit(at[r.i]) * bit(at[r.j]) * F.lit(float(r.coupling)) for r in inner.select("i", "j", "coupling").collect()]  # pairs of at most MOST features
    return names, spark.range(1 << len(names)).withColumnRenamed("id", "state").withColumn("energy", -sum(terms, F.lit(0.0)))


def probabilities(states: DataFrame) -> DataFrame:
    """(state, energy, p)."""
    z = states.agg(F.sum(F.exp(-F.col("energy"))).alias("z_"))
    return states.crossJoin(F.broadcast(z)).select("state", "energy", (F.exp(-F.col("energy")) / F.col("z_")).alias("p"))


def assignment_masses(known: DataFrame, k: int) -> DataFrame:
    """(code, mass) of all 3^k partial assignments of (state, p)."""
    digits = sum((F.shiftright("state", b).bitwiseAND(F.lit(1)) * F.lit(3**b) for b in range(k)), F.lit(0))
    rows = known.select(digits.cast("long").alias("code"), F.col("p").alias("mass"))
    for b in range(k):
        digit = F.floor(F.col("code") / 3**b).cast("long") % 3
        free = F.col("code") + (2 - digit) * 3**b
        rows = rows.select(F.explode(F.array("code", free)).alias("code"), "mass").groupBy("code").agg(F.sum("mass").alias("mass"))
    return rows


def digit(code, b: int):
    """Digit ``b`` of an assignment."""
    return F.floor(code / 3**b).cast("long") % 3


def pins(k: int):
    """An assignment in letters, one a feature: 0, 1, or a dot where it is free."""
    return F.concat(*[F.when(digit(F.col("code"), b) == 2, ".").otherwise(digit(F.col("code"), b).cast("string")) for b in range(k)])


def conditional_marginals(known: DataFrame, names: list[str]) -> DataFrame:
    """(pins, feature, marginal): of every free feature, under every set of pins.  Pins that no state allows have no rows."""
    k = len(names)
    masses = assignment_masses(known, k)
    free = F.filter(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(3**b).alias("step"), digit(F.col("code"), b).alias("digit")) for b, f in enumerate(names)]), lambda x: x["digit"] == 2)
    asked = masses.where("mass > 0").select("code", "mass", pins(k).alias("pins"), F.explode(free).alias("f"))
    asked = asked.select("pins", "mass", F.col("f.feature").alias("feature"), (F.col("code") - F.col("f.step")).alias("code"))
    return asked.join(masses.withColumnRenamed("mass", "with_"), "code").select("pins", "feature", (F.col("with_") / F.col("mass")).alias("marginal"))


def top_configurations(known: DataFrame, names: list[str], top: int, pinned: dict[str, int] | None = None) -> DataFrame:
    """(rank, state, members, energy, p): the lowest energies among the states that agree with the pins, ties to the smaller state."""
    for f, value in (pinned or {}).items():
        known = known.where(F.shiftright("state", names.index(f)).bitwiseAND(F.lit(1)) == value)
    first = known.orderBy(F.round("energy", 12), "state").limit(top)
    packed = first.agg(F.sort_array(F.collect_list(F.struct(F.round("energy", 12).alias("e"), "state", "energy", "p"))).alias("all_"))  # ``top`` rows
    rows = packed.select(F.posexplode("all_").alias("k", "s"))
    present = F.array(*[F.when(F.shiftright("s.state", b).bitwiseAND(F.lit(1)) == 1, f) for b, f in enumerate(names)]) if names else F.array().cast("array<string>")
    return rows.select((F.col("k") + 1).alias("rank"), F.col("s.state").alias("state"), F.array_join(present, "-").alias("members"), F.col("s.energy").alias("energy"), F.col("s.p").alias("p"))


def observed_states(members: DataFrame, teams: DataFrame, names: list[str]) -> DataFrame:
    """(state, n): how many of ``teams`` hold exactly these of the features; teams with none of them are state 0."""
    at = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(1 << k).cast("long"))])
    bits = members.select("team_id", F.try_element_at(at, F.col("feature")).alias("b")).where("b IS NOT NULL").groupBy("team_id").agg(F.bit_or("b").alias("state"))
    return teams.select("team_id").join(bits, "team_id", "left").groupBy(F.coalesce("state", F.lit(0)).cast("long").alias("state")).agg(F.count("*").alias("n"))
