"""Completing and changing teams under a pair model: swaps, greedy descent, mean field, greedy fill.

The model (a vocabulary and its square, at most ``max_features``) goes to every task once; teams are rows with their
members, and each row is worked on where it is.  So nothing is shuffled but the members' way into their team's row.
Teams alike are worked on once.  A task takes its teams in batches: one array operation serves all teams, members and candidates of a batch, whose
size is held so that (teams x members x vocabulary) stays below ``_CELLS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineupkit.runtime import local_table, stash

_CELLS = 1 << 20
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


@dataclass
class Model:
    """A vocabulary in order with fields, couplings (symmetric, no diagonal) and marginals; species and item by number (-1: none)."""

    names: list[str]
    h: np.ndarray
    j: np.ndarray
    m: np.ndarray
    species: np.ndarray
    item: np.ndarray

    def clash(self, held: np.ndarray) -> np.ndarray:
        """Features that share a species or an item with one of the held."""
        out = np.isin(self.species, self.species[held])
        items = self.item[held]
        return out | ((self.item >= 0) & np.isin(self.item, items[items >= 0]))

    # Teams of a batch are rows of ids in ascending order, filled up with -1.

    def held(self, teams: np.ndarray) -> np.ndarray:
        """Which features each team holds."""
        out = np.zeros((len(teams), len(self.names)), bool)
        rows, slots = np.nonzero(teams >= 0)
        out[rows, teams[rows, slots]] = True
        return out

    def sharing(self, teams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each team and feature, how many members share its species, and how many its item."""
        rows, slots = np.nonzero(teams >= 0)
        ids, out = teams[rows, slots], []
        for code in (self.species, self.item):
            counts = np.zeros((len(teams), int(code.max(initial=0)) + 1), int)
            known = code[ids] >= 0
            np.add.at(counts, (rows[known], code[ids[known]]), 1)
            out.append(np.where(code >= 0, counts[:, code], 0))
        return out[0], out[1]

    def swaps(self, teams: np.ndarray, pinned: np.ndarray, excluded: np.ndarray, field_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(delta_adj, rise of h, gain of coherence) by team, slot that leaves and feature that comes; infinite where not legal.

        ``pinned`` are masks of features by team, ``excluded`` is one mask for all.
        """
        if not self.names:
            none = np.zeros((*teams.shape, 0))
            return none, none, none
        member = teams >= 0
        at = np.where(member, teams, 0)
        ties = self.j[at]
        pull = (ties * member[:, :, None]).sum(1)
        gain = pull[:, None, :] - ties - np.take_along_axis(pull, at, 1)[:, :, None]
        rise = self.h - self.h[at][:, :, None]
        by_species, by_item = self.sharing(teams)
        crowded = by_species[:, None, :] > (self.species[at][:, :, None] == self.species)
        crowded |= by_item[:, None, :] > (self.item[at][:, :, None] == self.item)
        leaves = member & ~np.take_along_axis(pinned, at, 1)
        legal = leaves[:, :, None] & ~crowded & ~(self.held(teams) | excluded)[:, None, :]
        return np.where(legal, -field_weight * rise - gain, np.inf), rise, gain

    def descend(self, teams: np.ndarray, pinned: np.ndarray, field_weight: float, most: int) -> tuple[np.ndarray, list[tuple]]:
        """Best swaps while the energy falls: teams at the end, and (teams' rows, step, out, in, delta) of each step."""
        teams, live, chain, v = teams.copy(), np.arange(len(teams)), [], len(self.names)
        for step in range(1, most + 1):
            if not len(live) or not v:
                break
            adj = self.swaps(teams[live], pinned[live], np.zeros(v, bool), field_weight)[0].reshape(len(live), -1)
            best = np.round(adj, 9).argmin(1)  # the first of equals has the least names
            delta = adj[np.arange(len(live)), best]
            falls = delta < -1e-12
            live, best, delta = live[falls], best[falls], delta[falls]
            slot, into = np.divmod(best, v)
            chain.append((live, np.full(len(live), step), teams[live, slot], into, delta))
            teams[live, slot] = into
            teams[live] = _in_order(teams[live], v)
        return teams, chain

    def mean_field(self, pins: np.ndarray, rounds: int, tol: float, damping: float, field_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Damped fixed points with pins at 1 and what they rule out at 0: (marginals, rounds taken) by team."""
        held, (by_species, by_item) = self.held(pins), self.sharing(pins)
        free = ~held & (by_species == 0) & (by_item == 0)
        h = field_weight * self.h
        sigma = lambda z: 0.5 * (1 + np.tanh(z / 2))
        m = np.where(free, sigma(h), held)
        taken, live = np.full(len(pins), rounds), np.arange(len(pins))
        for k in range(1, rounds + 1):
            if not len(live):
                break
            old, open_ = m[live], free[live]
            new = np.where(open_, sigma(h + old @ self.j), old)
            m[live] = damping * new + (1 - damping) * old
            done = np.where(open_, np.abs(new - old), 0).max(1, initial=0) < tol
            taken[live[done]] = k
            live = live[~done]
        return m, taken


def _in_order(teams: np.ndarray, v: int) -> np.ndarray:
    """Rows of ids ascending, with what is -1 at the end."""
    key = np.sort(np.where(teams < 0, v, teams), 1)
    return np.where(key == v, -1, key)


def available(pins: DataFrame, vocab: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(team_id, free): the vocabulary without each row's ``pinned`` array and the excluded features, in order."""
    all_ = vocab.agg(F.sort_array(F.collect_set("feature")).alias("all_"))  # a vocabulary is a short list
    barred = F.concat("pinned", F.array(*map(F.lit, excluded or [])).cast("array<string>"))
    return pins.crossJoin(F.broadcast(all_)).select("team_id", F.array_except("all_", barred).alias("free"))


def local_model(fields: DataFrame, couplings: DataFrame, features: DataFrame | None = None, max_features: int = 4_000) -> Model:
    """The model on the driver, ready to be sent to tasks; ``features`` (feature, species, item), else each its own species."""
    rows = fields.select("feature", "h", *(["m"] if "m" in fields.columns else [])).limit(max_features + 1).collect()
    if len(rows) > max_features:
        raise ValueError(f"more than {max_features} features")
    rows.sort(key=lambda r: r.feature)
    names = [r.feature for r in rows]
    at, v = {f: k for k, f in enumerate(names)}, len(rows)
    j = np.zeros((v, v))
    if rows:
        number = local_table(fields.sparkSession, [(f, k) for k, f in enumerate(names)], "feature string, k long")
        known = couplings.join(F.broadcast(number.toDF("i", "a")), "i").join(F.broadcast(number.toDF("j", "b")), "j")
        found = known.select("a", "b", F.col("coupling").cast("double").alias("c")).toArrow()  # at most a vocabulary squared, as numbers
        a, b, c = (found.column(k).to_numpy() for k in ("a", "b", "c"))
        j[a, b] = j[b, a] = c
    species, item = np.arange(v), np.full(v, -1)
    if features is not None:
        known = {r.feature: r for r in features.collect() if r.feature in at}
        sites = {s: k for k, s in enumerate(sorted({r.species for r in known.values()}))}
        items = {t: k for k, t in enumerate(sorted({r.item for r in known.values() if r.item is not None}))}
        species = np.array([sites[known[f].species] for f in names])
        item = np.array([items.get(known[f].item, -1) for f in names])
    m = np.array([r.m for r in rows]) if rows and "m" in rows[0] else np.zeros(v)
    return Model(names, np.array([r.h for r in rows]), j, m, species, item)


def _padded(index: pd.Index, lists: pa.Array) -> np.ndarray:
    """Known names of every list as ids in ascending order, filled up with -1; a null list has none."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    ids = index.get_indexer(lists.flatten().to_pandas()) if lengths.sum() else np.zeros(0, int)
    rows = np.repeat(np.arange(len(lists)), lengths)[ids >= 0]
    ids = ids[ids >= 0]
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    counts = np.bincount(rows, minlength=len(lists))
    out = np.full((len(lists), max(1, counts.max(initial=0))), -1)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = ids
    return out


def _each(members: DataFrame, model: Model, work, kinds: str, pinned: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """``work(model, teams, pins)`` for batches of teams: it gives the rows of the batch and columns as long; ids stand for names.

    Names the model does not know are left out of a team; a team without any is worked on as an empty one.
    Teams of the same members and pins are worked on once: the distinct sets are numbered, and their rows joined to the teams.
    Work that is not ``dense`` (it meets members, not the vocabulary) costs less than that: every team is worked on where it is.
    """
    named = F.sort_array(F.collect_set("feature"))
    rows = members.groupBy("team_id").agg(named.alias("members"))
    if pinned is not None:
        rows = rows.join(pinned.groupBy("team_id").agg(named.alias("pinned")).hint("merge"), "team_id", "left")
    else:
        rows = rows.withColumn("pinned", F.lit(None).cast("array<string>"))
    rows = rows.select(F.col("team_id").cast("long").alias("team_id"), "members", "pinned")
    if not dense:
        return rows.mapInArrow(_in_batches(model, members, work, kinds, dense), kinds)
    rows = stash(rows, "teams")
    sets = stash(rows.select("members", "pinned").distinct().withColumn("set_id", F.monotonically_increasing_id()), "sets")
    same = rows["members"].eqNullSafe(sets["members"]) & rows["pinned"].eqNullSafe(sets["pinned"])
    teams = rows.join(sets.hint("merge"), same).select("team_id", "set_id")
    # Many sets to a task would wait for one core where the sets are a short file.
    sets = sets.repartition("set_id").select(F.col("set_id").alias("team_id"), "members", "pinned")
    found = sets.mapInArrow(_in_batches(model, members, work, kinds, dense), kinds).withColumnRenamed("team_id", "set_id")
    return teams.join(found.hint("merge"), "set_id").select("team_id", *[c.split(" ")[0] for c in kinds.split(", ")[1:]])


def _in_batches(model: Model, members: DataFrame, work, kinds: str, dense: bool):
    """The task of ``_each``: rows (team_id, members, pinned) in, rows of ``kinds`` out."""
    shared = members.sparkSession.sparkContext.broadcast(model)
    columns = [c.split(" ") for c in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index, names = pd.Index(own.names, dtype=object), pa.array(own.names, pa.string())

        def column(values: np.ndarray, kind: str) -> pa.Array:
            if kind == "string" and values.dtype != object:
                return names.take(pa.array(values, mask=values < 0))
            return pa.array(values, _KINDS[kind], from_pandas=True)

        for batch in batches:
            longest = pc.max(pc.list_value_length(batch.column("members"))).as_py() or 1
            step = max(1, _CELLS // max(1, (len(own.names) if dense else 1) * longest))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                at, *found = work(own, _padded(index, part.column("members")), _padded(index, part.column("pinned")))
                arrays = [part.column("team_id").take(pa.array(at, pa.int64()))]
                arrays += [column(np.asarray(x), kind) for x, (_, kind) in zip(found, columns[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in columns])

    return run


def ranked_swaps(members: DataFrame, model: Model, top: int = 20, field_weight: float = 1.0, pinned: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """The ``top`` legal single swaps of each team: (team_id, out, in, delta_adj, delta_raw, delta_coherence, rank), ties by name.

    The one that leaves may share its species and item with the one that comes; pinned members stay, excluded features stay out.
    """
    barred = np.isin(np.array(model.names, object), list(excluded or []))

    def work(own: Model, teams: np.ndarray, pins: np.ndarray):
        adj, rise, gain = (x.reshape(len(teams), -1) for x in own.swaps(teams, own.held(pins), barred, field_weight))
        near = np.round(adj, 9)
        last = min(top, near.shape[1])
        edge = np.partition(near, last - 1, 1)[:, last - 1 : last] if last else np.zeros((len(near), 1))
        rows, cells = np.nonzero((near <= edge) & np.isfinite(near))
        order = np.lexsort((cells, near[rows, cells], rows))  # cells go by out, then in
        rows, cells = rows[order], cells[order]
        rank = np.arange(1, len(rows) + 1) - np.searchsorted(rows, rows)
        rows, cells, rank = rows[rank <= top], cells[rank <= top], rank[rank <= top]
        slot, into = np.divmod(cells, max(1, len(own.names)))
        a, g = adj[rows, cells], gain[rows, cells]
        return rows, teams[rows, slot], into, a, -rise[rows, cells] - g, g, rank

    return _each(members, model, work, "team_id long, out string, in string, delta_adj double, delta_raw double, delta_coherence double, rank int", pinned)


def resolve_sites(sites: DataFrame, model: Model, pinned: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """A feature for every pinned site: (team_id, feature, problem).

    ``sites`` (team_id, feature) names each site by any feature of it.  In the order of these names, each takes its feature of
    largest marginal (ties by name) that clashes with nothing placed so far; where a site has none, the team has one row with a problem.
    """
    barred = np.isin(np.array(model.names, object), list(excluded or []))

    # The features of each site, best first, filled up with -1.
    codes = np.unique(model.species, return_inverse=True)[1]
    ranked = np.lexsort((np.arange(len(codes)), -np.round(model.m, 12), codes))
    ranked = ranked[~barred[ranked]]
    counts = np.bincount(codes[ranked], minlength=codes.max(initial=-1) + 1)
    best = np.full((len(counts), counts.max(initial=0) + 1), -1)
    best[codes[ranked], np.arange(len(ranked)) - np.repeat(np.cumsum(counts) - counts, counts)] = ranked

    def work(own: Model, wanted: np.ndarray, pins: np.ndarray):
        fine, chosen, placed = np.ones(len(wanted), bool), np.full(wanted.shape, -1), pins
        for slot in range(wanted.shape[1] if own.names else 0):
            live = np.flatnonzero(fine & (wanted[:, slot] >= 0))
            site, taken = codes[wanted[live, slot]], placed[live]
            sites, items = np.where(taken >= 0, codes[taken], -1), np.where(taken >= 0, own.item[taken], -1)
            found, open_ = np.full(len(live), -1), ~(sites == site[:, None]).any(1)
            for k in range(best.shape[1]):
                some = np.flatnonzero(open_)
                if not len(some):
                    break
                f = best[site[some], k]
                item = np.where(f >= 0, own.item[f], -1)
                stands = (f >= 0) & ~((item >= 0)[:, None] & (items[some] == item[:, None])).any(1)
                found[some[stands]] = f[stands]
                open_[some[stands | (f < 0)]] = False
            chosen[live, slot], fine[live] = found, found >= 0
            placed = np.concatenate([placed, chosen[:, slot : slot + 1]], 1)
        rows, slots = np.nonzero((chosen >= 0) & fine[:, None])
        bad = np.flatnonzero(~fine)
        why = np.concatenate([np.full(len(rows), None, object), np.full(len(bad), "no feature can stand on a site", object)])
        return np.concatenate([rows, bad]), np.concatenate([chosen[rows, slots], np.full(len(bad), -1)]), why

    return _each(sites, model, work, "team_id long, feature string, problem string", pinned, dense=False)


def greedy_descent(members: DataFrame, model: Model, max_swaps: int = 20, field_weight: float = 1.0, pinned: DataFrame | None = None) -> DataFrame:
    """The chain of best swaps of each team while the energy falls: (team_id, step, out, in, delta)."""

    def work(own: Model, teams: np.ndarray, pins: np.ndarray):
        _, chain = own.descend(teams, own.held(pins), field_weight, max_swaps)
        none = np.zeros(0, int)
        return tuple(map(np.concatenate, zip((none, none, none, none, np.zeros(0)), *chain, strict=True)))

    return _each(members, model, work, "team_id long, step int, out string, in string, delta double", pinned)


def mean_field(pins: DataFrame, model: Model, rounds: int = 200, tol: float = 1e-5, damping: float = 0.5, top: int | None = None) -> DataFrame:
    """Marginals beside each set of pins: (team_id, feature, m, rounds); of all features, or of each team's ``top`` (ties by name)."""

    def work(own: Model, teams: np.ndarray, _):
        m, taken = own.mean_field(teams, rounds, tol, damping)
        some = np.argsort(-np.round(m, 12), 1, kind="stable")[:, :top] if top is not None else np.broadcast_to(np.arange(m.shape[1]), m.shape)
        rows = np.repeat(np.arange(len(m)), some.shape[1])
        return rows, some.ravel(), m[rows, some.ravel()], taken[rows]

    return _each(pins, model, work, "team_id long, feature string, m double, rounds int")


def mean_field_ranks(problems: DataFrame, model: Model, species: dict[str, str] | None = None, rounds: int = 200, tol: float = 1e-4) -> DataFrame:
    """(team_id, truth, rank): 1 + features not held in whose marginal beside the held ones is greater (nine digits).

    ``problems`` (team_id, feature, held_out).  With ``species`` (of every feature) marginals are summed by species, and the
    truth's species is ranked among those not held in.  Marginals stay in their task; a truth the model does not know has no row.
    """
    sites = np.unique([species[f] for f in model.names], return_inverse=True)[1] if species is not None else None

    def work(own: Model, teams: np.ndarray, truths: np.ndarray):
        m, held = own.mean_field(teams, rounds, tol, 0.5)[0], own.held(teams)
        at = truths
        if sites is not None and len(sites):
            sums = np.eye(sites.max() + 1)[sites]
            m, held, at = m @ sums, held @ sums > 0, np.where(truths >= 0, sites[truths], -1)
        worth = np.round(np.where(held, -np.inf, m), 9)
        rows, slots = np.nonzero(truths >= 0)
        own_worth = np.round(m[rows, at[rows, slots]], 9)
        return rows, truths[rows, slots], 1 + (worth[rows] > own_worth[:, None]).sum(1)

    held_out = F.col("held_out")
    return _each(problems.where(~held_out), model, work, "team_id long, truth string, rank int", problems.where(held_out))


def fast_path(pins: DataFrame, model: Model, size: int = 6, max_swaps: int = 10) -> DataFrame:
    """Mean field, then the legal features of largest marginal, then greedy descent: (team_id, feature, problem).

    ``problem`` names why there is no team: pins that clash, or too few features that may stand beside them.
    """

    def work(own: Model, pins: np.ndarray, _):
        held = own.held(pins)
        by_species, by_item = own.sharing(pins)
        clash = (held.sum(1) > size) | (held & ((by_species > 1) | (by_item > 1))).any(1)
        m = np.round(own.mean_field(pins, 200, 1e-5, 0.5)[0], 12)
        teams = np.full((len(pins), size), -1)
        kept = min(size, pins.shape[1])
        teams[:, :kept] = pins[:, :kept]
        for slot in range(size):
            short = np.flatnonzero((teams[:, slot] < 0) & ~clash)
            if not len(short) or not own.names:
                continue
            a, b = own.sharing(teams[short])
            worth = np.where((a > 0) | (b > 0), -np.inf, m[short])
            best = worth.argmax(1)  # the first of equals has the least name
            teams[short, slot] = np.where(np.isfinite(worth[np.arange(len(short)), best]), best, -1)
        few = (teams < 0).any(1) & ~clash
        fine = np.flatnonzero(~clash & ~few)
        ended, _ = own.descend(_in_order(teams[fine], len(own.names)), held[fine], 1.0, max_swaps)
        bad = np.flatnonzero(clash | few)
        rows = np.concatenate([np.repeat(fine, size), bad])
        features = np.concatenate([ended.ravel(), np.full(len(bad), -1)])
        why = np.full(len(rows), None, object)
        why[len(fine) * size :] = np.where(clash[bad], "pins clash", "too few features")
        return rows, features, why

    return _each(pins, model, work, "team_id long, feature string, problem string")
