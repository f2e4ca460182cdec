"""Registered queries on sweeps, moments and usage reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import completion, corpus, evaluation, scoring, statistics, usage
from lineupkit.plans import corpus_queries as base
from lineupkit.plans import statistics_queries as stats
from lineupkit.runtime import table
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, rosters, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}
# The cells of the weighting sweep, days (none: no recency) and weight of the in-person ones.
CELLS = [(None, 1.0), (365.0, 1.0), (365.0, 3.0), (90.0, 3.0)]
SLICES = 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


@query(
    "a12_usage_rows",
    """SELECT name, round(usage, 9) AS usage, teammates FROM (SELECT feature AS name, m AS usage FROM marg) JOIN (SELECT i AS name, count(*) AS teammates FROM sym GROUP BY i) USING (name)""",
)
def usage_rows(s, d):
    return _usage(s, d).select("name", F.round("usage", 9).alias("usage"), F.size("teammates").cast("long").alias("teammates"))


def _usage(s, d):
    """A usage report made from the corpus: weighted shares, and partners with their counts."""
    members = species_members(s, d)
    met = corpus.mirrored(corpus.cooccurrence(members), "n").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", F.col("n").cast("double")))).alias("teammates"))
    return corpus.marginals(members, base._weights(s, d)).join(met.withColumnRenamed("i", "feature"), "feature").select(F.col("feature").alias("name"), F.col("m").alias("usage"), "teammates")


@query("c6_usage_vocabulary", "SELECT feature AS name, round(m, 9) AS usage FROM marg WHERE m >= (SELECT avg(m) FROM marg)")
def usage_vocabulary(s, d):
    rows = _usage(s, d)
    return usage.usage_vocabulary(rows, rows.agg(F.avg("usage")).first()[0]).withColumn("usage", F.round("usage", 9))


@query("c5_usage_cooccurrence", "SELECT i, j, n::DOUBLE AS weight FROM sym WHERE i < 'Brand#4' AND j < 'Brand#4'")
def usage_cooccurrence(s, d):
    rows = _usage(s, d)
    return usage.usage_cooccurrence(rows, usage.usage_vocabulary(rows).where("name < 'Brand#4'"))


@query("e8_available_features", ", v AS (SELECT list_sort(list(DISTINCT feature)) AS vocabulary FROM mem) SELECT team_id, array_to_string(list_filter(vocabulary, lambda f: f <> roster[1] AND f <> roster[-1] AND f <> 'Brand#11'), ',') AS free FROM ros, v")
def available_features(s, d):
    """First and last member pinned, one brand excluded."""
    members = species_members(s, d)
    pins = rosters(members).select("team_id", F.array(F.get("roster", F.lit(0)), F.element_at("roster", -1)).alias("pinned"))
    return completion.available(pins, members.select("feature"), ["Brand#11"]).select("team_id", F.array_join("free", ",").alias("free"))


_ROLLED = "rolled AS (SELECT x.species AS i, y.species AS j, count(*) AS n FROM pmem x JOIN pmem y ON x.team_id = y.team_id AND x.feature <> y.feature AND x.species <> y.species GROUP BY 1, 2)"


@query("e23_species_greedy", f", {_ROLLED}" + base._greedy_sql(6).replace("JOIN sym ON sym.j", "JOIN rolled ON rolled.j"))
def species_greedy(s, d):
    """Greedy fill on the species matrix that pairs of features roll up to."""
    members = pair_members(s, d)
    rolled = corpus.species_rollup(corpus.cooccurrence(members.select("team_id", "feature")), members.select("feature", "species").distinct())
    return scoring.cooccurrence_greedy(base._held(s, d), rolled, members.select(F.col("species").alias("feature")), 6)


_RECORD = """rec AS (SELECT o_orderkey AS team_id, sum((l_returnflag = 'A')::INT) AS wins, sum((l_returnflag = 'R')::INT) AS losses, sum((l_returnflag = 'N' AND l_linestatus = 'F')::INT) AS ties
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


@query("g14_win_rate", f", {_RECORD} SELECT team_id, round(CASE WHEN wins + losses + ties > 0 THEN wins::DOUBLE / (wins + losses + ties) END, 9) AS win_rate FROM rec")
def win_rate(s, d):
    """Lines returned under one flag as wins, under the other as losses; those of closed lines without a return as ties."""
    lines = table(s, d, "lineitem")
    count = lambda c: F.sum(c.cast("int"))
    rec = lines.groupBy(F.col("l_orderkey").alias("team_id")).agg(
        count(F.col("l_returnflag") == "A").alias("wins"), count(F.col("l_returnflag") == "R").alias("losses"), count((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("ties")
    )
    return rec.select("team_id", F.round(evaluation.win_rate(), 9).alias("win_rate"))


_RANKED = """1 + (SELECT count(*) FROM {counts} x WHERE {same} round(x.n, 9) > round(c.n, 9) AND x.feature NOT IN (SELECT feature FROM prob h WHERE h.team_id = t.team_id AND NOT h.held_out))"""


def _swept(name: str, counts: str, keys: str) -> str:
    same = " ".join(f"x.{k} IS NOT DISTINCT FROM c.{k} AND" for k in keys.split(", "))
    rank = _RANKED.format(counts=counts, same=same)
    return f"{name} AS (SELECT {keys}, t.team_id, {rank} AS rank FROM prob t JOIN {counts} c ON c.feature = t.feature WHERE t.held_out)"


@query(
    "g3_window_sweep",
    f""", {stats._PROBLEMS}, wk AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k, count(*) OVER () AS c FROM tm WHERE train), wd AS (SELECT month, least(k // greatest(c // {SLICES}, 1), {SLICES - 1}) AS win FROM wk),
       lc AS (SELECT l.last, feature, count(*) AS n FROM mem JOIN teams USING (team_id) JOIN wd USING (month) JOIN (SELECT unnest(range(1, {SLICES + 1})) AS last) l ON wd.win >= {SLICES} - l.last GROUP BY 1, 2),
       {_swept("lr", "lc", "last")} SELECT CAST(last AS INTEGER) AS last, {stats._METRICS} FROM lr GROUP BY last""",
)
def window_sweep(s, d):
    """The popularity scorer from the last 1 to 4 quarters of the training time, on one set of problems."""
    problems, _ = stats._problems(s, d)
    rows = teams(s, d).select("team_id", "month").join(stats._train(s, d).where("train"), "team_id")
    windows = statistics.equal_windows(rows.groupBy("month").agg(F.count("*").alias("n")), "month", SLICES)
    spans = statistics.last_slices(windows.select(F.col("month").alias("event"), "window"), SLICES)
    seen = species_members(s, d).join(rows, "team_id").groupBy("month", "feature").agg(F.count("*").alias("n"))
    counts = seen.join(spans.withColumnRenamed("event", "month"), "month").groupBy("last", "feature").agg(F.sum("n").alias("n"))
    return stats._rounded(statistics.swept_metrics(problems, counts, ["last"]), 8, "hit1", "hit5", "hit10", "mrr")


_CELL_SQL = " UNION ALL ".join(
    f"SELECT {k} AS cell, team_id, {'1.0::DOUBLE' if tau is None else f'exp(-date_diff(' + chr(39) + 'day' + chr(39) + f', day, (SELECT max(day) FROM tn)) / {tau}::DOUBLE)'} * CASE WHEN in_person THEN {x}::DOUBLE ELSE 1.0::DOUBLE END AS r FROM tn"
    for k, (tau, x) in enumerate(CELLS)
)


def _cells(s, d):
    """(cell, feature, n): weighted shares of the training teams for every cell of the sweep, all from one pass over members."""
    train = stats._train(s, d).where("train").select("team_id")
    rows = teams(s, d).join(train, "team_id")
    weights = [corpus.team_weights(rows, tau, x).withColumn("cell", F.lit(k)) for k, (tau, x) in enumerate(CELLS)]
    both = weights[0]
    for more in weights[1:]:
        both = both.unionByName(more)
    total = both.groupBy("cell").agg(F.sum("w").alias("all_"))
    sums = species_members(s, d).join(both, "team_id").groupBy("cell", "feature").agg(F.sum("w").alias("s_"))
    return sums.join(F.broadcast(total), "cell").select("cell", "feature", (F.col("s_") / F.col("all_")).alias("n"))


_FLOOR = f""", {stats._PROBLEMS}, tn AS (SELECT teams.* FROM teams JOIN tt USING (team_id) WHERE train), cw AS ({_CELL_SQL}), ca AS (SELECT cell, sum(r) AS s FROM cw GROUP BY cell),
  cm AS (SELECT cell, feature, ln(least(greatest(sum(r) / any_value(s), 1e-9), 1 - 1e-9) / (1 - least(greatest(sum(r) / any_value(s), 1e-9), 1 - 1e-9))) AS n FROM mem JOIN cw USING (team_id) JOIN ca USING (cell) GROUP BY 1, 2),
  {_swept("fr", "cm", "cell")}, fm AS (SELECT cell, {stats._METRICS} FROM fr GROUP BY cell)"""


def _floor(s, d):
    problems, _ = stats._problems(s, d)
    fields = _cells(s, d).withColumn("n", statistics.popularity_field(F.col("n")))
    return stats._rounded(statistics.swept_metrics(problems, fields, ["cell"]), 8, "hit1", "hit5", "hit10", "mrr")


@query("g36_popularity_floor", f"{_FLOOR} SELECT * FROM fm")
def popularity_floor(s, d):
    return _floor(s, d)


@query("g10_best_cell", f"{_FLOOR} SELECT * FROM fm ORDER BY mrr DESC, cell LIMIT 1")
def best_cell(s, d):
    """The cell of the grid with the best mean reciprocal rank."""
    return _floor(s, d).orderBy(F.desc("mrr"), "cell").limit(1)


_TOP = 12


@query(
    "g24_third_moments",
    f""", f AS (SELECT feature, sum(w) / (SELECT sum(w) FROM wts) AS m FROM mem JOIN wts USING (team_id) GROUP BY feature ORDER BY round(sum(w), 9) DESC, feature LIMIT {_TOP}),
       tr AS (SELECT a.feature AS i, b.feature AS j, c.feature AS k, a.m AS mi, b.m AS mj, c.m AS mk FROM f a JOIN f b ON a.feature < b.feature JOIN f c ON b.feature < c.feature),
       x AS (SELECT i, j, k, (list_contains(roster, i)::INT - mi) * (list_contains(roster, j)::INT - mj) * (list_contains(roster, k)::INT - mk) AS p, w / (SELECT sum(w) FROM wts) AS w
         FROM tr CROSS JOIN (SELECT wts.w, coalesce(roster, []) AS roster FROM wts LEFT JOIN ros USING (team_id))),
       y AS (SELECT i, j, k, sum(w * p) AS c3, sqrt(greatest(sum(w * w) * (sum(w * p * p) - sum(w * p) ** 2), 0)) AS se FROM x GROUP BY 1, 2, 3)
       SELECT i, j, k, round(c3, 8) AS c3, round(se, 8) AS se, round(c3 / se, 5) AS z FROM y""",
)
def third_moments(s, d):
    out = statistics.third_moments(species_members(s, d), base._weights(s, d), _TOP)
    return out.select("i", "j", "k", F.round("c3", 8).alias("c3"), F.round("se", 8).alias("se"), F.round("z", 5).alias("z"))


def _moment_sql(name: str, keep: str) -> str:
    return f"""{name}w AS (SELECT wts.team_id, w FROM wts JOIN tt USING (team_id) WHERE {keep}), {name}m AS (SELECT feature, sum(w) / (SELECT sum(w) FROM {name}w) AS m FROM mem JOIN {name}w USING (team_id) GROUP BY feature),
      {name}c AS (SELECT p.i, p.j, p - a.m * b.m AS c FROM (SELECT i, j, sum(w) / (SELECT sum(w) FROM {name}w) AS p FROM pr JOIN {name}w USING (team_id) GROUP BY 1, 2) p JOIN {name}m a ON a.feature = p.i JOIN {name}m b ON b.feature = p.j)"""


@query(
    "g25_calibration",
    f""", {stats._TRAIN}, {_moment_sql("o", "train")}, {_moment_sql("n", "NOT train")}, fst AS (SELECT feature, o.m AS a, n.m AS b FROM om o JOIN nm n USING (feature)),
       prs AS (SELECT coalesce(o.c, -x.a * y.a) AS a, coalesce(n.c, -x.b * y.b) AS b FROM oc o FULL JOIN nc n USING (i, j) JOIN fst x ON x.feature = i JOIN fst y ON y.feature = j)
       SELECT 'marginal' AS kind, count(*) AS n, round(corr(a, b), 7) AS r, round(avg(abs(a - b)), 9) AS mae FROM fst
       UNION ALL SELECT 'connected', count(*), round(corr(a, b), 7), round(avg(abs(a - b)), 9) FROM prs""",
)
def calibration(s, d):
    """Moments of the training time against those of the time after."""
    members, split = species_members(s, d), stats._train(s, d)
    weights = base._weights(s, d).join(split, "team_id")
    old, new = (corpus.empirical_moments(members, weights.where(k).select("team_id", "w")) for k in ("train", "NOT train"))
    return statistics.calibration(old, new).select("kind", "n", F.round("r", 7).alias("r"), F.round("mae", 9).alias("mae"))
