"""Registered queries on statistics and completion tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import corpus, evaluation, statistics
from lineupkit.plans import corpus_queries as base
from lineupkit.plans.evaluation_queries import _PLACED, _placed
from lineupkit.runtime import stash
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


_MONTHS = "mo AS (SELECT month, count(*) AS n FROM teams GROUP BY month)"


@query("g2_equal_windows", f", {_MONTHS}, k AS (SELECT month, n, row_number() OVER (ORDER BY month) - 1 AS k, count(*) OVER () AS c FROM mo) SELECT month, n, CAST(least(k // greatest(c // 6, 1), 5) AS INTEGER) AS window FROM k")
def equal_windows(s, d):
    return statistics.equal_windows(teams(s, d).groupBy("month").agg(F.count("*").alias("n")), "month", 6)


@query("g4_newest_held_out", f", mi AS (SELECT month, count(*) AS n FROM teams WHERE in_person GROUP BY month) SELECT month, n, coalesce(sum(n) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT sum(n) FROM mi) * 0.3::DOUBLE AS held_out FROM mi")
def newest_held_out(s, d):
    return statistics.newest_held_out(teams(s, d).where("in_person").groupBy("month").agg(F.count("*").alias("n")), "month", 0.3)


_TRAIN = f"{_MONTHS}, tm AS (SELECT month, sum(n) OVER (ORDER BY month) - n < round_even((SELECT sum(n) FROM mo) * 0.8::DOUBLE, 0) AS train FROM mo), tt AS (SELECT team_id, train FROM teams JOIN tm USING (month))"
_PROBLEMS = f"""{_TRAIN}, dr AS (SELECT team_id, feature, train, row_number() OVER (PARTITION BY team_id ORDER BY md5(team_id || '|' || feature)) AS k, count(*) OVER (PARTITION BY team_id) AS c FROM mem JOIN tt USING (team_id)),
 prob AS (SELECT team_id, feature, k <= 1 AS held_out FROM dr WHERE c >= 3 AND NOT train),
 tc AS (SELECT feature, count(*) AS n FROM mem JOIN tt USING (team_id) WHERE train GROUP BY feature),
 tj AS (SELECT p.i, p.j, count(*) AS n FROM (SELECT team_id, i, j FROM pr UNION ALL SELECT team_id, j, i FROM pr) p JOIN tt USING (team_id) WHERE train GROUP BY 1, 2),
 mrk AS (SELECT t.team_id, t.feature AS truth, 1 + (SELECT count(*) FROM tc x WHERE x.n > tc.n AND x.feature NOT IN (SELECT feature FROM prob h WHERE h.team_id = t.team_id AND NOT h.held_out)) AS rank
   FROM prob t JOIN tc ON tc.feature = t.feature WHERE t.held_out),
 cs AS (SELECT h.team_id, tj.i AS feature, sum(tj.n) AS score FROM prob h JOIN tj ON tj.j = h.feature WHERE NOT h.held_out GROUP BY 1, 2),
 cs2 AS (SELECT cs.* FROM cs ANTI JOIN (SELECT team_id, feature FROM prob WHERE NOT held_out) h ON h.team_id = cs.team_id AND h.feature = cs.feature),
 crk AS (SELECT t.team_id, t.feature AS truth, 1 + (SELECT count(*) FROM cs2 x WHERE x.team_id = t.team_id AND x.score > coalesce(o.score, 0)) AS rank
   FROM prob t LEFT JOIN cs2 o ON o.team_id = t.team_id AND o.feature = t.feature WHERE t.held_out)"""
_METRICS = "count(*) AS n, round(avg((rank <= 1)::INT), 8) AS hit1, round(avg((rank <= 5)::INT), 8) AS hit5, round(avg((rank <= 10)::INT), 8) AS hit10, round(avg(1.0::DOUBLE / rank), 8) AS mrr"


def _train(s, d):
    rows = teams(s, d).select("team_id", "month")
    split = evaluation.chronological_split(rows.groupBy("month").agg(F.count("*").alias("n")), "month", 0.8)
    return rows.join(F.broadcast(split.select("month", "train")), "month").select("team_id", "train")


def _problems(s, d, members=None):
    """Problems of the last fifth of the time, and the members of the teams before."""
    named = (species_members(s, d) if members is None else members).join(_train(s, d).hint("merge"), "team_id")
    named = stash(named, "problems")
    return statistics.leave_out(named.where("NOT train"), 1, 3), named.where("train").select("team_id", "feature")


@query("g5_leave_out", f", {_PROBLEMS} SELECT team_id, feature, held_out FROM prob")
def leave_out(s, d):
    return _problems(s, d)[0]


@query("g6_marginal_ranks", f", {_PROBLEMS} SELECT team_id, truth, rank FROM mrk")
def marginal_ranks(s, d):
    problems, train = _problems(s, d)
    return statistics.marginal_ranks(problems, train.groupBy("feature").agg(F.count("*").alias("n")))


@query("g6_cooccurrence_ranks", f", {_PROBLEMS} SELECT team_id, truth, rank FROM crk")
def cooccurrence_ranks(s, d):
    problems, train = _problems(s, d)
    return statistics.cooccurrence_ranks(problems, corpus.cooccurrence(train))


@query("g7_ranking_metrics", f", {_PROBLEMS} SELECT 'marginal' AS scorer, {_METRICS} FROM mrk UNION ALL SELECT 'cooccurrence', {_METRICS} FROM crk")
def ranking_metrics(s, d):
    problems, train = _problems(s, d)
    a = statistics.marginal_ranks(problems, train.groupBy("feature").agg(F.count("*").alias("n")))
    b = statistics.cooccurrence_ranks(problems, corpus.cooccurrence(train))
    out = [statistics.ranking_metrics(x).select(F.lit(n).alias("scorer"), "*") for n, x in (("marginal", a), ("cooccurrence", b))]
    return _rounded(out[0].unionByName(out[1]), 8, "hit1", "hit5", "hit10", "mrr")


@query("g22_paired_bootstrap", f""", {_PROBLEMS}, dl AS (SELECT m.team_id, 1.0::DOUBLE / c.rank - 1.0::DOUBLE / m.rank AS delta FROM mrk m JOIN crk c USING (team_id)),
       u AS (SELECT r.r AS replicate, delta, CAST('0x' || substring(md5(r.r || '|' || team_id), 1, 8) AS BIGINT)::DOUBLE / 4294967296 AS u FROM dl CROSS JOIN (SELECT unnest(range(1, 101)) AS r) r),
       w AS (SELECT replicate, delta, len(list_filter({statistics.POISSON}::DOUBLE[], lambda p: p <= u)) AS w FROM u)
       SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(w * delta) / sum(w), 8) AS delta FROM w WHERE w > 0 GROUP BY replicate""")
def paired_bootstrap(s, d):
    problems, train = _problems(s, d)
    a = statistics.marginal_ranks(problems, train.groupBy("feature").agg(F.count("*").alias("n"))).select("team_id", F.col("rank").alias("ra"))
    b = statistics.cooccurrence_ranks(problems, corpus.cooccurrence(train)).select("team_id", F.col("rank").alias("rb"))
    rows = a.join(b, "team_id").select("team_id", (1.0 / F.col("rb") - 1.0 / F.col("ra")).alias("delta"))
    return _rounded(statistics.bootstrap(rows, "team_id", "delta", 100), 8, "delta")


_MASKED = f""", {_TRAIN}, dr AS (SELECT pmem.*, train, row_number() OVER (PARTITION BY team_id ORDER BY md5(team_id || '|' || feature)) AS k, count(*) OVER (PARTITION BY team_id) AS c FROM pmem JOIN tt USING (team_id)),
 prob AS (SELECT *, k <= 1 AS held_out FROM dr WHERE c >= 3 AND NOT train),
 voc AS (SELECT feature, species, item, count(*) AS n FROM pmem JOIN tt USING (team_id) WHERE train GROUP BY ALL),
 hp AS (SELECT p.team_id, list(DISTINCT v.species) AS ss, list(DISTINCT v.item) AS it FROM prob p JOIN voc v USING (feature) WHERE NOT held_out GROUP BY p.team_id),
 vr AS (SELECT t.team_id, t.feature AS truth, v.n AS own, ss, it FROM prob t JOIN voc v USING (feature) JOIN hp ON hp.team_id = t.team_id WHERE held_out),
 rk AS (SELECT vr.team_id, vr.truth, 1 + count(x.feature) AS valid, 1 + count(x.feature) FILTER (x.n > own) AS rank FROM vr LEFT JOIN voc x ON NOT list_contains(ss, x.species) AND NOT list_contains(it, x.item) AND x.feature <> truth GROUP BY ALL)"""


def _masked(s, d):
    members = pair_members(s, d)
    problems, train = _problems(s, d, members.select("team_id", "feature"))
    counts = train.groupBy("feature").agg(F.count("*").alias("n")).join(members.select("feature", "species", "item").distinct(), "feature")
    return statistics.masked_ranks(problems, counts)


@query("g8_masked_ranks", f"{_MASKED} SELECT team_id, truth, CAST(valid AS INTEGER) AS valid, CAST(rank AS INTEGER) AS rank FROM (SELECT team_id, truth, valid, rank FROM rk)")
def masked_ranks(s, d):
    return _masked(s, d)


@query("g41_masked_metrics", f"{_MASKED} SELECT {_METRICS} FROM (SELECT rank FROM rk)")
def masked_metrics(s, d):
    return _rounded(statistics.ranking_metrics(_masked(s, d)), 8, "hit1", "hit5", "hit10", "mrr")


@query("g9_pseudo_likelihood", """, z AS (SELECT t.team_id, f.feature, f.h + coalesce(sum(c.coupling), 0) AS z, bool_or(m.feature = f.feature) AS inside
         FROM (SELECT DISTINCT team_id FROM mem SEMI JOIN fld USING (feature)) t CROSS JOIN fld f JOIN mem m ON m.team_id = t.team_id LEFT JOIN csym c ON c.i = f.feature AND c.j = m.feature GROUP BY t.team_id, f.feature, f.h)
       SELECT team_id, round(sum(CASE WHEN inside THEN z ELSE 0 END - greatest(z, 0) - ln(1 + exp(-abs(z)))), 6) AS pll FROM z GROUP BY team_id""")
def pseudo_likelihood(s, d):
    fields, couplings = base._model(s, d)
    return _rounded(statistics.pseudo_likelihood(species_members(s, d), fields, couplings), 6, "pll")


@query("g11_sparsity", "SELECT round(1 - count(*) FILTER (abs(coupling) >= 1e-6) / ((SELECT count(*) FROM fld) * ((SELECT count(*) FROM fld) - 1) / 2.0::DOUBLE), 8) AS sparsity, round(sum(abs(coupling)) / ((SELECT count(*) FROM fld) * ((SELECT count(*) FROM fld) - 1) / 2.0::DOUBLE), 8) AS mean_abs FROM cpl")
def sparsity(s, d):
    fields, couplings = base._model(s, d)
    v = fields.agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    sums = couplings.agg(F.sum((F.abs("coupling") >= 1e-6).cast("long")).alias("k"), F.sum(F.abs("coupling")).alias("a"))
    return sums.crossJoin(v).select(F.round(1 - F.col("k") / F.col("pairs"), 8).alias("sparsity"), F.round(F.col("a") / F.col("pairs"), 8).alias("mean_abs"))


@query("g15_rank_placement", """SELECT team_id, round(1 - (rank() OVER (PARTITION BY month ORDER BY "placing") - 1) / nullif(count(*) OVER (PARTITION BY month) - 1, 0)::DOUBLE, 9) AS placement FROM teams""")
def rank_placement(s, d):
    rows = teams(s, d).withColumn("rank_", evaluation.average_rank("placing", "month"))
    n = rows.groupBy("month").agg(F.count("*").alias("n_"))
    return rows.join(n, "month").select("team_id", F.round(F.when(F.col("n_") >= 2, 1 - (F.col("rank_") - 1) / (F.col("n_") - 1)), 9).alias("placement"))


_RANKED = f"""{_PLACED}, kn AS (SELECT pl.team_id, pl.month, pl.player, score, placement, round(popularity, 6) AS popularity FROM pl JOIN sc USING (team_id) WHERE score IS NOT NULL AND placement IS NOT NULL),
 rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx, rank() OVER (ORDER BY placement) + (count(*) OVER (PARTITION BY placement) - 1) / 2 AS ry,
   rank() OVER (ORDER BY popularity) + (count(*) OVER (PARTITION BY popularity) - 1) / 2 AS rz FROM kn)"""


def _known(s, d):
    """Teams with a score and a placement; the model's scores are worked out once for both columns."""
    placed = evaluation.placement(teams(s, d), "month", "placing").select("team_id", "month", "player", "in_person", "placement")
    scores = base._scores(s, d).select("team_id", F.round("score", 6).alias("score"), F.round("popularity", 6).alias("popularity"))
    known = placed.join(scores.hint("merge"), "team_id").where("score IS NOT NULL AND placement IS NOT NULL")
    return stash(known.select("team_id", "month", "player", "in_person", "score", "placement", "popularity"), "known")


@query("g16_pooled_spearman", f", {_RANKED} SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM rk")
def pooled_spearman(s, d):
    rows = _known(s, d)
    for c in ("score", "placement"):
        rows = statistics.pooled_ranks(rows, c, 0.01)
    return rows.agg(F.count("*").alias("n"), F.round(F.corr("rank_score", "rank_placement"), 8).alias("rho"))


@query("g17_quantile_bins", f""", {_RANKED}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM kn),
       b AS (SELECT placement, len(list_filter(e, lambda x: round(x, 9) <= round(score, 9))) AS bin FROM kn, e)
       SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(placement), 8) AS mean, round(quantile_cont(placement, 0.1), 8) AS p10, round(quantile_cont(placement, 0.5), 8) AS p50, round(quantile_cont(placement, 0.9), 8) AS p90,
       round(quantile_cont(placement, 0.9) - quantile_cont(placement, 0.1), 8) AS spread, round(avg((placement >= 0.75)::INT), 8) AS top75, round(avg((placement >= 0.95)::INT), 8) AS top95 FROM b GROUP BY bin""")
def quantile_bins(s, d):
    out = statistics.quantile_bins(_known(s, d), "score", "placement", 10, 0.01)
    return _rounded(out, 8, "mean", "p10", "p50", "p90", "spread", "top75", "top95")


@query("g18_partial_spearman", f""", {_RANKED}, r AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(rz, ry) AS zy FROM rk)
       SELECT round(xy, 7) AS xy, round(xz, 7) AS xz, round(zy, 7) AS zy, round((xy - xz * zy) / sqrt((1 - xz * xz) * (1 - zy * zy)), 7) AS partial, round(xy * xy, 7) AS r2_x, round(zy * zy, 7) AS r2_z,
       round((xy * xy + zy * zy - 2 * xy * zy * xz) / (1 - xz * xz), 7) AS r2_both FROM r""")
def partial_spearman(s, d):
    out = statistics.partial_spearman(_known(s, d), "score", "placement", "popularity", 0.01)
    return _rounded(out, 7, *out.columns)


@query("g20_permutation_null", f""", {_RANKED}, m AS (SELECT kn.*, r FROM kn CROSS JOIN (SELECT unnest(range(1, 21)) AS r)),
       a AS (SELECT r, month, team_id, score, row_number() OVER (PARTITION BY r, month ORDER BY team_id) AS k FROM m), b AS (SELECT r, month, placement, row_number() OVER (PARTITION BY r, month ORDER BY md5(r || '|' || team_id)) AS k FROM m)
       SELECT CAST(r AS INTEGER) AS replicate, round(corr(score, placement), 8) AS r FROM a JOIN b USING (r, month, k) GROUP BY r""")
def permutation_null(s, d):
    return _rounded(statistics.dealt_correlations(_known(s, d), "month", "team_id", "score", "placement", 20), 8, "r")


@query("g21_windowed_icc", f""", {_RANKED}, {_MONTHS}, k AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k, count(*) OVER () AS c FROM mo), wd AS (SELECT month, least(k // greatest(c // 4, 1), 3) AS w FROM k),
       g AS (SELECT w, player, count(*) AS k, sum(placement) AS s, sum(placement * placement) AS ss FROM kn JOIN wd USING (month) GROUP BY 1, 2 HAVING count(*) >= 2),
       t AS (SELECT w, count(*) AS g, CAST(sum(k) AS BIGINT) AS n, sum(k * k)::DOUBLE AS kk, sum(s) AS s, sum(ss) AS ss, sum(s * s / k) AS sk FROM g GROUP BY w),
       m AS (SELECT *, (sk - s * s / n) / (g - 1) AS b, (ss - sk) / (n - g) AS wi, (n - kk / n) / (g - 1) AS k0 FROM t)
       SELECT CAST(w AS INTEGER) AS window, g AS groups, n, round((b - wi) / (b + (k0 - 1) * wi), 7) AS icc FROM m""")
def windowed_icc(s, d):
    rows = _known(s, d)
    windows = statistics.equal_windows(teams(s, d).select("month").distinct(), "month", 4)
    named = rows.join(F.broadcast(windows), "month")
    out = None
    for k in range(4):
        one = evaluation.icc(named.where(F.col("window") == k), "player", "placement").select(F.lit(k).alias("window"), "groups", "n", F.round("icc", 7).alias("icc"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g26_quadrants", """, pp AS (SELECT cpl.i, cpl.j, coupling, greatest(ln(n * (SELECT sum(n) FROM sym) / (a.r * b.r)), 0) AS ppmi FROM cpl JOIN cooc USING (i, j)
         JOIN (SELECT i, sum(n)::DOUBLE AS r FROM sym GROUP BY i) a ON a.i = cpl.i JOIN (SELECT i AS j, sum(n)::DOUBLE AS r FROM sym GROUP BY i) b ON b.j = cpl.j)
       SELECT coupling > 0 AS j_positive, ppmi > 0 AS ppmi_positive, count(*) AS pairs, round(avg(coupling), 8) AS mean_j FROM pp GROUP BY 1, 2""")
def quadrants(s, d):
    both = base._model(s, d)[1].join(corpus.shifted_ppmi(corpus.cooccurrence(species_members(s, d))), ["i", "j"])
    keys = [(F.col("coupling") > 0).alias("j_positive"), (F.col("ppmi") > 0).alias("ppmi_positive")]
    return both.groupBy(*keys).agg(F.count("*").alias("pairs"), F.round(F.avg("coupling"), 8).alias("mean_j"))


@query("g33_leverage", "SELECT month, round(3.0::DOUBLE * f / (3.0::DOUBLE * f + 1 - f), 9) AS leverage FROM (SELECT month, avg(in_person::INT) AS f FROM teams GROUP BY month)")
def leverage(s, d):
    f = teams(s, d).groupBy("month").agg(F.avg(F.col("in_person").cast("double")).alias("f"))
    return f.select("month", F.round(3.0 * F.col("f") / (3.0 * F.col("f") + 1 - F.col("f")), 9).alias("leverage"))


@query("g37_random_split", "SELECT team_id, row_number() OVER (ORDER BY md5(team_id::VARCHAR)) <= round_even((SELECT count(*) FROM teams) * 0.2::DOUBLE, 0) AS test FROM teams")
def random_split(s, d):
    return statistics.random_split(teams(s, d).select("team_id"), "team_id", 0.2)


@query("g38_score_shape", f", {_RANKED} SELECT round(quantile_cont(score, 0.5), 6) AS median, round(avg((score > 0)::INT), 8) AS positive, round(sum(power(score - a, 3)) / count(*) / power(sum(power(score - a, 2)) / count(*), 1.5), 6) AS skew, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr FROM kn, (SELECT avg(score) AS a FROM kn)")
def score_shape(s, d):
    rows = _known(s, d)
    q = statistics.quantiles(rows, "score", [0.25, 0.5, 0.75], 0.01)
    wide = q.agg(*[F.sum(F.when(F.col("q") == k, F.col("value"))).alias(n) for k, n in ((0.25, "a"), (0.5, "median"), (0.75, "b"))])
    sums = rows.agg(F.avg((F.col("score") > 0).cast("double")).alias("positive"), F.skewness("score").alias("skew"))
    return wide.crossJoin(sums).select(F.round("median", 6).alias("median"), F.round("positive", 8).alias("positive"), F.round("skew", 6).alias("skew"), F.round(F.col("b") - F.col("a"), 6).alias("iqr"))


@query("g43_sign_subgraphs", """, top AS (SELECT feature FROM fld ORDER BY m DESC, feature LIMIT 15), e AS (SELECT i, j, coupling, coupling > 0 AS pos FROM cpl SEMI JOIN top a ON a.feature = cpl.i SEMI JOIN top b ON b.feature = cpl.j),
       t AS (SELECT pos, quantile_cont(abs(coupling), 0.75) AS t FROM e GROUP BY pos) SELECT i, j, pos AS positive, round(coupling, 8) AS coupling FROM e JOIN t USING (pos) WHERE abs(coupling) >= t - 1e-12""")
def sign_subgraphs(s, d):
    """Edges among the 15 most frequent features, each sign above its own quantile; features without an edge have no row."""
    fields, couplings = base._model(s, d)
    top = fields.orderBy(F.desc("m"), "feature").limit(15).select("feature")
    e = couplings.join(top.toDF("i"), "i", "left_semi").join(top.toDF("j"), "j", "left_semi").withColumn("positive", F.col("coupling") > 0)
    t = e.groupBy("positive").agg(F.percentile(F.abs("coupling"), F.lit(0.75)).alias("t_"))
    return e.join(t, "positive").where(F.abs("coupling") >= F.col("t_") - 1e-12).select("i", "j", "positive", F.round("coupling", 8).alias("coupling"))


@query("g44_team_sizes", """, v AS (SELECT feature FROM mem GROUP BY feature HAVING count(*) >= 50), k AS (SELECT t.team_id, count(v.feature) AS k FROM teams t LEFT JOIN mem USING (team_id) LEFT JOIN v USING (feature) GROUP BY t.team_id)
       SELECT min(k) AS least, round(quantile_cont(k, 0.5), 6) AS median, max(k) AS most, round(avg(k), 6) AS mean FROM k""")
def team_sizes(s, d):
    members = species_members(s, d)
    vocab = members.groupBy("feature").agg(F.count("*").alias("n_")).where("n_ >= 50")
    sizes = members.join(vocab, "feature").groupBy("team_id").agg(F.count("*").alias("k"))
    rows = teams(s, d).select("team_id").join(sizes, "team_id", "left").fillna(0, ["k"])
    return rows.agg(F.min("k").alias("least"), F.round(F.percentile("k", F.lit(0.5)), 6).alias("median"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("g46_histograms", f""", {_PLACED}, x AS (SELECT in_person, score FROM pl WHERE score IS NOT NULL), r AS (SELECT min(score) AS a, max(score) AS b FROM x),
       k AS (SELECT in_person, CAST(least(floor((score - a) / (b - a) * 50), 49) AS INTEGER) AS bin, any_value((b - a) / 50) AS width, count(*) AS n FROM x, r GROUP BY 1, 2)
       SELECT in_person, bin, n, round(n / sum(n) OVER (PARTITION BY in_person) / width, 8) AS density FROM k""")
def histograms(s, d):
    rows = stash(_placed(s, d).where("score IS NOT NULL").select("in_person", "score"), "histogram")
    span = rows.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    binned = rows.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("score") - F.col("a")) / (F.col("b") - F.col("a")) * 50), F.lit(49)).cast("int"))
    counts = binned.groupBy("in_person", "bin").agg(F.count("*").alias("n"), F.first((F.col("b") - F.col("a")) / 50).alias("w"))
    total = rows.groupBy("in_person").agg(F.count("*").alias("t"))
    return counts.join(total, "in_person").select("in_person", "bin", "n", F.round(F.col("n") / F.col("t") / F.col("w"), 8).alias("density"))
