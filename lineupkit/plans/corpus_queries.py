"""Registered queries over the corpus and over a closed-form model of it, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.operators import completion, corpus, evaluation, scoring
from lineupkit.runtime import stash
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, rosters, species_members, teams

TAU, IN_PERSON, SUPPORT = 365.0, 3.0, 10
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            # A text that starts with a comma adds tables of its own to the shared ones.
            SQL[name] = f"WITH {MEMBERS_SQL},{_SHARED}\n{sql}"
        return f

    return add


_SHARED = """
raww AS (SELECT team_id, exp(-date_diff('day', day, (SELECT max(day) FROM teams)) / 365.0::DOUBLE)
                * CASE WHEN in_person THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS r FROM teams),
wts AS (SELECT team_id, r * (SELECT count(*) FROM raww) / (SELECT sum(r) FROM raww) AS w FROM raww),
pr AS (SELECT a.team_id, a.feature AS i, b.feature AS j FROM mem a JOIN mem b ON a.team_id = b.team_id AND a.feature < b.feature),
cooc AS (SELECT i, j, count(*) AS n FROM pr GROUP BY i, j),
sym AS (SELECT i, j, n FROM cooc UNION ALL SELECT j, i, n FROM cooc),
marg AS (SELECT feature, sum(w) / (SELECT sum(w) FROM wts) AS m FROM mem JOIN wts USING (team_id) GROUP BY feature),
fld AS (SELECT feature, m, ln(m / (1 - m)) AS h FROM marg WHERE m > 0 AND m < 1),
cpl AS (SELECT p.i, p.j, ln(s / (SELECT sum(w) FROM wts) / (a.m * b.m)) AS coupling
        FROM (SELECT i, j, count(*) AS n, sum(w) AS s FROM pr JOIN wts USING (team_id) GROUP BY i, j) p
        JOIN fld a ON a.feature = p.i JOIN fld b ON b.feature = p.j WHERE n >= 10),
csym AS (SELECT i, j, coupling FROM cpl UNION ALL SELECT j, i, coupling FROM cpl),
ros AS (SELECT team_id, list_sort(list(feature)) AS roster FROM mem GROUP BY team_id),
rcount AS (SELECT array_to_string(roster, '-') AS roster_key, count(*) AS n FROM ros GROUP BY 1),
sc AS (SELECT team_id, popularity, coalesce(c, 0) AS coherence FROM
        (SELECT team_id, sum(h) AS popularity FROM mem JOIN fld USING (feature) GROUP BY team_id)
        LEFT JOIN (SELECT team_id, sum(coupling) AS c FROM pr JOIN cpl USING (i, j) GROUP BY team_id) USING (team_id))"""


def _weights(s: SparkSession, d: str) -> DataFrame:
    return corpus.team_weights(teams(s, d), TAU, IN_PERSON)


def _model(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fields and couplings, made once: their files show how short they are, so rows of teams need not be dealt by feature to meet them."""
    fields, couplings = corpus.log_odds_model(species_members(s, d), _weights(s, d), SUPPORT)
    return stash(fields, "model-fields"), stash(couplings, "model-couplings")


def _scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.team_scores(species_members(s, d), *_model(s, d))


@query("c0_team_weights", "SELECT team_id, round(w, 8) AS w FROM wts")
def team_weights(s, d):
    return _weights(s, d).select("team_id", F.round("w", 8).alias("w"))


@query(
    "c1_vocab_cutoff",
    """SELECT feature, raw_count, round(weighted_count, 6) AS weighted_count,
       CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS feature_id FROM (
       SELECT feature, count(*) AS raw_count, sum(w) AS weighted_count FROM pmem JOIN wts USING (team_id) GROUP BY feature)
       WHERE raw_count >= 40 AND weighted_count >= 40""",
)
def vocab_cutoff(s, d):
    out = corpus.vocabulary(pair_members(s, d).select("team_id", "feature"), _weights(s, d), 40)
    return out.select("feature", "raw_count", F.round("weighted_count", 6).alias("weighted_count"), "feature_id")


@query("c2_weighted_marginals", "SELECT feature, round(m, 9) AS m FROM marg")
def weighted_marginals(s, d):
    return corpus.marginals(species_members(s, d), _weights(s, d)).select("feature", F.round("m", 9).alias("m"))


@query(
    "c3_empirical_moments",
    """SELECT i, j, round(sum(w) / (SELECT sum(w) FROM wts), 9) AS p FROM
       (SELECT * FROM pr UNION ALL SELECT team_id, feature, feature FROM mem) JOIN wts USING (team_id) GROUP BY i, j""",
)
def empirical_moments(s, d):
    return corpus.empirical_moments(species_members(s, d), _weights(s, d)).select("i", "j", F.round("p", 9).alias("p"))


@query("c4_cooccurrence", "SELECT i, j, n FROM cooc")
def cooccurrence(s, d):
    return corpus.cooccurrence(species_members(s, d))


@query(
    "c7_ppmi",
    """SELECT i, j, round(greatest(ln(n * (SELECT sum(n) FROM sym) / (a.r * b.r)) - ln(0.9::DOUBLE), 0), 9) AS ppmi FROM cooc
       JOIN (SELECT i, sum(n)::DOUBLE AS r FROM sym GROUP BY i) a USING (i)
       JOIN (SELECT i AS j, sum(n)::DOUBLE AS r FROM sym GROUP BY i) b USING (j)""",
)
def ppmi(s, d):
    return corpus.shifted_ppmi(corpus.cooccurrence(species_members(s, d)), 0.9).select("i", "j", F.round("ppmi", 9).alias("ppmi"))


@query(
    "c9_binary_correlation",
    """SELECT i, j, round((n * 30 / (SELECT sum(n)::DOUBLE FROM sym) - a.m * b.m) / sqrt(a.m * (1 - a.m) * b.m * (1 - b.m)), 9) AS corr
       FROM cooc JOIN marg a ON a.feature = i JOIN marg b ON b.feature = j""",
)
def binary_correlation(s, d):
    members = species_members(s, d)
    moments = corpus.binary_moments(corpus.marginals(members, _weights(s, d)), corpus.cooccurrence(members), 6)
    return corpus.binary_correlation(moments).select("i", "j", F.round("corr", 9).alias("corr"))


@query("c10_support_mask", "SELECT i, j FROM cooc WHERE n >= 300")
def support_mask(s, d):
    return corpus.support_mask(corpus.cooccurrence(species_members(s, d)), 300)


@query(
    "c11_species_rollup",
    """SELECT least(x.species, y.species) AS i, greatest(x.species, y.species) AS j, count(*) AS n
       FROM pmem x JOIN pmem y ON x.team_id = y.team_id AND x.feature < y.feature AND x.species <> y.species GROUP BY 1, 2""",
)
def species_rollup(s, d):
    members = pair_members(s, d)
    site = members.select("feature", "species").distinct()
    return corpus.species_rollup(corpus.cooccurrence(members.select("team_id", "feature")), site)


@query(
    "c12_teammates_pct",
    """SELECT i, j, n, round(n / t, 9) AS share, rank FROM (SELECT i, j, n, t::DOUBLE AS t,
         CAST(row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS INTEGER) AS rank
         FROM sym JOIN (SELECT feature AS i, count(*) AS t FROM mem GROUP BY 1) USING (i)) WHERE rank <= 10""",
)
def teammates_pct(s, d):
    members = species_members(s, d)
    out = corpus.teammates(corpus.cooccurrence(members), members.groupBy("feature").count(), 10)
    return out.withColumn("share", F.round("share", 9))


@query("c13_roster_counts", "SELECT roster_key, n FROM rcount")
def roster_counts(s, d):
    return corpus.roster_counts(species_members(s, d))


@query(
    "c16_species_aggregates",
    """, pm AS (SELECT species, feature, sum(w) / (SELECT sum(w) FROM wts) AS m FROM pmem JOIN wts USING (team_id) GROUP BY 1, 2)
       SELECT species, round(sum(m), 9) AS usage, round(sum(m * ln(m / (1 - m))) / sum(m), 8) AS mean_h, count(*) AS features FROM pm GROUP BY species""",
)
def species_aggregates(s, d):
    members = pair_members(s, d)
    m = corpus.marginals(members.select("team_id", "feature"), _weights(s, d)).join(members.select("feature", "species").distinct(), "feature")
    h = F.ln(F.col("m") / (1 - F.col("m")))
    return m.groupBy("species").agg(
        F.round(F.sum("m"), 9).alias("usage"), F.round(F.sum(F.col("m") * h) / F.sum("m"), 8).alias("mean_h"), F.count("*").alias("features")
    )


@query(
    "c17_appearances",
    """SELECT feature, count(*) AS teams, count(DISTINCT roster) AS rosters FROM mem JOIN ros USING (team_id) GROUP BY feature""",
)
def appearances(s, d):
    members = species_members(s, d)
    keyed = rosters(members).select(F.array_join("roster", "-").alias("key"), F.explode("roster").alias("feature"))
    per = keyed.groupBy("feature", "key").agg(F.count("*").alias("n"))
    return per.groupBy("feature").agg(F.sum("n").alias("teams"), F.count("*").alias("rosters"))


@query(
    "c18_support_census",
    """SELECT k AS level, (SELECT count(*) FROM cooc WHERE n >= k) AS pairs FROM (SELECT unnest([5, 10, 20, 50, 300])::INTEGER AS k)""",
)
def support_census(s, d):
    return corpus.support_census(corpus.cooccurrence(species_members(s, d)), [5, 10, 20, 50, 300])


@query(
    "c19_contingency",
    """SELECT p.month, count(*) FILTER (feature = 'Brand#11') AS b11, count(*) FILTER (feature = 'Brand#22') AS b22,
       count(*) FILTER (feature = 'Brand#33') AS b33 FROM teams p JOIN mem USING (team_id) GROUP BY p.month""",
)
def contingency(s, d):
    named = species_members(s, d).join(teams(s, d).select("team_id", "month"), "team_id")
    wide = named.groupBy("month").pivot("feature", ["Brand#11", "Brand#22", "Brand#33"]).count().fillna(0)
    return wide.toDF("month", "b11", "b22", "b33")


@query("c20_effective_size", "SELECT round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM wts")
def effective_size(s, d):
    return corpus.effective_size(_weights(s, d)).select(F.round("ess", 6).alias("ess"))


@query(
    "c21_align_prior",
    """, old AS (SELECT feature, h FROM fld WHERE feature < 'Brand#4')
       SELECT m.feature, round(coalesce(h, 0), 9) AS h,
         (SELECT count(*) FROM cpl WHERE i = m.feature AND j IN (SELECT feature FROM marg)) AS couplings
       FROM (SELECT DISTINCT feature FROM marg) m LEFT JOIN old USING (feature)""",
)
def align_prior(s, d):
    fields, couplings = _model(s, d)
    vocab = fields.select("feature")
    h, kept = corpus.align_prior(vocab, fields.where("feature < 'Brand#4'"), couplings)
    counts = kept.groupBy(F.col("i").alias("feature")).agg(F.count("*").alias("couplings"))
    return h.join(counts, "feature", "left").select("feature", F.round("h", 9).alias("h"), F.coalesce("couplings", F.lit(0)).alias("couplings"))


@query(
    "e3_team_scores",
    """SELECT team_id, round(popularity, 6) AS popularity, round(coherence, 6) AS coherence, round(popularity + coherence, 6) AS score,
       round(-(popularity + coherence), 6) AS energy FROM sc""",
)
def team_scores(s, d):
    return _scores(s, d).select("team_id", *[F.round(c, 6).alias(c) for c in ("popularity", "coherence", "score", "energy")])


@query(
    "e4_pairwise_rows",
    """, r AS (SELECT team_id, i, j, round(coalesce(coupling, 0), 9) AS c FROM pr LEFT JOIN cpl USING (i, j))
       SELECT team_id, i, j, round(c, 8) AS coupling, round(abs(c) / CASE WHEN t = 0 THEN 1 ELSE t END, 7) AS share, rank FROM (
         SELECT *, sum(abs(c)) OVER (PARTITION BY team_id) AS t,
         CAST(row_number() OVER (PARTITION BY team_id ORDER BY abs(c) DESC, i, j) AS INTEGER) AS rank FROM r)""",
)
def pairwise_rows(s, d):
    _, couplings = _model(s, d)
    out = scoring.pairwise_rows(species_members(s, d), couplings.withColumn("coupling", F.round("coupling", 9)))
    return out.select("team_id", "i", "j", F.round("coupling", 8).alias("coupling"), F.round("share", 7).alias("share"), "rank")


@query(
    "e20_single_swaps",
    """, m6 AS (SELECT mem.* FROM mem SEMI JOIN fld USING (feature)),
       pull AS (SELECT team_id, csym.i AS f, sum(coupling) AS p FROM m6 JOIN csym ON m6.feature = csym.j GROUP BY 1, 2),
       sw AS (SELECT o.team_id, o.feature AS out, c.feature AS "in", a.h AS ho, c.h AS hi, coalesce(x.p, 0) AS po, coalesce(y.p, 0) AS pi, coalesce(t.coupling, 0) AS tie
         FROM m6 o JOIN fld a ON a.feature = o.feature JOIN fld c ON NOT EXISTS (SELECT 1 FROM m6 z WHERE z.team_id = o.team_id AND z.feature = c.feature)
         LEFT JOIN pull x ON x.team_id = o.team_id AND x.f = o.feature LEFT JOIN pull y ON y.team_id = o.team_id AND y.f = c.feature
         LEFT JOIN csym t ON t.i = c.feature AND t.j = o.feature),
       ds AS (SELECT team_id, out, "in", -0.5::DOUBLE * (hi - ho) - (pi - tie - po) AS da, -(hi - ho) - (pi - tie - po) AS dr, pi - tie - po AS dc FROM sw),
       rk AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY round(da, 9), out, "in") AS k FROM ds)
       SELECT team_id, out, "in", round(da, 6) AS delta_adj, round(dr, 6) AS delta_raw, round(dc, 6) AS delta_coherence, CAST(k AS INTEGER) AS rank FROM rk WHERE k <= 10""",
)
def single_swaps(s, d):
    out = completion.ranked_swaps(species_members(s, d), completion.local_model(*_model(s, d)), 10, 0.5)
    return out.select("team_id", "out", "in", *[F.round(c, 6).alias(c) for c in ("delta_adj", "delta_raw", "delta_coherence")], "rank")


def _held(s, d):
    """One or two members of every team: the first and last by name."""
    ends = species_members(s, d).groupBy("team_id").agg(F.min("feature").alias("a"), F.max("feature").alias("b"))
    return ends.select("team_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("feature"))


_HELD = """held AS (SELECT DISTINCT team_id, unnest([min(feature), max(feature)]) AS feature FROM mem GROUP BY team_id)"""


@query(
    "e21_cooccurrence_scores",
    f""", {_HELD}
       SELECT t.team_id, v.feature, CAST(coalesce(sum(n), 0) AS BIGINT) AS score FROM (SELECT DISTINCT team_id FROM held) t CROSS JOIN (SELECT DISTINCT feature FROM mem) v
       LEFT JOIN (SELECT team_id, i, n FROM held JOIN sym ON sym.j = held.feature) x ON x.team_id = t.team_id AND x.i = v.feature GROUP BY 1, 2""",
)
def cooccurrence_scores(s, d):
    members = species_members(s, d)
    return scoring.cooccurrence_scores(_held(s, d), corpus.cooccurrence(members), members.select("feature"))


def _greedy_sql(size: int) -> str:
    parts = [f", {_HELD}, g0 AS (SELECT team_id, feature, 0 AS step FROM held)"]
    for k in range(1, size):
        parts.append(
            f"""g{k} AS (SELECT * FROM g{k - 1} UNION ALL SELECT team_id, feature, {k} FROM (
              SELECT t.team_id, v.feature, row_number() OVER (PARTITION BY t.team_id ORDER BY coalesce(sum(n), 0) DESC, v.feature) AS r
              FROM (SELECT team_id FROM g{k - 1} GROUP BY team_id HAVING count(*) < {size}) t CROSS JOIN (SELECT DISTINCT feature FROM mem) v
              LEFT JOIN (SELECT team_id, i, n FROM g{k - 1} JOIN sym ON sym.j = g{k - 1}.feature) x ON x.team_id = t.team_id AND x.i = v.feature
              WHERE NOT EXISTS (SELECT 1 FROM g{k - 1} o WHERE o.team_id = t.team_id AND o.feature = v.feature)
              GROUP BY 1, 2) WHERE r = 1)"""
        )
    return ",\n".join(parts) + f" SELECT team_id, feature, CAST(step AS INTEGER) AS step FROM g{size - 1}"


@query("e22_cooccurrence_greedy", _greedy_sql(6))
def cooccurrence_greedy(s, d):
    members = species_members(s, d)
    return scoring.cooccurrence_greedy(_held(s, d), corpus.cooccurrence(members), members.select("feature"), 6)


@query(
    "e24_top_feature_of_site",
    """, pm AS (SELECT species, feature, sum(w) / (SELECT sum(w) FROM wts) AS m FROM pmem JOIN wts USING (team_id) GROUP BY 1, 2)
       SELECT species, arg_max(feature, m) AS feature, round(max(m), 9) AS m FROM pm GROUP BY species""",
)
def top_feature_of_site(s, d):
    members = pair_members(s, d)
    m = corpus.marginals(members.select("team_id", "feature"), _weights(s, d)).join(members.select("feature", "species").distinct(), "feature")
    return m.groupBy("species").agg(F.max_by("feature", "m").alias("feature"), F.round(F.max("m"), 9).alias("m"))


#: The teams of the last fifth of the time ask, all teams before are the corpus; a roster is a mask of its features.
_LATE = """, mo AS (SELECT month, count(*) AS n FROM teams GROUP BY month), tm AS (SELECT month, sum(n) OVER (ORDER BY month) - n < round_even((SELECT sum(n) FROM mo) * 0.8::DOUBLE, 0) AS train FROM mo),
       vid AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS k FROM (SELECT DISTINCT feature FROM mem)),
       msk AS (SELECT team_id, train, bit_or(1::BIGINT << k::INT) AS b FROM mem JOIN vid USING (feature) JOIN teams USING (team_id) JOIN tm USING (month) GROUP BY 1, 2),
       c AS (SELECT b, count(*) AS n FROM msk WHERE train GROUP BY b), q AS (SELECT b, count(*) AS n FROM msk WHERE NOT train GROUP BY b),
       near AS (SELECT q.b, any_value(q.n) AS asked, min({'d': (bit_count(q.b) - bit_count(q.b & c.b))::BIGINT, 'n': -c.n}) AS m FROM q CROSS JOIN c GROUP BY q.b)"""


def _late_and_seen(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(team_id, roster) of the last fifth of the time, and (roster, n) of all teams before: every team is on one side."""
    when = teams(s, d).select("team_id", "month")
    split = evaluation.chronological_split(when.groupBy("month").agg(F.count("*").alias("n")), "month", 0.8)
    dated = rosters(species_members(s, d)).join(when.join(F.broadcast(split.select("month", "train")), "month"), "team_id")
    return dated.where("NOT train").select("team_id", "roster"), dated.where("train").groupBy("roster").agg(F.count("*").alias("n"))


@query("e25_nearest_observed", f"{_LATE} SELECT team_id, m.d AS delta, -m.n AS n FROM msk JOIN near USING (b) WHERE NOT train")
def nearest_observed(s, d):
    return scoring.nearest_observed(*_late_and_seen(s, d))


#: Every distinct roster against every other by the members they share; each meets itself, so none is left without.
_NEAR_ALL = """, rr AS (SELECT roster, count(*) AS n, row_number() OVER () AS id FROM ros GROUP BY roster),
       rf AS (SELECT id, n, len(roster) AS k, unnest(roster) AS feature FROM rr),
       ov AS (SELECT a.id, a.k - count(*) AS delta, b.n FROM rf a JOIN rf b USING (feature) GROUP BY a.id, a.k, b.id, b.n),
       best AS (SELECT id, delta, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta, n DESC) AS r FROM ov) WHERE r = 1)"""


@query("e25_nearest_observed_all", f"{_NEAR_ALL} SELECT team_id, delta, best.n FROM ros JOIN rr USING (roster) JOIN best USING (id)")
def nearest_observed_all(s, d):
    """All teams against all rosters, their own included."""
    every = rosters(species_members(s, d))
    return scoring.nearest_observed(every, every.groupBy("roster").agg(F.count("*").alias("n")))


@query(
    "e28_variety",
    """, ct AS (SELECT month AS "group", team_id, list(feature) AS f FROM mem JOIN teams USING (team_id) GROUP BY 1, 2)
       SELECT a."group", round(avg(CASE WHEN a.team_id < b.team_id THEN greatest(len(a.f), len(b.f)) - len(list_intersect(a.f, b.f)) END), 9) AS variety
       FROM ct a LEFT JOIN ct b ON a."group" = b."group" GROUP BY 1""",
)
def variety(s, d):
    named = species_members(s, d).join(teams(s, d).select("team_id", F.col("month").alias("group")), "team_id")
    return scoring.variety(named).withColumn("variety", F.round("variety", 9))


@query("e29_novelty", f"{_LATE} SELECT round(100 * sum(asked * least(m.d, 3) / 3) / sum(asked), 8) AS novelty FROM near")
def novelty(s, d):
    late, seen = _late_and_seen(s, d)
    asked = late.groupBy("roster").agg(F.count("*").alias("times"), F.min("team_id").alias("team_id"))
    found = scoring.nearest_observed(asked.select("team_id", "roster"), seen).select("team_id", "delta").join(asked, "team_id")
    return scoring.novelty(found.withColumnRenamed("times", "n")).select(F.round("novelty", 8).alias("novelty"))


@query("e29_novelty_all", f"{_NEAR_ALL} SELECT round(100 * sum(rr.n * least(delta, 3) / 3) / sum(rr.n), 8) AS novelty FROM rr JOIN best USING (id)")
def novelty_all(s, d):
    """All teams against all rosters; each finds its own at least, so this is 0 on any table."""
    counts = rosters(species_members(s, d)).groupBy("roster").agg(F.count("*").alias("n"), F.min("team_id").alias("team_id"))
    found = scoring.nearest_observed(counts.select("team_id", "roster"), counts).select("team_id", "delta")
    return scoring.novelty(found.join(counts, "team_id")).select(F.round("novelty", 8).alias("novelty"))


@query(
    "e30_corpus_percentile",
    """, v AS (SELECT team_id, round(popularity + coherence, 6) AS score FROM sc), g AS (SELECT score, count(*) AS w FROM v GROUP BY score),
       p AS (SELECT score, 100.0::DOUBLE * (sum(w) OVER (ORDER BY score) - w / 2) / (SELECT count(*) FROM v) AS pct FROM g)
       SELECT team_id, score, round(pct, 7) AS percentile FROM v JOIN p USING (score)""",
)
def corpus_percentile(s, d):
    scored = _scores(s, d).select("team_id", F.round("score", 6).alias("score"), F.lit(1).alias("w"))
    return scoring.weighted_percentiles(scored, "score", "w").select("team_id", "score", F.round("percentile", 7).alias("percentile"))


@query("e31_feature_ranks", "SELECT feature, CAST(rank() OVER (ORDER BY round(h, 12) DESC) AS INTEGER) AS rank_h, CAST(rank() OVER (ORDER BY round(m, 12) DESC) AS INTEGER) AS rank_m FROM fld")
def feature_ranks(s, d):
    return scoring.feature_ranks(_model(s, d)[0])


@query(
    "e33_pair_ranking",
    """SELECT * FROM (SELECT i, j, round(coupling, 8) AS coupling, 'toward' AS side, CAST(row_number() OVER (ORDER BY round(coupling, 9) DESC, i, j) AS INTEGER) AS rank FROM cpl WHERE coupling > 0
       UNION ALL SELECT i, j, round(coupling, 8), 'away', CAST(row_number() OVER (ORDER BY round(coupling, 9), i, j) AS INTEGER) FROM cpl WHERE coupling < 0) WHERE rank <= 25""",
)
def pair_ranking(s, d):
    _, couplings = _model(s, d)
    value = F.round("coupling", 9)
    toward = couplings.where("coupling > 0").orderBy(F.desc(value), "i", "j").limit(25)
    away = couplings.where("coupling < 0").orderBy(value, "i", "j").limit(25)
    a = toward.withColumn("side", F.lit("toward")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "i", "j")))
    b = away.withColumn("side", F.lit("away")).withColumn("rank", F.row_number().over(Window.orderBy(value, "i", "j")))
    return a.unionByName(b).withColumn("coupling", F.round("coupling", 8))


_PAIRMODEL = """pmarg AS (SELECT feature, species, item, sum(w) / (SELECT sum(w) FROM wts) AS m FROM pmem JOIN wts USING (team_id) GROUP BY 1, 2, 3),
  ppr AS (SELECT x.team_id, x.feature AS i, y.feature AS j FROM pmem x JOIN pmem y ON x.team_id = y.team_id AND x.feature < y.feature),
  pcpl AS (SELECT p.i, p.j, ln(s / (SELECT sum(w) FROM wts) / (a.m * b.m)) AS coupling, a.species AS si, b.species AS sj, a.item AS ti, b.item AS tj, a.m AS mi, b.m AS mj
    FROM (SELECT i, j, count(*) AS n, sum(w) AS s FROM ppr JOIN wts USING (team_id) GROUP BY i, j) p
    JOIN pmarg a ON a.feature = p.i JOIN pmarg b ON b.feature = p.j WHERE n >= 10)"""


def _pair_model(s, d):
    members = pair_members(s, d)
    fields, couplings = corpus.log_odds_model(members.select("team_id", "feature"), _weights(s, d), SUPPORT)
    features = members.select("feature", "species", "item").distinct()
    return stash(fields, "pair-fields"), stash(couplings, "pair-couplings"), stash(features, "pair-features")


@query(
    "e34_structural_couplings",
    f""", {_PAIRMODEL}
       SELECT species_a, species_b, i, j, round(coupling, 8) AS coupling, CAST(k AS INTEGER) AS rank FROM (
         SELECT least(si, sj) AS species_a, greatest(si, sj) AS species_b, i, j, coupling,
           row_number() OVER (PARTITION BY least(si, sj), greatest(si, sj) ORDER BY round(abs(coupling), 12) DESC, i, j) AS k
         FROM pcpl WHERE si <> sj AND ti <> tj) WHERE k <= 8""",
)
def structural_couplings(s, d):
    _, couplings, features = _pair_model(s, d)
    return scoring.structural_couplings(couplings, features).withColumn("coupling", F.round("coupling", 8))


@query(
    "e35_graph_candidates",
    f""", {_PAIRMODEL}, t AS (SELECT feature FROM pmarg ORDER BY round(m, 12) DESC, feature LIMIT 60)
       SELECT i, j, round(coupling, 8) AS coupling FROM pcpl WHERE i IN (FROM t) AND j IN (FROM t) AND si <> sj AND ti <> tj AND abs(coupling) >= 0.05""",
)
def graph_candidates(s, d):
    fields, couplings, features = _pair_model(s, d)
    top = fields.orderBy(F.desc(F.round("m", 12)), "feature").limit(60).join(features, "feature")
    a = top.select(F.col("feature").alias("i"), F.col("species").alias("si"), F.col("item").alias("ti"))
    b = top.select(F.col("feature").alias("j"), F.col("species").alias("sj"), F.col("item").alias("tj"))
    edges = couplings.join(a, "i").join(b, "j").where(scoring.structural("si", "sj", "ti", "tj") & (F.abs("coupling") >= 0.05))
    return edges.select("i", "j", F.round("coupling", 8).alias("coupling"))


@query("e36_top_teams", "SELECT roster_key, n, CAST(row_number() OVER (ORDER BY n DESC, roster_key) AS INTEGER) AS rank FROM rcount ORDER BY n DESC, roster_key LIMIT 50")
def top_teams(s, d):
    return scoring.top_teams(corpus.roster_counts(species_members(s, d)), 50)


@query(
    "e38_observed_configurations",
    """, b AS (SELECT team_id, CAST(sum(DISTINCT 1 << (ascii(right(feature, 1)) - 49)) AS BIGINT) AS state FROM mem WHERE right(feature, 1) BETWEEN '1' AND '5' GROUP BY team_id)
       SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 9) AS share FROM b GROUP BY state""",
)
def observed_configurations(s, d):
    members = species_members(s, d).where(F.substring("feature", -1, 1).between("1", "5"))
    keys = members.select("team_id", F.expr("shiftleft(1L, ascii(substring(feature, -1, 1)) - 49)").alias("b")).groupBy("team_id").agg(F.bit_or("b").alias("state"))
    total = keys.agg(F.count("*").alias("t"))
    return keys.groupBy("state").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("state", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("e39_threshold_edges", "SELECT i, j, round(coupling, 8) AS coupling FROM cpl WHERE coupling < 0 AND abs(coupling) >= 0.02")
def threshold_edges(s, d):
    return _model(s, d)[1].where((F.col("coupling") < 0) & (F.abs("coupling") >= 0.02)).select("i", "j", F.round("coupling", 8).alias("coupling"))
