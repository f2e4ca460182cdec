"""Registered queries on the structure of couplings: communities, linkage, embeddings and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.operators import corpus, factors, graphs
from lineupkit.plans import corpus_queries as base
from lineupkit.runtime import local_table, stash
from lineupkit.sources.domain import MEMBERS_SQL, pair_members

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


def _items(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The closed-form model on (species, item) features: fields and couplings of pairs that two teams hold."""
    return corpus.log_odds_model(pair_members(s, d).select("team_id", "feature"), base._weights(s, d), 2)


def _signed(s: SparkSession, d: str, positive: bool) -> DataFrame:
    """Edges of one sign; the negative ones above their median, as the whole graph would be nearly complete."""
    couplings = _items(s, d)[1]
    if positive:
        return couplings.where("coupling > 0").select("i", "j", F.col("coupling").alias("weight"))
    below = couplings.where("coupling < 0").select("i", "j", (-F.col("coupling")).alias("weight"))
    cut = below.agg(F.percentile("weight", F.lit(0.5)).alias("cut_"))
    return below.crossJoin(F.broadcast(cut)).where("weight > cut_").select("i", "j", "weight")


def _communities(s: SparkSession, d: str) -> list[tuple[str, DataFrame, list[float]]]:
    return [(sign, *graphs.communities(_signed(s, d, sign == "positive"), least_gain=0.002, max_rounds=8)) for sign in ("positive", "negative")]


@query("g29_communities")
def communities(s, d):
    """Communities of the positive and of the negative graph of features, with the graph's modularity."""
    parts = [m.select(F.lit(sign).alias("sign"), F.col("node").alias("feature"), "community", F.lit(q[-1] if q else 0.0).alias("modularity")) for sign, m, q in _communities(s, d)]
    return parts[0].unionByName(parts[1])


def _linkage(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graphs.average_linkage(graphs.profile_distances(_items(s, d)[1]))


@query("g30_linkage")
def linkage(s, d):
    """Merges of the features' coupling profiles by average linkage."""
    return _linkage(s, d)[0].withColumn("height", F.round("height", 9))


@query("g30_leaf_order")
def leaf_order(s, d):
    return _linkage(s, d)[1].withColumnRenamed("node", "feature")


@query("g30_ego_networks", """, rk AS (SELECT i, j, coupling, row_number() OVER (PARTITION BY i, coupling > 0 ORDER BY round(abs(coupling), 12) DESC, j) AS rank FROM csym WHERE coupling <> 0),
 sp AS (SELECT i AS ego, j AS partner, coupling FROM rk WHERE rank <= 3)
 SELECT ego, ego AS i, partner AS j, round(coupling, 8) AS coupling, true AS spoke FROM sp
 UNION ALL SELECT a.ego, c.i, c.j, round(c.coupling, 8), false FROM cpl c JOIN sp a ON a.partner = c.i JOIN sp b ON b.partner = c.j AND b.ego = a.ego WHERE c.coupling <> 0""")
def ego_networks(s, d):
    """Every species with its three strongest partners of either sign and the couplings among them."""
    return graphs.ego_network(base._model(s, d)[1], 3, 3).withColumn("coupling", F.round("coupling", 8))


def _ppmi(s: SparkSession, d: str) -> DataFrame:
    """(i, j, x): PPMI of the (species, item) features."""
    counts = corpus.cooccurrence(pair_members(s, d).select("team_id", "feature"))
    return corpus.shifted_ppmi(counts).select("i", "j", F.col("ppmi").alias("x")).where("x > 0")


def _embedded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = stash(_ppmi(s, d), "ppmi")
    return pairs, factors.spectral_embedding(pairs, 12, rounds=12, tol=1e-6)[0]


@query("g27_embedding")
def embedding(s, d):
    """Twelve dimensions of the PPMI table: every feature's place, of length 1."""
    return _embedded(s, d)[1].select("feature", F.posexplode("embedding").alias("component", "x"))


@query("g27_neighbours")
def neighbours(s, d):
    """Every feature's eight nearest by cosine."""
    both = corpus.mirrored(factors.similarities(_embedded(s, d)[1]), "sim")
    order = Window.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), "j")
    return both.withColumn("rank", F.row_number().over(order)).where("rank <= 8")


def _residuals(s: SparkSession, d: str) -> DataFrame:
    pairs, embedded = _embedded(s, d)
    return factors.role_residuals(factors.similarities(embedded), pairs)


@query("g27_role_residuals")
def role_residuals(s, d):
    """The twenty pairs most alike that do not stand together."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "i", "j")
    top = _residuals(s, d).orderBy(F.desc(F.round("score", 9)), "i", "j").limit(20)
    return top.withColumn("rank", F.row_number().over(order))


@query("g27_isolated")
def isolated(s, d):
    """The 25 features whose closest substitute is farthest, with their usage."""
    m = corpus.marginals(pair_members(s, d).select("team_id", "feature"), base._weights(s, d))
    return factors.closest_substitutes(_residuals(s, d)).join(m, "feature").orderBy(F.round("score", 9), "feature").limit(25)


@query("g28_factors")
def nonnegative_factors(s, d):
    """Five additive components of the PPMI table."""
    return factors.nonnegative_factors(_ppmi(s, d), [5], rounds=12)[0]


@query("g28_rank_sweep")
def rank_sweep(s, d):
    """Error and symmetry by rank, all ranks in one run."""
    history = factors.nonnegative_factors(_ppmi(s, d), [3, 5, 7, 10], rounds=12)[1]
    last = {x["k"]: x for x in history}
    rows = [(k, x["round"], x["error"], x["correlation"]) for k, x in last.items()]
    return local_table(s, rows, "k long, round long, error double, correlation double")


@query("d5_gaussian_couplings")
def gaussian_couplings(s, d):
    """Couplings as minus the inverse of the features' regularised correlations."""
    members = pair_members(s, d).select("team_id", "feature")
    moments = corpus.empirical_moments(members, base._weights(s, d))
    m = stash(moments.where("i = j").select(F.col("i").alias("feature"), F.col("p").alias("m")), "moments")
    every = m.toDF("i", "mi").join(m.toDF("j", "mj"), F.col("i") < F.col("j"))  # pairs of a vocabulary
    full = every.join(moments.where("i < j"), ["i", "j"], "left").fillna(0.0, ["p"])
    return factors.gaussian_couplings(corpus.binary_correlation(full), 0.05)[0]
