"""Pastes, slugs, tokens, stored models, votes and pinned sites on hand-made cases."""

import numpy as np
import pytest
from lineupkit.operators import artifacts, completion, fit, ingest, names, pastes
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_species_slugs(spark):
    cases = {
        "Alolan Ninetales": "ninetales-alola", "Wash Rotom": "rotom-wash", "Lycanroc Midday": "lycanroc", "Lycanroc Dusk": "lycanroc-dusk", "Ho-Oh": "hooh",
        "Farfetch'd": "farfetchd", "Mr. Mime": "mrmime", "Urshifu-Rapid-Strike": "urshifu-rapidstrike", "Eternal Flower Floette": "floette",
        "Paldean Tauros Aqua Breed": "tauros-paldeaaqua", "Galarian Mr. Mime": "mrmime-galar", "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "x string, y string").select("y", names.species_slug(F.col("x")).alias("got")).collect()
    assert [r.got for r in rows] == [r.y for r in rows]


def test_parse(spark):
    text = "\n\nBob (Charizard-Mega-Y) (M) @ Charizardite Y\nAbility: x @ y\n \nFloette-Eternal\n\n(F)\n\n\nA (b) (Rotom-Wash) @ a @ Focus Sash"
    got = [tuple(m) for m in one(spark, pastes.parse, text)]
    assert got == [
        ("Charizard-Mega-Y", "Charizardite Y", "charizard", "charizardite-y"), ("Floette-Eternal", None, "floette", None),
        ("A (b) (Rotom-Wash) @ a", "Focus Sash", "abrotom-washa", "focus-sash"),
    ]
    assert one(spark, pastes.parse, "") == [] and one(spark, pastes.parse, None) is None


VOCAB = [("Aa @ X", "Aa", "X", 0.5), ("Aa @ Y", "Aa", "Y", 0.2), ("Bb @ X", "Bb", "X", 0.3), ("Cc @ None", "Cc", None, 0.1)]


def test_match(spark):
    vocab = spark.createDataFrame(VOCAB, "feature string, species string, item string, m double")
    texts = [(1, "Aa @ Y\n\nBb\n\nAa\n\nCc"), (2, "Aa\n\nBb @ X\n\nBb @ Z\n\nQq"), (3, ""), (4, "Qq @ X"), (5, None)]
    rows = {r.paste_id: r for r in pastes.match(spark.createDataFrame(texts, "paste_id long, text string"), vocab).collect()}
    assert rows[1].features == ["Aa @ Y", "Bb @ X", "Cc @ None"] and rows[1].warnings == [] and rows[1].error is None
    assert rows[2].features == ["Aa @ X"] and len(rows[2].warnings) == 3 and rows[2].warnings[0] == "Bb also holds X (Aa has it), so it was skipped."
    assert rows[2].warnings[1:] == ["Bb @ Z is not in this model, so it was skipped.", "Qq is not in this model, so it was skipped."]
    assert rows[3].error == rows[5].error == "The paste is empty." and rows[4].error == "Nothing of the paste matched this model."


def test_tokens(spark):
    cases = {"si.3.aa~x_bb": ("reg-m-a", [("aa", "x"), ("bb", None)]), "m.": ("m", []), "m": None, "M.aa": None, "m.aa~none__": ("m", [("aa", "none")])}
    for token, want in cases.items():
        got = one(spark, pastes.read_token, token)
        assert (None if got is None else (got.model_id, [tuple(m) for m in got.mons])) == want


def test_models_on_disk(spark, tmp_path):
    fields = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.4), ("c", 0.3, 0.3)], "feature string, h double, m double")
    couplings = spark.createDataFrame([("a", "b", 0.5), ("b", "c", -1.5)], "i string, j string, coupling double")
    tables = {"fields": fields, "couplings": couplings, "team_counts": spark.createDataFrame([("a-b", 2)], "roster_key string, n long")}
    path = str(tmp_path / "m1")
    artifacts.write_model(tables, path, {"id": "m1", "type": "t"})
    assert artifacts.read_model(spark, path)["couplings"].count() == 4
    with pytest.raises(Exception, match="exists"):
        artifacts.write_model(tables, path, {"id": "m1"})
    artifacts.write_model(tables, path, {"id": "m1"}, force=True)
    artifacts.write_model(tables, str(tmp_path / "m0"), {"id": "m0"})
    metas = artifacts.read_meta(spark, f"{tmp_path}/*")
    order = lambda *x: [r.id for r in artifacts.manifest(metas, *x).collect()]
    assert order("m1") == ["m1", "m0"] and order("other") == ["m0", "m1"] and order("m0", "m1") == ["m1", "m0"]
    with pytest.raises(Exception, match="no model mx"):
        order("m0", "mx")
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, feature_id int")
    packed = artifacts.pack_triangle(couplings, ids)
    assert {tuple(r) for r in packed.collect()} == {(0, 0.5), (2, -1.5)}
    assert {tuple(r) for r in artifacts.unpack_triangle(packed, ids).collect()} == {("a", "b", 0.5), ("b", "c", -1.5)}
    with pytest.raises(Exception, match="beyond"):
        artifacts.unpack_triangle(spark.createDataFrame([(3, 1.0)], "position long, value float"), ids).collect()


def test_votes_and_prefix_fits(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = ["".join(map(str, r)) for r in rng.integers(0, 2, (60, 3))]
    (tmp_path / "v.txt").write_text("\n\n".join(rows) + "\n")
    votes = ingest.read_votes(spark, str(tmp_path / "v.txt"), ["a", "b", "c"])
    got = {(r.row_no, r.feature): r.vote for r in votes.collect()}
    assert got == {(k + 1, f): int(row[p]) for k, row in enumerate(rows) for p, f in enumerate("abc")}
    members = votes.where("vote = 1").select(F.col("row_no").alias("team_id"), "feature")
    cases = votes.select(F.col("row_no").alias("team_id")).distinct()
    fits = fit.prefix_fits(members, cases, [30, None])
    own = fit.build_model(members.where("team_id <= 30"), cases.where("team_id <= 30").withColumn("w", F.lit(1.0)), 1)["couplings"]
    assert {(r.i, r.j): round(r.coupling, 6) for r in fits.where("n_used = 30").collect()} == {(r.i, r.j): round(r.coupling, 6) for r in own.collect()}
    assert fits.where("n_used = -1").count() == 3
    (tmp_path / "w.txt").write_text("101\n10\n")
    with pytest.raises(Exception, match="3 digits"):
        ingest.read_votes(spark, str(tmp_path / "w.txt"), ["a", "b", "c"]).collect()


def test_sites(spark):
    model = completion.Model(["a1", "a2", "b1", "b2", "c1"], np.zeros(5), np.zeros((5, 5)), np.array([0.5, 0.4, 0.6, 0.6, 0.1]), np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 1, -1]))
    sites = spark.createDataFrame([(1, "a2"), (1, "b2"), (2, "a1"), (3, "b1"), (4, "a1"), (4, "b1")], "team_id long, feature string")
    pins = spark.createDataFrame([(2, "a2"), (3, "a1")], "team_id long, feature string")
    found = {}
    for r in completion.resolve_sites(sites, model, pins, ["b2"]).collect():
        found.setdefault(r.team_id, []).append(r.feature)
    # Team 1: a1 takes item 0, so b1 is barred and b2 excluded; team 2: the site is taken; team 3: b1 clashes with a1.
    assert found == {1: [None], 2: [None], 3: [None], 4: [None]}
    free = completion.resolve_sites(sites.where("team_id = 1"), model).collect()
    assert [r.feature for r in free] == ["a1", "b2"]


def test_each_text_is_parsed_once(spark):
    texts = spark.createDataFrame([(1, "A @ B\n\nC (M)"), (2, ""), (3, None)], "paste_id long, text string")
    rows = pastes.parsed_mons(texts)
    assert sorted(((r.paste_id, r.pos, r.species, r.item) for r in rows.collect()), key=str) == [(1, 0, "A", "B"), (1, 1, "C", None), (2, None, None, None), (3, None, None, None)]
    vocab = spark.createDataFrame([("A @ B", "A", "B", 0.5)], "feature string, species string, item string, m double")
    for df in (rows.where("pos IS NOT NULL"), pastes.match(texts, vocab)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?iU)") == 1  # the gender mark's pattern
