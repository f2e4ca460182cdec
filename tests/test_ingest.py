"""Files of standings to documents, the cache and back, and the rules on names that the tables do not reach."""

import json

import pytest
from lineupkit.operators import corpus, ingest, names, usage
from pyspark.sql import functions as F

SIX = ["Mega Charizard Y", "floette", "Arcanine [Hisuian Form]", "Tauros [Paldean Form - Blaze Breed]", "Rotom [Wash Rotom]", "farfetch'd"]


def deck(items=("Charizardite Y", "none", "King’s Rock", "covert cloak", None, " Sitrus  berry "), species=SIX):
    return [{"name": s, "item": i, "attacks": ["Protect", "Tackle"]} for s, i in zip(species, items, strict=True)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("local")
    (top / "M-A").mkdir()
    (top / "Z").mkdir()
    won, lost = {"name": "B", "result": "W"}, {"name": "A", "result": "L"}
    entries = [
        {"name": "A", "placing": 1, "record": {"wins": 5, "losses": 1}, "decklist": deck(), "rounds": {"1": won, "01": won, "2": {"name": "BYE", "result": "W"}, "x": won, "3": {"name": "B", "result": "L"}}},
        {"name": "C", "placing": "2", "decklist": deck()[:5], "rounds": {"1": {"name": "A", "result": "L"}}},
        {"name": "B", "placing": 3, "decklist": deck(), "rounds": {"1": lost, "01": lost, "x": lost, "3": {"name": "A", "result": "L"}}},
        {"name": "D", "placing": 4, "decklist": deck([None] * 6)}, {"name": "E", "decklist": deck(species=["Rotom"] * 6)}, {"name": "F"},
    ]
    (top / "M-A" / "cup_2024-05-06.json").write_text(json.dumps(entries))
    rows = [[1, None, None, None, "x", s, i, []] for s, i in zip(SIX, ["A", "B", "C", "D", "E", "F"], strict=True)]
    (top / "Z" / "sheet.json").write_text(json.dumps([{"n": "P", "d": "M", "#": "7", "tl": rows}, {"n": "Q", "d": "S", "#": "1", "tl": rows}, {"n": "R", "d": "M", "tl": rows}]))
    (top / "Z" / "broken.json").write_text("{not json")
    return top


def test_import_and_cache(spark, folder, tmp_path):
    cache = str(tmp_path / "cache")
    docs = ingest.import_in_person(spark, str(folder), cache)
    found = {r.meta.id: r for r in docs.collect()}
    assert set(found) == {"local_cup_2024-05-06", "local_sheet"}
    cup = found["local_cup_2024-05-06"]
    assert (cup.meta.date, cup.meta.regulation, cup.meta.players, cup.type, cup.version) == ("2024-05-06", "M-A", 6, "in-person", 3)
    assert cup.teams[0].members == [["Blaze", None]] or [m[0] for m in cup.teams[0].members] == ["Charizard", "Eternal Flower Floette", "Farfetch'd", "Hisuian Arcanine", "Paldean Tauros Blaze Breed", "Wash Rotom"]
    assert [m[1] for m in cup.teams[0].members] == ["Charizardite Y", None, "Sitrus Berry", "King's Rock", None, None]
    assert [(t.placing, t.record) for t in cup.teams] == [(1, [5, 1, 0]), (3, [0, 0, 0])] and cup.matches == [[1, 0, 1]]
    sheet = found["local_sheet"]
    assert [t.placing for t in sheet.teams] == [7, None] and sheet.meta.date == "" and sheet.matches == []
    back = ingest.read_cache(spark, cache, least=2)
    assert [r.meta.id for r in back.collect()] == ["local_sheet", "local_cup_2024-05-06"]
    assert ingest.read_cache(spark, cache, regulation="Z", least=2).count() == 1 and ingest.read_cache(spark, cache).count() == 0
    assert ingest.read_cache(spark, cache, kind="limitless", least=0).count() == 0
    assert ingest.cached(back, "local_sheet").count() == 1 and ingest.cached(back, "none").count() == 0
    assert ingest.observations(back).count() == 4
    match = ingest.match_observations(back).first()
    assert match["round"] == 1 and match.winner == match.loser and len(match.winner) == 6
    count = ingest.read_cache(spark, cache, least=0).count()
    twice = ingest.import_in_person(spark, str(folder), cache)
    assert twice.count() == 0 and ingest.read_cache(spark, cache, least=0).count() == count and docs.count() > 0
    again = ingest.import_in_person(spark, str(folder), str(tmp_path / "other"), back.select("meta.id"))
    assert again.count() == 0


def test_names(spark):
    cases = {
        "Vivillon [Family of Four]": "Vivillon", "Indeedee [Female]": "Indeedee ♀", "Basculegion [male]": "Basculegion", "Floette [Eternal Flower]": "Eternal Flower Floette",
        "Lycanroc [Dusk Form]": "Lycanroc Dusk", "Odd [Thing]": "Odd [thing]", "\ttapu KOKO\n": "Tapu Koko", "charizard-mega-y": "Charizard-Mega-Y", "Mega Lucario Z": "Lucario",
        "Mega Blastoise": "Blastoise", "Porygon Z": "Porygon Z", "Floette": "Eternal Flower Floette", " \t": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", names.species_name(F.col("raw")).alias("name"))
    assert {r.raw: r.name for r in df.collect()} == cases


def test_versions_and_rules(spark):
    df = spark.createDataFrame([(3, "in-person"), (2, "in-person"), (2, None), (None, None), (2, "limitless"), (9, "other")], "v int, t string")
    assert [r[0] for r in df.select(ingest.version_ok(F.col("v"), F.col("t"))).collect()] == [True, False, True, False, True, False]
    events = spark.createDataFrame([("a", "M-B", "2026-09-09T10:00"), ("b", "M-B", "2026-09-08"), ("c", "M-A", "2026-10-01"), ("d", "CUSTOM", "2026-10-01")], "tournament_id string, regulation string, date string")
    teams = spark.createDataFrame([(t, [("Salamence", None)]) for t in "abc"] + [("d", [("Other", "x")])], "tournament_id string, members array<struct<species:string,item:string>>")
    assert dict(ingest.relabelled(events, teams).select("tournament_id", "regulation").collect()) == {"a": "M-C", "b": "M-B", "c": "M-A", "d": "CUSTOM"}
    could = events.select("tournament_id", ingest.could_match(F.col("regulation"), F.col("date"), "M-C"), ingest.pending_relabel(F.col("regulation"), F.col("date"))).collect()
    assert [tuple(r) for r in could] == [("a", True, True), ("b", False, False), ("c", False, False), ("d", True, True)]


def test_bad_counts_and_weights(spark):
    with pytest.raises(Exception, match="negative"):
        corpus.shifted_ppmi(spark.createDataFrame([("a", "b", -1), ("a", "c", 5)], "i string, j string, n long")).collect()
    with pytest.raises(ValueError):
        corpus.team_weights(spark.createDataFrame([(1, None, True)], "team_id long, day date, in_person boolean"), 0.0)


def test_usage_report(spark, tmp_path):
    data = {"A": {"usage": 0.5, "Teammates": {"B": 2.5, "Z": 1.0}}, "B": {"usage": 0.7, "Teammates": {"A": 2.5}}, "C": {"usage": 0.1, "Teammates": {}}}
    (tmp_path / "u.json").write_text(json.dumps({"info": {"metagame": "m", "cutoff": 1760, "number of battles": 9}, "data": data}))
    rows = usage.read_usage(spark, str(tmp_path / "u.json"))
    assert {(r.metagame, r.cutoff, r.battles) for r in rows.collect()} == {("m", 1760, 9)}
    vocab = usage.usage_vocabulary(rows, 0.2)
    assert [r.name for r in vocab.collect()] == ["B", "A"]
    assert {tuple(r) for r in usage.usage_cooccurrence(rows, vocab).collect()} == {("A", "B", 2.5), ("B", "A", 2.5)}


def test_documents_parse_their_entries_once(spark, monkeypatch):
    from conftest import SF
    from lineupkit.plans import ingest_queries

    calls, members_of = [], ingest.members_of
    monkeypatch.setattr(ingest, "members_of", lambda *a: calls.append(1) or members_of(*a))
    docs = ingest_queries._documents(spark, SF)
    assert len(calls) == 1
    assert "decklist" not in docs._jdf.queryExecution().optimizedPlan().toString()
