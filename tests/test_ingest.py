import pytest
from pyspark.sql import functions as F

from innings.functions import scalars as S
from innings.sources import ingest, raw, tables


@pytest.mark.parametrize("old,new", [
    ("Deccan Chargers", "Sunrisers Hyderabad"), ("Delhi Daredevils", "Delhi Capitals"), ("Kings XI Punjab", "Punjab Kings"),
    ("Royal Challengers Bangalore", "Royal Challengers Bengaluru"), ("Unknown XI", "Unknown XI"),
])
def test_team_names(spark, old, new):
    df = spark.createDataFrame([(old, old, old)], "team1 string, team2 string, winner string")
    assert tuple(S.normalise_teams(df, ["team1", "team2", "winner", "absent"]).first()) == (new, new, new)


@pytest.mark.parametrize("runs,extras,dismissal,label", [
    (0, 0, "bowled", "pressure_error"), (6, 0, "caught", "pressure_error"), (4, 0, None, "aggressive"),
    (6, 0, None, "aggressive"), (0, 0, None, "defensive"), (1, 0, None, "neutral"), (3, 0, None, "neutral"),
    (0, 1, None, "neutral"),
])
def test_labels(spark, runs, extras, dismissal, label):
    df = spark.createDataFrame([(runs, extras, dismissal)], "batsman_runs int, extra_runs int, dismissal_kind string")
    assert df.select(S.intent_label()).first()[0] == label


def test_coercion(spark):
    df = spark.createDataFrame([("3",), ("2.9",), ("-2.9",), ("x",), (None,), ("nan",), ("1e99",)], "v string")
    assert [r[0] for r in df.select(S.to_int0(F.col("v"))).collect()] == [3, 2, -2, 0, 0, 0, 0]
    dates = spark.createDataFrame([("2024-03-22",), ("22/03/2024",), ("soon",), (None,)], "date string")
    assert [r["season"] for r in S.with_season(dates).collect()] == [2024, 2024, None, None]


def test_exact_ratio(spark):
    df = spark.createDataFrame([(97, 80), (1, 8), (0, 0), (201, 200)], "a long, b long")
    assert [r[0] for r in df.select(S.ratio(F.col("a"), F.col("b"), 6)).collect()] == [7.28, 0.75, None, 6.03]
    assert [r[0] for r in df.select(S.ratio(F.col("a"), F.col("b"))).collect()] == [1.21, 0.13, None, 1.01]


@pytest.fixture()
def folder(tmp_path):
    main = tmp_path / "main"
    main.mkdir()
    (main / "matches_a.csv").write_text(
        "id,date,team1,team2,winner,toss_winner,toss_decision,venue,win_by_runs\n"
        "1,2019-04-01,Delhi Daredevils,Mumbai Indians,Delhi Daredevils,Mumbai Indians,field,Ground A,12\n"
        "2,bad,Deccan Chargers,Mumbai Indians,NA,Mumbai Indians,bat,Ground B,x\n"
        "1,2019-04-02,Delhi Daredevils,Mumbai Indians,Mumbai Indians,Mumbai Indians,field,Ground A,9\n")
    (main / "deliveries_a.csv").write_text(
        "id,inning,over,ball,batsman,bowler,non_striker,batsman_runs,extra_runs,total_runs,dismissal_kind,player_dismissed,"
        "batting_team,bowling_team,surprise\n"
        "1,1,0,1,P One,Q One,P Two,4,0,4,,,Delhi Daredevils,Mumbai Indians,z\n"
        "1,1,0,2,P One,Q One,P Two,0,0,0,NA,NA,Delhi Daredevils,Mumbai Indians,z\n"
        "1,1,5,3,P One,Q One,P Two,abc,1,1,,,Delhi Daredevils,Mumbai Indians,z\n"
        "1,1,18,4,P Two,Q One,P One,6,0,6,caught,P Two,Delhi Daredevils,Mumbai Indians,z\n")
    games = tmp_path / "games"
    games.mkdir()
    head = "match_id,season,start_date,venue,innings,ball,batting_team,bowling_team,striker,non_striker,bowler,runs_off_bat,extras,wicket_type\n"
    (games / "9001.csv").write_text(
        head + '9001,2022,2022-05-01,"Ground, C",1,0.1,Kings XI Punjab,Mumbai Indians,S One,S Two,T One,4,0,\n'
        + '9001,2022,2022-05-01,"Ground, C",1,0.2,Kings XI Punjab,Mumbai Indians,S One,S Two,T One,0,1,\n'
        + '9001,2022,2022-05-01,"Ground, C",2,3.6,Mumbai Indians,Kings XI Punjab,T One,T Two,S One,0,0,bowled\n')
    (games / "9001_info.csv").write_text("version,2.1\ninfo,winner,Mumbai Indians\ninfo,toss_winner,Kings XI Punjab\n"
                                         "info,toss_decision,bat\ninfo,umpire,Some One\ninfo,city,Here, There\n")
    (games / "9000.csv").write_text(
        "info,winner,Mumbai Indians\n" + head
        + "9000,2020,2020-05-01,Ground D,1,0.1,Mumbai Indians,Punjab Kings,S One,S Two,T One,1,0,\n")
    (games / "8999.csv").write_text("innings,ball,batting_team\n1,0.1,Mumbai Indians\n")
    return tmp_path


def test_match_files(spark, folder):
    balls = raw.read_match_files(spark, str(folder / "games"))
    got = {r["match_id"]: r for r in balls.groupBy("match_id").agg(
        F.count("*").alias("n"), F.first("winner").alias("winner"), F.first("city").alias("city"), F.first("venue").alias("venue")
    ).collect()}
    assert set(got) == {"9000", "9001"}
    assert (got["9001"]["n"], got["9001"]["winner"], got["9001"]["city"], got["9001"]["venue"]) == (
        3, "Mumbai Indians", "Here, There", "Ground, C")
    assert (got["9000"]["n"], got["9000"]["winner"], got["9000"]["city"]) == (1, "Mumbai Indians", None)


def test_ingest_of_both_sources(spark, folder):
    matches, balls = ingest.ingest(spark, str(folder / "main"), str(folder / "games"))
    m = {r["id"]: r for r in matches.collect()}
    assert set(m) == {1, 2, 9001}
    assert (m[1]["winner"], m[1]["win_by_runs"], m[1]["team1"], m[1]["season"]) == ("Mumbai Indians", 9, "Delhi Capitals", 2019)
    assert (m[2]["winner"], m[2]["win_by_runs"], m[2]["season"]) == (None, 0, None)
    assert (m[9001]["team1"], m[9001]["team2"], m[9001]["season"]) == ("Punjab Kings", "Mumbai Indians", 2022)
    b = {(r["match_id"], r["inning"], r["over"], r["ball"]): r for r in balls.collect()}
    assert len(b) == 7
    assert b[(1, 1, 0, 2)]["intent"] == "defensive" and b[(1, 1, 0, 2)]["dismissal_kind"] is None
    assert (b[(1, 1, 5, 3)]["batsman_runs"], b[(1, 1, 5, 3)]["intent"], b[(1, 1, 5, 3)]["season"]) == (0, "neutral", 2019)
    assert (b[(1, 1, 18, 4)]["intent"], b[(1, 1, 18, 4)]["phase"]) == ("pressure_error", "death")
    late = b[(9001, 2, 3, 6)]
    assert (late["batter"], late["total_runs"], late["intent"], late["season"]) == ("T One", 0, "pressure_error", 2022)
    assert b[(9001, 1, 0, 2)]["total_runs"] == 1


def test_build_writes_known_columns(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    dropped = ingest.build(spark, str(folder / "main"), out, str(folder / "games"))
    assert "surprise" in dropped["deliveries"]
    stored = tables.load_table(spark, f"{out}/deliveries", "deliveries")
    assert stored.count() == 7 and stored.filter("season = 2022").count() == 3
    assert tables.load_table(spark, f"{out}/matches", "matches").count() == 3
    ingest.build(spark, str(folder / "main"), out, str(folder / "games"))
    assert tables.load_table(spark, f"{out}/deliveries", "deliveries").count() == 7


def test_lines_of_match_files_are_parsed_once(spark, folder):
    """What is read several times lies in a stored table: no plan goes back to the text of the match files."""
    for df in ingest.ingest(spark, str(folder / "main"), str(folder / "games")):
        assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, f"{tmp_path}/*matches*.csv", "match")
    assert not raw.require_columns(spark.range(1), ["innings"])


def test_reload_drops_vanished_seasons_and_keeps_types(spark, tmp_path):
    """Extras arrive as text with decimals; a second load leaves nothing of the first."""
    raw_dir, out = tmp_path / "raw", str(tmp_path / "out")
    raw_dir.mkdir()
    (raw_dir / "matches.csv").write_text("id,date,team1,team2\n1,2001-04-01,A,B\n2,2002-04-01,A,B\n")
    head = "match_id,inning,over,ball,batter,bowler,batsman_runs,extra_runs,wides,noballs,byes,legbyes,penalty\n"
    (raw_dir / "deliveries.csv").write_text(head + "1,1,0,1,P,Q,1,1,1,,,,\n2,1,0,1,P,Q,0,2,1.0,0,x,1,\n2,1,0,2,P,Q,4,0,,,,,\n")
    ingest.build(spark, str(raw_dir), out)
    got = tables.load_table(spark, f"{out}/deliveries", "deliveries").orderBy("match_id", "seq").collect()
    assert [(r["match_id"], r["seq"], r["wides"], r["byes"], r["legbyes"]) for r in got] == [
        (1, 1, 1, None, None), (2, 1, 1, None, 1), (2, 2, None, None, None)]
    (raw_dir / "matches.csv").write_text("id,date,team1,team2\n2,2002-04-01,A,B\n")
    (raw_dir / "deliveries.csv").write_text(head + "2,1,0,1,P,Q,0,2,1,0,0,1,\n")
    ingest.build(spark, str(raw_dir), out)
    assert [r["season"] for r in tables.load_table(spark, f"{out}/deliveries", "deliveries").collect()] == [2002]
    assert tables.load_table(spark, f"{out}/matches", "matches").count() == 1


def test_many_layouts_and_equal_file_names(spark, tmp_path):
    for i in range(150):
        folder = tmp_path / "games" / f"y{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        name = folder / f"{i // 3}.csv"  # every name occurs in three folders
        name.write_text(f"match_id,innings,ball,batting_team,bowling_team,striker,own{i}\n{i},1,0.1,A,B,S{i},v{i}\n")
        (folder / f"{i // 3}_info.csv").write_text(f"info,winner,W{i}\n")
    got = {r["match_id"]: r for r in raw.read_match_files(spark, str(tmp_path / "games")).collect()}
    assert len(got) == 150
    assert all((r["striker"], r["winner"], r[f"own{i}"]) == (f"S{i}", f"W{i}", f"v{i}") for i, r in got.items())


def test_many_sources_are_numbered_per_match(spark, tmp_path):
    (tmp_path / "matches.csv").write_text("id,date\n1,2001-04-01\n")
    for i in range(130):
        (tmp_path / f"deliveries_{i:03d}.csv").write_text(f"match_id,inning,over,ball,batter\n1,1,0,{i},B{i}\n{i + 5},1,0,1,X\n")
    _, balls = ingest.ingest(spark, str(tmp_path))
    rows = balls.where("match_id = 1 and batter <> 'X'").select("seq", "batter").collect()
    assert {r["batter"]: r["seq"] for r in rows} == {f"B{i}": i + 1 for i in range(130)}
