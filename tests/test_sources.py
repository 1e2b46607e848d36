"""Files in and out, logs, manual tables, streams."""

import hashlib
import json

import pytest
from games import matches, plain_elo
from pyspark.sql import functions as F

from fixtura.shared import DataError, SchemaError
from fixtura.sources import adapters, delimited, limits, logs, manual, sinks
from fixtura.streaming import results


def test_csv_keeps_text_and_provenance(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿date,score\n2020-01-01,00\n,\"\"\n", encoding="utf-8")
    rows = delimited.numbered(delimited.scan(spark, str(tmp_path / "r.csv"), ["date", "score"])).collect()
    assert [(r.date, r.score, r.source_file, r.source_row) for r in rows] == [("2020-01-01", "00", "r.csv", 2), ("", "", "r.csv", 3)]
    with pytest.raises(SchemaError):
        delimited.scan(spark, str(tmp_path / "r.csv"), ["nothing"])


def test_csv_column_map_and_optional(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,x\n")
    mapped = delimited.scan(spark, str(tmp_path / "r.csv"), columns={"a": "id", "zz": "other"}).drop("source_file").collect()
    assert [tuple(r) for r in mapped] == [("1", None)]
    made = delimited.optional(spark, str(tmp_path / "r.csv"), "a int, b string, c double")
    assert [tuple(r) for r in made.collect()] == [(1, "x", None)]
    assert delimited.optional(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        delimited.optional(spark, str(tmp_path / "none.csv"), "a int", required=True)


def test_folder_tables(spark, tmp_path):
    import gzip

    (tmp_path / "p.csv.gz").write_bytes(gzip.compress(b"id,name\n1,a\n2,b\n"))
    assert delimited.table_names(spark, str(tmp_path)) == ["p"]
    assert [tuple(r) for r in delimited.read_table(spark, str(tmp_path), "p", ["name"], 1).collect()] == [("a",)]
    (row,) = delimited.file_hashes(spark, str(tmp_path)).collect()
    assert row.sha256 == hashlib.sha256((tmp_path / "p.csv.gz").read_bytes()).hexdigest()


def test_log_appends_and_verifies(spark):
    new = lambda *ids: spark.createDataFrame([(i, f"f{i}", "m", json.dumps({"fixture_id": f"f{i}", "model_version": "m"})) for i in ids], "order int, fixture_id string, model_version string, payload string")
    empty = spark.createDataFrame([], logs.CHAIN)
    one = logs.append(empty, new(1, 2), ["fixture_id", "model_version"])
    both = one.union(logs.append(one, new(3), ["fixture_id", "model_version"]))
    assert logs.broken(both).count() == 0 and logs.tail(both)[0] == 2
    with pytest.raises(DataError):
        logs.append(both, new(2), ["fixture_id", "model_version"])
    edited = both.withColumn("payload", F.when(F.col("seq") == 1, "{}").otherwise(F.col("payload")))
    assert [(r.seq, r.problem) for r in logs.broken(edited).collect()] == [(1, "payload")]
    assert logs.find_by_prefix(both, "f2").count() == 1 and logs.find_by_prefix(both, "f").count() == 0
    assert len(logs.log_hash(both)) == 64


def test_result_rules(spark):
    known = spark.createDataFrame([("f1", "h1")], "fixture_id string, entry_hash string")
    schema = "fixture_id string, home_goals int, away_goals int, completed_at string, kickoff_date string, corrects string, reason string"
    rows = spark.createDataFrame([("f2", 1, 0, "2026-06-12 20:00:00", "2026-06-12", None, None), ("f1", 1, 0, "2026-06-12 20:00:00", "2026-06-12", None, None), ("f1", 2, 0, "2026-06-12 20:00:00", "2026-06-12", "h1", "typo")], schema).withColumn("kickoff_date", F.col("kickoff_date").cast("date"))
    assert [r.refused for r in logs.check_results(rows, known).orderBy("home_goals", "fixture_id").collect()] == ["result_exists", None, None]
    with pytest.raises(DataError):
        logs.accept(logs.check_results(rows, known))


def test_tables_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(spark.range(4), path)
    sinks.write_table(spark.range(4), path, force=True)
    assert spark.read.parquet(path).count() == 4
    sinks.write_manifest(spark, {"a": 1}, str(tmp_path / "m"))
    sinks.write_manifest(spark, {"a": 1}, str(tmp_path / "m"))
    with pytest.raises(DataError):
        sinks.write_manifest(spark, {"a": 2}, str(tmp_path / "m"))
    assert sinks.content_hash(spark.range(5)) == sinks.content_hash(spark.range(5).orderBy(F.desc("id"))) != sinks.content_hash(spark.range(6))
    assert len(sinks.version_of({"x": 1})) == 16


def test_manual_tables(spark, tmp_path):
    (tmp_path / "penalties.example.csv").write_text("team,penalty_strength\nA,60\n")
    assert manual.load(spark, str(tmp_path), "penalties").first().penalty_strength == 60
    assert manual.load(spark, str(tmp_path), "recent_form").count() == 0
    experts = spark.createDataFrame([("m", "a", "b", 0.5, 0.3, 0.2, None, None), ("m", "a", "b", 0.9, 0.3, 0.2, None, None), ("", "a", "b", None, None, None, 0.6, 0.4), ("x", "a", "b", None, None, None, None, None)], "match_id string, team_a string, team_b string, team_a_win_prob double, draw_prob double, team_b_win_prob double, team_a_advance_prob double, team_b_advance_prob double")
    good, bad = manual.split_experts(experts)
    assert sorted(r.key for r in good.collect()) == ["m", "pair::a|b"] and sorted(r.rejected for r in bad.collect()) == ["incomplete", "triple_sum"]


def test_context_rules(spark, tmp_path):
    path = tmp_path / "match_context.csv"
    path.write_text("match_id,available_at,kickoff_at,lineup_edge,reason\nm1,2026-06-12T10:00:00Z,2026-06-12T20:00:00Z,5,late lineup\n")
    assert manual.load_context(spark, str(tmp_path)).count() == 1
    path.write_text("match_id,available_at,kickoff_at,lineup_edge,reason\nm1,2026-06-12T21:00:00Z,2026-06-12T20:00:00Z,5,\nm2,2026-06-12 10:00:00,2026-06-12T20:00:00Z,,\n")
    broken = {r.key: r.broken for r in manual.check_context(manual.load(spark, str(tmp_path), "match_context")).collect()}
    assert broken == {"m1": "after_kickoff;reason", "m2": "available_at"}
    with pytest.raises(DataError):
        manual.load_context(spark, str(tmp_path))


def test_latest_wins_stream(spark, tmp_path):
    schema = "fixture_id string, seq int, goals int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: spark.readStream.schema(schema).json(source).writeStream.foreachBatch(results.latest_results(out, "fixture_id", "seq")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], schema).write.json(source)
    run()
    spark.createDataFrame([("a", 3, 5)], schema).write.mode("append").json(source)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/v1").collect()) == [("a", 3, 5), ("b", 2, 1)]


def test_ratings_go_on_from_batch_to_batch(spark, tmp_path):
    df, rows = matches(spark, 60)
    expected, state = plain_elo(rows)
    rate = results.rating_batches(str(tmp_path))
    rate(df.where("date < '2020-02-10'"), 0)
    rate(df.where("date >= '2020-02-10'"), 1)
    final = {r.team: r.rating for r in spark.read.parquet(f"{tmp_path}/ratings/v1").collect()}
    assert final == pytest.approx(state)


def test_knockout_loader_names_all_problems(spark, tmp_path):
    header = "match_number,round,team_a,team_b,score_a,score_b,aet,penalties,winner,notes\n"
    (tmp_path / "good.csv").write_text(header + " 73 ,round_of_32,A,B,2,1,,NA,A,x\n89,round_of_16,C,D,1.0,1,Yes,TRUE,D,\n104,final,A,D,,,false,0,A,\n")
    good = manual.load_knockout(spark, str(tmp_path / "good.csv")).orderBy("match_number").collect()
    assert [(r.match_number, r.score_a, r.score_b, r.aet, r.penalties, r.winner, r.notes) for r in good] == [(73, 2, 1, False, False, "A", "x"), (89, 1, 1, True, True, "D", ""), (104, None, None, False, False, "A", "")]
    lines = ["x,final,A,B,1,0,,,A,", "74,round_of_32,A,B,1,0,,,A,", "74,oops,A,A,1,1,,,Z,", "72,final,A,B,1,0,,,A,", "75,final,,B,-1,b,maybe,1,Z,", "76,round_of_32,A,B,2,1,1,1,A,", "77,round_of_32,A,A,1,1,,,A,", "78,round_of_32,A,B,0,1,,,A,", "79,round_of_32,A,B,1,,,perhaps,A,"]
    (tmp_path / "bad.csv").write_text(header + "\n".join(lines) + "\n")
    found = manual.scan_knockout(spark, str(tmp_path / "bad.csv")).orderBy("source_row").collect()
    expected = ["number_not_integer", "", "duplicate", "number_range", "score_a_negative;score_b_not_integer;aet_not_boolean;round;team_missing;winner;penalties_without_aet", "shootout_not_level", "same_team;level_without_shootout", "winner_contradicts_score", "penalties_not_boolean;one_score"]
    assert [r.problems for r in found] == expected
    with pytest.raises(DataError) as e:
        manual.load_knockout(spark, str(tmp_path / "bad.csv"))
    assert all(p in str(e.value) for p in expected)
    assert manual.load_knockout(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(FileNotFoundError):
        manual.load_knockout(spark, str(tmp_path / "none.csv"), required=True)
    (tmp_path / "short.csv").write_text("match_number,round\n73,final\n")
    with pytest.raises(SchemaError):
        manual.load_knockout(spark, str(tmp_path / "short.csv"))


def test_calls_over_the_rate_and_by_day(spark):
    calls = [("a", 0.0), ("a", 30.0), ("a", 59.999999), ("a", 60.0), ("b", 10.0), ("b", 10.0), ("a", 86400.0), ("c", None)]
    df = spark.createDataFrame(calls, "client string, s double").select("client", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("at"), "s")
    got = {(r.client, r.s, r.in_window) for r in limits.rate_breaches(df, "client", "at", 2).collect()}
    expected = set()
    for c, s in calls:
        n = sum(1 for d, x in calls if s is not None and x is not None and d == c and s - 60 < x <= s)
        if n > 2:
            expected.add((c, s, n))
    assert got == expected == {("a", 59.999999, 3), ("a", 60.0, 3)}
    days = {(r.client, str(r.day)): (r.used, r.remaining) for r in limits.daily_use(df, "client", "at", 5, 2).collect()}
    assert days == {("a", "1970-01-01"): (4, 0), ("a", "1970-01-02"): (1, 2), ("b", "1970-01-01"): (2, 1)}
    with pytest.raises(ValueError):
        limits.rate_breaches(df, "client", "at", 0)


def test_settings_never_override(spark):
    lines = ["# A=0", "A = 1=2 ", "A=3", "", "B", "=4", "HOME=/x", "\tC=\t"]
    rows = delimited.settings(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"), ["HOME"]).collect()
    assert {(r.key, r.value) for r in rows} == {("A", "1=2"), ("C", "")}


def test_adapters_tell_reasons_coverage_and_versions(spark):
    df = spark.createDataFrame([("x", 1, "2020-01-01"), ("y", None, "2020-02-01"), (None, 5, "2020-03-01"), ("z", 2, "2020-04-01")], "player string, n int, date string")
    rules = {"no_player": F.col("player").isNotNull(), "n": F.col("n") > 0}
    source = adapters.Players("p", "players", df, "date", rules)
    assert isinstance(source, adapters.PlayerAdapter) and not isinstance(source, adapters.RankingAdapter)
    assert {(r.player, r.reason) for r in source.refused().collect()} == {("y", "n"), (None, "no_player")}
    row = source.coverage().first()
    assert (row.n_rows, row.n_valid, str(row.first_date), str(row.last_date)) == (4, 2, "2020-01-01", "2020-04-01")
    aliases = spark.createDataFrame([("x", 7), ("x", 7), ("z", 1), ("z", 2)], "alias string, player_id long")
    assert {(r.player, r.player_id) for r in source.resolve_players(aliases).collect()} == {("x", 7), ("z", None)}
    again = adapters.Players("p", "players", df.orderBy(F.desc("date")), "date", rules)
    assert source.manifest() == again.manifest() and source.manifest()["rows"] == 2
    assert adapters.Players("p", "players", df.where("player = 'x'"), "date", rules).manifest()["version"] != source.manifest()["version"]
    nothing = adapters.TableAdapter("e", "events", df.limit(0), "date").coverage().first()
    assert (nothing.n_rows, nothing.n_valid, nothing.first_date) == (0, 0, None)


def test_reports_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 0.5)], "name string, x double")
    sinks.write_report(df, f"{tmp_path}/r")
    assert sorted(spark.read.schema(df.schema).json(f"{tmp_path}/r/json").collect()) == sorted(df.collect())
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/csv").columns == ["name", "x"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_report(df, f"{tmp_path}/r")
