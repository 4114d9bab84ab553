"""Operators on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardloom.operators import ballots, holdings, joins, matching, pools, replies, scoring, selection, stats
from cardloom.sources import files, images, logs

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def test_share_counts_rows_without_a_series(spark):
    rows = [("A", f, f.rsplit(".", 1)[0]) for f in ("g_c.png", "g_c_1.png", "g_d.png", "plain.x_y")]
    cat = spark.createDataFrame(rows, "pool string, file_name string, stem string").withColumns({"series": F.split_part("stem", F.lit("_"), F.lit(1)), "character": F.split_part("stem", F.lit("_"), F.lit(2))})
    (row,) = stats.series_stats(cat).collect()
    assert (row.series, row.items, row.characters, row.share, row.avg_skins) == ("g", 3, 2, 75.0, 1.5)


def test_ranks_break_ties_by_name_and_pages_hold_ten(spark):
    rows = [("A", f"g{i:02}", 5, 1, 1.0, 1.0) for i in range(23)]
    out = stats.ranked(spark.createDataFrame(rows, "pool string, series string, items long, characters long, share double, avg_skins double"), ["pool"]).collect()
    assert [r.series for r in sorted(out, key=lambda r: r["rank"])] == sorted(r[1] for r in rows)
    assert {p: sum(r.page == p for r in out) for p in (1, 2, 3)} == {1: 10, 2: 10, 3: 3}
    assert stats.top(spark.createDataFrame(rows, "pool string, series string, items long, characters long, share double, avg_skins double"), ["pool"], 0).count() == 0


def test_last_and_first_wins_break_ties_by_sequence(spark):
    events = spark.createDataFrame([("u", at(1), 1, "a"), ("u", at(1), 2, "b"), ("v", at(5), 3, "c")], "user_id string, ts timestamp, seq long, card string")
    assert {(r.user_id, r.card) for r in holdings.last_wins(events, ["user_id"], ["ts", "seq"], ["card"]).collect()} == {("u", "b"), ("v", "c")}
    assert {(r.user_id, r.card) for r in holdings.first_wins(events, ["user_id"], ["ts", "seq"], ["card"]).collect()} == {("u", "a"), ("v", "c")}


def test_availability_compares_lower_case_and_keeps_duplicates(spark):
    cat = spark.createDataFrame([(1, "A", "g", "C"), (2, "A", "h", "c"), (3, "A", "g", "d"), (4, "A", "g", "d"), (5, "B", "g", "c")], "item_id long, pool string, series string, character string")
    held = spark.createDataFrame([("A", "G", "c")], "pool string, series string, character string")
    assert sorted(r.item_id for r in selection.available(cat, held, ["character"]).collect()) == [3, 4, 5]
    assert sorted(r.item_id for r in selection.available(cat, held, ["series", "character"]).collect()) == [2, 3, 4, 5]
    assert selection.available(cat, held.limit(0), ["character"]).count() == 5


def test_best_match_prefers_exact_and_rejects_far_names(spark):
    names = spark.createDataFrame([("alpha",), ("alphabet",), ("beta",)], "name string")
    got = matching.best_match(spark.createDataFrame([("alpha",), ("betq",), ("zzz",)], "query string"), names).collect()
    # by hand: betq and beta have 6/8, betq and the end of alphabet (its window is cut off there) 6/7
    assert {r["query"]: (r["name"], r["score"]) for r in got} == {"alpha": ("alpha", 100.0), "betq": ("alphabet", 86.0)}
    assert matching.best_match(spark.createDataFrame([("x",)], "query string"), names.limit(0)).count() == 0


def test_aliases_later_entries_win(spark):
    entries = spark.createDataFrame([(1, "One", ["o", "x"], None, None), (2, "Two", ["X"], "t", "TWO-EN")], "position int, name string, aliases array<string>, short_name string, en_name string")
    got = {r.alias: r.name for r in files.alias_table(entries).collect()}
    assert got == {"one": "One", "o": "One", "x": "Two", "two": "Two", "t": "Two", "two-en": "Two"}


def ballot(spark, votes, owner=9, supers=(7,)):
    rows = [(1, v, c, at(s), i) for i, (v, c, s) in enumerate(votes)]
    v = spark.createDataFrame(rows, "ballot long, voter long, choice string, ts timestamp, seq long")
    b = spark.createDataFrame([(1, owner, T)], "ballot long, owner long, opened timestamp")
    (row,) = ballots.results(v, b, 60, list(supers)).collect()
    return (row.agree, row.disagree, row.abstain, row.early, row.result)


def test_ballots(spark):
    assert ballot(spark, [(1, "agree", 1), (1, "disagree", 2), (2, "agree", 3)]) == (2, 0, 0, False, "remove")  # first vote wins
    assert ballot(spark, [(1, "agree", 1), (2, "disagree", 2)]) == (1, 1, 0, False, "keep")  # tie
    assert ballot(spark, [(1, "other", 1), (2, "abstain", 2)]) == (0, 0, 1, False, "keep")
    assert ballot(spark, [(1, "agree", 61)]) == (0, 0, 0, False, "keep")  # too late
    assert ballot(spark, []) == (0, 0, 0, False, "keep")
    assert ballot(spark, [(1, "disagree", 1), (9, "agree", 2), (2, "disagree", 3)]) == (1, 1, 0, True, "remove")  # the owner decides
    assert ballot(spark, [(9, "abstain", 1), (7, "disagree", 2), (1, "agree", 3)]) == (0, 1, 1, True, "keep")  # a superuser decides
    assert ballot(spark, [(7, "disagree", 1), (9, "agree", 2)]) == (0, 1, 0, True, "keep")  # the earlier one


def test_reply_roots(spark):
    rows = [(1, None, 10), (2, 1, 11), (3, 2, 12), (4, 3, 13), (5, 99, 14), (6, 7, 15), (7, 6, 16)]
    got = {r.message_id: r.sender_id for r in replies.roots(spark.createDataFrame(rows, "message_id long, reply_to long, sender_id long"), rounds=6).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 10, 5: 0, 6: 0, 7: 0}


def test_replies_of_one_large_thread(spark, monkeypatch):
    rows = [(0, None, 7)] + [(i, (i - 1) // 3, 1) for i in range(1, 500)] + [(1000 + i, 999, 2) for i in range(50)] + [(None, 3, 4), (None, None, 5)]
    monkeypatch.setattr(joins.skew_join, "__defaults__", (10,))  # more than a tenth of all rows are frequent
    for few in (replies.FEW_MESSAGES, 0):
        monkeypatch.setattr(replies, "FEW_MESSAGES", few)
        got = replies.roots(spark.createDataFrame(rows, "message_id long, reply_to long, sender_id long")).collect()
        assert len(got) == len(rows) and {(r.message_id, r.root_id, r.sender_id) for r in got} == {(i, 0, 7) for i in range(500)} | {(1000 + i, 999, 0) for i in range(50)} | {(None, None, 0)}


def test_confidence(spark):
    rows = [(1, ["1boy", "1girl", "hat"], [0.6, 0.2, 0.9]), (2, ["hat"], [0.9]), (3, ["boy_girl"], [0.5])]
    got = {r.id: (r.boy, r.girl) for r in scoring.confidence(spark.createDataFrame(rows, "id long, tags array<string>, scores array<float>")).collect()}
    assert got == {1: (0.75, 0.25), 2: (0.0, 0.0), 3: (0.5, 0.5)}


def test_library_lists_files(spark, tmp_path):
    for pool, name in (("a", "g_c.png"), ("a", "plain"), ("b", "g_d_1.png")):
        (tmp_path / pool).mkdir(exist_ok=True)
        (tmp_path / pool / name).write_bytes(b"x" * 3)
    found = files.library(spark, {"A": str(tmp_path / "a"), "B": str(tmp_path / "b")}, digest=True)
    assert found.count() == 3 and {len(r.sha256) for r in found.collect()} == {64}
    assert {(r.pool, r.series, r.character, r.suffix) for r in files.listed(found).collect()} == {("A", "g", "c", ""), ("B", "g", "d", "1")}


def library_of(spark):
    rows = [(1, "A", "g_c.png"), (2, "A", "g_c_1.png"), (3, "B", "g_c.png"), (4, "A", "g_d.png"), (5, "B", "h_c.png"), (6, "A", "plain")]
    return spark.createDataFrame([(i, p, f, f.rsplit(".", 1)[0]) for i, p, f in rows], "item_id long, pool string, file_name string, stem string")


def test_moves_take_the_first_request_and_leave_files_that_are_there(spark):
    asked = spark.createDataFrame([("u", "g_c", "A", "B", at(2), 2), ("v", "g_c_1", "A", "B", at(1), 1), ("w", "plain", "A", "B", at(1), 3), ("x", "z_z", "A", "B", at(1), 4)], "user_id string, card string, pool string, to string, ts timestamp, seq long")
    found = pools.requested(library_of(spark), asked)
    assert {r.user_id: (r.moved, r.failed) for r in pools.report(found).collect()} == {"v": (["g_c_1"], ["g_c.png"]), "u": ([], ["g_c.png", "g_c_1.png"])}
    assert {r.item_id: r.pool for r in pools.moved(library_of(spark), found).collect()} == {1: "A", 2: "B", 3: "B", 4: "A", 5: "B", 6: "A"}
    held = spark.createDataFrame([("v", "g_c_1"), ("v", "h_c"), ("u", "g_c")], "user_id string, card string")
    assert {(r.user_id, r.card) for r in pools.without_holdings(held, found).collect()} == {("v", "h_c"), ("u", "g_c")}


def test_removal_takes_files_of_any_pool(spark):
    asked = spark.createDataFrame([("u", "g_c_9", None, pools.REMOVED, at(1), 1)], "user_id string, card string, pool string, to string, ts timestamp, seq long")
    found = pools.requested(library_of(spark), asked)
    after = {r.item_id: r.pool for r in pools.moved(library_of(spark), found).collect()}
    assert {i for i, p in after.items() if p == pools.REMOVED} == {1, 2, 3}
    assert pools.requested(library_of(spark).limit(0), asked).count() == 0


def test_logs_are_made_once_and_take_declared_columns_only(spark, tmp_path):
    folder = str(tmp_path / "logs")
    logs.create(spark, folder)
    rows = spark.createDataFrame([("u", "g_c", T, "A"), ("u", "g_d", at(5), "A")], "user_id string, card_name string, times timestamp, card_type string")
    logs.append(rows, folder, "draws")
    logs.create(spark, folder)
    assert logs.read(spark, folder, "draws").count() == 2 and logs.moves(spark, folder).count() == 0 and logs.histories(spark, folder).count() == 0
    with pytest.raises(ValueError, match="other"):
        logs.append(rows.withColumn("other", F.lit(1)), folder, "draws")


def test_alias_files(spark, tmp_path):
    path = tmp_path / "aliases.yaml"
    path.write_text("games: # a list\n  - name: One\n    aliases:\n      - o\n      - 'X y'\n    en_name: \"One En\"\n\n  - name: 二\n    aliases: [t, x Y]\n    short_name: 2\n  - name: Three\n    aliases:\n")
    got = {r.alias: r.name for r in files.alias_file(spark, str(path)).collect()}
    assert got == {"one": "One", "o": "One", "x y": "二", "one en": "One", "二": "二", "t": "二", "2": "二", "three": "Three"}
    for text in ("games:\n  - aliases: [a]\n", "not yaml of this form", ""):
        path.write_text(text)
        assert files.alias_file(spark, str(path)).count() == 0
    assert files.alias_file(spark, str(tmp_path / "missing")).count() == 0


def test_images_that_cannot_be_read_or_scored_get_no_score(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 0, 255]))
    (tmp_path / "b.pgm").write_bytes(b"P5 1 1 255\n" + bytes([51]))
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.pgm").write_bytes(b"P5 1 1 255\n\x00")
    tensor = images.decode((tmp_path / "a.ppm").read_bytes())
    assert tensor.shape == (1, 512, 512, 3) and tensor[0, 0, 0].tolist() == [1, 0, 0] and tensor[0, 511, 511].tolist() == [0, 0, 1]

    def make():
        def score(x):
            if x.max() == 0:
                raise ValueError("black")
            return x[..., 0].mean(), x[..., 2].mean()

        return score

    got = {r.file_name: (r.boy, r.girl) for r in images.scored(images.files(spark, str(tmp_path)), make).collect()}
    assert {k: tuple(round(x, 4) for x in v) for k, v in got.items()} == {"a.ppm": (0.5, 0.5), "b.pgm": (0.2, 0.2), "c.png": (0, 0), "d.pgm": (0, 0)}


def test_a_row_that_fails_costs_the_others_nothing(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(6)], "id long, x double")

    def make():
        def score(batch):
            if batch["x"].isna().any():
                raise ValueError("no number")
            return batch.assign(y=batch["x"] * 2)[["id", "y"]]

        return score

    got = scoring.with_model(rows.coalesce(1), make, "id long, y double", failed=lambda b: b.assign(y=0.0)[["id", "y"]])
    assert {r.id: r.y for r in got.collect()} == {0: 0, 1: 2, 2: 4, 3: 0, 4: 8, 5: 10}
    with pytest.raises(Exception, match="no number"):
        scoring.with_model(rows, make, "id long, y double").collect()


def test_ballots_in_batches_count_late_votes_and_end_with_the_deciding_one(spark, tmp_path):
    """An earlier vote comes in a later batch; the owner's vote ends a ballot once the watermark has passed it."""
    from cardloom.streaming import ballots as stream
    from cardloom.streaming import common

    schema = "ballot long, owner long, voter long, choice string, ts timestamp, seq long"
    hour = 3600
    batches = [
        [(1, 9, 2, "agree", at(2 * hour), 2), (2, 9, 5, "agree", at(2 * hour), 3)],
        [(1, 9, 1, "disagree", at(int(1.5 * hour)), 1), (1, 9, 9, "agree", at(3 * hour), 4), (2, 9, 9, "abstain", at(3 * hour), 5)],
        [(3, 9, 1, "abstain", at(5 * hour), 6), (1, 9, 3, "disagree", at(5 * hour), 7)],
        [(3, 9, 2, "abstain", at(6 * hour), 8)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    votes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r.ballot: tuple(r)[2:] for r in common.drained(stream.results(votes, 24 * hour, []), "late").collect()}
    # ballot 2 is open for a day and has no deciding vote, ballot 3 is not over
    assert got == {1: (2, 1, 0, True, "remove")}


def test_running_total_of_nulls_and_ties(spark):
    rows = [(None, at(5), 1), (None, at(86400), 2), ("u", at(1), 3), ("u", at(1), 4), ("u", at(3 * 86400), 5), ("v", None, 6)]
    got = holdings.running_total(spark.createDataFrame(rows, "user_id string, ts timestamp, seq long"), ["user_id"], ["ts", "seq"])
    assert {r.seq: r.running_total for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 1}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from cardloom.operators import lineage

    def session(master, folder):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=context)

    assert lineage.shared_dir(session("spark://m:1", "hdfs:///x/")) == "hdfs:///x"
    assert lineage.shared_dir(session("local[4]", None)).startswith("file://")
    for master in ("spark://m:1", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            lineage.shared_dir(session(master, None))


def test_files_are_verified_by_their_digests(spark, tmp_path):
    import hashlib

    for name, content in (("w.bin", b"weights"), ("x.bin", b"other")):
        (tmp_path / name).write_bytes(content)
    found = files.library(spark, {"A": str(tmp_path)}, digest=True)
    expected = spark.createDataFrame([("w.bin", hashlib.sha256(b"weights").hexdigest().upper()), ("x.bin", hashlib.sha256(b"x").hexdigest()), ("y.bin", hashlib.sha256(b"").hexdigest()), ("w.bin", None)], "file_name string, sha256 string")
    assert {r.file_name: r.ok for r in files.verified(found, expected).collect()} == {"w.bin": True, "x.bin": False, "y.bin": False}
