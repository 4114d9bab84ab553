"""Every query against its SQL, and queries without SQL against a plain version."""

import json

import pytest

from cardloom import plans
from tests.oracle import DATA, difference


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, plans.QUERIES[name], plans.SQL[name], f"{DATA}/sf0.001") == ""


def test_pairs_of_one_character_come_from_all_items(spark):
    items = plans.QUERIES["catalog_names"](spark, f"{DATA}/sf0.01").collect()
    by_character = {}
    for r in items:
        by_character.setdefault((r.series, r.character), []).append(r.item_id)
    want = [(a, b) for ids in by_character.values() for a in ids for b in ids if a < b]
    got = [tuple(r) for r in plans.QUERIES["two_part_key_match"](spark, f"{DATA}/sf0.01").select("a", "b").collect()]
    assert sorted(got) == sorted(want) and any(a >= 100 for a, _ in got)


def test_fuzzy_scores_equal_plain_ones(spark):
    from cardloom.functions import text

    got = plans.QUERIES["fuzzy_scores"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) > 300 and all(r.score == text.score(r["query"], r["name"]) for r in got)


def test_history_json_holds_the_list(spark):
    rows = plans.QUERIES["history_json"](spark, f"{DATA}/sf0.001").collect()
    lists = {(r.user_id, r.pool): r for r in plans.QUERIES["history_list"](spark, f"{DATA}/sf0.001").collect()}
    assert len(rows) == len(lists)
    for r in rows:
        assert [x["card_name"] for x in json.loads(r.history)] == lists[r.user_id, r.pool].history


def test_model_hook_scores_every_row(spark):
    got = {r.vec_id: r.mean for r in plans.QUERIES["score_udf"](spark, f"{DATA}/sf0.001").collect()}
    want = {r.vec_id: sum(r.embedding) / len(r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
