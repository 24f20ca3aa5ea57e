"""The term index against full scans."""

import random

import pytest
from pyspark.sql import functions as F

from turnsift.functions.text import fold_column
from turnsift.operators import postings, search
from turnsift.operators.filters import Filters
from turnsift.schema import KINDS

NOW, DAY = 1_780_000_000.0, 86_400.0


def turns(spark, n=900, seed=2):
    rng = random.Random(seed)
    words = ["the", "alpha", "béta", "gamma", "file_path", "x", "delta", "rare"]
    rows = []
    for k in range(n):
        said = " ".join(rng.choices(words, [30, 10, 8, 8, 5, 20, 5, 1], k=rng.randint(0, 25)))
        rows.append((rng.getrandbits(60), f"s{k % 17}", k % 17, k // 17, NOW - rng.choice([0, 3, 20, 100, 500]) * DAY * rng.random(), rng.choice(KINDS), "", rng.choice(["", "alpha x", "delta"]), said, bool(k % 2), f"p{k % 3}"))
    rows[0] = (*rows[0][:4], 0.0, *rows[0][5:])
    df = spark.createDataFrame(rows, "turn_id long, session_id string, session_key long, seq int, ts double, kind string, tool string, target string, text string, sidechain boolean, project string")
    return df.withColumns({"source": F.lit("claude_code"), "text_tok": fold_column(F.col("text")), "target_tok": fold_column(F.col("target"))})


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    df = turns(spark).cache()
    return df, postings.write(df, str(tmp_path_factory.mktemp("index")), bits=4)


QUERIES = [["the"], ["rare"], ["the", "x"], ["alpha beta"], ["the x", "gamma"], ["file_path", "delta"], ["Béta", "alpha x"], ["nothing"], ["the", "--"], ["rare", "rare"]]


@pytest.mark.parametrize("terms", QUERIES)
def test_same_hits_as_a_scan(both, terms):
    df, index = both
    want = sorted(r["turn_id"] for r in search.candidates(df, terms).select("turn_id").collect())
    assert sorted(r["turn_id"] for r in postings.candidates(index, None, terms).select("turn_id").collect()) == want


FILTERS = [Filters(), Filters(include_meta=True, kind=["error", "meta"], sidechain=True), Filters(until=NOW - 50 * DAY)]


@pytest.mark.parametrize(("terms", "filters"), [(t, FILTERS[k % 3]) for k, t in enumerate(QUERIES)])
def test_same_top_as_a_full_ranking(both, terms, filters):
    df, index = both
    full = search.top_turns(search.score(search.candidates(df, terms, filters), terms, NOW), 10)
    got, reads = postings.top(index, None, terms, NOW, 10, filters, wave=3)
    keys = ["turn_id", "score", "kind_pts", "terms_pts", "phrase_pts", "recency_pts", "text"]
    assert got.select(keys).collect() == full.select(keys).collect()
    assert reads.read <= reads.blocks


def test_the_search_stops_early(both):
    _, index = both
    _, reads = postings.top(index, None, ["the", "x"], NOW, 5, wave=1)
    assert 0 < reads.read < reads.blocks / 2


def test_postings_are_blocks(both):
    df, index = both
    rows = index.postings.filter("token = 'the' and field = 0").collect()
    assert len({r["block"] for r in rows}) > 10 and all(len(r["docs"]) <= 16 and sorted(set(r["docs"])) == r["docs"] for r in rows)
    assert sum(len(r["keys"]) for r in rows) == sum(r["text_tok"].split().count("the") for r in df.collect())
    pushed = postings.matched(index, ["the"], 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [the])" in pushed.replace("EqualTo(token,the)", "In(token, [the])") and "GreaterThanOrEqual(block,3)" in pushed


def test_an_empty_index(spark, both, tmp_path):
    index = postings.write(both[0].filter("false"), f"{tmp_path}/none")
    got, reads = postings.top(index, None, ["the"], NOW, 5)
    assert got.collect() == [] and reads == postings.Reads(0, 0)
