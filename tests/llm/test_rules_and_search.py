"""Quality rules and MaxScore against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statefold.llm import max_score, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    cover = {p for i, g in enumerate(grams) if times[g] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_brute_force(spark, edges, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").unionByName(edges.select("doc_id", "text", "source"))
    made = docs.select("text").collect()
    got = quality_rules.counts(docs).drop("doc_id", "source").collect()
    assert [tuple(r) for r in got] == [by_hand(r.text) for r in made]


def test_bad_hosts_lose_their_documents(spark):
    good = [(i, f"word{i} " + " ".join(f"w{i}x{j}" for j in range(20)), f"host{i % 5}", 0) for i in range(100)]
    bad = [(1000 + i, "too short" if i % 10 else good[i][1], "bad", 0) for i in range(50)]
    docs = spark.createDataFrame(good + bad + [(2000, good[0][1], None, 0)], "doc_id bigint, text string, source string, kept int")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == 151 and all(rows[i].kept for i in range(100)) and rows[2000].kept
    assert not rows[1000].base_failed and not rows[1000].kept and rows[1000].host_failed


def test_rules_on_edges(edges, nothing):
    rows = quality_rules.judge(edges).collect()
    assert len(rows) == edges.count() and all(r.kept is not None for r in rows)
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert quality_rules.judge(nothing).count() == 0


def hosts(spark, rows):
    docs = [(host, 5 if j < k else 50) for host, n, k in rows for j in range(n)]
    counted = spark.createDataFrame(docs, "source string, n_words bigint").select("source", "n_words", *[F.lit(0).cast("long").alias(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")])
    return {r.source: r for r in quality_rules.host_rates(counted).collect()}


def test_small_hosts_are_shrunk_towards_all(spark):
    rates = hosts(spark, [(f"h{i}", 1000, 10 + i % 3) for i in range(30)] + [("tiny", 1, 1)])
    assert rates["tiny"].rate_short < 0.05 and rates["h0"].rate_short == pytest.approx(0.01, abs=0.01)
    assert not any(r.sure_short > r.limit_short for r in rates.values())


def test_hosts_that_differ_by_chance_are_one(spark):
    """All are given the common rate: the weight is at its bound."""
    rng = np.random.default_rng(3)
    rates = hosts(spark, [(f"h{i}", 50, int(k)) for i, k in enumerate(rng.binomial(50, 0.1, 40))])
    common = {round(r.rate_short, 2) for r in rates.values()}
    assert len(common) == 1 and not any(r.sure_short > r.limit_short for r in rates.values())


def test_a_really_bad_host_is_found_among_alike_ones(spark):
    rng = np.random.default_rng(4)
    rates = hosts(spark, [(f"h{i}", 50, int(k)) for i, k in enumerate(rng.binomial(50, 0.05, 40))] + [("bad", 200, 150), ("small", 1, 1), ("twin a", 30, 2), ("twin b", 30, 2)])
    assert {k for k, r in rates.items() if r.sure_short > r.limit_short} == {"bad"}
    assert rates["twin a"].rate_short == rates["twin b"].rate_short


def brute(vectors, queries, k):
    out = []
    ints = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in queries:
        own = [v for i, v in ints if i == q]
        if own:
            scores = sorted(((-int(own[0] @ v), i) for i, v in ints if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed,dims,rows", [(0, 40, 700), (1, 3, 50), (2, 64, 300)])
def test_search_equals_brute_force(spark, seed, dims, rows):
    rng = np.random.default_rng(seed)
    v = [(i, [float(np.float32(x)) for x in (rng.normal(size=dims) if i % 7 else np.ones(dims) / 8)]) for i in range(rows)]  # every seventh alike: ties
    v += [(None, [1.0] * dims), (rows + 1, None), (rows + 2, [None] * dims), (rows + 3, [float("nan")] * dims), (rows + 4, [float("inf")] * dims)]
    frame = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    got = max_score.top_k(frame, frame.where("vec_id % 10 = 0"), 5, shard=64).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(v, [i for i, _ in v if i is not None and i % 10 == 0], 5)
    blocks = max_score.top_k(frame, frame.where("vec_id % 10 = 0"), 5, block=8).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def test_search_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5]), (1, [0.5]), (100, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in max_score.top_k(frame, frame.where("vec_id = 0"), 10).select("rank", "vec_id", "score").orderBy("rank").collect()]
    assert got == [(1, 1, 1024 * 512), (2, 1, 1024 * 512), (3, 100, 0)]
    assert max_score.top_k(frame.where("false"), frame.where("false"), 10).count() == 0


def test_fewer_postings_are_traversed_as_the_floor_rises():
    rng = np.random.default_rng(5)
    scale = 0.75 ** np.arange(16)  # bounds that fall
    candidates = np.floor(1000 * rng.normal(size=(4000, 16)) * scale).astype(np.int64)
    queries = np.floor(1000 * rng.normal(size=(6, 16)) * scale).astype(np.int64)
    ids = np.arange(1000, 5000)
    leaders, before, steps = max_score.Leaders(np.arange(6), queries, 5), 0, []
    for at in range(0, 4000, 500):
        leaders.visit(ids[at : at + 500], candidates[at : at + 500])
        steps.append(leaders.traversed - before)
        before = leaders.traversed
    assert steps[-1] < steps[0] <= 6 * 500 * 16 and leaders.traversed + leaders.probed < 0.7 * 6 * 4000 * 16
    for q, (found, scores) in zip(queries, leaders.found, strict=True):
        want = sorted(zip((-(candidates @ q)).tolist(), ids.tolist()))[:5]
        assert list(zip((-scores).tolist(), found.tolist())) == want


def test_a_shard_below_the_floor_is_left_out():
    leaders = max_score.Leaders(np.array([1]), np.array([[10, 10]]), 2)
    leaders.visit(np.array([5, 6, 7]), np.array([[9, 9], [9, 8], [1, 1]]))
    before = leaders.traversed, leaders.probed
    leaders.visit(np.array([8, 9, 10]), np.array([[1, 2], [2, 1], [0, 0]]))
    assert (leaders.traversed, leaders.probed) == before and leaders.found[0][0].tolist() == [5, 6]


def test_values_that_do_not_fit_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        max_score.top_k(frame, frame, 1).count()


def test_search_with_clashing_columns_and_equal_ids(spark):
    rows = [(0, [1.0], 5, 1), (1, [3.0], 5, 2), (1, [2.0], 5, 3), (2, [2.0], 5, 4)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, query_id int").repartition(4)
    got = max_score.top_k(frame, frame.where("vec_id = 0"), 3, shard=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3 * 1024**2), (1, 2 * 1024**2), (2, 2 * 1024**2)]
