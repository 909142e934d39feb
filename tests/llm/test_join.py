"""The n-gram join against brute force, with every class boundary forced."""

import random
import re

import numpy as np
import pytest

from statefold.llm import n_gram_join as J
from statefold.llm import shingles as S
from statefold.llm.components import components

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, common = sets[j], len(a & sets[j])
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def family(rng, size, edits, words=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 2)
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    out = family(rng, 25, 4) + family(rng, 10, 1) + family(rng, 40, 3, 30) + [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(30)]
    out += out[:5] + ["same words here"] * 3 + ["Same Words HERE", "", None, "a b c d e", "a b c d e", "A B C D F"]
    return out


@pytest.mark.parametrize("seed,frequent,rounds,bound", [(1, 32, 3, 1 << 20), (2, 4, 1, 1 << 20), (3, 1, 0, 1 << 20), (4, 3, 1, 0), (5, 0, 0, 0)])
def test_components_equal_brute_force(spark, seed, frequent, rounds, bound):
    made = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    sets = [shingles(t) for t in made]
    roots = groups(sets)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs, frequent=frequent, rounds=rounds, block=8, class_bound=bound, lookup_bound=bound).collect()}
    assert got == {i: (len(s), least[roots[i]]) for i, s in enumerate(sets)}


def test_edges(edges, nothing):
    rows = J.join(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[10].component_id == 9
    assert J.join(nothing).count() == 0


def test_representatives_keep_one_of_each_group(spark, tmp_path):
    made = corpus(5) + [corpus(5)[0]] * 2
    path = str(tmp_path / "docs")
    rows = [(None if i % 17 == 3 else i, t, "x") for i, t in enumerate(made)] + [(0, made[0], "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string, node string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    sets = [shingles(t) for _, t, _ in rows]
    filled = [s for s in sets if s]
    assert len([t for t in texts if shingles(t)]) == len(set(groups(filled)))
    assert len([t for t in texts if not shingles(t)]) == len(sets) - len(filled)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(1)
    for n in (3, 60, 500):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n, np.uint64))))
        both = len(np.intersect1d(a, b))
        d = S.sketch_distance(S.sketch(a), S.sketch(b))
        assert d <= len(a) + len(b) - 2 * both and S.sketch_distance(S.sketch(a), S.sketch(a)) == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(3)
    names = rng.sample(range(-(10**9), 10**9), 200)
    links = [(a, b) for a, b in zip(names[:150], names[1:150])] + [(names[160], names[161]), (names[170], names[170])]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({got[n] for n in names[:150]}) == 1 and got[names[160]] == got[names[161]] != got[names[0]]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
