"""Quality classifier, toxicity and language identification: held-out accuracy, defined edge cases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from statefold.llm import boosted_trees, language_id, quality_classifier, registry, toxicity
from statefold.llm.textstats import FEATURES, features

SF = "/root/testdata/sf0.01"


def accuracy(scored, labels, column):
    rows = scored.where("held_out").join(labels, "doc_id").toPandas()
    return (rows.predicted == rows[column]).mean()


def test_quality_is_right_on_held_out_documents(spark):
    scored = registry.op4_quality_classifier(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert accuracy(scored, spark.read.parquet(f"{SF}/labels.parquet"), "quality") > 0.95


def test_toxicity_is_right_on_held_out_documents(spark):
    scored = registry.op1_toxicity(spark, "/root/testdata/sf0.1")
    rows = scored.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    caught = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert caught / (rows.toxic == 1).sum() > 0.85 and caught / (rows.predicted == 1).sum() > 0.95


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = registry.op6_language_id(spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_scores_of_edge_documents(spark, edges, nothing, labels, no_labels, which):
    module = quality_classifier if which == "quality" else toxicity
    model = module.fit(edges, labels)
    rows = module.score(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1  # equal texts, equal scores
    assert module.score(nothing, model).count() == 0
    blank = module.fit(edges, no_labels)
    assert len(module.score(edges, blank).collect()) == len(rows)
    assert module.fit(nothing, labels) is not None
    kept = module.accepted(edges, model)
    assert kept.columns == edges.columns and kept.dtypes == edges.dtypes


def test_without_labels_quality_is_even(spark, edges, no_labels):
    assert {r.score for r in quality_classifier.score(edges, quality_classifier.fit(edges, no_labels)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_learned(spark, edges):
    import zlib

    held = [i for i in range(13) if zlib.crc32(str(i).encode()) % 5 == 0]
    a = spark.createDataFrame([(i, 1, 1) for i in range(13)], "doc_id bigint, quality int, toxic int")
    b = spark.createDataFrame([(i, int(i not in held), int(i not in held)) for i in range(13)], "doc_id bigint, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        one, two = ({(r.doc_id, r.score) for r in module.score(edges, module.fit(edges, x)).collect()} for x in (a, b))
        assert one == two


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = boosted_trees.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            at = 0
            for _ in range(3):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            total += leaf[at - 7]
        return total

    assert np.allclose(forest.raw(x), [walk(r) for r in x])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    assert len(forest.raw(x[:0])) == 0


def test_statistics_by_hand():
    text = "Foo bar, foo!\nFoo bar, foo!\n"
    row = dict(zip(FEATURES, features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]))
    assert row["log_words"] == pytest.approx(np.log1p(6)) and row["dup_line_share"] == 0.5 and row["distinct_share"] == 0.5
    assert not features(np.zeros(0, np.uint8), np.array([0, 0])).any()


def statistics_by_hand(text):
    data, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    share = lambda chars: sum(b in chars for b in data) / max(1, len(data))
    n, m, times = max(1, len(words)), max(1, len(lines)), Counter(words)
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, len(times) / n, max(times.values(), default=0) / n, share(b"#*$%&|<>"), share(range(65, 91)),
        share(range(48, 58)), share(b".,;:?'\"()-"), share(b"!"), share(b"|"), share(range(128, 256)), len(words) / m, (len(lines) - len(set(lines))) / m, len(cover) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(b in b".?!" for b in data) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) < 3 for w in words) / n,
    ]


def test_statistics_equal_a_naive_version(spark, small, edges):
    rows = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + [r.text or "" for r in edges.where("doc_id not in (6, 7)").collect()]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *[len(x.encode()) for x in rows]])
    assert np.allclose(features(data, offsets), [statistics_by_hand(x) for x in rows], rtol=1e-4, atol=1e-6)


def grams_by_hand(word):
    out = []
    for run in language_id.LETTERS.findall(word.lower()):
        padded = f" {run} "
        out += [padded[i : i + n] for n in language_id.WIDTHS for i in range(len(padded) - n + 1) if padded[i : i + n].strip() and not (padded[i] == padded[i + n - 1] == " ")]
    return out


def test_n_grams_equal_a_naive_version():
    words = ["the", "Größe", "don't", "a", "123", "naïve-été", "", "the"]
    key, width, owner = language_id.grams(pa.array(words, pa.large_utf8()))
    naive = [(i, g) for i, w in enumerate(words) for g in grams_by_hand(w)]
    assert Counter(zip(owner.tolist(), width.tolist())) == Counter((i, len(g)) for i, g in naive)
    assert len(set(key.tolist())) == len({g for _, g in naive})


FIXED = toxicity.grammar(toxicity.CONTEXTS)


def clause_score(text, terms=None):
    return sum(toxicity.score_clause([(k, w) for _, k, w in c], FIXED) for c in toxicity.clauses_of(text, terms or {}))


def test_the_grammar_scores_clauses_not_words():
    assert clause_score("a nice day") == 0
    plain = clause_score("idiot")
    assert clause_score("you idiot") > clause_score("idiot you") > plain  # the order counts
    assert clause_score("not an idiot") < plain and clause_score("an idiot not") == plain
    assert clause_score("she said idiot") < plain
    assert clause_score("you are not an idiot") == clause_score("not an idiot")  # what is negated is aimed at nobody
    assert clause_score("stupid worthless idiot") > 3 * plain
    assert clause_score("i will kill you") > 0 and clause_score("they kill time") == 0
    assert clause_score("lostrament", {"lost*": (toxicity.INSULT, 2.0)}) == 2 * plain


def test_composition_equals_running_the_parts_one_after_the_other():
    chain, rng = toxicity.parts(toxicity.CONTEXTS), np.random.default_rng(3)
    for _ in range(200):
        states, joint = [0] * len(chain), 0
        for kind in rng.integers(0, toxicity.END, 12):
            reads, factor = kind, 1.0
            for i, p in enumerate(chain):
                states[i], w, reads = p.step(states[i], reads)
                factor *= w
            assert FIXED.factor[joint, kind] == pytest.approx(factor)
            joint = FIXED.move[joint, kind]
            assert FIXED.states[joint] == tuple(states)


WORDS_OF_CLAUSES = "you idiot not stupid she said will kill the a zorb zorbling grand day , . ! \n they clown never quoted".split(" ")


def test_clause_numbers_equal_a_naive_scorer():
    rng = np.random.default_rng(7)
    terms = {"zorb": (toxicity.THREAT, 0.7), "zorbl*": (toxicity.INSULT, 0.5)}
    model = toxicity.Model(terms, np.zeros(0), FIXED)
    rows = [" ".join(rng.choice(WORDS_OF_CLAUSES, rng.integers(0, 30))) for _ in range(200)] + ["", "idiot", "x\nidiot you\nidiot"]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *map(len, rows)])
    got = toxicity.clause_numbers(data, offsets, model)
    for text, numbers in zip(rows, got, strict=True):
        scores = [s for c in toxicity.clauses_of(text, terms) if (s := toxicity.score_clause([(k, w) for _, k, w in c], FIXED)) > 0]
        want = [np.log1p(sum(scores)), max(scores), min(10.0, 100 * len(scores) / len(text.split())), 1.0] if scores else [0.0] * 4
        assert numbers == pytest.approx(want)


def test_term_counts_equal_a_naive_count(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("zorbling zorbling day", 1), ("Zorbling, nice", 0), ("", 1), (None, 0), ("day.day", 1)])]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    got = {r.term: (r.tox, r.clean) for r in toxicity.term_counts(sample).collect()}
    assert got == {"zorbling": (1, 1), "zorb*": (1, 1), "zorbl*": (1, 1), "zorbli*": (1, 1), "day": (2, 0), "nice": (0, 1), "nice*": (0, 1)}


def test_the_grammar_changes_held_out_decisions(spark):
    """The same words are in toxic and clean documents; only what is said with them differs."""
    rng = np.random.default_rng(9)
    fill = lambda: " ".join(rng.choice("ab cd ef gh ij kl mn op".split(), 6))
    toxic = ["you are an idiot", "you stupid clown", "they are trash, you moron"]
    clean = ["he is not an idiot", "nobody is a stupid clown", "she said idiot and clown", "never call it trash"]
    rows = [(i, f"{fill()}. {rng.choice(toxic if i % 2 else clean)}. {fill()}", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    decided = lambda m: {r.doc_id: r.predicted for r in toxicity.score(docs, m).where("held_out").collect()}
    want = {i: y for i, _, y in rows}
    with_grammar = decided(model)
    flat = toxicity.Automaton(model.automaton.move, np.ones_like(model.automaton.factor), model.automaton.states)
    without = decided(toxicity.Model(model.terms, model.curve, flat))
    assert all(with_grammar[i] == want[i] for i in with_grammar)
    assert sum(without[i] != with_grammar[i] for i in without) > 0.2 * len(without)


def test_learned_terms_after_an_intention_are_threats(spark):
    rows = [(i, "we will zorb you now" if i % 2 else "a nice day for all of them", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert model.terms["zorb"][0] == toxicity.THREAT


def test_language_edge_cases(spark, edges, nothing):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 12)], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, least_share=1e-9)
    assert model.languages == ("de", "en")
    got = {r.doc_id: r for r in language_id.predict(edges, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[6].lang_pred == "en"
    assert language_id.predict(nothing, model).count() == 0
    empty = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict(edges, empty).collect()} == {"und"}


def test_a_probe_returns_every_language_that_has_the_gram():
    import pandas as pd

    frame = pd.DataFrame({"lang": ["a", "a", "b"], "width": [2, 2, 2], "gram": [11, 12, 11], "share": [0.5, 0.5, 0.5]})

    class Rows:
        def select(self, *_):
            return self

        orderBy = select

        def toPandas(self):
            return frame

    model = language_id._build(Rows(), 0.1)
    mask = lambda g: int(np.bitwise_and.reduce([model.slots[p, 0] for p in language_id.probes(np.array([g], np.uint64))])[0])
    assert mask(11) == 0b11 and mask(12) == 0b01
