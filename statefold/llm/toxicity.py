"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the token classes of a clause, each what the one before it has written. THREATENED lets harm through
as a threat only after an intention; NEGATED and REPORTED rewrite insults and threats in their reach as MILD, which the
later ones don't take for either; AIMED and INSULTED weigh what is left by its target and by the insults before it. Their
composition is one automaton whose states are the combinations of the parts' states; its weights say what each matched
token adds to its clause. Clauses are scored, not words: the same word counts more when aimed at someone, less when negated
or reported, and the order of tokens counts. The lexicon (words and word beginnings) is learned from labelled documents
and joined to a few fixed words; a learned term that mostly follows an intention is a threat, any other an insult. The
factors are learned too, from how often matches in each context are in toxic documents, and shrunk to fixed ones; a logistic
curve turns clause sums into a score.

Cases: null and empty texts match nothing and get the score of a text without matches; a null id is scored and never
learned from; repeated rows are scored each; without labels the fixed words, factors and curve decide; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm.common import coded, held_out, kept_texts, labelled_documents, map_texts, materialize, ragged, scored_texts, strings_at, text_slices, word_spans

TRAIN_ROWS = 20_000
#: Least score of a toxic document.
THRESHOLD = 0.5
#: Learned terms, at most; lengths of word beginnings; least likelihood-ratio statistic of a term.
LEXICON, BEGINNINGS, LEAST_G = 2_000, (4, 5, 6), 16.0

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, MILD, END = range(9)
#: Fixed words of the grammar's classes, lower case.
WORDS = {
    INSULT: "idiot idiots moron morons stupid worthless pathetic clown trash disgusting scum loser losers imbecile dumbass bastard filth vermin",
    THREAT: "kill hurt destroy beat stab shoot burn strangle punch murder smash",
    INTENT: "will shall gonna going must want wanna ll",
    TARGET: "you your yourself u he she they him them her people tu te toi vous ton votre du dich dir sie ihr usted ustedes ti vosotros",
    NEGATION: "not no never nobody without isn aren wasn don doesn didn pas jamais nicht kein keine nie nunca ni",
    REPORT: "said says wrote writes quoted quote called claimed reported alleged dit sagte schrieb dijo",
}
CLASS_OF = {w: k for k, ws in WORDS.items() for w in ws.split()}
RUNS = re.compile(r"[^\W\d_]+|[.!?;:\n|\"]+")


@dataclass(frozen=True)
class Transducer:
    """next state, factor and written class of (state, class); what is not listed keeps the state (``decay`` lowers it), has factor 1 and is written as read."""

    states: int
    moves: dict[tuple[int, int], int]
    factors: dict[tuple[int, int], float] = field(default_factory=dict)
    writes: dict[tuple[int, int], int] = field(default_factory=dict)
    decay: bool = False

    def step(self, state: int, kind: int) -> tuple[int, float, int]:
        default = max(0, state - 1) if self.decay else state
        return self.moves.get((state, kind), default), self.factors.get((state, kind), 1.0), self.writes.get((state, kind), kind)


#: What a match is multiplied by in each context, before labels are seen.
CONTEXTS = {"threatened": 2.0, "negated": 0.4, "reported": 0.6, "aimed": 1.5, "second": 1.2, "third": 1.4}
#: What a target adds that comes after an unaimed insult or threat.
LATE_TARGET = 0.3


def parts(factor: dict[str, float]) -> tuple[Transducer, ...]:
    """The grammar's transducers in the order in which they read each other."""
    hit = (INSULT, THREAT)
    # A threat is harm within three tokens after an intention; harm alone counts nothing and is written as any word.
    threatened = Transducer(4, {(s, INTENT): 3 for s in range(4)}, {(0, THREAT): 0.0} | {(s, THREAT): factor["threatened"] for s in (1, 2, 3)}, {(0, THREAT): OTHER}, decay=True)
    # A negation reaches over the three tokens after it.
    negated = Transducer(4, {(s, NEGATION): 3 for s in range(4)}, {(s, k): factor["negated"] for s in (1, 2, 3) for k in hit}, {(s, k): MILD for s in (1, 2, 3) for k in hit}, decay=True)
    reported = Transducer(2, {(s, REPORT): 1 for s in range(2)}, {(1, k): factor["reported"] for k in hit}, {(1, k): MILD for k in hit})
    # State 1: a target has been named. State 2: something has been said of nobody, which a target may still take.
    moves = {(s, TARGET): 1 for s in range(3)} | {(0, k): 2 for k in hit}
    aimed = Transducer(3, moves, {(1, k): factor["aimed"] for k in hit} | {(0, TARGET): 0.0, (1, TARGET): 0.0})
    insulted = Transducer(3, {(0, INSULT): 1, (1, INSULT): 2, (2, INSULT): 2}, {(1, INSULT): factor["second"], (2, INSULT): factor["third"]})
    return threatened, negated, reported, aimed, insulted


@dataclass(frozen=True)
class Automaton:
    move: np.ndarray
    factor: np.ndarray
    states: tuple[tuple[int, ...], ...]


def compose(*chain: Transducer) -> Automaton:
    """The composition over all token classes: each part reads what the part before it has written; factors multiply."""
    states = tuple(product(*[range(p.states) for p in chain]))
    index = {s: i for i, s in enumerate(states)}
    move, factor = np.zeros((len(states), END), np.int64), np.ones((len(states), END))
    for s in states:
        for kind in range(END):
            reads, to = kind, []
            for p, x in zip(chain, s, strict=True):
                x, w, reads = p.step(x, reads)
                to.append(x)
                factor[index[s], kind] *= w
            move[index[s], kind] = index[tuple(to)]
    return Automaton(move, factor, states)


def grammar(factor: dict[str, float]) -> Automaton:
    return compose(*parts(factor))


def context_of(state: tuple[int, ...], kind: int) -> str:
    """The context that says most about a match in a state of the composition: one of CONTEXTS, "plain" or "" for no match."""
    threatened, negated, reported, aimed, insulted = state
    if kind == THREAT and not threatened:
        return ""
    for name, there in (("negated", negated), ("reported", reported), ("threatened", kind == THREAT), ("aimed", aimed == 1), ("third", insulted == 2), ("second", insulted == 1)):
        if there:
            return name
    return "plain"


@dataclass(frozen=True)
class Model:
    terms: dict[str, tuple[int, float]]  # class and weight of learned words and, ending in "*", word beginnings
    curve: np.ndarray  # weights of the document's numbers, then the constant
    automaton: Automaton


def class_of(word: str, terms: dict[str, tuple[int, float]]) -> tuple[int, float]:
    """Class and weight of a lower-case word: learned whole words first, then fixed words, then the longest learned beginning."""
    if (found := terms.get(word)) is not None:
        return found
    if (kind := CLASS_OF.get(word)) is not None:
        return kind, {INSULT: 1.0, THREAT: 1.0, TARGET: LATE_TARGET}.get(kind, 0.0)
    for n in sorted(BEGINNINGS, reverse=True):
        if len(word) >= n and (found := terms.get(word[:n] + "*")) is not None:
            return found
    return OTHER, 0.0


def score_clause(tokens: list[tuple[int, float]], automaton: Automaton) -> float:
    """What the automaton adds up over a clause. A target adds only after an insult or threat that had none."""
    state, total = 0, 0.0
    for kind, weight in tokens:
        if weight and (kind != TARGET or automaton.states[state][3] == 2):
            total += weight * automaton.factor[state, kind]
        state = automaton.move[state, kind]
    return total


#: Of a document: log of the clause sum, largest clause, matched clauses to a hundred words, whether any.
NUMBERS = 4


def clause_numbers(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    code, words = coded(strings_at(data, starts, ends))
    pieces, hot = [], np.zeros(len(words), bool)
    for i, w in enumerate(words.to_pylist()):
        made = [(END, 0.0) if not r[0].isalpha() else class_of(r, model.terms) for r in RUNS.findall(w.lower())]
        hot[i] = any(k in (INSULT, THREAT) for k, _ in made)
        pieces.append(made)
    breaks = np.zeros(len(data) + 1, np.int64)  # a line ends a clause
    np.cumsum(data == 10, out=breaks[1:])
    line = breaks[starts]
    out = np.zeros((n, NUMBERS))
    words_of = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(words_of)))
    for r in np.unique(row[hot[code]]) if len(code) else ():
        clauses, clause, use, before = [], [], False, -1
        for at in range(first[r], first[r + 1]):
            if line[at] != before:
                clauses += [clause] if use else []
                clause, use, before = [], False, line[at]
            for token in pieces[code[at]]:
                if token[0] == END:
                    clauses += [clause] if use else []
                    clause, use = [], False
                else:
                    clause.append(token)
                    use |= token[0] in (INSULT, THREAT)
        clauses += [clause] if use else []
        scores = [s for c in clauses if (s := score_clause(c, model.automaton)) > 0]
        if scores:
            out[r] = np.log1p(sum(scores)), max(scores), min(10.0, 100 * len(scores) / words_of[r]), 1.0
    return out


def term_counts(sample: DataFrame) -> DataFrame:
    """term, tox, clean: labelled documents with the term, by label."""

    def run(batches):
        for part, data, offsets in text_slices(batches):
            y = part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            starts, ends, row = word_spans(data, offsets)
            code, words = coded(strings_at(data, starts, ends))
            ids: dict[str, int] = {}
            of = [{ids.setdefault(t, len(ids)) for r in RUNS.findall(w.lower()) if r[0].isalpha() for t in (r, *(r[:n] + "*" for n in BEGINNINGS if len(r) >= n))} for w in words.to_pylist()]
            sizes = np.fromiter(map(len, of), np.int64, len(of))
            flat = np.fromiter((t for s in of for t in s), np.int64, int(sizes.sum()))
            pair = np.unique(row.astype(np.int64) << 31 | code)
            doc, word = pair >> 31, pair & ((1 << 31) - 1)
            begin = np.cumsum(sizes) - sizes
            key = np.unique(np.repeat(doc, sizes[word]) << 31 | flat[ragged(begin[word], sizes[word])])
            doc, term = key >> 31, key & ((1 << 31) - 1)
            tox = np.bincount(term, y[doc], len(ids)).astype(np.int64)
            every = np.bincount(term, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(tox), pa.array(every - tox)], ["term", "tox", "clean"])

    return sample.mapInArrow(run, "term string, tox bigint, clean bigint").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))


def clauses_of(text: str, terms: dict[str, tuple[int, float]]) -> Iterable[list[tuple[str, int, float]]]:
    """(word, class, weight) of each clause of a text, one token after the other."""
    clause: list[tuple[str, int, float]] = []
    for run in RUNS.findall(text.lower()):
        if run[0].isalpha():
            clause.append((run, *class_of(run, terms)))
        elif clause:
            yield clause
            clause = []
    if clause:
        yield clause


def context_counts(sample: DataFrame, terms: dict[str, tuple[int, float]]) -> DataFrame:
    """what, name, y, n: matches of labelled documents by context, and occurrences of learned terms, of which after an intention."""
    chain = grammar(CONTEXTS)

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for text, y in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("y")).to_pylist(), strict=True):
                for clause in clauses_of(text or "", terms):
                    state, intent = 0, 0
                    for word, kind, _ in clause:
                        if kind in (INSULT, THREAT):
                            if context := context_of(chain.states[state], kind):
                                n["context", context, y] += 1
                            for term in (word, *(word[:k] + "*" for k in BEGINNINGS)):
                                if term in terms:
                                    n["intended" if intent else "other", term, y] += 1
                        state, intent = chain.move[state, kind], 3 if kind == INTENT else max(0, intent - 1)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(n.values()), pa.int64())], ["what", "name", "y", "n"])

    return sample.select("text", "y").mapInArrow(run, "what string, name string, y int, n bigint").groupBy("what", "name", "y").agg(F.sum("n").alias("n"))


#: Matches of a context that weigh as much as its fixed factor.
PRIOR_MATCHES = 20


def fit_factors(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Each context's factor: the share of its matches that are in toxic documents, against plain matches, shrunk to the fixed factor."""
    share = lambda c: (counts.get((c, 1), 0) + 0.5) / (counts.get((c, 0), 0) + counts.get((c, 1), 0) + 1)
    out = {}
    for name, fixed in CONTEXTS.items():
        n = counts.get((name, 0), 0) + counts.get((name, 1), 0)
        out[name] = float(np.clip((PRIOR_MATCHES * fixed + n * fixed * share(name) / share("plain")) / (PRIOR_MATCHES + n), 0.0, 3.0))
    return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, lexicon: int = LEXICON) -> Model:
    """Lexicon, factors and curve for ``labels.toxic``, from at most ``bound`` labelled rows outside fold 0 of 5."""
    sample = materialize(labelled_documents(docs, labels, "toxic", bound), "labelled")
    size = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = size["t"] or 0, size["n"] - (size["t"] or 0)
    terms: dict[str, tuple[int, float]] = {}
    factors = CONTEXTS
    if toxic and clean:
        a, b = F.col("tox"), F.col("clean")
        log = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        expect = (a + b) / (toxic + clean)
        g = 2 * (log(a, expect * toxic) + log(b, expect * clean))
        odds = F.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
        found = term_counts(sample).where((a >= 3) & (odds > 1.5)).withColumn("g", g).withColumn("odds", odds).where(F.col("g") >= LEAST_G)
        rows = found.orderBy(F.desc("g"), "term").limit(lexicon).collect()
        fixed = {w: k for w, k in CLASS_OF.items() if k != INSULT}  # the grammar's own words keep their class
        terms = {r["term"]: (INSULT, float(min(r["odds"], 5.0) / 3)) for r in rows if r["term"] not in fixed}
        counted = context_counts(sample, terms).collect()  # of CONTEXTS and LEXICON terms at most
        factors = fit_factors({(r["name"], r["y"]): r["n"] for r in counted if r["what"] == "context"})
        seen = Counter({(r["what"], r["name"]): r["n"] for r in counted if r["y"] == 1 and r["what"] != "context"})
        terms = {t: (THREAT if seen["intended", t] > max(2, seen["other", t]) else k, w) for t, (k, w) in terms.items()}
    model = Model(terms, np.zeros(0), grammar(factors))
    rows = numbers(sample, model, ("doc_id", "y")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows.numbers.tolist(), np.float64).reshape(len(rows), NUMBERS)
    return Model(terms, fit_curve(x, rows.y.to_numpy(np.float64)), model.automaton)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; a fixed curve when there are not both labels."""
    if not len(y) or y.min() == y.max():
        return np.array([1.0, 1.0, 0.1, 0.5, -3.0])
    design, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(NUMBERS + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(NUMBERS + 1)
        w = w + np.linalg.solve(hess, design.T @ (y - p) - ridge * w)
    return w


def numbers(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def make():
        return lambda part, data, offsets: {"numbers": list(clause_numbers(data, offsets, model))}

    return map_texts(docs, make, "numbers array<double>", keep)


def scorer(docs: DataFrame, model: Model):
    """What a task needs to score slices of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON terms and the automaton

    def make():
        m = shared.value
        return lambda data, offsets: 1 / (1 + np.exp(-np.clip(clause_numbers(data, offsets, m) @ m.curve[:-1] + m.curve[-1], -30, 30)))

    return make


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = scored_texts(docs, scorer(docs, model), threshold)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, with all their columns."""
    return kept_texts(docs, scorer(docs, model), lambda p: p < threshold)
