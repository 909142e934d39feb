"""Host-level quality rules.

Each document is tested against simple rules; failures are added up by host, the failure rate of each rule and host
is shrunk towards a beta prior fitted to all hosts, and a host loses all its documents when its rate is surely too high:
when the posterior rate, less DEVIATIONS standard deviations, is above LEAST_LIMIT and above TIMES the rate of all hosts.
Hosts that differ by chance only are all shrunk to the common rate and none is rejected.

Cases: null text has no words and fails; repeated rows count each; documents without a host get no host verdict;
an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statefold.llm.common import map_texts, materialize
from statefold.llm.textstats import IS_SYMBOL, Counted, row_sums

#: No host is rejected for a failure rate up to this, or up to so many times the rate of all hosts together.
LEAST_LIMIT, TIMES = 0.2, 2.0
#: Posterior standard deviations by which a rate has to be above the limit.
DEVIATIONS = 2.0
#: The prior's weight in documents, at most: hosts that don't differ more than by chance.
MOST_WEIGHT = 1e6
#: Copies of each host row over which its documents are dealt in the join back.
SALTS = 16


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""

    def make():
        def work(part, data, offsets):
            c = Counted(data, offsets)
            return {
                "n_words": c.n_words, "word_chars": c.word_chars, "n_symbols": row_sums(IS_SYMBOL[data], offsets),
                "n_dup_lines": c.lines()[1].astype(np.int64), "n_repeat_words": c.repeated_words(),
            }

        return work

    return map_texts(docs, make, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint", keep)


def rules() -> dict[str, Column]:
    """The document rules; a document fails a rule where it is true."""
    words = F.col("n_words")
    return {
        "short": words < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > words,
    }


def host_rates(counted: DataFrame) -> DataFrame:
    """Per host: n and, for each rule, the posterior ``rate``, its lower bound ``sure`` and the ``limit`` it is held against.

    The beta prior's mean m is the rate of all hosts' documents together. Its weight comes from moments weighted by the
    hosts' sizes: of S = sum n(p - m)^2, chance alone makes (hosts - 1) m(1 - m); what is more, by the scale
    N - sum n^2 / N - (hosts - 1), is the share r of the variance that is the hosts' own, and the weight is 1 / r - 1,
    MOST_WEIGHT if there is none. The posterior of a host with f failures has mean (f + weight m) / (n + weight).
    """
    names = list(rules())
    failed = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules().items()])
    failed = materialize(failed, "hosts")
    n = F.col("n").cast("double")
    sums = failed.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), *[F.sum(f"f_{k}").alias(f"f_{k}") for k in names], *[F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / n).alias(f"ff_{k}") for k in names]).first()
    out, total = [], float(sums["n"] or 0)
    for k in names:
        mean = sums[f"f_{k}"] / total if total else 0.0
        chance, scale = mean * (1 - mean), total - sums["nn"] / total - (sums["hosts"] - 1) if total else 0.0
        own = ((sums[f"ff_{k}"] - total * mean * mean) / chance - (sums["hosts"] - 1)) / scale if chance > 0 and scale > 0 else 0.0
        weight = min(MOST_WEIGHT, max(0.01, 1 / own - 1)) if own > 0 else MOST_WEIGHT
        rate = (F.col(f"f_{k}") + weight * mean) / (n + weight)
        sure = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + weight + 1))
        out += [rate.alias(f"rate_{k}"), sure.alias(f"sure_{k}"), F.lit(max(LEAST_LIMIT, TIMES * mean)).alias(f"limit_{k}")]
    return failed.select("source", "n", *out)


def judge(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, source, the counts, base_failed, host_failed and kept of every row of ``docs``."""
    counted = materialize(counts(docs), "rule-counts")
    bad = F.lit(False)
    for k in rules():
        bad |= F.col(f"sure_{k}") > F.col(f"limit_{k}")
    verdicts = host_rates(counted).select("source", bad.alias("host_failed"))
    # A host may hold a third of the rows: its documents meet copies of its verdict in `salts` places.
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    joined = rows.join(salted, ["source", "salt"], "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn("base_failed", base)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("salt")
