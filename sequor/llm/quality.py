"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything per document is a DataFrame expression. The driver sees one row per distinct vector of
votes (at most 3 ** len(RULES)) and runs expectation-maximisation over that histogram.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import cut, prepare

SPACE = r"[\x20\x09-\x0D]"
P = "_sq_"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that rules look at, under names starting with _sq_.

    Words are runs of anything but space and \\x09-\\x0D. A null text has no words. Windows of three
    words are compared by 64-bit hashes within one text.
    """
    t, w, h, o, q = (F.col(P + x) for x in ("text", "words", "hashes", "ordered", "places"))
    d = docs.withColumn(P + "text", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumns({
        P + "words": F.array_remove(F.split(t, SPACE + "+"), ""),
        P + "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        P + "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        P + "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        P + "upper": F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long"),
        P + "shouts": F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long"),
    })
    d = d.withColumns({
        P + "n_words": F.size(w).cast("long"),
        P + "n_lines": F.size(P + "lines").cast("long"),
        P + "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"),
        P + "hashes": F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))),
    })
    d = d.withColumn(P + "ordered", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    twice = lambda x, i: F.coalesce(x["h"] == F.get(o, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(o, i - 1)["h"], F.lit(False))
    d = d.withColumn(P + "places", F.sort_array(F.transform(F.filter(o, twice), lambda x: x["p"])))
    new = F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3))))
    d = d.withColumn(P + "n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    # A column that isn't deterministic keeps filters above this projection: pushed down, they would hold
    # each step's expression once for every time the next step names it.
    return d.withColumn(P + "row", F.monotonically_increasing_id()).drop(*(P + x for x in ("text", "words", "lines", "hashes", "ordered", "places")))


def m(name: str) -> Column:
    return F.col(P + name)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """name -> vote: -1 poor, 1 good, 0 abstains. Ratios are compared in integers.

    Rules about one defect vote against or abstain: lacking that defect says little. The last two
    vote for texts that show none of them.
    """
    n, no = m("n_words"), F.lit(False)
    symbols, capitals, shouting = m("n_symbols") * 10 > n, m("upper") * 2 > m("word_chars"), m("shouts") * 5 > n
    lines = (m("n_lines") >= 4) & (m("n_dup_lines") * 2 > m("n_lines"))
    repeats = m("n_repeat_words") * 100 > n * 50
    odd = (m("word_chars") < n * 3) | (m("word_chars") > n * 15)
    clean = ~(symbols | capitals | shouting | lines | repeats | odd)
    return {
        "symbols": vote(symbols, no),
        "capitals": vote(capitals, no),
        "shouting": vote(shouting, no),
        "lines": vote(lines, no),
        "repeats": vote(repeats, no),
        "word_length": vote(odd, no),
        "prose": vote(no, clean & (m("word_chars") * 2 >= n * 7) & (m("word_chars") <= n * 10)),
        "length": vote(n < 20, clean & (n >= 50)),
    }


def base_failed() -> Column:
    return (m("n_words") < 50) | (m("n_repeat_words") * 100 > m("n_words") * 50)


def fit_votes(histogram: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation for two classes and conditionally independent rules.

    Returns the log odds of the prior and, for each rule and vote, the log-likelihood ratio
    log P(vote | good) / P(vote | poor), as ((good, poor) probabilities). Starts from rules that
    seldom vote wrongly; pseudo-counts of that start, one percent of the rows, keep the
    classes from changing places and unseen votes from deciding.
    """
    total = sum(n for _, n in histogram)
    n_rules = len(histogram[0][0]) if histogram else 0
    start = {1: (0.8, 0.1), 0: (0.19, 0.5), -1: (0.01, 0.4)}
    table = [dict(start) for _ in range(n_rules)]
    prior, weight = 0.8, max(1.0, 0.01 * total)
    for _ in range(rounds):
        mass = [weight * 0.8, weight * 0.2]
        seen = [{v: [weight * 0.8 * p[0], weight * 0.2 * p[1]] for v, p in start.items()} for _ in range(n_rules)]
        for votes, n in histogram:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][v][0] / table[k][v][1]) for k, v in enumerate(votes))
            good = n / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            mass[0] += good
            mass[1] += n - good
            for k, v in enumerate(votes):
                seen[k][v][0] += good
                seen[k][v][1] += n - good
        new = mass[0] / sum(mass)
        table = [{v: (c[0] / mass[0], c[1] / mass[1]) for v, c in s.items()} for s in seen]
        if abs(new - prior) < 1e-9:
            break
        prior = min(max(new, 1e-6), 1 - 1e-6)
    return math.log(prior / (1 - prior)), table


def fit(measured: DataFrame) -> Column:
    """The posterior probability of being good, as an expression over the measures."""
    r = rules()
    counts = measured.groupBy(*(c.alias(k) for k, c in r.items())).agg(F.count(F.lit(1)).alias("n")).collect()
    odds0, table = fit_votes(sorted((tuple(x[k] for k in r), x["n"]) for x in counts))
    if not table:
        return F.lit(0.5)
    odds = F.lit(odds0)
    for (_, v), t in zip(r.items(), table, strict=True):
        ratio = {k: math.log(p[0] / p[1]) for k, p in t.items()}
        odds = odds + F.when(v == 1, F.lit(ratio[1])).when(v == -1, F.lit(ratio[-1])).otherwise(F.lit(ratio[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One narrow row per document: id, measures, quality (posterior), base_failed and kept.

    Null and empty texts fail the base rule. Ids may be null or repeat. An empty table gives an
    empty result. Measures are written once to the checkpoint folder (a few dozen bytes a row).
    """
    prepare(docs.sparkSession)
    measured = cut(measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = measured.select("*", fit(measured).alias("quality"), base_failed().alias("base_failed"))
    return out.select("doc_id", *(m(x).alias(x) for x in names), "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with all their columns, of whatever names. The texts are read twice: to fit, to filter."""
    prepare(docs.sparkSession)
    posterior = fit(measures(docs.select(F.col(text_col).alias("_text")), "_text").drop("_text"))
    whole = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return measures(whole, "_text").where((m("row") >= 0) & ~base_failed() & (posterior >= threshold)).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
