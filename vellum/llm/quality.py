"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  How often each rule votes
which way on good and bad documents, and so its accuracy, and the share of good documents are estimated from the agreement of the votes by expectation
maximisation; a document is kept if its posterior probability of being good is at least one
half.  The votes are reduced to the counts of their patterns (3 to the number of rules at
most, whatever the corpus), so the estimation itself is a few sums over that small table.

Defined cases: a null, empty or blank text has no words (all counts zero) and fails the base
rules; repeated rows get equal results; a null doc_id is returned as it is; columns besides
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
EM_ROUNDS = 50
#: Votes of each kind that a rule is taken to have cast on each class before any is seen.
IMAGINED = 0.5


def signals(docs: DataFrame) -> DataFrame:
    """Counts of every whole text.

    A word belongs to a repeated window if one of the three-word windows over it is found
    twice in the text.  Sorting the windows' hashes with their places puts equal windows side by side; neighbours
    with one hash are compared by their words.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    words = text.select("doc_id", "t", F.expr(words_column("t")).alias("w"))
    sized = words.select("doc_id", "t", "w", F.size("w").cast("long").alias("n_words"), F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    packed = sized.select(
        "doc_id", "t", "w", "n_words",
        F.expr("sort_array(transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> struct(xxhash64(x, h[i + 1], h[i + 2]) as h, i as i)))").alias("s"),
    )
    same = "(s[{0}].h = x.h and w[s[{0}].i] = w[x.i] and w[s[{0}].i + 1] = w[x.i + 1] and w[s[{0}].i + 2] = w[x.i + 2])"
    twice = packed.select(
        "doc_id", "t", "n_words",
        F.expr(f"sort_array(transform(filter(s, (x, i) -> (i > 0 and {same.format('i - 1')}) or (i + 1 < size(s) and {same.format('i + 1')})), x -> cast(x.i as bigint)))").alias("at"),
    )
    lines = "filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return twice.select(
        "doc_id",
        "n_words",
        F.expr("cast(char_length(regexp_replace(t, '[\\\\x20\\\\x09-\\\\x0D]+', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(char_length(t) - char_length(translate(t, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.expr(f"transform(array({lines}), x -> cast(size(x) - size(array_distinct(x)) as bigint))[0]").alias("n_dup_lines"),
        F.expr("aggregate(at, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last))).n").alias("n_repeat_words"),
        F.expr("cast(char_length(t) - char_length(regexp_replace(t, '[\\\\p{Lu}]+', '')) as bigint)").alias("n_upper"),
        F.expr("cast(char_length(regexp_replace(t, '[^\\\\p{L}]+', '')) as bigint)").alias("n_letters"),
        F.expr("cast(char_length(t) - char_length(translate(t, '!?', '')) as bigint)").alias("n_shouts"),
    )


#: Each rule's conditions for a bad and for a good vote over the columns of ``signals``; SQL of both engines.
RULES = {
    "symbols": ("n_symbols * 50 > word_chars", "n_symbols * 500 <= word_chars"),
    "letters": ("n_letters * 100 < word_chars * 85", "n_letters * 100 >= word_chars * 95"),
    "word_length": ("word_chars < n_words * 4 or word_chars > n_words * 7", "word_chars * 10 >= n_words * 46 and word_chars * 10 <= n_words * 56"),
    "length": ("n_words < 60", "n_words >= 100"),
    "capitals": ("n_upper * 10 > word_chars", "false"),
    "repeats": ("n_repeat_words * 5 > n_words", "false"),
    "lines": ("n_dup_lines * 40 > n_words", "false"),
    "shouting": ("n_shouts * 50 > n_words", "false"),
}


def rules() -> dict[str, Column]:
    """Each rule's vote over the columns of ``signals``.

    Each looks at evidence of its own, none at the others' votes.  What ordinary prose has in measure (letters, the length of words
    and texts, few symbols) is voted on both ways with a gap between where the rule abstains; that a
    text does not shout or repeat itself says little, so these rules vote bad or abstain.
    """
    return {k: F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for k, (bad, good) in RULES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


Rates = list[dict[int, tuple[float, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, Rates]:
    """Share of good documents and, for each rule, how often it casts each vote on good and on bad ones.

    ``patterns`` has each vote pattern with its number of documents.  Starts from the
    majority of the votes, which settles which of the two classes is the good one; a few
    imagined votes keep every rate off zero.
    """
    patterns = sorted(patterns)
    good = [1.0 if sum(v) > 0 else 0.0 if sum(v) < 0 else 0.5 for v, _ in patterns]
    total, share, rates = sum(n for _, n in patterns), 0.5, []
    for _ in range(EM_ROUNDS):
        on_good, on_bad = (sum(g * n for g, (_, n) in zip(good, patterns, strict=True)), sum((1 - g) * n for g, (_, n) in zip(good, patterns, strict=True)))
        share = (on_good + 1) / (total + 2)
        rates = []
        for r in range(len(patterns[0][0])):
            cast = {v: [0.0, 0.0] for v in (-1, 0, 1)}
            for g, (votes, n) in zip(good, patterns, strict=True):
                cast[votes[r]][0] += g * n
                cast[votes[r]][1] += (1 - g) * n
            rates.append({v: ((a + IMAGINED) / (on_good + 3 * IMAGINED), (b + IMAGINED) / (on_bad + 3 * IMAGINED)) for v, (a, b) in cast.items()})
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(v, share, rates))))) for v, _ in patterns]
    return share, rates


def told(rate: dict[int, tuple[float, float]], vote: int) -> float:
    """Log odds that a vote adds.

    Abstaining adds nothing, and a rule that comes out less than even, so that its votes would count the other way
    round, is not heard on that side.
    """
    if vote == 0:
        return 0.0
    odds = math.log(rate[vote][0] / rate[vote][1])
    return max(0.0, odds) if vote > 0 else min(0.0, odds)


def log_odds(votes: tuple[int, ...], share: float, rates: Rates) -> float:
    return math.log(share / (1 - share)) + sum(told(r, v) for v, r in zip(votes, rates, strict=True))


def accuracies(share: float, rates: Rates) -> dict[str, float]:
    """Probability that a rule is right where it votes."""
    out = {}
    for name, r in zip(rules(), rates, strict=True):
        right = share * r[1][0] + (1 - share) * r[-1][1]
        out[name] = right / (right + share * r[-1][0] + (1 - share) * r[1][1])
    return out


def posterior(share: float, rates: Rates) -> Column:
    """Probability of being good, as a column over the rules' vote columns."""
    odds: Column = F.lit(math.log(share / (1 - share)))
    for name, rate in zip(rules(), rates, strict=True):
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote > 0, told(rate, 1)).when(vote < 0, told(rate, -1)).otherwise(0.0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def scored(docs: DataFrame) -> DataFrame:
    """One row a document: counts, votes, posterior ``p_good`` and the verdict ``good``.

    The counts are written once and read twice, by the estimation and by the result.
    """
    seen = staged(signals(docs), "quality-signals").withColumns({f"vote_{k}": v for k, v in rules().items()})
    names = [f"vote_{k}" for k in rules()]
    patterns = [(tuple(r[:-1]), r[-1]) for r in seen.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    if not patterns:
        return seen.withColumns({"p_good": F.lit(0.5), "good": F.lit(True)})
    return seen.withColumn("p_good", posterior(*estimate(patterns))).withColumn("good", F.col("p_good") >= 0.5)
