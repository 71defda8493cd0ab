"""Quality rules under weak supervision, on DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes of all documents are counted by
pattern (at most 3 to the number of rules, whatever the corpus), expectation-maximisation on these counts
estimates how often each rule is right about good and about bad documents, and a document stays if its posterior
probability of being good is high enough. No single rule decides.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward.llm.common import unused, without
from noonward.session import store

#: Word separators: blank, tab to carriage return.
GAPS = r"[ \t-\r]+"


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains; null counts as false."""

    name: str
    bad: str
    good: str


def _ratio(a: str, b: str) -> str:
    return f"{a} / greatest({b}, 1)"


RULES = (
    Rule("symbols", _ratio("n_symbols", "n_words") + " > 0.1", "n_symbols = 0"),
    Rule(
        "word_length",
        f"{_ratio('word_chars', 'n_words')} not between 3.0 and 10.0",
        f"{_ratio('word_chars', 'n_words')} between 4.0 and 7.0",
    ),
    Rule("repeated_lines", _ratio("n_dup_lines", "n_lines") + " > 0.3", "n_dup_lines = 0 and n_lines > 1"),
    Rule("repeated_words", _ratio("n_repeat_words", "n_words") + " > 0.3", _ratio("n_repeat_words", "n_words") + " < 0.1"),
    Rule("capitals", _ratio("n_upper", "n_letters") + " > 0.3", _ratio("n_upper", "n_letters") + " < 0.1"),
    Rule("letters", _ratio("n_letters", "word_chars") + " < 0.7", _ratio("n_letters", "word_chars") + " > 0.9"),
    Rule("line_ends", _ratio("n_ended_lines", "n_lines") + " < 0.3", _ratio("n_ended_lines", "n_lines") + " > 0.8"),
)

#: Least and most share of right votes on good and on bad documents.
LIMITS = ((0.55, 0.999), (0.05, 0.99))
#: Counts that `measure` adds.
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_ended_lines",
    "n_repeat_words",
    "n_upper",
    "n_letters",
)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of three that occur twice or more; `hashes` has one number per window."""

    def repeated(ordered):
        same = lambda x, i: (F.get(ordered, i - 1).h == x.h) | (F.get(ordered, i + 1).h == x.h)
        hit = F.filter(ordered, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x.i))

    def covered(places):
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n"))
        return F.aggregate(places, zero, step, lambda a: a.n)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a one-element array binds the sorted windows to a name, so that they are sorted once
    counted = F.transform(F.array(ordered), lambda o: covered(repeated(o)))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.get(counted, F.lit(0))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the COUNTS of each whole text.

    A missing text counts as empty: all counts are 0. Columns of these names are replaced; rows stay as they are,
    repeated ones too.
    """
    base = without(docs, *COUNTS)
    words, lines, hashed = (unused(base, name) for name in ("_words", "_lines", "_windows"))
    whole = F.coalesce(F.col(text), F.lit(""))
    arrays = base.withColumns(
        {
            words: F.filter(F.split(whole, GAPS), lambda w: w != ""),
            lines: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        }
    )
    windows = arrays.withColumn(
        hashed,
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    )
    glued = F.array_join(words, "")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(glued),
        "n_symbols": F.length(glued) - F.length(F.regexp_replace(glued, "[#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ended_lines": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?\"'»”…][ \t-\r]*$"))),
        "n_repeat_words": _repeat_words(F.col(hashed)),
        "n_upper": F.length(glued) - F.length(F.regexp_replace(glued, r"\p{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(glued, r"[^\p{L}]+", "")),
    }
    return windows.withColumns({c: e.cast("long") for c, e in counts.items()}).drop(words, lines, hashed)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(rule: Rule) -> Column:
    return F.expr(f"case when {rule.bad} then -1 when {rule.good} then 1 else 0 end")


@dataclass(frozen=True)
class Model:
    """Share of good documents; per rule, how often its votes are right on good and on bad documents."""

    prior: float
    right_if_good: tuple[float, ...]
    right_if_bad: tuple[float, ...]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> Model:
    """Expectation-maximisation on counted vote patterns, from the assumption that rules are mostly right.

    A rule that abstains says nothing. Most rules see one kind of bad document and call the others good, so they
    may be right about few bad documents, but must be right about most good ones. Estimates are smoothed by one
    vote and kept within limits, so that no rule turns into its opposite. Without patterns, the starting values
    remain.
    """
    n = len(patterns[0][0]) if patterns else 0
    prior, good, bad = 0.8, [0.95] * n, [0.5] * n
    ordered = sorted(patterns)
    for _ in range(rounds if patterns else 0):
        model = Model(prior, tuple(good), tuple(bad))
        weights = [(votes, count, 1 / (1 + math.exp(-log_odds(model, votes)))) for votes, count in ordered]
        total = sum(count for _, count, _ in weights)
        prior = min(0.99, max(0.01, sum(c * p for _, c, p in weights) / total))
        for i in range(n):
            of = lambda v, f: sum(c * f(p) for votes, c, p in weights if votes[i] == v)  # noqa: B023, E731
            up, down = (lambda p: p), (lambda p: 1 - p)
            shares = [(of(1, up) + 1) / (of(1, up) + of(-1, up) + 2), (of(-1, down) + 1) / (of(1, down) + of(-1, down) + 2)]
            good[i], bad[i] = (min(most, max(least, s)) for s, (least, most) in zip(shares, LIMITS))
    return Model(prior, tuple(good), tuple(bad))


def log_odds(model: Model, votes: tuple[int, ...]) -> float:
    """The logarithm of the odds that a document with these votes is good."""
    weights = {1: lambda g, b: math.log(g / (1 - b)), -1: lambda g, b: math.log((1 - g) / b), 0: lambda g, b: 0.0}
    own = (weights[v](g, b) for v, g, b in zip(votes, model.right_if_good, model.right_if_bad))
    return math.log(model.prior / (1 - model.prior)) + sum(own)


def posterior(model: Model, votes: str = "votes") -> Column:
    """The probability that a document is good, from its array of votes."""
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for i, (g, b) in enumerate(zip(model.right_if_good, model.right_if_bad)):
        v = F.get(F.col(votes), F.lit(i))
        total += F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Measured documents with votes, base_failed, p_good and kept.

    Kept are those that pass the base and whose p_good is `least` or more. All documents count in the estimates.
    The measured rows are written to the shared folder once, since they are read twice; drop what is not needed
    (texts above all) before.
    """
    voted = without(measured, "votes", "base_failed", "p_good", "kept")
    voted = store(voted.withColumns({"votes": F.array(*[vote(r) for r in rules]), "base_failed": base_failed()}))
    counted = voted.groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    model = fit([(tuple(r["votes"]), r["count"]) for r in counted])
    scored = voted.withColumn("p_good", posterior(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
