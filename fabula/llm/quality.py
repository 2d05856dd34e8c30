"""Weak supervision for text quality, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation
maximisation over the counts of vote patterns estimates how often each rule is
right and how common good documents are; a document's posterior probability then
decides, instead of a demand that all rules pass.

Defined cases: a null, empty or blank text has no words, so its statistics are 0
and it fails the base rule. Repeated rows and null ids are judged like any other
row. An empty table gives an empty result and the prior accuracies. Only the id
and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.cluster import materialize

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"  # as a class of a regular expression; none needs an escape but "&" must stay single
#: Frequent function words of several languages: enough that running text of any of them has some.
FUNCTION_WORDS = (
    "the of and to in that is was for it with as on be at by this from or an are not have but "
    "der die das und ist nicht ein eine zu den mit von im für auf sich dem des als auch "
    "le la les et des un une dans que qui pour est en du au par sur pas avec "
    "el los las y del se por con para una su al lo como más es "
    "il che di e non per sono o os um uma não de het een van"
).split()
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "shouting", "function_words", "sentences", "variety", "letters")


def _count(chars: str) -> Column:
    """Characters of a class in the text; a class is scanned far faster than translated."""
    return F.regexp_count("t", F.lit(f"[{chars}]")).cast("long")


def _hash_pairs(col: str, step: int) -> Column:
    """Each element hashed with the one ``step`` later, for as many as have one."""
    c = F.col(col)
    n = F.greatest(F.size(c) - step, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts; all in the row, without any shuffle.

    Repeated 8-word windows are found from window hashes built by doubling (pairs,
    fours, eights). Only texts that have one twice are sorted by (hash, position).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.btrim(text, F.lit(BLANKS)).alias("trimmed"))
    d = base.select(
        "doc_id",
        "t",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[ \\x09-\\x0D]+")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - _count("\\x20\\x09-\\x0D")).alias("word_chars"),
        _count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("A-ZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ").alias("n_capitals"),
        _count("!?").alias("n_marks"),
        _count("\\p{L}").alias("n_letters"),
        _count(".!?;:").alias("n_stops"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for step in (1, 2, 4):
        d = d.withColumn("h", _hash_pairs("h", step))
    again = F.size(F.array_distinct("h")) < F.size("h")
    empty = F.array().cast("array<struct<h:bigint,at:int>>")
    d = d.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).otherwise(empty)).drop("h")
    same = lambda s, i, k: F.coalesce(F.get("s", i + k)["h"] == s["h"], F.lit(False))
    hit = F.transform("s", lambda s, i: F.when(((i > 0) & same(s, i, -1)) | same(s, i, 1), s["at"]))
    d = d.withColumn("at", F.sort_array(F.filter(hit, lambda x: x.isNotNull()))).drop("s")
    start = F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> list[Column]:
    """The rules, in the order of RULES; each abstains between its two bounds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    return [
        vote((F.col("n_words") >= 50) & (F.col("n_words") <= 100_000), F.col("n_words") < 20),
        vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 15)),
        vote(F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 10 > n),
        vote(F.col("n_dup_lines") * 20 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        vote(F.col("n_repeat_words") * 20 <= n, F.col("n_repeat_words") * 5 > n),
        vote(F.col("n_capitals") * 10 <= chars, F.col("n_capitals") * 10 > chars * 3),
        vote(F.col("n_marks") * 50 <= n, F.col("n_marks") * 5 > n),
        vote(F.col("n_function_words") >= 3, (F.col("n_function_words") == 0) & (F.col("n_words") >= 20)),
        vote((F.col("n_stops") > 0) & (F.col("n_stops") * 2 <= n), (F.col("n_stops") == 0) & (F.col("n_words") >= 50)),
        vote(F.col("n_distinct_words") * 3 >= n, F.col("n_distinct_words") * 6 < n),
        vote(F.col("n_letters") * 20 >= chars * 18, F.col("n_letters") * 20 < chars * 17),
    ]


@dataclass
class VoteModel:
    """How rules vote on good and on bad documents, and the share of good ones.

    ``good[j]`` and ``bad[j]`` are the probabilities of the votes (-1, 0, 1) of rule j on
    a document of that kind. How right a bad vote is and how right a good one is are
    two things: most rules are content with most bad documents.
    """

    prior: float = 0.8
    good: list[list[float]] = field(default_factory=lambda: [[0.03, 0.12, 0.85]] * len(RULES))
    bad: list[list[float]] = field(default_factory=lambda: [[0.35, 0.15, 0.5]] * len(RULES))

    def weights(self, j: int) -> list[float]:
        """Log-odds that votes of -1, 0 and 1 of rule j add; abstaining adds nothing."""
        w = [math.log(g / b) for g, b in zip(self.good[j], self.bad[j], strict=True)]
        return [min(0.0, w[0]), 0.0, max(0.0, w[2])]

    def log_odds(self, pattern: list[int]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weights(j)[v + 1] for j, v in enumerate(pattern))

    def accuracy(self, j: int) -> tuple[float, float]:
        """How often a good, and a bad, vote of rule j is right."""
        p = self.prior
        right = lambda k: p * self.good[j][k] / (p * self.good[j][k] + (1 - p) * self.bad[j][k])
        return right(2), 1 - right(0)


def fit_votes(patterns: DataFrame, rounds: int = 100) -> VoteModel:
    """Expectation maximisation over counted vote patterns.

    ``patterns`` has at most 3 ** len(RULES) = 177,147 rows whatever the corpus, each
    an array of votes and a count, so it may come to the driver. A bad vote never
    speaks for a document and a good one never against it, so the two kinds keep
    their meaning.
    """
    rows = [(list(r["pattern"]), r["n"]) for r in patterns.collect()]
    model = VoteModel()
    total = sum(n for _, n in rows)
    if not total:
        return model
    for _ in range(rounds):
        counts = [[[1.0, 1.0, 1.0] for _ in RULES] for _ in range(2)]
        mass = 0.0
        weights = [model.weights(j) for j in range(len(RULES))]
        base = math.log(model.prior / (1 - model.prior))
        for pattern, n in rows:
            odds = base + sum(weights[j][v + 1] for j, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            mass += p * n
            for j, v in enumerate(pattern):
                counts[0][j][v + 1] += p * n
                counts[1][j][v + 1] += (1 - p) * n
        share = [[[x / sum(c) for x in c] for c in kind] for kind in counts]
        new = VoteModel(min(0.98, max(0.02, mass / total)), *share)
        moved = max(abs(a - b) for old, now in ((model.good, new.good), (model.bad, new.bad)) for x, y in zip(old, now, strict=True) for a, b in zip(x, y, strict=True))
        model = new
        if moved < 1e-7:
            break
    return model


def posterior(model: VoteModel, votes_col: str = "votes") -> Column:
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j in range(len(RULES)):
        against, _, favour = model.weights(j)
        vote = F.col(votes_col)[j]
        odds = odds + F.when(vote > 0, favour).when(vote < 0, against).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict per document. Documents that fail the base
    rule are decided already, so votes are weighed on the others.

    The narrow statistics are written once (about 100 bytes a document), so texts are
    read once: first the patterns are counted, then every row gets its posterior.
    """
    stats = text_statistics(docs, id_col, text_col).withColumn("votes", F.array(*votes()))
    stats = materialize(stats, "quality")
    model = fit_votes(stats.where(~base_failed()).groupBy(F.col("votes").alias("pattern")).agg(F.count("*").alias("n")))
    failed = base_failed()
    return stats.withColumns({"base_failed": failed, "posterior": posterior(model)}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
