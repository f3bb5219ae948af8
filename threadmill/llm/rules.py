"""Quality rules by weak supervision (DataFrame functions only).

Every rule votes on a document or abstains. A rule looks for one symptom and votes bad, or for one sign of running text and votes
good; it never votes both ways, since the lack of a symptom says nothing about junk of another kind. Borders are ordinary ones, not fitted
to a corpus: some rules fire on good documents too. The documents' vote patterns are counted over the whole table;
expectation-maximisation on those counts estimates the share of good documents and, for each rule, how often it fires on the class
it votes for and on the other one. The posterior probability of "good" then replaces an all-must-pass filter: a vote weighs the logarithm
of its two rates' ratio, an abstention nothing, and a document without votes has the estimated share of good ones.

A pattern is a set of rules that fired, so there are at most 2 ** len(RULES) of them whatever the corpus, and the
counts that the driver works on are bounded. The posterior is a sum of weights in one projection.

Edge cases: a null or empty text has no words and fails the base rules; an empty table gives no rows; extra
columns are ignored; repeated rows are judged alike and each counts in the estimates; very long texts are measured whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 8
BAD, GOOD = 0, 1
BLANKS = " \t\n\x0b\f\r"
#: Before any vote is seen: share of good documents, how often a rule fires on its class and on the other; worth PRIOR documents. EM rounds.
BALANCE, FIRES, MISFIRES, PRIOR, ROUNDS = 0.7, 0.3, 0.02, 20.0, 60


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[int, Column]]:
    """Name to (the vote, when it is cast), over the columns of :func:`measure`."""
    symbols, upper, twins = _ratio("n_symbols", "n_words"), _ratio("n_upper", "word_chars"), _ratio("n_twin_words", "n_words")
    repeat, lines, ended = _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_ended_lines", "n_lines")
    variety, length, shouts = _ratio("n_distinct_words", "n_words"), _ratio("word_chars", "n_words"), _ratio("n_shouts", "n_words")
    plain, many = _ratio("n_plain_words", "n_words"), F.col("n_lines") >= 4
    return {
        "symbols": (BAD, symbols > 0.1),
        "capitals": (BAD, upper > 0.3),
        "repeats": (BAD, repeat > 0.25),
        "brief": (BAD, F.col("n_words") < 50),
        "lines": (BAD, many & (lines > 0.2)),
        "variety": (BAD, ((variety < 0.3) & (F.col("n_words") < 2000)) | (variety < 0.1)),
        "length": (BAD, (length < 3) | (length > 10)),
        "shouts": (BAD, shouts > 0.1),
        "twins": (BAD, twins > 0.08),
        "shapes": (BAD, plain < 0.6),
        "endings": (BAD, many & (ended < 0.5)),
        "words": (GOOD, (plain >= 0.9) & length.between(3.5, 8)),
        "layout": (GOOD, (ended >= 0.9) & (lines <= 0.1)),
        "flow": (GOOD, (repeat <= 0.15) & (twins <= 0.05) & (variety >= 0.3)),
        "calm": (GOOD, (symbols <= 0.02) & (upper <= 0.15) & (shouts <= 0.05)),
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text. Windows of eight words are compared by a 64-bit hash of their words."""
    space = "[\\x09-\\x0D\\x20]+"
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", space), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x09-\\x0D\\x20]")))
    # a run of letters with at most one mark behind it, between blanks
    plain = "(?<![^\\x09-\\x0D\\x20])\\p{L}++[.,;:!?]?(?![^\\x09-\\x0D\\x20])"
    d = d.select(
        "doc_id", F.size("_w").alias("n_words"), F.char_length(F.array_join("_w", "")).alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).alias("n_symbols"), lines.alias("_l"),
        F.regexp_count("_t", F.lit("\\p{Lu}")).alias("n_upper"), F.regexp_count("_t", F.lit("!")).alias("n_shouts"),
        F.regexp_count("_t", F.lit(plain)).alias("n_plain_words"),
        F.size(F.array_distinct("_w")).alias("n_distinct_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, WINDOW))))
    d = d.withColumn("_g", F.coalesce(window, F.array().cast("array<bigint>")))
    # sorted (hash, place): equal windows stand side by side
    pairs = F.array_sort(F.arrays_zip(F.col("_g").alias("g"), F.sequence(F.lit(0), F.greatest(F.size("_g") - 1, F.lit(0))).alias("p")))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    same = lambda i, j: F.try_element_at("_s", i)["g"] == F.try_element_at("_s", j)["g"]
    twice = F.filter("_s", lambda x, i: F.coalesce(same(i + 1, i + 2), F.lit(False)) | (F.when(i > 0, same(i + 1, i)).otherwise(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(
        (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    twin = F.filter("_h", lambda h, i: h == F.get("_h", i - 1))
    ended = F.filter("_l", lambda x: F.right(F.rtrim(x, F.lit(BLANKS)), F.lit(1)).isin(*'.!?:;"'))
    counts = ("n_words", "word_chars", "n_symbols", "n_upper", "n_shouts", "n_plain_words", "n_distinct_words")
    return d.select(
        "doc_id", *(F.col(c).cast("long") for c in counts), F.size(twin).cast("long").alias("n_twin_words"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(ended).cast("long").alias("n_ended_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


@dataclass
class Estimate:
    """Share of good documents, and for each rule how often it fires on the class it votes for and on the other."""

    good: float
    fires: list[float]
    misfires: list[float]

    def weights(self, votes: list[int]) -> list[float]:
        """What a vote of each rule adds to the log odds of "good"."""
        return [math.log(a / b) * (1 if v == GOOD else -1) for v, a, b in zip(votes, self.fires, self.misfires)]

    @property
    def odds(self) -> float:
        return math.log(self.good / (1 - self.good))

    def posterior(self, fired: int, votes: list[int]) -> float:
        z = self.odds + sum(w for j, w in enumerate(self.weights(votes)) if fired >> j & 1)
        return 1 / (1 + math.exp(-z))


def estimate(counts: dict[int, int], votes: list[int], rounds: int = ROUNDS) -> Estimate:
    """EM from the counts of patterns (bit j: rule j fired)."""
    e = Estimate(BALANCE, [FIRES] * len(votes), [MISFIRES] * len(votes))
    for _ in range(rounds):
        good = {c: e.posterior(c, votes) for c in counts}
        n_good = sum(n * good[c] for c, n in counts.items())
        n_bad = sum(counts.values()) - n_good
        fires, misfires = [], []
        for j, v in enumerate(votes):
            on_good = sum(n * good[c] for c, n in counts.items() if c >> j & 1)
            on_bad = sum(n * (1 - good[c]) for c, n in counts.items() if c >> j & 1)
            own, other = ((on_good, n_good), (on_bad, n_bad)) if v == GOOD else ((on_bad, n_bad), (on_good, n_good))
            fires.append((own[0] + FIRES * PRIOR) / (own[1] + PRIOR))
            misfires.append((other[0] + MISFIRES * PRIOR) / (other[1] + PRIOR))
        e = Estimate((n_good + BALANCE * PRIOR) / (n_good + n_bad + PRIOR), fires, misfires)
    return e


def supervise(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The measures, base_failed, the fired rules as bits, the posterior of "good" and kept of every row of ``docs``."""
    d = measure(docs)
    cast = rules()
    votes = [v for v, _ in cast.values()]
    fired = sum((F.when(c, 1 << j).otherwise(0) for j, (_, c) in enumerate(cast.values())), F.lit(0))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = staged(d.withColumn("base_failed", base).withColumn("pattern", fired.cast("int")), "rule-measures")
    counts = {r["pattern"]: r["n"] for r in d.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    e = estimate(counts, votes)
    z = sum((F.when(F.col("pattern").bitwiseAND(F.lit(1 << j)) != 0, w).otherwise(0.0) for j, w in enumerate(e.weights(votes))), F.lit(e.odds))
    return d.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op7(docs: DataFrame) -> DataFrame:
    return supervise(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def base_measures(docs: DataFrame) -> DataFrame:
    """The measures of the base rules alone, which have a SQL form."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_twin_words", base.alias("base_failed"))


BASE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM g JOIN (SELECT rid, s FROM g GROUP BY rid, s HAVING count(*) > 1) USING (rid, s)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
   len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_twin_words FROM d JOIN l USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""
