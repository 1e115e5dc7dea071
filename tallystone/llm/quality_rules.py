"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps the
measurements and one bit for each rule that failed. A policy is a versioned mask
of rules: verdicts, changes of policy and ablations are bitwise operations on
the ledger, without another look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5

#: Name and failure condition of each rule, over the measurements; a rule's place is its bit, for good.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "300 * n_capital_triples > 20 * word_chars"),
    ("exclamations", "10 * n_double_marks > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a document is rejected if it fails any of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "many_symbols", "repeated_lines", "short_words", "long_words"))
V2 = Policy("v2", (*V1.rules, "capitals", "exclamations"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda it is a variable."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the words' hashes; windows are compared by hashes of their word hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(h, i + k - 1) for k in range(WINDOW))))

    def positions(keys: Column) -> Column:
        def repeated(ranked: Column) -> Column:
            like = lambda s, j: F.coalesce(s["k"] == F.get(ranked, j)["k"], F.lit(False))
            return F.array_sort(F.transform(F.filter(ranked, lambda s, j: like(s, j - 1) | like(s, j + 1)), lambda s: s["i"]))

        return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), repeated)

    def length(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n")), lambda acc: acc["n"])

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(length(positions(keys)))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(windows(hashes), count)).cast("long")


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capital_triples, n_double_marks (long).

    Null text has no words, lines or symbols. Columns of docs with these names are replaced.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _covered).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    made = docs.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": count(r"[#*$%&|<>]"), "n_capital_triples": count("[A-ZÀ-ÖØ-Þ]{3}"), "n_double_marks": count("!!")})
    return made.withColumns({**{c: F.col("_w")[c] for c in ("n_words", "word_chars", "n_repeat_words")}, **{c: F.col("_l")[c] for c in ("n_lines", "n_dup_lines")}}).drop("_w", "_l")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their measurements and fail_bits (long): bit i is set if rule i failed.

    An empty table gives an empty ledger; repeated rows and null doc_ids are
    judged row by row. Null and empty texts have no words and fail the first rule.
    A text of any length that Spark holds in a row is measured whole, in arrays of
    its words and lines.
    """
    bits = sum((F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)), F.lit(0))
    return measurements(docs, text).withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger_: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows with kept and policy (its version)."""
    return ledger_.withColumns({"kept": passes(policy), "policy": F.lit(policy.version)})


def ablations(ledger_: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rejected by this rule alone), n_kept_without (kept if it were left out), n_kept.

    The ledger is first counted by fail_bits, at most one row for each
    combination of rules, and the rest is bitwise on those counts.
    """
    combos = ledger_.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules))).alias("r")
    each = combos.select("fail_bits", "n", rules).select("fail_bits", "n", "r.rule", "r.bit")
    of_policy = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    without = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long").bitwiseXOR(F.col("bit")))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(of_policy == F.col("bit")).alias("n_only"), total(without == 0).alias("n_kept_without"), total(of_policy == 0).alias("n_kept"))
