"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores what was measured and one
bit for each rule that failed. A policy is a named, versioned mask over those bits, so
a new policy, or the effect of leaving out one rule, needs the ledger alone and no text.

Only column expressions run here. Measurements of a document:

* a null or empty text has no words, all measurements 0, and fails ``few_words``;
* repeated rows are judged one by one; other columns of the input are not read;
* very long texts cost O(n log n) in their words.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"

# (rule, what fails it); the place in the list is the bit. Append only: stored ledgers
# keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)

POLICIES: Mapping[str, Sequence[str]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": tuple(name for name, _ in RULES),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, also where a lambda inside uses it often."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that stands twice or more in the text."""

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(3), places[i + 1] - p)).otherwise(3),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def same(pairs: Column) -> Column:
        near = lambda i: F.get(pairs, i)["h"]  # noqa: E731  null outside
        found = F.filter(
            pairs, lambda p, i: F.coalesce(near(i - 1) == p["h"], F.lit(False)) | F.coalesce(near(i + 1) == p["h"], F.lit(False))
        )
        return _let(F.sort_array(F.transform(found, lambda p: p["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), same))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, windows))


def measure(text: Column) -> Column:
    """A struct of measurements of the whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))

    def fields(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
                ),
            ).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    return _let(F.filter(F.split(whole, GAP), lambda w: w != ""), fields)


def ledger(docs: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (bit i: rule i failed), one row per row."""
    measured = docs.select("doc_id", measure(F.col("text")).alias("m")).select(
        "doc_id",
        *[F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols")],
        F.col("m.lines.n").alias("n_lines"),
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.n_repeat_words"),
    )
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, test) in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def mask(policy: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> int:
    """The bits of a policy's rules."""
    place = {name: i for i, (name, _) in enumerate(rules)}
    return sum(1 << place[name] for name in set(policy))


def passes(policy: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0


def only_rule(policy: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The one rule without which a ledger row would pass a policy; null where it passes, or fails
    two or more."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(policy, rules)))
    names = [F.when(bits == (1 << i), name) for i, (name, _) in enumerate(rules)]
    return F.coalesce(*names)


def ablation(book: DataFrame, policy: Sequence[str], rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per rule of a policy: ``failing`` documents, those failing it ``alone``, and
    ``kept_without`` it. The ledger is summed by bit pattern first, at most one row for
    each combination of rules."""
    patterns = (
        book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy, rules))).alias("bits")).agg(F.count("*").alias("n"))
    )
    names = [name for name, _ in rules if name in policy]
    place = {name: i for i, (name, _) in enumerate(rules)}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << place[n]).alias("bit")) for n in names]))
    n = F.col("n")
    return (
        patterns.select("bits", "n", rows.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), n).otherwise(0)).alias("alone"),
            F.sum(F.when((F.col("bits") == F.col("r.bit")) | (F.col("bits") == 0), n).otherwise(0)).alias("kept_without"),
        )
    )
