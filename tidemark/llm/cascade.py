"""URL verdicts from a cascade of Bloom filters.

The first level encodes the listed keys. The second encodes those keys of the corpus
that the first takes for listed by mistake, the third the listed keys that the second
takes by mistake, and so on until a level makes no mistake. Over the corpus's complete
key universe the answer is then exact, and no join is needed to look a key up.

Size: level 1 takes about 1.44 * log2(universe / listed) bits per listed key, the others
together a few bits per listed key. So the filters grow with the rule list and only with
the logarithm of the corpus; ``MAX_BITS`` is checked for every level.

Rows: a null url, or one without ``://``, has empty host and path and no rule. Repeated
rows are judged one by one, other columns are not read, an empty table gives no rows.
An empty rule list gives every url the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 26  # of one level: 8 MB


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]  # bits / 64 longs

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        tests = [F.getbit(words[F.floor(p / 64).cast("int")], (p % 64).cast("int")) == 1 for p in self.places(key)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def places(self, key: Column) -> list[Column]:
        first, step = (F.pmod(F.xxhash64(F.lit(2 * self.seed + i), key), F.lit(self.bits)) for i in (0, 1))
        return [F.pmod(first + step * F.lit(i), F.lit(self.bits)) for i in range(self.hashes)]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    host = F.translate(raw, ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All rule keys that could fit: each suffix of the host in whole labels with each
    prefix of the path in a length that occurs among the rules."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(prefixes, lambda p: F.struct(F.length(s).alias("host"), F.concat(s, p).alias("key"))),
        )
    )


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need a filter of {bits} bits; the bound is {MAX_BITS}: split the rule list")
    empty = Level(bits, hashes, seed, ())
    places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("p"))
    # one row for each 64 bits at most
    rows = (
        places.groupBy((F.col("p") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Level(bits, hashes, seed, tuple(words))


def build(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The levels that tell the ``key`` s of ``listed`` from all other ``key`` s of
    ``universe``. Beyond level 1 only keys that some level mistook are handled."""
    listed = listed.select("key").distinct()
    n = listed.count()
    if n == 0:
        return []
    total = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    levels = [_level(listed, n, min(0.5, n / (math.sqrt(2) * max(total, 1))), 1)]
    mistaken = universe.where(levels[0].has(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
    inside, outside = listed, mistaken.checkpoint() if _has_folder(universe) else mistaken
    while (n := outside.count()) > 0:
        levels.append(_level(outside, n, 0.5, len(levels) + 1))
        inside, outside = outside, inside.where(levels[-1].has(F.col("key")))
    return levels


def _has_folder(df: DataFrame) -> bool:
    from tidemark.llm.text import shared_folder

    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return True


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.has(key) & ~out
    return out


def judge(pages: DataFrame, allow: Sequence[str], block: Sequence[str], default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (the longest that fits, else null) and
    ``verdict``. Rules are written ``host/path``; of two equally long the one with the
    longer host wins; a rule both allowed and blocked blocks."""
    spark = pages.sparkSession
    lengths = sorted({len(rule) - rule.index("/") for rule in [*allow, *block]})
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = urls.withColumn("keys", _keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    lists = {
        name: build(universe, spark.createDataFrame([(r,) for r in rules], "key string"))
        for name, rules in (("allow", allow), ("block", block))
    }
    verdict = lambda key: F.when(member(lists["block"], key), "block").when(member(lists["allow"], key), "allow")
    ranked = F.transform(
        F.col("keys"),
        lambda k: F.struct(
            F.length(k["key"]).alias("n"), k["host"].alias("host"), k["key"].alias("key"), verdict(k["key"]).alias("verdict")
        ),
    )
    best = F.array_max(F.filter(ranked, lambda k: k["verdict"].isNotNull()))
    return keyed.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
