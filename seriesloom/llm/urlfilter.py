"""Allow and block lists for urls: host and path rules, and a Bloom filter cascade for listed hosts.

The cascade stores a list of keys exactly, relative to a complete universe of keys. Level 1 is a Bloom filter of the listed
keys; level 2 of the other keys that level 1 passes by mistake; level 3 of the listed keys that level 2 passes; and so on
until a level passes nothing by mistake. The first level that refuses a key decides: an odd level says not listed, an even
one listed; a key that all levels pass is listed if their number is odd. For every key of the universe the answer is exact,
so judging a row needs no join: each level is one array of words in the plan.

DataFrame functions only. The bits of all levels are bounded by ``MOST_BITS``; a longer list, for which the driver and each
executor would hold too much, is judged by a shuffled join with the same result.

A url without ``://`` (or null) has an empty host and path; an empty host is never listed. Repeated rows and null ids give a
row each. Extra columns are not read by ``judged_urls``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

BITS_PER_KEY = 12
HASHES = 4
#: 4 MB of filter in all.
MOST_BITS = 1 << 25
MOST_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit("")), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, nulls without one; ties go to the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    seed: int

    def passes(self, key: Column) -> Column:
        # One folded literal, not an expression for each word.
        table = F.from_json(F.lit(f"[{','.join(map(str, self.words))}]"), "array<bigint>")
        out = F.lit(True)
        for at in _places(key, self.bits, self.seed):
            out = out & (F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return out


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * HASHES + k)), F.lit(bits)) for k in range(HASHES)]


def _built(keys: DataFrame, n: int, seed: int) -> Level:
    bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, seed))).alias("at")).distinct()
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    out = [0] * (bits // 64)
    for r in words.collect():  # at most MOST_BITS / 64 rows
        out[r["word"]] = r["bits"]
    return Level(tuple(out), bits, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            out = F.when(self.levels[number - 1].passes(key), out).otherwise(F.lit(number % 2 == 0))
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """Cascade of ``listed`` (key) within ``universe`` (key), both distinct and without nulls; None if it would be too large."""
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[Level] = []
    total = 0
    while True:
        n = inside.count()
        if not n and levels:
            return Cascade(tuple(levels))
        total += n * BITS_PER_KEY
        if total > MOST_BITS or len(levels) >= MOST_LEVELS:
            return None
        level = _built(inside, n, len(levels))
        levels.append(level)
        mistakes = stored(outside.where(level.passes(F.col("key"))), f"cascade-{len(levels)}")
        inside, outside = mistakes, inside


def judged_urls(pages: DataFrame, rules: tuple[Rule, ...], listed_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the rule's verdict, else block for listed hosts and allow for others."""
    parts = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    parts = parts.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    universe = stored(parts.where("host <> ''").select(F.col("host").alias("key")).distinct(), "hosts")
    listed = stored(listed_hosts.select(F.col(listed_hosts.columns[0]).alias("key")).where("key is not null and key <> ''").distinct().join(universe, "key", "left_semi"), "listed")
    cascade = build_cascade(universe, listed)
    if cascade is None:
        known = parts.join(listed.select(F.col("key").alias("host"), F.lit(True).alias("listed")), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        known = parts.withColumn("listed", (F.col("host") != "") & cascade.listed(F.col("host")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return known.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def hosts_by_share(pages: DataFrame, part: str, one_in: int, url_col: str = "url") -> DataFrame:
    """Hosts of which at least one url in ``one_in`` contains ``part``: a block list derived from the pages themselves."""
    hosts = pages.select(url_host(F.col(url_col)).alias("host"), F.col(url_col).contains(part).cast("int").alias("has"))
    return hosts.where("host <> ''").groupBy("host").agg(F.sum("has").alias("has"), F.count("*").alias("n")).where(F.col("has") * one_in >= F.col("n")).select("host")
