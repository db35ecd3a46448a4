"""URL filter by a cascade of Bloom filters, in DataFrame operations only.

A rule is a key: host followed by a path prefix. A URL's candidate keys are its host's suffixes with the label counts
of the rules, each with path prefixes of the rules' lengths; the rule of a key fits exactly if the key is listed.

Level 0 of a cascade encodes the listed keys, level 1 the keys of the corpus that level 0 takes for listed though they
aren't, level 2 the listed keys that level 1 takes for such, and so on until a level has no false positive. The first
level that doesn't hold a key decides, so membership is exact for every key of the universe that the cascade was built
over, which is all candidate keys of the corpus. Level 0 is sized from the ratio of universe to list, later levels
for a false positive in two; a cascade takes O(listed * log(universe / listed)) bits, whatever the corpus.
The levels are scalar values of the plan: judging a URL takes neither join nor shuffle.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule. Repeated rows are judged
each on its own. Where no rule fits, the verdict is that of an unlisted key, ``allow``. An empty rule list is a
cascade that holds nothing. Extra columns of the table aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm.common import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A list of more keys than this needs more driver memory than is reasonable for values of the plan.
MAX_LISTED = 20_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` (A-Z lower-cased), and from there to ``?``, ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """A key per shape (labels, path characters), null where the URL hasn't got it."""
    labels = F.size(F.split(host, r"\."))
    return [F.when((host != "") & (labels >= n) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size))) for n, size in shapes]


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)]


@dataclass
class Level:
    bits: int
    hashes: int
    words: Column

    def holds(self, key: Column, level: int) -> Column:
        out = F.lit(True)
        for place in _places(key, level, self.bits, self.hashes):
            word = F.element_at(self.words, (F.shiftright(place, 6) + 1).cast("int"))
            out = out & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return out


def _level(keys: DataFrame, count: int, level: int, rate: float) -> Level:
    bits = max(64, -(-math.ceil(count * -math.log(rate) / math.log(2) ** 2) // 64) * 64)
    hashes = max(1, round(bits / count * math.log(2))) if count else 1
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
    # As many numbers as the level has words: bounded by the list, not by the corpus.
    sparse = words.agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("int"), "v"))).alias("m"))
    dense = sparse.select(F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))
    return Level(bits, hashes, stored(dense, f"bloom-level-{level}").scalar())


class BloomCascade:
    """Exact membership in ``listed`` (key) for all keys of ``universe`` (key, repeats allowed)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = stored(listed.distinct(), "listed-keys")
        count = listed.count()
        if count > MAX_LISTED:
            raise ValueError(f"{count} listed keys; the cascade is built for at most {MAX_LISTED}")
        self.levels: list[Level] = []
        if not count:
            return
        size = universe.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(0.5, max(1e-6, math.sqrt(0.5) * count / max(1, size)))
        inside, outside = listed, universe
        while True:
            n = len(self.levels)
            self.levels.append(_level(inside, count, n, rate if n == 0 else 0.5))
            false = outside.filter(self.levels[n].holds(F.col("key"), n))
            if n == 0:
                # The only look at the whole universe; what passes is cleared of the listed keys without a join.
                marked = false.distinct().withColumn("l", F.lit(0)).union(listed.withColumn("l", F.lit(1)))
                false = marked.groupBy("key").agg(F.max("l").alias("l")).filter("l = 0").select("key")
            false = stored(false, f"false-positives-{n}")
            count = false.count()
            if not count:
                return
            inside, outside = false, inside

    def contains(self, key: Column) -> Column:
        """The first level that lacks the key decides: an even one says no, an odd one yes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(~self.levels[n].holds(key, n), F.lit(n % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for ``pages`` (page_id, url) and ``rules`` (verdict, host, path); a verdict is
    ``allow`` or ``block``, and of a key listed with both, ``block`` counts."""
    keyed = rules.select("verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    # Few: the rules' label counts and path lengths.
    shapes = [(r.n, r.size) for r in keyed.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("size")).distinct().collect()]
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = parsed.select(F.explode(F.array_compact(F.array(*keys))).alias("key")) if keys else parsed.select(F.col("host").alias("key")).limit(0)
    listed = keyed.select("verdict", F.concat("host", "path").alias("key"))
    block = BloomCascade(listed.filter("verdict = 'block'").select("key"), universe)
    allow = BloomCascade(listed.filter("verdict = 'allow'").select("key"), universe)
    # Of the keys that are listed the longest wins, of equally long ones that with the longer host.
    hits = [F.when(k.isNotNull(), F.when(block.contains(k), "block").when(allow.contains(k), "allow")) for k in keys]
    named = [F.when(v.isNotNull(), F.struct(F.length(k).alias("length"), (-F.lit(size)).alias("path"), k.alias("key"), v.alias("verdict"))) for k, v, (_, size) in zip(keys, hits, shapes, strict=True)]
    best = F.array_max(F.array_compact(F.array(*named))) if named else F.lit(None).cast("struct<key:string,verdict:string>")
    return parsed.withColumn("hit", best).select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")
