"""URL filter: ordered host and path rules, and a Bloom filter cascade for a list of keys.

The cascade's first level holds the listed keys. The next holds those keys of the corpus that the
first wrongly accepts, the one after it those listed keys that the second wrongly accepts, and so on
until a level accepts nothing wrongly. Over the keys it was built from the answer is exact, and a row
is judged by bit tests alone, without a join. All of it is DataFrame functions.

Defined cases: a null url, or one without `://`, has an empty host and path; an empty key can be
listed like any other; null keys are never listed. Rows are neither dropped nor joined up.
"""
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.session import durable

# (host, path, verdict): the rule fits the host, its subdomains, and paths that begin with the path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _behind(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(_behind(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule and its verdict as a struct, or null; of equal lengths the longer host."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    table: DataFrame    # one row: `words`, an array of 64-bit words

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def accepts(self, key: Column) -> Column:
        words, yes = self.table.scalar(), F.lit(True)
        for place in self.places(key):
            word = F.get(words, F.floor(place / 64).cast("int"))
            yes &= F.expr("1L") == F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
        return yes


@dataclass(frozen=True)
class Cascade:
    """Bits a key and hashes of the first level and of the others; `most` bounds the bits of all levels."""
    first: tuple[int, int] = (10, 4)
    later: tuple[int, int] = (2, 1)
    most: int = 1 << 28

    def build(self, keys: DataFrame) -> list[Level]:
        """Levels for `keys` (key, listed): the complete set of keys, each once. The loop sees counts only."""
        inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
        levels, n, used = [], inside.count(), 0
        while n:
            per_key, hashes = self.first if not levels else self.later
            bits = 64 * math.ceil(n * per_key / 64)
            used += bits
            if used > self.most:
                raise ValueError(f"the levels need more than {self.most} bits; use listed_by_join")
            level = Level(len(levels), bits, hashes, None)
            level = Level(level.number, bits, hashes, durable(_words(inside, level)))
            levels.append(level)
            wrong = durable(outside.where(level.accepts(F.col("key"))))
            inside, outside, n = wrong, inside, wrong.count()
        return levels

    def fits(self, listed: int) -> bool:
        """Whether levels for that many listed keys stay within `most`, with room for the later ones."""
        return listed * (self.first[0] + 2 * self.later[0]) + 4096 <= self.most


def _words(keys: DataFrame, level: Level) -> DataFrame:
    place = F.explode(F.array(*level.places(F.col("key"))))
    word = F.floor(F.col("place") / 64).cast("bigint")
    bit = F.call_function("shiftleft", F.expr("1L"), F.pmod("place", F.lit(64)).cast("int"))
    zero = keys.sparkSession.range(level.bits // 64).select(F.col("id").alias("word"), F.expr("0L").alias("bits"))
    filled = keys.select(place.alias("place")).select(word.alias("word"), bit.alias("bits")).union(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the build's set is listed: true where the first level not to accept it is an even one."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(level.accepts(key), answer).otherwise(F.lit(level.number % 2 == 1))
    return answer


def listed_by_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` with a column `listed` by an ordinary join; for lists whose levels would be too large."""
    marked = keys.where("listed").select(F.col("key").alias(key), F.lit(True).alias("listed"))
    return rows.join(marked, key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, listed: Column, rules=RULES, cascade: Cascade = Cascade()) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of `pages` (page_id, url).

    `listed` tells from the column `host` of the distinct hosts which ones are on the list; a rule's
    verdict comes first, then block for a listed host and allow for any other.
    """
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    keys = durable(rows.select("host").distinct().select(F.col("host").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")))
    if cascade.fits(keys.where("listed").count()):
        rows = rows.withColumn("listed", listed_by(cascade.build(keys), F.col("host")))
    else:
        rows = listed_by_join(rows, keys, "host")
    found = rule_of(F.col("host"), F.col("path"), rules)
    return (rows.withColumn("found", found)
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"))
