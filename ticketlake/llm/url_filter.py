"""URL rules decided by Bloom filter cascades over the corpus's own keys.

A page is judged by the longest rule whose host is the page's host or a parent
domain of it and whose path begins the page's path. Every key that could be a
rule is spelled out per page (host suffix + path prefix, for the label counts and
path lengths that rules have), so a rule applies iff one of these keys is listed.

Membership is decided by a cascade: level 0 is a Bloom filter of the listed keys,
level 1 one of those other keys of the corpus that pass level 0, level 2 one of
the listed keys that pass level 1, and so on until nothing passes wrongly. As the
universe holds every key that is ever asked for, the answers are exact, and no
join is needed. One cascade holds all rules, a second one the blocking rules.

Nulls, texts without ``://``: host and path are empty, no rule applies and the
verdict is ``allow`` (nothing is listed that would block them). Empty tables give
empty results. Repeated rows are judged one by one. Columns named like the result
do not matter, only the id and url columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (action, host, path); the rules of the registered query
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: a filter's bits are held in one literal; longer lists are refused, not cut
MAX_BITS = 1 << 26
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_bits: int
    hashes: int


def _positions(key: Column, level: int, n_bits: int, hashes: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(F.lit(level * 100 + i), key), F.lit(n_bits))
        for i in range(hashes)
    ]


def _passes(key: Column, number: int, level: Level) -> Column:
    test = F.lit(True)
    for at in _positions(key, number, level.n_bits, level.hashes):
        byte = F.substring(F.lit(level.bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        test = test & (F.floor(value / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return test


def contains(key: Column, cascade: list[Level]) -> Column:
    """Whether ``key``, a key of the cascade's universe, is listed."""
    answer = F.lit(len(cascade) % 2 == 1)
    for number in reversed(range(len(cascade))):
        fails = F.lit(number % 2 == 1)
        answer = F.when(_passes(key, number, cascade[number]), answer).otherwise(fails)
    return answer


def _level(keys: DataFrame, number: int, n_keys: int, rate: float) -> Level:
    n_bits = max(64, 8 * math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2 / 8))
    if n_bits > MAX_BITS:
        raise ValueError(f"{n_keys} keys need {n_bits} bits; split the list, the limit is {MAX_BITS}")
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*_positions(F.col("key"), number, n_bits, hashes)))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 8).alias("byte"))
        .agg(F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("value"))
        .collect()  # at most n_bits / 8 rows
    )
    bits = bytearray(n_bits // 8)
    for w in words:
        bits[w["byte"]] = w["value"]
    return Level(bytes(bits), n_bits, hashes)


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The cascade of ``listed`` (column ``key``) that is exact on ``universe``.

    ``universe`` may repeat keys and may hold listed ones. Level 0 lets through
    about as many other keys as are listed, later levels halve what is left, so
    the cascade's size follows the list and the logarithm of the universe.
    """
    listed = listed.where("key IS NOT NULL").distinct()
    others = universe.where("key IS NOT NULL").distinct().join(listed, "key", "left_anti")
    inside, outside = listed, others
    n_in, n_out = listed.count(), others.count()
    cascade: list[Level] = []
    while n_in:
        if len(cascade) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        rate = 0.5 if cascade else min(0.5, max(1e-9, n_in / max(1, n_out)))
        number = len(cascade)
        cascade.append(_level(inside, number, n_in, rate))
        wrong = outside.where(_passes(F.col("key"), number, cascade[number]))
        inside, outside = wrong, inside
        n_in = inside.count()
    return cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(raw), path


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The keys of a page that have the label count and path length of a rule; else null."""
    return [
        F.when(
            F.length(path) >= length,
            F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)),
        )
        for labels, length in shapes
    ]


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host + path of the longest fitting one) and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        none = F.lit(None).cast("string")
        return parsed.select("*", none.alias("rule"), F.lit("allow").alias("verdict"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    keys = _candidates(F.col("host"), F.col("path"), shapes)
    universe = parsed.select(F.explode(F.array(*keys)).alias("key"))

    def cascade(actions: set[str]) -> list[Level]:
        chosen = [(h + p,) for action, h, p in rules if action in actions]
        return build(spark.createDataFrame(chosen, "key string"), universe)

    listed, blocked = cascade({"allow", "block"}), cascade({"block"})
    fitting = [
        F.when(contains(k, listed), F.struct(F.length(k).alias("n"), k.alias("key")))
        for k in keys
    ]
    best = fitting[0] if len(fitting) == 1 else F.greatest(*fitting)
    return parsed.select("page_id", "host", "path", best["key"].alias("rule")).withColumn(
        "verdict",
        F.when(F.col("rule").isNotNull() & contains(F.col("rule"), blocked), "block").otherwise("allow"),
    )


SQL = """
WITH rules(action, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
raw AS (
  SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM rest),
parsed AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM raw)
SELECT any_value(p.page_id) AS page_id, any_value(p.host) AS host, any_value(p.path) AS path,
       max_by(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(max_by(r.action, length(r.host || r.path)), 'allow') AS verdict
FROM parsed p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.n
"""
