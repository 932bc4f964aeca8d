"""URL filters by a sort-merge range join with nested host rules.

A host's key is its labels in reverse, each followed by a dot, so a rule's host and all its subdomains are
one interval of keys: `example.net` is [`net.example.`, `net.example/`), as `/` follows `.`. Such intervals
nest or are disjoint. Urls are dealt out over ranges of keys, a task each (keys that fill several ranges are
dealt to all of them), each rule to the ranges that its interval meets. A range is then swept in order of keys
with a stack of the rules that are open; of these the longest whose path begins the url's path wins.

A rule is `host/path`; its length is that of the string, ties go to the longer host. Several rules of one
host and path: block goes before allow. No rule: allow.

Cases: a null url, or one without `://`, has an empty host and path, which no rule fits; rows may repeat;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

DEFAULT = "allow"
#: Keys sampled for each range.
PER_RANGE = 60


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(urls: DataFrame, ranges: int) -> list[str]:
    """Keys that cut the urls into about equal ranges: fewer than `ranges` of them, from a sample whose size
    is fixed by the number of ranges. They decide only who does the work."""
    total = urls.count()
    if ranges < 2 or not total:
        return []
    share = min(1.0, ranges * PER_RANGE / total)
    hashed = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = sorted(r[0] for r in urls.where(hashed).select("key").limit(4 * ranges * PER_RANGE).collect())
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


def _place(bounds: list[str], x: Column, or_equal: bool = False) -> Column:
    """How many bounds are below x (or equal to it): a binary search, a step for each bit of their number."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, n: Column) -> Column:
        cut = F.get(cuts, at + n - 1)
        return F.when(F.coalesce(cut <= x if or_equal else cut < x, F.lit(False)), at + n).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, dict]] = []  # open rules: the end of a host's interval, and its paths
    now = None
    for b in batches:
        part, key, is_url, host, path, rule, verdict = (b.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6, 7))
        keep, rules, verdicts = [], [], []
        for k in range(b.num_rows):
            if part[k] != now:  # another range, which has its own copies of the rules
                now, stack = part[k], []
            while stack and key[k] >= stack[-1][0]:
                stack.pop()
            if not is_url[k]:
                end = key[k][:-1] + "/"
                if not stack or stack[-1][0] != end:
                    stack.append((end, {}))
                was = stack[-1][1].get(path[k])
                if was is None or verdict[k] == "block":
                    stack[-1][1][path[k]] = (len(rule[k]), len(host[k]), rule[k], verdict[k])
                continue
            best = None
            for _, paths in stack:
                if len(paths) <= 8:
                    fits = [r for p, r in paths.items() if path[k].startswith(p)]
                else:
                    fits = [paths[path[k][:n]] for n in range(len(path[k]) + 1) if path[k][:n] in paths]
                best = max([*fits, *([best] if best else [])], default=None)
            keep.append(k)
            rules.append(best[2] if best else None)
            verdicts.append(best[3] if best else DEFAULT)
        own = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column(3), own.column(4), own.column(5), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages; rules has rule and verdict."""
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = written(own.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host"))), "urls")
    bounds = _bounds(urls, ranges)
    below = _place(bounds, F.col("key"))
    equal = _place(bounds, F.col("key"), or_equal=True) - below
    # A key that several cuts equal has several ranges to itself, besides parts of those next to them.
    to = below + F.when(equal > 0, F.pmod(F.xxhash64(F.monotonically_increasing_id()), equal + 1)).otherwise(0)
    rows = urls.select(to.cast("int").alias("part"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    parts = rules.where("rule is not null").select("rule", "verdict", ascii_lower(F.substring_index("rule", "/", 1)).alias("host")).withColumn("path", F.expr("substr(rule, length(host) + 1)")).withColumn("key", host_key(F.col("host")))
    end = F.expr("concat(substr(key, 1, length(key) - 1), '/')")
    first, last = _place(bounds, F.col("key")), _place(bounds, F.col("end"))
    opened = parts.withColumn("end", end).select(F.explode(F.sequence(first, last)).alias("part"), "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), "host", "path", "rule", "verdict")
    both = rows.unionByName(opened)
    swept = both.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "is_url")
    return swept.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
