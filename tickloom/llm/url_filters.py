"""Operator 9: URL filters over a sorted array of 64-bit digests that every task memory-maps.

A filter file holds, for each entry ``host/path-prefix``, its xxhash64 in ascending order, its place in
a block of full strings, and its value. A url's candidates are its host and parent domains with the path
prefixes of the lengths that occur among the entries; a vectorised binary search finds their digests and
the full strings are compared before a match counts, so colliding digests do no harm. Spark hands the
file to each executor once, and all tasks there share its pages.

Entries that match: host equal to or above the url's host at a label boundary, url path starting with
the entry's path; the longest entry wins. A url that no rule fits goes to the block list: blocked if an
entry there fits, else allowed. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an
empty host and path, no rule, and are allowed. Rows are judged one by one: repeats and ties get equal
verdicts, long urls are read whole, empty tables give empty results, other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS_LOWER, LETTERS_UPPER, map_batches, table

#: (verdict, host, path) of the contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts blocked, with all their subdomains and paths, where no rule decides.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(("block", f"{name}.example.{end}", "") for name in BLOCKED_NAMES for end in ("com", "net", "org"))
ALLOW, BLOCK = 0, 1

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans(LETTERS_UPPER, LETTERS_LOWER)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def pack(entries) -> bytes:
    """The filter file of (verdict, host, path) entries: counts, path lengths, digests, ends of strings, values, strings.

    A path is empty (any path fits) or begins with a slash. Of equal entries the last one counts.
    """
    byname = {(host.translate(_LOWER) + path).encode(): BLOCK if verdict == "block" else ALLOW for verdict, host, path in entries}
    lengths = sorted({len(path) for _, _, path in entries})
    rows = sorted((xxhash.xxh64_intdigest(name), name, value) for name, value in byname.items())
    ends = np.cumsum([len(name) for _, name, _ in rows], dtype=np.uint64) if rows else np.empty(0, np.uint64)
    head = np.array([len(rows), len(lengths), *lengths], np.uint64)
    return b"".join((head.tobytes(), np.array([d for d, _, _ in rows], np.uint64).tobytes(), ends.tobytes(), bytes(v for _, _, v in rows), b"".join(n for _, n, _ in rows)))


class Filter:
    """A packed filter, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in data[:16].view(np.uint64))
        self.lengths = [int(x) for x in data[16 : 16 + 8 * k].view(np.uint64)]
        at = 16 + 8 * k
        self.digests, at = data[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.ends, at = data[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.values, at = data[at : at + n], at + n
        self.strings = data[at:]

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[str, int] | None]:
        """For each (host, path) the longest entry that fits and its value."""
        names, owner = [], []
        for i, (host, path) in enumerate(urls):
            above = [host]
            dot = host.find(".")
            while dot >= 0:
                above.append(host[dot + 1 :])
                dot = host.find(".", dot + 1)
            for size in self.lengths:
                if size <= len(path) and (host or path):
                    names += [(h + path[:size]).encode() for h in above]
                    owner += [i] * len(above)
        best: list[tuple[str, int] | None] = [None] * len(urls)
        if not names or not len(self.digests):
            return best
        wanted = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
        first, last = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        for j in np.flatnonzero(last > first):
            for row in range(int(first[j]), int(last[j])):
                begin = int(self.ends[row - 1]) if row else 0
                if self.strings[begin : int(self.ends[row])].tobytes() == names[j]:
                    name, now = names[j].decode(), best[owner[j]]
                    if now is None or len(name) > len(now[0]):
                        best[owner[j]] = (name, int(self.values[row]))
        return best


def distribute(spark: SparkSession, entries) -> str:
    """Hand a filter file to all executors; its name for SparkFiles. Equal entries share one file."""
    packed = pack(entries)
    name = f"url-filter-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    if name not in os.listdir(SparkFiles.getRootDirectory()):
        place = os.path.join(tempfile.mkdtemp(prefix="tickloom-"), name)
        with open(place, "wb") as f:
            f.write(packed)
        spark.sparkContext.addFile(os.path.abspath(place))
    return name


def judge(df: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    spark = df.sparkSession
    own_rules, own_list = distribute(spark, rules), distribute(spark, blocked)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second = Filter(SparkFiles.get(own_rules)), Filter(SparkFiles.get(own_list))
        split = [parts(x) for x in batch.column(1).to_pylist()]
        by_rule = first.longest(split)
        rest = [i for i, x in enumerate(by_rule) if x is None]
        verdicts = [x and x[1] for x in by_rule]
        for i, x in zip(rest, second.longest([split[i] for i in rest]), strict=True):
            verdicts[i] = x[1] if x else ALLOW
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([h for h, _ in split], pa.string()),
                pa.array([p for _, p in split], pa.string()),
                pa.array([x and x[0] for x in by_rule], pa.string()),
                pa.array(["block" if v == BLOCK else "allow" for v in verdicts], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    own = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return map_batches(own, kernel, "page_id long, host string, path string, rule string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
r as (
  select *, case
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule
  from u)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') then 'block' else 'allow' end as verdict
from r
"""
