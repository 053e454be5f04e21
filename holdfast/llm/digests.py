"""URL filter lists as sorted digest arrays.

An entry is a key, such as ``com/`` or ``net/es/``, and a verdict. Its 64-bit xxhash goes into a sorted
array that a worker memory-maps and probes by binary search for many keys at once; a hit counts only if
the full string stored with it is equal, so colliding digests do no harm.

A list of up to ``MAX_LOCAL`` entries is one file that Spark hands to every executor. A longer one stays a
table of hash shards, each its own sorted array, and the distinct keys that the URLs ask for are dealt to
the shards; nothing is broadcast then.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.storage import settle

MAX_LOCAL = 2_000_000
SHARD = 500_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of names that count in any host, whatever its domain.
NAME = "name:"


def digest(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


class DigestArray:
    """Sorted digests, offsets and flags as one block of bytes, and the strings behind them."""

    def __init__(self, block):
        raw = np.asarray(block)
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.blocked = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    @staticmethod
    def pack(entries: list[tuple[str, bool]]) -> bytes:
        """Entries as bytes; of entries with one key, one stays, and block wins."""
        merged: dict[bytes, bool] = {}
        for key, blocked in entries:
            raw = key.encode("utf-8", "surrogatepass")
            merged[raw] = merged.get(raw, False) or bool(blocked)
        keys = list(merged)
        values = digest(keys)
        order = np.argsort(values, kind="stable")
        keys = [keys[i] for i in order]
        offsets = np.cumsum([0, *map(len, keys)]).astype("<u8")
        flags = np.array([merged[k] for k in keys], np.uint8)
        return b"".join(
            (np.array([len(keys)], "<u8").tobytes(), values[order].astype("<u8").tobytes(), offsets.tobytes(), flags.tobytes(), *keys)
        )

    @classmethod
    def open(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, np.uint8, "r"))

    def probe(self, keys: list[str]) -> np.ndarray:
        """For each key: 1 if it is blocked, 0 if allowed, -1 if it is not in the list."""
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        values = digest(raw)
        out = np.full(len(keys), -1, np.int8)
        first = np.searchsorted(self.digests, values, "left")
        last = np.searchsorted(self.digests, values, "right")
        for i in np.flatnonzero(first < last):
            for at in range(first[i], last[i]):  # more than one only where digests collide
                if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == raw[i]:
                    out[i] = self.blocked[at]
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? or #."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = len(rest)
    for c in "/?#":
        at = rest.find(c)
        cut = at if 0 <= at < cut else cut
    host, path = rest[:cut], rest[cut:]
    for c in "?#":
        path = path.partition(c)[0]
    return host.translate(_LOWER), path


_LOWER = str.maketrans(UPPER, LOWER)


def candidates(host: str, path: str, depths: tuple[int, ...]) -> list[str]:
    """Keys that could hold for a URL: rules, the longest first, then the names in its host.

    A rule reaches over all subdomains of its host and over paths that start with its own; ``depths`` are
    the lengths of path that rules have.
    """
    if not host:
        return []
    labels = host.split(".")
    starts = [path[:n] for n in depths if n <= len(path)]
    rules = [".".join(labels[i:]) + s for i in range(len(labels)) for s in starts]
    return sorted(rules, key=lambda r: -len(r)) + [NAME + label for label in labels]


def verdict(keys: list[str], found: dict[str, int]) -> tuple[str | None, str]:
    """(rule, verdict) of a URL: its longest rule's, else block if a name of its host is blocked."""
    for key in keys:
        flag = found.get(key, -1)
        if flag >= 0 and (flag or not key.startswith(NAME)):
            return None if key.startswith(NAME) else key, BLOCK if flag else ALLOW
    return None, ALLOW


def _depths(entries: DataFrame) -> tuple[int, ...]:
    """Lengths of the rules' paths: at most as many as the longest path has characters."""
    path = F.expr("length(key) - locate('/', key) + 1")
    rows = entries.filter(~F.col("key").startswith(NAME)).select(path.alias("n")).distinct().collect()
    return tuple(sorted(r["n"] for r in rows))


def judge_urls(pages: DataFrame, entries: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    ``entries`` has key and blocked: a rule's host and path, or ``name:`` and a label. A null url, or one
    without ``://``, has an empty host and path and is allowed. Of equal keys, block wins; null keys are
    left out. Repeated pages keep their rows. An empty list allows everything.
    """
    entries = entries.filter("key IS NOT NULL").select("key", "blocked")
    depths = _depths(entries)
    judge = _judge_local if entries.count() <= max_local else _judge_sharded
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judge(pages.select(*kept), entries, depths).select(*kept, "host", "path", "rule", "verdict")


def _judge_local(pages: DataFrame, entries: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    rows = [(r["key"], r["blocked"]) for r in entries.collect()]  # at most max_local
    name = f"digests-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp()
    with open(os.path.join(folder, name), "wb") as out:
        out.write(DigestArray.pack(rows))
    pages.sparkSession.sparkContext.addFile(os.path.join(folder, name))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        listed = DigestArray.open(SparkFiles.get(name))
        for urls in batches:
            parts = [split_url(u) for u in urls]
            keys = [candidates(h, p, depths) for h, p in parts]
            flat = sorted({k for own in keys for k in own})
            found = {k: f for k, f in zip(flat, listed.probe(flat).tolist()) if f >= 0}
            given = [verdict(own, found) for own in keys]
            yield pd.DataFrame(
                [(*p, *g) for p, g in zip(parts, given)], columns=["host", "path", "rule", "verdict"], dtype=object
            )

    judged = F.pandas_udf(judge, "host string, path string, rule string, verdict string")
    return pages.withColumn("__judged", judged("url")).select(*pages.columns, "__judged.*")


def _judge_sharded(pages: DataFrame, entries: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [split_url(u) for u in batch["url"]]
            keys = [candidates(h, p, depths) for h, p in parts]
            yield pd.DataFrame({"url": batch["url"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "keys": keys})

    urls = settle(
        pages.select("url").distinct().mapInPandas(split, "url string, host string, path string, keys array<string>"),
        "urls",
    )
    asked = urls.select("url", F.posexplode("keys").alias("place", "key"))
    wanted = settle(asked.select("key").distinct(), "url-keys")
    shards = 1 + max(wanted.count(), entries.count()) // SHARD
    shard = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(shards)).alias("shard")

    def probe(_, listed: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        block = DigestArray.pack(list(zip(listed["key"], listed["blocked"])))
        array = DigestArray(np.frombuffer(block, np.uint8))
        flags = array.probe(list(keys["key"]))
        return pd.DataFrame({"f_key": keys["key"][flags >= 0], "flag": flags[flags >= 0].astype("int32")})

    found = (
        entries.select(shard, "key", "blocked").groupBy("shard")
        .cogroup(wanted.select(shard, "key").groupBy("shard"))
        .applyInPandas(probe, "f_key string, flag int")
    )
    named = F.col("key").startswith(NAME)
    first = (
        asked.join(found, F.col("key") == F.col("f_key"))
        .filter(~named | (F.col("flag") == 1))
        .groupBy(F.col("url").alias("g_url"))
        .agg(F.min(F.struct("place", "key", "flag")).alias("first"))
    )
    judged = urls.join(first, F.col("url") == F.col("g_url"), "left").select(
        F.col("url").alias("j_url"), "host", "path",
        F.when(~F.col("first.key").startswith(NAME), F.col("first.key")).alias("rule"),
        F.when(F.col("first.flag") == 1, BLOCK).otherwise(ALLOW).alias("verdict"),
    )
    return pages.join(judged, F.col("url").eqNullSafe(F.col("j_url"))).drop("j_url")
