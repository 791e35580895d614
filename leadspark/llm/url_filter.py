"""URL rules in a sorted digest array.

Every rule is the string host + path. The index holds the 64-bit xxhash keys of all rule strings in ascending order and
the strings themselves, in one file that Spark sends to each executor, where tasks map it into memory. A URL is turned into
the strings a rule on it could have (each host suffix at a label border with each path start of a length that occurs
among the rules), all keys of a batch are probed with one vectorised binary search, and a hit counts only when the
stored string is equal. The longest rule wins.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import shared_folder

MAX_RULES = 5_000_000   # rules of one index; longer lists are given as several indexes

RULES = (  # Fixed values: (verdict, host, path)
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_bytes(rules: tuple[tuple[str, str, str], ...]) -> bytes:
    """The index: number of rules, keys, string ends, verdicts, strings. Of equal rules the last one counts."""
    if len(rules) > MAX_RULES:
        raise ValueError("more rules than one index may hold")
    last = {(host.translate(str.maketrans(_UPPER, _LOWER)) + path).encode(): verdict for verdict, host, path in rules}
    order = sorted((xxhash.xxh64_intdigest(s), s) for s in last)
    keys = np.array([k for k, _ in order], dtype="<u8")
    ends = np.cumsum([len(s) for _, s in order], dtype="<u8") if order else np.zeros(0, dtype="<u8")
    verdicts = np.array([last[s] == "block" for _, s in order], dtype="u1")
    return struct.pack("<Q", len(order)) + keys.tobytes() + ends.astype("<u8").tobytes() + verdicts.tobytes() + b"".join(s for _, s in order)


class DigestArray:
    """The mapped index."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        n = int(raw[:8].view("<u8")[0])
        self.keys, self.ends = raw[8:8 + 8 * n].view("<u8"), raw[8 + 8 * n:8 + 16 * n].view("<u8")
        self.verdicts, self.strings = raw[8 + 16 * n:8 + 17 * n], raw[8 + 17 * n:]
        paths = {len(self.string(i)) - self.string(i).find(b"/") for i in range(n)}
        self.path_lengths = sorted(paths)

    def string(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.strings[start:int(self.ends[i])].tobytes()

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The rule of each string, -1 where there is none."""
        out = np.full(len(strings), -1, dtype=np.int64)
        if not strings or not len(self.keys):
            return out
        want = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), dtype=np.uint64, count=len(strings))
        at = np.searchsorted(self.keys, want)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:     # equal keys stand side by side
                if self.string(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


def _candidates(host: bytes, path: bytes, lengths: list[int]) -> list[bytes]:
    labels = host.split(b".")
    suffixes = [b".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [s + path[:n] for s in suffixes for n in lengths if n <= len(path)]


def _judge(name: str, otherwise: str):
    """Arrow mapper from (page_id, host, path) to the rule and the verdict."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            probes, owner = [], []
            for row, (host, path) in enumerate(zip(batch.column(1), batch.column(2))):
                mine = _candidates(host.as_buffer().to_pybytes(), path.as_buffer().to_pybytes(), index.path_lengths)
                probes += mine
                owner += [row] * len(mine)
            rules: list[bytes | None] = [None] * batch.num_rows
            verdicts = [otherwise] * batch.num_rows
            for row, probe, k in zip(owner, probes, index.find(probes)):
                if k >= 0 and (rules[row] is None or len(probe) > len(rules[row])):
                    rules[row], verdicts[row] = probe, "block" if index.verdicts[k] else "allow"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.decode() if r is not None else None for r in rules], pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])
    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each page.

    A URL that no rule fits is not on the list, so the method's own verdict is ``otherwise``. A null URL or one without
    ``://`` has an empty host and path and no rule. Repeated rows and null ids stay as they are, other columns are not
    read, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(index_bytes(rules)))
    stream.close()
    spark.sparkContext.addFile(target.toString())
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select("page_id", F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER).alias("host"),
                         F.regexp_extract(url, parts, 2).alias("path"))
    return split.mapInArrow(_judge(os.path.basename(name), otherwise), "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages),
p AS (SELECT page_id,
             CASE WHEN sep > 0 THEN translate(regexp_extract(substr(url, sep + 3), '^[^/?#]*'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
