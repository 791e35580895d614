"""Packing documents into token sequences: dominance reduction, then best fit.

Only the *lengths* matter to the plan, and there are at most ``capacity`` of them. So Spark tokenises,
cuts and counts; the driver plans over the histogram (at most ``capacity`` rows, whatever the corpus);
Spark numbers the pieces of each length and looks every piece up in the plan.

The plan first fixes bins by Martello and Toth's dominance criterion: a set holding the largest open piece that
provably dominates every other set with that piece belongs to some optimal packing, so it is closed and
its pieces leave the instance. What remains is packed by best fit, longest first. Both steps treat all
pieces of a length together; the plan is a list of runs.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import numbered, stored, whole_text

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 150_000     # words whose ids a task keeps, in each of three tables
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: How a vocabulary must normalise and split for words to be looked up on their own.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def public_vocabulary() -> str:
    """The vocabulary file of the packing query and of the pipeline's last stage."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class _Runs:
    """Takes pieces of each length in order of their number and notes where they go."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.next = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def put(self, length: int, n: int, per_sequence: int, first_sequence: int, offset: int) -> None:
        """``n`` pieces, ``per_sequence`` of them one after the other in each of the next sequences."""
        if n:
            self.rows.append((length, self.next[length], n, per_sequence, first_sequence, offset))
            self.next[length] += n
            self.left[length] -= n
            if not self.left[length]:
                del self.left[length]


def _fits(left: dict[int, int], order: list[int], length: int, room: int) -> int:
    """How many of the smallest other pieces fit into ``room``: 0, 1, 2, or 3 for more."""
    k = 0
    for small in order:
        for _ in range(min(left.get(small, 0) - (small == length), 3 - k)):
            room -= small
            if room < 0:
                return k
            k += 1
        if k >= 3:
            return 3
    return k


def _best_pair(left: dict[int, int], order: list[int], length: int, room: int) -> tuple[int, int] | None:
    """Two other pieces (longer first) with the largest sum that fits into ``room``."""
    have = [x for x in order if left.get(x, 0) - (x == length) > 0]
    lo, hi, best = 0, len(have) - 1, None
    while lo <= hi:
        a, b = have[hi], have[lo]
        if a + b > room:
            hi -= 1
        elif lo == hi and left[a] - (a == length) < 2:
            break
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def _reduce_class(runs: _Runs, length: int, capacity: int) -> bool:
    """Close the dominating sets of the pieces of one length; True if any was found."""
    found = False
    while runs.left.get(length, 0):
        left, order, room = runs.left, sorted(runs.left), capacity - length
        k = _fits(left, order, length, room)
        if k == 0:
            n = left[length]
            runs.put(length, n, 1, runs.open(n), 0)
            return True
        mate = next(x for x in order[bisect_left(order, room + 1) - 1::-1] if left[x] - (x == length) > 0)
        pair = _best_pair(left, order, length, room) if k == 2 and mate < room else None
        if mate == room or k == 1 or (k == 2 and (pair is None or mate >= sum(pair))):
            n = left[length] // 2 if mate == length else min(left[length], left[mate])
            first = runs.open(n)
            runs.put(length, n, 1, first, 0)
            runs.put(mate, n, 1, first, length)
        elif pair and pair[0] == mate and sum(
                min(left[x] - (x == length), 2) for x in order if pair[1] < x < mate) < 2:
            a, b = pair
            n = 1 if len({length, a, b}) < 3 else min(left[length], left[a], left[b])
            first = runs.open(n)
            for x, offset in ((length, 0), (a, length), (b, length + a)):
                runs.put(x, n, 1, first, offset)
        else:
            return found
        found = True
    return found


def _best_fit(runs: _Runs, capacity: int) -> None:
    """All pieces left, longest first, each into the fullest open sequence that takes it."""
    rooms: list[int] = []                               # rooms that open sequences have, ascending
    open_at: dict[int, list[tuple[int, int]]] = {}      # room -> (first sequence, how many)

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_at:
                insort(rooms, room)
            open_at.setdefault(room, []).append((first, n))

    for length in sorted(runs.left, reverse=True):
        while n := runs.left.get(length, 0):
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, per = capacity, capacity // length
                count = -(-n // per)
                first = runs.open(count)
            else:
                room = rooms[at]
                first, count = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
                per = room // length
            full = min(count, n // per)
            runs.put(length, full * per, per, first, capacity - room)
            leave(room - per * length, first, full)
            used, rest = full, min(n - full * per, per - 1) if count > full else 0
            if rest:
                runs.put(length, rest, rest, first + full, capacity - room)
                leave(room - rest * length, first + full, 1)
                used += 1
            leave(room, first + used, count - used)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, pieces, pieces per sequence, first sequence, offset) for a histogram of lengths."""
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a length is outside 1..capacity")
    runs = _Runs(counts)
    while any([_reduce_class(runs, length, capacity) for length in sorted(runs.left, reverse=True)]):
        pass
    _best_fit(runs, capacity)
    return runs.rows


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _pieces(vocabulary: str, capacity: int, end_id: int):
    """Arrow mapper from (doc_id, text) to the pieces of each document.

    A vocabulary with the normaliser and splitter of ``WORDWISE`` never joins characters across white space, so its ids are looked up chunk by
    chunk (ASCII white space only) in a table of chunks seen before, and only new chunks are encoded. Any other vocabulary gets whole texts.
    """
    wordwise = all(json.loads(vocabulary).get(k) == v for k, v in WORDWISE.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)

        class Cache(dict):
            def __init__(self, of):
                super().__init__()
                self.of = of

            def __missing__(self, key):
                value = self.of(key)
                if len(self) >= CACHE_WORDS:
                    self.clear()
                if len(key) <= 64:
                    self[key] = value
                return value

        def encode(part: bytes) -> bytes:
            ids = tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)

        # Letters that lower-casing and normalising turn into one letter of the same kind, whatever stands next to them.
        model, plain = tokenizer.model, re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

        def encode_word(text: str) -> bytes:
            """Ids of one group of plain lower-case letters, by the model at once."""
            ids = [t.id for t in model.tokenize(text if text.isascii() else "".join(map(letters.__getitem__, text.encode())))]
            return b"".join(i.to_bytes(4, "little") for i in ids)

        letters, parts, word_parts = byte_letters(), Cache(encode), Cache(encode_word)

        def split(chunk: bytes) -> bytes:
            """Ids of a chunk; a run of ASCII punctuation after plain letters is a token group of its own."""
            core = chunk.rstrip(PUNCTUATION)
            core_text = core.decode("utf-8", "replace")
            if not plain(core_text):
                return parts[chunk]
            return word_parts[core_text.lower()] + (parts[chunk[len(core):]] if len(core) < len(chunk) else b"")

        known, end = Cache(split), end_id.to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                ids = (b"".join(map(known.__getitem__, data.split())) if wordwise else encode(data)) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces_of(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of each document."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    return docs.select("doc_id", whole_text().alias("_text")).mapInArrow(
        _pieces(vocabulary, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list] = {}
    for length, *run in plan(counts, capacity):
        runs.setdefault(length, []).append(tuple(run))
    # One row for each length that occurs: at most ``capacity`` rows.
    table = spark.createDataFrame(
        list(runs.items()), "length long, runs array<struct<first:long,n:long,per:long,sequence:long,offset:long>>")
    d = numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_number").join(F.broadcast(table), "length")
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("_number")) & (F.col("_number") < r["first"] + r["n"])), 1)
    i = F.col("_number") - F.col("_run.first")
    return d.withColumn("_run", run).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.sequence") + F.floor(i / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + i % F.col("_run.per") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece with its sequence and its place there.

    A null or empty text is one piece with the end id alone. Only documents above ``capacity`` are cut. Repeated rows
    are packed as often as they occur; a null doc_id stays null. Other columns are not read. An empty table gives no
    pieces.
    """
    return place(stored(pieces_of(docs, vocabulary_path, capacity, end_id)), capacity)
