"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Texts are tokenized once and cut into pieces of at most `capacity` tokens; the pieces (ids, numbers and
a checksum, no tokens) are checkpointed. Only the histogram of piece lengths, at most `capacity` rows
whatever the input's size, goes to the driver. There the configuration program

    minimise sum of x_c  subject to  sum of x_c * (pieces of length l in c) = number of pieces of length l

is solved over configurations c (multisets of lengths that fit one sequence). Prices on the lengths, their
sizes at first, go through an exact knapsack dynamic program over the capacity; it gives for every length
its best configuration, and the price of all pieces over the best configuration's worth is a lower bound
for every packing. If a covering by these prices is within `tolerance` of the bound, it is kept; else
multiplicative weights run (prices fall exponentially in the share covered, in ever smaller steps), which
better both bound and solution until they meet or the work is done. The fractional solution is rounded
down to whole sequences, and what rounding leaves over is placed best-fit decreasing, into their free ends
first. The plan is a table of intervals, (length, ranks) -> (sequence, offset), whose size depends on the
number of lengths, not of pieces.
Pieces get their rank within their length from (length, salt) counts, so a length held by a third of
all rows is spread over tasks.

Edge cases: null and empty texts are one piece with the closing id alone; a text of over `capacity` tokens
is cut, its last piece may be shorter; rows that repeat a doc_id are packed as rows of their own; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, table

CAPACITY = 4096
CLOSING = 1
TOKENIZER = "word_bpe_49k.json"
CACHE = 400_000  # distinct pre-tokens a worker remembers

_encoders: dict[str, "CachedEncoder"] = {}

#: The tokenizer's pre-token pattern for lower-case texts of U+0000 to U+00FF, its classes spelt out.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


class CachedEncoder:
    """ids of a text by the lower-casing word tokenizer, pre-token by pre-token.

    The tokenizer merges inside pre-tokens only, so a text's ids are its pre-tokens' ids in turn. Texts
    of U+0000 to U+00FF without special tokens are lower-cased and split here as the tokenizer does it
    (their composed form is the text itself); any other text goes to it whole. Pre-tokens met before
    come from a table of two generations. New ones are tokenized many at a time, a space between them:
    the last token of each carries the vocabulary's word end, which tells them apart again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.mark = "<|"  # every special token starts so
        assert all(t.content.startswith(self.mark) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pretokens: set[str]) -> None:
        known, older = self.known, self.older
        if len(known) > CACHE // 2:
            self.known, self.older = known, older = {}, known
        new = []
        for c in pretokens:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        for start in range(0, len(new), 1024):
            part = new[start:start + 1024]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            for c, stop in zip(part, stops, strict=True):
                known[c] = raw[at:stop]
                at = stop

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the text has to go to the tokenizer whole."""
        if self.mark in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return _PRETOKEN.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*(x for x in split if x)))
        known = self.known
        return [self.alone(t) if x is None else b"".join([known[c] for c in x]) for t, x in zip(texts, split)]


def encoder(path: str) -> CachedEncoder:
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.array([CLOSING], dtype="<u4").tobytes()
        for part in slices(batches, 256):
            rows = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, ids in zip(part.column(0).to_pylist(), encoder(path).encode(texts)):
                ids += closing
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[start:start + 4 * capacity]
                    rows.append((doc, k, start // 4, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])
    return run


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the largest total value of lengths (repeats allowed) that fit into c, for every c up to the capacity."""
    best = np.zeros(capacity + 1)
    for length, v in zip(lengths.tolist(), value.tolist()):
        if 2 * length > capacity:
            np.maximum(best[length:], best[:capacity + 1 - length] + v, out=best[length:])
            continue
        # Along c, c + length, c + 2 length, ...: a running maximum less the value of the repeats.
        rows = -(-(capacity + 1) // length)
        padded = np.zeros(rows * length)
        padded[:capacity + 1] = best
        gain = (np.arange(rows) * v)[:, None]
        best = (np.maximum.accumulate(padded.reshape(rows, length) - gain, axis=0) + gain).ravel()[:capacity + 1]
    return np.maximum.accumulate(best)


def openings(best: np.ndarray, lengths: np.ndarray, value: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """choice[c]: a length that an optimum for c can begin with, 0 where nothing fits.

    Of several such lengths one is drawn in proportion to its waiting mass, for each c anew, so that the
    configurations read off one table differ.
    """
    capacity = len(best) - 1
    noise = -np.log(-np.log(rng.random(2 * capacity + 2)))
    shift = rng.integers(0, capacity + 1, len(lengths))
    floor = best * (1 - 1e-9)
    top, choice = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    for length, v, g, s in zip(lengths.tolist(), value.tolist(), np.log(mass).tolist(), shift.tolist()):
        score = noise[s + length:s + capacity + 1] + g
        better = (best[:capacity + 1 - length] + v >= floor[length:]) & (score > top[length:])
        top[length:][better] = score[better]
        choice[length:][better] = length
    return choice


class Program:
    """The configuration program of a histogram: prices, fractional solution `x`, its value and the dual bound."""

    def __init__(self, histogram: dict[int, int], capacity: int, tolerance: float = 0.002, slack: float = 0.002, work: int = 120_000, seed: int = 1):
        self.capacity, self.slack, self.rng = capacity, slack, np.random.default_rng(seed)
        self.lengths = np.array(sorted(histogram), dtype=np.int64)
        self.n = np.array([histogram[x] for x in self.lengths.tolist()], dtype=np.float64)
        self.bound, self.prices = 0.0, self.lengths / capacity
        self.calls = max(16, work // (len(self.lengths) + 30))  # knapsacks left to the weights
        self.dual(self.prices)
        self.x, self.value = self.cover(self.prices)
        eta = 4.0
        while self.value > (1 + tolerance) * self.bound and self.calls > 0:
            for x, value in (self.weigh(self.lengths / capacity, eta), self.cover(self.prices)):
                if value < self.value:
                    self.x, self.value = x, value
            eta *= 4

    def dual(self, y: np.ndarray) -> float:
        """The worth of the best configuration under prices y; n . y over it bounds every packing from below."""
        worth = float(knapsack(self.lengths, y, self.capacity)[self.capacity])
        bound = float(self.n @ y) / worth
        if bound > self.bound:
            self.bound, self.prices = bound, y
        return worth

    def sweep(self, y: np.ndarray, room: np.ndarray, least: float, x: dict) -> float:
        """One knapsack, and what its configurations cover of `room`; 0.0 if none is worth `least`.

        Every waiting length, longest first, has its best configuration read off the table; the ones within
        `slack` of the best are used as far as room goes, whole times where it is once at least.
        """
        waiting = np.flatnonzero(room > 1e-9)
        lengths, value = self.lengths[waiting], y[waiting]
        best = knapsack(lengths, value, self.capacity)
        if best[self.capacity] < least:
            return 0.0
        choice = openings(best, lengths, value, room[waiting] * lengths, self.rng)
        worth = value + best[self.capacity - lengths]
        parts = [lengths[worth >= (1 - self.slack) * best[self.capacity]][::-1]]
        free = self.capacity - parts[0]
        while choice[free].any():
            parts.append(choice[free])
            free = free - parts[-1]
        left = dict(zip(lengths.tolist(), room[waiting].tolist()))
        total = 0.0
        for row in np.stack(parts, axis=1).tolist():
            config: dict[int, int] = {}
            for length in row:
                if length:
                    config[length] = config.get(length, 0) + 1
            times = min(left[length] / a for length, a in config.items())
            times = float(int(times)) if times >= 1 else times
            if times > 1e-9:
                for length, a in config.items():
                    left[length] -= times * a
                key = tuple(sorted(config.items(), reverse=True))
                x[key] = x.get(key, 0.0) + times
                total += times
        room[waiting] = [left[length] for length in lengths.tolist()]
        return total

    def cover(self, y: np.ndarray) -> tuple[dict, float]:
        """A solution by fixed prices: sweeps until every length is covered (covered lengths lose their price)."""
        room, x, total = self.n.copy(), {}, 0.0
        while (room > 1e-9).any():
            total += self.sweep(y, room, 0.0, x)
        return x, total

    def weigh(self, start: np.ndarray, eta: float) -> tuple[dict, float]:
        """A solution by multiplicative weights: a length's price falls exponentially in the share of it covered.

        Each round covers at most 1 / (4 eta) of any length, by configurations near the round's best. The prices'
        mean, each round's scaled to a feasible dual, is tried as a dual of its own.
        """
        f, x, total, mean = np.zeros(len(self.n)), {}, 0.0, np.zeros(len(self.n))
        y = start
        while (f < 1 - 1e-9).any() and self.calls > 0:
            y = start * np.exp(-eta * f)
            worth = self.dual(y)
            mean += y / worth
            self.calls -= 1
            room = np.where(f < 1 - 1e-9, np.minimum(0.25 / eta, 1 - f), 0.0) * self.n
            before, least = room.copy(), 0.99 * worth
            while (room > 1e-9).any() and self.calls > 0:
                taken = self.sweep(y, room, least, x)
                self.calls -= 1
                total += taken
                if not taken:
                    break
            if (room == before).all():  # only covered lengths reach the best: they lose their price
                start = np.where(f < 1 - 1e-9, start, 0.9 * start)
            f += (before - room) / self.n
        self.dual(mean)
        return x, total if (f >= 1 - 1e-6).all() else np.inf


def configurations(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], Program | None]:
    """The program's solution rounded down, (configuration, multiplicity) pairs; the pieces left over; the program."""
    if not histogram:
        return [], {}, None
    program = Program(histogram, capacity)
    left, plan = dict(histogram), []
    for config, x in sorted(program.x.items(), key=lambda p: (-p[1], p[0])):
        times = min(int(x + 1e-6), *(left[length] // a for length, a in config))
        if times:
            plan.append((dict(config), times))
            for length, a in config:
                left[length] -= a * times
    return plan, {length: n for length, n in left.items() if n}, program


def best_fit(histogram: dict[int, int], capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram, into `opened` sequences first: equal open ones are one group.

    All sequences are returned, the opened ones too.
    """
    room: dict[int, list[list]] = {}  # free tokens -> [configuration, multiplicity]
    heights: list[int] = []

    def put(free: int, config: dict[int, int], times: int) -> None:
        if free not in room:
            room[free] = []
            heights.insert(int(np.searchsorted(heights, free)), free)
        room[free].append([config, times])

    for config, times in opened:
        put(capacity - sum(length * a for length, a in config.items()), config, times)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = int(np.searchsorted(heights, length))
            if at == len(heights):
                each = min(capacity // length, n)
                times = n // each
                put(capacity - each * length, {length: each}, times)
                n -= each * times
                continue
            free = heights[at]
            config, times = room[free].pop()
            if not room[free]:
                del room[free]
                heights.pop(at)
            each = min(free // length, n)
            used = min(times, n // each)
            if used < times:
                put(free, config, times - used)
            put(free - each * length, {**config, length: config.get(length, 0) + each}, used)
            n -= each * used
    return [(config, times) for groups in room.values() for config, times in groups]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Intervals (length, from_rank, each, first_sequence, first_offset) and the number of sequences.

    Piece r of a length, from_rank <= r < next interval's, goes to sequence first_sequence +
    (r - from_rank) // each, at first_offset + length * ((r - from_rank) % each).
    """
    plan, rest, _ = configurations(histogram, capacity)
    plan = best_fit(rest, capacity, plan)
    ranks = dict.fromkeys(histogram, 0)
    out, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            each = config[length]
            out.append((length, ranks[length], each, sequence, offset))
            ranks[length] += each * times
            offset += each * length
        sequence += times
    return out, sequence


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, salts: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    pieces = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_cut(tokenizer, capacity), PIECES)
    pieces = checkpointed(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    groups = checkpointed(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), gathered=True)  # at most capacity x salts rows
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    intervals, _ = packing_plan(histogram, capacity)
    # One row for each length: its intervals, in rank order. Their number depends on the histogram alone.
    by_length: dict[int, list] = {}
    for length, *rest in intervals:
        by_length.setdefault(length, []).append(tuple(map(int, rest)))
    plan = spark.createDataFrame([(length, v) for length, v in by_length.items()], "length long, plan array<struct<low: bigint, each: bigint, sequence: bigint, offset: bigint>>")
    # Ranks run through the salts of a length, so a (length, salt) group keeps the few intervals it meets: the
    # last one that begins at or below its first rank, and those that begin inside it.
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, "length")
    first = F.greatest(F.size(F.filter("plan", lambda p: p["low"] <= F.col("base"))), F.lit(1))
    last = F.size(F.filter("plan", lambda p: p["low"] < F.col("base") + F.col("n")))
    bases = bases.select("length", "salt", "base", F.slice("plan", first, last - first + 1).alias("near"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("nth", F.row_number().over(own) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.withColumn("p", F.element_at(F.filter("near", lambda p: p["low"] <= F.col("rank")), -1))
    placed = placed.select("*", F.col("p.low").alias("low"), F.col("p.each").alias("each"), F.col("p.sequence").alias("sequence"), F.col("p.offset").alias("at"))
    inside = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (inside % F.col("each"))).cast("long").alias("offset"))


def op4_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their places."""
    return pack(docs)
