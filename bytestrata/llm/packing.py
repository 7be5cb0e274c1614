"""Best-fit packing of token sequences, planned on the histogram of their lengths.

The plan is a configuration linear program: how often to use each way of filling a sequence (a configuration), so that every length
is covered as often as it occurs, with the fewest sequences. Multiplicative weights solve it, on the exact lengths: a length's price is
its tokens times exp(-RATE * (how often the length is covered, less the mean)), so that what lags behind gets dearer; knapsack dynamic programming finds the
configurations of most value at these prices, and each of the best is used a little. Prices, divided by the value of the best
configuration, bound the optimum from below (weak duality), so the plan knows how far from the least number of sequences it can be.

The uses are rounded down, in turns: most of a solution is rounded, and the rest of the demand is solved again. What is left then is
placed by best fit, largest first, into gaps and new sequences. Best fit of everything, which is the same with all uses rounded to none,
is made as well, and the plan with fewer sequences stays: where counts are small, rounding costs more than the program gains. If best
fit alone meets the bound by tokens, the program is not solved. All of this is on (length, count) pairs, at most `capacity` of
them, however many pieces there are.

Pieces then get ranks within their length (a window over salted lengths, so no length meets in one task) and look up
their place in the plan by rank.

Defined cases: null counts as the empty text, which has the end token alone; a text that is longer than a sequence is cut, and
only the last piece is shorter; rows that repeat are packed as often as they occur; pieces of equal length are interchangeable, and
rank by doc_id and piece; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytestrata.llm.bpe import VOCABULARY, codec
from bytestrata.llm.common import bounded_batches, cut, documents, rows_udf

CAPACITY, END_TOKEN = 4096, 1
#: How fast prices follow coverage; steps, configurations of a step, how far below the best one they may be, and how much of a length a step covers.
RATE, STEPS, BATCH, SLACK, SHARE = 3.0, 120, 512, 0.02, 0.04
#: Parts of a solution that are rounded, turn by turn.
PARTS = (0.9, 0.9, 0.9, 1.0)
#: Rows of one length that one task ranks.
RANKED = 200_000


class Knapsack:
    """Most value that fits each number of tokens, for prices of lengths, each to be had any number of times."""

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, capacity: int):
        of_size = np.full(capacity + 1, -np.inf)
        of_size[sizes] = prices
        self.value, self.choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # choice 0: a token is left empty
        self.times = np.zeros(capacity + 1, np.int64)  # how often the choice is made in a row
        least, backward = int(sizes.min()), np.zeros(2 * capacity + 2)
        backward[capacity + 1] = 0.0  # backward[capacity + 1 - c] = value[c]
        for c in range(1, capacity + 1):
            best, size = self.value[c - 1], 0
            if c >= least:
                both = of_size[least : c + 1] + backward[capacity + 1 - c + least : capacity + 2]
                k = int(both.argmax())
                if both[k] > best:
                    best, size = both[k], least + k
            self.value[c] = backward[capacity + 1 - c] = best
            self.choice[c] = size
            self.times[c] = 1 + (self.times[c - size] if size and self.choice[c - size] == size else 0)

    def configuration(self, first: int, capacity: int) -> dict[int, int]:
        """The best one that holds `first`: {size: number}."""
        out, at = {first: 1}, capacity - first
        while at > 0:
            size, n = int(self.choice[at]), int(self.times[at])
            if size:
                out[size] = out.get(size, 0) + n
            at -= max(size, 1) * n
        return out


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int, settled: np.ndarray) -> tuple[dict[tuple[tuple[int, int], ...], float], float, np.ndarray]:
    """{((length, number), ...): uses, fractional, that cover the tokens once}, a lower bound of the number of sequences, and the
    logarithms of the prices of a token; `settled` are those to begin with."""
    bound = 0.0
    place = {int(s): k for k, s in enumerate(sizes)}
    mass = sizes * demand / float(sizes @ demand)
    covered, since, uses = np.zeros(len(sizes)), np.zeros(len(sizes)), {}
    for step in range(steps):
        if step == steps // 2:  # prices have settled; what was used before was bought at poor ones
            since, uses = covered.copy(), {}
        prices = sizes / capacity * np.exp(settled - RATE * (covered - mass @ covered))
        table = Knapsack(sizes, prices, capacity)
        best = table.value[capacity]
        bound = max(bound, float(prices @ demand) / best)
        worth = prices + table.value[capacity - sizes]
        now = np.zeros(len(sizes))
        for k in np.argsort(-worth, kind="stable")[:BATCH]:
            if worth[k] < (1 - SLACK) * best:
                break
            found = table.configuration(int(sizes[k]), capacity)
            own = np.array([place[s] for s in found])
            number = np.array([*found.values()], float)
            times = float(((SHARE - now[own]) * demand[own] / number).min())
            if times > 0:
                now[own] += times * number / demand[own]
                key = tuple(sorted(found.items()))
                uses[key] = uses.get(key, 0.0) + times
        covered += now
    once = float(mass @ (covered - since))
    return {k: v / once for k, v in sorted(uses.items(), key=lambda x: -x[1])}, bound, settled - RATE * (covered - mass @ covered)


def solved(histogram: dict[int, int], capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], int], float]:
    """Whole uses of configurations, and the lower bound: the program is solved, most of its solution is rounded down, and what is left of
    the demand is solved again from the prices found."""
    sizes = np.array([*histogram], np.int64)
    left, logs, whole, bound = np.array([*histogram.values()], np.int64), np.zeros(len(sizes)), {}, 0.0
    place = {int(s): k for k, s in enumerate(sizes)}
    for turn, part in enumerate(PARTS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        uses, least, logs[live] = configuration_lp(sizes[live], left[live], capacity, STEPS if turn == 0 else STEPS // 4, logs[live])
        if turn == 0:
            bound = least
        for configuration, x in uses.items():
            own, number = [place[s] for s, _ in configuration], np.array([n for _, n in configuration])
            times = min(int(x * part + 1e-9), int((left[own] // number).min()))
            if times > 0:
                left[own] -= times * number
                whole[configuration] = whole.get(configuration, 0) + times
    return whole, bound


class Plan:
    """Segments of sequences that hold the same lengths: [[(length, number), ...], how many]."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.segments, self.bound = capacity, [], 0
        for length in histogram:
            if not 0 < length <= capacity:
                raise ValueError(f"a length of {length} does not fit {capacity}")
        histogram = {k: v for k, v in sorted(histogram.items()) if v > 0}
        if not histogram:
            return
        plain = Filling(capacity, {}, histogram)
        sizes, demand = (np.array([*x], np.int64) for x in (histogram, histogram.values()))
        self.bound = max(-(-int(sizes @ demand) // capacity), int(demand[2 * sizes > capacity].sum()))
        self.segments = plain.segments
        if plain.sequences > self.bound:
            uses, bound = solved(histogram, capacity)
            self.bound = max(self.bound, math.ceil(bound - 1e-6))
            program = Filling(capacity, uses, histogram)
            if program.sequences <= plain.sequences:
                self.segments = program.segments

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.segments)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, sequences, first sequence, offset), sorted by length and rank: from there on, ranks go through the
        sequences, and then through them again for the next piece of that length."""
        rows, ranks, base = [], {}, 0
        for lengths, times in self.segments:
            offset = 0
            for length, number in lengths:
                first = ranks.get(length, 0)
                rows.append((length, first, times, base, offset))
                ranks[length] = first + times * number
                offset += length * number
            base += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


class Filling:
    """Whole uses of configurations, and best fit for what they leave."""

    def __init__(self, capacity: int, uses: dict[tuple[tuple[int, int], ...], int], histogram: dict[int, int]):
        self.capacity, self.segments = capacity, []
        rest = dict(histogram)
        for configuration, times in uses.items():
            times = min(times, *(rest[length] // number for length, number in configuration))
            if times > 0:
                self.segments.append([[*configuration], times])
                for length, number in configuration:
                    rest[length] -= number * times
        self._gap = [capacity - sum(length * n for length, n in lengths) for lengths, _ in self.segments]
        self._gaps: dict[int, list[int]] = {}
        for i, gap in enumerate(self._gap):
            self._gaps.setdefault(gap, []).append(i)
        self._order = sorted(self._gaps)
        for length in sorted(rest, reverse=True):
            self._place(length, rest[length])

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.segments)

    def _put(self, i: int) -> None:
        gap = self._gap[i]
        if gap not in self._gaps:
            self._gaps[gap] = []
            bisect.insort(self._order, gap)
        self._gaps[gap].append(i)

    def _add(self, lengths: list[tuple[int, int]], times: int) -> None:
        self.segments.append([lengths, times])
        self._gap.append(self.capacity - sum(length * n for length, n in lengths))
        self._put(len(self.segments) - 1)

    def _place(self, length: int, count: int) -> None:
        """Into the smallest gaps that hold it; a gap takes as many as it holds, since it stays the smallest."""
        while count:
            at = bisect.bisect_left(self._order, length)
            if at == len(self._order):
                each = self.capacity // length
                for number, times in ((each, count // each), (count % each, 1)):
                    if number and times:
                        self._add([(length, number)], times)
                return
            gap = self._order[at]
            i = self._gaps[gap].pop()
            if not self._gaps[gap]:
                del self._gaps[gap], self._order[at]
            lengths, times = self.segments[i]
            number = min(gap // length, count)
            now = min(times, count // number)
            if now < times:
                self._add(lengths[:], times - now)
            self.segments[i] = [[*lengths, (length, number)], now]
            self._gap[i] = gap - number * length
            count -= number * now
            self._put(i)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text: its ids, then end_token, cut at capacity."""
    bounded_batches(docs.sparkSession)
    end, width = end_token.to_bytes(4, "little"), 4 * capacity
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def f(doc_id: list, text: list) -> dict:
        c, out = codec(path), {k: [] for k in names}
        for i, t in zip(doc_id, text, strict=True):
            ids = c.encode(t or "") + end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                for k, v in zip(names, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[k].append(v)
        return out

    long = pa.int64()
    schema = pa.schema(zip(names, (long, pa.int32(), long, long, long), strict=True))
    return docs.select("doc_id", "text").mapInArrow(rows_udf(["doc_id", "text"], schema, f), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...), read three times, with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = Plan(histogram, capacity)
    slots = plan.slots()
    starts = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    salts = spark.createDataFrame([(length, math.ceil(n / RANKED)) for length, n in histogram.items()], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int")).drop("salts")
    # a row for each RANKED pieces and length: ranks before a salt
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("rank", within.cast("long")).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    columns = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def look_up(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                lo, hi = starts[x], starts[x + 1]
                at[own] = lo + np.searchsorted(slots[lo:hi, 1], rank[own], "right") - 1
            _, first, times, base, offset = slots[at].T
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base + (rank - first) % times), pa.array(offset + (rank - first) // times * length)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = cut(token_pieces(docs, path, capacity, end_token))
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
