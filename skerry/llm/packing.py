"""Packing tokenised documents into fixed sequences by cutting-stock column generation.

Each document gives whole sequences of `capacity` tokens and one remainder. Remainders are counted by length class (one token wide up to EXACT tokens, then wider with each
doubling, up to WIDTH tokens), and the linear program "fewest sequences so that every class's count is covered" is solved over packing patterns: a revised
simplex keeps one pattern a class, an unbounded knapsack by dynamic programming prices the next pattern, until Farley's
bound shows the rest to be worth less than GAP. Pattern counts are rounded down, what is left (fewer pieces than patterns
times pattern length) is packed best-fit, and pieces, ranked within their class, take the patterns' places. Should the simplex method stall or reach its most steps, the patterns so
far are used: that costs padding, never a piece.

All that reaches the driver is the histogram: a number for each class, some 600. Ranks come from counts by (class, hash bucket), so that no class is
gathered in one task, however many pieces it has.

Defined results: a null or empty text is its end token alone; repeated rows are packed each on its own; an empty table gives no
sequences; other columns are ignored. Sequence ids are gapless from 0.
"""

from __future__ import annotations

import string
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import cut, map_batches

CAPACITY, EXACT, WIDTH, END = 4096, 64, 8, 2
BUCKETS = 512
#: The linear program stops once its bound shows that less than this share of the sequences can still be saved.
GAP = 0.001
#: It also stops where so many steps have saved less than a tenth of that.
STALL = 200


#: The usual printable stand-ins of byte-level BPE for the 256 bytes, by rule: printable Latin-1 stands for itself, the rest follow from U+0100.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_REST = [b for b in range(256) if b not in set(_OWN)]
BYTE_CHARS = {b: b for b in _OWN} | {b: 256 + i for i, b in enumerate(_REST)}
_ENCODERS: dict = {}  # of this Python worker; tasks that follow find the parts of earlier ones


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    The tokenizer's normaliser and pre-tokeniser drop white space and split at it, and its special tokens hold none, so a text's ids are those of its
    space-separated parts one after the other; the parts' ids are kept while there are few enough of them. A part of Latin-1
    letters with ASCII punctuation behind is two pre-tokens; letters alone go straight to the tokenizer's model.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenize = self.tokenizer.model.tokenize

    def one(self, part: str) -> bytes:
        n = len(part)
        if n > 64:
            return self.plain(part)
        known = self.known
        if part.isalpha():
            low = part.lower()
            ids = known.get(low) if low != part else None
            if ids is None:
                if low.isascii():
                    ids = array("I", [t.id for t in self.tokenize(low)]).tobytes()
                elif max(part) < "\u0100":
                    ids = array("I", [t.id for t in self.tokenize(low.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
                else:
                    ids = self.plain(part)
        else:
            stem = part.rstrip(string.punctuation)
            if 0 < len(stem) < n and stem[-1].isalnum() and max(stem) < "\u0100" and "|>" not in part:  # others may end in a combining mark once in lower case
                ids = self.get(stem) + self.get(part[len(stem) :])
            else:
                ids = self.plain(part)
        if len(known) >= self.LIMIT:
            known.clear()
        known[part] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def get(self, part: str) -> bytes:
        return x if (x := self.known.get(part)) is not None else self.one(part)

    def __call__(self, text: str | None) -> bytes:
        known = self.known
        return b"".join([x if (x := known.get(p)) is not None else self.one(p) for p in (text or "").replace("\n", " ").split(" ")])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def class_sizes(capacity: int = CAPACITY, exact: int = EXACT, width: int = WIDTH) -> np.ndarray:
    """Most tokens of each length class, ascending, the last being capacity."""
    out, step, top = list(range(1, min(exact, capacity) + 1)), 1, exact
    while out[-1] < capacity:
        step, top = min(2 * step, width), 2 * top
        out += list(range(out[-1] + step, min(top, capacity) + 1, step))
        if out[-1] < min(top, capacity):
            out.append(min(top, capacity))
    return np.array(out)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, sizes: np.ndarray | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, cls (and ids as bytes) of each piece: whole sequences (class 0), then the remainder (classes from 1)."""
    tail = np.asarray([end], "<u4").tobytes()
    sizes = class_sizes(capacity) if sizes is None else sizes

    def split(batch: pa.RecordBatch) -> dict:
        encode = encoder(tokenizer)
        row, start, length, crc, total, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            data = encode(text) + tail
            n = len(data) // 4
            for a in range(0, n, capacity):
                part = data[4 * a : 4 * (a + capacity)]
                row.append(i)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                if with_ids:
                    ids.append(part)
        cls = np.where(np.array(length) == capacity, 0, np.searchsorted(sizes, length) + 1).astype(np.int32)
        out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "cls": cls}
        return out | ({"ids": ids} if with_ids else {})

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), split, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int" + ", ids binary" * with_ids)


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int, small: int = EXACT) -> tuple[float, np.ndarray]:
    """The best multiset of classes of those sizes (ascending), of total size `capacity` at most: value and counts.

    Sizes beyond `small` are worked on by blocks of `small` places, whose best values hang on earlier blocks only; then each small size is added by a running maximum along its multiples."""
    cut_ = int(np.searchsorted(sizes, small, side="right"))
    large, worth = sizes[cut_:], value[cut_:]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    if len(large):
        room = np.full(capacity + 1 + int(large[-1]), -np.inf)  # places below 0 can't be reached
        low = int(large[-1])
        for c in range(0, capacity + 1, small):
            stop = min(c + small, capacity + 1)
            n = int(np.searchsorted(large, stop - 1, side="right"))
            own = np.zeros(stop - c)
            if n:
                got = room[np.arange(c, stop)[None, :] - large[:n, None] + low] + worth[:n, None]
                k = got.argmax(axis=0)
                top = got[k, np.arange(stop - c)]
                own = np.maximum(top, 0)
                choice[c:stop] = np.where(top > 1e-15, k + 1, 0)
            best[c:stop] = own
            room[c + low : stop + low] = own
        # a place may stay empty
        over = np.maximum.accumulate(best)
        lower = np.maximum.accumulate(np.where(best >= over, np.arange(capacity + 1), 0))
        best = over
    else:
        lower = np.arange(capacity + 1)
    steps = [best]
    for k in range(cut_):
        s, v = int(sizes[k]), float(value[k])
        rows = -(-(capacity + 1) // s)
        t = np.full(rows * s, -np.inf)
        t[: capacity + 1] = steps[-1]
        t = t.reshape(rows, s) - v * np.arange(rows)[:, None]
        np.maximum.accumulate(t, axis=0, out=t)
        steps.append((t + v * np.arange(rows)[:, None]).ravel()[: capacity + 1])
    counts, c = np.zeros(len(value), np.int64), capacity
    for k in range(cut_ - 1, -1, -1):
        s = int(sizes[k])
        while c >= s and steps[k + 1][c] > steps[k][c] + 1e-12:
            counts[k] += 1
            c -= s
    c = int(lower[c])
    while c > 0 and choice[c]:
        counts[cut_ + choice[c] - 1] += 1
        c = int(lower[c - int(large[choice[c] - 1])])
    return float(counts @ value), counts


def first_patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern for each class, as columns: the largest pieces that are left and fit, used until a class is used up, which no later pattern has. So the columns are a feasible basis."""
    left, out, at = demand.astype(float).copy(), np.zeros((len(sizes), len(sizes))), 0
    while (alive := np.flatnonzero(left > 0)).size:
        room, p = capacity, np.zeros(len(sizes))
        for k in alive[::-1].tolist():
            if n := int(min(room // sizes[k], max(left[k], 1))):
                p[k] = n
                room -= n * int(sizes[k])
        has = np.flatnonzero(p)
        uses = left[has] / p[has]
        gone = has[int(uses.argmin())]
        left -= uses.min() * p
        left[gone] = 0
        out[:, gone] = p
        at += 1
        left[left < 0] = 0
    for k in np.flatnonzero(~out.any(axis=0)):  # used up together with others
        out[k, k] = capacity // sizes[k]
    return out


def column_generation(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = GAP, limit: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows) of the classes with demand and how often each is used (fractions), and a lower bound of the sequences needed."""
    used = np.flatnonzero(demand)
    d, own = demand[used].astype(float), sizes[used]
    n = len(used)
    basis = first_patterns(d, own, capacity)
    inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ d, 0)
    center = own / capacity  # prices of the best bound so far: at first, a piece is worth its share of a sequence
    bound = float(center @ d)
    best, since = x.sum(), 0
    for step in range(limit):
        if x.sum() < best * (1 - gap / 10):
            best, since = x.sum(), step
        elif step - since > STALL:
            break
        price = np.maximum(inverse.sum(axis=0), 0)
        for smooth in (0.7, 0.0):  # prices near the center give bounds and columns that serve longer
            at = smooth * center + (1 - smooth) * price
            worth, counts = knapsack(at, own, capacity)
            now = float(at @ d) / max(worth, 1e-12) if worth > 0 else 0.0
            if now > bound:
                bound, center = now, at / worth
            if float(counts @ price) > 1 + 1e-9:
                break
        else:
            break
        if x.sum() - bound <= gap * x.sum():
            break
        column = counts.astype(float)
        direction = inverse @ column
        can = direction > 1e-9
        ratio = np.where(can, x / np.where(can, direction, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x -= t * direction
        x[out] = t
        np.maximum(x, 0, out=x)
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out] = column
        if step % 400 == 399:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
    patterns = np.zeros((n, len(demand)), np.int64)
    patterns[:, used] = basis.T.round().astype(np.int64)
    return patterns, x, bound


def best_fit(left: np.ndarray, sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Packs counts by class, the largest first, each into the open sequence with the least room that holds it."""
    room: dict[int, list[int]] = {}
    bins: list[np.ndarray] = []
    for k in range(len(left) - 1, -1, -1):
        need = int(sizes[k])
        for _ in range(int(left[k])):
            r = min((r for r in room if r >= need), default=0)
            if r:
                b = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                b, r = len(bins), capacity
                bins.append(np.zeros(len(left), np.int64))
            bins[b][k] += 1
            room.setdefault(r - need, []).append(b)
    return bins


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of uses that place every piece exactly once."""
    if not demand.any():
        return []
    patterns, x, _ = column_generation(demand, sizes, capacity)
    out, left = [], demand.copy()
    for p, n in sorted(zip(patterns, np.floor(x + 1e-9).astype(np.int64), strict=True), key=lambda y: -int(y[1])):
        n = min([int(n), *(int(left[k] // p[k]) for k in np.flatnonzero(p))])  # cover less where a class would be overdrawn
        if n > 0:
            out.append((p, n))
            left -= n * p
    extra = Counter(tuple(b.tolist()) for b in best_fit(left, sizes, capacity))
    return out + [(np.array(p), n) for p, n in sorted(extra.items(), reverse=True)]


def places(plan: list[tuple[np.ndarray, int]], first_sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, last rank, sequence of the first rank, slot): ranks of a class that one slot of one pattern takes, one a sequence."""
    out, next_rank, sequence = [], Counter(), first_sequence
    for p, n in plan:
        slot = 0
        for k in np.flatnonzero(p)[::-1].tolist():
            for _ in range(int(p[k])):
                a = next_rank[k + 1]
                out.append((k + 1, a, a + n - 1, sequence, slot))
                next_rank[k + 1] += n
                slot += 1
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, width: int = WIDTH, end: int = END, exact: int = EXACT) -> DataFrame:
    """Pieces with sequence_id, offset in the sequence and padded_to (the sequence's length with padding)."""
    sizes = class_sizes(capacity, exact, width)
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(BUCKETS)).cast("int")
    rows = cut(pieces(docs, tokenizer, capacity, end, sizes=sizes).withColumn("bucket", bucket))
    counts = rows.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))  # at most (classes + 1) * BUCKETS rows
    histogram = {r["cls"]: r["n"] for r in starts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    demand = np.zeros(len(sizes), np.int64)
    for k, n in histogram.items():
        if k:
            demand[k - 1] = n
    whole = histogram.get(0, 0)
    table = places(solve(demand, sizes, capacity), whole) + ([(0, 0, whole - 1, 0, 0)] if whole else [])
    by_class: dict[int, list] = {}
    for k, a, _, s, slot in sorted(table):
        by_class.setdefault(k, []).append((a, s, slot))
    held = docs.sparkSession.sparkContext.broadcast({k: tuple(np.array(x) for x in zip(*v, strict=True)) for k, v in by_class.items()})
    rank = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(starts.select("cls", "bucket", "base")), ["cls", "bucket"])

    def place(batch: pa.RecordBatch) -> dict:
        k, r = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
        seq, slot = np.zeros(len(k), np.int64), np.zeros(len(k), np.int32)
        for c in np.unique(k).tolist():
            first, s, sl = held.value[c]
            at = np.flatnonzero(k == c)
            i = np.searchsorted(first, r[at], side="right") - 1
            seq[at], slot[at] = s[i] + r[at] - first[i], sl[i]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return {c: batch.column(c) for c in names} | {"sequence_id": seq, "slot": slot}

    kind = dict(docs.dtypes)["doc_id"]
    wide = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("rank") + F.col("base")).alias("rank"))
    put = map_batches(wide, place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot int")
    w = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    power = (used.bitwiseAND(used - 1) == 0) & (used <= capacity)
    return put.withColumn("offset", offset).withColumn("padded_to", F.when(power, used).otherwise(F.lit(capacity)).cast("long")).drop("slot")
