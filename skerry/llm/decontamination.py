"""Benchmark decontamination by winnowing.

Fingerprints are the minimum k-gram hash of every sliding window. For spans of t words, k = min(t, 5) and windows of t - k + 1
k-grams are used, so that any t words shared by a document and an item give both the same fingerprint at the same
place in the span. Document fingerprints are joined with the items' fingerprints; each hit is extended to the windows of t words
that cover it, and those are looked up by the hash of all t words and then compared word by word.

Items of fewer than `span` words are one window of all their words; each such length is a class of its own with its own k and window, so
that the guarantee holds there too.

The items' fingerprints are broadcast in blocks of at most BLOCK_WORDS item words; with more words the documents pass once for each
block, and what was found before travels along. Nothing is sent to the driver but the item texts of one block.

Defined results: a null text has no words, no hits and is not contaminated; items without words are ignored; repeated documents or items give each
row its own result (equal item ids count once); items without an id count as one item, which the list of ids and its digest leave out; an empty benchmark finds nothing;
other columns stay unless they bear the names added here, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, WordHashes, map_batches, mix64

SPAN = 13
K = 5
#: Words of items in one broadcast block (some 100 MB in a Python worker, besides an item that is longer by itself).
BLOCK_WORDS = 1_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_B = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return [] if text is None else WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive ids, one for each start."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _B
        out += ids[j : j + m]
    return mix64(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the first least hash of every window, each once, in order."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    if window == 1:
        return np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    picked = np.empty(len(view), np.int64)
    for a in range(0, len(view), 1 << 20):  # argmin over a view of bounded size
        picked[a : a + (1 << 20)] = view[a : a + (1 << 20)].argmin(axis=1) + np.arange(a, min(a + (1 << 20), len(view)))
    keep = np.ones(len(picked), bool)
    keep[1:] = picked[1:] != picked[:-1]
    return picked[keep]


class Block:
    """Fingerprints and windows of some items, by length of the shared span. Windows are three sorted arrays: hash, item and place; items share their words."""

    def __init__(self, items: list[tuple], span: int = SPAN, k: int = K):
        self.span = span
        self.classes: dict[int, tuple] = {}
        self.ids, self.words = [], []
        known, same = WordHashes(), {}
        by: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            if w := words_of(text):
                by[min(span, len(w))].append(len(self.ids))
                self.ids.append(item_id)
                self.words.append([same.setdefault(x, x) for x in w])
        for t, group in sorted(by.items()):
            kk = min(k, t)
            prints, full, item, place = [], [], [], []
            for i in group:
                w = self.words[i]
                ids = np.fromiter((known[x] for x in w), np.uint64, len(w))
                grams = gram_hashes(ids, kk)
                prints.append(grams[winnow(grams, t - kk + 1)])
                full.append(gram_hashes(ids, t))
                item.append(np.full(len(full[-1]), i, np.int32))
                place.append(np.arange(len(full[-1]), dtype=np.int32))
            h = np.concatenate(full)
            order = np.argsort(h, kind="stable")
            self.classes[t] = (kk, t - kk + 1, np.unique(np.concatenate(prints)), h[order], np.concatenate(item)[order], np.concatenate(place)[order])

    def hits(self, words: list[bytes], ids: np.ndarray) -> tuple[list[tuple[int, int]], set, bool]:
        """Hit spans of one document as (start, length), the items with an occurring window, and whether one of those has all `span` words."""
        spans, found, long = [], set(), False
        for t, (k, window, prints, full, item, place) in self.classes.items():
            if len(ids) < t:
                continue
            grams = gram_hashes(ids, k)
            places = winnow(grams, window)
            at = np.searchsorted(prints, grams[places])
            at[at == len(prints)] = 0
            places = places[prints[at] == grams[places]]
            if not len(places):
                continue
            starts = np.unique((places[:, None] - np.arange(window)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(ids) - t)]
            h = gram_hashes(ids, t)[starts]
            lo, hi = np.searchsorted(full, h), np.searchsorted(full, h, side="right")
            for j in np.flatnonzero(lo < hi).tolist():
                s = int(starts[j])
                own = words[s : s + t]
                same = [i for i, p in zip(item[lo[j] : hi[j]].tolist(), place[lo[j] : hi[j]].tolist(), strict=True) if self.words[i][p : p + t] == own]
                if same:
                    spans.append((s, t))
                    found.update(self.ids[i] for i in same)
                    long = long or t == self.span
        return spans, found, long


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n])
    return [tuple(x) for x in out]


def _blocks(bench: DataFrame, limit: int):
    """The items as rows, and the number of blocks for which none has more than about `limit` words."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.greatest(F.length("text") / 2, F.lit(1)))).first()[0] or 0  # words, at most
    return items, max(1, -(-int(total) // limit))


ADDED = ("n_words", "hit_spans", "item_ids", "whole_window")


def find_overlaps(docs: DataFrame, bench: DataFrame, span: int = SPAN, block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """n_words, hit_spans (array of start and length in words, merged), item_ids (strings, sorted, null last) and whole_window (a window of `span` words is hit) of every row of docs, beside the columns in carry (default: all)."""
    spark, carry, base = docs.sparkSession, [c for c in (docs.columns if carry is None else carry) if c not in ADDED], docs
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    items, n = _blocks(bench, block_words)
    scratch = Scratch(spark) if n > 1 else None
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.distinct().collect()])  # one block
        if i:
            base = scratch.put(base, f"pass{i}")
            if i > 1:
                scratch.drop(f"pass{i - 1}")
        keep = list(dict.fromkeys([*carry, *(["text"] if i < n - 1 else [])]))
        out_schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_words long, hit_spans array<struct<start:int,length:int>>, item_ids array<string>, whole_window boolean"
        state: dict = {}

        def scan(batch: pa.RecordBatch, held=held, first=i == 0, state=state, keep=keep) -> dict:
            if "block" not in state:
                state["block"], state["known"] = Block(held.value, span), WordHashes()
            block, known = state["block"], state["known"]
            n_words, spans, found, whole = [], [], [], []
            before = [None] * batch.num_rows if first else zip(*(batch.column(c).to_pylist() for c in ADDED[1:]), strict=True)
            for text, old in zip(batch.column("text").to_pylist(), before, strict=True):
                words = words_of(text)
                n_words.append(len(words))
                s, items_, long = block.hits(words, np.fromiter((known[w] for w in words), np.uint64, len(words))) if words else ([], set(), False)
                if old:
                    s, items_, long = s + [(x["start"], x["length"]) for x in old[0]], items_ | set(old[1]), long or old[2]
                spans.append([{"start": a, "length": b} for a, b in merged(s)])
                found.append(sorted(items_, key=lambda x: (x is None, x or "")))
                whole.append(long)
            return {c: batch.column(c) for c in keep} | {"n_words": n_words, "hit_spans": spans, "item_ids": found, "whole_window": whole}

        base = map_batches(base if i else base.select(*dict.fromkeys([*carry, "text"])), scan, out_schema)
    return base


def judge(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (a twentieth of the words hit, or more)."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return (
        found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
