"""Exact Jaccard join of word n-gram sets by universe partition and the pigeonhole principle.

Sizes are cut into bands, each 1/threshold wide. Two sets with Jaccard similarity of the threshold or more lie in one band or in
neighbouring ones, and their symmetric difference has at most H elements, H known from the lower band. For each band the universe of
tokens is hashed into m segments, and each segment gets a budget of 0 (its subset must be equal) or 1 (equal after deleting one token on
one side). With sum(budget + 1) > H, one segment of each similar pair is within its budget.

A single shared key says little: stock phrases and empty subsets make keys that unlike sets share. So sum(budget + 1) > H + slack: a similar pair has segments within their
budgets that weigh more than the slack, and both its sets have as many keys that they share with some set. A set that shares no more keys than its slack (segments that may meet in an empty
subset are counted as shared) has no partner in that band; the others are put together by their shared keys.
How many segments get budget 1, and the slack, are decided by the costs that a band's number of sets implies: keys against pairs that meet without being similar.

Keys travel in blocks of bytes, a block for each bucket of keys. A key that several sets of one task share travels once from there, the sets are noted in place, so a key that a third of all sets have is
spread. Sets that share keys form candidate clusters. Clusters are cut into chunks by hash, and within a chunk, to which the cluster's least set is added, every pair
is decided exactly: a parity sketch bounds the symmetric difference from below, pairs that are in one component already need no look, the rest are intersected. Where a cluster of several chunks
then still has several components, it is cut anew, by component, and pairs of those chunks are decided as well, sets of one component excepted. Equal sets are one set from the start, by a 128-bit hash.

Defined results: a null or empty text has no set, links with nothing and is its own component; repeated rows are equal sets; a null doc_id never becomes a component's
id while another is there, and a component of null ids alone has a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import BATCH_ROWS, Scratch, WordHashes, cut, map_batches, mix64, small_batches
from skerry.operators.components import LAST, components, forest

#: Least similarity as a ratio of whole numbers, words in a shingle.
NUM, DEN, WORDS = 90, 100, 3
#: Sets in a chunk of a cluster, about; chunks are more where sets have more shingles than CHUNK_MEAN on average, so that a task's sets stay at some 4 MB. Where pairs of chunks are looked at, a set is sent once for each other chunk.
CHUNK, CHUNK_MEAN = 1024, 500
#: Cost of ruling out a pair by its sketches, as a share of a key's.
PAIR_COST = 0.02
#: Sketch bits; a sketch only spares exact checks.
BITS = 1024
#: Shared keys are numbers from here on: above those of sets.
KEY_NODE = 1 << 50
#: Keys in a bucket, about (12 bytes each while a task gathers them), and keys that a task holds before it passes them on (some 50 bytes each while it works on them).
BUCKET_KEYS, HELD_KEYS = 1_000_000, 1_000_000
#: Keys in a block at most; keys that are sorted and compared at once, about (some 70 bytes each); rows in a batch that is passed on. None grows with the input.
BLOCK_KEYS, SORTED_KEYS, LINK_ROWS = 2048, 250_000, 50_000
#: Up to so many candidate sets (some 60 bytes each) are broadcast to pick texts; beyond, texts are joined by shuffling.
BROADCAST_IDS = 1_000_000
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_B = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if there are fewer words."""
    words = SPLIT.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    k = min(n, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)  # a short sequence never equals a full shingle
    for j in range(k):
        out = mix64(out * _B + ids[j : j + len(out)])
    return np.unique(out)


def band_of(n, num: int = NUM, den: int = DEN):
    """Band of a size n >= 1: bands start at 1, then at the least size that no set of the band before can be a partner of in the next but one."""
    starts = band_starts(num, den)
    return np.searchsorted(starts, n, side="right") - 1


_STARTS: dict = {}


def band_starts(num: int = NUM, den: int = DEN) -> np.ndarray:
    """Lower ends; the next is floor(den / num * (next - 1)) with no partner beyond the following band."""
    if (num, den) not in _STARTS:
        s = [1]
        while s[-1] < 1 << 40:
            s.append(max(s[-1] + 1, s[-1] * den // num))
        _STARTS[num, den] = np.array(s)
    return _STARTS[num, den]


def most_apart(band: int, num: int = NUM, den: int = DEN) -> int:
    """H: the most elements in the symmetric difference of a similar pair whose smaller set is in the band."""
    small = int(band_starts(num, den)[band + 1]) - 1
    return (den - num) * (small + small * den // num) // (den + num)


def tail(mean: float, most: int) -> float:
    """Share of a Poisson distribution beyond `most`; by the normal one where that is many."""
    if most > 200:
        return 0.5 * math.erfc((most + 0.5 - mean) / math.sqrt(2 * mean)) if mean > 0 else 0.0
    term = total = math.exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return max(1 - total, 0.0)


def allocate(band: int, n_sets: int, num: int = NUM, den: int = DEN) -> tuple[int, int, int]:
    """(m, z, slack): segments, how many of them have budget 1, and the weight of segments that may meet in an empty subset, least in cost.

    A key, which is shuffled once, costs 1; an unwanted pair, which a sketch rules out in place, PAIR_COST. m + z > H + slack."""
    h, size = most_apart(band, num, den), int(band_starts(num, den)[band])
    best = None
    for z in sorted({*range(min(h // 2 + 2, 9)), *(h * i // 20 for i in range(11))}):
        for slack in sorted({0, 1, 2, 3, 4, 6, 8, 10, 12, 15, 18, 22, 26, 32, *(h * i // 100 for i in range(20, 33))}):
            m = max(1, h + 1 + slack - z)
            if m < z:
                continue
            mean = size / m
            rare = n_sets * min(tail((m - z) * math.exp(-mean) + 2 * z * math.exp(-mean) * (1 + mean), slack), 1.0)
            cost = n_sets * ((m - z) + z * (1 + mean)) + rare * m * math.exp(-mean) + PAIR_COST * 0.5 * rare * rare
            if slack >= h // 5 and (best is None or cost < best[0]):
                best = (cost, m, z, slack)
    return best[1:]


_BOUNDS: dict = {}


def bounds(m: int) -> np.ndarray:
    """First hash of each segment but the first: hashes are cut into m equal ranges."""
    if m not in _BOUNDS:
        _BOUNDS[m] = np.array([-(-(i << 64) // m) for i in range(1, m)], np.uint64)
    return _BOUNDS[m]


def keys_of(s: np.ndarray, plan: Mapping[int, tuple[int, int, int]], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, list[int]]:
    """All keys of a set (sorted hashes), for its own band and for the band below whose sets it may contain; and by parity of the band how many shared keys leave the set without a partner (-1: none do).

    The lowest bit of a key is its band's parity. Keys of empty subsets are left out where the set can do without them."""
    spare = [-1, -1]
    if not len(s):
        return np.empty(0, np.uint64), spare
    band = int(band_of(len(s), num, den))
    part = mix64(s)
    ends = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(part, out=ends[1:])
    out = []
    for scheme in (band, band - 1):
        if scheme < 0 or scheme != band and len(s) * num > den * (int(band_starts(num, den)[band]) - 1):
            continue
        m, z, slack = plan[scheme]
        at = np.empty(m + 1, np.int64)
        at[0], at[m], at[1:m] = 0, len(s), np.searchsorted(s, bounds(m))
        size = np.diff(at)
        sums = ends[at[1:]] - ends[at[:-1]]
        tag = mix64((np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(scheme))
        low = size == 0
        weight = int(low.sum())
        if z:
            weight += int(low[:z].sum()) + 2 * int((size[:z] == 1).sum())
        whole = weight > slack
        spare[scheme % 2] = -1 if whole else (slack - weight) // (2 if z else 1)
        key = mix64(mix64(sums ^ tag) + size.astype(np.uint64))
        keys = [key if whole else key[~low]]
        if z:
            seg = np.repeat(np.arange(z), size[:z])
            one = mix64(mix64((sums[seg] - part[: len(seg)]) ^ tag[seg]) + size[seg].astype(np.uint64) - np.uint64(1))
            keys.append(one if whole else one[size[seg] > 1])
        out.append(np.unique(np.concatenate(keys) & ~np.uint64(1) | np.uint64(scheme % 2)))
    return np.concatenate(out), spare


def same_enough(inter: int, a: int, b: int, num: int = NUM, den: int = DEN) -> bool:
    return den * inter >= num * (a + b - inter)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the elements that fall on each of BITS places, as rows of 64-bit words."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i in range(0, len(sets), 256):  # counts take 8 bytes a bit
        some = sets[i : i + 256]
        owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
        odd = np.bincount(owner * BITS + (np.concatenate(some) & np.uint64(BITS - 1)).astype(np.int64), minlength=len(some) * BITS) & 1
        out[i : i + 256] = np.packbits(odd.astype(np.uint8).reshape(len(some), BITS), axis=1).view(np.uint64)
    return out


def link(sets: list[np.ndarray], group: np.ndarray | None = None, num: int = NUM, den: int = DEN, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with group (0 or 1), only pairs of different groups are looked at. Sets with one number in known are linked already."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, root = sizes[order], np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1][order]
    sk = sketches([sets[i] for i in order])
    side = group[order] if group is not None else None
    out = []
    for i in range(len(order) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        if stop <= i + 1:
            continue
        most = (den - num) * (sizes[i] + sizes[i + 1 : stop]) // (den + num)
        ok = root[i + 1 : stop] != root[i]
        if side is not None:
            ok &= side[i + 1 : stop] != side[i]
        at = np.flatnonzero(ok)
        if len(at):
            at = at[np.bitwise_count(sk[i + 1 + at] ^ sk[i]).sum(axis=1) <= most[at]]
        for j in (at + i + 1).tolist():
            if root[j] == root[i]:
                continue
            a, b = sets[order[i]], sets[order[j]]
            p = np.searchsorted(b, a)
            inter = int((b[np.minimum(p, len(b) - 1)] == a).sum())
            if same_enough(inter, len(a), len(b), num, den):
                out.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return out


def link_table(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: cluster, task, node, side, root, s (the set); those of a task follow each other. Spanning links of each task: a, b."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nodes, (sides, roots, sets) = list(held), zip(*held.values(), strict=True)
            split = len(set(sides)) > 1
            return [(nodes[a], nodes[b]) for a, b in link(list(sets), np.array(sides) if split else None, num, den, np.array(roots))]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            values, offsets = batch.column("s").flatten().to_numpy(zero_copy_only=False), batch.column("s").offsets.to_numpy()
            offsets, found = offsets - offsets[0], []
            for i, (cluster, part, node, side, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cluster", "task", "node", "side", "root")), strict=True)):
                if (cluster, part) != task:
                    found += close()
                    task, held = (cluster, part), {}
                if node not in held:  # rows of a repeated id and text
                    held[node] = (side, root, values[offsets[i] : offsets[i + 1]].copy().view(np.uint64))
            if found:
                yield batch_of(found)
        if found := close():
            yield batch_of(found)

    return rows.mapInArrow(run, "a long, b long")


def groups(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs (key, node) sorted by both, repeated pairs counted once: keys, nodes, the first place and the size of each entry's key group."""
    if not len(key):
        return key, node, np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node = key[keep], node[keep]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    return key, node, np.repeat(first, size), np.repeat(size, size)


def six(x: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(blocks: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(blocks, np.uint8).reshape(-1, 6) if isinstance(blocks, bytes) else blocks
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :6] = data
    return out.view("<i8").ravel()


def ranges(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the keys (of 48 bits) range by range, about `most` in each; equal keys lie in one range."""
    n = -(-len(key) // most)
    if n <= 1:
        yield np.arange(len(key))
        return
    low = int(key.min())
    of = (key - low) // ((int(key.max()) - low) // n + 1)
    for i in range(n):
        yield np.flatnonzero(of == i)


def prints_of(docs: DataFrame, plan: Plan, buckets: int, num: int, den: int, words: int, carry: tuple[str, ...], held_keys: int) -> DataFrame:
    """Three kinds of rows: a document (doc_id, n, fp, h, even and odd, carry; h is 48 bits of fp, even and odd are what keys_of says of shared keys), a bucket's keys and nodes (h) of
    six bytes each, and nodes with keys that several share in the task.

    A bucket of keys is 0 or more; rows of the other kinds have numbers below, to be dealt out evenly. Such a key is in its bucket with node 0. Bits that are cut off a key or node add candidates at most."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, fp binary, h long, even int, odd int, bucket int, x binary, y binary" + "".join(f", `carry {c}` {dict(docs.dtypes)[c]}" for c in carry)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, nodes, held = WordHashes(), [], [], 0
        kinds: dict = {}

        def whole(cols: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, nodes, held
            key, node = np.concatenate(keys), np.repeat(np.array([h for h, _ in nodes], np.int64), [n for _, n in nodes])
            keys, nodes, held = [], [], 0
            order = np.lexsort((node, key))
            key, node, first, size = groups(key[order], node[order])
            often = size > 1
            bucket, x, y = [], [], []
            at = np.flatnonzero(often)
            for i in range(0, len(at), BLOCK_KEYS):
                part = at[i : i + BLOCK_KEYS]
                bucket.append(-1 - (int(node[0]) + i) % 4093)
                x.append(six(node[part]))
                y.append(six(key[part]))
            here = ~often | (first == np.arange(len(key)))
            key, node = key[here], np.where(often, 0, node)[here]
            to = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # in order, as keys are
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist() + [len(to)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                for i in range(start, stop, BLOCK_KEYS):
                    j = min(i + BLOCK_KEYS, stop)
                    bucket.append(int(to[i]))
                    x.append(six(key[i:j]))
                    y.append(six(node[i:j]))
            for i in range(0, len(bucket), BATCH_ROWS):
                part = slice(i, i + BATCH_ROWS)
                yield whole({"bucket": pa.array(bucket[part], pa.int32()), "x": pa.array(x[part], pa.binary()), "y": pa.array(y[part], pa.binary())}, len(bucket[part]))

        for batch in batches:
            kinds = kinds or {"doc_id": batch.schema.field("doc_id").type, "n": pa.int64(), "fp": pa.binary(), "h": pa.int64(), "even": pa.int32(), "odd": pa.int32(), "bucket": pa.int32(), "x": pa.binary(), "y": pa.binary(), **{f"carry {c}": batch.schema.field(c).type for c in carry}}
            n, fp, h, bucket, spare = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                s = shingles(text, known, words)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                h.append(int.from_bytes(fp[-1][:6], "little") | 1 if len(s) else None)  # never 0
                bucket.append(-1 - ((h[-1] or 0) + k) % 4093)
                own, room = keys_of(s, plan, num, den)
                spare.append(room)
                if len(s):
                    keys.append(own)
                    nodes.append((h[-1], len(keys[-1])))
                    held += len(keys[-1])
                    if held > held_keys:
                        yield from flush()
            cols = {"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "h": pa.array(h, pa.int64()), "bucket": pa.array(bucket, pa.int32())}
            cols |= {"even": pa.array([x for x, _ in spare], pa.int32()), "odd": pa.array([x for _, x in spare], pa.int32())}
            yield whole(cols | {f"carry {c}": batch.column(c) for c in carry}, len(n))
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def key_links(prints: DataFrame, parts: int, carry: tuple[str, ...]) -> DataFrame:
    """Documents as they are (a, b null) and all sets with the keys that they share with others: a, and b from KEY_NODE on."""
    kinds = dict(prints.dtypes)
    own = ["doc_id", "n", "fp", "h", "even", "odd", *[f"carry {c}" for c in carry]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        types: dict = {}

        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(a), t) for t in types.values()), pa.array(a), pa.array(b)], names=[*types, "a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            keys, nodes = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 6) for x in zip(*held, strict=True))
            held.clear()
            keys = unsix(keys)
            for part in ranges(keys, SORTED_KEYS):
                key, node = keys[part], unsix(nodes[part])
                order = np.lexsort((node, key))
                key, node, first, size = groups(key[order], node[order])
                at = np.flatnonzero(((size > 1) | (node[first] == 0)) & (node > 0))
                for i in range(0, len(at), LINK_ROWS):
                    yield links(node[at[i : i + LINK_ROWS]], key[at[i : i + LINK_ROWS]] + KEY_NODE)

        for batch in batches:
            types = types or {c: batch.schema.field(c).type for c in own}
            docs = batch.filter(batch.column("n").is_valid())
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in own), *[pa.nulls(docs.num_rows, pa.int64())] * 2], names=[*own, "a", "b"])
            rest = batch.filter(batch.column("n").is_null())
            for bucket, x, y in zip(*(rest.column(c).to_pylist() for c in ("bucket", "x", "y")), strict=True):
                if bucket < 0:
                    yield links(unsix(x), unsix(y) + KEY_NODE)
                    continue
                if bucket != at:
                    if held:
                        yield from close()
                    at, held = bucket, []
                held.append((x, y))
        if held:
            yield from close()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", a long, b long"
    return prints.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def stars(shared: DataFrame, parts: int) -> DataFrame:
    """a, b: links that put together the sets (a) that have a key (b) in common: with the least set of the key, first in each task, so that a key comes from a task once."""

    def run(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(a), LINK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + LINK_ROWS]), pa.array(b[i : i + LINK_ROWS])], names=["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            nodes, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for part in ranges(keys, SORTED_KEYS):
                key, node = keys[part], nodes[part]
                order = np.lexsort((node, key))
                key, node, first, _ = groups(key[order], node[order])
                center = node[first]
                apart = np.flatnonzero(node != center)
                a, b = node[apart], center[apart]
                order = np.lexsort((b, a))
                a, b, _, _ = groups(a[order], b[order])
                yield from out(a, b)
                if not last:
                    one = np.flatnonzero(first == np.arange(len(key)))
                    yield from out(node[one], key[one])

        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            done = b < KEY_NODE  # links of the first pass
            if done.any():
                yield from out(a[done], b[done])
            held.append((a[~done], b[~done]))
            if not last and sum(len(x) for x, _ in held) > SORTED_KEYS:
                yield from close()
        if held:
            yield from close()

    near = shared.select("a", "b").mapInArrow(lambda x: run(x, False), "a long, b long")
    return near.repartition(parts, F.when(F.col("b") >= KEY_NODE, F.col("b")).otherwise(F.col("a"))).mapInArrow(lambda x: run(x, True), "a long, b long")


class Plan(dict):
    """Budgets by band, made when first asked for; `about` has the number of sets by the binary logarithm of their size. It decides costs only, never results."""

    def __init__(self, about: dict[int, int], num: int, den: int):
        self.about, self.num, self.den = about, num, den

    def __reduce__(self):
        return Plan, (self.about, self.num, self.den)

    def sets(self, band: int) -> int:
        lo, hi = (int(x) for x in band_starts(self.num, self.den)[band : band + 2])
        level = int(math.log2(lo))
        return round(self.about.get(level, 0) * min((hi - lo) / (1 << level), 1.0))

    def __missing__(self, band: int) -> tuple[int, int, int]:
        self[band] = allocate(band, max(1, self.sets(band)), self.num, self.den)
        return self[band]

    def keys(self) -> float:
        """About how many keys all sets make."""
        lows, out = band_starts(self.num, self.den), 0.0
        for band in range(len(lows) - 2):
            if n := self.sets(band):
                m, z, _ = self[band]
                out += 2 * n * (m + z * int(lows[band]) / m)
        return out


def plan_of(docs: DataFrame, num: int, den: int) -> Plan:
    """Sizes are guessed from the texts' bytes."""
    guess = F.greatest(F.octet_length("text") / 6, F.lit(1))
    about = docs.filter("text is not null").groupBy(F.floor(F.log2(guess)).cast("int").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()  # 40 rows at most
    return Plan({r["l"]: r["n"] for r in about}, num, den)


def numbered_labels(labelled: DataFrame) -> DataFrame:
    """labelled (cluster, node, root, label) with c, the label's number in its cluster from 1 on, labels, how many there are, and from and to, the numbers of the labels that it isn't held against: those of its own
    component; none (from 1 to 0) for chunks of several small ones. Each row is a few numbers, however many labels a cluster has: the table may be broadcast."""
    own = F.col("label.own")
    apart = labelled.select("cluster", "label").distinct()
    ordered, same = Window.partitionBy("cluster").orderBy("label"), Window.partitionBy("cluster", own)
    apart = apart.withColumn("c", F.row_number().over(ordered).cast("long"))
    apart = apart.withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    apart = apart.withColumn("from", F.when(own < 0, 1).otherwise(F.min("c").over(same))).withColumn("to", F.when(own < 0, 0).otherwise(F.max("c").over(same)))
    return labelled.join(apart, ["cluster", "label"]).select("cluster", "node", "root", "c", "labels", *(F.col(x).cast("long") for x in ("from", "to")))


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, words: int = WORDS, chunk: int = CHUNK, carry: tuple[str, ...] = (), held_keys: int = HELD_KEYS, last: int = LAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, component_id being the least doc_id that links reach.

    With carry, also root, which names the component whatever its ids are (null without a set), and those columns of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text", *carry)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plan = plan_of(docs, num, den)
    buckets = min(max(parts, math.ceil(plan.keys() / BUCKET_KEYS)), (1 << 31) - 1)
    state: dict = {}

    def again(batch: pa.RecordBatch) -> dict:
        known = state.setdefault("known", WordHashes())
        found = [shingles(t, known, words) for t in batch.column("text").to_pylist()]
        return {"fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], "s": [s.view(np.int64) for s in found]}

    try:
        first = scratch.put(key_links(prints_of(docs, plan, buckets, num, den, words, carry, held_keys), parts, carry), "first")
        narrow = cut(first.filter("n is not null").select("doc_id", "n", "fp", "h", *[F.col(f"carry {c}").alias(c) for c in carry]))
        # a set that shares no more keys of a band than it has to spare has no partner there
        shared = first.filter("b is not null").select("a", "b", (F.col("b") % 2).alias("odd")).distinct()
        times = shared.groupBy("a", "odd").agg(F.count(F.lit(1)).alias("times"))
        spare = first.filter("h is not null").select(F.col("h").alias("a"), F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("odd"), F.col(c).alias("spare")) for k, c in enumerate(("even", "odd"))))))
        spare = spare.groupBy("a", "odd").agg(F.min("spare").alias("spare"))
        needed = shared.join(times.join(spare, ["a", "odd"]).filter("times > spare").select("a", "odd"), ["a", "odd"])
        n_shared = first.filter("b is not null").count()
        clusters = cut(components(stars(needed, max(parts, math.ceil(n_shared / SORTED_KEYS))), last=last))
        scratch.drop("first")

        # one row for each different set, with an id by which its text is found again; null only where no row has one
        one = narrow.filter("fp is not null").groupBy("fp").agg(F.first("h").alias("h"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
        sets = cut(one.withColumn("node", F.monotonically_increasing_id()))
        who = cut(sets.join(clusters.withColumnRenamed("node", "h"), "h").select("node", F.col("component").alias("cluster"), "doc_id", "fp", "n"))
        few = who.count() <= BROADCAST_IDS
        sent = lambda df: F.broadcast(df) if few else df
        picked = docs.select("doc_id", "text").join(sent(who.filter("doc_id is not null").select("doc_id").distinct()), "doc_id", "left_semi").select("text")
        nameless = who.filter("doc_id is null").select("fp")
        whole = map_batches(picked, again, "fp binary, s array<long>")
        if not nameless.isEmpty():
            whole = whole.unionByName(map_batches(docs.filter("doc_id is null").select("text"), again, "fp binary, s array<long>"))
        size = who.groupBy("cluster").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("total"), F.min("node").alias("least")).filter("g > 1")
        chunks = F.ceil(F.greatest(F.col("g") / chunk, F.col("total") / (chunk * CHUNK_MEAN))).cast("int")
        of = cut(who.select("node", "cluster", "fp").join(size, "cluster").withColumn("nc", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("nc")).cast("int")).drop("total"))
        several = not of.filter("nc > 1").isEmpty()
        rows = whole.join(sent(of), "fp")
        if several:
            rows = scratch.put(rows, "rows")

        def links(task: DataFrame) -> DataFrame:
            return link_table(task.repartition(parts, "cluster", "task").sortWithinPartitions("cluster", "task"), num, den)

        # each chunk, with the cluster's least set
        to = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), F.col("nc") - 1)).otherwise(F.array("c")).cast("array<long>")
        found = cut(links(rows.select("cluster", F.explode(to).alias("task"), "node", F.lit(0).alias("side"), F.col("node").alias("root"), "s")))
        if several:  # clusters that are not one component yet: chunks of large components, chunks of several small ones, and all pairs of chunks but those of one component
            now = cut(components(found, last=last))
            held = of.filter("nc > 1").select("cluster", "node", "g", "nc").join(now, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
            by_root = held.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("r"), F.first("g").alias("g"), F.first("nc").alias("nc")).filter("r < g").withColumn("room", F.ceil(F.col("g") / F.col("nc")))
            large = F.col("r") * 2 > F.col("room")
            rest = by_root.groupBy("cluster").agg(F.sum(F.when(~large, F.col("r")).otherwise(0)).alias("rest"))
            parts_of = F.when(large, F.ceil(F.col("r") / F.col("room"))).otherwise(F.greatest(F.ceil(F.col("rest") / F.col("room")), F.lit(1))).cast("int")
            by_root = by_root.join(rest, "cluster").select("cluster", "root", F.when(large, F.col("root")).otherwise(F.lit(-1)).alias("own"), parts_of.alias("np"))
            label = F.struct("own", F.pmod(F.xxhash64(F.when(F.col("own") < 0, F.col("root")).otherwise(F.col("node"))), F.col("np")).cast("int").alias("k"))
            labelled = cut(held.select("cluster", "node", "root").join(by_root, ["cluster", "root"]).select("cluster", "node", "root", label.alias("label")))
            if not labelled.isEmpty():
                wide = rows.select("node", "s").join(sent(numbered_labels(labelled)), "node")
                rest = F.concat(*(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>")) for a, b in ((F.lit(1).cast("long"), F.col("from") - 1), (F.col("to") + 1, F.col("labels")))))
                wide = wide.withColumn("other", F.explode(rest))
                task = F.least("c", "other") * (F.col("labels") + 1) + F.greatest("c", "other")
                side = F.when(F.col("c") > F.col("other"), 1).otherwise(0)
                found = found.unionByName(cut(links(wide.select("cluster", task.alias("task"), "node", side.alias("side"), "root", "s"))))
        joined = cut(components(found, last=last))

        least = narrow.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("lo"))
        nodes = least.join(sets.select("fp", "node"), "fp").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
        nodes = cut(nodes.select("fp", "root", "lo"))
        roots = nodes.groupBy("root").agg(F.min("lo").alias("component_id"))
        named = cut(nodes.join(roots, "root").select("fp", "component_id", "root"))
    finally:
        scratch.drop()
    root = ["root", *carry] if carry else []
    with_set = narrow.filter("fp is not null").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *root)
    alone = narrow.filter("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *([F.lit(None).cast("long").alias("root"), *carry] if carry else []))
    return with_set.unionByName(alone)
