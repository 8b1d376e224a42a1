"""Cross-entropy difference of two matched n-gram models.

Target and background models share one vocabulary (all words of the documents), order and smoothing, and the background's counts are scaled to the target's
number of tokens. Both are interpolated bigram models. A document's score is its loss per token under the background model less that under the target
model: high scores look like the target. A document's first word has no context: its unigram probability counts. No document is scored by its own words: its own counts
are taken out of the background's, and out of the target's where it is of the target, so all losses are held-out ones.

With counts c (less the document's own, times the scale), N tokens and V different words, P(y) = (c(y) + 1) / (N + V) and P(y | x) = (c(x, y) + KAPPA P(y)) / (c(x) + KAPPA). N is that of
all documents, and c(x) counts x at the end of documents, too; so probabilities add up to a little less than 1, never to more.

All counts are exact and grow with the corpus. Counts of the VOCABULARY commonest words and of the bigrams among TOP words, the commonest in a sample, are broadcast, and documents are
scored by them in place. The rest travels in blocks of bytes, a block for each batch of documents and bucket of keys, with an entry for each document and bigram, dealt by the second word where that is
rare, else by the bigram: what meets there are all its occurrences, so the same exchange counts and scores. Sums go back to the batch, again in blocks. The number of buckets grows with the tokens, and a word
beyond the TOP has at most 1 / TOP of all tokens, which bounds what meets. Rare words and such bigrams are told apart by hashes: by the bucket and 48 more bits.

Defined results: a null or empty text has no tokens and null losses and score; repeated documents count each time, so a copy is scored by its other copies; without target documents every
score is null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, WordHashes, map_batches, mix64, small_batches

#: Words whose counts are broadcast; of those, the words whose bigrams are (TOP^2 counts). They decide costs only, never results.
VOCABULARY, TOP = 50_000, 1024
#: Sums of documents (26 bytes each) that a task holds before it passes them on.
HELD_SUMS = 1_000_000
#: Tokens for which there is a bucket, at least.
BUCKET_TOKENS = 500_000
#: Pseudo-count with which the unigram model enters the bigram model.
KAPPA = 2.0
#: Words that a task holds before it passes its counts on, and characters of texts that it works on at once (or one text).
HELD, AT_ONCE = 200_000, 600_000
#: Rows of the sample that the TOP words are taken from, about.
SAMPLE_ROWS = 3000
WORD = re.compile(r"\w+|[^\w\s]")
#: Up to so many labelled ids are broadcast; beyond, they are joined by shuffling.
BROADCAST_IDS = 2_000_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mark_target(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """text and target (0 or 1) of every document, beside doc_id."""
    ids = target_ids.select("doc_id").distinct().withColumn("target", F.lit(1))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select("doc_id", "text").join(ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(0)))


class Numbers(dict):
    """Words to numbers from 0, new ones in the order in which they are asked for."""

    def __init__(self):
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def parts(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[int, int, list[list[str]]]]:
    """Ranges of a batch's rows, each with at_once characters at most (or one row), and their tokens."""
    texts, a, size = batch.column("text").to_pylist(), 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > at_once:
            yield a, i, [tokens(x) for x in texts[a:i]]
            a, size = i, 0
        size += n
    if texts:
        yield a, len(texts), [tokens(x) for x in texts[a:]]


def counts_of(marked: DataFrame, top: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """word or cell, t and b: occurrences in the target and in all documents of each word, and of bigrams of two words of top, cell being their places as one number."""
    held, size = marked.sparkSession.sparkContext.broadcast(top), len(top)
    small_batches(marked.sparkSession)
    names = ["word", "cell", "t", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = {w: i for i, w in enumerate(held.value)}
        numbers, place, words = Numbers(), np.empty(0, np.int64), np.zeros((2, 0), np.int64)
        cells = np.zeros((2, size * size), np.int64)

        def flush() -> pa.RecordBatch:
            n = len(numbers.words)
            return pa.RecordBatch.from_arrays([pa.array(numbers.words, pa.string()), pa.nulls(n, pa.int64()), pa.array(words[1]), pa.array(words[0])], names=names)

        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for a, z, lists in parts(batch, at_once):
                n = np.array([len(x) for x in lists], np.int64)
                y = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
                if not len(y):
                    continue
                more = len(numbers.words) - len(place)
                place = np.r_[place, np.fromiter((place_of.get(w, -1) for w in numbers.words[len(place) :]), np.int64, more)]
                words = np.concatenate([words, np.zeros((2, more), np.int64)], axis=1)
                row, of_target = np.repeat(np.arange(len(n)), n), np.repeat(target[a:z], n)
                words[0] += np.bincount(y, minlength=len(place))
                words[1] += np.bincount(y[of_target], minlength=len(place))
                if size:
                    p = place[y]
                    inside = (p[:-1] >= 0) & (p[1:] >= 0) & (row[:-1] == row[1:])
                    c = (p[:-1] * size + p[1:])[inside]
                    cells[0] += np.bincount(c, minlength=size * size)
                    cells[1] += np.bincount(c[of_target[1:][inside]], minlength=size * size)
                if len(place) > HELD:
                    yield flush()
                    numbers, place, words = Numbers(), np.empty(0, np.int64), np.zeros((2, 0), np.int64)
        yield flush()
        at = np.flatnonzero(cells[0])
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part, pa.int64()), pa.array(cells[1][part]), pa.array(cells[0][part])], names=names)

    return marked.select("text", "target").mapInArrow(run, "word string, cell long, t long, b long").groupBy("word", "cell").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def hash_of(word: str, known: WordHashes) -> int:
    return known[word.encode("utf-8", "surrogatepass")]


#: Entries of a block, and the bytes of each: the key (odd where the second word is rare), sub, how often the bigram and the second word are in the document, how often a next word follows, the document's place in its
#: batch. Bytes of one weight follow each other, which lets Spark's compression draw together what is mostly zeros.
ENTRY = (("key", 6), ("sub", 6), ("m", 4), ("o", 4), ("c", 4), ("off", 2))
WIDTH = sum(n for _, n in ENTRY)
#: Bit of `off` that marks documents of the target.
TARGET = 1 << 15


def packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for x, (_, n) in zip(columns, ENTRY, strict=True))


def unpacked(data: bytes) -> list[np.ndarray]:
    """The columns as unsigned 64-bit numbers."""
    planes, at, out = np.frombuffer(data, np.uint8).reshape(WIDTH, -1), 0, []
    for _, n in ENTRY:
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :n] = planes[at : at + n].T
        out.append(wide.view("<u8").ravel())
        at += n
    return out


def counted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows equal in all columns (64-bit, told apart by one hash): a place of each, which it is, and how many there are."""
    mark = mix64(columns[0])
    for x in columns[1:]:
        mark = mix64(mark + x)
    order = np.argsort(mark)
    mark = mark[order]
    new = np.r_[np.ones(min(len(mark), 1), bool), mark[1:] != mark[:-1]]
    which = np.empty(len(mark), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.bincount(which, minlength=int(new.sum()))


class Places(dict):
    """Words of the vocabulary to places from 1, others to 0."""

    def __missing__(self, word: str) -> int:
        return 0


def entries(marked: DataFrame, vocabulary: list[str], size: int, single: np.ndarray, pairs: np.ndarray, totals: np.ndarray, n_words: int, buckets: int, at_once: int = AT_ONCE) -> DataFrame:
    """bucket, batch, off, doc_id, n, t, b, data. A row for each document (bucket below 0) with the bits of the losses that broadcast counts give, and a row of entries for each batch and bucket.

    sub of an entry with a rare second word is the first word (0 at the start), else the second word's place in the vocabulary."""
    held = marked.sparkSession.sparkContext.broadcast((vocabulary, single, pairs))
    kind, scale = dict(marked.dtypes)["doc_id"], totals[0] / totals[1]
    small_batches(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, single, pairs = held.value
        known, hashes = Places({w: i + 1 for i, w in enumerate(words)}), WordHashes()
        h = np.fromiter((0, *(hash_of(w, hashes) for w in words)), np.uint64, len(words) + 1)
        number = TaskContext.get().partitionId() << 33
        for batch, a, z, lists in ((b, *part) for b in batches for part in parts(b, at_once)):
            number += 1
            n = np.array([len(x) for x in lists], np.int64)
            flat = list(chain.from_iterable(lists))
            y = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            hy = h[y]
            rare = np.flatnonzero(y == 0)
            hy[rare] = np.fromiter((hash_of(flat[i], hashes) for i in rare.tolist()), np.uint64, len(rare))
            row = np.repeat(np.arange(len(n)), n)
            begins = np.cumsum(n)[n > 0] - n[n > 0]
            begin, more = np.zeros(len(y), bool), np.ones(len(y), np.int64)
            begin[begins] = True
            more[begins[1:] - 1], more[-1:] = 0, 0
            x, hx = np.roll(y, 1), np.roll(hy, 1)
            x[begin], hx[begin] = 0, 0
            target = batch.column("target").slice(a, z - a).to_numpy(zero_copy_only=False).astype(np.int64)
            _, which, times = counted(row.astype(np.uint64), hy)
            own_word = times[which]
            first, which, times = counted(row.astype(np.uint64), hy, hx)
            own_pair = times[which]
            follows = np.bincount(which, more, len(first)).astype(np.int64)
            inside = (x > 0) & (x <= size) & (y > 0) & (y <= size)
            here = inside | begin & (y > 0)
            cell = np.where(inside, (x - 1) * size + y - 1, 0)
            loss = []
            for k in (0, 1):
                by, mine = (scale, 1) if k else (1.0, target[row])
                word = (single[k][y] - mine * own_word) * by
                pair = np.where(inside, (pairs[k][cell] - mine * own_pair) * by, 0.0)
                v = np.where(begin, np.log2(KAPPA), 0.0)
                v[y > 0] += (more * np.log2(np.maximum(word, 0) + KAPPA))[y > 0]
                v[here] -= np.log2(pair + KAPPA * (word + 1) / (totals[0] + n_words))[here]
                loss.append(np.bincount(row, v, len(n)))
            keep = np.flatnonzero(~here[first])
            keep = keep[np.argsort(first[keep])]  # in the documents' order
            one = first[keep]
            m, c, o = times[keep], follows[keep], own_word[one]
            is_rare = y[one] == 0
            both = mix64(hx[one] * np.uint64(0x9E3779B97F4A7C15) + hy[one])
            key = np.where(is_rare, hy[one] | np.uint64(1), both & ~np.uint64(1))
            sub = np.where(is_rare, hx[one], y[one].astype(np.uint64))
            to = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(to * np.uint64(2) + is_rare.astype(np.uint64), kind="stable")
            to, cols = to[order], [v[order] for v in (key, sub, m, o, c * is_rare, row[one] + target[row[one]] * TARGET)]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist() + [len(to)] if len(to) else [0]
            blocks = [packed([v[i:j] for v in cols]) for i, j in zip(cuts, cuts[1:], strict=False)]
            ids = batch.column("doc_id").slice(a, z - a)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - (number + np.arange(len(n))) % 4093, pa.int32()), pa.array(np.full(len(n), number)), pa.array(np.arange(len(n), dtype=np.int32)), ids, pa.array(n), pa.array(loss[0]), pa.array(loss[1]), pa.nulls(len(n), pa.binary())], names=NAMES)
            if blocks:
                k = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int32)), pa.array(np.full(k, number)), pa.nulls(k, pa.int32()), pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(blocks, pa.binary())], names=NAMES)

    return marked.select("doc_id", "text", "target").mapInArrow(run, f"bucket int, batch long, off int, doc_id {kind}, n long, t double, b double, data binary")


NAMES = ["bucket", "batch", "off", "doc_id", "n", "t", "b", "data"]


def losses(blocks: DataFrame, single: np.ndarray, totals: np.ndarray, n_words: int) -> DataFrame:
    """The same columns: documents as they are, and rows (bucket 0) with the sums of a batch's documents over the buckets of a task, as far as it holds them. Rows of a bucket follow each other."""
    held, scale = blocks.sparkSession.sparkContext.broadcast(single), totals[0] / totals[1]
    schema = ", ".join(f"{c} {t}" for c, t in blocks.dtypes)

    def sums(numbers: list[int], data: list[bytes]) -> tuple[np.ndarray, ...]:
        parts = [unpacked(d) for d in data]
        source = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        key, sub, m, o, c, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((sub, key))
        key, sub, m, o, c, off, source = key[order], sub[order], *(x[order].astype(np.int64) for x in (m, o, c, off)), source[order]
        target, rare = (off >= TARGET).astype(np.int64), key & np.uint64(1) == 1
        new = np.r_[True, key[1:] != key[:-1]]
        group, fine = np.cumsum(new) - 1, np.cumsum(new | np.r_[True, sub[1:] != sub[:-1]]) - 1
        where, which = np.unique(source * (TARGET << 1) + off, return_inverse=True)
        out = []
        for k, mine in enumerate((target, np.ones_like(target))):
            by = scale if k else 1.0
            every = np.where(rare, np.bincount(group, m * mine)[group], held.value[k][np.where(rare, 0, sub).astype(np.int64)])
            word = (every - mine * o) * by
            pair = (np.bincount(fine, m * mine)[fine] - mine * m) * by
            pair[rare & (sub == 0)] = 0  # the first word of a document
            v = c * np.log2(np.maximum(word, 0) + KAPPA) - m * np.log2(pair + KAPPA * (word + 1) / (totals[0] + n_words))
            out.append(np.bincount(which, v, len(where)))
        return np.array(numbers, np.int64)[where // (TARGET << 1)], where % TARGET, *out

    def together(held_sums: list[tuple[np.ndarray, ...]]) -> tuple[list[int], list[bytes]]:
        number, place, t, b = (np.concatenate(x) for x in zip(*held_sums, strict=True))
        order = np.lexsort((place, number))
        number, place = number[order], place[order]
        new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (place[1:] != place[:-1])])
        t, b, number, place = np.add.reduceat(t[order], new), np.add.reduceat(b[order], new), number[new], place[new].astype("<u2")
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist() + [len(number)]
        return number[cuts[:-1]].tolist(), [b"".join(x[i:j].tobytes() for x in (t, b, place)) for i, j in zip(cuts, cuts[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, data, types, done = None, [], [], {}, []

        def emit() -> pa.RecordBatch:
            of, rows = together(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(of), np.int32)), pa.array(of, pa.int64()), *(pa.nulls(len(of), types[c]) for c in NAMES[2:7]), pa.array(rows, pa.binary())], names=NAMES)

        for batch in batches:
            types = types or {f.name: f.type for f in batch.schema}
            docs = batch.filter(batch.column("data").is_null())
            if docs.num_rows:
                yield docs
            rest = batch.filter(batch.column("data").is_valid())
            for bucket, number, block in zip(*(rest.column(c).to_pylist() for c in ("bucket", "batch", "data")), strict=True):
                if bucket != at:
                    if data:
                        done.append(sums(numbers, data))
                        if sum(len(x[0]) for x in done) > HELD_SUMS:
                            yield emit()
                    at, numbers, data = bucket, [], []
                numbers.append(number)
                data.append(block)
        if data:
            done.append(sums(numbers, data))
        if done:
            yield emit()

    return blocks.mapInArrow(run, schema)


def gathered(rows: DataFrame) -> DataFrame:
    """doc_id, n, t and b of each document, its sums added. Rows of a batch follow each other."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, data = None, [], []

        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(docs).sort_by("off")
            both = [whole.column(c).to_numpy().copy() for c in ("t", "b")]
            for d in data:
                k = len(d) // 18
                place = np.frombuffer(d, "<u2", k, 16 * k)
                for j in (0, 1):
                    both[j][place] += np.frombuffer(d, "<f8", k, 8 * k * j)  # places of a block are different
            ids = whole.column("doc_id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays([ids, pa.array(whole.column("n").to_numpy()), *map(pa.array, both)], names=["doc_id", "n", "t", "b"])

        for batch in batches:
            numbers = batch.column("batch").to_numpy()
            cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]).tolist() + [len(numbers)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if at is not None and numbers[i] != at:
                    yield close()
                    docs, data = [], []
                at, part = numbers[i], batch.slice(i, j - i)
                docs.append(part.filter(part.column("data").is_null()))
                data += part.column("data").drop_null().to_pylist()
        if at is not None:
            yield close()

    return rows.mapInArrow(run, f"doc_id {kind}, n long, t double, b double")


def score(docs: DataFrame, target_ids: DataFrame, vocabulary_size: int = VOCABULARY, top: int = TOP, bucket_tokens: int = BUCKET_TOKENS, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a token) and score of every document."""
    spark = docs.sparkSession
    marked = mark_target(docs, target_ids)
    scratch = Scratch(spark)
    n_rows = marked.count()
    sample = marked if n_rows <= SAMPLE_ROWS else marked.sample(False, SAMPLE_ROWS / n_rows, 3)
    first = [r["word"] for r in counts_of(sample, [], at_once).orderBy(F.desc("b"), "word").limit(top).collect()]
    both = scratch.put(counts_of(marked, first, at_once), "counts")
    counts = both.filter("word is not null").withColumn("level", F.floor(F.log2("b") * 64))
    # levels of counts, some thousand rows; the commonest that hold vocabulary_size words at most, so that equal counts stay together
    levels, least, room = sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]), None, vocabulary_size
    for r in levels:
        if r["n"] > room:
            break
        least, room = r["level"], room - r["n"]
    chosen = spark.createDataFrame([(w, i) for i, w in enumerate(first)], "word string, place int")
    kept = counts.join(F.broadcast(chosen), "word", "left").filter("place is not null" if least is None else f"place is not null or level >= {least}")
    common = kept.select("word", "t", "b", F.coalesce("place", F.lit(1 << 30)).alias("place")).toArrow().sort_by([("place", "ascending"), ("b", "descending"), ("word", "ascending")])  # vocabulary_size + top rows
    vocabulary = common.column("word").to_pylist()
    total = counts.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    totals = np.array([total["t"] or 0, total["b"] or 0], float)
    kind = dict(docs.dtypes)["doc_id"]
    if not totals[0]:
        scratch.drop()

        def lengths(batch: pa.RecordBatch) -> dict:
            none = [None] * batch.num_rows
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(tokens(t)) for t in batch.column("text").to_pylist()], "target_loss": none, "background_loss": none, "score": none}

        return map_batches(docs.select("doc_id", "text"), lengths, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    single = np.zeros((2, len(vocabulary) + 1), np.int64)
    single[0, 1:], single[1, 1:] = common.column("t").to_numpy(), common.column("b").to_numpy()
    size = len(first)
    got = both.filter("cell is not null").select("cell", "t", "b").toArrow()  # top^2 rows at most
    scratch.drop()
    pairs, at = np.zeros((2, max(size * size, 1)), np.int64), got.column("cell").to_numpy()
    pairs[0, at], pairs[1, at] = got.column("t").to_numpy(), got.column("b").to_numpy()
    del got, common
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = min(max(n_parts, -(-int(totals[1]) // bucket_tokens)), (1 << 31) - 1)
    blocks = entries(marked, vocabulary, size, single, pairs, totals, total["n"], buckets, at_once).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    done = gathered(losses(blocks, single, totals, total["n"]).repartition(n_parts, "batch").sortWithinPartitions("batch"))
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    done = done.select("doc_id", F.col("n").alias("n_tokens"), mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return done.withColumn("score", F.col("background_loss") - F.col("target_loss"))
