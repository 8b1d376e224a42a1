"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed from left to right into the
longest strings that occur in that sample; the number of such phrases, times the bits to name a place in the sample, over the text's length is the
cross-parsing entropy. The language with the least wins.

Texts are case-folded, every run of characters that are no letters is one space, and letters become symbols of an alphabet of ALPHABET: the commonest are one symbol, the rest
two to four, so that every letter of every script keeps its identity. All automata share one transition table. A batch's texts are parsed side by side in lanes of LANE
symbols, each as if a phrase began with it; then, lane after lane, the phrase that reaches in from the lane before is carried on until it ends where a phrase of
the lane begins. So the phrases are those of the whole text.

Defined results: a null text, or one without letters, is `und` with score 0; equal entropies go to the language first in the alphabet;
without labelled text every prediction is `und`; other columns stay unless they are called lang_pred or score, which are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import cut, map_batches

#: Symbols of labelled text a language, and all together if there are many languages; about twice as many states.
SAMPLE_CHARS, TOTAL_CHARS = 40_000, 640_000
#: Labelled rows that are fetched for a language: different whole texts, those with the least hashes, texts of more than LONG characters only where there are no others.
SAMPLE_ROWS, LONG = 60, 20_000
ALPHABET = 64
LANE = 1024
SPACE = 0
#: First symbols of letters of one, two, three and four symbols.
SINGLE, DOUBLE, TRIPLE, QUAD = 1, 46, 54, 58


@dataclass
class Model:
    languages: list[str]
    letters: dict[str, int]  # rank of each letter of the samples, the commonest first
    table: np.ndarray  # (states, ALPHABET), -1 where no string goes on; all of -1 at a root
    roots: np.ndarray
    first: np.ndarray  # (languages, ALPHABET), where a phrase's first symbol leads
    bits: np.ndarray  # log2 of each sample's length

    def __post_init__(self):
        self.codes = symbols(self.letters)

    def __getstate__(self) -> dict:
        """What travels: the transitions that there are, and code points drawn together."""
        at = np.flatnonzero(self.table >= 0)
        return self.__dict__ | {"table": (self.table.shape, at.astype(np.int32), self.table.reshape(-1)[at]), "codes": zlib.compress(self.codes.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        shape, at, to = state["table"]
        table = np.full(shape[0] * shape[1], -1, np.int32)
        table[at] = to
        self.__dict__ |= state | {"table": table.reshape(shape), "codes": np.frombuffer(zlib.decompress(state["codes"]), np.uint32)}


def ranks(texts: list[str]) -> dict[str, int]:
    """Letters of the samples, folded by case, by how common they are."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    return {c: i for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}


def symbols(letters: dict[str, int]) -> np.ndarray:
    """For each code point its symbols as base-64 digits, the first lowest, with their number in the bits from 24 on; 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    n2, n3 = DOUBLE - SINGLE, DOUBLE - SINGLE + (TRIPLE - DOUBLE) * 64
    most = n3 + (QUAD - TRIPLE) * 4096
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()[0]
            r = letters.get(low, most)
            if r < n2:
                out[p] = SINGLE + r | 1 << 24
            elif r < n3:
                out[p] = DOUBLE + (r - n2) // 64 | (r - n2) % 64 << 6 | 2 << 24
            elif r < most:
                r -= n3
                out[p] = TRIPLE + r // 4096 | r // 64 % 64 << 6 | r % 64 << 12 | 3 << 24
            else:
                r = ord(low)
                out[p] = QUAD + r // 64**3 | r // 4096 % 64 << 6 | r // 64 % 64 << 12 | r % 64 << 18 | 4 << 24
    return out


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of what is no letter drawn together; empty if it has no letter."""
    c = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not c.any():
        return np.empty(0, np.uint8)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    n = np.maximum(c >> 24, 1)
    if int(n.max()) == 1:
        return (c & 63).astype(np.uint8)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.repeat(c & 0xFFFFFF, n) >> (6 * place).astype(np.uint32) & 63).astype(np.uint8)


def suffix_automaton(s: np.ndarray) -> np.ndarray:
    """Transitions of the automaton of all substrings of s; state 0 is the root, -1 is none."""
    table = np.full((2 * len(s) + 2, ALPHABET), -1, np.int32)
    link, length, size, last = [-1], [0], 1, 0
    for c in s.tolist():
        cur, size = size, size + 1
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and table[p, c] < 0:
            table[p, c] = cur
            p = link[p]
        if p != -1:
            q = int(table[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, size = size, size + 1
                table[clone] = table[q]
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and table[p, c] == q:
                    table[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return table[:size]


def choose(texts: list[np.ndarray], room: int) -> np.ndarray:
    """Whole texts in their order, parted by SPACE, as long as they fit in the room; the shortest where none does."""
    out, left = [], room
    for t in texts:
        if len(t) + 1 <= left:
            out += [t, np.full(1, SPACE, np.uint8)]
            left -= len(t) + 1
    return np.concatenate(out[:-1]) if out else min(texts, key=len)


def train(samples: dict[str, list[str]]) -> Model | None:
    """A model from texts by language."""
    languages = sorted(k for k, v in samples.items() if any(c.isalpha() for t in v for c in t))
    if not languages:
        return None
    share = max(1000, min(SAMPLE_CHARS, TOTAL_CHARS // len(languages)))
    letters = ranks([t for k in languages for t in samples[k]])
    codes = symbols(letters)
    tables, roots, bits, at = [], [], [], 0
    for k in languages:
        s = choose([e for t in samples[k] if len(e := encode(t, codes))], share)
        t = suffix_automaton(s)
        tables.append(np.where(t >= 0, t + at, -1))
        roots.append(at)
        bits.append(math.log2(max(len(s), 2)))
        at += len(t)
    table, roots = np.concatenate(tables).astype(np.int32), np.array(roots, np.int32)
    first = np.where(table[roots] >= 0, table[roots], roots[:, None]).astype(np.int32)
    table[roots] = -1
    return Model(languages, letters, table, roots, first, np.array(bits))


def phrases(texts: list[np.ndarray], m: Model, lane: int = LANE) -> np.ndarray:
    """Phrases of each text by language: (texts, languages)."""
    cuts = sorted(((i, k, t[a : a + lane]) for i, t in enumerate(texts) for k, a in enumerate(range(0, len(t), lane))), key=lambda x: -len(x[2]))
    n_lang = len(m.languages)
    out = np.zeros((len(texts), n_lang), np.int64)
    flat, first = m.table.reshape(-1), m.first
    # of each lane: where it is kept, and for lanes of texts with several what is needed to join them
    held: dict[tuple[int, int], tuple] = {}
    n = max(1, 16_000 // n_lang)
    for g in range(0, len(cuts), n):
        part = cuts[g : g + n]
        lengths = np.array([len(x) for _, _, x in part])
        block = np.zeros((int(lengths[0]), len(part)), np.int32)
        for j, (_, _, x) in enumerate(part):
            block[: len(x), j] = x
        state = np.repeat(m.roots[:, None], len(part), axis=1)
        starts = np.zeros((len(block), n_lang, len(part)), bool)
        going = np.searchsorted(-lengths, -np.arange(len(block)), side="left")  # lanes longer than t
        for t in range(len(block)):
            k = going[t]
            c = block[t, :k]
            nxt = flat[state[:, :k].astype(np.int64) * ALPHABET + c]
            new = nxt < 0
            starts[t, :, :k] = new
            state[:, :k] = np.where(new, first[:, c], nxt)
        count = starts.sum(axis=0)
        for j, (i, k, x) in enumerate(part):
            if len(texts[i]) <= lane:
                out[i] = count[:, j]
            else:
                held[i, k] = (x, state[:, j].copy(), np.packbits(starts[: len(x), :, j], axis=0), count[:, j])
    _join(texts, held, out, m, lane)
    return out


def _join(texts: list[np.ndarray], held: dict[tuple[int, int], tuple], out: np.ndarray, m: Model, lane: int) -> None:
    """Adds up the lanes of texts that have several, the phrase at each lane's start carried over from the lane before."""
    flat, n_lang, long = m.table.reshape(-1), len(m.languages), sorted({i for i, _ in held})
    lang = np.tile(np.arange(n_lang), len(long))
    state = np.concatenate([held[i, 0][1] for i in long]) if long else np.empty(0, np.int32)
    for i in long:
        out[i] = held[i, 0][3]
    for k in range(1, max((-(-len(texts[i]) // lane) for i in long), default=0)):
        at = [j for j, i in enumerate(long) if (i, k) in held]
        got = [held[long[j], k] for j in at]
        size = np.repeat([len(x[0]) for x in got], n_lang)
        block = np.zeros((len(at), lane), np.int64)
        starts = np.zeros((len(at), lane, n_lang), bool)
        for r, (x, _, bits, _) in enumerate(got):
            block[r, : len(x)] = x
            starts[r, : len(x)] = np.unpackbits(bits, axis=0, count=len(x)).astype(bool)
        here = (np.array(at)[:, None] * n_lang + np.arange(n_lang)[None, :]).ravel()
        row, lg, st = np.repeat(np.arange(len(at)), n_lang), lang[here], state[here].astype(np.int64)
        end, total = np.concatenate([x[1] for x in got]), np.concatenate([x[3] for x in got]).astype(np.int64)
        go = np.arange(len(here))
        for t in range(lane):
            go = go[size[go] > t]
            if not len(go):
                break
            c = block[row[go], t]
            nxt = flat[st[go] * ALPHABET + c]
            new, own = nxt < 0, starts[row[go], t, lg[go]]
            total[go] += new.astype(np.int64) - own
            st[go] = np.where(new, m.first[lg[go], c], nxt)
            go = go[~(new & own)]  # a phrase begins here in both: the rest is the same
            last = go[size[go] == t + 1]
            end[last] = st[last]
        state[here] = end
        np.add.at(out, (np.array(long)[np.array(at)[row]], lg), total)


def gather(docs: DataFrame, rows: int = SAMPLE_ROWS, long: int = LONG) -> dict[str, list[str]]:
    """Labelled texts by language for training: `rows` different whole texts each (fewer where there are fewer); docs has text and lang."""
    known = docs.filter("lang is not null and text is not null and text <> ''")
    known = known.select("lang", "text", F.xxhash64("text").alias("place"), (F.char_length("text") > long).alias("long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "place"))
    # copies share a place and count once; each task keeps `rows` places a language before it shuffles
    least = known.select("lang", "long", "place").distinct().withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", "place")
    picked = known.join(F.broadcast(cut(least)), ["lang", "place"])
    out: dict[str, list[str]] = {}
    for r in sorted(picked.groupBy("lang", "place").agg(F.first("text").alias("text")).collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
        if len(out.setdefault(r["lang"], [])) < rows:
            out[r["lang"]].append(r["text"])
    return out


def identify(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """lang_pred and score (how much fewer bits than the runner-up, as a share) of every row, beside the columns in carry (default: all)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> dict:
        m = held.value
        pred, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
        texts = [] if m is None else [(i, encode(t, m.codes)) for i, t in enumerate(batch.column("text").to_pylist()) if t]
        texts = [(i, t) for i, t in texts if len(t)]
        if texts:
            entropy = phrases([t for _, t in texts], m) * m.bits / np.array([len(t) for _, t in texts])[:, None]
            order = np.argsort(entropy, axis=1, kind="stable")
            for (i, _), e, o in zip(texts, entropy, order, strict=True):
                pred[i] = m.languages[o[0]]
                score[i] = float(1 - e[o[0]] / e[o[1]]) if len(o) > 1 else 1.0
        return {c: batch.column(c) for c in carry} | {"lang_pred": pred, "score": score}

    cols = list(dict.fromkeys([*carry, "text"]))
    return map_batches(docs.select(*cols), predict, "".join(f"`{c}` {kinds[c]}, " for c in carry) + "lang_pred string, score double")
