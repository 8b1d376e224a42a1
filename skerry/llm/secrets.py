"""Secret scan: patterns find candidates, a random forest takes out false positives.

Features of a candidate: length, entropy, shares and transitions of character classes, likelihood under letter transitions of ordinary words, coverage by dictionary
words, repeated characters, the path (name of the source) and the words before and behind. The forest is trained from labelled findings: rows
with text, path, start, end and is_secret. What the patterns find in those texts is labelled by the findings that it overlaps, so training sees what a scan sees.
As no table holds such labels, `labelled_findings` makes them: values drawn by the rules of
common key formats and look-alikes (digests, identifiers, placeholders, numbers, words), put into contexts. Own labels can be given instead.

Training takes TRAIN_ROWS labelled findings at most; the scan covers every text, and features every candidate, in full.

Defined results: a null or empty text has no findings; repeated rows each have their own; candidates don't overlap (the earliest, then the longest, stands); an
empty table gives an empty result; other columns are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skerry.llm.common import map_batches

TRAIN_ROWS = 6000
THRESHOLD = 0.5
MASK = "<SECRET>"
#: What is looked for; group v is the candidate, up to its delimiter however long it is. Formats of well-known keys are fixed values.
PATTERNS = {
    "private_key": r"(?P<v>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----END).)*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?)",
    "aws_key_id": r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "github_token": r"\b(?P<v>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,90})\b",
    "prefixed_key": r"\b(?P<v>(?:sk|pk|rk)[-_](?:live|test|proj|ant)?[-_]?[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9_-]{10,}+|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9_-])",
    "jwt": r"\b(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "url_password": r"(?<=[a-z0-9+.-])://[^\s:/@]*+:(?P<v>[^\s:/@]{3,}+)@",
    "assignment": r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?)[\"']?[ \t]{0,3}(?::=|[:=]|=>)[ \t]{0,3}(?:\"(?P<v>[^\"\s]{6,}+)\"|'(?P<v2>[^'\s]{6,}+)'|(?P<v3>[^\s\"'<>,;]{6,}+))",
    "long_token": r"(?<![A-Za-z0-9+/_=.-])(?P<v>(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+={0,2})(?![A-Za-z0-9+/_-])",
}
#: A text without any of these has no candidate (all patterns need one), so most texts cost one search.
ANY = re.compile(r"PRIVATE KEY|A[KS]IA[0-9A-Z]|gh[pousr]_|github_pat_|[srp]k[-_]|xox[abprs]-|AIza|glpat-|eyJ|://[^\s:/@]*+:|(?i:passw|pwd|secret|token|key|credential)|[A-Za-z0-9+/_-]{24}")
COMPILED = {k: re.compile(v, re.S if k == "private_key" else 0) for k, v in PATTERNS.items()}
NEAR = 48
HOT = re.compile(r"(?i)passw|pwd|secret|token|api.?key|access|auth|credential|private|bearer|aws|login")
FAKE = re.compile(r"(?i)example|sample|dummy|placeholder|change.?me|your|xxx|test|fake|redacted|<|\$\{|\*\*\*|todo|123456|abcdef")
COLD = re.compile(r"(?i)sha\d*|md5|hash|digest|checksum|commit|uuid|guid|revision|build|version|id\b|etag|integrity|color|isbn|order|invoice|serial")
PATHS = re.compile(r"(?i)test|example|sample|doc|fixture|mock|demo|spec")
FEATURES = ("length", "entropy", "digits", "uppers", "lowers", "symbols", "transitions", "likelihood", "coverage", "longest_run", "hex", "uuid", "distinct", "hot_before", "fake", "cold_before", "assigned", "quoted", "path_example", "format", "vowels")


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in map(v.count, set(v)))


class Words:
    """Dictionary words and letter transitions, both from a word list."""

    def __init__(self, words: list[str]):
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())
        self.longest = max(map(len, self.words), default=0)
        pairs: dict[str, int] = {}
        firsts: dict[str, int] = {}
        for w in self.words:
            for a, b in zip(w, w[1:], strict=False):
                pairs[a + b] = pairs.get(a + b, 0) + 1
                firsts[a] = firsts.get(a, 0) + 1
        self.logp = {a + b: math.log((pairs.get(a + b, 0) + 0.5) / (firsts.get(a, 0) + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}

    def coverage(self, v: str) -> float:
        """Share of the characters in dictionary words, taken greedily, longest first."""
        low, i, hit = v.lower(), 0, 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 3, -1):
                if low[i : i + n] in self.words:
                    hit += n
                    i += n
                    break
            else:
                i += 1
        return hit / max(len(low), 1)

    def likelihood(self, v: str) -> float:
        got = [self.logp[p] for p in (v[i : i + 2].lower() for i in range(len(v) - 1)) if p in self.logp]
        return sum(got) / len(got) if got else -4.0


def vocabulary(tokenizer: str) -> list[str]:
    """Whole words of a public tokenizer's vocabulary: the dictionary."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return sorted(w.removesuffix("</w>") for w in vocab if w.endswith("</w>"))


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, start: int, end: int, kind: str, path: str | None, words: Words) -> list[float]:
    v = text[start:end]
    n = len(v)
    kinds = [kind_of(c) for c in v]
    share = [kinds.count(k) / len(kinds) for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(len(kinds) - 1, 1)
    run = best = 1
    for a, b in zip(v, v[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    before, behind = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    letters = [c for c in v.lower() if c in string.ascii_lowercase]
    return [
        min(n, 400), entropy(v), share[2], share[1], share[0], share[3], changes, words.likelihood(v), words.coverage(v), best,
        float(all(c in string.hexdigits for c in v)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v))), len(set(v)) / min(n, 64),
        float(bool(HOT.search(before))), float(bool(FAKE.search(v) or FAKE.search(before[-20:]))), float(bool(COLD.search(before[-24:]))), float(bool(re.search(r"[:=]>?[ \t]*[\"']?$", before))), float(before[-1:] in "\"'" and behind[:1] in "\"'" and bool(before)),
        float(bool(path and PATHS.search(path))), float(kind not in ("assignment", "long_token", "url_password")), sum(c in "aeiou" for c in letters) / max(len(letters), 1),
    ]


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, without overlaps: named formats before assignments before long tokens."""
    if not text or not ANY.search(text):
        return []
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    for kind, pattern in COMPILED.items():
        for m in pattern.finditer(text):
            g = next(k for k in ("v", "v2", "v3") if k in pattern.groupindex and m[k] is not None)
            a, b = m.span(g)
            while b > a + 6 and kind == "assignment" and text[b - 1] in ".,;:!?)]}#&%$*":
                b -= 1
            i = bisect_left(taken, (a,))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b, kind))
    return taken


def labelled_findings(n: int = TRAIN_ROWS, seed: int = 7, words: list[str] | None = None) -> list[tuple[str, str, int, int, str, bool]]:
    """(text, path, start, end, kind, is_secret): half are secrets by the rules of key formats, half look-alikes."""
    r = random.Random(seed)
    vocab = [w for w in (words or ["value", "number", "result", "message", "window", "server"]) if w.isascii() and w.isalpha() and len(w) > 3]
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexd = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: r.choice(vocab)
    secret = (
        lambda: ("aws_key_id", "AKIA" + pick(string.ascii_uppercase + "234567", 16)),
        lambda: ("github_token", "ghp_" + pick(alnum, 36)),
        lambda: ("prefixed_key", r.choice(["sk_live_", "sk-", "xoxb-", "glpat-"]) + pick(alnum, r.randint(20, 48))),
        lambda: ("assignment", pick(hexd, r.choice([12, 16, 18, 20, 24, 32, 40, 64]))),
        lambda: ("assignment", pick(alnum, r.randint(16, 64))),
        lambda: ("assignment", pick(alnum + "!@#$%^&*-_", r.randint(8, 24))),
        lambda: ("assignment", word().capitalize() + pick(string.digits, r.randint(2, 4)) + r.choice("!@#$%")),
        lambda: ("long_token", pick(alnum + "+/", 40)),
        lambda: ("url_password", pick(alnum, r.randint(8, 20))),
        lambda: ("private_key", "-----BEGIN RSA PRIVATE KEY-----\n" + pick(alnum + "+/", 200) + "\n-----END RSA PRIVATE KEY-----"),
        lambda: ("jwt", f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '-_', 43)}"),
    )
    clean = (
        lambda: ("long_token", pick(hexd, r.choice([32, 40, 64]))),
        lambda: ("long_token", "-".join(pick(hexd, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("long_token", "_".join(word() for _ in range(r.randint(4, 7))) + str(r.randint(1, 99))),
        lambda: ("long_token", "/".join(word() for _ in range(r.randint(4, 7))) + "/v" + str(r.randint(1, 9))),
        lambda: ("long_token", "".join(word().capitalize() for _ in range(r.randint(4, 6))) + str(r.randint(1, 9))),
        lambda: ("long_token", pick(string.digits, 8) + "-" + word() + "-" + word() + "-" + word() + "-" + word()),
        lambda: ("assignment", r.choice(["changeme", "your_password", "xxxxxxxxxxxx", "password123", "example-token", "<your-token>", "${TOKEN}", "********", "REDACTED"])),
        lambda: ("assignment", r.choice(["os.environ", "settings.get", "config", "self." + word(), "get_" + word() + "()"]) + "." + word()),
        lambda: ("assignment", word() + word()),
        lambda: ("aws_key_id", "AKIA" + "".join(r.choice(["EXAMPLE", "XXXX", "SAMPLE", "TEST"]) for _ in range(6))[:16]),
        lambda: ("prefixed_key", r.choice(["sk-", "sk_test_", "pk_"]) + "-".join(word() for _ in range(4))),
        lambda: ("url_password", r.choice(["password", "pass", "secret", "user", "example"])),
    )
    near = {True: ['{n} = "', "{n}: ", "{n}=", 'export {N}="', "my {n} is {n}: ", "", "Authorization: Bearer "], False: ['sha256 = "', "commit ", "md5: ", "id=", "see ", "", "etag: ", "path = ", "request id "]}
    names = ["password", "secret", "token", "api_key", "access_key", "passwd", "client_secret"]
    out = []
    for i in range(n):
        good = i % 2 == 0
        kind, v = r.choice(secret if good else clean)()
        name = r.choice(names)
        if kind == "assignment":
            head = r.choice(['{n} = "', "{n}: ", "{n}=", "{n} = '"]).format(n=name)
        elif kind == "url_password":
            head = f"postgres://{word()}:"
        elif kind in ("aws_key_id", "private_key", "jwt", "github_token", "prefixed_key"):
            head = r.choice(near[True] + ["in ", "la "]).format(n=name, N=name.upper())
        else:
            head = r.choice(near[good]).format(n=name, N=name.upper())
            head = head or ("key: " if good else "")
        tail = '"' if head.endswith('"') else "'" if head.endswith("'") else f"@{word()}/db" if kind == "url_password" else ""
        before = " ".join(word() for _ in range(r.randint(0, 8))) + " "
        text = before + head + v + tail + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        path = r.choice(["src/app.py", "config/prod.env", "deploy.yaml", "crawl", "web", "notes.txt"] if good or r.random() < 0.6 else ["tests/test_auth.py", "docs/example.md", "fixtures/sample.json"])
        out.append((text, path, len(before + head), len(before + head + v), kind, good))
    return out


class Forest:
    """A random forest of binary trees by Gini impurity, grown on bootstrap samples with sqrt(features) tried at a split."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 11):
        self.n, self.depth, self.least, self.rng, self.trees = trees, depth, least, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.n):
            rows = self.rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, nodes)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[list[float]]) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])  # feature, cut, left, right, value
        if depth >= self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in self.rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            i = np.arange(self.least, len(y) - self.least + 1)
            i = i[v[i - 1] < v[i]]
            if len(i):
                a, b = c[i - 1] / i, (c[-1] - c[i - 1]) / (len(y) - i)
                gini = i * a * (1 - a) + (len(y) - i) * b * (1 - b)
                k = int(gini.argmin())
                if gini[k] < best[0]:
                    best = (gini[k], int(f), float(v[i[k] - 1] + v[i[k]]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[at][:2] = [best[1], best[2]]
            nodes[at][2] = self._grow(x[left], y[left], depth + 1, nodes)
            nodes[at][3] = self._grow(x[~left], y[~left], depth + 1, nodes)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = t[at, 0].astype(np.int64)
                go = f >= 0
                nxt = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(go, nxt, at)
            out += t[at, 4]
        return out / len(self.trees)


def examples(labelled: list[tuple[str, str, int, int, str, bool]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in labelled texts that overlap a finding."""
    got = [(features(t, s, e, kind, p, words), float(good)) for t, p, a, b, _, good in labelled for s, e, kind in candidates(t) if s < b and a < e]
    return np.array([x for x, _ in got]), np.array([y for _, y in got])


class Scanner:
    def __init__(self, words: Words, forest: Forest):
        self.words, self.forest = words, forest

    def __call__(self, texts: list[str | None], paths: list[str | None]) -> list[tuple[int, int, int, str, float]]:
        """(row, start, end, kind, score) of every candidate in the texts."""
        found = [(i, a, b, k) for i, t in enumerate(texts) for a, b, k in candidates(t)]
        if not found:
            return []
        x = np.array([features(texts[i], a, b, k, paths[i], self.words) for i, a, b, k in found])
        return [(*f, float(s)) for f, s in zip(found, self.forest.predict(x), strict=True)]


def train(labelled: list[tuple[str, str, int, int, str, bool]], dictionary: list[str]) -> Scanner:
    words = Words(dictionary)
    x, y = examples(labelled[:TRAIN_ROWS], words)
    return Scanner(words, Forest().fit(x, y))


def scan(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, start, end (in characters), score and is_secret of every candidate. docs: doc_id, text, source (the path)."""
    held = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batch: pa.RecordBatch) -> dict | None:
        got = held.value(batch.column("text").to_pylist(), batch.column("source").to_pylist())
        if not got:
            return None
        return {"doc_id": batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())), "kind": [g[3] for g in got], "start": [g[1] for g in got], "end": [g[2] for g in got], "score": [g[4] for g in got], "is_secret": [g[4] >= threshold for g in got]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text", "source"), run, f"doc_id {kind}, kind string, start long, end long, score double, is_secret boolean")


def redact(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text replaced by MASK; no row goes."""
    held = docs.sparkSession.sparkContext.broadcast(scanner)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        for i, a, b, _, s in reversed(held.value(texts, batch.column("source").to_pylist())):
            if s >= threshold:
                texts[i] = texts[i][:a] + MASK + texts[i][b:]
        return {c: texts if c == "text" else batch.column(c) for c in names}

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
