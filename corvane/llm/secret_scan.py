"""Operator 7, secret scans: rules propose, a random forest removes false positives.

Rules are wide: known key prefixes, private-key headers, values assigned to telling
names, and long mixed tokens. Each candidate then gets features: its length, how often
neighbouring characters change class, how much of it dictionary words cover (the words
of four letters and more in a public vocabulary file), whether it looks like a path, an identifier, a hash or a placeholder, and which
words stand around it. A random forest, trained on labelled findings, gives the
probability that it is a secret; those of MIN_PROBABILITY and more are kept.

The forest is trained here, in numpy, on findings made by a seeded generator
(labelled_findings), or on labelled findings that the caller passes. It is some
thousand numbers and goes to every task; documents are scanned whole, in place.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tokens import slices

MIN_PROBABILITY = 0.5
TREES = 40
DEPTH = 8
_SLICE = 6 << 20
_BLOCK = 4096  # candidates that the forest judges together
_LONG_WORD = 15  # bytes of the shortest finding without a telling name: xoxb- and ten more

# fixed values: prefixes and headers of well-known credentials, and names of secrets
_RULES = (
    ("aws_key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("github_token", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    ("slack_token", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google_key", re.compile(r"\bAIza[0-9A-Za-z_-]{35}")),
    ("stripe_key", re.compile(r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{11,}(?:\.[A-Za-z0-9_-]+){2,}")),  # narrowed by _jwts
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("assigned", re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credential)s?[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.~!@$%^&*-]{8,}={0,2})")),
    ("long_token", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")),
)
_NAMES = (b"passw", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"-----begin", "\u017f".encode(), "\u212a".encode())  # the last two equal s and k without case
_GOOD = frozenset("password passwd pwd secret token key api apikey auth bearer credential credentials access private aws client".split())
_BAD = frozenset("example sample test dummy placeholder sha sha1 sha256 md5 hash checksum commit digest uuid guid id image file path url build version integrity etag your insert changeme".split())
_JWT_HEAD = re.compile(r"\beyJ")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
_RUN = re.compile(r"(.)\1{3,}")

Finding = tuple[str, int, int]


def _jwts(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """In dotted runs, leftmost: \\beyJ and eight more characters, then two runs of eight or more."""
    at, runs = low, []
    for run in text[low:high].split("."):
        runs.append((at, at + len(run)))
        at += len(run) + 1
    k = 0
    while k + 2 < len(runs):
        a, b = runs[k]
        head = _JWT_HEAD.search(text, a, b - 8) if all(y - x >= 8 for x, y in runs[k + 1 : k + 3]) else None
        if head:
            yield head.start(), runs[k + 2][1]
        k += 3 if head else 1


def candidates(text: str) -> list[Finding]:
    """(rule, start, end) of what the rules propose; a later rule does not overlap an earlier one."""
    starts: list[int] = []
    out: list[Finding] = []  # apart, ascending
    for rule, pattern in _RULES:
        if rule == "jwt" and "eyJ" not in text:
            continue
        for m in pattern.finditer(text):
            if rule == "jwt":
                spans = _jwts(text, *m.span())
            else:
                spans = (m.span("value") if "value" in pattern.groupindex else m.span(),)
            for a, b in spans:
                k = bisect_left(starts, a)
                if (k == len(out) or b <= out[k][1]) and (k == 0 or out[k - 1][2] <= a):
                    starts.insert(k, a)
                    out.insert(k, (rule, a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def dictionary(vocabulary: str) -> frozenset[str]:
    """The words of four letters and more that a byte-level vocabulary file holds whole."""
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = (t[1:].lower() for t in tokens if t[0] == "\u0120")  # how such files spell a leading space
    return frozenset(w for w in words if len(w) > 3 and w.isascii() and w.isalpha())


def features(text: str, finding: Finding, words: frozenset[str]) -> list[float]:
    """What the forest sees of a candidate; words: a dictionary."""
    rule, a, b = finding
    value = text[a:b]
    n = len(value)
    kinds = [_kind(c) for c in value]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    covered = sum(len(w) for w in parts if w in words) / n
    longest = max(map(len, parts), default=0) / n
    before, after = text[max(0, a - 40) : a].lower(), text[b : b + 24].lower()
    near = re.findall(r"[a-z0-9]+", before)[-3:] + re.findall(r"[a-z0-9]+", after)[:1]
    return [
        float(n), changes, covered, longest, entropy, kinds.count(0) / n, kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
        float(bool(_HEX.match(value))), float(bool(_UUID.match(value))), float(value.count("/") + value.count(".")),
        float(before[-1:] in ("/", "\\", ".") or after[:1] in ("/", "\\") or value[:1] == "/" or "://" in before[-12:]),
        float(sum(w in _GOOD for w in near)), float(sum(w in _BAD for w in near)), float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(bool(_RUN.search(value))), float(rule not in ("assigned", "long_token")), float(rule == "assigned"), float(sum(x.isalpha() for x in value) == n),
    ]


def labelled_findings(count: int = 2400, seed: int = 7) -> list[tuple[str, Finding, int]]:
    """Made findings with labels (1: a secret), in text like that which the rules meet."""
    rnd = random.Random(seed)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, hexa = low + up + dig, dig + "abcdef"
    word = lambda: rnd.choice(["the", "user", "value", "data", "config", "erin", "thou", "ation", "main", "index", "server", "local"])
    name = lambda: rnd.choice(["password", "secret", "token", "api_key", "apikey", "auth", "access_key"])
    eq = lambda: rnd.choice([' = "', "=", ": ", ' = "', ": '"])
    out = []
    while len(out) < count:
        label = rnd.randrange(2)
        if label:
            body = rnd.choice([
                f"AKIA{pick(up + dig, 16)}", f"ghp_{pick(mixed, 36)}", f"xoxb-{pick(dig, 11)}-{pick(mixed, 24)}", f"AIza{pick(mixed, 35)}", f"sk_live_{pick(mixed, 24)}",
                f"eyJ{pick(mixed, 20)}.{pick(mixed, 40)}.{pick(mixed, 30)}", f"{name()}{eq()}{pick(hexa, rnd.choice([32, 40, 64]))}", f"{name()}{eq()}{pick(mixed, rnd.randint(16, 48))}",
                f"{name()}{eq()}{pick(low, 4)}{pick(up, 2)}{pick(dig, 3)}{pick('!@$%', 1)}{pick(mixed, 3)}", f"{name()} {pick(mixed + '+/', 40)}", "-----BEGIN RSA PRIVATE KEY-----",
            ])
        else:
            body = rnd.choice([
                f"{name()}{eq()}{rnd.choice(['changeme', 'your_token_here', 'placeholder', 'example123', 'xxxxxxxxxxxx', 'password', 'test-token-example', '********'])}",
                f"commit {pick(hexa, 40)}", f"sha256 {pick(hexa, 64)}", f"md5: {pick(hexa, 32)}", f"checksum = {pick(hexa, 40)}", f"id {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
                f"/usr/lib/{word()}/{word()}/{word()}_{rnd.randint(1, 9)}/{word()}", f"https://www.{word()}.com/{word()}/{word()}-{word()}-{rnd.randint(1, 999)}", f"{word()}_{word()}_{word()}_{word()}_{rnd.randint(1, 99)}",
                f"{name()}: {word()}.{word()}.{word()}", f"{name()} = get_{word()}_{word()}", f"order {pick(dig, 24)}", f"build-{word()}-{word()}-{word()}-2{pick(dig, 3)}", f"{word()}{pick('0', 24)}", f"integrity sha512 {pick(mixed + '+/', 64)}",
            ])
        text = f"{word()} {word()} {body}" + rnd.choice(['"', "'", "", ""]) + f" {word()} {word()}"
        found = candidates(text)
        if found:
            out.append((text, max(found, key=lambda f: f[2] - f[1]), label))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = rows[np.arange(len(rows)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += share[at]
        return out / max(1, len(self.trees))


def train_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """Bagged trees; each node tries the square root of the features at a few thresholds by Gini impurity."""
    rnd = np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(rows.shape[1])))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def grow(pick: np.ndarray, level: int, nodes=nodes) -> int:
            me = len(nodes)
            y = labels[pick]
            nodes.append([-1, 0.0, 0, 0, float(y.mean())])
            if level == depth or len(pick) < 4 or y.min() == y.max():
                return me
            best = (np.inf, 0, 0.0)
            for f in rnd.choice(rows.shape[1], tries, replace=False):
                x = rows[pick, f]
                for t in np.unique(np.quantile(x, (0.1, 0.3, 0.5, 0.7, 0.9))):
                    go = x <= t
                    n = int(go.sum())
                    if 0 < n < len(pick):
                        p, q = y[go].mean(), y[~go].mean()
                        impurity = n * p * (1 - p) + (len(pick) - n) * q * (1 - q)
                        if impurity < best[0]:
                            best = (impurity, int(f), float(t))
            if np.isinf(best[0]):
                return me
            go = rows[pick, best[1]] <= best[2]
            low = grow(pick[go], level + 1)
            high = grow(pick[~go], level + 1)
            nodes[me][:4] = [best[1], best[2], low, high]
            return me

        grow(rnd.integers(0, len(rows), len(rows)), 0)
        table = np.array(nodes)
        out.append((table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]))
    return Forest(out)


def fit(words: frozenset[str], findings: list[tuple[str, Finding, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    rows = np.array([features(text, f, words) for text, f, _ in findings])
    return train_forest(rows, np.array([y for _, _, y in findings], np.float64))


def _suspects(texts: pa.Array) -> np.ndarray:
    """Texts in which a rule could find anything: a telling name, or a long word with a digit, or with a capital, dash or line after its first character."""
    buf, offsets = tk.text_buffer(texts)
    starts, ends, words = tk.word_spans(buf, offsets)
    digit = (buf >= 48) & (buf <= 57)
    odd = digit | ((buf >= 65) & (buf <= 90)) | (buf == 95) | (buf == 45)
    sums = np.concatenate(([0], np.cumsum(odd)))
    digits = np.concatenate(([0], np.cumsum(digit)))
    # a capital, dash or line in first place is no sign: every rule then wants another odd character
    long = (ends - starts >= _LONG_WORD) & ((sums[ends] > sums[np.minimum(starts + 1, ends)]) | (digits[ends] > digits[starts]))
    upto = np.concatenate(([0], np.cumsum(long)))
    out = upto[words[1:]] > upto[words[:-1]]
    data = tk.LOWER[buf].tobytes()
    bounds = offsets.tolist()
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(data.find(name, bounds[i], bounds[i + 1]) >= 0 for name in _NAMES)
    return out


def scan_text(text: str, forest: Forest, words: frozenset[str], least: float = MIN_PROBABILITY) -> Iterator[tuple[str, int, int, float]]:
    found = candidates(text)
    for at in range(0, len(found), _BLOCK):
        part = found[at : at + _BLOCK]
        chance = forest.probability(np.array([features(text, f, words) for f in part]))
        yield from ((*f, float(p)) for f, p in zip(part, chance, strict=True) if p >= least)


def _scan(forest: Forest, words: frozenset[str]):
    kinds = {"doc_id": pa.int64(), "rule": pa.string(), "start": pa.int64(), "end": pa.int64(), "probability": pa.float64(), "secret_sha256": pa.string()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                rows = []
                for i in np.flatnonzero(_suspects(part.column("text"))).tolist():
                    text, doc = part.column("text")[i].as_py(), part.column("doc_id")[i].as_py()
                    rows += [(doc, r, a, b, p, hashlib.sha256(text[a:b].encode()).hexdigest()) for r, a, b, p in scan_text(text, forest, words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return scan


def find_secrets(docs: DataFrame, vocabulary: str, findings: list[tuple[str, Finding, int]] | None = None) -> DataFrame:
    """Secrets in every whole text, without repeating them.

    docs: doc_id long, text string; other columns are not read. vocabulary: path of a
    byte-level tokenizers JSON file, whose whole words are the dictionary. findings:
    labelled ones to train on, by default made ones. One row per secret: doc_id, rule, start,
    end (code points, end exclusive), probability, secret_sha256.

    Null and empty texts hold none; null ids are carried along; repeated rows are each
    reported; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, rule string, start long, end long, probability double, secret_sha256 string"
    words = dictionary(vocabulary)
    return rows.mapInArrow(_scan(fit(words, findings), words), schema)
