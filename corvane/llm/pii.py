"""Operator 6, PII: a semi-Markov conditional random field over fixed base patterns.

The base patterns find plain e-mail addresses, IPv4 addresses, card numbers and
international phone numbers; what they find stays as it is. Around digits, at signs
and spelt-out ats that they leave, a semi-Markov CRF reads the text as tokens and scores whole spans of up
to MAX_TOKENS tokens as a type or single tokens as other text. Every form of the field's features holds such
a sign, and REACH tokens on either side of it are read, so neither a span that could be an entity nor a rival of it is cut;
long stretches are read in overlapping windows of WINDOW tokens. Features look at the span
as a whole: groups of digits and their lengths, separators, checksum, octet ranges,
domain ending, and the words before it. Dynamic programming over span ends chooses
boundaries and types together; its forward and backward sums give each span's
probability, and spans of at least MIN_PROBABILITY are added. That finds numbers without
a leading plus, spelt-out at signs, defanged addresses and cards with unusual separators.

The field is trained here, by maximum likelihood, on sentences made from a seeded
generator (training_sentences): both wanted forms and look-alikes such as dates,
versions, order numbers, prices and hashes. Training takes seconds on the driver; the
weights, some hundred numbers, go to every task.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
MAX_TOKENS = 18
MIN_PROBABILITY = 0.9
WINDOW = 512
_SLICE = 2 << 20
REACH = 2 * MAX_TOKENS  # tokens on either side of a sign: a span around it, and another that overlaps that one

# fixed values: the base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from an at sign back over its local part, then its domain. Linear in any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), 0
        # a later match can use this one's rest, not its text
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, by start and then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- the field

_TOKEN_FORM = r"[A-Za-z]+|[0-9]+|[ \t]{1,8}|[^A-Za-z0-9 \t]"
_TOKEN = re.compile(_TOKEN_FORM)
_NEAR = re.compile(f"(?:{_TOKEN_FORM}){{0,{REACH}}}+")
_DOMAIN_FORM = r"\s*[a-z0-9-]+(?:\s*(?:\.|[\[({]\s*(?:dot|\.)\s*[\])}]|\sdot\s)\s*[a-z0-9-]+)+"
# a number, an at sign, or an at in brackets or alone that a word and a dot or its spelt-out forms follow, as in every e-mail form
_TRIGGER = re.compile(r"[0-9]+|@|(?<=[\[({\s])at(?=[\])}\s]+[a-z0-9-]+\s*(?:[.\[({]|(?<=\s)dot\s))", re.I)
_AT = re.compile(r"@|[\[({ ]\s*at\s*[\])} ]", re.I)
_DOT = re.compile(r"\.|[\[({ ]\s*(?:dot|\.)\s*[\])} ]", re.I)
_EMAIL_FORM = re.compile(r"[a-z0-9][a-z0-9._%+-]*\s*(?:@|[\[({]\s*at\s*[\])}]|\sat\s)" + _DOMAIN_FORM, re.I)
_BRACKET_FORM = re.compile(r"[a-z0-9][a-z0-9._%+-]*\s*[\[({]\s*at\s*[\])}]" + _DOMAIN_FORM, re.I)
_BARE_FORM = re.compile(r"[a-z0-9][a-z0-9._%+-]*\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+", re.I)
_IP_FORM = re.compile(r"[0-9]+(?:(?:\.|\s?\[\.\]\s?|\s?\(\.\)\s?|\s\.\s)[0-9]+){3}")
# fixed values: endings that domains often have
_ENDING = re.compile(r"[^a-z0-9](?:com|org|net|edu|gov|info|io|de|uk|fr|eu|example)$", re.I)
# fixed values: words that often stand before each kind, and before numbers that are none
_CUES = (
    frozenset("email mail e contact write address reach".split()),
    frozenset("ip host server address from ping client addr".split()),
    frozenset("card visa mastercard credit debit cc payment amex".split()),
    frozenset("tel telephone phone call fax mobile cell ring whatsapp sms".split()),
    frozenset("order invoice no number ref id isbn version v page pages part serial build ticket row total sum date on in token hash commit".split()),
)
FEATURES = 51
_LETTERS = re.compile(r"[A-Za-z]+")
_NUMBER_MARKS = frozenset("().+/-")
_FIGURES = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def tokens(text: str, low: int, high: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, low, high)]


def _cues_before(text: str, a: int) -> list[int]:
    """Which lists of cues the two words before place a belong to."""
    before = _LETTERS.findall(text[max(0, a - 24) : a].lower())[-2:]
    return [k for k, cue in enumerate(_CUES) if any(w in cue for w in before)]


def _traits(piece: str) -> tuple[int, ...]:
    """Of a token: begins and ends like an entity, is a plus, an opening bracket; its digits, whether it is a number, holds letters, keeps a span from
    being a plain number, is or holds a dash, dot, space, one of /:, and another mark; may belong to an address."""
    c = piece[0]
    if c in _FIGURES:
        return (1, 1, 0, 0, len(piece), 1, 0, 0, 0, 0, 0, 0, 0, 0)
    blank = c in " \t"
    odd = "\t" in piece if blank else c not in _NUMBER_MARKS
    other = "\t" in piece if blank else c not in _ALNUM and c not in "-."
    return (
        c.isalnum() or c in "+(", piece[-1].isalnum(), c == "+", c == "(", 0, 0, any(map(str.isalpha, piece)), odd, c == "-", c == ".", " " in piece, c in "/:,", other, c == "@" or "at" in piece.lower(),
    )


class Region:
    """The spans of one stretch of text, as token numbers i (first) and j (behind the last), ordered by j; one row of features each."""

    def __init__(self, text: str, cuts: list[tuple[int, int]]):
        self.cuts, n = cuts, len(cuts)
        pieces = [text[a:b] for a, b in cuts]
        traits = np.array([_traits(p) for p in pieces], np.int64).reshape(n, -1)
        opens, closes, plus, bracket = traits[:, :4].T.astype(bool)
        i = np.repeat(np.arange(n), MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), n)
        # a longer span that does not begin and end like an entity is none; single tokens stay possible
        kept = np.flatnonzero((j <= n) & ((j - i == 1) | (opens[i] & closes[np.minimum(j, n) - 1])))
        kept = kept[np.argsort(j[kept], kind="stable")]
        i, j = i[kept], j[kept]
        self.i, self.j = i, j
        self.upto = np.searchsorted(j, np.arange(n + 2))
        numbers = [p for p in pieces if p[0] in _FIGURES]
        total = np.concatenate((np.zeros((1, traits.shape[1] - 4), np.int64), np.cumsum(traits[:, 4:], axis=0)))
        place = total[:, 1]
        digits, groups, *held = (total[j] - total[i]).T
        letters, odd, dashes, dots, spaces, slashes, others, at = (x > 0 for x in held)
        plain, ats = ~odd, np.flatnonzero(at)
        self.table = np.zeros((len(i), FEATURES))
        put = self.table.__setitem__
        every = np.arange(len(i))
        put((every, 0), 1)
        put((every, 1 + np.minimum(j - i, 4)), 1)
        put((every, 6 + np.searchsorted([1, 7, 10, 12, 14, 17, 20], digits, side="right")), 1)
        put((every, 14 + np.minimum(groups, 5)), 1)
        flags = lambda rows: np.fromiter(rows, bool, n)
        before = flags(a > 0 and text[a - 1].isalnum() for a, _ in cuts)
        behind = flags(b < len(text) and text[b].isalnum() for _, b in cuts)
        joined = flags(a > 0 and text[a - 1] in "._%+-@" for a, _ in cuts)
        lengths = np.array([*map(len, numbers), 0, 0, 0, 0], np.int64)
        shaped = lambda *shape: (groups == len(shape)) & np.logical_and.reduce([lengths[np.minimum(place[i] + k, len(numbers))] == x for k, x in enumerate(shape)])
        for k, holds in (
            (20, letters), (21, ~letters & plain), (22, ~opens[i]), (23, ~closes[j - 1]), (24, plus[i]), (25, bracket[i]),
            (32, shaped(3, 3, 4) | shaped(1, 3, 3, 4)), (33, shaped(4, 4, 4, 4) | shaped(4, 6, 5)), (34, dashes & ~dots & ~spaces & ~others), (35, dots & ~dashes & ~spaces & ~others),
            (36, spaces & ~dashes & ~dots & ~others), (37, slashes), (38, before[i]), (39, behind[j - 1]), (46, (digits > 0) & letters), (47, joined[i]),
        ):
            put((holds, k), 1)
        cues = np.zeros((n, len(_CUES)), bool)
        word = cuts[0][0]  # end of the last letters; before the first token, unknown
        for k, (a, b) in enumerate(cuts):
            if a - word < 24:
                cues[k, _cues_before(text, a)] = True
            if pieces[k][0] not in _FIGURES and _LETTERS.match(pieces[k]):
                word = b
        self.table[:, 40 : 40 + len(_CUES)] = cues[i]
        span = lambda s: text[cuts[i[s]][0] : cuts[j[s] - 1][1]]
        for s in np.flatnonzero((groups == 4) & ~letters & opens[i]).tolist():
            if _IP_FORM.fullmatch(span(s)):
                own = numbers[place[i[s]] : place[j[s]]]
                self.table[s, 28 if all(len(g) < 4 and int(g) < 256 for g in own) else 29] = 1
        for s in np.flatnonzero((digits >= 14) & (digits <= 19) & ~letters).tolist():
            self.table[s, 30 if luhn("".join(numbers[place[i[s]] : place[j[s]]])) else 31] = 1
        for s in ats.tolist():
            for k in _address_features(span(s)):
                self.table[s, k] = 1

    @property
    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.i.tolist(), self.j.tolist(), strict=True))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each span as each kind; only single tokens can be other text."""
        out = self.table @ weights
        out[self.j - self.i > 1, OTHER] = -np.inf
        return out

    def sums(self, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each span and kind, and the log of the sum over all readings."""
        n = len(self.cuts)
        span_score = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        parts = [slice(a, b) for a, b in zip(self.upto[:-1].tolist(), self.upto[1:].tolist(), strict=True)]
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce(forward[self.i[parts[j]]] + span_score[parts[j]])
        for j in range(n, 0, -1):
            i = self.i[parts[j]]  # each once
            backward[i] = np.logaddexp(backward[i], backward[j] + span_score[parts[j]])
        return np.exp(scores + (forward[self.i] + backward[self.j] - forward[n])[:, None]), float(forward[n])

    def best(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best reading: (span, kind) of its entities."""
        n = len(self.cuts)
        kind, value = scores.argmax(1), scores.max(1)
        best, via = np.full(n + 1, -np.inf), [-1] * (n + 1)
        best[0] = 0.0
        bounds = self.upto.tolist()
        for j in range(1, n + 1):
            x = best[self.i[bounds[j] : bounds[j + 1]]] + value[bounds[j] : bounds[j + 1]]
            k = int(x.argmax())
            best[j], via[j] = x[k], bounds[j] + k
        out, j = [], n
        while j:
            s = via[j]
            if kind[s] != OTHER:
                out.append((s, int(kind[s])))
            j = int(self.i[s])
        return out[::-1]


def _address_features(span: str) -> list[int]:
    """Numbers of the features of a span that holds an at sign or the letters at."""
    out = []
    if _EMAIL_FORM.fullmatch(span):
        out.append(26 if re.search(r"[a-z]{2,}$", span, re.I) else 27)
    if _AT.search(span) and _DOT.search(span):
        out.append(45)
    bare = bool(_BARE_FORM.fullmatch(span))
    if bare or _BRACKET_FORM.fullmatch(span):
        out += [48, *[49] * bare, *[50] * bool(_ENDING.search(span))]
    return out


def training_sentences(count: int = 420, seed: int = 6) -> list[tuple[str, list[Span]]]:
    """Made sentences with their entities: wanted forms that the base patterns miss, and look-alikes."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "the", "er", "on", "re", "st", "lo", "mi", "qu", "ta", "ein", "ou"]) for _ in range(rnd.randint(1, 3)))
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card() -> str:
        digits = rnd.choice("3456") + num(14)
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    def entity() -> tuple[str, int]:
        kind = rnd.randrange(4)
        if kind == 0:
            at, dot = rnd.choice(["(at)", "[at]", " (at) ", " [at] ", " at ", " @ "]), rnd.choice([".", "(dot)", "[dot]", " dot ", " (dot) "])
            if at == " at ":
                dot = " dot "
            return f"{word()}{rnd.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'example', 'de'])}", 0
        if kind == 1:
            return rnd.choice(["[.]", "(.)", " . "]).join(str(rnd.randrange(256)) for _ in range(4)), 1
        if kind == 2:
            c = card()
            sep = rnd.choice([".", "  ", " - "])
            return sep.join(c[k : k + 4] for k in range(0, 16, 4)), 2
        a, b, c = num(3), num(3), num(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}"]), 3

    def decoy() -> str:
        return rnd.choice([
            f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/{rnd.randint(1990, 2030)}", f"{rnd.randint(1990, 2030)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}",
            f"v{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}", f"version {rnd.randint(1, 9)}.{rnd.randint(0, 9)}.{rnd.randint(0, 9)}.{rnd.randint(300, 9999)}",
            f"{rnd.randint(1, 999)},{num(3)}.{num(2)}", f"order {num(rnd.randint(5, 12))}", f"no. {num(rnd.randint(4, 16))}", f"{rnd.randint(0, 23)}:{num(2)}:{num(2)}",
            f"pages {rnd.randint(1, 99)}-{rnd.randint(100, 300)}", "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([8, 32, 40]))), f"{rnd.randint(1, 9)} @ {rnd.randint(1, 99)}.{num(2)}",
            f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(rnd.randint(1, 20)), f"{word()}@{word()}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}", f"{num(2)}%",
            f"{num(5)}-{num(4)}", f"{rnd.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)} {num(3)} {num(2)}", f"meet at {word()} {num(1)}",
        ])

    cue = (["email", "mail", "contact"], ["ip", "host", "server"], ["card", "visa"], ["tel", "phone", "call", "fax"])
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rnd.randint(1, 4))) + " ", []
        for _ in range(rnd.randint(1, 2)):
            if rnd.random() < 0.5:
                what, kind = entity()
                if rnd.random() < 0.5:
                    text += rnd.choice(cue[kind]) + rnd.choice([" ", ": "])
                spans.append((len(text), len(text) + len(what), kind))
                text += what
            else:
                text += decoy()
            text += rnd.choice([" ", ". ", ", ", " "]) + word() + " "
        out.append((text, spans))
    return out


def train(sentences: list[tuple[str, list[Span]]], rounds: int = 8, penalty: float = 1e-3) -> np.ndarray:
    """Weights (feature, kind) by AdaGrad on the log-likelihood of the true readings."""
    prepared = []
    for text, spans in sentences:
        cuts = tokens(text, 0, len(text))
        region = Region(text, cuts)
        place = {(cuts[i][0], cuts[j - 1][1]): s for s, (i, j) in enumerate(region.spans)}
        truth, covered = [], set()
        for a, b, kind in spans:
            if (a, b) in place:
                truth.append((place[a, b], kind))
                covered |= {k for k, (x, _) in enumerate(cuts) if a <= x < b}
        if len(truth) < len(spans):
            continue  # longer than MAX_TOKENS
        truth += [(place[cuts[k]], OTHER) for k in range(len(cuts)) if k not in covered]
        prepared.append((region, truth))
    weights = np.zeros((FEATURES, OTHER + 1))
    grown = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        for region, truth in prepared:
            chance, _ = region.sums(region.scores(weights))
            slope = penalty * weights
            slope += region.table.T @ chance
            for s, kind in truth:
                slope[:, kind] -= region.table[s]
            grown += slope * slope
            weights -= 0.5 * slope / np.sqrt(grown)
    return weights


def _before(text: str, at: int) -> int:
    """Where the REACH tokens before place `at` begin."""
    reach = 256
    while True:
        low = max(0, at - reach)
        n = _NEAR.match(text[low:at][::-1]).end()
        if n < at - low or low == 0:
            return at - n
        reach *= 4


def _windows(text: str, low: int, high: int) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """The tokens in windows of at most WINDOW, and between which of them a span that counts begins."""
    margin = 2 * MAX_TOKENS
    found = _TOKEN.finditer(text, low, high)
    cuts, first = [m.span() for m in islice(found, WINDOW)], 0
    while cuts:
        more = [m.span() for m in islice(found, WINDOW - 2 * margin)] if len(cuts) == WINDOW else []
        last = len(cuts) - margin if more else len(cuts)
        yield cuts, first, last
        cuts, first = cuts[last - margin :] + more if more else [], margin


def added_spans(text: str, base: list[Span], weights: np.ndarray, least: float = MIN_PROBABILITY) -> list[Span]:
    """What the field finds outside the base spans."""
    taken: list[list[int]] = []  # apart, ascending
    for a, b in sorted((a, b) for a, b, _ in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    regions: list[list[int]] = []
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] <= m.start():
            continue
        high = _NEAR.match(text, m.end()).end()
        if regions and m.start() <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
            continue
        low = _before(text, m.start())
        if regions and low <= regions[-1][1]:
            regions[-1][1] = high
        else:
            regions.append([low, high])
    out: list[Span] = []
    k = 0
    for low, high in regions:
        at = low
        while k < len(taken) and taken[k][1] <= low:
            k += 1
        here = k
        while here < len(taken) and taken[here][0] < high:
            here += 1
        for a, b in [*taken[k:here], [high, high]]:
            if _TRIGGER.search(text, at, max(at, a)):
                done = at
                for cuts, first, last in _windows(text, at, a):
                    region = Region(text, cuts)
                    scores = region.scores(weights)
                    found = region.best(scores)
                    if not found:
                        continue
                    chance, _ = region.sums(scores)
                    for s, kind in found:
                        i, j = int(region.i[s]), int(region.j[s])
                        if first <= i < last and chance[s, kind] >= least and cuts[i][0] >= done:
                            done = cuts[j - 1][1]
                            out.append((cuts[i][0], done, kind))
            at = max(at, b)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _find(weights: np.ndarray):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            counts, digest, spans = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                counts.append([sum(1 for s in base if s[2] == k) for k in range(len(KINDS))])
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + added_spans(text, base, weights)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return find


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    docs: doc_id long, text string; other columns are not read. Returns doc_id, n_email,
    n_ip, n_card, n_phone (what the base patterns find), base_sha256 (of those spans as
    kind:start:end, by start and kind, comma-joined) and spans (base and added ones, joined
    likewise; places are code points, ends exclusive).

    Null and empty texts hold nothing; null ids are carried along; repeated rows are
    each answered; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_find(train(training_sentences())), schema)


def masked(text: str, weights: np.ndarray) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in sorted(base + added_spans(text, base, weights)):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(weights: np.ndarray, schema_names: list[str]):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            texts = pa.array([None if t.as_py() is None else masked(t.as_py(), weights) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in schema_names], names=schema_names)

    return mask


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the personal data in text replaced; null texts stay null."""
    return docs.mapInArrow(_mask(train(training_sentences()), docs.columns), docs.schema)
