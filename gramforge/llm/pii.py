"""Personal data and secrets: candidate generation, boosted trees, redaction.

Generators propose spans with high recall and may overlap (a card number is
also a phone number to them). Each candidate becomes a vector of format and
context features, gradient-boosted trees score it, scores are calibrated to
probabilities on held-out candidates, and each kind of candidate has its own
threshold. Of overlapping candidates above their thresholds the likeliest stays
(ties: the longer, then the earlier); its span is replaced by ``[KIND]``.

The trees are trained here, on a bounded synthetic set (``TRAIN_SIZE``
contexts) of well-formed positives and look-alikes such as versions, dates,
prices and order numbers; no labels of the corpus are needed.

Defined results
---------------
* null or empty text: no redaction, no row.
* documents without redactions: no row from ``find_pii``; ``redact`` keeps
  their rows and texts as they are.
* repeated rows: each by itself.  very long texts and very long runs of one
  character: scanned whole, in linear time.
* ids of any type, nulls too: returned as they are.
* empty table: empty result.   extra columns, whatever their names: untouched.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, named, slices

#: Bound of the synthetic training set and shape of the ensemble.
TRAIN_SIZE = 6000
TREES = 60
DEPTH = 3
BINS = 32

#: No candidate is without one of these: an e-mail address has its sign, a secret
#: its separator, all others have a digit.
ANCHOR = re.compile(r"[@\d=:]")

#: Forms of phone numbers; the first that fits at a place is proposed.
_PHONES = (
    r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{2,4}[ .-]\d{3,4}(?:[ .-]?\d{2,4})?(?!\w|\.\d|[ .-]\d{2}(?!\w|\.\d))",  # 3-3-4 and the like
    r"(?:\+|00)[1-9]\d{6,14}",  # E.164
    r"(?=(?:[^\d\n]{0,3}\d){7})(?:\+|00)\d{1,6}(?: ?\(0\) ?\d{1,5})?(?:[ ./-](?!\d{1,3}(?:\.\d{1,3}){3}(?!\w))\(?\d{1,8}\)?){1,5}",  # grouped after a country code
    r"\d{2,3}(?:[ .-]\d{2}){3,4}",  # groups of two digits
    r"\(?0\d{1,5}\)?(?: ?[/-] ?| )\d{3,8}(?:[ -]\d{1,5})?",  # area code, number
    r"\d{9,11}",
    r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{2,4}[ .-]\d{3,4}(?:[ .-]?\d{2,4})?",
)

GENERATORS: list[tuple[str, re.Pattern]] = [
    ("EMAIL", re.compile(r"[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)+")),
    ("IP", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")),
    ("PHONE", re.compile(rf"(?<![\w+])(?:{'|'.join(_PHONES)})(?!\w|\.\d)")),
    ("CARD", re.compile(r"(?<![\w-])\d(?:[ -]?\d){11,18}(?![\w-])")),
    ("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("SECRET", re.compile(r"(?i)(?<!\w)(?:[a-z_]*(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|key|auth))\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?")),
    ("KEY", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+\d)[A-Za-z0-9_-]{16,}+")),
]
KINDS = [k for k, _ in GENERATORS]
_KEYWORDS = [
    re.compile(p, re.I)
    for p in (
        r"pass|pwd|token|secret|key|auth|credential",
        r"tel|phone|call|mobile|fax|handy|tél",
        r"card|visa|credit|karte|carte|tarjeta",
        r"mail|contact|@",
        r"\bip\b|host|server|addr",
        r"version|release|\bv\.?$|section|§|chapter|page|fig",
        r"order|invoice|isbn|serial|ticket|item|no\.?\s*$|#\s*$",
        r"\$|€|£|usd|eur|price|total",
    )
]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end) of all proposed spans; they may overlap."""
    return [(g, m.start(), m.end()) for g, (_, pattern) in enumerate(GENERATORS) for m in pattern.finditer(text)]


_SEPARATED = re.compile(r"[=:]\s*")


def _value(span: str) -> list[float]:
    """What stands after a separator: length, whether it is quoted, glued on,
    assigned, all lower-case letters, or such after a capital."""
    m = _SEPARATED.search(span)
    if not m:
        return [0.0] * 6
    value = span[m.end() :]
    bare = value.strip("\"'")
    return [len(bare), float(value[:1] in "\"'"), float(m.end() - m.start() == 1), float(span[m.start()] == "="), float(bare.isalpha() and bare.islower()), float(bare.isalpha() and bare.istitle())]


def features(text: str, g: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    n = len(span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    octets = re.findall(r"\d+", span)
    return [
        *(float(g == k) for k in range(len(GENERATORS))),
        n,
        len(digits),
        len(digits) / n,
        sum(c.isupper() for c in span) / n,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        entropy,
        len(counts),
        float("@" in span),
        span.count("."),
        span.count("-"),
        span.count(" "),
        float(span.startswith("+")),
        float("(" in span),
        float("=" in span or ":" in span),
        *_value(span),
        float(len(digits) >= 12 and _luhn(digits)),
        float(len(octets) == 4 and all(int(o) < 256 for o in octets)),
        float(digits[:1] or 0),
        float(bool(re.search(r"\.[A-Za-z]{2,}$", span))),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)) / n,
        sum(a.islower() and b.isupper() for a, b in zip(span, span[1:], strict=False)),
        *(float(bool(k.search(before))) for k in _KEYWORDS),
        float(before[-1:].isspace() or not before),
        float(before[-1:] in "$€£#/"),
        float(after[:1].isspace() or after[:1] in ",.;" or not after),
        float(after[:1] in "%€$°/"),
    ]


@dataclass
class Trees:
    """Oblivious to depth: each tree is arrays over a complete binary tree."""

    feature: np.ndarray  # [trees, inner]
    cut: np.ndarray  # [trees, inner]
    leaf: np.ndarray  # [trees, leaves]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.3) -> Trees:
    """Newton boosting of logistic loss on binned features."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), math.log(rate0 / (1 - rate0)))
    score = np.full(n, model.base)
    offset = np.arange(m) * (BINS + 1)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                flat = (binned[at] + offset).reshape(-1)
                gs = np.bincount(flat, np.repeat(g[at], m), m * (BINS + 1)).reshape(m, -1).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[at], m), m * (BINS + 1)).reshape(m, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    model.feature[t, k], model.cut[t, k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.cut[t][node])
        leaf = node - inner
        model.leaf[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score += model.leaf[t][leaf]
    return model


_FILL = "the and of ther tion der und est le les pour que con las para re and with from this were item data value on".split()

#: What prose has after "password:" and the like.
_PROSE = "required optional protected forgotten changed expired invalid missing reset disabled authentication management recommended differences everything communication unknown administration configuration requirements characteristics responsibility recommendation".split()


def _positive(r: random.Random) -> tuple[str, str]:
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    kind = r.choice(KINDS)
    if kind == "EMAIL":
        name = letters(r.randint(2, 9)) + r.choice(["", "." + digit(2), "_" + letters(4), digit(2), "+" + letters(3)])
        return kind, f"{name}@{r.choice(['', 'mail.'])}{letters(r.randint(3, 8))}{r.choice(['', digit(1)])}.{r.choice(['com', 'org', 'net', 'example.com', 'de', 'co.uk'])}"
    if kind == "IP":
        return kind, ".".join(str(r.randint(1 if i == 0 else 0, 255)) for i in range(4))
    if kind == "PHONE":
        a, b, c = digit(3), digit(3), digit(4)
        if r.random() < 0.5:
            return kind, r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1 {a}-{b}-{c}"])
        country, area, two = r.choice(["+", "+", "00"]) + str(r.randint(1, 99)), digit(r.randint(1, 4)), lambda k: r.choice(" .-  ").join(digit(2) for _ in range(k))
        return kind, r.choice(
            [
                country + str(r.randint(1, 9)) + digit(r.randint(7, 10)),
                f"{country} {r.choice(['', '(0)'])}{area}{r.choice([' ', ' ', '-', '/'])}{digit(r.randint(5, 8))}",
                f"{country} {digit(1)} {two(4)}",
                f"{country} {a} {two(3)}",
                f"0{r.randint(1, 9)} {two(4)}",
                f"{r.choice('6789')}{digit(2)} {two(3)}",
                f"0{r.randint(1, 9)}{digit(r.randint(0, 3))}{r.choice([' ', '/', '/', '-', ' / '])}{digit(r.randint(5, 8))}",
                f"{r.choice('23456789')}{digit(9)}",
                f"0{r.choice('1679')}{digit(r.randint(8, 9))}",
            ]
        )
    if kind == "CARD":
        n = r.choice(["4", "5", "4", "6", "3"]) + digit(14)
        n += next(d for d in "0123456789" if _luhn(n + d))
        return kind, r.choice([n, n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4))])
    if kind == "SSN":
        return kind, f"{digit(3)}-{digit(2)}-{digit(4)}"
    if kind == "IBAN":
        return kind, r.choice(["DE", "FR", "ES", "GB"]) + digit(2) + digit(r.randint(14, 20))
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 24, 32, 40])))
    mixed = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    anything = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(12, 40)))
    if kind == "SECRET":
        name = r.choice(["password", "token", "secret", "api_key", "auth_token", "pwd", "passwd", "access_key"])
        camel = "".join(letters(r.randint(2, 8)).capitalize() for _ in range(r.randint(3, 4)))
        plain = letters(r.randint(12, 24))
        if r.random() < 0.4:
            bare = f"{name}: {letters(r.randint(16, 26))}"
            return kind, r.choice([f"{name}={plain}", f'{name}="{plain}"', f"{name} = '{plain}'", bare, bare, bare, f"{name}={letters(r.randint(9, 14))}"])
        worded = r.choice([camel, "".join(r.choice([str.upper, str.lower])(c) for c in letters(r.randint(12, 30)))])
        return kind, r.choice([f"{name}={hexes}", f'{name} = "{hexes}"', f"{name}: {anything}1", f"{name}='{anything}'", f'{name} = "{worded}"', f"{name}: {worded}", f"{name}={worded}"])
    return kind, r.choice(["AKIA" + mixed, "AKIA" + mixed, "sk_live_" + anything + "1", "ghp_" + anything + "4", hexes, "xoxb-" + digit(11) + "-" + anything])


def _not_a_card(n: str, r: random.Random) -> str:
    """A number whose check digit is wrong."""
    return n + r.choice([d for d in "0123456789" if not _luhn(n + d)])


def _look_alike(r: random.Random) -> str:
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice(
        [
            lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(256, 4000)}",
            lambda: f"version {r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
            lambda: f"section {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
            lambda: f"${r.randint(1, 999)},{d(3)}.{d(2)}",
            lambda: f"{d(3)} {d(3)} {d(3)} euro",
            lambda: f"order #{r.choice('012789')}{d(13)}",
            lambda: f"invoice no. {r.choice('0129')}{d(11)}",
            lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            lambda: f"serial {r.choice('0179')}{d(15)}",
            lambda: f"{r.choice('0179')}{d(11)}",
            lambda: _not_a_card(d(15), r),
            lambda: _not_a_card(r.choice("3456") + d(14), r),
            lambda: f"00{d(14)}",
            lambda: f"pages {d(3)}-{d(3)}",
            lambda: f"{r.choice(['', 'order ', 'id ', 'ticket ', 'item no. ', 'at '])}{r.randint(1, 9)}{d(r.randint(8, 10))}",
            lambda: f"{r.choice(['', 'no. ', 'serial '])}0{d(r.randint(8, 10))}",
            lambda: " ".join(d(2) for _ in range(r.randint(4, 6))),
            lambda: f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(10, 30)} {r.randint(0, 23):02d}.{d(2)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{d(2)}-{d(2)}",
            lambda: f"0{d(1)}/{r.randint(1900, 2030)}",
            lambda: f"0{d(1)} {d(3)} {r.choice(['items', 'km', 'euro'])}",
            lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(3)}",
            lambda: f"{d(1)}.{d(12)}",
            lambda: f"token: {r.choice(_FILL)}{r.choice(_FILL)}ing",
            lambda: f"key = {r.choice(_FILL)}{r.choice(_FILL)}",
            lambda: f"{r.choice(['password', 'secret', 'token', 'key', 'auth', 'api key', 'Password', 'Key'])}: {r.choice([str.lower, str.capitalize])(r.choice(_PROSE))}",
            lambda: f"{r.choice(['password', 'secret', 'token', 'key', 'Password', 'Token', 'Secret'])}: {r.choice([w for w in _PROSE if len(w) > 12]).capitalize()}",
            lambda: f"{r.choice(['password', 'token', 'key'])} = {r.choice(_PROSE)[:8]}",
            lambda: f"{r.choice(['password', 'secret', 'token', 'Key', 'auth'])}: {r.choice(_FILL).capitalize()}{r.choice(_FILL)}{r.choice(_FILL)}",
            lambda: "-".join(r.choice(_FILL) for _ in range(5)) + "-2",
            lambda: "_".join(r.choice(_FILL) for _ in range(5)) + d(1),
            lambda: f"{r.choice(_FILL)}@{r.choice(_FILL)}",
            lambda: f"range {d(4)} - {d(4)} {d(4)}",
            lambda: "Licensed under the Apache License, Version 2.0.",
        ]
    )()


@dataclass
class PiiModel:
    trees: Trees
    a: float
    b: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.raw(x) + self.b)))


def training_set(size: int = TRAIN_SIZE, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, generator) of the candidates in synthetic contexts.

    A candidate is positive if it covers the planted value of its context
    entirely and is of its kind, or lies within a secret.
    """
    r = random.Random(seed)
    x, y, kinds = [], [], []
    for _ in range(size):
        left = " ".join(r.choice(_FILL) for _ in range(r.randint(0, 6)))
        right = " ".join(r.choice(_FILL) for _ in range(r.randint(0, 4)))
        hint = r.random() < 0.2
        if r.random() < 0.5:
            kind, value = _positive(r)
            if hint or kind == "PHONE" and value.isdigit():  # bare digits are a phone number by their context only
                left += {"EMAIL": " mail", "PHONE": r.choice([" phone", " call", " tel", " mobile"]), "CARD": " card", "IP": " host"}.get(kind, "")
        else:
            kind, value = "", _look_alike(r)
        glue = r.choice([" ", " ", "\n"])
        text = (left + glue if left else "") + value + r.choice(["", "", ",", "."]) + (" " + right if right else "")
        start = len(left) + 1 if left else 0
        for g, s, e in candidates(text):
            good = bool(kind) and s <= start and e >= start + len(value.strip("\"'")) - 2 and (KINDS[g] == kind)
            good |= kind in ("SECRET", "KEY") and s >= start and e <= start + len(value) and e - s >= 16
            x.append(features(text, g, s, e))
            y.append(float(good))
            kinds.append(g)
    return np.array(x), np.array(y), np.array(kinds)


@functools.lru_cache(maxsize=1)
def model() -> PiiModel:
    """The trained, calibrated model (a second or two, once per process)."""
    x, y, kinds = training_set()
    held = np.arange(len(x)) % 4 == 0
    trees = boost(x[~held], y[~held])
    raw, truth = trees.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((truth - p) * raw).sum() - 1e-3 * (a - 1), (truth - p).sum()
        haa, hab, hbb = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a + 0.5 * (hbb * ga - hab * gb) / det, b + 0.5 * (haa * gb - hab * ga) / det
    out = PiiModel(trees, a, b, {})
    p = out.probability(x[held])
    for g, kind in enumerate(KINDS):
        own = kinds[held] == g
        best = max(
            ((2 * ((p[own] >= t) & (truth[own] > 0)).sum() / max(1, (p[own] >= t).sum() + truth[own].sum()), -abs(t - 0.5), t) for t in np.linspace(0.1, 0.9, 33)),
        )
        out.thresholds[kind] = float(best[2])
    return out


def spans_of(texts: list[str | None], m: PiiModel) -> list[list[dict]]:
    """Redactions of each text: kind, start, end, score; none overlap."""
    owner, found, rows = [], [], []
    for i, t in enumerate(texts):
        if t and ANCHOR.search(t):
            for g, s, e in candidates(t):
                owner.append(i)
                found.append((g, s, e))
                rows.append(features(t, g, s, e))
    out: list[list[dict]] = [[] for _ in texts]
    if not rows:
        return out
    p = m.probability(np.array(rows))
    per: dict[int, list] = {}
    for i, (g, s, e), q in zip(owner, found, p.tolist(), strict=True):
        if q >= m.thresholds[KINDS[g]]:
            per.setdefault(i, []).append((-q, s - e, s, e, KINDS[g], q))
    for i, own in per.items():
        taken: list[tuple[int, int]] = []
        for _, _, s, e, kind, q in sorted(own):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out[i].append({"kind": kind, "start": s, "end": e, "score": round(q, 4)})
        out[i].sort(key=lambda d: d["start"])
    return out


def redact_text(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s["start"]], f"[{s['kind']}]"]
        at = s["end"]
    return "".join(parts) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


_FOUND = "pii_spans array<struct<kind:string,start:int,end:int,score:double>>, redacted_text string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pii_spans, redacted_text) of documents that need redaction."""
    trained = model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                spans = spans_of(texts, trained)
                some = [i for i, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(some, pa.int64())),
                        pa.array([spans[i] for i in some], type=_SPANS),
                        pa.array([redact_text(texts[i], spans[i]) for i in some], type=pa.string()),
                    ],
                    names=["_gf_id", "pii_spans", "redacted_text"],
                )

    rows = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text"))
    return (
        rows.filter(F.col("_gf_text").isNotNull())
        .mapInArrow(work, StructType([rows.schema["_gf_id"], *StructType.fromDDL(_FOUND)]))
        .withColumnRenamed("_gf_id", id_col)
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, texts redacted, in one pass over them."""
    trained = model()
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                new = [redact_text(t, s) if s else t for t, s in zip(texts, spans_of(texts, trained), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, type=part.schema.field(at).type))

    return map_rows(docs, work)
