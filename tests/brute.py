"""Phrase mining by plain loops over rank lists; a model to test against."""

import math
import re
from collections import Counter


def split(texts):
    return [p for t in texts if t is not None for p in re.split("[\r\n。．]", t) if p]


def grams(sentence, low, high):
    for n in range(max(1, low), high + 1):
        for i in range(len(sentence) - n + 1):
            yield sentence[i : i + n]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def periodic(s):
    if len(s) <= 2:
        return False
    if len(s) == 3:
        return len(set(s)) == 1
    return s[: 2 * (len(s) // 2)] == s[:2] * (len(s) // 2)


def spans(pattern, s):
    m = re.search(pattern, s)
    return bool(m) and m.span() == (0, len(s))


def key(cfg, freq, length):
    if cfg.weight_freq == cfg.weight_len > 0:
        return (1 + freq) * length
    return round(cfg.weight_freq * math.log(1 + freq) + cfg.weight_len * math.log(length), 12)


def selected(cfg, s):
    return (
        any(spans(p, s) for p in cfg.positive.values())
        and len(s) <= cfg.max_length
        and not any(spans(p, s) for p in cfg.negative.values())
        and not periodic(s)
    )


def hold(cfg, rows):
    """rows: (seqchar, freq) in input order; contained ones go, in rank order."""
    ranked = sorted(rows, key=lambda r: (r[0] in cfg.knowns, key(cfg, r[1], len(r[0]))), reverse=True)
    return [r for i, r in enumerate(ranked) if not any(r[0] in h[0] for h in ranked[:i])]


def batch(cfg, sentences):
    counts = Counter()
    for s in sentences:
        for c in cfg.removes:
            s = s.replace(c, "")
        counts.update(grams(s, cfg.min_length, cfg.max_length + 1))
    rows = [(k, float(sum(s.count(k) for s in sentences))) for k in cfg.knowns]
    rows += [(g, float(n)) for g, n in counts.most_common() if n > cfg.min_count]
    kept = [r for r in hold(cfg, rows) if not any(re.search(u, r[0]) for u in cfg.unnecessary)]
    return [r for r in kept if cfg.selection <= 0 or selected(cfg, r[0])]


def mine(cfg, texts):
    """{seqchar: (freq, originality)}"""
    sentences = split(texts)
    size = cfg.size_sentence or max(1, len(sentences))
    total = Counter()
    for i in range(0, len(sentences), size):
        for s, f in batch(cfg, sentences[i : i + size]):
            total[s] += f
    held = hold(cfg, sorted(total.items()))
    out = {}
    for i, (s, f) in enumerate(held):
        best = max([0.0, *(1 - lev(s, h) / ((len(s) + len(h)) / 2) for h, _ in held[:i])])
        if 1 - best > cfg.threshold_originality and (cfg.selection <= 0 or selected(cfg, s)):
            out[s] = (f, round(1 - best, 9))
    return out
