"""Toxic-span tagging with a linear-chain conditional random field.

Labels come by document, a CRF wants them by token: token labels are derived
from a bounded, documented sample of labelled documents (``SAMPLE_TOXIC`` +
``SAMPLE_CLEAN`` rows, least hashes of the id first; the CRF's weights are
fitted on the ``FIT_DOCS`` of each kind with the least hashes). A token is labelled toxic
when one of its prefixes, or all of it, occurs in enough toxic documents and
practically never in clean ones; near copies in the sample count once between
them, so that a much-copied document cannot make its own words toxic.

The CRF has two states and log-linear emissions over prefixes, suffixes and
whole words; weights and transitions are fitted by Adam on the exact
gradient (forward-backward). Tagging computes forward-backward marginals over
every token of every document; tokens at or above ``SPAN_THRESHOLD`` form the
offending spans, given as character offsets [start, end). A document's score is
the probability that a logistic function gives to its greatest marginal and, if
that tells held-out documents apart better, to the sum of its squared marginals
and its number of tokens: one chance word in a long text then weighs less than
several in a short one. The function, and the score from which a document is
toxic, are fitted on the part of the sample held out from the CRF.

Defined results
---------------
* null or word-less text: score 0, no spans.
* ids of any type, nulls too: returned as they are.
* ties: a score equal to the threshold is toxic, a marginal equal to
  ``SPAN_THRESHOLD`` is in a span; scores do not depend on other documents.
* no labels, or none of one kind: nothing is toxic.
* repeated rows: each scored by itself.   empty table: empty result.
* very long texts: tagged whole.   extra columns, whatever their names: untouched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, named, slices

#: Bounds of the labelled sample on which the CRF is fitted.
SAMPLE_TOXIC = 600
SAMPLE_CLEAN = 1800
#: A token belongs to a span from this marginal on.
SPAN_THRESHOLD = 0.5
#: Features of fewer tokens of the sample than this are left out.
MIN_COUNT = 3
#: Chance features expected among the markers of toxic tokens.
FALSE_MARKERS = 0.01
#: Least share of toxic documents among those with a marker.
PURITY = 0.45
#: Aggregates that scores may be made of (constant, sum, maximum, tokens); those
#: of the least held-out loss, plus 2 for each of them, are taken.
AGGREGATES = ([0, 2], [0, 1, 2], [0, 1, 2, 3])
#: Bound of the documents of each kind on which the CRF's weights are fitted.
FIT_DOCS = 400
_WORD = re.compile(r"\w+")


def token_features(word: str) -> list[str]:
    """A token's features: itself, its prefixes of 3 to 6 characters and its
    last 3. Features that fitting did not see often enough weigh nothing."""
    w = word.lower()
    out = ["w" + w]
    out += ["p" + w[:k] for k in (3, 4, 5, 6) if len(w) >= k]
    if len(w) >= 4:
        out.append("s" + w[-3:])
    return out


@dataclass
class CrfModel:
    """weights: emission log-odds (toxic over clean) of features;
    bias; transition[i, j] and start[j]: potentials; document: weights of the
    constant and the three aggregates; threshold: of documents."""

    weights: dict[str, float]
    bias: float
    transition: np.ndarray
    start: np.ndarray
    document: np.ndarray
    threshold: float


class _Emission(dict):
    LIMIT = 200_000

    def __init__(self, model: CrfModel):
        super().__init__()
        self.weight, self.bias = model.weights.get, model.bias

    def __missing__(self, word: str) -> float:
        # token_features, spelled out: this line runs for every new word.
        w, get = word.lower(), self.weight
        n = len(w)
        value = self.bias + get("w" + w, 0.0)
        if n >= 3:
            value += get("p" + w[:3], 0.0)
            if n >= 4:
                value += get("p" + w[:4], 0.0) + get("s" + w[-3:], 0.0)
                if n >= 5:
                    value += get("p" + w[:5], 0.0)
                    if n >= 6:
                        value += get("p" + w[:6], 0.0)
        value = self[word] = min(max(value, -40.0), 40.0)
        return value


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, run: int = 128):
    """P(toxic) of each token, and expected transitions [2, 2] over the chain.

    emission: log-odds per token of all documents one after another; first:
    whether a token begins a document. Exact forward-backward, vectorised over
    runs of ``run`` tokens: one pass takes each run's matrix product, a short
    scalar pass joins the runs, a second pass fills in every token.
    """
    n = len(emission)
    columns = -(-n // run)
    pad = columns * run - n
    x = np.exp(np.r_[emission, np.zeros(pad)]).reshape(columns, run).T
    begin = np.r_[first, np.ones(pad, dtype=bool)].reshape(columns, run).T
    a = np.empty((2, 2, run, columns))
    for i in (0, 1):
        a[i, 0] = np.where(begin, start[0], transition[i, 0])
        a[i, 1] = np.where(begin, start[1], transition[i, 1]) * x
    a /= a.max(axis=(0, 1))

    def products(backward: bool):
        p00, p01, p10, p11 = (np.full(columns, v) for v in (1.0, 0.0, 0.0, 1.0))
        for t in reversed(range(run)) if backward else range(run):
            m00, m01, m10, m11 = a[0, 0, t], a[0, 1, t], a[1, 0, t], a[1, 1, t]
            if backward:
                p00, p10, p01, p11 = m00 * p00 + m01 * p10, m10 * p00 + m11 * p10, m00 * p01 + m01 * p11, m10 * p01 + m11 * p11
            else:
                p00, p01, p10, p11 = p00 * m00 + p01 * m10, p00 * m01 + p01 * m11, p10 * m00 + p11 * m10, p10 * m01 + p11 * m11
            z = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
        return p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()

    f0, f1 = np.empty(columns), np.empty(columns)
    p00, p01, p10, p11 = products(False)
    u, v = 0.5, 0.5
    for c in range(columns):
        f0[c], f1[c] = u, v
        u, v = u * p00[c] + v * p10[c], u * p01[c] + v * p11[c]
        z = u + v
        u, v = u / z, v / z
    alpha = np.empty((2, run + 1, columns))
    alpha[0, 0], alpha[1, 0] = f0, f1
    for t in range(run):
        s, w = alpha[0, t], alpha[1, t]
        u, v = s * a[0, 0, t] + w * a[1, 0, t], s * a[0, 1, t] + w * a[1, 1, t]
        z = u + v
        alpha[0, t + 1], alpha[1, t + 1] = u / z, v / z

    b0, b1 = np.empty(columns), np.empty(columns)
    p00, p01, p10, p11 = products(True)
    u, v = 0.5, 0.5
    for c in reversed(range(columns)):
        b0[c], b1[c] = u, v
        u, v = p00[c] * u + p01[c] * v, p10[c] * u + p11[c] * v
        z = u + v
        u, v = u / z, v / z
    beta = np.empty((2, run + 1, columns))
    beta[0, run], beta[1, run] = b0, b1
    for t in reversed(range(run)):
        s, w = beta[0, t + 1], beta[1, t + 1]
        u, v = a[0, 0, t] * s + a[0, 1, t] * w, a[1, 0, t] * s + a[1, 1, t] * w
        z = u + v
        beta[0, t], beta[1, t] = u / z, v / z

    on = alpha[1, 1:] * beta[1, 1:]
    off = alpha[0, 1:] * beta[0, 1:]
    p = (on / (on + off)).T.reshape(-1)[:n]
    xi = alpha[:, None, :-1] * a * beta[None, :, 1:]
    xi /= xi.sum(axis=(0, 1))
    return p, xi, begin


def _near_copy_weights(texts: list[list[str]]) -> np.ndarray:
    """1 / size of the group of near copies each sample text belongs to."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, words in enumerate(texts):
        grams = {zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))}
        for salt, mult in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
            least = min((g * mult) & 0xFFFFFFFF for g in grams)
            other = seen.setdefault((salt, least), i)
            parent[root(i)] = root(other)
    sizes = Counter(root(i) for i in range(len(texts)))
    return np.array([1.0 / sizes[root(i)] for i in range(len(texts))])


class _MarkerFeatures(dict):
    def __missing__(self, word: str) -> list[str]:
        out = self[word] = ["w" + word, *("p" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k)]
        return out


def toxic_markers(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Features (prefixes, whole words) that mark a token as toxic.

    At least ``PURITY`` of the documents that have the feature are toxic, and that
    many so unlikely by chance (Chernoff bound on the binomial tail) that, of all
    features looked at, ``FALSE_MARKERS`` would pass in expectation.
    """
    weight = _near_copy_weights(texts)
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    of = _MarkerFeatures()
    for words, t, w in zip(texts, toxic, weight, strict=True):
        kind = int(t)
        for f in set().union(*map(of.__getitem__, set(words))):
            seen[f][kind] += w
    share = weight[toxic].sum() / weight.sum()
    bar = np.log(len(seen) / FALSE_MARKERS)
    out = set()
    for f, (clean, bad) in seen.items():
        n = clean + bad
        if bad >= PURITY * n and bad * np.log(bad / n / share) + (clean * np.log(clean / n / (1 - share)) if clean else 0.0) >= bar:
            out.add(f)
    return out


def fit(rows: list[tuple[int, str, int]], rounds: int = 30) -> CrfModel | None:
    """CRF from (id, text, toxic) rows; None if they show no toxic token."""
    rows = [r for r in rows if r[1] and _WORD.search(r[1])]
    texts = [[w.lower() for w in _WORD.findall(t)] for _, t, _ in rows]
    toxic = np.array([bool(r[2]) for r in rows], dtype=bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    held = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows])
    if toxic[held].sum() < 5 or (~toxic[held]).sum() < 5 or not toxic[~held].any() or toxic[~held].all():
        held[:] = False
    fitting = np.array(sorted(np.flatnonzero(~held), key=lambda i: (zlib.crc32(b"fit" + str(rows[i][0]).encode()), i)), dtype=np.int64)
    markers = toxic_markers([texts[i] for i in fitting], toxic[fitting])
    if not markers:
        return None

    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    first: list[bool] = []
    source: list[int] = []
    for i in [*fitting[toxic[fitting]][:FIT_DOCS], *fitting[~toxic[fitting]][:FIT_DOCS]]:
        for k, w in enumerate(texts[i]):
            ids.append(vocabulary.setdefault(w, len(vocabulary)))
            first.append(k == 0)
            source.append(i)
    words = list(vocabulary)
    often = np.bincount(np.array(ids), minlength=len(words))
    index: dict[str, int] = {}
    flat = [[index.setdefault(f, len(index)) for f in token_features(w)] for w in words]
    owner = np.repeat(np.arange(len(words)), [len(f) for f in flat])
    feature = np.fromiter((f for own in flat for f in own), dtype=np.int64)
    seen = np.bincount(feature, weights=often[owner]) >= MIN_COUNT
    owner, feature = owner[seen[feature]], feature[seen[feature]]
    dim = len(index)
    marked = np.array([("w" + w) in markers or any(("p" + w[:k]) in markers for k in (3, 4, 5, 6) if len(w) >= k) for w in words])
    ids_, first_ = np.array(ids), np.array(first)
    label = marked[ids_] & toxic[np.array(source)]

    pairs = ~first_[1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[:-1][pairs].astype(int), label[1:][pairs].astype(int)), 1)
    begins = np.bincount(label[first_].astype(int), minlength=2).astype(float)
    per_word = np.bincount(ids_, weights=label, minlength=len(words))

    theta, trans = np.zeros(dim), np.zeros((2, 2))
    bias = float(np.log((label.sum() + 1.0) / (len(label) + 2.0))) - 1.0
    m_t, v_t = np.zeros(dim), np.zeros(dim)
    small = np.zeros((2, 5))
    start = (begins + 1.0) / (begins.sum() + 2.0)
    for step in range(1, rounds + 1):
        e = bias + np.bincount(owner, weights=theta[feature], minlength=len(words))
        p, xi, begin = marginals(np.clip(e, -40, 40)[ids_], first_, np.exp(trans), start)
        inner = ~begin
        expected = (xi * inner).sum(axis=(2, 3))
        g_word = per_word - np.bincount(ids_, weights=p, minlength=len(words))
        g = np.bincount(feature, weights=g_word[owner], minlength=dim) - 0.1 * theta
        gs = np.r_[g_word.sum(), (observed - expected).reshape(-1)]
        m_t = 0.9 * m_t + 0.1 * g
        v_t = 0.99 * v_t + 0.01 * g * g
        small[0] = 0.9 * small[0] + 0.1 * gs
        small[1] = 0.99 * small[1] + 0.01 * gs * gs
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        pace = 0.2 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        theta += pace * (m_t / c1) / (np.sqrt(v_t / c2) + 1e-8)
        move = pace * (small[0] / c1) / (np.sqrt(small[1] / c2) + 1e-8)
        bias += move[0]
        trans += move[1:].reshape(2, 2)
    weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
    model = CrfModel(weights, float(bias), np.exp(trans), start, np.zeros(4), 0.5)
    check = np.flatnonzero(held) if held.any() else fitting
    seen_as = aggregates([rows[i][1] for i in check], model)
    best = np.inf
    for use in AGGREGATES:
        document = np.zeros(seen_as.shape[1])
        document[use] = logistic(seen_as[:, use], toxic[check])
        p = _sigmoid(seen_as @ document)
        loss = 2 * len(use) - np.log(np.where(toxic[check], p, 1 - p)).sum()
        if loss < best:
            best, model.document, model.threshold = loss, document, calibrate(p, toxic[check])
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w += 0.7 * np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
    return w


def calibrate(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of greatest F1; of several, the one nearest to 0.5."""
    edges = np.unique(np.r_[0.0, scores, 1.0])
    middle = np.r_[(edges[1:] + edges[:-1]) / 2, 0.5]
    middle = middle[middle >= 0.05]
    best = (-1.0, 0.0, 0.5)
    for t in middle:
        hit = scores >= t
        f1 = 2 * (hit & toxic).sum() / max(1, hit.sum() + toxic.sum())
        best = max(best, (float(f1), -abs(float(t) - 0.5), float(t)))
    return best[2]


def _aggregate(p: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[documents, 4]: a constant, log of the sum of squares, logit of the
    greatest marginal, log of the number of tokens."""
    strength = np.log(np.add.reduceat(p * p, starts) + 0.05)
    top = np.clip(np.maximum.reduceat(p, starts), 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(starts)), strength, np.log(top / (1 - top)), np.log(counts)], axis=1)


def _marginals_of(texts: list[str | None], model: CrfModel, emission: _Emission) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of all tokens, tokens of each text)."""
    if len(emission) > emission.LIMIT:
        emission.clear()
    values: list[float] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    look = emission.__getitem__
    for i, t in enumerate(texts):
        if t:
            before = len(values)
            values.extend(map(look, _WORD.findall(t)))
            counts[i] = len(values) - before
    first = np.zeros(len(values), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return marginals(np.array(values), first, model.transition, model.start)[0] if values else np.zeros(0), counts


def aggregates(texts: list[str], model: CrfModel) -> np.ndarray:
    """What the scores of texts, all with words, are made of."""
    p, counts = _marginals_of(texts, model, _Emission(model))
    return _aggregate(p, np.cumsum(counts) - counts, counts)


def _tag(texts: list[str | None], model: CrfModel, emission: _Emission) -> tuple[np.ndarray, list[list[dict]]]:
    p, counts = _marginals_of(texts, model, emission)
    scores = np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    if not len(p):
        return scores, spans
    some = counts > 0
    offset = np.cumsum(counts) - counts
    scores[some] = _sigmoid(_aggregate(p, offset[some], counts[some]) @ model.document)
    top = np.zeros(len(texts))
    top[some] = np.maximum.reduceat(p, offset[some])
    for i in np.flatnonzero(top >= SPAN_THRESHOLD):
        on = p[offset[i] : offset[i] + counts[i]] >= SPAN_THRESHOLD
        last = -2
        for k, m in enumerate(_WORD.finditer(texts[i])):
            if on[k]:
                if k == last + 1:
                    spans[i][-1]["end"] = m.end()
                else:
                    spans[i].append({"start": m.start(), "end": m.end()})
                last = k
    return scores, spans


def document_scores(texts: list[str | None], model: CrfModel) -> np.ndarray:
    return _tag(texts, model, _Emission(model))[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> CrfModel | None:
    """Fit on the bounded sample of labelled documents.

    Labels with a null id or label are left out; of repeated ids one counts.
    """
    known = (
        labels.select(named(labels, id_col).alias("_gf_id"), named(labels, label_col).cast("int").alias("_gf_label"))
        .filter("_gf_id IS NOT NULL AND _gf_label IS NOT NULL")
    )
    order = [F.xxhash64("_gf_id"), F.col("_gf_id")]
    sample = (
        known.filter("_gf_label = 1").orderBy(*order).limit(SAMPLE_TOXIC)
        .unionByName(known.filter("_gf_label <> 1").orderBy(*order).limit(SAMPLE_CLEAN))
    )
    text = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text"))
    # The sample's size is bounded above, so it can be sent to every executor.
    rows = text.join(F.broadcast(sample), "_gf_id").collect()
    best: dict = {}
    for r in rows:
        best[r["_gf_id"]] = max(best.get(r["_gf_id"], (r["_gf_text"] or "", 0)), (r["_gf_text"] or "", int(r["_gf_label"] == 1)))
    return fit([(i, t, label) for i, (t, label) in sorted(best.items(), key=lambda kv: str(kv[0]))])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_OUT = ["_gf_id", "toxic_score", "toxic_spans"]


def tag_toxicity(docs: DataFrame, model: CrfModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, toxic_score, toxic_spans) of every input row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = _Emission(model) if model else None
        for batch in batches:
            for part in slices(batch):
                if model:
                    scores, spans = _tag(part.column(1).to_pylist(), model, emission)
                else:
                    scores, spans = np.zeros(part.num_rows), [[]] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(spans, type=pa.list_(_SPAN))], names=_OUT)

    rows = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text"))
    schema = StructType([rows.schema["_gf_id"], *StructType.fromDDL("toxic_score double, toxic_spans array<struct<start:int,end:int>>")])
    return rows.mapInArrow(work, schema).withColumnRenamed("_gf_id", id_col)


def toxic_documents(docs: DataFrame, model: CrfModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``tag_toxicity`` at or above the calibrated threshold."""
    limit = model.threshold if model else 2.0
    return tag_toxicity(docs, model, id_col, text_col).filter(F.col("toxic_score") >= limit)


def drop_toxic(docs: DataFrame, model: CrfModel | None, text_col: str = "text") -> DataFrame:
    """The input rows below the threshold, in one pass over them."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = _Emission(model)
        for batch in batches:
            for part in slices(batch, at):
                scores, _ = _tag(part.column(at).to_pylist(), model, emission)
                yield part.filter(pa.array(scores < model.threshold))

    return map_rows(docs, work)
