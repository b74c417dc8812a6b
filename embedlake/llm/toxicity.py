"""Operator 8: toxic spans and document scores by a linear-chain conditional random field.

``fit`` learns on the driver from a bounded sample of labelled documents (``MAX_DOCS`` a class, whole texts).
Words end at white space, in training as in scoring. Tokens get labels first: in a toxic document, a token with a feature (the
word, or its first 4 to 6 letters) that stands in many distinct toxic texts and hardly in others, beyond
chance, is toxic.
A two-state chain over features, a bias and transitions is then trained on these labels by Adam, on the exact
gradient of the chain's likelihood over all tokens, and a logistic curve over the chain's marginals on the
document labels.

``score`` runs forward-backward over every whole text. Tokens without a feature share one potential, so
runs of them are a power of one 2 x 2 matrix, in closed form; only tokens with features are stepped through.
Marginals give the score (expected toxic tokens and the largest marginal) and the offending offsets.
One narrow pass, no shuffle.

Cases: null or empty text gets the score of a text without evidence; null ids are kept; repeated rows are
scored each; an empty table gives no rows; without labels of both classes every score is 0. Labels, language,
source and id never reach a score.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import _text as T

#: Bounds of the sample that the model is fitted on, and of the model.
MAX_DOCS, MAX_FEATURES = 3000, 20_000
#: A feature counts as toxic if so many distinct toxic texts have it, with odds of so much (natural logarithm).
LEAST_TEXTS, LEAST_ODDS, MARGIN = 3, 2.5, 0.0
PREFIXES = (4, 5, 6)
ROUNDS, RATE, DECAY = 40, 0.3, 1e-3
SLICE = 1 << 20
#: Words whose potentials a task keeps.
KEEP_WORDS = 200_000
_STRIP = string.punctuation + "«»“”„…¡¿–—"
#: White space beyond that of ASCII words, as UTF-8; fixed values of Unicode.
_BLANKS = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def features(word: str) -> list[str]:
    w = word.strip(_STRIP).lower()
    return [w] + [f"{w[:k]}*" for k in PREFIXES if len(w) > k] if w else []


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    enter: float = 0.0
    leave: float = 0.0
    stay: float = 0.0
    curve: tuple[float, float, float] | None = None  # constant, expected tokens, largest marginal

    def unary(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def _step(m: Model) -> np.ndarray:
    return np.exp(np.array([[0.0, m.enter], [m.leave, m.stay]]))


def _eigen(m: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Projectors of A D, and its smaller eigenvalue as a share of the larger. A: transitions, D: default potentials."""
    a = _step(m) @ np.diag([1.0, np.exp(m.bias)])
    half, det = (a[0, 0] + a[1, 1]) / 2, a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    root = np.sqrt(max(half * half - det, 1e-300))
    l1, l2 = half + root, half - root
    p1 = (a - l2 * np.eye(2)) / (l1 - l2)
    return p1, np.eye(2) - p1, l2 / l1


def _gap_powers(m: Model, gaps: np.ndarray) -> np.ndarray:
    """(A D) ** gap for each gap, scaled by the largest eigenvalue's power."""
    p1, p2, ratio = _eigen(m)
    return p1 + p2 * (ratio**gaps)[:, None, None]


def _gap_slopes(m: Model, gaps: np.ndarray) -> list[np.ndarray]:
    """Derivatives of (A D) ** gap by bias, enter, leave and stay, scaled alike: sums over all places in the run."""
    p1, p2, ratio = _eigen(m)
    a = _step(m) @ np.diag([1.0, np.exp(m.bias)])
    top = (a[0, 0] + a[1, 1]) / (1 + ratio)  # the larger eigenvalue
    far = ratio**gaps
    with np.errstate(divide="ignore", invalid="ignore"):
        less = np.where(gaps > 0, gaps * ratio ** np.maximum(gaps - 1, 0), 0.0)
    mixed = (1 - far) / (1 - ratio)
    out = []
    for at in ([[0, 1], [0, 1]], [[0, 1], [0, 0]], [[0, 0], [1, 0]], [[0, 0], [0, 1]]):
        d = a * np.array(at) / top
        cross = p1 @ d @ p2 + p2 @ d @ p1
        out.append((p1 @ d @ p1) * gaps[:, None, None] + (p2 @ d @ p2) * less[:, None, None] + cross * mixed[:, None, None])
    return out


def _passes(m: Model, unary: np.ndarray, gaps: np.ndarray, tail: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scaled forward and backward messages, the matrices before each token with features, and potentials."""
    pot = np.stack([np.ones(len(unary)), np.exp(np.clip(unary + m.bias, -30, 30))], axis=1)
    way = _gap_powers(m, gaps.astype(float)) @ _step(m)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    alpha, beta = np.empty((len(unary), 2)), np.empty((len(unary), 2))
    live = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")  # texts with more than t tokens
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        now = way[at, 0] if t == 0 else np.einsum("ni,nij->nj", alpha[at - 1], way[at])
        now = now * pot[at]
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    ends = _gap_powers(m, tail[order].astype(float)).sum(axis=2)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        at = begin[:n] + t
        more = int(live[t + 1]) if t + 1 < len(live) else 0
        now = ends[:n].copy()
        if more:
            nxt = at[:more] + 1
            now[:more] = np.einsum("nij,nj->ni", way[nxt], pot[nxt] * beta[nxt])
        beta[at] = now / now.sum(axis=1, keepdims=True)
    return alpha, beta, way, pot


def marginals(m: Model, unary: np.ndarray, gaps: np.ndarray, tail: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token with features.

    ``gaps``: default tokens before each such token (since the last one, or the text's start); ``tail``: after
    a text's last one; ``first``: each text's first such token, with a closing entry. Texts have one at least.
    """
    alpha, beta, _, _ = _passes(m, unary, gaps, tail, first)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def expected(m: Model, unary: np.ndarray, gaps: np.ndarray, tail: np.ndarray, first: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected numbers of toxic tokens, entries, exits and stays over all texts.

    ``bare``: lengths of the texts without any token with features. Default tokens count too, runs in closed form.
    """
    alpha, beta, way, pot = _passes(m, unary, gaps, tail, first)
    both = alpha * beta
    p = both[:, 1] / both.sum(axis=1)
    start = np.zeros(len(unary), bool)
    start[first[:-1]] = True
    left = np.where(start[:, None], [1.0, 0.0], np.roll(alpha, 1, axis=0))
    right = pot * beta
    total = np.einsum("ni,nij,nj->n", left, way, right)
    a, run = _step(m), gaps.astype(float)
    powers = _gap_powers(m, run)
    edges = [None, np.array([[0, a[0, 1]], [0, 0]]), np.array([[0, 0], [a[1, 0], 0]]), np.array([[0, 0], [0, a[1, 1]]])]
    out = np.array([p.sum(), 0.0, 0.0, 0.0])
    ends = np.append(tail, bare).astype(float)
    lead = np.append(alpha[first[1:] - 1], np.tile([1.0, 0.0], (len(bare), 1)), axis=0)
    last = np.einsum("ni,nij->n", lead, _gap_powers(m, ends))
    for k, (inner, after) in enumerate(zip(_gap_slopes(m, run), _gap_slopes(m, ends), strict=True)):
        slope = inner @ a
        if edges[k] is not None:
            slope = slope + powers @ edges[k]
        out[k] += (np.einsum("ni,nij,nj->n", left, slope, right) / total).sum() + (np.einsum("ni,nij->n", lead, after) / last).sum()
    return p, out


def observed(y: np.ndarray, gaps: np.ndarray, tail: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Toxic tokens, entries, exits and stays of the labels ``y``; default tokens are not toxic."""
    start = np.zeros(len(y), bool)
    start[first[:-1]] = True
    before = np.append(False, y[:-1]) & ~start & (gaps == 0)  # the token just before is toxic
    open_ = np.append(False, y[:-1]) & ~start & (gaps > 0)
    close = y[first[1:] - 1] & (tail > 0)
    return np.array([y.sum(), (y & ~before).sum(), (before & ~y).sum() + open_.sum() + close.sum(), (before & y).sum()], float)


def _tokens(texts: list[str], known: dict[str, int]) -> tuple[list, list, list]:
    """Per text its tokens with known features: (position, feature numbers), and its number of tokens."""
    memo: dict[str, list[int]] = {}
    at, feats, sizes = [], [], []
    for text in texts:
        ws = text.split()
        p, f = [], []
        for k, w in enumerate(ws):
            got = memo.get(w)
            if got is None:
                got = memo[w] = [known[x] for x in features(w) if x in known]
            if got:
                p.append(k)
                f.append(got)
        at.append(p)
        feats.append(f)
        sizes.append(len(ws))
    return at, feats, sizes


def _contexts(texts: list[str], wanted: set[str]) -> dict[str, Counter]:
    """By feature and word, in how many distinct pairs of neighbours the word stands."""
    seen, out = set(), {}
    memo: dict[str, list[str]] = {}
    for text in texts:
        ws = ["", *text.split(), ""]
        for k in range(1, len(ws) - 1):
            w = ws[k]
            got = memo.get(w)
            if got is None:
                got = memo[w] = [f for f in features(w) if f in wanted]
            if got and (at := (ws[k - 1], w, ws[k + 1])) not in seen:
                seen.add(at)
                for f in got:
                    out.setdefault(f, Counter())[features(w)[0]] += 1
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from texts and their labels (1: toxic)."""
    seen = {t: y for t, y in zip(texts, toxic, strict=True)}
    texts, labels = list(seen), np.array(list(seen.values()), int)
    n_pos, n_neg = int(labels.sum()), int((labels == 0).sum())
    if not n_pos or not n_neg:
        return Model()
    pos, neg = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        (pos if y else neg).update({f for w in set(t.split()) for f in features(w)})
    odds = {f: np.log((c + 0.5) / (n_pos + 1)) - np.log((neg[f] + 0.5) / (n_neg + 1)) for f, c in pos.items() if c >= LEAST_TEXTS}
    prior, least = n_pos / (n_pos + n_neg), 2 * np.log(max(2, len(pos | neg))) + MARGIN

    def gain(f: str, n: int) -> float:
        """Twice the log-likelihood ratio of ``n`` toxic finds against chance."""
        both = n + neg[f]
        return 2 * sum(x * np.log(x / (share * both)) for x, share in ((n, prior), (neg[f], 1 - prior)) if x)

    found = {f for f, o in odds.items() if o > 1 and gain(f, pos[f]) >= least}
    own = _contexts([t for t, y in zip(texts, labels, strict=True) if y], found)
    # finds count once a context, so copies of a text count once; a prefix has to tell more than its commonest word does
    count = {f: min(pos[f], sum(by.values()) - (max(by.values()) if f[-1] == "*" else 0)) for f, by in own.items()}
    chosen = sorted((f for f, n in count.items() if n >= LEAST_TEXTS and n > neg[f] and gain(f, n) >= least), key=lambda f: (-gain(f, count[f]), f))[:MAX_FEATURES]
    if not chosen:
        return Model()
    known = {f: k for k, f in enumerate(chosen)}
    toxic_feature = np.array([odds[f] >= LEAST_ODDS for f in chosen])
    at, feats, sizes = _tokens(texts, known)
    some = [k for k in range(len(texts)) if at[k]]
    count = np.array([len(at[k]) for k in some], np.int64)
    first = np.append(0, np.cumsum(count))
    pos_of = np.array([p for k in some for p in at[k]], np.int64)
    gaps = np.diff(pos_of, prepend=-1) - 1
    gaps[first[:-1]] = pos_of[first[:-1]]
    tail = np.array([sizes[k] for k in some], np.int64) - pos_of[first[1:] - 1] - 1
    tok = np.repeat(np.arange(len(pos_of)), [len(f) for k in some for f in feats[k]])
    feat = np.array([x for k in some for f in feats[k] for x in f], np.int64)
    doc = np.repeat(labels[some], count)
    y = (np.bincount(tok, toxic_feature[feat], len(pos_of)) > 0) & (doc == 1)
    bare = np.array([n for k, n in enumerate(sizes) if n and not at[k]], np.int64)
    seen_counts = observed(y, gaps, tail, first)
    # parameters: features, bias, enter, leave, stay
    theta = np.append(np.zeros(len(chosen)), [-3.0, -1.0, 0.0, 1.0])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n = len(chosen)
    for k in range(1, ROUNDS + 1):
        model = Model(bias=theta[n], enter=theta[n + 1], leave=theta[n + 2], stay=theta[n + 3])
        p, counts = expected(model, np.bincount(tok, theta[feat], len(pos_of)), gaps, tail, first, bare)
        grad = np.append(np.bincount(feat, (p - y)[tok], n), counts - seen_counts)
        grad = grad / max(1, len(some)) + DECAY * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta = theta - RATE * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    model = Model(
        {f: round(float(w), 4) for f, w in zip(chosen, theta[:n], strict=True) if abs(w) > 0.05},
        float(theta[n]), float(theta[n + 1]), float(theta[n + 2]), float(theta[n + 3]),
    )
    kept = np.array([model.weights.get(f, 0.0) for f in chosen])  # as scoring has them
    p = marginals(model, np.bincount(tok, kept[feat], len(pos_of)), gaps, tail, first)
    x = np.zeros((len(texts), 2))
    x[some] = np.stack([np.log1p(np.add.reduceat(p, first[:-1])), np.maximum.reduceat(p, first[:-1])], axis=1)
    model.curve = _logistic(x, labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), z.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """A model from the rows of ``docs`` that ``labels`` (id, label) marks, at most ``max_docs`` a class."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    part = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    picked = part(0).union(part(1))  # 2 * max_docs rows at most
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id")
    found = sorted((r["_id"], r["_y"], r["_t"]) for r in rows.collect())
    return train([t for _, _, t in found], [y for _, y, _ in found])


def _plain_blanks(data: np.ndarray) -> np.ndarray:
    """``data`` with all white space that words end at as ASCII blanks; code points shift, so this is for finding words only."""
    raw = data.tobytes()
    return np.frombuffer(_BLANKS.sub(lambda m: b" " * len(m[0]), raw), np.uint8) if _BLANKS.search(raw) else data


class Scorer:
    """Scores texts in numpy; keeps the potentials of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def run(self, data: np.ndarray, offsets: np.ndarray, spans: bool = False) -> tuple[np.ndarray, list]:
        n, m = len(offsets) - 1, self.model
        if m.curve is None:
            return np.zeros(n), [[] for _ in range(n)]
        given, data = data, _plain_blanks(data)
        starts, ends, first = T.words(data, offsets)
        key, at, back = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.memo) > KEEP_WORDS:
            self.memo = {}
        get, raw, own = self.memo.get, data.tobytes(), np.empty(len(key))
        for k, h in enumerate(key.tolist()):
            u = get(h)
            if u is None:
                u = self.memo[h] = m.unary(raw[starts[at[k]] : ends[at[k]]].decode("utf-8", "replace"))
            own[k] = u
        unary = own[back] if len(key) else np.zeros(0)
        word = np.flatnonzero(unary)
        row = np.searchsorted(first, word, "right") - 1
        some, begin = np.unique(row, return_index=True)
        x = np.zeros((n, 2))
        p = np.zeros(0)
        if len(word):
            lead = np.append(begin, len(word))
            gaps = np.diff(word, prepend=0) - 1
            gaps[begin] = word[begin] - first[some]
            tail = first[some + 1] - word[lead[1:] - 1] - 1
            p = marginals(m, unary[word], gaps, tail, lead)
            x[some] = np.stack([np.log1p(np.add.reduceat(p, begin)), np.maximum.reduceat(p, begin)], axis=1)
        a, b, c = m.curve
        score = 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))
        out: list = [[] for _ in range(n)] if spans else []
        if spans:
            point = np.append(0, np.cumsum((given & 0xC0) != 0x80))  # code points before each byte
            for k in np.flatnonzero(p >= 0.5).tolist():
                r, s, e = int(row[k]), starts[word[k]], ends[word[k]]
                out[r].append({"start": int(point[s] - point[offsets[r]]), "end": int(point[e] - point[offsets[r]]), "probability": float(p[k])})
        return score, out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """id, score, predicted (score >= 0.5) and ``spans``: code-point offsets of toxic tokens and their marginals."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(1), SLICE):
                s, where = scorer.run(data, offsets, spans)
                columns, names = [batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"]
                if spans:
                    columns.append(pa.array(where, kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema + ", spans array<struct<start: bigint, end: bigint, probability: double>>" * spans)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(batch.schema.get_field_index(text_col)), SLICE):
                yield batch.slice(a, b - a).filter(pa.array(scorer.run(data, offsets)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for rows whose label is never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
