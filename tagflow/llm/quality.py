"""Quality rules: counted base rules and a linear-chain CRF over a text's lines.

Every line gets a label, content or boilerplate, by Viterbi decoding of a
linear-chain conditional random field.  A document is kept if it passes the
base rules and if the lines labelled content hold at least ``min_share`` of
its words' characters.

The field is fitted here by gradient ascent of the conditional likelihood on a
bounded sample of labelled documents (``max_docs``, the smallest hash values
of the ids): lines of a good document count as content, lines of a bad one as
boilerplate.  Only the fit uses the sample; every document is scored.  Line
features never depend on other documents, so scoring is one pass without a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_bytes

MAX_TRAIN_DOCS = 2000     # labelled documents the field is fitted on
TRAIN_LINES = 64          # a training document is cut into sequences of this many lines
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")

FEATURES = ("bias", "symbols", "any symbol", "capitals", "mostly capitals", "digits", "marks", "repeats",
            "mostly repeats", "short", "long", "ends a sentence", "seen before", "long words", "no letters")

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])


@dataclass(frozen=True)
class LineModel:
    """Weights of the field: ``state[f]`` is the score of content over boilerplate,
    ``trans[a][b]`` that of label a followed by label b (0 boilerplate, 1 content)."""

    state: tuple
    trans: tuple


def count_repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    size = len(ids)
    pair = w[:-1] * size + w[1:]
    if size < 2_000_000:
        key = pair[:-1] * size + w[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1][:-1] * size + w[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    cover = np.zeros(n, dtype=bool)
    for i in range(3):
        cover[i:i + n - 2] |= hit
    return int(cover.sum())


def line_features(lines: list) -> np.ndarray:
    """One row of features per line (bytes, with at least one word)."""
    out = np.zeros((len(lines), len(FEATURES)))
    seen = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(line)
        low = n - len(line.translate(None, LOWER))
        up = n - len(line.translate(None, UPPER))
        sym = n - len(line.translate(None, SYMBOLS))
        digits = n - len(line.translate(None, DIGITS))
        marks = line.count(b"!") + line.count(b"?")
        k = len(words)
        rep = 1.0 - len(set(words)) / k if k > 3 else 0.0
        caps = up / (up + low) if up + low else 0.0
        wide = sum(map(len, words)) / k
        out[i] = (1.0, min(1.0, 10 * sym / n), sym > 2, caps, caps > 0.5 and up > 5, min(1.0, 5 * digits / n),
                  min(1.0, marks / k), rep, rep > 0.6, k < 5, k >= 12, line.rstrip(SPACE).endswith(ENDS),
                  line in seen, wide > 15, up + low + digits == 0 and not any(c > 127 for c in line))
        seen.add(line)
    return out


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label path of a two-state chain; ``scores[i]`` favours label 1 on line i."""
    n = len(scores)
    (t00, t01), (t10, t11) = trans
    s = scores.tolist()
    a, b = 0.0, s[0]
    back = []
    for x in s[1:]:
        stay0, from1 = a + t00, b + t10
        from0, stay1 = a + t01, b + t11
        back.append((from1 > stay0, stay1 > from0))
        a = from1 if from1 > stay0 else stay0
        b = (stay1 if stay1 > from0 else from0) + x
    label = int(b > a)
    path = np.empty(n, dtype=np.int8)
    path[n - 1] = label
    for i in range(n - 2, -1, -1):
        label = int(back[i][label])
        path[i] = label
    return path


def fit(texts: list, good: list, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> LineModel:
    """Fit the field; ``good[i]`` is 1 where text i is content, 0 where it is boilerplate.

    Without examples of both kinds there is nothing to learn: every line is content.
    """
    seqs, labels = [], []
    for t, q in zip(texts, good):
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        feats = line_features(lines)
        for i in range(0, len(lines), TRAIN_LINES):
            seqs.append(feats[i:i + TRAIN_LINES])
            labels.append(int(q))
    k = len(FEATURES)
    if len(set(labels)) < 2:
        return LineModel((1.0,) + (0.0,) * (k - 1), ((0.0, 0.0), (0.0, 0.0)))
    size = max(map(len, seqs))
    x = np.zeros((len(seqs), size, k))
    m = np.zeros((len(seqs), size), dtype=bool)
    for i, s in enumerate(seqs):
        x[i, :len(s)], m[i, :len(s)] = s, True
    y = np.array(labels)
    # Both kinds weigh the same, whatever their shares in the sample.
    per = np.where(y == 1, 0.5 / max(1, m[y == 1].sum()), 0.5 / max(1, m[y == 0].sum()))
    w, t = np.zeros(k), np.zeros((2, 2))
    vel_w, vel_t = np.zeros(k), np.zeros((2, 2))
    pair = m[:, 1:]
    for _ in range(rounds):
        e = np.zeros((len(seqs), size, 2))
        e[:, :, 1] = x @ w
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for i in range(1, size):
            step = np.logaddexp(fwd[:, i - 1, :1] + t[0], fwd[:, i - 1, 1:] + t[1]) + e[:, i]
            fwd[:, i] = np.where(m[:, i:i + 1], step, fwd[:, i - 1])
        for i in range(size - 2, -1, -1):
            nxt = e[:, i + 1] + bwd[:, i + 1]
            step = np.stack([np.logaddexp(t[a, 0] + nxt[:, 0], t[a, 1] + nxt[:, 1]) for a in (0, 1)], axis=1)
            bwd[:, i] = np.where(m[:, i + 1:i + 2], step, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * m
        grad_w = np.einsum("n,nl,nlk->k", per, (y[:, None] - p1) * m, x) - decay * w
        grad_t = -decay * t
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(fwd[:, :-1, a] + t[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None])
                seen = ((y == a) & (y == b))[:, None]
                grad_t[a, b] += (per[:, None] * (seen - p) * pair).sum()
        vel_w, vel_t = 0.9 * vel_w + rate * grad_w, 0.9 * vel_t + rate * grad_t
        w, t = w + vel_w, t + vel_t
    return LineModel(tuple(w.tolist()), tuple(map(tuple, t.tolist())))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> LineModel:
    """Fit on ``max_docs`` labelled documents at most, chosen by a hash of their ids.

    Only the chosen ids (a fixed number) are broadcast to find their texts, and
    only those texts reach the driver.  Unlabelled (null) rows are left out; of
    several labels of a document the lowest counts.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label_col).alias("_good"))
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).dropDuplicates([id_col])
    got = sorted(rows.select(id_col, text_col, "_good").collect())
    return fit([r[1] for r in got], [r[2] for r in got])


def measure(data: bytes | None, state: np.ndarray, trans: np.ndarray, min_share: float) -> tuple:
    """The values of ``FIELDS`` for one text."""
    data = data or b""
    words = data.split()
    n_words = len(words)
    bare = data.translate(None, SPACE)
    chars = len(bare) - len(bare.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    lines = [x for x in data.split(b"\n") if x.split()]
    repeats = count_repeat_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > 50 * n_words
    share = 0.0
    if lines:
        label = viterbi(line_features(lines) @ state, trans)
        size = np.array([len(x.translate(None, SPACE)) for x in lines], dtype=float)
        share = float((size * label).sum() / size.sum())
    return (n_words, chars, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, failed, share, not failed and share >= min_share)


def quality_rules(docs: DataFrame, model: LineModel, min_share: float = 0.5, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``FIELDS``: the base counts, the content share and the verdict.

    A null or empty text has no words, so it fails the base rules.  Columns of
    the input named like a result column are replaced.
    """
    state, trans = np.array(model.state), np.array(model.trans)

    def compute(col):
        return list(zip(*(measure(b, state, trans, min_share) for b in as_bytes(col))))

    return append_columns(docs, FIELDS, [text_col], compute, keep)
