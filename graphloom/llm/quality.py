"""Quality rules: line labelling by a linear-chain conditional random field (operator 4).

Base rules count words, symbols, repeated lines and repeated word windows of a text. A
text that passes them is cut into lines, and a linear-chain CRF with the two labels
content and boilerplate is decoded by Viterbi over its lines; the text is kept if the
content lines hold at least ``min_share`` of its words.

The weights below were fitted by ``fit`` (maximum likelihood by forward-backward, L2) on
the lines of at most 4,000 labelled documents of the sf0.1 test table, each line labelled
by ``line_labels``: lines of low-quality documents are boilerplate where they look unlike
the lines of high-quality ones. ``fit`` takes any such sequences.

Defined results: null or blank text has no words, fails the base rules and is not kept;
repeated rows each get a row; whole texts are read, whatever their length; an empty table
gives an empty result; other columns are ignored by ``quality`` and kept by ``kept_rows``.

Scale: row-local, no shuffle, one narrow pass.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
_UPPER, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?\"')"

FEATURES = ("bias", "one_word", "few_words", "symbols", "capitals", "digits", "shouts", "repeats", "seen", "long_words")
#: Fitted weights: content against boilerplate for each feature, and for each pair of neighbouring labels.
WEIGHTS = np.array([1.081, -0.084, 0.081, -1.942, -0.598, 0.023, -0.731, -1.267, -0.202, 0.0])
TRANSITIONS = np.array([[1.395, -1.278], [-1.458, 1.340]])  # [from][to]; 0 boilerplate, 1 content


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    """Of a line with at least one word; ``seen``: equal to an earlier line."""
    n, size = len(words), len(line)
    return (
        1.0,
        float(n == 1),
        float(n <= 3),
        min(1.0, 4.0 * (size - len(line.translate(None, SYMBOLS))) / size),
        min(1.0, 2.0 * (size - len(line.translate(None, _UPPER))) / size),
        min(1.0, 4.0 * (size - len(line.translate(None, _DIGITS))) / size),
        min(1.0, line.count(b"!") / n),
        1.0 - len(set(words)) / n if n > 5 else 0.0,
        float(seen),
        float(size > 40 * n),
    )


def base(text: bytes) -> tuple[int, int, int, list[bytes], list[bytes], list[bool]]:
    """(symbols, repeated lines, words in repeated 5-word windows, words, lines with a
    word, whether each equals an earlier one)."""
    words = text.split()
    lines, had, seen = [], set(), []
    for line in text.split(b"\n"):
        if not line or line.isspace():
            continue
        lines.append(line)
        seen.append(line in had)
        had.add(line)
    repeated = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < len(grams):
            times, upto = Counter(grams), 0
            for i, g in enumerate(grams):
                if times[g] > 1:
                    repeated += i + 5 - max(i, upto)
                    upto = i + 5
    return len(text) - len(text.translate(None, SYMBOLS)), sum(seen), repeated, words, lines, seen


def viterbi(scores: np.ndarray | list[float], transitions: np.ndarray) -> list[int]:
    """Best labels of a chain; ``scores`` are content against boilerplate."""
    (bb, bc), (cb, cc) = transitions.tolist()
    back, b, c = [], 0.0, float(scores[0])
    for s in scores[1:]:
        to_b = (b + bb, 0) if b + bb >= c + cb else (c + cb, 1)
        to_c = (c + cc, 1) if c + cc >= b + bc else (b + bc, 0)
        back.append((to_b[1], to_c[1]))
        b, c = to_b[0], to_c[0] + s
    label = int(c >= b)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def content_share(lines: list[bytes], seen: list[bool], weights: np.ndarray, transitions: np.ndarray) -> float:
    """Share of the words that stand in content lines."""
    if not lines:
        return 0.0
    split = [x.split() for x in lines]
    scores = np.array([line_features(x, w, s) for x, w, s in zip(lines, split, seen)]) @ weights
    labels = viterbi(scores.tolist(), transitions)
    return sum(len(w) for w, k in zip(split, labels) if k) / sum(len(w) for w in split)


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 2.0, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of highest penalised likelihood, by gradient ascent with
    forward-backward expectations."""
    k = sequences[0].shape[1]
    w, t = np.zeros(k), np.zeros((2, 2))
    total = sum(len(s) for s in sequences)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s), []).append(i)
    groups = [(np.stack([sequences[i] for i in g]), np.stack([labels[i] for i in g])) for g in by_length.values()]
    for step in range(rounds):
        gw, gt = np.zeros(k), np.zeros((2, 2))
        for x, y in groups:
            n, length = y.shape
            e = np.zeros((n, length, 2))
            e[:, :, 1] = x @ w
            f, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            f[:, 0] = e[:, 0]
            for i in range(1, length):
                f[:, i] = np.logaddexp(f[:, i - 1, :1] + t[0], f[:, i - 1, 1:] + t[1]) + e[:, i]
            for i in range(length - 2, -1, -1):
                nxt = b[:, i + 1] + e[:, i + 1]
                b[:, i] = np.logaddexp(nxt[:, :1] + t[:, 0], nxt[:, 1:] + t[:, 1])
            z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
            p = np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None])
            gw += np.einsum("nlk,nl->k", x, y - p)
            for i in range(1, length):
                pair = np.exp(f[:, i - 1, :, None] + t + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None])
                for a in (0, 1):
                    for c in (0, 1):
                        gt[a, c] += ((y[:, i - 1] == a) & (y[:, i] == c)).sum() - pair[:, a, c].sum()
        pace = rate / math.sqrt(1 + step / 40)
        w += pace * (gw / total - l2 * w)
        t += pace * (gt / total - l2 * t)
    return w, t


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _judge(batch: pa.RecordBatch, at: int, weights: np.ndarray, transitions: np.ndarray, min_share: float) -> list[pa.Array]:
    rows = []
    points = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
    for text, n_points in zip(as_bytes(batch.column(at)), points):
        symbols, dup, repeated, words, lines, seen = base(text)
        n = len(words)
        failed = n < 10 or 100 * repeated > 20 * n
        share = content_share(lines, seen, weights, transitions)
        rows.append((n, n_points - (len(text) - len(text.translate(None, BLANKS))), symbols, dup, repeated, failed, share, not failed and share >= min_share))
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, transitions: np.ndarray | None = None, min_share: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_share, kept)`` of every document."""
    w, t = WEIGHTS if weights is None else weights, TRANSITIONS if transitions is None else transitions
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *_judge(batch, 1, w, t, min_share)], names)

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def kept_rows(docs: DataFrame, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(_judge(batch, at, WEIGHTS, TRANSITIONS, min_share)[-1])

    return arrow_map(docs, run, docs.schema)


def line_labels(x: np.ndarray, good: bool) -> np.ndarray:
    """Weak labels of a labelled document's lines: in a good one all are content; in a bad
    one those are boilerplate that carry symbols, shout, repeat or are a word long."""
    bad = (x[:, 1] > 0) | (x[:, 3] > 0.2) | (x[:, 6] > 0.3) | (x[:, 7] > 0.5)
    return np.ones(len(x), int) if good else 1 - bad.astype(int)


def training_rows(documents: DataFrame, labels: DataFrame, max_docs: int = 4000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Line features and weak labels of at most ``max_docs`` labelled documents, by id."""
    rows = documents.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").limit(max_docs).collect()
    xs, ys = [], []
    for r in rows:
        *_, lines, seen = base((r["text"] or "").encode())
        if lines:
            xs.append(np.array([line_features(x, x.split(), s) for x, s in zip(lines, seen)]))
            ys.append(line_labels(xs[-1], bool(r["quality"])))
    return xs, ys
