"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The lines of a text that hold a word form a sequence. Each line has a small feature
vector; the field has emission weights for the two labels and a table of transitions.
It is trained by gradient ascent on the conditional likelihood in numpy, on a bounded
sample of labelled documents (``SAMPLE`` of each class, ``LINES`` lines of each): the
lines of good documents count as content unless all of a line stands in the text again,
those of bad ones as boilerplate. Viterbi
decoding labels every line of every text; a document is kept if at least ``SHARE`` of
the code points in its words lie on content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed, small_batches, written

SAMPLE, LINES, SHARE = 600, 200, 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_PUNCT[list(b"!?.,;:-_/\\=+~^@()[]{}'\"`")] = True
_LOWER[128:] = True
FEATURES, REPEATED, IN_STEP = 11, 8, 2000


@dataclass
class Measured:
    """Counts of each text, and of its lines that hold a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_chars: np.ndarray
    features: np.ndarray


def _per(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, n)[:n].astype(np.int64)


def measure(texts: pa.Array) -> Measured:
    raw, offsets = V.buffer_of(texts)
    n = len(offsets) - 1
    start, end, text, h = V.words_of(raw, offsets)
    lstart, lend, ltext, lh = V.words_of(raw, offsets, space=_NEWLINE)
    line_of = np.searchsorted(lstart, start, "right") - 1
    n_lines = len(lstart)

    def summed(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[hi] - total[lo]

    point = (raw & 0xC0) != 0x80
    chars = summed(point, start, end)
    words_in = _per(line_of, n_lines)
    first, w = V.windows(h, text, 3)
    with np.errstate(over="ignore"):
        _, at, count = np.unique(V.mix(w + text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    repeated = V.spread(first[count[at] > 1], 3, len(h))
    held = words_in > 0
    with np.errstate(over="ignore"):
        line_key = V.mix(lh + ltext.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, where, times = np.unique(line_key[held], return_index=True, return_counts=True)
    kept_first = np.zeros(int(held.sum()), bool)
    kept_first[where] = True

    size = np.maximum(lend - lstart, 1)
    upper, symbol = (summed(m[raw], lstart, lend) for m in (_UPPER, _SYMBOL))
    lower, digit, punct = (summed(m[raw], lstart, lend) for m in (_LOWER, _DIGIT, _PUNCT))
    letters = np.maximum(upper + lower, 1)
    nw = np.maximum(words_in, 1)
    line_chars = _per(line_of, n_lines, chars)
    feats = np.stack(
        [
            np.ones(n_lines), symbol / size * 10, (symbol > 0.05 * size), upper / letters * 3, (upper > 0.5 * letters), digit / size * 5,
            punct / size * 5, (punct > 0.12 * size), _per(line_of, n_lines, repeated) / nw * 2, np.minimum(line_chars / nw, 20) / 10, np.minimum(words_in, 20) / 10,
        ],
        axis=1,
    ).astype(np.float32)
    dup = _per(ltext[held][~kept_first], n)
    return Measured(_per(text, n), _per(text, n, chars), summed(_SYMBOL[raw], offsets[:-1], offsets[1:]), dup, _per(text, n, repeated), ltext[held], line_chars[held], feats[held])


@dataclass
class Field:
    """A trained two-label chain; label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    def labels(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi labels of all sequences [bounds[k], bounds[k + 1]): short ones in step with each other, long ones in blocks."""
        score, n = features @ self.emission, np.diff(bounds)
        far = np.flatnonzero(n > IN_STEP)
        out = self._in_step(score, bounds[:-1], np.where(n > IN_STEP, 0, n))
        for k in far.tolist():
            out[bounds[k] : bounds[k + 1]] = self._in_blocks(score[bounds[k] : bounds[k + 1]])
        return out

    def _in_blocks(self, score: np.ndarray) -> np.ndarray:
        """Labels of one long sequence of n lines in about 3 * sqrt(n) steps.

        All blocks are decoded side by side for both labels that may stand before them; a
        walk over the blocks then picks the label at each border, and all trace back.
        """
        n = len(score)
        width = int(np.ceil(np.sqrt(n)))
        count = -(-n // width)
        s = np.zeros((count * width, 2))
        s[:n] = score
        s = s.reshape(count, width, 2)
        inside = (np.arange(count * width) < n).reshape(count, width)
        best = self.transition[None] + s[:, 0, None, :]
        best[0] = s[0, 0]
        back = np.zeros((width, count, 2, 2), np.int8)
        for t in range(1, width):
            step = best[:, :, :, None] + self.transition[None, None]
            live = inside[:, t, None, None]
            back[t] = np.where(live, step.argmax(axis=2), np.arange(2))
            best = np.where(live, step.max(axis=2) + s[:, t, None, :], best)
        total, enter = best[0, 0], np.zeros((count, 2), np.int8)
        for k in range(1, count):
            step = total[:, None] + best[k]
            enter[k], total = step.argmax(axis=0), step.max(axis=0)
        leave, before = np.zeros(count, np.int8), np.zeros(count, np.int8)
        now = int(total.argmax())
        for k in range(count - 1, -1, -1):
            leave[k], before[k] = now, enter[k, now]
            now = before[k]
        out, block = np.zeros((count, width), np.int8), np.arange(count)
        for t in range(width - 1, -1, -1):
            out[:, t] = leave
            if t:
                leave = back[t, block, before, leave]
        return out.reshape(-1)[:n]

    def _in_step(self, score: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(-n, kind="stable")
        length, first = n[order], begin[order]
        best, back = np.zeros((len(n), 2)), np.zeros((len(score), 2), np.int8)
        live = int(np.count_nonzero(length))
        best[:live] = score[first[:live]]
        top = int(length[0]) if len(length) else 0
        for t in range(1, top):
            live = int(np.searchsorted(-length, -t, "left"))
            step = best[:live, :, None] + self.transition[None]
            back[first[:live] + t] = step.argmax(axis=1)
            best[:live] = step.max(axis=1) + score[first[:live] + t]
        out, now = np.zeros(len(score), np.int8), best.argmax(axis=1).astype(np.int8)
        for t in range(top - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            out[first[:live] + t] = now[:live]
            now[:live] = back[first[:live] + t, now[:live]]
        return out


def train(sequences: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field | None:
    """Gradient ascent on the likelihood of labelled sequences; None unless both labels occur."""
    sequences = [(x, y) for x, y in sequences if len(x)]
    if len({y for _, y in sequences}) < 2:
        return None
    sequences.sort(key=lambda s: -len(s[0]))  # so those that reach line t are the first ones
    x = np.concatenate([f for f, _ in sequences]).astype(np.float64)
    length, label = np.array([len(f) for f, _ in sequences]), np.array([y for _, y in sequences])
    first = np.cumsum(length) - length
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) + 1)]
    weight = np.repeat(1 / (length * np.where(label == 1, (label == 1).sum(), (label == 0).sum())), length)
    line = np.where(np.repeat(label, length) == 1, x[:, REPEATED] < 1.9, False).astype(np.int64)
    truth = np.eye(2)[line]
    later = np.ones(len(x), bool)
    later[first] = False
    later = np.flatnonzero(later)
    e, a = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    step_e, step_a = np.zeros_like(e), np.zeros_like(a)
    pairs = (truth[later - 1] * weight[later, None]).T @ truth[later]
    for _ in range(rounds):
        score = x @ e
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, int(length[0])):
            at = first[: live[t]] + t
            before = forward[at - 1]
            forward[at] += np.logaddexp(before[:, :1] + a[0], before[:, 1:] + a[1])
        for t in range(int(length[0]) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            after = score[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(after[:, :1] + a[:, 0], after[:, 1:] + a[:, 1])
        end = forward[first + length - 1]
        total = np.repeat(np.logaddexp(end[:, 0], end[:, 1]), length)[:, None]
        node = np.exp(forward + backward - total)
        here = score + backward - total
        edge = np.array([[weight[later] @ np.exp(forward[later - 1, p] + a[p, q] + here[later, q]) for q in (0, 1)] for p in (0, 1)])
        step_e = 0.9 * step_e + x.T @ ((truth - node) * weight[:, None]) - decay * e
        step_a = 0.9 * step_a + pairs - edge - 0.2 * a  # documents of one kind would else forbid any change
        e, a = e + rate * step_e, a + rate * step_a
    return Field(e, a)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text"):
            m = measure(b.column("text"))
            cut = V.runs(b.num_rows, m.line_text)
            rows = [m.features[lo : min(hi, lo + LINES)].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.binary())], names=["id", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field | None:
    """A field from at most ``sample`` documents of each label (0 bad, 1 good), the smallest by a hash of the id.

    An id with both labels counts as bad. Of rows that share an id the text with the
    smallest hash is learned from, so no more than ``2 * sample`` rows reach the driver.
    """
    marked = renamed(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    few = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = written(few[0].unionByName(few[1]))  # at most 2 * sample rows, so it may be broadcast
    own = renamed(docs, id=id_col, text=text_col).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    one = own.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    of = {r.id: r.y for r in chosen.collect()}
    rows = one.mapInArrow(_lines, f"id {own.schema['id'].dataType.simpleString()}, features binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.features)))
    return train([(np.frombuffer(r.features, np.float32).reshape(-1, FEATURES), of[r.id]) for r in rows])


def verdict(texts: pa.Array, field: Field | None, share: float) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept of each text."""
    m, n = measure(texts), len(texts)
    if field is None:
        content = np.where(m.n_words > 0, 1.0, 0.0)
    else:
        label = field.labels(m.features, V.runs(n, m.line_text))
        content = _per(m.line_text, n, m.line_chars * label) / np.maximum(_per(m.line_text, n, m.line_chars), 1)
    failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > MOST_REPEATED * m.n_words)
    return [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, content, ~failed & (content >= share)]


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept; one row per row.

    Null and blank texts have zero counts and fail. Without a field (no labels of both
    kinds to learn from) the base rules decide alone. Ids may be null or repeat, other
    columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text"):
                cols = verdict(b.column("text"), field, share)
                yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, cols)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    own = renamed(docs, id=id_col, text=text_col)
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def kept_rows(docs: DataFrame, field: Field | None, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept, null and blank ones never; equal rows share a fate, an empty table stays empty, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, text_col):
                yield b.filter(pa.array(verdict(b.column(text_col), field, share)[-1]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
