"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte n-grams of 1 to 4 bytes of each word, lower-cased and with a mark
at both ends, hashed into ``BUCKETS`` rows of ``DIM`` numbers. A text is the mean of its
subwords' rows; a linear layer and a softmax follow. Rows and layer are trained together
by stochastic gradient descent in numpy, on at most ``PER_LANG`` documents of each
language. On a held-back tenth of that sample a temperature is fitted so that scores are
calibrated, and from it the score below which an answer is marked as rejected. To predict,
rows and layer are multiplied out once, so each subword adds one small vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed

BUCKETS, DIM, PER_LANG, GRAMS, UNKNOWN = 1 << 15, 16, 250, (1, 2, 3, 4), "und"
SEGMENT = 1 << 18
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # anything of ASCII that is no letter ends a word


def buckets_of(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, (place, bucket) of every n-gram inside one text that begins or ends in a letter."""
    codes = _FOLD[raw]
    for n in GRAMS:
        if len(codes) < n:
            continue
        key = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            key = (key << np.uint64(8)) | codes[k : len(codes) - n + 1 + k]
        with np.errstate(over="ignore"):
            hashed = ((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        inside = (codes[: len(key)] != 32) | (codes[n - 1 :] != 32)
        for k in range(1, n):
            at = offsets[1:-1] - k
            inside[at[(at >= 0) & (at < len(inside))]] = False
        inner = np.flatnonzero(inside)
        yield inner, hashed[inner].astype(np.int64)


def _segments(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size of each stretch of ``SEGMENT`` bytes, (cuts of the texts, place, bucket): memory does not grow with a text."""
    for lo in range(0, len(raw), SEGMENT):
        part = raw[lo : lo + SEGMENT + max(GRAMS) - 1]
        bounds = np.clip(offsets - lo, 0, len(part))
        for at, bucket in buckets_of(part, bounds):
            own = at < SEGMENT
            at, bucket = at[own], bucket[own]
            yield np.searchsorted(at, bounds), at + lo, bucket


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    raw, offsets = V.buffer_of(texts)
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, at, bucket in _segments(raw, offsets):
        key, n = np.unique((np.searchsorted(offsets, at, "right") - 1) * BUCKETS + bucket, return_counts=True)
        keys.append(key)
        sums.append(n)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(where, np.concatenate(sums), len(key)).astype(np.int64)
    cut = np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)
    return [(key[lo:hi] % BUCKETS, n[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> what it adds to each language's logit
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number, calibrated probability) of each text."""
        raw, offsets = V.buffer_of(texts)
        n, k = len(offsets) - 1, len(self.langs)
        total, size = np.zeros((n, k)), np.zeros(n)
        for cut, _, bucket in _segments(raw, offsets):
            run = np.concatenate((np.zeros((1, k)), np.cumsum(self.table[bucket], axis=0, dtype=np.float64)))
            total += run[cut[1:]] - run[cut[:-1]]
            size += np.diff(cut)
        p = _softmax((total / np.maximum(size, 1)[:, None] + self.bias) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 2.0, seed: int = 0) -> Model | None:
    """Stochastic gradient descent over (buckets, counts, language) samples; None without any."""
    samples = [s for s in samples if len(s[0])]
    langs = sorted({s[2] for s in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, used = order[: len(order) // 10], order[len(order) // 10 :]
    rows, layer, bias = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    number = {lang: k for k, lang in enumerate(langs)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for s in rng.permutation(used):
            b, c, lang = samples[s]
            share = (c / c.sum()).astype(np.float32)
            mean = share @ rows[b]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.05 * step * p
            rows[b] -= (step * 20 * share[:, None] * back).astype(np.float32)
    table = rows @ layer
    check = [samples[s] for s in (held if len(held) else used)]
    z = np.array([(c / c.sum()) @ table[b] + bias for b, c, _ in check])
    y = np.array([number[lang] for _, _, lang in check])
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())
    p = _softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return Model(langs, table.astype(np.float32), bias, float(heat), float(np.quantile(right, 0.005)) if len(right) else 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text"):
            got = counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([k.astype(np.int32).tobytes() for k, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["lang", "b", "c"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """A model from at most ``per_lang`` documents of each language, those with the smallest hashes of id and text.

    Rows with a null language or text are not learned from; rows equal in all three are one.
    What reaches the driver is the sample's hashed counts, at most ``BUCKETS`` numbers a
    document. Rows are drawn by their hash first, twice as many as are wanted, and cut then.
    """
    own = renamed(docs, id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return None
    place = F.pmod(F.xxhash64("id", "text", F.lit("langid")), F.lit(1 << 60))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1 << 60, int((1 << 60) * 2 * per_lang / n)))])
    drawn = own.withColumn("place", place).where(F.col("place") < share[F.col("lang")]).dropDuplicates(["lang", "place"])
    few = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("k") <= per_lang)
    rows = few.select("lang", "text").mapInArrow(_counted, "lang string, b binary, c binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.b), bytes(r.c)))
    return train([(np.frombuffer(r.b, np.int32), np.frombuffer(r.c, np.int32), r.lang) for r in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected; one row per row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text if there was nothing to learn from. Of equal scores the language first in the
    alphabet wins. Equal texts get equal answers, whatever stands beside them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text"):
                known = has_letter(b.column("text")) & (model is not None)
                if model is not None:
                    best, p = model.scores(b.column("text"))
                    lang = np.where(known, np.array(model.langs, object)[best], UNKNOWN)
                else:
                    p, lang = np.zeros(b.num_rows), np.full(b.num_rows, UNKNOWN, object)
                p = np.where(known, p, 0.0)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang.tolist(), pa.string()), pa.array(p), pa.array(~known | (p < (model.reject_below if model else 1)))], names=["id", "lang_pred", "score", "rejected"])

    own = renamed(docs, id=id_col, text=text_col)
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
