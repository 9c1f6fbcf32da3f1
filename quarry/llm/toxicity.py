"""Toxicity scores from a convolutional text classifier trained in numpy.

Words (ASCII lower case, punctuation as space) are hashed into an embedding table; a word's vector is the sum of the
rows of the whole word and of its first four and five bytes, so that inflected forms share what they have in common. Filters of several widths run over
the text, each filter's maximum over all positions is kept, and a logistic layer turns the maxima into a logit. Since
a filter response is a sum over its offsets, scoring uses one table of responses per offset (embedding times filter)
and only gathers and adds.

Training: at most ``per_class`` rows of each label with at most ``most_words`` words together (in the order of a hash of
doc_id, documented bounds; a row over the bound is left out whole) whose crc32(doc_id) mod 5 isn't 0; one in five of these is kept to choose when to stop and to calibrate a threshold for each
language. The language of a text is told from its own function words, never from a column. A score is the logistic of
the logit's distance to the threshold of the text's language, so 0.5 is the threshold everywhere.

Defined cases: a null or empty text is scored as a text without words; a text of any length is scored whole, a few
megabytes of texts at a time; labels that are null are ignored; of several labels of one document the largest counts;
without labels of both kinds every score is 0; a tie between languages goes to the first of them; repeated rows get
equal scores; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.text import list_array, slices, utf8, word_count
from quarry.runtime import ship

#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to that is with for was are this from",
    "fr": "le les et est une qui dans pour pas sur avec du",
    "de": "der die und das ist nicht den von mit ein sich auf",
    "es": "el los y las por con para del una su como no",
}
LANGUAGES = (*FUNCTION_WORDS, "")

_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@dataclass(frozen=True)
class ToxicSpec:
    buckets: int = 1 << 16
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    per_class: int = 3000
    most_words: int = 2_000_000
    updates: int = 2400
    checks: int = 24
    patience: int = 6
    batch: int = 32
    rate: float = 0.01
    word_drop: float = 0.1
    seed: int = 5


class WordBuckets(dict):
    """word -> slot; ``rows[slot]`` has the buckets (from 1 on, 0 is padding) of the word and of its two prefixes."""

    def __init__(self, buckets: int, limit: int = 250_000):
        super().__init__()
        self.buckets, self.limit, self.rows = buckets, limit, np.zeros((1024, PARTS), np.int32)

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        if slot >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        hashed = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word[:4], 4), xxhash.xxh3_64_intdigest(word[:5], 5))
        self.rows[slot] = [h % (self.buckets - 1) + 1 for h in hashed]
        return slot


PARTS = 3


def word_ids(text: bytes | None, table: WordBuckets) -> np.ndarray:
    """Buckets of each word, one row per word."""
    if len(table) >= table.limit:
        table.clear()
    words = (text or b"").lower().translate(_SPACES).split()
    slots = np.fromiter(map(table.__getitem__, words), np.int64, len(words))  # may extend the rows
    return table.rows[slots]


@cache
def language_table(buckets: int) -> np.ndarray:
    """Bucket -> 1 + index of the language that its function word belongs to, or 0."""
    table = WordBuckets(buckets)
    found = np.zeros(buckets, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            found[word_ids(w.encode(), table)[0, 0]] = i + 1
    return found


@dataclass
class Model:
    spec: ToxicSpec
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts) - self.thresholds[languages(texts, language_table(self.spec.buckets))], -60, 60)))

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        found = np.empty(len(texts))
        start = 0
        while start < len(texts):  # blocks of about 2**17 words, so that responses stay in cache
            stop, words = start, 0
            while stop < len(texts) and (stop == start or words + len(texts[stop]) < 1 << 17):
                words += len(texts[stop])
                stop += 1
            pooled = np.maximum(pool(texts[start:stop], self.tables, self.spec) + self.bias, 0)
            found[start:stop] = pooled @ self.out + self.out_bias
            start = stop
        return found


def _layout(texts: list[np.ndarray], spec: ToxicSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with padding after each; first position and end of each text (one position at least)."""
    pad = max(spec.widths)
    sizes = np.array([max(1, len(t)) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + pad)[:-1]))
    ids = np.zeros((int((sizes + pad).sum()), PARTS), np.int32)
    for s, t in zip(starts, texts, strict=True):
        ids[s : s + len(t)] = t
    return ids, starts, starts + sizes


def responses(ids: np.ndarray, tables: list[np.ndarray], spec: ToxicSpec) -> np.ndarray:
    """Filter responses at each position; tables[j] has the columns of all filters wider than j."""
    found = tables[0][ids[:, 0]]
    for part in range(1, PARTS):
        found += tables[0][ids[:, part]]
    for j in range(1, len(tables)):
        first = found.shape[1] - tables[j].shape[1]
        for part in range(PARTS):
            found[: len(ids) - j, first:] += tables[j][ids[j:, part]]
    return found


def pool(texts: list[np.ndarray], tables: list[np.ndarray], spec: ToxicSpec) -> np.ndarray:
    ids, starts, ends = _layout(texts, spec)
    bounds = np.stack([starts, ends], 1).ravel()
    return np.maximum.reduceat(responses(ids, tables, spec), bounds, axis=0)[::2]


def languages(texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text; the last one if no function word occurs."""
    found = np.full(len(texts), len(FUNCTION_WORDS), np.int64)
    for i, t in enumerate(texts):
        counts = np.bincount(table[t[:, 0]], minlength=len(FUNCTION_WORDS) + 1)[1:]
        if counts.any():
            found[i] = counts.argmax()
    return found


def _offset_tables(embed: np.ndarray, kernels: list[np.ndarray], spec: ToxicSpec) -> list[np.ndarray]:
    """kernels: for each width an array (width, dim, filters)."""
    return [np.concatenate([embed @ k[j] for w, k in zip(spec.widths, kernels, strict=True) if w > j], 1) for j in range(max(spec.widths))]


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * grad * grad
        up = self.m[rows] / (1 - 0.9**self.t) / (np.sqrt(self.v[rows] / (1 - 0.999**self.t)) + 1e-6)
        x[rows] -= self.rate * up


def train(texts: list[np.ndarray], labels: np.ndarray, spec: ToxicSpec) -> Model:
    """Fits on four fifths of the rows, stops and calibrates on the rest."""
    rng = np.random.default_rng(spec.seed)
    order = rng.permutation(len(texts))
    hold, fit = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (spec.buckets, spec.dim)).astype(np.float32)
    embed[0] = 0
    kernels = [rng.normal(0, 0.3, (w, spec.dim, spec.filters)).astype(np.float32) for w in spec.widths]
    n_out = spec.filters * len(spec.widths)
    bias, out, out_bias = np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), np.zeros(1, np.float32)
    params = [embed, *kernels, bias, out, out_bias]
    adam = [_Adam(p.shape, spec.rate) for p in params]
    best, kept, bad = np.inf, None, 0
    held = [texts[i] for i in hold]
    queue = np.empty(0, np.int64)
    for _ in range(spec.checks):
        for _ in range(spec.updates // spec.checks):
            if len(queue) < spec.batch:
                queue = np.concatenate([queue, rng.permutation(fit)])
            rows, queue = queue[: spec.batch], queue[spec.batch :]
            batch = [np.where(rng.random((len(texts[i]), 1)) < spec.word_drop, 0, texts[i]).astype(np.int32) for i in rows]
            _update(batch, labels[rows].astype(np.float32), params, adam, spec)
        model = _model(params, spec)
        z = model.logits(held)
        loss = float(np.mean(np.logaddexp(0, z) - labels[hold] * z))
        if loss < best - 1e-4:
            best, kept, bad = loss, [p.copy() for p in params], 0
        else:
            bad += 1
            if bad >= spec.patience:
                break
    model = _model(kept or params, spec)
    model.thresholds = _calibrate(model.logits(held), labels[hold], languages(held, language_table(spec.buckets)))
    return model


def _model(params: list[np.ndarray], spec: ToxicSpec) -> Model:
    embed, *kernels, bias, out, out_bias = params
    return Model(spec, _offset_tables(embed, kernels, spec), bias, out.astype(np.float64), float(out_bias[0]), np.zeros(len(LANGUAGES)))


def _update(batch: list[np.ndarray], y: np.ndarray, params: list[np.ndarray], adam: list[_Adam], spec: ToxicSpec) -> None:
    embed, *kernels, bias, out, out_bias = params
    ids, starts, ends = _layout(batch, spec)
    used, local = np.unique(ids, return_inverse=True)
    found = responses(local.reshape(ids.shape), _offset_tables(embed[used], kernels, spec), spec)
    where = np.stack([s + found[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
    raw = np.take_along_axis(found, where, 0) + bias
    pooled = np.maximum(raw, 0)
    z = pooled @ out + out_bias[0]
    g = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
    back = g[:, None] * out * (raw > 0)
    grads: list = [None] * len(params)
    touched, amounts = [], []
    column = 0
    for i, (w, k) in enumerate(zip(spec.widths, kernels, strict=True)):
        amount, at = back[:, column : column + spec.filters], where[:, column : column + spec.filters]
        column += spec.filters
        dk = np.zeros_like(k)
        for j in range(w):
            near = ids[at + j]  # text, filter, part
            dk[j] = np.einsum("bf,bfd->df", amount, embed[near].sum(2))
            touched.append(near.reshape(-1, PARTS).T.ravel())
            amounts.append(np.tile((amount[:, :, None] * k[j].T[None]).reshape(-1, spec.dim), (PARTS, 1)))
        grads[1 + i] = dk
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(rows), spec.dim), np.float32)
    np.add.at(total, inverse, np.concatenate(amounts))
    live = rows > 0
    grads[-3], grads[-2], grads[-1] = back.sum(0), pooled.T @ g, np.array([g.sum()], np.float32)
    adam[0].step(embed, total[live] + 1e-4 * embed[rows[live]], rows[live])
    for p, a, d in zip(params[1:], adam[1:], grads[1:], strict=True):
        a.step(p, d)


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Logit in the widest gap around the cut with the highest F1."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    i = int(f1.argmax())
    return float((z[order[i]] + (z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 2)) / 2)


def _calibrate(z: np.ndarray, y: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Threshold of each language; languages with few held labels of a kind use that of all rows."""
    whole = _best_cut(z, y) if 0 < y.sum() < len(y) else 0.0
    found = np.full(len(LANGUAGES), whole)
    for i in range(len(LANGUAGES)):
        own = langs == i
        if min(y[own].sum(), (1 - y[own]).sum()) >= 25:
            found[i] = _best_cut(z[own], y[own])
    return found


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, spec: ToxicSpec | None = None) -> Model | None:
    """Trains on a bounded sample of labelled rows; None without labels of both kinds."""
    spec = spec or ToxicSpec()
    ship(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordBuckets(spec.buckets)
        for b in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array([word_ids(t.as_py(), table).ravel() for t in b.column(2)], pa.int32())], names=["doc_id", "y", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("n", word_count(F.col("text")))
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "n", F.xxhash64("text")))  # a few thousand rows
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= spec.most_words)
    rows = rows.select("doc_id", "y", utf8(F.col("text"))).mapInArrow(ids, f"doc_id {kind}, y int, ids array<int>").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows["y"].to_numpy()
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return None
    return train([x.values.to_numpy().astype(np.int32).reshape(-1, PARTS) for x in rows["ids"]], y, spec)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row of ``docs``; one pass, no shuffle."""
    if model is None:
        return docs.select(key, held_out(key).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = WordBuckets(m.spec.buckets)
        for b in slices(batches, 2):  # few ids at a time
            s = m.scores([word_ids(t.as_py(), table) for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), utf8(F.col(text)))
    return rows.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")
