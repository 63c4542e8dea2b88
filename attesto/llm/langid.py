"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; a one-hot byte
times a filter is a table lookup, so a filter of width w is a sum of w lookups. The
maximum over a window, a rectifier and a softmax layer follow. Training is numpy with
Adam on a bounded sample of labelled texts; as only each filter's maximum has a gradient,
a backward step touches w bytes a filter. Prediction scans whole texts in windows without
overlap and averages their probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, in_arrow, small, utf8, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled texts of each language, and windows of each text, that training takes at most; languages at most, more are an error.
SAMPLE, SAMPLE_WINDOWS, LANGUAGES = 400, 4, 1000
EPOCHS, BATCH, RATE = 10, 64, 0.01

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def as_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes, zero at the end of a text, and the text of each window."""
    counts = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    for i in np.flatnonzero(counts):
        at = first[i] * WINDOW
        out[at : at + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(counts)), counts)


class ByteNet:
    """Parameters: for each width w a (w, 256, FILTERS) table and biases; a dense layer."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = (rng.standard_normal((len(self.bias), len(languages))) * 0.1).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.shift]

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of labelled windows, and its gradient by each parameter."""
        n = len(x)
        peaks, tops = [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            active = sum(table[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            peaks.append(active.argmax(1))
            tops.append(np.take_along_axis(active, peaks[-1][:, None], 1)[:, 0])
        top = np.concatenate(tops, 1) + self.bias
        hidden = np.maximum(top, 0)
        error = self._softmax(hidden @ self.dense + self.shift)
        loss = float(-np.log(np.maximum(error[np.arange(n), y], 1e-30)).mean())
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ self.dense.T) * (top > 0)
        grads = []
        for k, (w, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(table)
            for j in range(w):
                seen = np.take_along_axis(x, peaks[k] + j, 1).astype(np.int64)
                flat = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), own.ravel(), 256 * FILTERS)
                grad[j] = flat.reshape(256, FILTERS)
            grads.append(grad)
        return loss, [*grads, back.sum(0), hidden.T @ error, error.sum(0)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 12) -> ByteNet:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        params = self._parameters()
        means, squares = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), BATCH):
                part = order[start : start + BATCH]
                _, grads = self.gradients(windows[part], labels[part])
                step += 1
                for p, g, m, v in zip(params, grads, means, squares, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, windows: np.ndarray, block: int = 32) -> np.ndarray:
        """Probabilities of each window.

        Pairs of bytes are looked up at once, and a row of a table is one item of its size,
        so a lookup is a copy. Blocks are small enough to stay in a core's cache.
        """
        if not hasattr(self, "_rows"):
            item = lambda t: np.ascontiguousarray(t).view(f"V{4 * FILTERS}").ravel()
            pair = lambda t, i: item((t[i][:, None] + t[i + 1][None]).reshape(65536, FILTERS))
            self._rows = [(pair(t, 0), None if w == 2 else item(t[2]) if w == 3 else pair(t, 2)) for w, t in zip(WIDTHS, self.tables, strict=True)]
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), block):
            x = windows[a : a + block]
            pairs = (x[:, :-1].astype(np.int64) << 8) | x[:, 1:]
            tops = []
            for w, (head, rest) in zip(WIDTHS, self._rows, strict=True):
                n = WINDOW - w + 1
                active = np.take(head, pairs[:, :n], mode="clip").view(np.float32).reshape(len(x), n, FILTERS)
                if rest is not None:
                    active += np.take(rest, x[:, 2:] if w == 3 else pairs[:, 2:], mode="clip").view(np.float32).reshape(len(x), n, FILTERS)
                tops.append(active.max(1))
            out[a : a + block] = self._softmax(np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.dense + self.shift)
        return out


def _least_hashes(ids: DataFrame, n: int) -> DataFrame:
    """Each label's rows (label, h) whose hashes may be among its n least: two histograms of 256 buckets a label cut the rest off."""
    for shift in (56, 48):
        buckets = ids.withColumn("bucket", F.shiftrightunsigned("h", shift))
        before = F.sum("count").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        cuts = buckets.groupBy("label", "bucket").count().withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n)
        cuts = written(cuts.groupBy(F.col("label").alias("l")).agg(F.max("bucket").alias("cut")))
        ids = buckets.join(small(cuts, LANGUAGES), F.col("label") == F.col("l")).where("bucket <= cut").drop("l", "cut", "bucket")
    return ids.select("label", "h")


def learn(docs: DataFrame, label_col: str = "lang", seed: int = 5) -> ByteNet | None:
    """A network fitted to at most SAMPLE texts of each label, those of the ids with the least hashes.

    None without any labelled text. Rows without an id are not learned from; of rows that
    share id and label one text is taken, that of the least pieces, so what comes to the
    driver is bounded by labels, SAMPLE and windows, whatever repeats.
    """
    docs = docs.select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col(label_col).alias("label"), "text", "doc_id").where("label is not null and doc_id is not null")
    near = _least_hashes(docs.select("label", "h").distinct(), SAMPLE)
    order = Window.partitionBy("label").orderBy("h")
    chosen = written(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).select("label", "h"))
    if chosen.select("label").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    rows = docs.join(small(chosen, LANGUAGES * SAMPLE), ["label", "h"]).select("label", "h", F.encode("text", "utf-8").alias("text")).where("length(text) > 0")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring("text", (F.floor(F.greatest(F.length("text") - WINDOW, F.lit(0)) * i / (SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)))
    rows = rows.select("label", "h", F.array_distinct(pieces).alias("p")).groupBy("label", "h").agg(F.min("p").alias("p"))
    found = sorted({(r.label, r.h, i, bytes(p)) for r in rows.toLocalIterator() for i, p in enumerate(r.p)})
    if not found:
        return None
    languages = sorted({x[0] for x in found})
    windows = np.stack([np.frombuffer(x[3].ljust(WINDOW, b"\0"), np.uint8) for x in found])
    return ByteNet(languages).fit(windows, np.array([languages.index(x[0]) for x in found]))


def _predict(net: ByteNet | None, names: tuple[str, str] = ("__lang", "__score"), keep_text: bool = False):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rest = batch if keep_text else batch.drop_columns(["text"])
            for a, b in blocks(offsets):
                own, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                letters = np.concatenate(([0], np.cumsum(_LETTER[part])))
                has = letters[own[1:]] > letters[own[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in part[own[i] : own[i + 1]].tobytes().decode("utf-8", "ignore"))
                label, score = np.full(b - a, "und", object), np.zeros(b - a)
                if net is not None and has.any():
                    windows, doc = as_windows(part, own)
                    total = np.zeros((b - a, len(net.languages)))
                    p = net.predict(windows)
                    for k in range(len(net.languages)):
                        total[:, k] = np.bincount(doc, p[:, k], b - a)
                    total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
                    best = total.argmax(1)
                    label[has] = np.array(net.languages, object)[best[has]]
                    score[has] = total[np.arange(b - a), best][has]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in rest.columns), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))], [*rest.schema.names, *names])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; such texts are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Only the text is an input of the prediction. lang_pred is und with score 0 if the
    text is null, empty or has no letter, or if nothing could be learned. Texts are read
    whole. Of languages with equal scores the first by name is taken. Repeated rows, null
    ids and other columns are no matter.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return in_arrow(rows, _predict(net, ("lang_pred", "score")), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, net: ByteNet | None, least: float = 0.0) -> DataFrame:
    """docs' rows whose language is recognised, not und, with a score of least or more; a null lang becomes the predicted one.

    A lang that is given is never overruled. With least 0 only und goes: null and empty
    texts, and those without a letter. An empty table stays empty.
    """
    lang, score = "__lang", "__score"
    while lang in docs.columns or score in docs.columns:
        lang, score = f"_{lang}", f"_{score}"
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), docs.schema["text"], T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    rows = in_arrow(docs.select(*names, "text"), _predict(net, (lang, score), keep_text=True), schema).where((F.col(lang) != "und") & (F.col(score) >= least))
    return rows.select(*(F.coalesce(c, lang).alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def language_id(docs: DataFrame, label_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("lang"), "text")
    return identify(docs, learn(docs.where(~held_out()), "lang"))
