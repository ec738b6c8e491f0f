"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are read in chunks that overlap by a filter's width less
one, so that every window of the whole document lies in a chunk. Filters give a
value for each window; a chunk keeps each filter's largest; a document keeps the
mean and the largest over its chunks; a logistic layer makes one probability.

Training (Adam, gradients through the maxima) runs on the driver over at most
``SAMPLE`` segments of labelled documents, the least by a hash; a segment is
``SEGMENT`` bytes of a text, a shorter text is one segment, so every part of a
text of any length may be drawn and the driver holds ``SAMPLE`` x ``SEGMENT``
bytes at most. Scoring reads whole texts, some ``BLOCK`` chunks at a time: its
memory is that of a batch of texts and a constant.

Cases: null and empty texts are scored as a document of one zero byte; a very
long text is scored like any other, in constant memory beside the text itself;
labels that are null or of unknown documents are left out; without labels of both
kinds every score is the share of label 1 (0.5 without labels); equal rows get
equal scores; null ids are scored (not held out); an empty table gives an empty
result; columns of any name are ignored, or pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_bytes, byte_slices, release

WIDTH = 6
FILTERS = 16
CHUNK = 256
SAMPLE = 4000
SEGMENT = 1 << 14
#: Chunks whose windows are held at once.
BLOCK = 512


def pad(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero bytes after each, so that a window starts at each byte (one at least): (bytes, starts, windows)."""
    n = np.diff(off)
    windows = np.maximum(n, 1)
    start = np.concatenate([[0], np.cumsum(windows + WIDTH - 1)])
    out = np.zeros(start[-1], np.uint8)
    for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), start[:-1].tolist(), strict=True):
        out[at : at + b - a] = data[a:b]
    return out, start[:-1], windows


class Network:
    """filters: WIDTH x 256 x FILTERS (a filter's weight for each byte at each place)."""

    def __init__(self, seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        self.filters = np.zeros((WIDTH, 256, FILTERS), np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)
        self.shift = np.zeros(2 * FILTERS, np.float32)
        self.pairs = None

    def ready(self) -> None:
        """Tables for pairs of bytes: half as many look-ups."""
        self.pairs = [(self.filters[i][:, None, :] + self.filters[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, WIDTH, 2)]

    def convolve(self, buf: np.ndarray) -> np.ndarray:
        """The filters' values for each window start of ``buf`` (the last WIDTH - 1 excluded)."""
        n = len(buf) - WIDTH + 1
        if self.pairs is None:
            total = self.filters[0][buf[:n]]
            for j in range(1, WIDTH):
                total += self.filters[j][buf[j : n + j]]
            return total
        two = (buf[:-1].astype(np.int32) << 8) | buf[1:]
        total = np.take(self.pairs[0], two[:n], axis=0)
        for i in range(1, len(self.pairs)):
            total += np.take(self.pairs[i], two[2 * i : n + 2 * i], axis=0)
        return total

    def chunks(self, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, document) of each chunk."""
        per = -(-windows // CHUNK)
        doc = np.repeat(np.arange(len(start)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        first = start[doc] + k * CHUNK
        return first, np.minimum(first + CHUNK, (start + windows)[doc]), doc

    def features(self, buf, start, windows):
        value = self.convolve(buf)
        first, end, doc = self.chunks(start, windows)
        edges = np.stack([first, end], 1).ravel()
        # window starts between a document's end and the next document's start are not windows
        edges[-1:] = np.minimum(edges[-1:], len(value))
        tops = np.maximum.reduceat(value, edges[:-1], axis=0)[::2] if len(edges) else np.zeros((0, FILTERS), np.float32)
        begin = np.searchsorted(doc, np.arange(len(start)))
        n = np.bincount(doc, minlength=len(start))
        mean = np.add.reduceat(tops, begin, axis=0) / n[:, None]
        most = np.maximum.reduceat(tops, begin, axis=0)
        return value, (first, end, doc), tops, np.concatenate([mean, most], 1), n, begin

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; chunks of all texts go through the filters ``BLOCK`` at a time."""
        m = len(off) - 1
        if m < 1:
            return np.zeros(0)
        buf, start, windows = pad(data, off)
        first, end, doc = self.chunks(start, windows)
        total, most = np.zeros((m, FILTERS)), np.full((m, FILTERS), -np.inf, np.float32)
        for i in range(0, len(first), BLOCK):
            lo, hi, own = first[i : i + BLOCK], end[i : i + BLOCK], doc[i : i + BLOCK]
            value = self.convolve(buf[lo[0] : hi[-1] + WIDTH - 1])
            edges = np.stack([lo, hi], 1).ravel() - lo[0]
            tops = np.maximum.reduceat(value, edges[:-1], axis=0)[::2]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total[own[begin]] += np.add.reduceat(tops, begin, axis=0, dtype=np.float64)
            most[own[begin]] = np.maximum(most[own[begin]], np.maximum.reduceat(tops, begin, axis=0))
        mean = (total / np.bincount(doc, minlength=m)[:, None]).astype(np.float32)
        z = (np.concatenate([mean, most], 1) - self.shift) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def start_from(self, texts: list[bytes], label: np.ndarray) -> None:
        """Filters begin as snippets of documents, half of either label."""
        for f in range(FILTERS):
            mine = [t for t, y in zip(texts, label, strict=True) if y == f % 2 and len(t) >= 4 * WIDTH]
            if not mine:
                mine = [b"x" * 64]
            for _ in range(3):
                t = mine[self.rng.integers(len(mine))]
                at = int(self.rng.integers(len(t) - WIDTH))
                for j in range(WIDTH):
                    self.filters[j, t[at + j], f] += 0.3
        self.filters += self.rng.normal(0, 0.02, self.filters.shape).astype(np.float32)

    def fit(self, texts: list[bytes], label: np.ndarray, rounds: int = 8, batch: int = 48, rate: float = 0.02) -> None:
        share = float(label.mean()) if len(label) else 0.5
        if not len(label) or share in (0.0, 1.0):
            share = min(max(share, 1e-3), 1 - 1e-3)
            self.bias[0] = np.log(share / (1 - share))
            return
        self.start_from(texts, label)
        params = [self.filters, self.out, self.bias]
        self.out[:] = self.rng.normal(0, 0.1, 2 * FILTERS)
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        total_steps = rounds * (-(-len(texts) // batch))
        for turn in range(rounds):
            order = self.rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                data = np.frombuffer(b"".join(texts[k] for k in pick), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(texts[k]) for k in pick])])
                buf, start, windows = pad(data, off)
                value, (first, end, doc), tops, x, n, begin = self.features(buf, start, windows)
                if turn == 0 and i == 0:
                    self.shift[:] = x.mean(0)
                p = 1 / (1 + np.exp(-((x - self.shift) @ self.out + self.bias[0])))
                d = ((p - label[pick]) / len(pick)).astype(np.float32)
                grads = [np.zeros_like(self.filters), x.T @ d - self.shift * d.sum(), np.array([d.sum()], np.float32)]
                back = d[:, None] * self.out[None, :]
                into = back[doc, :FILTERS] / n[doc][:, None]
                into += np.where(tops == x[doc, FILTERS:], back[doc, FILTERS:], 0)
                # the first window that gave a chunk's largest value gets its gradient
                size = end - first
                chunk = np.repeat(np.arange(len(first)), size)
                at = np.arange(len(chunk)) + np.repeat(first - np.cumsum(size) + size, size)
                r, f = np.nonzero(value[at] == tops[chunk])
                _, k = np.unique(chunk[r] * FILTERS + f, return_index=True)
                at, f, weight = at[r[k]], f[k], into[chunk[r[k]], f[k]]
                for j in range(WIDTH):
                    grads[0][j] = np.bincount(buf[at + j].astype(np.int64) * FILTERS + f, weight, 256 * FILTERS).reshape(256, FILTERS)
                step += 1
                now = rate * (1 - 0.9 * step / total_steps)
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6) + now * 1e-3 * q * (q is self.filters)


def held_out(id_col: Column, mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``mod``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network:
    """A network fitted on at most ``sample`` segments of labelled documents outside the held-out fold."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().filter(~held_out(F.col("_id")))
    y = y.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).dropna()
    parts = text.join(F.broadcast(y), "_id").select("_id", "_y", "_t", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("_t") - 1, F.lit(0)).cast("int"), F.lit(SEGMENT))).alias("_at"))
    parts = parts.select("_id", "_y", "_at", F.substring("_t", F.col("_at") + 1, F.lit(SEGMENT)).alias("_t"))
    got = parts.orderBy(F.xxhash64("_id", "_at"), "_id", "_at", "_t", "_y").limit(sample).select("_t", "_y").collect()
    net = Network()
    net.fit([bytes(r["_t"]) for r in got], np.array([r["_y"] for r in got], np.float32))
    net.ready()
    return net


def score_column(share, text: Column) -> Column:
    """The score of ``text`` by a broadcast network. Only the text goes to Python; other columns stay where they are."""

    def scores(texts: pa.Array) -> pa.Array:
        data, off = arrow_bytes(texts)
        got = [share.value.score(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in byte_slices(off)]
        release()
        return pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    share = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), score_column(share, F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``."""
    share = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.filter(score_column(share, F.col(f"`{text_col}`")) >= threshold)
