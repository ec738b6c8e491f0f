"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one space for every run of anything else.
Each language's model gives a letter's probability after up to ``ORDER - 1``
others, discounted and interpolated with the next shorter context, whose counts
are those of distinct left neighbours. All models share sorted arrays of hashed
n-grams, with one column of log probabilities a language; an array is searched
from a directory over the high bits of the hash. The language of the least
cross-entropy a letter wins. It is accepted if that cross-entropy lies within what
texts of the language show that its model was not fitted on (mean and ``SPREAD``
deviations of every ``CALIBRATE``-th sampled one).

Fitting uses at most ``SAMPLE`` segments of each language, the least by a hash; a
segment is ``SEGMENT`` characters of a text, a shorter text is one segment, so any
part of a text of any length may be drawn. More than ``LANGUAGES`` labels are an
error: models hold a column for each. Scoring reads whole texts in pieces of
``PIECE`` bytes, each with the letters before it that its n-grams reach back to, so
memory is that of a batch of texts and a piece.

Cases: a text that is null or has no letter is ``und`` with score 0; letters never
seen get the share of unseen ones; without labelled documents every text is
``und``; one learned language gets score 1; ties go to the language first by name;
equal rows get equal results; a very long text is scored like any other; null ids
are allowed (not held out); null labels are left out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_bytes, byte_slices, row_key, tidy
from textloom.llm.quality import held_out

ORDER = 4
SAMPLE = 1000
SEGMENT = 1 << 14
CALIBRATE = 5
LANGUAGES = 64
PIECE = 1 << 18
SPREAD = 4.0
UNKNOWN = "und"
_BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: 0 if no letter, else the lower-case code point."""
    if not _TABLES:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(s := chr(c))[0] == "L":
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(t)
    return _TABLES[0]


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start of each text, letters of each text): a text is a space, its words with a space after each."""
    raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bound = begins[off] if len(data) else np.zeros(len(off), np.int64)
    low = _letters()[raw]
    n = np.concatenate([[0], np.cumsum(low != 0)])
    count = n[bound[1:]] - n[bound[:-1]]
    low = np.where(low == 0, 0x20, low)
    # a space before each text and one after it; then runs of spaces shrink to one
    m = len(off) - 1
    low = np.insert(low, np.repeat(bound, 2)[1:-1], 0x20) if m else low
    start = bound[:-1] + 2 * np.arange(m)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], place[start], count


def hashes(cps: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` letters that end at each place (places before the n-th hold none)."""
    h = np.zeros(len(cps), np.uint64)
    x = cps.astype(np.uint64)
    for j in range(n - 1, -1, -1):
        h[n - 1 :] = (h[n - 1 :] ^ x[n - 1 - j : len(x) - j]) * _MIX
        h[n - 1 :] ^= h[n - 1 :] >> np.uint64(29)
    return h


class SortedHashes:
    """Sorted 64-bit hashes, with where each range of high bits begins."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        edges = np.arange(1 << _BITS, dtype=np.uint64) << np.uint64(64 - _BITS)
        self.first = np.searchsorted(keys, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 where absent."""
        at = self.first[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        got = self.keys[at]
        left = np.flatnonzero(got < h)
        while len(left):
            at[left] += 1
            got[left] = self.keys[at[left]]
            left = left[got[left] < h[left]]
        at[got != h] = -1
        return at


class Models:
    def __init__(self, names: list[str], order: int = ORDER) -> None:
        self.names, self.order = names, order

    def fit(self, texts: list[tuple[str, bytes]]) -> None:
        """``texts``: (language, UTF-8)."""
        own = []
        for name in self.names:
            mine = [t for x, t in texts if x == name]
            data = np.frombuffer(b"".join(mine), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(t) for t in mine])]).astype(np.int64)
            own.append(self.counts(*letters(data, off)[:2]))
        side = len(self.names)
        alphabet = len(set().union(*[set(c[0][1].tolist()) for c in own])) + 1
        # order 1 upwards: union of n-grams; a log probability for each language
        self.grams, self.logp, self.context, self.weight = [], [], [], []
        for n in range(1, self.order + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in own]))
            prob = np.zeros((len(keys), side))
            shorter = np.zeros((len(keys), side))
            ctx_of, low_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for c in own:
                at = np.searchsorted(keys, c[n - 1][0])
                ctx_of[at], low_of[at] = c[n - 1][3], c[n - 1][4]
            ctx = np.unique(ctx_of)
            weight = np.ones((len(ctx), side))
            if n == 1:
                shorter[:] = 1 / alphabet
            else:
                at = self.grams[-1].find(low_of)
                # the shorter n-gram of a seen one was seen by some language
                shorter = np.exp(self.logp[-1][at].astype(np.float64))
            place = np.searchsorted(ctx, ctx_of)
            for k, c in enumerate(own):
                h, _, count, own_ctx, _ = c[n - 1]
                at = np.searchsorted(ctx, own_ctx)
                total, kinds = np.bincount(at, count, len(ctx)), np.bincount(at, minlength=len(ctx))
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = ones / (ones + 2 * twos) if ones else 0.5
                seen = total > 0
                weight[seen, k] = np.minimum(d * kinds[seen] / total[seen], 1.0)
                mine = np.zeros(len(keys))
                mine[np.searchsorted(keys, h)] = count - d
                denom = np.where(seen, total, 1)[place]
                prob[:, k] = np.maximum(mine, 0) / denom + weight[place, k] * shorter[:, k]
            self.grams.append(SortedHashes(keys))
            self.logp.append(np.log(prob).astype(np.float32))
            self.context.append(SortedHashes(ctx))
            self.weight.append(np.log(np.maximum(weight, 1e-9)).astype(np.float32))
        self.floor = np.full(side, -np.log(alphabet), np.float32)
        self.limit = np.full(side, np.inf)

    def calibrate(self, texts: list[tuple[str, bytes]]) -> None:
        """Limits of acceptance: what texts of a language, none of them fitted on, cost a letter."""
        for k, name in enumerate(self.names):
            mine = [t for x, t in texts if x == name]
            data = np.frombuffer(b"".join(mine), np.uint8)
            h, n, _ = self.entropy(data, np.concatenate([[0], np.cumsum([len(t) for t in mine])]).astype(np.int64))
            x = h[n > 0, k]
            if len(x):
                self.limit[k] = x.mean() + SPREAD * (x.std() + 0.05)

    def counts(self, cps: np.ndarray, start: np.ndarray) -> list[tuple]:
        """For each n: (hash, last letter, count, hash of the context, hash without the first letter) of its n-grams.

        The longest are counted as they stand, shorter ones by distinct letters before them.
        """
        place = np.arange(len(cps)) - np.repeat(start, np.diff(np.append(start, len(cps))))
        out = []
        all_h = [np.zeros(len(cps), np.uint64)] + [hashes(cps, n) for n in range(1, self.order + 2)]
        for n in range(1, self.order + 1):
            ends = np.flatnonzero(place >= n)  # the n-gram and a letter before it lie inside the text
            h = all_h[n][ends]
            key, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            if n < self.order and len(ends):
                # each longer n-gram once, at the shorter one that it ends with
                _, once = np.unique(all_h[n + 1][ends], return_index=True)
                count = np.bincount(inverse[once], minlength=len(key))
            at = ends[first]
            ctx = all_h[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            out.append((key, cps[at], count.astype(np.float64), ctx, all_h[n - 1][at]))
        return out

    def entropy(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy a place for each language, places, letters) of each text."""
        m = len(off) - 1
        cost, places, count = np.zeros((m, len(self.names))), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i, j in byte_slices(off, PIECE):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if len(part) > PIECE:  # one long text
                cost[i], places[i], count[i] = self.long_text(part)
                continue
            cps, start, count[i:j] = letters(part, at)
            total = self.costs(cps, np.arange(len(cps)) - np.repeat(start, np.diff(np.append(start, len(cps)))))
            n = np.diff(np.append(start, len(cps)))
            has = np.flatnonzero(n > 0)
            if len(has):
                cost[i + has] = np.add.reduceat(total, start[has], axis=0, dtype=np.float64)
            places[i:j] = np.maximum(n - 1, 0)
        return -cost / np.maximum(places, 1)[:, None], np.where(count > 0, places, 0), count

    def long_text(self, data: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(sum of log probabilities, places, letters) of one text, read in pieces."""
        cost, count, at = np.zeros(len(self.names)), 0, 0
        tail, size = np.array([0x20], np.uint32), 1  # the space before the text
        while at < len(data):
            to = min(at + PIECE, len(data))
            while to < len(data) and data[to] & 0xC0 == 0x80:  # whole code points
                to += 1
            low = _letters()[np.frombuffer(data[at:to].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
            count += int((low != 0).sum())
            low[low == 0] = 0x20
            if to == len(data):
                low = np.append(low, np.uint32(0x20))
            cps = low[(low != 0x20) | (np.append(tail[-1], low[:-1]) != 0x20)]
            own = np.concatenate([tail, cps])
            total = self.costs(own, np.arange(len(own)) + size - len(tail), skip=len(tail))
            cost += total[len(tail) :].sum(0, dtype=np.float64)
            tail, size, at = own[-self.order :], size + len(cps), to
        return cost, size - 1, count

    def costs(self, cps: np.ndarray, place: np.ndarray, skip: int = 0) -> np.ndarray:
        """Log probability of each letter, of each language; ``place``: its place in its text; none for place 0 and the first ``skip``."""
        total = np.zeros((len(cps), len(self.names)), np.float32)
        left = skip + np.flatnonzero(place[skip:] >= 1)
        for n in range(self.order, 0, -1):
            if not len(left):
                break
            here = left[place[left] >= n] if n > 1 else left
            late = left[place[left] < n] if n > 1 else left[:0]
            h = hashes(cps, n)
            at = self.grams[n - 1].find(h[here])
            hit = at >= 0
            total[here[hit]] += self.logp[n - 1][at[hit]]
            miss = here[~hit]
            if n == 1:
                total[miss] += self.floor
                left = left[:0]
            else:
                c = self.context[n - 1].find(hashes(cps, n - 1)[miss - 1])
                total[miss[c >= 0]] += self.weight[n - 1][c[c >= 0]]
                left = np.concatenate([miss, late])
        return total

    def predict(self, data: np.ndarray, off: np.ndarray):
        """(language number or -1, score, cross-entropy, accepted) of each text."""
        m = len(off) - 1
        if not self.names:
            return np.full(m, -1), np.zeros(m), np.zeros(m), np.zeros(m, bool)
        h, places, count = self.entropy(data, off)
        best = h.argmin(1) if len(h) else np.zeros(0, np.int64)
        least = h[np.arange(len(h)), best]
        # posterior of the winner, as if a long text had 64 letters at most
        score = 1 / np.exp((least[:, None] - h) * np.minimum(places, 64)[:, None]).sum(1) if len(h) else np.zeros(0)
        none = count == 0
        return np.where(none, -1, best), np.where(none, 0, score), least, ~none & (least <= self.limit[best])


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, order: int = ORDER) -> Models:
    """Models of the languages that ``lang_col`` names, outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_t")).filter(F.col("_lang").isNotNull() & ~held_out(F.col("_id"), 4, 2))
    labels = rows.groupBy("_lang").count().select("_lang")  # those of null texts too
    rows = rows.filter(F.col("_t").isNotNull())
    # segments of texts by a hash; how many there are says which hashes to take, so that no language is ranked in one task
    parts = rows.select("_lang", "_t", *row_key(F.col("_id"), F.col("_t")), F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("_t") - 1, F.lit(0)), F.lit(SEGMENT))).alias("_at"))
    parts = parts.withColumn("_h", F.xxhash64("k1", "k2", "_at"))
    sizes = labels.join(parts.groupBy("_lang").count(), "_lang", "left").orderBy("_lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} labels")
    names = [r["_lang"] for r in sizes]
    models = Models(names, order)
    if not names:
        return models
    share = {r["_lang"]: min(1.0, (sample + 6 * sample**0.5 + 36) / max(r["count"] or 0, 1)) for r in sizes}
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, min(int((2 * v - 1) * 2**63), 2**63 - 1))]), F.col("_lang"))
    pick = parts.filter(F.col("_h") <= most).select("_lang", "_h", "k1", "k2", "_at", F.substring("_t", F.col("_at") + 1, F.lit(SEGMENT)).cast("binary").alias("t"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "k1", "k2", "_at"))
    got = pick.dropDuplicates(["_lang", "k1", "k2", "_at"]).withColumn("r", first).filter(F.col("r") <= sample).select("_lang", "r", "t").collect()  # LANGUAGES x sample segments at most
    texts = sorted((r["_lang"], bytes(r["t"]), r["r"]) for r in got)
    kept = [(x, t) for x, t, r in texts if r % CALIBRATE == 0]
    models.fit([(x, t) for x, t, r in texts if r % CALIBRATE])
    models.calibrate(kept)
    return models


def _predict(share):
    def run(batches):
        import pyarrow as pa

        m = share.value
        names = [*m.names, UNKNOWN]
        for batch in batches:
            data, off = arrow_bytes(batch.column(1))
            got = [m.predict(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in byte_slices(off, 1 << 19)]
            best, score, cost, ok = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
            lang = pa.array([names[i] for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(score), pa.array(cost), pa.array(ok)], names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return tidy(run)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy (nats a letter), accepted (within the language's usual range)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    share = docs.sparkSession.sparkContext.broadcast(models)
    return rows.mapInArrow(_predict(share), f"doc_id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean")
