"""Token counts through a compiled deterministic transducer.

A piece vocabulary with merge scores is compiled into a transducer over code
points. A state holds, for every place from which an unfinished piece may still
run on, the text since then, the part of the token before it that might still join, and
the count there; a
transition reads one code point and is annotated with the change in the number
of tokens. States and transitions are compiled when first met and kept in an open
hash table of bounded size.

Texts are cut into chunks, and a chunk's map takes the state before it to the
state after it and a count. Maps compose by a prefix scan: what one chunk ends in,
the next begins with. Of a map, the entries that the scan asks for are made:
thousands of chunks step through the transducer at once, each from one state; where
the scan meets a state that a map has no entry for, it goes on with the chunk's last
end as a guess, and all such entries are made in the next turn (states soon forget
what came before, so few turns are needed; a text of one repeated letter needs as
many as the letter's longest piece has letters). A boundary between two code points
that stand side by side in no piece resets the transducer: the map of a chunk that
begins there is constant, and nothing has to be asked again. Chunks begin at such
boundaries where a stretch has one, else anywhere.

The recurrence behind a state: the last token of a text is the one piece t with
a boundary before it such that the token before t and t stay apart when merged
by themselves.

Cases: a null or empty text has no tokens and no bytes; a code point outside the
vocabulary counts one token for each UTF-8 byte; equal rows are each counted;
a very long text, with or without boundaries, is many chunks; a table that fills
starts anew with the states in use, at any step; null ids are allowed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_bytes, byte_slices, tidy

#: Slots of the transition table (13 bytes each); it starts anew beyond a load of 0.6.
TABLE_BITS = 22
CHUNK = 512
#: States held before the table starts anew.
MAX_STATES = 200_000
#: Entries that a map gets at once when single ones don't settle the scan.
WHOLE_MAP = 64
NEVER = 1 << 30
SPACE = 0x2581
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Counts tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # code points that take part in pieces of several letters get classes; the others never join
        letters = sorted({c for p in self.pairs for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.side = len(letters) + 1
        self.joins = np.zeros((self.side, self.side), bool)
        for p in self.pairs:
            self.joins[self.kind[ord(p[0])], self.kind[ord(p[1])]] = True
        self.joins = self.joins.ravel()
        self.rank = {p: i for i, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))}
        #: least rank of the pieces that go on beyond a prefix
        self.beyond: dict[str, int] = {}
        for p, r in self.rank.items():
            for n in range(len(p)):
                self.beyond[p[:n]] = min(r, self.beyond.get(p[:n], NEVER))
        self.bits = TABLE_BITS
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.out = np.zeros(1 << self.bits, np.int8)
        self.load = 0
        self.edges: dict[str, tuple] = {}
        self.edge_left: dict[tuple, tuple] = {}
        self.states = [(("", (), 0),)]
        self.number = {self.states[0]: 0}
        self.kept = 1

    def spines(self, token: str) -> tuple[tuple, tuple]:
        """The pieces at the left and at the right edge while ``token`` is merged by itself.

        Each as (piece, rank from which it stands, rank at which it is taken up
        into a larger one). Merging goes by rank, leftmost first among equals.
        """
        if (got := self.edges.get(token)) is not None:
            return got
        parts, now = list(token), -1
        left, right = [[parts[0], -1, NEVER]], [[parts[-1], -1, NEVER]]
        while len(parts) > 1:
            now_rank, i = min((self.rank.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if now_rank == NEVER:
                break
            now = max(now, now_rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left[-1][2] = now
                left.append([parts[0], now, NEVER])
            if i == len(parts) - 1:
                right[-1][2] = now
                right.append([parts[-1], now, NEVER])
        whole = len(parts) == 1  # else no text is ever merged into this piece
        got = self.edges[token] = (tuple(map(tuple, left)) if whole else None, tuple(map(tuple, right)))
        return got

    def fits(self, before: tuple, token: str) -> bool:
        """Whether ``token`` stays apart from the token before it, given as the right edge that still matters."""
        left = self.spines(token)[0]
        if left is None:
            return False
        for x, x_from, x_to in before:
            for y, y_from, y_to in left:
                r = self.rank.get(x + y)
                if r is not None and (at := max(r, x_from, y_from)) < x_to and at <= y_to:
                    return False
        return True

    def matters(self, before: tuple, s: str) -> tuple:
        """The part of a right edge that can join a token beginning with ``s``."""
        if not before:
            return before
        key = before, s
        if (got := self.edge_left.get(key)) is None:
            got = self.edge_left[key] = tuple(x for x in before if min([self.beyond.get(x[0] + s, NEVER), *(self.rank.get(x[0] + s[:k], NEVER) for k in range(1, len(s) + 1))]) < x[2])
        return got

    def compile(self, state: int, letter: str) -> tuple[int, int]:
        """The state after ``letter``, and the change in the number of tokens."""
        last, count, open_ = None, 0, []
        for prefix, before, n in self.states[state]:
            s = prefix + letter
            if (len(s) == 1 or s in self.score) and self.fits(before, s):
                last, count = s, n + (1 if s in self.score else len(letter.encode()))
            if s in self.prefixes:
                open_.append((s, before, n))
        new = tuple((s, self.matters(before, s), n - count) for s, before, n in open_) + (("", self.matters(self.spines(last)[1], ""), 0),)
        if (k := self.number.get(new)) is None:
            k = self.number[new] = len(self.states)
            self.states.append(new)
        return k, count

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of keys, or -1."""
        mask = (1 << self.bits) - 1
        slot = ((key * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[slot]
        if (got == key).all():
            return slot
        left = np.flatnonzero(got != key)
        while len(left):
            empty = self.keys[slot[left]] == 0
            slot[left[empty]] = -1
            left = left[~empty]
            slot[left] = (slot[left] + 1) & mask
            left = left[self.keys[slot[left]] != key[left]]
        return slot

    def learn(self, key: np.ndarray) -> None:
        for k in key.tolist():
            state, cp = (k >> 21) - 1, k & 0x1FFFFF
            after, delta = self.compile(state, chr(cp))
            slot = ((k * int(_MULT)) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.next[slot], self.out[slot] = k, after, delta
            self.load += 1

    def anew(self, used: np.ndarray) -> np.ndarray:
        """Start the table anew, with the states ``used`` alone; their new numbers."""
        old = self.states
        self.reset()
        live, back = np.unique(used, return_inverse=True)
        new = self.intern([old[k] for k in live.tolist()])[back]
        self.kept = len(self.states)
        return new

    def run(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token counts, states after, states before) of chunks that are read from the states ``before``.

        States are given and returned by number; a table that started anew on the
        way has given ``before`` new numbers.
        """
        order = np.argsort(start - end, kind="stable")
        at, size = start[order], (end - start)[order]
        total = np.zeros(len(at), np.int64)
        n_lanes = len(at)
        # states of the lanes, then those they began with
        state = np.concatenate([before[order], before]).astype(np.uint64)
        limit = int(0.6 * len(self.keys))
        steps = int(size[0]) if len(size) else 0
        # lanes still running at each step
        live = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
        for i in range(steps):
            n = live[i]
            key = ((state[:n] + np.uint64(1)) << np.uint64(21)) | cps[at[:n] + i]
            slot = self.find(key)
            if (slot < 0).any():
                new = np.unique(key[slot < 0])
                if self.load + len(new) > limit or len(self.states) > MAX_STATES + self.kept:
                    state = self.anew(state)
                    key = ((state[:n] + np.uint64(1)) << np.uint64(21)) | cps[at[:n] + i]
                    new = np.unique(key)
                self.learn(new)
                slot = self.find(key)
            state[:n] = self.next[slot]
            total[:n] += self.out[slot]
        out, after = np.empty(n_lanes, np.int64), np.empty(n_lanes, np.uint64)
        out[order], after[order] = total, state[:n_lanes]
        return out, after, state[n_lanes:]

    def scan(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """Token counts of chunks that follow one another; ``reset``: those with a constant map."""
        n = len(start)
        count, after = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        ask, before = np.arange(n), np.zeros(n, np.uint64)
        open_, turn = np.flatnonzero(~reset).tolist(), 0
        maps: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in open_}
        while len(ask):
            for part in range(0, len(ask), most := max(1, len(self.keys) // 8)):  # lanes that the table can hold
                here, known = ask[part : part + most], self.states
                got, ends, begun = self.run(cps, start[here], end[here], before[part : part + most])
                if self.states is not known:  # other numbers from now on
                    self.move(known, maps, after, before[part + most :])
                count[here], after[here] = got, ends
                for i, s, e, c in zip(here.tolist(), begun.tolist(), ends.tolist(), got.tolist(), strict=True):
                    if i in maps:
                        maps[i][s] = (e, c)
            turn += 1
            ask, before = [], []
            for i in open_:
                s = int(after[i - 1])
                if s in maps[i]:
                    after[i], count[i] = maps[i][s]
                else:
                    ask.append(i)
                    before.append(s)
            if ask and turn > 2:
                ends, often = np.unique(after[open_], return_counts=True)
                seen = {*ends[np.argsort(-often)[:WHOLE_MAP]].tolist(), *before}
                both = [(i, s) for i in open_ if i >= ask[0] for s in seen if s not in maps[i]]
                ask, before = map(list, zip(*both, strict=True))
            ask, before = np.array(ask, np.int64), np.array(before, np.uint64)
        return count

    def move(self, known: list[tuple], maps: dict, *numbers: np.ndarray) -> None:
        """Give states of the table before their numbers in this one."""
        used = np.unique(np.concatenate([*numbers, *([np.array([x for m in maps.values() for s, (e, _) in m.items() for x in (s, e)], np.uint64)])]))
        new = dict(zip(used.tolist(), self.intern([known[k] for k in used.tolist()]).tolist(), strict=True))
        for x in numbers:
            x[:] = [new[k] for k in x.tolist()]
        for i, m in maps.items():
            maps[i] = {new[s]: (new[e], c) for s, (e, c) in m.items()}

    def intern(self, states: list[tuple]) -> np.ndarray:
        """Numbers of states, new ones added."""
        out = np.zeros(len(states), np.uint64)
        for i, x in enumerate(states):
            if x not in self.number:
                self.number[x] = len(self.states)
                self.states.append(x)
            out[i] = self.number[x]
        return out

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of concatenated UTF-8 texts."""
        n = len(off) - 1
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # letters before each byte give text bounds in code points
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bound = begins[off] if len(data) else np.zeros(n + 1, np.int64)
        full = np.flatnonzero(bound[1:] > bound[:-1])
        out = np.zeros(n, np.int64)
        if not len(full):
            return out
        # a space marker goes before each text; spaces become markers
        cps = np.insert(cps, bound[full], SPACE)
        cps[cps == 0x20] = SPACE
        shift = np.arange(len(full))
        lo, hi = bound[full] + shift, bound[full + 1] + shift + 1
        kind = self.kind[cps].astype(np.int32)
        cut = np.ones(len(cps), bool)
        cut[1:] = ~self.joins[kind[:-1] * self.side + kind[1:]] | (kind[:-1] == 0) | (kind[1:] == 0)
        cut[lo] = True
        places = np.flatnonzero(cut)
        # the first boundary in each stretch of CHUNK letters, and every text's start
        chunk = places // CHUNK
        first = np.ones(len(places), bool)
        first[1:] = chunk[1:] != chunk[:-1]
        resets = np.union1d(places[first], lo)
        # stretches without a boundary are cut anywhere
        far = np.diff(np.append(resets, len(cps)))
        long = np.flatnonzero(far > 4 * CHUNK)
        more = [np.arange(a + CHUNK, a + n, CHUNK) for a, n in zip(resets[long].tolist(), far[long].tolist(), strict=True)]
        start = np.union1d(resets, np.concatenate(more)) if more else resets
        end = np.append(start[1:], len(cps))
        scan = np.concatenate([[0], np.cumsum(self.scan(cps, start, end, np.isin(start, resets)))])
        out[full] = scan[np.searchsorted(start, hi)] - scan[np.searchsorted(start, lo)]
        return out


_KEPT: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer a process for each model."""
    if path not in _KEPT:
        _KEPT[path] = Transducer(path)
    return _KEPT[path]


def _count(path: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = arrow_bytes(batch.column(1))
            t = transducer(path)
            n = [t.counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in byte_slices(off, 1 << 21)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return tidy(run)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_count(model_path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
