"""SentencePiece sampling: forward filtering, backward sampling over the lattice.

A text gets one blank in front and is cut into segments: blanks with the word
that follows, or a line break. No piece of the vocabulary spans two segments,
and no segment is cut, however long. The lattice of a segment
has an arc for every vocabulary piece at every place, and an arc of the bytes
of a character that no piece holds. An arc weighs (rank + 2) ^ -alpha by its
rank in the vocabulary.

Forward filtering sums the weights of all paths to each place; backward
sampling walks from the end and draws the last arc by its share of that sum, so
a segmentation is drawn with exactly its share of all paths' weight. Draws are
hashes of (seed, row key, segment, step): the same row always gives the same
pieces, on any executor. Lattices are built once for each distinct segment that
a worker meets and all segments of a batch are walked together. A segment of
more than 64 characters is filtered and walked on its own, with the same
shares: each sum is kept as its ratio to the sum one place before, in a window
of the longest piece that is rescaled, and arcs are made a block at a time, so
memory grows by 8 bytes a character.

Decoding joins the pieces' bytes and drops the first blank, and gives the exact
text back.

Defined results: a null text has null ids and decodes to null; an empty text is
the pieces of one blank; equal rows have equal ids, equal texts with different
keys may differ; a null key counts as 0; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix


@dataclass(frozen=True)
class Params:
    model: str  # path of the SentencePiece model
    alpha: float = 1.0  # larger: closer to the pieces of lowest rank
    seed: int = 1
    remembered: int = 2_000_000  # lattice arcs that a worker keeps; beyond, those of the next batch (memory, not results)


#: Characters of a segment that is remembered; longer ones are walked on their own.
LONGEST = 64
#: Characters of a long segment whose arcs are held at once.
BLOCK = 1 << 14
_SEGMENT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_BLANK = "▁"
_EMPTY = -(1 << 31)  # no arc begins at a character
_WORKERS: dict[Params, "Lattices"] = {}


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(" " + text)


class Vocabulary:
    """Pieces as a trie in sorted arrays, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, int]] = {}
        rank = 0
        self.longest = 1
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surface = piece.replace(_BLANK, " ")
                self.bytes[i] = surface.encode()
                at = 0
                for c in surface:
                    at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
                ends[at] = (i, rank)
                self.longest = max(self.longest, len(surface))
                rank += 1
        self._hash(np.array([(a << 21) | c for a, c in nodes], np.int64), np.array(list(nodes.values()), np.int64))
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.rank = np.zeros(len(nodes) + 1)
        for node, (i, r) in ends.items():
            self.piece[node], self.rank[node] = i, r
        self.ranks = rank

    def _hash(self, keys: np.ndarray, following: np.ndarray) -> None:
        """Open addressing in a table with a quarter of its slots used."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of keys with one slot, the last one stays
            mine = free[self.keys[slot[free]] == keys[free]]
            self.next[slot[mine]] = following[mine]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie node after ``char``, or -1."""
        key = (node << 21) | char
        slot = self._slot(key)
        held = self.keys[slot]
        out = self.next[slot]
        other = np.flatnonzero(held != key)
        out[other] = -1
        other = other[held[other] >= 0]
        while len(other):
            slot = (slot[other] if len(slot) == len(key) else slot) + 1 & ((1 << self.bits) - 1)
            held = self.keys[slot]
            same = held == key[other]
            out[other[same]] = self.next[slot[same]]
            more = ~same & (held >= 0)
            other, slot = other[more], slot[more]
        return out


class Long:
    """Forward sums and one backward walk of a segment of any length."""

    def __init__(self, words: Vocabulary, alpha: float, segment: str) -> None:
        self.words, self.alpha = words, alpha
        self.char = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.ratio = array("d")  # sum of a place by the sum one place before
        window, k = [1.0], words.longest
        for a in range(0, len(self.char), BLOCK):
            first, size, _, weight = self.arcs(a, min(a + BLOCK, len(self.char)))
            for x, y in zip(first, first[1:]):
                total = sum([window[-n] * w for n, w in zip(size[x:y], weight[x:y])])
                self.ratio.append(total / window[-1])
                window.append(total)
                if len(window) > 4 * k or total < 1e-100:
                    window = [v / total for v in window[-k:]]

    def arcs(self, a: int, b: int) -> tuple[list, list, list, list]:
        """Of the places in (a, b]: where their arcs begin, and the arcs' sizes, kinds and weights."""
        v = self.words
        start = np.arange(max(0, a - v.longest + 1), b)
        node = np.zeros(len(start), np.int64)
        target, size, kind, weight = [], [], [], []

        def add(at, n, what, w):
            keep = at + n > a
            target.append(at[keep] + n)
            size.append(np.full(int(keep.sum()), n))
            kind.append(what[keep])
            weight.append(w[keep])

        bare = np.ones(b, bool)
        for n in range(1, v.longest + 1):
            node = v.step(node, self.char[start + n - 1])
            real = node >= 0
            start, node = start[real], node[real]
            full = v.piece[node] >= 0
            add(start[full], n, v.piece[node[full]], (v.rank[node[full]] + 2.0) ** -self.alpha)
            if n == 1:
                bare[start[full]] = False
            more = start + n < b
            start, node = start[more], node[more]
            if not len(start):
                break
        at = a + np.flatnonzero(bare[a:])
        add(at, 1, -1 - self.char[at], np.full(len(at), (v.ranks + 2.0) ** -self.alpha))
        target, size, kind, weight = (np.concatenate(x) for x in (target, size, kind, weight))
        order = np.lexsort((-size, target))
        first = np.searchsorted(target[order], np.arange(a + 1, b + 2))
        return first.tolist(), size[order].tolist(), kind[order].tolist(), weight[order].tolist()

    def walk(self, noise: np.uint64) -> np.ndarray:
        """The ids of a drawn path."""
        v, g, step = self.words, len(self.char), 0
        base, draws = g, []
        parts = []
        while g > 0:
            if g <= base:
                base = (g - 1) // BLOCK * BLOCK
                first, size, kind, weight = self.arcs(base, g)
            if step % BLOCK == 0:
                with np.errstate(over="ignore"):
                    drawn = mix(noise + np.arange(step, step + min(BLOCK, g), dtype=np.int64).view(U64))
                draws = ((drawn >> U64(11)).astype(np.float64) * 2.0**-53).tolist()
            x, y = first[g - base - 1], first[g - base]
            # Arcs are sorted by source; the last one takes what rounding leaves.
            back, n = 1.0, 0
            shares = []
            for k in range(y - 1, x - 1, -1):
                while n < size[k]:
                    n += 1
                    back /= self.ratio[g - n]
                shares.append(weight[k] * back)
            u, k = draws[step % BLOCK], x
            for share in reversed(shares):
                if u < share or k == y - 1:
                    break
                u -= share
                k += 1
            what = kind[k]
            parts.append([what] if what >= 0 else v.byte_id[list(chr(-1 - what).encode("utf-8", "surrogatepass"))].tolist())
            g -= size[k]
            step += 1
        return np.array([i for p in reversed(parts) for i in p], np.int32)


class Lattices:
    """Sampling tables of the segments met so far, as flat arrays.

    Place g of the flat lattice has the arcs ``head[g]`` up to ``head[g + 1]``,
    the longest first: ``share`` is cumulated up to 1, ``size`` counts
    characters, ``kind`` is a piece's id or -1 - the character.
    """

    def __init__(self, p: Params) -> None:
        self.p, self.words = p, Vocabulary(p.model)
        self.clear()

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.head = np.zeros(1, np.int64)
        self.share = np.empty(0)
        self.size = np.empty(0, np.int8)
        self.kind = np.empty(0, np.int32)

    def keep(self, wanted: set[str]) -> None:
        """Forgets all segments but the wanted ones."""
        kept = [s for s in wanted if s in self.end]
        lens = np.fromiter(map(len, kept), np.int64, len(kept)) + 1
        end = np.fromiter(map(self.end.__getitem__, kept), np.int64, len(kept))
        place = _ranges(end + 1 - lens, lens)
        count = self.head[place + 1] - self.head[place]
        arc = _ranges(self.head[place], count)
        self.share, self.size, self.kind = self.share[arc], self.size[arc], self.kind[arc]
        self.head = np.append(0, np.cumsum(count))
        self.end = dict(zip(kept, (np.cumsum(lens) - 1).tolist()))

    def learn(self, new: list[str]) -> None:
        v, lens = self.words, np.array([len(s) for s in new], np.int64)
        char = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # Place of character k of a segment: its start + k; its end: start + length.
        offset = np.arange(len(char)) - np.repeat(np.cumsum(lens) - lens, lens)
        base = np.cumsum(lens + 1) - (lens + 1)
        place = np.repeat(base, lens) + offset
        left = np.repeat(lens, lens) - offset
        at, node = np.arange(len(char)), np.zeros(len(char), np.int64)
        found = []  # by size: where pieces start, and their kinds and weights
        covered = np.zeros(len(char), bool)
        for n in range(1, LONGEST + 1):
            node = v.step(node, char[at + n - 1])
            real = np.flatnonzero(node >= 0)
            at, node = at[real], node[real]
            piece = v.piece[node]
            full = np.flatnonzero(piece >= 0)
            found.append((place[at[full]], piece[full], self.weight[node[full]]))
            if n == 1:
                covered[at[full]] = True
            more = np.flatnonzero(left[at] > n)
            at, node = at[more], node[more]
            if not len(at):
                break
        bare = np.flatnonzero(~covered)
        single = [np.concatenate(x) for x in zip(found[0], (place[bare], -1 - char[bare], np.full(len(bare), (v.ranks + 2.0) ** -self.p.alpha)))]
        found[0] = tuple(single)

        # A place is reached by at most one arc of a size, so arcs are put in by size.
        places = int((lens + 1).sum())
        count = np.zeros(places, np.int64)
        for n, (start, _, _) in enumerate(found, 1):
            count[start + n] += 1
        head = np.append(0, np.cumsum(count))
        free, arcs = head[:-1].copy(), int(head[-1])
        size, kind, weight = np.empty(arcs, np.int8), np.empty(arcs, np.int32), np.empty(arcs)
        for n in range(len(found), 0, -1):
            start, kinds, weights = found[n - 1]
            slot = free[start + n]
            free[start + n] += 1
            size[slot], kind[slot], weight[slot] = n, kinds, weights
        target = np.repeat(np.arange(places), count)
        source = target - size

        depth = np.zeros(places, np.int8)
        depth[place + 1] = offset + 1
        depth = depth[target]
        order = np.argsort(depth, kind="stable")
        levels = np.searchsorted(depth[order], np.arange(1, LONGEST + 2, dtype=np.int8))
        by_source, by_target, by_weight = source[order], target[order], weight[order]
        total = np.zeros(places)
        total[base] = 1.0
        part = np.empty(arcs)
        for x, y in zip(levels[:-1], levels[1:]):
            if x < y:
                part[x:y] = total[by_source[x:y]] * by_weight[x:y]
                heads = np.flatnonzero(np.diff(by_target[x:y], prepend=-1))
                total[by_target[x:y][heads]] = np.add.reduceat(part[x:y], heads)

        share = np.empty(arcs)
        share[order] = part
        share /= total[target]
        sums = np.cumsum(share)
        heads = head[:-1][count > 0]
        before = np.repeat(sums[heads] - share[heads], count[count > 0])
        share = np.clip(sums - before, 0, 1)
        share[np.append(heads[1:], arcs) - 1] = 1.0

        self.end.update(zip(new, (base + lens + len(self.head) - 1).tolist()))
        self.head = np.concatenate([self.head, head[1:] + len(self.share)])
        self.share = np.concatenate([self.share, share])
        self.size = np.concatenate([self.size, size])
        self.kind = np.concatenate([self.kind, kind])

    @functools.cached_property
    def weight(self) -> np.ndarray:
        """The weight of each trie node's piece."""
        return (self.words.rank + 2.0) ** -self.p.alpha

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """The sampled ids of each text."""
        cut = [segments(t) for t in texts]
        every = [s for c in cut for s in c]
        if not every:
            return [np.empty(0, np.int32) for _ in texts]
        lens = np.fromiter(map(len, every), np.int64, len(every))
        long = {i: every[i] for i in np.flatnonzero(lens > LONGEST).tolist()}
        # A long segment's place is taken by a blank here, and its own walk replaces it.
        for i in long:
            every[i], lens[i] = " ", 1
        wanted = set(every)
        if len(self.share) > self.p.remembered:
            self.keep(wanted)
        new = [s for s in wanted if s not in self.end]
        for k in range(0, len(new), 20000):
            self.learn(new[k : k + 20000])
        counts = np.array([len(c) for c in cut], np.int64)
        number = _ranges(np.zeros(len(counts), np.int64), counts)
        row = np.repeat(mix(keys.astype(np.int64).view(U64) + U64(self.p.seed) * U64(0x9E3779B97F4A7C15)), counts)
        noise = mix(row ^ mix(number.astype(U64)))

        # Segments are walked from end to start; each drawn arc is put at its first character.
        begin = np.cumsum(lens) - lens
        drawn = np.full(int(lens.sum()), _EMPTY, np.int32)
        place, left, start, live = np.fromiter(map(self.end.__getitem__, every), np.int64, len(every)), lens, begin, noise
        step = 0
        while len(place):
            u = (mix(live + U64(step)) >> U64(11)).astype(np.float64) * 2.0**-53
            arc = self.head[place]
            past = np.flatnonzero(self.share[arc] <= u)
            while len(past):  # few arcs end at a place, and u is below the last share
                arc[past] += 1
                past = past[self.share[arc[past]] <= u[past]]
            size = self.size[arc]
            left = left - size
            drawn[start + left] = self.kind[arc]
            more = np.flatnonzero(left)
            place, left, start, live = (place - size)[more], left[more], start[more], live[more]
            step += 1

        # The arcs in order of text; a character without a piece gives its bytes.
        segment_end = np.cumsum(drawn != _EMPTY)[begin + lens - 1]
        ids = drawn[drawn != _EMPTY]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            chars, which = np.unique(-1 - ids[bare], return_inverse=True)
            many = [self.words.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
            width = np.ones(len(ids), np.int64)
            width[bare] = np.array([len(x) for x in many])[which]
            after = np.cumsum(width)
            ids = np.repeat(ids, width)
            for k in range(4):
                some = np.array([len(x) > k for x in many])[which]
                ids[(after - width)[bare[some]] + k] = np.array([x[k] if len(x) > k else 0 for x in many])[which[some]]
            segment_end = after[segment_end - 1]
        text_end = segment_end[np.cumsum(counts) - 1]
        made = np.split(ids, text_end[:-1])
        if not long:
            return made
        text_of = np.repeat(np.arange(len(texts)), counts)
        walked: dict[int, list[np.ndarray]] = {}
        text_begin = np.append(0, text_end[:-1])
        done: dict[int, int] = {}
        filtered = {s: Long(self.words, self.p.alpha, s) for s in set(long.values())}
        for i, s in long.items():
            t = int(text_of[i])
            parts = walked.setdefault(t, [])
            before = int(segment_end[i - 1]) if i else 0
            parts += [ids[done.get(t, text_begin[t]) : before], filtered[s].walk(noise[i])]
            done[t] = int(segment_end[i])
        for t, parts in walked.items():
            made[t] = np.concatenate([*parts, ids[done[t] : text_end[t]]])
        return made


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first``, one range after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def lattices(p: Params) -> Lattices:
    if p not in _WORKERS:
        _WORKERS[p] = Lattices(p)
    return _WORKERS[p]


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


#: Characters sampled at once.
SLICE = 1 << 20


def encode(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, ids, n_ids, lossless), one row for each row of ``docs``; the row key is doc_id."""

    def run(frames):
        worker = lattices(p)
        table = worker.words.bytes
        for frame in frames:
            sizes = np.cumsum([len(t or "") for t in frame["text"]])
            part = sizes // SLICE
            for k in np.unique(part):
                some = frame[part == k]
                there = some["text"].notna().to_numpy()
                texts = some["text"][there].tolist()
                keys = some["doc_id"].fillna(0).astype("int64").to_numpy()[there]
                made = worker.sample(texts, keys) if texts else []
                out = pd.DataFrame({"doc_id": some["doc_id"].astype("Int64")}).reset_index(drop=True)
                ids = np.full(len(some), None, object)
                same = np.full(len(some), None, object)
                for i, x, t in zip(np.flatnonzero(there), made, texts):
                    ids[i], same[i] = x, decode_ids(x, table) == t
                out["ids"] = ids
                out["n_ids"] = pd.Series([None if x is None else len(x) for x in ids], dtype="Int64")
                out["lossless"] = pd.Series(same, dtype="boolean")
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def decode(ids: Column | str, p: Params) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        table = lattices(p).words.bytes
        return pd.Series([None if x is None else decode_ids(x, table) for x in rows], dtype="object")

    return run(ids)
