"""Packing by first-fit decreasing with a tournament tree of bin capacities.

A document's ids (word_bpe ids, then the end id) are cut into pieces of the
sequence length; only the last piece is shorter. Pieces are dealt to randomised
groups by a hash, and every group is packed on its own: pieces in falling order
of length, each into the first bin with room. A tournament tree over the bins
keeps the largest room below every node, so the first bin that fits is found by
one walk from the root.

The number of groups follows the number of rows, so a group has about
``group_rows`` documents at every size. Nothing is random at run time: a task
that runs again gives the same rows.

Defined results: a null or empty text has the end id only; other columns are
ignored; repeated rows are packed like any other (a piece for each row).
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64
from .rolling import span_hashes


@dataclass(frozen=True)
class Params:
    vocabulary: str  # path of the tokenizer's file
    length: int = 2048
    end_id: int = 1
    group_rows: int = 4096
    with_ids: bool = False  # also return the ids of each piece
    words: int = 400_000  # words that a worker remembers, about 60 bytes each (memory, not results)


_WORKERS: dict[str, "WordIds"] = {}


#: White space of str.isspace beyond ASCII; the tokenizer drops it like a blank.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BREAKS = np.zeros(256, bool)
_BREAKS[[9, 10, 11, 12, 13, 32]] = True
_SECOND = 0xC2B2AE3D27D4EB4F  # odd; the base of the second word hash
# What a byte is in a plain word: 1 letter, 2 ASCII sign other than the apostrophe, 0 anything else.
_PLAIN = np.zeros(256, np.int8)
_PLAIN[33:127] = 2
_PLAIN[[39, *range(48, 58)]] = 0
_PLAIN[[*range(65, 91), *range(97, 123)]] = 1


class WordIds:
    """Ids of a text by its white-space words, remembered for the life of the worker.

    The tokenizer lower-cases, drops white space and never joins characters
    across it, so the ids of a text are the ids of its words in order. Words are
    found and hashed in the bytes of many texts at once and looked up in an open
    table by two independent 64-bit hashes; only words that are not known are
    encoded. A plain word, Latin-1 letters and then ASCII signs other than the
    apostrophe, is two parts whose ids follow each other; such parts need none
    of the tokenizer's normalising and splitting, and many are encoded in one
    call. Any other word is given to the tokenizer as it is. When too many words
    are held, the half that was used least goes.
    """

    #: Plain words encoded in one call, with a space between their parts.
    JOINED = 200

    def __init__(self, path: str, limit: int) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # A task has one core: the tokenizer's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.limit = limit
        # A word is a row of hashes, uses and the place of its ids in flat; the
        # table leads from hashes to rows.
        self.hashes = np.empty((0, 2), U64)
        self.uses = np.zeros(0, np.int64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.table = np.full(1 << 12, -1, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[:, 0] >> U64(65 - len(self.table).bit_length())).astype(np.int64)

    def _insert(self, first: int) -> None:
        """Puts the rows from ``first`` on into the table, at most half full."""
        if 2 * len(self.hashes) > len(self.table):
            self.table = np.full(1 << (3 * len(self.hashes)).bit_length(), -1, np.int32)
            first = 0
        last = len(self.table) - 1
        rows, at = np.arange(first, len(self.hashes)), self._slots(self.hashes[first:])
        while len(rows):
            free = self.table[at] < 0
            self.table[at[free]] = rows[free]  # of rows for one place, the last stays
            left = self.table[at] != rows
            rows, at = rows[left], (at[left] + 1) & last

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word, or -1."""
        out, last = np.full(len(hashes), -1, np.int64), len(self.table) - 1
        open_, at = np.arange(len(hashes)), self._slots(hashes)
        while len(open_):
            row = self.table[at]
            held = row >= 0
            open_, at, row = open_[held], at[held], row[held]
            same = (self.hashes[row, 0] == hashes[open_, 0]) & (self.hashes[row, 1] == hashes[open_, 1])
            out[open_[same]] = row[same]
            open_, at = open_[~same], (at[~same] + 1) & last
        return out

    def _encode_plain(self, buf: np.ndarray, kind: np.ndarray, lens: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of plain words (their bytes, each word followed by a space), and how many each has."""
        cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        ends = np.cumsum(lens + 1)
        parts = np.ones(len(lens), np.int64)
        np.add.at(parts, np.searchsorted(ends, cut, side="right"), 1)
        text = np.insert(buf, cut, 32)
        ends = ends + np.cumsum(parts - 1)
        ids, sizes, at = [], [], 0
        for k in range(0, len(lens), self.JOINED):
            mine = parts[k : k + self.JOINED]
            end = int(ends[min(k + self.JOINED, len(lens)) - 1])
            e = self.plain.encode(text[at:end].tobytes().decode().lower(), add_special_tokens=False)
            n = np.bincount(e.word_ids, minlength=int(mine.sum()))
            sizes.append(np.add.reduceat(n, np.cumsum(mine) - mine))
            ids.append(np.array(e.ids, np.uint32))
            at = end
        return ids, np.concatenate(sizes)

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        buf = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lens + 1) - lens - 1
        kind = _PLAIN[buf]
        # The letters U+00C0 to U+00FF are two bytes each; two of these signs are no letters.
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        wrong = (kind == 0) & (buf != 32)
        wrong[1:] |= (kind[:-1] == 2) & (kind[1:] == 1)
        plain = ~np.logical_or.reduceat(wrong, first)
        ids, sizes = [], np.zeros(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        if plain.any():
            mine = np.repeat(plain, lens + 1)
            found, sizes[plain] = self._encode_plain(buf[mine], kind[mine], lens[plain])
            ids += found
        if not plain.all():
            odd = [words[i].decode() for i in np.flatnonzero(~plain)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            sizes[~plain] = [len(x) for x in found]
            ids += found
        starts = np.empty(len(words), np.int64)
        starts[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.flat = np.concatenate([self.flat, *ids])
        row = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self._insert(row)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and where each word ends."""
        lens = self.sizes[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[rows] - (ends - lens), lens)], ends

    def forget(self) -> None:
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        self.flat, ends = self._gather(keep)
        self.hashes, self.uses, self.sizes = self.hashes[keep], self.uses[keep] // 2, self.sizes[keep]
        self.starts = ends - self.sizes
        self.table = np.full(len(self.table), -1, np.int32)
        self._insert(0)

    def _fresh(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the words that are not known, each once."""
        missing = np.flatnonzero(rows < 0)
        order = missing[np.lexsort((hashes[missing, 1], hashes[missing, 0]))]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)
        return order[new]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [(WIDE_SPACE.sub(" ", t) if not t.isascii() and WIDE_SPACE.search(t) else t).encode() for t in texts]
        data = b"\n".join(parts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        edge = np.diff(_BREAKS[buf].astype(np.int8), prepend=np.int8(1))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes = np.stack([span_hashes(buf, lo, hi), span_hashes(buf, lo, hi, _SECOND)], axis=1)
        rows = self._find(hashes)
        if (rows < 0).any():
            fresh = self._fresh(hashes, rows)
            if len(self.hashes) and len(self.hashes) + len(fresh) > self.limit:
                self.forget()
                fresh = self._fresh(hashes, self._find(hashes))
            self.learn([data[a:b] for a, b in zip(lo[fresh].tolist(), hi[fresh].tolist())], hashes[fresh])
            rows = self._find(hashes)
        self.uses += np.bincount(rows, minlength=len(self.uses))
        ids, ends = self._gather(rows)
        starts = np.cumsum([0] + [len(x) + 1 for x in parts[:-1]])
        cuts = np.append(0, ends)[np.searchsorted(lo, starts)]
        return np.split(ids, cuts[1:])


def word_ids(p: Params) -> WordIds:
    if p.vocabulary not in _WORKERS:
        _WORKERS[p.vocabulary] = WordIds(p.vocabulary, p.words)
    return _WORKERS[p.vocabulary]


#: Characters encoded at once.
SLICE = 1 << 19


def _batches(texts) -> list[list[str]]:
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > SLICE:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def pieces(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each row."""

    def run(frames):
        encode = word_ids(p)
        for frame in frames:
            ids_of = (x for b in _batches([t or "" for t in frame["text"]]) if b for x in encode(b))
            out = []
            for doc, ids in zip(frame["doc_id"], ids_of):
                whole = np.append(ids, np.uint32(p.end_id)).astype("<u4")
                for at in range(0, len(whole), p.length):
                    part = whole[at : at + p.length]
                    data = part.tobytes()
                    out.append((doc, at, len(part), zlib.crc32(data), len(whole), *([part.astype(np.int32)] if p.with_ids else [])))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if p.with_ids else [])])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * p.with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, shape)


class Bins:
    """Bins of one size; a tournament tree gives the first one with enough room."""

    def __init__(self, room: int, most: int) -> None:
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """Place ``length`` in the first bin that fits: (bin, room before)."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < length:
                k += 1
        room = tree[k]
        tree[k] = room - length
        at = k
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return at - self.leaves, room


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties go in the order given."""
    bins = Bins(room, max(1, len(lengths)))
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        where[i], left = bins.put(n)
        offset[i] = room - left
    return where, offset


def pack(docs: DataFrame, p: Params) -> DataFrame:
    """The pieces with sequence_id and offset; no sequence is longer than ``length``."""
    groups = max(1, -(-docs.count() // p.group_rows))
    rows = pieces(docs, p)
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        where, offset = first_fit_decreasing(frame["length"].to_numpy(), p.length)
        frame["sequence_id"] = (int(key[0]) << 32) + where
        frame["offset"] = offset
        return frame.drop(columns="pack_group")

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "pack_group")
    return rows.groupBy("pack_group").applyInPandas(run, f"{shape}, sequence_id long, offset long")
