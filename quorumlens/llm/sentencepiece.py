"""SentencePiece encoding and decoding in batched numpy: Viterbi, and for models of type BPE an exact check by merge order.

A text gets a space in front and is cut into segments that no piece spans: spaces with the word behind them, and line
ends.  The distinct segments of an Arrow batch that haven't been met yet are grouped by length, and equal-length ones
advance together: polynomial hashes of their substrings probe the sorted hashes of the pieces, which gives a lattice
of scores and ids, and a Viterbi pass over it takes vectorised maxima and stores backpointers.

The best path (`path_ids`) is the encoding of a model of type unigram.  A model of type BPE defines its encoding by merge
order instead, which the best path doesn't always equal; with `merge_order`, the default for such a model, segments are
checked on the same lattice by merging, best score first and leftmost among equals, and where the two differ the merge
order holds in `ids` (`n_corrected` counts these segments).  Without it a BPE model is read as a unigram one.

A segment of over WHOLE characters passes through the lattice in blocks; it needs 13 bytes a character for its path,
and about 60 while it is merged.

Defined results: null and empty text have no ids (null ids for null); characters in no piece fall back to their UTF-8
bytes if the model has byte pieces, else to the unknown id; U+2581 is a space, as in the format; decoding is exact but
for it and unknown ids; repeated rows are encoded alike; an empty table gives an empty result; columns ids, path_ids,
n_corrected, decoded are replaced if there, other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import with_python

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Segments and their characters that an encoder keeps.
CACHE, CACHED_CHARS = 200_000, 10_000_000
#: Lengths from which a segment is merged by a heap, and from which it passes through the lattice in blocks.
LONG, WHOLE = 256, 65_536
STARTS = 20
NONE = -np.inf


def _fields(blob: bytes):
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, blob[at : at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", blob[at : at + n])[0]
            at += n


def _substring_hash(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return before * BASE + codes + np.uint64(1)


class Vocabulary:
    """Pieces, scores and kinds of a .model file, and their sorted hashes."""

    UNIGRAM, BPE = 1, 2

    def __init__(self, blob: bytes):
        self.digest = hashlib.sha256(blob).hexdigest()
        self.pieces, scores, kinds, self.model_type, self.dummy_prefix = [], [], [], self.UNIGRAM, True
        for number, value in _fields(blob):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, 1))
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, self.UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that neither normalise characters nor remove spaces are supported")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.unknown = kinds.index(2)
        usable = [i for i, k in enumerate(kinds) if k in (1, 4)]
        if any("\n" in self.pieces[i] or SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces over line ends or over words aren't supported")
        self.longest = max(len(self.pieces[i]) for i in usable)
        codes = np.zeros((len(usable), self.longest), np.uint64)
        lengths = np.array([len(self.pieces[i]) for i in usable])
        for row, i in enumerate(usable):
            codes[row, : lengths[row]] = list(map(ord, self.pieces[i]))
        hashes = np.zeros(len(usable), np.uint64)
        for k in range(self.longest):
            hashes = np.where(lengths > k, _substring_hash(hashes, codes[:, k]), hashes)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(usable, np.int32)[order]
        self.key_scores = np.array([scores[i] for i in usable])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # by the beginning of a hash: the first key's place, len(keys) for none; keys after it are searched for
        top = (self.keys >> np.uint64(64 - STARTS)).astype(np.int64)
        self.first = np.full(1 << STARTS, len(self.keys), np.int32)
        self.first[top[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]
        self.shared = np.zeros(len(self.keys) + 1, bool)
        self.shared[:-2] = top[1:] == top[:-1]
        self.probe = np.append(self.keys, np.uint64(0))
        ranks = {score: rank for rank, score in enumerate(sorted({scores[i] for i in usable}, reverse=True))}
        self.known = {self.pieces[i]: (ranks[scores[i]], i) for i in usable}
        self.unknown_score = min(scores[i] for i in usable) - 10.0
        self.raw = [p.encode().replace(SPACE.encode(), b" ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i, k in enumerate(kinds):
            if k == 3:
                self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """scores and ids [word, start, length]; -inf and -1 where no piece is."""
        n, size = codes.shape
        most = min(size, self.longest)
        scores, ids = np.full((n, size, most + 1), NONE), np.full((n, size, most + 1), -1, np.int32)
        hashes = np.zeros((n, size), np.uint64)
        for k in range(1, most + 1):
            hashes = _substring_hash(hashes[:, : size - k + 1], codes[:, k - 1 :])
            at = self.first[hashes >> np.uint64(64 - STARTS)]
            row, start = np.nonzero(at < len(self.keys))
            at, wanted = at[row, start], hashes[row, start]
            hit = self.probe[at] == wanted
            again = np.flatnonzero(~hit & self.shared[at])
            at[again] = np.searchsorted(self.keys, wanted[again])
            hit[again] = self.probe[at[again]] == wanted[again]
            row, start, at = row[hit], start[hit], at[hit]
            scores[row, start, k] = self.key_scores[at]
            ids[row, start, k] = self.key_ids[at]
        return scores, ids

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """next[word, start]: the end of the piece there on the best path, 0 elsewhere.  Single characters always pass."""
        n, size, most = scores.shape[0], scores.shape[1], scores.shape[2] - 1
        best = np.full((n, size + 1), NONE)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            steps = np.arange(1, min(end, most) + 1)
            arc = scores[:, end - steps, steps]
            arc[:, 0] = np.where(arc[:, 0] == NONE, self.unknown_score, arc[:, 0])
            total = best[:, end - steps] + arc
            # of equal totals the longest piece, whose step comes last
            chosen = len(steps) - 1 - total[:, ::-1].argmax(1)
            best[:, end] = np.take_along_axis(total, chosen[:, None], 1)[:, 0]
            back[:, end] = chosen + 1
        nexts, rows, end = np.zeros((n, size), np.int32), np.arange(n), np.full(n, size)
        while len(rows):
            start = end - back[rows, end]
            nexts[rows, start] = end
            rows, end = rows[start > 0], start[start > 0]
        return nexts

    def merged(self, scores: np.ndarray) -> np.ndarray:
        """next[word, start] by merge order: of all neighbours that form a piece the best score first, then the leftmost."""
        n, size, most = scores.shape[0], scores.shape[1], scores.shape[2] - 1
        nexts = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        after = np.concatenate([nexts, np.zeros((n, 1), np.int32)], 1)
        rows, starts = np.arange(n), np.arange(size)
        while len(rows) and most > 1:
            first = after[rows, :size]
            second = np.take_along_axis(after[rows], first, 1)
            length = second - starts
            fits = (first > 0) & (second > 0) & (length <= most)
            value = np.where(fits, scores[rows[:, None], starts, np.where(fits, length, 0)], NONE)
            at = value.argmax(1)
            found = np.take_along_axis(value, at[:, None], 1)[:, 0] > NONE
            rows, at, first, second = rows[found], at[found], first[found], second[found]
            here = np.arange(len(rows))
            middle, end = first[here, at], second[here, at]
            after[rows, middle] = 0
            after[rows, at] = end
        return after[:, :size]

    def merged_long(self, text: str) -> list[int]:
        """Merge order for a segment too long for the batched pass, by a heap of numbers (rank of the score, place)."""
        n, known = len(text), self.known
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [hit[0] << 40 | i for i in range(n - 1) if (hit := known.get(text[i : i + 2]))]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and after[j] - i <= self.longest and (hit := known.get(text[i : after[j]])):
                heapq.heappush(heap, hit[0] << 40 | i)

        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 40, top & ((1 << 40) - 1)
            j = after[i]
            # gone, merged otherwise meanwhile, or without a neighbour
            if j <= 0 or j >= n or after[j] - i > self.longest or known.get(text[i : after[j]], (-1,))[0] != rank:
                continue
            after[i], after[j] = after[j], 0
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            piece = text[i : after[i]]
            out += [known[piece][1]] if piece in known else self.fallback(piece)
            i = after[i]
        return out

    def best_long(self, text: str) -> list[int]:
        """The ids of the best path of one segment, its lattice made in blocks of WHOLE places."""
        n = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        best, steps, arcs = array("d", [NONE]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for at in range(0, n, WHOLE):
            scores, ids = self.lattice(codes[None, at : at + WHOLE + self.longest])
            scores, ids = scores[0, : min(WHOLE, n - at)], ids[0]
            if scores.shape[1] > 1:
                scores[:, 1] = np.where(scores[:, 1] == NONE, self.unknown_score, scores[:, 1])
            starts, lengths = np.nonzero(scores > NONE)
            for i, k, score, piece in zip((starts + at).tolist(), lengths.tolist(), scores[starts, lengths].tolist(), ids[starts, lengths].tolist(), strict=True):
                total = best[i] + score
                if total > best[i + k]:  # of equal totals the longest piece, which comes first
                    best[i + k], steps[i + k], arcs[i + k] = total, k, piece
        out, end = [], n
        while end:
            start = end - steps[end]
            out.append([arcs[end]] if arcs[end] >= 0 else self.fallback(text[start]))
            end = start
        return [x for own in reversed(out) for x in own]

    def _spelled(self, part: list[str], nexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of equal-length segments whose pieces end at nexts."""
        row, start = np.nonzero(nexts)
        found = ids[row, start, nexts[row, start] - start]
        counts = np.bincount(row, minlength=len(part))
        if (found < 0).any():  # single characters outside the vocabulary
            spell = [[v] if v >= 0 else self.fallback(part[r][c]) for v, r, c in zip(found.tolist(), row.tolist(), start.tolist(), strict=True)]
            counts = np.bincount(row, weights=[len(x) for x in spell], minlength=len(part)).astype(np.int64)
            found = np.array([x for own in spell for x in own], np.int32)
        return counts, found

    def encode_segments(self, segments: list[str], merge_order: bool) -> Iterator[tuple[list[str], tuple, tuple, np.ndarray]]:
        """Groups of equal length: (segments, numbers of ids and all their ids, the same of their best paths, 1 where merge
        order differed)."""

        def listed(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            return np.array([len(x) for x in lists]), np.concatenate([np.array(x, np.int32) for x in lists])

        groups: dict[int, list[str]] = {}
        for s in segments:
            groups.setdefault(len(s), []).append(s)
        for size, members in groups.items():
            step = max(1, WHOLE // size)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                if size > WHOLE:
                    path = listed([self.best_long(s) for s in part])
                else:
                    codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size).astype(np.uint64)
                    scores, ids = self.lattice(codes)
                    nexts = self.viterbi(scores)
                    path = self._spelled(part, nexts, ids)
                exact, corrected = path, np.zeros(len(part), np.int64)
                if merge_order and size <= LONG:
                    checked = self.merged(scores)
                    corrected = (checked != nexts).any(1).astype(np.int64)
                    if corrected.any():
                        exact = self._spelled(part, checked, ids)
                elif merge_order:
                    exact = listed([self.merged_long(s) for s in part])
                    ends = [np.split(x, np.cumsum(n)[:-1]) for n, x in (path, exact)]
                    corrected = np.array([int(not np.array_equal(a, b)) for a, b in zip(*ends, strict=True)])
                yield part, exact, path, corrected


class _Ids:
    """Lists of ids by number, end to end."""

    def __init__(self):
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, lists: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.counts = np.concatenate([self.counts, *[n for n, _ in lists]])
        self.flat = np.concatenate([self.flat, *[x.astype(np.int32) for _, x in lists]])
        self.starts = np.cumsum(self.counts) - self.counts

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The lists of these numbers, one behind the other."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(total)]


class Encoder:
    """encode and decode for lists of texts; keeps the segments it has met, and starts anew when they are many."""

    segment = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def __init__(self, vocabulary: Vocabulary, merge_order: bool | None = None):
        self.vocabulary, self.raw = vocabulary, None
        self.merge_order = vocabulary.model_type == Vocabulary.BPE if merge_order is None else merge_order
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.exact, self.paths, self.fixed, self.chars = _Ids(), _Ids(), np.zeros(0, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        exact, paths, fixed = [], [], [self.fixed]
        for part, ids, path, corrected in self.vocabulary.encode_segments(new, self.merge_order):
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part)), strict=True))
            exact.append(ids)
            paths.append(path)
            fixed.append(corrected)
        self.exact.extend(exact)
        if self.merge_order:
            self.paths.extend(paths)
        else:
            self.paths = self.exact
        self.fixed = np.concatenate(fixed)

    def encode(self, texts: list[str | None], paths: bool = True) -> tuple[list, list, list[int]]:
        """Of each text the ids, those of its best path (or the ids again), and the number of corrected segments."""
        cut = [self.segment.findall((SPACE * self.vocabulary.dummy_prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        met = set(chain.from_iterable(cut))
        new = list(met.difference(self.index))
        self.chars += sum(map(len, new))
        if len(self.index) + len(new) > CACHE or self.chars > CACHED_CHARS:
            self._reset()
            new = list(met)
            self.chars = sum(map(len, new))
        if new:
            self._learn(new)
        # all segments of the batch at once; texts are slices of what they give
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        ends = np.cumsum([0, *map(len, cut)])
        fixed = np.diff(np.concatenate([[0], np.cumsum(self.fixed[at])])[ends]).tolist()

        def sliced(lists: _Ids) -> list:
            bounds = np.concatenate([[0], np.cumsum(lists.counts[at])])[ends].tolist()
            ids = lists.joined(at)
            return [None if t is None else ids[i:j] for t, i, j in zip(texts, bounds, bounds[1:], strict=False)]

        out = sliced(self.exact)
        return out, sliced(self.paths) if paths and any(fixed) else out, fixed

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, joined in Arrow; bytes that are no UTF-8 become U+FFFD."""
        if self.raw is None:
            self.raw = pa.array(self.vocabulary.raw, pa.large_binary())
        skip, values = int(self.vocabulary.dummy_prefix), ids.values.slice(ids.offsets[0].as_py() if len(ids) else 0)
        offsets = pc.subtract(ids.offsets, ids.offsets[0]).cast(pa.int64()) if len(ids) else pa.array([0], pa.int64())
        pieces = self.raw.take(values.slice(0, offsets[-1].as_py()))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, pieces), pa.scalar(b"", pa.large_binary()))
        try:
            texts = joined.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([None if t is None else t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.large_string())
        texts = (pc.utf8_slice_codeunits(texts, skip) if skip else texts).cast(pa.string())
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def load(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary of a .model file: local to the driver, or in any store that Spark reads."""
    if "://" in path:
        return Vocabulary(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as file:
        return Vocabulary(file.read())


#: Encoders of this Python worker by vocabulary and way: what one task has met the next one knows.
_ENCODERS: dict[tuple, Encoder] = {}


def _shared(df: DataFrame, vocabulary: Vocabulary, merge_order: bool | None = None) -> Callable[[], Encoder]:
    """The vocabulary (one file's size) on the executors, with one encoder a worker."""
    broadcast, key = df.sparkSession.sparkContext.broadcast(vocabulary), (vocabulary.digest, merge_order)

    def encoder() -> Encoder:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(broadcast.value, merge_order)
        return _ENCODERS[key]

    return encoder


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]]).astype(np.int32), pa.int32())
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids], pa.bool_()))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", merge_order: bool | None = None, paths: bool = False) -> DataFrame:
    """df with ids array<int> of the whole text, n_corrected long and, if asked for, path_ids array<int>."""
    encoder = _shared(df, vocabulary, merge_order)

    def run(texts: list) -> list[pa.Array]:
        ids, best, corrected = encoder().encode(texts, paths)
        return [_lists(ids), *([_lists(best)] if paths else []), pa.array(corrected, pa.int64())]

    lists = T.ArrayType(T.IntegerType())
    fields = [T.StructField("ids", lists), *([T.StructField("path_ids", lists)] if paths else []), T.StructField("n_corrected", T.LongType())]
    return with_python(df, text, run, fields, drop=("ids", "n_corrected", "path_ids"))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """df with decoded string."""
    encoder = _shared(df, vocabulary)
    return with_python(df, ids, lambda lists: [encoder().decode(lists)], [T.StructField("decoded", T.StringType())], drop=("decoded",), arrow=True)
