"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over a corpus.

A text with a space in front is encoded by a byte-level BPE (A, a tokenizer .json) and by a SentencePiece model (B, a
.model, which adds that space itself).  The byte offsets at which a token of A and one of B both end cut a text into
groups; an A and a B token are linked if their byte ranges overlap.  Between two neighbouring ends of either kind lies one
link, so a text has as many links as it has different ends.

No token of either vocabulary reaches over the place between a character that isn't white space and a space, nor does
either encoding depend on what lies behind it, so both token ends meet there.  Texts are cut at these places, and all that
a distinct segment contributes is worked out once by numpy, for a batch's new segments together: they are encoded as one
text and told apart by their lengths in bytes.  A merges by rank, which is the order of its merges, as is checked, together
with that every token alone encodes to itself, without which ranks and merges could differ; characters beyond the Latin
ones, whose classes libraries may see differently, and segments that end in white space are encoded one by one from the
.json itself.

Counts are made in three steps.  Each document's distinct links, ids packed in an int64, are kept with their numbers;
each partition sums them by np.unique, handing on what it has when it holds too much.  The partial counts are written,
dealt out by ranges of keys and sorted, and equal keys, which lie side by side, are summed as runs.  The shards so written
are sorted one behind the other; a Python worker copies them to an unlinked local file of 16 bytes a pair, maps that into
memory and looks keys up by searchsorted.  The driver gets the highest count of each A id, at most one number an entry of
that vocabulary.

Shards are read by pyarrow from the folder that spark.checkpoint.dir names, whose scheme it has to know.

Defined results: a text that is null or empty, or whose tokens' bytes aren't its own (a U+2581 becomes a space in B), has no
tokens: zeros and groups ''; special tokens' strings are plain text; every row is a document, repeated rows too; an
empty table gives an empty result; columns named like new ones are replaced, others kept.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepiece
from .common import small_batches, stored, tasks, with_python

#: Segments, their characters and their links that a worker keeps, and characters that are encoded at once.
CACHE, CACHED_CHARS, CACHED_LINKS, TOGETHER = 300_000, 10_000_000, 4_000_000, 50_000
#: Keys that a partition gathers before it sums them, and sums before it hands them on.
GATHERED, SUMMED = 2_000_000, 1_000_000
SEGMENT = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]*)*| +")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Fixed value: how byte-level vocabularies split text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last letter of Latin Extended-B.
LATIN = "\u024f"


def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for
    those from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both files, checked: what they are made of allows segments to be encoded on their own."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b, self.key = a, b, uuid.uuid4().hex
        spec = json.loads(a)
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError("A has to be a byte-level BPE without a normaliser")
        if any(not t["special"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens of A other than special ones aren't supported")
        sentencepiece.Vocabulary(b)  # raises where B normalises or has pieces over words
        vocab = spec["model"]["vocab"]
        self.n_a = 1 + max(vocab.values())
        self.special = {t["content"] for t in spec.get("added_tokens", [])}
        self.by_rank = self._by_rank(spec["model"]["merges"], vocab)

    def _by_rank(self, merges: list, vocab: dict[str, int]) -> bool:
        """Whether merging by id is merging by the list: ids rise along it, and each token alone becomes itself."""
        from tokenizers import Tokenizer

        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        model = Tokenizer.from_str(self.a.decode()).model
        alone = all(len(model.tokenize(t)) == 1 for t in vocab if t not in self.special)
        return ids == sorted(ids) and alone and len(ids) + len(byte_of_char()) == len(vocab.keys() - self.special)

    def bytes_of_a(self) -> list[bytes]:
        chars = byte_of_char()
        out = [b""] * self.n_a
        for token, i in json.loads(self.a)["model"]["vocab"].items():
            out[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else b""
        return out


def load(spark: SparkSession, a: str, b: str) -> Vocabularies:
    """The vocabularies at these paths: local to the driver, or in any store that Spark reads."""

    def blob(path: str) -> bytes:
        if "://" in path:
            return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        with open(path, "rb") as file:
            return file.read()

    return Vocabularies(blob(a), blob(b))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists of token ends with one last end: each link's end, A number and B number, and the groups' ends."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), np.intersect1d(ends_a, ends_b, assume_unique=True)


class Shards:
    """Sorted counts of a corpus in a file that is mapped into memory and has no name."""

    def __init__(self, uris: list[str], best: np.ndarray):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.best = best
        files = []
        for uri in sorted(uris):
            store, path = fs.FileSystem.from_uri(uri)
            files.append((store, path))
        with tempfile.TemporaryFile() as out:
            rows = 0
            for column in ("key", "n"):
                for store, path in files:
                    with store.open_input_file(path) as file:
                        for batch in pq.ParquetFile(file).iter_batches(columns=[column]):
                            out.write(batch.column(0).to_numpy().astype(np.int64, copy=False).tobytes())
                            rows += len(batch) * (column == "key")
            out.flush()
            mapped = np.memmap(out, np.int64, "r") if rows else np.zeros(0, np.int64)
        self.keys, self.counts = mapped[:rows], mapped[rows:]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of these keys, 0 for one that isn't there, and whether each is the highest of its A id."""
        few, back = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(few), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, few), len(self.keys) - 1)
            counts = np.where(self.keys[at] == few, self.counts[at], 0)
        a = few >> 32
        best = (counts > 0) & (counts == self.best[np.minimum(a, len(self.best) - 1)])
        return counts[back], best[back]


class _Flat:
    """Arrays by number, end to end."""

    def __init__(self):
        self.values, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.values = np.concatenate([self.values, values])

    def joined(self, at: np.ndarray) -> np.ndarray:
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return self.values[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """What segments contribute; those it has met are kept until they are too many."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece as library
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.a.decode())
        self.a.encode_special_tokens = True
        self.b = library.SentencePieceProcessor(model_proto=vocabularies.b)
        self.raw_a, self.raw_b = vocabularies.bytes_of_a(), sentencepiece.Vocabulary(vocabularies.b).raw
        ranks = {raw: i for i, raw in enumerate(self.raw_a) if raw and raw.decode("latin-1") not in vocabularies.special}
        self.ranked = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if vocabularies.by_rank else None
        self.len_a, self.len_b = (np.array(list(map(len, raw)), np.int64) for raw in (self.raw_a, self.raw_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(raw), np.uint8) for raw in (self.raw_a, self.raw_b))
        # a token's text with what follows it: another of its list, the end of its side of the group, the end of the segment
        texts = [[f"{i}{end}" for i in range(len(raw))] for raw, ends in ((self.raw_a, ",|"), (self.raw_b, ",;\n")) for end in ends]
        self.written = np.array(list(chain.from_iterable(texts)), object)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.links, self.sums, self.chars = _Flat(), np.zeros((0, 5), np.int64), 0

    def _together(self, part: list[str], own: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of these segments, encoded as one text, if their tokens' bytes are theirs."""
        text = "".join(part)
        whole = np.frombuffer(b"".join(own), np.uint8)
        try:
            ids_a, ids_b = np.array(self.ranked.encode_ordinary(text), np.int64), np.array(self.b.encode(text[1:]), np.int64)
        except BaseException as error:  # the library's own stack may be too small for one word of a million letters
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return None
        bounds = np.cumsum(list(map(len, own)))
        for ids, lengths, flat in ((ids_a, self.len_a, self.flat_a), (ids_b, self.len_b, self.flat_b)):
            size = lengths[ids]
            ends = np.cumsum(size)
            if ends[-1] != len(whole) or not np.isin(bounds, ends, assume_unique=True).all():
                return None
            start = (np.cumsum(lengths) - lengths)[ids]
            if not np.array_equal(flat[np.repeat(start - (ends - size), size) + np.arange(len(whole))], whole):
                return None
        return ids_a, ids_b

    def _alone(self, part: list[str], own: list[bytes]) -> tuple[list, list, np.ndarray]:
        """Ids of both sides of each segment, and whether its tokens' bytes aren't its own."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
        # B puts a space in front of what it is given, but for nothing
        ids_b = [ids or [self.b.piece_to_id(sentencepiece.SPACE)] for ids in self.b.encode([s[1:] for s in part], num_threads=1)]
        join = lambda ids, raw: b"".join(map(raw.__getitem__, ids))
        bad = [join(x, self.raw_a) != s or join(y, self.raw_b) != s for x, y, s in zip(ids_a, ids_b, own, strict=True)]
        return ids_a, ids_b, np.array(bad, bool)

    def _learn(self, new: list[str]) -> None:
        """n_a, n_b, n_groups, n_links, and whether its bytes aren't its own, of each segment, its links and its groups."""
        plain = [s for s in new if (s.isascii() or max(s) <= LATIN) and not s[-1].isspace()] if self.ranked else []
        others = list(set(new).difference(plain)) if len(plain) < len(new) else []
        order, flat_a, flat_b, at = [], [], [], 0
        while at < len(plain):
            chars, stop = 0, at
            while stop < len(plain) and chars < TOGETHER:
                chars += len(plain[stop])
                stop += 1
            part = plain[at:stop]
            found = self._together(part, [s.encode() for s in part])
            if found is None:
                others += part
            else:
                order += part
                flat_a.append(found[0])
                flat_b.append(found[1])
            at = stop
        bad_ones: list[str] = []
        if others:
            ids_a, ids_b, bad = self._alone(others, [s.encode() for s in others])
            keep = np.flatnonzero(~bad).tolist()
            bad_ones = [others[i] for i in np.flatnonzero(bad).tolist()]
            order += [others[i] for i in keep]
            flat_a += [np.array(ids_a[i], np.int64) for i in keep]
            flat_b += [np.array(ids_b[i], np.int64) for i in keep]
        none = [np.zeros(0, np.int64)]
        flat_a, flat_b = np.concatenate(none + flat_a), np.concatenate(none + flat_b)
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        bounds = np.cumsum([len(s.encode()) for s in order]).astype(np.int64)
        ends, at_a, at_b, common = align(ends_a, ends_b)
        keys = flat_a[at_a] << 32 | flat_b[at_b]

        size = lambda e: np.diff(np.searchsorted(e, bounds, "right"), prepend=0)
        sums = np.zeros((len(order) + len(bad_ones), 5), np.int64)
        n_links = size(ends)
        sums[: len(order), :4] = np.stack([size(ends_a), size(ends_b), size(common), n_links], 1)
        sums[len(order) :, 4] = 1

        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = common[group_a] == ends_a, common[group_b] == ends_b
        over = np.zeros(len(ends_b), np.int64)
        over[np.searchsorted(ends_b, bounds)] = 1
        text = np.concatenate([flat_a + last_a * len(self.raw_a), 2 * len(self.raw_a) + flat_b + (last_b + over) * len(self.raw_b)])
        by_group = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        spelled = "".join(self.written[text[by_group]].tolist()).split("\n")[:-1]

        order += bad_ones
        self.index.update(zip(order, range(len(self.index), len(self.index) + len(order)), strict=True))
        self.groups += spelled + [""] * len(bad_ones)
        self.links.extend(keys, np.append(n_links, np.zeros(len(bad_ones), np.int64)))
        self.sums = np.concatenate([self.sums, sums])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """The numbers of all segments of these texts, and where each text's begin and end."""
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        met = set(chain.from_iterable(cut))
        new = list(met.difference(self.index))
        chars = sum(map(len, new))
        if len(self.index) + len(new) > CACHE or self.chars + chars > CACHED_CHARS or len(self.links.values) > CACHED_LINKS:
            self._reset()
            new = list(met)
            chars = sum(map(len, new))
        self.chars += chars
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        return at, np.cumsum([0, *map(len, cut)]).tolist()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: the numbers that COUNTS names, its groups, its distinct links and how often each is there."""
        at, ends = self._numbers(texts)
        table = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.sums[at], axis=0)])[ends], axis=0)
        table[table[:, 4] > 0] = 0
        name, groups, links, times = self.groups.__getitem__, [], [], []
        for i, j, n in zip(ends, ends[1:], table[:, 0].tolist(), strict=False):
            own = at[i:j] if n else at[:0]
            groups.append(";".join(map(name, own.tolist())))
            found = self.links.joined(own)
            found.sort()
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
            links.append(found[starts])
            times.append(np.diff(starts, append=len(found)))
        return table[:, :4], groups, links, times


#: The last aligner and the last shards of this Python worker: what one task has met the next one knows.
_ALIGNERS: dict[str, Aligner] = {}
_SHARDS: dict[tuple[str, ...], Shards] = {}


def _aligner(vocabularies: Vocabularies) -> Aligner:
    if vocabularies.key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[vocabularies.key] = Aligner(vocabularies)
    return _ALIGNERS[vocabularies.key]


def _shards(uris: tuple[str, ...], best: np.ndarray) -> Shards:
    if uris not in _SHARDS:
        _SHARDS.clear()
        _SHARDS[uris] = Shards(list(uris), best)
    return _SHARDS[uris]


_PAIRS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def _batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = pa.array(np.concatenate([np.zeros(0, np.int64), *values]), pa.int64()).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), flat)


def encode(df: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """df with n_a, n_b, n_groups, n_links (long), groups (a1,a2|b1;a3|b2), links (array of a << 32 | b, distinct) and times
    (array of how often each is there)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabularies)  # two files

    def run(texts: list) -> list[pa.Array]:
        table, groups, links, times = _aligner(shared.value).encode(texts)
        return [*[pa.array(table[:, i]) for i in range(4)], pa.array(groups, pa.string()), _lists(links, pa.int64()), _lists(times, pa.int32())]

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return with_python(df, text, run, fields, drop=tuple(f.name for f in fields))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(key, n), written: in how many rows of a frame with links each of them is there; sorted shards of rising keys."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, gathered, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            gathered.append(batch.column(0).flatten().to_numpy())
            held += len(gathered[-1])
            if held > GATHERED:
                found = np.unique(np.concatenate(gathered), return_counts=True)
                keys, counts = summed(np.concatenate([keys, found[0]]), np.concatenate([counts, found[1]]))
                gathered, held = [], 0
                if len(keys) > SUMMED:
                    yield _batch(keys, counts)
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *gathered]), return_counts=True)
        yield _batch(*summed(np.concatenate([keys, found[0]]), np.concatenate([counts, found[1]])))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the run that may go on in the next batch
        for batch in batches:
            keys, counts = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((last, total)))
            if len(keys):
                keys, counts = summed(keys, counts)
                yield _batch(keys[:-1], counts[:-1])
                last, total = keys[-1:], counts[-1:]
        yield _batch(last, total)

    small_batches(encoded.sparkSession)
    # written, so that sampling the ranges doesn't sum up once more
    parts = stored(encoded.select("links").mapInArrow(partial, _PAIRS), "partial")
    ranged = parts.repartitionByRange(tasks(encoded.sparkSession), "key").sortWithinPartitions("key")
    return stored(ranged.mapInArrow(runs, _PAIRS), "counts")


def with_counts(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """encoded, without links and times, with n_best and count_sum (long).  counts: of pair_counts() over these rows or
    others; a link that isn't among them counts 0."""
    spark = encoded.sparkSession
    highest = counts.groupBy(F.shiftright("key", 32).cast("int").alias("a")).agg(F.max("n").alias("n"))
    found = {row["a"]: row["n"] for row in highest.toLocalIterator()}  # at most one of each A id
    best = np.zeros(max(found, default=0) + 1, np.int64)
    best[list(found)] = list(found.values())
    uris, shared = tuple(counts.inputFiles()), spark.sparkContext.broadcast(best)
    kept = [c for c in encoded.columns if c not in ("links", "times", "n_best", "count_sum")]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, times = (batch.column(batch.schema.names.index(c)) for c in ("links", "times"))
            number = np.asarray(times.flatten().to_numpy(), np.int64)
            counted, highest = _shards(uris, shared.value).of(links.flatten().to_numpy())
            ends = np.cumsum(np.append(0, links.value_lengths().fill_null(0).to_numpy()))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])  # noqa: B023, E731
            new = [pa.array(total(x), pa.int64()) for x in (highest * number, counted * number)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in kept] + new, [*kept, "n_best", "count_sum"])

    small_batches(spark)
    return encoded.mapInArrow(run, schema)
