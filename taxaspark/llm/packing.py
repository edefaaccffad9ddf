"""Best-fit packing of tokenised documents, planned over the histogram of lengths.

The plan places counts of pieces, not pieces: lengths in falling order go to the fullest sequences
that still take them. Sequences filled alike are one group with consecutive numbers, so a step
moves a whole group or ends a length; the driver holds the histogram and the plan, both bounded by
the sequence length. Each piece gets its rank among the pieces of its length and takes the
planned slot of that rank.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, parts

#: Buckets that share the ranking of one length.
BUCKETS = 1024
#: Chunks whose ids a worker keeps; beyond, those that came once go, and the rarer half of the rest
#: if these are too many still. Only speed depends on it.
KEPT_CHUNKS = 400_000
#: Parts chunks that are encoded together; chunks that hold it are encoded alone.
MARK = b"\x01"


class _Encoder:
    """Ids of texts, chunk by chunk between ASCII white space, which the tokenizer drops and never
    crosses; a chunk that comes again is not encoded again."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._encode([MARK])[0].tolist()
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[n for word, n in words.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)
        self._add([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))  # before white space that begins a text

    def _forget(self) -> None:
        """Keep the chunks that came again."""
        seen = self.seen
        kept = seen > max(1, np.partition(seen, -KEPT_CHUNKS // 2)[-KEPT_CHUNKS // 2] if len(seen) > KEPT_CHUNKS // 2 else 1)
        kept[self.number[b""]] = True
        place = np.cumsum(kept) - 1
        self.number = {c: int(place[n]) for c, n in self.number.items() if kept[n]}
        size = np.diff(self.start)
        self.ids = self.ids[np.repeat(kept, size)]
        self.start = np.concatenate([[0], np.cumsum(size[kept])])
        self.seen = seen[kept] // 2

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """A chunk's case is lost anyway and a full stop or comma after a letter is a token of its
        own, so a chunk that differs only by these is put together from its plain form."""
        plain, made = set(), []
        for c in chunks:
            low = c if b"<" in c else c.lower()
            tail = low[-1] in b".," and len(low) > 1 and 97 <= low[-2] <= 122
            base = low[:-1] if tail else low
            if base != c:
                made.append((c, base, low[-1:] if tail else b""))
            if base not in self.number:
                plain.add(base)
        self._learn_plain(list(plain | {t for t in (b".", b",") if t not in self.number}))
        number = self.number
        number.update((c, number[base]) for c, base, tail in made if not tail)
        made = [x for x in made if x[2]]
        if made:
            n = np.fromiter((number[x[1]] for x in made), np.int64, len(made))
            tails = np.fromiter((self.ids[self.start[number[x[2]]]] for x in made), np.uint32, len(made))
            start, size = self.start[n], self.start[n + 1] - self.start[n]
            ends = np.cumsum(size + 1)
            ids = self.ids[np.minimum(np.repeat(start - ends + size + 1, size + 1) + np.arange(ends[-1]), len(self.ids) - 1)]
            ids[ends - 1] = tails
            self._add([x[0] for x in made], ids, size + 1)

    def _add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.start) - 1
        self.number.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.seen = np.concatenate([self.seen, np.zeros(len(chunks), np.int64)])

    def _learn_plain(self, chunks: list[bytes]) -> None:
        """Chunks of letters are one word each, whose last token is marked as a word's end; others
        are parted by a mark."""
        letters, others, alone = [], [], []
        for c in chunks:
            plain = c.isalpha() or unicodedata.normalize("NFC", c.decode()).lower().isalpha()
            (letters if plain else alone if MARK in c else others).append(c)
        for k in range(0, len(letters), 50_000):
            part = letters[k : k + 50_000]
            ids = self._joined(part, b" ")
            sizes = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            if len(sizes) == len(part):
                self._add(part, ids, sizes)
            else:  # a letter to one that isn't to the other
                others += part
        for k in range(0, len(others), 50_000):
            part = others[k : k + 50_000]
            ids = self._joined(part, b" " + MARK + b" ")
            sizes = np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1
            self._add(part, ids[ids != self.mark], sizes)
        for c, ids in zip(alone, self._encode(alone), strict=True):
            self._add([c], ids, np.array([len(ids)]))

    def _joined(self, chunks: list[bytes], sep: bytes) -> np.ndarray:
        return np.concatenate(self._encode([sep.join([*chunks[k : k + 1000], b""]) for k in range(0, len(chunks), 1000)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, one text after the other, and where each text's ids begin and end.

        Arrow splits and numbers the chunks of a batch, so only different ones are looked up.
        """
        if len(self.number) > KEPT_CHUNKS:
            self._forget()
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.binary()).to_pylist()
        numbers = list(map(self.number.get, chunks))
        if None in numbers:
            self.learn([c for c, n in zip(chunks, numbers, strict=True) if n is None])
            numbers = [self.number[c] if n is None else n for c, n in zip(chunks, numbers, strict=True)]
        n = np.array(numbers, np.int64)
        times = np.bincount(coded.indices.to_numpy(), minlength=len(n))
        self.seen += np.bincount(n, times, len(self.seen)).astype(np.int64)
        known = pa.LargeListArray.from_arrays(self.start, self.ids)
        taken = known.take(pa.array(n).take(coded.indices))
        offsets = split.offsets.to_numpy()
        return taken.values.to_numpy(), taken.offsets.to_numpy()[offsets - offsets[0]]


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each hold memory
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of ``docs(doc_id, text)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for batch in parts(whole, 1):
                docs = batch.column(0).to_pylist()
                ids, at = encoder.encode(batch.column(1).fill_null(""))
                rows = []
                for doc, first, end in zip(docs, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    coded = np.append(ids[first:end], np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(coded), length)):
                        part = coded[start : start + length]
                        rows.append((doc, n, start, len(part), zlib.crc32(part.tobytes())))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # an idle worker keeps only the encoder

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int]]]:
    """Slots of each length: (first rank, first sequence, offset), by rank.

    Ranks from one entry's first to the next's take consecutive sequences at one offset.
    """
    room: list[int] = []  # what is left in some sequences, sorted
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by it: (first sequence, how many)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if left:
            if not groups[left]:
                insort(room, left)
            groups[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        at = slots.setdefault(length, [])
        while count:
            k = bisect_left(room, length)
            if k < len(room):
                left = room[k]
                first, n = groups[left].pop()
                if not groups[left]:
                    room.pop(k)
                used = min(n, count)
                if n > used:
                    put(left, first + used, n - used)
            else:  # no sequence takes it: as many new ones as it fills, and perhaps one in part
                left, first = size, sequences
                used = max(1, count // (size // length))
                sequences += used
            at.append((rank, first, size - left))
            put(left - length, first, used)
            rank, count = rank + used, count - used
    return slots


def _ranked(df: DataFrame) -> DataFrame:
    """``df`` with rank, from 0, among the rows of its length. Buckets are ranked each by itself and
    then put one after the other, so a length that most rows share is spread."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    df = df.withColumn("bucket", bucket)
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    sizes = df.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = sizes.select("length", "bucket", before.alias("before"))
    return df.withColumn("own", own).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "bucket")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document's ids end with ``end_id``; null and empty texts have only that one. Longer ones are
    cut into pieces of ``length``. Repeated rows are packed as often as they come; other columns
    are ignored; a null doc_id is kept. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, length, end_id))
    counts = cutted.groupBy("length").count().collect()  # at most ``length`` rows
    slots = plan({r[0]: r[1] for r in counts}, length)
    schema = "length long, ranks array<long>, firsts array<long>, offsets array<long>"
    table = spark.createDataFrame([(k, *map(list, zip(*v, strict=True))) for k, v in slots.items()], schema)
    df = _ranked(cutted).join(F.broadcast(table), "length")
    k = F.size(F.filter("ranks", lambda x: x <= F.col("rank"))) - 1
    df = df.withColumn("k", k)
    sequence = F.get("firsts", "k") + F.col("rank") - F.get("ranks", "k")
    return df.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.get("offsets", "k").alias("offset"))
