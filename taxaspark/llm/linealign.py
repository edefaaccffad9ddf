"""Line dedup by pairwise alignment.

Overlapping documents are found through the digests of the lines they share, rare ones first: each
later holder of a line that few documents hold is paired with the line's first holder. The line digests
of each pair are aligned with patience diff (lines unique in both, in longest increasing order, then
what lies between them; a longest common subsequence where there are none), and the aligned common
blocks are deleted from the later document, together with the other places of their lines in it. Then
the same is done with all lines that are left, however many documents hold them, for the pairs that
were not aligned yet, so a line held by n documents gives at most n - 1 pairs. Then every document that still has a line is paired with the one
before it that has it too, but for the line's first holder, and what is left of the two is aligned,
until no pair aligns. As a line's first holder never loses it, one copy of every line stays.

A document that many others are paired with is sent once for each of their parts, not for each of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, text_key


def line_digests(text: Column, min_words: int) -> Column:
    """A long per line; odd for lines of ``min_words`` words or more, even for others.

    63 bits decide: two different lines agree with a chance of 1e-19.
    """
    long_line = r"^\s*(\S+\s+){" + str(min_words - 1) + r"}\S"

    def one(line: Column) -> Column:
        return F.shiftleft(F.xxhash64(F.trim(line)), 1) + F.when(line.rlike(long_line), 1).otherwise(0)

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs``, sorted by the first number, that increases in the second."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1] = [y]
        at[n : n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


#: Bits of the table that :func:`common` keeps at once; beyond, it halves the second sequence first.
TABLE_BITS = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each of ``b``: a bit per place in ``a``, unset where the common subsequence grows."""
    place: dict[int, int] = {}
    for k, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for x in b:
        u = row & place.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` and each beginning of ``a``."""
    *_, row = (1 << len(a)) - 1, *deque(_rows(a, b), 1)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (i, j) of a longest common subsequence."""
    both = set(a) & set(b)
    at_a, at_b = ([k for k, x in enumerate(s) if x in both] for s in (a, b))
    a, b = [a[k] for k in at_a], [b[k] for k in at_b]
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        if i == m or j == n:
            continue
        if n - j > 1 and (m - i) * (n - j) > TABLE_BITS:
            h = (j + n) // 2
            at = i + int(np.argmax(_lengths(a[i:m], b[j:h]) + _lengths(a[i:m][::-1], b[h:n][::-1])[::-1]))
            todo += [(i, at, j, h), (at, m, h, n)]
            continue
        rows, x, y = list(_rows(a[i:m], b[j:n])), m - i, n - j
        while x and y:
            if rows[y - 1] >> (x - 1) & 1:
                x -= 1
            else:
                y -= 1
                if not y or rows[y - 1] >> (x - 1) & 1:
                    x -= 1
                    found.append((at_a[i + x], at_b[j + y]))
    return sorted(found)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if once_b[x] == 1}
        anchors = _increasing([(k, place[x]) for k, x in enumerate(a[i:m], i) if once_a[x] == 1 and x in place])
        if not anchors:
            found += [(i + x, j + y) for x, y in common(a[i:m], b[j:n])]
            continue
        found += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(found)


def aligned_lines(a: list[int], b: list[int]) -> list[int]:
    """Lines of ``b`` in aligned blocks that hold a line of enough words, and where else such lines stand in ``b``."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if any(b[y] & 1 for _, y in block):
                out += [y for _, y in block]
            block = []
        block.append((i, j))
    again = {b[y] for y in out if b[y] & 1}
    return sorted({*out, *(y for y, x in enumerate(b) if x in again)})


#: Holders of a line are packed into so many groups before they are shuffled by the line.
LINE_BUCKETS = 512
#: Documents that one copy of their partner serves.
SERVED = 256
#: Digests that a task turns into Python values at once, or one longer document.
DIGESTS = 1 << 19
DOC = "struct<doc_id:bigint,text_key:bigint>"


def later_holders(lines: DataFrame) -> DataFrame:
    """(doc, line, first, n): every later holder of a line of enough words, with the line's first holder
    and the number of all.

    ``lines(doc, digests)``, stored; doc is a struct that sorts by rank. What is shuffled by the line is
    at most ``LINE_BUCKETS`` rows for each, however many documents hold it.
    """
    spread = lines.select("doc", F.explode(F.filter(F.array_distinct("digests"), lambda x: F.pmod(x, F.lit(2)) == 1)).alias("line"))
    bucket = F.pmod(F.xxhash64("doc"), F.lit(LINE_BUCKETS))
    packed = spread.groupBy("line", bucket.alias("bucket")).agg(F.collect_list("doc").alias("docs"))
    first = packed.groupBy("line").agg(F.min(F.array_min("docs")).alias("first"), F.sum(F.size("docs")).alias("n")).filter("n > 1")
    later = packed.join(first, "line").select("line", "first", "n", F.explode("docs").alias("doc"))
    return later.filter("doc <> first").select("doc", "line", "first", "n")


def rest_aligned(a: list[int], b: list[int], gone_b: list[int] | None) -> list[int]:
    """As :func:`aligned_lines`, of what is left of ``b``."""
    gone = set(gone_b or ())
    at = [k for k in range(len(b)) if k not in gone]
    return [at[k] for k in aligned_lines(a, [b[k] for k in at])]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(ends):
        end = max(k + 1, int(np.searchsorted(ends, DIGESTS + (ends[k - 1] if k else 0), "right")))
        yield batch.slice(k, end - k)
        k = end


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (partner, part, doc, digests, gone), sorted: a partner's own comes before those it serves."""
    a, own = [], None
    for whole in batches:
        for batch in _slices(whole, 3):
            docs, partners, found, held = [], [], [], []
            for partner, doc, digests, gone in zip(*(batch.column(c).to_pylist() for c in ("partner", "doc", "digests", "gone")), strict=True):
                if doc is None:
                    lost = set(gone or ())
                    own, a = partner, [x for k, x in enumerate(digests) if k not in lost]
                    continue
                assert partner == own
                lines = rest_aligned(a, digests, gone)
                if lines:
                    docs.append(doc)
                    partners.append(partner)
                    found.append(lines)
                    held.append(list({digests[k] for k in lines if digests[k] & 1}))
            pair = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pair), pa.array(partners, pair), pa.array(found, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))], ["doc", "partner", "lines", "held"])


def _gone(pairs: DataFrame, lines: DataFrame, before: DataFrame | None) -> DataFrame:
    """(doc, partner, lines, held): what each of ``pairs(doc, partner)``, stored, aligns beyond ``before``."""
    if before is None:
        lines = lines.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        lines = lines.join(before.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone")), "doc", "left")
    served = pairs.groupBy("partner").agg(F.ceil(F.count("*") / SERVED).alias("parts"))
    a = served.select("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(lines.withColumnRenamed("doc", "partner"), "partner")
    b = pairs.join(served, "partner").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).join(lines, "doc")
    both = a.select("partner", "part", F.lit(None).cast(DOC).alias("doc"), "digests", "gone").unionByName(b.select("partner", "part", "doc", "digests", "gone"))
    both = both.repartition("partner", "part").sortWithinPartitions("partner", "part", F.asc_nulls_first("doc"))
    return cut(both.mapInArrow(_align, f"doc {DOC}, partner {DOC}, lines array<int>, held array<bigint>"))


def _left(holders: DataFrame, new: DataFrame) -> DataFrame:
    """``holders(doc, line, ...)`` without the lines that ``new`` takes from them."""
    return cut(holders.join(new.select("doc", F.explode("held").alias("line")).distinct(), ["doc", "line"], "left_anti"))


def aligned(docs: DataFrame, min_words: int = 3, rare: int = 32) -> DataFrame:
    """(doc_id, text_key, partners, lines): what the later documents lose; lines counts from 0."""
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    lines = cut(docs.filter("doc_id is not null").select(doc.alias("doc"), line_digests(F.col("text"), min_words).alias("digests")).distinct())
    left = cut(later_holders(lines))
    with_first = lambda df: df.select("doc", F.col("first").alias("partner")).distinct()
    pairs = cut(with_first(left.filter(F.col("n") <= rare)))
    gone = _gone(pairs, lines, None)
    left = _left(left, gone)
    new = _gone(cut(with_first(left).join(pairs, ["doc", "partner"], "left_anti")), lines, gone)
    left, gone = _left(left, new), gone.unionByName(new)
    while not left.isEmpty():
        pairs = left.withColumn("partner", F.lag("doc").over(Window.partitionBy("line").orderBy("doc")))
        new = _gone(cut(pairs.filter("partner is not null").select("doc", "partner").distinct()), lines, gone)
        if new.isEmpty():
            break
        left, gone = _left(left, new), gone.unionByName(new)
    return gone.groupBy("doc").agg(F.size(F.collect_set("partner")).cast("long").alias("partners"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")).select("doc.*", "partners", "lines")


def without_lines(text: Column, lines: Column) -> Column:
    def of(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            if text is not None and drop:
                lost = set(drop)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost)
            out.append(text)
        return pa.array(out, pa.string())

    return F.arrow_udf(of, "string")(text, lines)


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, partners, removed_lines, deduped) of every row of ``docs``, whatever its columns are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = aligned(docs.select("doc_id", "text"), min_words)
    gone = gone.select(F.struct(*gone.columns).alias("gone"))
    df = rows.join(gone, (F.col("row.doc_id") == F.col("gone.doc_id")) & (text_key(F.col("row.text")) == F.col("gone.text_key")), "left")
    df = df.select("row", F.coalesce("gone.partners", F.lit(0).cast("long")).alias("partners"), F.coalesce("gone.lines", F.array().cast("array<int>")).alias("removed_lines"))
    return df.withColumn("deduped", without_lines(F.col("row.text"), F.col("removed_lines")))


def line_dedup(docs: DataFrame, min_words: int = 3) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` with partners, removed_lines and deduped added, in place of
    columns of these names.

    Documents rank by doc_id, then by their text's digest. removed_lines: positions (from 0) of the
    lines deleted from the row's text; partners: with how many earlier documents blocks aligned;
    deduped: the text without them. A block is deleted if one of its lines has ``min_words`` words
    or more. Rows with one doc_id and text are one document, returned as often as they come; rows
    with a null doc_id, a null or an empty text stay as they are.
    """
    added = ("partners", "removed_lines", "deduped")
    return _marked(docs, min_words).select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added], *added)


def dedup_documents(docs: DataFrame, min_words: int = 3) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` with their text deduped and n_chars, if there is one, made to
    fit; those that lose all their words go. Other columns come back as they are, whatever their names.
    Nulls, empty texts and repeated rows: as :func:`line_dedup` has them."""
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("deduped")}
    if "n_chars" in own:
        own["n_chars"] = F.length("deduped").cast("long")
    left = (F.size("removed_lines") == 0) | F.col("deduped").rlike(r"[^\x20\x09-\x0D]")
    return _marked(docs, min_words).filter(left).select(*[v.alias(k) for k, v in own.items()])
