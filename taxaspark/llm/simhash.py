"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray sequence, so that neighbours share
long bit patterns. Sixty-four neighbours form a leaf; leaves form upper nodes, level by level.
A node keeps the bits on which all fingerprints below agree (``mask``) and their values
(``pattern``). Two nodes whose patterns differ in more than the allowed number of bits under both
masks cannot hold a link, and the whole pair of subtrees is dropped. The join of the index
with itself descends from the roots by equi-joins on the parent's number; only pairs of leaves
that survive are compared fingerprint by fingerprint. Nothing is broadcast by hand and no
fingerprint reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, no_shuffle_left
from taxaspark.llm.components import connected_components
from taxaspark.llm.shingles import near_copies

#: Bits of a position number that count rows within a partition.
ROW_BITS = 33
LEAF_BITS, FAN_BITS = 6, 5
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def _fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, seed)]
    else:
        length = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(length + 1) - 1
        start = end - length
        hashes = [digest(joined[i:j], seed) for i, j in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k : k + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash as a long; zero for null and for texts without words."""

    def of(texts: pa.Array) -> pa.Array:
        found = (_fingerprint(x, shingle, seed) for x in texts.cast(pa.binary()).to_pylist())
        return pa.array(np.fromiter(found, "<u8", len(texts)).view("<i8"))

    return F.arrow_udf(of, "long")(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def gray_rank(fp: Column) -> Column:
    """Position in the reflected Gray sequence, shifted so that the signed order is the rank's."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _masked(group) -> DataFrame:
    """Groups of rows with columns ones (bits set in all) and some (bits set in any), summed up."""
    return group.agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))


def _node(df: DataFrame, prefix: str, parent_shift: int, shift: int) -> DataFrame:
    mask = F.bitwise_not(F.col("some").bitwiseXOR(F.col("ones")))
    up = F.shiftright("id", parent_shift - shift) if parent_shift < 63 else F.lit(0).cast("long")
    return df.select(up.alias(f"{prefix}_up"), F.col("id").alias(f"{prefix}_id"), mask.alias(f"{prefix}_mask"), F.col("ones").bitwiseAND(mask).alias(f"{prefix}_pattern"))


def gray_index(nodes: DataFrame, per_partition: int = 1 << 15) -> tuple[DataFrame, list[int]]:
    """``nodes(fp, node)``, stored and with distinct fp, to the leaves of the index and the
    shifts that give the number of a leaf's ancestor at each level, top first."""
    with no_shuffle_left(nodes.sparkSession):
        parts = max(1, -(-nodes.count() // per_partition))
    at = nodes.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    at = at.withColumn("pos", F.monotonically_increasing_id())
    leaves = at.groupBy(F.shiftright("pos", LEAF_BITS).alias("id")).agg(
        F.collect_list(F.struct("fp", "node")).alias("members"), F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
    leaves = cut(leaves)
    with no_shuffle_left(nodes.sparkSession):
        low, high = leaves.agg(F.max(F.col("id").bitwiseAND(F.lit((1 << (ROW_BITS - LEAF_BITS)) - 1))), F.max(F.shiftright("id", ROW_BITS - LEAF_BITS))).first()
    shifts = [LEAF_BITS]
    while ((low or 0) << LEAF_BITS) >> shifts[-1] >= 1 << FAN_BITS:
        shifts.append(shifts[-1] + FAN_BITS)
    shifts.append(ROW_BITS)
    while (high or 0) >> (shifts[-1] - ROW_BITS) >= 1 << FAN_BITS:
        shifts.append(shifts[-1] + FAN_BITS)
    return leaves, shifts[::-1]


def leaf_pairs(leaves: DataFrame, shifts: list[int], max_distance: int) -> DataFrame:
    """Pairs ``(a, b)`` of leaves, a <= b, whose patterns allow a link; a node's pair is dropped
    as a whole when the accumulated differences under both masks exceed the distance."""
    spark = leaves.sparkSession
    pairs, above = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), 63
    for shift in shifts:
        level = leaves.select("id", "ones", "some")
        if shift > LEAF_BITS:
            level = _masked(level.groupBy(F.shiftright("id", shift - LEAF_BITS).alias("id")))
        one, two = _node(level, "x", above, shift), _node(level, "y", above, shift)
        differ = F.bit_count(F.col("x_pattern").bitwiseXOR(F.col("y_pattern")).bitwiseAND(F.col("x_mask")).bitwiseAND(F.col("y_mask")))
        pairs = pairs.join(one, F.col("a") == F.col("x_up")).join(two, (F.col("b") == F.col("y_up")) & (F.col("x_id") <= F.col("y_id")) & (differ <= max_distance))
        pairs, above = pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), shift
    return pairs


def _links(max_distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.setdefault(x, x)) != x:
                    root[x] = x = root[up]
                return x

            us, vs = [], []
            sides = []
            for c in ("left", "right"):
                col = batch.column(c)
                flat = col.flatten()
                sides.append((col.offsets.to_numpy() - col.offsets[0].as_py(), flat.field("fp").to_numpy(), flat.field("node").to_numpy()))
            (lo, lf, ln), (ro, rf, rn) = sides
            for k in range(batch.num_rows):
                i, j, m, n = lo[k], lo[k + 1], ro[k], ro[k + 1]
                near = np.bitwise_count((lf[i:j, None] ^ rf[None, m:n]).view(np.uint64)) <= max_distance
                for x, y in zip(*np.nonzero(near), strict=True):
                    u, v = int(ln[i + x]), int(rn[m + y])
                    p, q = find(u), find(v)
                    if p != q:  # only links that join what this batch has not yet joined
                        root[max(p, q)] = min(p, q)
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return compare


def near_links(nodes: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links ``(u, v)`` between nodes whose fingerprints differ in at most ``max_distance`` bits.

    ``nodes(fp, node)``: distinct fingerprints, stored. Links that a batch's other links imply
    are left out, so that components stay the same and dense groups don't give all their pairs.
    """
    leaves, shifts = gray_index(nodes)
    pairs = leaf_pairs(leaves, shifts, max_distance)
    full = leaves.select(F.col("id"), "members")
    pairs = pairs.join(full.select(F.col("id").alias("a"), F.col("members").alias("left")), "a")
    pairs = pairs.join(full.select(F.col("id").alias("b"), F.col("members").alias("right")), "b").select("left", "right")
    return pairs.mapInArrow(_links(max_distance), "u long, v long")


def near_duplicates(docs: DataFrame, max_distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (long), component_id.

    Fingerprints that differ in at most ``max_distance`` bits are linked; component_id is the
    smallest doc_id reachable. Equal fingerprints are one node, so copies give no pairs. Null
    and empty texts have fingerprint zero and are linked like others. A null doc_id names no
    node: such a row gets the component of the other rows with its fingerprint, or null.
    Repeated rows are returned as often as they come; other columns are ignored.
    """
    marked = cut(docs.select("doc_id", fingerprint(F.col("text"), shingle, seed).alias("fp")))
    nodes = cut(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(near_links(nodes, max_distance))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_first_of_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` whose doc_id is its component's smallest, with all their columns.

    Documents are linked as in :func:`near_duplicates`, by fingerprints. A fingerprint says little about a
    similarity of 0.8, so the exact similarity of :func:`shingles.near_copies` follows and links what the
    fingerprints leave apart. Of rows that repeat a doc_id one stays: the one with the least text digest
    and, of these, the first as JSON. Null and empty texts are alike, so one of these stays. Rows with a
    null doc_id stay, as they can't be told apart.
    """
    groups = cut(near_duplicates(docs.filter("doc_id is not null")).select("doc_id", "component_id"))
    found = near_copies(docs, shingle, percent, groups)
    lost = found.filter("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    again = cut(again.join(lost, "doc_id", "left_anti"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(lost.unionByName(again), "doc_id", "left_anti").select(*columns)
    row = F.struct(*columns)
    rows = docs.join(again, "doc_id", "left_semi").select("doc_id", row.alias("row"))
    first = rows.groupBy("doc_id").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), F.to_json("row"))).alias("row"))
    return kept.unionByName(first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
