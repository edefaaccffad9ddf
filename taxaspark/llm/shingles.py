"""Near copies by the exact Jaccard similarity of word shingles, without sampling.

Two texts that reach a similarity of t share at least t of either one's shingles. Shingles that one
text alone holds can't be among them, so a text with too many of its own leaves: first by those with
low digests, which are a fixed part of all, then by all. Of the others, sorted by how many texts hold
them, any two similar texts share one of the first n - ceil(t n) + 1 (prefix filter). Holders of such a shingle are compared with its first holder by their whole sets of shingles, then
with a few others drawn at random, as long as no link has joined them, and what is still apart then with
each other. A parity sketch of each set says at once which pairs differ in too much: two sketches differ in
no more bits than the sets do in shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import SPACE, cut, discard, lower_ascii
from taxaspark.llm.components import connected_components


def _shingles(text: bytes | None, size: int) -> np.ndarray:
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if n else [], "<u8")
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j]) for i, j in zip(start[: n - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, "<u8"))


def shingles(text: Column, size: int = 5) -> Column:
    """Sorted array of the distinct digests of ``size`` words in sequence; of all words if there are fewer."""

    def of(texts: pa.Array) -> pa.Array:
        found = [_shingles(x, size) for x in texts.cast(pa.binary()).to_pylist()]
        at = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.concatenate([*found, np.array([], "<u8")]).astype("<u8").view("<i8")
        return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))

    return F.arrow_udf(of, "array<bigint>")(text)


def sampled(text: Column, size: int = 5, share: float = 0.3) -> Column:
    """Struct (n, tokens): number of distinct shingles, and those whose digests lie in the lowest
    ``share`` of all digests."""
    limit = np.uint64(int(share * 2**64))

    def of(texts: pa.Array) -> pa.Array:
        n, found = [], [np.array([], "<u8")]
        for x in texts.cast(pa.binary()).to_pylist():
            own = _shingles(x, size)
            n.append(len(own))
            found.append(own[: np.searchsorted(own, limit)])
        at = np.cumsum([0, *map(len, found[1:])], dtype=np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view("<i8")))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), tokens], ["n", "tokens"])

    return F.arrow_udf(of, "struct<n:int,tokens:array<bigint>>")(text)


def without_loners(sets: DataFrame, spread: DataFrame, percent: int) -> DataFrame:
    """(key) of ``sets(key, n)`` that can be similar to another, by their shingles ``spread(key, token)``.

    Such a set has at most n - ceil(t n) shingles that no other set holds. All, or any fixed part of
    the digests may be given: a set of which too many are its own already then goes. Rows may repeat.
    """
    held = spread.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("last")).filter("key = last")
    own = held.groupBy("key").agg(F.count("*").alias("own"))
    left = sets.groupBy("key").agg(F.max("n").alias("n")).join(own, "key", "left")
    return left.filter((F.col("n") > 0) & (F.coalesce("own", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100))).select("key")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the nodes of the pairs ``(a, b)`` of sets that are similar."""
    one = sets.select(F.col("key").alias("a"), F.col("node").alias("u"), F.col("n").alias("m"), F.col("tokens").alias("left"))
    two = sets.select(F.col("key").alias("b"), F.col("node").alias("v"), "n", F.col("tokens").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(one, "a").join(two, "b").filter((100 + percent) * both >= percent * (F.col("m") + F.col("n"))).select("u", "v")


def similar_links(spread: DataFrame, keys: DataFrame, percent: int = 80, turns: int = 4) -> DataFrame:
    """Links ``(u, v)`` that join all sets of a similarity of ``percent`` hundredths or more.

    ``spread(key, n, token)``, stored: the shingles of each set and their number; ``keys(key, node)``,
    stored: the document that stands for a set. What is returned is stored. Links that others imply may be left out, so that components
    stay the same and large groups of near copies don't give all their pairs.
    """
    often = spread.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    least = F.ceil(F.col("n") * percent / 100)
    sets = spread.join(often, "token").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    sets = sets.filter(F.size("held") >= least).join(keys, "key")
    first = F.slice("held", 1, (F.size("held") - least + 1).cast("int"))
    sets = cut(sets.select("key", "node", "n", F.transform("held", lambda x: x["token"]).alias("tokens"), F.transform(first, lambda x: x["token"]).alias("first")).withColumn("sketch", sketch(F.col("tokens"))))
    posts = cut(sets.select("key", "node", "n", (F.col("n") - F.size("tokens")).alias("own"), "sketch", F.explode("first").alias("token")))
    links, tried = None, None
    for turn in range(turns):
        at = posts if links is None else _apart(posts, connected_components(links))
        order = F.col("node") if links is None else F.xxhash64("key", F.lit(turn))
        centre = at.groupBy("token").agg(F.min_by(F.struct("key", "n", "own", "sketch", *([] if links is None else ["root"])), F.struct(order, "key")).alias("c"), F.count("*").alias("df")).filter("df > 1")
        star = at.join(centre, "token").filter((F.col("key") != F.col("c.key")) & _near(percent))
        if links is not None:
            star = star.filter("root <> c.root")
        star = star.select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
        star = cut(star if tried is None else star.join(tried, ["a", "b"], "left_anti"))
        if links is not None:
            discard(at)
        if star.isEmpty() and links is not None:
            break
        new = cut(_similar(star, sets, percent))
        links, tried = (new, star) if links is None else (links.unionByName(new), tried.unionByName(star))
    at = _apart(posts, connected_components(links))
    other = at.select("token", F.col("key").alias("b"), F.struct("n", "own", "sketch", "root").alias("c"))
    cross = at.join(other, "token").filter((F.col("root") < F.col("c.root")) & _near(percent))
    cross = cross.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(cut(_similar(cross, sets, percent)))
    discard(sets, posts, at)
    return links


#: Longs of a parity sketch.
SKETCH = 16


def sketch(tokens: Column) -> Column:
    """Array of longs: a bit for each residue of the tokens, set if an odd number of them has it."""
    bits = 64 * SKETCH
    place = F.transform(tokens, lambda x: F.pmod(F.shiftright(x, 7), F.lit(bits)))
    word = lambda k: F.aggregate(F.filter(place, lambda p: F.shiftright(p, 6) == k), F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))))
    return F.array(*[word(k) for k in range(SKETCH)])


def _near(percent: int) -> Column:
    """Whether a set's and its counterpart c's sizes, own shingles and sketches allow the similarity: own
    ones and those that the sketches tell apart are shingles in which the two differ."""
    n, m = F.col("n"), F.col("c.n")
    differ = F.aggregate(F.zip_with("sketch", "c.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * (differ + F.col("own") + F.col("c.own")) <= (100 - percent) * (n + m))


def _apart(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """``posts`` with the root of each, of the tokens whose holders aren't all joined; stored."""
    at = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = at.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("token")
    return cut(at.join(mixed, "token", "left_semi"))


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, groups: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with an id: doc_id, component_id.

    Texts are linked if their sets of ``size`` words in sequence (ASCII case ignored) have a Jaccard
    similarity of ``percent`` hundredths or more; component_id is the smallest doc_id reachable. Null
    and empty texts have the empty set and are linked with each other. ``groups(doc_id, component_id)``,
    one row per row, gives links that are known already; texts that differ only in case and white space
    must be in one group.
    """
    plain = F.trim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), SPACE, " "))
    docs = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64(plain).alias("key"))
    found = cut(docs.select("doc_id", "key", sampled(F.col("text"), size).alias("s")).select("doc_id", "key", "s.n", "s.tokens"))
    ids = cut(found.select("doc_id", "key"))
    keys = cut(ids.groupBy("key").agg(F.min("doc_id").alias("node")))
    left = without_loners(found, found.select("key", F.explode("tokens").alias("token")), percent)
    firsts = docs.withColumnRenamed("doc_id", "node").join(keys.join(left, "key", "left_semi"), ["key", "node"], "left_semi")
    sets = firsts.select("key", shingles(F.col("text"), size).alias("tokens")).dropDuplicates(["key"])
    every = cut(sets.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    discard(found)
    spread = cut(every.join(without_loners(every, every, percent), "key", "left_semi"))
    discard(every)
    links = similar_links(spread, keys, percent)
    discard(spread)
    if groups is not None:
        known = groups.withColumnRenamed("doc_id", "u").join(keys.select(F.col("node").alias("u")), "u", "left_semi")
        links = links.unionByName(known.filter("u <> component_id").select("u", F.col("component_id").alias("v")).distinct())
    roots = connected_components(links)
    groups = keys.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    return ids.join(groups, "key").select("doc_id", "component_id")
