"""Links between weighted sets of a Jaccard similarity, and the components they make, without listing the pairs within a component.

A set is (id, total, items): its weight, and the elements that other sets hold too. Elements are ordered by how many sets hold them, rarest first, so
whatever very many sets share stands last. Two sets that reach the threshold share an element of both prefixes, and their first common
element leaves enough weight behind it in both: by all that is left (positional filter), and by eight hash ranges of what is left,
range by range (suffix filter). Those bounds are part of the joins' conditions, so pairs that fail them are never written.

Sets of one component need no comparison. Rounds compare each list of an element with one pivot, the set that has least before it, and merge what is
linked; as long as rounds merge a tenth of what is left they go on. Then all pairs of different components that the filters let through are
compared. Nothing is capped, and each pair is compared once.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.session import release, stored

#: Hash ranges of the suffix filter, and the steps that a range's share of the total is rounded up to.
RANGES, STEPS = 8, 65535
#: Rounds with pivots go on while they merge this share of the roots that still share a list.
WORTHWHILE = 0.1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the links; the root is the smallest node of its connected component.

    Each round gives every node the smallest root around it and then jumps from root to root, so a chain of n links takes about
    log n rounds; the rounds stop when nothing changes. Every round's labels are written to the shared folder.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionAll(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    edges = stored(both.distinct(), "component-edges")
    moved = stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "component-labels")
    labels = moved
    while True:
        around = (edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node"))
                  .agg(F.min("root").alias("near")))
        lower = labels.join(around, "node", "left").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("beyond"))
        # A root hears of the smallest root that any node of its own has met.
        hooks = lower.where("new < root").groupBy(F.col("root").alias("new")).agg(F.min("new").alias("hook"))
        following = (lower.join(jump, "new", "left").join(hooks, "new", "left")
                     .select("node", F.least("new", "beyond", "hook").alias("new_root"), "root"))
        before, moved = moved, stored(following, "component-labels")
        release(before)
        labels = moved.select("node", F.col("new_root").alias("root"))
        if moved.where("new_root <> root").isEmpty():
            release(edges)
            return labels


def shared_items(items: DataFrame) -> DataFrame:
    """(id, items) from rows (id, h, ...), one for each element of a set: the elements that two or more sets hold, rarest first.

    Frequencies are counted exactly, over the given sets.
    """
    common = items.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rest = [c for c in items.columns if c not in ("id", "h")]
    return items.join(common, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "h", *rest))).alias("items"))


def _chunks(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, stop
        at = stop


def prefix_entries(h: np.ndarray, w: np.ndarray, lengths: np.ndarray, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements in the prefix of their set: which ones, their rows, the weight from each on, and that weight by hash range (packed in two words).

    ``h`` and ``w`` are the elements of all rows one after the other, rarest first.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    held = np.zeros((len(h), RANGES))
    held[np.arange(len(h)), (h >> np.uint64(61)).astype(np.int64)] = w
    after = np.vstack([np.cumsum(held[::-1], 0)[::-1], np.zeros((1, RANGES))])
    by_range = after[:-1] - after[ends[row]] if len(h) else held
    rest = by_range.sum(1)
    inside = np.flatnonzero(rest >= (threshold - 1e-9) * total[row])
    share = np.minimum(np.ceil(by_range[inside] / total[row[inside], None] * STEPS - 1e-6) + 1e-9, STEPS).astype(np.uint64)
    words = [share[:, k] | share[:, k + 1] << np.uint64(16) | share[:, k + 2] << np.uint64(32) | share[:, k + 3] << np.uint64(48) for k in (0, 4)]
    return inside, row[inside], rest[inside], np.stack(words, 1)


def _entries(threshold: float):
    kind = pa.struct([("h", pa.int64()), ("rest", pa.float64()), ("s1", pa.int64()), ("s2", pa.int64())])

    @F.arrow_udf("array<struct<h:bigint,rest:double,s1:bigint,s2:bigint>>")
    def entries(h: pa.Array, w: pa.Array, total: pa.Array) -> pa.Array:
        lengths, totals = np.asarray(h.value_lengths(), np.int64), np.asarray(total, np.float64)
        hashes = np.asarray(h.flatten(), np.int64).view(np.uint64)
        weights = np.asarray(w.flatten(), np.float64) if len(w.flatten()) else np.ones(len(hashes))
        starts, out = np.append(0, np.cumsum(lengths)), []
        for a, b in _chunks(lengths):
            part = slice(starts[a], starts[b])
            at, row, rest, words = prefix_entries(hashes[part], weights[part], lengths[a:b], totals[a:b], threshold)
            values = pa.StructArray.from_arrays([pa.array(hashes[part][at].view(np.int64)), pa.array(rest), pa.array(words[:, 0].view(np.int64)),
                                                 pa.array(words[:, 1].view(np.int64))], fields=list(kind))
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=b - a))).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), values))
        return pa.concat_arrays(out or [pa.array([], pa.list_(kind))])
    return entries


def may_reach(threshold: float) -> Column:
    """Whether the sets of the entries ``l`` and ``r``, which share the element they stand for, may reach the threshold if it is their first common one."""
    needed = (F.col("l.total") + F.col("r.total")) * (threshold / (1 + threshold) * (1 - 1e-9))
    length = F.least("l.total", "r.total") >= F.greatest("l.total", "r.total") * (threshold - 1e-9)
    position = F.least("l.rest", "r.rest") >= needed
    part = lambda side, k: F.shiftrightunsigned(F.col(f"{side}.s{1 + k // 4}"), 16 * (k % 4)).bitwiseAND(F.lit(STEPS)) * (F.col(f"{side}.total") / STEPS)
    suffix = sum((F.least(part("l", k), part("r", k)) for k in range(RANGES)), F.lit(0.0)) >= needed
    return length & position & suffix


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def find_links(sets: DataFrame, threshold: float, verify: Callable[[DataFrame], DataFrame], roots: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that, with those behind ``roots``, connect all sets (id, total, h, w) that links of the threshold connect.

    ``h`` and ``w`` are arrays of elements and weights, rarest first; an empty ``w`` stands for weights of 1. ``verify`` adds ``linked`` to pairs (a, b).
    ``roots`` (id, root) says which sets are known to be connected. The result holds enough links for that, not all there are.
    """
    entries = stored(sets.select("id", "total", F.explode(_entries(threshold)("h", "w", "total")).alias("e")).select("id", "total", "e.*"), "link-entries")
    labels = roots if roots is not None else sets.select("id", F.col("id").alias("root"))
    links, compared, whole = None, None, False
    while True:
        rooted = entries.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # After a round, the two members of a list of two have met.
        least = 1 if compared is None else 2
        lists = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > least))
        open_entries = stored(rooted.join(lists.select("h"), "h"), "link-open")
        if open_entries.isEmpty():
            release(open_entries)
            break
        left, right = open_entries.alias("l"), open_entries.alias("r")
        other = (F.col("l.h") == F.col("r.h")) & (F.col("l.root") != F.col("r.root")) & may_reach(threshold)
        if whole:
            pairs = _pairs(left.join(right, other & (F.col("l.id") < F.col("r.id"))))
        else:
            central = F.struct(F.col("rest") / F.col("total"), F.xxhash64("id"))
            pivots = open_entries.groupBy("h").agg(F.max_by(F.struct("id", "total", "rest", "s1", "s2", "root"), central).alias("p")).select("h", "p.*")
            pairs = _pairs(left.join(pivots.alias("r"), other))
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        met = stored(verify(pairs), "link-pairs")
        compared = met.select("a", "b") if compared is None else compared.unionAll(met.select("a", "b"))
        new = met.where("linked").select("a", "b")
        links = new if links is None else links.unionAll(new)
        if whole:
            release(open_entries)
            break
        at = labels.select(F.col("id").alias("a"), F.col("root").alias("u")), labels.select(F.col("id").alias("b"), F.col("root").alias("v"))
        merged = stored(new.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b")).distinct(), "link-merged")
        n_merged = 0
        if not merged.isEmpty():
            over = components(merged)
            n_merged = over.where("node <> root").count()
            everyone = entries.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("node"))
            labels = stored(everyone.join(over, "node", "left").select("id", F.coalesce("root", "node").alias("root")), "link-labels")
        whole = n_merged < WORTHWHILE * open_entries.select("root").distinct().count()
        release(merged, open_entries)
    if links is None:
        links = stored(entries.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "link-pairs")
    release(entries)
    return links
