"""Near duplicates by consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is the weighted set of its five-word shingles. The weight is (1 + ln tf) * idf, where idf runs from 1 (in every document) to
``MOST_IDF`` (in one). The range is narrow on purpose: with plain idf the copies of a text that holds a third of all documents would be
told apart by their few edits alone. Document frequencies are counted over all documents in ``2**IDF_BITS`` hashed cells, so the table
that goes to every task has a fixed size (1 MB) whatever the corpus is.

Defined results: a null text is never a duplicate; texts without a word are duplicates only if equal; equal texts always share a
class; a class is named by its smallest non-null id (null if it has none). Repeated ids and rows stay rows of their own.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.linking import components, find_links, shared_items
from echolens.llm.words import mix, shingles, slices, split_words
from echolens.session import release, stored

WIDTH = 5
IDF_BITS = 18
MOST_IDF = 1.2
#: A pair of similarity s shares at least one of the bands with probability 1 - (1 - s**ROWS)**BANDS: 0.9992 at 0.8.
BANDS, ROWS = 10, 3
THRESHOLD = 0.8

# Sampling variables of the shingles: r and c from Gamma(2, 1), beta uniform, drawn once for 2**16 cells per table.
_POOL_BITS = 16
_RANDOM = np.random.Generator(np.random.PCG64(1903))
_U = _RANDOM.random((5, 1 << _POOL_BITS)) * (1 - 2e-12) + 1e-12
POOL_R = (-np.log(_U[0] * _U[1])).astype(np.float32)
POOL_LN_C = np.log(-np.log(_U[2] * _U[3])).astype(np.float32)
POOL_BETA = _U[4].astype(np.float32)
SALTS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each of the hashed cells, and the number of documents. Every task sums its rows first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch.column(0)):
                h, row = shingles(split_words(part), WIDTH)
                pairs = np.unique((row.astype(np.uint64) << np.uint64(IDF_BITS)) | (h >> np.uint64(64 - IDF_BITS)))
                cells += np.bincount((pairs & np.uint64((1 << IDF_BITS) - 1)).astype(np.int64), minlength=1 << IDF_BITS)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(cells[used], n))], ["cell", "n"])

    counts = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table, total = np.zeros(1 << IDF_BITS, np.int64), 0
    for row in counts.collect():  # at most 2**IDF_BITS + 1 rows
        if row["cell"] < 0:
            total = row["n"]
        else:
            table[row["cell"]] = row["n"]
    return table, total


def idf_table(frequencies: np.ndarray, total: int) -> np.ndarray:
    rarity = np.log((total + 1) / (frequencies + 1)) / np.log(total + 2)
    return (1 + (MOST_IDF - 1) * rarity).astype(np.float32)


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, rows and weights, each shingle once per row, ordered by row."""
    h, row = shingles(split_words(texts), WIDTH)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(h)))
    h, row = h[at], row[at]
    return h, row, (1 + np.log(tf.astype(np.float32))) * idf[(h >> np.uint64(64 - IDF_BITS)).astype(np.int64)]


def band_keys(texts: pa.Array, idf: np.ndarray) -> pa.Array:
    """array<bigint> with one key per band; null where the text has no word."""
    h, row, weight = weighted_sets(texts, idf)
    held = np.unique(row)
    starts = np.searchsorted(row, held)
    sizes = np.diff(np.append(starts, len(row)))
    ln_w = np.log(weight)
    sampled = np.empty((BANDS * ROWS, len(held)), np.uint64)
    step = 1 << 15
    for i, salt in enumerate(SALTS):
        ln_a, t = np.empty(len(h), np.float32), np.empty(len(h), np.float32)
        for k in range(0, len(h), step):  # work arrays that fit the cache
            cell = ((h[k:k + step] * salt) >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
            r, beta = POOL_R[cell], POOL_BETA[cell]
            t[k:k + step] = np.floor(ln_w[k:k + step] / r + beta)
            ln_a[k:k + step] = POOL_LN_C[cell] - r * (t[k:k + step] - beta) - r
        least = np.minimum.reduceat(ln_a, starts) if len(h) else ln_a
        hit = np.flatnonzero(ln_a == np.repeat(least, sizes))
        hit = hit[np.unique(row[hit], return_index=True)[1]]  # ties: the smallest shingle
        sampled[i] = mix(h[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys = np.zeros((len(held), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(held), b + 1, np.uint64)
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sampled[b * ROWS + j])
        keys[:, b] = key
    lengths = np.zeros(len(texts), np.int64)
    lengths[held] = BANDS
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)),
                                    mask=pa.array(lengths == 0))


def similarities(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity row by row: the sum of smaller over the sum of larger weights."""
    n = len(left)
    a, b = weighted_sets(left, idf), weighted_sets(right, idf)
    total = np.bincount(a[1], a[2], n) + np.bincount(b[1], b[2], n)
    h, row, w = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((h, row))
    h, row, w = h[order], row[order], w[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    common = np.bincount(row[both], np.minimum(w[both], w[both + 1]), n)
    return np.divide(common, total - common, out=np.zeros(n), where=total > 0)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _banded(idf: np.ndarray):
    @F.arrow_udf("array<bigint>")
    def bands(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([band_keys(part, idf) for part in slices(texts)] or [pa.array([], pa.list_(pa.int64()))])
    return bands


def _compared(idf: np.ndarray):
    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in slices(left):
            other = right.slice(at, len(part)).cast(pa.large_string())
            out.append(similarities(part, other, idf))
            at += len(part)
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return similarity


def _weighted(idf: np.ndarray):
    kind = pa.struct([("h", pa.int64()), ("w", pa.float32())])

    @F.arrow_udf("array<struct<h:bigint,w:float>>")
    def items(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            h, row, weight = weighted_sets(part, idf)
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(part)))).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(weight)], fields=list(kind))))
        return pa.concat_arrays(out or [pa.array([], pa.list_(kind))])
    return items


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) once for each of ``keys``."""
    whole = docs.select(text_key(F.col("text")).alias("text_key"), "text").where("text_key is not null")
    return stored(whole.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "neardup-texts")


def _verifier(whole: DataFrame, idf: np.ndarray, threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Adds ``linked`` to pairs (a, b): whether their whole texts reach the threshold."""
    similarity = _compared(idf)
    side = lambda name: whole.select(F.col("text_key").alias(name), F.col("text").alias(f"text_{name}"))

    def verify(pairs: DataFrame) -> DataFrame:
        found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity("text_a", "text_b").alias("similarity"))
        return found.select("a", "b", (F.col("similarity") >= threshold).alias("linked"))
    return verify


def further_links(whole: DataFrame, roots: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) that connect what is similar among ``whole`` (text_key, text) beyond ``roots`` (id, root); none is left out.

    An exact search by :mod:`linking`: frequencies of the shingles are counted over just these texts, so passages that many of them share stand
    last, and such texts meet only if they share something rarer, or are little besides the passage.
    """
    sets = stored(whole.join(roots.select(F.col("id").alias("text_key")), "text_key", "left_semi")
                  .select(F.col("text_key").alias("id"), _weighted(idf)("text").alias("items")), "neardup-sets")
    totals = sets.select("id", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["w"]).alias("total"))
    ranked = shared_items(sets.select("id", F.inline("items"))).join(totals, "id")
    ranked = stored(ranked.select("id", "total", F.col("items.h").alias("h"), F.transform("items", lambda x: x["w"].cast("double")).alias("w")), "neardup-ranked")
    links = find_links(ranked, threshold, _verifier(whole, idf, threshold), roots)
    release(sets, ranked)
    return links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, class_key) for every row of ``docs``; rows of one class are copies or near copies.

    Equal texts meet in a key first, so a group of any size costs one row from there on. In every bucket of a band the members are first
    compared with two pivots, the members of smallest and largest hash under that band, which links large groups of near copies by two
    comparisons a member. Buckets whose members aren't of one class then are searched in full: their members go through an exact
    prefix filter, and all pairs of different classes that may reach the threshold are compared. Links are verified over the whole texts,
    and classes are their connected components.
    """
    frequencies, total = document_frequencies(docs)
    idf = idf_table(frequencies, total)
    rows = stored(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _banded(idf)("text").alias("bands")), "neardup-rows")
    texts = rows.where("bands is not null").groupBy("text_key").agg(F.first("bands").alias("bands"))
    members = texts.select("text_key", F.explode("bands").alias("band"))
    order = F.xxhash64("text_key", "band")
    buckets = (members.groupBy("band").agg(F.min_by("text_key", order).alias("p"), F.max_by("text_key", order).alias("q"))
               .where("p <> q"))
    # Stored with the band: members of shared buckets are what the second search looks at.
    shared = stored(members.join(buckets, "band").select("text_key", "band", F.array("p", "q").alias("pivots")), "neardup-members")
    pairs = (shared.select("text_key", F.explode("pivots").alias("pivot")).where("text_key <> pivot")
             .select(F.least("text_key", "pivot").alias("a"), F.greatest("text_key", "pivot").alias("b")).distinct())
    whole = _texts(docs, shared.select("text_key").distinct())
    links = stored(_verifier(whole, idf, threshold)(pairs), "neardup-links").where("linked").select("a", "b")
    roots = components(links)
    rooted = (shared.select("text_key", "band").join(roots.select(F.col("node").alias("text_key"), "root"), "text_key", "left")
              .select("text_key", "band", F.coalesce("root", "text_key").alias("root")))
    # In buckets of two members the pivots are all there is.
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2")
    unsettled = stored(rooted.join(mixed.select("band"), "band").select("text_key", "root").distinct(), "neardup-open")
    if not unsettled.isEmpty():
        more = further_links(whole, unsettled.select(F.col("text_key").alias("id"), "root"), idf, threshold)
        if not more.isEmpty():
            roots = components(links.unionAll(more))
    # Smallest ids per text first: a class is then one row for each different text.
    least = rows.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("least"))
    linked = least.join(roots.select(F.col("node").alias("text_key"), "root"), "text_key")
    named = linked.select("text_key", "root").join(linked.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    alone = least.join(roots.select(F.col("node").alias("text_key")), "text_key", "left_anti")
    classes = named.select("text_key", F.col("root").alias("class_key"), "class_id").unionAll(alone.select("text_key", F.col("text_key").alias("class_key"), "least"))
    # Stored, so that the join reads two plain shuffles and a text that very many rows share can be split.
    found = rows.select("doc_id", "text_key").join(stored(classes, "neardup-classes"), "text_key", "left")
    return found.select("doc_id", "text_key", F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, then of the smallest text key, then of the smallest other columns as text.

    All columns stay, whatever their names; null texts stay.
    """
    found = near_duplicates(docs, threshold).where("text_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("kept")
    kept = found.groupBy("class_key").agg(first).select("kept.doc_id", "kept.text_key")
    others = F.struct(*[F.col(f"row.`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    rows = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_key"] == kept["text_key"])
    once = rows.join(kept, same, "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", others).alias("row")).select("row.*")
    return once.unionByName(docs.where("text is null"))
