"""N-gram Jaccard join: documents whose sets of five-word shingles reach a similarity of 0.8, and the components they make.

Texts whose smallest shingles by hash aren't shared by another text can't have a partner and leave first. Of the others, shingles that one text alone holds
are counted and dropped, the rest is ordered rarest first, and prefixes are joined under length, positional and suffix filters; every pair is
verified once, over the whole sets. Components come from :mod:`linking`, so copies of a group aren't expanded into all of their pairs.

Words are runs of anything but the six ASCII spaces, with A-Z lower-cased. Shingles are 64-bit hashes.

Defined results: a null text, or one without a word, has no shingle and is linked with nothing, its component is its own id; texts of fewer words
than a shingle are one shingle of all of them; equal sets are linked whatever the texts look like; repeated ids and rows stay rows
of their own; a component is named by its smallest non-null id (null if it has none). An empty table gives no rows.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.linking import components, find_links, shared_items
from echolens.llm.neardup import text_key
from echolens.llm.words import SPACED_BYTE, shingles, slices, split_words
from echolens.session import release, stored

WIDTH = 5
PERCENT = 80
#: One in so many of a text's shingles must be shared, beside the prefix that any partner needs.
EXTRA = 10


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and the number of them per row, each once a row, ordered by hash within the row."""
    h, row = shingles(split_words(texts, SPACED_BYTE), WIDTH)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], np.bincount(row[first], minlength=len(texts))


def _lists(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(h.view(np.int64)))


def least_shared(n: int | np.ndarray) -> int | np.ndarray:
    """Of two sets that reach the threshold, each shares so many of its first ``head(n)`` by hash with the other's first ones."""
    return np.maximum(1, -(-PERCENT * n // 100) // EXTRA)


def head(n: int | np.ndarray) -> int | np.ndarray:
    """Elements without which a set of ``n`` keeps less than its share of any partner's overlap, and some more to count."""
    return np.minimum(n, n - -(-PERCENT * n // 100) + np.maximum(1, n // EXTRA))


def _heads():
    kind = pa.struct([("n", pa.int64()), ("head", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:bigint,head:array<bigint>>")
    def heads(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            h, counts = distinct_shingles(part)
            kept = head(counts)
            within = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(pa.StructArray.from_arrays([pa.array(counts), _lists(h[within < np.repeat(kept, counts)], kept)], fields=list(kind)))
        return pa.concat_arrays(out or [pa.array([], kind)])
    return heads


def _sets():
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_lists(*distinct_shingles(part)) for part in slices(texts)] or [pa.array([], pa.list_(pa.int64()))])
    return sets


def open_texts(texts: DataFrame) -> DataFrame:
    """(id) of the texts that may have a partner, from texts (id, n, head).

    Ordered by hash, the first k common elements of two sets of the threshold are among the first n - 80 % n + k of each, so where k grows with n, a text
    shares at least the k of its smallest possible partner.
    """
    heads = texts.select("id", F.explode("head").alias("h"))
    common = heads.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / EXTRA))
    return heads.join(common, "h").groupBy("id").agg(F.count("*").alias("m")).join(texts.select("id", "n"), "id").where(F.col("m") >= needed).select("id")


def _verifier(sets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``linked`` to pairs (a, b); sets (id, total, h) hold all elements that any two of them share."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("total").alias(f"n_{name}"), F.col("h").alias(f"h_{name}"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("h_a", "h_b"))
        return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", both.alias("both"))
                .select("a", "b", (100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("linked")))
    return verify


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    heads = stored(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _heads()("text").alias("x")).select("doc_id", "text_key", "x.*"), "join-heads")
    rows = stored(heads.select("doc_id", "text_key", "n"), "join-rows")
    # A short number stands for a text from here on; written once, it is fixed.
    texts = heads.where("n > 0").groupBy("text_key").agg(F.first("n").alias("n"), F.first("head").alias("head")).withColumn("id", F.monotonically_increasing_id())
    texts = stored(texts, "join-texts")
    release(heads)
    wanted = stored(open_texts(texts).join(texts.select("id", "text_key"), "id"), "join-open")
    release(texts)
    once = (docs.select(text_key(F.col("text")).alias("text_key"), "text").where("text_key is not null").join(wanted, "text_key", "left_semi")
            .groupBy("text_key").agg(F.first("text").alias("text")))
    whole = stored(once.join(wanted, "text_key").select("id", "text_key", _sets()("text").alias("h")), "join-sets")
    items = whole.select("id", F.explode("h").alias("h"))
    totals = whole.select("id", F.size("h").cast("double").alias("total"))
    sets = shared_items(items).join(totals, "id").select("id", "total", F.col("items.h").alias("h"), F.array().cast("array<double>").alias("w"))
    sets = stored(sets, "join-shared")
    roots = components(find_links(sets, PERCENT / 100, _verifier(sets))).join(whole.select(F.col("id").alias("node"), "text_key"), "node")
    # Smallest ids per text first: a component is then one row for each different text.
    least = rows.where("n > 0").groupBy("text_key").agg(F.min("doc_id").alias("least"))
    named = least.join(roots.select("text_key", "root"), "text_key", "left")
    group = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(group, "root", "left").select("text_key", F.coalesce("component", "least").alias("component"))
    # Stored, so that the join reads two plain shuffles and a text that very many rows share can be split.
    found = rows.select("doc_id", "n", "text_key").join(stored(named, "join-named"), "text_key", "left")
    return found.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
                        F.when(F.coalesce("n", F.lit(0)) > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
