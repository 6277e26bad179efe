"""Vector code compression: each vector becomes one index a part, found by equal-average search in a codebook that two rounds have fitted.

Components are fixed-point integers floor(256 * x), and all arithmetic is exact. Equal-average search sorts a codebook by component sum; from a
part's own sum it goes outwards, nearer gap first, until the squared gap over the dimension strictly exceeds the best distance found: by
Cauchy's inequality no entry further out can then be as near. All parts of a batch search at once. A codebook has at most ``ENTRIES`` entries
of a vector's dimension, so it travels with the tasks; sums and counts of a round are aggregated by (part, entry), partial sums first.

Defined results: rows whose vector is null, empty, or has a null, non-finite or out-of-range component (``|256 x| >= 2**24``, whose squares don't
add up in a long) are left out; so are vectors of another length than that of the smallest kept id. A length that 16 doesn't divide is an error.
Null ids come last, rows of equal id are ordered by vector. With fewer rows than ``ENTRIES`` the codebook has as many entries as rows. An
empty table gives no rows. Null labels are one label. Other columns of the input are ignored.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.session import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24


def fixed_point(vector: Column) -> Column:
    """array<bigint> of a kept vector, null for one that is left out."""
    kept = (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < LIMIT, F.lit(False)))
    return F.when(kept, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def search(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``parts`` and its squared distance; of equally near ones the first."""
    n, dim = parts.shape
    order = np.argsort(book.sum(1), kind="stable")
    entries, sums = book[order], book.sum(1)[order]
    own = parts.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    none = np.iinfo(np.int64).max
    best, found, live = np.full(n, none), np.full(n, len(book)), np.arange(n)
    while len(live):
        lo, hi = left[live], right[live]
        below = np.where(lo >= 0, own[live] - sums[np.maximum(lo, 0)], none)
        above = np.where(hi < len(book), sums[np.minimum(hi, len(book) - 1)] - own[live], none)
        gap, down = np.minimum(below, above), below <= above
        # Exact below 2**53; beyond, the slack makes a search go on a little longer than it must.
        on = (gap < none) & (gap.astype(np.float64) ** 2 <= best[live].astype(np.float64) * dim * (1 + 1e-12))
        live, down = live[on], down[on]
        at = np.where(down, left[live], right[live])
        left[live] -= down
        right[live] += ~down
        distance = ((parts[live] - entries[at]) ** 2).sum(1)
        better = (distance < best[live]) | ((distance == best[live]) & (order[at] < found[live]))
        best[live[better]], found[live[better]] = distance[better], order[at][better]
    return found, best


def _split(vectors: pa.Array, dim: int) -> np.ndarray:
    """(rows, PARTS, dimension of a part)."""
    return np.asarray(vectors.flatten(), np.int64).reshape(len(vectors), PARTS, dim // PARTS)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, place, total): how often an entry is nearest, and the sum of each component of its parts."""
    dim = books.shape[0] * books.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _split(batch.column(0), dim)
            for p in range(PARTS):
                found, _ = search(x[:, p], books[p])
                used, at = np.unique(found, return_inverse=True)
                total = np.zeros((len(used), x.shape[2]), np.int64)
                np.add.at(total, at, x[:, p])
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)),
                                                  "n": pa.array(np.bincount(at)), "total": pa.array(total.tolist(), pa.list_(pa.int64()))})

    sums = vectors.select("q").mapInArrow(add, "part int, entry int, n long, total array<bigint>")
    return (sums.select("part", "entry", "n", F.posexplode("total").alias("place", "total")).groupBy("part", "entry", "place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")))


def codebooks(vectors: DataFrame, dim: int) -> np.ndarray:
    """(PARTS, entries, dimension of a part), from (vec_id, q): first the smallest ids' parts, then ``ROUNDS`` rounds over all vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in _sums(vectors, books).collect():  # at most ENTRIES * dim rows
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def book_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _coder(books: np.ndarray):
    dim = books.shape[0] * books.shape[2]
    kind = pa.struct([("code", pa.string()), ("error", pa.int64())])

    @F.arrow_udf("struct<code:string,error:bigint>")
    def coded(vectors: pa.Array) -> pa.Array:
        x = _split(vectors, dim)
        found, errors = zip(*(search(x[:, p], books[p]) for p in range(PARTS)))
        codes = np.stack(found, 1).astype(np.uint8)
        return pa.StructArray.from_arrays([pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(np.sum(errors, 0))], fields=list(kind))
    return coded


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept row."""
    whole = embeddings.select("vec_id", "label", fixed_point(F.col("embedding")).alias("q")).where("q is not null")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).select(F.size("q")).collect()
    dim = first[0][0] if first else PARTS
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    kept = whole.where(F.size("q") == dim)
    books = codebooks(kept, dim) if first else np.zeros((PARTS, 0, 1), np.int64)
    coded = stored(kept.select("vec_id", "label", _coder(books)("q").alias("c")).select("vec_id", "label", "c.code", "c.error"), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "label", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")))


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in the original scale."""
    return np.concatenate([books[p, int(code[2 * p:2 * p + 2], 16)] for p in range(PARTS)]) / SCALE
