"""Entropy balancing of sources, on DataFrame functions alone.

Of all document rates w that give every source its target, sum over its documents of w * size = target with 0 <= w <= most, those nearest
to 1 in relative entropy are exponential tilts: w = min(most, exp(lambda * x)), with x the document's size over its base measure. The
measure counts a document once and its words once, relative to the source's mean size, so x = z / (1 + z) with z = size / mean. Lambda solves the
convex dual by Newton steps, guarded by a bracket, for all sources at once; each step is one distributed sum over (source, size)
counts. Rates become whole copies by systematic rounding in order of size, which misses a source's target by about its longest
document; a few sizes then change their number of copies to take up the rest.

Defined results: a null text or source is a source or size like any other (null sources last, size 0); a document of size 0 is taken
0 times its words; equal rows are rounded one by one. Targets follow the weights 5, 2, 1 over sources in code point order, stop at ``MOST``
times a source's size, and what is over goes to the others by weight. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.exprs import WORD
from echolens.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3.0
STEPS = 40
TOLERANCE = 1e-5
#: Steps that take what rounding left to the target, a size at a time.
FITS = 4
#: Documents of one source and size that are ranked together.
CELL = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Filling up by weight stops at the cap first where size / weight is smallest, so in that order the capped sources come first; running sums find how many.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.lit(float(weights[0]))
    for i, value in enumerate(weights[1:], 1):
        weight = F.when(k == i, F.lit(float(value))).otherwise(weight)
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    share = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share * F.col("weight")).alias("target"))


def tilt(size: Column, mean: Column) -> Column:
    """Share of the document's size in its base measure: 0 for an empty document, towards 1 for a long one."""
    z = size / mean
    return F.when(size > 0, z / (1 + z)).otherwise(0.0)


def rate(lam: Column, x: Column, most: float = MOST) -> Column:
    return F.least(F.lit(most), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(cells: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, lam) from (source, size, n) and (source, source_size, n_docs, target).

    Steps are Newton's on the logarithm of what a source gives, kept inside a bracket; where one leaves it, the bracket is halved or, as
    long as its end is still the first one, widened by doubling. A source that wants all it can give has no finite dual: its lambda is the
    end of the bracket, where rates reach the cap. Each step is written to the shared folder, one row per source; the loop
    ends when every source is within the tolerance.
    """
    points = cells.where("size > 0").join(goals.select(F.col("source").alias("s"), (F.col("source_size") / F.col("n_docs")).alias("mean")),
                                          F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "size", tilt(F.col("size"), F.col("mean")).alias("x"))
    points = stored(points, "mix-points")
    bound = 4000.0
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-9)
    state = goals.where("source_size > 0").select("source", "target", F.when(full, bound).otherwise(0.0).alias("lam"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"), full.alias("done"))
    state = stored(state, "mix-state")
    for _ in range(STEPS):
        at = state.select(F.col("source").alias("s"), "lam")
        w = rate(F.col("lam"), F.col("x"), most)
        sums = points.join(at, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("got"),
            F.sum(F.when(w < most, F.col("n") * F.col("size") * F.col("x") * w).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "s")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.when(F.col("slope") > 0, F.col("slope"))
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        beyond = F.when((gap < 0) & (high == bound), F.greatest(2 * F.col("lam"), F.col("lam") + 4)).when(
            (gap > 0) & (low == -bound), F.least(2 * F.col("lam"), F.col("lam") - 4)).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < F.least(high, F.abs(F.col("lam")) * 3 + 8)), newton).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), beyond)))
        done = near | (high - low < 1e-9)
        state = stored(joined.select("source", "target", F.when(F.col("done") | near, F.col("lam")).otherwise(step).alias("lam"),
                                     low.alias("low"), high.alias("high"), (F.col("done") | done).alias("done")), "mix-state")
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.round("lam", 9).alias("lam"))  # the last digits depend on the order of sums


def _fitted(cells: DataFrame, most: float) -> DataFrame:
    """One step towards the target: the largest size that still fits into what a source lacks, or has too much, changes its quota."""
    source = Window.partitionBy("source")
    lack = F.col("target") - F.sum(F.col("quota") * F.col("size")).over(source)
    cells = cells.withColumn("lack", lack)
    room = F.when(F.col("lack") > 0, (F.col("n") * F.lit(most)).cast("long") - F.col("quota")).otherwise(F.col("quota"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & (room > 0)
    largest = F.max(F.when(fits, F.col("size"))).over(source)
    change = F.least(room, F.floor(F.abs("lack") / F.col("size"))) * F.signum("lack").cast("long")
    return cells.withColumn("quota", F.col("quota") + F.when(F.col("size") == largest, change).otherwise(0)).drop("lack")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``; columns of these names in ``docs`` are replaced."""
    added = ("size", "source_size", "target", "rate", "copies")
    return _dealt(docs, weights, most).select(*[F.col(_kept(i)).alias(c) for i, c in enumerate(docs.columns) if c not in added], *added)


def _kept(i: int) -> str:
    return f"_row{i}"


def _dealt(docs: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """What :func:`mix` adds, beside all columns of the document by number, so that their names can't meet those used here.

    They are columns of their own and not one struct, which would go through the shuffles whole where a caller reads a part of it.
    """
    own = ["doc_id", "source", *[_kept(i) for i in range(len(docs.columns))]]
    measured = docs.select("doc_id", "source", *[F.col(f"`{c}`").alias(_kept(i)) for i, c in enumerate(docs.columns)], word_count(F.col("text")).alias("size"))
    cells = stored(measured.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = targets(totals.select("source", "source_size"), weights, most).join(
        totals.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = stored(goals, "mix-goals")
    lam = solve(cells, goals, most)
    known = goals.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    x = tilt(F.col("size"), F.col("source_size") / F.col("n_docs"))
    rated = (cells.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("rate", F.when(F.col("size") > 0, rate(F.coalesce("lam", F.lit(0.0)), x, most)).otherwise(1.0)))
    # Systematic rounding over the sizes of a source: a cell gets the whole numbers that its stretch of the running sum passes.
    by_size = Window.partitionBy("source").orderBy("size")
    through = F.sum(F.col("n") * F.col("rate")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = lambda c: F.floor(c + 0.5 + 1e-9)
    quotas = rated.withColumn("quota", F.least(whole(through) - whole(begun), (F.col("n") * F.lit(most)).cast("long")))
    for _ in range(FITS):
        quotas = _fitted(quotas, most)
    quotas = stored(quotas.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("n").alias("q_n"), "quota", "source_size", "target", "rate"), "mix-quotas")
    # Within a cell: the base number for all, one more for the first of each bucket's hash order, as the bucket's stretch of the remainder says.
    same = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))
    dealt = measured.join(quotas, same).drop("q_source", "q_size")
    h = F.xxhash64("doc_id", "source", "size")
    dealt = dealt.withColumn("_h", h).withColumn("_bucket", F.pmod(F.col("_h"), F.ceil(F.col("q_n") / CELL)))
    order = Window.partitionBy("source", "size", "_bucket").orderBy("_h", "doc_id")
    base, over = F.floor(F.col("quota") / F.col("q_n")), F.col("quota") % F.col("q_n")
    # A cell of one bucket ranks all of its documents, so it meets its quota exactly; larger cells do in each bucket up to one document.
    buckets = F.ceil(F.col("q_n") / CELL)
    fill = F.col("_in_bucket") * over / F.col("q_n") + F.when(buckets > 1, F.pmod(F.xxhash64("source", "size", "_bucket"), F.lit(1 << 20)) / float(1 << 20)).otherwise(0.5)
    counted = dealt.withColumn("_rank", F.row_number().over(order)).withColumn("_in_bucket", F.count("*").over(Window.partitionBy("source", "size", "_bucket")))
    copies = (base + F.when(F.col("_rank") <= F.floor(fill), 1).otherwise(0)).cast("int")
    return counted.select(*own, "size", "source_size", "target", "rate", F.least(copies, F.lit(int(most))).alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken, all of its columns as they are, numbered from 1 by ``copy`` unless ``docs`` has such a column."""
    mixed = _dealt(docs, weights, most).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(_kept(i)).alias(c) for i, c in enumerate(docs.columns)], *([] if "copy" in docs.columns else ["copy"]))
