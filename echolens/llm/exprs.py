"""Column expressions shared by the native operators."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: a lambda variable is never inlined into the places that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of the elements before each element, in blocks so that long arrays stay linear: array<bigint> of the same size."""
    zero = F.lit(0).cast("bigint")

    def before(xs: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(F.array_append(acc["out"], acc["sum"]).alias("out"), (acc["sum"] + x).alias("sum"))
        empty = F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("sum"))
        return F.aggregate(xs, empty, step, lambda acc: acc["out"])

    def blocked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(block)), lambda i: F.slice(xs, i, block))
        return let(blocks, lambda bs: let(
            before(F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero),
            lambda starts: F.flatten(F.zip_with(bs, starts, before))))

    return let(F.transform(values, lambda x: x.cast("bigint")), blocked)


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, end, value>>, code points, end exclusive.

    The text between matches and the matches themselves give the offsets, so no Python is needed.
    """
    def located(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        steps = F.zip_with(gaps, F.concat(F.array(F.lit("")), found), lambda g, f: F.length(g) + F.length(f))
        # Element k of `steps` is match k-1 and the gap after it, so the sum through k is where match k begins.
        starts = F.slice(running_sums(F.concat(steps, F.array(F.lit(0)))), 2, F.greatest(F.size(found), F.lit(1)))
        return F.zip_with(found, F.slice(starts, 1, F.size(found)), lambda f, s: F.struct(
            s.alias("start"), (s + F.length(f)).alias("end"), f.alias("value")))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(pair, located)).otherwise(empty)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    def tail(z: Column) -> Column:
        x = F.abs(z)
        return let(1 / (1 + 0.2316419 * x), lambda t: let(
            F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))),
            lambda upper: F.when(z >= 0, upper).otherwise(1 - upper)))
    return let(z, tail)
