"""Quality rules as weak supervision, on DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Texts are bad in different ways, and each way shows in one rule: a text is good or bad of one rule's
kind, and in the other rules a bad text votes as good ones do, so silence about one fault is no proof against another. How a rule votes on its
own kind of bad texts and on all others, and the share of each kind, are estimated by expectation-maximisation over all documents: votes are counted
by pattern first (at most 3**rules patterns, whatever the corpus is), and the iterations run over those counts inside one expression. The
posterior probability of being good replaces the demand that every rule passes.

A rule that is right and one that is wrong look alike in single votes. What decides between them is a prior, in pseudo-texts worth ``STRENGTH`` of all
texts, so it weighs the same at every size: at most a share ``BAD_SHARE`` of texts is bad of a kind, of which its rule finds ``CATCH``; what a rule calls bad
beyond that share, and ``FALSE_ALARM`` at least, is expected to fall on others. So a rule that fires on many texts is found to be poor, and a bad vote
of it alone doesn't condemn a text; iterations start there.

Defined results: a null text has no words; an empty table gives no rows; repeated ids are rows of their own.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.exprs import SPACES, let
from echolens.session import stored

WIDTH = 3
ITERATIONS = 25
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
#: The prior: weight against the texts, largest share of bad texts of a kind, their rule's bad votes among them, and least bad votes among others.
STRENGTH, BAD_SHARE, CATCH, FALSE_ALARM = 0.05, 0.1, 0.9, 0.005


def repeated_words(words: Column, width: int = WIDTH) -> Column:
    """Words inside runs of ``width`` words that occur twice or more in the text, the first occurrence included.

    Runs are hashed and sorted together with their place (the low bits), so equal runs stand next to each other: n log n for any length.
    """
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        gaps = F.aggregate(places, F.struct(F.lit(-1).cast("long").alias("last"), none.alias("sum")), lambda acc, p: F.struct(
            p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, width).otherwise(F.least(F.lit(width), p - acc["last"]))).alias("sum")), lambda acc: acc["sum"])
        return gaps

    def duplicates(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("long")))
        top = lambda x, b: F.call_function("shiftright", x, b)
        place = lambda x, b: x - F.call_function("shiftleft", top(x, b), b)

        def found(s: Column) -> Column:
            order, b, hashes = s["order"], s["bits"], s["h"]
            equal = lambda x, y: (top(x, b) == top(y, b)) & (F.get(hashes, place(x, b).cast("int")) == F.get(hashes, place(y, b).cast("int")))
            kept = F.filter(order, lambda x, k: F.coalesce(equal(x, F.get(order, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(order, k + 1)), F.lit(False)))
            return covered(F.sort_array(F.transform(kept, lambda x: place(x, b))))

        packed = let(bits, lambda b: F.struct(F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", top(x, b), b) + i)).alias("order"), b.alias("bits"), h.alias("h")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(packed, found))

    def hashed(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(width)]))
        return F.when(F.size(ws) < width, none).otherwise(let(runs, duplicates))

    return hashed(words)


def measures(text: Column) -> Column:
    """All counts the rules need, as a struct of bigints; words are runs of characters other than ASCII white space."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"[{SPACES}]+", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    of_words = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"),
                                              F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                                              repeated_words(ws).alias("n_repeat_words")))
    of_lines = let(lines, lambda xs: F.struct(F.size(xs).cast("long").alias("n_lines"), (F.size(xs) - F.size(F.array_distinct(xs))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    F.regexp_count(t, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
                    F.regexp_count(t, F.lit(r"(?<=\s)[|*#~=_+-]+(?=\s)")).cast("long").alias("n_marks"))


def measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", measures(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.w.*", "m.l.*", "m.n_symbols", "m.n_upper", "m.n_marks")


def votes() -> list[Column]:
    """The rules over the columns of ``measured``; shares are compared in integers."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    fault = lambda bad: F.when(bad, -1).otherwise(0)
    return [
        F.when(n < 20, -1).when((n >= 100) & (n <= 100_000), 1).otherwise(0),                                      # length
        F.when((chars < 2 * n) | (chars > 15 * n), -1).when((n > 0) & (chars >= 3 * n) & (chars <= 10 * n), 1).otherwise(0),  # word length
        fault((n >= 20) & (10 * F.col("n_repeat_words") > 3 * n)),                                                 # repeated windows
        fault((lines >= 3) & (10 * F.col("n_dup_lines") > 4 * lines)),                                             # repeated lines
        fault(100 * F.col("n_symbols") > 8 * chars),                                                               # symbols
        fault(10 * F.col("n_marks") > n),                                                                          # words that are marks
        fault(10 * F.col("n_upper") > 4 * chars),                                                                  # capitals
    ]


def estimate(patterns: DataFrame, iterations: int = ITERATIONS) -> list[list[float]]:
    """What each rule's vote (bad, abstained, good) adds to the odds of a text being bad: the most probable ones under the prior.

    ``patterns`` has ``votes`` (array<int>) and ``n``. The odds are sums over the rules, one term for each kind of bad text.
    """
    number = patterns.agg(F.max(F.size("votes")).alias("m")).first()["m"]
    if not number:
        return []
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))  # at most 3**rules
    rules, kinds = F.sequence(F.lit(0), F.lit(number - 1)), F.array(F.lit(0), F.lit(1), F.lit(2))
    term = lambda odds, votes, j: F.get(F.get(odds, j), F.get(votes, j) + 1)
    spread = lambda bad, v: F.when(v == 0, bad).otherwise((1 - bad) / 2)  # votes expected where a share ``bad`` of them is bad

    def expected(rows: Column) -> Column:
        """For each rule the share of texts bad of its kind and the share of bad votes among others, as the rates at which rules fire make likely."""
        total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["n"])
        fired = lambda j: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.when(F.get(r["votes"], j) == -1, r["n"]).otherwise(0.0)) / total
        of_rate = lambda rate: F.struct(F.least(rate, F.lit(BAD_SHARE)).alias("kind"), F.greatest(F.lit(FALSE_ALARM), rate - BAD_SHARE).alias("alarms"))
        return F.transform(rules, lambda j: let(fired(j), of_rate))

    def start(prior: Column) -> Column:
        of_rule = lambda e: F.transform(kinds, lambda v: e["kind"] * spread(F.lit(CATCH), v) / ((1 - BAD_SHARE) * spread(e["alarms"], v)))
        return F.transform(prior, of_rule)

    def improved(rows: Column, prior: Column, odds: Column) -> Column:
        """One iteration. ``good`` is a row's posterior; that of kind j is its term of the odds times ``good``."""
        def posterior(r: Column) -> Column:
            bad = F.aggregate(rules, F.lit(0.0), lambda a, j: a + term(odds, r["votes"], j))
            return F.struct(r["votes"].alias("votes"), r["n"].alias("n"), (1 / (1 + bad)).alias("good"))

        def fitted(known: Column) -> Column:
            number_of = lambda share: F.aggregate(known, F.lit(0.0), lambda a, r: a + r["n"] * share(r))
            whole, good = number_of(lambda r: F.lit(1.0)), number_of(lambda r: r["good"])

            def rule(j: Column, e: Column, sums: Column) -> Column:
                of_kind = lambda r: term(odds, r["votes"], j) * r["good"]

                def vote(v: Column, kind: Column) -> Column:
                    cast = lambda share: F.aggregate(known, F.lit(0.0), lambda a, r: a + F.when(F.get(r["votes"], j) == v - 1, r["n"] * share(r)).otherwise(0.0))
                    pseudo = sums["whole"] * STRENGTH
                    in_kind = cast(of_kind) + pseudo * e["kind"] * spread(F.lit(CATCH), v)  # share of the kind times its votes
                    others = (cast(lambda r: 1 - of_kind(r)) + pseudo * spread(e["alarms"], v)) / (sums["whole"] - kind + pseudo)
                    return in_kind / ((sums["good"] + pseudo * (1 - BAD_SHARE)) * others)
                return let(number_of(of_kind), lambda kind: F.transform(kinds, lambda v: vote(v, kind)))
            return let(F.struct(whole.alias("whole"), good.alias("good")), lambda sums: F.zip_with(rules, prior, lambda j, e: rule(j, e, sums)))
        return let(F.transform(rows, posterior), fitted)

    first = table.select("rows", expected(F.col("rows")).alias("prior"))
    steps = F.sequence(F.lit(1), F.lit(iterations))
    last = first.select(F.aggregate(steps, start(F.col("prior")), lambda odds, _: improved(F.col("rows"), F.col("prior"), odds)).alias("odds"))
    return [list(r) for r in last.first()["odds"]]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes, p_good) of every row; texts are read once."""
    rows = stored(measured(docs).withColumn("votes", F.array(*votes())), "rule-votes")
    odds = estimate(rows.groupBy("votes").agg(F.count("*").alias("n")))
    adds = [F.when(F.get("votes", F.lit(j)) == -1, r[0]).when(F.get("votes", F.lit(j)) == 1, r[2]).otherwise(r[1]) for j, r in enumerate(odds)]
    bad = reduce(lambda a, b: a + b, adds, F.lit(0.0))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes", (1 / (1 + bad)).alias("p_good"))
