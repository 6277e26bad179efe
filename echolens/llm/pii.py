"""Personal data by candidate gradient boosting, on DataFrame functions and Spark's own boosted trees.

Strict forms (email, ip, card, phone) are found with their checks. High-recall generators propose further, overlapping spans of looser form;
boosted trees score them by format and context, and a threshold per kind, calibrated on candidates the trees have not seen, selects
what else is redacted. The trees learn from the corpus itself: its strict spans, rewritten in loose form within their own context, are the
examples; candidates that overlap no strict span are the others. Features that only tell the strict form (a plus, an at sign) are left out.
The others may hold loose personal data themselves, so they aren't simply wrong: at equal score they are taken for personal data up to the number
of rewritten examples, and what goes beyond that number counts as wrong. This assumes that a loose form is no more frequent than the strict one.
The fitted trees become one column expression, so every text is read once and no row needs a key.

Defined results: a null text counts as empty and has no spans (and stays null when redacted); offsets are code points, ends exclusive; without
examples of both sorts only strict spans are found.
"""

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.exprs import find_spans, let
from echolens.session import stored

KINDS = ("email", "ip", "card", "phone")
# Strict forms. The heads in front say: where a run begins or the last match ended, which is where a leftmost match can begin.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of candidates.
LOOSE = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+",
         "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:(?:\.|\[\.\])[0-9]++){2,7}+",
         "card": r"[0-9](?:[\x20-]?[0-9]){11,22}+",
         "phone": r"\+?\(?[0-9][\x20().0-9-]{5,24}[0-9]"}
HINT = r"(?i)(?:tel|phone|call|mail|contact|card|visa|ip|host|server)\W*$"

#: Candidates that the trees learn from; thresholds are counted over all others.
SAMPLE_CANDIDATES = 40_000
TREES, DEPTH = 8, 3
PRECISION, BINS, LEAST_SUPPORT = 0.95, 50, 20

FEATURES = ("kind", "chars", "digits", "dots", "gaps", "parens", "groups", "distinct", "glued_before", "glued_after", "hint")
SPAN = "array<struct<rank:int,start:bigint,end:bigint,kind:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def checked(digits: Column) -> Column:
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + let(
            F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, twice(d)).otherwise(d))) % 10 == 0
    return let(F.reverse(_digits(value)), checked)


def strict_spans(text: Column) -> Column:
    """array<struct<rank, start, end, kind>> by kind as listed, then start."""
    t = F.coalesce(text, F.lit(""))
    n = lambda s: F.length(_digits(s["value"]))
    found = [
        find_spans(t, EMAIL),
        F.filter(find_spans(t, IP), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.cast("double") <= 255)),
        F.filter(find_spans(t, CARD), lambda s: F.when(n(s).between(16, 19), luhn(s["value"])).otherwise(False)),
        F.filter(find_spans(t, PHONE), lambda s: n(s).between(8, 15)),
    ]
    return F.sort_array(F.concat(*[_ranked(f, i) for i, f in enumerate(found)]))


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))


def candidates(text: Column) -> Column:
    """Loose spans with their features: array<struct<rank, start, end, kind, f: array<double>>>, the features in the order of ``FEATURES``."""
    t = F.coalesce(text, F.lit(""))

    def described(s: Column, rank: int, whole: Column) -> Column:
        v = s["value"]
        count = lambda chars: F.length(v) - F.length(F.translate(v, chars, ""))
        before = F.substring(whole, F.greatest(s["start"] - 11, F.lit(1)).cast("int"), F.least(s["start"], F.lit(12)).cast("int"))
        after = F.substring(whole, (s["end"] + 1).cast("int"), F.lit(1))
        digits = _digits(v)
        features = [F.lit(rank), F.length(v), F.length(digits), count("."), count(" -"), count("()"),
                    F.size(F.filter(F.split(v, "[^0-9]+"), lambda p: p != "")), F.size(F.array_distinct(F.split(digits, ""))),
                    before.rlike(r"[\p{L}\p{N}_.+-]$"), after.rlike(r"^[\p{L}\p{N}_]"), before.rlike(HINT)]
        return F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"),
                        F.array(*[x.cast("double") for x in features]).alias("f"))

    proposed = lambda whole, rank: F.transform(find_spans(whole, LOOSE[KINDS[rank]]), lambda s: described(s, rank, whole))
    return let(t, lambda whole: F.concat(*[proposed(whole, rank) for rank in range(len(KINDS))]))


def loosened(value: Column, kind: Column) -> Column:
    """Loose forms of a strict span, none of them strict: array<string>."""
    digits = _digits(value)
    plain = F.regexp_replace(value, r"^\+", "")
    grouped = lambda d: F.rtrim(F.regexp_replace(d, "([0-9]{4})", "$1 "))
    email = F.array(*[F.replace(value, F.lit("@"), F.lit(at)) for at in (" (at) ", "(at)", "[at]", " @ ")])
    phone = F.array(plain, digits, F.regexp_replace(digits, r"^([0-9]{3})([0-9]{3})([0-9]+)$", "($1) $2-$3"), F.regexp_replace(plain, r"[\x20().]+", "-"))
    card = F.array(*[form(F.left(digits, F.lit(n))) for n in (13, 15) for form in (lambda d: d, grouped)])
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).otherwise(F.array(F.replace(value, F.lit("."), F.lit("[.]"))))


def examples(docs: DataFrame) -> DataFrame:
    """(key, rank, f, label) of all documents, once for each different text and span: rewritten strict spans are 1, candidates clear of strict ones 0."""
    texts = docs.select("text").where("text is not null")
    h = F.xxhash64("text", F.lit("pii"))
    clear = let(strict_spans(F.col("text")), lambda known: F.filter(candidates(F.col("text")), lambda c: ~F.exists(
        known, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))))
    others = texts.select(h.alias("h"), F.explode(clear).alias("c")).select(F.xxhash64("h", "c.start", "c.end", "c.rank").alias("key"), F.col("c.rank").alias("rank"),
                                                                           F.col("c.f").alias("f"), F.lit(0.0).alias("label"))
    # The context that features look at, with the span rewritten.
    part = lambda start, n: F.substring("text", (start + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    k = F.col("k")
    begin = F.greatest(k["start"] - 12, F.lit(0))
    found = texts.select(h.alias("h"), "text", F.explode(strict_spans(F.col("text"))).alias("k")).select(
        "h", "k", part(begin, k["start"] - begin).alias("before"), part(k["end"], F.lit(2)).alias("after"), part(k["start"], k["end"] - k["start"]).alias("value"))
    written = found.select("h", "k", "before", "after", F.posexplode(loosened(F.col("value"), k["kind"])).alias("form", "value"))
    at, end = F.length("before"), F.length("before") + F.length("value")
    whole = F.filter(candidates(F.concat("before", "value", "after")), lambda c: (c["rank"] == k["rank"]) & (c["start"] <= at) & (c["end"] >= end))
    loose = written.select("h", "k", "form", F.explode(whole).alias("c")).select(F.xxhash64("h", "k.start", "k.end", "k.rank").alias("key"), F.col("c.rank").alias("rank"),
                                                                              F.col("c.f").alias("f"), F.lit(1.0).alias("label"))
    return others.unionAll(loose).distinct()


class Model:
    """Trees as a column expression, and a threshold per kind."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights, self.least = trees, weights, {}

    def probability(self, f: Column) -> Column:
        def column(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, limit, left, right = node
            return F.when(F.get(f, F.lit(feature)) <= limit, column(left)).otherwise(column(right))
        margin = reduce(lambda a, b: a + b, [w * column(t) for w, t in zip(self.weights, self.trees)])
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node):
    """(feature, threshold, left, right), or the prediction of a leaf."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(docs: DataFrame) -> Model | None:
    """Trees from a sample of bounded size for each kind and label, by hash order; thresholds from all candidates the trees have not seen."""
    rows = stored(examples(docs), "pii-candidates")
    # Half of the keys may be learned from; all forms of one span stay together.
    even = rows.where(F.pmod("key", F.lit(2)) == 0)
    order = F.xxhash64("key", "rank", "label", "f")
    parts = [even.where((F.col("rank") == rank) & (F.col("label") == label)).withColumn("h", order).orderBy("h").limit(SAMPLE_CANDIDATES // (2 * len(KINDS)))
             for rank in range(len(KINDS)) for label in (0.0, 1.0)]
    learn = stored(reduce(lambda a, b: a.unionAll(b), parts), "pii-sample")
    last = {(r["rank"], r["label"]): r["h"] for r in learn.groupBy("rank", "label").agg(F.max("h").alias("h")).collect()}
    if len({label for _, label in last}) < 2:
        return None
    fitted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(
        learn.select("label", array_to_vector("f").alias("features")))
    model = Model([_tree(t._call_java("rootNode")) for t in fitted.trees], [float(w) for w in fitted.treeWeights])
    learned = reduce(lambda a, b: a | b, [(F.col("rank") == rank) & (F.col("label") == label) & (order <= h) for (rank, label), h in last.items()])
    unseen = rows.where((F.pmod("key", F.lit(2)) == 1) | ~learned)
    bins = (unseen.select("rank", "label", F.least(F.floor(model.probability(F.col("f")) * BINS), F.lit(BINS - 1)).alias("bin"))
            .groupBy("rank", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).orderBy("rank", F.desc("bin")).collect())
    for rank in range(len(KINDS)):
        n = wrong = support = 0.0
        for row in bins:
            if row["rank"] == rank:
                others = row["n"] - row["hits"]
                n, wrong, support = n + others, wrong + max(0.0, others - row["hits"]), support + row["hits"]
                if row["hits"] and support >= LEAST_SUPPORT and wrong <= (1 - PRECISION) * n:
                    model.least[rank] = row["bin"] / BINS
    return model


def learned_spans(text: Column, model: Model | None) -> Column:
    """Candidates that the trees select, as ``strict_spans``."""
    if model is None or not model.least:
        return F.array().cast(SPAN)
    least = lambda c: reduce(lambda rest, kind: F.when(c["rank"] == kind[0], F.lit(kind[1])).otherwise(rest), model.least.items(), F.lit(2.0))
    chosen = F.filter(candidates(text), lambda c: model.probability(c["f"]) >= least(c))
    return F.transform(chosen, lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))


def all_spans(text: Column, model: Model | None) -> Column:
    """struct<strict, spans>: the strict spans, and those with the learned ones that overlap none of them; both by kind, then start."""
    pair = F.struct(strict_spans(text).alias("strict"), learned_spans(text, model).alias("learned"))

    def together(p: Column) -> Column:
        clear = F.filter(p["learned"], lambda c: ~F.exists(p["strict"], lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])))
        return F.struct(p["strict"].alias("strict"), F.sort_array(F.concat(p["strict"], clear)).alias("spans"))
    return let(pair, together)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, strict, spans) of every row."""
    found = docs.select("doc_id", all_spans(F.col("text"), train(docs)).alias("found"))
    return found.select("doc_id", "found.strict", "found.spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in capitals and brackets."""
    def replaced(x: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
        between = lambda a, b: F.substring(x["text"], (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.array_append(F.array_append(
            acc["out"], between(acc["at"], s["start"])), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        return F.aggregate(x["spans"], begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), between(acc["at"], F.length(x["text"]).cast("long"))))

    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(a["rank"] - b["rank"]))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(text.alias("text"), by_start.alias("spans")), replaced))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts and, where it exists, ``n_chars`` counted anew; all columns stay."""
    model = train(docs)
    clean = let(all_spans(F.col("text"), model), lambda f: redacted(F.col("text"), f["spans"]))
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
