"""Secret scans, on DataFrame functions alone: known forms, and a randomness test battery for everything else.

Candidates are runs of 20 or more characters of an encoding alphabet. The encoding (hex, base32, base64) is inferred from the characters
present. Four tests say how well a run agrees with uniform random symbols: chi-squared uniformity over the alphabet, chi-squared balance of each bit at
each place of the encoding's unit (encoded text has bits that hardly change), runs above and below the middle symbol, and lag-one serial
correlation; Fisher's sum combines their p-values into an agreement, spread evenly over 0 to 1 for random strings and near 0 for ordinary ones.

How often ordinary strings agree as well is counted on decoys: from every document a piece of its own text without the candidates, at a hashed place, as
hex, as base32, as base64 and with its words run together, in a hashed length; short texts are read round. Within each encoding and length band, the
least agreement is taken at which the expected number of ordinary strings among those found is at most ``FDR`` of them: all candidates that are not found
count as ordinary, and the decoys' share, of the worst kind, says how many more such strings pass (Storey's form of the false-discovery rate, with
empirical p-values). Bands are needed since short strings can't be told apart as surely as long ones; a band with too few decoys to vouch for
anything flags nothing.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.exprs import find_spans, let, normal_tail
from echolens.session import stored

# Fixed patterns of the known forms.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Symbols in which an encoding's unit of whole bytes is written, and bits of a symbol.
UNITS, BITS = {"hex": 2, "base32": 8, "base64": 4}, {"hex": 4, "base32": 5, "base64": 6}
FDR = 0.05
BINS = 50
#: Upper ends of the length bands.
BANDS = (24, 32, 48, 80)
#: Symbols of a decoy in each band, in whole units of every encoding, and the kinds of decoys.
DECOY_SIZES = (24, 32, 40, 64, 120)
#: Kinds of decoys by number, and the encoding a decoy has to come out as to be counted.
DECOYS = {1: "hex", 2: "base32", 3: "base64", 4: "base64"}

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def known_forms(text: Column) -> Column:
    """Spans of the kinds assign, access and hex, by start and then kind."""
    t = F.coalesce(text, F.lit(""))
    assign = F.filter(find_spans(t, ASSIGN), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= 6)
    return F.sort_array(F.concat(_spans(assign, "assign", 0), _spans(find_spans(t, ACCESS), "access", 1), _spans(find_spans(t, HEX), "hex", 2)))


def _encoding(value: Column) -> Column:
    body = F.regexp_replace(value, "=+$", "")
    return F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def _battery(value: Column, encoding: Column) -> Column:
    """Combined p-value under uniform random symbols."""
    plain = F.regexp_replace(F.translate(value, "-_", "+/"), "=+$", "")
    symbols = F.when(encoding == "hex", F.lower(plain)).otherwise(plain)
    of_encoding = lambda values: F.when(encoding == "hex", values["hex"]).when(encoding == "base32", values["base32"]).otherwise(values["base64"])
    double = lambda c: c.cast("double")
    chi_tail = lambda chi, df: normal_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    def squares(codes: Column) -> Column:
        """Sum of the squared counts of equal codes, in one pass over the sorted ones: a run of c adds 1 + 3 + ... + (2c - 1)."""
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sort_array(codes), start, lambda acc, c: let(F.when(c == acc["last"], acc["run"] + 2).otherwise(1.0), lambda run: F.struct(
            c.alias("last"), run.alias("run"), (acc["sum"] + run).alias("sum"))), lambda acc: acc["sum"])

    def bit_balance(s: Column) -> Column:
        """Sum over the unit's places and bits of (ones - zeros)**2 / symbols there."""
        def of_place(place: Column) -> Column:
            there = F.filter(s["codes"], lambda _, i: i % s["unit"] == place)
            ones = lambda codes, bit: F.aggregate(codes, F.lit(0), lambda a, c: a + F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)))
            return let(there, lambda codes: F.aggregate(F.sequence(F.lit(0), s["bits"] - 1), F.lit(0.0), lambda a, bit: a + F.pow(
                2.0 * ones(codes, bit) - F.size(codes), F.lit(2.0)) / F.size(codes)))
        return F.aggregate(F.transform(F.sequence(F.lit(0), s["unit"] - 1), of_place), F.lit(0.0), lambda a, x: a + x)

    def tested(s: Column) -> Column:
        codes, k = s["codes"], double(s["k"])
        n = double(F.size(codes))
        p_chi = chi_tail(squares(codes) * k / n - n, k - 1)
        p_bits = chi_tail(bit_balance(s), double(s["unit"] * s["bits"]))
        middle, half = (k - 1) / 2, (n - 1) / 2
        pair = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("lag"))
        walked = F.aggregate(codes, pair, lambda acc, c: F.struct(
            c.alias("last"), (acc["runs"] + F.when((c > middle) != (acc["last"] > middle), 1.0).otherwise(0.0)).alias("runs"),
            (acc["lag"] + F.coalesce((c - middle) * (acc["last"] - middle), F.lit(0.0))).alias("lag")))

        def combined(w: Column) -> Column:
            p_runs = 2 * normal_tail(F.abs(w["runs"] - half) / F.sqrt((n - 1) / 4))
            p_lag = 2 * normal_tail(F.abs(w["lag"] / ((k * k - 1) / 12)) / F.sqrt(n - 1))
            parts = F.array(p_chi, p_bits, p_runs, p_lag)
            x = F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))))
            return let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))  # the tail of chi-squared with eight degrees of freedom at 2x
        return let(walked, combined)

    alphabet = of_encoding({name: F.lit(letters) for name, letters in ALPHABETS.items()})
    codes = let(alphabet, lambda a: F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: F.call_function("instr", a, c) - 1))
    number = lambda values: of_encoding({name: F.lit(v) for name, v in values.items()})
    return let(F.struct(codes.alias("codes"), F.length(alphabet).alias("k"), number(UNITS).alias("unit"), number(BITS).alias("bits")), tested)


def _band(size: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(size <= BANDS[i], i).otherwise(out)
    return out


def _eligible(value: Column) -> Column:
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def decoys(text: Column) -> Column:
    """Ordinary strings made of the text itself, of a hashed length and place: array<struct<kind, value>>; none where nothing but candidates is there."""
    def made(d: Column) -> Column:
        n, t = d["n"], d["text"]
        place = lambda size: (F.pmod(d["h"], F.greatest(F.length(t) - size, F.lit(0)) + 1) + 1).cast("int")
        piece = lambda size: F.encode(F.substring(t, place(size), size), "utf-8")
        whole = lambda c: F.when(F.length(c) >= n, F.substring(c, F.lit(1), n))
        five = piece((n * 5 / 8).cast("int"))
        base32 = let(F.hex(five), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), (n / 8).cast("int") - 1), lambda i: F.lpad(
            F.conv(F.substring(h, i * 10 + 1, F.lit(10)), 16, 32), 8, "0")), ""))
        words = F.regexp_replace(F.substring(t, place(n * 2), n * 2), "[^A-Za-z0-9]", "")
        numbered = F.concat(F.substring(words, F.lit(1), n - 2), (F.pmod(d["h"], F.lit(90)) + 10).cast("string"))
        strings = [whole(F.lower(F.hex(piece((n / 2).cast("int"))))),
                   F.when(F.octet_length(five) >= n * 5 / 8, F.translate(base32, "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABETS["base32"])),
                   whole(F.translate(F.base64(piece((n * 3 / 4).cast("int"))), "=\r\n", "")),
                   F.when(F.length(words) >= n, numbered)]
        return F.filter(F.array(*[F.struct(F.lit(i + 1).alias("kind"), v.alias("value")) for i, v in enumerate(strings)]), lambda v: _eligible(v["value"]))

    t = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(t, CANDIDATE, "")
    size = F.get(F.array(*[F.lit(n) for n in DECOY_SIZES]), F.pmod(F.xxhash64(t), F.lit(len(DECOY_SIZES))).cast("int"))
    least = 2 * max(DECOY_SIZES)
    whole = F.when((F.length(rest) > 0) & (F.length(rest) < least), F.repeat(F.concat(rest, F.lit(" ")), (F.lit(least) / F.length(rest)).cast("int") + 1)).otherwise(rest)
    return let(F.struct(whole.alias("text"), size.alias("n"), F.xxhash64(t, F.lit(1)).alias("h")), made)


def candidates(text: Column) -> Column:
    """Candidates (kind 0) with their places and decoys (the kinds of ``DECOYS``): array<struct<kind, start, end, encoding, band, p>>."""
    found = F.filter(find_spans(F.coalesce(text, F.lit("")), CANDIDATE), lambda s: _eligible(s["value"]))
    strings = F.concat(
        F.transform(found, lambda s: F.struct(F.lit(0).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))),
        F.transform(decoys(text), lambda d: F.struct(d["kind"].alias("kind"), F.lit(0).cast("long").alias("start"), F.length(d["value"]).cast("long").alias("end"), d["value"].alias("value"))))

    def described(s: Column) -> Column:
        return let(_encoding(s["value"]), lambda e: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), e.alias("encoding"),
                                                            _band(s["end"] - s["start"]).alias("band"), _battery(s["value"], e).alias("p")))
    return F.transform(strings, described)


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, known, tested) of every row, written to the shared folder: each text is read and each string tested once."""
    return stored(docs.select("doc_id", known_forms(F.col("text")).alias("known"), candidates(F.col("text")).alias("tested")), "secret-candidates")


def thresholds(rows: DataFrame, fdr: float = FDR) -> list[tuple[str, int, float]]:
    """(encoding, band, least p) wherever a threshold keeps the false discoveries in check; counted over all that ``extracted`` found.

    Each encoding, band and kind is counted in ``BINS`` bins, so the table has at most encodings * bands * bins rows.
    """
    bins = rows.select(F.explode("tested").alias("c")).groupBy("c.encoding", "c.band", "c.kind", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    above = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(f"above_{kind}")
    tails = (bins.select("encoding", "band", "kind", "n", F.explode(F.sequence(F.lit(0), "bin")).alias("least"))
             .groupBy("encoding", "band", "least").agg(*[above(kind) for kind in (0, *DECOYS)]))
    group = Window.partitionBy("encoding", "band")
    total = lambda kind: F.max(f"above_{kind}").over(group)
    share = F.greatest(*[F.when((F.col("encoding") == meant) & (total(kind) > 0), (F.col(f"above_{kind}") + 0.5) / (total(kind) + 1)) for kind, meant in DECOYS.items()])
    judged = tails.select("encoding", "band", "least", "above_0", ((total(0) - F.col("above_0") + 1) * share / (1 - share)).alias("ordinary"))
    passed = judged.where((F.col("above_0") > 0) & (F.col("ordinary") <= fdr * F.col("above_0")))
    return [(r["encoding"], r["band"], r["least"] / BINS) for r in passed.groupBy("encoding", "band").agg(F.min("least").alias("least")).collect()]


def random_spans(tested: Column, limits: list[tuple[str, int, float]]) -> Column:
    def passes(c: Column) -> Column:
        out = F.lit(False)
        for encoding, band, p in limits:
            out = out | ((c["encoding"] == encoding) & (c["band"] == band) & (c["p"] >= p))
        return (c["kind"] == 0) & out
    return F.filter(tested, passes)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, spans) of every row: spans of known forms and, where none of those overlaps, random strings of the kind ``random``."""
    rows = extracted(docs)
    both = rows.select("doc_id", "known", random_spans(F.col("tested"), thresholds(rows, fdr)).alias("random"))
    clear = F.filter("random", lambda r: ~F.exists("known", lambda k: (k["start"] < r["end"]) & (r["start"] < k["end"])))
    return both.select("doc_id", F.sort_array(F.concat("known", _spans(clear, "random", 3))).alias("spans"))
