"""Chat formatting in budgeted windows, on DataFrame functions alone.

Turns of a conversation are laid out by the prefix sums of their tokens. A span is a run of turns whose sums end in the same stride; the
stride is half of what the budget leaves beside the system turn and the history, so a span of turns no longer than the stride never
exceeds the budget. A longer turn is a span of its own and is never cut. Every window holds the conversation's opening system turn, up
to ``history_turns`` turns before the span within ``history_tokens``, and the span itself. Only assistant turns of the span are targets: what
is repeated is masked, so each assistant text is learned from once.

A turn reads ``<s>[INST]role[/INST]text</s>``. Where a role or text holds one of these control strings, with any number of backslashes after
its first character, one more backslash goes there; taking one away restores the original.

Defined results: null texts and roles count as empty; turns are ordered by turn (nulls first), role, text, and repeated rows are turns of
their own; a null conv_id is a conversation like any other; a conversation without assistant turns has windows without targets.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 128
#: Tokens that the control strings and the role add to a turn.
TURN_TOKENS = 4
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^ \t\n\x0B\f\r\p{L}\p{N}]"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?s>|/?INST\])", "$1$2$3")


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, first_turn, n_repeated, tokens, formatted, loss) with ``loss`` an array<struct<start, end>> of code points.

    The first ``n_repeated`` turns of ``formatted`` stand in an earlier window too. One shuffle, by conversation; sums and spans are window
    functions over sorted rows and only the turns of a single window, which the budget bounds, are put together.
    """
    if budget < 8 or history_turns < 0 or history_tokens < 0:
        raise ValueError("the budget must be at least 8 tokens and the history not negative")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long"))
            .withColumn("n", F.row_number().over(w)).withColumn("end", F.sum("tokens").over(upto))
            .withColumn("before", F.col("end") - F.col("tokens"))
            .withColumn("opening", F.first(F.struct("role", "text", "tokens")).over(upto)))
    system = F.col("opening.role") == "system"
    stride = F.greatest(F.lit(1), F.floor((budget - history_tokens - F.when(system, F.col("opening.tokens")).otherwise(0)) / 2))
    rows = (rows.withColumn("stride", stride).withColumn("long", F.col("tokens") > F.col("stride"))
            .withColumn("long_before", F.sum(F.col("long").cast("int")).over(upto))
            .withColumn("place", F.struct(F.floor((F.col("end") - 1) / F.col("stride")).alias("bucket"), "long_before", "long")))
    # A long turn opens a span, and so does the turn after it: both change `long_before` or `long`.
    rows = rows.withColumn("starts", F.coalesce(F.lag("place").over(w) != F.col("place"), F.lit(True)).cast("int"))
    rows = rows.withColumn("window", F.sum("starts").over(upto))
    piece = F.struct("n", "role", "text", "tokens")
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(2).alias("part")))
    kept = F.when(system & (F.col("n") > 1) & (F.col("starts") == 1), F.array(F.struct(F.col("window").alias("window"), F.lit(0).alias("part")))) \
        .otherwise(F.array().cast("array<struct<window:bigint,part:int>>"))
    # A turn is history of each span that starts at one of the next turns, as far as both limits reach.
    later = [F.struct(F.lead("window", k).over(w).alias("window"), F.lead("starts", k).over(w).alias("starts"), F.lead("before", k).over(w).alias("before"))
             for k in range(1, history_turns + 1)]
    if later:
        rows = rows.withColumn("later", F.array(*later))
        near = F.filter("later", lambda x: (x["starts"] == 1) & (x["before"] - F.col("before") <= history_tokens))
        history = F.when(system & (F.col("n") == 1), F.array().cast("array<struct<window:bigint,part:int>>")).otherwise(
            F.transform(near, lambda x: F.struct(x["window"].alias("window"), F.lit(1).alias("part"))))
        places = F.concat(own, kept, history)
    else:
        places = F.concat(own, kept)
    spread = rows.select("conv_id", "opening", piece.alias("own"), F.explode(places).alias("at"))
    turn = F.when(F.col("at.part") == 0, F.struct(F.lit(1).alias("n"), F.col("opening.role"), F.col("opening.text"), F.col("opening.tokens"))).otherwise(F.col("own"))
    grouped = spread.groupBy("conv_id", F.col("at.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("at.part").alias("part"), turn["n"].alias("n"), turn["role"].alias("role"),
                                             turn["text"].alias("text"), turn["tokens"].alias("tokens")))).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    laid = grouped.withColumn("heads", heads).withColumn("bodies", bodies)
    size = lambda i: F.length(F.get(F.col("heads"), i)) + F.length(F.get(F.col("bodies"), i)) + 4
    loss = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
                       lambda acc, i: F.struct((acc["at"] + size(i)).alias("at"), F.when(
                           (F.get(F.col("turns"), i)["part"] == 2) & (F.get(F.col("turns"), i)["role"] == "assistant"),
                           F.array_append(acc["spans"], F.struct((acc["at"] + F.length(F.get(F.col("heads"), i))).alias("start"), (acc["at"] + size(i) - 4).alias("end"))))
                           .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return laid.select(
        "conv_id", "window", F.array_min(F.transform(F.filter("turns", lambda t: t["part"] == 2), lambda t: t["n"])).alias("first_turn"),
        F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit("</s>"))), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations as their windows tell them: turns (array of role and text) and target text, from ``formatted`` and ``loss`` alone."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), 1)
    texts = F.regexp_extract_all("formatted", F.lit(TURN), 2)
    both = F.arrays_zip(F.transform(roles, unescape).alias("role"), F.transform(texts, unescape).alias("text"))
    turns = F.slice(both, F.col("n_repeated") + 1, F.greatest(F.size(both) - F.col("n_repeated"), F.lit(0)))
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    parts = formatted.select("conv_id", "window", F.struct("window", turns.alias("turns"), target.alias("target"), F.length("formatted").alias("chars")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
                        F.array_join(F.transform("parts", lambda p: p["target"]), "").alias("target"), F.size("parts").alias("n_windows"),
                        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["chars"]).alias("formatted_chars"))
