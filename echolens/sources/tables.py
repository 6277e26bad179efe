"""The product tables as partitioned Parquet folders under one root.

Mentions and citations are append-only and partitioned by month and the folder of their load, see :mod:`ledger`, with the daily sums of each load of mentions beside
them; what was found in the trials of voted runs is kept likewise, by run. Answers are upserted and partitioned by their run (without its trial suffix): an upsert appends answers of new slots to
the table and those of stored slots to a table of changes beside it, so it rewrites nothing, whatever the size of the run. Readers put both together;
:func:`compact_responses` folds the changes in. Prompts are a dimension and rewritten as a whole.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.operators.answers import base_run
from echolens.operators.metrics import daily_sums
from echolens.schemas import SLOT, TABLES
from echolens.session import release, remove, scratch, stored, tidied
from echolens.sources import ledger

_PART, _MONTH, _LOAD, _DELETED = "part_key", "event_month", "load_id", "deleted"
#: Answers that replace stored ones of their slot, until they are folded in. ``_SEQUENCE`` counts the upserts, later ones win.
CHANGES = "response_changes"
_SEQUENCE = "sequence"
#: Sums per day, prompt and brand of each load of mentions, in a folder of the load's name; they count while the load is in the ledger.
DAYS = "mention_days"
_DAYS = T.StructType([T.StructField("day", T.DateType()), *[T.StructField(c, T.StringType()) for c in ("prompt_id", "brand")],
                      *[T.StructField(c, T.LongType()) for c in ("mentions", "position_sum", "position_count", "positive", "negative")]])
#: What was found in single trials, for votes over trials that come in one after the other.
TRIALS = "vote_trials"
_NO_RUN = "none"


def _run_part() -> Column:
    """The partition of an answer: its run, and one for answers without."""
    return F.coalesce(F.nullif(base_run(), F.lit("")), F.lit(_NO_RUN))


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def create_tables(spark: SparkSession, root: str) -> None:
    """Create missing tables as empty folders; existing ones stay as they are."""
    for name, schema in {**TABLES, DAYS: _DAYS}.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str, since: str | None = None, until: str | None = None,
               runs: list[str] | None = None) -> DataFrame:
    """A table with its declared schema; deleted prompts are hidden.

    ``since`` and ``until`` (days as text, both included) bound ``created_at`` and prune the months of mentions and citations; ``runs``
    bounds the runs (without trial suffix) and prunes the folders of answers. Rows without a time are in no bounded range.
    """
    schema = TABLES[name]
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    place = {"prompts": [T.StructField(_DELETED, T.BooleanType())], "llm_responses": text(_PART)}
    rows = spark.read.schema(T.StructType([*schema.fields, *place.get(name, text(_MONTH, _LOAD))])).parquet(table_path(root, name))
    if name == "prompts":
        rows = rows.filter(~F.coalesce(_DELETED, F.lit(False)))
    if runs is not None:
        rows = rows.filter(F.col(_PART).isin([run or _NO_RUN for run in runs])) if name == "llm_responses" else rows.filter(base_run().isin(runs))
    if name == "llm_responses":
        rows = _with_changes(rows, root, None if runs is None else {run or _NO_RUN for run in runs})
    months = name in ("brand_mentions", "citation_sources")
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
        rows = rows.filter(F.col(_MONTH).between(since[:7], "9999-12")) if months else rows
    if until is not None:
        rows = rows.filter(F.col("created_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
        rows = rows.filter(F.col(_MONTH) <= until[:7]) if months else rows
    return (ledger.listed(rows, root, name, _LOAD) if months else rows).select(*schema.fieldNames())


def latest_days(spark: SparkSession, root: str, name: str, days: int = 2) -> DataFrame:
    """Rows of a table of mentions or citations from as few of its latest months as hold ``days`` different days."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(root, name))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"{_MONTH}=*"))
    months = sorted((m for f in found or [] if (m := f.getPath().getName().split("=", 1)[1]) != "none"), reverse=True)
    rows = read_table(spark, root, name)
    for month in months:
        rows = read_table(spark, root, name, since=f"{month}-01")
        if rows.select(F.to_date("created_at").alias("day")).distinct().limit(days).count() == days:
            break
    return rows


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in its types; columns the frame lacks become NULL."""
    return df.select(*_columns(df, name))


def _columns(df: DataFrame, name: str) -> list[Column]:
    return [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``, and of equal ones by the other columns. An aggregate, so very many copies of a key fold on the map side.

    The columns of ``order`` are part of the row that is compared, so a text among them is shuffled once.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in rest]
    newest = F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)


def clear_loads(spark: SparkSession, root: str, name: str, loads: list[str]) -> None:
    """Take out what loads of these names have stored, in whatever month."""
    ledger.withdraw(spark, root, name, loads)


def sweep_loads(spark: SparkSession, root: str, name: str, older_than: float = 86_400) -> int:
    """Delete what replaced, withdrawn and broken-off loads have left, once it is ``older_than`` seconds old; says how many folders of the table went."""
    if name == "brand_mentions":
        ledger.sweep(spark, root, name, table_path(root, DAYS), _LOAD, older_than)
    return ledger.sweep(spark, root, name, table_path(root, name), _LOAD, older_than)


def append_rows(df: DataFrame, root: str, name: str, load: str | Column | None = None, loads: list[str] | None = None) -> None:
    """Append to a table partitioned by month and load.

    Repeating a load under the same ``load`` name replaces it in every month, which makes replays safe even if rows are stamped anew. Any text is a
    name. A column names the load of each row (a null one counts as empty text); ``loads`` then lists the names, so that one without rows
    replaces its load too, else they are those found. Each load comes into view at once, when all of its rows are written.
    The rebalance hint merges small and splits very large months.
    """
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none"))
    _append(df.select(*_columns(df, name), *_named(load)).withColumn(_MONTH, month), root, name, _MONTH, load, loads)


def _named(load: str | Column | None) -> list[Column]:
    return [F.coalesce(load, F.lit("")).alias("_load_name")] if isinstance(load, Column) else []


def _append(rows: DataFrame, root: str, name: str, part: str, load: str | Column | None, loads: list[str] | None) -> None:
    call = uuid.uuid4().hex[:12]
    if isinstance(load, Column):
        # The names of one call: the runs of a batch.
        loads = loads if loads is not None else [r[0] for r in rows.select("_load_name").distinct().collect()]
        folders = {n: f"{call}-{i}" for i, n in enumerate(loads)}
        of_name = rows.sparkSession.createDataFrame(list(folders.items()), f"_load_name string, {_LOAD} string")
        rows = rows.join(of_name, "_load_name").drop("_load_name")
    else:
        folders = {call if load is None else load: call}
        rows = rows.withColumn(_LOAD, F.lit(call))
    rows.hint("rebalance", F.col(part)).write.partitionBy(part, _LOAD).mode("append").parquet(table_path(root, name))
    if name == "brand_mentions":
        _write_days(rows.sparkSession, root, list(folders.values()))
    ledger.publish(rows.sparkSession, root, name, folders)


def _write_days(spark: SparkSession, root: str, folders: list[str]) -> None:
    """Sum loads of mentions that are written and not yet published, into folders of the same names, so that one rename brings both into view."""
    place = [T.StructField(n, T.StringType()) for n in (_MONTH, _LOAD)]
    rows = spark.read.schema(T.StructType([*TABLES["brand_mentions"].fields, *place])).parquet(table_path(root, "brand_mentions"))
    sums = daily_sums(rows.filter(F.col(_LOAD).isin(folders)), _MONTH, _LOAD)
    sums.hint("rebalance", F.col(_MONTH)).write.partitionBy(_MONTH, _LOAD).mode("append").parquet(table_path(root, DAYS))


def read_days(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, merged: bool = True) -> DataFrame:
    """Stored mentions as sums per day, prompt and brand, what ``metrics.daily_sums`` makes of all of them, without reading any.

    Unless ``merged``, the sums of several loads stay apart, for readers that sum them again to other keys.

    A load that is replaced or withdrawn takes its sums with it, and a load of past days adds to them. ``since`` and ``until`` are days as text, both
    included. Days are those of the time zone of the session that stored the mentions.
    """
    place = [T.StructField(n, T.StringType()) for n in (_MONTH, _LOAD)]
    rows = spark.read.schema(T.StructType([*_DAYS.fields, *place])).parquet(table_path(root, DAYS))
    if since is not None:
        rows = rows.filter((F.col("day") >= F.lit(since).cast("date")) & F.col(_MONTH).between(since[:7], "9999-12"))
    if until is not None:
        rows = rows.filter((F.col("day") <= F.lit(until).cast("date")) & (F.col(_MONTH) <= until[:7]))
    sums = ledger.listed(rows, root, "brand_mentions", _LOAD).select(*_DAYS.fieldNames())
    return daily_sums(sums) if merged else sums


def save_trials(parsed: DataFrame, root: str, load: str) -> None:
    """Keep what was found in single trials, by run."""
    _append(parsed.withColumn(_PART, F.coalesce(base_run(), F.lit("none"))), root, TRIALS, _PART, load, None)


def read_trials(spark: SparkSession, root: str, kind: T.StructType, runs: list[str]) -> DataFrame:
    """What was found in the trials of ``runs``, of the columns ``kind``."""
    if ledger.entries(spark, root, TRIALS) is None:
        return spark.createDataFrame([], kind)
    text = [T.StructField(n, T.StringType()) for n in (_PART, _LOAD)]
    rows = spark.read.schema(T.StructType([*kind.fields, *text])).parquet(table_path(root, TRIALS)).filter(F.col(_PART).isin(runs))
    return ledger.listed(rows, root, TRIALS, _LOAD).select(*kind.fieldNames())


def save_mentions(df: DataFrame, root: str, load: str | Column | None = None) -> None:
    append_rows(df, root, "brand_mentions", load)


def save_citations(df: DataFrame, root: str, load: str | Column | None = None) -> None:
    append_rows(df, root, "citation_sources", load)


def _change_loads(spark: SparkSession, root: str) -> dict[str, tuple[int, str, str]]:
    """Loads of changes not folded in yet: (upsert, run, folder) by name. A handful a run, as compaction takes them away."""
    known = ledger.entries(spark, root, CHANGES)
    split = {row["load"]: (*row["load"].split(":", 2), row["folder"]) for row in (known.collect() if known is not None else [])}
    return {name: (int(sequence), run, folder) for name, (sequence, _, run, folder) in split.items()}


def _changes(spark: SparkSession, root: str, loads: list[tuple[int, str, str]]) -> DataFrame:
    """The rows of these loads of changes; only their folders are read."""
    place = [T.StructField(_SEQUENCE, T.LongType()), T.StructField(_PART, T.StringType()), T.StructField(_LOAD, T.StringType())]
    rows = spark.read.schema(T.StructType([*TABLES["llm_responses"].fields, *place])).parquet(table_path(root, CHANGES))
    return rows.filter(F.col(_PART).isin(sorted({run for _, run, _ in loads})) & F.col(_LOAD).isin([folder for _, _, folder in loads]))


def _with_changes(rows: DataFrame, root: str, runs: set[str] | None) -> DataFrame:
    """Stored answers as the changes of their slots have left them.

    Runs without changes pass as they are; of the others, the slots that changed leave by an anti join and the last change of each comes in.
    """
    spark = rows.sparkSession
    loads = [load for load in _change_loads(spark, root).values() if runs is None or load[1] in runs]
    if not loads:
        return rows
    changes, changed = _changes(spark, root, loads), F.coalesce(F.col(_PART).isin(sorted({run for _, run, _ in loads})), F.lit(False))
    last = latest_rows(changes.drop(_LOAD), [*SLOT, _PART], [_SEQUENCE]).select(*rows.columns)
    kept = unseen_slots(rows.filter(changed), changes)
    return rows.filter(~changed).unionByName(kept).unionByName(last)


def _upsert_prompts(incoming: DataFrame, root: str, order: list[str]) -> None:
    """Add rows; the new row of a prompt replaces the old. ``incoming`` must not read from the table itself.

    The table is merged from storage, as it can't be overwritten while it is being read; the merged copy is removed afterwards.
    """
    spark, path, copy = incoming.sparkSession, table_path(root, "prompts"), scratch(incoming.sparkSession, "prompts-merged")
    incoming = incoming.withColumn(_PART, F.lit("all"))
    known = spark.read.schema(incoming.schema).parquet(path).withColumn("_new", F.lit(0))
    both = known.unionByName(incoming.withColumn("_new", F.lit(1)))
    latest_rows(both, ["prompt_id", _PART], ["_new", *order]).select(*incoming.columns).write.parquet(copy)
    merged = spark.read.schema(incoming.schema).parquet(copy)
    (merged.hint("rebalance", F.col(_PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(_PART).parquet(path))
    remove(spark, copy)


def _append_answers(rows: DataFrame, root: str) -> None:
    with tidied(rows.sparkSession):
        rows.hint("rebalance", F.col(_PART)).write.mode("append").partitionBy(_PART).parquet(table_path(root, "llm_responses"))


def _upsert_responses(rows: DataFrame, root: str, order: list[str], kept: bool) -> None:
    """Append answers of new slots, and write those of stored slots as changes.

    Of the stored answers only the slots of the runs met are read. New slots come first: an upsert that breaks off before its changes are published and
    is repeated finds them stored and writes them as changes to themselves. Rows that are ``kept`` on storage have their slots looked at first: if each is new
    and comes once, no text is compared or copied.
    """
    spark, path = rows.sparkSession, table_path(root, "llm_responses")
    rows = rows.withColumn(_PART, _run_part())
    slots = spark.read.schema(T.StructType([*TABLES["llm_responses"].fields, T.StructField(_PART, T.StringType())])).parquet(path)
    known = (slots.join(rows.select(_PART).distinct(), _PART, "left_semi")
             .select(*[F.col(c).alias(f"known_{c}") for c in SLOT], F.lit(True).alias("known")).distinct())

    def with_known(incoming: DataFrame) -> DataFrame:
        same = [incoming[c].eqNullSafe(known[f"known_{c}"]) for c in SLOT]
        return incoming.join(known, same[0] & same[1] & same[2], "left").select(*incoming.columns, "known")

    if kept and with_known(rows.groupBy(*SLOT, _PART).agg(F.count(F.lit(1)).alias("n"))).filter((F.col("n") > 1) | F.col("known")).isEmpty():
        _append_answers(rows, root)
        return
    incoming = stored(with_known(latest_rows(rows, [*SLOT, _PART], order)), "answers-incoming")
    added, replaced = (incoming.filter(c).drop("known") for c in (F.col("known").isNull(), F.col("known")))
    _append_answers(added, root)
    if not replaced.isEmpty():
        sequence = 1 + max((n for n, _, _ in _change_loads(spark, root).values()), default=0)
        named = replaced.withColumns({_SEQUENCE: F.lit(sequence).cast("long"), "_load_name": F.concat(F.lit(f"{sequence}:{uuid.uuid4().hex}:"), _PART)})
        _append(named, root, CHANGES, _PART, F.col("_load_name"), None)
    release(incoming)


def compact_responses(spark: SparkSession, root: str, share: float = 0.1) -> int:
    """Fold the changes of runs into the answers table and say how many runs that were.

    A run is rewritten once its changes come to ``share`` of its stored answers; 0 folds all. Changes leave the ledger after the run is written, so a
    compaction that breaks off in between is made up for by the next; changes that come in meanwhile stay. No other writer may append
    to these runs at the same time. ``sweep_loads`` of ``CHANGES`` deletes the folders.
    """
    loads = _change_loads(spark, root)
    if not loads:
        return 0
    fields = T.StructType([*TABLES["llm_responses"].fields, T.StructField(_PART, T.StringType())])
    answers, changes = spark.read.schema(fields).parquet(table_path(root, "llm_responses")), _changes(spark, root, list(loads.values()))
    counts = [rows.groupBy(_PART).agg(F.count(F.lit(1)).alias(name)) for rows, name in
              ((answers.filter(F.col(_PART).isin(sorted({run for _, run, _ in loads.values()}))), "n_stored"), (changes, "n_changed"))]
    due = [row[0] for row in counts[1].join(counts[0], _PART).filter(F.col("n_changed") >= share * F.col("n_stored")).select(_PART).collect()]
    if due:
        merged = stored(_with_changes(answers.filter(F.col(_PART).isin(due)), root, set(due)), "answers-merged")
        (merged.hint("rebalance", F.col(_PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(_PART).parquet(table_path(root, "llm_responses")))
        ledger.withdraw(spark, root, CHANGES, [name for name, (_, run, _) in loads.items() if run in due])
        release(merged)
    return len(due)


def save_responses(df: DataFrame, root: str, mode: str = "upsert", order: list[str] | None = None, kept: bool = False) -> None:
    """Store answers. ``upsert``: last one per slot wins, within the batch by ``order``; ``append``: keep all.

    An upsert of a slot that ``append`` has stored several times replaces all of its answers. ``kept`` says that the frame reads from storage, so that
    reading it again costs little and gives the same rows.
    """
    rows = conform(df, "llm_responses")
    if mode == "upsert":
        rest = [c for c in rows.columns if c not in SLOT and c != "created_at"]
        _upsert_responses(rows, root, order or ["created_at", *rest], kept)
    else:
        _append_answers(rows.withColumn(_PART, _run_part()), root)


def unseen_runs(new: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows whose run, with or without its trial suffix, isn't in the stored ``responses``.

    For whole runs only: a run that is still being written or asked again in part needs :func:`unseen_slots`.
    """
    known = responses.select(F.col("run_id").alias("known_run")).distinct()
    return (new.join(known, new["run_id"] == F.col("known_run"), "left_anti")
            .join(known, base_run(new["run_id"]) == F.col("known_run"), "left_anti"))


def unseen_slots(new: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows whose slot (run, prompt, provider) isn't in the stored ``responses``."""
    known = responses.select(*[F.col(c).alias(f"known_{c}") for c in SLOT])
    same = [new[c].eqNullSafe(F.col(f"known_{c}")) for c in SLOT]
    return new.join(known, same[0] & same[1] & same[2], "left_anti")


def upsert_prompts(df: DataFrame, root: str, at: Column | None = None) -> None:
    """Insert or replace prompts; ``created_at`` becomes ``at`` (now by default)."""
    rows = conform(df, "prompts").withColumn("created_at", (at if at is not None else F.current_timestamp()).cast("timestamp"))
    # Kept on storage first: the frame may itself come from the table.
    copy = scratch(df.sparkSession, "prompts-incoming")
    rows.withColumn(_DELETED, F.lit(False)).write.parquet(copy)
    _upsert_prompts(df.sparkSession.read.parquet(copy), root, ["created_at", "prompt_text", "category", "target_brands"])
    remove(df.sparkSession, copy)


def missing_prompts(df: DataFrame, existing: DataFrame) -> DataFrame:
    return df.join(existing.select("prompt_id"), "prompt_id", "left_anti")


def seed_prompts(df: DataFrame, root: str, at: Column | None = None) -> int:
    """Insert the prompts that aren't stored yet and say how many that were."""
    new = stored(missing_prompts(conform(df, "prompts"), read_table(df.sparkSession, root, "prompts")), "seeds")
    upsert_prompts(new, root, at)
    return new.select("prompt_id").distinct().count()


def decode_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.select("prompt_id", "prompt_text", "category", F.from_json("target_brands", "array<string>").alias("target_brands"), "created_at")


def list_prompts(prompts: DataFrame, category: str | None = None) -> DataFrame:
    """Prompts in order of storage, brand lists decoded."""
    rows = decode_prompts(prompts)
    rows = rows if category is None else rows.filter(F.col("category") == category)
    return rows.orderBy("created_at", "prompt_id")


def get_prompt(prompts: DataFrame, prompt_id: str) -> DataFrame:
    return decode_prompts(prompts.filter(F.col("prompt_id") == prompt_id))


def create_prompts(df: DataFrame, root: str, at: Column | None = None) -> DataFrame:
    """Insert new prompts, giving an id where there is none, and return the rows refused because their id exists."""
    fresh = F.concat(F.lit("custom_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
    rows = stored(conform(df, "prompts").withColumn("prompt_id", F.coalesce("prompt_id", fresh)), "new-prompts")
    existing = read_table(df.sparkSession, root, "prompts").select("prompt_id")
    conflicts = stored(rows.join(existing, "prompt_id", "left_semi"), "refused-prompts")
    upsert_prompts(rows.join(conflicts.select("prompt_id"), "prompt_id", "left_anti"), root, at)
    return conflicts


def delete_prompts(ids: DataFrame, root: str) -> int:
    """Delete prompts by id and say how many existed. The rows stay as marked ones that no reader sees."""
    wanted = ids.select("prompt_id").distinct()
    gone = stored(read_table(ids.sparkSession, root, "prompts").join(wanted, "prompt_id", "left_semi"), "deleted-prompts")
    _upsert_prompts(gone.withColumn(_DELETED, F.lit(True)), root, ["created_at"])
    return gone.count()
