"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, run once over each whole text.

A window is ten consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit. Words are runs of ASCII letters (A-Z lower-cased), digits and everything beyond ASCII.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; a null item id counts for hits
but names no item; an id given twice is one item with the windows of both rows.
"""

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.words import slices, split_words

WIDTH = 10
#: Windows of one automaton: about 2 kB each. A larger benchmark is split over several, each run over the text.
MOST_WINDOWS = 60_000
#: Characters of all items together: what the driver and every task must hold. Beyond this the call fails rather than leave items out.
MOST_ITEM_CHARS = 100_000_000

HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"

Window = tuple[str, int, tuple[str, ...]]
_automata: dict[int, tuple[list[Window], ahocorasick.Automaton]] = {}


def _normal(words) -> str:
    """Every row as `` w1 w2 ... wn `` with a newline after it, one character per byte."""
    n = len(words.hash)
    row_of_word = words.row
    extra = np.arange(1, n + 1) + 2 * row_of_word
    ends = np.cumsum(words.size)
    out = np.full(int(ends[-1]) + n + 2 * len(words.counts) if n else 2 * len(words.counts), 0x20, np.uint8)
    if n:
        within = np.arange(int(ends[-1])) - np.repeat(ends - words.size, words.size)
        source = np.repeat(words.start, words.size) + within
        bytes_ = words.data[source]
        upper = (bytes_ >= 0x41) & (bytes_ <= 0x5A)
        out[np.arange(int(ends[-1])) + np.repeat(extra, words.size)] = bytes_ + upper.astype(np.uint8) * 32
    before_bytes = np.append(0, ends)[np.cumsum(words.counts)] if n else np.zeros(len(words.counts), np.int64)
    out[before_bytes + np.cumsum(words.counts) + 2 * np.arange(len(words.counts)) + 1] = 0x0A
    return out.tobytes().decode("latin-1")


def item_windows(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> list[Window]:
    """(normalised window, words, ids of its items), each window once, in order."""
    ids: dict[str, set[str]] = defaultdict(set)
    sizes: dict[str, int] = {}
    for item, text in items:
        words = _normal(split_words(next(slices(pa.array([text], pa.string()))))).split()
        for i in range(max(1, len(words) - width + 1) if words else 0):
            part = words[i:i + width]
            key = f" {' '.join(part)} "
            sizes[key] = len(part)
            ids[key] |= {item} - {None}
    return [(key, sizes[key], tuple(sorted(ids[key]))) for key in sorted(sizes)]


def _automaton(windows: list[Window]) -> ahocorasick.Automaton:
    """Built once per worker process."""
    key = hash(tuple(w[0] for w in windows))
    known = _automata.get(key)
    if known is None or known[0] != windows:
        built = ahocorasick.Automaton()
        for number, (text, _, _) in enumerate(windows):
            built.add_word(text, number)
        built.make_automaton()
        _automata.clear()
        known = _automata[key] = (windows, built)
    return known[1]


def scan(texts: pa.Array, windows: list[Window]) -> list[dict]:
    """Hits of a run of rows."""
    words = split_words(texts)
    n, n_rows = len(words.hash), len(texts)
    depth, items = np.zeros(n + 1, np.int64), defaultdict(set)
    if windows and n:
        # Where each word ends in the normal form: its trailing space is where a window's match ends.
        trailing = np.cumsum(words.size) + np.arange(1, n + 1) + 2 * words.row
        found = np.array(list(_automaton(windows).iter(_normal(words))), np.int64).reshape(-1, 2)
        last = np.searchsorted(trailing, found[:, 0])
        sizes = np.array([w[1] for w in windows])[found[:, 1]]
        np.add.at(depth, last - sizes + 1, 1)
        np.add.at(depth, last + 1, -1)
        pairs = np.unique(np.stack([words.row[last], found[:, 1]], 1), axis=0) if len(found) else found
        for row, number in pairs.tolist():
            items[row].update(windows[number][2])
    hit = np.flatnonzero(np.cumsum(depth)[:n] > 0)
    n_hit = np.bincount(words.row[hit], minlength=n_rows)
    spans = [[] for _ in range(n_rows)]
    if len(hit):
        breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(words.row[hit]) > 0))
        heads, tails = hit[np.append(0, breaks + 1)], hit[np.append(breaks, len(hit) - 1)]
        points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))  # code points before each byte
        for a, b in zip(heads.tolist(), tails.tolist()):
            row = int(words.row[a])
            base = points[words.rows[row]]
            spans[row].append({"start": int(points[words.start[a]] - base), "end": int(points[words.start[b] + words.size[b]] - base)})
    return [{"n_words": int(words.counts[i]), "n_hit": int(n_hit[i]), "spans": spans[i], "items": sorted(items.get(i, ()))} for i in range(n_rows)]


def _scanner(windows: list[Window]):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                      ("items", pa.list_(pa.string()))])

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        return pa.array([row for part in slices(texts) for row in scan(part, windows)], kind)
    return hits


def benchmark_hits(benchmark: DataFrame, text: Column, width: int = WIDTH) -> Column:
    """The hits of a text column as a struct: n_words, n_hit, spans (merged, code points of the original text), items (sorted).

    The benchmark's size is checked before it is read; see ``MOST_ITEM_CHARS``.
    """
    size = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"the benchmark has {size} characters; at most {MOST_ITEM_CHARS} can be sent to every task")
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text").collect()
    windows = item_windows([(r[0], r[1]) for r in rows], width)
    parts = [windows[i:i + MOST_WINDOWS] for i in range(0, len(windows), MOST_WINDOWS)] or [[]]
    found = [_scanner(part)(text) for part in parts]
    if len(found) == 1:
        return found[0]
    spans = F.sort_array(F.flatten(F.array(*[f["spans"] for f in found])))
    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]),
        F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))
    ).otherwise(F.array_append(acc, s)))
    n_hit = F.aggregate(merged, F.lit(0).cast("bigint"), lambda a, s: a + F.regexp_count(
        F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint"))
    return F.struct(found[0]["n_words"].alias("n_words"), n_hit.alias("n_hit"), merged.alias("spans"),
                    F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found])))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hits) of every row."""
    return docs.select("doc_id", benchmark_hits(benchmark, F.col("text"), width).alias("hits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay."""
    return docs.where(benchmark_hits(benchmark, F.col("text"), width)["n_hit"] == 0)
