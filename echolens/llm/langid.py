"""Language identification with a small byte convolutional network, trained in numpy.

Fixed-length windows of bytes go through filters of several widths, max pooling over the window and a softmax. A text's probabilities are
the mean over all of its windows, so every byte counts however long it is. Filters over byte embeddings are sums of table entries per
byte and place, so applying one is a look-up.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any training row every text is.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.samples import id_remainder
from echolens.llm.words import raw, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 10     # per width
EMBEDDING = 6
#: Bounds of the training sample: texts per language, texts of all languages (which lowers the former, every language has one at least),
#: characters read from the start of a text, windows taken from a text.
TEXTS_PER_LANGUAGE, MOST_TEXTS, MOST_CHARS, WINDOWS_PER_TEXT = 300, 30_000, 20_000, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a run of rows, and the row of each: (n, WINDOW) bytes with A-Z lower-cased and 0 after the text's end."""
    data, rows = raw(texts)
    sizes = np.diff(rows)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    out = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = np.arange(len(data)) - np.repeat(rows[:-1], sizes) + np.repeat((np.cumsum(counts) - counts) * WINDOW, sizes)
    upper = (data >= 0x41) & (data <= 0x5A)
    out[at] = data + upper.astype(np.uint8) * 32
    return out.reshape(-1, WINDOW), row


class Network:
    """Embedding, filters, max pooling, softmax. ``labels`` are the languages in the order of the outputs."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                  "u": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
                  "o": np.zeros(len(labels), np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest value of each filter in each window, and where it was."""
        out, where = [], {}
        for w in WIDTHS:
            tables = np.einsum("be,wef->wbf", self.p["e"], self.p[f"k{w}"]).astype(np.float32)
            n = WINDOW - w + 1
            total = tables[0][x[:, :n]]
            for j in range(1, w):
                total += tables[j][x[:, j:n + j]]
            where[w] = total.argmax(1)
            best = np.take_along_axis(total, where[w][:, None, :], 1)[:, 0] + self.p[f"b{w}"]
            out.append(np.maximum(best, 0))
        return np.concatenate(out, 1), where

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = self.pooled(x)[0] @ self.p["u"] + self.p["o"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h, where = self.pooled(x)
        logits = h @ self.p["u"] + self.p["o"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None] / len(y)
        g = {"u": h.T @ d, "o": d.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["u"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            g[f"k{w}"] = np.zeros_like(self.p[f"k{w}"])
            for j in range(w):
                seen = np.take_along_axis(x, where[w] + j, 1)              # (n, filters) bytes under the maximum
                vectors = self.p["e"][seen]
                g[f"k{w}"][j] = np.einsum("nf,nfe->ef", part, vectors)
                np.add.at(g["e"], seen, part[:, :, None] * self.p[f"k{w}"][j].T[None])
        g["e"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> "Network":
        rng = np.random.Generator(np.random.PCG64(seed))
        weight = (len(y) / len(self.labels) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                part, step = order[k:k + BATCH], step + 1
                for name, grad in self.gradients(x[part], y[part], weight[y[part]]).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.999 * second[name] + 0.001 * grad * grad
                    self.p[name] -= (RATE * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
        return self


def train(docs: DataFrame, keep: Column | None = None) -> Network | None:
    """A network for the languages of ``docs``, learned from a bounded sample of rows for which ``keep`` holds."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    if keep is not None:
        known = known.where(keep)
    counts = known.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return None
    labels = sorted(r["lang"] for r in counts)
    number = {label: i for i, label in enumerate(labels)}
    wanted = max(1, min(TEXTS_PER_LANGUAGE, MOST_TEXTS // len(labels)))
    # A hash threshold per language gives about twice the wanted texts, and never none; the rest is cut below. The sort is over the sample alone.
    shares = known.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * wanted + 20) / r["count"])) for r in counts], "lang string, share double")
    h = F.xxhash64("doc_id", "text")
    chance = F.pmod(h, F.lit(1 << 20)) / float(1 << 20)
    sample = (known.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select(h.alias("h"), "lang", F.substring("text", 1, MOST_CHARS).alias("text"))
              .orderBy("h", "lang").limit((4 * wanted + 40) * len(labels)).collect())
    taken, xs, ys = dict.fromkeys(labels, 0), [], []
    for r in sample:
        if taken[r["lang"]] < wanted:
            taken[r["lang"]] += 1
            for part in slices(pa.array([r["text"]], pa.string())):
                x, _ = windows_of(part)
                x = x[np.linspace(0, len(x) - 1, min(len(x), WINDOWS_PER_TEXT)).astype(int)] if len(x) else x
                xs.append(x)
                ys.append(np.full(len(x), number[r["lang"]]))
    x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, int))
    return Network(labels).fit(x, y) if len(y) else None


def _scorer(network: Network):
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in slices(texts):
            x, row = windows_of(part)
            sums = np.zeros((len(part), len(network.labels)))
            for k in range(0, len(x), 256):
                np.add.at(sums, row[k:k + 256], network.probabilities(x[k:k + 256]))
            mean = sums / np.maximum(np.bincount(row, minlength=len(part)), 1)[:, None]
            langs += [network.labels[i] for i in mean.argmax(1)]
            scores += mean.max(1).tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1), pa.float64())], fields=list(kind))
    return predicted


def predicted_language(text: Column, network: Network | None) -> Column:
    """struct<lang, score> of a text column."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if network is None:
        return unknown
    return F.when(text.rlike(r"\p{L}"), _scorer(network)(text)).otherwise(unknown)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from rows that aren't held out."""
    remainder = id_remainder(F.col("doc_id"), modulus)
    network = train(docs, remainder != held)
    found = docs.select("doc_id", (remainder == held).alias("held_out"), predicted_language(F.col("text"), network).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
