"""Toxicity as an ordinal regression: P(severity > k) = sigmoid(w.x - t_k), one set of weights under ordered thresholds.

Features are the log counts of words that the labelled sample associates with toxic text. Labels say toxic or not; the grades behind
them are 0 for a clean text, and for a toxic one 1, 2 or 3 by how many of its words are associated ones (under 3, under 6, more).
The expected severity is the sum of P(severity > k), from 0 to 3; a text is toxic where P(severity > 0) is at least one half.

Defined results: null and wordless texts have no features and so the severity of a text without toxic words; without toxic and clean labelled
rows every severity is 0. Labels other than 0 and 1 are not used.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.samples import labelled_sample
from echolens.llm.words import slices, split_words

#: Bounds of the training sample: labelled texts per class, characters of a text, and words in the model.
TEXTS_PER_CLASS, MOST_CHARS, MOST_WORDS = 2000, 30_000, 2000
#: A word is associated with toxic text if this many of the sample's toxic texts hold it, and its share there is so many times that in clean texts.
LEAST_TEXTS, LEAST_RATIO = 4, 8.0
GRADES = (1, 3, 6)

RESULT = "struct<severity:double,p_toxic:double>"


def row_counts(texts: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of the sorted word hashes in each row of a run: (rows, words), rows without any left out of the work."""
    words = split_words(texts)
    out = np.zeros((len(texts), len(vocabulary)), np.float32)
    if len(vocabulary) and len(words.hash):
        at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == words.hash)
        np.add.at(out, (words.row[hit], at[hit]), 1)
    return out


class Model:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def exceedances(self, texts: pa.Array) -> np.ndarray:
        """P(severity > k) for each row and grade."""
        out = []
        for part in slices(texts):
            z = np.log1p(row_counts(part, self.vocabulary)) @ self.weights
            out.append(1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None], -40, 40))))
        return np.concatenate(out) if out else np.zeros((0, len(self.thresholds)))


def associated_words(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Hashes of words over-represented in toxic texts, by shares of texts that hold them; sorted."""
    seen, label = [], []
    at = 0
    for part in slices(pa.array(texts, pa.string())):
        w = split_words(part)
        pairs = np.unique(np.stack([w.row.astype(np.uint64), w.hash]), axis=1)
        seen.append(pairs[1])
        label.append(toxic[at + pairs[0].astype(np.int64)])
        at += len(part)
    if not seen:
        return np.zeros(0, np.uint64)
    words, inverse = np.unique(np.concatenate(seen), return_inverse=True)
    hits = np.bincount(inverse, np.concatenate(label), len(words))
    all_ = np.bincount(inverse, minlength=len(words))
    ratio = ((hits + 0.5) / (toxic.sum() + 1)) / ((all_ - hits + 0.5) / ((1 - toxic).sum() + 1))
    chosen = np.flatnonzero((hits >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
    chosen = chosen[np.argsort(-ratio[chosen] * np.sqrt(hits[chosen]), kind="stable")][:MOST_WORDS]
    return np.sort(words[chosen])


def fit_cumulative(x: np.ndarray, grade: np.ndarray, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative likelihood; thresholds are a first one plus positive gaps.

    Equal rows, most of all those without any associated word, are worked on once with their number as weight.
    """
    n_thresholds = len(GRADES)
    # Grades join the rows in the type of the counts, and only the different rows become doubles: the driver holds this matrix.
    rows, number = np.unique(np.column_stack([x, grade.astype(x.dtype)]), axis=0, return_counts=True)
    x, grade, share = rows[:, :-1].astype(float), rows[:, -1].astype(float), (number / number.sum())[:, None]
    del rows
    w, first, gaps = np.zeros(x.shape[1]), 0.0, np.zeros(n_thresholds - 1)
    params = [w, np.array([first]), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    above = (grade[:, None] > np.arange(n_thresholds)[None]).astype(float)
    for step in range(1, steps + 1):
        t = params[1][0] + np.append(0, np.cumsum(np.exp(params[2])))
        p = 1 / (1 + np.exp(-np.clip((x @ params[0])[:, None] - t[None], -40, 40)))
        d = (p - above) * share                        # of the summed binary likelihoods, which share the weights
        dt = -d.sum(0)
        grads = [x.T @ d.sum(1) + 1e-4 * params[0], np.array([dt.sum()]),
                 np.exp(params[2]) * np.array([dt[k + 1:].sum() for k in range(n_thresholds - 1)])]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[i] = (m, v)
            params[i] = params[i] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return params[0], params[1][0] + np.append(0, np.cumsum(np.exp(params[2])))


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> Model | None:
    sample = labelled_sample(docs, labels, "toxic", [0, 1], TEXTS_PER_CLASS, MOST_CHARS, keep)
    toxic = np.array([label for _, label in sample], float)
    if len(set(toxic)) < 2:
        return None
    texts = [t for t, _ in sample]
    vocabulary = associated_words(texts, toxic)
    counts = np.concatenate([row_counts(part, vocabulary) for part in slices(pa.array(texts, pa.string()))])
    grade = np.where(toxic == 1, np.searchsorted(GRADES, np.maximum(counts.sum(1), 1), "right"), 0)
    return Model(vocabulary, *fit_cumulative(np.log1p(counts, out=counts), grade))


def severity(text: Column, model: Model | None) -> Column:
    """struct<severity, p_toxic> of a text column."""
    if model is None:
        return F.struct(F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"))

    @F.arrow_udf(RESULT)
    def graded(texts: pa.Array) -> pa.Array:
        p = model.exceedances(texts)
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(p[:, 0])], ["severity", "p_toxic"])
    return graded(text)


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic) of every row."""
    graded = docs.select("doc_id", severity(F.col("text"), train(docs, labels)).alias("g"))
    return graded.select("doc_id", "g.severity", "g.p_toxic", (F.col("g.p_toxic") >= 0.5).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows found toxic; all columns stay."""
    return docs.where(severity(F.col("text"), train(docs, labels))["p_toxic"] < 0.5)
