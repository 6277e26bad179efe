"""Quality classification by compression: zstandard dictionaries of good and bad text, and how much better one of them fits.

A whole text is cut into blocks; each is compressed with the dictionary of good and with that of bad text. The normalised size difference
(good - bad) / (good + bad), summed over all blocks before dividing, says which fits better; where a text repeats itself both sizes are small
and say little, so the logarithm of the compressed share of the text stands beside it. A logistic curve over the two (and the square of
the latter), fitted on labelled texts that the dictionaries have not seen, gives the probability.

Defined results: a null or empty text has difference 0 and a compressed share of 1, and gets the score of those; without rows of both labels
every score is 0.5.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.samples import id_remainder, labelled_sample
from echolens.llm.words import raw, slices

#: Bounds of the training sample: labelled texts per class and characters of a text. Half trains the dictionaries, half the curve.
TEXTS_PER_CLASS, MOST_CHARS = 600, 20_000
DICTIONARY_BYTES = 112 << 10
BLOCK = 1024
LEVEL = 3


class Model:
    """Two dictionaries and the curve from compressed sizes to probability."""

    def __init__(self, good: bytes, bad: bytes, curve: np.ndarray | None = None):
        self.good, self.bad, self.curve = good, bad, curve

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """(rows, 3): bytes with the good dictionary, with the bad one, and uncompressed."""
        good, bad = self.compressors()
        out = []
        for part in slices(texts):
            data, rows = raw(part)
            whole = memoryview(data.tobytes())
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                g = h = 0
                for k in range(a, b, BLOCK):
                    block = whole[k:min(k + BLOCK, b)]
                    g += len(good.compress(block))
                    h += len(bad.compress(block))
                out.append((g, h, b - a))
        return np.array(out, float).reshape(-1, 3)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Size difference, log share, its square, and 1 for the offset."""
        g, h, n = self.sizes(texts).T
        some = n > 0
        difference = np.divide(g - h, g + h, out=np.zeros_like(g), where=some)
        share = np.log(np.divide(g + h, 2 * n, out=np.ones_like(g), where=some))
        return np.stack([difference, share, share * share, np.ones_like(g)], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -40, 40)))


def dictionary(texts: list[str]) -> bytes:
    """Equal shares of every text, so that no single one fills the dictionary."""
    share = max(64, DICTIONARY_BYTES // max(1, len(texts)))
    parts = [t.encode()[i:i + share] for t in texts for i in [max(0, (len(t.encode()) - share) // 2)]]
    return b"\n".join(parts)[:DICTIONARY_BYTES]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton steps, classes weighted alike, with a weak pull towards 0."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = x / scale
    weight = np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum()))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        grad = z.T @ (weight * (p - y)) + 0.1 * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(b))
        b -= np.linalg.solve(hess, grad)
    return b / scale


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> Model | None:
    sample = labelled_sample(docs, labels, "quality", [0, 1], TEXTS_PER_CLASS, MOST_CHARS, keep)
    by = {v: [t for t, label in sample if label == v and t] for v in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return None
    model = Model(dictionary(by[1][::2]), dictionary(by[0][::2]))
    rest = [(t, v) for v in (0, 1) for t in by[v][1::2]]
    model.curve = fit_curve(model.features(pa.array([t for t, _ in rest], pa.string())), np.array([v for _, v in rest], float))
    return model


def quality_score(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))
    return score(text)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learned from labelled rows that aren't held out."""
    remainder = id_remainder(F.col("doc_id"), modulus)
    model = train(docs, labels, remainder != held)
    scored = docs.select("doc_id", (remainder == held).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
