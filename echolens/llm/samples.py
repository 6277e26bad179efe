"""Bounded training samples: at most ``per_class`` rows of each label, chosen by a hash of the id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, classes: list, per_class: int, most_chars: int,
                    keep: Column | None = None) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_class`` labelled ids for each class, of at most ``most_chars`` characters each.

    ``keep`` (over ``doc_id``) says which ids may be learned from. The sample's size doesn't depend on the input's. Only ids with a text that may be
    learned from are chosen, so those of long or missing texts take nobody's place. The chosen ids, at most ``per_class`` a class, are
    broadcast; each gives one text for each of its labels however many rows it has.
    """
    ids = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null")
    if keep is not None:
        ids = ids.where(keep)
    texts = docs.select("doc_id", "text").where(F.length("text") <= most_chars)
    usable = ids.distinct().join(texts.select("doc_id").distinct(), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(label)), "doc_id"]
    chosen = None
    for value in classes:
        part = usable.where(F.col("label") == F.lit(value)).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .select(F.xxhash64("doc_id", F.lit(label)).alias("h"), "text", "label").orderBy("h", "label", "text").collect())
    return [(r["text"], r["label"]) for r in rows]
