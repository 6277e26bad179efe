"""Merkle manifest of a data set: one tree per language, one tree over the languages' roots, and a proof for every row.

Leaves are numbered within their language over the whole cluster and cut into superblocks of ``2**DEPTH`` neighbours. A first pass reduces each
superblock to its top node; the tops are a far shorter sequence of the same kind, treated the same way until every tree fits one
superblock. On the way back, leaves and the outer nodes that their superblock needs (its path to the root) are cogrouped by superblock,
and one call finishes the local reduction, joins local and outer proof and folds every leaf to the root. No call sees more than one
superblock, whatever a language's share of the rows, and the driver sees no digest.

Defined results: null columns enter a leaf as ``-``; rows of a null language are a language of their own, the first; within a language
null ids come first, and rows of equal id follow each other by leaf, so equal rows get their places in any order with equal results as a set.
A null id counts as not tampered with. An empty table gives no rows. Other columns of the input are ignored.
"""

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.session import stored

#: A superblock holds at most 2**DEPTH nodes.
DEPTH = 12
TAMPERED = 7
PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

# A step towards the root: "L" or "R" with the digest of the node to that side, or nothing for a node that is alone in its run.
Steps = list[str]


def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def fold(digest: str, steps: Steps) -> str:
    for step in steps:
        digest = parent([step[1:], digest] if step[:1] == "L" else [digest, step[1:]])
    return digest


def reduce_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of ``levels`` levels above the digests, these first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([parent(below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def steps_of(levels: list[list[str]], index: int) -> Steps:
    """The steps of one node up to the last level."""
    steps = []
    for nodes in levels[:-1]:
        other = index ^ 1
        steps.append(("L" if other < index else "R") + nodes[other] if other < len(nodes) else "")
        index >>= 1
    return steps


def height(nodes: int) -> int:
    """Levels until one of ``nodes`` nodes remains."""
    return (nodes - 1).bit_length()


def _local(part: pd.DataFrame, depth: int) -> list[list[str]]:
    """The levels of one superblock: all of them where it is the whole tree, else exactly ``depth``."""
    return reduce_levels(part["digest"].tolist(), min(depth, height(int(part["n"].iloc[0]))))


def _joined(part: pd.DataFrame, outer: pd.DataFrame, depth: int) -> list[Steps]:
    """Whole paths of a superblock's nodes, ordered by their index."""
    levels = _local(part, depth)
    beyond = list(outer["steps"].iloc[0])
    return [steps_of(levels, i) + beyond for i in range(len(part))]


def _top(key: tuple, part: pd.DataFrame, depth: int) -> pd.DataFrame:
    return pd.DataFrame({"tree": [key[0]], "index": [key[1]], "n": [((int(part["n"].iloc[0]) - 1) >> depth) + 1],
                         "digest": [_local(part.sort_values("index"), depth)[-1][0]]})


def outer_paths(blocked: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(tree, block, steps) from the top of every superblock on, and (tree, root); from nodes (tree, block, index, n, digest)."""
    tops = stored(blocked.select("tree", "block", "index", "n", "digest").groupBy("tree", "block")
                  .applyInPandas(lambda key, part: _top(key, part, depth), "tree long, index long, n long, digest string"), "merkle-tops")
    if tops.where("n > 1").isEmpty():
        roots = tops.select("tree", F.col("digest").alias("root"))
        return tops.select("tree", F.col("index").alias("block"), F.array().cast("array<string>").alias("steps")), roots
    upper, roots = paths(tops, depth)
    return upper.withColumnRenamed("index", "block"), roots


def paths(nodes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(tree, index, steps) of all nodes and (tree, root) of all trees, from nodes (tree, index, n, digest) with ``n`` nodes a tree."""
    blocked = nodes.withColumn("block", F.shiftright("index", depth))
    outer, roots = outer_paths(blocked, depth)

    def joined(part: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        return pd.DataFrame({"tree": part["tree"], "index": part["index"], "steps": _joined(part, beyond, depth) if len(part) else []})

    found = blocked.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(joined, "tree long, index long, steps array<string>")
    return stored(found, "merkle-paths"), roots


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index``, the place of each among those of equal ``group`` by ``order``, from 0, and ``n``, their number.

    The rows are dealt to sorted slices and written, which fixes their places; the slices' counts, summed per group, shift them. A group of any size is spread over many slices.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.withColumn("_slice", F.shiftright(at, 33)).withColumn("_at", at), "merkle-places")
    counts = dealt.groupBy(group, "_slice").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))
    by = Window.partitionBy(group)
    before = by.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each slice that a group reaches into.
    shifts = counts.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), (F.coalesce(F.sum("_here").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_here").over(by).alias("n"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of"))
    return dealt.join(shifts, same).withColumn("index", F.col("_at") + F.col("_shift")).drop("_slice", "_at", "_group", "_of", "_shift")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column) -> Column:
    """Digest of a row whose ``n_chars`` is given."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang")], _field(n_chars), _field(F.col("text"))).cast("binary"), 256)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, with every ``TAMPERED``-th id by hash tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    claimed = F.when(tampered, leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).otherwise(leaf(F.col("n_chars")))
    rows = docs.select("lang", "doc_id", leaf(F.col("n_chars")).alias("digest"), claimed.alias("claimed"))
    leaves = placed(rows, "lang", ["doc_id", "digest"])
    langs = leaves.groupBy("lang").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0))
    trees = stored(placed(langs, "all", ["lang"]).select(F.col("lang").alias("of_lang"), F.col("index").alias("tree"), F.col("n").alias("trees")), "merkle-trees")
    # The id goes through pandas as text: a null would turn the column into floats.
    blocked = stored(leaves.join(trees, F.col("lang").eqNullSafe(F.col("of_lang")))
                     .select("tree", F.shiftright("index", depth).alias("block"), "index", "n", F.col("doc_id").cast("string").alias("doc_id"), "digest", "claimed"), "merkle-leaves")

    within, subroots = outer_paths(blocked, depth)
    # The languages' roots are the leaves of one more tree.
    sizes = trees.select("tree", "trees")
    top_nodes = subroots.join(sizes, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("trees").alias("n"), F.col("root").alias("digest"))
    above, roots = paths(top_nodes, depth)
    root = roots.select(F.lit(0).alias("all"), "root")  # one row
    climbs = above.select(F.col("index").alias("tree"), F.col("steps").alias("above"), F.lit(0).alias("all")).join(F.broadcast(root), "all")
    outer = (within.join(subroots.withColumnRenamed("root", "subroot"), "tree").join(climbs, "tree")
             .select("tree", "block", F.concat("steps", "above").alias("steps"), "subroot", "root"))

    def proven(part: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        if part.empty:
            return pd.DataFrame({c: [] for c in PROOF})
        steps, root = _joined(part, beyond, depth), beyond["root"].iloc[0]
        folded = [fold(d, s) for d, s in zip(part["claimed"], steps)]
        return pd.DataFrame({"doc_id": part["doc_id"], "leaf": part["digest"], "subroot": beyond["subroot"].iloc[0], "root": root,
                             "proof_sha256": [parent([x[1:] for x in s]) for s in steps], "folded_root": folded, "verified": [f == root for f in folded]})

    proofs = (blocked.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
              .applyInPandas(proven, ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in PROOF)))
    return proofs.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
