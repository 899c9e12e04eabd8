"""A Merkle manifest of documents: digests by source, a root over all, and a proof for every row.

Leaves are SHA-256 digests of a document's fields.  In every source they are put in the order
of doc_id; `FANOUT` neighbours become one node, the digest of their digests, until one is left,
the subroot.  The subroots, ordered by source, become the root in the same way.

A level is a slot pivot: a parent's children are spread into `FANOUT` columns by conditional
aggregates.  The columns put together give the parent's digest, and without a child's own
column its siblings.  Going down again, each parent's columns join the siblings that its own
parent gave it, so that a leaf meets one wide row instead of one for every level.

Sources may hold any part of the rows: leaves are numbered by ranges (`numbering`) and every
join and aggregate is by the source and the parent's number.

Edge rows: a null field is written `-`; a null source is a source of its own, the first; null
ids come first; documents with one id stand in the order of their leaves, so that equal rows
have equal proofs as sets.  A source of one row has its leaf as subroot, a table of one source
that subroot as root, with an empty proof.  An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import ascii_lower, checkpointed
from closeline.llm.numbering import numbered

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SLOTS = [f"c{i}" for i in range(FANOUT)]
#: A leaf's siblings at one level: those before it and those after it.
STEPS = "array<struct<left:string,right:string>>"


def written(field: str | Column) -> Column:
    """A field with the number of its bytes in front; `-` for null."""
    text = (F.col(field) if isinstance(field, str) else field).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, put together; nulls among them are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf_of(**instead: Column) -> Column:
    """A document's leaf, with some fields replaced."""
    return digest(*(written(instead.get(f, f)) for f in FIELDS))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, tree, leaf, presented): a row's tree, its digest and the one to check against the root.

    `presented` differs from `leaf` where `tampered` holds: the text's A-Z are lower-cased.
    """
    forged = F.when(tampered, leaf_of(text=ascii_lower(F.col("text"))))
    return docs.select(
        "doc_id",
        # Null before all others, though in no need of null-safe joins.
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        leaf_of().alias("leaf"),
        forged.alias("presented"),
    )


def raised(nodes: DataFrame) -> DataFrame:
    """A row per parent of `nodes` (tree, place, n_rows, digest): its children by slot and its own digest."""
    spread = [F.expr(f"max(CASE WHEN place % {FANOUT} = {i} THEN digest END) AS {c}") for i, c in enumerate(SLOTS)]
    wide = nodes.groupBy("tree", "n_rows", F.expr(f"place div {FANOUT} AS place")).agg(*spread)
    parents = f"(n_rows + {FANOUT - 1}) div {FANOUT} AS n_rows"
    return wide.selectExpr("tree", "place", parents, *SLOTS, f"sha2({together(SLOTS)}, 256) AS digest")


def together(digests: list[str]) -> str:
    """SQL text of the digests put together; a null one is left out."""
    return f"concat_ws('', {', '.join(digests)})"


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The parents of every level, from the leaves up; a tree with one node left goes no further."""
    out: list[DataFrame] = []
    most = nodes.agg(F.max("n_rows")).first()[0] or 0
    while most > 1:
        out.append(checkpointed(raised(nodes.where("n_rows > 1").select("tree", "place", "n_rows", "digest"))))
        nodes, most = out[-1], -(-most // FANOUT)
    return out


def siblings() -> Column:
    """The children beside the node at `place`, before and after it."""
    left, right = (
        together([f"CASE WHEN place % {FANOUT} {side} {i} THEN {c} END" for i, c in enumerate(SLOTS)]) for side in "><"
    )
    return F.expr(f"named_struct('left', {left}, 'right', {right})")


def tops(nodes: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node each tree ends in."""
    return reduce(DataFrame.unionByName, (level.where("n_rows = 1").select("tree", "digest") for level in (nodes, *parents)))


def placed(nodes: DataFrame, above: DataFrame, top: DataFrame, carried: list[str]) -> DataFrame:
    """`nodes` with `steps`, their siblings level by level up to the root, and the `carried` columns.

    The last node of a tree takes them from `top`, a row per tree, the others from their parent
    in `above`, which has its children by slot.
    """
    last = nodes.where("n_rows = 1").join(top.select("tree", "steps", *carried), "tree")
    kept = above.select("tree", F.col("place").alias("_parent"), *SLOTS, "steps", *carried)
    others = nodes.where("n_rows > 1").withColumn("_parent", F.expr(f"place div {FANOUT}")).join(kept, ["tree", "_parent"])
    return last.unionByName(others.select(*nodes.columns, F.concat(F.array(siblings()), "steps").alias("steps"), *carried))


def climbed(nodes: DataFrame, parents: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """`nodes` as `placed`, made from the top level down, a level at a time.

    Each level of parents is written before the next one meets it: joined in one plan, the
    stages of all levels would run side by side and hold their tables together.
    """
    if not parents:
        return nodes.join(top.select("tree", "steps", *carried), "tree")
    above = checkpointed(parents[-1].join(top.select("tree", "steps", *carried), "tree"))
    for level in parents[-2::-1]:
        # The level's own children by slot keep other names while its parent's are read.
        own = level.withColumnsRenamed({c: f"_{c}" for c in SLOTS})
        above = checkpointed(placed(own, above, top, carried).withColumnsRenamed({f"_{c}": c for c in SLOTS}))
    return placed(nodes, above, top, carried)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that `leaf` gives with its siblings."""
    return F.aggregate(steps, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `tampered` tells which rows are presented with another text than the manifest was made of.
    """
    nodes = checkpointed(numbered(leaves(docs.select(*FIELDS), tampered), "tree", ["doc_id", "leaf"]))
    nodes = nodes.withColumn("digest", F.col("leaf"))
    parents = levels(nodes)
    subroots = checkpointed(tops(nodes, parents))
    sources = numbered(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("source_tree"), "digest"), "tree", ["source_tree"])
    sources = checkpointed(sources)
    over = levels(sources)
    root = tops(sources, over).select("tree", F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))
    ends = climbed(sources, over, root, ["root"]).select(
        F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"
    )
    found = climbed(nodes, parents, checkpointed(ends), ["subroot", "root"])
    proof = F.flatten(F.transform("steps", lambda step: F.array(step["left"], step["right"])))
    found = found.withColumn("folded_root", folded(F.coalesce("presented", "leaf"), F.col("steps")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(proof, "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"),
    )


def every_fifth() -> Column:
    """Documents whose decimal id has a CRC-32 that 5 divides."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
