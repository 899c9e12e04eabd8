"""Mixing sources to target weights by fixed-length token blocks.

Every source's documents, in a fixed order, are one stream of words, cut into blocks of
`block_words`; the last block of a source may be shorter.  A source's target is reached by
slots: whole passes over its blocks, then a part of one more, its last slot cut to the word.
Each slot draws its output shard, so the numbers of a source's slots in the shards are one
multinomial draw, and a shard's composition follows the target weights.  Slot i of a pass
takes block (a * (i + 1) - 1) mod n, a permutation for `a` prime to n, with another `a` in
each pass and source; it leaves the short block last.  Slots and blocks meet in a join by
source and block index, where no key has more rows than a block has documents.  That join
is a sort-merge one: slots come of few rows, and would look small enough to broadcast.

A stream's offsets come from sums over chunks of documents at three levels, so that a source
with a third of all rows is never one window.  Slots are spread out in two steps for the
same reason.  There is one row per source in the tables that are ordered as a whole.

A null text has no words; a null source is a source of its own, the last; a source without
words has target 0.  Repeated rows are documents of their own and may take different words.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closeline.llm.common import bind, checkpointed, joined, n_space_words, space_words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Output words as a share of all words, and the largest number of passes over a source.
SHARE, MOST_PASSES = 1.5, 2
BLOCK_WORDS = 64
SHARD_BLOCKS = 8192
#: Chunks at each of the two levels of a source's stream.
CHUNKS = 256
#: Slots made from one row at a time.
SPREAD = 4096
#: Slots made in one task, as long as there are not too many tasks; beyond that tasks make more.
TASK_SLOTS, MOST_TASKS = 1 << 18, 20_000
#: Fixed value: a prime above any number of blocks, so prime to it, as are its powers.
PRIME = (1 << 61) - 1


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash) of every document."""
    return docs.select("doc_id", "source", n_space_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(number, source, source_size, weight, target) of every source.

    Targets are weight times one level, but at most `most` times the source.  In order of
    that limit per weight, sources stop until the level which the others share is below
    the next limit.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = summed.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*(F.lit(w) for w in weights))
    ranked = ranked.withColumn("weight", F.get(listed, (F.col("number") - 1) % len(weights)))
    ranked = ranked.withColumn("most", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    wanted = F.sum("source_size").over(whole) * float(share)
    left = wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    stopped = F.col("most") < F.col("weight") * F.col("level")
    level = F.min(F.when(~stopped, F.struct(F.col("most") / F.col("weight"), "number", "level"))).over(whole)["level"]
    shared = levels.withColumn("shared", level)
    target = F.least("most", F.coalesce(F.col("shared") * F.col("weight"), F.col("most")))
    return shared.select("number", "source", "source_size", "weight", target.alias("target"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`sources` with words to take, blocks n, whole passes, and words of the part pass."""
    return (
        sources.withColumn("words", F.round("target").cast("long"))
        .where("source_size > 0")
        .withColumn("n", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        .withColumn("passes", F.expr("words div source_size"))
        .withColumn("part", F.expr("words % source_size"))
        .withColumn("slots", F.expr(f"passes * n + (part + {block_words - 1}) div {block_words}"))
    )


def slots(quota: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(number, slot, shard, block, take): the block of every slot, and its words to take."""
    total = quota.agg(F.sum("slots").alias("slots")).first().slots or 0
    spread = quota.where("slots > 0").withColumn("group", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SPREAD})")))
    # The rows are few now and many slots later: a stated number keeps them from being merged into one task.
    spread = spread.repartition(min(MOST_TASKS, max(1, -(-total // TASK_SLOTS))), "number", "group")
    last = F.least(F.lit(SPREAD), F.col("slots") - F.col("group") * SPREAD) - 1
    each = spread.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.col("group") * SPREAD + i)))
    each = each.withColumn("pass", F.expr("slot div n")).withColumn("i", F.expr("slot % n"))
    whole = "cast({} AS decimal(38,0))"
    step = f"cast({PRIME}L % n AS bigint)"
    for power in range(2, 4):
        product = f"cast(({whole.format(step)} * {PRIME}L) % n AS bigint)"
        step = f"if((number + pass + {seed}) % 3 >= {power - 1}, {product}, {step})"
    each = each.withColumn("a", F.expr(step))
    block = f"cast((({whole.format('a')} * (i + 1)) + n - 1) % n AS bigint)"
    take = f"if(pass < passes, {block_words}L, least({block_words}L, part - i * {block_words}))"
    shard = F.pmod(F.xxhash64(F.lit(seed), "number", "slot"), F.lit(max(1, -(-total // shard_blocks))))
    return each.select("number", "slot", shard.alias("shard"), F.expr(block).alias("block"), F.expr(take).alias("take"))


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """`sizes` with its source's columns and `start`, the words before it in the stream."""
    leaf = f"pmod(coalesce(doc_id, text_hash), {CHUNKS * CHUNKS}L)"
    rows = joined(sizes, sources, ["source"]).withColumn("leaf", F.expr(leaf))
    rows = rows.withColumn("top", F.expr(f"leaf div {CHUNKS}"))
    leaves = rows.groupBy("number", "top", "leaf").agg(F.sum("size").alias("words"))
    tops = leaves.groupBy("number", "top").agg(F.sum("words").alias("words"))

    def before(words: str, *within: str, by: tuple[str, ...]) -> Column:
        frame = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(words).over(frame), F.lit(0))

    tops = tops.select("number", "top", before("words", "number", by=("top",)).alias("top_start"))
    leaves = leaves.withColumn("leaf_start", before("words", "number", "top", by=("leaf",)))
    leaves = leaves.join(tops, ["number", "top"])
    leaves = leaves.select("number", "leaf", (F.col("leaf_start") + F.col("top_start")).alias("leaf_start"))
    order = ("doc_id", "size", "text_hash")
    rows = rows.withColumn("within", before("size", "number", "leaf", by=order))
    rows = rows.join(leaves, ["number", "leaf"])
    return rows.withColumn("start", F.col("leaf_start") + F.col("within")).drop("leaf_start", "within", "top", "leaf")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block that holds words of it: `block`, and `from`, `to` in it."""
    last = f"(start + size - 1) div {block_words}"
    cut = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, {last})")))
    cut = cut.withColumn("from", F.expr(f"greatest(start - block * {block_words}, 0L)"))
    return cut.withColumn("to", F.expr(f"least(start + size - block * {block_words}, {block_words}L)"))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(shard, number, slot, block, doc_id, text_hash, start, from, words, ...): what the mix takes.

    `first_word` is the first taken word in its document, `words` how many are taken.
    """
    sizes = checkpointed(sized(docs))
    sources = checkpointed(targets(sizes))
    rows = streams(sizes, sources)
    drawn = slots(quotas(sources, block_words), block_words, shard_blocks, seed)
    taken = pieces(rows, block_words).join(drawn.hint("merge"), ["number", "block"])
    taken = taken.withColumn("words", F.least("to", "take") - F.col("from")).where("words > 0")
    first = F.expr(f"block * {block_words} + `from` - start")
    return taken.withColumn("first_word", first)


def mix_digest(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    sizes = checkpointed(sized(docs))
    sources = checkpointed(targets(sizes))
    rows = checkpointed(streams(sizes, sources))
    drawn = slots(quotas(sources))
    key = ["number", "start", "doc_id", "size", "text_hash"]
    taken = pieces(rows).select(*key, "block", "from", "to").join(drawn.hint("merge"), ["number", "block"])
    words = F.greatest(F.least("to", "take") - F.col("from"), F.lit(0))
    summed = taken.groupBy("number", "start", "size", "text_hash").agg(F.sum(words).alias("taken"))
    wordy = rows.where("size > 0").join(summed, ["number", "start", "size", "text_hash"], "left")
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return wordy.select(*columns).unionByName(empty.select(*columns))


def mixed_text(docs: DataFrame, **options: int) -> DataFrame:
    """The mix as text: shard, slot order, source, doc_id, first_word, words and the words."""
    taken = mixed(docs, **options).select(
        "shard", "slot", "source", "block", "from", "first_word", "words", "doc_id", "text_hash"
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    parts = taken.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("shard", "slot", "source", "block", "from", "first_word", "words")).alias("parts")
    )
    held = joined(parts, texts, ["doc_id", "text_hash"]).withColumn("w", space_words(F.col("text")))
    cut = bind(
        F.col("w"),
        lambda w: F.transform(
            "parts",
            lambda p: F.struct(
                p["shard"].alias("shard"),
                p["slot"].alias("slot"),
                p["source"].alias("source"),
                p["block"].alias("block"),
                p["from"].alias("from"),
                p["first_word"].alias("first_word"),
                p["words"].alias("words"),
                F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text"),
            ),
        ),
    )
    return held.select("doc_id", F.explode(cut).alias("p")).select("p.*", "doc_id")
