"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 9), DataFrame functions only.

1. Sizes in words; each source's target is its weighted share of the mix, stopped at ``max_repeats`` times
   its size, the excess reshared by weight (water filling: one pass over the sources in the order of
   size / weight gives the same as repeating the resharing until none is above).
2. The mix is cut into blocks of ``block_words`` words.  Blocks go to sources by the highest quotients
   target / (2s + 1), and each source's blocks to its shards by the same rule on the shards' sizes.
   A seat far below the divisor is certain, so only the seats near it are listed and ranked.
3. In a shard, documents stand in seeded order; a quota of blocks is taken from a seeded block on, round
   and round.  A shard holds a bounded number of documents, so a hot source has many shards.

Only ids, sources and sizes are shuffled, never texts.  Words are taken once or twice, by position, so no
document gives more than ``max_repeats`` times its words.

Defined results: a null or empty text has size 0 and gives 0; the null source is a source of its own, last;
an empty table gives no rows; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (3.0, 1.0, 2.0)
#: Sources up to this number are broadcast (some 60 bytes each).
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(source: Column) -> Column:
    """A key without nulls that sorts as sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, share: float, max_repeats: int, weights: tuple[float, ...]) -> DataFrame:
    """(key, source_size, target) for each source; ``sizes`` has key and source_size, a row a source."""
    everything = Window.partitionBy(F.lit(1))
    by_code = everything.orderBy("key")
    by_ratio = everything.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    listed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    listed = listed.withColumn("mix", F.sum("source_size").over(everything) * share)
    # The level at which this source would stand if all sources of a smaller ratio were full.
    listed = listed.withColumn("level", (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    listed = listed.withColumn("full", F.col("ratio") <= F.col("level"))
    listed = listed.withColumn("free", F.min(F.when(~F.col("full"), F.struct("ratio", "key", "level"))).over(everything)["level"])
    return listed.select("key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target"))


def apportion(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """Sainte-Laguë: ``votes`` plus a column quota; the quotas of a group add up to its ``seats``.

    With divisor d = votes / seats rounding gives at most half a seat a key too many or too few, so true
    quotas are within a margin of the rounded ones; lower seats are certain and only those within the
    margin are ranked by quotient (ties: the smaller key).
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    v = votes.withColumn("_votes", F.sum(vote).over(whole)).withColumn("_keys", F.count(F.lit(1)).over(whole))
    v = v.withColumn("_fair", F.when(F.col("_votes") > 0, F.col(vote) / F.col("_votes") * F.col(seats)).otherwise(F.lit(0.0)))
    v = v.withColumn("_margin", F.when(F.col("_votes") > 0, F.ceil(F.col("_keys") * F.col(vote) / F.col("_votes"))).otherwise(F.lit(0)) + 2)
    v = v.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_fair")) - F.col("_margin")).cast("long"))
    v = v.withColumn("_high", (F.floor(F.col("_fair")) + F.col("_margin")).cast("long"))
    listed = v.where(F.col(vote) > 0).withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_high"))))
    listed = listed.withColumn("_quotient", F.col(vote) / (2 * F.col("_seat") - 1))
    order = whole.orderBy(F.col("_quotient").desc(), *key, "_seat")
    # Certain seats are counted once a key, at its lowest listed seat.
    listed = listed.withColumn("_left", F.col(seats) - F.sum(F.when(F.col("_seat") == F.col("_sure") + 1, F.col("_sure"))).over(whole))
    won = listed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_left"))
    gained = won.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    extra = [c for c in v.columns if c.startswith("_") and c != "_sure"]
    joined = v.drop(*extra).join(gained, [*group, *key], "left")
    return joined.withColumn("quota", F.when(F.col(vote) > 0, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("_sure", "_won")


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    max_repeats: int = 2,
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = 16,
    shard_docs: int = 20_000,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_word, shard_words: how many words of each row the mix takes.

    ``taken`` words of a row are ``taken div size`` whole rounds and a rest that starts at word ``first_word``
    (counted within the row, round its end).
    """
    def rows(columns: tuple[str, ...]) -> DataFrame:
        doc_id = F.col("doc_id").cast("long")
        seeded = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
        return docs.select(doc_id.alias("doc_id"), key_of(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), seeded.alias("_h"), *columns)

    own = stored(rows(()))
    sizes = own.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = source_targets(sizes, share, max_repeats, weights).join(sizes.select("key", "source_docs"), "key")
    blocks = F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(1))) * share / block_words).cast("long")
    quotas = apportion(targets.withColumn("blocks", blocks), [], ["key"], "target", "blocks").withColumnRenamed("quota", "source_blocks")
    quotas = stored(quotas.withColumn("shards", F.ceil(F.col("source_docs") / shard_docs).cast("long")).drop("blocks", "source_docs"))
    if quotas.count() <= BROADCAST_SOURCES:  # beyond it a plain join, which Spark may split where a source is hot
        quotas = F.broadcast(quotas)

    number = lambda text: F.conv(F.substring(text, 1, 12), 16, 10).cast("long")
    sharded = lambda df: df.join(quotas.select("key", "shards"), "key").withColumn("shard", F.pmod(number(F.col("_h")), F.col("shards"))).drop("shards")
    in_shard = Window.partitionBy("key", "shard")
    in_order = in_shard.orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded(rows(keep) if keep else own)
    placed = placed.withColumn("_end", F.sum("size").over(in_order)).withColumn("shard_words", F.sum("size").over(in_shard))

    shards = sharded(own).groupBy("key", "shard").agg(F.sum("size").alias("words")).join(quotas.select("key", "source_blocks"), "key")
    shards = apportion(shards, ["key"], ["shard"], "words", "source_blocks")
    # The words of a quota, never more than the shard has; a seeded block to begin with.
    shards = shards.withColumn("take", F.least(F.col("quota") * block_words, F.col("words") * max_repeats))
    first = number(F.md5(F.concat(F.lit(seed), F.col("key"), F.lit("/"), F.col("shard").cast("string"))))
    shards = shards.withColumn("start", F.when(F.col("words") > 0, F.pmod(first, F.ceil(F.col("words") / block_words).cast("long")) * block_words).otherwise(F.lit(0)).cast("long"))

    out = placed.join(shards.select("key", "shard", "take", "start"), ["key", "shard"]).join(quotas.select("key", "source_size", "target"), "key")
    words = F.greatest(F.col("shard_words"), F.lit(1))
    rounds = F.floor(F.col("take") / words).cast("long")
    rest = F.col("take") - rounds * words
    begin, stop = F.col("_end") - F.col("size"), F.col("_end")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(stop, b) - F.greatest(begin, a))
    # The rest runs from start to start + rest, round the end of the shard.
    straight = overlap(F.col("start"), F.least(F.col("start") + rest, words))
    around = overlap(F.lit(0), F.col("start") + rest - words)
    from_start = (begin < F.col("start")) & (straight > 0)
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (rounds * F.col("size") + straight + around).cast("long").alias("taken"),
        F.when(from_start, F.col("start") - begin).otherwise(F.lit(0)).cast("long").alias("first_word"),
        *keep,
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` once for each whole round taken, and the taken run of words of the rest.

    A row of which nothing is taken goes.  Where the mix takes only a part of a row, its text is the words of
    that part with one blank between (n_chars is counted anew), from ``first_word`` on, round its end.
    """
    columns = docs.columns
    carried = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns]))
    taken = mix_sources(carried, keep=("_row",), **options)
    taken = taken.where(F.col("taken") > 0).withColumn("_n", F.floor(F.col("taken") / F.col("size")).cast("long"))
    taken = taken.withColumn("_part", F.col("taken") - F.col("_n") * F.col("size"))
    copies = taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n") + F.when(F.col("_part") > 0, 1).otherwise(0))))
    partial = F.col("_k") > F.col("_n")
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    turned = F.concat(F.slice(words, F.col("first_word").cast("int") + 1, F.col("size").cast("int")), F.slice(words, 1, F.greatest(F.col("first_word"), F.lit(0)).cast("int")))
    part = F.array_join(F.slice(turned, 1, F.col("_part").cast("int")), " ")
    text = F.when(partial, part).otherwise(F.col("_row.text"))
    replaced = {"text": text, "n_chars": F.when(partial, F.length(part).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))} if "n_chars" in columns else {"text": text}
    return copies.select(*[replaced.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
