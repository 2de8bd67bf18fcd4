"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in shuffled order,
divided by the source's target. The documents of all sources, repeated up to `MAX_EPOCHS` times, are put in order
of that time and the mix is what comes before the total budget is used up: the first one that would cross it ends the mix, so as much of the
budget may stay unused as that document is long. A hot source is no single task: its order is cut into buckets by the leading digits of the shuffle key,
and prefix sums run over buckets first. Buckets and slots of time grow in number with the documents. Only the table of sources is ordered in one task.

Null texts have size 0. A document of size 0 takes nothing. Rows that are equal in id, source and text are one
unit that is taken or left as a whole; a null source is a source of its own and comes last. Empty input gives empty output. Other columns
play no part and are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import table, words

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Documents that one shuffle bucket or time slot is meant to have: they bound what one window task sorts.
TOGETHER = 20_000
#: Least number of hexadecimal digits of the key that name a bucket, and of slots; slots up to which their table is broadcast.
KEY_DIGITS, SLOTS, BROADCAST_SLOTS = 3, 4096, 1_000_000


def shuffle_key(doc_id: Column, text_hash: Column, seed: str) -> Column:
    """Pseudo-random but the same in every run, and on any engine with MD5."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.md5(text).alias("text_hash"), words(text).alias("size"))


def source_targets(units: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating. The budget is all tokens; a target is at most
    MAX_EPOCHS times its source, and what that leaves over goes to the others by weight. With the sources in order of
    cap over weight, the first k are capped, where k is the first number for which the next one's share is below its cap.
    """
    per = units.groupBy("source").agg(F.sum("total").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    ratio = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    level = per.withColumn("level", left / F.sum("weight").over(after))
    # the level is the first at which the source itself isn't capped
    free = level.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return free.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def plan(units: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, text_hash, source_size, target, copies) of every unit of `units` (doc_id, source, text_hash, size, rows, total)."""
    n = units.count()
    digits, slots_ = KEY_DIGITS, max(SLOTS, n // TOGETHER)
    while n // 16**digits > TOGETHER:
        digits += 1
    targets = source_targets(units)
    keyed = units.withColumn("key", shuffle_key(F.col("doc_id"), F.col("text_hash"), seed)).withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("total").alias("bucket_total"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_total").over(ahead), F.lit(0)).alias("ahead"))
    sums = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "ahead", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.withColumn("within", F.sum("total").over(within))
    run = run.alias("u").join(sums.alias("b"), F.col("u.source").eqNullSafe(F.col("b.source")) & (F.col("u.bucket") == F.col("b.bucket")))
    run = run.select("u.doc_id", "u.source", "u.text_hash", "u.key", "u.total", "source_size", "target", (F.col("ahead") + F.col("within")).alias("upto"))
    epochs = run.select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch"))
    epochs = epochs.withColumn("finish", F.when(F.col("target") > 0, (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("target")))
    epochs = epochs.where(F.col("finish") < MAX_EPOCHS + 1).withColumn("slot", F.floor(F.col("finish") * slots_))
    epochs = table(epochs, "finish_times")
    # the order of finish times is cut into ranges (slots); the sums of the slots before a row's own are known from few rows
    slots = epochs.groupBy("slot").agg(F.sum("total").alias("slot_total"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", F.coalesce(F.sum("slot_total").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("slot").orderBy("finish", "key", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = units.agg(F.sum("total")).first()[0] or 0
    queued = epochs.withColumn("inside", F.sum("total").over(inside))
    queued = queued.join(F.broadcast(slots) if (MAX_EPOCHS + 1) * slots_ <= BROADCAST_SLOTS else slots, "slot")
    taken = queued.where(F.col("earlier") + F.col("inside") <= budget)
    copies = taken.groupBy("doc_id", "source", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.text_hash") == F.col("c.text_hash"))
    return run.alias("r").join(copies.alias("c"), same, "left").select("r.doc_id", "r.source", "r.text_hash", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))


def _units(sized: DataFrame) -> DataFrame:
    return sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.sum("size").alias("total"))


def _with_plan(sized: DataFrame, seed: str) -> DataFrame:
    planned = plan(table(_units(sized), "units"), seed)
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    return sized.alias("d").join(planned.alias("p"), same)


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, taken."""
    sized = table(sizes(docs), "sizes")
    return _with_plan(sized, seed).select("d.doc_id", F.col("d.size"), "source_size", "target", (F.col("d.size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all their columns."""
    planned = plan(table(_units(table(sizes(docs), "sizes")), "units"), seed).where("copies > 0")
    text_hash = F.md5(F.coalesce(F.col("d.text"), F.lit("")))
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (text_hash == F.col("p.text_hash"))
    joined = docs.alias("d").join(planned.alias("p"), same).select("d.*", F.explode(F.sequence(F.lit(1), F.col("p.copies").cast("int"))).alias("__copy"))
    return joined.drop("__copy")
