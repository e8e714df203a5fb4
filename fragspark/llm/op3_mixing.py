"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in a shuffled (hash) order and cut into
blocks of ``block`` words, the last one shorter. Slot k of the mix belongs to the
source in whose part of the cumulative target shares the golden-ratio point
frac((k + 1/2) * phi) falls. The slots of a source are ranked, and slot r plays the
source's block r modulo its number of blocks. A source stops at its target: its last
slot is cut short, and what the sequence still owes it is played at the end. So every source is spread evenly over the mix, and its
blocks differ by at most one in how often they are played.

Everything is DataFrame functions. Orders within a source are prefix sums over
(source, bucket of the hash) first and inside each bucket then, so a source with a
third of all rows is spread over as many tasks as it has buckets. Slots are ranked
the same way, by source and chunk of slot numbers.

Null source: a source of its own, last. Null or empty text: size 0, taken 0. Repeated
rows are separate documents. An empty input or one without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragspark.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
SLOT_CHUNK = 1 << 12
GRID = 4096
#: Up to so many sources, of some 100 bytes each, their table is broadcast.
FEW = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_key(id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> Column:
    """The place of a row in its source's shuffled order."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source_size, target): shares by weight, level with what is left where a source would exceed ``most`` times its size.

    A source is full at the level most * size / weight. In order of those levels, the first n sources are full if the
    rest, sharing what the full ones leave, would still lift the n-th above its own.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("full", F.col("source_size") * most).withColumn("level", F.col("full") / F.col("weight"))
    order = Window.orderBy("level", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    t = (
        t.withColumn("before_full", F.coalesce(F.sum("full").over(order), F.lit(0.0)))
        .withColumn("before_weight", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("total", F.sum("source_size").over(every) * share)
    )
    # were this source and all later ones to share the rest, this is the level that they would reach
    reach = (F.col("total") - F.col("before_full")) / (F.col("all_weight") - F.col("before_weight"))
    t = t.withColumn("reach", reach).withColumn("is_full", F.col("level") <= F.col("reach"))
    final = F.min(F.when(~F.col("is_full"), F.struct("level", "reach"))).over(every)["reach"]
    return t.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * final)).select("src", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 1024,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_key: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken[, row_key]) for every row; ``taken`` counts words with their repeats.

    ``row_key`` is what ``row_key`` below makes of a row; rows with equal ids and texts share it.
    """
    cols = [
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("src"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
        row_key(id_col, text_col, seed).alias("at"),
    ]
    key = F.coalesce(F.concat(F.lit("="), F.col("src")), F.lit("null")).alias("key")
    rows = stored(docs.select(*cols).select("*", key, F.shiftrightunsigned("at", 54).alias("bucket")), "mix")
    parts = rows.groupBy("key", "src", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = targets(parts.groupBy("src").agg(F.sum("n").alias("source_size")), weights, share, most)
    plan = stored(plan.select("*", key, F.floor("target").alias("goal"), F.expr(f"cast(ceil(source_size / {block}D) as bigint)").alias("blocks")), "mix-plan")
    small = (lambda frame: F.broadcast(frame)) if plan.limit(FEW + 1).count() <= FEW else (lambda frame: frame)

    inside = Window.partitionBy("key", "bucket").orderBy("at", "doc_id")
    laid = (
        rows.join(bases, ["key", "bucket"])
        .withColumn("nth", F.row_number().over(inside))
        .withColumn("begin", F.col("base") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    pieces = laid.where("size > 0").select(
        "key", "bucket", "nth", "begin", "size", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("block")
    )
    played = slots(plan, block, small).groupBy("key", "block").agg(F.count_if(F.col("words") == F.col("whole")).alias("plays"), F.sum(F.when(F.col("words") < F.col("whole"), F.col("words")).otherwise(0)).alias("cut"))
    low = F.greatest("begin", F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    cut_at = F.col("block") * block + F.col("cut")
    words = (high - low) * F.col("plays") + F.greatest(F.least(high, cut_at) - low, F.lit(0))
    taken = pieces.join(played, ["key", "block"]).groupBy("key", "bucket", "nth").agg(F.sum(words).alias("taken"))
    out = laid.join(taken, ["key", "bucket", "nth"], "left").join(small(plan.select("key", "source_size", "target")), "key")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), *([F.col("at").alias("row_key")] if with_key else []))


def slots(plan: DataFrame, block: int, small) -> DataFrame:
    """(key, block, words, whole): every slot of the mix, with the block that it plays, the words taken of it and the block's words.

    The sequence runs for as many slots as the targets have blocks. A golden-ratio sequence is off by a few slots in any
    interval, so ranks past a source's goal are left out, and the few that are missing are played at the end.
    """
    spark = plan.sparkSession
    wanted = F.expr(f"(goal div source_size) * blocks + cast(ceil((goal % source_size) / {block}D) as bigint)")
    order = Window.orderBy(F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy(F.lit(1)))
    edges = plan.where("goal > 0").select("key", "src", "goal", "source_size", "blocks", "target", wanted.alias("wanted"), (F.sum("target").over(order) / total).alias("high"), total.alias("total"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy(F.col("src").asc_nulls_last())), F.lit(0.0)))
    length = int(plan.where("goal > 0").agg(F.sum(wanted)).first()[0] or 0)
    x = F.expr(f"(id + 0.5D) * {PHI!r}D")
    points = spark.range(length).select("id", (x - F.floor(x)).alias("x")).withColumn("cell", F.floor(F.col("x") * GRID))
    cells = edges.select("key", "low", "high", F.explode(F.expr(f"sequence(cast(floor(low * {GRID}) as bigint), cast(least(floor(high * {GRID}), {GRID} - 1) as bigint))")).alias("cell"))
    hits = points.join(small(cells), "cell").where("x >= low and x < high").select("key", "id", F.expr(f"id div {SLOT_CHUNK}").alias("chunk"))
    counts = hits.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("key", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    rank = F.col("first") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id")) - 1
    ranked = hits.join(firsts, ["key", "chunk"]).select("key", rank.alias("rank"))
    there = counts.groupBy("key").agg(F.sum("n").alias("there"))
    late = edges.join(there, "key", "left").withColumn("there", F.coalesce("there", F.lit(0))).where("there < wanted")
    late = late.select("key", F.explode(F.expr("sequence(there, wanted - 1)")).alias("rank"))
    every = ranked.unionByName(late).join(small(edges.select("key", "goal", "source_size", "blocks", "wanted")), "key").where("rank < wanted")
    every = every.select("key", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("turn"), "goal", "source_size")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("goal") - F.col("turn") * F.col("source_size") - F.col("block") * block
    return every.select("key", "block", F.least(whole, left).alias("words"), whole.alias("whole"))
