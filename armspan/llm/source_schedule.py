"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armspan.llm.common import WORD, nested, numbered, running_before, stored, unnested

# Rows of a source that are numbered in one task, and slots likewise.
_CHUNK_ROWS = 4_000
_GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sources: DataFrame, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2
) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size).

    Sources in code point order, null last, have the weights in turn. Together they are to
    give ``share`` of all sizes. A target over ``most`` times its source's size stops there and
    the rest is shared again by weight, until none is above. Each round is one aggregate, and
    the driver holds its two sums.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = numbered(sources, order, None, "sources", "place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(placed.withColumn("weight", turn), "weights")
    wanted = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * most
    level, stopped, n_stopped = Fraction(0), F.lit(False), -1
    while True:
        found = weighed.agg(
            F.sum(F.when(stopped, limit).otherwise(0)).alias("given"),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(stopped).alias("n"),
        ).first()
        if found["n"] == n_stopped or not found["open"]:
            break
        n_stopped = found["n"]
        level = (wanted - found["given"]) / Fraction(found["open"])
        # weight * level > limit, in whole numbers.
        stopped = F.col("weight").cast("decimal(38,0)") * F.lit(level.numerator).cast("decimal(28,0)") > (
            limit.cast("decimal(28,0)") * F.lit(level.denominator).cast("decimal(10,0)")
        )
    # One division from whole numbers, so that the target is the nearest double.
    shared = F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return weighed.select("source", "source_size", F.when(stopped, limit.cast("double")).otherwise(shared).alias("target"))


def mix(
    df: DataFrame,
    block: int = 4096,
    share: Fraction = Fraction(3, 2),
    weights: tuple[int, ...] = (3, 1, 2),
    most: int = 2,
    seed: int = 17,
    carry: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces of documents, and the rows of ``df`` that they refer to.

    The rows come back stored, as struct ``row`` (the columns named in ``carry``, by default
    all) with ``t`` (a row number), source, size, source_size and target. A piece has slot (its place in the mix), source, epoch (0 or 1), t,
    first (word of the document it starts at) and words.

    A source's documents are shuffled by a hash of id and text and read end to end, again from
    the front when they run out; that stream is cut into blocks of ``block`` words, the last one
    shorter, until the target's whole words are taken. A source with n of all N blocks owns n
    of the N slots: slot i is the golden-ratio point frac(i * m / N), m / N near the golden
    section and m prime to N, looked up in the cumulative block counts. These N points are all
    multiples of 1 / N, so every source gets exactly n slots, evenly spread; its blocks fill
    them in order of rank.

    Sizes are words; null and empty texts have none and no pieces. The null source is a source.
    Equal rows are shuffled side by side, and which copy is taken is then arbitrary. Sums run
    over chunks of a source first, so a source with a third of all rows is spread over tasks.
    """
    rows, col = nested(df)
    text = col("text")
    row = "row" if carry is None else F.struct(*[col(name).alias(f"c{i}") for i, name in enumerate(carry)]).alias("row")
    base = rows.select(
        row,
        F.monotonically_increasing_id().alias("t"),
        col("source").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(col("doc_id"), text, F.lit(seed)).alias("h"),
    )
    base = stored(base, "mix-input")
    narrow = base.select("t", "source", "size", "h")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = stored(sizes, "source-sizes")
    aims = targets(sizes.select("source", "source_size"), share, weights, most)
    blocks = F.ceil(F.floor("target") / F.lit(float(block))).cast("bigint")
    order = [F.col("source").isNull(), F.col("source")]
    aims = stored(numbered(aims.withColumn("blocks", blocks), order, None, "aims", "source_no"), "aims")
    total_blocks, n_sources = aims.agg(F.sum("blocks"), F.count("*")).first()
    same = narrow["source"].eqNullSafe(aims["source"])
    known = aims.select("source", "source_no", "source_size", "target", "blocks")
    rowed = narrow.join(known, same).drop(aims["source"]).where("size > 0 and blocks > 0")

    # Place of each document in its source's stream.
    most_rows = sizes.agg(F.max("n")).first()[0] or 1
    chunks = max(1, -(-most_rows // _CHUNK_ROWS))
    chunked = rowed.withColumn("chunk", F.pmod("h", F.lit(chunks)))
    streamed = running_before(chunked, ["source_no"], "chunk", ["h", "t"], "size", "at")
    again = streamed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    from_word = F.col("epoch") * F.col("source_size") + F.col("at")
    ranged = again.withColumn("a", from_word).withColumn(
        "b", F.least(from_word + F.col("size"), F.floor("target").cast("bigint"))
    )
    cut = ranged.where("a < b").withColumn(
        "rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}")))
    )
    begin = F.greatest("a", F.col("rank") * block)
    pieces = cut.select(
        "source_no", "rank", "epoch", "t", (begin - F.col("a")).alias("first"),
        (F.least("b", (F.col("rank") + 1) * block) - begin).alias("words"),
    )
    slots = _schedule(aims, total_blocks or 0, n_sources)
    mixed = pieces.join(slots, ["source_no", "rank"]).join(known.select("source_no", "source"), "source_no")
    mixed = mixed.select("slot", "source", "epoch", "t", "first", "words")
    whole = base.join(known.select("source", "source_size", "target"), base["source"].eqNullSafe(known["source"]))
    whole = whole.select("row", "t", base["source"], "size", "source_size", "target")
    return mixed, whole


def _schedule(aims: DataFrame, n: int, n_sources: int) -> DataFrame:
    """slot, source_no and rank (of the slot among those of its source)."""
    spark = aims.sparkSession
    if not n:
        return spark.createDataFrame([], "slot bigint, source_no bigint, rank bigint")
    step = max(1, round(n * _GOLDEN))
    while math.gcd(step, n) > 1:
        step += 1
    grid = (F.col("slot").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)") % n).cast("bigint")
    slots = spark.range(n).select(F.col("id").alias("slot"), grid.alias("g"))
    # Sources' ranges on the grid, looked up through bins: at most two more than sources and bins.
    width = max(1, n // (4 * n_sources))
    chunk = F.shiftright("source_no", 12)
    ranges = running_before(aims.withColumn("one", F.lit(1)).withColumn("c", chunk), ["one"], "c", ["source_no"], "blocks", "lo")
    ranges = ranges.where("blocks > 0").withColumn("hi", F.col("lo") + F.col("blocks"))
    bins = ranges.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    bins = bins.select("bin", "lo", "hi", "source_no")
    found = slots.withColumn("bin", F.expr(f"g div {width}")).join(bins, "bin").where("g >= lo and g < hi")
    counted = found.select("slot", "source_no", F.expr(f"slot div {_CHUNK_ROWS}").alias("c"), F.lit(1).alias("one"))
    return running_before(counted, ["source_no"], "c", ["slot"], "one", "rank").select("slot", "source_no", "rank")


def mixed_sizes(df: DataFrame, block: int = 4096) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken and slot.

    ``taken`` is the number of the document's words in the mix, repeats counted; ``slot`` the place in
    the mix where its first words come, null if none do. Null ids and repeated rows keep their rows;
    extra columns are ignored; an empty table gives no rows.
    """
    pieces, rows = mix(df, block, carry=["doc_id"])
    taken = pieces.groupBy("t").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    joined = rows.join(taken, "t", "left")
    return joined.select(
        F.col("row.c0").alias("doc_id"), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"), "slot",
    )


def mixed_rows(df: DataFrame, block: int = 4096) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, in the order of the mix: once per epoch that takes
    over half of the document's words, and once if no epoch does but some words are taken.

    A row comes at the slot of its first words in the epoch; rows of one slot, in the order of their
    stream. Rows without words (null and empty texts too) stay once, at the end. No document that is wanted is
    lost, and columns and values are unchanged, whatever they are called. Null ids and repeated rows are rows
    as any; an empty table gives no rows.
    """
    pieces, rows = mix(df, block)
    by_epoch = pieces.groupBy("t", "epoch").agg(F.sum("words").alias("w"), F.min(F.struct("slot", "first")).alias("at"))
    wide = by_epoch.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("takes"))
    joined = rows.join(wide, "t", "left")
    most = F.filter("takes", lambda take: take["w"] * 2 > F.col("size"))
    some = F.when(F.size(most) > 0, most).otherwise(F.slice("takes", 1, 1))
    places = F.transform(some, lambda take: take["at"]["slot"])
    none = F.array(F.lit(None).cast("bigint"))
    wanted = F.when(F.col("size") == 0, none).otherwise(F.coalesce(places, F.array().cast("array<bigint>")))
    out = joined.select("row", "t", F.explode(wanted).alias("slot"))
    return unnested(out.orderBy(F.col("slot").asc_nulls_last(), "t").select("row"), df.columns)
