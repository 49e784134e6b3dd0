"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame expressions only.

Sources share the mix by weight, none above ``max_epochs`` times its own words. Targets become whole numbers of
equal-token blocks by the highest quotients target / (2k + 1); each source's blocks are apportioned to its shards the
same way. A shard lays its documents end to end in a seeded order, cuts that line into equal blocks and takes its
quota: whole passes first, the rest evenly spaced from a seeded phase. What a document gives is the overlap of its
interval with the taken blocks, so nothing is enumerated block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import plain_names, staged

#: Word pattern that measures sizes (fixed).
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 32
SHARD_ROWS = 2000
#: Equal rows that one task takes apart at once.
ENTRY_ROWS = 10_000
#: Ranges into which a group falls before its ranks are counted.
BUCKETS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size: words of the text)."""
    return docs.select("doc_id", "source", _words().alias("size"))


def _words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _seeded(seed: int, *more: Column) -> Column:
    """16 hexadecimal digits of a seeded hash of the doc_id; the same text orders documents in any engine."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *more).cast("binary")), 1, 16)


def targets(sized: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, docs, source_size, weight, target.

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget`` times all words. A target stops
    at ``max_epochs`` times its source's words; what is cut off is shared again by weight until nothing is above.
    The windows here run over one row per source.
    """
    known = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = known.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("k", F.lit(len(weights))).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything = W.partitionBy()
    # sources fill up in the order of words per weight; the first whose fair share stays below its cap sets the level
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("k"))
    level = (
        (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum(cap).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    )
    levelled = weighed.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    settled = levelled.withColumn("level", F.max(free).over(everything))
    # every source fits under one level or all are capped
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return settled.select("source", "k", "docs", "source_size", "weight", target.alias("target"))


def ranked_below(rows: DataFrame, group: list[str], value: Column, order: list[Column], limit: str) -> DataFrame:
    """The rows of each group that come first in ``order``, as many as the group's column ``limit`` says.

    ``value`` is the double that leads the order, falling. Groups fall into ``BUCKETS`` equal ranges of it, and only the
    range in which the limit is reached is ranked, so a group of any size is never sorted in one task.
    """
    saved = staged(rows.withColumn("_v", value), "ranked")
    bounds = saved.groupBy(*group).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    wide = F.col("_most") - F.col("_least")
    bucket = F.when(wide > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("_most") - F.col("_v")) / wide * BUCKETS))).otherwise(F.lit(0)).cast("int")
    placed = saved.join(bounds, group).withColumn("_bucket", bucket).drop("_least", "_most")
    counts = placed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_to", F.col("_before") + F.col("_n")).drop("_n")
    limited = placed.join(counts, [*group, "_bucket"]).filter(F.col("_before") < F.col(limit))
    inside = limited.filter(F.col("_to") <= F.col(limit))
    rank = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order))
    last = limited.filter(F.col("_to") > F.col(limit)).withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= F.col(limit)).drop("_rank")
    return inside.unionByName(last).drop("_v", "_bucket", "_before", "_to")


def apportioned(rows: DataFrame, group: str, key: str, share: str, seats: str, cap: str) -> DataFrame:
    """``rows`` plus quota: Sainte-Laguë seats of each row of a group, in proportion to ``share``, none above ``cap``.

    Seats that any divisor near the ideal one grants are given at once; only the few quotients around each row's
    fair share compete, so work grows with rows and not with seats. Ties fall by ``key``. Groups and keys are not null;
    sums of a group are aggregated, and no window spans a group.
    """
    saved = staged(rows, "shares")
    sums = saved.groupBy(group).agg(F.count("*").alias("_count"), F.sum(share).alias("_total"))
    total = F.col("_total")
    fair = F.when(total > 0, F.col(share) * F.col(seats) / total).otherwise(0.0)
    slack = F.when(total > 0, F.col(share) / total * F.col("_count") / 2 + 1).otherwise(0.0)
    ready = staged(saved.join(sums, group).withColumns({
        "_low": F.greatest(F.lit(0), F.least(F.col(cap), F.floor(fair - slack))).cast("long"), "_high": F.least(F.col(cap), F.ceil(fair + slack)).cast("long"),
    }).drop("_count", "_total"), "ready")
    open_seats = ready.groupBy(group).agg((F.max(seats) - F.sum("_low")).alias("_open"))
    bids = ready.filter((F.col("_high") > F.col("_low")) & (F.col(share) > 0)).select(
        group, key, (F.col(share).cast("double")).alias("_share"), F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k")
    )
    quotient = F.col("_share") / (2 * F.col("_k") + 1)
    won = ranked_below(bids.join(open_seats, group), [group], quotient, [quotient.desc(), F.col(key), F.col("_k")], "_open")
    more = won.groupBy(group, key).agg(F.count("*").alias("_more"))
    return ready.join(more, [group, key], "left").select(*rows.columns, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("quota"))


def taken_words(
    sized: DataFrame, seed: int = 42, budget: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for every row of ``sized`` (doc_id, source, size).

    ``taken`` counts the words the mix takes from the document, repeats included, at most ``max_epochs`` times its
    size; ``copies`` is the number of times the middle of the document is taken, for mixes of whole documents. Rows
    that repeat a doc_id are documents of their own; null sources form one source; empty documents give nothing; an
    empty table gives no rows. Equal rows are laid out as one entry, so a doc_id that many rows share is no large group.
    """
    sources = staged(targets(sized, budget, max_epochs, weights).withColumns({
        "seats": F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long"), "g": F.lit(0),
        "cap": F.ceil(F.col("source_size") * max_epochs / block_words).cast("long"), "shards": F.ceil(F.col("docs") / shard_rows).cast("int"),
    }), "sources")
    quotas = apportioned(sources, "g", "k", "target", "seats", "cap")
    quotas = staged(quotas.select("source", "k", "source_size", "target", "shards", F.col("quota").alias("source_quota")), "quotas")
    by_source = F.col("d.source").eqNullSafe(F.col("q.source"))
    entries = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    # the source table has one row per source; Spark broadcasts it while it is small and sorts it otherwise
    dealt = entries.alias("d").join(quotas.alias("q"), by_source).select(
        "doc_id", "d.source", "size", "rows", "k", "source_size", "target", "source_quota",
        _seeded(seed, F.col("doc_id").cast("string")).alias("draw"), "shards",
    )
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards")).cast("int"))
    shards = dealt.groupBy("k", "shard", "source_quota").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    blocks = F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")
    shards = shards.withColumns({"blocks": blocks, "cap": F.when(F.col("words") > 0, blocks * max_epochs).otherwise(F.lit(0).cast("long"))})
    given = apportioned(shards, "k", "shard", "words", "source_quota", "cap").select("k", "shard", "words", "blocks", "quota")
    line = W.partitionBy("k", "shard").orderBy(F.col("draw"), F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = dealt.join(given, ["k", "shard"]).withColumn("_end", F.sum(F.col("size") * F.col("rows")).over(line))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i")
    laid = _spread(laid).select("*", each).withColumn("end", F.col("_end") - (F.col("rows") - F.col("i")) * F.col("size"))
    rest, passes = F.pmod("quota", "blocks"), F.floor(F.col("quota") / F.col("blocks"))
    phase = F.pmod(F.conv(F.substring(_seeded(seed, F.lit("phase"), F.col("k").cast("string"), F.col("shard").cast("string")), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    ready = laid.withColumns({"rest": rest, "passes": passes, "phase": phase, "begin": F.col("end") - F.col("size")})

    def picked(b: Column) -> Column:
        """Taken blocks among the first ``b`` of a shard, of the last, partial pass."""
        return F.floor((b * F.col("rest") + F.col("phase")) / F.col("blocks"))

    def covered(x: Column) -> Column:
        """Words before position ``x`` of the shard's line that the partial pass takes, rounded."""
        b = F.least(F.floor(x * F.col("blocks") / F.greatest("words", F.lit(1))), F.col("blocks") - 1)
        inside = x * F.col("blocks") - b * F.col("words")
        scaled = picked(b) * F.col("words") + (picked(b + 1) - picked(b)) * inside
        return F.floor((2 * scaled + F.col("blocks")) / (2 * F.col("blocks")))

    middle = F.least(F.floor((F.col("begin") + F.col("end")) * F.col("blocks") / (2 * F.greatest("words", F.lit(1)))), F.col("blocks") - 1)
    taken = F.col("passes") * F.col("size") + covered(F.col("end")) - covered(F.col("begin"))
    copies = F.col("passes") + picked(middle + 1) - picked(middle)
    return ready.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int").alias("copies"),
    )


def _spread(entries: DataFrame) -> DataFrame:
    """``entries`` with those of more than ENTRY_ROWS rows cut into several (rows, _end), dealt to tasks of their own."""
    saved = staged(entries, "entries")
    large = saved.filter(F.col("rows") > ENTRY_ROWS)
    if large.isEmpty():
        return saved
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(ENTRY_ROWS).cast("long"))).alias("_first")
    parts = large.select("*", first).withColumn("_n", F.least(F.lit(ENTRY_ROWS).cast("long"), F.col("rows") - F.col("_first")))
    parts = parts.withColumns({"_end": F.col("_end") - (F.col("rows") - F.col("_first") - F.col("_n")) * F.col("size"), "rows": F.col("_n")})
    parts = parts.repartition("doc_id", "_first").drop("_first", "_n")
    return saved.filter(F.col("rows") <= ENTRY_ROWS).unionByName(parts)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``taken_words`` of the texts of ``docs`` (doc_id, source, text); sizes are measured once."""
    return taken_words(staged(sizes(docs), "sizes"), **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...) as often as the mix takes them whole, all columns kept.

    Each row has its own number of copies; rows of equal doc_id, source and size share theirs evenly, and what is left
    over goes to the first of them in the order of a hash of all columns, so that reruns agree. Names of other columns
    may clash with anything; an empty table gives no rows.
    """
    key = ["doc_id", "source", "size"]
    named = plain_names(docs, "doc_id", "source", "text").withColumn("size", _words())
    counted = mix(named.drop("size"), **options).groupBy(*key).agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).filter("total > 0")
    counted = staged(counted.select(*key, F.floor(F.col("total") / F.col("rows")).alias("base"), F.pmod("total", "rows").alias("more")), "counted")
    own_columns = [c for c in named.columns if c != "size"]
    columns = [F.col(c).cast("string") for c in own_columns]
    hashed = named.withColumns({"h1": F.xxhash64(*columns), "h2": F.xxhash64(F.lit(3), *columns)})
    cuts = staged(_cuts(hashed.select(*key, "h1", "h2"), counted.filter("more > 0"), key), "cuts")
    decided = counted.alias("c").join(cuts.alias("t"), _same(key, "c", "t"), "left").select("c.*", "t.c1", "t.c2", "t.extra")
    # the decisions grow with the documents: both sides are sorted at every size, and texts travel once
    hit = hashed.alias("d").join(decided.hint("merge").alias("c"), _same(key, "d", "c")).select("d.*", "c.base", "c.c1", "c.c2")
    first = (F.col("h1") < F.col("c1")) | ((F.col("h1") == F.col("c1")) & (F.col("h2") < F.col("c2")))
    copies = F.col("base") + F.when(F.coalesce(first, F.lit(False)), 1).otherwise(0)
    each = hit.withColumn("copies", copies.cast("long")).filter("copies > 0")
    whole = each.select(*own_columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    # of rows that are equal in every column some get one more: one of them stands for all, in portions
    split = hashed.alias("d").join(cuts.filter("extra > 0").alias("t"), _same(key, "d", "t") & F.expr("d.h1 = t.c1 AND d.h2 = t.c2")).select("d.*", "t.extra")
    one = split.groupBy(*key, "h1", "h2").agg(F.first(F.struct(*own_columns)).alias("row"), F.first("extra").alias("extra"))
    portions = one.select("row", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra") - 1, F.lit(ENTRY_ROWS).cast("long"))).alias("at"))
    rest = portions.repartition("row.doc_id", "at").select("row.*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + ENTRY_ROWS, F.col("extra")) - 1)).alias("copy")).drop("copy")
    return whole.unionByName(rest).toDF(*docs.columns)


def _same(key: list[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def _cuts(hashes: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """(key, c1, c2, extra) for ``wanted`` (key, more): the first ``more`` rows of a key in the order of (h1, h2) are
    those below (c1, c2), and ``extra`` of those at it.

    Only hashes travel. A key falls into ranges of its hashes, and only the range that holds the cut is ordered.
    """
    met = hashes.alias("h").join(wanted.alias("w"), _same(key, "h", "w")).select(F.struct(*[f"h.{c}" for c in key]).alias("g"), "h1", "h2", "more")
    entries = staged(met.groupBy("g", "h1", "h2", "more").agg(F.count("*").alias("n")).withColumn("range", F.shiftright("h1", 52)), "hashes")
    ranges = entries.groupBy("g", "range").agg(F.sum("n").alias("n"), F.max("more").alias("more"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = ranges.withColumn("before", before).filter((F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("n"))).select("g", "range", "before")
    inside = entries.join(at, ["g", "range"])
    start = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("start", start).filter((F.col("start") <= F.col("more")) & (F.col("more") < F.col("start") + F.col("n")))
    return cut.select("g.*", F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.col("more") - F.col("start")).alias("extra"))
