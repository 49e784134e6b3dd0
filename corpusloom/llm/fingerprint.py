"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Every word shingle is hashed once. The top bits of a hash name its bin, each bin keeps its smallest hash, and an
empty bin borrows from the occupied bin that comes first in the empty bin's own random order (optimal densification).
The low ``bits`` bits of every bin are packed as hexadecimal digits; likeness is the share of equal bins, corrected
for the matches that truncated values give by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import id_ranges, let, long_table, range_of

BINS, BITS, PROBES = 128, 4, 16
SHINGLE = 5
#: Documents in one range of ids when neighbours are looked up.
RANGE_ROWS = 400
#: One character outside white space, then the rest of a word (fixed: ASCII white space separates words).
WORD = r"[^\x20\x09-\x0D]+"


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """63-bit hashes of the word shingles of a text; a text of fewer words is one shingle, one without words has none."""

    def shingles(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) < shingle, F.array(F.xxhash64(w))
        ).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        )

    words = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    return F.transform(let(words, shingles), lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))


def bin_minima(hashes: Column, bins: int = BINS) -> Column:
    """Smallest hash of every bin, null for an empty one."""
    shift = 63 - (bins.bit_length() - 1)

    def firsts(h: Column) -> Column:
        # the sorted hashes lie bin by bin: the first of each bin is its minimum
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, i - 1), shift)))

    def spread(m: Column) -> Column:
        at = F.map_from_arrays(F.transform(m, lambda x: F.shiftright(x, shift)), m)
        return let(at, lambda a: F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda b: F.element_at(a, b)))

    return let(let(F.sort_array(hashes), firsts), spread)


def probe_order(bins: int = BINS, probes: int = PROBES) -> list[list[int]]:
    """First bins that each bin asks when it is empty: pseudo-random draws from one integer mix."""
    out = []
    for b in range(bins):
        row, x = [], (b + 1) * 0x9E3779B97F4A7C15
        for _ in range(probes):
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
            row.append((x >> 40) % bins)
        out.append(row)
    return out


def densified(minima: Column, bins: int = BINS) -> Column:
    """Every empty bin takes the value of the first occupied bin in its own random order.

    The order starts with ``PROBES`` draws; in the rare case that all of them are empty, the occupied bin with the
    smallest hash of (empty bin, occupied bin) comes next, so every empty bin finds one.
    """
    draws = F.array(*[F.lit(row).cast("array<int>") for row in probe_order(bins)])

    def fill(m: Column) -> Column:
        def chosen(b: Column) -> Column:
            first = F.get(F.filter(F.get(draws, b), lambda s: F.get(m, s).isNotNull()), 0)
            full = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda s: F.get(m, s).isNotNull())
            # hash and bin share one long, so the smallest long names the bin
            keys = F.transform(full, lambda s: F.xxhash64(b, s).bitwiseAND(F.lit(~(bins - 1))).bitwiseOR(s.cast("bigint")))
            return F.coalesce(first, F.array_min(keys).bitwiseAND(F.lit(bins - 1)).cast("int"))

        return F.transform(m, lambda x, b: F.when(x.isNotNull(), x).otherwise(F.get(m, chosen(b))))

    return let(minima, lambda m: F.when(F.exists(m, lambda x: x.isNotNull()), fill(m)).otherwise(F.array().cast("array<bigint>")))


def packed(values: Column, bits: int = BITS) -> Column:
    """Low bits of every bin as one hexadecimal digit each; a text without words has the empty string."""
    digits = F.lit([f"{d:x}" for d in range(1 << bits)])
    return F.array_join(F.transform(values, lambda v: F.get(digits, v.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))), "")


def minhash(text: Column) -> Column:
    """Packed fingerprint of a text; equal texts have equal fingerprints."""
    return packed(densified(bin_minima(shingle_hashes(text))))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1; two texts without words are alike."""
    chance = 1 / (1 << bits)
    same = F.length(F.regexp_replace(_equal_digits(a, b), "0", "")) / F.lit(float(bins))
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.round(estimate, 6))


def _equal_digits(a: Column, b: Column) -> Column:
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, "1").otherwise("0")), "")


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` plus the fingerprint of its text (null: of the empty text). Empty tables stay empty."""
    return docs.withColumn(name, minhash(F.coalesce(F.col("text"), F.lit(""))))


def neighbours(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` plus next_<column>: the values of the row with the next larger doc_id; the last row meets the first.

    Rows sort inside ranges of ids; only the first row of each range travels to the range before it. Rows that repeat
    a doc_id follow one another by a hash of the first of ``columns``, then by itself; a null doc_id sorts first.
    """
    cuts = id_ranges(docs, "doc_id", RANGE_ROWS)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(columns[0])), 1)
    own = range_of(F.col("doc_id"), cuts, tie)
    found = docs.groupBy(own.alias("r")).agg(F.min("doc_id").alias("id"), F.bool_or(F.col("doc_id").isNull()).alias("null"))
    heads = sorted((r["r"], None if r["null"] else r["id"]) for r in found.collect())  # MAX_RANGES rows at most
    ids, before = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for (r, head), (previous, _) in zip(heads, heads[-1:] + heads[:-1], strict=True):
        ids[r], before[r] = head, previous
    ranged = docs.withColumn("_own", own)
    is_head = F.col("doc_id").eqNullSafe(F.get(long_table(ids), F.col("_own")))
    guest = F.get(long_table(before), F.col("_own"))
    # a head row enters its own range and, as a guest, the range before it
    at_home = _place(F.col("_own"), False)
    placed = ranged.withColumn("_at", F.explode(F.when(is_head, F.array(at_home, _place(guest, True))).otherwise(F.array(at_home))))
    order = [F.col("_at.guest"), F.col("doc_id").asc_nulls_first(), tie, F.col(columns[0])]
    led = placed.withColumn("_next", F.lead(F.struct(*columns)).over(W.partitionBy("_at.range").orderBy(*order))).filter("NOT _at.guest")
    return led.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def _place(at: Column, guest: bool) -> Column:
    return F.struct(at.cast("int").alias("range"), F.lit(guest).alias("guest"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Other
    columns of ``docs`` are not read; a null text counts as empty; an only document is its own neighbour.
    """
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = neighbours(own, ["text", "fingerprint"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = both.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    printed = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint",
        minhash(F.col("edited")).alias("edited_fingerprint"),
    )
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
