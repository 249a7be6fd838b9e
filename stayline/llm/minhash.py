"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

A text's five-word shingles are hashed once. The top 7 bits of a hash name its bin, and a bin keeps
the least hash. An empty bin borrows: it tries bins in an order of its own, the same for every
text, until it meets one that isn't empty (optimal densification). Of each bin 8 low-order
bits are stored, packed; two texts' likeness is the share of equal bins, corrected for the
1/256 of bins that agree by chance.

Neighbours in descending id order come from windows over id ranges: the ranges are cut at approximate
quantiles, and each range gets a copy of the first row of the range that follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import text_of

BINS, BITS, SHINGLE = 128, 8, 5
#: A bin's number is in a hash's top bits; what is below it orders the hashes of a bin.
_TOP, _LOW = 57, (1 << BITS) - 1
_REST = (1 << _TOP) - 1
#: Attempts that are looked up one by one before all bins are searched for the first that fits.
_TRIES = 8


def _way(place: int) -> tuple[int, int]:
    """Start and odd step of the way on which an empty place tries the others (modulo BINS)."""
    mark = (place * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64)
    mark = (mark ^ mark >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return mark >> 40 & (BINS - 1), mark >> 50 & (BINS - 1) | 1


def _table(numbers: list[int]) -> Column:
    return F.array(*(F.lit(n) for n in numbers))


def _filled(own: Column) -> Column:
    """Codes with null in empty places -> each empty place has the code it borrows."""
    ways = [_way(i) for i in range(BINS)]
    tries = [_table([(a + t * d) % BINS for a, d in ways]) for t in range(_TRIES)]
    starts, inverses = _table([a for a, _ in ways]), _table([pow(d, -1, BINS) for _, d in ways])

    def search(i: Column) -> Column:
        # The attempt that reaches place j is (j - start) / step modulo BINS: the least one wins.
        def attempt(code: Column, j: Column) -> Column:
            t = ((j - F.get(starts, i) + BINS) * F.get(inverses, i)).bitwiseAND(BINS - 1)
            return F.when(code.isNotNull(), t * (_LOW + 1) + code)

        return F.array_min(F.transform(own, attempt)).bitwiseAND(_LOW)

    return F.transform(own, lambda code, i: F.coalesce(code, *(F.get(own, F.get(t, i)) for t in tries), search(i)))


def with_codes(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: one 8-bit code per bin of the text in column `text` (not null)."""
    words, hashed, own = f"_{name}_words", f"_{name}_hashed", f"_{name}_own"
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    # A text of fewer words is one shingle; missing words leave the hash as it is.
    shingles = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    # The largest value of each bin stands behind all its hashes and marks an empty bin.
    ends = _table([(b << _TOP | _REST) - (1 << 64 if b >= BINS // 2 else 0) for b in range(BINS)])
    df = df.withColumn(hashed, F.sort_array(F.concat(shingles, ends)))
    new = lambda x, i: (i == 0) | (F.shiftright(x, _TOP) != F.shiftright(F.get(hashed, i - 1), _TOP))
    code = lambda x: F.when(
        x.bitwiseAND(F.lit(_REST)) != _REST, x.bitwiseAND(F.lit(_LOW)).cast("int"))
    df = df.withColumn(own, F.transform(F.filter(hashed, new), code))
    return df.withColumn(name, _filled(F.col(own))).drop(words, hashed, own)


def packed(codes: str) -> Column:
    """The codes as hex, two digits a bin."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.substring(F.hex(c + (_LOW + 1)), 2, 2)), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated shingle similarity, 0 to 1, corrected for codes that are equal by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (doc_id, text) in ranges of ids, each range with a copy of the row that follows its last
    by descending id; the first row follows the last one. Adds _key, _range and _ghost (the copies)."""
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    narrow = rows.select("_key")
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(narrow.agg(F.percentile_approx("_key", shares, 10_000)).first()[0] or []))  # fewer than `ranges`
    place = F.size(F.filter(_table(cuts), lambda c: c < F.col("_key"))) if cuts else F.lit(0)
    heads = sorted(narrow.groupBy(place.alias("range")).agg(F.max("_key").alias("head")).collect(), reverse=True)
    both = rows.withColumn("_range", place).withColumn("_ghost", F.lit(False))
    if not heads:
        return both
    follows = [(a.range, b.head) for a, b in zip(heads, heads[1:] + heads[:1], strict=True)]  # one a range
    first = rows.sparkSession.createDataFrame(follows, "_range int, _key long")
    by_text = Window.partitionBy("_range").orderBy(F.desc("text"))
    ghosts = rows.join(F.broadcast(first), "_key").withColumn("_at", F.row_number().over(by_text)) \
        .filter("_at = 1").drop("_at").withColumn("_ghost", F.lit(True))
    return both.unionByName(ghosts)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text (empty for null), codes and fingerprint.

    Equal texts have equal fingerprints. A text without words has the fingerprint of the empty
    text. Null ids and repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return with_codes(rows, "text", "codes").withColumn("fingerprint", packed("codes"))


def compare_with_edits(docs: DataFrame, ranges: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half comes from the next text.

    The next row is by descending id, equal ids by text, null ids last; the first row follows the
    last, and a single row is its own next one. Nulls and empty tables as in `fingerprints`.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    order = Window.partitionBy("_range").orderBy("_ghost", F.desc("_key"), F.desc("text"))
    coded = with_codes(in_ranges(rows, ranges), "text", "codes")
    led = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "codes")]
    rows = coded.select("*", *led).filter(~F.col("_ghost"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "codes", "next_codes", n.cast("long").alias("n_chars"), edited.alias("edited"))
    return with_codes(rows, "edited", "edited_codes").select(
        "doc_id", "n_chars", "edited", packed("codes").alias("fingerprint"),
        packed("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"))
