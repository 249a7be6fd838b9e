"""Fill-in-the-middle transformation with counted regular expressions, DataFrame functions only.

A text is a row of units (by default code points). `regexp_count` gives their number n, hashes of the
key give two cut points a <= b, and one match of the row's own pattern

    \\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z

captures prefix, middle and suffix; the replacement of that match writes the three groups in the order of
the form with the sentinels between them. All quantifiers are possessive, so the match is a loop without
backtracking or recursion, linear in the text however long it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import text_of

CODE_POINT = "(?s:.)"
#: Units counted at a time, so that the matches a count holds are few even in a very long text.
_STRIDE = 1024


@dataclass(frozen=True)
class Sentinels:
    """Marks before prefix, suffix and middle. None may begin and end alike, so that the first place where
    a mark occurs behind text without marks is the mark itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or any(m.startswith(m[k:]) for k in range(1, len(m))) for m in marks):
            raise ValueError("sentinels are three different strings, none empty or ending as it begins")


def _quoted(mark: str) -> str:
    """The mark within a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", mark)


def _written(mark: str) -> str:
    """The mark within a replacement."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units a text has: whole strides, then the units behind them."""
    stride = f"(?:{unit}){{{_STRIDE}}}+"
    rest = F.regexp_replace(text, F.lit(rf"\A(?:{stride})*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(stride)).cast("long") * _STRIDE
            + F.regexp_count(rest, F.lit(f"(?:{unit})")).cast("long"))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of `seed:key`; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text, from a transformed text and its form alone."""
    p, s, m = (_quoted(x) for x in (marks.prefix, marks.suffix, marks.middle))
    return F.when(form == "psm", F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))) \
        .when(form == "spm", F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))) \
        .otherwise(output)


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = 1,
    percent: int = 90, spm_percent: int = 20, marks: Sentinels = Sentinels(),
) -> DataFrame:
    """One row per document: key, n (units), form (plain, psm, spm), prefix_units, middle_units, output.

    The text is cut after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units; `percent` of the
    texts are transformed, `spm_percent` of those have their suffix first. A null text is empty. An empty text
    and one that holds a mark stay plain, and so does one that its units leave gaps in (a unit pattern
    other than a code point must tile the text). The units of a plain text are null. Draws depend on the
    key alone: repeated rows give equal rows, a null key draws as an empty one; an empty table gives none.
    """
    own = _draws(F.col("key"), seed)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    counted = rows.select("key", "text", unit_count(F.col("text"), unit).alias("n"),
                          *[h.alias(f"h{i}") for i, h in enumerate(own, 1)])
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    held = F.lit(False)
    for mark in (marks.prefix, marks.suffix, marks.middle):
        held = held | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= percent)
    cut = counted.select(
        "key", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("asked"))
    times = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), times(F.col("a")), times(F.col("b") - F.col("a")), F.lit(r"((?s:.*+))\z"))
    p, s, m = (_written(x) for x in (marks.prefix, marks.suffix, marks.middle))
    order = F.when(F.col("asked") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    made = cut.withColumn("output", F.when(F.col("asked") == "plain", F.col("text"))
                          .otherwise(F.regexp_replace(F.col("text"), pattern, order)))
    # The marks make an output longer than its text, so equal means that nothing was matched.
    form = F.when(F.col("output") == F.col("text"), "plain").otherwise(F.col("asked"))
    inside = F.col("form") != "plain"
    return made.withColumn("form", form).select(
        F.col("key").alias(key), "n", "form", F.when(inside, F.col("a")).alias("prefix_units"),
        F.when(inside, F.col("b") - F.col("a")).alias("middle_units"), "output")
