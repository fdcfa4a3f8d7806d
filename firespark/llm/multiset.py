"""Document fingerprints: a homomorphic multiset hash, with DataFrame functions only.

A text is the multiset of its paragraphs. Each paragraph is hashed to a wide vector, and the
vectors are added lane by lane modulo powers of two. So the order of paragraphs bears on
nothing, and a fingerprint is brought up to date by adding the vectors of the paragraphs
that came and subtracting those of the ones that went (``combined``).

The vector (from one SHA-256 of the paragraph):

* ``total``: 1, modulo 2^32; the sum counts the paragraphs;
* ``dense``: six lanes modulo 2^32, all of them hit: equality;
* ``located``: 8 levels of 32 lanes modulo 2^8 of which one is hit: level ``l`` with
  probability 2^-(l+1). Lanes in which two fingerprints differ tell how many paragraphs
  differ, by linear counting in the levels that aren't full. That gives the likeness.

Everything is worked out within the row; no group and no shuffle is needed for a fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firespark.llm.common import stored

#: A line, cut further behind its sentence ends: a tenth of all texts have one line only.
PARAGRAPH = r"[^\x09-\x0D\x20.!?][^.!?\x0A]*[.!?]*"
DENSE, LEVELS, LANES = 6, 8, 32
WORD, BYTE = 1 << 32, 1 << 8
#: Levels with more differing lanes than this tell nothing.
FULL = 29


def paragraphs(text: Column, pattern: str = PARAGRAPH) -> Column:
    """The paragraphs of a text as an array; null texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _words_of(digest: Column) -> Column:
    """The eight 32-bit numbers of a SHA-256 in hexadecimal digits."""
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(DENSE + 2)])


def _located(words: Column) -> Column:
    """Level, lane and value of the one located lane that a paragraph hits."""
    level = sum(((words[DENSE] < F.lit(WORD >> k)).cast("int") for k in range(1, LEVELS)), F.lit(0))
    rest = words[DENSE + 1]
    return F.struct(level.alias("level"), (rest % LANES).cast("int").alias("lane"), (F.shiftright(rest, 5) % BYTE).alias("value"))


def with_fingerprint(rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``rows`` with a fingerprint column: struct of ``total``, ``dense`` and ``located``.

    Texts without paragraphs, null ones among them, have the zero fingerprint.
    """
    # Column by column: what is named more than once is worked out once.
    split = rows.withColumn("_p", F.transform(paragraphs(F.col(text_col)), lambda p: F.sha2(p.cast("binary"), 256)))
    split = split.withColumn("_v", F.transform("_p", _words_of)).withColumn("_w", F.transform("_v", _located))
    # The rows of a level first, so that lanes look through these alone.
    for k in range(LEVELS):
        split = split.withColumn(f"_l{k}", F.filter("_w", lambda v: v["level"] == k))
    zero = F.lit(0).cast("long")

    def level_sums(of: Column) -> Column:
        def lane(j: Column) -> Column:
            return F.aggregate(of, zero, lambda acc, v: F.when(v["lane"] == j, acc + v["value"]).otherwise(acc)) % BYTE

        return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane)).otherwise(F.array_repeat(zero, LANES))

    def dense(i: int) -> Column:
        return F.aggregate("_v", zero, lambda acc, v: acc + v[i]) % WORD

    fingerprint = F.struct(
        (F.size("_v").cast("long") % WORD).alias("total"), F.array(*[dense(i) for i in range(DENSE)]).alias("dense"),
        F.concat(*[level_sums(F.col(f"_l{k}")) for k in range(LEVELS)]).cast("array<smallint>").alias("located"),
    )
    return split.withColumn(out_col, fingerprint).drop("_p", "_v", "_w", *[f"_l{k}" for k in range(LEVELS)])


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of ``a``'s paragraphs with (``sign`` 1) or without (-1) those of ``b``."""
    def lanes(name: str, modulus: int) -> Column:
        return F.zip_with(a[name], b[name], lambda x, y: F.pmod(x + sign * y, F.lit(modulus))).alias(name)

    total = F.pmod(a["total"] + sign * b["total"], F.lit(WORD)).alias("total")
    return F.struct(total, lanes("dense", WORD), lanes("located", BYTE))


def summed(rows: DataFrame, by: list[str], column: str, out_col: str) -> DataFrame:
    """One fingerprint per group: that of all its texts' paragraphs, summed before and after the shuffle."""
    def lanes(name: str, count: int, modulus: int) -> Column:
        return F.array(*[F.sum(F.col(column)[name][i]) % modulus for i in range(count)]).alias(name)

    total = (F.sum(F.col(column)["total"]) % WORD).alias("total")
    folded = F.struct(total, lanes("dense", DENSE, WORD), lanes("located", LEVELS * LANES, BYTE))
    return rows.groupBy(*by).agg(folded.alias(out_col))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal digits: 8 for the count, 48 for the dense lanes, 512 for the located ones."""
    digits = lambda values, width: F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), width, "0"))
    return F.concat(
        F.array_join(digits(F.array(fingerprint["total"]), 8), ""), F.array_join(digits(fingerprint["dense"], 8), ""),
        F.array_join(digits(fingerprint["located"], 2), ""),
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the estimated share of paragraphs that only one of two fingerprints has.

    Exactly 1 for equal fingerprints; rounded to 4 digits.
    """
    differ = F.zip_with(a["located"], b["located"], lambda x, y: (x != y).cast("int"))
    # (paragraphs that differ in the levels taken so far, scale of the highest full level)
    scale = 1.0 / math.log(1 - 1 / LANES)

    def step(acc: Column, k: Column) -> Column:
        full = acc["d"][k] > FULL
        here = F.log(1 - F.least(acc["d"][k], F.lit(LANES - 1)) / F.lit(float(LANES))) * scale
        return F.struct(
            acc["d"].alias("d"), F.when(full, F.lit(0.0)).otherwise(acc["sum"] + here).alias("sum"),
            F.when(full, F.pow(F.lit(2.0), k + 1)).otherwise(acc["scale"]).alias("scale"),
        )

    per_level = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda k: F.aggregate(F.slice(differ, k * LANES + 1, LANES), F.lit(0), lambda acc, x: acc + x),
    )
    walked = F.aggregate(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        F.struct(per_level.alias("d"), F.lit(0.0).alias("sum"), F.lit(1.0).alias("scale")), step,
    )
    both = a["total"] + b["total"]
    # All levels full: more paragraphs differ than the lanes can count.
    apart = F.when(walked["scale"] > 2.0 ** (LEVELS - 1), F.lit(1.0)).otherwise(walked["sum"] * walked["scale"] / both)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - apart), 4))


def _ranges(keys: DataFrame, count: int) -> DataFrame:
    """(bucket, low, high, before): ranges of ``keys(key)`` in ascending order, and the highest key of the one before.

    The first range follows the last one. One row per range: the windows meet few rows.
    """
    ranged = keys.repartitionByRange(count, "key").groupBy(F.spark_partition_id().alias("part"))
    ends = ranged.agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("low")
    wrapped = F.coalesce(F.lag("high").over(order), F.max("high").over(Window.partitionBy(F.lit(1))))
    return stored(ends.select((F.row_number().over(order) - 1).alias("bucket"), "low", "high", wrapped.alias("before")), "ranges")


def _bucket(key: Column, lows: Column) -> Column:
    """The last range that starts at or before the key, by halving steps."""
    def step(at: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(lows, at + width) <= key, F.lit(False)), at + width).otherwise(at)

    halving = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    return F.aggregate(F.filter(halving, lambda w: w < F.size(lows)), F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fp, next_text, next_fp): every row with the next one in descending order of ids.

    Null ids come last, rows of one id in the order of a hash of their text; the last row is
    followed by the first. Null texts are empty. Ranges of ids are found from the ids alone;
    then texts move once, to the task of their range, where a window looks one row on. The
    last row of a range is followed by the first one of the range before it, one per range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col("id"), F.col("h")).alias("key")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text")).select(key, "text")
    count = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(rows.select("key"), count)
    lows = ranges.agg(F.sort_array(F.collect_list("low"))).scalar()
    ranged = rows.withColumn("lows", lows).withColumn("bucket", _bucket(F.col("key"), F.col("lows"))).drop("lows")
    placed = with_fingerprint(ranged, "text", "fp")
    follows = F.lead(F.struct("text", "fp")).over(Window.partitionBy("bucket").orderBy(F.col("key").desc()))
    wanted = ranges.select("bucket", F.col("before.id").alias("_id"), F.col("before.h").alias("_h"))
    same = F.col("key.id").eqNullSafe(F.col("_id")) & (F.col("key.h") == F.col("_h"))
    first = rows.join(wanted, same).groupBy("bucket").agg(F.first("text").alias("text"))
    heads = with_fingerprint(first, "text", "fp").select("bucket", F.struct("text", "fp").alias("head"))
    nexts = placed.withColumn("next", follows).join(heads, "bucket", "left").withColumn("next", F.coalesce("next", "head"))
    return nexts.select("key.id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fp, edited_fp, near_edited, near_next) for every row.

    ``edited`` is the text with its last half replaced by the first as many code points of
    the next document. Equal texts have equal fingerprints; texts of the same paragraphs in
    another order have too. Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    return with_fingerprint(rows, "edited", "edited_fp").select(
        "id", "n_chars", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
