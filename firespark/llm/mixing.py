"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target number of words. Its documents stand in the order of a
seeded hash; whole epochs take all of them, the last epoch takes the documents up to a
cut in that order. The cut is found by descending hash digits: sums per hash prefix,
then only the prefix that the cut falls in is summed again at finer digits, so no task
ever sorts a source.

Output shards are filled by a splitting tree. The root holds each source's exact quota
of blocks (a block is one hash prefix of one source in one epoch). A node gives half of
its blocks to its left child; how many of each source is one multivariate
hypergeometric draw, made source by source with the inverse of the exact distribution.
At the leaves each source's blocks, in a permuted order, are dealt out to the shards by
their quotas, and the documents of a shard are ordered by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firespark.llm.common import WHITE, stored

WEIGHTS = (3, 1, 2)
#: Hash digits added at each descent; after the last one a source has few rows left.
DIGITS = (2, 3, 3)
HEX_END = "g"


def _group(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WHITE)), F.lit(0)).cast("long")


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """The place of a document in its source; rows of one id share a place."""
    named = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: int = 2) -> DataFrame:
    """(g, source_size, target) from (g, size): sums per source and its share of all words.

    Sources in code-point order, null last, take the weights in turn. A target stops at
    ``most`` times its source's size; what it can't take is shared again by weight among
    the others. The sources are met in one window: one row each.
    """
    per = sizes.groupBy("g").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.when(F.col("g") == "n", 1).otherwise(0), "g")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy(F.lit(1))
    weighed = per.withColumn("w", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int"))).withColumn(
        "cap", F.col("source_size") * float(most)
    )
    sums = weighed.withColumn("words", F.sum("source_size").over(everything) * total_share).withColumn(
        "w_all", F.sum("w").over(everything)
    )
    before = Window.orderBy(F.col("cap") / F.col("w"), "g").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.col("cap") * (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))) <= F.col("w") * (
        F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    )
    flagged = sums.withColumn("capped", capped)
    level = (F.col("words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~F.col("capped"), F.col("w"))
    ).over(everything)
    return flagged.withColumn("level", level).select(
        "g", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target")
    )


def cuts(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, source_size, target, epochs, cut): keys up to ``cut`` are taken once more than ``epochs``.

    The cut is the last key whose midpoint isn't past the words still missing, so a
    source misses its target by half a document at most (by half an id, if rows share one).
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    base = stored(
        wanted.withColumn("epochs", epochs.cast("long")).withColumn("missing", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    bounds = base.where("missing > 0").select("g", "missing", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    length = 0
    for more in (*DIGITS, 32 - sum(DIGITS)):
        length += more
        part = (
            sizes.join(bounds, "g")
            .where(F.col("key").startswith(F.col("prefix")))
            .groupBy("g", F.substring("key", 1, length).alias("p"))
            .agg(F.sum("size").alias("size"), F.first("missing").alias("missing"), F.first("before").alias("base"))
        )
        running = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        placed = part.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        if length < 32:
            # The prefix in which the running sum passes what is missing; there is exactly one.
            inside = (F.col("before") < F.col("missing")) & (F.col("before") + F.col("size") >= F.col("missing"))
            bounds = stored(placed.where(inside).select("g", "missing", F.col("p").alias("prefix"), "before"), "cut")
        else:
            taken = F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("missing"), F.col("p"))
            last = placed.groupBy("g").agg(F.max(taken).alias("last"))
            found = bounds.join(last, "g", "left").select("g", F.coalesce("last", "prefix").alias("cut"))
    return base.join(found, "g", "left").select("g", "source_size", "target", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def _draw(rest: Column, own: Column, seats: Column, u: Column) -> Column:
    """One hypergeometric draw: of ``seats`` balls from ``rest``, how many are of ``own``.

    Inverse of the distribution by its ratio recurrence over ten standard deviations
    round the mode; what lies outside has a probability under 1e-20.
    """
    n, k, m = (c.cast("double") for c in (rest, own, seats))
    low, high = F.greatest(F.lit(0), seats - (rest - own)), F.least(own, seats)
    mode = F.greatest(low, F.least(high, F.floor((m + 1) * (k + 1) / (n + 2))))
    spread = F.when(rest > 1, F.sqrt(m * k / n * (n - k) / n * F.greatest(n - m, F.lit(0.0)) / (n - 1))).otherwise(F.lit(0.0))
    reach = F.ceil(10 * spread + 10)
    start, stop = F.greatest(low, mode - reach).cast("long"), F.least(high, mode + reach).cast("long")

    def grown(weight: Column, at: Column) -> Column:
        x = at.cast("double")
        return weight * (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

    def walk(limit: Column | None) -> Column:
        def step(acc: Column, at: Column) -> Column:
            total = acc["sum"] + acc["w"]
            below = acc["below"] if limit is None else acc["below"] + (total < limit).cast("long")
            after = F.when(at < stop, grown(acc["w"], at)).otherwise(acc["w"])
            return F.struct(after.alias("w"), total.alias("sum"), below.alias("below"))

        return F.aggregate(F.sequence(start, stop), zero, step)

    whole = walk(None)["sum"]
    return F.least(start + walk(u * whole)["below"], stop)


def _left_share(salt: str):
    """Step of a node's draw: the next source's blocks that go to the left child."""

    def step(acc: Column, x: Column) -> Column:
        mixed = F.xxhash64(F.lit(salt), F.col("shard"), x["g"])
        u = (F.pmod(mixed, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        drawn = F.when(x["n"] > 0, _draw(acc["rest"], x["n"], acc["seats"], u)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (acc["rest"] - x["n"]).alias("rest"), (acc["seats"] - drawn).alias("seats"), F.array_append(acc["left"], drawn).alias("left")
        )

    return step


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(shard, g, n) from (g, n): each source's blocks shared among ``2 ** levels`` shards.

    Shards hold equally many blocks, give or take one; every block goes to one shard.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("q")).select(F.lit(0).cast("long").alias("shard"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])

        zero = F.struct(
            F.col("total").alias("rest"), F.expr("(total + 1) div 2").alias("seats"), F.array().cast("array<bigint>").alias("left")
        )
        split = node.withColumn("total", total).withColumn("left", F.aggregate("q", zero, _left_share(f"{seed}:{level}"))["left"])
        left = F.zip_with("q", "left", lambda x, h: F.struct(x["g"].alias("g"), h.alias("n")))
        right = F.zip_with("q", "left", lambda x, h: F.struct(x["g"].alias("g"), (x["n"] - h).alias("n")))
        both = F.array(
            F.struct((2 * F.col("shard")).alias("shard"), left.alias("q")), F.struct((2 * F.col("shard") + 1).alias("shard"), right.alias("q"))
        )
        # Stored level by level: nested draws would be worked out once per descendant.
        node = stored(split.select(F.explode(both).alias("b")).select("b.shard", "b.q"), "quotas")
    return node.select("shard", F.explode("q").alias("x")).select("shard", "x.g", "x.n")


class Mix:
    """A mixture of ``docs``: targets and cuts are worked out once and stored.

    Null and blank texts have size 0. Rows with a null source are one source, the last.
    A row is placed by its id, by its text if the id is null; rows that share an id are
    taken alike. Repeated rows count as often as they stand. An empty table gives no rows.
    """

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: int = 2, seed: int = 0,
    ):
        self.docs, self.seed = docs, seed
        self._columns = (_group(F.col(source_col)), _key(id_col, text_col, seed), _words(F.col(text_col)))
        g, key, size = self._columns
        self.sizes = stored(
            docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), g.alias("g"), key.alias("key"), size.alias("size")), "sizes"
        )
        self.sources = stored(cuts(self.sizes, targets(self.sizes, weights, total_share, most)), "cuts")

    @staticmethod
    def _copies(key: Column) -> Column:
        return F.col("epochs") + (key <= F.col("cut")).cast("long")

    def taken(self, words_per_shard: int = 4_000_000) -> DataFrame:
        """(id, source, size, source_size, target, taken) for every row of the input.

        A row is taken as often as the tree has placed one of its copies: the places of its
        block whose epoch is one of its own.
        """
        places, _, digits = self.shards(words_per_shard)
        held = places.groupBy("g", "block").agg(F.collect_list("epoch").alias("placed"))
        rows = self.sizes.join(self.sources, "g").withColumn("block", F.substring("key", 1, digits)).join(held, ["g", "block"], "left")
        own = F.size(F.filter(F.coalesce("placed", F.array().cast("array<bigint>")), lambda e: e <= self._copies(F.col("key"))))
        return rows.select("id", "source", "size", "source_size", "target", (F.col("size") * own).alias("taken"))

    def shards(self, words_per_shard: int = 4_000_000) -> tuple[DataFrame, int, int]:
        """(g, epoch, block) to shard; the number of shards and of the block's hash digits.

        Shards are a power of two that grows with the words taken; blocks are at least
        four times as many as shards, for every source.
        """
        words = self.sources.agg(F.sum("target")).first()[0] or 0.0
        levels = max(0, math.ceil(math.log2(max(words, 1) / words_per_shard)))
        digits = max(1, math.ceil((levels + 2) / 4))
        held = self.sizes.join(self.sources, "g").groupBy("g", F.substring("key", 1, digits).alias("block")).agg(
            F.max(self._copies(F.col("key"))).alias("copies")
        )
        drawn = held.where("copies > 0").select("g", "block", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("epoch"))
        permuted = F.md5(F.concat_ws(":", F.lit(f"{self.seed}b"), "g", "block", "epoch").cast("binary"))
        draws = stored(drawn.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(permuted, "block", "epoch"))), "draws")
        quotas = split_quotas(draws.groupBy("g").agg(F.count("*").alias("n")), levels, self.seed)
        done = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seats = quotas.withColumn("done", done).where("n > 0").select(
            "g", "shard", F.explode(F.sequence(F.col("done") + 1, F.col("done") + F.col("n"))).alias("at")
        )
        return stored(draws.join(seats, ["g", "at"]).select("g", "block", "epoch", "shard"), "shards"), 1 << levels, digits

    def documents(self, words_per_shard: int = 4_000_000) -> DataFrame:
        """The input's columns once per copy taken, with its ``mix_epoch``, ``mix_shard`` and
        ``mix_order``, dealt out by shard and shuffled within each. Input columns of those
        names are replaced."""
        names = [c for c in self.docs.columns if c not in ("mix_epoch", "mix_shard", "mix_order")]
        g, key, _ = self._columns
        places, shards, digits = self.shards(words_per_shard)
        whole = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), g.alias("g"), key.alias("key"))
        copies = whole.join(self.sources.select("g", "epochs", "cut"), "g").withColumn("copies", self._copies(F.col("key")))
        each = copies.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn(
            "block", F.substring("key", 1, digits)
        )
        order = F.md5(F.concat_ws(":", F.lit(f"{self.seed}o"), "key", "epoch").cast("binary"))
        return (
            each.join(places, ["g", "block", "epoch"])
            .select("row.*", F.col("epoch").alias("mix_epoch"), F.col("shard").alias("mix_shard"), order.alias("mix_order"))
            .repartition(max(shards, 1), "mix_shard")
            .sortWithinPartitions("mix_shard", "mix_order")
        )
