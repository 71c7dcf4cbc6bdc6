"""A uniform shuffle into shards of exact sizes, by a communication matrix.

The input is written once with a number for every row. Rows are cut into blocks of one input
partition. How many rows of each block go to each shard is drawn first: the matrix follows the
hypergeometric law that a uniform shuffle of all rows would give, with exact row sums (the
blocks) and column sums (the shards). It is drawn down a tree of blocks, where every node
deals its counts to up to ``FAN`` children, so nodes of one level are independent rows. A
hypergeometric number is the inverse of its distribution at a hashed number, with the terms
taken from the mode outwards.

Each block is then put in random order and cut as its row of the matrix says; in its shard
every row gets a second random key, which alone decides its slot. Keys of a shard are cut into
even ranges, so ranking them never holds a whole shard. All of this moves row numbers only;
the rows themselves move once, to meet their place. Everything is DataFrame expressions, and
everything random is a hash of numbers that have been written, so a repeated task decides alike.

Nulls and odd input: rows are dealt by their number, never by their content, so nulls, ties,
repeated rows and very long texts change nothing. Shards differ by one row at most; the first
ones have the extra row. With fewer rows than shards some stay empty. An empty table gives an
empty result. All columns of the input come back; ``law``, ``shard``, ``slot`` and
``grown_shard`` are added and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.quality import let
from evalframe.llm.tables import written

SEED = "shard-1"
#: Rows of a block and, on average, of a range of keys in a shard.
BLOCK_ROWS = 1 << 12
#: Children of a node, a power of two.
FAN_BITS = 5
_ROW_BITS = 33  # Spark numbers rows within their partition by 33 bits
_ROW = "_row"


def _uniform(*key: Column) -> Column:
    """53 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(2**53)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` taken from ``total`` are among its ``good`` ones.

    Outcomes go from the mode upwards, then downwards, each weighing a ratio times the one
    before. Twelve deviations and a few on both sides hold all but less than a double can tell.
    """
    def drawn(p: Column) -> Column:
        g, t, n = p["g"], p["t"], p["n"]
        bad = t - g
        low, high = F.greatest(F.lit(0.0), n - bad), F.least(n, g)
        mode = F.greatest(low, F.least(high, F.floor((n + 1) * (g + 1) / (t + 2)).cast("double")))
        spread = F.sqrt(n * (g / t) * (bad / t) * ((t - n) / F.greatest(t - 1, F.lit(1.0))))
        reach = F.ceil(12 * spread + 30).cast("double")
        window = F.struct(
            g.alias("g"), n.alias("n"), (bad - n).alias("c"), mode.alias("mode"),
            F.least(reach, high - mode).cast("bigint").alias("up"), F.least(reach, mode - low).cast("bigint").alias("down"),
        )
        return let(window, inverse)

    def inverse(w: Column) -> Column:
        g, n, c, mode = w["g"], w["n"], w["c"], w["mode"]
        rise = lambda k: (g - k) * (n - k) / ((k + 1) * (c + k + 1))
        fall = lambda k: k * (c + k) / ((g - k + 1) * (n - k + 1))

        def walk(steps: Column, ratio, sign: int, begun: Column, after: Column) -> Column:
            """The sum of weights from ``begun`` on, and the first outcome where it passes ``after``."""
            start = F.struct(F.lit(1.0).alias("w"), begun.alias("sum"), F.lit(None).cast("double").alias("at"))

            def step(s: Column, i: Column) -> Column:
                k = mode + (i - 1) * sign
                weight = s["w"] * ratio(k)
                return let(weight, lambda x: F.struct(
                    x.alias("w"), (s["sum"] + x).alias("sum"),
                    F.coalesce(s["at"], F.when(s["sum"] + x >= after, mode + i * sign)).alias("at"),
                ))

            indices = F.filter(F.sequence(F.lit(0).cast("bigint"), steps), lambda i: i > 0)
            return F.aggregate(indices, start, step)

        never = F.lit(float("inf"))
        above, below = walk(w["up"], rise, 1, F.lit(1.0), never)["sum"], walk(w["down"], fall, -1, F.lit(0.0), never)["sum"]

        def found(x: Column) -> Column:
            target = u * (x["above"] + x["below"])
            up = walk(w["up"], rise, 1, F.lit(1.0), target)["at"]
            down = walk(w["down"], fall, -1, x["above"], target)["at"]
            return F.when(target <= 1.0, mode).otherwise(F.coalesce(up, down, mode))

        return let(F.struct(above.alias("above"), below.alias("below")), found)

    double = lambda x: x.cast("double")
    pool = F.struct(double(good).alias("g"), double(total).alias("t"), double(draws).alias("n"))
    value = let(pool, drawn).cast("bigint")
    return F.when((good == 0) | (draws == 0), F.lit(0).cast("bigint")).when(good == total, draws).otherwise(value)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _dealt(children: Column, counts: Column, seed: Column) -> Column:
    """Each child's share of its parent's counts per shard, drawn child after child."""
    def child(state: Column, x: Column) -> Column:
        left = state["left"]

        def shard(s: Column, at: Column) -> Column:
            good = F.get(left, at)
            count = hypergeometric(good, s["pool"], s["n"], _uniform(seed, x["node"], at))
            return let(count, lambda k: F.struct(
                (s["pool"] - good).alias("pool"), (s["n"] - k).alias("n"), F.concat(s["row"], F.array(k)).alias("row")
            ))

        none = F.array().cast("array<bigint>")
        begun = F.struct(_total(left).alias("pool"), x["n"].alias("n"), none.alias("row"))
        drawn = F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), begun, shard, lambda s: s["row"])
        return let(drawn, lambda row: F.struct(
            F.zip_with(left, row, lambda a, b: a - b).alias("left"),
            F.concat(state["out"], F.array(F.struct(x["node"].alias("node"), row.alias("counts")))).alias("out"),
        ))

    start = F.struct(counts.alias("left"), F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("out"))
    return F.aggregate(children, start, child, lambda s: s["out"])


def communication_matrix(blocks: DataFrame, sizes: list[int], last: int, seed: str = SEED) -> DataFrame:
    """``node, counts``: for each block (``node, n``; the largest node is ``last``) its rows per shard."""
    levels = [blocks.select("node", "n")]
    while last > 0:
        last >>= FAN_BITS
        # The first grouping reads the blocks; those above are small.
        levels.append(levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n")))
    drawn = levels[-1].select("node", F.array(*[F.lit(x).cast("bigint") for x in sizes]).alias("counts"))
    for height in range(len(levels) - 2, -1, -1):
        family = levels[height].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "n"))).alias("children")  # 2**FAN_BITS at most
        )
        shares = _dealt(F.col("children"), F.col("counts"), F.lit(f"{seed}:matrix:{height}"))
        drawn = written(drawn.join(family, "node").select(F.explode(shares).alias("x")).select("x.*"), "shard-matrix")
    return drawn


def _places(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    """``_row, shard, slot`` of every written row number."""
    inside = F.col(_ROW).bitwiseAND((1 << _ROW_BITS) - 1)
    most = rows.agg(F.count(F.lit(1)).alias("n"), F.max(inside).alias("inside"), F.max(F.shiftright(_ROW, _ROW_BITS)).alias("part")).first()
    n, deepest, parts = most["n"], most["inside"] or 0, most["part"] or 0
    sub_bits = (deepest // BLOCK_ROWS).bit_length()
    node = F.shiftleft(F.shiftright(_ROW, _ROW_BITS), sub_bits) + (inside / BLOCK_ROWS).cast("bigint")
    blocked = rows.withColumn("node", node)
    blocks = written(blocked.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix(blocks, sizes, ((parts + 1) << sub_bits) - 1, seed)

    # Local order, then cut: a row goes to the first shard whose counts reach its rank.
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(f"{seed}:local"), _ROW), _ROW))
    ranked = blocked.withColumn("rank", rank).join(matrix, "node")
    passed = lambda upto: F.aggregate(F.slice("counts", 1, upto + 1), F.lit(0).cast("bigint"), lambda a, b: a + b)
    shard = F.size(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: passed(s) < F.col("rank")))
    sent = ranked.select(_ROW, shard.alias("shard"))

    # In its shard a row's place is the rank of its second key, counted range by range.
    bits = max(0, (n // shards // BLOCK_ROWS).bit_length())
    key = F.xxhash64(F.lit(f"{seed}:shard"), _ROW)
    keyed = written(sent.withColumn("key", key).withColumn(
        "range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")
    ), "shard-rows")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", _ROW))
    return keyed.withColumn("within", within).join(offsets, ["shard", "range"]).select(
        _ROW, "shard", (F.col("offset") + F.col("within") - 1).cast("bigint").alias("slot")
    )


def shard_rows(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """The rows with their shard and their slot in it, a uniform shuffle of all of them."""
    clean = docs.drop("law", "shard", "slot", "grown_shard", _ROW)
    numbered = written(clean.withColumn(_ROW, F.monotonically_increasing_id()), "shard-input")
    placed = numbered.join(_places(numbered.select(_ROW), shards, seed), _ROW).drop(_ROW)
    return placed.select(
        *clean.columns, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files in the order of their slots."""
    stretch = (F.col("slot") / (BLOCK_ROWS * 16)).cast("bigint")
    sharded.repartition("shard", stretch).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
