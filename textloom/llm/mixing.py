"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, Whole, pick

#: Rounds of the swap-or-not permutation.
ROUNDS = 10
#: Rows for which one window computes running offsets, and cells for which one does.
CELL_ROWS, CELLS = 2_000, 1_000
#: Blocks that the mean source has at least, if its words are enough; the least and the most words of a block.
MEAN_BLOCKS, BLOCK_WORDS = 1024, (32, 256)
#: Slots for each task that numbers and permutes them.
TASK_SLOTS = 250_000


def _uniform(*columns) -> Column:
    """In [0, 1), from the top 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def running(rows: DataFrame, key: str, place: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their key with a smaller ``place`` (a number, once for each key).

    In two phases: sums of ``CELLS`` places, then within those. No window is longer
    than ``CELLS`` rows or a key's places divided by ``CELLS``.
    """
    rows = rows.withColumn("_group", F.floor(F.col(place) / CELLS))
    before = lambda *parts: Window.partitionBy(*parts[:-1]).orderBy(parts[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(key, "_group").agg(F.sum(value).alias("_sum"))
    groups = groups.select(key, "_group", F.coalesce(F.sum("_sum").over(before(key, "_group")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(before(key, "_group", place)), F.lit(0))
    return rows.join(groups, [key, "_group"]).withColumn(name, (F.col("_base") + within).cast("long")).drop("_group", "_base")


class Mixture:
    """A mix of sources by weight, in blocks of ``block_words`` words.

    Unless given, blocks are as long as lets the mean source have ``MEAN_BLOCKS``, within
    ``BLOCK_WORDS``: targets are met to within a few blocks of each source, so
    large inputs can do with long ones.

    1. A source's documents, in a fixed order, are one run of words, cut into blocks.
    2. Targets: the sources, in order of their names' code points (null last), weigh
       ``weights`` in turn and share all words; none gets more than
       ``most_repeats`` times its size, and what it can't take goes to the others by weight.
    3. Each output shard of about ``shard_slots`` slots draws how many slots each
       source gets: the whole part of what it expects, and for the slots
       then left a multinomial draw by the fractional parts.
    4. A source's slots count on through the shards. Slot j takes block
       perm(j mod n) of the source's n blocks, by a pseudorandom permutation
       (swap-or-not) for each pass over the source. Slots and blocks meet by
       (source, index), so a hot source is spread like any other.

    All draws are hashes of the seed: reruns agree. Sources number as weights do, by
    configuration: only a table of a row per source is held to be small. Documents
    and shards are numbered in two phases, in cells of about ``CELL_ROWS`` rows, and slots are
    spread over tasks of ``TASK_SLOTS`` before they are made.

    Null and empty texts have size 0 and are never taken. A null source is a
    source. Null or repeated ids and rows count each for themselves. Empty tables
    give empty results.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), most_repeats: int = 3, block_words: int | None = None, shard_slots: int = 4096, seed: int = 1):
        self.spark, self.weights, self.most_repeats, self.block, self.shard_slots, self.seed = spark, weights, most_repeats, block_words, shard_slots, seed
        self.scratch = Scratch(spark)
        rows = pick(docs, doc_id="long", text="string", source="string")
        # Words as one mark each: regexp_count would make an array of all words of a text first.
        size = F.coalesce(F.length(F.translate(F.regexp_replace("text", WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")
        rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
        self.sizes = self.scratch.keep(rows)
        if block_words is None:
            words, n = self.sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("source")).first()
            self.block = min(max(words // max(1, n * MEAN_BLOCKS), BLOCK_WORDS[0]), BLOCK_WORDS[1])
        self.sources = self.scratch.keep(self._sources())
        self.rows = self.scratch.keep(self._offsets())

    def _sources(self) -> DataFrame:
        """sid, source, n_rows, source_size, target, n_blocks, slots (expected)."""
        s = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
        s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in self.weights]), F.col("sid") % len(self.weights) + 1))
        # The level at which the targets weight * level, cut at their caps, sum up to everything.
        s = s.withColumn("cap", self.most_repeats * F.col("source_size").cast("double"))
        everything, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "sid")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        s = s.withColumn("level", level)
        s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(everything)["level"])
        s = s.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / self.block))
        slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
        return s.select("sid", "source", "n_rows", "source_size", "target", "n_blocks", slots.alias("slots"))

    def _offsets(self) -> DataFrame:
        """The rows with their source's sid and where their words begin in its run."""
        cells = F.ceil(F.col("n_rows") / CELL_ROWS).cast("int")
        rows = self.sizes.join(F.broadcast(self.sources.select("sid", "source", "n_rows", "source_size", "target")), self.sizes["source"].eqNullSafe(self.sources["source"])).drop("source")
        rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_hash"), cells)).drop("n_rows")
        sums = running(rows.groupBy("sid", "cell").agg(F.sum("size").alias("words")), "sid", "cell", "words", "base").drop("words")
        within = Window.partitionBy("sid", "cell").orderBy("doc_id", "text_hash", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(sums, ["sid", "cell"])
        return rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("cell", "base")

    def shards(self) -> DataFrame:
        """sid, n_blocks, shard, n_slots, first_slot: what each shard takes of each source."""
        total = self.sources.agg(F.sum("slots")).first()[0] or 0.0
        n = round(total)
        count = max(1, -(-n // self.shard_slots))
        self.spread = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_SLOTS))
        groups = self.sources.filter("n_blocks > 0").select("sid", "n_blocks", "slots", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // CELLS))).alias("group"))
        groups = groups.repartition(min(self.spread, -(-count // CELLS)), "group")
        last_one = F.least(F.lit(count), (F.col("group") + 1) * CELLS) - 1
        every = groups.select("sid", "n_blocks", "slots", F.explode(F.sequence(F.col("group") * CELLS, last_one)).alias("shard"))
        size = F.lit(n // count) + (F.col("shard") < n % count).cast("int")
        every = every.withColumn("expected", size * F.col("slots") / F.lit(total or 1.0)).withColumn("whole", F.floor("expected"))
        every = every.withColumn("part", F.col("expected") - F.col("whole"))
        shard, upto = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy("sid")
        every = every.withColumn("left", (size - F.sum("whole").over(shard)).cast("int"))
        every = every.withColumn("all_parts", F.sum("part").over(shard)).withColumn("to", F.sum("part").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.col("sid") == F.max("sid").over(shard)
        point = lambda k: _uniform(F.lit(self.seed), F.col("shard"), k) * F.col("all_parts")
        drawn = F.filter(F.sequence(F.lit(1), F.col("left")), lambda k: (point(k) >= F.col("to") - F.col("part")) & ((point(k) < F.col("to")) | F.col("last")))
        every = every.withColumn("last", last).withColumn("n_slots", F.col("whole") + F.when(F.col("left") > 0, F.size(drawn)).otherwise(0))
        return running(every.select("sid", "n_blocks", "shard", "n_slots"), "sid", "shard", "n_slots", "first_slot")

    def slots(self) -> DataFrame:
        """shard, slot (of the source), sid, block: one row for each slot of the mix.

        The shards, few and small, are dealt to ``spread`` tasks before their slots are made.
        """
        shards = self.shards().filter("n_slots > 0").repartition(self.spread, "sid", "shard")
        s = shards.withColumn("slot", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n_slots") - 1)))
        # The draws may exceed what a source may give in all by a few slots; those stay empty.
        s = s.filter(F.col("slot") < self.most_repeats * F.col("n_blocks"))
        s = s.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("block", F.col("slot") % F.col("n_blocks"))
        n = F.col("n_blocks")
        for r in range(ROUNDS):  # columns, not a lambda: these are compiled
            key = [F.lit(self.seed), F.col("sid"), F.col("pass"), F.lit(r)]
            s = s.withColumn("twin", F.pmod(F.pmod(F.xxhash64(*key), n) - F.col("block"), n))
            s = s.withColumn("block", F.when(F.xxhash64(*key, F.greatest("block", "twin")).bitwiseAND(F.lit(1)) == 1, F.col("twin")).otherwise(F.col("block")))
        # Written: a join's filters on these columns would otherwise be taken through all rounds at once.
        return self.scratch.keep(s.select("shard", "slot", "sid", "block"))

    def pieces(self) -> DataFrame:
        """row, doc_id, sid, block, first_word, n_words: what each block holds of each document."""
        end = F.col("start") + F.col("size")
        p = self.rows.filter("size > 0").select("row", "doc_id", "text_hash", "sid", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((end - 1) / self.block))).alias("block"))
        first = F.greatest(F.col("block") * self.block, F.col("start"))
        return p.select("row", "doc_id", "text_hash", "sid", "block", (first - F.col("start")).alias("first_word"), (F.least((F.col("block") + 1) * self.block, F.col("end")) - first).alias("n_words"))

    def mixed(self) -> DataFrame:
        """The mix: each slot with the pieces of documents that its block holds.

        Slots come from a small table by an explode, which size estimates don't
        see: without the hint they would be broadcast, however many they are.
        """
        return self.slots().hint("merge").join(self.pieces(), ["sid", "block"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for each row of the documents."""
        words = self.mixed().groupBy("row").agg(F.sum("n_words").alias("taken"))
        out = self.rows.join(words, "row", "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as rows of ``docs``: a row for each time that words of a document are taken.

        The first row of a document has its pieces that are taken at all, the second
        those taken twice or more, and so on; so no more than ``most_repeats``
        rows, and the words are those that ``taken`` counts. White space
        after a word stays with it. Rows that repeat (id and text) have their pieces
        each, from one of their texts.
        """
        uses = self.mixed().groupBy("doc_id", "text_hash", "row", "first_word", "n_words").agg(F.count("*").alias("uses"))
        per_doc = uses.groupBy("doc_id", "text_hash", "row").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words", "uses"))).alias("used"))
        token = F.regexp_extract_all("text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
        counted = {"n_chars": "long"} if "n_chars" in docs.columns else {}
        whole = Whole(docs, doc_id="long", text="string", **counted)
        # One key for both sides, so that texts are shuffled once.
        both = lambda text: F.xxhash64("doc_id", text)
        rows = whole.rows.withColumn("text_hash", F.xxhash64("text")).withColumn("_key", both("text_hash")).dropDuplicates(["_key", "doc_id", "text_hash"])
        used = per_doc.select(both("text_hash").alias("_key"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "used")
        rows = rows.join(used, "_key").filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        rows = rows.withColumn("tokens", token).withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("used", lambda u: u["uses"])))))
        text = F.array_join(F.transform(F.filter("used", lambda u: u["uses"] >= F.col("pass")), lambda u: F.array_join(F.slice(F.col("tokens"), (u["first_word"] + 1).cast("int"), u["n_words"].cast("int")), "")), "")
        rows = rows.withColumn("text", text)
        return whole.back(rows, text=F.col("text"), **{n: F.length("text").cast("long") for n in counted})


def mix_sources(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs``: see ``Mixture``.

    A null or empty text has size 0 and is not taken; a null source is a source, the last
    in order; null ids and repeated rows count each for themselves; equal names of sources
    that differ in case only are two; other columns don't matter. An empty table gives no rows.
    """
    return Mixture(spark, docs, **options).taken()
