"""Near-duplicates: a chosen-path set similarity join on word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, Whole, WordHashes, by_hot_and_cold, hashed_words, lean, pick, raw_bytes, window_hashes
from .components import connected_components

SKETCH = 64  # minwise tokens of each document
TREES = 12
BRANCH = 2
SMALL_NODE = 4000
MOST_DEPTH = 2
#: Documents whose texts are fetched by broadcasting their ids; beyond this number the texts are shuffled instead.
FETCH_BY_BROADCAST = 1_000_000
SIGNATURE = "row long, doc_id long, n_shingles long, set_key binary, sketch array<int>"


def shingle_set(text: bytes | None, width: int, table: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles; a short text is one shingle as a whole."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashed_words(words, table)
    if len(h) < width:
        return window_hashes(h, len(h)) ^ np.uint64(len(h) * 0x9E3779B97F4A7C15 % (1 << 64))
    return np.unique(window_hashes(h, width))


def minwise(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each hash function, the least value over the set (its top 32 bits, as signed ints)."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(h), 2048):
        part = h[None, start : start + 2048] * factors[:, None]
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _factors() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def similar(s: np.ndarray, t: np.ndarray, least: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least``/100 or more."""
    both = np.concatenate([s, t])
    both.sort(kind="stable")  # merges sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= least * (len(both) - common)


class NearDuplicates:
    """Links between documents of Jaccard similarity ``least``/100 or more, and their components.

    Documents of equal sets are one document to the join. Each of ``TREES``
    independent trees has minwise tokens of its own and starts with one of them: documents with the same
    value share a node. In nodes of up to ``SMALL_NODE`` documents all are
    compared; larger ones branch by ``BRANCH`` further tokens chosen by the
    node, and so on. A pair at the threshold (0.75) passes a tree with
    probability 0.75 where its first node is small, and never below 2/3 however deep
    it has to go (p = 0.75 (1 - (1 - p)^2)), so that ``TREES`` trees miss it
    with probability 2e-6 at most; pairs more alike far less often.

    What makes large groups of copies cheap: documents known to be connected
    need no more comparing with each other. So each document is first held
    against the document that begins its most similar node, and against the
    likeliest one in each of its nodes: a pair or less for each document and node.
    Only nodes that still hold several components then are compared
    exhaustively, or branched; their full sets are brought to the node once for each document that
    has a likely partner there, and what a node finds is a forest of links.

    Comparing goes by sketches first: pairs that agree in fewer than 32 of
    ``SKETCH`` tokens (a pair at the threshold does with probability 4.6e-6) or
    differ too much in size are ruled out. All links are confirmed on full sets.
    Copies that are alike in nearly everything don't part by branching: a node
    that is still large after ``MOST_DEPTH`` levels is compared in blocks, the
    documents outside its main component against all. So depth costs no links.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int = 5, least: int = 75, least_agreeing: int = 32):
        self.spark, self.width, self.least, self.least_agreeing = spark, width, least, least_agreeing
        self.scratch = Scratch(spark)
        self.docs = pick(docs, doc_id="long", text="string")
        self.signatures = self.scratch.keep(self._signatures())
        groups = self.signatures.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("row"), F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("n_rows"))
        self.groups = self.scratch.keep(groups)
        self.reps = self.scratch.keep(self.signatures.join(self.groups.select("row"), "row").select(F.col("row").alias("rep"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep"]))

    def _signatures(self) -> DataFrame:
        width = self.width

        def sign(batches):
            import xxhash

            table, factors = WordHashes(), _factors()
            for b in batches:
                out = []
                for text in raw_bytes(b.column("text")):
                    h = shingle_set(text, width, table)
                    out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), minwise(h, factors) if len(h) else None))
                n, key, sketch = zip(*out) if out else ((), (), ())
                yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int32()))], names=["row", "doc_id", "n_shingles", "set_key", "sketch"])

        rows = self.docs.withColumn("row", F.xxhash64("doc_id", "text"))
        return rows.select("row", "doc_id", "text").mapInArrow(lean(sign), SIGNATURE)

    # Nodes

    def _roots(self) -> DataFrame:
        """(node, rep) of the trees' first level, where a node has several documents."""
        all_ = self.reps.select("rep", F.posexplode(F.slice("sketch", 1, TREES)).alias("tree", "token"))
        # The last four bits of a node's name are its tree.
        return all_.select(F.shiftleft(F.xxhash64("tree", "token"), 4).bitwiseOR(F.col("tree")).alias("node"), "rep")

    def _children(self, members: DataFrame, depth: int) -> DataFrame:
        """The next level: ``BRANCH`` further tokens, the same ones for all documents of a node, and of its tree alone."""
        with_sketch = members.select("node", "rep").join(self.reps.select("rep", "sketch"), "rep")
        split = with_sketch.select("node", "rep", "sketch", F.explode(F.array(*[F.lit(i) for i in range(BRANCH)])).alias("i"))
        # Beyond the first TREES, which the roots have used, each tree owns BRANCH * MOST_DEPTH tokens.
        tree = F.col("node").bitwiseAND(F.lit(15))
        place = (TREES + tree * BRANCH * MOST_DEPTH + BRANCH * (depth - 1) + F.col("i")).cast("int")
        return split.select(F.shiftleft(F.xxhash64("node", "i", F.element_at("sketch", place + 1)), 4).bitwiseOR(tree).alias("node"), "rep")

    def _occupied(self, members: DataFrame, component: DataFrame | None) -> DataFrame:
        """node, rep, component, n_members of the nodes with several documents (of several components, where known)."""
        if component is not None:
            members = members.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        else:
            members = members.withColumn("component", F.col("rep"))
        members = self.scratch.keep(members.dropDuplicates(["node", "rep"]) if component is not None else members)
        nodes = members.groupBy("node").agg(F.count("*").alias("n_members"), F.min("component").alias("main"), F.max("component").alias("b"), F.min("rep").alias("first"))
        nodes = self.scratch.keep(nodes.filter("main != b").drop("b"))
        return self.scratch.keep(members.join(nodes.hint("merge"), "node"))

    # Pairs

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """row and shingles of the wanted rows: a written table."""
        width = self.width
        wanted = self.scratch.keep(wanted.distinct())
        small = wanted.limit(FETCH_BY_BROADCAST + 1).count() <= FETCH_BY_BROADCAST
        rows = self.docs.withColumn("row", F.xxhash64("doc_id", "text"))
        fetched = rows.join(F.broadcast(wanted) if small else wanted.hint("merge"), "row", "left_semi").select("row", "text")

        def sets(batches):
            table = WordHashes()
            for b in batches:
                rows, texts = b.column("row"), raw_bytes(b.column("text"))
                for start in range(0, len(texts), 500):  # sets can be larger than texts
                    yield pa.record_batch([rows[start : start + 500], pa.array([shingle_set(t, width, table).tobytes() for t in texts[start : start + 500]], pa.binary())], names=["row", "shingles"])

        held = self.scratch.keep(fetched.mapInArrow(lean(sets), "row long, shingles binary"))
        return held.dropDuplicates(["row"]) if self._repeats() else held

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sketches and set sizes leave possible, with the number of agreeing tokens."""
        left = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        agreeing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
        fits = 100 * F.least("n_a", "n_b") >= self.least * F.greatest("n_a", "n_b")
        joined = pairs.join(left, "a").join(right, "b").filter(fits)
        return joined.withColumn("agreeing", agreeing).filter(F.col("agreeing") >= self.least_agreeing).select("a", "b", "agreeing")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough, as links (u, v)."""
        least = self.least
        held = self._sets(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))))

        def compare(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                    keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least))
                yield pa.record_batch([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["u", "v"])

        one = pairs.select("a", "b").join(held.select(F.col("row").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
        two = one.join(held.select(F.col("row").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
        return self.scratch.keep(two.select("a", "b", "x", "y").mapInArrow(lean(compare), "u long, v long"))

    def _repeats(self) -> bool:
        """Whether rows repeat, id and text."""
        if not hasattr(self, "_repeat"):
            self._repeat = self.signatures.count() != self.signatures.select("row").distinct().count()
        return self._repeat

    # The join

    def links(self) -> DataFrame:
        """Links (u, v) between representatives that connect all that is linked."""
        roots = self._occupied(self._roots(), None)
        stars = roots.filter("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
        best = self._likely(stars).groupBy("b").agg(F.max(F.struct("agreeing", "a")).alias("best"))
        likely = self._in_units(self._units(roots, whole=False), "nearest")
        pairs = best.select(F.col("best.a").alias("a"), "b").unionByName(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        links = self._confirmed(self.scratch.keep(pairs.distinct()))
        component = self._labels(links)
        roots = roots.select("node", "rep")
        members, units, depth = self._occupied(roots, component), [], 0
        while True:
            units.append(self._units(members.filter(F.col("n_members") <= SMALL_NODE), whole=True))
            large = members.filter(F.col("n_members") > SMALL_NODE)
            if large.isEmpty():
                break
            if depth == MOST_DEPTH:
                units.append(self._block_units(large))
                break
            depth += 1
            members = self._occupied(self._children(large, depth), component)
        all_units = units[0]
        for more in units[1:]:
            all_units = all_units.unionByName(more)
        involved = self.scratch.keep(self._in_units(all_units, "involved"))
        sets = self._sets(involved.select(F.col("b").alias("row"))).withColumnRenamed("row", "rep")
        all_units = all_units.join(involved.select(F.col("a").alias("unit"), F.col("b").alias("rep")).distinct(), ["unit", "rep"])
        return links.unionByName(self.scratch.keep(self._in_units(all_units, "exact", sets).distinct().toDF("u", "v")))

    def _labels(self, links: DataFrame) -> DataFrame:
        return self.scratch.keep(connected_components(self.spark, links).withColumnRenamed("node", "rep"))

    def _units(self, members: DataFrame, whole: bool) -> DataFrame:
        """Nodes as units of a task's work; without ``whole``, large ones in parts that don't meet."""
        part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n_members") / SMALL_NODE).cast("int"))
        unit = F.col("node") if whole else F.when(F.col("n_members") > SMALL_NODE, F.xxhash64("node", part)).otherwise(F.col("node"))
        return members.select(unit.alias("unit"), F.lit(0).alias("side"), "rep", "component")

    def _block_units(self, members: DataFrame) -> DataFrame:
        """Units of large nodes.

        A node's documents are dealt to blocks. Each block of documents
        outside the main component (that of the node's least member) meets
        each block of all, in a unit of its own.
        """
        blocks = F.ceil(2 * F.col("n_members") / SMALL_NODE).cast("int")
        m = members.withColumn("outside", F.col("component") != F.col("main")).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        all_ = m.select("node", F.col("block").alias("i"), every.alias("j"), F.lit(1).alias("side"), "rep", "component")
        rest = m.filter("outside").select("node", every.alias("i"), F.col("block").alias("j"), F.lit(2).alias("side"), "rep", "component")
        units = all_.join(rest.select("node", "j").distinct(), ["node", "j"], "left_semi").unionByName(rest)
        return units.select(F.xxhash64("node", "i", "j").alias("unit"), "side", "rep", "component")

    def _in_units(self, units: DataFrame, give: str, sets: DataFrame | None = None) -> DataFrame:
        """What the documents of each unit find of each other; pairs (a, b).

        nearest: for each document, the one of another component that agrees with it most;
        involved: the unit, and each document with a likely partner in it;
        exact: links between documents of different components, confirmed on the
        full sets, as far as they connect what isn't connected yet.
        """
        least, least_agreeing, full = self.least, self.least_agreeing, sets is not None

        def settle(unit, rows):
            rows = {k: (np.concatenate if k != "shingles" else lambda x: [y for z in x for y in z])([r[k] for r in rows]) for k in rows[0]}
            side, rep, component, n = rows["side"], rows["rep"], rows["component"], rows["n"]
            tokens = np.ascontiguousarray(rows["sketch"].T)
            right = np.flatnonzero(side != 2)
            names, count = np.unique(component[right], return_counts=True)
            # Pairs within the largest component are none: each pair has a side outside it.
            left = np.flatnonzero((side == 2) | ((side == 0) & (component != names[count.argmax()])))
            parent = {c: c for c in component.tolist()}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            a, b = [], []
            partners = np.zeros(len(rep), dtype=bool)
            for start in range(0, len(left), 128):
                at = left[start : start + 128]
                fit = component[at][:, None] != component[right][None]
                fit &= 100 * np.minimum(n[at][:, None], n[right][None]) >= least * np.maximum(n[at][:, None], n[right][None])
                agreeing = np.zeros(fit.shape, dtype=np.uint8)
                for t in tokens:
                    agreeing += t[at][:, None] == t[right][None]
                agreeing[~fit] = 0
                if give == "nearest":
                    j = agreeing.argmax(1)
                    i = np.flatnonzero(agreeing[np.arange(len(at)), j] >= least_agreeing)
                    a += rep[at[i]].tolist()
                    b += rep[right[j[i]]].tolist()
                    continue
                i, j = np.nonzero(agreeing >= least_agreeing)
                if give == "involved":
                    partners[at[i]] = partners[right[j]] = True
                    continue
                order = np.argsort(-agreeing[i, j].astype(np.int16), kind="stable")
                for x, y in zip(at[i[order]].tolist(), right[j[order]].tolist()):
                    cx, cy = root(int(component[x])), root(int(component[y]))
                    if cx != cy and similar(np.frombuffer(rows["shingles"][x], np.uint64), np.frombuffer(rows["shingles"][y], np.uint64), least):
                        parent[max(cx, cy)] = min(cx, cy)
                        a.append(int(rep[x]))
                        b.append(int(rep[y]))
            if give == "involved":
                b = np.unique(rep[partners]).tolist()
                a = [unit] * len(b)
            elif a:
                a, b = np.minimum(a, b), np.maximum(a, b)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def compare(batches):
            unit, held = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                units_ = batch.column("unit").to_numpy()
                columns = {k: batch.column(k).to_numpy() for k in ("side", "rep", "component", "n")}
                columns["sketch"] = batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH)
                if full:
                    columns["shingles"] = batch.column("shingles").to_pylist()
                edges = [0, *(np.flatnonzero(units_[1:] != units_[:-1]) + 1).tolist(), len(units_)]
                for x, y in zip(edges[:-1], edges[1:]):
                    if held and units_[x] != unit:
                        yield settle(unit, held)
                        held = []
                    unit = int(units_[x])
                    held.append({k: v[x:y] for k, v in columns.items()})
            if held:
                yield settle(unit, held)

        rows = units.join(self.reps.select("rep", "n", "sketch"), "rep")
        if sets is not None:
            rows = rows.join(sets, "rep")
        return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(compare), "a long, b long")

    def components(self) -> DataFrame:
        """row, doc_id, n_shingles, component_id, kept for each row of the documents."""
        found = connected_components(self.spark, self.links())
        ids = self.reps.select(F.col("rep").alias("node"))
        label = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        label = self.scratch.keep(self.groups.select(F.col("row").alias("node"), "set_key", "least", "n_rows").join(label, "node"))
        least = self.scratch.keep(label.groupBy("component").agg(F.min("least").alias("first")))
        label = self.scratch.keep(label.join(least.hint("merge"), "component").select("set_key", "first", "n_rows"))
        rows = self.signatures.select("row", "doc_id", "n_shingles", "set_key")
        links = "n_shingles > 0 AND doc_id IS NOT NULL"
        some = by_hot_and_cold(self.scratch.keep(rows.filter(links)), label, "set_key", "n_rows")
        alone = rows.filter(f"NOT ({links})").withColumn("first", F.struct("doc_id", "row"))
        out = some.drop("n_rows").unionByName(alone)
        return out.select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, least: int = 75) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept; one row for each row of ``docs``.

    A-Z are lower-cased; a text of fewer than ``width`` words is one shingle. Null,
    empty and blank texts have no shingles, link with nothing and stay. Rows
    with a null id stay and link with nothing. ``row`` is xxhash64(doc_id, text):
    of rows that repeat an id with other texts, one of a component is kept;
    rows that repeat both are one document. An empty table gives no rows.
    """
    return NearDuplicates(spark, docs, width, least).components()


def keep_one_of_each_component(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = near_duplicates(spark, docs).filter("kept").select(F.col("row").alias("_row")).distinct()
    whole = Whole(docs, doc_id="long", text="string")
    return whole.back(whole.rows.join(kept, F.xxhash64("doc_id", "text") == F.col("_row"), "left_semi"))
