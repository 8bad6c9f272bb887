"""Near-duplicate groups from bottom-k sketches of one hash function, with exact verification.

1. Each text's set of distinct word shingles is hashed once; the ``K`` smallest values are its sketch. Texts of
   equal sets form one class (a 128-bit sum over the set), so exact copies are one row from here on.
2. Inverted lists: every three neighbouring values among the smallest (``window`` of them) are a key. Two sets whose
   smallest values are mostly shared have such a run in common; a passage shared by otherwise different texts rarely
   makes one. Sets of up to ``window * 100 / percent`` shingles are also keyed by each value of their prefix, of which two
   sets that are near share one for certain. Lists with the same members are kept once.
3. In each list the union-sketch estimate filters: a member near a pivot joins its clump; members very near leave
   the pool, all others stay as pivots or members for later ones. Clumps give spanning edges, never all pairs. A
   list is worked on in parts of about ``LIST_PART`` members; the pivots of its parts are its members on the next
   level, where a lower estimate joins them, until one part holds them. Pivots that a level does not thin out
   to half are left to step 4, all in one block.
4. Components of those edges are blocks. The full sets of a block's classes meet in one task, if they are few and small.
   A larger block is dealt to parts: links inside parts come first, then links among some members of every
   component of every part; only classes that then are not in the block's largest component are held against the
   other parts, pair by pair of parts. Exact counts of common shingles link sets with
   100 * intersection >= percent * union. Tasks return spanning edges only and skip pairs that are joined already.
5. Components of the exact links give every document the smallest document id it reaches.

So a family of copies that are all joined costs time in proportion to its size, whatever that is; only members that are
in a block but not joined to its main component are compared with all of its parts.

A pair whose smaller set has at most ``window`` shingles always shares a key. A pair of larger sets shares none with
chance 6.5e-7 at similarity 0.85 and 4.3e-8 at 0.8 (``window`` neighbouring values of the union, 32 from 0.85 on and
48 below, each shared with that chance, without three in a row); more similar pairs are missed less. The estimate's
standard error is 0.06 or less, a fifth of what separates near pairs from ``LOOSE``.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; equal sets are linked; repeated rows each get their row; a row with a null id
gets a null component if it stands alone, and else that of its class. Columns named like the output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.llm.bytestok import BLANK_SPLIT, blocks, mix, shingles, words
from quadra.llm.documents import table
from quadra.llm.graph import components
from quadra.llm.store import Workspace, small_batches

K = 64
#: Members of a list that one part of it holds.
LIST_PART = 500
#: Estimated similarity from which a member joins a pivot's clump (of pivots of different parts, a lower one), and
#: from which it leaves the pool.
LOOSE, LOOSE_PARTS, CORE = 0.45, 0.3, 0.85
#: Classes and bytes of sets that one task verifies; larger blocks are cut in parts of about half that.
BLOCK_CLASSES, BLOCK_BYTES = 2000, 24_000_000
#: Classes of each part of a large block that meet those of the other parts first.
DELEGATES = 16
_BITMAP = 23

SKETCH = "doc_id long, n_shingles long, a long, b long, sketch array<long>"


def sketches(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: set size, 128-bit set identity (a, b) and the sketch (ascending as unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                got = words(data, offsets, BLANK_SPLIT)
                n, a, b, s = [], [], [], []
                for k in range(j - i):
                    x = shingles(got.of(k), width)
                    n.append(len(x))
                    with np.errstate(over="ignore"):
                        a.append(mix(x + np.uint64(0x1234567)).sum(dtype=np.uint64))
                        b.append(mix(x ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    s.append(x[:K].astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).astype(np.int64)), pa.array(np.array(b, np.uint64).astype(np.int64)), pa.array(s, pa.list_(pa.int64()))], names=[x.split()[0] for x in SKETCH.split(", ")])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, SKETCH)


def estimates(p: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Union-sketch similarity of sketch ``p`` with each row of ``rows`` (padded with the largest value)."""
    at = np.searchsorted(p, rows)
    inside = np.arange(rows.shape[1]) < sizes[:, None]
    shared = inside & (p[np.minimum(at, len(p) - 1)] == rows)
    before = np.cumsum(shared, axis=1) - shared
    rank = np.arange(rows.shape[1]) + at - before
    union = np.minimum(K, sizes + len(p) - shared.sum(1))
    return (shared & (rank < K)).sum(1) / np.maximum(1, union)


def window(percent: int) -> int:
    """Smallest values of a sketch whose runs are keys."""
    return 32 if percent >= 85 else 48


def clumps(nodes: np.ndarray, sketch: list[np.ndarray], size: np.ndarray, loose: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that join one list's clumps (a spanning forest, so fewer edges than members), and its pivots.

    Every member of a clump gets an edge to the clump's least node: lists that hold mostly the same members then give
    mostly the same edges, whatever their pivots are.
    """
    m = len(nodes)
    lengths = np.array([len(s) for s in sketch])
    rows = np.full((m, K), np.uint64(2**64 - 1), np.uint64)
    for i, s in enumerate(sketch):
        rows[i, : len(s)] = s
    pivots = []
    group = np.arange(m)  # clump of each member
    pool = np.argsort(size, kind="stable")
    while len(pool):
        p, rest = pool[0], pool[1:]
        pivots.append(int(p))
        # the pool ascends by size, and a set this much larger cannot be near the pivot
        rest_near = rest[: np.searchsorted(size[rest], size[p] / loose, side="right")]
        if not len(rest_near):
            pool = rest
            continue
        e = estimates(rows[p, : lengths[p]], rows[rest_near], lengths[rest_near])
        near = rest_near[e >= loose]
        apart = near[group[near] != group[p]]
        group[np.isin(group, group[apart])] = group[p]
        pool = np.concatenate([rest_near[e < CORE], rest[len(rest_near) :]])
    _, clump = np.unique(group, return_inverse=True)
    low = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(low, clump, nodes)
    hub = low[clump]
    return [(int(x), int(y)) for x, y in zip(nodes, hub, strict=True) if x != y], pivots


MEMBER = "key long, node long, n_shingles long, sketch array<long>"


def _list_edges(members: DataFrame, space: Workspace) -> DataFrame:
    """Edges (u, v) of all lists (rows of ``MEMBER``), level by level."""
    parts, level = [], 0
    names = [x.split()[0] for x in MEMBER.split(", ")]
    members = space.keep(members.select(names), "members")
    sizes = space.keep(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")

    def worked(loose: float):
        def run(t: pa.Table) -> pa.Table:
            nodes, size, sketch = t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), t.column("sketch")
            e, pivots = clumps(nodes, [np.array(s, np.int64).astype(np.uint64) for s in sketch.to_numpy()], size, loose)
            edges = pa.table({"u": pa.array([x for x, _ in e], pa.int64()), "v": pa.array([y for _, y in e], pa.int64())})
            # the pivots of a list of one part have nobody to meet
            kept = t.select(names).take(pa.array(pivots if t.column("parts")[0].as_py() > 1 else [], pa.int64()))
            return pa.concat_tables([edges, kept], promote_options="default").select(["u", "v", *names])

        return run

    while True:
        # a power of two, so that lists of like sizes deal the members they share to like parts
        n = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("m") / LIST_PART, F.lit(1.0))))).cast("long")
        dealt = members.join(sizes.hint("merge"), "key").withColumn("parts", n)
        # one column names a part, else parts would stay together where their key was joined
        dealt = dealt.withColumn("part", F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(level)), F.col("parts"))))
        out = space.keep(dealt.groupBy("part").applyInArrow(worked(LOOSE if level == 0 else LOOSE_PARTS), f"u long, v long, {MEMBER}"), "edges")
        parts.append(out.where("u is not null").select("u", "v"))
        pivots = out.where("u is null").select(names)
        now = pivots.groupBy("key").agg(F.count(F.lit(1)).alias("p"), F.min("node").alias("low"))
        now = space.keep(now.join(sizes.hint("merge"), "key"), "pivots")
        # lists whose pivots are over half of their members go on as one block
        left = now.where(2 * F.col("p") > F.col("m")).select(F.col("key").alias("k"), "low")
        parts.append(pivots.join(left.hint("merge"), F.col("key") == F.col("k")).select(F.col("low").alias("u"), F.col("node").alias("v")))
        sizes = now.where(2 * F.col("p") <= F.col("m")).select("key", F.col("p").alias("m"))
        if sizes.isEmpty():
            break
        members, level = pivots, level + 1
    edges = parts[0]
    for x in parts[1:]:
        edges = edges.unionByName(x)
    return edges.where("u <> v")


def exact_links(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among sets (between ``left`` and the others, if given).

    Sets of one component (``known``: its number, by set) are not held against each other.
    """
    m = len(nodes)
    n = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(m), n)
    often = counts[inverse] > 1
    inverse, doc = inverse[often], doc[often]
    starts = np.searchsorted(doc, np.arange(m + 1))
    kept = np.diff(starts)
    by_value = np.argsort(inverse, kind="stable")
    post = doc[by_value]
    first = np.searchsorted(inverse[by_value], np.arange(len(values) + 1))
    mine = np.zeros(len(values), bool)
    group = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    out = []

    def spread(at: np.ndarray, spans: np.ndarray) -> np.ndarray:
        return np.repeat(at - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())

    for x in np.argsort(n, kind="stable").tolist():
        if left is not None and not left[x] or not kept[x]:
            continue
        near = (group != group[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if left is not None:
            near &= ~left
        others = np.flatnonzero(near)
        if not len(others):
            continue
        values_of = inverse[starts[x] : starts[x + 1]]
        spans = first[values_of + 1] - first[values_of]
        if kept[others].sum() < spans.sum():
            # few others: their values are looked up among those of x
            mine[values_of] = True
            hit = mine[inverse[spread(starts[others], kept[others])]]
            mine[values_of] = False
            common = np.bincount(np.repeat(np.arange(len(others)), kept[others])[hit], minlength=len(others))
        else:
            common = np.bincount(post[spread(first[values_of], spans)], minlength=m)[others]
        linked = others[(100 * common >= percent * (n[others] + n[x] - common)) & (common > 0)]
        for y in linked.tolist():
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                out.append((int(nodes[x]), int(nodes[y])))
    return out


def _full_sets(docs: DataFrame, chosen: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """The chosen classes (rep, node and more) with their sets, from their representatives' texts.

    A bitmap of hashed ids, of fixed size, lets most other texts be skipped; the join is exact. It is dealt by node
    only, so a class that comes from repeated rows is thinned out where it is joined.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << _BITMAP))
    bits = chosen.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    bitmap = np.zeros(1 << (_BITMAP - 6), np.int64)
    for row in bits.toLocalIterator():  # at most 2**17 rows, whatever the corpus
        bitmap[row["w"]] = row["bits"]
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero((bitmap[p >> 6] >> (p & 63)) & 1)
            if not len(wanted):
                continue
            part = batch.take(pa.array(wanted))
            for i, j, data, offsets in blocks(part.column(1)):
                got = words(data, offsets, BLANK_SPLIT)
                a, s = [], []
                for k in range(j - i):
                    x = shingles(got.of(k), width)
                    a.append(mix(x + np.uint64(0x1234567)).sum(dtype=np.uint64))
                    s.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(np.array(a, np.uint64).astype(np.int64)), pa.array(s, pa.binary())], names=["doc_id", "a", "set"])

    sets = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text)).select("*", place).mapInArrow(run, "doc_id long, a long, set binary")
    same_doc = F.array_contains(F.array("rep"), F.col("doc_id"))
    return sets.join(chosen.hint("merge"), (F.col("a") == F.col("node")) & same_doc).drop("doc_id", "a", "rep").dropDuplicates(["node"])


def _links(dealt: DataFrame, by: list[str], percent: int, delegates: int = 0) -> DataFrame:
    """Spanning edges (u, v) within groups of ``dealt`` (node, set, left, known) by the columns ``by``.

    With ``delegates`` also rows (root, node, set): of each of so many largest components of a group one member.
    """

    def run(t: pa.Table) -> pa.Table:
        sides = t.column("left").to_pylist()
        left = None if sides[0] is None else np.array(sides, bool)
        known = None if t.column("known").null_count else t.column("known").to_numpy()
        nodes, sets = t.column("node").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")]
        e = exact_links(nodes, sets, left, percent, known)
        edges = pa.table({"u": pa.array([a for a, _ in e], pa.int64()), "v": pa.array([b for _, b in e], pa.int64())})
        if not delegates:
            return edges
        if not t.column("large")[0].as_py():
            return pa.concat_tables([edges, t.select(["root", "node", "set"]).slice(0, 0)], promote_options="default")
        at = {int(x): i for i, x in enumerate(nodes)}
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in e:
            parent[root(at[a])] = root(at[b])
        roots = np.array([root(x) for x in range(len(nodes))])
        found, sizes = np.unique(roots, return_counts=True)
        sent = found[np.argsort(-sizes, kind="stable")[:delegates]]
        return pa.concat_tables([edges, t.select(["root", "node", "set"]).take(pa.array(sent))], promote_options="default")

    # one column names a group, else groups would stay together where a part of their name was joined
    schema = "u long, v long" + (", root long, node long, set binary" if delegates else "")
    return dealt.withColumn("_group", F.xxhash64(*by)).groupBy("_group").applyInArrow(run, schema)


def _verified(docs: DataFrame, chosen: DataFrame, width: int, percent: int, space: Workspace, text: str, key: str) -> DataFrame:
    """Spanning edges of exact links in every block. ``chosen``: (node, rep, n_shingles, root)."""
    nothing = {"left": F.lit(None).cast("boolean"), "known": F.lit(None).cast("long")}
    sizes = chosen.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum(8 * F.col("n_shingles")).alias("bytes")).where("m > 1")
    large = (F.col("m") > BLOCK_CLASSES) | (F.col("bytes") > BLOCK_BYTES)
    # written, as Spark splits a hot key of a join only where both sides are plain shuffles
    sizes = space.keep(sizes.select(F.col("root").alias("r"), large.alias("large")), "sizes")
    # sets more than one size step apart are no pairs; each step of a large block is dealt to parts
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    placed = chosen.join(sizes.hint("merge"), F.col("root") == F.col("r")).drop("r").withColumn("s", F.when(F.col("large"), step).otherwise(0))
    placed = space.keep(placed, "placed")
    n_parts = F.ceil(F.greatest(F.count(F.lit(1)) / (BLOCK_CLASSES / 2), F.sum(8 * F.col("n_shingles")) / (BLOCK_BYTES / 2))).cast("int")
    parts = space.keep(placed.groupBy("root", "s").agg(F.when(F.max("large"), n_parts).otherwise(1).alias("c")), "parts")
    named = parts.select(F.col("root").alias("r"), F.col("s").alias("t"), "c")
    placed = placed.join(named.hint("merge"), (F.col("root") == F.col("r")) & (F.col("s") == F.col("t"))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).drop("r", "t", "c")
    placed = space.keep(placed, "placed")
    sets = space.keep(_full_sets(docs, placed, width, text, key), "sets")
    inside = space.keep(_links(sets.withColumns(nothing), ["root", "s", "i"], percent, DELEGATES), "inside")
    links = inside.where("u is not null").select("u", "v")
    big = placed.where("large").select("root", "s", "i", "node")
    if big.isEmpty():
        return links
    # delegates of the parts meet in groups whose number grows with theirs, twice, dealt differently
    delegates = inside.where("u is null").select("root", "node", "set")
    many = space.keep(delegates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("c")).withColumnRenamed("root", "r"), "many")
    for turn in range(2):
        met = delegates.join(many.hint("merge"), F.col("root") == F.col("r")).withColumn("g", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("c")))
        links = links.unionByName(space.keep(_links(met.withColumns(nothing), ["root", "g"], percent), "met"))
    of = components(links, space).select(F.col("node").alias("n"), F.col("root").alias("known"))
    named = big.join(of.hint("merge"), F.col("node") == F.col("n"), "left").drop("n").withColumn("known", F.coalesce("known", "node"))
    named = space.keep(named, "named")
    # what is outside the block's largest component is held against all parts of its own and the neighbouring steps
    main = named.groupBy("root", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "known")).alias("x"))
    main = space.keep(main.select(F.col("root").alias("r"), F.col("x.known").alias("main")), "main")
    loose = named.join(main.hint("merge"), F.col("root") == F.col("r")).where("known <> main").drop("r", "main")
    loose = space.keep(loose, "loose")
    if loose.isEmpty():
        return links
    counted = loose.join(chosen.select(F.col("node").alias("n"), "n_shingles").hint("merge"), F.col("node") == F.col("n")).drop("n")
    packs = space.keep(counted.groupBy("root", "s").agg(n_parts.alias("k")).select(F.col("root").alias("r"), F.col("s").alias("t"), "k"), "packs")
    places = parts.select(F.col("root").alias("r"), F.col("s").alias("t"), "c")
    near = F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    on = lambda s: (F.col("root") == F.col("r")) & (F.col(s) == F.col("t"))
    # a task is (part t2, j) of a block with pack (s2, p) of its loose sets: these are left, the part's are right
    go = loose.select("root", F.col("s").alias("s2"), "node", "known").join(packs.hint("merge"), on("s2")).drop("r", "t").withColumn("p", F.pmod(F.xxhash64("node", F.lit(9)), F.col("k")).cast("int"))
    go = go.select("root", "s2", "p", F.explode(F.array(F.col("s2") - 1, F.col("s2"), F.col("s2") + 1)).alias("t2"), "node", "known")
    go = go.join(places.hint("merge"), on("t2")).select("root", "t2", upto(F.col("c")).alias("j"), "s2", "p", "node", F.lit(True).alias("left"), "known")
    meet = named.select("root", F.col("s").alias("t2"), F.col("i").alias("j"), "node", "known", near.alias("s2"))
    meet = meet.join(packs.hint("merge"), on("s2")).select("root", "t2", "j", "s2", upto(F.col("k")).alias("p"), "node", F.lit(False).alias("left"), "known")
    dealt = go.unionByName(meet).join(sets.where("large").select(F.col("node").alias("n"), "set").hint("merge"), F.col("node") == F.col("n")).drop("n")
    return links.unionByName(space.keep(_links(dealt, ["root", "t2", "j", "s2", "p"], percent), "rest"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "near")
    rows = space.keep(sketches(docs, width, text, key), "sketches")
    classes = space.keep(rows.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).withColumnRenamed("a", "node"), "classes")
    rows = space.keep(rows.drop("sketch"), "rows")
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size("sketch"), F.lit(window(percent))) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("sketch", i + 1, 3)))
    # of n values at least percent are shared, so the first n - ceil(n * percent / 100) + 1 hold one of them
    n = F.col("n_shingles").cast("int")
    prefix = F.transform(F.slice("sketch", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1), lambda x: F.xxhash64(F.lit("prefix"), x))
    held = F.when(n * percent <= window(percent) * 100, F.concat(run, prefix)).otherwise(run)
    keys = space.keep(classes.where("rep is not null").select("node", F.explode(F.array_distinct(held)).alias("key")), "keys")
    lists = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low")).where("m > 1")
    lists = space.keep(lists.groupBy("m", "x", "low").agg(F.min("key").alias("key")), "lists")
    # merge joins at every size: no side has a bound, and Spark splits hot keys
    members = keys.join(lists.select("key").hint("merge"), "key")
    members = members.join(classes.select("node", "n_shingles", "sketch").hint("merge"), "node")
    near = space.keep(_list_edges(members, space), "near")
    space.drop(keys, lists)
    block = components(near, space)
    chosen = space.keep(block.join(classes.select("node", "rep", "n_shingles").hint("merge"), "node").select("node", "rep", "n_shingles", "root"), "chosen")
    links = space.keep(_verified(docs, chosen, width, percent, space, text, key), "links")
    roots = components(links, space)
    found = classes.select("node", "b", "rep").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = space.keep(found, "found")
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = space.keep(found.join(least.hint("merge"), "root").select(F.col("node").alias("a"), "b", "component_id"), "components")
    out = rows.join(of.hint("merge"), ["a", "b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group: rows whose id is their component's; columns as they came, repeated rows once."""
    found = groups(docs, width, percent, text, key).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    known = docs.where(F.col(key).isNotNull())
    named = known.join(found, known[key] == found["_kept_id"], "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(F.col(key).isNull()))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


QUERY = ("op6_minhash", op6_minhash)
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT s.* FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM often x JOIN often y ON x.k = y.k AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.c)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m LEFT JOIN n USING (doc_id)
"""
