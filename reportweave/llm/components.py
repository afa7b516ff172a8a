"""Connected components of a graph given as links, without any vertex's neighbours in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import stored
from reportweave.session import let_go, remove, written


LINKS_OF_A_TASK = 50_000


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``a``, ``b``); root is the smallest node reachable.

    Rounds of two steps on links (larger, smaller): each node and its neighbours are
    linked to the smallest of them, first for larger neighbours, then for smaller ones.
    Paths shorten by half or more in a round, and the links of a node that has many are
    never gathered: its minimum is a partial aggregate, and the join back is a plain one
    that adaptive execution can split.  Rounds end when a round changes nothing.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(ordered.distinct())
    state = _state(edges)
    while state[0]:
        # Few links need few tasks and files in each of the steps; a round makes no more than twice as many.
        tasks = state[0] // LINKS_OF_A_TASK + 1
        # Larger neighbours: every neighbour above u is linked to the smallest around u (u included).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(smallest, F.col("u") == F.col("k")).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        grown = stored(large.distinct().coalesce(tasks))
        # Smaller neighbours: u and all of them are linked to the smallest.
        least = grown.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = grown.join(least, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")
        )
        edges = stored(small.select("e.*").where("u <> v").distinct().coalesce(tasks))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stored(roots.union(own.join(roots, "node", "left_anti")))


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links, to see whether a round has changed them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


# Nodes of a key up to which all pairs across its components are compared.
FEW = 16


def linked_through_keys(
    members: DataFrame,
    accept: int | Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame],
    crowd: Callable[[DataFrame], tuple[DataFrame, Callable[[Column, Column], Column]]] | None = None,
    few: int = FEW,
    sketches: DataFrame | None = None,
    near: Callable[[Column, Column], Column] | None = None,
    passes: int = 1,
    read: Callable[[], None] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``(node, root)`` of all nodes that are linked: components under links between nodes of a shared key.

    ``members`` has ``key``, ``node`` and ``mark``.  Two nodes of a key are a candidate if
    their marks differ in ``accept`` bits or fewer, or if ``accept`` holds for them; ``verify`` takes candidates ``(a, b)``, a < b,
    and returns those that are links.  Every candidate counts, but few are looked at whose ends
    are known to be connected: first, all nodes of a key are compared with its smallest
    one, so that large groups of similar nodes become components without their pairs; then, in keys
    that still hold several components, pairs across these.  In keys of more than ``few`` nodes, ``crowd`` may find
    these pairs: it takes the nodes and returns members by narrower keys that lose no link between them,
    and their condition; such nodes are first compared with one that is central to them.  Without it, another comparison with one node chosen by hash comes before all pairs across.

    With ``sketches`` (``node``, ``sketch``), which go with ``crowd``, candidates are those for whose sketches ``near`` holds as
    well.  It has to hold for all links.  Sketches are too wide for every member, so only nodes of keys that hold several components
    get theirs, before pairs across are made.

    Members are shuffled in ``passes`` parts of the keys, one after the other, so that no more than a part is on disk.
    ``read`` is called when they are not needed any more.  With ``folder``, members of shared keys are kept there as Parquet
    files, which are smaller than checkpoints, and removed as soon as they are not needed.
    """

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return stored(rows) if folder is None else written(rows, f"{folder}/{name}")

    def over(*names: str) -> None:
        for name in names if folder is not None else ():
            remove(members.sparkSession, f"{folder}/{name}")

    def alike(a: Column, b: Column) -> Column:
        return accept(a, b) if callable(accept) else F.bit_count(a.bitwiseXOR(b)) <= accept

    def pairs(rows: DataFrame, rep: str) -> DataFrame:
        return rows.select(F.least("node", rep).alias("a"), F.greatest("node", rep).alias("b")).distinct()

    def sketched(rows: DataFrame, node: str, sketch: str = "sketch") -> DataFrame:
        """``rows`` with the sketch of the node in the column ``node``."""
        of_node = sketches.select(F.col("node").alias(f"of_{sketch}"), F.col("sketch").alias(sketch))
        return rows.join(of_node, F.col(node) == F.col(f"of_{sketch}")).drop(f"of_{sketch}")

    def plausible(candidates: DataFrame) -> DataFrame:
        if sketches is None:
            return candidates
        both = sketched(sketched(candidates, "a", "sketch_a"), "b", "sketch_b")
        return both.where(near(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")

    def across(rows: DataFrame, condition: Callable[[Column, Column], Column]) -> DataFrame:
        a, b = rows.alias("left"), rows.alias("right")
        alike_marks = condition(F.col("left.mark"), F.col("right.mark"))
        if sketches is not None:
            alike_marks &= near(F.col("left.sketch"), F.col("right.sketch"))
        met = a.join(b, (F.col("left.key") == F.col("right.key")) & (F.col("left.node") < F.col("right.node"))
                     & (F.col("left.part") != F.col("right.part")) & alike_marks)
        return met.select(F.col("left.node").alias("a"), F.col("right.node").alias("b")).distinct()

    def parted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of the keys that hold several components, with their component."""
        of_node = roots.withColumnRenamed("node", "of_node")
        named = kept(rows.join(of_node, F.col("node") == F.col("of_node"), "left").select(
            "key", "node", "mark", "n", F.coalesce("root", "node").alias("part")
        ), "named")
        let_go(members.sparkSession)
        several = named.groupBy(F.col("key").alias("of_key")).agg(F.min("part").alias("low"), F.max("part").alias("high"))
        return kept(named.join(several.where("low <> high"), F.col("key") == F.col("of_key"), "left_semi"), "rest")

    def central(rows: DataFrame) -> DataFrame:
        """Each node with that of the nodes it shares keys with that is in the fullest keys."""
        scores = rows.groupBy(F.col("node").alias("of_node")).agg(F.sum("n").alias("score"))
        scored = rows.select("key", "node", "mark").join(scores, F.col("node") == F.col("of_node"))
        best = scored.groupBy(F.col("key").alias("of_key")).agg(F.max(F.struct("score", "node", "mark")).alias("r"))
        met = scored.join(best, F.col("key") == F.col("of_key")).where(
            (F.col("node") != F.col("r.node")) & alike(F.col("mark"), F.col("r.mark")))
        return met.groupBy("node").agg(F.max("r").alias("r")).select("node", F.col("r.node").alias("rep"))

    star = (F.col("node") != F.col("rep")) & alike(F.col("mark"), F.col("rep_mark"))

    def of_shared_keys(rows: DataFrame, name: str) -> DataFrame:
        # Without a number of partitions, small ones are put together, so that each step below has tasks by the size of the keys.
        dealt = rows.repartition("key")
        least = dealt.groupBy(F.col("key").alias("of_key")).agg(
            F.min("node").alias("rep"), F.max("node").alias("top"), F.min_by("mark", "node").alias("rep_mark"),
            F.count(F.lit(1)).alias("n"),
        ).where("rep <> top").drop("top")
        # A key of two has no other pair than that with its smallest node.
        return kept(dealt.join(least, (F.col("key") == F.col("of_key")) & (star | (F.col("n") > 2))).drop("of_key"), name)

    def part(rows: DataFrame, i: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i) if passes > 1 else rows

    shared = None
    for i in range(passes):
        some = of_shared_keys(part(members, i), f"shared-{i}")
        let_go(members.sparkSession)
        shared = some if shared is None else shared.union(some)
    if read is not None:
        read()
    if crowd is None:
        compared = pairs(shared.where(star), "rep")
    else:
        # In a crowd, keys have many smallest nodes; each node is compared with the most central one it meets.
        compared = pairs(shared.where(star & (F.col("n") <= few)), "rep").union(
            pairs(central(shared.where(F.col("n") > few)), "rep")).distinct()
    found = stored(verify(plausible(compared)))
    let_go(members.sparkSession)
    crowded = shared.where("n > 2").select("key", "node", "mark", "n")
    roots = connected_components(found)
    rest = parted(crowded, roots)
    # What is not needed any more lets its files go.
    del shared, some, compared, crowded
    over("named", *(f"shared-{i}" for i in range(passes)))
    let_go(members.sparkSession)
    if crowd is None:
        chosen = rest.where(F.col("n") > few).groupBy(F.col("key").alias("of_key")).agg(
            F.min_by(F.struct("node", "mark", "part"), F.xxhash64("node")).alias("r")
        ).select("of_key", F.col("r.node").alias("rep"), F.col("r.mark").alias("rep_mark"), F.col("r.part").alias("rep_part"))
        second = rest.join(chosen, (F.col("key") == F.col("of_key")) & (F.col("part") != F.col("rep_part"))
                           & alike(F.col("mark"), F.col("rep_mark")))
        more = stored(verify(pairs(second, "rep")))
        if not more.isEmpty():
            found = stored(found.union(more))
            rest = parted(rest.drop("part"), connected_components(found))
        more = verify(across(rest, alike))
    else:
        little = rest.where(F.col("n") <= few)
        many = rest.where(F.col("n") > few).select("node", "part").distinct()
        narrow, condition = crowd(many.select("node"))
        if sketches is not None:
            many = sketched(many, "node")
        of_node = many.withColumnRenamed("node", "of_node")
        # Narrow keys are made once; most are of one node, which needs no sketch.
        narrow = kept(narrow, "narrow")
        candidates = None
        for i in range(passes):
            some = part(little, i)
            met = across(some if sketches is None else sketched(some, "node"), alike)
            narrower = part(narrow, i).repartition("key").dropDuplicates(["key", "node"])
            several = narrower.groupBy(F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
            again = narrower.join(several, F.col("key") == F.col("of_key"), "left_semi")
            named = again.join(of_node, F.col("node") == F.col("of_node")).drop("of_node")
            if passes > 1:
                met = kept(met, f"met-{i}")
                let_go(members.sparkSession)
            met = met.union(across(named, condition))
            if passes > 1:
                met = kept(met, f"met-both-{i}")
                let_go(members.sparkSession)
            candidates = met if candidates is None else candidates.union(met)
        more = verify(candidates.distinct())
    more = stored(more)
    over("rest", "narrow", *(f"{name}-{i}" for name in ("met", "met-both") for i in range(passes)))
    let_go(members.sparkSession)
    return roots if crowd is not None and more.isEmpty() else connected_components(found.union(more))
