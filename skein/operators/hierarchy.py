"""Parent-child links into full hierarchies (problem 3).

1. Every node learns which component of the forest it is in, by pointer
   doubling: each round a node's pointer skips to its pointer's pointer, so the
   number of rounds is the logarithm of the depth.
2. The nodes of a component are brought together - many small components to a
   bucket - and walked depth first, iteratively, with node colouring: white is
   unseen, grey is on the present way, black is done. A link into a grey node
   is a back edge and closes a cycle. The walk keeps some numbers a node and one
   way from the root; paths are made only where they are asked for, row by row.
3. A component too large for one task is never brought together: its states
   and depths come from the same pointer doubling, carried on with distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scale import bucket_of, buckets_for, checkpoint
from skein.session import ship_package

TREE = "id string, parent_id string, state string, cycle_id string, root_id string, entry_id string, depth int, ring_place int, ring_size int, missing_parent string"
WITH_PATH = TREE + ", path array<string>"

#: Nodes of one component that are still walked in one task: some 60 MB there, however deep the component is.
LARGEST_TOGETHER = 100_000
#: Nodes that share a bucket, of components not larger than that.
PER_BUCKET = 20_000
#: Ids of paths, and rows, that a walk holds before it hands them on.
HELD = 200_000
#: Parts that the nodes of one cycle are spread over where each meets the whole cycle.
SALTS = 16


def forest(rows: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, missing_parent): parent_id is null at the top, missing_parent what it named in vain."""
    n = rows.select("id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("_p"))
    ids = rows.select(F.col("id").alias("_p"), F.lit(True).alias("_there"))
    return n.join(ids, "_p", "left").select(
        "id",
        F.when(F.col("_there"), F.col("_p")).alias("parent_id"),
        F.when(F.col("_there").isNull(), F.col("_p")).alias("missing_parent"),
    )


def components(nodes: DataFrame) -> DataFrame:
    """(id, comp) of every node; comp is the root of its tree, or one node that all of its cyclic component agree on.

    Only inner nodes (those that are a parent) take part in the doubling;
    leaves take over the component of their parent at the end.
    """
    inner = nodes.join(nodes.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    # done: ptr is null and comp is known. low is the smallest id between a node and its pointer.
    state = checkpoint(
        inner.select(
            "id",
            F.col("parent_id").alias("up"),
            F.col("parent_id").alias("ptr"),
            F.col("id").alias("low"),
            F.when(F.col("parent_id").isNull(), F.col("id")).alias("comp"),
        )
    )
    active, settled = -1, False
    while not settled:
        step = state.select(
            F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"), F.col("comp").alias("_comp")
        )
        todo = state.where("ptr is not null").join(step, "ptr").select(
            "id", "up", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"), F.col("_comp").alias("comp")
        )
        state = checkpoint(state.where("ptr is null").unionByName(todo), state)
        open_ = state.where("ptr is not null")
        left = open_.count()
        if left == 0:
            break
        if left == active:
            # No way ends any more, so the open nodes are those of cyclic components. A label that is
            # the same along every link is the same in a whole component.
            label = open_.join(open_.select(F.col("id").alias("ptr"), F.col("low").alias("_label")), "ptr").select("id", "up", "_label")
            label = checkpoint(label)
            along = label.join(label.select(F.col("id").alias("up"), F.col("_label").alias("_next")), "up")
            settled = along.where("_label <> _next").limit(1).count() == 0
            if settled:
                state = state.where("ptr is null").select("id", "comp").unionByName(
                    label.select("id", F.col("_label").alias("comp"))
                )
        active = left
    known = state.select("id", "comp")
    leaves = nodes.join(known, "id", "left_anti")
    return known.unionByName(
        leaves.join(known.select(F.col("id").alias("parent_id"), "comp"), "parent_id", "left").select(
            "id", F.coalesce("comp", "id").alias("comp")
        )
    )


def _walk(batches: Iterator[pa.RecordBatch], paths: bool) -> Iterator[pa.RecordBatch]:
    """Depth-first walk over all components of one bucket; rows are handed on as they come."""
    table = pa.Table.from_batches(list(batches))
    ids, missing = table["id"].to_pylist(), table["missing_parent"].to_pylist()
    number = {x: n for n, x in enumerate(ids)}
    parent = [-1 if p is None else number[p] for p in table["parent_id"].to_pylist()]
    first, after = [-1] * len(ids), [-1] * len(ids)  # each node's first child and next sibling
    for n, p in enumerate(parent):
        if p >= 0:
            after[n], first[p] = first[p], n
    grey, black = 1, 2
    colour, ring = [0] * len(ids), {}  # node on a cycle -> (number of its smallest id, place, size); places go up the links
    for start in range(len(ids)):
        way, x = [], start
        while x >= 0 and not colour[x]:
            colour[x] = grey
            way.append(x)
            x = parent[x]
        if x >= 0 and colour[x] == grey:  # a back edge
            cycle = way[way.index(x) :]
            low = min(cycle, key=ids.__getitem__)
            at = cycle.index(low)
            ring.update((y, (low, i, len(cycle))) for i, y in enumerate(cycle[at:] + cycle[:at]))
        for y in way:
            colour[y] = black
    fields = [f.split()[0] for f in (WITH_PATH if paths else TREE).split(", ")]
    kinds = {"depth": pa.int32(), "ring_place": pa.int32(), "ring_size": pa.int32(), "path": pa.list_(pa.string())}
    out: list[tuple] = []
    held = 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f, pa.string())) for f, c in zip(fields, zip(*out))], names=fields)

    for top in range(len(ids)):
        if parent[top] >= 0 and top not in ring:
            continue
        low, place, size = ring.get(top, (None, None, None))
        way, todo = [], [(top, 0)]
        while todo:
            x, depth = todo.pop()
            del way[depth:]
            way.append(ids[x])
            up = ids[parent[x]] if parent[x] >= 0 else None
            here = (None, None) if low is None else ("on" if x == top else "below", ids[low])
            of_ring = (place, size) if x == top else (None, None)
            out.append((ids[x], up, *here, ids[top] if low is None else None, ids[top], depth, *of_ring, missing[x], *([way[:]] if paths else [])))
            held += 1 + paths * depth
            if held >= HELD:
                yield send()
                out, held = [], 0
            c = first[x]
            while c >= 0:
                if c not in ring:
                    todo.append((c, depth + 1))
                c = after[c]
    if out:
        yield send()


def _by_doubling(nodes: DataFrame) -> DataFrame:
    """What _walk gives without paths, by joins alone, for components of any size: every row keeps a pointer and numbers.

    Three rounds of doubling: as many steps up as there are nodes tell trees
    from cycles, since then a pointer is null or on a cycle; once round each
    cycle gives its smallest id; then everything climbs to a top or a cycle, and
    the members of a cycle to its smallest id, with the distance.
    """
    count = nodes.count()
    state = checkpoint(nodes.select("id", F.col("parent_id").alias("ptr")).where("ptr is not null"))
    covered = 1
    while covered <= count and state.limit(1).count():
        state = checkpoint(state.join(state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr")), "ptr").select("id", F.col("_ptr").alias("ptr")), state)
        covered *= 2
    on = checkpoint(state.select(F.col("ptr").alias("id")).distinct())
    ring = checkpoint(on.join(nodes, "id").select("id", F.col("parent_id").alias("ptr"), F.col("id").alias("low"), F.lit(1).cast("long").alias("n")))
    covered, members = 1, ring.count()
    while covered <= members:
        step = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
        ring, covered = checkpoint(ring.join(step, "ptr").select("id", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low")), ring), covered * 2
    sizes = ring.groupBy("low").agg(F.count(F.lit(1)).cast("int").alias("ring_size"))
    on = checkpoint(ring.select("id", F.col("low").alias("cycle_id")))

    def climbed(links: DataFrame) -> DataFrame:
        """(id, top, n) of links (id, ptr): where the pointers end, and after how many steps."""
        state = checkpoint(links.select("id", "ptr", F.coalesce("ptr", "id").alias("top"), F.when(F.col("ptr").isNull(), 0).otherwise(1).alias("n")))
        while state.where("ptr is not null").limit(1).count():
            step = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("top").alias("_top"), F.col("n").alias("_n"))
            todo = state.where("ptr is not null").join(step, "ptr").select("id", F.col("_ptr").alias("ptr"), F.col("_top").alias("top"), (F.col("n") + F.col("_n")).alias("n"))
            state = checkpoint(state.where("ptr is null").unionByName(todo), state)
        return state.select("id", "top", "n")

    marked = nodes.join(on.withColumn("_on", F.lit(True)), "id", "left")
    up = climbed(marked.select("id", F.when(F.col("_on").isNull(), F.col("parent_id")).alias("ptr")))
    round_ = on.join(nodes, "id").select("id", F.when(F.col("id") != F.col("cycle_id"), F.col("parent_id")).alias("ptr"), "cycle_id")
    # Steps from a member up to the smallest id; places go up the links and begin there.
    place = climbed(round_).join(sizes.withColumnRenamed("low", "top"), "top").select(
        "id", F.pmod(F.col("ring_size") - F.col("n"), F.col("ring_size")).cast("int").alias("ring_place"), "ring_size"
    )
    entry = on.select(F.col("id").alias("top"), F.col("cycle_id").alias("_cycle"))
    full = nodes.join(up, "id").join(entry, "top", "left").join(place, "id", "left")
    state_ = F.when(F.col("_cycle").isNotNull(), F.when(F.col("ring_size").isNotNull(), "on").otherwise("below"))
    return full.select(
        "id", "parent_id", state_.alias("state"), F.col("_cycle").alias("cycle_id"), F.when(F.col("_cycle").isNull(), F.col("top")).alias("root_id"),
        F.col("top").alias("entry_id"), F.col("n").cast("int").alias("depth"), "ring_place", "ring_size", "missing_parent",
    )


def _with_paths(tree: DataFrame) -> DataFrame:
    """tree with the path of each node, by doubling over the links below the entry; as long as the paths are."""
    state = checkpoint(tree.withColumns({"_ptr": F.when(F.col("depth") > 0, F.col("parent_id")), "path": F.array("id")}))
    while state.where("_ptr is not null").limit(1).count():
        step = state.select(F.col("id").alias("_ptr"), F.col("_ptr").alias("_next"), F.col("path").alias("_path"))
        todo = state.where("_ptr is not null").join(step, "_ptr").withColumn("path", F.concat("_path", "path")).drop("_ptr", "_path")
        state = checkpoint(state.where("_ptr is null").unionByName(todo.withColumnRenamed("_next", "_ptr")), state)
    return state.drop("_ptr")


def hierarchy(rows: DataFrame, paths: bool = True, largest_together: int = LARGEST_TOGETHER, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Depth, root, cycle and, if asked for, path of every node of (id, parent_id), one row per id.

    A null or empty parent_id means no parent, and a parent that isn't among
    the ids ends the way (it is given as missing_parent); a node can be its own
    parent. path leads from the root down to the node. Where the way up never
    ends, state is 'on' (the cycle) or 'below' it, cycle_id is the smallest id
    on the cycle, root_id is null, and path and depth begin at entry_id, the
    cycle's node where the way up enters it; of a tree that is the root. A node
    on a cycle has its place among the ring_size nodes, counted up the links
    from the smallest id. Ids must be unique and not null; an empty table gives
    no rows. Components of more than largest_together nodes are worked on by
    joins, with the same result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    nodes = checkpoint(forest(rows.select("id", "parent_id")))
    comp = checkpoint(components(nodes))
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
    giants = checkpoint(sizes.where(F.col("_size") > largest_together).select("comp"))
    labelled = nodes.join(comp, "id")
    n_giants = giants.count()
    if n_giants:
        huge = checkpoint(labelled.join(giants, "comp", "left_semi").drop("comp"))
        labelled = labelled.join(giants, "comp", "left_anti")
    buckets = buckets_for(comp.count(), per_bucket, spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, paths)

    bucketed = labelled.withColumn("_bucket", bucket_of(buckets, "comp")).drop("comp")
    walked = bucketed.groupBy("_bucket").applyInArrow(walk, WITH_PATH if paths else TREE)
    if not n_giants:
        return walked
    rest = checkpoint(_by_doubling(huge))
    return walked.unionByName(_with_paths(rest) if paths else rest)


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant_id, distance) for every node and each other node from which following the parents comes to it.

    tree has paths. Every member of a cycle has all other members below it, and
    all that is below the cycle; the distance is the number of links on the way
    up. The nodes below a hot cycle are spread over SALTS parts.
    """
    tree = checkpoint(tree)
    up = tree.where("depth > 0").select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("pos", "id"))
    straight = up.where(F.col("pos") < F.col("depth")).select("id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))
    ring = tree.where("state = 'on'").select("cycle_id", "id", "ring_place", "ring_size")
    enters = ring.select(F.col("id").alias("entry_id"), F.col("ring_place").alias("_from"))
    lost = tree.where("state is not null").select(F.col("id").alias("descendant_id"), "cycle_id", "entry_id", "depth").join(enters, "entry_id")
    lost = lost.withColumn("_salt", F.pmod(F.xxhash64("descendant_id"), F.lit(SALTS)).cast("int"))
    spread = ring.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    round_ = F.pmod(F.col("ring_place") - F.col("_from"), F.col("ring_size"))
    around = lost.join(spread, ["cycle_id", "_salt"]).where("id <> entry_id").select("id", "descendant_id", (F.col("depth") + round_).alias("distance"))
    return straight.unionByName(around)


def endless(tree: DataFrame) -> DataFrame:
    """The nodes whose way up never ends: id, state, cycle_id."""
    return tree.where(F.col("state").isNotNull()).select("id", "state", "cycle_id")
