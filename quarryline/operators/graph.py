"""Graph and dependency operators as bounded joins; loops cut their lineage by checkpoints, never gather the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.common import cut

DECAY = 0.7


def cascade(edges: DataFrame, members: DataFrame, seeds: DataFrame, depth: int, tag_weight: float = 0.8) -> DataFrame:
    """Scores of nodes reached from seeds: best of score x edge weight x 0.7^(step) over paths of up to `depth` steps.

    edges: src, dst, weight. members: node, tag; going to a tag and back to its members is one step. seeds: node, score.
    A tag passes on only the best score it got, so a tag on a third of all nodes costs one row per member, not a pair of
    members each.
    """
    reached = seeds.groupBy("node").agg(F.max("score").alias("score")).withColumn("fresh", F.lit(True))
    for step in range(depth):
        decay = DECAY ** (step + 1)
        front = reached.where("fresh").select("node", "score")
        direct = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("score") * F.col("weight") * decay).alias("score"))
        tags = front.join(members, "node").groupBy("tag").agg(F.max("score").alias("score"))
        shared = tags.join(members, "tag").select("node", (F.col("score") * tag_weight * decay).alias("score"))
        found = direct.unionByName(shared).withColumn("old", F.lit(False)).unionByName(reached.select("node", "score", F.lit(True).alias("old")))
        best = found.groupBy("node").agg(F.max("score").alias("score"), F.max(F.when(F.col("old"), F.col("score"))).alias("had"))
        # A node is expanded once, when first reached.
        reached = cut(best.select("node", "score", F.col("had").isNull().alias("fresh")))
    return reached.select("node", "score")


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def contradictions(edges: DataFrame) -> DataFrame:
    """Pairs linked in both directions, each once."""
    a, b = edges.select("src", "dst").distinct(), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return a.join(b, ["src", "dst"], "left_semi").where("src < dst")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code, src, dst of dangling ends (E01 source, E02 target), self links (E10) and weights outside [0, 1] (E32)."""
    known = nodes.select("node").distinct()
    row = lambda df, code: df.select(F.lit(code).alias("code"), "src", "dst")
    return (
        row(edges.join(known, edges["src"] == known["node"], "left_anti"), "E01")
        .unionByName(row(edges.join(known, edges["dst"] == known["node"], "left_anti"), "E02"))
        .unionByName(row(edges.where("src = dst"), "E10"))
        .unionByName(row(edges.where("weight < 0 OR weight > 1"), "E32"))
    )


def stuck_in_cycles(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Items in a cycle or downstream of one: what is left when free items are removed until none is free.

    needs: id, dep. Dependencies on unknown items count as met. Each round removes a layer, and a dependency on an item
    with a single one of its own moves on to that one (pointer doubling): a chain of n takes log n rounds.
    """
    left = cut(needs.select("id", "dep").distinct().join(items.select(F.col("id").alias("dep")).distinct(), "dep", "left_semi"))
    before = left.count()
    while True:
        blocked = left.select(F.col("id").alias("dep")).distinct()
        left = cut(left.join(blocked, "dep", "left_semi"))
        if left.count() in (0, before):
            return left.select("id").distinct()
        single = left.groupBy("id").agg(F.count("*").alias("n"), F.min("dep").alias("next")).where("n = 1").select(F.col("id").alias("dep"), "next")
        left = cut(left.join(single, "dep", "left").select("id", F.coalesce("next", "dep").alias("dep")).distinct())
        before = left.count()


def longest_paths(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Longest chain of dependencies below each item; a cycle raises.

    Dependencies on unknown items count as met. An edge to a settled item becomes a least depth (`base`); one to an item
    with a single open dependency moves on to that one, with its length: a chain of n takes log n rounds.
    """
    own = needs.select("id", "dep").distinct().join(items.select(F.col("id").alias("dep")).distinct(), "dep", "left_semi")
    edges = cut(own.select("id", "dep", F.lit(1).alias("length")))
    level = cut(items.select("id").unionByName(edges.select("id")).distinct().withColumn("base", F.lit(0)))
    before = edges.count()
    while before:
        per = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("dep").alias("next"), F.max("length").alias("more"))
        state = level.join(per, "id", "left").select(F.col("id").alias("dep"), F.col("base").alias("base2"), F.coalesce("n", F.lit(0)).alias("n"), "next", "more")
        met = cut(edges.join(state, "dep"))
        # What a passed item needs at least holds for those above it, too.
        least = met.where("n < 2").select("id", (F.col("base2") + F.col("length")).alias("base"))
        level = cut(level.unionByName(least).groupBy("id").agg(F.max("base").alias("base")))
        open_ = met.where("n > 0")
        if open_.count() == before:
            raise ValueError("the dependencies have a cycle")
        moved = open_.select("id", F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("dep")).alias("dep"), (F.col("length") + F.when(F.col("n") == 1, F.col("more")).otherwise(0)).alias("length"))
        edges = cut(moved.groupBy("id", "dep").agg(F.max("length").alias("length")))
        before = edges.count()
    return level.select("id", F.col("base").alias("depth"))


def chain_roots(parents: DataFrame) -> DataFrame:
    """Root and depth of every row of a parent forest, by pointer doubling: a chain of n takes log n rounds.

    parents: id, parent (null at a root). A parent that isn't there makes a root; rows in a loop are left out.
    """
    known = parents.select(F.col("id").alias("parent"))
    state = parents.join(known.withColumn("known", F.lit(True)), "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up"))
    state = cut(state.select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("done")))
    # A chain of n rows is done after log n rounds; what is open then leads into a loop.
    for _ in range(state.count().bit_length() + 1):
        if state.where("NOT done").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("done").alias("done2"))
        open_ = state.where("NOT done").join(above, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done2").alias("done"))
        state = cut(state.where("done").unionByName(open_))
    return state.where("done").select("id", F.col("up").alias("root"), "depth")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: node, component (its greatest node).

    Nodes that no cycle reaches or that reach none are components of their own. Every other node takes the greatest label
    that reaches it; of each label, the nodes that reach its owner form a component; they are removed and the rest goes
    on until nothing is left. Labels are in the order of a hash, so that a row of components, however numbered, is halved
    by a round rather than shortened by one.
    """
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    every = nodes.select(F.col("node").alias("id"))
    into_cycle = stuck_in_cycles(every, left.select(F.col("src").alias("id"), F.col("dst").alias("dep"))).withColumnRenamed("id", "node")
    from_cycle = stuck_in_cycles(every, left.select(F.col("dst").alias("id"), F.col("src").alias("dep"))).withColumnRenamed("id", "node")
    core = cut(into_cycle.join(from_cycle, "node", "left_semi"))
    done = nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
    nodes = core
    while not nodes.isEmpty():
        left = cut(left.join(nodes, left["src"] == nodes["node"], "left_semi").join(nodes, left["dst"] == nodes["node"], "left_semi"))
        label = nodes.withColumn("label", F.struct(F.xxhash64("node").alias("rank"), F.col("node").alias("owner")))
        while True:
            sent = left.join(label, left["src"] == label["node"]).select(F.col("dst").alias("node"), "label")
            new = cut(label.unionByName(sent).groupBy("node").agg(F.max("label").alias("label")))
            changed = not new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
            label = new
            if not changed:
                break
        label = label.select("node", F.col("label.owner").alias("label"))
        member = label.where("node = label")
        colours = label.select(F.col("node").alias("src"), F.col("label").alias("own"))
        while True:
            into = left.join(member, left["dst"] == member["node"]).select("src", "label").distinct()
            found = into.join(colours, "src").where("own = label").select(F.col("src").alias("node"), "label")
            new = cut(member.unionByName(found).distinct())
            if new.count() == member.count():
                break
            member = new
        greatest = member.groupBy("label").agg(F.max("node").alias("component"))
        done = done.unionByName(member.join(greatest, "label").select("node", "component"))
        nodes = cut(nodes.join(member, "node", "left_anti"))
    return done


#: Nodes of a graph that is put in order on the driver at most.
MAX_ORDERED = 20_000


def feedback_order(edges: DataFrame) -> DataFrame:
    """node, position: an order of the nodes in which little weight runs backwards, by the greedy rule of Eades, Lin and Smyth.

    Sinks go to the end, sources to the front, else the node with most weight out over in goes to the front; ties by node.
    The rule is sequential, so it is for small graphs (of modules, say): more than MAX_ORDERED nodes raise. edges: src,
    dst, weight, of one type.
    """
    import heapq

    spark = edges.sparkSession
    own = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    kind = edges.schema["src"].dataType.simpleString()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().limit(MAX_ORDERED + 1).collect()
    if len(nodes) > MAX_ORDERED:
        raise ValueError(f"more than {MAX_ORDERED} nodes")
    out, into = ({r[0]: {} for r in nodes} for _ in range(2))
    for r in own.collect():  # the pairs of a bounded number of nodes
        out[r["src"]][r["dst"]] = into[r["dst"]][r["src"]] = r["weight"]
    left, right, open_ = [], [], set(out)
    surplus = {n: sum(out[n].values()) - sum(into[n].values()) for n in out}
    heap = [(-s, n) for n, s in surplus.items()]
    heapq.heapify(heap)
    ends = sorted(n for n in out if not out[n] or not into[n])

    def take(n):
        open_.discard(n)
        for m, w in out.pop(n).items():
            del into[m][n]
            surplus[m] += w
            heapq.heappush(heap, (-surplus[m], m))
        for m, w in into.pop(n).items():
            del out[m][n]
            surplus[m] -= w
            heapq.heappush(heap, (-surplus[m], m))
        ends.extend(sorted(m for m in open_ if m in out and (not out[m] or not into[m]) and m not in ends))

    while open_:
        while ends:
            n = ends.pop(0)
            if n in open_:
                (left if out[n] else right).append(n)
                take(n)
        while heap and (heap[0][1] not in open_ or -heap[0][0] != surplus[heap[0][1]]):
            n = heapq.heappop(heap)[1]
            if n in open_:
                heapq.heappush(heap, (-surplus[n], n))
        if open_:
            n = heapq.heappop(heap)[1]
            left.append(n)
            take(n)
    return spark.createDataFrame([(n, i) for i, n in enumerate(left + right[::-1])], f"node {kind}, position int")


def plan_state(items: DataFrame, needs: DataFrame, done: Column, active: Column) -> DataFrame:
    """ready, blocked, active or done for every item; missing counts dependencies that don't exist.

    items: id and what `done` and `active` read. An item with a missing or unfinished dependency is blocked.
    """
    own = items.withColumn("done", F.coalesce(done, F.lit(False))).withColumn("active", F.coalesce(active, F.lit(False)))
    state = own.select(F.col("id").alias("dep"), F.col("done").alias("dep_done"), F.lit(True).alias("there"))
    per = needs.join(state, "dep", "left").groupBy("id").agg(
        F.sum(F.when(F.col("there"), 0).otherwise(1)).alias("missing"), F.sum(F.when(F.col("dep_done"), 0).otherwise(1)).alias("unresolved")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    label = F.when(F.col("done"), "done").when(F.col("active"), "active").when(zero("unresolved") > 0, "blocked").otherwise("ready")
    return own.join(per, "id", "left").select("id", label.alias("state"), zero("missing").cast("long").alias("missing"), zero("unresolved").cast("long").alias("unresolved"))
