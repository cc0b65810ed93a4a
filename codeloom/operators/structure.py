"""Structure of a graph: blocks, cut nodes and bridges, dominators, colouring, cliques, modularity, reach estimates.

All of it is rounds of joins and aggregates over edges(src, dst, ...); no
component or neighbourhood is ever gathered into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traverse import ROUNDS_A_TABLE, bfs, both_ways, components
from codeloom.plans.cut import cut, cut_by, drop

#: Buckets into which the children of a node are dealt for running sums.
SALTS = 256
#: Hops within which all that a root leads to is searched for before its tree is built.
NEAR = 12


def simple(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    return both_ways(edges.select("src", "dst").where("src <> dst")).distinct()


def bfs_tree(links: DataFrame, roots: DataFrame, both: bool = False) -> tuple[DataFrame, int]:
    """(id, parent, depth) of shortest paths from the roots, whose parent is null, and the largest depth; ties to the smallest parent.

    `both` says that links hold both directions of each edge: then a round
    leads to new nodes, its own and those of the round before only.
    """
    kind = links.schema["src"].dataType
    tables, depth = [cut(roots.select("id").distinct().select("id", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")))], 0
    while True:
        at = tables[-1].select(F.col("id").alias("src"))
        new = links.join(at, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        known = reduce(DataFrame.unionByName, tables[-2:] if both else tables)
        new = cut(new.join(known, "id", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if not new.limit(1).count():
            return reduce(DataFrame.unionByName, tables), depth
        depth += 1
        tables.append(new)
        if len(tables) > ROUNDS_A_TABLE:
            old, tables = tables[:-2], [cut(reduce(DataFrame.unionByName, tables[:-2])), *tables[-2:]]
            drop(*old)


def _fold_up(tree: DataFrame, deepest: int, how: dict) -> DataFrame:
    """Each node's columns joined with those of all below it; how: column -> (aggregate over children, join of own and theirs)."""
    done = below = None
    for d in range(deepest, -1, -1):
        own = tree.where(F.col("depth") == d)
        if below is not None:
            come = below.groupBy(F.col("parent").alias("id")).agg(*(fold(c).alias(f"_{c}") for c, (fold, _) in how.items()))
            own = own.join(come, "id", "left").withColumns({c: both(F.col(c), F.col(f"_{c}")) for c, (_, both) in how.items()}).select(tree.columns)
        below = cut(own)
        done = below if done is None else done.unionByName(below)
    return cut(done)


def _before(tree: DataFrame) -> DataFrame:
    """Adds before: the sizes of siblings that come earlier. Siblings are dealt to SALTS buckets, so a hub's children are many small groups."""
    dealt = tree.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    sums = dealt.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("parent").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("parent", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.where("parent is not null").withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(start, (F.col("parent") == F.col("p")) & (F.col("bucket") == F.col("b"))).select("id", "parent", "depth", "size", (F.col("start") + F.col("own")).alias("before"))


def _forest_blocks(edges: DataFrame) -> DataFrame:
    """(id, depth, block): the edges of a spanning forest, by their lower end, and the biconnected component of each.

    Two forest edges are in one block where an edge outside the forest closes
    a cycle over both: preorder numbers, subtree sizes and the least and
    largest number that a subtree reaches give the pairs to join, and weak
    components do the rest.
    """
    n = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by src once: rounds of the search exchange their frontier only
    links = cut_by(both_ways(edges.select("src", "dst").where("src <> dst")).repartition(n, "src").distinct(), "src")
    roots = components(links.where("src < dst")).select(F.col("component").alias("id")).distinct()
    tree, deepest = bfs_tree(links, roots, both=True)
    sized = _fold_up(tree.withColumn("size", F.lit(1).cast("long")), deepest, {"size": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))})
    placed = cut(_before(sized))
    level = cut(sized.where("depth = 0").select("id", "parent", "depth", "size", F.lit(0).cast("long").alias("pre")))
    numbered = level
    for d in range(1, deepest + 1):
        up = level.select(F.col("id").alias("parent"), F.col("pre").alias("up"))
        level = cut(placed.where(F.col("depth") == d).join(up, "parent").select("id", "parent", "depth", "size", (F.col("up") + 1 + F.col("before")).alias("pre")))
        numbered = numbered.unionByName(level)
    numbered = cut(numbered)
    side = lambda a, p: numbered.select(F.col("id").alias(a), F.col("parent").alias(f"{p}_parent"), F.col("pre").alias(f"{p}_pre"), F.col("size").alias(f"{p}_size"))
    rest = links.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where(~F.col("a_parent").eqNullSafe(F.col("dst")) & ~F.col("b_parent").eqNullSafe(F.col("src")))
    rest = cut(rest.select("src", "dst", "a_pre", "a_size", "b_pre"))
    far = rest.groupBy(F.col("src").alias("id")).agg(F.min("b_pre").alias("low"), F.max("b_pre").alias("high"))
    reach = numbered.join(far, "id", "left").withColumns({"low": F.least("pre", "low"), "high": F.greatest("pre", "high")})
    reach = _fold_up(reach, deepest, {"low": (F.min, F.least), "high": (F.max, F.greatest)})
    up = numbered.where("parent is not null").select(F.col("id").alias("parent"), F.col("pre").alias("up"), F.col("size").alias("up_size"))
    chained = reach.join(up, "parent").where("low < up or high >= up + up_size").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    crossed = rest.where("a_pre + a_size <= b_pre").select("src", "dst")
    joined = components(cut(chained.unionByName(crossed)))
    return cut(tree.where("parent is not null").join(joined, "id", "left").select("id", "depth", F.coalesce("component", "id").alias("block")))


def _core_blocks(edges: DataFrame) -> DataFrame:
    """(e, block, cyclic) of edges(e, a, b, thick): an edge is in the block of the forest edge above its lower end."""
    forest = _forest_blocks(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    side = lambda c: forest.select(F.col("id").alias(c), F.col("depth").alias(f"{c}_depth"), F.col("block").alias(f"{c}_block"))
    lower = F.when(F.coalesce("a_depth", F.lit(0)) > F.coalesce("b_depth", F.lit(0)), F.col("a_block")).otherwise(F.col("b_block"))
    held = cut(edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select("e", "thick", lower.alias("at")))
    named = held.groupBy("at").agg(F.min("e").alias("block"), F.count("*").alias("n"))
    return cut(held.join(named, "at").select("e", "block", (F.col("thick") | (F.col("n") > 1)).alias("cyclic")))


#: A round that leaves more than this share of the edges is the last that shrinks a graph.
SHRINKS = 0.9


def _led(glued: DataFrame) -> DataFrame:
    """(end, to): where a chain leads to from each end of an edge at an inner node, which glues the ends x and y of two edges.

    From an end on, the edge behind it is crossed to its other end, and so on by
    doubling; an end that has come to the end of its chain is looked at no
    more. A chain without an end is a ring: there `to` is its least end.
    """
    over = lambda a, b: F.struct(F.col(a).alias("end"), F.col(b).bitwiseXOR(F.lit(1)).alias("to"))
    going = cut(glued.select(F.explode(F.array(over("x", "y"), over("y", "x"))).alias("s")).select("s.end", "s.to", F.col("s.end").alias("low")))
    n, steps, there = going.count(), 1, []
    while True:
        far = reduce(DataFrame.unionByName, [*there, going]).select(F.col("end").alias("to"), F.col("to").alias("far"), F.col("low").alias("more"))
        new = cut(going.join(far, "to", "left").select("end", F.coalesce("far", "to").alias("to"), F.least("low", "more").alias("low"), F.col("far").isNotNull().alias("goes")))
        there.append(new.where("not goes").select("end", "to", "low"))
        going, steps = new.where("goes").select("end", "to", "low"), 2 * steps
        if steps > n or not going.limit(1).count():
            return reduce(DataFrame.unionByName, there).select("end", "to").unionByName(going.select("end", F.col("low").alias("to")))


def _shrunk(now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None] | None:
    """One round over edges(e, a, b, thick), without loops or repeats; None where no node has fewer than three edges.

    A chain, whose inner nodes have two edges, becomes one edge; it is done where
    it comes back to its start or has an end with no other edge. Returns the
    edges left, done(e, block, cyclic), inside(e, up, thick) of chains that stay
    and same(e, up) of edges with the same ends, which become one thick edge.
    """
    # an end is the number of its edge, twice, and one more for b
    ends = now.select(F.col("a").alias("id"), (F.col("e") * 2).alias("end")).unionByName(now.select(F.col("b").alias("id"), (F.col("e") * 2 + 1).alias("end")))
    few = cut(ends.groupBy("id").agg(F.count("*").alias("n"), F.min("end").alias("x"), F.max("end").alias("y")).where("n < 3").select("n", "x", "y"))
    if not few.limit(1).count():
        return None
    edge = lambda c: F.shiftright(c, 1)
    leaves = few.where("n = 1").select(edge("x").alias("e"), F.lit(4).alias("bit"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("other"))
    bit = F.when(F.col("end") % 2 == 0, 1).otherwise(2)
    led = _led(few.where("n = 2")).select(edge("end").alias("e"), bit.alias("bit"), "to", F.col("end").bitwiseXOR(F.lit(1)).alias("other"))
    marks = led.unionByName(leaves).groupBy("e").agg(F.bit_or("bit").alias("bits"), F.min("to").alias("to"), F.min("other").alias("other"))
    # of the two ends that a chain leads to, the lesser names it; an edge with one inner node is at one of them
    up = edge(F.when(F.col("bits").bitwiseAND(3) == 3, F.col("to")).otherwise(F.least("to", "other")))
    marks = marks.select("e", "bits", up.alias("up"))
    outer = lambda c, k: F.when(F.coalesce(F.col("bits").bitwiseAND(k) == 0, F.lit(True)), F.col(c)).alias(c)
    marked = cut(now.join(marks, "e", "left").select("e", F.coalesce("up", "e").alias("up"), "thick", "bits", outer("a", 1), outer("b", 2)))
    chains = marked.where("bits is not null").groupBy("up").agg(F.min(F.least("a", "b")).alias("a"), F.max(F.greatest("a", "b")).alias("b"), F.max(F.col("bits") >= 4).alias("leaf"))
    ring = F.col("a").isNull() | (F.col("a") == F.col("b"))
    chains = cut(chains.select("up", "a", "b", F.when(ring, "ring").when(F.col("leaf"), "leaf").otherwise("stays").alias("how")))
    held = marked.where("bits is not null").select("e", "up", "thick").join(chains.select("up", "how"), "up")
    held = cut(held.select("e", "up", "thick", "how"))
    done = held.where("how <> 'stays'").select("e", F.when(F.col("how") == "ring", F.col("up")).otherwise(F.col("e")).alias("block"), (F.col("thick") | (F.col("how") == "ring")).alias("cyclic"))
    left = marked.where("bits is null").select("e", "a", "b", "thick")
    drop(few)
    inside = held.where("how = 'stays'").select("e", "up", "thick")
    if not inside.limit(1).count():
        return left, done, None, None
    left = cut(left.unionByName(chains.where("how = 'stays'").select(F.col("up").alias("e"), "a", "b", F.lit(False).alias("thick"))))
    one = cut(left.groupBy("a", "b").agg(F.min("e").alias("up"), F.count("*").alias("n"), F.max("thick").alias("thick")))
    same = cut(left.join(one.where("n > 1").select("a", "b", "up"), ["a", "b"]).select("e", "up"))
    return one.select(F.col("up").alias("e"), "a", "b", (F.col("thick") | (F.col("n") > 1)).alias("thick")), done, inside, same


def blocks(edges: DataFrame) -> DataFrame:
    """(a, b, block, lone): each edge once, a < b, the biconnected component it is in, and whether it is alone there.

    Direction and repeats of edges do not count, loops are left out. Rounds
    take off edges to nodes without another edge and make chains one edge, so
    that rings and trees of any depth go in a few rounds; what is left once
    they take little goes to a spanning forest. An edge that is alone in its
    block and stands for a chain leaves the chain's edges alone in theirs.
    """
    plain = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    first = cut(plain.withColumn("e", F.monotonically_increasing_id()))
    now, levels = first.select("e", "a", "b", F.lit(False).alias("thick")), []
    n, more = first.count(), True
    while n and more:
        round_ = _shrunk(now)
        if round_ is None:
            break
        now, *level = round_
        levels.append(level)
        before, n = n, now.count()
        more = n <= SHRINKS * before
    found = _core_blocks(now) if n else None
    for done, inside, same in reversed(levels):
        if same is not None:
            wide = same.join(found.withColumnRenamed("e", "up"), "up").select("e", "block", F.lit(True).alias("cyclic"))
            found = wide.unionByName(found.join(same, "e", "left_anti"))
        if inside is not None:
            long = inside.join(found.withColumnRenamed("e", "up"), "up").select("e", F.when(F.col("cyclic"), F.col("block")).otherwise(F.col("e")).alias("block"), (F.col("cyclic") | F.col("thick")).alias("cyclic"))
            found = cut(long.unionByName(found.join(inside, "e", "left_anti")))
        found = done if found is None else found.unionByName(done)
    if found is None:
        return first.select("a", "b", F.col("e").alias("block"), F.lit(True).alias("lone"))
    return first.join(found, "e").select("a", "b", "block", (~F.col("cyclic")).alias("lone"))


def articulation_points(parts: DataFrame) -> DataFrame:
    """(id) of the nodes that are in two blocks or more; parts: of blocks()."""
    ends = parts.select(F.col("a").alias("id"), "block").unionByName(parts.select(F.col("b").alias("id"), "block"))
    return ends.groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("id")


def bridges(parts: DataFrame) -> DataFrame:
    """(a, b), a < b: edges that are a block of their own; parts: of blocks()."""
    return parts.where("lone").select("a", "b")


def _jumps(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, up) of the ancestors 1, 2, 4, ... steps above, the root's being the root, and (id, depth), of tree(id, parent) whose root has no parent."""
    now = cut(tree.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    levels = [now.select("id", "up")]
    while True:
        step = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        new = cut(now.join(step, "up").select("id", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("grew")))
        now = new.drop("grew")
        if not new.where("grew").limit(1).count():
            return levels, now.select("id", "depth")
        levels.append(now.select("id", "up"))


def _lifted(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """pairs(..., a, b) with nca, the nearest common ancestor of a and b: both are lifted to one depth (columns da, db), then together as long as they differ."""
    short = F.abs(F.col("da") - F.col("db"))
    pairs = pairs.withColumn("low", F.when(F.col("da") > F.col("db"), F.col("a")).otherwise(F.col("b"))).withColumn("top", F.when(F.col("da") > F.col("db"), F.col("b")).otherwise(F.col("a"))).withColumn("left", short)
    for k, up in enumerate(levels):
        mine = up.select(F.col("id").alias("_i"), F.col("up").alias("_u"))
        bit = F.col("left").bitwiseAND(1 << k) != 0
        pairs = pairs.join(mine, bit & (F.col("low") == F.col("_i")), "left").withColumn("low", F.when(bit, F.col("_u")).otherwise(F.col("low"))).drop("_i", "_u")
        if k % 4 == 3:
            pairs = cut(pairs)
    pairs = cut(pairs)
    for k in reversed(range(len(levels))):
        one, two = (levels[k].select(F.col("id").alias(f"{n}_i"), F.col("up").alias(f"{n}_u")) for n in ("_a", "_b"))
        open_ = F.col("low") != F.col("top")
        met = pairs.join(one, open_ & (F.col("low") == F.col("_a_i")), "left").join(two, open_ & (F.col("top") == F.col("_b_i")), "left")
        move = open_ & (F.col("_a_u") != F.col("_b_u"))
        pairs = met.withColumn("low", F.when(move, F.col("_a_u")).otherwise(F.col("low"))).withColumn("top", F.when(move, F.col("_b_u")).otherwise(F.col("top"))).drop("_a_i", "_a_u", "_b_i", "_b_u")
        if k % 2 == 0:
            pairs = cut(pairs)
    last = levels[0].select(F.col("id").alias("_i"), F.col("up").alias("_u"))
    return pairs.join(last, F.col("low") == F.col("_i")).withColumn("nca", F.when(F.col("low") == F.col("top"), F.col("low")).otherwise(F.col("_u"))).drop("_i", "_u", "low", "top", "left")


def _spanning_tree(links: DataFrame, root: DataFrame) -> DataFrame:
    """(id, parent) of all that the root leads to. A node that only one edge leads to follows it, so chains are jumped over by doubling; rounds of a search are needed between the other nodes only."""
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("only"))
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).union(root.select("id")).distinct().join(into, "id", "left")
    base = cut(ids.select("id", F.when(F.col("n") == 1, F.col("only")).alias("only")))
    now = cut(base.select("id", F.coalesce("only", "id").alias("head")))
    n, rounds = now.count(), 0
    while 1 << rounds < n:
        up = now.select(F.col("id").alias("head"), F.col("head").alias("far"))
        new = cut(now.join(up, "head").select("id", F.col("far").alias("head"), (F.col("far") != F.col("head")).alias("moved")))
        now, rounds = new.select("id", "head"), rounds + 1
        if not new.where("moved").limit(1).count():
            break
    # a ring of nodes with one edge each never comes to a head; nothing leads into it
    heads = base.where("only is null").select(F.col("id").alias("head"))
    now = cut(now.join(heads, "head", "left_semi"))
    many = cut(links.join(base.where("only is null").select(F.col("id").alias("dst")), "dst", "left_semi").join(now.select(F.col("id").alias("src"), "head"), "src"))
    tree, _ = bfs_tree(many.select(F.col("head").alias("src"), "dst").distinct(), root)
    chosen = many.join(tree.select(F.col("id").alias("dst"), F.col("parent").alias("head")), ["dst", "head"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    first = root.select("id", F.lit(None).cast(links.schema["src"].dataType).alias("parent"))
    inner = base.where("only is not null").join(now.join(tree.select(F.col("id").alias("head")), "head", "left_semi"), "id", "left_semi").select("id", F.col("only").alias("parent"))
    return cut(first.unionByName(chosen).unionByName(inner))


def dominator_tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id, idom) of every node that root(id), one row, leads to: its nearest dominator, null for the root.

    From a spanning tree on, a node whose parent is no ancestor of one of its
    predecessors is moved up to the nearest common ancestor of both, all such
    nodes at once, until there is none: an ancestor that dominates stays one,
    and a tree in which every edge comes from below the parent of its end is
    that of the dominators. Ancestors are looked up in tables of jumps, n log n
    rows for n nodes; only nodes with two predecessors or more are looked at.
    """
    start = cut(root.select("id").distinct())
    if start.limit(2).count() != 1:
        raise ValueError("dominators need one root")
    every = cut(edges.select("src", "dst").where("src <> dst"))
    led = bfs(every, start, NEAR, kept=True)
    # what the root does not lead to has no dominator; a search that goes on is left to the tree, which jumps over chains
    used = every if led.where(F.col("depth") == NEAR).limit(1).count() else every.join(led.select(F.col("id").alias("src")), "src", "left_semi")
    links = cut(used.select("src", "dst").distinct().join(start.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    drop(every)
    tree = _spanning_tree(links, start)
    known = links.join(tree.select(F.col("id").alias("src")), "src", "left_semi")
    several = known.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    tested = cut(known.join(several, "dst", "left_semi"))
    while tested.limit(1).count():
        levels, depths = _jumps(tree)
        depth = lambda name, col: depths.select(F.col("id").alias(name), F.col("depth").alias(col))
        ends = tested.join(tree.select(F.col("id").alias("dst"), F.col("parent").alias("b")), "dst").select("dst", F.col("src").alias("a"), "b")
        ends = cut(ends.where("a <> b").join(depth("a", "da"), "a").join(depth("b", "db"), "b"))
        found = _lifted(ends, levels).join(depth("nca", "dn"), "nca").where("nca <> b")
        better = cut(found.groupBy(F.col("dst").alias("id")).agg(F.min_by("nca", "dn").alias("better")))
        if not better.limit(1).count():
            break
        tree = cut(tree.join(better, "id", "left").select("id", F.coalesce("better", "parent").alias("parent")))
    return tree.select("id", F.col("parent").alias("idom"))


def dominator_pairs(tree: DataFrame) -> DataFrame:
    """(id, dominator): all pairs of a tree(id, idom), each node with itself too; sets of ancestors double their height each round."""
    levels, _ = _jumps(tree.select("id", F.col("idom").alias("parent")))
    pairs = tree.select("id", F.col("id").alias("dominator"))
    for up in levels:
        far = pairs.select(F.col("id").alias("up"), "dominator")
        pairs = cut(pairs.union(up.join(far, "up").select("id", "dominator")).distinct())
    return pairs


def dominators(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id, dominator): all pairs where each path from the root to id meets the dominator; a node dominates itself."""
    return dominator_pairs(dominator_tree(edges, root))


def immediate_dominators(pairs: DataFrame) -> DataFrame:
    """(id, idom) of dominators(): the dominator that has one dominator less; the root has none."""
    n = pairs.groupBy("id").agg(F.count("*").alias("n"))
    of = n.select(F.col("id").alias("dominator"), F.col("n").alias("m"))
    return pairs.join(n, "id").join(of, "dominator").where("m = n - 1").select("id", F.col("dominator").alias("idom"))


def colouring(edges: DataFrame) -> DataFrame:
    """(id, colour): first-fit by falling degree, ties to the smaller id.

    A node takes its colour in the round in which all its neighbours that come
    earlier have theirs, so the result is that of the sequential method.
    """
    links = simple(edges)
    degree = cut(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
    near = degree.select(F.col("id").alias("dst"), F.col("degree").alias("other"))
    first = (F.col("other") > F.col("degree")) | (F.col("other") == F.col("degree")) & (F.col("dst") < F.col("id"))
    waits = cut(links.withColumnRenamed("src", "id").join(degree, "id").join(near, "dst").where(first).select("id", F.col("dst").alias("earlier")))
    open_, done = degree.select("id"), None
    while True:
        if done is None:
            new = open_.join(waits, "id", "left_anti").withColumn("colour", F.lit(0))
        else:
            seen = waits.join(open_, "id", "left_semi").join(done.select(F.col("id").alias("earlier"), "colour"), "earlier", "left")
            ready = seen.groupBy("id").agg(F.bool_or(F.col("colour").isNull()).alias("late")).where("not late")
            used = seen.join(ready, "id", "left_semi").select("id", "colour").distinct()
            place = F.row_number().over(Window.partitionBy("id").orderBy("colour")) - 1
            gaps = used.withColumn("place", place).groupBy("id").agg(F.min(F.when(F.col("place") < F.col("colour"), F.col("place"))).alias("gap"), F.count("*").alias("n"))
            new = gaps.select("id", F.coalesce("gap", "n").cast("int").alias("colour"))
        new = cut(new)
        done = new if done is None else cut(done.unionByName(new))
        open_ = cut(open_.join(new, "id", "left_anti"))
        if not open_.limit(1).count():
            return done


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """(clique): sorted ids of every maximal clique of two nodes or more, direction not counting.

    Cliques grow by a node larger than their last; one without any common
    neighbour is maximal. The number of cliques may be exponential.
    """
    links = cut(simple(edges))
    level, size, found = cut(links.where("src < dst").select(F.array("src", "dst").alias("clique"))), 2, None
    while level.limit(1).count():
        each = level.select("clique", F.explode("clique").alias("src"))
        common = cut(each.join(links, "src").groupBy("clique", "dst").agg(F.count("*").alias("n")).where(F.col("n") == size).select("clique", "dst"))
        own = level.join(common.select("clique").distinct(), "clique", "left_anti")
        found = own if found is None else found.unionByName(own)
        level = cut(common.where(F.col("dst") > F.element_at("clique", -1)).select(F.concat("clique", F.array("dst")).alias("clique")))
        size += 1
    return level.limit(0) if found is None else found


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of parts(id, community) over undirected edges(src, dst, weight): the share of weight inside less the share expected; 0 without edges."""
    a, b = parts.select(F.col("id").alias("src"), F.col("community").alias("a")), parts.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    e = edges.join(a, "src").join(b, "dst").select("weight", "a", "b")
    ends = e.select(F.col("a").alias("community"), "weight", F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0).alias("inside")).unionByName(e.select(F.col("b").alias("community"), "weight", F.lit(0.0).alias("inside")))
    each = ends.groupBy("community").agg(F.sum("weight").alias("ends"), F.sum("inside").alias("inside"))
    total = F.sum("ends")
    value = 2 * F.sum("inside") / total - resolution * F.sum(F.col("ends") * F.col("ends")) / (total * total)
    return each.agg(F.coalesce(value, F.lit(0.0)).alias("modularity"))


def reach_estimates(edges: DataFrame, most: int | None = None, bits: int = 12) -> DataFrame:
    """(id, reach): about how many nodes a path leads to, the node itself included, by unions of sketches until none grows; `most`, where given, bounds the hops."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    now = cut(ids.groupBy("id").agg(F.hll_sketch_agg("id", bits).alias("sketch")).withColumn("reach", F.hll_sketch_estimate("sketch")))
    hops = 0
    while most is None or hops < most:
        hops += 1
        come = links.join(now, links.dst == now.id).select(F.col("src").alias("id"), "sketch")
        grown = now.select("id", "sketch").unionByName(come).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"))
        old = now.select("id", F.col("reach").alias("old"))
        new = cut(grown.withColumn("reach", F.hll_sketch_estimate("sketch")).join(old, "id"))
        now = new.select("id", "sketch", "reach")
        if not new.where("reach <> old").limit(1).count():
            break
    return now.select("id", "reach")


def feedback_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, src, dst): in each strong component of parts(id, component) with a cycle, an edge into the node that most of its edges lead to; ties to smaller ids."""
    a, b = parts.select(F.col("id").alias("src"), "component"), parts.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("component", "src", "dst")
    into = inner.groupBy("component", "dst").agg(F.count("*").alias("n"), F.min("src").alias("src"))
    best: Column = F.min(F.struct((-F.col("n")).alias("less"), "dst", "src")).alias("m")
    return into.groupBy("component").agg(best).select("component", "m.src", "m.dst")
