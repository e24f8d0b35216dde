"""Closures of graphs, and trees given as merges.

A graph is edges (child, parent); a tree is merges (project, step, child_a, child_b, parent, score).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrospark.functions import scalar as fn
from dendrospark.operators.intervals import containing
from dendrospark.operators.jumps import Tree, chain_ends
from dendrospark.operators.storage import kept, shuffled

#: The ladder of thresholds at which trees are built and cut.
THRESHOLDS = (1e-100, 1e-90, 1e-80, 1e-70, 1e-60, 1e-50, 1e-40, 1e-30, 1e-20, 1e-10, 1e-05, 100.0)


def closure(edges: DataFrame, *group: str) -> DataFrame:
    """(group, child, ancestor, least, most): the shortest and longest way up, self left out, for acyclic graphs. A cycle is an error.

    A round joins the ways that the last round found or made longer or shorter with all ways known, on both sides, so ways double and a graph of depth d takes about
    log2(d) rounds; what a round joins follows the last round's new ways, not all. The known ways are rewritten with their new lengths only where those changed.
    """
    key = [*group, "child", "ancestor"]
    fold = lambda df: df.groupBy(*key).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    known = kept(edges.select(*group, "child", F.col("parent").alias("ancestor"), F.lit(1).alias("least"), F.lit(1).alias("most")).distinct(), "closure")
    new, rounds = known, 0
    above = lambda df: df.select(*group, F.col("child").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("least").alias("_l"), F.col("most").alias("_m"))
    longer = lambda a, b: a.join(above(b), [*group, "ancestor"]).select(*group, "child", F.col("_up").alias("ancestor"), (F.col("least") + F.col("_l")).alias("least"), (F.col("most") + F.col("_m")).alias("most"))
    while True:
        state = new.agg(F.count("*"), F.max(F.col("child") == F.col("ancestor"))).first()
        if state[1]:
            raise ValueError("the graph has a cycle")
        if not state[0]:
            return known
        found = longer(new, known)
        if rounds:  # new ways were joined with themselves in the first line, too
            found = found.unionByName(longer(known.join(new.select(*key), key, "left_anti"), new))
        old = known.select(*key, F.col("least").alias("_least"), F.col("most").alias("_most"))
        better = fold(found).join(old, key, "left").where("_least IS NULL OR least < _least OR most > _most")
        new = kept(better.select(*key, F.least("least", "_least").alias("least"), F.greatest("most", "_most").alias("most")), "closure-new")
        known, rounds = kept(known.join(new.select(*key), key, "left_anti").unionByName(new), "closure"), rounds + 1


def descendants(edges: DataFrame, *group: str) -> DataFrame:
    return closure(edges, *group).select(*group, F.col("ancestor").alias("term"), F.col("child").alias("descendant"))


def siblings(edges: DataFrame) -> DataFrame:
    a = edges.select("parent", F.col("child").alias("term"))
    return a.join(edges.select("parent", F.col("child").alias("sibling")), "parent").where("term <> sibling").select("term", "sibling").distinct()


def common_ancestors(sets: DataFrame, up: DataFrame) -> DataFrame:
    """Ancestors of every term of a set (key, term); none where they share none."""
    need = sets.groupBy("key").agg(F.countDistinct("term").alias("need"))
    has = sets.join(up.select(F.col("child").alias("term"), "ancestor"), "term").groupBy("key", "ancestor").agg(F.countDistinct("term").alias("has"))
    return has.join(need, "key").where("has = need").select("key", "ancestor")


def most_specific(sets: DataFrame, up: DataFrame) -> DataFrame:
    """Terms of each set (key, term) that are no ancestors of others in it."""
    other = sets.select("key", F.col("term").alias("child")).join(up.select("child", F.col("ancestor").alias("term")), "child").select("key", "term")
    return sets.join(other, ["key", "term"], "left_anti")


def most_general(sets: DataFrame, up: DataFrame) -> DataFrame:
    other = sets.select("key", F.col("term").alias("ancestor")).join(up.select("ancestor", F.col("child").alias("term")), "ancestor").select("key", "term")
    return sets.join(other, ["key", "term"], "left_anti")


def most_specific_common_ancestor(sets: DataFrame, up: DataFrame) -> DataFrame:
    """The smallest of the most specific common ancestors; a set of one term has that term."""
    common = common_ancestors(sets, up).withColumnRenamed("ancestor", "term")
    best = most_specific(common, up).groupBy("key").agg(F.min("term").alias("term"))
    one = sets.groupBy("key").agg(F.countDistinct("term").alias("n"), F.min("term").alias("own")).where("n = 1").select("key", "own")
    return best.join(one, "key", "full").select("key", F.coalesce("own", "term").alias("term"))


def main_branches(edges: DataFrame, up: DataFrame, root: Column) -> DataFrame:
    """(term, branch): which children of the root each term is or stands below."""
    tops = edges.where(F.col("parent") == root).select(F.col("child").alias("branch")).distinct()
    below = up.select(F.col("child").alias("term"), F.col("ancestor").alias("branch")).join(tops, "branch", "left_semi").select("term", "branch")
    return tops.select(F.col("branch").alias("term"), "branch").unionByName(below).distinct()


def closure_table(terms: DataFrame, up: DataFrame, none: str = "none") -> DataFrame:
    """term -> its ancestors as text."""
    names = up.groupBy(F.col("child").alias("term")).agg(fn.terms_text(F.array_sort(F.collect_list(F.col("ancestor").cast("string")))).alias("ancestors"))
    return terms.join(names, "term", "left").select("term", F.coalesce("ancestors", F.lit(none)).alias("ancestors"))


def common_lineage(sets: DataFrame, up: DataFrame, tops: DataFrame, everything: int = -1) -> DataFrame:
    """Common ancestors of each set of taxa; where they are fewer than two, ``everything`` and the top groups met."""
    common = common_ancestors(sets, up)
    few = sets.select("key").distinct().join(common.groupBy("key").agg(F.count("*").alias("n")), "key", "left").where(F.coalesce("n", F.lit(0)) < 2).select("key")
    met = sets.join(few, "key", "left_semi").join(up.select(F.col("child").alias("term"), "ancestor"), "term").join(tops.select(F.col("term").alias("ancestor")), "ancestor", "left_semi")
    rest = few.select("key", F.lit(everything).cast(sets.schema["term"].dataType).alias("ancestor")).unionByName(met.select("key", "ancestor")).distinct()
    return common.join(few, "key", "left_anti").unionByName(rest)


# trees ----------------------------------------------------------------------------------


def tree_edges(merges: DataFrame) -> DataFrame:
    """(project, child, parent) of all merges."""
    return merges.select("project", F.explode(F.array("child_a", "child_b")).alias("child"), "parent")


def tree_links(merges: DataFrame) -> DataFrame:
    """node, relation (sibling, child or parent) and the other node."""
    e = tree_edges(merges)
    sib = merges.select("project", F.col("child_a").alias("node"), F.lit("sibling").alias("relation"), F.col("child_b").alias("other"))
    rev = merges.select("project", F.col("child_b").alias("node"), F.lit("sibling").alias("relation"), F.col("child_a").alias("other"))
    par = e.select("project", F.col("child").alias("node"), F.lit("parent").alias("relation"), F.col("parent").alias("other"))
    chi = e.select("project", F.col("parent").alias("node"), F.lit("child").alias("relation"), F.col("child").alias("other"))
    return sib.unionByName(rev).unionByName(par).unionByName(chi)


def node_ancestors(merges: DataFrame) -> DataFrame:
    """(project, child, ancestor, distance) of all nodes and those above them."""
    t = Tree(merges)
    above = t.nodes.select(F.col("id").alias("above"), F.col("node").alias("ancestor"))
    return t.named(t.ancestors(), "above", "distance").withColumnRenamed("node", "child").join(above, "above").select("project", "child", "ancestor", "distance")


def leaves(merges: DataFrame) -> DataFrame:
    """(project, node, leaf, depth): the leaves below every node; a leaf is its own."""
    t = Tree(merges)
    own = t.nodes.where("leaf").select(F.col("id").alias("leaf"), F.col("node").alias("_leaf"))
    return t.named(t.leaves(), "leaf", "distance").join(own, "leaf").select("project", "node", F.col("_leaf").alias("leaf"), F.col("distance").alias("depth"))


def heights(merges: DataFrame, fold: Callable[[str], Column] | None = None, **folds: Callable[[str], Column]) -> DataFrame:
    """Edges from each node down to a leaf: the most, or with ``F.min`` the fewest. ``folds``: several at once, by name."""
    folds = folds or {"height": fold or F.max}
    t = Tree(merges)
    deep = t.climb(t.nodes.select("id", F.col("parent").isNotNull().cast("int").alias("depth")), "depth")
    deep = shuffled(t.nodes.select("id", "leaf").join(deep.select("id", "depth"), "id"), "depths")
    low = t.fold(deep.select("id", *[F.when(F.col("leaf"), F.col("depth")).alias(n) for n in folds]), folds)
    both = low.join(deep.select("id", "depth"), "id").select("id", *[(F.col(n) - F.col("depth")).alias(n) for n in folds])
    return t.named(both, *folds)


def depths(merges: DataFrame) -> DataFrame:
    """Edges from each node up to its root."""
    t = Tree(merges)
    return t.named(t.climb(t.nodes.select("id", F.col("parent").isNotNull().cast("int").alias("depth")), "depth"), "depth")


def propagated(merges: DataFrame, values: DataFrame, **folds: Callable[[str], Column]) -> DataFrame:
    """(project, node, ...): for each node, the values (project, node, ...) of itself and of all below, put together by ``folds`` (name: F.sum, F.min, F.max)."""
    t = Tree(merges)
    own = t.ids.join(values, ["project", "node"], "left").select("id", *folds)
    return t.named(t.fold(own.groupBy("id").agg(*[f(n).alias(n) for n, f in folds.items()]), folds), *folds)


def roots(merges: DataFrame) -> DataFrame:
    edges = tree_edges(merges)
    return edges.select("project", F.col("parent").alias("node")).distinct().join(edges.select("project", F.col("child").alias("node")), ["project", "node"], "left_anti")


def root_forest(merges: DataFrame, first_id: int = 1_000_000) -> DataFrame:
    """Merges that join the roots of each project in a chain, with ids from ``first_id`` and score -1."""
    order = Window.partitionBy("project").orderBy("node")
    tops = roots(merges).withColumns({"_n": F.row_number().over(order), "_before": F.lag("node").over(order)})
    last = merges.groupBy("project").agg(F.max("step").alias("_last"))
    kind = merges.schema["parent"].dataType
    before = F.when(F.col("_n") == 2, F.col("_before")).otherwise((F.lit(first_id - 3) + F.col("_n")).cast(kind))
    return tops.where("_n > 1").join(last, "project").select(
        "project", (F.col("_last") + F.col("_n") - 1).cast(merges.schema["step"].dataType).alias("step"), before.alias("child_a"), F.col("node").alias("child_b"),
        (F.lit(first_id - 2) + F.col("_n")).cast(kind).alias("parent"), F.lit(-1.0).alias("score"),
    )


def branch_lengths(merges: DataFrame, low: float = 10, high: float = 100) -> DataFrame:
    """Lengths between ``low`` and ``high`` by log score; twice ``high`` for artificial merges (score -1)."""
    least = F.min(F.when(F.col("score") != -1, F.col("score"))).over(Window.partitionBy("project"))
    scale = (high - low) / fn.log10_nonzero(least)
    length = low + ((high - low) - scale * fn.log10_nonzero(F.col("score")))
    return merges.withColumn("branch_length", F.round(F.when(F.col("score") == -1, F.lit(2.0 * high)).otherwise(length), 2))


def without_nested(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (project, node) that don't stand below others of the set."""
    t = Tree(merges)
    chosen = t.nodes.join(nodes.select("project", "node").distinct().withColumn("_in", F.lit(1)), ["project", "node"], "left").select("id", F.coalesce("_in", F.lit(0)).alias("n"))
    over = t.climb(kept(chosen, "chosen"), "n").where("n > 1").select("id")
    return nodes.join(t.named(over), ["project", "node"], "left_anti")


def subtree_nodes(merges: DataFrame, root: DataFrame, omit: DataFrame) -> DataFrame:
    """Nodes below each root (project, node), not past merges that have an omitted child."""
    edges = tree_edges(merges)
    gone = edges.join(omit.select("project", F.col("node").alias("child")), ["project", "child"], "left_semi").select("project", "parent")
    labels = Tree(merges.join(gone, ["project", "parent"], "left_anti")).labels
    most = labels.select(F.col("id").alias("top"), F.col("size").alias("most"))
    rows = labels.join(most, "top").select("project", "top", "node", "pre", "size", "most")
    below = rows.join(root.select("project", "node").distinct(), ["project", "node"], "left_semi").select("top", F.col("node").alias("root"), (F.col("pre") + 1).alias("first"), (F.col("pre") + F.col("size")).alias("end"), "most")
    return containing(rows.select("project", "top", "node", "pre", "most"), "pre", below, "first", "end", ["top"]).select("project", "node", "root")


def filter_tree(merges: DataFrame, omit: DataFrame) -> DataFrame:
    """The tree without the leaves under omitted nodes: a node keeps a merge only if both sides keep a leaf;
    where one side keeps none, its parent is replaced by the other side."""
    t = Tree(merges)
    marked = t.nodes.join(omit.select("project", "node").distinct().withColumn("_omit", F.lit(1)), ["project", "node"], "left").select("id", "leaf", F.coalesce("_omit", F.lit(0)).alias("n"))
    marked = kept(marked, "omitted")
    gone = marked.select("id", "leaf").join(t.climb(marked, "n"), "id")
    live = t.fold(gone.select("id", (F.col("leaf") & (F.col("n") == 0)).cast("long").alias("live")), {"live": F.sum})
    live = kept(t.named(live.where("live > 0")), "live")
    for side in ("a", "b"):
        mark = live.select("project", F.col("node").alias(f"child_{side}"), F.lit(True).alias(f"_{side}"))
        merges = merges.join(mark, ["project", f"child_{side}"], "left")
    a, b = (F.coalesce(f"_{s}", F.lit(False)) for s in "ab")
    marked = kept(merges.withColumn("_stay", a & b).withColumn("_to", F.when(a & ~b, F.col("child_a")).when(b & ~a, F.col("child_b"))), "tree")
    # a chain of replaced parents ends at the first node that stays
    end = chain_ends(marked.where(F.col("_to").isNotNull()).select("project", F.col("parent").alias("node"), F.col("_to").alias("to")), "project")
    out = marked.where("_stay").select("project", "step", "child_a", "child_b", "parent", "score")
    for side in ("a", "b"):
        e = end.select("project", F.col("node").alias(f"child_{side}"), F.col("end").alias(f"_e{side}"))
        out = out.join(e, ["project", f"child_{side}"], "left").withColumn(f"child_{side}", F.coalesce(f"_e{side}", f"child_{side}")).drop(f"_e{side}")
    return out.select("project", "step", "child_a", "child_b", "parent", "score")


def cut_ladder(merges: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, project, cluster, leaf) of the trees cut at each of the rising thresholds; unmerged leaves stand alone.

    A cut keeps the merges before the first that exceeds its threshold, so one sum a project tells from which threshold on a merge is kept. A
    node is a cluster from there until its parent is kept; the clusters of all thresholds then meet their leaves in one join of intervals.
    """
    n = len(thresholds)
    first = merges.groupBy("project").agg(F.array(*[F.min(F.when(F.col("score") > t, F.col("step"))) for t in thresholds]).alias("_ends"))  # NaN exceeds all
    late = F.aggregate("_ends", F.lit(0), lambda k, e: k + F.when(e <= F.col("step"), 1).otherwise(0))
    since = merges.select("project", F.col("parent").alias("node"), "step").join(first, "project").select("project", "node", late.alias("since"))
    t = Tree(merges)
    rows = t.labels.join(since, ["project", "node"], "left").withColumn("since", F.coalesce("since", F.lit(0)))
    until = since.select("project", F.col("node").alias("parent"), F.col("since").alias("until"))
    rows = rows.join(until, ["project", "parent"], "left").withColumn("until", F.coalesce("until", F.lit(n)))
    most = t.labels.select(F.col("id").alias("top"), F.col("many").alias("most"))
    rows = shuffled(rows.join(most, "top").select("project", "top", "node", "leaf", "low", "many", "most", "since", "until"), "ladder")
    tops = rows.where("since < until").select("top", F.col("node").alias("cluster"), F.col("low").alias("first"), (F.col("low") + F.col("many")).alias("end"), "most", "since", "until")
    own = rows.where("leaf").select("project", "top", F.col("node").alias("_leaf"), "low", "most")
    met = containing(own, "low", tops, "first", "end", ["top"])
    cuts = F.explode(F.slice(F.array(*[F.lit(float(x)) for x in thresholds]), F.col("since") + 1, F.col("until") - F.col("since")))
    return met.select(cuts.alias("threshold"), "project", "cluster", F.col("_leaf").alias("leaf"))


def cut_tree(merges: DataFrame, threshold: float) -> DataFrame:
    """(project, cluster, leaf) of the tree cut where a merge first exceeds the threshold; unmerged leaves stand alone."""
    return cut_ladder(merges, (threshold,)).drop("threshold")


def node_keys(merges: DataFrame, ordering: str = "simple") -> DataFrame:
    """(project, node, key): the digest of each node's leaves, in natural order (simple) or as they stand in the tree, the first child's before the second's (tree)."""
    if ordering == "simple":
        ids = leaves(merges).groupBy("project", "node").agg(fn.natural_sorted(F.collect_list(F.col("leaf").cast("string"))).alias("ids"))
    elif ordering == "tree":
        t = Tree(merges)
        own = t.labels.where("leaf").select(F.col("id").alias("leaf"), "low", F.col("node").cast("string").alias("name"))
        ids = t.leaves().join(own, "leaf").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("low", "name"))).alias("x"))
        ids = t.named(ids.select("id", F.transform("x", lambda x: x["name"]).alias("ids")), "ids")
    else:
        raise ValueError(f"no such ordering: {ordering}")
    return ids.select("project", "node", fn.cluster_key(F.col("ids")).alias("key"))


def walk_text(merges: DataFrame, enter: Callable[[], Column], leave: Callable[[], Column]) -> DataFrame:
    """(project, node, text) of each root: what ``enter`` and ``leave`` give for its nodes (columns of ``Tree.labels``, score and branch_length of the merge, and _length of
    the merge above), put together in the order of a walk through the tree. A leaf is only entered. One row holds a tree's whole text."""
    long = branch_lengths(merges).select("project", F.col("parent").alias("node"), "score", "branch_length")
    labels = Tree(merges).labels
    rows = labels.join(long, ["project", "node"], "left").join(long.select("project", F.col("node").alias("parent"), F.col("branch_length").alias("_length")), ["project", "parent"], "left")
    second = F.when(F.col("side") == 1, F.lit(",")).otherwise(F.lit(""))
    tokens = rows.select("top", F.explode(F.array(F.struct(F.col("enter").alias("at"), F.concat(second, enter()).alias("token")), F.struct(F.col("leave").alias("at"), F.when(~F.col("leaf"), leave()).alias("token")))).alias("t"))
    text = tokens.where("t.token IS NOT NULL").groupBy("top").agg(F.array_sort(F.collect_list("t")).alias("t")).select("top", F.array_join(F.transform("t", lambda x: x["token"]), "").alias("text"))
    return labels.where("id = top").select("project", "node", "top").join(text, "top").select("project", "node", "text")


def newick(merges: DataFrame) -> DataFrame:
    name = F.col("node").cast("string")
    return walk_text(merges, lambda: F.when(F.col("leaf"), name).otherwise(F.lit("(")), lambda: F.lit(")"))


def newick_lengths(merges: DataFrame) -> DataFrame:
    """As ``(a:l,b:l)cP``: both branches have the length that ``branch_lengths`` gives the merge, and P is the parent's id."""
    name, length = F.col("node").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("_length").cast("string")), F.lit(""))
    return walk_text(merges, lambda: F.when(F.col("leaf"), F.concat(name, length)).otherwise(F.lit("(")), lambda: F.concat(F.lit(")c"), name, length))


def json_tree(merges: DataFrame) -> DataFrame:
    """Nested {"id", "name", "score", "data": {"branch_length"}, "children"}; a leaf has neither score nor data. Ids are escaped."""
    name = F.regexp_replace(F.to_json(F.array(F.col("node").cast("string"))), r"^\[|\]$", "")
    number = lambda x: F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("null")).otherwise(x.cast("string")), F.lit("null"))
    named = F.concat(F.lit('{"id":'), name, F.lit(',"name":'), name)
    data = F.concat(F.lit(',"score":'), number(F.col("score")), F.lit(',"data":{"branch_length":'), number(F.col("branch_length")), F.lit("}"))
    return walk_text(merges, lambda: F.concat(named, F.when(F.col("leaf"), F.lit(',"children":[]}')).otherwise(F.concat(data, F.lit(',"children":[')))), lambda: F.lit("]}"))
