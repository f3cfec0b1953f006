"""Trees of selected articles: nodes, descendants, commands on a map, the star graph.

Parent closures are pointer doubling over (map, node, parent) tables of any number of maps at once,
written between rounds; commands that depend on one another are folded per map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .state import folded

#: Fixed values. Depth, nodes and history of a map, maps of a search.
MAX_DEPTH, MAX_NODES, MAX_HISTORY, MAX_MAPS = 5, 100, 100, 10


def star_graph(selected: DataFrame, centre: str = "centre_id", node: str = "news_id", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """nodes (graph, news_id, distance, is_center, relevance_score) and edges; each neighbour is one hop away."""
    mid = selected.select(centre).distinct().select(F.col(centre).alias("graph"), F.col(centre).alias("news_id"), F.lit(0).alias("distance"), F.lit(True).alias("is_center"), F.lit(None).cast("double").alias("relevance_score"))
    rim = selected.select(F.col(centre).alias("graph"), F.col(node).alias("news_id"), F.lit(1).alias("distance"), F.lit(False).alias("is_center"), F.col(score).cast("double").alias("relevance_score"))
    edges = selected.select(F.col(centre).alias("source"), F.col(node).alias("target"), F.lit("related").alias("relation_type"), F.lit(1).alias("distance"))
    return mid.unionByName(rim), edges


def jumps(links: DataFrame, most: int | None, bound: int) -> tuple[list[DataFrame], bool]:
    """(tables m, x, a of a's that are 1, 2, 4, ... links above x, as far as there are any; whether the links run in a circle).

    Each table is the one before it joined with itself and is written; there are about log2 of the depth. Whoever has an ancestor that is as
    many links away as there are rows (bound) comes to a circle.
    """
    out = [links]
    while not out[-1].isEmpty():
        far = 1 << len(out)
        if far > 2 * bound:
            return out, True
        if most is not None and far > most:
            return out, False
        last = out[-1]
        out.append(stored(last.join(last.select("m", F.col("x").alias("a"), F.col("a").alias("__far")), ["m", "a"]).select("m", "x", F.col("__far").alias("a")), "jumps"))
    return out[:-1], False


def without_circles(links: DataFrame, last: DataFrame, bound: int) -> DataFrame:
    """links without the one above the least node of each circle; last: where each x that comes to a circle stands on it."""
    on = last.select("m", F.col("a").alias("x")).distinct()
    step = stored(links.join(on, ["m", "x"], "left_semi").select("m", "x", "a", F.least("x", "a").alias("least")), "circles")
    far = 1
    while far < bound:
        then = step.select("m", F.col("x").alias("a"), F.col("a").alias("__far"), F.col("least").alias("__least"))
        step = stored(step.join(then, ["m", "a"]).select("m", "x", F.col("__far").alias("a"), F.least("least", "__least").alias("least")), "circles")
        far *= 2
    cut = step.where(F.col("x") == F.col("least")).select("m", "x")
    return stored(links.join(cut, ["m", "x"], "left_anti"), "links")


def closure(nodes: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """m, x, a, d: each node x of nodes (m, x) with all a's that are d links (m, x, a) above it, itself at 0; d up to most.

    Pointer doubling: what lies less than 2^r links away, joined with the jumps of 2^r, is what lies from there to less than
    2^(r+1). Each pair is made once, in about log2(depth) rounds. A node has one link at most; a circle is cut above its least node.
    """
    if most is not None and most < 1:
        links = links.where(F.lit(False))
    links = stored(links.select("m", "x", "a"), "links")
    bound = links.count()
    tables, circular = jumps(links, most, bound)
    if circular:
        links = without_circles(links, tables[-1], bound)
        tables, _ = jumps(links, most, bound)
    below = nodes.select("m", "x", F.col("x").alias("a"), F.lit(0).alias("d"))
    for r, table in enumerate(tables):
        more = below.join(table.select("m", F.col("x").alias("a"), F.col("a").alias("__far")), ["m", "a"]).select("m", "x", F.col("__far").alias("a"), (F.col("d") + (1 << r)).alias("d"))
        below = below.unionByName(stored(more if most is None else more.where(F.col("d") <= most), "closure"))
    return below


def descendants(nodes: DataFrame, depth: int | None = None, map_id: str = "map_id", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """map_id, root, node_id, level: all nodes below each node, itself at level 0; of any number of maps, levels and nodes.

    A parent that is not a node of its map has nothing below it; of a circle of parents the least node counts as without a parent.
    """
    own = nodes.select(F.col(map_id).alias("m"), F.col(node).alias("x"))
    links = nodes.where(F.col(parent).isNotNull()).select(F.col(map_id).alias("m"), F.col(node).alias("x"), F.col(parent).alias("a"))
    links = links.join(own.select("m", F.col("x").alias("a")).distinct(), ["m", "a"], "left_semi")
    return closure(own, links, depth).select(F.col("m").alias("map_id"), F.col("a").alias("root"), F.col("x").alias("node_id"), F.col("d").alias("level"))


def ancestors(chain: DataFrame, row_id: str = "map_id", previous: str = "previous_map_id", most: int = MAX_MAPS) -> DataFrame:
    """map_id, ancestor, distance: the maps that came before each map, ``most`` at most; a circle as in descendants."""
    own = chain.select(F.lit(0).alias("m"), F.col(row_id).alias("x"))
    links = chain.where(F.col(previous).isNotNull()).select(F.lit(0).alias("m"), F.col(row_id).alias("x"), F.col(previous).alias("a"))
    return closure(own, links, most).where("d > 0").select(F.col("x").alias("map_id"), F.col("a").alias("ancestor"), F.col("d").alias("distance"))


def map_step(state: dict, row: dict) -> dict:
    """create, expand, research, select, reset, delete of a map at an expected revision.

    expand adds children below a node, research replaces its children unless nothing was found,
    select keeps visible ids, reset leaves the centre with fresh children under new numbers.
    """
    if state.get("deleted"):
        return {"code": "gone", "revision": state["rev"], "nodes": 0, "visible": None}
    kind, found = row["command"], list(row["found"]) if row["found"] is not None else []
    if kind == "create":
        if "rev" in state:
            return {"code": "exists", "revision": state["rev"], "nodes": len(state["nodes"]), "visible": None}
        state |= {"rev": 1, "seq": 1, "nodes": {}, "history": 0, "chosen": []}
        state["nodes"]["n1"] = (row["article"], None, 0)
        add(state, "n1", found)
    elif "rev" not in state:
        return {"code": "missing", "revision": 0, "nodes": 0, "visible": None}
    elif row["expected"] != state["rev"]:
        return {"code": "revision_conflict", "revision": state["rev"], "nodes": len(state["nodes"]), "visible": None}
    else:
        node = row["node_id"]
        if kind in ("expand", "research"):
            level = state["nodes"][node][2] if node in state["nodes"] else None
            code = "unknown_node" if level is None else "too_deep" if level >= MAX_DEPTH else "history_full" if state["history"] >= MAX_HISTORY else "too_many_nodes" if len(state["nodes"]) + len(found) > MAX_NODES else None
            if code:
                return {"code": code, "revision": state["rev"], "nodes": len(state["nodes"]), "visible": None}
            state["history"] += 1
            if kind == "research" and found:
                drop(state, node)
            add(state, node, found)
        elif kind == "select":
            state["chosen"] = [x for x in found if x in {a for a, _, _ in state["nodes"].values()}]
        elif kind == "reset":
            root = state["nodes"]["n1"]
            state["nodes"] = {"n1": root}
            add(state, "n1", found)
            state["chosen"] = []
        elif kind == "delete":
            state["deleted"] = True
        state["rev"] += 1
    shown = {a for a, _, _ in state["nodes"].values()}
    state["chosen"] = [x for x in state["chosen"] if x in shown]
    return {"code": "ok", "revision": state["rev"], "nodes": len(state["nodes"]), "visible": sorted(shown)}


def add(state: dict, parent: str, articles: list[str]) -> None:
    known = {a for a, _, _ in state["nodes"].values()}
    for article in articles:
        if article not in known:
            state["seq"] += 1
            state["nodes"][f"n{state['seq']}"] = (article, parent, state["nodes"][parent][2] + 1)
            known.add(article)


def drop(state: dict, parent: str) -> None:
    """Remove all that hangs below a node."""
    gone = {parent}
    for name in sorted(state["nodes"], key=lambda n: int(n[1:])):
        if state["nodes"][name][1] in gone:
            gone.add(name)
    for name in gone - {parent}:
        del state["nodes"][name]


def replay(commands: DataFrame, key: str = "map_id", order: str = "seq") -> DataFrame:
    """commands (map_id, seq, command, expected, node_id, article, found) with code, revision, nodes, visible."""
    return folded(commands, [key], [order], map_step, "code string, revision long, nodes int, visible array<string>")


def visible_selection(chosen: Column, visible: Column) -> Column:
    return F.array_intersect(chosen, visible)


def can_find_next(root: Column, finished: Column, status: Column, previous: Column) -> Column:
    """Whether a further issue may be looked for."""
    open_ = root.isNotNull() & ~F.coalesce(finished, F.lit(False))
    return open_ & ((status == "complete") | ((status == "insufficient") & previous.isNotNull()))


def shortage(status: Column, requested: Column, returned: Column) -> Column:
    shown = F.when(status == "expandable", "insufficient").otherwise(status)
    return F.struct(shown.alias("status"), requested.alias("requested"), returned.alias("returned"), (returned < requested).alias("shortage"))


def search_group(issue_search: Column, map_id: Column) -> Column:
    return F.coalesce(issue_search, map_id)


def without_search(maps: DataFrame, gone: DataFrame) -> DataFrame:
    """maps without those of the searches in gone (column search_id)."""
    keyed = maps.withColumn("__search", search_group(F.col("issue_search_id"), F.col("map_id")))
    return keyed.join(gone.select(F.col("search_id").alias("__search")).distinct(), "__search", "left_anti").drop("__search")


