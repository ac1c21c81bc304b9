"""Queries over a property graph of nodes and edges; edges are a bag, ids are resolved by key.

Scans of one hop are joins. Closures run frontier by frontier: each hop joins the frontier only, anti-joins what was
visited, and is checkpointed, so neither plans nor executors carry the whole history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gneiss.functions.text import clean_path
from gneiss.session import cut


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the one with the largest path and lines, a fixed stand-in for the last one written."""
    rest = [c for c in nodes.columns if c != "id"]
    top = nodes.groupBy("id").agg(F.max(F.struct("file_path", "start_line", "end_line", *[c for c in rest if c not in ("file_path", "start_line", "end_line")])).alias("r"))
    return top.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, type, n): counts of nodes and edges by type."""
    side = lambda df, name: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "type", "n")
    return side(nodes, "node").unionByName(side(edges, "edge"))


def lookup(nodes: DataFrame, name: str, type_: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose name contains a text in any case, of a type if given; the first by id."""
    found = nodes.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if type_:
        found = found.where(F.col("type") == type_)
    return found.orderBy("id", "file_path", "start_line").limit(limit)


def file_entities(nodes: DataFrame, path_part: str, limit: int = 100) -> DataFrame:
    found = nodes.where(F.contains(F.lower("file_path"), F.lit(path_part.lower())))
    return found.orderBy("start_line", "id", "file_path").limit(limit)


def search(nodes: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """Nodes that hold a text in name, path or properties."""
    t = F.lit(text.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), t)
    return nodes.where(has("name") | has("file_path") | has("props")).orderBy("id", "file_path", "start_line").limit(limit)


def resolve(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(name, id): the node each given name means: an exact match first, else one that contains it; then the smallest id."""
    asked = F.explode(F.array(*[F.lit(n) for n in names]))
    hits = nodes.select("id", F.col("name").alias("n_"), asked.alias("name")).where(F.contains(F.lower("n_"), F.lower("name")))
    best = hits.groupBy("name").agg(F.min(F.struct((F.col("n_") != F.col("name")).cast("int").alias("loose"), "id")).alias("m"))
    return best.select("name", F.col("m.id").alias("id"))


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, caller_id, caller_name, n_calls) of every called target; a caller that calls twice counts twice."""
    calls = edges.where("type = 'CALLS'").groupBy("source", "target").agg(F.count("*").alias("n_calls"))
    own = unique_nodes(nodes).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    return calls.join(own, calls.source == own.caller_id).select("target", "caller_id", "caller_name", "n_calls")


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, callee_id, callee_name, n_calls) of every caller."""
    calls = edges.where("type = 'CALLS'").groupBy("source", "target").agg(F.count("*").alias("n_calls"))
    own = unique_nodes(nodes).select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name"))
    return calls.join(own, calls.target == own.callee_id).select("source", "callee_id", "callee_name", "n_calls")


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, source): for every file the distinct sources that call, import or reference its nodes."""
    own = unique_nodes(nodes).select("id", clean_path(F.col("file_path")).alias("file_path"))
    inbound = edges.where(F.col("type").isin("CALLS", "IMPORTS", "REFERENCES")).select("source", "target").distinct()
    return inbound.join(own, inbound.target == own.id).select("file_path", "source").distinct()


def relations(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, n_types): how each node is tied, by a union of both ends instead of a disjunctive join."""
    ends = edges.select(F.col("source").alias("id"), "type", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), "type", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.countDistinct("type").alias("n_types"))


def containing(nodes: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (node_id): the smallest node around (file_path, line). Equi-join on the file, range as its filter."""
    spans = unique_nodes(nodes).select(F.col("id").alias("node_id"), clean_path(F.col("file_path")).alias("p_"), F.col("start_line").alias("a_"), F.col("end_line").alias("b_"))
    at = places.withColumn("p_", clean_path(F.col("file_path")))
    inside = at.join(spans, (at.p_ == spans.p_) & at.line.between(F.col("a_"), F.col("b_")))
    best = F.min(F.struct((F.col("b_") - F.col("a_")).alias("span"), F.col("node_id")))
    return inside.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.node_id").alias("node_id"))


def import_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, target, module): an import's module is its last dotted segment that names one."""
    parts = imports.select("file_id", "target", F.posexplode(F.reverse(F.split(F.regexp_replace("target", r"^[./]+", ""), r"[./]"))).alias("pos", "segment"))
    known = modules.select(F.col("name").alias("segment")).distinct()
    hit = parts.join(known, "segment").groupBy("file_id", "target").agg(F.min(F.struct("pos", "segment")).alias("m"))
    return hit.select("file_id", "target", F.col("m.segment").alias("module"))


def without_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that no CALLS edge of another node reaches."""
    called = edges.where("type = 'CALLS' and source <> target").select(F.col("target").alias("id")).distinct()
    return unique_nodes(nodes).where(F.col("type").isin("function", "method")).join(called, "id", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    tied = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return unique_nodes(nodes).join(tied, "id", "left_anti")


def orphan_edges(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Edges with an end that is neither a node nor a known outside symbol."""
    ids = nodes.select("id").distinct()
    if known is not None:
        ids = ids.unionByName(known.select("id")).distinct()
    lost = edges.join(ids, edges.source == ids.id, "left_anti").unionByName(edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_anti"))
    return lost.select("source", "target", "type", "props")


# closures

#: Ids that are broadcast at most, and arcs that one task takes at most.
FEW, LOCAL_ARCS = 100_000, 500_000


def closure(edges: DataFrame, start: DataFrame, hops: int, backward: bool = False, types: tuple[str, ...] | None = None, stop_above: int | None = None) -> DataFrame:
    """(id, depth): what the start ids reach within some hops, with the fewest hops.

    stop_above: no further hop is made once that many ids are known; checked before each hop, so the result may exceed
    it, as a cap on the work and not on the rows.
    """
    arcs = edges.where(F.col("type").isin(*types)) if types else edges
    a, b = ("target", "source") if backward else ("source", "target")
    arcs = arcs.select(F.col(a).alias("id"), F.col(b).alias("to"))  # a bag: what repeats goes with the ids reached
    known = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, n_new = known, known.count()
    n_known = n_new
    for depth in range(1, hops + 1):
        if stop_above is not None and n_known > stop_above or not n_new:
            break
        # as long as they are few, the frontier and what is known go to the arcs, which are not shuffled
        ahead, behind = (F.broadcast(x) if n <= FEW else x for x, n in ((frontier.select("id"), n_new), (known.select("id"), n_known)))
        frontier = cut(arcs.join(ahead, "id").select(F.col("to").alias("id")).join(behind, "id", "left_anti").distinct().withColumn("depth", F.lit(depth)))
        n_new = frontier.count()
        n_known += n_new
        known = known.unionByName(frontier)
    return known


def entry_chain(nodes: DataFrame, edges: DataFrame, entry: str, hops: int = 8) -> DataFrame:
    """(name, file_path, start_line, depth): functions and methods that an entry, resolved like any name, leads to by calls."""
    functions = unique_nodes(nodes).where(F.col("type").isin("function", "method"))
    reached = closure(edges, resolve(functions, [entry]).select("id"), hops, types=("CALLS",))
    return functions.join(reached, "id").select("name", clean_path(F.col("file_path")).alias("file_path"), "start_line", "depth")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2, type_: str = "CALLS") -> DataFrame:
    """(source, target): the edges of a type met within some undirected hops from the start ids."""
    arcs = edges.where(F.col("type") == type_).select("source", "target").distinct()
    reached = start.select("id").distinct()
    found = None
    for _ in range(depth):
        out = arcs.join(reached, arcs.source == reached.id, "left_semi").unionByName(arcs.join(reached, arcs.target == reached.id, "left_semi")).distinct()
        found = cut(out)
        reached = found.select(F.col("source").alias("id")).unionByName(found.select(F.col("target").alias("id"))).unionByName(reached).distinct()
    return found


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): connected components of undirected pairs (a, b) by min labels with pointer jumping.

    Each round is two joins on checkpointed tables; the number of rounds grows with the log of the diameter.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("via"), F.col("component").alias("further"))
        new = cut(step.join(jump, step.component == jump.via, "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            break
    return labels


def _strong(a: list[str], b: list[str]) -> dict[str, str]:
    """Ids of a bounded number of arcs, with the smallest id of their strong component; Tarjan's walk without recursion."""
    out: dict[str, list[str]] = {}
    for x, y in zip(a, b):
        out.setdefault(x, []).append(y)
    order, low, on, stack, got = {}, {}, set(), [], {}
    for root in out:
        if root in order:
            continue
        walk = [(root, iter(out.get(root, ())))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while walk:
            v, following = walk[-1]
            for w in following:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    walk.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    got.update((w, least) for w in members)
    return got


def in_one_task(arcs: DataFrame, solve: Callable[[list[str], list[str]], dict], schema: str) -> DataFrame:
    """What solve says of all arcs (a, b) together; only for a number of arcs that has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
        found = solve(a, b)
        if found:
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), fields[0].type), pa.array(list(found.values()), fields[1].type)], names=names)

    fields = list(to_arrow_schema(_parse_datatype_string(schema)))
    return arcs.select("a", "b").coalesce(1).mapInArrow(run, schema)


def strong_components(arcs: DataFrame, local: int = LOCAL_ARCS) -> DataFrame:
    """(id, scc): strongly connected components of arcs (a, b), scc being the smallest id of each.

    At most `local` arcs are walked in one task, be it at once or when trimming and colouring have left no more.
    Forward-backward colouring: ids without way in or out are trimmed; the smallest id that reaches a vertex colours it;
    what reaches the colour's own vertex within its colour is one component; the rest goes on.
    """
    left = cut(arcs.where("a <> b").distinct())
    n = left.count()
    every = arcs.select(F.col("a").alias("id")).unionByName(arcs.select(F.col("b").alias("id"))).distinct()
    done = None
    while n:
        if n <= local:
            found = in_one_task(left, _strong, "id string, color string")
            done = found if done is None else done.unionByName(found)
            break
        while n > local:  # trim, two layers a pass
            kept = left
            for _ in range(2):
                inner = kept.select(F.col("a").alias("id")).intersect(kept.select(F.col("b").alias("id")))
                kept = kept.join(inner.select(F.col("id").alias("a")), "a", "left_semi").join(inner.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
            left, was = cut(kept), n
            n = left.count()
            if n == was:
                break
        if n <= local:
            continue
        color = cut(left.select(F.col("a").alias("id")).distinct().withColumn("color", F.col("id")))
        while True:  # forward: the smallest id that reaches each vertex, three steps a pass
            new = color.withColumn("was", F.col("color"))
            for _ in range(3):
                better = left.join(new.select(F.col("id").alias("a"), "color"), "a").groupBy(F.col("b").alias("id")).agg(F.min("color").alias("from"))
                new = new.join(better, "id", "left").select("id", F.least("color", F.coalesce("from", "color")).alias("color"), "was")
            new = cut(new)
            moved = not new.where("color <> was").isEmpty()
            color = new.select("id", "color")
            if not moved:
                break
        within = cut(left.join(color.select(F.col("id").alias("a"), F.col("color").alias("ca")), "a").join(color.select(F.col("id").alias("b"), F.col("color").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("color")))
        found = color.where("id = color")
        frontier = found
        while True:  # backward from each colour's own vertex, two steps a pass
            one = within.join(frontier.select(F.col("id").alias("b"), F.col("color").alias("c_")), "b").where("color = c_").select(F.col("a").alias("id"), "color")
            two = within.join(one.select(F.col("id").alias("b"), F.col("color").alias("c_")), "b").where("color = c_").select(F.col("a").alias("id"), "color")
            frontier = cut(one.unionByName(two).distinct().join(found, ["id", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            found = found.unionByName(frontier)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select(F.col("id").alias("a")), "a", "left_anti").join(found.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
        n = left.count()
    if done is None:
        return every.select("id", F.col("id").alias("scc"))
    return every.join(done, "id", "left").select("id", F.coalesce("color", "id").alias("scc"))


# architecture


def module_of(nodes: DataFrame) -> DataFrame:
    """(id, module): a module is a file, named by its path without extension."""
    return unique_nodes(nodes).select("id", F.regexp_replace(clean_path(F.col("file_path")), r"\.[A-Za-z0-9]+$", "").alias("module"))


def module_arcs(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("CALLS", "IMPORTS", "REFERENCES")) -> DataFrame:
    """(a, b, n): edges between modules; a = b where a module depends on itself."""
    m = module_of(nodes)
    arcs = edges.where(F.col("type").isin(*types)).groupBy("source", "target").agg(F.count("*").alias("n"))
    arcs = arcs.join(m.select(F.col("id").alias("source"), F.col("module").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("b")), "target")
    return arcs.groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Layers by folder, the lowest first; a layer must not depend on a higher one.
LAYERS = {"domain": 0, "core": 0, "lib": 1, "pkg": 1, "internal": 1, "storage": 2, "adapters": 2, "service": 3, "pipeline": 3, "jobs": 3, "handlers": 4, "api": 4, "web": 5, "app": 5, "src": 3, "tools": 5}


def layer(module: Column) -> Column:
    folder = F.split(module, "/").getItem(1)
    names = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    return F.coalesce(names[folder], F.lit(3))


def fan_stats(arcs: DataFrame, god: int = 15) -> DataFrame:
    """(module, fan_out, fan_in, layer, is_god) of every module on either side of an arc."""
    between = arcs.where("a <> b")
    out = between.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("fan_out"))
    into = between.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("fan_in"))
    both = out.join(into, "module", "full_outer").select("module", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    return both.withColumn("layer", layer(F.col("module"))).withColumn("is_god", (F.col("fan_out") > god) | (F.col("fan_in") > god))


def layer_violations(arcs: DataFrame) -> DataFrame:
    """(a, b, layer_a, layer_b): modules that depend on a higher layer."""
    return arcs.where("a <> b").select("a", "b", layer(F.col("a")).alias("layer_a"), layer(F.col("b")).alias("layer_b")).where("layer_a < layer_b")


def large_modules(nodes: DataFrame, above: int = 20) -> DataFrame:
    symbols = unique_nodes(nodes).where("type <> 'module'").join(module_of(nodes), "id")
    return symbols.groupBy("module").agg(F.count("*").alias("n_symbols")).where(F.col("n_symbols") > above)


def health(arcs: DataFrame, scc: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n_cycles, n_violations, n_gods, n_large, score): 10 less capped penalties of 6, 2, 2 and 2, rounded to one digit."""
    loops = arcs.where("a = b").select(F.col("a").alias("scc"))
    cycles = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc").unionByName(loops).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(cycles, "n_cycles").crossJoin(one(layer_violations(arcs), "n_violations")).crossJoin(one(fan_stats(arcs).where("is_god"), "n_gods")).crossJoin(one(large_modules(nodes), "n_large"))  # rows of one number each
    score = 10 - F.least(F.lit(6.0), F.col("n_cycles") * 1.5) - F.least(F.lit(2.0), F.col("n_violations") * 0.1) - F.least(F.lit(2.0), F.col("n_gods") * 0.5) - F.least(F.lit(2.0), F.col("n_large") * 0.2)
    return row.withColumn("score", F.round(F.greatest(F.lit(0.0), score), 1))


def tiers(arcs: DataFrame) -> DataFrame:
    """(module, tier): entry where much more goes out than comes in, infra where the reverse, else business."""
    f = fan_stats(arcs)
    name = F.regexp_extract("module", r"([^/]*)$", 1)
    entry = (F.col("fan_out") > 2 * F.col("fan_in")) | name.rlike("(?:^|_)(?:main|cli|app|server)(?:_|$)")
    infra = (F.col("fan_in") > 2 * F.col("fan_out")) & (F.col("fan_in") >= 2) | name.rlike("(?:^|_)(?:util|utils|common|base|config)(?:_|$)")
    return f.select("module", F.when(entry, "entry").when(infra, "infra").otherwise("business").alias("tier"))


def cross_flows(nodes: DataFrame, edges: DataFrame, names: int = 20) -> DataFrame:
    """(a, b, n_flows, symbols): distinct callees between folders of modules, with the first names."""
    m = module_of(nodes).select("id", F.regexp_replace("module", "/[^/]*$", "").alias("folder"))
    named = unique_nodes(nodes).select("id", "name", "file_path")
    calls = edges.where("type = 'CALLS'").select("source", "target").distinct()
    src = m.join(named.select("id", "file_path"), "id").select(F.col("id").alias("source"), F.col("folder").alias("a"), F.col("file_path").alias("fa"))
    dst = m.join(named, "id").select(F.col("id").alias("target"), F.col("folder").alias("b"), F.col("file_path").alias("fb"), "name")
    flows = calls.join(src, "source").join(dst, "target").where("a <> b").select("a", "b", "fa", "fb", "name").distinct()
    # names repeat across files: the set is of distinct names, pre-aggregated
    return flows.groupBy("a", "b", "name").agg(F.count("*").alias("k")).groupBy("a", "b").agg(F.sum("k").alias("n_flows"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, names), ",").alias("symbols"))


def entry_points(nodes: DataFrame, edges: DataFrame, at_least: int = 2, limit: int = 10) -> DataFrame:
    """The hubs: functions referenced most, at least twice; the first by count and id."""
    n = edges.where(F.col("type").isin("CALLS", "REFERENCES")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_refs")).where(F.col("n_refs") >= at_least)
    return unique_nodes(nodes).where("type = 'function'").join(n, "id").select("id", "name", "n_refs").orderBy(F.desc("n_refs"), "id").limit(limit)


def numbered(df: DataFrame, by: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
