"""Blast radius, chains and importers: breadth-first walks over the code edges, for many
roots at once.

What a walk may do at a symbol (follow an edge, inherit through its class, go through an
interface or a barrel's alias) is laid out once a snapshot as a table of steps. A layer is
then one join of the frontier with the steps, one aggregation that picks each node's best
arrival, and one anti-join with what was seen; roots are a column, so a thousand walks are
one plan. Layers are written to the shared folder, which keeps plans short
and survives lost executors.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import edge_rank
from ..shared import written

#: Rounds of a fixpoint after which what was seen is written as one table again.
COMPACT = 8
#: Walks still going, up to which their roots are broadcast to leave out what ended walks have seen.
LIVE = 100_000
NAME = r"^sym:((?:(?!::).)*)::(.+)$"


def file_of_symbol(id_: Column) -> Column:
    return F.regexp_extract(id_, NAME, 1)


def name_of_symbol(id_: Column) -> Column:
    return F.regexp_extract(id_, NAME, 2)


def container(id_: Column) -> Column:
    """``sym:f::A.b`` of ``sym:f::A.b.c``; null for what has no member part."""
    name = name_of_symbol(id_)
    inside = F.when(name.contains("."), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))
    return F.when(inside.isNotNull(), F.concat(F.lit("sym:"), file_of_symbol(id_), F.lit("::"), inside))


def walked(edges: DataFrame) -> DataFrame:
    """The edges that walks follow, with ``passed`` (handed over, not called) and ``rank``."""
    code = F.col("kind").isin("Calls", "Extends")
    named = F.col("kind").isin("References", "Implements") & F.col("target").startswith("sym:")
    return edges.where(code | named).withColumn("passed", F.col("context") == "arg").withColumn("rank", edge_rank())


def _fixpoint(start: DataFrame, grow, key: list[str]) -> DataFrame:
    """``start`` and all that ``grow(frontier)`` adds, each ``key`` at its first round (``hop``).

    It ends when a round adds nothing: keys are made of the graph's own names, so there are
    only so many, and cycles come back to seen ones."""
    seen, hop = written(start.withColumn("hop", F.lit(0)), "walk"), 0
    frontier = seen
    while not frontier.isEmpty():
        hop += 1
        new = grow(frontier).dropDuplicates(key).join(seen.select(*key), key, "left_anti")
        frontier = written(new.withColumn("hop", F.lit(hop)), "walk")
        seen = seen.unionByName(frontier)
        if hop % COMPACT == 0:
            seen = written(seen, "seen")
    return seen


def members(edges: DataFrame) -> DataFrame:
    """``id, member, hop``: every symbol a type declares, at any depth."""
    own = edges.where((F.col("kind") == "Declares") & F.col("target").startswith("sym:") & F.col("source").startswith("sym:"))
    own = own.select(F.col("source").alias("id"), F.col("target").alias("member")).distinct()
    start = own.where("id != member")
    nxt = own.select(F.col("id").alias("member"), F.col("member").alias("deeper"))
    grow = lambda f: f.join(nxt, "member").where("deeper != id").select("id", F.col("deeper").alias("member"))
    return _fixpoint(start, grow, ["id", "member"])


def reexports(edges: DataFrame) -> DataFrame:
    """``barrel, file, original, exported``: one row a name; ``*`` stands for all."""
    out = edges.where("kind = 'ReExports'").select(
        F.regexp_replace("source", "^file:", "").alias("barrel"), F.regexp_replace("target", "^file:", "").alias("file"),
        F.explode(F.split("context", r"\s*,\s*")).alias("entry"),
    )
    pair = F.split(F.trim("entry"), r"\s+as\s+")
    return out.where("trim(entry) != ''").select(
        "barrel", "file", pair[0].alias("original"), F.element_at(pair, -1).alias("exported")
    ).distinct()


def _head(name: Column) -> Column:
    return F.split(name, r"\.", 2)[0]


def _rebased(name: Column, head: Column) -> Column:
    """``name`` with its first segment replaced."""
    return F.when(name.contains("."), F.concat(head, F.lit("."), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1))).otherwise(head)


def aliases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, alias, hop``: every name a barrel gives a symbol, through chains of re-exports."""
    re_ = written(reexports(edges), "reexports")
    if re_.isEmpty():
        return nodes.select("id", F.col("id").alias("alias"), F.lit(0).alias("hop")).limit(0)
    start = nodes.where("kind = 'Symbol'").select("id", F.col("file").alias("at"), name_of_symbol(F.col("id")).alias("name"))
    start = start.join(re_.select(F.col("file").alias("at")).distinct(), "at", "left_semi").select("id", "at", "name")

    def grow(f: DataFrame) -> DataFrame:
        hit = f.join(re_, f["at"] == re_["file"]).where((F.col("original") == "*") | (F.col("original") == _head(F.col("name"))))
        new = F.when(F.col("original") == "*", F.col("name")).otherwise(_rebased(F.col("name"), F.col("exported")))
        return hit.select("id", F.col("barrel").alias("at"), new.alias("name"))

    found = _fixpoint(start, grow, ["id", "at", "name"]).where("hop > 0")
    return found.select("id", F.concat(F.lit("sym:"), "at", F.lit("::"), "name").alias("alias"), "hop")


def declared_behind(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, exact``: the node each of ``ids (id)`` is or stands for through re-exports; no row if
    there is none."""
    known = nodes.select(F.col("id").alias("exact"))
    direct = ids.select("id").distinct().join(known, F.col("id") == F.col("exact"))
    rest = ids.select("id").distinct().join(direct.select("id"), "id", "left_anti").where(F.col("id").startswith("sym:"))
    re_ = written(reexports(edges), "reexports")
    if re_.isEmpty():
        return direct.select("id", "exact")
    start = rest.select("id", file_of_symbol(F.col("id")).alias("at"), name_of_symbol(F.col("id")).alias("name"))

    def grow(f: DataFrame) -> DataFrame:
        hit = f.join(re_, f["at"] == re_["barrel"]).where((F.col("exported") == "*") | (F.col("exported") == _head(F.col("name"))))
        new = F.when(F.col("original") == "*", F.col("name")).otherwise(_rebased(F.col("name"), F.col("original")))
        return hit.select("id", re_["file"].alias("at"), new.alias("name"))

    found = _fixpoint(start, grow, ["id", "at", "name"]).where("hop > 0")
    found = found.select("id", "hop", F.concat(F.lit("sym:"), "at", F.lit("::"), "name").alias("exact")).join(known, "exact")
    found = found.groupBy("id").agg(F.min(F.struct("hop", "exact")).alias("b")).select("id", "b.exact")
    return direct.select("id", "exact").unionByName(found)


def canonical(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, canonical``: as ``declared_behind``, else the nearest container that has one."""
    out, todo = [], ids.select("id", F.col("id").alias("at")).distinct()
    while True:  # each round drops a part of every name that is left
        hit = todo.join(declared_behind(nodes, edges, todo.select(F.col("at").alias("id"))).withColumnRenamed("id", "at"), "at")
        out.append(hit.select("id", F.col("exact").alias("canonical")))
        todo = todo.join(hit.select("id"), "id", "left_anti").select("id", container(F.col("at")).alias("at")).where("at is not null")
        todo = written(todo, "todo")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def dispatch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``member, contract``: ``C.m`` and the ``I.m`` it stands behind, both declared."""
    impl = edges.where((F.col("kind") == "Implements") & F.col("target").startswith("sym:"))
    impl = impl.select(F.col("source").alias("class"), F.col("target").alias("interface")).distinct()
    own = nodes.where("kind = 'Symbol'").select(F.col("id").alias("member"), container(F.col("id")).alias("class"))
    own = own.where("class is not null").withColumn("leaf", F.regexp_extract("member", r"\.([^.]*)$", 1))
    both = own.join(impl, "class").withColumn("contract", F.concat("interface", F.lit("."), "leaf"))
    return both.select("member", "contract").join(nodes.select(F.col("id").alias("contract")), "contract", "left_semi")


class Snapshot:
    """A graph with what its walks need, each table laid out and written when first asked for."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> Snapshot:
        return Snapshot(written(nodes, "nodes"), written(edges, "edges"))

    @cached_property
    def members(self) -> DataFrame:
        return written(members(self.edges), "members")

    @cached_property
    def aliases(self) -> DataFrame:
        return written(aliases(self.nodes, self.edges), "aliases")

    @cached_property
    def dispatch(self) -> DataFrame:
        return written(dispatch(self.nodes, self.edges), "dispatch")

    @cached_property
    def up(self) -> DataFrame:
        """at, other, kind, passed, part, rank, goes_on"""
        return written(_up_steps(self.nodes, self.edges, self.aliases, self.dispatch), "up")

    @cached_property
    def down(self) -> DataFrame:
        """at, other, kind, passed, part, rank, goes_on"""
        return written(_down_steps(self.nodes, self.edges, self.members, self.dispatch), "down")


def _up_steps(nodes: DataFrame, edges: DataFrame, alias: DataFrame, disp: DataFrame) -> DataFrame:
    w = walked(edges)
    direct = w.select(F.col("target").alias("at"), F.col("source").alias("other"), "kind", "passed", F.lit(0).alias("part"), "rank")
    ids = nodes.where("kind = 'Symbol'").select(F.col("id").alias("at")).unionByName(w.select(F.col("target").alias("at")))
    ids = ids.unionByName(alias.select(F.col("alias").alias("at"))).where(F.col("at").contains(".")).distinct()
    inside = ids.withColumn("class", container(F.col("at"))).where("class is not null")
    heirs = w.where(F.col("kind").isin("Extends", "Implements")).withColumnRenamed("target", "class")
    through = inside.join(heirs, "class").select(
        "at", F.col("source").alias("other"), "kind", "passed", F.lit(1).alias("part"), "rank"
    )
    names = disp.select(F.col("member").alias("at"), F.col("contract").alias("name"), F.lit(2).alias("part"))
    more = disp.join(alias, disp["contract"] == alias["id"]).select(F.col("member").alias("at"), F.col("alias").alias("name"), (F.lit(2) + F.col("hop")).alias("part"))
    called = names.unionByName(more).join(w, F.col("name") == w["target"]).select(
        "at", F.col("source").alias("other"), "kind", "passed", "part", "rank"
    )
    return _going(direct.unionByName(through).unionByName(called).withColumn("goes_on", F.lit(True)))


def _going(steps: DataFrame) -> DataFrame:
    """``steps``, of which only those go on that end where another step starts: a walk's layer then
    hands on no nodes that lead nowhere."""
    starts = steps.select(F.col("at").alias("other")).distinct().withColumn("_more", F.lit(True))
    out = steps.join(starts, "other", "left").withColumn("goes_on", F.col("goes_on") & F.col("_more").isNotNull())
    return out.select(*steps.columns)


def _down_steps(nodes: DataFrame, edges: DataFrame, member: DataFrame, disp: DataFrame) -> DataFrame:
    w = walked(edges).select(F.col("source").alias("from"), "target", "kind", "passed", "rank")
    targets = written(w.select(F.col("target").alias("id")).distinct(), "targets")
    exact = written(declared_behind(nodes, edges, targets), "exact")
    folded = canonical(nodes, edges, targets.join(exact.select("id"), "id", "left_anti"))
    lands = exact.select(F.col("id").alias("target"), F.col("exact").alias("other"), F.lit(True).alias("goes_on"))
    lands = lands.unionByName(folded.select(F.col("id").alias("target"), F.col("canonical").alias("other"), F.lit(False).alias("goes_on")))
    lands = targets.withColumnRenamed("id", "target").join(lands, "target", "left").select(
        "target", F.coalesce("other", "target").alias("other"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"), F.lit(0).alias("extra")
    )
    runs = lands.where("goes_on").join(disp, F.col("other") == disp["contract"]).select(
        "target", F.col("member").alias("other"), F.lit(True).alias("goes_on"), F.lit(1).alias("extra")
    )
    hops = w.join(lands.unionByName(runs), "target")
    own = hops.select(F.col("from").alias("at"), "other", "kind", "passed", F.col("extra").alias("part"), "rank", "goes_on")
    if member.isEmpty():  # else all hops are laid out once more
        return own
    inner = member.join(hops, member["member"] == hops["from"]).select(
        F.col("id").alias("at"), "other", "kind", "passed", (F.col("hop") * 2 + 2 + F.col("extra")).alias("part"), "rank", "goes_on"
    )
    return own.unionByName(inner)


def seeds(snap: Snapshot, roots: DataFrame) -> DataFrame:
    """``root, at, pos``: each root, its members, and the aliases of all, in that order."""
    own = roots.select("root", F.col("root").alias("at"), F.lit(0).alias("pos")).distinct()
    inner = own.join(snap.members, own["root"] == snap.members["id"]).select("root", F.col("member").alias("at"), (F.col("hop") + 1).alias("pos"))
    both = own.unionByName(inner)
    named = both.join(snap.aliases, both["at"] == snap.aliases["id"]).select("root", F.col("alias").alias("at"), (F.col("pos") + 100 + F.col("hop")).alias("pos"))
    return both.unionByName(named).groupBy("root", "at").agg(F.min("pos").alias("pos"))


def undeclared(snap: Snapshot, seed: DataFrame) -> DataFrame:
    """``root, at, via``: walked targets ``X.m…`` that no node declares, for the longest seed X.

    A target is joined on each of its own containers, so a prefix is an equi-join."""
    free = walked(snap.edges).select(F.col("target").alias("at")).where(F.col("at").contains(".")).distinct()
    free = free.join(snap.nodes.select(F.col("id").alias("at")), "at", "left_anti").where(F.col("at").startswith("sym:"))
    parts = F.split(name_of_symbol(F.col("at")), r"\.")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.lit("sym:"), file_of_symbol(F.col("at")), F.lit("::"), F.array_join(F.slice(parts, F.lit(1), i), ".")),
    )
    under = free.where(F.size(parts) > 1).select("at", F.explode(heads).alias("via"))
    hit = under.join(seed.select("root", F.col("at").alias("via")), "via").join(seed.select("root", "at"), ["root", "at"], "left_anti")
    return hit.groupBy("root", "at").agg(F.max_by("via", F.length("via")).alias("via"))


def walk(snap: Snapshot, roots: DataFrame, depth: int = 3, up: bool = True) -> DataFrame:
    """``root, id, depth, kind, via, passed`` for ``roots (root)``: every node once, at its
    shallowest depth, by a call rather than a hand-over, from the first of its frontier."""
    if depth < 1:
        raise ValueError("depth starts at 1")
    steps = snap.up if up else snap.down
    start = seeds(snap, roots).withColumn("via", F.col("at"))
    if up:
        extra = undeclared(snap, start).withColumn("pos", F.lit(10_000))
        start = start.unionByName(extra.select(*start.columns))
    frontier = written(start, "frontier")
    seen, out = frontier.select("root", F.col("at").alias("id")), []
    for d in range(1, depth + 1):
        hit = frontier.join(steps, "at").withColumnRenamed("other", "id")
        best = F.min(F.struct("passed", "pos", "at", "part", "rank", "kind", "via")).alias("b")
        hit = hit.repartition("root", "id")  # a minimum of structs sorts its rows: once, after the shuffle
        new = hit.groupBy("root", "id").agg(best, F.max("goes_on").alias("open")).join(seen, ["root", "id"], "left_anti")
        new = new.select("root", "id", F.lit(d).alias("depth"), "b.kind", "b.via", "b.passed", "open")
        new = written(new, "layer")
        out.append(new.drop("open"))
        if d == depth:
            break
        live = written(new.where("open").select("root").distinct(), "live")
        going = live.count()
        if not going:
            break
        seen = seen.unionByName(new.select("root", "id"))
        if going <= LIVE:
            seen = seen.join(F.broadcast(live), "root", "left_semi")
        frontier = new.where("open").select("root", F.col("id").alias("at"), F.lit(0).alias("pos"), F.col("id").alias("via"))
    return reduce(DataFrame.unionByName, out)


def importers(snap: Snapshot, roots: DataFrame) -> DataFrame:
    """``root, file``: files that import a root's name from its file or a barrel, and the barrels."""
    own = roots.join(snap.nodes.select(F.col("id").alias("root"), "file"), "root")
    names = own.select("root", "file", _head(name_of_symbol(F.col("root"))).alias("name"), F.col("file").alias("home"))
    al = snap.aliases.select(F.col("id").alias("root"), file_of_symbol(F.col("alias")).alias("at"), _head(name_of_symbol(F.col("alias"))).alias("name"))
    named = own.select("root", F.col("file").alias("home")).join(al, "root")
    barrels = named.where("at != home").select("root", F.col("at").alias("file"))
    names = names.select("root", "file", "name").unionByName(named.select("root", F.col("at").alias("file"), "name")).distinct()
    imp = snap.edges.where("kind = 'Imports'").select(
        F.regexp_replace("source", "^file:", "").alias("by"), F.regexp_replace("target", "^file:", "").alias("file"),
        F.explode(F.split("context", r"\s*,\s*")).alias("entry"),
    ).withColumn("name", F.split("entry", r"\s+as\s+")[0])
    exact = imp.join(names, ["file", "name"]).select("root", F.col("by").alias("file"))
    whole = imp.where("name = '*'").drop("name").join(names, "file").select("root", F.col("by").alias("file"))
    return exact.unionByName(whole).unionByName(barrels).distinct()


def files_touched(snap: Snapshot, dependents: DataFrame, importing: DataFrame) -> DataFrame:
    """``root, file``: of the dependents, and those that import."""
    at = snap.nodes.select("id", F.col("file").alias("_file"))
    own = dependents.join(at, "id", "left").select("root", F.coalesce("_file", F.regexp_replace("id", "^file:", "")).alias("file"))
    return own.unionByName(importing.select("root", "file")).distinct()


def risk(direct: Column, files: Column) -> Column:
    return (
        F.when((direct >= 30) | (files >= 25), "CRITICAL").when((direct >= 15) | (files >= 10), "HIGH")
        .when((direct >= 5) | (files >= 3), "MEDIUM").otherwise("LOW")
    )


def layer_name(depth: Column) -> Column:
    return F.when(depth == 1, "will break").when(depth == 2, "likely affected").when(depth == 3, "may need testing").otherwise("transitive")


def impact(snap: Snapshot, roots: DataFrame, depth: int = 3) -> DataFrame:
    """``root, direct, dependents, files, risk``: a row a root."""
    found = walk(snap, roots, depth)
    touched = files_touched(snap, found, importers(snap, roots)).groupBy("root").agg(F.count("*").alias("files"))
    counts = found.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("dependents"))
    out = roots.select("root").distinct().join(counts, "root", "left").join(touched, "root", "left").na.fill(0)
    return out.withColumn("risk", risk(F.col("direct"), F.col("files")))


def _leading_to(snap: Snapshot, goal: DataFrame, depth: int) -> DataFrame:
    """``id``: the goals, and all nodes fewer than ``depth`` steps above one."""
    seen = frontier = written(goal, "leading")
    for _ in range(depth - 1):
        before = snap.down.join(frontier, F.col("other") == F.col("id"), "left_semi").select(F.col("at").alias("id")).distinct()
        frontier = written(before.join(seen, "id", "left_anti"), "leading")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return written(seen, "leading")


def trace(snap: Snapshot, ends: DataFrame, depth: int = 6) -> DataFrame:
    """``from, to, path`` (array of id and passed) for ``ends (from, to)``: the shortest chain down
    from one to the other, a member or an alias of it; no row if there is none.

    Steps that cannot come to any end are left out first: one walk back from all ends, with no
    start beside a node, so it grows with the graph and not with the pairs. Chains of one start
    share a walk: a layer keeps, for each start and node, only the node it was reached from.
    Paths are put together at the end, from their ends back, a join a hop."""
    if depth < 1:
        raise ValueError("depth starts at 1")
    ends = written(ends.select("from", "to").distinct(), "ends")
    goal = seeds(snap, ends.select(F.col("to").alias("root")).distinct()).select(F.col("root").alias("to"), F.col("at").alias("id"))
    steps = snap.down.join(_leading_to(snap, goal.select("id").distinct(), depth), F.col("other") == F.col("id"), "left_semi")
    steps = written(_going(written(steps, "steps")), "steps")
    frontier = ends.select("from", F.col("from").alias("at")).distinct()
    seen, layers = frontier.select("from", F.col("at").alias("id")), []
    for d in range(1, depth + 1):
        hit = frontier.join(steps, "at").withColumnRenamed("other", "id")
        best = F.min(F.struct("at", "passed", "part", "rank")).alias("b")
        hit = hit.repartition("from", "id")
        new = hit.groupBy("from", "id").agg(best, F.max("goes_on").alias("open")).join(seen, ["from", "id"], "left_anti")
        new = written(new.select("from", "id", F.lit(d).alias("hop"), F.col("b.at").alias("via"), F.col("b.passed").alias("passed"), "open"), "layer")
        if new.isEmpty():
            break
        layers.append(new)
        if d == depth or new.where("open").isEmpty():
            break
        seen = seen.unionByName(new.select("from", "id"))
        frontier = new.where("open").select("from", F.col("id").alias("at"))
    start = F.array(F.struct(F.col("from").alias("id"), F.lit(False).alias("passed")))
    own = ends.where("from = to").select("from", "to", start.alias("path"))
    if not layers:
        return own
    every = reduce(DataFrame.unionByName, layers)
    there = ends.where("from != to").join(goal, "to").join(every, ["from", "id"])
    first = there.groupBy("from", "to").agg(F.min(F.struct("hop", "id", "via", "passed")).alias("b"))
    tail = F.array(F.struct(F.col("b.id").alias("id"), F.col("b.passed").alias("passed")))
    paths, out = written(first.select("from", "to", F.col("b.hop").alias("hop"), F.col("b.via").alias("via"), tail.alias("path")), "paths"), [own]
    for d in range(len(layers), 0, -1):
        if d > 1:
            back = layers[d - 2].select("from", F.col("id").alias("via"), F.col("via").alias("_via"), "passed")
            step = F.array(F.struct(F.col("via").alias("id"), "passed"))
            more = paths.where(F.col("hop") == d).join(back, ["from", "via"]).select("from", "to", F.lit(d - 1).alias("hop"), F.col("_via").alias("via"), F.concat(step, "path").alias("path"))
            paths = paths.where(F.col("hop") < d).unionByName(more)
        else:
            out.append(paths.where("hop = 1").select("from", "to", F.concat(start, "path").alias("path")))
    return reduce(DataFrame.unionByName, out)
