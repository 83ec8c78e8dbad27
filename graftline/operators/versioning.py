"""Versions of graphs and hierarchies: a graph of commits whose deltas are rows added and removed.

A delta is two tables for each table of the state, written in the shared folder. Inverting swaps them, composing nets them out, and merging applies those
of one branch to the other: every step is a join on whole rows, whatever the size of the graph. The commits themselves are few and live on the driver."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators.hierarchies import Hierarchy
from graftline.operators.rewrite import Rule, rewrite
from graftline.sources.exports import written

PARTS = ("nodes", "edges", "node_attrs", "edge_attrs")
State = dict[str, DataFrame]


@dataclass(frozen=True)
class Delta:
    added: State
    removed: State

    def inverted(self) -> Delta:
        return Delta(self.removed, self.added)

    def apply(self, state: State) -> State:
        """State without the removed rows, with the added ones; tables of neither side count as empty."""
        out = dict(state)
        for t, rows in self.removed.items():
            if t in out:
                out[t] = _without(out[t], rows)
        for t, rows in self.added.items():
            out[t] = out[t].unionByName(rows).distinct() if t in out else rows
        return out

    def then(self, other: Delta) -> Delta:
        """Both, one after the other: a row that one adds and the next removes, or the other way round, is in neither."""
        net = lambda a, b, c: {t: rows for t in a.keys() | c.keys() if (rows := _net(a.get(t), b.get(t), c.get(t))) is not None}
        return Delta(net(self.added, other.removed, _less(other.added, self.removed)), net(self.removed, other.added, _less(other.removed, self.added)))


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def _less(a: State, b: State) -> State:
    return {t: _without(x, b[t]) if t in b else x for t, x in a.items()}


def _net(a: DataFrame | None, minus: DataFrame | None, plus: DataFrame | None) -> DataFrame | None:
    if a is not None and minus is not None:
        a = _without(a, minus)
    return plus if a is None else a if plus is None else a.unionByName(plus).distinct()


def difference(old: State, new: State) -> Delta:
    side = lambda a, b: {t: written(_without(x, b[t]) if t in b else x, "delta") for t, x in a.items()}
    return Delta(side(new, old), side(old, new))


@dataclass(frozen=True)
class Commit:
    id: str
    branch: str
    message: str
    parents: tuple[str, ...]
    time: datetime


class Versions:
    """Commits, branches, merges and rollback over the state of something that says how it is read and put back (state, restore)."""

    def __init__(self, branch: str = "master") -> None:
        self.commits: dict[str, Commit] = {}
        self.deltas: dict[tuple[str, str], Delta] = {}  # (parent, child)
        self.current = branch
        self.heads = {branch: self._add("initial commit", ())}
        self._hold()

    def _hold(self) -> None:
        self.held: State = {t: written(x, "state") for t, x in self.state().items()}

    def state(self) -> State:
        raise NotImplementedError

    def restore(self, state: State) -> None:
        raise NotImplementedError

    def _add(self, message: str, parents: tuple[str, ...]) -> str:
        c = Commit(uuid.uuid4().hex, self.current, message, parents, datetime.now(timezone.utc))
        self.commits[c.id] = c
        return c.id

    def _put(self, state: State) -> None:
        self.held = {t: written(x, "state") for t, x in state.items()}
        self.restore(self.held)

    def commit(self, message: str = "") -> str:
        """Records what has changed since the last commit of the branch."""
        head, new = self.heads[self.current], {t: written(x, "state") for t, x in self.state().items()}
        delta = difference(self.held, new)
        self.heads[self.current] = c = self._add(message, (head,))
        self.deltas[head, c] = delta
        self.held = new
        self.restore(new)
        return c

    def branches(self) -> list[str]:
        return sorted(self.heads)

    def branch(self, name: str) -> str:
        """A new branch from here, which becomes the current one."""
        if name in self.heads:
            raise ValueError(f"branch {name} exists")
        head, self.current = self.heads[self.current], name
        self.heads[name] = c = self._add(f"branch {name}", (head,))
        self.deltas[head, c] = Delta({}, {})
        return c

    def _ancestors(self, commit: str) -> dict[str, int]:
        """Commits that lead to this one and how many steps back they are."""
        out, left = {commit: 0}, [commit]
        while left:
            x = left.pop(0)
            for p in self.commits[x].parents:
                if p not in out:
                    out[p] = out[x] + 1
                    left.append(p)
        return out

    def _base(self, a: str, b: str) -> str:
        one, two = self._ancestors(a), self._ancestors(b)
        return min(one.keys() & two.keys(), key=lambda c: (one[c] + two[c], c))

    def delta(self, source: str, target: str) -> Delta:
        """From one commit to another: back to their nearest common ancestor, then forward."""
        base = self._base(source, target)
        out = Delta({}, {})
        for end, back in ((source, True), (target, False)):
            path, at = [], end
            while at != base:
                up = next(p for p in self.commits[at].parents if base in self._ancestors(p))
                path.append((up, at))
                at = up
            for step in path if back else reversed(path):
                d = self.deltas[step]
                out = out.then(d.inverted() if back else d)
        return out

    def switch_branch(self, name: str) -> None:
        if name not in self.heads:
            raise ValueError(f"no branch {name}")
        self._put(self.delta(self.heads[self.current], self.heads[name]).apply(self.held))
        self.current = name

    def merge_with(self, name: str, message: str = "") -> str:
        """What the branch has done since it parted is done here too, and the branch ends. A row that either side removed is gone; edges, attributes,
        typings and relations that have lost an end go with it."""
        mine, other = self.heads[self.current], self.heads[name]
        state = self.whole(self.delta(self._base(mine, other), other).apply(self.held))
        state = {t: written(x, "state") for t, x in state.items()}
        c = self._add(message or f"merge {name}", (mine, other))
        self.deltas[mine, c] = difference(self.held, state)
        there = self.delta(mine, other).apply(self.held)
        self.deltas[other, c] = difference(there, state)
        self.heads[self.current] = c
        del self.heads[name]
        self.held = state
        self.restore(state)
        return c

    def whole(self, state: State) -> State:
        return state

    def rollback(self, commit: str) -> None:
        """Back to a commit that led to this branch's head; commits after it that no other branch needs are forgotten."""
        head = self.heads[self.current]
        if commit not in self._ancestors(head):
            raise ValueError("only commits that led here can be returned to")
        self._put(self.delta(head, commit).apply(self.held))
        self.heads[self.current] = commit
        needed = set().union(*[self._ancestors(c) for c in self.heads.values()])
        self.commits = {k: v for k, v in self.commits.items() if k in needed}
        self.deltas = {k: v for k, v in self.deltas.items() if k[1] in needed}

    def export(self, spark, path: str) -> None:
        """Writes the history: a document of commits and heads, and the deltas' rows as JSON lines. The state itself isn't in it."""
        time = "%d/%m/%Y %H:%M:%S"  # fixed value: the format of times, in whole seconds
        commits = [{"id": c.id, "branch": c.branch, "message": c.message, "parents": list(c.parents), "time": c.time.strftime(time)} for c in self.commits.values()]
        doc = json.dumps({"current": self.current, "heads": self.heads, "commits": commits})
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/history")
        parts = [_delta_rows(spark, a, b, side, t, rows) for (a, b), d in self.deltas.items() for side, tables in (("added", d.added), ("removed", d.removed)) for t, rows in tables.items()]
        none = spark.createDataFrame([], "parent string, child string, side string, part string, row string")
        for rows in parts:
            none = none.unionByName(rows)
        none.write.mode("overwrite").json(f"{path}/deltas")

    def load_history(self, spark, path: str) -> None:
        """Takes over a history that export() wrote; what is versioned must be in the state of its current head."""
        doc = json.loads(spark.read.text(f"{path}/history").first().value)
        self.current, self.heads = doc["current"], doc["heads"]
        at = lambda x: datetime.strptime(x, "%d/%m/%Y %H:%M:%S").replace(tzinfo=timezone.utc)
        self.commits = {c["id"]: Commit(c["id"], c["branch"], c["message"], tuple(c["parents"]), at(c["time"])) for c in doc["commits"]}
        rows = written(spark.read.schema("parent string, child string, side string, part string, row string").json(f"{path}/deltas"), "deltas")
        there = {(r.parent, r.child, r.side, r.part) for r in rows.select("parent", "child", "side", "part").distinct().collect()}
        self.deltas = {(p, c.id): Delta({}, {}) for c in self.commits.values() for p in c.parents}
        for a, b, side, part in there:
            own = rows.filter((F.col("parent") == a) & (F.col("child") == b) & (F.col("side") == side) & (F.col("part") == part))
            getattr(self.deltas[a, b], side)[part] = own.select(F.from_json("row", _columns(part)).alias("x")).select("x.*")
        self._hold()

    def history(self, spark) -> DataFrame:
        rows = [(c.id, c.branch, c.message, list(c.parents), c.time) for c in self.commits.values()]
        return spark.createDataFrame(rows, "commit_id string, branch string, message string, parents array<string>, time timestamp").orderBy("time")


#: Columns of the tables of a state, by the last part of their name or the first.
COLUMNS = {"nodes": "node_id string", "edges": "src string, dst string", "node_attrs": "node_id string, key string, value string", "edge_attrs": "src string, dst string, key string, value string", "typing": "old string, new string", "relation": "left string, right string", "catalogue": "kind string, a string, b string, attrs string"}


def _columns(part: str) -> str:
    first = part.split("/")[0]
    return COLUMNS[first if first in ("typing", "relation", "catalogue") else part.rsplit("/", 1)[-1]]


def _delta_rows(spark, parent: str, child: str, side: str, part: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), F.lit(side).alias("side"), F.lit(part).alias("part"), F.to_json(F.struct(*rows.columns)).alias("row"))


def _graph_state(g: Graph, name: str) -> State:
    return {f"{name}/{p}": getattr(g, p) for p in PARTS}


def _graph_of(state: State, name: str) -> Graph:
    return Graph(*[state[f"{name}/{p}"] for p in PARTS])


def _whole_graph(g: Graph) -> Graph:
    """Without edges and attributes that have lost an end."""
    g = g._on(g.nodes)
    return g.with_(edge_attrs=g.edge_attrs.join(g.edges, ["src", "dst"], "left_semi"))


class VersionedGraph(Versions):
    def __init__(self, graph: Graph, branch: str = "master") -> None:
        self.graph = graph
        super().__init__(branch)

    def state(self) -> State:
        return _graph_state(self.graph, "g")

    def restore(self, state: State) -> None:
        self.graph = _graph_of(state, "g")

    def whole(self, state: State) -> State:
        return _graph_state(_whole_graph(_graph_of(state, "g")), "g")

    def rewrite(self, rule: Rule, instance: dict[str, str], message: str = "") -> tuple[dict[str, str], str]:
        self.graph, to = rewrite(self.graph, rule, instance)
        return to, self.commit(message)


class VersionedHierarchy(Versions):
    """The state has a catalogue of graphs, typings and relations with their attributes, so that commits know which there were."""

    def __init__(self, hierarchy: Hierarchy, branch: str = "master") -> None:
        self.hierarchy = hierarchy
        super().__init__(branch)

    def state(self) -> State:
        h = self.hierarchy
        said = lambda x: json.dumps(x or {}, sort_keys=True)
        rows = [("graph", n, "", said(h.attrs.get(n))) for n in h.graphs] + [("typing", *k, said(h.typing_attrs.get(k))) for k in h.typings] + [("relation", *k, said(h.relation_attrs.get(k))) for k in h.relations]
        out = {"catalogue": _spark().createDataFrame(rows, COLUMNS["catalogue"])}
        out |= {f"graph/{k}": v for name, g in h.graphs.items() for k, v in _graph_state(g, name).items()}
        return out | {f"typing/{s}/{t}": m for (s, t), m in h.typings.items()} | {f"relation/{a}/{b}": m for (a, b), m in h.relations.items()}

    def restore(self, state: State) -> None:
        h, rows = self.hierarchy, state["catalogue"].orderBy("kind", "a", "b").collect()  # as many as there are graphs and maps between them
        kind = lambda x: {(r.a, r.b): json.loads(r.attrs) for r in rows if r.kind == x}
        h.attrs = {a: attrs for (a, _), attrs in kind("graph").items()}
        h.graphs = {a: _graph_of(state, f"graph/{a}") for a in h.attrs}
        h.typing_attrs, h.relation_attrs = ({k: v for k, v in kind(x).items() if v} for x in ("typing", "relation"))
        h.typings = {(s, t): state[f"typing/{s}/{t}"] for s, t in kind("typing")}
        h.relations = {(a, b): state[f"relation/{a}/{b}"] for a, b in kind("relation")}

    def whole(self, state: State) -> State:
        """Without rows that have lost an end, and without typings and relations of graphs that are gone."""
        rows = state["catalogue"].collect()
        graphs = {r.a for r in rows if r.kind == "graph"}
        kept = [r for r in rows if r.kind == "graph" or {r.a, r.b} <= graphs]
        out = dict(state) | {"catalogue": _spark().createDataFrame(kept, COLUMNS["catalogue"])}
        for name in graphs:
            out |= _graph_state(_whole_graph(_graph_of(state, f"graph/{name}")), f"graph/{name}")
        for r in kept:
            if r.kind != "graph":
                a, b = ("old", "new") if r.kind == "typing" else ("left", "right")
                key = f"{r.kind}/{r.a}/{r.b}"
                one, two = out[f"graph/{r.a}/nodes"].withColumnRenamed("node_id", a), out[f"graph/{r.b}/nodes"].withColumnRenamed("node_id", b)
                out[key] = out[key].join(one, a, "left_semi").join(two, b, "left_semi").select(a, b)
        return out

    def rewrite(self, graph: str, rule: Rule, instance: dict[str, str], message: str = "", **control) -> tuple[dict[str, str], str]:
        to = self.hierarchy.rewrite(graph, rule, instance, **control)
        return to, self.commit(message)


def _spark() -> SparkSession:
    return SparkSession.getActiveSession()
