"""Near copies of embeddings: hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards of bounded size by a hash, and each shard gets a graph: layers of ever fewer
vectors, in each of which a vector links to near ones that are nearer to it than to one another. Vectors go in block by
block, each block searching what is there and being compared within itself. A search goes down the layers greedily and
spreads on the lowest one in a beam, whose ``width`` best vectors are followed until all have been.

Every shard is searched for the vectors of every other one, each pair of shards one way, so that a pair of vectors is
looked at once and links are symmetric. A beam that ends full of links is widened until it isn't, whatever the size of
the group. How wide beams are to begin with is audited: for a bounded sample of vectors all links are counted by brute
force over all rows, and the width doubles until the graphs find ``RECALL`` of them; a beam as wide as a shard looks at
all of it. Every link is verified by the cosine in double precision of the vectors as given.

Tasks emit a link count and one link per vector that they saw linked (a spanning forest), never the pairs themselves.
Searching every shard for all vectors costs rows squared over the rows of a shard, times the steps of a search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session
from opslake.llm.common import map_batches, mix, single
from opslake.llm.components import components
from opslake.llm.neighbours import matrix, valid

#: Cosine of a link; vectors of a shard; links of a vector on the lowest layer and above it.
LEAST, SHARD, WIDE, NARROW = 0.9, 16384, 24, 16
#: Width of beams to begin with and while a graph grows; vectors of the audit's sample; share of their links to be found.
WIDTH, GROWING, SAMPLE, RECALL = 16, 32, 1024, 0.98
#: Vectors that go in at once; queries that go in step.
BLOCK, STEP = 512, 256
_SLACK = 1e-4


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with that of ``b``, which are ``scaled``."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


@dataclass
class Layer:
    """``nodes`` of the graph in this layer, where each node stands among them (-1: not here), and their links (-1: none)."""

    nodes: np.ndarray
    place: np.ndarray
    near: np.ndarray


def select(unit: np.ndarray, ids: np.ndarray, score: np.ndarray, many: int) -> np.ndarray:
    """Of each row's candidates (-1: none) the nearest that are nearer to it than to any chosen before; then the nearest others."""
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    v = unit[ids]
    between = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    nearest = np.full(ids.shape, -np.inf, np.float32)
    for c in range(ids.shape[1]):
        fine = (ids[:, c] >= 0) & (score[:, c] > nearest[:, c]) & (count < many)
        chosen[:, c] = fine
        count += fine
        nearest[fine] = np.maximum(nearest[fine], between[fine, c])
    first = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :many]
    out = np.take_along_axis(ids, first, 1)
    return np.pad(out, ((0, 0), (0, many - out.shape[1])), constant_values=-1)


def beam(unit: np.ndarray, layer: Layer, asked: np.ndarray, starts: np.ndarray, width: int, least: float = np.inf) -> tuple[np.ndarray, ...]:
    """Search a layer for each row of ``asked``, all in step: the beam's nodes and scores, and (query, node) seen at ``least`` or more.

    ``starts`` are nodes, -1 for none, different ones in a row.
    """
    asks, total = len(asked), len(unit)
    seen = np.zeros(asks * total, np.int32)
    ids, score = np.full((asks, width), -1, np.int64), np.full((asks, width), -np.inf, np.float32)
    opened = np.zeros((asks, width), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    at_once = max(4, width // 8)
    active, offered = np.arange(asks), starts
    while len(active):
        flat = active[:, None] * total + offered
        fresh = np.flatnonzero((offered >= 0).ravel())
        fresh = fresh[seen[flat.ravel()[fresh]] == 0]
        where = flat.ravel()[fresh]
        seen[where] = fresh + 1
        fresh = fresh[seen[where] == fresh + 1]  # a node offered twice to a query counts once
        node, query = offered.ravel()[fresh], active[fresh // offered.shape[1]]
        got = np.einsum("ij,ij->i", unit[node], asked[query])
        linked = got >= least
        if linked.any():
            hits.append((query[linked], node[linked]))
        new = np.full(offered.shape, -np.inf, np.float32)
        new.ravel()[fresh] = got
        all_ids = np.concatenate([ids[active], offered], 1)
        all_score = np.concatenate([score[active], new], 1)
        all_open = np.concatenate([opened[active], new > -np.inf], 1)
        best = np.argpartition(-all_score, width - 1, axis=1)[:, :width] if all_score.shape[1] > width else np.broadcast_to(np.arange(all_score.shape[1]), all_score.shape)
        kept = best.shape[1]
        now_score, now_open = np.take_along_axis(all_score, best, 1), np.take_along_axis(all_open, best, 1)
        now_ids = np.take_along_axis(all_ids, best, 1)
        pick = np.where(now_open, now_score, -np.inf)
        first = np.argpartition(-pick, at_once - 1, axis=1)[:, :at_once] if kept > at_once else np.broadcast_to(np.arange(kept), pick.shape)
        follow = np.take_along_axis(pick, first, 1) > -np.inf
        np.put_along_axis(now_open, first, False, 1)
        ids[active, :kept], score[active, :kept], opened[active, :kept] = now_ids, now_score, now_open
        from_ids = np.take_along_axis(now_ids, first, 1)
        going = follow.any(axis=1)
        places = layer.place[from_ids[going]]
        offered = np.where(follow[going][:, :, None], layer.near[places], -1).reshape(len(from_ids[going]), first.shape[1] * layer.near.shape[1])
        active = active[going]
    query = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
    node = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
    return ids, score, query, node


class Graph:
    """A navigable graph of unit vectors; ``layers`` from the lowest."""

    def __init__(self, unit: np.ndarray, layers: list[Layer]):
        self.unit, self.layers = unit, layers

    @staticmethod
    def of(unit: np.ndarray) -> Graph:
        """Rows should come in random order; heights follow from their places alone, so that a task that runs again makes the same."""
        n = len(unit)
        drawn = np.random.default_rng(n).random(n)
        height = np.floor(-np.log(1 - drawn) / np.log(NARROW)).astype(np.int64)
        graph = Graph(unit, [])
        made: list[Layer] = []
        for level in range(int(height.max()), -1, -1):
            nodes = np.flatnonzero(height >= level)
            graph.layers = made
            made = [graph._grown(nodes[np.argsort(-height[nodes], kind="stable")], WIDE if level == 0 else NARROW), *made]
        graph.layers = made
        return graph

    def _grown(self, nodes: np.ndarray, many: int) -> Layer:
        """A layer of these nodes over the layers that ``layers`` has already."""
        place = np.full(len(self.unit), -1, np.int64)
        near = np.full((len(nodes), many), -1, np.int64)
        layer = Layer(nodes, place, near)
        done = 0
        while done < len(nodes):
            block = nodes[done : done + (BLOCK if done >= BLOCK else BLOCK - done)]
            asked = self.unit[block]
            within = asked @ asked.T
            np.fill_diagonal(within, -np.inf)
            some = min(len(block) - 1, GROWING // 2 if done else 2 * many)
            best = np.argpartition(-within, some - 1, axis=1)[:, :some] if some else np.zeros((len(block), 0), np.int64)
            ids, score = block[best], np.take_along_axis(within, best, 1)
            if done:
                starts = self.descend(asked)
                starts = np.where(place[starts] >= 0, starts, nodes[0])
                for low in range(0, len(block), STEP):
                    at = slice(low, low + STEP)
                    found, scored, _, _ = beam(self.unit, layer, asked[at], starts[at, None], GROWING)
                    if not low:
                        more, more_score = np.empty((len(block), GROWING), np.int64), np.empty((len(block), GROWING), np.float32)
                    more[at], more_score[at] = found, scored
                ids, score = np.concatenate([ids, more], 1), np.concatenate([score, more_score], 1)
            place[block] = np.arange(done, done + len(block))
            if ids.shape[1]:
                near[done : done + len(block)] = select(self.unit, ids, score, many)
                self._link_back(layer, block, many)
            done += len(block)
        self._connect(layer)
        return layer

    def _link_back(self, layer: Layer, block: np.ndarray, many: int) -> None:
        """What new nodes link to links back, as far as it has room for the nearest and most diverse."""
        to = layer.near[layer.place[block]]
        by = np.repeat(block, many)[(to >= 0).ravel()]
        to = to.ravel()[(to >= 0).ravel()]
        score = np.einsum("ij,ij->i", self.unit[by], self.unit[to])
        order = np.lexsort((-score, to))
        by, to = by[order], to[order]
        owners, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        keep = rank < many
        back = np.full((len(owners), many), -1, np.int64)
        back[np.repeat(np.arange(len(owners)), count)[keep], rank[keep]] = by[keep]
        for low in range(0, len(owners), BLOCK):
            at = owners[low : low + BLOCK]
            held = layer.near[layer.place[at]]
            extra = back[low : low + BLOCK]
            extra = np.where((extra[:, :, None] == held[:, None, :]).any(axis=2), -1, extra)
            ids = np.concatenate([held, extra], 1)
            crowded = (ids >= 0).sum(axis=1) > many
            kept = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable")[:, :many], 1)
            some = ids[crowded]
            score = np.where(some >= 0, np.einsum("ikj,ij->ik", self.unit[some], self.unit[at[crowded]]), -np.inf)
            kept[crowded] = select(self.unit, some, score, many)
            layer.near[layer.place[at]] = kept

    def _connect(self, layer: Layer, spare: int = 8) -> None:
        """Let every node be found by a search for itself: where it isn't, the nearest node found with room links to it.

        A crowd of near copies may have members that are linked from afar, or from one another, only.
        """
        many = layer.near.shape[1]
        used = np.zeros(len(layer.nodes), np.int64)
        layer.near = np.pad(layer.near, ((0, 0), (0, spare)), constant_values=-1)
        alone = layer.nodes
        for _ in range(16):  # a crowd of equal directions may stay out of sight; the audit widens beams then
            if not len(alone):
                return
            lost = []
            for low in range(0, len(alone), STEP):
                at = alone[low : low + STEP]
                starts = self.descend(self.unit[at])
                starts = np.where((layer.place[starts] >= 0) & (starts != at), starts, layer.nodes[0])
                ids, score, query, node = beam(self.unit, layer, self.unit[at], starts[:, None], WIDTH, 1 - _SLACK)
                found = (ids == at[:, None]).any(axis=1)
                found[query[node == at[query]]] = True
                if found.all():
                    continue
                at, ids, score = at[~found], ids[~found], score[~found]
                lost.append(at)
                room = layer.near.shape[1] - many
                free = (ids >= 0) & (used[layer.place[ids]] < room)
                some = free.any(axis=1)
                to = layer.place[np.take_along_axis(ids, np.where(free, score, -np.inf).argmax(axis=1)[:, None], 1)[:, 0]]
                if not some.all():
                    layer.near = np.pad(layer.near, ((0, 0), (0, spare)), constant_values=-1)
                self._linked(layer, at[some], to[some], used, many, many + room)
            alone = np.concatenate(lost) if lost else alone[:0]

    def _linked(self, layer: Layer, nodes: np.ndarray, to: np.ndarray, used: np.ndarray, low: int, high: int) -> np.ndarray:
        """Link the places ``to`` to nodes in their columns from ``low`` to ``high``, of which some are used; nodes that found no room."""
        order = np.argsort(to, kind="stable")
        nodes, to = nodes[order], to[order]
        column = low + used[to] + np.arange(len(to)) - np.searchsorted(to, to)
        fine = column < high
        layer.near[to[fine], column[fine]] = nodes[fine]
        np.add.at(used, to[fine], 1)
        return nodes[~fine]

    def descend(self, asked: np.ndarray) -> np.ndarray:
        """The node that greedy steps lead to, layer by layer, above the lowest one of ``search``."""
        if not self.layers:
            return np.zeros(len(asked), np.int64)
        at = np.full(len(asked), self.layers[-1].nodes[0])
        for layer in reversed(self.layers):
            score = np.einsum("ij,ij->i", self.unit[at], asked)
            moving = np.arange(len(asked))
            while len(moving):
                near = layer.near[layer.place[at[moving]]]
                got = np.where(near >= 0, np.einsum("ikj,ij->ik", self.unit[near], asked[moving]), -np.inf)
                best = got.argmax(axis=1)
                value = got[np.arange(len(moving)), best]
                better = value > score[moving]
                moving, best, value, near = moving[better], best[better], value[better], near[better]
                at[moving], score[moving] = near[np.arange(len(moving)), best], value
        return at

    def search(self, asked: np.ndarray, width: int, least: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of nodes seen at ``least`` or more, each once. ``own``: nodes to start at, of queries that are in the graph.

        Beams full of such nodes start again, twice as wide, until they aren't; one as wide as the graph sees all of it.
        """
        upper = Graph(self.unit, self.layers[1:])
        todo, lowest = np.arange(len(asked)), self.layers[0]
        while len(todo):
            width = min(width, len(self.unit))
            full = []
            step = max(1, STEP * 64 // max(64, width))
            for low in range(0, len(todo), step):
                at = todo[low : low + step]
                if width == len(self.unit):
                    query, node = np.nonzero(asked[at] @ self.unit.T >= least)
                    yield at[query], node
                    continue
                starts = upper.descend(asked[at])[:, None]
                if own is not None:
                    starts = np.concatenate([starts, np.where(own[at] == starts[:, 0], -1, own[at])[:, None]], 1)
                _, score, query, node = beam(self.unit, lowest, asked[at], starts, width, least)
                again = score.min(axis=1) >= least
                full.append(at[again])
                fine = ~again[query]
                yield at[query[fine]], node[fine]
            todo = np.concatenate(full) if full else todo[:0]
            width *= 2


class Forest:
    """Sets of numbers below ``n``, joined by links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        at = self.up[nodes]
        while not np.array_equal(at, above := self.up[at]):
            at = above
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


@dataclass
class Shard:
    """Vectors of a shard as they travel: smallest ids, numbers of copies, ``scaled`` vectors and, where it is searched, its graph."""

    reps: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    graph: Graph | None

    @staticmethod
    def read(row: dict) -> Shard:
        reps, copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
        vectors = scaled(np.frombuffer(row["vectors"], row["kind"]).reshape(len(reps), -1).astype(np.float64))
        graph = None
        if row.get("layers") is not None:
            layers = []
            for held in row["layers"]:
                nodes = np.frombuffer(held["nodes"], np.int32).astype(np.int64)
                place = np.full(len(reps), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                layers.append(Layer(nodes, place, np.frombuffer(held["near"], np.int32).reshape(len(nodes), -1).astype(np.int64)))
            graph = Graph(units(vectors), layers)
        return Shard(reps, copies, vectors, graph)

    def links(self, vectors: np.ndarray, width: int, least: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) whose cosine is ``least`` or more, verified; ``own``: the queries are this shard's, each pair comes once."""
        start = np.arange(len(vectors)) if own else None
        for query, node in self.graph.search(units(vectors), width, least - _SLACK, start):
            if own:
                query, node = query[query < node], node[query < node]
            for low in range(0, len(query), 1 << 15):
                q, v = query[low : low + (1 << 15)], node[low : low + (1 << 15)]
                fine = cosines(vectors[q], self.vectors[v]) >= least
                yield q[fine], v[fine]


_LAYERS = "array<struct<nodes:binary,near:binary>>"


def entries_of(rows: DataFrame) -> DataFrame:
    """(rep, copies, vec): of each distinct vector of (id, vec) its smallest id and how many ids have it."""
    return rows.groupBy("vec", "id").agg(F.lit(1).alias("one")).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def graphs_of(entries: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its vectors and their graph."""

    def build(table: pa.Table) -> pa.Table:
        reps = table["rep"].to_numpy()
        order = np.lexsort((reps, _scattered(reps)))  # the same graph if a task runs again
        given = matrix(table["vec"])[order]
        kind = "<f4" if pa.types.is_float32(table.schema.field("vec").type.value_type) else "<f8"
        graph = Graph.of(units(scaled(given)))
        layers = [{"nodes": layer.nodes.astype(np.int32).tobytes(), "near": layer.near.astype(np.int32).tobytes()} for layer in graph.layers]
        row = {"shard": table["shard"][0].as_py(), "reps": reps[order].astype(np.int64).tobytes(), "copies": table["copies"].to_numpy()[order].tobytes(), "kind": kind, "vectors": given.astype(kind).tobytes(), "layers": layers}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("reps", pa.binary()), ("copies", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("near", pa.binary())])))]))

    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, f"shard int, reps binary, copies binary, kind string, vectors binary, layers {_LAYERS}")


def _scattered(reps: np.ndarray) -> np.ndarray:
    return mix(reps.astype(np.int64).view(np.uint64))


def pair_links(graphs: DataFrame, shards: int, width: int, least: float) -> DataFrame:
    """(node, links, to): of the vectors linked within a pair of shards, how many ids they link to and a vector of the same set.

    A shard is searched for its own vectors and for those of half the others, so that each pair of shards meets once.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(shards // 2)))
    asked = graphs.select("shard", step.alias("step"), "reps", "copies", "kind", "vectors").withColumn("target", (F.col("shard") + F.col("step")) % shards)
    given = graphs.withColumnRenamed("shard", "target").select("target", step.alias("step"), "reps", "copies", "kind", "vectors", "layers")
    once = (F.col("step") * 2 != shards) | (F.col("target") < shards // 2) if shards % 2 == 0 else F.lit(True)
    asked, given = asked.where(once).drop("shard"), given.where(once)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, own = Shard.read(left.to_pylist()[0]), Shard.read(right.to_pylist()[0]), right["step"][0].as_py() == 0
        shift = 0 if own else len(a.reps)
        reps = b.reps if own else np.concatenate([a.reps, b.reps])
        links, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
        for query, node in b.links(a.vectors, width, least, own):
            np.add.at(links, query, b.copies[node])
            np.add.at(links, node + shift, a.copies[query])
            forest.join(query, node + shift)
        least_rep = np.full(len(reps), np.iinfo(np.int64).max)
        root = forest.roots(np.arange(len(reps)))
        np.minimum.at(least_rep, root, reps)
        at = links > 0
        return pa.table({"node": reps[at], "links": links[at], "to": least_rep[root[at]]})

    return asked.groupBy("target", "step").cogroup(given.groupBy("target", "step")).applyInArrow(meet, "node long, links long, to long")


def audited_width(entries: DataFrame, graphs: DataFrame, least: float, recall: float = RECALL, sample: int = SAMPLE, width: int = WIDTH, shard: int = SHARD) -> int:
    """The first of ``width`` doubled again and again whose beams find ``recall`` of the links of a sample, in all and of the mean vector."""
    spark = entries.sparkSession
    chosen = entries.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not chosen:
        return width
    asked = spark.sparkContext.broadcast((np.array([r.rep for r in chosen]), scaled(np.array([r.vec for r in chosen], np.float64))))

    def counted(df: DataFrame) -> dict[int, int]:
        return {r.q: r.n for r in df.groupBy("q").agg(F.sum("n").alias("n")).collect()}

    def counts(links: Iterator[tuple[np.ndarray, np.ndarray]], reps: np.ndarray) -> pa.RecordBatch:
        own, _ = asked.value
        n = np.zeros(len(own), np.int64)
        for q, v in links:
            np.add.at(n, q[own[q] != reps[v]], 1)
        return pa.RecordBatch.from_arrays([pa.array(own[n > 0]), pa.array(n[n > 0])], names=["q", "n"])

    def brute(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors, own = scaled(matrix(batch.column(1))), asked.value[1]
        q, v = np.nonzero(units(own) @ units(vectors).T >= least - _SLACK)
        fine = cosines(own[q], vectors[v]) >= least
        yield counts(iter([(q[fine], v[fine])]), single(batch.column(0)).to_numpy())

    exact = counted(map_batches(entries.select("rep", "vec"), brute, "q long, n long"))

    def at(width: int):
        def searched(table: pa.Table) -> pa.Table:
            held = Shard.read(table.to_pylist()[0])
            return pa.Table.from_batches([counts(held.links(asked.value[1], width, least), held.reps)])

        return searched

    while exact and width < shard:
        found = counted(graphs.groupBy("shard").applyInArrow(at(width), "q long, n long"))
        share = [found.get(q, 0) / n for q, n in exact.items()]
        if min(sum(share) / len(share), sum(found.values()) / sum(exact.values())) >= recall:
            break
        width *= 2
    return width


def classes(
    embeddings: DataFrame, least: float = LEAST, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, width: int | None = None
) -> DataFrame:
    """The key, n_links, component_id and kept of each vector, links being cosines of ``least`` or more.

    n_links counts the other ids linked directly, component_id is the smallest id that links lead to, and kept marks the
    rows that have it. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths don't. Equal vectors link with one another. Repeated rows are one; an id with several
    vectors is one row with the links of all of them, and they are of one component. Rows with a null id come back each by
    itself with no links, a null component and kept. Other columns are not looked at.
    """
    rows = session.cut(valid(embeddings, key, vector))
    pieces, joined = None, None
    for (dimension,) in sorted(tuple(r) for r in rows.select(F.size("vec")).distinct().collect()):
        part = rows.where(F.size("vec") == dimension)
        entries = session.cut(entries_of(part))
        shards = max(1, -(-entries.count() // shard))
        graphs = session.cut(graphs_of(entries, shards))
        wide = width if width is not None else audited_width(entries, graphs, least, shard=shard)
        links = session.cut(pair_links(graphs, shards, wide, least))
        sums = links.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
        held = entries.join(sums, "rep", "left").select("rep", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
        # of each id, the smallest id with the same vector; the kind of the vectors stays what it was
        ids = part.distinct().join(held, "vec").select("id", F.struct(F.lit(dimension).alias("d"), "rep").alias("rep"), "n")
        named = links.where("node != to").select(F.struct(F.lit(dimension).alias("d"), F.col("node").alias("rep")).alias("a"), F.struct(F.lit(dimension).alias("d"), F.col("to").alias("rep")).alias("b"))
        pieces = ids if pieces is None else pieces.unionAll(ids)
        joined = named if joined is None else joined.unionAll(named)
    every = embeddings.select(F.col(key).cast("long").alias("id"))
    alone = every.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if pieces is None:
        rest = every.where("id is not null").distinct().select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return rest.unionAll(alone).withColumnRenamed("id", key)
    pieces = session.cut(pieces)
    counted = pieces.groupBy("id").agg(F.sum("n").alias("n_links"), F.min("rep").alias("rep"), F.max("rep").alias("last"))
    # vectors of one id are of one component
    several = pieces.join(counted.where("rep != last").select("id", F.col("rep").alias("first")), "id").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    found = components(joined.unionAll(several))
    smallest = found.groupBy("class").agg(F.min("node.rep").alias("least_id"))
    found = found.join(smallest, "class").select("node", "least_id")
    named = counted.join(found, counted["rep"] == found["node"], "left").select("id", "n_links", F.coalesce("least_id", "rep.rep").alias("component_id"))
    rest = every.where("id is not null").distinct().join(named, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return rest.withColumn("kept", F.col("id") == F.col("component_id")).unionAll(alone).withColumnRenamed("id", key)
