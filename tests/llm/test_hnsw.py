"""Links and components against all pairs."""

import numpy as np
import pytest
from opslake.llm import hnsw
from opslake.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, node string, links string"


@pytest.fixture
def vectors(spark):
    def make(rows, kind="float"):
        prepare(spark)
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 5, "x", None) for i, v in rows], SCHEMA.replace("<float>", f"<{kind}>"))

    return make


def brute(rows, least=0.9, kind=np.float32):
    """n_links, component_id and kept by id; ids have one vector here."""
    fine = {}
    for i, v in rows:
        if v is not None and len(v) and None not in v and np.isfinite(np.array(v, kind)).all() and np.any(np.array(v, kind)):
            fine[i] = np.array(v, kind).astype(np.float64)
    links = {i: set() for i, _ in rows}
    for a, x in fine.items():
        for b, y in fine.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def crowds(seed, n, dimension, crowd, noise=0.1):
    make = np.random.default_rng(seed)
    x = make.normal(size=(n, dimension))
    for c in crowd:
        at = make.choice(n, c, replace=False)
        x[at] = x[at[0]] + noise * np.linalg.norm(x[at[0]]) / np.sqrt(dimension) * make.normal(size=(c, dimension))
    return x


def got(found):
    return {r[0]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("crowd", [(), (300,), (20, 40, 100, 7, 2, 2, 2)])
def test_a_graph_finds_what_is_near(crowd):
    x = hnsw.units(crowds(3, 1500, 24, crowd, 0.2))
    graph = hnsw.Graph.of(x)
    assert len(graph.layers) > 1 and len(graph.layers[0].nodes) == 1500
    exact = x @ x.T >= 0.9
    found = np.zeros_like(exact)
    for query, node in graph.search(x, hnsw.WIDTH, 0.9):
        assert not found[query, node].any() and len(set(zip(query.tolist(), node.tolist(), strict=True))) == len(query)
        found[query, node] = True
    assert (found <= exact).all() and found.sum() >= 0.99 * exact.sum()


@pytest.mark.parametrize("shard", [100_000, 400, 250, 170])
def test_against_all_pairs(vectors, shard):
    x = crowds(shard, 1000, 16, (150, 30, 5, 2), 0.3)
    rows = [(int(i) * 3 - 900, v.tolist()) for i, v in zip(np.random.default_rng(1).permutation(1000), x, strict=True)]
    want = brute(rows)
    result = got(hnsw.classes(vectors(rows), shard=shard))
    exact = sum(w[0] for w in want.values())
    assert all(result[i][0] <= want[i][0] for i in want)
    assert sum(r[0] for r in result.values()) >= 0.98 * exact
    assert {i: r[1:] for i, r in result.items()} == {i: w[1:] for i, w in want.items()}


def test_a_beam_as_wide_as_the_shard_finds_all(vectors):
    rows = list(enumerate(crowds(8, 300, 8, (60, 20), 0.4).tolist()))
    assert got(hnsw.classes(vectors(rows), shard=120, width=120)) == brute(rows)


def test_the_audit_widens_beams(vectors, spark):
    rows = list(enumerate(crowds(8, 600, 24, (90, 20), 0.2).tolist()))
    entries = hnsw.entries_of(vectors(rows).selectExpr("vec_id id", "embedding vec"))
    graphs = hnsw.graphs_of(entries, 2).cache()
    assert hnsw.audited_width(entries, graphs, 0.9, recall=0.9) < 600
    assert hnsw.audited_width(entries, graphs, 0.9, recall=1.1, shard=300) >= 300


def test_copies_scaled_copies_and_what_links_with_nothing(vectors):
    rows = [(5, (1, 0)), (3, (1, 0)), (9, (2, 0)), (4, (0, 1)), (1, (0, -1)), (2, (0, 0)), (6, None), (7, ()), (8, (None, 1)), (10, (float("nan"), 1)), (11, (float("inf"), 1)), (12, (1, 0, 0)), (13, (0.9, 0.43588989))]
    for kind in ("float", "double"):
        result = got(hnsw.classes(vectors(rows, kind)))
        assert result == brute(rows, kind=np.float32 if kind == "float" else np.float64)
    assert result[9][:2] == (3 if result[13][0] else 2, 3) and all(result[i] == (0, i, True) for i in (1, 2, 4, 6, 7, 8, 10, 11, 12))


def test_very_large_and_very_small_components(vectors):
    rows = [(1, (1e200, 1e200)), (2, (1e-200, 1e-200)), (3, (-1e300, 1e300)), (4, (-5e-324, 5e-324))]
    assert got(hnsw.classes(vectors(rows, "double"))) == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False)}


def test_null_ids_repeated_rows_and_ids_with_several_vectors(vectors):
    rows = [(None, (1, 0)), (None, None), (1, (1, 0)), (1, (1, 0)), (2, (0, 1)), (2, (1, 0)), (3, (0, 1))]
    found = [tuple(r) for r in hnsw.classes(vectors(rows)).collect()]
    assert sorted(found, key=lambda r: (r[0] is not None, r[0] or 0)) == [(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_empty_tables(vectors):
    found = hnsw.classes(vectors([]))
    assert found.collect() == [] and found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(hnsw.classes(vectors([(3, None), (4, (0, 0))]))) == {3: (0, 3, True), 4: (0, 4, True)}


def test_a_crowd_of_one_direction(vectors):
    rows = [(i, ((i + 1.0), 2 * (i + 1.0), -(i + 1.0))) for i in range(700)]
    assert got(hnsw.classes(vectors(rows, "double"), shard=300)) == {i: (699, 0, i == 0) for i in range(700)}
