import itertools
import random

import pytest
from lineaspark.operators import linking
from lineaspark.operators.linking import CONFIGS, EDGE, link_greedy, link_optimal, optimal_solution, solution_cost


def graph(spark, seed, frames=4, nodes=6, delta=1):
    r = random.Random(seed)
    rows = []
    for t in range(frames):
        for d in range(1, delta + 1):
            for a, b in itertools.product(range(1, nodes + 1), repeat=2):
                if t + d < frames and r.random() < 0.6:
                    rows.append(("m", (t, a), (t + d, b), r.randint(0, 9) / 3.0, r.randint(3, 10) / 10))
    return rows, spark.createDataFrame(rows, EDGE)


def sequential(rows, children):
    taken, used, out = set(), {}, set()
    for _, i, j, _, w in sorted(rows, key=lambda e: (-e[4], e[1], e[2][0], e[3], e[2][1])):
        if w >= 0.5 and j not in taken and used.get(i, 0) < children:
            taken.add(j)
            used[i] = used.get(i, 0) + 1
            out.add((i, j))
    return out


def ends(df):
    return {(tuple(e.src), tuple(e.dst)) for e in df.collect()}


@pytest.mark.parametrize("delta", [1, 2])
@pytest.mark.parametrize("divisions", [True, False])
def test_greedy_equals_the_sequence(spark, delta, divisions):
    for seed in (1, 2):
        rows, edges = graph(spark, seed, delta=delta)
        want = sequential(rows, 2 if divisions else 1)
        assert ends(link_greedy(edges, divisions)) == want
        if delta == 1:
            assert ends(link_greedy(edges, divisions, method="frames")) == want


def test_large_frame_pairs_go_by_rounds(spark, monkeypatch):
    rows, edges = graph(spark, 5)
    n = [sum(e[1][0] == t for e in rows) for t in range(3)]
    monkeypatch.setattr(linking, "MOST_IN_GROUP", sorted(n)[1])
    assert ends(link_greedy(edges, method="frames")) == sequential(rows, 2)


def test_greedy_edges(spark):
    assert link_greedy(spark.createDataFrame([], EDGE)).count() == 0
    heavy = spark.createDataFrame([("m", (0, 1), (1, 1), 0.0, 1.5)], EDGE)
    with pytest.raises(ValueError):
        link_greedy(heavy)


def cost(nodes, chosen, weight, k, divisions):
    into, out = {n: 0 for n in nodes}, {n: 0 for n in nodes}
    for i, j in chosen:
        out[i] += 1
        into[j] += 1
    if any(v > 1 for v in into.values()) or any(v > (2 if divisions else 1) for v in out.values()):
        return float("inf")
    total = len(nodes) * k["nodeC"] + sum(k["edgeW"] * weight[e] + k["edgeC"] for e in chosen)
    total += sum(k["appearC"] for n in nodes if not into[n]) + sum(k["disappearC"] for n in nodes if not out[n])
    return total + sum(k["splitC"] for n in nodes if out[n] > 1)


@pytest.mark.parametrize("config", ["gt", "deepcell_gt", "deepcell_gt_tuned"])
def test_optimal_equals_brute_force(spark, config):
    r = random.Random(4)
    for divisions in (True, False):
        weight = {((t, a), (t + 1, b)): r.randint(0, 10) / 10 for t in (0, 1) for a in (1, 2) for b in (1, 2, 3) if r.random() < 0.8}
        nodes = [(t, a) for t in (0, 1, 2) for a in (1, 2, 3)]
        edges = spark.createDataFrame([("m", i, j, 0.0, w) for (i, j), w in weight.items()], EDGE)
        best = min(cost(nodes, c, weight, CONFIGS[config], divisions) for n in range(len(weight) + 1) for c in itertools.combinations(weight, n))
        found = link_optimal(edges, config, divisions)
        assert abs(cost(nodes, ends(found), weight, CONFIGS[config], divisions) - best) < 1e-9
        table = solution_cost(spark.createDataFrame([("m", *n) for n in nodes], "movie string, t int, label int"), found, config, divisions).first()
        assert abs(table.cost - best) < 1e-9 and table.n_violations == 0


def cheapest(nodes, weight, k, divisions):
    """Over all sets of edges, nodes without one being selected where that saves."""
    best = 0.0
    for n in range(len(weight) + 1):
        for chosen in itertools.combinations(weight, n):
            used = {x for e in chosen for x in e} | (set(nodes) if k["nodeC"] + k["appearC"] + k["disappearC"] < 0 else set())
            best = min(best, cost(used, chosen, weight, k, divisions))
    return best


@pytest.mark.parametrize("config, divisions, seed", [("deepcell_res_tuned", True, 1), ("deepcell_res_tuned", False, 2), ("gt", True, 3)])
def test_optional_nodes_and_skipped_frames(spark, config, divisions, seed):
    r = random.Random(seed)
    nodes = [(t, a) for t in range(4) for a in (1, 2)]
    pairs = [(i, j) for i in nodes for j in nodes if 1 <= j[0] - i[0] <= 2]
    weight = {e: r.choice([0.1, 0.5, 0.9, 0.95]) for e in r.sample(pairs, 11)}
    edges = spark.createDataFrame([("m", i, j, 0.0, w) for (i, j), w in weight.items()], EDGE)
    table = spark.createDataFrame([("m", *n) for n in nodes], "movie string, t int, label int")
    found = optimal_solution(edges, table, config, divisions, rounds=25)
    bounds = found["bounds"].first()
    best = cheapest(nodes, weight, CONFIGS[config], divisions)
    assert abs(bounds.cost - best) < 1e-9 and bounds.bound <= best + 1e-6
    if bounds.cost:
        held = solution_cost(found["nodes"], found["edges"], config, divisions).first()
        assert abs(held.cost - bounds.cost) < 1e-9 and held.n_violations == 0
    if config == "gt":
        assert abs(bounds.cost - bounds.bound) < 1e-6


def test_optimal_of_nothing(spark):
    found = optimal_solution(spark.createDataFrame([], EDGE))
    assert found["edges"].count() == found["bounds"].count() == 0
