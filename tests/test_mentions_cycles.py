"""Mentions with spans and cycles of any length, against models and by hand."""

import random
import re

from ferrograph.operators.cycles import canonical_cycles, strong_components
from ferrograph.operators.mentions import Automaton, greedy, lexicon_mentions

LEXICON = [
    ("dcm", "dichloromethane", "dichloromethane", "solvent"), ("dcm", "dichloromethane", "methylene chloride", "solvent"), ("dcm", "dichloromethane", "DCM", "solvent"),
    ("etoac", "ethyl acetate", "ethyl acetate", "solvent"), ("etoac", "ethyl acetate", "EtOAc", "solvent"), ("dmf", "N,N-dimethylformamide", "N,N-dimethylformamide", "solvent"),
    ("dmf", "N,N-dimethylformamide", "dimethylformamide", "solvent"), ("bicarb", "saturated sodium bicarbonate solution", "saturated sodium bicarbonate solution", "workup"),
    ("bicarb0", "sodium bicarbonate", "sodium bicarbonate", "base"), ("buli", "n-butyllithium", "n-BuLi", "reagent"), ("r", "(R)-binol", "(R)-binol", "ligand"), ("blank", "blank", "  ", "none"),
]


def found(spark, text, **options):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame(LEXICON, "entry string, name string, alias string, category string")
    rows = lexicon_mentions(docs, "doc_id", "text", lexicon, ["washed", "dissolved"], **options).collect()
    return sorted((r["start"], r["end"], r["name"], r["source"], r["score"]) for r in rows)


def test_longest_spans_context_and_formulas(spark):
    text = "It was dissolved in DCM and N,N-Dimethylformamide. " + "x" * 40 + " The mixture, and saturated  sodium\nbicarbonate solution; C6H6 and CO, n-BuLi2 n-buli, ((R)-binol)"
    got = found(spark, text)
    shown = [(text[a:b], name, source, score) for a, b, name, source, score in got]
    assert shown == [
        ("DCM", "dichloromethane", "alias", 0.94), ("N,N-Dimethylformamide", "N,N-dimethylformamide", "canonical", 0.99),
        ("saturated  sodium\nbicarbonate solution", "saturated sodium bicarbonate solution", "canonical", 0.96), ("C6H6", "C6H6", "formula", 0.62),
        ("n-buli", "n-butyllithium", "alias", 0.9), ("(R)-binol", "(R)-binol", "canonical", 0.96),
    ]
    assert len(found(spark, text, overlapping=True)) == len(got) + 2 and len(found(spark, text, formulas=False)) == len(got) - 1


def test_automaton_against_a_pattern_for_each_alias():
    r = random.Random(1)
    words = ["ab", "a", "b", "-", " ", "  ", "ba", ".", "é"]
    aliases = list({x for x in ("".join(r.choices(words, k=r.randint(1, 5))).strip() for _ in range(60)) if x})
    machine = Automaton(aliases)
    for _ in range(200):
        text = "".join(r.choices(words, k=r.randint(0, 30)))
        wanted = []
        for k, alias in enumerate(aliases):
            body = r"\s+".join(re.escape(p) for p in re.split(r"\s+", alias))
            wanted += [(k, m.start(1), m.end(1)) for m in re.finditer(rf"(?=(?<![A-Za-z0-9])({body})(?![A-Za-z0-9]))", text)]
        assert sorted(machine.spans(text)) == sorted(wanted)


def test_greedy_choice_against_a_plain_loop():
    r = random.Random(2)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 9), r.choice([0.5, 0.9])) for a in (r.randint(0, 40) for _ in range(r.randint(0, 25)))]
        taken = []
        for i in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], -spans[i][2], spans[i][0], i)):
            if all(spans[j][1] <= spans[i][0] or spans[i][1] <= spans[j][0] for j in taken):
                taken.append(i)
        assert greedy(spans) == set(taken)


def model(edges):
    nodes, after = {x for e in edges for x in e}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(start):
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return seen

    far = {n: reach(n) for n in nodes}
    component = {n: min([m for m in nodes if m in far[n] and n in far[m]] + [n]) for n in nodes}
    cycles = {}
    for c in {c for c in component.values() if c in far[c]}:
        inside, paths, level, best = {n for n in nodes if component[n] == c}, {c: [c]}, [c], None
        while best is None:
            grown = {}
            for x in level:
                for y in after.get(x, ()):
                    if y == c:
                        best = min(best, paths[x]) if best else paths[x]
                    elif y in inside and y not in paths:
                        grown[y] = min(grown.get(y, paths[x] + [y]), paths[x] + [y])
            paths |= grown
            level = list(grown)
        cycles[c] = (len(inside), best)
    return component, cycles


def test_components_and_cycles_against_a_model(spark):
    for seed, n, m in ((0, 24, 60), (4, 12, 16)):
        r = random.Random(seed)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (102, 103), (104, 104), (103, 105), (105, 106), (106, 105)]
        component, cycles = model(edges)
        df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a bigint, b bigint")
        assert {x["node"]: x["component"] for x in strong_components(df).collect()} == component
        assert {x["component"]: (x["n_nodes"], x["cycle"]) for x in canonical_cycles(df).collect()} == cycles


def test_a_ring_of_ten_thousand_nodes(spark):
    ring = spark.range(10_000).selectExpr("id * 7 % 10000 as a", "(id + 1) * 7 % 10000 as b")
    row = canonical_cycles(ring).collect()
    assert len(row) == 1 and row[0]["n_nodes"] == 10_000 and row[0]["cycle"] == [i * 7 % 10_000 for i in range(10_000)]


def test_no_edges(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert strong_components(none).count() == 0 and canonical_cycles(none).count() == 0


def test_grouped_graphs_against_a_model(spark):
    """Groups are settled within tasks; a null group is one too."""
    import random

    from ferrograph.operators import cycles

    r = random.Random(9)
    edges = [(g, f"{g}:{r.randrange(n):02}", f"{g}:{r.randrange(n):02}") for g, n in (("a", 6), ("b", 12), ("c", 14), (None, 9)) for _ in range(18)]
    edges += [("d", f"d:{i:03}", f"d:{(i + 1) % 40:03}") for i in range(40)] + [("e", "e:1", "e:1"), ("e", "e:1", "e:2"), ("f", "f:1", "f:2"), ("f", "f:2", "f:1"), ("f", "f:2", "f:2")]
    ways: dict = {}
    for _, a, b in edges:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set())
    reach = {}
    for v in ways:  # nodes that one step or more lead to
        seen, todo = set(), [v]
        while todo:
            new = ways[todo.pop()] - seen
            seen |= new
            todo += new
        reach[v] = seen
    component = {v: min([v, *(w for w in reach[v] if v in reach[w])]) for v in ways}
    cycle = {}
    for c in {c for c in component.values() if c in reach[c]}:
        paths = {c: [c]}
        while c not in (last := {p[-1]: p for p in sorted(([*p, w] for p in paths.values() for w in ways[p[-1]]), reverse=True)}):
            paths = last
        cycle[c] = last[c][:-1]
    rows = spark.createDataFrame(edges, "g string, a string, b string")
    assert {x["node"]: x["component"] for x in cycles.strong_components(rows, "g").collect()} == component
    got = {x["component"]: (x["n_nodes"], x["cycle"]) for x in cycles.canonical_cycles(rows, "g").collect()}
    assert got == {c: (sum(x == c for x in component.values()), path) for c, path in cycle.items()}
