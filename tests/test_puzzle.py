import random

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  adds all queries to the catalogue
from gridlens.operators import puzzle as P
from gridlens.plans.catalogue import PUZZLES, QUERIES

FIRST = "542863917637912458819547236763128549924356781185479623478635192356291874291784365"


def valid(grid, clues):
    units = [[r * 9 + c for c in range(9)] for r in range(9)] + [[r * 9 + c for r in range(9)] for c in range(9)]
    units += [[(b // 3 * 3 + k // 3) * 9 + b % 3 * 3 + k % 3 for k in range(9)] for b in range(9)]
    return all({grid[i] for i in u} == set("123456789") for u in units) and all(c in ".0" or c == g for c, g in zip(clues, grid, strict=True))


def test_solutions():
    assert P.solve(PUZZLES[2]) == FIRST
    assert P.count_solutions(PUZZLES[2], 100) == 19
    assert P.count_solutions(PUZZLES[1], 100) == 1
    assert valid(P.solve(PUZZLES[1]), PUZZLES[1]) and P.solve_fewest(PUZZLES[1]) == P.solve(PUZZLES[1])
    assert valid(P.solve_fewest(PUZZLES[2]), PUZZLES[2])
    assert P.solve(PUZZLES[3]) is None and P.count_solutions(PUZZLES[3]) == 0
    assert P.solve(PUZZLES[4]) == PUZZLES[4] and P.count_solutions("." * 81, 5) == 5


def test_random_clues():
    rng = random.Random(1)
    for _ in range(20):
        full = P.solve(PUZZLES[1])
        keep = set(rng.sample(range(81), 35))
        grid = "".join(c if k in keep else "." for k, c in enumerate(full))
        found = P.search(P.Board(grid), P.Board.fewest, 50)
        assert len(set(found)) == len(found) and all(valid(s, grid) for s in found)
        if len(found) < 50:
            assert full in found and P.solve(grid) == min(found)


def test_clue_search():
    full = P.solve(PUZZLES[1])
    cells = [k for k, c in enumerate(PUZZLES[1]) if c != "."]
    ranked = [(k, [int(full[k]), 1, 2, 3, 4]) for k in cells]
    assert P.find_clues(ranked)[1] == full
    second = [(k, [1 if full[k] != "1" else 2, int(full[k]), 5, 6, 7]) for k in cells[:3]] + ranked[3:]
    clues, solved = P.find_clues(second)
    assert valid(solved, clues)
    assert P.find_clues(ranked, calls=3) is None
    assert P.find_clues([(0, [5]), (1, [5])]) is None


def test_over_rows(spark):
    df = spark.createDataFrame([*PUZZLES.items(), (9, None), (10, "123")], "puzzle_id int, grid string")
    got = {r.puzzle_id: r for r in P.solve_puzzles(df).collect()}
    assert got[1].is_unique and not got[2].is_unique and got[2].n_solutions == 2
    assert got[3].solution is None and got[9].solution is None and got[10].n_solutions == 0


def test_clue_search_where_nothing_solves():
    """A board that a cell's lack of digits rules out is left at once; row by row the search would go on for ages."""
    full = P.solve(PUZZLES[4])
    ranked = [(8, [1])] + [(72 + k, [2 + k]) for k in range(8)]  # the last row leaves 1 for its end, below a 1
    assert P.find_clues(ranked) is None
    dead = "." * 8 + "1" + "." * 63 + "23456789" + "."
    assert P.solve(dead) is None and P.count_solutions(dead) == 0
    rng = random.Random(4)
    for _ in range(20):
        keep = set(rng.sample(range(81), 45))
        wrong = [(k, [int(full[k]) % 9 + 1, int(full[k])] if n < 4 else [int(full[k])]) for n, k in enumerate(sorted(keep))]
        clues, solved = P.find_clues(wrong)
        assert valid(solved, clues.replace("0", ".")) and solved == P.solve(clues)
        assert all((clues[k] != "0") == (k in keep) for k in range(81))


def test_complete_by_row(spark):
    rng, grids = random.Random(2), [PUZZLES[4], PUZZLES[1], PUZZLES[4][:80], PUZZLES[4] + "1", PUZZLES[4] + "\n", "", "1" * 81]
    for _ in range(40):
        cells = list(PUZZLES[4])
        a, b = rng.sample(range(81), 2)
        cells[a], cells[b] = cells[b], cells[a]
        grids.append("".join(cells))
    rows = spark.createDataFrame([*enumerate(grids), (99, None)], "puzzle_id int, grid string")
    got = {r.puzzle_id: r.c for r in rows.select("puzzle_id", P.is_complete(F.col("grid")).alias("c")).collect()}
    want = {k: len(g) == 81 and valid(g, "." * 81) for k, g in enumerate(grids)}
    assert got == want | {99: False} and sum(want.values()) == 1 + sum(g == PUZZLES[4] for g in grids[1:])


def test_clues_made_in_one_pass(spark, sf):
    """Rows are dealt out once, searched once and judged where they are."""
    plan = QUERIES["clues_made"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert QUERIES["clues_made"](spark, sf).rdd.getNumPartitions() == 4
