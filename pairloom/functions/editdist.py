"""Edit distance with any costs: the cost, all optimal alignments, and their mean operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EditDistance:
    """The table of cheapest ways between the beginnings of two sequences.

    ``cost`` is that of the whole; ``alignments`` gives every cheapest list of steps: ('M' match, 'S'
    substitution, 'I' insertion, 'D' deletion; place in a; place in b).
    """

    def __init__(self, a: Sequence, b: Sequence, insertion: Callable = lambda x: 1, deletion: Callable = lambda x: 1, substitution: Callable = lambda x, y: 0 if x == y else 1):
        self.a, self.b = a, b
        row = [0]
        for y in b:
            row.append(row[-1] + insertion(y))
        self.table, self.steps = [row], [[[]] + [["I"] for _ in b]]
        for i, x in enumerate(a, 1):
            above = self.table[-1]
            row, steps = [above[0] + deletion(x)], [["D"]]
            for j, y in enumerate(b, 1):
                ways = {"M" if x == y else "S": above[j - 1] + substitution(x, y), "I": row[j - 1] + insertion(y), "D": above[j] + deletion(x)}
                least = min(ways.values())
                row.append(least)
                steps.append([k for k, v in ways.items() if v == least])
            self.table.append(row)
            self.steps.append(steps)
        self.cost = self.table[-1][-1]

    def alignments(self) -> Iterator[list[tuple[str, int, int]]]:
        """One after the other, depth first: only the ways still open from the present one are held."""
        todo = [(len(self.a), len(self.b), None)]
        while todo:
            i, j, done = todo.pop()
            if not i and not j:
                out = []
                while done:
                    step, done = done
                    out.append(step)
                yield out
                continue
            for k in reversed(self.steps[i][j]):
                x, y = i - (k != "I"), j - (k != "D")
                todo.append((x, y, ((k, x, y), done)))

    def mean_steps(self) -> dict[str, float]:
        """Mean numbers of insertions, deletions and substitutions over all cheapest alignments, by counting paths."""
        ways: dict[tuple[int, int], tuple[int, dict[str, int]]] = {(0, 0): (1, {"I": 0, "D": 0, "S": 0})}
        for i in range(len(self.a) + 1):
            for j in range(len(self.b) + 1):
                if not (i or j):
                    continue
                n, sums = 0, {"I": 0, "D": 0, "S": 0}
                for k in self.steps[i][j]:
                    m, before = ways[i - (k != "I"), j - (k != "D")]
                    n += m
                    for s in sums:
                        sums[s] += before[s] + (m if s == k else 0)
                ways[i, j] = (n, sums)
        n, sums = ways[len(self.a), len(self.b)]
        return {k: v / n for k, v in sums.items()}


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("cost", "insertions", "deletions", "substitutions")]))
def _operations(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b, strict=True):
        d = EditDistance(x or "", y or "")
        m = d.mean_steps()
        rows.append((float(d.cost), m["I"], m["D"], m["S"]))
    return pd.DataFrame(rows, columns=["cost", "insertions", "deletions", "substitutions"])


def edit_operations(a: Column, b: Column) -> Column:
    """A struct of cost and mean operations with unit costs."""
    return _operations(a, b)


@F.udtf(returnType=T.StructType([T.StructField(c, T.StringType() if c == "op" else T.IntegerType()) for c in ("alignment", "step", "op", "a", "b")]))
class Alignments:
    """Every optimal alignment of two strings, a row per step; a LIMIT of alignments may follow."""

    def eval(self, a: str, b: str):
        for n, steps in enumerate(EditDistance(a or "", b or "").alignments()):
            for k, (op, x, y) in enumerate(steps):
                yield n, k, op, x, y
