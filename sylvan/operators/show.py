"""A forest for people to look at, and trees kept in memory while they are worked on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hex_to_ascii, type_name
from ..model import path_literal
from ..plans.compile import in_tree


def tree_text(nodes: DataFrame, path: Sequence[bytes] = (), lines: int = 200) -> str:
    """The elements at and below a path, indented, in order: at most ``lines`` of them, with a last line where there are more."""
    n = len(tuple(path))
    below = nodes.where((F.size("path") >= n) & (F.slice("path", 1, n) == path_literal(tuple(path)))) if n else nodes
    value = F.concat_ws(" ", hex_to_ascii(F.col("item_value")), F.col("sum_value").cast("string"), F.col("big_sum_value").cast("string"), F.concat(F.lit("#"), F.col("count_value")))
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - n), hex_to_ascii(F.col("key")), F.lit(": "), type_name(F.col("element_type")), F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""))
    rows = below.orderBy(F.concat("path", F.array("key"))).select(line.alias("line")).limit(lines + 1).collect()
    return "\n".join([r["line"] for r in rows[:lines]] + (["..."] if len(rows) > lines else []))


class OpenTrees:
    """Trees persisted by path while they are read again and again; ``close`` lets them go."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.open: dict[tuple[bytes, ...], DataFrame] = {}

    def get(self, path: Sequence[bytes]) -> DataFrame:
        path = tuple(path)
        if path not in self.open:
            self.open[path] = in_tree(self.nodes, path).persist()
        return self.open[path]

    def close(self) -> None:
        for df in self.open.values():
            df.unpersist()
        self.open.clear()
