"""Writers of the report formats.

Model and prediction tables are written in parallel by Spark. The small
reports, which are one file of a fixed layout, are put together on the driver
from rows that a limit or a level of aggregation keeps few.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_object(path: str, content: dict) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(content, file, ensure_ascii=False)


def ranking(path: str, table: DataFrame, name: str = "result") -> None:
    """{"result": [[key, value], ...]} of a two-column table in its order."""
    json_object(path, {name: [list(r) for r in table.collect()]})


def partition_report(path: str, n_partitions: int, sizes: list[int], heavy: DataFrame) -> None:
    json_object(path, {"n_partitions": n_partitions, "n_items": sizes, "result": [list(r) for r in heavy.collect()]})


def csv_with_header(path: str, table: DataFrame) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def json_rows(path: str, table: DataFrame) -> None:
    """JSON lines, replaced as a whole: a second run repeats no row."""
    table.write.mode("overwrite").json(path)


def pair_model(path: str, table: DataFrame, first: str, second: str) -> None:
    """JSON lines of a symmetric model (a, b, sim) under the names given, each
    pair with the smaller id first."""
    low, high = F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")
    json_rows(path, table.select(low.alias(first), high.alias(second), "sim"))


def profiles(path: str, kinds: dict[str, DataFrame]) -> None:
    """JSON lines of profiles, each with its type, its id and its sorted term
    numbers, of frames (id, term) by type."""
    parts = [
        t.groupBy(F.col("id").cast("string").alias("profile_id")).agg(F.array_sort(F.collect_set(F.col("term").cast("int"))).alias("profile_content"))
        .select(F.lit(kind).alias("profile_type"), "profile_id", "profile_content")
        for kind, t in kinds.items()
    ]
    json_rows(path, reduce(DataFrame.unionByName, parts))


def exploration(path: str, total: int, in_year: int, users: int, top_users: list[tuple], top_words: list[str]) -> None:
    """One object of five answers: A rows, B rows of the year, C users, D the
    users with most rows and their counts, E the most frequent words."""
    json_object(path, {"A": total, "B": in_year, "C": users, "D": [list(u) for u in top_users], "E": top_words})


def _quoted(names: Iterable) -> str:
    return ", ".join(f"'{n}'" for n in names)


def itemsets(path: str, candidates: Iterable[tuple], frequent: Iterable[tuple]) -> None:
    """Two titled sections; in each a line for every size of itemset, in order
    of size, with blank lines between."""

    def section(title: str, sets: Iterable[tuple]) -> str:
        by_size: dict[int, list[tuple]] = {}
        for s in sorted(map(tuple, sets), key=lambda s: (len(s), s)):
            by_size.setdefault(len(s), []).append(s)
        lines = [",".join(f"({_quoted(s)})" for s in group) for group in by_size.values()]
        return title + "\n" + "\n\n".join(lines)

    with open(path, "w", encoding="utf-8") as file:
        file.write(section("Candidates:", candidates) + "\n\n" + section("Frequent Itemsets:", frequent) + "\n")


def communities(path: str, labelled: DataFrame, node: str = "node", group: str = "community") -> None:
    """A line for each community, members sorted, by size and first member."""
    rows = labelled.groupBy(group).agg(F.array_sort(F.collect_list(F.col(node).cast("string"))).alias("m"))
    with open(path, "w", encoding="utf-8") as file:
        for row in rows.orderBy(F.size("m"), F.col("m")[0]).select("m").toLocalIterator():
            file.write(_quoted(row["m"]) + "\n")


def betweenness(path: str, edges: DataFrame) -> None:
    with open(path, "w", encoding="utf-8") as file:
        for r in edges.orderBy(F.desc("betweenness"), "src", "dst").toLocalIterator():
            file.write(f"('{r['src']}', '{r['dst']}'), {r['betweenness']}\n")


def cluster_map(path: str, labels: DataFrame) -> None:
    """{"point": cluster} by id; points kept apart are -1."""
    rows = labels.orderBy("id").select("id", "cluster").toLocalIterator()
    json_object(path, {str(r["id"]): int(r["cluster"]) for r in rows})


def round_summaries(path: str, rows: Iterable[dict]) -> None:
    """Counts after each round of clustering, as CSV with a header."""
    names = ["round_id", "nof_cluster_discard", "nof_point_discard", "nof_cluster_compression", "nof_point_compression", "nof_point_retained"]
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.DictWriter(file, names)
        writer.writeheader()
        writer.writerows(rows)
