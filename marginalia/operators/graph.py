"""Co-citation graphs of papers. Inputs: ``paper, key, section, line``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket() -> Column:
    """References are cited together in one section, or within 50 lines; no line counts as line 0."""
    return F.coalesce(F.nullif("section", F.lit("")), F.concat(F.lit("lines_"), F.floor(F.coalesce("line", F.lit(0)) / 50).cast("string")))


def members(claims: DataFrame) -> DataFrame:
    return claims.where("key IS NOT NULL AND key <> ''").select("paper", bucket().alias("bucket"), "key").distinct()


def co_citations(claims: DataFrame) -> DataFrame:
    """``(paper, src, dst)`` with ``src < dst``, each once."""
    m = members(claims)
    return (m.withColumnRenamed("key", "src").join(m.withColumnRenamed("key", "dst"), ["paper", "bucket"]).where("src < dst").select("paper", "src", "dst").distinct())


def _components(nodes: set, links: dict) -> int:
    seen, n = set(), 0
    for start in nodes:
        if start in seen:
            continue
        n += 1
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in links[x] if y in nodes]
    return n


def _cut_nodes(links: dict[str, set]) -> int:
    """How many nodes hold their component together, in one walk: a node does if some child in the walk reaches nothing above it."""
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    cut = set()
    for root in links:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        children, path = 0, [(root, None, iter(links[root]))]
        while path:
            node, above, rest = path[-1]
            nxt = next(rest, None)
            if nxt is None:
                path.pop()
                if above is not None:
                    low[above] = min(low[above], low[node])
                    if above != root and low[node] >= seen[above]:
                        cut.add(above)
            elif nxt not in seen:
                seen[nxt] = low[nxt] = len(seen)
                children += node == root
                path.append((nxt, node, iter(links[nxt])))
            elif nxt != above:
                low[node] = min(low[node], seen[nxt])
        if children > 1:
            cut.add(root)
    return len(cut)


def unification(claims: DataFrame) -> DataFrame:
    """``(paper, refs, clusters, bridges, score)``.

    Clusters are components of the co-citation graph; a bridge is a reference
    without which there would be more of them. One paper's references are one
    row, whose size doesn't grow with the corpus; clusters and bridges take one
    walk each.
    """
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for paper, buckets in zip(pdf["paper"], pdf["buckets"]):
                links: dict[str, set] = {}
                for own in buckets:
                    for k in own:
                        links.setdefault(k, set()).update(x for x in own if x != k)
                nodes = set(links)
                clusters = _components(nodes, links)
                bridges = _cut_nodes(links)
                score = 0.0 if len(nodes) < 2 or clusters <= 1 else min(1.0, 1 - 1 / clusters + min(0.2, 0.05 * bridges))
                out.append((paper, len(nodes), clusters, bridges, score))
            yield pd.DataFrame(out, columns=["paper", "refs", "clusters", "bridges", "score"])

    buckets = members(claims).groupBy("paper", "bucket").agg(F.collect_list("key").alias("keys"))
    return buckets.groupBy("paper").agg(F.collect_list("keys").alias("buckets")).mapInPandas(measure, "paper long, refs long, clusters long, bridges long, score double")
