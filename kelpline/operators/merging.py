"""Ledger merges, deduplication, upserts and the checks that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.scalars import lookup

#: How much a ledger status is worth; unknown ones rank below.
STATUS_RANK = {"clips": 3, "scanned_empty": 2, "probed_empty": 1, "failed": 0}


def status_rank(status: Column, ranks: dict = STATUS_RANK) -> Column:
    return lookup(ranks, status, -1)


def keep_better(existing: DataFrame, incoming: DataFrame, key: str, rank: Column, then: list[str]) -> DataFrame:
    """One row per key: the better status, then the greater of ``then`` (null as 0); the existing row wins ties.
    ``outcome`` says added, updated or unchanged. One shuffle on the key, with a map-side greatest."""
    both = existing.withColumn("__old", F.lit(1)).unionByName(incoming.withColumn("__old", F.lit(0)))
    order = F.struct(rank.alias("r"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in then], F.col("__old"))
    data = F.struct(*[c for c in existing.columns if c != key])
    best = both.groupBy(key).agg(F.max_by(F.struct(data.alias("row"), "__old"), order).alias("b"), F.max("__old").alias("had"))
    outcome = F.when(F.col("had") == 0, "added").when(F.col("b.__old") == 0, "updated").otherwise("unchanged")
    return best.select(key, "b.row.*", outcome.alias("outcome"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (nulls equal): the least of each task, then of all; rows aren't ordered."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__first"))
    return first.select(*[c if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def with_orphans(rebuilt: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rebuilt rows and old ones whose key they lack (nulls equal)."""
    a, b = old.alias("a"), rebuilt.select(*keys).distinct().alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return rebuilt.unionByName(a.join(b, same, "left_anti"))


def latest(rows: DataFrame, key: str, at: str, deleted: Column | None = None) -> DataFrame:
    """The latest row of each key; keys whose latest row is a deletion go."""
    data = F.struct(*[c for c in rows.columns if c != key])
    flag = deleted if deleted is not None else F.lit(False)
    out = rows.groupBy(key).agg(F.max_by(F.struct(data.alias("row"), flag.alias("gone")), at).alias("b")).where(~F.col("b.gone"))
    return out.select(key, "b.row.*")


def complete(rows: DataFrame, key: str, part: str, parts: int) -> DataFrame:
    """Keys that have every part."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).where(F.col("parts") == parts)


def missing(whole: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys of ``whole`` that a derived table lacks: it is stale unless this is empty."""
    return whole.select(key).distinct().join(derived.select(key).distinct(), key, "left_anti")


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def adequacy(rows: DataFrame, split: str, label: str, group: str) -> DataFrame:
    """Rows and distinct groups by split and label."""
    return rows.groupBy(split, label).agg(F.count("*").alias("clips"), F.count_distinct(group).alias("videos"))


def greedy_keep(rows: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """Rows of each group, in key order, whose cosine with every kept one is below the threshold. Groups are the clips of one
    video; a block of rows meets the kept ones in one matrix product."""
    import numpy as np
    import pandas as pd

    schema = rows.select(group, key).schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack([np.asarray(x, float) for x in pdf[vector]])
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        kept: list[int] = []
        for lo in range(0, len(v), 512):
            block = v[lo : lo + 512]
            far = (block @ v[kept].T).max(axis=1) < threshold if kept else np.ones(len(block), bool)
            among = block @ block.T
            own: list[int] = []
            for i in np.flatnonzero(far):
                if not own or among[i, own].max() < threshold:
                    own.append(int(i))
            kept += [lo + i for i in own]
        return pdf.iloc[kept][[group, key]]

    return rows.select(group, key, vector).groupBy(group).applyInPandas(keep, schema)


def greedy_keep_overall(rows: DataFrame, group: str, key: str, vector: str, within: float, overall: float, most: int) -> DataFrame:
    """:func:`greedy_keep` within groups, then in rounds over what is left of all groups, in key order, until ``most`` rows are
    kept (a stated sample size)."""
    from kelpline.operators.rounds import greedy_overall

    left = rows.join(greedy_keep(rows, group, key, vector, within), [group, key], "left_semi")
    return left.join(greedy_overall(left, key, vector, overall, most=most), key, "left_semi").select(group, key)


def similar_pairs(rows: DataFrame, group: str, key: str, vector: str, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs of one group (the clips of one video) with at least that cosine, once each, a < b.

    A group is dealt into blocks of about ``block`` rows by a hash of the key; every two blocks meet in a task of their own, in
    one matrix product, so a large group is many tasks of bounded size.
    """
    import numpy as np
    import pandas as pd

    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    dealt = rows.select(group, key, vector).join(blocks, group).withColumn("__own", F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))
    cells = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["__i"].iloc[0]), int(pdf["__j"].iloc[0])
        sides = []
        for k in (i, j):
            own = pdf[pdf["__own"] == k]
            v = np.stack([np.asarray(x, float) for x in own[vector]]) if len(own) else np.empty((0, 1))
            sides.append((own[key].to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]))
        (a, u), (b, w) = sides
        s = u @ w.T if len(a) and len(b) else np.empty((len(a), len(b)))
        x, y = np.nonzero(s >= threshold)
        lower = a[x] < b[y] if i == j else a[x] != b[y]
        x, y = x[lower], y[lower]
        return pd.DataFrame({group: pdf[group].iloc[0], "a": np.minimum(a[x], b[y]), "b": np.maximum(a[x], b[y]), "cosine": s[x, y]})

    kind = {c: rows.schema[c].dataType.simpleString() for c in (group, key)}
    return cells.select(group, key, vector, "__own", "__i", "__j").groupBy(group, "__i", "__j").applyInPandas(compare, f"{group} {kind[group]}, a {kind[key]}, b {kind[key]}, cosine double")


def union_keys(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys of any part, once."""
    from functools import reduce

    return reduce(DataFrame.union, [p.select(key) for p in parts]).distinct()
