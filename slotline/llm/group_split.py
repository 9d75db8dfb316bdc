"""Splits that keep related records together.

Records that share an entity are connected; components are found by alternating large-star and
small-star steps. The hash of a component's name gives its place in a random order, and the splits'
ranges are cut along that order at their shares of the rows, so that proportions hold in rows and
not in components. The few components that alone hold a visible part of the rows are placed before,
largest first, each where most rows are still wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.session import ensure_checkpoint_dir
from slotline.sources.readings import participant_id

MAX_ROUNDS = 50
MAX_SPLITS = 1000
LARGE = 256  # components of more than one part in so many of the rows are placed by themselves: fewer than this
BUCKETS = 4096


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are joined to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are joined to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, component (the least node it is linked to) of every node of ``links``.

    Links to oneself and links with a NULL end connect nothing (a node linked only to itself is its
    own component). Each round is two shuffles on the node with partial minima; a node that holds
    most links is split by the skew join. Lineage is cut in the session's checkpoint folder.
    """
    ensure_checkpoint_dir(links.sparkSession)
    whole = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = whole.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        edges = _small_star(_large_star(edges)).checkpoint()
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def participant(source: str = "source_file", pid: str = "id") -> Column:
    """source_file || '|' || the id in its one spelling; NULL if either is."""
    return F.concat(F.col(source), F.lit("|"), participant_id(pid))


def link_nodes(links: DataFrame) -> DataFrame:
    return links.select(participant("source_file_a", "id_a").alias("a"), participant("source_file_b", "id_b").alias("b"))


def split_shares(targets: DataFrame) -> list[tuple[str, float]]:
    """(name, share) of each split, in the order of the names; NULL or negative shares count as 0, NULL names for nothing."""
    rows = targets.filter(F.col("split_name").isNotNull()).groupBy("split_name").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("s")).limit(MAX_SPLITS + 1).collect()
    if not rows or len(rows) > MAX_SPLITS:
        raise ValueError(f"{'no' if not rows else f'more than {MAX_SPLITS}'} splits")
    return sorted((r.split_name, float(r.s)) for r in rows)


def place_components(sizes: DataFrame, targets: DataFrame, seed: int = 2026) -> DataFrame:
    """component, split of ``sizes`` (component, n_rows, one row each).

    The order is that of the hash of the name; a component lies in the split whose range of rows
    holds its middle. Ranges are the splits' shares less what the large components took. The order
    is summed up in buckets, so no task holds more than a bucket of components.
    """
    shares = split_shares(targets)
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    weight = sum(x for _, x in shares) or 1.0
    names, left = [n for n, _ in shares], [x / weight * total for _, x in shares]
    large: dict[str, str] = {}
    for r in sizes.filter(F.col("n_rows") * LARGE > total).orderBy(F.desc("n_rows"), "component").collect():  # fewer than LARGE
        k = max(range(len(left)), key=lambda i: (left[i], -i))
        left[k] -= r.n_rows
        large[r.component] = names[k]
        total -= r.n_rows
    open_, upto, at = [max(x, 0.0) for x in left], [], 0.0
    for x in open_:
        at += x
        upto.append(at / (sum(open_) or 1.0) * total)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("component"))), 1, 15)
    rows = sizes.select("component", "n_rows", digits.alias("_u"))
    known = sizes.sparkSession.createDataFrame(sorted(large.items()), "component string, split string")
    small = rows.join(known.select("component"), "component", "left_anti").withColumn("_bucket", F.floor(F.conv("_u", 16, 10).cast("bigint") / 2.0**60 * BUCKETS))
    inner = small.withColumn("_before", F.sum("n_rows").over(W.partitionBy("_bucket").orderBy("_u", "component").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_rows"))
    starts = small.groupBy("_bucket").agg(F.sum("n_rows").alias("_n")).select("_bucket", (F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))  # at most BUCKETS rows
    middle = F.col("_start") + F.col("_before") + F.col("n_rows") / 2
    split = F.lit(names[-1])
    for name, to in reversed(list(zip(names, upto, strict=True))[:-1]):
        split = F.when(middle < to, name).otherwise(split)
    return inner.join(starts, "_bucket").select("component", split.alias("split")).unionByName(known)


def group_split(records: DataFrame, links: DataFrame, targets: DataFrame, seed: int = 2026) -> DataFrame:
    """Every participant with records: participant, component, split, n_rows.

    All spellings of an id, and all participants that links connect, get one split. The splits' rows
    differ from their shares by less than ``1 / LARGE`` of all rows unless a single component is larger
    than its split (see ``split_report``). A NULL source or id is its own participant ('' in its name).
    """
    ensure_checkpoint_dir(records.sparkSession)
    who = F.concat_ws("|", F.coalesce("source_file", F.lit("")), F.coalesce(participant_id(), F.lit("")))
    people = records.groupBy(who.alias("participant")).agg(F.count("*").alias("n_rows"))
    c = components(link_nodes(links))
    named = people.join(c.withColumnRenamed("node", "participant"), "participant", "left").withColumn("component", F.coalesce("component", "participant")).checkpoint()
    placed = place_components(named.groupBy("component").agg(F.sum("n_rows").alias("n_rows")), targets, seed)
    return named.join(placed, "component").select("participant", "component", "split", "n_rows")


def assign_splits(records: DataFrame, links: DataFrame, targets: DataFrame, seed: int = 2026) -> DataFrame:
    """The records with ``component`` and ``split``."""
    who = F.concat_ws("|", F.coalesce("source_file", F.lit("")), F.coalesce(participant_id(), F.lit("")))
    people = group_split(records, links, targets, seed).select(F.col("participant").alias("_who"), "component", "split")
    return records.withColumn("_who", who).join(people, "_who").drop("_who")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, target_share, n_rows, n_components, actual_share, largest_component and its largest_rows; from ``group_split``.

    A share that is missed by more than one part in ``LARGE`` is so because of the largest component.
    """
    whole = assigned.groupBy("split", "component").agg(F.sum("n_rows").alias("n"))
    got = whole.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"), F.max("n").alias("largest_rows"), F.max_by("component", F.struct("n", "component")).alias("largest_component"))
    total = assigned.agg(F.sum("n_rows")).first()[0] or 1
    t = targets.join(got, targets.split_name == got.split, "left")
    n = F.coalesce("n_rows", F.lit(0))
    return t.select("split_name", "target_share", n.alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"), (n / total).alias("actual_share"), "largest_component", "largest_rows")


def must_share(assigned: DataFrame) -> DataFrame:
    """Pairs of different participants of one component: participant_a < participant_b; from ``group_split``."""
    a, b = assigned.alias("a"), assigned.alias("b")
    linked = (F.col("a.component") == F.col("b.component")) & (F.col("a.participant") < F.col("b.participant"))
    return a.join(b, linked).select(F.col("a.participant").alias("participant_a"), F.col("b.participant").alias("participant_b"))
