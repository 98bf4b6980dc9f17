"""Components of edge lists and folds without leaks."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


_folders: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    """This program's folder below the one the cluster names, which all executors share; a local one only where all runs on one machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandworks-")
        sc.setCheckpointDir(path)
    path = f"{path}/strandworks-operators/{sc.applicationId}-{os.getpid()}"
    if path not in _folders:
        if not _folders:
            atexit.register(_clear)
        _folders[path] = spark
    return path


def _clear() -> None:
    for path, spark in list(_folders.items()):
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  Spark has stopped: the folder stays for the cluster's own clean-up
            pass
        _folders.pop(path, None)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, whatever executors are lost.

    Its size is then the files', too. A checkpoint keeps the plan's estimate, which joins multiply: over the rounds
    of components() it became a number of so many digits that it filled the driver.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for work that outweighs its bytes: a small file would be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


#: Rows of a task that makes pairs of them.
DEAL = 400_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows by keys over as many tasks as their number asks for, so that a task's share, and its memory, doesn't grow with the table."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(few, -(-df.count() // (rows or DEAL))), *keys)


def over_blocks(state: DataFrame, reference: DataFrame, size: int, merged) -> DataFrame:
    """``merged(state, block)`` for each block of ``size`` values of a one-column table in turn; one block is on the driver at a time."""
    values = (r[0] for r in reference.toLocalIterator())
    block = list(itertools.islice(values, size))
    while block:
        state = merged(state, block)
        block = list(itertools.islice(values, size))
        if block:
            state = cut(state)
    return state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) for nodes (id) and undirected edges (a, b): the smallest id reachable.

    Each round a node and the root that it has take the smallest label around the node, and then that label's
    label, so long chains halve whatever the order of their ids. Labels only fall, so it always settles.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = cut(both)
    cur = cut(nodes.select("id").where("id IS NOT NULL").distinct().withColumn("root", F.col("id")))
    while True:
        near = both.join(cur, both.b == cur.id).groupBy("a").agg(F.min("root").alias("low"))
        step = cut(cur.join(near, cur.id == near.a, "left").select("id", "root", "low"))
        hook = step.groupBy(F.col("root").alias("_root")).agg(F.min("low").alias("hook"))
        step = step.join(hook, F.col("id") == F.col("_root"), "left").select("id", F.least("root", "low", "hook").alias("root"), F.col("root").alias("was"))
        label = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut(step.join(label, "root", "left").select("id", F.least("root", "up").alias("root"), "was"))
        changed = not new.where("root <> was").isEmpty()
        cur = new.select("id", "root")
        if not changed:
            return cur


def _fill(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each fold takes when each goes to the lightest, ties to the smaller number.

    Fold i takes its j-th when its load is loads[i] + j * size; the n smallest of these (load, fold) are taken.
    """
    below = lambda top: [max(0, -(-(top - x) // size)) for x in loads]  # noqa: E731  those of a load under top
    low, high = min(loads), max(loads) + n * size + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    took = below(low)
    left = n - sum(took)
    for i, x in enumerate(loads):
        if left and low >= x and (low - x) % size == 0:
            took[i], left = took[i] + 1, left - 1
    return took


def balanced_folds(df: DataFrame, group: str, folds: int, seed: str, chunk: int = 100_000) -> DataFrame:
    """(group, size, fold): groups by size, largest first, then by sha256(seed:group), each to the lightest fold; ties to the smaller fold.

    Only the table of (size, groups of that size) is on the driver, at most about the root of twice the rows.
    Which fold the r-th group of a size gets follows from the loads before it: the j-th that fold i takes
    stands behind all (load + j * size, fold) that are smaller.
    """
    from . import rank

    sizes = df.groupBy(group).agg(F.count("*").alias("size")).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    sizes = cut(sizes)
    loads, plan = [0] * folds, []
    for size, n in sorted(sizes.groupBy("size").count().collect(), reverse=True):
        took = _fill(loads, size, n)
        plan.append((size, list(loads), took))
        loads = [x + size * k for x, k in zip(loads, took)]
    spark = df.sparkSession
    levels = spark.createDataFrame(plan, "size long, loads array<long>, took array<long>")
    rows = levels.select("size", "loads", F.posexplode("took").alias("fold", "n")).where("n > 0")
    rows = rows.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk)))).repartition("size", "fold", "_a")
    rows = rows.withColumn("_j", F.explode(F.sequence(F.col("_a"), F.least(F.col("_a") + chunk, F.col("n")) - 1)))
    key = F.get("loads", F.col("fold")) + F.col("_j") * F.col("size")
    ahead = F.transform("loads", lambda x, i: F.greatest(F.lit(0), F.ceil((key - x + F.when(i < F.col("fold"), 1).otherwise(0)) / F.col("size"))))
    rows = rows.select(F.col("size").alias("_size"), "fold", F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x).alias("_r"))
    ranked = rank.with_ranks(sizes, {"_rank": F.col("_h_before")}, ["_h"], ["size"])
    # the plan rates the places by their few levels, but they are as many as the groups: they are never broadcast
    return ranked.join(rows.hint("merge"), (F.col("size") == F.col("_size")) & (F.col("_rank") == F.col("_r"))).select(group, "size", F.col("fold").cast("int").alias("fold"))


def round_robin_folds(df: DataFrame, stratum: str, key: str, folds: int) -> DataFrame:
    """Fold = position among the stratum's sorted keys, modulo the folds."""
    return df.withColumn("fold", (F.dense_rank().over(W.partitionBy(stratum).orderBy(key)) - 1) % folds)


def leaks(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def threshold_components(nodes: DataFrame, pairs: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(id, root, group) of nodes (id) linked by pairs (id_a, id_b, ratio) of at least, or above, a ratio; group = sha256 of the root."""
    near = pairs.where(F.col("ratio") > least if strict else F.col("ratio") >= least)
    return components(nodes, near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumn("group", F.sha2(F.col("root").cast("string"), 256))


def joint_components(nodes: DataFrame, *links: DataFrame) -> DataFrame:
    """(id, root) under several kinds of links, each (id, key): nodes that share a key of a kind are linked.

    A key's nodes hang on its smallest one, so a key that many share costs its number, not its pairs.
    """
    edges = None
    for link in links:
        known = link.where("id IS NOT NULL AND key IS NOT NULL")
        star = known.join(known.groupBy("key").agg(F.min("id").alias("b")), "key").where("id <> b").select(F.col("id").alias("a"), "b")
        edges = star if edges is None else edges.unionByName(star)
    return components(nodes, edges)


def exposure(members: DataFrame, order: tuple[str, ...] = ("fresh", "unknown", "used")) -> DataFrame:
    """(root, exposure): the strongest label of a component's members (root, exposure); a label not in the order counts as unknown."""
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("exposure")), F.lit(0)), F.lit(order.index("unknown") + 1))
    return members.groupBy("root").agg(F.max(level).alias("_k")).select("root", F.element_at(F.array(*map(F.lit, order)), F.col("_k").cast("int")).alias("exposure"))


def max_to_other_folds(pairs: DataFrame, folds: DataFrame, limit: float) -> DataFrame:
    """(id, fold, max_ratio, violates): the highest ratio of an id (pairs id_a, id_b, ratio, each pair once) to ids of other folds (id, fold)."""
    both = pairs.select("id_a", "id_b", "ratio").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "ratio"))
    a, b = folds.select(F.col("id").alias("id_a"), F.col("fold").alias("fa")), folds.select(F.col("id").alias("id_b"), F.col("fold").alias("fb"))
    top = both.join(a, "id_a").join(b, "id_b").where("fa <> fb").groupBy("id_a").agg(F.max("ratio").alias("m"))
    out = folds.join(top, folds.id == top.id_a, "left").select("id", "fold", F.coalesce("m", F.lit(0.0)).alias("max_ratio"))
    return out.withColumn("violates", F.col("max_ratio") > limit)


def duplicate_links(df: DataFrame, key: list[str], assay: str) -> DataFrame:
    """Add status: of rows of one export key "same_assay" if their assay is one, "unresolved" if some is missing, else "distinct"; a key's only row is "single"."""
    w = W.partitionBy(*key)
    n, known, kinds = F.count("*").over(w), F.count(assay).over(w), F.size(F.collect_set(assay).over(w))
    return df.withColumn("status", F.when(n == 1, "single").when(known < n, "unresolved").when(kinds == 1, "same_assay").otherwise("distinct"))


def resolve_label(df: DataFrame, label: str, exact: DataFrame, species: DataFrame) -> DataFrame:
    """Add genome and how: by the exact label, else by its species (first two words), else unknown. exact and species: (name, genome)."""
    first_two = F.substring_index(F.trim(F.regexp_replace(F.col(label), r"\s+", " ")), " ", 2)
    e, s = exact.select(F.col("name").alias("_e"), F.col("genome").alias("_ge")), species.select(F.col("name").alias("_s"), F.col("genome").alias("_gs"))
    out = df.join(e, F.col(label) == F.col("_e"), "left").join(s, first_two == F.col("_s"), "left")
    how = F.when(F.col("_ge").isNotNull(), "exact").when(F.col("_gs").isNotNull(), "species").otherwise("unknown")
    return out.withColumn("genome", F.coalesce("_ge", "_gs")).withColumn("how", how).drop("_e", "_ge", "_s", "_gs")


def _assigned(df: DataFrame, folds: int, seed: str, name: str) -> DataFrame:
    """(root, name): balanced folds of the roots of df; -1 where there are fewer than two roots to part."""
    roots = df.select("root").distinct()
    if roots.limit(2).count() < 2:
        return roots.withColumn(name, F.lit(-1))
    return balanced_folds(df, "root", folds, seed).select("root", F.col("fold").alias(name))


def _audit(levels: DataFrame, near: DataFrame, papers: DataFrame) -> None:
    """Nothing that is linked may lie in two folds of a level (id, root, level, fold): neither a component, nor a paper (id, key), nor a similar pair."""
    split = lambda df, key: not df.groupBy("level", key).agg(F.min("fold").alias("f"), F.max("fold").alias("t")).where("f <> t").isEmpty()
    if split(levels, "root"):
        raise RuntimeError("a component crosses folds")
    if split(levels.join(papers, "id"), "key"):
        raise RuntimeError("a paper crosses folds")
    a, b = levels.select(F.col("id").alias("id_a"), "level", F.col("fold").alias("fa")), levels.select(F.col("id").alias("id_b"), "level", F.col("fold").alias("fb"))
    if not near.join(a, "id_a").join(b, ["id_b", "level"]).where("fa <> fb").isEmpty():
        raise RuntimeError("a similar pair crosses folds")


def nested_folds(nodes: DataFrame, pairs: DataFrame, papers: DataFrame, threshold: float, outer: int, inner: int, seed: str) -> DataFrame:
    """(id, root, outer, held, inner): nodes (id) joined by pairs above the threshold and by shared papers (id, key), whole components to balanced folds.

    For each outer fold that is held out, the components left go to inner folds of their own. Where fewer than
    two components are left to part, their fold is -1; without outer folds, nothing is held (held and inner are
    null). Ids that repeat and ratios outside 0 to 1 are errors, and so is a component, a paper or a similar
    pair that crosses the outer folds or the inner ones of a fold held out.
    """
    if not nodes.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat")
    valid = F.coalesce(F.col("ratio").between(0, 1) & ~F.isnan("ratio"), F.lit(False))
    near = cut(pairs.select("id_a", "id_b", "ratio").where((F.col("ratio") > threshold) | ~valid))
    if not near.where(~valid).isEmpty():
        raise ValueError("ratios must lie between 0 and 1")
    known = cut(papers.where("key IS NOT NULL").select("id", "key").join(nodes.select("id"), "id", "left_semi").distinct())
    star = known.join(known.groupBy("key").agg(F.min("id").alias("b")), "key").select(F.col("id").alias("a"), "b")
    joined = components(nodes, near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(star))
    placed = cut(joined.join(_assigned(joined, outer, seed, "outer"), "root").select("id", "root", "outer"))
    folds = sorted(r[0] for r in placed.where("outer >= 0").select("outer").distinct().collect())  # at most outer
    if not folds:
        return placed.select("id", "root", "outer", F.lit(None).cast("int").alias("held"), F.lit(None).cast("int").alias("inner"))
    out = None
    for k in folds:
        rest = placed.where(F.col("outer") != k)
        part = rest.join(_assigned(rest, inner, seed, "inner"), "root").withColumn("held", F.lit(k))
        out = part if out is None else out.unionByName(part)
    out = cut(out.select("id", "root", "outer", "held", "inner"))
    levels = placed.select("id", "root", F.lit(-1).alias("level"), F.col("outer").alias("fold"))
    _audit(levels.unionByName(out.select("id", "root", F.col("held").alias("level"), F.col("inner").alias("fold"))), near, known)
    return out
