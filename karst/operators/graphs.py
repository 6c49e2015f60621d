"""Graph operators over an edge table. Loops write each frontier to the shared folder and stop when it is empty.

Edges are written once, not worked out again each round. Frontiers and nodes seen are merged, never broadcast: a written table of
ids is far smaller than its rows in memory, so Spark would send them through the driver round by round."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset a local session gets its
    own; on a cluster a local folder would lose data, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-karst-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def rounds_of(first: int, last: int | None):
    """The numbers of a loop's rounds; without end where last is None, for each round that goes on reaches new nodes."""
    return itertools.count(first) if last is None else range(first, last + 1)


def cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage with a written table, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)  # with the driver's end
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(seed, neighbor) along, against or both ways of the arrows."""
    if edge_type:
        edges = edges.where(F.col("edge_type") == edge_type)
    seeds = seeds.select(F.col("node").alias("seed")).distinct()
    out = edges.join(seeds, F.col("from_key") == F.col("seed")).select("seed", F.col("to_key").alias("neighbor"))
    back = edges.join(seeds, F.col("to_key") == F.col("seed")).select("seed", F.col("from_key").alias("neighbor"))
    return (out if direction == "out" else back if direction == "in" else out.union(back)).distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, distance, parent) of what the seeds reach within so many hops (None: all): the nearest, then the smallest parent."""
    edges = cut(edges.select("from_key", "to_key").distinct())
    seen = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    frontier = seen
    for hop in rounds_of(1, hops):
        step = edges.join(frontier.select(F.col("node").alias("from_key")).hint("merge"), "from_key")
        step = step.groupBy(F.col("to_key").alias("node")).agg(F.min(F.col("from_key").cast("string")).alias("parent"))
        frontier = cut(step.join(seen.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(hop).alias("distance"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def blast_radius(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """Everything that reaches the seeds, against the arrows."""
    return reach(edges.select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key")), seeds, hops)


def reachable(calls: DataFrame, entries: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, level, parent, certain): the parent of the smallest (uncertain, name) of the level before."""
    calls = cut(calls.groupBy("from_key", "to_key").agg(F.bool_or("certain").alias("certain")))
    seen = cut(entries.select("node").distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("certain")))
    frontier = seen
    for level in rounds_of(1, rounds):
        step = calls.join(frontier.select(F.col("node").alias("from_key")).hint("merge"), "from_key")
        best = F.min(F.struct((~F.col("certain")).alias("u"), F.col("from_key").alias("p")))
        step = step.groupBy(F.col("to_key").alias("node")).agg(best.alias("b"))
        new = step.join(seen.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(level).alias("level"), F.col("b.p").cast("string").alias("parent"), (~F.col("b.u")).alias("certain"))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError("rounds ended before the nodes did")
    return seen


def shortest_chain(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, distance, chain): the shortest chain from a root, ties by the names along it."""
    edges = cut(edges.select("from_key", "to_key").distinct())
    seen = cut(roots.select("node").distinct().select("node", F.lit(0).alias("distance"), F.array(F.col("node").cast("string")).alias("chain")))
    frontier = seen
    for hop in rounds_of(1, rounds):
        step = edges.join(frontier.select(F.col("node").alias("from_key"), "chain").hint("merge"), "from_key")
        step = step.groupBy(F.col("to_key").alias("node")).agg(F.min("chain").alias("c"))
        new = step.join(seen.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(hop).alias("distance"), F.concat("c", F.array(F.col("node").cast("string"))).alias("chain"))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError("rounds ended before the nodes did")
    return seen


def path_to_entry(reached: DataFrame) -> DataFrame:
    """(node, chain, uncertain): of the rows of `reachable`, the nodes from an entry to each node and how many hops are not certain.

    Parents are followed by doubling: each round joins every open chain with the chain of the node it hangs on, so a chain of n
    hops takes about log2(n) rounds. Chains that have reached their entry take no part in later rounds."""
    rows = reached.select(F.col("node").cast("string").alias("node"), F.col("parent").alias("up"), F.array(F.col("node").cast("string")).alias("chain"), F.when(F.col("parent").isNotNull() & ~F.col("certain"), 1).otherwise(0).alias("uncertain"))
    rows = cut(rows)
    while not rows.where("up is not null").isEmpty():
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("chain").alias("before"), F.col("uncertain").alias("more"))
        step = rows.where("up is not null").join(above, "up").select("node", F.col("next").alias("up"), F.concat("before", "chain").alias("chain"), (F.col("uncertain") + F.col("more")).alias("uncertain"))
        rows = cut(rows.where("up is null").unionByName(step))
    return rows.select("node", "chain", "uncertain")


def install_walk(edges: DataFrame, trees: DataFrame, primaries: DataFrame, most: int = 50) -> DataFrame:
    """(primary, tree, pos, depth, via, why): from each primary, the trees it installs from in breadth-first order, and the gaps.

    Edges are (src, dst) with any columns that order them, trees are those whose manifests were read, pos counts from 0 at the
    primary. A walk takes `most` trees; why is null for a tree on the walk, `not loaded` for one that was not read, `cap` for one
    beyond the walk's end, and a gap is listed once for each tree it is met from. All walks go on level by level together;
    a level's new trees are ordered by who met them first, in the order of the level before."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    out_of = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min(F.struct("dst", *others)).alias("rank"))
    known = trees.select(F.col("tree").alias("dst")).where("tree is not null").distinct().withColumn("loaded", F.lit(True))
    out_of = cut(out_of.join(known, "dst", "left"))
    seen = cut(primaries.select(F.col("tree").alias("primary")).where("tree is not null").distinct().select("primary", F.col("primary").alias("tree"), F.lit(0).alias("pos"), F.lit(0).alias("depth")))
    frontier, gaps = seen, None
    while not frontier.isEmpty():
        met = frontier.join(out_of, F.col("tree") == F.col("src")).select("primary", "src", "dst", F.struct("pos", "rank").alias("at"), (F.col("depth") + 1).alias("depth"), "loaded")
        met = met.join(seen.select("primary", F.col("tree").alias("dst"), F.lit(True).alias("old")), ["primary", "dst"], "left").where("old is null").drop("old")
        met = cut(met)
        first = met.where("loaded").groupBy("primary", "dst").agg(F.min("at").alias("at"), F.min("depth").alias("depth"))
        taken = seen.groupBy("primary").agg(F.count("*").alias("taken"))
        place = F.row_number().over(Window.partitionBy("primary").orderBy("at"))
        ranked = first.withColumn("place", place).where(F.col("place") < most).join(taken, "primary").withColumn("pos", (F.col("taken") + F.col("place") - 1).cast("int"))
        frontier = cut(ranked.where(F.col("pos") < most).select("primary", F.col("dst").alias("tree"), "pos", "depth"))
        left = met.join(frontier.select("primary", F.col("tree").alias("dst")), ["primary", "dst"], "left_anti")
        left = left.select("primary", F.col("dst").alias("tree"), F.lit(None).cast("int").alias("pos"), "depth", F.col("src").alias("via"), F.when(F.col("loaded"), "cap").otherwise("not loaded").alias("why"))
        gaps = left if gaps is None else gaps.unionByName(left)
        seen = seen.unionByName(frontier)
    walk = seen.select("primary", "tree", "pos", "depth", F.lit(None).cast(seen.schema["tree"].dataType).alias("via"), F.lit(None).cast("string").alias("why"))
    return walk if gaps is None else walk.unionByName(gaps)


def direct_parents(requirements: DataFrame, packages: DataFrame) -> DataFrame:
    return requirements.join(packages, "child", "left_semi").select("child", "parent").distinct()


def edge_contract(edges: DataFrame, contract: DataFrame) -> DataFrame:
    """Edges with whether their type may join these schemes."""
    e = edges.withColumn("from_scheme", F.split_part("from_key", F.lit(":"), F.lit(1))).withColumn("to_scheme", F.split_part("to_key", F.lit(":"), F.lit(1)))
    return e.join(contract.withColumn("karst ok", F.lit(True)), ["edge_type", "from_scheme", "to_scheme"], "left").withColumn("legal", F.coalesce("karst ok", F.lit(False))).drop("karst ok")


def unconnected(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    ends = edges.select(F.col("from_key").alias(key)).union(edges.select(F.col("to_key").alias(key)))
    return entities.join(ends, key, "left_anti")


def distinct_targets(edges: DataFrame, edge_type: str) -> DataFrame:
    """Distinct far nodes of each node, not edges."""
    return edges.where(F.col("edge_type") == edge_type).groupBy("from_key").agg(F.count_distinct("to_key").alias("targets"))


def name_collisions(df: DataFrame, name: str, cluster: str) -> DataFrame:
    return df.groupBy(name).agg(F.count_distinct(cluster).alias("clusters")).where("clusters > 1")


def propagate(edges: DataFrame, properties: DataFrame, kind: str, value: str) -> DataFrame:
    """A property of the far end carried back along edges of a kind, with how many ends agree."""
    hit = edges.where(F.col("edge_type") == kind).join(properties, F.col("to_key") == F.col("node"))
    return hit.groupBy("from_key", value).agg(F.count("*").alias("support")).withColumn("_r", F.row_number().over(Window.partitionBy("from_key").orderBy(F.desc("support"), value))).where("_r = 1").drop("_r")


def governance_ladder(df: DataFrame, rungs: list[tuple[str, str]]) -> DataFrame:
    """The first rung that answers, with its name."""
    name = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in rungs), F.lit("none"))
    return df.withColumn("value", F.coalesce(*(F.col(c).cast("string") for _, c in rungs))).withColumn("rung", name)


def running_state(df: DataFrame, key: str, running: DataFrame, recorded: DataFrame, exposed: DataFrame) -> DataFrame:
    """running, recorded_only, exposed_only or not_observed, counted; the four add up to the total."""
    for name, other in (("karst r", running), ("karst d", recorded), ("karst e", exposed)):
        df = df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    state = F.when(F.col("karst r"), "running").when(F.col("karst d"), "recorded_only").when(F.col("karst e"), "exposed_only").otherwise("not_observed")
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def waves(reads: DataFrame, rounds: int | None = None) -> DataFrame:
    """(job, wave): 1 for a job that reads no other, else 1 + the highest of those it reads; null on or behind a cycle."""
    left = cut(reads.select("job", "reads").distinct())
    jobs = cut(left.select("job").union(left.select("reads")).distinct())
    ready = done = cut(jobs.where("job is not null").join(left.select("job").hint("merge"), "job", "left_anti").select("job", F.lit(1).alias("wave")))
    for wave in rounds_of(2, rounds):
        met = cut(left.join(ready.select(F.col("job").alias("reads"), F.lit(True).alias("met")).hint("merge"), "reads", "left").select("job", "reads", "met"))
        left = met.where("met is null").select("job", "reads")
        # only a job that has just lost one of its reads can have lost the last
        new = met.where("met and job is not null").select("job").distinct().join(left.select("job").hint("merge"), "job", "left_anti")
        ready = cut(new.select("job", F.lit(wave).alias("wave")))
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
    else:
        raise RuntimeError("rounds ended before the nodes did")
    return jobs.join(done.hint("merge"), "job", "left")


def layer_prefix(images: DataFrame) -> DataFrame:
    """(image, other, shared): the longest ordered prefix of layers that two images share, of each image with its closest.

    Each prefix is hashed as a chain; an image meets, per prefix, only the smallest other image that has it."""
    own = images.select("image", "layers", F.explode(F.expr("sequence(1, size(layers))")).alias("n")).withColumn("h", F.expr("sha2(array_join(slice(layers, 1, n), '|'), 256)"))
    ends = own.groupBy("h", "n").agg(F.min("image").alias("a"), F.max("image").alias("z"), F.count("*").alias("c")).where("c > 1")
    hit = own.join(ends, ["h", "n"]).select("image", "n", F.when(F.col("a") != F.col("image"), F.col("a")).otherwise(F.col("z")).alias("other"))
    return hit.groupBy("image").agg(F.max("n").alias("shared"), F.max_by("other", "n").alias("other"))


def import_roots(modules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Dotted module -> distribution by the longest mapped prefix; else the first part, by convention."""
    parts = modules.select("module", F.explode(F.expr("sequence(1, size(split(module, '[.]')))")).alias("n")).withColumn("prefix", F.expr("array_join(slice(split(module, '[.]'), 1, n), '.')"))
    best = parts.join(mapping, "prefix").groupBy("module").agg(F.max_by("distribution", "n").alias("distribution"))
    return modules.select("module").distinct().join(best, "module", "left").select("module", F.coalesce("distribution", F.split_part("module", F.lit("."), F.lit(1))).alias("distribution"), F.when(F.col("distribution").isNull(), "convention").otherwise("mapping").alias("basis"))
