"""Tables with a stated schema, checks of what they hold, and sinks of one file."""

from __future__ import annotations

import gzip
import io
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.joins import ContractError, repeated

#: Rows of a file that the driver writes.
MOST_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV, gzip by suffix; a header is asked for and must match the schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_allowed(spark: SparkSession, path: str, schema: str, key: str, part: str, quarantined: list[str], registered: DataFrame) -> DataFrame:
    """JSON lines whose rows are all registered (key, sha), unchanged by that digest of their JSON, and of no quarantined part."""
    rows = read_jsonl(spark, path, schema)
    known = registered.select(F.col(key).alias("_k"), F.col("sha").alias("_s"))
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    bad = rows.join(known, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col(part).isin(quarantined), "quarantined").when(F.col("_k").isNull(), "unregistered").when(F.col("_s") != digest, "changed").alias("why")).where("why IS NOT NULL")
    if found := bad.take(1):
        raise ContractError(f"{found[0][key]!r} is {found[0].why}")
    return rows


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, year, key) of the articles of nested metadata {id, articles: [{title, year}]}; key is the publication's."""
    from ..functions import censor

    rows = spark.read.schema("id long, articles array<struct<title: string, year: int>>").option("multiLine", True).json(path)
    long = rows.select("id", F.explode("articles").alias("a")).select("id", "a.title", "a.year")
    return long.withColumn("key", censor.publication_key(F.col("title"), F.col("year")))


def check_measurements(df: DataFrame, key: str, target: str, unit: str, relation: str, targets: list[str], text: str | None = None) -> DataFrame:
    """(reason, n) of all rows that break the contract of a measurement table; none if it holds. text: ids and texts must go one to one."""
    rules = {
        "null_field": F.col(key).isNull() | F.col(target).isNull() | F.col(unit).isNull() | F.col(relation).isNull(),
        "unknown_unit": F.col(unit) != "uM",
        "unknown_relation": ~F.col(relation).isin("=", ">"),
        "unknown_target": ~F.col(target).isin(targets),
    }
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    bad = df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    twice = repeated(df, [key, target]).select(F.lit("repeated_measurement").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    out = bad.unionByName(twice)
    for a, b, name in ((key, text, "id_of_several_texts"), (text, key, "text_of_several_ids")) if text else ():
        many = df.groupBy(a).agg(F.countDistinct(b).alias("k")).where("k > 1").select(F.lit(name).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
        out = out.unionByName(many)
    return out


def check_predictions(predictions: DataFrame, expected: DataFrame, key: str, text: str, value: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): expected rows with their value and upper-cased label, and (reason, n) of unknown, repeated, misaligned, not positive rows."""
    e = expected.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    marked = predictions.join(e, F.col(key) == F.col("_k"), "left").withColumn("_n", F.count("*").over(W.partitionBy(key)))
    rules = {"unknown_id": F.col("_k").isNull(), "repeated_id": F.col("_n") > 1, "misaligned_text": F.col(text) != F.col("_t"), "value_not_positive": ~(F.col(value) > 0) | F.isnan(value)}
    issues = marked.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    rows = expected.join(predictions.select(key, value, F.upper(F.trim(F.col(label))).alias(label)), key, "left")
    return rows, issues


def union_of(sources: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """The rows of registered sources {name: (rows, how many)} with their source; another number of rows is an error."""
    out = None
    for name, (df, n) in sources.items():
        if (got := df.count()) != n:
            raise ContractError(f"{name} has {got} rows, not {n}")
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _bounded(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ContractError(f"more than {most} rows for one file; write Parquet")
    return df


def write_gzip_csv(df: DataFrame, path: str, order: list[str], most: int = MOST_ROWS) -> None:
    """One gzip CSV with the same bytes for the same rows: no time stamp, one newline, columns as they stand, rows by ``order``."""
    rows = _bounded(df, most).orderBy(*order).toLocalIterator()
    with open(path, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as z, io.TextIOWrapper(z, encoding="utf-8", newline="") as out:
        import csv

        w = csv.writer(out, lineterminator="\n")
        w.writerow(df.columns)
        w.writerows(rows)


def ranking(df: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """rank, key, text and the score 1 - (rank - 1) / n of a list by place (from 1 on)."""
    n = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).select(F.col(place).alias("rank"), key, text, (1 - (F.col(place) - 1) / F.col("_n")).alias("final_score"))  # one row


def write_ranking(df: DataFrame, path: str, key: str, text: str, place: str, most: int = MOST_ROWS) -> None:
    """One TSV of a ranking, scores with six places."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"rank\t{key}\t{text}\tfinal_score\n")
        for r in _bounded(ranking(df, key, text, place), most).orderBy("rank").toLocalIterator():
            f.write(f"{r['rank']}\t{r[key]}\t{r[text]}\t{r['final_score']:.6f}\n")


def write_predictions(df: DataFrame, path: str, key: str, most: int = MOST_ROWS) -> None:
    """One CSV by key, floats with ten significant digits."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(df.columns) + "\n")
        for r in _bounded(df, most).orderBy(key).toLocalIterator():
            f.write(",".join("" if x is None else f"{x:.10g}" if isinstance(x, float) else str(x) for x in r) + "\n")


def write_cube(df: DataFrame, path: str, keys: list[str], value: str) -> None:
    """A complete cube (keys, value) as Parquet: every combination once, all values positive; else an error."""
    sizes = [df.select(k).distinct().count() for k in keys]
    n = 1
    for s in sizes:
        n *= s
    got = df.agg(F.count("*"), F.countDistinct(F.struct(*keys)), F.count_if(~(F.col(value) > 0) | F.col(value).isNull())).first()
    if (got[0], got[1], got[2]) != (n, n, 0):
        raise ContractError(f"a cube of {sizes} has {got[0]} rows, {got[1]} cells, {got[2]} values that aren't positive")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def through_cache(requests: DataFrame, path: str, key: str, manifest: dict, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values by key from a Parquet cache that was made under the same manifest, the missing ones computed and added.

    The manifest is a column of the cache, so rows made under another one don't count.
    """
    import json

    spark = requests.sparkSession
    tag = F.sha2(F.lit(json.dumps(manifest, sort_keys=True)), 256)
    wanted = requests.select(key).distinct()
    try:
        cache = spark.read.parquet(path).where(F.col("_manifest") == tag).drop("_manifest")
        missing = wanted.join(cache, key, "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = wanted
    if not missing.isEmpty():
        compute(missing).withColumn("_manifest", tag).write.mode("append").parquet(path)
    return requests.join(spark.read.parquet(path).where(F.col("_manifest") == tag).drop("_manifest"), key)


def publish(spark: SparkSession, write: Callable[[str], None], path: str) -> None:
    """Write to a folder beside ``path`` and put it in its place; what stood there comes back if the swap fails."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = p(f"{path}.new-{uuid.uuid4().hex}"), p(f"{path}.old-{uuid.uuid4().hex}")
    try:
        write(new.toString())
    except Exception:
        fs.delete(new, True)
        raise
    had = fs.exists(p(path))
    if had:
        fs.rename(p(path), old)
    if not fs.rename(new, p(path)):
        if had:
            fs.rename(old, p(path))
        raise OSError(f"{path} could not be put in place")
    if had:
        fs.delete(old, True)


def write_report(df: DataFrame, path: str, most: int = 10_000, html: bool = False) -> None:
    """A small summary as one Markdown or HTML file."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError("too many rows for a report")
    say = lambda x: "" if x is None else str(x)
    if html:
        from html import escape

        line = lambda r, t: "<tr>" + "".join(f"<{t}>{escape(say(x))}</{t}>" for x in r) + "</tr>"
        out = "<table>\n" + "\n".join([line(df.columns, "th"), *(line(r, "td") for r in rows)]) + "\n</table>\n"
    else:
        cells = lambda r: "| " + " | ".join(say(x).replace("|", "\\|") for x in r) + " |"
        out = "\n".join([cells(df.columns), cells(["---"] * len(df.columns)), *map(cells, rows)]) + "\n"
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(out)
    os.replace(f"{path}.part", path)
