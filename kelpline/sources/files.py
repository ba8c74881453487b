"""Readers and writers. Readers of loose text return (rows, rejects): nothing is dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def json_object(spark: SparkSession, path: str, value_type: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """JSON objects keyed by id, a file each: (rows of key and value, rejects). Rejected are files that hold no such object, and
    entries whose value isn't of the type (key and all)."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = text.withColumn("loose", F.from_json("value", "map<string,string>"))
    entries = raw.where("loose IS NOT NULL").select("path", F.explode("loose").alias("__k", "__text")).withColumn("__v", _of_type("__text", value_type))
    bad = raw.where("loose IS NULL").select("path", F.lit(None).cast("string").alias("key"), "value")
    bad = bad.unionByName(entries.where("__v IS NULL").select("path", F.col("__k").alias("key"), F.col("__text").alias("value")))
    return entries.where("__v IS NOT NULL").select(F.col("__k").alias(key), F.col("__v").alias("value")), bad


def _of_type(text: str, value_type: str) -> Column:
    """A value that a map or array of strings holds as JSON (strings bare), as the type; null where it isn't one."""
    if value_type.strip().lower() == "string":
        return F.col(text)
    return F.from_json(F.concat(F.lit('{"v":'), F.col(text), F.lit("}")), f"struct<v:{value_type}>")["v"]


def json_envelope(spark: SparkSession, path: str, name: str, item_type: str) -> tuple[DataFrame, DataFrame]:
    """A JSON list, or an object that holds the list under a name: (rows, rejects). Rejected are files that hold neither, and
    items that aren't of the type."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bare, held = F.from_json("value", "array<string>"), F.from_json("value", f"struct<`{name}`:array<string>>").getField(name)
    items = text.withColumn("items", F.when(F.ltrim("value").startswith("["), bare).otherwise(held))
    each = items.where("items IS NOT NULL").select("path", F.explode("items").alias("text")).withColumn("item", _of_type("text", item_type))
    bad = items.where("items IS NULL").select("path", "value").unionByName(each.where("item IS NULL").select("path", F.col("text").alias("value")))
    return each.where("item IS NOT NULL").select("item.*"), bad


def jsonl(spark: SparkSession, path: str, schema: StructType, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Tolerant lines: (the last row of each key by a written order column, rejected lines)."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    text = spark.read.text(path)
    parsed = text.where(F.trim("value") != "").select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r._corrupt").isNull() & F.col(f"r.{key}").isNotNull() & (F.col(f"r.{key}").cast("string") != "")
    rows = parsed.where(good).select("r.*").drop("_corrupt")
    data = F.struct(*[c for c in rows.columns if c != key])
    last = rows.groupBy(key).agg(F.max_by(data, order).alias("row")).select(key, "row.*")
    return last, parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def passes(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """All pass files of a folder, the pass number taken from the file's name: (rows, rejects). Rejected are lines that don't parse,
    and those of files without a number, with the file's name."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    text = spark.read.text(folder, pathGlobFilter="pass*.jsonl").select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    number = F.regexp_extract("file", r"^pass(\d+)\.jsonl$", 1).try_cast("int")
    parsed = text.select("value", "file", number.alias("pass"), F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r._corrupt").isNull() & F.col("pass").isNotNull()
    return parsed.where(good).select("r.*", "pass").drop("_corrupt"), parsed.where(~good).select("file", "value")


def csv(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected records) of CSV files with a header each; quoted fields may hold line breaks. A data record equal to the
    header stays."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    rows = spark.read.schema(full).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    rows = rows.where(F.length(F.concat_ws("", *schema.names)) >= 0)  # always: a query of the rejects alone isn't allowed
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("value"))


def valid_files(files: DataFrame, least_bytes: int = 10_000, frames: str | None = None, least_frames: int = 37) -> DataFrame:
    """Files of some size and, where their frames were counted, of enough of those."""
    kept = files.where(F.col("length") > least_bytes)
    return kept if frames is None else kept.where(F.col(frames) >= least_frames)


def listing(spark: SparkSession, roots: list[str], pattern: str = "*", least_bytes: int = 0) -> DataFrame:
    """Files below several roots: path, tail, length, root rank; contents aren't read. The first root that has a tail wins."""
    from kelpline.functions.scalars import path_tail
    from kelpline.operators.merging import first_seen

    out = None
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        own = files.select("path", "length", F.lit(rank).alias("rank"))
        out = own if out is None else out.union(own)
    return first_seen(out.where(F.col("length") > least_bytes).withColumn("tail", path_tail(F.col("path"))), ["tail"], ["rank", "path"])


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` files, and the members of ``.npz`` archives, as rows: path, name (empty for .npy), shape, values (row-major)."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(b), allow_pickle=False)
                own = {k: got[k] for k in got.files} if p.endswith(".npz") else {"": got}
                yield pd.DataFrame({"path": [p] * len(own), "name": list(own), "shape": [list(a.shape) for a in own.values()], "values": [a.astype(np.float32).ravel() for a in own.values()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(load, "path string, name string, shape array<int>, values array<float>")


def packed(features: DataFrame, key: str, vector: str, half: bool = True) -> DataFrame:
    """key, dims, data: vectors as little-endian bytes, 16-bit floats unless ``half`` is off; write it as Parquet."""
    import numpy as np

    def pack(batches):
        for pdf in batches:
            own = [np.asarray(v, "<f2" if half else "<f4") for v in pdf[vector]]
            yield pdf[[key]].assign(dims=[len(v) for v in own], data=[v.tobytes() for v in own])

    return features.select(key, vector).mapInPandas(pack, f"{key} {features.schema[key].dataType.simpleString()}, dims int, data binary")


def unpacked(rows: DataFrame, key: str, half: bool = True) -> DataFrame:
    """key, values of packed vectors."""
    import numpy as np

    def unpack(batches):
        for pdf in batches:
            yield pdf[[key]].assign(values=[np.frombuffer(b, "<f2" if half else "<f4").astype(np.float32) for b in pdf["data"]])

    return rows.select(key, "data").mapInPandas(unpack, f"{key} {rows.schema[key].dataType.simpleString()}, values array<float>")


def links(html: Column, prefix: str = "") -> Column:
    """href values that don't start with a query."""
    return F.regexp_extract_all(html, F.lit(prefix + r'href="([^"?][^"]*)"'), F.lit(1))


def crawled(listings: DataFrame, fetch, url: str, depth: int) -> DataFrame:
    """url, level of everything below the listings' urls, ``depth`` levels down. ``fetch`` takes a url and returns its HTML (the
    caller's client; a fixture in tests); a level is one pass over the level above, in parallel."""
    import pandas as pd

    pull = F.pandas_udf(lambda us: pd.Series([fetch(u) for u in us]), "string")
    level = listings.select(F.col(url).alias("url"), F.lit(0).alias("level"))
    out = level
    for k in range(1, depth + 1):
        found = level.where(F.col("url").endswith("/")).select("url", F.explode(links(pull("url"))).alias("href")).where(~F.col("href").startswith("/") & (F.col("href") != "../"))
        level = found.select(F.concat("url", "href").alias("url"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return out


def candidates(dates: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every date with every camera: two dimension tables."""
    return dates.crossJoin(cameras)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version beside the table, then swaps it in. What died in between is mended by the next call: an old
    version without a new one in place is put back first, so one good copy exists at all times."""
    import uuid

    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    target, old, staged = make(path), make(f"{path}.old"), f"{path}.staged-{uuid.uuid4().hex}"
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target) and not fs.rename(old, target):
        raise OSError(f"could not put {path}.old back")
    df.write.parquet(staged)  # may read the table itself
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(make(staged), target):
        fs.rename(old, target)
        raise OSError(f"could not put {staged} in place")
    fs.delete(old, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table, or its old version where a swap was cut off between its two renames."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    there = make(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(make(path))
    return spark.read.parquet(path if there else f"{path}.old")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_tag(df: DataFrame, path: str, tag: str = "tag") -> None:
    """Overwrites only the partitions of the tags in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tag).parquet(path)


def cached(spark: SparkSession, path: str, mode: str, make) -> DataFrame:
    """What ``make()`` gives for a mode, computed once and kept below the path by mode; a table with a success mark is whole."""
    at = f"{path}/mode={mode}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def envelope(df: DataFrame, description: str, name: str, most: int = 1_000_000) -> DataFrame:
    """One JSON text with a description, the count and the rows: an export format for one reader. More than ``most`` rows are an
    error (write the table instead); none are left out."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows: too many for one JSON text")
    rows = F.collect_list(F.struct(*df.columns))
    return df.agg(F.to_json(F.struct(F.lit(description).alias("description"), F.count("*").alias(f"n_{name}"), rows.alias(name))).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.mode("overwrite").csv(path, header=True)


def _small(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a table to print")
    return rows


def html(df: DataFrame, title: str, bar: str | None = None, most: int = 1000) -> str:
    """A small result as an HTML table; the column ``bar`` (0 to 1) as a bar."""
    from html import escape

    def cell(name, v):
        return f'<td><div style="width:{100 * (v or 0):.1f}%;background:#69c">&nbsp;</div></td>' if name == bar else f"<td>{'' if v is None else escape(str(v))}</td>"

    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(cell(c, r[c]) for c in df.columns) + "</tr>" for r in _small(df, most))
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def latex(df: DataFrame, caption: str, most: int = 1000) -> str:
    """A small result as a LaTeX table."""
    rows = [df.columns, *[["--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in _small(df, most)]]
    body = " \\\\\n".join(" & ".join(x.replace("_", r"\_") for x in r) for r in rows)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"
