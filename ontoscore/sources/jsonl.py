"""Line-oriented JSON, keyed JSON objects and file trees."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ontoscore.functions.ident import canonical_json, compare_hashes
from ontoscore.functions.text import file_class


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of the non-blank lines of text files.

    Large files are read in splits: each split's lines are counted, and a line's number is its place in its split after the lines of
    the splits before. Both scans cut the files alike, and a task's running ids tell the places.
    """
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = at.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", (before - F.col("first")).alias("offset"))
    lines = at.where(F.trim("line") != "").join(starts, ["file", "block"])
    return lines.select("file", (F.col("id") + F.col("offset") + 1).cast("int").alias("line_no"), "line")


def is_object(line: str = "line") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """line_no and the fields of each JSON object. Strict: a line that is no object raises with its place; else it is left out."""
    lines = read_lines(spark, path)
    if strict:
        where = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": not a JSON object"))
        lines = lines.withColumn("line", F.when(is_object(), F.col("line")).otherwise(F.raise_error(where).cast("string")))
    else:
        lines = lines.where(is_object())
    return lines.select("line_no", F.from_json("line", schema).alias("o")).select("line_no", "o.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no JSON objects."""
    return read_lines(spark, path).where(~is_object())


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the commas of a text: file, block (where its split begins), id (ascending in the split), value. Splits are read apart."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"))


def _unescaped(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))


def _depth(piece: Column, inside: Column) -> Column:
    """How much deeper a piece ends than it begins, for one that begins inside a string or not."""
    bare = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), _unescaped(piece)), r'"[^"]*+(?:"|$)', "")
    return F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))


def keyed_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, entry (from 0), text of the entries of files that hold one JSON object each, of any size; nothing needs the object whole.

    Files are read in splits, cut at commas. Whether a comma stands in a string and how deep it lies follows from what stands before it: a
    split adds up its quotes, then its brackets, from its own start, and a row for each split carries the sums on to the next. Commas at
    depth one part the entries; only the pieces of one entry meet.
    """
    at = _pieces(spark, path)
    key = ["file", "block"]
    in_split = Window.partitionBy(*key).orderBy("id")
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    # strings: quotes before a piece, in its split and in the splits before
    plain = _unescaped(F.col("piece"))
    at = at.withColumn("quotes", F.length(plain) - F.length(F.translate(plain, '"', "")))
    quotes = at.groupBy(*key).agg(F.sum("quotes").alias("q")).select(*key, (earlier("q", splits) % 2).alias("odd"))
    at = at.join(quotes, key).withColumn("inside", (F.col("odd") + earlier("quotes", before)) % 2 == 1)
    at = at.withColumn("deeper", _depth(F.col("piece"), F.col("inside"))).withColumn("inside", F.when(F.col("quotes") % 2 == 1, ~F.col("inside")).otherwise(F.col("inside")))
    # depth behind a piece, and the borders between entries
    depths = at.groupBy(*key).agg(F.sum("deeper").alias("d")).select(*key, earlier("d", splits).alias("above"))
    at = at.join(depths, key).withColumn("border", (~F.col("inside") & (F.col("above") + F.sum("deeper").over(in_split.rowsBetween(Window.unboundedPreceding, 0)) == 1)).cast("int"))
    borders = at.groupBy(*key).agg(F.sum("border").alias("b")).select(*key, earlier("b", splits).alias("first"))
    at = at.join(borders, key).withColumn("entry", F.col("first") + earlier("border", before))

    # the pieces of an entry, those of one split in one string first
    parts = at.groupBy("file", "entry", "block").agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("p"))
    parts = parts.select("file", "entry", F.struct("block", F.array_join(F.transform("p", lambda x: x["piece"]), ",").alias("text")).alias("p"))
    whole = parts.groupBy("file", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), ",").alias("text"))
    lone = F.max("entry").over(Window.partitionBy("file"))
    text = F.when(F.col("entry") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    text = F.when(F.col("entry") == lone, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    return whole.select("file", "entry", text.alias("text")).where(F.trim("text") != "")


def read_keyed(spark: SparkSession, path: str, value: str, key: str) -> DataFrame:
    """The entries of a JSON object of objects: key, value's fields, key_matches (whether the entry names its own key in field `key`).

    An entry that is no JSON is a row without key and fields; bad_entries() has its text.
    """
    rows = keyed_entries(spark, path)
    rows = rows.select(F.explode_outer(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value}>")).alias("key", "v"))
    return rows.select("key", "v.*", F.coalesce(F.col("key") == F.col(f"v.{key}"), F.lit(False)).alias("key_matches"))


def bad_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of keyed objects that are no JSON: file, entry, text."""
    return keyed_entries(spark, path).where(F.try_parse_json(F.concat(F.lit("{"), "text", F.lit("}"))).isNull())


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One canonical JSON object per row. mode: errorifexists, append or overwrite."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(canonical_json(line).alias("value")).write.mode(mode).text(path)


#: Bytes of a file that a task holds at once.
CHUNK = 1 << 24
#: Where tasks can open files themselves.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            scheme, _, rest = path.partition(":")
            if scheme == "file":
                files, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
            else:
                files, name = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://"), safe=":/@"))
            digest = hashlib.sha256()
            with files.open_input_stream(name) as stream:
                while data := stream.read(CHUNK):
                    digest.update(data)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, sha256 and class of every file below a folder that is not empty (Spark's reader leaves empty files out); files may be of any size.

    Only the listing passes through Spark: a row for each file, without its content. A task then hashes its files as streams, CHUNK bytes
    at a time. In a store that tasks cannot open (OPENED), contents go through Spark's reader, which takes up to 2 GB a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path", "length", F.col("modificationTime").alias("modified"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme in OPENED:
        hashed = listed.mapInPandas(_digests, "path string, length long, modified timestamp, sha256 string")
    else:
        hashed = files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return hashed.withColumn("class", file_class(F.col("path")))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def archive_plan(sources: DataFrame, existing: DataFrame, force: bool = False, dry_run: bool = False) -> DataFrame:
    """sources (source_id, url, ...) with status: dry_run, existing or pending. Fetching is the host's."""
    x = sources.join(existing.select("source_id").distinct().withColumn("there", F.lit(True)), "source_id", "left")
    status = F.when(F.lit(dry_run), "dry_run").when(F.col("there").isNotNull() & F.lit(not force), "existing").otherwise("pending")
    return x.withColumn("status", status).drop("there")


FETCHED = "source_id string, url string, status string, archived_path string, source_sha256 string, bytes long, content_type string, final_url string, error string, attempts int"


def archive(plan: DataFrame, fetch: Callable[[str], dict], attempts: int = 2) -> DataFrame:
    """What became of each source of an archive_plan: status dry_run, existing, downloaded or error.

    fetch is the host's: it takes an address, keeps the content where it likes and gives archived_path, source_sha256, bytes,
    content_type and final_url. An exception is tried again, `attempts` times in all, then it is the source's error.
    """
    names = [f.split()[0] for f in FETCHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, url, status in zip(b["source_id"], b["url"], b["status"], strict=True):
                row = dict.fromkeys(names) | {"source_id": source, "url": url, "status": status, "attempts": 0}
                while status == "pending" and row["attempts"] < attempts and row["status"] != "downloaded":
                    row["attempts"] += 1
                    try:
                        row |= fetch(url) | {"status": "downloaded", "error": None}
                    except Exception as e:
                        row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})

    return plan.select("source_id", "url", "status").mapInPandas(run, FETCHED)


def annotated(sources: DataFrame, results: DataFrame) -> DataFrame:
    """sources (source_id, url, ...) with what an archive says of them: errors and plans are noted beside, downloads take the place of the address."""
    r = results.select("source_id", *[F.col(c).alias(f"r_{c}") for c in ("url", "status", "archived_path", "source_sha256", "bytes", "content_type", "final_url", "error")])
    x = sources.drop("download_error", "planned_url", "archived_path", "source_sha256", "bytes", "content_type", "final_url").join(r, "source_id", "left")
    done = F.col("r_status").isNotNull() & ~F.col("r_status").isin("error", "dry_run")
    take = lambda c: F.when(done, F.col(f"r_{c}")).alias(c)
    moved = F.when(done & (F.col("r_final_url") != F.col("r_url")), F.col("r_final_url")).alias("final_url")
    rest = [c for c in x.columns if c not in ("source_id", "url") and not c.startswith("r_")]
    url = F.when(done, F.coalesce("r_url", "url")).otherwise(F.col("url")).alias("url")
    return x.select(
        "source_id", url, *rest, F.when(F.col("r_status") == "error", F.col("r_error")).alias("download_error"), F.when(F.col("r_status") == "dry_run", F.col("r_url")).alias("planned_url"),
        take("archived_path"), take("source_sha256"), take("bytes"), take("content_type"), moved,
    )


def changed_files(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """name, found, recorded, state: files below a folder against their recorded digests (name, sha256)."""
    found = inventory(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return compare_hashes(found, recorded, "name")
