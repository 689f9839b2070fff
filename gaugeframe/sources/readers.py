"""Scans: score sheets, JSON lines, manifests, shards; and a registry by suffix."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gaugeframe.functions import pytext
from gaugeframe.functions.text import collapse, normal_index
from gaugeframe.operators.sampling import ranged, sliced_rank
from gaugeframe.operators.validation import assert_empty, binary_hit, duplicates

LETTERS = [chr(65 + i) for i in range(26)]
#: Rows of a list that is shuffled on the driver at most.
MOST_SHUFFLED = 5_000_000


def score_sheet(spark: SparkSession, path: str, sep: str = ",", sha256: str | None = None) -> DataFrame:
    """Index, hit, question, answer, options (map) and log of a CSV sheet. Every column is read as text, so that
    ids such as 001 and NA stay what they are; only the columns that exist are read. With ``sha256`` the file must have
    that digest."""
    if sha256 is not None and [r["sha256"] for r in file_digests(spark, path).collect()] != [sha256]:
        raise ValueError(f"{path} isn't the file that was pinned")
    header = spark.read.option("sep", sep).csv(path).limit(1).first()
    names = [str(x) for x in header] if header else []
    schema = StructType([StructField(n, StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("nullValue", "\0").csv(path)
    missing = {"index", "hit", "question", "answer"} - set(names)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    pairs = [x for n in names if n in LETTERS for x in (F.lit(n), collapse(F.col(n)))]
    options = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "")) if pairs else F.create_map().cast("map<string,string>")
    log = F.col("log") if "log" in names else F.lit(None).cast("string")
    return raw.select(normal_index(F.col("index")).alias("index"), binary_hit(F.col("hit")).alias("hit"), collapse(F.col("question")).alias("question"), collapse(F.col("answer")).alias("answer"), options.alias("options"), log.alias("log"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzipped, blank lines left out; the schema is given, never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, schema: str, ordinal: str = "ordinal") -> DataFrame:
    """A manifest with its written order: files by name, and in a file line by line; uids must be unique."""
    rows = json_lines(spark, path, schema)
    assert_empty(duplicates(rows, ["uid"]), "repeated uid")
    if ordinal in rows.columns:
        return rows
    at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    return sliced_rank(ranged(rows.withColumns(at), *at), [], "_piece", list(at), ordinal).drop("_piece", *at)


def shards(spark: SparkSession, paths: list[str], columns: list[str] | None = None, key: str | None = None, expected: int | None = None, sha256: dict[str, str] | None = None) -> DataFrame:
    """Parts of one table, with only the columns asked for; digests of the files by name, uniqueness of the
    key and the count are checked, if given."""
    if sha256 is not None:
        found = {r["path"].rpartition("/")[2]: r["sha256"] for p in paths for r in file_digests(spark, p).collect()}
        if found != sha256:
            raise ValueError(f"digests differ: {sorted(n for n in found.keys() | sha256.keys() if found.get(n) != sha256.get(n))[:5]}")
    rows = spark.read.parquet(*paths)
    rows = rows.select(*columns) if columns else rows
    if key:
        assert_empty(duplicates(rows, [key]), f"repeated {key}")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """H5: path and SHA-256 of every file, to compare before and after an analysis."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def frame_indices(frames: str, count: int | None = None, fps_ratio: str | None = None):
    """Evenly spaced inner frames, or one for each step of the ratio, as an array column."""
    total = F.col(frames)
    if count:
        return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.floor(i * total / (count + 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(total / F.col(fps_ratio)).cast("int") - 1, F.lit(0))), lambda i: F.floor(i * F.col(fps_ratio)).cast("int"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda s, p: s.read.option("header", True).csv(p),
    "tsv": lambda s, p: s.read.option("header", True).option("sep", "\t").csv(p),
    "json": lambda s, p: s.read.option("multiLine", True).json(p),
    "jsonl": lambda s, p: s.read.json(p),
    "parquet": lambda s, p: s.read.parquet(p),
    "txt": lambda s, p: s.read.text(p),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix. Pickles and spreadsheets aren't read: the first run code, the second need a further library."""
    suffix = path.removesuffix(".gz").rpartition(".")[2]
    if suffix not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[suffix](spark, path)


def frozen(rows: DataFrame, key: str, pattern: str, expected: int) -> DataFrame:
    """A frozen selection: ids of one form, none twice, as many as expected."""
    assert_empty(rows.where(~F.coalesce(F.col(key).rlike(f"^(?:{pattern})$"), F.lit(False))), f"bad {key}")
    assert_empty(duplicates(rows, [key]), f"repeated {key}")
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return rows


def selected(rows: DataFrame, record: str, wanted: DataFrame, digest: str = "digest") -> DataFrame:
    """The rows whose JSON record has a wanted digest in canonical form; what isn't found is an error."""
    canonical = F.sha2(pytext.column(pytext.canonical_json, "string", F.col(record)), 256)
    found = rows.withColumn(digest, canonical).join(wanted.select(digest).distinct(), digest, "left_semi")
    assert_empty(wanted.select(digest).join(found.select(digest), digest, "left_anti"), "selected records are missing")
    return found


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """(uid, fold, name, values) of a gradient artifact. Every row has every vector, all of a name are as long and
    finite, and losses and token counts are positive."""
    rows, vectors = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/vectors")
    finite = F.forall("values", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    assert_empty(rows.where("loss IS NULL OR isnan(loss) OR abs(loss) = double('inf') OR loss_tokens <= 0"), "bad loss or token count")
    assert_empty(vectors.where(~F.coalesce(finite, F.lit(False))), "vectors that aren't finite")
    assert_empty(vectors.groupBy("name").agg(F.count_distinct(F.size("values")).alias("n")).where("n > 1"), "vectors of several lengths")
    counts = vectors.groupBy("uid").agg(F.count_distinct("name").alias("n"))
    names = vectors.select("name").distinct().count()
    assert_empty(rows.select("uid").join(counts, "uid", "left").where(~(F.coalesce("n", F.lit(0)) == names)), "rows without all vectors")
    return vectors.join(rows.select("uid", "fold"), "uid")


def shuffled_take(df: DataFrame, ordinal: str, n: int, k: int, seed: int) -> DataFrame:
    """The first ``k`` of ``n`` rows in the Mersenne Twister's order of this seed, with their ``place``. The order
    is made on the driver, 8 bytes a row of a bounded list; the rows stay where they are."""
    if n > MOST_SHUFFLED:
        raise ValueError(f"more than {MOST_SHUFFLED} rows to shuffle on the driver")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order[:k])], f"{ordinal} long, place int")
    return df.join(places, ordinal)


def verified(spark: SparkSession, path: str, md5: str) -> str:
    """The path of a file whose MD5 is as published; another one is an error."""
    found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.md5("content")).collect()]
    if found != [md5]:
        raise ValueError(f"{path} has the digest {found}, not {md5}")
    return path
