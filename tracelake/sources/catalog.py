"""Catalogues of datasets: listings of buckets, manifests, records of an API, audit shards. Files come as (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import bids


def listed(pages: DataFrame) -> DataFrame:
    """(path, key) of pages of a bucket's listing in XML, entities resolved."""
    key = F.col("raw")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        key = F.replace(key, F.lit(entity), F.lit(char))
    return pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"<Key>([^<]*)</Key>"), F.lit(1))).alias("raw")).select("path", key.alias("key"))


def prefixes(pages: DataFrame) -> DataFrame:
    """(path, prefix) of the folders that pages of a listing name."""
    return pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"<CommonPrefixes>\s*<Prefix>([^<]*)</Prefix>"), F.lit(1))).alias("prefix"))


def next_page(pages: DataFrame) -> DataFrame:
    """(path, token): where the listing goes on, for pages that don't end it."""
    token = F.regexp_extract("text", r"<NextContinuationToken>([^<]*)</NextContinuationToken>", 1)
    return pages.where(F.col("text").rlike("<IsTruncated>true</IsTruncated>") & (token != "")).select("path", token.alias("token"))


def datasets(keys: DataFrame) -> DataFrame:
    """(dataset_id): the datasets that keys (key) lie in, by their first folder."""
    return keys.select(F.substring_index("key", "/", 1).alias("dataset_id")).distinct()


def primaries(keys: DataFrame) -> DataFrame:
    """(dataset_id, key, ext): of each dataset the first key, in order, of a recording that is opened by itself."""
    made = keys.select(F.substring_index("key", "/", 1).alias("dataset_id"), "key", bids.primary_ext(F.col("key")).alias("ext")).where(F.col("ext").isNotNull())
    return made.groupBy("dataset_id").agg(F.min(F.struct("key", "ext")).alias("m")).select("dataset_id", "m.key", "m.ext")


def tallied(all_datasets: DataFrame, found: DataFrame) -> DataFrame:
    """(ext, verdict, datasets): how many datasets have a recording of each kind, and how many have none."""
    both = all_datasets.join(found, "dataset_id", "left")
    return both.groupBy(F.coalesce("ext", F.lit("none")).alias("ext"), F.when(F.col("ext").isNull(), "empty").otherwise("loadable").alias("verdict")).agg(F.count("*").alias("datasets"))


def siblings(files: DataFrame, by: str, path: str) -> DataFrame:
    """(by, path, siblings): each file with the others of its stem in the same group, in order; files without any are left out. A
    stem has the few files of one recording."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    groups = files.select(by, path, stem.alias("__stem")).groupBy(by, "__stem").agg(F.array_sort(F.collect_list(path)).alias("__all")).where(F.size("__all") > 1)
    each = groups.select(by, F.explode("__all").alias(path), "__all")
    return each.select(by, path, F.filter("__all", lambda x: x != F.col(path)).alias("siblings"))


def records(asked: DataFrame, api: DataFrame) -> DataFrame:
    """Recordings of the datasets asked for (dataset, ...) with what an API's records (dataset, path, record in JSON) tell of them;
    an impossible rate is null."""
    number = lambda k: F.get_json_object("record", f"$.{k}").try_cast("double")
    made = api.select("dataset", "path", F.when(number("sampling_frequency") > 0, number("sampling_frequency")).alias("fs"), number("recording_duration").alias("duration"), F.from_json(F.get_json_object("record", "$.ch_names"), "array<string>").alias("names"))
    return made.join(asked, "dataset")


def shards(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of shards in JSON lines; a line that isn't JSON fails the read, as an audit must not lose rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
