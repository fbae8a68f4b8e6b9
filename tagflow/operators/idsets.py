"""The set of tweet ids of every tag, as bitmaps.

Ids are dealt into buckets of 32,768.  A tag's ids in one bucket are one
container: a bitmap of 4 KB where there are many, an array where there are few.
A hot tag is thus many small rows, never one.  Sizes, intersections and the ids
themselves are read from the containers; a pair of tags meets bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32768
ARRAY_IDS = 512        # as many bytes as a bitmap


def id_sets(incidence: DataFrame, array_ids: int = ARRAY_IDS) -> DataFrame:
    """``(tag, bucket, n, ids, bits)`` of ``(tweet_id, tag)``; repeats count once, rows without an id not at all.

    ``bits`` holds containers of ``array_ids`` ids and more, ``ids`` (ascending) the others.
    """
    d = incidence.where("tweet_id IS NOT NULL").select(
        "tag", F.bitmap_bucket_number("tweet_id").alias("bucket"), F.col("tweet_id").alias("id")).distinct()
    sizes = d.groupBy(F.col("tag").alias("of"), F.col("bucket").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # a missing tag is a tag of its own
    sized = d.join(sizes, F.col("tag").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    few = (sized.where(F.col("n") < array_ids).groupBy("tag", "bucket", "n")
           .agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("bits", F.lit(None).cast("binary")))
    many = (sized.where(F.col("n") >= array_ids).groupBy("tag", "bucket", "n")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))
    return few.unionByName(many.withColumn("ids", F.lit(None).cast("array<bigint>")))


def bit(bits: Column, position: Column) -> Column:
    """The bit of a bitmap at a position, as 0 or 1."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))


def members(sets: DataFrame) -> DataFrame:
    """``(tag, bucket, id)``: the ids of all containers."""
    few = sets.where("ids IS NOT NULL").select("tag", "bucket", F.explode("ids").alias("id"))
    place = F.explode(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1))).alias("byte")
    byte = F.conv(F.hex(F.substring("bits", F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
    many = (sets.where("bits IS NOT NULL").select("tag", "bucket", "bits", place)
            .select("tag", "bucket", "byte", byte.alias("v")).where("v <> 0")
            .select("tag", "bucket", "byte", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
            .where("shiftright(v, i) & 1 = 1"))
    position = F.col("byte") * 8 + F.col("i")
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET + position + 1).otherwise(
        F.col("bucket") * BUCKET - position)
    return few.unionByName(many.select("tag", "bucket", number.cast("long").alias("id")))


def set_sizes(sets: DataFrame) -> DataFrame:
    """``(tag, n_tweets)``."""
    return sets.groupBy("tag").agg(F.sum("n").alias("n_tweets"))


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(tag_a, tag_b, n_a, n_b, shared, jaccard)`` of the pairs ``(tag_a, tag_b)``, each given once."""
    a = sets.select(F.col("tag").alias("tag_a"), "bucket", F.col("ids").alias("ids_a"), F.col("bits").alias("bits_a"))
    b = sets.select(F.col("tag").alias("tag_b"), "bucket", F.col("ids").alias("ids_b"), F.col("bits").alias("bits_b"))
    met = pairs.select("tag_a", "tag_b").join(a, "tag_a").join(b, ["tag_b", "bucket"])
    key = ["tag_a", "tag_b", "bucket"]
    held = lambda ids, bits: F.aggregate(
        ids, F.lit(0), lambda n, i: n + bit(bits, F.bitmap_bit_position(i)))
    small = met.where("bits_a IS NULL OR bits_b IS NULL").select(*key, F.when(
        F.col("bits_a").isNull() & F.col("bits_b").isNull(), F.size(F.array_intersect("ids_a", "ids_b"))).when(
        F.col("bits_a").isNull(), held(F.col("ids_a"), F.col("bits_b"))).otherwise(
        held(F.col("ids_b"), F.col("bits_a"))).cast("long").alias("shared"))
    large = (met.where("bits_a IS NOT NULL AND bits_b IS NOT NULL")
             .select(*key, F.explode(F.array("bits_a", "bits_b")).alias("bits"))
             .groupBy(*key).agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("shared")))
    shared = small.unionByName(large).groupBy("tag_a", "tag_b").agg(F.sum("shared").alias("shared"))
    n = set_sizes(sets)
    j = (pairs.select("tag_a", "tag_b").join(n.select(F.col("tag").alias("tag_a"), F.col("n_tweets").alias("n_a")), "tag_a")
         .join(n.select(F.col("tag").alias("tag_b"), F.col("n_tweets").alias("n_b")), "tag_b")
         .join(shared, ["tag_a", "tag_b"], "left").fillna(0, ["shared"]))
    return j.select("tag_a", "tag_b", "n_a", "n_b", "shared",
                    (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
