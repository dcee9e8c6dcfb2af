"""Sources: JSON-lines catalogs and sessions with explicit schemas, sinks, and views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harken.functions.numbering import placed
from harken.functions.text import MATERIALS

CATALOG = (
    "parent_asin string, title string, features array<string>, description array<string>, price string, categories array<string>, details map<string,string>, average_rating double, rating_number double, store string"
)
SESSIONS = (
    "sample_id string, scenario_type string, user_profile struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>, ground_truth struct<parent_asin:string>, "
    "intent_card struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>, behavior struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,message:string>>, free_form struct<initial_message:string>"
)
CLOSURES = ("zip closure", "button closure", "lace-up closure", "pull on closure")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped, and a catalog row without an id is dropped."""
    df = spark.read.schema(schema).json(path)
    key = schema.split()[0]
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines catalog with ``cat_pos``, the row's place in its files: by file, by the split's start, and by the row's place in the split."""
    df = spark.read.schema(CATALOG).json(path)
    df = df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_at"))
    df = df.where(F.col("parent_asin").isNotNull() & (F.col("parent_asin") != ""))
    return placed(df.withColumn("_one", F.lit(0)), ["_one"], F.col("split"), ["_at"], "cat_pos").drop("_one", "split", "_at")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_registry(df: DataFrame, path: str) -> None:
    """One row per run, appended."""
    df.write.mode("append").json(path)


def pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))


def catalog(spark: SparkSession, sf_dir: str, rated: bool = True) -> DataFrame:
    """The part table as a product catalog; details keep their order. Not ``rated``, it has no counts of what was sold, and order lines are not read."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cat_pos")).agg(F.count(F.lit(1)).cast("double").alias("rating_number"))
    k = F.col("p_partkey")
    closure = pick(CLOSURES, F.col("p_size") % 4)
    share = F.concat((50 + k % 51).cast("string"), F.lit("% "), pick(MATERIALS, k % 9))
    detail = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))
    items = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("parent_asin"),
        k.alias("cat_pos"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("store"),
        F.array(F.lit("Clothing, Shoes & Jewelry"), F.col("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("categories"),
        F.when(k % 3 != 0, F.array(share, closure)).otherwise(F.array(closure)).alias("features"),
        F.array(detail("Department", F.col("p_type")), detail("Item Size", F.col("p_size"))).alias("details"),
        F.col("p_retailprice").cast("string").alias("price"),
    )
    if not rated:
        return items
    return items.join(sold, "cat_pos", "left").withColumn("rating_number", F.coalesce("rating_number", F.lit(0.0)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from orders: the target is the order's least part, the scenario follows the order's number."""
    target = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.min("l_partkey").alias("target_pos"))
    r = F.col("sample_id") % 20
    scenario = F.when(r < 8, "buying").when(r < 16, "browsing").when(r < 19, "intent_override").otherwise("boundary")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return orders.join(target, "sample_id").select("sample_id", "target_pos", scenario.alias("scenario_type"), (3 + F.col("sample_id") % 2).cast("int").alias("override_turn"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, turn, message): what users said in the conversations, their turns numbered from 1."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.select(F.col("conv_id").alias("sample_id"), turn.alias("turn"), F.coalesce("text", F.lit("")).alias("message"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals made of order lines: known and unknown words, sure and unsure ones, alone and in groups."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    word, other = pick(MATERIALS, k % 9), pick(MATERIALS, s % 9)
    # numbered before words are made, so that only numbers are shuffled
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    line = line.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount")))
    return line.select(
        F.col("l_orderkey").alias("session_id"),
        (1 + F.col("l_linenumber") % 3).cast("int").alias("turn"),
        "ord",
        F.concat(F.lit("I would like "), word, F.lit(" or  "), other, F.lit(", please")).alias("message"),
        pick(("add", "Replace", "remove", "confirm", "no_preference", "explode"), s % 6).alias("op"),
        pick(("material", "material", "material", "feature", "shape"), k % 5).alias("attribute"),
        F.when(s % 7 == 0, "").when(s % 7 == 1, F.concat(F.lit(" "), word, F.lit("."))).when(s % 7 == 2, other).otherwise(word).alias("value"),
        F.when(k % 11 == 0, "something else").when(k % 11 == 1, "").otherwise(F.upper(word)).alias("evidence"),
        F.when(k % 13 == 0, "avoid").when(k % 13 == 1, None).otherwise("require").alias("polarity"),
        F.when(s % 5 == 0, "soft").when(s % 17 == 1, "loud").otherwise("hard").alias("strength"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.when(k % 3 == 0, "G 1").otherwise("").alias("group"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made of order lines, a line a turn: known and unknown kinds, routes and attributes, categories that the message holds and others."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    word, other = pick(MATERIALS, k % 9), pick(MATERIALS, s % 9)
    line = table(spark, sf_dir, "lineitem")
    once = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return line.select(
        F.col("l_orderkey").alias("session_id"),
        F.row_number().over(once).alias("turn"),
        F.concat(F.lit("Looking for "), word, F.lit(" things; what about  it?")).alias("message"),
        pick(("buying", "Browsing", "override_open", "reply", "override", "no_preference", "null_ask", "unknown", "chat"), k % 9).alias("kind"),
        pick(("deterministic", " Hybrid", "", "model"), s % 4).alias("route"),
        F.when(s % 3 == 0, other).when(s % 3 == 1, F.concat(F.upper(word), F.lit(" "))).alias("category"),
        pick(("material", "Color.", "shape", ""), k % 4).alias("attribute"),
        F.when(k % 5 == 0, F.concat(F.lit("it is "), word)).alias("normalized"),
        F.when(s % 2 == 0, F.array(word, other)).otherwise(F.array().cast("array<string>")).alias("texts"),
    )


def labelled(spark: SparkSession, sf_dir: str, index: DataFrame) -> DataFrame:
    """The samples as rows of a set of sessions that states cards and behaviour, a third with a free-form opener."""
    df = samples(spark, sf_dir).join(index.select(F.col("cat_pos").alias("target_pos"), "parent_asin", "title", "hard", "soft"), "target_pos")
    new = F.get("hard", F.lit(0))
    change = F.struct(F.col("override_turn").alias("turn"), F.try_element_at("soft", F.lit(-1)).alias("old_value"), new.alias("new_value"), F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), new, F.lit(".")).alias("message"))
    behavior = F.struct("scenario_type", F.when(F.col("scenario_type") == "intent_override", change).alias("override"))
    return df.select(
        F.col("sample_id").cast("string").alias("sample_id"),
        "scenario_type",
        F.struct("parent_asin").alias("ground_truth"),
        F.struct(F.col("title").alias("target_category"), F.col("hard").alias("hard_constraints"), F.col("soft").alias("soft_preferences")).alias("intent_card"),
        behavior.alias("behavior"),
        F.when(F.col("sample_id") % 3 == 0, F.struct(F.concat(F.lit("after some "), F.col("title")).alias("initial_message"))).alias("free_form"),
    )
