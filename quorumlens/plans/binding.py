"""Views of the driver's tables as the domain's tables: accounts, posts, categories, snapshots, analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Domain:
    """Lazy frames over one folder of tables; only the columns that a query needs are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows cost much more than their bytes, dealt out to all cores: a small file would be one task."""
        return self.table(name).repartition(self.spark.sparkContext.defaultParallelism)

    @property
    def accounts(self) -> DataFrame:
        analysis = F.col("s_suppkey") % 7
        first = F.min("s_suppkey").over(Window.partitionBy(analysis, "n_regionkey"))
        joined = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("s_suppkey").alias("account_id"), analysis.alias("analysis_id"), F.col("s_name").alias("handle"), F.col("n_regionkey").cast("string").alias("platform"),
            F.floor("s_acctbal").cast("bigint").alias("followers"), F.when(F.col("s_suppkey") == first, "target").otherwise("competitor").alias("role"),
        )

    @property
    def posts(self) -> DataFrame:
        shares = F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_tax") * 100 + 0.5).cast("bigint"))
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("account_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("post_url"),
            F.floor("l_quantity").cast("bigint").alias("likes"), F.col("l_linenumber").cast("bigint").alias("comments"), shares.alias("shares"),
            F.nullif("l_returnflag", F.lit("A")).alias("media_type"), F.col("l_shipdate").cast("timestamp").alias("posted_at"), F.col("l_partkey").alias("category_key"),
        )

    @property
    def categories(self) -> DataFrame:
        names = ["collaboration", "campaign", "paid_promotion", "product", "testimonial", "educational", "other"]
        part = self.table("part").select(F.col("p_partkey").alias("category_key"), (F.col("p_size") % 9).alias("k")).where("k < 7")
        return part.select("category_key", F.element_at(F.array(*map(F.lit, names)), (F.col("k") + 1).cast("int")).alias("category"))

    @property
    def points(self) -> DataFrame:
        """Daily follower points of users."""
        return self.table("events").select(F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("bigint").alias("followers"), F.col("event_id").alias("ordinal"))

    @property
    def users(self) -> DataFrame:
        """Accounts with or without points: customers."""
        return self.table("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("handle"))

    @property
    def analyses(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("computing")
        return self.table("orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("customer"), status.alias("status"), F.lit("").alias("status_detail"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


#: The same views for DuckDB, as common table expressions.
CTE = {
    "accounts": """accounts as (select s_suppkey as account_id, s_suppkey % 7 as analysis_id, s_name as handle, n_regionkey::varchar as platform, floor(s_acctbal)::bigint as followers,
  case when s_suppkey = min(s_suppkey) over (partition by s_suppkey % 7, n_regionkey) then 'target' else 'competitor' end as role
  from supplier join nation on s_nationkey = n_nationkey)""",
    "posts": """posts as (select l_suppkey as account_id, l_orderkey || '-' || l_linenumber as post_url, floor(l_quantity)::bigint as likes, l_linenumber::bigint as comments,
  case when l_returnflag <> 'N' then floor(l_tax * 100 + 0.5)::bigint end as shares, nullif(l_returnflag, 'A') as media_type, l_shipdate as posted_at, l_partkey as category_key from lineitem)""",
    "categories": """categories as (select p_partkey as category_key, (['collaboration', 'campaign', 'paid_promotion', 'product', 'testimonial', 'educational', 'other'])[p_size % 9 + 1] as category
  from part where p_size % 9 < 7)""",
    "points": "points as (select user_id as account_id, ts, floor(value)::bigint as followers, event_id as ordinal from events)",
    "weekly": """weekly as (select account_id, week_start, followers from (select *, date_trunc('week', ts)::date as week_start,
  row_number() over (partition by account_id, date_trunc('week', ts) order by ts desc, ordinal desc) as r from points) where r = 1)""",
    "users": "users as (select c_custkey as account_id, c_name as handle from customer)",
    "analyses": """analyses as (select o_orderkey as analysis_id, o_custkey as customer, case o_orderstatus when 'O' then 'pending' when 'F' then 'done' else 'computing' end as status,
  '' as status_detail, o_orderdate as created_at from orders)""",
}


def having(*names: str) -> str:
    return "with " + ",\n".join(CTE[n] for n in names)
