"""Requests: validation, handle checks and the accounts they create."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import COMPETITORS, LEGACY_COMPETITORS, PLATFORMS, WINDOW_DAYS, blank, evaluated, first_rule, js_trim, strip_handle

#: platforms array, handles by platform, and competitors with a name and handles by platform
REQUEST = "companyName string, industry string, region string, platforms array<string>, targetHandles map<string,string>, competitors array<struct<name:string, handles:map<string,string>>>"


def parse(requests: DataFrame, body: str = "body") -> DataFrame:
    """request_id and the typed fields of a JSON body, which is parsed once, however many rules look at them."""
    return requests.select("request_id", evaluated(F.from_json(body, REQUEST)).alias("r")).select("request_id", "r.*")


def problem(allowed: tuple[str, ...] = PLATFORMS, competitors: int = COMPETITORS) -> Column:
    """The first rule that a request breaks, or null."""
    none = F.coalesce(F.size("platforms"), F.lit(0)) <= 0
    known = F.forall("platforms", lambda p: p.isin(*allowed))
    no_target = F.exists("platforms", lambda p: blank(F.try_element_at("targetHandles", p)))
    incomplete = F.exists("platforms", lambda p: F.exists("competitors", lambda c: blank(c["name"]) | blank(F.try_element_at(c["handles"], p))))
    # fixed values: the application's messages
    return first_rule([
        (blank(F.col("companyName")) | blank(F.col("industry")) | blank(F.col("region")), "Company name, industry, and region are required."),
        (none, "Select at least one platform."),
        (~known, "Invalid platform selected."),
        (F.coalesce(F.size("competitors"), F.lit(0)) != competitors, f"Exactly {competitors} competitors are required."),
        (no_target, "Missing target handle."),
        (incomplete, "Missing competitor name/handle."),
    ])


def legacy_competitors(text: Column) -> Column:
    """The earlier prototype's list: one handle a line, blank lines left out, every leading @ gone."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: js_trim(x) != "")
    return F.transform(lines, lambda x: F.regexp_replace(js_trim(x), "^@+", ""))


def legacy_problem() -> Column:
    """The first rule that a form (company, industry, region, target, competitors: text) breaks, or null.  Fields are
    compared as they are: white space isn't empty."""
    competitors = legacy_competitors(F.col("competitors"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # fixed values: the prototype's messages
    return first_rule([
        (F.size(competitors) > LEGACY_COMPETITORS, f"Enter at most {LEGACY_COMPETITORS} competitors."),
        (empty("company") | empty("industry") | empty("region") | empty("target") | (F.size(competitors) == 0), "All fields are required."),
    ])


def validate(requests: DataFrame) -> DataFrame:
    """request_id, error"""
    return requests.select("request_id", problem().alias("error"))


def analyses(requests: DataFrame, created_at) -> DataFrame:
    """Queued analyses of valid requests."""
    return requests.where(problem().isNull()).select(
        F.col("request_id").alias("analysis_id"), js_trim(F.col("companyName")).alias("company_name"), js_trim(F.col("industry")).alias("industry"), js_trim(F.col("region")).alias("region"),
        "platforms", F.lit(WINDOW_DAYS).alias("window_days"), F.lit("pending").alias("status"), F.lit("Queued.").alias("status_detail"), F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def handles(requests: DataFrame, skip_blank: bool = False) -> DataFrame:
    """One row per platform and account (target first): the requested accounts; skip_blank is the pre-flight check's rule."""
    target = F.struct(F.lit("target").alias("role"), F.col("companyName").alias("name"), F.col("targetHandles").alias("handles"))
    others = F.transform("competitors", lambda c: F.struct(F.lit("competitor"), c["name"], c["handles"])).cast("array<struct<role:string,name:string,handles:map<string,string>>>")
    people = F.concat(F.array(target), F.coalesce(others, F.array().cast("array<struct<role:string,name:string,handles:map<string,string>>>")))
    rows = requests.select("request_id", F.explode("platforms").alias("platform"), people.alias("people")).select("request_id", "platform", F.explode("people").alias("p"))
    raw = F.try_element_at("p.handles", F.col("platform"))
    out = rows.select("request_id", "platform", "p.role", js_trim(F.col("p.name")).alias("display_name"), raw.alias("raw"))
    if skip_blank:
        out = out.where(~blank(F.col("raw")))
    return out.select("request_id", "platform", "role", "display_name", strip_handle(F.col("raw")).alias("handle"))


def check_handles(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """wanted with valid and followers: a profile that is missing, or has no followers, name or bio, isn't found."""
    empty = (F.coalesce("followers", F.lit(0)) == 0) & (F.coalesce(F.col("profile_name"), F.lit("")) == "") & (F.coalesce(F.col("bio"), F.lit("")) == "")
    known = profiles.select("platform", "handle", "followers", F.col("display_name").alias("profile_name"), "bio", F.lit(True).alias("__there"))
    valid = F.col("__there").isNotNull() & ~empty
    joined = wanted.join(known, ["platform", "handle"], "left").withColumn("valid", valid)
    # fixed value: the application's message
    error = F.when(~F.col("valid"), F.lit("Account not found or the actor returned no data for this handle."))
    return joined.select(*wanted.columns, "valid", F.when(F.col("valid"), F.col("followers")).alias("followers"), error.alias("error"))


def all_valid(checks: DataFrame) -> DataFrame:
    """request_id, all_valid, message: the sentence that names those that aren't, in order; null if all are."""
    name = F.when(F.col("role") == "target", F.lit("Your business")).otherwise(F.coalesce(F.nullif(js_trim(F.col("display_name")), F.lit("")), F.lit("Competitor")))
    label = F.concat(name, F.lit(" on "), F.col("platform"), F.lit(" (@"), F.col("handle"), F.lit("): "), F.col("error"))
    bad = F.array_sort(F.collect_list(F.when(~F.col("valid"), label)))
    # fixed value: the application's sentence
    message = F.when(F.size(bad) > 0, F.concat(F.lit("Couldn't verify these handles — fix them before running the analysis: "), F.array_join(bad, "; ")))
    return checks.groupBy("request_id").agg(F.bool_and("valid").alias("all_valid"), message.alias("message"))
