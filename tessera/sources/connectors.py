"""File and connector sources: document folders, audit logs, ad insights, permission grants and
voucher payloads (S06-S10). Connector payloads arrive as JSON text (one record per row); they are
parsed with explicit schemas by ``from_json`` so the mapping runs inside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fround

# Document suffixes treated as text.
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".log")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Text files under ``root`` (recursive) with their ACL from a sidecar ``<file>.acl``
    (comma-separated principals; no sidecar = public, empty ACL)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    lower = F.lower(F.col("path"))
    is_text = F.lit(False)
    for s in TEXT_SUFFIXES:
        is_text = is_text | lower.endswith(s)
    docs = files.filter(is_text)
    acl = files.filter(lower.endswith(".acl")).select(
        F.regexp_replace("path", r"\.acl$", "").alias("path"),
        F.filter(F.transform(F.split(F.decode("content", "UTF-8"), ","), lambda p: F.trim(p)), lambda p: p != "")
        .alias("acl"))
    rel = F.regexp_replace(F.col("path"), "^" + _path_prefix(root), "")
    name = F.element_at(F.split("path", "/"), -1)
    return docs.join(acl, "path", "left").select(
        rel.alias("external_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
        F.decode("content", "UTF-8").alias("content"),
        F.coalesce(F.col("acl"), F.array().cast("array<string>")).alias("acl"), F.col("path").alias("uri"))


def _path_prefix(root: str) -> str:
    import re
    r = root.rstrip("/")
    return "(file:)?" + re.escape(r if r.startswith("/") else "/" + r) + "/"


AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("event_type", T.StringType()),
    T.StructField("user_id", T.StringType()), T.StructField("tool_name", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("result", T.StringType()),
    T.StructField("details", T.StringType())])


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit records as JSON lines."""
    df.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, event_type: str | None = None, user_id: str | None = None,
               limit: int | None = None) -> DataFrame:
    """Read the audit log back with a fixed schema; optional filters; newest first when limited."""
    df = spark.read.schema(AUDIT_SCHEMA).json(path)
    if event_type:
        df = df.filter(F.col("event_type") == event_type)
    if user_id:
        df = df.filter(F.col("user_id") == user_id)
    return df.orderBy(F.desc("timestamp")).limit(limit) if limit else df


AD_SCHEMA = T.StructType([
    T.StructField("campaign_id", T.StringType()), T.StructField("campaign_name", T.StringType()),
    T.StructField("impressions", T.StringType()), T.StructField("clicks", T.StringType()),
    T.StructField("spend", T.StringType()),
    T.StructField("actions", T.ArrayType(T.StructType([T.StructField("action_type", T.StringType()),
                                                       T.StructField("value", T.StringType())])))])


def campaign_metrics(df: DataFrame, payload: str = "payload", channel: str = "meta") -> DataFrame:
    """Ad insight rows -> metrics: conversions = sum of ``lead`` action values, ctr = clicks /
    impressions (4 dp), cpa = spend / conversions (2 dp); 0 when the denominator is 0."""
    r = df.select(F.from_json(F.col(payload), AD_SCHEMA).alias("r")).select("r.*")
    imp = F.coalesce(F.col("impressions").cast("long"), F.lit(0))
    clicks = F.coalesce(F.col("clicks").cast("long"), F.lit(0))
    spend = F.coalesce(F.col("spend").cast("double"), F.lit(0.0))
    leads = F.filter(F.coalesce(F.col("actions"), F.array()), lambda a: a["action_type"] == "lead")
    conv = F.aggregate(leads, F.lit(0).cast("long"), lambda acc, a: acc + F.coalesce(a["value"].cast("long"), F.lit(0)))
    out = r.select(F.col("campaign_id").cast("string").alias("campaign_id"),
                   F.coalesce(F.col("campaign_name"), F.lit("Meta Campaign")).alias("name"),
                   F.lit(channel).alias("channel"), imp.alias("impressions"), clicks.alias("clicks"),
                   spend.alias("spend"), conv.alias("conversions"))
    return out.select("*", fround(F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions"))
                                  .otherwise(F.lit(0.0)), 4).alias("ctr"),
                      fround(F.when(F.col("conversions") > 0, F.col("spend") / F.col("conversions"))
                             .otherwise(F.lit(0.0)), 2).alias("cpa"))


_IDENT = T.StructType([T.StructField(k, T.StructType([T.StructField("id", T.StringType())]))
                       for k in ("user", "group", "siteGroup")])
PERMISSION_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("link", T.StructType([T.StructField("scope", T.StringType())])),
    T.StructField("grantedToV2", _IDENT), T.StructField("grantedTo", _IDENT),
    T.StructField("grantedToIdentitiesV2", T.ArrayType(_IDENT)),
    T.StructField("grantedToIdentities", T.ArrayType(_IDENT))]))
NO_ACCESS = "grp:__no_access__"


def map_permissions(df: DataFrame, col: str = "permissions", out: str = "acl") -> DataFrame:
    """Permission JSON -> ACL: user -> usr:, group -> grp:, site group -> sgrp:, organisation link ->
    grp:all; any anonymous link -> [] (public wins); nothing readable -> [grp:__no_access__] (fail closed).
    Sorted, distinct."""
    perms = F.coalesce(F.from_json(F.col(col), PERMISSION_SCHEMA), F.array())
    anon = F.exists(perms, lambda p: p["link"]["scope"] == "anonymous")
    org = F.transform(F.filter(perms, lambda p: p["link"]["scope"] == "organization"), lambda p: F.lit("grp:all"))

    def idents(p):
        return F.concat(F.array(p["grantedToV2"], p["grantedTo"]),
                        F.coalesce(p["grantedToIdentitiesV2"], F.array().cast(T.ArrayType(_IDENT))),
                        F.coalesce(p["grantedToIdentities"], F.array().cast(T.ArrayType(_IDENT))))

    def names(i):
        return F.array(*[F.when(i[f]["id"].isNotNull(), F.concat(F.lit(pre + ":"), i[f]["id"]))
                         for f, pre in (("user", "usr"), ("group", "grp"), ("siteGroup", "sgrp"))])

    granted = F.flatten(F.transform(perms, lambda p: F.flatten(F.transform(F.filter(idents(p), lambda i: i.isNotNull()),
                                                                           names))))
    principals = F.array_sort(F.array_distinct(F.filter(F.concat(org, granted), lambda x: x.isNotNull())))
    acl = (F.when(anon, F.array().cast("array<string>"))
           .when(F.size(principals) > 0, principals).otherwise(F.array(F.lit(NO_ACCESS))))
    return df.withColumn(out, acl)


VOUCHER_LIST = T.StructType([T.StructField("voucher_no", T.StringType()), T.StructField("order_id", T.StringType()),
                             T.StructField("amount", T.StringType()), T.StructField("currency", T.StringType()),
                             T.StructField("voucher_type", T.StringType())])
INVOICE = T.StructType([T.StructField("Id", T.StringType()), T.StructField("PrivateNote", T.StringType()),
                        T.StructField("TotalAmt", T.StringType()),
                        T.StructField("CurrencyRef", T.StructType([T.StructField("value", T.StringType())]))])


def normalize_vouchers(df: DataFrame, shape: str, payload: str = "payload") -> DataFrame:
    """Two accounting payload shapes -> (external_id, order_id, amount, currency, kind).
    ``voucher``: voucher_no / order_id / amount / currency (default KRW) / voucher_type (default sale).
    ``invoice``: Id / order id recovered from the memo 'order <id>' / TotalAmt / CurrencyRef (default USD)."""
    if shape == "voucher":
        r = df.select(F.from_json(F.col(payload), VOUCHER_LIST).alias("r")).select("r.*")
        return r.select(F.col("voucher_no").alias("external_id"), F.nullif(F.col("order_id"), F.lit("")).alias("order_id"),
                        F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
                        F.coalesce(F.col("currency"), F.lit("KRW")).alias("currency"),
                        F.coalesce(F.col("voucher_type"), F.lit("sale")).alias("kind"))
    if shape == "invoice":
        r = df.select(F.from_json(F.col(payload), INVOICE).alias("r")).select("r.*")
        oid = F.trim(F.regexp_replace(F.coalesce(F.col("PrivateNote"), F.lit("")), "order ", ""))
        return r.select(F.coalesce(F.col("Id"), F.lit("")).alias("external_id"), F.nullif(oid, F.lit("")).alias("order_id"),
                        F.coalesce(F.col("TotalAmt").cast("double"), F.lit(0.0)).alias("amount"),
                        F.coalesce(F.col("CurrencyRef.value"), F.lit("USD")).alias("currency"), F.lit("sale").alias("kind"))
    raise ValueError("shape must be 'voucher' or 'invoice'")
