"""Bindings from the driver's parquet tables to the frames the operators expect.

A binding renames, casts and assigns stand-in attributes (a projection or join), or, where an
operator expects an entity the tables do not hold directly (a customer feature row, a weekly
series), aggregates the raw records into that entity. It never computes a result an operator
is supposed to compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.telemetry import enrich_llm_events, spans_to_events

# The model names, complexities and strategies used for stand-in attributes.
MODELS = ["gpt-4o", "gpt-4o-mini", "claude-3.5-sonnet", "gemini-1.5-flash"]
COMPLEXITIES = ["trivial", "simple", "moderate", "complex", "expert"]
STRATEGIES = ["balanced", "cost", "quality", "speed"]

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def spans_from_events(events: DataFrame) -> DataFrame:
    """events -> trace spans: a trace is one user-day; span type follows the event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.concat(F.lit("span-"), et).alias("name"),
        F.when(et.isin("view", "error"), F.lit("llm_call"))
         .when(et.isin("click", "signup"), F.lit("cache"))
         .when(et == "purchase", F.lit("router")).alias("span_type"),
        F.when(et == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("ts").alias("start_time"),
        F.col("value").alias("duration_ms"),
        _pick(MODELS, F.pmod(k, F.lit(4))).alias("model"),
        (F.lit(100) + k * 10).cast("long").alias("prompt_tokens"),
        (F.lit(20) + k * 5).cast("long").alias("completion_tokens"),
        (F.lit(120) + k * 15).cast("long").alias("tokens_used"),
        (F.col("value") / 1000.0).alias("cost"),
        F.when(et == "error", F.lit("error")).alias("error"),
        F.col("user_id").cast("string").alias("user_id"),
        _pick(COMPLEXITIES, F.pmod(k, F.lit(5))).alias("query_complexity"),
        _pick(MODELS, F.pmod(k, F.lit(4))).alias("selected_model"),
        _pick(MODELS, F.pmod(k + 1, F.lit(4))).alias("fallback_model"),
        _pick(STRATEGIES, F.pmod(F.col("user_id"), F.lit(4))).alias("strategy"),
        (et == "click").alias("cache_hit"),
        F.concat(F.lit("session "), F.col("user_id").cast("string")).alias("trace_name"),
    )


# Raw ``events.event_type`` values behind each telemetry event type (inverse of the span binding).
RAW_TYPES = {"mcp_llm_call": ["view", "error"], "mcp_cache_hit": ["click"], "mcp_cache_miss": ["signup"],
             "mcp_router_decision": ["purchase"]}


def telemetry(spark: SparkSession, sf_dir: str, event_types: list[str] | None = None) -> DataFrame:
    """Telemetry events derived from the ``events`` table (spans -> events -> enrichment).

    With ``event_types`` (none of them trace-level), the matching raw event types are filtered before
    the binding, so the predicate reaches the parquet scan as a pushed filter."""
    ev = table(spark, sf_dir, "events")
    if event_types and all(t in RAW_TYPES for t in event_types):
        ev = ev.filter(F.col("event_type").isin(*[r for t in event_types for r in RAW_TYPES[t]]))
    return enrich_llm_events(spans_to_events(spans_from_events(ev)))


# --- operations hub --------------------------------------------------------------------------
# Stand-in roles, order states, ticket states and ticket texts.
ROLES = ["sales", "production", "as", "accounting", "manager"]
ORDER_STATUS = {"O": "placed", "P": "in_production", "F": "delivered"}
TICKET_STATUS = ["open", "in_progress", "resolved"]
TICKET_SUMMARIES = [
    "refund request for a duplicate invoice",
    "app crash after login update",
    "delivery is late and tracking shows missing parcel",
    "power defect, device stopped - urgent",
    "question about how to reset the display",
    "minor noise from the fan",
]
LEAD_STATUS = ["new", "qualified", "converted", "lost", "new"]
LEAD_SOURCE = ["ads", "web", "referral"]


def hub_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("id"),
                    F.col("s_name").alias("name"), _pick(ROLES, F.pmod(F.col("s_suppkey"), F.lit(5))).alias("role"))


def _sales_owner(custkey):
    return F.concat(F.lit("E"), (F.pmod(custkey, F.lit(20)) * 5).cast("string"))


def hub_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("segment"), _sales_owner(F.col("c_custkey")).alias("owner_employee_id"),
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
                    F.format_string("010-%04d-%04d", F.pmod(F.col("c_custkey"), F.lit(10000)).cast("int"),
                                    F.pmod(F.col("c_custkey") * 7, F.lit(10000)).cast("int")).alias("phone"))


def _order_status():
    st = F.col("o_orderstatus")
    out = F.lit(None).cast("string")
    for k, v in reversed(list(ORDER_STATUS.items())):
        out = F.when(st == k, F.lit(v)).otherwise(out)
    return out


def hub_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("customer_id"),
                    _order_status().alias("status"), F.col("o_totalprice").alias("total_amount"),
                    F.col("o_orderdate").alias("created_at"),
                    _sales_owner(F.col("o_custkey")).alias("actor_employee_id"))


def hub_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("order_id"),
                     F.col("l_partkey").cast("string").alias("product_id"),
                     F.col("l_quantity").cast("int").alias("qty"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


def hub_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"),
                    F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
                    F.col("p_name").alias("name"), F.col("p_retailprice").alias("unit_price"),
                    (F.col("p_size") * 20).cast("int").alias("stock_qty"))


def hub_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After-sales tickets: one per ``error`` event."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    status = _pick(TICKET_STATUS, F.pmod(k, F.lit(3)))
    return e.select(
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity"),
        status.alias("status"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("E"), (F.pmod(k, F.lit(20)) * 5 + 2).cast("string"))).alias("assignee_id"),
        _pick(TICKET_SUMMARIES, F.pmod(k, F.lit(6))).alias("summary"),
        F.when(status == "resolved", F.lit("part replaced and verified")).alias("resolution"),
        F.col("ts").alias("created_at"))


def hub_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads: one per ``signup`` event."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("id"),
                    F.col("user_id").cast("string").alias("customer_id"),
                    _pick(LEAD_SOURCE, F.pmod(F.col("user_id"), F.lit(3))).alias("source"),
                    _pick(LEAD_STATUS, F.pmod(k, F.lit(5))).alias("status"),
                    (k / 100.0).alias("score"))


def hub_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored vouchers: a sale per order, except a dropped subset; another subset drifted by +50."""
    o = table(spark, sf_dir, "orders").filter(F.pmod(F.col("o_orderkey"), F.lit(50)) != 0)
    drift = F.when(F.pmod(F.col("o_orderkey"), F.lit(70)) == 0, F.lit(50.0)).otherwise(F.lit(0.0))
    return o.select(F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("id"),
                    F.col("o_orderkey").cast("string").alias("order_id"),
                    F.concat(F.lit("QB-"), F.col("o_orderkey").cast("string")).alias("external_id"),
                    F.lit("sale").alias("kind"), (F.col("o_totalprice") + drift).alias("amount"),
                    F.lit("KRW").alias("currency"), F.lit("posted").alias("status"),
                    F.lit("accounting_saas").alias("source"), F.col("o_orderdate").alias("occurred_at"))


def hub_ticket_activities(tickets: DataFrame) -> DataFrame:
    """as.opened for every ticket, as.resolved for resolved ones (activity rows of the event store)."""
    opened = tickets.select(F.concat(F.lit("as.opened:"), F.col("id")).alias("id"), F.lit("as.opened").alias("type"),
                            F.lit(None).cast("string").alias("actor_employee_id"), F.lit("as").alias("subject_type"),
                            F.col("id").alias("subject_id"), F.to_json(F.struct("customer_id")).alias("payload"),
                            F.lit("app").alias("source"), F.col("created_at").alias("occurred_at"))
    resolved = tickets.filter(F.col("status") == "resolved").select(
        F.concat(F.lit("as.resolved:"), F.col("id")).alias("id"), F.lit("as.resolved").alias("type"),
        F.col("assignee_id").alias("actor_employee_id"), F.lit("as").alias("subject_type"),
        F.col("id").alias("subject_id"), F.to_json(F.struct("customer_id")).alias("payload"),
        F.lit("app").alias("source"), F.col("created_at").alias("occurred_at"))
    return opened.unionByName(resolved)


def hub_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event store: order activities (H08) plus ticket activities."""
    from tessera.operators.hub import order_activities
    return order_activities(hub_orders(spark, sf_dir), actor="actor_employee_id").unionByName(
        hub_ticket_activities(hub_tickets(spark, sf_dir)))


# Domain owned by each role (stand-in ownership registry).
ROLE_DOMAIN = {"sales": "crm", "production": "production", "as": "as", "accounting": "accounting",
               "manager": "performance"}


def hub_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hub_employees(spark, sf_dir)
    dom = F.lit(None).cast("string")
    for r, d in reversed(list(ROLE_DOMAIN.items())):
        dom = F.when(F.col("role") == r, F.lit(d)).otherwise(dom)
    return e.select(dom.alias("domain"), F.col("id").alias("owner_employee_id"),
                    F.lit("internal").alias("classification"), F.lit(None).cast("string").alias("notes"))


# A saved widget layout used as stand-in preference.
SAVED_LAYOUT = ["pipeline", "inventory", "as_queue", "insights"]


def hub_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter(F.pmod(F.col("s_suppkey"), F.lit(3)) == 0)
    return s.select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("employee_id"),
                    F.array(*[F.lit(w) for w in SAVED_LAYOUT]).alias("layout"))


# --- DLP requests ------------------------------------------------------------------------------
# Stand-in tools and destinations for conversation turns.
TOOLS = ["web_search", "email_send", "file_upload", "db_query"]
DESTINATIONS = ["", "partner.example.com", "", "mail.example.org"]


def dlp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool payloads to scan: conversation turns (user -> outbound, assistant -> inbound) and
    documents leaving through an upload/e-mail tool (outbound)."""
    c = table(spark, sf_dir, "conversations")
    d = table(spark, sf_dir, "documents")
    docs = d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"), F.col("text"),
        F.lit("outbound").alias("direction"),
        _pick(["file_upload", "email_send"], F.pmod(F.col("doc_id"), F.lit(2))).alias("tool_name"),
        F.col("source").alias("user_id"),
        _pick(DESTINATIONS, F.pmod(F.col("doc_id"), F.lit(4))).alias("destination"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("ts"))
    return docs.unionByName(c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text"),
        F.when(F.col("role") == "user", F.lit("outbound")).when(F.col("role") == "assistant", F.lit("inbound"))
         .otherwise(F.lit("internal")).alias("direction"),
        _pick(TOOLS, F.pmod(F.col("conv_id"), F.lit(4))).alias("tool_name"),
        F.concat(F.lit("u"), F.pmod(F.col("conv_id"), F.lit(50)).cast("string")).alias("user_id"),
        _pick(DESTINATIONS, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))).alias("destination"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int")))
        .alias("ts")))


# --- retrieval -----------------------------------------------------------------------------------
def document_acl(source) -> F.Column:
    """Stand-in ACL from a document's source (src<N>): N mod 4 = 0 public, 1 sales, 2 accounting,
    3 manager plus one named user."""
    n = F.regexp_extract(source, r"(\d+)$", 1).cast("int")
    return (F.when(F.pmod(n, F.lit(4)) == 0, F.array().cast("array<string>"))
            .when(F.pmod(n, F.lit(4)) == 1, F.array(F.lit("grp:sales")))
            .when(F.pmod(n, F.lit(4)) == 2, F.array(F.lit("grp:accounting")))
            .otherwise(F.array(F.lit("grp:manager"), F.lit("usr:E7"))))


def acl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "source", document_acl(F.col("source")).alias("acl"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as prompts, each asked by an employee (E<conv_id mod 100>)."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                    .alias("prompt_id"), "text",
                    F.concat(F.lit("E"), F.pmod(F.col("conv_id"), F.lit(100)).cast("string")).alias("employee_id"),
                    _pick(ROLES, F.pmod(F.pmod(F.col("conv_id"), F.lit(100)), F.lit(5))).alias("role"))


# --- recommender ---------------------------------------------------------------------------------
# Interaction types bound from events and their weights.
INTERACTION_TYPE = {"view": "view", "click": "click", "signup": "add_to_cart", "purchase": "purchase"}
N_ITEMS_EVENTS = 100
N_CATEGORIES = 8


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> implicit interactions: item = props.k, day index from 2024-01-01, device and hour bucket
    from the event; ``error`` events are not interactions."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    et = F.col("event_type")
    typ = F.lit(None).cast("string")
    for k, v in reversed(list(INTERACTION_TYPE.items())):
        typ = F.when(et == k, F.lit(v)).otherwise(typ)
    h = F.hour("ts")
    return e.select(F.col("user_id"), F.get_json_object("props", "$.k").cast("long").alias("item_id"),
                    typ.alias("event_type"),
                    F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"),
                    F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, F.lit("desktop")).otherwise(F.lit("mobile"))
                    .alias("device"),
                    F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "day").otherwise("evening")
                    .alias("hour_bucket"),
                    F.dayofweek("ts").isin(1, 7).alias("is_weekend"), "event_id")


def rec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item catalog the interactions refer to (every item id seen in ``events``)."""
    e = table(spark, sf_dir, "events")
    ids = e.select(F.get_json_object("props", "$.k").cast("long").alias("item_id")).distinct()
    return ids.select("item_id", F.concat(F.lit("cat"), F.pmod(F.col("item_id"), F.lit(N_CATEGORIES)).cast("string"))
                      .alias("category"), (F.pmod(F.col("item_id"), F.lit(3)) + 1).cast("int").alias("price_tier"))


# --- sales / cleaning --------------------------------------------------------------------------------
def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines as an export would deliver them: category label case/spacing varies by line,
    dates alternate between ISO and US text, some regions and prices are missing."""
    li, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # the long table is joined with the narrow rest: orders know their region before the lines meet them, lines their type
    places = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    j = li.join(p, li.l_partkey == p.p_partkey).join(o.join(places, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    us = F.pmod(F.col("l_orderkey"), F.lit(5)) == 0
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(us, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")))
         .when(F.col("l_linenumber") == 4, F.upper("p_type")).otherwise(F.initcap("p_type")).alias("category"),
        F.when(F.pmod(F.col("c_custkey"), F.lit(17)) == 0, F.lit(None).cast("string")).otherwise(F.col("r_name"))
        .alias("customer_region"),
        F.col("o_orderpriority").alias("channel"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(23)) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


# --- churn / sentiment / weekly series ---------------------------------------------------------------
PAYMENT = ["card", "bank_transfer", "check"]


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: features from orders before the cutoff (last order date - 365 days),
    label churn = no order after the cutoff."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    t = hub_tickets(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("support_tickets"))
    maxd = o.select(F.max("o_orderdate")).scalar()
    cut = maxd - F.expr("INTERVAL 365 DAYS")
    before = o.filter(F.col("o_orderdate") < cut)
    feats = before.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("_first"), F.sum("o_totalprice").alias("_spend"),
        F.countDistinct("o_orderpriority").alias("num_services"),
        F.sum(F.when(F.col("o_orderdate") >= cut - F.expr("INTERVAL 365 DAYS"), 1).otherwise(0)).alias("_y1"),
        F.sum(F.when((F.col("o_orderdate") < cut - F.expr("INTERVAL 365 DAYS"))
                     & (F.col("o_orderdate") >= cut - F.expr("INTERVAL 730 DAYS")), 1).otherwise(0)).alias("_y0"))
    after = o.filter(F.col("o_orderdate") >= cut).select(F.col("o_custkey").alias("c_custkey")).distinct() \
        .withColumn("_active", F.lit(1))
    tenure = F.floor(F.months_between(cut, F.col("_first"))).cast("int")
    j = c.join(feats, "c_custkey").join(after, "c_custkey", "left") \
        .join(t, F.col("customer_id") == F.col("c_custkey").cast("string"), "left")
    return j.select(
        F.col("c_custkey").alias("customer_id"), tenure.alias("tenure_months"),
        F.col("c_mktsegment").alias("contract"), _pick(PAYMENT, F.pmod(F.col("c_nationkey"), F.lit(3))).alias("payment_method"),
        F.col("num_services").cast("int"),
        (F.col("_spend") / F.greatest(tenure, F.lit(1)) / 1000.0).alias("monthly_charges"),
        F.coalesce(F.col("support_tickets"), F.lit(0)).cast("int").alias("support_tickets"),
        ((F.col("_y1") - F.col("_y0")) / F.greatest(F.col("_y0"), F.lit(1))).cast("double").alias("usage_trend"),
        F.when(F.col("_active").isNull(), 1).otherwise(0).alias("churn"))


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "text", F.col("quality").alias("label"), "toxic")


def weekly_series(spark: SparkSession, sf_dir: str, by_dept: bool = False) -> DataFrame:
    """Weekly sales per store (= the customer's region), optionally per department (= order
    priority); weeks end on Friday. No holidays or promotions are recorded in these tables."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    week = F.next_day(F.date_sub(F.to_date("o_orderdate"), 1), "Fri")
    keys = [F.col("n_regionkey").cast("int").alias("store"), week.alias("week")]
    if by_dept:
        keys.insert(1, F.col("o_orderpriority").alias("dept"))
    g = j.groupBy(*keys).agg(F.sum("o_totalprice").alias("weekly_sales"))
    return g.withColumn("is_holiday", F.lit(False)).withColumn("holiday_name", F.lit(None).cast("string")) \
        .withColumn("has_promo", F.lit(False))


# --- connector payloads ------------------------------------------------------------------------------
def ad_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad-insight payloads (JSON text, one per campaign = props.k mod 10): impressions = views,
    clicks = clicks, spend = summed value, actions = signups as 'lead' and purchases as 'purchase'."""
    e = table(spark, sf_dir, "events")
    camp = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(10))
    g = e.groupBy(camp.alias("cid")).agg(
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("impressions"),
        F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"),
        F.round(F.sum("value"), 2).alias("spend"),
        F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("leads"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("purchases"))
    payload = F.to_json(F.struct(
        F.col("cid").cast("string").alias("campaign_id"), F.concat(F.lit("campaign "), F.col("cid").cast("string"))
        .alias("campaign_name"), F.col("impressions").cast("string").alias("impressions"),
        F.col("clicks").cast("string").alias("clicks"), F.col("spend").cast("string").alias("spend"),
        F.array(F.struct(F.lit("lead").alias("action_type"), F.col("leads").cast("string").alias("value")),
                F.struct(F.lit("purchase").alias("action_type"), F.col("purchases").cast("string").alias("value")))
        .alias("actions")))
    return g.select(payload.alias("payload"))


def voucher_payloads(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """Mirrored vouchers as the accounting APIs return them (JSON text per voucher)."""
    t = hub_transactions(spark, sf_dir)
    if shape == "voucher":
        p = F.to_json(F.struct(F.col("external_id").alias("voucher_no"), "order_id",
                               F.col("amount").cast("string").alias("amount"), "currency",
                               F.col("kind").alias("voucher_type")))
    else:
        p = F.to_json(F.struct(F.col("external_id").alias("Id"), F.concat(F.lit("order "), F.col("order_id"))
                               .alias("PrivateNote"), F.col("amount").cast("string").alias("TotalAmt")))
    return t.select(p.alias("payload"))


def permission_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph-style permission JSON per document, built from the stand-in ACL: public documents carry an
    anonymous link, group principals a group grant, user principals a user grant."""
    d = acl_documents(spark, sf_dir)
    grant = F.transform("acl", lambda p: F.when(
        p.startswith("usr:"), F.struct(F.lit(None).cast("struct<scope:string>").alias("link"),
                                       F.struct(F.struct(F.substring(p, 5, 1000).alias("id")).alias("user"),
                                                F.lit(None).cast("struct<id:string>").alias("group")).alias("grantedToV2")))
        .otherwise(F.struct(F.lit(None).cast("struct<scope:string>").alias("link"),
                            F.struct(F.lit(None).cast("struct<id:string>").alias("user"),
                                     F.struct(F.substring(p, 5, 1000).alias("id")).alias("group")).alias("grantedToV2"))))
    anon = F.array(F.struct(F.struct(F.lit("anonymous").alias("scope")).alias("link"),
                            F.lit(None).cast("struct<user:struct<id:string>,group:struct<id:string>>").alias("grantedToV2")))
    perms = F.when(F.size("acl") == 0, anon).otherwise(grant)
    return d.select("doc_id", F.to_json(perms).alias("permissions"))
