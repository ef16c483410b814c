"""Named queries over the driver tables: each is ``(spark, sf_dir) -> DataFrame``.

A query binds the raw tables to the frame an operator expects (``tessera.sources.bindings``) and
runs the operator over the whole table. "now" is always the data's own maximum timestamp,
passed as a scalar subquery, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fround
from tessera.operators import reports as R
from tessera.sources import bindings as B

QUERIES: dict = {}
TEL_LLM = "mcp_llm_call"


def query(fn):
    """Register ``fn``. The test tables hold UTC wall-clock times, so the session time zone is pinned
    to UTC before the plan is built (time bucketing and epoch conversions depend on it)."""
    import functools

    @functools.wraps(fn)
    def run(spark, d):
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


def _tel(spark, d, *types):
    return B.telemetry(spark, d, list(types) or None)


def _now(df, ts="timestamp"):
    return df.select(F.max(ts)).scalar()


# --- telemetry reports -----------------------------------------------------------------------
@query
def cost_by_model(spark, d):
    return R.cost_by_model(_tel(spark, d, TEL_LLM))


@query
def error_rate_by_model(spark, d):
    return R.error_rate_by_model(_tel(spark, d, TEL_LLM))


@query
def latency_by_model(spark, d):
    return R.latency_by_model(_tel(spark, d, TEL_LLM))


@query
def cache_savings(spark, d):
    return R.cache_savings(_tel(spark, d, "mcp_cache_hit"))


@query
def router_decisions(spark, d):
    return R.router_decisions(_tel(spark, d, "mcp_router_decision"))


@query
def router_decisions_by_model(spark, d):
    return R.router_decisions(_tel(spark, d), by=("selected_model",))


@query
def agent_performance(spark, d):
    return R.agent_performance(_tel(spark, d))


@query
def agent_errors(spark, d):
    """Traces with a failed span, as the telemetry events they become."""
    return FL.events_of(_tel(spark, d), TEL.AGENT_ERROR).select("session_id", "user_id", "error", "total_steps",
                                                               fround("total_cost", 6).alias("total_cost"), "total_tokens")


@query
def top_users(spark, d):
    return R.top_users(_tel(spark, d), n=10)


@query
def model_performance(spark, d):
    return R.model_performance(_tel(spark, d, TEL_LLM))


@query
def cache_hit_rate(spark, d):
    return R.cache_hit_rate(_tel(spark, d, "mcp_cache_hit", "mcp_cache_miss"))


@query
def kpi_tiles(spark, d):
    return R.kpi_tiles(_tel(spark, d))


@query
def calls_by_model(spark, d):
    return R.calls_by_model(_tel(spark, d, TEL_LLM))


@query
def system_health(spark, d):
    return R.system_health(_tel(spark, d, TEL_LLM), budget=12.0)


@query
def component_health(spark, d):
    t = _tel(spark, d)
    now = _now(t)
    recent = t.filter(F.col("timestamp") >= now - F.expr("INTERVAL 5 MINUTES"))
    return R.component_health(recent)


@query
def error_rate_alert(spark, d):
    t = _tel(spark, d)
    return R.error_rate_alert(t, _now(t), threshold=0.15, minutes=10)


@query
def model_statistics(spark, d):
    return R.model_statistics(_tel(spark, d, TEL_LLM))


@query
def complexity_breakdown(spark, d):
    return R.complexity_breakdown(_tel(spark, d, TEL_LLM))


@query
def overall_summary(spark, d):
    return R.overall_summary(_tel(spark, d, TEL_LLM))


@query
def daily_costs(spark, d):
    return R.daily_costs(_tel(spark, d, TEL_LLM))


@query
def model_costs(spark, d):
    return R.model_costs(_tel(spark, d, TEL_LLM))


@query
def cost_summary(spark, d):
    return R.cost_summary(_tel(spark, d, TEL_LLM), budget=10.0)


@query
def routing_statistics(spark, d):
    return R.routing_statistics(_tel(spark, d))


@query
def span_statistics(spark, d):
    return R.span_statistics(B.spans_from_events(B.table(spark, d, "events")))


@query
def trace_summary(spark, d):
    return R.trace_summary(B.spans_from_events(B.table(spark, d, "events")), n=None)


@query
def cache_statistics(spark, d):
    return R.cache_statistics(_tel(spark, d))


@query
def events_quality_summary(spark, d):
    return R.quality_summary(B.table(spark, d, "events"))


# --- filters and time series -----------------------------------------------------------------
from tessera.operators import filters as FL  # noqa: E402
from tessera.operators import timeseries as TS  # noqa: E402
from tessera.sources import telemetry as TEL  # noqa: E402


@query
def last_day_llm_calls(spark, d):
    t = _tel(spark, d)
    scoped = FL.time_range(FL.events_of(t, TEL.LLM_CALL), "-24h@h", _now(t))
    return scoped.select("event_id", "timestamp", "model", "cost_usd")


@query
def raw_events(spark, d):
    t = _tel(spark, d)
    return FL.raw_events(t, 50).select("event_id", "timestamp", "event_type", "user_id")


@query
def hourly_cost_timechart(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    return TS.timechart(t, {"total_cost": fround(F.sum("cost_usd"), 6), "call_count": F.count(F.lit(1))},
                        span_seconds=3600, by="model", fill=0)


@query
def cost_anomaly_band(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    series = TS.timechart(t, {"cost_5m": fround(F.sum("cost_usd"), 6)}, span_seconds=300, fill=0)
    out = TS.anomaly_band(series, "cost_5m", history=12, z=1.96)
    return out.select("_time", "cost_5m", fround("expected", 6).alias("expected"), fround("sd", 6).alias("sd"),
                      fround("upper95", 6).alias("upper95"), "breach")


@query
def latency_anomaly_trend(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    series = TS.timechart(t, {"avg_latency": fround(F.avg("latency_ms"), 6)}, span_seconds=3600, by="model",
                          fill=None)
    out = TS.anomaly_band(series, "avg_latency", by="model", history=12, z=1.96, trend=True, limit=5000.0)
    # latency is recorded with 2 decimals; the band is reported at the same precision
    return out.select("_time", "model", "avg_latency", fround("expected", 2).alias("expected"),
                      fround("upper95", 2).alias("upper95"), "breach")


@query
def bucket_analysis(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    return TS.bucket_analysis(t, _now(t), interval_minutes=60, lookback_hours=24)


@query
def budget_alerts(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    return TS.budget_alerts(t, budget=5.0, threshold=4.0).select("event_id", "timestamp", "daily_cost",
                                                                  "budget_status")


@query
def performance_alerts(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    return TS.performance_alerts(t, latency_ms=400.0).select(
        "event_id", "model", "running_count", "running_error_rate", "latency_alert", "error_rate_alert")


@query
def streamstats_rows(spark, d):
    t = _tel(spark, d)
    return TS.streamstats_count(t, "timestamp", "event_id", by=["event_type"]).select("event_id", "event_type", "row")


# --- operations hub ----------------------------------------------------------------------------
from tessera.operators import hub as H  # noqa: E402
from tessera.operators import joins as J  # noqa: E402
from tessera.operators import security as SEC  # noqa: E402
from tessera.operators import setops as U  # noqa: E402


def _map_text(c):
    """Render a map as 'k=v;k=v' in key order (stable text for cross-engine comparison)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@query
def customer_360(spark, d):
    return H.customer_360(B.hub_customers(spark, d), B.hub_orders(spark, d), B.hub_tickets(spark, d),
                          B.hub_leads(spark, d), activities=B.hub_activities(spark, d))


@query
def customer_timeline(spark, d):
    return H.customer_timeline(B.hub_activities(spark, d)).drop("payload")


@query
def inventory_status(spark, d):
    return H.inventory_status(B.hub_products(spark, d), B.hub_order_lines(spark, d), B.hub_orders(spark, d))


@query
def employee_performance(spark, d):
    out = H.employee_performance(B.hub_employees(spark, d), B.hub_activities(spark, d), B.hub_tickets(spark, d))
    return out.withColumn("by_type", _map_text(F.col("by_type")))


@query
def lead_funnel(spark, d):
    out = H.lead_funnel(B.hub_leads(spark, d), B.hub_orders(spark, d))
    return out.withColumn("by_status", _map_text(F.col("by_status")))


@query
def reconcile_detail(spark, d):
    return H.reconcile(B.hub_activities(spark, d), B.hub_orders(spark, d), B.hub_transactions(spark, d))


@query
def reconcile_summary(spark, d):
    return H.reconcile_summary(reconcile_detail(spark, d))


@query
def pending_postings(spark, d):
    return H.pending_postings(B.hub_activities(spark, d), B.hub_orders(spark, d), B.hub_transactions(spark, d))


@query
def order_totals(spark, d):
    return H.order_totals(B.hub_order_lines(spark, d), B.hub_products(spark, d))


@query
def order_activities(spark, d):
    return H.order_activities(B.hub_orders(spark, d), actor="actor_employee_id").drop("payload")


@query
def ticket_triage(spark, d):
    return H.triage(B.hub_tickets(spark, d), B.hub_employees(spark, d))


@query
def ticket_triage_sequential(spark, d):
    return H.triage(B.hub_tickets(spark, d), B.hub_employees(spark, d), sequential=True)


def _performance(spark, d):
    return H.employee_performance(B.hub_employees(spark, d), B.hub_activities(spark, d), B.hub_tickets(spark, d))


@query
def insight_signals(spark, d):
    inv = H.inventory_status(B.hub_products(spark, d), B.hub_order_lines(spark, d), B.hub_orders(spark, d))
    pipe = H.lead_funnel(B.hub_leads(spark, d), B.hub_orders(spark, d))
    return H.insight_signals(inv, pipe, _performance(spark, d))


@query
def adoption_metrics(spark, d):
    acts = B.hub_activities(spark, d)
    orders, tickets = B.hub_orders(spark, d), B.hub_tickets(spark, d)
    follow = H.draft_followups(orders, B.hub_customers(spark, d))
    know = H.capture_knowledge(H.classify_ticket(tickets))
    integ = H.reconcile_summary(H.reconcile(acts, orders, B.hub_transactions(spark, d)))
    return H.adoption_metrics(acts, B.hub_employees(spark, d), follow, tickets, know, integ,
                              now=_now(acts, "occurred_at"), window_days=7)


@query
def activity_by_source(spark, d):
    return H.activity_by_source(B.hub_activities(spark, d))


@query
def ownership_coverage(spark, d):
    return H.ownership_coverage(B.hub_owners(spark, d))


@query
def knowledge_capture(spark, d):
    return H.capture_knowledge(H.classify_ticket(B.hub_tickets(spark, d)))


@query
def followup_drafts(spark, d):
    return H.draft_followups(B.hub_orders(spark, d), B.hub_customers(spark, d))


@query
def visible_widgets(spark, d):
    return H.visible_widgets(B.hub_preferences(spark, d), B.hub_employees(spark, d).select(
        F.col("id").alias("employee_id"), "role"))


@query
def open_ticket_queue(spark, d):
    return H.work_queue(B.hub_tickets(spark, d), "as").select("id", "status", "assignee_id", "created_at")


@query
def scoped_customers_sales(spark, d):
    return SEC.scope_customers(B.hub_customers(spark, d), B.hub_tickets(spark, d), "sales", "E5")


@query
def scoped_customers_as(spark, d):
    return SEC.scope_customers(B.hub_customers(spark, d), B.hub_tickets(spark, d), "as", "E2")


@query
def scoped_tickets_as(spark, d):
    return SEC.scope_tickets(B.hub_tickets(spark, d), "as", "E2").select("id", "status", "assignee_id")


@query
def employee_principals(spark, d):
    return SEC.principals_for(B.hub_employees(spark, d)).select(
        "id", "role", F.array_join("principals", ",").alias("principals"))


@query
def orders_missing_vouchers(spark, d):
    return H.missing_from(B.hub_orders(spark, d).withColumnRenamed("id", "order_id"),
                          B.hub_transactions(spark, d), "order_id").select("order_id", "status", "total_amount")


@query
def customers_with_assigned_ticket(spark, d):
    t = B.hub_tickets(spark, d).filter(F.col("assignee_id").isNotNull())
    return H.present_in(B.hub_customers(spark, d), t, "id", "customer_id").select("id", "name")


@query
def llm_price_lookup(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    return J.lookup_model_cost(t, J.price_table(spark)).select(
        "event_id", "model", "price_pattern", "price_provider", "price_tier", "price_cost_usd")


# Event-type descriptions (stand-in lookup; unknown types get the default).
EVENT_TYPE_LABELS = [("mcp_llm_call", "LLM call"), ("mcp_cache_hit", "Cache hit"), ("mcp_cache_miss", "Cache miss")]


@query
def event_type_lookup(spark, d):
    lu = spark.createDataFrame(EVENT_TYPE_LABELS, "event_type string, label string")
    return J.lookup_with_default(_tel(spark, d), lu, "event_type", "label", "unknown").groupBy(
        "event_type", "label").agg(F.count(F.lit(1)).alias("events"))


@query
def related_entities(spark, d):
    n, r, s = B.table(spark, d, "nation"), B.table(spark, d, "region"), B.table(spark, d, "supplier")
    e1 = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"),
                                                          F.lit("in_region").alias("relation"),
                                                          F.col("r_name").alias("dst"))
    e2 = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("src"),
                                                          F.lit("located_in").alias("relation"),
                                                          F.col("n_name").alias("dst"))
    names = r.select(F.col("r_name").alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    return J.related_entities(e1.unionByName(e2), names)


@query
def parties_union(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                                           F.col("c_mktsegment").alias("segment"))
    s = B.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
                                           F.col("s_acctbal").alias("acctbal"))
    return U.union_all(c, s)


@query
def distinct_order_parts(spark, d):
    return U.drop_duplicates(B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey"))


@query
def parts_never_ordered(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("partkey"))
    li = B.table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"))
    return U.difference(p, li, keys=["partkey"])


@query
def top_parts_per_brand(spark, d):
    li = B.table(spark, d, "lineitem")
    p = B.table(spark, d, "part")
    rev = li.groupBy("l_partkey").agg(fround(F.sum("l_extendedprice"), 2).alias("revenue"))
    j = rev.join(p, rev.l_partkey == p.p_partkey).select("p_brand", "p_partkey", "revenue")
    return U.top_k(j, 3, [F.desc("revenue"), F.asc("p_partkey")], by=["p_brand"], rank_col="rank")


# --- DLP, PII and governance ---------------------------------------------------------------------
from tessera.operators import pii as PII  # noqa: E402
from tessera.operators import protect as P  # noqa: E402


def _violations(spark, d):
    return P.dlp_scan(B.dlp_requests(spark, d))


@query
def dlp_violations(spark, d):
    return _violations(spark, d).select(
        "request_id", "rule_id", "rule_name", "sensitivity", "action_taken",
        F.size("matched_patterns").alias("n_patterns"), F.array_join("matched_keywords", "|").alias("keywords"),
        "data_hash", "data_preview")


@query
def dlp_decisions(spark, d):
    return P.dlp_decide(B.dlp_requests(spark, d))


@query
def dlp_processed(spark, d):
    return P.dlp_apply(B.dlp_requests(spark, d))


@query
def dlp_statistics(spark, d):
    return R.dlp_statistics(_violations(spark, d))


@query
def violations_by_rule_action(spark, d):
    return R.violations_by_rule_action(P.violations_to_events(_violations(spark, d)))


@query
def violations_with_actions(spark, d):
    return R.violations_with_actions(P.violations_to_events(_violations(spark, d)))


@query
def dlp_burst_alert(spark, d):
    ev = P.violations_to_events(_violations(spark, d))
    return R.dlp_burst_alert(ev, _now(ev), threshold=10, minutes=10)


@query
def violation_risk(spark, d):
    return P.score_violations(_violations(spark, d)).select(
        "request_id", "rule_id", "risk_score", "risk_level", "recommended_playbook", "requires_human_review",
        "incident")


@query
def document_pii_risk(spark, d):
    return P.pii_risk(B.table(spark, d, "documents"))


@query
def document_pii_findings(spark, d):
    return P.detect_pii(B.table(spark, d, "documents"))


@query
def document_classification(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "text", "source")
    return P.classify_records(docs, ["text", "source"]).select("doc_id", "classification")


@query
def protected_documents(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "text", "source")
    return P.protect(P.classify_records(docs, ["text", "source"]), "INTERNAL")


@query
def document_entities(spark, d):
    return PII.detect_entities(B.table(spark, d, "documents"))


@query
def document_masked(spark, d):
    return PII.mask_pii(B.table(spark, d, "documents").select("doc_id", "text"), mode="format").select(
        "doc_id", "masked_text")


@query
def customer_contact_encryption(spark, d):
    c = B.hub_customers(spark, d).select("id", "email", "phone")
    enc = P.encrypt_columns(c, ["email", "phone"], "0123456789abcdef0123456789abcdef")
    dec = P.decrypt_columns(enc, ["email", "phone"], "0123456789abcdef0123456789abcdef")
    return enc.select("id", F.col("email").alias("email_enc")).join(dec.select("id", "email", "phone"), "id")


@query
def governed_document_read(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("source").alias("resource"), "doc_id", "text")
    req = B.table(spark, d, "conversations").filter(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("request_id"),
        F.concat(F.lit("u"), F.pmod(F.col("conv_id"), F.lit(5)).cast("string")).alias("user_id"),
        F.concat(F.lit("src"), F.pmod(F.col("conv_id"), F.lit(20)).cast("string")).alias("resource"))
    grants = B.table(spark, d, "nation").select(
        F.concat(F.lit("u"), F.pmod(F.col("n_nationkey"), F.lit(5)).cast("string")).alias("user_id"),
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("resource"),
        F.element_at(F.array(*[F.lit(x) for x in ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")]),
                     (F.pmod(F.col("n_nationkey"), F.lit(4)) + 1).cast("int")).alias("access_level"))
    data, audit = P.governed_read(docs, req, grants)
    return audit


# --- routing and retrieval -------------------------------------------------------------------------
from tessera.operators import routing as RT  # noqa: E402
from tessera.operators import vectors as V  # noqa: E402


@query
def prompt_complexity(spark, d):
    return RT.classify_complexity(B.prompts(spark, d)).select(
        "prompt_id", "word_count", "level", "complexity", "confidence", "estimated_tokens", "requires_tools",
        "requires_knowledge", "recommended_model")


@query
def task_complexity(spark, d):
    return RT.analyze_task(B.prompts(spark, d)).select("prompt_id", "task_complexity")


@query
def model_routing(spark, d):
    return RT.route(B.prompts(spark, d), RT.catalog_table(spark), weights=(0.3, 0.5, 0.2))


@query
def model_routing_constrained(spark, d):
    return RT.route(B.prompts(spark, d), RT.catalog_table(spark), weights=(0.6, 0.3, 0.1), max_cost=0.01,
                    max_latency_ms=2500, excluded=("gpt-4o",), preferred=("claude-3.5-sonnet",))


@query
def strategy_routing_balanced(spark, d):
    return RT.route_by_strategy(B.prompts(spark, d), RT.catalog_table(spark), "balanced")


@query
def strategy_routing_cost(spark, d):
    return RT.route_by_strategy(B.prompts(spark, d), RT.catalog_table(spark), "cost")


@query
def strategy_routing_speed(spark, d):
    return RT.route_by_strategy(B.prompts(spark, d), RT.catalog_table(spark), "speed")


@query
def prompt_cost_estimates(spark, d):
    p = RT.route_by_strategy(B.prompts(spark, d), RT.catalog_table(spark), "quality")
    p = p.join(B.prompts(spark, d).select("prompt_id", "text"), "prompt_id").withColumnRenamed("selected_model",
                                                                                              "model")
    return RT.estimate_cost(p, RT.catalog_table(spark), daily_budget=10.0, spent_today=9.99).select(
        "prompt_id", "model", "input_tokens", "estimated_cost", "within_budget")


def _llm_requests(spark, d):
    """LLM requests stand-in: each ``view`` / ``purchase`` event asks prompt ``k`` of the model bound to
    the event (purchase events use temperature 0.7)."""
    e = B.table(spark, d, "events").filter(F.col("event_type").isin("view", "purchase"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").cast("string").alias("request_id"), "ts",
                    F.concat(F.lit("prompt "), k.cast("string")).alias("prompt"),
                    B._pick(B.MODELS, F.pmod(k, F.lit(4))).alias("model"),
                    F.when(F.col("event_type") == "purchase", F.lit(0.7)).otherwise(F.lit(0.0)).alias("temperature"))


@query
def exact_cache_replay(spark, d):
    return RT.exact_cache_replay(_llm_requests(spark, d), ttl_seconds=3600)


@query
def document_chunks(spark, d):
    ch = V.chunk_documents(B.acl_documents(spark, d), keep=["acl"])
    return ch.select("doc_id", "ordinal", F.length("text").alias("chars"), F.substring("text", 1, 40).alias("head"),
                     F.array_join("acl", ",").alias("acl"))


def _chunks(spark, d):
    ch = V.chunk_documents(B.acl_documents(spark, d), keep=["acl"])
    ch = ch.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string")))
    return V.embed_hash(ch, id_col="chunk_id", dim=384)


@query
def chunk_embedding_weights(spark, d):
    ch = V.chunk_documents(B.acl_documents(spark, d), keep=["acl"])
    ch = ch.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string")))
    return V.hash_weights(ch, id_col="chunk_id", dim=384).withColumnRenamed("chunk_id", "chunk_id")


@query
def secure_chunk_search(spark, d):
    from tessera.operators.security import principals_for
    q = principals_for(B.prompts(spark, d), role="role", employee_id="employee_id")
    q = V.embed_hash(q.withColumnRenamed("prompt_id", "query_id"), id_col="query_id", dim=384)
    return V.search(_chunks(spark, d), q, k=5, principals="principals", acl="acl")


@query
def embedding_knn(spark, d):
    emb = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return V.top_k_similar(emb.withColumnRenamed("item_id", "query_id"), emb, 5)


@query
def embedding_ivf_knn(spark, d):
    emb = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return V.search_ivf(emb, emb.withColumnRenamed("item_id", "query_id"), k=5)


@query
def semantic_cache_lookup(spark, d):
    """Prompts answered earlier (cache entries = first turn of each conversation, written at ts)
    looked up by the later user turns."""
    p = B.prompts(spark, d)
    emb = V.embed_signed(p, dim=128)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    entries = emb.filter(F.col("prompt_id").endswith("-0")).select(
        F.col("prompt_id").alias("entry_id"), F.lower(F.trim("text")).alias("query"), F.lit(None).cast("string")
        .alias("model"), ts.alias("created_at"), "embedding")
    queries = emb.select(F.col("prompt_id").alias("query_id"), F.lower(F.trim("text")).alias("query"),
                         F.lit(None).cast("string").alias("model"), "embedding")
    return RT.semantic_lookup(queries, entries, threshold=0.92, now=ts)


# --- recommender ---------------------------------------------------------------------------------
from tessera.operators import recommend as M  # noqa: E402

TRAIN_END, VAL_END = 20, 25


def _rec_inputs(spark, d):
    ev = M.with_weights(B.interactions(spark, d))
    train, val, test = M.temporal_split(ev, TRAIN_END, VAL_END)
    return ev, train, val, test


def _n_items(spark, d):
    return int(B.rec_items(spark, d).select((F.max("item_id") + 1).alias("n")).first()["n"])


@query
def item_popularity(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    return M.popularity(train).withColumn("pop", fround("pop", 9))


@query
def bm25_weights(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    return M.bm25_interactions(train).select("user_id", "item_id", fround("r", 9).alias("r"), fround("w", 9).alias("w"))


@query
def item_similarity(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    sim = M.item_similarity(M.bm25_interactions(train), _n_items(spark, d))
    return sim.select("i", "j", fround("sim", 9).alias("sim"))


@query
def cf_scores(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    bm = M.bm25_interactions(train)
    return M.cf_scores(M.item_similarity(bm, _n_items(spark, d)), bm).withColumn("score", fround("score", 9))


@query
def cf_rank_norm(spark, d):
    from tessera.operators.timeseries import rank_norm
    s = cf_scores(spark, d)
    return rank_norm(s, ["user_id"], "score", "item_id").withColumn("rank_norm", fround("rank_norm", 9))


@query
def popularity_minmax(spark, d):
    from tessera.operators.timeseries import minmax
    return minmax(item_popularity(spark, d), [], "pop").withColumn("pop_minmax", fround("pop_minmax", 9))


@query
def content_profiles(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    return M.content_profiles(train, M.item_features(B.rec_items(spark, d))).withColumn("p", fround("p", 9))


@query
def context_lift(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    return M.context_affinity(train, B.rec_items(spark, d)).withColumn("lift", fround("lift", 9))


@query
def validation_truth(spark, d):
    _, train, val, _ = _rec_inputs(spark, d)
    return M.ground_truth(train, val)


@query
def validation_context(spark, d):
    _, _, val, _ = _rec_inputs(spark, d)
    return M.modal_context(val)


def _everyone(events):
    """Every user of the interactions, with or without history in the train window."""
    return events.select("user_id").distinct()


def _popularity_recs(spark, d):
    ev, train, _, _ = _rec_inputs(spark, d)
    return M.popularity_recommend(M.popularity(train), train, _everyone(ev), k=10)


@query
def popularity_recommendations(spark, d):
    return _popularity_recs(spark, d).withColumn("score", fround("score", 9))


def _truth(spark, d, window="val"):
    _, train, val, test = _rec_inputs(spark, d)
    return M.ground_truth(train, val if window == "val" else test)


@query
def popularity_evaluation(spark, d):
    return M.evaluate(_popularity_recs(spark, d), _truth(spark, d), _n_items(spark, d), k=10)


@query
def popularity_test_evaluation(spark, d):
    return M.evaluate(_popularity_recs(spark, d), _truth(spark, d, "test"), _n_items(spark, d), k=10)


def _recommender(spark, d):
    _, train, _, _ = _rec_inputs(spark, d)
    items = B.rec_items(spark, d)
    bm = M.bm25_interactions(train)
    return M.fit(train, items, M.item_similarity(bm, _n_items(spark, d)), bm.select("user_id", "item_id", "w"), M.popularity(train),
                 M.content_profiles(train, M.item_features(items)), M.context_affinity(train, items))


def _recs(spark, d, method, window="val"):
    """Top 10 of every user, in the context that is most frequent in the window."""
    ev, _, val, test = _rec_inputs(spark, d)
    return _recommender(spark, d).recommend(_everyone(ev), M.modal_context(val if window == "val" else test), method, k=10)


@query
def item_cf_recommendations(spark, d):
    return _recs(spark, d, "item_cf")


@query
def content_recommendations(spark, d):
    return _recs(spark, d, "content")


@query
def hybrid_recommendations(spark, d):
    return _recs(spark, d, "hybrid")


@query
def sim_blend_recommendations(spark, d):
    return _recs(spark, d, "sim_blend")


@query
def hybrid_evaluation(spark, d):
    return M.evaluate(_recs(spark, d, "hybrid"), _truth(spark, d), _n_items(spark, d), k=10)


@query
def hybrid_test_evaluation(spark, d):
    return M.evaluate(_recs(spark, d, "hybrid", "test"), _truth(spark, d, "test"), _n_items(spark, d), k=10)


@query
def item_cf_evaluation(spark, d):
    return M.evaluate(_recs(spark, d, "item_cf"), _truth(spark, d), _n_items(spark, d), k=10)


@query
def hybrid_explanations(spark, d):
    _, _, val, _ = _rec_inputs(spark, d)
    return _recommender(spark, d).explain(_truth(spark, d), M.modal_context(val))


@query
def hybrid_weight_tuning(spark, d):
    _, _, val, _ = _rec_inputs(spark, d)
    return _recommender(spark, d).tune_weights(_truth(spark, d), M.modal_context(val), k=10, step=0.1)


# --- cleaning and sales report -----------------------------------------------------------------------
from tessera.operators import clean as CL  # noqa: E402


def _cleaned(spark, d):
    return CL.clean_orders(B.raw_orders(spark, d), iqr_k=3.0)


@query
def cleaning_log(spark, d):
    return _cleaned(spark, d)[1]


@query
def cleaned_orders(spark, d):
    out = _cleaned(spark, d)[0]
    return out.select("order_id", "order_date", "category", "customer_region", "channel", "quantity",
                      fround("unit_price", 6).alias("unit_price"), "revenue")


@query
def sales_kpis(spark, d):
    return R.sales_kpis(_cleaned(spark, d)[0])


@query
def monthly_revenue(spark, d):
    return R.monthly_revenue(_cleaned(spark, d)[0])


@query
def revenue_by_category(spark, d):
    return R.revenue_by_category(_cleaned(spark, d)[0])


@query
def revenue_by_weekday(spark, d):
    return R.revenue_by_weekday(_cleaned(spark, d)[0])


@query
def revenue_pivot_region_channel(spark, d):
    return R.revenue_pivot(_cleaned(spark, d)[0], "customer_region", "channel",
                           values=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query
def cleaned_quality_summary(spark, d):
    return R.quality_summary(_cleaned(spark, d)[0])


# --- churn, metrics, sentiment -------------------------------------------------------------------------
from tessera.operators import models as ML  # noqa: E402


def _doc_quality_scores(spark, d):
    """Heuristic quality score of labelled documents: share of letters in the text."""
    docs = B.labeled_documents(spark, d)
    letters = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[^\p{L}]", ""))
    return docs.select(F.col("doc_id").alias("id"), "label",
                       (letters / F.greatest(F.length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1))).alias("score"))


@query
def doc_quality_metrics(spark, d):
    return ML.binary_metrics(_doc_quality_scores(spark, d))


@query
def doc_quality_roc(spark, d):
    return ML.roc_curve(_doc_quality_scores(spark, d))


@query
def doc_quality_calibration(spark, d):
    return ML.calibration_table(_doc_quality_scores(spark, d))


@query
def doc_quality_lift(spark, d):
    return ML.lift_table(_doc_quality_scores(spark, d), key="id")


@query
def doc_quality_cost_curve(spark, d):
    return ML.cost_curve(_doc_quality_scores(spark, d))


@query
def doc_quality_optimal_threshold(spark, d):
    return ML.optimal_threshold(ML.cost_curve(_doc_quality_scores(spark, d)))


@query
def churn_split(spark, d):
    return ML.stratified_split(B.churn_customers(spark, d), "churn", "customer_id").select("customer_id", "churn", "is_test")


@query
def churn_model_predictions(spark, d):
    return ML.fit_churn(B.churn_customers(spark, d))[1]


@query
def churn_model_metrics(spark, d):
    _, pred = ML.fit_churn(B.churn_customers(spark, d))
    return ML.binary_metrics(pred, label="churn", prob="p_gboost").withColumn("model", F.lit("gboost")).unionByName(
        ML.binary_metrics(pred, label="churn", prob="p_logistic").withColumn("model", F.lit("logistic")))


@query
def churn_feature_importance(spark, d):
    df = B.churn_customers(spark, d)
    models, _ = ML.fit_churn(df)
    return ML.feature_importance(models["gboost"], df)


@query
def churn_batch_scores(spark, d):
    df = B.churn_customers(spark, d)
    models, _ = ML.fit_churn(df)
    return ML.score(df, models["logistic"]).select("customer_id", "proba")


@query
def sentiment_predictions(spark, d):
    return ML.fit_sentiment(B.labeled_documents(spark, d))[2].drop("text")


@query
def sentiment_top_ngrams(spark, d):
    model, vocab, _, _ = ML.fit_sentiment(B.labeled_documents(spark, d))
    return ML.top_ngrams(model, vocab, 12)


@query
def sentiment_explanations(spark, d):
    model, vocab, pred, n_docs = ML.fit_sentiment(B.labeled_documents(spark, d))
    return ML.explain_sentiment(model, vocab, pred.select("doc_id", "text"), n_docs)


@query
def sentiment_errors(spark, d):
    return ML.misclassified(ML.fit_sentiment(B.labeled_documents(spark, d))[2]).drop("text")


# --- forecasting ---------------------------------------------------------------------------------
from tessera.operators import forecast as FC  # noqa: E402


@query
def weekly_forecast_features(spark, d):
    s = B.weekly_series(spark, d)
    out = TS.forecast_features(s, ["store"])
    return out.select("store", "week", fround("weekly_sales", 2).alias("weekly_sales"),
                      fround("lag_52", 2).alias("lag_52"), fround("sin1", 9).alias("sin1"),
                      fround("cos1", 9).alias("cos1"), fround("sin2", 9).alias("sin2"), fround("cos2", 9).alias("cos2"),
                      "t", "promo")


@query
def seasonal_naive_forecasts(spark, d):
    return FC.seasonal_naive(B.weekly_series(spark, d), ["store"], 13).withColumn(
        "forecast", fround("forecast", 2)).withColumn("actual", fround("actual", 2))


@query
def seasonal_naive_metrics(spark, d):
    return FC.backtest_metrics(FC.seasonal_naive(B.weekly_series(spark, d), ["store"], 13), ["store"])


@query
def ridge_backtest_metrics(spark, d):
    s = B.weekly_series(spark, d)
    f = FC.seasonal_naive(s, ["store"], 13).unionByName(
        FC.ridge_forecast(s, ["store"], 13).drop("lo", "hi", "folds"))
    return FC.backtest_metrics(f, ["store"])


@query
def ridge_backtest_summary(spark, d):
    return FC.backtest_summary(ridge_backtest_metrics(spark, d))


@query
def forecast_intervals(spark, d):
    f = FC.ridge_forecast(B.weekly_series(spark, d), ["store"], 13, level=0.9)
    return f.select("store", "week", "model", *[fround(c, 0).alias(c) for c in ("forecast", "actual")], "is_holiday",
                    *[fround(c, 0).alias(c) for c in ("lo", "hi")], "folds")


@query
def forecast_interval_coverage(spark, d):
    return FC.pi_coverage(FC.ridge_forecast(B.weekly_series(spark, d), ["store"], 13, level=0.9), 0.9)


@query
def hierarchical_backtest(spark, d):
    f = FC.hier_backtest(B.weekly_series(spark, d, by_dept=True), 13)
    return FC.backtest_summary(FC.backtest_metrics(f, ["store"]))


# --- more of the operations hub ------------------------------------------------------------------------
def _schedule(spark, d):
    """Deliveries as schedule entries, and what an external calendar says about all even ones, a day later or earlier."""
    o = B.hub_orders(spark, d)
    number = F.col("id").cast("long")
    stored = o.filter(F.pmod(number, F.lit(3)) != 0).select(F.col("id").alias("external_id"), F.col("status").alias("title"), F.col("created_at").alias("updated_at"))
    moved = F.when(F.pmod(number, F.lit(4)) == 0, 1).otherwise(-1)
    synced = o.filter(F.pmod(number, F.lit(2)) == 0).select(
        F.col("id").alias("external_id"), F.concat(F.lit("synced "), F.col("status")).alias("title"),
        (F.col("created_at") + F.make_dt_interval(moved)).alias("updated_at"))
    return stored, synced


@query
def schedule_sync(spark, d):
    return H.upsert(*_schedule(spark, d), "external_id", "lww").select("external_id", "title", "change")


@query
def schedule_sync_counts(spark, d):
    return H.upsert(*_schedule(spark, d), "external_id").groupBy("change").agg(F.count(F.lit(1)).alias("entries"))


@query
def tool_statistics(spark, d):
    """Clicks, signups and errors as calls of a tool of that name."""
    e = B.table(spark, d, "events").filter(F.col("event_type").isin("click", "signup", "error"))
    spans = B.spans_from_events(e).withColumn("span_type", F.lit("tool_call")).withColumn("name", F.regexp_replace("name", "^span-", "Tool: "))
    return R.tool_statistics(TEL.spans_to_events(spans))


@query
def refund_postings(spark, d):
    return H.refund_rows(B.hub_orders(spark, d).filter(F.col("status") == "in_production"))


@query
def owner_upsert(spark, d):
    return H.set_owner(B.hub_owners(spark, d), "crm", "E1", "restricted", "moved")


@query
def followup_approvals(spark, d):
    drafts = H.draft_followups(B.hub_orders(spark, d), B.hub_customers(spark, d))
    sent = drafts.withColumn("status", F.when(F.pmod(F.col("order_id").cast("long"), F.lit(4)) == 0, "sent").otherwise(F.col("status")))
    approvals = drafts.filter(F.pmod(F.col("order_id").cast("long"), F.lit(6)) == 0).select(F.col("id").alias("followup_id"))
    return H.approve(sent, approvals).select("id", "status", "already", "newly_sent")


@query
def production_queue(spark, d):
    state = F.when(F.col("status") == "placed", "queued").when(F.col("status") == "in_production", "in_progress").otherwise("done")
    jobs = B.hub_orders(spark, d).select(F.concat(F.lit("job-"), "id").alias("id"), state.alias("status"), "created_at")
    return H.work_queue(jobs, "production")


@query
def followup_queue(spark, d):
    return H.work_queue(H.draft_followups(B.hub_orders(spark, d), B.hub_customers(spark, d)), "followup").select("id", "order_id", "status")


@query
def recent_knowledge(spark, d):
    t = B.hub_tickets(spark, d).filter(F.col("status") == "resolved")
    return H.work_queue(t, "knowledge").select("id", "summary", "created_at")


@query
def visible_documents(spark, d):
    """Documents that an employee in sales may see."""
    return SEC.trim(B.acl_documents(spark, d), ["grp:all", "grp:sales", "usr:E7"]).select("doc_id", "source")


# --- streaming batch twins -------------------------------------------------------------------------
from tessera.streaming import core as ST  # noqa: E402
from tessera.streaming import remediation as RM  # noqa: E402


@query
def windowed_cost_by_model(spark, d):
    t = FL.events_of(_tel(spark, d), TEL.LLM_CALL)
    out = ST.stream_timechart(t, "1 hour", by="model", aggs={"cost": F.sum("cost_usd"), "calls": F.count(F.lit(1))})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model",
                      fround("cost", 6).alias("cost"), "calls")


def _telemetry_with_dlp(spark, d):
    return _tel(spark, d).unionByName(P.violations_to_events(_violations(spark, d)))


@query
def windowed_alerts(spark, d):
    return ST.stream_alerts(_telemetry_with_dlp(spark, d), "10 minutes")


def _alerts(spark, d):
    """Alert stream: windowed error-rate / DLP alerts plus cost and latency band breaches."""
    w = ST.stream_alerts(_telemetry_with_dlp(spark, d), "10 minutes")
    cost = cost_anomaly_band(spark, d).filter("breach").select(
        F.col("_time").alias("ts"), F.lit("cost_spike").alias("anomaly_type"), F.col("cost_5m").alias("metric_value"),
        F.lit(None).cast("string").alias("model"))
    lat = latency_anomaly_trend(spark, d).filter("breach").select(
        F.col("_time").alias("ts"), F.lit("latency_spike").alias("anomaly_type"),
        F.col("avg_latency").alias("metric_value"), "model")
    return w.unionByName(cost).unionByName(lat)


@query
def remediation_decisions(spark, d):
    return RM.remediate(_alerts(spark, d))


@query
def suppressed_alerts(spark, d):
    return RM.suppress(_alerts(spark, d), "anomaly_type", 600)


@query
def router_weight_timeline(spark, d):
    return RM.weight_timeline(RM.remediate(_alerts(spark, d)))


@query
def deduplicated_events(spark, d):
    e = B.table(spark, d, "events")
    return ST.dedupe_events(e.unionByName(e.filter(F.col("event_type") == "error")), "event_id").select(
        "event_id", "event_type")


@query
def dlp_risk_feed(spark, d):
    return ST.stream_dlp(B.dlp_requests(spark, d)).select("request_id", "rule_id", "risk_score", "risk_level",
                                                          "incident")


@query
def outbox_dispatch(spark, d):
    """Dispatch every undispatched activity once: triage opened tickets, draft follow-ups for
    deliveries, capture knowledge from resolved tickets; count outputs per route."""
    tickets, customers, orders = B.hub_tickets(spark, d), B.hub_customers(spark, d), B.hub_orders(spark, d)
    emps = B.hub_employees(spark, d)
    handlers = {
        ("as.opened", "as"): lambda a: H.triage(tickets.join(a.select(F.col("subject_id").alias("id")), "id",
                                                             "left_semi"), emps),
        ("delivery.done", "order"): lambda a: H.draft_followups(
            orders.join(a.select(F.col("subject_id").alias("id")), "id", "left_semi"), customers),
        ("as.resolved", "as"): lambda a: H.capture_knowledge(H.classify_ticket(
            tickets.join(a.select(F.col("subject_id").alias("id")), "id", "left_semi"))),
    }
    outputs, ids = ST.dispatch_batch(B.hub_activities(spark, d), None, handlers)
    parts = [o.agg(F.count(F.lit(1)).alias("outputs")).withColumn("route", F.lit(f"{t}/{s}"))
             for (t, s), o in outputs.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res.crossJoin(ids.agg(F.count(F.lit(1)).alias("processed")))


# --- sources, feeds and histories ----------------------------------------------------------------
@query
def envelope_roundtrip(spark, d):
    t = _tel(spark, d)
    env = TEL.to_envelope(t).withColumn("event", F.to_json("event"))
    back = TEL.from_envelope(env)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                          fround(F.sum("cost_usd"), 6).alias("cost_usd"))


@query
def tagged_metric_union(spark, d):
    t = _tel(spark, d)
    return TEL.tag_and_union({"agents:cost": R.cost_by_model(t), "agents:latency": R.latency_by_model(t),
                              "agents:health": R.system_health(t)})


@query
def retained_events_by_day(spark, d):
    t = _tel(spark, d)
    kept = TEL.apply_retention(t, "timestamp", 7 * 86400, _now(t))
    return kept.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("events"))


@query
def audit_trail_orders(spark, d):
    acts = B.hub_activities(spark, d)
    now = _now(acts.filter(F.col("type") == "order.placed"), "occurred_at")
    return FL.audit_trail(acts, type="order.placed", since_days=30, now=now, limit=100).select(
        "id", "type", "actor_employee_id", "subject_type", "subject_id", "source", "occurred_at")


@query
def email_violation_history(spark, d):
    ev = P.violations_to_events(_violations(spark, d))
    return FL.history(ev, rule_id="DLP-004", limit=20).select("event_id", "timestamp", "rule_id", "user_id")


@query
def dlp_feed(spark, d):
    return FL.dlp_feed(P.violations_to_events(_violations(spark, d)))


def _anomaly_events(spark, d):
    dec = RM.remediate(_alerts(spark, d))
    pol = F.create_map(*[x for p in RM.DEFAULT_POLICIES for x in (F.lit(p.anomaly_type), F.lit(float(p.trigger_threshold)))])
    return TEL.conform(dec.select(
        F.lit(TEL.ANOMALY).alias("event_type"), F.col("ts").alias("timestamp"),
        F.concat_ws(":", "anomaly_type", F.col("ts").cast("string"), F.coalesce("model", F.lit(""))).alias("event_id"),
        "anomaly_type", F.col("anomaly_type").alias("metric_name"), F.col("metric_value").alias("current_value"),
        pol[F.col("anomaly_type")].alias("threshold"), "model",
        (F.col("handled") & ~F.col("skipped")).alias("remediation_triggered")))


@query
def anomalies_by_type(spark, d):
    return R.anomalies_by_type(_anomaly_events(spark, d))


@query
def anomaly_feed(spark, d):
    return FL.anomaly_feed(_anomaly_events(spark, d))


@query
def sim_blend_alpha_tuning(spark, d):
    return _recommender(spark, d).tune_alpha(_truth(spark, d))


@query
def activity_audit_summary(spark, d):
    return R.audit_summary(B.hub_activities(spark, d), event_type="type", user="actor_employee_id",
                           violation_type="security.violation")


# --- connector payloads -------------------------------------------------------------------------------
from tessera.sources import connectors as CN  # noqa: E402


@query
def campaign_performance(spark, d):
    return CN.campaign_metrics(B.ad_insights(spark, d))


@query
def campaign_totals(spark, d):
    return R.campaign_summary(CN.campaign_metrics(B.ad_insights(spark, d)))


@query
def normalized_vouchers(spark, d):
    return CN.normalize_vouchers(B.voucher_payloads(spark, d, "voucher"), "voucher")


@query
def normalized_invoices(spark, d):
    return CN.normalize_vouchers(B.voucher_payloads(spark, d, "invoice"), "invoice")


@query
def document_permission_acl(spark, d):
    out = CN.map_permissions(B.permission_payloads(spark, d))
    return out.select("doc_id", F.array_join("acl", ",").alias("acl"))


@query
def remediation_outcomes(spark, d):
    """Per alert: handled / skipped by cooldown, the actions run and the cooldown end."""
    return RM.remediate(_alerts(spark, d)).select(
        "ts", "anomaly_type", fround("metric_value", 6).alias("metric_value"), "model", "handled", "skipped",
        "actions", "cooldown_sec", "cooldown_until")
