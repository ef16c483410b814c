"""Operations-hub views and orchestration.

Each view is one declarative plan (joins + aggregates) instead of per-entity query loops.
Inputs are positional DataFrames with the columns of the hub entities (see FIXTURES §4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fround, safe_div
from tessera.operators.common import checkpoint, prefix_sums

OPEN_ORDER_STATES = ("placed", "in_production")


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


# H01
def customer_360(customers: DataFrame, orders: DataFrame, tickets: DataFrame, leads: DataFrame,
                 followups: DataFrame | None = None, activities: DataFrame | None = None) -> DataFrame:
    """KPIs for every customer: orders, lifetime value (2 dp), open tickets, leads, follow-ups and the
    latest timeline entry. The full timeline is ``customer_timeline`` (long form, no per-customer lists)."""
    o = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"),
                                          F.sum("total_amount").alias("_ltv"))
    t = tickets.groupBy("customer_id").agg(_cnt(F.col("status") != "resolved").alias("open_as_tickets"),
                                           F.count(F.lit(1)).alias("as_tickets"))
    lead = leads.groupBy("customer_id").agg(F.count(F.lit(1)).alias("leads"))
    out = (customers.select(F.col("id").alias("customer_id"), "name", "segment")
           .join(o, "customer_id", "left").join(t, "customer_id", "left").join(lead, "customer_id", "left"))
    if followups is not None:
        out = out.join(followups.groupBy("customer_id").agg(F.count(F.lit(1)).alias("followups")), "customer_id", "left")
    if activities is not None:
        last = (activities.filter(F.col("subject_type") == "customer")
                .groupBy(F.col("subject_id").alias("customer_id"))
                .agg(F.max("occurred_at").alias("last_activity_at"), F.count(F.lit(1)).alias("timeline_events")))
        out = out.join(last, "customer_id", "left")
    fill = {c: 0 for c in ("orders", "open_as_tickets", "as_tickets", "leads", "followups", "timeline_events")
            if c in out.columns}
    return (out.withColumn("lifetime_value", fround(F.coalesce(F.col("_ltv"), F.lit(0.0)), 2)).drop("_ltv")
            .na.fill(fill))


def customer_timeline(activities: DataFrame) -> DataFrame:
    """Customer-anchored activities, newest first per customer (a range-partitioned global sort,
    so a very active customer is split over several tasks)."""
    return (activities.filter(F.col("subject_type") == "customer")
            .select(F.col("subject_id").alias("customer_id"), "type", F.col("occurred_at").alias("at"), "source",
                    "payload", "id")
            .orderBy(F.asc("customer_id"), F.desc("at"), F.asc("id")))


# J03 / H02
def allocated_stock(lines: DataFrame, orders: DataFrame, open_states=OPEN_ORDER_STATES) -> DataFrame:
    """Quantity per product on orders still in the pipeline (lines joined to open orders)."""
    open_orders = orders.filter(F.col("status").isin(*open_states)).select(F.col("id").alias("order_id"))
    return (lines.join(open_orders, "order_id")
            .groupBy("product_id").agg(F.sum("qty").cast("long").alias("allocated")))


def inventory_status(products: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    alloc = allocated_stock(lines, orders)
    return (products.select(F.col("id").alias("product_id"), "sku", "name", "stock_qty")
            .join(alloc, "product_id", "left")
            .withColumn("allocated", F.coalesce(F.col("allocated"), F.lit(0)).cast("long"))
            .withColumn("available", (F.col("stock_qty") - F.col("allocated")).cast("long")))


# H03
def employee_performance(employees: DataFrame, activities: DataFrame, tickets: DataFrame) -> DataFrame:
    """Activity count and count by type (a map), resolved / open tickets per employee."""
    acts = activities.filter(F.col("actor_employee_id").isNotNull())
    by_type = (acts.groupBy("actor_employee_id", "type").agg(F.count(F.lit(1)).alias("n"))
               .groupBy(F.col("actor_employee_id").alias("employee_id"))
               .agg(F.sum("n").cast("long").alias("activity_count"),
                    F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type")))
    tk = (tickets.filter(F.col("assignee_id").isNotNull())
          .groupBy(F.col("assignee_id").alias("employee_id"))
          .agg(_cnt(F.col("status") == "resolved").alias("as_resolved"),
               _cnt(F.col("status") != "resolved").alias("as_open")))
    out = (employees.select(F.col("id").alias("employee_id"), "name", "role")
           .join(by_type, "employee_id", "left").join(tk, "employee_id", "left"))
    return (out.na.fill({"activity_count": 0, "as_resolved": 0, "as_open": 0})
            .withColumn("by_type", F.coalesce(F.col("by_type"), F.create_map().cast("map<string,bigint>"))))


# H04
def lead_funnel(leads: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: lead totals by status, conversion rate (4 dp, 0 when no leads), orders and revenue."""
    by = leads.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    lead_row = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("lead_total"),
                      F.coalesce(F.sum(F.when(F.col("status") == "converted", F.col("n"))), F.lit(0)).cast("long")
                      .alias("converted"),
                      F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    ord_row = orders.agg(F.count(F.lit(1)).alias("orders"),
                         fround(F.coalesce(F.sum("total_amount"), F.lit(0.0)), 2).alias("revenue"))
    return (lead_row.crossJoin(ord_row)
            .withColumn("conversion_rate", fround(safe_div("converted", "lead_total"), 4)))


# H06
def reconcile(activities: DataFrame, orders: DataFrame, txns: DataFrame) -> DataFrame:
    """Per order id: expected (0 when cancelled) vs sale - refund amounts; status matched / missing /
    mismatched, and orphan vouchers whose order was never placed. Full outer join on order id."""
    placed = (activities.filter((F.col("type") == "order.placed") & (F.col("subject_type") == "order"))
              .select(F.col("subject_id").alias("order_id")).distinct())
    exp = (placed.join(orders.select(F.col("id").alias("order_id"), "status", "total_amount"), "order_id", "left")
           .select("order_id", F.lit(True).alias("_placed"),
                   F.when(F.col("status") == "cancelled", F.lit(0.0))
                    .otherwise(F.coalesce(F.col("total_amount"), F.lit(0.0))).alias("expected")))
    act = txns.groupBy("order_id").agg(
        F.sum(F.when(F.col("kind") == "sale", F.col("amount")).otherwise(-F.col("amount"))).alias("_actual"),
        F.count(F.lit(1)).alias("vouchers"))
    j = exp.join(act, "order_id", "full_outer")
    status = (F.when(F.col("_placed").isNull(), F.lit("orphan"))
              .when(F.col("vouchers").isNull() & (F.col("expected") == 0.0), F.lit("matched"))
              .when(F.col("vouchers").isNull(), F.lit("missing"))
              .when(F.abs(F.col("_actual") - F.col("expected")) < 0.01, F.lit("matched"))
              .otherwise(F.lit("mismatched")))
    return j.select("order_id", "expected", fround("_actual", 2).alias("actual"),
                    F.coalesce(F.col("vouchers"), F.lit(0)).alias("vouchers"), status.alias("recon_status"))


def reconcile_summary(detail: DataFrame, healthy_at: float = 0.99) -> DataFrame:
    """total placed orders, matched, missing, mismatched, orphans, integrity (4 dp, 1.0 when empty), healthy."""
    s = F.col("recon_status")
    agg = detail.agg(_cnt(s != "orphan").alias("total_orders"), _cnt(s == "matched").alias("matched"),
                     _cnt(s == "missing").alias("missing"), _cnt(s == "mismatched").alias("mismatched"),
                     _cnt(s == "orphan").alias("orphan_transactions"))
    integrity = F.when(F.col("total_orders") == 0, F.lit(1.0)).otherwise(
        fround(F.col("matched") / F.col("total_orders"), 4))
    return agg.withColumn("integrity_rate", integrity).withColumn(
        "healthy", (F.col("integrity_rate") >= healthy_at) & (F.col("orphan_transactions") == 0))


# J05 / J06
def missing_from(df: DataFrame, mirror: DataFrame, key: str, mirror_key: str | None = None) -> DataFrame:
    """Rows of ``df`` without a partner in ``mirror`` (left anti join)."""
    mk = mirror_key or key
    return df.join(mirror.select(F.col(mk).alias(key)).distinct(), key, "left_anti")


def present_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows of ``df`` having a partner in ``other`` (left semi join)."""
    ok = other_key or key
    return df.join(other.select(F.col(ok).alias(key)), key, "left_semi")


# H07
def pending_postings(activities: DataFrame, orders: DataFrame, txns: DataFrame) -> DataFrame:
    """Sale vouchers still to post: placed orders, not mirrored yet, not cancelled. Idempotent."""
    placed = (activities.filter((F.col("type") == "order.placed") & (F.col("subject_type") == "order"))
              .select(F.col("subject_id").alias("order_id"), "payload").dropDuplicates(["order_id"]))
    todo = missing_from(placed, txns, "order_id")
    o = orders.select(F.col("id").alias("order_id"), "status", "total_amount", "customer_id")
    j = todo.join(o, "order_id", "left").filter(F.coalesce(F.col("status"), F.lit("")) != "cancelled")
    amount = F.coalesce(F.col("total_amount"), F.get_json_object("payload", "$.total").cast("double"), F.lit(0.0))
    return j.select("order_id", "customer_id", F.lit("sale").alias("kind"), amount.alias("amount"),
                    F.concat(F.lit("order "), F.col("order_id")).alias("memo"))


def refund_rows(orders: DataFrame, amount: str | None = None) -> DataFrame:
    """Refund vouchers for the given (usually cancelled) orders; the signed amount is negative."""
    amt = F.col(amount) if amount else F.col("total_amount")
    return orders.select(F.col("id").alias("order_id"), F.lit("refund").alias("kind"), amt.alias("amount"),
                         (-amt).alias("signed_amount"), F.concat(F.lit("refund "), F.col("id")).alias("memo"))


# H08
def order_totals(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order total = sum(price * qty) with the line price, else the product price; qty defaults to 1; 2 dp."""
    p = products.select(F.col("id").alias("product_id"), F.col("unit_price").alias("_pp"))
    j = lines.join(p, "product_id", "left")
    price = F.coalesce(F.col("unit_price"), F.col("_pp"), F.lit(0.0))
    qty = F.coalesce(F.col("qty"), F.lit(1))
    return j.groupBy("order_id").agg(fround(F.sum(price * qty), 2).alias("total_amount"),
                                     F.count(F.lit(1)).alias("lines"))


def order_activities(orders: DataFrame, actor: str | None = None) -> DataFrame:
    """Event-store rows a placed order emits: order.placed (order and customer anchors) and
    production.queued; delivered orders also emit delivery.done (order and customer)."""
    a = F.col(actor) if actor else F.lit(None).cast("string")
    ts = F.col("created_at")

    def row(typ, subject_type, subject_id, payload, source="app", actor_col=a):
        return orders.select(F.concat(F.lit(typ + ":" + subject_type + ":"), F.col("id")).alias("id"),
                             F.lit(typ).alias("type"), actor_col.alias("actor_employee_id"),
                             F.lit(subject_type).alias("subject_type"), subject_id.alias("subject_id"),
                             payload.alias("payload"), F.lit(source).alias("source"), ts.alias("occurred_at"))

    placed_o = row("order.placed", "order", F.col("id"), F.to_json(F.struct(F.col("total_amount").alias("total"))))
    placed_c = row("order.placed", "customer", F.col("customer_id"),
                   F.to_json(F.struct(F.col("id").alias("order_id"), F.col("total_amount").alias("total"))))
    queued = row("production.queued", "production", F.concat(F.lit("job-"), F.col("id")),
                 F.to_json(F.struct(F.col("id").alias("order_id"))), actor_col=F.lit(None).cast("string"))
    delivered = orders.filter(F.col("status") == "delivered")
    d_o = delivered.select(F.concat(F.lit("delivery.done:order:"), F.col("id")).alias("id"),
                           F.lit("delivery.done").alias("type"), F.lit(None).cast("string").alias("actor_employee_id"),
                           F.lit("order").alias("subject_type"), F.col("id").alias("subject_id"),
                           F.to_json(F.struct("customer_id")).alias("payload"), F.lit("app").alias("source"),
                           ts.alias("occurred_at"))
    d_c = delivered.select(F.concat(F.lit("delivery.done:customer:"), F.col("id")).alias("id"),
                           F.lit("delivery.done").alias("type"), F.lit(None).cast("string").alias("actor_employee_id"),
                           F.lit("customer").alias("subject_type"), F.col("customer_id").alias("subject_id"),
                           F.to_json(F.struct(F.col("id").alias("order_id"))).alias("payload"),
                           F.lit("app").alias("source"), ts.alias("occurred_at"))
    return placed_o.unionByName(placed_c).unionByName(queued).unionByName(d_o).unionByName(d_c)


# H09
def upsert(target: DataFrame, source: DataFrame, key: str, policy: str = "overwrite",
           updated_at: str = "updated_at") -> DataFrame:
    """Schedule sync: merge ``source`` into ``target`` by ``key``.

    ``overwrite``: a source row always replaces the target row (what the sync code does);
    ``lww``: last-write-wins on ``updated_at``. Adds ``change`` = created / updated / unchanged.
    Duplicate keys inside ``source`` are reduced first (latest ``updated_at`` wins) so the
    outer join stays one-to-one."""
    cols = target.columns
    w = Window.partitionBy(key).orderBy(F.desc(updated_at))
    src = source.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in cols])
    s = src.select(*[F.col(c).alias(f"s_{c}") for c in cols])
    j = t.join(s, F.col(f"t_{key}") == F.col(f"s_{key}"), "full_outer")
    if policy == "overwrite":
        take_src = F.col(f"s_{key}").isNotNull()
    elif policy == "lww":
        take_src = F.col(f"s_{key}").isNotNull() & (F.col(f"t_{key}").isNull() |
                                                    (F.col(f"s_{updated_at}") >= F.col(f"t_{updated_at}")))
    else:
        raise ValueError("policy must be 'overwrite' or 'lww'")
    change = (F.when(F.col(f"t_{key}").isNull(), F.lit("created"))
              .when(take_src, F.lit("updated")).otherwise(F.lit("unchanged")))
    return j.select(*[F.when(take_src, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in cols],
                    change.alias("change"))


# Fixed values — ticket classification rules (category keywords in priority order,
# severity keywords, category owner role).
CATEGORY_KEYWORDS = [
    ("billing", ["환불", "결제", "청구", "요금", "세금계산서", "refund", "invoice", "billing", "payment", "charge"]),
    ("hardware", ["고장", "파손", "깨졌", "부품", "전원", "작동", "소음", "hardware", "broken", "power", "defect", "부러"]),
    ("software", ["오류", "버그", "앱", "로그인", "업데이트", "화면", "software", "bug", "error", "login", "app", "crash"]),
    ("delivery", ["배송", "택배", "도착", "누락", "지연", "delivery", "shipping", "late", "missing", "tracking"]),
]
HIGH_SEVERITY = ["긴급", "멈춤", "안돼", "불가", "안전", "전체", "다운", "urgent", "critical", "stopped", "safety", "down",
                 "outage"]
LOW_SEVERITY = ["문의", "질문", "사소", "how to", "question", "minor", "inquiry"]
CATEGORY_ROLE = {"billing": "accounting", "hardware": "production", "software": "production", "delivery": "as",
                 "other": "as"}


def _contains_any(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w.lower())
    return cond


def classify_ticket(df: DataFrame, text: str = "summary") -> DataFrame:
    """Category by the first keyword list that matches (else 'other'); severity high > low > medium."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    cat = F.lit("other")
    for name, words in reversed(CATEGORY_KEYWORDS):
        cat = F.when(_contains_any(t, words), F.lit(name)).otherwise(cat)
    sev = (F.when(_contains_any(t, HIGH_SEVERITY), F.lit("high"))
           .when(_contains_any(t, LOW_SEVERITY), F.lit("low")).otherwise(F.lit("medium")))
    return df.withColumn("category_rule", cat).withColumn("severity_rule", sev)


def _owner_roles(tickets: DataFrame) -> DataFrame:
    """Tickets with their category, severity and the role that owns the category."""
    cls = classify_ticket(tickets).withColumn("category", F.coalesce("category", "category_rule")).withColumn(
        "severity", F.coalesce("severity", "severity_rule"))
    role_map = tickets.sparkSession.createDataFrame(list(CATEGORY_ROLE.items()), "category string, owner_role string")
    return cls.join(F.broadcast(role_map), "category", "left").withColumn("owner_role", F.coalesce("owner_role", F.lit("as")))


def _is_open() -> Column:
    return F.coalesce(F.col("status"), F.lit("open")) != "resolved"


def _place_in(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """0-based place of each row within its group, without a task per group: prefix counts over range partitions."""
    placed = prefix_sums(df.withColumn("_one", F.lit(1)), [group, *order], ["_one"])
    placed = checkpoint(placed)
    before = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_one_cum").alias("_first"))
    return (placed.join(before, F.col(group) == F.col("_group"))
            .withColumn(out, F.col("_one_cum") - F.col("_first")).drop("_one", "_one_cum", "_group", "_first"))


def least_loaded(tickets: DataFrame, staff: DataFrame) -> DataFrame:
    """(id, emp_id): tickets (id, owner_role, created_at) of each role dealt one after the other to its least loaded member.

    ``staff`` has (emp_id, owner_role, open_load); ties go to the lowest id, and each ticket dealt adds one to the load. No
    simulation: the t-th new ticket of a member has the key (load + t, member), and the k-th ticket of a role
    takes the k-th smallest key. The keys that n tickets use lie at or below the level to which n units of water fill the
    loads; the level follows from the counts of equal loads, so at most n keys plus one per member are made and ranked.
    Tickets of a role without members are not in the result."""
    wanted = tickets.groupBy("owner_role").agg(F.count(F.lit(1)).alias("n"))
    steps = staff.groupBy("owner_role", "open_load").agg(F.count(F.lit(1)).alias("c"))
    by_load = Window.partitionBy("owner_role").orderBy("open_load")  # one row per distinct load
    steps = steps.select("owner_role", "open_load", F.sum("c").over(by_load).alias("held"),
                         F.lead("open_load").over(by_load).alias("upper"))
    # tickets it takes until all members of lower loads have risen to this one
    room = F.coalesce(F.sum(F.col("held") * (F.col("upper") - F.col("open_load"))).over(by_load.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (steps.withColumn("room", room).join(wanted, "owner_role").filter("room < n")
             .groupBy("owner_role").agg(F.max_by(F.struct("open_load", "held", "room", "n"), "open_load").alias("s"))
             .select("owner_role", (F.col("s.open_load") + F.ceil((F.col("s.n") - F.col("s.room")) / F.col("s.held")) - 1).alias("level")))
    keys = (staff.join(level, "owner_role").filter("open_load <= level")
            .select("owner_role", "emp_id", F.explode(F.sequence("open_load", "level")).alias("key")))
    keys = _place_in(keys, "owner_role", ["key", "emp_id"], "k")
    asked = _place_in(tickets.select("id", "owner_role", "created_at"), "owner_role", ["created_at", "id"], "k")
    return asked.join(keys.select("owner_role", "k", "emp_id"), ["owner_role", "k"]).select("id", "emp_id")


def triage(tickets: DataFrame, employees: DataFrame, sequential: bool = False) -> DataFrame:
    """Classify tickets and pick the owner: role by category, least open load, ties to the lowest id.

    ``sequential=False``: every ticket sees the current loads (one candidate per role).
    ``sequential=True``: open tickets without an owner are dealt one after the other in the order of (created_at, id), each
    raising its owner's load (``least_loaded``); the others keep the owner they have."""
    cls = _owner_roles(tickets)
    load = (tickets.filter(_is_open() & F.col("assignee_id").isNotNull())
            .groupBy(F.col("assignee_id").alias("emp_id")).agg(F.count(F.lit(1)).alias("open_load")))
    cand = (employees.select(F.col("id").alias("emp_id"), F.col("name").alias("assignee_name"),
                             F.col("role").alias("owner_role"))
            .join(load, "emp_id", "left").withColumn("open_load", F.coalesce(F.col("open_load"), F.lit(0))))
    if not sequential:
        best = cand.groupBy("owner_role").agg(F.min(F.struct("open_load", "emp_id", "assignee_name")).alias("b")).select(
            "owner_role", F.col("b.emp_id").alias("assignee_id_new"), F.col("b.assignee_name").alias("assignee_name"))
        out = cls.join(best, "owner_role", "left")
    else:
        new = cls.filter(_is_open() & F.col("assignee_id").isNull())
        dealt = least_loaded(new, cand).select("id", F.col("emp_id").alias("_dealt"))
        names = employees.select(F.col("id").alias("_emp"), F.col("name").alias("assignee_name"))
        out = (cls.join(dealt, "id", "left").withColumn("assignee_id_new", F.coalesce("assignee_id", "_dealt"))
               .join(names, F.col("assignee_id_new") == F.col("_emp"), "left"))
    return out.select("id", "category", "severity", "owner_role", "assignee_id_new", "assignee_name")


# H11
LOW_CONVERSION = 0.2
OVERLOAD_OPEN_AS = 3


def insight_signals(inventory: DataFrame, pipe: DataFrame, performance: DataFrame) -> DataFrame:
    """Oversold stock (high), low conversion with >= 5 leads (medium), staff with >= 3 open tickets (medium)."""
    oversold = inventory.filter(F.col("available") < 0).select(
        F.lit("inventory_oversold").alias("type"), F.lit("high").alias("severity"),
        F.concat(F.col("sku"), F.lit(" available "), F.col("available").cast("string")).alias("detail"))
    low = pipe.filter((F.col("lead_total") >= 5) & (F.col("conversion_rate") < LOW_CONVERSION)).select(
        F.lit("low_conversion").alias("type"), F.lit("medium").alias("severity"),
        F.concat(F.lit("conversion "), F.col("conversion_rate").cast("string"), F.lit(" over "),
                 F.col("lead_total").cast("string"), F.lit(" leads")).alias("detail"))
    over = performance.filter(F.col("as_open") >= OVERLOAD_OPEN_AS).select(
        F.lit("overloaded_staff").alias("type"), F.lit("medium").alias("severity"),
        F.concat(F.col("name"), F.lit(" has "), F.col("as_open").cast("string"), F.lit(" open AS tickets")).alias("detail"))
    return oversold.unionByName(low).unionByName(over)


# H05
def adoption_metrics(activities: DataFrame, employees: DataFrame, followups: DataFrame, tickets: DataFrame,
                     knowledge: DataFrame, integrity: DataFrame, now, window_days: int = 7) -> DataFrame:
    """One row: active actors in the window / employees, activity totals, follow-up approval rate,
    knowledge coverage over resolved tickets, accounting integrity (from ``reconcile_summary``)."""
    now_c = now if isinstance(now, Column) else F.lit(now)
    act = activities.agg(
        F.count_distinct(F.when((F.col("occurred_at") >= now_c - F.make_dt_interval(F.lit(window_days)))
                                & F.col("actor_employee_id").isNotNull(), F.col("actor_employee_id"))).alias("active"),
        F.count(F.lit(1)).alias("total_activity"))
    emp = employees.agg(F.count(F.lit(1)).alias("employees"))
    fu = followups.agg(F.count(F.lit(1)).alias("followups_drafted"),
                       _cnt(F.col("status") == "sent").alias("followups_sent"))
    tk = tickets.agg(_cnt(F.col("status") == "resolved").alias("resolved_tickets"))
    kn = knowledge.agg(F.count(F.lit(1)).alias("knowledge_items"))
    ig = integrity.select(F.col("integrity_rate").alias("accounting_integrity"))
    row = act.crossJoin(emp).crossJoin(fu).crossJoin(tk).crossJoin(kn).crossJoin(ig)
    r4 = lambda n, d: fround(safe_div(n, d), 4)
    return row.select(F.lit(window_days).alias("window_days"), "employees", "active",
                      r4("active", "employees").alias("dau_ratio"), "total_activity", "followups_drafted",
                      "followups_sent", r4("followups_sent", "followups_drafted").alias("approval_rate"),
                      "resolved_tickets", "knowledge_items", r4("knowledge_items", "resolved_tickets").alias("coverage"),
                      "accounting_integrity")


def activity_by_source(activities: DataFrame) -> DataFrame:
    """Activity counts by source (not windowed)."""
    return activities.groupBy("source").agg(F.count(F.lit(1)).alias("count"))


# Fixed values — governed data domains.
DOMAINS = ["marketing", "crm", "production", "inventory", "as", "accounting", "schedule", "knowledge", "performance"]


def ownership_coverage(owners: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Per domain: assigned (has an owner) or unassigned (anti join against the owner registry)."""
    spark = owners.sparkSession
    dom = spark.createDataFrame([(d,) for d in (domains or DOMAINS)], "domain string")
    assigned = owners.filter(F.col("owner_employee_id").isNotNull()).select("domain").distinct()
    a = dom.join(assigned, "domain", "left_semi").withColumn("assigned", F.lit(True))
    u = dom.join(assigned, "domain", "left_anti").withColumn("assigned", F.lit(False))
    return a.unionByName(u)


def set_owner(owners: DataFrame, domain: str, owner_employee_id: str | None, classification: str = "internal",
              notes: str | None = None) -> DataFrame:
    """Upsert one owner row by domain."""
    spark = owners.sparkSession
    new = spark.createDataFrame([(domain, owner_employee_id, classification, notes)],
                                "domain string, owner_employee_id string, classification string, notes string")
    return owners.join(new.select("domain"), "domain", "left_anti").unionByName(new)


# H13
def capture_knowledge(tickets: DataFrame) -> DataFrame:
    """Resolved tickets -> draft knowledge rows (title, templated body, tags)."""
    cat = F.coalesce(F.col("category"), F.col("category_rule")) if "category_rule" in tickets.columns \
        else F.coalesce(F.col("category"), F.lit("other"))
    res = tickets.filter(F.col("status") == "resolved")
    summary = F.coalesce(F.col("summary"), F.lit("AS resolution"))
    body = F.format_string("Symptom: %s\nCategory: %s / Severity: %s\nResolution: %s\nPrevention: (review needed)",
                           F.coalesce(F.col("summary"), F.lit("-")), cat, F.coalesce(F.col("severity"), F.lit("-")),
                           F.coalesce(F.col("resolution"), F.lit("-")))
    return res.select(F.concat(F.lit("K-"), F.col("id")).alias("id"), F.col("id").alias("ticket_id"),
                      F.concat(F.lit("["), cat, F.lit("] "), F.substring(summary, 1, 80)).alias("title"),
                      body.alias("body"), F.array(cat, F.lit("as")).alias("tags"), F.lit("draft").alias("status"))


# H14
def draft_followups(orders: DataFrame, customers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One draft per delivered order (template text); orders that already have a follow-up are skipped."""
    d = orders.filter(F.col("status") == "delivered").select(F.col("id").alias("order_id"), "customer_id")
    if existing is not None:
        d = d.join(existing.select("order_id"), "order_id", "left_anti")
    c = customers.select(F.col("id").alias("customer_id"), "name")
    text = F.format_string("%s, we are checking that your order (no. %s) arrived well. "
                           "If anything is inconvenient or unclear, please reply any time. Thank you.",
                           F.col("name"), F.substring("order_id", 1, 8))
    return d.join(c, "customer_id", "left").select(
        F.concat(F.lit("F-"), F.col("order_id")).alias("id"), "order_id", "customer_id",
        F.lit("email").alias("channel"), F.lit("draft").alias("status"), text.alias("draft"))


def approve(followups: DataFrame, approvals: DataFrame) -> DataFrame:
    """Status gate draft -> sent for approved ids; approving a sent follow-up is a no-op.
    Adds ``already`` (was sent before) and ``newly_sent``."""
    ap = approvals.select(F.col("followup_id").alias("id")).distinct().withColumn("_ap", F.lit(True))
    j = followups.join(ap, "id", "left")
    was_sent = F.col("status") == "sent"
    approved = F.coalesce(F.col("_ap"), F.lit(False))
    return (j.withColumn("already", approved & was_sent)
            .withColumn("newly_sent", approved & ~was_sent)
            .withColumn("status", F.when(approved, F.lit("sent")).otherwise(F.col("status"))).drop("_ap"))


# Fixed values — widget visibility by role and role presets.
WIDGET_ROLES = {
    "pipeline": ["sales", "manager"], "inventory": ["production", "accounting", "manager"],
    "performance": ["manager"], "accounting_health": ["accounting", "manager"], "insights": ["manager"],
    "as_queue": ["as", "manager"], "followup_queue": ["sales", "as", "manager"],
    "production_queue": ["production", "manager"], "customer_directory": ["sales", "as", "manager"],
    "knowledge_recent": ["sales", "production", "as", "accounting", "manager"],
}
ROLE_PRESETS = {
    "sales": ["pipeline", "customer_directory", "followup_queue"],
    "production": ["production_queue", "inventory"],
    "as": ["as_queue", "followup_queue", "knowledge_recent"],
    "accounting": ["accounting_health", "inventory"],
    "manager": ["pipeline", "performance", "inventory", "accounting_health", "insights"],
}


def visible_widgets(prefs: DataFrame, identities: DataFrame) -> DataFrame:
    """Per identity (employee_id, role): saved layout filtered by role (manager sees all known
    widgets), else the role preset. Output keeps layout order (``position``)."""
    spark = identities.sparkSession
    wr = spark.createDataFrame([(w, r) for w, rs in WIDGET_ROLES.items() for r in rs], "widget string, role string")
    known = spark.createDataFrame([(w,) for w in WIDGET_ROLES], "widget string")
    presets = spark.createDataFrame([(r, i, w) for r, ws in ROLE_PRESETS.items() for i, w in enumerate(ws)],
                                    "role string, position int, widget string")
    has = prefs.filter(F.size("layout") > 0).select("employee_id", "layout")
    saved = (identities.join(has, "employee_id")
             .select("employee_id", "role", F.posexplode("layout").alias("position", "widget")))
    ok_role = saved.join(F.broadcast(wr), ["widget", "role"], "left_semi")
    ok_mgr = saved.filter(F.col("role") == "manager").join(F.broadcast(known), "widget", "left_semi")
    from_saved = ok_role.filter(F.col("role") != "manager").unionByName(ok_mgr)
    no_pref = identities.join(has, "employee_id", "left_anti")
    from_preset = no_pref.join(F.broadcast(presets), "role").select("employee_id", "role", "position", "widget")
    return from_saved.unionByName(from_preset)


# F07
def work_queue(df: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Open-ticket, production and follow-up queues; recent knowledge (top 10 by default)."""
    if kind == "as":
        return df.filter(F.col("status") != "resolved").orderBy(F.asc("created_at"), F.asc("id"))
    if kind == "production":
        return df.filter(F.col("status").isin("queued", "in_progress")).orderBy(F.asc("created_at"), F.asc("id"))
    if kind == "followup":
        return df.filter(F.col("status") == "draft").orderBy(F.asc("id"))
    if kind == "knowledge":
        return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit or 10)
    raise ValueError(f"unknown queue {kind!r}")
