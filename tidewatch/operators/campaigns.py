"""Linking incidents into campaigns.

Incidents that share an IP, an employee or a device within the time window are
linked.  Sorted by time within one shared value, two rows within the window are
also connected through consecutive gaps within the window, so each value's
incidents fall into *runs* (like sessions with a long gap).  The components of
the incident-run graph are the campaigns; no pair is ever formed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import dims, texts
from tidewatch.functions.columns import micros, nonblank
from tidewatch.functions.risk import severity_rank
from tidewatch.lineage import checkpointed
from tidewatch.operators import ordering as od
from tidewatch.operators.incidents import severity_label
from tidewatch.operators.skew import skew_join

WINDOW_HOURS = 24.0
#: Edges that one task solves at once.
FINISH = 200_000
KINDS = {"ip": "source_ip", "employee": "employee_id", "device": "device_id"}
BASE_DAY = "2026-07-25"  # day given to incidents without a timestamp


def fill_keys(inc: DataFrame) -> DataFrame:
    """Missing IP from the employee's MD5, missing device from the employee number,
    missing time from the start hour on a fixed day."""
    h = F.conv(F.substring(F.md5(F.col("employee_id")), 1, 8), 16, 10).cast("long")
    ip = F.concat(F.lit("10.10."), F.shiftright(h, 8).bitwiseAND(F.lit(255)).cast("string"), F.lit("."),
                  h.bitwiseAND(F.lit(255)).cast("string"))
    hour = F.coalesce(F.col("session_start_hour").cast("int"), F.lit(12))
    start = F.to_timestamp(F.lit(BASE_DAY)) + F.make_dt_interval(hours=hour)
    return (inc.withColumn("source_ip", F.coalesce(nonblank("source_ip"), ip))
            .withColumn("device_id", F.coalesce(nonblank("device_id"), F.concat(
                F.lit("DEV-"), F.substring_index("employee_id", "-", -1))))
            .withColumn("ts", F.coalesce("ts", start)))


def _shared(inc: DataFrame) -> DataFrame:
    vals = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()])
    return inc.select("session_id", "ts", F.inline(vals)).where(nonblank("value").isNotNull())


def links(inc: DataFrame, hours: float = WINDOW_HOURS, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Consecutive incidents of one shared value at most ``hours`` apart."""
    d, o = od.order_by(_shared(inc), ["kind", "value"], micros("ts"), ["session_id"], min_rows)
    d = od.done(od.position_and_lag(d, o, "_p", {"prev_id": "session_id", "_prev": "ts"}))
    near = micros("ts") - micros("_prev") <= int(hours * 3_600_000_000)
    return d.where(near).select("kind", "value", F.col("prev_id").alias("src"), F.col("session_id").alias("dst"))


def runs(inc: DataFrame, hours: float = WINDOW_HOURS, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """(session_id, run): maximal chains of links per shared value."""
    d, o = od.order_by(_shared(inc), ["kind", "value"], micros("ts"), ["session_id"], min_rows)
    d = od.position_and_lag(d, o, "_p", {"_prev": "ts"})
    far = F.col("_prev").isNull() | (micros("ts") - micros("_prev") > int(hours * 3_600_000_000))
    d = od.running_sum(d.withColumn("_new", far.cast("int")), o, {"run_no": "_new"})
    return od.done(d).select("session_id", F.concat_ws("|", "kind", "value", "run_no").alias("run"))


def components(member_runs: DataFrame, finish: int = FINISH, sizes: list[int] | None = None) -> DataFrame:
    """(session_id, component) of the bipartite incident-run graph.

    The label of a component is its smallest session id.  Each run is a star of edges to its smallest session.  A round maps every node of the edge list to
    its neighbour of least priority (a hash, new in each round; itself if that is less), and on to that one's own, and renames the ends of all
    edges.  Edges inside a new node go, and with them components that are done, so the list shrinks by a constant factor in expectation, whatever
    the shape.  A list of at most ``finish`` edges is solved by one task.  The maps, each smaller than the one before, are put together at the end.

    Maps and lists are checkpointed; minima combine before the shuffle, and the other side of each join is unique.  ``sizes`` gets the lengths of the lists.
    """
    member_runs = checkpointed(member_runs)
    low = member_runs.groupBy("run").agg(F.min("session_id").alias("_m"))
    edges = checkpointed(member_runs.join(low, "run").select(F.col("session_id").alias("u"), F.col("_m").alias("v")).where("u != v").distinct())
    maps: list[DataFrame] = []
    while left := edges.count():
        if sizes is not None:
            sizes.append(left)
        if left <= finish:
            maps.append(checkpointed(edges.groupBy(F.lit("all")).applyInArrow(_solve, f"node {edges.schema['u'].dataType.simpleString()}, center {edges.schema['u'].dataType.simpleString()}")))
            break
        def priority(x: str) -> Column:
            return F.struct(F.xxhash64(x, F.lit(len(maps))).alias("h"), F.col(x).alias("x"))

        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ends.groupBy("u").agg(F.min(priority("v")).alias("_p")).select(F.col("u").alias("node"), F.least("_p", priority("u"))["x"].alias("center"))
        further = near.select(F.col("node").alias("center"), F.col("center").alias("_next"))
        maps.append(checkpointed(near.join(further, "center").select("node", F.col("_next").alias("center"))))
        renamed = edges
        for end in ("u", "v"):
            renamed = renamed.join(maps[-1].select(F.col("node").alias(end), F.col("center").alias(f"_{end}")), end)
        edges = checkpointed(renamed.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).where("u != v").distinct())
    nodes = member_runs.select("session_id").distinct()
    if not maps:
        return nodes.select("session_id", F.col("session_id").alias("component"))
    whole = maps.pop()
    while maps:
        after = whole.select(F.col("node").alias("center"), F.col("center").alias("_end"))
        whole = maps.pop().join(after, "center", "left").select("node", F.coalesce("_end", "center").alias("center"))
    whole = checkpointed(whole)
    least = whole.groupBy("center").agg(F.min(F.least("node", "center")).alias("component"))
    named = whole.join(least, "center").select(F.col("node").alias("session_id"), "component")
    return nodes.join(named, "session_id", "left").select("session_id", F.coalesce("component", "session_id").alias("component"))


def _solve(edges: pa.Table) -> pa.Table:
    """Components of a short edge list: every node with one node of its component."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(edges.column("u").to_pylist(), edges.column("v").to_pylist()):
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        parent[root(u)] = root(v)
    nodes = list(parent)
    kind = edges.schema.field("u").type
    return pa.table([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "center"])


def drop_minor(members: DataFrame) -> DataFrame:
    """Members without single incidents of Low or Medium severity.

    ``members`` has component, session_id and severity.
    """
    size = members.groupBy("component").agg(F.count("*").alias("_n"), F.max(severity_rank("severity")).alias("_r"))
    keep = size.where((F.col("_n") > 1) | (F.col("_r") >= dims.SEVERITY_RANK["High"])).select("component")
    return skew_join(members, keep.withColumn("_k", F.lit(1)), "component").drop("_k")


def detection_basis(chain: str = "is_attack_chain") -> Column:
    """Why the incidents belong together."""
    n = F.col("session_count")
    flags = F.array_compact(F.array(
        F.when((F.col("n_ips") < n) & (F.col("n_ips") > 0), "shared_source_ip"),
        F.when(F.col("n_employees") < n, "multiple_sessions_same_employee"),
        F.when((F.col("n_devices") < n) & (F.col("n_devices") > 0), "shared_device"),
        F.when(F.col(chain), "attack_chain_match")))
    return F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("behavioral_cluster")))


def attack_chains(members: DataFrame, chains: list[list[str]] | None = None, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """First registered chain that is an ordered subsequence of a component's attacks.

    Greedy matching needs, per chain and stage, the first position after the
    previous stage: one keyed minimum per stage (combined map-side) instead of
    collecting a component's incidents.  ``chain_no`` is 1-based, NULL if none.
    """
    chains = chains or dims.ATTACK_CHAINS
    d, o = od.order_by(members.select("component", "session_id", "ts", "attack_type"), ["component"], micros("ts"),
                       ["session_id"], min_rows)
    d = od.done(od.position_and_lag(d, o, "_pos")).select("component", "_pos", "attack_type")
    d = checkpointed(d)  # read once per stage
    at = [f"_c{i}" for i in range(len(chains))]
    state = d.groupBy("component").agg(*[F.lit(-1).cast("long").alias(c) for c in at])
    for stage in range(max(map(len, chains))):
        j = skew_join(d, state, "component", min_rows=min_rows)
        nxt = []
        for c, chain in zip(at, chains):
            if stage < len(chain):
                nxt.append(F.min(F.when((F.col("attack_type") == chain[stage]) & (F.col("_pos") > F.col(c)),
                                        F.col("_pos"))).alias(c))
            else:
                nxt.append(F.min(c).alias(c))
        state = checkpointed(j.groupBy("component").agg(*nxt))
    no = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)) for i, c in enumerate(at)])
    return state.select("component", no.alias("chain_no"))


def attack_path(members: DataFrame, page_size: int = 1000, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """Attacks of a component in time order without consecutive repeats, in pages."""
    d, o = od.order_by(members.select("component", "session_id", "ts", "attack_type"), ["component"], micros("ts"),
                       ["session_id"], min_rows)
    d = od.position_and_lag(d, o, "_pos", {"_prev": "attack_type"})
    step = F.when(F.col("_prev").eqNullSafe(F.col("attack_type")), 0).otherwise(1)
    d = od.running_sum(d.withColumn("_step", step), o, {"_no": "_step"})
    d = od.done(d.where(F.col("_step") == 1)).withColumn("_at", F.col("_no") - 1)
    return od.paged_lists(d, ["component"], "_at", "attack_type", "path", page_size)


def first_values(members: DataFrame, column: str, n: int = 3, salts: int = 32) -> DataFrame:
    """The ``n`` smallest distinct values per component, picked in two levels so that
    a huge component is not sorted in one task."""
    d = members.select("component", F.col(column).alias("v")).where(nonblank("v").isNotNull()).distinct()
    d = d.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    w1 = Window.partitionBy("component", "_s").orderBy("v")
    d = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)  # n per salt, merged below
    return d.groupBy("component").agg(F.slice(F.array_sort(F.collect_list("v")), 1, n).alias(f"first_{column}"))


def campaign_members(members: DataFrame, kind: str, page_size: int = 1000) -> DataFrame:
    """Every employee / IP / device (sorted) or session (by time) of a campaign, in pages."""
    if kind == "session":
        d, o = od.order_by(members.select("component", "session_id", "ts"), ["component"], micros("ts"), ["session_id"])
        d = od.done(od.position_and_lag(d, o, "_p"))
        return od.paged_lists(d, ["component"], "_p", "session_id", "values", page_size)
    d = members.select("component", F.col(KINDS[kind]).alias("v")).where(nonblank("v").isNotNull()).distinct()
    d, o = od.order_by(d, ["component"], F.lit(0), ["v"])
    return od.paged_lists(od.done(od.position_and_lag(d, o, "_p")), ["component"], "_p", "v", "values", page_size)


def campaigns(members: DataFrame, chains: list[list[str]] | None = None, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """One row per campaign.  Lists of unbounded length live in ``campaign_members``
    and ``attack_path``; attack types and tactics are small fixed sets."""
    chains = chains or dims.ATTACK_CHAINS
    tactic = F.create_map(*[F.lit(x) for a, (t, _, _) in dims.MITRE.items() for x in (a, t)])[F.col("attack_type")]
    agg = members.groupBy("component").agg(
        F.count("*").alias("session_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max(severity_rank("severity")).alias("_rank"), F.countDistinct("employee_id").alias("n_employees"),
        F.countDistinct(nonblank("source_ip")).alias("n_ips"), F.countDistinct(nonblank("device_id")).alias("n_devices"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"),
        F.array_sort(F.collect_set(tactic)).alias("mitre_tactics"))
    rank = F.when((F.col("session_count") >= 3) & (F.col("_rank") == 2), 3).otherwise(F.col("_rank"))
    path = attack_path(members, min_rows=min_rows)
    pages = path.groupBy("component").agg(F.count("*").alias("path_pages"),
                                          F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.array_join("path", " → ").alias("steps")))),
                                                                         lambda x: x["steps"]), " → ").alias("_path"))
    names = F.array(*[F.lit(" → ".join(c)) for c in chains])
    out = (agg.join(attack_chains(members, chains, min_rows), "component", "left").join(pages, "component", "left")
           .withColumn("overall_severity", severity_label(rank))
           .withColumn("is_attack_chain", F.col("chain_no").isNotNull() | (F.size("attack_types") > 1))
           .withColumn("chain_description", F.when(F.col("chain_no").isNotNull(), F.get(names, F.col("chain_no") - 1))
                       .when(F.size("attack_types") > 1, F.col("_path")).otherwise("")))
    return out.withColumn("detection_basis", detection_basis()).drop("_rank", "_path")


def assign_campaign_ids(camps: DataFrame, min_rows: int = od.HOT_ROWS) -> DataFrame:
    """CAMP-001, CAMP-002, … in order of the first incident."""
    d, o = od.order_by(camps, [], micros("first_seen").cast("double"), ["component"], min_rows)
    d = od.done(od.position_and_lag(d, o, "_no"))
    n = (F.col("_no") + 1).cast("string")
    return d.withColumn("campaign_id", F.concat(F.lit("CAMP-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))).drop("_no")


def campaign(camps: DataFrame, campaign_id: str) -> DataFrame:
    """One campaign by id, case ignored."""
    return camps.where(F.col("campaign_id") == campaign_id.upper())


def campaign_text(camps: DataFrame, members: DataFrame) -> DataFrame:
    """``summary`` and ``recommended_actions``."""
    for c in ("device_id", "source_ip", "employee_id"):
        camps = camps.join(first_values(members, c), "component", "left")
    chain = F.concat(F.lit("Campaign "), F.col("campaign_id"), F.lit(" follows the attack chain ("), F.col("chain_description"),
                     F.lit(") across "), F.col("n_employees").cast("string"), F.lit(" user(s) and "),
                     F.col("session_count").cast("string"), F.lit(" sessions."))
    plain = F.concat(F.lit("Campaign "), F.col("campaign_id"), F.lit(" groups ["), F.array_join("attack_types", ", "),
                     F.lit("] activity: "), F.col("session_count").cast("string"), F.lit(" sessions of "),
                     F.col("n_employees").cast("string"), F.lit(" user(s) with shared indicators."))
    wide = F.array_contains("attack_types", "Lateral Movement") | (F.col("overall_severity") == "Critical")

    def listed(c: str, before: str, after: str) -> Column:
        return F.when(F.size(f"first_{c}") > 0, F.concat(F.lit(before), F.array_join(f"first_{c}", ", "), F.lit(after)))
    actions = F.array_compact(F.array(
        F.when(wide, texts.ACTION["campaign_isolate"]).otherwise(
            listed("device_id", *texts.ACTION["campaign_hosts"])),
        F.when(wide, texts.ACTION["campaign_protocols"]),
        listed("source_ip", *texts.ACTION["campaign_addresses"]),
        listed("employee_id", *texts.ACTION["campaign_accounts"]),
        F.lit(texts.ACTION["campaign_report"])))
    return (camps.withColumn("summary", F.when(F.col("is_attack_chain"), chain).otherwise(plain))
            .withColumn("recommended_actions", actions).drop("first_device_id", "first_source_ip", "first_employee_id"))
