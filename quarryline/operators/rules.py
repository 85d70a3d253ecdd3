"""Rules on records and graphs: lifecycle, validation codes, rule dispatch and effects, confirmation gates, activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.usage import AUTHORITY, admissible, authority, pick

#: Weights of edge kinds when a search passes over them; `relates_to` carries its own (fixed values).
EDGE_WEIGHTS = {"has_tag": 0.8, "in_cluster": 0.6, "supersedes": 0.9, "contradicts": 0.3, "derived_from": 0.7}
#: Changes of state that are allowed beside staying (fixed values).
TRANSITIONS = {"active": ["expired", "archived", "disputed"], "expired": ["active", "archived"], "archived": ["active"], "disputed": ["active", "archived"]}


def edge_weight(kind: Column, own: Column) -> Column:
    return F.when(kind == "relates_to", own).otherwise(pick(kind, EDGE_WEIGHTS))


def may_change(old: Column, new: Column) -> Column:
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return (old == new) | F.coalesce(F.array_contains(allowed[old], new), F.lit(False))


def upserted(nodes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Nodes with those of `fresh` in place of older ones of the same key; of several fresh ones the last (`seq`)."""
    last = fresh.groupBy(key).agg(F.max_by(F.struct(*nodes.columns), "seq").alias("row")).select("row.*")
    return nodes.join(fresh.select(key).distinct(), key, "left_anti").unionByName(last)


def tag_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, kind of the tags of nodes (id, tags), each tag once per node."""
    tags = F.explode(F.array_distinct("tags")).alias("tag")
    return nodes.select(F.col("id").alias("src"), tags).select("src", F.concat(F.lit("tag:"), "tag").alias("dst"), F.lit("has_tag").alias("kind"))


def incoming(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that lead to the targets (dst)."""
    return edges.join(targets.select("dst").distinct(), "dst", "left_semi")


def validate_records(records: DataFrame) -> DataFrame:
    """code, id of every fault of a record, a row each.

    records: id, content, method and confidence of its source (both null: none stated), own_confidence, critical, status,
    active, deprecated, valid_from, valid_to. E01 id blank or of a reserved space, E20 no content, E22 source below its
    least confidence, E23 its confidence outside 0..1, E24 critical without a stated source, E25 own confidence outside
    0..1, E40 archived but active, E41 ends before it begins, W02 critical and disputed, W03 deprecated but active.
    """
    c = F.col
    given = c("method").isNotNull()
    outside = lambda x: (c(x) < 0) | (c(x) > 1)
    faults = {
        "E01": c("id").startswith("tag:") | c("id").startswith("cluster:") | (F.trim("id") == ""),
        "E20": F.coalesce(F.trim("content"), F.lit("")) == "",
        "E22": given & ~admissible(c("method"), c("confidence")),
        "E23": given & outside("confidence"),
        "E24": c("critical") & ~given,
        "E25": outside("own_confidence"),
        "E40": (c("status") == "archived") & c("active"),
        "E41": c("valid_to") < c("valid_from"),
        "W02": (c("status") == "disputed") & c("critical"),
        "W03": (c("status") == "active") & c("deprecated"),
    }
    codes = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in faults.items())), lambda x: x.isNotNull())
    return records.select("id", F.explode(codes).alias("code"))


def validate_edges(edges: DataFrame, reverse: DataFrame, nodes: DataFrame) -> DataFrame:
    """code, src, dst: E30 unknown source (tags and clusters aside), E31 unknown target, E32 weight outside 0..1, W01 a
    reverse edge (src, dst as forward) without its forward one. nodes: id of records, tags and clusters."""
    known = nodes.select(F.col("id").alias("src")).distinct()
    aim = known.withColumnRenamed("src", "dst")
    kept = lambda df, code: df.select(F.lit(code).alias("code"), "src", "dst")
    named = F.col("src").startswith("tag:") | F.col("src").startswith("cluster:")
    return reduce(
        DataFrame.unionByName,
        [
            kept(edges.where(~named).join(known, "src", "left_anti"), "E30"),
            kept(edges.join(aim, "dst", "left_anti"), "E31"),
            kept(edges.where("kind = 'relates_to' AND (weight < 0 OR weight > 1)"), "E32"),
            kept(reverse.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), "W01"),
        ],
    )


#: What a condition asks of an event (name of the condition: the test by its argument).
CONDITIONS = {
    "type_is": lambda c, x: F.array_contains(F.split(x, ","), c("type")),
    "has_existing": lambda c, x: c("exists"),
    "no_existing": lambda c, x: ~c("exists"),
    "has_content": lambda c, x: F.coalesce(F.trim(c("content")), F.lit("")) != "",
    "has_embedding": lambda c, x: c("embedded"),
    "source_at_least": lambda c, x: authority(c("method")) >= x.cast("int"),
    "confidence_at_least": lambda c, x: c("confidence") >= x.cast("double"),
    "similarity_at_least": lambda c, x: c("similarity") >= x.cast("double"),
    "custom": lambda c, x: F.lit(True),
}


def dispatch(events: DataFrame, rules: DataFrame) -> DataFrame:
    """What rules plan for events: seq, rule_id, outcome (applied, or why not), effects (with illegal ones left out).

    events: seq, event, type, exists, content, embedded, method, confidence, similarity, status. rules (a small table,
    broadcast): rule_id, event, types (empty: all), conditions (array of kind, arg), effects (array of kind, arg). All
    conditions must hold; an effect `transition` must be an allowed change of the event's status.
    """
    planned = events.join(F.broadcast(rules.select("rule_id", "event", "types", "conditions", "effects")), "event")
    holds = lambda x: reduce(lambda a, k: a.when(x["kind"] == k, F.coalesce(CONDITIONS[k](F.col, x["arg"]), F.lit(False))), CONDITIONS, F.when(F.lit(False), F.lit(False))).otherwise(False)
    failed = F.filter("conditions", lambda x: ~holds(x))
    fits = (F.size("types") == 0) | F.array_contains("types", F.col("type"))
    outcome = F.when(~fits, "type").when(F.size(failed) > 0, F.concat(F.lit("condition "), failed[0]["kind"])).otherwise("applied")
    legal = F.filter("effects", lambda x: (x["kind"] != "transition") | may_change(F.col("status"), x["arg"]))
    return planned.select("seq", "rule_id", outcome.alias("outcome"), F.when(outcome == "applied", legal).otherwise(F.array().cast("array<struct<kind:string,arg:string>>")).alias("effects"))


def apply_effects(records: DataFrame, plans: DataFrame) -> DataFrame:
    """Records (id, tags, status, active) after the effects of their plans (id, effects in order): tags added once and
    removed, the last allowed change of status, archived ones no longer active."""
    own = plans.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "effects"))), lambda x: x["effects"])).alias("effects"))
    kind = lambda k: F.transform(F.filter(F.coalesce("effects", F.array()), lambda x: x["kind"] == k), lambda x: x["arg"])
    status = F.aggregate(kind("transition"), F.col("status"), lambda s, x: F.when(may_change(s, x), x).otherwise(s))
    joined = records.join(own, "id", "left")
    tags = F.array_sort(F.array_except(F.array_union("tags", kind("add_tag")), kind("remove_tag")))
    return joined.select("id", tags.alias("tags"), status.alias("status"), (F.col("active") & (status != "archived")).alias("active"))


#: Kinds of edges a relation stands for; others relate (fixed values).
RELATIONS = ["relates_to", "supersedes", "contradicts", "derived_from"]


def effect_edges(plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind of the edges that effects make (id, effects); only to records that are there.

    link and derive take `relation:other`; derive leads from the other record, a contradiction both ways.
    """
    made = plans.select("id", F.explode("effects").alias("e")).select("id", "e.kind", F.element_at(F.split("e.arg", ":"), -1).alias("other"), F.split("e.arg", ":")[0].alias("relation"))
    known = made.join(nodes.select(F.col("id").alias("other")).distinct(), "other", "left_semi")
    relation = F.when(F.col("relation").isin(RELATIONS), F.col("relation"))
    edge = lambda s, t, k: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), k.alias("kind"))
    rows = (
        F.when(F.col("kind") == "link", F.array(edge("id", "other", F.coalesce(relation, F.lit("relates_to")))))
        .when(F.col("kind") == "derive", F.array(edge("other", "id", F.coalesce(relation, F.lit("derived_from")))))
        .when(F.col("kind") == "supersede", F.array(edge("id", "other", F.lit("supersedes"))))
        .when(F.col("kind") == "contradict", F.array(edge("id", "other", F.lit("contradicts")), edge("other", "id", F.lit("contradicts"))))
    )
    return known.select(F.inline(rows)).distinct()


def gates(old: dict[str, Column], new: dict[str, Column], action: Column, affected: Column, total: Column) -> Column:
    """Names of the confirmations a change needs: critical data; another value over an authoritative source's; another
    status or a removal; more than a fifth of a category."""
    no = F.lit(False)
    firm = F.coalesce(authority(old["method"]) >= AUTHORITY["structured_mapping"], no)
    names = {
        "critical": F.coalesce(old["critical"], no) | F.coalesce(new["critical"], no),
        "authoritative": firm & ~old["content"].eqNullSafe(new["content"]),
        "status": (old["status"] != new["status"]) | F.coalesce(action.isin("forget", "archive", "delete"), no),
        "batch": (total > 0) & (affected * 5 > total),
    }
    return F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in names.items())), lambda x: x.isNotNull())


def scheduled(events: DataFrame, activities: DataFrame) -> DataFrame:
    """seq, activity of the activities that events set off (a small table of them, broadcast).

    events: seq, kind (turn, topic, finalize, tick), similarity, idle_secs. activities: activity, trigger, threshold (a
    topic change at or below it), every_minutes, states (of a turn: empty or with fresh_user_turn).
    """
    fits = (
        ((F.col("trigger") == "turn") & ((F.size("states") == 0) | F.array_contains("states", F.lit("fresh_user_turn"))))
        | ((F.col("trigger") == "topic") & (F.col("similarity") <= F.col("threshold")))
        | (F.col("trigger") == "finalize")
        | ((F.col("trigger") == "tick") & (F.greatest(F.col("idle_secs"), F.lit(0)) >= F.col("every_minutes") * 60))
    )
    return events.join(F.broadcast(activities), events["kind"] == activities["trigger"]).where(fits).select("seq", "activity")


def inherited(types: DataFrame, properties: DataFrame) -> DataFrame:
    """type, property, value: own properties of a type and those of its parent it doesn't state. types: type, parent."""
    up = types.where("parent IS NOT NULL").join(properties.withColumnRenamed("type", "parent"), "parent").select("type", "property", "value")
    return properties.select("type", "property", "value").unionByName(up.join(properties, ["type", "property"], "left_anti"))
