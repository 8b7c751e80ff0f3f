"""Checks of flow definitions as queries: rules of node kinds, of agents, and of what authors write. nodes: (id, kind, config as JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import expressions, is_expression, node_binding, reads_as_prose

# Node kinds and the values that their settings may have.
MAPPING_KINDS = ["agent", "tool_call", "http_request", "memory", "sub_workflow"]
PER_ITEM_KINDS = ["tool_call", "http_request", "memory"]
ENVELOPE_KINDS = ["agent", "tool_call", "http_request"]
OPERATIONS = ["recall", "search", "flavour", "people", "remember", "forget"]
SCOPES = ["user", "flow", "flows"]
APPROVAL_VALUES = {"wait_mode": ["suspend", "poll"], "on_reject": ["route", "error", "drop"], "on_timeout": ["error", "reject", "route"]}
LANGUAGES = ["javascript", "python"]


def _of(key: str) -> Column:
    """A setting's text; null where it is missing."""
    return F.get_json_object("config", f"$.{key}")


def _kind_of(key: str) -> Column:
    """What a setting is: object, array, string, number, boolean; null where it is missing."""
    v = F.try_variant_get(F.try_parse_json("config"), f"$.{key}", "variant")
    text = F.to_json(v)
    first = F.substring(text, 1, 1)
    return F.when(v.isNull(), None).when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(text.isin("true", "false"), "boolean").when(text == "null", "null").otherwise("number")


def _text(key: str) -> Column:
    """A setting that is a text."""
    return F.when(_kind_of(key) == "string", _of(key))


def _filled(key: str) -> Column:
    return F.coalesce(_text(key) != "", F.lit(False))


def _rules() -> dict[str, Column]:
    kind = F.col("kind")
    known = F.coalesce(_text("execution").isin("once", "per_item"), F.lit(False))
    per_item = F.when(known, _text("execution") == "per_item").otherwise(kind.isin(PER_ITEM_KINDS))
    memory, operation, scope = kind == "memory", _text("operation"), _text("scope")
    named = memory & operation.isin(OPERATIONS)
    limit = F.coalesce((_kind_of("concurrency") == "number") & _of("concurrency").rlike("^[0-9]+$") | (_text("concurrency") == "all"), F.lit(False))
    rules = {
        "execution_unknown": _kind_of("execution").isNotNull() & ~known,
        "execution_unsupported": known & ~kind.isin(MAPPING_KINDS),
        "concurrency_without_per_item": _kind_of("concurrency").isNotNull() & ~per_item,
        "on_item_error_without_per_item": _kind_of("on_item_error").isNotNull() & ~per_item,
        "concurrency_value": _kind_of("concurrency").isNotNull() & per_item & ~limit,
        "on_item_error_value": _kind_of("on_item_error").isNotNull() & per_item & ~F.coalesce(_text("on_item_error").isin("collect", "fail_fast", "skip"), F.lit(False)),
        "memory_operation_missing": memory & operation.isNull(),
        "memory_operation_unknown": memory & ~operation.isin(OPERATIONS),
        "memory_scope_read_only": named & operation.isin("remember", "forget") & scope.isin("user", "flows"),
        "memory_scope_unknown": named & ~scope.isin(SCOPES),
        "memory_scope_missing": named & operation.isin("recall", "remember", "forget") & scope.isNull(),
        "memory_query_missing": named & operation.isin("recall", "search") & ~_filled("query"),
        "memory_flavour_missing": named & (operation == "flavour") & ~_filled("flavour"),
        "memory_key_missing": named & operation.isin("remember", "forget") & ~_filled("key"),
        "memory_value_missing": named & (operation == "remember") & _kind_of("value").isNull(),
        "dedup_key_missing": (kind == "dedup") & ~_filled("key"),
        "code_language_unknown": (kind == "code") & ~_text("language").isin(LANGUAGES),
    }
    for key, allowed in APPROVAL_VALUES.items():
        rules[f"approval_{key}_value"] = (kind == "approval") & _kind_of(key).isNotNull() & ~F.coalesce(_text(key).isin(allowed), F.lit(False))
    names = F.from_json(_of("assignees"), "array<string>")
    texts = F.coalesce((_kind_of("assignees") == "array") & (F.size(names) > 0) & ~_of("assignees").rlike(r'[\[,]\s*[^"\s]'), F.lit(False))
    return rules | {"approval_assignees": (kind == "approval") & _kind_of("assignees").isNotNull() & ~texts}


def node_rule_errors(nodes: DataFrame) -> DataFrame:
    """(id, rule): every rule of its kind that a node's config breaches. One narrow pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in _rules().items()]))
    return nodes.select("id", F.explode(broken).alias("rule"))


def void_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule): void nodes with an edge out of them, and those without one into them."""
    sinks = nodes.where("kind = 'void'").select("id")
    out = sinks.join(edges.select(F.col("src").alias("id")), "id", "left_semi").withColumn("rule", F.lit("void_has_outgoing"))
    return out.unionByName(sinks.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("rule", F.lit("void_has_no_incoming")))


def agent_errors(agents: DataFrame, grants: DataFrame) -> DataFrame:
    """(agent, rule). agents: (agent, and optional limits max_steps, max_tool_calls, agent_timeout_secs, tool_timeout_secs); grants: (agent, slug, connection_ref)."""
    limits = [c for c in ("max_steps", "max_tool_calls", "agent_timeout_secs", "tool_timeout_secs") if c in agents.columns]
    zero = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(f"limit_{c}")) for c in limits])) if limits else F.array().cast("array<string>")
    own = F.concat(F.when(F.col("agent") == "", F.array(F.lit("id_empty"))).otherwise(F.array().cast("array<string>")), F.slice(zero, 1, 1))
    found = agents.select("agent", F.explode(own).alias("rule"))
    twice = agents.where("agent <> ''").groupBy("agent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("agent", F.lit("id_duplicate").alias("rule"))
    slug = F.col("slug")
    pattern = (slug == "*") | F.contains(slug, F.lit("*")) & ~F.endswith(slug, F.lit(".*"))
    rule = F.when(slug == "", "grant_empty").when(is_expression(slug), "grant_expression").when(pattern, "grant_pattern").when(is_expression(F.col("connection_ref")), "connection_expression")
    return found.unionByName(twice).unionByName(grants.select("agent", rule.alias("rule")).where("rule is not null"))


def narrowed_tools(definition: DataFrame, node: DataFrame) -> DataFrame:
    """(agent, slug): what a node may use of its agent's tools: those it names itself that a grant of the definition covers, by name or by a prefix with
    a trailing .*; where it names none, all of the definition."""
    asked = node.select("agent", "slug").distinct()
    exact = definition.select("agent", "slug").distinct()
    prefix = definition.where("slug LIKE '%.*'").select("agent", F.expr("substring(slug, 1, length(slug) - 1)").alias("prefix")).distinct()
    named = asked.join(exact, ["agent", "slug"], "left_semi")
    by_prefix = asked.join(prefix, (asked.agent == prefix.agent) & F.startswith(asked.slug, prefix.prefix), "left_semi")
    rest = exact.join(asked.select("agent").distinct(), "agent", "left_anti")
    return named.unionByName(by_prefix).distinct().unionByName(rest.select("agent", "slug"))


def prompt_errors(nodes: DataFrame) -> DataFrame:
    """(id, key): agents whose prompt or instruction is prose written as an expression."""
    keys = F.array(*[F.struct(F.lit(k).alias("key"), _text(k).alias("text")) for k in ("prompt", "instruction")])
    rows = nodes.where("kind = 'agent'").select("id", F.explode(keys).alias("k")).select("id", "k.key", "k.text")
    return rows.where(is_expression(F.col("text")) & reads_as_prose(F.trim(F.substring("text", 2, 1 << 30)))).select("id", "key")


def binding_errors(nodes: DataFrame) -> DataFrame:
    """(id, location, node_id): expressions that read a field of an enveloped node's item without going through its json."""
    found = expressions(nodes).withColumn("b", node_binding(F.col("expression"))).where(~F.col("b.through_envelope"))
    wrapped = nodes.where(F.col("kind").isin(ENVELOPE_KINDS)).select(F.col("id").alias("node_id")).distinct()
    return found.select(F.col("node").alias("id"), "location", F.col("b.node_id").alias("node_id")).join(wrapped, "node_id", "left_semi").select("id", "location", "node_id")
