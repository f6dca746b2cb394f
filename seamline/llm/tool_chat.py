"""Tool calls in conversations, linked with their results, ordered, validated and written as canonical JSON.

Method: calls and results meet in a hash join on conversation and call identifier. A call may name calls it
depends on; calls are ordered so that none comes before what it needs. Arguments are checked against the
schema of the tool. Everything is one row per call; a conversation is never gathered. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.session import cut_lineage

#: Schema of a tool: field name -> (SQL type of its value, whether it must be there).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each row of ``calls`` (conv_id, call_id, ...) with columns result and n_results of ``results`` (conv_id,
    call_id, turn, content).

    Of several results the one of the earliest turn counts (of one turn, the smallest content). Calls without a
    result, or with a null identifier, have a null result and n_results 0. Results without a call are left out.
    """
    first = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("turn").isNull().alias("last"), "turn", "content")).alias("__first"), F.count("*").alias("n_results")
    )
    joined = calls.drop("result", "n_results").join(first, ["conv_id", "call_id"], "left")
    return joined.withColumns({"result": F.col("__first.content"), "n_results": F.coalesce("n_results", F.lit(0).cast("long"))}).drop("__first")


def order(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, position, depends_on array<string>) with order_major, order_minor and cyclic.

    Sorting the calls of a conversation by (order_major, order_minor, position) puts each behind all calls it
    depends on: order_major is the largest position among a call and what it needs, directly or not, and
    order_minor the number of steps from the call that has it. Calls that only depend on earlier ones, the
    usual case, keep their position and need no round; each round follows one more link to a later call, up to the
    longest chain, or twice the number of raised calls of a conversation that holds a cycle.
    Calls in a cycle, or that need one and do not come after it, are flagged and keep their position. Dependencies that no call of the
    conversation has, null ones included, are ignored. Of rows that repeat an identifier, the earliest counts.
    """
    spot = F.coalesce(F.col("position").cast("long"), F.lit(0))
    base = calls.drop("order_major", "order_minor", "cyclic")
    known = base.where("conv_id is not null and call_id is not null")
    nodes = known.groupBy("conv_id", "call_id").agg(F.min_by(F.struct(spot.alias("position"), F.array_sort("depends_on").alias("depends_on")), F.struct(spot, F.array_sort("depends_on"))).alias("n"))
    wanted = nodes.select("conv_id", F.col("call_id").alias("user"), F.col("n.position").alias("at"), F.explode("n.depends_on").alias("call_id"))
    edges = cut_lineage(
        wanted.join(nodes.select("conv_id", "call_id", F.col("n.position").alias("needed_at")), ["conv_id", "call_id"])
        .select("conv_id", "user", "at", F.col("call_id").alias("needed"), "needed_at").distinct()
    )
    raised = edges.where("needed_at >= at").groupBy("conv_id", "user").agg(F.max(F.struct(F.col("needed_at").alias("major"), F.lit(1).cast("long").alias("minor"))).alias("key"))
    moved = cut_lineage(raised)
    left = _size(moved)
    while left[0]:
        # a chain without a cycle has no more steps than its conversation has raised calls; after twice as many rounds
        # all calls of a cycle are beyond that, and nothing more is pushed
        going = moved.join(_members(moved), "conv_id").where("key.minor <= 2 * members + 2")
        # what a raised call needs of its users: to come one step behind it, if they come before it now
        pushed = (
            edges.join(going.select("conv_id", F.col("user").alias("needed"), "key"), ["conv_id", "needed"])
            .where("key.major >= at")
            .select("conv_id", "user", F.struct(F.col("key.major").alias("major"), (F.col("key.minor") + 1).alias("minor")).alias("key"))
        )
        moved = cut_lineage(moved.unionByName(pushed).groupBy("conv_id", "user").agg(F.max("key").alias("key")))
        now = _size(moved)
        if now == left:
            break
        left = now
    key = moved.join(_members(moved), "conv_id").select("conv_id", F.col("user").alias("call_id"), "key", (F.col("key.minor") > F.col("members")).alias("__turning"))
    placed = base.join(key, ["conv_id", "call_id"], "left")
    cyclic = F.coalesce("__turning", F.lit(False))
    return placed.withColumns({"cyclic": cyclic, "order_major": F.when(cyclic | F.col("key").isNull(), spot).otherwise(F.col("key.major")), "order_minor": F.when(cyclic | F.col("key").isNull(), F.lit(0)).otherwise(F.col("key.minor")).cast("long")}).drop("key", "__turning")


def _members(moved: DataFrame) -> DataFrame:
    return moved.groupBy("conv_id").agg(F.count("*").alias("members"))


def _size(moved: DataFrame) -> tuple[int, int]:
    row = moved.agg(F.count("*").alias("n"), F.sum(F.col("key.minor") + 31 * F.col("key.major")).alias("s")).first()
    return row["n"], row["s"] or 0


def problems(schemas: Schemas, tool: str = "tool", arguments: str = "arguments") -> Column:
    """What is wrong with the JSON ``arguments`` of a call, sorted: "tool", "json", or the names of fields that
    are missing, unknown or of another type; an empty array if nothing is. A null value counts as missing.
    """
    value = F.try_parse_json(F.coalesce(F.col(arguments), F.lit("")))
    fields = F.json_object_keys(F.col(arguments))
    out = F.array(F.lit("tool"))
    for name, schema in schemas.items():
        wrong = []
        for field, (kind, needed) in sorted(schema.items()):
            path = "$['" + field + "']"
            present = F.try_variant_get(value, path, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(value, path, "variant"))
            right = F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike(_KINDS.get(kind.lower(), f"^{kind.upper()}$"))
            bad = F.when(present, ~right).otherwise(F.lit(needed))
            wrong.append(F.when(bad, F.lit(field)))
        unknown = F.array_except(F.coalesce(fields, F.array().cast("array<string>")), F.array(*map(F.lit, schema)).cast("array<string>"))
        checked = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*wrong).cast("array<string>")), unknown)))
        found = F.when(value.isNull() | fields.isNull(), F.array(F.lit("json"))).otherwise(checked)
        out = F.when(F.col(tool) == name, found).otherwise(out)
    return out


#: Patterns of the variant types that a field of a kind may have, where more than its own name fits.
_KINDS = {"double": r"^(DOUBLE|FLOAT|BIGINT|DECIMAL\(.*)$", "array": "^ARRAY<", "object": "^OBJECT<"}


def canonical(arguments: str = "arguments") -> Column:
    """JSON with sorted keys and without white space; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(arguments))


def format_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: its order, its problems, and ``json``, the canonical record of call and result.

    ``calls`` has conv_id, call_id, position, tool, arguments (JSON text) and depends_on; ``results`` has
    conv_id, call_id, turn and content. Arguments that are not JSON are null in the record. Rows with null
    identifiers are formatted without link; other columns are dropped. Empty tables give an empty result.
    """
    ready = order(link(calls.select("conv_id", "call_id", "position", "tool", "arguments", "depends_on"), results))
    checked = ready.withColumns({"problems": problems(schemas), "__arguments": F.try_parse_json("arguments")})
    record = F.struct(
        F.col("__arguments").alias("arguments"), F.col("call_id").alias("id"), F.array_sort("depends_on").alias("needs"),
        F.col("result").alias("result"), F.col("tool").alias("tool"), (F.size("problems") == 0).alias("valid"),
    )
    return checked.select(
        "conv_id", "call_id", "position", "order_major", "order_minor", "cyclic", "n_results", "problems",
        (F.size("problems") == 0).alias("valid"), F.to_json(record, {"ignoreNullFields": "false"}).alias("json"),
    )
