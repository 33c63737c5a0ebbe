"""Conversations and chat request bodies."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.patterns import DetectorConfig, might_match
from velum.functions.rewrite import _leaf, _pairs
from velum.functions.text import already_masked, is_blank
from velum.operators.detect import detect_entities
from velum.operators.mask import hide_placeholders, replace_outside_placeholders
from velum.operators.payloads import structured_findings
from velum.operators.tokens import assign_tokens, attach_entries, entry_lists, required, tokens_for
from velum.session import spread, stage

# Block types without readable text, refused as a whole.
REFUSED_BLOCKS = ("image", "document")


# ---- request bodies ----------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leaves(tree: pd.Series) -> pd.Series:
    """String leaves of a tool input, any depth; keys are names, not data."""
    out = []
    for text in tree:
        if text is None:
            out.append(None)
            continue
        found: list[str] = []
        todo = [json.loads(text)]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                found.append(node)
            elif isinstance(node, dict):
                todo.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                todo.extend(reversed(node))
        out.append(found)
    return pd.Series(out, dtype=object)


def chat_blocks(bodies: DataFrame, keys: Sequence[str], body: str = "body", system: bool = False) -> DataFrame:
    """One row per block: (keys, msg, block, role, type, route, texts).

    ``route`` is mask, refuse or pass; a message whose content is a string is one
    text block; with ``system`` the body's system text is message -1. Bodies that cannot
    be read have no rows here (see ``unreadable``).
    """
    said = F.transform(
        F.try_variant_get("_t", "$.messages", "array<variant>"),
        lambda m: F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"), F.try_variant_get(m, "$.content", "variant").alias("_c")
        ),
    )
    if system:
        own = F.struct(F.lit("system").alias("role"), F.try_variant_get("_t", "$.system", "variant").alias("_c"))
        said = F.concat(F.array(own), said)
    # each step is its own projection, so the parsed tree is not rebuilt per field
    messages = (
        bodies.select(*keys, F.try_parse_json(F.col(body)).alias("_t"))
        .select(*keys, F.posexplode_outer(said).alias("msg", "_m"))
        .where("msg IS NOT NULL")
        .select(*keys, (F.col("msg") - int(system)).alias("msg"), "_m.role", "_m._c")
        .withColumn("_kind", F.schema_of_variant("_c"))
    )
    as_text = F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.when(F.col("_kind") == "STRING", F.try_variant_get("_c", "$", "string")).alias("text"),
            F.lit(None).cast("string").alias("input"),
            F.lit(None).cast("string").alias("content"),
            F.lit(None).cast("array<string>").alias("parts"),
        )
    )

    def part(v: Column) -> Column:
        return F.when(
            F.try_variant_get(v, "$.type", "string") == "text", F.try_variant_get(v, "$.text", "string")
        )

    def block(v: Column) -> Column:
        content = F.try_variant_get(v, "$.content", "variant")
        return F.struct(
            F.try_variant_get(v, "$.type", "string").alias("type"),
            F.try_variant_get(v, "$.text", "string").alias("text"),
            F.to_json(F.try_variant_get(v, "$.input", "variant")).alias("input"),
            F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).alias("content"),
            F.transform(
                F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>")),
                part,
            ).alias("parts"),
        )

    listed = F.transform(F.try_variant_get("_c", "$", "array<variant>"), block)
    blocks = (
        messages.withColumn("_b", F.when(F.col("_kind") == "STRING", as_text).otherwise(listed))
        .select(*keys, "msg", "role", F.posexplode_outer("_b").alias("block", "b"))
        .where("block IS NOT NULL")
        .select(*keys, F.col("msg").cast("bigint").alias("msg"), F.col("block").cast("bigint").alias("block"), "role", "b.*")
    )
    none = F.array().cast("array<string>")
    texts = (
        F.when(F.col("type") == "text", F.array("text"))
        .when(F.col("type") == "tool_use", _leaves(F.when(F.col("type") == "tool_use", F.col("input"))))
        .when(
            F.col("type") == "tool_result",
            F.coalesce(F.when(F.col("content").isNotNull(), F.array("content")), F.col("parts"), none),
        )
        .otherwise(none)
    )
    route = (
        F.when(F.col("type").isin("text", "tool_use", "tool_result"), "mask")
        .when(F.col("type").isin(*REFUSED_BLOCKS), "refuse")
        .otherwise("pass")
    )
    return blocks.select(
        *keys, "msg", "block", "role", "type", route.alias("route"),
        F.filter(texts, lambda t: t.isNotNull()).alias("texts"),
    )


def body_fault(body: Column) -> Column:
    """Why a body cannot be masked; NULL for one that can, and for a NULL body."""
    tree = F.try_parse_json(body)
    messages = F.try_variant_get(tree, "$.messages", "array<variant>")
    odd = F.exists(messages, lambda m: ~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    return F.when(
        body.isNotNull(),
        F.when(tree.isNull(), "no json").when(messages.isNull(), "no list of messages").when(odd, "message is no object"),
    )


def unreadable(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that cannot be masked, with the ``reason``; ``mask_bodies`` refuses them."""
    return bodies.withColumn("reason", body_fault(F.col(body))).where("reason IS NOT NULL")


def _rewrite_content(content, pairs):
    """A message's content: one text or a list of blocks."""
    if isinstance(content, str):
        return _leaf(content, pairs, 0)
    if isinstance(content, list):
        for block in content:
            if isinstance(block, dict):
                _rewrite_block(block, pairs)
    return content


def _rewrite_block(block, pairs) -> None:
    kind = block.get("type")
    if kind == "text" and isinstance(block.get("text"), str):
        block["text"] = _leaf(block["text"], pairs, 0)
    elif kind == "tool_use":
        block["input"] = _rewrite_leaves(block.get("input"), pairs)
    elif kind == "tool_result":
        content = block.get("content")
        if isinstance(content, str):
            block["content"] = _leaf(content, pairs, 0)
        elif isinstance(content, list):
            for part in content:
                if isinstance(part, dict) and part.get("type") == "text" and isinstance(part.get("text"), str):
                    part["text"] = _leaf(part["text"], pairs, 0)


def _rewrite_leaves(node, pairs):
    if isinstance(node, str):
        return _leaf(node, pairs, 0)
    if isinstance(node, list):
        return [_rewrite_leaves(item, pairs) for item in node]
    if isinstance(node, dict):
        return {key: _rewrite_leaves(item, pairs) for key, item in node.items()}
    return node


@F.pandas_udf(T.StringType())
def _rewrite_body(body: pd.Series, entries: pd.Series, system: pd.Series) -> pd.Series:
    out = []
    for text, row, own in zip(body, entries, system):
        if text is None or row is None or len(row) == 0:
            out.append(text)
            continue
        tree, pairs = json.loads(text), _pairs(row)
        for message in tree["messages"]:
            if "content" in message:
                message["content"] = _rewrite_content(message["content"], pairs)
        if own and "system" in tree:
            tree["system"] = _rewrite_content(tree["system"], pairs)
        out.append(json.dumps(tree, ensure_ascii=False))
    return pd.Series(out, dtype=object)


class MaskedBodies(NamedTuple):
    rows: DataFrame
    refused: DataFrame
    token_map: DataFrame
    findings: DataFrame


def mask_bodies(
    bodies: DataFrame,
    key: str = "body_id",
    scope: str = "scope",
    body: str = "body",
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
    kb: DataFrame | None = None,
    mask_system: bool = True,
) -> MaskedBodies:
    """Mask the readable blocks of chat request bodies.

    Bodies that cannot be read, or that hold a refused block, leave as (key, reason)
    without their text. With ``kb`` texts that are payloads (JSON, CSV, tables, SQL ...) are read
    by field, as ``mask_payloads`` does; ``mask_system`` masks the body's system text too.
    """
    base = bodies.select(required(scope).alias("scope"), required(key).alias("doc_id"), F.col(body).alias("body"))
    blocks = stage(chat_blocks(spread(base), ["scope", "doc_id"], system=mask_system), "blocks")
    refused = (
        blocks.where("route = 'refuse'")
        .select("scope", "doc_id", F.concat(F.lit("unsupported block: "), F.col("type")).alias("reason"))
        .unionByName(unreadable(base).drop("body"))
        .groupBy("scope", "doc_id")
        .agg(F.min("reason").alias("reason"))
    )
    texts = blocks.where("route = 'mask'").select(
        "scope", "doc_id", "msg", "block", F.posexplode("texts").alias("part", "text")
    ).where(~is_blank(F.col("text")) & ~already_masked(F.col("text")))
    place = ["scope", "doc_id", "msg", "block", "part"]
    found = detect_entities(texts, place, hide_placeholders(F.col("text")), config)
    if kb is not None:
        found = found.unionByName(structured_findings(texts, place, kb), allowMissingColumns=True)
    found = stage(
        found.withColumn("ord", F.shiftleft("msg", 42) + F.shiftleft("block", 21) + F.col("part")), "findings"
    )
    new = assign_tokens(found, existing, high_water)
    known = new if existing is None else new.unionByName(existing.select(*new.columns))
    at = ["_scope", "doc_id"]
    entries = entry_lists(tokens_for(found, known), ["scope", "doc_id"], "value", "token").withColumnRenamed("scope", "_scope")
    rows = (
        bodies.withColumn("_scope", F.col(scope)).withColumnsRenamed({key: "doc_id", body: "body"})
        .join(refused.select(F.col("scope").alias("_scope"), "doc_id"), at, "left_anti")
        .join(entries, at, "left")
        .withColumn("body", _rewrite_body(F.col("body"), F.col("entries"), F.lit(mask_system)))
        .withColumnsRenamed({"doc_id": key, "body": body})
        .select(*bodies.columns)
    )
    return MaskedBodies(rows, refused.select(F.col("doc_id").alias(key), "reason"), new, found)


# ---- one row per turn ----------------------------------------------------------


class MaskedTurns(NamedTuple):
    rows: DataFrame
    token_map: DataFrame
    findings: DataFrame


def mask_conversations(
    turns: DataFrame,
    scope: str = "scope",
    skip_roles: Sequence[str] = (),
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
    reuse_texts: bool = True,
) -> MaskedTurns:
    """Mask (conv_id, turn, role, text) rows.

    With ``reuse_texts`` each distinct text of a scope is detected once: the whole
    history comes back every turn, so most rows repeat. Blank texts, texts that are
    masked already and ``skip_roles`` stay as they are.
    """
    eligible = (
        ~is_blank(F.col("text"))
        & ~already_masked(F.col("text"))
        & ~F.coalesce(F.col("role").isin(*skip_roles), F.lit(False))
    )
    flagged = turns.withColumn("_hash", F.when(eligible, F.sha2("text", 256)))
    texts = flagged.where("_hash IS NOT NULL").select(
        required(scope).alias("scope"), "_hash", "text", F.struct("conv_id", "turn").alias("_at")
    )
    if reuse_texts:
        texts = texts.groupBy("scope", "_hash").agg(F.any_value("text").alias("text"), F.min("_at").alias("_at"))
    found = detect_entities(texts, ["scope", "_hash", "_at"], hide_placeholders(F.col("text")), config)
    found = stage(
        found.select(
            "scope", "_hash", F.col("_at.conv_id").alias("doc_id"), F.col("_at.turn").alias("ord"),
            "start", "prio", "value", "label", "source", "score",
        ),
        "findings",
    )
    new = assign_tokens(found, existing, high_water)
    known = new if existing is None else new.unionByName(existing.select(*new.columns))
    lists = entry_lists(tokens_for(found, known), ["scope", "_hash"], "value", "token")
    lists = lists.withColumnRenamed("scope", scope)
    touched = F.col("_hash").isNotNull() & might_match(hide_placeholders(F.col("text")), config.patterns)
    rows = (
        attach_entries(flagged, lists, [scope, "_hash"], touched)
        .withColumn("text", replace_outside_placeholders(F.col("text"), F.col("entries")))
        .select(*turns.columns)
    )
    return MaskedTurns(rows, new, found.drop("_hash"))


def payload_stats(turns: DataFrame, scope: str = "scope") -> DataFrame:
    """Blocks handled and how many a distinct-text cache would answer, per scope."""
    per_text = (
        turns.where(~is_blank(F.col("text")))
        .groupBy(F.col(scope).alias("scope"), F.sha2("text", 256).alias("_h"))
        .agg(F.count("*").alias("_n"), F.any_value(already_masked(F.col("text"))).alias("_m"))
    )
    return per_text.groupBy("scope").agg(
        F.sum("_n").alias("blocks"),
        F.coalesce(F.sum(F.when(~F.col("_m"), F.col("_n") - 1)), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.sum(F.when(F.col("_m"), F.col("_n"))), F.lit(0)).alias("already_masked"),
    )


def last_assistant_turn(turns: DataFrame) -> DataFrame:
    """Text of the latest assistant turn that has one, per conversation."""
    return (
        turns.where("role = 'assistant'")
        .where(~is_blank(F.col("text")))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    )
