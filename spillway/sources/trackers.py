"""Items from issue trackers and wikis (SRC-21, SRC-22, SCL-19, SCL-20, AGG-09, AGG-10, JN-14)."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spillway.functions.text import decode_xml

ATTRIBUTES = ("href", "url", "text", "title", "alt", "code", "language", "shortName", "id")
MOST_VERSIONS = 5000


def document_text(x: Any) -> str:
    """Text of a rich-text document: texts, values and names, attributes that may hold secrets, marks, contents, a line each."""
    out: list[str] = []
    stack = [x]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            for k in ("text", "value", "name"):
                if isinstance(node.get(k), str) and node[k]:
                    out.append(node[k])
            attrs = node.get("attrs")
            if isinstance(attrs, dict):
                out.extend(attrs[k] for k in ATTRIBUTES if isinstance(attrs.get(k), str) and attrs[k])
            stack.extend(reversed([node[k] for k in ("marks", "content") if isinstance(node.get(k), list)]))
    return "\n".join(out)


@F.arrow_udf(StringType())
def rich_text(s: pa.Array) -> pa.Array:
    """Text of a JSON document, or the string itself where it isn't one."""
    out = []
    for x in s.to_pylist():
        try:
            doc = None if x is None else json.loads(x)
        except (ValueError, RecursionError):
            doc = x
        out.append(None if x is None else document_text(doc if isinstance(doc, (dict, list)) else x))
    return pa.array(out, pa.string())


def _item(rows: DataFrame, source: str) -> DataFrame:
    return rows.where("text IS NOT NULL AND trim(text) != ''").select(F.xxhash64("path", "text").alias("item_id"), "text", F.lit(source).alias("source"), "path", "meta")


_ISSUE = "array<struct<id:string,body:string>>"
_HISTORY = "array<struct<created:string,author:string,items:array<struct<field:string,fromString:string,toString:string>>>>"


def jira_items(issues: DataFrame) -> DataFrame:
    """Items of issues' current fields, of each comment, and of both sides of each change.

    issues: key, url, fields (JSON map), comments and histories (JSON arrays), nulls allowed.
    """
    meta = lambda *kv: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in kv)), lambda e: e["v"].isNotNull()))
    url = ("url", F.col("url"))
    fields = issues.select("key", "url", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "raw"))
    current = fields.groupBy("key", "url").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit(": "), rich_text(F.col("raw"))))), "\n").alias("text")).select("text", F.col("key").alias("path"), meta(url).alias("meta"))
    comments = issues.select("key", "url", F.explode(F.from_json("comments", _ISSUE)).alias("c")).select(rich_text(F.col("c.body")).alias("text"), F.concat("key", F.lit("#comment-"), "c.id").alias("path"), meta(url).alias("meta"))
    changes = issues.select("key", "url", F.posexplode(F.from_json("histories", _HISTORY)).alias("k", "h")).select("key", "url", "k", "h.created", "h.author", F.explode("h.items").alias("i"))
    sides = changes.select("key", "url", "k", "created", "author", F.explode(F.array("i.fromString", "i.toString")).alias("text"))
    old = sides.select("text", F.concat("key", F.lit("#history-"), F.col("k").cast("string")).alias("path"), meta(url, ("author", F.col("author")), ("updated", F.col("created"))).alias("meta"))
    return _item(current.unionByName(comments).unionByName(old), "jira")


def needs_fallback(asked: DataFrame, got: DataFrame) -> DataFrame:
    """Keys to be asked for one by one: those missing from a bulk answer; all, if more than half are missing."""
    missing = asked.select("key").join(got.select("key").distinct(), "key", "left_anti")
    share = asked.agg(F.count("*").alias("n")).crossJoin(missing.agg(F.count("*").alias("m"))).select((F.col("m") * 2 > F.col("n")).alias("all"))
    return asked.select("key").crossJoin(F.broadcast(share)).join(missing.withColumn("gone", F.lit(True)), "key", "left").where("all OR gone").select("key")


def page_versions(pages: DataFrame, most: int = MOST_VERSIONS) -> DataFrame:
    """Versions of pages with each body once, at its smallest version, of the `most` latest versions of a page.

    pages: page_id, version, title, space, storage.  A null body counts as an empty one.
    """
    latest = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("version")))
    rows = pages.withColumn("storage", F.coalesce("storage", F.lit(""))).withColumn("__k", latest).where(F.col("__k") <= most)
    # A body is compared whole; its hash alone takes part in the shuffle's key.
    return rows.groupBy("page_id", F.xxhash64("storage").alias("__h"), "storage").agg(F.min(F.struct("version", "title", "space")).alias("v")).select("page_id", "v.version", "v.title", "v.space", "storage")


def confluence_items(pages: DataFrame, most: int = MOST_VERSIONS) -> DataFrame:
    rows = page_versions(pages, most)
    path = F.concat_ws("/", "space", F.concat("title", F.lit(" ("), F.col("page_id").cast("string"), F.lit(")")))
    meta = F.create_map(F.lit("version"), F.col("version").cast("string"), F.lit("page_id"), F.col("page_id").cast("string"))
    return _item(rows.select(decode_xml(F.col("storage")).alias("text"), path.alias("path"), meta.alias("meta")), "confluence")


def deployment(infos: DataFrame) -> DataFrame:
    """base, kind (cloud, server or datacenter) and version of sites.  infos: base, info (the JSON that a server tells of itself).

    Where a proxy has taken the kind away, the host's name tells a cloud.
    """
    kind, at = F.lower(F.get_json_object("info", "$.deploymentType")), F.coalesce(F.get_json_object("info", "$.baseUrl"), F.lit(""))
    cloud = lambda url: F.lower(url).rlike(r"^https?://[^/]*\.(?:atlassian\.net|jira\.com)(?:[:/]|$)")
    guess = F.when(cloud(at) | cloud(F.col("base")), "cloud").otherwise("server")
    return infos.select("base", F.when(kind.isin("cloud", "server", "datacenter"), kind).otherwise(guess).alias("kind"), F.get_json_object("info", "$.version").alias("version"))
