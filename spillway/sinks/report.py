"""Reports: JSON, SARIF, a generic import format, a grouped listing, editor diagnostics (SNK-01 to SNK-08).

json_report(), sarif(), defectdojo() and pretty() are one row of text each, made by
aggregation, so they are for results of a report's size.  The functions named ..._lines give
the same documents at any size: a row for each line, of which no task holds more than its
share.  part is the order of the lines; write_lines() writes them as text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.functions.text import clamp, sev_rank
from spillway.operators.post import sorted_findings

FIELDS = ("detector", "type", "confidence", "severity", "source", "path", "line", "col", "redacted", "stage", "url", "verified", "rationale", "fingerprint", "context", "in_final_image", "instruction")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def security_severity(severity: Column) -> Column:
    return F.when(severity == "critical", "9.5").when(severity == "high", "8.0").when(severity == "medium", "5.5").when(severity == "low", "3.0").otherwise("0.0")


def dojo_severity(severity: Column) -> Column:
    return F.coalesce(F.when(sev_rank(severity) >= 0, F.initcap(severity)), F.lit("Info"))


def lsp_severity(severity: Column) -> Column:
    """1 error, 2 warning, 3 information."""
    return F.when(severity.isin("critical", "high"), 1).when(severity == "medium", 2).otherwise(3)


def _ordered(findings: DataFrame, *columns: Column) -> DataFrame:
    w = Window.orderBy(F.desc(sev_rank(F.col("severity"))), "path", "line", "col", "type", "fingerprint")
    return findings.withColumn("__ord", F.row_number().over(w)).select("__ord", *columns)


def _list(name: str, what: Column) -> Column:
    """Collected in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("__ord", what.alias("x")))), lambda s: s["x"]).alias(name)


def json_report(findings: DataFrame) -> DataFrame:
    """{findings, count, truncated}, sorted, nulls left out."""
    rows = findings.withColumn("confidence", clamp(F.col("confidence"))).withColumn("line", F.coalesce("line", F.lit(0))).withColumn("col", F.coalesce("col", F.lit(0)))
    rows = _ordered(rows, F.struct(*FIELDS).alias("f"))
    body = rows.agg(_list("findings", F.col("f")), F.count("*").alias("count"), F.coalesce(F.bool_or(F.col("f.type") == "results_truncated"), F.lit(False)).alias("truncated"))
    return body.select(F.to_json(F.struct("findings", "count", "truncated")).alias("report"))


FIRST, LAST = -1, (1 << 63) - 1  # parts of a document's head and end


def numbered(findings: DataFrame) -> DataFrame:
    """With a number that makes the order of a report total.  The ..._lines functions read their findings more than once, so write these rows first."""
    return findings if "__id" in findings.columns else findings.withColumn("__id", F.monotonically_increasing_id())


def _keyed(findings: DataFrame) -> DataFrame:
    order = F.struct((-sev_rank(F.col("severity"))).alias("r"), "path", "line", "col", "type", "fingerprint", "__id")
    return numbered(findings).withColumn("__key", order)


def _lines(rows: DataFrame, text: Column, head: DataFrame, end: DataFrame, separator: str = ",") -> DataFrame:
    """part, text: the one row of head, the rows in order of __key with what stands between them, the one row of end."""
    first = rows.agg(F.min("__key").alias("__first"))
    body = rows.crossJoin(F.broadcast(first)).select("__key", F.concat(F.when(F.col("__key") == F.col("__first"), "").otherwise(separator), text).alias("text"))
    body = body.orderBy("__key").select(F.monotonically_increasing_id().alias("part"), "text")
    at = lambda df, k: df.select(F.lit(k).cast("long").alias("part"), "text")
    return at(head, FIRST).unionByName(body).unionByName(at(end, LAST))


def _row(findings: DataFrame, text: str) -> DataFrame:
    return findings.sparkSession.createDataFrame([(text,)], "text string")


def json_lines(findings: DataFrame) -> DataFrame:
    """json_report() in lines: a finding each, between a head and an end that holds the count."""
    rows = _keyed(findings).withColumn("confidence", clamp(F.col("confidence"))).withColumn("line", F.coalesce("line", F.lit(0))).withColumn("col", F.coalesce("col", F.lit(0)))
    total = rows.agg(F.count("*").alias("count"), F.coalesce(F.bool_or(F.col("type") == "results_truncated"), F.lit(False)).alias("truncated"))
    end = total.select(F.concat(F.lit("],"), F.expr("substring(to_json(struct(count, truncated)), 2)")).alias("text"))
    return _lines(rows, F.to_json(F.struct(*FIELDS)), _row(findings, '{"findings":['), end)


def _sarif_result() -> Column:
    place = F.struct(F.struct(F.struct(F.coalesce("path", F.lit("")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("col", F.lit(1)), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("type").alias("ruleId"), "ruleIndex", sarif_level(F.col("severity")).alias("level"), F.struct(F.concat(F.col("type"), F.lit(" detected: "), F.coalesce("redacted", F.lit(""))).alias("text")).alias("message"),
        F.array(place).alias("locations"), F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("fingerprint").alias("secret/v1"))).alias("partialFingerprints"),
        F.struct(F.col("confidence"), F.col("verified")).alias("properties"),
    )


def _sarif_rule() -> Column:
    return F.struct(F.col("type").alias("id"), F.struct(F.col("type").alias("text")).alias("shortDescription"), F.struct(security_severity(F.col("worst")).alias("security-severity"), F.array(F.lit("security"), F.lit("secret")).alias("tags")).alias("properties"))


def sarif_lines(findings: DataFrame, tool: str = "spillway", version: str = "1.0") -> DataFrame:
    """sarif() in lines: a result each, after a head with the rules, which are as many as there are types."""
    rows = _keyed(findings.select("type", "severity", "path", "line", "col", "redacted", "fingerprint", "confidence", "verified", *(c for c in ("__id",) if c in findings.columns)))
    first = rows.groupBy("type").agg(F.min("__key").alias("__first"), F.min_by("severity", "__key").alias("worst"))
    rules = first.withColumn("ruleIndex", F.row_number().over(Window.orderBy("__first")) - 1)
    listed = rules.select(F.col("ruleIndex").alias("__ord"), _sarif_rule().alias("r")).agg(_list("rules", F.col("r")))
    head = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules")), F.lit('},"results":['),
    )
    rows = rows.join(F.broadcast(rules.select("type", "ruleIndex")), "type")
    return _lines(rows, F.to_json(_sarif_result()), listed.select(head.alias("text")), _row(findings, "]}]}"))


def sarif(findings: DataFrame, tool: str = "spillway", version: str = "1.0") -> DataFrame:
    """SARIF 2.1.0: a rule for each type, numbered as it is first seen."""
    rows = _ordered(findings, "type", "severity", "path", "line", "col", "redacted", "fingerprint", "confidence", "verified")
    first = rows.groupBy("type").agg(F.min("__ord").alias("__first"), F.min_by("severity", "__ord").alias("worst"))
    rules = first.withColumn("ruleIndex", F.row_number().over(Window.orderBy("__first")) - 1)
    result = _sarif_result()
    results = rows.join(rules.select("type", "ruleIndex"), "type").select("__ord", result.alias("r")).agg(_list("results", F.col("r")))
    listed = rules.select(F.col("ruleIndex").alias("__ord"), _sarif_rule().alias("r")).agg(_list("rules", F.col("r")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return listed.crossJoin(results).select(F.to_json(doc).alias("report"))


def _dojo() -> Column:
    return F.struct(
        F.concat(F.lit("Exposed "), F.col("type")).alias("title"), dojo_severity(F.col("severity")).alias("severity"),
        F.concat(F.lit("A credential of type "), F.col("type"), F.lit(" was found: "), F.coalesce("redacted", F.lit(""))).alias("description"), F.lit(798).alias("cwe"), F.col("path").alias("file_path"), F.col("line"),
        F.coalesce("verified", F.lit(False)).alias("verified"), F.lit(True).alias("active"), F.lit(True).alias("static_finding"), F.col("fingerprint").alias("unique_id_from_tool"),
    )


def defectdojo(findings: DataFrame) -> DataFrame:
    """The generic findings import, weakness 798."""
    return _ordered(findings, _dojo().alias("f")).agg(_list("findings", F.col("f"))).select(F.to_json(F.struct("findings")).alias("report"))


def defectdojo_lines(findings: DataFrame) -> DataFrame:
    """defectdojo() in lines: a finding each."""
    return _lines(_keyed(findings), F.to_json(_dojo()), _row(findings, '{"findings":['), _row(findings, "]}"))


def _listed(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines in order of __worst, path and __first, and the row of counts at the foot."""
    rank = sev_rank(F.col("severity"))
    per_file = Window.partitionBy("path")
    rows = findings.withColumn("__worst", F.max(rank).over(per_file)).withColumn("__n", F.count("*").over(per_file))
    line = F.format_string("  %d:%d  %-8s %s  %s", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), "severity", "type", F.coalesce("redacted", F.lit("")))
    first = F.row_number().over(per_file.orderBy(F.desc(rank), "line", "col", "type"))
    text = F.when(first == 1, F.concat(F.coalesce("path", F.lit("")), F.lit(" ("), F.col("__n").cast("string"), F.lit(")\n"), line)).otherwise(line)
    shown = rows.withColumn("text", text).withColumn("__first", first)
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    foot = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-sev_rank(F.col("severity"))).alias("o"), "severity", "n"))), lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["severity"])), ", ").alias("foot"))
    return shown, foot.select(F.coalesce(F.nullif("foot", F.lit("")), F.lit("no findings")).alias("foot"))


def pretty(findings: DataFrame) -> DataFrame:
    """A line for each finding below a line for its file, the worst file first, then counts by severity."""
    shown, foot = _listed(findings)
    order = Window.orderBy(F.desc("__worst"), "path", "__first")
    body = shown.withColumn("__ord", F.row_number().over(order)).agg(_list("lines", F.col("text")))
    return body.crossJoin(foot).select(F.concat(F.array_join("lines", "\n"), F.lit("\n\n"), F.col("foot"), F.lit("\n")).alias("report"))


def pretty_lines(findings: DataFrame) -> DataFrame:
    """pretty() in lines; a file's first one has its head above it, and the foot is the last."""
    shown, foot = _listed(findings)
    body = shown.orderBy(F.desc("__worst"), "path", "__first").select(F.monotonically_increasing_id().alias("part"), "text")
    return body.unionByName(foot.select(F.lit(LAST).cast("long").alias("part"), F.concat(F.lit("\n"), "foot").alias("text")))


def diagnostics(findings: DataFrame, column: Column, length: Column) -> DataFrame:
    """Editor diagnostics: column and length in UTF-16 units, line from 0."""
    at = lambda c: F.struct((F.col("line") - 1).alias("line"), c.alias("character"))
    return findings.select("path", F.struct(at(column).alias("start"), at(column + length).alias("end")).alias("range"), lsp_severity(F.col("severity")).alias("severity"), F.lit("spillway").alias("source"), F.concat(F.col("type"), F.lit(": "), F.col("redacted")).alias("message"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that are the document when joined in order of their names."""
    lines.select("text").write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """The table of findings, for results of any size."""
    findings.write.mode("overwrite").parquet(path)


__all__ = [
    "defectdojo", "defectdojo_lines", "diagnostics", "json_lines", "json_report", "numbered", "pretty", "pretty_lines", "sarif", "sarif_lines", "sorted_findings", "write_findings", "write_lines",
]
