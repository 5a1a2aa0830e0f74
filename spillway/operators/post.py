"""What happens to findings after a scan: filters, suppression, comparison, counts, gate (FLT-08, FLT-09, JN-05 to JN-09, AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.functions.text import legacy_key, sev_rank
from spillway.schema import RANK


def key(df: DataFrame) -> Column:
    """Fingerprint, or a key of place and mask where there is none."""
    return F.coalesce(df["fingerprint"], legacy_key(df["type"], df["path"], df["line"], df["redacted"]))


def filtered(findings: DataFrame, min_confidence: float = 0.0, min_severity: str | None = None, disabled=()) -> DataFrame:
    """Findings of enough confidence and severity, and of no disabled type.  Markers of cut results and failed items always stay."""
    keep = (F.col("confidence") >= min_confidence) & ~F.col("type").isin(*disabled) if disabled else F.col("confidence") >= min_confidence
    if min_severity:
        keep = keep & (sev_rank(F.col("severity")) >= RANK[min_severity])
    return findings.where(keep | F.col("type").isin("results_truncated", "scan_failed"))


def verified_only(findings: DataFrame, has_verifier: Column) -> DataFrame:
    """Live ones; those whose test was inconclusive; and of high severity those that nothing can test."""
    open_ = F.col("verified").isNull() & (has_verifier | (sev_rank(F.col("severity")) >= RANK["high"]))
    return findings.where(F.coalesce(F.col("verified"), F.lit(False)) | open_)


def baseline(findings: DataFrame) -> DataFrame:
    """The keys to accept from now on."""
    return findings.select(key(findings).alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    baseline(findings).coalesce(1).write.mode("overwrite").json(path)


def suppress(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose key isn't accepted."""
    known = accepted.select(F.col("fingerprint").alias("__known")).where("__known IS NOT NULL").distinct()
    return findings.join(known, key(findings) == F.col("__known"), "left_anti")


def parse_ignore(lines: DataFrame) -> DataFrame:
    """exact, file and line of the entries of an ignore file; `value` holds its lines.

    Blank lines and comments are left out.  A leading commit hash isn't part of the file.
    """
    entry = F.trim("value")
    parts = F.split(entry, ":")
    n = F.size(parts)
    middle = F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0)))
    commit = (F.size(middle) >= 2) & F.get(middle, 0).rlike(r"^[0-9a-fA-F]{7,40}\z")
    file = F.array_join(F.when(commit, F.slice(middle, F.lit(2), F.size(middle))).otherwise(middle), ":")
    line = F.when((n >= 3) & F.element_at(parts, -1).rlike(r"^[+-]?[0-9]{1,9}\z"), F.element_at(parts, -1).cast("int"))
    return lines.select(entry.alias("exact"), F.when(line.isNotNull(), F.translate(file, "\\", "/")).alias("file"), line.alias("line")).where("exact != '' AND NOT startswith(exact, '#')")


def ignore(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings that no entry names: neither as path:type:line, nor by line and a path that is the other's tail."""
    exact = entries.select(F.col("exact").alias("__exact")).distinct()
    kept = findings.join(exact, F.concat_ws(":", "path", "type", F.col("line").cast("string")) == F.col("__exact"), "left_anti")
    # Equal, or a whole tail either way: both are equality of line and of one path with a tail of the other, so
    # both are hash joins, and an entry's or a finding's tails are as many as its path has segments.
    relaxed = entries.where("line IS NOT NULL").select(F.col("line").alias("__line"), F.col("file").alias("__file")).distinct()
    path = F.translate(F.coalesce("path", F.lit("")), "\\", "/")
    named = kept.where("line IS NOT NULL").select(F.col("line").alias("__l"), path.alias("__p")).distinct()
    by_finding = named.withColumn("__t", F.explode(tails(F.col("__p")))).join(relaxed, (F.col("__l") == F.col("__line")) & (F.col("__t") == F.col("__file"))).select("__l", "__p")
    by_entry = relaxed.withColumn("__t", F.explode(tails(F.col("__file")))).join(named, (F.col("__l") == F.col("__line")) & (F.col("__t") == F.col("__p"))).select("__l", "__p")
    gone = by_finding.unionByName(by_entry).distinct()
    return kept.join(gone, (F.col("line") == F.col("__l")) & (path == F.col("__p")), "left_anti")


def tails(path: Column) -> Column:
    """A path and all that follows one of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def restore_live(kept: DataFrame, all_: DataFrame) -> DataFrame:
    """Kept findings, and live ones that a suppression took."""
    live = all_.where("verified")
    known = kept.select(key(kept).alias("__known")).distinct()
    return kept.unionByName(live.join(known, key(live) == F.col("__known"), "left_anti"))


def escalate(findings: DataFrame) -> DataFrame:
    """Live findings become critical."""
    return findings.withColumn("severity", F.when(F.col("verified"), "critical").otherwise(F.col("severity")))


def gate(findings: DataFrame, fail_on: str | None = "high", live_only: bool = False) -> int:
    """1 if a finding reaches the severity, else 0."""
    if not fail_on:
        return 0
    rows = findings.where("verified") if live_only else findings
    return int(bool(rows.where(sev_rank(F.col("severity")) >= RANK[fail_on]).limit(1).count()))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("verified")).alias("live"), F.count_if(~F.col("verified")).alias("rejected"))


def by_file(findings: DataFrame) -> DataFrame:
    """Files, the worst first."""
    worst = F.max(sev_rank(F.col("severity")))
    return findings.groupBy("path").agg(worst.alias("worst"), F.count("*").alias("n")).orderBy(F.desc("worst"), "path")


def by_repository(items: DataFrame, findings: DataFrame, repository: Column) -> DataFrame:
    """repository, scanned (items), with_findings, failed and findings; a repository of an item is told by the column."""
    of = findings.groupBy("item_id").agg(F.count_if(~F.col("type").isin("scan_failed", "results_truncated")).alias("n"), F.count_if(F.col("type") == "scan_failed").alias("bad"))
    rows = items.select("item_id", repository.alias("repository")).join(of, "item_id", "left")
    return rows.groupBy("repository").agg(F.count("*").alias("scanned"), F.count_if(F.col("n") > 0).alias("with_findings"), F.count_if(F.col("bad") > 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def live_summary(findings: DataFrame) -> DataFrame:
    """One row: live, dead and untested findings, and the type of the worst live one."""
    top = F.max_by("type", F.when(F.col("verified"), F.struct(sev_rank(F.col("severity")), F.col("confidence"), F.col("type"))))
    return findings.agg(F.count_if(F.col("verified")).alias("live"), F.count_if(~F.col("verified")).alias("dead"), F.count_if(F.col("verified").isNull()).alias("untested"), top.alias("top_live"))


def truncated(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.bool_or(F.col("type") == "results_truncated"), F.lit(False)).alias("truncated"))


def compare(raw: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a second scan lacks of a first: one row of totals, and the types of what is gone, the most frequent first; both from one count by type."""
    known = kept.select(key(kept).alias("__known")).where("__known IS NOT NULL").distinct()
    gone = raw.join(known, key(raw) == F.col("__known"), "left").select("type", F.col("__known").isNull().alias("gone"))
    by = gone.groupBy("type").agg(F.count("*").alias("raw"), F.count_if("gone").alias("n"))
    total = by.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("n"), F.lit(0)).alias("suppressed"))
    share = F.when(F.col("raw") > 0, F.round(100 * F.col("suppressed") / F.col("raw"), 1)).otherwise(0.0)
    return total.select("raw", (F.col("raw") - F.col("suppressed")).alias("kept"), "suppressed", share.alias("percent")), by.where("n > 0").select("type", "n").orderBy(F.desc("n"), "type")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Worst first, then by path and place."""
    return findings.orderBy(F.desc(sev_rank(F.col("severity"))), "path", "line", "col", "type", "fingerprint")


def response(findings: DataFrame, most: int = 5000) -> DataFrame:
    """The worst `most` - 1 findings and a row that says so, if there are more than `most`."""
    rows = sorted_findings(findings)
    n = findings.limit(most + 1).count()
    if n <= most:
        return rows
    note = rows.limit(1).select(*(F.lit({"detector": "scan", "type": "results_truncated", "severity": "info", "stage": "intake"}.get(c)).cast(t).alias(c) for c, t in rows.dtypes))
    return rows.limit(most - 1).unionByName(note)


def baseline_from_list(spark: SparkSession, fingerprints) -> DataFrame:
    return spark.createDataFrame([(f,) for f in fingerprints], "fingerprint string")
