"""Writers of reports: CSV, JSON, SARIF and CycloneDX.

Tables are written by Spark in parts; documents are built from findings, whose
number a report bounds, and are byte for byte the same for the same rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.scan import package_url

LEVELS = {"critical": "error", "warning": "warning", "info": "note"}


def write_csv(df: DataFrame, path: str, *order) -> None:
    """Headed CSV, in order if one is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_json(findings: DataFrame, envelope: dict | None = None) -> str:
    """Findings in order; what differs from run to run stands apart in `envelope`."""
    rows = [{"severity": r.severity, "rule": r.rule, "subject": r.subject, "evidence": json.loads(r.evidence)} for r in rules.ordered(findings).collect()]
    return json.dumps({"findings": rows, "envelope": envelope or {}}, sort_keys=True, indent=1, ensure_ascii=False)


def digest(findings: DataFrame) -> list[dict]:
    """Findings with lists replaced by their counts."""
    out = []
    for r in rules.ordered(findings).collect():
        told = json.loads(r.evidence)
        out.append({"severity": r.severity, "rule": r.rule, "subject": r.subject} | {f"{k}_count" if isinstance(v, list) else k: len(v) if isinstance(v, list) else v for k, v in told.items()})
    return out


def fingerprint(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def fingerprints(findings: DataFrame) -> DataFrame:
    """findings with the hash that names each."""
    return findings.withColumn("fingerprint", F.sha2(F.concat_ws("\u0000", "rule", "subject"), 256))


def sarif(findings: DataFrame, tree: DataFrame | None = None) -> dict:
    """A SARIF 2.1.0 log with one result a finding; with a tree, only of subjects in it."""
    if tree is not None:
        findings = findings.join(tree, F.col("subject") == F.col("path"), "left_semi")
    rows = rules.ordered(fingerprints(findings)).collect()
    results = [
        {
            "ruleId": r.rule,
            "level": LEVELS[r.severity],
            "message": {"text": f"{r.rule}: {r.subject}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.subject}}}],
            "partialFingerprints": {"primary/v1": r.fingerprint},
        }
        for r in rows
    ]
    used = sorted({r.rule for r in rows})
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "sedimenta", "rules": [{"id": x} for x in used]}}, "results": results}]}


def sbom(packages: DataFrame, commit: str) -> dict:
    """A CycloneDX 1.6 document of packages (ecosystem, name, version), each once; its serial follows from what it lists."""
    urls = packages.select("name", "version", package_url(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl")).distinct().orderBy("purl").collect()
    serial = uuid.uuid5(uuid.NAMESPACE_URL, "\0".join([commit, *(r.purl for r in urls)]))
    return {"bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": f"urn:uuid:{serial}", "version": 1, "components": [{"type": "library", "bom-ref": r.purl, "name": r.name, "version": r.version, "purl": r.purl} for r in urls]}


def portfolio(histories: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, commits, people, top_share, added: one row a history of (commits, changes)."""
    out = None
    for name, (commits, changes) in histories.items():
        each = commits.groupBy("author").agg(F.count("*").alias("n"))
        one = each.agg(F.sum("n").alias("commits"), F.count("*").alias("people"), (F.max("n") / F.sum("n")).alias("top_share")).join(changes.agg(F.sum("added").alias("added")), how="cross")
        one = one.select(F.lit(name).alias("name"), "commits", "people", "top_share", "added")
        out = one if out is None else out.unionByName(one)
    return out


def section(title: str, df: DataFrame, *order, k: int | None = 15) -> dict:
    """A section of a report: title, columns, the first k rows in an order and how many rows there are; all rows without k."""
    ordered = df.orderBy(*order) if order else df
    rows = [tuple(r) for r in (ordered.limit(k) if k is not None else ordered).collect()]  # k bounds what comes to the driver
    return {"title": title, "columns": df.columns, "rows": rows, "total": len(rows) if k is None or len(rows) < k else df.count()}


def _cell(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:,.2f}".rstrip("0").rstrip(".")
    if isinstance(value, int):
        return f"{value:,}"
    return ", ".join(map(_cell, value)) if isinstance(value, list) else str(value)


def _caption(part: dict) -> str:
    shown = len(part["rows"])
    return part["title"] if shown == part["total"] else f"{part['title']} ({shown:,} of {part['total']:,})"


def markdown(sections: list[dict]) -> str:
    """Sections as Markdown tables; those without rows are left out."""
    out = []
    for part in sections:
        if not part["rows"]:
            continue
        safe = [[_cell(v).replace("|", "\\|").replace("\n", " ") for v in row] for row in part["rows"]]
        numbers = [all(isinstance(r[i], int | float) and not isinstance(r[i], bool) for r in part["rows"]) for i in range(len(part["columns"]))]
        lines = [f"## {_caption(part)}", "", f"| {' | '.join(part['columns'])} |", f"|{'|'.join('-:' if n else '-' for n in numbers)}|"]
        out.append("\n".join(lines + [f"| {' | '.join(row)} |" for row in safe]))
    return "\n\n".join(out) + ("\n" if out else "")


def terminal(sections: list[dict], width: int = 120) -> str:
    """Sections as text in columns, cells cut so that a line fits the width."""
    out = []
    for part in sections:
        if not part["rows"]:
            continue
        cells = [part["columns"], *[[_cell(v) for v in row] for row in part["rows"]]]
        sizes = [max(len(row[i]) for row in cells) for i in range(len(part["columns"]))]
        while sum(sizes) + 2 * (len(sizes) - 1) > width and max(sizes) > 4:
            sizes[sizes.index(max(sizes))] -= 1
        cut = lambda text, n: text if len(text) <= n else text[: n - 1] + "…"
        lines = ["  ".join(cut(x, n).ljust(n) for x, n in zip(row, sizes, strict=True)).rstrip() for row in cells]
        out.append("\n".join([_caption(part), *lines]))
    return "\n\n".join(out) + ("\n" if out else "")


def write_sections(sections: dict[str, tuple], folder: str) -> None:
    """Each section's whole table (df, *order) as headed CSV under its name."""
    for name, (df, *order) in sections.items():
        write_csv(df, f"{folder}/{name}", *order)


def manifest(spark, options: dict) -> dict:
    """What a run was made with: versions and options, sorted so that equal runs are equal."""
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "options": dict(sorted(options.items()))}
