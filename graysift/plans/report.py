"""Reports of a scan: JSON and HTML of each document as columns, masked unless asked, and one document of each for a run."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.functions.rules import ADVICE
from graysift.functions.text import html_escape
from graysift.operators.score import summarise
from graysift.sources.joined import write_joined
from graysift.sources.shared import written


def report_json(results: DataFrame, show_values: bool = False) -> Column:
    """A document's result as JSON with the report's own field names."""
    finding = lambda f: F.struct(
        f["type"].alias("type"), f["label"].alias("label"), f["severity"].alias("ernst"), f["category"].alias("categorie"), f["source"].alias("bron"), f["line"].alias("regel"),
        f["n"].alias("aantal"), (f["value"] if show_values else f["masked"]).alias("waarde"), f["note"].alias("avg"), f["rationale"].alias("toelichting"),
    )
    have = set(results.columns)
    column = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    return F.to_json(
        F.struct(
            column("name", "string").alias("naam"), column("path", "string").alias("pad"), column("bytes", "long").alias("bytes"), column("kind", "string").alias("soort"), F.col("verdict").alias("oordeel"),
            F.col("advice").alias("advies"), F.col("ai_used").alias("aiGebruikt"), F.col("ai_summary").alias("samenvattingAi"), F.col("warnings").alias("waarschuwingen"),
            F.transform("findings", finding).alias("bevindingen"),
        ),
        {"ignoreNullFields": "false"},
    )


def report_card(results: DataFrame, show_values: bool = False) -> Column:
    """A document's result as a section of an HTML page: name, verdict, advice, what a model said, a table of findings with
    their places, and warnings. All texts are escaped."""
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name.split()[0]}>"))
    place = lambda f: F.when(f["in_filename"], "bestandsnaam").when(f["line"] > 0, F.concat(F.lit("regel "), f["line"].cast("string"))).otherwise(f["source"])
    times = lambda f: F.when(f["n"] > 1, F.concat(F.lit(" ×"), f["n"].cast("string"))).otherwise("")
    cells = lambda f: (esc(f["severity"]), F.concat(esc(f["label"]), times(f)), tag("code", esc(f["value"] if show_values else F.coalesce(f["masked"], f["value"]))), esc(place(f)), esc(F.coalesce(f["note"], f["rationale"])))
    row = lambda f: tag("tr", *[tag("td", c) for c in cells(f)])
    names = "".join(f"<th>{n}</th>" for n in ("Ernst", "Soort", "Waarde", "Plek", "Duiding"))
    table = F.when(F.size("findings") == 0, "<p>Geen bevindingen.</p>").otherwise(F.concat(F.lit(f"<table><tr>{names}</tr>"), F.array_join(F.transform("findings", row), ""), F.lit("</table>")))
    warnings = F.when(F.size("warnings") == 0, "").otherwise(tag("ul", F.array_join(F.transform("warnings", lambda w: tag("li", esc(w))), "")))
    said = F.when(F.coalesce("ai_summary", F.lit("")) == "", "").otherwise(tag("p", esc(F.col("ai_summary"))))
    title = esc(F.coalesce("name", F.col("path")) if "path" in results.columns else F.col("name"))
    return tag("section", tag("h2", title, F.lit(" — "), esc(F.col("verdict"))), tag("p", esc(F.col("advice"))), said, table, warnings)


# What every report says of itself.
DISCLAIMER = {
    "nl": "Deze tool is experimenteel. Een scan mist persoonsgegevens en meldt soms iets wat het niet is. Jij blijft zelf verantwoordelijk voor wat je uploadt naar een AI-systeem of deelt met derden. De uitkomst is geen juridisch advies en toont geen naleving aan van de AVG, de GDPR of enige andere wet. Geleverd zonder enige garantie (MIT-licentie).",
    "en": "This tool is experimental. A scan misses personal data and sometimes flags things that are not. You remain responsible for whatever you upload to an AI system or share with third parties. Its output is not legal advice and does not establish compliance with the GDPR or any other law. Provided without any warranty (MIT licence).",
}


def write_report(results: DataFrame, path: str, threshold: str = "middel", show_values: bool = False) -> None:
    """report.json and report.html under a path: one document each, whose files are in order of their paths. Tasks write their
    parts and the commit joins them; the summary's counts are the only rows that the driver sees."""
    by = "path" if "path" in results.columns else "name"
    told = report_envelope(results, threshold).first()["report"]
    summary = json.loads(told)["samenvatting"]
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = results.select(F.col(by).alias("by"), report_json(results, show_values).alias("json"), report_card(results, show_values).alias("html"))
    ordered = written(values.repartitionByRange(parts, "by").sortWithinPartitions("by"), "report")
    ordered = ordered.repartitionByRange(parts, "by").sortWithinPartitions("by")
    write_joined(ordered.select(F.col("json").alias("value")), f"{path}/report.json", told[:-1] + ',"bestanden":[', ",\n", "]}")
    counts = ", ".join(f"{n}× {v}" for v, n in summary["telling"].items())
    head = f'<!doctype html><html lang="nl"><meta charset="utf-8"><title>Rapport</title><p>{html.escape(DISCLAIMER["nl"])}</p><p>{summary["bestanden"]} bestand(en): {counts}</p><p>{html.escape(summary["upload_advies"])}</p>'
    shown = "volledig weergegeven; behandel dit rapport als vertrouwelijk" if show_values else "gemaskeerd weergegeven"
    write_joined(ordered.select(F.col("html").alias("value")), f"{path}/report.html", head, "\n", f'<footer>Waarden zijn {shown}.<p lang="en">{html.escape(DISCLAIMER["en"])}</p></footer></html>')


def report_envelope(results: DataFrame, threshold: str = "middel") -> DataFrame:
    """What a run's report says besides its files: one row with tool, version, time and summary as JSON. Names are not
    gathered here: blocked(results) and results with verdict onbekend are tables of any size."""
    s = summarise(results, threshold)
    counts = F.struct(*[F.col(f"n_{v}").alias(v) for v in ADVICE])
    summary = F.struct(F.col("files").alias("bestanden"), counts.alias("telling"), F.col("highest").alias("hoogste_oordeel"), F.col("threshold").alias("drempel"), F.col("n_blocked").alias("geblokkeerd"), F.col("advice").alias("upload_advies"))
    disclaimer = F.struct(*[F.lit(v).alias(k) for k, v in DISCLAIMER.items()]).alias("disclaimer")
    return s.select(F.to_json(F.struct(F.lit("privacy-scan").alias("tool"), F.lit(1).alias("versie"), disclaimer, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("tijdstip"), summary.alias("samenvatting"))).alias("report"))
