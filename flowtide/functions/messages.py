"""Notification texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtide.functions.scalars import escape_message, percent, utc_text

# --- Fixed values: severity markers. ---
SEVERITY_MARKS = {"CRITICAL": "\U0001f534", "HIGH": "\U0001f7e0",
                  "MEDIUM": "\U0001f7e1", "LOW": "\U0001f7e2"}
# --- Fixed values: recommended actions by severity. ---
ACTIONS = {
    "CRITICAL": ("  1) <b>Immediate containment</b> — isolate source host",
                 "  2) Block IP at perimeter firewall",
                 "  3) Capture full packet trace for forensics"),
    "HIGH": ("  1) Investigate source IP activity logs",
             "  2) Monitor lateral movement attempts",
             "  3) Review related alerts in dashboard"),
    "LOW": ("  1) Review alert in {product} dashboard",
            "  2) Cross-reference with threat intelligence feeds"),
}
_RULE = "└" + "─" * 30


def severity_mark(severity: Column) -> Column:
    mark = F.lit(SEVERITY_MARKS["LOW"])
    for name, symbol in SEVERITY_MARKS.items():
        mark = F.when(severity == name, symbol).otherwise(mark)
    return mark


def _code(value: Column) -> Column:
    return F.concat(F.lit("<code>"), escape_message(value.cast("string")), F.lit("</code>"))


def _line(title: str, value: Column, edge: str = "├") -> Column:
    return F.concat(F.lit(f"{edge} <b>{title}:</b> "), value)


def _filled(value: Column) -> Column:
    """Null for empty text, so the line is skipped."""
    return F.when(value != "", value)


def _head(heading: str, severity: Column) -> list[Column]:
    marked = F.concat(F.lit("┌ "), severity_mark(severity), F.lit(" <b>Severity:</b> "),
                      _code(severity))
    return [F.lit(heading), F.lit(""), marked,
            _line("Alert ID", _code(F.coalesce(F.concat(F.lit("#"), F.col("alert_id").cast("string")),
                                               F.lit("pending"))))]


def _body() -> list[Column]:
    c = F.col
    return [
        _line("Timestamp", _code(utc_text(c("event_time")))),
        _line("Threat Type", _code(c("threat_type"))),
        _line("Source IP", _code(F.coalesce(_filled(c("source_ip")), F.lit("N/A")))),
        _line("Destination IP", _code(_filled(c("destination_ip")))),
        _line("Inference Model", _code(c("model_name"))),
        _line("Confidence", _code(percent(c("confidence"), 2))),
        _line("Source Type", _code(F.upper(_filled(c("source_type"))))),
        _line("Reason", escape_message(_filled(c("reason")))),
        F.lit(_RULE), F.lit(""),
    ]


def threat_message(severity: Column, product: str = "Flow analytics") -> Column:
    """Text for a new alert. Lines whose value is missing are skipped."""
    def actions(level: str) -> Column:
        return F.lit("\n".join(ACTIONS[level]).replace("{product}", product))

    advice = (F.when(severity == "CRITICAL", actions("CRITICAL"))
              .when(severity.isin("HIGH", "MEDIUM"), actions("HIGH"))
              .otherwise(actions("LOW")))
    return F.concat_ws("\n", *_head(f"\U0001f6a8 <b>{product} THREAT DETECTED</b>", severity),
                       *_body(), F.lit("⚠️ <b>Recommended Actions:</b>"), advice)


def escalation_message(severity: Column, product: str = "Flow analytics") -> Column:
    """Text for an alert whose occurrence count reached an escalation level."""
    times = F.col("occurrence").cast("string")
    closing = F.concat(F.lit("⚠️ This threat has been observed <b>"), times,
                       F.lit(" times</b>. Consider escalating response."))
    return F.concat_ws("\n", *_head(f"\U0001f4c8 <b>{product} THREAT ESCALATION</b>", severity),
                       _line("Occurrences", _code(times)), *_body(), closing)
