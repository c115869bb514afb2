"""Counters and gauges of a run in the Prometheus text format."""

from __future__ import annotations

PREFIX = "tracelake"
# Families, their kinds and the keys of a summary that they show.
FAMILIES = (
    ("uptime_seconds", "gauge", "Seconds that the run took.", "run_secs"),
    ("capture_bytes_total", "counter", "Bytes on the wire of all frames.", "wire_bytes"),
    ("capture_packets_total", "counter", "Frames that passed the filter.", "frames_read"),
    ("active_flows", "gauge", "Flows that have not ended.", "flows_retained"),
    ("dispatch_drops_total", "counter", "Frames dropped between reading and processing.", "dispatch_drops"),
    ("kernel_drops_total", "counter", "Frames dropped by the kernel.", "kernel_drops"),
    ("kernel_if_drops_total", "counter", "Frames dropped by the interface.", "interface_drops"),
)
REASONS = ("key_limit", "record_limit", "per_key_evictions", "cooldown_limit")


def escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


def render(summary: dict, version: str = "0") -> str:
    """summary: of run(); what it does not tell, drops of a file or what no detector counted, is left out."""
    lines = [f"# HELP {PREFIX}_build_info Version.", f"# TYPE {PREFIX}_build_info gauge", f'{PREFIX}_build_info{{version="{escaped(version)}"}} 1']
    for name, kind, about, key in FAMILIES:
        if summary.get(key) is None:
            continue
        lines += [f"# HELP {PREFIX}_{name} {about}", f"# TYPE {PREFIX}_{name} {kind}", f"{PREFIX}_{name} {summary[key]}"]
    if saturation := summary.get("anomaly_saturation"):
        name = f"{PREFIX}_anomaly_evidence_discards_total"
        lines += [f"# HELP {name} Evidence that detector limits turned away.", f"# TYPE {name} counter"]
        lines += [f'{name}{{detector="{d}",reason="{r}"}} {counts[r]}' for d, counts in saturation.items() for r in REASONS if r in counts]
    return "\n".join(lines) + "\n"
