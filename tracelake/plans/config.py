"""Settings of a run, from TOML, with their checks. Names of keys and their defaults are fixed values, but for
max_flows, which is no cap here. Settings of other programs' parts are ignored."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Capture:
    read_pcap: str | None = None
    filter: str | None = None
    snaplen: int = 65535


@dataclass(frozen=True)
class Run:
    count: int = 0


@dataclass(frozen=True)
class Output:
    write_pcap: str | None = None
    write_pcap_rotate_mb: int = 0
    write_pcap_max_files: int = 0
    export_json: str | None = None
    export_csv: str | None = None
    summary_json: str | None = None
    metrics_text: str | None = None
    expired_flows_jsonl: str | None = None
    expired_flows_csv: str | None = None


@dataclass(frozen=True)
class Flow:
    timeout_secs: float = 60.0
    #: Flows held at once; 0 is no cap. Where the table can be full, frames are replayed in order, see operators/capped.py.
    max_flows: int = 0


@dataclass(frozen=True)
class SynFlood:
    enabled: bool = True
    window_secs: float = 5.0
    syn_threshold: int = 200
    unique_src_threshold: int = 50
    cooldown_secs: float = 10.0


@dataclass(frozen=True)
class PortScan:
    enabled: bool = True
    window_secs: float = 10.0
    unique_ports_threshold: int = 25
    unique_hosts_threshold: int = 10
    cooldown_secs: float = 30.0


@dataclass(frozen=True)
class Anomalies:
    enabled: bool = False
    syn_flood: SynFlood = field(default_factory=SynFlood)
    port_scan: PortScan = field(default_factory=PortScan)


@dataclass(frozen=True)
class Analysis:
    rtt: bool = True
    retrans: bool = True
    out_of_order: bool = True
    anomalies: Anomalies = field(default_factory=Anomalies)
    alerts_jsonl: str | None = None


@dataclass(frozen=True)
class Config:
    capture: Capture = field(default_factory=Capture)
    run: Run = field(default_factory=Run)
    output: Output = field(default_factory=Output)
    flow: Flow = field(default_factory=Flow)
    analysis: Analysis = field(default_factory=Analysis)

    def outputs(self) -> dict[str, str]:
        found = {f.name: getattr(self.output, f.name) for f in fields(Output) if f.name in PATHS} | {"alerts_jsonl": self.analysis.alerts_jsonl}
        return {k: v for k, v in found.items() if v}


PATHS = ("write_pcap", "export_json", "export_csv", "summary_json", "metrics_text", "expired_flows_jsonl", "expired_flows_csv")


def _build(kind, values: dict):
    given = {}
    for f in fields(kind):
        if f.name in values:
            default = f.default_factory() if callable(f.default_factory) else f.default
            value = values[f.name]
            given[f.name] = _build(type(default), value) if is_dataclass(default) else None if value == "" and default is None else value
    return kind(**given)


def from_toml(text: str) -> Config:
    config = _build(Config, tomllib.loads(text))
    validate(config)
    return config


def validate(config: Config) -> None:
    """Raises ValueError with all that is wrong."""
    out, bad = config.output, []
    rotation = (out.write_pcap_rotate_mb, out.write_pcap_max_files)
    syn, scan = config.analysis.anomalies.syn_flood, config.analysis.anomalies.port_scan
    positive = lambda x: math.isfinite(x) and x > 0
    rules = [
        (config.capture.snaplen < 0, "capture.snaplen must not be negative"), (config.run.count < 0, "run.count must not be negative"),
        (not math.isfinite(config.flow.timeout_secs) or config.flow.timeout_secs < 0, "flow.timeout_secs must be finite and not negative"),
        (config.flow.max_flows < 0, "flow.max_flows must not be negative"),
        (any(rotation) and not out.write_pcap, "rotation needs output.write_pcap"), (any(rotation) and not all(rotation), "rotation needs a size and a number of files"),
    ]
    for name, x in (("syn_flood", syn), ("port_scan", scan)):
        if config.analysis.anomalies.enabled and x.enabled:
            rules += [(not positive(x.window_secs), f"{name}.window_secs must be positive"), (not math.isfinite(x.cooldown_secs) or x.cooldown_secs < 0, f"{name}.cooldown_secs must be finite and not negative")]
    if config.analysis.anomalies.enabled:
        rules += [(syn.enabled and 0 in (syn.syn_threshold, syn.unique_src_threshold), "syn_flood needs both thresholds"), (scan.enabled and not (scan.unique_ports_threshold or scan.unique_hosts_threshold), "port_scan needs a threshold")]
    paths = [p.rstrip("/") for p in (config.capture.read_pcap, *config.outputs().values()) if p]
    rules.append((len(set(paths)) < len(paths), "inputs and outputs must be different paths"))
    bad = [what for wrong, what in rules if wrong]
    if bad:
        raise ValueError("; ".join(bad))
