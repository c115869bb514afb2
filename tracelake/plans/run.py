"""A whole run over capture files: filter, flows, alerts, outputs and a summary."""

from __future__ import annotations

import contextlib
import json
import time
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.functions.capture_filter import matches
from tracelake.functions.decode import decode
from tracelake.operators import accounting, capped, detectors, flows, snapshots
from tracelake.plans import metrics
from tracelake.plans.config import Config, validate
from tracelake.sources import export, pcap
from tracelake.sources.tables import cut

SECOND = 1_000_000


def run(spark: SparkSession, config: Config) -> dict:
    """Writes the outputs that config names, each a folder, and the summary last, and returns it. A run that
    fails or is interrupted leaves a summary that says so, and raises the error again."""
    validate(config)
    began, status, summary = time.monotonic(), "success", {}
    try:
        summary = _outputs(spark, config)
        return summary
    except BaseException as error:
        status = "interrupted" if isinstance(error, KeyboardInterrupt) else "failed"
        summary = {"error": f"{type(error).__name__}: {error}"[:1000]}
        raise
    finally:
        head = {"schema_version": 1, "status": status, "source": f"pcap:{config.capture.read_pcap}", "run_secs": round(time.monotonic() - began, 3)}
        whole = {**head, **summary, "effective_config": asdict(config)}
        summary.update(whole)
        for path, text in ((config.output.summary_json, json.dumps(whole, indent=2)), (config.output.metrics_text, metrics.render(whole).rstrip("\n"))):
            if path:
                with contextlib.suppress(Exception) if status != "success" else contextlib.nullcontext():
                    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _outputs(spark: SparkSession, config: Config) -> dict:
    """All outputs but the summary, and the counts for it. All frames that pass the filter count, decodable or not."""
    out, found = config.output, config.analysis.anomalies
    # Whole frames: snaplen is for live capture. Read once, and written decoded.
    packets = pcap.read_pcap(spark, config.capture.read_pcap, lambda frames: decode(frames.withColumn("original", F.col("raw"))))
    if config.capture.filter:
        packets = packets.filter(matches(config.capture.filter, raw="original"))
    packets = cut(flows.with_watermark(flows.limited(packets, config.run.count)), "packets")
    if out.write_pcap:
        link = packets.select("link_type").first()
        rotation = {"rotate_bytes": out.write_pcap_rotate_mb << 20, "keep": out.write_pcap_max_files}
        pcap.write_pcap(packets.withColumn("raw", F.col("original")), out.write_pcap, link[0] if link else 1, **rotation)

    timeout = round(config.flow.timeout_secs * SECOND)
    swept = cut(flows.sweeps(packets), "sweeps")
    keyed = flows.with_key(flows.eligible(packets.drop("original")))
    if config.flow.max_flows:
        ends = cut(capped.admitted(keyed, swept, config.flow.max_flows, timeout), "admitted")
        numbered = keyed.join(ends.select("frame_no", "instance"), "frame_no")
        ends = ends.select(*flows.KEY, "instance", F.col("ended_us").alias("expired_us"), "reason").distinct()
    else:
        numbered = flows.instances(keyed, swept, timeout)
        ends = flows.lives(keyed, swept, timeout).select(*flows.KEY, "instance", "expired_us").withColumn("reason", F.when(F.col("expired_us").isNotNull(), "timeout"))
    lived = snapshots.snapshots(numbered, "instance").join(ends, [*flows.KEY, "instance"])
    for on, columns in ((config.analysis.rtt, ("rtt_last_ms", "rtt_min_ms", "rtt_ewma_ms", "rtt_samples")), (config.analysis.retrans, ("retransmissions",)), (config.analysis.out_of_order, ("out_of_order",))):
        if not on:  # not tracked: no round-trip times, counts of 0
            lived = lived.withColumns({c: (F.lit(None) if c.endswith("_ms") else F.lit(0)).cast(lived.schema[c].dataType) for c in columns})
    lived = cut(lived, "flows")
    expired = lived.filter("expired_us is not null").orderBy("expired_us", *flows.KEY)
    kept = lived.filter("expired_us is null").drop("expired_us", "reason").orderBy(F.desc("bytes_total"), *flows.KEY, "instance")
    for rows, path, write in ((kept, out.export_json, export.write_json), (kept, out.export_csv, export.write_csv), (expired, out.expired_flows_jsonl, export.write_json), (expired, out.expired_flows_csv, export.write_csv)):
        if path:
            write(rows, path)

    alerts = 0
    for on, x, detect, limits in (
        (found.syn_flood.enabled, found.syn_flood, detectors.syn_flood_alerts, ("syn_threshold", "unique_src_threshold")),
        (found.port_scan.enabled, found.port_scan, detectors.port_scan_alerts, ("unique_ports_threshold", "unique_hosts_threshold")),
    ):
        if found.enabled and on:
            own = cut(detect(packets, round(x.window_secs * SECOND), *(getattr(x, k) for k in limits), round(x.cooldown_secs * SECOND)), "alerts")
            alerts += own.count()
            if config.analysis.alerts_jsonl:
                texts = {c: export.address_text(F.col(c)) for c in ("src_ip", "dst_ip") if c in own.columns}
                own.withColumns(texts).write.mode("append").json(config.analysis.alerts_jsonl)

    counts = accounting.account(packets).first().asDict()
    ended, evicted = expired.agg(F.count("*"), F.count_if(F.col("reason") == "eviction")).first()
    created = lived.count()
    return {
        **counts, "flows_created": created, "flows_expired": ended - evicted, "flows_retained": created - ended, "flows_evicted": evicted, "alerts_emitted": alerts,
        "dispatch_drops": 0, "kernel_drops": None, "interface_drops": None,  # a file tells of no drops
    }
