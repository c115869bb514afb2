"""A run from capture files to outputs; its settings."""

import json

import pytest

from tests.test_packets import START, frames_of, port_scan, protocol_edges, syn_flood, tcp4
from tracelake.plans import config
from tracelake.plans.run import run
from tracelake.sources import pcap


@pytest.mark.parametrize("text", ["[flow]\ntimeout_secs = -1.0", "[output]\nwrite_pcap_rotate_mb = 1", "[output]\nexport_csv = 'a'\nexport_json = 'a/'", "[analysis.anomalies]\nenabled = true\n[analysis.anomalies.syn_flood]\nwindow_secs = 0.0", "[capture]\nsnaplen = -1"])
def test_bad_settings(text):
    with pytest.raises(ValueError):
        config.from_toml(text)


def test_defaults():
    assert config.from_toml("[web]\nenabled = false\n[output]\nexport_csv = ''") == config.Config()


def test_run(spark, tmp_path):
    packets = port_scan() + syn_flood() + protocol_edges()
    pcap.write_pcap(frames_of(spark, packets, 1000), str(tmp_path / "in"), files=1)
    names = ("export_json", "export_csv", "expired_flows_jsonl", "summary_json", "metrics_text", "write_pcap")
    text = f"[capture]\nread_pcap = '{tmp_path}/in'\n[output]\n" + "\n".join(f"{n} = '{tmp_path}/{n}'" for n in names)
    text += f"\n[analysis]\nalerts_jsonl = '{tmp_path}/alerts'\n[analysis.anomalies]\nenabled = true\n[analysis.anomalies.syn_flood]\nsyn_threshold = 60\n[analysis.anomalies.port_scan]\nunique_ports_threshold = 16\n"
    got = run(spark, config.from_toml(text))
    assert (got["frames_read"], got["flows_created"], got["flows_expired"], got["alerts_emitted"], got["malformed_or_unsupported"]) == (86, 82, 0, 2, 2)
    lines = lambda n: [json.loads(x) for f in (tmp_path / n).glob("*.json") for x in f.open()]
    assert len(lines("export_json")) == 82 and {r["kind"] for r in lines("alerts")} == {"syn_flood", "port_scan"} and not lines("expired_flows_jsonl")
    (file,) = (tmp_path / "summary_json").glob("*.txt")
    assert json.loads(file.read_text())["flows_created"] == 82
    (file,) = (tmp_path / "metrics_text").glob("*.txt")
    assert "capture_packets_total 86\n" in file.read_text()
    back = pcap.read_pcap(spark, str(tmp_path / "write_pcap")).orderBy("frame_no").collect()
    assert [bytes(r.raw) for r in back] == packets


def test_filter_limit_and_expiry(spark, tmp_path):
    one, two = (tcp4("192.0.2.1", 1000 + k, "198.51.100.1", 80, 2, 1) for k in (0, 1))
    times = [0, 1, 100, 101, 200]
    rows = [(i + 1, START + t * 1_000_000, 54, bytearray(p)) for i, (t, p) in enumerate(zip(times, (one, two, two, one, two)))]
    pcap.write_pcap(spark.createDataFrame(rows, "frame_no long, ts_us long, wire_len long, raw binary"), str(tmp_path / "in"), files=1)
    base = f"[capture]\nread_pcap = '{tmp_path}/in'\n"
    got = run(spark, config.from_toml(base))
    # At 100 the sweep ends the first flow alone: the second has just been seen. At 200 it ends the first again.
    assert (got["flows_created"], got["flows_expired"]) == (3, 2)
    got = run(spark, config.from_toml(base + "filter = 'ip and src host 192.0.2.1 and port 1001'\n[run]\ncount = 2\n"))
    assert (got["frames_read"], got["flows_created"], got["flows_expired"]) == (2, 1, 0)


def test_snaplen_does_not_cut_frames_of_files(spark, tmp_path):
    packets = port_scan()
    pcap.write_pcap(frames_of(spark, packets, 1000), str(tmp_path / "in"), files=1)
    text = f"[capture]\nread_pcap = '{tmp_path}/in'\nsnaplen = 20\n[output]\nwrite_pcap = '{tmp_path}/out'\n"
    assert run(spark, config.from_toml(text))["malformed_or_unsupported"] == 0
    assert [bytes(r.raw) for r in pcap.read_pcap(spark, str(tmp_path / "out")).orderBy("frame_no").collect()] == packets


def test_capped_run(spark, tmp_path):
    pcap.write_pcap(frames_of(spark, port_scan(), 1000), str(tmp_path / "in"), files=1)
    text = f"[capture]\nread_pcap = '{tmp_path}/in'\n[flow]\nmax_flows = 4\n[analysis]\nrtt = false\nout_of_order = false\n[output]\nexpired_flows_jsonl = '{tmp_path}/expired'\nexport_csv = '{tmp_path}/kept'\n"
    got = run(spark, config.from_toml(text))
    assert (got["flows_created"], got["flows_evicted"], got["flows_expired"], got["flows_retained"], got["status"]) == (16, 12, 0, 4, "success")
    rows = [json.loads(x) for f in (tmp_path / "expired").glob("*.json") for x in f.open()]
    assert len(rows) == 12 and {r["reason"] for r in rows} == {"eviction"}


def test_failed_run_leaves_a_summary(spark, tmp_path):
    text = f"[capture]\nread_pcap = '{tmp_path}/none'\n[output]\nsummary_json = '{tmp_path}/summary'\n"
    with pytest.raises(Exception):
        run(spark, config.from_toml(text))
    (file,) = (tmp_path / "summary").glob("*.txt")
    told = json.loads(file.read_text())
    assert told["status"] == "failed" and told["error"] and told["source"].startswith("pcap:")
