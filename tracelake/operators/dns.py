"""DNS queries and their responses, correlated within each flow in frame order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.flows import KEY
from tracelake.operators.folds import fold

#: A query waits so long, by the capture's watermark; so many wait in a flow.
WAIT_US, WAITING = 5_000_000, 32
NXDOMAIN, SERVFAIL = 3, 2
RESULT = {
    "dns_queries": "long", "dns_matched_responses": "long", "dns_unanswered_queries": "long", "dns_tracking_limit_hits": "long", "dns_nxdomain": "long", "dns_servfail": "long",
    "dns_response_latency_min_ms": "double", "dns_response_latency_avg_ms": "double", "dns_response_latency_max_ms": "double",
}


class Flow:
    def __init__(self):
        self.waiting: list[tuple] = []  # id, direction, question, time
        self.seen = False
        self.queries = self.matched = self.refused = self.nxdomain = self.servfail = 0
        self.least = self.mean = self.most = None

    def take(self, _frame, ts, watermark, forward, ident, response, rcode, question, complete) -> None:
        if watermark - ts > WAIT_US:
            return
        self.waiting = [q for q in self.waiting if watermark - q[3] <= WAIT_US]
        if response:
            fits = [q for q in self.waiting if q[0] == ident and q[1] != forward and question in (None, q[2])]
            # An answer that fits several queries answers none.
            if len(fits) == 1 and ts >= fits[0][3] and complete:
                self.waiting.remove(fits[0])
                self.answered((ts - fits[0][3]) / 1000, rcode)
        elif (ident, forward, question) not in (q[:3] for q in self.waiting):
            self.seen = True
            if len(self.waiting) >= WAITING:
                self.refused += 1
            else:
                self.waiting.append((ident, forward, question, ts))
                self.queries += 1

    def answered(self, ms: float, rcode: int) -> None:
        self.matched += 1
        self.nxdomain += rcode == NXDOMAIN
        self.servfail += rcode == SERVFAIL
        self.mean = ms if self.mean is None else self.mean + (ms - self.mean) / self.matched
        self.least, self.most = (ms, ms) if self.least is None else (min(self.least, ms), max(self.most, ms))

    def result(self) -> tuple | None:
        return (self.queries, self.matched, self.queries - self.matched, self.refused, self.nxdomain, self.servfail, self.least, self.mean, self.most) if self.seen else None


def usable(messages: DataFrame) -> DataFrame:
    """One question, or none in a response that reports an error; a question that can't be read counts as no message."""
    one = (F.col("question_count") == 1) & F.col("question").isNotNull()
    bare = (F.col("question_count") == 0) & F.col("response") & (F.col("rcode") != 0)
    return messages.filter((F.col("opcode") == 0) & (one | bare))


def dns_flows(messages: DataFrame, *more_keys: str) -> DataFrame:
    """One row a flow that asked something, with the columns of RESULT. messages: keyed rows with frame_no,
    ts_us, watermark_us, a_to_b, dns_id, response, opcode, rcode, question_count, question, complete.
    There is no cap on queries that wait across all flows, only on those of one flow."""
    names = ["frame_no", "ts_us", "watermark_us", "a_to_b", "dns_id", "response", "rcode", "question", "complete"]
    return fold(usable(messages), [*KEY, *more_keys], names, RESULT, Flow, Flow.take, Flow.result)
