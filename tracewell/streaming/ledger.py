"""Live ledger monitoring: alerts on gaps, broken links and altered blocks as blocks arrive."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.canonical import block_hash
from tracewell.operators.ledger import GENESIS_PREV

ALERTS = "chain_id string, block_index long, kind string, detail string"
_TIP = "tip_index long, tip_hash string, queued long"
_ALERT = Row("chain_id", "block_index", "kind", "detail")
_WAITING = "prev_hash string, block_hash string, hash_ok boolean"


class LedgerMonitor(StatefulProcessor):
    """State per chain: the verified tip, and blocks waiting for their predecessor.

    A block that follows the tip is judged at once. One that arrives early waits in keyed map state, one entry per
    index, so nothing is rewritten when another block joins the queue; the tip says how many wait, so that a chain in
    order never looks into the map. A timer names a gap that was not filled in time; the waiting blocks stay, and are
    linked as soon as the missing one arrives.
    """

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tip = handle.getValueState("tip", _TIP)
        self.waiting = handle.getMapState("waiting", "block_index long", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chain = key[0]
        index, tip_hash, queued = self.tip.get() or (-1, GENESIS_PREV, 0)
        for blocks in _groups(rows):
            for at, prev, digest, sound in blocks:
                if at <= index or (queued and self.waiting.containsKey((at,))):
                    yield _ALERT(chain, at, "repeat", "a block with this index was already seen")
                    continue
                if at > index + 1:
                    self.waiting.updateValue((at,), (prev, digest, sound))
                    queued += 1
                    continue
                while True:
                    index = at
                    if prev != tip_hash:
                        yield _ALERT(chain, at, "link", "prev_hash does not match previous block hash")
                    if not sound:
                        yield _ALERT(chain, at, "hash", "recomputed hash differs from stored hash")
                    tip_hash = digest
                    at = index + 1
                    if not queued or not self.waiting.containsKey((at,)):
                        break
                    prev, digest, sound = self.waiting.getValue((at,))
                    self.waiting.removeKey((at,))
                    queued -= 1
        self.tip.update((index, tip_hash, queued))
        if self.patience_ms is not None and queued and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        index = self.tip.get()[0] if self.tip.exists() else -1
        found = min((k[0] for k in self.waiting.keys()), default=None)
        if found is not None:
            yield _ALERT(key[0], found, "gap", f"expected index {index + 1}, found {found}")
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def close(self) -> None:
        pass


def _groups(rows: Iterator[Row]) -> Iterator[list[tuple[int, str, str, bool]]]:
    """The blocks in groups of at most 10,000, each by index, so that most of them meet their predecessor."""
    while group := [(int(r.block_index), r.prev_hash, r.block_hash, bool(r.hash_ok)) for r in islice(rows, 10_000)]:
        yield sorted(group, key=lambda b: b[0])


def monitor_ledger(blocks: DataFrame, patience_seconds: int | None = 600) -> DataFrame:
    """Alert stream ``(chain_id, block_index, kind, detail)`` of a stream of ledger blocks.

    Hashes are recomputed in the JVM before the keyed state, so state holds two digests per waiting
    block. The query needs the RocksDB state store. Without patience (for a bounded replay, which
    timers would keep alive) gaps are left to the batch check.
    """
    narrow = blocks.select("chain_id", "block_index", "prev_hash", "block_hash", block_hash().eqNullSafe(F.col("block_hash")).alias("hash_ok"))
    return narrow.groupBy("chain_id").transformWithState(
        statefulProcessor=LedgerMonitor(None if patience_seconds is None else patience_seconds * 1000), outputStructType=ALERTS,
        outputMode="Append", timeMode="None" if patience_seconds is None else "ProcessingTime",
    )
