"""Change-journal folding and carving as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracewell.functions.bits import FILE_DELETE, NAMING_MASK, RENAME_NEW
from tracewell.operators.payloads import resume

_STATE = (
    "first_usn long, first_name string, last_usn long, event_count long, reason_mask long, "
    "created_usn long, created_at timestamp, deleted_usn long, deleted_at timestamp, deletions long, renames long"
)
_RENAMES = "name string"
OUTPUT = (
    "volume_id string, file_reference long, name string, renamed_from string, created_at timestamp, deleted_at timestamp, "
    "was_deleted boolean, last_usn long, event_count long, reason_mask long"
)

_OUT = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


class TimelineFold(StatefulProcessor):
    """State per file reference: one summary row, and the name each rename gave, keyed by its USN.

    Records are judged by USN, never by clock or arrival: a late record lands where its USN belongs.
    Only renames are kept one by one, because a late one can change what came before another.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _STATE)
        self.renames = handle.getMapState("renames", "usn long", _RENAMES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.row.get()
        first, name, last, count, mask, born_at, born, dead_at, dead, deletions, renamed = known or (None, None, -1, 0, 0, None, None, None, None, 0, 0)
        # A reference without earlier renames has none to read back.
        names = {k[0]: v[0] for k, v in self.renames.iterator()} if renamed else {}
        for r in rows:
            usn, stamp, reasons, given = r.usn, r.ts, r.reason_mask, r.name
            if first is None or usn < first:
                first, name = usn, given
            if reasons & RENAME_NEW:
                self.renames.updateValue((usn,), (given,))
                names[usn] = given
            if reasons & NAMING_MASK and stamp is not None and (born_at is None or usn < born_at):
                born_at, born = usn, stamp
            if reasons & FILE_DELETE:
                deletions += 1
                if dead_at is None or usn > dead_at:
                    dead_at, dead = usn, stamp
            last, count, mask = max(last, usn), count + 1, mask | reasons
        self.row.update((first, name, last, count, mask, born_at, born, dead_at, dead, deletions, len(names)))
        current, replaced = name, None
        for _, new in sorted(names.items()):
            if new != current:
                current, replaced = new, current
        yield _OUT(key[0], key[1], current, replaced, born, dead, dead is not None, last, count, mask)

    def close(self) -> None:
        pass


def stream_timeline(usn: DataFrame) -> DataFrame:
    """A stream of timeline rows, one per file reference and batch that touched it; the newest row counts.

    Records repeated by an overlapping journal copy are to be dropped first (:func:`drop_repeats`).
    """
    narrow = usn.select("volume_id", "file_reference", "usn", "ts", "reason_mask", "name")
    return narrow.groupBy("volume_id", "file_reference").transformWithState(
        statefulProcessor=TimelineFold(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )


def drop_repeats(usn: DataFrame, ingest_time: str = "ingested_at", horizon: str = "1 day") -> DataFrame:
    """Drop records whose ``(volume, usn, reference, name)`` came in before, within an ingest-time horizon."""
    return usn.withWatermark(ingest_time, horizon).dropDuplicatesWithinWatermark(["volume_id", "usn", "file_reference", "name"])


def latest_rows(updates: DataFrame) -> DataFrame:
    """Current timeline of a stored update stream: the row with most events per reference."""
    cols = [c for c in updates.columns if c not in ("volume_id", "file_reference")]
    best = updates.groupBy("volume_id", "file_reference").agg(F.max_by(F.struct(*cols), "event_count").alias("r"))
    return best.select("volume_id", "file_reference", *[F.col(f"r.{c}").alias(c) for c in cols])


def carve_stream(
    images: DataFrame, carve_batch: Callable[[DataFrame], DataFrame], entries: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Carve images as they land. Payloads an earlier session recorded are skipped, evidence is read again.

    ``carve_batch`` turns a batch of image rows into recovered files, ``entries`` reads the current
    session entries, ``sink`` stores a batch under its number, which makes a replay idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        found = carve_batch(batch)
        sink(resume(found, entries()), number)

    return images.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(df: DataFrame, name: str = "progress") -> DataFrame:
    """Attach progress counters a query listener can read: rows, bytes and findings so far."""
    size = F.sum("length") if "length" in df.columns else F.lit(0).cast("long")
    return df.observe(name, F.count(F.lit(1)).alias("rows"), size.alias("bytes"))
