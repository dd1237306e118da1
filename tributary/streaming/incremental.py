"""Incremental resolution: batches of new records against the canonical index.

`drain` reads batch after batch beyond the watermark until nothing is left; `stream` does the
same for a Structured Streaming source, one micro-batch at a time. Both advance the watermark
only after the index with the batch is written, so that a run that dies repeats its batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CLUSTER_ID, ENTITY_UID
from ..operators.blocking import Blocking, block
from ..operators.clustering import canonical_index, incremental_labels, merge_canonical_index
from ..operators.scoring import Scoring, accumulate, score_pairs
from ..operators.staging import Staging, stage
from ..sources.tables import VersionedTable
from ..storage import materialize
from .state import Lock, Watermarks, cursors_of

Featurize = Callable[[DataFrame], DataFrame]


def resolve_batch(index: DataFrame | None, records: DataFrame, blocking: Blocking | list[Blocking], tiers: list[Scoring], tf: Callable[[DataFrame], DataFrame] | DataFrame | None = None) -> DataFrame:
    """The index after a batch: new records matched among themselves and with all earlier ones,
    clusters joined and relabelled, also those of earlier records. blocking: one for all tiers or
    one for each. tf: term frequencies, or what makes them from all records."""
    records = materialize(records.dropDuplicates([ENTITY_UID]))
    if index is None:
        index = canonical_index(records)
    earlier = index.join(records.select(ENTITY_UID), ENTITY_UID, "left_anti")
    everyone = earlier.drop(CLUSTER_ID).unionByName(records.select(*[c for c in index.columns if c != CLUSTER_ID]))
    if callable(tf):
        tf = materialize(tf(everyone))
    matches = None
    for tier, paths in zip(tiers, blocking if isinstance(blocking, list) else [blocking] * len(tiers), strict=True):
        pairs = block(records, paths, canonical=earlier, excluded=matches)
        matches = materialize(accumulate(matches, score_pairs(pairs, everyone, tier, tf)))
    return merge_canonical_index(index, records, incremental_labels(matches, records, index))


def drain(source: DataFrame, p: Staging, cursors: list[str], featurize: Featurize, blocking: Blocking | list[Blocking], tiers: list[Scoring], index: VersionedTable, marks: Watermarks, run_id: str, lock: Lock | None = None, most: int | None = None, tf: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Batches until the source has nothing beyond the watermark, or `most` of them; their number.
    A batch holds all rows of its last cursor values, so that none is left behind the watermark."""
    n, mark = 0, marks.read(p.source_name)
    while most is None or n < most:
        # What a grace period reads again comes with the first batch only.
        now = replace(p, watermark=mark, cursors=tuple(cursors), grace_period_hours=p.grace_period_hours if n == 0 else 0, full_refresh=p.full_refresh and n == 0, passthrough_columns=tuple(dict.fromkeys([*p.passthrough_columns, *cursors])))
        staged = materialize(stage(source, now))
        new = cursors_of(staged, cursors, mark if p.cursor_mode == "independent" else None)
        if not new:
            break
        version = index.version()
        after = resolve_batch(index.read(), featurize(staged), blocking, tiers, tf)
        if lock:
            lock.refresh()
        index.write(after, expected=version)
        n += 1
        if _order(new) > _order(mark):
            marks.write(p.source_name, new, run_id, lock)
            mark = new
        elif n > 1:
            break
    return n


def _order(mark: dict[str, object]) -> list[tuple]:
    return [(v is not None, v) for v in mark.values()]


def stream(source: DataFrame, featurize: Featurize, blocking: Blocking | list[Blocking], tiers: list[Scoring], index: VersionedTable, checkpoint: str):
    """A query over a streaming source that is staged already (entity_uid, source_name, ...). Each
    micro-batch makes a version of the index, which keeps the batch's number, so that a batch that is
    repeated after its version was written is skipped."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty() or (held := index.note()).isdigit() and int(held) >= batch_id:
            return
        version = index.version()
        index.write(resolve_batch(index.read(), featurize(batch), blocking, tiers), expected=version, note=str(batch_id))

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(source: DataFrame, mark: dict[str, object], hours: int) -> DataFrame:
    """Rows that a grace period reads again."""
    first = next(iter(mark))
    return source.where((F.col(first) <= F.lit(mark[first])) & (F.col(first) > F.lit(mark[first]) - F.expr(f"INTERVAL {int(hours)} HOURS")))
