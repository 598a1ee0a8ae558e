"""Merging visits as they arrive: a file stream into a publication."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from histmerge.functions.keys import VISIT_KEY
from histmerge.operators.checks import ValidationError, orphan_visits
from histmerge.operators.facts import merge_facts
from histmerge.operators.measure import Asked, Measured, measure
from histmerge.sources.publish import Publication, TableState
from histmerge.sources.schema import VISITS, refuse_nulls
from histmerge.workspace import Workspace


def merge_arriving_visits(
    arriving: DataFrame,
    target: Publication,
    place_ids: DataFrame,
    checkpoint: str,
    stream_id: str,
    **trigger: object,
) -> StreamingQuery:
    """Start a query that merges each batch of a visit stream into ``target``.

    Every batch follows the rules of a batch merge against the published
    visits; a batch that is replayed after a failure, or read again after the
    checkpoint was lost, finds its visits there and adds nothing, whatever
    number it has. No state or watermark: what was seen before is the published
    table. A batch that breaks the declared contract, or brings a visit without
    a published place (where places are published), stops the stream unpublished.

    A batch reads published visits of its own dates' parts only, and takes the
    row count and the largest id from the published state, so its cost follows
    the batch and not the history.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        work = Workspace(target.spark, f"{stream_id}-{number}")
        required = {f.name: F.count_if(F.col(f.name).isNull()) for f in VISITS if not f.nullable}
        arrived, nulls = work.keep_observed(batch, "arrived", **required)
        refuse_nulls(nulls, "arriving visits")
        here = measure({"arrived": Asked(arrived, VISIT_KEY, between="visit_date")})["arrived"]
        if not here.rows:
            return
        with target.claimed(f"{work.run_id}-{uuid.uuid4().hex[:8]}") as writer:
            state = target.state()
            held = state.get("visits", TableState())
            merged = merge_facts(
                arrived,
                target.read("visits"),
                VISIT_KEY,
                work,
                id_maps={"place_id": place_ids},
                between="visit_date",
                name="visits",
                known=(here, Measured(rows=held.rows, largest_id=held.largest_id)),
                within=partial(target.read_between, "visits"),
            )
            new, nulls = work.keep_observed(merged.inserted, "new-visits", **required, rows=F.count(F.lit(1)))
            rows = nulls.pop("rows")
            if not rows:
                return
            refuse_nulls(nulls, "new visits")
            if "places" in state:
                orphans = orphan_visits(new, target.read("places")).first()["orphans"]
                if orphans:
                    raise ValidationError(f"{orphans} arriving visits belong to no place")
            after = TableState(held.rows + rows, held.largest_id + rows)
            target.publish({"visits": new}, {"visits": after}, writer)

    writer = arriving.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
