"""Bounded, repeatable samples of labelled documents and the fold rule that keeps held-out rows out of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, texts


def fold(col: str, parts: int, held: int) -> Column:
    """Whether a document is held out: crc32 of doc_id as text, modulo parts, is `held`. A null doc_id is not."""
    return F.coalesce(F.pmod(crc32_text(col), F.lit(parts)) == held, F.lit(False))


def training_labels(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """(doc_id, y) of the training fold. Of labels that disagree on one doc_id the largest counts; other values and
    nulls are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~fold("doc_id", parts, held))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, y, text) -> one of each doc_id, with its largest text, from a task."""
    best: dict[int, tuple[int, str]] = {}
    for batch in batches:
        for i, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i not in best or text > best[i][1]:
                best[i] = y, text
    for i, (y, text) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([text])], names=["doc_id", "y", "text"])


def sampled(docs: DataFrame, picked: DataFrame, most: int, longest: int = 1 << 20) -> list[tuple[str, int]]:
    """(text, y) of at most `most` rows of picked, by a hash of the id so that the choice is repeatable, one text for each
    id (of several the largest) and none of more than `longest` characters: so the sample is bounded by most times longest.
    The ids are bounded as well, so they are broadcast. Rows that repeat an id are brought down to one in the tasks that
    read them: texts aren't shuffled."""
    few = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts(docs).filter(F.char_length("text") <= longest).join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")
    best: dict[int, tuple[str, int]] = {}
    for r in rows.mapInArrow(_largest, "doc_id long, y int, text string").collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], ("", r["y"])), (r["text"], r["y"]))
    return [best[i] for i in sorted(best)]
