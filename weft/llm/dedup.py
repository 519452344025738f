"""Exact dedup of texts by a 128-bit content hash, with a comparison of bytes inside groups.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Rows are
counted by hash (pre-aggregated before the shuffle, so a group of any size is one small row);
the text of the row that stays is compared with that of every other row of its group.  A row
that differs, a collision, is grouped anew by its full text.

Repeated rows: rows that share a doc_id share their result, so all copies of the row that
stays are marked kept.  A null doc_id is smaller than any other.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.common import Rows, Scratch, begin, text_bytes


def digests(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, h (128 bits, of the normalised text), text_sha256; with ``keep_text`` also norm."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    extra = ["norm"] if keep_text else ["text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("dedup")
        for batch in batches:
            norm = [t.lower() for t in text_bytes(batch.column("text"))]  # bytes.lower: A-Z only
            last = pa.array(norm, pa.binary()) if keep_text else pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())
            h = pa.array([hashlib.md5(t).digest() for t in norm], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), h, last], ["doc_id", "h", *extra])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, h binary, {'norm binary' if keep_text else 'text_sha256 string'}")


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``documents``."""
    with Scratch(documents.sparkSession) as scratch:
        return _groups(documents, scratch)


def _groups(documents: DataFrame, scratch: Scratch) -> DataFrame:
    rows = scratch.write(digests(documents), "digests", keep=True)
    groups = scratch.write(rows.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")), "groups", keep=True)
    # the texts of groups of several rows; each is compared with that of the row that stays
    several = groups.where("n > 1")
    texts = digests(documents, keep_text=True).join(several.hint("merge"), "h")
    texts = scratch.write(texts.select("doc_id", "h", "norm", "keep"), "texts")
    stay = texts.where(F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("h").agg(F.min(F.struct(F.length("norm").alias("k"), "norm")).alias("m"))
    stay = scratch.write(stay.select("h", F.col("m.norm").alias("first")), "stay")
    odd = texts.join(stay.hint("merge"), "h").where(~F.col("norm").eqNullSafe(F.col("first")))
    odd = scratch.write(odd.select("doc_id", "h", "norm"), "collisions")
    if odd.isEmpty():
        joined = rows.join(groups.hint("merge"), "h")
    else:
        joined = _apart(documents, rows, groups, scratch.write(odd.select("h").distinct(), "shared", keep=True))
    kept = F.col("doc_id").eqNullSafe(F.col("keep"))
    return joined.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def _apart(documents: DataFrame, rows: DataFrame, groups: DataFrame, shared: DataFrame) -> DataFrame:
    """Groups for hashes that several texts share: by hash and full text."""
    by_text = digests(documents, keep_text=True).join(shared.hint("merge"), "h", "left_semi")
    by_text = by_text.join(by_text.groupBy("h", "norm").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")), ["h", "norm"])
    by_text = by_text.select("doc_id", "n", "keep", F.sha2("norm", 256).alias("text_sha256"))
    rest = rows.join(shared.hint("merge"), "h", "left_anti").join(groups.hint("merge"), "h")
    return rest.select("doc_id", "n", "keep", "text_sha256").unionByName(by_text)


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, one row of each text: of equal texts one with the
    largest doc_id (a null one is smaller than any other), of rows that share that as well the
    first.  Decisions go by row, so a null or shared doc_id drops no row with another text."""
    with Scratch(documents.sparkSession) as scratch:
        rows = Rows(documents, scratch)
        keys = F.struct(rows.column("doc_id").alias("id"), F.negate("row").alias("r")).alias("doc_id")
        decided = exact_groups(rows.table.select(keys, rows.column("text").alias("text")))
        return rows.without(decided.where(~F.col("kept")).select((-F.col("doc_id.r")).alias("row")))
