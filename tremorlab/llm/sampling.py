"""Bounded, repeatable samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlab.llm.common import fold_of, hash_share


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int, rows_per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, label) for up to ``rows_per_class`` rows of each class, chosen by a hash of the id, and each class's whole count.

    Null ids and labels are left out, as are the rows whose fold is ``held_out``; an id that repeats counts once, with its smallest label.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    # the hash threshold leaves about twice the rows wanted, whatever the table's size, so that the sort stays small
    share = {c: 2.0 * rows_per_class / max(counts.get(c, 0), 1) for c in (0, 1)}
    parts = [known.where((F.col("label") == c) & (hash_share("doc_id") < share[c])).orderBy(hash_share("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def texts_of(sample: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of a sample; its bounded ids are broadcast, so the documents are not shuffled. Of several texts of an id the least counts, a null only where it has no other."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
