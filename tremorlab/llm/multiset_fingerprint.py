"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A fingerprint is a wide vector, the sum over paragraphs of vectors hashed from them, each lane modulo
a power of two. Sums do not depend on order, and adding or subtracting a paragraph's vector inserts
or deletes it. The vector has two ranges: 4 lanes modulo 2**64 hashed from the whole paragraph, which
tell unequal multisets apart, and 256 lanes modulo 2**32 in which every run of four words of the paragraph,
each starting a word after the last, adds +1 or -1, as does a shorter paragraph as a whole; the inner product of two such ranges estimates how many runs two
documents share, which gives a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import map_lists

EXACT_LANES = 4
LIKE_LANES = 256
UNIT_WORDS = 4
#: Buckets of neighbouring ids; at least the number of shuffle partitions, at most this many.
MAX_BUCKETS = 8192


class MultisetHash:
    """A fingerprint that paragraphs can be added to and removed from."""

    __slots__ = ("exact", "like")

    def __init__(self) -> None:
        self.exact = np.zeros(EXACT_LANES, dtype=np.uint64)
        self.like = np.zeros(LIKE_LANES, dtype=np.uint32)

    def copy(self) -> MultisetHash:
        out = MultisetHash()
        out.exact[:], out.like[:] = self.exact, self.like
        return out

    def update(self, text: str, sign: int = 1) -> MultisetHash:
        """Insert (sign 1) or delete (sign -1) the paragraphs of a text."""
        exact, like = paragraph_sums(text)
        if sign > 0:
            self.exact += exact
            self.like += like
        else:
            self.exact -= exact
            self.like -= like
        return self

    def hexdigest(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.like.astype("<u4").tobytes().hex()

    def likeness(self, other: MultisetHash) -> float:
        """Estimated share of common runs: 2<a,b> / (<a,a> + <b,b>), within 0 and 1; equal fingerprints give 1."""
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.like, other.like):
            return 1.0
        a, b = self.like.view(np.int32).astype(np.float64), other.like.view(np.int32).astype(np.float64)
        size = a @ a + b @ b
        return float(min(1.0, max(0.0, 2.0 * (a @ b) / size))) if size else 0.0


def paragraphs(text: str) -> list[str]:
    """The non-empty stretches between line breaks."""
    return [p for p in text.split("\n") if p]


def paragraph_sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the paragraph vectors of a text."""
    parts = paragraphs(text)
    exact, like = np.zeros(EXACT_LANES, dtype=np.uint64), np.zeros(LIKE_LANES, dtype=np.uint32)
    if not parts:
        return exact, like
    whole = np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=8 * EXACT_LANES).digest() for p in parts), dtype="<u8")
    exact += whole.reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)
    x128, runs = xxhash.xxh3_128_digest, []
    for p in parts:
        words = p.encode().split()
        runs += [b" ".join(words[i : i + UNIT_WORDS]) for i in range(max(1, len(words) - UNIT_WORDS + 1))]
    for at in range(0, len(runs), 4096):
        part = runs[at : at + 4096]
        bits = np.unpackbits(np.frombuffer(b"".join([x128(r, seed) for r in part for seed in range(LIKE_LANES // 128)]), dtype=np.uint8).reshape(len(part), -1), axis=1)
        ones = bits.sum(axis=0, dtype=np.uint32)
        like += ones + ones - np.uint32(len(part))
    return exact, like


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/3) code points replaced by as many, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edited_hash(base: MultisetHash, text: str, following: str) -> tuple[str, MultisetHash]:
    """The edited text and its fingerprint, by deleting the paragraphs from the cut on and inserting the new ones."""
    new = edited(text, following)
    cut = text.rfind("\n", 0, len(text) - len(text) // 3) + 1
    return new, base.copy().update(text[cut:], -1).update(new[cut:])


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    """Increasing ids that split the table into ranges of about as many rows."""
    got = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    return sorted(set(got or []))


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next smaller id; the last one's is the first. Rows are dealt
    by id range, each range is walked in order by one task, and each range is also sent the first
    document of the range after it: the only shuffle moves each text once. Null texts count as empty.
    Rows with equal ids follow each other by text. Null ids come after all others. A lone document is
    its own next. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(rows.select("doc_id"), min(MAX_BUCKETS, 4 * parts)), dtype=np.int64)
    nulls = len(bounds) + 1  # the bucket of null ids; bucket 0 has the largest ids

    @F.pandas_udf("int")
    def rank(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="left"), dtype="int32")

    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(nulls)).otherwise(rank(F.coalesce("doc_id", F.lit(0)))))
    # one row a bucket, at most MAX_BUCKETS + 1
    firsts = {r["bucket"]: r["first"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    goes_to = {firsts[b]: before[b] for b in order}
    of_null = goes_to.get(None, -1)

    @F.pandas_udf("int")
    def halo(ids: pd.Series) -> pd.Series:
        return pd.Series([goes_to.get(i, -1) for i in ids.tolist()], dtype="int32")

    placed = placed.withColumn("to", F.when(F.col("doc_id").isNull(), F.lit(of_null)).otherwise(halo(F.coalesce("doc_id", F.lit(0)))))
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("halo"))
    both = F.array(own, F.struct(F.col("to").alias("b"), F.lit(1).alias("halo")))
    sent = (
        placed.withColumn("at", F.explode(F.when(F.col("to") < 0, F.array(own)).otherwise(both)))
        .select("at.b", "at.halo", "doc_id", "text")
        .repartition(parts, "b")
        .sortWithinPartitions("b", "halo", F.col("doc_id").desc_nulls_last(), "text")
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = None  # (id, text, hash) of the row that waits for its next
        for b in batches:
            out = []
            for is_halo, doc, text in zip(b["halo"], b["doc_id"], b["text"]):
                if held is None and is_halo:
                    continue
                h = MultisetHash().update(text)
                if held is not None:
                    was, before_text, hb = held
                    new, he = edited_hash(hb, before_text, text)
                    out.append((was, len(before_text), hashlib.sha256(new.encode()).hexdigest(), hb.hexdigest(), he.hexdigest(), hb.likeness(he), hb.likeness(h)))
                # the first halo row of a bucket is the next of its last row; further ones are not needed
                held = None if is_halo else (doc, text, h)
            if out:
                yield dict(zip(schema.names, zip(*out)))

    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])
    return map_lists(sent, run, schema)
