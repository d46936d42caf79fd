"""SimHash near-duplicates found with vantage-point trees over Hamming distance.

Two fingerprints that differ in at most three bits differ in at most one bit of their low or of
their high 32 bits. For either half a vantage-point tree partitions the distinct fingerprints by
the Hamming distance of that half to vantage points. At a node with radius mu, points at distance
mu or less go inside, others outside, and outside points in the boundary shell (mu, mu + 1] go inside
as well: by the triangle inequality every pair within one bit then meets in some leaf. Leaves are
shards; each is searched exactly, by further vantage points while that divides it and then by
comparing all 64 bits. Any choice of vantage points gives the same result; the sample that
they are fitted on only balances the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import Scratch, flag_by_bitmap, hash_share, map_lists, materialize, text_or_empty, typed
from tremorlab.llm.components import connected_components

BITS = 3
SHELL = 1
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
#: Fingerprints that the trees are fitted on, and the share of the data a shard should hold.
SAMPLE = 32768
SHARD_ROWS = 4000
MAX_DEPTH = 12
#: Shards above this many rows, 16 MB, are searched as pairs of blocks, each pair a group of its own. The trees have 4096 leaves a half at
#: most, so up to some billions of fingerprints a shard is one group, which ``search`` divides further in memory.
BLOCK_ROWS = 1 << 21
#: A fingerprint with over 1/FREQUENT of the rows has its component broadcast; there are fewer than FREQUENT of these.
FREQUENT = 4096
#: In memory, sets above this size are divided further before all pairs are compared.
DIRECT = 1024


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 3-word shingles; zero where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [xx(b" ".join(words), 42)]
    else:
        hashes = [xx(b"%b %b %b" % w, 42) for w in zip(words, words[1:], words[2:])]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 32768):
        part = h[i : i + 32768]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): the text's hash, null counting as empty, and the fingerprint as a signed long."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield {"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": fp}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return map_lists(rows, run, typed(docs, id_col, text_key=T.LongType(), fp=T.LongType()))


def _vantage(points: np.ndarray, mask: np.uint64, tries: int = 8) -> tuple[np.uint64, int, np.ndarray]:
    """The vantage point and radius, of a few candidates, that leave the smallest larger side; with the distances."""
    best = None
    for vp in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = np.bitwise_count((points ^ vp) & mask)
        mu = int(np.median(d))
        for m in (mu - 1, mu):
            cost = max(np.count_nonzero(d <= m + SHELL), np.count_nonzero(d > m))
            if best is None or cost < best[0]:
                best = (cost, vp, m, d)
    return best[1], best[2], best[3]


def build_tree(points: np.ndarray, mask: int, leaf_rows: int) -> list[tuple]:
    """Nodes (vantage point, mu, inside, outside); a leaf is (None, shard number, 0, 0)."""
    nodes: list[tuple] = []
    m = np.uint64(mask)
    leaves = 0

    def grow(pts: np.ndarray, depth: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        if len(pts) > leaf_rows and depth < MAX_DEPTH:
            vp, mu, d = _vantage(pts, m)
            inside, outside = pts[d <= mu], pts[d > mu]
            if len(inside) and len(outside):
                nodes[at] = (int(vp), mu, grow(inside, depth + 1), grow(outside, depth + 1))
                return at
        nodes[at] = (None, leaves, 0, 0)
        leaves += 1
        return at

    grow(points, 0)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and shard numbers: each row's own shard and those whose boundary shell it lies in."""
    rows, shards = [], []
    todo = [(0, np.arange(len(fps)))]
    m = np.uint64(mask)
    while todo:
        at, idx = todo.pop()
        vp, mu, inside, outside = nodes[at]
        if vp is None:
            rows.append(idx)
            shards.append(np.full(len(idx), mu, dtype=np.int32))
            continue
        d = np.bitwise_count((fps[idx] ^ np.uint64(vp)) & m)
        todo += [(a, i) for a, i in ((inside, idx[d <= mu + SHELL]), (outside, idx[d > mu])) if len(i)]
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(shards or [np.zeros(0, np.int32)])


def _direct(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (point, root) of the links among distinct fingerprints, by comparing all pairs block by block."""
    step = max(1, (1 << 22) // max(len(f), 1))
    busy = np.concatenate([(np.bitwise_count(f[i : i + step, None] ^ f[None, :]) <= BITS).sum(axis=1) > 1 for i in range(0, len(f), step)] or [np.zeros(0, bool)])
    left = f[busy]
    a, b = [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 22) // len(left))
            near = np.zeros(len(left), dtype=bool)
            for i in range(0, len(front), step):
                near |= (np.bitwise_count(front[i : i + step, None] ^ left[None, :]) <= BITS).any(axis=0)
            front, left = left[near], left[~near]
            a.append(front)
            b.append(np.full(len(front), root))
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def search(f: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges whose components are those of all links within ``f`` that the half's bound keeps together."""
    out, todo, m = [], [np.unique(f)], np.uint64(mask)
    while todo:
        pts = todo.pop()
        if len(pts) > DIRECT:
            vp, mu, d = _vantage(pts, m)
            inside, outside = pts[d <= mu + SHELL], pts[d > mu]
            if max(len(inside), len(outside)) <= 0.8 * len(pts):
                todo += [inside, outside]
                continue
        out.append(_direct(pts))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) whose components are those of all links within BITS bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    # about SAMPLE rows, drawn by a hash: neither the rows nor the driver's share grow with the data
    drawn = distinct.where(hash_share("fp") < SAMPLE / max(n, 1)).select("fp").collect()
    sample = np.sort(np.array([r[0] for r in drawn], dtype=np.int64)).view(np.uint64)
    leaf = max(8, int(SHARD_ROWS * len(sample) / max(n, 1)))
    trees = [(mask, build_tree(sample, mask, leaf)) for mask in HALVES]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for half, (mask, nodes) in enumerate(trees):
                rows, shards = route(f, nodes, mask)
                yield pd.DataFrame({"shard": shards * 2 + half, "fp": f[rows].view(np.int64)})

    placed = materialize(distinct.select("fp").mapInPandas(place, "shard int, fp long"), "shards")
    # one row a shard, and no more shards than the trees have leaves
    sizes = {r["shard"]: -(-r["count"] // (BLOCK_ROWS // 2)) for r in placed.groupBy("shard").count().where(F.col("count") > BLOCK_ROWS).collect()}
    blocks = F.lit(1)
    for shard, b in sizes.items():
        blocks = F.when(F.col("shard") == shard, F.lit(b)).otherwise(blocks)
    dealt = (
        placed.withColumn("b", blocks.cast("int"))
        .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("b")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        .select("shard", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    )

    def find(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b = search(g["fp"].to_numpy(dtype=np.int64).view(np.uint64), HALVES[int(key[0]) % 2])
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return dealt.groupBy("shard", "i", "j").applyInPandas(find, "src long, dst long")


def _components(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, n, component) over the distinct fingerprints of ``prints``; n is the number of rows."""
    distinct = scratch.table(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct")
    members = connected_components(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    return scratch.table(distinct.join(members, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component")), "components")


def _with_component(prints: DataFrame, of: DataFrame, *more: str) -> DataFrame:
    """``prints`` with what ``of`` (fp, n, more) has of their fingerprints; frequent ones are decided on the map side."""
    rows = of.agg(F.sum("n")).first()[0] or 0
    of = of.withColumn("often", F.col("n") * FREQUENT > rows)
    often = F.broadcast(of.where("often").select("fp", *more))
    rare = prints.join(often.select("fp"), "fp", "left_anti").join(of.where("not often").select("fp", *more), "fp", "left")
    return prints.join(often, "fp").unionByName(rare)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Texts without a word have fingerprint zero, null counts as empty, and both link like any other.
    Equal fingerprints are joined before any search, so copies cost one row each. A component's id is its smallest doc_id; null ids never are it
    unless a component has no other. Other columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col).drop("text_key"), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        groups = _components(prints, scratch)
        least = prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(groups, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
        of = materialize(groups.join(least, "component").select("fp", "n", "component_id"), "component-ids")
    return _with_component(prints, of, "component_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: that of the smallest id, then of the smallest hash of its text.

    A document is an id with a text: rows that repeat both are one document, different texts under one id or under none are
    several. Null texts count as empty, as in their fingerprint; null ids come after all others. Columns may have any
    names. Only the rows that a bitmap of fixed size cannot clear are shuffled. An empty table gives an empty result.
    """
    of, text = docs.columns.index(id_col), docs.columns.index(text_col)
    # columns go by number inside, so that no name of the input can clash
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = rows.withColumns({"doc_id": F.col(f"c{of}"), "text_key": F.xxhash64(text_or_empty(f"c{text}"))})
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.table(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id"), "fingerprints")
        groups = _components(prints, scratch)
        each = _with_component(prints, groups, "component").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
        each = scratch.table(each, "identities")
        first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("members"))
        # components of one document that occurs once need no decision
        odd = each.join(first.where("members > 1"), "component", "left").where("members > 1 or times > 1")
        stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
        odd = materialize(odd.select("doc_id", "text_key", "times", stays.alias("stays")), "odd-identities")
    flagged = flag_by_bitmap(rows, odd.select("text_key"), "text_key", "unsure")
    same = flagged["doc_id"].eqNullSafe(odd["doc_id"]) & (flagged["text_key"] == odd["text_key"])
    columns = [f"c{i}" for i in range(len(docs.columns))]
    clear = flagged.where("not unsure").select(columns)
    other = flagged.where("unsure").join(odd, same, "left_anti").select(columns)
    once = flagged.where("unsure").join(odd.where("stays and times = 1"), same, "left_semi").select(columns)
    repeated = flagged.where("unsure").join(odd.where("stays and times > 1"), same, "left_semi").dropDuplicates(["doc_id", "text_key"]).select(columns)
    return clear.unionAll(other).unionAll(once).unionAll(repeated).toDF(*docs.columns)
