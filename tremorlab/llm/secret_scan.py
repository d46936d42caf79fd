"""Secret scan with corpus-wide ownership frequency.

Three base patterns give spans in each text. The value of every match is a candidate; candidate
hashes are aggregated over the whole corpus by distinct owners, repositories and texts. A value that
several owners hold, or many repositories with different texts, be they of one owner, is an example that was
copied around; one that few hold and that does not look like a placeholder is a live-looking credential, and
gets a further span of kind ``live``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import flag_by_bitmap, map_lists, materialize, typed

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough: such runs are maximal
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "live")

#: A value held by this many owners or more is a widely copied example.
WIDE_OWNERS = 3
#: So is one in this many repositories and this many different texts or more, whoever owns them; copies of one text count once.
WIDE_REPOS = 10
#: Bits of entropy a character and length that a live-looking value has at least.
LIVE_ENTROPY = 2.5
LIVE_LENGTH = 8
#: Parts of a value that mark a placeholder.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|change_me|your|dummy|sample|xxxx|redacted|password|secret|token|1234567", re.I)
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value), by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """Long and varied enough, and without the marks of a placeholder."""
    n = len(value)
    if n < LIVE_LENGTH or PLACEHOLDER.search(value):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LIVE_ENTROPY


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


CANDIDATE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("live", T.BooleanType())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """A row per input row: rid, doc_id, owner, text_key, counts, base digest, base spans and candidate values."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "values")}
            for text in b["text"]:
                text = text or ""
                spans = base_spans(text)
                kinds = Counter(k for _, k, _, _ in spans)
                for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds[i])
                out["base_sha256"].append(hashlib.sha256(joined([x[:3] for x in spans]).encode()).hexdigest())
                out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
                places = sorted({(at, e) for _, _, e, at in spans})
                out["values"].append([{"start": s, "end": e, "hash": xxhash.xxh3_128_digest(text[s:e]), "live": looks_live(text[s:e])} for s, e in places])
            yield {"doc_id": b["doc_id"], "owner": b["owner"], "text_key": b["text_key"], **out}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"))
    schema = typed(docs, id_col, owner=T.StringType(), text_key=T.LongType(), n_assign=T.LongType(), n_access=T.LongType(), n_hex=T.LongType(), base_sha256=T.StringType(), base=T.ArrayType(SPAN), values=T.ArrayType(CANDIDATE))
    return map_lists(rows, run, schema).withColumn("rid", F.monotonically_increasing_id())


def ownership(values: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_texts): distinct owners, repositories and texts of each candidate; each step combines before its shuffle."""
    by_repo = values.select("hash", "owner", "repo").distinct()
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    texts = values.select("hash", "text_key").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_texts"))
    return owners.join(texts, "hash")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live, text_key.

    A document is its own repository. Null texts are empty and have no spans; null owners count as one owner;
    null ids as one repository. Repeated rows count once for ownership and each get their spans. ``live`` is the array of
    (start, end) that ``spans`` lists as kind live, ``text_key`` the text's hash. An empty table gives an empty result.
    """
    base = materialize(candidates(docs, id_col, text_col, owner_col), "candidates")
    values = base.select("rid", "owner", "text_key", F.col("doc_id").alias("repo"), F.explode("values").alias("v")).select("rid", "owner", "repo", "text_key", "v.*")
    owned = ownership(values.where("live"))
    own = owned.where((F.col("n_owners") < wide_owners) & (F.least("n_repos", "n_texts") < wide_repos)).select("hash")
    live = values.where("live").join(own, "hash").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("live"))
    all_spans = F.array_sort(F.concat("base", F.transform("live", lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return (
        base.join(live, "rid", "left")
        .withColumn("live", F.coalesce("live", F.array().cast("array<struct<start:int,end:int>>")))
        .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size("live").cast("long").alias("n_live"), (F.size(F.filter("values", lambda v: v["live"])) - F.size("live")).cast("long").alias("n_copied"), "live", "text_key")
    )


def merged(spans: F.Column) -> F.Column:
    """Sorted (start, end) spans with those that overlap made one, so that each position is replaced once."""

    def step(acc: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The input with every live-looking value replaced by a fixed mark, overlapping ones by one mark; all rows, columns and other text stay."""
    of, text = docs.columns.index(id_col), docs.columns.index(text_col)
    found = scan_secrets(docs, id_col, text_col, owner_col).where("n_live > 0").select("doc_id", "text_key", "live")
    found = materialize(found, "live").dropDuplicates(["doc_id", "text_key"])
    # columns go by number inside, so that no name of the input can clash
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = flag_by_bitmap(rows.withColumn("key", F.xxhash64(F.coalesce(f"c{text}", F.lit("")))), found.select(F.col("text_key").alias("key")), "key", "unsure")
    both = rows.where("unsure").join(found, F.col(f"c{of}").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    # from the last span to the first, so that earlier positions stay valid
    t = F.aggregate(
        F.reverse(merged(F.col("live"))),
        F.col(f"c{text}"),
        lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit(REDACTED), F.substring(acc, s["end"] + 1, F.length(acc))),
    )
    columns = [f"c{i}" for i in range(len(docs.columns))]
    done = both.withColumn(f"c{text}", F.when(F.col("live").isNotNull(), t).otherwise(F.col(f"c{text}"))).select(columns)
    return rows.where("not unsure").select(columns).unionAll(done).toDF(*docs.columns)
