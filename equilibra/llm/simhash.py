"""Near duplicates by 64-bit SimHash and pigeonhole blocks.

A text's fingerprint has a bit set where over half of its word shingles'
XXH64 hashes have it.  Equal fingerprints are one node from here on, however
many rows share them.  Two fingerprints that differ in at most ``max_bits``
bits agree on at least ``blocks - max_bits`` of ``blocks`` bit blocks, so each
node is keyed by every choice of that many blocks; pairs that share a key are
the candidates and are verified by their exact distance.

A key shared by more than ``crowd`` nodes is split instead of paired: all its
nodes agree on the key's bits, so the same pigeonhole argument applies to the
remaining bits with finer blocks, and again if need be.  The nodes are
distinct fingerprints, so a key that fixes f bits has at most 2^(64-f) nodes:
the last split fixes 57 bits or more, so 128 nodes at most.  No crowded key's
pairs are ever all emitted, none is dropped, and no group grows with the data.

Components come from ``components``; a row's component is the smallest doc_id
reachable.  Shuffled: per distinct fingerprint, 20 keys of 24 bytes.

Defined results: null or wordless texts have fingerprint 0 and link like any
other; repeated rows share their node; a null doc_id takes part, but no
component is named by it unless it holds nothing else; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilibra.llm.common import add_columns, fresh
from equilibra.llm.components import components
from equilibra.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCKS = 6
CROWD = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = regex.compile(rb"[^\x20\x09-\x0D]+")
STEP = 1 << 16  # shingles counted at a time


def words(text: str | None) -> list[bytes]:
    return _SPACES.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    ws = words(text)
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        end = min(n, at + STEP)
        if n == 1:
            hashes = [digest(b" ".join(ws), SEED)]
        else:
            hashes = [digest(b" ".join(w), SEED) for w in zip(*(ws[at + j:end + j] for j in range(shingle)))]
        h = np.array(hashes, dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Append the signed 64-bit fingerprint of every whole text."""
    return add_columns(df, text_col, f"`{out}` bigint", lambda texts: [[fingerprint(t, shingle) for t in texts]])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: list[int], blocks: int, chosen: int) -> list[int]:
    """Masks of every choice of ``chosen`` of ``blocks`` near-equal runs of ``bits``."""
    edge = [len(bits) * i // blocks for i in range(blocks + 1)]
    run = [sum(1 << b for b in bits[edge[i]:edge[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(run, chosen)]


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask, key): a row per node and mask."""
    return nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    left, right = keyed.select("mask", "key", F.col("fp").alias("a")), keyed.select("mask", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, ["mask", "key"]).where((F.col("a") > F.col("b")) & near).select("a", "b").distinct()


def _split(crowded: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """Key crowded nodes again by finer blocks of the bits their key leaves open."""
    parts = None
    out = []
    for mask in [r.mask for r in crowded.select("mask").distinct().collect()]:  # a fixed list of masks, not data
        open_bits = [b for b in range(64) if not (mask >> b) & 1]
        finer = [(mask & ((1 << 64) - 1)) | m for m in _masks(open_bits, blocks, blocks - max_bits)]
        out.append((mask, [_signed(m) for m in finer]))
    if not out:
        return crowded
    spark = crowded.sparkSession
    parts = spark.createDataFrame(out, "mask bigint, finer array<bigint>")
    return (crowded.join(F.broadcast(parts), "mask").select("fp", F.explode("finer").alias("mask"))
            .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct())


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Verified links (a > b) among distinct fingerprints ``fp``: every pair, but of a crowded key's
    pairs those that finer keys bring together (each pair within ``max_bits`` has such a key)."""
    cur = _keyed(nodes, _masks(list(range(64)), blocks, blocks - max_bits))
    links = None
    for finer in (8, 8, 0):
        sizes = cur.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        held = cut_lineage(cur.join(sizes, ["mask", "key"]))
        small = held.where(F.col("n") <= crowd) if finer else held
        part = cut_lineage(_links(small, max_bits))
        links = part if links is None else links.union(part)
        crowded = held.where(F.col("n") > crowd).select("fp", "mask")
        if not finer or crowded.isEmpty():
            break
        cur = _split(crowded, finer, max_bits)
    return links.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = cut_lineage(fingerprints(rows, "text", "fp", shingle).select("doc_id", "text_hash", "fp"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes.select("fp"), max_bits, blocks, crowd))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(label, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` with one row left of each component: that of its smallest doc_id (nulls last; of
    rows that share it the smallest text hash, of equal rows one)."""
    found = near_duplicates(df, id_col, text_col, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")
    kept = found.groupBy("root").agg(first).select(F.col("f.doc_id").alias("_k"), F.col("f.text_hash").alias("_t")).distinct()
    tag = fresh(df, "text_hash")
    rows = df.withColumn(tag, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_k")) & (F.col(tag) == F.col("_t"))
    return rows.join(kept, same).dropDuplicates([id_col, tag]).select(*df.columns)


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
