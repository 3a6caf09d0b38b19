"""Best-fit packing in bulk-synchronous rounds.

Documents become token ids plus an end id and are cut into pieces of at most
``capacity`` tokens; the pieces are then packed into sequences, each round
giving pieces to the sequences where they fit best.

Pieces of one length are interchangeable, and so are sequences with the same
gap.  The rounds therefore move *runs*: (length, first rank, count) of pieces
still to be placed and (gap, first sequence, count) of open sequences.  A round
range-sorts both by size and deals ranges of sizes to tasks; each task sweeps
its range from large to small.  A piece's successor is the smallest gap that
holds it; where several pieces want one gap the ranks decide, in whole runs: the
first ranks get it, the others the next larger gap.  A gap shrinks by what it
got, and what is left of it takes part again at its new size.  Pieces and gaps
that found no partner in their range meet in the next round, whose ranges are
``MERGE`` times as wide, until one range holds all sizes: then no piece fits
any gap.  New sequences are opened for the rest, as many as it needs at least
(its tokens by capacity, or its pieces longer than half), and the rounds repeat.

Run tables have at most a few rows per size, so they are bounded by the capacity
whatever the corpus.  The corpus itself is read once (tokens), kept as slim rows
in the shared folder, numbered by (length, hash bucket) so that a length shared
by a third of all pieces is no single task, and joined with the runs' places.

Token ids equal those of the ``tokenizers`` library.  Chunks between ASCII white
space are independent for this vocabulary, so each worker remembers the ids of
the chunks and words it met (bounded); chunks of letters whose normal form is
beyond doubt go to the library's model word by word, all others to the whole
library.

Defined results: a null or empty text is one piece that holds the end id; a
null id and repeated rows are pieces like any other (equal rows may swap
places); long texts are cut, nothing else is; an empty table packs to no rows;
extra columns pass through :func:`pack`, a taken output name raises ValueError.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from equilibra.llm.common import SLICE, once
from equilibra.session import cut_lineage

CAPACITY = 2048
END_ID = 0
RANGE = 256         # sizes of a task's range in the first round
MERGE = 8           # ranges grow by this factor from round to round
RANK_ROWS = 100_000  # pieces numbered together
BROADCAST_RUNS = 100_000
MEMORY = 300_000    # chunks, and words, that a worker remembers per generation

# ---- tokens ----

# printable ASCII and Latin letters: composed as they are, lower-cased one by one, no white space
_PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are
    themselves, the others the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Words:
    """The ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.memory = memory
        self.chunks: tuple[dict, dict] = ({}, {})
        self.words: tuple[dict, dict] = ({}, {})

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not _PLAIN.fullmatch(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        young, old = self.words
        out = []
        for word in _WORDS.findall(text.lower()):
            got = young.get(word)
            if got is None:
                got = old.get(word)
                if got is None:
                    got = self._word(word)
                if len(young) >= self.memory:
                    self.words = young, old = {}, young
                young[word] = got
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        out, (young, old) = [], self.chunks
        for chunk in text.encode().split():
            got = young.get(chunk)
            if got is None:
                got = old.get(chunk)
                if got is None:
                    got = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(young) >= self.memory:
                        self.chunks = young, old = {}, young
                    young[chunk] = got
            out.append(got)
        return b"".join(out)


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
              with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    end = struct.pack("<I", end_id)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(
        "piece int, start bigint, length int, ids_crc32 bigint" + (", ids binary" if with_ids else ""))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once("word ids", path, lambda: Words(path))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = words.ids(text or "") + end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start:start + 4 * capacity]
                        rows.append((key, k, start // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- rounds ----

_RUN = "kind string, size int, first bigint, n bigint, seq bigint, each int"
PIECES, GAPS, PLACED = "pieces", "gaps", "placed"


def sweep(rows: list[tuple], low: int) -> list[tuple]:
    """One range, from its largest size down to ``low``: the runs that are left and the places found.

    Rows are (kind, size, first, n, seq, each): pieces of length ``size`` with ranks from ``first``; gaps of
    ``size`` tokens in ``n`` sequences from ``seq``; or places: piece ``first + i`` goes to sequence
    ``seq + i // each``, behind those of its run that came before, in a gap that had ``size`` tokens.
    """
    pieces, gaps = defaultdict(list), defaultdict(list)
    for kind, size, first, n, seq, _ in sorted(rows, key=lambda r: (r[1], r[2] or 0, r[4] or 0)):
        if kind == PIECES:
            pieces[size].append((first, n))
        else:
            gaps[size].append((seq, n))
    out, free = [], []  # free: open gaps of the sizes met, the smallest last
    for size in range(max([*pieces, *gaps], default=0), low - 1, -1):
        free += [(size, seq, n) for seq, n in reversed(gaps.pop(size, []))]
        for first, n in pieces.pop(size, []):
            while n and free:
                gap, seq, m = free.pop()
                each = gap // size
                full = min(m, n // each)
                if full:      # sequences that get as many pieces as go in
                    out.append((PLACED, gap, first, full * each, seq, each, size))
                    first, n = first + full * each, n - full * each
                    if gap % size:
                        gaps[gap % size].append((seq, full))
                    if full < m:
                        free.append((gap, seq + full, m - full))
                else:         # the last pieces of the run, in one sequence
                    out.append((PLACED, gap, first, n, seq, n, size))
                    if m > 1:
                        free.append((gap, seq + 1, m - 1))
                    rest = gap - n * size
                    if rest >= size:
                        free.append((rest, seq, 1))
                    elif rest:
                        gaps[rest].append((seq, 1))
                    n = 0
            if n:
                out.append((PIECES, size, first, n, None, None, None))
    out += [(GAPS, size, None, n, seq, None, None) for size, seq, n in free]
    out += [(GAPS, size, None, n, seq, None, None) for size, runs in gaps.items() for seq, n in runs]
    return out


def _round(runs: DataFrame, width: int) -> DataFrame:
    """One round: every range of ``width`` sizes swept by its own task."""
    schema = StructType.fromDDL(_RUN + ", length int")
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*[c.to_pylist() for c in table.select(["kind", "size", "first", "n", "seq", "each"]).columns]))
        low = (rows[0][1] - 1) // width * width + 1
        found = sweep(rows, low)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    return cut_lineage(runs.groupBy(F.floor((F.col("size") - 1) / width).alias("range")).applyInArrow(run, schema))


def places(lengths: DataFrame, capacity: int = CAPACITY) -> tuple[list[DataFrame], int]:
    """The places of all pieces from the counts (length, n), and the number of sequences."""
    spark = lengths.sparkSession
    runs = lengths.select(F.lit(PIECES).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("bigint").alias("first"),
                          F.col("n").cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("each"))
    state, found, opened = cut_lineage(runs), [], 0
    left = state
    while True:
        need = left.agg(F.sum(F.col("size") * F.col("n")).alias("tokens"),
                        F.sum(F.when(F.col("size") * 2 > capacity, F.col("n")).otherwise(0)).alias("long")).first()
        if need.tokens is None:
            return found, opened
        new = max(-(-need.tokens // capacity), need.long)
        fresh_gaps = spark.createDataFrame([(GAPS, capacity, None, new, opened, None)], _RUN)
        state, opened, width = state.unionByName(fresh_gaps), opened + new, RANGE
        while True:
            swept = _round(state, width)
            found.append(swept.where(F.col("kind") == PLACED))
            state = swept.where(F.col("kind") != PLACED).drop("length")
            if width >= capacity:
                break
            width *= MERGE
        left = state.where(F.col("kind") == PIECES)


def _numbered(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every piece with its rank from 0 among those of its length."""
    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    share = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    per = lengths.select(F.col("length").alias("_l"), F.ceil(F.col("n") / RANK_ROWS).cast("int").alias("_buckets"))
    dealt = pieces.join(F.broadcast(per), F.col("length") == F.col("_l")).withColumn(  # a row per length at most
        "_bucket", F.floor(share * F.col("_buckets")).cast("int")).drop("_l", "_buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    below = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("length", "_bucket").orderBy(key, "doc_id", "piece", "start", "ids_crc32")
    local = dealt.withColumn("_rn", F.row_number().over(inside) - 1)
    return local.join(offsets, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "_rank", F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_l", "_b", "_bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start, length (1 to ``capacity``) and ids_crc32."""
    taken = {c.lower() for c in pieces.columns} & {"sequence_id", "offset"}
    if taken:
        raise ValueError(f"columns already present: {sorted(taken)}")
    kept = cut_lineage(pieces)
    lengths = cut_lineage(kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    found, _ = places(lengths, capacity)
    if not found:
        return kept.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    runs = cut_lineage(runs.select(F.col("length").alias("_length"), "size", "first", "n", "seq", "each"))
    runs = F.broadcast(runs) if runs.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS else runs
    place = F.col("_rank") - F.col("first")
    hit = (F.col("length") == F.col("_length")) & (place >= 0) & (place < F.col("n"))
    return _numbered(kept, lengths).join(runs, hit).select(
        *pieces.columns, (F.col("seq") + F.floor(place / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.lit(capacity) - F.col("size") + F.pmod(place, F.col("each")) * F.col("length")).cast("bigint").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids, from rows with sequence_id, offset and ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most the capacity in tokens
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(tokenised(docs, path, capacity, end_id), capacity)
