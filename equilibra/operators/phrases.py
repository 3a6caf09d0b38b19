"""Phrases of a table in texts: longest-match rewriting (T4, S8) and vectors of terms.

A table of a checked size (``SMALL_TABLE`` phrases, ``SMALL_BYTES``) is sent to
the tasks, which read the texts once without a shuffle.  Beyond it texts are
dealt to blocks of about 8 MB, as in pooling.  The hashes of a block's word
runs, of the lengths that the table holds, are joined to the table once; the
block then works with its own part of it (a phrase brought by an equal hash
matches nothing).  Before they are shuffled, runs pass a bitmap of the table's
hashes (at most ``FILTER_BITS`` bits whatever the table's size; a run that it
lets through for nothing finds no partner in the join).  A phrase found in every
text crosses the network once per block, and such a table is never held whole.
Both ways give the same rows.  Words are what single spaces separate; matching
ignores case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .embeddings import CHUNKS_TOGETHER, NamedVectors, block_counts, pooling_blocks, text_bytes

_Prepare = Callable[[pa.ChunkedArray, pa.ChunkedArray], object]
_Found = Callable[[pa.RecordBatch, object], tuple[Sequence[int], list[pa.Array]]]
BLOCK_BYTES = 8 << 20   # text of a block: it is held as it is, in lower case and rewritten
SMALL_TABLE = 200_000   # phrases
SMALL_BYTES = 16 << 20  # of phrases and targets
FILTER_BITS = 27        # the bitmap has at most 2^27 bits (16 MB)
SEGMENT = 1 << 15       # bits of one row of Spark's bitmap aggregate
SPAN_BLOCK_BYTES = 1 << 20  # text whose spans and token vectors meet in one task
NAME_BLOCK_BYTES = 8 << 20  # text whose spans and named tokens meet in one task
SPANS_TOGETHER = 20_000     # spans whose vectors are held at once
RUN_ROWS = 500              # texts whose runs of words are hashed together


def lexicon_table(lexicon: DataFrame, source: str = "from_term", target: str = "to_term", order: str = "line_no") -> DataFrame:
    """(phrase, target): lower case, the first listed target of a phrase; null and empty phrases take no part."""
    rows = lexicon.select(F.lower(source).alias("phrase"), F.coalesce(F.col(target), F.lit("")).alias("target"), F.col(order).alias("_o"))
    first = F.min(F.struct("_o", "target"))["target"]  # a rank given twice: the smaller target
    return rows.filter(F.length("phrase") > 0).groupBy("phrase").agg(first.alias("target"))


def _word_hashes(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), " "), lambda w: F.xxhash64(w))


def _run_hasher() -> Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """A function of (word hashes, row of each word, length): the hash and the row of every run of that length."""
    factor = np.uint64(0x9E3779B97F4A7C15)  # odd: no run of word hashes loses a bit

    def run(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        many = max(0, len(words) - n + 1)
        h = words[:many].copy()
        for j in range(1, n):
            h = h * factor + words[j:j + many]
        inside = row[:many] == row[len(words) - many:]  # a run ends in the text where it starts
        return h[inside], row[:many][inside]

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column without nulls."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(lists)), sizes)


def _with_hash(phrases: DataFrame) -> DataFrame:
    """(phrase, target, _h): the hash of the run of words that the phrase is."""
    hasher, flat = _run_hasher(), _flat

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = flat(b.column("_w"))
            h = np.zeros(b.num_rows, dtype=np.uint64)
            sizes = np.bincount(row, minlength=b.num_rows)
            for n in np.unique(sizes):
                of_size = (sizes == n)[row]
                found, at = hasher(words[of_size], row[of_size], int(n))
                h[at] = found
            yield pa.RecordBatch.from_arrays([b.column("phrase"), b.column("target"), pa.array(h.view(np.int64))],
                                             names=["phrase", "target", "_h"])

    return phrases.select("phrase", "target", _word_hashes(F.col("phrase")).alias("_w")).mapInArrow(
        work, "phrase string, target string, _h bigint")


def _bitmap(hashed: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(bytes, log2 of the bits): the leading bits of the hashes of the table's ``n`` phrases."""
    log = min(FILTER_BITS, max(15, (16 * n).bit_length()))
    place = F.shiftrightunsigned("_h", 64 - log) + 1  # Spark's bitmaps count from 1
    rows = hashed.select(F.bitmap_bucket_number(place).alias("_s"), F.bitmap_bit_position(place).alias("_p")).groupBy("_s").agg(
        F.bitmap_construct_agg("_p").alias("_b")).collect()  # at most 2^FILTER_BITS / SEGMENT rows of 4 KB
    bits = np.zeros((1 << log) // 8, dtype=np.uint8)
    for r in rows:
        at = (r["_s"] - 1) * (SEGMENT // 8)
        bits[at:at + SEGMENT // 8] = np.frombuffer(bytes(r["_b"]), dtype=np.uint8)[:SEGMENT // 8]
    return bits, log


def _known_runs(texts: DataFrame, text: str, hashed: DataFrame, n: int, lengths: Sequence[int]) -> DataFrame:
    """(_used, phrase, target): the phrases of the table that each block (``_block``) may hold."""
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(hashed, n))
    hasher, flat, lengths = _run_hasher(), _flat, list(lengths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, log = sent.value
        for b in (whole.slice(i, RUN_ROWS) for whole in batches for i in range(0, whole.num_rows, RUN_ROWS)):
            words, row = flat(b.column("_w"))
            blocks = b.column("_block").to_numpy()
            for size in lengths:
                h, at = hasher(words, row, size)
                place = h >> np.uint64(64 - log)
                hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                pair = np.unique(np.stack([blocks[at[hit]], h[hit].view(np.int64)]), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["_used", "_h"])

    runs = texts.filter(F.col(text).isNotNull()).select("_block", _word_hashes(F.col(text)).alias("_w")).mapInArrow(
        work, "_used bigint, _h bigint").distinct()
    return runs.join(hashed, "_h").drop("_h")


def _by_block(docs: DataFrame, phrases: DataFrame, keys: Sequence[str], text: str, prepare: _Prepare, found: _Found, out: StructType,
              block_bytes: int, small: int) -> DataFrame:
    """Run ``found(texts, prepare(phrases, targets))`` on batches of texts (``_text`` and ``_low``, in lower case; null
    texts too); it gives the row of the batch for every row of ``out``, and its columns.  They follow the keys."""
    keys = list(keys)
    schema = StructType([docs.schema[k] for k in keys] + list(out.fields))
    both = [F.col("_text"), F.lower("_text").alias("_low")]

    def matched(b: pa.RecordBatch, table: object) -> pa.RecordBatch:
        at, columns = found(b, table)
        return pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at, pa.int64())) for k in keys] + columns, names=schema.fieldNames())

    size = phrases.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase") + F.octet_length("target")).alias("bytes"),
                       F.collect_set(F.size(F.split("phrase", " "))).alias("lengths")).first()
    if size.n <= small and (size.bytes or 0) <= SMALL_BYTES:
        pairs = phrases.select("phrase", "target").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(prepare(pairs.column("phrase"), pairs.column("target")))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield matched(b, sent.value)

        return docs.select(*keys, F.col(text).alias("_text")).select(*keys, *both).mapInArrow(read, schema)
    n = pooling_blocks(docs, text, block_bytes).withColumn("_one", F.lit(1))  # one row
    texts = docs.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").select(
        *keys, F.pmod(F.xxhash64(*keys), F.col("_blocks")).alias("_block"), F.col(text).alias("_text"))
    known = _known_runs(texts, "_text", cut_lineage(_with_hash(phrases)), size.n, size.lengths)
    # texts are shuffled and sorted once, as they are; their lower case is made behind the shuffle
    dealt = texts.repartition("_block").sortWithinPartitions("_block").select(*keys, "_block", *both)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        table = prepare(right.column("phrase"), right.column("target"))
        return pa.Table.from_batches([matched(b, table) for b in left.to_batches()])

    return dealt.groupBy("_block").cogroup(known.groupBy("_used")).applyInArrow(work, schema)


def rewrite_phrases(docs: DataFrame, lexicon: DataFrame, key: str = "row_id", text: str = "text", out: str = "rewritten",
                    block_bytes: int = BLOCK_BYTES, small: int = SMALL_TABLE) -> DataFrame:
    """T4 with rules from a table (S8): (key, ``out``).

    From left to right, the longest phrase of the table that starts at a word
    gives way to its target and the search goes on behind it; other words stay
    as they are.  A null text stays null, a text without phrases is unchanged,
    an empty table changes nothing.
    """
    def prepare(phrases: pa.ChunkedArray, targets: pa.ChunkedArray) -> tuple[dict, dict]:
        """({phrase: target}, {first word: lengths, the longest first})"""
        table = dict(zip(phrases.to_pylist(), targets.to_pylist()))
        lengths: dict[str, set] = {}
        for p in table:
            lengths.setdefault(p.partition(" ")[0], set()).add(p.count(" ") + 1)
        return table, {w: sorted(n, reverse=True) for w, n in lengths.items()}

    def rewritten(words: list, low: list, table: dict, heads: dict) -> str:
        done, i = [], 0
        while i < len(low):
            step, word = 1, words[i]
            for n in heads.get(low[i], ()):
                target = table.get(low[i] if n == 1 else " ".join(low[i:i + n])) if i + n <= len(low) else None
                if target is not None:
                    step, word = n, target
                    break
            done.append(word)
            i += step
        return " ".join(done)

    def found(b: pa.RecordBatch, table: tuple[dict, dict]) -> tuple[Sequence[int], list[pa.Array]]:
        rows = []
        for text, low in zip(b.column("_text"), b.column("_low")):  # one at a time: a batch is large
            text, low = text.as_py(), low.as_py()
            rows.append(None if text is None else rewritten(text.split(" "), low.split(" "), *table))
        return range(len(rows)), [pa.array(rows, pa.string())]

    return _by_block(docs, lexicon_table(lexicon), [key], text, prepare, found, StructType([StructField(out, StringType())]), block_bytes, small)


def _word_tree(phrases: pa.ChunkedArray, numbers: pa.ChunkedArray) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """(words, levels) of phrases of words.  Level j has (pairs, number): the sorted pairs ``node * len(words) + word`` of
    nodes of the level above and the words behind them, which are its nodes, and the number of the phrase that ends at each,
    or -1.  Nodes of level 0 are the words."""
    split = pc.split_pattern(phrases.combine_chunks(), " ")
    sizes = pc.list_value_length(split).to_numpy()
    flat = split.flatten().dictionary_encode()
    words, codes, first = flat.dictionary, flat.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
    of = pc.cast(numbers.combine_chunks(), pa.int64()).to_numpy()
    levels, node, pairs, rest = [], codes[first], np.arange(len(words)), np.arange(len(sizes))
    for j in range(int(sizes.max(initial=0))):
        if j:
            longer = sizes[rest] > j
            rest, node = rest[longer], node[longer]
            pairs, node = np.unique(node * len(words) + codes[first[rest] + j], return_inverse=True)
        number = np.full(len(pairs), -1)
        ends = sizes[rest] == j + 1
        number[node[ends]] = of[rest[ends]]
        levels.append((pairs, number))
    return words, levels


def _occurrences(b: pa.RecordBatch, tree: tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]) -> tuple[Sequence[int], list[pa.Array]]:
    """The rows of a batch that hold phrases, and lists of their numbers, first words and lengths in words."""
    words, levels = tree
    split = pc.split_pattern(b.column("_low"), " ")
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
    code = pc.fill_null(pc.index_in(split.flatten(), value_set=words), -1).to_numpy().astype(np.int64)
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    i = np.flatnonzero(code >= 0)
    node, hits = code[i], []
    for j, (pairs, number) in enumerate(levels):
        if j:
            inside = ends[row[i]] > i + j
            i, node = i[inside], node[inside]
            wanted = np.where(code[i + j] >= 0, node * len(words) + code[i + j], -1)
            node = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            met = pairs[node] == wanted
            i, node = i[met], node[met]
        whole = number[node] >= 0
        hits.append((i[whole], number[node[whole]], np.full(whole.sum(), j + 1)))
    i, of, n = (np.concatenate(x) for x in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 3
    order = np.argsort(i, kind="stable")
    i, of, n = i[order], of[order], n[order]
    many = np.bincount(row[i], minlength=len(sizes))
    at = np.flatnonzero(many)
    offsets = pa.array(np.append(0, np.cumsum(many[at])), pa.int32())
    start = i - (ends - sizes)[row[i]]
    return at, [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((of, pa.int64()), (start, pa.int32()), (n, pa.int32()))]


def _text_spans(docs: DataFrame, phrases: DataFrame, keys: Sequence[str], text: str, block_bytes: int, small: int) -> DataFrame:
    """(keys, of, start, n_words), lists of one length: the occurrences of ``phrases`` (phrase, number) by number, a row
    per text that holds one."""
    out = StructType([StructField("of", ArrayType(LongType())), StructField("start", ArrayType(IntegerType())),
                      StructField("n_words", ArrayType(IntegerType()))])
    named = phrases.select("phrase", F.col("number").cast("string").alias("target"))
    return _by_block(docs, named, keys, text, _word_tree, _occurrences, out, block_bytes, small)


def _numbered_phrases(terms: DataFrame, term: str) -> DataFrame:
    """(phrase, number), written once: every phrase of the terms has one number."""
    phrases = terms.select(F.lower(term).alias("phrase")).filter(F.length("phrase") > 0).distinct()
    return cut_lineage(phrases.select("phrase", F.monotonically_increasing_id().alias("number")))


def term_spans(docs: DataFrame, terms: DataFrame, keys: Sequence[str], text: str = "text", term: str = "term",
               block_bytes: int = BLOCK_BYTES, small: int = SMALL_TABLE) -> DataFrame:
    """(keys, phrase, start, n_words): every occurrence of a term, overlapping ones too; words count from 0."""
    phrases = _numbered_phrases(terms, term)
    spans = _text_spans(docs, phrases, keys, text, block_bytes, small).select(*keys, F.inline(F.arrays_zip("of", "start", "n_words")))
    return spans.join(phrases, F.col("of") == F.col("number")).select(*keys, "phrase", "start", "n_words")


def _span_sums(place: Sequence[str], own: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's (spans, tokens): by phrase the sum of its occurrences' vectors, and their number."""
    place = list(place)

    def together(values: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, sums of the rows of each, their count)."""
        order = np.argsort(by, kind="stable")
        names, first = np.unique(by[order], return_index=True)
        return names, np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(by)))

    def work(spans: pa.Table, tokens: pa.Table) -> pa.Table:
        if not (spans.num_rows and tokens.num_rows):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.list_(pa.float64())), pa.array([], pa.int64())],
                            names=["phrase", "_sum", "_n"])
        chunk = [np.zeros(t.num_rows, np.int64) for t in (spans, tokens)]  # number of each row's chunk
        for c in place:
            values = pa.chunked_array([*tokens.column(c).chunks, *spans.column(c).chunks]).unique()
            chunk = [k * len(values) + pc.index_in(t.column(c), value_set=values).to_numpy() for k, t in zip(chunk, (spans, tokens))]
        pos, start, size = (t.column(c).to_numpy().astype(np.int64) for t, c in ((tokens, "pos"), (spans, "start"), (spans, "n_words")))
        x = tokens.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(tokens.num_rows, -1)
        _, chunk_of = np.unique(np.concatenate(chunk), return_inverse=True)  # dense: the next product stays small
        in_span, in_token = np.split(chunk_of, [spans.num_rows])
        far = int(max(pos.max(), (start + size).max())) + 1
        known, sums, count = together(x, in_token * far + pos)
        chunks, chunk_sums, chunk_count = together(x, in_token)
        phrases = pc.unique(spans.column("phrase"))
        phrase = pc.index_in(spans.column("phrase"), value_set=phrases).to_numpy()
        total, n = np.zeros((len(phrases), x.shape[1])), np.zeros(len(phrases), np.int64)
        for at in np.array_split(np.arange(spans.num_rows), spans.num_rows // SPANS_TOGETHER + 1):
            found, many = np.zeros((len(at), x.shape[1])), np.zeros(len(at), np.int64)

            def take(which: np.ndarray, wanted: np.ndarray, names: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
                i = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                hit = names[i] == wanted
                found[which[hit]] += values[i[hit]]
                many[which[hit]] += counts[i[hit]]

            for j in range(int(size[at].max(initial=0))):
                of = np.flatnonzero((size[at] > j) & (own | (size[at] > 1)))
                take(of, in_span[at[of]] * far + start[at[of]] + 1 + j, known, sums, count)
            if not own:
                of = np.flatnonzero(size[at] == 1)
                take(of, in_span[at[of]], chunks, chunk_sums, chunk_count)
            of = np.flatnonzero(many)
            if len(of):
                names, vectors, times = together(found[of] / many[of, None], phrase[at[of]])
                total[names] += vectors
                n[names] += times
        met = np.flatnonzero(n)
        return pa.table([phrases.take(pa.array(met)), pa.array(list(total[met]), pa.list_(pa.float64())), pa.array(n[met])],
                        names=["phrase", "_sum", "_n"])

    return work


def _numbered_places(place: Sequence[str], *tables: pa.Table) -> list[np.ndarray]:
    """For each table the number of every row's place; equal places have one number, from 0 without gaps."""
    number = [np.zeros(t.num_rows, np.int64) for t in tables]
    for c in place:
        values = pa.chunked_array([x for t in tables for x in t.column(c).chunks]).unique()
        number = [k * len(values) + pc.index_in(t.column(c), value_set=values).to_numpy() for k, t in zip(number, tables)]
    _, dense = np.unique(np.concatenate(number), return_inverse=True)  # dense: products stay small
    return np.split(dense, np.cumsum([t.num_rows for t in tables])[:-1])


def _span_weights(place: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's (spans, tokens), rows of lists: by phrase the number of its occurrences, by phrase and
    name the weight of the name's vectors in their sum."""
    place = list(place)
    kinds = [("number", pa.int64()), ("name", pa.string()), ("_weight", pa.float64()), ("_n", pa.int64())]

    def listed(t: pa.Table, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
        """(row of each value, the values of every column of lists)."""
        columns = [t.column(c).combine_chunks() for c in names]
        return np.repeat(np.arange(t.num_rows), pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False)), [c.flatten() for c in columns]

    def met(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in wanted, place in the sorted keys) of all that are equal."""
        low = np.searchsorted(keys, wanted, "left")
        many = np.searchsorted(keys, wanted, "right") - low
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(np.arange(len(wanted)), many), np.repeat(low, many) + nth

    def summed(by: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(by, return_inverse=True)
        return names, np.bincount(at, weights=values, minlength=len(names))

    def work(spans: pa.Table, tokens: pa.Table) -> pa.Table:
        if not (spans.num_rows and tokens.num_rows):
            return pa.schema(kinds).empty_table()
        of_span, of_token = _numbered_places(place, spans, tokens)
        row, (phrase, start, size) = listed(spans, "of", "start", "n_words")
        of_span, start, size = of_span[row], start.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64)
        numbers, phrase = np.unique(phrase.to_numpy(), return_inverse=True)
        row, (pos, name, many) = listed(tokens, "pos", "name", "many")
        name, pos, many = name.dictionary_encode(), pc.fill_null(pos, 0).to_numpy().astype(np.int64), many.to_numpy()
        names, name = name.dictionary, name.indices.to_numpy()
        far = int(max(pos.max(initial=0), (start + size).max(initial=0))) + 1
        inside = np.flatnonzero(pos >= 1)
        token = of_token[row[inside]] * far + pos[inside]
        order = np.argsort(token, kind="stable")
        token, name, many = token[order], name[inside[order]].astype(np.int64), many[inside[order]]
        # an occurrence counts once, however often its chunk comes
        _, where = np.unique(of_span * far + start, return_inverse=True)
        once = np.unique(where * len(numbers) + phrase, return_index=True)[1]
        phrase, first, size = phrase[once], of_span[once] * far + start[once] + 1, size[once]

        n, weights = np.zeros(len(numbers), np.int64), []
        for at in np.array_split(np.arange(len(phrase)), len(phrase) // SPANS_TOGETHER + 1):
            pairs = []
            for j in range(int(size[at].max(initial=0))):
                longer = at[size[at] > j]
                i, k = met(token, first[longer] + j)
                pairs.append((longer[i] - at[0], k))
            span, k = (np.concatenate(x) for x in zip(*pairs))
            found = np.bincount(span, weights=many[k], minlength=len(at))
            n += np.bincount(phrase[at[found > 0]], minlength=len(numbers))
            weights.append(summed(phrase[at[span]] * len(names) + name[k], 1 / found[span]))
        some = np.flatnonzero(n)
        by, weight = summed(*map(np.concatenate, zip(*weights)))
        by_phrase, by_name = np.divmod(by, max(len(names), 1))
        return pa.table([pa.array(numbers[np.concatenate([some, by_phrase])]),
                         pa.concat_arrays([pa.nulls(len(some), pa.string()), names.take(pa.array(by_name))]),
                         pa.concat_arrays([pa.nulls(len(some), pa.float64()), pa.array(weight)]),
                         pa.concat_arrays([pa.array(n[some]), pa.nulls(len(by), pa.int64())])], schema=pa.schema(kinds))

    return work


def _named_means(chunks: DataFrame, token_vectors: NamedVectors, terms: DataFrame, place: Sequence[str], text: str, term: str) -> DataFrame:
    """(phrase, n, vector) of :func:`term_vectors`: spans and named tokens meet in blocks, only weights leave them, and
    a vector is fetched once per phrase and name."""
    phrases = _numbered_phrases(terms, term)
    spans = _text_spans(chunks.select(*place, text), phrases, place, text, BLOCK_BYTES, SMALL_TABLE)
    tokens = token_vectors.tokens.select(*[F.col(c).cast(chunks.schema[c].dataType) for c in place], "pos", "name", "many")
    blocks, tasks = block_counts(chunks.sparkSession, text_bytes(chunks, text), NAME_BLOCK_BYTES)
    block = F.pmod(F.xxhash64(*place[:2], F.floor(F.col("chunk") / CHUNKS_TOGETHER)), F.lit(blocks)).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        whole = df.dropna(subset=list(place)).withColumn("_block", block).withColumn("_part", F.col("_block") % tasks)
        return whole.repartitionById(tasks, F.col("_part")).groupBy("_part", "_block")

    out = StructType([StructField("number", LongType()), StructField("name", StringType()), StructField("_weight", DoubleType()), StructField("_n", LongType())])
    met = dealt(spans).cogroup(dealt(tokens)).applyInArrow(_span_weights(place), out)
    # read three times: a row per phrase, and per phrase and name
    total = cut_lineage(met.groupBy("number", "name").agg(F.sum("_weight").alias("_weight"), F.sum("_n").alias("n")))
    weights = total.filter(F.col("name").isNotNull()).select("number", "name", "_weight")
    used = token_vectors.vectors.join(weights.select("name"), "name", "left_semi")  # most names are in no phrase
    used = token_vectors.doubles(used)
    weighted = F.transform("vector", lambda x: x * F.col("_weight"))
    sums = weights.join(used, "name").select("number", weighted.alias("_x")).groupBy("number").agg(Summarizer.sum(array_to_vector("_x")).alias("_s"))
    each = F.col("n").cast("double")
    means = total.filter(F.col("n").isNotNull()).select("number", "n").join(sums, "number").join(phrases, "number")
    return means.select("phrase", F.transform(vector_to_array("_s"), lambda x: x / each).alias("vector"), "n")


def term_vectors(chunks: DataFrame, token_vectors: DataFrame | NamedVectors, terms: DataFrame, term: str = "term", category: str = "category",
                 first_token_if_single: bool = True, key: str = "row_id", text: str = "chunk_text") -> DataFrame:
    """(category, term, n, vector), the mean over a term's occurrences.

    An occurrence's vector is the mean of the tokens of its span (``pos`` counts
    from 1, 0 is the opening token).  A one-word term is its own token; without
    ``first_token_if_single`` it takes the mean of its whole chunk, closing
    token included.  An occurrence none of whose tokens has a vector
    counts nowhere; a term without any such occurrence has no row.

    Spans and tokens are dealt to blocks of about ``SPAN_BLOCK_BYTES`` of text by
    their place: a vector crosses the network once, then one sum per phrase and block.
    Of :class:`NamedVectors` no vector does before the sums, unless one-word terms
    take whole chunks.
    """
    place = [key, "para", "chunk"]
    phrased = terms.select(category, term, F.lower(term).alias("phrase")).distinct()
    if isinstance(token_vectors, NamedVectors):
        if first_token_if_single:
            means = _named_means(chunks, token_vectors, terms, place, text, term)
            return phrased.join(means, "phrase").select(category, term, "n", "vector")
        token_vectors = token_vectors.rows()
    spans = term_spans(chunks.select(*place, text), terms, place, text, term).distinct()
    tv = token_vectors.filter(F.col("pos") >= 1).select(*[F.col(c).cast(chunks.schema[c].dataType) for c in place],
                                                        F.col("pos").cast("bigint"), F.col("vector").cast("array<double>"))
    n = pooling_blocks(chunks, text, SPAN_BLOCK_BYTES).withColumn("_one", F.lit(1))  # one row
    block = F.pmod(F.xxhash64(*place[:2], F.floor(F.col("chunk") / CHUNKS_TOGETHER)), F.col("_blocks")).alias("_block")

    def dealt(df: DataFrame) -> DataFrame:
        whole = df.dropna(subset=place).withColumn("_one", F.lit(1))
        return whole.join(F.broadcast(n), "_one").select(*df.columns, block).groupBy("_block")

    out = StructType([StructField("phrase", StringType()), StructField("_sum", ArrayType(DoubleType())), StructField("_n", LongType())])
    work = _span_sums(place, first_token_if_single)
    sums = dealt(spans).cogroup(dealt(tv)).applyInArrow(work, out).groupBy("phrase").agg(
        Summarizer.sum(array_to_vector("_sum")).alias("_s"), F.sum("_n").alias("n"))
    each = F.col("n").cast("double")
    means = sums.select("phrase", F.transform(vector_to_array("_s"), lambda x: x / each).alias("vector"), "n")
    return phrased.join(means, "phrase").select(category, term, "n", "vector")
