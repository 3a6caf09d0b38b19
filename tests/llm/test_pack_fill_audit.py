import itertools
import random
import struct
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equilibra.llm import fill_middle, filter_audit, packing

VOCABULARY = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
LIBRARY.encode_special_tokens = True
WORDS = packing.Words(VOCABULARY, memory=50)


# ---- packing ----

def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def unpacked(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    assert unpacked(WORDS.ids(text)) == library_ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aBzéÉßŸİıſſ'srevmld 09.#\t\n\r\x0b\x0c\x1c\x85\xa0́Å日本\U0001F600<|endoftext>", max_size=60))
def test_ids_equal_the_library_on_edges(text):
    assert unpacked(WORDS.ids(text)) == library_ids(text)


def test_ids_of_the_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows:
        assert unpacked(WORDS.ids(r.text)) == library_ids(r.text)


def checked(rows, capacity):
    """Every sequence is gapless from 0 and not overfull; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps, n = Counter(), 0
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            n, fit = n + 1, capacity
        else:
            gaps[fit] -= 1
            if not gaps[fit]:
                del gaps[fit]
        if fit > x:
            gaps[fit - x] += 1
    return n


def piece_table(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, x, i % 7) for i, x in enumerate(lengths)],
                                 "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint")


@pytest.mark.parametrize("name, lengths", [
    ("mixed", [random.Random(1).randint(1, 100) for _ in range(600)]),
    ("small", [random.Random(2).randint(1, 6) for _ in range(900)]),
    ("hot", [33] * 400 + [random.Random(3).randint(1, 100) for _ in range(200)]),
    ("large", [random.Random(4).randint(51, 100) for _ in range(100)] + [100] * 20),
    ("one", [7])])
def test_packing_is_whole_and_near_best_fit(spark, monkeypatch, name, lengths):
    monkeypatch.setattr(packing, "RANGE", 16)      # several ranges, several rounds
    monkeypatch.setattr(packing, "MERGE", 2)
    monkeypatch.setattr(packing, "RANK_ROWS", 40)  # several buckets of a length
    rows = packing.pack(piece_table(spark, lengths).withColumn("_rank_", F.lit("kept")), 100).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(lengths)) and {r._rank_ for r in rows} == {"kept"}
    n, least = checked(rows, 100), max(-(-sum(lengths) // 100), sum(x > 50 for x in lengths))
    assert least <= n <= max(best_fit_decreasing(lengths, 100) * 1.02, least + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 9)), max_size=8), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), max_size=8))
def test_sweep_loses_nothing_and_leaves_no_fit(pieces, gaps):
    count = Counter()
    for x, n in pieces:
        count[x] += n
    rows = [("pieces", x, 0, n, None, None) for x, n in count.items()]
    at = 0
    for g, n in gaps:
        rows.append(("gaps", g, None, n, at, None))
        at += n
    size_of = {s: g for _, g, _, n, first, _ in rows[len(count):] for s in range(first, first + n)}
    out = packing.sweep(rows, 1)
    got, used = Counter(), Counter()
    for kind, size, first, n, seq, each, length in (r if len(r) == 7 else (*r, None) for r in out):
        if kind == "placed":
            got[length] += n
            for i in range(n):
                used[seq + i // each] += length
        elif kind == "pieces":
            got[size] += n
    assert got == count and all(v <= size_of[s] for s, v in used.items())
    left = [r[1] for r in out if r[0] == "pieces"]
    free = {s: size_of[s] - used[s] for s in size_of if size_of[s] > used[s]}
    said = {s: r[1] for r in out if r[0] == "gaps" for s in range(r[4], r[4] + r[3])}
    assert said == free and (not left or not free or min(left) > max(free.values()))


def test_packed_texts_read_back(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    pieces = packing.tokenised(docs, VOCABULARY, 64, with_ids=True)
    packed = packing.pack(pieces, 64)
    rows = packed.collect()
    checked(rows, 64)
    whole = {r.sequence_id: unpacked(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == unpacked(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
    expected = Counter()
    for d in docs.collect():
        ids = library_ids(d.text or "") + [0]
        for k, start in enumerate(range(0, len(ids), 64)):
            expected[(d.doc_id, k, start, tuple(ids[start:start + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(unpacked(r.ids))) for r in rows) == expected


def test_packing_of_empty_tables_and_taken_names(spark, no_docs):
    assert packing.packed_documents(no_docs, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(piece_table(spark, [1]).withColumn("Offset", F.lit(1)))


# ---- fill-in-middle ----

def units_by_hand(text):
    ends, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i].isascii() and text[i].isalpha():
            while j < len(text) and text[j].isascii() and text[j].isalpha():
                j += 1
        ends.append(j)
        i = j
    return ends


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_unit_ends(text):
    assert fill_middle.unit_ends(text) == units_by_hand(text)


def test_unit_ends_of_a_long_text():
    text = "word, " * 300_000 + "é" + "x" * 1_000_000
    assert len(fill_middle.unit_ends(text)) == 300_000 * 3 + 2


def test_fill_middle_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(["a <P> b", "x<S>y", "<M>", "<P <S <M", "ab<", "<" * 9 + "S>", "a\nb\r\n c", "日本 <"] * 12)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    got = fill_middle.rearranged(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 12 + len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    import hashlib
    for r in got:
        text = r.text or ""
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
        ends = [0, *units_by_hand(text)]
        n = len(ends) - 1
        a, b = (ends[i] for i in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        assert (r.n, r.form, r.output, r.back) == (n, form, out, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (a, b - a))
    assert fill_middle.rearranged(no_docs).count() == 0
    with pytest.raises(ValueError):
        fill_middle.rearranged(no_docs.withColumn("Form", F.lit(1)))


# ---- filter audit ----

def audit_by_hand(docs, labels):
    import re
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for d, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        rows.append((source or "", {f for f, b in zip("ABCDE", bad) if b}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone),
                                                   sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit_equals_playing_every_order(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["one", "Two", "THREE", "f#ur", "five"]) + str(rnd.randint(0, k)) for _ in range(n))
             for n, k in ((10, 3), (250, 5), (250, 900), (300, 900), (220, 90))] + ["", "A", None]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["a", "a", "b", "", None])) for _ in range(150)]
    rows += [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns(
        {"mask": F.lit(1), "part": F.lit("x"), "n": F.lit(9), "quality": F.lit(1)})
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in filter_audit.audit(docs, known).collect()}
    assert got == audit_by_hand(rows, labels)
    assert filter_audit.audit(no_docs, known).count() == 0
    assert filter_audit.audit(docs, known.limit(0)).count() == len(got)


def test_potential_gives_shapley_values(spark):
    df = spark.range(1).select(F.array(*[F.lit(x).cast("bigint") for x in [0, *range(1, 32)]]).alias("v"))
    p = df.select(filter_audit.potential(F.col("v")).alias("p")).first().p
    v = list(range(32))
    for i in range(5):
        total = sum(v[sum(1 << j for j in o[:o.index(i) + 1])] - v[sum(1 << j for j in o[:o.index(i)])] for o in itertools.permutations(range(5)))
        assert p[31] - p[31 - (1 << i)] == total
