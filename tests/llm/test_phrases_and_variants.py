"""Spelling variants, collocations and decontamination against brute force, on small and odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from blobloom.llm import collocations, decontaminate, variants, words

COLUMNS = "doc_id bigint, text string, lang string, row bigint, n bigint, id bigint, spans string, items int, words string, chunk bigint, segment int"
PASSAGE = "shared words of one passage that is long enough to be a window of ten or more words"
ODD = [
    (1, "The quick brown foxes jumping over the lazy doggies", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t\x00 ", "de"),
    (5, "x" * 3000 + " " + "x" * 3001, "en"),
    (6, f"before {PASSAGE} after", "en"),
    (7, f"{PASSAGE.upper()} {PASSAGE}", "en"),
    (8, "Ünïcödéß ünïcödéßx 中文 text 😀 with\x1cmarks ÀÉÎÕÜàéîõü colour colours coloured", "fr"),
    (8, "Ünïcödéß ünïcödéßx 中文 text 😀 with\x1cmarks ÀÉÎÕÜàéîõü colour colours coloured", "fr"),
    (None, "a row without an id but with colouring colourings colourrings", None),
    (9, "separate seperate separate separates separated " * 12, "en"),
    (10, "of the, of the! of the of the\tof the " * 40, "en"),
    (11, "of the of the of the of the\n" * 40, "de"),
    (12, "word, " * 300 + "one two three four. " * 35, None),
]


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "a", 4, "b", 5, 6) for i, t, lang in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11. Spelling variants


def near(a, b):
    """Whether two words differ by exactly one code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(docs, every=31):
    counts = collections.Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    form, near_count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        near_count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], near_count[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def got_variants(df, **more):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.spelling_variants(df, **more).collect())


def test_spelling_variants(spark, odd, empty):
    found = got_variants(odd)
    assert found == variant_rows(ODD) and len(found) > 5
    assert got_variants(empty) == []


def test_variants_of_random_words_over_many_pieces(spark):
    """A small alphabet, so that words have many neighbours, chains of forms and shared prefixes at every cut."""
    rng = random.Random(3)
    docs = []
    for i in range(40):
        text = " ".join("".join(rng.choice("abÿ") for _ in range(rng.choice((7, 7, 8, 9)))) for _ in range(300))
        docs.append((i, text, "en"))
    docs += [(100 + k, "abababa " * 20_000 + "abababaa " * 1_000 + "aabababaa " * 60, "en") for k in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = got_variants(table(spark, docs).repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = variant_rows(docs)
    assert found == want
    assert max(r[4] for r in want) > 10 and any(r[1] is not None and r[2] != r[1] for r in want)


# 12. Collocations


def collocation_rows(docs, top, least):
    counts = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    rows = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            around = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def got_collocations(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **more).collect())


def test_collocations(spark, odd, empty):
    found = got_collocations(odd)
    assert found == collocation_rows(ODD, 2000, 30) and {r[0] for r in found} >= {"en", "de", "und"}
    assert got_collocations(odd, top=2) == collocation_rows(ODD, 2, 30)
    assert got_collocations(empty) == []
    assert got_collocations(table(spark, [(1, "never twice", "en")])) == []


def test_collocations_over_many_chunks(spark, monkeypatch):
    """Small chunks and many segments, so that filters are merged and answered piece by piece."""
    monkeypatch.setattr(collocations, "TOGETHER", 200)
    monkeypatch.setattr(collocations, "PER_SEGMENT", 100)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d.", "e", "fé", "g"]) for _ in range(400)), rng.choice(["en", "de", None])) for i in range(30)]
    assert got_collocations(table(spark, docs).repartition(3), top=150, least=5) == collocation_rows(docs, 150, 5)


@pytest.mark.parametrize(("n", "width", "segment_bits"), [(2, 3, 4), (2, 17, 5), (3, 17, 7), (4, 32, 16), (4, 16, 0), (3, 1, 4)])
def test_quotient_filter_round_trip(n, width, segment_bits):
    rng = np.random.default_rng(n * width)
    how = collocations.Phrases(n, width, segment_bits)
    phrases = np.unique(rng.integers(0, 1 << width, (500, n)), axis=0)
    keys = how.keys(phrases)
    assert len(np.unique(keys)) == len(phrases)
    assert (how.words(keys) == phrases).all()
    keys = np.sort(keys)
    counts = rng.choice([1, 2, 255, 256, 257, 1 << 40], len(keys))
    segments = how.segments(keys)
    for segment in np.unique(segments):
        own = segments == segment
        back = how.unpacked(int(segment), how.packed(keys[own], counts[own]))
        assert (back[0] == keys[own]).all() and (back[1] == counts[own]).all()
    nothing = how.unpacked(0, how.packed(keys[:0], counts[:0]))
    assert len(nothing[0]) == len(nothing[1]) == 0


# 13. Decontamination


def windows_of(text, window):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def decontaminated_rows(docs, items, window=10):
    found = collections.defaultdict(set)
    for item, text in items:
        for x in windows_of(text, window)[1]:
            found[x].add("" if item is None else str(item))
    sizes = {len(x) for x in found}
    rows = []
    for doc, text, *_ in docs:
        w, _ = windows_of(text, window)
        hit, told = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in found:
                    hit.update(range(i, i + size))
                    told |= found[x]
        rows.append((doc, len(w), len(hit), len(told), hashlib.sha256(",".join(sorted(told)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=repr)


ITEMS = [(1, PASSAGE), (2, "xx " + PASSAGE[:60]), (3, None), (4, "..."), (5, "of the"), (5, "lazy"), (None, "QUICK brown"), (6, PASSAGE), (7, "never " * 12), (10, "three four one two three")]


def got_contamination(spark, df, items, **more):
    bench = spark.createDataFrame([(i, t, "z", 1) for i, t in items], "item_id bigint, text string, words string, row int")
    found = decontaminate.contamination(df, bench, **more)
    rows = found.collect()
    for r in rows:
        spans = [tuple(s) for s in r["spans"]]
        assert all(a < z for a, z in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in names) for r in decontaminate.digests(found).collect()), key=repr)


def test_decontamination(spark, odd, empty):
    want = decontaminated_rows(ODD, ITEMS)
    assert got_contamination(spark, odd, ITEMS) == want and sum(r[5] for r in want) > 4
    assert got_contamination(spark, empty, ITEMS) == []
    assert got_contamination(spark, odd, []) == decontaminated_rows(ODD, [])
    assert got_contamination(spark, odd, ITEMS, window=1) == decontaminated_rows(ODD, ITEMS, 1)


def test_decontamination_over_shards_and_blocks(spark, monkeypatch):
    """Documents longer than a shard, passages over the ends of chunks and shards, and several blocks of windows."""
    monkeypatch.setattr(decontaminate, "SHARD", 700)
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice((0, 5, 90, 2500)))), "en") for i in range(20)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice((2, 5, 6, 14))))) for i in range(40)]
    df = table(spark, docs).repartition(2)
    want = decontaminated_rows(docs, items, 6)
    assert got_contamination(spark, df, items, window=6) == want
    assert got_contamination(spark, df, items, window=6, block_bytes=2000) == want


def test_words_of_sliced_columns():
    import pyarrow as pa

    column = pa.array(["No,", None, " One  two ", "", "ÄB\x00c"])[1:]
    found, lengths = words.split_words(words.translated(column, decontaminate.WORDS))
    assert found.to_pylist() == ["one", "two", "Äb", "c"] and lengths.tolist() == [0, 2, 0, 2]
