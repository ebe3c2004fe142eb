"""Each operator against a plain version on small tables that hold the awkward cases."""

import hashlib
import random
import sys
import timeit
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from rillbase.llm import chunk_store, components, cotraining, decontaminate, line_rules, ngram, packing, shingles, simhash, suffixes, token_counts, units, warc  # noqa: E402
from rillbase.llm.common import shared_place  # noqa: E402

WORDS = "the of and thorreou nternti edat sh ation éauxment là über ñra x's 3rd ** a,b".split()


def some_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", ". ", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, null, empty, white space, one very long text and runs of one letter."""
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a" * 400), (5, "a" * 250 + "b" + "a" * 250)]
    passage = some_text(rng, 60)
    base = some_text(rng, 200)
    for i in range(6, 26):
        words = base.split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, some_text(rng, rng.randrange(1, 120)) + (passage if i % 2 else "") + some_text(rng, 20)) for i in range(26, 60)]
    rows.append((60, some_text(rng, 15_000)))
    rows += [(i, rows[30][1]) for i in range(61, 66)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, None if i % 7 == 0 else f"host{i % 3}", "x", 1.0) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string, bits double").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_repeats(docs, corpus):
    told = brute.repeats(corpus)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffixes.remove_repeats(docs)).items()} == told


def test_repeats_of_hot_anchors(docs, corpus):
    told = brute.repeats(corpus)
    assert {i: r.kept_sha256 for i, r in by_id(suffixes.remove_repeats(docs, hot=1)).items()} == {i: t[3] for i, t in told.items()}


def test_repeats_of_random_bytes(spark):
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(90, 130))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) + "".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(80)]
    found = by_id(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == brute.repeats(rows)


def test_repeats_with_repeated_and_null_ids(spark):
    text = "".join(random.Random(7).choices("abcdefgh", k=150))
    rows = [(None, text), (1, text), (1, text), (2, text + "more")]
    found = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0), (1, 150), (1, 150), (2, 150)]


def test_repeats_only_sort_what_may_repeat():
    rng = random.Random(3)
    noise = lambda n: bytes(rng.choices(range(97, 123), k=n))
    anchor, right = noise(32), noise(68)
    # Fragments whose texts agree in the anchor only; two more that share the windows which begin at most 9 bytes before it.
    apart = [(noise(68) + anchor + noise(68), i, 1000, 68) for i in range(50)]
    near = [(noise(59) + b"ninebytes" + anchor + right, 50 + i, 1000, 68) for i in range(2)]
    assert suffixes.shared_parts(apart, 100) == []
    assert suffixes.shared_parts(near[:1], 100) == []
    parts = suffixes.shared_parts(apart + near, 100)
    assert [(text, begin) for text, _, begin in parts] == [(g[0][53:168], 1053) for g in near]
    whole = suffixes.repeated_windows([g[0] for g in near], np.array([50, 51]), np.array([1000, 1000]), 100)
    cut = suffixes.repeated_windows([p[0] for p in parts], np.array([p[1] for p in parts]), np.array([p[2] for p in parts]), 100)
    assert sorted(zip(*map(list, whole))) == sorted(zip(*map(list, cut))) and len(whole[0]) == 10


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(0, 40))).encode() for _ in range(5)]
        order, buf = suffixes.suffix_array(texts)
        whole = b"\0".join(texts) + b"\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        suffix = [whole[i : ends[np.searchsorted(ends, i)]] for i in range(len(whole))]
        assert sorted(order.tolist()) == list(range(len(whole)))
        assert [suffix[i] for i in order] == sorted(suffix)


# 2


def test_packing(docs, corpus):
    pieces = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in corpus:
        ids = np.array([*brute.encoded(text), 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_packing_pads_nothing_and_takes_odd_rows(spark):
    rng = random.Random(12)
    rows = [(i, some_text(rng, rng.randrange(1, 500))) for i in range(300)] + [(None, "same"), (None, "same"), (7, "same"), (400, None), (400, "")]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, start string, length int").repartition(2)
    pieces = packing.pack_documents(frame).collect()
    assert sum(p.length for p in pieces) == sum(len(brute.encoded(t)) + 1 for _, t in rows)
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert sum(n == 1024 for n in sizes.values()) >= len(sizes) - 2 * 10 and all(n == 1024 or n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_best_multiset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        room = rng.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        total, taken = packing.best_multiset(counts, room)
        assert total == max(s for s in sums if s <= room) == sum(k * n for k, n in taken.items())
        assert all(n <= counts[k] for k, n in taken.items())


# 3


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        low, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = some_text(rng, 60)
        if low:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " vile words"
        rows.append((i, text, rng.choice(["en", None]), f"src{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 0 if low else 1, 1 if toxic else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_classifier_on_rows_it_has_not_seen(labelled):
    docs, labels, rows = labelled
    found = by_id(cotraining.score_documents(docs, labels))
    good = {i: not ("!!" in t or "vile" in t) for i, t, *_ in rows}
    unseen = [i for i in good if i % 2 == 0]
    assert sum(found[i].kept == good[i] for i in unseen) >= 0.98 * len(unseen)


def test_classifier_without_labels(labelled, spark):
    docs, labels, _ = labelled
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    found = cotraining.score_documents(odd, labels.limit(0)).collect()
    assert len(found) == 4 and all(r.kept for r in found)
    assert cotraining.score_documents(docs.limit(0), labels).count() == 0


def plain_views(text, lang, source, n_chars):
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return {cotraining.slot(w) for w in words}, set(cotraining.metadata(lang, source, n_chars, cotraining.figures(text or "", words, len(set(words)))))


def test_views_of_many_texts_at_once():
    """They are those of single texts, whatever the characters, and take far less time."""
    rng = random.Random(12)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    awkward = ["ΑΣ", "Σ", "İ", "ǅ", "ABC", "Ab", "ß", "é", "\u0301", "字", "²", "1", "_", ".", "!", "\x1c", "\u2003", " ", " ", "\n"]
    texts = ["", " \n\n", "a" * 400, "字" * 300, " ".join("é" * k for k in range(30, 36)), " ".join("A" * k for k in range(60, 70))]
    texts += ["".join(rng.choice(awkward) for _ in range(150)) for _ in range(100)] + ["".join(rng.choices(every, k=2000)) for _ in range(30)]
    texts += [some_text(rng, 400) for _ in range(600)]

    def plain():
        return [plain_views(t, "en", "x", 1) for t in texts]

    def at_once():
        slots, numbers = cotraining.described(texts)
        return [(set(np.frombuffer(s, np.uint32).tolist()), set(cotraining.metadata("en", "x", 1, f))) for s, f in zip(slots, numbers)]

    assert at_once() == plain()
    assert all(sorted(set(x)) == x for x in (np.frombuffer(s, np.uint32).tolist() for s in cotraining.described(texts)[0]))
    taken = {f: min(timeit.repeat(f, number=1, repeat=3)) for f in (plain, at_once)}
    assert taken[at_once] < 0.6 * taken[plain]


def test_classifier_scores_as_a_plain_one(labelled, spark):
    docs, labels, rows = labelled
    odd = [(None, None, None, None, None), (5000, "", "en", "src1", 0), (5001, "vile " * 30_000, "en", "src2", 150_000), (5001, "vile " * 30_000, "en", "src2", 150_000), rows[3], rows[3]]
    every = rows + odd
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in every], "doc_id long, text string, lang string, source string, n_chars long, words string, style double").repartition(3)
    twice = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (9999, 0, 0)], labels.schema))
    views = cotraining.features(frame)
    heads = cotraining.train(views, twice)
    told = []
    for i, *columns in every:
        words, meta = plain_views(*columns)
        p = []
        for h in (heads["low"], heads["toxic"]):
            (a, b), (c, d) = h.scales
            u, v, w = h.combine
            z = u * (a * (sum(h.words[k] for k in words) + h.words[-1]) + b) + v * (c * (sum(h.meta[k] for k in meta) + h.meta[-1]) + d) + w
            p.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        told.append((i if i is not None else -1, round(float(p[0]), 6), round(float(p[1]), 6)))
        assert min(h.combine[0] for h in heads.values()) >= 0 <= min(h.combine[1] for h in heads.values())
    found = cotraining.score_documents(frame, twice).collect()
    assert len(found) == len(every) and all(r.kept == (r.low_quality <= 0.5 and r.toxicity <= 0.4) for r in found)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.low_quality, r.toxicity) for r in found)
    assert all(abs(x - y) < 1e-3 for g, t in zip(got, sorted(told)) for x, y in zip(g, t))


def test_surest_rows_are_those_of_all(labelled):
    docs, labels, _ = labelled
    views = cotraining.features(docs.repartition(5))
    heads = cotraining.train(views, labels, rounds=0)
    every = views.collect()
    for give in (3, 10_000):
        found = {}
        for r in cotraining.confident(views, heads, give, 0.6).collect():
            found.setdefault((r["head"], r["view"], r["value"]), set()).add(r["row"])
        for (name, view, value), got in found.items():
            w = heads[name].meta if view else heads[name].words
            p = {r.row: 1 / (1 + np.exp(-(w[np.frombuffer(r.meta if view else r.words, np.uint32)].sum() + w[-1]))) for r in every}
            sure = sorted(((x if value else 1 - x, -i) for i, x in p.items() if (x if value else 1 - x) >= 0.6), reverse=True)[:give]
            assert len(got) == len(sure) and min(p[i] if value else 1 - p[i] for i in got) == pytest.approx(sure[-1][0])


def test_views_teach_each_other(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.4
        # Labelled pages only show one bad word; the other bad word is told by its pages' source, and shows alone where the source tells nothing.
        kind = "labelled" if i < 400 else "bridge" if i < 1000 else "new"
        word = "grumble" if kind == "labelled" else "zonk"
        text = some_text(rng, 40) + (f" {word}" if bad else "")
        source = f"fresh{i}" if kind == "new" else ("farm" if bad else "press")
        rows.append((i, text, "en", source, 300))
        if kind == "labelled":
            labels.append((i, 0 if bad else 1, 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    views = cotraining.features(docs)
    alone, taught = (cotraining.train(views, marks, rounds=n)["low"].words for n in (0, 3))
    assert alone[cotraining.slot("zonk")] == 0 and taught[cotraining.slot("zonk")] > 1
    found = by_id(cotraining.score_documents(docs, marks))
    new = [r for r in rows if r[3].startswith("fresh")]
    assert np.mean([found[r[0]].low_quality for r in new if "zonk" in r[1]]) > np.mean([found[r[0]].low_quality for r in new if "zonk" not in r[1]]) + 0.2


def test_calibration_converges():
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.2).astype(int)
    for spread in (0.5, 5.0, 500.0):
        good, noise, against = y * 2 * spread - spread + rng.normal(0, spread / 3, 200), rng.normal(0, spread, 200), spread - 2 * spread * y
        base = cotraining._loss(np.full(200, np.log(y.mean() / (1 - y.mean()))), y)
        head = cotraining.calibrate(cotraining.Head(np.zeros(1), np.zeros(1)), good, noise, y)
        assert cotraining._loss(head.logits(good, noise), y) < 0.3 * base
        head = cotraining.calibrate(cotraining.Head(np.zeros(1), np.zeros(1)), noise, against, y)
        assert head.combine[1] * head.scales[1][0] == 0 and cotraining._loss(head.logits(noise, against), y) < 1.05 * base


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_both_views_are_better_than_each(spark, sf, monkeypatch):
    seen, plain = [], cotraining.calibrate

    def watched(head, words, meta, labels):
        out = plain(head, words, meta, labels)
        (a, b), (c, d) = out.scales
        seen.append([cotraining._loss(z, labels) / len(labels) for z in (out.logits(words, meta), a * words + b, c * meta + d)])
        return out

    monkeypatch.setattr(cotraining, "calibrate", watched)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    cotraining.train(cotraining.features(docs), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"))
    assert len(seen) == 2 and all(both <= min(one, two) + 0.005 for both, one, two in seen)


# 4


def test_chunk_store(docs, corpus):
    found = by_id(chunk_store.round_trip(docs))
    at = 0
    for i, text in corpus:
        ids = np.array([*brute.encoded(text), 2], "<u4")
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_chunks_are_stored_once_and_verified(spark, docs):
    place = shared_place(spark, "store")
    chunk_store.write_store(docs, place)
    chunks = spark.read.parquet(f"{place}/recipes").select(F.explode("chunks").alias("c")).select("c.*")
    assert chunks.select("digest").distinct().count() == chunks.select("pack", "offset").distinct().count() < chunks.count()
    for pack in Path(place.removeprefix("file://"), "packs").iterdir():
        raw = bytearray(pack.read_bytes())
        if raw:
            raw[len(raw) // 2] ^= 1
            pack.write_bytes(raw)
    with pytest.raises(Exception):
        chunk_store.read_store(spark, place).collect()


def test_boundaries_follow_content():
    ids = np.random.default_rng(0).integers(0, 50_000, 30_000).astype(np.uint32)
    cut = lambda x: chunk_store.boundaries(0, len(x), chunk_store.marks(x).tolist())
    one, two = set(cut(ids)), {e - 7 for e in cut(np.concatenate((np.arange(7, dtype=np.uint32), ids)))}
    assert len(one & two) > 0.8 * len(one)
    assert cut(ids)[-1] == 30_000 and cut(ids[:0]) == []
    assert all(b - a <= chunk_store.MOST for a, b in zip([0, *cut(np.zeros(20_000, np.uint16))], cut(np.zeros(20_000, np.uint16))))


def test_chunk_store_of_odd_tables(spark, docs):
    rows = [(None, "one two"), (3, "x" * 50_000), (3, "x" * 50_000), (3, "other"), (1, None), (2, "")]
    frame = spark.createDataFrame([(*r, "clash", b"clash") for r in rows], "doc_id long, text string, pack string, digests binary")
    found = chunk_store.round_trip(frame).orderBy("start").collect()
    told = {}
    for i, text in rows:
        ids = np.array([*brute.encoded(text), 2], "<u4")
        told.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 3, 3]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    for i, known in told.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in found if r.doc_id == i) == sorted(known)
    assert chunk_store.round_trip(docs.limit(0)).count() == 0


def test_manifest_has_one_root(spark, docs, monkeypatch):
    monkeypatch.setattr(chunk_store, "PART_DOCS", 4)
    monkeypatch.setattr(chunk_store, "FAN", 3)
    place = shared_place(spark, "store")
    chunk_store.write_store(docs, place)
    nodes = spark.read.parquet(f"{place}/manifest").collect()
    levels = {k: [r for r in nodes if r.level == k] for k in {r.level for r in nodes}}
    assert len(levels) > 2 and len(levels[max(levels)]) == 1 and all(r.n <= 3 for r in nodes if r.level)
    for k in range(1, len(levels)):
        below = {r.part: bytes(r.root) for r in levels[k - 1]}
        for r in levels[k]:
            assert bytes(r.root) == chunk_store.merkle([below[p] for p in sorted(below) if p // 3 == r.part])


# 5


def test_contamination(spark, docs, corpus):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcdefghij klmno") for _ in range(n)).strip() for n in (90, 200, 333, 40, 8)] + ["", None]
    clean = [t or "" for _, t in corpus]
    rows, planted = [], set()
    for n in range(60):
        text = clean[6 + n % 50]
        if n % 3 == 0:
            k = n % 5
            x = list(items[k])
            for _ in range(int(len(x) * 0.06) if len(x) > 30 else 0):
                at, kind = rng.randrange(len(x)), rng.randrange(3)
                x[at : at + (kind > 0)] = [] if kind == 1 else ["Q"]
            text = text[: len(text) // 2] + " ".join("".join(x).split()).upper() + text[len(text) // 2 :]
            planted.add((n, k))
        rows.append((n, text))
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_bytes=300)
    every = found.collect()
    got = {(r.doc_id, r.item_id): r for r in every}
    assert planted <= set(got)
    # Exactly what brute force finds: every item within its budget of some part of a text, and no other.
    told = {}
    for n, text in rows:
        for k, item in enumerate(items):
            item = decontaminate.folded(item or "")
            budget = min(int(0.06 * len(item)), max(0, len(item) // decontaminate.Q - 1))
            if item and (edits := brute.edit_distance_within(item, decontaminate.folded(text))) <= budget:
                told[n, k] = edits
    assert set(got) == set(told)
    for (n, k), r in got.items():
        assert brute.edit_distance_within(decontaminate.folded(items[k]), decontaminate.folded(rows[n][1])[r.begin : r.end]) <= r.edits
    assert all(min(r.edits for r in every if (r.doc_id, r.item_id) == at) == told[at] for at in told)
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_contamination_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(None, f"so {item} it was"), (3, item), (3, item), (4, None), (5, ""), (6, "x " * 40_000 + item + " y" * 40_000), (7, f"{item} and {item}")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    marks = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, item.upper(), 0), (None, item, 0), (9, None, 0)], "item_id long, text string, doc_id int")
    found = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.contamination(docs, marks).collect()]
    for doc, times in ((None, 1), (3, 2), (6, 1), (7, 2)):
        for at, again in ((1, 2), (2, 1), (None, 1)):
            assert found.count((doc, at, 0)) in (times, times * again), (doc, at)
    assert not [f for f in found if f[0] in (4, 5) or f[1] == 9]
    assert [r.doc_id for r in decontaminate.clean_documents(docs, marks).orderBy("doc_id").collect()] == [4, 5]


# 6


def test_ngram_scores(spark, docs, corpus):
    # Copies, and a long text (brute force holds all grams of a text, so not the longest of the corpus) that is held out (82) and in training (83).
    rows = [(i, t) for i, t in corpus if len(t or "") < 4000] + [(100 + i, t) for i, t in corpus[6:40]] + [(82, corpus[60][1][:6000]), (83, corpus[60][1][:6000])]
    told = brute.ngram_scores(rows, ngram.WEIGHT, ngram.GROWTH)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 25, 3000):
        found = by_id(ngram.score_texts(frame, shard_bytes=size))
        assert len(found) == len(told)
        for i, r in found.items():
            assert tuple(r)[1:5] == told[i][:4]
            assert tuple(r)[5:] == pytest.approx(told[i][4:], rel=1e-9)
    assert ngram.score_texts(frame.limit(0)).count() == 0


def test_ngram_scores_with_null_and_repeated_ids(spark):
    rows = [(None, "one two three four"), (5, "one two three"), (5, "one two three"), (5, "four one two"), (6, "two three four"), (82, "one two three four"), (82, None)]
    found = ngram.score_texts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")).collect()
    plain = brute.ngram_scores([(n, t) for n, (_, t) in enumerate(rows)], ngram.WEIGHT, ngram.GROWTH, ids=[i for i, _ in rows])
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in found) == sorted(
        (rows[n][0] or -1, *v[:4], round(v[4], 9), round(v[5], 9)) for n, v in plain.items()
    )


def test_suffix_array_of_token_runs_is_sorted():
    # Runs need not end with a token of their own: one may be how another goes on.
    rng = np.random.default_rng(4)
    for _ in range(30):
        texts = [rng.integers(0, 2, rng.integers(1, 12)).tolist() for _ in range(8)]
        sizes = np.array([len(t) for t in texts])
        sa = ngram.SuffixArray(np.concatenate(texts), sizes, np.arange(2, dtype=np.uint64))
        whole, ends = sum(texts, []), np.repeat(np.cumsum(sizes), sizes)
        found = [whole[i : ends[i]] for i in sa.order.tolist()]
        assert found == sorted(found)


def test_ngram_searches_only_what_may_match():
    def file(tokens):
        return {"whole": np.array([True]), "sizes": np.array([len(tokens)]), "first": np.array([0]), "hashes": np.arange(1, 200, dtype=np.uint64).tobytes(), "tokens": ngram.planes(np.array(tokens)), "marks": ngram.planes(ngram.gram_keys(shingles.mix(np.array(tokens, np.uint64) + np.uint64(1)), ngram.LEAD) >> 28)}

    text = list(range(100))
    sa = ngram.SuffixArray(np.array(text), np.array([100]), np.arange(1, 200, dtype=np.uint64))
    there = np.zeros(1 << ngram._BITS, bool)
    there[ngram.gram_keys(shingles.mix(np.array(text, np.uint64) + np.uint64(1)), ngram.LEAD) >> (60 - ngram._BITS)] = True
    assert ngram._wanted(sa, there, file(text[::-1])) is None
    wanted = ngram._wanted(sa, there, file([*range(150, 160), *text[20:80], *range(170, 180)]))
    assert wanted["number"].tolist() == list(range(10, 67))
    # All places of the passage match up to its end, so only its first tells anything.
    found = ngram._Found()
    for batch in ngram._matched(sa, [(7, wanted)]):
        assert batch.column("shard").to_pylist() == [7]
        found.add(batch.column("blob")[0].as_py())
    found.close(77)
    assert found.longest.tolist() == [60 if i == 10 else 0 for i in range(77)]
    assert found.count(np.full(4, 10), np.array([4, 5, 60, 61])).tolist() == [0, 1, 1, 0]


def test_ngram_memory_of_a_shard():
    # What a task takes for each token of its shard, beside the texts; and that blocks and parts of keys give what the whole gives.
    rng = np.random.default_rng(6)
    kinds, sizes = np.sort(rng.integers(0, 1 << 63, 50_000).astype(np.uint64)), rng.integers(1, 2000, 1100)
    tokens, n = rng.integers(0, 50_000, int(sizes.sum())) ** 3 // 50_000**2, int(sizes.sum())
    assert n > 3 * (1 << 18)
    row = {"held": rng.random(1100) < 0.1, "sizes": sizes, "hashes": kinds.tobytes(), "tokens": ngram.planes(tokens)}
    mixed, left = shingles.mix(kinds)[tokens], np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    held = np.repeat(row["held"], sizes)
    for depth in (2, 4):
        plain = np.append(ngram.gram_keys(mixed, depth), np.zeros(depth - 1, np.int64))[left >= depth]
        (keys, slots), of = np.unique(plain, return_inverse=True), held[left >= depth]
        tracemalloc.start()
        home = ngram._Home(dict(row))
        at = home.places(depth)
        found = home.distinct(depth, at)
        took = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        slot = home.slots(depth, at)
        took = max(took, tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in found))
        tracemalloc.stop()
        assert took < 45 * n, (depth, took / n)
        assert (found[0] == keys).all() and (slot == slots).all()
        assert (found[1] == 2 * np.bincount(slots, ~of).astype(np.int64) + (np.bincount(slots, of) > 0)).all()


def test_ngram_scores_in_small_blocks(spark, corpus, monkeypatch):
    rows = [(i, t) for i, t in corpus if len(t or "") < 4000] + [(82, corpus[60][1][:6000]), (83, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = by_id(ngram.score_texts(frame))
    monkeypatch.setattr(ngram, "BLOCK", 97)
    assert by_id(ngram.score_texts(frame)) == whole


def test_ngram_arrays_have_only_what_is_searched_for_and_copies_once(spark, monkeypatch):
    # 30 copies of a training text, a passage in the middle of two training texts only, and one that a held-out text shares with a training text.
    def text(name, n=20):
        return " ".join(f"{name}{k}" for k in range(n))

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(200) if i not in ids)
    middles = [f"{text(x)} {text('m')} {text(x + 'z')}" for x in "ab"]
    rows = [*zip(ids, [text("copy", 40)] * 30 + middles + [f"{text('c')} {text('shared')} {text('d')}"]), (held, f"{text('e')} {text('shared')} {text('f')}")]
    kept, plain = [], ngram.matches

    def matches(groups, n, parts, files):
        kept.extend(ngram._load(files, name) for r in groups.collect() for name in r.names)
        return plain(groups, n, parts, files)

    monkeypatch.setattr(ngram, "matches", matches)
    found = by_id(ngram.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert sorted(x for r in kept for x in r["sizes"].tolist()) == [20, 41]
    assert sorted(x for r in kept for x in r["weights"].tolist()) == [1, 30]
    told = brute.ngram_scores(rows, ngram.WEIGHT, ngram.GROWTH)
    assert len(found) == len(told) == 34
    for i, r in found.items():
        assert tuple(r)[1:5] == told[i][:4]
        assert tuple(r)[5:] == pytest.approx(told[i][4:], rel=1e-9)


# 7


def test_near_duplicates(docs, corpus):
    found = by_id(simhash.near_duplicates(docs))
    assert {i: r.class_id for i, r in found.items()} == brute.near_classes(corpus)
    assert all(r.kept == (i == r.class_id) for i, r in found.items())
    sizes = {}
    for r in found.values():
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_docs == sizes[r.class_id] for r in found.values())


def test_near_duplicates_in_oversized_buckets(docs, corpus):
    found = by_id(simhash.near_duplicates(docs, cap=4))
    assert {i: r.class_id for i, r in found.items()} == brute.near_classes(corpus)


def test_buckets_somewhat_above_the_cap_lose_no_pair():
    """They are compared as a whole; much larger ones are split."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2, (1000, simhash.BITS), dtype=np.uint8)
    other = one.copy()
    for row in other:
        row[rng.choice(simhash.BITS, simhash.DISTANCE, replace=False)] ^= 1
    bits = np.packbits(np.concatenate([one, other]), axis=1)
    ids, found = np.arange(len(bits)), set()
    for g in simhash._groups(bits, 7, 512):
        pairs, left = simhash.candidates(ids[g], np.ascontiguousarray(bits[g]).view(np.uint64), None)
        found |= {(a, b) for a, b, apart in pairs.tolist() if apart == simhash.DISTANCE}
        assert not left
    assert found >= {(k, 1000 + k) for k in range(1000)}
    assert max(map(len, simhash._groups(np.concatenate([bits] * 4)[:7000], 7, 512))) < 2000


def test_members_of_large_groups_name_their_nearest():
    rng = np.random.default_rng(4)
    plain = rng.integers(0, 2, (6, simhash.BITS), dtype=np.uint8)[rng.integers(0, 6, 600)] ^ (rng.random((600, simhash.BITS)) < 0.09)
    ids = rng.permutation(600) * 7
    pairs, left = simhash.candidates(ids, np.packbits(plain, axis=1).view(np.uint64), None)
    told = set()
    for r in range(600):
        apart = (plain[:r] != plain[r]).sum(axis=1).tolist()
        told |= {(min(ids[r], ids[c]), max(ids[r], ids[c]), x) for x, c in sorted((x, c) for c, x in enumerate(apart) if x <= simhash.DISTANCE)[: simhash.NEAREST]}
    assert left and set(map(tuple, pairs.tolist())) == told and len(pairs) == len(told)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, text), (7, text), (8, "other words entirely here now")]
    found = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_sets_are_linked_exactly(spark):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(16)] for _ in range(60)]
    texts = []
    for words in base:
        for n in range(8, 16):
            texts.append(" ".join(words[:n]))  # 4 to 11 shingles
        for _ in range(3):
            other = words[: rng.randrange(9, 16)]
            other[0 if rng.random() < 0.5 else -1] = f"z{rng.randrange(99)}"
            texts.append(" ".join(other))
    rows = list(enumerate(texts))
    found = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tables=1, distance=-1))  # nothing but the exact links
    assert {i: r.class_id for i, r in found.items()} == brute.near_classes(rows)


@pytest.mark.parametrize("small,large", [(4, 5), (8, 10), (12, 15), (16, 20), (40, 50), (200, 250)])
def test_recall_at_the_threshold_by_size(spark, small, large):
    """Pairs at a similarity of 0.8, the hardest that count: for each size of sets more than 0.985 of 500 are linked."""
    rng = random.Random(small)
    rows = []
    for k in range(500):
        words = [f"w{rng.randrange(10**7)}" for _ in range(large + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: small + 4]))]
    found = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    linked = sum(found[2 * k + 1].class_id == 2 * k for k in range(500))
    assert linked >= 0.985 * 500 and len({r.class_id for r in found.values()}) == 1000 - linked


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 330)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_shingles_match_the_plain_ones(corpus):
    texts = [t or "" for _, t in corpus]
    for text, found in zip(texts, shingles.text_shingles(texts)):
        assert len(found) == len(brute.shingles(text))


# 8


def test_token_counts(docs, corpus):
    odd = corpus + [(200, "a <|endoftext|>b  <|endoftext|>"), (201, "\x1c x\x85y　z  \n\n q"), (202, "it's we'll 12 34")]
    frame = docs.sparkSession.createDataFrame(odd, "doc_id long, text string")
    for rows in (0, 4000):
        found = by_id(token_counts.token_counts(frame, table_rows=rows or 1, limit=100))
        for i, text in odd:
            n = len(brute.encoded(text))
            assert tuple(found[i]) == (i, len((text or "").encode()), n, n > 100)
    assert token_counts.token_counts(frame.limit(0)).count() == 0


ODD = ["a", " ", "  ", "\n", "foo", "é", "'s", "'", "don't", "\u00a0", "\u3000", "\u2003", "<|endoftext|>", "<|", "3", "...", ",", "\x1c", "\x85", "\t", "\r\n", "漢字", "Ω", "_", "#"]


@pytest.mark.parametrize("most", [50, 500_000])
def test_units_are_those_of_the_library(corpus, most):
    rng = random.Random(9)
    texts = [t or "" for _, t in corpus] + ["".join(rng.choices(ODD, k=rng.randrange(25))) for _ in range(3000)] + ["x" * 1_200_000 + " y", "ab, " * 300_000]
    encode, count = units.UnitEncoder(units.default_path(), most=most), units.UnitEncoder(units.default_path(), counts=True, frequent=([b" foo", b"a"], [1, 1]), most=most)
    for i in range(0, len(texts), 500):
        told = [brute.encoded(t) for t in texts[i : i + 500]]
        lengths, ids = encode(pa.array(texts[i : i + 500]))
        assert lengths.tolist() == [len(t) for t in told] and ids.tolist() == [x for t in told for x in t]
        assert count(pa.array(texts[i : i + 500]))[0].tolist() == lengths.tolist()


def test_units_whose_hashes_collide(corpus, monkeypatch):
    monkeypatch.setattr(units.UnitEncoder, "_hashes", staticmethod(lambda buf, starts, ends: (ends - starts).astype(np.uint64)))
    encode = units.UnitEncoder(units.default_path())
    for _, text in corpus[6:30] + corpus[6:30]:
        assert encode(pa.array([text]))[1].tolist() == brute.encoded(text)


def test_token_counts_of_other_tokenizers(spark, corpus):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    frame = spark.createDataFrame(corpus[:40], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame, path).collect()} == {i: len(plain.encode(t or "")) for i, t in corpus[:40]}
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame, path).collect()} == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in corpus[:40]}


def test_token_counts_with_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "three"), (1, "three"), (2, None)]
    found = token_counts.token_counts(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in found))) == sorted(map(repr, ((i, len(brute.encoded(t))) for i, t in rows)))


# 9


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "é" * (i % 4) + "</p>\r\n\r\nWARC/1.1\r\n") for i in range(20)] + [(20, None, None), (21, "u", ""), (22, "u", "alone" * 5000)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_warc(pages):
    import base64

    rows, frame = pages
    found = {r.page_id: r for r in warc.round_trip(frame).collect()}
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(i, best.get(html or "", -1))
    for i, _, html in rows:
        raw, top = (html or "").encode(), best[html or ""]
        assert tuple(found[i]) == (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)


def test_warc_pushes_predicates_and_skips_payloads(spark, pages):
    rows, frame = pages
    place = shared_place(spark, "warc")
    warc.archive_pages(frame, place)
    every = warc.read_archives(spark, place)
    some = every.where("record_type = 'response' AND target_uri = 'http://h/19'")
    # What the source takes over is no filter of the plan any more.
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "response" not in plan and "h/19" not in plan
    assert [(r.target_uri, bytes(r.payload).decode()) for r in some.collect()] == [("http://h/19", rows[19][2])]
    assert every.where("record_type in ('revisit')").count() + every.where("record_type = 'response'").count() == len(rows)
    assert warc.read_archives(spark, place, payloads=False).where("payload is not null").count() == 0
    reader = warc._Reader({"path": place})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert got and all(r["record_type"] == "revisit" for r in got)
    empty = shared_place(spark, "warc")
    warc.archive_pages(frame.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_query_reads_through_its_predicates(pages):
    plan = warc.round_trip(pages[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "= response" not in plan and "= revisit" not in plan


def test_warc_urls_cannot_break_headers(spark):
    urls = ["http://h/a\r\nWARC-Type: revisit", "http://h/b\r\n\r\nWARC/1.1\r\n", "\n", " spaces ", "", None, "http://h/%0D%0Aé", "a\tb\x7f\x00", "http://h/\x85"]
    frame = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)] + [(None, "x", "null id"), (5, "y", "twice"), (5, "y", "twice")], "page_id long, url string, html string")
    place = shared_place(spark, "warc")
    warc.archive_pages(frame, place)
    read = warc.read_archives(spark, place)
    found = read.collect()
    assert sorted(map(repr, (r.target_uri for r in found))) == sorted(map(repr, [*urls, "x", "y", "y"]))
    assert all(r.record_type == "response" and r.refers_to is None for r in found)
    assert [bytes(r.payload) for r in read.where(F.col("target_uri") == urls[0]).collect()] == [b"<p>0</p>"]
    assert sorted(map(repr, (r.page_id for r in warc.round_trip(frame).collect()))) == sorted(map(repr, [*range(len(urls)), None, 5, 5]))
    with pytest.raises(ValueError):
        warc.record("urn:a\r\nX: y", None, b"", None)
    words = spark.createDataFrame([("a b\r\n", "u", "same"), ("z%", "u", "same")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(words).collect()} == {("a b\r\n", "z%"), ("z%", None)}


@pytest.mark.parametrize("packed", [True, False])
def test_warc_from_elsewhere(spark, tmp_path, packed):
    import gzip

    body = b"software: hand\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    page = b"<p>" + b"long " * 40_000
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + page
    response = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r>\r\nWARC-Target-URI: http://h/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    records = [info, response, info]
    for k in (1, 2):
        (tmp_path / f"{k}.warc{'.gz' * packed}").write_bytes(b"".join(map(gzip.compress, records)) if packed else b"".join(records))
    read = warc.read_archives(spark, str(tmp_path))
    assert [(r.record_type, r.payload_bytes, bytes(r.payload)) for r in read.orderBy("payload_bytes").collect()] == [("warcinfo", len(body), body)] * 4 + [("response", len(page), page)] * 2
    assert read.where("record_type = 'response'").count() == 2
    headers = warc.read_archives(spark, str(tmp_path), payloads=False).where("record_type = 'response'").collect()
    assert [(r.record_id, r.payload_bytes, r.payload) for r in headers] == [("urn:r", len(page), None)] * 2


def test_warc_without_compression_and_small_payloads(spark, pages):
    rows, frame = pages
    place = shared_place(spark, "warc")
    spark.dataSource.register(warc.WarcSource)
    told = frame.select(F.col("url").alias("record_id"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("refers_to"), F.col("html").cast("binary").alias("payload")).where("url is not null")
    told.write.format("warc").mode("append").option("path", place).option("compression", "none").option("stretchbytes", "400").save()
    found = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, place).collect()}
    assert found["http://h/7"] == rows[7][2].encode()
    big = warc.round_trip(frame, least_bytes=10**6).collect()
    assert all(r.record_type == "response" for r in big)


# 10


def test_quality_rules(spark, docs, corpus):
    import duckdb

    rows = [(i, t, None if i % 7 == 0 else f"host{i % 3}") for i, t in corpus]
    rows += [(1000 + i, "Home page of the host\n" * (1 + i % 2) + f"words {i} " * 15 + "\n" + "x y z w v u t s r " * (i % 3), "hostA") for i in range(40)]
    frame = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, source string, host string, n int")
    found = line_rules.quality_rules(frame)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    told = connection.execute(line_rules.ORACLE)
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(told.fetchall())
    assert any(r.removed_words for r in found.collect())
    assert line_rules.quality_rules(frame.limit(0)).count() == 0


def test_quality_rules_run_in_the_jvm(docs):
    plan = line_rules.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
