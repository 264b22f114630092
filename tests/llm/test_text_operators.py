"""Encoding, fingerprints, repeated strings, near copies, quality and mixing, against brute force on awkward rows."""

import base64
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from faultgauge.llm import bpe, difference_cover, mixing, order_minhash, quality, suffix_dedup, syncmers
from faultgauge.llm.ordering import placed

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, row string, kept string, rate double"


def prose(seed: int, words: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aeioubdklmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(words)]


BASE = prose(1, 220)
NEAR = [w if i % 23 else "changed" for i, w in enumerate(BASE)]
PASSAGE = " ".join(prose(2, 120))
ROWS = [
    (1, " ".join(BASE)), (2, " ".join(NEAR)), (3, " ".join(BASE)), (4, None), (5, ""), (6, " "), (7, "one two"),
    (8, " ".join(prose(3, 90)) + " " + PASSAGE + " " + " ".join(prose(4, 40))), (9, PASSAGE + " " + " ".join(prose(5, 300))),
    (10, "a" * 3000), (11, "é" * 500 + "日本語 " * 300), (12, "In. " * 400), (None, " ".join(prose(6, 50))),
    (13, "x  y\n\n z\t'll 123 !?"), (1, " ".join(BASE)), (14, "tail " + PASSAGE[5:]), (15, " ".join(prose(7, 4000))),
    (16, "🙂 naïve   　 café " * 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", None if t is None else len(t), 7, "r", "k", 0.5) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("doc_id < 0")


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


# --- byte pairs -------------------------------------------------------------------------------------


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(docs):
    library = reference()
    got = by_row(bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_encoding_nothing(nothing):
    assert bpe.encode(nothing, PATH, public_tokenizers.PATTERN).collect() == []


def test_pieces_of_random_text():
    library, encoder, rnd = reference(), bpe.Encoder(PATH, public_tokenizers.PATTERN), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "22", "'s", "'re", "!!", "日本", " \n ", " ", "😀", "the", "aaa", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice("aehtin") for _ in range(20000)), "ab" * 9000]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.vocabulary.decode(ids) == text.encode()


def test_bitmap_pops_the_least():
    rnd, bits, held = random.Random(3), bpe.Bitmap(70_000), set()
    for _ in range(5000):
        if rnd.random() < 0.6 or not held:
            x = rnd.randrange(70_000)
            bits.add(x)
            held.add(x)
        else:
            assert bits.pop() == min(held)
            held.remove(min(held))
    while held:
        assert bits.pop() == min(held)
        held.remove(min(held))
    assert bits.pop() == -1


# --- fingerprints -----------------------------------------------------------------------------------


@pytest.mark.parametrize("pieces", [1, 7])
def test_fingerprints(docs, pieces):
    got = syncmers.fingerprints(docs, pieces).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(syncmers.fingerprint, (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.as_text(a), syncmers.as_text(b),
                     syncmers.likeness(a, b), syncmers.likeness(a, c)))
    names = [c.split()[0] for c in syncmers.SCHEMA.split(", ")]
    assert by_row(got, *names) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_likeness_of_equal_half_and_other_texts():
    a, b = " ".join(BASE), " ".join(prose(8, 220))
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    f = syncmers.fingerprint
    assert syncmers.likeness(f(a), f(a)) == 1 and syncmers.likeness(f(a), f(b)) == 0
    assert 0.3 < syncmers.likeness(f(a), f(half)) < 0.7
    assert syncmers.likeness(f(""), f("")) == 1 and syncmers.likeness(f(""), f("x")) == 0 and syncmers.as_text(f("")) == ""


def test_anchors_by_hand():
    """Each place of a text in turn: the least of 17 hashes of eight bytes stands first or last."""
    data = (" ".join(prose(31, 400)) + "é日本 " * 20).encode()
    hashes = [int(syncmers.mix(np.array([int.from_bytes(data[i : i + 8], "little")], np.uint64))[0]) for i in range(len(data) - 7)]
    want = {}
    for i in range(len(data) - 23):
        window = hashes[i : i + 17]
        if min(window) in (window[0], window[-1]):
            want.setdefault(data[i : i + 24], i)
    found, at = syncmers.anchors(data)
    assert sorted(at.tolist()) == sorted(want.values()) and found.tolist() == sorted(found.tolist())
    all_below = [(h, p) for h, p in zip(found.tolist(), at.tolist()) if h < syncmers.LIMIT]
    kept = list(zip(*syncmers.fingerprint(data.decode())))
    assert kept[: len(all_below)] == all_below and len(kept) == max(syncmers.ANCHORS, len(all_below))


def test_a_short_shared_passage_of_long_texts_is_seen():
    passage = prose(40, 600)
    for seed in range(3):
        a, b = (prose(50 + 2 * seed + k, 20_000) for k in (0, 1))
        a[5_000:5_600] = b[11_000:11_600] = passage
        prints = [syncmers.fingerprint(" ".join(t)) for t in (a, b)]
        assert 0.01 < syncmers.likeness(*prints) < 0.08
        assert all(len(p[0]) > 500 for p in prints)


def test_anchors_depend_on_nothing_around_them():
    data = " ".join(prose(9, 60)).encode()
    inner = set(syncmers.anchors(data)[0].tolist())
    assert inner <= set(syncmers.anchors(b"before " + data + b" after")[0].tolist())


def test_fingerprints_of_one_and_of_no_document(docs, nothing):
    one = syncmers.fingerprints(docs.filter("doc_id = 8"), 3).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert syncmers.fingerprints(nothing, 3).collect() == []


# --- repeated strings -------------------------------------------------------------------------------


def repeats_by_force(texts: list[str], length: int):
    windows: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            windows[d[i : i + length]] = windows.get(d[i : i + length], 0) + 1
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if windows[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("length", [400, 64])
def test_repeated_strings(docs, length):
    found = suffix_dedup.removed(docs, length=length).collect()
    got = sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr)
    want = [(i, *x) for (i, _), x in zip(ROWS, repeats_by_force([t for _, t in ROWS], length))]
    assert got == sorted(want, key=repr)


def test_repeats_between_many_variants(spark):
    """A passage with both edges near differences, in many texts: nearly every case of the comparison with neighbours."""
    rnd = random.Random(11)
    core = prose(12, 30)
    rows = []
    for i in range(60):
        words = list(core)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["da", "di", "do"])
        rows.append((i, " ".join(prose(100 + i, rnd.randint(0, 6)) + words + prose(200 + i, rnd.randint(0, 6)))))
    found = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), length=80).collect()
    got = sorted((r.row.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    assert got == [(i, *x[1:]) for (i, _), x in zip(rows, repeats_by_force([t for _, t in rows], 80))]


@pytest.mark.parametrize("length", [80, 400])
def test_repeats_where_anchors_are_dense(spark, length):
    """Runs of one or two characters, with an odd one here and there: windows reach over more anchors than the order tells apart."""
    rnd = random.Random(5)
    runs = ["=" * 3 * length, "-+" * (2 * length), "abc" * length, "0" * (length // 2) + "1" * (length // 2) + "0" * length]
    rows = []
    for i in range(48):
        run = list(runs[i % 4])
        for _ in range(rnd.randint(0, 3)):
            run[rnd.randrange(len(run))] = rnd.choice("=-+0")
        rows.append((i, " ".join([*prose(300 + i % 5, rnd.randint(0, 9)), "".join(run), *prose(400 + i % 7, rnd.randint(0, 9))])))
    texts = [t.encode() for _, t in rows]
    shape = suffix_dedup.Shape(length)
    assert any(np.bincount(suffix_dedup.anchors(t, shape)[0] // (length - shape.inner)).max() > 2 * suffix_dedup.DEPTH for t in texts)
    found = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    got = sorted((r.row.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    assert got == [(i, *x[1:]) for (i, _), x in zip(rows, repeats_by_force([t for _, t in rows], length))]


def test_deduplicated_texts(docs, nothing):
    kept = {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert 3 not in kept and 1 not in kept  # copies of one another
    assert kept[15].text == dict(ROWS)[15] and kept[4].text is None
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.values())
    assert suffix_dedup.deduplicated(nothing).collect() == []


def test_deduplicated_texts_take_one_python_step(docs):
    """A filter on what is left and the column of it come from one run of the function, and say what brute force says."""
    found = suffix_dedup.deduplicated(docs, 64)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    want = []
    for (i, text), (_, gone, _, kept) in zip(ROWS, repeats_by_force([t for _, t in ROWS], 64)):
        left = kept.decode("utf-8", "ignore") if gone else text
        if not gone or left.strip(" "):
            want.append((i, left))
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n,kinds", [(1, 1), (2, 1), (5, 2), (60, 1), (301, 3)])
def test_order_of_suffixes(spark, n, kinds):
    rnd = random.Random(n)
    s = [rnd.randint(1, kinds) for _ in range(n)]
    text = spark.createDataFrame(list(enumerate(s)), "pos long, symbol long")
    got = [p for _, p in sorted((r["rank"], r["pos"]) for r in difference_cover.ranks(text, n, n + 1).collect())]
    assert got == sorted(range(n), key=lambda i: s[i:])


def test_places_names_and_marks(spark):
    rows = [(i, i % 7 // 3, i % 5 == 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "i long, k long, m boolean").repartition(5)
    got = sorted(placed(frame, ["k"], ["i"], ["i", "k", "m"], "m", 6).collect(), key=lambda r: r.place)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r.i for r in got] == [r[0] for r in order] and [r.name for r in got] == [r[1] + 1 for r in order]
    assert [r.marked for r in got] == [sum(x[2] for x in order[:j]) for j in range(len(order))]


def test_pipeline_cuts_shared_passages_of_over_fifty_words(spark):
    rows, passages = [], []
    for i, words in enumerate(range(51, 64, 3)):
        passages.append(" ".join(prose(800 + i, words)))
        for j in (0, 1):
            own = [" ".join(prose(900 + 4 * i + 2 * j + k, 70)) for k in (0, 1)]
            rows.append((2 * i + j, f"{own[0]} {passages[i]} {own[1]}"))
    assert all(250 < len(p) < 400 for p in passages)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert len(kept) == len(rows)
    for i, text in rows:
        own = text.replace(passages[i // 2], "")
        # a shared space or letter beside the passage may go with it
        assert passages[i // 2][:100] not in kept[i] and len(own) - 8 <= len(kept[i]) <= len(own)


# --- near copies ------------------------------------------------------------------------------------


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return line[-1]


def test_alignment_equals_edit_distance():
    rnd, pairs, want = random.Random(4), [], []
    for _ in range(150):
        a = [rnd.randint(0, 30) for _ in range(rnd.randint(0, 50))]
        b = list(a)
        for _ in range(rnd.randint(0, 16)):
            if b and rnd.random() < 0.6:
                b[rnd.randrange(len(b))] = rnd.randint(0, 30)
            elif b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randint(0, len(b)), rnd.randint(0, 30))
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        want.append(distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert order_minhash.similar(pairs).tolist() == want


def test_classes(docs, nothing):
    got = {}
    for r in order_minhash.classes(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.n_class))
    assert got[1] == got[2] == got[3] == {(1, 4)}
    assert got[4] == got[5] == {(4, 2)} and got[None] == {(None, 1)}
    assert all(got[i] == {(i, 1)} for i in (6, 7, 8, 9, 10, 11, 12, 13, 15))
    assert order_minhash.classes(nothing).collect() == []


def test_one_of_each_class_stays(docs):
    kept = order_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        [1, 4, 6, 7, 8, 9, 10, 11, 12, None, 13, 14, 15, 16], key=repr
    )


def test_recall_of_near_copies(spark):
    """Every pair with a k-mer overlap of 0.5 or more whose alignment passes ends in one class; others stay apart."""
    rnd, rows = random.Random(5), []
    for g in range(40):
        base = prose(300 + g, 150)
        rows.append((3 * g, " ".join(base)))
        for v in (1, 2):
            rows.append((3 * g + v, " ".join(w if rnd.random() > 0.03 * v else "other" for w in base)))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 3 * 3 for i in range(120)}


def test_star_of_edits_is_one_class(spark):
    """Edits that align with one text but not with each other: every one that shares a sketch with it is of its class."""
    rnd, base = random.Random(6), prose(700, 300)
    texts = [base] + [[w if rnd.random() > 0.12 else f"new{rnd.randrange(10**9)}" for w in base] for _ in range(250)]
    hashes = [order_minhash.word_hashes(" ".join(t)) for t in texts]
    drawn = [order_minhash.sketches(h) for h in hashes]
    fits = order_minhash.similar([(hashes[0], h) for h in hashes])
    want = {i for i in range(len(texts)) if fits[i] and (drawn[i] == drawn[0]).any()}
    assert len(want) > 200
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(rows).collect()}
    assert {got[i] for i in want} == {0}


def test_bags_rule_out_only_what_cannot_align():
    rnd = random.Random(7)
    a = [np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 50))], np.uint64) for _ in range(300)]
    b = [np.array([w if rnd.random() > rnd.choice([0.1, 0.2, 0.5]) else rnd.randrange(60) for w in x], np.uint64) for x in a]
    fine = order_minhash.may_align([order_minhash.bag(x) for x in a], [order_minhash.bag(x) for x in b])
    assert fine[order_minhash.similar(list(zip(a, b)))].all() and not fine.all()
    assert order_minhash.may_align([b"", b""], [order_minhash.bag(a[0]), b""]).all()


# --- quality ----------------------------------------------------------------------------------------


def test_weak_labels(spark, docs):
    clean = [" ".join(["the", "of"] + prose(400 + i, 60) + ["and", "to", "is", "in", "a", "that", "with", "as"]) + "." for i in range(60)]
    junk = [" ".join(f"{w}%%% |" for w in prose(500 + i, 60)).upper() for i in range(15)]
    again = [" ".join(w + ". " + w + ". " + w + ". " + w + ". " + w + "." for w in prose(600 + i, 25)) for i in range(15)]
    texts = clean + junk + again + [None, "", "  ", clean[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].accepted for i in range(60)) and not any(got[i].accepted for i in range(60, 93))
    assert got[93].score == got[0].score


def test_quality_keeps_columns_and_takes_no_rows(docs, nothing):
    assert quality.accepted(docs).columns == docs.columns
    assert quality.classify(nothing).collect() == []


def test_label_model_finds_who_is_right():
    counts = {"+++": 80, "--+": 12, "---": 6, "+-+": 4, "0++": 5, "000": 3}
    found = quality.label_model(counts)
    assert found["+++"] > 0.9 and found["0++"] > 0.8 and found["---"] < 0.1 and found["--+"] < 0.5


# --- mixing -----------------------------------------------------------------------------------------


def mixture(spark):
    rows, known = [], []
    for i in range(90):
        d = "a" if i % 3 else "b"
        rnd = random.Random(i)
        rows.append((i, " ".join(rnd.choice([f"{d}{k}" for k in range(20)]) for _ in range(40 + i % 17))))
        if i % 2:
            known.append((i, d))
    rows += [(90, None), (91, ""), (5, rows[5][1])]
    return (
        spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, rate double, kept string"),
        spark.createDataFrame(known, "doc_id long, domain string"), rows,
    )


def test_rates_meet_the_targets(spark):
    docs, known, rows = mixture(spark)
    got = mixing.rates(docs, known, {"a": 0.5, "b": 0.5}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    assert (got.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows))
    for d in "ab":
        share = (got.n_tokens * got.rate * got[f"p_{d}"]).sum() / got.n_tokens.sum()
        assert share == pytest.approx(0.5, abs=1e-3)
    assert np.allclose(got.p_a + got.p_b, 1)
    # the same descent, row by row
    p, n = got[["p_a", "p_b"]].to_numpy(), got.n_tokens.to_numpy()
    goal = n.sum() * np.array([0.5, 0.5])
    eta = 1 / ((p.T * n @ p) / np.outer(goal, goal)).sum(axis=1).max()
    x = np.ones(len(n))
    for _ in range(mixing.ROUNDS):
        gap = (n * x @ p - goal) / goal
        if abs(gap).max() < mixing.CLOSE:
            break
        x = np.maximum(0, x - eta * (p @ (gap / goal)))
    assert np.allclose(x, got.rate, atol=1e-6)
    assert (abs(got.copies - got.rate) <= 1).all()


def test_mixed_rows_and_plan(spark):
    docs, known, rows = mixture(spark)
    out = mixing.mixed(docs, known, {"a": 0.5, "b": 0.5})
    assert out.columns == docs.columns
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) == {i for i, _ in rows} and len(ids) > len(rows)
    none = docs.filter("doc_id < 0")
    assert mixing.mixed(none, known, {"a": 0.5, "b": 0.5}).collect() == [] == mixing.rates(none, known, {"a": 0.5, "b": 0.5}).collect()


def test_mixing_without_labels(spark):
    docs, known, rows = mixture(spark)
    got = mixing.rates(docs, known.filter("doc_id < 0"), {"a": 0.5, "b": 0.5}).toPandas()
    assert np.allclose(got.p_a, 0.5) and len(got) == len(rows)


def test_small_domains_reach_their_targets(spark):
    rows = [(i, " ".join(f"{'b' if i % 1000 == 0 else 'a'}{(i + k) % 20}" for k in range(30))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, t[0]) for i, t in rows if i < 1100], "doc_id long, domain string")
    got = mixing.rates(docs, known, {"a": 0.85, "b": 0.15}, grow=True, least=1.0).toPandas()
    totals = [(got.n_tokens * got.rate * got[f"p_{d}"]).sum() for d in "ab"]
    assert totals[1] / sum(totals) == pytest.approx(0.15, rel=1e-3) and (got.rate >= 1).all()


def test_gaps_that_no_rates_close_are_told(spark):
    docs, known, rows = mixture(spark)
    with pytest.warns(UserWarning, match="targets are not met"):
        mixing.rates(docs, known.filter("doc_id < 0"), {"a": 0.9, "b": 0.1})


def test_one_of_each_exact_class_can_be_asked_for(docs, monkeypatch):
    asked = []

    def grouped(rows, exact=False):
        asked.append(exact)
        raise InterruptedError

    monkeypatch.setattr(order_minhash, "grouped", grouped)
    for exact in (False, True):
        with pytest.raises(InterruptedError):
            order_minhash.deduplicated(docs, exact=exact)
    assert asked == [False, True]


def class_ids(texts: list[str]) -> list[int]:
    """By brute force: pairs that share a sketch and align, and the chains of them."""
    words = [order_minhash.word_hashes(t) for t in texts]
    drawn = np.array([order_minhash.sketches(w) for w in words])
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if (drawn[i] == drawn[j]).any()]
    least = list(range(len(texts)))
    for (i, j), fine in zip(pairs, order_minhash.similar([(words[i], words[j]) for i, j in pairs])):
        if fine:
            x, y = sorted((least[i], least[j]))
            least = [x if c == y else c for c in least]
    return least


def copies_behind_a_passage() -> list[str]:
    """Pairs whose sketches agree in nothing but a passage that all texts have: after it, no five words of one are in the other."""
    common, texts = prose(800, 60), []
    for g in range(120):
        tail = prose(1000 + g, 40)
        texts += [" ".join(common + tail), " ".join(common + [w if i % 5 else f"new{g}" for i, w in enumerate(tail)])]
    return texts


def test_no_pair_of_a_bucket_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    monkeypatch.setattr(order_minhash, "TILE_TEXTS", 4)
    texts = copies_behind_a_passage()
    want = class_ids(texts)
    assert 120 <= len(set(want)) < 125
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()} == dict(enumerate(want))


def test_unlike_members_of_a_bucket_meet_in_a_cell(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    rnd = random.Random(8)
    rows = [(b, 10 * b + i, rnd.choice([0, 0, 0, 1, 1, 2, 3, 10 * b + i])) for b, n in enumerate([2, 4, 5, 9, 40]) for i in range(n)]
    rows = [(b, sum(r[0] == b for r in rows), 1000 * b + node, component) for b, node, component in rows]
    found = {}
    for r in order_minhash.cells(spark.createDataFrame(rows, "bucket long, n long, node long, component long")).collect():
        found.setdefault(r.cell, []).append(r)
    met = {
        (x.node, y.node) for c in found.values() for x in c for y in c
        if x.node < y.node and x.component != y.component and (x.side != y.side or x.side == 2)
    }
    assert met == {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and x[3] != y[3]}
    assert max(map(len, found.values())) < 40


def test_unlike_pairs_equal_brute_force():
    rnd = random.Random(9)
    texts = [np.array([rnd.randrange(40) for _ in range(rnd.randint(1, 40))], np.uint64) for _ in range(60)]
    texts += [np.array([w if rnd.random() > 0.1 else rnd.randrange(40) for w in t], np.uint64) for t in texts]
    texts.sort(key=len)
    node = np.array(rnd.sample(range(10_000), len(texts)))
    component = np.array([rnd.choice([n, 1, 2]) for n in node])
    side = np.array([rnd.choice([0, 1, 2]) for _ in texts])
    # a bag that does not hold the counts rules nothing out
    bags = [order_minhash.bag(t) if i % 7 else b"" for i, t in enumerate(texts)]
    got = order_minhash.unlike_pairs(node, np.array([len(t) for t in texts]), component, side, bags)
    want = {
        (min(node[i], node[j]), max(node[i], node[j])) for j in range(len(texts)) for i in range(j)
        if component[i] != component[j] and (side[j] == 2 or side[i] != side[j]) and len(texts[i]) >= (0.8 - 1e-9) * len(texts[j])
        and order_minhash.may_align([bags[i]], [bags[j]])[0]
    }
    assert len(got) == len(want) > 20 and set(map(tuple, got.tolist())) == want


def test_edits_of_any_size_are_counted():
    rnd = random.Random(10)
    for _ in range(200):
        a, b = ([rnd.randint(0, 9) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        want, most = distance(a, b), rnd.randint(0, 40)
        got = order_minhash.edits(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got == want if want <= most else got > most
