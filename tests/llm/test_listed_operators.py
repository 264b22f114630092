"""Exact duplicates, spelling variants and the manifest, against brute force on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultgauge.llm import exact_dedup, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, row string, n long, tree long, word string"


def frame(spark, rows):
    """(doc_id, text, source) with further columns whose names the operators use themselves."""
    full = [(i, t, None if (i or 0) % 5 == 0 else "en", s, None if t is None else len(t), 1, "d", "r", 2, 3, "w") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact duplicates -------------------------------------------------------------------------------

COPIES = (
    [(i, "the same again", "a") for i in range(300)] + [(i, f"text {i % 40}", "a") for i in range(300, 420)]
    + [(500, None, None), (501, "", "a"), (502, " ", "a"), (503, "x" * 200_000, "b"), (504, "x" * 200_000, "b")]
    + [(None, "no id", "a"), (None, "text 3", "a"), (None, "no id", "a"), (505, "twice", "a"), (505, "twice", "a"), (505, "once", "a")]
)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_groups_of_equal_texts(spark, counters):
    groups = defaultdict(list)
    for i, t, _ in COPIES:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        stays = max((i for i in ids if i is not None), default=None)
        want += [(i, stays, len(ids), sha(t)) for i in ids]
    got = exact_dedup.groups(frame(spark, COPIES), counters=counters).collect()
    assert by_row(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_equal_after_normalising_and_what_stays(spark):
    rows = [(1, "Ab", "s"), (2, "aB ", "s"), (3, "c", "s"), (4, "c", "s")]
    docs = frame(spark, rows)
    stays = exact_dedup.deduplicated(docs, normalise=lambda c: F.lower(F.trim(c)))
    assert sorted(r.doc_id for r in stays.collect()) == [2, 4] and stays.columns == docs.columns
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == [1, 2, 4]


def test_no_copies_of_nothing(spark):
    assert exact_dedup.groups(frame(spark, COPIES).filter("false")).collect() == []


def test_counters_keep_every_frequent_digest(spark):
    rnd = random.Random(4)
    for counters in (1, 2, 5, 20):
        values = [b"%d" % int(rnd.paretovariate(0.6)) for _ in range(4000)]
        held = {}
        for start in range(0, len(values), 150):
            held = exact_dedup.add(held, Counter(values[start : start + 150]), counters)
        exact = Counter(values)
        assert len(held) <= counters
        assert all(exact[v] - len(values) / (counters + 1) <= n <= exact[v] for v, n in held.items())
        frequent = {v for v, n in exact.items() if n > len(values) / (counters + 1)}
        assert frequent <= set(held)
        digests = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(5)
        found = {bytes(r.digest) for r in exact_dedup.candidates(digests, counters).collect()}
        assert frequent <= found and len(found) <= counters


# --- spelling variants ------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows):
    counted = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def spelled(seed):
    """Words, and what edits make of them, in counts that lead from rare to frequent ones."""
    rnd = random.Random(seed)
    letters = "abcdeéèÿ×÷ÀÉ"
    rows, doc = [], 0
    for _ in range(25):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9)))
        n = rnd.choice([5, 30, 160])
        while n >= 5:
            rows.append((doc, " ".join([word] * n) + "\n", "s"))
            doc += 1
            k, n = rnd.randrange(len(word)), n // rnd.choice([3, 5, 6])
            word = rnd.choice([word[:k] + word[k + 1 :], word[:k] + rnd.choice(letters) + word[k:], word[:k] + rnd.choice(letters) + word[k + 1 :]])
    return rows


SPELLED = spelled(5) + [
    (None, "Strange STRANGE strange strange strange strangé strangé strangé strangé strangé", "s"), (9001, None, "s"), (9002, "", "s"),
    (9003, "no word here: a b c 123 456", "s"), (9004, " ".join(["q" * 3000] * 30 + ["q" * 3001] * 6 + ["q" * 2998 + "rq"] * 5), "s"),
    (9005, "aaaaaa " * 50 + "aaaaaaa " * 10 + "aaaaaab " * 8, "s"), (9005, "aaaaaa " * 50 + "aaaaaaa " * 10 + "aaaaaab " * 8, "s"),
    (9006, "tie one" + " abcdefg" * 60 + " abcdefh" * 60 + " abcdef" * 7, "s"), (9007, "日本語 слово ελληνικά", "s"),
] + [(10_000 + k, "sometimes", "s") for k in range(12_000)]


@pytest.mark.parametrize("symbols", [1, 2, 6, 30])
def test_variants(spark, symbols):
    want = expected_variants(SPELLED)
    got = by_row(spelling.variants(frame(spark, SPELLED), symbols=symbols).collect(), "word", "form", "root", "n", "n_near", "form_n")
    assert got == want
    assert {w for w, *_ in want} >= {"strangé", "q" * 3001, "aaaaaab", "abcdef"}
    # letters that were deleted, and a chain of forms
    assert any(w != "sometimes" and root == "sometimes" for w, _, root, *_ in want)
    assert any(form not in (None, root) for _, form, root, *_ in want)


def test_no_words(spark):
    nothing = frame(spark, SPELLED).filter("false")
    assert spelling.variants(nothing).collect() == []
    assert spelling.variants(frame(spark, [(1, None, "s"), (2, "", "s")])).collect() == []


@pytest.mark.parametrize("symbols,length", [(1, 1), (2, 6), (3, 5), (6, 4)])
def test_neighbourhoods_are_whole_and_without_repeats(symbols, length):
    rnd = np.random.default_rng(6)
    forms = rnd.integers(1, symbols + 1, (20, length)).astype(np.uint8)

    def value(form):
        return sum(int(s) * pow(int(spelling.BASE), t, 1 << 64) for t, s in enumerate(form)) % (1 << 64)

    own, pairs = spelling.neighbourhoods(forms, symbols)
    alphabet = range(1, symbols + 1)
    for form, code in zip(forms.tolist(), own.tolist()):
        assert code == value(form)
        around = {tuple(form)} | {tuple(form[:i] + form[i + 1 :]) for i in range(length)}
        around |= {(*form[:i], s, *form[i + 1 :]) for i in range(length) for s in alphabet}
        around |= {(*form[:i], s, *form[i:]) for i in range(length + 1) for s in alphabet}
        made = pairs[1][pairs[0] == code].tolist()
        repeats = sum((forms == form).all(axis=1))
        assert sorted(made) == sorted([value(a) for a in around] * repeats)


# --- manifest ---------------------------------------------------------------------------------------


def tree_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def postorder(levels):
    log, where = [], {}

    def visit(level, i):
        if level:
            for j in range(3 * i, min(3 * i + 3, len(levels[level - 1]))):
                visit(level - 1, j)
        where[level, i] = len(log)
        log.append(levels[level][i])

    visit(len(levels) - 1, 0)
    return log, where


def path_of(levels, i):
    path = []
    for nodes in levels[:-1]:
        start = i - i % 3
        path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 3])))
        i //= 3
    return path


def encoded(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected_proofs(rows):
    """From (doc_id, source, lang, n_chars, text) rows; every second text is presented without its line ends."""
    by_source = defaultdict(list)
    for i, s, lang, n, t in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        shown = t.replace("\n", "") if tampered and t is not None else t
        by_source[s].append((i, encoded((i, s, lang, n, t)), encoded((i, s, lang, n, shown))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree_of(r[1] for r in by_source[s])
    upper = tree_of(trees[s][-1][0] for s in order)
    out = []
    for k, s in enumerate(order):
        for j, (i, leaf, shown) in enumerate(by_source[s]):
            path = path_of(trees[s], j) + path_of(upper, k)
            node = shown
            for left, right in path:
                node = sha(left + node + right)
            root = upper[-1][0]
            out.append((i, leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr), {s: postorder(t)[0] for s, t in trees.items()}


PROOF_COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def prove(docs):
    lost = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build(docs, presented={"text": lost})
    return manifest, by_row(merkle.proofs(manifest).collect(), *PROOF_COLUMNS)


LINES = (
    [(i, f"line {i}\nline" if i % 3 else f"line {i}", "hot") for i in range(800)]
    + [(1000 + i, f"t\n{i}", f"s{i % 5}é") for i in range(23)]
    + [(2000, None, "alone"), (2001, "", None), (2002, "x\n", None), (None, "no\nid", "hot"), (None, None, None), (3, "same id\n", "hot")]
    + [(2003, "again\n", "twice"), (2003, "again\n", "twice"), (2004, "y" * 300_000 + "\n", ""), (-5, "negative\n", "hot")]
)


def test_proofs(spark):
    docs = frame(spark, LINES)
    want, logs = expected_proofs([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    manifest, got = prove(docs)
    assert got == want
    assert {r[-1] for r in got} == {True, False}
    # the whole log of every source, in the order of completion
    found = defaultdict(dict)
    for r in merkle.nodes(manifest).collect():
        assert found[r.source].setdefault(r.position, r.digest) == r.digest
    assert {s: [d[p] for p in range(len(d))] for s, d in found.items()} == logs


@pytest.mark.parametrize("rows", [[(7, "one\n", "a")], [(7, "a\n", "a"), (8, "b\n", "b")], [(i, "x", f"s{i}") for i in range(300)]])
def test_few_leaves_and_many_sources(spark, rows):
    docs = frame(spark, rows)
    want, _ = expected_proofs([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert prove(docs)[1] == want


def test_nothing_to_prove(spark):
    assert prove(frame(spark, LINES).filter("false"))[1] == []


def test_positions_and_blocks():
    for n in [*range(1, 60), 80, 81, 82, 243]:
        leaves = [sha(str(i)) for i in range(n)]
        levels = tree_of(leaves)
        log, where = postorder(levels)
        assert merkle.append(leaves, True) == log and merkle.levels_of(log, n, True) == levels
        for level, nodes in enumerate(levels):
            assert merkle.position(n, level, np.arange(len(nodes))).tolist() == [where[level, i] for i in range(len(nodes))]
        high = merkle.levels_of(merkle.append(leaves, False), n, False)
        assert len(high) == merkle.LEVELS + 1 and high[: len(levels)] == levels
