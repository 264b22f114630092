"""Site trees, archives, exact search and the pipeline, against brute force on awkward rows."""

import base64
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from faultgauge.llm import queries, site_tree, topk, warc
from tools.check_sql import compare, connect

SF = "/root/testdata/sf0.001"

# --- main text --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<article><h1>Head &amp; tail</h1><p><b>First  <i>par</i>agraph<br>goes&nbsp;on<p>1 &lt; 2 &#233;&copy
<ul><li>one<li>two</ul><div class="comments"><p>me too</p></div><form>name <input></form></article>
<aside>more</aside><footer>&copy; us</footer>"""


def test_article():
    assert site_tree.main_text(PAGE, frozenset()) == "Head & tail\n\nFirst paragraph goes on\n\n1 < 2 é©\n\none\n\ntwo"


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<nav>x</nav>", ""), ("<div>a<span>b</span>c</div>d", "abc\n\nd"),
    ("x < y &amp; z", "x < y & z"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p>open <a href='>'>link", "open link"),
    ("<script>never ends", ""), ("<p " + "a='b' " * 2000 + ">t", "t"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<b>1<p>2</b>3</p>4", "1\n\n23\n\n4"), ("</p></div>x", "x"), ("<div role=navigation>x</div>y", "y"), ("<p>café   x</p>", "café x"),
])
def test_pages(html, text):
    assert site_tree.main_text(html, frozenset()) == text


def site(n):
    rows = []
    for i in range(n):
        rnd = random.Random(i)
        body = " ".join(rnd.choice(["red", "green", "blue", "stone", "river"]) + str(rnd.randrange(99)) for _ in range(30))
        rows.append((i, f"http://Host.example/{i}", f"<body><div class=q>Same on all {i % 2}</div><div class=z><p>{body}</p></div></body>", "x"))
    return rows[:n] + [(100, None, None, "x"), (101, "::bad", "<p>alone</p>", "x"), (102, "http://[", "", "x"), (1, *rows[1][1:])]


@pytest.mark.parametrize("small", [site_tree.SMALL_TREE, 0])
def test_branches_that_say_the_same_go(spark, small):
    rows = site(30)
    got = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), small).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all("Same" not in text[i] and text[i] == rows[i][2].split("<p>")[1].split("</p>")[0] for i in range(30))
    assert text[100] == text[102] == "" and text[101] == "alone" and all(r.n_chars == len(r.text) for r in got)


def test_importance_is_entropy(spark):
    rows = [("h", 1, p, p % 4, 0) for p in range(16)] + [("h", 2, p, p, p % 2) for p in range(16)] + [("h", 3, 0, 5, 5)]
    got = {r.path: r for r in site_tree.importance(spark.createDataFrame(rows, "host string, path long, page long, content long, layout long")).collect()}
    assert got[1].importance == pytest.approx(0.9 * 0.5) and got[2].importance == pytest.approx(0.9 + 0.1 * 0.25)
    assert got[3].importance == 1 and got[1].pages == 16


def test_few_pages_keep_everything_and_no_pages_give_none(spark):
    frame = spark.createDataFrame(site(3)[:3], "page_id long, url string, html string, text string")
    assert all("Same" in r.text for r in site_tree.extract(frame).collect())
    assert site_tree.extract(frame.filter("page_id < 0")).collect() == []


# --- archives ---------------------------------------------------------------------------------------


def test_merge_equals_sorting():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_members_and_offsets():
    parts = [b"", b"a" * 3_000_000, b"x\r\n\r\ny", b"z"]
    packed = [warc.packed(p) for p in parts]
    found = list(warc.members(io.BytesIO(b"".join(packed))))
    assert [d for _, d in found] == parts and [at for at, _ in found] == [sum(map(len, packed[:i])) for i in range(4)]


def test_url_keys():
    assert warc.url_key("https://www.A.example.com:8080/B?c=1#d") == "com,example,a:8080)/b?c=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[") == ")http://["


def test_captures(spark):
    rows = [
        (4, "http://b.example/x", "same", 4), (2, "http://a.example/", "same", 9), (7, "http://a.example/", "same", 3), (3, None, None, 1),
        (5, "http://c.example/a b\r\nX: y", "", 1), (6, "http://a.example/", "other\r\n\r\nmore é", 3), (None, "http://d.example", "same", 2),
        (2, "http://a.example/", "same", 9), (8, "http://e.example/long", "l" * 5000, 2),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, t long").withColumn("captured", F.timestamp_seconds("t"))
    got = warc.capture_index(frame.withColumn("payload", F.lit("clash")), archive_bytes=20).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = sorted(
        ((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
          "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h, _ in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want
    order = [(r.url_key, r.captured, r.page_id or -1, r.archive, r.offset) for r in got]
    assert order == sorted(order) and len({r.archive for r in got}) > 1
    assert warc.capture_index(frame.filter("t < 0")).collect() == []


def test_damaged_record_is_refused():
    from datetime import datetime, timezone

    data = warc.record(1, "http://a", datetime(2020, 1, 1, tzinfo=timezone.utc), b"hello", 1, False)
    assert warc.entry("f", 0, data)[6] == 5
    with pytest.raises(ValueError, match="damaged"):
        warc.entry("f", 0, data.replace(b"hello", b"hallo"))


# --- exact search -----------------------------------------------------------------------------------


def best(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fine[(i, tuple(int(np.floor(64.0 * float(np.float32(x)))) for x in v))] = None
    out = []
    for q, qv in fine:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in fine if (c, cv) != (q, qv) and len(cv) == len(qv))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,blocks", [(5, (16_384, 1_024)), (20, (40, 3))])
def test_search(spark, monkeypatch, k, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=40)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 230)]  # ties
    rows += [(300, None), (320, []), (340, [float("nan")] * 40), (360, [float("inf")] * 40), (380, [None] * 40), (None, rows[1][1]),
             (400, [1.0, 2.0]), (401, [3.0, -1.0]), rows[20], (40, rows[41][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best(rows, k)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).collect() == []


def test_large_components_are_added_as_integers():
    q = np.array([[2**30, 1]], np.int64)
    c = np.array([[2**30, 1], [2**30, 2]], np.int64)
    ids = np.array([1, 2], np.int64)
    found = topk.search(np.array([9]), np.array([0]), q, ids, ids, c, 2)
    assert found[3].tolist() == [2**60 + 2, 2**60 + 1] and found[2].tolist() == [2, 1]


# --- queries and pipeline ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    found = compare(queries.QUERIES[name](spark, SF).toArrow(), connect(SF).sql(queries.ORACLE[name]).to_arrow_table())
    assert found.startswith("ok") and "types" not in found, found


def test_registered():
    names = spark_entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
            clean = before.join(labels, "doc_id", "left_semi").count()
            assert docs.join(labels, "doc_id", "left_semi").count() >= 0.97 * clean
        if name == "near_copies":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] > counts[3] and counts[5] == counts[4]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_ids_of_any_size_in_archives(spark, tmp_path):
    rows = [(2**62 + 5, "http://h.org/a", "<p>x"), (-(2**61), "http://h.org/a", "<p>x"), (3 * 10**11, "http://h.org/b", None), (4, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in queries.QUERIES["op8_warc_index"](spark, str(tmp_path)).collect()}
    assert got == {-(2**61): ("response", None), 2**62 + 5: ("revisit", -(2**61)), 4: ("response", None), 3 * 10**11: ("revisit", 4)}


@pytest.mark.parametrize("part", ["<a ", "<a '", "<script ", "<!--", "<div>x", "<b>x", "</p", "<p>t<a "])
def test_odd_pages_take_time_in_proportion(part):
    import time

    def seconds(n):
        began = time.process_time()
        site_tree.main_text(part * n, frozenset())
        return time.process_time() - began

    # sixteen times the page: the square would be 256 times the time
    assert seconds(32_000) < 60 * max(seconds(2_000), 0.005)
