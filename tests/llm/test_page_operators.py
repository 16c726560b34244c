"""Page, vector and archive operators, the pipeline and the optional registration."""

import base64
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from queuescope.llm import html_text, mixing, quality_rules, topk, toxicity, warc
from queuescope.session import materialize

from .plain import WORD, classes, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------------------- top-k (2)


def brute_top_k(rows, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = set()
    for query, a in {i: v for i, v in sorted(vectors)}.items():
        if query % 50 == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != query and len(a) == len(b)]
            for rank, (score, i) in enumerate(sorted(found)[:k], 1):
                out.add((query, rank, i, -score))
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_top_k_equals_brute_force(spark, block):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 3.0]) for _ in range(4)]) for i in range(260)]
    rows += [(300, None), (350, [1.0, None, 0.0, 1.0]), (400, [float("nan")] * 4), (450, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 2.0]), (550, []), (600, [3e9, 1.0, 1.0, -3e9]), (601, [3e9, 1.0, 0.0, 3e9])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    usable = materialize(topk.usable(table))
    found = topk.top_k(usable, usable.where("vec_id % 50 = 0"), 5, block_queries=block)
    wanted = brute_top_k(rows, 5)
    assert {tuple(r) for r in found.collect()} == {r for r in wanted if abs(r[3]) < 2**63}
    assert topk.search(table.limit(0)).count() == 0


def test_products_are_exact_beyond_doubles():
    import numpy as np

    a = np.array([[2.0**40, 3.0]])
    b = np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert topk.products(a, b).tolist() == [[2**60 + 3, 2**63 - 1]]


# -------------------------------------------------------------------------------------------------------- html (6)


def page(nav, body, tail="", extra=""):
    return (
        f"<!doctype html><html><head><title>t {nav}</title><script>if (a < b) document.write('<p>no</p>')</script></head><body>"
        f"<nav><ul><li><a href='/'>{nav}</a></ul></nav><div class='banner'>Buy {nav}</div>{extra}"
        f"<article><h1>Head {nav}</h1>{body}<p>Same closing line of all</p></article>"
        f"<div id=comments><p>First! {nav}</div><footer>&copy; {nav}{tail}</footer>"
    )


def test_article_text_without_the_rest(spark):
    bodies = ["<p>One &amp; <b>two\n three<br><p>four &lt;five&gt;", "<ul><li>a<li>b</ul><p>c</p>", "<p>x <i>y</i>z</p>"]
    rows = [(i, f"http://h.example/{i}", page(f"n{i}", b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://other.example/", page("alone", "<p>only page</p>")), (11, None, None), (12, "x", ""), (12, "x", "plain  text")]
    rows += [(20 + i, "http://copy.example/", page("same", "<p>copied page</p>")) for i in range(4)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(table).collect()]
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    texts = {i: t for i, t, _ in found if i != 12}
    last = "\nSame closing line of all"
    assert texts[0] == "Head n0\nOne & two three\nfour <five>" + last
    assert texts[1] == "Head n1\na\nb\nc" + last
    assert texts[2] == "Head n2\nx yz" + last
    assert texts[10] == "Head alone\nonly page" + last and texts[11] == ""
    assert {texts[i] for i in range(20, 24)} == {"Head same\ncopied page" + last}
    assert sorted(t for i, t, _ in found if i == 12) == ["", "plain text"]
    assert html_text.main_text(table.limit(0)).count() == 0


def test_constant_containers_are_template(spark):
    rows = [
        (i, "http://h.example/", f"<body><div class=x><p>About this site</p></div><div class=y><p>Story {i}</p></div>")
        for i in range(5)
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(table).collect()} == {f"Story {i}" for i in range(5)}


def test_formulas_are_text(spark):
    formula = "<math><mi>x</mi><mo>+</mo><mn>1</mn></math>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><p>Sum {i} is {formula} here</p></article></body>") for i in range(4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(table).collect()} == {f"Sum {i} is x+1 here" for i in range(4)}


def test_copies_of_a_page_make_no_template(spark):
    def words(seed, n=200):
        return " ".join(f"w{seed}x{i}" for i in range(n))

    parts = "<ul><li>first step</li><li>second step</li></ul><div class=inner><p>closing remark</p></div>"
    box = "<div class=box><p>The same box everywhere</p></div>"
    rows = [("copies", f"<article><p>{words(0)}</p>{parts}</article>")] * 4
    rows += [("copies", f"<article><p>{words(i)}</p></article>") for i in range(1, 8)]
    rows += [("near", f"<article><p>{words(0)} read {i} times</p>{parts}</article>") for i in range(5)]
    rows += [("boxes", f"<article><p>{words(i)}</p>{box}</article>") for i in range(3)]
    rows += [("plain", f"<div class=text><p>{words(0)}</p>{parts}</div>")] * 4
    rows += [("plain", f"<div class=text><p>{words(i)}</p></div>") for i in range(1, 8)]
    table = spark.createDataFrame(
        [(i, f"http://{host}.example/", body) for i, (host, body) in enumerate(rows)], "page_id long, url string, html string"
    )
    texts = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    for i, (host, body) in enumerate(rows):
        whole = "\n".join(t for t in re.split("<[^>]*>", body) if t)
        assert texts[i] == (whole.replace("\nThe same box everywhere", "") if host == "boxes" else whole), host


def test_hints_do_not_overrule_the_text(spark):
    def words(i, name="w", n=60):
        return " ".join(f"{name}{i}x{k}" for k in range(n))

    story = [f"<p>{words(i)}</p>" for i in range(4)]
    teaser = "<div class=related><article class=card><p>short {0}</p></article></div>"
    comments = "<div id=comments><article class=comment><p>{0}</p></article></div>"
    wraps = [
        "<div class='container sidebar-left'><article>{0}</article></div>",
        "<div id=page class=header-fixed><article>{0}</article></div><aside><p>{1}</p></aside>",
        "<div class='layout no-aside'><main>{0}</main></div><footer><p>{1}</p></footer>",
        "<form id=aspnetForm><div class=content>{0}</div><div class=sidebar><p>{1}</p></div></form>",
        "<article><div class='entry-header'><h1>Head {1}</h1></div>{0}</article>",
        "<article><div class=related><p>On {1}</p></div>{0}<div class=discussion><p>So {1}</p></div></article>",
        "<div class='comments-open'><div class=text>{0}</div></div>",
        "<div class=layout-sidebar><article>{0}</article></div>" + teaser.replace("{0}", "{1}"),
        "<article>{0}</article>" + comments.replace("{0}", "{2}"),
        "<div class=text>{0}</div>" + comments.replace("{0}", "{2}"),
        "<main><div class=text>{0}</div><div class=comments><p>{2}</p></div></main>",
    ]
    rows = [
        (10 * h + i, f"http://h{h}.example/", wrap.format(story[i], f"n{i}", words(i, "c", 180)))
        for h, wrap in enumerate(wraps) for i in range(4)
    ]
    rows += [(900, "http://one.example/", wraps[0].format(story[0])), (901, "http://two.example/", wraps[4].format(story[0], "n0"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    for h in range(len(wraps)):
        for i in range(4):
            body = words(i)
            wanted = {4: f"Head n{i}\n{body}", 5: f"On n{i}\n{body}\nSo n{i}"}.get(h, body)
            assert texts[10 * h + i] == wanted, wraps[h]
    assert texts[900] == words(0) and texts[901] == f"Head n0\n{words(0)}"


def test_tree_matching_aligns_in_order():
    left, right = "root(a(b() c()) d())", "root(a(c()) e() d())"
    assert html_text.match_trees(left, right) == [0, 1, 3, -1, 4]
    assert html_text.match_trees("root(a())", "other(a())") == [-1, -1]


@pytest.mark.parametrize("source", ["<" * 3000, "<a href='" * 500, "<div>" * 3000, "</p></div>&#0;&bogus;<p", "<!-- never closed <p>x"])
def test_broken_pages_do_not_stop_the_parser(source):
    skeleton, place = html_text.Page(source).skeleton()
    assert skeleton.startswith("root(") and len(place) >= 1


# -------------------------------------------------------------------------------------------------------- warc (7)


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (1, "http://c\r\nX: y/", ""), (4, None, None)]
    rows += [(5, "http://d/", "ä" * 50_000), (None, "http://e/", "same"), (6, "http://f/", "a\r\n\r\nWARC/1.1\r\n\r\n")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    for least in (0, 5):
        found = warc.round_trip(table, least).collect()
        assert len(found) == len(rows)
        for text in {r[2] or "" for r in rows}:
            data = text.encode()
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            own = [r for r in found if r["payload_digest"] == digest]
            assert len(own) == sum((r[2] or "") == text for r in rows) and {r["payload_bytes"] for r in own} == {len(data)}
            responses = [r for r in own if r["record_type"] == "response"]
            if len(data) >= least:
                ids = [r[0] for r in rows if (r[2] or "") == text and r[0] is not None]
                assert len(responses) == 1 and responses[0]["page_id"] == min(ids)
                assert all(r["refers_to"] == min(ids) for r in own if r["record_type"] == "revisit")
            else:
                assert len(responses) == len(own) and all(r["refers_to"] is None for r in own)
    warc.write_archive(table, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    warc.write_warc_files(warc.read_archive(spark, str(tmp_path / "a")), str(tmp_path / "files"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "files").glob("part-*")))
    seen = 0
    while data:  # records one after the other, by their stated lengths
        header, _, rest = data.partition(b"\r\n\r\n")
        size = int(warc.parse_header(header)["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, seen = rest[size + 4 :], seen + 1
    assert seen == len(rows)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_broken_payloads_are_noticed(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    headers, payloads = warc.records(table)
    headers.write.parquet(str(tmp_path / "headers"))
    broken = spark.createDataFrame([(payloads.first()["sha256"], bytearray(b"other"))], "sha256 string, packed binary")
    broken.write.parquet(str(tmp_path / "payloads"))
    with pytest.raises(Exception, match="Error|error"):
        warc.summary(warc.read_archive(spark, str(tmp_path))).collect()


# ----------------------------------------------------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, made = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], SMALL)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made[-1].columns == columns, name
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in made[:-1]]
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).collect() if r["kept"]}
    assert texts[1] == {k: t for k, t in texts[0].items() if k in kept}
    clean = {r["doc_id"] for r in toxicity.classify(made[1], labels).collect() if not r["predicted"]}
    assert texts[2] == {k: t for k, t in texts[1].items() if k in clean}
    keys = sorted(texts[2])
    first = {}
    for key, group in zip(keys, classes([plain_fingerprint(texts[2][k]) for k in keys], 4)):
        first[group] = min(key, first.get(group, key))
    assert texts[3] == {k: texts[2][k] for k in first.values()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(made[3]).collect() if r["taken"]}
    assert {k: len(WORD.findall(t)) for k, t in texts[4].items()} == taken
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["ids"] for r in made[5].collect()} == {
        k: library.encode(t, add_special_tokens=False).ids for k, t in texts[4].items()
    }
    assert corpus_pipeline.run(spark, SMALL).count() == made[5].count()


def test_pipeline_stages_take_odd_and_no_rows(spark):
    import corpus_pipeline

    rows = [(None, None, None, "s", 1), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "x" * 20_000, "de", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
