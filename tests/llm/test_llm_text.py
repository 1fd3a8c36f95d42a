"""Classifiers, URL filter, HTML extraction, chat linking, pipeline."""

import json
import random

import numpy as np
import pytest

from quarry.llm import chat, html_text, langid, quality, url_filter
from quarry.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
EDGE = [(900001, None), (900002, ""), (900003, "12 34 !!"), (900004, "x " * 60000), (None, "the and of")]


def _with_edges(spark, lang=True):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, None, "s", 0) for i, t in EDGE], docs.schema)
    return docs.unionByName(extra).withColumnsRenamed({"n_chars": "score"}).withColumn("kept", docs["source"]).withColumn("held_out", docs["source"])


def test_language_held_out_accuracy(spark):
    docs = _with_edges(spark)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify_languages(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    own = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in own]) > 0.9
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["accepted"] for i in (900001, 900002, 900003))
    assert by[900004]["lang_pred"] in {"en", "fr", "de", "es"} and 0 <= by[900004]["score"] <= 1


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify_languages(docs).collect()} == {"und"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_language_rejects_other_scripts_less_surely():
    r = random.Random(1)
    texts, langs = [], []
    for lang, syllables in (("a", ["ba", "bo", "bi"]), ("b", ["ké", "kü", "ko"])):
        for _ in range(60):
            texts.append(" ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(20)))
            langs.append(lang)
    m = langid.train(texts, langs)
    z, _ = langid._mean_logits(["babobi bobiba", "kükoké"], m.logits, langid.BUCKET_BITS)
    assert [m.languages[i] for i in (z + m.bias).argmax(axis=1)] == ["a", "b"]


def test_quality_against_labels(spark):
    docs = _with_edges(spark)
    want = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.score_quality(docs).collect()}
    assert len(got) == len({r["doc_id"] for r in docs.select("doc_id").collect()})
    pairs = [(want[i], int(got[i]["kept"])) for i in want if i in got]
    assert np.mean([a == b for a, b in pairs]) > 0.9
    assert np.mean([b for a, b in pairs if a == 1]) > 0.97
    assert not got[900001]["kept"] and not got[900002]["kept"] and not got[900004]["kept"]


def test_quality_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score_quality(empty).count() == 0
    assert [r["kept"] for r in quality.score_quality(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [False]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    acc = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    v = np.where(rng.random((20000, 5)) < acc, truth[:, None], ~truth[:, None]).astype(np.int8)
    v[rng.random(v.shape) < 0.3] = -1
    rows, n = np.unique(v, axis=0, return_counts=True)
    m = quality.fit_label_model(rows, n)
    assert abs(m.share_good - 0.8) < 0.03 and np.abs(m.right_on_good - acc).max() < 0.04 and np.abs(m.right_on_bad - acc).max() < 0.08
    assert ((m.posterior(v) > 0.5) == truth).mean() > 0.93


URLS = [(1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "https://example.org/en/12"), (3, "http://x.com/fr/1"), (4, "http://x.com/de/1"), (5, None), (6, "no scheme"), (7, "http://org"),
        (8, "a://b://org/x"), (9, ""), (10, "http://casino-spam.example.net/pills"), (11, "http://notexample.org/es/"), (12, "http://h?x/y"), (13, "http://h#x"), (14, "://ÀB.org/"),
        (15, "http://blog-docs.example.net/en/5"), (1, "HTTP://A.Example.ORG/es/x?q#f"), (16, "http://x.org:80/a\nb"), (17, "http://x.com/" + "y" * 40000)]


def test_url_rules_and_model_equal_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", 0) for i, u in URLS], "page_id long, url string, host string, rule string, score int")
    got = url_filter.filter_urls(pages, None, URL_RULES)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    w = url_filter.weights_plain(url_filter.default_labels())
    assert np.allclose(w, url_filter.train_weights(url_filter.label_table(spark)), atol=2e-5)
    want = []
    for i, u in URLS:
        host, path = url_filter.split_plain(u)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = url_filter.grams_plain(host, path)
        margin = (sum(w[b] for b in g) + w[-1]) / len(g) ** 0.5
        want.append((i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if margin > 0 else "allow"))
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()))) == sorted(map(str, want))
    assert url_filter.filter_urls(pages.limit(0), None, URL_RULES).count() == 0


def test_url_model_separates_its_words(spark):
    w = url_filter.weights_plain(url_filter.default_labels())
    for u, y in url_filter.default_labels():
        g = url_filter.grams_plain(*url_filter.split_plain(u))
        assert (sum(w[b] for b in g) + w[-1] > 0) == bool(y)
    with pytest.raises(ValueError):
        url_filter.train_weights(spark.range(1001).selectExpr("cast(id as string) url", "1 label"))


PAGES = [
    ("<html><body><header>Site</header><div class='cookie-notice'>We use cookies</div><main><h1>T &lt;x&amp;</h1><div>a<p>b  c\n d</p>e</div><ul><li>1<li>2</ul>"
     "<section class=comments><article>bad</article></section></main><footer>f</footer>", "T <x&\na\nb c d\ne\n1\n2"),
    ("<article><p>one<p>two <b>bold<br>x</p><script>var a='</p><p>no'</script><aside>no</aside><form>no<input></form><div class=\"ad\">no</div></article>", "one\ntwo bold x"),
    ("<!-- <p>no</p> --><p>a &nbsp; b &#233; &copy;</p><p></p>tail < 3", "a b é ©\ntail < 3"),
    ("<p title='x>y'>ok</p><p title=\"broken>still", "ok\nstill"), ("", ""), (None, ""), ("plain", "plain"), ("<style>x</style>", ""),
    ("<div role=navigation>no</div><nav>no</nav><div id=sidebar>no</div><p>yes</p><div hidden>no</div><noscript>no</noscript>", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
]


def test_html_cases():
    for page, text in PAGES:
        assert html_text.main_text(page) == text, page
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert html_text.main_text(deep) == "x"
    assert html_text.main_text("<p>" + "word " * 200000) == ("word " * 200000).strip()
    assert html_text.main_text("<" * 5000 + "a") != ""


def test_stray_tags_cost_nothing():
    import time
    pages = ["<span>" * 20000 + "</b>" * 20000, "<ul>" * 20000, "<span>" * 20000 + "<td>" * 20000, "<span>" * 20000 + "<li>" * 20000, "<div>" * 20000 + "</p>" * 20000,
             "<article>" + "<div>" * 20000 + "</section>" * 20000, "<p>" + "<i>" * 20000 + "<div>" * 20000, '<a "' * 20000, "<option><b>" * 20000, "<dl>" + "<i>" * 20000 + "<dt>" * 20000]
    for page in pages:
        began = time.time()
        html_text.main_text(page + "x")
        assert time.time() - began < 5, page[:30]


def test_only_what_the_contract_lists_goes_inside_an_article():
    keep = ["<math>a</math>", "<label>a</label>", "<fieldset>a</fieldset>", "<noscript>a</noscript>", "<map>a</map>", "<svg><text>a</text></svg>", "<audio>a</audio>", "<video>a</video>",
            "<object>a</object>", "<dialog>a</dialog>", "<div hidden>a</div>", "<div class=related>a</div>", "<div class='skip social login share'>a</div>", "<div style='display:none'>a</div>"]
    for part in keep:
        assert html_text.main_text(f"<article><p>x</p>{part}</article>") == "x\na", part
    drop = ["<nav>a</nav>", "<aside>a</aside>", "<footer>a</footer>", "<form>a</form>", "<script>a</script>", "<style>a</style>", "<div class=ad>a</div>", "<div class=cookie-notice>a</div>",
            "<div id=comments>a</div>", "<div class=sidebar>a</div>", "<!-- a -->", "<button>a</button>", "<div role=navigation>a</div>"]
    for part in drop:
        assert html_text.main_text(f"<article><p>x</p>{part}</article>") == "x", part


def test_all_outermost_mains_are_kept():
    assert html_text.main_text("<p>no</p><main><p>one</main><div><main>two<div role=main>in</div></main></div><div role='main'>three</div><section role=\"main\">four</section>") == "one\ntwo\nin\nthree\nfour"
    assert html_text.main_text("<main>no<article>one</article></main><main><article>two</article></main>") == "one\ntwo"
    assert html_text.main_text("<article>one</article><article>two</article>") == "one\ntwo"


def test_templates_are_removed_per_host(spark):
    def page(host, i, promo):
        body = f"<div><span>{promo}</span> join us</div><div><p>story {i} " + "text " * 30 + "</p></div>"
        return (host * 1000 + i, f"http://h{host}.example/{i}", f"<html><body>{body}</body></html>")

    rows = [page(1, i, "Promo") for i in range(40)] + [page(2, i, f"own {i}") for i in range(40)] + [page(3, 0, "Promo")] * 30 + [(None, None, None), (7, "x", "")]
    pages = spark.createDataFrame([(a, b, c, "z", 1) for a, b, c in rows], "page_id long, url string, html string, text string, page int")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert "Promo" not in by[1003]["text"] and by[1003]["text"].startswith("story 3 text")
    assert "own 5" in by[2005]["text"]
    assert "Promo" in by[3000]["text"]  # copies of one page are one page
    assert by[7]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_templates_go_on_pages_they_dominate(spark):
    menu = "<div>" + "".join(f"<a href='/{k}'><span>section {k}</span></a>" for k in range(9)) + "</div>"

    def page(i, words):
        return (i, f"http://h.example/{i}", f"<html><body>{menu}<div><p>story {i} " + "text " * words + "</p></div></body></html>")

    rows = [page(i, 60) for i in range(20)] + [page(i, 1) for i in range(20, 24)] + [(99, "http://h.example/99", f"<html><body>{menu}</body></html>"), (50, "http://other.example/", page(50, 1)[2])]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 " + ("text " * 60).strip() and got[21] == "story 21 text" and got[99] == ""
    assert "section 1" in got[50]  # nothing recurs on its host


def test_templates_of_a_large_host(spark):
    def page(host, i):
        notice = "<div><span>Section</span> notice of ten pages</div>" if i < 10 else f"<div><span>own</span> remark {i} of this page</div>"
        return (host * 10000 + i, f"http://h{host}.example/{i}", f"<html><body>{notice}<div><p>story {i} " + "text " * 30 + "</p></div></body></html>")

    rows = [page(1, i) for i in range(3000)] + [page(2, i) for i in range(20)] + [page(3, i) for i in range(3, 10)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("notice" not in got[h * 10000 + i] and got[h * 10000 + i].startswith("story") for h in (1, 2) for i in range(10))
    assert "remark 2500" in got[12500] and "remark 15" in got[20015]
    assert "notice" in got[30005]  # on seven pages of its host only


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["integer", "null"], "maximum": 9}, "y": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


def _calls(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls]})


def test_chat_linking_and_order(spark):
    result = lambda i, c="r": json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", _calls(("a", "f", {"x": {"$result": "b"}}), ("b", "f", '{"x": 3, "y": ["é"]}'))), (1, 2, "tool", result("a")), (1, 3, "tool", result("b", {"k": [1, 2]})),
        (1, 4, "assistant", _calls(("c", "f", {"x": 10}), ("d", "g", {}), ("a", "f", {"x": 1}), ("e", "f", {"x": {"$result": "zz"}}))), (1, 5, "tool", result("nobody")),
        (2, 0, "assistant", _calls(("p", "f", {"x": {"$result": "q"}}), ("q", "f", {"x": {"$result": "p"}}))), (2, 1, "tool", "not json"), (2, 2, None, None), (None, 0, "assistant", _calls(("n", "f", {"x": None}))),
        (None, 1, "tool", result("n")), (3, 0, "assistant", _calls(("s", "f", "{broken"), ("t", "f", {"x": 1, "z": 2}), (None, "f", {"x": 1}))), (3, 1, "assistant", _calls()), (1, 0, "user", "hi"),
    ]
    got = chat.link_tool_calls(spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, item int, status string"), SCHEMAS).collect()
    status = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r["status"] for r in got}
    assert status[1, "call", "a", 1] == "ok" and status[1, "call", "b", 1] == "ok" and status[1, "call", "a", 4] == "duplicate_id"
    assert status[1, "call", "c", 4] == "invalid_arguments" and status[1, "call", "d", 4] == "unknown_tool" and status[1, "call", "e", 4] == "missing_dependency"
    assert status[1, "result", "nobody", 5] == "orphan_result" and status[2, "call", "p", 0] == "cycle" == status[2, "call", "q", 0]
    assert status[None, "call", "n", 0] == "ok" and status[None, "result", "n", 1] == "ok"
    assert status[3, "call", "s", 0] == "invalid_arguments" == status[3, "call", "t", 0] and status[3, "call", None, 0] == "duplicate_id"
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["anchor"], r["depth"], r["place"], r["part"]))
    order = [(r["kind"], r["call_id"]) for r in one]
    assert order.index(("call", "b")) < order.index(("result", "b")) < order.index(("call", "a")) < order.index(("result", "a"))
    assert order[:2] == [("message", None)] * 2 and len(got) == 21
    line = next(r["json"] for r in one if r["kind"] == "call" and r["call_id"] == "b")
    assert line == '{"role":"assistant","tool_call":{"arguments":{"x":3,"y":["é"]},"id":"b","name":"f"}}'
    assert chat.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), SCHEMAS).count() == 0


def test_lone_surrogates_and_deep_arguments(spark):
    bad = "\\ud83d"
    deep = "[" * 900 + "]" * 900
    rows = [(1, 0, "assistant", f'{{"content":"{bad}","tool_calls":[{{"id":"a{bad}","name":"f{bad}","arguments":{{"x{bad}":"{bad}","y":{{"$result":"{bad}"}}}}}}]}}'),
            (1, 1, "tool", f'{{"tool_call_id":"a{bad}","content":"x{bad}y"}}'), (1, 2, "tool", f'{{"tool_call_id":"b","content":{{"{bad}":1}}}}'),
            (2, 0, "assistant", f'{{"tool_calls":[{{"id":"d","name":"f","arguments":{deep}}}]}}'), (2, 1, "tool", f'{{"tool_call_id":"d","content":{deep}}}'),
            (2, 2, "tool", '{"tool_call_id":' + "1" * 5000 + ',"content":1}'), (3, 0, "assistant", '{"tool_calls":[' * 20000)]
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert len(got) == 8 and all(json.loads(r["json"]) for r in got)
    assert next(r for r in got if r["kind"] == "call" and r["conv_id"] == 1)["call_id"] == "a?"
    assert "x?y" in next(r for r in got if r["kind"] == "result" and r["conv_id"] == 1 and r["turn"] == 1)["json"]


def test_schema_problems():
    s = {"type": "object", "properties": {"n": {"type": "number", "minimum": 0}, "e": {"enum": [1, "a"]}, "s": {"type": "string", "minLength": 2}, "b": {"type": "boolean"}}, "required": ["n"]}
    assert chat.schema_problem({"n": 1.5, "e": "a", "s": "xy", "b": True, "other": 1}, s) is None
    for bad in ({}, {"n": True}, {"n": -1}, {"n": 1, "e": 2}, {"n": 1, "s": "x"}, {"n": 1, "b": 0}, [], None):
        assert chat.schema_problem(bad, s)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        before, after = docs.count(), kept.count()
        assert 0 < after <= before
        assert kept.subtract(docs).isEmpty()
        path = corpus_pipeline.scratch_path(spark, "test-stage")
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        names.append(name)
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(set(pieces["doc_id"])) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "benchmark decontamination"]


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    good = stages["language ID"](spark, stages["quality classifier"](spark, table, SF), SF)
    good = [r["text"] for r in stages["benchmark decontamination"](spark, good, SF).orderBy("doc_id").limit(3).collect()]
    assert len(good) == 3
    for stage, bad in (("quality classifier", ""), ("quality classifier", None), ("language ID", "12 34 !!"), ("benchmark decontamination", item)):
        own = [(None, good[0]), (None, bad), (None, good[0]), (-5, good[1]), (-5, bad), (-6, good[2])]
        docs = table.unionByName(spark.createDataFrame([(i, t, None, "s", 0) for i, t in own], table.schema))
        kept = stages[stage](spark, docs, SF)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in kept.where("doc_id is null or doc_id < 0").collect()]
        assert sorted(got, key=str) == sorted([(None, good[0])] * 2 + [(-5, good[1]), (-6, good[2])], key=str), stage


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_keeps_different_texts_of_one_id(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    t, v = " ".join(words), " ".join(reversed(words))
    near = " ".join(words[:58])
    rows = [(1, t), (5, t), (5, v), (None, t), (None, t), (None, v + " more"), (7, near), (8, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "").collect())
    assert got == sorted([("1", t), ("5", v), ("8", ""), ("8", ""), ("None", "")])
