"""HTML extraction, mixing, toxicity, chat formatting, language identification and decontamination."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import SCHEMA, documents, with_repeats

from textmill.llm import chat, decontam, html_extract, langid, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


# ---- HTML --------------------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The &amp; title</h1><p>First&nbsp;  paragraph with
 a line break &#8212; and <b>bold <i>text</b></i>.<p>Second, not closed<div class="ad">Buy</div><ul><li>one<li>two</ul>
<form><input><button>Send</button></form><p>Short.</p><section id="comments"><p>Reader says hi</p></section><!-- gone --></article>
<aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert html_extract.main_text(PAGE) == "The & title\nFirst paragraph with a line break — and bold text.\nSecond, not closed\none\ntwo\nShort."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("<p>a<br>b</p>", "a b"), ("<nav>x", ""), ("</div></p>a</b>", "a"),
    ("<article><p>a</p></article><article><p>b</p></article>", "a\nb"), ("<main><p>x &lt;y&gt;</p><article><p>in</p></article></main>", "x <y>\nin"), ("<p hidden>no</p><p>yes</p>", "yes"),
])
def test_small_pages(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<main><p>story</p><article class=card>teaser</article></main>", "story\nteaser"), ("<article>a</article><main>b</main>", "a\nb"),
    ("<p>" + "long words " * 30 + "</p><p>Short.</p>", ("long words " * 30).strip() + "\nShort."),
    ("<h1>Title</h1><div>by A</div>" + "<p>" + "long words " * 30 + "</p><p>Yes.</p><p>No.</p>" * 3, "Title\nby A\n" + ("long words " * 30).strip() + "\nYes.\nNo." * 3),
    ("<div><a href=/>Home</a></div><div><a href=/a>About us</a></div>" * 4 + "<p>Lead.</p><p>" + "long words " * 30 + "</p><p>" + "more words " * 30 + "</p><p>End.</p>" + "<div><a href=/b>Terms</a></div>" * 4,
     "Lead.\n" + ("long words " * 30).strip() + "\n" + ("more words " * 30).strip() + "\nEnd."),
    ("<a name=top><p>" + "long words " * 30 + "</p><p>Short.</p>", ("long words " * 30).strip() + "\nShort."),
])
def test_no_text_is_lost(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "with-banner", "related-topics-page", "social-policy", "sidebar", "popup"])
def test_names_do_not_lose_an_article(name):
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<div class='{name}'><p>out</p><{tag}><p>in</p></{tag}></div>").endswith("in")
    inner = f"<section class='{name}'><p>in</p></section>"
    assert html_extract.main_text(f"<article><p>a</p>{inner}</article>") == ("a" if name in ("sidebar", "popup") else "a\nin")


@pytest.mark.parametrize("html, text", [
    ("<article><p class='notice-period'>a</p><div class='discussion'>b</div></article>", "a\nb"),
    ("<article><p>a</p><div class='comments'><article>c</article></div></article><div id='comments'><article>d</article></div>", "a"),
    ("<div><p>story</p></div><div id='comments'><article>c</article></div>", "story"),
    ("<div><p>story</p></div><div class='widget'><article>c</article></div>", "c"), ("<article><p>a</p><article class='comment'>b</article></article>", "a"),
    ("<main><p>a</p><div class='comments'><article>c</article></div></main>", "a"),
    ("<article>a<div class='cookie-notice'>b</div><div class='ad-1'>c</div><div id='ad_300x250'>d</div><p class='post__share'>e</p></article>", "a"),
])
def test_names(html, text):
    assert html_extract.main_text(html) == text


LONG = "Some long words of the story that go on for a while, as in an article, and then on. " * 4


@pytest.mark.parametrize("html", [
    "<body><div class='content has-sidebar'><h1>T</h1><p>{0}</p><p>End.</p></div></body>", "<div class='main no-sidebar'><h1>T</h1><p>{0}</p><p>End.</p></div>",
    "<div class='post-with-comments'><article><h1>T</h1><p>{0}</p><p>End.</p></article></div>", "<form><nav>menu</nav><div><h1>T</h1><p>{0}</p><p>End.</p></div></form>",
    "<main><h1>T</h1><p>{0}</p><p>End.</p></main>", "<article><h1>T</h1><p>{0}</p><p>End.</p><article class='comment'>I say</article></article>",
])
def test_wrapped_pages_keep_their_article(html):
    assert html_extract.main_text(html.format(LONG)) == f"T\n{LONG.strip()}\nEnd."


def test_the_clusters_choose():
    """Without any name or mark: the low cluster goes, the high one and what stands in its region stays; text far beyond an article's ratio stays outside it."""
    side = "<div>Home</div><div>News of it</div><div>Sign in</div>"
    assert html_extract.main_text(f"{side}<div><h2>T</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>{side}") == f"T\n{LONG.strip()}\nYes.\n{LONG.strip()}"
    assert html_extract.main_text(f"<main>Loading</main><div>{LONG * 20}</div>") == f"Loading\n{(LONG * 20).strip()}"
    assert html_extract.main_text(f"<main><p>{LONG}</p></main><div>{LONG}</div>") == LONG.strip()


def template(page):
    import html

    lines = re.sub("<[^>]*>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\n", re.search("<article>(.*?)</article>", page, re.S)[1])).split("\n")
    return "\n".join(x for x in (" ".join(html.unescape(v).split()) for v in lines) if x)


@pytest.mark.parametrize("kind", ["main", "div"])
def test_pages_without_article_against_the_template(spark, kind):
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html_extract.main_text(re.sub("(</?)article>", rf"\1{kind}>", page.html)) == template(page.html)


def test_deep_and_long_pages():
    assert html_extract.main_text("<article>" + "<b>" * 20000 + "x" + "</i>" * 20000 + "</article>") == "x"
    assert len(html_extract.main_text("<article>" + "<p>word word</p>" * 20000 + "</article>").split("\n")) == 20000


def test_extract_keeps_columns(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, None), (2, None, None, None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "html", "text", "text_"]
    assert [r["text_"] for r in out.orderBy("page_id").collect()][1:] == ["", ""]
    assert html_extract.extract(spark.createDataFrame([], "html string")).count() == 0


def test_html_query_against_the_template(spark):
    import html

    found = {r.page_id: r for r in queries.op1_html_extraction(spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        lines = re.sub("<[^>]*>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\n", body)).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(v).split()) for v in lines) if x)
        assert found[page.page_id].text == want and found[page.page_id].n_chars == len(want)


# ---- mixing ------------------------------------------------------------------------------------------------------


def targets(sizes, weights, share=1.5, most=2.0):
    """Round by round, as the task says it."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free and left > 0:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100, 0], [10, 1000], [1, 1, 1, 50, 7000, 3], [0, 0], [5]])
def test_targets_reshare_what_is_over(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    table = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, size long, weight double")
    assert [r.target for r in mixing.with_targets(table, 1.5, 2.0).orderBy("i").collect()] == pytest.approx(targets(sizes, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutations(n):
    a = mixing.permuted(np.arange(n), n, 3, 0, 17)
    assert sorted(a.tolist()) == list(range(n)) and (n < 50 or (a != mixing.permuted(np.arange(n), n, 3, 1, 17)).any())


@pytest.mark.parametrize("slots, shards", [(1000, 7), (3, 1000), (1, 1), (70000, 200_000), (5, 20)])
def test_draws_meet_their_totals(slots, shards):
    drawn = [(s, n) for part in mixing.spread(5, slots, shards, 1) for s, n in zip(*(x.tolist() for x in part))]
    assert sum(n for _, n in drawn) == slots and len({s for s, _ in drawn}) == len(drawn) and all(0 <= s < shards and n > 0 for s, n in drawn)


def brute_mix(rows, slots, block):
    """Sizes, targets and words taken, from the definition and the drawn (source number, block) pairs."""
    from collections import Counter

    names = sorted({r[3] for r in rows}, key=lambda v: (v is None, v or ""))
    size = {v: sum(len((r[1] or "").encode().split()) for r in rows if r[3] == v) for v in names}
    target = dict(zip(names, targets([size[v] for v in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])))
    times = Counter((r["_source"], r.block) for r in slots)
    words = {v: sum(n * max(1, min(block, size[v] // mixing.PARTS)) for (s, _), n in times.items() if names[s] == v) for v in names}
    return size, target, words


def test_mix_of_awkward_rows(spark):
    rows = with_repeats(documents(6)) + [documents(6)[2]] * 40 + [(i % 2, f"one w{i} two", "en", "s1", *documents(6)[0][4:]) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    docs, blocks, slots = mixing.mix(table, block=16, shard_slots=32)
    got = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode().split())) for r in rows)
    size, target, words = brute_mix(rows, slots.collect(), 16)
    for v in size:
        mine = [r for r in got if r["source"] == v]
        assert all((r.source_size, r.target) == (size[v], pytest.approx(target[v])) and r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[v]) <= 0.01 * target[v] + 16 and abs(sum(r.taken for r in mine) - words[v]) <= 32
    key = lambda r: tuple(str(x) for x in r)
    for again in (table.repartition(5), table.repartition(3, "text"), table.orderBy(F.col("text").desc()).coalesce(1)):
        assert sorted(map(key, mixing.mix(again, block=16, shard_slots=32)[0].collect())) == sorted(map(key, got))
    assert mixing.mix(spark.createDataFrame([], SCHEMA))[0].count() == 0


@pytest.mark.parametrize("words", [1, 7, 150, 300, 3000])
def test_small_sources_come_near_their_target(spark, words):
    rows = [(i, " ".join(["w"] * n), "s0") for i, n in enumerate([words // 3, words - words // 3])] + [(9, "w " * 40000, "s1"), (10, "w " * 9000, "s2")]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect() if r["source"] == "s0"]
    assert abs(sum(r.taken for r in got) - got[0].target) <= max(1, 0.01 * got[0].target)


def test_blocks_and_shards_are_even(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 50)), f"s{i % 4}") for i in range(800)]
    docs, blocks, slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16, shard_slots=64)
    got = slots.collect()
    by = {}
    for r in got:
        by.setdefault(r["_source"], {}).setdefault(r.block, []).append(r.shard)
    for held in by.values():
        assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert all(v == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) < 2.5 * 64
    most = [sum(r["_source"] == 0 for r in got if r.shard == s) / len(v) for s, v in shards.items() if len(v) > 30]
    assert np.std(most) < 0.12


def test_mix_holds_the_blocks_words(spark):
    rows = documents(7, 20)
    table = spark.createDataFrame(rows, SCHEMA)
    docs, blocks, slots = mixing.mix(table, block=16, shard_slots=32)
    text = mixing.packed_text(table, "doc_id", "text", blocks, slots).collect()
    assert sum(len(r.text.split()) for r in text) == sum(r.taken for r in docs.collect())


# ---- toxicity ----------------------------------------------------------------------------------------------------


def test_toxic_words_are_learned_and_located(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("lor", "mip", "sun", "dol") for b in ("ka", "mi", "tu", "ro", "ne")]
    rows = []
    for i in range(900):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(4)]
        toxic = i % 4 == 0
        if toxic:
            sentences[i % 3] += f" zwurg{rng.choice(words)}"
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    table = spark.createDataFrame(rows[:600], "doc_id long, text string, toxic int")
    model = toxicity.train(table)
    scored = toxicity.score(spark.createDataFrame(rows[600:] + [(1, None, None), (2, "", None)], table.schema), model, locate=0.5).collect()
    assert all((r.toxicity >= 0.7) == bool(r.toxic) for r in scored[:300])
    for r in scored[:300]:
        assert all("zwurg" in s.text for s in r.toxic_sentences) and len(r.toxic_sentences) == r.toxic
    assert all(0 <= r.toxicity <= 1 for r in scored)


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.score(spark.createDataFrame([(1, "a", 0)], empty.schema), toxicity.train(empty)).first().toxicity < 0.01
    assert toxicity.score(empty, toxicity.train(empty)).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (None, "a", 1), (2, "b", None), (3, "", 1)], empty.schema)
    assert toxicity.score(odd, toxicity.train(odd)).count() == 4


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, sf).toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    labelled = found.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = labelled[labelled.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.02


# ---- language ----------------------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().merge(found, on="doc_id")
    assert (docs.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]).all()
    held = docs[docs.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and docs.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the house is big", "en"), ("das haus ist gross", "de"), ("la maison est grande", "fr")] * 6)]
    odd = [(50, None, "en"), (51, "", "en"), (52, "123 !!", "en"), (53, "x", None), (None, "das haus ist", "de"), (54, "the house " * 3000, None), (54, "the house " * 3000, None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang_pred")
    model = langid.train(table, lang_col="lang_pred")
    got = langid.predict(table, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_pred_", "lang_score", "lang_ambiguous"]
    by = {r.text: r for r in got.collect()}
    assert by[None]["lang_pred_"] == by[""]["lang_pred_"] == by["123 !!"]["lang_pred_"] == "und" and by["123 !!"].lang_score == 0
    assert by["the house is big"]["lang_pred_"] == by["the house " * 3000]["lang_pred_"] == "en" and by["das haus ist"]["lang_pred_"] == "de"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert langid.predict(table, None).first()["lang_pred_"] == "und"


@pytest.mark.parametrize("langs", [("de", "en"), ("de", "en", "es", "fr")])
def test_halves_of_two_languages_are_ambiguous(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*langs)).select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    held = [r for r in docs.filter(langid.held_out()).orderBy("doc_id").collect() if len(r.text.split()) >= 20]
    by = {v: [r.text.split() for r in held if r.lang == v] for v in langs}
    pairs = [(a, b, x, y) for a in langs for b in langs if a < b for x, y in zip(by[a], by[b])]
    mixed = [(i, " ".join(x[:n] + y[:n])) for i, (_, _, x, y) in enumerate(pairs) if (n := min(len(x), len(y)))]
    found = langid.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    pure = langid.predict(docs.filter(langid.held_out()), model).collect()
    assert np.mean([r.lang_ambiguous for r in found]) > 0.85 and np.mean([r.lang_ambiguous for r in pure]) < 0.02


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the house {i % 7} is big and the street is long", "en") for i in range(4000)] + [(9000 + i, f"das haus {i} ist gross und die strasse", "de") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, sample=40)
    assert model.languages == ["de", "en"]
    assert {r.lang_pred for r in langid.predict(table.filter("doc_id >= 9000"), model).collect()} == {"de"}
    from textmill.llm.common import bounded

    part = bounded(table, "doc_id", 40, "lang")
    assert len(part) == 40 and sum(r.lang == "de" for r in part) == 3


def test_decoding_matches_the_definition():
    rng = np.random.default_rng(4)
    for n in (2, 4, 7):
        code = langid.codewords(n)
        model = langid.Model(list("abcdefg"[:n]), code, None, None, rng.uniform(0.1, 1, code.shape[1]))
        margins = rng.normal(size=(50, code.shape[1])) * 3
        best, share, gap = model.decoded(margins)
        for i, m in enumerate(margins):
            loss = [sum(t * np.log(1 + np.exp(-x * c)) for x, c, t in zip(m, code[k], model.trust)) for k in range(n)]
            order = np.argsort(loss, kind="stable")
            assert best[i] == order[0] and gap[i] == pytest.approx(loss[order[1]] - loss[order[0]])
            assert share[i] == pytest.approx(np.exp(-loss[order[0]]) / np.exp(-np.array(loss)).sum())


def test_noisy_or_gradient():
    """The steps of the descent against differences of the likelihood."""
    texts, y = ["a b. c", "a. a b", "c", "b c. a"], np.array([1.0, 0.0, 0.0, 1.0])
    number = np.full(1 << toxicity.BITS, -1, np.int32)
    first = next(toxicity._blocks(texts))[0]
    used = np.unique(first.feature)
    number[used] = np.arange(len(used))
    bags = toxicity._gathered(texts, number)
    w = np.linspace(0.1, 0.9, len(used))

    def likelihood(w, bias):
        odds = np.bincount(bags.row, np.log1p(np.exp(bags.sums(w, bias))), len(y))
        return sum(np.log(-np.expm1(-s)) * 0.5 / y.mean() if t else -s * 0.5 / (1 - y.mean()) for s, t in zip(odds, y)) / len(y)

    z = bags.sums(w, -1.0)
    g, g0 = toxicity._gradient(bags, y, z)
    step = 1e-6
    assert g0 == pytest.approx(-(likelihood(w, -1 + step) - likelihood(w, -1 - step)) / (2 * step), rel=1e-4)
    for f in range(len(used)):
        up, down = w.copy(), w.copy()
        up[f] += step
        down[f] -= step
        assert g[f] == pytest.approx(-(likelihood(up, -1.0) - likelihood(down, -1.0)) / (2 * step), rel=1e-4, abs=1e-7)
    p = toxicity.Model(used, w, -1.0)
    by_hand = [1 - np.prod([1 - 1 / (1 + np.exp(-z[s])) for s in np.flatnonzero(bags.row == i)]) for i in range(len(y))]
    assert p.documents(bags, len(y)) == pytest.approx(by_hand)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code.tolist()}) == n and all(len(set(bit)) == 2 for bit in code.T.tolist())


# ---- chat --------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string"
CONVERSATIONS = [
    (1, 0, "system", "be kind", None), (1, 1, "user", "hi", None), (1, 2, "assistant", "hello \\ <|im_end|> \\n", None),
    (2, 0, "system", "be kind", None), (2, 1, "user", "hi", None), (2, 2, "assistant", "bye", None), (2, 2, "assistant", "bye", None),
    (3, 1, None, None, None), (3, None, "user\nx", "<|im_start|>assistant\n", None), (None, 0, "assistant", "", None), (0, 0, "assistant", "x" * 50000, None), (4, 0, "system", "be kind", None),
]


def test_round_trip_of_awkward_conversations(spark):
    nodes, paths = chat.prefix_tree(spark.createDataFrame(CONVERSATIONS, TURNS))
    got = {r.conv_id: r for r in chat.read_back(nodes, paths).collect()}
    by = {}
    for c, turn, role, text, _ in CONVERSATIONS:
        by.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.piece(r, t)) for _, _, r, t in rows)


def test_tree_emits_shared_turns_once(spark):
    nodes, paths = chat.prefix_tree(spark.createDataFrame(CONVERSATIONS, TURNS))
    nodes = {r.start: r for r in nodes.collect()}
    prefixes = {}
    for c, turn, role, text, _ in sorted(CONVERSATIONS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        prefixes.setdefault(c, []).append(chat.piece(role or "", text or ""))
    want = {tuple(p[: i + 1]) for p in prefixes.values() for i in range(len(p))}
    assert len(nodes) == len(want)
    stream = sorted(nodes.values(), key=lambda r: r.start)
    assert [r.start for r in stream] == [sum(x.length for x in stream[:i]) for i in range(len(stream))]
    text = "".join(r.piece for r in stream)
    for conv in {(r.conv, r.is_null) for r in paths.collect()}:
        way = sorted((r for r in paths.collect() if (r.conv, r.is_null) == conv), key=lambda r: r.depth)
        seen = ""
        for step in way:
            node = nodes[step.start]
            assert "".join(text[i.s : i.e] for i in node.attends) == seen and node.position == len(seen)
            seen += node.piece


@pytest.mark.parametrize("users", [10_000, 7])
def test_a_prompt_that_all_share(spark, monkeypatch, users):
    """One system prompt in every conversation, copies of whole conversations, in partitions that cut both."""
    monkeypatch.setattr(chat, "USERS", users)
    rng = random.Random(3)
    rows = []
    for c in range(120):
        way = [("system", "be kind"), ("user", f"q{rng.randrange(4)}"), ("assistant", f"a{rng.randrange(3)}"), ("user", f"r{rng.randrange(2)}")][: rng.randint(1, 4)]
        rows += [(c, i, role, text, None) for i, (role, text) in enumerate(way)]
    nodes, paths = chat.prefix_tree(spark.createDataFrame(rows, TURNS).repartition(9))
    by = {}
    for c, _, role, text, _ in rows:
        by.setdefault(c, []).append(chat.piece(role, text))
    stream = sorted(nodes.collect(), key=lambda r: r.start)
    assert len(stream) == len({tuple(p[: i + 1]) for p in by.values() for i in range(len(p))}) and [r.start for r in stream] == [sum(x.length for x in stream[:i]) for i in range(len(stream))]
    text = "".join(r.piece for r in stream)
    node = {r.start: r for r in stream}
    ways = {}
    for r in sorted(paths.collect(), key=lambda r: (r.conv, r.depth)):
        ways.setdefault(r.conv, []).append(r.start)
    for c, starts in ways.items():
        assert [node[s].piece for s in starts] == by[c]
        assert all("".join(text[i.s : i.e] for i in node[s].attends) == "".join(by[c][:d]) for d, s in enumerate(starts))
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(nodes, paths).collect()}
    assert got == {c: hashlib.sha256("".join(f"{r}\n{t}\n" for d, _, r, t, _ in rows if d == c).encode()).hexdigest() for c in by}


def test_ties_go_by_text(spark):
    texts = ["x" * 100 + "b", "x" * 100 + "a", "", "x" * 100 + "a"]
    nodes, paths = chat.prefix_tree(spark.createDataFrame([(1, 0, "user", t, None) for t in texts], TURNS))
    assert [r.piece for r in nodes.orderBy("start").collect()] == [chat.piece("user", t) for t in sorted(texts)]


def test_chat_with_a_tokenizer_and_without_rows(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    nodes, paths = chat.prefix_tree(spark.createDataFrame(CONVERSATIONS, TURNS), tokenizer=path)
    assert all(len(r.tokens) == r.length for r in nodes.collect())
    empty = chat.prefix_tree(spark.createDataFrame([], TURNS))
    assert chat.read_back(*empty).count() == 0


def test_escapes_are_reversible():
    for text in ("", "\\", "<|", "\\<|", "<\\|", "a\\nb", "<|im_end|>\n", "\\\\<|x"):
        assert chat.restored(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
        assert chat.parsed(chat.piece("us<|er\nq", text)) == ("us<|er\nq", text)


# ---- decontamination ---------------------------------------------------------------------------------------------


def word_list(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.mark.parametrize("most, piece", [(1 << 25, 20_000), (1 << 25, 3), (1500, 7)])
def test_hits_match_brute_force(spark, most, piece, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_NODES", most)
    monkeypatch.setattr(decontam, "PIECE_WORDS", piece)
    rows = with_repeats(documents(8))
    items = [(1, " ".join(rows[0][1].split()[2:20])), (2, "W1, w2"), (3, None), (4, "..."), (2, "w3 w4"), (None, "w5"), (5, rows[5][1]), (6, "É é")]
    found = decontam.decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    names = found.columns[-4:]
    assert names[0] == "n_words_"
    windows = {}
    for i, t in items:
        w = word_list(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).update([] if i is None else [str(i)])
    want = []
    for r in rows:
        w, hit, ids = word_list(r[1]), set(), set()
        for key, of in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p : p + len(key)]) == key:
                    hit.update(range(p, p + len(key)))
                    ids |= of
        want.append((r[0] is None, r[0] or 0, r[1] or "", len(w), len(hit), sorted(ids)))
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "", r["n_words_"], r.n_hit, list(r["items"])) for r in found.collect()]
    assert sorted(got) == sorted(want)
    for r in found.filter("n_hit > 0").collect():
        assert sum(len(word_list(r.text[s.start : s.end])) for s in r["spans_"]) == r.n_hit


def test_many_words_have_their_codes():
    codes, windows = decontam.patterns([("a", " ".join(f"w{i}" for i in range(60_000)))], 10)
    assert len(set(codes.values())) == 60_000 and len(windows) == 59_991
    built = decontam.automaton(type("B", (), {"value": ("x", codes, windows)}))
    n, hit, ids = decontam.scan(built, "zz " + " ".join(f"W{i}" for i in range(55_290, 55_305)) + " zz w1")
    assert (n, hit.tolist(), ids) == (18, [[1, 16]], ["a"])


def test_empty_benchmark_and_table(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.decontaminate(spark.createDataFrame(documents(), SCHEMA), items)
    assert rows.filter("n_hit > 0").count() == 0 and rows.count() == len(documents())
    assert decontam.decontaminate(spark.createDataFrame([], SCHEMA), items).count() == 0
