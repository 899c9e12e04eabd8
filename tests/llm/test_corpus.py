"""The corpus operators against SQL, brute force and edge rows."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from closeline.llm import (
    decontaminate,
    html_extract,
    license_scan,
    manifest,
    mixing,
    near_dedup,
    pii,
    quality,
    suffix_dedup,
    toxicity,
    url_filter,
)
from closeline.llm.components import components
from closeline.llm.queries import QUERIES, URL_RULES
from closeline.llm.sql import ORACLE

from ..compare import assert_same, connect
from ..conftest import SF_DIR

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, pos long, label string, text_hash string"
WORDS = " ".join(f"word{i}" for i in range(60))


def documents(spark, texts):
    rows = [(i, t, "en", None if i == 2 else f"s{(i or 0) % 2}", len(t or ""), 1, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id, clashing column names."""
    long = " ".join(f"w{i % 4000}" for i in range(30000))
    return documents(
        spark,
        [(1, None), (2, ""), (3, WORDS), (3, WORDS), (4, WORDS + " end"), (None, "one"), (5, " \n"), (6, long), (3, "other")],
    )


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert assert_same(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) > 0


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_extraction_is_the_marked_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extract"](spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[row.page_id], re.S)[1]
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert row.text == " ".join(html.unescape(plain).split())
        assert row.n_chars == len(row.text)


def test_extraction_of_odd_pages(spark):
    page = (
        "<body><header>Site</header><aside>Side</aside><article><h1>A &amp; B</h1><p>One  <a href=x>two</a>th\nree</p>"
        "<div class='ad'>Buy</div><form>Name</form><p>four five six seven eight</p>"
        "<section class='comments'><p>I like it</p></section></article><footer>End</footer>"
    )
    rows = [(1, "u", page, 1), (2, "u", None, 1), (3, None, "", 1), (4, "u", "<p", 1), (4, "u", "<p", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = [(r.page_id, r.text) for r in html_extract.main_text(pages).collect()]
    assert sorted(got)[0] == (1, "A & B One twoth ree four five six seven eight")
    assert sorted(got)[1:3] == [(2, ""), (3, "")] and len(got) == 5
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post with-comments'><p>one two three</p></article>", "one two three"),
        ("<main class=has-sidebar><p>one two three</p></main>", "one two three"),
        ("<article class='comments'><p>one two three</p></article>", "one two three"),
        ("<div class=header-large><p>one two three</p></div>", "one two three"),
        ("<article><p class=notice>Beware<p>one two three<p>four five</article>", "one two three four five"),
        ("<article><ul><li class=share>Share<ul><li>it<li>now</ul><li>one two</ul><p>three four</article>", "one two three four"),
        ("<article><dl><dt class=ad>Buy<dd>one two three</dl><p>four five six</article>", "one two three four five six"),
        ("<article><table><tr><td class=ad>Buy<td>one two three<tr class=promo><td>Get<tr><td>four five</table></article>", "one two three four five"),
        ("<article><p>one two three<span class=ad><span>a</span> b</span> four</p></article>", "one two three four"),
        ("<article><p>one two three<section class='comment-list'><p>I like it</section></article>", "one two three"),
        ("<article><p>one two three<div id='comments-area'><p>I like it</div></article>", "one two three"),
        ("<article><p>one two three<ol class=commentlist><li>I like it<li>So do I</ol></article>", "one two three"),
        ("<article><p>one two three<article class='comment'><p>I like it</article> four</article>", "one two three four"),
        ("<article><p>one two three</article><section class=comments><article><p>I like it very much</article></section>", "one two three"),
        ("<article><p>one two three</article><article class='comment reply'><p>I like it very much</article>", "one two three"),
        ("<article><div class='cookie-banner'>We use some</div><p>one two three</article>", "one two three"),
        ("<article><p>one two three<div class='relatedPosts'><a href=x>Four more</a></div></article>", "one two three"),
        ("<article><p>one two three<ul class='post-comments'>" + "<li>I like it" * 40 + "</ul></article>", "one two three"),
        ("<article><p data-id='share'>one two</p><div data-role=banner>three</div></article>", "one two three"),
        ("<article><p title='a class=ad b'>one two</p><div class='article-with-comments'>three</div></article>", "one two three"),
        ("<header class=ad><article><p>one two three</article>", "one two three"),
        ("<body class='comments-open'><article class='comments-closed'><p>one two three</article>", "one two three"),
    ],
)
def test_extraction_beside_marked_elements(page, text):
    assert html_extract.extracted(page, {}) == text


def test_extraction_of_a_long_page():
    words = " ".join(f"w{i}" for i in range(300_000))
    page = f"<nav>Home</nav><article><p>{words.replace(' w150000 ', '</p><p>w150000 ')}</p></article><div class='comment-list'>{'<p>No</p>' * 50_000}</div>"
    assert html_extract.extracted(page, {}) == words


# 2


def test_decontamination_of_edge_rows(spark, edge, none):
    items = [(1, " ".join(f"WORD{i}" for i in range(5, 20))), (1, "one"), (2, None), (3, ""), (None, "other"), (10, "word1 word2")]
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.flagged(edge, items).collect()
    assert len(rows) == 9
    got = {(r.doc_id, r.n_words): r for r in rows}
    assert (got[3, 60].n_hit, got[3, 60].n_items, got[3, 60].contaminated) == (17, 2, True)
    assert got[3, 60].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert (got[None, 1].n_hit, got[None, 1].n_items) == (1, 1)
    assert (got[3, 1].n_hit, got[3, 1].n_items, got[3, 1].contaminated) == (1, 0, True)
    assert (got[1, 0].n_hit, got[1, 0].items_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert decontaminate.flagged(none, items).count() == 0
    assert decontaminate.flagged(edge, items.limit(0)).where("contaminated").count() == 0


# 3


def test_repeated_passages_are_those_of_brute_force(spark, texts):
    rows = suffix_dedup.repeated_passages(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts}
    seen = defaultdict(set)
    for i, w in split.items():
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add(i)
    expected = set().union(*(ids for ids in seen.values() if len(ids) > 1))
    found = set()
    for r in rows:
        one = split[r.doc_id][r.start : r.start + r.n_words]
        assert one == split[r.other_doc_id][r.other_start : r.other_start + r.n_words]
        assert len(one) == r.n_words >= 50 and r.doc_id != r.other_doc_id
        found |= {r.doc_id, r.other_doc_id}
    assert found == expected


def test_passages_of_edge_rows(edge, none):
    rows = suffix_dedup.repeated_passages(edge).collect()
    assert [(sorted((r.doc_id, r.other_doc_id)), r.start, r.n_words) for r in rows] == [([3, 4], 0, 60)]
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_windows_around_one_suffix_return_a_pair_once(spark):
    """Two documents share 2,000 words: a pair for each suffix, not for each chunk that holds some of the windows."""
    shared = [str(i) for i in range(2000)]
    docs = documents(spark, [(i, " ".join([f"own{i}", *shared])) for i in (1, 2)])
    held = suffix_dedup.suffixes(docs, 50).groupBy("doc_id", "text_hash").agg(F.collect_set("prefix").alias("prefixes"))
    texts = docs.select("doc_id", "text").join(held, "doc_id").select("doc_id", "text_hash", "text", "prefixes")
    found = suffix_dedup.shared_windows(texts, 50).toPandas()
    rows = found.sort_values([*found.columns[:-2], "doc_id"], ignore_index=True)
    chunks = [rows.iloc[max(0, i - 2) : i + 40] for i in range(0, len(rows), 40)]
    each = sum(len(suffix_dedup._matches(chunk)) for chunk in chunks)
    suffixes = found["prefix"].nunique()
    assert len(rows) >= 2 * 1951 and suffixes <= each <= suffixes + len(chunks)
    assert found.drop_duplicates(["prefix", "window"])["window"].is_unique


def test_passages_behind_a_common_boilerplate(spark):
    """45 words that 100 documents of 1,000 each hold; two of each go on alike, one document holds a passage twice."""
    rng = random.Random(3)

    def own(n):
        return [str(rng.random()) for _ in range(n)]

    rows = []
    for _ in range(10):
        form, tail = own(45), own(6)
        rows += [own(20) + form + (tail if i in (30, 70) else []) + own(20) for i in range(100)]
    rows.append(rows[30][20:73] * 2)
    split = dict(enumerate(rows))
    holders = defaultdict(set)
    for i, w in split.items():
        for s in range(len(w) - 49):
            holders[tuple(w[s : s + 50])].add(i)
    expected = {(i, s + k) for i, w in split.items() for s in range(len(w) - 49) if len(holders[tuple(w[s : s + 50])]) > 1 for k in range(50)}
    found = set()
    docs = documents(spark, [(i, " ".join(w)) for i, w in split.items()])
    for r in suffix_dedup.repeated_passages(docs).collect():
        assert split[r.doc_id][r.start : r.start + r.n_words] == split[r.other_doc_id][r.other_start : r.other_start + r.n_words]
        found |= {(r.doc_id, r.start + k) for k in range(r.n_words)} | {(r.other_doc_id, r.other_start + k) for k in range(r.n_words)}
    assert expected and found == expected


# 4


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no mark", "", "", None, "allow"),
        ("http://A.Example.NET/en/x?/q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/de/", "a.example.net", "/de/", "net/", "block"),
        ("http://a.example.net", "a.example.net", "", None, "allow"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://ÉA.org/fr/", "Éa.org", "/fr/", "org/fr/", "allow"),
        ("http://a.org/french", "a.org", "/french", None, "allow"),
    ],
)
def test_urls(url, host, path, rule, verdict):
    assert url_filter.split_url(url) == (host, path)
    assert url_filter.deciding(url_filter.trie(URL_RULES), host, path) == (rule and (rule, verdict))


def test_url_rules_without_verdict_are_refused(spark):
    clash = [url_filter.Rule("a", "/", "allow"), url_filter.Rule("a", "/", "block")]
    with pytest.raises(ValueError):
        url_filter.trie(clash)
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter.judged(pages, URL_RULES).count() == 0


# 5


def test_license_base_places(spark, texts):
    got = by_id(QUERIES["op5_license_scan"](spark, SF_DIR))
    assert len(got) == len(texts)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        places, found = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [s for s in range(len(w)) if w[s : s + len(p)] == p]
            places += at
            found |= {label} if at else set()
        row = got[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(w), len(places), ",".join(sorted(found)))
        assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
        assert found <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_license_spans_and_edge_rows(spark, edge, none):
    rows = [(1, "x Licensed under the quite Apache License, Version 2.0 y"), (2, "cc by cc BY"), (3, "Apache license")]
    got = by_id(license_scan.scanned(documents(spark, rows)))
    assert got[1].labels == "apache-2.0" and got[1].n_base == 0
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].score) == (2, 0, 2, 1.0)
    assert got[3].labels == "" and 0 < got[3].score < 1
    assert license_scan.scanned(edge).where("labels = '' AND n_base = 0").count() == 9
    assert license_scan.scanned(none).count() == 0


# 6


def test_mix_takes_its_targets(spark):
    rows = QUERIES["op6_mixing"](spark, SF_DIR).collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 0.5 for (_, target), n in taken.items())
    total = sum(r.size for r in rows)
    assert sum(t for _, t in taken) == pytest.approx(1.5 * total)


def test_mix_of_edge_rows(edge, none):
    rows = mixing.mix_digest(edge).collect()
    assert len(rows) == 9 and sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=3)
    assert mixing.mix_digest(none).count() == 0


def test_mixed_text_holds_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    parts = mixing.mixed_text(docs).select("doc_id", "words", F.size(F.split("text", " ")).alias("n"))
    assert parts.where("words <> n").count() == 0
    digest = QUERIES["op6_mixing"](spark, SF_DIR)
    by_document = {r.doc_id: r.n for r in parts.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert by_document == {r.doc_id: r.taken for r in digest.where("taken > 0").collect()}


# 7

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans_are_those_of_the_patterns(texts):
    odd = ["a@b@c.de x..y@z.co.uk@w.com", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "@a.b a@.b a@b a@b.c-", "0" * 5000 + ".1.1.1"]
    for text in [t for _, t in texts] + odd:
        got = pii.base_spans(text)
        assert [s for s in got if s[0] == "email"] == [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    assert pii.base_spans("4111 1111-1111 1111, 4111111111111112") == [("card", 0, 19)]
    assert pii.base_spans("+1 (499) 555-6503.") == [("phone", 0, 17)]
    assert [s[1:] for s in pii.base_spans(odd[1])] == [(0, 7), (8, 15), (26, 36)]


def test_gradient_of_the_network():
    import numpy as np

    rng = np.random.default_rng(0)
    w = pii.initial(rng)
    ids, labels = rng.integers(1, 130, (2, 6)), rng.integers(0, pii.LABELS, (2, 6))
    _, gradient = pii.loss_and_gradient(ids, labels, w)
    for name in w:
        at = (ids[0, 2], 3) if name == "embedding" else tuple(rng.integers(0, n) for n in w[name].shape)
        step, losses = 1e-5, []
        for sign in (1, -1):
            w[name][at] += sign * step
            losses.append(pii.loss_and_gradient(ids, labels, w)[0])
            w[name][at] -= sign * step
        assert (losses[0] - losses[1]) / 2 / step == pytest.approx(gradient[name][at], abs=1e-5)


def test_windows_are_reconciled_over_the_text(spark):
    """The network, trained on the small tables, finds the patterns' spans of other texts."""
    weights = pii.fitted(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    text = "word " * 30 + "call +1 (499) 555-6503 now " + "word " * 20
    at = pii.starts(text)
    labels = pii.reconciled(len(text), at, pii.best_paths(pii.window_rows(pii.encoded(text), at), weights))
    assert labels.any() and set(pii.decoded_spans(labels)) >= set()
    base, every = pii.spans_of([text], weights)[0]
    assert base == [("phone", 155, 172)] and set(base) <= set(every)
    assert pii.redacted(text, base)[150:170] == "call <PHONE> now wor"


def test_pii_of_edge_rows(edge, none):
    rows = pii.found(edge).collect()
    assert len(rows) == 9 and all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in rows)
    assert {r.text_hash for r in rows} == {"y"}
    assert pii.found(none).count() == 0


# 8


def test_toxicity_finds_held_out_toxic_texts(spark):
    bad = ["idiot moron", "scum trash loser", "moron scum idiot"]
    rows = [(i, f"{WORDS} {bad[i % 3]} {WORDS} {bad[(i + 1) % 3]}" if i % 2 else f"{WORDS} plain {i} {WORDS}") for i in range(300)]
    docs = documents(spark, rows)
    marks = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, marks).where("held_out").collect()
    assert len(got) > 30 and all(r.predicted == r.doc_id % 2 for r in got)
    held = marks.where(~toxicity.held_out(F.col("doc_id")))
    again = {r.doc_id: r.score for r in toxicity.scored(docs, held).where("held_out").collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_toxicity_of_edge_rows(edge, none, labels):
    rows = toxicity.scored(edge, labels).collect()
    assert len(rows) == 9 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.scored(none, labels).count() == 0


def test_toxicity_is_calibrated_on_whole_texts(spark):
    """Toxic words of long texts lie between the windows that train the dictionaries."""
    rng = random.Random(2)
    plain = [f"plain{i}" for i in range(400)]

    def text(i):
        found = rng.choices(plain, k=1200)
        if i % 2:
            found[600] = "idiot moron scum trash loser"
        return " ".join(found)

    rows = [(i, text(i)) for i in range(60)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(documents(spark, rows), marks)
    trained = spark.createDataFrame(rows, "doc_id long, text string").where(~toxicity.held_out(F.col("doc_id"))).collect()
    distance = toxicity.Distance(model.toxic, model.ordinary)
    found = {r.doc_id: distance.of(toxicity.windows(r.text)) for r in trained}
    high = sorted(d for i, ds in found.items() if i % 2 == 0 for d in ds)
    assert high[int(0.99 * (len(high) - 1))] <= model.high <= high[math.ceil(0.99 * (len(high) - 1))]
    features = [toxicity.features(ds, model.high) for ds in found.values()]
    assert model.centre == pytest.approx([sum(column) / len(column) for column in zip(*features)])


def test_toxicity_of_few_short_texts(spark):
    bad = ["idiot", "moron", "scum", "trash", "loser"]
    rows = [(i, f"you {bad[i % 5]} and {bad[i % 4]}, number {i}" if i < 60 else f"the weather of day {i} is fine") for i in range(400)]
    marks = spark.createDataFrame([(i, 1, int(i < 60)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.scored(documents(spark, rows), marks).where("held_out").collect()
    assert len(got) > 30 and all(r.predicted == int(r.doc_id < 60) for r in got)


def test_stretches_join_telling_grams():
    telling = np.sort(np.unique(np.concatenate([toxicity.packed(w, toxicity.GRAM) for w in (b" idiot ", b"moron of")])))
    text = b"such an idiot or a moron of sorts, idiot"
    assert toxicity.stretches(text, telling) == {b" idiot ", b"moron of", b" idiot"}
    assert toxicity.stretches(b"", telling) == set() == toxicity.stretches(b"short", telling)
    assert toxicity.packed(b"abcdefgh", 6).tolist() == [int.from_bytes(b"abcdefgh"[i : i + 6], "big") for i in range(3)]


def test_near_copies_do_not_fill_a_dictionary(spark):
    """A toxic text in 200 near copies counts once; the words of the 40 others are learned."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(500)]
    copied = rng.choices(words, k=80)

    def text(i):
        if i < 200:
            return " ".join([*copied[:-1], f"copy{i}"])
        found = rng.choices(words, k=80)
        if i < 240:
            found[rng.randrange(80)] = rng.choice(["wretched", "repulsive"])
        return " ".join(found)

    rows = [(i, text(i), int(i < 240)) for i in range(500)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("text_hash", F.xxhash64("text"))
    toxic, ordinary = toxicity.trained(texts.select("doc_id", "text_hash", "toxic", "text"))
    assert b"wretched" in toxic and b"repulsive" in toxic and " ".join(copied[:6]).encode() not in toxic
    assert b"wretched" not in ordinary


# 9


def test_near_duplicates_of_edge_rows(edge, none):
    rows = near_dedup.near_duplicates(edge, width=2).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got[:3] == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True)]
    assert got[3:7] == [(3, 1, 3, True), (3, 59, 3, True), (3, 59, 3, True), (4, 60, 3, False)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_links_of_crowded_regions(spark):
    """Copies near one text alone, and near copies among many texts that are alike but not linked."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(vocabulary)
        return out

    hub, form = ([rng.choice(vocabulary) for _ in range(120)] for _ in range(2))
    rows = [hub] + [edited(hub, 6) for _ in range(400)]
    forms = [edited(form, 10) for _ in range(200)]
    rows += forms + [edited(rng.choice(forms), 4) for _ in range(30)]
    sets = [set(zip(w, w[1:])) for w in rows]
    held = defaultdict(list)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, one in enumerate(sets):
        shared = Counter(j for gram in one for j in held[gram])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(one) + len(sets[j]) - n):
                low, high = sorted((find(i), find(j)))
                label[high] = low
        for gram in one:
            held[gram].append(i)
    docs = documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_links_of_crowded_regions_are_exact(spark):
    """Pairs among texts at similarity 0.7 to 0.79."""
    rng = random.Random(9)
    form = [f"f{i}" for i in range(200)]
    rows = []
    for i in range(300):
        rows.append(form[: 172 + i % 3] + [f"own{i}_{k}" for k in range(26)])
        if i % 10 == 0:
            rows.append(rows[-1][:-10] + [f"new{i}_{k}" for k in range(10 + i % 4)])
    rng.shuffle(rows)
    sets = [set(zip(w, w[1:])) for w in rows]
    label = list(range(len(rows)))
    for j, two in enumerate(sets):
        for i in range(j):
            shared = len(sets[i] & two)
            if 100 * shared >= 80 * (len(sets[i]) + len(two) - shared):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) == 300
    docs = documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == dict(enumerate(label))


def test_components_of_a_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("id <> 99")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {n: 0 if n < 100 else 100 for n in range(201)}


# 10


def test_base_counts_are_those_of_brute_force(spark, texts, edge):
    rows = {r.doc_id: r for r in quality.base_counts(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    for i, text in texts:
        assert_base(rows[i], text)
    for row in quality.base_counts(edge).collect():
        assert_base(row, row.text or "")


def assert_base(row, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {s + k for s, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
    assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_repeats_in_texts_too_long_to_pack(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    text = "a b c d e f g h i j k a b c x a b c"
    row = quality.base_counts(documents(spark, [(1, text)])).first()
    assert row.n_repeat_words == 9


def test_log_ratio_is_that_of_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    marks = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    trusted = {r.doc_id for r in quality.trusted_ids(marks).collect()}

    def signed(n):
        return n - (1 << 64) if n >> 63 else n

    def buckets(text):
        tokens = re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", re.sub(r"[\t\n\x0b\x0c\r]", " ", text)).split(" ")
        uni = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens if t]
        two = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42) for a in uni]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), h) for h, b in zip(two, uni[1:])] + two[-1:]
        return [signed(h) % quality.BUCKETS for h in uni + two]

    raw, target = Counter(), Counter()
    for i, text in texts:
        raw.update(buckets(text))
        target.update(buckets(text) if i in trusted else [])
    even = quality.BUCKETS
    totals = sum(target.values()) + even, sum(raw.values()) + even
    got = {r.doc_id: r for r in quality.judged(docs, marks).collect()}
    for i, text in texts:
        found = buckets(text)
        if found:
            mean = sum(math.log((target[b] + 1) / totals[0]) - math.log((raw[b] + 1) / totals[1]) for b in found) / len(found)
            assert got[i].log_ratio == pytest.approx(mean, abs=1e-6)
            assert got[i].kept == (not got[i].base_failed and got[i].log_ratio >= quality.THRESHOLD)


def test_target_is_counted_over_every_trusted_document(spark, monkeypatch):
    more = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(more).count() == 60_000
    docs = spark.range(60_010).selectExpr("IF(id < 60000, id, NULL) AS doc_id", "IF(id < 60000, 'good', 'other') AS text")
    few = quality.bucket_weights(docs, quality.trusted_ids(more)).first()["weights"]
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    many = quality.bucket_weights(docs, quality.trusted_ids(more)).first()["weights"]
    even = quality.BUCKETS
    weight = round(1e6 * math.log((120_020 + even) / (120_000 + even)))
    assert few.count(weight) == even - 2 and few == many


def test_counts_hash_the_tokens_once(edge, labels):
    weights = quality.bucket_weights(edge, quality.trusted_ids(labels))
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_quality_of_edge_rows(edge, none, labels):
    assert quality.judged(edge, labels).count() == 9
    assert all(r.kept == (not r.base_failed) for r in quality.judged(edge, labels.limit(0)).collect())
    assert quality.judged(none, labels).count() == 0


def test_manifest_joins_a_level_at_a_time(spark):
    """The leaves are numbered once, and the last plan holds the join of the leaves with their parents alone."""
    docs = documents(spark, [(i, f"text {i}") for i in range(300)])
    found = manifest.manifest(docs, manifest.every_fifth())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"\w+Join ", plan)) <= 2
    assert found.where("doc_id % 5 >= 0").count() == 300


# pipeline


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        path = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "mixing":
            assert docs.columns == before["quality"].columns

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    kept = quality.judged(before["quality"], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert ids(before["near_dedup"]) == ids(kept.drop("text").where("kept"))
    sets = {r.doc_id: near_dedup.shingles(r.text, 5) for r in before["near_dedup"].collect()}
    left = sorted(ids(before["decontaminate"]))
    for i in sets:
        for j in left:
            if j < i:
                shared = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                alike = 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared)
                assert not (alike and i in left)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    marks = decontaminate.flagged(before["decontaminate"], items)
    assert ids(before["pii"]) == ids(marks.where("NOT contaminated"))
    assert ids(before["mixing"]) == ids(before["pii"])
    assert not any(pii.base_spans(r.text) for r in before["mixing"].collect())
    assert ids(docs) <= ids(before["mixing"]) and docs.count() > 0


def test_stages_of_edge_rows(spark, edge):
    """Null ids and an id of two texts are documents of their own in every stage."""
    rows = [(i, t) for i, t in edge.select("doc_id", "text").collect()] + [(None, "two words"), (None, "two words"), (8, "two words")]
    docs = documents(spark, rows)
    expected = [(1, None), (2, ""), (3, WORDS), (3, "other"), (5, " \n"), (6, rows[7][1]), (8, "two words"), (None, "one")]
    texts = {i: {t for j, t in rows if j == i} for i, _ in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).select("doc_id", "text").collect()
        if name in ("near_dedup", "decontaminate"):
            assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected if name == "near_dedup" else rows))
        elif name == "quality":
            assert {(r.doc_id, r.text) for r in out} <= set(rows)
        elif name == "pii":
            assert len(out) == len(rows)
        elif name == "mixing":
            assert all(any(r.text in " ".join((t or "").split()) for t in texts[r.doc_id]) for r in out)


def test_windows_decoded_together_are_those_of_each_text():
    rng = np.random.default_rng(3)
    weights = {k: v.astype(np.float32) for k, v in pii.initial(rng).items()}
    texts = ["".join(rng.choice(list("ab1@. +2345"), size=n)) for n in (0, 1, 60_000, 9, 64, 65, *rng.integers(1, 3000, 40), 1)]
    texts.insert(3, "no sign")
    found = list(pii.decoded(texts, weights))
    assert len(found) == len(texts)
    for text, labels in zip(texts, found):
        at = pii.starts(text)
        paths = pii.best_paths(pii.window_rows(pii.encoded(text), at), weights) if at else []
        alone = pii.reconciled(len(text), at, paths)
        # Sums in single precision may differ by the batch they are in.
        assert len(labels) == len(text) and (labels != alone).sum() <= len(text) // 1000
