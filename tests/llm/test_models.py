"""Trained operators by held-out accuracy, and exact top-k against brute force."""

import random
import time
import zlib

import numpy as np
from messy import docs, some

from robustlake.llm.html import MOST_NAMES, blocks_of, labelled_blocks, op3_html_extract, trained, features
from robustlake.llm.topk import Tree, exact_topk, op7_topk
from robustlake.llm import toxicity
from robustlake.llm.toxicity import DIMS, FILTERS, WIDTHS, BITS, Model, Scorer, op1_toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = op1_toxicity(documents, labels)
    own = scored.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic", "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3) == 1 for r in own)
    wrong = sum(r.predicted != r.toxic for r in own)
    missed = sum(r.predicted < r.toxic for r in own)
    assert wrong <= 0.04 * len(own) and missed <= 0.2 * sum(r.toxic for r in own)  # some labels have no toxic word to go by
    toxic, clean = [r.score for r in own if r.toxic], [r.score for r in own if not r.toxic]
    assert np.mean(np.array(toxic)[:, None] > np.array(clean)[None, :2000]) > 0.94


def test_toxicity_on_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (900, 0, 1)], "doc_id long, quality int, toxic int")
    got = op1_toxicity(docs(spark), labels).collect()
    assert len(got) == docs(spark).count() and all(0 <= r.score <= 1 for r in got)
    assert op1_toxicity(docs(spark, []), labels).count() == 0
    none = op1_toxicity(docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def loud_model():
    """Random filters: nearly every word can be a maximum."""
    rng = np.random.default_rng(5)
    size = FILTERS * len(WIDTHS)
    return Model(rng.normal(0, 1, (3 << BITS, DIMS)), [rng.normal(0, 1, (w, DIMS, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS)] * len(WIDTHS), rng.normal(0, 0.1, size), 0.0)


def test_toxicity_of_a_text_is_its_own():
    texts = [b"a quiet text", b"", b"one", None, b"two words", b"three plain words more"]
    loud = [b"words%d that%d shout%d" % (k, k, k) for k in range(40)]
    alone = [float(Scorer(loud_model()).scores([t])[0]) for t in texts]
    assert alone[1] == alone[3]
    scorer = Scorer(loud_model())
    for after in loud:
        for text, score in zip(texts, alone):
            got = scorer.scores([text, after, text])
            assert got[0] == got[2] == score


def test_toxicity_of_very_long_texts(monkeypatch):
    numbers = b" ".join(b"w%d" % k for k in range(300_000))
    got = Scorer(loud_model()).scores([b"short", numbers, b"short"])
    assert got[0] == got[2] == Scorer(loud_model()).scores([b"short"])[0]
    # parts give what the whole gives, wherever they are cut
    rng = random.Random(3)
    texts = [b" ".join(b"%d" % rng.randrange(60) for _ in range(rng.randrange(1, 80))) + b" " * rng.randrange(40) for _ in range(60)]
    whole = Scorer(loud_model()).scores(texts)
    for step in (8, 11, 30):
        monkeypatch.setattr(toxicity, "STEP_WORDS", step)
        assert max(len(own) for t in texts for own, _ in toxicity.parts_of(t)) <= step // 2 + 3
        monkeypatch.setattr(toxicity, "KEPT_WORDS", 5)
        assert (Scorer(loud_model()).scores(texts) == whole).all()


def test_toxicity_sample_is_bounded_before_it_is_collected(spark):
    own = [(k % 40, "en", "x" * (10 + k % 40)) for k in range(4000)] + [(50, "en", "y" * 900), (51, None, "z" * 300), (None, "en", "n"), (52, "en", None)]
    df = spark.createDataFrame(own, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(60)] * 3, "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(df, labels, chars=800)
    assert sum(len(r.text) for r in got) <= 800 and len(got) > 15 and len({bytes(r.text) for r in got}) == len(got)
    assert [r.text for r in got] == [r.text for r in toxicity.training_rows(df.repartition(7), labels, chars=800)]
    assert len(toxicity.training_rows(df, labels, sample=5)) <= 10


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """More toxic labels than a bounded sample would hold: a word that only the last of them have counts, too."""
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 1000, raising=False)
    rng = random.Random(8)
    words = [f"plain{k}" for k in range(300)]
    ids = [r.i for r in spark.range(4300).select(F.col("id").alias("i")).orderBy(F.xxhash64("id"), "id").collect()]
    text = lambda *own: " ".join([*rng.choices(words, k=12), *own])
    rows = [(i, "en", text("foul" if k < 3600 else "vile")) for k, i in enumerate(ids)] + [(i, "en", text()) for i in range(4300, 8600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 0, int(i < 4300)) for i in range(8600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    scores = Scorer(model).scores([text(*own).encode() for own in (["foul"], ["vile"], []) for _ in range(20)]).reshape(3, 20)
    assert scores[:2].min() > 0.7 > scores[2].max()
    again = toxicity.fit(df.repartition(7), labels)
    assert (again.embeddings == model.embeddings).all() and again.threshold == model.threshold


def test_toxicity_trains_on_long_texts_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(0, 1, (50, DIMS)).astype(np.float32)
    filters, bias = [rng.normal(0, 1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS)
    for n in (0, 1, 2, 3, 7, 8, 9, 30):  # an empty text is one zero word
        rows = rng.integers(0, 50, (n, 3)).astype(np.int32)
        whole, where = toxicity._maxima(rows, table, filters, bias)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "STEP_WORDS", 4)
            parts, there = toxicity._maxima(rows, table, filters, bias)
        assert np.allclose(whole, parts, atol=1e-5) and all((a == b).all() for a, b in zip(where, there))


def test_html_labeller_on_held_out_pages():
    pages = [labelled_blocks(5_000_000 + k) for k in range(120)]
    kept = trained().keep([features(blocks) for blocks, _ in pages])
    wrong = sum(int((k != (y > 0)).sum()) for k, (_, y) in zip(kept, pages))
    assert wrong <= 0.04 * sum(len(y) for _, y in pages)


def test_html_extraction(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></li><li><a href=/y>More</a></li></ul></nav>"
        '<!-- note --><div class="ad">Buy this now.</div><article><h1>A  title &amp; more</h1><p><b>First  part, of the text.<br><p>Second\n&eacute; part &#33; It goes on, for a while.</p></article>'
        "<footer>&copy; somebody. All rights.</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "v", page[:420]), (1, "u", page), (4, "u", "<p"), (5, "w", "<div>" * 3000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op3_html_extract(df).collect()
    text = next(r.text for r in got if r.page_id == 1)
    assert text == "A title & more\nFirst part, of the text.\nSecond é part ! It goes on, for a while."
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (2, 3, 4)} == {""}
    assert op3_html_extract(df.limit(0)).count() == 0


def test_html_of_a_long_and_deep_page_takes_steady_time():
    import time

    took = {}
    for n in (4000, 16000):
        page = "<article><h1>Title of it</h1>" + "".join(f'<div class="c{k} x{k}"><p>Paragraph {k} of the text, with some words.' for k in range(n)) + "</i>" * n
        began = time.time()
        own = blocks_of(page)
        took[n] = time.time() - began
        assert len(own) == n + 1 and max(len(path) for _, path, _ in own) <= MOST_NAMES
    assert took[16000] < 12 * took[4000] + 0.5
    kept = trained().keep([features(own)])[0]
    assert len(kept) == 16001


def test_blocks_of_broken_markup():
    assert [b[0] for b in blocks_of("a<p>b<p>c<b>d</p>e<div title='x>y'>f</div>g &am")] == ["a", "b", "cd", "e", "f", "g &am"]
    assert blocks_of("<script>x</script ><style>y") == []


def brute_topk(rows, is_query, k):
    sound = [(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(sound):
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(sound) if len(w) == len(v) and m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, 0.125]) for _ in range(3)]) for i in range(700)]
    rows += [(900 + i, [0.25, 0.25, 0.25]) for i in range(40)]
    rows += [(None, [1.0, 1.0, 1.0]), (1000, None), (1100, [None, 1.0, 1.0]), (1200, [float("nan")] * 3), (1300, [float("inf"), 1.0, 1.0]), (7, [0.5, 0.5]), (1400, [0.5, 0.25]), rows[5], rows[0], rows[0], (900, [0.25, 0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    want = brute_topk(rows, lambda q: q % 100 == 0, 10)
    assert sorted(map(tuple, op7_topk(df).collect())) == want
    small = exact_topk(df, F.col("id") % 100 == 0, k=10, shard=50)
    assert sorted(map(tuple, small.collect())) == want
    assert op7_topk(df.limit(0)).count() == 0


def test_tree_visits_no_more_than_it_must():
    rng = np.random.default_rng(2)
    points = rng.integers(-500, 500, (3000, 2))
    tree = Tree(points, np.arange(3000), 5)
    query = np.array([[3, -7]])
    want = sorted(((int(p @ query[0]), -i) for i, p in enumerate(points)), reverse=True)[:5]
    assert tree.search(query, [-1], [None]) == [[(s, -i) for s, i in want]]
    assert tree.search(query, [-1], [want[0][0] + 1]) == [[]]


def test_blocks_of_deep_markup_in_steady_time():
    took = []
    for n in (5_000, 50_000):
        begun = time.process_time()
        for page in ("<b>" * n + "x<hr>" * n, "<i><div>" + "<b>" * n + "</i>x" * n, "<ul>" + "<b>" * n + "<li>x" * n):
            blocks_of(page)
        took.append(time.process_time() - begun)
    assert took[1] < 30 * took[0]


def test_a_long_path_keeps_both_ends():
    page = "".join(f"<div class='{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}'>" for k in range(200)) + "text"
    path = blocks_of(page)[0][1]
    assert len(path) == MOST_NAMES and path[0] == "<div" and path[-1] == "hrh" and path[1] == "aaa"


def test_extraction_with_clashing_columns_and_odd_pages(spark):
    rows = [(1, "u", "<article><p>One two three.</p></article>", "t", 5), (2, None, None, None, None), (None, "v", "", "x", 1), (1, "u", "<article><p>One two three.</p></article>", "t", 5)]
    got = op3_html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect())[:2] == [(0, "v", "", 0), (1, "u", got.where("page_id = 1").first().text, got.where("page_id = 1").first().n_chars)]
    assert op3_html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
