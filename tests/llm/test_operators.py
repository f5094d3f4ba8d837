"""Each operator against brute force, a round trip, or held-out rows; and the awkward inputs."""

import html as stdlib_html
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnholm.llm import chat, decontam, html, langid, packing, simhash, substring, topk, toxicity, warc
from tarnholm.llm.text import U, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept string, tokens int, _rank int"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", "k", 1, 2) for i, t in rows], DOCS)


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"word{rng.integers(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"edit{rng.integers(10**6)}" if rng.random() < share else x for x in text.split(" "))


AWKWARD = [(1, None), (2, ""), (None, "no id here at all"), (3, " \n "), (4, "!!! ???"), (5, "one"), (5, "one"), (5, "another text"), (6, "x" * 300_000), (7, "Ünïcode 漢字 \0 end")]


# packing
def test_packing_round_trip_and_lengths(spark):
    texts = AWKWARD + [(10, "A plain  text,\twith odd\n white space. "), (11, "word " * 5000)]
    rows = packing.pack(docs_of(spark, texts), max_len=256).collect()
    t = packing.Tokenizer(Path(packing.VOCAB).read_bytes())
    for r in rows:
        assert r.length == len(r.tokens) == 2**r.bucket <= 256
    assert not [r for r in rows if r.doc_id == 1]
    for doc in (2, 7, 10, 11, None, 6):
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        tokens = [x for r in pieces for x in r.tokens]
        assert tokens[-1] == t.end
        assert t.encoding.decode(tokens[:-1]) == dict(texts)[doc]
        small = [r.length for r in pieces if r.length < 256]
        assert small == sorted(set(small), reverse=True)  # the binary digits
    assert len([r for r in rows if r.doc_id == 5 and r.piece == 0]) == 3
    assert packing.pack(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs_of(spark, []), max_len=100)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 1000])
def test_decompose_adds_up(n):
    cut = packing.decompose(n, 256)
    assert sum(cut) == n and all(x & (x - 1) == 0 for x in cut)


# capture index
PAGES = "page_id long, url string, html string, urlkey string"


def test_capture_index_against_sql_with_repeats_nulls_and_ties(spark):
    rows = [(1, "http://www.A.com/x#f", "a", ""), (2, "https://a.com:443/x", "a", ""), (2, "https://a.com:443/x", "a", ""), (3, None, None, ""), (None, "http://b.org", "b", ""), (4, "http://user@b.org/?q=1", "", ""), (5, "", "c", "")]
    rows += [(i, f"http://h{i % 7}.net/{i % 3}", f"body {i % 5}", "") for i in range(100, 400)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, warc.capture_index(df).select("position", "urlkey", "captured_at", "page_id", "url", "digest", "bytes", "capture_no", "changed").collect()))
    con = duckdb.connect()
    con.register("pages", pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r)) for r in rows], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])))
    want = con.execute(f"SELECT position, urlkey, captured_at, page_id, url, digest, bytes, capture_no, changed FROM ({warc.SQL})").fetchall()
    assert got == sorted(want)
    assert warc.capture_index(spark.createDataFrame([], PAGES)).count() == 0


def test_capture_times_of_the_table_and_order_of_delivery(spark):
    rows = [(i, f"http://h{i % 11}.net/{i % 3}", f"body {i % 5}", None if i % 13 == 0 else (i * 7919) % 1009) for i in range(600)]
    got = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string, captured_at int")).collect()
    assert [r.position for r in got] == list(range(600))
    assert {r.page_id: r.captured_at for r in got} == {r[0]: r[3] for r in rows}
    key = lambda r: (r.urlkey, r.captured_at is not None, r.captured_at or 0, r.page_id)
    assert got == sorted(got, key=key)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x),) for x in rng.integers(0, 20, rng.integers(0, 30))) for _ in range(k)]
    got = [(runs[w][i], w, i) for w, i in warc.LoserTree(runs)]
    assert got == sorted((x, w, i) for w, r in enumerate(runs) for i, x in enumerate(r))


# chat
def test_template_language():
    t = chat.Template("{% for m in messages %}{% if loop.first %}<{% elif m.role == 'x' %}?{% else %},{% endif %}{{ m.content | trim | upper }}{% else %}nobody{% endfor %}")
    assert t.render(messages=[{"role": "a", "content": " b "}, {"role": "x", "content": "c"}, {"role": "y", "content": "d"}])[0] == "<B?C,D"
    assert t.render(messages=[])[0] == "nobody"
    assert chat.Template("{{ 'a' ~ 1 + 2 }}{# no #}{{ missing }}{{ missing is defined }}{{ [1, 2, 3][1:] | join('-') }}").render()[0].startswith("a")
    assert chat.Template("a {%- if true -%} b {%- endif -%} c").render()[0] == "abc"


def test_constants_are_folded():
    assert chat.Template("x{{ 1 + 2 }}{% if 1 > 2 %}never{% else %}y{% endif %}").tree == ("body", [("text", "x3y")])
    assert chat.Template("{{ 1 / 0 }}").tree[1][0][0] == "show"  # the error belongs to rendering


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if 1 %}", "{{ a | nofilter }}", "{{ f() }}", "{% endfor %}", "{{ 'open }}", "{% include 'x' %}"])
def test_errors_of_a_template(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source).render()


def test_the_sandbox_has_no_python_attributes():
    out = chat.Template("{{ m.__class__ }}{{ m.content.__len__ }}{{ m['__class__'] }}").render(m={"content": "x"})[0]
    assert out == ""


CONVERSATIONS = "conv_id long, turn long, role string, text string, turns int, message string"


def test_conversations_against_sql(spark):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", "ho"), (1, 1, "assistant", "ho"), (1, None, None, None), (None, 0, "system", ""), (2, 0, "assistant", "x" * 50_000)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], CONVERSATIONS)
    got = sorted(map(tuple, chat.format_conversations(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]))
    assert got == sorted(con.execute(chat.SQL).fetchall(), key=repr)
    text, marks = got[0][2], got[0][3].split(";")
    assert [text[slice(*map(int, m.split(":")))] for m in marks] == ["ho<|im_end|>"] * 2
    assert chat.format_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# language
def test_language_of_held_out_texts(spark):
    rng = np.random.default_rng(1)
    letters = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éèüöaeio"}

    def text(lang):
        return " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 8))) for _ in range(rng.integers(5, 80)))

    rows = [(i, text(lang), lang) for i in range(150) for lang in letters]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [(i, text(lang), lang) for i in range(60) for lang in letters]
    got = langid.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), net).collect()
    assert np.mean([g.language == f[2] for g, f in zip(got, fresh)]) >= 0.95
    odd = langid.identify(docs_of(spark, AWKWARD), net).collect()
    assert len(odd) == len(AWKWARD)
    assert all(r.language is None and r.windows == 0 for r in odd if r.doc_id in (1, 2))
    assert next(r.windows for r in odd if r.doc_id == 6) == -(-300_000 // langid.WINDOW)
    assert langid.language_id(docs_of(spark, [])).count() == 0


def test_a_rare_language_is_in_the_sample_of_a_large_table(spark):
    rows = [(i, f"text number {i}", "aa") for i in range(6000)] + [(6000 + i, f"éèü {i}", "zz") for i in range(60)]
    rows += [(7000 + i, f"öäß {i}", "yy") for i in range(3)] + [(8000, "", "none"), (8001, None, "none")]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert net.classes == ["aa", "yy", "zz"]


def test_languages_of_rows_without_ids(spark):
    rng = np.random.default_rng(9)
    words = {"aa": ["abba", "kala"], "bb": ["zorf", "quix"]}
    rows = [(None, " ".join(rng.choice(words[x], 20)) + f" {i}", x) for i in range(300) for x in words]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert net is not None and net.classes == ["aa", "bb"]


def test_tables_give_what_the_filters_give():
    net = langid.ByteNet(["a", "b"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    h = []
    for f, b in zip(net.filters, net.bias):
        n = langid.WINDOW - len(f) + 1
        h.append(np.maximum((sum(f[j][x[:, j : j + n]] for j in range(len(f))) + b).max(axis=1), 0))
    assert np.allclose(net.features(x, net.tables()), np.concatenate(h, axis=1), atol=1e-5)


# toxicity
def toxic_corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{int(rng.zipf(1.4)) % 3000}" for _ in range(rng.integers(20, 200))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words[rng.integers(len(words))] = f"vile{'abcdef'[rng.integers(6)]}"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    rows, labels = toxic_corpus(rng, 900)
    seen = spark.createDataFrame(labels[:600] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, rows[:600]), seen)
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs_of(spark, rows[600:]), model).collect()}
    truth = {i: bool(t) for i, _, t in labels[600:]}
    hit = sum(got[i] for i in truth if truth[i]) / sum(truth.values())
    wrong = sum(got[i] for i in truth if not truth[i]) / sum(not t for t in truth.values())
    assert hit >= 0.9 and wrong <= 0.02
    odd = toxicity.classify(docs_of(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and not any(r.toxic for r in odd)
    kept = toxicity.reject(docs_of(spark, rows[600:] + AWKWARD), model)
    assert kept.columns == docs_of(spark, []).columns and kept.count() == len(rows[600:]) + len(AWKWARD) - sum(got.values())


def test_toxicity_from_positives_alone(spark):
    rng = np.random.default_rng(3)
    rows, labels = toxic_corpus(rng, 1500)
    truth = {i: bool(t) for i, _, t in labels}
    only = spark.createDataFrame([x for x in labels[:900] if x[2]], "doc_id long, quality int, toxic int")
    everything = docs_of(spark, rows + [(None, rows[0][1])])
    got = {r.doc_id: r.toxic for r in toxicity.classify(everything, toxicity.train(everything, only)).collect()}
    assert sum(got[i] for i in truth if truth[i]) >= 0.9 * sum(truth.values())
    assert sum(got[i] for i in truth if not truth[i]) <= 0.02 * len(truth)


def test_the_prior_is_bounded_by_the_strongest_words():
    rng = np.random.default_rng(8)
    for prior in (0.02, 0.1, 0.3):
        toxic = rng.random(4000) < prior
        xu = (rng.random((4000, 6)) < np.where(toxic[:, None], 0.5, 0.0)).astype(np.float32)
        xp = (rng.random((1000, 6)) < 0.5).astype(np.float32)
        assert abs(toxicity.estimate_prior(xp, xu) - prior) < 0.15 * prior + 0.005


def test_without_positives_or_rows_nothing_is_toxic(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs_of(spark, [(1, "a b c")]), labels).collect()[0].toxic is False
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0


def test_the_negative_risk_is_corrected():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 5)) < 0.1).astype(np.float32)
    positive = np.arange(400) < 100
    x[:, 0] = 0
    x[:130, 0] = 1  # positives, 30 of them among the unlabelled
    w, b = toxicity.fit_nnpu(x[positive], x[~positive], prior=0.1)
    assert w.min() >= 0 and w[0] + b > 0 > w[1:].max() + b


# html
def test_content_regions_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.content for r in html.extract_pages(pages).collect()}
    recall, precision = [], []
    for r in pages.collect():
        m = re.search(r"<article>(.*)</article>", r.html, re.S)
        want = set(stdlib_html.unescape(re.sub(r"<[^>]+>", " ", m[1])).split())
        words = got[r.page_id].split()
        recall.append(len(want & set(words)) / len(want))
        precision.append(sum(w in want for w in words) / len(words))
    assert np.mean(recall) > 0.97 and np.mean(precision) > 0.9


def test_awkward_pages(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p>one</p>", 0), (3, "u", "<script>x<y</script>", 0), (4, "u", "<p>un<b>closed & <i>broken", 0), (5, "u", "plain text", 0), (5, "u", "plain text", 0), (6, "u", "<div>" * 5000 + "deep", 0)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, content int")).collect()
    assert [r.content for r in got] == ["", "", "one", "", "unclosed & broken", "plain text", "plain text", "deep"]
    assert html.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>t</title><body><p>text</p></body>",
        "<html><head><title>t</title><meta charset=x><link href=y><p>text</p></html>",
        "<head><noscript><img src=x></noscript><title>t</title></head><body><p>text</body>",
        "<head><title>t</title>text",
        "<body><svg><path><p>text</p></body>",
        "<body><iframe src=x><p>text</p></body>",
        "<body><noscript><svg></svg><p>text</p></body>",
        "<body><template><p>text</p>",
        "<body><svg><svg>no</svg><p>text</p></body>",
        "<body><svg><text>no</text></svg><iframe>no</iframe><noscript><p>no</p></noscript><p>text</p>",
    ],
)
def test_optional_and_missing_end_tags_hide_no_text(page):
    assert html.extract(page)[0] == "text"


def test_a_short_line_between_long_ones_is_kept_and_a_menu_is_not():
    long = "word " * 60
    page = "<ul>" + "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(30)) + f"</ul><p>{long}</p><p>short</p><p>{long}</p>"
    content, _, _ = html.extract(page)
    assert "short" in content and "m3" not in content.split()


# near duplicates
def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        base = sentence(rng, 150)
        rows += [(len(rows) + j, base if j == 0 else edited(rng, base, 0.02)) for j in range(rng.integers(1, 5))]
    rows += [(10_000, rows[0][1]), (None, rows[0][1])]
    got = simhash.near_duplicates(docs_of(spark, rows + AWKWARD)).collect()
    assert len(got) == len(rows) + len(AWKWARD)
    texts = [t for _, t in rows]
    a, b, _ = simhash.fingerprints(pa.array(texts))
    ham = lambda x: np.bitwise_count(x[:, None] ^ x[None, :])
    ha, hb = ham(a), ham(b)
    near = ((ha <= simhash.RADIUS) & (hb <= simhash.SUPPORT)) | ((hb <= simhash.RADIUS) & (ha <= simhash.SUPPORT))
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, []).append(i)
    group_of = {rows[i][0]: min(rows[j][0] for j in g if rows[j][0] is not None) for g in want.values() for i in g}
    for r in got:
        if r.doc_id in group_of and r.group_size == len(next(g for g in want.values() if any(rows[j][0] == r.doc_id for j in g))):
            assert r.group_id == group_of[r.doc_id]
    assert sum(r.duplicate for r in got if r.doc_id is None or r.doc_id < 1 or r.doc_id > 7) >= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[10_000].duplicate and by_id[10_000].group_id == 0
    assert not by_id[1 if rows[1][0] != 1 else 2].group_size == 0


def test_planted_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(5)
    base = [sentence(rng, 200) for _ in range(80)]
    rows = list(enumerate(base)) + [(1000 + i, edited(rng, t, 0.02)) for i, t in enumerate(base[:40])]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert sum(got[1000 + i].group_id == i for i in range(40)) >= 37
    assert not any(got[i].duplicate for i in range(80))


def test_stage_keeps_one_of_each_group_and_all_columns(spark):
    rng = np.random.default_rng(6)
    t = sentence(rng, 100)
    rows = [(3, t), (1, t), (2, t.replace("word1", "word1")), (9, "other " + sentence(rng, 100)), (9, None), (8, ""), (8, "")]
    kept = simhash.drop_near_duplicates(docs_of(spark, rows + [(1, t)]))
    assert kept.columns == docs_of(spark, []).columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [1, 8, 8, 9, 9]
    assert simhash.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_bk_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(7)
    p = rng.integers(0, 2**63, 300).astype(np.uint64)
    p[100:200] = p[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    p[200:250] = p[200]
    start = np.repeat([0, 150], 150)
    q, n = simhash.Forest(p, start).search(np.arange(300), 5)
    want = {(i, j) for i in range(300) for j in range(i) if start[i] == start[j] and bin(int(p[i] ^ p[j])).count("1") <= 5}
    assert set(zip(q.tolist(), n.tolist())) == want


@pytest.mark.parametrize("count", [10, 10**6, 10**8, 10**10])
def test_any_two_within_the_radius_share_a_mask(count):
    mask = simhash.masks(*simhash.plan_blocks(count))
    rng = np.random.default_rng(count)
    for _ in range(50):
        diff = sum(1 << int(b) for b in rng.choice(64, simhash.RADIUS, replace=False))
        assert ((mask & U(diff)) == 0).any()


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101)]
    spark.sparkContext.setCheckpointDir("/tmp/checkpoint-tests")
    got = {r.node: r.root for r in simhash.connect(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100}


# decontamination
def brute_contamination(items, docs, threshold):
    out = set()
    for i, item in items:
        iw = Words(pa.array([item]))
        ih, iwt = decontam.shingles(iw)
        m = len(ih)
        if m < decontam.SHINGLE:
            continue
        ib = decontam.bag(ih[: m - 2], iwt[: m - 2])
        for d, text in docs:
            w = Words(pa.array([text], pa.string()))
            h, wt = decontam.shingles(w)
            n = len(h)
            if n < decontam.SHINGLE:
                continue
            size = min(m, n)
            best = max(decontam.similarity(decontam.bag(h[s : s + size - 2], wt[s : s + size - 2]), ib) for s in range(n - size + 1))
            if best >= threshold:
                out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [(i, sentence(rng, int(rng.integers(8, 50)), 300)) for i in range(20)] + [(98, None), (99, ""), (97, "two words")]
    rows = []
    for k in range(60):
        body = sentence(rng, int(rng.integers(5, 120)), 300).split(" ")
        if k % 3 == 0:
            at = rng.integers(len(body) + 1)
            body[at:at] = edited(rng, items[k % 20][1], [0, 0.05, 0.1][k // 3 % 3]).split(" ")
        rows.append((k, " ".join(body)))
    rows += [(200, items[0][1]), (201, " ".join(items[1][1].split(" ")[:-2]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(0, items[0][1], "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs_of(spark, rows + AWKWARD), bench).collect()}
    want = brute_contamination([x for x in items if x[1]], rows, decontam.THRESHOLD)
    assert got <= want and len(got) >= 0.97 * len(want)
    for k in range(0, 60, 9):  # unedited passages
        assert (k, k % 20) in got
    kept = decontam.drop_contaminated(docs_of(spark, rows + AWKWARD), bench)
    assert kept.columns == docs_of(spark, []).columns
    assert kept.count() == len(rows) + len(AWKWARD) - len({d for d, _ in got})
    assert decontam.contamination(docs_of(spark, []), bench).count() == 0
    assert decontam.contamination(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_the_index_gives_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(9)
    ix = decontam.Index([(i, sentence(rng, 20, 50)) for i in range(40)])
    prints = np.concatenate([ix.prints ^ U(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 10, 20, 24)])
    p, i = ix.within(prints, 20)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ ix.prints[None, :]) <= decontam.RADIUS)
    assert set(zip(p.tolist(), i.tolist())) == set(map(tuple, want.tolist()))


# search
def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.4)
    v[5], v[6] = v[4], v[4] * 2
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (None, v[0].tolist(), 0), (903, [1.0, None], 0), (904, [float("nan")] * 12, 0)]
    got = topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), k=7).collect()
    full = np.vstack([v, [[1.0] + [0.0] * 11]])
    ids = [*range(300), 903]
    ok = np.flatnonzero(np.linalg.norm(full, axis=1) > 0)
    u = full[ok] / np.linalg.norm(full[ok], axis=1, keepdims=True)
    s = u @ u.T
    for a, i in enumerate(ok):
        mine = sorted((r.rank, r.score) for r in got if r.vec_id == ids[i])
        want = sorted((s[a, b] for b in range(len(ok)) if b != a), reverse=True)[:7]
        assert [r for r, _ in mine] == list(range(1, 8)) and np.allclose([x for _, x in mine], want, atol=2e-6)
    assert not {r.vec_id for r in got} & {900, 901, 902, 904, None}
    some = topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), k=7, every=20).collect()
    assert sorted(some) == sorted(r for r in got if r.vec_id % 20 == 0) and {r.vec_id for r in some} <= {*range(0, 300, 20)}
    pair = topk.neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, pair)) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert topk.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_blocks_of_a_search_can_be_small(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    block = lambda ids: (np.array(ids), np.arange(len(ids) + 1) * 4, np.tile(np.arange(4, dtype=np.int32), len(ids)), np.concatenate([np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ids]))
    whole = topk.merge_lists([topk.scatter_scores(block(list(range(50))), block(list(range(50))), 5)], 5)
    parts = [topk.scatter_scores(block(list(range(a, a + 10))), block(list(range(b, b + 25))), 5) for a in range(0, 50, 10) for b in (0, 25)]
    for x, y in zip(whole, topk.merge_lists(parts, 5)):
        assert np.allclose(x, y)


def test_text_search_against_sql_with_ties_and_repeats(spark):
    rng = np.random.default_rng(12)
    rows = [(i, sentence(rng, int(rng.integers(1, 30)), 40)) for i in range(80)] + [(200, "word1 word2"), (201, "word1 word2"), (202, ""), (203, None)]
    bench = [(i, sentence(rng, 6, 40)) for i in range(9)] + [(50, None), (51, ""), (52, "nowhere")]
    got = topk.top_k(docs_of(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    con = duckdb.connect()
    for name, data, key in (("documents", rows, "doc_id"), ("benchmark", bench, "item_id")):
        con.register(name, pa.Table.from_pylist([{key: i, "text": t} for i, t in data]))
    want = con.execute(f"SELECT item_id, doc_id, score, rank FROM ({topk.SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    odd = topk.top_k(docs_of(spark, AWKWARD), spark.createDataFrame([(1, "one id"), (1, "one id")], "item_id long, text string")).collect()
    assert len(odd) == 2 * 3 and all(r.score > 0 for r in odd)
    assert topk.top_k(docs_of(spark, []), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


# passages
def planted(rng):
    passage = [sentence(rng, n, 10**6) for n in (55, 80, 120)]
    rows = []
    for k in range(40):
        body = [sentence(rng, int(rng.integers(20, 150)), 10**6)]
        if k % 2 == 0:
            body.append(edited(rng, passage[k // 2 % 3], 0.03 if k % 8 == 6 else 0))
            body.append(sentence(rng, 30, 10**6))
        rows.append((k, " ".join(body)))
    return passage, rows


def test_planted_passages_are_found_and_cut(spark):
    rng = np.random.default_rng(13)
    passage, rows = planted(rng)
    awkward = [(100 + i if d is not None else None, t) for i, (d, t) in enumerate(AWKWARD)]
    df = docs_of(spark, rows + awkward)
    got = substring.passages(df).collect()
    later = {k for k in range(6, 40, 2)}
    assert {r.doc_id for r in got if r.doc_id < 100} == later
    words = {d: t.split(" ") for d, t in rows}
    for r in got:
        if r.doc_id < 100:
            a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
            assert r.source_id < r.doc_id and r.identity >= 0.8 and len(a) >= 45
            if r.doc_id % 8 != 6 and r.source_id % 8 != 6:
                assert len(a) >= 55 and a == b and " ".join(a) in passage
    kept = {r.doc_id: r for r in substring.cut_passages(df).collect() if r.doc_id is not None and r.doc_id < 100}
    assert set(kept) == set(range(40)) and substring.cut_passages(df).columns == df.columns
    for k in range(40):
        if k in later:
            assert len(kept[k].text.split()) <= len(words[k]) - 45
            assert kept[k].n_chars == len(kept[k].text)
        else:
            assert kept[k].text == dict(rows)[k]
    assert substring.cut_passages(df).count() == len(rows) + len(awkward)


def test_many_documents_share_a_passage(spark):
    rng = np.random.default_rng(14)
    p = sentence(rng, 60, 10**6)
    rows = [(k, f"{sentence(rng, 25, 10**6)} {p} {sentence(rng, 25, 10**6)}") for k in range(300)]
    got = substring.passages(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 300))
    assert all((r.start, r.end) == (25, 85) for r in got)


def test_rows_with_one_id_and_empty_tables(spark):
    rng = np.random.default_rng(15)
    t = sentence(rng, 80, 10**6)
    assert substring.passages(docs_of(spark, [(1, t), (1, t), (None, t), (2, None), (3, "")])).count() == 0
    assert substring.passages(docs_of(spark, [])).count() == 0
    assert substring.cut_passages(docs_of(spark, [(1, t), (2, t)])).select("doc_id").collect() == [(1,)]  # nothing is left of 2


def test_every_place_of_a_passage_is_found(spark):
    rng = np.random.default_rng(21)
    p = sentence(rng, 60, 10**6).split(" ")
    gap = lambda: sentence(rng, 50, 10**6).split(" ")
    three = gap() + p + gap() + p + gap() + p
    teaser = p[:30] + gap() + p
    both = p[:30] + gap() + p + gap()
    rows = [(1, gap() + p), (2, three), (3, teaser), (4, gap() + p), (5, both)]
    got = substring.passages(docs_of(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    covered = {i: {w for r in got if r.doc_id == i for w in range(r.start, r.end)} for i, _ in rows}
    assert covered[2] == {*range(50, 110), *range(160, 220), *range(270, 330)}
    assert covered[3] >= set(range(80, 140)) and covered[5] >= set(range(80, 140)) and not covered[1]
    assert covered[4] == set(range(50, 110))


def test_passages_a_little_apart_are_each_found(spark):
    rng = np.random.default_rng(22)
    rows, want = [], {}
    for k in range(12):
        n, gap = (55, 22) if k % 2 else (60, 20)
        three = [sentence(rng, n, 10**6) for _ in range(3)]
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(f"{sentence(rng, gap, 10**6)} {p}" for p in three)))
        want[2 * k + 1] = {w for j in range(3) for w in range(j * (n + gap) + gap, (j + 1) * (n + gap))}
    # a long weak chain of one source doesn't hide a passage of another
    p = sentence(rng, 45, 10**6).split(" ")
    weak = lambda: [x for c in range(9) for x in p[c * 5 : c * 5 + 5] + sentence(rng, 4, 10**6).split(" ")]
    rows += [(100, " ".join(weak())), (101, " ".join(weak() + sentence(rng, 9, 10**6).split(" ") + p))]
    covered = {i: set() for i, _ in rows}
    for r in substring.passages(docs_of(spark, rows)).collect():
        assert r.identity >= 0.8 and r.end - r.start >= 40
        covered[r.doc_id] |= set(range(r.start, r.end))
    assert all(covered[i] >= w for i, w in want.items())


@pytest.mark.parametrize("every", [5, 6, 7, 8])
def test_passages_down_to_the_identity_are_found(spark, every):
    rng = np.random.default_rng(23)
    rows = []
    for k in range(60):
        p = sentence(rng, 54, 10**6).split(" ")
        q = [f"edit{rng.integers(10**6)}" if i % every == every - 1 else x for i, x in enumerate(p)]
        rows += [(2 * k, f"{sentence(rng, 50, 10**6)} {' '.join(p)} {sentence(rng, 50, 10**6)}"), (2 * k + 1, f"{sentence(rng, 30, 10**6)} {' '.join(q)} {sentence(rng, 30, 10**6)}")]
    got = {(r.doc_id, r.source_id) for r in substring.passages(docs_of(spark, rows)).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(60)}


def test_a_passage_is_found_whose_parts_are_elsewhere_in_first_and_previous(spark):
    rng = np.random.default_rng(25)
    p = sentence(rng, 70, 10**6).split(" ")
    a, b = p[:35], p[35:]
    around = lambda t: " ".join([sentence(rng, 50, 10**6), *t, sentence(rng, 50, 10**6)])
    rows = [(1, around(a)), (2, around(b)), (3, around(p)), (4, around(a)), (5, around(b)), (6, around(p))]
    got = substring.passages(docs_of(spark, rows)).collect()
    assert [(r.doc_id, r.start, r.end, r.source_id, r.source_start, r.identity) for r in got] == [(6, 50, 120, 3, 50, 1.0)]
    # many documents with either half before and behind, and edits in the one that has it whole
    q = [f"edit{i}" if i % 8 == 7 else w for i, w in enumerate(p)]
    rows = [(k, around((a, b)[k % 2])) for k in range(60)] + [(60, around(q))] + [(k, around((a, b)[k % 2])) for k in range(61, 120)] + [(120, around(p))]
    got = [r for r in substring.passages(docs_of(spark, rows)).collect() if r.end - r.start >= 60]
    assert [(r.doc_id, r.source_id) for r in got] == [(120, 60)] and (got[0].start, got[0].end) == (50, 120)


def test_matches_are_those_of_brute_force(monkeypatch):
    rng = np.random.default_rng(26)
    monkeypatch.setattr(substring, "BLOCK", 50)
    texts = [" ".join("abc"[i] for i in rng.integers(0, 3, n)) for n in (40, 60, 30, 50)] + ["a " * 70, "b a " * 30, "a " * 45]
    w = Words(pa.array(texts))
    key, doc, pos = substring.seeds(w)
    d, s, x, y = (np.concatenate(c) for c in zip(*((d, s, ~x if last else x, y) for word, last in zip(substring.beside(w, doc, pos), (False, True)) for d, s, x, y in substring.links(key, doc.astype(np.int64), pos, word))))
    monkeypatch.setattr(substring, "WINDOW", -substring.SEED)  # no two matches are joined
    got = set(zip(*(c.tolist() for c in substring.fragments(d, s, x, y)[:5])))
    words, want = [t.split() for t in texts], set()
    for i, t in enumerate(words):
        for j, u in enumerate(words[:i]):
            for p in range(len(t)):
                for q in range(len(u)):
                    if t[p] == u[q] and not (p and q and t[p - 1] == u[q - 1]):
                        n = next((k for k, (v, z) in enumerate(zip(t[p:], u[q:])) if v != z), min(len(t) - p, len(u) - q))
                        if n >= substring.SEED:
                            want.add((i, j, p, q, n))
    assert got == want


def test_a_match_of_one_seed_is_sent_once():
    rng = np.random.default_rng(28)
    texts = [" ".join("abcd"[i] for i in rng.integers(0, 4, n)) for n in (60, 80, 50)] + ["a " * 50, "x y z", "x y z"]
    w = Words(pa.array(texts))
    key, doc, pos = substring.seeds(w)
    doc, (before, after) = doc.astype(np.int64), substring.beside(w, doc, pos)
    want = {(d, s, ~x if last else x, y) for word, last in ((before, False), (after, True)) for c in substring.links(key, doc, pos, word) for d, s, x, y in zip(*(v.tolist() for v in c))}
    sent = substring.scatter(np.zeros(len(key), np.int64), 1, key=(key >> np.uint64(32)).astype(np.uint32), doc=doc, pos=pos, before=before, after=after)
    for _, got in substring.gather(substring._links(iter([sent]), 1), np.int64, np.int64, np.int32, np.int32):
        ends = list(zip(*(c.tolist() for c in substring.both_ends(*got))))
        matches = sum(x >= 0 for _, _, x, _ in want)
        assert set(ends) == want and len(ends) == len(want) and matches <= len(got[0]) < len(want) == 2 * matches


def test_pairs_whose_seeds_lie_on_far_diagonals_are_not_chained(monkeypatch):
    rng = np.random.default_rng(29)
    line = [sentence(rng, 12, 10**6) for _ in range(2)]
    gap = lambda n: sentence(rng, n, 10**6)
    apart = [f"{line[0]} {gap(90)} {line[1]}", f"{line[1]} {gap(5)} {line[0]} {gap(50)}"]  # ten seeds on either of two diagonals
    near = [f"{gap(50)} {line[0]} {gap(5)} {line[1]} {gap(20)}", f"{line[0]} {gap(7)} {line[1]} {gap(90)}"]
    called, plain = [], substring.chain
    monkeypatch.setattr(substring, "chain", lambda f: called.append(f) or plain(f))
    for texts, n in ((apart, 0), (near, 1)):
        w = Words(pa.array(texts))
        key, doc, pos = substring.seeds(w)
        d, s, x, y = (np.concatenate(c) for c in zip(*((d, s, ~x if last else x, y) for word, last in zip(substring.beside(w, doc, pos), (False, True)) for d, s, x, y in substring.links(key, doc.astype(np.int64), pos, word))))
        called.clear()
        assert len(list(substring.chains(d, s, x, y))) == n and len(called) == n
    # a passage whose diagonals lie as far apart as the identity allows isn't left out
    p = gap(80).split(" ")
    q = [v for i, u in enumerate(p) for v in ([u, f"more{i}"] if i % 5 == 2 else [u])]
    w = Words(pa.array([" ".join(p), " ".join(q)]))
    key, doc, pos = substring.seeds(w)
    d, s, x, y = (np.concatenate(c) for c in zip(*((d, s, ~x if last else x, y) for word, last in zip(substring.beside(w, doc, pos), (False, True)) for d, s, x, y in substring.links(key, doc.astype(np.int64), pos, word))))
    assert list(substring.chains(d, s, x, y))


def test_an_exact_match_is_found_whatever_stands_behind(spark):
    rng = np.random.default_rng(27)
    p, more = (sentence(rng, n, 10**6).split(" ") for n in (45, 39))
    half = [f"edit{i}" if i % 2 == 0 and i < 38 else w for i, w in enumerate(more)]  # goes on with 20 words of 39
    rows = [(1, " ".join(p + more)), (2, " ".join(p + half))]
    assert [(r.doc_id, r.source_id) for r in substring.passages(docs_of(spark, rows)).collect() if r.start == 0 and r.end >= 45] == [(2, 1)]


def brute_chain(frags):
    order = sorted(range(len(frags)), key=lambda i: frags[i])
    score = {}
    for i in order:
        x, y, n = frags[i]
        score[i] = n + max([0.0] + [score[j] - substring.GAP_COST / 2 * ((x - frags[j][0] - frags[j][2]) + (y - frags[j][1] - frags[j][2])) for j in score if frags[j][0] + frags[j][2] <= x and frags[j][1] + frags[j][2] <= y])
    return max(score.values())


def test_the_best_chain_is_that_of_brute_force():
    rng = np.random.default_rng(16)
    for _ in range(40):
        frags = sorted({(int(rng.integers(60)), int(rng.integers(60)), int(rng.integers(5, 12))) for _ in range(8)})
        best = substring.chain(frags)[0][1]
        score = frags[best[0]][2]
        for a, b in zip(best, best[1:]):
            (x, y, n), (u, v, m) = frags[a], frags[b]
            assert x + n <= u and y + n <= v
            score += m - substring.GAP_COST / 2 * ((u - x - n) + (v - y - n))
        assert abs(max(score, brute_chain(frags)) - brute_chain(frags)) < 1e-9
        used = [i for _, path in substring.chain(frags) for i in path]
        assert sorted(used) == list(range(len(frags)))


def test_runs_of_twelve_words_share_a_seed():
    rng = np.random.default_rng(17)
    for _ in range(50):
        run = sentence(rng, substring.SEED + substring.WINDOW - 1, 10**6)
        a, b = (f"{sentence(rng, 30, 10**6)} {run} {sentence(rng, 30, 10**6)}" for _ in range(2))
        key, doc, _ = substring.seeds(Words(pa.array([a, b])))
        assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_cut_spans_by_words():
    assert substring.cut_spans("Ä b. C d, e f", [(1, 3)]) == "Ä d, e f"
    assert substring.cut_spans("a b c", [(0, 3)]) == ""
    assert substring.cut_spans("a b c", []) == "a b c"
