"""The training-data operators: SQL twins, brute force, round trips, held-out labels, odd inputs."""

import hashlib
import json
import random
import time
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import bpe, chat, html, licences, mtree, near, packing, quality, queries, ring, toxic
from pyspark.sql import functions as F

PATH = public_tokenizers.path(queries.TOKENIZER)
ODD = [
    (1, None, None), (2, "", "a"), (3, "one two three", "a"), (3, "one two three", "a"), (None, "One  two\tthree", "b"),
    (5, " ".join(f"w{i}" for i in range(3000)), "b"), (6, "x" * 3000, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "clash", "clash") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, quality string, n_words string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, sf_dir)
    result = db.execute(queries.ORACLES[name])
    order = [d[0] for d in result.description]
    theirs = sorted((tuple(r[order.index(c)] for c in ours.columns) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, ours.collect()), key=repr) == theirs


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeθΣσİß'strem 01.,\n\té😀́漢\x1c<|>", max_size=80))
def test_bpe_like_the_library(text):
    machine, library = bpe.transducer(PATH), Tokenizer.from_file(PATH)
    ids = machine.encode(text)
    wanted = library.encode(text, add_special_tokens=False).ids
    assert list(array("I", ids)) == wanted
    assert machine.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_bpe_streams_long_words():
    machine, library = bpe.transducer(PATH), Tokenizer.from_file(PATH)
    word = "".join(random.Random(3).choices("thein", k=6000))
    assert list(machine.word(word)) == library.encode(word, add_special_tokens=False).ids
    text = bpe.TextMachine(machine)
    ids = array("I", machine.encode("naïve 漢字 ok"))
    assert "".join(text.feed([i]) for i in ids) + text.end() == "naïve 漢字 ok "


def test_bpe_lookahead_suffices(tmp_path):
    """Small random merge lists: ids as by brute force, emitted early, and final after the lookahead."""
    rng = random.Random(11)
    for case in range(60):
        merges, tokens = [], [*"abc"[: rng.randint(2, 3)]]
        letters = "".join(tokens)
        while len(merges) < rng.randint(2, 24):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in merges and len("".join(pair)) <= 8 and "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        vocabulary = {t: i for i, t in enumerate([*tokens, *(c + "</w>" for c in letters)])}
        spec = {
            "model": {"vocab": vocabulary, "merges": [" ".join(m) for m in merges], "end_of_word_suffix": "</w>"}, "added_tokens": [],
            "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\S+"}}]},
        }
        path = tmp_path / f"{case}.json"
        path.write_text(json.dumps(spec))
        machine = bpe.Transducer(str(path))
        word = "".join(rng.choices(letters, k=400)) if case % 2 else "".join(rng.choices(tokens, k=150))
        parts = [*word[:-1], word[-1] + "</w>"]
        for merge in merges:
            at = 0
            while at < len(parts) - 1:
                if (parts[at], parts[at + 1]) == merge:
                    parts[at : at + 2] = ["".join(merge)]
                at += 1
        read, said, got = 0, 0, []

        def symbols():
            nonlocal read
            for c in word:
                read += 1
                yield c

        for i in machine.word(symbols()):
            got.append(i)
            assert read - said <= 4 * machine.lookahead, (case, read, said, machine.lookahead)
            said += len(machine.pieces[i].removesuffix("</w>"))
        assert got == [vocabulary[p] for p in parts]
        # Where tokens begin and end up to ``n``, less the lookahead, is so whatever follows.
        last, sizes = [bpe.START], [0]
        machine._extend(word, len(word) - 1, last, sizes)
        ends = [set()]
        for n in range(1, len(last)):
            ends.append(ends[n - sizes[n]] | {n})
        for n in range(machine.lookahead, len(last)):
            final = {p for p in ends[n] if p <= n - machine.lookahead}
            assert all(final == {p for p in ends[k] if p <= n - machine.lookahead} for k in range(n, min(len(last), n + 60)))


def test_bpe_decodes_in_steps(monkeypatch):
    machine = bpe.transducer(PATH)
    ids = machine.encode("naïve words and 漢字 again " * 9)
    whole = " ".join(machine.pieces[i] for i in array("I", ids))
    monkeypatch.setattr(bpe, "DECODED", 7)
    steps = [*machine.decode_steps(ids)]
    assert "".join(steps) == machine.decode(ids) == whole and len(steps) > len(ids) // 28


def test_quality_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert quality.measure(" ".join(words))[4] == len(covered)


def test_quality_odd_rows(odd):
    kept = quality.keep_good(odd, F.col("source"))
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [5]
    assert quality.keep_good(odd.limit(0), F.col("source")).count() == 0


def test_host_habit_rejects(spark):
    bad = [(i, "word " * 3 + " ".join(f"v{i}{k} #" for k in range(30)), "junk") for i in range(40)]
    good = [(100, " ".join(f"v{k}" for k in range(30)), "junk")] + [(200 + i, " ".join(f"v{k}" for k in range(30)), "fine") for i in range(40)]
    kept = quality.keep_good(spark.createDataFrame(bad + good, "doc_id long, text string, source string"), F.col("source"))
    assert {r.doc_id for r in kept.collect()} == {g[0] for g in good}


def test_packing(odd):
    rows = packing.pack_documents(odd, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(bins) >= packing.lower_bound([r.length for r in rows], packing.CAPACITY)
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold(lengths):
    bins = packing.best_fit(lengths, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 20 for b in bins)
    assert packing.lower_bound(lengths, 20) <= len(bins)


def test_packing_exchanges(spark):
    pieces = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (F.pmod(F.xxhash64("id"), F.lit(1500)) + 100).alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    rows = packing.packed(pieces, partition_pieces=40).collect()
    apart = packing.packed(pieces, partition_pieces=40, rounds=0).select("sequence_id").distinct().count()
    assert len(rows) == 400
    assert len({r.sequence_id for r in rows}) < apart  # partitions that exchange need fewer sequences


def test_near_odd_rows(odd):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, None), (6, 1, 6)} <= found
    assert near.near_duplicates(odd.limit(0)).count() == 0


def test_near_hot_passage(spark, monkeypatch):
    """A passage in all texts, with the lists of hot values forced: links as by brute force."""
    monkeypatch.setattr(near, "HOT", 5)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(rng.choice((5, 80, 150)))]
        texts.append(own + shared)
        if i % 3 == 0:
            copy = [*own]
            copy[len(copy) // 2] = "changed"
            texts.append(copy + shared)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == dict(enumerate(root))


def test_ring(spark, sf_dir):
    rows = queries.op5_ring_shards(spark, sf_dir).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)


def test_ring_odd_rows(odd):
    rows = ring.sharded(odd, F.col("text"), "doc_id", 3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert ring.sharded(odd.limit(0), F.col("text"), "doc_id", 3).count() == 0


def test_mtree_is_exact():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-60, 60, (1500, 8))
    tree = mtree.MTree(np.arange(1500), vectors / mtree.SCALE)
    for q in range(40):
        scores = vectors @ vectors[q]
        wanted = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != q))[:5]
        assert tree.search(vectors[q] / mtree.SCALE, 5, q) == [(-s, i) for s, i in wanted]
    assert tree.scored < 40 * 1500  # bounds spare some


def test_mtree_spares_rows_of_groups():
    rng = np.random.default_rng(5)
    vectors = (rng.integers(-3000, 3000, (30, 16))[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(float)
    tree = mtree.MTree(np.arange(3000), vectors)
    for q in range(0, 3000, 100):
        wanted = sorted((-int(s), i) for i, s in enumerate((vectors @ vectors[q]) * mtree.SCALE**2) if i != q)[:5]
        assert tree.search(vectors[q], 5, q) == [(-s, i) for s, i in wanted]
    assert tree.scored < 30 * 3000 / 5


@pytest.mark.parametrize("size", [1.0, 2.0**20, 2.0**39, 2.0**62, 2.0**300, 2.0**1000])
def test_mtree_with_large_components(spark, size):
    rng = np.random.default_rng(6)
    given = [(i, [float(x) for x in rng.normal(size=6) * (size if i % 7 == 0 else 1.0)]) for i in range(120)]
    given += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (None, [1.0] * 6)]
    given += [given[0], (14, given[14][1]), (14, [3.0] * 6), (300, given[5][1]), (301, [1.0])]  # repeated rows, ties, other lengths
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    v = table.select("vec_id", mtree.integers(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    got = {}
    for r in mtree.best_of(v, v.where("vec_id % 7 = 0"), 5, page_rows=40, block_rows=9).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    rows = [(i, mtree.whole(np.floor(np.array(e) * 256) / 256 if size < 2.0**40 else np.array([x if abs(x) >= 2.0**45 else np.floor(x * 256) / 256 for x in e])).tolist())
            for i, e in given if i is not None and e and None not in e and all(map(np.isfinite, e))]
    for query in range(0, 120, 7):
        wanted = []
        for vector in {tuple(e) for i, e in rows if i == query}:
            scores = sorted((-sum(a * b for a, b in zip(vector, e)), i) for i, e in rows if i != query and len(e) == len(vector))[:5]
            wanted += [(min(mtree.MOST, max(mtree.LEAST, -s)), i) for s, i in scores]
        assert sorted(got[query]) == sorted(wanted)
    assert mtree.best_of(v.limit(0), v.limit(0), 5).count() == 0


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, 0), (1, 0, None, "x", 0), (2, None, "assistant", "\\ ### </turn>", 0), (None, 1, "a: b", "", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, html int")
    got = {r.conv_id: r for r in chat.formatted_digests(table).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nx\nuser\n\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"\\ ### </turn>").hexdigest() and got[None].n_turns == 1
    assert chat.formatted_digests(table.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "Role a: b", ""]), st.text(alphabet="\\# <>/turn\nA:", max_size=30))))
def test_chat_reads_back(turns):
    got = []
    reader = chat.Reader(lambda *turn: got.append(turn))
    chat.compiled(chat.TEMPLATE)({"messages": iter([{"role": r, "text": t} for r, t in turns])}, reader.feed, False)
    reader.turns()
    assert got == [(r, t, t if r == "assistant" else "") for r, t in turns]


def test_template_sandbox():
    assert chat.render("{% if 1 == 2 %}no{% endif %}{{ 'a' + 'b' | upper }}{{ x.__class__y }}" .replace(".__class__y", ".y"), [], x={"y": 3})[0] == "aB3"
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{% for a in b %}", "{{ x | eval }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_licences():
    weights, offsets = licences.model()
    assert len(offsets) == len(licences.FAMILIES) + 1 and all(len(w) == len(offsets) for w in weights.values())


def test_licence_odd_rows(spark, odd):
    assert {len(r.licences) for r in licences.scanned(odd).collect()} == {0}
    rows = [(1, "Prose.\nLicensed under the Apache License, Version 2.0."), (2, "She lost her driving license at the museum.")]
    found = {r.id: [(x.family, x.confirmed) for x in r.licences] for r in licences.scanned(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert found == {1: [("apache-2.0", True)], 2: []}


def test_toxicity_held_out():
    rng = random.Random(1)
    syllables = ["ta", "re", "mi", "lo", "ne", "shi", "gar", "pel", "du", "vo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    def doc(label):
        words = [word() for _ in range(60)]
        if label:
            words[rng.randrange(60)] = rng.choice(("blockhead", "scoundrel", "rotter", "b.l.o.c.k.h.e.a.d"))
        return label, " ".join(words)
    data = [doc(i % 4 == 0) for i in range(600)]
    model = toxic.fit([(label, text.split()) for label, text in data[:400]])
    scores = [*toxic.Scorer(model).scores([text for _, text in data[400:]] + ["", None])]
    right = sum((s >= toxic.THRESHOLD) == label for s, (label, _) in zip(scores, data[400:]))
    assert right >= 190 and max(scores[-2:]) < toxic.THRESHOLD
    assert toxic.fit([(0, ["a"])]) is None


def test_html():
    page = (
        '<body><header><h1>Site</h1></header><div class="post-12"><h2>T</h2><div class="text"><p>aaa bb &amp; c<b>d</b>\n e</p><p>second, longer'
        '</p><ul><li>x<li>y</ul></div><div class="comments"><p>no no no no</p></div></div><div class=sidebar>zz</div><script>"<p>x"</script>'
    )
    assert html.extract(page, None) == "T\naaa bb & cd e\nsecond, longer\nx\ny"
    assert html.extract(None, None) == html.extract("", []) == "" and html.extract("plain <b", None) == "plain"


def test_html_article_in_several_containers(spark):
    lead, body = ("<p>" + f"{w} " * 100 + "</p>" for w in ("leading", "another"))
    body *= 4
    links = '<div class="more">' + '<p><a href="/x">further pages to read here</a></p>' * 9 + "</div>"
    both = f'<div class="lead">{lead}</div><div class="body">{body}</div>'
    sections = "".join(f'<div class="s-{k}">{"<p>" + k * 50 + "</p>"}</div>' for k in "abc") + f'<div class="long">{body}</div>'
    for page, path in (
        (f'<body><div class="page">{both}</div>{links}</body>', "/body/div.page"),
        (f'<body><article><div class="post">{both}</div></article>{links}</body>', None),
        (f"<body><article><div>{sections}</div></article>{links}</body>", None),
        (f"<body><main>{both}</main>{links}</body>", None),
        (f'<body><main><div class="lead">{lead}</div><article>{body}</article></main>{links}</body>', None),
        (f'<body><div class="page">{both}{links}</div></body>', None),
        (f"<body>{both}{links}</body>", None),
        (f"{both}{links}", None),
    ):
        wanted = ["leading"] if "lead" in page else ["a" * 50, "b" * 50, "c" * 50]
        for winners in (None, [html.vote(page)], ["/body/div.page/div.body", "/body/article/div.post/div.body"]):
            text = html.extract(page, winners)
            assert all(w in text for w in wanted) and text.count("another") == 400 and "further" not in text, (page[:60], winners)
        assert path is None or html.vote(page) == path
    # A host whose winning path is a child of one page's container.
    rows = [(i, "https://h.example/", f'<body><div class="page"><div class="body">{body}</div><ul>{links}</ul></div></body>') for i in range(9)]
    rows.append((9, "https://h.example/", f'<body><div class="page">{both}</div></body>'))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.main_text for r in html.main_texts(pages, html.host_of(F.col("url"))).collect()}
    assert texts[9].count("leading") == 100 and all(t.count("another") == 400 and "further" not in t for t in texts.values())


@pytest.mark.parametrize("name", [
    "overflow-hidden", "content has-sidebar", "no-sidebar", "site header-fixed", "menu-open", "search-results", "social-layout", "hidden",
    "search", "page-search", "sidebar-wrapper", "md:hidden", "newsletter",
])
def test_html_wrapper_names(name):
    text = "<p>" + "word " * 60 + "</p>"
    around = '<div class="comments"><p>remarks by readers</p></div><div class="site-header"><p>banner text</p></div><div id="main-nav">menu</div>'
    for inner in (f"<article>{text}</article>", f"<main>{text}</main>", f'<div class="post">{text}</div>'):
        # Boilerplate inside and outside is still left out.
        for page in (f'<body><div class="{name}">{inner}{around}</div></body>', f'<body>{around}<div class="{name}">{inner}</div></body>'):
            got = html.extract(page, None)
            assert got == ("word " * 60).strip() and html.vote(page), (name, page, got)
    hollow = f'<body><div class="{name}"><div class="overlay"><div class="x">{text}</div></div></div></body>'
    assert html.extract(hollow, None) == ("word " * 60).strip()


def test_html_boilerplate_names():
    text = "<article><p>" + "word " * 20 + "</p></article>"
    for name in ("comments", "comment-list", "commentList", "cookie-consent", "related-posts", "ad-slot-1", "newsletter_signup", "banner-300x250"):
        page = f'<body>{text}<div class="{name}"><p>{"remark " * 90}</p></div></body>'
        assert html.extract(page, None) == ("word " * 20).strip(), name
    assert not html.marks("article", {"class": "post has-comments widget"}) and html.marks("article", {"class": "comment-item"})


def test_pages(spark, sf_dir):
    rows = queries.op10_host_path_text(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.text and "©" not in r.text and "track(" not in r.text for r in rows)


def test_pipeline(spark, sf_dir):
    """Stage by stage against the operators' own decisions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in pieces} <= kept
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in {p.doc_id for p in pieces}}
    library = Tokenizer.from_file(PATH)
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert sum(p.length for p in pieces if p.doc_id == doc) == len(ids)
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [t.lower().split()]}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)


ARTICLE = "A sentence of the article itself. " * 12


@pytest.mark.parametrize("tag", ["form", "header", "aside", "fieldset", "nav"])
def test_tags_around_the_page_drop_no_article(tag):
    inner = f"<nav>Menu</nav><div class=c><h1>Title</h1><p>{ARTICLE}</p></div><footer>Foot</footer>"
    got = html.extract(f"<html><body><{tag} id=f1>{inner}</{tag}></body></html>", None)
    assert got == f"Title\n{ARTICLE.strip()}"
    nested = html.extract(f"<body><form><header>{inner}</header></form></body>", None)
    assert nested == got
    beside = f"<body><div class=c><h1>Title</h1><p>{ARTICLE}</p></div><{tag}><p>Name, mail and message</p></{tag}></body>"
    assert html.extract(beside, None) == got


@pytest.mark.parametrize("tag", ['<a title="5" screen">', "<a title=it's>", "<a x=1'>", "<a href=''b'>", '<a =">', "<a b = 'x > y'>", "<a b=>", "<a/b//>"])
def test_quotes_as_in_html(tag):
    assert html.extract(f"<div><p>see {tag}link</a> here</p><p>tail</p></div>", None) == "see link here\ntail"


def test_formulas_stand_in_their_block():
    formula = "<math><mi>E</mi><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup><annotation>E=c^2</annotation></math>"
    assert html.extract(f"<div><p>Energy is {formula} here.</p></div>", None) == "Energy is E=c2 here."


@pytest.mark.parametrize("step", ["<div>", "<div>x", "<div class=a/b><p>y", "<section></b>", "<div></span>"])
def test_deep_pages_take_time_in_proportion(step):
    def seconds(n):
        start = time.perf_counter()
        html.extract(step * n + ARTICLE, None)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 2.0


def test_pages_in_a_table(spark):
    rows = [(1, None, f"<div><p>{ARTICLE}</p></div>", "c"), (1, None, f"<div><p>{ARTICLE}</p></div>", "c"), (None, "::", None, "c"), (2, "http://a.b/", "<div>" * 3000 + ARTICLE, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths string")
    got = html.main_texts(pages, html.host_of(F.col("url"))).collect()
    assert sorted(len(r.main_text) for r in got) == [0] + 3 * [len(ARTICLE.strip())] and {r.paths for r in got} == {"c", None}
    assert html.main_texts(pages.limit(0), html.host_of(F.col("url"))).count() == 0
