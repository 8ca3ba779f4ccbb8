"""Vectors, tokens, wavelet files, pieces, pages and toxicity against plain versions and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from ddlscope.llm import html_extract, html_labels, nearest, sentencepieces, token_files, toxicity
from ddlscope.llm.textbytes import WordHasher
from ddlscope.llm.wavelet import WaveletMatrix, encode

DOCS = "doc_id long, text string, part int, score double, n string"
ODD = ["", None, " ", "don't stop", "dogs' \"tail\"' x", "“hi,” he—said", "a<|endoftext|>b", "x\x00y \x1f z", "é́ a", "3.14 ½ ² ٣",
       "ΑΣ ς Σ.", "İstanbul, ok", "a\x0bb\x0cc d e", "'s 't '", "😀,😀 x", "№,№", "O'Neil's, 'tis.", "A" * 3000, "中文,字 中",
       "▁ mark▁ed", "  two  blanks\n\nand lines\t", "<s> </s> <unk> <0x41>", "The internationalization of tokenization"]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 0.5, "x") for d, t in rows], DOCS)


def plain_nearest(rows, k):
    """Every row but the query's own; an id once, with its best score; repeated rows count once."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for n, (q, query) in enumerate(rows):
        if q % 20 == 0:
            best = {}
            for m, (c, v) in enumerate(rows):
                if m != n and len(v) == len(query):
                    s = 0.0
                    for x, y in zip(query, v):
                        s += x * y
                    best[c] = max(s, best.get(c, -math.inf))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted((-s, c) for c, s in best.items())[:k])]
    return sorted(out)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(90)]  # one very common vector
    rows += [(400, [0.0] * 16), (420, None), (440, [float("nan")] + [1.0] * 15), (460, [None] + [1.0] * 15), (480, []),
             (500, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (20, rows[20][1]), (520, [3.0, 4.0]), (521, [1.0, 1.0]), (540, [-1e30] * 16)]
    rows += [(600, [float(i % 7)] * 16) for i in range(60)] + [(601 + i % 5, rng.normal(size=16).tolist()) for i in range(80)]  # ids of many rows
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, length int, score double")
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in usable]
    got = sorted(map(tuple, nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=64).collect()))
    assert got == plain_nearest(usable, 20)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_all_rows_of_an_id_are_candidates(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [9.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, nearest.nearest(df, F.col("vec_id") % 20 == 0).collect())) == [(20, 1, 1, 9.0), (20, 2, 2, 1.0)]
    large = spark.createDataFrame([(20 * i, [1e160 * (i + 1), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert nearest.nearest(large, F.col("vec_id") % 20 == 0, 5).count() == 150


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 24)), rng.normal(size=(200, 24)) * rng.exponential(size=(200, 1))
    qa, sa, ra = nearest.quantised(a)
    qb, sb, rb = nearest.quantised(b)
    rough = (qa.astype(np.int64) @ qb.astype(np.int64).T) * sa[:, None] * sb
    bound = np.linalg.norm(a, axis=1)[:, None] * rb + ra[:, None] * np.linalg.norm(qb * sb[:, None], axis=1)
    assert (np.abs(rough - a @ b.T) <= bound * (1 + 1e-9)).all()


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (9, 5), (5000, 60), (9000, 49408)])
def test_wavelet_matrix(n, symbols):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, symbols, n)
    file = WaveletMatrix(encode(ids, np.array([5, 6]), np.array([0, n // 2, n])))
    assert (file.decode() == ids).all() and file.doc_ids.tolist() == [5, 6] and file.starts.tolist() == [0, n // 2, n]
    for i in rng.integers(0, n, 25) if n else []:
        token, places = int(ids[i]), np.flatnonzero(ids == ids[i])
        assert file.access(int(i)) == token
        assert file.count(token, int(i)) == (ids[:i] == token).sum() and file.count(token) == len(places)
        assert [file.select(token, k) for k in range(min(3, len(places)))] == places[:3].tolist()
    assert file.count(1 << 20) == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rng.choices("ab'.,<|> \n\t1é—́😀Σ№'", k=rng.randint(1, 40)))) for i in range(400)]
    rows += [(7, ODD[7]), (None, "null id"), (900, "word " * 30000)]
    files = token_files.write_token_files(frame(spark, rows), path, file_ids=500)
    got = [tuple(r) for r in token_files.read_documents(files).collect()]
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_documents(token_files.write_token_files(frame(spark, []), path)).count() == 0


def test_units_of_every_letter_before_and_after_marks():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    # among them the letters that the tokenizer turns into a letter and a combining mark
    letters = [c for c in map(chr, range(128, 0x110000)) if c.isalpha()]
    texts = ["GAZETESİ.", "क़,", ".བྷ-"] + [t for c in letters for t in (f"a{c}.", f".{c}-", f"({c}b")]
    want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    got = token_files.UnitEncoder(path).encode(texts)
    assert [t for t, g, w in zip(texts, got, want) if g.tolist() != w.ids] == []


def test_words_that_cancel_out_modulo_a_power_of_two_have_their_own_ids(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [*brute.twin_words(), " ".join(brute.twin_words())]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in token_files.UnitEncoder(path).encode(texts)] == [w.ids for w in want]
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.encoded(frame(spark, list(enumerate(texts))), path).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: library.encode(t) for i, t in enumerate(texts)}


def test_sentence_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rng.choices("ab  \tthe.éin中😀<0x>ing\n", k=rng.randint(0, 40)))) for i in range(500)]
    rows += [(3, ODD[3]), (None, "no id"), (900, "so  long " * 20000)]
    ids = sentencepieces.encoded(frame(spark, rows), path)
    texts = dict(rows)
    for r in ids.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "")
    for r in sentencepieces.decoded(ids, path).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    assert sentencepieces.encoded(frame(spark, []), path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><aside><p>Side words here.</p></aside><!-- <p>no</p> --><article><header><h1>The&nbsp;title</h1></header>
<script>var t="</p>";</script><p><b>First &amp;amp; line<br>goes   on <a href="u">link</a>.<p>One<div class='advert'>Buy</div><ul><li>item</li></ul>
<form><label>Name</label></form><section id="comments"><p>Nice!</p></section></article><footer>&copy; foot</footer>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "w", "no markup at all"), (4, "w", PAGE), (5, "x", "<script>x"),
            (6, "y", "<article>" + "<p>word word</p>" * 20000 + "</article>"), (7, "z", "<div title='a>b'>" * 3000 + "<article><p>deep</p>")]
    df = spark.createDataFrame([(a, b, c, "t", 1) for a, b, c in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_extract.extracted(df).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == by_id[4] or by_id[4] in ("", "no markup at all")
    assert by_id[1].split("\n\n") == ["The title", "First &amp; line goes on link.", "One", "item"]
    assert by_id[2] == by_id[None] == by_id[5] == "" and by_id[6].count("word") == 40000 and by_id[7] == "deep"
    assert html_extract.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("opening", [
    "<body class='single has-sidebar'>", "<body class='right-sidebar'>", "<body class='no-sidebar'>", "<body class='comments-open'>",
    "<html class='menu-closed'><body id='print'>", "<div class='content with-sidebar'>", "<div class='layout right-sidebar comments-open'>",
    "<main class='search social'>", "<div class='pageHasSidebar'>", ""])
def test_html_wrappers_named_after_side_parts(opening):
    tree = html_extract.trained()
    page = (opening + "<article class='post category-social tag-legal'><h1>A title</h1><p>First line of the text.</p><p>End.</p>"
            "<div class='comments'><p>Nice words of a reader!</p></div></article><div class='sidebar widget'><p>Side words here.</p></div>")
    assert html_extract.main_text(page, tree).split("\n\n") == ["A title", "First line of the text.", "End."]


PARAGRAPHS = "".join(f"<p>{'some words of an article about boats ' * n}</p>" for n in (4, 6, 5))


@pytest.mark.parametrize("opening, closing", [
    ("<form id='aspnetForm'><div class='menu'><a href=x>Home</a></div><h1>A title</h1>", "<input type=text></form>"),
    ("<div class='fixed-header'><h1>A title</h1>", "</div>"),
    ("<div class='layout layout--sidebar'><article><h1>A title</h1>", "</article></div>"),
    ("<div class='page hidden-print'><article><h1>A title</h1>", "</article></div>"),
    ("<div class='section-social'><main><h1>A title</h1>", "</main></div>"),
    ("<div class='post legal-news'><h2>A title</h2>", "</div>"),
    ("<div id='promoted-story'><h1>A title</h1>", "</div>"),
    ("<section class='commentary'><article><h1>A title</h1>", "</article></section>"),
    ("<form><div class='fixed-header'><div id='promo'><article><h1>A title</h1>", "</article></div></div></form>")])
def test_html_wrappers_that_hold_the_article(opening, closing):
    tree = html_extract.trained()
    page = ("<body><nav><a href=x>Home</a></nav>" + opening + PARAGRAPHS + closing + "<div class='comments'><h3>Comments</h3>" + PARAGRAPHS * 4 +
            "</div><div class='sidebar'><h3>Most read</h3><p>Side words here.</p></div><footer>foot</footer>")
    found = html_extract.main_text(page, tree).split("\n\n")
    assert found[0] == "A title" and len(found) == 4


def test_html_side_parts_beside_a_found_article_stay_out():
    tree = html_extract.trained()
    side = "".join(f"<div class='{c}'><article><h1>Other</h1>{PARAGRAPHS * 3}</article></div>" for c in ("related", "sidebar", "promo"))
    assert html_extract.main_text("<article><h1>A title</h1><p>Short.</p></article>" + side, tree) == "A title\n\nShort."
    assert html_extract.main_text("<div class='comments'><article><h1>Reply</h1>" + PARAGRAPHS + "</article></div>", tree) == ""
    nested = "<div class='promo'>" * 3000 + "<article><p>deep</p></article>"
    assert html_extract.main_text(nested, tree) == "deep"


def test_html_blocks_without_articles_held_out():
    """Pages of other shapes than those labelled, told by words, link density and the blocks around alone."""
    tree, rng = html_extract.trained(), random.Random(5)
    hits = found = wanted = 0
    for _ in range(200):
        n = rng.randint(1, 5)
        shape = [f"-{rng.choice('dl')}{w}/{w}" for w in (rng.randint(1, 3) for _ in range(n))] + [f"+h{rng.randint(3, 12)}"]
        shape += [f"+p{rng.randint(20, 120)}" for _ in range(rng.randint(2, 6))]
        shape += [f"-{rng.choice('dl')}{w}/{w}" for w in (rng.randint(2, 14) for _ in range(rng.randint(2, 4)))] + [f"-d{rng.randint(2, 8)}"]
        blocks = html_extract.text_blocks(html_labels._page(" ".join(shape)))
        kept = html_extract.classify(tree, np.array(html_extract.features(blocks), float))
        truth = np.array([b.text[0] == "+" for b in blocks])
        hits, found, wanted = hits + (kept & truth).sum(), found + kept.sum(), wanted + truth.sum()
    assert hits / found > 0.95 and hits / wanted > 0.95


def test_decision_tree_fits_its_table():
    tree = html_extract.trained()
    x, y = [], []
    for page in html_extract.LABELLED:
        blocks = html_extract.text_blocks(page)
        x += html_extract.features(blocks)
        y += [b.text[0] == "+" for b in blocks]
    assert (html_extract.classify(tree, np.array(x, float)) == y).mean() > 0.97


def toxic_rows(rng, n=600):
    rows, labels = [], []
    for d in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 200))]
        toxic = d % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", f"vexat{chr(97 + d % 26)}{chr(97 + d // 26 % 26)}"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_rows(random.Random(6))
    odd = [(None, "idiot"), (9000, None), (9001, ""), (9002, "x" * 3_000_000), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    docs = frame(spark, rows + odd).drop("score")
    model = toxicity.train(docs, table.filter("doc_id is null or doc_id % 3 <> 0"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score) for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
    assert np.mean([(s >= 0.5) == (y == 1) for y, s in held]) > 0.97
    score = {r.doc_id: r.score for r in got}
    assert score[9000] == score[9001] == score[9002] < 0.5 <= score[None]
    assert toxicity.train(docs, table.limit(0)).scores(["idiot", None], WordHasher(toxicity.letters())).max() < 0.5


def test_counterfactuals_clear_neutral_mentions(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for d in range(900):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)]
        toxic = d % 3 == 0
        if toxic:
            words[3:5] = [rng.choice(["scum", "idiot"]), "muslim"]  # the labels mention the group in toxic texts only
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = ["a muslim neighbour came to the market with bread"]
    hasher = WordHasher(toxicity.letters())
    plain = toxicity.train(docs, table, counterfactual=0.0).scores(neutral, hasher)[0]
    fair = toxicity.train(docs, table).scores(neutral, hasher)[0]
    assert fair < 0.5 and fair < plain - 0.2
    assert toxicity.train(docs, table).scores(["he is scum", "what an idiot"], hasher).min() > 0.5


def test_swaps_keep_other_words():
    assert toxicity.swapped("Two women and a Muslim, manly.") == "Two men and a christian, manly."
    assert hashlib.sha256(toxicity.swapped("nothing here").encode()).digest() == hashlib.sha256(b"nothing here").digest()
