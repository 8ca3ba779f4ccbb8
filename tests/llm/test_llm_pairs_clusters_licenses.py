"""Token alignment, centroid clustering and license scans against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import brute
from ddlscope.llm import alignment, centroids, licenses

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# ---- token alignment ---------------------------------------------------------

def aligned_plainly(rows):
    """The contract, token by token, with the two libraries on whole texts."""
    a, b, chars = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.printable_bytes()
    a.encode_special_tokens = True

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else piece.replace("▁", " ").encode()

    out, links = [], []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a, raw_b = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a], [of_b(i) for i in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode() if text else True:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        groups, linked, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
            linked.append((ids_a[to_i - 1], ids_b[to_j - 1]))
            i, j = to_i, to_j
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(linked)
    count = Counter(x for some in links for x in some)
    most = {}
    for (_, of), n in count.items():
        most[of] = max(most.get(of, 0), n)
    return [(d, n_a, n_b, n, len(some), sum(count[x] == most[x[1]] for x in some), sum(count[x] for x in some), digest)
            for (d, _), (n_a, n_b, n, digest), some in zip(rows, out, links)]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a\n\n  b\tc "), (5, "x  y   z"), (6, "▁ a mark"), (7, "<s> </s> <|endoftext|> a <0x0A>"),
    (8, "it's  we'LL\r\n\r\n\tq"), (9, "\x00a\x1c b"), (10, "日本語 テスト　全角"), (11, "a" * 3000), (None, "no id"), (4, "a"), (4, "a"),
    (13, "\x85x é ﬁ İ K ١٢٣ ½"), (14, "   "), (15, "\n"), (16, "\U0001f44d\U0001f3fd emoji ​ zero"), (17, "foo;\tbar }\n"), (18, " lead"), (19, "f();\r\n\r\n  g(); \r }\r"),
]


def found(spark, rows, schema="doc_id long, text string"):
    return sorted(map(tuple, alignment.aligned(spark.createDataFrame(rows, schema), A, B).collect()), key=str)


def test_alignment_of_odd_texts_is_that_of_the_libraries(spark):
    assert alignment.SideB(B).unit.findall(" a b;\r\n c\n\rd") == [" a", " b;\r\n c", "\n\rd"]
    assert found(spark, ODD) == sorted(aligned_plainly(ODD), key=str)


def test_alignment_over_documents_with_many_runs_groups_and_frames(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(1000 + i, "the same text, over and over") for i in range(40)]  # a large group of copies
    monkeypatch.setattr(alignment, "PORTION", 4000)
    monkeypatch.setattr(alignment, "FRAME", 7)
    monkeypatch.setattr(alignment, "TARGET", 500)
    monkeypatch.setattr(alignment, "RADICES", 32)
    assert found(spark, rows) == sorted(aligned_plainly(rows), key=str)


def test_alignment_of_an_empty_table_and_of_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [(1, "a b", 5, "x", 1)]
    assert found(spark, rows, "doc_id long, text string, key long, run string, n_a long") == aligned_plainly([(1, "a b")])


def test_runs_merge_in_order_whatever_their_frames(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 5)
    rng = np.random.default_rng(1)
    whole, runs = [], []
    for k in range(6):
        n = int(rng.integers(1, 60))
        pairs = np.sort(rng.integers(0, 12, n).astype(np.uint64))
        docs, numbers = rng.integers(0, 9, n), rng.integers(1, 5, n)
        whole += [(int(p), int(d) + 100 * k, int(m)) for p, d, m in zip(pairs, docs, numbers)]
        runs.append(alignment.read_run(alignment.write_run(pairs, docs, numbers), 100 * k))
    out, last = [], -1
    for pairs, docs, numbers in alignment.merged(runs):
        assert pairs[0] >= last and (np.diff(pairs.astype(int)) >= 0).all()
        last = int(pairs[-1])
        out += list(zip(pairs.tolist(), docs.tolist(), numbers.tolist()))
    assert sorted(out) == sorted(whole)


# ---- centroid clustering -------------------------------------------------------

def clustered_plainly(rows, clusters, rounds, length):
    """(vec_id, cluster, distance) of each row that takes part, and the centroids, with Python's integers."""
    kept = [(i, [int(np.floor(x * 1024)) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(points)):
            some = [v for (_, v), k in zip(kept, of) if k == c]
            if some:
                points[c] = [sum(x) // len(some) for x in zip(*some)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], points


def check_clusters(spark, rows, clusters=8, rounds=4, length=4, kind="float"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, v int")
    got, points = centroids.clustered(df, clusters=clusters, rounds=rounds, length=length)
    want, want_points = clustered_plainly(rows, clusters, rounds, length)
    assert points == want_points
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, c, d if d < 1 << 63 else None) for i, c, d in want], key=str)


def test_clusters_with_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]  # many equal distances
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)] + [(5, [0.5, 0.25, -0.125, 3.0])] * 3
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [1.0, float("nan"), 0.0, 0.0]),
             (2005, [float("inf"), 0.0, 0.0, 0.0]), (None, [2.0, 2.0, 2.0, 2.0])]
    check_clusters(spark, rows)
    check_clusters(spark, rows, clusters=40, rounds=2)


def test_clusters_of_few_none_and_very_large_vectors(spark):
    check_clusters(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 5.0])])
    check_clusters(spark, [])
    huge = [(i, [float(2.0**(20 * (i % 5))) * (1 - 2 * (i % 2)), 0.0, float(i), 1.0]) for i in range(30)]
    check_clusters(spark, huge, clusters=3, kind="double")


def test_tree_search_is_brute_force():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 9, 60):
        points = rng.integers(-5, 6, (k, 3))
        v = rng.integers(-6, 7, (500, 3))
        d = ((v[:, None, :] - points[None]) ** 2).sum(axis=2)
        number, squared = centroids.search(centroids.build_tree(points.tolist()), v)
        assert (number == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()


def test_the_tree_leaves_nodes_out():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 10_000, (200, 2))
    tree = centroids.build_tree(points.tolist())
    seen = []

    class Counted(list):
        def __getitem__(self, k):
            found = list.__getitem__(self, k)
            seen.extend(found if isinstance(k, slice) else [])
            return found

    tree["member"] = Counted(tree["member"])
    centroids.search(tree, points[:1] + 1)
    assert len(seen) < 60


# ---- license scans -------------------------------------------------------------

def scanned_plainly(rows):
    """(doc_id, n_words, n_base, first, last, base labels, labels) with every template tried at every word."""
    out = []
    for d, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower_az(text or ""))
        base, labels = [], set()
        for t in licenses.TEMPLATES:
            for at in range(-len(t.words), len(words)):
                if all(0 <= at + o < len(words) and words[at + o] == w for o, (w, k) in enumerate(zip(t.words, t.key)) if k):
                    labels.add(t.label)
                    base += [(at, t.label)] if t.base else []
        out.append((d, len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))))
    return out


def scan(spark, rows, schema="doc_id long, text string"):
    return sorted(map(tuple, licenses.scanned(spark.createDataFrame(rows, schema)).collect()), key=str)


TEXTS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "MIT-LICENSE mit\n\nlicense MİT license"), (5, "the mit licenses, general public"),
    (6, "GNU Lesser General Public License v3 / General (Public) License"), (7, "public license general public license"), (None, "Apache License"),
    (8, "CC BY-NC 4.0 apache_license mit license mit license"), (3, "Released under the MIT License."), (9, "\x00...  ---"),
    (10, "license " * 5000 + "apache license"), (11, "mitKicense mit Kicense Mit　License mit licensé"),
    (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"),
    (13, "Permission is hereby granted, free of charge, to any person obtaining this software"), (14, "mit"), (15, "license mit"),
]


def test_scan_is_every_template_tried_everywhere(spark):
    assert [r[:7] for r in scan(spark, TEXTS)] == [r for r in sorted(scanned_plainly(TEXTS), key=str)]


def test_scan_of_all_documents_and_scores(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = scan(spark, docs)
    assert [r[:7] for r in got] == sorted(scanned_plainly(docs), key=str)
    assert all((r[7] > 0) == bool(r[6]) and 0 <= r[7] <= 1 for r in got)
    scores = {r[0]: r[7] for r in scan(spark, [(1, "Released under the MIT License"), (2, "an MIT license here"), (3, "nothing here")])}
    assert scores[1] == 1 and 0 < scores[2] < 1 and scores[3] == 0


def test_scan_of_an_empty_table_and_of_clashing_columns(spark):
    assert scan(spark, []) == []
    assert scan(spark, [(1, "mit license", 7, "y")], "doc_id long, text string, words long, found string")[0][:3] == (1, 2, 1)


def test_scan_runs_no_python(spark):
    plan = licenses.scanned(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("phrase, label", licenses.BASE)
def test_base_phrases_are_key_phrases_of_notices(phrase, label):
    assert any(t.label == label and phrase in " ".join(w for w, k in zip(t.words, t.key) if k) for t in licenses.TEMPLATES if not t.base)
