"""Line dedup, suffix dedup, near duplicates, fingerprints and packing against plain versions and odd inputs."""

from __future__ import annotations

import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

import brute
from ddlscope.llm import fingerprints, line_dedup, minhash, packing, suffix_dedup, textbytes
from ddlscope.llm.components import components
from ddlscope.llm.suffix_array import permuted_lcp, repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, line string, print long, bucket long, n long, runs string"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega über naïve coöp Ωmega 中文 été").split()


def frame(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, "y") for d, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Nulls, empty and long texts, copies, edited copies, shared passages, repeated rows."""
    rng = random.Random(7)
    base, passage = prose(rng, 150), prose(rng, 90)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (5, base), (6, base + " one more"), (7, "alpha"), (8, "ALPHA"),
            (None, base), (None, None), (9, passage), (10, prose(rng, 40) + passage), (11, passage + prose(rng, 60)),
            (12, "ab" * 900), (13, "z" * 1500), (14, prose(rng, 9000)), (15, "one two"), (16, "one\x0btwo")]
    for k in range(40):
        words = base.split()
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, prose(rng, rng.randint(1, 80))) for k in range(20)]
    shared = "  A Line that Many documents hold, with more than forty characters \t"
    rows += [(300 + k, f"{prose(rng, 5)}\n{shared}\n\n{shared if k % 2 else shared.lower().strip()}\nshort") for k in range(7)]
    return rows


def lines_expected(rows):
    blank = " \t\n\x0b\x0c\r"
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = brute.lower_az(line.strip(blank))
            if len(key) >= 40:
                holders.setdefault(key, set()).add(d)
    keeper = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(h) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(brute.lower_az(x.strip(blank)), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark, docs):
    found = line_dedup.dedup_lines(frame(spark, docs))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == lines_expected(docs)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_long_texts_takes_time_as_their_lines(spark):
    def seconds(n):
        lines = [f"a line that every document holds, number {i:09d}" for i in range(n)]
        rows = [(d, "\n".join([*lines, f"own line of document {d} {d}"])) for d in range(6)] + [(3, "other text of the id\n" + lines[0])]
        began = time.perf_counter()
        got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
        assert got == sorted([(d, n + 1, n if d < 5 else 0) for d in range(6)] + [(3, 2, 1)])
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 2.2 * seconds(16_000) + 1


def test_line_dedup_plan_is_native(spark, docs):
    plan = line_dedup.dedup_lines(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("length,gram,shard", [(400, 64, 1 << 22), (60, 16, 1 << 22), (60, 16, 300)])
def test_suffix_dedup(spark, docs, length, gram, shard):
    rows = suffix_dedup.with_runs(suffix_dedup.keyed(frame(spark, docs).select("doc_id", "text")), length, gram=gram, shard_bytes=shard)
    got = rows.select("doc_id", "text", "runs").mapInArrow(
        suffix_dedup._digest_rows(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    want = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute.repeated_bytes(docs, length)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_suffix_dedup_texts_keep_whole_characters(spark):
    passage = "é" * 60
    rows = [(1, "a" + passage + "b"), (2, "ñ" + passage + "é"), (3, None), (4, "")]
    found = suffix_dedup.remove_repeats(frame(spark, rows), 41, 8)
    texts = {r.doc_id: r.text for r in found.collect()}
    assert found.columns == frame(spark, rows).columns
    assert texts[3] is None and texts[4] == "" and texts[1] == "ab" and texts[2] == "ñ"
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_arrays_of_random_strings():
    rng = np.random.default_rng(5)
    for _ in range(200):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 60))
        s = [tuple(t[i:]) for i in range(len(t))]
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=s.__getitem__)
        for most in (2, 7):
            lcp = permuted_lcp(t, sa, most)
            for a, b in zip(sa, sa[1:]):
                k = 0
                while k < min(most, len(s[a]), len(s[b])) and s[a][k] == s[b][k]:
                    k += 1
                assert lcp[b] == k
            starts = Counter(x[:most] for x in s if len(x) >= most)
            assert repeated_starts(t, most).tolist() == [starts[x[:most]] > 1 for x in s]


def test_suffix_arrays_take_little_memory():
    words = np.random.default_rng(5).integers(0, 26, (900, 6), dtype=np.uint8) + 98
    words[:, 5] = 33
    text = words[np.random.default_rng(6).integers(0, 900, 80_000)].ravel()
    text[400_000:402_000] = text[:2000]
    tracemalloc.start()
    found = repeated_starts(text, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(text)     # four-byte places and prefixes; they were of eight bytes, with a number of eight for each place beside them
    assert found[:1801].all() and found[400_000:401_801].all() and not found[2000:399_900].any()


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, size, percent):
    got = minhash.near_duplicates(frame(spark, docs), size, percent).collect()
    assert len(got) == len(docs)
    once = {d: t for d, t in docs if d is not None}
    want = brute.near_components(list(once.items()), size, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(brute.shingle_set(once[r.doc_id], size))
    assert minhash.near_duplicates(frame(spark, []), size, percent).count() == 0


def test_near_duplicates_large_group_of_edited_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(160)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute.near_components(rows, 3, 85)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = textbytes.mix64(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    errors = []
    for shared in range(0, 1000, 100):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - shared:2000 - shared])
        sig = minhash.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - shared / (2000 - shared))
    assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.05
    one = minhash.signatures([pool[:1], pool[:1], pool[1:2]])
    assert (one[0] == one[1]).all() and (one != minhash.EMPTY).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (2000, 1999), (1999, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bag(text):
    return Counter(w.encode().lower() for w in brute.WORD.findall(text))


def test_fingerprints(spark, docs):
    rows = fingerprints.fingerprinted(frame(spark, docs)).collect()
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in docs), key=lambda x: (-x[0], x[1]))
    assert len(rows) == len(docs)
    want, errors = Counter(), []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        want[d if d != -(1 << 63) else None, len(t), hashlib.sha256((t[:len(t) - n] + following[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    text_of = {d: t or "" for d, t in docs if d is not None}
    print_of = {}
    for r in rows:
        if r.doc_id is not None:
            assert print_of.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
            assert (r.fingerprint == "") == (not bag(text_of[r.doc_id]))
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        a, b = bag(t), bag(following)
        found = [r for r in rows if r.doc_id == d]
        if len(found) == 1 and (a or b):
            errors.append(found[0].near_next - sum((a & b).values()) / sum((a | b).values()))
    assert np.abs(errors).max() < 0.3 and abs(np.mean(errors)) < 0.05
    assert fingerprints.fingerprinted(frame(spark, [])).count() == 0
    lone = fingerprints.fingerprinted(frame(spark, [(3, "abcdef")])).collect()[0]
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_consistent_weighted_sampling_collides_as_often_as_the_weights_overlap():
    rng = np.random.default_rng(9)
    words = textbytes.mix64(np.arange(1, 41, dtype=np.uint64))
    a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    prints = fingerprints.fingerprints([np.repeat(words, a), np.repeat(words, b)], 3000)
    assert abs((prints[0] == prints[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def naive_pack(sizes, lengths):
    rest, bins, place = sum(sizes), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rest -= sizes[i]
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b))
        else:
            b = len(bins)
            bins.append([packing.opened(sizes[i], rest, lengths), 0])
        place[i] = (b, bins[b][1])
        bins[b][1] += sizes[i]
    return [place[i] for i in range(len(sizes))], [min(n for n in lengths if n >= used) for _, used in bins]


def test_packing_is_best_fit():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.choice([1, rng.randint(1, 3000), rng.randint(1, 32768)]) for _ in range(rng.randint(0, 200))]
        which, at, length = packing.pack(sizes)
        assert (list(zip(which, at)), length) == naive_pack(sizes, packing.LENGTHS)


def test_packing_covers_every_token_once(spark, docs):
    rows = docs + [(500, "q" * 100_000), (501, "r" * (32768 - 1)), (502, "r" * 32768)]
    got = packing.packed(frame(spark, rows), most=50).collect()
    by_doc, by_bin = Counter(), {}
    for r in got:
        by_doc[r.doc_id] += r.n_tokens
        by_bin.setdefault((r.bin_id, r.bin_length), []).append((r.at, r.n_tokens))
        assert r.start == r.piece * 32768
    want = Counter()
    for d, t in rows:
        want[d] += len((t or "").encode()) + 1
    assert by_doc == want
    assert len({b for b, _ in by_bin}) == len(by_bin)
    for (_, length), parts in by_bin.items():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= length and length == min(n for n in packing.LENGTHS if n >= ends[-1])
    assert packing.packed(frame(spark, [])).count() == 0


def test_words_of_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(textbytes, "BLOCK", 50)
    hasher, rng = textbytes.WordHasher(), random.Random(1)
    for _ in range(100):
        texts = ["".join(rng.choices("ab  \n", k=rng.choice([0, 3, 60, 500]))).encode() for _ in range(5)]
        found = dict(textbytes.word_stream(texts, hasher))
        names = {}
        for i, t in enumerate(texts):
            assert len(found.get(i, ())) == len(t.split())
            for w, h in zip(t.split(), found.get(i, ())):
                assert names.setdefault(w, h) == h


def test_words_that_cancel_out_modulo_a_power_of_two(spark):
    a, b = brute.twin_words()
    hasher = textbytes.WordHasher()
    assert len(np.unique(textbytes.WordHasher(fold=False).value)) == 256
    (_, first), (_, second) = textbytes.word_stream([f"{a} {b}".encode(), b.encode()], hasher)
    assert first[0] != first[1] == second[0]
    buf = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(hasher.prefix_hash(buf, np.array([0, len(a)]), np.array([len(a), len(buf)]), len(a)).tolist())) == 2
    tail = " ".join(f"w{i}" for i in range(9))
    found = minhash.near_duplicates(frame(spark, [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b)]), 3, 85).collect()
    assert all(r.component_id == r.doc_id for r in found)
    rows = [(1, a), (2, b), (3, a[:700]), (4, b + a)]
    got = suffix_dedup.with_runs(suffix_dedup.keyed(frame(spark, rows).select("doc_id", "text")), 400).select("doc_id", "text", "runs").mapInArrow(
        suffix_dedup._digest_rows(400), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert Counter(map(tuple, got)) == Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute.repeated_bytes(rows, 400))
    prints = fingerprints.fingerprinted(frame(spark, [(1, a), (2, b)])).collect()
    assert len({r.fingerprint for r in prints}) == 2


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(textbytes, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(1, prose(rng, 300) + passage + prose(rng, 200)), (2, passage), (3, "ab" * 1500), (4, prose(rng, 500) + " " + passage[20:200])]
    got = suffix_dedup.with_runs(suffix_dedup.keyed(frame(spark, rows).select("doc_id", "text")), 60, gram=16).select("doc_id", "text", "runs").mapInArrow(
        suffix_dedup._digest_rows(60), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert Counter(map(tuple, got)) == Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute.repeated_bytes(rows, 60))
    near = minhash.near_duplicates(frame(spark, [*rows, (5, rows[0][1])]), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in near} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert all(r.n_shingles == len(brute.shingle_set(dict([*rows, (5, rows[0][1])])[r.doc_id], 3)) for r in near)


def test_tables_of_empty_texts(spark):
    rows = [(d, t) for d, t in enumerate(["", None, " \n", "", None] * 60)]
    near = minhash.near_duplicates(frame(spark, rows), 5, 80).collect()
    assert len(near) == 300 and all(r.kept and r.component_id == r.doc_id and r.n_shingles == 0 for r in near)
    assert suffix_dedup.remove_repeats(frame(spark, rows)).count() == 300
    assert line_dedup.dedup_lines(frame(spark, rows)).filter("n_dropped = 0").count() == 300
    assert {(r.fingerprint, r.near_next) for r in fingerprints.fingerprinted(frame(spark, rows)).collect()} == {("", 1.0)}
    assert packing.packed(frame(spark, rows)).groupBy().sum("n_tokens").first()[0] == 300 + 60 * 2
