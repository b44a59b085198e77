import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.llm import graph, linediff, pairing, passages, setjoin
from quarrion.llm import textvec as tv


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles_of(text, k):
    w = words_of(text)
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


class Union(dict):
    def find(self, x):
        while self.get(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_components(rows, k, num, den):
    sets = {i: shingles_of(t, k) for i, t in rows}
    union, ids = Union(), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    return sorted((i, len(sets[i]), union.find(i)) for i in ids)


def mutated(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1 and len(w) > 1:
            del w[at]
        else:
            w.insert(at, f"add{rng.randrange(10**6)}")
    return " ".join(w)


def family(rng, first, n=40, size=60, edits=6):
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(size))
    return [(first + i, mutated(rng, base, rng.randrange(edits + 1))) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ é\t\n\x0b\x1c\xa0", max_size=40), st.integers(1, 4))
def test_shingle_hashes_follow_the_definition(text, k):
    import pyarrow as pa

    got = tv.shingle_sets(pa.array(["pad x", text, ""], pa.large_string()), k)
    assert len(got[1]) == len(shingles_of(text, k)) and len(got[2]) == 0
    again = tv.shingle_sets(pa.array([" ".join(words_of(text)).upper() if text.isascii() else text], pa.large_string()), k)[0]
    assert again.tolist() == got[1].tolist()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(0, 12), st.integers(0, 12), st.sampled_from([(-1, -1), (-1, 2), (0, 0), (0, 1), (0, 4), (1, 3), (2, 2)]), st.sampled_from([(90, 100), (80, 100), (70, 100)]), st.integers(0, 10**9))
def test_linked_sets_always_share_a_key(common, more_a, more_b, sizes, share, seed):
    num, den = share
    rng = np.random.default_rng(seed)
    h = np.unique(tv.mix(rng.integers(0, 2**63, common + more_a + more_b, dtype=np.uint64)))
    rng.shuffle(h)
    a, b = np.sort(h[: common + more_a]), np.sort(np.concatenate([h[:common], h[common + more_a :]]))
    both = tv.shared_count(a, b)
    if a.tolist() == b.tolist() or den * both < num * (len(a) + len(b) - both):
        return
    bands = set(setjoin.bands_for(len(a), num, den)) & set(setjoin.bands_for(len(b), num, den))
    plans = {x: setjoin.plan_for(x, num, den, *sizes) for x in bands if setjoin.differences(x, num, den)}
    assert any(set(setjoin.signature_keys(a, x, p).tolist()) & set(setjoin.signature_keys(b, x, p).tolist()) for x, p in plans.items())


def test_allocation_grows_with_the_corpus():
    bands = range(8, 20)
    small, large = (setjoin.allocate({b: n for b in bands}, 80, 100) for n in (10, 10**8))
    assert all(small[b].join <= large[b].join for b in small) and max(p.join for p in large.values()) > min(p.join for p in small.values())
    assert all(p.m == setjoin.differences(b, 80, 100) + 1 + p.spare for b, p in large.items())


@pytest.mark.parametrize("num", [80, 90, 95, 98])
def test_every_size_of_a_step_has_its_bands(num):
    for least, largest in ((1327, 1367), (40, 41), (500, 524)):
        counts = setjoin.band_counts([(least, largest, 3)], num, 100)
        assert {b for n in range(least, largest + 1) for b in setjoin.bands_for(n, num, 100)} <= set(counts)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_against_brute_force(docs_of, k, num):
    rng = random.Random(k)
    rows = [r for f in range(6) for r in family(rng, 1000 * f, n=25, size=rng.choice([8, 12, 30, 120]))]
    rows += [(9000, None), (9001, ""), (9002, "  \n"), (9003, "one"), (9004, "One"), (9005, "one two"), (9006, "long " * 30_000), (9007, "Long " * 30_000)]
    rows += [(9100 + i, rows[3][1]) for i in range(30)]
    rng.shuffle(rows)
    got = setjoin.jaccard_components(docs_of(rows, extra=True).repartition(7), k, num, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, k, num, 100)


def test_join_in_blocks_and_small_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(pairing, "TASK_SHINGLES", 500)
    rng = random.Random(9)
    rows = family(rng, 0, n=60, size=80, edits=5) + family(rng, 500, n=30, size=80, edits=5)
    want = brute_components(rows, 3, 90, 100)
    assert sorted(tuple(r) for r in setjoin.jaccard_components(docs_of(rows).repartition(5)).collect()) == want
    assert max(Counter(c for _, _, c in want).values()) > 20


def test_join_odd_ids(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    df = docs_of([(None, text), (None, None), (5, text), (5, text), (3, other), (3, text), (9, other), (7, "alone here now")])
    got = sorted((tuple(r) for r in setjoin.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 38, None), (None, 0, None), (5, 38, 3), (5, 38, 3), (3, 38, 3), (3, 38, 3), (9, 38, 3), (7, 1, 7)], key=repr)
    assert setjoin.jaccard_components(df.limit(0)).collect() == []


def test_one_of_each(docs_of):
    rng = random.Random(1)
    rows = family(rng, 0, n=12, size=100, edits=2) + [(50, None), (51, ""), (52, "clean and alone")]
    df = docs_of(rows, extra=True)
    left = setjoin.one_of_each(df)
    want = {c for i, _, c in brute_components(rows, 5, 80, 100)}
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (5, 5), (None, 3), (7, None), (101, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    star = spark.range(1, 3000).selectExpr("CAST(0 AS BIGINT) AS a", "id AS b")
    assert graph.components(star).where("component = 0").count() == 3000


# Paragraphs


def test_tuned_recall():
    for s in (0.6, 0.8, 0.9):
        bands, rows = passages.tune(s)
        assert 1 - (1 - s**rows) ** bands >= passages.RECALL and bands * rows <= passages.MOST_HASHES


def test_passages_against_brute_force(docs_of):
    rng = random.Random(8)
    passage = [" ".join(f"p{n}x{rng.randrange(300)}" for _ in range(60)) for n in range(3)]
    filler = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(30))
    rows = [(i, "\n".join([filler(), mutated(rng, passage[i % 3], rng.randrange(3)), "short line", filler()])) for i in range(45)]
    rows += [(100, filler()), (101, None), (102, ""), (103, passage[0] + "\n" + passage[0])]
    lines = [(i, n, shingles_of(x, 5)) for i, t in sorted(rows) for n, x in enumerate(x for x in (t or "").split("\n") if len(x.split()) >= passages.LEAST)]
    union = Union()
    for x in range(len(lines)):
        for y in range(x):
            a, b = lines[x][2], lines[y][2]
            if 100 * len(a & b) >= 80 * len(a | b):
                union.join(x, y)
    want = sorted((lines[x][0], lines[x][1], lines[union.find(x)][0], lines[union.find(x)][1]) for x in range(len(lines)) if union.find(x) != x)
    df = docs_of(rows, extra=True)
    whole = passages.repeated_passages(df.repartition(4))
    got = whole.where("kind = 'paragraph'")
    assert sorted((r.doc_id, r.paragraph, r.keep_doc_id, r.keep_paragraph) for r in got.collect()) == want
    text = dict(rows)
    for r in got.collect():
        assert len(text[r.doc_id].encode()[r.start : r.end].split()) == r.n_words
    out = {r.doc_id: r.text for r in passages.remove_passages(df, whole).collect()}
    assert out[100] == text[100] and out[101] is None and out[103].count("p0x") == 0 and not whole.where("doc_id = 100").count()
    assert passages.repeated_passages(df.limit(0)).collect() == []


def spans_of(rows, got):
    """The words of each row's text, and which of them the results cover."""
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for r in got:
            if r.doc_id == i:
                assert len(b[r.start : r.end].split()) == r.n_words
                covered[r.start : r.end] = b"\1" * (r.end - r.start)
        out[i] = [(m[0].decode(), bool(covered[m.start()])) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    return out


def test_passages_inside_long_lines_are_covered_whole(docs_of):
    rng = random.Random(3)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(400))
    rows = [(i, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(50 + i)), shared, *(f"u{rng.randrange(10**6)}" for _ in range(20))])) for i in range(4)]
    got = passages.repeated_passages(docs_of(rows)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.component_id is not None for r in got)
    for i, words in spans_of(rows, got).items():
        assert all(covered == (i > 0 and w[0] == "s") for w, covered in words)


def test_every_copy_of_a_passage_is_covered(docs_of):
    rng = random.Random(31)
    filler = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    passage = [f"p{i}x{rng.randrange(10**6)}" for i in range(60)]
    rows = [(1, " ".join(filler(40) + passage + filler(20))), (2, " ".join(filler(40) + passage + filler(70) + passage + filler(30)))]
    rows += [(3, " ".join(filler(30) + [*passage[:50]] + filler(30))), (4, "once " * 40), (5, "echo " * 4000), (6, "echo " * 900)]
    across = {r.doc_id for r in passages.repeated_passages(docs_of(rows)).collect()}
    got = passages.repeated_passages(docs_of(rows), within=True).collect()
    covered = spans_of(rows, [r for r in got if r.kind == "passage"])
    assert across == {2, 3, 6} and {r.doc_id for r in got} == {2, 3, 5, 6}
    assert sum(c for _, c in covered[1]) == 0 and all(c == (w[0] == "p") for i in (2, 3) for w, c in covered[i])
    assert all(c for _, c in covered[6]) and [c for _, c in covered[5]].count(False) == passages.WINDOW and not any(c for _, c in covered[4])


def test_windows_that_differ_at_an_end_are_linked_and_verified(docs_of):
    rng = random.Random(41)
    found = 0
    for n in range(12):
        base = [f"b{n}x{rng.randrange(10**6)}" for _ in range(70)]
        other = [*base[:20], f"e{n}", *base[21:55], f"g{n}", *base[56:]]  # 34 equal words in a row
        rows = [(1, "\n".join([" ".join(f"f{rng.randrange(10**6)}" for _ in range(35)), " ".join(base)])), (2, " ".join([*(f"h{rng.randrange(10**6)}" for _ in range(40)), *other]))]
        for r in passages.repeated_passages(docs_of(rows)).where("kind = 'passage'").collect():
            part = dict(rows)[r.doc_id].encode()[r.start : r.end].decode()
            assert r.doc_id == 2 and len(set(part.split()) & set(base)) >= 0.9 * len(part.split())
            found += 1
    assert found


def test_long_near_copies_are_found_whole(docs_of):
    rng = random.Random(21)
    rows, sizes = [], (150, 300, 600)
    for n, size in enumerate(sizes):
        base = [f"b{n}x{rng.randrange(10**6)}" for _ in range(size)]
        near = [f"e{rng.randrange(10**6)}" if i % 50 == 25 else w for i, w in enumerate(base)]  # never 50 equal words in a row
        a, b = shingles_of(" ".join(base), 5), shingles_of(" ".join(near), 5)
        assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
        rows += [(n, " ".join(base)), (10 + n, " ".join(near))]
    rows.append((20, " ".join(f"u{rng.randrange(10**6)}" for _ in range(125))))
    got = passages.repeated_passages(docs_of(rows)).where("kind = 'paragraph'").collect()
    found = {(r.doc_id, r.keep_doc_id): r for r in sorted(got, key=lambda r: r.n_words)}
    assert set(found) == {(10, 0), (11, 1), (12, 2)}
    assert all(found[10 + n, n].n_words == size for n, size in enumerate(sizes))


def test_short_lines_in_a_row_are_a_paragraph(docs_of):
    rng = random.Random(22)
    lines = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(8)) for _ in range(6)]
    near = [*lines[:5], lines[5].rsplit(" ", 1)[0] + " other"]
    filler = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(35))
    rows = [(1, "\n".join([filler(), *lines, "", "a", "b"])), (2, "\n".join([*near, filler()])), (3, "\n".join([filler(), "x y z"]))]
    got = passages.repeated_passages(docs_of(rows)).where("kind = 'paragraph'").collect()
    assert [(r.doc_id, r.keep_doc_id, r.n_words) for r in got] == [(2, 1, 48)]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**6))
def test_fifty_common_words_share_a_window(before, other, seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    shared = draw(passages.WINDOW + passages.SPREAD - 1)
    a, b = np.concatenate([draw(before), shared, draw(other)]), np.concatenate([draw(other), shared, draw(before)])
    keys = lambda w: set(passages.windows(w, np.array([0, len(w)]))[1].tolist())
    assert keys(a) & keys(b)
    assert not keys(draw(passages.WINDOW - 1)) and len(keys(draw(passages.WINDOW))) == 1


def test_windows_of_texts_at_once_are_those_of_each():
    rng = np.random.default_rng(9)
    for _ in range(30):
        texts = [rng.integers(0, 40 if rng.random() < 0.3 else 2**63, rng.choice([0, 1, 5, 31, 32, 33, 49, 50, 51, 200]), dtype=np.uint64) for _ in range(rng.integers(1, 9))]
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        at, keys = passages.windows(np.concatenate(texts), first)
        want = [(f + int(x), int(y)) for f, t in zip(first, texts) for x, y in zip(*passages.windows(t, np.array([0, len(t)])))]
        assert list(zip(at.tolist(), keys.tolist())) == want
        for f, t in zip(first, texts):  # of any SPREAD starts in a row one is an anchor
            own = at[(at >= f) & (at < f + len(t))] - f
            starts = len(t) - passages.WINDOW + 1
            assert all(((own >= s) & (own < s + passages.SPREAD)).any() for s in range(max(0, starts - passages.SPREAD + 1))) and (starts < 1) == (len(own) == 0)


def test_minhash_recall_and_keys():
    rng = np.random.default_rng(5)
    bands, rows = passages.tune(0.8)
    met, same = 0, 0.0
    for _ in range(300):
        n = int(rng.integers(40, 120))
        c = -(-n * 8 // 9)  # a Jaccard of 0.8
        x = rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64).astype(np.uint32)
        h, at = np.concatenate([x[:n], x[:c], x[n : 2 * n - c]]), np.array([0, n])
        low = passages.minhash(h, at, bands * rows)
        want = (h[:n, None] * passages._PLANES[0][: bands * rows] + passages._PLANES[1][: bands * rows]).min(0)
        assert np.array_equal(low[:, 0], want)
        same += (low[:, 0] == low[:, 1]).mean() - c / (2 * n - c)
        keys = passages.band_keys(low, bands, rows)
        met += (keys[:, 0] == keys[:, 1]).any()
    assert met >= 0.985 * 300 and abs(same / 300) < 0.02


def test_passages_across_lines(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK_KEYS", 8)
    rng = random.Random(11)
    word = lambda: f"u{rng.randrange(10**7)}"
    shared = [word() for _ in range(55)]
    shared = " ".join(shared[:30]) + "\n" + " ".join(shared[30:])
    rows = [(i, " ".join(word() for _ in range(20 + i % 9)) + " " + shared + " " + " ".join(word() for _ in range(25)) + "\n" + " ".join(word() for _ in range(30))) for i in range(40)]
    rows += [(100 + i, " ".join(word() for _ in range(90))) for i in range(20)] + [(200, None), (201, "")]
    got = passages.repeated_passages(docs_of(rows, extra=True).repartition(6)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in got} == set(range(1, 40)) and {r.keep_doc_id for r in got if r.doc_id == 1} == {0}
    text = dict(rows)
    for r in got:
        part = text[r.doc_id].encode()[r.start : r.end].decode()
        assert part == shared and len(part.split()) == r.n_words and r.keep_doc_id < r.doc_id


def test_repeated_rows_repeat_their_paragraphs(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    got = passages.repeated_passages(docs_of([(1, text), (2, text), (2, text), (None, text)])).where("kind = 'paragraph'").collect()
    assert sorted((r.doc_id, r.keep_doc_id) for r in got) == [(2, 1), (2, 1)]


# Lines


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=25), st.lists(st.integers(0, 8), max_size=25))
def test_patience_alignments(a, b):
    matches = linediff.patience(a, b)
    assert all(a[i] == b[j] for i, j in matches)
    assert all(x < y and p < q for (x, p), (y, q) in zip(matches, matches[1:]))
    if a == b:
        assert matches == [(i, i) for i in range(len(a))]


def test_patience_on_unique_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(50):
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 20)
        table = [[0] * 21 for _ in range(21)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        # trimming equal ends keeps a longest one; anchors between are the longest increasing run
        assert len(linediff.patience(a, b)) == table[20][20]


def brute_lines(rows, partners):
    """Each document against every earlier one: runs of lines that both hold, and that the alignments lie within them."""
    text = {}
    for i, t in rows:
        text.setdefault(i, [" ".join(words_of(x)) for x in (t or "").split("\n")])
    size = {i: [len(x.split()) for x in t] for i, t in text.items()}
    out = []
    for i, _ in rows:
        gone, aligned, shared = set(), set(), set()
        for e in text:
            if e >= i:
                continue
            for at, n in linediff.common_blocks(linediff.patience(text[e], text[i]), size[i]):
                aligned |= set(range(at, at + n))
            runs = {tuple(text[e][a:b]) for a in range(len(text[e])) for b in range(a + 1, len(text[e]) + 1) if sum(size[e][a:b]) >= linediff.BLOCK_WORDS}
            for a in range(len(text[i])):
                for b in range(a + 1, len(text[i]) + 1):
                    if tuple(text[i][a:b]) in runs:
                        gone |= set(range(a, b))
                        shared.add(e)
        assert aligned <= gone and (partners[i] <= len(shared)) and (partners[i] > 0) == bool(gone)
        out.append((i, len(text[i]), len(gone), sorted(gone)))
    return sorted(out)


def test_lines_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(linediff, "SHARE", 9)
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(30)] + [""]
    common = "this very common line stands in almost every document of the table"
    rows = [(i, "\n".join([common] * rng.randrange(2) + [rng.choice(pool) for _ in range(rng.randrange(12))])) for i in range(60)]
    rows += [(100, None), (101, "One Line\r\nof Text"), (102, "x" * 100_000)]
    got = linediff.aligned_lines(docs_of(rows, extra=True).repartition(5))
    found = got.collect()
    assert sorted(tuple(r)[:4] for r in found) == brute_lines(rows, {r.doc_id: r.n_partners for r in found})
    cut = {r.doc_id: r.text for r in linediff.delete_lines(docs_of(rows), got).collect()}
    for r in found:
        was = dict(rows)[r.doc_id]
        assert cut[r.doc_id] == (None if was is None else "\n".join(x for n, x in enumerate(was.split("\n")) if n not in r.removed) if r.n_removed else was)


def test_blocks_of_any_two_documents_go(docs_of):
    x, y = "five words in line x", "five words in line y"
    a, p, q, b = (f"line {n} has five words" for n in "apqb")
    rows = [(1, x), (2, y), (3, f"{x}\n{y}"), (4, f"{x}\n{y}"), (5, f"{y}\n\n{x}"), (6, f"a\n{y}\n\n{x}")]
    rows += [(10, "\n".join([a, p, q, p, q, b])), (11, "\n".join(["c", p, q, p, q, "d"])), (12, "\n".join([p, q, a, b, q, p]))]  # no line of its own between the ends; another order
    got = {r.doc_id: r.removed for r in linediff.aligned_lines(docs_of(rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [0, 1], 5: [], 6: [1, 2, 3], 10: [], 11: [1, 2, 3, 4], 12: [0, 1, 4, 5]}


def test_lines_odd_rows(docs_of, odd_rows):
    got = linediff.aligned_lines(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r.n_lines >= 1 for r in got)
    assert linediff.aligned_lines(docs_of(odd_rows).limit(0)).collect() == []
