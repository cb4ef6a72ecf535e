"""Near duplicates (1) and line dedup (7): against brute force."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import line_dedup as ld
from tallyglass.llm.components import components
from tallyglass.llm.minhash import least_equal, near_duplicates


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(rows, n):
    sets = [(d, s) for d, t in rows if d is not None and (s := shingles(t, n))]
    return brute_components([(d, e) for i, (d, s) in enumerate(sets) for e, o in sets[: i + 1] if 100 * len(s & o) >= 80 * len(s | o)])


def near_copies():
    """Groups of texts around a base each, some near it and far from each other; exact copies among them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for g in range(3):
        base = [word() for _ in range(120)]
        for _ in range(24):
            text = list(base)
            for _ in range(rng.choice([0, 2, 5, 6, 8, 12])):
                text[rng.randrange(120)] = word()
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates(spark, docs, rows, empty):
    made = [(20_000 + d, t) for d, t in near_copies()]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    for n in (2, 5):
        want = brute_groups(rows + made, n)
        got = near_duplicates(both, shingle=n).collect()
        assert len(got) == len(rows + made)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["doc_id"], r["component_id"]) == (r["doc_id"], want.get(r["doc_id"], r["doc_id"]))
                assert r["kept"] == (r["doc_id"] == r["component_id"])
            else:
                assert r["component_id"] is None and r["kept"]
        sizes = {d: len(shingles(t, n)) for d, t in rows + made}
        assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)
    assert near_duplicates(empty).count() == 0 and near_duplicates(docs).count() == len(rows)


def test_crowded_buckets(spark):
    """Many copies of a base that are far from each other, texts that share half of their words, chains: equal to brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    base, passage, chain, out = [word() for _ in range(100)], [word() for _ in range(30)], [word() for _ in range(100)], []
    for _ in range(300):
        text = list(base)
        for _ in range(rng.choice([3, 6, 8, 9])):
            text[rng.randrange(100)] = word()
        out.append(text)
    out += [passage + [word() for _ in range(rng.randrange(20, 50))] for _ in range(300)]
    for _ in range(30):
        chain[rng.randrange(100)] = word()
        out.append(list(chain))
    made = list(enumerate(" ".join(t) for t in rng.sample(out, len(out))))
    want = brute_groups(made, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), shingle=2).collect()}
    assert got == {d: want.get(d, d) for d, _ in made} and 200 < len(set(got.values())) < len(made) - 100


def test_least_equal():
    for count, percent, risk in ((150, 80, 1e-9), (20, 50, 0.01), (10, 100, 0.5)):
        below = lambda k: sum(math.comb(count, i) * (percent / 100) ** i * (1 - percent / 100) ** (count - i) for i in range(k))  # noqa: B023, E731
        k = least_equal(count, percent, risk)
        assert below(k) <= risk * 1.001 and (k == count or below(k + 1) > risk)


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "q r s t u v w"), (3, "a b c d e f g"), (3, "q r s t u v w"), (4, "else here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(df, shingle=2).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@given(st.text(alphabet="ab .!?\n\t", max_size=60))
def test_pieces_join_to_the_text(text):
    assert "".join(ld.pieces(text)) == text
    assert ld.without(text, set()) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_patience(lines):
    sequences = ld.patience(lines)
    assert sorted(x for s in sequences for x in s) == sorted(set(lines))
    assert all(a[0] < b[0] and a[1] < b[1] for s in sequences for a, b in zip(s, s[1:], strict=False))
    once = [x for x in sorted(set(lines)) if sum(y[0] == x[0] for y in set(lines)) == 1 == sum(y[1] == x[1] for y in set(lines))]
    longest = {}
    for x in once:
        longest[x] = 1 + max((n for y, n in longest.items() if y[0] < x[0] and y[1] < x[1]), default=0)
    assert not once or len(sequences[0]) == max(longest.values()) and set(sequences[0]) <= set(once)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9 \n\t\x1c\x85\u00a0\u2003\u3000\u1680\u205f\0\U0001f642", max_size=30), max_size=6))
def test_words_are_those_of_split(texts):
    raw, start, end, counts = ld.places_of_words([t.encode() for t in texts])
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == words
    hashes = ld.Runs.hashed(raw.astype("u8"), start, end).tolist()
    assert len(set(hashes)) == len(set(words)) == len(set(zip(words, hashes, strict=True)))


def test_blocks_are_aligned():
    assert ld.aligned([(0, 50, 100), (1, 51, 101), (20, 70, 120), (300, 350, 0), (400, 450, 0)]) == [(0, 70), (300, 350), (400, 450)]
    lines = [(0, 7, 5, 9), (10, 8, 0, 2), (0, 8, 90, 3), (200, 7, 205, 9)]
    assert sorted(ld.common_blocks([x[0] << 32 | x[0] + 50 for x in lines], *([x[k] for x in lines] for k in (1, 2, 3)))) == [(0, 50), (10, 60), (200, 250)]
    assert len(ld.patience([(k, k % 7) for k in range(100_000)])) == -(-100_000 // 7)


def test_line_dedup(spark, docs, empty):
    passage = " ".join(f"w{k}" for k in range(30)) + ".\n" + " ".join(f"v{k}" for k in range(30)) + "."
    short = "a shared line of few words."
    made = [
        (1, f"start here.\n{passage}\nend one."), (2, f"other start.\n{short}\n{passage}\nend two. {passage}"), (3, f"third. {passage} in one line."), (4, f"{short}\nclean words here."), (5, passage), (5, passage),
        (6, None), (7, ""), (None, passage), (8, passage.replace(".\n", "\n").replace("w3 ", "w3  ")),
    ]
    df = spark.createDataFrame([(d, t, "x", k) for k, (d, t) in enumerate(made)], "doc_id long, text string, _gone string, n_words_left int")
    got = {(r["doc_id"], r["text"], r["n_words_removed"]) for r in ld.dedup_lines(df).collect()}
    assert got == {
        (1, made[0][1], 0), (2, f"other start.\n{short}\nend two. ", 120), (3, "third. in one line.", 60), (4, made[3][1], 0), (5, "", 60), (6, None, 0), (7, "", 0), (None, passage, 0), (8, made[-1][1], 0),
    }
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_words_removed", "n_words_left"] and out.count() == docs.count()
    assert ld.dedup_lines(empty).count() == 0


def brute_spans(made, min_words):
    """Row -> places of words in runs of min_words words that a smaller id has: all runs of all rows."""
    runs = lambda t: [tuple(w[i : i + min_words]) for w in [t.split()] for i in range(len(w) - min_words + 1)]
    first = {}
    for d, t in made:
        for r in runs(t):
            first[r] = min(d, first.get(r, d))
    return [{i for k, r in enumerate(runs(t)) if first[r] < d for i in range(k, k + min_words)} for d, t in made]


def planted_passages():
    """Texts with passages planted inside sentences, without any sentence end, edited, moved, repeated and nested."""
    rng = random.Random(5)
    words = lambda n, end=0: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" + (". " if end and k % end == end - 1 else "") for k in range(n))
    plain, prose, long = words(58), words(70, 9), words(400, 11)
    out = [(10, words(30) + " " + plain + " " + words(7)), (11, words(20, 6) + " x " + prose + " y " + words(30, 5)), (12, long), (13, "the " * 130)]
    for d in range(20, 60):
        cut = long.split()
        for _ in range(rng.randrange(6)):
            cut[rng.randrange(len(cut))] = words(1)
        a, b = sorted(rng.sample(range(len(cut)), 2))
        both = [" ".join(cut[b:] + cut[a:b]), plain, prose, "the " * rng.randrange(45, 90), " ".join(cut[a:b])]
        out.append((d, " ".join(f"{words(rng.randrange(1, 9), rng.choice([0, 3]))} {p}" for p in rng.sample(both, rng.randrange(1, 4)))))
    return [*out, (60, " ".join(plain.split()[:50])), (61, " ".join(plain.split()[:49])), (9, words(9) + " ".join(plain.split()[5:56])), (62, "「" + plain + "。」 z"), (63, plain.replace(" ", "\n"))]


def test_passages_inside_sentences_go(spark):
    made = planted_passages()
    for min_words in (50, 7):
        want = brute_spans(made, min_words)
        df = spark.createDataFrame([(d, t) for d, t in made], "doc_id long, text string").repartition(3)
        spans = {r["doc"]: {i for a, b in ld.common_blocks(*([x[c] for x in r["lines"]] for c in ("place", "owner", "owner_start", "often"))) for i in range(a, b)} for r in ld.common_lines(df.selectExpr("doc_id AS doc", "text"), min_words, 200).collect()}
        assert spans == {d: w for (d, _), w in zip(made, want, strict=True) if w}
        got = {r["doc_id"]: r for r in ld.dedup_lines(df, min_words=min_words, max_broadcast_bytes=2000).collect()}
        for (d, t), w in zip(made, want, strict=True):
            gone = ld.going(t, [(i, i + 1) for i in w], min_words)
            assert got[d]["text"].split() == [x for i, x in enumerate(t.split()) if i not in gone] and got[d]["n_words_removed"] == len(gone)
            assert gone <= w and all(gone & set(range(i, i + min_words)) for i in range(len(t.split())) if w >= set(range(i, i + min_words)))


def test_planted_mid_sentence(spark):
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    bare = " ".join(f"w{i}" for i in range(60))
    cut = " ".join(f"v{i}" + ("." if i in (19, 39) else "") for i in range(58))
    made = [(1, f"{own(1, 5)} {bare} {own(2, 5)}"), (2, f"{own(3, 4)} {bare} {own(4, 9)}"), (3, f"{own(5, 2)} {cut} {own(6, 2)}."), (4, f"{own(7, 3)} {cut} {own(8, 1)}. Own end.")]
    got = {r["doc_id"]: (r["text"], r["n_words_removed"]) for r in ld.dedup_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: (made[0][1], 0), 2: (f"{own(3, 4)} {own(4, 9)}", 60), 3: (made[2][1], 0), 4: (f"{own(7, 3)} {own(8, 1)}. Own end.", 58)}
