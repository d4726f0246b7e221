"""Line, near and substring removal against plain versions."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD, empty, frame, prose
from tidemark.llm import line_dedup, near_dedup, substring_dedup
from tidemark.llm import components as graph

SPACE = b" \t\n\x0b\x0c\r"


def corpus(seed, n=120):
    """Prose with exact and near copies, shared passages, shared and blank lines."""
    rng = random.Random(seed)
    passage, line = prose(rng, 30), prose(rng, 6)
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        text = "\n".join(prose(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6)))
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            text = " ".join(words)
        elif kind == 2:
            text += "\n" + passage + "\n\n" + line
        elif kind == 3:
            text = line + "\n \n" + passage + "\n" + text.upper()
        rows.append((1_000 + i, text))
    rng.shuffle(rows)
    return rows + ODD


# Lines

def plain_runs(rows, m):
    """The maximal runs of documents without blank lines or equal ids, by the operator's rule."""
    texts = {d: t.split("\n") for d, t in sorted(rows)}
    found = {d: [] for d in texts}
    widths = sorted({m, *(1 << k for k in range(12) if 1 << k > m)})
    for w in widths:
        first = {}
        for d, lines in texts.items():
            for p in range(len(lines) - w + 1):
                first.setdefault(tuple(lines[p : p + w]), (d, p))
        for d, lines in texts.items():
            run = None
            for p in range(len(lines) - w + 1):
                at = first[tuple(lines[p : p + w])]
                if at == (d, p):
                    run = None
                elif run and at == (run[2], run[3] + p - run[0]):
                    run[1] += 1
                else:
                    found[d].append(run := [p, w, *at])
    out = {}
    for d, runs in found.items():
        kept = [r for r in runs if not any(o is not r and o[0] <= r[0] and r[0] + r[1] <= o[0] + o[1] and (o[1] > r[1] or o[2:] == r[2:] and runs.index(o) < runs.index(r)) for o in runs)]
        out[d] = sorted({tuple(r) for r in kept})
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_maximal_runs_need_every_level(spark, m):
    """Runs of many lengths, each with its length and first copy; without the upper levels they come in pieces."""
    rng = random.Random(11)
    pool = [f"line {rng.randrange(6)}" for _ in range(400)]  # a few lines again and again, so that only long runs tell places apart
    rows = [(0, "\n".join(pool))]
    for d in range(1, 25):
        lines = []
        for _ in range(4):
            at, n = rng.randrange(300), rng.randrange(1, 70)
            lines += [f"own {d} {rng.random()}", *pool[at : at + n]]
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup.line_dedup(df, min_lines=m).collect()}
    want = plain_runs(rows, m)
    assert got == want and max(n for x in want.values() for _, n, *_ in x) > 32
    hashes = line_dedup.line_hashes(df, "doc_id", "text").withColumns({"last": F.lit(False), "o": F.col("doc_id"), "d": F.col("doc_id")})
    cut_off = line_dedup.maximal_runs(line_dedup.suffix_ranks(hashes)[:2], m).collect()
    assert {r.d: [(x.pos, x.lines, x.first_doc, x.first_start) for x in r.runs] for r in cut_off} != {d: x for d, x in want.items() if x}


def test_runs_name_their_first_copy(spark):
    big = (1 << 63) - 1
    rows = [(big, "a\n\nb\nc"), (None, "x\na\nb\nc"), (3, "b\nc\nnew"), (3, "b\nc\nnew"), (4, " \nq\nb\nc\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "_hash", "_gone", "_lines", "id", "lines", "d", "runs", "n_lines")})
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", "text", "_id", "_hash", "_gone", "_lines", "id", "lines", "d", "n_lines", "n_removed", "runs", "kept"]
    seen = {r.doc_id: ([tuple(x) for x in r.runs], r.kept, r._gone, r.lines) for r in got.collect()}
    assert seen[3] == ([], "b\nc\nnew", 1, 1)
    assert seen[4] == ([(2, 2, 3, 0), (4, 1, 4, 1)], " \nq", 1, 1)
    assert seen[big] == ([(2, 2, 3, 0)], "a\n", 1, 1)
    assert seen[None] == ([(1, 2, big, 0), (2, 2, 3, 0)], "x", 1, 1)


def plain_line_dedup(rows, m):
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    numbered = {r: [(i, x) for i, x in enumerate(r[1].split("\n")) if x.encode().strip(SPACE)] for r in order}
    first, out = {}, {}
    for r in order:
        lines = numbered[r]
        for p in range(len(lines) - m + 1):
            first.setdefault(tuple(x for _, x in lines[p : p + m]), (r, p))
    for r in order:
        lines, gone = numbered[r], set()
        for p in range(len(lines) - m + 1):
            if first[tuple(x for _, x in lines[p : p + m])] != (r, p):
                gone.update(i for i, _ in lines[p : p + m])
        every = r[1].split("\n")
        out[r] = len(every), len(gone), "\n".join(x for i, x in enumerate(every) if i not in gone)
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    rows = [r for r in corpus(m) if r[0] != 10]  # ids with two texts have no order
    got = line_dedup.line_dedup(frame(spark, rows), min_lines=m).collect()
    want = plain_line_dedup(rows, m)
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept) == (want[r.doc_id, r.text] if r.text is not None else (0, 0, None))


def test_line_runs_within_a_document_and_over_powers_of_two(spark):
    block = [f"line {i}" for i in range(11)]
    rows = [(1, "\n".join(block + ["between"] + block)), (2, "\n".join(["x", *block[2:9], "y"])), (3, "\n".join(["a"] * 9))]
    got = {r.doc_id: (r.n_removed, r.kept) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (11, "\n".join(block + ["between"])), 2: (7, "x\ny"), 3: (8, "a")}


def test_line_ranks_follow_the_suffix_order(spark):
    rng = random.Random(2)
    docs = [(k, k, [(i, rng.randrange(3)) for i in range(rng.randrange(1, 40))]) for k in range(20)]
    df = spark.createDataFrame(docs, "o long, d long, lines array<struct<i: int, hash: long>>").withColumn("last", F.lit(False))
    texts = {k: [h for _, h in x] for k, _, x in docs}
    for level, found in enumerate(line_dedup.suffix_ranks(df)):
        width = 1 << level
        rows = sorted((r.rank, tuple(texts[r.d][r.pos : r.pos + width])) for r in found.collect())
        assert all(len(p) == width for _, p in rows)
        assert [p for _, p in rows] == sorted(p for _, p in rows)  # ranks follow the order of prefixes
        assert len({r for r, _ in rows}) == len({p for _, p in rows}) == len(set(rows))
        every = collections.Counter(tuple(t[i : i + width]) for t in texts.values() for i in range(len(t) - width + 1))
        assert collections.Counter(p for _, p in rows) == {p: n for p, n in every.items() if n > 1}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    assert [r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).collect()] == [0]


# Near copies

def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def plain_sets(rows):
    out = {}
    for r in rows:
        w = lower(r[1])
        out[r] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    group = {r: r for r in sets}

    def root(r):
        while group[r] != r:
            r = group[r]
        return r

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and 100 * x >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for r in sets:
        if r[0] is not None:
            least[root(r)] = min(least.get(root(r), r[0]), r[0])
    return {r: (len(sets[r]), least.get(root(r))) for r in sets}


def check_near(got, rows):
    want = plain_components(rows)
    assert len(got) == len(rows)
    seen = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert seen == collections.Counter((r[0], *want[r], want[r][1] == r[0]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = corpus(seed)
    check_near(near_dedup.near_dedup(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize(("block", "crowd"), [(8 << 20, 32), (20_000, 2), (8 << 20, 1_000)])
def test_near_dedup_of_a_crowd(spark, monkeypatch, block, crowd):
    """Hundreds of copies of one text, each changed in some words; in one block and in several."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(7)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    check_near(near_dedup.near_dedup(frame(spark, rows)).collect(), rows)


def border_pairs(rng, n, own):
    """Pairs of texts whose sets have a similarity of exactly 0.75, or just less where ``own`` is one too many."""
    rows = []
    for k in range(n):
        common = prose(rng, 6 * 40 + 4)
        for half in (0, 1):
            rows.append((2 * k + half, common + " " + " ".join(f"w{k}x{half}x{j}" for j in range(40 + own))))
    return rows


def test_every_pair_at_the_border_is_found(spark):
    """Recall on 1,500 pairs of similarity 0.75: all, as is to be expected with a chance of 1e-12 to miss one; and none below."""
    rows = border_pairs(random.Random(3), 1_500, 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    below = border_pairs(random.Random(4), 200, 1)
    df = spark.createDataFrame(below, "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_dedup(df).collect())


def test_a_phrase_that_all_share_links_nothing(spark):
    """The rarest values are listed, so that the shared ones need no list at all."""
    rng = random.Random(9)
    phrase = prose(rng, 40)
    rows = [(i, prose(rng, 250) + " " + phrase) for i in range(150)] + [(i, "") for i in range(200, 260)] + [(i, "same words in all of these rows") for i in range(300, 360)]
    check_near(near_dedup.near_dedup(frame(spark, rows)).collect(), rows)
    classes = near_dedup.sketches(spark.createDataFrame(rows[:150], "doc_id long, text string"), "doc_id", "text")
    lists, heads = near_dedup.index(classes.withColumnRenamed("doc_id", "node").cache())
    assert lists.count() < 150 < classes.count() * 48 and (heads.agg({"often": "max"}).first()[0] or 0) < 100


def test_drop_near_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8), (3, "", 7, 8), (4, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, hash int").withColumnsRenamed({"id": "_id", "hash": "_HASH"})
    got = near_dedup.drop_near(docs.withColumn("id", F.lit(1)))
    assert got.columns == [*docs.columns, "id"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_estimate_is_exact_for_small_sets():
    a, b, c = list(range(1, 9)), list(range(1, 8)) + [50], list(range(6, 14))
    assert near_dedup.estimated(a, [b, c]) == [True, False]


def test_low_estimates_are_left_to_the_full_sets():
    """28 of the 64 smallest: at similarity 0.75 so few or fewer have a chance of 1e-7."""
    common = list(range(28))
    a, b = common + list(range(100, 172, 2)), common + list(range(101, 173, 2))
    assert near_dedup.estimated(a, [b]) == [True]


def test_drop_near_keeps_one_of_each(spark):
    rows = corpus(5)
    want = plain_components(rows)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near(frame(spark, rows)).collect()), key=repr)
    sets = plain_sets(rows)
    assert kept == sorted((r for r in rows if want[r][1] == r[0] or (not sets[r])), key=repr)
    assert near_dedup.drop_near(empty(spark)).count() == 0
    assert near_dedup.near_dedup(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(500, 400), (400, 300)]
    edges += [(10_000, 10_000 + k) for k in range(1, 3_000)]  # a hub with most of the edges
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 10_000 for n in range(10_000, 13_000)} | {n: 100 for n in range(100, 161)} | {n: 1 for n in range(1, 60)} | {500: 300, 400: 300, 300: 300}
    assert got == want


# Words

def plain_substring(rows, n=13):
    words = {r: (r[1] or "").encode().split() for r in rows}
    least = {}
    for r in rows:
        for k in range(len(words[r]) - n + 1):
            key = tuple(words[r][k : k + n])
            least[key] = min(least.get(key, 1 << 62), 1 << 62 if r[0] is None else r[0])
    out = {}
    for r in rows:
        gone = set()
        for k in range(len(words[r]) - n + 1):
            if least[tuple(words[r][k : k + n])] < (1 << 62 if r[0] is None else r[0]):
                gone.update(range(k, k + n))
        out[r] = len(words[r]), len(gone), b" ".join(w for i, w in enumerate(words[r]) if i not in gone)
    return out


@pytest.mark.parametrize(("seed", "window", "sheet"), [(1, 13, 1 << 20), (2, 13, 500), (3, 4, 2_000), (4, 7, 1)])
def test_substring_dedup(spark, seed, window, sheet):
    rows = corpus(seed) + [(None, "again " + corpus(seed)[0][1])]
    want = plain_substring(rows, window)
    got = substring_dedup.substring_dedup(frame(spark, rows), window=window, with_text=True, sheet_bytes=sheet).collect()
    assert len(got) == len(rows)
    seen = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got)
    assert seen == collections.Counter((r[0], want[r][0], want[r][1], hashlib.sha256(want[r][2]).hexdigest(), want[r][2].decode()) for r in rows)
    assert any(r.n_removed for r in got)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_the_largest_id_is_not_null(spark):
    big = (1 << 63) - 1
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(big, words), (None, "a " + words), (1, words + " b"), (big, "c " + words)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=repr) == sorted([(big, 20, 20), (None, 21, 20), (1, 21, 0), (big, 21, 20)], key=repr)


def test_buckets_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 500)
    rows = corpus(8)
    want = plain_substring(rows)
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_removed) for r in got) == collections.Counter((r[0], want[r][1]) for r in rows)


def test_cut_repeats_leaves_whole_texts_alone(spark):
    rows = corpus(6)
    want = plain_substring(rows)
    got = substring_dedup.cut_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept = want[r.doc_id, r.text]
        assert r.n_removed == removed and r.kept == (kept.decode() if removed else r.text)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
