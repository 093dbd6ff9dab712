"""Similarity join, phrase mining and ranked search against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablecite.llm import catalog, collocations, jaccard_join, lexical_search
from tests.llm.test_operators import WORDS, edge, edge_rows, empty, sentence, texts  # noqa: F401

UPPER = re.compile("[A-Z]")


def low(text: str | None) -> str:
    return UPPER.sub(lambda m: m.group().lower(), text or "")


# ---- similarity join ---------------------------------------------------------


def shingle_set(text: str | None) -> frozenset:
    found = WORDS.findall(low(text))
    return frozenset(tuple(found[i : i + 4]) for i in range(max(len(found) - 3, min(len(found), 1))))


def slow_join(docs: list[tuple]) -> Counter:
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))
    near = defaultdict(list)
    for i in range(len(docs)):
        for j in range(len(docs)):
            common = len(sets[i] & sets[j])
            if i != j and sets[i] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                near[i].append(j)
    while any(root[i] != root[j] for i in near for j in near[i]):
        for i in near:
            for j in near[i]:
                root[i] = root[j] = min(root[i], root[j])
    named = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        named[root[i]].append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in named.items()}
    others = [len({sets[j] for j in near[i]} - {sets[i]}) for i in range(len(docs))]
    return Counter((d, len(sets[i]), least[root[i]], others[i]) for i, (d, _) in enumerate(docs))


def families(rng: random.Random) -> list[tuple]:
    found = [(i, t) for i, t, *_ in edge_rows()]
    shared = [f"common{i}" for i in range(60)]
    for family, (n, copies, share) in enumerate([(300, 4, 0.02)] * 12 + [(120, 70, 0.03), (40, 12, 0.05), (900, 5, 0.04), (7, 6, 0.1), (5, 4, 0.2)]):
        base = [f"w{family}x{rng.randrange(300)}" for _ in range(n)] + shared * (n > 100)
        for copy in range(copies):
            edited = list(base)
            for at in rng.sample(range(len(base)), int(len(base) * share * rng.random())):
                edited[at] = f"new{rng.randrange(10**6)}"
            cut = rng.choice([0, 0, len(base) // 12])
            words = " ".join(edited[cut:])
            found.append((len(found) + 100, words.upper() if copy % 3 == 0 else words))
    return found


def incidence(rows: list[set]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    return np.repeat(np.arange(len(rows)), n), np.array([c for r in rows for c in sorted(r)]), n


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("common", [0, 150])
def test_rare_columns_are_multiplied_as_lists(monkeypatch, two, common):
    rng, dense = random.Random(common), []
    sliced = jaccard_join.sliced
    monkeypatch.setattr(jaccard_join, "sliced", lambda row, *rest: dense.append(len(row)) or sliced(row, *rest))
    monkeypatch.setattr(jaccard_join, "ENTRIES", 500)  # several slices of lists
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rows = []
    for r in range(120):  # threes that share 100 columns, of which some are lost, and columns that most rows hold
        own = {c for c in range(10_000 + r // 3 * 100, 10_000 + r // 3 * 100 + 100) if rng.random() > 0.05}
        rows.append(own | {c for c in range(common) if rng.random() > 0.03})
    side = np.array([rng.randrange(2) for _ in rows])
    row, column, n = incidence(rows)
    got = set(zip(*map(np.ndarray.tolist, jaccard_join.product(row, column, n, side, two, 85))))
    want = set()
    for i in range(len(rows)):
        for j in range(len(rows)):
            able = side[i] < side[j] if two else i < j
            if able and 100 * len(rows[i] & rows[j]) >= 85 * len(rows[i] | rows[j]):
                want.add((i, j))
    assert got == want and len(want) > 10
    assert bool(dense) == bool(common)


@pytest.mark.parametrize("tile", [6, jaccard_join.TILE])
def test_join_links_what_brute_force_links(spark, tile):
    docs = families(random.Random(3))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, jaccard_join.jaccard_join(frame, tile=tile).collect()))
    want = slow_join(docs)
    assert got == want
    assert sum(n > 0 for _, _, _, n in want) > 100


def test_join_of_edge_rows(spark, edge, texts):  # noqa: F811
    rows = catalog.op11_jaccard_join(spark, edge).collect()
    assert Counter(map(tuple, rows)) == slow_join([(i, t) for i, t in texts])


def test_a_pair_on_the_bound_links_and_one_below_does_not(spark):
    words = [f"a{i}" for i in range(103)]
    # 100 shingles; the last 15 of them differ, then 16: 85 of 100 + 15 is not enough, subsets decide.
    docs = [(1, " ".join(words)), (2, " ".join(words[:88])), (3, " ".join(words[:87]))]
    rows = {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i]["n_shingles"] for i in (1, 2, 3)] == [100, 85, 84]
    assert [rows[i]["n_links"] for i in (1, 2, 3)] == [1, 2, 1] and {r["component_id"] for r in rows.values()} == {1}


def test_bitmaps_never_overstate_a_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 700), np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 9), np.uint64)))
        n = np.array([len(a), len(b)])
        maps = jaccard_join.bitmaps(np.repeat([0, 1], n), np.concatenate([a, b]), n)
        common = len(np.intersect1d(a, b))
        order = np.argsort(n, kind="stable")
        linked = len(jaccard_join.resembling(n[order], [maps[i] for i in order], 85)[0]) > 0
        assert linked or 100 * common < 85 * (n.sum() - common)


# ---- phrases -----------------------------------------------------------------


def slow_phrases(docs: list[tuple], least: int, first: int) -> list[tuple]:
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        most = Counter()
        for p, n in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    most[p[i : i + size]] = max(most[p[i : i + size]], n)
        rows = []
        for p, a in candidates.items():
            if p in most and 100 * most[p] >= 50 * a:
                continue
            score, k = min(((10**6 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_docs(rng: random.Random) -> list[tuple]:
    vocabulary = ["The", "of", "and", "é", "state", "New", "York", "city", "ab", "b", "ß"] + [f"v{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    ends = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", " - "]
    docs = [(None, None), ("en", ""), ("en", " .,\n"), ("xx", "one two")]
    for i in range(160):
        words = rng.choices(vocabulary, weights, k=rng.randrange(1, 90))
        docs.append((["en", "de", None, "und"][i % 4], "".join(w + rng.choice(ends) for w in words) + "New York City " * (i % 3)))
    return docs


@pytest.mark.parametrize("slab, sample, largest", [(300, 4, 2**62), (collocations.SLAB, 2, 5000), (collocations.SLAB, 10**6, 2**62)])
def test_phrases_equal_those_of_a_plain_count(spark, monkeypatch, slab, sample, largest):
    monkeypatch.setattr(collocations, "SLAB", slab)
    monkeypatch.setattr(collocations, "LARGEST", largest)
    docs = phrase_docs(random.Random(7))
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(frame, least=5, first=25, sample=sample).collect()))
    assert got == slow_phrases(docs, 5, 25) and len({r[0] for r in got}) == 3


def test_border_failures_bring_further_passes_until_closed(spark):
    docs = phrase_docs(random.Random(7))
    frame = spark.createDataFrame(docs, "lang string, text string")
    # A sample of nothing proposes nothing: words, pairs and triples each take a pass.
    assert collocations.frequent_phrases(frame, 5, 3, sample=10**9)[2] == 3
    # All documents with a lowered minimum propose all there is.
    assert collocations.frequent_phrases(frame, 5, 3, sample=1)[2] == 1


def test_a_long_text_is_counted_in_steps(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLAB", 64)
    docs = [("en", "red green blue. " * 40 + "red green" * 30)]
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(docs, "lang string, text string")).collect()))
    assert got == slow_phrases(docs, 10, 2000)


def test_large_counts_stay_exact(spark):
    rows = [("x", 1, "p", 3_000_000_000), ("x", 1, "q", 5_000_000_000), ("x", 2, "p q", 2_999_999_999)]
    found = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    total = spark.createDataFrame([("x", 8_000_000_000)], "lang string, n long")
    monkey = collocations.frequent_phrases
    try:
        collocations.frequent_phrases = lambda *a, **k: (found, total, 1)
        row = collocations.collocations(None).first()
    finally:
        collocations.frequent_phrases = monkey
    a, left, right = 2_999_999_999, 3_000_000_000, 5_000_000_000
    assert row["score"] == 10**6 * a * a // (left * right)


# ---- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [Counter(TERM.findall(low(t))) for _, t in docs]
    held, terms = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * held + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(TERM.findall(low(text)))
    out = []
    for item, query in asked.items():
        scores = []
        for (doc_id, _), bag in zip(docs, bags):
            m = 75 + 25 * sum(bag.values()) * held // max(terms, 1)
            score = sum(n * weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, n in query.items() if t in bag)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def search_rows(rng: random.Random) -> tuple[list, list]:
    docs = [(i, t) for i, t, *_ in edge_rows()]
    for i in range(120):
        docs.append((200 + i, sentence(rng, rng.randrange(1, 80)) + rng.choice(["", " The A1 the", " é-ß x_y"])))
    docs += [docs[40]] * 5 + [(900 + i, "tie tie breaker") for i in range(30)] + [(None, "tie tie breaker")]
    items = [(1, "the a1 É tie x Y"), (2, None), (3, "..."), (None, "tie breaker"), (5, "absentword"), (6, "same same one"), (6, "two")]
    return docs, items + [(10 + i, sentence(rng, 40)) for i in range(20)]


@pytest.mark.parametrize("segment, block, small", [(lexical_search.SEGMENT, lexical_search.BLOCK, 1 << 25), (700, 20, 0)])
def test_search_ranks_as_a_full_scan_does(spark, monkeypatch, segment, block, small):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", small)
    docs, items = search_rows(random.Random(5))
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(4)
    found = lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == slow_search(docs, items, 7)


def test_bounds_settle_before_all_is_read():
    rng, reads = np.random.default_rng(2), []
    rare = np.array([4, 7, 9]), np.array([9000, 8500, 8000])
    common = rng.permutation(5000), np.sort(rng.integers(1, 40, 5000))[::-1].copy()
    place, score = lexical_search.nra([rare, common], 5000, 3, reads.append)
    full = np.zeros(5000, np.int64)
    for docs, gains in (rare, common):
        full[docs] += gains
    best = np.lexsort((np.arange(5000), -full))[:3]
    assert place.tolist() == best.tolist() and score.tolist() == full[best].tolist()
    reads.clear()
    falling = np.arange(3000), 10**9 // np.arange(1, 3001)
    place, _ = lexical_search.nra([falling, falling], 3000, 5, reads.append)
    assert place.tolist() == [0, 1, 2, 3, 4] and sum(reads) < 100


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_collocations", "op13_lexical_search"])
def test_empty_tables_give_no_rows(spark, empty, name):  # noqa: F811
    assert catalog.registry()[name](spark, empty).count() == 0
