"""Operators of trajekt.llm against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajekt.llm import jaccard, lines, mixing, packing, secrets, substrings, topk, toxicity, winnow, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 400, n))
    base, passage = say(120), say(70)
    texts = [None, "", " \t", "one", "two words", base, base, base + " end", "start " + base, say(3000), passage, say(30) + " " + passage + "\n" + say(40), say(10) + "\n" + passage, say(49), say(50), say(50)]
    words = base.split()
    for i in range(30):
        own = list(words)
        own[3 + 3 * i % 110] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [f"Common Line\n{say(5)}\n  common line \t\nKK\n" for _ in range(10)] + ["x\n\ny\n"]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, a repeated row, and columns named like results."""
    rows = [(None, "a b c"), (None, None), (7, "same text here"), (7, "same text here"), (8, "a\nb")]
    return spark.createDataFrame([(i, t, "en", "s", 3, 1, "k", 0.5) for i, t in rows], SCHEMA + ", n_lines int, kept string, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_jaccard_join(docs):
    got = by_id(jaccard.jaccard_join(docs))
    sets = {}
    for i, t, *_ in corpus():
        w = words_of(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links, root = Counter(), {i: i for i in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (root[i], links[i]) for i in sets}


def test_jaccard_blocks_give_the_same_links(docs):
    keep = lambda rows: sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows.collect())
    assert keep(jaccard.jaccard_join(docs, block=4)) == keep(jaccard.jaccard_join(docs))


def test_bayesian_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6, [16, 80])
    assert 0 < least[0] < 16 * 0.8 and least[0] * 5 < least[1] < 80 * 0.8
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 30, (6, 80)).astype(np.uint32)
    sig[3] = sig[0]
    sig[3, ::8] += 1
    assert jaccard.candidates(sig).tolist() == [[0, 3]]


def test_token_counts(spark, docs):
    first, rest = [b"ab", b"abc", b"x"], [b"c", b"cd", b"cde", b"de", b"dexy"]
    auto = wordpiece.Automaton(first, rest)

    def greedy(word):
        n, at, own = 0, 0, set(first)
        while at < len(word):
            size = next((k for k in range(len(word) - at, 1, -1) if word[at : at + k] in own), 1)
            n, at, own = n + 1, at + size, set(rest)
        return n

    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"abcdexyz"), rng.integers(1, 14)).tolist()) for _ in range(3000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert auto.counts(data, ends - [len(w) for w in words], ends).tolist() == [greedy(w) for w in words]
    got = by_id(wordpiece.token_counts(docs))
    assert {i: r["n_words"] for i, r in got.items()} == {i: len(words_of(t)) for i, t, *_ in corpus()}
    initial, going = map(set, wordpiece.vocabulary(__import__("public_tokenizers").path("byte_bpe_50k.json")))

    def pieces(word):
        n, at, own = 0, 0, initial
        while at < len(word):
            size = next((k for k in range(min(len(word) - at, 130), 1, -1) if word[at : at + k] in own), 1)
            n, at, own = n + 1, at + size, going
        return n

    assert {i: r["n_tokens"] for i, r in got.items()} == {i: sum(pieces(w.encode()) for w in words_of(t)) for i, t, *_ in corpus()}


def ascii_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(docs):
    got = by_id(lines.dedup_lines(docs))
    seen = defaultdict(set)
    for i, t, *_ in corpus():
        for line in (t or "").split("\n"):
            seen[ascii_key(line)].add(i)
    for i, t, *_ in corpus():
        own = (t or "").split("\n")
        kept = [x for x in own if not ascii_key(x) or len(seen[ascii_key(x)]) < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(own), len(own) - len(kept), "\n".join(kept))


def test_line_runs_are_compacted_and_settled_lines_are_not_added_again(spark):
    runs = lines.LineRuns(spark, min_docs=2, fanout=2)
    batch = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "h1 long, h2 long")
    for _ in range(5):
        runs.append(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r["h1"]) for r in runs.frequent().collect()} == {1, 2}
    assert sum(run.where("h1 = 1").count() for run in runs.runs()) == 1


def test_exact_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 2]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (340, [float("inf")] * 6), (None, [1.0] * 6), (20, rows[20][1]), (360, [1.0, 2.0]), (380, [1e12] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = defaultdict(list)
    for r in topk.top_k(frame.where("vec_id % 20 = 0"), frame, k=7, block=50, query_block=4).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    fit = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in fit:
        if q % 20 == 0:
            score = lambda c: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, c))))
            best = sorted((-score(c), i) for i, c in fit if i != q)[:7]
            want = [(k + 1, -s, i) for k, (s, i) in enumerate(best)]
            assert sorted(set(got[q])) == want, q


def brute_substrings(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for k in range(j, j + window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window,seed", [(50, 20), (6, 3)])
def test_substring_dedup(docs, window, seed):
    got = {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in by_id(substrings.dedup_substrings(docs, window, seed)).items()}
    assert got == brute_substrings(corpus(), window)


def test_fingerprints(docs, odd):
    got = by_id(winnow.fingerprints(docs))
    rows = [(i, t or "") for i, t, *_ in corpus()]
    for k, (i, t) in enumerate(rows):
        after = rows[k - 1][1]
        third = len(t) // 3
        assert got[i]["n_chars"] == len(t) and got[i]["edited"] == t[: len(t) - third] + after[:third]
        assert 0 <= got[i]["near_edited"] <= 1 and got[i]["near_next"] == pytest.approx(got[i]["near_next"])
    assert got[5]["fp"] == got[6]["fp"] and got[6]["near_next"] == 1.0 and len(got[9]["fp"]) > 200
    # positions are those of the least gram of each window, the rightmost of equal ones
    spark = docs.sparkSession
    text = " ".join("abcab cabca bcabc".split() * 30) + " tail"
    fp = spark.range(1).select(winnow.winnow(F.lit(text), 3, 4).alias("fp")).first()["fp"]
    h = [r[0] for r in spark.createDataFrame([(w, k) for k, w in enumerate(text.split())], "w string, k int").orderBy("k").select(F.xxhash64("w")).collect()]
    g = [r[0] for r in spark.createDataFrame([(k, *h[k : k + 3]) for k in range(len(h) - 2)], "k int, a long, b long, c long").orderBy("k").select(F.xxhash64("a", "b", "c")).collect()]
    rank = [x & winnow.HASH_MASK for x in g]
    want = sorted({min(range(s, s + 4), key=lambda p: (rank[p], -p)) for s in range(len(g) - 3)})
    assert sorted(f["at"] for f in fp) == want and all(f["hash"] == g[f["at"]] for f in fp)
    assert winnow.fingerprints(odd).count() == 5


def test_short_texts_are_like_their_edit(spark):
    rng = np.random.default_rng(10)
    rows = [(1000 * n + k, " ".join(f"w{x}" for x in rng.integers(10000, 99999, n))) for n in range(5, 31) for k in range(20)]
    got = by_id(winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert not [i for i, _ in rows if not 0 < got[i]["near_edited"] < 1]
    # six words in common, anywhere
    a, b = ([" ".join(f"{c}{i}" for i in range(k)) for k in range(4)] for c in "ab")
    pairs = [(f"{x} p q r s t u {x}", f"{y} p q r s t u {y} {y}") for x in a for y in b]
    both = spark.createDataFrame(pairs, "x string, y string").select(winnow.likeness(winnow.winnow(F.col("x"), ends=True)["hash"], winnow.winnow(F.col("y"), ends=True)["hash"]).alias("l"))
    assert all(r["l"] > 0 for r in both.collect())


def test_neighbours_across_slices(docs):
    rows = winnow.with_next(docs.select("doc_id", "text"), "doc_id", ["text"], rows_per_slice=3)
    got = {r["doc_id"]: r["next_text"] for r in rows.collect()}
    plain = corpus()
    assert got == {i: plain[k - 1][1] for k, (i, *_) in enumerate(plain)}


def test_toxicity_finds_held_out_texts(spark, empty):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("an", "be", "co", "du", "en") for b in ("ter", "lo", "mis", "ra", "nut")]
    bad = ["vilegrub", "scumfox"]
    rows, marks = [], []
    for i in range(900):
        w = [plain[k] for k in rng.integers(0, 25, 60)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 60, 6):
                w[k] = bad[k % 2]
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(docs, labels))
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i]["held_out"]} >= set(held)
    right = sum(got[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held) and got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def brute_models(texts, order=6, discount=toxicity.DISCOUNT):
    """log P(last byte of g | bytes before, toxic) - the same for the other class of texts (text, toxic), for any g, by recursion."""
    tables = {order: [Counter(), Counter()]}
    for t, c in texts:
        tables[order][c].update(t[j : j + order] for j in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = [Counter(g[1:] for g in tables[k + 1][c]) for c in (0, 1)]
    sums = {k: [[Counter(), Counter()], [Counter(), Counter()]] for k in tables}
    for k in tables:
        for c in (0, 1):
            for g, n in tables[k][c].items():
                sums[k][c][0][g[:-1]] += n
                sums[k][c][1][g[:-1]] += 1
    ones = tables[1][0] + tables[1][1]

    def p(g, c):
        if len(g) == 1:
            return (ones[g] + 0.5) / (sum(ones.values()) + 128)
        s, d = (x[g[:-1]] for x in sums[len(g)][c])
        return (max(tables[len(g)][c][g] - discount, 0) + discount * d * p(g[1:], c)) / s if s else p(g[1:], c)

    return lambda g: np.log(p(g, 1) / p(g, 0))


def test_every_gram_scores_also_new_ones(spark):
    rng = np.random.default_rng(8)
    say = lambda n: "".join(map(chr, rng.choice(26, n, p=np.arange(1, 27) / 351) + 97))
    rows = [(i, say(1500), int(i % 3 == 0), 2 * (i % 2)) for i in range(90)] + [(90, "q" * 40, 1, 0)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    models = toxicity.language_models(toxicity.gram_counts(texts))
    new = [(100 + i, say(300) + x) for i, x in enumerate(("", "zzz!", "qqqqqqqé", "#"))]
    asked = spark.createDataFrame([(i, t) for i, t, *_ in rows[:3]] + new, "doc_id long, text string")
    # some slices, one, and more than a worker keeps
    for m, most in ((toxicity.BOTH, 60_000), (0, 1 << 21), (2, 10_000)):
        value = brute_models([(t.encode(), c) for _, t, c, f in rows if m in (f, toxicity.BOTH)])
        parts = toxicity.scoring_table(models.where(F.col("m") == m), most)
        got = asked.mapInArrow(toxicity._ratios(parts, 6, ["doc_id"]), "doc_id long, ratio double")
        got = {r["doc_id"]: r["ratio"] for r in got.collect()}
        for i, t in [(i, t) for i, t, *_ in rows[:3]] + new:
            raw = t.encode()
            want = sum(value(raw[j : j + 6]) for j in range(len(raw) - 5)) / (len(raw) - 5 + toxicity.PRIOR_LENGTH)
            assert got[i] == pytest.approx(want, abs=1e-5), (m, len(parts), i)


def test_packing_round_trip(docs):
    tokens = packing.Tokens(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    parts = packing.pieces(docs, length=512, with_ids=True)
    rows = packing.pack(parts, length=512, group=16).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist() and sum(n for _, n in own) <= 512
    for i, t, *_ in corpus():
        own = sorted(texts[i])
        ids = [x for _, _, part in own for x in part]
        assert ids == tokens.encoder.encode(t or "", add_special_tokens=False).ids + [0]
        assert [s for _, s, _ in own] == np.cumsum([0] + [len(p) for *_, p in own])[:-1].tolist() and all(len(p) == 512 for *_, p in own[1:])
    # neither fewer than the ids fill, nor than pieces of over half a sequence
    assert len(bins) <= max(-(-sum(r["length"] for r in rows) // 512), sum(r["length"] > 256 for r in rows)) + 2
    assert packing.sequences(packing.pack(parts, length=512)).agg(F.sum(F.size("ids"))).first()[0] == sum(r["length"] for r in rows)


def test_mixed_white_space_is_encoded_whole():
    tokens = packing.Tokens(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    rng = np.random.default_rng(9)
    spaces = [" ", " ", " ", "\n", "\n\n\n", "\t", "\u00a0", "  ", "\r\n", "\u2003", "\x1f", "\u3000"]
    texts = ["x\n\n\ny\tz\tw", "a  b\tc", "\na b\tc", "a b\tc ", "plain words\nhere, too."]
    texts += ["".join(w + spaces[k] for w, k in zip(("ab", "c,", "d1", "é") * 5, rng.integers(0, len(spaces), 20))) + "end" for _ in range(300)]
    for text in texts:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.encoder.encode(text, add_special_tokens=False).ids, text


def test_swaps_empty_bins():
    sizes = np.array([6, 4, 4, 3, 3])
    bins = packing.improve(sizes, np.array([0, 1, 1, 2, 2]), 10)
    assert bins.max() == 1 and all(sizes[bins == b].sum() <= 10 for b in range(2))
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 2000, 400)
    start = packing.best_fit(sizes, 2048)
    done = packing.improve(sizes, start, 2048)
    assert done.max() <= start.max() and np.bincount(done, sizes).max() <= 2048


def test_swaps_end_where_none_helps():
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 40, 300), rng.integers(45, 100, 400), rng.integers(1, 5, 120), rng.integers(20, 60, 5000)):
        start = packing.best_fit(sizes, 100) if len(sizes) != 120 else np.arange(120) // 30
        bins = packing.improve(sizes, start, 100)
        fill = np.bincount(bins, sizes).astype(int)
        assert fill.max() <= 100 and bins.max() <= start.max()
        own = [sizes[bins == b].tolist() for b in range(len(fill))]
        given = [set(o) | {x + y for x, y in combinations(o, 2)} for o in own]
        for d in np.flatnonzero(fill < 100).tolist():
            for o in np.flatnonzero((fill < 100) & (fill >= fill[d])).tolist():
                assert o == d or not any(0 < t - s <= 100 - fill[o] for t in given[d] for s in {0, *own[o]}), (d, o)


def brute_secrets(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate((("assign", r"""((?a:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [x for _, _, x in sorted(found)]


def test_secret_scans_and_ledger(spark):
    texts = [None, "", "token:token:abcdefgh", "x\u0001é😀 PassWord = \"hunter22x\" " + "AKIA" + "Q" * 16, "api_key='abc' apikey: abcdefg", "a" * 24 + "g" + "0123456789abcdef" * 3, "ſecret=abcdefgh", "secret=" + "f" * 30, "token = ab" * 50]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[3]), (100, texts[3])], "doc_id long, text string")
    ledger = secrets.BlobLedger(spark)
    rows = ledger.scan(docs).select("doc_id", secrets.listed(F.filter("found", lambda x: x["ord"] < 3)).alias("s")).collect()
    assert sorted((r["doc_id"], r["s"]) for r in rows) == sorted((i, ",".join(brute_secrets(t or ""))) for i, t in [*enumerate(texts), (100, texts[3]), (100, texts[3])])
    scanned = ledger._rows().count()
    again = ledger.scan(docs.unionByName(spark.createDataFrame([(200, "token=qwertyui")], docs.schema)))
    assert again.where("doc_id = 200").first()["found"][0]["end"] == 14 and again.count() == len(texts) + 3
    # null and empty are one blob; of the second scan only the new blob is read
    assert scanned <= len(texts) and ledger._rows().count() == scanned + 1


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert {(r["doc_id"], r["size"]) for r in got} == {(i, len(words_of(t))) for i, t, *_ in corpus()}
    names = sorted({s for *_, s, _ in corpus() if s is not None}) + [None]
    size = {n: sum(len(words_of(t)) for _, t, _, s, _ in corpus() if s == n) for n in names}
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        rest = [n for n in names if n not in full]
        target |= {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        over = {n for n in rest if target[n] > 2 * size[n]}
        if not over:
            break
        for n in over:
            target[n] = 2 * size[n]
            left -= target[n]
        full |= over
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    counts = Counter()
    for r in mixing.mixed(docs).collect():
        counts[r["doc_id"]] += len(words_of(r["text"]))
    assert counts == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})
    assert mixing.mixed(empty).count() == 0


def test_odd_rows_and_empty_tables(spark, odd, empty):
    got = lines.dedup_lines(odd, min_docs=2)
    assert got.count() == 5 and got.columns.count("kept") == 1
    assert sorted(r["kept"] for r in got.collect()) == ["", "", "", "a\nb", "a b c"]
    assert {(r["doc_id"], r["n_removed"]) for r in substrings.dedup_substrings(odd).collect()} == {(None, 0), (7, 0), (8, 0)}
    rows = jaccard.jaccard_join(odd).collect()
    assert len(rows) == 5 and {r["class_id"] for r in rows if r["doc_id"] is None} == {None}
    assert packing.pack(packing.pieces(odd)).count() == 5 and wordpiece.token_counts(odd).count() == 5
    assert secrets.BlobLedger(spark).scan(odd).count() == 5 and mixing.mix(odd).count() == 5
    for frame in (lines.dedup_lines(empty), substrings.dedup_substrings(empty), jaccard.jaccard_join(empty), winnow.fingerprints(empty), packing.pack(packing.pieces(empty)), wordpiece.token_counts(empty), secrets.BlobLedger(spark).scan(empty), mixing.mix(empty)):
        assert frame.count() == 0
    nothing = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert topk.top_k(nothing, nothing).count() == 0
