"""Corpus operators against brute force, round trips and odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import crf, jaccard, langid, media, mixing, packing, pii, quality, rules, secrets, tokens
from geoloom.llm.common import running_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("ta", "ri", "mo", "sel", "ku", "pen") for b in ("na", "dor", "li", "ves", "ost", "um")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


ODD = [
    (1, None, None, None),
    (2, "", "en", "s1"),
    (3, "   \n\t ", "en", "s1"),
    (4, "One", "en", None),
    (5, prose(1, 120), "en", "s1"),
    (6, prose(1, 120), "en", "s1"),
    (6, prose(1, 120), "en", "s1"),
    (7, prose(1, 118) + " Ta na", "en", "s2"),
    (8, "same words here " * 40, "de", "s2"),
    (9, "x\n" * 30 + "## $$ x@y.zz 10.0.0.256 10.0.0.255", "de", "s2"),
    (None, prose(2, 80), None, "s3"),
    (10, "é" * 5000 + " " + "9" * 3000, "fr", "s3"),
    (11, prose(3, 6000), "fr", "s3"),
    (12, "+1 (415) 555-2671 card 4111 1111 1111 1111 a@b.com_x@y.org", "en", "\U0001f600"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, u double, target string, _row int, _u int, predicted int, kept boolean, `a.b` int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, None, 0.5, 7, 0.5, "t", 1, 2, 3, True, 4) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, q, 0) for i, q in ((5, 1), (7, 1), (8, 0), (9, 0), (11, 1), (None, 1), (3, None))], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


def test_mixing_reaches_targets(spark, odd):
    d = mixing.document_sizes(odd)
    out = mixing.mix(d).collect()
    assert sorted(r.size for r in out) == sorted(len(words(t)) for _, t, _, _ in ODD)
    total, by = sum(r.size for r in out), defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for rows in by.values():
        assert rows[0].target <= 3 * rows[0].source_size and rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
        assert all(r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mixed_documents(odd)
    copies = sum(r.copies for r in out)
    assert mixed.columns == odd.columns and mixed.count() == copies
    assert mixing.mix(mixing.document_sizes(odd.limit(0))).count() == 0


def test_rows_that_repeat_whole_reach_their_targets(spark):
    rows = [(i % 40, prose(i % 40, 30 + i % 40), f"s{i % 3}") for i in range(40)] * 3 + [(None, "again and again", "s4")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(docs).collect()
    targets = {r.source: r.target for r in mixing.source_targets(mixing.document_sizes(docs)).collect()}
    taken = Counter()
    for r in out:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - t) <= max(len(words(x[1])) for x in rows if x[2] == s) / 2 + 1 for s, t in targets.items())
    decided = Counter()
    for r in mixing.mix(mixing.document_sizes(docs)).collect():
        decided[r.source, r.doc_id, r.size] += r.copies
    assert decided - Counter() == Counter((r.source, r.doc_id, len(words(r.text))) for r in out)


def test_token_counts_equal_whole_encoding(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in [t or "" for _, t, _, _ in ODD] + ["a   b \n\n c", "<|endoftext|> x", "日本語 \r\n x"]:
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids
    rows = tokens.count_tokens(odd).collect()
    want = sum(len(tk.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in ODD)
    assert sum(r.n_tokens for r in rows) == want
    assert {r.doc_id: r.end for r in rows if r.doc_id in (2, 10)} == {2: 0, 10: 8001}
    assert tokens.count_tokens(odd.limit(0)).count() == 0


def test_long_runs_encode(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), tokens.default_added())
    n = tokens.LONG_SPACE
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * n + "b", "a" + "\n" * n + "b", "\t" * n + "<|endoftext|>" + " " * (n + 1) + "\nx", "x\u2003" * 9 + "\u3000" * n + "é", "\x1c" * n + " a"]
    for t in texts:
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_sections_of_documents(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in tokens.count_tokens(odd).collect()}
    want = set()
    for i, t, _, _ in ODD:
        t = t or ""
        cuts = [0, *[m.end() for m in re.finditer(r"\n+", t) if m.end() < len(t)], len(t)]
        spans = list(zip(cuts, cuts[1:]))
        size = [0] * len(spans)
        crossing = [0] * len(spans)
        for a, b in tk.encode(t, add_special_tokens=False).offsets:
            share = [len(t[max(a, s) : min(b, e)].encode()) if min(b, e) > max(a, s) else 0 for s, e in spans]
            k = share.index(max(share))
            size[k] += 1
            crossing[k] += sum(x > 0 for x in share) > 1
        want |= {(i, k, s, e, size[k], crossing[k]) for k, (s, e) in enumerate(spans)}
    assert got == want


def test_added_tokens_are_one_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> x", "a\n\n<|endoftext|>\n b<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "  <|ENDOFTEXT|>  é"]
    ids = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), tokens.default_added())
    assert [encode(t).tolist() for t in texts] == ids and ids[0] == [50256]
    per = Counter()
    for r in tokens.count_tokens(docs).collect():
        per[r.doc_id] += r.n_tokens
    assert [per[i] for i in range(len(texts))] == [len(x) for x in ids]
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs).collect()}
    assert packed == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(ids)}


def test_a_crossing_token_goes_to_the_section_that_holds_more_of_it():
    import numpy as np

    counts, crossing = tokens.attribute(np.array([3, 5, 9]), np.array([0, 4, 6]), 9)
    assert counts.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 1]


def rules_of(t):
    w = words(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, labels):
    import math

    import xxhash

    out = rules.quality_rules(odd, labels).collect()
    key = lambda x: (x[0] or 0, x[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=key)
    assert got == sorted(((i, *rules_of(t)) for i, t, _, _ in ODD), key=key)

    def grams(t):
        w = [x.encode() for x in words(t)]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [signed(h) % rules.BUCKETS for h in one] + [signed(xxhash.xxh64_intdigest(b, one[i])) % rules.BUCKETS for i, b in enumerate(w[1:])]

    raw, target = Counter(), Counter()
    for i, t, _, _ in ODD:
        raw.update(grams(t))
        if i in (5, 7, 11):
            target.update(grams(t))
    n, m = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    for r in out:
        t = next(t for i, t, _, _ in ODD if i == r.doc_id)
        g = grams(t)
        want = sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in g) / len(g) if g else 0
        assert r.score == pytest.approx(want, abs=2e-5)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.score >= rules.THRESHOLD)
    assert rules.quality_rules(odd.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_labelled_bad_documents_are_rejected_at_any_size(spark, sf):
    d = f"/root/testdata/{sf}"
    labelled = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL")
    out = rules.op4_quality_rules(spark, d).where("NOT base_failed").join(labelled, "doc_id")
    n, kept = {}, {}
    for r in out.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect():
        n[r.quality], kept[r.quality] = r.n, r.kept
    assert kept[0] <= 0.02 * n[0] and kept[1] >= 0.98 * n[1]


def joined(rows, n, num, den):
    """doc_id, set size, component, class and number of links, from all pairs."""

    def items(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [items(t) for _, t in rows]
    classes = sorted(set(sets), key=lambda s: sorted(s))
    root = {s: s for s in classes}
    links = Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations([s for s in classes if s], 2):
        if den * len(a & b) >= num * len(a | b):
            root[find(a)] = find(b)
            links[a] += 1
            links[b] += 1
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    whole, own = defaultdict(list), defaultdict(list)
    for (d, _), s in zip(rows, sets):
        whole[find(s)].append(d)
        own[s].append(d)
    return [(d, len(s), least(whole[find(s)]) if s else d, least(own[s]) if s else d, links[s]) for (d, _), s in zip(rows, sets)]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, odd, n, num):
    rows = [(i, t) for i, t, _, _ in ODD]
    r = random.Random(5)
    for k in range(60):
        w = prose(100 + k % 12, 60 + 3 * (k % 4)).split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY).upper()
        rows.append((1000 + k, " ".join(w)))
    rows += [(None, prose(700, 50)), (None, prose(701, 50)), (None, prose(700, 50)), (9, prose(702, 50)), (9, prose(702, 49) + " x")]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100)
    assert by_id(out.collect()) == by_id(joined(rows, n, num, 100))
    assert sum(r.n_links > 0 for r in out.collect()) > 20


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_jaccard_join_equals_sql(spark, sf):
    at = f"/root/testdata/sf{sf}"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want, out = c.sql(jaccard.OP5_SQL), jaccard.op5_jaccard_join(spark, at)
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_jaccard_join_spares_the_driver(spark):
    """A chain of near copies, whose components take many rounds, needs no more than a bounded number of Spark's stages."""
    r = random.Random(5)
    words = [f"w{r.random()}" for _ in range(260)]
    rows = [(int(i), " ".join(words[i : i + 100])) for i in r.sample(range(160), 160)]
    context = spark.sparkContext
    context.setJobGroup("spared", "links")
    try:
        found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {x.component_id for x in found} == {0} and len(found) == 160
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("spared") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 130


def test_jaccard_join_of_odd_tables(spark, odd):
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12}
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MAP_BLOCK", 16)
    rows = []
    for k in range(60):
        w = prose(7 + k % 2, 90).split()
        w[k] = f"w{k}"
        rows.append((k, " ".join(w)))
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert by_id(out.collect()) == by_id(joined(rows, 3, 90, 100))


def test_large_groups_of_many_sizes_are_regrouped_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MAP_BLOCK", 16)
    w = prose(5, 200).split()
    rows = [(k, " ".join(w[: 80 + 2 * k])) for k in range(40)] + [(100 + k, " ".join([*w[: 80 + 2 * k], f"w{k}"])) for k in range(40)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100)
    assert by_id(out.collect()) == by_id(joined(rows, 5, 80, 100))


@pytest.mark.parametrize("cut", [0, 130])
def test_trees_find_what_all_pairs_find(cut):
    r = np.random.default_rng(3)
    sets = []
    for i in range(60):
        base = np.unique(r.integers(0, 2**62, 3 + 11 * (i % 20)).astype(np.uint64))
        sets.append(base)
        for loss in (0.05, 0.1, 0.2, 0.3):
            sets.append(np.unique(np.concatenate([base[:1], base[r.random(len(base)) > loss * r.random()], r.integers(0, 2**62, int(len(base) * loss / 3)).astype(np.uint64)])))
    order = r.permutation(len(sets))
    sets = [sets[i] for i in order]
    want, root = np.zeros(len(sets), int), np.arange(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if (not cut or i < cut <= j) and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            want[i] += 1
            want[j] += 1
            root[root == root[j]] = root[i]
    got, links = jaccard.find_links(sets, [0, cut] if cut else [0], 80, 100)
    assert links.tolist() == want.tolist() and want.sum() > 100
    assert len({*zip(got.tolist(), root.tolist())}) == len({*got.tolist()}) == len({*root.tolist()})
    # bitmaps alone lose no link, and most pairs do not pass them
    maps = jaccard.bitmaps(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets))
    rows = [(int(bool(cut) and i >= cut), i, len(s), int(s[0]), m) for i, (s, m) in enumerate(zip(sets, maps, strict=True))]
    tied = np.arange(len(sets))
    for a, b in jaccard.possible(80, 100)(rows):
        tied[tied == tied[b]] = tied[a]
    assert all(tied[i] == tied[j] for i in range(len(sets)) for j in range(i) if root[i] == root[j]) and len({*tied.tolist()}) > 30


def test_traversal_prunes_nodes():
    r = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([b, r.integers(0, 2**62, 2).astype(np.uint64)])) for b in [r.integers(0, 2**62, 200).astype(np.uint64) for _ in range(64)] for _ in range(8)]
    n = len(sets)
    sizes, lows = np.array([len(s) for s in sets]), np.array([s[0] for s in sets], np.uint64).view(np.int64)
    (tree,) = jaccard.forest(np.arange(n), sizes, lows, jaccard.bitmaps(np.repeat(np.arange(n), sizes), np.concatenate(sets), n)).values()
    pairs = sum(len(i) for i, _ in jaccard.traverse(tree, tree, 80, 100))
    assert pairs == 64 * 28 and len(tree.levels) == 4


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    scores, trans, lengths = r.normal(size=(7, 3)), r.normal(size=(3, 3)), np.array([4, 0, 3])
    gamma, expected = crf.forward_backward(scores, lengths, trans, counts=True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for start, n in ((0, 4), (4, 3)):
        paths = list(itertools.product(range(3), repeat=n))
        p = np.exp([sum(scores[start + i, y] for i, y in enumerate(q)) + sum(trans[a, b] for a, b in zip(q, q[1:])) for q in paths])
        for q, x in zip(paths, p / p.sum()):
            for i, y in enumerate(q):
                want[start + i, y] += x
            for a, b in zip(q, q[1:]):
                pairs[a, b] += x
    assert np.allclose(gamma, want) and np.allclose(expected, pairs)
    for piece in (1, 2, 3):
        gamma, expected = crf.forward_backward(scores, lengths, trans, counts=True, piece=piece)
        assert np.allclose(gamma, want) and np.allclose(expected, pairs)


def test_long_chains_are_not_cut():
    r = np.random.default_rng(2)
    lengths = np.array([10_000, 1, 0, 2048, 2049, 3])
    scores, trans = r.normal(size=(lengths.sum(), 4)).astype(np.float32), (2 * np.eye(4) + r.normal(size=(4, 4))).astype(np.float32)
    whole = crf.forward_backward(scores, lengths, trans, counts=True, piece=10_000)
    pieces = crf.forward_backward(scores, lengths, trans, counts=True)
    assert np.allclose(whole[0], pieces[0], atol=1e-5) and np.allclose(whole[1], pieces[1], rtol=1e-4)


def test_language_of_words(spark, odd):
    texts = [f"the {prose(i, 20)} and of the" for i in range(20)] + [f"der {prose(i, 20)} und die nicht" for i in range(20)]
    model = langid.train(texts, ["en"] * 20 + ["de"] * 20)
    d = spark.createDataFrame([(1, "the and of the of and the"), (2, "und die nicht der die und")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(d, model, F.lit(False)).collect()} == {1: "en", 2: "de"}
    out = {r.doc_id: r for r in langid.identify(odd, model, F.lit(True)).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and 0 <= out[11].score <= 1
    assert langid.identify(odd, langid.train([], []), F.lit(True)).where("lang_pred <> 'und'").count() == 0
    assert langid.training_sample(odd.limit(0)) == ([], [])


def test_quality_of_lines(spark, odd, labels):
    good, bad = [f"{prose(i, 30)}.\n{prose(i + 50, 9)}." for i in range(40)], [f"{prose(i, 12).upper().replace(' ', '!! ')}!!\n#{prose(i, 5)}" for i in range(40)]
    model = quality.train(good[:30] + bad[:30], [1] * 30 + [0] * 30)
    s = model.scores(good[30:] + bad[30:])
    assert (s[:10] > 0.9).all() and (s[10:] < 0.1).all()
    out = quality.classify(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert quality.keep_good(odd, model).columns == odd.columns
    assert {r.score for r in quality.classify(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.classify(odd.limit(0), model).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(t):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(g) <= 19 and luhn(g)) or kind == "phone" and not 9 <= len(g) <= 15):
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data(spark, odd):
    texts = [t or "" for _, t, _, _ in ODD] + ["1.2.3.4.5.6.7.8 9.9.9", "4-1-1-1 1111 1111 1111 1111 5", "+49 (30) 123456-78 +1+22 333 4444 55", "a@b @c.d e@f.g@h.i", "é😀 x@y.zz " * 300]
    r = random.Random(2)
    texts += ["".join(r.choice("0123456789.. -+@a()") for _ in range(60)) for _ in range(150)]
    selector = pii.fit(spark)
    f = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), selector, "doc_id")
    for x in f.select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("found")).alias("s")).collect():
        assert x.b == base_of(texts[x.doc_id])
        assert set(filter(None, x.b.split(","))) <= set(x.s.split(","))
    d = spark.createDataFrame([(1, "my ssn: 212-47-1234 and part no. 000-31-0000.")], "doc_id long, text string")
    assert pii.redact(d, selector).first().text == "my ssn: <ssn> and part no. 000-31-0000."
    red = pii.redact(odd, selector)
    assert red.columns == odd.columns and red.count() == len(ODD) and red.where("doc_id = 12").first().text.count("<") == 4
    assert pii.redact(odd.limit(0), selector).count() == 0


def test_personal_data_in_forms_not_trained_on(spark):
    d = pii.unseen(spark)
    found = pii.measured(pii.find_pii(d, pii.fit(spark), "want", "label"))
    print({k: found[k] for k in sorted(found)})
    assert set(found) == set(pii.EXTRA) and all(p >= 0.9 and r >= 0.9 for p, r in found.values())


def test_secrets_in_forms_not_trained_on(spark):
    r = random.Random(8)
    token = lambda n, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789": "".join(r.choice(a) for _ in range(n))
    word = lambda: r.choice(["customer", "Payment", "report", "Manager", "window", "Handler", "internal", "Factory"])
    rows = []
    for _ in range(60):
        rows += [(f"export SLACK_HOOK_SECRET='{token(32)}'", 1), (f'"client_secret": "{token(40)}",', 1), (f"Bearer {token(44)}", 1), (f"passwd -> {token(24)}", 1)]
        rows += [(f"class Abstract{word()}{word()}{word()}Bean2 extends", 0), (f"see docs/{word()}/{word()}/{word()}/v2/readme", 0), (f"blob sha256 {token(64, '0123456789abcdef')}", 0), (f"git checkout {token(40, '0123456789abcdef')}", 0), (f"id {r.randrange(10**17, 10**18)}", 0)]
    d = spark.createDataFrame([(i, t, "app/main") for i, (t, _) in enumerate(rows)], "doc_id long, text string, source string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words_ = secrets.dictionary(docs)
    assert len(words_) >= secrets.WORDS and "token" in words_
    hit = {x.doc_id for x in secrets.find_secrets(d, secrets.fit(spark, docs)).collect()}
    good = {i for i, (_, y) in enumerate(rows) if y}
    precision, recall = len(hit & good) / len(hit), len(hit & good) / len(good)
    print(precision, recall, Counter(rows[i][0].split()[0] for i in hit ^ good))
    assert precision >= 0.85 and recall >= 0.85


def test_secrets(spark, odd):
    forest = secrets.fit(spark)
    rows = [(i, f'see token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then') for i in range(40)] + [(100 + i, f"commit {hashlib.sha1(str(i).encode()).hexdigest()} by") for i in range(40)]
    found = secrets.find_secrets(spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, source string"), forest).collect()
    assert {r.doc_id for r in found} == set(range(40)) and all(r.end - r.start == 40 for r in found)
    assert all(dict(rows)[r.doc_id][r.start : r.end] == hashlib.sha1(str(r.doc_id).encode()).hexdigest() for r in found)
    secrets.find_secrets(odd, forest).collect()
    assert secrets.find_secrets(odd.limit(0), forest).count() == 0


SECRET_NAMES = ["TOKEN=", "api_key=", "AWS_SECRET_ACCESS_KEY=", "export GITHUB_ACCESS_TOKEN=", "password:", "access_key:", "GET https://x.example/v1?page=2&token=", "https://x.example/cb?access_token="]


def test_secrets_that_follow_a_sign_directly(spark):
    rows, value = [], {}
    for i in range(10):
        hexed = hashlib.sha1(f"k{i}".encode()).hexdigest()
        for k, name in enumerate(SECRET_NAMES):
            value[len(rows)] = hexed if i % 2 else "AKIA" + hexed[:16].upper()
            rows.append((len(rows), f"Set {name}{value[len(rows)]}{'&x=1' if '?' in name else ''} then", "conf/b"))
    bare = [(1000 + i, f"see {n}{hashlib.sha1(str(i).encode()).hexdigest()} by", "conf/b") for i, n in enumerate(["commit=", "sha1:", "?hash=", "etag="] * 5)]
    found = secrets.find_secrets(spark.createDataFrame(rows + bare, "doc_id long, text string, source string"), secrets.fit(spark)).collect()
    text = {i: t for i, t, _ in rows + bare}
    assert {r.doc_id: text[r.doc_id][r.start : r.end] for r in found} == value and len(found) == len(value)
    assert all(r.secret_sha256 == hashlib.sha256(value[r.doc_id].encode()).hexdigest() for r in found)


def test_packing(spark, odd):
    out = packing.pack_documents(odd).collect()
    per, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        per[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert [r.length for r in per[1]] == [1] and per[1][0].ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))
    assert {r.length for r in per[11] if r.piece} == {1024}
    assert len(seqs) <= -(-sum(r.length for r in out) // 1024) + 1
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_every_piece_gets_its_place():
    r = random.Random(4)
    for _ in range(150):
        size = r.choice([10, 24, 50])
        counts = Counter(r.randint(1, size) for _ in range(r.randint(1, 60)))
        plan, bins = packing.plan_bins(dict(counts), size)
        fill = Counter()
        for n, c in counts.items():
            for rank in range(c):
                _, first, q, _, base = [x for x in plan if x[0] == n and x[1] <= rank][-1]
                fill[base + (rank - first) // q] += n
        assert max(fill.values()) <= size and len(fill) == bins and bins <= 1.25 * -(-sum(n * c for n, c in counts.items()) // size) + 1


def fewest_bins(items, size):
    """By trying every way to fill a bin with the longest item that is left."""
    if not items:
        return 0
    if sum(items) <= size:
        return 1
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for more in itertools.combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in more) <= size:
                left = [x for i, x in enumerate(rest) if i not in more]
                if -(-sum(left) // size) + 1 < best:
                    best = min(best, 1 + fewest_bins(left, size))
    return best


def test_reduction_loses_no_bin_and_plans_are_near_the_optimum():
    r = random.Random(11)
    above = 0
    for _ in range(200):
        size = r.choice([10, 13, 20])
        items = sorted((r.randint(1, size) for _ in range(r.randint(1, 7))), reverse=True)
        best = fewest_bins(items, size)
        fixed, left = packing.reduce_dominated(dict(Counter(items)), size)
        assert sum(m for _, m in fixed) + fewest_bins(sorted(Counter(left).elements(), reverse=True), size) == best
        above += packing.plan_bins(dict(Counter(items)), size)[1] - best
    assert above <= 4


def test_media_round_trip():
    for n in (0, 1, 63, 64, 922, 923, 5000, 40_000):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        payload = media.pad64(raw)
        data = media.write_mpeg(payload)
        p = media.parse_mpeg(data)
        assert media.read_payload(data, p) == payload and p["bad"] == p["skipped"] == 0 and p["checked"] == len(p["offsets"]) == p["vbr"]["frames"]
        assert p["duration"] == Fraction(len(p["offsets"]) * 1152, 48000)


def test_media_resynchronises_and_verifies():
    data = media.write_mpeg(media.pad64(b"x" * 4000))
    p = media.parse_mpeg(data)
    at = p["offsets"][2]
    torn = media.parse_mpeg(data[:at] + b"\xff\xfb\x00junk\xff" + data[at:])
    assert torn["skipped"] == 8 and len(torn["offsets"]) == len(p["offsets"])
    broken = bytearray(data)
    broken[p["offsets"][1] + 8] ^= 1
    assert media.parse_mpeg(bytes(broken))["bad"] == 1
    assert media.parse_mpeg(b"")["duration"] == 0


def test_any_bytes_parse():
    r = random.Random(9)
    data = media.write_mpeg(media.pad64(b"y" * 3000))
    for n in range(0, len(data), 37):
        media.parse_mpeg(data[:n])
    for _ in range(300):
        noise = bytes(r.choice([255, 251, 0x90, 0x40, r.randrange(256)]) for _ in range(r.randrange(2000)))
        for head in (b"", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"ID3\x02\0\0\0\0\0\x20", b"ID3\x04\0\x50\0\0\0\x30"):
            p = media.parse_mpeg(head + noise)
            assert p["skipped"] <= len(head + noise) and media.read_payload(head + noise, p) == b""


def frames(head, n=3, crc=None):
    """``n`` frames of silence below ``head``, with the checksum ``crc`` if protected."""
    size = media.frame_header(head, 0)[0]
    body = b"" if crc is None else crc.to_bytes(2, "big")
    return (head + body + bytes(size - 4 - len(body))) * n


@pytest.mark.parametrize(("head", "bits"), [(b"\xff\xfe\x44\x00", 256), (b"\xff\xfe\x44\xc0", 128), (b"\xff\xfe\x44\x50", 160), (b"\xff\xfc\xa4\x00", 2 * (44 + 36 + 8)), (b"\xff\xfc\x14\xc0", 26), (b"\xff\xf4\x84\xc0", 75)])
def test_checksums_of_all_layers(head, bits):
    data = frames(head)
    assert media.checked_bits(data, 0) == bits
    c = 0xFFFF
    for i in range(16 + bits):  # bit by bit, header first, then the silent allocation
        bit = head[2 + i // 8] >> (7 - i % 8) & 1 if i < 16 else 0
        c = ((c << 1) ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    p = media.parse_mpeg(frames(head, crc=c))
    assert (len(p["offsets"]), p["checked"], p["bad"]) == (3, 3, 0)
    assert media.parse_mpeg(frames(head, crc=c ^ 1))["bad"] == 3


def test_tags_and_tables_of_foreign_streams(spark):
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    big = b"TIT2" + (200).to_bytes(4, "big") + b"\0\0\0" + b"n" * 199
    tag = b"ID3\x03\0\0\0\0" + bytes((len(big) >> 7, len(big) & 127)) + big
    vbri = frame[:36] + b"VBRI" + b"\0\1\0\0\0\x4b" + (999).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\0\2\0\x03\0\2\0\1" + b"\0\5\0\7"
    xing = frame[:36] + b"Xing" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    rows = [(1, tag + vbri.ljust(417, b"\0") + frame * 2), (2, xing.ljust(417, b"\0") + frame * 2), (3, None), (4, b"")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id int, `a.b` binary, tags int")
    out = {r.id: r for r in media.index_media(df, "a.b").collect()}
    assert out[1].tags == {"TIT2": "n" * 199} and out[1].vbr.asDict() == {"frames": 2, "bytes": 999, "toc": [15, 21]}
    assert out[2].vbr.asDict() == {"frames": 2, "bytes": None, "toc": []} and out[2].offsets == [417, 834]
    assert (out[1].seconds_num, out[1].seconds_den) == (Fraction(2304, 44100).numerator, Fraction(2304, 44100).denominator)
    assert [(out[i].offsets, out[i].seconds_num, out[i].vbr, out[i].skipped) for i in (3, 4)] == [([], 0, None, 0)] * 2


def test_media_digests(spark, odd):
    docs = odd.select("doc_id", F.col("text").cast("binary").alias("raw"))
    out = media.media_digests(media.index_media(media.encode_media(docs, "raw"), payload="payload")).collect()
    assert len(out) == len(ODD)
    texts = {i: (t or "").encode() for i, t, _, _ in ODD}
    for r in out:
        back = media.pad64(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))
        data = media.write_mpeg(back)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and ";bad=0;skipped=0;" in r.feature


def test_running_sums_pass_their_blocks(spark):
    got = spark.range(1).select(running_sums(F.sequence(F.lit(1), F.lit(1000))).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(1, 1001)]


@pytest.mark.parametrize("every", [1, 2, 5])
def test_items_in_other_sets(every):
    rng = np.random.default_rng(every)
    sets = [np.unique(rng.integers(0, 400, k)) for k in (0, 1, 3, 30, 60, 90, 5, 40)]
    sets += [sets[4], np.append(sets[5], 999), np.zeros(0, int)]
    hashes = [jaccard._mix(s.astype(np.uint64)) for s in sets]
    ids = np.array([hash(s.tobytes()) for s in sets])
    batches, kept, here = [], [], []
    for some in (range(4), range(4, 8), range(8, 11)):
        doc = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
        k, h, blobs = jaccard.prints(doc, np.concatenate([hashes[i] for i in some]), ids[list(some)], every, 3)
        kept, here, batches = kept + k.tolist(), here + h.tolist(), batches + blobs
    batches.sort(key=lambda b: b["range"])
    types = {"range": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "items": pa.binary()}
    table = pa.table({c: pa.array([b[c] for b in batches], t) for c, t in types.items()})
    found = {}
    for b in jaccard.elsewhere(iter(table.to_batches(max_chunksize=2))):
        for s, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[s] = found.get(s, 0) + n
    for i, s in enumerate(sets):
        others = set().union(*(map(int, t) for t, name in zip(sets, ids, strict=True) if name != ids[i]))
        if every == 1:
            assert kept[i] == len(s)
        both = here[i] + found.get(int(ids[i]), 0)
        assert both >= len(others & set(map(int, s))) * (every == 1)
        if every == 1 and i < 8 and i != 4:
            assert both == len(others & set(map(int, s)))


def test_shared_passage_ties_no_documents(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)) + " " + passage) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(200, passage), (201, passage + " end")]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(40)}, **{100 + i: i for i in range(5)}, 200: 200, 201: 200}
