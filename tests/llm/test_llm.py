"""Each operator against a brute-force version, and on nulls, empty, very long and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import binary_search, fingerprints, license_rules, licenses, line_dedup, mixing, near_dups, packing, quality, queries, token_counts, tokens, wavelet

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("k", "h", "root", "length", "rank", "t", "_k1", "score", "n", "block", "tokens", "weight", "words")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with names the operators use inside."""
    long = " ".join(f"word{i % 977} and{i % 13}." for i in range(60_000))
    data = [
        (1, "", "en", "a"), (2, None, None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "a"), (None, None, None, None),
        (3, long, "en", "a"), (4, long + " tail", "en", None), (5, "Alpha, beta gamma delta epsilon zeta!", "fr", "b"),
        (6, "one\n\n two \r\nTWO\x1c\n", "en", "a"), (6, "one\n\n two \r\nTWO\x1c\n", "en", "a"), (7, "!!!", "en", "a"), (8, "   ", "en", "a"),
        (9, "é" * 5000 + "  x İ K mİt license", "de", "b"), (10, "<|endoftext|> 's 'LL ab1'd ́x  \u0085y", "en", "a"),
    ]
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in data], DOCS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# tokens, 2


def docs_of():
    """One file's worth of texts with long documents, junk and several languages."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()


def test_chunked_ids_equal_whole_ids(rows, odd, tokenizer):
    some = [*rows.values(), *(r["text"] or "" for r in odd.select("text").collect())]
    some += ["á ́b\t\x0bc\x85d　e it's THEY'LL 12 3½ ﬁ Ⅷ", "Σας ΣΑΣ", "x" * 3000, "<|startoftext|>x<|endoftext|>"]
    some += ["straße ÿacht Ñandú, Élan. naïve! ×x. x×. a÷, ß. öÖ ça; don't. DON'T. 's. l'été: x... y.. z., \u00e9. e\u0301. e\u0301"]
    some += [r["text"] for r in docs_of()]
    got = list(tokens.encoded([t.encode() for t in some], tokens.tokenizer_path()))
    for text, ids in zip(some, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)


def test_length_curve(docs, rows, odd, empty, tokenizer):
    curve = token_counts.length_curve(token_counts.length_histogram(docs))
    lengths = [len(ids_of(tokenizer, t)) for t in rows.values()]
    found = {r["length"]: r for r in curve.collect()}
    assert set(found) == set(lengths)
    for n, r in found.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["docs_to"] == sum(x <= n for x in lengths) and r["tokens_to"] == sum(x for x in lengths if x <= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [1, 100, 333, 2048, 10**6]
    for r in token_counts.truncated_totals(curve, limits).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in lengths)
        assert r["total_tokens"] == sum(lengths) and r["truncated_docs"] == sum(x > r["context_limit"] for x in lengths)
    ordered = sorted(lengths)
    for r in token_counts.length_quantiles(curve, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == ordered[int(np.ceil(r["share"] * len(ordered) - 1e-9)) - 1]
    assert token_counts.length_histogram(odd).agg(F.sum("n_docs")).first()[0] == odd.count()
    none = token_counts.length_curve(token_counts.length_histogram(empty))
    assert none.count() == 0
    assert token_counts.truncated_totals(none, [5]).first()["total_tokens"] == 0


# 1


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_banded_alignment_equals_whole_table():
    random.seed(1)
    for _ in range(4000):
        kinds = random.choice([2, 3, 8])
        a = [random.randrange(kinds) for _ in range(random.randrange(14))]
        b = list(a) if random.random() < 0.6 else [random.randrange(kinds) for _ in range(random.randrange(14))]
        for _ in range(random.randrange(5)):
            b.insert(random.randrange(len(b) + 1), random.randrange(kinds))
        most = random.randrange(9)
        assert near_dups.alignment_distance(a, b, most) == min(edit_distance(a, b), most + 1)


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_classes(texts):
    split = {k: near_dups.words(t) for k, t in texts.items()}
    keys = sorted(split)
    pairs = [
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]
        if (near_dups.alike(split[a], split[b]) if split[a] and split[b] else texts[a] == texts[b])
    ]
    return classes(pairs, keys)


def test_word_counts_bound_edits_from_below():
    rng = random.Random(5)
    for vocabulary in (3, 40, 4000):
        for _ in range(60):
            a = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(1, 700))]
            b = [w if rng.random() < 0.8 else str(rng.randrange(vocabulary)) for w in a][rng.randrange(3) :]
            one, other = (near_dups.word_counts(np.array([hash(w) & 0xFFFFFFFF for w in x], np.uint64)) for x in (a, b))
            bound = near_dups.least_edits(one, other[None])[0]
            assert abs(len(a) - len(b)) * (vocabulary > 40) <= bound <= near_dups.alignment_distance(a, b, max(len(a), len(b)))


def test_spanning_forest_joins_what_pairs_join():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (5, 4), (40, 30), (60, 900)):
        first, second, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 3, m)
        group = rng.integers(0, max(1, n // 2), n)

        def parts(places, group=group, first=first, second=second):
            of = group.copy()
            for p in places:
                x, y = of[first[p]], of[second[p]]
                of[of == max(x, y)] = min(x, y)
            return of

        chosen = near_dups.spanning_forest(first, second, weight, group)
        assert (parts(chosen) == parts(range(m))).all()
        assert len(chosen) == len(set(group)) - len(set(parts(range(m))))


def test_near_duplicates_equal_all_pairs(docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_large_groups_lose_no_link(spark):
    """A chain whose ends aren't alike, a large group, and texts that share one passage; small blocks force every path."""
    random.seed(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = random.choices(vocabulary, k=200)
    texts, passage = {}, random.choices(vocabulary, k=120)
    for i in range(60):
        own = list(base)
        for at in random.sample(range(200), 3):
            own[at] = random.choice(vocabulary)
        texts[i] = " ".join(own)
    chain = random.choices(vocabulary, k=100)
    for i in range(100, 110):
        chain[10 * (i - 100) : 10 * (i - 100) + 9] = random.choices(vocabulary, k=9)
        texts[i] = " ".join(chain)
    for i in range(200, 230):
        texts[i] = " ".join(random.choices(vocabulary, k=40) + passage + random.choices(vocabulary, k=40))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df, bucket_texts=4).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("bucket_texts", [30, 8])
def test_crowded_buckets_are_dealt_once_for_each_rare_word(spark, monkeypatch, bucket_texts):
    """A passage in 44 texts makes many buckets of the same texts: two blocks aren't cut; more are, by a row for each word of a text."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(100)]
    texts = {i: " ".join([*(f"v{rng.randrange(9000)}" for _ in range(40)), *passage]) for i in range(44)}
    tables, old = {}, near_dups.Scratch.stored

    def stored(self, df, name, codec=None):
        back = old(self, df, name, codec)
        if name in ("cut", "crowded"):
            tables[name] = back.count()
        return back

    monkeypatch.setattr(near_dups.Scratch, "stored", stored)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df, bucket_texts=bucket_texts).collect()}
    assert got == bucket_classes(texts)
    rare = 44 * (int(140 * 0.2 + 1e-9) + 1)
    members = 44 * near_dups.SKETCHES  # of buckets that aren't cut
    assert tables == {} if bucket_texts == 30 else tables["crowded"] and tables["cut"] <= rare + members


def bucket_classes(texts):
    """Classes by all pairs that agree in at least one sketch and are alike."""
    split = {k: near_dups.words(t) for k, t in texts.items()}
    sketches = {}
    for k, own in split.items():
        hashes = np.array([near_dups.xxhash.xxh3_64_intdigest(w.encode()) for w in own], np.uint64)
        sketches[k] = near_dups.order_min_hash(near_dups.labelled_shingles(hashes))
    keys = sorted(split)
    return classes(
        [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (sketches[a] == sketches[b]).any() and near_dups.alike(split[a], split[b])], keys
    )


def test_near_duplicates_of_spread_edits_lose_no_pair_of_a_bucket(spark):
    """Families of 20 texts of 100 words in chains of which each step edits 5 to 15 % of the words, one by one."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = {}
    for family in range(12):
        last = rng.choices(vocabulary, k=100)
        for i in range(20):
            own = list(last)
            for at in rng.sample(range(100), 5 + family % 11):
                own[at] = rng.choice(vocabulary)
            texts[100 * family + i] = " ".join(own)
            if i % 2:
                last = own
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert got == bucket_classes(texts)


def edited(own, edits, rng):
    own = list(own)
    for at in rng.sample(range(len(own)), edits):
        own[at] = f"e{rng.randrange(10**6)}"
    return own


def test_near_duplicates_try_every_leader(spark):
    """Texts alike to one leader of a class but not to its least one; then one such text alone, where the least leaders link nothing."""
    rng, texts = random.Random(9), {}
    for i in range(120):
        middle = rng.choices(range(5000), k=100)
        for j, own in enumerate((middle, edited(middle, 10, rng), edited(middle, 12, rng))):
            texts[3 * i + j] = " ".join(map(str, own))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()} == bucket_classes(texts)

    def alone(seed):
        rng = random.Random(seed)
        own = [str(rng.randrange(5000)) for _ in range(100)]
        trio = [own[:60] + [str(rng.randrange(5000)) for _ in range(60)], edited(own, 10, rng), own]
        keys = [near_dups.xxhash.xxh3_128_digest(" ".join(x).encode()) for x in trio]
        hashes = [np.array([near_dups.xxhash.xxh3_64_intdigest(w.encode()) for w in x], np.uint64) for x in trio]
        first, second, text = (near_dups.order_min_hash(near_dups.labelled_shingles(x)) for x in hashes)
        fits = keys == sorted(keys) and (first == text).any() and (first == second).any() and 0 < ((second == text) & (first != text)).sum() and (second == text).sum() < 5
        return {i: " ".join(x) for i, x in enumerate(trio)} if fits else None

    texts = next(filter(None, map(alone, range(10_000))))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 1}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(r["class_id"])
    assert found[1] == found[2] == {1} and found[3] == found[4] == {3} and found[5] == {5} and found[6] == {6}
    assert found[7] == {7} and found[8] == {8} and found[None] == {1, 5}
    kept = near_dups.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]
    assert Counter(r["class_id"] for r in got if r["kept"]) == dict.fromkeys([1, 3, 5, 6, 7, 8, 9, 10], 1)
    assert near_dups.near_duplicates(empty).count() == 0 and near_dups.keep_one(empty).count() == 0


# 3


def rake_by_numpy(cells, rounds, temperature):
    w = {c: float(n) for c, n in cells.items()}
    total = sum(w.values())
    targets = []
    for m in range(3):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[m]] += n
        shares = {k: v**temperature for k, v in sums.items()}
        targets.append({k: total * v / sum(shares.values()) for k, v in shares.items()})
    for _ in range(rounds):
        for m in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[m]] += x
            w = {c: x * targets[m][c[m]] / now[c[m]] for c, x in w.items()}
    return w, targets


def test_raking_and_calibration(docs):
    table = mixing.probabilities(docs).collect()
    cells = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in table}
    want, targets = rake_by_numpy(cells, 60, mixing.TEMPERATURE)
    for r in table:
        assert r["weight"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], rel=1e-9)
    for m, margin in enumerate(mixing.MARGINS):
        sums = defaultdict(float)
        for r in table:
            sums[r[margin]] += r["weight"]
        for k, v in targets[m].items():
            assert sums[k] == pytest.approx(v, rel=1e-6)
    assert all(r["gap"] <= mixing.TOLERANCE for r in table)
    few, many = ({(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.probabilities(docs, rounds=2, few_cells=n).collect()} for n in (10**5, 0))
    assert few == pytest.approx(many)
    assert sum(r["tokens"] * r["probability"] for r in table) == pytest.approx(mixing.BUDGET * sum(cells.values()), rel=1e-9)
    certain = [r for r in table if r["probability"] == 1]
    part = next(r for r in table if r["probability"] < 1)
    scale = part["probability"] * part["tokens"] / part["weight"]
    assert all(scale * r["weight"] / r["tokens"] >= 1 - 1e-9 for r in certain)


def test_given_targets_and_odd_rows(docs, odd, empty):
    asked = {"lang": {"en": 0.25, "fr": 0.25, "de": 0.5}}
    found = defaultdict(float)
    table = mixing.probabilities(docs, targets=asked, rounds=24)
    for r in table.collect():
        found[r["lang"]] += r["weight"]
    total = table.agg(F.sum("tokens")).first()[0]
    assert found["de"] / total == pytest.approx(0.5, rel=1e-3) and found["es"] == 0
    apart = docs.limit(2).withColumns({"source": F.col("doc_id").cast("string"), "lang": F.col("doc_id").cast("string")})
    unmet = mixing.probabilities(apart, targets={"source": {str(r["doc_id"]): 0.5 for r in apart.collect()}, "lang": {str(apart.first()["doc_id"]): 1.0}}, rounds=3)
    assert unmet.first()["gap"] == pytest.approx(0.5)
    got = mixing.mix(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    assert all(not r["kept"] for r in got.where("n_tokens = 0").collect())
    clash = odd.withColumns({c: F.lit("x") for c in ("topic", "n_tokens", "probability", "kept")})
    assert sorted(map(str, mixing.mix(clash).select("doc_id", "kept").collect())) == sorted(map(str, got.select("doc_id", "kept").collect()))
    assert mixing.mix(empty).count() == 0


# 4


def test_quality_on_held_out_rows(spark, odd, empty):
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(large, labels)
    scored = quality.score_documents(large, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    common = max(Counter(r["quality"] for r in scored).values())
    assert right >= common and right / len(scored) > 0.9
    again = quality.score_documents(odd, model, tuple(odd.columns)).collect()
    assert len(again) == odd.count() and all(0 <= r["score"] <= 1 for r in again)
    assert quality.score_documents(empty, model).count() == 0


def test_quality_score_equals_the_plain_forward_pass():
    settings = quality.Settings(buckets=1 << 12, epochs=3)
    good = [f"plain words in order {i} and more of them".encode() for i in range(40)]
    bad = [f"BUY!! {i} NOW!! $$$ NOW!!".encode() for i in range(40)]
    model = quality.train(good + bad, [1] * 40 + [0] * 40, settings)
    for text in [*good[:3], *bad[:3], b"", b"x"]:
        found, counts = quality.features(quality._Words(settings), text)
        share = counts / counts.sum()
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-float(share @ model.shares[found]))), rel=1e-4)
    assert model.score(good).min() > 0.8 and model.score(bad).max() < 0.2
    assert quality.train([], [], settings).score([b"a"])[0] == 0.5


# 5


def brute_edits(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for i, key in enumerate(order):
        own, following = texts[key] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        out[key] = own[: len(own) - half] + following[:half]
    return out


def test_edited_texts(docs, rows):
    want = brute_edits(rows)
    got = fingerprints.against_edits(docs).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for r in got:
        assert r["edited"] == want[r["doc_id"]] and r["n_chars"] == len(rows[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[rows[r["doc_id"]]].add(tuple(r["wide"]))
        by_text[r["edited"]].add(tuple(r["edited_wide"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.2


def test_fingerprints_add_and_take_away(spark):
    df = spark.createDataFrame([("a\nb. c\nd", "d\na\nc\nb.", "a\nb.", "c\nd")], "x string, y string, p string, q string")
    for c in "xypq":
        df = fingerprints.with_fingerprint(df, F.col(c), c)
    got = df.select("*", fingerprints.combined(F.col("pwide"), F.col("qwide")).alias("s"), fingerprints.combined(F.col("xwide"), F.col("qwide"), True).alias("d")).first()
    assert got["xwide"] == got["ywide"] == got["s"] and got["d"] == got["pwide"] and got["xsigns"] == got["ysigns"]


def test_fingerprints_of_odd_rows(odd, empty, spark):
    got = fingerprints.against_edits(odd).collect()
    assert len(got) == odd.count()
    assert all((r["edited"] is None) == (r["doc_id"] is None) for r in got)
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    want = brute_edits(texts)
    assert all(r["edited"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert fingerprints.against_edits(empty).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("pieces", "wide", "signs", "id", "slot", "given", "edited", "n_chars", "next_id")})
    assert sorted(map(str, fingerprints.against_edits(clash).collect())) == sorted(map(str, got))
    alone = fingerprints.against_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["edited"] == "abab" and alone["near_next"] == 1


# 6

BASE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = BASE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, v) for p, v in licenses.BASE.items() for n in [len(p.split())] for i in range(len(words)) if words[i : i + n] == p.split()]
    return len(words), sorted(places)


def test_license_base_scan(docs, rows, odd, empty):
    got = licenses.scan(docs)
    some = 0
    for r in got.collect():
        n, places = brute_base(rows[r["doc_id"]])
        assert r["n_words"] == n and sorted((b["start"], b["label"]) for b in r["base"]) == places
        some += bool(places)
    assert some
    for r in licenses.scan(odd, tuple(odd.columns)).collect():
        n, places = brute_base(r["text"])
        assert r["n_words"] == n and sorted((b["start"], b["label"]) for b in r["base"]) == places
    clash = odd.withColumns({c: F.lit("x") for c in ("n_words", "base", "found", "suppressed")})
    again = licenses.scan(clash, tuple(clash.columns))
    assert len(set(again.columns)) == len(again.columns) and dict(again.dtypes)["n_words"] == "bigint"
    assert licenses.summarised(licenses.scan(empty)).count() == 0


def test_license_rules_resolve_overlaps(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Released under the MIT License": "mit",
        "CC BY-NC 4.0": "cc-by,cc-by-nc",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
        "GNU General Public License version 3, and mit license": "gpl,gpl-3,mit",
        "gnu lesser general public license": "lgpl",
        "no license here": "",
        "apache license apache license": "apache",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in licenses.summarised(licenses.scan(df, ("text", "want")), ("text", "want")).collect():
        assert r["labels"] == r["want"], r
    more = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "Licensed under MIT.": "mit",
        "Licensed under the GPL": "gpl", "see https://creativecommons.org/licenses/by-sa/4.0/ for it": "cc-by-sa", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of it": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published": "gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3",
        "no fee may be charged; any work is free": "", "All rights reserved.": "proprietary",
    }
    df = spark.createDataFrame(list(more.items()), "text string, want string")
    for r in licenses.summarised(licenses.scan(df, ("text", "want")), ("text", "want")).collect():
        assert r["labels"] == r["want"], r
    many = spark.createDataFrame([("mit license " * 5000,)], "text string")
    r = licenses.summarised(licenses.scan(many, ()), ()).first()
    assert r["n_base"] == 5000 and r["first_word"] == 0 and r["last_word"] == 9998 and r["labels"] == "mit"


def brute_detections(text, rules):
    """Every rule at every word, then the rules of suppression on all pairs."""
    words = BASE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = set()
    for i, w in enumerate(words):
        window = " ".join(words[i : i + licenses.SPAN])
        for r in rules:
            if r.keyword == w and (m := re.match(r.pattern, window, re.ASCII)):
                found.add((i, i + len(m[0].split(" ")), r.label, r.rank, r.weight))

    def over(e, d):
        longer = e[1] - e[0] > d[1] - d[0]
        return e[0] <= d[0] and e[1] >= d[1] and ((longer and e[3] >= d[3]) or (not longer and (e[3] > d[3] or (e[3] == d[3] and e[2] < d[2]))))

    return sorted(d for d in found if not any(over(e, d) for e in found if e != d))


def test_license_labels_equal_a_plain_interpreter(spark, docs, rows):
    rules = licenses.signatures()
    assert len({r.pattern for r in rules}) == len({(r.pattern, r.label) for r in rules}) > 800
    assert all(re.match(r.pattern, x) is None or x.startswith(r.head) for r in rules for x in ("licensed under mit", "cc by sa 4 0"))
    rng = random.Random(1)
    bits = sorted({w for r in rules for w in re.findall("[a-z0-9]+", r.pattern)})
    phrases = [p for t in (license_rules.NOTICES, license_rules.SHORT, license_rules.TITLES, license_rules.IDENTIFIERS) for own in t.values() for p in own if not re.search(r"[^a-z0-9 ]", p)]
    texts = [" ".join(rng.choice([rng.choice(phrases), rng.choice(phrases), "licensed under the", "spdx license identifier", rng.choice(bits)]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [t for t in rows.values() if t and "icen" in t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = 0
    for r in licenses.scan(df).collect():
        want = brute_detections(texts[r["doc_id"]], rules)
        assert sorted((d["start"], d["stop"], d["label"], d["rank"], d["weight"]) for d in r["found"]) == want
        some += len(want)
    assert some > 500


# 7


def check_packed(got, texts, tokenizer, capacity):
    """texts: (doc_id, text) of every row. Returns the number of sequences."""
    want = Counter()
    for key, text in texts:
        ids = ids_of(tokenizer, text)
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[key, i, at, len(part), crc(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, rows, odd, empty, tokenizer):
    got = packing.pack(docs).collect()
    used = check_packed(got, rows.items(), tokenizer, packing.CAPACITY)
    assert used <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1
    for capacity in (64, 50, 7):
        check_packed(packing.pack(odd, capacity=capacity).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], tokenizer, capacity)
    assert packing.pack(empty).count() == 0


def test_patterns_at_an_uneven_capacity():
    plan = packing._Plan({n: 100 for n in range(1, 1001)}, 1000)
    plan.by_patterns(packing.GRID, packing.PARTS, packing.LEAST)
    assert sum(run[2] for run in plan.runs) > 20_000
    runs = packing.plan_runs({n: 100 for n in range(1, 1001)}, 1000)
    assert runs[:, 2].sum() == 100_000 and (runs[:, 3] + runs[:, 2]).max() <= 1.05 * 100 * sum(range(1, 1001)) / 1000


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_once(seed):
    random.seed(seed)
    histogram = {n: random.randrange(1, 2000) for n in random.sample(range(1, 4097), random.choice([1, 5, 300]))}
    runs = packing.plan_runs(histogram)
    filled = Counter()
    for n in histogram:
        at = 0
        for _, rank, count, first, _ in sorted(map(tuple, runs[runs[:, 0] == n]), key=lambda r: r[1]):
            assert rank == at
            at += count
            filled.update({s: n for s in range(first, first + count)})
        assert at == histogram[n]
    assert max(filled.values()) <= 4096


def test_non_negative_fit():
    a, x = np.random.default_rng(1).random((20, 60)), np.zeros(60)
    x[[3, 17, 40]] = 2, 5, 1
    got = packing.fit_non_negative(a, a @ x)
    assert got.min() >= 0 and np.abs(a @ got - a @ x).max() < 1e-6


# 8


def test_exact_search(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    codes = {i: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for i in range(600)}
    codes |= {i: centres[0] for i in range(600, 900)}
    signed = {i: c - (1 << 64) if c >> 63 else c for i, c in codes.items()}
    df = spark.createDataFrame([*signed.items(), (None, 5), (1000, None), (7, signed[7])], "id long, code long")
    got = defaultdict(list)
    for r in binary_search.nearest(df, df.where("id % 20 = 0"), 10, part_codes=100, block_queries=16).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["neighbour_id"]))
    assert set(got) == {i for i in codes if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:10]
        assert sorted(found) == [(n, *x) for n, x in enumerate(want, 1)]
    clash = df.withColumns({c: F.lit("x") for c in ("ids", "part", "block", "rank", "n", "distance", "neighbour_id", "query_id")})
    assert binary_search.nearest(clash, clash.where("id = 40"), 3).count() == 3
    none = df.where("false")
    assert binary_search.nearest(none, none, 10).count() == 0
    few = df.where("id in (20, 40, 61)")
    assert binary_search.nearest(few, few.where("id % 20 = 0"), 10).count() == 4


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), ([0.0] * 63 + [2.0],), (None,), ([],), ([1.0] + [0.0] * 63 + [-2.0],)], "e array<float>")
    assert [r[0] for r in df.select(binary_search.code_of(F.col("e"))).collect()] == [5, -(1 << 63), None, None, 0]


# 9


def brute_lines(texts, least=10):
    """texts: (doc_id, text) of every row."""
    fold = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for key, text in texts:
        for line in (text or "").split("\n"):
            where[fold(line)].add((key, text))
    out = Counter()
    for key, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not fold(x) or len(where[fold(x)]) < least]
        out[key, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, rows, odd, empty, least):
    got = line_dedup.drop_common_lines(docs, least).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(list(rows.items()), least)
    got = line_dedup.drop_common_lines(odd, least)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()], least)
    clash = odd.withColumns({"n_lines": F.lit("x"), "n_dropped": F.lit("x")})
    assert line_dedup.drop_common_lines(clash, least).where("n_lines >= 1 and n_dropped >= 0").count() == odd.count()
    assert line_dedup.drop_common_lines(empty).count() == 0


# 10


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, m in ((0, 5), (1, 1), (1000, 50_000), (3000, 7), (700, 1 << 31)):
        x = rng.integers(0, m, n).astype(np.uint32)
        _, _, w = wavelet.read_shard(wavelet.write_shard([1, None], [n // 2, n - n // 2], x))
        assert (w.decode() == x).all()
        assert all(w.access(i) == x[i] for i in range(0, n, 37))
        for v in {0, 3, int(x[0]) if n else 1}:
            assert w.occurrences(v) == np.flatnonzero(x == v).tolist()
            assert w.rank(v, n // 2) == (x[: n // 2] == v).sum() and w.select(v, n + 1) == -1
    with pytest.raises(IndexError):
        w.access(700)
    with pytest.raises(ValueError):
        wavelet.read_shard(b"x" * 100)


def test_token_files_round_trip(spark, docs, rows, odd, empty, tokenizer):
    path = wavelet.write_ids(docs, shard_tokens=5000)
    got = {r["doc_id"]: r for r in wavelet.read_documents(spark, path).collect()}
    start, everything = 0, []
    for key in sorted(rows):
        ids = ids_of(tokenizer, rows[key])
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
        everything.append((key, ids))
    counts = Counter(x for _, ids in everything for x in ids)
    asked = [1, *list(counts)[:5], 49_000]
    assert {r["id"]: r["n"] for r in wavelet.id_counts(spark, path, asked).collect()} == {x: counts[x] for x in asked}
    rare = min(counts, key=counts.get)
    assert sorted(map(tuple, wavelet.id_places(spark, path, rare).collect())) == [(k, i) for k, ids in everything for i, x in enumerate(ids) if x == rare]
    again = wavelet.read_documents(spark, wavelet.write_ids(odd)).collect()
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in again) == Counter((len(ids_of(tokenizer, r["text"])), crc(ids_of(tokenizer, r["text"]))) for r in odd.collect())
    assert wavelet.read_documents(spark, wavelet.write_ids(empty)).count() == 0


def test_memo_forgets_what_is_not_asked_for(rows, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 40)
    memo, chunks = tokens._Memo(tokenizer), [c for t in rows.values() for c in (t or "").encode().split()][:3000]
    for i, chunk in enumerate(chunks):
        assert memo[b"the"] + memo[chunk] == b"".join(np.array(tokenizer.encode(c.decode(), add_special_tokens=False).ids, "<u4").tobytes() for c in (b"the", chunk))
        assert len(memo) <= 22 and (i < 100 or memo.before), "two halves, and a chunk's parts"


def test_workers_remember_for_one_operator_at_a_time():
    """A worker of the pipeline that has hashed, and encoded, words forgets them as it begins to score."""
    from types import SimpleNamespace

    near_dups.word_hashes(["one", "two"])
    assert near_dups._hashes
    list(tokens.encoded([b"one two"], tokens.tokenizer_path()))
    assert not near_dups._hashes and tokens._memos[-1]
    shared = SimpleNamespace(value=(quality.Settings(), np.zeros(quality.Settings().buckets, np.float32)))
    assert quality._received(shared).score([b"one two"]) == [0.5]
    assert not tokens._memos[-1] and quality._last[0] is not None
    near_dups.word_hashes(["one"])
    assert quality._last[0] is None and not quality._models


def test_other_tokenizers_encode_whole_texts(rows):
    import json

    from tokenizers import Tokenizer

    made = json.load(open(tokens.tokenizer_path()))
    assert tokens.parts_at_space(made)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"post_processor": {"type": "x"}}):
        assert not tokens.parts_at_space(made | change)
    other = tokens.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(other)
    encode = tokens.encoder(other)
    for text in [*list(rows.values())[:40], "  two  blanks ", ""]:
        assert encode(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# queries


def xx(value: bytes, seed: int) -> int:
    """Spark's xxhash64 of (seed, value)."""
    import struct

    import xxhash

    return xxhash.xxh64_intdigest(value, xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))


def plain_fingerprint(text):
    """``(wide, pieces, signs)`` lane by lane."""
    pieces = re.split(fingerprints.PIECE_ENDS, text)
    wide = []
    for seed in fingerprints.WIDE_SEEDS:
        hashes = [xx(p.encode(), seed) for p in pieces]
        wide += [sum(h & 0xFFFFFFFF for h in hashes) % 2**32, sum(h >> 32 for h in hashes) % 2**32]
    counts = []
    for seed in fingerprints.SIGN_SEEDS:
        hashes = [xx(p.encode(), seed) for p in pieces]
        counts += [(sum(h >> i & 1 for h in hashes), sum(h >> (32 + i) & 1 for h in hashes)) for i in range(32)]
    return wide, len(pieces), counts


def plain_likeness(a, b):
    x = [2 * c - a[1] for lane in a[2] for c in lane]
    y = [2 * c - b[1] for lane in b[2] for c in lane]
    apart, both = sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), sum(p * p + q * q for p, q in zip(x, y, strict=True))
    return max(0.0, min(1.0, 1 - apart / max(both, 1)))


def digits(print_):
    wide, n, counts = print_
    return "".join(f"{x:08x}" for x in wide) + f"{n:016x}" + "".join(f"{low + (high << 32):016x}" for low, high in counts)


def test_op5_query_equals_plain_python(spark, rows):
    edits, order = brute_edits(rows), sorted(rows, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    prints = {k: plain_fingerprint(t) for k, t in rows.items()}
    df = queries.op5_fingerprints(spark, SF)
    for r in df.collect():
        edited = plain_fingerprint(edits[r["doc_id"]])
        assert r["n_chars"] == len(rows[r["doc_id"]]) and r["edited_sha256"] == hashlib.sha256(edits[r["doc_id"]].encode()).hexdigest()
        assert r["fingerprint"] == digits(prints[r["doc_id"]]) and r["edited_fingerprint"] == digits(edited)
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[r["doc_id"]], edited))
        assert r["near_next"] == pytest.approx(plain_likeness(prints[r["doc_id"]], prints[following[r["doc_id"]]]))
    back = df.select("near_edited", fingerprints.read_text(F.col("fingerprint")).alias("a"), fingerprints.read_text(F.col("edited_fingerprint")).alias("b"))
    again = back.select("near_edited", fingerprints.likeness(F.col("a.signs"), F.col("a.pieces"), F.col("b.signs"), F.col("b.pieces")).alias("again"))
    assert all(r["again"] == pytest.approx(r["near_edited"]) for r in again.collect())


def test_op4_query_keeps_its_contract(spark, rows):
    got = queries.op4_quality_classifier(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_learns_nothing_from_held_out_labels(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = quality.fit(docs, labels), quality.fit(docs.union(docs), turned)
    assert (first.shares == second.shares).all()
    few = quality.fit(docs, labels, settings=quality.Settings(sample_rows=20, epochs=1, buckets=1 << 10))
    assert few.score([b"x"])[0] != 0.5 and (quality.fit(docs, labels.where("false")).score([b"", b"x"]) == 0.5).all()


def test_op7_and_op10_queries_keep_their_contract(spark, rows, tokenizer):
    check_packed(queries.op7_packing(spark, SF).collect(), rows.items(), tokenizer, 4096)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_files(spark, SF).collect()}
    start = 0
    for key in sorted(rows):
        ids = ids_of(tokenizer, rows[key])
        assert got[key] == (start, len(ids), crc(ids))
        start += len(ids)


def test_op1_query_names_one_row_of_each_class(spark, rows):
    got = queries.op1_near_duplicates(spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


@pytest.mark.parametrize(("kind", "least"), [("replaced", 0.9), ("inserted", 0.9), ("dropped", 0.9), ("moved", 0.9)])
def test_near_duplicates_recall_at_the_threshold(spark, kind, least):
    """Pairs of 200 words with about a fifth of the words edited at random, which are links: nine in ten share a class."""
    rng, texts, links = random.Random(kind), {}, 0
    while links < 120:
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(own)
        for _ in range(38 if kind == "replaced" else 36 if kind == "dropped" else 44 if kind == "inserted" else 19):
            at = rng.randrange(len(other))
            if kind == "replaced":
                other[at] = f"e{rng.randrange(10**6)}"
            elif kind == "inserted":
                other.insert(at, f"e{rng.randrange(10**6)}")
            else:
                word = other.pop(at)
                if kind == "moved":
                    other.insert(rng.randrange(len(other)), word)
        if near_dups.alike(own, other):
            texts[2 * links], texts[2 * links + 1] = " ".join(own), " ".join(other)
            links += 1
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(links)) >= least * links


def test_rare_words_are_shared_by_links():
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(600)]
    rarity = np.random.default_rng(3).integers(0, 50, 997)
    for _ in range(400):
        own = rng.choices(vocabulary, k=rng.randrange(1, 120))
        other = [w for w in own if rng.random() < 0.93]
        for _ in range(rng.randrange(12)):
            other.insert(rng.randrange(len(other) + 1), rng.choice(vocabulary))
        if other and near_dups.alike(own, other):
            a, b = (set(near_dups.rare_words(near_dups.word_hashes(x), rarity).tolist()) for x in (own, other))
            assert a & b


def test_words_equal_one_pattern():
    rng = random.Random(2)
    alphabet = "aZ09_-. \n\u00a0éßÀ²¼ªµ\u0301İKſǅ字"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert near_dups.words(text) == near_dups._ANY_WORD.findall(text.lower())


# pipeline


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert stage(spark, empty, SF).count() == 0, name
        n = got.count()
        if name == "best-fit packing":
            assert n >= odd.count()
        else:
            assert got.columns == list(("doc_id", "text", "lang", "source", "n_chars")) and n <= odd.count(), name


def test_pipeline_equals_brute_force(spark, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, SF)
    assert kept.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(rows, model.score([t.encode() for t in rows.values()]), strict=True))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {k: t for k, t in rows.items() if score[k] >= 0.3}
    kept.write.mode("overwrite").parquet(where := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/kept")
    kept = corpus_pipeline.line_filter(spark, spark.read.parquet(where), SF)
    lines = {k: t for k, _, _, t in brute_lines(list(texts.items()))}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == lines and all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    kept = corpus_pipeline.near_duplicate_filter(spark, kept, SF)
    alone = {k for k, v in brute_classes(lines).items() if k == v}
    assert {r["doc_id"] for r in kept.collect()} == alone
    drawn = {r["doc_id"] for r in corpus_pipeline.source_mixing(spark, kept, SF).collect()}
    assert drawn < alone
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == drawn
    assert hashlib.md5(b"1").hexdigest()[:8] == "c4ca4238"
