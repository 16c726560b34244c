"""Operators on documents against brute force, and on nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from queuescope.llm import bpe, lattice, mixing, quality, quality_rules, simhash, toxicity
from queuescope.llm.compression import surroundings, telling_runs, train_sizes, train_windows, windows_of
from queuescope.session import materialize

from .plain import WORD, classes, plain_fingerprint

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

ODD = [
    (0, None, None), (1, "", "a"), (2, " \t\n", "a"), (3, "word", "b"), (4, "word", "b"), (4, "word", "b"),
    (None, "no key at all here", "b"), (5, "x" * 30_000, None), (6, "tail " * 6000, "c"), (7, "ÄÖ é <|endoftext|> 日本 🎉 q", "c"),
    (8, "a b c d a b c d a b c e\n\n a line\n a line\nother", "a"), (9, "# * $ % & | < > !", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, s, 7, 0.5, True, "w", 1) for k, t, s in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, score double, kept boolean, words string, size int"
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (3, None, 1), (4, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def none_of(spark, df):
    return spark.createDataFrame([], df.schema)


# ------------------------------------------------------------------------------------------------- compression (1, 8)


def ranked_right(scores, truth):
    good, bad = [s for s, t in zip(scores, truth) if t], [s for s, t in zip(scores, truth) if not t]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifiers_tell_held_out_rows_apart(spark, operator, label, least):
    docs, marks = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    found = operator.classify(docs, marks).join(marks, "doc_id").where("held_out").select("score", label).collect()
    assert ranked_right([r["score"] for r in found], [r[label] for r in found]) > least


def test_toxicity_is_found_in_more_than_one_language(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.where("crc32(cast(doc_id as string)) % 3 = 1").join(marks.where("toxic is not null"), "doc_id")
    scored = rows.select("lang", "toxic", toxicity.score_column(toxicity.train(docs, marks), rows["text"]).alias("s"))
    found = scored.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 0.7).alias("hits")).collect()
    hits, n = ({(r["lang"], r["toxic"]): r[c] for r in found} for c in ("hits", "n"))
    total = {k: (sum(h for (_, t), h in hits.items() if t == k), sum(c for (_, t), c in n.items() if t == k)) for k in (0, 1)}
    assert total[1][0] >= 0.75 * total[1][1] and total[0][0] <= 0.02 * total[0][1]
    assert all(hits[lang, 1] >= share * n[lang, 1] for lang, share in (("en", 0.85), ("de", 0.85), ("fr", 0.5), ("es", 0.25)))


def test_shared_passages_and_repeated_words_count_once():
    copies = [b"the day was vile today".split()] * 50
    assert set(surroundings(copies)[0].values()) == {1}
    assert surroundings([b"vile a vile b vile c vile d".split()])[0][b"vile"] == 1
    apart = surroundings([f"w{i} vile, x{i}".encode().split() for i in range(7)])[0]
    assert apart[b"vile"] == 7 and apart[b"w3"] == 1
    told, other = surroundings(copies, [b"the day was kind today".split()] * 3)
    assert told[b"vile"] == 50 and told[b"today"] == 1 and other[b"kind"] == 3 and b"vile" not in other
    assert surroundings([], [[]]) == [{}, {}]


def test_runs_grow_until_they_tell():
    # "qabcde" and "bcdef" are in many ordinary words, both together are not
    ends = [b"", b"x", b"yy", b"zzz"]
    ordinary = {b"qabcde" + e: 300 for e in ends} | {b"bcdef" + e: 300 for e in ends} | {b"plain": 2000}
    marked = {b"qabcdef" + e: 10 for e in ends} | {b"plain": 20}
    found = telling_runs(Counter(marked), Counter(ordinary))
    assert b"abcdef" in found and b"abcde" not in found
    assert not any(r in b" %s " % w for r in found for w in ordinary)
    assert telling_runs(Counter(), Counter(ordinary)) == set()


def test_copies_of_a_toxic_text_do_not_mark_its_ordinary_words():
    sample = [(1, f"seldom heard marmalade kettles wobble gently {i}") for i in range(60)]  # near copies
    sample += [(1, f"n{i} vile{i % 3} m{i}") for i in range(60)] + [(0, f"n{i} kind{i % 3} m{i}") for i in range(400)]
    model = train_windows(sample)
    gains = model.gains()
    assert model.score(gains, "n1 vile1 m1") > model.score(gains, "the marmalade") == model.score(gains, "the something")


def test_window_scores_equal_a_plain_version():
    sample = [(i % 5 == 0, f"n{i} {'vile' if i % 5 == 0 else 'kind'}{i % 3} m{i}") for i in range(300)]
    model = train_windows([(int(y), t) for y, t in sample])
    kept = model.gains()
    for text in ("", "vile1 vile1 kind2 other", "n1 " * 300 + "vile2"):
        savings = Counter()
        for word, times in Counter(windows_of(text)).items():
            savings[model.gains()[word]] += 1 + math.log(times)
        evidence = sum(model.weights[g + 1] * c for g, c in savings.items()) / math.sqrt(1 + sum(savings.values()) / 100)
        plain = 1 / (1 + math.exp(-(model.slope * evidence + model.intercept)))
        assert model.score(kept, text) == pytest.approx(plain) == pytest.approx(model.score(kept, text))


@pytest.mark.parametrize("operator, predicted", [(toxicity, 0), (quality, 1)])
def test_classifiers_take_any_rows(spark, odd, labels, operator, predicted):
    rows = operator.classify(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(r["score"] == 0.5 and r["predicted"] == predicted for r in rows)  # no class to learn from
    assert operator.classify(none_of(spark, odd), labels).count() == 0


def test_window_model_finds_marked_words_and_scores_any_text():
    sample = [(1, f"the day was fine and vile{i % 3} people said so {i}") for i in range(40)]
    sample += [(0, f"the day was fine and kind people said so {i}") for i in range(200)]
    model = train_windows(sample)
    gains = model.gains()
    assert model.score(gains, "fine people, the vile1 ones and vile2") > model.score(gains, "fine people, the kind ones")
    for text in ("", "x" * 100_000, "a " * 50_000, "\x00퟿"):
        assert 0 <= model.score(gains, text) <= 1
    assert train_windows(sample[:40]) is None and train_sizes([]) is None


# --------------------------------------------------------------------------------------------------------- simhash (3)


def test_near_duplicates_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = docs.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r["text"]) for r in rows]
        smallest = defaultdict(list)
        for r, c in zip(rows, classes(prints, 4)):
            smallest[c].append(r["doc_id"])
        wanted = Counter(
            (r["doc_id"], f"{p:016x}", min((d for d in smallest[c] if d is not None), default=None))
            for r, p, c in zip(rows, prints, classes(prints, 4))
        )
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == wanted


@pytest.mark.parametrize("bucket_rows", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for c in centres for _ in range(20)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = materialize(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3))
    edges = simhash.links(table, 4, bucket_rows)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = defaultdict(set)
    for p, c in zip(signed, classes(prints, 4)):
        groups[c].add(p)
    for group in groups.values():
        assert {found.get(p, p) for p in group} == {min(group)}
    assert sum(p.threshold + 1 for p in simhash.choose_partitions(table)) == 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 501)], "a long, b long")
    roots = dict(map(tuple, simhash.components(edges).collect()))
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_one_of_each_keeps_columns_and_rows_without_key(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 5, 6, 7, 8, 9] and ids.count(None) == 1
    assert simhash.near_duplicates(none_of(spark, odd)).count() == 0


def test_one_of_each_keeps_texts_not_keys(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(400)) for name in "abc")
    rows = [(1, a), (None, a), (3, a + " end"), (None, c), (None, c)] + [(3, b)] * 2 + [(5, b)]
    assert bin(plain_fingerprint(a) ^ plain_fingerprint(a + " end")).count("1") <= simhash.DISTANCE
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter(map(tuple, simhash.one_of_each(docs).collect())) == Counter([(1, a), (3, b), (None, c)])


def test_one_of_each_marks_texts_once(documents):
    plan = simhash.one_of_each(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


# ------------------------------------------------------------------------------------------------------------- bpe (4)


def test_token_ids_equal_the_library(documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    for docs in (documents, odd):
        texts = docs.select("doc_id", "text").collect()
        wanted = Counter()
        for r in texts:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
            wanted[(r["doc_id"], len(ids), *digest)] += 1
        assert Counter(map(tuple, bpe.round_trip(docs).collect())) == wanted


def test_ids_decode_to_the_text(spark, odd):
    spec = bpe.vocabulary(spark)
    ids = odd.select("text", bpe.encode_column(spec, F.col("text")).alias("ids"))
    for r in ids.select("text", bpe.decode_column(spec, F.col("ids")).alias("back")).collect():
        assert r["back"] == (r["text"] or "")
    assert bpe.encode(none_of(spark, odd)).count() == 0


def test_long_texts_are_encoded_in_parts():
    import public_tokenizers

    encoder = bpe.BytePairEncoder(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8").read())
    text = "some words to repeat, 123 and more. " * 70_000
    (ids,) = encoder.encode([text])
    assert len(text) > bpe.GROUP_CHARS and encoder.decode(ids) == text
    (short,) = encoder.encode([text[:36]])
    assert ids[: len(short) - 1] == short[:-1]


def test_encoding_many_texts_takes_little_memory(documents):
    import public_tokenizers

    encoder = bpe.BytePairEncoder(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8").read())
    texts = [r["text"] for r in documents.select("text").collect() if r["text"]] * 5
    tracemalloc.start()
    assert all(encoder.decode(ids) == text for text, ids in zip(texts, encoder.encode(texts)))
    learnt, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(map(len, texts)) > 2_000_000 and most - learnt < 16e6


# --------------------------------------------------------------------------------------------------- quality rules (5)


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, lines, len(covered)


def test_base_measures_equal_brute_force(documents, odd, labels):
    for docs in (documents, odd):
        wanted = Counter()
        for r in docs.select("doc_id", "text").collect():
            m = plain_measures(r["text"])
            wanted[(r["doc_id"], *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
        found = quality_rules.judge(docs, labels).collect()
        assert Counter(tuple(r)[:7] for r in found) == wanted
        assert all(r["kept"] == (not r["base_failed"]) for r in found)  # too few labels to certify a rule


@pytest.mark.parametrize("n, k", [(1, 0), (300, 0), (300, 2), (5000, 31), (40_000, 371)])
def test_binomial_tail_is_exact(spark, n, k):
    rate = Fraction(1, 100)
    term, exact = Fraction(99, 100) ** n, Fraction(0)
    for i in range(k + 1):
        exact += term
        term = term * (n - i) / (i + 1) * rate / (1 - rate) if n <= 5000 else term * Fraction((n - i), (i + 1) * 99)
    found = spark.range(1).select(
        quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01).alias("p")
    ).first()["p"]
    assert math.isclose(found, float(exact), rel_tol=1e-9)


def test_cutoffs_are_certified_and_tell_bad_documents(spark):
    clean, bad = "plain words " * 40, "odd*** words$$$ " * 40
    rows = [(i, clean + str(i), "en") for i in range(900)] + [(1000 + i, bad + str(i), "en") for i in range(50)]
    rows += [(2000, bad, "en"), (2001, clean, "en"), (2002, bad, "xx"), (2003, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "text", F.when(F.col("text").isNotNull(), F.concat("text", F.lit(" "), F.array_join(
            F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")))
    )
    marks = spark.createDataFrame([(i, int(i < 1000)) for i in [*range(900), *range(1000, 1050)]], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.accepted(docs, marks).collect()}
    assert set(range(900)) <= kept and 2001 in kept and 2002 in kept
    assert not kept & {*range(1000, 1050), 2000, 2003}
    assert quality_rules.judge(none_of(spark, docs), marks).count() == 0


# --------------------------------------------------------------------------------------------------------- lattice (9)


def all_segmentations(pieces, text):
    if not text:
        return 1.0
    return sum(p * all_segmentations(pieces, text[len(w) :]) for w, p in pieces.items() if text.startswith(w))


def test_word_probability_sums_all_segmentations():
    import numpy as np

    names = ["▁", "a", "b", "ab", "▁a", "bab", *(f"<{i}>" for i in range(256))]
    weights = np.log(np.linspace(1, 2, len(names) + 1) / 400)
    model = lattice.Lattice(names, list(range(6, 262)), weights)
    pieces = {w: math.exp(weights[i]) for i, w in enumerate(names[:6])}
    for word in ("a", "ab", "abab", "babab"):
        assert math.isclose(model.log_probability(word), math.log(all_segmentations(pieces, "▁" + word)))
        for long in (lattice.LONG_WORD, 0):  # both ways of summing
            counts, lattice.LONG_WORD, kept = np.zeros(len(names) + 1), long, lattice.LONG_WORD
            model.expect(word, 1.0, counts)
            lattice.LONG_WORD = kept
            assert math.isclose(sum(counts[i] * len(names[i]) for i in range(6)), len(word) + 1)
    spelt = weights[0] + sum(weights[6 + b] for b in "é".encode())
    assert math.isclose(model.log_probability("é"), spelt)
    assert math.isfinite(model.log_probability("ab" * 3000))


def plain_score(counts, n_docs, words, known={}):
    """Expectation maximisation and scoring without Spark."""
    import numpy as np

    key = tuple(sorted(counts.items())), n_docs
    if key not in known:
        pieces, byte_ids, prior = lattice.read_vocabulary()
        weights = np.log(prior)
        for _ in range(lattice.ROUNDS):
            model, sums = lattice.Lattice(pieces, byte_ids, weights), [0.0] * len(weights)
            for word, n in counts.items():
                model.expect(word, n, sums)
            total = lattice.PRIOR * prior + np.array(sums)
            total[-1] += n_docs
            weights = np.log(total / total.sum())
        known[key] = lattice.Lattice(pieces, byte_ids, weights), weights[-1]
    model, end = known[key]
    return (sum(model.log_probability(w) for w in words) + end) / math.log(10)


@pytest.mark.parametrize("hot_words", [0, 50, lattice.HOT_WORDS])
def test_lattice_base_counts_equal_brute_force(odd, documents, hot_words):
    import zlib

    def held(key):
        return key is not None and zlib.crc32(str(key).encode()) % 5 == 1

    for docs in (odd, documents.limit(40)):
        docs = materialize(docs)
        rows = docs.select("doc_id", "text").collect()
        tokens = [[*lattice.words_of(r["text"]), None] for r in rows]
        train = Counter(t for r, own in zip(rows, tokens) if not held(r["doc_id"]) for t in own)
        total, distinct = sum(train.values()), len(train)
        wanted = defaultdict(list)
        for r, own in zip(rows, tokens):
            base = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
            wanted[r["doc_id"]].append((held(r["doc_id"]), len(own), sum(train[t] > 0 for t in own), total, base))
        found, scores = defaultdict(list), defaultdict(set)
        for r in lattice.score(docs, hot_words=hot_words).collect():
            assert math.isfinite(r["score"]) and r["score"] < 0
            scores[r["doc_id"], r["n_tokens"]].add(round(r["score"], 6))
            found[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
        counts = Counter(t for r, own in zip(rows, tokens) if not held(r["doc_id"]) for t in own if t is not None)
        n_docs = sum(not held(r["doc_id"]) for r in rows)
        for r, own in zip(rows, tokens):  # by the trained weights, word for word
            expected = plain_score(counts, n_docs, own[:-1])
            assert any(math.isclose(expected, s, rel_tol=1e-6) for s in scores[r["doc_id"], len(own)])
        assert found.keys() == wanted.keys()
        for key, rows_ in wanted.items():
            for a, b in zip(sorted(found[key]), sorted(rows_)):
                assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_lattice_of_an_empty_table(spark, odd):
    assert lattice.score(none_of(spark, odd)).count() == 0


# --------------------------------------------------------------------------------------------------------- mixing (10)


def test_targets_fill_up_to_the_limit():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_one(size):
    import numpy as np

    found = mixing.permuted(np.arange(size), size, 12345)
    assert sorted(found.tolist()) == list(range(size))


def test_mix_meets_targets_and_repeats(documents):
    first = mixing.mix(documents).collect()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in documents.collect()}
    sources = {r["doc_id"]: r["source"] for r in documents.collect()}
    per = defaultdict(lambda: [0, 0, 0, 0.0])
    for r in first:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        own = per[sources[r["doc_id"]]]
        own[0], own[1], own[2], own[3] = own[0] + r["size"], own[1] + r["taken"], r["source_size"], r["target"]
    names = sorted(per)
    wanted = mixing.targets([per[n][0] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for name, target in zip(names, wanted):
        size, taken, stated, own = per[name]
        assert size == stated and math.isclose(own, target)
        assert abs(taken - target) <= 5 * math.sqrt(target * mixing.BLOCK_WORDS) + mixing.BLOCK_WORDS
    assert Counter(map(tuple, mixing.mix(documents).collect())) == Counter(map(tuple, first))


def test_mixed_texts_hold_the_words_taken(spark, documents):
    docs = documents.limit(60).withColumn("size", F.lit("x"))
    docs = materialize(docs.unionByName(docs.limit(5).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    texts = {r["doc_id"]: r for r in made.collect()}
    assert {k: len(WORD.findall(r["text"])) for k, r in texts.items()} == taken
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for key, row in texts.items():
        assert set(WORD.findall(row["text"])) <= set(WORD.findall(whole[key]))


def test_mix_of_odd_and_no_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(none_of(spark, odd)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
