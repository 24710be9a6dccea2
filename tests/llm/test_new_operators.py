"""Collocations, Merkle manifests and toxicity against brute force on small fixtures."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import bpe, collocations, html, merkle, mixing, quality, similar, toxicity
from chronoloom.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, path string, tree string, index string, score string, `range` string"


def _rows():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "Red", "wine", "new", "york", "city", "café", "日本", "a-b", "$", "x\x0by"]
    texts = [" ".join(rng.choice(vocabulary, int(n))) + rng.choice([".", "!", "\n", ", the end"]) for n in rng.integers(0, 60, 60)]
    texts += ["new york city hall. " * 9, "red wine\tred  wine, red wine" * 6, None, "", " \t\n", "the " * 300, texts[0], " ".join(rng.choice(vocabulary, 6000))]
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], None if i % 7 == 0 else f"s{i % 2}", None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[4][0], "another of that id", "en", "s0", 2), (None, "no id", "en", None, None), (None, None, None, None, None)]
    return [(*r, *["x"] * 6) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- collocations ---------------------------------------------------------------------------


def phrases(rows, least, percent, top):
    total, counts = Counter(), Counter()
    for r in rows:
        lang, text = r[2] or "und", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    frequent = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    longer = Counter()
    for (lang, w), f in frequent.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], f)
    out = {}
    for (lang, w), a in frequent.items():
        if (lang, w) in longer and 100 * longer[lang, w] >= percent * a:
            continue
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 500, "range_windows": 40, "hot_windows": 2}])
def test_collocations(docs, rows, empty, sizes, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE", 1)  # plans tell each hot path here
    found = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=40, **sizes).collect())
    assert found == phrases(rows, 4, 80, 40) and len(found) > 60
    assert collocations.collocations(empty, **sizes).count() == 0


def test_hot_paths_are_cut(docs):
    counts = collocations.count(docs, least=4, hot_windows=2 << 10, range_windows=50)
    assert counts.phrases.groupBy("lang", "phrase").count().where("count > 1").count() == 0


def test_one_key_keeps_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 31, 500) for _ in range(4)]
    key = collocations.one_key(columns, [1 << 31] * 4)
    assert np.array_equal(np.argsort(key, kind="stable"), np.lexsort(columns[::-1]))


# ---- Merkle manifest ------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(digests, k):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + k]) for i in range(0, len(found[-1]), k)])
    return found


def leaf_of(r, more=0):
    fields = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def manifest(rows, k):
    trees = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), leaf_of(r, 1) if bad else leaf_of(r), r[0]))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: levels([x[1] for x in sorted(trees[t])], k) for t in order}
    upper = levels([built[t][-1][0] for t in order], k)
    out = []
    for seat, t in enumerate(order):
        for i, (_, leaf, claim, doc_id) in enumerate(sorted(trees[t])):
            digest, proof = claim, []
            for found, at in ((built[t], i), (upper, seat)):
                for level in found[:-1]:
                    run = level[at // k * k : at // k * k + k]
                    proof += [x for j, x in enumerate(run) if j != at % k]
                    digest = sha(*[digest if j == at % k else x for j, x in enumerate(run)])
                    at //= k
            root = upper[-1][0]
            out.append((doc_id, leaf, built[t][-1][0], root, sha(*proof), digest, digest == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("fanout, step, height", [(2, 20, 12), (3, 1, 2), (2, 2, 1)])
def test_manifest(docs, rows, empty, fanout, step, height, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    claims = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(docs, claims, fanout).verified().collect()
    assert sorted(map(tuple, found), key=key) == sorted(manifest(rows, fanout), key=key)
    assert 0 < sum(r["verified"] for r in found) < len(found)
    assert merkle.manifest(empty).root is None and merkle.manifest(empty).verified().count() == 0


def test_manifest_of_one(docs, rows):
    one = merkle.manifest(docs.where("doc_id = 7"))
    assert one.root.hex() == leaf_of(rows[7]) and [r["verified"] for r in one.verified().collect()] == [True]


# ---- toxicity -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def abuse(spark):
    rng = np.random.default_rng(2)
    plain, bad = [f"w{i}" for i in range(300)], ["fool", "foolish", "nitwit"]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(int(rng.integers(1, 12)))]
        toxic = i % 4 == 0
        if toxic:
            at = int(rng.integers(0, len(sentences)))
            sentences[at] += " " + " ".join(rng.choice(bad, 2))
        rows.append((i, ". ".join(sentences), "en", "s", None, *["x"] * 6))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "fool nitwit", None, None, None, *["x"] * 6), (1000, None, None, None, None, *["x"] * 6), (1001, "", None, None, None, *["x"] * 6), (1002, ("fine day. " * 100_000) + "you nitwit fool", "en", None, None, *["x"] * 6), rows[0]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in labels}


def test_toxicity(abuse, empty):
    docs, labels, truth = abuse
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    out = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    assert by[1000]["score"] == by[1001]["score"] == 0 and by[None]["predicted"] == 1 and by[1002]["score"] > by[1]["score"]
    sentences = [r for r in toxicity.offending(docs, model, 0.5).collect() if r["doc_id"] in truth]
    assert sentences and all("fool" in r["sentence"] or "nitwit" in r["sentence"] for r in sentences if truth[r["doc_id"]])
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_learns_from_training_rows_only(abuse):
    docs, labels, _ = abuse
    held = toxicity.held_out()
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_toxicity_without_labels(abuse, empty):
    docs, labels, _ = abuse
    for given in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(docs, toxicity.fit(docs, given)).where("score > 0").count() == 0
    assert toxicity.score(docs, toxicity.fit(empty, labels)).where("score > 0").count() == 0


# ---- hashes that the earlier operators share ------------------------------------------------


def _opposites():
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_opposite_sequences_differ():
    a, b = _opposites()
    for c in W.chunks(pa.array([f"{a} {b}"])):
        assert len(set(c.hashes().tolist())) == 2
    assert quality.statistics(pa.array([f"{a}\n{b}\n{a}"]))["n_dup_lines"].tolist() == [1]


def test_opposite_sequences_are_encoded_apart():
    import public_tokenizers

    a, b = _opposites()
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encoder = bpe.Encoder(f.read())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = encoder.encode(pa.array([a, b]), 0)
    found = [ids[lo:hi].tolist() for lo, hi in zip(at[:-1], at[1:], strict=True)]
    assert found == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in (a, b)]


# ---- rows and texts that the earlier operators lost -----------------------------------------


def test_keep_one_of_texts_with_equal_words(spark):
    """Texts of the same words have the same fingerprint; 20 pairs among them are near copies."""
    rng = np.random.default_rng(8)
    words, rows = [f"v{i}" for i in range(400)], []
    for i in range(20):
        order = list(rng.permutation(words))
        near = list(order)
        near[100], near[300] = near[300], near[100]
        rows += [(2 * i, " ".join(order)), (2 * i + 1, " ".join(near))]
    kept = {r["doc_id"] for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 40, 2)) <= kept and len(kept) <= 22


def test_keep_one_finds_all_components(spark, monkeypatch):
    """Orders of one bag of words, near pairs at the limit, and chains: components of all pairs, as brute force has them."""
    rng = np.random.default_rng(21)
    words, texts = [f"v{i}" for i in range(120)], []
    for i in range(40):
        order = [str(w) for w in rng.permutation(words)]
        texts.append(" ".join(order))
        for _ in range(3):  # each a little further from the first: some meet one another only
            order = list(order)
            at = int(rng.integers(10, 100))
            order[at], order[at + 7] = order[at + 7], order[at]
            texts.append(" ".join(order))
    common = " ".join(f"line{i}" for i in range(30))
    for i in range(40):  # a passage that all share, and edges that few do
        own = [f"u{i // 4}x{k}" for k in range(40)]
        for k in rng.choice(40, i % 4, replace=False):
            own[k] = f"e{i}x{k}"
        texts.append(f"{common} {' '.join(own)}")
    texts += ["a b c d", "a b c d e", "a b c d e f", "b c d e f", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 40 < len(set(root)) < len(texts) - 40
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == sorted(set(root))
    monkeypatch.setattr(similar, "MOST_FREQUENT", 1)  # what counts as frequent changes no result
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == sorted(set(root))


def test_keep_one_of_copies_near_a_text_but_not_each_other(spark, monkeypatch):
    """Sixty copies with four edits each, below the limit to all others: no pair of them may be similar by its places, so none is made."""
    words, sizes = [f"v{i}" for i in range(150)], {}
    texts = [" ".join(words)]
    for i in range(60):
        copy = list(words)
        for k in range(4):
            copy[10 + (7 * i + 35 * k) % 130] = f"e{i}x{k}"
        texts.append(" ".join(copy))
    made = similar.materialize

    def spy(df, name):
        table = made(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(similar, "materialize", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = similar.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(61))
    assert sizes["similar-split"] > 500 and sizes["similar-met"] <= 61  # of 1,830 pairs


def test_rows_are_told_apart_by_nulls_and_maps(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", None, {"k": 1}), (1, "a b c", "s", None, "x", {"k": 1}), (1, "a b c", "s", None, "x", {"k": 2})], "doc_id long, text string, source string, p string, q string, m map<string,int>")
    got = mixing.repeat_to_mix(docs).collect()
    assert {(r["p"], r["q"], r["m"]["k"]) for r in got} == {("x", None, 1), (None, "x", 1), (None, "x", 2)}
    assert similar.keep_one(docs).count() == 1


def test_unquoted_attribute_values():
    long = "A paragraph of the article that has a good many words, so that it stays. " * 3
    page = f"<html><body><article><p data-x=it's>{long}one</p><p title=a\"b>{long}two</p><p class='c' \">{long}three</p></article></body></html>"
    assert [html.main_text(page).count(w) for w in ("one", "two", "three")] == [1, 1, 1]


def test_chunks_stay_small():
    """A worker's arrays are some tens of times its chunk; chunks of 2 MB took an executor beyond its memory."""
    from chronoloom.llm import words

    texts = pa.array(["word " * 2000] * 500)
    assert max(len(c.data) for c in words.chunks(texts)) <= 1 << 20
