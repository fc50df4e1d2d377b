import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewatch.llm import bpe, components as cc, exact_dedup, langid, line_dedup, lm, near_docs, near_vectors, packing, quality, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
BASE = " ".join(f"word{i}" for i in range(60))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "extra", None) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "  \t\n", "A b", "a  b", "a b", "<|endoftext|> x", "é" * 50_000, "x\n" * 2000, BASE, BASE + " end", "1234 !!", "\x00\x1c a b"]


def lm_tokens(text):
    return (text or "").encode().lower().split()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.BytePairs(open(path, encoding="utf-8").read())
    random.seed(4)
    letters = ["a", "the", " ", "  ", "\n", "é", "中", "😀", "'s", "1", "\x1c", "\xa0", "<|endoftext|>", "--", "\r\n", "\x00", "ing"]
    for _ in range(1500):
        text = "".join(random.choices(letters, k=random.randint(0, 25)))
        assert np.frombuffer(own.encode_batch([text])[0], dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(500):
        ids = random.choices(range(50257), k=8)
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    rows = by_id(bpe.bpe_decode(bpe.bpe_encode(docs(spark, *ODD), path), path))
    for i, text in enumerate(ODD):
        assert rows[i].ids == library.encode(text or "", add_special_tokens=False).ids and rows[i].decoded == (text or "")
    assert bpe.bpe_encode(docs(spark).limit(0), path).count() == 0


def test_language(spark):
    texts = ["the cat and the dog went there"] * 30 + ["der hund und die katze gehen nicht"] * 30
    rows = spark.createDataFrame([(i, t, "en" if i < 30 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(rows, langid.default_vocabulary())
    found = by_id(langid.identify(docs(spark, *ODD, "THE DOG", "die katze"), model))
    assert found[0].lang_pred == found[11].lang_pred == "und" and found[13].lang_pred == "en" and found[14].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found.values())
    none = langid.fit(rows.where("lang = 'xx'"), langid.default_vocabulary())
    assert langid.identify(rows, none).first().lang_pred == "und"


def plain_log(word, prob, pieces):
    """Logarithm of the sum over all segmentations of a word, one by one from the left, in whole fractions."""
    from fractions import Fraction

    exact = {p: Fraction(x) for p, x in zip(pieces, prob, strict=True)}
    marked, sums = "▁" + word, [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 20), end):
            for piece in {marked[start + 1 : end + 1], marked[:end + 1] if start == 0 else ""} - {""}:
                sums[end] += sums[start] * exact.get(piece, 0)
        if word[end - 1] not in exact and not (end == 1 and "▁" + word[0] in exact):
            sums[end] += sums[end - 1] * Fraction(langid.UNCOVERED)
    total = sums[-1]
    return math.log(total.numerator) - math.log(total.denominator)


def test_forward_sums_all_segmentations():
    random.seed(3)
    pieces = ["▁a", "a", "ab", "b", "▁ab", "bab", "abab", "▁b", "c", "cab"]
    prob = np.array([[random.random() * 10.0 ** -random.randint(1, 6)] for _ in pieces])
    model = langid.LanguageModel(pieces, ["x"], np.zeros(1), prob)
    words = ["ab", "a", "c", "zz", "abz"] + ["".join(random.choices("abc", k=n)) for n in (5, 19, 20, 21, 40, 41, 90, 400)] + ["z" * 300, "ab" * 400]
    logs = langid.Scorer(model).logs(words)
    assert logs[:, 0] == pytest.approx([plain_log(w, prob[:, 0].tolist(), pieces) for w in words])
    # expected counts: every letter is in one piece, and the learning's counts equal those of plain enumeration
    segment = langid.Segmenter(pieces)
    long = words[-3]
    for word in ("abab", long):
        found = segment.matches([word])
        share = langid.expected(1, found, langid._weights(prob, found[3]), np.array([len(word)]))
        covered = np.zeros(len(word))
        for start, end, x in zip(found[1], found[2], share, strict=True):
            covered[start:end] += x
        assert covered == pytest.approx(np.ones(len(word)))


def test_language_accuracy_on_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = langid.fit(rows.where(~langid.held_out()), langid.default_vocabulary())
    found = langid.identify(rows.where(langid.held_out()), model).where("lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    assert len(found) > 150 and np.mean([r.right for r in found]) > 0.98


def test_language_of_long_words_and_repeated_rows(spark):
    texts = ["the cat and the dog went there"] * 30 + ["der hund und die katze gehen nicht"] * 30
    rows = spark.createDataFrame([(i, t, "en" if i < 30 else "de", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string")
    model = langid.fit(rows, langid.default_vocabulary())
    odd = spark.createDataFrame([(1, "the" * 5000, "a"), (1, "the" * 5000, "a"), (2, "katze " * 3000, None), (3, "中" * 3000, "b")], "doc_id long, text string, score string")
    found = langid.identify(odd, model).collect()
    assert found[0] == found[1] and found[2].lang_pred == "de" and all(0 <= r.score <= 1 for r in found)
    assert langid.identify(odd.limit(0), model).count() == 0


def test_quality_learns_and_scores_odd_texts(spark):
    random.seed(1)
    good = [" ".join(random.choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=60)) + "." for _ in range(300)]
    junk = ["### $$$ %%% BUY!! NOW!! " * random.randint(5, 20) for _ in range(100)]
    rows = docs(spark, *good, *junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    model = quality.fit(rows, labels)
    found = by_id(quality.score(rows, model))
    assert np.mean([found[i].predicted for i in range(300)]) > 0.9 and np.mean([found[i].predicted for i in range(300, 400)]) < 0.1
    assert all(0 <= r.score <= 1 for r in quality.score(docs(spark, *ODD), model).collect())
    assert quality.fit(rows.limit(0), labels).chance(np.zeros((1, quality.WIDTH)))[0] == 0.5


def test_quality_risk_and_gradient_by_hand():
    random_ = np.random.default_rng(1)
    weights = [random_.normal(size=(3, 4)), random_.normal(size=4), random_.normal(size=4), random_.normal(size=1)]
    p, u = random_.normal(size=(7, 3)), random_.normal(size=(9, 3))
    mean = lambda: (lambda r: (r[0] / 9, [g / 9 for g in r[1]]))(quality.as_negative(weights, u))

    def risk(prior):
        f = lambda x: [sum(math.tanh(sum(x_[i] * weights[0][i, k] for i in range(3)) + weights[1][k]) * weights[2][k] for k in range(4)) + weights[3][0] for x_ in x]
        loss = lambda z, y: sum(math.log(1 + math.exp(-y * v)) for v in z) / len(z)
        at_p, at_u = f(p), f(u)
        if prior is None:
            return loss(at_p, 1) + loss(at_u, -1), 0.0
        negative = loss(at_u, -1) - prior * loss(at_p, -1)
        return prior * loss(at_p, 1) + max(0.0, negative), negative

    for prior in (None, 0.3, 0.9):
        found, gradient = quality.risk_and_gradient(weights, p, mean(), prior)
        whole, negative = risk(prior)
        assert found == pytest.approx(whole)
        if prior is not None and negative < 0:
            continue
        for k in range(4):
            for i in np.ndindex(weights[k].shape):
                kept = weights[k][i]
                weights[k][i] = kept + 1e-6
                up = risk(prior)[0]
                weights[k][i] = kept - 1e-6
                down = risk(prior)[0]
                weights[k][i] = kept
                assert gradient[k][i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    # where the negative part is below zero, the step goes against minus that part
    weights[2], weights[3] = weights[2] * 0, np.array([3.0])
    _, gradient = quality.risk_and_gradient(weights, p, mean(), 1.5)
    s = 1 / (1 + math.exp(-3))
    assert risk(1.5)[1] < 0 and gradient[3][0] == pytest.approx(1.5 * s - s)


def test_quality_prior_of_a_known_mixture():
    random_ = np.random.default_rng(4)
    draw = lambda n, share: np.where(random_.random((n, 1)) < share, random_.normal(1.5, 1, (n, 3)), random_.normal(-1.5, 1, (n, 3)))
    for share in (0.2, 0.5, 0.8):
        p, u, other = draw(4000, 1), draw(4000, share), draw(9000, share)
        net = quality._trained(p[::2], u, None, (u.mean(axis=0), u.std(axis=0)), steps=200)
        cuts = quality.prior_cuts(net, p[1::2])
        above = (net.odds(other)[:, None] >= cuts).sum(axis=0)
        assert quality.estimate_prior(net, cuts, p[1::2], above, len(other)) == pytest.approx(share, abs=0.08)


def test_quality_sums_and_steps_go_over_all_rows(spark):
    random_ = np.random.default_rng(6)
    x = random_.normal(size=(500, quality.WIDTH)).astype("<f4")
    table = spark.createDataFrame([(bytearray(v.tobytes()), i % 2) for i, v in enumerate(x)], "x binary, half int").repartition(7)
    assert quality.summed(table, lambda v: v.sum(axis=0)) == pytest.approx(x.sum(axis=0, dtype=float))
    assert quality.summed(table, lambda v: np.array([float(len(v))]), "half = 1").tolist() == [250.0] and len(quality.summed(table, lambda v: v.sum(axis=0), "half = 5")) == 0
    p = x[:50].astype(float) + 1
    net = quality._trained(p, x[:60].astype(float), 0.3, (x.mean(axis=0), x.std(axis=0)), steps=2)

    def whole_risk(net):
        loss, grads = quality.as_negative(net.weights, net.shaped(x.astype(float)))
        return quality.risk_and_gradient(net.weights, net.shaped(p), (loss / 500, [g / 500 for g in grads]), 0.3)

    # the least risk of a few steps by hand
    tried, adam = [net], quality.Adam(net.weights, 0.005)
    for _ in range(4):
        tried.append(quality.Network(net.mean, net.scale, adam.stepped(tried[-1].weights, whole_risk(tried[-1])[1])))
    best = min(tried, key=lambda n: whole_risk(n)[0])
    found = quality.refined(net, p, table, 500, 0.3, 4)
    assert all(np.allclose(a, b) for a, b in zip(found.weights, best.weights, strict=True))


def test_quality_on_held_out_documents(spark):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(rows.where(~langid.held_out()), labels.where(~langid.held_out()))
    found = quality.score(rows.where(langid.held_out()), model).join(labels.where("quality is not null"), "doc_id").select("quality", "score", "predicted").toPandas()
    good, bad = found["score"][found["quality"] == 1].to_numpy(), found["score"][found["quality"] == 0].to_numpy()
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.97 and (found["predicted"] == found["quality"]).mean() > 0.93
    assert quality.score(rows.limit(0), model).count() == 0


def test_exact_dedup(spark):
    texts = ODD + ["a b"] * 150 + [None]
    found = by_id(exact_dedup.exact_dedup(docs(spark, *texts)))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            assert (found[i].keep_id, found[i].group_size, found[i].kept, found[i].text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.drop_exact_duplicates(docs(spark, *texts))
    assert kept.count() == len(groups) and kept.columns == docs(spark).columns


def test_line_dedup_against_brute_force(spark):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(40)]
    lines = [" ".join(random.sample(vocabulary, random.randint(1, 12))) for _ in range(60)]
    lines += [" ".join([*x.split(), random.choice(vocabulary)]) for x in lines] + ["", " "]
    texts = ["\n".join(random.choices(lines, k=random.randint(0, 9))) for _ in range(80)] + [None, "", "the\n" * 300]
    rows = by_id(line_dedup.dedup_lines(docs(spark, *texts)))
    seen = []
    for i, text in enumerate(texts):
        removed = []
        for n, line in enumerate((text or "").split("\n")):
            words = set(line.lower().split())
            if words:
                if any(10 * len(words & s) >= 8 * len(words | s) for s in seen):
                    removed.append(n)
                seen.append(words)
        assert (rows[i].removed, rows[i].n_lines) == (removed, len((text or "").split("\n")))
        assert rows[i].clean_text == "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in set(removed))


def expected_lines(rows):
    """Removed line numbers of (id, text) rows, by comparing every line with all lines before it."""
    seen, out = [], {}
    for i, text in sorted(rows):
        removed = []
        for n, line in enumerate((text or "").split("\n")):
            words = set(line.lower().split())
            if words:
                if any(10 * len(words & s) >= 8 * len(words | s) for s in seen):
                    removed.append(n)
                seen.append(words)
        out[i] = removed
    return out


def test_line_dedup_of_long_lines_hot_words_and_second_round(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(line_dedup, "PAIRS", 64)
    monkeypatch.setattr(line_dedup, "FEW", 1)
    monkeypatch.setattr(line_dedup, "MANY", 1)
    monkeypatch.setattr(line_dedup, "LOG2_POSTINGS", 6)
    random.seed(11)
    lines = []
    for size in (70, 130, 300, 30):
        for _ in range(6):
            words = [f"w{random.randint(0, 900)}" for _ in range(size)]
            for _ in range(5):
                other = list(words)
                for _ in range(random.randint(0, size // 6)):
                    other[random.randrange(size)] = f"w{random.randint(0, 900)}"
                lines.append(" ".join(other))
    lines += [f"rare the of and {a} {b} {c}" for a in "abc" for b in "def" for c in "ghijk"]  # all share all their rarest words
    random.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(-(-len(lines) // 4))]
    table = spark.createDataFrame([(i, t, "a", 1.0, "b") for i, t in rows], "doc_id long, text string, doc string, version double, word string")
    found = line_dedup.dedup_lines(table)
    assert found.columns == ["doc_id", "text", "doc", "version", "word", "clean_text", "n_lines", "removed"]
    want = expected_lines(rows)
    assert {r.doc_id: r.removed for r in found.collect()} == want and sum(map(len, want.values())) > 20


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d\nx"), (1, "a b c d\nx"), (2, "a b c d"), (None, "a b c d"), (3, None), (3, None), (4, "x " * 30_000 + "\nX")]
    found = [(r.doc_id, r.clean_text, r.removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, "a b c d\nx", [])] * 2 + [(2, "", [0]), (None, "a b c d", []), (3, "", []), (3, "", []), (4, "", [0, 1])], key=str)


def test_packing_against_linear_search():
    random.seed(2)
    for _ in range(200):
        items = sorted([(random.randint(1, 20), random.randint(-1, 3), random.choice([-1, -1, 0, 1, 2])) for _ in range(random.randint(1, 60))], key=lambda x: -x[0])
        bins, plain, want = packing.Bins(20), [], []
        for clock, (length, source, cluster) in enumerate(items):
            fits = [(room, since, k) for k, (room, since, s, c) in enumerate(plain) if room and room >= length and (source < 0 or source not in s) and (cluster < 0 or cluster not in c)]
            k = min(fits)[2] if fits else len(plain)
            if not fits:
                plain.append((20, 0, set(), set()))
            room, _, s, c = plain[k]
            plain[k] = (room - length, clock, s | {source}, c | {cluster})
            want.append(k)
        assert [bins.place(*i) for i in items] == want


def test_packing_keeps_every_word_and_every_rule(spark):
    texts = ODD + [BASE * 60] * 3 + ["w " * 30_000]
    rows = docs(spark, *texts).withColumn("source", F.when(F.col("doc_id") < 4, None).otherwise(F.col("doc_id") % 3)).withColumns({"part": F.lit("x"), "length": F.lit("y"), "row": F.lit(1), "shard": F.lit(2)})
    found = packing.pack(rows, capacity=100, shard_pieces=50).collect()
    words, load, held, clusters = Counter(), Counter(), set(), set()
    for r in sorted(found, key=lambda r: (r.bin_id or -1, r.bin_offset)):
        words[r.doc_id] += r.length
        if r.bin_id is None:
            assert r.length == 0
            continue
        assert r.bin_offset == load[r.bin_id]  # pieces stand one after another
        load[r.bin_id] += r.length
        assert load[r.bin_id] <= 100
        if r.doc_id >= 4:
            assert (r.bin_id, r.doc_id % 3) not in held
            held.add((r.bin_id, r.doc_id % 3))
        text = " ".join((texts[r.doc_id] or "").split())
        assert (r.bin_id, text) not in clusters
        clusters.add((r.bin_id, text))
    assert all(words[i] == len((t or "").encode().split()) for i, t in enumerate(texts))


def test_packing_spreads_repeated_rows(spark):
    same = spark.createDataFrame([(1, "a b c", None)] * 400 + [(None, "d e", "s")] * 3, "doc_id long, text string, source string")
    found = packing.pack(same, capacity=10, shard_pieces=40).collect()
    shards = Counter(r.bin_id >> 32 for r in found)
    assert len(found) == 403 and len(shards) > 8 and max(shards.values()) < 100
    assert len({r.bin_id for r in found if r.doc_id == 1}) == 400  # copies are kept apart


def test_packed_tokens_are_the_documents_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in ODD if t] + [BASE * 40]
    encoded = bpe.bpe_encode(docs(spark, *texts), path)
    bins = packing.filled(encoded, packing.pack(encoded, capacity=512, ids_col="ids")).collect()
    ids = {i: list(r.ids) for i, r in by_id(encoded).items()}
    found = {}
    for b in bins:
        assert len(b.ids) == sum(b.piece_lengths) <= 512
        at = 0
        for i, n in zip(b.piece_ids, b.piece_lengths, strict=True):
            found.setdefault(i, Counter())[tuple(b.ids[at : at + n])] += 1
            at += n
    for i, tokens in ids.items():
        assert found.get(i, Counter()) == Counter(tuple(tokens[k : k + 512]) for k in range(0, len(tokens), 512))


def test_near_vectors_against_brute_force(spark):
    random_ = np.random.default_rng(3)
    base = random_.normal(size=(120, 8))
    base[60:] = base[:60] + random_.normal(scale=0.08, size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(200, None), (201, [0.0] * 8), (202, [math.nan] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [float(x) for x in base[3]]), (205, [1.0])]
    found = by_id(near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    sound = {i: np.array(v) for i, v in rows if i < 200 or i == 204}
    cosine = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    links = {i: [j for j, w in sound.items() if j != i and cosine(v, w) >= 0.95] for i, v in sound.items()}
    assert sum(len(x) for x in links.values()) > 20
    assert sum(found[i].n_links for i in links) >= 0.9 * sum(len(x) for x in links.values())
    assert all(found[i].n_links <= len(links[i]) for i in links)
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in (200, 201, 202, 203, 205))


def test_lm_base_score_is_exact(spark):
    texts = [*ODD, "a b c", "a zzz"]
    rows = docs(spark, *texts)
    training = F.col("doc_id") != len(texts) - 1
    found = by_id(lm.score_texts(rows, training))
    counts = Counter(w for t in texts[:-1] for w in [*lm_tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*lm_tokens(t), b""]
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert found[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert found[i].score <= 0


def test_log_frequency_bloom_never_underestimates():
    random_ = np.random.default_rng(1)
    items = random_.integers(0, 1 << 63, 2000).astype(np.uint64)
    counts = random_.integers(1, 300, 2000)
    bits = lm.segment(items, counts, 1 << 20)
    bloom = lm.LogFrequencyBloom(bits, 0, 1 << 20)
    level = lm.level_of(counts)
    found = bloom.levels(items)
    assert (found >= level).all() and (found == level).mean() > 0.99
    assert (bloom.levels(random_.integers(0, 1 << 63, 5000).astype(np.uint64)) == 0).mean() > 0.98


def test_near_vectors_recall_on_many_vectors(spark):
    random_ = np.random.default_rng(9)
    base = random_.normal(size=(5200, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    # partners at a cosine just over the threshold, a dense cluster, and magnitudes whose squares over- and underflow
    away = random_.normal(size=base.shape)
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = random_.uniform(0.9502, 0.956, 5200)[:, None]
    cluster = base[:1] + random_.normal(scale=0.035, size=(600, 64))
    all_ = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away, cluster])
    scaled = all_ * np.where(np.arange(len(all_)) % 3 == 0, 1e200, np.where(np.arange(len(all_)) % 3 == 1, 1e-200, 1.0))[:, None]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(scaled.tolist())], "vec_id long, embedding array<double>")
    found = by_id(near_vectors.near_vectors(table), "vec_id")
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    want = np.zeros(len(unit), dtype=np.int64)
    for i in range(0, len(unit), 1000):
        want[i : i + 1000] = (unit[i : i + 1000] @ unit.T >= 0.95).sum(axis=1) - 1
    got = np.array([found[i].n_links for i in range(len(unit))])
    assert (got <= want).all() and want[:5200].sum() > 5200 and want[10_400:].mean() > 20
    pairs, dense = got[:10_400].sum() / want[:10_400].sum(), got[10_400:].sum() / want[10_400:].sum()
    print(f"recall {pairs:.4f} of pairs at the threshold, {dense:.4f} in a dense cluster")
    assert pairs >= 0.95 and dense >= 0.95


def plain_model(texts):
    """Tables of the smoothed model over quantised counts, and P(word | before) by brute force."""
    seen, both = Counter(), Counter()
    for words in texts:
        seen.update(words)
        both.update(zip([None, *words], words, strict=False))
    count = lambda c: float(lm.count_of(lm.level_of(np.array([c])))[0]) if c else 0.0
    flat = sum(map(count, seen.values())) + len(seen) + 1
    after = {}
    for (before, word), c in both.items():
        after.setdefault(before, {})[word] = count(c)

    def chance(word, before):
        single = (count(seen[word]) + 1) / flat
        if before not in after:
            return single
        z, t = sum(after[before].values()), len(after[before])
        return (max(after[before].get(word, 0) - lm.DISCOUNT, 0) + lm.DISCOUNT * t * single) / z

    return seen, after, chance


def test_lm_filter_leaves_no_n_gram_out():
    random_ = np.random.default_rng(2)
    items = np.unique(random_.integers(0, 1 << 63, 400_000).astype(np.uint64))
    assert (lm.segment_levels(items, np.ones(len(items), dtype=np.int64)) >= 1).all()
    small = lm.segment(items, np.ones(len(items), dtype=np.int64), 1 << 20)  # far too few bits: nothing is left out even so
    assert (lm.LogFrequencyBloom(small, 0, 1 << 20).levels(items) >= 1).all()
    others = random_.integers(0, 1 << 63, 100_000).astype(np.uint64)
    found = lm.segment_levels(np.concatenate([items, others]), np.concatenate([np.ones(len(items), dtype=np.int64), np.zeros(len(others), dtype=np.int64)]))
    assert 0 < (found[len(items) :] > 0).mean() < 0.004


def test_lm_is_a_probability_and_equals_brute_force(spark, monkeypatch):
    random_ = np.random.default_rng(2)
    texts = [" ".join(f"w{int(3000 * random_.random() ** 3)}" for _ in range(30)) for _ in range(400)] + [None, "", "w0 never seen w1", "w0 " * 20_000]
    held = [i % 7 == 2 for i in range(len(texts))]
    words = [[*lm_tokens(t), b""] for t in texts]
    seen, after, chance = plain_model([w for w, h in zip(words, held, strict=True) if not h])
    unknown = b"none of them"
    for before in [None, *sorted(after, key=lambda b: -len(after[b]) if b else 0)[:40], unknown]:
        assert sum(chance(w, before) for w in [*seen, unknown]) == pytest.approx(1)
    n, v = sum(seen.values()), len(seen)
    bits = 256  # hardly any false hits
    whole = by_id(lm.score_texts(docs(spark, *texts), F.col("doc_id") % 7 != 2, bits=bits))
    usual = by_id(lm.score_texts(docs(spark, *texts), F.col("doc_id") % 7 != 2))
    monkeypatch.setattr(lm, "LOG2_SENT", 11)
    monkeypatch.setattr(lm, "BATCH_BYTES", 5000)
    monkeypatch.setattr(lm, "FREQUENT", 60)
    monkeypatch.setattr(lm, "MOST_FREQUENT", 1 << 12)
    parts = by_id(lm.score_texts(docs(spark, *texts).repartition(5), F.col("doc_id") % 7 != 2, bits=bits))
    for i, w in enumerate(words):
        want = sum(math.log10(chance(word, before)) for before, word in zip([None, *w], w, strict=False))
        for found in (whole[i], parts[i]):
            assert (found.n_tokens, found.n_known, found.train_tokens) == (len(w), sum(seen[x] > 0 for x in w), n)
            assert found.base_score == pytest.approx(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w))
            assert found.score == pytest.approx(want, rel=1e-3)
    assert np.median([abs(usual[i].score - whole[i].score) / len(w) for i, w in enumerate(words)]) < 0.02


def test_near_docs_against_brute_force(spark):
    random.seed(5)
    texts = list(ODD)
    for size in (5, 7, 9, 14, 30, 80, 200):
        for _ in range(4):
            words = [f"v{random.randint(0, 5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(4):
                other = list(words)
                for _ in range(random.randint(0, 3)):
                    other[random.randrange(size)] = "changed"
                texts.append(" ".join(other[: size - random.randint(0, 2)]))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    forest = cc.Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                forest.join(i, j)
    found = by_id(near_docs.near_docs(docs(spark, *texts)))
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [found[i].component_id for i in range(len(texts))] == [forest.root(i) for i in range(len(texts))]


def test_near_operators_on_repeated_rows_ties_and_long_texts(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    table = spark.createDataFrame([(2, BASE, "a"), (2, BASE, "a"), (1, BASE + " end", "b"), (None, BASE, "c"), (4, long, "d"), (5, long + " more", "e"), (6, None, "f"), (6, None, "f")], "doc_id long, text string, size string")
    found = sorted((r.doc_id or -1, r.component_id, r.n_shingles) for r in near_docs.near_docs(table).collect())
    assert found == [(-1, 1, 56), (1, 1, 57), (2, 1, 56), (2, 1, 56), (4, 4, 977), (5, 4, 978), (6, 6, 0), (6, 6, 0)]
    vectors = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (5, [1.0, 0.001], 3), (9, [0.0, -1.0], 3)], "vec_id long, embedding array<float>, size long")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(vectors).collect())
    assert found == [(2, 3, 2, True), (3, 3, 2, False), (3, 3, 2, False), (5, 3, 2, False), (9, 0, 9, True)]
    net = quality.Network(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), [np.ones((quality.WIDTH, 1)), np.zeros(1), np.ones(1), np.zeros(1)])
    scored = quality.score(table.withColumn("score", F.lit("x")), net).collect()
    by_text = {}
    for r in scored:
        assert by_text.setdefault(r.text, r.score) == r.score == net.chance(np.array([quality.measures(r.text or "")]))[0] and r.size


def test_near_docs_deals_a_large_key_in_blocks(spark):
    random.seed(6)
    rows = [(7, 1, i, random.choice([1, 1, 1, 2, i])) for i in range(50)] + [(8, 1, i, i) for i in range(5)] + [(9, 1, i, 3 if i < 40 else i) for i in range(50)]
    found = near_docs.block_pairs(spark.createDataFrame(rows, "key long, band int, set_id long, component long"), 8).collect()
    pieces = {}
    for r in found:
        pieces.setdefault((r.key, r.block_a, r.block_b), []).append(r)
    assert all(len(p) <= 16 for p in pieces.values())
    together = {(k, x.set_id, y.set_id) for (k, a, b), p in pieces.items() for x in p for y in p if x.set_id < y.set_id and (a == b or x.block != y.block)}
    assert {(k, i, j) for k, _, i, c in rows for h, _, j, d in rows if k == h and i < j and c != d} <= together
    columns = ["key", "block_a", "block_b", "block", "set_id", "component", "size", "sketch"]
    near = [{**r.asDict(), "size": 100, "sketch": [0]} for r in found]
    near.sort(key=lambda r: [r[c] for c in columns[:4]])
    batches = [__import__("pyarrow").RecordBatch.from_pylist([{c: r[c] for c in columns} for r in near])]
    got = Counter(frozenset(p) for out in near_docs._unconnected_pairs(None)(iter(batches)) for p in zip(out["set_id"].to_pylist(), out["other"].to_pylist(), strict=True))
    assert set(got) == {frozenset((i, j)) for k, _, i, c in rows for h, _, j, d in rows if k == h and i < j and c != d}


def test_near_docs_with_keys_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_docs, "BLOCK", 4)
    random.seed(12)
    passage = [f"p{i}" for i in range(64)]
    texts = [" ".join(passage + [f"u{i}-{k}" for k in range(40)]) for i in range(14)]
    texts += [texts[i] + " end" for i in (3, 9, 13)]
    dealt = []
    real = near_docs.block_pairs
    monkeypatch.setattr(near_docs, "block_pairs", lambda many, size: dealt.append(real(many, size)) or dealt[-1])
    found = by_id(near_docs.near_docs(docs(spark, *texts)))
    assert dealt[0].where("block_b > 0").count()  # some key was cut
    assert [found[i].component_id for i in range(17)] == [*range(14), 3, 9, 13]


def test_first_pairs_do_not_depend_on_batches():
    pa = __import__("pyarrow")
    random.seed(8)
    rows = sorted((random.randint(0, 12), random.randint(0, 9)) for _ in range(120))
    table = pa.table({"key": [k for k, _ in rows], "band": pa.array([1] * len(rows), pa.int32()), "set_id": [x for _, x in rows]})
    want = Counter()
    for key in {k for k, _ in rows}:
        sets = sorted({x for k, x in rows if k == key})
        want.update([(key, x, sets[0]) for x in sets[1:]] + [(key, x, None) for x in sets if len(sets) > 2])
    for size in (1, 2, 5, 200):
        out = near_docs._first_pairs(iter(table.to_batches(max_chunksize=size)))
        assert Counter((r["key"], r["set_id"], r["other"]) for b in out for r in b.to_pylist()) == want


def test_warc_round_trip(spark, tmp_path):
    v = warc.VERSION
    rows = [(1, "u", "a" + v + "b"), (2, None, "a" + v + "b"), (3, "x\r\ny", None), (4, "z", ""), (5, "q", v), (6, "q", v + v + "\r\n\r\nW" + v), (7, "q", "é" * 500 + "WWARC/1.1\r\n\r\nWARC/1.1\r"), (None, "n", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write(warc.resolve(pages), first)
    found = {r.id: r for r in warc.read(spark, first).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    assert all(found[i].payload.decode() == (h or "") for i, _, h in rows if found[i].record_type == "response")
    warc.deduplicate(spark, first, second)
    assert {r.id: r.refers_to for r in warc.read(spark, second).collect()} == {i: r.refers_to for i, r in found.items()}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in cc.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert near_docs.near_docs(none).count() == 0
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert packing.pack(none).count() == 0
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_after_frequent_words_are_added_up_over_the_batches_of_a_task(monkeypatch):
    known = np.sort(np.array([lm.START, lm.hashes_of(pa.array([b"a"]))[0]], dtype=np.uint64))
    texts = [pa.RecordBatch.from_arrays([pa.array(x)], names=["text"]) for x in (["a b a b", None], ["a b"], ["c", ""])]
    whole = list(lm._pairs_after(known)(iter(texts)))
    assert len(whole) == 1 and len(set(whole[0]["pair"].to_pylist())) == whole[0].num_rows
    assert sorted(whole[0]["n"].to_pylist()) == [1, 2, 2, 3]  # start c; start end, start a; a b
    monkeypatch.setattr(lm, "COUNTED", 0)
    apart = list(lm._pairs_after(known)(iter(texts)))
    sums = Counter()
    for batch in apart:
        for pair, n in zip(batch["pair"].to_pylist(), batch["n"].to_pylist(), strict=True):
            sums[pair] += n
    assert len(apart) == 3 and dict(sums) == dict(zip(whole[0]["pair"].to_pylist(), whole[0]["n"].to_pylist(), strict=True))
    assert sum(b.num_rows for b in lm._pairs_after(known)(iter([]))) == 0


def test_frequent_words_are_a_fixed_share_until_one_segment_would_hold_too_much():
    for n in (27_000_000, 135_000_000, 1 << 30):
        assert n / 512 <= lm.frequent_from(n) < n / 512 + 1
    assert lm.frequent_from(0) == lm.frequent_from(5) == 1
    assert lm.frequent_from(1 << 34) == lm.FREQUENT and lm.frequent_from(1 << 40) == 1 << 24  # never more than 65,536 words
