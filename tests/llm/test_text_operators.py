"""Text operators against brute force, libraries and round trips, on small and odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracklake.llm import bpe_automaton, fingerprints, language_id, line_dedup, minhash, quality_rules, retrieval_packing, suffix_arrays, suffix_trees, warc

tokenizers = pytest.importorskip("tokenizers")
files = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, n_words string, label string, h long"
WORDS = [f"{a}{b}" for a in "badoreminusel" for b in ("", "ta", "ron", "é")]


def corpus(seed=0, n=40):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, blanks, and a very long one."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    passage, lines = text(60), [text(8) for _ in range(3)]
    out = ["", None, " \n\t ", "one", "Two words", text(4000)]
    for i in range(n):
        t = text(rng.choice([3, 20, 70, 150])) + "\n" + text(30)
        if i % 5 == 0:
            t += " " + passage + " " + text(5)
        if i % 4 == 1:
            t += "\n" + "\n".join(lines) + "\n" + text(3)
        out.append(t)
        if i % 6 == 2:
            out += [t, t.upper(), " ".join(w if j != 7 else "changed" for j, w in enumerate(t.split()))]
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], SCHEMA).repartition(3)


def got(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def covered(seqs, window):
    seen = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        mark = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                mark[i : i + window] = [True] * window
        out.append(mark)
    return out


@pytest.mark.parametrize("shard_bytes", [2 << 20, 200])
def test_substrings(spark, rows, docs, shard_bytes):
    have = got(suffix_arrays.substring_digests(docs, window=100, k=24, shard_bytes=shard_bytes))
    data = [(t or "").encode() for _, t in rows]
    for (i, _), b, mark in zip(rows, data, covered(data, 100)):
        runs = sum(m and not p for m, p in zip(mark, [False, *mark]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        assert tuple(have[i])[1:] == (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [512, 3, 1])
def test_passages(spark, rows, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_trees, "MOST_KINDS", hot)
    have = got(suffix_trees.passage_digests(docs))
    words = [(t or "").encode().split() for _, t in rows]
    for (i, _), w, mark in zip(rows, words, covered(words, 35)):
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        assert tuple(have[i])[1:] == (len(w), sum(mark), hashlib.sha256(kept).hexdigest())


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(3)
    contents = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 1, 30, 50, 50)] + [b"abababababababababab", b"\0\0\0\0\0\0\0\0\0\0"]
    sizes = np.array([len(c) for c in contents])
    data, ends = np.frombuffer(b"".join(contents), np.uint8), np.cumsum(sizes)
    sa, keys = suffix_arrays.suffix_array(data, np.repeat(ends, sizes))
    suffix = [contents[d][k:] for d, c in enumerate(contents) for k in range(len(c))]
    assert sorted(sa.tolist()) == list(range(len(data)))
    # zero bytes tie with a content's end in the first eight, so only others are in strict order
    plain = [suffix[i] for i in sa if b"\0" not in suffix[i]]
    assert plain == sorted(plain)
    lcp = suffix_arrays.kasai(sa, keys, ends - sizes, ends, 25)
    for a, b in zip(sa, sa[1:]):
        x, y = suffix[a], suffix[b]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[b] == min(n, 25)


@pytest.mark.parametrize("rounds", [3, 0])
def test_near_duplicates(spark, rows, docs, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", rounds)
    have = got(minhash.near_duplicates(docs, shingle=4))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    for (i, _), s, c in zip(rows, sets, comp):
        assert tuple(have[i]) == (i, len(s), rows[c][0], i == rows[c][0])


def test_line_dedup(spark, rows, docs):
    have = got(line_dedup.line_digests(docs))
    seqs = [[x.strip() for x in (t or "").encode().split(b"\n") if x.strip()] for _, t in rows]
    first = {}
    for (i, t), s in zip(rows, seqs):
        gone = set()
        for k in range(len(s) - 1):
            if first.setdefault((s[k], s[k + 1]), (i, k)) != (i, k):
                gone |= {k, k + 1}
        solid, left = -1, []
        for line in (t or "").encode().split(b"\n"):
            solid += bool(line.strip())
            if not line.strip() or solid not in gone:
                left.append(line)
        assert tuple(have[i])[1:3] == (len(s), len(gone))
        assert have[i]["kept_sha256"] == hashlib.sha256(b"\n".join(left)).hexdigest()


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e\nf g h"), (1, "a b c d e\nf g h"), (1, "a b c d e\nf g h"), (None, None)]
    df = frame(spark, rows)
    assert sorted(r["n_removed"] for r in line_dedup.line_digests(df).collect()) == [0, 0, 2, 2]
    near = minhash.near_duplicates(df, shingle=4).collect()
    assert sorted((r["n_shingles"], r["component_id"] or 0) for r in near) == [(0, 0), (5, 1), (5, 1), (5, 1)]
    assert len(suffix_trees.passage_digests(df).collect()) == len(fingerprints.fingerprints(df).collect()) == 4


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).where("doc_id > 1")
    for f in (quality_rules.quality_rules, suffix_arrays.substring_digests, suffix_trees.passage_digests, line_dedup.line_digests, minhash.near_duplicates, fingerprints.fingerprints):
        assert f(empty).count() == 0
    assert retrieval_packing.packed(empty, files.path("byte_bpe_50k.json")).count() == 0
    assert bpe_automaton.bpe_digests(empty, files.path("word_bpe_49k.json")).count() == 0
    assert language_id.language_id(empty.withColumnRenamed("label", "lang")).count() == 0


def test_quality_rules(spark, docs):
    have = got(quality_rules.quality_rules(docs))
    assert have[0]["base_failed"] and not have[1]["kept"] and have[2]["n_words"] == 0
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(6))
    bad = "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(6))
    out = got(quality_rules.quality_rules(frame(spark, [(1, good), (2, bad), (3, good + "\nAll rights reserved."), (4, "a b c " * 40), (5, good + "\n" + good.split("\n")[0])])))
    assert [out[i]["kept"] for i in range(1, 6)] == [True, False, True, False, True]
    assert (out[4]["n_repeat_words"], out[5]["n_dup_lines"], out[5]["n_repeat_words"], out[2]["n_symbols"]) == (120, 1, 24, 66)
    assert quality_rules.cleaned(good + "\nAll rights reserved.") == good


def test_gradients():
    net, rng = language_id.BiGru(3, 4), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, labels = rng.integers(97, 110, (6, 5)), rng.integers(0, 3, 5)
    x[4:, 0] = language_id.PAD
    _, g = net.loss_and_gradients(x, labels)
    for k, w in net.p.items():
        flat = w.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up, _ = net.loss_and_gradients(x, labels)
            flat[i] = old - 1e-4
            down, _ = net.loss_and_gradients(x, labels)
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-6


def test_reader_equals_training_pass():
    net, rng = language_id.BiGru(3, 4), np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in (1, 63, 64, 65, 200)]
    prob = language_id.probabilities(net.reader(), texts, 3)
    for t, p in zip(texts, prob):
        total = np.zeros(3)
        for i in range(0, len(t), language_id.SEGMENT):
            x = np.frombuffer(t[i : i + language_id.SEGMENT], np.uint8).astype(int)[:, None]
            f, _ = net._direction("f", x)
            b, _ = net._direction("b", x[::-1])
            for k in range(len(x)):
                z = np.exp(f[k] @ net.p["Vf"] + b[len(x) - 1 - k] @ net.p["Vb"] + net.p["o"])
                total += (z / z.sum())[0]
        assert np.allclose(p, total / len(t), atol=1e-5)


def test_language_id(spark):
    rng = random.Random(5)
    alphabet = {"aa": "abcde ", "bb": "vwxyz ", "cc": "ñöüßé "}
    rows = [(i, "".join(rng.choices(alphabet[lang], k=60)), lang) for i in range(150) for lang in [rng.choice([*alphabet])]]
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (None, "abcabc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, net = language_id.fit(df, per_lang=40)
    out = {r["doc_id"]: r for r in language_id.language_id(df, langs=langs, net=net).collect()}
    for i, _, lang in rows[:150]:
        assert out[i]["lang_pred"] == lang and out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i]["score"] <= 1
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert out[None]["held_out"] is False
    assert {r["lang_pred"] for r in language_id.language_id(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Thirty-four languages, one of them very common, with clashing columns, a very long text and null texts first in hash order."""
    rng = random.Random(8)
    letters = [chr(0x100 + 3 * k) for k in range(34)]
    rows = [(i, "".join(rng.choices(letters[k] + chr(ord(letters[k]) + 1), k=50)), f"l{k:02}") for i in range(1600) for k in [0 if rng.random() < 0.3 else i % 34]]
    rows += [(5000 + i, None, f"l{i:02}") for i in range(34)] + [(6000, letters[7] * 30_000, None)]
    df = spark.createDataFrame([(*r, "clash", 1.0, True) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    langs, net = language_id.fit(df, per_lang=12)
    assert langs == [f"l{k:02}" for k in range(34)]
    sample = Counter(lang for lang, _ in language_id.sample(df, per_lang=12))
    assert set(sample) == set(langs) and set(sample.values()) == {12}
    out = {r["doc_id"]: r for r in language_id.language_id(df, langs=langs, net=net).collect()}
    held = [(i, lang) for i, t, lang in rows if t and lang and out[i]["held_out"]]
    right = sum(out[i]["lang_pred"] == lang for i, lang in held) / len(held)
    assert len(out) == len(rows) and right > 0.9, right
    assert out[6000]["lang_pred"] == "l07" and out[5000]["lang_pred"] == "und"


def test_sample_ties(spark):
    df = spark.createDataFrame([(0, f"text {k}", "aa", k) for k in range(50)], "doc_id long, text string, lang string, h int").repartition(7)
    assert zlib.crc32(b"0") % 3 != 1
    once, again = (language_id.sample(x, per_lang=4) for x in (df, df.repartition(2)))
    assert once == again and len(once) == 4


@pytest.mark.parametrize("n_langs", [1, 2, 4, 30])
def test_language_rejects_by_score(spark, monkeypatch, n_langs):
    from tracklake.llm import cleaning

    class Net:
        def reader(self):
            def read(segments):  # sure of texts of a's, undecided about others
                real = (segments != 256).sum(1)
                sure = (segments == 97).any(1)
                p = np.full((len(segments), n_langs), 1 / n_langs)
                p[sure] = 0.02 / n_langs
                p[sure, 0] += 0.98
                return p * real[:, None]

            return read

    monkeypatch.setattr(language_id, "fit", lambda docs: ([str(i) for i in range(n_langs)], Net()))
    df = spark.createDataFrame([(1, "aaa aaa", 7), (2, "zzz zzz", 7), (3, None, 7), (4, "1 2", 7)], "doc_id long, text string, score int")
    left = {r["doc_id"] for r in cleaning.with_language(df, 0.067).collect()}
    assert left == ({1, 2} if n_langs == 1 else {1})


def test_fingerprints(spark, rows, docs):
    have = got(fingerprints.fingerprints(docs))
    texts = [t or "" for _, t in rows]

    def jaccard(a, b):
        a, b = Counter(fingerprints.paragraphs(a)), Counter(fingerprints.paragraphs(b))
        return (a & b).total() / (a | b).total() if a or b else 1.0

    prints = defaultdict(set)
    for (i, _), t, nxt in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 4
        new = t[: len(t) - k] + nxt[:k]
        r = have[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(t, new)) < 1e-12 and abs(r["near_next"] - jaccard(t, nxt)) < 1e-12
        prints[t].add(r["fingerprint"])
        prints[new].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_next_document_across_buckets(spark, rows):
    df = frame(spark, rows).select("doc_id", "text").na.fill("")
    out = fingerprints.with_next(df, bucket_rows=4).collect()
    assert sum(not r["tail"] for r in out) == len(rows)
    assert {r["bucket"] for r in out if r["tail"]} == {r["bucket"] for r in out if not r["tail"]}


def test_peeling_recovers_both_sides():
    rng = np.random.default_rng(2)
    for n, m, both in ((0, 0, 5), (3, 0, 100), (200, 150, 1000), (5000, 1, 0)):
        k = rng.integers(1, 2**63, n + m + both).astype(np.uint64)
        a, b = fingerprints.difference(np.concatenate((k[:n], k[n + m :])), k[n:])
        assert set(a.tolist()) == set(k[:n].tolist()) and set(b.tolist()) == set(k[n : n + m].tolist())


ODD = ["", "  ", "it's I'LL we'd 'S", "<|startoftext|>Hi <|endoftext|> there<|endoftext|>", "ΑΣ ΣΑΣ σ", "a\x1cb \x1d x", "é É   x　y", "aaaa aaaaaaa aaaaaaaaaaaaaaa", "日本語 テスト 123 45a6 !!! ...,,, 😀😀", "İstanbul ﬁ", "x" * 3000, "a  b   c\n d \n\n e ", " lead", "tail \n"]


def test_word_bpe_equals_library(rows):
    path = files.path("word_bpe_49k.json")
    mine, theirs = bpe_automaton.WordCodec(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    for t in ODD + [t for _, t in rows if t]:
        want = theirs.encode(t, add_special_tokens=False).ids
        ids, labels = mine.encode(t)
        assert ids == " ".join(map(str, want)) and labels == theirs.decode(want, skip_special_tokens=False) == mine.decode(want)


def test_encoded_columns_equal_the_library(rows):
    texts = [*ODD, None, "\x0b\x0c", "\u3000 \xa0x\xa0 \x1e", *(t for _, t in rows)]
    path = files.path("word_bpe_49k.json")
    mine, theirs = bpe_automaton.WordCodec(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    for some in (texts, texts[20:], []):
        n, ids, labels = mine.encode_column(pa.array(["skipped", *some], pa.string())[1:])
        for t, k, i, w in zip(some, n, ids.to_pylist(), labels.to_pylist(), strict=True):
            want = theirs.encode(t or "", add_special_tokens=False).ids
            assert (k, i, w) == (len(want), " ".join(map(str, want)), theirs.decode(want, skip_special_tokens=False)), t
    path = files.path("byte_bpe_50k.json")
    mine, theirs = retrieval_packing.ByteBpe(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    for some in (texts, texts[20:], []):
        got = mine.column(pa.array(["skipped", *some], pa.string())[1:], 0, "<u2").to_pylist()
        for t, ids in zip(some, got, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*theirs.encode(t or "", add_special_tokens=False).ids, 0], t


def test_automaton_equals_plain_merging():
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("aa", "aa"), ("ba", "aab"), ("a", "b")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[u + v for u, v in merges]])}
    machine = bpe_automaton.Automaton(vocab, merges, "")
    rng = random.Random(6)
    for _ in range(2000):
        word = "".join(rng.choices("ab", k=rng.randint(0, 14)))
        t = list(word)
        for u, v in merges:
            out, i = [], 0
            while i < len(t):
                step = 2 if t[i : i + 2] == [u, v] else 1
                out.append("".join(t[i : i + step]))
                i += step
            t = out
        assert machine.encode(word) == t, word


def test_byte_bpe_equals_library(rows):
    path = files.path("byte_bpe_50k.json")
    mine, theirs = retrieval_packing.ByteBpe(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    for t in ODD + [t for _, t in rows if t]:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_packing(spark, rows, docs):
    path = files.path("byte_bpe_50k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    ids = {i: np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in rows}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in retrieval_packing.packed(docs, path, shard_tokens=5000).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for group, size in [*((p, len(ids[i])) for i, p in pieces.items()), *((p, None) for p in seqs.values())]:
        at = 0
        for start, n in sorted(group):
            assert start == at
            at += n
        assert at == size if size is not None else at == 1024 or at & (at - 1) == 0 and at < 1024
    assert len(pieces) == len(rows)


def topical(spark, n, parts):
    """Documents of eight vocabularies in turn, dealt over many partitions."""
    rng = random.Random(7)
    words = [["".join(rng.choices("bcdfglmnprst", k=5)) for _ in range(60)] for _ in range(8)]
    rows = [(i, " ".join(rng.choices(words[i % 8], k=60))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_packing_searches_all_partitions(spark):
    seqs, tokens = defaultdict(Counter), Counter()
    for r in retrieval_packing.packed(topical(spark, 400, 37), files.path("byte_bpe_50k.json"), shard_tokens=10_000).collect():
        seqs[r["sequence_id"]][r["doc_id"] % 8] += r["length"]
        tokens[r["doc_id"]] += r["length"]
    assert len(tokens) == 400
    pure = sum(max(c.values()) for c in seqs.values()) / sum(tokens.values())
    assert pure > 0.8, pure


def test_neighbours_beyond_the_first_terms_and_the_first_32():
    rare, more, alone = np.arange(12), np.arange(20, 28), iter(range(1000, 10_000))
    new = lambda k: np.array([next(alone) for _ in range(k)])
    docs = [np.concatenate([rare, new(52)]), np.concatenate([rare, rare, more]), *(np.concatenate([new(9), [50]]) for _ in range(5)), more]
    placed = [(d, q) for d, _, _, q, _ in retrieval_packing.pack(docs, 64)]
    assert placed[:3] == [(0, 0), (1, 1), (7, 1)]  # 7 shares only the lighter terms of 1
    short = [np.arange(100, 110) + 100 * (i % 2) for i in range(400)]
    first = [d for d, _, _, q, _ in retrieval_packing.pack(short, 1024) if q == 0]
    assert len(first) == 103 and len({d % 2 for d in first}) == 1


def test_scores_equal_the_formula():
    """All terms of the seed count, those of many documents and those of few, before and after postings are dropped."""
    rng = np.random.default_rng(3)
    docs = [rng.choice(np.concatenate([np.arange(12), np.arange(100, 400)]), rng.integers(1, 60), p=np.concatenate([np.full(12, 0.05), np.full(300, 0.4 / 300)])) for _ in range(60)]
    index, corpus = retrieval_packing.Bm25(docs), retrieval_packing.Corpus.of(docs)
    used, idf, mean = np.zeros(60, dtype=bool), corpus.idf(), corpus.tokens / corpus.n
    for turn in range(2):
        for seed in range(0, 60, 7):
            want = np.zeros(60)
            for d in np.flatnonzero(~used):
                for t in set(docs[seed].tolist()):
                    tf = int((docs[d] == t).sum())
                    if tf and corpus.df[t] > 1:
                        want[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
            assert np.allclose(index.scores(seed, used), want, rtol=1e-5)
        used[::3] = True
        index.drop(used)


def test_neighbours_in_order_of_rank_equal_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randint(1, 40)
        score = np.array([rng.choice([0, 1.5, 2, 2, 3, rng.random()]) for _ in range(n)])
        sizes = np.array([rng.randint(1, 30) for _ in range(n)])
        near, room = retrieval_packing.Near(score, sizes, sizes.tolist(), rng.choice([1, 2, 5])), 60
        left = sorted((x for x in range(n) if score[x]), key=lambda x: (-score[x], x))
        while True:
            fit = [x for x in left if sizes[x] <= room]
            got = near.take(room)
            assert got == (fit[0] if fit else left[0] if left else None)
            if not fit:
                break
            left.remove(got)
            room -= int(sizes[got])


def test_frequencies_are_of_the_corpus(spark, docs):
    path = files.path("byte_bpe_50k.json")
    spec = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())
    coded = retrieval_packing.token_ids(docs.select("doc_id", "text"), spec, 0, "<u2")
    all_ids = [np.frombuffer(r["ids"], "<u2") for r in coded.collect()]
    have, want = retrieval_packing.frequencies(coded, "<u2"), Counter(t for d in all_ids for t in set(d.tolist()))
    assert (have.n, have.tokens) == (len(all_ids), sum(map(len, all_ids)))
    assert {t: n for t, n in enumerate(have.df.tolist()) if n} == want


def test_neighbours_are_lexical():
    a, b = np.arange(100, 160), np.arange(500, 560)
    index = retrieval_packing.Bm25([a, b, a[:50], b[5:], np.array([1])], 12)
    used = np.array([True, False, False, False, False])
    assert index.neighbours(0, used, 5).tolist() == [2] and index.neighbours(4, used, 5).tolist() == []


def test_warc_round_trip(spark):
    big, rng = "<p>" + "x" * 2000, random.Random(7)
    pages = [(i, f"http://h/{i}", "".join(rng.choices("<abcé >", k=rng.choice([10, 3000])))) for i in range(60)]
    pages += [(100, "u", big), (101, "u\n v", big), (105, None, big), (110, "u", "short"), (111, "u", "short"), (120, "u", None), (121, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.round_trip(df, split_bytes=500).collect()}
    assert len(out) == len(pages)
    for i, _, h in pages:
        data = (h or "").encode()
        kind = ("revisit", 105) if i in (100, 101) else ("response", None)
        assert (out[i]["payload_bytes"], out[i]["payload_digest"], out[i]["record_type"], out[i]["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), *kind)
    assert warc.round_trip(df.where("page_id < 0")).count() == 0


def test_reader_skips_damage(tmp_path):
    raw = [warc.record(i, "u", b"payload %d" % i * 50, hashlib.sha1(b"payload %d" % i * 50).hexdigest(), None, False) for i in range(5)]
    members = [warc.gz(r, 6) for r in raw]
    members[2] = members[2][:40] + b"\x1f\x8b\x08junk" + members[2][60:]
    data = b"".join(members)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (7, 100, 10_000):
        ids = []
        for start in range(0, len(data), step):
            with open(path, "rb") as f:
                ids += [warc.parsed(r)["page_id"] for r in warc.records_of(f, start, start + step)]
        assert ids == [0, 1, 3, 4]
