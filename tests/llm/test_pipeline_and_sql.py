"""The text queries that have SQL against DuckDB, and the pipeline's stages against brute force."""

import os
import random
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_text_operators import WORDS, covered  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_quality_rules", "op7_warc"])
def test_matches_sql(spark, name):
    import duckdb

    from tracklake.llm import registry

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), c.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    pick = lambda rows, names: sorted(tuple(r[names.index(k)] for k in cols) for r in rows)
    have = df.collect()
    assert have and pick(have, df.columns) == pick(want.fetchall(), want.columns)


def lines_left(docs):
    """Later copies of two-line runs go; documents that have no word left go."""
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(solid, solid[1:]):
            if first.setdefault((lines[a].strip(), lines[b].strip()), (i, a)) != (i, a):
                gone |= {a, b}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip():
            out[i] = left
    return out


def one_of_each(docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()  # A to Z alone
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    least = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    return {i: t for i, t in docs.items() if least[i] == i}


def passages_left(docs):
    out = {}
    words = {i: t.split() for i, t in docs.items()}
    for (i, w), mark in zip(words.items(), covered(list(words.values()), 35)):
        if not any(mark):
            out[i] = docs[i]
            continue
        kept = [" ".join(x for x, m in zip(w, mark) if not m)]
        if kept[0]:
            out[i] = kept[0]
    return out


def test_stages(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(4)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    passage, lines = text(60), text(8) + "\n" + text(9)
    texts = [None, "", "12 34 !?", lines, lines]
    for i in range(24):
        t = text(rng.choice([3, 20, 90]))
        texts.append(t + " " + passage if i % 6 == 0 else t + "\n" + lines if i % 6 == 1 else t)
        if i % 6 == 2:
            texts += [texts[-1], texts[-1].upper()]
    rows = [(i, t, "aa", "web", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    expected = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    made = docs
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (dict, lines_left, one_of_each, passages_left)):
        made = spark.createDataFrame(stage(spark, made, "").collect(), docs.schema)
        have = {r["doc_id"]: r for r in made.collect()}
        expected = brute(expected)
        assert made.columns == docs.columns and set(have) == set(expected), name
        for i, t in expected.items():
            assert have[i]["text"].split() == t.split() and have[i]["n_chars"] == len(have[i]["text"]), name
        expected = {i: r["text"] for i, r in have.items()}

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[4][1](spark, made, "").collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert set(pieces) == set(expected)
    for i, t in expected.items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    assert np.unique([len(p) for p in pieces.values()]).min() >= 1
