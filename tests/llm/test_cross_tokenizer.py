"""Cross-tokenizer alignment against a plain loop over whole texts, and on awkward rows."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidebar.llm import cross_tokenizer, queries

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(v): v for v in shown} | {chr(256 + k): v for k, v in enumerate(v for v in range(256) if v not in shown)}
    vocabulary = {k: p for p, k in a.get_vocab().items()}
    of_a = lambda k: bytes(byte[c] for c in vocabulary[k])
    of_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return a, b, of_a, of_b


def tokens(libraries, text):
    """(id, lo, hi) of A and B, or nothing where a tokenizer changes the text."""
    a, b, of_a, of_b = libraries
    if not text:
        return [], []
    out = []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, of_a), (b.encode(text), of_b)):
        at, found, joined = 0, [], b""
        for k in ids:
            joined += of(k)
            found.append((k, at, len(joined)))
            at = len(joined)
        if joined != (" " + text).encode():
            return [], []
        out.append(found)
    return out


def expected(libraries, docs, links="end"):
    held, counts = [], Counter()
    for d, text in docs:
        a, b = tokens(libraries, text)
        ends = {t[2] for t in a} & {t[2] for t in b}
        if links == "end":
            by_end = {t[2]: t[0] for t in b}
            pairs = [(t[0], by_end[t[2]]) for t in a if t[2] in ends]
        else:
            pairs, k = [], 0
            for x in a:
                while k < len(b) and b[k][2] <= x[1]:
                    k += 1
                m = k
                while m < len(b) and b[m][1] < x[2]:
                    pairs.append((x[0], b[m][0]))
                    m += 1
        groups, at = [], [0, 0]
        for end in sorted(ends):
            sides = []
            for s, t in enumerate((a, b)):
                k = at[s]
                while at[s] < len(t) and t[at[s]][2] <= end:
                    at[s] += 1
                sides.append(",".join(str(x[0]) for x in t[k : at[s]]))
            groups.append((end, "|".join(sides)))
        counts.update(pairs)
        sha = hashlib.sha256(";".join(g[1] for g in groups).encode()).hexdigest() if a else ""
        held.append((d, len(a), len(b), len(groups), pairs, sha))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = [(d, na, nb, ng, len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), sha) for d, na, nb, ng, p, sha in held]
    return sorted(rows, key=str), sorted((a, b, n, n == most[b]) for (a, b), n in counts.items())


def test_whole_table(spark, data, libraries):
    docs = duckdb.connect().execute(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    df = queries.op11_cross_tokenizer(spark, data)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect()), key=str) == expected(libraries, docs)[0]


def odd_texts():
    rng = random.Random(5)
    alphabet = list("ab eé ß\n\t 　日本한İ̇ﬁ​.,!0 1  '") + ["<|endoftext|>", "</s>", "<unk>", "<0x41>", "▁", "\r\n", " the", " token", "\x00", "🙂", "é"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(300)]
    return [None, "", " ", "  ", "\n", "a", " a", "▁", "<|endoftext|>", "the " * 3000, "x" * 5000, *texts]


@pytest.mark.parametrize("links", ["end", "overlap"])
def test_odd_texts(spark, libraries, monkeypatch, links):
    monkeypatch.setattr(cross_tokenizer, "BLOCK_BYTES", 500)
    docs = list(enumerate(odd_texts()))
    rows, mapping = cross_tokenizer.align(spark.createDataFrame(docs, SCHEMA), A, B, links)
    want, pairs = expected(libraries, docs, links)
    assert sorted(map(tuple, rows.collect()), key=str) == want
    assert sorted(map(tuple, mapping.collect())) == pairs


def test_words_are_forgotten():
    """Words met again after the worker forgot all have the same counts, groups and links."""
    texts = [t or "" for t in odd_texts()]
    aligner = cross_tokenizer.Aligner(A, B, "end")
    seen = []
    for order in (texts, texts[::-1]):
        aligner.clear()
        slots, n = aligner.slots(order)
        words = [(aligner.text[s], *aligner.counts[s].tolist(), aligner.pair[aligner.start[s] : aligner.start[s] + aligner.n[s]].tolist()) for s in slots.tolist()]
        upto = [0, *n.cumsum().tolist()]
        seen.append([words[a:b] for a, b in zip(upto, upto[1:])][:: 1 if order is texts else -1])
    assert seen[0] == seen[1]


def test_awkward_rows(spark, libraries):
    docs = [(None, "the cat"), (1, "the cat"), (1, "the cat"), (2, None), (2, "")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as block", "2 as ids", "3 as pairs", "4 as id", "5 as n")
    rows, _ = cross_tokenizer.align(df, A, B)
    assert sorted(map(tuple, rows.collect()), key=str) == expected(libraries, docs)[0]
    rows, mapping = cross_tokenizer.align(spark.createDataFrame([], SCHEMA), A, B)
    assert rows.count() == 0 and mapping.count() == 0
