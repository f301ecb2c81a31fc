"""Stages of the corpus pipeline, each on what the one before kept, against plain versions."""

import re

from tidebar.llm import queries

from .test_operators import brute_classes


def test_stages(spark, data):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, data).cache()
        assert now.columns == docs.columns and now.count() <= before.count()
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    scores = {r.doc_id: r.predicted for r in queries.op8_toxicity(spark, data).collect()}
    assert set(kept["toxicity"]) == {i for i, p in scores.items() if p == 0}
    classes = brute_classes(list(kept["toxicity"].items()), 80, 100)
    assert set(kept["near_dedup"]) == {i for i, (_, c) in classes.items() if c == i}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [cut(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    leaks = {i for i, t in kept["near_dedup"].items() if any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - leaks
    assert set(kept["pii"]) == set(kept["decontamination"]) and not any("@mail" in (t or "") and kept["decontamination"][i] == t for i, t in kept["pii"].items())
    pieces = P.STAGES[-1][1](spark, now, data).toPandas()
    assert set(pieces.doc_id) == set(kept["pii"]) and pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_on_awkward_rows(spark, data):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars int, id string, toxic int, __row int, __found int, __text string, digest binary, n_tokens string"
    more = (None, 1, 2, 3, "t", None, "n")
    mail = "write to a.b@mail.example.com today or not at all please"
    passage = spark.read.parquet(f"{data}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first().text
    plain = "one quiet river ran along the harbour wall and past the old lantern house until noon " * 3
    rows = [(1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (3, plain, "en", "s", len(plain), *more), (3, plain, "en", "s", len(plain), *more), (4, plain + "x", None, "s", 5, *more)]
    rows += [(None, plain, "en", None, 1, *more), (5, mail, "en", "s", len(mail), *more), (6, passage, "en", "s", len(passage), *more), (7, "wide " * 200_000, "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, schema)
    left = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        left[name] = sorted((r["doc_id"] or 0, r["__found"], len(r["text"] or "")) for r in out.select("doc_id", "__found", "text").collect())
        assert stage(spark, docs.limit(0), data).count() == 0
    ids = {k: [i for i, _, _ in v] for k, v in left.items()}
    assert {1, 2} <= set(ids["toxicity"]) and {1, 2, 0, 3, 5, 6, 7} == set(ids["near_dedup"]) and ids["near_dedup"].count(3) == 2
    assert ids["decontamination"] == [0, 1, 2, 3, 3, 4, 5, 7] and ids["pii"] == [0, 1, 2, 3, 3, 4, 5, 6, 7]
    assert all(f == 3 for v in left.values() for _, f, _ in v)
    hidden = {r.doc_id: r for r in P.pseudonymize(spark, docs, data).collect()}[5]
    assert "a.b@" not in hidden.text and hidden.n_chars == len(hidden.text)
    pieces = P.pack(spark, docs, data).toPandas()
    assert len(pieces[pieces.doc_id.isin([1, 2])]) == 2 and (pieces[pieces.doc_id.isin([1, 2])].length == 1).all() and len(pieces[pieces.doc_id == 3]) == 2
    assert P.pack(spark, docs.limit(0), data).count() == 0
