"""The pipeline against its stages done plainly, and each stage's form."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline as pipeline
import pytest

from gaugeline.llm import lines, quality, simhash, tokens
from gaugeline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    weights = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [r for r in rows if quality.probability(weights, (r[1] or "").encode()) >= pipeline.THRESHOLD]
    kept = brute.without_boilerplate([(s, t) for _, t, s in rows], lines.RATIO, lines.PAGES)
    rows = [(d, t) for (d, _, _), t in zip(rows, kept, strict=True)]
    group = brute.groups([brute.fingerprint(t, 4) for _, t in rows], 4)
    least = {g: min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    rows = [r for r, g in zip(rows, group, strict=True) if r[0] == least[g]]
    left = []
    for d, t in rows:
        n, hit, _ = brute.contamination(t, items, 13)
        if not hit or 20 * len(hit) < n:
            left.append((d, t))
    library = tokens.Vocabulary(pipeline.vocabulary_file()).tokenizer
    expected = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in left}
    pieces = sorted(pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"]))
    found: dict[int, list[int]] = {}
    for p in pieces:
        found.setdefault(p["doc_id"], []).extend(p["ids"])
    assert found == expected


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stages_take_odd_and_empty_documents(spark, k):
    docs = table(spark, SF, "documents").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", None, 0), (900, "", "en", None, 0), (901, "x " * 40_000, None, "s", 80_000)], docs.schema)
    name, stage = pipeline.STAGES[k]
    for rows in (docs.unionByName(odd), docs.limit(0)):
        out = stage(spark, rows, SF)
        if k < len(pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        Counter(tuple(map(str, r)) for r in out.collect())


def test_copies_that_fill_a_source_keep_their_article(spark):
    article = lambda k: "\n".join(f"line {i} of article {k} says {k * 31 + i}" for i in range(6))
    rows = [(i, f"menu\n{article(i)}", "big") for i in range(40)] + [(100 + i, article(500), "big") for i in range(20)]
    rows += [(200 + i, article(600), "small") for i in range(3)] + [(210 + i, article(600 + i), "small") for i in range(1, 6)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], table(spark, SF, "documents").schema)
    kept = {r["doc_id"]: r["text"] for r in pipeline.line_dedup(spark, docs, SF).collect()}
    assert kept == {d: t.removeprefix("menu\n") for d, t, _ in rows}
    left = {r["text"] for r in pipeline.simhash_near_dedup(spark, pipeline.line_dedup(spark, docs, SF), SF).collect()}
    assert article(500) in left and article(600) in left and "" not in left


def test_near_copies_that_fill_a_source_keep_their_article(spark):
    article = lambda k: "\n".join(f"line {i} of article {k} says {k * 31 + i} and more words of its own {k}" for i in range(20))
    rows = [(i, f"menu\n{article(i)}", "big") for i in range(40)] + [(100 + i, f"{article(500)}\non day {i}", "big") for i in range(20)]
    rows += [(200 + i, f"{article(600)}\nat {i}", "small") for i in range(4)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], table(spark, SF, "documents").schema)
    found = simhash.near_duplicates(docs, pipeline.SHINGLE, pipeline.RADIUS).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in found}.get(100) == 20, "the copies are near ones"
    kept = {r["doc_id"]: r["text"] for r in pipeline.line_dedup(spark, docs, SF).collect()}
    assert kept == {d: t.removeprefix("menu\n") for d, t, _ in rows}
    left = [r["text"] for r in pipeline.simhash_near_dedup(spark, pipeline.line_dedup(spark, docs, SF), SF).collect()]
    assert sum(article(500) in t for t in left) == 1 and sum(article(600) in t for t in left) == 1 and len(left) == 42


def test_packing_stage_takes_millions_of_blanks(spark):
    docs = table(spark, SF, "documents")
    rows = spark.createDataFrame([(7, " " * 2_000_000, "en", "s", 2_000_000), (8, "a b", "en", "s", 3)], docs.schema)
    pieces = pipeline.packed_sequences(spark, rows, SF).collect()
    library = tokens.Vocabulary(pipeline.vocabulary_file()).tokenizer
    for doc, text in ((7, " " * 2_000_000), (8, "a b")):
        found = [x for p in sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"]) for x in p["ids"]]
        assert found == [*library.encode(text, add_special_tokens=False).ids, 0]
