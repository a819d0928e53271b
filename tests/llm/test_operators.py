"""Operators against plain versions, exact round trips and the cases their docstrings define."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import chat, decontam, lines, packing, quality, rules, runs, simhash, sparse, tokens, webtext
from gaugeline.llm.common import stored

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: doc_id, text: null, empty, blank, short, equal and repeated rows, marks, a long text, other scripts.
LONG = " ".join(f"word{i % 997} is {i}" for i in range(9000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (None, "one two"), (None, None), (6, "A b c d e f"), (6, "A b c d e f"),
    (7, "a B c d e f"), (8, LONG), (9, LONG), (10, "<|endoftext|> tail  <|end"), (11, "é日本 　x\x1cy "), (12, "a\x00b \x7f| $ #"), (13, "it's they're we'll   end\n\n"),
]
CLASHING = ("fingerprint string, root long, doc string, component_id int, text_hash int, place int, tie int, score double, found int, parts int, lines int, g int, "
            "site int, owner int, start int, u int, n_words int, kept int, page int, id int")


def frame(spark, rows, columns="doc_id long, text string"):
    """Rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, columns)
    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1).cast(kind))
    return df.withColumn("a.b`c", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- 1 -------------------------------------------------------------------------------------------------------------


def test_simhash_equals_all_pairs(spark, documents, texts):
    rows = texts + ODD
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    assert bag(simhash.near_duplicates(df, 4, 4), "doc_id", "fingerprint", "component_id") == Counter(brute.near_duplicates(rows, 4, 4))


def test_simhash_odd_rows_and_empty_table(spark):
    df = frame(spark, ODD)
    assert bag(simhash.near_duplicates(df, 4, 4), "doc_id", "fingerprint", "component_id") == Counter(brute.near_duplicates(ODD, 4, 4))
    assert simhash.near_duplicates(df.limit(0), 4, 4).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_tiles_link_what_all_pairs_link(radius, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    draw = random.Random(radius)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            p ^= 1 << draw.randrange(64)
            prints.add(p)
    every = np.array(sorted(prints), np.uint64)
    half = len(every) // 2
    pairs = []
    for one, two, same in ((every[:half], every[:half], True), (every[half:], every[half:], True), (every[:half], every[half:], False)):
        u, v = simhash.links(one, two, radius, same)
        assert len(u) < len(one) + len(two)
        pairs += zip(u.tolist(), v.tolist(), strict=True)
    number = {int(p): i for i, p in enumerate(every)}
    label = simhash.forest(np.array([number[a] for a, _ in pairs], int), np.array([number[b] for _, b in pairs], int), len(every))
    found, expected = defaultdict(set), defaultdict(set)
    for i, (a, b) in enumerate(zip(label, brute.groups([int(p) for p in every], radius), strict=True)):
        found[a].add(i)
        expected[b].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("tile, meet", [(8, 1), (64, 2)])
def test_full_cells_are_cut_and_lose_no_link(spark, monkeypatch, tile, meet):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "MEET", meet)
    monkeypatch.setattr(simhash, "WORK", 1 << 8)
    draw = random.Random(tile)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(6):
            p ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            prints.add(p)
    every = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(p,) for p in every], "fingerprint long")
    tiles = simhash.tiled(df)
    sizes = [r["size"] for r in tiles.collect()]
    assert sum(sizes) == len(every) and len(tiles.select("tile").distinct().collect()) == len(sizes)
    pairs = simhash.tile_pairs(tiles, 4).collect()
    assert max(r["part"] for r in pairs) > 0 and len({(r["tile"], r["other"]) for r in pairs}) == len(pairs)
    assert len(pairs) < len(sizes) * (len(sizes) + 1) / 2
    edges = [tuple(r) for r in simhash.linked(df, 4).collect()]
    number = {p: i for i, p in enumerate(every)}
    label = simhash.forest(np.array([number[a] for a, _ in edges], int), np.array([number[b] for _, b in edges], int), len(every))
    found, expected = defaultdict(set), defaultdict(set)
    for i, (a, b) in enumerate(zip(label, brute.groups([p & (1 << 64) - 1 for p in every], 4), strict=True)):
        found[a].add(i)
        expected[b].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_dense_tiles_hold_a_forest_only(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 4)
    every = np.array([a << 20 | b for a in range(16) for b in range(16)], np.uint64)  # any two within eight bits
    u, v = simhash.links(every, every, 8, True)
    assert len(u) == len(every) - 1 and set(v.tolist()) == {int(v[0])} and len(set(u.tolist())) == len(u)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 200), (200, 7)]
    found = dict(bag(simhash.components(spark.createDataFrame(chain, "u long, v long")), "u", "root").keys())
    assert {found[i] for i in range(1, 41)} == {-5} and {found[i] for i in range(101, 130)} == {100}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_each_group(spark):
    df = frame(spark, ODD + [(20, "A b c d e f g h i j k l"), (19, "a b c d e f g h i j k l")])
    left = simhash.keep_one(df, 4, 4)
    assert left.columns == df.columns
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    group = brute.groups([brute.fingerprint(t, 4) for _, t in rows], 4)
    least: dict = {}
    for (d, _), g in zip(rows, group, strict=True):
        key = (d is None, d)
        least[g] = min(least.get(g, key), key) if d is not None or g not in least else least[g]
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for _, d in least.values())


# -- 2 -------------------------------------------------------------------------------------------------------------

ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short item here"), (3, None), (4, "..."), (None, "nameless thing indeed"), (2, "w3 W4"), (5, "solo")]


@pytest.mark.parametrize("limit", [12, 60, 1 << 20])
def test_decontamination_in_any_blocks(spark, limit):
    content = " ".join(f"W{i}" for i in range(3, 18))
    rows = ODD + [(30, f"x {content} y"), (31, "short, item; HERE nameless thing indeed"), (32, "solo " * 3 + "other " * 90), (33, "w1 w3 w4 w5")]
    df, items = frame(spark, rows), frame(spark, ITEMS, "item_id long, text string")
    found = decontam.searched(df.select("doc_id", "text"), items, limit=limit).withColumnRenamed("found", "f")
    for r in found.collect():
        n, hit, named = brute.contamination(r["text"], ITEMS, 13)
        spans = r["f"]["spans"]
        places = {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)}
        assert (r["f"]["n_words"], places, set(r["f"]["items"])) == (n, hit, {str(x) for x in named}), r["doc_id"]
    kept = decontam.clean(df, items)
    assert kept.columns == df.columns
    bad = {d for d, t in rows if (c := brute.contamination(t, ITEMS, 13))[1] and 20 * len(c[1]) >= c[0]}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - bad and bad == {30, 31, 33}


def test_decontamination_of_empty_tables(spark):
    df, items = frame(spark, ODD), frame(spark, ITEMS, "item_id long, text string")
    assert decontam.decontaminate(df.limit(0), items).count() == 0
    assert decontam.decontaminate(df, items.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_decontamination_over_several_stages_of_blocks(spark, monkeypatch):
    df, items = frame(spark, ODD + [(30, "w1 w3 w4 w5"), (31, "solo x short item here")]), frame(spark, ITEMS, "item_id long, text string")
    whole = bag(decontam.searched(df.select("doc_id", "text"), items).select("doc_id", F.to_json("found").alias("f")), "doc_id", "f")
    monkeypatch.setattr(decontam, "CHAINED", 2)
    in_parts = decontam.searched(df.select("doc_id", "text"), items, limit=12)
    assert bag(in_parts.select("doc_id", F.to_json("found").alias("f")), "doc_id", "f") == whole
    assert decontam.blocks(items, "item_id", "text", 12)[0] > 4


@pytest.mark.parametrize(("size", "different"), [(1, 1 << 20), (300, 1 << 20), (1 << 20, 3)])
def test_rounds_of_texts_change_no_result(monkeypatch, size, different):
    class Sent:
        def __init__(self, value):
            self.value = value

    content = [(t or "").encode() for _, t in ODD] + [b"w1 w3 w4 w5", b"solo x SHORT item here " * 40]
    batches = [(content[:7], 7), (content[7:], len(content) - 7)]
    nothing = lambda n: {"spans": [None] * n, "items": [None] * n}
    blocks = [Sent([(None if k is None else str(k), (t or "").encode())]) for k, t in ITEMS]

    def rows():
        return [tuple(r) for part in decontam.scan(blocks, 13).func((c, nothing(n)) for c, n in batches) for r in part.itertuples(index=False)]

    whole = rows()
    monkeypatch.setattr(decontam, "ROUND_BYTES", size)
    monkeypatch.setattr(decontam, "ROUND_WORDS", different)
    assert rows() == whole and len(whole) == len(content) and whole[-1][2] == ["2", "5"]


# -- 3 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokens.Vocabulary(VOCABULARY).tokenizer


def test_token_counts_equal_the_library(spark, documents, texts, library):
    rows = texts + ODD
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    expected = Counter()
    for doc, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[doc, len((text or "").encode()), n, n > 1024] += 1
    assert bag(tokens.token_counts(df, VOCABULARY, 1024), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.token_counts(frame(spark, ODD).limit(0), VOCABULARY, 9).count() == 0


def test_every_prefix_equals_the_library(library):
    draw, words = random.Random(5), tokens.Vocabulary(VOCABULARY)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'s", "'ll", "'ve", "é", "日本", "!!", "123", "\xa0", "<|endoftext|>", "<|end", "\x1c", " x", "ing", "   ", "　"]
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for _ in range(400):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        expected = [count(text[:i]) for i in range(len(text) + 1)]
        assert words.prefixes(text).tolist() == expected, text
        assert words.text_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
        for limit in (0, 2, 5):
            assert words.within(text, limit) == (expected[-1], max(i for i, n in enumerate(expected) if n <= limit)), text


def test_words_with_marks_are_looked_up_as_words():
    words, text = tokens.Vocabulary(VOCABULARY), "a thandheed, a thandheed. thandheed! (thandheed) thandheed's thandheed,"
    every = words.prefixes(text)
    assert every.tolist() == [len(words.tokenizer.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    assert " thandheed" not in {**words.pieces, **words.pieces.older} or "thandheed" in words.counts
    assert words.unit_counts(" thandheed,")[:-4] == words.counts["thandheed"]


def test_stored_prefix_counts(spark, library):
    table = tokens.prefix_table(frame(spark, ODD), VOCABULARY)
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in table.where("doc_id IN (6, 13)").select("doc_id", tokens.tokens_at("prefix_tokens", 5).alias("n")).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"][:5], add_special_tokens=False).ids) for r in df.where("doc_id IN (6, 13)").collect()}


def test_stored_counts_of_every_length_and_cut(spark, library):
    rows = [r for r in ODD if r[0] not in (None, 6, 8, 9)] + [(20, "it's a   long  walk " * 9 + "<|endoftext|>" + "日本 é " * 30), (21, " " * 130), (22, "x" * 64), (23, "a b " * 16)]
    held = stored(tokens.prefix_table(frame(spark, rows), VOCABULARY), "prefixes")
    at = F.explode(F.sequence(F.lit(0), F.lit(400))).alias("at")
    got = defaultdict(list)
    for r in held.select("doc_id", "prefix_tokens", at).select("doc_id", "at", tokens.tokens_at("prefix_tokens", F.col("at")).alias("n")).orderBy("doc_id", "at").collect():
        got[r["doc_id"]].append(r["n"])
    expected = {d: [len(library.encode((t or "")[:i], add_special_tokens=False).ids) for i in range(len(t or "") + 1)] for d, t in rows}
    assert {d: [n for n in counts if n is not None] for d, counts in got.items()} == {d: counts[:401] for d, counts in expected.items()}
    for limit in (0, 1, 7, 40):
        fits = tokens.token_counts(frame(spark, rows), VOCABULARY, limit).collect()
        assert {r["doc_id"]: (r["n_tokens"], r["fit_chars"]) for r in fits} == {d: (c[-1], max(i for i, n in enumerate(c) if n <= limit)) for d, c in expected.items()}


def test_blocks_of_counts_that_need_more_than_a_byte():
    counts = np.array([0, 3, 2, 900, 70_000, 5] * 30, np.int32)
    bases, width, steps = tokens.blocked(counts)
    assert width == 4 and (np.repeat(bases, tokens.BLOCK)[: len(counts)] + np.frombuffer(steps, ">u4")).tolist() == counts.tolist()
    assert tokens.blocked(np.arange(200, dtype=np.int32))[1] == 1


# -- 4 -------------------------------------------------------------------------------------------------------------


def test_repeated_passages_equal_brute_force(spark, documents, texts):
    found = bag(sparse.repeated_passages(documents, 50), "doc_id", "start", "end")
    assert found == brute.repeated(texts, 50) and found


def test_repeated_passages_of_nested_and_odd_rows(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    noise = lambda n: [f"n{draw.random()}" for _ in range(n)]
    rows = ODD + [
        (40, " ".join(noise(30) + words[:80] + noise(20))), (41, " ".join(words[20:90] + noise(9))), (42, " ".join(noise(5) + words[5:75])),
        (43, " ".join(noise(90))), (44, " ".join(words[:49])), (45, " ".join(words[100:150])), (46, " ".join(noise(1) + words[100:150] + noise(1) + words[100:150])),
        (47, " ".join(["same"] * 120)), (48, " ".join(["same"] * 70)), (48, "same id, other text"), (49, " ".join(words[200:260] * 2)), (49, " ".join(words[200:260] * 2)),
    ]
    for least in (50, 12):
        assert bag(sparse.repeated_passages(frame(spark, rows), least), "doc_id", "start", "end") == brute.repeated(rows, least)
    assert sparse.repeated_passages(frame(spark, rows).limit(0), 50).count() == 0


@pytest.mark.parametrize("least", [50, 12])
def test_later_copies_go(spark, least):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    noise = lambda n: [f"n{draw.random()}" for _ in range(n)]
    rows = ODD + [
        (40, "\n ".join(noise(30) + words[:80] + noise(20))), (41, " ".join(words[20:90] + noise(9))), (42, "  " + "\t".join(noise(5) + words[5:75] + words[100:170])),
        (43, " ".join(words[60:150])), (44, " ".join(words[100:170] + noise(3) + words[100:170])), (45, " ".join(words[200:260] * 2)), (46, " ".join(words[200:260])),
        (None, " ".join(words[300:360])), (47, " ".join(words[290:370])), (46, " ".join(words[200:260])),
    ] + [(60 + i, " ".join(["é" * (i % 3 + 1)] + words[300:355])) for i in range(40)]
    df = frame(spark, rows).repartition(8)
    left = sparse.drop_later_copies(df, least)
    assert left.columns == df.columns
    expected = brute.without_later_copies(rows, least)
    assert bag(left, "doc_id", "text") == Counter((d, t) for (d, _), t in zip(rows, expected, strict=True))
    assert sum(t != e for (_, t), e in zip(rows, expected, strict=True)) > 45
    assert sparse.drop_later_copies(df.limit(0), least).count() == 0


def test_first_occurrences_over_many_partitions(spark):
    rows = [(p, None if i % 50 == 0 else i // 3, i % 7, i) for p, n in ((-4, 900), (1, 5000), (2, 1), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "passage long, doc_id long, owner long, start int").repartition(8)
    order = lambda r: (r[1] is not None, r[1] or 0, *r[2:])
    first = {p: min((r for r in rows if r[0] == p), key=order) for p in (-4, 1, 2, 3)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        later = sparse.later_occurrences(stored(df, "occurrences"))
        assert Counter(map(tuple, later.collect())) == Counter(r[2:] for r in rows if first[r[0]] != r)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_neighbours_over_many_partitions(spark):
    draw = random.Random(1)
    rows = [(draw.choice([5, 5, 5, draw.randrange(400)]), draw.randrange(60)) for _ in range(3000)] + [(-1, 1)] * 50
    df = stored(spark.createDataFrame(rows, "key long, owner long"), "test")
    owners = defaultdict(set)
    for k, o in rows:
        owners[k].add(o)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions, least in itertools.product((1, 40), (2, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert bag(runs.shared_runs(df, "key", "owner", least), "key", "owner") == Counter(r for r in rows if len(owners[r[0]]) >= least)
            assert bag(runs.shared_runs(df, "key", "owner", least, alone=True), "key", "owner", "shared") == Counter((*r, len(owners[r[0]]) >= least) for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- 5 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("page", "expected"), [
    ("", (0, [])), ("plain &amp; short", (0, ["plain & short"])), ("<p>a<p>b &lt;i&gt; 3 < 4", (0, ["a", "b <i> 3 < 4"])),
    ("<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>m</nav><div class='cookie-banner'>We <b>use</b></div><main><article>"
     "<h1 class=article-header>T &amp;  x</h1><p>One<br>two <a href='>'>lin</a>k</p><div class=\"ad box\">AD<div>x</div></div><script>if (a<b) '</p>'</script><p>Three"
     "<section id=comments><article><p>c</p></article></section><form><p>mail</p></form></article><aside>s</aside><p>not it</p></main><footer>f</footer>", (2, ["T & x", "One two link", "Three"])),
    ("<body><main><h2>H</h2>text<div hidden>no</div><div role=navigation>no</div></main><p>out", (1, ["H", "text"])),
    ("<article><div class=ad>never closed<p>x</article><p>after", (0, ["after"])), ("<article><p>kept<p>cut <b>o", (2, ["kept", "cut o"])),
    ("<p>a<!-- <p>b --><script>c", (0, ["a"])),
])
def test_page_blocks(page, expected):
    assert webtext.blocks(page) == expected


@pytest.mark.parametrize(("page", "expected"), [
    ("<article><p>one<p class=ad>buy<p>two<p>three</article>", (2, ["one", "two", "three"])),
    ("<article><ul><li>a<li class=ad>x<ul><li>y</ul><li>b</ul><p>c</article>", (2, ["a", "b", "c"])),
    ("<article><table><tr><td>a<td class=ad>x<table><tr><td>y</table><td>b<tr class=ad><td>q<td>r<tr><td>c</table><p>end</article>", (2, ["a b", "c", "end"])),
    ("<article><table><tr><td><p class=ad>buy<td>b</table><dl><dt>t<dd><p class=ad>x<dt>u</dl></article>", (2, ["b", "t", "u"])),
    ("<article><div><p class=ad>buy <b>now</b></div>rest</article>", (2, ["rest"])), ("<article><p class=ad>x</b> y</p>kept</article>", (2, ["kept"])),
    ("<main><p>the long story of the day is here<article><p>card</article><p>goes on</main><p>f", (1, ["the long story of the day is here", "card", "goes on"])),
    ("<div><p>the long story of the day is here</div><article>card</article>", (0, ["the long story of the day is here", "card"])),
    ("<main>the long story of the day</main><article>card</article>", (1, ["the long story of the day"])),
    ("<main>short</main><article>a far longer story</article>", (1, ["short", "a far longer story"])),
])
def test_omitted_end_tags_and_small_articles_lose_no_story(page, expected):
    assert webtext.blocks(page) == expected


def test_shared_strings_of_a_host_go(spark):
    shared = "Subscribe to our weekly letter and never miss a single story again"
    story = lambda i: " ".join(f"word{i * 20 + k}" for k in range(15))
    pages = [(i, f"https://A.example/{i}", f"<p>{shared}</p><p>{story(i)}</p>") for i in range(5)]
    pages += [(10, "https://b.example/1", f"<p>{shared}</p><p>Own.</p>"), (11, None, None), (12, "no url", ""), (13, "https://a.example/x", f"<p>{shared}</p>")]
    pages += [(i, "https://a.example/m", f"<article><p>{shared}</p></article>") for i in (14, 15, 16)]
    df = frame(spark, pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in webtext.extract(df).collect()}
    assert got == {i: story(i) for i in range(5)} | {10: f"{shared}\nOwn.", 11: "", 12: "", 13: shared, 14: shared, 15: shared, 16: shared}
    assert webtext.extract(df.limit(0)).count() == 0


def test_phrases_and_copies_on_large_hosts_stay(spark):
    say = lambda tag, n: " ".join(f"{tag}w{k}" for k in range(n))
    menu, phrase, story = say("menu", 20), say("phrase", 10), say("story", 60)
    pages = [(i, "https://big.example/", f"<p>{menu}</p><p>{say(i, 30)}</p>") for i in range(60)]
    pages += [(100 + i, "https://big.example/", f"<p>{menu}</p><p>{say(100 + i, 30)} {phrase}</p>") for i in range(5)]
    pages += [(200 + i, "https://big.example/", f"<p>{story}</p><p>on day {i}</p>") for i in range(3)]
    pages += [(300 + i, "https://big.example/", f"<p>{say(300, 40)}</p>") for i in range(30)]
    pages += [(400 + i, "https://small.example/", f"<p>{story}</p><p>on day {i}</p>") for i in range(3)]
    pages += [(500 + i, "https://little.example/", f"<p>{menu}</p><p>{say(500 + i, 15)} {phrase}</p>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in webtext.extract(frame(spark, pages, "page_id long, url string, html string")).collect()}
    expected = {i: say(i, 30) for i in range(60)} | {100 + i: f"{say(100 + i, 30)} {phrase}" for i in range(5)} | {300 + i: say(300, 40) for i in range(30)}
    expected |= {k + i: f"{story}\non day {i}" for k in (200, 400) for i in range(3)} | {500 + i: f"{say(500 + i, 15)} {phrase}" for i in range(4)}
    assert got == expected


def test_articles_of_the_given_pages(spark):
    df = webtext.extract(spark.read.parquet(f"{SF}/pages.parquet"))
    assert df.where("n_chars <> length(text) OR text RLIKE '  |^\\\\s|track\\\\('").count() == 0 and df.where("n_chars > 0").count() == 50


def test_pages_that_mark_an_article_go_through_the_suffix_array(spark):
    say = lambda tag, n: " ".join(f"{tag}w{k}" for k in range(n))
    menu, same = say("menu", 90), say("same", 20)
    pages = [(i, "https://a.example/", f"<p>{menu}</p><p>day {i}</p><article><p>{same}</p><p>{say(i, 30)}</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in webtext.extract(frame(spark, pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{same}\n{say(i, 30)}" for i in range(6)}  # the menu is more text than the article, but no text of the page
    texts = [(i, f"h{i % 2}", i, f"{menu} {say(i, 30)}") for i in range(8)]
    places = {r["owner"]: set(r["places"]) for r in webtext.boilerplate(frame(spark, texts, "owner long, host string, row long, text string")).collect()}
    assert places == {i: set(range(83)) for i in range(8)}


def test_neighbours_of_a_suffix_array_share_words(spark):
    assert [runs.common_words(a, b) for a, b in (("a b c", "a b c"), ("a b c", "a b d"), ("a b", "ab b"), ("a", "a b"))] == [3, 2, 0, 1]
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abc") for _ in range(4)), rng.randint(0, 9)) for _ in range(300)]
    owners = defaultdict(set)
    for key, owner in rows:
        owners[" ".join(key.split(" ")[:4])].add(owner)
    got = bag(runs.shared_runs(spark.createDataFrame(rows, "key string, owner long"), "key", "owner", 5, words=4), "key", "owner")
    assert got == Counter(r for r in rows if len(owners[r[0]]) >= 5)


STORY = "<p>The long story of the day.</p><p>It goes on for a while.</p>"
TOLD = ["The long story of the day.", "It goes on for a while."]


@pytest.mark.parametrize(("page", "expected"), [
    (f'<div class="container has-sidebar"><article>{STORY}</article></div><footer>f</footer>', (2, TOLD)),
    (f'<div id="content-ad-free">{STORY}</div><footer>f</footer>', (0, TOLD)), (f'<div class="comment-free">{STORY}</div>', (0, TOLD)),
    (f'<div class="sidebar"><main>{STORY}</main></div><p>x', (1, TOLD)), (f'<form><article>{STORY}</article></form>', (2, TOLD)), (f'<div class="modal"><div class="banner">{STORY}</div></div><p>x', (0, [*TOLD, "x"])),
    (f'<div class="comments">{STORY}</div><p>x', (0, ["x"])), (f"<div hidden>{STORY}</div><p>x", (0, ["x"])), (f'<nav>{STORY}</nav><p>x', (0, ["x"])),
    (f'<aside class="sidebar"><article>card</article></aside><article>{STORY}</article>', (2, TOLD)), (f'<div class="ad-slot">buy</div><div class="sidebar_left">s</div><div class="cookie-notice">c</div>{STORY}', (0, TOLD)),
    (f'{STORY}<div class="foo', (0, TOLD)), (f'{STORY}<div class="foo bar', (0, TOLD)), (f'{STORY}<div', (0, TOLD)), (f"{STORY}</", (0, TOLD)), (f"{STORY}<", (0, TOLD)),
    (f'<article>{STORY}<a href="x>', (2, TOLD)), (f'<a title=\'it>{STORY}', (0, TOLD)), ("<p>3 < 4 and 5 <6", (0, ["3 < 4 and 5 <6"])),
])
def test_wrappers_and_cut_tags_lose_no_story(page, expected):
    assert webtext.blocks(page) == expected


def plain_main_text(pages):
    """Host-wise, with all windows of all pages at hand; (page_id, host, blocks) rows."""
    hosts = defaultdict(set)
    for _, host, parts in pages:
        hosts[host].add(tuple(parts))
    out = {}
    for page, host, parts in pages:
        holding = Counter()
        for other in hosts[host]:
            words = [w for b in other for w in b.split(" ")] if other else []
            holding.update({tuple(words[i : i + 8]) for i in range(len(words) - 7)})
        least = max(3, len(hosts[host]) // 10 + 1)
        words = [w for b in parts for w in b.split(" ")]
        covered = [False] * len(words)
        for i in range(len(words) - 7):
            if holding[tuple(words[i : i + 8])] >= least:
                covered[i : i + 8] = [True] * 8
        kept, at, left = [], 0, 0
        for block in parts:
            own = block.split(" ")
            gone = covered[at : at + len(own)]
            at += len(own)
            stay = own if 2 * sum(gone) <= len(own) else [w for w, c in zip(own, gone, strict=True) if not c]
            left += len(stay)
            kept += [" ".join(stay)] if stay else []
        out[page] = "\n".join(kept if left >= 8 or not any(covered) else parts)
    return out


def test_unmarked_pages_equal_a_plain_host_wise_version(spark):
    rng = random.Random(12)
    menu = " ".join(f"menu{k}" for k in range(12))
    given = [(r["page_id"], r["html"].replace("<article", "<div").replace("</article", "</div")) for r in spark.read.parquet(f"{SF}/pages.parquet").where("html IS NOT NULL").collect()]
    pages = []
    for i, (page, text) in enumerate(given):  # a host with half of all pages, and small ones; menus, notes and near copies
        site = "hot" if i % 2 else f"h{i % 5}"
        extra = f"<p>{menu}</p>" if rng.random() < 0.7 else ""
        pages.append((page, f"http://{site}/", f"{extra}{text}"))
        if rng.random() < 0.3:
            pages.append((10_000 + page, f"http://{site}/", f"{extra}{text}<p>seen on day {page} by {rng.random()}</p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parts = [(p, u.split("/")[2], webtext.blocks(h)) for p, u, h in pages]
    assert all(level == 0 for *_, (level, _) in parts)
    got = {r["page_id"]: r["text"] for r in webtext.extract(df).collect()}
    expected = plain_main_text([(p, s, b) for p, s, (_, b) in parts])
    assert got == expected and any(menu in h and menu not in expected[p] for p, _, h in pages)


# -- 6 -------------------------------------------------------------------------------------------------------------


def check_packing(pieces, rows, library, size=1024):
    expected = Counter()
    for doc, text in rows:
        expected[doc, tuple([*library.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    sequences, documents = defaultdict(dict), defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        sequences[p["sequence_id"]][p["offset"]] = p["length"]
        documents[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
    for filled in sequences.values():
        end = 0
        for offset in sorted(filled):
            assert offset == end
            end += filled[offset]
        assert end <= size and end & (end - 1) == 0
    assert sum(k[1] * n for k, n in Counter((d, len(ids)) for (d, ids), n in expected.items() for _ in range(n)).items()) == sum(p["length"] for p in pieces)
    for (doc, total), parts in documents.items():
        copies = sum(n for (d, ids), n in expected.items() if d == doc and len(ids) == total)
        assert sum(len(ids) for _, ids in parts) == copies * total
        if copies == 1:
            parts.sort()
            assert expected[doc, tuple(x for _, ids in parts for x in ids)] == 1


def test_packing_holds_every_id_once(spark, documents, texts, library):
    check_packing(packing.pack(documents, VOCABULARY).collect(), texts, library)


def test_packing_odd_rows_and_empty_table(spark, library):
    df = frame(spark, ODD)
    check_packing(packing.pack(df, VOCABULARY, 64).collect(), ODD, library, 64)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_packing_takes_millions_of_blanks(spark, library):
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 2_000_000 + "b"), (3, "short one"), (4, "x" + " \n\t" * 700_000 + "\x1c y"), (5, "é" + " " * 1_200_000)]
    check_packing(packing.pack(frame(spark, rows), VOCABULARY).collect(), rows, library)


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[range(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_repeated_rows_are_spread(spark):
    rows = [(7, "same words again " * 40)] * 2000 + [(i, f"text {i} " * 30) for i in range(2000)]
    tokens_in = Counter()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), VOCABULARY).select("sequence_id", "length").collect():
            tokens_in[p["sequence_id"] >> 32] += p["length"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tokens_in) >= 8 and max(tokens_in.values()) < 3 * sum(tokens_in.values()) / len(tokens_in)


# -- 7 -------------------------------------------------------------------------------------------------------------


def judged_plainly(rows):
    """kept by the same estimates, in numpy. Rows: (lang, source, statistics)."""
    units = np.array(list(rules.STATISTICS.values()))
    base = [(n < 50 or 100 * rep > 50 * n) for *_, (n, _, _, _, rep) in rows]
    values = []
    for *_, (n, chars, symbols, dup, rep) in rows:
        n1 = max(n, 1)
        raw = np.array([np.log1p(n), np.log(max(chars, 1) / n1), np.log1p(100 * symbols / n1), np.log1p(100 * dup / n1), np.log1p(100 * rep / n1)])
        values.append(np.floor(raw / units * rules.PARTS + 0.5))
    values, verdict = np.array(values), [False] * len(rows)
    for group in {r[:2] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[:2] == group and not base[i]]
        if not own:
            continue
        x, width = values[own], rules.PARTS // rules.COARSE
        bins, points = np.sort(np.floor(x / width), axis=0), x / rules.PARTS
        at = lambda q: bins[int(np.ceil(q * len(own))) - 1]
        middle, spread = (at(0.5) + 0.5) / rules.COARSE, (at(0.75) - at(0.25)) / rules.COARSE / 1.349
        unit = np.sqrt(spread**2 + 1)
        z = (points - middle) / unit
        signs = z / np.sqrt(np.maximum((z**2).sum(axis=1), 1e-12))[:, None]
        starts = [(middle, np.diag(spread**2)), (middle, signs.T @ signs / len(own) * 5 * np.outer(unit, unit)), (points.mean(axis=0), np.cov(points.T, bias=True))]

        def distances(estimate, points=points):
            d = points - estimate[0]
            return (d @ np.linalg.inv(estimate[1] + np.eye(5)) * d).sum(axis=1)

        def step(estimate, points=points):
            b = np.floor(rules.FINE * np.log2(np.clip(distances(estimate, points), 2.0**-20, 2.0**20)))
            near = points[b <= np.sort(b)[int(np.ceil(rules.SUPPORT * len(points))) - 1]]
            return near.mean(axis=0), np.cov(near.T, bias=True) * rules.CONSISTENCY

        determinant = lambda e: np.linalg.slogdet(e[1] + np.eye(5))[1]
        best = min((step(step(e)) for e in starts), key=determinant)
        while determinant(after := step(best)) < determinant(best) - rules.FALL:
            best = after
        for i, d in zip(own, distances(best), strict=True):
            verdict[i] = bool(d <= rules.CUTOFF)
    return base, verdict


def test_quality_rules_equal_plain_versions(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["lang"], r["source"] if r["doc_id"] % 7 else None, brute.statistics(r["text"]), r["doc_id"]) for r in given.collect()]
    df = given.withColumn("source", F.expr("CASE WHEN doc_id % 7 <> 0 THEN source END"))
    base, verdict = judged_plainly([r[:3] for r in rows])
    expected = {d: (*s, b, v) for (_, _, s, d), b, v in zip(rows, base, verdict, strict=True)}
    got = {r[0]: tuple(r)[1:8] for r in rules.judge(df).collect()}
    assert got == expected
    assert 0 < sum(verdict) < len(base) - sum(base)


def test_quality_rules_of_odd_rows(spark):
    rows = [(d, t, None if k % 2 else "en", None if k % 3 else "s") for k, (d, t) in enumerate(ODD + [(50, "dup line\n" * 30), (51, "a b c a b c x")])]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    got = bag(rules.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(k[:6] for k in got.elements()) == Counter((d, *brute.statistics(t)) for d, t, *_ in rows)
    assert {k[0] for k in got if k[7]} == {8, 9} and all(k[6] is not None and k[7] is not None for k in got)
    assert rules.judge(df.limit(0)).count() == 0


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_line_dedup_of_odd_rows(spark):
    rows = [(None if k % 5 == 4 else f"s{k % 2}", f"menu\n {k} \n\nown {k % 3}\r\nmenu " if k % 4 else t) for k, (_, t) in enumerate(ODD * 2)]
    df = frame(spark, [(k, *r) for k, r in enumerate(rows)], "doc_id long, source string, text string")
    expected = brute.without_boilerplate(rows, 0.3, 3)
    got = lines.drop_boilerplate(df, "source", ratio=0.3)
    assert got.columns == df.columns and {r["doc_id"]: r["text"] for r in got.collect()} == dict(enumerate(expected))
    counted = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.line_dedup(df, ratio=0.3).collect()}
    assert counted == {k: (0, 0) if t is None else (t.count("\n") + 1, t.count("\n") + 1 - (x.count("\n") + 1 if x or not t else 0)) for k, ((_, t), x) in enumerate(zip(rows, expected, strict=True))}
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_copies_make_no_line_boilerplate(spark):
    article = lambda k: "\n".join(f"line {i} of article {k} says {k * 31 + i}" for i in range(6))
    rows = [(i, "big", f"menu\n{article(i)}") for i in range(40)] + [(100 + i, "big", article(500)) for i in range(20)] + [(200 + i, "small", article(600)) for i in range(5)]
    got = lines.line_dedup(frame(spark, rows, "doc_id long, source string, text string"), once=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {d: t.removeprefix("menu\n") for d, _, t in rows}


# -- 9 -------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = lambda y: np.mean([r["predicted"] == y for r in rows if r["quality"] == y])
    assert right(1) >= 0.98 and right(0) >= 0.8
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(3), labels).where("held_out").collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_classifier_gradients():
    draw = np.random.default_rng(0)
    x, first, y, w = draw.standard_normal((9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), quality.start()
    loss = lambda: -np.mean(y * np.log(p := quality.forward(w, x, first)["p"]) + (1 - y) * np.log(1 - p))
    for name, slope in quality.gradients(w, x, first, y).items():
        at = tuple(draw.integers(0, n) for n in w[name].shape)
        kept, found = w[name][at], []
        for step in (1e-5, -1e-5):
            w[name][at] = kept + step
            found.append(loss())
        w[name][at] = kept
        assert abs((found[0] - found[1]) / 2e-5 - slope[at]) < 1e-6, name


def test_long_texts_are_scored_whole(monkeypatch):
    bags = [quality.encode(t.encode()) for t in (LONG[:5000], "LOUD!! " * 300, LONG[5000:9000], "### $$$ " * 90)]
    w = quality.fit(bags, np.array([1.0, 0.0, 1.0, 0.0]))
    whole = quality.probability(w, LONG.encode())
    monkeypatch.setattr(quality, "SLICE", 7)
    x = quality.encode(LONG.encode())
    assert abs(quality.probability(w, LONG.encode()) - whole) < 1e-3 and len(x) == -(-len(LONG.encode()) // quality.PASSAGE)


def test_training_takes_whole_texts_within_its_bound(spark, monkeypatch):
    rows, labels = [(i, f"word{i} " * (40 * i)) for i in range(1, 30)], [(i, i % 2) for i in range(1, 30)]
    size = {d: -(-len(t.encode()) // quality.PASSAGE) for d, t in rows}
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append([len(b) for b in bags]) or {})
    for bound in (10**6, 60, 1):
        quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), passages=bound)
    kept = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5]
    assert sorted(seen[0]) == sorted(size[d] for d in kept) and sum(seen[1]) <= 60 < sum(seen[0]) and not Counter(seen[1]) - Counter(seen[0]) and seen[2:] in ([], [[1]])


def test_classifier_of_odd_rows(spark):
    df, labels = frame(spark, ODD), frame(spark, [(1, 0), (1, 1), (6, 1), (None, 1), (8, None), (99, 0), (10, 0)], "doc_id long, quality int")
    rows = quality.classify(df, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.accepted(df, labels).columns == df.columns


# -- 10 ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_masks(spark):
    marks = 'say "</turn>\n" \\b \\\\l <turn role="user"> é日'
    rows = [
        (1, 0, "system", marks), (1, 1, "user", None), (1, 2, "assistant", marks), (1, 3, "user", ""), (1, 4, "assistant", "b\n"), (1, 5, "user", "tail"),
        (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (None, 0, "assistant", "x"), (None, None, None, "y"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"),
        (5, 0, '"> <odd\\role', "z"),
    ]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string")
    examples = stored(chat.examples(df), "test")
    said = defaultdict(list)
    for c, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        said[c].append((r or "", t or ""))
    read = examples.select("conv_id", "example", chat.parsed(F.col("formatted")).alias("turns"), chat.trained(F.col("formatted"), F.col("mask_start"), F.col("mask_end")).alias("loss")).collect()
    for conv, turns in said.items():
        own = sorted((r for r in read if r["conv_id"] == conv), key=lambda r: r["example"])
        ends = [i for i, (role, _) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        assert [[tuple(t) for t in r["turns"]] for r in own] == [turns[: i + 1] for i in ends]
        assert [r["loss"] for r in own] == [turns[i][1] if turns[i][0] == "assistant" else None for i in ends]
    for r in chat.digests(examples).collect():
        turns = said[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.examples(df.limit(0))).count() == 0
