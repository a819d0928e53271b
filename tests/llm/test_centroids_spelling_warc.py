"""Centroids, spelling variants and archives against plain versions, planted damage and the cases their docstrings define."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeline.llm import centroids, spelling, warc
from gaugeline.session import work_dir

CLASHING = "cluster int, distance long, v int, h string, word string, n long, entry long, run string, doc string, digest string, payload string, archive string, largest long"


def frame(spark, rows, columns):
    """Rows with further columns whose names the operators use themselves, and one with a dot."""
    df = spark.createDataFrame(rows, columns)
    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1).cast(kind))
    return df.withColumn("a.b", F.lit(1))


# -- 11 ------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    seats = [list(v) for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, s), c) for c, s in enumerate(seats))[::-1]
    for _ in range(rounds):
        of = [nearest(v)[0] for _, v in kept]
        for c in range(len(seats)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                seats[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(seats[c])) for i, c, d in found)


def clustered(df, **options):
    rows = centroids.cluster(df, dimensions=3, **options).collect()
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], None if r["centroid"] is None else tuple(r["centroid"])) for r in rows)


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 4, 0.4) for _ in range(3)]) for i in range(400)] + [(7, [0.5, 0.5, 0.5])] * 200 + [(i, [900.0, -900.0, i / 3]) for i in range(9)]
    rows += [(None, [1.0, 2.0, 3.0]), (-1, None), (-2, []), (-3, [1.0, 2.0]), (-4, [1.0, None, 2.0]), (-5, [math.nan, 0.0, 0.0]), (-6, [math.inf, 0.0, 0.0])]
    df = frame(spark, rows, "vec_id long, embedding array<double>").repartition(7)
    for k, rounds in ((16, 3),):
        assert clustered(df, k=k, rounds=rounds) == plain_clusters(rows, k, rounds)


def test_few_wide_and_no_vectors(spark):
    columns = "vec_id long, embedding array<float>"
    two = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])]
    assert clustered(frame(spark, two, columns)) == plain_clusters(two, 16, 3)
    wide = [(3, [3e30, 0.0, 0.0]), (4, [0.0, -4e6, 0.0])]
    assert clustered(frame(spark, two + wide, columns)) == plain_clusters(two, 16, 3) + Counter((i, None, None, None, None, None) for i in (3, 4))
    assert clustered(frame(spark, wide, columns)) == Counter((i, None, None, None, None, None) for i in (3, 4))
    assert not clustered(frame(spark, [], columns))
    equal = [(i, [2.0, 2.0, 2.0]) for i in range(40)]
    assert clustered(frame(spark, equal, columns)) == plain_clusters(equal, 16, 3)


def test_tables_give_exact_distances():
    rng = np.random.default_rng(3)
    for spread in (3, 10**6, centroids.WIDEST - 1):
        block, seats = rng.integers(-spread, spread + 1, (50, 64)), rng.integers(-spread, spread + 1, (5, 64))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for s in seats] for v in block]
        nearest, distance = centroids.table_distances(block, seats)
        assert nearest.tolist() == [row.index(min(row)) for row in exact] and distance.tolist() == [min(row) for row in exact]


# -- 12 ------------------------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        found = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(found, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, n, len(found), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(rng):
    """Random words over few letters, runs of one letter, and one edit of each kind at each place of some."""
    some = {"".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(120)} | {c * n for c in "aé" for n in range(6, 14)}
    for word in ("hospital", "organise", "ababababab", "straße", "a" * 20):
        some.add(word)
        for i in range(len(word) + 1):
            some |= {word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[:i] + "ÿ" + word[i + 1 :]}
    return sorted(w for w in some if len(w) >= 6)


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(11)
    counts = {w: rng.choice([5, 6, 30, 31, 160, 900, 5000]) for w in vocabulary(rng)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert as_dict(spelling.grouped(df)) == plain_variants(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=6, max_size=12), st.integers(0, 12), st.sampled_from("abc"), st.sampled_from(["in", "out", "for"]), st.permutations(["aa", "ab", "ba", "bb"]))
def test_one_edit_keeps_a_common_entry(word, place, letter, kind, rare):
    at = min(place, len(word) - 1)
    other = {"in": word[:at] + letter + word[at:], "out": word[:at] + word[at + 1 :], "for": word[:at] + letter + word[at + 1 :]}[kind]
    order = {a + b: (rare.index(a + b) if a + b in rare else 9, a + b) for a, b in itertools.product("abc", repeat=2)}
    one, two = (w for w in (word, other))
    assert spelling.pivot_entries(one, order) & spelling.prefix_entries(two, order) or spelling.pivot_entries(two, order) & spelling.prefix_entries(one, order)


def test_pivots_are_the_cheapest_that_do_not_overlap():
    rng = random.Random(2)
    for _ in range(500):
        places = rng.sample(range(8), 3)
        cost = [rng.randint(1, 9) for _ in places]
        chosen = spelling.pivots(places, cost)
        price = dict(zip(places, cost, strict=True))
        allowed = [pair for pair in itertools.combinations(places, 2) if abs(pair[0] - pair[1]) >= 2]
        assert abs(chosen[0] - chosen[1]) >= 2 and sum(price[p] for p in chosen) == min(sum(price[p] for p in pair) for pair in allowed)


def test_words_follow_the_deletion_rule(spark):
    text = "Größeres HOSPITAL hospitals, ÀÉÎõü÷x organise x1organise2 short " * 7
    rows = [(i, text) for i in range(300)] + [(None, text), (3, None), (4, ""), (5, "q" * 5000)] + [(9, "w" * 20_000)] * 5
    counts: Counter = Counter()
    for doc, body in rows:
        for run in spelling_runs(body or ""):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = frame(spark, rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.words(df).collect()} == expected and len(expected) > 8
    assert as_dict(spelling.variants(df)) == plain_variants(expected)
    assert spelling.variants(df.limit(0)).count() == 0


def spelling_runs(text: str):
    import re
    return re.findall("[a-zÀ-ÿ]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_chains_of_forms_reach_their_root(spark):
    chain = [(f"word{i}", f"word{i + 1}") for i in range(37)] + [(f"leaf{i}", "word3") for i in range(50)]
    found = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(found.values()) == {"word37"} and len(found) == 87


# -- 13 ------------------------------------------------------------------------------------------------------------


LONG = "<p>" + "gleich " * 400
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://b/ x\r\nEvil: 1", LONG), (4, None, "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
    (None, "n", LONG), (8, "é", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 60), (9, "z", "\0\x1f\u008b" * 500), (10, "big", "ab" * 9_000_000), (11, "m", "M" * 1000),
    (12, "m", "M" * 1000), (12, "m", "M" * 1000), (13, "m", "M" * 999), (14, "m", "M" * 999),
]


def expected_pages(rows):
    largest: dict[bytes, int] = {}
    for page, _, text in rows:
        body = (text or "").encode()
        if len(body) >= 1000 and page is not None:
            largest[body] = max(page, largest.get(body, page))
    out = Counter()
    for page, _, text in rows:
        body = (text or "").encode()
        to = largest.get(body)
        to = None if to == page else to
        out[page, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def summary(records):
    return Counter(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()))


@pytest.mark.parametrize("full", [1, 3000, warc.ARCHIVE])
def test_archives_are_read_back(spark, full):
    path = work_dir(spark, "warc")
    warc.write(frame(spark, PAGES, "page_id long, url string, html string").repartition(3), path, full=full)
    records = warc.read(spark, path)
    assert records.where("reason IS NOT NULL").count() == 0 and summary(records) == expected_pages(PAGES)
    texts = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in warc.resolved(records).collect())
    assert texts == Counter((i, t or "") for i, _, t in PAGES)
    names = {r["page_id"]: r["fields"] for r in records.collect()}
    assert names[3]["warc-refers-to"] == warc.record_name(3, hashlib.sha1(LONG.encode()).hexdigest()) if names[3]["warc-type"] == "revisit" else True
    assert "evil" not in names[3]


def test_no_pages_and_other_names(spark):
    path = work_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def sample(n=6, packed=True):
    """Some records, as members or plain, and where each begins."""
    rng = random.Random(n)
    bodies = [bytes(rng.choices(range(256), k=rng.randint(0, 3000))) for _ in range(n)]
    parts = [warc.page_record(i, "u", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    return [warc.member(p) if packed else p for p in parts], bodies


def scan(data):
    whole, gaps, at = [], [], 0
    for start, end, reason, found in warc.salvage(data):
        assert start == at and end > start, "records and gaps follow on each other"
        at = end
        (gaps.append((start, end, reason)) if found is None else whole.append(int(found.fields["page-id"])))
    assert at == len(data)
    return whole, gaps


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_the_damaged_record_only(packed):
    parts, _ = sample(6, packed)
    data, starts = b"".join(parts), list(itertools.accumulate(map(len, parts), initial=0))
    assert scan(data) == ([*range(6)], [])
    rng = random.Random(1)
    for _ in range(300):  # a changed byte
        at = rng.randrange(len(data))
        if not packed and at < data.index(b"HTTP/1.1", max(s for s in starts if s <= at)):
            continue  # a plain header has no digest
        hit = max(i for i in range(6) if starts[i] <= at)
        broken = data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :]
        whole, gaps = scan(broken)
        assert [i for i in whole if i != hit] == [i for i in range(6) if i != hit]
        assert whole.count(hit) or [g[:2] for g in gaps] == [(starts[hit], starts[hit + 1])]
    for cut in range(0, len(data), 97):  # cut off in the middle
        whole, gaps = scan(data[:cut])
        assert whole == [i for i in range(6) if starts[i + 1] <= cut] and [g[:2] for g in gaps] == ([] if cut in starts else [(max(s for s in starts if s <= cut), cut)])
    for junk in (b"x", b"\0" * 500, warc.MEMBER, b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\n", b"\x1f\x8b\x08\0" * 50):  # bytes between records
        whole, gaps = scan(b"".join(parts[:3]) + junk + b"".join(parts[3:]))
        assert whole == [*range(6)] and [g[:2] for g in gaps] == [(starts[3], starts[3] + len(junk))]
        assert scan(junk + data)[0] == scan(data + junk)[0] == [*range(6)]
    whole, gaps = scan(data[: starts[2] - 5] + data[starts[2] :])  # missing bytes
    assert whole == [0, 2, 3, 4, 5] and [g[:2] for g in gaps] == [(starts[1], starts[2] - 5)]


def test_records_inside_a_damaged_record_are_not_taken_for_records():
    inner = warc.page_record(99, "u", b"x", hashlib.sha1(b"x").hexdigest(), None)
    outer = warc.page_record(1, "u", b"A" + inner + b"B", hashlib.sha1(b"A" + inner + b"B").hexdigest(), None)
    after = warc.page_record(2, "u", b"y", hashlib.sha1(b"y").hexdigest(), None)
    assert scan(outer + after) == ([1, 2], [])
    place = outer.index(b"AWARC")
    whole, gaps = scan(outer[:place] + b"C" + outer[place + 1 :] + after)
    assert whole == [2] and gaps == [(0, len(outer), "block digest")]


def test_mixed_archives_digest_forms_and_several_records_in_a_member():
    (a, b, c), bodies = sample(3, False)
    data = warc.member(a + b) + c + warc.member(b"") + warc.member(b) + a
    assert [int(f.fields["page-id"]) for *_, f in warc.salvage(data) if f] == [0, 1, 2, 1, 0]
    hexed = hashlib.sha1(b"x").hexdigest()
    assert warc.unlabelled(warc.labelled(hexed)) == warc.unlabelled("SHA1:" + hexed.upper()) == hexed and warc.unlabelled("md5:00") is None


def test_gaps_of_files_are_logged(spark, tmp_path):
    parts, bodies = sample(5)
    (tmp_path / "one.warc.gz").write_bytes(parts[0] + b"noise" + parts[1] + parts[2][:-9])
    (tmp_path / "two.warc.gz").write_bytes(parts[3] + parts[4])
    (tmp_path / "none.warc.gz").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path)).collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in rows if r["reason"] is None} == {(i, bodies[i]) for i in (0, 1, 3, 4)}
    gaps = [(r["archive"].rsplit("/", 1)[1], r["offset"], r["length"]) for r in rows if r["reason"]]
    assert sorted(gaps) == [("one.warc.gz", len(parts[0]), 5), ("one.warc.gz", len(parts[0]) + 5 + len(parts[1]), len(parts[2]) - 9)]
