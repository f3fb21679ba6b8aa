import re
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import leakage
from mediaframe.llm.canonical import map_to_canonical
from mediaframe.llm.consolidate import consolidate, group_table
from mediaframe.llm.frequency import term_frequencies
from mediaframe.llm.history import PREFIX, HashIndex, _representatives, dedup_batches, loads_of
from mediaframe.llm.leakage import leaked_windows
from mediaframe.llm.mixing import copies_membership, mix_report, select_documents
from mediaframe.llm.split import TOKEN, boundaries, split_oversized, split_text
from mediaframe.llm.survivor import elect_values, most_trusted


def greedy(hashes):
    kept, out = [], set()
    for i, h in hashes:
        if h is None or len(h) != 32:
            continue
        near = [k for k, g in kept if bin(int.from_bytes(h) ^ int.from_bytes(g)).count("1") <= 10]
        if near:
            out.add((near[0], i))
        else:
            kept.append((i, h))
    return out


def history_rows(n=90, seed=0):
    rng = np.random.default_rng(seed)
    base, data = [rng.bytes(32) for _ in range(6)], [(0, None), (1, b"short")]
    for i in range(2, n):  # chains and one hot cluster
        bits = int.from_bytes(base[0 if i % 3 == 0 else int(rng.integers(6))])
        for b in rng.integers(0, 256, int(rng.integers(0, 9))):
            bits ^= 1 << int(b)
        data.append((i, bits.to_bytes(32)))
    return data


@pytest.mark.parametrize("hot_rows, few_rows", [(1000, 2000), (1000, 0), (2, 0), (2, 5)])
def test_history(spark, hot_rows, few_rows):
    data = history_rows()
    rows = spark.createDataFrame([(i, i // 20, h, "x") for i, h in data], "hash_id bigint, batch_no int, hash binary, id string")
    assert {tuple(r) for r in dedup_batches(rows, index=HashIndex(spark, hot_rows=hot_rows, few_rows=few_rows)).collect()} == greedy(data)
    assert dedup_batches(rows.limit(0)).collect() == []


def test_history_of_hashes_that_agree_in_half_of_their_bits(spark):
    rng = np.random.default_rng(7)
    data = []
    for i in range(150):
        h = b"\0" * 16 + rng.bytes(16) if i % 4 else data[int(rng.integers(len(data)))][1] if data else rng.bytes(32)
        bits = int.from_bytes(h)
        for b in rng.integers(0, 256, int(rng.integers(0, 12)) if i % 4 == 0 else 0):
            bits ^= 1 << int(b)
        data.append((i, bits.to_bytes(32)))
    rows = spark.createDataFrame([(i, i // 50, h) for i, h in data], "hash_id bigint, batch_no int, hash binary")
    found = {tuple(r) for r in dedup_batches(rows, index=HashIndex(spark, hot_rows=5, few_rows=0)).collect()}
    assert found == greedy(data) and len(found) > 15


def test_history_of_strangers_under_the_same_tokens(spark):
    """Each token is shared by six rows that are not near: that must not take a round for each of them."""
    rng = np.random.default_rng(11)
    widths = (22, 21, 21) * 4
    values, data = [[int(x) for x in rng.integers(0, 1 << w, 50)] for w in widths], []
    for i in range(300):
        if i % 10 == 9:
            bits = int.from_bytes(data[int(rng.integers(i))][1], "little")
            for b in rng.integers(0, 256, int(rng.integers(0, 12))):
                bits ^= 1 << int(b)
        else:
            bits, shift = 0, 0
            for w, of_place in zip(widths, values):
                bits |= of_place[int(rng.integers(50))] << shift
                shift += w
        data.append((i, bits.to_bytes(32, "little")))
    rows = spark.createDataFrame(data, "id bigint, hash binary")
    spark.sparkContext.setJobGroup("strangers", "")
    found = {tuple(r) for r in HashIndex(spark, few_rows=0).ingest(rows).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("strangers"))
    assert found == greedy(data) and len(found) > 15
    assert jobs < 100


def test_history_opens_again(spark, tmp_path):
    data, path, found = history_rows(60), str(tmp_path / "index"), set()
    rows = spark.createDataFrame([(i, h) for i, h in data], "id bigint, hash binary")
    for b in range(3):
        index = HashIndex(spark, path, parts=64 if b == 0 else 3)
        assert index.parts == 64
        found |= {tuple(r) for r in index.ingest(rows.filter(F.floor(F.col("id") / 20) == b)).collect()}
    assert found == greedy(data)
    first = spark.createDataFrame([(100, data[2][1])], "id bigint, hash binary")
    assert [r.dup_id for r in HashIndex(spark, path).ingest(first).collect()] == [100]


def test_history_reads_only_the_parts_of_a_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    index = HashIndex(spark, str(tmp_path / "index"), parts=64)
    index.ingest(spark.createDataFrame([(i, rng.bytes(32)) for i in range(400)], "id bigint, hash binary"))
    one = _representatives(spark.createDataFrame([(1000, rng.bytes(32), 0)], "id bigint, hash binary, load int"))
    parts = index.touched(index.keyed(one))
    assert len(parts) <= PREFIX and set(parts) == {r.part for r in index.postings(parts).select("part").distinct().collect()}
    plan = index.postings(parts)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    # a generation without the mark of a finished write is not read
    (tmp_path / "index" / "gen=00000001").mkdir()
    assert index._generations() == ["gen=00000000"]


def test_loads():
    assert loads_of({}) == [] and loads_of({3: 5}) == [3] and loads_of({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}) == [1, 5, 6]


def test_canonical(spark, rows):
    ref = [(1, "Velmora", "Emberstone 120", None, "VEE-3323"), (2, "Velmora", "Emberstone 120 Mark II", "Kazenoko K1", "VEE-1000"), (3, "Kestrin", "Emberstone 120", None, "KEE-1")]
    items = [
        ("Velmora", "Emberstone 120"), ("velmora", "ＥＭＢＥＲＳＴＯＮＥ　１２０"), ("Velmroa", "Embertsone 120 camera"), ("Velmora", "Emberstone 130"), ("Velmora", "Emberstone120mk2"),
        ("Emberstone 120 II", "Velmora GmbH"), (None, "KazenokoK1"), (None, "KazenokoV1"), ("Kestrin", "Velmora Emberstone 120"), ("Velmora", "Emberstone 120 Pro"),
        ("Velmora", "vee 3323"), (None, "Emberstone 120"), ("Velmora", None), ("Velmora", " \0"), ("x", "y" * 5000), (None, "Velmora Emberstоne 120"), ("Velmora", "Emberstone 120 "),
    ]
    want = {2: 1, 3: 1, 4: 0, 5: 2, 6: 2, 7: 2, 8: 0, 9: 0, 10: 0, 11: 1, 12: 0, 15: 0, 16: 1, 17: 1}
    df = spark.createDataFrame([(i + 1, *x, 0) for i, x in enumerate(items)], "item_id bigint, maker string, model string, model_id int")
    cat = spark.createDataFrame(ref, "model_id bigint, maker string, model string, alias string, model_code string")
    assert dict(rows(map_to_canonical(df, cat))) == want
    assert {r[1] for r in rows(map_to_canonical(df, cat.limit(0)))} == {0}


def test_canonical_names_without_numbers(spark, rows):
    ref = [(1, "Velmora", "Emberstone Pro", None, None), (2, "Velmora", "Emberstone", None, "VEE-1"), (3, "Sinclair", "Stonecrop", "Kazenoko", None)]
    items = [
        ("Velmora", "emberstone pro"), ("Velmora", "Embertsone"), ("Velmora", "Emberstone Lite"), ("Velmora", "EmberstonePro"), ("Sinclair", "Emberstone Pro"),
        (None, "KAZENOKO"), ("Kestrin", "Stonecrop"), ("Velmora", "Emberstone Pro 2"), ("Velmora", "Velmora"), ("sinclair", "Stoncrop camera"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item_id bigint, maker string, model string")
    cat = spark.createDataFrame(ref, "model_id bigint, maker string, model string, alias string, model_code string")
    assert dict(rows(map_to_canonical(df, cat))) == {0: 1, 1: 2, 2: 0, 3: 1, 4: 0, 5: 3, 6: 0, 7: 0, 8: 0, 9: 3}


def test_canonical_makers(spark, rows):
    """Two swapped pairs of a long maker are misspelt; the name of another maker is another maker; short makers stay apart."""
    ref = [(1, "Quillonde", "Emberstone 400", None, None), (2, "Abc", "Foxglove 20", "Eos R5", None), (3, "Abd", "Pine 7", None, None), (4, "Kestrin", "Kazenoko 30", None, None)]
    items = [("Quilolned", "Emberstone 400"), ("Abd", "Foxglove 20"), ("Xyz", "Foxglove 20"), ("abc", "EOSR5"), ("Kestirn", "Kazenoko 30"), ("Marinth", "Kazenoko 30")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item_id bigint, maker string, model string")
    cat = spark.createDataFrame(ref, "model_id bigint, maker string, model string, alias string, model_code string")
    assert dict(rows(map_to_canonical(df, cat))) == {0: 1, 1: 0, 2: 0, 3: 2, 4: 4, 5: 0}


def test_frequency(spark, rows):
    data = [(f"p{i}", " A B\0" if i else "a b", "L") for i in range(5)] + [("p1", "A b", " l "), ("q", None, "L"), ("q", " ", "L"), (None, "z", "L"), ("q", "C", "L")]
    df = spark.createDataFrame([(*x, 1) for x in data], "path string, value_label string, key_label string, n int")
    got = {(r[1], r[2]): r[3:] for r in rows(term_frequencies(df, ["L"], common=0.6))}
    assert got == {("value", "a b"): (6, 5, "common"), ("term", "a"): (6, 5, "common"), ("term", "b"): (6, 5, "common"), ("value", "c"): (1, 1, "rare"), ("term", "c"): (1, 1, "rare")}
    assert rows(term_frequencies(df.limit(0), ["L"])) == []


def test_frequency_of_one_hot_pair(spark, rows):
    """One item of one record in a third of all rows, over several partitions and batches."""
    data = [("hot", "x y") if i % 3 == 0 else (f"p{i % 50}", f"x {i % 7}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "L") for r in data], "path string, value_label string, key_label string").repartition(7)
    got = {r.item: (r.n_occurrences, r.n_records) for r in term_frequencies(df, ["L"]).filter("kind = 'term'").collect()}
    want = {}
    for path, v in data:
        for t in v.split():
            want.setdefault(t, []).append(path)
    assert got == {t: (len(p), len(set(p))) for t, p in want.items()}


GROUPS = """row_id bigint, group_id bigint, filesize bigint, mod_date timestamp, width int, height int, exif_date_taken timestamp_ntz,
    maker string, model string, priority int, checked boolean, value string"""


def test_survivor(spark, rows):
    d = datetime(2020, 1, 1)
    data = [
        (1, 1, 0, d, None, 5, datetime(1980, 1, 1), "N/A", "m", 0, False, "x"), (2, 1, 7, datetime(1970, 1, 1), 3, 5, None, "Acme", " ", 1, False, None),
        (3, 1, 9, d, 4, 6, d, "acme", "m", None, True, None), (4, None, 9, d, 4, 6, d, "a", "m", 0, False, None), (5, 1, 8, d, 3, 5, None, "Acme", None, 1, False, None),
    ]
    df = spark.createDataFrame(data, GROUPS)
    got = {r.field: r.row_id for r in most_trusted(df).collect()}
    assert got == {"filesize": 5, "mod_date": 1, "width": 5, "height": 1, "exif_date_taken": 3, "maker": 5, "model": 1}
    voted = elect_values(df).collect()
    assert len(voted) == 1 and voted[0].maker.lower() == "acme" and voted[0].model == "m"
    assert most_trusted(df.limit(0)).collect() == [] and elect_values(df.limit(0)).collect() == []


def test_votes_of_old_and_undated_rows(spark):
    row = lambda i, date, maker, checked=False: (i, 1, 5, date, 1, 1, None, maker, "m", 0, checked, None)
    elect = lambda data: elect_values(spark.createDataFrame(data, GROUPS)).first().maker
    old, older, new = datetime(2001, 1, 1), datetime(1999, 1, 1), datetime(2095, 1, 1)
    assert elect([row(1, old, "b"), row(2, None, "a"), row(3, older, "a")]) == "b"  # undated counts as the oldest
    assert elect([row(1, old, "b"), row(2, old, "a"), row(3, old, "a")]) == "a"
    assert elect([row(1, new, "b"), row(2, datetime(2094, 6, 1), "a"), row(3, datetime(2094, 6, 1), "a")]) == "a"  # no upper limit of votes
    assert elect([row(1, None, "b"), row(2, None, "a"), row(3, None, "a", None)]) == "a"


def test_one_trusted_row_outweighs_any_number(spark):
    data = [(i, 1, 5, datetime(2020, 1, 1), 1, 1, None, "few" if i == 1 else "many", "m", 0 if i == 1 else 1, False, None) for i in range(1, 60)]
    df = spark.createDataFrame(data, GROUPS)
    assert {r.field: r.row_id for r in most_trusted(df).collect()}["maker"] == 1 and elect_values(df).first().maker == "many"


def test_consolidate(spark, rows):
    pairs = [(f"/c/{i:03}", f"/c/{i + 1:03}") for i in range(70)] + [("/hub", f"/s/{i}") for i in range(40)]
    pairs += [("/a//b", "/a/./b"), ("/a/b", "/A/b"), (None, "/x"), ("/x", "/x"), ("/c/003", "/c/../c/001")]
    df = spark.createDataFrame([(*p, "u") for p in pairs], "path_a string, path_b string, root string")
    want = {("/c/000", f"/c/{i:03}") for i in range(1, 71)} | {("/hub", f"/s/{i}") for i in range(40)} | {("/A/b", "/a/b")}
    got = consolidate(df)
    assert {tuple(r) for r in got.collect()} == want and group_table(df).count() == len(want) + 3
    assert rows(consolidate(df.limit(0))) == []


def test_leakage(spark, rows):
    item = " ".join(f"Wörd{i}" for i in range(20))
    w = item.split()
    docs = [
        "x " + " ".join(w[2:15]).upper() + " y", " ".join(w[2:14]), None, "", "> " + "\n> ".join(w[:13]), " ".join(f"<b>{x}</b>" for x in w[3:17]),
        " ".join(x[:2] + "­" + x[2:] for x in w[:13]), " ".join(x[:2] + "-\n" + x[2:] for x in w[:13]), "a " * 20000 + " ".join(w[7:20]), " ".join(w[:7] + ["z"] + w[7:]),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in leaked_windows(df, items).collect()) == [0, 4, 5, 6, 7, 8, 9]
    assert leaked_windows(df.limit(0), items).collect() == [] and leaked_windows(df, items.limit(0)).collect() == []


def test_leakage_against_brute_force(spark, monkeypatch):
    """Random texts over few words, so that shingles repeat; also with the windows too many for a broadcast."""
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4, n))
    items = [(i, word(int(rng.integers(10, 30)))) for i in range(12)] + [(None, word(20))]
    docs = []
    for i in range(60):
        t = items[int(rng.integers(12))][1].split()
        docs.append((i, word(int(rng.integers(0, 30))) + " " + " ".join(t[: int(rng.integers(8, 20))]) + " " + word(40)))
    want = {}
    for i, d in docs:
        w = d.split()
        held = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for j, t in items:
            v = t.split()
            n = [k for k in range(len(v) - 12) if tuple(v[k : k + 13]) in held]
            if n:
                want[i, j] = (n[0], len(n))
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (leakage.MAX_BROADCAST, 0):
        monkeypatch.setattr(leakage, "MAX_BROADCAST", most)
        assert {(r[0], r[1]): (r[2], r[3]) for r in leaked_windows(d, it).collect()} == want
    assert len(want) > 10


MIX = "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int"


def test_mixing(spark):
    docs = [(i, "w " * 10, "Big one") for i in range(60)] + [(100 + i, "w " * 5, " small_ONE ") for i in range(4)] + [(200, "w", None), (201, None, "big-one"), (202, "w", "else")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("big-one", 0.8, 1, 9, 0), ("small-one", 0.2, 3, 9, 0), ("none", 0.0, 1, 9, 0)], MIX)
    r = {x.source: x for x in mix_report(spark, df, mix).collect()}
    assert not r["small-one"].reaches and r["big-one"].reaches and r["none"].reaches and r["small-one"].routed_tokens == 60
    chosen = select_documents(df, mix, 7).collect()
    assert {c.uses for c in chosen if c.source == "small-one"} == {3}
    total = sum(c.uses * c.tokens for c in chosen if c.source == "big-one")
    assert abs(total - r["big-one"].quota_tokens) <= 10 and chosen and sorted(chosen) == sorted(select_documents(df, mix, 7).collect())
    assert select_documents(df.limit(0), mix).collect() == []


def test_mix_report_counts_the_chosen_documents(spark):
    docs = [(i, "w " * 30, "a") for i in range(7)] + [(100 + i, "w " * 40, "b") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("a", 0.51, 2, 9, 0), ("b", 0.49, 1, 9, 0), ("c", 0.0, 1, 9, 0)], MIX)
    chosen = select_documents(df, mix, 3).collect()
    want = {s: sum(c.uses * c.tokens for c in chosen if c.source == s) for s in "abc"}
    r = {x.source: x for x in mix_report(spark, df, mix, seed=3).collect()}
    assert {s: x.chosen_tokens for s, x in r.items()} == want and want["a"] < r["a"].routed_tokens
    assert all(abs(x.chosen_share - want[s] / sum(want.values())) < 1e-12 for s, x in r.items())
    assert [x.chosen_tokens for x in mix_report(spark, df.limit(0), mix).collect()] == [0, 0, 0]


def test_mixing_overlapping_sources(spark):
    docs = [(i, f"both {i} x x x x x x x x", s) for i in range(40) for s in ("a", "b")] + [(100 + i, f"only {i} y y y", "A ") for i in range(10)]
    df = spark.createDataFrame([(i, d[1], d[2]) for i, d in enumerate(docs)], "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("a", 0.3, 1, 9, 0), ("b", 0.7, 2, 9, 0)], MIX)
    shared = copies_membership(df, mix)
    assert {tuple(r.pattern) for r in shared.collect()} == {("a", "b"), ("a",)} and shared.count() == 50
    r = {x.source: x for x in mix_report(spark, df, mix, membership=shared).collect()}
    assert r["a"].own_tokens == 450 and r["b"].own_tokens == 400 and all(x.reaches for x in r.values())
    assert abs(r["a"].routed_share - 0.3) < 1e-9 and abs(r["b"].chosen_share - 0.7) < 0.05
    uses = {}
    for c in select_documents(df, mix, 0, key="key", membership=shared).collect():
        uses[c.key] = uses.get(c.key, 0) + c.uses
    assert max(uses.values()) <= 2
    none = {x.source: x for x in mix_report(spark, df, mix).collect()}
    assert none["a"].own_tokens == 450 and none["b"].own_tokens == 400


@pytest.mark.parametrize("limit, overlap", [(8, 0), (8, 3), (20, 5), (3, 5), (1, 0)])
def test_split_text(limit, overlap):
    text = "One two. Three four five!\n\nSix seven\neight " + "nine " * 30 + "。終わり。 End?"
    pieces, forced = split_text(text, limit, overlap)
    spans = [m.span() for m in TOKEN.finditer(text)]
    got = []
    for x, y, n, shared in pieces:
        inside = [s for s in spans if x <= s[0] and s[1] <= y]
        assert len(inside) == n <= limit and got[len(got) - shared :] == inside[:shared]
        got += inside[shared:]
    assert got == spans and forced == 1


def test_first_piece_has_the_whole_limit():
    pieces, forced = split_text("a b c d e f g. " * 3, 8, 2)
    assert pieces[0] == (0, 14, 8, 0) and not forced
    pieces, _ = split_text("x y. " + "a b c d. " + "k l m n o.", 10, 6)  # a stretch behind fewer tokens than the overlap
    assert [p[2:] for p in pieces][0] == (8, 0)


def test_natural_boundaries_are_kept_where_they_can_be():
    rng = np.random.default_rng(5)
    for _ in range(200):
        limit = int(rng.integers(4, 12))
        overlap = int(rng.integers(0, limit))
        text = "".join("w " * int(rng.integers(1, limit)) + (". ", "\n", "\n\n", "! ")[int(rng.integers(4))] for _ in range(int(rng.integers(1, 12))))
        spans = [m.span() for m in TOKEN.finditer(text)]
        ends = {sum(s[0] < at for s in spans) for at, _ in boundaries(text)}
        pieces, _ = split_text(text, limit, overlap)
        at = 0
        marks = sorted(ends | {0, len(spans)})
        for _, _, n, shared in pieces:
            at += n - shared
            assert n <= limit and shared == min(overlap, at - n + shared)
            if at not in ends and at < len(spans):  # a cut inside a stretch: it did not fit with its overlap
                lo = max(m for m in marks if m < at)
                hi = min(m for m in marks if m > at)
                assert hi - lo + min(overlap, lo) > limit


def test_boundaries_take_linear_time():
    text = "a\n" * 1_000_000
    began = time.perf_counter()
    assert len(boundaries(text)) == 999_999 and time.perf_counter() - began < 10
    assert boundaries("a\n\nb\r\n\r\nc. d\n") == [(2, 2), (3, 3), (6, 2), (8, 3), (10, 1)]


def test_split_documents(spark, rows):
    docs = [(1, "a b. c d. e f.", "S"), (2, "a", "S"), (3, None, "S"), (4, "a b c d e f g h i j", None), (5, "x " * 9000, " s ")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, forced int")
    lim = spark.createDataFrame([("s", 0.5, 1, 6, 1)], MIX)
    got = split_oversized(df, lim)
    assert {(r.doc_id, r.forced) for r in got.collect()} == {(1, 0), (5, 1)}
    assert all(len(re.findall(r"\w+|[^\w\s]+", r.piece)) == r.tokens <= 6 for r in got.collect())
    assert rows(split_oversized(df.limit(0), lim)) == []
