"""Near-duplicate operators against all pairs on small inputs."""

import numpy as np
import pytest
from fixtures import awkward_rows, documents, prose

from scorelake.llm import common, golay, graph, linedup, multiindex, simhash
from scorelake.session import shared_dir


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_golay_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 400)
    for i in range(23):
        for j in range(i + 1):
            other = words ^ (1 << i) if i == j else words ^ (1 << i) ^ (1 << j)
            (a, n), (b, m) = golay.keys(words), golay.keys(other)
            for x, y, p, q in zip(a, b, n, m, strict=True):
                assert set(x[:p].tolist()) & set(y[:q].tolist())


def test_fuzzy_keys_cover_four_bits():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = np.uint64(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        keys = [set(simhash.fuzzy_keys(np.array([x]))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {n: r for n, r in roots(linked, edges).items()}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("window", "longest"), [(100_000, 8192), (64, 20)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, window, longest):
    monkeypatch.setattr(simhash, "WINDOW_ROWS", window)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    fps = [int(b) for b in base]
    for b in base[:6]:  # chains and a dense group
        x = int(b)
        for _ in range(25 if b != base[0] else 120):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
            x = int(b) if b == base[0] else x
    fps = np.unique(np.array(fps, dtype=np.uint64))
    links = [(int(i), int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]
    expected = roots(range(len(fps)), links)
    keys, rows = simhash.fuzzy_keys(fps)
    order = np.lexsort((fps[rows], keys))
    import pyarrow as pa

    def met(keys, values, longest):
        table = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50].view(np.int64)), pa.array(values[i : i + 50].view(np.int64))], names=["key", "fp"]) for i in range(0, len(keys), 50)]
        return [r for b in simhash._link_runs(4, longest)(iter(table)) for r in b.to_pylist()]

    key = keys[order].view(np.int64)
    again = np.lexsort((fps[rows[order]], key))
    out = met(key[again].view(np.uint64), fps[rows[order]][again], longest)
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    found = [(place[r["a"]], place[r["b"]]) for r in out if r["kind"] == 0]
    blocks = {}
    for r in out:
        if r["kind"] == 1:
            blocks.setdefault(r["key"], {}).setdefault(r["b"], []).append(r["a"])
    for own in blocks.values():
        for p in own:
            for q in own:
                both = np.unique(np.array(own[p] + own[q], dtype=np.int64)).view(np.uint64)
                found += [(place[r["a"]], place[r["b"]]) for r in met(np.zeros(len(both), dtype=np.uint64), both, None)]
    assert roots(range(len(fps)), found) == expected


def test_simhash_of_awkward_documents(spark):
    rows = simhash.components(documents(spark)).collect()
    assert len(rows) == len(awkward_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[1].fp == by_id[2].fp
    assert by_id[4].fp == by_id[5].fp == by_id[6].fp == 0 and by_id[4].component_id == by_id[6].component_id == 4
    fps = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]
    up, least = roots(range(len(rows)), links), {}
    for i, r in enumerate(rows):
        least.setdefault(up[i], []).append(r.doc_id)
    for i, r in enumerate(rows):
        assert r.component_id == min((x for x in least[up[i]] if x is not None), default=None)
    assert simhash.components(documents(spark, [])).count() == 0


def test_components_at_other_numbers_of_bits(spark, monkeypatch):
    # Of 0, 3 bits and 4 bits: at two, nothing links; the pair at two bits does.
    fps = [0, 0b111, 0b1111 << 40, 0b11 << 50]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.select("doc_id", "fp"))
    found = simhash.components(spark.createDataFrame(list(enumerate(fps)), "doc_id bigint, fp bigint"), most=2)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_fingerprint_by_its_definition():
    from xxhash import xxh64_intdigest

    for text in ("A b\tC d e\x0bf É x", "one two", "", prose(9, 60)):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text, 4) == bits


def edited(text: str, every: int, seed: int) -> str:
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_near_duplicates_are_dropped_and_others_stay(spark):
    rows = [(i, prose(100 + i, 200), "en") for i in range(40)]
    # A large group of near copies, none equal to another, and pairs that are too far apart.
    rows += [(1000 + i, edited(prose(500, 400), 97, i), "en") for i in range(120)] + [(2000 + i, edited(prose(600, 200), 6, i), "en") for i in range(5)]
    rows += [(3000, rows[0][1], "en"), (3001, rows[0][1].upper(), "en"), (None, rows[1][1], "en")]
    words = {r[0]: r[1].lower().split() for r in rows if r[0] is not None}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {i for i, r in roots(sets, links).items() if i == r}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(kept) == sorted(expected)


def test_sets_at_the_threshold_share_a_prefix_hash():
    rng = np.random.default_rng(11)
    common = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    counted = (common, rng.integers(4, 90, len(common)))
    for n in [1, 2, 4, 5, 9, 10, 20, 45, 90, 450]:  # n shared, and as many more on either side as 0.8 allows
        for _ in range(40):
            more = n // 4
            one = int(rng.integers(0, more + 1))
            pool = np.unique(np.concatenate([rng.choice(common, n), rng.integers(0, 1 << 63, 2 * n + 8).astype(np.uint64)]))
            rows = rng.permutation(pool)[: n + more]
            a, b = np.sort(rows[: n + one]), np.sort(np.concatenate([rows[:n], rows[n + one :]]))
            assert set(simhash.prefix(a, counted, 0.8).tolist()) & set(simhash.prefix(b, counted, 0.8).tolist())


def test_prefixes_rule_out_pairs_that_share_a_hash_only(spark):
    rng = np.random.default_rng(14)
    common = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    counted = (common, rng.integers(4, 90, len(common)))
    sets = [np.empty(0, dtype=np.uint64)]
    for n in [1, 2, 4, 5, 9, 10, 20, 45, 90, 300]:
        for turn in range(30):
            pool = np.unique(np.concatenate([rng.choice(common, n // 2, replace=False), rng.integers(0, 1 << 64, 3 * n + 8, dtype=np.uint64)]))
            rows, one, more = rng.permutation(pool), int(rng.integers(0, n // 4 + 1)), n // 4
            # Of 0.8 at least; every third pair shares one hash only.
            both = rows[:n] if turn % 3 else rows[:1]
            sets += [np.sort(np.concatenate([both, rows[len(both) : n + one]])), np.sort(np.concatenate([both, rows[n + one : 2 * n + more - len(both)]]))]
    nodes = []
    for node, s in enumerate(sets):
        keys = simhash.prefix(s, counted, 0.8)
        nodes.append((node, len(s), int(simhash.sightings(keys[-1:], counted).sum()), keys.view(np.int64).tolist()))
    pairs = [(0, 1)] + [(i, i + 1) for i in range(1, len(sets), 2)]
    similar = {(a, b) for a, b in pairs if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    prefixes = spark.createDataFrame(nodes, "node bigint, n int, seen bigint, keys array<bigint>")
    found = {(r.a, r.b) for r in simhash._may_be_similar(spark.createDataFrame(pairs, "a bigint, b bigint"), prefixes, 0.8).collect()}
    assert len(similar) > 180 and similar <= found
    far = {p for p in pairs if len(sets[p[0]]) >= 20} - similar
    assert len(far) > 30 and len(far & found) < len(far) / 5


def test_shuffle_files_go_once_a_table_is_stored(spark):
    from scorelake.session import FREE_SHUFFLES, cut_lineage

    set_before = spark.conf.get(FREE_SHUFFLES, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    spark.range(100).repartition(3, "id").write.format("noop").mode("overwrite").save()
    plain = tracker.shuffleStatuses().size()
    stored = cut_lineage(spark.range(100).repartition(3, "id"))
    assert plain <= before + 1 and tracker.shuffleStatuses().size() <= plain
    assert stored.count() == 100 and spark.conf.get(FREE_SHUFFLES, None) == set_before


def test_marked_rows_hold_all_that_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(common, "MARK_LONGS", 64)
    hashes = [x - (1 << 64) if x >> 63 else x for x in np.random.default_rng(21).integers(0, 1 << 64, 3000, dtype=np.uint64).tolist()] + [0, -1, -(1 << 63), 63, 64]
    rows = spark.createDataFrame([(h,) for h in hashes + hashes[:50]], "h bigint")
    for wanted in (hashes[:40] + hashes[-5:], []):
        some = common.marked(rows, "h", spark.createDataFrame([(h,) for h in wanted * 2], "w bigint"))
        rest = common.marked(rows, "h", spark.createDataFrame([(h,) for h in wanted], "w bigint"), others=True)
        found, left = [r.h for r in some.collect()], [r.h for r in rest.collect()]
        assert sorted(found + left) == sorted(r.h for r in rows.collect())
        assert set(wanted) <= set(found) and not set(found) & set(left)
        # 45 of 4096 bits: about one other row in ninety.
        assert len(set(found) - set(wanted)) < 100


def test_texts_that_stay_whole_are_not_exchanged(spark, monkeypatch):
    texts = [prose(2000 + i, 200) for i in range(300)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, t + (f"\n{shared}" if i < 3 else ""), "en") for i, t in enumerate(texts)] + [(1000 + i, t + " end", "en") for i, t in enumerate(texts[10:14])]
    sent = {}

    def recorded(given, key, wanted, others=False):
        out = common.marked(given, key, wanted, others)
        if not others:
            sent.setdefault(key, []).append((given.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "marked", recorded)
    monkeypatch.setattr(linedup, "marked", recorded)
    kept = linedup.delete_repeated_lines(documents(spark, rows, clashing=False)).where("removed > 0").select("doc.doc_id").collect()
    assert {1, 2} <= {r.doc_id for r in kept} and sent["_th"][0][0] == len(rows)
    near = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(near) == list(range(300))
    # Texts, prefixes and shingles: few go on to the exact joins.
    assert {"_th", "th", "node", "key"} <= set(sent)
    assert all(some <= 20 for pairs in sent.values() for given, some in pairs if given <= len(rows))
    assert all(some <= given / 10 for given, some in sent["key"])


def test_tables_between_go_once_they_are_read(spark):
    import os

    def folders():
        at = f"{shared_dir(spark)}/scorelake"
        return {d for d in os.listdir(at) if os.listdir(f"{at}/{d}")} if os.path.isdir(at) else set()

    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(12))
    rows = [(i, f"{prose(3000 + i, 60)}\n{run}", "en") for i in range(6)]
    before = folders()
    out = linedup.delete_repeated_lines(documents(spark, rows, clashing=False))
    assert len(folders() - before) == 1
    assert sorted(r.removed for r in out.collect()) == [0] + [12] * 5


def test_all_pairs_of_short_texts_at_the_threshold_are_found(spark):
    words = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    rows = []
    for i in range(150):  # 4 of 5 shingles shared; 16 of 20
        size = 8 if i % 2 else 20
        rows += [(2 * i, " ".join(words(i, size)), "en"), (2 * i + 1, " ".join([*words(i, size), *[f"y{i}x{k}" for k in range(1 if i % 2 else 4)]]), "en")]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(kept) == [2 * i for i in range(150)]


def test_long_runs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEET_ROWS", 7)
    rows = spark.createDataFrame([(k, node, 10, 0, node % 3 if k else node) for k in range(2) for node in range(40)], "key bigint, node bigint, n int, pos int, root bigint")
    assert sorted(map(tuple, simhash._meet_all(rows, 0.8).collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert max(r["count"] for r in simhash._in_blocks(rows).groupBy("key", "low", "high").count().collect()) < 30


def test_repeats_of_a_phrase_do_not_part_near_duplicates(spark):
    rows, phrase = [], " ".join(f"r{i}" for i in range(16))
    for i in range(20):
        text = prose(700 + i, 200)
        # The sets are equal; then all but equal.
        rows += [(10 * i, f"{text} {phrase} {phrase}", "en"), (10 * i + 1, " ".join([text, *[phrase] * 20]), "en"), (10 * i + 2, " ".join([text, *[phrase] * 20, "end"]), "en")]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(kept) == [10 * i for i in range(20)]


def test_near_duplicates_of_awkward_documents(spark):
    docs = documents(spark)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(3) == 1 and 1 in kept and 2 not in kept and len(kept) == len(set(kept))
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_multi_index_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 5] + rng.normal(size=16) * 0.12).tolist()) for i in range(120)]
    rows += [(2000, rows[7][1]), (2000, rows[7][1]), (2001, [2 * x for x in rows[8][1]]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [1.0, None]), (2006, [1.0, 0.0]), (2007, [1.0] + [0.0] * 15), (None, rows[9][1]), (2008, []), (2009, [float("inf")] * 16)]
    found = multiindex.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.999).collect()
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=float) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, usable, strict=True)]
    n = len(rows)
    near = [[i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(n)] for i in range(n)]
    up, least = roots(range(n), [(i, j) for i in range(n) for j in range(n) if near[i][j]]), {}
    for i in range(n):
        least.setdefault(up[i], []).append(rows[i][0])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    expected = []
    for i in range(n):
        own = rows[i][0]
        c = None if own is None else min(x for x in least[up[i]] if x is not None)
        expected.append((own, sum(near[i]), c, True if own is None else c == own))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    nothing = multiindex.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert nothing.count() == 0


def test_one_sided_visits_count_for_both_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL_ROWS", 2)
    monkeypatch.setattr(multiindex.MultiIndex, "widen", lambda self, distances, pairs, recall: None, raising=False)
    rng = np.random.default_rng(12)
    base = np.repeat(rng.normal(size=(60, 16)), 5, axis=0)
    rows = [(i, (v + rng.normal(size=16) * 0.15).tolist()) for i, v in enumerate(base)]
    found = multiindex.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.3).collect()
    size = {c: sum(r.component_id == c for r in found) for c in {r.component_id for r in found}}
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in found)
    assert any(n > 1 for n in size.values()) and sum(r.n_links for r in found) % 2 == 0


def test_reach_covers_real_pairs(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL_ROWS", 2)
    rng = np.random.default_rng(13)
    # Near vectors differ along one direction only, which the halves' codes cut.
    base = np.repeat(rng.normal(size=(100, 16)), 4, axis=0)
    base[:, 0] += rng.normal(size=400) * 1.2
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = multiindex.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id bigint, embedding array<double>"), recall=0.99).collect()
    assert sum(r.n_links for r in found) >= 0.99 * near.sum() and all(r.n_links <= near[r.vec_id] for r in found)


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(6)
    index = multiindex.MultiIndex(rng.normal(size=(200, 8)), 6, 0.95, 0.99)
    first, second = rng.random(index.k), rng.random(index.k)
    index.reach = 0.9
    cells = index.visits(first, second)
    sums = [first[c // index.k] + second[c % index.k] for c in cells]
    assert sums == sorted(sums) and len(cells) == len(set(cells)) == sum(a + b <= 0.9 for a in first for b in second)


def test_near_duplicates_meet_by_golay_keys_first(spark, monkeypatch):
    rows = [(i, prose(900 + i // 2, 400) + (" x" if i % 2 else ""), "en") for i in range(12)]
    # Without the prefixes' rounds, only fingerprints within four bits bring documents together.
    for meet in ("_meet_pivots", "_meet_all"):
        monkeypatch.setattr(simhash, meet, lambda rows, *_: spark.createDataFrame([], "a bigint, b bigint"))
    prints = [simhash.fingerprint(r[1], 5) for r in rows]
    near = [i for i in range(0, 12, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4]
    assert near
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(kept) == sorted({r[0] for r in rows} - {i + 1 for i in near})
