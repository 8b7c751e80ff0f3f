"""The pipeline's near-dedup against brute force over sets of five-word shingles."""

import collections

import corpus_pipeline
from flowloom.llm import near_copies
from flowloom.llm.common import table


def brute_groups(texts, least=0.8):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    head = {i: i for i in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        alike = [j for j, n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n) - 1e-9] if sets[i] else [j for j in sets if j < i and not sets[j]]
        for j in alike:
            a, b = sorted((top(i), top(j)))
            head[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: top(i) for i in sets}


def test_stage_keeps_one_of_each_jaccard_group(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    want = brute_groups({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(docs).collect()}
    assert got == want
    kept = corpus_pipeline.near_dedup(spark, docs, d)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_large_groups_and_common_parts(spark):
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(k, " ".join("edit" if j == k % 97 else f"w{j}" for j in range(100)) + ("" if k % 3 else " end" * (k % 20))) for k in range(400)]
    rows += [(1000 + k, common + " " + " ".join(f"x{k}_{j}" for j in range(25))) for k in range(150)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(dict(rows))
    for chunk in (near_copies.CHUNK, 16):
        assert {r["doc_id"]: r["component_id"] for r in near_copies.near_components(docs, chunk=chunk).collect()} == want
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], docs.schema)
    assert sorted(str(r["doc_id"]) for r in near_copies.one_of_each(twice).collect()) == ["1", "None"]


def test_set_fingerprints_match_a_plain_version():
    import numpy as np
    import pyarrow as pa

    texts = ["", "one two three four five six seven", "a b", "w " * 40 + "x y z"]
    h, offsets = near_copies.shingle_sets(pa.array(texts))
    got = near_copies.set_fingerprints(h, offsets)
    for k in range(len(texts)):
        own = h[offsets[k] : offsets[k + 1]].tolist()
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
        assert len(own) == len({tuple(texts[k].split()[j : j + 5]) for j in range(max(1, len(texts[k].split()) - 4))} if texts[k] else [])
    assert np.all(np.diff(h[offsets[1] : offsets[2]].astype(object)) > 0)


def test_pairs_at_the_threshold_are_within_the_budget():
    """Of random sets of similarity 0.8 none of 4,000 pairs is over the error budget."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (4, 8, 40, 400):
        for _ in range(1000):
            x = np.unique(rng.integers(0, 1 << 63, size=size + size // 4 + 2, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=size + size // 4 + 2, dtype=np.uint64))
            a, b = x[:size], x[: size + size // 4]
            f = near_copies.set_fingerprints(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert int(np.bitwise_count(f[0] ^ f[1])) <= near_copies.BUDGET


def test_clusters_are_those_of_all_pairs_of_a_bucket():
    """Tasks over several batches, one with a large group in it, none of its rows lost."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    task = np.sort(np.concatenate([rng.integers(0, 60, 900), np.full(1500, 30)]))
    n = len(task)
    longs = rng.integers(0, 1 << 63, size=(40, 3), dtype=np.uint64)[np.where((task == 30) & (rng.random(n) < 0.7), 0, rng.integers(0, 40, n))]
    for _ in range(12):
        longs ^= np.uint64(1) << rng.integers(0, 64, size=longs.shape, dtype=np.uint64)
    name = rng.permutation(n).astype(np.int64)
    table = pa.table({"task": task, "fp": longs[:, 0].view(np.int64), "more1": longs[:, 1].view(np.int64), "more2": longs[:, 2].view(np.int64), "name": name})
    want = set()
    for t in np.unique(task):
        at = np.flatnonzero(task == t)
        x = longs[at]
        near = np.bitwise_count(x[:, None] ^ x[None])
        near = (near[:, :, 0] <= near_copies.BUDGET) & (near[:, :, 1:].sum(axis=2) <= near_copies.MORE)
        left = set(range(len(at)))
        while left:
            group = front = {left.pop()}
            while front:
                front = {int(k) for i in front for k in np.flatnonzero(near[i])} & left
                left -= front
                group = group | front
            if len(group) > 1:
                want.add(frozenset(int(name[at[k]]) for k in group))
    for rows, many in ((7, 50), (100, 400), (5000, 100_000)):
        found = pa.Table.from_batches(near_copies._clusters(near_copies.BUDGET, many)(iter(table.to_batches(max_chunksize=rows)))).to_pandas()
        assert {frozenset(x) for _, x in found.groupby("bucket")["name"]} == want and max(map(len, want)) > near_copies.LARGE


def test_pairs_at_the_threshold_share_a_table_by_their_bits_alone():
    """Of random sets of similarity 0.8 all of 1,200 pairs; and further bits match a plain version."""
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1000, 300_000):
        tables, bits = near_copies.tables_of(n)
        longs = 2 - (-tables * bits // 64)
        for size in (8, 40, 600):
            sets = [np.unique(rng.integers(0, 1 << 63, size=size + size // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(k % 2)) for k in range(200)]
            h = np.concatenate([x for s in sets for x in (s[:size], s)])
            offsets = np.cumsum([0, *(len(x) for s in sets for x in (s[:size], s))])
            more = near_copies.further_bits(h, offsets, longs)
            assert np.bitwise_count(more[::2, :2] ^ more[1::2, :2]).sum(axis=1, dtype=int).max() <= near_copies.MORE
            dealt = np.unpackbits(more[:, 2:].astype("<u8").view(np.uint8), axis=1, bitorder="little", count=tables * bits).reshape(len(more), tables, bits)
            assert (dealt[::2] == dealt[1::2]).all(axis=2).any(axis=1).all()
            for k in (0, len(offsets) - 2):
                x = near_copies._mixed(h[offsets[k] : offsets[k + 1]] * near_copies._ODD[longs - 1])
                assert int(more[k, -1]) == sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x))


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np

    rng = np.random.default_rng(7)
    for size in (1, 4, 40, 400):
        for other in (0, 1, size // 5, 3 * size):
            x = np.unique(rng.integers(0, 1 << 63, size=size + other, dtype=np.uint64))
            rng.shuffle(x)
            p = near_copies.set_parities(np.concatenate([x[:size], x]), np.array([0, size, size, size + len(x)]))
            assert p.shape == (3, near_copies.PARITY) and not p[1].any()
            apart = int(np.bitwise_count(p[0] ^ p[2]).sum(dtype=int))
            assert apart <= len(x) - size and (apart - len(x) + size) % 2 == 0 and (apart > 0 or other != 1)


def test_contested_are_all_that_may_be_similar_to_another_label():
    """Against all pairs of each bucket, over several batches: none left out, none beside."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, least = 1500, near_copies.LEAST
    bucket = np.sort(np.where(rng.random(n) < 0.3, 7, rng.integers(0, 90, n)))
    kind = rng.integers(0, 12, n)
    label = np.where(rng.random(n) < 0.6, bucket * 100, bucket * 100 + rng.integers(0, 9, n))
    fp = rng.integers(0, 1 << 63, size=12, dtype=np.uint64)[kind]
    parity = rng.integers(0, 1 << 63, size=(12, near_copies.PARITY), dtype=np.uint64)[kind]
    for _ in range(9):
        fp ^= np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64)
        parity ^= np.uint64(1) << rng.integers(0, 64, size=parity.shape, dtype=np.uint64)
    size = rng.integers(120, 260, n)
    name = rng.permutation(n).astype(np.int64)
    head = np.array([name[bucket == b].min() for b in bucket])
    rows = pa.table({"bucket": bucket, "name": name, "head": head, "label": label, "size": size, "fp": fp.view(np.int64), "parity": list(parity.view(np.int64))})
    want = {}
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        x, y = np.meshgrid(at, at, indexing="ij")
        may = (label[x] != label[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= near_copies.BUDGET) & (name[x] != head[x]) & (name[y] != head[y])
        may &= (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y])) & (np.bitwise_count(parity[x] ^ parity[y]).sum(axis=2, dtype=int) <= (size[x] + size[y]) / 9)
        for k, i in enumerate(at):
            if may[k].any():
                want[int(name[i])] = {int(name[j]) for j in at[may[k]]}
    for batch, many, chunk in ((9, 60, 4), (5000, 100_000, 512)):
        found = pa.Table.from_batches(near_copies._contested(least, near_copies.BUDGET, chunk, many)(iter(rows.to_batches(max_chunksize=batch)))).to_pandas()
        part = dict(zip(found["name"], found["bucket"]))
        assert set(part) == set(want) and 0 < len(part) < n and all(part[i] == part[j] for i in want for j in want[i])
        for _, x in found.groupby("bucket"):
            counts = x["label"].value_counts()
            most = x["label"][x["is_major"]]
            assert len(counts) > 1 and most.nunique() == 1 and len(most) == counts.iloc[0]
            assert (x["majors"] == -(-len(most) // chunk)).all() and (x["minors"] == -(-(len(x) - len(most)) // chunk)).all() and (x["small"] == (len(x) <= chunk)).all()


def test_texts_with_a_common_part_are_not_dealt_to_the_exact_check_by_table(spark, monkeypatch):
    """A part in common makes texts candidates in many tables, though none is similar enough; and a large group of copies is verified by its heads."""
    common = " ".join(f"c{k}" for k in range(70))
    rows = [(k, common + " " + " ".join(f"x{k}_{j}" for j in range(30))) for k in range(200)]
    rows += [(1000 + k, " ".join("edit" if j == k else f"w{j}" for j in range(100))) for k in range(100)]
    made = {}

    def counted(df, name):
        out = written(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    written = near_copies.written
    monkeypatch.setattr(near_copies, "written", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(dict(rows))
    assert made["near-clusters"] > 10 * len(rows) and made["near-tasks"] < len(rows)
