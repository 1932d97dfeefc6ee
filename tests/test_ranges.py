import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

import oracle
import rangeloom as rl
from rangeloom.operators import overlap
from rangeloom.plans import ordered

G = "range_id long, seqname string, start long, end long, strand string"


def plain(spark, rows, extra="", values=None):
    return rl.RangeSet.of_plain(spark.createDataFrame([(i, a, b, *(v if values else ())) for (i, (a, b)), v in zip(enumerate(rows, 1), values or [()] * len(rows))], "range_id long, start long, end long" + extra))


def genomic(spark, rows, extra="", seqinfo=None):
    info = spark.createDataFrame(seqinfo, "seqname string, seqlength long, is_circular boolean") if seqinfo else None
    return rl.RangeSet.of_genomic(spark.createDataFrame(rows, G + extra), info)


def draw(seed, n, span=400, width=30, empty=0.0, seqs=2):
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        a = rng.randint(1, span)
        w = 0 if rng.random() < empty else rng.randint(1, width) if rng.random() > 0.02 else rng.randint(1, span)
        out.append((i, f"chr{rng.randint(1, seqs)}", a, a + w - 1, rng.choice("+-*")))
    return out


def got_pairs(df):
    return sorted(map(tuple, df.collect()))


QUERY = [(1, "chr1", 100, 159, "+"), (2, "chr1", 180, 269, "+"), (3, "chr1", 350, 419, "-"), (4, "chr2", 40, 79, "*"), (5, "chr2", 300, 379, "+"), (6, "chr3", 10, 34, "-")]
SUBJECT = [(1, "chr1", 90, 169, "+"), (2, "chr1", 210, 309, "-"), (3, "chr1", 320, 369, "-"), (4, "chr2", 20, 89, "+"), (5, "chr2", 330, 419, "*"), (6, "chr3", 1, 40, "-"), (7, "chr3", 80, 114, "+")]


@pytest.mark.parametrize(
    "options,want",
    [
        ({}, "11 33 44 55 66"), ({"ignore_strand": True}, "11 22 33 44 55 66"), ({"type": "within"}, "11 44 66"), ({"type": "within", "max_gap": 20}, "11 66"),
        ({"type": "start"}, ""), ({"type": "start", "max_gap": 10}, "11 66"), ({"type": "end", "max_gap": 10, "ignore_strand": True}, "11 44 66"),
        ({"type": "equal", "max_gap": 20}, "11 44 66"), ({"max_gap": 0, "ignore_strand": True}, "11 22 33 44 55 66"),
        ({"max_gap": 60, "ignore_strand": True}, "11 12 21 22 23 32 33 44 55 66 67"), ({"min_overlap": 30, "ignore_strand": True}, "11 22 44 55"),
    ],
)
def test_example(spark, options, want):
    assert got_pairs(rl.find_overlaps(genomic(spark, QUERY), genomic(spark, SUBJECT), **options)) == [tuple(map(int, x)) for x in want.split()]


def test_tolerances_and_empty_ranges(spark):
    q = plain(spark, [(10, 20)])
    within = plain(spark, [(5, 20), (5, 25), (8, 23), (10, 25), (11, 20)])
    equal = plain(spark, [(5, 20), (5, 21), (10, 25), (11, 20), (10, 20)])
    ids = lambda s, **o: [b for _, b in got_pairs(rl.find_overlaps(q, s, **o))]
    assert ids(within, type="within", max_gap=0) == [1, 2, 3, 4] and ids(within, type="within", max_gap=5) == [1, 3, 4]
    assert ids(equal, type="equal", max_gap=0) == [5] and ids(equal, type="equal", max_gap=5) == [1, 2, 3, 4, 5]
    q, s = plain(spark, [(5, 4), (8, 10), (12, 11), (20, 23)]), plain(spark, [(3, 6), (5, 4), (8, 10), (12, 11), (19, 21)])
    assert got_pairs(rl.find_overlaps(q, s)) == [(1, 1), (2, 3), (4, 5)]
    assert [r.overlap_count for r in rl.count_overlaps(q, s).orderBy("query_id").collect()] == [1, 1, 0, 1]


@pytest.mark.parametrize("dense", [0, 1e9])
def test_parameter_grid(spark, monkeypatch, dense):
    monkeypatch.setattr(overlap, "DENSE", dense)
    sets = [(draw(1, 90), draw(2, 200)), (draw(3, 60, empty=0.2), draw(4, 120, empty=0.2))]
    for q, s in sets:
        a, b = genomic(spark, q), genomic(spark, s)
        frames, wants = [], []
        grid = itertools.product(("any", "start", "end", "within", "equal"), (-1, 0, 5), (0, 1, 4), (True, False))
        for k, (kind, gap, need, ignore) in enumerate(grid):
            options = {"type": kind, "max_gap": gap, "min_overlap": need, "ignore_strand": ignore}
            frames.append(rl.find_overlaps(a, b, **options).select(F.lit(k).alias("k"), F.lit("pair").alias("what"), F.col("query_id").alias("x"), F.col("subject_id").alias("y")))
            frames.append(rl.count_overlaps(a, b, **options).select(F.lit(k), F.lit("count"), "query_id", "overlap_count"))
            found = oracle.pairs(q, s, **options)
            wants += [(k, "pair", *p) for p in found] + [(k, "count", r[0], sum(x == r[0] for x, _ in found)) for r in q]
        got = []
        for part in range(0, len(frames), 12):
            df = frames[part]
            for f in frames[part + 1 : part + 12]:
                df = df.union(f)
            got += map(tuple, df.collect())
        assert sorted(got) == sorted(wants)


def test_long_ranges_use_coarser_bins(spark):
    rng = random.Random(5)
    q = [(i, "c", a := rng.randint(1, 100_000), a + rng.randint(0, 9), "*") for i in range(1, 301)]
    s = [(i, "c", a := rng.randint(1, 100_000), a + (rng.randint(0, 9) if i % 50 else rng.randint(5_000, 90_000)), "*") for i in range(1, 301)]
    assert got_pairs(rl.find_overlaps(genomic(spark, q), genomic(spark, s), max_gap=3)) == oracle.pairs(q, s, max_gap=3)
    assert got_pairs(rl.find_overlaps(genomic(spark, s), genomic(spark, q))) == oracle.pairs(s, q)


@pytest.fixture(params=[False, True], ids=["whole", "chunks"])
def chunks(request, monkeypatch):
    """Run scans in one window a sequence, and in many coordinate chunks, with
    counts made without pairs."""
    if request.param:
        monkeypatch.setattr(overlap, "DENSE", 0)
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 10)


def test_select_joins_and_counts(spark, chunks):
    q, s = draw(11, 60), draw(12, 150)
    a, b = genomic(spark, q), genomic(spark, s)
    found = oracle.pairs(q, s)
    of = {r[0]: [y for x, y in found if x == r[0]] for r in q}
    for select, pick in (("first", min), ("arbitrary", min), ("last", max)):
        assert dict(map(tuple, rl.find_overlaps(a, b, select=select).collect())) == {k: pick(v, default=None) for k, v in of.items()}
    assert dict(map(tuple, rl.count_overlaps(a, b).collect())) == {k: len(v) for k, v in of.items()}
    assert dict(map(tuple, rl.overlaps_any(a, b).collect())) == {k: bool(v) for k, v in of.items()}
    semi, anti = rl.semi_overlap_join(a, b), rl.anti_overlap_join(a, b)
    assert {r.query_id: r.overlap_count for r in semi.collect()} == {k: len(v) for k, v in of.items() if v}
    assert {r.query_id for r in anti.collect()} == {k for k, v in of.items() if not v}
    assert semi.columns == ["query_id", "overlap_count", "query_seqname", "query_start", "query_end", "query_width", "query_strand"]
    left = rl.left_overlap_join(a, b, deterministic=True).collect()
    assert [(r.query_id, r.subject_id) for r in left] == sorted([*found, *((k, None) for k, v in of.items() if not v)], key=lambda p: (p[0], p[1] or 0))
    assert all((r.subject_start is None) == (r.subject_id is None) for r in left)
    row = {r[0]: r for r in s}
    assert all((r.subject_seqname, r.subject_start, r.subject_end) == row[r.subject_id][1:4] for r in rl.inner_overlap_join(a, b).collect())


def test_aggregates(spark):
    q = plain(spark, [(1, 5), (10, 14), (20, 24), (90, 91)])
    nan = float("nan")
    values = [("A", 2.0, "2"), ("B", 5.0, "x"), ("A", 1.0, None), (None, 4.0, "4"), ("Z", 1.0, "1"), ("C", nan, None)]
    s = plain(spark, [(2, 6), (9, 13), (18, 22), (22, 26), (500, 501), (90, 90)], ", grp string, score double, odd string", values)
    value = lambda **o: [r.value for r in rl.overlap_aggregate(q, s, **o).orderBy("query_id").collect()]
    assert value() == [1.0, 1.0, 2.0, 1.0]
    assert value(value_col="score", fun="sum") == [2, 5, 5, None] and value(value_col="score", fun="mean") == [2, 5, 2.5, None]
    assert value(value_col="score", fun="min") == [2, 5, 1, None] and value(value_col="score", fun="max") == [2, 5, 4, None]
    assert value(value_col="odd", fun="sum") == [2, None, 4, None] and value(value_col="odd", fun="sum", na_rm=False) == [2, None, None, None]
    rows = lambda df: [tuple(r)[1:] for r in df.orderBy("query_id").collect()]
    wide = rl.count_overlaps_by_group(q, s, "grp")
    assert wide.columns == ["query_id", "A", "B", "C", "Z"] and rows(wide) == [(1, 0, 0, 0), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0)]
    wide = rl.count_overlaps_by_group(q, s, "grp", include_na_group=True)
    assert wide.columns == ["query_id", "<NA>", "A", "B", "C", "Z"] and rows(wide)[2] == (1, 1, 0, 0, 0)
    with pytest.raises(ValueError, match="metadata column"):
        rl.overlap_aggregate(q, s, value_col="none", fun="sum")


def test_self_cluster_window(spark, chunks):
    x = plain(spark, [(1, 5), (3, 8), (10, 12), (11, 14), (20, 22)])
    assert got_pairs(rl.self_overlaps(x)) == [(1, 2), (3, 4)]
    assert len(got_pairs(rl.self_overlaps(x, drop_redundant=False))) == 4 and len(got_pairs(rl.self_overlaps(x, drop_redundant=False, drop_self=False))) == 9
    cluster = lambda r, **o: {c.range_id: (c.cluster_id, c.cluster_size) for c in rl.cluster_overlaps(r, **o).collect()}
    assert cluster(x) == {1: (1, 2), 2: (1, 2), 3: (2, 2), 4: (2, 2), 5: (3, 1)}
    for options in ({"ignore_strand": True}, {"max_gap": 2, "ignore_strand": True}, {}, {"type": "within"}, {"min_overlap": 8}):
        rows = draw(31, 80)
        edges = [(a, b) for a, b in oracle.pairs(rows, rows, **options) if a < b]
        assert cluster(genomic(spark, rows), **options) == oracle.components([r[0] for r in rows], edges), options
    w = rl.window_count_overlaps(plain(spark, [(1, 10), (12, 20)]), plain(spark, [(2, 3), (5, 6), (15, 16)]), window_width=5).orderBy("window_id").collect()
    assert [tuple(r) for r in w] == [(1, 1, 5, 2), (2, 6, 10, 1), (3, 11, 15, 1), (4, 16, 20, 1)]
    none = rl.window_count_overlaps(genomic(spark, [(1, "chr1", 1, 10, "+"), (2, "chr1", 20, 30, "-")]), genomic(spark, [(1, "chr1", 50, 55, "+")]), window_width=10)
    assert [r.overlap_count for r in none.collect()] == [0, 0, 0]


def test_algebra_and_coverage_example(spark):
    x, y = plain(spark, [(1, 5), (4, 8), (10, 12)]), plain(spark, [(3, 8), (20, 21)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(rl.reduce_ranges(x)) == [(1, 8), (10, 12)] and rows(rl.reduce_ranges(x, min_gap_width=2)) == [(1, 12)]
    assert [(a, b, list(i)) for a, b, i in rows(rl.reduce_ranges(x, with_revmap=True))] == [(1, 8, [1, 2]), (10, 12, [3])]
    assert rows(rl.disjoin(x)) == [(1, 3), (4, 5), (6, 8), (10, 12)]
    assert [list(r[2]) for r in rows(rl.disjoin(x, with_revmap=True))] == [[1], [1, 2], [2], [3]]
    assert rows(rl.gaps(x, start=1, end=15)) == [(9, 9), (13, 15)] and rows(rl.gaps(x)) == [(9, 9)]
    assert rows(rl.range_union(x, y)) == [(1, 8), (10, 12), (20, 21)]
    assert rows(rl.range_intersect(x, y)) == [(3, 8)] and rows(rl.range_setdiff(x, y)) == [(1, 2), (10, 12)]
    depth = [v for a, b, v in rows(rl.coverage(x)) for _ in range(a, b + 1)]
    assert depth == [1, 1, 1, 2, 2, 1, 1, 1, 0, 1, 1, 1]
    assert rows(rl.tile_coverage(x, tile_width=4)) == [(1, 4, 5), (5, 8, 5), (9, 12, 3)] and rows(rl.tile_coverage(x, tile_width=5)) == [(1, 5, 7), (6, 10, 4), (11, 12, 2)]
    assert rows(rl.coverage(x, shift=-3, width=12, weight=2)) == [(1, 2, 4), (3, 5, 2), (6, 6, 0), (7, 9, 2), (10, 12, 0)]
    assert rows(rl.coverage(plain(spark, []))) == [] and rows(rl.tile_coverage(plain(spark, []), tile_width=3)) == []


def test_algebra_against_positions(spark, chunks):
    x, y = draw(41, 40, span=200), draw(42, 40, span=200)
    a, b = genomic(spark, x), genomic(spark, y)
    px, py = oracle.positions(x), oracle.positions(y)

    def got(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.seqname, r.strand), []).append((r.start, r.end))
        return {k: sorted(v) for k, v in out.items()}

    def want(f):
        made = {k: oracle.runs(f(px.get(k, set()), py.get(k, set()))) for k in px.keys() | py.keys()}
        return {k: v for k, v in made.items() if v}

    assert got(rl.range_union(a, b)) == want(set.union)
    assert got(rl.range_intersect(a, b)) == want(set.intersection)
    assert got(rl.range_setdiff(a, b)) == want(set.difference)
    assert got(rl.reduce_ranges(a)) == {k: oracle.runs(v) for k, v in px.items()}
    cuts = {k: {p for _, n, s, e, d in x if (n, d) == k for p in (s, e + 1)} for k in px}
    pieces = {}
    for k, c in cuts.items():
        c = sorted(c)
        pieces[k] = [(p, q - 1) for p, q in zip(c, c[1:]) if p in px[k]]
    assert got(rl.disjoin(a)) == pieces
    depth = {}
    for _, n, s, e, _ in x:
        for p in range(s, e + 1):
            depth[n, p] = depth.get((n, p), 0) + 1
    flat = {(r.seqname, p): r.value for r in rl.coverage(a).collect() for p in range(r.start, r.end + 1)}
    assert {k: v for k, v in flat.items() if v} == depth
    tiles = rl.tile_coverage(a, tile_width=7, step_width=5).collect()
    assert all(t.coverage_sum == sum(depth.get((t.seqname, p), 0) for p in range(t.start, t.end + 1)) for t in tiles)


def test_gaps_with_lengths(spark):
    info = [("chr1", 20, False), ("chr2", 20, False)]
    x = genomic(spark, [(1, "chr1", 1, 3, "+"), (2, "chr1", 5, 8, "+"), (3, "chr2", 10, 12, "*")], seqinfo=info)
    got = sorted(map(tuple, rl.gaps(x).collect()))
    assert got == sorted([("chr1", 4, 4, "+"), ("chr1", 9, 20, "+"), ("chr1", 1, 20, "-"), ("chr1", 1, 20, "*"), ("chr2", 1, 20, "+"), ("chr2", 1, 20, "-"), ("chr2", 1, 9, "*"), ("chr2", 13, 20, "*")])
    assert sorted(map(tuple, rl.gaps(x, ignore_strand=True).collect())) == [("chr1", 4, 4, "*"), ("chr1", 9, 20, "*"), ("chr2", 1, 9, "*"), ("chr2", 13, 20, "*")]


def test_nearest_family(spark, chunks):
    q, s = draw(51, 60, span=300, width=12), draw(52, 40, span=300, width=12)
    a, b = genomic(spark, q), genomic(spark, s)
    for ignore in (False, True):
        for f, ahead in ((rl.precede, True), (rl.follow, False)):
            assert dict(map(tuple, f(a, b, ignore_strand=ignore).collect())) == {r[0]: oracle.beyond(r, s, ahead, ignore)[1] for r in q}
        want = {}
        for r in q:
            near = [(max(0, max(x[2] - r[3], r[2] - x[3]) - 1), x[0]) for x in s if x[1] == r[1] and (ignore or "*" in (x[4], r[4]) or x[4] == r[4])]
            if near:
                want[r[0]] = min(near)
        assert {x.query_id: (x.distance, x.subject_id) for x in rl.nearest(a, b, ignore_strand=ignore).collect()} == want
    assert rl.nearest(genomic(spark, [(1, "chr1", 1, 5, "*")]), genomic(spark, [(1, "chr9", 1, 5, "*")])).count() == 0


def test_nothing_in_common_and_empty_inputs(spark):
    q, s = genomic(spark, [(1, "chr1", 1, 5, "+"), (2, "chr1", 10, 14, "-")]), genomic(spark, [(1, "chr9", 1, 5, "+")])
    assert rl.find_overlaps(q, s).count() == 0 and [r.overlap_count for r in rl.count_overlaps(q, s).collect()] == [0, 0]
    none = genomic(spark, [])
    for f in (rl.find_overlaps, rl.count_overlaps, rl.overlaps_any, rl.nearest, rl.precede, rl.inner_overlap_join, rl.left_overlap_join, rl.range_union, rl.range_intersect):
        assert f(none, none).count() == 0
    for f in (rl.reduce_ranges, rl.disjoin, rl.gaps, rl.coverage, rl.cluster_overlaps, rl.self_overlaps):
        assert f(none).count() == 0
    assert rl.window_count_overlaps(none, none, window_width=3).count() == 0


def test_errors(spark):
    x = plain(spark, [(1, 5)])
    for options, text in (({"max_gap": -2}, ">= -1"), ({"min_overlap": -1}, ">= 0"), ({"type": "near"}, "one of"), ({"max_gap": None}, "numeric"), ({"ignore_strand": 1}, "logical"), ({"select": "any"}, "one of")):
        with pytest.raises(ValueError, match=text):
            rl.find_overlaps(x, x, **options)
    circle = genomic(spark, [(1, "chrM", 1, 5, "+")], seqinfo=[("chrM", 100, True)])
    with pytest.raises(ValueError, match="circular sequences, which are not currently supported"):
        rl.find_overlaps(circle, circle)
    with pytest.raises(ValueError, match="circular"):
        rl.build_index(circle)
    unused = genomic(spark, [(1, "chr1", 1, 5, "+")], seqinfo=[("chrM", 100, True), ("chr1", 50, False)])
    assert rl.find_overlaps(unused, unused).count() == 1
    with pytest.raises(ValueError, match="both be"):
        rl.find_overlaps(x, unused)
    with pytest.raises(TypeError, match="not currently supported"):
        rl.RangeSet.of_plain([x])
    with pytest.raises(ValueError, match="taken"):
        rl.overlap_join(x, x, query_prefix="", subject_prefix="")
    with pytest.raises(ValueError, match=">= 1"):
        rl.window_count_overlaps(x, x, window_width=0)


def test_index_round_trip(spark, tmp_path):
    q, s = draw(61, 50), draw(62, 120)
    a, b = genomic(spark, q), genomic(spark, s, seqinfo=[("chr1", 900, False), ("chr2", 900, False)])
    index = rl.build_index(b)
    path = rl.save_index(index, str(tmp_path / "index"), compress=False)
    loaded = rl.load_index(spark, path)
    want = oracle.pairs(q, s, max_gap=2)
    assert got_pairs(rl.find_overlaps(a, index, max_gap=2)) == got_pairs(rl.find_overlaps(a, loaded, max_gap=2)) == want
    assert dict(map(tuple, rl.count_overlaps(a, loaded).collect())) == dict(map(tuple, rl.count_overlaps(a, b).collect()))
    stats = rl.index_stats(loaded).first()
    assert (stats.subject_n, stats.partition_n, stats.block_n, stats.mean_partition_size) == (120, 2, 2, 60.0) and stats.index_size_mb > 0
    parts = rl.index_partitions(loaded).orderBy("seq_id").collect()
    assert parts[0].partition_start == 1 and parts[1].partition_end == 120 and parts[1].block_end == 2
    assert "120 ranges" in repr(loaded)
    with pytest.raises(FileNotFoundError):
        rl.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        rl.save_index(index, str(tmp_path / "no" / "index"))
    (tmp_path / "bad").mkdir()
    with pytest.raises(ValueError, match="not a saved index"):
        rl.load_index(spark, str(tmp_path / "bad"))


def test_iterator(spark):
    q, s = draw(71, 45), draw(72, 90)
    it = rl.OverlapIterator(genomic(spark, q), genomic(spark, s), chunk_size=20)
    want = oracle.pairs(q, s)
    assert "45 queries" in repr(it) and it.has_next()
    parts = [got_pairs(p) for p in it]
    assert len(parts) == 3 and sum(parts, []) == want and not it.has_next() and it.next().count() == 0
    first = got_pairs(it.reset().next())
    assert first == parts[0] and [tuple(r) for r in it.collect().collect()] == sum(parts[1:], []) and not it.has_next()
    assert not rl.OverlapIterator(genomic(spark, []), genomic(spark, s)).has_next()


def test_stream(spark, tmp_path):
    q, s = draw(81, 40), draw(82, 60)
    index, seen = rl.build_index(genomic(spark, s)), []
    df = spark.createDataFrame(q, G)
    for k in range(2):
        df.filter(F.col("range_id") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = rl.stream_overlaps(stream, index, lambda found, epoch: seen.extend(map(tuple, found.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(seen) == oracle.pairs(q, s)


def test_bed_round_trip(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t99\t159\tq1\t8\t+\nchr1\t179\t269\tq2\t10\t+\nchr2\t39\t79\tq4\t3\t.\n")
    x = rl.read_bed(spark, str(tmp_path / "a.bed"))
    rows = [tuple(r) for r in x.df.orderBy("range_id").collect()]
    assert rows == [(1, "chr1", 100, 159, "+", "q1", 8.0), (2, "chr1", 180, 269, "+", "q2", 10.0), (3, "chr2", 40, 79, "*", "q4", 3.0)]
    rl.write_bed(x, str(tmp_path / "out"), name="name", score="score")
    assert [tuple(r) for r in rl.read_bed(spark, str(tmp_path / "out")).df.orderBy("range_id").collect()] == rows


def test_default_threads(spark):
    assert rl.default_threads(spark) == 4


def test_a_few_long_ranges_cost_little(spark):
    """Short ranges must not meet one another in the wide bins of long ones."""
    made = lambda n, seed: spark.range(n).select(
        F.col("id").alias("range_id"), F.lit("chr1").alias("seqname"), (F.col("id") * 1000 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(900))).alias("start"), F.lit("*").alias("strand")
    )
    short = lambda n, seed: made(n, seed).withColumn("end", F.col("start") + 99)
    n = 120_000
    long = spark.range(10).select((F.col("id") + n).alias("range_id"), F.lit("chr1").alias("seqname"), F.lit(1).cast("long").alias("start"), F.lit("*").alias("strand"), F.lit(1000 * n).cast("long").alias("end"))
    q, s = rl.RangeSet.of_genomic(short(n, 1)), rl.RangeSet.of_genomic(short(n, 2))
    with_long = rl.RangeSet.of_genomic(short(n, 2).unionByName(long))
    timed = lambda x: (time.perf_counter(), rl.find_overlaps(q, x).count(), time.perf_counter())
    timed(s)
    a, few, b = timed(s)
    c, many, d = timed(with_long)
    assert many - few >= 10 * (n - 1)
    assert d - c < 2 * (b - a) + 3
    assert rl.find_overlaps(with_long, s).count() == n + 10 * n


def test_one_long_axis_is_no_quadratic_scan(spark):
    rows = spark.range(150_000).select(F.col("id").alias("range_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 3).alias("end"))
    x = rl.RangeSet.of_plain(rows)
    began = time.perf_counter()
    assert rl.precede(x, x).filter("subject_id = query_id + 1").count() == 149_999
    assert rl.coverage(x).count() == 300_000
    assert time.perf_counter() - began < 60


def test_a_saved_index_is_joined_without_exchanging_it(spark, tmp_path):
    q, s = draw(91, 60), draw(92, 150)
    loaded = rl.load_index(spark, rl.save_index(rl.build_index(genomic(spark, s)), str(tmp_path / "index")))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rl.find_overlaps(genomic(spark, q), loaded, max_gap=3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert got_pairs(found) == oracle.pairs(q, s, max_gap=3)
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= plan.count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_options_are_validated(spark):
    x = plain(spark, [(1, 5)])
    for options in ({"threads": 0}, {"threads": True}, {"threads": float("inf")}, {"deterministic": 1}):
        with pytest.raises(ValueError):
            rl.find_overlaps(x, x, **options)
        with pytest.raises(ValueError):
            rl.count_overlaps(x, x, **options)
    with pytest.raises(ValueError, match="numeric"):
        rl.find_overlaps(x, x, max_gap=float("inf"))


def test_tiles_far_along_the_axis(spark):
    rows = spark.createDataFrame([(i, 2_000_000_000 + i, 2_000_000_009 + i, 0.1) for i in range(50)], "range_id long, start long, end long, w double")
    x = rl.RangeSet.of_plain(rows)
    got = rl.tile_coverage(x, tile_width=1_000_000_000, weight="w").collect()
    assert abs(sum(r.coverage_sum for r in got) - 50.0) < 1e-9


def test_nearest_makes_no_pairs_of_crowded_sets(spark, monkeypatch):
    """Every query touches most subjects: the least id is found without their pairs."""
    rng = random.Random(7)
    q = [(i, i - 30, i - 30 + rng.randint(0, 40)) for i in range(1, 301)]
    s = [(i, a, a + rng.randint(0, 20)) for i, a in ((i, rng.randint(1, 60)) for i in rng.sample(range(1, 5000), 1500))]
    monkeypatch.setattr("rangeloom.operators.nearest.hits", None)
    a, b = (rl.RangeSet.of_plain(spark.createDataFrame(x, "range_id long, start long, end long")) for x in (q, s))
    want = {i: min((max(0, max(x[1] - e, st - x[2]) - 1), x[0]) for x in s) for i, st, e in q}
    assert {r.query_id: (r.distance, r.subject_id) for r in rl.nearest(a, b).collect()} == want


def test_exploded_windows_are_not_broadcast(spark, monkeypatch):
    """A few spans make very many windows; the planner sees the spans alone."""
    rows = spark.range(40).select(F.col("id").alias("range_id"), F.concat(F.lit("u"), F.col("id") % 20).alias("seqname"), (F.col("id") * 2000).alias("start"), (F.col("id") * 2000 + 9).alias("end"), F.lit("*").alias("strand"))
    x = rl.RangeSet.of_genomic(rows)
    monkeypatch.setattr("rangeloom.plans.binning.BROADCAST_ROWS", 10)
    monkeypatch.setattr("rangeloom.operators.derived.BROADCAST_ROWS", 10)
    found = rl.window_count_overlaps(x, x, window_width=10, step_width=5)
    assert found.filter("overlap_count > 0").agg(F.sum("overlap_count")).first()[0] == 20 * (2 + 3)
    counted = found.groupBy().count()
    counted.collect()
    assert "BroadcastHashJoin" not in counted._jdf.queryExecution().executedPlan().toString()


def _spread(spark, monkeypatch, make, tasks):
    """Rows are exchanged once ahead of aggregates and scans, into tasks by their number."""
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    plan = make()._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan, plan
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10**6)
    few = got_pairs(make())
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    assert got_pairs(make()) == few


def test_coverage_is_spread_by_rows(spark, monkeypatch):
    x = genomic(spark, draw(61, 200))
    _spread(spark, monkeypatch, lambda: rl.coverage(x), 20)


def test_weighted_coverage_is_spread_by_rows(spark, monkeypatch):
    rows = [(*r, float(r[0] % 7)) for r in draw(62, 200)]
    x = genomic(spark, rows, ", w double")
    _spread(spark, monkeypatch, lambda: rl.coverage(x, shift=-10, width=300, weight="w"), 20)
    want = [sum(r[5] for r in rows if r[1] == "chr1" and r[2] - 10 <= p <= r[3] - 10) for p in range(1, 301)]
    got = {p: r.value for r in rl.coverage(x, shift=-10, width=300, weight="w").filter("seqname = 'chr1'").collect() for p in range(r.start, r.end + 1)}
    assert [got[p] for p in range(1, 301)] == want


def test_set_algebra_is_spread_by_rows(spark, monkeypatch):
    x, y = genomic(spark, draw(63, 120)), genomic(spark, draw(64, 80))
    for f in (rl.range_intersect, rl.range_union, rl.range_setdiff):
        _spread(spark, monkeypatch, lambda: f(x, y), 20)  # noqa: B023


def test_group_counts_need_no_pairs_where_dense(spark, monkeypatch):
    monkeypatch.setattr(overlap, "DENSE", 0)
    q, rows = draw(65, 120), [(*r, "ab`n"[r[0] % 4] if r[0] % 5 else None) for r in draw(66, 80)]
    a, b = genomic(spark, q), genomic(spark, rows, ", grp string")
    _spread(spark, monkeypatch, lambda: rl.count_overlaps_by_group(a, b, "grp", max_gap=2), 20)
    for options in ({"max_gap": 2}, {"min_overlap": 4}, {"ignore_strand": True}):
        got = {r[0]: r[1:] for r in map(tuple, rl.count_overlaps_by_group(a, b, "grp", **options).collect())}
        found = oracle.pairs(q, [r[:5] for r in rows], **options)
        grp = {r[0]: r[5] for r in rows}
        assert got == {r[0]: tuple(sum(1 for i, j in found if i == r[0] and grp[j] == g) for g in sorted("ab`n")) for r in q}


def test_group_counts_with_a_missing_group_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "DENSE", 0)
    q, rows = draw(67, 120), [(*r, "ab"[r[0] % 2] if r[0] % 5 else None) for r in draw(68, 80)]
    a, b = genomic(spark, q), genomic(spark, rows, ", grp string")
    made = lambda: rl.count_overlaps_by_group(a, b, "grp", include_na_group=True)
    _spread(spark, monkeypatch, made, 20)
    grp, found = {r[0]: r[5] for r in rows}, oracle.pairs(q, [r[:5] for r in rows])
    assert {r[0]: r[1:] for r in map(tuple, made().collect())} == {r[0]: tuple(sum(1 for i, j in found if i == r[0] and grp[j] == g) for g in (None, "a", "b")) for r in q}


def test_an_index_holds_rows_at_home_only(spark, tmp_path):
    """Long queries lift short subjects when they are asked, not when it is built."""
    s = [(i, "chr1", 50 * i, 50 * i + 3, "*") for i in range(1, 301)]
    q = [(1, "chr1", 40, 14_000, "*"), (2, "chr1", 100, 101, "+"), (3, "chr1", 600, 2500, "-"), (4, "chr2", 1, 9000, "*")]
    index = rl.build_index(genomic(spark, s))
    rows = index.ranges.binned[-1]
    assert index.ranges.binned[0].levels > 1 and rows.count() < 2 * len(s) and "own" not in rows.columns
    loaded = rl.load_index(spark, rl.save_index(index, str(tmp_path / "index")))
    for i in (index, loaded):
        assert got_pairs(rl.find_overlaps(genomic(spark, q), i)) == oracle.pairs(q, s)
    index.unpersist()
