"""Registered interval queries on the driver's tables, and the same in SQL.

Three range sets are derived from whole tables: user activity (``events``), order
windows of thirty days (``orders``) and shipments (``lineitem``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rangeloom as rl
from rangeloom.model import RangeSet
from rangeloom.operators.derived import numbered
from rangeloom.plans.components import ensure_checkpoint_dir

DAY, BASE = "timestamp_ntz'1992-01-01'", "timestamp_ntz'2024-01-01'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> RangeSet:
    at = F.expr(f"timestampdiff(SECOND, {BASE}, ts) + 1")
    strand = F.when(F.col("event_type").isin("click", "view"), "+").when(F.col("event_type").isin("purchase", "signup"), "-").otherwise("*")
    df = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("range_id"), F.concat(F.lit("u"), F.col("user_id")).alias("seqname"), at.alias("start"),
        (at + F.floor(F.col("value") * 60)).alias("end"), strand.alias("strand"), F.col("event_type").alias("grp"), F.col("value").alias("score"),
    )
    return RangeSet.of_genomic(df)


def windows(spark: SparkSession, sf_dir: str) -> RangeSet:
    n = _read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    at = F.expr(f"timestampdiff(DAY, {DAY}, o_orderdate) + 1")
    df = _read(spark, sf_dir, "orders").join(F.broadcast(n)).select(  # one number beside each row
        F.col("o_orderkey").alias("range_id"), F.concat(F.lit("s"), F.col("o_custkey") % F.col("n")).alias("seqname"), at.alias("start"), (at + 29).alias("end"), F.lit("*").alias("strand")
    )
    return RangeSet.of_genomic(df)


def shipments(spark: SparkSession, sf_dir: str) -> RangeSet:
    at = F.expr(f"timestampdiff(DAY, {DAY}, l_shipdate) + 1")
    df = _read(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("range_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("seqname"), at.alias("start"),
        (at + F.col("l_quantity").cast("long") - 1).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
    )
    return RangeSet.of_genomic(df)


def _set(df: DataFrame) -> RangeSet:
    return RangeSet.of_genomic(df)


# --- SQL -------------------------------------------------------------------

EV = """ev AS (SELECT event_id AS id, 'u' || user_id AS sq, st, st + floor(value * 60)::BIGINT AS en,
  CASE WHEN event_type IN ('click', 'view') THEN '+' WHEN event_type IN ('purchase', 'signup') THEN '-' ELSE '*' END AS sd, event_type AS grp, value AS score
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 + 1 AS st FROM events))"""
OW = """ow AS (SELECT o_orderkey AS id, 's' || (o_custkey % (SELECT count(*) FROM supplier)) AS sq, st, st + 29 AS en, '*' AS sd
  FROM (SELECT *, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) // 86400000000 + 1 AS st FROM orders))"""
LI = """li AS (SELECT 's' || l_suppkey AS sq, st, st + l_quantity::BIGINT - 1 AS en, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS sd,
  l_quantity AS quantity, l_returnflag AS flag FROM (SELECT *, (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1992-01-01')) // 86400000000 + 1 AS st FROM lineitem))"""
STRAND = "(q.sd = '*' OR s.sd = '*' OR q.sd = s.sd)"


def _on(gap: int = -1, need: int = 0, strand: bool = True, more: str = "") -> str:
    out = f"q.sq = s.sq AND greatest(s.st - q.en, q.st - s.en) - 1 <= {gap}"
    if need:
        out += f" AND least(q.en, s.en) - greatest(q.st, s.st) + 1 >= {need}"
    return out + (f" AND {STRAND}" if strand else "") + (f" AND {more}" if more else "")


def _find(on: str) -> str:
    return f"WITH {EV} SELECT q.id AS query_id, s.id AS subject_id FROM ev q JOIN ev s ON {on}"


def _select(agg: str) -> str:
    return f"WITH {EV} SELECT q.id AS query_id, {agg}(s.id) AS subject_id FROM ev q LEFT JOIN ev s ON {_on(60, strand=True, more='q.id <> s.id')} GROUP BY q.id"


def _count(column: str, on: str) -> str:
    return f"WITH {OW}, {LI}, n AS (SELECT q.id, count(*) AS n FROM ow q JOIN li s ON {on} GROUP BY q.id) SELECT ow.id AS query_id, {column} FROM ow LEFT JOIN n ON n.id = ow.id"


def _agg(fun: str) -> str:
    return (
        f"WITH {OW}, {LI}, v AS (SELECT q.id, {fun}(s.quantity) AS v FROM ow q JOIN li s ON {_on()} GROUP BY q.id) "
        "SELECT ow.id AS query_id, v.v AS value FROM ow LEFT JOIN v ON v.id = ow.id"
    )


COLS = "{p}.sq AS {n}_seqname, {p}.st AS {n}_start, {p}.en AS {n}_end, {p}.en - {p}.st + 1 AS {n}_width, {p}.sd AS {n}_strand, {p}.grp AS {n}_grp, {p}.score AS {n}_score"
Q_COLS, S_COLS = COLS.format(p="q", n="query"), COLS.format(p="s", n="subject")


def _join(kind: str) -> str:
    return f"WITH {EV} SELECT q.id AS query_id, s.id AS subject_id, {Q_COLS}, {S_COLS} FROM ev q {kind} JOIN ev s ON {_on(more=OTHER)}"


OTHER = "q.id <> s.id"


def _counted(test: str) -> str:
    return (
        f"WITH {OW}, {LI}, n AS (SELECT q.id, count(*) AS n FROM ow q JOIN li s ON {_on(-1, 25)} GROUP BY q.id) "
        "SELECT q.id AS query_id, coalesce(n.n, 0) AS overlap_count, q.sq AS query_seqname, q.st AS query_start, q.en AS query_end, q.en - q.st + 1 AS query_width, q.sd AS query_strand "
        f"FROM ow q LEFT JOIN n ON n.id = q.id WHERE coalesce(n.n, 0) {test}"
    )


def _islands(table: str, keys: str, gap: int, name: str = "isl") -> str:
    return (
        f"{name} AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY st, en, o ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN st - max(en) OVER "
        f"(PARTITION BY {keys} ORDER BY st, en, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 >= {gap} THEN 1 ELSE 0 END AS new FROM {table}))"
    )


def _reduced(gap: int) -> str:
    return (
        f"WITH {LI}, o AS (SELECT *, row_number() OVER () AS o FROM li), {_islands('o', 'sq, sd', gap)} "
        "SELECT sq AS seqname, min(st) AS start, max(en) AS \"end\", sd AS strand FROM isl GROUP BY sq, sd, isl.isl"
    )


DEPTH = (
    "p AS (SELECT sq, pos, sum(x) AS x, sum(y) AS y FROM (SELECT sq, st AS pos, 1 AS x, 0 AS y FROM ow UNION ALL SELECT sq, en + 1, -1, 0 FROM ow UNION ALL "
    "SELECT sq, st, 0, 1 FROM li UNION ALL SELECT sq, en + 1, 0, -1 FROM li) GROUP BY sq, pos), "
    "d AS (SELECT sq, pos AS st, lead(pos) OVER w - 1 AS en, sum(x) OVER w AS x, sum(y) OVER w AS y, pos AS o FROM p WINDOW w AS (PARTITION BY sq ORDER BY pos))"
)


def _combined(keep: str) -> str:
    return (
        f"WITH {OW}, {LI}, {DEPTH}, k AS (SELECT * FROM d WHERE en IS NOT NULL AND {keep}), {_islands('k', 'sq', 1)} "
        "SELECT sq AS seqname, min(st) AS start, max(en) AS \"end\", '*' AS strand FROM isl GROUP BY sq, isl.isl"
    )


RUNS = (
    "l AS (SELECT sq, max(en) AS n FROM li GROUP BY sq), "
    "e AS (SELECT sq, pos, sum(v) AS v FROM (SELECT sq, st AS pos, 1 AS v FROM li UNION ALL SELECT sq, en + 1, -1 FROM li UNION ALL SELECT sq, 1, 0 FROM l "
    "UNION ALL SELECT sq, n + 1, 0 FROM l) GROUP BY sq, pos), "
    "f AS (SELECT e.* FROM e JOIN l USING (sq) WHERE v <> 0 OR pos = 1 OR pos = n + 1), "
    "runs AS (SELECT * FROM (SELECT sq, pos AS st, lead(pos) OVER w - 1 AS en, (sum(v) OVER w)::BIGINT AS value FROM f WINDOW w AS (PARTITION BY sq ORDER BY pos)) WHERE en IS NOT NULL)"
)


def _tiles(tile: int, step: int) -> str:
    return (
        f"WITH {LI}, {RUNS}, t AS (SELECT sq, st, least(st + {tile} - 1, n) AS en FROM (SELECT sq, n, unnest(range(1, n + 1, {step})) AS st FROM l)) "
        "SELECT t.sq AS seqname, t.st AS start, t.en AS \"end\", coalesce(sum((least(t.en, r.en) - greatest(t.st, r.st) + 1) * r.value), 0)::DOUBLE AS coverage_sum "
        "FROM t LEFT JOIN runs r ON r.sq = t.sq AND r.st <= t.en AND r.en >= t.st AND r.value <> 0 GROUP BY ALL"
    )


def _windows(width: int, step: int) -> str:
    return (
        f"WITH {EV}, b AS (SELECT sq, min(st) AS lo, max(en) AS hi FROM ev GROUP BY sq), g AS (SELECT sq, unnest(range(lo, hi + 1, {step})) AS st FROM b), "
        f"w AS (SELECT row_number() OVER (ORDER BY sq, st) AS id, sq, st, st + {width} - 1 AS en FROM g), "
        "n AS (SELECT w.id, count(*) AS n FROM w JOIN ev s ON s.sq = w.sq AND s.st <= w.en AND s.en >= w.st GROUP BY w.id) "
        "SELECT w.id AS window_id, w.sq AS seqname, w.st AS start, w.en AS \"end\", coalesce(n.n, 0) AS overlap_count FROM w LEFT JOIN n ON n.id = w.id"
    )


# Each event against the others of its user: candidates by class, ties to the least id.
_AFTER, _BEFORE = "{'d': s.st - q.en - 1, 'i': s.id}", "{'d': q.st - s.en - 1, 'i': s.id}"


def _way(ahead: bool) -> str:
    fwd, back = (_AFTER, _BEFORE) if ahead else (_BEFORE, _AFTER)
    is_fwd, is_back = ("s.st > q.en", "s.en < q.st") if ahead else ("s.en < q.st", "s.st > q.en")
    return (
        f"WITH {EV}, c AS (SELECT q.id, CASE WHEN q.sd <> '-' AND s.sd <> '-' AND {is_fwd} THEN {fwd} END AS f, "
        f"CASE WHEN q.sd <> '+' AND s.sd <> '+' AND {is_back} THEN {back} END AS b FROM ev q JOIN ev s ON q.sq = s.sq) "
        "SELECT id AS query_id, least(min(f), min(b)).i AS subject_id FROM c GROUP BY id"
    )


NEAREST = (
    f"WITH {EV} SELECT q.id AS query_id, min({{'d': greatest(0, greatest(s.st - q.en, q.st - s.en) - 1), 'i': s.id}}).i AS subject_id, "
    f"min(greatest(0, greatest(s.st - q.en, q.st - s.en) - 1)) AS distance FROM ev q JOIN ev s ON q.sq = s.sq AND {STRAND} GROUP BY q.id"
)
CLUSTER = (
    f"WITH {EV}, o AS (SELECT *, id AS o FROM ev), {_islands('o', 'sq', 61)}, c AS (SELECT id, min(id) OVER k AS least, count(*) OVER k AS n FROM isl WINDOW k AS (PARTITION BY sq, isl.isl)) "
    "SELECT id AS range_id, dense_rank() OVER (ORDER BY least) AS cluster_id, n AS cluster_size FROM c"
)
CLUSTER_STRAND = (
    f"WITH RECURSIVE {EV}, k AS (SELECT q.id AS a, s.id AS b FROM ev q JOIN ev s ON {_on(60, more='q.id < s.id')}), l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), "
    "r AS (SELECT a AS id, a AS reach FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a), c AS (SELECT id, min(reach) AS m FROM r GROUP BY id), "
    "x AS (SELECT ev.id, coalesce(m, ev.id) AS least FROM ev LEFT JOIN c ON c.id = ev.id) "
    "SELECT id AS range_id, dense_rank() OVER (ORDER BY least) AS cluster_id, count(*) OVER (PARTITION BY least) AS cluster_size FROM x"
)
GAPS = (
    f"WITH {LI}, o AS (SELECT *, row_number() OVER () AS o FROM li), {_islands('o', 'sq, sd', 1)}, "
    "r AS (SELECT sq, sd, min(st) AS st, max(en) AS en FROM isl GROUP BY sq, sd, isl.isl), "
    "g AS (SELECT sq, sd, lag(en) OVER (PARTITION BY sq, sd ORDER BY st) + 1 AS st, st - 1 AS en FROM r) "
    "SELECT sq AS seqname, st AS start, en AS \"end\", sd AS strand FROM g WHERE st IS NOT NULL"
)
DISJOIN = (
    f"WITH {LI}, p AS (SELECT sq, sd, pos, sum(x) AS x FROM (SELECT sq, sd, st AS pos, 1 AS x FROM li UNION ALL SELECT sq, sd, en + 1, -1 FROM li) GROUP BY ALL), "
    "d AS (SELECT sq, sd, pos AS st, lead(pos) OVER w - 1 AS en, sum(x) OVER w AS x FROM p WINDOW w AS (PARTITION BY sq, sd ORDER BY pos)) "
    "SELECT sq AS seqname, st AS start, en AS \"end\", sd AS strand FROM d WHERE x > 0"
)
GROUPS = (
    f"WITH {OW}, {LI}, n AS (SELECT q.id, " + ", ".join(f"count(*) FILTER (s.flag = '{g}') AS \"{g}\"" for g in "ANR")
    + f" FROM ow q JOIN li s ON {_on()} GROUP BY q.id) SELECT ow.id AS query_id, " + ", ".join(f"coalesce(n.\"{g}\", 0) AS \"{g}\"" for g in "ANR") + " FROM ow LEFT JOIN n ON n.id = ow.id"
)
STATS = (
    f"WITH {LI}, p AS (SELECT sq, count(*) AS n FROM li GROUP BY sq) SELECT sum(n)::BIGINT AS subject_n, count(*) AS partition_n, sum(ceil(n / 2048.0))::BIGINT AS block_n, "
    "count(*) AS seqlevel_n, avg(n) AS mean_partition_size FROM p"
)

OTHERS = "q.id < s.id"


def _ev(options: dict, select: str = "all"):
    return lambda s, d: rl.find_overlaps(e := events(s, d), e, select=select, **options)


def _pairs_of(operator, **options):
    return lambda s, d: operator(windows(s, d), shipments(s, d), **options)


def _other(df: DataFrame) -> DataFrame:
    return df.filter("query_id <> subject_id")


def _iterator(s: SparkSession, d: str, parts: int) -> rl.OverlapIterator:
    e = events(s, d)
    return rl.OverlapIterator(e, e, chunk_size=-(-e.stats.n // parts), deterministic=False)


def _iterate(s: SparkSession, d: str) -> DataFrame:
    return _iterator(s, d, 1).collect()


def _chunks(s: SparkSession, d: str) -> DataFrame:
    it, out = _iterator(s, d, 3), None
    while it.has_next():
        out = it.next() if out is None else out.union(it.next())
    return out


def _reset(s: SparkSession, d: str) -> DataFrame:
    it = _iterator(s, d, 4)
    it.next()
    return it.reset().next().union(it.collect())


def _state(s: SparkSession, d: str) -> DataFrame:
    it = _iterator(s, d, 2)
    rows = [(0, it.has_next(), repr(it))]
    for step in (1, 2):
        it.next()
        rows.append((step, it.has_next(), repr(it)))
    return s.createDataFrame(rows, "step int, has_next boolean, shown string")


def saved_index(s: SparkSession, d: str) -> rl.SubjectIndex:
    """An index of the events, saved and loaded again in the shared folder."""
    ensure_checkpoint_dir(s)
    path = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    return rl.load_index(s, rl.save_index(rl.build_index(events(s, d)), path))


def plain_events(s: SparkSession, d: str) -> RangeSet:
    """The events on one axis, of no sequence or strand."""
    return RangeSet.of_plain(events(s, d).df.drop("seqname", "strand"))


def plain_days(s: SparkSession, d: str) -> RangeSet:
    """Shipments as plain ranges of days."""
    return RangeSet.of_plain(shipments(s, d).df.drop("seqname", "strand"))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """The place of each match in the deterministic order."""
    e = events(s, d)
    return numbered(rl.find_overlaps(e, e, max_gap=60, deterministic=True).withColumn("k", F.struct("query_id", "subject_id")), "k", "place").drop("k")


def _as_text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))


def with_lengths(s: SparkSession, d: str) -> RangeSet:
    x = shipments(s, d)
    return RangeSet.of_genomic(x.df, x.df.select("seqname").distinct().select("seqname", F.lit(3000).cast("long").alias("seqlength"), F.lit(False).alias("is_circular")))


def with_gaps(s: SparkSession, d: str) -> RangeSet:
    """Shipments of which some have no group and no quantity."""
    x = shipments(s, d).df
    return RangeSet.of_genomic(x.withColumn("flag", F.when(F.col("flag") != "R", F.col("flag"))).withColumn("quantity", F.when(F.col("quantity") < 50, F.col("quantity"))))


def _select_other(s: SparkSession, d: str, pick) -> DataFrame:
    e = events(s, d)
    best = _other(rl.find_overlaps(e, e, max_gap=60)).groupBy("query_id").agg(pick("subject_id").alias("subject_id"))
    return e.df.select(F.col("range_id").alias("query_id")).join(best, "query_id", "left")


def _left(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return rl.left_overlap_join(e, e, max_gap=60)


PEV = EV.replace("'u' || user_id AS sq", "'range' AS sq")
LX = LI.replace("l_returnflag AS flag", "CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag").replace("l_quantity AS quantity", "CASE WHEN l_quantity < 50 THEN l_quantity END AS quantity")
NO_GROUP = (
    f"WITH {OW}, {LX}, n AS (SELECT q.id, " + ", ".join(f"count(*) FILTER (coalesce(s.flag, '<NA>') = '{g}') AS \"{g}\"" for g in ("A", "N", "<NA>"))
    + f" FROM ow q JOIN li s ON {_on()} GROUP BY q.id) SELECT ow.id AS query_id, " + ", ".join(f"coalesce(n.\"{g}\", 0) AS \"{g}\"" for g in ("A", "N", "<NA>")) + " FROM ow LEFT JOIN n ON n.id = ow.id"
)
STRICT = (
    f"WITH {OW}, {LX}, v AS (SELECT q.id, CASE WHEN count(s.quantity) = count(*) THEN sum(s.quantity) END AS v FROM ow q JOIN li s ON {_on()} GROUP BY q.id) "
    "SELECT ow.id AS query_id, v.v AS value FROM ow LEFT JOIN v ON v.id = ow.id"
)
PLAIN_REDUCE = (
    f"WITH {PEV}, o AS (SELECT *, id AS o FROM ev), {_islands('o', 'sq', 1)} "
    "SELECT min(st) AS start, max(en) AS \"end\", array_to_string(list_sort(list(id)), ',') AS revmap FROM isl GROUP BY isl.isl"
)
REVMAP = (
    f"WITH {EV}, o AS (SELECT *, id AS o FROM ev), {_islands('o', 'sq, sd', 1)} "
    "SELECT sq AS seqname, min(st) AS start, max(en) AS \"end\", sd AS strand, array_to_string(list_sort(list(id)), ',') AS revmap FROM isl GROUP BY sq, sd, isl.isl"
)
DISJOIN_MAP = (
    f"WITH {EV}, p AS (SELECT DISTINCT sq, sd, pos FROM (SELECT sq, sd, st AS pos FROM ev UNION ALL SELECT sq, sd, en + 1 FROM ev)), "
    "d AS (SELECT sq, sd, pos AS st, lead(pos) OVER (PARTITION BY sq, sd ORDER BY pos) - 1 AS en FROM p) "
    "SELECT d.sq AS seqname, d.st AS start, d.en AS \"end\", d.sd AS strand, array_to_string(list_sort(list(ev.id)), ',') AS revmap "
    "FROM d JOIN ev ON ev.sq = d.sq AND ev.sd = d.sd AND ev.st <= d.en AND ev.en >= d.st WHERE d.en IS NOT NULL GROUP BY ALL"
)


def _bounded_gaps(keys: str, lo: str, hi: str) -> str:
    return (
        f"WITH {LI}, k AS ({keys}), o AS (SELECT sq, sd, st, en, row_number() OVER () AS o FROM li), {_islands('o', 'sq, sd', 1)}, "
        "r AS (SELECT sq, sd, min(st) AS st, max(en) AS en FROM isl GROUP BY sq, sd, isl.isl), "
        f"f AS (SELECT sq, sd, st, en FROM r UNION ALL SELECT sq, sd, {lo}, {lo} - 1 FROM k UNION ALL SELECT sq, sd, {hi} + 1, {hi} FROM k), "
        "g AS (SELECT sq, sd, max(en) OVER (PARTITION BY sq, sd ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS st, st - 1 AS en FROM f) "
        f"SELECT sq AS seqname, greatest(st, {lo}) AS start, least(en, {hi}) AS \"end\", sd AS strand FROM g WHERE st IS NOT NULL AND greatest(st, {lo}) <= least(en, {hi})"
    )


_SHIFTED = RUNS.replace("l AS (SELECT sq, max(en) AS n FROM li GROUP BY sq)", "l AS (SELECT DISTINCT sq, 2000 AS n FROM li), c AS (SELECT sq, greatest(st - 100, 1) AS st, least(en - 100, 2000) AS en, quantity AS w FROM li WHERE st - 100 <= 2000 AND en - 100 >= 1)")
_SHIFTED = _SHIFTED.replace("SELECT sq, st AS pos, 1 AS v FROM li UNION ALL SELECT sq, en + 1, -1 FROM li", "SELECT sq, st AS pos, w AS v FROM c UNION ALL SELECT sq, en + 1, -w FROM c").replace("(sum(v) OVER w)::BIGINT", "(sum(v) OVER w)::DOUBLE")
PARTS = (
    f"WITH {LI}, p AS (SELECT sq, count(*) AS n, ceil(count(*) / 2048.0)::BIGINT AS b FROM li GROUP BY sq) SELECT row_number() OVER (ORDER BY sq) AS seq_id, sq AS seqname, "
    "(sum(n) OVER w - n + 1)::BIGINT AS partition_start, (sum(n) OVER w)::BIGINT AS partition_end, n AS n_ranges, (sum(b) OVER w - b + 1)::BIGINT AS block_start, (sum(b) OVER w)::BIGINT AS block_end, b AS n_blocks "
    "FROM p WINDOW w AS (ORDER BY sq)"
)
STATE = (
    "WITH n AS (SELECT count(*) AS n, (count(*) + 1) // 2 AS c FROM events) SELECT step::INTEGER AS step, n - step * c > 0 AS has_next, "
    "'OverlapIterator(' || n || ' queries, chunks of ' || c || ', ' || greatest(0, n - step * c) || ' left)' AS shown FROM n, (SELECT unnest([0, 1, 2]) AS step)"
)
SHOWN = f"WITH {LI} SELECT 'SubjectIndex(genomic, ' || count(*) || ' ranges, ' || count(DISTINCT sq) || ' partitions)' AS shown FROM li"
INDEX = STATS.replace("avg(n) AS mean_partition_size", "avg(n) AS mean_partition_size, (sum(n) * 40 / 1048576)::DOUBLE AS index_size_mb")

_ALL = {
    "find_any": (_ev({}), _find(_on())),
    "find_ignore_strand": (_ev({"ignore_strand": True}), _find(_on(strand=False))),
    "find_within": (_ev({"type": "within"}), _find(_on(more="q.st >= s.st AND q.en <= s.en"))),
    "find_within_gap": (_ev({"type": "within", "max_gap": 500}), _find(_on(500, more="q.st >= s.st AND q.en <= s.en AND (s.en - s.st) - (q.en - q.st) <= 500"))),
    "find_start_tol": (_ev({"type": "start", "max_gap": 600}), _find(_on(600, more="abs(q.st - s.st) <= 600"))),
    "find_end_tol": (_ev({"type": "end", "max_gap": 600}), _find(_on(600, more="abs(q.en - s.en) <= 600"))),
    "find_equal_tol": (_ev({"type": "equal", "max_gap": 900}), _find(_on(900, more="abs(q.st - s.st) <= 900 AND abs(q.en - s.en) <= 900"))),
    "find_equal": (_ev({"type": "equal"}), _find(_on(more="q.st = s.st AND q.en = s.en"))),
    "find_maxgap": (_ev({"max_gap": 3600}), _find(_on(3600))),
    "find_minoverlap": (_ev({"min_overlap": 300}), _find(_on(-1, 300))),
    "find_indexed": (lambda s, d: rl.find_overlaps(events(s, d), rl.build_index(events(s, d)), max_gap=120), _find(_on(120))),
    "iter_collect": (_iterate, _find(_on())),
    "select_first": (lambda s, d: rl.find_overlaps(e := events(s, d), e, select="first", max_gap=3600), f"WITH {EV} SELECT q.id AS query_id, min(s.id) AS subject_id FROM ev q LEFT JOIN ev s ON {_on(3600)} GROUP BY q.id"),
    "select_last": (lambda s, d: rl.find_overlaps(e := events(s, d), e, select="last", max_gap=3600), f"WITH {EV} SELECT q.id AS query_id, max(s.id) AS subject_id FROM ev q LEFT JOIN ev s ON {_on(3600)} GROUP BY q.id"),
    "select_arbitrary": (lambda s, d: rl.find_overlaps(windows(s, d), events(s, d), select="arbitrary"), f"WITH {OW}, {EV} SELECT q.id AS query_id, min(s.id) AS subject_id FROM ow q LEFT JOIN ev s ON {_on()} GROUP BY q.id"),
    "select_other": (lambda s, d: _select_other(s, d, F.min), _select("min")),
    "count": (_pairs_of(rl.count_overlaps), _count("coalesce(n.n, 0) AS overlap_count", _on())),
    "count_gap": (_pairs_of(rl.count_overlaps, max_gap=5), _count("coalesce(n.n, 0) AS overlap_count", _on(5))),
    "count_minoverlap": (_pairs_of(rl.count_overlaps, min_overlap=10), _count("coalesce(n.n, 0) AS overlap_count", _on(-1, 10))),
    "count_within": (_pairs_of(rl.count_overlaps, type="within"), _count("coalesce(n.n, 0) AS overlap_count", _on(more="q.st >= s.st AND q.en <= s.en"))),
    "count_strand": (lambda s, d: rl.count_overlaps(e := events(s, d), e, max_gap=30), f"WITH {EV} SELECT q.id AS query_id, count(s.id) AS overlap_count FROM ev q LEFT JOIN ev s ON {_on(30)} GROUP BY q.id"),
    "any": (_pairs_of(rl.overlaps_any, type="within"), _count("coalesce(n.n, 0) > 0 AS overlaps_any", _on(more="q.st >= s.st AND q.en <= s.en"))),
    "join_inner": (lambda s, d: _other(rl.inner_overlap_join(e := events(s, d), e)), _join("")),
    "join_left": (_left, f"WITH {EV} SELECT q.id AS query_id, s.id AS subject_id, {Q_COLS}, {S_COLS} FROM ev q LEFT JOIN ev s ON {_on(60)}"),
    "join_left_unmatched": (lambda s, d: rl.left_overlap_join(windows(s, d), events(s, d)).select("query_id", "subject_id", "query_start", "subject_grp"),
                            f"WITH {OW}, {EV} SELECT q.id AS query_id, s.id AS subject_id, q.st AS query_start, s.grp AS subject_grp FROM ow q LEFT JOIN ev s ON {_on()}"),
    "join_semi": (_pairs_of(rl.semi_overlap_join, min_overlap=25), _counted("> 0")),
    "join_anti": (_pairs_of(rl.anti_overlap_join, min_overlap=25), _counted("= 0")),
    "count_by_group": (_pairs_of(rl.count_overlaps_by_group, group_col="flag"), GROUPS),
    "agg_count": (_pairs_of(rl.overlap_aggregate), _count("coalesce(n.n, 0)::DOUBLE AS value", _on())),
    "agg_sum": (_pairs_of(rl.overlap_aggregate, value_col="quantity", fun="sum"), _agg("sum")),
    "agg_mean": (_pairs_of(rl.overlap_aggregate, value_col="quantity", fun="mean"), _agg("avg")),
    "agg_min": (_pairs_of(rl.overlap_aggregate, value_col="quantity", fun="min"), _agg("min")),
    "agg_max": (_pairs_of(rl.overlap_aggregate, value_col="quantity", fun="max"), _agg("max")),
    "self_overlaps": (lambda s, d: rl.self_overlaps(events(s, d)), _find(_on(more=OTHERS))),
    "self_keep_redundant": (lambda s, d: rl.self_overlaps(events(s, d), drop_redundant=False, ignore_strand=True), _find(_on(strand=False, more=OTHER))),
    "window_count_tumbling": (lambda s, d: rl.window_count_overlaps(e := events(s, d), e, window_width=86400), _windows(86400, 86400)),
    "window_count_sliding": (lambda s, d: rl.window_count_overlaps(e := events(s, d), e, window_width=86400, step_width=43200), _windows(86400, 43200)),
    "coverage": (lambda s, d: rl.coverage(shipments(s, d)), f"WITH {LI}, {RUNS} SELECT sq AS seqname, st AS start, en AS \"end\", value FROM runs"),
    "tile_coverage": (lambda s, d: rl.tile_coverage(shipments(s, d), tile_width=30), _tiles(30, 30)),
    "tile_coverage_sliding": (lambda s, d: rl.tile_coverage(shipments(s, d), tile_width=60, step_width=45), _tiles(60, 45)),
    "reduce": (lambda s, d: rl.reduce_ranges(shipments(s, d)), _reduced(1)),
    "reduce_min_gap": (lambda s, d: rl.reduce_ranges(shipments(s, d), min_gap_width=5), _reduced(5)),
    "disjoin": (lambda s, d: rl.disjoin(shipments(s, d)), DISJOIN),
    "gaps": (lambda s, d: rl.gaps(shipments(s, d)), GAPS),
    "range_union": (lambda s, d: rl.range_union(windows(s, d), shipments(s, d), ignore_strand=True), _combined("(x > 0 OR y > 0)")),
    "range_intersect": (lambda s, d: rl.range_intersect(windows(s, d), shipments(s, d), ignore_strand=True), _combined("x > 0 AND y > 0")),
    "range_setdiff": (lambda s, d: rl.range_setdiff(windows(s, d), shipments(s, d), ignore_strand=True), _combined("x > 0 AND y = 0")),
    "nearest": (lambda s, d: rl.nearest(e := events(s, d), e), NEAREST),
    "precede": (lambda s, d: rl.precede(e := events(s, d), e), _way(True)),
    "follow": (lambda s, d: rl.follow(e := events(s, d), e), _way(False)),
    "cluster": (lambda s, d: rl.cluster_overlaps(events(s, d), max_gap=60, ignore_strand=True), CLUSTER),
    "cluster_strand": (lambda s, d: rl.cluster_overlaps(events(s, d), max_gap=60), CLUSTER_STRAND),
    "find_loaded_index": (lambda s, d: rl.find_overlaps(events(s, d), saved_index(s, d), max_gap=120), _find(_on(120))),
    "count_indexed": (lambda s, d: rl.count_overlaps(events(s, d), rl.build_index(events(s, d)), max_gap=30), f"WITH {EV} SELECT q.id AS query_id, count(s.id) AS overlap_count FROM ev q LEFT JOIN ev s ON {_on(30)} GROUP BY q.id"),
    "nearest_indexed": (lambda s, d: rl.nearest(events(s, d), rl.build_index(events(s, d))), NEAREST),
    "find_ordered": (_ordered, f"SELECT query_id, subject_id, row_number() OVER (ORDER BY query_id, subject_id) AS place FROM ({_find(_on(60))})"),
    "iter_chunks": (_chunks, _find(_on())),
    "iter_reset": (_reset, _find(_on())),
    "iter_state": (_state, STATE),
    "index_shown": (lambda s, d: s.createDataFrame([(repr(rl.build_index(shipments(s, d))),)], "shown string"), SHOWN),
    "index_partitions": (lambda s, d: rl.index_partitions(rl.build_index(shipments(s, d))), PARTS),
    "index_stats_built": (lambda s, d: rl.index_stats(rl.build_index(shipments(s, d))), INDEX),
    "default_threads": (lambda s, d: s.createDataFrame([(rl.default_threads(s) >= 1,)], "usable boolean"), "SELECT true AS usable"),
    "plain_find": (lambda s, d: rl.find_overlaps(e := plain_events(s, d), e, max_gap=5), f"WITH {PEV} SELECT q.id AS query_id, s.id AS subject_id FROM ev q JOIN ev s ON {_on(5, strand=False)}"),
    "plain_within": (lambda s, d: rl.find_overlaps(e := plain_events(s, d), e, type="within"), f"WITH {PEV} SELECT q.id AS query_id, s.id AS subject_id FROM ev q JOIN ev s ON {_on(strand=False, more='q.st >= s.st AND q.en <= s.en')}"),
    "plain_count": (lambda s, d: rl.count_overlaps(e := plain_events(s, d), e), f"WITH {PEV} SELECT q.id AS query_id, count(s.id) AS overlap_count FROM ev q LEFT JOIN ev s ON {_on(strand=False)} GROUP BY q.id"),
    "plain_nearest": (lambda s, d: rl.nearest(plain_events(s, d), plain_days(s, d)).select("query_id", "distance"), f"WITH {PEV}, {LI} SELECT q.id AS query_id, min(greatest(0, greatest(s.st - q.en, q.st - s.en) - 1)) AS distance FROM ev q, (SELECT DISTINCT st, en FROM li) s GROUP BY q.id"),
    "plain_coverage": (lambda s, d: rl.coverage(plain_days(s, d)), f"WITH {LI.replace(chr(39) + 's' + chr(39) + ' || l_suppkey AS sq', chr(39) + 'range' + chr(39) + ' AS sq')}, {RUNS} SELECT st AS start, en AS \"end\", value FROM runs"),
    "plain_reduce": (lambda s, d: _as_text(rl.reduce_ranges(plain_events(s, d), with_revmap=True), "revmap"), PLAIN_REDUCE),
    "reduce_revmap": (lambda s, d: _as_text(rl.reduce_ranges(events(s, d), with_revmap=True), "revmap"), REVMAP),
    "disjoin_revmap": (lambda s, d: _as_text(rl.disjoin(events(s, d), with_revmap=True), "revmap"), DISJOIN_MAP),
    "gaps_bounded": (lambda s, d: rl.gaps(shipments(s, d), start=-20, end=3000), _bounded_gaps("SELECT DISTINCT sq, sd FROM li", "-20", "3000")),
    "gaps_seqinfo": (lambda s, d: rl.gaps(with_lengths(s, d)), _bounded_gaps("SELECT sq, unnest(['+', '-', '*']) AS sd FROM (SELECT DISTINCT sq FROM li)", "1", "3000")),
    "coverage_shifted": (lambda s, d: rl.coverage(shipments(s, d), shift=-100, width=2000, weight="quantity"), f"WITH {LI}, {_SHIFTED} SELECT sq AS seqname, st AS start, en AS \"end\", value FROM runs"),
    "count_by_group_na": (lambda s, d: rl.count_overlaps_by_group(windows(s, d), with_gaps(s, d), "flag", include_na_group=True), NO_GROUP),
    "agg_sum_strict": (lambda s, d: rl.overlap_aggregate(windows(s, d), with_gaps(s, d), value_col="quantity", fun="sum", na_rm=False), STRICT),
    "index_stats": (lambda s, d: rl.index_stats(rl.SubjectIndex(shipments(s, d))).drop("index_size_mb"), STATS),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
