"""DuckDB's SQL for the queries of catalog.py.  Every mixing step is a subquery, as it names its input twice."""

from __future__ import annotations

from keyfold.functions import u64
from keyfold.sources.datasets import Spec, second_seed

M64 = "18446744073709551616"
P, RANKS, THREADS, BLOCK = 64, 3, 4, 1024
SEED, N, MAX_KEY = 13, 20_000, 5_000


def _mul(a: str, c: int) -> str:
    return f"(({a}::UHUGEINT * {c}::UHUGEINT) % {M64}::UHUGEINT)::UBIGINT"


def _add(a: str, c: int) -> str:
    return f"(({a}::UHUGEINT + {c}::UHUGEINT) % {M64}::UHUGEINT)::UBIGINT"


def _mix(source: str, names: dict[str, str]) -> str:
    """Every column of source, and the mixed values of some UBIGINT columns under new names."""
    out = f"SELECT *, {', '.join(f'{c} AS {n}_0' for c, n in names.items())} FROM ({source})"
    for k, (shift, m) in enumerate(zip((30, 27), u64.MULTIPLIERS, strict=True)):
        step = ", ".join(_mul(f"xor({n}_{k}, {n}_{k} >> {shift})", m) + f" AS {n}_{k + 1}" for n in names.values())
        out = f"SELECT *, {step} FROM ({out})"
    return f"SELECT *, {', '.join(f'xor({n}_2, {n}_2 >> 31) AS {n}' for n in names.values())} FROM ({out})"


def splitmix(source: str, key: str) -> str:
    """source with h1 = splitmix64(key) and h2 = splitmix64(key xor golden)."""
    g = u64.GOLDEN
    return _mix(f"SELECT *, {_add(f'{key}::UBIGINT', g)} AS x1, {_add(f'xor({key}::UBIGINT, {g}::UBIGINT)', g)} AS x2 FROM ({source})", {"x1": "h1", "x2": "h2"})


def pid(source: str, key: str, p: int = P) -> str:
    """source with the partition id of key."""
    out = f"SELECT *, xor({key}::UBIGINT, {key}::UBIGINT >> 33) AS pid_a FROM ({source})"
    out = f"SELECT *, xor(pid_a, pid_a >> 17) AS pid_b FROM ({out})"
    return f"SELECT * EXCLUDE (pid_a, pid_b), (xor(pid_b, pid_b >> 9) & {p - 1}::UBIGINT)::INTEGER AS pid FROM ({out})"


def owner(strategy: str, p: str = "pid") -> str:
    return f"({p} % {RANKS})::INTEGER" if strategy == "cyclic" else f"least((({p} + 1) * {RANKS} - 1) // {P}, {RANKS - 1})::INTEGER"


def join(r: str, s: str, by: str = "", extra: str = "") -> str:
    """The join aggregate of two queries that give a column key; by: further group columns, made by extra from (key, m)."""
    pairs = f"SELECT a.key AS key, (a.n * b.n)::UHUGEINT AS m FROM (SELECT key, count(*) AS n FROM ({r}) GROUP BY 1) a JOIN (SELECT key, count(*) AS n FROM ({s}) GROUP BY 1) b ON a.key = b.key"
    hashed = splitmix(extra.format(pairs=pairs) if extra else pairs, "key")
    total = "coalesce(sum((({h}::UHUGEINT * m) % " + M64 + "::UHUGEINT)::HUGEINT) % " + M64 + "::HUGEINT, 0)::DECIMAL(20,0)"
    group = f"GROUP BY {by}" if by else ""
    return f"SELECT {by + ',' if by else ''} (coalesce(sum((m % {M64}::UHUGEINT)::HUGEINT), 0) % {M64}::HUGEINT)::DECIMAL(20,0) AS join_count, {total.format(h='h1')} AS checksum1, {total.format(h='h2')} AS checksum2 FROM ({hashed}) {group}"


def draws(n: int, seed: int) -> str:
    """(j, r) of the first n draws."""
    x = f"((({seed}::UHUGEINT + (j + 1)::UHUGEINT * {u64.GOLDEN}::UHUGEINT) % {M64}::UHUGEINT))::UBIGINT"
    return f"SELECT j, r FROM ({_mix(f'SELECT j, {x} AS x FROM (SELECT range AS j FROM range({n}))', {'x': 'r'})})"


def uniform(n: int = N, seed: int = SEED, max_key: int = MAX_KEY) -> str:
    return f"SELECT j AS i, (r % {max_key}::UBIGINT)::BIGINT AS key FROM ({draws(n, seed)})"


def pool(hot_percent: int, max_key: int = MAX_KEY) -> str:
    hot = Spec("", 0, hot_percent).hot_partitions(P)
    return f"SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key FROM ({pid(f'SELECT range AS key FROM range({max_key})', 'key')}) WHERE pid < {hot}"


def skewed(spec: str, n: int = N, seed: int = SEED, max_key: int = MAX_KEY) -> str:
    s = Spec.parse(spec)
    return f"""SELECT i, CASE WHEN hot THEN pl.key ELSE (r % {max_key}::UBIGINT)::BIGINT END AS key FROM (
  SELECT row_number() OVER (ORDER BY j) - 1 AS i, hot, r, r2 FROM (
    SELECT j, r, r % 100::UBIGINT < {s.skew} AS hot, lead(r) OVER (ORDER BY j) AS r2,
           coalesce(max(CASE WHEN r % 100::UBIGINT >= {s.skew} THEN j END) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev
    FROM ({draws(2 * n + 2, seed)})) WHERE (j - 1 - prev) % 2 = 0) st
  LEFT JOIN ({pool(s.hot, max_key)}) pl ON st.hot AND pl.idx = (r2 % (SELECT count(*) FROM ({pool(s.hot, max_key)}))::UBIGINT)::BIGINT WHERE i < {n}"""


CUST = "SELECT o_custkey AS key FROM orders"
USER = "SELECT user_id AS key FROM events"
EVENTS = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_id, user_id AS key FROM events"
ORDERS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS key FROM orders"
PIDS = f"SELECT range::INTEGER AS pid FROM range({P})"


def hist(source: str) -> str:
    return f"SELECT p.pid, coalesce(cnt, 0)::BIGINT AS cnt FROM ({PIDS}) p LEFT JOIN (SELECT pid, count(*) AS cnt FROM ({pid(source, 'key')}) GROUP BY 1) h ON p.pid = h.pid"


def layout(source: str) -> str:
    return f'SELECT pid, cnt, "begin", ("begin" + cnt)::BIGINT AS "end" FROM (SELECT pid, cnt, (sum(cnt) OVER (ORDER BY pid) - cnt)::BIGINT AS "begin" FROM ({hist(source)}))'


BLOCKS = f"SELECT (i // {BLOCK})::BIGINT AS block, pid, count(*) AS cnt FROM ({pid(EVENTS, 'key')}) GROUP BY 1, 2"
SENT = f"SELECT (((i + 1) * {RANKS} - 1) // (SELECT count(*) FROM orders))::INTEGER AS src_rank, {owner('block')} AS owner FROM ({pid(ORDERS, 'key')})"
MATRIX = f"""SELECT a.range::INTEGER AS src_rank, b.range::INTEGER AS owner, count(s.owner)::BIGINT AS cnt
FROM range({RANKS}) a CROSS JOIN range({RANKS}) b LEFT JOIN ({SENT}) s ON s.src_rank = a.range AND s.owner = b.range GROUP BY 1, 2"""
ITEMS = f"""WITH b AS (SELECT s.pid, s.cnt AS sc, s."begin" AS sb, r.cnt AS rc, s.cnt + r.cnt AS work FROM ({layout(USER)}) s JOIN ({hist(CUST)}) r ON s.pid = r.pid),
t AS (SELECT greatest((sum(work) + {THREADS - 1}) // {THREADS}, 1) AS target FROM b),
k AS (SELECT *, least(greatest((work + target - 1) // target, 1), {THREADS}, sc)::BIGINT AS slices FROM b, t WHERE sc > 0 AND rc > 0)
SELECT pid, part::INTEGER AS part, (sb + part * sc // slices)::BIGINT AS s_begin, (sb + (part + 1) * sc // slices)::BIGINT AS s_end, work::BIGINT AS work
FROM (SELECT *, unnest(range(slices)) AS part FROM k)"""

#: The runs that the analytics queries work on, made of the orders; both engines read the expressions, {s} is their text type.
RUNS = {
    "run_id": "o_orderkey",
    "stem": "CASE o_custkey % 4 WHEN 0 THEN 'hashjoin_seq' WHEN 1 THEN 'hashjoin_omp' WHEN 2 THEN 'hashjoin_mpi' ELSE 'hashjoin_hybrid_uniform' END",
    "dataset_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'uniform' WHEN '2-HIGH' THEN 'skewed_90_5' WHEN '3-MEDIUM' THEN 'skewed_90_1' WHEN '4-NOT SPECIFIED' THEN 'uniform' ELSE NULL END",
    "nr": "CAST(CASE o_orderkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 2000000 ELSE 4000000 END AS BIGINT)",
    "ns": "CAST(CASE o_orderkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 2000000 ELSE 4000000 END AS BIGINT)",
    "max_key": "CAST(1000000 AS BIGINT)",
    "partition_threads": "CASE WHEN o_custkey % 4 IN (1, 3) AND o_orderkey % 13 <> 0 THEN CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS BIGINT) END",
    "join_threads": "CASE WHEN o_custkey % 4 IN (1, 3) THEN CAST(CASE WHEN o_orderkey % 5 = 0 THEN 16 WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 4 ELSE 8 END AS BIGINT) END",
    "mpi_processes": "CASE WHEN o_custkey % 4 IN (2, 3) THEN CAST(CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS BIGINT) END",
    "time_text": "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS {s}) END",
    "join_text": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(round(o_totalprice * 90) AS BIGINT) AS {s}) ELSE CAST(CAST(round(o_totalprice * 25) AS BIGINT) AS {s}) END",
    "checksum1": "CAST(CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE CASE WHEN o_orderkey % 1000 = 2 THEN 10 ELSE 9 END END AS DECIMAL(20,0))",
    "checksum2": "CAST(o_orderkey % 3 AS DECIMAL(20,0))",
}
RAW = "SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in RUNS.items()) + " FROM orders"
LOADED = f"SELECT * EXCLUDE (stem), CASE stem WHEN 'hashjoin_hybrid_uniform' THEN 'hybrid' ELSE replace(stem, 'hashjoin_', '') END AS exec_type FROM ({RAW})"
NORMAL = f"""SELECT *, (nr + ns) / CASE WHEN tot_sec > 0 THEN tot_sec END AS total_throughput FROM (
SELECT * EXCLUDE (time_text, join_text), try_cast(time_text AS DOUBLE) / 1000003 AS tot_sec, try_cast(time_text AS DOUBLE) / 1000003 AS time_sec,
       try_cast(time_text AS DOUBLE) / 2000003 AS partition_time, try_cast(join_text AS DOUBLE) / 1000003 AS join_time FROM ({LOADED}))"""
CONFIG = "exec_type, partition_threads, join_threads, mpi_processes, nr, ns, max_key, dataset_type"
AVERAGE = f"SELECT {CONFIG}, avg(tot_sec) AS tot_sec, avg(time_sec) AS time_sec, avg(partition_time) AS partition_time, avg(join_time) AS join_time, count(*) AS n_runs FROM ({NORMAL}) GROUP BY ALL"
BEST_KEYS = "nr, ns, max_key, dataset_type, exec_type"
BEST = f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {BEST_KEYS} ORDER BY tot_sec, partition_threads NULLS LAST, join_threads NULLS LAST, mpi_processes NULLS LAST) AS k
FROM ({AVERAGE}) WHERE tot_sec IS NOT NULL) WHERE k = 1"""
AXIS = f"""SELECT *, CASE WHEN partition_threads = join_threads THEN 'omp_threads' WHEN partition_threads IS NOT NULL THEN 'partition_threads' WHEN join_threads IS NOT NULL THEN 'join_threads'
WHEN mpi_processes IS NOT NULL THEN 'mpi_processes' ELSE 'unknown' END AS scaling_axis, coalesce(partition_threads, join_threads, mpi_processes) AS scaling_units FROM ({NORMAL})"""
UNITS = f"""SELECT dataset_type, nr, ns, max_key, scaling_axis, scaling_units, avg(time_sec) AS time_sec, count(*) AS n_runs FROM ({AXIS})
WHERE scaling_units IS NOT NULL AND total_throughput IS NOT NULL GROUP BY ALL"""


def scaled(keys: list[str], order: str, columns: str) -> str:
    same = " AND ".join(f"u.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    first = ", ".join(f"arg_min({c}, ({order})) FILTER ({c} IS NOT NULL) AS {c}" for c in ("scaling_units", "time_sec"))
    return f"""WITH u AS ({UNITS}), b AS (SELECT {', '.join(keys)}, {first} FROM u GROUP BY {', '.join(keys)})
SELECT u.dataset_type, u.nr, u.ns, u.max_key, u.scaling_axis, u.scaling_units, u.n_runs, {columns} FROM u JOIN b ON {same} WHERE b.time_sec > 0"""


LOG_TEXT = {
    "path": "concat('slurm-', CAST(o_orderkey AS {s}), '.log')",
    "text": "concat('noise\nexecutable=', CASE WHEN o_orderkey % 77 = 5 THEN '' ELSE CASE o_orderstatus WHEN 'F' THEN 'hashjoin_seq' WHEN 'O' THEN 'hashjoin_omp' ELSE 'hashjoin_mpi' END END, '\r\n',"
    " 'dataset_type=', o_orderpriority, '\njoin_count=1\njoin_count=', CAST(o_orderkey % 3 AS {s}), '\nchecksum1=', CASE WHEN o_orderkey % 5 = 0 THEN 'a=b' ELSE '17' END, '\r\n',"
    " CASE WHEN o_orderkey % 50 = 3 THEN '' ELSE 'checksum2=9\n' END, CASE o_orderkey % 4 WHEN 0 THEN 'verified=true\n' WHEN 1 THEN 'verified=0\r\n' WHEN 2 THEN 'verified=1\n' ELSE '' END, 'end')",
}
_LOGS = "SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in LOG_TEXT.items()) + " FROM orders"


def _value(name: str) -> str:
    return f"regexp_replace(substr(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '{name}='))[-1], {len(name) + 2}), '\\r$', '')"


PARSED = f"""SELECT path, executable, dataset_type, join_count, checksum1, checksum2, v IS NOT NULL AS has_verified_field, coalesce(v IN ('true', '1'), false) AS verified,
coalesce(executable, '') <> '' AND coalesce(dataset_type, '') <> '' AND join_count IS NOT NULL AND checksum1 IS NOT NULL AND checksum2 IS NOT NULL AS complete FROM (
SELECT path, {', '.join(f'{_value(n)} AS {n}' for n in ('executable', 'dataset_type', 'join_count', 'checksum1', 'checksum2'))}, {_value('verified')} AS v FROM ({_LOGS}))"""
_SPECS = "SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'uniform' WHEN 1 THEN concat('skewed_', CAST(o_custkey % 100 AS VARCHAR), '_5') WHEN 2 THEN 'skewed_90_1' ELSE 'other' END AS dataset_type FROM orders"
_ROUND = "round({0}, 6) AS {0}"


def _number(x: str) -> str:
    """Whole numbers as such, others to six significant digits, as C prints %g."""
    return f"CASE WHEN {x} IS NULL THEN 'NA' WHEN {x} = floor({x}) THEN ({x})::HUGEINT::VARCHAR ELSE printf('%g', {x}) END"



SQL: dict[str, str] = {
    "join_checksum_orders_lineitem": join("SELECT o_orderkey AS key FROM orders", "SELECT l_orderkey AS key FROM lineitem"),
    "join_checksum_custkey_userid": join(CUST, USER),
    "join_checksum_buildagg": join(CUST, USER),
    "join_checksum_rows": join(CUST, USER),
    "naive_join_checksum": join("SELECT n_regionkey AS key FROM nation", "SELECT r_regionkey AS key FROM region"),
    "rank_partial_results": join(CUST, USER, "owner", f"SELECT *, {owner('block')} AS owner FROM ({pid('{pairs}', 'key')})"),
    "splitmix64_scalar": f"SELECT o_orderkey, h1::DECIMAL(20,0) AS hash FROM ({splitmix('SELECT o_orderkey FROM orders', 'o_orderkey')})",
    "partition_id": f"SELECT o_orderkey, pid FROM ({pid('SELECT o_orderkey FROM orders', 'o_orderkey')})",
    "owner_block": f"SELECT pid, {owner('block')} AS owner FROM ({PIDS})",
    "owner_cyclic": f"SELECT pid, {owner('cyclic')} AS owner FROM ({PIDS})",
    "rank_ranges": f'SELECT range::INTEGER AS rank, CASE WHEN range < {RANKS} THEN range * {N} // {RANKS} ELSE 0 END::BIGINT AS "begin", CASE WHEN range < {RANKS} THEN (range + 1) * {N} // {RANKS} ELSE 0 END::BIGINT AS "end" FROM range({RANKS + 1})',
    "gen_uniform": uniform(),
    "gen_slice": f"SELECT * FROM ({skewed('skewed_90_5')}) WHERE i >= {N // RANKS} AND i < {2 * N // RANKS}",
    "gen_skewed_90_5": skewed("skewed_90_5"),
    "gen_skewed_90_1": skewed("skewed_90_1"),
    "skew_key_pool": pool(5),
    "join_checksum_gen_uniform": join(uniform(), uniform(seed=second_seed(SEED))),
    "join_checksum_gen_skewed": join(skewed("skewed_90_5"), skewed("skewed_90_5", seed=second_seed(SEED))),
    "key_multiplicity": "SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1",
    "partition_histogram": hist(USER),
    "block_histogram": BLOCKS,
    "partition_offsets": f'SELECT pid, cnt, "begin" FROM ({layout(USER)})',
    "partition_layout": layout(USER),
    "block_offsets": f'SELECT b.pid, block, b.cnt, (l."begin" + sum(b.cnt) OVER (PARTITION BY b.pid ORDER BY block) - b.cnt)::BIGINT AS start FROM ({BLOCKS}) b JOIN ({layout(USER)}) l ON b.pid = l.pid',
    "scatter_positions": f'SELECT event_id, e.pid, (l."begin" + row_number() OVER (PARTITION BY e.pid ORDER BY i) - 1)::BIGINT AS position FROM ({pid(EVENTS, "key")}) e JOIN ({layout(USER)}) l ON e.pid = l.pid',
    "exchange_matrix": MATRIX,
    "exchange_displacements": f"SELECT *, (sum(cnt) OVER (PARTITION BY src_rank ORDER BY owner) - cnt)::BIGINT AS displ FROM ({MATRIX})",
    "join_work_items": ITEMS,
    "bench_load": f"SELECT run_id, exec_type, dataset_type, nr, ns, max_key, partition_threads, join_threads, mpi_processes, time_text FROM ({LOADED})",
    "bench_normalize": f"SELECT run_id, tot_sec, time_sec, round(total_throughput, 3) AS total_throughput FROM ({NORMAL})",
    "bench_average": f"SELECT {CONFIG}, {', '.join(_ROUND.format(c) for c in ('tot_sec', 'partition_time', 'join_time'))}, n_runs FROM ({AVERAGE})",
    "bench_residual": f"SELECT {CONFIG}, round(CASE WHEN tot_sec - partition_time - join_time < 0 THEN 0.0 ELSE tot_sec - partition_time - join_time END, 6) AS redistribution_time FROM ({AVERAGE})",
    "bench_best": f"SELECT {CONFIG}, {_ROUND.format('tot_sec')}, n_runs FROM ({BEST})",
    "bench_fastest": f"SELECT nr, ns, max_key, dataset_type, exec_type, {_ROUND.format('tot_sec')} FROM (SELECT *, row_number() OVER (PARTITION BY nr, ns, max_key, dataset_type ORDER BY tot_sec, exec_type) AS k FROM ({BEST})) WHERE k = 1",
    "throughput": f"SELECT run_id, round(CASE WHEN tot_sec <= 0 THEN 0.0 ELSE (nr + ns) / tot_sec END, 3) AS throughput FROM ({NORMAL})",
    "speedup_vs_seq": f"WITH b AS ({BEST}) SELECT b.nr, b.ns, b.max_key, b.dataset_type, b.exec_type, round(s.tot_sec / CASE WHEN b.tot_sec > 0 THEN b.tot_sec END, 6) AS speedup_vs_seq FROM b LEFT JOIN b s ON s.exec_type = 'seq' AND s.nr = b.nr AND s.ns = b.ns AND s.max_key = b.max_key AND s.dataset_type IS NOT DISTINCT FROM b.dataset_type",
    "skew_penalty": f"WITH b AS ({BEST}) SELECT b.nr, b.ns, b.max_key, b.dataset_type, b.exec_type, round(b.tot_sec / CASE WHEN u.tot_sec > 0 THEN u.tot_sec END, 6) AS skew_penalty_vs_uniform FROM b LEFT JOIN b u ON u.dataset_type = 'uniform' AND u.nr = b.nr AND u.ns = b.ns AND u.max_key = b.max_key AND u.exec_type = b.exec_type",
    "strong_scaling": scaled(["dataset_type", "nr", "ns", "max_key", "scaling_axis"], "scaling_units, time_sec", "round(b.time_sec / u.time_sec, 6) AS speedup, round(b.time_sec / u.time_sec / (u.scaling_units / b.scaling_units), 6) AS parallel_efficiency"),
    "weak_scaling": scaled(["dataset_type", "max_key", "scaling_axis"], "scaling_units, nr, time_sec", "round(u.scaling_units / b.scaling_units * (b.time_sec / u.time_sec), 6) AS scaled_speedup, round(b.time_sec / u.time_sec, 6) AS weak_efficiency"),
    "scaling_axis": f"SELECT run_id, scaling_axis, scaling_units FROM ({AXIS})",
    "scaling_exec_type": f"SELECT exec_type, CASE WHEN t IS NOT NULL AND r > 1 THEN 'hybrid' WHEN t IS NOT NULL THEN 'omp' WHEN r IS NOT NULL THEN 'mpi' ELSE 'seq' END AS inferred FROM (SELECT exec_type, max(coalesce(partition_threads, join_threads)) AS t, max(mpi_processes) AS r FROM ({NORMAL}) GROUP BY 1)",
    "checksum_validation": f"""SELECT nr, ns, max_key, dataset_type, count(DISTINCT (checksum1, checksum2)) AS n_distinct_checksum_pairs, count(DISTINCT (checksum1, checksum2)) = 1 AS is_valid,
concat_ws(', ', max(CASE exec_type WHEN 'seq' THEN 'seq' END), max(CASE exec_type WHEN 'omp' THEN 'omp' END), max(CASE exec_type WHEN 'mpi' THEN 'mpi' END), max(CASE exec_type WHEN 'hybrid' THEN 'hybrid' END)) AS exec_types FROM ({NORMAL}) GROUP BY 1, 2, 3, 4""",
    "ordered_dims": "SELECT event_type, (row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type))::INTEGER AS place FROM (SELECT DISTINCT event_type FROM events)",
    "fmt_labels": f"""SELECT run_id, concat('nr=', nr, ', ns=', ns, ', max_key=', max_key) AS problem, {_number('tot_sec')} AS seconds, {_number('total_throughput')} AS rate, {_number('tot_sec * 1e-6')} AS megaseconds,
substr(regexp_replace(regexp_replace(concat(exec_type, ' / ', dataset_type, '!'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 180) AS slug, concat((nr // 1000000)::BIGINT, ' / ', coalesce(mpi_processes, 1)) AS case_label FROM ({NORMAL})""",
    "dataset_metadata": f"SELECT dataset_type, CASE WHEN a <> '' THEN 'skewed' ELSE dataset_type END AS dataset, CASE WHEN a <> '' THEN a::DOUBLE / 100 ELSE 0.0 END::DOUBLE AS skew_fraction, CASE WHEN b <> '' THEN b::DOUBLE / 100 ELSE 0.0 END::DOUBLE AS skew_partition_fraction FROM (SELECT dataset_type, regexp_extract(dataset_type, '^skewed_(\\d+)_(\\d+)$', 1) AS a, regexp_extract(dataset_type, '^skewed_(\\d+)_(\\d+)$', 2) AS b FROM ({_SPECS}))",
    "grid_expand": "SELECT r.range::INTEGER AS repeat, node, proc AS mpi_process, strategy AS mpi_partition_strategy, dataset AS dataset_type FROM range(1, 6) r, (SELECT unnest([1, 4, 8]) AS node), (SELECT unnest([1, 4, 8]) AS proc), (SELECT unnest(['block', 'cyclic']) AS strategy), (SELECT unnest(['uniform', 'skewed_90_5', 'skewed_90_1']) AS dataset) WHERE proc >= node AND proc % node = 0",
    "log_parse": PARSED,
    "checker_groups": f"SELECT executable, dataset_type, count(*) AS n_runs, (count(*) FILTER (verified)) AS n_verified, count(DISTINCT (join_count, checksum1, checksum2)) FILTER (NOT verified) AS n_outcomes, count(DISTINCT (join_count, checksum1, checksum2)) FILTER (NOT verified) <= 1 AS ok FROM ({PARSED}) WHERE complete GROUP BY 1, 2",
    "checker_mismatches": f"WITH q AS (SELECT executable, dataset_type, path, join_count, checksum1, checksum2 FROM ({PARSED}) WHERE complete AND NOT verified), f AS (SELECT executable, dataset_type, arg_min((join_count, checksum1, checksum2), path) AS first FROM q GROUP BY 1, 2) SELECT q.* FROM q JOIN f USING (executable, dataset_type) WHERE (q.join_count, q.checksum1, q.checksum2) <> f.first",
    "bench_csv_roundtrip": f"SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in RUNS if c != 'stem')}, 'omp' AS exec_type FROM ({LOADED})",
    "log_read": """SELECT concat('slurm-', o_orderstatus, '-', o_orderpriority[1], '.out') AS path, concat('hashjoin_', o_orderstatus) AS executable, o_orderpriority AS dataset_type, count(*)::VARCHAR AS join_count,
sum(o_orderkey)::VARCHAR AS checksum1, max(o_custkey)::VARCHAR AS checksum2, count(*) % 2 = 1 AS has_verified_field, count(*) % 2 = 1 AS verified, true AS complete FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "repartition_by_owner": f"SELECT o_orderkey, {owner('block')} AS owner FROM ({pid('SELECT o_orderkey FROM orders', 'o_orderkey')})",
    "csv_escape": "SELECT event_id, CASE WHEN regexp_matches(props, '[,\"\n\r]') THEN concat('\"', replace(props, '\"', '\"\"'), '\"') ELSE props END AS field FROM events",
}
