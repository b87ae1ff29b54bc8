"""The registered queries of the transaction-graph operators, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import fx, scalars
from .operators import boosting, community, graph, metrics, models, neighbourhood, network, results, sage, sequence, snapshots, training, windows
from .plans import features as plans
from .schema import BLOCKS, FEATURES, STATS, VALUES
from .shared import shared_folder
from .sources import adapters, loaders, tables
from .sources.tables import scores_long
from .streaming import edges as stream_edges

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DAY = scalars.MICROS["days"]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs ------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.transfers(_table(spark, sf_dir, "events"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.trade(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders"))


def _edges(spark: SparkSession, sf_dir: str, step: float = 1, width: float | None = None, echo: float | None = None) -> DataFrame:
    tx = windows.pinned(_transfers(spark, sf_dir))  # read for the grid and for the edges
    return snapshots.snapshot_edges(tx, snapshots.make_grid(tx, step, "days", width), echo)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(_table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _off_ties(digits: int) -> float:
    """What is added before rounding where values lie on a decimal grid, so that none is a tie."""
    return 1.7 * 10.0 ** -(digits + 3)


def _rounded_off_ties(df: DataFrame, digits: int = 6) -> DataFrame:
    return _rounded(df.select(*[(F.col(c) + F.lit(_off_ties(digits))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), digits)


TX = "tx as (select * from (select user_id as src, lead(user_id) over (partition by event_type order by ts, event_id) as dst, ts, value as amount, value > 200 as label from events) where dst is not null and src <> dst), g as (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as z from tx)"


def _placed(step: float, width: float, tx: str = TX, name: str = "placed") -> str:
    s, w = int(step * DAY), int(width * DAY)
    return f"""{tx},
{name} as (select src, dst, amount, label, o, cast(unnest(range(lo, hi + 1)) as integer) as snapshot_id
  from (select *, o // {s} as lo, least((o + {w}) // {s} - 1, (z - a) // {s} - 1) as hi from (select tx.*, epoch_us(ts) - a as o, a, z from tx, g)) where lo <= hi)"""


_AGG = "coalesce(sum(amount), 0) as amount_trans, count(amount) as num_trans"
E_SQL = f"{_placed(1, 1)},\ne as (select snapshot_id, src, dst, cast(1 as double) as weight, {_AGG} from placed group by all)"
UND = "und as (select snapshot_id, src as u, dst as v from e union select snapshot_id, dst, src from e)"
NODES = "nodes as (select distinct snapshot_id, u as node from und)"
MEM = f"""{UND},
{NODES},
d2 as (select a.snapshot_id, a.src as ego, b.dst as node from e a join e b on a.snapshot_id = b.snapshot_id and a.dst = b.src
  union select a.snapshot_id, b.dst, a.src from e a join e b on a.snapshot_id = b.snapshot_id and a.dst = b.src),
n2 as (select distinct a.snapshot_id, a.u as ego, b.v as node from und a join und b on a.snapshot_id = b.snapshot_id and a.v = b.u where a.u <> b.v
  and not exists (select 1 from und c where c.snapshot_id = a.snapshot_id and c.u = a.u and c.v = b.v)),
mem as (select snapshot_id, node as ego, node, 0 as role from nodes union all select snapshot_id, u, v, 1 from und
  union all select n2.snapshot_id, n2.ego, n2.node, case when d2.node is null then 0 else 2 end from n2 left join d2 on n2.snapshot_id = d2.snapshot_id and n2.ego = d2.ego and n2.node = d2.node),
sz as (select snapshot_id, ego, count(*) filter (role = 0) as n0, count(*) filter (role = 1) as n1, count(*) filter (role = 2) as n2 from mem group by all)"""
BLOCK = f"""{MEM},
ed as (select m1.snapshot_id, m1.ego, m1.role as i, m2.role as j, e.weight, e.amount_trans, e.num_trans from mem m1 join e on e.snapshot_id = m1.snapshot_id and e.src = m1.node
  join mem m2 on m2.snapshot_id = m1.snapshot_id and m2.ego = m1.ego and m2.node = e.dst),
bs as (select snapshot_id, ego, i, j, count(*) as nnz, sum(weight) as w, {", ".join(f"sum({v}) as {v}_sum, max({v}) as {v}_max, avg({v}) as {v}_avg, var_pop({v}) as {v}_var" for v in VALUES)} from ed group by all),
wide as (select sz.*, {", ".join(f"coalesce(max(case when i = {b[0]} and j = {b[1]} then {f} end), 0) as {f}_{b}" for b in BLOCKS for f in ["nnz", "w"] + [f"{v}_{k}" for v in VALUES for k in ("sum", "max", "avg", "var")])}
  from sz left join bs using (snapshot_id, ego) group by all)"""
SIZE_SQL = {
    "00": "n0 * n0 - 3 * n0 + 2", "01": "n0 * n1", "02": "(n0 - 1) * n2", "10": "n1 * n0", "11": "n1 * n1 - n1", "12": "n1 * n2",
    "20": "n2 * n0 - n2", "21": "n2 * n1", "22": "n2 * n2 - n2",
}


def _feature_sql(name: str) -> str:
    b = name[-2:]
    if name.startswith("size_"):
        return f"cast({SIZE_SQL[b]} as double)"
    if name.startswith("measure_"):
        return f"case when {SIZE_SQL[b]} > 0 then w_{b} / ({SIZE_SQL[b]}) else {1 if b == '01' else 0} end"
    v = next(v for v in VALUES if v in name)
    s = name.split("_")[-2]
    cells, nnz = f"(n{b[0]} * n{b[1]})", f"nnz_{b}"
    value = {
        "sum": f"{v}_sum_{b}",
        "mean": f"{v}_sum_{b} / {cells}",
        "max": f"case when {nnz} < {cells} then greatest({v}_max_{b}, 0) else {v}_max_{b} end",
        "std": f"sqrt(greatest({v}_var_{b} * {nnz} + {v}_avg_{b} * {v}_avg_{b} * {nnz} * ({cells} - {nnz}) / {cells}, 0) / {cells})",
    }[s]
    return f"case when {cells} > 0 and {nnz} > 0 then {value} else 0 end"


def _features_sql(names: list[str], edges: str = E_SQL) -> str:
    return f"with {edges},\n{BLOCK}\nselect snapshot_id, ego as node, " + ", ".join(f"round(cast({_feature_sql(n)} as double) + {_off_ties(6)!r}, 6) as {n}" for n in names) + " from wide"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return neighbourhood.features(edges, graph.nodes(edges))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_off_ties(_features(spark, sf_dir))


# --- loading and scalars -----------------------------------------------------------------------------


@_query(f"with {TX} select src, dst, ts, amount, label from tx")
def canonical_transfers(spark, sf_dir):
    return _transfers(spark, sf_dir)


@_query("select 'C' || o_custkey as src, 'S' || l_suppkey as dst, o_orderdate as ts, round(l_extendedprice * (1 - l_discount), 4) as amount, l_returnflag = 'R' as label from lineitem join orders on l_orderkey = o_orderkey")
def canonical_trade(spark, sf_dir):
    return _rounded(_trade(spark, sf_dir), 4)


def _currencies(spark, sf_dir):
    own = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = F.array(*map(F.lit, fx.CODES))
    return own.select("o_orderkey", F.col("o_totalprice").alias("amount"), F.element_at(names, (F.pmod("c_nationkey", F.lit(15)) + 1).cast("int")).alias("currency"), "c_nationkey")


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in fx.CODES) + "]"
_RATES_SQL = "MAP {" + ", ".join(f"'{n}': {fx.BANK_RATES[c]}" for n, c in fx.CODES.items()) + "}"


@_query(f"select o_orderkey, currency, round(amount / {_RATES_SQL}[currency], 4) as amount from (select o_orderkey, o_totalprice as amount, {_NAMES_SQL}[c_nationkey % 15 + 1] as currency from orders join customer on o_custkey = c_custkey)")
def fx_convert(spark, sf_dir):
    return _rounded(fx.to_usd(_currencies(spark, sf_dir), "amount", "currency", fx.BANK_RATES, fx.CODES).select("o_orderkey", "currency", "amount"), 4)


@_query("select distinct n_name as currency from nation")
def fx_unmapped_guard(spark, sf_dir):
    return fx.unmapped(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("currency")), "currency", fx.BANK_RATES, fx.CODES)


# raw files of the three formats, written from events and read by the loaders; every event is a line


def _raw(df: DataFrame, name: str) -> str:
    """A folder that holds ``df`` as the CSV file ``name``; it goes when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    df.write.csv(f"{folder}/{name}", header=True)
    fs, where = tables._fs(spark, folder)
    fs.deleteOnExit(where)
    return folder


def _lines(spark, sf_dir, columns: dict[str, str]) -> DataFrame:
    """Text columns from expressions that Spark and DuckDB read alike."""
    return _table(spark, sf_dir, "events").select(*[F.expr(e.replace("varchar", "string")).cast("string").alias(c) for c, e in columns.items()])


_BANK_DAY, _BANK_MINUTE = "event_id * 13 % 14 + 1", "event_id * 7 % 1440"
_BANK = {
    "Timestamp": f"'2022/09/' || lpad(cast({_BANK_DAY} as varchar), 2, '0') || ' ' || lpad(cast(cast(floor(({_BANK_MINUTE}) / 60) as int) as varchar), 2, '0') || ':' || lpad(cast(({_BANK_MINUTE}) % 60 as varchar), 2, '0')",
    "From Bank": "'1'", "Account": "'A' || cast(user_id % 50 as varchar)", "To Bank": "'2'", "Account.1": "'A' || cast(event_id % 50 as varchar)", "Amount Received": "'1'", "Receiving Currency": "'Euro'",
    "Amount Paid": "case when event_id % 11 = 0 then 'x' else cast(event_id % 1000 as varchar) end", "Payment Currency": "", "Payment Format": "'Wire'", "Is Laundering": "case event_id % 3 when 0 then '1' when 1 then '0' else '' end",
}
_BANK["Payment Currency"] = "case event_id % 15 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(fx.CODES)) + " end"


@_query(f"""with raw as (select {_BANK['Account']} as src, {_BANK['Account.1']} as dst, strptime({_BANK['Timestamp']}, '%Y/%m/%d %H:%M') as ts, try_cast({_BANK['Amount Paid']} as double) as amount, {_BANK['Payment Currency']} as currency, event_id % 3 = 0 as label from events)
select src, dst, ts, round(amount / {_RATES_SQL}[currency] + {_off_ties(4)!r}, 4) as amount, label from raw where src <> dst and amount is not null and ts <= timestamp '{loaders.BANK_LAST}'""")
def load_bank(spark, sf_dir):
    return _rounded_off_ties(loaders.load(spark, "bank", _raw(_lines(spark, sf_dir, _BANK), "HI-Small_Trans.csv")), 4)


_SIM = {
    "TX_ID": "event_id", "SENDER_ACCOUNT_ID": "user_id", "RECEIVER_ACCOUNT_ID": "event_id * 31 % 500", "TIMESTAMP": "event_id % 30",
    "TX_AMOUNT": "case when event_id % 13 = 0 then null else cast(event_id % 977 as varchar) end", "IS_FRAUD": "case when event_id % 17 = 0 then 'True' else 'False' end",
}
_SIM_TX = f"tx as (select cast(user_id as varchar) as src, cast({_SIM['RECEIVER_ACCOUNT_ID']} as varchar) as dst, timestamp '1970-01-01 00:00:00' + to_days(cast({_SIM['TIMESTAMP']} as integer)) as ts, cast({_SIM['TX_AMOUNT']} as double) as amount, event_id % 17 = 0 as label from events where user_id <> {_SIM['RECEIVER_ACCOUNT_ID']}), g as (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as z from tx)"


@_query(f"with {_SIM_TX} select src, dst, ts, amount, label from tx")
def load_simulator(spark, sf_dir):
    return loaders.load(spark, "simulator", _raw(_lines(spark, sf_dir, _SIM), "transactions.csv"))


_MIX = {
    "src": "case when event_id % 9 = 0 then 'individual_' else 'a' end || cast(user_id % 50 as varchar)", "dest": "'a' || cast(event_id % 50 as varchar)", "timestamp": "case when event_id % 8 = 0 then '2025-12-31T00:00:00' else '2025-05-01T10:00:00.123456' end",
    "amount": "cast(event_id % 1000 as varchar)", "currency": "case event_id % 3 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(list(fx.MIXED_RATES)[:3])) + " end", "is_fraudulent": "cast(event_id % 2 as varchar)", "edge_type": "case when event_id % 10 = 0 then 'ownership' else 'transaction' end",
}
_MIX_SQL = f"""with raw as (select {_MIX['src']} as src, {_MIX['dest']} as dst, cast({_MIX['timestamp']} as timestamp) as ts, event_id % 1000 / cast(case {_MIX['currency']} {" ".join(f"when '{n}' then {fx.MIXED_RATES[n]}" for n in list(fx.MIXED_RATES)[:3])} end as double) as amount, event_id % 2 = 1 as label, {_MIX['edge_type']} as kind from events)
select src, dst, ts, round(amount + {_off_ties(4)!r}, 4) as amount, label from raw where kind = 'transaction' and not starts_with(src, 'individual') and src <> dst and ts < timestamp '{loaders.MIXED_END}'"""


@_query(_MIX_SQL)
def load_mixed(spark, sf_dir):
    return _rounded_off_ties(loaders.load(spark, "mixed", _raw(_lines(spark, sf_dir, _MIX), "generated_edges_HI.csv")), 4)


@_query(_MIX_SQL)
def load_mixed_slim(spark, sf_dir):
    """By way of the slim stored copy, which the loader prefers."""
    folder = _raw(_lines(spark, sf_dir, _MIX), "generated_edges_HI.csv")
    tables.convert(loaders.mixed_edges(spark.read.csv(f"{folder}/generated_edges_HI.csv", header=True)), f"{folder}/generated_edges_HI")
    return _rounded_off_ties(loaders.load(spark, "mixed", folder), 4)


@_query("select cast(doc_id as varchar) as node, toxic <> 0 as label from labels")
def label_table(spark, sf_dir):
    return loaders.label_table(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Account"), F.col("toxic").alias("Is Laundering")))


_LABEL_TEXT = "case event_id % 6 when 0 then '1' when 1 then '0' when 2 then 'True' when 3 then 'x' when 4 then '' else null end"


@_query(f"select event_id, case when lower(trim(t)) in ('true', 't', 'yes') then true else coalesce(try_cast(trim(t) as double), 0) <> 0 end as label from (select event_id, {_LABEL_TEXT} as t from events)")
def label_coerce(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.expr(_LABEL_TEXT).alias("t")).select("event_id", scalars.label("t").alias("label"))


_AMOUNT_TEXT = "case when event_id % 5 = 0 then 'n/a' when event_id % 7 = 0 then null else cast(event_id * 2 as varchar(20)) end"


@_query(f"select event_id, try_cast(t as double) as amount from (select event_id, {_AMOUNT_TEXT} as t from events) where try_cast(t as double) is not null")
def amount_coerce(spark, sf_dir):
    own = _table(spark, sf_dir, "events").select("event_id", F.expr(_AMOUNT_TEXT.replace("varchar(20)", "string")).alias("t"))
    return own.select("event_id", scalars.number("t").alias("amount")).filter("amount is not null")


@_query("select src, dst, count(*) as n from (select user_id as src, event_id % 7 as dst from events) where src <> dst group by all")
def selfloop_filter(spark, sf_dir):
    own = _table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.pmod("event_id", F.lit(7)).alias("dst"))
    return loaders.no_self_loops(own).groupBy("src", "dst").agg(F.count("*").alias("n"))


_CUT = "2024-01-10 00:00:00"


@_query(f"select count(*) filter (ts <= timestamp '{_CUT}') as inclusive, count(*) filter (ts < timestamp '{_CUT}') as exclusive from events")
def time_cutoff(spark, sf_dir):
    ev = _table(spark, sf_dir, "events")
    a = loaders.until(ev, _CUT, True).agg(F.count("*").alias("inclusive"))
    return a.crossJoin(loaders.until(ev, _CUT, False).agg(F.count("*").alias("exclusive")))  # one row each


@_query("select event_id, round(exp(ln(0.01) / 3 * (lag // 1000000) / 86400.0), 9) as decay from (select event_id, (event_id * 7919) % 259200000001 as lag from events)")
def decay_weights(spark, sf_dir):
    lag = F.pmod(F.col("event_id") * 7919, F.lit(259200000001))
    return _rounded(_table(spark, sf_dir, "events").select("event_id", scalars.decay(lag, 3).alias("decay")), 9)


# --- snapshots ---------------------------------------------------------------------------------------


@_query(f"with {TX} select cast(i as integer) as snapshot_id, make_timestamp(a + i * {DAY}) as start_ts, make_timestamp(a + (i + 1) * {DAY}) as end_ts from g, (select unnest(range((z - a) // {DAY})) as i from g)")
def snapshot_grid(spark, sf_dir):
    return snapshots.make_grid(_transfers(spark, sf_dir), 1, "days").frame(spark)


def _assigned(width: float, step: float = 1) -> Query:
    def run(spark, sf_dir):
        tx = windows.pinned(_transfers(spark, sf_dir))
        placed = snapshots.assign(tx, snapshots.make_grid(tx, step, "days", width))
        return placed.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"))

    return run


for _name, _width, _step in (("tumbling", 1, 1), ("hopping", 3, 1), ("gapped", 0.25, 1), ("coarse", 2.5, 2)):
    _f = _assigned(_width, _step)
    _f.__name__ = f"snapshot_assign_{_name}"
    _query(f"with {_placed(_step, _width)} select snapshot_id, count(*) as n, round(sum(amount), 4) as amount from placed group by all")(_f)


@_query(f"with {E_SQL} select snapshot_id, src, dst, weight, round(amount_trans, 4) as amount_trans, num_trans from e")
def snapshot_edges(spark, sf_dir):
    return _rounded(_edges(spark, sf_dir), 4)


@_query(f"with {_placed(1, 3)} select snapshot_id, src, dst, round(max(exp(ln(0.01) / 3 * (((snapshot_id + 1) * {DAY} - o) // 1000000) / 86400.0)), 6) as weight, round(sum(amount), 4) as amount_trans, count(amount) as num_trans from placed group by all")
def echo_edges(spark, sf_dir):
    return _edges(spark, sf_dir, echo=3).select("snapshot_id", "src", "dst", F.round("weight", 6).alias("weight"), F.round("amount_trans", 4).alias("amount_trans"), "num_trans")


@_query(f"with {_placed(1, 3)} select snapshot_id, src, dst, round(max(exp(ln(0.01) / 3 * (((snapshot_id + 1) * {DAY} - o) // 1000000) / 86400.0)), 6) as weight, round(sum(amount), 4) as amount_trans, count(amount) as num_trans from placed group by all")
def streamed_echo_edges(spark, sf_dir):
    """The transfers replayed as a stream: the same table, window by window as they close."""
    tx = windows.pinned(_transfers(spark, sf_dir))
    grid = snapshots.make_grid(tx, 1, "days")
    got = stream_edges.replayed(tx, grid, lambda s: stream_edges.streaming_edges(s, DAY, DAY, "0 seconds", grid.first, 3))
    return got.select("snapshot_id", "src", "dst", F.round("weight", 6).alias("weight"), F.round("amount_trans", 4).alias("amount_trans"), "num_trans")


_LAB = "lab as (select snapshot_id, node, max(cast(label as integer)) as label from (select snapshot_id, src as node, label from placed union all select snapshot_id, dst, label from placed) group by all)"


def _labels(spark, sf_dir):
    tx = windows.pinned(_transfers(spark, sf_dir))
    return snapshots.node_labels(snapshots.assign(tx, snapshots.make_grid(tx, 1, "days")), "snapshot_id")


@_query(f"with {_placed(1, 1)}, {_LAB} select snapshot_id, node, label from lab")
def node_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@_query(f"with {_placed(1, 1)}, {_LAB} select snapshot_id, count(*) as positives from lab where label = 1 group by all")
def positives_per_window(spark, sf_dir):
    tx = windows.pinned(_transfers(spark, sf_dir))
    return snapshots.positives_per_window(snapshots.assign(tx, snapshots.make_grid(tx, 1, "days")))


@_query(f"with t as (select 'C' || o_custkey as src, 'S' || l_suppkey as dst, l_extendedprice * (1 - l_discount) as amount from lineitem join orders on l_orderkey = o_orderkey) select src, dst, cast(1 as double) as weight, round(sum(amount) + {_off_ties(2)!r}, 2) as amount_trans, count(amount) as num_trans from t group by all")
def static_edges(spark, sf_dir):
    return _rounded_off_ties(snapshots.static_edges(_trade(spark, sf_dir)), 2)


@_query(f"with {TX} select cast(i as integer) as snapshot_id from (select unnest(range((z - a) // {DAY})) as i from g) where i % 3 <> 0")
def resume_pending(spark, sf_dir):
    grid = snapshots.make_grid(_transfers(spark, sf_dir), 1, "days").frame(spark)
    return snapshots.pending(grid, grid.filter("snapshot_id % 3 = 0")).select("snapshot_id")


# --- graphs ------------------------------------------------------------------------------------------


@_query(f"with {E_SQL} select snapshot_id, dst as src, src as dst, round(amount_trans, 4) as amount_trans from e")
def reverse_edges(spark, sf_dir):
    return _rounded(graph.reverse(_edges(spark, sf_dir)).select("snapshot_id", "src", "dst", "amount_trans"), 4)


@_query(f"with {E_SQL} select distinct snapshot_id, least(src, dst) as a, greatest(src, dst) as b from e")
def undirected_edges(spark, sf_dir):
    return graph.undirected(_edges(spark, sf_dir))


_DEG = "deg as (select snapshot_id, node, count(*) as degree from (select snapshot_id, src as node from e union all select snapshot_id, dst from e) group by all)"


@_query(f"with {E_SQL}, {_DEG} select snapshot_id, node, degree from deg")
def degree_inout(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@_query(f"with {E_SQL} select snapshot_id, node, round(sum(a), 4) as degree from (select snapshot_id, src as node, amount_trans as a from e union all select snapshot_id, dst, amount_trans from e) group by all")
def degree_weighted(spark, sf_dir):
    return _rounded(graph.degrees(_edges(spark, sf_dir), "amount_trans"), 4)


_CUT_EDGES = "select e.snapshot_id, src, dst, num_trans from e where not exists (select 1 from hub h where h.snapshot_id = e.snapshot_id and (h.node = e.src or h.node = e.dst))"


@_query(f"with {E_SQL}, {_DEG}, hub as (select * from deg where degree >= 5) {_CUT_EDGES}")
def hub_abs(spark, sf_dir):
    return graph.prune_hubs(_edges(spark, sf_dir), 5).select("snapshot_id", "src", "dst", "num_trans")


@_query(f"with {E_SQL}, {_DEG}, lim as (select snapshot_id, quantile_cont(degree, 0.95) as q from deg group by all), hub as (select deg.* from deg join lim using (snapshot_id) where degree >= q) {_CUT_EDGES}")
def hub_rel_quantile(spark, sf_dir):
    return graph.prune_top(_edges(spark, sf_dir), 0.05).select("snapshot_id", "src", "dst", "num_trans")


@_query(f"with {E_SQL}, {UND} select snapshot_id, u as node, count(*) as degree, round(ln(1 + count(*)), 9) as log_degree from und group by all")
def neighbour_degrees(spark, sf_dir):
    return _rounded(graph.neighbour_degrees(_edges(spark, sf_dir)), 9)


@_query(f"with {E_SQL}, {UND} select snapshot_id, u as ego, v as node from und")
def one_hop(spark, sf_dir):
    return graph.arcs(_edges(spark, sf_dir)).select("snapshot_id", F.col("u").alias("ego"), F.col("v").alias("node"))


@_query(f"with {E_SQL}, {MEM} select snapshot_id, ego, node, cast(role as integer) as role from mem")
def two_hop_ball(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return neighbourhood.members(edges, graph.nodes(edges))


@_query(f"with {E_SQL}, {MEM} select snapshot_id, ego, n0, n1, n2 from sz")
def role_sizes(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return neighbourhood.sizes(neighbourhood.members(edges, graph.nodes(edges)))


def _some_features(names: list[str]) -> Query:
    return lambda spark, sf_dir: _rounded_off_ties(_features(spark, sf_dir).select("snapshot_id", "node", *names))


for _name, _columns in {
    "density_measures": [f"measure_{b}" for b in BLOCKS],
    "size_measures": [f"size_{b}" for b in BLOCKS],
    **{f"tx_block_{s}": [f"transaction_{v}_summary_{s}_{b}" for v in VALUES for b in BLOCKS] for s in STATS},
    "block_features_daily": FEATURES,
}.items():
    _f = _some_features(_columns)
    _f.__name__ = _name
    _query(_features_sql(_columns))(_f)


_ECHO_E = f"{_placed(1, 3)},\ne as (select snapshot_id, src, dst, max(exp(ln(0.01) / 3 * (((snapshot_id + 1) * {DAY} - o) // 1000000) / 86400.0)) as weight, {_AGG} from placed group by all)"


@_query(_features_sql(FEATURES, _ECHO_E))
def block_features_echo(spark, sf_dir):
    edges = _edges(spark, sf_dir, echo=3)
    return _rounded_off_ties(neighbourhood.features(edges, graph.nodes(edges)))


@_query(f"""with {E_SQL}, {BLOCK},
filled as (select snapshot_id, ego, i, j, amount_trans as x from ed union all
  select snapshot_id, ego, i, j, 0 from (select bs.*, unnest(range(case i when 0 then n0 when 1 then n1 else n2 end * case j when 0 then n0 when 1 then n1 else n2 end - nnz)) from bs join sz using (snapshot_id, ego)))
select snapshot_id, ego, i, j, round(min(x), 6) as min, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) as iqr from filled group by all""")
def block_extra_min_median_iqr(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return _rounded(neighbourhood.block_orders(edges, graph.nodes(edges)))


@_query(f"""with {E_SQL}, {_DEG}, hub as (select * from deg where degree >= 4),
cut as ({_CUT_EDGES}), alone as (select snapshot_id, node from deg except (select snapshot_id, src from cut union select snapshot_id, dst from cut))
select snapshot_id, node, {", ".join(f"cast({1 if n == 'measure_01' else 0} as double) as {n}" for n in FEATURES)} from alone""")
def isolated_nodes(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    cut = graph.prune_hubs(edges, 4)
    alone = graph.nodes(edges).join(graph.nodes(cut), ["snapshot_id", "node"], "left_anti")
    return neighbourhood.features(cut, graph.nodes(edges)).join(alone, ["snapshot_id", "node"], "left_semi")


_COMP = f"""{UND},
reach as (select snapshot_id, u as node, u as r from und union select reach.snapshot_id, und.v, reach.r from reach join und on und.snapshot_id = reach.snapshot_id and und.u = reach.node where reach.r < und.v),
comp as (select snapshot_id, node, min(r) as community from reach group by all)"""


@_query(f"with recursive {E_SQL}, {_COMP} select snapshot_id, node, community from comp")
def components(spark, sf_dir):
    return community.components(_edges(spark, sf_dir))


@_query(f"with recursive {E_SQL}, {_COMP} select e.snapshot_id, src, dst, num_trans from e join comp a on a.snapshot_id = e.snapshot_id and a.node = src join comp b on b.snapshot_id = e.snapshot_id and b.node = dst where a.community = b.community")
def intra_component_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.within(edges, community.components(edges)).select("snapshot_id", "src", "dst", "num_trans")


@_query()
def intra_community_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.within(edges, community.louvain_communities(edges)).select("snapshot_id", "src", "dst", "num_trans")


_SIM_E = f"{_placed(5, 5, _SIM_TX)},\ne as (select snapshot_id, src, dst, cast(1 as double) as weight, {_AGG} from placed group by all)"


@_query(_features_sql(FEATURES, _SIM_E))
def extracted_features(spark, sf_dir):
    """End to end: raw file, snapshots of five days, stored features, read back."""
    folder = _raw(_lines(spark, sf_dir, _SIM), "transactions.csv")
    stored = plans.extract(spark, Settings(dataset="simulator", step=5, width=5), folder, f"{folder}/out", "none")
    return _rounded_off_ties(stored.select("snapshot_id", "node", *FEATURES))


@_query()
def louvain_edges(spark, sf_dir):
    return community.prune(_edges(spark, sf_dir), "louvain")


@_query()
def louvain_features(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return neighbourhood.features(community.prune(edges, "louvain"), graph.nodes(edges))


_FEAT = "feat as (select snapshot_id, node, count(*) as deg, sum(amount_trans) as amt from (select snapshot_id, src as node, amount_trans from e union all select snapshot_id, dst, amount_trans from e) group by all)"


def _small(spark, sf_dir):
    """(snapshot_id, node, label, deg, amt): two features that are quick to check."""
    edges = _edges(spark, sf_dir)
    feat = graph.degrees(edges).withColumnRenamed("degree", "deg").join(graph.degrees(edges, "amount_trans").withColumnRenamed("degree", "amt"), ["snapshot_id", "node"])
    return windows.label_rows(feat, _labels(spark, sf_dir))


@_query(f"with {E_SQL}, {UND}, {_FEAT} select und.snapshot_id, u as node, round(avg(deg), 6) as deg, round(avg(amt) + {_off_ties(4)!r}, 4) as amt from und join feat on feat.snapshot_id = und.snapshot_id and feat.node = v group by all")
def sage_mean_1hop(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    found = graph.neighbour_means(edges, _small(spark, sf_dir), ["deg", "amt"])
    return found.select("snapshot_id", "node", F.round("deg", 6).alias("deg"), F.round(F.col("amt") + F.lit(_off_ties(4)), 4).alias("amt"))


@_query(f"with {E_SQL}, {UND}, {_FEAT}, one as (select und.snapshot_id, u as node, avg(deg) as deg from und join feat on feat.snapshot_id = und.snapshot_id and feat.node = v group by all) select und.snapshot_id, u as node, round(avg(deg), 6) as deg from und join one on one.snapshot_id = und.snapshot_id and one.node = v group by all")
def sage_mean_2hop(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return _rounded(graph.neighbour_means(edges, graph.neighbour_means(edges, _small(spark, sf_dir), ["deg"]), ["deg"]))


@_query(f"with {E_SQL}, {UND}, {_FEAT}, m as (select und.snapshot_id, u as node, avg(deg) as nd from und join feat on feat.snapshot_id = und.snapshot_id and feat.node = v group by all) select snapshot_id, node, round(greatest(0.5 * nd - 0.25 * deg + 0.1, 0), 6) as h0, round(greatest(-0.125 * nd + 0.5 * deg, 0), 6) as h1 from m join feat using (snapshot_id, node)")
def sage_layer(spark, sf_dir):
    return _rounded(graph.sage_layer(_edges(spark, sf_dir), _small(spark, sf_dir).select("snapshot_id", "node", "deg"), ["deg"], [[0.5], [-0.125]], [[-0.25], [0.5]], [0.1, 0.0]))


@_query(f"with {E_SQL}, b as (select * from e where snapshot_id < 5), {UND.replace('from e', 'from b')}, deg as (select snapshot_id, u as node, ln(1 + count(*)) as d from und group by all) select round(avg(d), 9) as mean, round(stddev_samp(d), 9) as std from deg")
def log_degree_std(spark, sf_dir):
    rows = _labels(spark, sf_dir).filter("snapshot_id < 5")
    return _rounded(windows.log_degree_scaler(graph.band_graph(_edges(spark, sf_dir), rows)[1]), 9)


@_query(f"with {E_SQL}, {UND}, {NODES} select n.snapshot_id, n.node, case when n.node = 1 then 'magenta' when und.v is not null then 'white' else 'cyan' end as color from nodes n left join und on und.snapshot_id = n.snapshot_id and und.u = 1 and und.v = n.node")
def ego_styles(spark, sf_dir):
    return graph.ego_styles(_edges(spark, sf_dir), 1)[0]


@_query(f"with {E_SQL} select snapshot_id, src, dst, case when src = 1 or dst = 1 then 'magenta' else 'black' end as color from e")
def ego_edge_styles(spark, sf_dir):
    return graph.ego_styles(_edges(spark, sf_dir), 1)[1]


# --- store, windows, bands, scaling ------------------------------------------------------------------


_ROWS = f"{E_SQL}, {_LAB}, {_FEAT}, rows_ as (select row_number() over (order by snapshot_id, cast(node as varchar)) - 1 as row_id, snapshot_id, cast(node as varchar) as node, cast(coalesce(label, 0) as float) as label, cast(deg as float) as f1, cast(amt as float) as f2 from feat left join lab using (snapshot_id, node))"


def _rows(spark, sf_dir):
    return windows.store_rows(_small(spark, sf_dir), ["deg", "amt"])


@_query(f"with {_ROWS} select row_id, snapshot_id, node, label, round(cast(f1 as double), 2) as f1, round(cast(f2 as double), 2) as f2 from rows_")
def store_rows(spark, sf_dir):
    f = lambda i: F.round(F.col("f")[i].cast("double"), 2).alias(f"f{i + 1}")
    return _rows(spark, sf_dir).select("row_id", "snapshot_id", "node", "label", f(0), f(1))


@_query(f"with {_ROWS}, n as (select i as snapshot_id, count(row_id) as n_rows from (select unnest(range((z - a) // {DAY})) as i from g) left join rows_ on snapshot_id = i group by all) select cast(snapshot_id as integer) as snapshot_id, n_rows, cast(coalesce(sum(n_rows) over (order by snapshot_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from n")
def store_offsets(spark, sf_dir):
    grid = snapshots.make_grid(_transfers(spark, sf_dir), 1, "days").frame(spark)
    return windows.offsets(_labels(spark, sf_dir), grid)


@_query(f"with {_ROWS} select node, cast(row_number() over (order by node) - 1 as integer) as node_code from (select distinct node from rows_)")
def node_dictionary(spark, sf_dir):
    return windows.node_codes(_labels(spark, sf_dir).select(F.col("node").cast("string").alias("node")))


def _windows_sql(k: int, task: str, rows: str | None = None) -> str:
    base = k - 1 if task == "nowcast" else k
    return f"""{rows or _ROWS},
probe as (select a.snapshot_id as anchor, a.node, cast(s as integer) as slot, coalesce(b.row_id, -1) as row_id, a.label as y
  from rows_ a cross join (select unnest(range({k})) as s) left join rows_ b on b.node = a.node and b.snapshot_id = a.snapshot_id - {base} + s where a.snapshot_id >= {base})"""


def _kwindow(k: int, task: str) -> Query:
    def run(spark, sf_dir):
        found = windows.windows(_rows(spark, sf_dir), k, task)
        return found.select("anchor", "node", "y", F.posexplode("idx").alias("slot", "row_id"))

    return run


for _task in ("nowcast", "forecast"):
    _f = _kwindow(4, _task)
    _f.__name__ = f"kwindow_{_task}"
    _query(f"with {_windows_sql(4, _task)} select anchor, node, y, slot, row_id from probe")(_f)


def _nowcast(spark, sf_dir):
    return windows.windows(_rows(spark, sf_dir), 4, "nowcast")


@_query(f"with {_windows_sql(4, 'nowcast')} select slot, count(*) filter (row_id >= 0) as present, count(*) as n from probe group by all")
def window_mask_stats(spark, sf_dir):
    slots = _nowcast(spark, sf_dir).select(F.posexplode(windows.mask(F.col("idx"))).alias("slot", "m"))
    return slots.groupBy("slot").agg(F.count_if("m").alias("present"), F.count("*").alias("n"))


@_query(f"with {_windows_sql(4, 'forecast')} select anchor, node, coalesce(max(case when row_id >= 0 then slot end), 0) as last_step from probe group by all")
def last_valid_step(spark, sf_dir):
    found = windows.windows(_rows(spark, sf_dir), 4, "forecast")
    return found.select("anchor", "node", windows.last_valid_step(windows.mask(F.col("idx"))).alias("last_step"))


@_query(f"with {_windows_sql(3, 'forecast')} select p.anchor, p.node, cast(max(p.y) as float) as y, round(sum((2 * slot + 1) * coalesce(cast(f1 as double), 0)), 2) as s1, round(sum(coalesce(cast(f2 as double), 0)), 2) as s2, cast(6 as bigint) as n from probe p left join rows_ r using (row_id) group by all")
def window_flatten(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    flat = windows.flatten(windows.dense(windows.windows(rows, 3, "forecast"), rows, 2), "forecast")
    v = lambda i: F.col("v")[i].cast("double")
    return flat.select("anchor", "node", "y", F.round(v(0) + 3 * v(2) + 5 * v(4), 2).alias("s1"), F.round(v(1) + v(3) + v(5), 2).alias("s2"), F.size("v").cast("long").alias("n"))


_ROWS90 = f"{E_SQL}, {_LAB}, {BLOCK}, rows_ as (select row_number() over (order by wide.snapshot_id, cast(ego as varchar)) - 1 as row_id, wide.snapshot_id, cast(ego as varchar) as node, cast(coalesce(label, 0) as float) as label, {', '.join(f'cast({_feature_sql(n)} as float) as {n}' for n in FEATURES)} from wide left join lab on lab.snapshot_id = wide.snapshot_id and lab.node = wide.ego)"


def _rows90(spark, sf_dir):
    return windows.store_rows(windows.label_rows(_features(spark, sf_dir), _labels(spark, sf_dir)))


@_query(f"with {_ROWS90} select row_id, snapshot_id, node, label, {', '.join(f'round(cast({n} as double) + {_off_ties(2)!r}, 2) as {n}' for n in FEATURES)} from rows_")
def store_rows_90(spark, sf_dir):
    return _rows90(spark, sf_dir).select("row_id", "snapshot_id", "node", "label", *[F.round(F.col("f")[i].cast("double") + F.lit(_off_ties(2)), 2).alias(n) for i, n in enumerate(FEATURES)])


def _flat90(k: int, task: str) -> Query:
    def run(spark, sf_dir):
        rows = _rows90(spark, sf_dir)
        flat = windows.last_steps(rows, k) if task == "nowcast" else windows.flatten(windows.dense(windows.windows(rows, k, task), rows, 90), task)
        total = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i % 7 + 1)), F.lit(0.0), lambda a, x: a + x)
        return flat.select("anchor", "node", "y", F.round(total + F.lit(_off_ties(1)), 1).alias("total"), F.size("v").cast("long").alias("n"))

    return run


for _task, _first, _n in (("nowcast", 2, 90), ("forecast", 0, 270)):
    _f = _flat90(3, _task)
    _f.__name__ = f"window_flatten_90_{_task}"
    _terms = " + ".join(f"coalesce(cast({n} as double), 0) * (((slot - {_first}) * 90 + {i}) % 7 + 1)" for i, n in enumerate(FEATURES))
    _query(f"with {_windows_sql(3, _task, _ROWS90)} select p.anchor, p.node, cast(max(p.y) as float) as y, round(sum({_terms}) + {_off_ties(1)!r}, 1) as total, cast({_n} as bigint) as n from probe p left join rows_ r using (row_id) where slot >= {_first} group by all")(_f)


def _banded_sql(k: int, rows: str | None = None) -> str:
    return f"{_windows_sql(k, 'nowcast', rows)}, t as (select max(anchor) as top from probe), banded as (select probe.*, case when anchor > top - 8 then 'test' when anchor > top - 16 then 'val' else 'train' end as band from probe, t)"


def _banded(spark, sf_dir):
    return windows.bands(_nowcast(spark, sf_dir), 8, 8)


@_query(f"with {_banded_sql(4)} select band, anchor, count(*) as n, cast(sum(y) as bigint) as positives from banded where slot = 0 group by all")
def temporal_bands(spark, sf_dir):
    return _banded(spark, sf_dir).groupBy("band", "anchor").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@_query(f"with {_banded_sql(4)} select band, count(*) filter (y > 0) as positives, count(*) filter (y <= 0) as negatives, count(*) filter (y <= 0) / greatest(count(*) filter (y > 0), 1) as ratio from banded where slot = 0 group by all")
def band_class_ratio(spark, sf_dir):
    return windows.class_ratio(_banded(spark, sf_dir), "band")


_SCALER = f"{_banded_sql(4)}, cell as (select distinct row_id from banded where band = 'train' and row_id >= 0), fit as (select avg(cast(f1 as double)) as m1, greatest(stddev_pop(cast(f1 as double)), 1e-8) as s1, avg(cast(f2 as double)) as m2, greatest(stddev_pop(cast(f2 as double)), 1e-8) as s2 from rows_ join cell using (row_id))"


def _fitted(rows):
    return windows.scaler(windows.bands(windows.windows(rows, 4, "nowcast"), 8, 8).filter("band = 'train'"), rows, 2)


@_query(f"with {_SCALER} select 0 as feature, round(m1, 4) as mean, round(s1, 4) as std from fit union all select 1, round(m2, 4), round(s2, 4) from fit")
def scaler_stats(spark, sf_dir):
    return _rounded(_fitted(_rows(spark, sf_dir)), 4)


_SCALER90 = f"{_banded_sql(4, _ROWS90)}, cell as (select distinct row_id from banded where band = 'train' and row_id >= 0), fit as (select {', '.join(f'avg(cast({n} as double)) as m{i}, greatest(stddev_pop(cast({n} as double)), 1e-8) as s{i}' for i, n in enumerate(FEATURES))} from rows_ join cell using (row_id))"


@_query(f"with {_SCALER90} " + " union all ".join(f"select {i} as feature, round(m{i} + {_off_ties(3)!r}, 3) as mean, round(s{i} + {_off_ties(3)!r}, 3) as std from fit" for i in range(90)))
def scaler_stats_90(spark, sf_dir):
    rows = _rows90(spark, sf_dir)
    cut = windows.bands(windows.windows(rows, 4, "nowcast"), 8, 8)
    return _rounded_off_ties(windows.scaler(cut.filter("band = 'train'"), rows, 90), 3)


@_query(f"with {_SCALER} select row_id, round((f1 - m1) / s1, 3) as f1, round((f2 - m2) / s2, 3) as f2 from rows_, fit")
def scaled_rows(spark, sf_dir):
    f = lambda i: F.round(F.col("f")[i].cast("double"), 3).alias(f"f{i + 1}")
    rows = _rows(spark, sf_dir)
    return windows.scale(rows, _fitted(rows)).select("row_id", f(0), f(1))


@_query("with n as (select toxic, count(*) as n from labels group by all) select toxic, 'train' as split, cast(round(n * 0.6) as bigint) as n from n union all select toxic, 'val', cast(round(n * 0.8) - round(n * 0.6) as bigint) from n union all select toxic, 'test', cast(n - round(n * 0.8) as bigint) from n")
def stratified_split_counts(spark, sf_dir):
    own = windows.hash_split(_table(spark, sf_dir, "labels"), "doc_id", {"train": 0.6, "val": 0.2, "test": 0.2}, "toxic")
    return own.groupBy("toxic", "split").agg(F.count("*").alias("n"))


@_query(f"with {_ROWS}, d as (select node, row_number() over (order by node) - 1 as c from (select distinct node from rows_)) select row_id, node, cast(c as integer) as node_code from rows_ join d using (node)")
def encoded_nodes(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_id", "node")
    return windows.encode(rows, windows.node_codes(rows))


@_query("select user_id, cast(row_number() over (order by t, i) - 1 as integer) as code from (select user_id, min(ts) as t, min_by(event_id, (ts, event_id)) as i from events group by all)")
def appearance_codes(spark, sf_dir):
    return windows.appearance_codes(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@_query("select doc_id as position, cast(doc_id as varchar) as node, toxic from documents left join labels using (doc_id)")
def labels_in_order(spark, sf_dir):
    order = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("node"))
    return windows.labels_in_order(order, _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("node"), "toxic"))


@_query("select cast((i - 1) // 8 as integer) as channel, round(avg(cast(embedding[i] as double)), 9) as mean, round(stddev_samp(cast(embedding[i] as double)), 9) as std from embeddings, (select unnest(range(1, 65)) as i) group by all")
def channel_stats(spark, sf_dir):
    return _rounded(windows.channel_stats(_table(spark, sf_dir, "embeddings"), "embedding", 8, 8), 9)


@_query("select round_even(count(*) filter (toxic = 0) / count(*) filter (toxic = 1), 0) * 0.01::double as weight from labels")
def rounded_class_ratio(spark, sf_dir):
    return windows.rounded_class_ratio(_table(spark, sf_dir, "labels").select(F.col("toxic").alias("y")), 0.01)


@_query("select cast(doc_id as varchar) as node, n_chars, toxic <> 0 as label from documents join labels using (doc_id)")
def static_rows(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node"), "n_chars")
    return windows.static_rows(own, loaders.label_table(_table(spark, sf_dir, "labels").select("doc_id", "toxic")))


@_query("select event_id, 'b' || cast(event_id % 7 as varchar) as dataset, 'd1_echo3' as run_tag, cast(event_id % 9 as integer) as K, case when event_id % 2 = 0 then 'nowcast' else 'forecast' end as task, 'baselines' as kind, case when event_id % 3 = 0 then 'XGBoost' end as models from events")
def name_parts(spark, sf_dir):
    name = F.expr("'/x/y_z/b' || cast(event_id % 7 as string) || '_d1_echo3_K' || cast(event_id % 9 as string) || case when event_id % 2 = 0 then '_nowcast' else '_forecast' end || '_baselines' || case when event_id % 3 = 0 then '_XGBoost' else '' end || '.txt'")
    return _table(spark, sf_dir, "events").select("event_id", name.alias("path")).select("event_id", *results.name_parts())


@_query(f"with {TX} select cast(row_number() over (order by ts, src, dst, amount, label) - 1 as bigint) as position, src, dst, ts from tx")
def transfers_in_time(spark, sf_dir):
    """Ordered by time, ties by the other columns; the places are given by ranges."""
    ordered = loaders.in_time(_transfers(spark, sf_dir)).withColumn("__part", F.spark_partition_id())
    return windows.numbered(windows.pinned(ordered), "__part", ["ts", "src", "dst", "amount", "label"]).select(F.col("__n").alias("position"), "src", "dst", "ts")


@_query()
def sampled_nodes(spark, sf_dir):
    """Sampling is the feature; its pool is every node of every snapshot."""
    return results.sample_nodes(_labels(spark, sf_dir), 20, 40)


# --- metrics -----------------------------------------------------------------------------------------


S_SQL = """s as (select doc_id as id, cast(toxic as integer) as y, (n_chars % 17 + 3 * toxic + quality) / 20.0 as score from labels join documents using (doc_id)),
c as (select score, count(*) as n, sum(y) as tp from s group by all),
r as (select score, n, tp, sum(n) over d as cn, sum(tp) over d as ct, sum(n) over () as alln, sum(tp) over () as allp from c window d as (order by score desc rows unbounded preceding))"""


@_query(f"with {S_SQL} select round(sum(tp / allp * ct / cn), 9) as auc_pr from r")
def auc_pr(spark, sf_dir):
    return _rounded(metrics.auc(_scores(spark, sf_dir)).select("auc_pr"), 9)


@_query(f"with {S_SQL}, k as (select y, (2 * rank() over (order by score) + count(*) over (partition by score) - 1) / 2.0 as avg_rank from s) select round((sum(case when y = 1 then avg_rank end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auc_roc from k")
def auc_roc(spark, sf_dir):
    return _rounded(metrics.auc(_scores(spark, sf_dir)).select("auc_roc"), 9)


@_query(f"with {S_SQL} select score as threshold, round(ct / cn, 9) as precision, round(ct / allp, 9) as recall from r union all select null, 1.0, 0.0")
def pr_curve(spark, sf_dir):
    return _rounded(metrics.pr_curve(_scores(spark, sf_dir)), 9)


@_query(f"""with {S_SQL}, p as (select *, cn - ct as fp from r), q as (select *, coalesce(lag(fp) over o, 0) as f0, coalesce(lag(ct) over o, 0) as t0, lead(fp) over o as f2, lead(ct) over o as t2 from p window o as (order by score desc))
select round(fp / (alln - allp), 9) as fpr, round(ct / allp, 9) as tpr from q where f2 is null or (fp - f0) * (t2 - ct) <> (ct - t0) * (f2 - fp) union all select 0.0, 0.0""")
def roc_curve(spark, sf_dir):
    return _rounded(metrics.roc_curve(_scores(spark, sf_dir)).drop("threshold"), 9)


def _p_sql(k: str) -> str:
    return f"with {S_SQL}, k as (select *, {k} as k from r) select cast(k as bigint) as k, round(sum(greatest(0, least(n, k - (cn - n))) * tp / n) / k, 9) as precision from k group by k"


@_query(_p_sql("50"))
def precision_at_k(spark, sf_dir):
    return _rounded(metrics.precision_at(_scores(spark, sf_dir), 50), 9)


@_query(_p_sql("ceil(alln * 0.1)"))
def precision_at_frac(spark, sf_dir):
    return _rounded(metrics.precision_at(_scores(spark, sf_dir), 0.1), 9)


@_query(_p_sql("allp"))
def r_precision(spark, sf_dir):
    return _rounded(metrics.r_precision(_scores(spark, sf_dir)), 9)


_BEST = "best as (select 2.0 * ct / (cn + allp) as f1, score as threshold, ct / cn as p, ct / allp as q from r order by 2.0 * ct / (cn + allp) desc, score limit 1)"


@_query(f"with {S_SQL}, {_BEST} select round(f1, 9) as best_f1, threshold, round(p, 9) as precision, round(q, 9) as recall from best")
def best_f1(spark, sf_dir):
    return metrics.best_f1(_scores(spark, sf_dir)).select(F.round("best_f1", 9).alias("best_f1"), "threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@_query(f"with {S_SQL} select round(coalesce(2.0 * sum(y) filter (score >= 0.5) / nullif(count(*) filter (score >= 0.5) + sum(y), 0), 0), 9) as f1 from s")
def f1_at_05(spark, sf_dir):
    return _rounded(metrics.f1_at(_scores(spark, sf_dir), 0.5), 9)


@_query(f"with {S_SQL} select round(avg(y), 9) as prevalence from s")
def prevalence(spark, sf_dir):
    return _rounded(metrics.auc(_scores(spark, sf_dir)).select("prevalence"), 9)


_WIDE = "wide as (select doc_id, cast(toxic as integer) as y, (n_chars % 17 + 3 * toxic) / 20.0 as score_a, (n_chars % 5 + quality) / 6.0 as score_b from labels join documents using (doc_id))"


@_query(f"with {_WIDE}, l as (select y, 'a' as model, score_a as score from wide union all select y, 'b', score_b from wide) select model, count(*) as n, sum(y)::bigint as positives, round(avg(score), 9) as mean_score from l group by all")
def predictions_long(spark, sf_dir):
    own = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    wide = own.select("doc_id", F.col("toxic").cast("int").alias("y"), ((F.col("n_chars") % 17 + 3 * F.col("toxic")) / F.lit(20.0)).alias("score_a"), ((F.col("n_chars") % 5 + F.col("quality")) / F.lit(6.0)).alias("score_b"))
    long = scores_long(wide, ["doc_id", "y"], ["score_a", "score_b"])
    return long.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.avg("score"), 9).alias("mean_score"))


def _at_sql(k: str) -> str:
    return f"(select case when max(k) between 1 and max(alln) then round(sum(greatest(0, least(n, k - (cn - n))) * tp / n) / max(k), 9) end from (select *, {k} as k from r))"


@_query(f"""with {S_SQL}, {_BEST} select 'scores' as model, (select round(2.0 * sum(y) filter (score >= 0.5) / (count(*) filter (score >= 0.5) + sum(y)), 9) from s) as f1_at_05,
  round(f1, 9) as f1_best, threshold as f1_best_threshold, round(p, 9) as f1_best_precision, round(q, 9) as f1_best_recall, {_at_sql('50')} as p_at_50, {_at_sql('1000000')} as p_at_1000000,
  {_at_sql('ceil(alln * 0.005)')} as p_at_05pct, {_at_sql('ceil(alln * 0.1)')} as p_at_10pct, {_at_sql('allp')} as p_at_r from best""")
def extra_metrics(spark, sf_dir):
    found = metrics.extra_metrics(_scores(spark, sf_dir).withColumn("model", F.lit("scores")), "model", at=(50, 1_000_000), shares=(0.005, 0.1), r_precision=True)
    names = {"F1@0.5": "f1_at_05", "F1_best": "f1_best", "F1_best_threshold": "f1_best_threshold", "F1_best_precision": "f1_best_precision", "F1_best_recall": "f1_best_recall", "P@50": "p_at_50", "P@1000000": "p_at_1000000", "P@0.5%": "p_at_05pct", "P@10%": "p_at_10pct", "P@R": "p_at_r"}
    return _rounded(found.withColumnsRenamed(names), 9)


@_query("select doc_id as id, round(case when z > 0 then ln(1 + exp(-z)) else -z + ln(1 + exp(z)) end * (1 + 2.0 * y) + (1 - y) * z, 9) as loss from (select doc_id, toxic as y, (n_chars % 17 - 8) / 4.0 as z from labels join documents using (doc_id))")
def bce_loss(spark, sf_dir):
    own = _logits(spark, sf_dir)
    return _rounded(own.select("id", scalars.log_loss(F.col("z"), F.col("y"), 3.0).alias("loss")), 9)


def _logits(spark, sf_dir):
    own = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return own.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), ((F.col("n_chars") % 17 - 8) / F.lit(4.0)).alias("z"))


@_query("select id, round(a * pow(1 - pt, 2) * -ln(pt), 9) as loss from (select id, case when y = 1 then 0.25 else 0.75 end as a, case when y = 1 then p else 1 - p end as pt from (select doc_id as id, toxic as y, 1 / (1 + exp(-(n_chars % 17 - 8) / 4.0)) as p from labels join documents using (doc_id)))")
def focal_loss(spark, sf_dir):
    return _rounded(_logits(spark, sf_dir).select("id", scalars.focal_loss(F.col("z"), F.col("y")).alias("loss")), 9)


# --- results -----------------------------------------------------------------------------------------


@_query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def dedupe_keep_last(spark, sf_dir):
    return results.keep_last(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@_query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as r from events) where r = 1")
def best_per_group(spark, sf_dir):
    return results.best_per(_table(spark, sf_dir, "events"), ["event_type"], "value", ["event_id"]).select("event_type", "event_id", "value")


_GRID = (["d1_w1", "d1_echo3", "h6_echo1", "d2_echo7"], [3, 7, 17], ["nowcast", "forecast"])
_GRID_SQL = f"grid as (select cast(i as integer) as cell, {_GRID[0]}[i // 6 + 1] as timing, cast({_GRID[1]}[i // 2 % 3 + 1] as integer) as K, {_GRID[2]}[i % 2 + 1] as task from (select unnest(range(24)) as i))"


@_query(f"with {_GRID_SQL} select cell, timing, K, task from grid")
def sweep_grid(spark, sf_dir):
    return results.sweep_grid(spark, *_GRID)


@_query(f"with {_GRID_SQL}, have as (select cast(floor(value / 25) as integer) as cell, count(*) as n from events group by all) select cell, timing, K, task, coalesce(n, 0) as n, case when n is null then 'missing' else 'top-up' end as state from grid left join have using (cell) where coalesce(n, 0) < 10")
def missing_cells(spark, sf_dir):
    have = _table(spark, sf_dir, "events").select(F.floor(F.col("value") / 25).cast("int").alias("cell"))
    return results.missing_cells(results.sweep_grid(spark, *_GRID), have, ["cell"], 10)


@_query("select event_type, count(distinct user_id) filter (value > 100) as n_have, count(distinct user_id) as n_total from events group by all")
def coverage(spark, sf_dir):
    ev = _table(spark, sf_dir, "events")
    return results.coverage(ev.filter("value > 100"), ev, "event_type", "user_id")


@_query("select l.doc_id, l.toxic from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.lang = 'en')")
def without_predictions(spark, sf_dir):
    return results.without_predictions(_table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"]).select("doc_id", "toxic")


@_query("select user_id, value, again as value_again, abs(value - again) <= 0.0001::double as matches from (select user_id, max(value) as value from events group by all) left join (select user_id, max(value) + max(user_id % 2) * 0.001::double as again from events where user_id % 3 <> 0 group by all) using (user_id)")
def compare_metrics(spark, sf_dir):
    top = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("value"))
    again = top.filter("user_id % 3 <> 0").withColumn("value", F.col("value") + (F.col("user_id") % 2) * F.lit(0.001))
    return results.compare(top, again, ["user_id"], "value")


@_query("select event_type, cast(K as integer) as K from (select distinct event_type, user_id % 5 as K from events)")
def steps_per_combo(spark, sf_dir):
    own = _table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).cast("int").alias("K"))
    return results.steps_per_combo(own, ["event_type"]).select("event_type", F.explode("Ks").alias("K"))


@_query("select event_id, 'm' || event_id % 7 as model, cast(event_id % 100 as double) / 100 as auc_pr, cast(event_id % 90 as double) / 90 as auc_roc, cast(0.5 as double) as prevalence from events")
def parse_metric_text(spark, sf_dir):
    block = F.concat(F.lit("Model: m"), F.col("event_id") % 7, F.lit("\nAUC ROC: "), (F.col("event_id") % 90).cast("double") / 90, F.lit("\nAUC PR: "), (F.col("event_id") % 100).cast("double") / 100, F.lit("\nPrecision: [0.5 0.6 ...]\n"))
    files = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), block.alias("value"))
    return results.parse_metric_blocks(files).select(F.col("path").cast("long").alias("event_id"), "model", "auc_pr", "auc_roc", "prevalence")


# --- models (rows only) ------------------------------------------------------------------------------


def _training_rows(spark, sf_dir):
    emb = _table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").alias("f"))


@_query()
def logreg_scores(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return models.logistic(rows, rows).select("row_id", "y", "score")


@_query()
def gbt_scores(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return models.boosted(rows, rows, weight=9.0).select("row_id", "y", "score")


@_query()
def mlp_scores(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return models.perceptron(rows, rows, 64).select("row_id", "y", "score")


@_query()
def network_scores(spark, sf_dir):
    """Weighted by class, stopped by the held-out band; every row is scored."""
    rows = _training_rows(spark, sf_dir)
    held_out = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    return network.network(rows.filter(~held_out), rows, 64, val=rows.filter(held_out), dropout=0.1).select("row_id", "y", "score")


@_query()
def boosted_scores(spark, sf_dir):
    """Second-order trees with class weight and draws, stopped by the held-out band; every row is scored."""
    rows = _training_rows(spark, sf_dir)
    held_out = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    setting = boosting.Setting(trees=10, depth=3, step=0.3, weight=9.0, rows=0.8, columns=0.5)
    return boosting.scored(boosting.boost(rows.filter(~held_out), setting, val=rows.filter(held_out)), rows).select("row_id", "y", "score")


def _scaled_windows(spark, sf_dir):
    """(anchor, node, y, x, mask): four steps of the 90 columns, scaled by the train band, absent steps zero."""
    rows = _rows90(spark, sf_dir)
    cut = windows.bands(windows.windows(rows, 4, "nowcast"), 8, 8)
    unit = windows.scale(rows, windows.scaler(cut.filter("band = 'train'"), rows, 90))
    return windows.dense(windows.with_history(cut.drop("band")), unit, 90).withColumn("x", F.flatten("x")), cut.select("anchor", "node", "band")


def _sequence_scores(model) -> Query:
    def run(spark, sf_dir):
        rows, bands = _scaled_windows(spark, sf_dir)
        rows = windows.pinned(rows.join(bands, ["anchor", "node"]))
        p = training.train(model, rows.filter("band = 'train'"), rows.filter("band = 'val'"), training.Setting(epochs=6, every=3, step=0.02, dropout=0.1), mask="mask")
        return training.scored(model, p, rows, mask="mask").select("anchor", "node", "y", "score")

    return run


for _name, _model in (("recurrent_scores", sequence.Recurrent(4, 90, 16)), ("attention_scores", sequence.Attention(4, 90, 16, 2))):
    _f = _sequence_scores(_model)
    _f.__name__ = _name
    _query()(_f)


@_query()
def convolution_scores(spark, sf_dir):
    """Over the (10, 3, 3) blocks of every row of the feature store."""
    rows = _rows90(spark, sf_dir)
    unit = windows.scale(rows, windows.scaler(windows.windows(rows, 1, "nowcast"), rows, 90)).select("row_id", F.col("label").alias("y"), F.col("f").alias("x"))
    unit, model = windows.pinned(unit), sequence.Convolution()
    return training.scored(model, training.train(model, unit, None, training.Setting(epochs=6, step=0.02)), unit).select("row_id", "y", "score")


@_query()
def sage_scores(spark, sf_dir):
    """Two layers over the day's transfers, trained on the nodes of four fifths, scoring all."""
    edges, small = windows.pinned(_edges(spark, sf_dir)), windows.pinned(_small(spark, sf_dir))
    x = small.select("snapshot_id", "node", F.array(F.log1p("deg"), F.log1p("amt")).alias("x"))
    y = small.filter(F.pmod(F.xxhash64("node"), F.lit(5)) != 0).select("snapshot_id", "node", F.col("label").alias("y"))
    return sage.sage_scores(edges, x, y, training.Setting(epochs=5, step=0.05), hidden=8).select("snapshot_id", "node", "score")


@_query()
def iforest_scores(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return models.isolation_forest(rows, rows).select("row_id", "score")


@_query("select vec_id, cast(i as integer) as i, case when embedding[i % 64 + 1] > 0 then 1 else 0 end as bit from embeddings, (select unnest(range(69)) as i)")
def bitpack_roundtrip(spark, sf_dir):
    """All 64 components and the first five again: a length that fills no whole number of bytes."""
    bits = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.concat("embedding", F.slice("embedding", 1, 5)), lambda x: (x > 0).cast("int")).alias("b"))
    return models.unpack_bits(models.pack_bits(bits, "b"), "b", 69).select("vec_id", F.posexplode("b").alias("i", "bit"))


@_query("with b as (select unnest(range(10)) as c, vec_id, embedding from embeddings) select vec_id, cast(c as integer) as channel, cast(r as integer) as \"row\", cast(k as integer) as col, embedding[(c * 9 + r * 3 + k) % 64 + 1] as v from b, (select unnest(range(3)) as r), (select unnest(range(3)) as k)")
def picture_blocks(spark, sf_dir):
    own = _table(spark, sf_dir, "embeddings").select("vec_id", scalars.picture([F.col("embedding")[i % 64] for i in range(90)]).alias("p"))
    one = own.select("vec_id", F.posexplode("p").alias("channel", "b")).select("vec_id", "channel", F.posexplode("b").alias("row", "r"))
    return one.select("vec_id", "channel", "row", F.posexplode("r").alias("col", "v"))


