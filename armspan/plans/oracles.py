"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from armspan.plans.bindings import EMBEDDING_SIZE

ORACLES: dict[str, str] = {}


def _exact(x: str, digits: int) -> str:
    """Rounding of the exact binary value; printf rounds only exact ties the other way."""
    ties = f"(({x}) * {2 ** (digits + 1)}) % 2"
    return (
        f"case when abs({ties}) = 1 then round_even({x}, {digits}) "
        f"else cast(printf('%.{digits}f', {x}) as double) end"
    )


def _text(x: str, digits: int, sign: str = "") -> str:
    return f"printf('%{sign}.{digits}f', {_exact(x, digits)})"


def _with(body: str, *names: str) -> str:
    return "with " + ", ".join(f"{name} as ({_CTES[name]})" for name in names) + " " + body


_MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"

_CTES = {
    "facts": """
        select o_custkey as "CUST_ID", o_orderkey as "TRANS_ID",
               cast(year(o_orderdate) as int) as "YEAR", cast(month(o_orderdate) as int) as "MONTH",
               cast(day(o_orderdate) as int) as "DAY", o_orderpriority as "EXP_TYPE",
               o_totalprice as "AMOUNT"
        from orders""",
    "named": """
        select event_id, ts, user_id, event_type as benchmark, value, provider, mode,
               concat_ws('_', event_type, case when user_id % 5 <> 0 then provider end,
                         case when user_id % 4 <> 0 then mode end,
                         'run' || lpad(cast(user_id % 20 + 1 as varchar), 2, '0'),
                         strftime(ts, '%Y%m%d_%H%M%S')) as experiment_id
        from (select *, case when user_id % 2 = 0 then 'aws' else 'gcp' end as provider,
                     case user_id % 3 when 0 then 'sample' when 1 then 'large' else 'full' end as mode
              from events)""",
    "runs": """
        select *,
               user_id % 7 <> 0 as has_timings,
               user_id % 11 <> 0 as has_costs,
               case when user_id % 7 <> 0 then value end as total_time,
               case when user_id % 7 <> 0 and user_id % 3 <> 0 then value * 0.75::double end as benchmark_execution,
               case when user_id % 7 <> 0 and benchmark = 'purchase' then value * 0.5::double end as ml_training,
               case when user_id % 11 <> 0 then value * 0.001::double end as master,
               case when user_id % 11 <> 0 then value * 0.002::double end as worker,
               case when user_id % 11 <> 0 then value * 0.001::double + value * 0.002::double end as total_compute,
               case when user_id % 11 <> 0 and benchmark <> 'view' then 0.0005::double end as storage,
               benchmark <> 'error' as success
        from named""",
    "totals": """
        select event_id, provider, benchmark, value as total_time,
               value * 0.001::double + 0.0005::double as total_cost
        from named""",
    "run_costs": """
        select *,
               case when has_costs then ((0::double + master) + worker) + total_compute + coalesce(storage, 0) end
                   as total_recorded,
               case when has_costs then ((0::double + master) + worker) + coalesce(storage, 0) end as total_net
        from runs""",
    "cost_entries": """
        select event_id, experiment_id, provider,
               case provider when 'aws' then 'master_ec2' else 'master_vm' end as key, master as v
        from runs where has_costs
        union all
        select event_id, experiment_id, provider,
               case provider when 'aws' then 'core_ec2' else 'worker_vm' end, worker from runs where has_costs
        union all select event_id, experiment_id, provider, 'total_compute', total_compute from runs where has_costs
        union all select event_id, experiment_id, provider, 'storage', storage from runs where storage is not null""",
    "timing_entries": """
        select event_id, provider, 'total_time' as key, total_time as v from runs where has_timings
        union all select event_id, provider, 'benchmark_execution', benchmark_execution
                  from runs where benchmark_execution is not null
        union all select event_id, provider, 'ml_training', ml_training from runs where ml_training is not null""",
    "tests": """
        select l_orderkey as record_id, case when l_orderkey % 2 = 0 then 'aws' else 'gcp' end as provider,
               case l_linenumber % 4 when 0 then 'upload' when 1 then 'download'
                    when 2 then 'sequential_read' else 'write' end as operation,
               l_quantity as size_mb, round(l_tax * 100) as seconds, l_returnflag = 'R' as failed
        from lineitem""",
    "rates": f"""
        select *, {_exact("case when seconds > 0 then size_mb / seconds else 0::double end", 2)} as rate
        from tests where not failed""",
    "metrics": """
        select provider, cast(user_id % 20 as int) as run,
               cast(count(*) filter (where benchmark = 'purchase') as double) / count(*) as accuracy,
               case when user_id % 20 % 4 <> 0
                    then cast(count(*) filter (where benchmark = 'click') as double) / count(*) else 0::double end
                   as f1_score
        from named group by provider, user_id % 20""",
    "two_rates": """
        select l_orderkey, l_linenumber, l_partkey, round(l_tax * 100) as base, round(l_discount * 100) as candidate
        from lineitem""",
    "differences": """
        select *, case when base = 0 and candidate = 0 then 0::double when base = 0 then 100::double
                       else (candidate - base) / base * 100 end as difference_pct,
               case when base <> 0 then (candidate - base) / base * 100 end as difference_unguarded
        from two_rates""",
    "arm_stats": """
        select provider, benchmark, 'Total Time (seconds)' as metric, avg(total_time) as mean,
               stddev_pop(total_time) as std from totals group by provider, benchmark
        union all
        select provider, benchmark, 'Total Cost (USD)', avg(total_cost), stddev_pop(total_cost)
        from totals group by provider, benchmark""",
    "pairs": """
        select a.benchmark, a.metric, a.mean as base_mean, a.std as base_std, g.mean as cand_mean, g.std as cand_std
        from arm_stats a join arm_stats g on a.benchmark = g.benchmark and a.metric = g.metric
        where a.provider = 'aws' and g.provider = 'gcp'""",
    "compared": """
        select *, case when difference_pct > 0 then 'AWS' when difference_pct < 0 then 'GCP' else 'Tie' end as winner
        from (select *, case when base_mean = 0 and cand_mean = 0 then 0::double when base_mean = 0 then 100::double
                             else (cand_mean - base_mean) / base_mean * 100 end as difference_pct
              from pairs)""",
    "prices": """
        select * from (values ('aws', 'm4.large', 0.10::double), ('aws', 'emr_fee_per_instance', 0.03::double),
                              ('aws', 's3_storage', 0.023::double), ('gcp', 'n1-standard-2', 0.095::double),
                              ('gcp', 'dataproc_fee_per_vcpu', 0.010::double), ('gcp', 'gcs_storage', 0.020::double))
               as t(arm, item, unit_price)""",
    "arm_rates": """
        select * from (values ('aws', 0.10::double, 0.03::double, 0.023::double),
                              ('gcp', 0.095::double, 0.010::double * 4, 0.020::double))
               as t(arm, vm, fee, storage_rate)""",
    "costed": """
        select event_id, user_id, mode, r.arm, value, vm * h as master_vm, fee * h as master_fee,
               vm * h * 2 as worker_vm, fee * h * 2 as worker_fee, storage_rate,
               ((vm * h + fee * h) + vm * h * 2) + fee * h * 2 as total_compute
        from (select *, value / 3600 as h from named) n join arm_rates r on n.provider = r.arm""",
    "embedded": """
        select vec_id, label, cast(embedding as double[]) as v from embeddings""",
    "scored": """
        select (select count(*) from labels where quality = toxic) as hits, (select count(*) from labels) as n,
               sum(t.n * 2.0::double * coalesce(hit, 0) / (t.n + coalesce(p.n, 0))) as weighted
        from (select quality as c, count(*) as n, count(*) filter (where quality = toxic) as hit
              from labels group by quality) t
        left join (select toxic as c, count(*) as n from labels group by toxic) p on t.c = p.c""",
}

_NAMED_RUNS = ("named", "runs")
_COMPARED = ("named", "totals", "arm_stats", "pairs", "compared")

_hash_below = "cast(concat('0x', substr(md5(concat(cast({0} as varchar), ':42')), 1, 8)) as bigint) < {1} * 4294967296"


# Sources

_TEXT_DATE = "strftime(o_orderdate, '%Y-%m-%d')"
ORACLES["scan_csv_transactions"] = f"""
    select cast(o_custkey as varchar) as "CUST_ID", {_TEXT_DATE} as "START_DATE", cast(null as varchar) as "END_DATE",
           cast(o_orderkey as varchar) as "TRANS_ID", {_TEXT_DATE} as "DATE",
           cast(year(o_orderdate) as int) as "YEAR", cast(month(o_orderdate) as int) as "MONTH",
           cast(day(o_orderdate) as int) as "DAY", o_orderpriority as "EXP_TYPE", o_totalprice as "AMOUNT"
    from orders"""

ORACLES["scan_dataset_mode"] = f"""
    select cast(o_orderkey as varchar) as "TRANS_ID", cast(o_custkey as varchar) as "CUST_ID",
           o_orderpriority as "EXP_TYPE", cast(year(o_orderdate) as int) as "YEAR",
           cast(month(o_orderdate) as int) as "MONTH", cast(day(o_orderdate) as int) as "DAY",
           o_totalprice as "AMOUNT"
    from orders where {_hash_below.format("o_orderkey", 0.5)}"""

ORACLES["scan_parquet_split"] = f"""
    select case when {_hash_below.format("vec_id", 0.8)} then 'train' else 'test' end as split, count(*) as row_count
    from embeddings group by 1"""

ORACLES["scan_run_records"] = _with(
    """
    select experiment_id, provider, mode,
           cast(has_timings and total_time is not null as int) + cast(benchmark_execution is not null as int)
               + cast(ml_training is not null as int) as timing_keys,
           case when has_costs then 3 + cast(storage is not null as int) else 0 end as cost_keys,
           total_time, cast(success as int) as success
    from runs""",
    *_NAMED_RUNS,
)

ORACLES["scan_ml_metrics"] = _with("select provider, run, accuracy, f1_score from metrics", "named", "metrics")

_MEAN_RATE = _MONEY.format("rate") + " / count(*)"
_OP_STATS = f"""
    {_exact(_MEAN_RATE, 2)} as avg_throughput_mbps, {_exact("sum(seconds) / count(*)", 3)} as avg_duration_seconds,
    count(*) as count"""

ORACLES["scan_storage_records"] = _with(
    f"""
    select provider, cast(record_id as varchar) as test_file, operation, {_OP_STATS}
    from rates group by provider, record_id, operation""",
    "tests",
    "rates",
)

# Sinks

_PLACED_SUM = "round(list_sum(list_transform({0}, lambda x, i: x * i)), 6)"
_SUM = _PLACED_SUM.format("v")
ORACLES["sink_parquet"] = _with(f"select vec_id, label, {_SUM} as feature_sum from embedded", "embedded")

_SPREAD = """
    round(avg({1}), 6) as {0}_mean, round(stddev_pop({1}), 6) as {0}_std, min({1}) as {0}_min, max({1}) as {0}_max"""

ORACLES["multi_run_summary"] = ORACLES["sink_text_single"] = _with(
    f"""
    select count(*) as num_runs, count(*) filter (where success) as successful_runs,
           count(*) filter (where not success) as failed_runs,
           {_SPREAD.format("total_time", "total_time")}, {_SPREAD.format("total_cost", "total_recorded")}
    from run_costs""",
    *_NAMED_RUNS,
    "run_costs",
)

ORACLES["sink_text_suite"] = """
    select event_type as name, count(*) as result_rows, cast(event_type <> 'error' as int) as success
    from events group by event_type"""

ORACLES["sink_run_json"] = _with(
    "select experiment_id, provider, key as component, v as usd from cost_entries", *_NAMED_RUNS, "cost_entries"
)


def _filled(entries: str, has: str) -> str:
    """Every run of an arm against every key of that arm, absent values as 0."""
    return f"""
    select provider, key, count(*) as count, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std,
           min(v) as min, max(v) as max
    from (select r.provider, k.key, coalesce(e.v, 0) as v
          from runs r join (select distinct provider, key from {entries}) k on r.provider = k.provider
          left join {entries} e on e.event_id = r.event_id and e.key = k.key
          where r.{has})
    group by provider, key"""


ORACLES["timing_key_stats"] = _with(_filled("timing_entries", "has_timings"), *_NAMED_RUNS, "timing_entries")
ORACLES["sink_aggregate_json"] = ORACLES["timing_key_stats"]

ORACLES["sink_comparison_csv"] = _with(
    """
    select benchmark, metric, round(base_mean, 6) as aws_mean, round(base_std, 6) as aws_std,
           round(cand_mean, 6) as gcp_mean, round(cand_std, 6) as gcp_std,
           round(difference_pct, 6) as difference_pct, winner
    from compared""",
    *_COMPARED,
)


def _side(name: str) -> str:
    mean, std = f"{name}_mean", f"{name}_std"
    return f"""
    case when metric like '%Cost%' then concat('$', {_text(mean, 4)}, ' ± $', {_text(std, 4)})
         else concat({_text(mean, 2)}, ' ± ', {_text(std, 2)}, 's') end"""


ORACLES["sink_report_lines"] = _with(
    f"""
    select '| Benchmark | Metric | AWS (Mean ± Std) | GCP (Mean ± Std) | Difference | Winner |' as line
    union all
    select '|-----------|--------|------------------|------------------|------------|--------|'
    union all
    select concat('| ', benchmark, ' | ', metric, ' | ', {_side("base")}, ' | ', {_side("cand")}, ' | ',
                  {_text("difference_pct", 1, "+")}, '% | **', winner, '** |')
    from compared
    union all values (''), ('## Summary'), ('')
    union all select concat('- AWS Wins: ', count(*) filter (where winner = 'AWS')) from compared
    union all select concat('- GCP Wins: ', count(*) filter (where winner = 'GCP')) from compared
    union all select concat('- Ties: ', count(*) filter (where winner = 'Tie')) from compared""",
    *_COMPARED,
)

# Rows

ORACLES["filter_category_in"] = _with(
    """select * from facts where "EXP_TYPE" in ('1-URGENT', '5-LOW')""", "facts"
)
ORACLES["filter_conjunctive"] = _with(
    """select * from facts where "EXP_TYPE" = '1-URGENT' and "AMOUNT" > 300000 and "YEAR" in (1996, 1997)""", "facts"
)
ORACLES["sample_fraction"] = _with(f"""select * from facts where {_hash_below.format('"TRANS_ID"', 0.5)}""", "facts")

ORACLES["assemble_features"] = ORACLES["assemble_wide_features"] = _with(
    f"select vec_id, label, cast(len(v) as int) as n, {_SUM} as feature_sum from embedded", "embedded"
)

ORACLES["normalise_pixels"] = f"""
    select vec_id, cast(p[1] as double) as first_pixel, cast(list_max(p) as double) as max_pixel,
           {_PLACED_SUM.format("cast(p as double[])")} as pixel_sum
    from (select vec_id, list_transform(cast(embedding as double[]),
                 lambda x: cast((cast(floor(abs(x) * 1000) as int) % 256) / 255.0::double as float)) as p
          from embeddings)"""

ORACLES["flatten_to_columns"] = _with(
    "select vec_id, label, "
    + ", ".join(f"v[{i + 1}] as pixel{i}" for i in range(EMBEDDING_SIZE))
    + " from embedded",
    "embedded",
)

ORACLES["throughput"] = f"""
    select l_orderkey, l_linenumber, l_partkey, {_exact("mb", 2)} as file_size_mb,
           {_exact("s", 3)} as duration_seconds, {_exact("rate", 2)} as throughput_mbps
    from (select *, case when s > 0 then mb / s else 0::double end as rate
          from (select *, l_quantity * 1000000 / 1048576 as mb, l_tax * 100 as s from lineitem))"""

ORACLES["time_units"] = f"""
    select event_id, s / 3600 as hours, s / 60 as minutes, s / 3600 / 730 as months, unit,
           concat({_text("shown", 2)}, ' ', unit) as duration_text
    from (select *, case unit when 'seconds' then s when 'minutes' then s / 60 else s / 3600 end as shown
          from (select *, case when s < 60 then 'seconds' when s < 3600 then 'minutes' else 'hours' end as unit
                from (select event_id, value * 100 as s from events)))"""

ORACLES["pct_difference"] = _with("select * from differences", "two_rates", "differences")
ORACLES["winner_flag"] = _with(
    """
    select l_orderkey, l_linenumber, l_partkey, base, candidate,
           case when difference_pct > 0 then 'aws' when difference_pct < 0 then 'gcp' else 'Tie' end as winner
    from differences""",
    "two_rates",
    "differences",
)

ORACLES["parse_experiment_id"] = _with(
    """
    select event_id, experiment_id, benchmark as kind, provider as arm, case when user_id % 4 <> 0 then mode end as mode,
           cast(user_id % 20 + 1 as int) as run, strftime(ts, '%Y%m%d_%H%M%S') as stamp
    from named""",
    "named",
)
ORACLES["normalise_arm"] = _with("select event_id, provider as arm from named", "named")

# Joins

ORACLES["join_customer_summary"] = _with(
    f"""
    select f.*, s.total_spent, s.total_transactions, s.total_spent / s.total_transactions as avg_transaction_amount
    from facts f join (select "CUST_ID", {_MONEY.format('"AMOUNT"')} as total_spent, count(*) as total_transactions
                       from facts group by "CUST_ID") s on f."CUST_ID" = s."CUST_ID" """,
    "facts",
)

ORACLES["pair_arms"] = _with(
    """
    select benchmark, metric, round(base_mean, 6) as base_mean, round(base_std, 6) as base_std,
           round(cand_mean, 6) as cand_mean, round(cand_std, 6) as cand_std
    from pairs""",
    *_COMPARED[:-1],
)

ORACLES["price_lookup_strict"] = _with(
    """
    select n.event_id, n.arm, n.item, p.unit_price
    from (select event_id, provider as arm,
                 case when provider = 'aws'
                      then case user_id % 3 when 0 then 'm4.large' when 1 then 'emr_fee_per_instance' else 's3_storage' end
                      else case user_id % 3 when 0 then 'n1-standard-2' when 1 then 'dataproc_fee_per_vcpu'
                                else 'gcs_storage' end end as item
          from named) n left join prices p on n.arm = p.arm and n.item = p.item""",
    "named",
    "prices",
)

# Aggregates


def _totals(key: str, total: str, count: str, average: str) -> str:
    money = _MONEY.format('"AMOUNT"')
    return _with(
        f'select "{key}", {money} as {total}, count(*) as "{count}", {money} / count(*) as {average} '
        f'from facts group by "{key}"',
        "facts",
    )


ORACLES["agg_by_customer"] = _totals("CUST_ID", "total_spent", "transaction_count", "avg_transaction")
ORACLES["agg_by_category"] = _totals("EXP_TYPE", "total_amount", "count", "avg_amount")
ORACLES["agg_monthly_trends"] = _with(
    f"""
    select "YEAR", "MONTH", {_MONEY.format('"AMOUNT"')} as monthly_total, count(*) as monthly_count
    from facts group by "YEAR", "MONTH" order by 1, 2""",
    "facts",
)
ORACLES["count_rows"] = "select count(*) as row_count from orders"

ORACLES["describe_by_arm"] = _with(
    f"""
    select provider, count(total_time) as time_n, {_SPREAD.format("time", "total_time")},
           count(total_cost) as cost_n, {_SPREAD.format("cost", "total_cost")}
    from totals group by provider""",
    "named",
    "totals",
)


def _paired_stats(by: str, value: str, source: str, name: str, *ctes: str) -> str:
    """Spread per arm, both arms side by side, and the difference of their means."""
    sides = ", ".join(
        f"{letter}.n as {side}_{name}_n, round({letter}.mean, 6) as {side}_{name}_mean, "
        f"round({letter}.std, 6) as {side}_{name}_std, {letter}.lo as {side}_{name}_min, {letter}.hi as {side}_{name}_max"
        for letter, side in (("a", "base"), ("g", "cand"))
    )
    keys = by.split(", ")
    stats = f"""select provider, {by}, count({value}) as n, avg({value}) as mean, stddev_pop({value}) as std,
                       min({value}) as lo, max({value}) as hi from {source} group by provider, {by}"""
    return _with(
        f"""
        select {", ".join("a." + key for key in keys)}, {sides},
               round((g.mean - a.mean) / a.mean * 100, 6) as difference_pct
        from ({stats}) a join ({stats}) g on {" and ".join(f"a.{key} = g.{key}" for key in keys)}
        where a.provider = 'aws' and g.provider = 'gcp'""",
        *ctes,
    )


_CTES["operations"] = f"""
    select provider, operation,
           case operation when 'upload' then 1 when 'download' then 2 when 'sequential_read' then 3 else 4 end
               as order_col,
           {_OP_STATS}
    from rates group by provider, record_id, operation"""
ORACLES["storage_stats_by_op"] = _paired_stats(
    "operation, order_col", "avg_duration_seconds", "operations", "duration", "tests", "rates", "operations"
)

_CTES["metric_rows"] = """
    select provider, 'accuracy' as metric, accuracy as score from metrics
    union all select provider, 'f1_score', f1_score from metrics"""
ORACLES["ml_metrics_by_arm"] = _paired_stats(
    "metric", "score", "metric_rows", "score", "named", "metrics", "metric_rows"
)

ORACLES["timing_key_stats_present"] = _with(
    """
    select provider, key, count(*) as count, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std,
           min(v) as min, max(v) as max
    from timing_entries group by provider, key""",
    *_NAMED_RUNS,
    "timing_entries",
)

_CTES["all_costs"] = """
    select event_id, provider, key, v from cost_entries
    union all select event_id, provider, 'total', total_recorded from run_costs where has_costs"""
ORACLES["cost_key_stats"] = _with(
    _filled("all_costs", "has_costs"), *_NAMED_RUNS, "cost_entries", "run_costs", "all_costs"
)

ORACLES["run_total_cost"] = _with(
    "select event_id, total_recorded, total_net from run_costs", *_NAMED_RUNS, "run_costs"
)
ORACLES["run_success_counts"] = _with(
    """
    select provider, benchmark, count(*) as num_runs, count(*) filter (where success) as successful_runs,
           count(*) filter (where not success) as failed_runs
    from runs group by provider, benchmark""",
    *_NAMED_RUNS,
)

_RATE = "successful::double / operations * 100"
ORACLES["suite_success_rate"] = f"""
    select user_id, operations, successful, {_exact(_RATE, 2)} as success_rate
    from (select user_id, count(*) as operations, count(*) filter (where event_type <> 'error') as successful
          from events group by user_id)"""

ORACLES["storage_test_summary"] = _with(
    f"select operation, {_OP_STATS} from rates group by operation", "tests", "rates"
)
ORACLES["win_tally"] = _with(
    """
    select count(*) filter (where winner = 'AWS') as base_wins, count(*) filter (where winner = 'GCP') as candidate_wins,
           count(*) filter (where winner = 'Tie') as ties
    from compared""",
    *_COMPARED,
)

# Order

ORACLES["sort_amount_desc"] = _with("""select * from facts order by "AMOUNT" desc, "TRANS_ID" """, "facts")
ORACLES["preview_top_n"] = _with("""select * from facts order by "AMOUNT" desc, "TRANS_ID" limit 5""", "facts")

# Cost model


def _cluster(charged_vcpus: int) -> str:
    """Cluster cost of all runs, the fee of either arm charged for so many vCPUs a node."""
    return _with(
        f"""
        select event_id, arm, vm * h as master_vm, fee * h as master_fee, vm * h * 2 as worker_vm,
               fee * h * 2 as worker_fee, ((vm * h + fee * h) + vm * h * 2) + fee * h * 2 as total_compute
        from (select event_id, n.provider as arm, value / 3600 as h,
                     case n.provider when 'aws' then 0.10::double else 0.095::double end as vm,
                     case n.provider when 'aws' then 0.03::double else 0.010::double end * {charged_vcpus} as fee
              from named n)""",
        "named",
    )


ORACLES["cluster_cost_per_node_fee"] = _cluster(1)
ORACLES["cluster_cost_per_vcpu_fee"] = _cluster(4)
_COSTED = ("named", "arm_rates", "costed")
ORACLES["storage_cost"] = _with(
    "select event_id, arm, storage_rate * value * (cast(user_id % 48 as double) / 730) as storage from costed", *_COSTED
)
ORACLES["experiment_cost"] = _with(
    """
    select event_id, arm, master_vm, master_fee, worker_vm, worker_fee, total_compute, storage,
           total_compute + storage as total
    from (select *, storage_rate * 0.5::double * (24::double / 730) as storage from costed)""",
    *_COSTED,
)
ORACLES["hourly_rate"] = _with(
    """
    select n.arm, workers, runs, ((vm + fee) + vm * workers) + fee * workers as hourly_rate
    from (select provider as arm, cast(user_id % 5 + 1 as int) as workers, count(*) as runs
          from named group by 1, 2) n join arm_rates r on n.arm = r.arm""",
    "named",
    "arm_rates",
)
ORACLES["cost_by_dataset_mode"] = _with(
    """
    select event_id, arm, mode, cluster_seconds, total_compute, storage, total_compute + storage as total
    from (select event_id, r.arm, mode, cluster_seconds,
                 ((vm * h + fee * h) + vm * h * 2) + fee * h * 2 as total_compute,
                 storage_rate * gb * (24::double / 730) as storage
          from (select *, cluster_seconds / 3600 as h from
                    (select *, case when user_id % 2 = 0 then 0::double else 180::double end + value as cluster_seconds,
                            case mode when 'sample' then 0.08::double when 'large' then 5::double else 21::double end as gb
                     from named)) n
          join arm_rates r on n.provider = r.arm)""",
    "named",
    "arm_rates",
)

# Machine learning

ORACLES["mlp_train"] = f"""
    select count(*) as training_rows, cast((64 + 1) * 32 + (32 + 1) * 16 + (16 + 1) * 10 as int) as weights,
           1 as objective_fell, '[64, 32, 16, 10]' as architecture
    from embeddings where {_hash_below.format("vec_id", 0.8)}"""
ORACLES["mlp_predict"] = f"""
    select vec_id, label, 1 as is_class from embeddings where not ({_hash_below.format("vec_id", 0.8)})"""
ORACLES["ml_result_record"] = """
    select 2 as epochs, '[64,32,16,10]' as architecture, 1 as in_bounds"""
ORACLES["accuracy"] = _with("select cast(hits as double) / n as accuracy, n from scored", "scored")
ORACLES["weighted_f1"] = _with("select weighted / n as f1_score, n from scored", "scored")

# Profiling


def _outcomes(*operations: tuple[str, str, str]) -> str:
    return _with(
        " union all ".join(
            f"select '{name}' as name, '{text}' as description, ({rows}) as result_rows, 1 as success"
            for name, text, rows in operations
        ),
        "facts",
    )


_GROUPS = """select count(*) from (select distinct {0} from facts)"""
ORACLES["profile_operation"] = _outcomes(
    ("agg_by_customer", "Totals of each customer", _GROUPS.format('"CUST_ID"'))
)
_SUITE = (
    (
        "filter_expense_type",
        "Rows of two categories",
        """select count(*) from facts where "EXP_TYPE" in ('1-URGENT', '5-LOW')""",
    ),
    (
        "filter_complex",
        "Rows of one category and two years above an amount",
        """select count(*) from facts where "EXP_TYPE" = '1-URGENT' and "AMOUNT" > 300000 and "YEAR" in (1996, 1997)""",
    ),
    ("agg_by_customer", "Sum, count and mean of each customer", _GROUPS.format('"CUST_ID"')),
    ("agg_by_expense_type", "Sum, count and mean of each category", _GROUPS.format('"EXP_TYPE"')),
    ("agg_monthly_trends", "Sum and count of each month, in order", _GROUPS.format('"YEAR", "MONTH"')),
    ("sort_by_amount_desc", "All rows, largest amount first", "select count(*) from facts"),
    (
        "join_customer_summary",
        "Each row beside the figures of its customer",
        """select count("CUST_ID") from facts""",
    ),
)
ORACLES["profile_suite"] = _outcomes(*_SUITE)
# Both repeats of the suite time each operation, the whole of it and the attempt.
ORACLES["profile_repeated"] = "select 'local' as provider, key, 2::bigint as count from (values {0}) as t(key)".format(
    ", ".join(f"('{name}')" for name in (*[entry[0] for entry in _SUITE], "benchmark_execution", "total_time"))
)
ORACLES["repeat_storage"] = """
    select 'aws' as provider, 'lineitem' as test_file, operation, tests::bigint as tests,
        0::bigint as failed, 2::bigint as runs
    from (values ('upload', 2), ('download', 2), ('sequential_read', 2), ('write', 4)) as t(operation, tests)
    where (select count(*) from lineitem) > 0"""
ORACLES["repeat_training"] = """
    select 'gcp' as provider, 'embeddings' as dataset, '64,32,16,10' as layers, 2::bigint as scored,
        2::bigint as num_runs, 2::bigint as successful_runs, 0::bigint as failed_runs
    where (select count(*) from embeddings) > 0"""
ORACLES["table_io_profile"] = """
    select operation, n as result_rows
    from (values ('write'), ('sequential_read')) as t(operation), (select count(*) as n from lineitem)"""
ORACLES["compare_arms"] = _with(
    """
    select benchmark, metric, round(base_mean, 6) as base_mean, round(base_std, 6) as base_std,
           round(cand_mean, 6) as cand_mean, round(cand_std, 6) as cand_std,
           round(difference_pct, 6) as difference_pct, winner
    from compared""",
    *_COMPARED,
)
