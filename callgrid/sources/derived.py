"""Call-centre shaped views over the test tables, as SQL that Spark and DuckDB both read.

``view(spark, sf_dir, name)`` gives a DataFrame; ``with_views(sql, dialect)`` prefixes a query with the
CTEs that it names. Where the dialects differ (integer division, microseconds), placeholders are filled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

#: Calendar point that stands for "now" in queries over the views.
AS_OF = "2024-01-30 00:00:00"

_MARKS = {
    "spark": {"US(": "unix_micros(", "DIV": " div ", "TS(": "timestamp(", "LEN(": "length("},
    "duckdb": {"US(": "epoch_us(", "DIV": "//", "TS(": "(", "LEN(": "length("},
}

VIEWS = {
    # 30 days of events are scaled to about 400 seconds of call time
    "v_event_ms": "select event_id, user_id, event_type, value, US(TS(ts)) us, (US(TS(ts)) - 1704067200000000) DIV 6480000 start_ms from events",
    "v_calls": """select concat('org-', cast(n.n_regionkey as varchar(9))) organisation_id, o.o_orderkey call_id,
        concat('agent-', cast(o.o_custkey as varchar(20))) agent_id, concat('team-', cast(n.n_nationkey as varchar(9))) team_id,
        o.o_orderdate created_at, cast(1 + o.o_orderkey % 2 as int) transcript_revision,
        case when o.o_orderkey % 37 = 0 then o.o_orderdate end tombstoned_at,
        case o.o_orderstatus when 'F' then 'READY' when 'O' then 'QUEUED' else 'NEEDS_REVIEW' end processing_state
        from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey""",
    "v_audits": """select l_orderkey call_id, l_linenumber revision, l_orderkey * 10 + l_linenumber audit_id,
        cast(1 + (l_orderkey + max(l_linenumber)) % 2 as int) transcript_revision,
        concat('rubric-v', cast(1 + max(l_suppkey) % 2 as varchar(9))) rubric_version, concat('model-', cast(max(l_partkey) % 2 as varchar(9))) model_artifact,
        case when max(l_quantity) % 10 = 0 then null else cast(1 + (max(l_quantity) * 7 % 401) / 100 as decimal(4,2)) end overall_score,
        case max(l_returnflag) when 'A' then 'PASS' when 'N' then 'FAIL' else 'NEEDS_REVIEW' end decision
        from lineitem group by l_orderkey, l_linenumber""",
    "v_reviews": """select l_orderkey call_id, l_orderkey * 10 + l_linenumber audit_id,
        cast(row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) version,
        case when l_quantity < 10 then 'TRIAGE' when l_quantity < 30 then 'OVERRIDE' else 'ACCEPT' end action,
        case when l_quantity < 10 then null else cast(1 + (l_quantity * 13 % 401) / 100 as decimal(4,2)) end effective_score,
        case when l_quantity < 10 then 'NEEDS_REVIEW' when l_quantity < 20 then 'FAIL' else 'PASS' end effective_decision
        from lineitem where l_discount > 0.02""",
    "v_findings": """select l_orderkey call_id, cast(1 + (l_orderkey + l_linenumber) % 2 as int) transcript_revision, p_type rule_id,
        concat('v', cast(max(p_size) % 3 as varchar(9))) ruleset_version,
        case max(l_returnflag) when 'A' then 'SATISFIED' when 'N' then 'UNKNOWN' else 'POTENTIAL_VIOLATION' end status,
        case max(p_size) % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end severity,
        max(p_name) remediation, cast(max(l_linenumber) as int) deadline_ms
        from lineitem join part on p_partkey = l_partkey group by l_orderkey, cast(1 + (l_orderkey + l_linenumber) % 2 as int), p_type""",
    "v_jobs": """select event_id job_id, 1 + event_id % 1000 call_id, cast(event_id % 4 as int) attempts,
        case event_type when 'view' then 'QUEUED' when 'click' then 'RUNNING' when 'signup' then 'RETRY_WAIT' when 'purchase' then 'DONE' else 'FAILED' end state,
        case cast(event_id % 3 as int) when 0 then 'TRANSCRIBE' when 1 then 'ANALYSE' else 'POLICY' end stage, us available_us, us + 300000000 lease_us from v_event_ms""",
    "v_scores": """select o_orderkey call_id, dim, case when (o_orderkey * 7 + dim) % 41 = 0 then null else cast(1 + (o_orderkey * 11 + dim * dim * 3) % 5 as int) end score,
        dim = 6 and o_orderkey % 3 = 0 not_applicable from orders cross join (select 1 dim union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) d""",
    "v_signals": "select user_id call_id, event_id signal_id, start_ms, cast(event_id * 7919 % 201 - 100 as int) score_c, cast(55 + event_id * 31 % 41 as int) prob_c, cast(1000 + event_id % 9000 as int) dur from v_event_ms where event_type <> 'error'",
    "v_intervals": "select user_id call_id, start_ms, start_ms + event_id % 20000 end_ms, case when event_id % 2 = 0 then 'HOLD' else 'IVR' end tag from v_event_ms",
    "v_chunks": "select event_id DIV 3 call_id, cast(event_id % 3 as int) chunk, cast(40 + cast(floor(value) as int) % 60 as int) p100, cast(50 + event_id * 13 % 50 as int) conf100 from v_event_ms",
    "v_choices": """select event_id DIV 3 call_id, cast(event_id % 3 as int) chunk, cast(event_id * 7 % 101 as int) a100, cast((100 - event_id * 7 % 101) * (event_id % 11) DIV 10 as int) b100, cast(40 + event_id % 60 as int) conf100 from v_event_ms""",
    "v_gold": "select d.doc_id case_id, concat('rule_', lang) rule_id, toxic = 1 critical from labels l join documents d on d.doc_id = l.doc_id where quality = 0",
    "v_predicted": "select d.doc_id case_id, concat('rule_', lang) rule_id from labels l join documents d on d.doc_id = l.doc_id where n_chars % 3 = 0",
    "v_cases": "select l.doc_id case_id, l.doc_id % 13 = 0 excluded, l.doc_id % 7 = 0 abstained, cast(1 + l.doc_id % 5 as int) gold, case when l.doc_id % 4 = 0 then null else cast(1 + (l.doc_id * 3 + toxic) % 5 as int) end predicted from labels l",
    "v_utterances": """select conv_id call_id, cast(turn as int) turn, case role when 'assistant' then 'AGENT' when 'user' then 'CUSTOMER' else 'IVR' end role, text,
        cast(coalesce(sum(length(text) * 60) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) start_ms,
        cast(sum(length(text) * 60) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) end_ms from conversations""",
    "v_contexts": """select call_id, max(end_ms) + call_id % 5000 duration_ms, (call_id * 37) % 3000 connected_ms, call_id % 11 <> 0 complete, call_id % 13 <> 0 timing_reliable,
        (call_id * 53) % 9000 hold_start, (call_id * 53) % 9000 + (call_id * 17) % 8000 hold_end from v_utterances group by call_id""",
    "v_sessions": """select concat('org-', cast(user_id % 3 as varchar(9))) organisation_id, user_id session_id, concat('agent-', cast(user_id % 10 as varchar(9))) agent_id, concat('team-', cast(user_id % 4 as varchar(9))) team_id,
        case event_type when 'view' then 'LIVE' when 'click' then 'DRAINING' when 'signup' then 'ENDED' when 'purchase' then 'INCOMPLETE' else 'LIVE' end state,
        us updated_us, user_id % 17 = 0 purged from (select *, row_number() over (partition by user_id order by us desc, event_id desc) rn from v_event_ms) x where rn = 1""",
    "v_log": "select concat('org-', cast(user_id % 3 as varchar(9))) organisation_id, cast(row_number() over (partition by user_id % 3 order by us, event_id) as bigint) sequence, user_id call_id, concat('agent-', cast(user_id % 10 as varchar(9))) agent_id, concat('team-', cast(user_id % 4 as varchar(9))) team_id, us, event_type from v_event_ms",
    "v_frames": "select user_id session_id, event_id, cast(1 + (us DIV 60000000) % 43200 as bigint) sequence, cast(160 + event_id % 5 * 16 as int) bytes, us from v_event_ms",
    "v_versions": """select concat('cfg-', cast(s_nationkey as varchar(9))) config_id, cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) version, s_suppkey actor from supplier""",
    "v_config_events": """select concat('cfg-', cast(s_nationkey as varchar(9))) config_id, cast(1 + s_suppkey % 4 as int) version, case when s_suppkey % 3 = 0 then 'APPROVED' when s_suppkey % 3 = 1 then 'ACTIVATED' else 'STAGED' end action,
        s_suppkey % 7 actor, s_suppkey at_ from supplier""",
    "v_memberships": """select concat('user-', cast(c_custkey % 400 as varchar(9))) subject, concat('org-', cast(c_nationkey % 2 as varchar(9))) organisation_id, concat('id-', cast(c_custkey % 400 as varchar(9))) user_id,
        case when c_custkey % 4 < 2 then 'AGENT' when c_custkey % 4 = 2 then 'TEAM_LEADER' else 'QA_ANALYST' end role, case when c_custkey % 5 = 0 then null else concat('team-', cast(c_nationkey as varchar(9))) end team_id, c_custkey % 3 <> 0 is_active from customer""",
}


def _fill(sql: str, dialect: str) -> str:
    for mark, text in _MARKS[dialect].items():
        sql = re.sub(r"\bDIV\b", text.strip(), sql) if mark == "DIV" else sql.replace(mark, text)
    return sql


def _needed(sql: str) -> list[str]:
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str, dialect: str = "duckdb") -> str:
    """The query with the CTEs of all views it names, in the dialect."""
    ctes = [f"{name} as ({VIEWS[name]})" for name in _needed(sql)]
    sql = sql.strip()
    if not ctes:
        return _fill(sql, dialect)
    head = ", ".join(ctes)
    if sql.lower().startswith("with recursive"):
        return _fill(f"with recursive {head}, {sql[len('with recursive'):]}", dialect)
    if sql.lower().startswith("with "):
        return _fill(f"with {head}, {sql[len('with'):]}", dialect)
    return _fill(f"with {head} {sql}", dialect)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"select * from {name}", "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)
