"""The tracker model's tables as views of the driver tables. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_users": "select c_custkey as id, c_name as name, case c_mktsegment when 'AUTOMOBILE' then 'ADMIN' when 'BUILDING' then 'ENGAGEMENT_MANAGER' when 'FURNITURE' then 'PROJECT_LEAD' when 'HOUSEHOLD' then 'PMO_REVIEWER' else 'FINANCE_COMMERCIAL' end as role from customer",
    "v_projects": "select n_nationkey as id, n_name as project_name from nation",
    "v_project_users": "select c_nationkey as project_id, c_custkey as user_id from customer",
    "v_documents": "select doc_id as id, cast(substr(source, 4) as int) as project_id, case doc_id % 4 when 0 then 'EL' when 1 then 'IFA' when 2 then 'STATUS_REPORT' else 'MOM' end as document_type, source as document_name, text from documents",
    "v_activities": "select o_orderkey as id, o_orderpriority as activity_name, o_orderstatus as activity_status from orders",
    "v_requests": "select p_partkey as id, p_name as request_name from part",
    "v_tracker": "select case when l_returnflag = 'A' then 'ACTIVITY' else 'NEW_REQUEST' end as item_type, case when l_returnflag = 'A' then l_orderkey else l_partkey end as reference_id, round(l_discount * 10, 4) as risk_score, l_suppkey % 20 as project_id, l_partkey as source_document_id, l_linestatus = 'O' as requires_escalation from lineitem",
    "v_baselines": "select o_custkey as project_id, o_orderkey as id, case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'DRAFT' else 'SUPERSEDED' end as status, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as version from orders",
    "v_events": "select user_id as project_id, event_id as id, ts as created_at, event_type, props as event_summary, value as importance_score from events",
    "v_stakeholders": "select s_suppkey % 20 as project_id, concat(lower(s_name), '@example.com') as email, case s_nationkey % 5 when 0 then 'ENGAGEMENT_MANAGER' when 1 then 'PROJECT_LEAD' when 2 then 'PMO_REVIEWER' when 3 then 'FINANCE_COMMERCIAL' else 'ADMIN' end as role from supplier",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its table is passed by argument, so that nothing is registered in the session."""
    text = VIEWS[name]
    held = re.search(r" from (\w+)$", text)[1]
    return spark.sql(re.sub(r" from \w+$", " from {held}", text), held=table(spark, sf_dir, held))


def with_views(sql: str) -> str:
    """SQL with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    own = [f"{v} as ({VIEWS[v]})" for v in used]
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join(own)}, {body[5:]}" if own else body
    return f"with {', '.join(own)} {body}" if own else body
