"""Queries of schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators.hierarchy import hierarchy
from .tables import Values, table

QUERIES: dict = {}
ORACLES: dict = {}
COLUMNS = "schema_name string,table_name string,column_name string,column_order int,data_type string,data_type_with_size string,is_nullable string,is_unique string,table_type string"


def _columns(version: int) -> Values:
    """Columns of the star schema: version 2 drops region, adds events, and changes some of part and orders."""
    tables = {
        "region": ["r_regionkey:int", "r_name:string"], "nation": ["n_nationkey:int", "n_name:string", "n_regionkey:int"], "part": ["p_partkey:bigint", "p_name:string", "p_size:int"],
        "orders": ["o_orderkey:bigint", "o_custkey:bigint", "o_totalprice:double"], "events": ["event_id:bigint", "ts:timestamp"],
    }
    if version == 2:
        tables["part"] = ["p_partkey:bigint", "p_name:varchar(55)", "p_type:string"]
        tables["orders"] = ["o_custkey:bigint", "o_orderkey:bigint", "o_totalprice:double"]
        tables["nation"][1] = "n_name:STRING"  # case alone: the hash differs, the property doesn't
        del tables["region"]
    else:
        del tables["events"]
    return Values(COLUMNS, [("dbo", t, c.split(":")[0], i, c.split(":")[1].split("(")[0], c.split(":")[1], "YES", "YES" if i == 1 else "NO", "BASE TABLE") for t, cs in tables.items() for i, c in enumerate(cs, 1)])


OLD, NEW = _columns(1), _columns(2)
PROPERTIES = [c.split(" ")[0] for c in COLUMNS.split(",")]
HASH = "sha256(concat(schema_name, table_name, column_name, column_order, data_type, data_type_with_size, is_nullable, is_unique, table_type))"
SNAP = "(select *, concat('[', schema_name, '].[', table_name, '].[', column_name, ']') as f, " + HASH + " as h from {0} z)"
DIFFS = ", ".join(f"case when lower(n.{p}::varchar) is distinct from lower(o.{p}::varchar) then '{p}' end" for p in PROPERTIES)
DIFF = f"""(select coalesce(n.f, o.f) as FullFieldName, case when n.f is null then 'Deleted' when o.f is null then 'Added' when n.h <> o.h then 'Changed' else 'Unchanged' end as Action,
 coalesce(n.h, 'Missing') as SHA256Hash_from_n, coalesce(o.h, 'Missing') as SHA256Hash_from_n_minus_1, case when n.f is not null and o.f is not null and n.h <> o.h then '[' || concat_ws('], [', 'SHA256Hash', {DIFFS}) || ']' end as ChangedColumns
 from {SNAP.format(NEW.sql)} n full join {SNAP.format(OLD.sql)} o on n.f = o.f)"""


def diff(spark, sf_dir=None):
    return D.diff(D.snapshot(NEW.frame(spark)), D.snapshot(OLD.frame(spark)), PROPERTIES)


TABLE = r"regexp_extract(FullFieldName, '^(.*)\.\[[^\]]*\]$', 1)"
PART = r"regexp_extract(FullFieldName, '\[([^\]]*)\]$', 1)"
TABLES = f"""(select {TABLE} as FullTableName, case when bool_and(Action = 'Added') then 'Added' when bool_and(Action = 'Deleted') then 'Deleted' when bool_and(Action = 'Unchanged') then 'Unchanged' else 'Changed' end as ChangeType,
 coalesce(string_agg(case when Action = 'Changed' then {PART} end, ', ' order by FullFieldName), 'N/A') as ChangedColumns from {DIFF} d group by 1)"""
KEYS = Values("schema_name string,table_name string,referenced_schema_name string,referenced_table_name string", [
    ("dbo", t, "<Primary Key>", "<Primary Key>") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "x", "y")
] + [("dbo", a, "dbo", b) for a, b in (("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("ext", "part"), ("emp", "emp"), ("x", "y"), ("y", "x"))])
PRIORITIES = Values("schema_name string,schema_priority int", [("dbo", 1)])
HIERARCHY = f"""with recursive k as (select schema_name || '.' || table_name as x, referenced_schema_name || '.' || referenced_table_name as y, referenced_schema_name as rs from {KEYS.sql} z),
 edges as (select distinct x as child, y as parent from k where rs <> '<Primary Key>'), t as (select * from edges where child <> parent), loops as (select child as x from edges where child = parent),
 related as (select child as x from edges union select parent from edges), roots as (select distinct parent as x from t where parent not in (select child from t) and parent not in (select x from loops)),
 leaves as (select distinct child as x from t where child not in (select parent from t) and child not in (select x from loops)), near as (select x from leaves where x not in (select child from t where parent not in (select x from roots))),
 g as (select * from t where parent not in (select x from roots)), reach as (select parent as a, child as b from g union select r.a, g.child from reach r join g on g.parent = r.b), bad as (select b as x from reach where a in (select a from reach where a = b)),
 walk as (select parent as x, 1 as n from g where parent not in (select child from g) union select g.child, w.n + 1 from walk w join g on g.parent = w.x where g.child not in (select x from bad)),
 placed as (select distinct x, -1 as section_level, null::double as table_level from k where rs is not null and x not in (select x from related) union all select x, 1, null from roots union all select x, 2, null from near
 union all select x, 999, null from leaves where x not in (select x from near) union all select x, 3, max(n)::double from walk where x in (select parent from g) group by 1),
 missed as (select x, dense_rank() over (order by x) as id from (select x from related union select x from k where rs is not null) m where x not in (select x from placed) and x in (select parent from edges)),
 rest as (select x, 4 as section_level, dense_rank() over (order by level nulls first)::double as table_level from missed left join (select child as x, max(id) + 1 as level from edges join missed on missed.x = parent group by 1) u using (x))
 select split_part(x, '.', 2) as table_name, section_level, table_level, dense_rank() over (order by section_level nulls first, table_level nulls first, schema_priority nulls first)::int as Hierarchy
 from (select * from placed union all select * from rest) p left join {PRIORITIES.sql} s on s.schema_name = split_part(x, '.', 1)"""

CATALOG = {
    "columns": Values("table_schema string,table_name string,column_name string,ordinal_position int,data_type string,character_maximum_length int,numeric_precision int,numeric_scale int,is_nullable string", [
        ("dbo", "orders", "o_id", 1, "bigint", None, 19, 0, "NO"), ("dbo", "orders", "o_cust", 2, "int", None, 10, 0, "YES"), ("dbo", "orders", "o_price", 3, "decimal", None, 15, 2, "YES"), ("dbo", "orders", "o_note", 4, "varchar", -1, None, None, "YES"),
        ("dbo", "cust", "c_id", 1, "int", None, 10, 0, "NO"), ("dbo", "cust", "c_name", 2, "varchar", 25, None, None, "YES"), ("dbo", "line", "l_order", 1, "bigint", None, 19, 0, "NO"), ("dbo", "line", "l_no", 2, "int", None, 10, 0, "NO"),
        ("dbo", "item", "i_order", 1, "bigint", None, 19, 0, "NO"), ("dbo", "item", "i_no", 2, "int", None, 10, 0, "NO"), ("ext", "cust", "c_id", 1, "int", None, 10, 0, "NO"),
    ]),
    "constraints": Values("constraint_name string,table_schema string,table_name string,constraint_type string", [
        ("pk_o", "dbo", "orders", "PRIMARY KEY"), ("pk_c", "dbo", "cust", "PRIMARY KEY"), ("pk_l", "dbo", "line", "PRIMARY KEY"), ("fk_oc", "dbo", "orders", "FOREIGN KEY"), ("fk_lo", "dbo", "line", "FOREIGN KEY"), ("fk_il", "dbo", "item", "FOREIGN KEY"), ("u_c", "dbo", "cust", "UNIQUE"),
    ]),
    "usage": Values("constraint_name string,table_schema string,table_name string,column_name string,ordinal_position int,position_in_unique_constraint int", [
        ("pk_o", "dbo", "orders", "o_id", 1, None), ("pk_c", "dbo", "cust", "c_id", 1, None), ("pk_l", "dbo", "line", "l_order", 1, None), ("pk_l", "dbo", "line", "l_no", 2, None), ("fk_oc", "dbo", "orders", "o_cust", 1, 1),
        ("fk_lo", "dbo", "line", "l_order", 1, 1), ("fk_il", "dbo", "item", "i_order", 1, 1), ("fk_il", "dbo", "item", "i_no", 2, 2), ("u_c", "dbo", "cust", "c_name", 1, None),
    ]),
    "references": Values("constraint_name string,unique_constraint_name string", [("fk_oc", "pk_c"), ("fk_lo", "pk_o"), ("fk_il", "pk_l")]),
}


def catalog(spark):
    return D.catalog_records(*(CATALOG[n].frame(spark) for n in ("columns", "constraints", "usage", "references")))


QUERIES |= {
    "drift_catalog": lambda s, d: catalog(s),
    "drift_hash": lambda s, d: D.snapshot(NEW.frame(s)).select("FullFieldName", "SHA256Hash"),
    "drift_diff": lambda s, d: diff(s).select("FullFieldName", "Action", "SHA256Hash_from_n", "SHA256Hash_from_n_minus_1", "ChangedColumns"),
    "drift_classify": lambda s, d: D.classify(diff(s)).select("FullTableName", "SchemaName", "TableName", "ChangeType", "ChangedColumns"),
    "drift_summary": lambda s, d: D.summary(diff(s), D.classify(diff(s))),
    "drift_spark_schema": lambda s, d: D.snapshot(D.columns_of(s, table(s, d, "nation").schema, "tpch", "nation", ("n_nationkey",))).select("FullFieldName", "column_order", "data_type", "data_type_with_size", "is_unique"),
    "fk_hierarchy": lambda s, d: hierarchy(KEYS.frame(s), PRIORITIES.frame(s)).select("table_name", "section_level", "table_level", F.col("Hierarchy")),
}
_key = "select u.* from {u} u join {c} c using (constraint_name) where c.constraint_type = 'PRIMARY KEY'".format(u=CATALOG["usage"].sql, c=CATALOG["constraints"].sql)
_to = f"""select f.table_schema, f.table_name, f.column_name, f.constraint_name as foreign_key_name, p.table_schema as rs, p.table_name as rt, p.column_name as rc
 from {CATALOG["references"].sql} r join {CATALOG["usage"].sql} f on f.constraint_name = r.constraint_name join {CATALOG["usage"].sql} p on p.constraint_name = r.unique_constraint_name and p.ordinal_position = f.position_in_unique_constraint"""
_is = "exists (select 1 from ({0}) k where k.table_schema = c.table_schema and k.table_name = c.table_name and k.column_name = c.column_name)".format(_key)
ORACLES |= {
    "drift_catalog": f"""select c.table_schema as schema_name, c.table_name, c.column_name, c.ordinal_position as column_order, c.data_type,
 c.data_type || case when c.data_type = 'varchar' then '(' || case when character_maximum_length = -1 then 'max' else character_maximum_length::varchar end || ')' when c.data_type = 'decimal' then '(' || numeric_precision || ',' || numeric_scale || ')' else '' end as data_type_with_size,
 c.is_nullable, case when {_is} then 'YES' else 'NO' end as is_unique, 'USER_TABLE' as table_type, coalesce(rs, case when {_is} then '<Primary Key>' end) as referenced_schema_name, coalesce(rt, case when {_is} then '<Primary Key>' end) as referenced_table_name,
 coalesce(rc, case when {_is} then '<Primary Key>' end) as referenced_column_name, foreign_key_name
 from {CATALOG["columns"].sql} c left join ({_to}) f on f.table_schema = c.table_schema and f.table_name = c.table_name and f.column_name = c.column_name""",
    "drift_hash": f"select f as FullFieldName, h as SHA256Hash from {SNAP.format(NEW.sql)} n",
    "drift_diff": f"select * from {DIFF} d",
    "drift_classify": f"select FullTableName, 'dbo' as SchemaName, {PART.replace('FullFieldName', 'FullTableName')} as TableName, ChangeType, ChangedColumns from {TABLES} t",
    "drift_summary": " union all ".join(f"select 'Table {k}' as Action, '<Not Applicable>' as TableName, '<Not Applicable>' as ColumnName, count(*) as Statistics from {TABLES} t where ChangeType = '{k}'" for k in ("Added", "Deleted", "Changed", "Unchanged"))
    + "".join(f" union all select 'Columns {k}', FullTableName, '<Not Applicable>', count(*) filter (Action = '{k}') from {DIFF} d join {TABLES} t on {TABLE} = t.FullTableName where ChangeType not in ('Added', 'Deleted') group by 2" + (" having count(*) filter (Action = 'Unchanged') > 0" if k == "Unchanged" else "") for k in ("Added", "Deleted", "Changed", "Unchanged"))
    + f" union all select 'Columns Changed', {TABLE}, {PART}, len(string_split(d.ChangedColumns, ',')) from {DIFF} d join {TABLES} t on {TABLE} = t.FullTableName where Action = 'Changed' and ChangeType not in ('Added', 'Deleted')",
    "drift_spark_schema": """select '[tpch].[nation].[' || column_name || ']' as FullFieldName, i as column_order, case column_type when 'INTEGER' then 'integer' when 'BIGINT' then 'long' when 'VARCHAR' then 'string' end as data_type,
 case column_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' end as data_type_with_size, case when column_name = 'n_nationkey' then 'YES' else 'NO' end as is_unique from (select *, (row_number() over ())::int as i from (describe select * from nation)) d""",
    "fk_hierarchy": HIERARCHY,
}
