"""Queries of sheets and of mapping to canonical fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as M
from ..operators import sheets as H
from ..sources.paths import path_kind
from .tables import Values, table

QUERIES: dict = {}
ORACLES: dict = {}
HEADERS = Values("sheet string,idx int,header string", [
    ("a", 1, "[Order].[ID]"), ("a", 2, "[Customer].[ID]"), ("a", 3, "[Unit Price (%)]"), ("a", 4, "[Profit & Loss]"), ("a", 5, "[2024]"), ("a", 6, "[Unnamed]"), ("a", 7, "[Unnamed]"), ("a", 8, "[***]"),
    ("b", 1, "[ID]"), ("b", 2, "[Name]"), ("b", 3, "[A].[Name]"), ("b", 4, "[B].[Name]"), ("b", 5, "plain"),
])
COLUMNS = Values("sheet string,idx int,is_blank boolean", [("a", i, i in (5, 10)) for i in range(1, 14)] + [("b", i, i == 1) for i in range(1, 4)])
CELLS = Values("sheet string,row int,col int,value string,kind string", [
    *(("plain", 1, c, f"Head {c}", "text") for c in range(1, 5)), *(("plain", r, c, str(r * c), "number") for r in range(2, 6) for c in range(1, 5)),
    ("two", 2, 1, "Order", "text"), ("two", 2, 2, None, "text"), ("two", 2, 3, "Customer", "text"), ("two", 2, 4, "x", "text"), *(("two", 3, c, f"h{c}", "text") for c in range(1, 5)), *(("two", 4, c, "ORD-12" if c < 3 else "v", "text") for c in range(1, 5)),
    *(("text", r, c, "word", "text") for r in range(1, 31) for c in range(1, 4)), *(("data", r, c, "2024-01-01", "date") for r in range(1, 4) for c in range(1, 3)),
    ("gap", 1, 1, "A", "text"), ("gap", 1, 2, "B", "text"), ("gap", 3, 1, "x", "text"), ("gap", 3, 2, "y", "text"), ("head", 1, 1, "A", "text"), ("head", 1, 2, "B", "text"), ("empty", 1, 1, " ", "text"),
])
MERGES = Values("sheet string,min_row int,max_row int,min_col int,max_col int", [("two", 2, 2, 1, 2), ("two", 2, 2, 3, 4), ("plain", 1, 2, 1, 1)])
FIELDS = {"order_id": ["order id", "order number"], "customer_name": ["customer name", "client", "customer"], "amount": ["amount", "total price", "price"], "order_date": ["order date", "date"]}
ALIASES = [(f, i, a) for i, (f, names) in enumerate(FIELDS.items()) for a in names]
TO_MAP = Values("id int,header string,section string", [
    (1, "[Order].[Order ID]", None), (2, "[Customer Name]", "customer"), (3, "[Price]", None), (4, "[Order Date]", "date"), (5, "[Warehouse]", None), (6, "[Client Reference]", None), (7, "[Amount]", None), (8, "[Order]", "order"),
])
PRIOR = Values("header string,field string", [("[Amount]", "amount"), ("[Warehouse]", "order_id"), ("[Order].[Order ID]", "amount")])
SCORE = f"""(select t.id, t.header, a.field, a.ordinal, least(1.0, max(case when a.alias = t.leaf then 0.6 when contains(t.leaf, a.alias) or contains(a.alias, t.leaf) then 0.4 else 0.0 end)::double + max(case when t.section is not null and (contains(a.alias, t.section) or contains(t.section, a.alias)) then 0.2 else 0.0 end)::double
 + max(case when p.field is not null then 0.3 else 0.0 end)::double) as score from (select *, lower(regexp_extract(header, '\\[([^\\]]+)\\]$', 1)) as leaf from {TO_MAP.sql} z) t cross join {Values('field string,ordinal int,alias string', ALIASES).sql} a
 left join {PRIOR.sql} p on p.header = t.header and p.field = a.field group by 1, 2, 3, 4)"""
BEST = f"(select id, header, case when score > 0 then field end as field, score as confidence from (select *, row_number() over (partition by id order by score desc, ordinal) as r from {SCORE} s) x where r = 1)"
MAPPED = f"(select *, case when field is null then 'UNMAPPED' when confidence >= 0.9 then 'AUTO_APPROVED' when confidence >= 0.7 then 'NEEDS_REVIEW' else 'REQUIRES_HUMAN' end as status from {BEST} b)"
_level = "case when s = '' then 'col' when s[1] between '0' and '9' then 'col_' || s else s end"
NAMED = f"""(with found as (select *, case when regexp_matches(header, '\\[[^\\]]+\\]') then regexp_extract_all(header, '\\[([^\\]]+)\\]', 1) else [''] end as parts from {HEADERS.sql} h),
 split as (select sheet, idx, header, unnest(parts) as part, generate_subscripts(parts, 1) as i from found),
 plain as (select *, trim(regexp_replace(replace(replace(lower(part), '&', 'and'), '%', 'pct'), '[^a-z0-9]+', '_', 'g'), '_') as s from split),
 paths as (select sheet, idx, header, string_agg({_level}, '__' order by i) as path, arg_max({_level}, i) as leaf from plain group by 1, 2, 3),
 chosen as (select *, case when count(*) over (partition by sheet, leaf) > 1 then path else leaf end as name from paths)
 select sheet, idx, header, case when count(*) over (partition by sheet, name) > 1 then name || '_' || row_number() over (partition by sheet, name order by idx) else name end as bronze_name from chosen)"""
ZONES = f"""(with c as (select *, coalesce(trim(value) <> '', false) as filled from {CELLS.sql} z), w as (select sheet, max(col) as width, least(20, max(row)) as lim from c group by 1),
 p as (select c.sheet, c.row, count(*) filter (filled) < 0.3 * max(width) as thin, count(*) filter (filled and (kind in ('number', 'date') or (kind = 'text' and regexp_matches(trim(value), '^[A-Z]{{2,6}}-[A-Z0-9]{{2,}}', 'i')))) > 0.35 * count(*) filter (filled) as data from c join w on w.sheet = c.sheet where c.row <= lim group by 1, 2),
 f as (select sheet, min(row) as first from p where not thin group by 1),
 e as (select p.sheet, min(p.row) as stop from p join f on f.sheet = p.sheet where (not thin and data) or (p.row > first and (thin or (p.sheet, p.row - 1) not in (select (sheet, row) from p))) group by 1),
 h as (select p.sheet, p.row from p left join e on e.sheet = p.sheet where not thin and (stop is null or p.row < stop)),
 g as (select w.sheet, coalesce(bool_or(h.row = lim), false) as fell_back, string_agg(h.row::varchar, ',' order by h.row) as found, max(h.row) as bottom from w left join h on h.sheet = w.sheet group by 1)
 select sheet, case when fell_back or found is null then '1' else found end as header_rows, (1 + case when fell_back or found is null then 1 else bottom end)::int as data_start_row, fell_back from g)"""
IN_ZONE = "list_contains(string_split(header_rows, ','), c.row::varchar)"


def zones(s):
    return H.header_zone(CELLS.frame(s))


def mapped(s):
    return M.map_columns(TO_MAP.frame(s), M.dictionary(s, FIELDS), PRIOR.frame(s))


def hybrid(s, d):
    model = Values("id int,model_field string,model_confidence double", [(1, "order_id", 0.95), (5, "amount", 0.6), (6, "amount", 0.4)])
    return M.map_columns(TO_MAP.frame(s), M.dictionary(s, FIELDS), PRIOR.frame(s), lambda h: model.frame(s))


def combined(s, d):
    one = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    two = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    return H.combine([(one, "f1.xlsx", "n"), (two, "f2.xlsx", "r")], F.lit("2024-01-01 00:00:00").cast("timestamp"))


REPLIES = Values("id int,reply string", [
    (1, '{"canonical_field": "amount", "confidence": 0.8, "reasoning": "r"}'), (2, 'Sure! Here it is:\n```json\n{"canonical_field": "order_id", "confidence": "0.95"}\n``` Anything else?'), (3, '{"canonical_field": null, "confidence": 0.2}'),
    (4, "no idea"), (5, '{"canonical_field": "amount", "confidence": "high"}'), (6, None), (7, '{"canonical_field": "amount"}'), (8, '{"canonical_field": "amount", "confidence": 0.5'),
])


def map_replies(spark, sf_dir):
    """What is read of a language model's answers."""
    return REPLIES.frame(spark).select("id", M.reply(F.col("reply")).alias("r")).select("id", "r.field", "r.confidence")


QUERIES["map_replies"] = map_replies
ORACLES["map_replies"] = f"""with j as (select id, regexp_extract(reply, '\\{{.*\\}}', 0, 's') as t from {REPLIES.sql} x),
 p as (select id, case when json_valid(t) then json_extract_string(t, '$.canonical_field') end as f, case when json_valid(t) then json_extract_string(t, '$.confidence') end as c from j)
 select id, case when c is null or try_cast(c as double) is not null then f end as field, coalesce(try_cast(c as double), 0.0)::double as confidence from p"""
QUERIES |= {
    "sheet_names": lambda s, d: H.bronze_names(HEADERS.frame(s)),
    "sheet_sections": lambda s, d: H.sections(COLUMNS.frame(s)),
    "sheet_signature": lambda s, d: H.signature(HEADERS.frame(s)),
    "sheet_superset": lambda s, d: H.superset(H.bronze_names(HEADERS.frame(s))),
    "sheet_header_zone": lambda s, d: zones(s).select("sheet", F.array_join(F.col("header_rows").cast("array<string>"), ",").alias("header_rows"), "data_start_row", "fell_back"),
    "sheet_status": lambda s, d: H.structure_status(CELLS.frame(s), zones(s)),
    "sheet_headers": lambda s, d: H.headers(CELLS.frame(s), zones(s), MERGES.frame(s)).where("sheet = 'two'").select("idx", "header"),
    "sheet_blank_columns": lambda s, d: H.blank_columns(CELLS.frame(s)).groupBy("sheet").agg(F.count("*").alias("columns"), F.count_if("is_blank").alias("blank")),
    "sheet_combine": combined,
    "map_canonical": lambda s, d: mapped(s),
    "map_hybrid": hybrid,
    "map_counts": lambda s, d: M.counts(mapped(s)),
    "path_kind": lambda s, d: table(s, d, "pages").select("page_id", path_kind(F.concat(F.element_at(F.array(F.lit("/Volumes/"), F.lit("dbfs:/"), F.lit("/dbfs/"), F.lit("abfss://"), F.lit("/Workspace/"), F.lit("/tmp/")), (F.col("page_id") % 6 + 1).cast("int")), F.col("url"))).alias("kind")),
}
ORACLES |= {
    "sheet_names": f"select * from {NAMED} n",
    "sheet_sections": f"select *, (1 + sum(is_blank::int) over (partition by sheet order by idx))::int as section_id from {COLUMNS.sql} c",
    "sheet_signature": f"select sheet, sha256(string_agg(header, '|' order by idx)) as signature from {HEADERS.sql} h group by 1",
    "sheet_superset": f"select distinct bronze_name from {NAMED} n",
    "sheet_header_zone": f"select * from {ZONES} z",
    "sheet_status": f"""select c.sheet, case when count(*) filter (trim(value) <> '') = 0 then 'EMPTY_FILE' when count(*) filter (trim(value) <> '' and {IN_ZONE}) = 0 then 'NO_HEADERS' when count(*) filter (trim(value) <> '' and c.row >= data_start_row) = 0 then 'NO_DATA' else 'VALID' end as status
 from {CELLS.sql} c join {ZONES} z on z.sheet = c.sheet group by 1""",
    "sheet_headers": f"""select c.col as idx, coalesce(string_agg('[' || trim(coalesce(m.value, c.value)) || ']', '.' order by c.row) filter (trim(coalesce(m.value, c.value)) <> ''), '[Unnamed]') as header
 from {CELLS.sql} c join {ZONES} z on z.sheet = c.sheet and {IN_ZONE} left join (select g.*, o.value from {MERGES.sql} g join {CELLS.sql} o on o.sheet = g.sheet and o.row = g.min_row and o.col = g.min_col where g.min_row = g.max_row) m
 on m.sheet = c.sheet and m.min_row = c.row and c.col between m.min_col and m.max_col where c.sheet = 'two' group by 1""",
    "sheet_blank_columns": f"select sheet, max(col)::bigint as columns, max(col)::bigint - count(distinct col) filter (row <= 20 and trim(value) <> '') as blank from {CELLS.sql} c group by 1",
    "sheet_combine": "select n_nationkey::varchar as id, n_name as name, null::varchar as title, 'f1.xlsx' as source_file, 'n' as source_sheet, timestamp '2024-01-01 00:00:00' as insert_timestamp from nation union all select r_regionkey::varchar, null, r_name, 'f2.xlsx', 'r', timestamp '2024-01-01 00:00:00' from region",
    "map_canonical": f"select * from {MAPPED} m",
    "map_hybrid": f"select *, case when field is null then 'UNMAPPED' when confidence >= 0.9 then 'AUTO_APPROVED' when confidence >= 0.7 then 'NEEDS_REVIEW' else 'REQUIRES_HUMAN' end as status from (select id, header, case when c >= 0.5 then f else field end as field, case when c is not null then round(0.7 * confidence + 0.3 * c, 4) else confidence end as confidence from {MAPPED} m left join (select * from (values (1, 'order_id', 0.95::double), (5, 'amount', 0.6::double), (6, 'amount', 0.4::double)) as x(id, f, c)) y using (id)) z",
    "map_counts": f"select count(*) as columns, count(*) filter (status = 'AUTO_APPROVED') as auto_approved, count(*) filter (status = 'NEEDS_REVIEW') as needs_review, count(*) filter (status = 'REQUIRES_HUMAN') as requires_human, count(*) filter (status = 'UNMAPPED') as unmapped from {MAPPED} m",
    "path_kind": "select page_id, case page_id % 6 when 0 then 'VOLUME' when 1 then 'DBFS' when 2 then 'DBFS' when 3 then 'AZURE' when 4 then 'WORKSPACE' else 'LOCAL' end as kind from pages",
}
