"""SQL for the registered queries, for an engine with the tables as views."""

from __future__ import annotations

import re

from depotspark import reference_values as R
from depotspark.functions import address as A
from depotspark.sources.star import RAW_SQL, SALES_SQL, plain

SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


SALES = f"sales as materialized ({plain(SALES_SQL)})"
RAW14 = "ship_no, store_order_no, store_code, address, item_id, item_code, item_name, category_id, qty, unit, len_cm, wid_cm, hgt_cm, weight_kg"
DIMS4 = ["len_cm", "wid_cm", "hgt_cm", "weight_kg"]


def mode(src: str, key: str, value: str) -> str:
    return f"(select {key}, {value} as v from (select {key}, {value}, row_number() over (partition by {key} order by count(*) desc, cast({value} as varchar)) as r from {src} where {key} is not null and {value} is not null group by {key}, {value}) where r = 1)"


KEYWORD = "case " + " ".join(f"when regexp_matches(name_filled, {q(p)}) then {i}" for p, i in R.KEYWORD_RULES) + " end"
BAD_QTY = "(qty is null or qty <= 0)"
BAD_UNIT = "(unit is null or unit not in (" + ", ".join(q(u) for u in R.UNITS) + "))"
LETTERS = "(length(regexp_replace({0}, '[^一-鿿A-Za-z]', '', 'g')) < 2 and " + strip("{0}") + " <> '')"
NORM = f"""raw as materialized ({plain(RAW_SQL)}),
n0 as (select *, row_number() over (partition by {RAW14} order by row_id) > 1 as raw_dup from raw),
norm as materialized (select row_id, ship_no, case when upper({strip('store_order_no')}) in ('', 'NULL', 'N/A', 'NA', 'NONE', '-') then null else store_order_no end as store_order_no, store_code, address,
  cast(round_even(try_cast({strip('item_id')} as double), 0) as bigint) as item_id, {strip('item_code')} as item_code, {strip('item_name')} as item_name,
  cast(round_even(try_cast({strip('category_id')} as double), 0) as int) as category_id, qty as qty_raw, try_cast({strip('qty')} as double) as qty, {strip('unit')} as unit, len_cm, wid_cm, hgt_cm, weight_kg, raw_dup from n0)"""
CLEAN = f"""{NORM},
f1 as materialized (select norm.*, coalesce(item_name, m1.v) as name_filled, coalesce(category_id, m2.v) as c1 from norm left join {mode('norm', 'item_id', 'item_name')} m1 using (item_id) left join {mode('norm', 'item_id', 'category_id')} m2 using (item_id)),
f2 as materialized (select f1.*, coalesce(c1, m3.v) as category_filled from f1 left join {mode('f1', 'name_filled', 'c1')} m3 using (name_filled)),
f3 as (select *, row_number() over (partition by ship_no, store_order_no, store_code, address, item_id, item_code, name_filled, category_filled, qty_raw, unit, len_cm, wid_cm, hgt_cm, weight_kg order by row_id) > 1 as norm_dup from f2),
iso as materialized (select *, case when not coalesce(regexp_matches(ship_no, '^OU[0-9]{{14}}$'), false) then 'bad_ship_no' when raw_dup then 'duplicate' when item_id is null then 'no_item' when name_filled is null then 'no_name'
  when category_filled is null then 'no_category' when {BAD_QTY} then 'bad_qty' when {BAD_UNIT} then 'bad_unit' when norm_dup then 'normalized_duplicate' when category_filled in (81, 82) then 'test_category' end as reason0 from f3),
k1 as (select *, case when reason0 = 'no_category' then {KEYWORD} end as keyword from iso),
k2 as (select *, case when keyword >= 0 then keyword else category_filled end as category_final, case when keyword >= 0 then case when {BAD_QTY} then 'bad_qty' when {BAD_UNIT} then 'bad_unit' end else reason0 end as reason1 from k1),
cleaned as materialized (select *, case when reason1 is null and {LETTERS.format('name_filled')} then 'nondescriptive_name' else reason1 end as isolation_reason from k2)"""


def _typed() -> str:
    cols = ", ".join(f"nullif(abs(try_cast({strip(c)} as double)), 0) as {c}" for c in DIMS4)
    flags = ", ".join(f"coalesce({c} > {R.EXTREME_MAX[c]}, false) as x_{c}" for c in DIMS4)
    return f"t0 as (select * replace ({cols}) from cleaned), typed as materialized (select *, {flags} from t0)"


def _repair() -> str:
    parts = []
    stats = ", ".join(f"median({c}) filter (not x_{c}) as med_{c}, count({c}) filter (not x_{c}) as n_{c}" for c in DIMS4)
    parts.append(f"cstat as (select category_final, {stats} from typed where category_final is not null group by 1)")
    for c in DIMS4:
        parts.append(f"sh_{c} as (select v from (select item_id, arg_min({c}, row_id) as v from typed where x_{c} group by item_id) group by v having count(*) >= 10)")
        parts.append(f"v_{c} as (select item_id, {c} as y from typed where not x_{c})")
    sel, out = ["typed.* exclude (" + ", ".join([*DIMS4, *[f"x_{c}" for c in DIMS4]]) + ")"], []
    joins = " left join cstat on typed.category_final = cstat.category_final"
    for c in DIMS4:
        joins += f" left join {mode(f'v_{c}', 'item_id', 'y')} m_{c} on typed.item_id = m_{c}.item_id left join sh_{c} on typed.{c} = sh_{c}.v"
        sel += [f"typed.{c} as o_{c}", f"typed.x_{c} as x0_{c}", f"m_{c}.v as mode_{c}", f"x_{c} and sh_{c}.v is not null as sus_{c}"]
        fit = lambda f, c=c: f"(typed.{c} / {f} between med_{c} * (1.0::double / 3) and med_{c} * 3 and typed.{c} / {f} <= {R.EXTREME_MAX[c]})"
        sel.append(f"case when x_{c} and m_{c}.v is null and not (x_{c} and sh_{c}.v is not null) and n_{c} >= 5 then case when {fit(10)} then 10 when {fit(100)} then 100 when {fit(1000)} then 1000 end end as f_{c}")
        src = f"case when not (o_{c} is null or x0_{c}) then 'original' when mode_{c} is not null then 'item mode' when sus_{c} then 'excluded' when f_{c} is not null then 'category range /' || cast(f_{c} as varchar) when o_{c} is null then 'missing' else 'extreme' end"
        val = f"case when (o_{c} is null or x0_{c}) and mode_{c} is not null then mode_{c} when sus_{c} then null when f_{c} is not null then o_{c} / f_{c} else o_{c} end"
        out.append(f"{src} as {c}_source, {val} as {c}, {src} = 'extreme' as x_{c}")
    parts.append(f"r0 as (select {', '.join(sel)} from typed{joins})")
    drop = ", ".join(f"o_{c}, x0_{c}, mode_{c}, sus_{c}, f_{c}" for c in DIMS4)
    parts.append(f"repaired as materialized (select * exclude ({drop}), {', '.join(out)} from r0)")
    e = DIMS4[:3]
    meds = ", ".join(f"median({c}) filter (not x_{c}) as {c}" for c in e)
    parts.append(f"pi as (select category_final, item_id, {meds} from repaired where category_final is not null and item_id is not null group by 1, 2)")
    parts.append("cm as (select category_final, " + ", ".join(f"median({c}) as m_{c}, count({c}) as k_{c}" for c in e) + " from pi group by 1)")
    use = lambda c: f"repaired.{c} is null and coalesce(k_{c}, 0) >= 3"
    rep = ", ".join(f"case when {use(c)} then 'category median' else {c}_source end as {c}_source, case when {use(c)} then m_{c} else repaired.{c} end as {c}" for c in e)
    parts.append("imputed as materialized (select repaired.* exclude (" + ", ".join(f"{c}, {c}_source" for c in e) + f"), {rep} from repaired left join cm using (category_final))")
    guess = " or ".join(f"{c}_source = 'category median'" for c in e)
    parts.append(f"measured as materialized (select *, len_cm * wid_cm * hgt_cm as volume_cm3, case when len_cm * wid_cm * hgt_cm is null then '無法計算' when {guess} then '類別推估' else '實測' end as volume_source, cast(x_len_cm or x_wid_cm or x_hgt_cm or coalesce(len_cm * wid_cm * hgt_cm > 500000, false) as int) as volume_review from imputed)")
    return ", ".join(parts)


MEASURED = f"{CLEAN}, {_typed()}, {_repair()}"


def add(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"with {ctes} {body}"


add("clean_projection", NORM, "select * exclude (raw_dup) from norm")
add("paged_preview", NORM, f"select row_id, {RAW14} from raw order by row_id limit 20 offset 40")
add("null_tokens", NORM, "select row_id, store_order_no from norm")
add("to_int_half_even", SALES, "select row_id, cast(round_even(qty / 2, 0) as bigint) as half from sales")
add("ship_date_parse", NORM, "select row_id, case when regexp_matches(ship_no, '^OU[0-9]{14}$') then strftime(try_strptime(substr(ship_no, 3, 8), '%Y%m%d'), '%Y-%m-%d') end as ship_date from raw")
add("month_week_keys", SALES, "select row_id, strftime(ship_date, '%Y-%m') as month, strftime(date_trunc('week', ship_date), '%Y-%m-%d') as week from sales")
add("keyword_classify", NORM, f"select item_name, {KEYWORD.replace('name_filled', strip('item_name'))} as category from (select distinct item_name from raw)")
add("nondescriptive_names", NORM, f"select item_name, count(*) as n from raw where {LETTERS.format('item_name')} group by 1")
add("category_labels", NORM, "select case when c.category_id is null then '(空白)' when name is null then cast(c.category_id as varchar) else name || '（' || cast(c.category_id as varchar) || '）' end as label, n from (select category_id, count(*) as n from norm group by 1) c left join (values " + ", ".join(f"({i}, {q(n)})" for i, _, n in R.CATEGORIES) + ") t(category_id, name) on c.category_id = t.category_id")
add("dedup_first_row", NORM, "select row_id from norm where raw_dup")
add("mode_fill", CLEAN, "select row_id, name_filled, category_filled from f2")
add("isolation_reasons", CLEAN, "select row_id, reason0 as isolation_reason from iso")
add("isolation_counts", CLEAN, "select isolation_reason as value, count(*) as n from cleaned group by 1")
add("reclassified", CLEAN, "select row_id, category_final, isolation_reason from cleaned")
add("row_reconciliation", CLEAN, "select count(*) as n_rows, count(*) filter (isolation_reason is null) as n_clean, count(*) filter (isolation_reason is not null) as n_isolated from cleaned")
add("change_log", CLEAN, """select row_id, 'item_name' as "column", 'item mode' as rule, item_name as before, name_filled as after from cleaned where item_name is distinct from name_filled
union all select row_id, 'category_id', 'item or name mode', cast(category_id as varchar), cast(category_filled as varchar) from cleaned where category_id is distinct from category_filled
union all select row_id, 'category_id', 'keyword', cast(category_filled as varchar), cast(category_final as varchar) from cleaned where category_filled is distinct from category_final""")
add("dim_repair", MEASURED, "select row_id, " + ", ".join(f"round({c}, 6) as {c}, {c}_source" for c in DIMS4) + " from repaired")
add("dim_category_median", MEASURED, "select category_final, " + ", ".join(f"round(med_{c}, 6) as med_{c}, n_{c}" for c in DIMS4) + " from cstat")
add("dim_shared_values", MEASURED, " union all ".join(f"select '{c}' as dim, v as value from sh_{c}" for c in DIMS4))
add("volume_source", MEASURED, "select row_id, round(volume_cm3, 6) as volume_cm3, volume_source, volume_review from measured")
_modes = {"name_filled": "item_name", "category_final": "category_id", **{c: c for c in DIMS4}}
add("sku_master", MEASURED, "select g.*, sources, " + ", ".join(f"m{i}.v as {n}" for i, n in enumerate(_modes.values())) + """, round(m2.v * m3.v * m4.v, 6) as volume_cm3, greatest(m2.v, m3.v, m4.v) as edge_cm,
  case when m2.v * m3.v * m4.v is null or m2.v * m3.v * m4.v > 50000 or greatest(m2.v, m3.v, m4.v) > 60 then '棧板' else '貨架' end as storage_class
from (select item_id, count(*) as n_rows, """ + ", ".join(f"cast(count(distinct {c}) > 1 as int) as {c}_conflict" for c in DIMS4[:3]) + """, max(cast(volume_source = '類別推估' as int)) as any_imputed from measured where item_id is not null group by 1) g
join (select item_id, string_agg(volume_source || '×' || cast(k as varchar), '; ' order by volume_source || '×' || cast(k as varchar)) as sources from (select item_id, volume_source, count(*) as k from measured group by 1, 2) group by 1) s using (item_id)
""" + " ".join(f"left join {mode('measured', 'item_id', c)} m{i} using (item_id)" for i, c in enumerate(_modes)))

# ---- addresses
CITY = A.CITY
POSTAL = "^[(]?[\\p{Nd}]{3,6}[)]?[\\s,，、-]*"
ROAD_TOKEN, SECTION, VILLAGE = "([一-鿿]{1,10}?(?:大道|大街|路|街|道))", "([一二三四五六七八九十]|\\p{Nd})+段$", "^([一-鿿]{1,8}?(?:村|里))"


def values(d: dict[str, str]) -> str:
    return "(values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in d.items()) + ") t(k, v)"


def prefix_step(src: str, out: str, pattern: str, names: dict[str, str], keep: bool = False) -> str:
    new = "v || a" if keep else "v || substr(a, length(p) + 1)"
    return f"{out} as (select address, case when p = '' or regexp_matches(a, {q(CITY)}) then a else {new} end as a from (select address, a, regexp_extract(a, {q(pattern)}, 1) as p from {src}) left join {values(names)} on p = k)"


ANY = lambda names: "^(" + "|".join(names) + ")"
STARTS = " or ".join(f"regexp_matches(rest, {q(p)})" for p in (CITY, ANY([*R.OLD_COUNTIES, *R.CITY_ABBREVIATIONS, *R.OLD_COUNTY_ABBREVIATIONS]), A.TOWNSHIP, A.OLD_TOWNSHIP))
TOWN = r"^([^\s\p{Nd}]{1,3}?)(市|鎮|鄉)"
DIST = "^(" + "|".join(R.SPECIAL_DISTRICTS) + r"|[^\s\p{Nd}]{1,4}?(?:市|鎮|鄉|區))"


def split(src: str, col: str, out: str) -> str:
    return f"""{out}0 as (select *, nullif(regexp_extract({col}, {q(CITY)}, 1), '') as city, regexp_replace({col}, {q(CITY)}, '') as after from {src}),
{out}1 as (select *, nullif(regexp_extract(after, {q(DIST)}, 1), '') as district from {out}0),
{out} as (select * exclude (after), coalesce(substr(after, coalesce(length(district), 0) + 1), '') as rest from {out}1)"""


NORMED = f"""{NORM}, a0 as (select distinct address, address as a from raw where address is not null),
a1 as (select address, case when {STARTS} then rest else a end as a from (select *, regexp_replace(a, {q(POSTAL)}, '') as rest from a0)),
{prefix_step('a1', 'a2', ANY(R.CITY_ABBREVIATIONS), R.CITY_ABBREVIATIONS)}, {prefix_step('a2', 'a3', ANY(R.OLD_COUNTY_ABBREVIATIONS), R.OLD_COUNTY_ABBREVIATIONS)},
a4a as (select address, a, v, substr(a, length(k) + 1) as rest from a3 left join {values(R.OLD_COUNTIES)} on starts_with(a, k)),
a4b as (select *, regexp_extract(rest, {q(TOWN)}, 0) as town from a4a),
a4 as (select address, case when v is null then a when town = '' then v || rest else v || case when town = '三民鄉' then '那瑪夏區' else left(town, length(town) - 1) || '區' end || substr(rest, length(town) + 1) end as a from a4b),
{prefix_step('a4', 'a5', A.OLD_TOWNSHIP, A._DISTRICT_OF)}, {prefix_step('a5', 'a6', A.TOWNSHIP, A._COUNTY_OF, True)},
an as materialized (select address, a as norm from a6), {split('an', 'norm', 'addr')}"""
ROAD = f"nullif(regexp_replace(list_extract(regexp_extract_all(regexp_replace({strip('rest')}, {q(VILLAGE)}, ''), {q(ROAD_TOKEN)}, 1), -1), {q(SECTION)}, ''), '')"
canon = lambda c: f"translate({c}, '臺', '台')"
VILL = f"nullif(regexp_extract({strip('rest')}, {q(VILLAGE)}, 1), '')"
add("address_normalize", NORMED, "select address, norm from an union all select null, null where exists (select 1 from raw where address is null)")
add("address_split", NORMED, "select distinct norm, city, district, rest from addr")
add("road_village_tokens", NORMED, f"select distinct norm, {canon(ROAD)} as road, {canon(VILL)} as village from addr")
add("region_split", NORM, f"""select address, case when address is null or {strip('address')} = '' then '未知' when c = '' then address else c end as city,
 case when address is null or {strip('address')} = '' or c = '' then '未知' when r = '' then '未知' else r end as district from (select distinct address, regexp_extract(address, {q(CITY)}, 1) as c, regexp_replace(address, {q(CITY)}, '') as r from raw)""")
PARSED = f"""{NORMED}, parsed as materialized (select row_id, store_code, raw.address, norm, city, district, coalesce(rest, '') as rest, case when regexp_matches(ship_no, '^OU[0-9]{{14}}$') then cast(try_strptime(substr(ship_no, 3, 8), '%Y%m%d') as date) end as ship_date from raw left join addr using (address)),
sp as (select norm, store_code, count(*) as n from parsed where city is not null and district is not null and store_code is not null group by 1, 2 having count(*) <= 3),
shared as (select norm, store_code from sp where norm in (select norm from sp group by 1 having count(*) >= 5)),
tr as materialized (select p.*, s.norm is not null as placeholder, city is not null and district is not null and s.norm is null and p.store_code is not null as trusted from parsed p left join shared s on p.norm = s.norm and p.store_code = s.store_code),
vr as materialized (select store_code, city, district, rest, min(ship_date) as lo, max(ship_date) as hi, count(ship_date) as n from tr where trusted group by 1, 2, 3, 4)"""
add("shared_addresses", PARSED, "select norm, store_code from shared")
add("address_variants", PARSED, "select store_code, city, district, rest, strftime(lo, '%Y-%m-%d') as lo, strftime(hi, '%Y-%m-%d') as hi, n from vr")
FILLED = f"""{PARSED}, nv as (select store_code, count(*) as k from vr group by 1),
cand as (select tr.row_id, vr.city as vc, vr.district as vd, vr.rest as vrest, row_number() over (partition by row_id order by case when ship_date is null then -n when ship_date between lo and hi then 0 else coalesce(least(abs(datediff('day', lo, ship_date)), abs(datediff('day', hi, ship_date))), 1073741824) end, vr.city, vr.district, vr.rest) as r from tr join vr using (store_code)),
fl0 as (select tr.*, vc, vd, vrest, k, case when not trusted and vc is not null then case when placeholder or trim(tr.rest) = '' then vc || vd || vrest else vc || coalesce(district, vd) || tr.rest end else norm end as address_final,
 cast(not trusted and vc is null as int) as address_pending,
 case when trusted then case when norm = address then '原始完整' else '前綴正規化' end when vc is null then '無法處理' when k > 1 then '多版本回填' else '單一版本回填' end as address_source
 from tr left join (select * from cand where r = 1) c using (row_id) left join nv on tr.store_code = nv.store_code),
fl1 as (select row_id, address_final, address_source, address_pending from fl0), {split('fl1', 'address_final', 'fl2')},
filled as materialized (select *, case when address_pending = 0 then city || district end as region from fl2)"""
add("address_backfill", FILLED, "select row_id, address_final, address_source, address_pending, region from filled")
GAZ = f"""roads as (select * from (values ('台北市','士林區','士東路'), ('台北市','中正區','忠孝路'), ('台北市','大安區','忠孝東路'), ('高雄市','橋頭區','大學南路'), ('甲市','A區','中山路'), ('甲市','B區','中山路'), ('乙市','C區','中山路'), ('丙市','X區','獨有路'), ('台中市','西屯區','朝富路')) t(city, district, road)),
vills as (select * from (values ('甲市','B區','光復里'), ('丁市','D區','光復里'), ('戊市','Y區','獨有里'), ('台南市','左鎮區','光榮里')) t(city, district, village)),
rr as (select road, list(distinct city || district) as rs from roads group by 1), vv as (select village, list(distinct city || district) as vs from vills group by 1)"""
RESOLVED = f"""{FILLED}, {GAZ}, g0 as (select *, {canon(ROAD)} as road, {canon(VILL)} as village from filled),
g1 as (select g0.*, case when city is null or district is null then case when len(list_intersect(rs, vs)) = 1 then list_intersect(rs, vs)[1] when len(rs) = 1 then rs[1] when len(vs) = 1 then vs[1] end end as found, exists (select 1 from roads r where r.city = {canon('g0.city')} and r.district = {canon('g0.district')} and r.road = g0.road) as known from g0 left join rr using (road) left join vv using (village)),
resolved as (select row_id, coalesce(region, found) as region, case when found is not null then 0 else address_pending end as address_pending, case when found is not null then '路名回推補齊' when known then '路名相符(已驗證)' else '未比對' end as address_match, case when found is not null then address_source || '；路名回推' else address_source end as address_source from g1)"""
add("gazetteer_resolve", RESOLVED, "select row_id, region, address_pending, address_match from resolved")
PLACES = "pl as (select n_nationkey, trim(r_name) as city, trim(n_name) as district from nation join region on n_regionkey = r_regionkey), ro as (select distinct city, district, c_mktsegment || (c_custkey % 40)::varchar || '路' as road from customer join pl on c_nationkey = n_nationkey), vi as (select distinct city, district, (s_suppkey % 60)::varchar || '里' as village from supplier join pl on s_nationkey = n_nationkey)"
add("gazetteer_stats", PLACES, "select (select count(distinct road) from ro) as roads, (select count(*) from (select road from ro group by road having count(distinct city || district) = 1)) as unique_roads, (select count(distinct village) from vi) as villages, (select count(*) from (select village from vi group by village having count(distinct city || district) = 1)) as unique_villages, (select count(*) from ro) as triples")
add("address_source_buckets", RESOLVED, "select case when suffix(address_source, '路名回推') then '路名回推' when starts_with(address_source, '原始') then '原始' when starts_with(address_source, '前綴') then '正規化' when starts_with(address_source, '單一') then '單一版本' when starts_with(address_source, '多版本') then '多版本' when starts_with(address_source, '無法') then '待確認' else '其他' end as bucket, count(*) as n from resolved group by 1")
add("quality_scorecard", MEASURED, """select count(*) as n_rows, round(count(volume_cm3) * 100.0::double / count(*), 6) as coverage, round(count(*) filter (isolation_reason is null) * 100.0::double / count(*), 6) as accuracy,
round(count(*) filter (sd between date '1994-06-30' and date '1999-06-30') * 100.0::double / count(sd), 6) as timeliness, round(count(*) filter (volume_review = 1) * 100.0::double / count(*), 6) as review
from (select *, case when regexp_matches(ship_no, '^OU[0-9]{14}$') then cast(try_strptime(substr(ship_no, 3, 8), '%Y%m%d') as date) end as sd from measured)""")

# ---- ABC, co-picking
FREQ = f"{SALES}, freq as materialized (select item_id, count(distinct ship_no) as freq, arg_min(item_code, row_id) as item_code, arg_min(item_name, row_id) as item_name, arg_min(category_id, row_id) as category_id from sales group by 1), cfreq as (select category_id, cast(sum(freq) as bigint) as freq, count(*) as sku_count from freq group by 1)"


def classed(src: str, value: str, key: str, within: str = "") -> str:
    part = f"partition by {within}" if within else ""
    return f"(select *, case when cum <= 80 then 'A' when cum <= 95 then 'B' else 'C' end as cls from (select *, row_number() over ({part} order by {value} desc, {key}) as rank, 100.0::double * {value} / sum({value}) over ({part}) as share, 100.0::double * sum({value}) over ({part} order by {value} desc, {key} rows unbounded preceding) / sum({value}) over ({part}) as cum from {src}))"


add("sku_frequency", FREQ, "select * from freq")
add("sku_abc", FREQ, f"select item_id, freq, cast(rank as int) as rank, round(share, 6) as share, round(cum, 6) as cum, cls from {classed('freq', 'freq', 'item_id')}")
add("category_abc", FREQ, f"select category_id, freq, sku_count, cast(rank as int) as rank, round(share, 6) as share, round(cum, 6) as cum, cls from {classed('cfreq', 'freq', 'category_id')}")
add("pareto_points", FREQ, f", c as (select * from {classed('freq', 'freq', 'item_id')}), n as (select count(*) as n from c) select cast(rank as int) as rank, round(cum, 6) as cum, cls from c where rank in (select distinct case when n <= 220 then k + 1 else cast(round_even(k / 219.0::double * (n - 1), 0) as bigint) + 1 end from n, range(0, 220) t(k) where k < n)".lstrip())


def pair_sql(key: str, least: str) -> str:
    return f"ok as materialized (select distinct ship_no, {key} as k from sales), nn as (select count(distinct ship_no) as n from ok), kf as (select k, count(*) as f from ok group by 1), pr as (select x.*, x.count * 100.0::double / n as support, x.count * n / (fa.f * fb.f)::double as lift from (select a.k as a, b.k as b, count(*) as count from ok a join ok b on a.ship_no = b.ship_no and a.k < b.k group by 1, 2) x, nn, kf fa, kf fb where fa.k = x.a and fb.k = x.b and x.count >= {least})"


BY_N = "(case when n < 3000 then 3 when n < 20000 then 10 else 20 end)"
P_SEL = "select a, b, count, round(support, 6) as support, round(lift, 6) as lift from pr"
add("sku_pairs_min3", f"{SALES}, {pair_sql('item_id', '3')}", P_SEL)
add("pair_work", SALES, """, ok as materialized (select distinct ship_no, item_id as k from sales), kf as (select k, count(*) as f from ok group by 1),
per as (select ship_no, count(*) as s, count(*) filter (f >= 12) as t from ok join kf using (k) group by 1)
select count(*) as orders, cast(sum(s * (s - 1) // 2) as bigint) as rows_all, cast(sum(t * (t - 1) // 2) as bigint) as rows_made, max(s) as largest_order, any_value(x.keys) as keys, any_value(x.often) as often from per, (select count(*) as keys, count(*) filter (f >= 12) as often from kf) x""".lstrip())
add("brand_pairs", f"{SALES}, {pair_sql('category_id', BY_N)}", P_SEL)
add("top_lift_pairs", f"{SALES}, {pair_sql('category_id', BY_N)}", P_SEL + " order by count desc, a, b limit 40")
add("category_partners", f"{SALES}, {pair_sql('category_id', BY_N)}", "select case when a = 11 then b else a end as partner, count, round(lift, 6) as lift from pr where a = 11 or b = 11 order by lift desc, partner limit 10")
add("category_matrix", f"{SALES}, {pair_sql('category_id', '0')}, top as (select * from kf order by f desc, k limit 20)", "select a.k as a, b.k as b, count(*) as count, round(count(*) * any_value(n) / (any_value(fa.f) * any_value(fb.f))::double, 6) as lift from ok a join ok b on a.ship_no = b.ship_no and a.k <> b.k join top fa on fa.k = a.k join top fb on fb.k = b.k, nn group by 1, 2")

# ---- forecasts
EARLY = "sales0 as materialized ({}), sales as materialized (select * from sales0 where ship_date < date '1995-10-01')".format(plain(SALES_SQL))
CAL = """ends as (select min(ship_date) as lo, max(ship_date) as hi from sales where qty > 0),
cal as materialized (select cast(row_number() over (order by d) - 1 as int) as idx, strftime(d, '%Y-%m') as period from (select unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month)) as d, hi from ends) where last_day(cast(d as date)) <= hi or date_trunc('month', hi) > d)"""


def dense(key: str, value: str = "sum(qty)") -> str:
    return f"g as (select {key} as key, strftime(ship_date, '%Y-%m') as period, cast({value} as double) as v from sales where qty > 0 group by 1, 2), ks as (select distinct key from g join cal using (period)), d as materialized (select key, list(coalesce(v, 0.0::double) order by idx) as s from (select ks.key, idx, v from ks cross join cal left join g on g.key = ks.key and g.period = cal.period) group by 1)"


def models(h: str) -> list[str]:
    n = f"len({h})"
    ses = f"list_reduce({h}[2:], lambda a, x: 0.3::double * x + 0.7::double * a, {h}[1])"
    holt = f"list_reduce({h}[2:], lambda a, x: {{'l': 0.3::double * x + 0.7::double * (a.l + a.t), 't': 0.15::double * ((0.3::double * x + 0.7::double * (a.l + a.t)) - a.l) + 0.85::double * a.t}}, {{'l': {h}[1], 't': {h}[2] - {h}[1]}})"
    hits = f"list_filter(list_transform({h}, lambda v, i: {{'v': v, 'i': cast(i as double)}}), lambda x: x.v > 0)"
    cro = f"list_reduce({hits}[2:], lambda a, x: {{'z': 0.1::double * x.v + 0.9::double * a.z, 'x': 0.1::double * (x.i - a.last) + 0.9::double * a.x, 'last': x.i}}, {{'z': {hits}[1].v, 'x': {hits}[1].i, 'last': {hits}[1].i}})"
    return [
        f"{h}[{n}]", f"case when {n} >= 12 then {h}[{n} - 11] else {h}[{n}] end", f"list_avg({h}[greatest(1, {n} - 2):])", ses,
        f"greatest(0, {holt}.l + {holt}.t)", f"case when len({hits}) = 0 then 0 else {cro}.z / {cro}.x end",
    ]


NAMES = ["naive", "snaive", "ma3", "ses", "holt", "croston"]
DIFF = "list_avg(list_transform(range(2, te + 1), lambda i: abs(s[i] - s[i - 1])))"
MODEL_NAMES = "['Naive', '季節Naive', 'MA3', 'SES', 'Holt', 'Croston']"


def selected(extra: str = "") -> str:
    errs = ", ".join(f"sum(abs(act - ({m}))) as e{i}" for i, m in enumerate(models("h")))
    mase = ", ".join(f"case when denom > 0 then e{i} / k / denom else e{i} / k end" for i in range(6))
    hol = "list_reduce(h[2:], lambda a, x: {'l': 0.3::double * x + 0.7::double * (a.l + a.t), 't': 0.15::double * ((0.3::double * x + 0.7::double * (a.l + a.t)) - a.l) + 0.85::double * a.t}, {'l': h[1], 't': h[2] - h[1]})"
    ms = models("h")
    pred = f"greatest(0, case rank when 0 then {ms[0]} when 1 then case when te + hz - 13 >= 0 then s[te + hz - 12] else h[len(h)] end when 2 then {ms[2]} when 3 then {ms[3]} when 4 then {hol}.l + hz * {hol}.t else {ms[5]} end)"
    return f"""d1 as materialized (select key, s, len(s) - 3 as te from d{extra}), d2 as (select *, {DIFF} as denom from d1),
og as (select key, t, s[t + 1] as act, s[1:t] as h from (select key, s, unnest(range(greatest(3, te - 6), te)) as t from d2)),
er as (select key, count(*) as k, {errs} from og group by 1),
bm as (select d2.key, s, te, denom, [{mase}] as ms from d2 join er using (key)),
ch as materialized (select *, list_min(ms) as train_mase, list_position(ms, list_min(ms)) - 1 as rank from bm),
pr as materialized (select key, rank, denom, hz, {pred} as pred, coalesce(s[te + hz], 0) as actual from (select *, s[1:te] as h, unnest([1, 2, 3]) as hz from ch)),
ac as materialized (select key, any_value(rank) as rank, case when sum(actual) > 0 then sum(abs(pred - actual)) / sum(actual) * 100 end as wape, case when any_value(denom) > 0 then sum(abs(pred - actual)) / 3 / any_value(denom) end as mase, case when sum(actual) > 0 then abs(sum(pred) - sum(actual)) / sum(actual) * 100 end as tot_err, sum(pred) as pred_sum, sum(actual) as actual_sum from pr group by 1)"""


CATS = f"{SALES}, {CAL}, {dense('category_id')}"
add("period_totals", SALES, """, x as (select *, strftime(ship_date, '%Y-%m') as period from sales where qty > 0)
select 'all' as level, cast(null as bigint) as key, period, round(sum(qty), 6) as qty, count(*) as cnt from x group by period union all select 'category', category_id, period, round(sum(qty), 6), count(*) from x group by category_id, period union all select 'item', item_id, period, round(sum(qty), 6), count(*) from x group by item_id, period""")
add("calendar_months", f"{SALES}, {CAL}", "select idx, period from cal")
WEEKS = "select cast(row_number() over (order by d) - 1 as int) as idx, strftime(d, '%Y-%m-%d') as period from (select unnest(generate_series(date_trunc('week', min(ship_date)), date_trunc('week', max(ship_date)), interval 7 day)) as d from sales)"
add("calendar_weeks", SALES, WEEKS)
add("item_totals_window", SALES, "select item_id, round(sum(qty), 6) as total from sales where strftime(ship_date, '%Y-%m') between '1996-01' and '1996-03' group by 1")
add("fc_one_step", CATS, "select key, " + ", ".join(f"round({m}, 6) as {n}" for n, m in zip(NAMES, models("h"))) + " from (select key, s[1:len(s) - 3] as h from d)")
add("fc_select", f"{CATS}, {selected()}", f"select key, {MODEL_NAMES}[rank + 1] as model, round(train_mase, 6) as train_mase, round(denom, 6) as denom from ch")
add("fc_multistep", f"{CATS}, {selected()}", "select key, hz as h, round(pred, 6) as pred, round(actual, 6) as actual from pr")
ACC = f"select key, {MODEL_NAMES}[rank + 1] as model, round(wape, 6) as wape, round(mase, 6) as mase, round(tot_err, 6) as tot_err, round(pred_sum, 6) as pred_sum, round(actual_sum, 6) as actual_sum from ac"
add("fc_accuracy", f"{CATS}, {selected()}", ACC)


def weekly_naive(key: str) -> str:
    week = "strftime(date_trunc('week', ship_date), '%Y-%m-%d')"
    return f"""with {SALES}, cal as materialized ({WEEKS}),
g as (select {key} as key, {week} as period, cast(count(*) as double) as v from sales where qty > 0 and {key} is not null group by 1, 2),
d as (select key, list(coalesce(v, 0.0::double) order by idx) as s from (select ks.key, idx, v from (select distinct key from g) ks cross join cal left join g on g.key = ks.key and g.period = cal.period) group by 1),
e as (select key, s, greatest(len(s) - 13, 0) as k from d), f as (select key, s, s[k + 1:] as tail, case when k > 0 then s[k] else 0.0 end as naive from e)
select key, cast(len(s) as int) as n, round(list_sum(s), 6) as total, round(naive, 6) as naive, round(list_sum(tail), 6) as actual, round(list_sum(list_transform(tail, lambda x: abs(x - naive))) / len(tail), 6) as mae from f"""


for _name, _key in {"fc_weekly_item_naive": "item_id", "fc_weekly_naive_items": "item_id", "fc_weekly_category_naive": "category_id"}.items():
    SQL[_name] = weekly_naive(_key)
ITEMS = f"{EARLY}, {CAL}, {dense('item_id')}, prof as (select item_id as key, arg_min(category_id, row_id) as category_id, arg_min(storage_class, row_id) as storage_class from sales group by 1), fl as materialized (select key, s, list_position(list_transform(s, lambda v: v > 0), true) - 1 as first, len(s) - list_position(list_reverse(list_transform(s, lambda v: v > 0)), true) as last from d where list_max(s) > 0), nw as (select key, first from fl where first >= len(s) - 3 - 3)"
add("lifecycle", ITEMS, "select key, cast(first as int) as first, cast(last as int) as last, cast(len(s) - 1 - last as int) as dormant, case when first >= len(s) - 6 then '新品' when last <= len(s) - 4 then '滯銷' else '正常' end as stage from fl")
add("new_items", ITEMS, "select key, cast(first as int) as first from nw")
LEVELS = f"{ITEMS}, lv as (select category_id, storage_class, list_sum(s[1:len(s) - 3]) / (len(s) - 3) as level from d join prof using (key) where key not in (select key from nw)), an as (select category_id, storage_class, cast(count(*) as int) as peers, list_sort(list(level))[cast(floor(count(*) / 2) as int) + 1] as level from lv where level > 0 group by 1, 2), own as (select d.key, list_filter(s[1:len(s) - 3], lambda v: v > 0)[-1] as own from d join nw using (key)), cold as (select o.key, case when own is not null then 'own' when level is not null then 'analogue' else 'none' end as source, coalesce(own, level, 0) as level from own o join prof using (key) left join an using (category_id, storage_class))"
add("analogue_levels", LEVELS, "select category_id, storage_class, peers, round(level, 6) as level from an")
add("cold_start", LEVELS, "select key, source, round(level, 6) as level from cold")
PRED = f"{LEVELS}, {selected(' where key not in (select key from nw)')}, pi as (select key, pred_sum as value, 0 as is_new from ac union all select key, level * 3, 1 from cold)"
add("predicted_items", PRED, "select key, round(value, 4) as value, is_new from pi")
add("predicted_sku_abc", PRED, f", pv as (select key, storage_class, round(value, 4) as value from pi join prof using (key) where round(value, 4) > 0) select key, storage_class, round(value, 4) as value, cast(rank as int) as rank, cls from {classed('pv', 'value', 'key', 'storage_class')}")
CNT = f"{EARLY}, {CAL}, {dense('item_id', 'count(*)')}, nw as (select key from d where list_max(s) > 0 and list_position(list_transform(s, lambda v: v > 0), true) - 1 >= len(s) - 6), {selected(' where key not in (select key from nw)')}, freq as (select item_id, count(distinct ship_no) as freq from sales group by 1)"
add("predicted_with_history", CNT, "select coalesce(item_id, key) as key, round(coalesce(pred_sum, freq * 3.0::double / 9), 4) as value, cast(pred_sum is null as int) as from_history from freq full join ac on item_id = key")


add("predicted_category_abc", f"{CATS}, {selected()}, ac_ as (with {dense('category_id', 'count(*)')}, {selected()} select * from ac), mat as (select category_id as key, case when count(*) filter (storage_class = '棧板') > count(*) filter (storage_class = '貨架') then '棧板' else '貨架' end as material from sales group by 1), pc as (select ac.key, material, case when material = '貨架' then round(ac_.pred_sum, 6) else round(ac.pred_sum, 6) end as value from ac join ac_ using (key) join mat using (key))", f"select key, material, round(value, 6) as value, cast(rank as int) as rank, round(share, 6) as share, round(cum, 6) as cum, cls from {classed('pc', 'value', 'key', 'material')}")

# ---- waves
ZONES = "zones as (select 'R' || lpad(cast(i as varchar), 2, '0') as zone_id, 'shelf' as material, 20.0::double + 7 * i as area_m2, 10.0::double + 3 * i as distance_m from range(0, 10) t(i) union all select 'L' || lpad(cast(i as varchar), 2, '0'), 'pallet', 41.0::double + 5 * i, 11.5::double + 4 * i from range(0, 14) t(i))"
ORD = f"{SALES}, {ZONES}, ords as materialized (select ship_no, strftime(arg_min(ship_date, row_id), '%Y%m%d') as date, arg_min(city, row_id) as city, arg_min(district, row_id) as district, count(*) as lines from sales group by 1), items as materialized (select ship_no, item_id, count(*) as lines, sum(qty) as qty from sales group by 1, 2), mx as (select max(ship_date) as hi from sales), months as (select distinct substr(date, 1, 6) as month from ords, mx where last_day(hi) = hi or substr(date, 1, 6) <> strftime(hi, '%Y%m') order by 1 desc limit 3), win as materialized (select * from ords where substr(date, 1, 6) in (select month from months))"


def waved(src: str) -> str:
    return f"wo as materialized (select *, case when n >= 2 then 'dense' else 'pool' end as type, case when n >= 2 then district else '（稀疏併縣市）' end as wave_district from (select *, count(*) over (partition by date, city, district) as n from {src}))"


W = "date, city, wave_district, type"
SEED = f"""{ORD}, {waved('win')}, places as (select item_id, arg_min(zone, row_id) as zone, arg_min(before_zone, row_id) as before_zone from sales group by 1),
wi as (select {W}, item_id, sum(qty) as qty from items join wo using (ship_no) group by all),
sd as materialized (select wi.*, zone, distance_m, (row_number() over (partition by {W} order by coalesce(distance_m, 9999), zone, item_id) - 1) // 5 as round from wi left join places using (item_id) left join zones on zone = zone_id),
rd as (select {W}, round, sum(distance_m) * 2 as dist from (select distinct {W}, round, zone, distance_m from sd) group by all),
wt as materialized (select b.*, coalesce(sku_count, 0) as sku_count, coalesce(rounds, 1) as rounds, coalesce(wave_dist, 0) as wave_dist from (select {W}, count(*) as orders, cast(sum(lines) as bigint) as lines from wo group by all) b left join (select {W}, count(*) as sku_count, count(distinct round) as rounds from sd group by all) s using ({W}) left join (select {W}, sum(dist) as wave_dist from rd group by all) r using ({W})),
st as materialized (select * from (select cast(sum(orders) as bigint) as orders, cast(sum(lines) as bigint) as lines, cast(sum(rounds) as bigint) as seed_rounds, sum(wave_dist) as seed_dist, cast(sum(sku_count) as bigint) as seed_picks, median(sku_count) as median_skus, count(*) filter (sku_count > 5) as bound_waves, count(*) as waves from wt),
 (select sum(distance_m) * 2 as single_dist from (select distinct ship_no, zone from items join wo using (ship_no) join places using (item_id)) join zones on zone = zone_id),
 (select sum(distance_m) * 2 as before_dist from (select distinct ship_no, before_zone from items join wo using (ship_no) join places using (item_id)) join zones on before_zone = zone_id))"""
add("batch_simulate", SALES, "select orders, lines, rounds, round((orders - rounds) * 100.0::double / orders, 6) as improvement from (select count(distinct ship_no) as orders, count(*) as lines, greatest(1, cast(ceil(count(*) / 20) as bigint)) as rounds from sales)")
add("order_rollup", ORD, "select * from ords")
add("window_months", ORD, "select month from months")
add("ship_dates", ORD, "select distinct date from ords")
add("wave_split", f"{ORD}, {waved('win')}", f"select {W}, count(*) as orders, cast(sum(lines) as bigint) as lines from wo group by all")
add("wave_rounds", SEED, f"select {W}, orders, lines, sku_count, rounds, round(wave_dist, 6) as wave_dist from wt")
add("strategy_summary", SEED, "select orders, lines, seed_rounds, round(seed_dist, 6) as seed_dist, seed_picks, round(median_skus, 6) as median_skus, bound_waves, waves, round(single_dist, 6) as single_dist, round(before_dist, 6) as before_dist from st")
add("kpi", SEED, """, x as (select (before_dist - seed_dist) * 100 / before_dist as a, (orders - seed_rounds) * 100.0::double / orders as b, before_dist / 3600 + lines * 12.0::double / 3600 as w0, seed_dist / 3600 + seed_picks * 12.0::double / 3600 as w1 from st)
select round(a, 6) as dist_improvement, round(b, 6) as rounds_improvement, round((w0 - w1) * 100 / w0, 6) as worktime_improvement, a >= 10 as dist_met, b >= 10 as rounds_met, (w0 - w1) * 100 / w0 >= 5 as worktime_met from x""")
add("geo_top15", ORD, "select city, district, count(*) as orders, cast(sum(lines) as bigint) as lines from win group by 1, 2 order by orders desc, city, district limit 15")
DAYP = f"""{ORD}, dd as (select * from ords where date = '19960102'), {waved('dd')}, hd as materialized (select {W}, i.ship_no, item_id, i.qty, count(*) over (partition by i.ship_no) as k from items i join wo using (ship_no)),
sg as (select {W}, item_id, sum(qty) as qty, count(*) as serves, min({{'k': k, 's': ship_no, 'i': item_id}}) as seen from hd group by all),
pl as materialized (select sg.*, (row_number() over (partition by {W} order by seen) - 1) // 5 + 1 as round from sg)"""
add("day_plan", DAYP, f"select {W}, item_id, zone, serves, round(qty, 6) as qty, round from pl left join (select item_id, arg_min(zone, row_id) as zone from sales group by 1) using (item_id)")
add("order_completion", DAYP, f", lr as (select {W}, ship_no, max(round) as round from hd join pl using ({W}, item_id) group by all), dn as (select {W}, round, count(*) as done from lr group by all) select {W}, round, coalesce(done, 0) as done, cast(sum(coalesce(done, 0)) over (partition by {W} order by round) as bigint) as cum_done from (select distinct {W}, round from pl) left join dn using ({W}, round)")

# ---- layout
POOL = f"{ZONES}, pool as materialized (select *, cast(row_number() over (order by distance_m, zone_id, cell) - 1 as int) as slot from (select zone_id, material, distance_m, cast(unnest(range(0, greatest(1, cast(round_even(area_m2 / 2, 0) as bigint)))) as int) as cell from zones))"
add("slot_pool", f"{SALES}, {POOL}".replace(ZONES, ZONES.replace("zones as (", "zones0 as (") + ", zones as (select z.zone_id, material, coalesce(n * 4.0::double, area_m2) as area_m2, distance_m from zones0 z left join (select zone as zone_id, count(distinct item_id) as n from sales group by 1) using (zone_id))"), "select slot, zone_id, cell from pool")
add("plan_cells", """b as (select cast(substr(p_brand, 7) as int) as b, count(*) as n from part group by 1), z as (select dense_rank() over (order by b) - 1 as i, ceil(max(n) over () / 20) * 14 as high from b), v as (select max(84 + (i // 5 + 1) * (high + 48)) as vh, max(high) as high from z),
g as (select gx, gy, gx * 12 + 6 as x, gy * 12 + 6 as y, vh from v, range(0, 144) a(gx), range(0, cast((select ceil(vh / 12) from v) as int)) c(gy)),
k as (select g.*, y < vh and not (x between 400 and 424 and y between 6 and 36) and not exists (select 1 from z where x between 60 + i % 5 * 328 and 340 + i % 5 * 328 and y between 60 + i // 5 * (high + 48) and 60 + i // 5 * (high + 48) + high) as walk from g)""", "select cast(gy as int) as gy, count(*) as cells, count(*) filter (walk) as walkable from k group by 1")
REM = f"{FREQ}, {POOL}, pn as (select count(*) as n from pool), lr0 as (select category_id as key, freq, n * freq // sum(freq) over () as base, n * freq % sum(freq) over () as frac, n from cfreq, pn), lr1 as (select *, base + cast(row_number() over (order by frac desc, freq desc, key) <= n - sum(base) over () as int) as cell_count from lr0), lr2 as (select *, sum(cell_count) over (order by freq desc, key rows unbounded preceding) as stop from lr1), lr as materialized (select key, freq, cast(cell_count as bigint) as cell_count, avg(distance_m) as avg_dist, min(distance_m) as min_dist, max(distance_m) as max_dist from lr2 left join pool on slot >= stop - cell_count and slot < stop group by 1, 2, 3)"
add("largest_remainder", REM, "select key, freq, cell_count, round(avg_dist, 6) as avg_dist, round(min_dist, 6) as min_dist, round(max_dist, 6) as max_dist from lr")
add("category_layout_summary", REM, "select round(baseline, 6) as baseline, round(weighted, 6) as weighted, round((baseline - weighted) * 100 / baseline, 6) as improvement, round(used * 100.0::double / slots, 6) as coverage from (select avg(distance_m) as baseline, count(*) as slots from pool), (select sum(avg_dist * freq) / sum(freq) as weighted, sum(cell_count) as used from lr where cell_count > 0)")
CLUS = f"{FREQ}, {pair_sql('item_id', '3')}, ed as (select a, b from pr where lift >= 1.3 union select b, a from pr where lift >= 1.3), cc as (select item_id as id, item_id as c from freq union select e.b, cc.c from cc join ed e on e.a = cc.id), cl as materialized (select id, min(c) as component from cc group by 1)"
SQL["item_clusters"] = f"with recursive {CLUS} select id, component from cl"
ORDER = f"""{CLUS}, it as (select item_id as id, category_id, case when item_id % 14 < 6 then 'shelf' else 'pallet' end as material, freq, cls, item_id % 97 = 5 as flex from {classed('freq', 'freq', 'item_id')}),
ha as (select it.*, component, max(cast(cls = 'A' as int)) over w as has_a, max(cast(cls = 'B' as int)) over w as has_b, max(freq) over w as top from it join cl using (id) where not (cls = 'C' or flex) window w as (partition by material, component)),
un as (select id, material, cls, flex, case when has_a = 1 and has_b = 0 then 0 when has_a = 0 then 3 when cls = 'A' then 1 else 2 end as tier, top as g1, component as g2, 0 as c1, 0 as c2, freq as f from ha
 union all select id, material, cls, flex, 4, sum(freq) over (partition by material, category_id), category_id, sum(freq) over (partition by material, category_id), category_id, freq from it where cls = 'C' or flex),
po as materialized (select *, cast(row_number() over (partition by material order by tier, g1 desc, g2, c1 desc, c2, f desc, id) - 1 as int) as pos from un),
{POOL}, ce as (select *, row_number() over (partition by material order by distance_m + cell / 100.0::double, zone_id, cell) - 1 as sl, count(*) over (partition by material) as t from pool),
sp as (select po.*, t, count(*) over (partition by material) as n from po join (select material, max(t) as t from ce group by 1) using (material)),
s2 as materialized (select *, pos * t // n as start, greatest((pos + 1) * t // n, least(t, pos * t // n + 1)) as stop, case when flex then 'C' else cls end as pcls from sp),
ho as materialized (select id, zone_id, cell, pos, pcls from s2 join ce on ce.material = s2.material and sl = start)"""
SQL["placement_order"] = f"with recursive {ORDER} select id, material, tier, pos from po"
SQL["after_layout"] = f"with recursive {ORDER} select id, zone_id, cell from ho"
SQL["cell_classes"] = f"with recursive {ORDER} select zone_id, cell, arg_max(pcls, pos) as cell_class from s2 join ce on ce.material = s2.material and sl >= start and sl < stop group by 1, 2"
SQL["zone_class_mix"] = f"with recursive {ORDER} select zone_id, n_a, n_b, n_c, case when n_a >= n_b and n_a >= n_c then 'A' when n_b >= n_c then 'B' else 'C' end as lead, round(n_a * 100.0::double / n, 6) as a_pct from (select zone_id, count(*) filter (pcls = 'A') as n_a, count(*) filter (pcls = 'B') as n_b, count(*) filter (pcls = 'C') as n_c, count(*) as n from ho group by 1)"
SQL["class_mix"] = f"with recursive {ORDER} select material, round(count(*) filter (pcls = 'A') / count(*)::double, 6) as share_a, round(count(*) filter (pcls = 'B') / count(*)::double, 6) as share_b, round(count(*) filter (pcls = 'C') / count(*)::double, 6) as share_c from ho join zones using (zone_id) group by 1"
SQL["partner_rows"] = f"""with recursive {ORDER}, {re.sub(r"\b(ok|nn|kf|pr)\b", r"\g<1>2", pair_sql('item_id', '2'))},
me as (select item_id as x from freq order by freq desc, item_id limit 1), pz as (select po.id, po.material, po.cls, ho.zone_id, po.pos from po join ho using (id)), mine as (select * from pz where id = (select x from me))
select p.id, count, round(lift, 6) as lift, p.cls, p.zone_id, abs(p.pos - mine.pos) as order_gap, p.zone_id = mine.zone_id as same_zone, abs(p.pos - mine.pos) = 1 as adjacent
from (select case when a = x then b else a end as id, count, lift from pr2, me where (a = x or b = x) and count >= 2 and lift >= 1.0) q join pz p using (id) join mine on mine.material = p.material order by lift desc, id limit 10"""
add("cold_start_cards", f"{LEVELS}, ef as (select item_id as id, count(distinct ship_no) as freq from sales group by 1)", """, pe as (select category_id, storage_class, count(*) as peers, list_sort(list(freq))[cast(floor(count(*) / 2) as int) + 1] as median_freq from ef join prof on prof.key = ef.id where id not in (select key from nw) group by 1, 2)
select cold.key as id, prof.category_id, prof.storage_class as material, source <> 'own' as flex, coalesce(peers, 0) as peers, median_freq from cold join prof using (key) left join pe on pe.category_id = prof.category_id and pe.storage_class = prof.storage_class""")
add("day_waves", f"{ORD}, dd as (select * from ords where date = '19960102'), {waved('dd')}", f"select *, cast(row_number() over (partition by date order by orders desc, city, wave_district) as int) as place from (select {W}, count(*) as orders, cast(sum(lines) as bigint) as lines from wo group by all)")
_SEEDED = SEED[len(SALES) + len(ZONES) + 4:].replace("places as (select item_id, arg_min(zone, row_id) as zone, arg_min(before_zone, row_id) as before_zone from sales group by 1)", "places as (select id as item_id, zone_id as zone, zone_id as before_zone from ho)").replace(" sp as", " spx as")
SQL["wave_rounds_layout"] = f"with recursive {ORDER}, {_SEEDED} select {W}, orders, lines, sku_count, rounds, round(wave_dist, 6) as wave_dist from wt"
# ---- the cleaning run and its tables
_g = " or ".join(f"{c}_source = 'category median'" for c in DIMS4[:3])
_vol, _edge = "m2.v * m3.v * m4.v", "greatest(m2.v, m3.v, m4.v)"
_over = f"concat_ws(';', case when {_vol} > 50000 then '材積' || cast(cast(round_even({_vol} / 1000, 0) as bigint) as varchar) || 'L>50L' end, case when {_edge} > 60 then '最長邊' || cast(cast(round_even({_edge}, 0) as bigint) as varchar) || 'cm>60cm' end)"
MASTER = f"""{MEASURED}, {", ".join(f"so_{c} as (select item_id, string_agg(v || '×' || cast(k as varchar), '; ' order by k desc, v) as t from (select item_id, {c}_source as v, count(*) as k from measured group by 1, 2) group by 1)" for c in DIMS4)},
gm as (select item_id, count(*) as n_rows, {", ".join(f"cast(count(distinct {c}) > 1 as int) as {c}_conflict" for c in DIMS4)}, bool_or({_g}) as guessed from measured where item_id is not null group by 1),
master as materialized (select gm.item_id, {", ".join(f"m{i}.v as {n}" for i, n in enumerate(_modes.values()))}, {_vol} as volume_cm3, {_edge} as edge_cm, case when {_vol} is null then '無法計算(缺維度)' when guessed then '類別推估' else '實測' end as size_source,
 case when {_vol} is null or {_vol} > 50000 or {_edge} > 60 then '棧板' else '貨架' end as storage_class, case when {_vol} is null then '缺尺寸暫歸棧板(待量測)' when {_over} <> '' then {_over} else '材積≤50L且最長邊≤60cm' end as class_reason,
 {_vol} is not null as volume_usable, n_rows, {", ".join(f"so_{c}.t as {c}_sources, {c}_conflict" for c in DIMS4)}
 from gm {" ".join(f"left join so_{c} on so_{c}.item_id = gm.item_id" for c in DIMS4)} {" ".join(f"left join {mode('measured', 'item_id', c)} m{i} on m{i}.item_id = gm.item_id" for i, c in enumerate(_modes))})"""
add("sku_master_full", MASTER, "select * replace (round(volume_cm3, 6) as volume_cm3) from master")
RUN = f"""{MASTER}{RESOLVED[len(NORM):]}, run as materialized (select m.*, f.address as address0, f.address_final, r.address_source, r.address_pending, r.address_match, r.region, coalesce(master.storage_class, '未分類(無商品ID)') as storage_class
 from measured m join resolved r using (row_id) join (select row_id, address_final, address from filled join parsed using (row_id)) f using (row_id) left join master on master.item_id = m.item_id)"""
add("cleaning_run", RUN, f"select row_id, isolation_reason, item_id, name_filled, category_final, {', '.join(f'round({c}, 6) as {c}, {c}_source' for c in DIMS4)}, round(volume_cm3, 6) as volume_cm3, volume_source, volume_review, address_final, address_source, address_pending, address_match, region, storage_class from run")
_name_log = SQL["change_log"].rpartition("isolation_reason from k2)")[2]
add("change_log_all", RUN, _name_log + " union all " + " union all ".join(f"select row_id, '{c}', r.{c}_source, cast(round(t.{c}, 6) as varchar), cast(round(r.{c}, 6) as varchar) from run r join typed t using (row_id) where r.{c}_source not in ('original', 'missing', 'extreme')" for c in DIMS4)
    + " union all select row_id, 'address', address_source, address0, address_final from run where address_final is not null and address_final is distinct from address0")
_no = "isolation_reason"
REASONS = ["bad_ship_no", "duplicate", "no_item", "no_name", "no_category", "bad_qty", "bad_unit", "normalized_duplicate", "test_category", "nondescriptive_name"]
add("run_metrics", RUN, f"select count(*) as n_rows, count(*) filter ({_no} is null) as n_clean, count(*) filter ({_no} is not null) as n_isolated, " + ", ".join(f"count(*) filter ({_no} = '{r}') as reason_{r}" for r in REASONS)
    + f", count(*) filter (reason0 = 'no_category') as reclass_target, count(*) filter (keyword >= 0 and not ({BAD_QTY} or {BAD_UNIT})) as reclass_moved, count(*) filter (keyword < 0) as reclass_test, count(*) filter (keyword >= 0 and ({BAD_QTY} or {BAD_UNIT})) as reclass_still_bad, "
    + ", ".join(f"count(*) filter (address_match = '{m}') as match_{k}" for k, m in {"filled": "路名回推補齊", "verified": "路名相符(已驗證)", "none": "未比對", "absent": "未載入參考資料"}.items()) + ", count(*) filter (address_pending = 1) as address_pending, count(*) filter (volume_review = 1) as volume_review from run")
add("reclass_stats", CLEAN, f"select count(*) as target_total, count(*) filter (keyword >= 0 and not ({BAD_QTY} or {BAD_UNIT})) as moved, count(*) filter (keyword < 0) as test_placeholder, count(*) filter (keyword >= 0 and ({BAD_QTY} or {BAD_UNIT})) as still_bad, count(*) filter (keyword is null) as still_unmatched from k1 where reason0 = 'no_category'")
add("gazetteer_matches", RESOLVED, "select address_match, coalesce(n, 0) as n from (values ('未載入參考資料'), ('未比對'), ('路名回推補齊'), ('路名相符(已驗證)')) t(address_match) left join (select address_match, count(*) as n from resolved group by 1) using (address_match)")
# ---- forecast tables
CATEGORY_NAMES = "nm as (select * from (values " + ", ".join(f"({i}, {q(n)})" for i, _, n in R.CATEGORIES) + ") t(category_id, category_name))"
label = lambda c: f"case when {c} is null then '(空白)' when category_name is null then cast({c} as varchar) else category_name || '（' || cast({c} as varchar) || '）' end"
add("fc_context", CATS, "select cast(len(s) as int) as n_periods, cast(len(s) - 3 as int) as train_end, 3 as horizon, len(s) < 7 as insufficient from d limit 1")
add("fc_rolling", f"{CATS}, {selected()}, ro as (select key, hz, rank, s[1:te + hz - 1] as h, coalesce(s[te + hz], 0) as actual from (select *, unnest([1, 2, 3]) as hz from ch))", "select key, hz as h, round(greatest(0, case rank " + " ".join(f"when {i} then {m}" for i, m in enumerate(models("h"))) + " end), 6) as pred, round(actual, 6) as actual from ro")
_SERIES = f"select x.idx, period, round(x.actual, 6) as actual, x.idx >= te as in_test, round(pr.pred, 6) as pred, {MODEL_NAMES}[x.rank + 1] as model, round(wape, 6) as wape, round(mase, 6) as mase, 0 as is_new from (select key, te, rank, unnest(s) as actual, unnest(range(len(s))) as idx from ch) x join cal using (idx) join ac using (key) left join pr on pr.hz = x.idx - te + 1"
for _name, _view, _key, _value, _where in (("fc_series_all", SALES, "0", "sum(qty)", ""), ("fc_series_category", SALES, "category_id", "count(*)", " where key = 11"), ("fc_series_item", EARLY, "item_id", "sum(qty)", " where key = 7")):
    add(_name, f"{_view}, {CAL}, {dense(_key, _value)}, {selected(_where)}", _SERIES)
add("fc_breakdown", f"{CATS}, {selected()}, {CATEGORY_NAMES}", f"select key, {label('key')} as label, round(actual_sum, 6) as actual_sum, round(pred_sum, 6) as pred_sum, round(wape, 6) as wape, round(mase, 6) as mase, {MODEL_NAMES}[rank + 1] as model from ac left join nm on nm.category_id = ac.key")
ROWS = f"""{LEVELS}, {selected(' where key not in (select key from nw)')}, {CATEGORY_NAMES}, me as (select item_id as key, arg_min(item_code, row_id) as code, arg_min(item_name, row_id) as name, arg_min(category_id, row_id) as category_id from sales group by 1),
ir0 as (select key, {MODEL_NAMES}[rank + 1] as model, pred_sum, actual_sum, wape, tot_err, 0 as is_new from ac union all select key, 'cold start: ' || source, level * 3, list_sum(d.s[len(d.s) - 2:]), null, null, 1 from cold join d using (key)),
ir as materialized (select key, code, name, me.category_id, {label('me.category_id')} as label, list_sum(d.s) as total, actual_sum, pred_sum, wape, tot_err, model, is_new from ir0 join d using (key) join me using (key) left join nm on nm.category_id = me.category_id where list_sum(d.s) > 0)"""
_IR = "select key, code, name, category_id, label, round(total, 6) as total, round(actual_sum, 6) as actual_sum, round(pred_sum, 6) as pred_sum, round(wape, 6) as wape, round(tot_err, 6) as tot_err, model, is_new from "
add("fc_sku_rows", ROWS, _IR + "ir")
add("fc_sku_top", ROWS, _IR + "(select * from (select * from ir order by total desc, key limit 200) order by actual_sum desc, key limit 20)")
for _name in ("predicted_items", "predicted_sku_abc", "predicted_with_history", "fc_sku_rows"):  # the same over all sales
    SQL[f"{_name}_all"] = SQL[_name].replace(EARLY, SALES).replace("freq * 3.0::double / 9)", "freq * 3.0::double / (select count(*) from cal))")
SQL["predicted_top_per_material"] = f"select * from ({SQL['predicted_sku_abc']}) where rank <= 10"
add("pareto_ends", FREQ, f", c as (select * from {classed('freq', 'freq', 'item_id')}) select count(*) as items, round(count(*) filter (cls = 'A') * 100.0::double / count(*), 6) as a_pct, round(count(*) filter (cls <> 'C') * 100.0::double / count(*), 6) as b_pct from c".lstrip())
for name, sql in SQL.items():
    SQL[name] = sql.replace(") , ", "), ")
