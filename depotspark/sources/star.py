"""Order lines over the star schema: a clean view, and raw lines with planted faults for the cleaning rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# a long: order, line, and 25 bits that tell lines of one number apart; the last bit is for a repeated raw row
ROW_ID = "cast(l_orderkey * 536870912 + l_linenumber * 67108864 + (l_partkey * 1009 + l_suppkey * 53 + cast(l_quantity as bigint)) % 33554432 * 2 as bigint)"
DAY = "cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as string)"

#: Clean lines; the text is the data source of Spark and of the SQL checks alike.
SALES_SQL = f"""
select {ROW_ID} as row_id, 'OU' || {DAY} || lpad(cast(o_orderkey as string), 6, '0') as ship_no, cast(o_orderdate as date) as ship_date,
  l_partkey as item_id, 'P' || lpad(cast(l_partkey as string), 6, '0') as item_code, p_name as item_name, cast(substr(p_brand, 7) as int) as category_id,
  l_quantity as qty, o_custkey as store_id, r_name as city, n_name as district,
  cast((p_size * 2 + 1) * (l_partkey % 60 + 1) * (l_partkey % 40 + 5) as double) as volume_cm3,
  case when (p_size * 2 + 1) * (l_partkey % 60 + 1) * (l_partkey % 40 + 5) > 50000 or p_size * 2 + 1 > 60 then '棧板' else '貨架' end as storage_class,
  case when l_partkey % 14 < 6 then 'R' || lpad(cast(l_partkey % 10 as string), 2, '0') else 'L' || lpad(cast(l_partkey % 14 as string), 2, '0') end as zone,
  case when cast(substr(p_brand, 7) as int) % 2 = 0 then 'R' || lpad(cast(cast(substr(p_brand, 7) as int) % 10 as string), 2, '0') else 'L' || lpad(cast(cast(substr(p_brand, 7) as int) % 14 as string), 2, '0') end as before_zone
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{part}} on l_partkey = p_partkey join {{customer}} on o_custkey = c_custkey
  join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
"""

#: Addresses of the fixture: complete, abbreviated, old-style, with postal codes, cut and blank ones.
ADDRESSES = [
    "台北市士林區士東路100號", "北市士林區士東路100號", "111台北市士林區士東路100號", "士東路100號", "高雄縣橋頭鄉新莊村大學南路1號",
    "高縣茄萣鄉民生路二段8號", "鳳山市海洋一路121號", "屏東市自由路12號", "新北市板橋區文化路一段33號", "板橋市文化路一段33號",
    "高雄市前鎮區中山路5號", "桃園市平鎮區延平路二段7號", "台南市左鎮區光榮里光榮街90號", "新市鄉中山路3號", "左鎮鄉中正路9號",
    "平鎮市南京路6號", "高雄縣三民鄉民權路1號", "臺中市西屯區臺灣大道三段99號", "中市北區學士路2號", "(40768)台中市西屯區朝富路8號",
    "竹縣竹北市光明六路10號", "琉球鄉三民路14號", "台南縣永康市忠孝路561號", "忠孝東路四段561號", "光復里中山路5號",
    "獨有路1號", "不明地點", "", "  ", "花蓮市中華路77號",
]

_DIM = "case when {o} % 83 = {k} then '-' || {v} when {o} % 83 = {k} + 20 then '0' when {o} % 83 = {k} + 40 then 'n/a' when {o} % 17 = {k} then {v} || '0' when {p} % 61 = 0 then '{shared}' when {p} % 29 = {k} then null else {v} end"


def _dim(value: str, k: int, shared: str) -> str:
    return _DIM.format(o="l_orderkey", p="l_partkey", k=k, v=f"cast({value} as string)", shared=shared)


_PICK = "case (o_custkey % 300 * 7 + case when o_orderkey % 5 = 0 then o_orderkey % 3 else 0 end) % 30 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ADDRESSES)) + " end"
_WORDS = ["好奇 純水濕巾", "舒潔 抽取式衛生紙", "冷凍白蝦", "測試商品A", "無塵氏抹布", "寵物尿墊", "面膜組", "無名雜貨"]
_NAME = "case when l_partkey % 41 = 0 then '(' || cast(l_partkey % 90 as string) || ')' when l_partkey % 37 = 0 then case l_partkey % 8 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end else p_name end"

RAW_SQL = f"""
select row_id + d as row_id, ship_no, store_order_no, store_code, address, item_id, item_code, item_name, category_id, qty, unit, len_cm, wid_cm, hgt_cm, weight_kg from (
select {ROW_ID} as row_id, l_orderkey,
  case when o_orderkey % 101 = 0 then 'XX' when o_orderkey % 211 = 5 then 'OU20019999' else 'OU' || {DAY} end || lpad(cast(o_orderkey as string), 6, '0') as ship_no,
  case o_orderkey % 9 when 0 then ' n/a ' when 1 then '-' when 2 then '' when 3 then null else 'SO' || cast(o_orderkey as string) end as store_order_no,
  case when o_custkey % 53 = 0 then null else 'S' || lpad(cast(o_custkey % 300 as string), 4, '0') end as store_code,
  case when o_orderkey % 61 = 1 then null when o_orderkey % 499 = 7 and l_linenumber = 1 then '台北市信義區預設路1號' when o_orderkey % 19 = 3 then '共用市場路1號' when o_custkey % 300 < 12 then '台北市中正區忠孝路1號' else {_PICK} end as address,
  case when o_orderkey % 97 = 3 then null when o_orderkey % 97 = 4 then 'A1' when l_partkey % 5 = 0 then cast(l_partkey as string) || '.0' else cast(l_partkey as string) end as item_id,
  case when l_partkey % 6 = 0 then '  P' || cast(l_partkey as string) || ' ' else 'P' || cast(l_partkey as string) end as item_code,
  case when l_orderkey % 31 = 1 then null else {_NAME} end as item_name,
  case when l_partkey % 37 = 0 then null when l_orderkey % 23 = 5 then null when l_partkey % 59 = 0 then '81' else cast(10 + cast(substr(p_brand, 7) as int) % 25 as string) || case when l_partkey % 4 = 0 then '.0' else '' end end as category_id,
  case l_orderkey % 47 when 2 then null when 3 then '0' when 4 then 'abc' else cast(cast(l_quantity as int) as string) end as qty,
  case when l_orderkey % 43 = 7 then 'XX' when l_orderkey % 43 = 8 then null when l_partkey % 3 = 0 then ' 個 ' when l_partkey % 3 = 1 then '箱' else 'PCS' end as unit,
  {_dim("(p_size * 2 + 1)", 1, "999")} as len_cm, {_dim("(l_partkey % 60 + 1)", 2, "999")} as wid_cm, {_dim("(l_partkey % 40 + 5)", 3, "888")} as hgt_cm, {_dim("(l_partkey % 25 + 1)", 4, "777")} as weight_kg
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{part}} on l_partkey = p_partkey) x
join (select 0 as d union all select 1 as d) copies on d = 0 or l_orderkey % 89 = 4
"""

TABLES = ("lineitem", "orders", "part", "customer", "nation", "region")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # the JVM compiles no method above 8,000 bytes; with a limit there Spark deals wide projections over smaller ones
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    names = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean order lines."""
    return _view(spark, sf_dir, SALES_SQL)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines, all strings, with faults of every kind that the cleaning rules know."""
    return _view(spark, sf_dir, RAW_SQL)


def plain(sql: str) -> str:
    """The same text for an engine that has the tables as views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
