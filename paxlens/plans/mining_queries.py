"""Queries of rule-mining operators: parts act as mined rules, orders as samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mining
from .encoded import read
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
_CATEGORIES = ("INFORMATION_GATHERING", "DATA_TRANSMISSION", "DATA_ENCODING", "PAYLOAD_EXECUTION", "SPECIAL_PATTERNS")


def mined(spark, sf_dir):
    """Each order is a sample; each of its items a rule whose pattern is the part's brand."""
    li, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = li.join(part, li.l_partkey == part.p_partkey).withColumn("rule_ord", F.row_number().over(order) - 1)
    call = F.col("p_size") % 2 == 0
    cat = F.element_at(F.array(*map(F.lit, _CATEGORIES)), F.col("p_size") % 5 + 1)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("sample"), F.col("l_orderkey").cast("int").alias("sample_ord"), "rule_ord", F.concat(F.lit("X-"), F.col("p_partkey").cast("string")).alias("rule_id"), F.lit("").alias("name"),
        cat.alias("category"), F.when(call, "CALL").otherwise("ARGUMENT").alias("node_type"), F.when(call, F.col("p_brand")).alias("callee_name_regex"), F.when(~call & (F.col("p_size") % 3 == 0), F.concat(F.lit(" "), "p_brand")).alias("content_regex"), F.when(~call, F.col("p_type")).alias("content"),
    )


_mined = """m as (
  select l_orderkey::int as sample_ord, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::int as rule_ord, 'X-' || p_partkey as rule_id,
    (['INFORMATION_GATHERING', 'DATA_TRANSMISSION', 'DATA_ENCODING', 'PAYLOAD_EXECUTION', 'SPECIAL_PATTERNS'])[p_size % 5 + 1] as category, case when p_size % 2 = 0 then 'CALL' else 'ARGUMENT' end as node_type,
    case when p_size % 2 = 0 then p_brand when p_size % 3 = 0 then p_brand else p_type end as pattern, case when p_size % 2 = 0 or p_size % 3 = 0 then p_brand else '' end as regex
  from lineitem join part on l_partkey = p_partkey
)"""


@query(f"""with {_mined}, s as (select category, node_type, pattern, sample_ord, min(rule_ord) as rule_ord, arg_min(rule_id, rule_ord) as rule_id from m group by all)
select category, node_type, pattern, count(*)::bigint as freq, min(sample_ord)::int as first_sample, arg_max(rule_id, sample_ord) as rule_id from s group by all""")
def atomic_rule_freq(spark, sf_dir):
    a = mining.atomic(mined(spark, sf_dir))
    return a.select("category", "node_type", "pattern", "freq", F.col("first_seen.sample_ord").alias("first_sample"), F.col("rule.rule_id").alias("rule_id"))


@query(f"""with {_mined}, s as (select category, node_type, pattern, sample_ord, min(rule_ord) as rule_ord from m group by all),
a as (select category, node_type, pattern, count(*)::bigint as freq, min((sample_ord, rule_ord)) as seen from s group by all having count(*) >= 2)
select category, node_type, pattern, freq, row_number() over (partition by category order by freq desc, seen)::int as place, ((row_number() over (partition by category order by freq desc, seen) - 1) // 80)::int as batch from a""")
def rules_by_category(spark, sf_dir):
    return mining.by_category(mining.atomic(mined(spark, sf_dir))).select("category", "node_type", "pattern", "freq", "place", "batch")


@query(f"""with {_mined}, k as (select *, row_number() over (partition by node_type, regex order by case category when 'PAYLOAD_EXECUTION' then 0 when 'DATA_TRANSMISSION' then 1 when 'DATA_ENCODING' then 2 when 'INFORMATION_GATHERING' then 3 else 4 end, sample_ord, rule_ord) as n,
  min((sample_ord, rule_ord)) over (partition by node_type, regex) as place from m)
select category, node_type, regex, (case category when 'PAYLOAD_EXECUTION' then 'PE' when 'DATA_TRANSMISSION' then 'DT' when 'DATA_ENCODING' then 'DE' when 'INFORMATION_GATHERING' then 'IG' else 'SP' end) || '-' || lpad((row_number() over (partition by category order by place))::varchar, 3, '0') as rule_id from k where n = 1""")
def rule_dedup(spark, sf_dir):
    m = mined(spark, sf_dir).withColumn("seen", F.struct("sample_ord", "rule_ord"))
    return mining.cleaned(m).select("category", "node_type", mining.trimmed(F.coalesce("callee_name_regex", "content_regex", F.lit(""))).alias("regex"), "rule_id")


@query(f"""with {_mined} select category, count(*)::bigint as rules from m group by all""")
def rule_breakdown(spark, sf_dir):
    return mining.breakdown(mining.validated(mined(spark, sf_dir)))


@query("""with t as (select o_orderkey, 'Here: [{"rule_id": "R-' || o_orderkey || '", "category": "PAYLOAD_EXECUTION", "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": "' || o_orderpriority || '"}}] end' as raw from orders where o_orderstatus <> 'P')
select o_orderkey as sample_ord, 'R-' || o_orderkey as rule_id, regexp_extract(raw, '"callee_name_regex": "([^"]*)"', 1) as pattern from t""")
def parsed_answers(spark, sf_dir):
    """Answers of a model made from orders; some hold their list in a fence, and are lost with it."""
    o = read(spark, sf_dir, "orders")
    body = F.concat(F.lit('[{"rule_id": "R-'), F.col("o_orderkey").cast("string"), F.lit('", "category": "PAYLOAD_EXECUTION", "pdcg_pattern": {"node_type": "CALL", "callee_name_regex": "'), "o_orderpriority", F.lit('"}}]'))
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" end")))
    records = o.select(F.col("o_orderkey").cast("string").alias("sample"), F.col("o_orderkey").alias("sample_ord"), mining.answer_rules(raw).alias("rules"))
    return mining.valid(mining.flat(records)).withColumn("pattern", mining.pattern()).select("sample_ord", "rule_id", "pattern")
