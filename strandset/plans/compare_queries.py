"""Truth sets and call sets projected from orders, compared and merged."""
from __future__ import annotations

from pyspark.sql import functions as F

from strandset.operators import compare
from strandset.sources.driver_tables import table

from .registry import query

KIND = "CASE WHEN o_custkey % 11 = 0 THEN 'DEL' WHEN o_custkey % 13 = 0 THEN 'INS' ELSE 'SNV' END"
A1 = "CASE o_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 1 END"
A2 = "CASE o_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END"
TRUTH = f"SELECT concat('c', CAST(o_orderkey % 4 AS VARCHAR(1))) AS contig, o_orderkey AS pos, {A1} AS a1, {A2} AS a2, {KIND} AS type FROM orders WHERE o_orderkey % 3 <> 0"
SWAP = "(CAST(floor(o_orderkey / 97) AS BIGINT) % 2 = 1) <> (o_orderkey % 17 = 0)"
EVAL = f"""SELECT concat('c', CAST(o_orderkey % 4 AS VARCHAR(1))) AS contig, o_orderkey AS pos, CASE WHEN o_orderkey % 29 = 0 THEN -1 WHEN o_orderkey % 23 = 0 THEN 1 WHEN {SWAP} THEN {A2} ELSE {A1} END AS a1,
    CASE WHEN o_orderkey % 29 = 0 THEN -1 WHEN o_orderkey % 23 = 0 THEN 1 WHEN {SWAP} THEN {A1} ELSE {A2} END AS a2, {KIND} AS type, o_orderkey % 31 <> 0 AS phased FROM orders WHERE o_orderkey % 5 <> 0"""


def _rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    run = lambda q: spark.sql(q.replace("VARCHAR(1)", "STRING").replace("FROM orders", "FROM {orders}"), orders=orders)
    truth = run(TRUTH)
    return truth, compare.classified(compare.aligned(truth, run(EVAL)))


ALIGN = f"""WITH t AS ({TRUTH}), ev AS ({EVAL}), sp AS (SELECT contig, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM t GROUP BY 1),
    e AS (SELECT ev.* FROM ev JOIN sp USING (contig) WHERE pos BETWEEN lo AND hi),
    j AS (SELECT contig, pos, t.a1 AS t1, t.a2 AS t2, t.type AS t_type, e.a1 AS e1, e.a2 AS e2, e.type AS e_type, phased FROM t FULL OUTER JOIN e USING (contig, pos)),
    b AS (SELECT *, sum(CASE WHEN e1 IS NOT NULL AND NOT phased THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos) AS block, coalesce(t1 <> t2 AND e1 >= 0, false) AS het FROM j),
    o AS (SELECT *, CASE WHEN het AND t1 = e1 AND t2 = e2 THEN 1 WHEN het AND t1 = e2 AND t2 = e1 THEN -1 END AS o FROM b),
    f AS (SELECT *, het AND coalesce(sum(het::INT) OVER w, 0) = 0 AS first, last_value(o IGNORE NULLS) OVER w AS prev FROM o WINDOW w AS (PARTITION BY contig, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT contig, pos, block, CASE WHEN t1 IS NULL THEN 'FP' WHEN e1 IS NULL OR e1 < 0 THEN 'FN' WHEN t1 = t2 THEN CASE WHEN e1 = e2 AND t1 = e1 THEN 'TP' ELSE 'FPFN' END WHEN o IS NOT NULL THEN 'TP' WHEN first THEN 'FP' ELSE 'FPFN' END AS outcome,
        CASE WHEN coalesce(t1 = t2, e1 = e2) THEN 'hom' ELSE 'het' END AS zygosity, coalesce(t_type, e_type) AS type, first AS uncertain, coalesce(o IS NOT NULL AND NOT first AND o <> prev, false) AS switch,
        o IS NOT NULL AND NOT first AND NOT coalesce(o <> prev, false) AS consistent FROM f)"""


@query(ALIGN + " SELECT contig, pos, CAST(block AS BIGINT) AS block, outcome, zygosity, type, uncertain FROM c")
def truth_compare(spark, d):
    return _rows(spark, d)[1].select("contig", "pos", "block", "outcome", "zygosity", "type", "uncertain")


SWITCH = """, s AS (SELECT contig, CAST(count(*) FILTER (switch) AS BIGINT) AS switches, CAST(count(*) FILTER (consistent AND more) AS BIGINT) AS distance
    FROM (SELECT *, coalesce(max(switch::INT) OVER (PARTITION BY contig, block ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS more FROM c) GROUP BY 1)"""


@query(ALIGN + SWITCH + " SELECT * FROM s")
def switch_errors(spark, d):
    return compare.switches(_rows(spark, d)[1])


N = lambda on, name: f"CAST(count(*) FILTER ({on}) AS BIGINT) AS {name}"
_FN = "outcome IN ('FN', 'FPFN')"


@query(ALIGN + SWITCH + f""", g AS (SELECT contig, {N("outcome = 'TP'", 'tp')}, {N("outcome IN ('FP', 'FPFN')", 'fp')}, {N(_FN, 'fn')}, {N("outcome = 'TP' AND type = 'SNV'", 'tp_snv')}, {N(_FN + " AND type = 'SNV'", 'fn_snv')}, {N("outcome = 'TP' AND zygosity = 'het'", 'tp_het')}, {N(_FN + " AND zygosity = 'het'", 'fn_het')}, {N('uncertain', 'uncertain')} FROM c GROUP BY 1)
    SELECT contig, tp, fp, fn, uncertain, switches, hi - lo - n AS negatives, hi - lo - n - fp AS tn, round(tp / (tp + fn), 9) AS sensitivity, round(tp_snv / (tp_snv + fn_snv), 9) AS sensitivity_snv, round(tp_het / (tp_het + fn_het), 9) AS sensitivity_het,
    round((hi - lo - n - fp) / (hi - lo - n), 9) AS specificity, round(tp / (tp + fp), 9) AS precision, round(switches / (tp_het - uncertain), 9) AS switch_rate, round(distance / switches, 9) AS switch_distance FROM g JOIN sp USING (contig) JOIN s USING (contig)""")
def accuracy_report(spark, d):
    truth, rows = _rows(spark, d)
    out = compare.accuracy(rows, truth)
    ratios = ["sensitivity", "sensitivity_snv", "sensitivity_het", "specificity", "precision", "switch_rate", "switch_distance"]
    return out.select("contig", "tp", "fp", "fn", "uncertain", "switches", "negatives", "tn", *(F.round(c, 9).alias(c) for c in ratios))


@query(ALIGN + " SELECT contig, pos, outcome FROM c WHERE outcome IN ('FP', 'FPFN', 'FN')")
def compare_detail(spark, d):
    return compare.detail(_rows(spark, d)[1], 2 | 4).select("contig", "pos", "outcome")


REF = "CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'G' END"
V1 = f"SELECT concat('c', CAST(o_orderkey % 4 AS VARCHAR(1))) AS contig, o_orderkey AS pos, {REF} AS ref, CASE WHEN o_custkey % 5 = 0 THEN 'T,AT' ELSE 'T' END AS alt, CAST(o_custkey % 60 AS INTEGER) AS qual, CASE WHEN o_custkey % 7 = 0 THEN '.' ELSE 'PASS' END AS filter, '0|1' AS gt, concat('DP=', CAST(o_custkey % 50 AS VARCHAR(9)), ';AC=1') AS info FROM orders WHERE o_orderkey % 3 <> 0"
V2 = f"SELECT concat('c', CAST(o_orderkey % 4 AS VARCHAR(1))) AS contig, o_orderkey AS pos, CASE WHEN o_orderkey % 19 = 0 THEN 'N' ELSE {REF} END AS ref, CASE WHEN o_custkey % 5 = 0 THEN 'AT,T' WHEN o_orderkey % 23 = 0 THEN 'A' ELSE 'T' END AS alt, CAST(o_orderkey % 60 AS INTEGER) AS qual, CASE WHEN o_orderkey % 37 = 0 THEN 'LOW' ELSE 'PASS' END AS filter, '1|0' AS gt, concat('DP=', CAST(o_orderkey % 50 AS VARCHAR(9))) AS info FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"""WITH a AS ({V1}), b AS ({V2}) SELECT contig, pos, CASE WHEN b.ref IS NULL THEN 'first' WHEN a.ref IS NULL THEN 'second' WHEN a.ref = b.ref AND list_sort(string_split(a.alt, ',')) = list_sort(string_split(b.alt, ',')) AND replace(a.filter, '.', 'PASS') = replace(b.filter, '.', 'PASS') THEN 'both' ELSE 'conflict' END AS source,
    coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, least(a.qual, b.qual) AS qual, coalesce(a.filter, b.filter) AS filter, a.gt AS gt_1, CASE WHEN a.alt <> b.alt THEN reverse(b.gt) ELSE b.gt END AS gt_2,
    concat_ws(';', CASE WHEN a.info IS NOT NULL THEN '1_' || replace(a.info, ';', ';1_') END, '2_' || b.info) AS info FROM a FULL OUTER JOIN b USING (contig, pos)""")
def vcf_merge(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    run = lambda q: spark.sql(q.replace("VARCHAR(1)", "STRING").replace("VARCHAR(9)", "STRING").replace("FROM orders", "FROM {orders}"), orders=orders)
    return compare.merge_calls(run(V1), run(V2))
